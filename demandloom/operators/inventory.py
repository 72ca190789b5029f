"""Days of cover, reorder decisions and the per-product fact sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.functions import round_half_even, truncate
from demandloom.operators import series as S
from demandloom.session import checkpoint

# Gate and coefficients of the reorder rules.
MIN_SALE_ROWS = 14
LEAD_DAYS = 14
EMERGENCY_MINIMUM = 50
NEVER = 999


def _number(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def days_of_cover(products: DataFrame, averages: DataFrame) -> DataFrame:
    """Stock divided by daily sales (one decimal, NULL without sales) and margin in percent."""
    joined = products.join(
        averages.select(F.col("product_id").alias("_pid"), "daily_avg"), on=F.col("id") == F.col("_pid"), how="left"
    ).drop("_pid")
    price, cost = _number("base_price"), _number("unit_cost")
    cover = F.when(F.col("daily_avg") > 0, round_half_even(_number("current_stock") / F.col("daily_avg"), 1))
    margin = F.when(price > 0, round_half_even((price - cost) / price * 100, 1)).otherwise(0.0)
    return joined.withColumns({"days_of_cover": cover, "margin_pct": margin})


def daily_average(sales: DataFrame) -> DataFrame:
    """Per product: sale rows and mean quantity over the days with sales."""
    return (
        S.daily_totals(sales)
        .groupBy("product_id")
        .agg(F.sum("sale_rows").alias("sale_rows"), F.avg("quantity").alias("daily_avg"))
    )


def reorder_plan(products: DataFrame, sales: DataFrame, lead_days: int = LEAD_DAYS) -> DataFrame:
    """What to order, when, and why, for every product of the catalogue.

    The first rule that applies decides. Products with fewer than 14 sale rows get status no_data.
    """
    averages = daily_average(sales).withColumnRenamed("product_id", "id")
    base = products.select(
        "id",
        F.col("name").alias("product_name"),
        F.coalesce(F.col("current_stock"), F.lit(0)).cast("bigint").alias("stock"),
        F.coalesce(F.col("safety_stock"), F.lit(0)).cast("bigint").alias("safety"),
    ).join(averages, on="id", how="left")
    avg, stock, safety = F.col("daily_avg"), F.col("stock"), F.col("safety")
    facts = base.withColumn("cover", F.when(avg > 0, round_half_even(stock / avg, 1)))
    cover = F.col("cover")
    lead = str(lead_days)
    cover_s, stock_s, safety_s = cover.cast("string"), stock.cast("string"), safety.cast("string")
    zero = F.lit(0).cast("bigint")

    def decision(text, quantity, wait, confidence, factor, risk):
        return F.struct(
            text.alias("reorder_recommendation"),
            quantity.cast("bigint").alias("order_quantity"),
            wait.cast("bigint").alias("reorder_in_days"),
            F.lit(confidence).alias("confidence"),
            F.array(factor).alias("key_factors"),
            F.array(F.lit(risk)).alias("risk_factors"),
        )

    no_velocity = decision(
        F.lit("No sales data — monitor inventory manually."),
        zero,
        F.lit(NEVER),
        "low",
        F.lit("No sales history available"),
        "Cannot determine demand pattern",
    )
    depleted = decision(
        F.lit("URGENT: Stock is depleted. Place an emergency order immediately."),
        F.greatest(safety * 2, F.lit(EMERGENCY_MINIMUM).cast("bigint")),
        zero,
        "medium",
        F.lit("Current stock is zero"),
        "Stockout likely causing lost sales",
    )
    short = decision(
        F.concat(F.lit("Reorder soon — stock will run out within "), cover_s, F.lit(f" days (lead time: {lead}d).")),
        F.greatest(truncate(avg * lead_days * 1.5), safety),
        F.greatest(zero, truncate(cover - lead_days * 0.7)),
        "medium",
        F.concat(F.lit("Days of cover ("), cover_s, F.lit(f") <= lead time ({lead}d)")),
        "Lead time delays could cause stockout",
    )
    low = decision(
        F.concat(
            F.lit("Below safety stock ("), stock_s, F.lit(" < "), safety_s, F.lit("). Reorder to restore buffer.")
        ),
        truncate(safety * 1.5),
        zero,
        "high",
        F.concat(F.lit("Stock ("), stock_s, F.lit(") below safety stock ("), safety_s, F.lit(")")),
        "Unexpected demand spike could cause stockout",
    )
    adequate = decision(
        F.concat(
            F.lit("Stock level is adequate ("),
            stock_s,
            F.lit(", "),
            cover_s,
            F.lit(" days of cover). No urgent reorder needed."),
        ),
        zero,
        F.greatest(F.lit(1).cast("bigint"), truncate(cover - lead_days)),
        "high",
        F.concat(F.lit("Days of cover ("), cover_s, F.lit(f") exceeds lead time ({lead}d)")),
        "Sales velocity increase could reduce days of cover",
    )
    enough = F.coalesce(F.col("sale_rows"), F.lit(0)) >= MIN_SALE_ROWS
    chosen = (
        F.when(cover.isNull(), no_velocity)
        .when(stock <= 0, depleted)
        .when(cover <= lead_days, short)
        .when(stock < safety, low)
        .otherwise(adequate)
    )
    return facts.withColumn("d", F.when(enough, chosen)).select(
        F.col("id").alias("product_id"),
        "product_name",
        F.when(enough, "success").otherwise("no_data").alias("status"),
        "d.reorder_recommendation",
        "d.order_quantity",
        "d.reorder_in_days",
        F.when(enough, truncate(cover)).alias("stock_out_in_days"),
        "d.confidence",
        "d.key_factors",
        "d.risk_factors",
    )


def insight_facts(products: DataFrame, sales: DataFrame, scope: str = "week", direction: str = "chronological") -> DataFrame:
    """One row per product with enough history: levels, trend, cover and the recent scope values.

    The value list holds at most the scope's limit (60 days, 26 weeks, 24 months, 10 years). The facts
    are read once, into a table of daily totals.
    """
    daily = checkpoint(S.daily_totals(sales))
    stats = S.series_stats(scope=scope, daily=daily).filter(F.col("sale_rows") >= MIN_SALE_ROWS)
    weeks = S.complete_weeks(daily, last=S.TREND_POINTS)
    trend = S.trend(weeks, order="period_start", direction=direction).select(
        "product_id", F.col("trend").alias("trend_description"), F.col("pct_change").alias("trend_pct")
    )
    wanted = S.max_values(scope)
    freq = S.FORECAST_FREQ.get(scope, "D")
    buckets = S.resample(daily, freq, by=["product_id"], date_col="day", last=wanted)
    recent = (
        S.last_n(buckets, wanted, most_recent_first=True)
        .groupBy("product_id")
        .agg(F.sort_array(F.collect_list(F.struct("position", "quantity"))).alias("v"))
        .select("product_id", F.col("v.quantity").alias("recent_values"))
    )
    covered = days_of_cover(products, stats).withColumnRenamed("id", "product_id").drop("daily_avg")
    return covered.join(stats, on="product_id").join(trend, on="product_id", how="left").join(
        recent, on="product_id", how="left"
    ).withColumn(
        "trend_description", F.coalesce("trend_description", F.lit("Insufficient data to determine trend"))
    ).withColumn("lead_time_days", F.lit(LEAD_DAYS))


def insight_features(sales: DataFrame, scope: str = "week", horizon: int = 4) -> DataFrame:
    """One row per product: the features of its recent buckets, newest first, and of the next ones.

    ``historical_features`` are structs (date, quantity, calendar columns of the scope,
    prev_period_sales, rollback_n) of at most the scope's limit of buckets; ``future_features`` hold
    what is known of the next ``horizon`` buckets; ``weekday_means`` is filled for the scope day.
    """
    daily = checkpoint(S.daily_totals(sales))
    scope, wanted, one = S.base_scope(scope), S.max_values(scope), ["product_id"]
    # as many more buckets as the first one's rolling sum looks back at
    margin = S.ROLLING_LENGTH.get(scope, 1) + 1
    buckets = S.resample(daily, S.FORECAST_FREQ.get(scope, "D"), by=one, date_col="day", last=wanted + margin).select(*one, "period_end", "quantity")
    lagged = S.last_n(S.calendar_for_scope(S.lag_features(buckets, scope), scope, "period_end"), wanted, most_recent_first=True)
    calendar = S.SCOPE_CALENDAR[scope]
    row = F.struct(
        "position",
        F.date_format("period_end", "yyyy-MM-dd").alias("date"),
        *[round_half_even(F.col(c), 1).alias(c) for c in ("quantity", "prev_period_sales", "rollback_n")],
        *calendar,
    )
    history = lagged.groupBy(*one).agg(F.sort_array(F.collect_list(row)).alias("historical_features"))
    future = S.future_features(buckets, horizon, scope)
    ahead = F.struct("period", F.date_format("date", "yyyy-MM-dd").alias("date"), *calendar, "prev_period_sales", "rollback_n")
    out = history.join(future.groupBy(*one).agg(F.sort_array(F.collect_list(ahead)).alias("future_features")), on=one)
    if scope != "day":
        return out.withColumn("weekday_means", F.lit(None).cast("map<string,double>"))
    days = S.dow_averages(daily).groupBy(*one).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("day_name", "average")))).alias("weekday_means"))
    return out.join(days, on=one)
