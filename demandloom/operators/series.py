"""Time buckets, gap filling, lags and per-product series statistics.

Facts are first summed per (key, bucket) with map-side combining. Every window below runs over those
sums, so its partition is at most the number of buckets of one key, however many facts the key has.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.functions import name_col, round_half_even, truncate
from demandloom.operators.features import calendar_parts
from demandloom.operators.relational import product_sales
from demandloom.session import checkpoint

FREQUENCIES = ("D", "W", "M", "Q", "Y")

# Bucket per scope name, one table per caller that buckets time.
TREND_FREQ = {"day": "D", "week": "W", "month": "M", "year": "Q"}
HISTORY_FREQ = {"day": "D", "week": "W", "month": "M", "year": "Q", "5years": "Y", "beginning": "W"}
FORECAST_FREQ = {"day": "D", "week": "W", "month": "M", "year": "Y", "5years": "Y", "beginning": "D"}
SCOPE_MAX_VALUES = {"day": 60, "week": 26, "month": 24, "year": 10}
DEFAULT_MAX_VALUES = 60
ROLLING_LENGTH = {"day": 7, "week": 4, "month": 3}
SCOPE_CALENDAR = {
    "day": ("month", "day_of_week"),
    "week": ("month", "week_of_year", "week_of_month"),
    "month": ("month", "quarter"),
    "year": (),
}
DAY_NAMES = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
MIN_TREND_POINTS = 3
TREND_POINTS = 12

_STEP = {
    "D": "interval 1 day",
    "W": "interval 7 days",
    "M": "interval 1 month",
    "Q": "interval 3 months",
    "Y": "interval 12 months",
}


def period_start(day: Column, freq: str) -> Column:
    """First day of the bucket; weeks run Monday to Sunday."""
    if freq == "D":
        return day
    if freq == "W":
        return F.date_sub(day, F.weekday(day))
    return F.trunc(day, {"M": "month", "Q": "quarter", "Y": "year"}[freq]) if freq in "MQY" else _bad(freq)


def period_end(start: Column, freq: str) -> Column:
    """Last day of the bucket that starts on ``start``."""
    if freq == "D":
        return start
    if freq == "W":
        return F.date_add(start, 6)
    if freq == "M":
        return F.last_day(start)
    if freq == "Q":
        return F.last_day(F.add_months(start, 2))
    return F.make_date(F.year(start), F.lit(12), F.lit(31)) if freq == "Y" else _bad(freq)


def _bad(freq: str):
    raise ValueError(f"unknown frequency {freq!r}, expected one of {FREQUENCIES}")


def _step_back(start: Column, freq: str, steps: int = 1) -> Column:
    days, months = {"D": 1, "W": 7}.get(freq), {"M": 1, "Q": 3, "Y": 12}.get(freq)
    return F.date_sub(start, days * steps) if days else F.add_months(start, -months * steps)


def periods_between(first: Column, last: Column, freq: str) -> Column:
    """Number of buckets from ``first`` to ``last``, both bucket starts, both counted."""
    if freq in ("D", "W"):
        return F.floor(F.date_diff(last, first) / (1 if freq == "D" else 7)) + 1
    months = (F.year(last) - F.year(first)) * 12 + F.month(last) - F.month(first)
    return F.floor(months / {"M": 1, "Q": 3, "Y": 12}[freq]) + 1


def ordered_by(by: Sequence[str], *order):
    """Window over one key's buckets. Without a key it spans the whole, bucket-bounded, series."""
    return Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)


def fill_gaps(
    buckets: DataFrame,
    freq: str,
    values: Sequence[str],
    by: Sequence[str] = (),
    start: str = "period_start",
    last: int | None = None,
) -> DataFrame:
    """Add the missing buckets between the first and the last of each key, with 0.

    Each bucket is stretched up to the one after it, so no calendar is joined. ``last`` keeps only
    that many buckets at the end of each key, and no others are made.
    """
    following = F.lead(start).over(ordered_by(by, start))
    spans = buckets.withColumns(
        {"_from": F.col(start), "_until": F.coalesce(_step_back(following, freq), F.col(start))}
    )
    if last is not None:
        # the newest bucket of the key, by the same partitioning and order as above
        newest = F.max(start).over(ordered_by(by, start).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        spans = spans.withColumn("_oldest", _step_back(newest, freq, last - 1))
        spans = spans.filter(F.col("_until") >= F.col("_oldest")).withColumn("_from", F.greatest(start, "_oldest"))
    stretched = spans.withColumn("_bucket", F.explode(F.sequence(F.col("_from"), F.col("_until"), F.expr(_STEP[freq]))))
    real = F.col("_bucket") == F.col(start)
    return stretched.select(
        *by,
        F.col("_bucket").alias(start),
        *[F.when(real, name_col(v)).otherwise(F.lit(0).cast(buckets.schema[v].dataType)).alias(v) for v in values],
    )


_REDUCERS = {"sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max}


def resample(
    df: DataFrame,
    freq: str,
    values: Sequence[str] | Mapping[str, Column] = ("quantity",),
    how: str = "sum",
    by: Sequence[str] = (),
    date_col: str = "ds",
    fill: bool = True,
    last: int | None = None,
) -> DataFrame:
    """Bucketed values per key: columns ``by``, period_start, period_end and the values.

    Empty buckets between the first and the last are 0 for sums and counts (``fill``). ``last`` keeps
    the newest buckets of each key only.
    """
    exprs = values if isinstance(values, Mapping) else {v: name_col(v).cast("double") for v in values}
    start = period_start(F.to_date(name_col(date_col)), freq)
    buckets = (
        df.filter(name_col(date_col).isNotNull())
        .groupBy(*by, start.alias("period_start"))
        .agg(*[_REDUCERS[how](e).alias(v) for v, e in exprs.items()])
    )
    if fill and how in ("sum", "count"):
        buckets = fill_gaps(buckets, freq, list(exprs), by, last=last)
    elif last is not None:
        raise ValueError("last needs a gap-filled series")
    return buckets.select(
        *by, "period_start", period_end(F.col("period_start"), freq).alias("period_end"), *list(exprs)
    )


def demand_trends(sales: DataFrame, scope: str = "week") -> DataFrame:
    """Total sales per bucket with a 10 % uplift as forecast, in time order."""
    freq = TREND_FREQ.get(scope, "W")
    series = resample(sales, freq, {"total": F.col("quantity").cast("double")})
    pattern = "yyyy-MM-dd" if freq == "D" else "MMM dd"
    return series.select(
        F.date_format("period_end", "yyyy-MM-dd").alias("date"),
        F.date_format("period_end", pattern).alias("name"),
        truncate(F.col("total")).alias("sales"),
        truncate(F.col("total") * 1.1).alias("forecast"),
    ).orderBy("date")


def product_sales_history(
    sales: DataFrame,
    scope: str = "month",
    start: Any = None,
    end: Any = None,
    product_ids: Sequence[Any] | None = None,
) -> DataFrame:
    """Quantity and revenue per product and bucket, for all products unless some are named."""
    freq = HISTORY_FREQ.get(scope, "M")
    rows = product_sales(sales, product_ids, start, end)
    quantity = F.col("quantity").cast("double")
    values = {"quantity": quantity, "revenue": quantity * F.col("price_at_sale").cast("double")}
    series = resample(rows, freq, values, by=["product_id"])
    return series.select(
        "product_id",
        F.date_format("period_end", "yyyy-MM-dd").alias("date"),
        truncate(F.col("quantity")).alias("quantity"),
        round_half_even(F.col("revenue"), 2).alias("revenue"),
    )


def scope_key(ds: Column, scope: str) -> Column:
    """Text key of the bucket: 2024-12-30, 2025-W01, 2024-12 or 2024. An unknown scope means day."""
    day = F.to_date(ds)
    if scope == "week":
        iso_year = F.extract(F.lit("YEAROFWEEK"), day).cast("string")
        return F.concat(iso_year, F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))
    return F.date_format(day, {"month": "yyyy-MM", "year": "yyyy"}.get(scope, "yyyy-MM-dd"))


def scope_series(sales: DataFrame, scope: str = "day", by: Sequence[str] = ("product_id",)) -> DataFrame:
    """Sums per bucket key without gap filling: the input of the forecasters."""
    return sales.groupBy(*by, scope_key(F.col("ds"), scope).alias("bucket")).agg(
        F.sum(F.col("quantity").cast("double")).alias("quantity")
    )


def lag_features(
    series: DataFrame,
    scope: str,
    by: Sequence[str] = ("product_id",),
    order: str = "period_end",
    value: str = "quantity",
) -> DataFrame:
    """``prev_period_sales`` and ``rollback_n``: the sum of the last 7 days, 4 weeks or 3 months
    before the row, NULL until that many exist; yearly series have no rolling sum."""
    w = ordered_by(by, order)
    out = series.withColumn("prev_period_sales", F.lag(value).over(w))
    n = ROLLING_LENGTH.get(scope)
    if n is None:
        return out.withColumn("rollback_n", F.lit(None).cast("double"))
    before = w.rowsBetween(-n, -1)
    full = F.count(value).over(before) == n
    return out.withColumn("rollback_n", F.when(full, F.sum(value).over(before)))


def ml_lags(
    series: DataFrame,
    lags: Sequence[int] = (1, 7),
    by: Sequence[str] = ("product_id",),
    order: str = "period_end",
    value: str = "quantity",
) -> DataFrame:
    """``lag_k`` per requested lag, and the month of the bucket."""
    w = ordered_by(by, order)
    return series.withColumns(
        {**{f"lag_{k}": F.lag(value, k).over(w) for k in lags}, "month": F.month(name_col(order))}
    )


def calendar_for_scope(df: DataFrame, scope: str, date_col: str) -> DataFrame:
    """The calendar columns a scope uses."""
    parts = calendar_parts(name_col(date_col))
    return df.withColumns({c: parts[c] for c in SCOPE_CALENDAR[scope]}) if SCOPE_CALENDAR[scope] else df


def base_scope(scope: str) -> str:
    """day, week, month or year; ``5years`` is read as year, anything else unknown as day."""
    return scope if scope in SCOPE_CALENDAR else {"5years": "year"}.get(scope, "day")


def future_features(
    series: DataFrame,
    horizon: int,
    scope: str = "day",
    by: Sequence[str] = ("product_id",),
    value: str = "quantity",
) -> DataFrame:
    """What is known about the next ``horizon`` buckets of each series.

    ``series`` is a resampled series. The rolling sum given for the first period is that of the last
    historical row, which does not include that row itself.
    """
    scope = base_scope(scope)
    history = lag_features(series, scope, by, "period_end", value)
    last = history.groupBy(*by).agg(
        F.max("period_end").alias("last_date"),
        F.max_by(value, "period_end").alias("last_value"),
        F.max_by("rollback_n", "period_end").alias("last_rollback"),
    )
    ahead = last.withColumn("period", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    p, last_date = F.col("period"), F.col("last_date")
    date = {
        "day": F.date_add(last_date, p),
        "week": F.date_add(last_date, p * 7),
        "month": F.add_months(last_date, p),
        "year": F.make_date(F.year(last_date) + p, F.lit(1), F.lit(1)),
    }[scope]
    dated = calendar_for_scope(ahead.withColumn("date", date), scope, "date")
    first = p == 1
    return dated.select(
        *by,
        "period",
        "date",
        *SCOPE_CALENDAR[scope],
        F.when(first, round_half_even(F.col("last_value"), 1)).alias("prev_period_sales"),
        F.when(first, round_half_even(F.col("last_rollback"), 1)).alias("rollback_n"),
    )


def last_n(
    series: DataFrame,
    n: int,
    by: Sequence[str] = ("product_id",),
    order: str = "period_end",
    most_recent_first: bool = False,
) -> DataFrame:
    """The last ``n`` buckets per key, numbered in ``position`` from 1."""
    newest = series.withColumn("_back", F.row_number().over(ordered_by(by, F.desc(order)))).filter(
        F.col("_back") <= n
    )
    if most_recent_first:
        return newest.withColumnRenamed("_back", "position")
    return newest.drop("_back").withColumn("position", F.row_number().over(ordered_by(by, order)))


def max_values(scope: str) -> int:
    return SCOPE_MAX_VALUES.get(scope, DEFAULT_MAX_VALUES)


def daily_totals(sales: DataFrame, by: Sequence[str] = ("product_id",)) -> DataFrame:
    """Quantity and number of sale rows per key and day."""
    return (
        sales.filter(F.col("ds").isNotNull())
        .groupBy(*by, F.to_date("ds").alias("day"))
        .agg(F.sum(F.col("quantity").cast("double")).alias("quantity"), F.count(F.lit(1)).alias("sale_rows"))
    )


def weekly_totals(daily: DataFrame, by: Sequence[str] = ("product_id",)) -> DataFrame:
    return daily.groupBy(*by, period_start(F.col("day"), "W").alias("period_start")).agg(
        F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("sale_days")
    )


def complete_weeks(daily: DataFrame, by: Sequence[str] = ("product_id",), last: int | None = None) -> DataFrame:
    """Weekly sums with gaps as 0, without the last week of a key when it has fewer than 7 sale days.

    ``last`` makes no more weeks per key than are needed to have that many complete ones.
    """
    values = ["quantity", "sale_days"]
    filled = fill_gaps(weekly_totals(daily, by), "W", values, by, last=None if last is None else last + 1)
    is_last = F.lead("period_start").over(ordered_by(by, "period_start")).isNull()
    marked = filled.withColumn("_partial", is_last & (F.col("sale_days") < 7))
    return marked.filter(~F.col("_partial")).drop("sale_days", "_partial")


def filled_moments(buckets: DataFrame, freq: str, by: Sequence[str]) -> DataFrame:
    """Count, mean, sample sd and last value of the gap-filled series, without filling it.

    A missing bucket is 0: it adds one to the count and the squared mean to the squared deviations.
    """
    every = Window.partitionBy(*by)
    start = F.col("period_start")
    n = periods_between(F.min(start).over(every), F.max(start).over(every), freq)
    placed = buckets.withColumns({"_n": n, "_total": F.sum("quantity").over(every)})
    mean = F.col("_total") / F.col("_n")
    per_key = placed.withColumn("_mean", mean).groupBy(*by).agg(
        F.max("_n").alias("scope_count"),
        F.max("_mean").alias("scope_mean"),
        F.sum((F.col("quantity") - F.col("_mean")) * (F.col("quantity") - F.col("_mean"))).alias("_squares"),
        F.count(F.lit(1)).alias("_held"),
        F.max_by("quantity", start).alias("scope_last_value"),
    )
    gaps = (F.col("scope_count") - F.col("_held")) * F.col("scope_mean") * F.col("scope_mean")
    spread = F.sqrt((F.col("_squares") + gaps) / (F.col("scope_count") - 1))
    return per_key.select(
        *by, "scope_count", "scope_mean", F.when(F.col("scope_count") > 1, spread).alias("scope_std"), "scope_last_value"
    )


def series_stats(
    sales: DataFrame | None = None,
    scope: str = "day",
    by: Sequence[str] = ("product_id",),
    daily: DataFrame | None = None,
) -> DataFrame:
    """Per key: level and spread of the scope series, and daily, weekly and monthly averages.

    The facts are read once, into a table of daily totals that all statistics come from; pass
    ``daily`` to use an existing one.
    """
    by = list(by)
    if daily is None:
        daily = checkpoint(daily_totals(sales, by))
    month = period_start(F.col("day"), "M")
    months = periods_between(F.min(month), F.max(month), "M")
    per_day = daily.groupBy(*by).agg(
        F.sum("sale_rows").alias("sale_rows"),
        F.avg("quantity").alias("daily_avg"),
        F.stddev_samp("quantity").alias("daily_std"),
        (F.sum("quantity") / months).alias("monthly_avg"),
    )
    # Mean over the gap-filled weeks, from totals: the filled zeros only count in the divisor.
    weeks = weekly_totals(daily, by).groupBy(*by).agg(
        F.sum("quantity").alias("total"),
        periods_between(F.min("period_start"), F.max("period_start"), "W").alias("n"),
        F.max_by("quantity", "period_start").alias("last_quantity"),
        F.max_by("sale_days", "period_start").alias("last_days"),
    )
    partial = F.col("last_days") < 7
    kept_total = F.col("total") - F.when(partial, F.col("last_quantity")).otherwise(0.0)
    kept_n = F.col("n") - F.when(partial, 1).otherwise(0)
    per_week = weeks.select(*by, F.coalesce(F.try_divide(kept_total, kept_n), F.lit(0.0)).alias("weekly_avg"))
    freq = FORECAST_FREQ.get(scope, "D")
    buckets = resample(daily, freq, by=by, date_col="day", fill=False)
    per_scope = filled_moments(buckets, freq, by)
    return per_day.join(per_week, on=by).join(per_scope, on=by)


def dow_averages(daily: DataFrame, by: Sequence[str] = ("product_id",)) -> DataFrame:
    """Mean per weekday, Monday to Sunday, 0 for a weekday without sales: one row per key and day."""
    weekday = F.weekday("day")
    wide = daily.groupBy(*by).agg(
        *[F.coalesce(F.avg(F.when(weekday == i, F.col("quantity"))), F.lit(0.0)).alias(n) for i, n in enumerate(DAY_NAMES)]
    )
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("day_of_week"), F.lit(n).alias("day_name"), F.col(n).alias("average"))
            for i, n in enumerate(DAY_NAMES)
        ]
    )
    return wide.select(*by, F.inline(cells))


def trend(
    series: DataFrame,
    n: int = TREND_POINTS,
    by: Sequence[str] = ("product_id",),
    order: str = "period_end",
    value: str = "quantity",
    direction: str = "chronological",
) -> DataFrame:
    """Least-squares trend over the last ``n`` buckets, as percent of the mean, with a label.

    ``direction="reference"`` numbers the points from the newest backwards, which turns the sign.
    """
    points = last_n(series, n, by, order, most_recent_first=(direction == "reference"))
    y, x = name_col(value).cast("double"), F.col("position").cast("double")
    fit = points.groupBy(*by).agg(
        F.count(y).alias("points"), F.avg(y).alias("mean"), F.regr_slope(y, x).alias("slope")
    )
    pct = F.coalesce(F.try_divide(F.col("slope") * F.col("points"), F.col("mean")) * 100, F.lit(0.0))
    out = fit.withColumn("pct_change", F.when(F.col("points") >= MIN_TREND_POINTS, pct))
    shown = F.replace(F.format_number("pct_change", 0), F.lit(","), F.lit(""))
    up, moderate_up = F.col("pct_change") > 10, F.col("pct_change") > 3
    down, moderate_down = F.col("pct_change") < -10, F.col("pct_change") < -3
    label = (
        F.when(F.col("points") < MIN_TREND_POINTS, "Insufficient data to determine trend")
        .when(up, F.concat(F.lit("Strong upward trend (+"), shown, F.lit("% over recent period)")))
        .when(moderate_up, F.concat(F.lit("Moderate upward trend (+"), shown, F.lit("%)")))
        .when(down, F.concat(F.lit("Strong downward trend ("), shown, F.lit("%)")))
        .when(moderate_down, F.concat(F.lit("Moderate downward trend ("), shown, F.lit("%)")))
        .otherwise("Relatively flat / stable")
    )
    return out.select(*by, "points", "slope", "pct_change", label.alias("trend"))
