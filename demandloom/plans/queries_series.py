"""Registered queries: time buckets, lags, series statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom.operators import series as S
from demandloom.plans import views as V
from demandloom.plans.registry import query

ISO_DAY = "yyyy-MM-dd"


def _text_dates(df, *columns):
    return df.withColumns({c: F.date_format(c, ISO_DAY) for c in columns})


@query(
    "resample_monthly",
    "SELECT product_id, strftime(mo, '%Y-%m-%d') AS period_start, strftime(last_day(mo), '%Y-%m-%d') AS period_end, quantity FROM monthly_filled",
    ["monthly_filled"],
)
def resample_monthly(spark, sf):
    return _text_dates(S.resample(V.sales(spark, sf), "M", by=["product_id"]), "period_start", "period_end")


@query(
    "resample_daily_total",
    """WITH d AS (SELECT CAST(ds AS DATE) AS day, sum(quantity) AS quantity FROM sales GROUP BY 1),
            s AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d)
       SELECT strftime(s.day, '%Y-%m-%d') AS period_start, strftime(s.day, '%Y-%m-%d') AS period_end, coalesce(quantity, 0) AS quantity
       FROM s LEFT JOIN d ON s.day = d.day""",
    ["sales"],
)
def resample_daily_total(spark, sf):
    return _text_dates(S.resample(V.sales(spark, sf), "D"), "period_start", "period_end")


@query(
    "resample_quarterly",
    """WITH q AS (SELECT product_id, CAST(date_trunc('quarter', ds) AS DATE) AS q, sum(quantity) AS quantity FROM sales GROUP BY 1, 2),
            s AS (SELECT product_id, CAST(unnest(generate_series(min(q), max(q), INTERVAL 3 MONTH)) AS DATE) AS q FROM q GROUP BY 1)
       SELECT s.product_id, strftime(s.q, '%Y-%m-%d') AS period_start, strftime(last_day(s.q + INTERVAL 2 MONTH), '%Y-%m-%d') AS period_end,
              coalesce(quantity, 0) AS quantity FROM s LEFT JOIN q ON s.product_id = q.product_id AND s.q = q.q""",
    ["sales"],
)
def resample_quarterly(spark, sf):
    return _text_dates(S.resample(V.sales(spark, sf), "Q", by=["product_id"]), "period_start", "period_end")


@query(
    "resample_yearly_mean",
    """SELECT product_id, strftime(date_trunc('year', ds), '%Y-%m-%d') AS period_start, concat(CAST(year(ds) AS VARCHAR), '-12-31') AS period_end,
              round(avg(quantity), 6) AS quantity FROM sales GROUP BY 1, 2, 3""",
    ["sales"],
)
def resample_yearly_mean(spark, sf):
    out = S.resample(V.sales(spark, sf), "Y", how="mean", by=["product_id"])
    return _text_dates(out, "period_start", "period_end").withColumn("quantity", F.round("quantity", 6))


def _trend_sql(scope: str) -> str:
    unit, step, end = {
        "day": ("day", "1 DAY", "p"),
        "week": ("week", "7 DAY", "p + INTERVAL 6 DAY"),
        "month": ("month", "1 MONTH", "last_day(p)"),
        "year": ("quarter", "3 MONTH", "last_day(p + INTERVAL 2 MONTH)"),
    }[scope]
    name = "'%Y-%m-%d'" if scope == "day" else "'%b %d'"
    return f"""WITH b AS (SELECT CAST(date_trunc('{unit}', ds) AS DATE) AS p, sum(quantity) AS total FROM sales GROUP BY 1),
        s AS (SELECT CAST(unnest(generate_series(min(p), max(p), INTERVAL {step})) AS DATE) AS p FROM b),
        f AS (SELECT {end} AS e, coalesce(total, 0) AS total FROM (SELECT s.p, b.total FROM s LEFT JOIN b ON s.p = b.p))
        SELECT strftime(e, '%Y-%m-%d') AS date, strftime(e, {name}) AS name, CAST(trunc(total) AS BIGINT) AS sales,
               CAST(trunc(total * CAST(1.1 AS DOUBLE)) AS BIGINT) AS forecast FROM f"""


def _demand_trends(scope):
    def run(spark, sf):
        return S.demand_trends(V.sales(spark, sf), scope)

    query(f"demand_trends_{scope}", _trend_sql(scope), ["sales"])(run)


for _scope in ("day", "week", "month", "year"):
    _demand_trends(_scope)


@query(
    "product_sales_history",
    """WITH r AS (SELECT product_id, CAST(date_trunc('month', ds) AS DATE) AS mo, sum(quantity) AS q, sum(quantity * price_at_sale) AS rev FROM sales
                  WHERE ds >= TIMESTAMP '1996-03-10' AND ds <= TIMESTAMP '1999-11-20' GROUP BY 1, 2),
            s AS (SELECT product_id, CAST(unnest(generate_series(min(mo), max(mo), INTERVAL 1 MONTH)) AS DATE) AS mo FROM r GROUP BY 1)
       SELECT s.product_id, strftime(last_day(s.mo), '%Y-%m-%d') AS date, CAST(trunc(coalesce(q, 0)) AS BIGINT) AS quantity, round(coalesce(rev, 0), 2) AS revenue
       FROM s LEFT JOIN r ON s.product_id = r.product_id AND s.mo = r.mo""",
    ["sales"],
)
def product_sales_history(spark, sf):
    return S.product_sales_history(V.sales(spark, sf), "month", "1996-03-10", "1999-11-20")


@query(
    "scope_series_week",
    "SELECT product_id, strftime(ds, '%G-W%V') AS bucket, sum(quantity) AS quantity FROM sales GROUP BY 1, 2",
    ["sales"],
)
def scope_series_week(spark, sf):
    return S.scope_series(V.sales(spark, sf), "week")


@query(
    "scope_series_month",
    "SELECT product_id, strftime(ds, '%Y-%m') AS bucket, sum(quantity) AS quantity FROM sales GROUP BY 1, 2",
    ["sales"],
)
def scope_series_month(spark, sf):
    return S.scope_series(V.sales(spark, sf), "month")


def _history_sql(unit: str, step: str, end: str) -> str:
    return f"""WITH r AS (SELECT product_id, CAST(date_trunc('{unit}', ds) AS DATE) AS p, sum(quantity) AS q, sum(quantity * price_at_sale) AS rev FROM sales GROUP BY 1, 2),
            s AS (SELECT product_id, CAST(unnest(generate_series(min(p), max(p), INTERVAL {step})) AS DATE) AS p FROM r GROUP BY 1)
       SELECT s.product_id, strftime({end}, '%Y-%m-%d') AS date, CAST(trunc(coalesce(q, 0)) AS BIGINT) AS quantity, round(coalesce(rev, 0), 2) AS revenue
       FROM s LEFT JOIN r ON s.product_id = r.product_id AND s.p = r.p"""


@query("product_sales_history_week", _history_sql("week", "7 DAY", "s.p + INTERVAL 6 DAY"), ["sales"])
def product_sales_history_week(spark, sf):
    return S.product_sales_history(V.sales(spark, sf), "week")


@query("product_sales_history_5years", _history_sql("year", "1 YEAR", "s.p + INTERVAL 1 YEAR - INTERVAL 1 DAY"), ["sales"])
def product_sales_history_5years(spark, sf):
    return S.product_sales_history(V.sales(spark, sf), "5years")


@query("scope_series_day", "SELECT product_id, strftime(ds, '%Y-%m-%d') AS bucket, sum(quantity) AS quantity FROM sales GROUP BY 1, 2", ["sales"])
def scope_series_day(spark, sf):
    """An unknown scope means day."""
    return S.scope_series(V.sales(spark, sf), "fortnight")


@query("scope_series_year", "SELECT product_id, strftime(ds, '%Y') AS bucket, sum(quantity) AS quantity FROM sales GROUP BY 1, 2", ["sales"])
def scope_series_year(spark, sf):
    return S.scope_series(V.sales(spark, sf), "year")


def _monthly(spark, sf):
    return S.resample(V.sales(spark, sf), "M", by=["product_id"]).drop("period_start")


LAG_SQL = """SELECT product_id, last_day(mo) AS e, quantity, lag(quantity) OVER w AS prev_period_sales,
    CASE WHEN count(*) OVER r = 3 THEN sum(quantity) OVER r END AS rollback_n FROM monthly_filled
    WINDOW w AS (PARTITION BY product_id ORDER BY mo), r AS (PARTITION BY product_id ORDER BY mo ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"""


@query(
    "lag_features",
    f"SELECT product_id, strftime(e, '%Y-%m-%d') AS period_end, quantity, prev_period_sales, rollback_n FROM ({LAG_SQL})",
    ["monthly_filled"],
)
def lag_features(spark, sf):
    return _text_dates(S.lag_features(_monthly(spark, sf), "month"), "period_end")


@query(
    "ml_lags",
    """SELECT product_id, strftime(last_day(mo), '%Y-%m-%d') AS period_end, quantity, lag(quantity, 1) OVER w AS lag_1, lag(quantity, 7) OVER w AS lag_7,
              month(mo) AS month FROM monthly_filled WINDOW w AS (PARTITION BY product_id ORDER BY mo)""",
    ["monthly_filled"],
)
def ml_lags(spark, sf):
    return _text_dates(S.ml_lags(_monthly(spark, sf)), "period_end")


def _one_decimal(c: str) -> str:
    return f"CAST(printf('%.1f', {c}) AS DOUBLE)"


@query(
    "future_features_month",
    f"""WITH h AS ({LAG_SQL}), l AS (SELECT product_id, max(e) AS e, arg_max(quantity, e) AS q, arg_max(rollback_n, e) AS r FROM h GROUP BY 1),
            f AS (SELECT l.*, p, e + to_months(CAST(p AS INT)) AS d FROM l, (SELECT unnest(generate_series(1, 4)) AS p))
        SELECT product_id, CAST(p AS INT) AS period, strftime(d, '%Y-%m-%d') AS date, month(d) AS month, quarter(d) AS quarter,
               CASE WHEN p = 1 THEN {_one_decimal('q')} END AS prev_period_sales, CASE WHEN p = 1 THEN {_one_decimal('r')} END AS rollback_n FROM f""",
    ["monthly_filled"],
)
def future_features_month(spark, sf):
    return _text_dates(S.future_features(_monthly(spark, sf), 4, "month"), "date")


@query(
    "future_features_week",
    f"""WITH h AS (SELECT product_id, wk + INTERVAL 6 DAY AS e, quantity, CASE WHEN count(*) OVER r = 4 THEN sum(quantity) OVER r END AS rollback_n
                   FROM weekly_filled WINDOW r AS (PARTITION BY product_id ORDER BY wk ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)),
            l AS (SELECT product_id, max(e) AS e, arg_max(quantity, e) AS q, arg_max(rollback_n, e) AS r FROM h GROUP BY 1),
            f AS (SELECT l.*, p, e + to_days(CAST(p * 7 AS INT)) AS d FROM l, (SELECT unnest(generate_series(1, 3)) AS p))
        SELECT product_id, CAST(p AS INT) AS period, strftime(d, '%Y-%m-%d') AS date, month(d) AS month, weekofyear(d) AS week_of_year,
               (day(d) - 1) // 7 + 1 AS week_of_month, CASE WHEN p = 1 THEN {_one_decimal('q')} END AS prev_period_sales,
               CASE WHEN p = 1 THEN {_one_decimal('r')} END AS rollback_n FROM f""",
    ["weekly_filled"],
)
def future_features_week(spark, sf):
    weekly = S.resample(V.sales(spark, sf), "W", by=["product_id"])
    return _text_dates(S.future_features(weekly, 3, "week"), "date")


@query(
    "last_n",
    """SELECT product_id, strftime(last_day(mo), '%Y-%m-%d') AS period_end, quantity, CAST(rn AS INT) AS position FROM (
         SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY mo DESC) AS rn FROM monthly_filled) WHERE rn <= 24""",
    ["monthly_filled"],
)
def last_n(spark, sf):
    out = S.last_n(_monthly(spark, sf), S.max_values("month"), most_recent_first=True)
    return _text_dates(out, "period_end")


@query(
    "series_stats_month",
    """WITH d AS (SELECT product_id, sum(sale_rows) AS sale_rows, avg(quantity) AS daily_avg, stddev_samp(quantity) AS daily_std FROM daily GROUP BY 1),
            w AS (SELECT product_id, avg(quantity) AS weekly_avg FROM complete_weeks GROUP BY 1),
            m AS (SELECT product_id, avg(quantity) AS monthly_avg, count(*) AS n, stddev_samp(quantity) AS s, arg_max(quantity, mo) AS l FROM monthly_filled GROUP BY 1)
       SELECT d.product_id, CAST(sale_rows AS BIGINT) AS sale_rows, round(daily_avg, 6) AS daily_avg, round(daily_std, 6) AS daily_std, round(monthly_avg, 6) AS monthly_avg,
              round(coalesce(weekly_avg, 0), 6) AS weekly_avg, n AS scope_count, round(monthly_avg, 6) AS scope_mean, round(s, 6) AS scope_std, l AS scope_last_value
       FROM d JOIN m ON d.product_id = m.product_id LEFT JOIN w ON d.product_id = w.product_id""",
    ["daily", "complete_weeks", "monthly_filled"],
)
def series_stats_month(spark, sf):
    out = S.series_stats(V.sales(spark, sf), "month")
    six = ("daily_avg", "daily_std", "monthly_avg", "weekly_avg", "scope_mean", "scope_std")
    return out.withColumns({c: F.round(c, 6) for c in six})


@query(
    "dow_averages",
    """SELECT p.product_id, i AS day_of_week, ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][i + 1] AS day_name, round(coalesce(avg(quantity), 0), 6) AS average
       FROM (SELECT DISTINCT product_id FROM daily) p CROSS JOIN (SELECT unnest(generate_series(0, 6)) AS i)
       LEFT JOIN daily d ON d.product_id = p.product_id AND isodow(d.day) - 1 = i GROUP BY 1, 2, 3""",
    ["daily"],
)
def dow_averages(spark, sf):
    return S.dow_averages(S.daily_totals(V.sales(spark, sf))).withColumn("average", F.round("average", 6))


def _trend_query_sql(order: str) -> str:
    return f"""WITH l AS (SELECT product_id, quantity, row_number() OVER (PARTITION BY product_id ORDER BY mo DESC) AS back, count(*) OVER (PARTITION BY product_id) AS n
                   FROM monthly_filled),
        pts AS (SELECT product_id, quantity, {order} AS x FROM l WHERE back <= 12),
        fit AS (SELECT product_id, count(*) AS points, avg(quantity) AS mean, regr_slope(quantity, x) AS slope FROM pts GROUP BY 1),
        f AS (SELECT *, CASE WHEN points >= 3 THEN coalesce(slope * points / nullif(mean, 0) * 100, 0) END AS pct FROM fit)
        SELECT product_id, points, round(slope, 6) AS slope, round(pct, 6) AS pct_change, CASE
            WHEN points < 3 THEN 'Insufficient data to determine trend'
            WHEN pct > 10 THEN concat('Strong upward trend (+', printf('%.0f', pct), '% over recent period)')
            WHEN pct > 3 THEN concat('Moderate upward trend (+', printf('%.0f', pct), '%)')
            WHEN pct < -10 THEN concat('Strong downward trend (', printf('%.0f', pct), '%)')
            WHEN pct < -3 THEN concat('Moderate downward trend (', printf('%.0f', pct), '%)')
            ELSE 'Relatively flat / stable' END AS trend FROM f"""


@query("trend", _trend_query_sql("-back"), ["monthly_filled"])
def trend(spark, sf):
    out = S.trend(_monthly(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("slope", "pct_change")})


@query("trend_newest_first", _trend_query_sql("back"), ["monthly_filled"])
def trend_newest_first(spark, sf):
    out = S.trend(_monthly(spark, sf), direction="reference")
    return out.withColumns({c: F.round(c, 6) for c in ("slope", "pct_change")})
