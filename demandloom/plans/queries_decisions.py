"""Registered queries: alerts, cover, reorder plan, fact sheet."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom.operators import alerts as A
from demandloom.operators import inventory as N
from demandloom.plans import views as V
from demandloom.plans.registry import query

ALERT_KEYS = ("order_id", "line_no")

HITS_SQL = """hits AS (SELECT * FROM (
    SELECT s.product_id, s.ds, s.quantity * CASE WHEN line_no = 7 THEN 4 ELSE 1 END AS quantity, coalesce(p.safety_stock, 20) AS threshold,
           row_number() OVER (PARTITION BY s.product_id ORDER BY ds, order_id, line_no, s.quantity * CASE WHEN line_no = 7 THEN 4 ELSE 1 END) AS rn
    FROM sales s LEFT JOIN (SELECT * REPLACE (CASE WHEN id % 10 = 4 THEN id + 1000000000 ELSE id END AS id) FROM products) p ON s.product_id = p.id
    WHERE s.quantity * CASE WHEN line_no = 7 THEN 4 ELSE 1 END > coalesce(p.safety_stock, 20) * 3) WHERE rn = 1)"""
MESSAGE = "concat('Anomaly: Product ''', CAST(product_id AS VARCHAR), ''' sales velocity exceeds safety threshold (', CAST(quantity AS VARCHAR), ' units).')"


def _sales(spark, sf):
    """Sales in which some lines are large enough for a critical alert."""
    big = F.when(F.col("line_no") == 7, F.col("quantity") * 4).otherwise(F.col("quantity"))
    return V.sales(spark, sf).withColumn("quantity", big)


def _products(spark, sf):
    return V.with_shifted_key(V.products(spark, sf), "id", 10, 4)


def _hits(spark, sf):
    return A.anomaly_scan(_sales(spark, sf), _products(spark, sf), ALERT_KEYS)


@query(
    "anomaly_scan",
    f"""WITH {HITS_SQL} SELECT product_id, strftime(ds, '%Y-%m-%d') AS ds, quantity, threshold,
        CASE WHEN quantity > 100 THEN 'critical' ELSE 'warning' END AS severity, {MESSAGE} AS message FROM hits""",
    ["products", "sales"],
)
def anomaly_scan(spark, sf):
    return _hits(spark, sf).withColumn("ds", F.date_format("ds", "yyyy-MM-dd"))


@query(
    "emit_alerts",
    f"""WITH {HITS_SQL} SELECT product_id, CASE WHEN quantity > 100 THEN 'critical' ELSE 'warning' END AS severity, 'SALES_VOLUME_SPIKE' AS event_type,
        {MESSAGE} AS message, FALSE AS is_resolved FROM hits""",
    ["products", "sales"],
)
def emit_alerts(spark, sf):
    return A.emit_alerts(_hits(spark, sf)).drop("alert_id", "alert_ts")


def _ledger(spark, sf):
    """The events as an alert table."""
    e = V.events(spark, sf)
    return e.select(
        F.col("event_id").cast("string").alias("alert_id"),
        F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "purchase", "warning").otherwise("info").alias("severity"),
        F.lit("EVENT").alias("event_type"),
        F.col("ts").alias("alert_ts"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("message"),
        (F.col("event_id") % 3 == 0).alias("is_resolved"),
    )


LEDGER_SQL = """ledger AS (SELECT CAST(event_id AS VARCHAR) AS alert_id, CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'warning' ELSE 'info' END AS severity,
    'EVENT' AS event_type, ts AS alert_ts, concat('user ', CAST(user_id AS VARCHAR)) AS message, event_id % 3 = 0 AS is_resolved
    FROM events)"""


@query(
    "active_alerts",
    f"""WITH {LEDGER_SQL} SELECT alert_id AS id, severity, strftime(alert_ts, '%Y-%m-%dT%H:%M:%S') AS ts, event_type AS type, 'active' AS status, message AS title,
        message AS desc, strftime(alert_ts, '%H:%M') AS time, severity AS level,
        CASE severity WHEN 'critical' THEN '🔴' WHEN 'warning' THEN '🟡' ELSE '🔵' END AS icon,
        CASE severity WHEN 'critical' THEN '#ef4444' WHEN 'warning' THEN '#f59e0b' ELSE '#3b82f6' END AS color,
        CASE severity WHEN 'critical' THEN '#ef444412' WHEN 'warning' THEN '#f59e0b12' ELSE '#3b82f612' END AS bg,
        CASE severity WHEN 'critical' THEN '#ef444430' WHEN 'warning' THEN '#f59e0b30' ELSE '#3b82f630' END AS border FROM ledger WHERE NOT is_resolved""",
)
def active_alerts(spark, sf):
    return A.active_alerts(_ledger(spark, sf))


@query(
    "active_alerts_by_severity",
    f"""WITH {LEDGER_SQL} SELECT alert_id AS id, CASE WHEN is_resolved THEN 'resolved' ELSE 'active' END AS status FROM ledger WHERE severity = 'critical'""",
)
def active_alerts_by_severity(spark, sf):
    return A.active_alerts(_ledger(spark, sf), "critical", include_resolved=True).select("id", "status")


@query(
    "resolve_alerts",
    f"""WITH {LEDGER_SQL} SELECT alert_id, is_resolved OR CAST(alert_id AS BIGINT) IN (SELECT event_id FROM events WHERE value > 60) AS is_resolved FROM ledger""",
)
def resolve_alerts(spark, sf):
    ids = V.events(spark, sf).filter("value > 60").select(F.col("event_id").cast("string").alias("alert_id"))
    return A.resolve_alerts(_ledger(spark, sf), ids).select("alert_id", "is_resolved")


@query("resolve_all_alerts", f"WITH {LEDGER_SQL} SELECT alert_id, TRUE AS is_resolved FROM ledger")
def resolve_all_alerts(spark, sf):
    return A.resolve_alerts(_ledger(spark, sf)).select("alert_id", "is_resolved")


COVER_SQL = """avgs AS (SELECT product_id, avg(quantity) AS daily_avg, sum(sale_rows) AS sale_rows FROM (SELECT * REPLACE (CASE WHEN product_id % 7 = 0 THEN product_id + 1000000000 ELSE product_id END AS product_id) FROM daily) GROUP BY 1)"""


def _sold(spark, sf):
    return V.with_shifted_key(V.sales(spark, sf), "product_id", 7)


@query(
    "days_of_cover",
    f"""WITH {COVER_SQL} SELECT p.id, CAST(printf('%.1f', p.current_stock / daily_avg) AS DOUBLE) AS days_of_cover,
        CAST(printf('%.1f', (base_price - unit_cost) / base_price * 100) AS DOUBLE) AS margin_pct FROM products p LEFT JOIN avgs a ON p.id = a.product_id""",
    ["products", "daily"],
)
def days_of_cover(spark, sf):
    return N.days_of_cover(V.products(spark, sf), N.daily_average(_sold(spark, sf))).select("id", "days_of_cover", "margin_pct")


REORDER_SQL = f"""WITH {COVER_SQL},
    f AS (SELECT p.id, p.name, CASE WHEN p.id % 11 = 0 THEN 0 ELSE p.current_stock * (1 + p.id % 5) END AS stock, p.safety_stock * (1 + p.id % 9) AS safety, a.daily_avg,
                 coalesce(a.sale_rows, 0) AS sale_rows FROM products p LEFT JOIN avgs a ON p.id = a.product_id),
    c AS (SELECT *, CASE WHEN daily_avg > 0 THEN CAST(printf('%.1f', stock / daily_avg) AS DOUBLE) END AS cover FROM f),
    r AS (SELECT *, CASE WHEN sale_rows < 14 THEN 'none' WHEN cover IS NULL THEN 'idle' WHEN stock <= 0 THEN 'empty' WHEN cover <= 5 THEN 'short'
                         WHEN stock < safety THEN 'low' ELSE 'fine' END AS rule FROM c)
    SELECT id AS product_id, name AS product_name, CASE WHEN rule = 'none' THEN 'no_data' ELSE 'success' END AS status,
        CASE rule WHEN 'empty' THEN 'URGENT: Stock is depleted. Place an emergency order immediately.'
                  WHEN 'short' THEN concat('Reorder soon — stock will run out within ', CAST(cover AS VARCHAR), ' days (lead time: 5d).')
                  WHEN 'low' THEN concat('Below safety stock (', CAST(stock AS VARCHAR), ' < ', CAST(safety AS VARCHAR), '). Reorder to restore buffer.')
                  WHEN 'fine' THEN concat('Stock level is adequate (', CAST(stock AS VARCHAR), ', ', CAST(cover AS VARCHAR), ' days of cover). No urgent reorder needed.') END AS reorder_recommendation,
        CAST(CASE rule WHEN 'empty' THEN greatest(safety * 2, 50) WHEN 'short' THEN greatest(CAST(trunc(daily_avg * 5 * 1.5) AS BIGINT), safety)
                  WHEN 'low' THEN CAST(trunc(safety * 1.5) AS BIGINT) WHEN 'fine' THEN 0 END AS BIGINT) AS order_quantity,
        CAST(CASE rule WHEN 'empty' THEN 0 WHEN 'short' THEN greatest(0, CAST(trunc(cover - 5 * CAST(0.7 AS DOUBLE)) AS BIGINT)) WHEN 'low' THEN 0
                  WHEN 'fine' THEN greatest(1, CAST(trunc(cover - 5) AS BIGINT)) END AS BIGINT) AS reorder_in_days,
        CASE WHEN rule <> 'none' THEN CAST(trunc(cover) AS BIGINT) END AS stock_out_in_days,
        CASE rule WHEN 'empty' THEN 'medium' WHEN 'short' THEN 'medium' WHEN 'low' THEN 'high' WHEN 'fine' THEN 'high' END AS confidence,
        CASE rule WHEN 'empty' THEN 'Current stock is zero' WHEN 'short' THEN concat('Days of cover (', CAST(cover AS VARCHAR), ') <= lead time (5d)')
                  WHEN 'low' THEN concat('Stock (', CAST(stock AS VARCHAR), ') below safety stock (', CAST(safety AS VARCHAR), ')')
                  WHEN 'fine' THEN concat('Days of cover (', CAST(cover AS VARCHAR), ') exceeds lead time (5d)') END AS key_factors,
        CASE rule WHEN 'empty' THEN 'Stockout likely causing lost sales' WHEN 'short' THEN 'Lead time delays could cause stockout'
                  WHEN 'low' THEN 'Unexpected demand spike could cause stockout' WHEN 'fine' THEN 'Sales velocity increase could reduce days of cover' END AS risk_factors
    FROM r"""


@query("reorder_plan", REORDER_SQL, ["products", "daily"])
def reorder_plan(spark, sf):
    key = F.col("id")
    products = V.products(spark, sf).withColumns(
        {
            "current_stock": F.when(key % 11 == 0, 0).otherwise(F.col("current_stock") * (1 + key % 5)),
            "safety_stock": F.col("safety_stock") * (1 + key % 9),
        }
    )
    out = N.reorder_plan(products, _sold(spark, sf), lead_days=5)
    return out.withColumns({c: F.array_join(c, "; ") for c in ("key_factors", "risk_factors")})


@query(
    "insight_facts",
    """WITH d AS (SELECT product_id, sum(sale_rows) AS sale_rows, avg(quantity) AS daily_avg, stddev_samp(quantity) AS daily_std FROM daily GROUP BY 1),
        w AS (SELECT product_id, avg(quantity) AS weekly_avg FROM complete_weeks GROUP BY 1),
        m AS (SELECT product_id, avg(quantity) AS monthly_avg, count(*) AS n, stddev_samp(quantity) AS s, arg_max(quantity, mo) AS l FROM monthly_filled GROUP BY 1),
        wr AS (SELECT product_id, quantity, -row_number() OVER (PARTITION BY product_id ORDER BY wk DESC) AS x FROM complete_weeks),
        fit AS (SELECT product_id, count(*) AS points, avg(quantity) AS mean, regr_slope(quantity, x) AS slope FROM wr WHERE x >= -12 GROUP BY 1),
        tr AS (SELECT product_id, CASE WHEN points >= 3 THEN coalesce(slope * points / nullif(mean, 0) * 100, 0) END AS pct FROM fit),
        rv AS (SELECT product_id, string_agg(CAST(quantity AS VARCHAR), ',' ORDER BY mo DESC) AS recent_values FROM (
                SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY mo DESC) AS rn FROM monthly_filled) WHERE rn <= 24 GROUP BY 1)
       SELECT p.id AS product_id, p.sku_code, CAST(printf('%.1f', p.current_stock / daily_avg) AS DOUBLE) AS days_of_cover, CAST(sale_rows AS BIGINT) AS sale_rows,
              round(daily_avg, 6) AS daily_avg, round(daily_std, 6) AS daily_std, round(coalesce(weekly_avg, 0), 6) AS weekly_avg, round(monthly_avg, 6) AS monthly_avg,
              n AS scope_count, round(s, 6) AS scope_std, l AS scope_last_value, round(pct, 6) AS trend_pct, recent_values, 14 AS lead_time_days
       FROM products p JOIN d ON p.id = d.product_id JOIN m ON p.id = m.product_id LEFT JOIN w ON p.id = w.product_id LEFT JOIN tr ON p.id = tr.product_id
       LEFT JOIN rv ON p.id = rv.product_id WHERE sale_rows >= 14""",
    ["products", "daily", "complete_weeks", "monthly_filled"],
)
def insight_facts(spark, sf):
    out = N.insight_facts(V.products(spark, sf), V.sales(spark, sf), "month")
    six = ("daily_avg", "daily_std", "weekly_avg", "monthly_avg", "scope_std", "trend_pct")
    return out.select(
        "product_id",
        "sku_code",
        "days_of_cover",
        "sale_rows",
        *[F.round(c, 6).alias(c) for c in six],
        "scope_count",
        "scope_last_value",
        F.array_join(F.transform("recent_values", lambda v: v.cast("string")), ",").alias("recent_values"),
        "lead_time_days",
    )


@query(
    "insight_features_month",
    """WITH h AS (SELECT product_id, last_day(mo) AS e, quantity AS q, lag(quantity) OVER w AS prev, CASE WHEN count(*) OVER r = 3 THEN sum(quantity) OVER r END AS roll,
                         row_number() OVER (PARTITION BY product_id ORDER BY mo DESC) AS rn FROM monthly_filled
                  WINDOW w AS (PARTITION BY product_id ORDER BY mo), r AS (PARTITION BY product_id ORDER BY mo ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
            t AS (SELECT product_id, string_agg(concat_ws('/', strftime(e, '%Y-%m-%d'), printf('%.1f', q), coalesce(printf('%.1f', prev), '-'), coalesce(printf('%.1f', roll), '-'),
                         month(e), quarter(e)), ',' ORDER BY rn) AS history FROM h WHERE rn <= 24 GROUP BY 1),
            f AS (SELECT product_id, p, e + to_months(CAST(p AS INT)) AS d, q, roll FROM h, (SELECT unnest(generate_series(1, 3)) AS p) WHERE rn = 1),
            a AS (SELECT product_id, string_agg(concat_ws('/', p, strftime(d, '%Y-%m-%d'), month(d), quarter(d), CASE WHEN p = 1 THEN printf('%.1f', q) ELSE '-' END,
                         CASE WHEN p = 1 THEN coalesce(printf('%.1f', roll), '-') ELSE '-' END), ',' ORDER BY p) AS future FROM f GROUP BY 1)
       SELECT t.product_id, history, future FROM t JOIN a ON t.product_id = a.product_id""",
    ["monthly_filled"],
)
def insight_features_month(spark, sf):
    out = N.insight_features(V.sales(spark, sf), "month", 3)

    def shown(c):
        return F.when(c.isNull(), "-").otherwise(F.format_string("%.1f", c))

    past = F.transform(
        "historical_features",
        lambda h: F.concat_ws("/", h["date"], shown(h["quantity"]), shown(h["prev_period_sales"]), shown(h["rollback_n"]), h["month"].cast("string"), h["quarter"].cast("string")),
    )
    ahead = F.transform(
        "future_features",
        lambda h: F.concat_ws("/", h["period"].cast("string"), h["date"], h["month"].cast("string"), h["quarter"].cast("string"), shown(h["prev_period_sales"]), shown(h["rollback_n"])),
    )
    return out.select("product_id", F.array_join(past, ",").alias("history"), F.array_join(ahead, ",").alias("future"))
