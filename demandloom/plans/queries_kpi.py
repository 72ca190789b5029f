"""Registered queries: KPIs, rankings, statistics, accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom.operators import accuracy as A
from demandloom.operators import kpi as K
from demandloom.operators import stats as T
from demandloom.plans import views as V
from demandloom.plans.registry import query

KPI_KEYS = ("order_id", "line_no", "quantity", "rev")


@query(
    "business_kpis",
    """WITH r AS (SELECT s.*, s.quantity * s.price_at_sale AS rev, coalesce(p.unit_cost, 0) * s.quantity AS cost,
                     row_number() OVER (ORDER BY ds, product_id, order_id, line_no, s.quantity, s.quantity * s.price_at_sale) AS rn, count(*) OVER () AS n
              FROM sales s LEFT JOIN products p ON s.product_id = p.id),
       t AS (SELECT sum(quantity) AS qty, sum(rev) AS rev, sum(cost) AS cost, sum(rev) FILTER (rn <= n // 2) AS prev, sum(rev) FILTER (rn > n // 2) AS recent FROM r),
       k AS (SELECT *, (rev - cost) / rev * 100 AS margin_pct, CASE WHEN prev > 0 THEN (recent - prev) / prev * 100 ELSE 0 END AS g FROM t)
       SELECT CAST(trunc(qty) AS BIGINT) AS total_volume, round(rev, 2) AS total_revenue, round(cost, 2) AS total_cost, round(margin_pct, 6) AS margin_pct,
              round(g, 6) AS growth_pct, concat('$', format('{:,}', CAST(round_even(rev, 0) AS BIGINT))) AS revenue, concat(printf('%.1f', g), '%') AS growth,
              'Pending' AS conversion, concat(printf('%.1f', margin_pct), '%') AS margin,
              concat(CASE WHEN g >= 0 THEN '+' ELSE '' END, printf('%.2f', g), '%') AS revenue_change,
              CASE WHEN abs(g) < 10 THEN 'Steady' ELSE 'High Velocity' END AS growth_change FROM k""",
    ["products", "sales"],
)
def business_kpis(spark, sf):
    out = K.business_kpis(V.sales(spark, sf), V.products(spark, sf), KPI_KEYS)
    return out.withColumns(
        {
            "total_revenue": F.round("total_revenue", 2),
            "total_cost": F.round("total_cost", 2),
            "margin_pct": F.round("margin_pct", 6),
            "growth_pct": F.round("growth_pct", 6),
        }
    )


@query(
    "revenue_breakdown",
    """WITH r AS (SELECT product_id, CAST(trunc(sum(quantity * price_at_sale)) AS BIGINT) AS value FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)
       SELECT r.product_id, coalesce(p.name, concat('SKU #', CAST(r.product_id AS VARCHAR))) AS name, value FROM r LEFT JOIN products p ON r.product_id = p.id""",
    ["products", "sales"],
)
def revenue_breakdown(spark, sf):
    return K.revenue_breakdown(V.sales(spark, sf), V.products(spark, sf))


def _some_products(spark, sf):
    return V.with_shifted_key(V.products(spark, sf), "id", 10, 4)


INVENTORY_SQL = """SELECT b.id, b.name, coalesce(c.name, 'Uncategorized') AS category, stock, CAST(printf('%.2f', velocity) AS DOUBLE) AS velocity,
           CASE WHEN stock <= safety THEN 'High' WHEN velocity > 15 THEN 'Monitor' ELSE 'Low' END AS risk
    FROM (SELECT coalesce(p.id, v.product_id) AS id, coalesce(p.name, concat('Unknown SKU #', CAST(v.product_id AS VARCHAR))) AS name, p.category_id,
                 coalesce(p.current_stock, 0) AS stock, coalesce(p.safety_stock, 0) AS safety, coalesce(v.velocity, 0) AS velocity
          FROM (SELECT * REPLACE (CASE WHEN id % 10 = 4 THEN id + 1000000000 ELSE id END AS id) FROM products) p
          FULL OUTER JOIN (SELECT product_id, avg(quantity) AS velocity FROM (SELECT * REPLACE (CASE WHEN product_id % 7 = 0 THEN product_id + 1000000000 ELSE product_id END AS product_id) FROM sales) GROUP BY 1) v ON p.id = v.product_id) b
    LEFT JOIN categories c ON b.category_id = c.id"""


@query("inventory_status", INVENTORY_SQL, ["products", "categories", "sales"])
def inventory_status(spark, sf):
    sold = V.with_shifted_key(V.sales(spark, sf), "product_id", 7)
    return K.inventory_status(_some_products(spark, sf), V.categories(spark, sf), sold)


@query(
    "active_products",
    "SELECT id, sku_code, name FROM products WHERE status = 'active' AND category_id = 12",
    ["products"],
)
def active_products(spark, sf):
    return K.active_products(V.products(spark, sf), 12).select("id", "sku_code", "name")


@query("by_category", "SELECT p_partkey, p_name FROM part WHERE p_type = 'SMALL'")
def by_category(spark, sf):
    return K.by_category(V.table(spark, sf, "part").withColumnRenamed("p_type", "category"), "SMALL").select("p_partkey", "p_name")


@query(
    "group_mean",
    """SELECT key, key_value, round(avg(q), 6) AS mean FROM (
         SELECT 'l_linenumber' AS key, CAST(l_linenumber AS VARCHAR) AS key_value, l_quantity AS q FROM lineitem
         UNION ALL SELECT 'month', CAST(month(l_shipdate) AS VARCHAR), l_quantity FROM lineitem
         UNION ALL SELECT 'weekday', CAST(isodow(l_shipdate) - 1 AS VARCHAR), l_quantity FROM lineitem
         UNION ALL SELECT 'l_suppkey', CAST(l_suppkey AS VARCHAR), l_quantity FROM lineitem) GROUP BY 1, 2""",
)
def group_mean(spark, sf):
    df = V.table(spark, sf, "lineitem").withColumns({"month": F.month("l_shipdate"), "weekday": F.weekday("l_shipdate")})
    out = T.group_mean(df, ["l_linenumber", "month", "weekday", "l_suppkey"], "l_quantity")
    return out.withColumn("mean", F.round("mean", 6))


@query(
    "yearly_totals",
    "SELECT year(o_orderdate) AS year, round(sum(o_totalprice), 2) AS total FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1999 GROUP BY 1",
)
def yearly_totals(spark, sf):
    return T.yearly_totals(V.table(spark, sf, "orders"), "o_orderdate", "o_totalprice", 1996, 1999).withColumn("total", F.round("total", 2))


@query("rows_per_date", "SELECT strftime(l_shipdate, '%Y-%m-%d') AS date, count(*) AS count FROM lineitem GROUP BY 1")
def rows_per_date(spark, sf):
    out = T.rows_per_date(V.table(spark, sf, "lineitem"), "l_shipdate")
    return out.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("value_counts", "SELECT o_orderpriority AS value, count(*) AS count FROM orders GROUP BY 1")
def value_counts(spark, sf):
    return T.value_counts(V.table(spark, sf, "orders"), "o_orderpriority")


@query(
    "date_range",
    """SELECT strftime(min(l_shipdate), '%Y-%m-%d') AS first, strftime(max(l_shipdate), '%Y-%m-%d') AS last,
              count(DISTINCT CAST(l_shipdate AS DATE)) AS distinct_dates FROM lineitem""",
)
def date_range(spark, sf):
    out = T.date_range(V.table(spark, sf, "lineitem"), "l_shipdate")
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first", "last")})


def _describe_part(c: str) -> str:
    return f"""SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS null_count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
        min({c}) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75, max({c}) AS max FROM src"""


@query(
    "describe",
    "WITH src AS (SELECT l_quantity, l_extendedprice, CASE WHEN l_linenumber <> 3 THEN l_discount END AS l_discount FROM lineitem) "
    + " UNION ALL ".join(_describe_part(c) for c in ("l_quantity", "l_extendedprice", "l_discount")),
)
def describe(spark, sf):
    df = V.table(spark, sf, "lineitem").withColumn("l_discount", F.when(F.col("l_linenumber") != 3, F.col("l_discount")))
    out = T.describe(df, ["l_quantity", "l_extendedprice", "l_discount"])
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "p25", "p50", "p75")})


NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "correlation_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, " + ("1.0" if a == b else f"round(corr({a}, {b}), 6)") + " AS r FROM lineitem"
        + (" HAVING count(*) > 0" if a == b else "")
        for a in NUMBERS
        for b in NUMBERS
    ),
)
def correlation_matrix(spark, sf):
    return T.correlation_matrix(V.table(spark, sf, "lineitem"), list(NUMBERS)).withColumn("r", F.round("r", 6))


@query(
    "correlation_with",
    " UNION ALL ".join(f"SELECT '{a}' AS \"column\", round(corr({a}, l_extendedprice), 6) AS r FROM lineitem" for a in NUMBERS if a != "l_extendedprice"),
)
def correlation_with(spark, sf):
    return T.correlation_with(V.table(spark, sf, "lineitem"), "l_extendedprice", list(NUMBERS)).withColumn("r", F.round("r", 6))


@query(
    "skewness",
    " UNION ALL ".join(f"SELECT '{a}' AS \"column\", round(skewness({a}), 5) AS skewness FROM lineitem" for a in NUMBERS),
)
def skewness(spark, sf):
    return T.skewness(V.table(spark, sf, "lineitem"), list(NUMBERS)).withColumn("skewness", F.round("skewness", 5))


@query("vif")
def vif(spark, sf):
    return T.vif(V.table(spark, sf, "lineitem"), list(NUMBERS))


@query(
    "vif_three_columns",
    """WITH g AS (SELECT sum(l_quantity * l_quantity) AS aa, sum(l_discount * l_discount) AS bb, sum(l_tax * l_tax) AS cc,
                     sum(l_quantity * l_discount) AS ab, sum(l_quantity * l_tax) AS ac, sum(l_discount * l_tax) AS bc FROM lineitem),
            d AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM g)
       SELECT 'l_quantity' AS feature, round(aa * (bb * cc - bc * bc) / det, 6) AS vif FROM d
       UNION ALL SELECT 'l_discount', round(bb * (aa * cc - ac * ac) / det, 6) FROM d
       UNION ALL SELECT 'l_tax', round(cc * (aa * bb - ab * ab) / det, 6) FROM d""",
)
def vif_three_columns(spark, sf):
    return T.vif(V.table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"]).withColumn("vif", F.round("vif", 6))


@query(
    "histogram",
    """WITH e AS (SELECT min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 20 AS w FROM events),
       c AS (SELECT CAST(least(floor((value - lo) / w), 19) AS INT) AS bin, count(*) AS n FROM events, e GROUP BY 1)
       SELECT CAST(b.bin AS INT) AS bin, round(lo + b.bin * w, 6) AS low, round(lo + (b.bin + 1) * w, 6) AS high, coalesce(n, 0) AS count
       FROM (SELECT unnest(generate_series(0, 19)) AS bin) b CROSS JOIN e LEFT JOIN c ON b.bin = c.bin""",
)
def histogram(spark, sf):
    out = T.histogram(V.events(spark, sf), "value", 20)
    return out.withColumns({c: F.round(c, 6) for c in ("low", "high")})


def _pairs(spark, sf):
    """Last line quantity as the actual, a shifted one as the prediction; some actuals are zero."""
    no = F.col("l_linenumber")
    return V.table(spark, sf, "lineitem").select(
        "l_returnflag",
        F.when(no == 1, 0.0).otherwise(F.col("l_quantity")).alias("actual"),
        (F.col("l_quantity") * (0.8 + no * 0.07)).alias("predicted"),
    )


PAIRS_SQL = """WITH p AS (SELECT l_returnflag, CASE WHEN l_linenumber = 1 THEN 0.0 ELSE l_quantity END AS y,
    l_quantity * (CAST(0.8 AS DOUBLE) + l_linenumber * CAST(0.07 AS DOUBLE)) AS p FROM lineitem) """


@query(
    "error_metrics",
    PAIRS_SQL
    + """SELECT l_returnflag, round(avg(abs(y - p)), 6) AS mae, round(avg((y - p) * (y - p)), 6) AS mse,
                round(avg(abs((y - p) / y)) FILTER (y <> 0), 6) AS mape, count(*) AS n FROM p GROUP BY 1""",
)
def error_metrics(spark, sf):
    out = A.error_metrics(_pairs(spark, sf), by=["l_returnflag"])
    return out.withColumns({c: F.round(c, 6) for c in ("mae", "mse", "mape")})


@query(
    "market_fit",
    PAIRS_SQL
    + """SELECT l_returnflag, round(sum(p) / sum(y), 6) AS forecast_bias, round(avg((p < y)::INT), 6) AS under_prediction_rate,
                round(avg((p > y)::INT), 6) AS over_prediction_rate, round(avg((p >= y AND p <= y * CAST(1.2 AS DOUBLE))::INT), 6) AS inventory_efficiency_score,
                round(sum(y), 4) AS total_actual_demand, round(sum(p), 4) AS total_predicted_demand FROM p GROUP BY 1""",
)
def market_fit(spark, sf):
    out = A.market_fit(_pairs(spark, sf), by=["l_returnflag"])
    six = ("forecast_bias", "under_prediction_rate", "over_prediction_rate", "inventory_efficiency_score")
    return out.withColumns(
        {**{c: F.round(c, 6) for c in six}, **{c: F.round(c, 4) for c in ("total_actual_demand", "total_predicted_demand")}}
    )
