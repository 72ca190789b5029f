"""Registered queries: cleaning, scaling, feature transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom.operators import cleaning as C
from demandloom.operators import features as X
from demandloom.operators import series as S
from demandloom.plans import views as V
from demandloom.plans.registry import query


def _holed(spark, sf):
    """Numbers with NaN and NULL in different columns."""
    no = F.col("l_linenumber")
    return V.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(no != 2, F.col("l_quantity")).otherwise(F.lit(float("nan"))).alias("quantity"),
        F.when(no != 5, F.col("l_extendedprice")).alias("price"),
    )


HOLED_SQL = """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 2 THEN l_quantity END AS quantity,
    CASE WHEN l_linenumber <> 5 THEN l_extendedprice END AS price FROM lineitem"""


@query("drop_missing", f"SELECT * FROM ({HOLED_SQL}) WHERE quantity IS NOT NULL AND price IS NOT NULL")
def drop_missing(spark, sf):
    return C.drop_missing(_holed(spark, sf))


@query(
    "impute_mean",
    f"""WITH src AS ({HOLED_SQL}), m AS (SELECT avg(quantity) AS q, avg(price) AS p FROM src)
        SELECT l_orderkey, l_linenumber, round(coalesce(quantity, (SELECT q FROM m)), 4) AS quantity,
               round(coalesce(price, (SELECT p FROM m)), 4) AS price FROM src""",
)
def impute_mean(spark, sf):
    out = C.impute_mean(_holed(spark, sf), ["quantity", "price"])
    return out.withColumns({c: F.round(c, 4) for c in ("quantity", "price")})


@query(
    "drop_outliers",
    """WITH b AS (SELECT quantile_cont(l_extendedprice, 0.05) AS p1, quantile_cont(l_extendedprice, 0.95) AS p2,
                         quantile_cont(l_quantity, 0.05) AS q1, quantile_cont(l_quantity, 0.95) AS q2 FROM lineitem)
       SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity FROM lineitem, b
       WHERE l_extendedprice > p1 AND l_extendedprice < p2 AND l_quantity > q1 AND l_quantity < q2""",
)
def drop_outliers(spark, sf):
    rows = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return C.drop_outliers(rows, ["l_extendedprice", "l_quantity"])


@query(
    "clean_impute_then_drop",
    f"""WITH src AS ({HOLED_SQL}), m AS (SELECT avg(quantity) AS q, avg(price) AS p FROM src),
        f AS (SELECT l_orderkey, l_linenumber, coalesce(quantity, (SELECT q FROM m)) AS quantity, coalesce(price, (SELECT p FROM m)) AS price FROM src),
        b AS (SELECT quantile_cont(quantity, 0.05) AS q1, quantile_cont(quantity, 0.95) AS q2,
                     quantile_cont(price, 0.05) AS p1, quantile_cont(price, 0.95) AS p2 FROM f)
        SELECT l_orderkey, l_linenumber, round(quantity, 4) AS quantity, round(price, 4) AS price FROM f, b
        WHERE quantity > q1 AND quantity < q2 AND price > p1 AND price < p2""",
)
def clean_impute_then_drop(spark, sf):
    out = C.clean(_holed(spark, sf), "impute", "drop", ["quantity", "price"])
    return out.withColumns({c: F.round(c, 4) for c in ("quantity", "price")})


def _monthly(spark, sf):
    return S.resample(V.sales(spark, sf), "M", by=["product_id"]).select(
        "product_id", F.date_format("period_start", "yyyy-MM-dd").alias("month"), "quantity"
    )


@query(
    "rolling_outliers",
    """SELECT product_id, strftime(mo, '%Y-%m-%d') AS month, quantity,
              coalesce(abs(quantity - avg(quantity) OVER w) > 2.0 * stddev_samp(quantity) OVER w, FALSE) AS is_outlier
       FROM monthly_filled WINDOW w AS (PARTITION BY product_id ORDER BY mo ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""",
    ["monthly_filled"],
)
def rolling_outliers(spark, sf):
    return C.rolling_outliers(_monthly(spark, sf), ["product_id"], "month", "quantity")


@query(
    "hampel_outliers",
    """SELECT product_id, strftime(mo, '%Y-%m-%d') AS month, quantity,
              coalesce(abs(quantity - median(quantity) OVER w) > 3.0 * 1.4826 * mad(quantity) OVER w, FALSE) AS is_outlier
       FROM monthly_filled WINDOW w AS (PARTITION BY product_id ORDER BY mo ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""",
    ["monthly_filled"],
)
def hampel_outliers(spark, sf):
    return C.hampel_outliers(_monthly(spark, sf), ["product_id"], "month", "quantity")


SCALED = ["quantity", "price", "constant"]


def _numbers(spark, sf):
    return V.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.lit(3.0).alias("constant"),
    )


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in SCALED})


@query(
    "scale_standard",
    """WITH s AS (SELECT avg(l_quantity) AS qm, stddev_pop(l_quantity) AS qs, avg(l_extendedprice) AS pm, stddev_pop(l_extendedprice) AS ps FROM lineitem)
       SELECT l_orderkey, l_linenumber, round((l_quantity - qm) / qs, 6) AS quantity, round((l_extendedprice - pm) / ps, 6) AS price, CAST(0 AS DOUBLE) AS constant
       FROM lineitem, s""",
)
def scale_standard(spark, sf):
    return _rounded(C.normalize(_numbers(spark, sf), "standard", SCALED))


@query(
    "scale_minmax",
    """WITH s AS (SELECT min(l_quantity) AS q1, max(l_quantity) AS q2, min(l_extendedprice) AS p1, max(l_extendedprice) AS p2 FROM lineitem)
       SELECT l_orderkey, l_linenumber, round((l_quantity - q1) / (q2 - q1), 6) AS quantity, round((l_extendedprice - p1) / (p2 - p1), 6) AS price,
              CAST(0 AS DOUBLE) AS constant FROM lineitem, s""",
)
def scale_minmax(spark, sf):
    return _rounded(C.normalize(_numbers(spark, sf), "minmax", SCALED))


@query(
    "scale_robust",
    """WITH s AS (SELECT quantile_cont(l_quantity, [0.25, 0.5, 0.75]) AS q, quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS p FROM lineitem)
       SELECT l_orderkey, l_linenumber, round((l_quantity - q[2]) / (q[3] - q[1]), 6) AS quantity,
              round((l_extendedprice - p[2]) / (p[3] - p[1]), 6) AS price, CAST(0 AS DOUBLE) AS constant FROM lineitem, s""",
)
def scale_robust(spark, sf):
    return _rounded(C.normalize(_numbers(spark, sf), "robust", SCALED))


@query("power_transform_yeo_johnson")
def power_transform_yeo_johnson(spark, sf):
    rows = V.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return C.power_transform(rows, ["c_acctbal"], "yeo-johnson")


@query("power_transform_box_cox")
def power_transform_box_cox(spark, sf):
    rows = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return C.power_transform(rows, ["l_extendedprice", "l_quantity"], "box-cox")


def _exponent_sql(column: str) -> str:
    return f"""SELECT '{column}' AS name, arg_max(lam, score) AS exponent FROM (
        SELECT lam, -count(*) / 2 * ln(var_pop(CASE WHEN lam = 0 THEN ln({column}) ELSE (pow({column}, lam) - 1) / lam END)) + (lam - 1) * sum(ln({column})) AS score
        FROM lineitem, (SELECT round(-2 + 0.1 * unnest(generate_series(0, 40)), 1)::DOUBLE AS lam) GROUP BY lam)"""


@query("power_exponents", _exponent_sql("l_extendedprice") + " UNION ALL " + _exponent_sql("l_quantity"))
def power_exponents(spark, sf):
    """The best exponents of the first grid, which SQL can score as well."""
    best = C.fit_power(V.table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"], "box-cox", passes=1)
    return spark.createDataFrame(list(best.items()), "name string, exponent double")


def _fine_exponent_sql(column: str) -> str:
    """Three grids, each about the best point of the one before."""
    score = f"-count(*) / 2 * ln(var_pop(CASE WHEN lam = 0 THEN ln({column}) ELSE (pow({column}, lam) - 1) / lam END)) + (lam - 1) * sum(ln({column}))"
    grid = lambda around, step, half: f"SELECT arg_max(lam, score) AS lam FROM (SELECT lam, {score} AS score FROM lineitem, (SELECT {around} + {step} * unnest(generate_series(-{half}, {half})) AS lam) GROUP BY lam)"
    first = grid("0.0", 0.1, 20)
    second = grid(f"({first})", 0.005, 20)
    return f"SELECT '{column}' AS name, CAST(round(lam, 3) AS DOUBLE) AS exponent FROM ({grid(f'({second})', 0.0002, 25)})"


@query("power_exponents_fine", _fine_exponent_sql("l_extendedprice") + " UNION ALL " + _fine_exponent_sql("l_quantity"))
def power_exponents_fine(spark, sf):
    """The best exponents to three digits."""
    best = C.fit_power(V.table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"], "box-cox")
    return spark.createDataFrame([(c, round(lam, 3)) for c, lam in best.items()], "name string, exponent double")


@query(
    "power_transform_moments",
    "SELECT count(*) AS n, round(count(*) * 0.0, 6)::DOUBLE AS mean, round(count(*) / count(*), 6)::DOUBLE AS spread FROM customer",
)
def power_transform_moments(spark, sf):
    """Transformed values are standardised."""
    rows = V.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    out = C.power_transform(rows, ["c_acctbal"], "yeo-johnson")
    return out.agg(
        F.count("c_acctbal").alias("n"),
        F.abs(F.round(F.avg("c_acctbal"), 6)).alias("mean"),
        F.round(F.stddev_pop("c_acctbal"), 6).alias("spread"),
    )


@query(
    "log1p_skewed",
    """WITH s AS (SELECT skewness(value) AS sv, skewness(user_id) AS su FROM events)
       SELECT event_id, round(CASE WHEN sv > 0.8 THEN ln(1 + value) ELSE value END, 6) AS value,
              round(CASE WHEN su > 0.8 THEN ln(1 + user_id) ELSE user_id END, 6) AS user_id FROM events, s""",
)
def log1p_skewed(spark, sf):
    out = X.log1p_skewed(V.events(spark, sf).select("event_id", "value", "user_id"), ["value", "user_id"])
    return out.withColumns({c: F.round(c, 6) for c in ("value", "user_id")})


@query(
    "log1p_positive",
    """WITH s AS (SELECT min(l_quantity) AS q, min(l_tax) AS t FROM lineitem)
       SELECT l_orderkey, l_linenumber, round(CASE WHEN q > 0 THEN ln(1 + l_quantity) ELSE l_quantity END, 6) AS l_quantity,
              round(CASE WHEN t > 0 THEN ln(1 + l_tax) ELSE l_tax END, 6) AS l_tax FROM lineitem, s""",
)
def log1p_positive(spark, sf):
    rows = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    out = X.log1p_positive(rows, ["l_quantity", "l_tax"])
    return out.withColumns({c: F.round(c, 6) for c in ("l_quantity", "l_tax")})


@query(
    "calendar_features",
    """SELECT o_orderkey, year(o_orderdate) AS year, month(o_orderdate) AS month, day(o_orderdate) AS day, isodow(o_orderdate) - 1 AS day_of_week,
              weekofyear(o_orderdate) AS week_of_year, quarter(o_orderdate) AS quarter, (day(o_orderdate) - 1) // 7 + 1 AS week_of_month FROM orders""",
)
def calendar_features(spark, sf):
    return X.calendar_features(V.table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")


@query(
    "date_from_parts",
    "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS first_day FROM orders",
)
def date_from_parts(spark, sf):
    parts = V.table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"))
    out = X.date_from_parts(parts, "y", "m", "first_day")
    return out.select("o_orderkey", F.date_format("first_day", "yyyy-MM-dd").alias("first_day"))


@query(
    "one_hot_long",
    "SELECT l_orderkey, l_linenumber, concat('l_partkey_', l_partkey) AS feature, 1 AS hot FROM lineitem",
)
def one_hot_long(spark, sf):
    """A feature with a value per product."""
    return X.one_hot_long(V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey")


@query(
    "one_hot",
    """SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'A' AS INT) AS "l_returnflag_A", CAST(l_returnflag = 'N' AS INT) AS "l_returnflag_N",
              CAST(l_returnflag = 'R' AS INT) AS "l_returnflag_R" FROM lineitem""",
)
def one_hot(spark, sf):
    return X.one_hot(V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag")


@query(
    "row_sum_features",
    "SELECT l_orderkey, l_linenumber, round(l_tax + l_discount, 6) AS rates, round(l_quantity + l_extendedprice, 6) AS amounts FROM lineitem",
)
def row_sum_features(spark, sf):
    out = X.row_sum_features(
        V.table(spark, sf, "lineitem"), {"rates": ["l_tax", "l_discount"], "amounts": ["l_quantity", "l_extendedprice"]}
    )
    return out.select("l_orderkey", "l_linenumber", F.round("rates", 6).alias("rates"), F.round("amounts", 6).alias("amounts"))


@query(
    "map_columns",
    """SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(NULL AS VARCHAR) AS order_date, o_orderstatus AS status, CAST(NULL AS VARCHAR) AS total_amount FROM orders""",
)
def map_columns(spark, sf):
    rows = V.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    mapping = {"order_id": "o_orderkey", "customer_id": "o_custkey", "status": "o_orderstatus"}
    return X.map_columns(rows, mapping)[0]
