"""Registered queries: forecasts, boosted trees, prediction logs, backtest."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from demandloom.operators import features as X
from demandloom.operators import forecast as M
from demandloom.operators import learn as L
from demandloom.operators import series as S
from demandloom.plans import views as V
from demandloom.plans.registry import query
from demandloom.session import checkpoint, scratch_path


def _monthly(spark, sf):
    return S.resample(V.sales(spark, sf), "M", by=["product_id"]).drop("period_start")


@query(
    "forecast_naive",
    """SELECT product_id, CAST(step AS INT) AS step, arg_max(quantity, mo) AS forecast
       FROM monthly_filled, (SELECT unnest(generate_series(1, 6)) AS step) GROUP BY 1, 2""",
    ["monthly_filled"],
)
def forecast_naive(spark, sf):
    return M.forecast_naive(_monthly(spark, sf), 6)


@query("forecast_arima")
def forecast_arima(spark, sf):
    return M.forecast_arima(S.scope_series(V.sales(spark, sf), "month"), 3)


@query(
    "forecast_arima_steps",
    """SELECT product_id, CASE WHEN count(*) < 3 THEN 'no_data' ELSE 'success' END AS status, count(*) AS data_points,
              CASE WHEN count(*) < 3 THEN 1 ELSE 2 END AS steps FROM (SELECT DISTINCT CASE WHEN product_id % 4 = 0 OR year(ds) < 1997 THEN product_id ELSE product_id + 1000000000 END AS product_id, year(ds) AS y FROM sales)
       GROUP BY 1""",
    ["sales"],
)
def forecast_arima_steps(spark, sf):
    """Which products get a forecast, from how many points: most have two years only."""
    early = (F.col("product_id") % 4 == 0) | (F.year("ds") < 1997)
    moved = F.when(early, F.col("product_id")).otherwise(F.col("product_id") + V.SHIFT).cast("int")  # three of four products end early, and as others begin late
    sales = V.sales(spark, sf).withColumn("product_id", moved)
    out = M.forecast_arima(S.scope_series(sales, "year"), 2)
    return out.groupBy("product_id", "status").agg(
        F.max("data_points").alias("data_points"), F.count(F.lit(1)).alias("steps")
    )


@query("forecast_arimax")
def forecast_arimax(spark, sf):
    monthly = _monthly(spark, sf)
    past = monthly.withColumns({"month": F.month("period_end"), "quarter": F.quarter("period_end")})
    future = S.future_features(monthly, 3, "month")
    return M.forecast_arimax(past, future, ["month", "quarter"])


@query(
    "clean_forecast",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice, CASE WHEN l_linenumber = 1 THEN 'missing' WHEN l_linenumber = 2 THEN 'invalid' ELSE 'ok' END AS st,
                      greatest(l_quantity - 20, 0) AS a, l_quantity AS b FROM lineitem)
       SELECT l_orderkey, l_linenumber, st AS forecast_status, CASE WHEN st = 'ok' THEN
              CASE WHEN l_linenumber >= 5 THEN concat_ws(',', CAST(a AS VARCHAR), CAST(b AS VARCHAR), CAST(a AS VARCHAR))
                   ELSE concat_ws(',', CAST(a AS VARCHAR), CAST(a AS VARCHAR), CAST(a AS VARCHAR)) END END AS forecast FROM s""",
)
def clean_forecast(spark, sf):
    no, q = F.col("l_linenumber"), F.col("l_quantity")
    a, b = (q - 20).cast("string"), q.cast("string")
    values = (
        F.when(no == 1, F.array().cast("array<string>"))
        .when(no == 2, F.array(a, F.lit("many")))
        .when(no >= 5, F.array(a, b, a, b))
        .otherwise(F.array(a))
    )
    rows = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", values.alias("forecast"))
    return M.clean_forecast(rows, 3).withColumn("forecast", F.array_join("forecast", ","))


def _features(spark, sf):
    lagged = S.ml_lags(S.lag_features(_monthly(spark, sf), "month"), (1, 7))
    return X.calendar_features(lagged, "period_end").withColumn("product_number", F.col("product_id").cast("double"))


FEATURES = ("lag_1", "lag_7", "rollback_n", "month", "quarter", "product_number")


@query(
    "split_time",
    """SELECT product_id, strftime(last_day(mo), '%Y-%m-%d') AS period_end, CASE WHEN r > 1 - CAST(0.1 AS DOUBLE) THEN 'test'
              WHEN r > 1 - CAST(0.1 AS DOUBLE) - CAST(0.2 AS DOUBLE) THEN 'eval' ELSE 'train' END AS split
       FROM (SELECT *, percent_rank() OVER (PARTITION BY product_id ORDER BY mo) AS r FROM monthly_filled)""",
    ["monthly_filled"],
)
def split_time(spark, sf):
    out = L.split_time(_monthly(spark, sf))
    return out.select("product_id", F.date_format("period_end", "yyyy-MM-dd").alias("period_end"), "split")


def _trained(spark, sf):
    return L.train_gbt(L.split_time(_features(spark, sf)), FEATURES)


@query("train_gbt")
def train_gbt(spark, sf):
    return _trained(spark, sf).metrics


@query("predict_demand")
def predict_demand(spark, sf):
    """The newest month of each product as features; every product asked for."""
    features = _features(spark, sf)
    newest = S.last_n(features, 1)
    path = scratch_path(spark, "model")
    L.save_model(_trained(spark, sf), path)
    trained = L.load_model(spark, path)
    requested = V.products(spark, sf).select(F.col("id").alias("product_id"))
    return L.predict_demand(trained, newest, requested)


def _naive_log(spark, sf):
    """Naive one-step predictions of every product, with the month they are for."""
    monthly = checkpoint(_monthly(spark, sf))
    train, test = M.hold_out(monthly, 1, ["product_id"], "period_end")
    naive = M.forecast_naive(train, 1).select("product_id", F.col("forecast").alias("prediction"))
    target = test.select("product_id", F.col("period_end").alias("target_date"), F.col("quantity").alias("actual_value"))
    return naive, target


@query(
    "log_predictions",
    """SELECT product_id, 'naive' AS model_name, 'v1' AS model_version, quantity AS predicted_value, '{}' AS features_json FROM (
         SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY mo DESC) AS rn FROM monthly_filled) WHERE rn = 2""",
    ["monthly_filled"],
)
def log_predictions(spark, sf):
    naive, _ = _naive_log(spark, sf)
    return L.log_predictions(naive, "naive", "v1").drop("prediction_ts")


SCORE_SQL = """WITH l AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY mo DESC) AS rn, lag(quantity) OVER (PARTITION BY product_id ORDER BY mo) AS predicted FROM monthly_filled),
    s AS (SELECT product_id, mo, predicted AS predicted_value, CASE WHEN product_id % 6 <> 0 THEN quantity END AS actual_value FROM l WHERE rn = 1 AND predicted IS NOT NULL),
    d AS (SELECT *, CASE WHEN actual_value IS NULL THEN 'pending' ELSE 'completed' END AS status,
                 coalesce(abs(predicted_value - actual_value) > CAST(0.2 AS DOUBLE) * abs(actual_value), FALSE) AS drift_detected FROM s) """


def _scored(spark, sf):
    naive, target = _naive_log(spark, sf)
    log = L.log_predictions(naive, "naive", "v1").join(target.select("product_id", "target_date"), on="product_id")
    return L.score_predictions(log, V.with_shifted_key(target, "product_id", 6))


@query(
    "score_predictions",
    SCORE_SQL + "SELECT product_id, strftime(last_day(mo), '%Y-%m-%d') AS target_date, predicted_value, actual_value, status, drift_detected FROM d",
    ["monthly_filled"],
)
def score_predictions(spark, sf):
    out = _scored(spark, sf)
    return out.select(
        "product_id",
        F.date_format("target_date", "yyyy-MM-dd").alias("target_date"),
        "predicted_value",
        "actual_value",
        "status",
        "drift_detected",
    )


@query(
    "accuracy_by_version",
    SCORE_SQL
    + """SELECT 'naive' AS model_name, 'v1' AS model_version, round(avg(abs(actual_value - predicted_value)), 6) AS mae,
                round(avg(abs((actual_value - predicted_value) / actual_value)) FILTER (actual_value <> 0), 6) AS mape, count(*) AS n,
                round(avg(drift_detected::INT), 6) AS drift_share FROM d WHERE status = 'completed'""",
    ["monthly_filled"],
)
def accuracy_by_version(spark, sf):
    out = L.accuracy_by_version(_scored(spark, sf)).drop("mse")
    return out.withColumns({c: F.round(c, 6) for c in ("mae", "mape", "drift_share")})


@query("backtest")
def backtest(spark, sf):
    return M.backtest(S.scope_series(V.sales(spark, sf), "month"), 3)


@query(
    "backtest_naive",
    """WITH b AS (SELECT product_id, strftime(ds, '%Y-%m') AS bucket, sum(quantity) AS q FROM sales GROUP BY 1, 2),
            r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY bucket DESC) AS rn FROM b),
            l AS (SELECT product_id, q AS p FROM r WHERE rn = 4)
       SELECT r.product_id, round(avg(abs(q - p)), 6) AS mae, round(avg(abs((q - p) / q)) FILTER (q <> 0), 6) AS mape, count(*) AS n
       FROM r JOIN l ON r.product_id = l.product_id WHERE rn <= 3 GROUP BY 1""",
    ["sales"],
)
def backtest_naive(spark, sf):
    """The naive rows of the backtest, which SQL can check."""
    series = S.scope_series(V.sales(spark, sf), "month")
    out = M.backtest(series, 3).filter("model = 'naive'")
    return out.select("product_id", F.round("mae", 6).alias("mae"), F.round("mape", 6).alias("mape"), "n")


@query(
    "backtest_trees",
    """WITH b AS (SELECT product_id, strftime(ds, '%Y-%m') AS bucket, sum(quantity) AS q FROM sales GROUP BY 1, 2),
            c AS (SELECT product_id, count(*) AS n FROM b GROUP BY 1)
       SELECT product_id, model, 3 AS n, TRUE AS has_errors FROM c, (SELECT unnest(['naive', 'boosted_trees']) AS model)
       WHERE n > 3 AND (model = 'naive' OR n >= 6)""",
    ["sales"],
)
def backtest_trees(spark, sf):
    """Boosted trees beside the other models: which products they forecast, and for how many steps."""
    series = S.scope_series(V.sales(spark, sf), "month")
    trees = partial(L.forecast_trees, rounds=3, depth=3)
    out = M.backtest(series, 3, more={"boosted_trees": trees}).filter("model <> 'arima'")
    return out.select("product_id", "model", "n", (F.col("mae") >= 0).alias("has_errors"))


@query(
    "lag_rows",
    """WITH b AS (SELECT product_id, strftime(ds, '%Y-%m') AS bucket, sum(quantity) AS quantity FROM sales GROUP BY 1, 2)
       SELECT *, lag(quantity, 1) OVER w AS lag_1, lag(quantity, 2) OVER w AS lag_2, lag(quantity, 3) OVER w AS lag_3,
              CAST(row_number() OVER w - 1 AS INT) AS place FROM b WINDOW w AS (PARTITION BY product_id ORDER BY bucket)""",
    ["sales"],
)
def lag_rows(spark, sf):
    """What the recursive forecast learns from."""
    return L.lag_rows(S.scope_series(V.sales(spark, sf), "month"), ["product_id"], "bucket", "quantity")
