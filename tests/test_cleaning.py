import math

import numpy as np
import pytest
from tests.conftest import rows
from pyspark.sql import functions as F

from demandloom.functions import exact_quantiles
from demandloom.operators import accuracy as A
from demandloom.operators import cleaning as C
from demandloom.operators import features as X
from demandloom.operators import stats as T


def test_missing(spark):
    df = spark.createDataFrame([(1.0, 4.0), (2.0, 5.0), (float("nan"), 6.0)], "a double, b double")
    assert C.drop_missing(df).count() == 2
    assert rows(C.impute_mean(df))[1] == (1.5, 6.0)


def test_outlier_bounds_are_strict(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("a"))
    kept = sorted(r["a"] for r in C.drop_outliers(df).collect())
    assert kept[0] == 5.0 and kept[-1] == 94.0 and len(kept) == 90
    assert C.drop_outliers(df.withColumn("a", F.lit(1.0))).count() == 0


def test_exact_quantiles_beyond_the_buffer(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.lognormal(3, 2, 4000), np.repeat(7.0, 3000), rng.normal(0, 1, 500)])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    expected = np.quantile(values, probs)
    for limit in (50, 1000, 10**6):
        assert np.allclose(exact_quantiles(df, ["x"], probs, buffer_rows=limit)["x"], expected)
    few = spark.createDataFrame([(float(v % 2), float(v)) for v in range(400)], "a double, b double")
    got = exact_quantiles(few, ["a", "b"], [0.25, 0.5], buffer_rows=20)
    assert got == {"a": [0.0, 0.5], "b": [99.75, 199.5]}
    assert exact_quantiles(few.filter("a > 5"), ["a"], [0.5]) == {"a": [None]}
    ends = np.concatenate([np.repeat(1.0, 10_000), [2.0, 3.0, 4.0, 5.0, 6.0], np.repeat(9.0, 10_000)])  # a few values between two frequent ones
    df = spark.range(len(ends)).select(F.expr("CASE WHEN id < 10000 THEN 1D WHEN id < 10005 THEN id - 9998 ELSE 9D END").cast("double").alias("x"))
    probs = [0.4, 0.4999, 0.49992, 0.5, 0.50007, 0.6]
    assert np.allclose(exact_quantiles(df, ["x"], probs, buffer_rows=2)["x"], np.quantile(ends, probs))


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 4.0, 2.0), (2.0, 5.0, 2.0), (3.0, 6.0, 2.0)], "a double, b double, k double")
    z = rows(C.normalize(df, "standard"))
    assert math.isclose(z[0][0], -math.sqrt(1.5)) and z[0][2] == 0.0
    assert rows(C.normalize(df, "minmax"), "a", "k") == [(0.0, 0.0), (0.5, 0.0), (1.0, 0.0)]
    assert rows(C.normalize(df, "robust"), "a", "k") == [(-1.0, 0.0), (0.0, 0.0), (1.0, 0.0)]
    assert C.normalize(df) is df
    with pytest.raises(ValueError):
        C.normalize(df, "other")
    with pytest.raises(ValueError):
        C.clean(df, "other")


def test_power_transform(spark):
    rng = np.random.default_rng(1)
    data = np.exp(rng.normal(1, 0.5, 3000))
    df = spark.createDataFrame([(float(v),) for v in data], "x double")
    assert abs(C.fit_power(df, ["x"], "box-cox")["x"]) < 0.1
    out = np.array([r["x"] for r in C.power_transform(df, ["x"]).collect()])
    assert abs(out.mean()) < 1e-9 and abs(out.std() - 1) < 1e-9
    lam = C.fit_power(df.withColumn("x", F.col("x") - 3), ["x"], "yeo-johnson")["x"]
    assert -2 < lam < 2
    for method, values, found in (("box-cox", data, C.fit_power(df, ["x"])["x"]), ("yeo-johnson", data - 3, lam)):
        log_of = np.log(values).sum() if method == "box-cox" else (np.sign(values) * np.log1p(np.abs(values))).sum()
        score = lambda t: -len(values) / 2 * np.log(C._powers(method, values, t).var()) + (t - 1) * log_of  # noqa: B023, E731
        fine = found + np.arange(-200, 201) * 1e-6
        assert abs(fine[np.argmax([score(t) for t in fine])] - found) < 3e-6
    with pytest.raises(ValueError, match="positive"):
        C.power_transform(df.withColumn("x", -F.col("x")))
    with pytest.raises(ValueError, match="numeric"):
        C.power_transform(spark.createDataFrame([("a",)], "s string"))


def test_series_outliers(spark):
    values = [10.0, 11.0, 9.0, 10.0, 100.0, 10.0, 9.0, 11.0, 10.0]
    df = spark.createDataFrame([("p", i, v) for i, v in enumerate(values)], "k string, t int, v double")
    assert rows(C.hampel_outliers(df, ["k"], "t", "v").filter("is_outlier"), "t") == [(4,)]
    assert rows(C.rolling_outliers(df, ["k"], "t", "v").filter("is_outlier"), "t") == [(4,)]


def test_features(spark):
    df = spark.createDataFrame([("2024-12-30", "b"), ("2024-02-29", "a"), ("2023-01-01", None)], "d string, c string")
    got = {r["d"]: r for r in X.calendar_features(df, "d").collect()}
    monday = got["2024-12-30"]
    assert (monday["day_of_week"], monday["week_of_year"], monday["quarter"], monday["week_of_month"]) == (0, 1, 4, 5)
    assert got["2023-01-01"]["day_of_week"] == 6 and got["2024-02-29"]["day"] == 29
    hot = X.one_hot(df, "c")
    assert hot.columns == ["d", "c_a", "c_b"] and rows(hot, "c_a", "c_b") == [(0, 0), (0, 1), (1, 0)]
    mapped, warnings = X.map_columns(df, {"order_id": "c"})
    assert warnings == ["order_date"] and "customer_id" in mapped.columns
    assert str(X.date_from_parts(spark.createDataFrame([(2024, 2)], "year int, month int")).first()["date"]) == "2024-02-01"


def test_log_features(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 1.0), (1.0, 2.0), (50.0, 3.0)], "skewed double, flat double")
    out = X.log1p_skewed(df)
    assert math.isclose(max(r["skewed"] for r in out.collect()), math.log1p(50)) and max(r["flat"] for r in out.collect()) == 3.0
    out = X.log1p_positive(df)
    assert max(r["flat"] for r in out.collect()) == 3.0 and math.isclose(min(r["skewed"] for r in out.collect()), math.log(2))


def test_statistics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (-1.0, 1.0), (1.0, -1.0), (-1.0, -1.0)], "x double, y double")
    assert [round(r["vif"], 9) for r in T.vif(df, ["x", "y"]).collect()] == [1.0, 1.0]
    values = [1.0, 2.0, 2.0, 9.0]
    skew = T.skewness(spark.createDataFrame([(v,) for v in values], "v double")).first()["skewness"]
    n, m = 4, np.mean(values)
    g1 = np.mean((np.array(values) - m) ** 3) / np.mean((np.array(values) - m) ** 2) ** 1.5
    assert math.isclose(skew, g1 * math.sqrt(n * (n - 1)) / (n - 2))
    bins = [r["count"] for r in T.histogram(spark.createDataFrame([(v,) for v in values], "v double"), "v", 4).orderBy("bin").collect()]
    assert bins == [3, 0, 0, 1]
    constant = T.histogram(spark.createDataFrame([(5.0,), (5.0,)], "v double"), "v", 3)
    assert sum(r["count"] for r in constant.collect()) == 2


def test_accuracy(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.5), (3.0, 3.5)], "actual double, predicted double")
    assert A.error_metrics(df).first()["mae"] == 0.5
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 4.0), (3.0, 3.0), (0.0, 0.0)], "actual double, predicted double")
    got = A.error_metrics(df).first()
    assert math.isclose(got["mse"], 1.0) and math.isclose(got["mape"], 1 / 3)
    fit = A.market_fit(spark.createDataFrame([(10.0, 11.0), (20.0, 19.0), (30.0, 31.0)], "actual double, predicted double")).first()
    assert math.isclose(fit["forecast_bias"], 61 / 60) and math.isclose(fit["inventory_efficiency_score"], 2 / 3)
    assert A.market_fit(df.limit(0)).count() == 0
    zero = A.market_fit(spark.createDataFrame([(0.0, 1.0)], "actual double, predicted double")).first()
    assert zero["forecast_bias"] == 0.0
