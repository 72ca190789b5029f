import json

import numpy as np
import pytest
from tests.conftest import rows
from pyspark.sql import functions as F

from demandloom.operators import forecast as M
from demandloom.operators import learn as L


def series_of(spark, values_by_product):
    data = [(p, f"{t:04d}", float(v)) for p, values in values_by_product.items() for t, v in enumerate(values)]
    return spark.createDataFrame(data, "product_id int, bucket string, quantity double")


def test_naive(spark):
    got = rows(M.forecast_naive(series_of(spark, {1: [1, 2, 9], 2: [4]}), 2, order="bucket"))
    assert got == [(1, 1, 9.0), (1, 2, 9.0), (2, 1, 4.0), (2, 2, 4.0)]


def test_arima_recovers_an_autoregression():
    rng = np.random.default_rng(11)
    y = np.zeros(600)
    for t in range(1, 600):
        y[t] = 3 + 0.7 * y[t - 1] + rng.normal()
    path, error, method = M.arima_path(y, 40)
    mean = 3 / 0.3
    assert method.startswith("arima") and abs(path[0] - (3 + 0.7 * y[-1])) < 0.6
    assert abs(path[-1] - mean) < 0.8 and abs(error[0] - 1) < 0.15 and error[-1] == pytest.approx(1 / np.sqrt(1 - 0.49), rel=0.2)


def test_arima_differences_a_trend():
    rng = np.random.default_rng(2)
    y = np.cumsum(2 + rng.normal(0, 0.5, 300))
    path, error, method = M.arima_path(y, 10)
    assert ",1," in method and path[-1] == pytest.approx(y[-1] + 20, abs=3) and error[-1] > error[0]
    assert M.choose_difference(rng.normal(size=200)) == 0
    quadratic = np.arange(60.0) ** 2 + rng.normal(0, 0.1, 60)
    assert M.arima_path(quadratic, 1)[0][0] == pytest.approx(3600, rel=0.05)


def test_arima_moving_average():
    rng = np.random.default_rng(4)
    e = rng.normal(size=2000)
    y = 5 + e[1:] + 0.6 * e[:-1]
    path, error, method = M.arima_path(y, 6)
    assert path[-1] == pytest.approx(5, abs=0.3) and error[0] == pytest.approx(1, rel=0.1)


def test_arima_short_and_constant(spark):
    got = M.forecast_arima(series_of(spark, {1: [5, 5], 2: [5, 5, 5], 3: [7] * 30, 4: [1, 2, 3, 4]}), 2).collect()
    by = {}
    for r in got:
        by.setdefault(r["product_id"], []).append(r)
    assert [(r["status"], r["forecast"], r["data_points"]) for r in by[1]] == [("no_data", None, 2)]
    assert [r["forecast"] for r in by[2]] == [5.0, 5.0] and [r["forecast"] for r in by[3]] == [7.0, 7.0]
    assert all(r["method"] == "naive" for k in (2, 3) for r in by[k])
    assert all(r["method"].startswith("arima(") for r in by[4])


def test_orders_are_compared_on_one_sample():
    """A first-order autoregression is found and its coefficient is that of least squares."""
    rng = np.random.default_rng(3)
    y = np.zeros(400)
    for t in range(1, 400):
        y[t] = 2 + 0.6 * y[t - 1] + rng.normal()
    fit, p, q = M.search_orders(y, np.r_[np.full(26, np.nan), rng.normal(size=374)], 26)
    assert (p, q) == (1, 0)
    slope, constant = np.polyfit(y[:-1], y[1:], 1)
    assert fit[2][0] == pytest.approx(slope) and fit[1] == pytest.approx(constant)
    for n in range(3, 30):
        path, spread, method = M.arima_path(rng.normal(10, 1, n).cumsum(), 3)
        assert np.isfinite(path).all() and np.isfinite(spread).all() and method.startswith("arima(")


def test_exact_likelihood():
    """Equal to the density of the whole series, and no start is more likely than its fit."""
    rng = np.random.default_rng(5)
    for phi, theta in (([0.6], []), ([], [0.5]), ([0.5, -0.3], [0.4]), ([], [])):
        phi, theta = np.array(phi), np.array(theta)
        w = rng.normal(3, 1, 40)
        psi = np.zeros(400)  # covariances from the weights of past shocks
        for j in range(400):
            psi[j] = (1 if j == 0 else theta[j - 1] if j <= len(theta) else 0) + sum(phi[i] * psi[j - 1 - i] for i in range(min(len(phi), j)))
        covariance = np.array([[psi[: 400 - abs(i - j)] @ psi[abs(i - j) :] for j in range(40)] for i in range(40)])
        e = w - 2.5
        sigma2 = e @ np.linalg.solve(covariance, e) / 40
        want = -0.5 * (40 * np.log(2 * np.pi * sigma2) + np.linalg.slogdet(covariance)[1] + 40)
        assert M.exact_likelihood(w, 2.5, phi, theta) == pytest.approx(want)
        mean, phi_, theta_, weights, sigma2, _ = M.fit_exact(w, np.zeros((40, 0)), 2.5, phi, theta)
        best = M.exact_likelihood(w, mean, phi_, theta_)
        assert best >= want - 1e-9 and len(weights) == 0
        for i in range(1 + len(phi) + len(theta)):
            for step in (-0.01, 0.01):
                moved = np.r_[mean, phi_, theta_]
                moved[i] += step
                near = moved[1 : len(phi) + 1], moved[len(phi) + 1 :]
                if M._inside(near[0]) and M._inside(-near[1]):
                    assert M.exact_likelihood(w, moved[0], *near) <= best + 1e-6
    assert (mean, sigma2) == pytest.approx((w.mean(), w.var()))


def test_exact_forecasts(spark):
    """An autoregression's forecast follows from its exact fit; a regression is fitted with its errors' model."""
    rng = np.random.default_rng(6)
    y = np.zeros(300)
    for t in range(1, 300):
        y[t] = 0.7 * y[t - 1] + rng.normal()
    path, error, method = M.arima_path(10 + y, 30, exact=True)
    assert method.startswith("arima(") and abs(path[0] - (10 + 0.7 * y[-1])) < 0.5 and error[-1] == pytest.approx(1 / np.sqrt(1 - 0.49), rel=0.2)
    for n in range(3, 30):
        path, spread, method = M.arima_path(rng.normal(10, 1, n).cumsum(), 3, exact=True)
        assert np.isfinite(path).all() and np.isfinite(spread).all()
    x = rng.normal(size=300)
    past = spark.createDataFrame([(1, t, float(b), float(a)) for t, (a, b) in enumerate(zip(x, 10 + 5 * x + y))], "product_id int, period_end int, quantity double, x double")
    future = spark.createDataFrame([(1, 1, 0.0), (1, 2, 2.0)], "product_id int, period int, x double")
    first, second = (r["forecast"] for r in M.forecast_arimax(past, future, ["x"], exact=True).orderBy("step").collect())
    assert first == pytest.approx(10 + 0.7 * y[-1], abs=0.6) and second == pytest.approx(20 + 0.49 * y[-1], abs=0.9)
    short = series_of(spark, {1: [5, 5], 2: [5, 5, 5], 3: [1, 2, 3, 4]})
    assert {(r["product_id"], r["status"]) for r in M.forecast_arima(short, 2, exact=True).collect()} == {(1, "no_data"), (2, "success"), (3, "success")}


def test_models_are_saved(spark, tmp_path):
    data = [(i % 3, float(i), float(i * 2 % 7), "train" if i < 40 else "test") for i in range(50)]
    df = spark.createDataFrame(data, "product_id int, x double, quantity double, split string")
    trained = L.train_gbt(df, ["x"], rounds=3, depth=2)
    L.save_model(trained, str(tmp_path / "m"))
    loaded = L.load_model(spark, str(tmp_path / "m"))
    assert (loaded.features, loaded.params) == (trained.features, {k: float(v) for k, v in trained.params.items()})
    assert rows(loaded.metrics) == rows(trained.metrics)
    wanted = df.filter("split = 'test'").select("product_id", "x").dropDuplicates(["product_id"])
    assert rows(L.predict_demand(loaded, wanted, wanted)) == rows(L.predict_demand(trained, wanted, wanted))


def test_arimax_uses_the_future_values(spark):
    rng = np.random.default_rng(7)
    x = np.tile([0.0, 1.0], 60)
    y = 10 + 5 * x + rng.normal(0, 0.1, 120)
    past = spark.createDataFrame([(1, t, float(b), float(a)) for t, (a, b) in enumerate(zip(x, y))], "product_id int, period_end int, quantity double, x double")
    future = spark.createDataFrame([(1, 1, 0.0), (1, 2, 1.0)], "product_id int, period int, x double")
    got = [r["forecast"] for r in M.forecast_arimax(past, future, ["x"]).orderBy("step").collect()]
    assert got == pytest.approx([10, 15], abs=0.3)


def test_clean_forecast(spark):
    df = spark.createDataFrame([(1, [1.0, -2.0]), (2, [1.0, 2.0, 3.0, 4.0]), (3, []), (4, None)], "id int, forecast array<double>")
    got = {r["id"]: (r["forecast"], r["forecast_status"]) for r in M.clean_forecast(df, 3).collect()}
    assert got == {1: ([1.0, 0.0, 0.0], "ok"), 2: ([1.0, 2.0, 3.0], "ok"), 3: (None, "missing"), 4: (None, "missing")}
    text = spark.createDataFrame([(1, ["1", "x"]), (2, ["2"])], "id int, forecast array<string>")
    got = {r["id"]: (r["forecast"], r["forecast_status"]) for r in M.clean_forecast(text, 2).collect()}
    assert got == {1: (None, "invalid"), 2: ([2.0, 2.0], "ok")}


def test_backtest(spark):
    rng = np.random.default_rng(9)
    wave = 50 + 20 * np.sin(np.arange(60) * np.pi / 2) + rng.normal(0, 0.5, 60)
    got = M.backtest(series_of(spark, {1: wave, 2: [3.0] * 20}), 4).collect()
    best = {r["product_id"]: r["model"] for r in got if r["is_best"]}
    assert best[1] == "arima" and len(got) == 4 and all(r["n"] == 4 for r in got)


def test_recursive_trees(spark):
    """A repeating series is learned; each step goes on from the step before; short series have no forecast."""
    cycle = [float(10 * (i % 4)) for i in range(48)]
    series = series_of(spark, {1: cycle, 2: cycle[2:], 3: [5.0, 5.0]})
    got = {}
    for r in L.forecast_trees(series, 6, rounds=20, depth=4).collect():
        got[r["product_id"], r["step"]] = r["forecast"]
    assert sorted(got) == [(p, s) for p in (1, 2) for s in range(1, 7)]
    assert all(abs(got[p, s] - 10 * ((s - 1 + len(series_)) % 4)) < 3 for p, series_ in ((1, cycle), (2, cycle)) for s in range(1, 7))
    assert L.forecast_trees(series.filter("product_id = 3"), 6).collect() == []
    best = M.backtest(series.filter("product_id < 3"), 4, more={"boosted_trees": lambda *a: L.forecast_trees(*a, rounds=20, depth=4)}).collect()
    assert {r["model"] for r in best} == {"naive", "arima", "boosted_trees"} and all(r["n"] == 4 for r in best)


def test_lagged_rows_are_read_as_files(spark, monkeypatch):
    """Only the steps are checkpoints, whose partitions stay as they are however large; the rows to learn from are files."""
    kept, checkpoint = [], L.checkpoint
    monkeypatch.setattr(L, "checkpoint", lambda df: kept.append(df.columns) or checkpoint(df))
    got = L.forecast_trees(series_of(spark, {1: [1, 2, 3, 4, 5, 6], 2: [1]}), 2, rounds=2, depth=2)
    assert rows(got, "product_id", "step") == [(1, 1), (1, 2)]
    assert len(kept) == 2 and all("forecast" in names for names in kept)


def test_split_is_in_time_order(spark):
    df = L.split_time(series_of(spark, {1: range(11)}), order="bucket")
    got = [r["split"] for r in df.orderBy("bucket").collect()]
    assert got == ["train"] * 8 + ["eval"] * 2 + ["test"]


def test_trees_and_ledger(spark):
    df = spark.range(60).select(
        F.lit(1).alias("product_id"), (F.col("id") % 6).cast("double").alias("a"), ((F.col("id") % 6) * 10).cast("double").alias("quantity"),
        F.when(F.col("id") < 48, "train").otherwise("eval").alias("split"),
    )
    trained = L.train_gbt(df, ["a"], rounds=5, depth=3)
    assert trained.metrics.filter("split = 'eval'").first()["mae"] < 5
    asked = spark.createDataFrame([(1,), (2,)], "product_id int")
    features = spark.createDataFrame([(1, 3.0)], "product_id int, a double")
    got = {r["product_id"]: r for r in L.predict_demand(trained, features, asked).collect()}
    assert abs(got[1]["prediction"] - 30) < 8 and (got[2]["prediction"], got[2]["status"]) == (0.0, "no_data")
    log = L.log_predictions(L.predict_demand(trained, features, asked))
    assert log.count() == 1 and json.loads(log.first()["features_json"]) == {"a": 3.0}


def test_equal_rows_are_learned_from_once(spark, tmp_path, monkeypatch):
    """From some size on equal rows are one row with a weight, and the model is the same."""
    data = [(i % 3, float(i % 5), float(i % 30), float((i % 5) * 7 + i % 2), "train" if i % 10 else "test") for i in range(600)]
    df = spark.createDataFrame(data, "product_id int, a double, b double, quantity double, split string")
    plain = L.train_gbt(df, ["a", "b"], rounds=4, depth=3)
    monkeypatch.setattr(L, "GROUP_FROM", 1)
    given, fit = [], L.Pipeline.fit
    monkeypatch.setattr(L.Pipeline, "fit", lambda self, frame: given.append(frame.count()) or fit(self, frame))
    grouped = L.train_gbt(df, ["a", "b"], rounds=4, depth=3)
    assert given == [df.filter("split = 'train'").select("a", "b", "quantity").distinct().count()] and given[0] < 100
    asked = df.select("product_id", "a", "b").distinct()
    scores = [{(r["a"], r["b"]): r["prediction"] for r in t.model.transform(asked).collect()} for t in (plain, grouped)]
    assert scores[1] == pytest.approx(scores[0])
    assert grouped.metrics.filter("split = 'test'").first()["n"] == 60
    # a feature with very many values is learned from in buckets, also after saving
    monkeypatch.setattr(L, "MANY_VALUES", 20)
    cut = L.train_gbt(df, ["a", "b"], rounds=4, depth=3)
    assert cut.model.stages[-2].getInputCols() == ["a", "_bucket_b_no"] and 2 <= len(cut.model.stages[0].getSplitsArray()[0]) <= L.BINS + 1
    L.save_model(cut, str(tmp_path / "m"))
    loaded = L.load_model(spark, str(tmp_path / "m"))
    got = {(r["a"], r["b"]): r["prediction"] for r in loaded.model.transform(asked).collect()}
    assert got == pytest.approx(scores[0], abs=1.5)


def test_scoring(spark):
    log = spark.createDataFrame([(1, "m", "v1", 10.0, "d"), (2, "m", "v1", 10.0, "d"), (3, "m", "v1", 10.0, "d")], "product_id int, model_name string, model_version string, predicted_value double, target_date string")
    actuals = spark.createDataFrame([(1, "d", 11.0), (2, "d", 20.0)], "product_id int, target_date string, actual_value double")
    scored = L.score_predictions(log, actuals)
    assert rows(scored, "product_id", "status", "drift_detected") == [(1, "completed", False), (2, "completed", True), (3, "pending", False)]
    assert L.accuracy_by_version(scored).first()["drift_share"] == 0.5


def test_features_of_days(spark):
    """The scope day: weekday means, a rolling week, and the days to come."""
    import datetime as dt

    from demandloom.operators import inventory as N

    first = dt.datetime(2024, 2, 20)
    sales = spark.createDataFrame([(1, first + dt.timedelta(d), float(d + 1)) for d in range(9)], "product_id int, ds timestamp, quantity double")
    got = N.insight_features(sales, "day", 2).first()
    past, ahead = got["historical_features"], got["future_features"]
    assert [h["quantity"] for h in past] == [9.0, 8.0, 7.0, 6.0, 5.0, 4.0, 3.0, 2.0, 1.0]
    assert (past[0]["date"], past[0]["prev_period_sales"], past[0]["rollback_n"], past[-1]["rollback_n"]) == ("2024-02-28", 8.0, 35.0, None)
    assert [(f["date"], f["prev_period_sales"]) for f in ahead] == [("2024-02-29", 9.0), ("2024-03-01", None)]
    assert got["weekday_means"]["Tue"] == 4.5 and got["weekday_means"]["Mon"] == 7.0


def test_features_are_cut_as_the_trees_cut_them(spark):
    """Mostly zeros: a cut after each value until the counts have caught up with the stride, and none after the last value."""
    counts = [(0.0, 700), *[(float(v), 10) for v in range(1, 31)]]
    got = L.tree_cuts(counts)
    assert len(got) <= L.BINS - 1 and [round(c, 6) for c in got[:3]] == [0.5, 1.5, 2.5] and got == sorted(set(got))
    even = L.tree_cuts([(float(v), 5) for v in range(64)])
    assert [round(c, 6) for c in even] == [2 * k + 1.5 for k in range(L.BINS - 1)]
    assert 1.5 < even[0]  # a value half way between belongs below the cut


def test_many_values_make_few_groups(spark, monkeypatch):
    """A feature with more values than bins is learned from in the ranges that the trees tell apart; the errors are of all rows."""
    data = [(float(i % 100), float(i % 100 // 25), "train" if i % 10 else "test") for i in range(4000)]
    df = spark.createDataFrame(data, "a double, quantity double, split string")
    plain = L.train_gbt(df, ["a"], rounds=4, depth=3)
    monkeypatch.setattr(L, "GROUP_FROM", 1)
    given, fit = [], L.Pipeline.fit
    monkeypatch.setattr(L.Pipeline, "fit", lambda self, frame: given.append((frame.count(), frame.agg(F.sum("_weight")).first()[0])) or fit(self, frame))
    trained = L.train_gbt(df, ["a"], rounds=4, depth=3)
    assert given[0][0] <= L.BINS + 3 and given[0][1] == 3600
    got, wanted = ({r["split"]: (r["n"], r["mae"], r["mse"], r["mape"]) for r in t.metrics.collect()} for t in (trained, plain))
    assert {s: v[0] for s, v in got.items()} == {"train": 3600, "test": 400}
    scored = trained.model.transform(df.withColumnRenamed("quantity", "label"))
    rowwise = {r["split"]: (r["n"], r["mae"], r["mse"], r["mape"]) for r in L.error_metrics(scored, "label", "prediction", ["split"]).collect()}
    for s in got:
        assert got[s] == pytest.approx(rowwise[s]) and got[s][1] == pytest.approx(wanted[s][1], abs=0.1)
