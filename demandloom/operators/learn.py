"""A global boosted-tree model over all products, batch prediction and prediction logs."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import Bucketizer, SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.functions import name_col
from demandloom.operators.accuracy import error_metrics
from demandloom.operators.series import ordered_by
from demandloom.session import checkpoint, materialize, shared_dir

# The training parameters.
ROUNDS, DEPTH, RATE, EVAL_SHARE = 100, 5, 0.1, 0.2
MODEL_NAME = "boosted_trees"
#: Training rows from which equal ones are learned from as one, with their number as its weight; fewer gain little by it.
GROUP_FROM = 1_000_000
#: The trees tell ``BINS`` ranges of a feature apart; if it has more values, it is cut into them first: by the counts of its
#: values, or, if there are more than ``MANY_VALUES``, by quantiles.
MANY_VALUES, BINS = 4_096, 32
#: Rows that one task of the training holds.
ROWS_PER_TASK = 250_000


def split_time(
    df: DataFrame,
    eval_share: float = EVAL_SHARE,
    test_share: float = 0.1,
    by: Sequence[str] = ("product_id",),
    order: str = "period_end",
) -> DataFrame:
    """``split`` = train, eval or test by position in time within each series, newest last."""
    rank = F.percent_rank().over(ordered_by(by, order))
    return df.withColumn(
        "split",
        F.when(rank > 1 - test_share, "test").when(rank > 1 - test_share - eval_share, "eval").otherwise("train"),
    )


@dataclass(frozen=True)
class TrainedModel:
    model: PipelineModel
    features: tuple[str, ...]
    params: dict[str, float]
    metrics: DataFrame


def train_gbt(
    df: DataFrame,
    features: Sequence[str],
    label: str = "quantity",
    rounds: int = ROUNDS,
    depth: int = DEPTH,
    rate: float = RATE,
    seed: int = 42,
) -> TrainedModel:
    """Boosted trees on absolute error, one model for all products.

    ``df`` has the column ``split`` of ``split_time``; rows with a missing feature are left out.
    ``metrics`` holds the errors per split. All rows count: from ``GROUP_FROM`` on, equal ones as one row with a weight.
    """
    shared_dir(df.sparkSession)  # the training cuts its lineage there
    rows = df.select("split", name_col(label).cast("double").alias("label"), *[name_col(c).cast("double").alias(c) for c in features])
    rows = rows.na.drop()
    trained_on = F.col("split") == "train"
    trees = GBTRegressor(
        featuresCol="features",
        labelCol="label",
        lossType="absolute",
        maxIter=rounds,
        maxDepth=depth,
        maxBins=BINS,
        stepSize=rate,
        seed=seed,
        checkpointInterval=10,
    )
    params = {"rounds": rounds, "depth": depth, "rate": rate}
    with materialize(rows, "training") as kept:
        train = kept.filter(trained_on).drop("split")
        if train.count() < GROUP_FROM:
            model = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), trees]).fit(train)
            return TrainedModel(model, tuple(features), params, error_metrics(model.transform(rows), "label", "prediction", ["split"]))
        buckets, names = value_buckets(train, features)
        # equal rows have one prediction too, so the errors come from the groups, which outlive this block
        groups = checkpoint(grouped_rows(kept, ["split", *names], buckets))
    learned = groups.filter(trained_on)
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-learned.count() // ROWS_PER_TASK))
    flow = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), trees.setWeightCol("_weight")])
    fitted = flow.fit(learned.drop("split").repartition(tasks))
    errors = error_metrics(fitted.transform(groups), "label", "prediction", ["split"], weight="_weight")
    return TrainedModel(PipelineModel([*buckets, *fitted.stages]), tuple(features), params, errors)


def value_buckets(rows: DataFrame, features: Sequence[str]) -> tuple[list[Transformer], list[str]]:
    """Buckets for the features with more values than the trees tell apart, and the columns to learn from in their place."""
    seen = rows.agg(*[F.approx_count_distinct(name_col(c)).alias(c) for c in features]).first()
    many = [c for c in features if seen[c] > MANY_VALUES]
    ranks = [k / BINS for k in range(1, BINS)]
    cuts = dict(zip(many, rows.approxQuantile(many, ranks, 0.001))) if many else {}
    for c in features:
        if c not in cuts and seen[c] > BINS // 2:  # the number is a guess
            counts = rows.groupBy(name_col(c).alias("v")).count().orderBy("v").collect()  # MANY_VALUES, or some more
            if len(counts) > BINS:
                cuts[c] = tree_cuts([(r["v"], r["count"]) for r in counts])
    if not cuts:
        return [], list(features)
    splits = [[-math.inf, *sorted({q for q in found if math.isfinite(q)}), math.inf] for found in cuts.values()]
    made = {c: f"_bucket_{c}" for c in cuts}
    cut = Bucketizer(splitsArray=splits, inputCols=list(made), outputCols=list(made.values()))
    # the sum is a number, while the trees would take the bucket itself for a category without order
    plain = ", ".join(f"`{c}` + 0.0D AS `{c}_no`" for c in made.values())
    return [cut, SQLTransformer(statement=f"SELECT *, {plain} FROM __THIS__")], [f"{made[c]}_no" if c in made else c for c in features]


def tree_cuts(counts: Sequence[tuple[float, int]]) -> list[float]:
    """The lower ends of the ranges that the trees cut a feature into, from its values in order and how often each occurs.

    MLlib's rule for continuous features, which it applies to a sample of the rows: a cut half way to the
    next value wherever the running count is nearest to a multiple of the stride.
    """
    stride = sum(n for _, n in counts) / BINS
    cuts, target, seen = [], stride, counts[0][1]
    for (value, _), (following, n) in zip(counts, counts[1:]):
        if abs(seen - target) < abs(seen + n - target):
            # what equals the middle belongs below it
            cuts.append(math.nextafter(value / 2 + following / 2, math.inf))
            target += stride
        seen += n
    return cuts[: BINS - 1]


def grouped_rows(rows: DataFrame, names: Sequence[str], buckets: Sequence[Transformer] = ()) -> DataFrame:
    """(label, columns to learn from, _weight): one row for all that are equal in these, with their number.

    The trees add up labels, or signs of errors, by bucket of a feature, so they learn the same from them.
    """
    found = reduce(lambda df, stage: stage.transform(df), buckets, rows)
    return found.groupBy("label", *[name_col(c) for c in names]).agg(F.count(F.lit(1)).cast("double").alias("_weight"))


def save_model(trained: TrainedModel, path: str) -> None:
    """The model, its features, parameters and errors below a folder, replacing what is there."""
    spark = trained.metrics.sparkSession
    trained.model.write().overwrite().save(f"{path}/model")
    trained.metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    facts = [(list(trained.features), {k: float(v) for k, v in trained.params.items()})]
    spark.createDataFrame(facts, "features array<string>, params map<string,double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")


def load_model(spark: SparkSession, path: str) -> TrainedModel:
    """What ``save_model`` has written."""
    facts = spark.read.parquet(f"{path}/facts").first()
    return TrainedModel(PipelineModel.load(f"{path}/model"), tuple(facts["features"]), dict(facts["params"]), spark.read.parquet(f"{path}/metrics"))


def predict_demand(trained: TrainedModel, features: DataFrame, requested: DataFrame, key: str = "product_id") -> DataFrame:
    """One prediction per requested id; ids without features get 0.0 and status no_data."""
    usable = features.select(key, *[name_col(c).cast("double").alias(c) for c in trained.features]).na.drop()
    scored = trained.model.transform(usable).select(
        key, F.col("prediction").alias("_p"), F.to_json(F.struct(*trained.features)).alias("features_json")
    )
    ids = requested.select(key).distinct()
    return ids.join(scored, on=key, how="left").select(
        key,
        F.coalesce("_p", F.lit(0.0)).alias("prediction"),
        F.when(F.col("_p").isNull(), "no_data").otherwise("success").alias("status"),
        "features_json",
    )


#: Past buckets that a recursive forecast looks at.
LAGS = 3


def lag_rows(series: DataFrame, by: Sequence[str], order: str, value: str, lags: int = LAGS) -> DataFrame:
    """Each bucket with the values of the ``lags`` buckets before it and its place in the series, from 0."""
    w = ordered_by(by, order)
    past = {f"lag_{k}": F.lag(name_col(value).cast("double"), k).over(w) for k in range(1, lags + 1)}
    return series.withColumns({**past, "place": F.row_number().over(w) - 1})


def forecast_trees(
    series: DataFrame,
    horizon: int,
    by: Sequence[str] = ("product_id",),
    order: str = "bucket",
    value: str = "quantity",
    lags: int = LAGS,
    rounds: int = ROUNDS,
    depth: int = DEPTH,
) -> DataFrame:
    """(keys, step, forecast) of one boosted-tree model over all series, step after step.

    The model learns a bucket from the ``lags`` before it. A step is predicted for all series at once;
    the lags of the next step come from these predictions. Negative predictions count as 0. Series
    with fewer buckets than lags have no forecast, nor has a table in which no series is longer.
    """
    keys = list(by)
    names = [f"lag_{k}" for k in range(1, lags + 1)]
    none = series.select(*keys, F.lit(1).alias("step"), F.lit(0.0).alias("forecast")).limit(0)
    # as files, which tasks share by size; a checkpoint keeps the partitions of the window, however large
    with materialize(lag_rows(series, keys, order, value, lags), "lags") as rows:
        known = rows.na.drop(subset=[*names, value])
        if known.isEmpty():
            return none
        model = train_gbt(known.withColumn("split", F.lit("train")), names, value, rounds, depth).model
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(name_col(value).cast("double").alias("lag_1"), *[F.col(f"lag_{k}").alias(f"lag_{k + 1}") for k in range(1, lags)]), "place").alias("s"))
        state = last.select(*keys, "s.*").na.drop(subset=names)
        steps = []
        for step in range(1, horizon + 1):
            # each step is kept, else the model of the last one would run over all steps before it again
            scored = checkpoint(model.transform(state).select(*keys, *names, F.greatest("prediction", F.lit(0.0)).alias("forecast")))
            steps.append(scored.select(*keys, F.lit(step).alias("step"), "forecast"))
            state = scored.select(*keys, F.col("forecast").alias("lag_1"), *[F.col(f"lag_{k}").alias(f"lag_{k + 1}") for k in range(1, lags)])
    return reduce(DataFrame.unionByName, steps)


def log_predictions(
    predictions: DataFrame, model_name: str = MODEL_NAME, model_version: str = "v1.0.0", key: str = "product_id"
) -> DataFrame:
    """Ledger rows of successful predictions; append them to the inference table."""
    rows = predictions.filter(F.col("status") == "success") if "status" in predictions.columns else predictions
    features = F.col("features_json") if "features_json" in predictions.columns else F.lit("{}")
    return rows.select(
        key,
        F.lit(model_name).alias("model_name"),
        F.lit(model_version).alias("model_version"),
        F.col("prediction").cast("double").alias("predicted_value"),
        F.current_timestamp().alias("prediction_ts"),
        features.alias("features_json"),
    )


def score_predictions(
    log: DataFrame,
    actuals: DataFrame,
    tolerance: float = 0.2,
    on: Sequence[str] = ("product_id", "target_date"),
) -> DataFrame:
    """The log with what really happened: actual value, status and whether the error is beyond
    ``tolerance`` of it. Predictions without an actual stay pending."""
    joined = log.join(actuals.select(*on, name_col("actual_value").cast("double").alias("actual_value")), on=list(on), how="left")
    actual, predicted = F.col("actual_value"), F.col("predicted_value")
    off = F.abs(predicted - actual)
    return joined.withColumns(
        {
            "status": F.when(actual.isNull(), "pending").otherwise("completed"),
            "drift_detected": F.coalesce(off > tolerance * F.abs(actual), F.lit(False)),
        }
    )


def accuracy_by_version(scored: DataFrame) -> DataFrame:
    """Errors and drift share per model version over the completed predictions."""
    done = scored.filter(F.col("status") == "completed")
    drift = F.avg(F.col("drift_detected").cast("double")).alias("drift_share")
    return error_metrics(done, "actual_value", "predicted_value", ["model_name", "model_version"], [drift])
