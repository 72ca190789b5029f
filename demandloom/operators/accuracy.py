"""Forecast accuracy and market fit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.functions import name_col


def error_metrics(
    df: DataFrame,
    actual: str = "actual",
    predicted: str = "predicted",
    by: Sequence[str] = (),
    extra: Sequence[Column] = (),
    weight: str | None = None,
) -> DataFrame:
    """Mean absolute error, mean squared error and mean absolute percentage error (a fraction).

    Rows with actual 0 do not enter the percentage error. ``extra`` are more aggregates of the same
    groups. ``weight`` is the column with how many rows a row stands for.
    """
    y, p = name_col(actual).cast("double"), name_col(predicted).cast("double")

    def mean(error: Column) -> Column:
        if weight is None:
            return F.avg(error)
        w = name_col(weight)
        return F.try_divide(F.sum(error * w), F.sum(F.when(error.isNotNull(), w)))

    return df.groupBy(*by).agg(
        mean(F.abs(y - p)).alias("mae"),
        mean((y - p) * (y - p)).alias("mse"),
        mean(F.when(y != 0, F.abs((y - p) / y))).alias("mape"),
        (F.count(F.lit(1)) if weight is None else F.sum(name_col(weight)).cast("bigint")).alias("n"),
        *extra,
    )


def market_fit(
    df: DataFrame, actual: str = "actual", predicted: str = "predicted", by: Sequence[str] = ()
) -> DataFrame:
    """Bias, shares of under- and over-prediction, and the share within 100-120 % of demand."""
    y, p = name_col(actual).cast("double"), name_col(predicted).cast("double")
    out = df.groupBy(*by).agg(
        F.coalesce(F.try_divide(F.sum(p), F.sum(y)), F.lit(0.0)).alias("forecast_bias"),
        F.avg((p < y).cast("double")).alias("under_prediction_rate"),
        F.avg((p > y).cast("double")).alias("over_prediction_rate"),
        F.avg(((p >= y) & (p <= y * 1.2)).cast("double")).alias("inventory_efficiency_score"),
        F.sum(y).alias("total_actual_demand"),
        F.sum(p).alias("total_predicted_demand"),
    )
    return out.filter(F.col("under_prediction_rate").isNotNull())
