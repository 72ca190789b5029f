"""Missing values, outliers, scaling and power transforms.

Scalers that need one pass of sums take their statistics from a scalar subquery, so fitting and
applying is one lazy plan. Quantile bounds are fitted first (exactly, see ``exact_quantiles``) and
enter the plan as literals that reach the scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.functions import exact_quantiles, name_col, null_if_nan
from demandloom.functions.expr import numeric_columns
from demandloom.session import checkpoint

MAD_TO_SIGMA = 1.4826


def drop_missing(df: DataFrame) -> DataFrame:
    """Rows without any NULL or NaN."""
    return df.na.drop()


def _stats(df: DataFrame, **aggregates: Column) -> Column:
    """A struct of aggregates over the whole frame, as a scalar subquery."""
    packed = F.struct(*[a.alias(k) for k, a in aggregates.items()])
    return df.agg(packed.alias("stats")).scalar()


def impute_mean(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing numbers become the column mean; other columns are kept."""
    names = list(columns or numeric_columns(df))
    means = _stats(df, **{f"m{i}": F.avg(null_if_nan(df, c).cast("double")) for i, c in enumerate(names)})
    filled = {c: F.coalesce(null_if_nan(df, c).cast("double"), means[f"m{i}"]) for i, c in enumerate(names)}
    return df.withColumns(filled)


def drop_outliers(
    df: DataFrame, columns: Sequence[str] | None = None, low: float = 0.05, high: float = 0.95
) -> DataFrame:
    """Rows strictly between both quantiles in every column; rows with a missing value go too."""
    names = list(columns or numeric_columns(df))
    bounds = exact_quantiles(df, names, [low, high])
    inside = [(null_if_nan(df, c) > F.lit(b[0])) & (null_if_nan(df, c) < F.lit(b[1])) for c, b in bounds.items()]
    return df.filter(reduce(lambda a, b: a & b, inside)).na.drop()


def clean(
    df: DataFrame, missing: str = "none", outliers: str = "drop", columns: Sequence[str] | None = None
) -> DataFrame:
    """Missing values first (drop, impute, none), then outliers (drop, none)."""
    if missing not in ("drop", "impute", "none"):
        raise ValueError("missing must be drop, impute or none")
    if outliers not in ("drop", "none"):
        raise ValueError("outliers must be drop or none; rolling and hampel work on a series")
    if missing == "drop":
        df = drop_missing(df)
    elif missing == "impute":
        df = impute_mean(df, columns)
    return drop_outliers(df, columns) if outliers == "drop" else df


def _centred(by: Sequence[str], order: str, half_width: int):
    return Window.partitionBy(*by).orderBy(order).rowsBetween(-half_width, half_width)


def rolling_outliers(
    series: DataFrame, by: Sequence[str], order: str, value: str, half_width: int = 3, k: float = 2.0
) -> DataFrame:
    """Flag values further than ``k`` standard deviations from the mean of the rows around them.

    Meant for bucketed series, whose length per key is bounded by the number of buckets.
    """
    w = _centred(by, order, half_width)
    x = name_col(value).cast("double")
    mean, sd = F.avg(x).over(w), F.stddev_samp(x).over(w)
    return series.withColumn("is_outlier", F.coalesce(F.abs(x - mean) > k * sd, F.lit(False)))


def hampel_outliers(
    series: DataFrame, by: Sequence[str], order: str, value: str, half_width: int = 3, k: float = 3.0
) -> DataFrame:
    """Flag values further than ``k`` scaled median absolute deviations from the local median."""
    x = name_col(value).cast("double")
    near = F.collect_list(x).over(_centred(by, order, half_width))

    def median(values: Column) -> Column:
        s, n = F.sort_array(values), F.size(values)
        middle = F.floor(n / 2).cast("int")
        even = (F.get(s, middle - 1) + F.get(s, middle)) / 2
        return F.when(n % 2 == 1, F.get(s, middle)).otherwise(even)

    staged = series.withColumn("_near", near).withColumn("_median", median(F.col("_near")))
    deviations = F.transform("_near", lambda v: F.abs(v - F.col("_median")))
    staged = staged.withColumn("_mad", median(deviations))
    flag = F.abs(x - F.col("_median")) > k * MAD_TO_SIGMA * F.col("_mad")
    return staged.withColumn("is_outlier", F.coalesce(flag, F.lit(False))).drop("_near", "_median", "_mad")


def _or_one(c: Column) -> Column:
    return F.when(c == 0, F.lit(1.0)).otherwise(c)


def scale_standard(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(x - mean) / population standard deviation; a constant column becomes 0."""
    names = list(columns or numeric_columns(df))
    aggs = {}
    for i, c in enumerate(names):
        v = null_if_nan(df, c).cast("double")
        aggs |= {f"m{i}": F.avg(v), f"s{i}": F.stddev_pop(v)}
    s = _stats(df, **aggs)
    return df.withColumns({c: (name_col(c) - s[f"m{i}"]) / _or_one(s[f"s{i}"]) for i, c in enumerate(names)})


def scale_minmax(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(x - min) / (max - min); a constant column becomes 0."""
    names = list(columns or numeric_columns(df))
    aggs = {}
    for i, c in enumerate(names):
        v = null_if_nan(df, c).cast("double")
        aggs |= {f"lo{i}": F.min(v), f"hi{i}": F.max(v)}
    s = _stats(df, **aggs)
    return df.withColumns(
        {c: (name_col(c) - s[f"lo{i}"]) / _or_one(s[f"hi{i}"] - s[f"lo{i}"]) for i, c in enumerate(names)}
    )


def scale_robust(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(x - median) / interquartile range; a zero range counts as 1."""
    names = list(columns or numeric_columns(df))
    quartiles = exact_quantiles(df, names, [0.25, 0.5, 0.75])
    scaled = {}
    for c, (q1, q2, q3) in quartiles.items():
        if q2 is not None:
            scaled[c] = (name_col(c) - F.lit(q2)) / F.lit((q3 - q1) or 1.0)
    return df.withColumns(scaled)


def normalize(df: DataFrame, strategy: str = "none", columns: Sequence[str] | None = None) -> DataFrame:
    """Scale by name: standard, minmax, robust or none."""
    scalers = {"standard": scale_standard, "minmax": scale_minmax, "robust": scale_robust}
    if strategy == "none":
        return df
    if strategy not in scalers:
        raise ValueError("strategy must be standard, minmax, robust or none")
    return scalers[strategy](df, columns)


def _box_cox(x: Column, lam: Column) -> Column:
    return F.when(lam == 0, F.log(x)).otherwise((F.pow(x, lam) - 1) / lam)


def _yeo_johnson(x: Column, lam: Column) -> Column:
    up = F.when(lam == 0, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / lam)
    down = F.when(lam == 2, -F.log1p(-x)).otherwise(-(F.pow(1 - x, 2 - lam) - 1) / (2 - lam))
    return F.when(x >= 0, up).otherwise(down)


POWER_METHODS = {
    # transform, Jacobian term of the log-likelihood
    "box-cox": (_box_cox, lambda x: F.log(x)),
    "yeo-johnson": (_yeo_johnson, lambda x: F.signum(x) * F.log1p(F.abs(x))),
}
GRID_POINTS = 41
#: Points of the grids that follow the first one.
FINE_POINTS = 9
MAX_EXPONENT = 30


def _powers(method: str, x: np.ndarray, lam: float) -> np.ndarray:
    """The transforms above, for an array."""
    if method == "box-cox":
        return np.log(x) if lam == 0 else (np.power(x, lam) - 1) / lam
    up, down = np.maximum(x, 0), np.minimum(x, 0)
    high = np.log1p(up) if lam == 0 else (np.power(up + 1, lam) - 1) / lam
    low = -np.log1p(-down) if lam == 2 else -(np.power(1 - down, 2 - lam) - 1) / (2 - lam)
    return np.where(x >= 0, high, low)


def _variances(values: DataFrame, method: str, cells: list[tuple[int, int, float]]) -> dict[tuple[int, int], float]:
    """The variance of column x<i> under each exponent of the cells (i, k, exponent).

    One scan: a task sends number, mean and sum of squares of each cell. Squares are about the task's
    own mean and then moved to the common one, so large values lose no digits.
    """
    columns = sorted({i for i, _, _ in cells})

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {(i, k): (0, 0.0, 0.0) for i, k, _ in cells}
        for batch in batches:
            for place, i in enumerate(columns):
                x = batch.column(place).drop_null().to_numpy(zero_copy_only=False)
                for lam, k in [(c[2], c[1]) for c in cells if c[0] == i and len(x)]:
                    with np.errstate(all="ignore"):  # a sum beyond all numbers makes its exponent useless, see below
                        y = _powers(method, x, lam)
                        n, mean, square = sums[i, k]
                        new = y.mean()
                        total, off = n + len(y), new - mean
                        sums[i, k] = (total, mean + off * len(y) / total, square + ((y - new) ** 2).sum() + off * off * n * len(y) / total)
        found = [(i, k, *v) for (i, k), v in sums.items() if v[0]]
        yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], kind) for c, kind in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64()))], names=["i", "k", "n", "mean", "square"])

    parts = checkpoint(values.select(*[f"x{i}" for i in columns]).mapInArrow(partial, "i int, k int, n long, mean double, square double"))
    means = parts.groupBy("i", "k").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("common"))
    moved = F.sum(F.col("square") + F.col("n") * F.pow(F.col("mean") - F.col("common"), F.lit(2.0))) / F.sum("n")
    return {(r["i"], r["k"]): r["v"] for r in parts.join(means, ["i", "k"]).groupBy("i", "k").agg(moved.alias("v")).collect()}


def fit_power(df: DataFrame, columns: Sequence[str], method: str = "box-cox", passes: int = 4) -> dict[str, float]:
    """The exponent per column with the highest normal log-likelihood.

    Each pass scores a grid of exponents for all columns in one scan. The first grid is moved on while
    its best point is at an edge; from then on a few points lie about the top of the parabola through
    the best point and its neighbours, closer each time. A column without a best exponent up to
    ``MAX_EXPONENT`` is an error.
    """
    jacobian = POWER_METHODS[method][1]
    values = df.select(*[null_if_nan(df, c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    facts = [a for i in range(len(columns)) for a in (F.count(f"x{i}").alias(f"n{i}"), F.sum(jacobian(F.col(f"x{i}"))).alias(f"j{i}"))]
    row = values.agg(*facts).first()
    sums = {i: (row[f"n{i}"], row[f"j{i}"]) for i in range(len(columns)) if row[f"n{i}"]}
    grids = {i: [round(-2.0 + 4.0 * k / (GRID_POINTS - 1), 12) for k in range(GRID_POINTS)] for i in sums}
    best = {i: 1.0 for i in range(len(columns))}
    done = dict.fromkeys(sums, 0)
    while grids:
        found = _variances(values, method, [(i, k, lam) for i, grid in grids.items() for k, lam in enumerate(grid)])
        for i, grid in list(grids.items()):
            n, j = sums[i]
            score = {k: -n / 2 * math.log(v) + (lam - 1) * j for k, lam in enumerate(grid) if (v := found.get((i, k))) is not None and 0 < v < math.inf}
            if not score:
                del grids[i]
                continue
            k = max(score, key=lambda k: (score[k], -k))
            best[i], step = grid[k], grid[1] - grid[0]
            if not done[i] and k in (0, len(grid) - 1):
                if abs(grid[k]) >= MAX_EXPONENT:
                    raise ValueError(f"{columns[i]} has no best exponent up to {MAX_EXPONENT}")
                half = (grid[-1] - grid[0]) / 2
                grids[i] = [round(grid[k] - half + 2 * half * p / (GRID_POINTS - 1), 12) for p in range(GRID_POINTS)]
                continue
            done[i] += 1
            if passes > 1:
                best[i] = grid[k] + _top(score, k) * step
            if done[i] >= passes:
                del grids[i]
            else:
                half = step if done[i] == 1 else step / 4
                grids[i] = [best[i] - half + 2 * half * p / (FINE_POINTS - 1) for p in range(FINE_POINTS)]
    return {c: best[i] for i, c in enumerate(columns)}


def _top(score: Mapping[int, float], k: int) -> float:
    """Where the parabola through a best point and its neighbours is highest, in steps from the point."""
    if k - 1 not in score or k + 1 not in score:
        return 0.0
    bend = score[k - 1] - 2 * score[k] + score[k + 1]
    return max(-1.0, min(1.0, (score[k - 1] - score[k + 1]) / (2 * bend))) if bend < 0 else 0.0


def power_transform(df: DataFrame, columns: Sequence[str] | None = None, method: str = "box-cox") -> DataFrame:
    """Box-Cox or Yeo-Johnson with the fitted exponent, then standardised."""
    names = list(columns or numeric_columns(df))
    if not names:
        raise ValueError("DataFrame does not contain numeric columns")
    if method not in POWER_METHODS:
        raise ValueError("method must be box-cox or yeo-johnson")
    if method == "box-cox":
        lows = df.agg(*[F.min(null_if_nan(df, c)).alias(f"m{i}") for i, c in enumerate(names)]).first()
        if any(v is not None and v <= 0 for v in lows):
            raise ValueError("box-cox needs strictly positive values")
    exponents = fit_power(df, names, method)
    transform = POWER_METHODS[method][0]
    shaped = df.withColumns({c: transform(null_if_nan(df, c).cast("double"), F.lit(exponents[c])) for c in names})
    return scale_standard(shaped, names)
