"""Summary statistics over whole tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.functions import exact_quantiles, name_col, null_if_nan
from demandloom.functions.expr import numeric_columns
from demandloom.operators.features import unbiased_skewness


def group_mean(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean per value of each key, all keys in one pass: rows (key, key_value, mean)."""
    cells = F.array(
        *[F.struct(F.lit(k).alias("key"), name_col(k).cast("string").alias("key_value")) for k in keys]
    )
    long = df.select(name_col(value).alias("v"), F.inline(cells))
    return long.groupBy("key", "key_value").agg(F.avg("v").alias("mean"))


def yearly_totals(df: DataFrame, date_col: str, value: str, lo: int, hi: int) -> DataFrame:
    """Sum per year, both years included. The bound is on the date itself so it reaches the scan."""
    d = name_col(date_col)
    inside = (d >= F.make_date(F.lit(lo), F.lit(1), F.lit(1))) & (d < F.make_date(F.lit(hi + 1), F.lit(1), F.lit(1)))
    return df.filter(inside).groupBy(F.year(d).alias("year")).agg(F.sum(name_col(value)).alias("total"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(name_col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def rows_per_date(df: DataFrame, date_col: str) -> DataFrame:
    return df.groupBy(F.to_date(name_col(date_col)).alias("date")).agg(F.count(F.lit(1)).alias("count"))


def date_range(df: DataFrame, date_col: str) -> DataFrame:
    """First and last value and the number of distinct days."""
    d = name_col(date_col)
    per_day = df.groupBy(F.to_date(d).alias("day")).agg(F.min(d).alias("lo"), F.max(d).alias("hi"))
    return per_day.agg(F.min("lo").alias("first"), F.max("hi").alias("last"), F.count("day").alias("distinct_dates"))


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: count, nulls, mean, sample sd, min, exact quartiles, max."""
    names = list(columns or numeric_columns(df))
    quartiles = exact_quantiles(df, names, [0.25, 0.5, 0.75])
    aggs = [F.count(F.lit(1)).alias("total")]
    rows = []
    for i, c in enumerate(names):
        v = null_if_nan(df, c).cast("double")
        aggs.append(
            F.struct(
                F.count(v).alias("count"),
                F.avg(v).alias("mean"),
                F.stddev_samp(v).alias("std"),
                F.min(v).alias("min"),
                F.max(v).alias("max"),
            ).alias(f"s{i}")
        )
        s = F.col(f"s{i}")
        q = [F.lit(x).cast("double") for x in quartiles[c]]
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                s["count"].alias("count"),
                (F.col("total") - s["count"]).alias("null_count"),
                s["mean"].alias("mean"),
                s["std"].alias("std"),
                s["min"].alias("min"),
                q[0].alias("p25"),
                q[1].alias("p50"),
                q[2].alias("p75"),
                s["max"].alias("max"),
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair, over the rows where both are present: rows (a, b, r)."""
    names = list(columns or numeric_columns(df))
    v = {c: null_if_nan(df, c).cast("double") for c in names}
    pairs = list(combinations(range(len(names)), 2))
    one = df.agg(*[F.corr(v[names[i]], v[names[j]]).alias(f"r{i}_{j}") for i, j in pairs])
    cells = []
    for i, j in pairs:
        for a, b in ((i, j), (j, i)):
            cells.append((names[a], names[b], F.col(f"r{i}_{j}")))
    cells += [(c, c, F.lit(1.0)) for c in names]
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r.alias("r")) for a, b, r in cells]
    return one.select(F.inline(F.array(*rows)))


def correlation_with(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Correlation of each column with the target, highest first."""
    names = [c for c in (columns or numeric_columns(df)) if c != target]
    t = null_if_nan(df, target).cast("double")
    one = df.agg(*[F.corr(null_if_nan(df, c).cast("double"), t).alias(f"r{i}") for i, c in enumerate(names)])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"r{i}").alias("r")) for i, c in enumerate(names)]
    return one.select(F.inline(F.array(*rows))).orderBy(F.desc("r"), "column")


def skewness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Bias-corrected skewness per column."""
    names = list(columns or numeric_columns(df))
    one = df.agg(
        *[unbiased_skewness(null_if_nan(df, c).cast("double")).alias(f"s{i}") for i, c in enumerate(names)]
    )
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("skewness")) for i, c in enumerate(names)]
    return one.select(F.inline(F.array(*rows)))


def vif(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Variance inflation factors without intercept.

    With G the matrix of column products, the factor of column i is G[i,i] times the i-th diagonal
    element of the inverse of G. G is one distributed aggregate; only that small matrix is inverted
    on the driver.
    """
    import numpy as np

    names = list(columns)
    k = len(names)
    v = [null_if_nan(df, c).cast("double") for c in names]
    complete = df.select(*[x.alias(f"x{i}") for i, x in enumerate(v)]).na.drop()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = complete.agg(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"g{i}_{j}") for i, j in pairs]).first()
    g = np.zeros((k, k))
    for i, j in pairs:
        g[i, j] = g[j, i] = row[f"g{i}_{j}"] or 0.0
    scale = np.sqrt(np.diag(g))
    scale[scale == 0] = 1.0
    correlation = g / np.outer(scale, scale)
    try:
        factors = np.diag(np.linalg.inv(correlation))
    except np.linalg.LinAlgError:
        factors = np.full(k, np.inf)
    return df.sparkSession.createDataFrame(
        [(c, float(f)) for c, f in zip(names, factors)], "feature string, vif double"
    )


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins over the range; the last bin includes the maximum. Empty bins are kept."""
    v = null_if_nan(df, column).cast("double")
    ends = df.agg(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi")).alias("e")).scalar()
    width = (ends["hi"] - ends["lo"]) / bins
    slot = F.least(F.floor(F.try_divide(v - ends["lo"], width)), F.lit(bins - 1))
    counts = (
        df.filter(v.isNotNull())
        .groupBy(F.coalesce(slot, F.lit(0).cast("bigint")).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(counts, on="bin", how="left").select(
        "bin",
        (ends["lo"] + F.col("bin") * width).alias("low"),
        (ends["lo"] + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("count", F.lit(0).cast("bigint")).alias("count"),
    )
