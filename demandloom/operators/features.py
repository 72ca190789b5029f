"""Column features: calendar parts, log transforms, one-hot, renames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.functions import name_col, null_if_nan
from demandloom.functions.expr import numeric_columns

ORDER_FIELDS = {
    "required": ("order_id", "order_date"),
    "optional": ("customer_id", "status", "total_amount"),
}


def unbiased_skewness(v: Column) -> Column:
    """Bias-corrected sample skewness; Spark's own is the population form."""
    n = F.count(v).cast("double")
    factor = F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(n > 2, F.skewness(v) * factor)


def log1p_skewed(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.8) -> DataFrame:
    """log(1 + x) in the columns whose skewness is above the threshold."""
    names = list(columns or numeric_columns(df))
    aggs = [unbiased_skewness(null_if_nan(df, c).cast("double")).alias(f"s{i}") for i, c in enumerate(names)]
    skews = df.agg(F.struct(*aggs).alias("s")).scalar()
    return df.withColumns(
        {
            c: F.when(skews[f"s{i}"] > threshold, F.log1p(name_col(c).cast("double"))).otherwise(
                name_col(c).cast("double")
            )
            for i, c in enumerate(names)
        }
    )


def log1p_positive(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """log(1 + x) in the columns whose smallest value is above zero."""
    names = list(columns or numeric_columns(df))
    lows = df.agg(F.struct(*[F.min(null_if_nan(df, c)).alias(f"m{i}") for i, c in enumerate(names)]).alias("s")).scalar()
    return df.withColumns(
        {
            c: F.when(lows[f"m{i}"] > 0, F.log1p(name_col(c).cast("double"))).otherwise(name_col(c).cast("double"))
            for i, c in enumerate(names)
        }
    )


def calendar_parts(day: Column) -> dict[str, Column]:
    """Calendar parts of a date: Monday is 0, weeks are ISO weeks."""
    return {
        "year": F.year(day),
        "month": F.month(day),
        "day": F.dayofmonth(day),
        "day_of_week": F.weekday(day),
        "week_of_year": F.weekofyear(day),
        "quarter": F.quarter(day),
        "week_of_month": F.floor((F.dayofmonth(day) - 1) / 7).cast("int") + 1,
    }


def calendar_features(df: DataFrame, date_col: str) -> DataFrame:
    return df.withColumns(calendar_parts(F.to_date(name_col(date_col))))


def date_from_parts(df: DataFrame, year: str = "year", month: str = "month", into: str = "date") -> DataFrame:
    """The first of the month."""
    return df.withColumn(into, F.make_date(name_col(year), name_col(month), F.lit(1)))


def one_hot(df: DataFrame, column: str, values: Sequence | None = None) -> DataFrame:
    """One 0/1 column ``column_value`` per distinct value, sorted; the original is dropped.

    The values become names of columns, so they are part of the plan. ``one_hot_long`` has no such
    limit.
    """
    if values is None:
        distinct = df.select(name_col(column).alias("v")).filter(F.col("v").isNotNull()).distinct()
        values = sorted(r["v"] for r in distinct.collect())
    c = name_col(column)
    flags = [F.coalesce((c == F.lit(v)).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in values]
    return df.select(*[name_col(x) for x in df.columns if x != column], *flags)


def one_hot_long(df: DataFrame, column: str) -> DataFrame:
    """The same as rows (other columns, feature, hot), only those with a 1, for any number of values."""
    c = name_col(column)
    others = [name_col(x) for x in df.columns if x != column]
    return df.filter(c.isNotNull()).select(*others, F.concat(F.lit(f"{column}_"), c.cast("string")).alias("feature"), F.lit(1).alias("hot"))


def row_sum_features(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Named sums of column groups."""
    return df.withColumns({n: reduce(lambda a, b: a + b, [name_col(c) for c in cs]) for n, cs in groups.items()})


def map_columns(
    df: DataFrame,
    mapping: Mapping[str, str],
    required: Sequence[str] = ORDER_FIELDS["required"],
    optional: Sequence[str] = ORDER_FIELDS["optional"],
) -> tuple[DataFrame, list[str]]:
    """Rename by ``{internal: source}``. Returns the frame and the required names left unmapped.

    Internal columns that are absent afterwards are added as NULL.
    """
    renames = {source: internal for internal, source in mapping.items() if source in df.columns}
    out = df.withColumnsRenamed(renames)
    warnings = [c for c in required if c not in mapping]
    absent = [c for c in (*required, *optional) if c not in out.columns]
    return out.withColumns({c: F.lit(None).cast("string") for c in absent}), warnings
