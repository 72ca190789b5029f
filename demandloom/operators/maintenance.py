"""Set forms of update, delete and upsert. Each returns the new table snapshot."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.functions import name_col, null_if_nan
from demandloom.operators.relational import predicate

# The dimension tables a sync may target.
DIMENSIONS = ("products", "categories", "regions", "segments", "customers")


def normalize_nulls(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column."""
    return df.select(*[null_if_nan(df, c).alias(c) for c in df.columns])


def bulk_update(df: DataFrame, filters: Mapping[str, Any], updates: Mapping[str, Any]) -> DataFrame:
    """Set literals on the rows that match all filters. ``count_where`` gives their number."""
    condition = predicate(filters)
    changed = {}
    for name, value in updates.items():
        new = F.lit(value).cast(df.schema[name].dataType)
        changed[name] = new if condition is None else F.when(condition, new).otherwise(name_col(name))
    return df.withColumns(changed)


def bulk_delete(df: DataFrame, keys: DataFrame, id_column: str = "id") -> DataFrame:
    """Rows whose id is not among ``keys``."""
    source = id_column if id_column in keys.columns else keys.columns[0]
    return df.join(keys.select(name_col(source).alias(id_column)), on=id_column, how="left_anti")


def fold_updates(updates: DataFrame, key: str, order_col: str) -> DataFrame:
    """One row per key: for each column the last non-null value in ``order_col`` order.

    An aggregate rather than a window, so a key repeated very often is combined before the shuffle.
    """
    fields = [c for c in updates.columns if c not in (key, order_col)]
    last = [
        F.max_by(name_col(c), F.when(name_col(c).isNotNull(), name_col(order_col))).alias(c)
        for c in fields
    ]
    return updates.filter(name_col(key).isNotNull()).groupBy(key).agg(*last)


def upsert(target: DataFrame, updates: DataFrame, key: str, order_col: str | None = None) -> DataFrame:
    """Insert new keys; on known keys overwrite only the fields that are given (not NULL).

    ``order_col`` orders repeated keys within the batch. Without it the keys must be unique.
    """
    changes = updates if order_col is None else fold_updates(updates, key, order_col)
    t, u = target.alias("t"), changes.alias("u")
    joined = t.join(u, on=F.col(f"t.`{key}`") == F.col(f"u.`{key}`"), how="full_outer")
    columns = []
    for f in target.schema.fields:
        old = F.col(f"t.`{f.name}`")
        if f.name in changes.columns:
            old = F.coalesce(F.col(f"u.`{f.name}`").cast(f.dataType), old)
        columns.append(old.alias(f.name))
    extra = [c for c in changes.columns if c not in target.columns]
    return joined.select(*columns, *[F.col(f"u.`{c}`") for c in extra])


def sync_dimension(
    df: DataFrame,
    target: DataFrame,
    key: str,
    order_col: str | None = None,
) -> DataFrame:
    """Bring a dimension table up to date; an empty input leaves it as it is."""
    return upsert(target, normalize_nulls(df), key, order_col)
