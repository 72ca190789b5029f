"""Filtered scans, counts, look-ups and searches over a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.functions import name_col

# Filter-name suffixes; the two-letter-longer ones are tested first so that `__gte` is not `__gt`.
RANGE_SUFFIXES = {
    "__gte": lambda c, v: c >= v,
    "__lte": lambda c, v: c <= v,
    "__gt": lambda c, v: c > v,
    "__lt": lambda c, v: c < v,
}


def predicate(filters: Mapping[str, Any] | None) -> Column | None:
    """All conditions joined by AND. ``{"qty__gte": 3, "status": "active"}``."""
    conditions = []
    for key, value in (filters or {}).items():
        for suffix, compare in RANGE_SUFFIXES.items():
            if key.endswith(suffix):
                conditions.append(compare(name_col(key[: -len(suffix)]), F.lit(value)))
                break
        else:
            conditions.append(name_col(key) == F.lit(value))
    return reduce(lambda a, b: a & b, conditions) if conditions else None


def scan(
    df: DataFrame,
    filters: Mapping[str, Any] | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Rows matching every filter, then the named columns (all when None)."""
    condition = predicate(filters)
    out = df if condition is None else df.filter(condition)
    return out if columns is None else out.select(*[name_col(c) for c in columns])


def count_where(df: DataFrame, filters: Mapping[str, Any] | None = None) -> DataFrame:
    """One row, one column ``row_count``."""
    return scan(df, filters).agg(F.count(F.lit(1)).alias("row_count"))


def lookup(df: DataFrame, ids: DataFrame, id_column: str = "id") -> DataFrame:
    """Rows of ``df`` whose id is in ``ids`` (the column of the same name, or its only column)."""
    source = id_column if id_column in ids.columns else ids.columns[0]
    keys = ids.select(name_col(source).alias(id_column))
    return df.join(keys, on=id_column, how="left_semi")


def product_sales(
    df: DataFrame,
    product_ids: Sequence[Any] | DataFrame | None = None,
    start: Any = None,
    end: Any = None,
    date_col: str = "ds",
    columns: Sequence[str] | None = None,
    mapping: Mapping[str, str] | None = None,
) -> DataFrame:
    """Sales of some products in a date range, both ends included; empty filters are skipped.

    ``mapping`` is ``{internal name: name in the table}``. The ids are a literal list, or a
    DataFrame of ids of any size.
    """
    names = dict(mapping or {})
    product = names.get("product_id", "product_id")
    date = names.get(date_col, date_col)
    out = df
    if start:
        out = out.filter(name_col(date) >= F.lit(start))
    if end:
        out = out.filter(name_col(date) <= F.lit(end))
    if isinstance(product_ids, DataFrame):
        out = lookup(out, product_ids, product)
    elif product_ids:
        out = out.filter(name_col(product).isin(list(product_ids)))
    return out if columns is None else out.select(*[name_col(names.get(c, c)) for c in columns])


def search_any(df: DataFrame, text: str) -> DataFrame:
    """Rows where any column, as text, contains ``text`` in any letter case."""
    needle = text.lower()
    hits = [F.lower(name_col(c).cast("string")).contains(needle) for c in df.columns]
    return df.filter(F.coalesce(F.exists(F.array(*hits), lambda hit: hit), F.lit(False)))


def search_products(df: DataFrame, name: str = "", id_prefix: str = "") -> DataFrame:
    """Products whose name contains ``name`` and whose id starts with ``id_prefix``."""
    out = df
    if name:
        out = out.filter(F.lower("name").contains(name.lower()))
    if id_prefix:
        out = out.filter(F.col("id").cast("string").startswith(id_prefix))
    return out


def source_metadata(df: DataFrame, source_type: str, source_name: str) -> DataFrame:
    """One row describing an extracted table."""
    return df.agg(F.count(F.lit(1)).alias("record_count")).select(
        F.lit(source_type).alias("source_type"),
        F.lit(source_name).alias("source_name"),
        "record_count",
        F.lit(len(df.columns)).alias("column_count"),
        F.current_timestamp().alias("extracted_at"),
    )


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Names of the tables and views the session knows."""
    statement = f"SHOW TABLES IN {database}" if database else "SHOW TABLES"
    return spark.sql(statement).select(F.col("tableName").alias("name")).distinct()


def describe_columns(spark: SparkSession, table: str | DataFrame) -> DataFrame:
    """One row per column: name and type."""
    frame = spark.table(table) if isinstance(table, str) else table
    rows = [(f.name, f.dataType.simpleString()) for f in frame.schema.fields]
    return spark.createDataFrame(rows, "name string, type string")
