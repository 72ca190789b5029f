"""Updates that rewrite the touched parts of a table only.

A versioned table is cut into parts by ranges of its key. A part is a folder that is never written to
again; a version lists the folders that make up the table. An update looks for the parts it touches,
writes those anew, and lists them with the untouched folders in the next version. That entry is
written last and its number can be claimed once, so readers see a version whole or not at all, and of
two writers at once the second fails instead of undoing the first.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.functions import name_col
from demandloom.operators.maintenance import bulk_delete, bulk_update, upsert
from demandloom.operators.relational import predicate
from demandloom.session import path_exists
from demandloom.sources import ledger

#: Parts a table is cut into, unless the caller says otherwise; keys find their part by halving the bounds.
PARTS, MOST_PARTS = 64, 4096
PART = "_part"
ENTRY = "part int, folder string"
SHAPE = "key string, bounds string, columns string"


class Conflict(RuntimeError):
    """Another writer has made the next version meanwhile; read it and update again."""


@dataclass(frozen=True)
class Version:
    """What a version consists of; ``bounds`` are the least keys of all parts but the first."""

    path: str
    number: int
    key: str
    bounds: list
    columns: T.StructType
    folders: dict[int, str]

    def part_of(self, key: Column) -> Column:
        """The number of the part a key lies in; null keys lie in the first."""
        dtype = self.columns[self.key].dataType

        def below(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            middle = (low + high) // 2
            return F.when(key >= F.lit(self.bounds[middle]).cast(dtype), below(middle + 1, high)).otherwise(below(low, middle))

        return below(0, len(self.bounds))

    def rows(self, spark: SparkSession, parts: list[int] | None = None) -> DataFrame:
        """The rows of some parts, or of all."""
        folders = [f for p, f in sorted(self.folders.items()) if parts is None or p in parts]
        if not folders:
            return spark.createDataFrame([], self.columns)
        return spark.read.schema(self.columns).parquet(*folders)


def latest(spark: SparkSession, path: str) -> Version:
    versions = f"{path}/versions"
    if not path_exists(spark, versions):
        raise ValueError(f"there is no versioned table in {path}")
    entries = spark.read.schema(ENTRY + ", version int").option("basePath", versions).parquet(versions)
    number = entries.agg(F.max("version")).first()[0]
    folders = {r["part"]: r["folder"] for r in entries.filter(F.col("version") == number).collect() if r["folder"]}  # at most MOST_PARTS
    shape = spark.read.schema(SHAPE).parquet(f"{path}/shape").first()
    return Version(path, number, shape["key"], json.loads(shape["bounds"]), T.StructType.fromJson(json.loads(shape["columns"])), folders)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table as of its latest version."""
    return latest(spark, path).rows(spark)


def create(df: DataFrame, path: str, key: str, parts: int = PARTS) -> int:
    """Make a versioned table; returns its rows. The key is a number, a text, a date or a timestamp."""
    if not 1 <= parts <= MOST_PARTS:
        raise ValueError(f"parts must be from 1 to {MOST_PARTS}")
    spark = df.sparkSession
    dealt = df.select(name_col(key).alias("k")).repartitionByRange(parts, "k").groupBy(F.spark_partition_id()).agg(F.min("k").cast("string").alias("low"))
    lows = dealt.filter("low IS NOT NULL").select(F.col("low").cast(df.schema[key].dataType).alias("k")).orderBy("k").select(F.col("k").cast("string")).collect()
    bounds = [r["k"] for r in lows[1:]]
    shape = (key, json.dumps(bounds), df.schema.json())
    spark.createDataFrame([shape], SHAPE).coalesce(1).write.mode("error").parquet(f"{path}/shape")
    empty = Version(path, 0, key, bounds, df.schema, {})
    return _commit(spark, empty, df, list(range(len(bounds) + 1)))


def update_where(spark: SparkSession, path: str, filters: Mapping[str, Any], updates: Mapping[str, Any]) -> int:
    """Set literals on the rows that match all filters; returns how many parts were written anew."""
    version = latest(spark, path)
    condition = predicate(filters)
    if version.key in updates:
        raise ValueError("the key tells the part of a row and cannot be updated")
    rows = version.rows(spark)
    parts = _parts(version, rows if condition is None else rows.filter(condition))
    _commit(spark, version, bulk_update(version.rows(spark, parts), filters, updates), parts)
    return len(parts)


def delete_keys(spark: SparkSession, path: str, keys: DataFrame) -> int:
    """Delete the rows of some keys, the first column; returns how many parts were written anew."""
    version = latest(spark, path)
    wanted = keys.select(name_col(keys.columns[0]).cast(version.columns[version.key].dataType).alias(version.key))
    held = version.rows(spark).select(name_col(version.key)).join(wanted.distinct(), version.key, "left_semi")
    parts = _parts(version, held)
    _commit(spark, version, bulk_delete(version.rows(spark, parts), wanted, version.key), parts)
    return len(parts)


def upsert_rows(spark: SparkSession, path: str, updates: DataFrame, order_col: str | None = None) -> int:
    """Insert new keys and overwrite the given fields of known ones; returns how many parts were written anew."""
    version = latest(spark, path)
    changes = updates.filter(name_col(version.key).isNotNull())
    parts = _parts(version, changes)
    _commit(spark, version, upsert(version.rows(spark, parts), changes, version.key, order_col).select(*version.columns.names), parts)
    return len(parts)


def _parts(version: Version, rows: DataFrame) -> list[int]:
    """The parts that the rows' keys lie in."""
    found = rows.select(version.part_of(name_col(version.key)).alias(PART)).distinct().collect()  # at most MOST_PARTS
    return sorted(r[PART] for r in found)


def _commit(spark: SparkSession, version: Version, rows: DataFrame, parts: list[int]) -> int:
    """Write the parts anew and make them the next version, with all others as they are; returns the rows written."""
    if not parts and version.number:
        return 0
    folder = f"{version.path}/data/write={uuid.uuid4().hex}~"
    dealt = rows.withColumn(PART, version.part_of(name_col(version.key))).repartition(max(1, len(parts)), PART)
    count = ledger.write_counted(dealt, folder, partition_by=PART)
    made = {p: f"{folder}/{PART}={p}" for p in parts if path_exists(spark, f"{folder}/{PART}={p}")}
    folders = {p: f for p, f in version.folders.items() if p not in parts} | made
    entry = spark.createDataFrame(list(folders.items()) or [(0, None)], ENTRY)
    try:
        entry.coalesce(1).write.mode("error").parquet(f"{version.path}/versions/version={version.number + 1}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        raise Conflict(f"version {version.number + 1} of {version.path} is there already") from e
    return count
