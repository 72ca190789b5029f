"""A manifest of loads: several sources, runs and streams write to the tables of one folder.

Every attempt to load writes below ``<table>/load_id=<attempt>``, a folder that no other attempt ever
uses. Its entry in the manifest is written last. Readers see the loads that have an entry and nothing
else, so a load that died half way is as if it had never been, and a load under a key that is there
already replaces the older one in one step.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from demandloom.session import path_exists, short_shuffles

MANIFEST = "load_manifest"
ENTRY = "load_key string, source_id int, sequence bigint, counts map<string,bigint>, committed_at timestamp, load_id string"


@dataclass(frozen=True)
class Load:
    """One attempt to load; ``key`` is what is loaded."""

    out_dir: str
    key: str
    attempt: str
    source_id: int

    def path(self, table: str) -> str:
        return f"{self.out_dir}/{table}/load_id={self.attempt}"


def begin(out_dir: str, source_id: int = 0, key: str | None = None) -> Load:
    """A new attempt. Without a key the load is one of its own; keys belong to their source."""
    made = uuid.uuid4().hex
    name = re.sub(r"[^\w.-]+", "_", f"{source_id}-{made if key is None else key}")
    return Load(out_dir, name, f"{name}~{made}", source_id)


def stream_key(spark: SparkSession, checkpoint: str, batch_id: int) -> str:
    """The key of a micro-batch: the query's own id, which its checkpoint keeps, and the batch."""
    metadata = "".join(r["value"] for r in spark.read.text(f"{checkpoint}/metadata").collect())
    return f"{json.loads(metadata)['id']}-{batch_id}"


def committed(spark: SparkSession, out_dir: str) -> DataFrame:
    """The manifest: the last attempt committed under each key."""
    path = f"{out_dir}/{MANIFEST}"
    if not path_exists(spark, path):
        return spark.createDataFrame([], ENTRY)
    rows = spark.read.schema(ENTRY).option("basePath", path).parquet(path)
    names = [c for c in rows.columns if c != "load_key"]
    last = F.max(F.struct("sequence", "committed_at", "load_id", "source_id", F.to_json("counts").alias("counts"))).alias("last")
    found = rows.groupBy("load_key").agg(last).select("load_key", "last.*")
    return found.withColumn("counts", F.from_json("counts", "map<string,bigint>")).select("load_key", *names)


def is_committed(spark: SparkSession, out_dir: str, source_id: int, key: str) -> bool:
    return not committed(spark, out_dir).filter(F.col("load_key") == begin(out_dir, source_id, key).key).isEmpty()


def commit(spark: SparkSession, load: Load, counts: Mapping[str, int]) -> int:
    """Make the load visible; returns its place in the order of loads."""
    newest = committed(spark, load.out_dir).agg(F.coalesce(F.max("sequence"), F.lit(0))).first()[0]
    row = [(load.key, load.source_id, newest + 1, dict(counts))]
    entry = spark.createDataFrame(row, "load_key string, source_id int, sequence bigint, counts map<string,bigint>")
    entry.withColumn("committed_at", F.current_timestamp()).coalesce(1).write.mode("error").parquet(load.path(MANIFEST))
    return newest + 1


def raw(spark: SparkSession, out_dir: str, table: str) -> DataFrame | None:
    """All that lies in a table's folder, committed or not, with ``load_id``; None if there is nothing."""
    path = f"{out_dir}/{table}"
    if not path_exists(spark, path):
        return None
    return spark.read.option("basePath", path).parquet(path)


#: Load ids that are named in a plan, so that the folders of other loads are not read; more are broadcast.
NAMED_LOADS = 1024


def of_loads(rows: DataFrame, loads: DataFrame) -> DataFrame:
    """The rows of some loads. Never a shuffle by load, which would send all rows of one to a single task."""
    ids = loads.select("load_id")
    named = [r["load_id"] for r in ids.limit(NAMED_LOADS + 1).collect()]
    if len(named) <= NAMED_LOADS:
        return rows.filter(F.col("load_id").isin(named))
    return rows.join(F.broadcast(ids), "load_id", "left_semi")


def read(spark: SparkSession, out_dir: str, table: str) -> DataFrame | None:
    """The committed rows of a table with ``load_id``; None if it was never written to."""
    rows = raw(spark, out_dir, table)
    return None if rows is None else of_loads(rows, committed(spark, out_dir))


def write_counted(df: DataFrame, path: str, mode: str = "error", partition_by: str | None = None) -> int:
    """Write parquet and return the rows written, counted in the same pass.

    Without rows a partitioned table would be a folder without any file, so without a schema.
    """
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).option("compression", "zstd")
    with short_shuffles(df.sparkSession):
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    rows = int(seen.get["rows"])
    if partition_by and not rows:
        none = df.sparkSession.createDataFrame([], df.drop(partition_by).schema)
        none.write.parquet(f"{path}/{partition_by}=__HIVE_DEFAULT_PARTITION__")
    return rows
