"""Writers: parquet, CSV, report exports, JDBC, run log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.functions import name_col
from demandloom.operators.maintenance import normalize_nulls

REPORT_FORMATS = ("CSV", "JSON")
MANIFEST_SCHEMA = "name string, report_type string, file_path string, file_size_kb bigint, created_at timestamp"


def default_name(prefix: str = "processed") -> str:
    return f"{prefix}_{datetime.now(timezone.utc):%Y%m%d_%H%M%S}"


def write_parquet(df: DataFrame, path: str, partition_by: str | Sequence[str] | None = None, mode: str = "error") -> str:
    """Write parquet; partition columns the frame does not have are ignored."""
    wanted = [partition_by] if isinstance(partition_by, str) else list(partition_by or [])
    present = [c for c in wanted if c in df.columns]
    writer = df.write.mode(mode)
    if present:
        writer = writer.partitionBy(*present)
    writer.parquet(path)
    return path


def write_csv(df: DataFrame, path: str, mode: str = "error") -> str:
    """A headed UTF-8 CSV folder. Nested columns are written as JSON text."""
    complex_as_json(df).write.mode(mode).option("header", True).option("encoding", "UTF-8").option(
        "escape", '"'
    ).csv(path)
    return path


def export_view(df: DataFrame, columns: Sequence[str], path: str) -> str:
    """The visible columns only."""
    return write_csv(df.select(*[name_col(c) for c in columns]), path)


def sales_audit(df: DataFrame, out_dir: str, format: str = "CSV") -> str | None:
    """Export all sales and add a line to the report manifest.

    None for an unknown format or when there are no rows.
    """
    kind = format.upper()
    if kind not in REPORT_FORMATS or df.isEmpty():
        return None
    spark = df.sparkSession
    now = datetime.now(timezone.utc)
    path = f"{out_dir}/sales_audit_{now:%Y%m%d_%H%M%S_%f}.{kind.lower()}"
    if kind == "CSV":
        write_csv(df, path)
    else:
        df.write.option("ignoreNullFields", False).json(path)
    entry = [(f"Sales Audit {now:%Y-%m-%d}", kind, path, stored_bytes(spark, path) // 1024, now.replace(tzinfo=None))]
    spark.createDataFrame(entry, MANIFEST_SCHEMA).coalesce(1).write.mode("append").parquet(f"{out_dir}/reports")
    return path


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of a written folder, on whichever file system it lies."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(jvm_path).getLength())


def complex_as_json(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, for stores without nested types."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *[
            (F.to_json(name_col(f.name)) if isinstance(f.dataType, nested) else name_col(f.name)).alias(f.name)
            for f in df.schema.fields
        ]
    )


def jdbc_ready(df: DataFrame) -> DataFrame:
    """NaN as NULL and nested values as JSON text."""
    return complex_as_json(normalize_nulls(df))


def write_jdbc(df: DataFrame, uri: str, table: str, batch_size: int = 500, **options: str) -> dict[str, Any]:
    """Append to a relational table in batches, one connection per partition.

    Returns table, total, inserted and failed. Rows are counted as they are written; a write that
    fails raises, so what is returned has been inserted whole.
    """
    seen = Observation("write_jdbc")
    rows = jdbc_ready(df).observe(seen, F.count(F.lit(1)).alias("total"))
    rows.write.format("jdbc").mode("append").options(url=uri, dbtable=table, batchsize=str(batch_size), **options).save()
    total = seen.get["total"]
    return {"table": table, "total": total, "inserted": total, "failed": 0}


def run_log(profile: DataFrame, issues: DataFrame, source_name: str, params: Mapping[str, Any] | None = None) -> DataFrame:
    """One row summing up a run: sizes of the profile and of its issue list."""
    issue_count = issues.agg(F.count(F.lit(1)).alias("n")).scalar()
    return profile.agg(
        F.count(F.lit(1)).alias("field_count"),
        F.coalesce(F.max("record_count"), F.lit(0)).alias("record_count"),
        F.count_if("nullable").alias("nullable_field_count"),
        F.count_if("is_nested").alias("nested_field_count"),
    ).select(
        F.lit(source_name).alias("source_name"),
        "field_count",
        "record_count",
        issue_count.alias("issue_count"),
        "nullable_field_count",
        "nested_field_count",
        F.to_json(F.create_map(*[F.lit(str(x)) for kv in (params or {}).items() for x in kv])).alias("params")
        if params
        else F.lit(None).cast("string").alias("params"),
        F.current_timestamp().alias("logged_at"),
    )
