"""The ingestion chain: profile, drift check, rules, then clean-and-cast or order explosion, load, log."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.operators.cleaning import clean, normalize
from demandloom.operators.orders import load_orders
from demandloom.operators.profiling import drift_report, latest_profile, profile, save_profile, schema_drift, schema_issues
from demandloom.operators.quality import cast_to_profile, gatekeeper, require_quality, with_violations
from demandloom.session import path_exists
from demandloom.sources.ledger import write_counted
from demandloom.sources.writers import run_log


@dataclass(frozen=True)
class IngestResult:
    """What a run left behind. ``drift`` is None on the first run of a source."""

    profile: DataFrame
    issues: DataFrame
    drift: DataFrame | None
    quarantine: DataFrame | None
    loaded: DataFrame
    log: DataFrame


def ingest(
    source: DataFrame,
    out_dir: str,
    source_name: str,
    mode: str = "table",
    rules: str = "sales",
    strict: bool = False,
    missing: str = "impute",
    outliers: str = "drop",
    scaling: str = "none",
    columns: list[str] | None = None,
    mapping: Mapping[str, str] | None = None,
    source_id: int = 0,
    load_id: str | None = None,
    check_drift: bool = True,
) -> IngestResult:
    """Run the chain on one source and write below ``out_dir``.

    ``mode="table"`` cleans, scales and casts ``columns`` and writes one table; ``mode="orders"``
    explodes orders into the order tables and the dead letters. ``load_id`` names what is loaded:
    again under the same name it replaces the older rows; without one nothing is replaced.
    """
    if mode not in ("table", "orders"):
        raise ValueError("mode must be table or orders")
    spark = source.sparkSession
    run = load_id or uuid.uuid4().hex + "~"
    history = f"{out_dir}/schema_history"
    before = latest_profile(spark, history, source_name) if check_drift and path_exists(spark, history) else None
    save_profile(profile(source), history, source_name)
    current = latest_profile(spark, history, source_name)
    drift = None
    if before is not None:
        # the comparison is a few rows per column; kept as a table since the history moves on
        path = f"{out_dir}/schema_drift/load_id={run}"
        drift_report(schema_drift(before, current)).write.mode("overwrite").parquet(path)
        drift = spark.read.parquet(path)
    issues = schema_issues(current)
    quarantine = None
    if mode == "orders":
        loaded = load_orders(source, out_dir, mapping, source_id, load_id)
    else:
        if strict:
            gatekeeper(source, rules, strict)  # raises
        # the rows are checked and written once, split by the outcome; all that follows starts from there
        checked = f"{out_dir}/checked/load_id={run}"
        judged = with_violations(source, rules).withColumn("passed", F.size("violations") == 0)
        write_counted(judged, checked, "overwrite", "passed")
        rows = spark.read.schema(judged.schema).parquet(checked)
        passed, quarantine = rows.filter("passed").drop("passed", "violations"), rows.filter("NOT passed").drop("passed")
        shaped = normalize(clean(passed, missing, outliers, columns), scaling, columns)
        typed = require_quality(cast_to_profile(shaped, {r["name"]: r["inferred_type"] for r in _types(current, columns)}))
        count = write_counted(typed, f"{out_dir}/{source_name}/load_id={run}", "overwrite")
        loaded = spark.createDataFrame([(source_name, count, True)], "table string, rows bigint, counted boolean")
    log_path = f"{out_dir}/run_log"
    entry = run_log(current, issues, source_name, {"mode": mode, "rules": rules, "load_id": run})
    entry.write.mode("append").parquet(log_path)
    log = spark.read.parquet(log_path).filter(F.col("source_name") == source_name)
    return IngestResult(current, issues, drift, quarantine, loaded, log)


def _types(current: DataFrame, cleaned: list[str] | None):
    """Names and types of the columns that were not cleaned; cleaned ones are doubles already."""
    rows = current.select("name", "inferred_type")
    return (rows.filter(~F.col("name").isin(cleaned)) if cleaned else rows.filter(F.col("inferred_type") != "integer")).collect()
