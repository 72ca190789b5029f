"""Spike detection and the alert ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.operators.maintenance import bulk_update

# Spike rule and the display style per severity.
SPIKE_FACTOR = 3
DEFAULT_SAFETY = 20
CRITICAL_ABOVE = 100
EVENT_TYPE = "SALES_VOLUME_SPIKE"
SEVERITY_STYLE = {
    "critical": {"icon": "🔴", "color": "#ef4444", "bg": "#ef444412", "border": "#ef444430"},
    "warning": {"icon": "🟡", "color": "#f59e0b", "bg": "#f59e0b12", "border": "#f59e0b30"},
    "info": {"icon": "🔵", "color": "#3b82f6", "bg": "#3b82f612", "border": "#3b82f630"},
}
LEDGER_FIELDS = ("alert_id", "severity", "event_type", "alert_ts", "message", "is_resolved", "product_id")


def spikes(sales: DataFrame, products: DataFrame) -> DataFrame:
    """Sale rows whose quantity is above three times the product's safety stock.

    Rows below the lowest limit of all products are dropped before the join.
    """
    limits = products.select(
        F.col("id").alias("product_id"), F.coalesce("safety_stock", F.lit(DEFAULT_SAFETY)).alias("threshold")
    )
    lowest = limits.agg(F.least(F.coalesce(F.min("threshold"), F.lit(DEFAULT_SAFETY)), F.lit(DEFAULT_SAFETY)).alias("t"))
    candidates = sales.filter(F.col("quantity") > lowest.scalar() * SPIKE_FACTOR)
    joined = candidates.join(limits, on="product_id", how="left")
    return joined.withColumn("threshold", F.coalesce("threshold", F.lit(DEFAULT_SAFETY))).filter(
        F.col("quantity") > F.col("threshold") * SPIKE_FACTOR
    )


def anomaly_scan(sales: DataFrame, products: DataFrame, order_keys: Sequence[str] = ("order_id", "line_no")) -> DataFrame:
    """One alert per product: its earliest spike by (ds, *order_keys).

    The earliest is an aggregate, so the spikes of one product are combined before they are shuffled.
    """
    keys = [k for k in order_keys if k in sales.columns]
    first = F.min(F.struct("ds", *keys, F.col("quantity"), "threshold")).alias("hit")
    hits = spikes(sales, products).groupBy("product_id").agg(first).select("product_id", "hit.*")
    return described(hits).select("product_id", "ds", "quantity", "threshold", "severity", "message")


def described(hits: DataFrame) -> DataFrame:
    """Spikes with the severity and the message of their alerts."""
    text = F.concat(
        F.lit("Anomaly: Product '"),
        F.col("product_id").cast("string"),
        F.lit("' sales velocity exceeds safety threshold ("),
        F.col("quantity").cast("string"),
        F.lit(" units)."),
    )
    return hits.withColumns({"severity": F.when(F.col("quantity") > CRITICAL_ABOVE, "critical").otherwise("warning"), "message": text})


def alert_id(*parts: Column) -> Column:
    """A UUID-shaped id made from the alert itself, so a repeated task gives the same one."""
    h = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts])


def emit_alerts(hits: DataFrame, event_type: str = EVENT_TYPE, at: Column | None = None) -> DataFrame:
    """Ledger rows for the hits; append them to the alert table."""
    return hits.select(
        alert_id(F.lit(event_type), F.col("product_id"), F.col("ds"), F.col("quantity")).alias("alert_id"),
        "severity",
        F.lit(event_type).alias("event_type"),
        (at if at is not None else F.current_timestamp()).alias("alert_ts"),
        "message",
        F.lit(False).alias("is_resolved"),
        "product_id",
    )


def active_alerts(alerts: DataFrame, severity: str | None = None, include_resolved: bool = False) -> DataFrame:
    """Alerts for display, newest first. Severity None or ``all`` means every severity."""
    rows = alerts
    if severity and severity != "all":
        rows = rows.filter(F.col("severity") == severity)
    if not include_resolved:
        rows = rows.filter(~F.col("is_resolved"))
    level = F.lower(F.coalesce("severity", F.lit("info")))

    def style(key: str) -> Column:
        return (
            F.when(level == "critical", SEVERITY_STYLE["critical"][key])
            .when(level == "warning", SEVERITY_STYLE["warning"][key])
            .otherwise(SEVERITY_STYLE["info"][key])
        )

    return rows.select(
        F.col("alert_id").cast("string").alias("id"),
        level.alias("severity"),
        F.date_format("alert_ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"),
        F.coalesce("event_type", F.lit("system")).alias("type"),
        F.when(F.col("is_resolved"), "resolved").otherwise("active").alias("status"),
        F.coalesce("message", F.lit("Unknown Alert")).alias("title"),
        F.col("message").alias("desc"),
        F.coalesce(F.date_format("alert_ts", "HH:mm"), F.lit("Just now")).alias("time"),
        level.alias("level"),
        *[style(k).alias(k) for k in ("icon", "color", "bg", "border")],
    ).orderBy(F.desc("ts"), "id")


def resolve_alerts(alerts: DataFrame, ids: DataFrame | Sequence[str] | None = None) -> DataFrame:
    """Mark alerts as resolved: those in ``ids``, or all unresolved ones."""
    if ids is None:
        return bulk_update(alerts, {"is_resolved": False}, {"is_resolved": True})
    if not isinstance(ids, DataFrame):
        hit = F.col("alert_id").isin(list(ids))
        return alerts.withColumn("is_resolved", F.col("is_resolved") | F.coalesce(hit, F.lit(False)))
    marked = ids.select(F.col(ids.columns[0]).alias("alert_id"), F.lit(True).alias("_hit")).distinct()
    joined = alerts.join(marked, on="alert_id", how="left")
    return joined.withColumn("is_resolved", F.col("is_resolved") | F.coalesce("_hit", F.lit(False))).select(
        *alerts.columns
    )
