"""Spike alerts with the open alert of each product in a state store.

A product has at most one open alert. Its next spike opens another one only after a resolution, which
is an event like the sales are. The state of a product is its open alert and the time up to which its
spikes are dealt with, so a batch reads nothing but its own rows and the states that they touch.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from demandloom.operators.alerts import EVENT_TYPE, LEDGER_FIELDS, alert_id, described, spikes
from demandloom.sources import ledger as loads
from demandloom.streaming import jobs

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Times are microseconds: Python's would depend on the zone of the worker.
STATE = "open_id string, severity string, message string, opened bigint, dealt_with bigint"
EVENT = "alert_id string, severity string, event_type string, message string, is_resolved boolean, product_id {key}, happened bigint"


def event(alert: str, severity: str, message: str, is_resolved: bool, product, happened) -> Row:
    return Row(alert_id=alert, severity=severity, event_type=EVENT_TYPE, message=message, is_resolved=is_resolved, product_id=product, happened=happened)


class OpenAlerts(StatefulProcessor):
    """Turns the spikes and resolutions of a product into alerts that open and close.

    The events of a batch are taken by time, a resolution after the spikes of its instant. A spike
    that is not later than the last resolution was dealt with by it. ``places`` are the columns by
    which the spikes of one instant are ordered, missing values first.
    """

    def __init__(self, places: tuple[str, ...]) -> None:
        self.places = places

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("alert", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first: dict = {}  # the first spike of each instant, with its place: all that can open an alert
        resolved = set()
        for row in rows:
            if row["is_resolution"]:
                resolved.add(row["happened"])
                continue
            place = [(row[c] is not None, row[c]) for c in self.places]
            if row["happened"] not in first or place < first[row["happened"]][0]:
                first[row["happened"]] = place, row
        held = self.state.get()
        open_id, severity, message, opened, dealt_with = held if held is not None else (None,) * 5
        for happened, is_resolution in sorted([(t, False) for t in first] + [(t, True) for t in resolved]):
            if is_resolution:
                dealt_with = happened if dealt_with is None else max(dealt_with, happened)
                if open_id is not None and opened <= happened:
                    yield event(open_id, severity, message, True, key[0], happened)
                    open_id = None
            elif open_id is None and (dealt_with is None or happened > dealt_with):
                spike = first[happened][1]
                open_id, severity, message, opened = spike["alert_id"], spike["severity"], spike["message"], happened
                yield event(open_id, severity, message, False, key[0], happened)
        self.state.update((open_id, severity, message, opened, dealt_with))

    def close(self) -> None:
        pass


def alert_events(sales: DataFrame, products: DataFrame, resolutions: DataFrame | None = None, order_keys: tuple[str, ...] = ("order_id", "line_no")) -> DataFrame:
    """A stream of alerts as they open and close, from a stream of sales and one of resolutions.

    ``resolutions`` has the columns product_id and resolved_at. Only spikes are shuffled.
    """
    # columns of their own: a struct would reach the state as a dict, which has no order
    places = {f"place_{n}": k for n, k in enumerate([*[k for k in order_keys if k in sales.columns], "quantity", "threshold"])}
    hits = described(spikes(sales, products)).select(
        "product_id",
        F.unix_micros(F.col("ds").cast("timestamp")).alias("happened"),
        F.lit(False).alias("is_resolution"),
        alert_id(F.lit(EVENT_TYPE), F.col("product_id"), F.col("ds"), F.col("quantity")).alias("alert_id"),
        "severity",
        "message",
        *[F.col(k).alias(c) for c, k in places.items()],
    )
    key = hits.schema["product_id"].dataType
    if resolutions is not None:
        closing = resolutions.select(F.col("product_id").cast(key).alias("product_id"), F.unix_micros(F.col("resolved_at").cast("timestamp")).alias("happened"), F.lit(True).alias("is_resolution"))
        hits = hits.unionByName(closing, allowMissingColumns=True)
    schema = T.StructType.fromDDL(EVENT.format(key=key.simpleString()))
    found = hits.filter("happened IS NOT NULL").groupBy("product_id").transformWithState(OpenAlerts(tuple(places)), schema, "Append", "None")
    return found.withColumn("happened", F.timestamp_micros("happened"))


@contextmanager
def rocks_state(spark: SparkSession):
    """The state store that keyed state needs, for queries that start in the block."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def stream_alert_events(sales: DataFrame, products: DataFrame, out_dir: str, checkpoint: str, resolutions: DataFrame | None = None) -> StreamingQuery:
    """Write what ``alert_events`` gives, each micro-batch a load of its own below ``out_dir``."""
    with rocks_state(sales.sparkSession):
        return jobs.write_batches(alert_events(sales, products, resolutions), out_dir, checkpoint)


def alert_ledger(spark: SparkSession, out_dir: str) -> DataFrame:
    """The alerts of all batches, one row each, as the batch ledger has them; ``alert_ts`` is the spike's time."""
    rows = loads.read(spark, out_dir, jobs.STATE)
    found = rows.groupBy("alert_id", "product_id").agg(
        F.min(F.struct("is_resolved", "severity", "event_type", "message", "happened")).alias("first"), F.max("is_resolved").alias("is_resolved")
    )
    return found.select("alert_id", "first.severity", "first.event_type", F.col("first.happened").alias("alert_ts"), "first.message", "is_resolved", "product_id").select(*LEDGER_FIELDS)
