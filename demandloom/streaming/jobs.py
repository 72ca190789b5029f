"""Streaming forms of the order load, daily demand, metrics, sync and alerts.

Each micro-batch is a load of its query in the folder's manifest (``sources.ledger``): its key is the
query's id, which the checkpoint keeps, and the batch. A batch replayed after a failure is loaded once,
and several sources, or a source with a new checkpoint, share a folder without touching each other's
rows.
"""

from __future__ import annotations

import threading
from collections import defaultdict
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from demandloom.functions import name_col
from demandloom.functions.expr import digest
from demandloom.operators.alerts import LEDGER_FIELDS, anomaly_scan, emit_alerts
from demandloom.operators.demand import refresh
from demandloom.operators.orders import daily_demand, explode_orders, load_orders, unparsed_orders
from demandloom.operators.quality import with_violations
from demandloom.session import path_exists, short_shuffles
from demandloom.sources import ledger as loads


def file_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType | None = None,
    glob: str | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """A folder of parquet files as a stream, in place of a message topic.

    Zone-free timestamps are read as timestamps, since event time needs them.
    """
    if schema is None:
        probe = spark.read.option("pathGlobFilter", glob or "*")
        schema = probe.parquet(folder).schema
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return zoned(reader.parquet(folder))


def zoned(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {f.name: name_col(f.name).cast("timestamp") for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)}
    )


def finish(query: StreamingQuery) -> StreamingQuery:
    """Wait for an ``availableNow`` query and raise what stopped it; then do what is left for the end of the run."""
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    if at_end := getattr(query, AT_END, None):
        at_end()
    return query


#: The attribute of a query with what ``finish`` calls.
AT_END = "at_end"


def load_batches(df: DataFrame, out_dir: str, checkpoint: str, load: Callable[[DataFrame, str], None], source_id: int = 0, mode: str = "append") -> StreamingQuery:
    """Process what is available: ``load(batch, key)`` for each micro-batch that is not committed yet."""

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        key = loads.stream_key(spark, checkpoint, batch_id)
        if not loads.is_committed(spark, out_dir, source_id, key):
            load(batch, key)

    with short_shuffles(df.sparkSession):
        return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def commit_batch(batch: DataFrame, out_dir: str, table: str, key: str, source_id: int = 0, partition_by: str | None = None) -> None:
    """One table's rows as a load of their own."""
    load = loads.begin(out_dir, source_id, key)
    rows = loads.write_counted(batch, load.path(table), partition_by=partition_by)
    loads.commit(batch.sparkSession, load, {table: rows})


#: The table that ``write_batches`` writes below its folder.
STATE = "state"


def write_batches(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is available, each micro-batch a load of its own below ``path``."""
    return load_batches(df, path, checkpoint, lambda batch, key: commit_batch(batch, path, STATE, key), mode=mode)


def read_latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The last state of each key that the update-mode queries below ``path`` have written."""
    order = loads.committed(spark, path).select("load_id", "sequence")
    rows = loads.raw(spark, path, STATE).join(F.broadcast(order), "load_id")  # a row per batch
    values = [c for c in rows.columns if c not in (*keys, "load_id", "sequence")]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*values), "sequence").alias("v"))
        .select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])
    )


def stream_orders(
    orders: DataFrame,
    out_dir: str,
    checkpoint: str,
    mapping: Mapping[str, str] | None = None,
    source_id: int = 0,
) -> StreamingQuery:
    """Explode arriving orders and check the items; one write per batch, split by ``passed``.

    An order whose items cannot be read has no facts; it is quarantined as a whole, with its items
    as they came in ``raw_items``.
    """

    def put(batch: DataFrame, key: str) -> None:
        checked = with_violations(explode_orders(batch, mapping, source_id, tracked=True), "order_items")
        lost = unparsed_orders(batch, mapping, source_id).select(
            F.col("order_id").cast(checked.schema["order_id"].dataType).alias("order_id"),
            "source_id",
            F.col("order_date").cast(checked.schema["sale_date"].dataType).alias("sale_date"),
            "message_id",
            "raw_items",
            F.array("reason").alias("violations"),
        )
        rows = checked.unionByName(lost, allowMissingColumns=True).withColumn("passed", F.size("violations") == 0)
        commit_batch(rows, out_dir, CHECKED_ITEMS, key, source_id, "passed")

    return load_batches(orders, out_dir, checkpoint, put, source_id)


#: The table that ``stream_orders`` writes.
CHECKED_ITEMS = "checked_items"


def read_facts(spark: SparkSession, out_dir: str) -> DataFrame:
    """The items that passed, of all committed batches of all sources."""
    return loads.read(spark, out_dir, CHECKED_ITEMS).filter(F.col("passed").cast("boolean")).drop("passed", "load_id", "violations", "raw_items")


def read_quarantine(spark: SparkSession, out_dir: str) -> DataFrame:
    """The items that failed, with the reasons."""
    return loads.read(spark, out_dir, CHECKED_ITEMS).filter(~F.col("passed").cast("boolean")).drop("passed", "load_id")


#: What the state of the streamed demand is kept by.
DEMAND_KEYS = ("product_id", "sale_date", "order_id", "source_id")


def stream_daily_demand(facts: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Quantity and revenue per product, day and order as facts arrive; run it in update mode.

    Facts of a message that is delivered again within the watermark are taken once; further lines of
    the same product in an order are other items and count. The order stays a key, since a stream
    can sum but not count distinct orders: ``read_demand`` takes them together. Rows later than
    ``lateness`` are dropped and counted by ``LateRows``. What tells deliveries apart is shuffled and
    kept as a digest of 16 bytes, however long the message's id.
    """
    delivery = F.unhex(digest(facts, ["source_id", "order_id", "message_id", "item_no"]))
    found = facts.select("product_id", "sale_date", "order_id", "source_id", "quantity", "gross_sale", delivery.alias("_delivery"))
    unique = found.withWatermark("sale_date", lateness).dropDuplicatesWithinWatermark(["_delivery"])
    days = unique.groupBy("product_id", F.window("sale_date", "1 day").alias("w"), "order_id", "source_id").agg(
        F.sum("quantity").alias("quantity"), F.sum("gross_sale").alias("gross_sale")
    )
    return days.select("product_id", F.to_date("w.start").alias("sale_date"), "order_id", "source_id", "quantity", "gross_sale")


def read_demand(spark: SparkSession, path: str) -> DataFrame:
    """Daily demand from the folders of ``stream_daily_demand``, as ``daily_demand`` gives it."""
    return daily_demand(read_latest(spark, path, DEMAND_KEYS))


class LateRows(StreamingQueryListener):
    """Counts the rows that watermarks drop, over all batches of the session's queries.

    A query's own progress list only holds its last batches.
    """

    def __init__(self) -> None:
        self.by_run: dict[str, int] = {}
        self.ended: dict[str, threading.Event] = defaultdict(threading.Event)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        late = sum(int(op.numRowsDroppedByWatermark) for op in event.progress.stateOperators)
        run = str(event.progress.runId)
        self.by_run[run] = self.by_run.get(run, 0) + late

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.runId)].set()

    def total(self, query: StreamingQuery, timeout: float = 60) -> int:
        """Rows dropped over the whole run of a query that has ended."""
        if not self.ended[str(query.runId)].wait(timeout):
            raise TimeoutError("the query's last events have not come")
        return self.by_run.get(str(query.runId), 0)


def stream_metric_cache(
    events: DataFrame,
    bucket: str = "1 hour",
    lateness: str = "1 day",
    ts: str = "ts",
    metric: str = "event_type",
    value: str = "value",
) -> DataFrame:
    """Count and sum per metric and tumbling bucket; run it in update mode."""
    return (
        events.withWatermark(ts, lateness)
        .groupBy(F.window(ts, bucket).alias("w"), name_col(metric).alias("metric_name"))
        .agg(F.count(F.lit(1)).alias("event_count"), F.sum(name_col(value)).alias("metric_value"))
        .select("metric_name", F.col("w.start").alias("bucket_start"), "event_count", "metric_value")
    )


def stream_sync(
    orders: DataFrame,
    out_dir: str,
    checkpoint: str,
    mapping: Mapping[str, str] | None = None,
    source_id: int = 0,
) -> StreamingQuery:
    """The incremental order load with the checkpoint as the mark: every file is loaded once.

    With a new checkpoint the source is loaded anew; its messages are in the tables already and
    count once there. The demand table is brought up to date once, when ``finish`` has seen the run
    end, and not by each batch, which would read all facts of its months. Till then, or if the run
    stops half way, readers make up for the batches that are loaded, and the next run takes them in.
    """
    spark = orders.sparkSession
    query = load_batches(orders, out_dir, checkpoint, lambda batch, key: load_orders(batch, out_dir, mapping, source_id, key, refresh=False), source_id)
    setattr(query, AT_END, lambda: refresh(spark, out_dir))
    return query


def open_alerts(spark: SparkSession, ledger: str, before_batch: int | None = None) -> DataFrame:
    """Product ids with an unresolved alert in the ledger, optionally of earlier batches only."""
    if not path_exists(spark, ledger):  # nothing written yet
        return spark.createDataFrame([], "product_id int")
    rows = spark.read.option("basePath", ledger).parquet(ledger)
    if before_batch is not None:
        rows = rows.filter(F.col("batch_id") < before_batch)
    return rows.filter(~F.col("is_resolved")).select("product_id").distinct()


def claim(spark: SparkSession, folder: str, owner: str) -> None:
    """Note a folder's owner beside it; raises if it has another one."""
    path = f"{folder}.owner"
    if not path_exists(spark, path):
        spark.createDataFrame([(owner,)], "owner string").coalesce(1).write.mode("error").parquet(path)
    known = spark.read.parquet(path).first()["owner"]
    if known != owner:
        raise ValueError(f"{folder} belongs to another query ({known}); give this one a folder of its own")


def stream_alerts(sales: DataFrame, products: DataFrame, ledger: str, checkpoint: str) -> StreamingQuery:
    """Spike alerts on arriving sales, one open alert per product.

    The ledger itself is the state: a product whose alert was resolved can raise a new one, and a
    replayed batch only looks at the batches before it. The batches of one query are the ledger's
    history, so another query cannot write to it.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        claim(spark, ledger, loads.stream_key(spark, checkpoint, 0))
        new = emit_alerts(anomaly_scan(batch, products)).select(*LEDGER_FIELDS)
        known = open_alerts(spark, ledger, batch_id)
        new.join(known, on="product_id", how="left_anti").select(*LEDGER_FIELDS).write.mode("overwrite").parquet(
            f"{ledger}/batch_id={batch_id}"
        )

    return (
        sales.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(put)
        .start()
    )
