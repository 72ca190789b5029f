"""Registered queries: the streaming jobs, run over what is available."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom.operators import orders as O
from demandloom.plans import views as V
from demandloom.plans.queries_decisions import HITS_SQL, MESSAGE
from demandloom.plans.queries_orders import DEMAND_SQL, ITEM_SQL, _demand_shown, _shown
from demandloom.plans.registry import query
from demandloom.session import scratch_path
from demandloom.streaming import alert_state as S
from demandloom.streaming import jobs as J


def _order_stream(spark, sf):
    files = V.files_for(spark, sf, "lineitem", 4)
    folder = V.folder_of(spark, V.order_feed(spark, sf), "order-feed", files, 4)
    return J.file_stream(spark, folder, max_files=V.half_of(spark, folder))


@query("stream_orders", ITEM_SQL + " WHERE sale_date IS NOT NULL", ["items"])
def stream_orders(spark, sf):
    out = scratch_path(spark, "stream-orders")
    J.finish(J.stream_orders(_order_stream(spark, sf), out, scratch_path(spark, "ckpt"), V.FEED_MAPPING, 7))
    facts = J.read_facts(spark, out).drop("message_id", "item_no")
    return facts.withColumns(
        {
            "gross_sale": F.round("gross_sale", 4),
            "net_sale": F.round("net_sale", 4),
            "sale_date": F.date_format("sale_date", "yyyy-MM-dd"),
            "order_id": F.col("order_id").cast("bigint"),
        }
    )


@query(
    "stream_quarantine",
    "SELECT CAST(l_orderkey AS VARCHAR) AS order_id, 'quantity:non_negative' AS violations FROM lineitem WHERE l_linenumber = 1",
)
def stream_quarantine(spark, sf):
    """Every first line arrives with a negative quantity."""
    li = V.table(spark, sf, "lineitem")
    quantity = F.when(F.col("l_linenumber") == 1, -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    item = F.struct(F.col("l_partkey").alias("product_id"), quantity.alias("quantity"), F.col("l_extendedprice").alias("unit_price"))
    rows = li.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_shipdate").alias("order_date"), F.to_json(F.array(item)).alias("items")
    )
    folder = V.folder_of(spark, rows, "returns", V.files_for(spark, sf, "lineitem", 2))
    out = scratch_path(spark, "stream-quarantine")
    J.finish(J.stream_orders(J.file_stream(spark, folder), out, scratch_path(spark, "ckpt")))
    failed = J.read_quarantine(spark, out)
    return failed.select("order_id", F.array_join("violations", ",").alias("violations"))


@query(
    "stream_dead_letters",
    """SELECT CAST(l_orderkey AS VARCHAR) AS order_id, strftime(o_orderdate, '%Y-%m-%d') AS sale_date, 'items:json_array' AS violations, TRUE AS has_items
       FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber IN (4, 7)""",
)
def stream_dead_letters(spark, sf):
    """Orders whose items cannot be read are quarantined as a whole."""
    out = scratch_path(spark, "stream-orders")
    J.finish(J.stream_orders(_order_stream(spark, sf), out, scratch_path(spark, "ckpt"), V.FEED_MAPPING, 7))
    lost = J.read_quarantine(spark, out)
    return lost.select(
        F.col("order_id").cast("string").alias("order_id"),
        F.date_format("sale_date", "yyyy-MM-dd").alias("sale_date"),
        F.array_join("violations", ",").alias("violations"),
        F.col("raw_items").isNotNull().alias("has_items"),
    )


@query(
    "stream_daily_demand",
    """SELECT product_id, strftime(d, '%Y-%m-%d') AS sale_date, round(sum(q), 4) AS total_qty, round(sum(v), 2) AS total_revenue, count(DISTINCT ord) AS order_count
       FROM (SELECT DISTINCT l_orderkey // 3 AS ord, l_orderkey, l_linenumber, l_partkey AS product_id, CAST(l_shipdate AS DATE) AS d, l_quantity AS q, l_extendedprice AS v
             FROM lineitem) GROUP BY 1, 2""",
)
def stream_daily_demand(spark, sf):
    """Every line arrives twice, in order of time; three order keys make one order, so that an order has
    several lines of one product."""
    li = V.table(spark, sf, "lineitem")
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity"]
    rows = li.select(
        F.floor(F.col("l_orderkey") / 3).alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.lit(1).alias("source_id"),
        F.concat_ws("/", *key).alias("message_id"),
        F.lit(0).alias("item_no"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("gross_sale"),
        F.col("l_shipdate").alias("sale_date"),
    )
    folder, out, ckpt = (scratch_path(spark, name) for name in ("facts", "stream-demand", "ckpt"))
    files = V.files_for(spark, sf, "lineitem")
    year = F.year("sale_date")
    for low, high in ((None, 1997), (1997, 1999), (1999, None)):  # a run each, the next one later in time
        part = rows.filter((F.lit(True) if low is None else year >= low) & (F.lit(True) if high is None else year < high))
        V.write_files(spark, part.unionAll(part), folder, files, 1)
        with S.rocks_state(spark):
            J.finish(J.write_batches(J.stream_daily_demand(J.file_stream(spark, folder), "2 days"), out, ckpt, "update"))
    return _demand_shown(J.read_demand(spark, out))


def _metric_sql(unit: str) -> str:
    return f"""SELECT event_type AS metric_name, strftime(date_trunc('{unit}', ts), '%Y-%m-%d %H:%M') AS bucket_start, count(*) AS event_count,
        round(sum(value), 4) AS metric_value FROM events GROUP BY 1, 2"""


def _metric_cache(spark, sf, bucket):
    out = scratch_path(spark, "metrics")
    files = V.files_for(spark, sf, "events", 2)
    folder = V.folder_of(spark, V.events(spark, sf), "events", files)
    metrics = J.stream_metric_cache(J.file_stream(spark, folder, max_files=files // 2), bucket, lateness="60 days")
    J.finish(J.write_batches(metrics, out, scratch_path(spark, "ckpt"), "update"))
    state = J.read_latest(spark, out, ["metric_name", "bucket_start"])
    return state.select(
        "metric_name",
        F.date_format("bucket_start", "yyyy-MM-dd HH:mm").alias("bucket_start"),
        "event_count",
        F.round("metric_value", 4).alias("metric_value"),
    )


@query("stream_metric_cache_hourly", _metric_sql("hour"))
def stream_metric_cache_hourly(spark, sf):
    return _metric_cache(spark, sf, "1 hour")


@query("stream_metric_cache_daily", _metric_sql("day"))
def stream_metric_cache_daily(spark, sf):
    return _metric_cache(spark, sf, "1 day")


@query("stream_sync", DEMAND_SQL, ["items"])
def stream_sync(spark, sf):
    out = scratch_path(spark, "stream-sync")
    J.finish(J.stream_sync(_order_stream(spark, sf), out, scratch_path(spark, "ckpt"), V.FEED_MAPPING, 7))
    return _demand_shown(O.read_loaded(spark, out, "agg_daily_demand"))


SOURCES_SQL = ITEM_SQL.replace("7 AS source_id", "CASE WHEN ord % 2 = 0 THEN 1 ELSE 2 END AS source_id")


def _two_sources(spark, sf):
    """(source, its messages): even orders come from source 1, odd ones from source 2, and source 1 begins anew once."""
    feed = V.order_feed(spark, sf)
    files = V.files_for(spark, sf, "lineitem", 2)
    folders = {source: V.folder_of(spark, feed.filter(F.col("ord") % 2 == source - 1), f"source-{source}", files, 2) for source in (1, 2)}
    return [(source, J.file_stream(spark, folders[source], max_files=V.half_of(spark, folders[source]))) for source in (1, 2, 1)]


@query("stream_sync_two_sources", SOURCES_SQL, ["items"])
def stream_sync_two_sources(spark, sf):
    """Two sources, one of them twice under different checkpoints, into one folder."""
    out = scratch_path(spark, "stream-sync")
    for source, stream in _two_sources(spark, sf):
        J.finish(J.stream_sync(stream, out, scratch_path(spark, "ckpt"), V.FEED_MAPPING, source))
    return _shown(O.read_loaded(spark, out, "fact_sales"))


@query("stream_sync_two_sources_demand", DEMAND_SQL, ["items"])
def stream_sync_two_sources_demand(spark, sf):
    out = scratch_path(spark, "stream-sync")
    for source, stream in _two_sources(spark, sf):
        J.finish(J.stream_sync(stream, out, scratch_path(spark, "ckpt"), V.FEED_MAPPING, source))
    return _demand_shown(O.read_loaded(spark, out, "agg_daily_demand"))


@query("stream_orders_two_sources", SOURCES_SQL + " WHERE sale_date IS NOT NULL", ["items"])
def stream_orders_two_sources(spark, sf):
    """Both sources' items that passed; those of the source that begins anew count once by message and item."""
    out = scratch_path(spark, "stream-orders")
    for source, stream in _two_sources(spark, sf):
        J.finish(J.stream_orders(stream, out, scratch_path(spark, "ckpt"), V.FEED_MAPPING, source))
    return _shown(O.once(J.read_facts(spark, out)).drop("message_id", "item_no")).withColumn("order_id", F.col("order_id").cast("bigint"))


@query(
    "stream_alerts",
    f"WITH {HITS_SQL} SELECT product_id, CASE WHEN quantity > 100 THEN 'critical' ELSE 'warning' END AS severity, {MESSAGE} AS message FROM hits",
    ["products", "sales"],
)
def stream_alerts(spark, sf):
    """All sales in one batch, so the first alert is the earliest spike."""
    big = F.when(F.col("line_no") == 7, F.col("quantity") * 4).otherwise(F.col("quantity"))
    folder = V.folder_of(spark, V.sales(spark, sf).withColumn("quantity", big), "sales", V.files_for(spark, sf, "lineitem", 3))
    ledger = scratch_path(spark, "alerts")
    products = V.with_shifted_key(V.products(spark, sf), "id", 10, 4)
    J.finish(J.stream_alerts(J.file_stream(spark, folder), products, ledger, scratch_path(spark, "ckpt")))
    return spark.read.parquet(ledger).select("product_id", "severity", "message")


REARMED_SQL = f"""WITH spikes AS (
    SELECT s.product_id, s.ds, s.order_id, s.line_no, s.quantity * CASE WHEN line_no = 7 THEN 4 ELSE 1 END AS quantity
    FROM sales s LEFT JOIN (SELECT * REPLACE (CASE WHEN id % 10 = 4 THEN id + 1000000000 ELSE id END AS id) FROM products) p ON s.product_id = p.id
    WHERE s.quantity * CASE WHEN line_no = 7 THEN 4 ELSE 1 END > coalesce(p.safety_stock, 20) * 3),
eras AS (SELECT *, product_id % 2 = 0 AND ds > TIMESTAMP '1995-06-30' AS later FROM spikes),
alerts AS (SELECT *, row_number() OVER (PARTITION BY product_id, later ORDER BY ds, order_id, line_no, quantity) AS rn FROM eras)
SELECT product_id, strftime(ds, '%Y-%m-%d') AS ds, CASE WHEN quantity > 100 THEN 'critical' ELSE 'warning' END AS severity, {MESSAGE} AS message,
       product_id % 2 = 0 AND NOT later AS is_resolved
FROM alerts WHERE rn = 1"""


@query("stream_alerts_rearmed", REARMED_SQL, ["products", "sales"])
def stream_alerts_rearmed(spark, sf):
    """All sales in order of time; the alerts of even products are resolved in the middle, after which a spike opens another."""
    big = F.when(F.col("line_no") == 7, F.col("quantity") * 4).otherwise(F.col("quantity"))
    sales = V.sales(spark, sf).withColumn("quantity", big)
    middle = F.to_timestamp_ntz(F.lit("1995-06-30 00:00:00"))
    folder, closing, out, ckpt = (scratch_path(spark, name) for name in ("sales", "resolutions", "alerts", "ckpt"))
    files = V.files_for(spark, sf, "lineitem")
    products = V.products(spark, sf).filter("id % 2 = 0").select(F.col("id").alias("product_id"), middle.alias("resolved_at"))
    products.write.parquet(closing)
    known = V.with_shifted_key(V.products(spark, sf), "id", 10, 4)
    for part in (F.col("ds") <= middle, (F.col("ds") > middle) & (F.year("ds") < 1997), F.year("ds") >= 1997):  # a run each
        sales.filter(part).repartition(files).write.mode("append").parquet(folder)
        J.finish(S.stream_alert_events(J.file_stream(spark, folder), known, out, ckpt, J.file_stream(spark, closing)))
    found = S.alert_ledger(spark, out)
    return found.select("product_id", F.date_format("alert_ts", "yyyy-MM-dd").alias("ds"), "severity", "message", "is_resolved")
