import datetime as dt

import pytest
from tests.conftest import rows
from pyspark.sql import functions as F

from demandloom.operators import orders as O
from demandloom.operators.alerts import anomaly_scan, resolve_alerts
from demandloom.sources import ledger
from demandloom.streaming import alert_state as S
from demandloom.streaming import jobs as J


def write(df, path):
    df.coalesce(1).write.mode("append").parquet(str(path))


def orders(spark, ids, day=1, quantity=2):
    item = f'[{{"product_id": 5, "quantity": {quantity}, "unit_price": 3}}]'
    return spark.createDataFrame([(i, dt.datetime(2024, 1, day), "c", item) for i in ids], "order_id string, order_date timestamp, customer_id string, items string")


def test_orders_arrive_once(spark, tmp_path):
    src, out, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    write(orders(spark, ["a", "b"]), src)
    J.finish(J.stream_orders(J.file_stream(spark, src), out, ckpt))
    write(orders(spark, ["c"], quantity=-1), src)
    for _ in range(2):
        J.finish(J.stream_orders(J.file_stream(spark, src), out, ckpt))
    assert rows(J.read_facts(spark, out), "order_id") == [("a",), ("b",)]
    bad = J.read_quarantine(spark, out).collect()
    assert [(r["order_id"], r["violations"]) for r in bad] == [("c", ["quantity:non_negative"])]


def test_demand_equals_batch_and_late_rows_are_dropped(spark, tmp_path):
    """An order with two lines of one product, a message delivered twice, and a late row."""
    src, out, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    schema = "order_id string, product_id string, source_id int, message_id string, item_no int, quantity double, gross_sale double, sale_date timestamp"

    def facts(*data):
        return spark.createDataFrame([(o, "p", 1, o + str(h), n, q, q * 2, dt.datetime(2024, 1, d, h)) for o, n, q, d, h in data], schema)

    early = facts(("a", 0, 1.0, 1, 3), ("a", 1, 5.0, 1, 3), ("b", 0, 2.0, 1, 9), ("a", 0, 1.0, 1, 3), ("c", 0, 4.0, 2, 1), ("c", 0, 3.0, 2, 2))
    listener = J.LateRows()
    spark.streams.addListener(listener)
    try:
        write(early, src)
        run = lambda: J.finish(J.write_batches(J.stream_daily_demand(J.file_stream(spark, src), "2 days"), out, ckpt, "update"))
        run()
        expected = rows(O.daily_demand(early.dropDuplicates()))
        assert rows(J.read_demand(spark, out)) == expected
        assert [r[2:] for r in expected] == [(8.0, 16.0, 2), (7.0, 14.0, 1)]
        write(facts(("d", 0, 1.0, 20, 0)), src)
        run()
        write(facts(("late", 0, 9.0, 1, 5), ("e", 0, 1.0, 20, 1)), src)
        assert listener.total(run()) == 1
    finally:
        spark.streams.removeListener(listener)
    got = {str(r["sale_date"]): r["total_qty"] for r in J.read_demand(spark, out).collect()}
    assert got == {"2024-01-01": 8.0, "2024-01-02": 7.0, "2024-01-20": 2.0}


def test_unreadable_orders_are_quarantined(spark, tmp_path):
    src, out, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    write(orders(spark, ["a"]).union(orders(spark, ["b"]).withColumn("items", F.lit("[{"))), src)
    J.finish(J.stream_orders(J.file_stream(spark, src), out, ckpt))
    assert J.read_facts(spark, out).count() == 1
    assert [(r["order_id"], r["violations"], r["raw_items"]) for r in J.read_quarantine(spark, out).collect()] == [("b", [O.UNPARSED], "[{")]


def test_sync_loads_each_file_once(spark, tmp_path):
    src, out, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    write(orders(spark, ["a"]), src)
    J.finish(J.stream_sync(J.file_stream(spark, src), out, ckpt))
    write(orders(spark, ["b"]), src)
    for _ in range(2):
        J.finish(J.stream_sync(J.file_stream(spark, src), out, ckpt))
    assert rows(O.read_loaded(spark, out, "fact_sales"), "order_id") == [("a",), ("b",)]
    assert O.read_loaded(spark, out, "agg_daily_demand").first()["order_count"] == 2


def test_one_open_alert_per_product(spark, tmp_path):
    src, ledger, ckpt = str(tmp_path / "in"), str(tmp_path / "ledger"), str(tmp_path / "ckpt")
    products = spark.createDataFrame([(1, 10), (2, 10)], "id int, safety_stock int")

    def sell(*data):
        write(spark.createDataFrame([(p, dt.datetime(2024, 1, d), float(q)) for p, d, q in data], "product_id int, ds timestamp, quantity double"), src)
        J.finish(J.stream_alerts(J.file_stream(spark, src), products, ledger, ckpt))

    sell((1, 1, 50), (1, 2, 200), (2, 1, 5))
    sell((1, 3, 60), (2, 2, 40))
    assert rows(spark.read.parquet(ledger), "product_id", "severity") == [(1, "warning"), (2, "warning")]
    assert rows(J.open_alerts(spark, ledger)) == [(1,), (2,)]
    # resolving re-arms the product
    first = spark.read.parquet(f"{ledger}/batch_id=0")
    resolved = spark.createDataFrame(resolve_alerts(first).collect(), first.schema)
    resolved.write.mode("overwrite").parquet(f"{ledger}/batch_id=0")
    sell((1, 5, 70))
    assert rows(spark.read.parquet(ledger).filter("not is_resolved"), "product_id") == [(1,), (2,)]


def test_alerts_rearm_from_the_state_store(spark, tmp_path):
    """One open alert per product over batches and restarts; a resolution lets the next spike open another."""
    src, closing, out, ckpt = (str(tmp_path / n) for n in ("in", "closing", "out", "ckpt"))
    products = spark.createDataFrame([(1, 10), (2, 10)], "id int, safety_stock int")
    sale = "product_id int, ds timestamp, order_id int, line_no int, quantity double"

    def run(sales, resolved):
        write(spark.createDataFrame([(p, dt.datetime(2024, 1, d), d, 1, float(q)) for p, d, q in sales], sale), src)
        write(spark.createDataFrame([(p, dt.datetime(2024, 1, d)) for p, d in resolved], "product_id int, resolved_at timestamp"), closing)
        J.finish(S.stream_alert_events(J.file_stream(spark, src), products, out, ckpt, J.file_stream(spark, closing)))
        return sorted((r["product_id"], r["alert_ts"].day, r["is_resolved"], r["severity"]) for r in S.alert_ledger(spark, out).collect())

    assert run([(1, 2, 50), (1, 1, 200), (2, 1, 5)], []) == [(1, 1, False, "critical")]
    assert run([(1, 3, 60), (2, 2, 40)], []) == [(1, 1, False, "critical"), (2, 2, False, "warning")]
    # the spike of day 4 is dealt with by the resolution of day 5, that of day 6 opens another alert
    assert run([(1, 6, 70), (1, 4, 80)], [(1, 5), (2, 1)]) == [(1, 1, True, "critical"), (1, 6, False, "warning"), (2, 2, False, "warning")]
    assert run([(2, 9, 1)], [(2, 8), (2, 8)]) == [(1, 1, True, "critical"), (1, 6, False, "warning"), (2, 2, True, "warning")]
    assert run([(2, 7, 99)], []) == [(1, 1, True, "critical"), (1, 6, False, "warning"), (2, 2, True, "warning")]
    ids = [r["alert_id"] for r in S.alert_ledger(spark, out).collect()]
    assert len(set(ids)) == 3


def test_spikes_of_one_instant_are_ordered(spark, tmp_path):
    """Of several spikes at one time the first by order, line and quantity opens the alert, missing orders first."""
    products = spark.createDataFrame([(p, 10) for p in range(1, 5)], "id int, safety_stock int")
    noon = dt.datetime(2024, 1, 1, 12)
    data = [(1, noon, 9, 1, 200.0), (1, noon, 3, 2, 50.0), (1, noon, 3, 1, 60.0), (2, noon, 1, 1, 200.0), (2, noon, None, 5, 40.0),
            (3, noon, 1, 1, 90.0), (3, noon, 1, 1, 80.0), (4, noon, None, None, 70.0), (4, noon, None, 1, 300.0)]
    sales = spark.createDataFrame(data, "product_id int, ds timestamp, order_id int, line_no int, quantity double")
    write(sales, tmp_path / "in")
    out = str(tmp_path / "out")
    J.finish(S.stream_alert_events(J.file_stream(spark, str(tmp_path / "in")), products, out, str(tmp_path / "ckpt")))
    got = rows(S.alert_ledger(spark, out), "product_id", "message")
    assert got == rows(anomaly_scan(sales, products), "product_id", "message")
    assert [m.split("(")[1] for _, m in got] == ["60.0 units).", "40.0 units).", "80.0 units).", "70.0 units)."]


def test_sources_share_a_folder(spark, tmp_path):
    """Two sources, a new checkpoint of one, and a load that died before its entry."""
    out = str(tmp_path / "out")
    for source, ids in ((1, ["a", "b"]), (2, ["a", "c"])):
        write(orders(spark, ids), tmp_path / f"in{source}")
    for source, ckpt in ((1, "x"), (2, "y"), (1, "z")):
        J.finish(J.stream_sync(J.file_stream(spark, str(tmp_path / f"in{source}")), out, str(tmp_path / ckpt), source_id=source))
        J.finish(J.stream_orders(J.file_stream(spark, str(tmp_path / f"in{source}")), out, str(tmp_path / f"o{ckpt}"), source_id=source))
    every = [("a", 1), ("a", 2), ("b", 1), ("c", 2)]
    assert rows(O.read_loaded(spark, out, "fact_sales"), "order_id", "source_id") == every
    assert sorted({(r["order_id"], r["source_id"]) for r in J.read_facts(spark, out).collect()}) == every
    demand = O.read_loaded(spark, out, "agg_daily_demand").first()
    assert (demand["total_qty"], demand["order_count"]) == (8.0, 3)
    dead = ledger.begin(out, 3)
    O.explode_orders(orders(spark, ["lost"]), source_id=3, tracked=True).withColumn("month_no", F.lit(202401)).write.partitionBy("month_no").parquet(dead.path("fact_sales"))
    assert rows(O.read_loaded(spark, out, "fact_sales"), "order_id", "source_id") == every
    with pytest.raises(ValueError, match="another query"):
        J.claim(spark, str(tmp_path / "alerts"), "one")
        J.claim(spark, str(tmp_path / "alerts"), "two")


def test_kafka_messages_parse(spark):
    from demandloom.sources.readers import parse_json_values

    raw = spark.createDataFrame([(b'{"order_id": "a", "n": {"x": 1}}',), (b"junk",)], "value binary")
    got = parse_json_values(raw, "order_id string, n struct<x int>").select("order_id", F.col("n.x").alias("x"))
    assert rows(got) == [("a", 1), (None, None)]
    kept = parse_json_values(raw, "order_id string, n struct<x int>", malformed_col="bad").select("order_id", "bad")
    assert rows(kept) == [("a", None), (None, "junk")]
