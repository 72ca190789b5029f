"""How loads are read and summed at size: no shuffle by load, one of the facts, files by the number of rows."""

import datetime as dt

from pyspark.sql import functions as F
from tests.conftest import plan_text, rows

from demandloom import session
from demandloom.operators import demand as D
from demandloom.operators import orders as O
from demandloom.operators import sync as Y
from demandloom.plans import views as V
from demandloom.sources import ledger
from demandloom.streaming import jobs as J

FACT = "order_id string, source_id int, product_id string, quantity double, gross_sale double, sale_date timestamp, message_id string, item_no int"


def facts(spark):
    """Orders with several lines of a product, re-deliveries, one order in two sources, and missing keys."""
    day, late = dt.datetime(2024, 1, 1, 3), dt.datetime(2024, 1, 1, 23)
    data = [
        ("a", 1, "p", 1.0, 2.0, day, "m1", 0),
        ("a", 1, "p", 1.0, 2.0, day, "m1", 0),  # again
        ("a", 1, "p", 5.0, 7.0, day, "m1", 1),
        ("a", 2, "p", 1.0, 2.0, day, "m1", 0),  # another source, the same order
        ("a", 1, "p", 2.0, 2.0, late, "m2", 0),
        ("b", 1, "p", None, None, day, "m3", 0),
        (None, 1, "p", 4.0, 4.0, day, "m4", 0),
        (None, 1, "q", 4.0, 4.0, day, "m5", 0),
        ("c", 1, None, 4.0, 4.0, day, "m6", 0),
        ("d", 1, "p", 4.0, 4.0, None, "m7", 0),
        ("a", 1, "p", 3.0, 3.0, dt.datetime(2024, 2, 1), "m8", 0),
    ]
    return spark.createDataFrame(data, FACT)


def test_demand_with_one_shuffle_of_the_facts(spark):
    given = facts(spark).withColumn("touched", F.lit(True))
    got = D.demand_once(given)
    assert rows(got, *D.KEY, *D.VALUES) == rows(D.daily_demand(D.once(given)))
    plan = plan_text(got)
    assert plan.count("hashpartitioning(order_id") == 1 and plan.count("hashpartitioning(") == 2


def test_keys_of_replaced_loads_without_facts_are_null(spark):
    gone = spark.createDataFrame([("p", dt.date(2024, 1, 1)), ("x", dt.date(2024, 1, 1))], "product_id string, day date")
    got = {r["product_id"]: r for r in D.demand_once(facts(spark).filter("sale_date < '2024-02-01'").withColumn("touched", F.lit(False)), gone).collect()}
    assert [(k, got[k]["touched"]) for k in sorted(got)] == [("p", True), ("q", False), ("x", True)]
    assert (got["p"]["total_qty"], got["p"]["order_count"]) == (13.0, 2)
    assert (got["x"]["total_qty"], got["x"]["total_revenue"], got["x"]["order_count"]) == (None, None, None)


def test_loads_are_read_without_a_shuffle_by_load(spark, tmp_path, monkeypatch):
    out = str(tmp_path)
    for key in ("a", "b", "a"):
        J.commit_batch(spark.createDataFrame([(key, 1.0)], "k string, v double"), out, J.STATE, key)
    lost = ledger.begin(out, 0, "lost")
    spark.createDataFrame([("lost", 1.0)], "k string, v double").write.parquet(lost.path(J.STATE))
    for most in (ledger.NAMED_LOADS, 1):
        monkeypatch.setattr(ledger, "NAMED_LOADS", most)
        found = ledger.read(spark, out, J.STATE)
        assert rows(found, "k") == [("a",), ("b",)]
        assert "hashpartitioning(load_id" not in plan_text(found)
    assert "hashpartitioning(load_id" not in plan_text(J.read_latest(spark, out, ["k"]))


def test_files_grow_with_the_rows(spark, sf, monkeypatch):
    many = V.table(spark, sf, "lineitem").count()
    assert V.files_for(spark, sf, "lineitem", 4) == 4
    monkeypatch.setattr(V, "ROWS_PER_FILE", 1000)
    assert V.files_for(spark, sf, "lineitem", 4) == 4 * -(-many // 4000)


def test_the_feed_is_joined_before_its_texts_are_made(spark, tmp_path):
    """The shuffle holds the numbers of a line; its JSON text comes after."""
    spark.sql("SELECT 1L AS l_orderkey, 2 AS l_linenumber, 3L AS l_partkey, 4D AS l_quantity, 5.5D AS l_extendedprice, 0.1D AS l_discount").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT 1L AS o_orderkey, 6L AS o_custkey, 'O' AS o_orderstatus, 9D AS o_totalprice, DATE'2024-01-01' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    feed = V.order_feed(spark, str(tmp_path))
    assert feed.columns == ["ord", "line_no", "lines", "cust", "state", "total", "placed"]
    lines = '[{"sku": 3, "qty": 4.0, "price": "5.5", "off": 0.1}, {"sku": "gift", "qty": 1, "price": null}]'
    assert rows(feed) == [(1, 2, lines, 6, "O", 9.0, dt.date(2024, 1, 1))]
    after, before = feed._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)
    assert '{"sku": ' in after and '{"sku": ' not in before


def test_digests_are_shuffled_as_bytes(spark):
    hex_id, other = "0123456789abcdef" * 2, "z" * 32
    ids = spark.createDataFrame([(hex_id,), (other,), ("41",), ("A",), (None,)], "message_id string")
    got = [None if r[0] is None else bytes(r[0]) for r in ids.select(D._short(F.col("message_id"))).collect()]
    assert got == [bytes.fromhex(hex_id), other.encode(), b"41", b"A", None]


def test_files_of_a_kept_frame_have_few_rows(spark, monkeypatch):
    """A task takes some files at most, so its rows are bounded however well they compress."""
    monkeypatch.setattr(session, "FILE_ROWS", 100)
    with session.materialize(spark.range(0, 1000, 1, 1), "kept") as kept:
        assert len(kept.inputFiles()) == 10 and kept.count() == 1000


def test_rows_of_a_task_are_bounded_by_their_number(spark, monkeypatch):
    """Facts are dealt out by how many there are, not by how well they compress, and sorted by their digests."""
    monkeypatch.setattr(session, "TASK_ROWS", 4)
    given = facts(spark)
    assert session.parts_for(0) == 1 and session.parts_for(given.count()) == 3
    got = D.once_spread(given, "item_no")
    key = [*D.MESSAGE_KEY, "item_no"]
    assert got.columns == given.columns and rows(got, *key) == rows(D.once(given), *key)
    assert "_message" in plan_text(got) and ", 3), REPARTITION_BY_NUM" in plan_text(got)
    dealt = D.demand_once(given.withColumn("touched", F.lit(True)), None, 3)
    assert rows(dealt, *D.KEY, *D.VALUES) == rows(D.daily_demand(D.once(given)))
    assert ", 3), REPARTITION_BY_NUM" in plan_text(dealt)


def test_a_sync_reads_its_source_once(spark, tmp_path):
    seen, out, schema = spark.sparkContext.accumulator(0), str(tmp_path), "order_id string, day int, items string"

    @F.udf("timestamp")
    def date(day):
        seen.add(1)
        return day and dt.datetime(2024, 1, day)

    marks = spark.createDataFrame([], Y.MARK_SCHEMA)
    data = [("a", 1, "[]"), ("b", 2, "[]"), ("u", None, "[]")]
    for number, more in enumerate(([], [("c", 1, "[]"), ("c", 1, "[]"), ("d", 3, "[]")], [])):
        data += more
        before = seen.value
        counts, marks = Y.incremental_sync(spark.createDataFrame(data, schema).select("order_id", date("day").alias("order_date"), "items"), marks, 1, out)
        assert seen.value - before == len(data)
        assert {r["table"]: r["rows"] for r in counts.collect()}["orders_backlog"] == [2, 3, 0][number]


def test_messages_not_loaded_yet(spark, tmp_path):
    """All are new, some (told by a join with the new digests), or none."""
    out, schema = str(tmp_path), "order_id string, order_date timestamp, items string"
    frame = lambda names: spark.createDataFrame([(n, dt.datetime(2024, 1, 1), "[]") for n in names], schema)
    O.load_orders(frame("ab"), out, source_id=1)
    for given, left in (("ccd", "ccd"), ("abccb", "cc"), ("aab", "")):
        with Y.not_loaded(frame(given), out, "orders_backlog", 1, {}) as found:
            assert (found is None) == (not left) and (found is None or rows(found, "order_id") == [(c,) for c in left])
    with Y.not_loaded(frame("ab"), out, "orders_backlog", 2, {}) as found:
        assert found.count() == 2  # another source's


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}


def test_shuffles_go_with_their_job(spark, tmp_path):
    """What is in files needs no shuffle any more; the setting is as before afterwards."""
    before, there = spark.conf.get(session.CLEANUP, None), shuffle_files(spark)
    summed = spark.range(0, 1000, 1, 4).groupBy((F.col("id") % 7).alias("k")).count()
    with session.materialize(summed, "sums") as kept:
        assert not shuffle_files(spark) - there
        assert kept.count() == 7
    there = shuffle_files(spark)
    assert ledger.write_counted(summed, f"{tmp_path}/sums") == 7 and not shuffle_files(spark) - there
    assert spark.conf.get(session.CLEANUP, None) == before


def test_the_backlog_gives_the_other_tables(spark, tmp_path, monkeypatch):
    """With items as text and no customer details the source is not kept beside the backlog; the tables are the same."""
    item = '[{"sku": 1, "qty": "2", "price": 3, "off": 1}, {"sku": 2, "price": "x"}]'
    data = [("a", dt.datetime(2024, 1, 1), 7, item), ("a", dt.datetime(2024, 1, 1), 7, item), ("b", None, None, item), (None, dt.datetime(2024, 2, 1), 7, "[]"),
            ("c", dt.datetime(2023, 2, 1), 7, "[{"), ("d", dt.datetime(2024, 2, 1), 8, '{"sku": 1}'), ("e", dt.datetime(2024, 2, 1), 9, None)]
    names = {"order_id": "ord", "order_date": "placed", "customer_id": "cust", "items_column": "lines", "product_id": "sku", "quantity": "qty", "unit_price": "price", "discount": "off"}
    df = spark.createDataFrame(data, "ord string, placed timestamp, cust int, lines string")
    plain, detailed = f"{tmp_path}/plain", f"{tmp_path}/detailed"
    wanted = O.load_orders(df.withColumn("customer_email", F.lit(None).cast("string")), detailed, names, 3)
    monkeypatch.setattr(O, "materialize", None)
    got = O.load_orders(df, plain, names, 3)
    assert rows(got) == rows(wanted)
    for table in O.LOAD_TABLES:
        assert rows(O.read_loaded(spark, plain, table)) == rows(O.read_loaded(spark, detailed, table))
    assert [r[0] for r in rows(O.read_loaded(spark, plain, "dead_letters"), "order_id")] == ["c", "d"]
    facts = O.read_loaded(spark, plain, "fact_sales")
    assert facts.columns == ["order_id", "source_id", "product_id", "quantity", "unit_price", "discount", "gross_sale", "net_sale", "sale_date"]
    assert rows(facts.filter("product_id = '1' AND order_id = 'a'"), "gross_sale", "net_sale") == [(6.0, 5.0)]
    scans = [line for line in plan_text(facts).splitlines() if line.startswith("ReadSchema")]
    assert scans and not any("gross_sale" in line or "net_sale" in line for line in scans)


def test_a_run_makes_one_version_of_the_demand(spark, tmp_path):
    """Each file is a batch; the demand is brought up to date when the run ends, and can be read before."""
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    frame = spark.createDataFrame([(str(i), dt.datetime(2024, 1, 1), '[{"product_id": 5, "quantity": 2, "unit_price": 3}]') for i in range(3)], "order_id string, order_date timestamp, items string")
    frame.repartition(3).write.option("maxRecordsPerFile", 1).parquet(src)
    query = J.stream_sync(J.file_stream(spark, src, max_files=1), out, f"{tmp_path}/ckpt")
    query.awaitTermination()
    assert ledger.committed(spark, out).count() >= 3 and D.versions(spark, out).isEmpty()
    wanted = rows(O.read_loaded(spark, out, "agg_daily_demand"))
    J.finish(query)
    assert rows(D.versions(spark, out).select("version").distinct()) == [(1,)] and D.changed_loads(spark, out).isEmpty()
    assert rows(O.read_loaded(spark, out, "agg_daily_demand")) == wanted == [("5", dt.date(2024, 1, 1), 6.0, 18.0, 3)]
    J.finish(J.stream_sync(J.file_stream(spark, src, max_files=1), out, f"{tmp_path}/ckpt"))
    assert D.versions(spark, out).select("version").distinct().count() == 1  # nothing came


def test_large_feeds_are_written_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(V, "ROWS_PER_FILE", 10)
    given = spark.range(0, 95, 1, 2)
    few = V.folder_of(spark, given, "few", 4, 4)
    many = V.folder_of(spark, given, "many", 12, 4)
    assert rows(spark.read.parquet(few)) == rows(spark.read.parquet(many)) == rows(given)
    assert V.half_of(spark, many) == 5  # 47 and 48 rows, 10 to a file
    assert spark.read.parquet(many).groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] == 10
    assert spark.read.parquet(many).filter("id < 10").select(F.input_file_name()).distinct().count() == 1  # not dealt out


def test_deliveries_are_kept_as_digests(spark, tmp_path):
    """The state of the streamed demand has 16 bytes for a delivery, whatever the length of its message's id."""
    facts(spark).write.parquet(f"{tmp_path}/in")
    days = J.stream_daily_demand(J.file_stream(spark, f"{tmp_path}/in"))
    plan = days._jdf.queryExecution().analyzed().toString()
    assert "DeduplicateWithinWatermark [_delivery#" in plan
    J.finish(J.write_batches(days, f"{tmp_path}/out", f"{tmp_path}/ckpt", "update"))
    assert rows(J.read_demand(spark, f"{tmp_path}/out")) == rows(O.daily_demand(D.once(facts(spark))))
