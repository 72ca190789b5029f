import datetime as dt

import pytest
from tests.conftest import rows
from pyspark.sql import functions as F

from demandloom.operators import imports as I
from demandloom.operators import orders as O
from demandloom.operators import sync as Y
from demandloom.plans import schemas
from demandloom.plans.ingest import ingest


def orders_of(spark, items, dates=None):
    data = [(f"o{i}", dt.datetime(2024, 1, 1 + i % 3), f"c{i % 2}", text) for i, text in enumerate(items)]
    return spark.createDataFrame(data, "order_id string, order_date timestamp, customer_id string, items string")


def test_explode_edge_cases(spark):
    df = orders_of(
        spark,
        [
            '[{"product_id": 5, "quantity": "2", "unit_price": 3.5, "discount": 1}, {"product_id": "x", "quantity": 1, "unit_price": 2}]',
            '[{"product_id": 6, "quantity": "two", "unit_price": 3, "discount": 1}]',
            '[{"product_id": 7, "quantity": 2, "unit_price": null}]',
            '[{"quantity": 2, "unit_price": 4}]',
            '{"product_id": 8, "quantity": 2}',
            '[{"product_id": 9, "quan',
            "[]",
            None,
        ],
    )
    got = rows(O.explode_orders(df, source_id=3), "order_id", "product_id", "quantity", "unit_price", "discount", "gross_sale", "net_sale")
    assert got == [
        ("o0", "5", 2.0, 3.5, 1.0, 7.0, 6.0),
        ("o0", "x", 1.0, 2.0, 0.0, 2.0, 2.0),
        ("o1", "6", 0.0, 0.0, 0.0, 0.0, 0.0),
        ("o2", "7", 0.0, 0.0, 0.0, 0.0, 0.0),
        ("o3", None, 2.0, 4.0, 0.0, 8.0, 8.0),
    ]
    assert O.explode_orders(df, items_source_type="separate_table").count() == 0
    assert O.explode_orders(df.drop("items")).count() == 0


def test_backlog_and_customers(spark):
    df = orders_of(spark, ["[]", "[1]", "[]"]).withColumn("customer_name", F.concat(F.lit("name "), "order_id"))
    backlog = O.order_backlog(df, source_id=4)
    assert backlog.columns == ["order_id", "customer_id", "order_date", "status", "total_amount", "source_id", "raw_items"]
    people = O.extract_customers(df.withColumn("customer_id", F.when(F.col("order_id") != "o1", F.col("customer_id"))))
    assert rows(people, "customer_id", "name") == [("c0", "name o0")]


def test_daily_demand_skips_null_keys(spark):
    fact = spark.createDataFrame(
        [("o1", "p", 1.0, 2.0, dt.datetime(2024, 1, 1, 5)), ("o1", "p", 2.0, 2.0, dt.datetime(2024, 1, 1, 9)), ("o2", None, 1.0, 1.0, dt.datetime(2024, 1, 1)), ("o3", "p", 1.0, 1.0, None)],
        "order_id string, product_id string, quantity double, gross_sale double, sale_date timestamp",
    )
    assert rows(O.daily_demand(fact)) == [("p", dt.date(2024, 1, 1), 3.0, 4.0, 1)]


def test_load_is_repeatable_and_additive(spark, tmp_path):
    item = '[{"product_id": 5, "quantity": 2, "unit_price": 3}]'
    out = str(tmp_path / "tables")
    first, second = orders_of(spark, [item]), orders_of(spark, [item, item]).filter("order_id = 'o1'")
    for _ in range(2):
        counts = O.load_orders(first, out, load_id="a")
    assert dict((r["table"], r["rows"]) for r in counts.collect()) == dict.fromkeys(O.LOAD_TABLES, 1) | {"dead_letters": 0}
    O.load_orders(second.withColumn("order_date", F.lit(dt.datetime(2024, 1, 1))), out, load_id="b")
    assert O.read_loaded(spark, out, "fact_sales").count() == 2
    assert rows(O.read_loaded(spark, out, "agg_daily_demand")) == [("5", dt.date(2024, 1, 1), 4.0, 12.0, 2)]


def test_loads_share_orders_and_repeat_messages(spark, tmp_path):
    out = str(tmp_path)
    item = lambda q: f'[{{"product_id": 5, "quantity": {q}, "unit_price": 3}}, {{"product_id": 5, "quantity": 1, "unit_price": 3}}]'
    day = dt.datetime(2024, 1, 1)
    schema = "order_id string, order_date timestamp, customer_id string, customer_name string, items string"
    first = [("a", day, "c", "late", item(2)), ("a", day, "c", "late", item(7)), ("b", day, "c", "x", "[1"), ("b", day, "c", "x", "[1")]
    second = [("a", day, "c", "late", item(2)), ("a", day - dt.timedelta(1), "c", "early", "[]"), ("z", day, "d", "z", '[{"quantity": 1}] []')]
    O.load_orders(spark.createDataFrame(first, schema), out, load_id="1")
    O.load_orders(spark.createDataFrame(second, schema), out, load_id="2")
    assert rows(O.read_loaded(spark, out, "agg_daily_demand")) == [("5", dt.date(2024, 1, 1), 11.0, 33.0, 1)]
    assert rows(O.read_loaded(spark, out, "dim_customers"), "customer_id", "name") == [("c", "early"), ("d", "z")]
    assert rows(O.read_loaded(spark, out, "dead_letters"), "order_id", "reason") == [("b", O.UNPARSED), ("z", O.UNPARSED)]
    assert O.read_loaded(spark, out, "orders_backlog").count() == 5


def test_sync_takes_ties_and_keeps_undated_rows(spark, tmp_path):
    item = '[{"product_id": 5, "quantity": 2, "unit_price": 3}]'
    out, schema = str(tmp_path), "order_id string, order_date timestamp, items string"
    day = dt.datetime(2024, 1, 2)
    marks = spark.createDataFrame([], Y.MARK_SCHEMA)
    data = [("a", day, item), ("u", None, item)]
    for more in ([], [("b", day, item)], [("b", day, item), ("v", None, item)], [("c", day + dt.timedelta(1), item)], []):
        data += more
        _, marks = Y.incremental_sync(spark.createDataFrame(data, schema), marks, 1, out)
    assert rows(O.read_loaded(spark, out, "orders_backlog"), "order_id") == [("a",), ("b",), ("c",)]
    assert rows(O.read_loaded(spark, out, "dead_letters"), "order_id", "reason") == [("u", O.UNDATED), ("v", O.UNDATED)]
    assert marks.first()["last_synced_at"] == day + dt.timedelta(1)


PRODUCTS = "id int, sku_code string, name string, category_id int, base_price double, unit_cost double, current_stock int, safety_stock int, status string, weight double, dimensions string"


def empty_catalog(spark):
    return spark.createDataFrame([], PRODUCTS), spark.createDataFrame([], "id int, name string")


def test_product_import(spark):
    products, categories = empty_catalog(spark)
    data = [
        (0, "SKU001", "A", "29.99", "100.7", "Active", "Electronics"),
        (1, "SKU002", "B", "bad", "50", "gone", "Home"),
        (2, "SKU003", "C", None, None, None, "Electronics"),
        (3, "", "D", None, None, None, None),
        (4, None, "E", None, None, None, None),
        (5, "SKU001", "A2", None, "7", None, None),
    ]
    df = spark.createDataFrame(data, "row_num int, sku_code string, name string, base_price string, current_stock string, status string, category_name string")
    got = I.import_products(df, products, categories)
    assert got.summary.first().asDict() == {"total_rows": 6, "rows_imported": 3, "rows_updated": 1, "rows_failed": 0, "rows_skipped": 2, "warnings": 2}
    assert rows(got.tables["products"], "sku_code", "name", "base_price", "current_stock", "status") == [
        ("SKU001", "A2", 29.99, 7, "active"), ("SKU002", "B", None, 50, None), ("SKU003", "C", None, None, None),
    ]
    assert rows(got.tables["products"], "id") == [(1,), (2,), (3,)]
    assert {n for _, n in rows(got.tables["categories"], "id", "name")} == {"Electronics", "Home"}
    assert rows(got.rejects, "row_num", "outcome") == [(3, "skipped"), (4, "skipped")]
    again = I.import_products(df, got.tables["products"], got.tables["categories"])
    assert again.summary.first()["rows_imported"] == 0 and again.tables["products"].count() == 3
    with pytest.raises(ValueError, match="sku_code"):
        I.import_products(df.drop("sku_code"), products, categories)


def test_order_import(spark):
    products = spark.createDataFrame([(1, "SKU001"), (2, "SKU002")], "id int, sku_code string")
    customers = spark.createDataFrame([("k1", "Known", "known@x.org")], "id string, name string, email string")
    data = [
        (0, "ORD-1", "2026-06-01", "Acme", "a@acme.com", "SKU001", "10", "29.99", "completed", "549.85"),
        (1, "ORD-1", "2026-06-01", "Acme", "other@x.org", "SKU002", "5", "49.99", None, None),
        (2, "ORD-2", "2026-06-02", "Twin", "a@acme.com", "SKU001", "3", "29.99", None, "much"),
        (3, "ORD-3", "2026-06-02", "Alias", "known@x.org", "SKU001", "3", "1", None, None),
        (4, "ORD-4", "2026-06-02", "Known", None, "SKU001", "3", "1", None, None),
        (5, "ORD-5", "2026-06-02", None, None, "SKU404", "3", "1", None, None),
        (6, "", "2026-06-02", None, None, "SKU001", "3", "1", None, None),
        (7, "ORD-6", None, None, None, "SKU001", "3", "1", None, None),
        (8, "ORD-6", "junk", None, None, "SKU001", "3", "1", None, None),
        (9, "ORD-6", "2026-06-02", None, None, "SKU001", "x", "1", None, None),
        (10, "ORD-6", "2026-06-02", None, None, "SKU001", "1", None, None, None),
        (11, "ORD-6", "2026-06-02", None, None, " ", "1", "1", None, None),
    ]
    names = "row_num int, order_id string, order_date string, customer_name string, customer_email string, product_sku string, quantity string, price_at_sale string, status string, total_amount string"
    got = I.import_orders(spark.createDataFrame(data, names), products, customers)
    s = got.summary.first()
    assert (s["total_rows"], s["rows_imported"], s["rows_failed"], s["rows_skipped"]) == (12, 5, 4, 3)
    orders = {r["order_id"]: r for r in got.tables["orders"].collect()}
    assert set(orders) == {"ORD-1", "ORD-2", "ORD-3", "ORD-4"}
    assert (orders["ORD-1"]["status"], orders["ORD-2"]["status"], orders["ORD-2"]["total_amount"]) == ("completed", "pending", None)
    assert orders["ORD-3"]["customer_id"] == orders["ORD-4"]["customer_id"] == "k1"
    # a new name with the e-mail of a customer made earlier in the file is that customer
    assert orders["ORD-1"]["customer_id"] == orders["ORD-2"]["customer_id"]
    assert rows(got.tables["customers"], "name", "email") == [("Acme", "a@acme.com")]
    assert got.tables["sales"].filter(F.col("order_id") == orders["ORD-1"]["id"]).count() == 2


def test_new_ids_are_dense(spark):
    known = spark.createDataFrame([(40, "a")], "id int, name string")
    names = spark.range(500).select(F.concat(F.lit("n"), (F.col("id") % 300).cast("string")).alias("name")).union(known.select("name"))
    got = I.assign_category_ids(names, known)
    assert sorted(r["id"] for r in got.collect()) == list(range(40, 341))


def test_incremental_sync(spark, tmp_path):
    item = '[{"product_id": 5, "quantity": 2, "unit_price": 3}]'
    df, out = orders_of(spark, [item] * 3), str(tmp_path)
    marks = spark.createDataFrame([], Y.MARK_SCHEMA)
    counts, marks = Y.incremental_sync(df.filter("order_id <> 'o2'"), marks, 1, out)
    assert marks.first()["last_synced_at"] == dt.datetime(2024, 1, 2) and marks.first()["rows_synced"] == 4
    counts, marks = Y.incremental_sync(df, marks, 1, out)
    assert {r["table"]: r["rows"] for r in counts.collect()}["fact_sales"] == 1
    assert marks.count() == 1 and marks.first()["last_synced_at"] == dt.datetime(2024, 1, 3)
    counts, marks = Y.incremental_sync(df, marks, 1, out)
    assert sum(r["rows"] for r in counts.collect()) == 0 and O.read_loaded(spark, out, "fact_sales").count() == 3


def test_syncs_at_one_mark_and_late_rows(spark, tmp_path):
    """Rows at the unchanged mark, undated rows and rows older than the mark are all loaded, once."""
    item, out = '[{"product_id": 5, "quantity": 2, "unit_price": 3}]', str(tmp_path)
    marks = spark.createDataFrame([], Y.MARK_SCHEMA)

    def sync(*given, **more):
        nonlocal marks
        df = spark.createDataFrame([(i, d and dt.datetime(2024, 1, d), item) for i, d in given], "order_id string, order_date timestamp, items string")
        counts, marks = Y.incremental_sync(df, marks, 1, out, **more)
        return {r["table"]: r["rows"] for r in counts.collect()}

    first = [("a", 5), ("b", 9)]
    sync(*first)
    assert sync(*first, ("c", 9), ("u", None))["orders_backlog"] == 1
    assert sync(*first, ("c", 9), ("d", 9), ("u", None), ("v", None)) == {"orders_backlog": 1, "fact_sales": 1, "dim_customers": 0, "agg_daily_demand": 1, "dead_letters": 1}
    assert sync(("late", 2), ("b", 9))["orders_backlog"] == 1
    assert sync(("older", 1), ("near", 8), lookback_days=3)["orders_backlog"] == 1  # the other waits for a sync without the bound
    assert sync(("older", 1), ("near", 8))["orders_backlog"] == 1
    loaded = ["a", "b", "c", "d", "late", "near", "older"]
    assert [r[0] for r in rows(O.read_loaded(spark, out, "orders_backlog"), "order_id")] == loaded
    assert [r[0] for r in rows(O.read_loaded(spark, out, "dead_letters"), "order_id")] == ["u", "v"]
    assert marks.first()["last_synced_at"] == dt.datetime(2024, 1, 9)
    assert O.read_loaded(spark, out, "agg_daily_demand").agg(F.sum("order_count")).first()[0] == 7


def test_demand_versions(spark, tmp_path, monkeypatch):
    """Each version holds the touched keys, reads the touched months only, and now and then all keys."""
    from demandloom.operators import demand as D
    from demandloom.sources import ledger
    from tests.conftest import plan_text

    out = str(tmp_path)
    monkeypatch.setattr(D, "COMPACT_AFTER", 3)

    def load(key, *given):
        item = lambda q: f'[{{"product_id": 5, "quantity": {q}, "unit_price": 3}}]'
        df = spark.createDataFrame([(i, dt.datetime(2024, m, 1), item(q)) for i, m, q in given], "order_id string, order_date timestamp, items string")
        counts = {r["table"]: r["rows"] for r in O.load_orders(df, out, source_id=1, load_id=key).collect()}
        every = O.daily_demand(ledger.read(spark, out, "fact_sales").transform(O.once))
        assert rows(O.read_loaded(spark, out, "agg_daily_demand")) == rows(every)
        return counts["agg_daily_demand"]

    assert load("x", ("a", 1, 1), ("b", 2, 1), ("c", 3, 1)) == 3
    assert load("y", ("d", 2, 5)) == 1
    assert load("x", ("a", 1, 1)) == 3  # replaced: two days lose rows, one of them all
    assert load(None, ("e", 4, 2)) == 3  # all keys there are
    assert load(None, ("f", 4, 2)) == 1
    keys = D.touched_keys(ledger.raw(spark, out, "fact_sales"), ledger.committed(spark, out).filter("load_key LIKE '%-y'"))
    plan = plan_text(D.demand_of(ledger.read(spark, out, "fact_sales"), keys))
    assert "month_no" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0] or "month_no" in plan and "202402" in plan
    lost = ledger.begin(out, 1)
    ledger.commit(spark, lost, {})  # committed by another job, not yet in any version
    assert D.changed_loads(spark, out).count() == 1


def test_sources_due(spark):
    sources = spark.createDataFrame([(1, None), (2, 6), (3, 0), (4, 6), (5, 1)], "id int, sync_interval_hours int")
    marks = spark.createDataFrame(
        [(2, dt.datetime(2024, 1, 1, 0)), (3, dt.datetime(2020, 1, 1)), (4, dt.datetime(2024, 1, 1, 11)), (5, dt.datetime(2024, 1, 1, 11))],
        "source_id int, last_synced_at timestamp",
    )
    assert rows(Y.sources_due(sources, marks, dt.datetime(2024, 1, 1, 12)), "id") == [(1,), (2,)]


def test_ingest_table(spark, tmp_path):
    df = spark.range(200).select(
        F.col("id").cast("string").alias("product_id"), F.col("id").cast("double").alias("quantity"), F.lit("2024-01-01").alias("date")
    )
    first = ingest(df, str(tmp_path), "shop", columns=["quantity"])
    assert first.drift is None and first.loaded.first()["rows"] == 180 and first.quarantine.count() == 0
    second = ingest(df.drop("date").withColumn("quantity", F.col("quantity") - 5), str(tmp_path), "shop", columns=["quantity"], load_id="1")
    assert second.drift.first()["has_breaking_changes"] and second.quarantine.count() == 5
    assert second.log.count() == 2
    with pytest.raises(ValueError):
        ingest(df, str(tmp_path), "shop", mode="other")


def test_table_schemas():
    for name in schemas.TABLES:
        assert schemas.table_schema(name).fields
