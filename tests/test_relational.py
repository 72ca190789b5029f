import datetime as dt

import pytest
from tests.conftest import plan_text, rows
from pyspark.sql import functions as F

from demandloom.operators import maintenance as M
from demandloom.operators import relational as R
from demandloom.sources import readers, writers


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [(1, "Ann", 10.0, "x"), (2, "Bob", 20.0, None), (3, None, 30.0, "x"), (4, "bobby", None, "y")],
        "id int, name string, score double, tag string",
    )


def test_suffix_filters_and_projection(people):
    assert rows(R.scan(people, {"score__gte": 20, "score__lt": 30}, ["id"])) == [(2,)]
    assert rows(R.scan(people, {"score__gt": 20, "score__lte": 30}, ["id"])) == [(3,)]
    assert R.scan(people, {"tag": None}).count() == 0
    assert R.scan(people).columns == people.columns


def test_filters_reach_the_scan(spark, sf):
    df = R.scan(spark.read.parquet(f"{sf}/lineitem.parquet"), {"l_quantity__gte": 10, "l_returnflag": "R"}, ["l_orderkey"])
    plan = plan_text(df)
    assert "GreaterThanOrEqual(l_quantity,10.0)" in plan and "EqualTo(l_returnflag,R)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string>" in plan


def test_count_lookup_search(spark, people):
    assert R.count_where(people, {"tag": "x"}).first()["row_count"] == 2
    ids = spark.createDataFrame([(2,), (2,), (9,)], "id int")
    assert rows(R.lookup(people, ids), "id") == [(2,)]
    assert rows(R.search_any(people, "BOB"), "id") == [(2,), (4,)]
    assert rows(R.search_products(people, "bob", "4"), "id") == [(4,)]


def test_product_sales_bounds_and_mapping(spark):
    df = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 1)), (1, dt.datetime(2024, 1, 3)), (2, dt.datetime(2024, 1, 2))], "sku int, sold timestamp"
    )
    out = R.product_sales(df, [1], "2024-01-01", "2024-01-02", mapping={"product_id": "sku", "ds": "sold"})
    assert out.count() == 1
    assert R.product_sales(df, [], None, "", mapping={"product_id": "sku", "ds": "sold"}).count() == 3
    ids = spark.createDataFrame([(2,)], "sku int")
    assert R.product_sales(df, ids, mapping={"product_id": "sku"}).count() == 1


def test_catalog_listing(spark, people):
    people.createOrReplaceTempView("people_listing")
    assert ("people_listing",) in rows(R.list_tables(spark))
    assert ("score", "double") in rows(R.describe_columns(spark, "people_listing"))
    spark.catalog.dropTempView("people_listing")
    meta = R.source_metadata(people, "csv", "people").first()
    assert (meta["record_count"], meta["column_count"], meta["source_type"]) == (4, 4, "csv")


def test_normalize_nulls_and_update(spark):
    df = spark.createDataFrame([(1, float("nan"), "a"), (2, 1.5, None)], "id int, x double, s string")
    assert rows(M.normalize_nulls(df)) == [(1, None, "a"), (2, 1.5, None)]
    out = M.bulk_update(df, {"id__gte": 2}, {"s": "new"})
    assert rows(out, "id", "s") == [(1, "a"), (2, "new")]


def test_upsert_rules(spark):
    target = spark.createDataFrame([("a", "old", 1.0), ("b", "keep", 2.0)], "k string, name string, v double")
    updates = spark.createDataFrame(
        [(1, "a", "first", 5.0), (2, "a", None, 6.0), (3, "c", "new", None), (4, None, "no key", 1.0)],
        "seq int, k string, name string, v double",
    )
    assert rows(M.upsert(target, updates, "k", "seq")) == [("a", "first", 6.0), ("b", "keep", 2.0), ("c", "new", None)]
    empty = updates.limit(0)
    assert rows(M.sync_dimension(empty, target, "k", "seq")) == rows(target)


def test_bulk_delete(spark, people):
    assert rows(M.bulk_delete(people, spark.createDataFrame([(1,), (4,)], "id int")), "id") == [(2,), (3,)]


def test_csv_options(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_bytes("a;b;c\n1;2024-02-29 10:00:00;é\n2;bad;\n".encode("latin-1"))
    df = readers.read_csv(spark, str(path), ";", "ISO-8859-1", ["b"], ["b", "c"], schema="a int, b string, c string")
    assert df.columns == ["b", "c"]
    got = df.collect()
    assert got[0]["b"] == dt.datetime(2024, 2, 29, 10) and got[0]["c"] == "é" and got[1]["b"] is None
    with pytest.raises(Exception):
        readers.read_csv(spark, str(tmp_path / "absent.csv"))


def test_json_path_and_flatten(spark, tmp_path):
    (tmp_path / "page.json").write_text('{"data": {"results": [{"a": 1, "n": {"b": 2, "l": [1]}}, {"a": 3}]}, "one": {"z": 5}}')
    df = readers.flatten_struct(readers.read_json_path(spark, str(tmp_path), "data.results"))
    assert df.columns == ["a", "n.b", "n.l"]
    assert [tuple(r) for r in df.collect()] == [(1, 2, [1]), (3, None, None)]
    assert rows(readers.read_json_path(spark, str(tmp_path), "one")) == [(5,)]


def test_connector_options():
    assert readers.jdbc_options("jdbc:x", "t", "id", 0, 100, 10)["numPartitions"] == "10"
    kafka = readers.kafka_options("orders", "broker:9092")
    assert kafka["startingOffsets"] == "earliest" and "maxOffsetsPerTrigger" not in kafka


def test_writers(spark, people, tmp_path):
    path = writers.write_parquet(people, str(tmp_path / "p"), ["tag", "absent"])
    assert spark.read.parquet(path).count() == 4
    assert writers.sales_audit(people, str(tmp_path / "r"), "pdf") is None
    assert writers.sales_audit(people.limit(0), str(tmp_path / "r"), "csv") is None
    out = writers.sales_audit(people, str(tmp_path / "r"), "csv")
    manifest = spark.read.parquet(str(tmp_path / "r" / "reports")).first()
    assert manifest["file_path"] == out and manifest["report_type"] == "CSV"
    nested = spark.createDataFrame([(1, [1, 2], float("nan"))], "id int, l array<int>, x double")
    assert rows(writers.jdbc_ready(nested)) == [(1, "[1,2]", None)]


def test_search_any_ignores_nulls(people):
    assert R.search_any(people, "null").count() == 0
    assert people.filter(F.lit(True)).count() == 4


def test_updates_leave_untouched_parts_alone(spark, tmp_path):
    from demandloom.operators import versioned as W

    path = str(tmp_path / "t")
    W.create(spark.range(1000).select("id", (F.col("id") * 2).alias("v"), F.lit("a").alias("s")), path, "id", 10)
    first = W.latest(spark, path)
    assert len(first.folders) == 10 and W.read(spark, path).count() == 1000
    files = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "t" / "data").rglob("*.parquet")}
    before = files()
    assert W.update_where(spark, path, {"id__gte": 995}, {"s": "b"}) == 1
    assert W.upsert_rows(spark, path, spark.createDataFrame([(5, -1, None), (5000, 1, "new")], "id long, v long, s string")) == 2
    assert W.delete_keys(spark, path, spark.createDataFrame([(5,), (77777,)], "key long")) == 1
    assert W.delete_keys(spark, path, spark.createDataFrame([(77777,)], "key long")) == 0
    after = files()
    assert all(after[f] == t for f, t in before.items())  # old files stay, and as they were
    last = W.latest(spark, path)
    assert last.number == 4 and sum(last.folders[p] == first.folders[p] for p in first.folders) == 8
    got = {r.id: (r.v, r.s) for r in W.read(spark, path).collect()}
    assert got == {i: (i * 2, "b" if i >= 995 else "a") for i in range(1000) if i != 5} | {5000: (1, "new")}
    with pytest.raises(W.Conflict):
        W._commit(spark, first, first.rows(spark, [0]), [0])
    assert W.delete_keys(spark, path, W.read(spark, path).select("id")) == 10
    assert W.read(spark, path).count() == 0 and W.read(spark, path).columns == ["id", "v", "s"]
    assert W.upsert_rows(spark, path, spark.createDataFrame([(3, 1, "x")], "id long, v long, s string")) == 1
    assert rows(W.read(spark, path)) == [(3, 1, "x")]
