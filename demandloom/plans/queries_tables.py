"""Registered queries: scans, sources, sinks and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom.operators import maintenance as M
from demandloom.operators import relational as R
from demandloom.operators import versioned as W
from demandloom.plans import views as V
from demandloom.plans.registry import query
from demandloom.session import scratch_path
from demandloom.sources import readers, writers


@query(
    "scan_filters",
    """SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice FROM lineitem
       WHERE l_quantity >= 10 AND l_quantity < 20 AND l_returnflag = 'R' AND l_discount > 0.02 AND l_tax <= 0.05""",
)
def scan_filters(spark, sf):
    filters = {"l_quantity__gte": 10, "l_quantity__lt": 20, "l_returnflag": "R", "l_discount__gt": 0.02, "l_tax__lte": 0.05}
    return R.scan(V.table(spark, sf, "lineitem"), filters, ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice"])


@query(
    "count_where",
    "SELECT count(*) AS row_count FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 200000",
)
def count_where(spark, sf):
    return R.count_where(V.table(spark, sf, "orders"), {"o_orderstatus": "F", "o_totalprice__gte": 200000})


@query(
    "lookup_ids",
    "SELECT * FROM customers WHERE id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)",
    ["customers"],
)
def lookup_ids(spark, sf):
    big = V.table(spark, sf, "orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("id"))
    return R.lookup(V.customers(spark, sf), big)


@query(
    "product_sales_range",
    """SELECT product_id, strftime(ds, '%Y-%m-%d') AS ds, quantity FROM sales
       WHERE product_id IN (1, 5, 17, 101) AND ds >= TIMESTAMP '1997-01-01' AND ds <= TIMESTAMP '1999-06-30'""",
    ["sales"],
)
def product_sales_range(spark, sf):
    out = R.product_sales(
        V.sales(spark, sf), [1, 5, 17, 101], "1997-01-01", "1999-06-30", columns=["product_id", "ds", "quantity"]
    )
    return out.withColumn("ds", F.date_format("ds", "yyyy-MM-dd"))


@query("search_any", "SELECT * FROM part WHERE lower(concat_ws('|', p_partkey, p_name, p_brand, p_type, p_size, p_retailprice)) LIKE '%gear%'")
def search_any(spark, sf):
    return R.search_any(V.table(spark, sf, "part"), "GEAR")


@query(
    "search_products",
    "SELECT id, sku_code, name FROM products WHERE lower(name) LIKE '%red%' AND starts_with(CAST(id AS VARCHAR), '1')",
    ["products"],
)
def search_products(spark, sf):
    return R.search_products(V.products(spark, sf), "Red", "1").select("id", "sku_code", "name")


@query(
    "source_metadata",
    "SELECT 'parquet' AS source_type, 'lineitem' AS source_name, count(*) AS record_count, 11 AS column_count FROM lineitem",
)
def source_metadata(spark, sf):
    return R.source_metadata(V.table(spark, sf, "lineitem"), "parquet", "lineitem").drop("extracted_at")


@query(
    "read_csv",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders",
)
def read_csv(spark, sf):
    path = scratch_path(spark, "orders-csv")
    writers.write_csv(V.table(spark, sf, "orders"), path)
    back = readers.read_csv(
        spark, path, parse_dates=["o_orderdate"], usecols=["o_orderkey", "o_orderdate", "o_orderpriority"]
    )
    return back.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query(
    "export_view",
    "SELECT c_custkey, c_mktsegment FROM customer",
)
def export_view(spark, sf):
    path = scratch_path(spark, "customer-view")
    writers.export_view(V.table(spark, sf, "customer"), ["c_custkey", "c_mktsegment"], path)
    return readers.read_csv(spark, path, schema="c_custkey bigint, c_mktsegment string")


def _landed_pages(spark, sf) -> str:
    """Orders as landed API documents: {"data": {"results": [...]}} per line."""
    path = scratch_path(spark, "landed-json")
    record = F.struct(
        F.col("o_orderkey").alias("id"),
        F.struct(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("status")).alias("customer"),
        F.col("o_totalprice").alias("total"),
    )
    V.table(spark, sf, "orders").select(F.struct(F.array(record).alias("results")).alias("data")).write.json(path)
    return path


PAGE_SCHEMA = "data struct<results array<struct<id bigint, customer struct<key bigint, status string>, total double>>>"


@query("read_json_path", "SELECT o_orderkey AS id, o_custkey AS customer_key, o_totalprice AS total FROM orders")
def read_json_path(spark, sf):
    rows = readers.read_json_path(spark, _landed_pages(spark, sf), "data.results", PAGE_SCHEMA)
    return rows.select("id", F.col("customer.key").alias("customer_key"), "total")


@query(
    "flatten_struct",
    'SELECT o_orderkey AS id, o_custkey AS "customer.key", o_orderstatus AS "customer.status", o_totalprice AS total FROM orders',
)
def flatten_struct(spark, sf):
    return readers.flatten_struct(readers.read_json_path(spark, _landed_pages(spark, sf), "data.results", PAGE_SCHEMA))


@query(
    "parse_json_values",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
)
def parse_json_values(spark, sf):
    messages = V.events(spark, sf).select(
        F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "props": '), F.col("props"), F.lit("}"))
        .cast("binary")
        .alias("value")
    )
    parsed = readers.parse_json_values(messages, "event_id bigint, props struct<k bigint>")
    return parsed.select("event_id", F.col("props.k").alias("k"))


@query(
    "write_parquet_partitioned",
    "SELECT l_returnflag, count(*) AS row_count, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1",
)
def write_parquet_partitioned(spark, sf):
    path = scratch_path(spark, "lineitem-by-flag")
    writers.write_parquet(V.table(spark, sf, "lineitem"), path, ["l_returnflag", "absent"])
    return (
        spark.read.parquet(path)
        .groupBy("l_returnflag")
        .agg(F.count(F.lit(1)).alias("row_count"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    )


@query(
    "sales_audit",
    "SELECT product_id, order_id, line_no, quantity FROM sales",
    ["sales"],
)
def sales_audit(spark, sf):
    out = scratch_path(spark, "audit")
    path = writers.sales_audit(V.sales(spark, sf), out, "json")
    return spark.read.schema("product_id int, order_id bigint, line_no int, quantity double").json(path)


@query(
    "report_manifest",
    "SELECT 'CSV' AS report_type, count(*) > 0 AS has_size FROM lineitem",
)
def report_manifest(spark, sf):
    out = scratch_path(spark, "audit")
    writers.sales_audit(V.sales(spark, sf), out, "CSV")
    return spark.read.parquet(f"{out}/reports").select("report_type", (F.col("file_size_kb") > 0).alias("has_size"))


@query(
    "jdbc_ready_rows",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value,
              concat('["', event_type, '"]') AS tags FROM events""",
)
def jdbc_ready_rows(spark, sf):
    rows = V.events(spark, sf).select(
        "event_id",
        F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value")).alias("value"),
        F.array("event_type").alias("tags"),
    )
    return writers.jdbc_ready(rows)


@query(
    "normalize_nulls",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_tax END AS l_tax FROM lineitem""",
)
def normalize_nulls(spark, sf):
    holed = V.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("l_tax"),
    )
    return M.normalize_nulls(holed)


@query(
    "bulk_update",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_totalprice < 100000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
              CASE WHEN o_orderstatus = 'P' AND o_totalprice < 100000 THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders""",
)
def bulk_update(spark, sf):
    rows = V.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return M.bulk_update(rows, {"o_orderstatus": "P", "o_totalprice__lt": 100000}, {"o_orderstatus": "X", "o_totalprice": 0})


@query(
    "bulk_delete",
    "SELECT id, name FROM customers WHERE id NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    ["customers"],
)
def bulk_delete(spark, sf):
    gone = V.table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id"))
    return M.bulk_delete(V.customers(spark, sf), gone).select("id", "name")


UPSERT_SQL = """
SELECT coalesce(t.id, u.id) AS id, coalesce(u.name, t.name) AS name, coalesce(u.ltv, t.ltv) AS ltv
FROM (SELECT id, name, ltv FROM customers) t
FULL OUTER JOIN (
    SELECT id, arg_max(name, seq) FILTER (name IS NOT NULL) AS name, arg_max(ltv, seq) FILTER (ltv IS NOT NULL) AS ltv
    FROM (SELECT o_custkey + 3 AS id, o_orderkey AS seq,
                 CASE WHEN o_orderkey % 5 = 0 THEN concat('renamed ', CAST(o_orderkey AS VARCHAR)) END AS name,
                 CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS ltv FROM orders)
    GROUP BY id) u ON t.id = u.id"""


def _customer_updates(spark, sf):
    o = V.table(spark, sf, "orders")
    key = F.col("o_orderkey")
    return o.select(
        (F.col("o_custkey") + 3).alias("id"),
        key.alias("seq"),
        F.when(key % 5 == 0, F.concat(F.lit("renamed "), key.cast("string"))).alias("name"),
        F.when(key % 3 == 0, F.col("o_totalprice")).alias("ltv"),
    )


@query("upsert", UPSERT_SQL, ["customers"])
def upsert(spark, sf):
    target = V.customers(spark, sf).select("id", "name", "ltv")
    return M.upsert(target, _customer_updates(spark, sf), "id", "seq")


@query("sync_dimension", UPSERT_SQL, ["customers"])
def sync_dimension(spark, sf):
    target = V.customers(spark, sf).select("id", "name", "ltv")
    updates = _customer_updates(spark, sf).withColumn("ltv", F.coalesce("ltv", F.lit(float("nan"))))
    return M.sync_dimension(updates, target, "id", "seq")


@query(
    "versioned_update",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_totalprice < 100000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
              CASE WHEN o_orderstatus = 'P' AND o_totalprice < 100000 THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders""",
)
def versioned_update(spark, sf):
    path = scratch_path(spark, "versioned")
    W.create(V.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path, "o_orderkey", 8)
    W.update_where(spark, path, {"o_orderstatus": "P", "o_totalprice__lt": 100000}, {"o_orderstatus": "X", "o_totalprice": 0})
    return W.read(spark, path)


@query(
    "versioned_delete",
    "SELECT id, name FROM customers WHERE id NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    ["customers"],
)
def versioned_delete(spark, sf):
    path = scratch_path(spark, "versioned")
    W.create(V.customers(spark, sf).select("id", "name"), path, "id", 8)
    W.delete_keys(spark, path, V.table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select("o_custkey"))
    return W.read(spark, path)


@query("versioned_upsert", UPSERT_SQL, ["customers"])
def versioned_upsert(spark, sf):
    path = scratch_path(spark, "versioned")
    W.create(V.customers(spark, sf).select("id", "name", "ltv"), path, "id", 8)
    W.upsert_rows(spark, path, _customer_updates(spark, sf), "seq")
    return W.read(spark, path)


@query(
    "versioned_parts",
    """WITH cut AS (SELECT quantile_disc(o_orderkey, 0.9) AS k FROM orders)
       SELECT o_orderkey, CASE WHEN o_orderkey > k AND o_orderkey % 2 = 0 THEN 'late' ELSE o_orderstatus END AS o_orderstatus FROM orders, cut
       WHERE NOT (o_orderkey > k AND o_orderkey % 5 = 0)""",
)
def versioned_parts(spark, sf):
    """Updates of the last tenth of the keys only, of which an upsert, a delete and the parts in between make three versions."""
    path, orders = scratch_path(spark, "versioned"), V.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    W.create(orders, path, "o_orderkey", 8)
    late = orders.filter(F.col("o_orderkey") > orders.agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY o_orderkey)").alias("k")).scalar())
    W.upsert_rows(spark, path, late.filter("o_orderkey % 2 = 0").select("o_orderkey", F.lit("late").alias("o_orderstatus")))
    W.delete_keys(spark, path, late.filter("o_orderkey % 5 = 0").select("o_orderkey"))
    return W.read(spark, path)


@query(
    "describe_columns",
    """SELECT name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS type,
              CAST(filled AS BIGINT) AS filled
       FROM (UNPIVOT (SELECT count(COLUMNS(*)) FROM lineitem) ON COLUMNS(*) INTO NAME name VALUE filled) JOIN (DESCRIBE lineitem) ON name = column_name""",
)
def describe_columns(spark, sf):
    """Names and types of the columns, with how many values each has."""
    li = V.table(spark, sf, "lineitem")
    counts = li.agg(*[F.count(c).alias(c) for c in li.columns])
    filled = counts.unpivot([], li.columns, "name", "filled")
    return R.describe_columns(spark, li).join(filled, on="name")


@query("list_tables", "SELECT 'listed_orders' AS name, count(*) AS record_count FROM orders UNION ALL SELECT 'listed_parts', count(*) FROM part")
def list_tables(spark, sf):
    """Tables of the folder, made known to the session under names of their own, with their sizes."""
    sizes = None
    for name, source in (("listed_orders", "orders"), ("listed_parts", "part")):
        V.table(spark, sf, source).createOrReplaceTempView(name)
        size = spark.table(name).agg(F.lit(name).alias("name"), F.count("*").alias("record_count"))
        sizes = size if sizes is None else sizes.unionAll(size)
    return R.list_tables(spark).join(sizes, on="name")
