"""Registered queries: JSON orders, imports, incremental loads."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.operators import imports as I
from demandloom.operators import orders as O
from demandloom.operators import sync as Y
from demandloom.plans import views as V
from demandloom.plans.ingest import ingest
from demandloom.plans.registry import query
from demandloom.session import scratch_path

ITEM_SQL = """SELECT ord AS order_id, 7 AS source_id, product_id, quantity, unit_price, discount, round(gross_sale, 4) AS gross_sale,
    round(net_sale, 4) AS net_sale, strftime(sale_date, '%Y-%m-%d') AS sale_date FROM items"""


def _facts(spark, sf):
    return O.explode_orders(V.order_feed(spark, sf), V.FEED_MAPPING, 7)


def _shown(facts):
    return facts.withColumns(
        {
            "gross_sale": F.round("gross_sale", 4),
            "net_sale": F.round("net_sale", 4),
            "sale_date": F.date_format("sale_date", "yyyy-MM-dd"),
        }
    )


@query("explode_orders", ITEM_SQL, ["items"])
def explode_orders(spark, sf):
    return _shown(_facts(spark, sf))


@query(
    "explode_orders_native",
    """SELECT l_orderkey AS order_id, 1 AS source_id, CAST(l_partkey AS VARCHAR) AS product_id, l_quantity AS quantity,
              l_extendedprice AS unit_price, CAST(0 AS DOUBLE) AS discount, round(l_quantity * l_extendedprice, 4) AS gross_sale,
              round(l_quantity * l_extendedprice, 4) AS net_sale, strftime(l_shipdate, '%Y-%m-%d') AS sale_date FROM lineitem""",
)
def explode_orders_native(spark, sf):
    item = F.struct(
        F.col("l_partkey").alias("product_id"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("unit_price")
    )
    rows = V.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_shipdate").alias("order_date"), F.array(item).alias("items")
    )
    return _shown(O.explode_orders(rows, source_id=1))


@query(
    "order_backlog",
    """SELECT l_orderkey AS order_id, o_custkey AS customer_id, strftime(o_orderdate, '%Y-%m-%d') AS order_date, o_orderstatus AS status,
              o_totalprice AS total_amount, 7 AS source_id, TRUE AS has_items FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""",
)
def order_backlog(spark, sf):
    out = O.order_backlog(V.order_feed(spark, sf), V.FEED_MAPPING, 7)
    return out.withColumns(
        {"order_date": F.date_format("order_date", "yyyy-MM-dd"), "has_items": F.col("raw_items").isNotNull()}
    ).drop("raw_items")


def _order_customers(spark, sf):
    c = V.customers(spark, sf).select(F.col("id").alias("o_custkey"), "name", "segment")
    o = V.table(spark, sf, "orders").join(c, on="o_custkey")
    return o.select(
        F.col("o_orderkey").alias("ord"),
        F.col("o_orderdate").alias("placed"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey")).alias("cust"),
        F.concat("name", F.lit("/"), F.col("o_orderpriority")).alias("cust_name"),
        F.col("segment").alias("cust_segment"),
    )


@query(
    "extract_customers",
    """SELECT customer_id, name, CAST(NULL AS VARCHAR) AS email, segment, CAST(NULL AS VARCHAR) AS region FROM (
         SELECT o_custkey AS customer_id, concat(name, '/', o_orderpriority) AS name, segment,
                row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn
         FROM orders JOIN customers ON o_custkey = id WHERE o_orderkey % 11 <> 0) WHERE rn = 1""",
    ["customers"],
)
def extract_customers(spark, sf):
    return O.extract_customers(_order_customers(spark, sf), V.FEED_MAPPING)


DEMAND_SQL = """SELECT product_id, strftime(sale_date, '%Y-%m-%d') AS sale_date, round(sum(quantity), 4) AS total_qty,
    round(sum(gross_sale), 2) AS total_revenue, count(DISTINCT ord) AS order_count
    FROM items WHERE product_id IS NOT NULL AND sale_date IS NOT NULL GROUP BY 1, 2"""


def _demand_shown(df):
    return df.select(
        "product_id",
        F.date_format("sale_date", "yyyy-MM-dd").alias("sale_date"),
        F.round("total_qty", 4).alias("total_qty"),
        F.round("total_revenue", 2).alias("total_revenue"),
        "order_count",
    )


@query("daily_demand", DEMAND_SQL, ["items"])
def daily_demand(spark, sf):
    return _demand_shown(O.daily_demand(_facts(spark, sf)))


@query(
    "load_orders",
    """SELECT 'orders_backlog' AS "table", count(*) AS rows, TRUE AS counted FROM lineitem
       UNION ALL SELECT 'fact_sales', count(*), TRUE FROM items
       UNION ALL SELECT 'dim_customers', count(DISTINCT o_custkey), FALSE FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       UNION ALL SELECT 'agg_daily_demand', count(*), FALSE FROM (SELECT DISTINCT product_id, sale_date FROM items WHERE sale_date IS NOT NULL)
       UNION ALL SELECT 'dead_letters', count(*), FALSE FROM lineitem WHERE l_linenumber IN (4, 7)""",
    ["items"],
)
def load_orders(spark, sf):
    return O.load_orders(V.order_feed(spark, sf), scratch_path(spark, "orders"), V.FEED_MAPPING, 7)


@query("load_orders_demand_table", DEMAND_SQL, ["items"])
def load_orders_demand_table(spark, sf):
    out = scratch_path(spark, "orders")
    O.load_orders(V.order_feed(spark, sf), out, V.FEED_MAPPING, 7)
    return _demand_shown(O.read_loaded(spark, out, "agg_daily_demand"))


def _product_rows(spark, sf):
    """An import file: known codes with some cells empty or wrong, new codes, repeated codes."""
    p = V.table(spark, sf, "part")
    key = F.col("p_partkey")
    base = p.select(
        (key + 1).alias("row_num"),
        F.when(key % 50 == 7, F.lit("  ")).otherwise(F.concat(F.lit(" SKU-"), (key + 1000).cast("string"))).alias("sku_code"),
        F.when(key % 50 != 8, F.concat(F.lit("new "), "p_name")).alias("name"),
        F.when(key % 5 == 0, "dear").when(key % 5 == 1, "").otherwise(F.col("p_retailprice").cast("string")).alias("base_price"),
        F.concat(F.col("p_size").cast("string"), F.lit(".9")).alias("current_stock"),
        F.when(key % 4 == 0, " Retired ").when(key % 4 == 1, "sold").alias("status"),
        F.when(key % 3 == 0, F.concat(F.lit("Type "), "p_type")).when(key % 3 == 1, F.col("p_brand")).alias("category_name"),
    )
    again = p.filter(key % 10 == 3).select(
        (key + 10_000_000).alias("row_num"),
        F.concat(F.lit("SKU-"), (key + 1000).cast("string")).alias("sku_code"),
        F.lit("second").alias("name"),
        F.lit(None).cast("string").alias("base_price"),
        F.lit("5").alias("current_stock"),
        F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("string").alias("category_name"),
    )
    return base.unionByName(again)


PRODUCT_ROWS_SQL = """
WITH raw AS (
    SELECT p_partkey + 1 AS row_num, CASE WHEN p_partkey % 50 = 7 THEN NULL ELSE concat('SKU-', CAST(p_partkey + 1000 AS VARCHAR)) END AS sku_code,
           CASE WHEN p_partkey % 50 <> 8 THEN concat('new ', p_name) END AS name,
           CASE WHEN p_partkey % 5 >= 2 THEN p_retailprice END AS base_price, p_size AS current_stock,
           CASE WHEN p_partkey % 4 = 0 THEN 'retired' END AS status,
           (p_partkey % 5 = 0)::INT + (p_partkey % 4 = 1)::INT AS warnings,
           CASE WHEN p_partkey % 3 = 0 THEN concat('Type ', p_type) WHEN p_partkey % 3 = 1 THEN p_brand END AS category_name FROM part
    UNION ALL
    SELECT p_partkey + 10000000, concat('SKU-', CAST(p_partkey + 1000 AS VARCHAR)), 'second', NULL, 5, NULL, 0, NULL FROM part WHERE p_partkey % 10 = 3),
valid AS (SELECT * FROM raw WHERE sku_code IS NOT NULL AND name IS NOT NULL),
"""


def _import_products(spark, sf):
    return I.import_products(_product_rows(spark, sf), V.products(spark, sf), V.categories(spark, sf))


@query(
    "import_products",
    PRODUCT_ROWS_SQL
    + """products AS (SELECT concat('SKU-', CAST(p_partkey AS VARCHAR)) AS sku_code, p_name AS name, p_retailprice AS base_price,
             round(p_retailprice * 0.6, 2) AS unit_cost, CAST((p_partkey * 7) % 120 AS INT) AS current_stock,
             CASE WHEN p_partkey % 20 = 0 THEN 'retired' WHEN p_partkey % 33 = 0 THEN 'draft' ELSE 'active' END AS status FROM part),
    u AS (SELECT sku_code, arg_max(name, row_num) AS name, arg_max(base_price, row_num) FILTER (base_price IS NOT NULL) AS base_price,
                 arg_max(current_stock, row_num) AS current_stock, arg_max(status, row_num) FILTER (status IS NOT NULL) AS status FROM valid GROUP BY 1)
    SELECT coalesce(p.sku_code, u.sku_code) AS sku_code, coalesce(u.name, p.name) AS name, coalesce(u.base_price, p.base_price) AS base_price,
           p.unit_cost, coalesce(u.current_stock, p.current_stock) AS current_stock, coalesce(u.status, p.status) AS status
    FROM products p FULL OUTER JOIN u ON p.sku_code = u.sku_code""",
)
def import_products(spark, sf):
    return _import_products(spark, sf).tables["products"].select(
        "sku_code", "name", "base_price", "unit_cost", "current_stock", "status"
    )


@query(
    "import_products_summary",
    PRODUCT_ROWS_SQL
    + """n AS (SELECT count(DISTINCT sku_code) AS n FROM valid WHERE sku_code NOT IN (SELECT concat('SKU-', CAST(p_partkey AS VARCHAR)) FROM part))
    SELECT (SELECT count(*) FROM raw) AS total_rows, n AS rows_imported, (SELECT count(*) FROM valid) - n AS rows_updated, 0 AS rows_failed,
           (SELECT count(*) FROM raw) - (SELECT count(*) FROM valid) AS rows_skipped, (SELECT CAST(sum(warnings) AS BIGINT) FROM valid) AS warnings FROM n""",
)
def import_products_summary(spark, sf):
    return _import_products(spark, sf).summary


@query(
    "import_products_warnings",
    PRODUCT_ROWS_SQL
    + """odd AS (SELECT row_num, 'invalid base_price' AS warning FROM valid WHERE row_num < 10000000 AND (row_num - 1) % 5 = 0
             UNION ALL SELECT row_num, 'invalid status' FROM valid WHERE row_num < 10000000 AND (row_num - 1) % 4 = 1
             UNION ALL SELECT row_num, 'sku_code and name are required' FROM raw WHERE sku_code IS NULL OR name IS NULL)
    SELECT row_num, warning FROM odd""",
)
def import_products_warnings(spark, sf):
    return _import_products(spark, sf).warnings


@query(
    "import_products_ids",
    PRODUCT_ROWS_SQL
    + """ids AS (SELECT CAST(p_partkey AS BIGINT) AS id FROM part UNION ALL
            SELECT (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY sku_code)
            FROM (SELECT DISTINCT sku_code FROM valid WHERE sku_code NOT IN (SELECT concat('SKU-', CAST(p_partkey AS VARCHAR)) FROM part)))
    SELECT id FROM ids""",
)
def import_products_ids(spark, sf):
    return _import_products(spark, sf).tables["products"].select(F.col("id").cast("bigint").alias("id"))


@query(
    "assign_category_ids",
    """WITH names AS (SELECT DISTINCT p_brand AS name FROM part UNION SELECT DISTINCT concat('Type ', p_type) FROM part),
            c AS (SELECT n.name, k.id FROM names n LEFT JOIN categories k ON n.name = k.name)
       SELECT id IS NULL AS is_new, CASE WHEN id IS NULL THEN '' ELSE name END AS known_name,
              CASE WHEN id IS NULL THEN (SELECT max(id) FROM categories) + row_number() OVER (PARTITION BY id IS NULL ORDER BY name) ELSE id END AS id FROM c""",
    ["categories"],
)
def assign_category_ids(spark, sf):
    p = V.table(spark, sf, "part")
    names = p.select(F.col("p_brand").alias("name")).union(p.select(F.concat(F.lit("Type "), "p_type")))
    out = I.assign_category_ids(names, V.categories(spark, sf))
    return out.select("is_new", F.when(F.col("is_new"), "").otherwise(F.col("name")).alias("known_name"), "id")


def _order_rows(spark, sf):
    """An order file of all sales lines; the line number and part spoil some cells."""
    no, part = F.col("l_linenumber"), F.col("l_partkey")
    li = V.table(spark, sf, "lineitem").join(
        V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_totalprice"),
        on="l_orderkey",
        how="left",
    )
    return li.select(
        F.concat_ws(
            "-", "l_orderkey", "l_linenumber", "l_partkey", F.date_format("l_shipdate", "yyyyMMdd"), F.col("l_extendedprice").cast("decimal(18,2)")
        ).alias("row_num"),
        F.when(no != 1, F.concat(F.lit("ORD-"), F.col("l_orderkey").cast("string"))).otherwise(
            F.when(part % 9 != 0, F.concat(F.lit(" ORD-"), F.col("l_orderkey").cast("string")))
        ).alias("order_id"),
        F.when(no == 2, "not a date").when(no != 3, F.date_format("l_shipdate", "yyyy-MM-dd")).alias("order_date"),
        F.when(part % 13 == 0, F.lit("SKU-none"))
        .when(part % 17 == 0, F.lit(""))
        .otherwise(F.concat(F.lit("SKU-"), part.cast("string")))
        .alias("product_sku"),
        F.when(no == 4, "lots").otherwise(F.col("l_quantity").cast("string")).alias("quantity"),
        F.when((no == 5) & (part % 2 == 0), "?").otherwise(F.col("l_extendedprice").cast("string")).alias("price_at_sale"),
        F.when(F.col("o_custkey") % 4 != 0, F.concat(F.lit("Customer "), (F.col("o_custkey") % 400).cast("string"))).alias("customer_name"),
        F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("mail"), (F.col("o_custkey") % 60).cast("string"), F.lit("@example.com"))).alias(
            "customer_email"
        ),
        F.when(no == 6, " shipped ").alias("status"),
        F.when(no == 7, "much").otherwise(F.col("o_totalprice").cast("string")).alias("total_amount"),
    )


ORDER_ROWS_SQL = """
WITH src AS (
    SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, strftime(l_shipdate, '%Y%m%d'), printf('%.2f', l_extendedprice)) AS row_num,
           l_linenumber AS no, l_partkey AS part,
           CASE WHEN l_linenumber <> 1 OR l_partkey % 9 <> 0 THEN concat('ORD-', CAST(l_orderkey AS VARCHAR)) END AS order_key,
           l_shipdate AS ds, l_quantity AS quantity, l_extendedprice AS price_at_sale,
           CASE WHEN o_custkey % 4 <> 0 THEN concat('Customer ', CAST(o_custkey % 400 AS VARCHAR)) END AS customer_name,
           CASE WHEN o_custkey % 3 = 0 THEN concat('mail', CAST(o_custkey % 60 AS VARCHAR), '@example.com') END AS customer_email,
           CASE WHEN l_linenumber = 6 THEN 'shipped' END AS status, CASE WHEN l_linenumber <> 7 THEN o_totalprice END AS total_amount
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey),
checked AS (SELECT *, CASE WHEN order_key IS NULL THEN 'order_id is empty' WHEN part % 17 = 0 AND part % 13 <> 0 THEN 'product_sku is empty'
    WHEN no = 3 THEN 'order_date is required' WHEN no = 2 THEN 'invalid order_date' WHEN no = 4 THEN 'invalid quantity'
    WHEN no = 5 AND part % 2 = 0 THEN 'invalid price_at_sale' WHEN part % 13 = 0 THEN 'product_sku not found' END AS reason FROM src),
accepted AS (SELECT * FROM checked WHERE reason IS NULL),
customers AS (SELECT c_custkey AS id, concat('Customer ', CAST(c_custkey % 350 AS VARCHAR)) AS name,
                     CASE WHEN c_custkey % 7 = 0 THEN concat('mail', CAST(c_custkey % 20 AS VARCHAR), '@example.com') END AS email FROM customer),
first_seen AS (SELECT customer_name, row_num, customer_email AS email FROM (
    SELECT *, row_number() OVER (PARTITION BY customer_name ORDER BY row_num) AS rn FROM accepted WHERE customer_name IS NOT NULL) WHERE rn = 1),
found AS (SELECT f.*, coalesce(
        (SELECT min(id) FROM customers c WHERE c.email = f.email), (SELECT min(id) FROM customers c WHERE c.name = f.customer_name)) AS known FROM first_seen f),
owner AS (SELECT email, arg_min(customer_name, row_num) AS owner FROM found WHERE known IS NULL AND email IS NOT NULL GROUP BY email),
people AS (SELECT f.customer_name, f.email, f.known, CASE WHEN f.known IS NULL THEN coalesce(o.owner, f.customer_name) END AS made_for
           FROM found f LEFT JOIN owner o ON f.email = o.email)
"""


def _known_customers(spark, sf):
    key = F.col("c_custkey")
    return V.table(spark, sf, "customer").select(
        key.alias("id"),
        F.concat(F.lit("Customer "), (key % 350).cast("string")).alias("name"),
        F.when(key % 7 == 0, F.concat(F.lit("mail"), (key % 20).cast("string"), F.lit("@example.com"))).alias("email"),
    )


def _import_orders(spark, sf):
    return I.import_orders(_order_rows(spark, sf), V.products(spark, sf), _known_customers(spark, sf))


def _made(kind: str, name: str) -> str:
    h = f"md5(concat('{kind}|', {name}))"
    return f"concat_ws('-', substr({h}, 1, 8), substr({h}, 9, 4), substr({h}, 13, 4), substr({h}, 17, 4), substr({h}, 21, 12))"


@query(
    "import_orders_sales",
    ORDER_ROWS_SQL
    + f"""SELECT a.row_num, {_made('order', 'a.order_key')} AS order_id, CAST(a.part AS INT) AS product_id, strftime(a.ds, '%Y-%m-%d') AS ds,
        a.quantity, a.price_at_sale, CASE WHEN p.known IS NOT NULL THEN CAST(p.known AS VARCHAR) WHEN p.made_for IS NOT NULL THEN {_made('customer', 'p.made_for')} END AS customer_id
        FROM accepted a LEFT JOIN people p ON a.customer_name = p.customer_name""",
)
def import_orders_sales(spark, sf):
    sales = _import_orders(spark, sf).tables["sales"]
    return sales.withColumn("ds", F.date_format("ds", "yyyy-MM-dd"))


@query(
    "import_orders_summary",
    ORDER_ROWS_SQL
    + """SELECT count(*) AS total_rows, count(*) FILTER (reason IS NULL) AS rows_imported, 0 AS rows_updated,
        count(*) FILTER (reason LIKE 'invalid%' OR reason LIKE '%not found') AS rows_failed,
        count(*) FILTER (reason LIKE '%empty' OR reason LIKE '%required') AS rows_skipped FROM checked""",
)
def import_orders_summary(spark, sf):
    return _import_orders(spark, sf).summary


@query(
    "import_orders_rejects",
    ORDER_ROWS_SQL
    + """SELECT row_num, CASE WHEN reason LIKE 'invalid%' OR reason LIKE '%not found' THEN 'failed' ELSE 'skipped' END AS outcome, reason
        FROM checked WHERE reason IS NOT NULL""",
)
def import_orders_rejects(spark, sf):
    return _import_orders(spark, sf).rejects


@query(
    "resolve_customers",
    ORDER_ROWS_SQL
    + f"""SELECT customer_name, email, CASE WHEN known IS NOT NULL THEN CAST(known AS VARCHAR) ELSE {_made('customer', 'made_for')} END AS customer_id,
        coalesce(made_for = customer_name, FALSE) AS is_new FROM people""",
)
def resolve_customers(spark, sf):
    checked = I.check_orders(_order_rows(spark, sf), V.products(spark, sf))
    return I.resolve_customers(checked.filter("outcome = 'imported'"), _known_customers(spark, sf))


@query(
    "build_orders",
    ORDER_ROWS_SQL
    + f"""SELECT {_made('order', 'order_key')} AS id, order_key AS order_id, strftime(ds, '%Y-%m-%d') AS order_date, coalesce(status, 'pending') AS status, total_amount
        FROM (SELECT *, row_number() OVER (PARTITION BY order_key ORDER BY row_num) AS rn FROM accepted) WHERE rn = 1""",
)
def build_orders(spark, sf):
    orders = _import_orders(spark, sf).tables["orders"]
    return orders.withColumn("order_date", F.date_format("order_date", "yyyy-MM-dd")).drop("customer_id")


def _two_loads(spark, sf):
    """The feed in two loads: every third line comes late, and the second load repeats the first.

    Both loads hold lines of the same orders. Returns the folder.
    """
    feed, out = V.order_feed(spark, sf), scratch_path(spark, "loads")
    O.load_orders(feed.filter("line_no % 3 <> 0"), out, V.FEED_MAPPING, 7, "a")
    O.load_orders(feed, out, V.FEED_MAPPING, 7, "b")
    return out


@query("two_loads_facts", ITEM_SQL, ["items"])
def two_loads_facts(spark, sf):
    return _shown(O.read_loaded(spark, _two_loads(spark, sf), "fact_sales"))


@query("two_loads_demand", DEMAND_SQL, ["items"])
def two_loads_demand(spark, sf):
    return _demand_shown(O.read_loaded(spark, _two_loads(spark, sf), "agg_daily_demand"))


@query(
    "two_loads_backlog",
    """SELECT l_orderkey AS order_id, o_custkey AS customer_id, strftime(o_orderdate, '%Y-%m-%d') AS order_date, count(*) AS messages,
              count(*) FILTER (l_linenumber IN (4, 7)) AS dead
       FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3""",
)
def two_loads_backlog(spark, sf):
    out = _two_loads(spark, sf)
    dead = O.read_loaded(spark, out, "dead_letters").groupBy("order_id").agg(F.count("*").alias("dead"))
    backlog = O.read_loaded(spark, out, "orders_backlog").groupBy("order_id", "customer_id", F.date_format("order_date", "yyyy-MM-dd").alias("order_date"))
    counts = backlog.agg(F.count("*").alias("messages"))
    return counts.join(dead.withColumn("order_id", F.col("order_id").cast("bigint")), "order_id", "left").withColumn("dead", F.coalesce("dead", F.lit(0)))


@query(
    "two_loads_customers",
    """SELECT customer_id, name, CAST(NULL AS VARCHAR) AS email, segment, CAST(NULL AS VARCHAR) AS region FROM (
         SELECT o_custkey AS customer_id, concat(name, '/', o_orderpriority) AS name, segment,
                row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn
         FROM orders JOIN customers ON o_custkey = id WHERE o_orderkey % 11 <> 0) WHERE rn = 1""",
    ["customers"],
)
def two_loads_customers(spark, sf):
    """Customers whose earliest order is in either load."""
    orders, out = _order_customers(spark, sf), scratch_path(spark, "loads")
    O.load_orders(orders.filter("ord % 2 = 0"), out, V.FEED_MAPPING, 7, "a")
    O.load_orders(orders.filter("ord % 2 = 1"), out, V.FEED_MAPPING, 7, "b")
    return O.read_loaded(spark, out, "dim_customers")


SYNCED_SQL = """SELECT CASE WHEN sale_date IS NULL THEN 'dead' ELSE 'loaded' END AS state, l_orderkey AS order_id, count(*) AS messages
       FROM (SELECT l_orderkey, CASE WHEN l_linenumber <> 2 THEN o_orderdate END AS sale_date FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey)
       GROUP BY 1, 2"""


def _partly_undated(spark, sf):
    return V.order_feed(spark, sf).withColumn("placed", F.when(F.col("line_no") != 2, F.col("placed")))


def _synced(spark, arrivals):
    """What is loaded and what is a dead letter after syncs of each arrival into one folder."""
    out, marks = scratch_path(spark, "sync"), spark.createDataFrame([], Y.MARK_SCHEMA)
    for arrived in arrivals:
        _, marks = Y.incremental_sync(arrived, marks, 7, out, "order_date", V.FEED_MAPPING)
    loaded = O.read_loaded(spark, out, "orders_backlog").select(F.lit("loaded").alias("state"), F.col("order_id").cast("bigint").alias("order_id"))
    dead = O.read_loaded(spark, out, "dead_letters").filter(F.col("reason") == O.UNDATED)
    dead = dead.select(F.lit("dead").alias("state"), F.col("order_id").cast("bigint").alias("order_id"))
    return loaded.unionByName(dead).groupBy("state", "order_id").agg(F.count("*").alias("messages"))


@query("incremental_sync_one_mark", SYNCED_SQL)
def incremental_sync_one_mark(spark, sf):
    """Three syncs between which the mark does not move: of the newest day, and of the undated rows, a third comes each time."""
    feed = _partly_undated(spark, sf)
    newest = F.lit(feed.agg(F.max("placed").cast("string").alias("m")).first()["m"]).cast("timestamp_ntz")
    there = F.coalesce(F.col("placed") < newest, F.lit(False))
    return _synced(spark, [feed.filter(there | (F.col("ord") % 3 <= k)) for k in range(3)])


@query("incremental_sync_out_of_order", SYNCED_SQL)
def incremental_sync_out_of_order(spark, sf):
    """The newest years come first, then the oldest, then those between, then everything again."""
    feed = _partly_undated(spark, sf)
    year = F.year("placed")
    return _synced(spark, [feed.filter(year >= 1997), feed.filter(year < 1995), feed.filter(year.between(1995, 1996)), feed])


@query("incremental_sync", SYNCED_SQL)
def incremental_sync(spark, sf):
    """Three syncs into one folder: half the messages up to a day, the others up to it, then all.

    Every second line is without a date. Messages loaded and dead letters make up the input.
    """
    feed = _partly_undated(spark, sf)
    newest = F.lit(dt.datetime(1998, 6, 30)).cast("timestamp_ntz")
    early = feed.filter((F.col("placed") <= newest) | F.col("placed").isNull())
    at_mark = F.col("placed") == early.agg(F.max("placed").alias("m")).first()["m"]
    first = early.filter(~F.coalesce(at_mark, F.lit(False)) | (F.col("line_no") % 3 == 0))  # others of the mark's day come later
    return _synced(spark, [first.unionByName(feed.filter(at_mark & (F.col("line_no") == 1))), early, feed])


def _demand_stage(number: int, which: str) -> str:
    return f"""SELECT {number} AS stage, product_id, strftime(sale_date, '%Y-%m-%d') AS sale_date, round(sum(quantity), 4) AS total_qty,
        round(sum(gross_sale), 2) AS total_revenue, count(DISTINCT ord) AS order_count
        FROM items WHERE product_id IS NOT NULL AND sale_date IS NOT NULL AND {which} GROUP BY 2, 3"""


@query(
    "demand_after_loads",
    " UNION ALL ".join(
        _demand_stage(i, which) for i, which in enumerate(["ord % 3 <> 0", "(ord % 3 <> 0 OR ord % 2 = 0)", "(ord % 5 = 0 OR ord % 2 = 0)", "TRUE"], 1)
    ),
    ["items"],
)
def demand_after_loads(spark, sf):
    """The demand table after each of four loads; the second overlaps with the first, the third replaces the first."""
    feed, out = V.order_feed(spark, sf), scratch_path(spark, "demand")
    stages = []
    for number, (key, which) in enumerate([("a", "ord % 3 <> 0"), ("b", "ord % 2 = 0"), ("a", "ord % 5 = 0"), ("c", "TRUE")], 1):
        O.load_orders(feed.filter(which), out, V.FEED_MAPPING, 7, key)
        shown = _demand_shown(O.read_loaded(spark, out, "agg_daily_demand")).select(F.lit(number).alias("stage"), "*")
        path = scratch_path(spark, "stage")
        shown.write.parquet(path)  # the table moves on
        stages.append(spark.read.parquet(path))
    return reduce(DataFrame.unionByName, stages)


@query(
    "explode_orders_trailing_text",
    """SELECT o_orderkey AS order_id, CAST(o_custkey AS VARCHAR) AS product_id, CAST(1 AS DOUBLE) AS quantity FROM orders WHERE o_orderkey % 5 = 0""",
)
def explode_orders_trailing_text(spark, sf):
    """Item lists with more text after the array are no item lists."""
    key = F.col("o_orderkey")
    array = F.concat(F.lit('[{"product_id": '), F.col("o_custkey").cast("string"), F.lit(', "quantity": 1, "unit_price": 2}]'))
    tail = F.when(key % 5 == 1, " []").when(key % 5 == 2, ", []").when(key % 5 == 3, "]").when(key % 5 == 4, ' {"a": 1}]').otherwise(" \n")
    rows = V.table(spark, sf, "orders").select(key.alias("order_id"), F.col("o_orderdate").alias("order_date"), F.concat(array, tail).alias("items"))
    return O.explode_orders(rows).select("order_id", "product_id", "quantity")


@query(
    "sync_marks",
    """SELECT 7 AS source_id, strftime(max(o_orderdate), '%Y-%m-%d') AS last_synced, (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM items) AS rows_synced
       FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""",
    ["items"],
)
def sync_marks(spark, sf):
    marks = spark.createDataFrame([], Y.MARK_SCHEMA)
    _, marks = Y.incremental_sync(V.order_feed(spark, sf), marks, 7, scratch_path(spark, "sync"), "order_date", V.FEED_MAPPING)
    return marks.select("source_id", F.date_format("last_synced_at", "yyyy-MM-dd").alias("last_synced"), "rows_synced")


@query(
    "sources_due",
    """WITH m AS (SELECT o_custkey AS id, max(o_orderdate) AS mark FROM orders GROUP BY 1),
            s AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 2400 WHEN 2 THEN NULL ELSE 6 END AS h FROM customer)
       SELECT s.id FROM s LEFT JOIN m ON s.id = m.id
       WHERE coalesce(h, 6) <> 0 AND (mark IS NULL OR epoch(TIMESTAMP '2001-06-01' - mark) > coalesce(h, 6) * 3600.0)""",
)
def sources_due(spark, sf):
    """Customers as sources, their newest order as the last sync."""
    key = F.col("c_custkey")
    hours = F.when(key % 4 == 0, 0).when(key % 4 == 1, 2400).when(key % 4 == 3, 6)
    sources = V.table(spark, sf, "customer").select(key.alias("id"), hours.alias("sync_interval_hours"))
    marks = V.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("source_id")).agg(
        F.max("o_orderdate").cast("timestamp").alias("last_synced_at")
    )
    return Y.sources_due(sources, marks, F.lit("2001-06-01 00:00:00")).select("id")


@query(
    "ingest_orders",
    """SELECT 'orders_backlog' AS "table", count(*) AS rows, TRUE AS counted FROM lineitem
       UNION ALL SELECT 'fact_sales', count(*), TRUE FROM items
       UNION ALL SELECT 'dim_customers', count(DISTINCT o_custkey), FALSE FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       UNION ALL SELECT 'agg_daily_demand', count(*), FALSE FROM (SELECT DISTINCT product_id, sale_date FROM items WHERE sale_date IS NOT NULL)
       UNION ALL SELECT 'dead_letters', count(*), FALSE FROM lineitem WHERE l_linenumber IN (4, 7)""",
    ["items"],
)
def ingest_orders(spark, sf):
    feed = V.order_feed(spark, sf)
    return ingest(feed, scratch_path(spark, "ingest"), "order_feed", "orders", mapping=V.FEED_MAPPING, source_id=7).loaded


@query(
    "ingest_table",
    """WITH src AS (SELECT *, l_quantity AS q, l_extendedprice AS p FROM lineitem),
            b AS (SELECT quantile_cont(q, 0.05) AS q1, quantile_cont(q, 0.95) AS q2, quantile_cont(p, 0.05) AS p1, quantile_cont(p, 0.95) AS p2
                  FROM src WHERE l_linenumber <> 7)
       SELECT 'sales' AS "table", count(*) AS rows, TRUE AS counted FROM src, b WHERE l_linenumber <> 7 AND q > q1 AND q < q2 AND p > p1 AND p < p2""",
)
def ingest_table(spark, sf):
    no = F.col("l_linenumber")
    rows = V.table(spark, sf, "lineitem").select(
        F.col("l_partkey").cast("string").alias("product_id"),
        F.when(no == 7, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_shipdate").cast("timestamp").alias("date"),
    )
    return ingest(rows, scratch_path(spark, "ingest"), "sales", "table", columns=["quantity", "price"]).loaded


