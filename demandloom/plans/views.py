"""The supplied tables seen as the retail domain, in Spark and as SQL text with the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.session import scratch_path, short_shuffles


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def products(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(
        key.cast("int").alias("id"),
        F.concat(F.lit("SKU-"), key.cast("string")).alias("sku_code"),
        F.col("p_name").alias("name"),
        F.regexp_extract("p_brand", r"(\d+)$", 1).try_cast("int").alias("category_id"),
        F.col("p_retailprice").alias("base_price"),
        F.round(F.col("p_retailprice") * 0.6, 2).alias("unit_cost"),
        ((key * 7) % 120).cast("int").alias("current_stock"),
        F.col("p_size").alias("safety_stock"),
        F.when(key % 20 == 0, "retired").when(key % 33 == 0, "draft").otherwise("active").alias("status"),
    )


def categories(spark: SparkSession, sf: str) -> DataFrame:
    """Every second brand is a named category, the others are left uncategorised."""
    brand = table(spark, sf, "part").select("p_brand").distinct()
    return brand.select(
        F.regexp_extract("p_brand", r"(\d+)$", 1).try_cast("int").alias("id"), F.col("p_brand").alias("name")
    ).filter(F.col("id") % 2 == 0)


def sales(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").cast("int").alias("product_id"),
        F.col("l_shipdate").alias("ds"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price_at_sale"),
    )


def sales_with_customer(spark: SparkSession, sf: str) -> DataFrame:
    """Only where the customer is needed: the join with the orders is a shuffle."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"))
    return sales(spark, sf).join(orders, on="order_id", how="left")


def customers(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("region"))
    return (
        table(spark, sf, "customer")
        .join(nation, on="c_nationkey")
        .select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("name"),
            "region",
            F.col("c_mktsegment").alias("segment"),
            F.col("c_acctbal").alias("ltv"),
        )
    )


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


# The column names of the order feed, as a registered source would map them.
FEED_MAPPING = {
    "order_id": "ord",
    "order_date": "placed",
    "customer_id": "cust",
    "customer_name": "cust_name",
    "customer_segment": "cust_segment",
    "status": "state",
    "total_amount": "total",
    "items_column": "lines",
    "product_id": "sku",
    "quantity": "qty",
    "unit_price": "price",
    "discount": "off",
}


def order_feed(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON order message per sales line; the line number decides how the message is spoiled.

    1-3: the line plus an item with a null price; 4: an object instead of a list; 5: no discount;
    6: quantity as a word; 7: cut-off JSON.
    """
    li, no = table(spark, sf, "lineitem"), F.col("l_linenumber")

    def item(quantity, with_discount=True):
        parts = [
            F.lit('{"sku": '),
            F.col("l_partkey").cast("string"),
            F.lit(', "qty": '),
            quantity,
            F.lit(', "price": "'),
            F.col("l_extendedprice").cast("string"),
            F.lit('"'),
        ]
        if with_discount:
            parts += [F.lit(', "off": '), F.col("l_discount").cast("string")]
        return F.concat(*parts, F.lit("}"))

    quantity = F.col("l_quantity").cast("string")
    spoiled = F.concat(F.lit(', {"sku": "gift", "qty": 1, "price": null}]'))
    lines = (
        F.when(no <= 3, F.concat(F.lit("["), item(quantity), spoiled))
        .when(no == 4, item(quantity))
        .when(no == 5, F.concat(F.lit("["), item(quantity, False), F.lit("]")))
        .when(no == 6, F.concat(F.lit("["), item(F.lit('"many"')), F.lit("]")))
        .otherwise(F.concat(F.lit("["), item(quantity), F.lit(", {")))
    )
    headers = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("ord"),
        F.col("o_custkey").alias("cust"),
        F.col("o_orderstatus").alias("state"),
        F.col("o_totalprice").alias("total"),
        F.col("o_orderdate").alias("placed"),
    )
    # the texts are made after the join, which then shuffles the numbers they are made of
    parts = ("l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_linenumber")
    messages = li.select(F.col("l_orderkey").alias("ord"), *parts).join(headers, on="ord", how="left")
    return messages.select("ord", no.alias("line_no"), lines.alias("lines"), "cust", "state", "total", "placed")


def with_shifted_key(df: DataFrame, key: str, every: int, rest: int = 0) -> DataFrame:
    """All rows, with the keys that leave ``rest`` modulo ``every`` moved so far that they match nothing."""
    c = F.col(key)
    return df.withColumn(key, F.when(c % every == rest, c + SHIFT).otherwise(c).cast(df.schema[key].dataType))


#: Added to keys that shall match nothing.
SHIFT = 1_000_000_000


def folder_of(spark: SparkSession, df: DataFrame, name: str, files: int | None = None, least: int | None = None) -> str:
    """The frame written as a parquet folder in the shared scratch space, see ``write_files``."""
    path = scratch_path(spark, name)
    write_files(spark, df, path, files, least)
    return path


def write_files(spark: SparkSession, df: DataFrame, path: str, files: int | None = None, least: int | None = None) -> None:
    """Add the frame to a parquet folder.

    It is dealt out to ``files`` files. Are there more than ``least``, its tasks write what they have,
    ``ROWS_PER_FILE`` to a file at most, since a shuffle of all rows would only even out the files.
    """
    dealt = df if files is None or (least is not None and files > least) else df.repartition(files)
    writer = dealt.write.mode("append").option("compression", "zstd").option("maxRecordsPerFile", ROWS_PER_FILE)
    with short_shuffles(spark):
        writer.parquet(path)


def half_of(spark: SparkSession, folder: str) -> int:
    """Half the files of a parquet folder, rounded up: it is read in two batches."""
    return -(-len(spark.read.parquet(folder).inputFiles()) // 2) or 1


#: Rows of a file that stands for arriving data, so that no task writes or reads more of them when the tables grow.
ROWS_PER_FILE = 400_000


def files_for(spark: SparkSession, sf: str, name: str, least: int = 1) -> int:
    """How many files hold the rows of a table, as many as ``least`` if it is small, and a multiple of it."""
    return least * -(-table(spark, sf, name).count() // (ROWS_PER_FILE * least) or -1)


# The same views as SQL text, for the comparison engine.
SQL_VIEWS = {
    "products": """
        SELECT CAST(p_partkey AS INT) AS id, concat('SKU-', CAST(p_partkey AS VARCHAR)) AS sku_code, p_name AS name,
               CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) AS category_id,
               p_retailprice AS base_price, round(p_retailprice * 0.6, 2) AS unit_cost,
               CAST((p_partkey * 7) % 120 AS INT) AS current_stock, p_size AS safety_stock,
               CASE WHEN p_partkey % 20 = 0 THEN 'retired' WHEN p_partkey % 33 = 0 THEN 'draft' ELSE 'active' END AS status
        FROM part""",
    "categories": """
        SELECT id, name FROM (SELECT DISTINCT CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) AS id, p_brand AS name FROM part)
        WHERE id % 2 = 0""",
    "sales": """
        SELECT CAST(l_partkey AS INT) AS product_id, l_shipdate AS ds, l_orderkey AS order_id, l_linenumber AS line_no,
               l_quantity AS quantity, l_extendedprice / l_quantity AS price_at_sale
        FROM lineitem""",
    "customers": """
        SELECT c_custkey AS id, c_name AS name, n_name AS region, c_mktsegment AS segment, c_acctbal AS ltv
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "items": """
        SELECT ord, sku AS product_id, qty AS quantity, price AS unit_price, off AS discount,
               qty * price AS gross_sale, qty * price - off AS net_sale, placed AS sale_date
        FROM (
            SELECT l_orderkey AS ord, o_orderdate AS placed, CAST(l_partkey AS VARCHAR) AS sku,
                   CASE WHEN l_linenumber = 6 THEN 0.0 ELSE l_quantity END AS qty,
                   CASE WHEN l_linenumber = 6 THEN 0.0 ELSE l_extendedprice END AS price,
                   CASE WHEN l_linenumber IN (5, 6) THEN 0.0 ELSE l_discount END AS off
            FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber IN (1, 2, 3, 5, 6)
            UNION ALL
            SELECT l_orderkey, o_orderdate, 'gift', 0.0, 0.0, 0.0
            FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <= 3
        )""",
    "daily": """
        SELECT product_id, CAST(ds AS DATE) AS day, sum(quantity) AS quantity, count(*) AS sale_rows FROM sales GROUP BY 1, 2""",
    "weekly": """
        SELECT product_id, CAST(date_trunc('week', day) AS DATE) AS wk, sum(quantity) AS quantity, count(*) AS sale_days
        FROM daily GROUP BY 1, 2""",
    "weekly_filled": """
        SELECT s.product_id, s.wk, coalesce(w.quantity, 0) AS quantity, coalesce(w.sale_days, 0) AS sale_days
        FROM (SELECT product_id, CAST(unnest(generate_series(min(wk), max(wk), INTERVAL 7 DAY)) AS DATE) AS wk
              FROM weekly GROUP BY product_id) s
        LEFT JOIN weekly w ON s.product_id = w.product_id AND s.wk = w.wk""",
    "complete_weeks": """
        SELECT product_id, wk, quantity FROM (
            SELECT *, lead(wk) OVER (PARTITION BY product_id ORDER BY wk) AS nxt FROM weekly_filled)
        WHERE NOT (nxt IS NULL AND sale_days < 7)""",
    "monthly_filled": """
        SELECT s.product_id, s.mo, coalesce(m.quantity, 0) AS quantity
        FROM (SELECT product_id, CAST(unnest(generate_series(min(date_trunc('month', day)), max(date_trunc('month', day)), INTERVAL 1 MONTH)) AS DATE) AS mo
              FROM daily GROUP BY product_id) s
        LEFT JOIN (SELECT product_id, CAST(date_trunc('month', day) AS DATE) AS mo, sum(quantity) AS quantity FROM daily GROUP BY 1, 2) m
               ON s.product_id = m.product_id AND s.mo = m.mo""",
}
_NEEDS = {
    "daily": ("sales",),
    "weekly": ("daily",),
    "weekly_filled": ("weekly",),
    "complete_weeks": ("weekly_filled",),
    "monthly_filled": ("daily",),
}


def with_views(names: tuple[str, ...] | list[str], body: str) -> str:
    """``body`` behind the WITH clauses it needs."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, ()):
            add(n)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        add(n)
    if not ordered:
        return body
    clauses = ", ".join(f"{n} AS ({SQL_VIEWS[n]})" for n in ordered)
    rest = body.lstrip()
    # a body with clauses of its own continues the list
    joint = ",\n" + rest[len("WITH ") :] if rest.startswith("WITH ") else "\n" + rest
    return "WITH " + clauses + joint
