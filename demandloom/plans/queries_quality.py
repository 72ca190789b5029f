"""Registered queries: profiling, validation, rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom.functions import is_empty
from demandloom.operators import profiling as P
from demandloom.operators import quality as Q
from demandloom.plans import views as V
from demandloom.plans.registry import query
from demandloom.session import scratch_path
from demandloom.sources import writers

ISO = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2})?)?"
EMAIL = r"^[\w.+-]+@[\w-]+\.[\w.]+$"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def _profile_part(column: str, kind: str) -> str:
    """One row of the profile of lineitem as SQL."""
    number = kind in ("integer", "float")
    lo = f"CAST(min({column}) AS DOUBLE)" if number else "CAST(NULL AS DOUBLE)"
    hi = f"CAST(max({column}) AS DOUBLE)" if number else "CAST(NULL AS DOUBLE)"
    t_lo = f"strftime(min({column}), '%Y-%m-%dT%H:%M:%S')" if kind == "datetime" else "CAST(NULL AS VARCHAR)"
    t_hi = f"strftime(max({column}), '%Y-%m-%dT%H:%M:%S')" if kind == "datetime" else "CAST(NULL AS VARCHAR)"
    inferred = f"'{kind}'"
    if kind == "float":
        inferred = f"CASE WHEN bool_and({column} = floor({column})) THEN 'integer' ELSE 'float' END"
    return f"""SELECT '{column}' AS name, {inferred} AS inferred_type, count(*) AS record_count,
        count(*) > count({column}) AS nullable, count(*) - count({column}) AS null_count,
        CAST(printf('%.4f', (count(*) - count({column})) / count(*)) AS DOUBLE) AS null_percentage, count(DISTINCT {column}) AS unique_count,
        CAST(printf('%.4f', count(DISTINCT {column}) / count(*)) AS DOUBLE) AS cardinality_ratio,
        {lo} AS min_number, {hi} AS max_number, {t_lo} AS min_time, {t_hi} AS max_time FROM src"""


_LINEITEM = {
    "l_orderkey": "integer",
    "l_partkey": "integer",
    "l_linenumber": "integer",
    "l_quantity": "float",
    "l_extendedprice": "float",
    "l_tax": "float",
    "l_returnflag": "string",
    "l_shipdate": "datetime",
}
_HOLED_SQL = """WITH src AS (SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice,
    CASE WHEN l_linenumber >= 3 THEN l_tax END AS l_tax, l_returnflag, l_shipdate FROM lineitem) """


def _holed(spark, sf):
    """lineitem with NaN in a column that is mostly present elsewhere."""
    missing = F.when(F.col("l_linenumber") >= 3, F.col("l_tax")).otherwise(F.lit(float("nan")))
    return V.table(spark, sf, "lineitem").withColumn("l_tax", missing).select(*_LINEITEM)


PROFILE_COLUMNS = [
    "name", "inferred_type", "record_count", "nullable", "null_count", "null_percentage", "unique_count",
    "cardinality_ratio", "min_number", "max_number", "min_time", "max_time",
]


@query("profile_lineitem", _HOLED_SQL + " UNION ALL ".join(_profile_part(c, k) for c, k in _LINEITEM.items()))
def profile_lineitem(spark, sf):
    return P.profile(_holed(spark, sf)).select(*PROFILE_COLUMNS)


@query(
    "profile_documents",
    """SELECT 'text' AS name, count(DISTINCT text) AS unique_count, count(*) - count(text) AS null_count FROM documents
       UNION ALL SELECT 'lang', count(DISTINCT lang), count(*) - count(lang) FROM documents
       UNION ALL SELECT 'source', count(DISTINCT source), count(*) - count(source) FROM documents
       UNION ALL SELECT 'n_chars', count(DISTINCT n_chars), count(*) - count(n_chars) FROM documents""",
)
def profile_documents(spark, sf):
    df = V.table(spark, sf, "documents")
    return P.profile(df, ["text", "lang", "source", "n_chars"]).select("name", "unique_count", "null_count")


@query(
    "infer_types",
    """SELECT 'event_id' AS name, 'integer' AS inferred_type FROM events HAVING count(*) > 0
       UNION ALL SELECT 'ts_text', CASE WHEN avg(CASE WHEN regexp_matches(CAST(ts AS VARCHAR), '^\\d{4}-\\d{2}-\\d{2}') THEN 1 ELSE 0 END) > 0.8
                                        THEN 'datetime' ELSE 'string' END FROM events
       UNION ALL SELECT 'props', CASE WHEN avg(CASE WHEN json_valid(props) AND regexp_matches(props, '^\\s*[\\[{]') THEN 1 ELSE 0 END) > 0.5
                                      THEN 'json' ELSE 'string' END FROM events
       UNION ALL SELECT 'event_type', 'string' FROM events HAVING count(event_type) > 0
       UNION ALL SELECT 'value', CASE WHEN bool_and(value = floor(value)) THEN 'integer' ELSE 'float' END FROM events
       UNION ALL SELECT 'nothing', 'unknown'
       UNION ALL SELECT 'unlike', CASE WHEN greatest(a, b, c) < 0.8 THEN 'mixed' ELSE 'other' END FROM (
            SELECT avg(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS a, avg(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS b,
                   avg(CASE WHEN event_type NOT IN ('error', 'view') THEN 1 ELSE 0 END) AS c FROM events)""",
)
def infer_types(spark, sf):
    e = V.events(spark, sf)
    unlike = (
        F.when(F.col("event_type") == "error", F.col("event_id").cast("string"))
        .when(F.col("event_type") == "view", F.lit("true"))
        .otherwise(F.col("event_type"))
    )
    df = e.select(
        "event_id",
        F.col("ts").cast("string").alias("ts_text"),
        "props",
        "event_type",
        "value",
        F.lit(None).cast("string").alias("nothing"),
    )
    plain = P.infer_types(df)
    return plain.unionByName(P.infer_types(e.select(unlike.alias("unlike")), text_kinds=True))


@query(
    "detect_pattern",
    rf"""WITH src AS (
        SELECT CAST(ts AS VARCHAR) AS stamp, concat(event_type, '.', CAST(user_id AS VARCHAR), '@example.com') AS mail,
               concat(left(md5(CAST(event_id AS VARCHAR)), 8), '-', substr(md5(CAST(event_id AS VARCHAR)), 9, 4), '-',
                      substr(md5(CAST(event_id AS VARCHAR)), 13, 4), '-', substr(md5(CAST(event_id AS VARCHAR)), 17, 4), '-',
                      substr(md5(CAST(event_id AS VARCHAR)), 21, 12)) AS uid, event_type AS plain FROM events),
       long AS (SELECT 'stamp' AS name, stamp AS v FROM src UNION ALL SELECT 'mail', mail FROM src
                UNION ALL SELECT 'uid', uid FROM src UNION ALL SELECT 'plain', plain FROM src),
       s AS (SELECT name, avg(CASE WHEN regexp_matches(v, '{ISO}') THEN 1 ELSE 0 END) AS iso,
                    avg(CASE WHEN regexp_matches(v, '{UUID}') THEN 1 ELSE 0 END) AS uu,
                    avg(CASE WHEN regexp_matches(v, '{EMAIL}') THEN 1 ELSE 0 END) AS em FROM long GROUP BY name)
       SELECT name, CASE WHEN iso > 0.8 THEN 'ISO-8601' WHEN uu > 0.8 THEN 'UUID' WHEN em > 0.8 THEN 'email' END AS detected_pattern FROM s""",
)
def detect_pattern(spark, sf):
    h = F.md5(F.col("event_id").cast("string").cast("binary"))
    uid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    df = V.events(spark, sf).select(
        F.col("ts").cast("string").alias("stamp"),
        F.concat(F.col("event_type"), F.lit("."), F.col("user_id").cast("string"), F.lit("@example.com")).alias("mail"),
        uid.alias("uid"),
        F.col("event_type").alias("plain"),
    )
    return P.detect_pattern(df)


@query("nested_keys", "SELECT DISTINCT unnest(json_keys(props)) AS key FROM events")
def nested_keys(spark, sf):
    return P.nested_keys(V.events(spark, sf), "props")


@query("sample_values")
def sample_values(spark, sf):
    return P.sample_values(V.table(spark, sf, "orders"))


@query(
    "schema_issues",
    """WITH src AS (SELECT CASE WHEN l_linenumber = 1 THEN l_tax END AS sparse, CASE WHEN l_linenumber <= 3 THEN l_tax END AS half,
                           CASE WHEN l_linenumber = 1 AND l_quantity > 45 THEN l_tax END AS nearly_empty, l_tax AS full_one FROM lineitem),
       s AS (SELECT 'sparse' AS field, (count(*) - count(sparse)) / count(*) AS p FROM src
             UNION ALL SELECT 'half', (count(*) - count(half)) / count(*) FROM src
             UNION ALL SELECT 'nearly_empty', (count(*) - count(nearly_empty)) / count(*) FROM src
             UNION ALL SELECT 'full_one', (count(*) - count(full_one)) / count(*) FROM src)
       SELECT field, CASE WHEN p >= 0.9 THEN 'critical' ELSE 'warning' END AS severity,
              concat('Column has ', printf('%.0f', p * 100), CASE WHEN p >= 0.9 THEN '% null values — nearly empty.' ELSE '% null values.' END) AS message
       FROM s WHERE p >= 0.5
       UNION ALL SELECT 'nothing', 'critical', 'Column has 100% null values — nearly empty.'
       UNION ALL SELECT 'nothing', 'warning', 'Could not determine data type for this column.'""",
)
def schema_issues(spark, sf):
    no, tax = F.col("l_linenumber"), F.col("l_tax")
    df = V.table(spark, sf, "lineitem").select(
        F.when(no == 1, tax).alias("sparse"),
        F.when(no <= 3, tax).alias("half"),
        F.when((no == 1) & (F.col("l_quantity") > 45), tax).alias("nearly_empty"),
        tax.alias("full_one"),
        F.lit(None).cast("string").alias("nothing"),
    )
    return P.schema_issues(P.profile(df, approximate_unique=True))


@query(
    "validate_schema",
    """SELECT 'c_phone' AS field, 'critical' AS severity, 'Expected column ''c_phone'' is missing from the DataFrame.' AS message
       UNION ALL SELECT 'extra', 'warning', 'Unexpected column ''extra'' found (not in schema).'
       UNION ALL SELECT 'c_acctbal', 'warning', concat('Column was not nullable in schema but has ',
            CAST(count(*) FILTER (c_acctbal < 0) AS VARCHAR), ' null value(s).') FROM customer HAVING count(*) FILTER (c_acctbal < 0) > 0""",
)
def validate_schema(spark, sf):
    c = V.table(spark, sf, "customer")
    expected = P.profile(c.withColumn("c_phone", F.lit("x")), approximate_unique=True)
    actual = c.withColumn("c_acctbal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))).withColumn("extra", F.lit(1))
    return P.validate_schema(actual, expected, strict=True)


@query(
    "schema_drift",
    """SELECT 'o_orderpriority' AS field, 'removed' AS change, 'string' AS previous, NULL AS current, TRUE AS breaking FROM orders HAVING count(*) > 0
       UNION ALL SELECT 'channel', 'added', NULL, 'string', FALSE
       UNION ALL SELECT 'o_custkey', 'type', 'integer', 'string', TRUE
       UNION ALL SELECT 'o_totalprice', 'nullability', 'false', 'true', FALSE FROM orders HAVING count(*) FILTER (o_totalprice < 50000) > 0""",
)
def schema_drift(spark, sf):
    before = V.table(spark, sf, "orders")
    after = (
        before.drop("o_orderpriority")
        .withColumn("channel", F.lit("web"))
        .withColumn("o_custkey", F.concat(F.lit("C"), F.col("o_custkey").cast("string")))
        .withColumn("o_totalprice", F.when(F.col("o_totalprice") >= 50000, F.col("o_totalprice")))
    )
    return P.schema_drift(P.profile(before, approximate_unique=True), P.profile(after, approximate_unique=True))


@query("profile_history", "SELECT name FROM (SELECT unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS name) WHERE (SELECT count(*) FROM nation) > 0")
def profile_history(spark, sf):
    path = scratch_path(spark, "profiles")
    P.save_profile(P.profile(V.table(spark, sf, "region")), path, "geo")
    P.save_profile(P.profile(V.table(spark, sf, "nation")), path, "geo")
    return P.latest_profile(spark, path, "geo").select("name")


@query(
    "run_log",
    """SELECT 'events' AS source_name, 6 AS field_count, count(*) AS record_count, 0 AS issue_count,
              0 AS nullable_field_count, 1 AS nested_field_count FROM events""",
)
def run_log(spark, sf):
    profile = P.profile(V.events(spark, sf), approximate_unique=True)
    return writers.run_log(profile, P.schema_issues(profile), "events").drop("params", "logged_at")


@query(
    "cast_to_profile",
    """SELECT l_orderkey AS id, CASE WHEN l_linenumber = 2 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS quantity,
              CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice END AS price,
              CASE WHEN l_linenumber = 4 THEN NULL ELSE strftime(l_shipdate, '%Y-%m-%d') END AS shipped FROM lineitem""",
)
def cast_to_profile(spark, sf):
    no = F.col("l_linenumber")
    df = V.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("id"),
        F.when(no == 2, "few").otherwise(F.col("l_quantity").cast("string")).alias("quantity"),
        F.when(no == 3, "free").otherwise(F.col("l_extendedprice").cast("string")).alias("price"),
        F.when(no == 4, "soon").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("shipped"),
    )
    types = {"id": "integer", "quantity": "integer", "price": "float", "shipped": "datetime"}
    return Q.cast_to_profile(df, types).withColumn("shipped", F.date_format("shipped", "yyyy-MM-dd"))


@query(
    "quality_check",
    """WITH src AS (SELECT l_returnflag, l_linestatus, CASE WHEN l_linenumber = 1 THEN l_linenumber END AS a,
                           CASE WHEN l_linenumber <= 4 THEN l_linenumber END AS b,
                           CASE WHEN l_quantity > 49 AND l_linenumber = 1 THEN 1 END AS c FROM lineitem),
       n AS (SELECT count(*) AS n, count(a) AS a, count(b) AS b, count(c) AS c FROM src),
       r AS (SELECT 'a' AS "column", (n - a) / n AS value FROM n UNION ALL SELECT 'b', (n - b) / n FROM n UNION ALL SELECT 'c', (n - c) / n FROM n),
       d AS (SELECT (SELECT n FROM n) - count(*) AS dup FROM (SELECT DISTINCT * FROM src))
       SELECT 'null_ratio' AS "check", "column", CASE WHEN value > 0.9 THEN 'error' ELSE 'warning' END AS severity, round(value, 6) AS value,
              concat('Column ''', "column", ''' has ', printf('%.1f', value * 100), '% nulls (threshold: 30.0%).') AS message FROM r WHERE value > 0.3
       UNION ALL SELECT 'duplicates', NULL, CASE WHEN dup / n > 0.5 THEN 'error' ELSE 'warning' END, dup,
              concat(CAST(dup AS VARCHAR), ' duplicate rows (', printf('%.1f', dup / n * 100), '% of data).') FROM d, n WHERE dup > 0""",
)
def quality_check(spark, sf):
    no = F.col("l_linenumber")
    df = V.table(spark, sf, "lineitem").select(
        "l_returnflag",
        "l_linestatus",
        F.when(no == 1, no).alias("a"),
        F.when(no <= 4, no).alias("b"),
        F.when((F.col("l_quantity") > 49) & (no == 1), F.lit(1)).alias("c"),
    )
    return Q.quality_check(df).withColumn("value", F.round("value", 6))


@query("duplicate_rows", """SELECT count(*) AS record_count, count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS duplicate_count FROM documents""")
def duplicate_rows(spark, sf):
    return Q.duplicate_rows(V.table(spark, sf, "documents").select("text", "lang"))


def _raw_items(spark, sf):
    """Order items with text, negative and missing cells."""
    no = F.col("l_linenumber")
    return V.table(spark, sf, "lineitem").select(
        F.when(no != 7, F.col("l_orderkey").cast("string")).alias("order_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.when(no == 2, -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("string").alias("quantity"),
        F.when(no == 3, "n/a").otherwise(F.col("l_extendedprice").cast("string")).alias("unit_price"),
        F.when((no == 2) | (no == 4), F.lit(None)).otherwise(F.col("l_extendedprice")).alias("gross_sale"),
        F.when(no == 5, "someday").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("sale_date"),
    )


@query(
    "gatekeeper_passed",
    """SELECT CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_partkey AS VARCHAR) AS product_id, l_quantity AS quantity,
              l_extendedprice AS unit_price, l_extendedprice AS gross_sale, strftime(l_shipdate, '%Y-%m-%d') AS sale_date
       FROM lineitem WHERE l_linenumber IN (1, 6)""",
)
def gatekeeper_passed(spark, sf):
    passed, _ = Q.gatekeeper(_raw_items(spark, sf), "order_items", strict=False)
    return passed.withColumn("sale_date", F.date_format("sale_date", "yyyy-MM-dd"))


@query(
    "gatekeeper_quarantine",
    """SELECT CAST(l_partkey AS VARCHAR) AS product_id, CASE l_linenumber
            WHEN 2 THEN 'gross_sale:not_null,quantity:non_negative' WHEN 3 THEN 'unit_price:coerce' WHEN 4 THEN 'gross_sale:not_null'
            WHEN 5 THEN 'sale_date:coerce' WHEN 7 THEN 'order_id:not_null' END AS violations
       FROM lineitem WHERE l_linenumber IN (2, 3, 4, 5, 7)""",
)
def gatekeeper_quarantine(spark, sf):
    _, failed = Q.gatekeeper(_raw_items(spark, sf), "order_items", strict=False)
    return failed.select("product_id", F.array_join(F.array_sort("violations"), ",").alias("violations"))


@query(
    "violation_report",
    """SELECT 'quantity' AS "column", 'non_negative' AS "check", count(*) AS count FROM lineitem WHERE l_linenumber = 2
       UNION ALL SELECT 'unit_price', 'coerce', count(*) FROM lineitem WHERE l_linenumber = 3
       UNION ALL SELECT 'gross_sale', 'not_null', count(*) FROM lineitem WHERE l_linenumber IN (2, 4)
       UNION ALL SELECT 'sale_date', 'coerce', count(*) FROM lineitem WHERE l_linenumber = 5
       UNION ALL SELECT 'order_id', 'not_null', count(*) FROM lineitem WHERE l_linenumber = 7""",
)
def violation_report(spark, sf):
    return Q.violation_report(_raw_items(spark, sf), "order_items")


@query(
    "normalize_headers",
    "SELECT c_custkey AS customer_key, c_name AS full_name FROM customer",
)
def normalize_headers(spark, sf):
    df = V.table(spark, sf, "customer").select(F.col("c_custkey").alias(" Customer Key "), F.col("c_name").alias("Full Name"))
    return Q.require_columns(Q.normalize_headers(df), ["customer_key", "full_name"])


@query(
    "is_empty",
    """SELECT l_linenumber, count(*) FILTER (l_linenumber IN (1, 2)) AS empty_numbers, count(*) FILTER (l_linenumber IN (3, 4)) AS empty_texts
       FROM lineitem GROUP BY l_linenumber""",
)
def empty_cells(spark, sf):
    no = F.col("l_linenumber")
    df = V.table(spark, sf, "lineitem").select(
        "l_linenumber",
        F.when(no == 1, F.lit(float("nan"))).when(no != 2, F.lit(0.0)).alias("number"),
        F.when(no == 3, F.lit(" \t")).when(no != 4, F.col("l_returnflag")).alias("text"),
    )
    return df.groupBy("l_linenumber").agg(
        F.count_if(is_empty(df, "number")).alias("empty_numbers"), F.count_if(is_empty(df, "text")).alias("empty_texts")
    )


@query(
    "duplicate_rows_exact",
    """SELECT count(*) AS record_count, count(*) - count(DISTINCT (user_id, us, v, p)) AS duplicate_count
       FROM (SELECT user_id % 20 AS user_id, epoch_us(date_trunc('day', ts)) + event_id % 2 AS us, CASE WHEN event_id % 3 = 0 THEN round(value) END AS v,
                    [event_id % 2, NULL, 1] AS p FROM events)""",
)
def duplicate_rows_exact(spark, sf):
    """Instants one microsecond apart, NaN beside NULL, lists with missing elements."""
    e, no = V.events(spark, sf), F.col("event_id")
    value = F.when(no % 3 == 0, F.round("value")).when(no % 3 == 1, F.lit(float("nan")))
    rows = e.select(
        (F.col("user_id") % 20).alias("user_id"),
        F.timestamp_micros(F.unix_micros(F.date_trunc("day", "ts").cast("timestamp")) + no % 2).alias("ts"),
        value.alias("value"),
        F.array(no % 2, F.lit(None), F.lit(1)).alias("parts"),
    )
    return Q.duplicate_rows(rows)


@query(
    "gatekeeper_orders",
    """SELECT CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS order_id,
              CASE WHEN o_orderkey % 11 = 0 THEN 'order_date:coerce' WHEN o_orderkey % 13 = 0 THEN 'order_date:not_null' ELSE '' END AS date_violation,
              o_orderkey % 7 = 0 AS lacks_id FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0
       UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'passed', FALSE FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0""",
)
def gatekeeper_orders(spark, sf):
    """The rules of order headers: a number and a readable date; the customer may be missing."""
    key = F.col("o_orderkey")
    date = F.when(key % 11 == 0, "junk").when(key % 13 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = V.table(spark, sf, "orders").select(
        F.when(key % 7 != 0, key.cast("string")).alias("order_id"), date.alias("order_date"), F.lit(None).cast("string").alias("customer_id")
    )
    passed, failed = Q.gatekeeper(rows, "orders", strict=False)
    dates = F.filter("violations", lambda v: v.startswith("order_date"))
    bad = failed.select("order_id", F.coalesce(F.get(dates, F.lit(0)), F.lit("")).alias("date_violation"), F.array_contains("violations", "order_id:not_null").alias("lacks_id"))
    return bad.unionAll(passed.select("order_id", F.lit("passed"), F.lit(False)))
