"""JSON orders to sales facts, backlog, customers and daily demand."""

from __future__ import annotations

from collections.abc import Mapping
from contextlib import nullcontext

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.functions import name_col, to_number
from demandloom.functions.expr import digest
from demandloom.operators import demand
from demandloom.operators.demand import MONTH, daily_demand, once, once_spread, with_month  # noqa: F401  (daily_demand and once are operators here)
from demandloom.session import materialize
from demandloom.sources import ledger

HEADER_FIELDS = ("order_id", "customer_id", "order_date", "status", "total_amount")
CUSTOMER_FIELDS = {
    "customer_name": "name",
    "customer_email": "email",
    "customer_segment": "segment",
    "customer_region": "region",
}
ITEM_NUMBERS = ("quantity", "unit_price", "discount")
LOAD_TABLES = ("orders_backlog", "fact_sales", "dim_customers", "agg_daily_demand", "dead_letters")
COUNTED_TABLES = ("orders_backlog", "fact_sales")
UNPARSED, UNDATED = "items:json_array", "order_date:missing"


def _source(mapping: Mapping[str, str], name: str, default: str | None = None) -> str:
    return mapping.get(name, default or name)


def _column(df: DataFrame, name: str) -> Column:
    return name_col(name) if name in df.columns else F.lit(None).cast("string")


def _items(df: DataFrame, name: str) -> Column:
    """The item list as an array; text that is not one JSON array and nothing else gives NULL.

    The parser stops after the first value, so the text is parsed as the first of two elements: more
    text, or a bracket too many, spoils the second, which is an empty array. The lambda binds what is
    parsed to a name; written out, each use of it would parse the text again.
    """
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        text = F.btrim(name_col(name), F.lit(" \t\r\n"))
        both = F.concat(F.lit("["), text, F.lit(",[]]"))
        parsed = F.from_json(both, "array<array<map<string,string>>>", {"allowSingleQuotes": "false"})
        first = F.transform(F.array(parsed), lambda p: F.when((F.size(p) == 2) & (F.size(F.get(p, F.lit(1))) == 0), F.get(p, F.lit(0))))
        return F.when(text.startswith("[") & text.endswith("]"), F.get(first, F.lit(0)))
    if isinstance(dtype, T.ArrayType):
        return name_col(name)
    return F.lit(None).cast("array<map<string,string>>")


def message_id(df: DataFrame, mapping: Mapping[str, str] | None = None) -> Column:
    """A digest of the order's number, date and items: equal for each delivery of one message."""
    names = dict(mapping or {})
    used = [_source(names, "order_id"), _source(names, "order_date"), _source(names, "items_column", "items")]
    return digest(df, [c for c in used if c in df.columns])


def unparsed_orders(
    df: DataFrame,
    mapping: Mapping[str, str] | None = None,
    source_id: int = 0,
    items_source_type: str = "json_column",
    message: Column | None = None,
) -> DataFrame:
    """Orders whose items are given but are no JSON array: they have no facts, and are not lost.

    ``message`` is the digest of the message if ``df`` has it already.
    """
    names = dict(mapping or {})
    items_col = _source(names, "items_column", "items")
    readable = items_source_type == "json_column" and items_col in df.columns
    bad = name_col(items_col).isNotNull() & _items(df, items_col).isNull() if readable else F.lit(False)
    return _dead_letters(df.filter(bad), names, source_id, UNPARSED, message)


def undated_orders(df: DataFrame, mapping: Mapping[str, str] | None = None, source_id: int = 0) -> DataFrame:
    """Orders without a date as dead letters."""
    return _dead_letters(df, dict(mapping or {}), source_id, UNDATED)


def _dead_letters(df: DataFrame, names: Mapping[str, str], source_id: int, reason: str, message: Column | None = None) -> DataFrame:
    return df.select(
        _column(df, _source(names, "order_id")).cast("string").alias("order_id"),
        F.lit(source_id).alias("source_id"),
        _column(df, _source(names, "order_date")).cast("timestamp").alias("order_date"),
        _raw_items(df, names).alias("raw_items"),
        (message_id(df, names) if message is None else message).alias("message_id"),
        F.lit(reason).alias("reason"),
    )


def _raw_items(df: DataFrame, names: Mapping[str, str]) -> Column:
    items_col = _source(names, "items_column", "items")
    raw = _column(df, items_col)
    if items_col in df.columns and isinstance(df.schema[items_col].dataType, (T.ArrayType, T.StructType, T.MapType)):
        raw = F.to_json(raw)
    return raw


def explode_orders(
    df: DataFrame,
    mapping: Mapping[str, str] | None = None,
    source_id: int = 0,
    items_source_type: str = "json_column",
    tracked: bool = False,
    message: Column | None = None,
) -> DataFrame:
    """One fact row per order item.

    ``mapping`` is ``{internal: source}`` for the order columns and the item fields. A missing
    quantity, price or discount is 0; when one of them is no number all three are 0. A product id that
    is missing stays NULL. Other modes than ``json_column`` carry no items. ``tracked`` adds the
    message an item came with and its place there, by which re-deliveries are told from new lines;
    ``message`` is the digest of the message if ``df`` has it already.
    """
    names = dict(mapping or {})
    items_col = _source(names, "items_column", "items")
    order_id = _column(df, _source(names, "order_id")).alias("order_id")
    sale_date = _column(df, _source(names, "order_date")).alias("sale_date")
    if items_source_type != "json_column" or items_col not in df.columns:
        items = F.lit(None).cast("array<map<string,string>>")
    else:
        items = _items(df, items_col)
    origin = [(message_id(df, names) if message is None else message).alias("message_id")] if tracked else []
    rows = df.select(order_id, sale_date, *origin, F.posexplode(items).alias("item_no", "item"))
    kept = ["message_id", "item_no"] if tracked else []
    item_type = rows.schema["item"].dataType
    struct_fields = item_type.names if isinstance(item_type, T.StructType) else None

    def field(name: str) -> Column:
        key = _source(names, name)
        if struct_fields is not None:
            return F.col("item").getField(key) if key in struct_fields else F.lit(None)
        return F.col("item").getItem(key)

    def number_text(name: str) -> Column:
        """The value as text, "0" when the field is absent. A struct cannot tell absent from null."""
        value = field(name).cast("string")
        if struct_fields is not None:
            return F.coalesce(value, F.lit("0"))
        return F.when(F.map_contains_key("item", F.lit(_source(names, name))), value).otherwise(F.lit("0"))

    rows = rows.select(
        "order_id",
        "sale_date",
        *kept,
        field("product_id").cast("string").alias("product_id"),
        *[number_text(n).alias(f"_text_{n}") for n in ITEM_NUMBERS],
    )
    rows = rows.withColumns({f"_{n}": to_number(F.col(f"_text_{n}")) for n in ITEM_NUMBERS})
    usable = F.col("_quantity").isNotNull() & F.col("_unit_price").isNotNull() & F.col("_discount").isNotNull()
    checked = rows.select(
        "order_id",
        F.lit(source_id).alias("source_id"),
        "product_id",
        *[F.when(usable, F.col(f"_{n}")).otherwise(F.lit(0.0)).alias(n) for n in ITEM_NUMBERS],
        "sale_date",
        *kept,
    )
    return with_sales(checked).select("order_id", "source_id", "product_id", *ITEM_NUMBERS, "gross_sale", "net_sale", "sale_date", *kept)


def with_sales(facts: DataFrame) -> DataFrame:
    gross = F.col("quantity") * F.col("unit_price")
    return facts.withColumns({"gross_sale": gross, "net_sale": gross - F.col("discount")})


def order_backlog(df: DataFrame, mapping: Mapping[str, str] | None = None, source_id: int = 0, tracked: bool = False) -> DataFrame:
    """Order headers with the item list as JSON text; ``tracked`` adds the digest of the message."""
    names = dict(mapping or {})
    return df.select(
        *[_column(df, _source(names, c)).alias(c) for c in HEADER_FIELDS],
        F.lit(source_id).alias("source_id"),
        _raw_items(df, names).alias("raw_items"),
        *([message_id(df, names).alias("message_id")] if tracked else []),
    )


def _first_orders(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(F.min("first").alias("first"))


def _customer_rows(df: DataFrame, mapping: Mapping[str, str] | None) -> DataFrame:
    names = dict(mapping or {})
    date = _column(df, _source(names, "order_date"))
    return df.select(
        _column(df, _source(names, "customer_id")).alias("customer_id"),
        F.struct(
            date.isNull().alias("undated"),
            date.alias("order_date"),
            _column(df, _source(names, "order_id")).alias("order_id"),
            *[_column(df, _source(names, c)).alias(out) for c, out in CUSTOMER_FIELDS.items()],
        ).alias("first"),
    )


def _customer_details(rows: DataFrame) -> DataFrame:
    return rows.select("customer_id", *[F.col(f"first.{c}").alias(c) for c in CUSTOMER_FIELDS.values()])


def extract_customers(df: DataFrame, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """One row per customer id: the details on its earliest order by (order_date, order_id).

    Kept as a minimum rather than a row number, so a customer with very many orders is reduced
    before the shuffle.
    """
    return _customer_details(_first_orders(_customer_rows(df, mapping)))


def load_orders(
    df: DataFrame,
    out_dir: str,
    mapping: Mapping[str, str] | None = None,
    source_id: int = 0,
    load_id: str | None = None,
    dead: DataFrame | None = None,
    refresh: bool = True,
) -> DataFrame:
    """Load backlog, facts, customers, daily demand and dead letters; returns (table, rows, counted).

    Each load has folders of its own, which readers see once all of them are written
    (``sources.ledger``). ``load_id`` names what is loaded: loading it again replaces the older rows;
    without one nothing is replaced. The source is read once, see ``load_kept``, and rows are counted
    as they are written. Orders whose items are no JSON array are in the backlog and in the dead letters,
    together with ``dead``, rows that the caller does not load. Then the demand of the products and
    days that the load touches is brought up to date; without ``refresh`` the caller does so after
    several loads, and readers of the demand make up for these until then. ``counted`` tells whether
    a table adds to the inserted total.
    """
    once_read = backlog_tells(df, dict(mapping or {}))
    with nullcontext(df) if once_read else materialize(df, "orders") as source:
        return load_kept(source, out_dir, mapping, source_id, load_id, dead, refresh)


def backlog_tells(df: DataFrame, names: Mapping[str, str]) -> bool:
    """Whether the backlog holds all that the other tables are made of: the items as text, and no customer details beside it."""
    items_col = _source(names, "items_column", "items")
    if items_col not in df.columns or df.schema[items_col].dataType != T.StringType():
        return False
    return not any(_source(names, c) in df.columns for c in CUSTOMER_FIELDS)


def load_kept(
    source: DataFrame,
    out_dir: str,
    mapping: Mapping[str, str] | None = None,
    source_id: int = 0,
    load_id: str | None = None,
    dead: DataFrame | None = None,
    refresh: bool = True,
) -> DataFrame:
    """``load_orders`` of a frame that lies in files already.

    If ``backlog_tells``, it is read once, for the backlog, whose files then give the other tables:
    they hold the items and the digest of each message. Else it is read once per table.
    """
    spark = source.sparkSession
    names = dict(mapping or {})
    load = ledger.begin(out_dir, source_id, load_id)
    counts = {}

    def write(table: str, frame: DataFrame) -> None:
        counts[table] = ledger.write_counted(frame, load.path(table), partition_by=MONTH if MONTH in frame.columns else None)

    backlog = with_month(order_backlog(source, names, source_id, tracked=True), "order_date")
    write("orders_backlog", backlog)
    rest, message = source, None
    if backlog_tells(source, names):
        rest, message = spark.read.schema(backlog.schema).parquet(load.path("orders_backlog")), F.col("message_id")
        names = {"items_column": "raw_items"} | {c: names[c] for c in ("product_id", *ITEM_NUMBERS) if c in names}
    write("fact_sales", with_month(explode_orders(rest, names, source_id, tracked=True, message=message), "sale_date"))
    write("dim_customers", _first_orders(_customer_rows(rest, names)))
    letters = unparsed_orders(rest, names, source_id, message=message)
    write("dead_letters", letters if dead is None else letters.unionByName(dead))
    ledger.commit(spark, load, counts)
    counts["agg_daily_demand"] = demand.refresh(spark, out_dir) if refresh else 0
    rows = [(t, counts[t], t in COUNTED_TABLES) for t in LOAD_TABLES]
    return spark.createDataFrame(rows, "table string, rows bigint, counted boolean")


def read_loaded(spark: SparkSession, out_dir: str, table: str) -> DataFrame:
    """A loaded table over all its committed loads, each key once.

    A message that was delivered again, in the same load or another, counts once; a further line of
    the same product in an order is another message and counts. Customers have the details of their
    earliest order of all loads. Daily demand is the maintained table, see ``operators.demand``.
    """
    if table == "agg_daily_demand":
        return demand.read_demand(spark, out_dir)
    frame = ledger.read(spark, out_dir, table)
    if frame is None:
        raise ValueError(f"nothing was loaded into {table} of {out_dir}")
    frame = frame.drop("load_id", MONTH)
    if table == "dim_customers":
        return _customer_details(_first_orders(frame))
    if table == "fact_sales":
        # what the others give is not shuffled
        found = with_sales(once_spread(frame.drop("gross_sale", "net_sale"), "item_no"))
        return found.select(*[name_col(c) for c in frame.columns if c not in ("message_id", "item_no")])
    return once_spread(frame)
