"""Product and order imports as joins over the whole batch."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.functions import name_col, strip, to_number
from demandloom.operators.maintenance import upsert
from demandloom.operators.quality import require_columns
from demandloom.session import checkpoint

# The columns of both import files and the allowed product states.
PRODUCT_COLUMNS = {
    "required": ("sku_code", "name"),
    "optional": (
        "base_price",
        "unit_cost",
        "current_stock",
        "safety_stock",
        "status",
        "category_name",
        "weight",
        "dimensions",
    ),
}
ORDER_COLUMNS = {
    "required": ("order_id", "order_date", "product_sku", "quantity", "price_at_sale"),
    "optional": ("customer_name", "customer_email", "status", "total_amount"),
}
PRODUCT_STATUS = ("active", "retired", "draft")
DEFAULT_ORDER_STATUS = "pending"

ID_BUCKETS = 1024


@dataclass(frozen=True)
class ImportResult:
    """Tables after the import, the rows not taken, one row of counts, and what was odd by row.

    ``warnings`` has (row_num, warning): cells of taken rows that were left out, and the reasons of
    rows not taken.
    """

    tables: dict[str, DataFrame]
    rejects: DataFrame
    summary: DataFrame
    warnings: DataFrame


def _cells(rows: DataFrame, columns: Sequence[str], row_col: str) -> DataFrame:
    """``row_num`` and the named cells as trimmed text, NULL where absent or empty.

    In steps, so that a cell is trimmed once however often it is looked at afterwards.
    """
    absent = F.lit(None).cast("string")
    trimmed = rows.select(
        name_col(row_col).alias("row_num"),
        *[(strip(name_col(c).cast("string")) if c in rows.columns else absent).alias(c) for c in columns],
    )
    return trimmed.select("row_num", *[F.when(~F.col(c).isin("", "NaN"), F.col(c)).alias(c) for c in columns])


def stable_uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def number_new_keys(keys: DataFrame, key: str, start: Column) -> DataFrame:
    """Distinct ``keys`` with consecutive ids after ``start``.

    Keys are hashed into a fixed number of buckets; each is numbered on its own and shifted by the
    sizes of the buckets before it, so no task sees all keys.
    """
    spread = keys.select(key).distinct().withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(ID_BUCKETS)))
    sizes = spread.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        "_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_offset")
    )
    # at most ID_BUCKETS rows
    placed = spread.join(F.broadcast(offsets), on="_bucket")
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    return placed.select(key, (start + F.col("_offset") + within).cast("bigint").alias("id"))


def assign_category_ids(names: DataFrame, categories: DataFrame) -> DataFrame:
    """(name, id, is_new): the known id, or a new one after the highest."""
    wanted = names.select(name_col(names.columns[0]).alias("name")).filter(F.col("name").isNotNull()).distinct()
    known = categories.groupBy("name").agg(F.min("id").cast("bigint").alias("id"))
    looked_up = checkpoint(wanted.join(known, on="name", how="left"))
    top = categories.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint").alias("m")).scalar()
    old, missing = looked_up.filter(F.col("id").isNotNull()), looked_up.filter(F.col("id").isNull())
    new = number_new_keys(missing, "name", top)
    return old.withColumn("is_new", F.lit(False)).unionByName(new.withColumn("is_new", F.lit(True)))


def parse_products(rows: DataFrame, row_col: str = "row_num") -> DataFrame:
    """Typed product fields, ``skip_reason`` and ``warnings`` per input row."""
    require_columns(rows, PRODUCT_COLUMNS["required"])
    cells = _cells(rows, [*PRODUCT_COLUMNS["required"], *PRODUCT_COLUMNS["optional"]], row_col)
    reals, wholes = ("base_price", "unit_cost", "weight"), ("current_stock", "safety_stock")
    parsed = cells.withColumns(
        {
            **{f"_{c}": to_number(F.col(c)) for c in reals},
            **{f"_{c}": to_number(F.col(c)).try_cast("bigint") for c in wholes},
            "_status": F.lower("status"),
        }
    )
    known_status = F.col("_status").isin(*PRODUCT_STATUS)
    checks = [F.when(F.col(c).isNotNull() & F.col(f"_{c}").isNull(), F.lit(f"invalid {c}")) for c in (*reals, *wholes)]
    checks.append(F.when(~known_status, F.lit("invalid status")))
    return parsed.select(
        "row_num",
        "sku_code",
        "name",
        *[F.col(f"_{c}").alias(c) for c in (*reals, *wholes)],
        "dimensions",
        F.when(known_status, F.col("_status")).alias("status"),
        "category_name",
        F.array_compact(F.array(*checks)).alias("warnings"),
        F.when(F.col("sku_code").isNull() | F.col("name").isNull(), F.lit("sku_code and name are required")).alias(
            "skip_reason"
        ),
    )


def import_products(
    rows: DataFrame, products: DataFrame, categories: DataFrame, row_col: str = "row_num"
) -> ImportResult:
    """Insert or update products by ``sku_code``; empty cells leave a field as it is.

    ``row_col`` numbers the input rows. Repeated codes apply in that order. The parsed rows are kept
    in a table, since all results start from them.
    """
    parsed = checkpoint(parse_products(rows, row_col))
    valid = parsed.filter(F.col("skip_reason").isNull())
    ids = assign_category_ids(valid.select("category_name"), categories)
    categories_after = categories.select("id", "name").unionByName(
        ids.filter("is_new").select(F.col("id").cast(categories.schema["id"].dataType).alias("id"), "name")
    )
    named = valid.join(
        ids.select(F.col("name").alias("category_name"), F.col("id").alias("category_id")),
        on="category_name",
        how="left",
    )
    fields = [c for c in named.columns if c in products.columns]
    changes = named.select("row_num", *[name_col(c) for c in fields])
    known = products.select("sku_code")
    top = products.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint").alias("m")).scalar()
    new_codes = valid.select("sku_code").join(known, on="sku_code", how="left_anti")
    new_ids = number_new_keys(new_codes, "sku_code", top)
    changes = changes.join(new_ids, on="sku_code", how="left")
    after = upsert(products, changes, "sku_code", "row_num")
    rejects = parsed.filter(F.col("skip_reason").isNotNull()).select(
        "row_num", F.lit("skipped").alias("outcome"), F.col("skip_reason").alias("reason")
    )
    new_count = new_ids.agg(F.count(F.lit(1)).alias("n")).scalar()
    summary = parsed.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("skip_reason").isNull()).alias("valid"),
        F.count_if(F.col("skip_reason").isNotNull()).alias("rows_skipped"),
        F.sum(F.when(F.col("skip_reason").isNull(), F.size("warnings")).otherwise(0)).alias("warnings"),
    ).select(
        "total_rows",
        new_count.alias("rows_imported"),
        (F.col("valid") - new_count).alias("rows_updated"),
        F.lit(0).cast("bigint").alias("rows_failed"),
        "rows_skipped",
        "warnings",
    )
    odd = valid.select("row_num", F.explode("warnings").alias("warning"))
    return ImportResult({"products": after, "categories": categories_after}, rejects, summary, odd.unionAll(rejects.select("row_num", "reason")))


# (outcome, reason) in the order the checks apply
ORDER_REASONS = (
    ("skipped", "order_id is empty"),
    ("skipped", "product_sku is empty"),
    ("skipped", "order_date is required"),
    ("failed", "invalid order_date"),
    ("failed", "invalid quantity"),
    ("failed", "invalid price_at_sale"),
    ("failed", "product_sku not found"),
)


def check_orders(rows: DataFrame, products: DataFrame, row_col: str = "row_num") -> DataFrame:
    """Typed order lines with ``outcome`` and ``reason``; the first failing check decides."""
    require_columns(rows, ORDER_COLUMNS["required"])
    cells = _cells(rows, [*ORDER_COLUMNS["required"], *ORDER_COLUMNS["optional"]], row_col)
    parsed = cells.select(
        "row_num",
        F.col("order_id").alias("order_key"),
        "product_sku",
        F.col("order_date").alias("date_text"),
        F.try_to_timestamp("order_date").alias("ds"),
        *[to_number(F.col(c)).alias(c) for c in ("quantity", "price_at_sale", "total_amount")],
        "customer_name",
        "customer_email",
        "status",
    )
    codes = products.select(F.col("sku_code").alias("product_sku"), F.col("id").alias("product_id"))
    joined = parsed.join(codes, on="product_sku", how="left")
    failing = (
        F.col("order_key").isNull(),
        F.col("product_sku").isNull(),
        F.col("date_text").isNull(),
        F.col("ds").isNull(),
        F.col("quantity").isNull(),
        F.col("price_at_sale").isNull(),
        F.col("product_id").isNull(),
    )
    verdict = F.coalesce(
        *[
            F.when(c, F.struct(F.lit(o).alias("outcome"), F.lit(r).alias("reason")))
            for c, (o, r) in zip(failing, ORDER_REASONS)
        ],
        F.struct(F.lit("imported").alias("outcome"), F.lit(None).cast("string").alias("reason")),
    )
    return joined.withColumn("v", verdict).select("*", "v.outcome", "v.reason").drop("v", "date_text")


def resolve_customers(lines: DataFrame, customers: DataFrame) -> DataFrame:
    """(customer_name, customer_id, email, is_new) per distinct name in ``lines``.

    The e-mail on the first line of a name counts. An existing customer is found by e-mail, then by
    name. Otherwise one is created, and later new names with the same e-mail share it.
    """
    first = (
        lines.filter(F.col("customer_name").isNotNull())
        .groupBy("customer_name")
        .agg(F.min(F.struct("row_num", F.col("customer_email").alias("email"))).alias("f"))
        .select("customer_name", F.col("f.row_num").alias("row_num"), F.col("f.email").alias("email"))
    )
    by_email = (
        customers.filter(F.col("email").isNotNull()).groupBy("email").agg(F.min("id").cast("string").alias("email_id"))
    )
    by_name = (
        customers.filter(F.col("name").isNotNull())
        .groupBy(F.col("name").alias("customer_name"))
        .agg(F.min("id").cast("string").alias("name_id"))
    )
    found = checkpoint(
        first.join(by_email, on="email", how="left")
        .join(by_name, on="customer_name", how="left")
        .withColumn("known_id", F.coalesce("email_id", "name_id"))
    )
    fresh = found.filter(F.col("known_id").isNull())
    owners = (
        fresh.filter(F.col("email").isNotNull())
        .groupBy("email")
        .agg(F.min(F.struct("row_num", "customer_name")).alias("o"))
        .select("email", F.col("o.customer_name").alias("owner"))
    )
    owned = found.join(owners, on="email", how="left")
    is_fresh = F.col("known_id").isNull()
    owner = F.coalesce(F.when(is_fresh, F.col("owner")), F.col("customer_name"))
    return owned.select(
        "customer_name",
        F.coalesce("known_id", stable_uuid(F.lit("customer"), owner)).alias("customer_id"),
        "email",
        (is_fresh & (owner == F.col("customer_name"))).alias("is_new"),
    )


def build_orders(accepted: DataFrame) -> DataFrame:
    """One order per order key, from its first accepted line; status defaults to pending."""
    first = accepted.groupBy("order_key").agg(
        F.min(F.struct("row_num", "ds", "status", "total_amount", "customer_id")).alias("f")
    )
    return first.select(
        stable_uuid(F.lit("order"), F.col("order_key")).alias("id"),
        F.col("order_key").alias("order_id"),
        F.col("f.ds").alias("order_date"),
        F.coalesce("f.status", F.lit(DEFAULT_ORDER_STATUS)).alias("status"),
        F.col("f.total_amount").alias("total_amount"),
        F.col("f.customer_id").alias("customer_id"),
    )


def import_orders(
    rows: DataFrame, products: DataFrame, customers: DataFrame, row_col: str = "row_num"
) -> ImportResult:
    """Order lines to orders, sales and new customers.

    The checked lines are kept in a table, since all results start from them.
    """
    checked = checkpoint(check_orders(rows, products, row_col))
    accepted = checked.filter(F.col("outcome") == "imported")
    people = resolve_customers(accepted, customers)
    lines = accepted.join(people.select("customer_name", "customer_id"), on="customer_name", how="left")
    sales = lines.select(
        stable_uuid(F.lit("order"), F.col("order_key")).alias("order_id"),
        "product_id",
        "ds",
        "quantity",
        "price_at_sale",
        "customer_id",
        "row_num",
    )
    new_customers = people.filter("is_new").select(
        F.col("customer_id").alias("id"), F.col("customer_name").alias("name"), "email"
    )
    rejects = checked.filter(F.col("outcome") != "imported").select("row_num", "outcome", "reason")
    summary = checked.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("outcome") == "imported").alias("rows_imported"),
        F.lit(0).cast("bigint").alias("rows_updated"),
        F.count_if(F.col("outcome") == "failed").alias("rows_failed"),
        F.count_if(F.col("outcome") == "skipped").alias("rows_skipped"),
    )
    return ImportResult(
        {"orders": build_orders(lines), "sales": sales, "customers": new_customers},
        rejects,
        summary,
        rejects.select("row_num", F.col("reason").alias("warning")),
    )
