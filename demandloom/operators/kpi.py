"""Business KPIs, revenue ranking, inventory status, catalogue lists."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from demandloom.functions import money_text, name_col, percent_text, round_half_even, truncate
from demandloom.functions.expr import fixed_text
from demandloom.operators.relational import scan
from demandloom.session import checkpoint

# Risk limits and defaults.
MONITOR_VELOCITY = 15.0
STEADY_BELOW = 10
TOP_PRODUCTS = 5


def revenue_column() -> Column:
    return F.col("quantity").cast("double") * F.col("price_at_sale").cast("double")


def _split_group(sums: DataFrame, keys: Sequence[str], need: int) -> Row:
    """The group in which row number ``need`` (from 0) lies when groups are laid end to end in key
    order: its keys, its ``n`` and ``rev``, and the rows and revenue before it.

    The groups are dealt out by ranges of their keys. One sum per range tells in which the row lies,
    and only that range is put in order.
    """
    order = [F.col(k).asc_nulls_last() for k in keys]
    ranged = checkpoint(sums.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    rows_before, rev_before = 0, 0.0
    for r in ranged.groupBy("_range").agg(F.sum("n").alias("n"), F.sum("rev").alias("rev")).orderBy("_range").collect():  # a row per partition
        if rows_before + r["n"] > need:
            break
        rows_before, rev_before = rows_before + r["n"], rev_before + r["rev"]
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    running = ranged.filter(F.col("_range") == r["_range"]).withColumns({"_rows": F.sum("n").over(w) + rows_before, "_rev": F.sum("rev").over(w) + rev_before})
    placed = running.withColumns({"rows_before": F.col("_rows") - F.col("n"), "rev_before": F.col("_rev") - F.col("rev")})
    return placed.filter((F.col("_rows") > need) & (F.col("rows_before") <= need)).drop("_rows", "_rev", "_range").first()


def _earlier_revenue(rows: DataFrame, per_day: DataFrame, half: int, keys: Sequence[str]) -> float:
    """Revenue of the first ``half`` rows by (ds, product_id, *keys).

    Instead of numbering all rows, the split row is found from group sums: its day, then its second,
    then its (instant, product), then its key. Each step sums in parallel, and its literal bounds on
    ``ds`` let the next one read that part of the table only. No step puts all its groups in order
    in one task, so a day of one product may hold any number of rows.
    """
    ds_type = rows.schema["ds"].dataType
    earlier, need, inside = 0.0, half, rows

    def at(text: str) -> Column:
        return F.lit(text).cast(ds_type)

    second = F.date_trunc("second", "ds").cast(ds_type).cast("string")
    steps = (
        # group columns, then the filter that keeps the found group
        (None, lambda g: F.col("ds").isNull() if g["day"] is None else (F.col("ds") >= at(g["day"])) & (F.col("ds") < F.date_add(F.lit(g["day"]).cast("date"), 1).cast(ds_type))),
        ({"second": second}, lambda g: F.lit(True) if g["second"] is None else (F.col("ds") >= at(g["second"])) & (F.col("ds") < at(g["second"]) + F.expr("interval 1 second"))),
        (
            {"instant": F.col("ds").cast("string"), "product": F.col("product_id")},
            lambda g: (F.lit(True) if g["instant"] is None else F.col("ds") == at(g["instant"])) & F.col("product_id").eqNullSafe(F.lit(g["product"])),
        ),
        ({k: F.col(k) for k in keys}, None),
    )
    for groups, keep in steps:
        if groups is None:
            names, sums = ["day"], per_day
        elif groups:
            names = list(groups)
            sums = inside.groupBy(*[c.alias(n) for n, c in groups.items()]).agg(
                F.count(F.lit(1)).alias("n"), F.sum("rev").alias("rev")
            )
        else:
            break
        found = _split_group(sums, names, need)
        earlier, need = earlier + found["rev_before"], need - found["rows_before"]
        if need == 0:
            return earlier
        if keep is not None:
            inside = inside.filter(keep(found))
    # rows equal in every key share their revenue evenly
    return earlier + found["rev"] * need / found["n"]


KPI_SCHEMA = "qty double, rev double, cost double, prev double, recent double"


def business_kpis(sales: DataFrame, products: DataFrame, order_keys: Sequence[str] = ("order_id", "line_no")) -> DataFrame:
    """One row: volume, revenue, margin, and revenue growth of the later half of the rows.

    Rows are ordered by (ds, product_id, *order_keys) and split after floor(n/2). Costs are joined to
    sums per product and day, never to the sales rows. No sales give no row.
    """
    base = ("product_id", "ds", "quantity", "rev")
    keys = [k for k in order_keys if k in sales.columns or k in base]
    rows = sales.select(
        "product_id",
        "ds",
        *[k for k in keys if k not in base],
        F.col("quantity").cast("double").alias("quantity"),
        revenue_column().alias("rev"),
    )
    costs = products.select(F.col("id").alias("product_id"), F.col("unit_cost").cast("double").alias("unit_cost"))
    per_day = (
        rows.groupBy("product_id", F.to_date("ds").cast("string").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("qty"), F.sum("rev").alias("rev"))
        .join(costs, on="product_id", how="left")
        .groupBy("day")
        .agg(
            F.sum("n").alias("n"),
            F.sum("qty").alias("qty"),
            F.sum("rev").alias("rev"),
            F.sum(F.col("qty") * F.coalesce("unit_cost", F.lit(0.0))).alias("cost"),
        )
    )
    # one short row per day, kept for the totals and for the first step of the split
    spark = sales.sparkSession
    days = checkpoint(per_day)
    total = days.agg(*[F.sum(c).alias(c) for c in ("n", "qty", "rev", "cost")]).first()
    if not total["n"]:
        facts = spark.createDataFrame([], KPI_SCHEMA)
    else:
        half = total["n"] // 2
        prev = _earlier_revenue(rows, days, half, keys) if half else total["rev"]
        recent = total["rev"] - prev if half else total["rev"]
        facts = spark.createDataFrame([(total["qty"], total["rev"], total["cost"], prev, recent)], KPI_SCHEMA)
    change = F.when(F.col("prev") > 0, (F.col("recent") - F.col("prev")) / F.col("prev") * 100).otherwise(0.0)
    margin = F.when(F.col("rev") > 0, (F.col("rev") - F.col("cost")) / F.col("rev") * 100).otherwise(0.0)
    out = facts.withColumns({"rev_change": change, "margin_pct": margin})
    return out.select(
        truncate(F.col("qty")).alias("total_volume"),
        F.col("rev").alias("total_revenue"),
        F.col("cost").alias("total_cost"),
        "margin_pct",
        F.col("rev_change").alias("growth_pct"),
        money_text(F.col("rev")).alias("revenue"),
        percent_text(F.col("rev_change"), 1).alias("growth"),
        F.lit("Pending").alias("conversion"),
        percent_text(F.col("margin_pct"), 1).alias("margin"),
        F.concat(F.when(F.col("rev_change") >= 0, "+").otherwise(""), fixed_text(F.col("rev_change"), 2), F.lit("%")).alias(
            "revenue_change"
        ),
        F.when(F.abs("rev_change") < STEADY_BELOW, "Steady").otherwise("High Velocity").alias("growth_change"),
    )


def revenue_breakdown(sales: DataFrame, products: DataFrame, k: int = TOP_PRODUCTS) -> DataFrame:
    """The ``k`` products with most revenue; names are looked up for those only."""
    top = (
        sales.filter(F.col("product_id").isNotNull())
        .groupBy("product_id")
        .agg(truncate(F.sum(revenue_column())).alias("value"))
        .orderBy(F.desc("value"), "product_id")
        .limit(k)
    )
    names = products.select(F.col("id").alias("product_id"), F.col("name").alias("known"))
    return (
        top.join(names, on="product_id", how="left")
        .select(
            "product_id",
            F.coalesce("known", F.concat(F.lit("SKU #"), F.col("product_id").cast("string"))).alias("name"),
            "value",
        )
        .orderBy(F.desc("value"), "product_id")
    )


def inventory_status(
    products: DataFrame, categories: DataFrame | None, sales: DataFrame, query: str = ""
) -> DataFrame:
    """Stock, sales velocity and risk of every product that is in the catalogue or was sold."""
    velocity = (
        sales.filter(F.col("product_id").isNotNull())
        .groupBy("product_id")
        .agg(F.avg(F.col("quantity").cast("double")).alias("velocity"))
    )
    catalogue = products.select(
        F.col("id"),
        F.col("name").alias("known_name"),
        "category_id",
        F.col("current_stock"),
        F.col("safety_stock"),
        F.lit(True).alias("known"),
    )
    both = catalogue.join(velocity, on=F.col("id") == F.col("product_id"), how="full_outer").select(
        F.coalesce("id", "product_id").alias("id"),
        F.coalesce("known_name", F.concat(F.lit("Unknown SKU #"), F.col("product_id").cast("string"))).alias("name"),
        "category_id",
        F.coalesce("current_stock", F.lit(0)).cast("bigint").alias("stock"),
        F.when(F.col("known"), F.coalesce("safety_stock", F.lit(10))).otherwise(0).cast("bigint").alias("safety"),
        F.coalesce("velocity", F.lit(0.0)).alias("velocity"),
    )
    if query:
        both = both.filter(F.lower("name").contains(query.lower()))
    if categories is not None:
        named = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
        both = both.join(named, on="category_id", how="left")
    else:
        both = both.withColumn("category", F.lit(None).cast("string"))
    risk = (
        F.when(F.col("stock") <= F.col("safety"), "High")
        .when(F.col("velocity") > MONITOR_VELOCITY, "Monitor")
        .otherwise("Low")
    )
    return both.select(
        "id",
        "name",
        F.coalesce("category", F.lit("Uncategorized")).alias("category"),
        "stock",
        round_half_even(F.col("velocity"), 2).alias("velocity"),
        risk.alias("risk"),
    ).orderBy("id")


def active_products(products: DataFrame, category_id: Any = None) -> DataFrame:
    filters = {"status": "active"}
    if category_id:
        filters["category_id"] = category_id
    return scan(products, filters)


def by_category(df: DataFrame, category: str | None = None) -> DataFrame:
    """Rows of one category; None and ``All`` mean every row."""
    return df if not category or category == "All" else df.filter(name_col("category") == category)
