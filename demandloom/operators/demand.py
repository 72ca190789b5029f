"""Daily demand, and its table over all loads, kept up to date by the keys that a load touches.

``agg_daily_demand/part=<id>`` holds the new totals of the (product, day) keys that changed with one
version; the newest version that has a key counts. A version is made from the facts of the touched
months only, which are folders of the fact table. Its entry, written last, claims the version's
number and names the loads that it takes in. So a reader knows which loads came later and works out
their keys itself: the result never depends on when, or by whom, the table was refreshed. Now and
then a version holds all keys, and older ones are no longer read.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.session import checkpoint, parts_for, path_exists
from demandloom.sources import ledger

#: What a re-delivered message and its items have in common with the first delivery.
MESSAGE_KEY = ("source_id", "order_id", "message_id")
#: Loads keep dated rows in folders by this number, year * 100 + month.
MONTH = "month_no"
TABLE, VERSIONS = "agg_daily_demand", "demand_versions"
#: ``delta`` is 1 for a load that the version takes in and -1 for one that was replaced.
VERSION_ROW = "load_id string, delta int, part string, whole boolean, version bigint"
KEY, VALUES = ["product_id", "sale_date"], ["total_qty", "total_revenue", "order_count"]
#: Versions after which one with all keys is written.
COMPACT_AFTER = 20


def daily_demand(fact: DataFrame) -> DataFrame:
    """Quantity, revenue and number of orders per product and day."""
    day = F.to_date("sale_date")
    return (
        fact.filter(F.col("product_id").isNotNull() & F.col("sale_date").isNotNull())
        .groupBy("product_id", day.alias("sale_date"))
        .agg(
            F.sum("quantity").alias("total_qty"),
            F.sum("gross_sale").alias("total_revenue"),
            F.count_distinct("order_id").alias("order_count"),
        )
    )


def once(facts: DataFrame) -> DataFrame:
    """The facts with re-delivered messages counted once."""
    return facts.dropDuplicates([*MESSAGE_KEY, "item_no"])


def once_spread(rows: DataFrame, *more: str) -> DataFrame:
    """The rows of a loaded table with re-delivered messages (and their ``more``) counted once, dealt out first, some to a task.

    Their number is read from the footers of their files. Digests come as bytes, and first in the
    key: a sort by them is decided by its first eight bytes, whereas all rows may have one source.
    """
    keys = ["_message", *more, "order_id", "source_id"]
    dealt = rows.withColumn("_message", _short(F.col("message_id"))).repartition(parts_for(rows.count()), *keys)
    return dealt.dropDuplicates(keys).drop("_message")


def with_month(df: DataFrame, date_col: str) -> DataFrame:
    day = F.to_date(date_col)
    return df.withColumn(MONTH, F.year(day) * 100 + F.month(day))


def versions(spark: SparkSession, out_dir: str) -> DataFrame:
    path = f"{out_dir}/{VERSIONS}"
    if not path_exists(spark, path):
        return spark.createDataFrame([], VERSION_ROW)
    return spark.read.schema(VERSION_ROW).option("basePath", path).parquet(path)


def changed_loads(spark: SparkSession, out_dir: str) -> DataFrame:
    """(load_id, delta) of the loads committed or replaced since the newest version."""
    taken = versions(spark, out_dir).groupBy("load_id").agg(F.sum("delta").alias("n")).filter("n > 0").select("load_id", F.lit(-1).alias("delta"))
    now = ledger.committed(spark, out_dir).select("load_id", F.lit(1).alias("delta"))
    return taken.union(now).groupBy("load_id").agg(F.sum("delta").cast("int").alias("delta")).filter("delta <> 0")


def touched_keys(facts: DataFrame, loads: DataFrame) -> DataFrame:
    """(product_id, sale_date, month) of the facts that some loads hold."""
    rows = ledger.of_loads(facts, loads).filter("product_id IS NOT NULL AND sale_date IS NOT NULL")
    return rows.select("product_id", F.to_date("sale_date").alias("sale_date"), MONTH).distinct()


def demand_of(facts: DataFrame, keys: DataFrame) -> DataFrame:
    """The demand of some keys, from the months that they lie in; keys that have no facts get nulls."""
    months = [r[MONTH] for r in keys.select(MONTH).distinct().collect()]  # bounded by the calendar
    wanted = keys.drop(MONTH)
    rows = facts.filter(F.col(MONTH).isin(months)).withColumn("day", F.to_date("sale_date"))
    rows = rows.join(wanted.withColumnRenamed("sale_date", "day"), ["product_id", "day"], "left_semi")
    return wanted.join(daily_demand(once(rows)), KEY, "left").select(*KEY, *VALUES)


def _short(message_id: Column) -> Column:
    """A message's digest as its 16 bytes, which take half the room of its hex digits in a shuffle; other ids as their bytes."""
    text = F.encode(message_id, "utf-8")
    return F.when(F.length(message_id) == 32, F.coalesce(F.unhex(message_id), text)).otherwise(text)


def demand_once(facts: DataFrame, gone: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """``daily_demand(once(facts))`` of dated facts, which are shuffled once, with whether a key is ``touched``.

    A message's digest holds its order and date, so all deliveries of an item, and all lines of an
    order on a day, meet where order and day do. Then an order is one row per key, and orders need
    only be counted. ``gone`` are further touched keys (product_id, day): without facts they get nulls.
    ``parts`` are the tasks that the facts are dealt out to. The digest leads the key, see ``once_spread``.
    """
    dated = facts.filter(F.col("sale_date").isNotNull()).withColumns({"day": F.to_date("sale_date"), "message_id": _short(F.col("message_id"))})
    dated = dated.repartition(*([] if parts is None else [parts]), "order_id", "day")
    measures = ("quantity", "gross_sale")
    items = dated.groupBy("message_id", "item_no", "order_id", "source_id", "day").agg(
        *[F.first(c).alias(c) for c in ("product_id", *measures)], F.max("touched").alias("touched")
    )
    sums = [F.sum(c).alias(c) for c in measures]
    rows = items.filter(F.col("product_id").isNotNull()).groupBy("product_id", "day", "order_id").agg(*sums, F.max("touched").alias("touched"))
    rows = rows.withColumn("live", F.lit(True))
    if gone is not None:
        rows = rows.unionByName(gone.withColumns({"touched": F.lit(True), "live": F.lit(False)}), allowMissingColumns=True)
    days = rows.groupBy("product_id", F.col("day").alias("sale_date")).agg(
        F.sum("quantity").alias("total_qty"),
        F.sum("gross_sale").alias("total_revenue"),
        F.count("order_id").alias("order_count"),
        F.max("touched").alias("touched"),
        F.max("live").alias("live"),
    )
    return days.withColumn("order_count", F.when(F.col("live"), F.col("order_count"))).drop("live")


def remade(spark: SparkSession, out_dir: str, changed: Sequence[str]) -> DataFrame:
    """The demand of the keys that some loads hold, committed ones or replaced ones, from the months that
    these have facts in; keys that have no facts any more get nulls."""
    mine = F.col("load_id").isin(list(changed))
    every = ledger.raw(spark, out_dir, "fact_sales")
    months = [r[MONTH] for r in every.filter(mine).select(MONTH).distinct().collect() if r[MONTH] is not None]  # bounded by the calendar
    rows = every.filter(F.col(MONTH).isin(months))
    loads = ledger.committed(spark, out_dir)
    left = {r["load_id"] for r in loads.filter(mine).select("load_id").collect()}
    gone = None
    if replaced := [c for c in changed if c not in left]:
        old = rows.filter(F.col("load_id").isin(replaced) & F.col("product_id").isNotNull() & F.col("sale_date").isNotNull())
        gone = old.select("product_id", F.to_date("sale_date").alias("day")).distinct()
    live = ledger.of_loads(rows, loads)
    found = demand_once(live.withColumn("touched", mine), gone, parts_for(live.count()))  # counted by the files' footers
    return found.filter("touched").select(*KEY, *VALUES)


def newest(spark: SparkSession, out_dir: str) -> DataFrame | None:
    """The totals as of the newest version, keys without facts left out; None before the first."""
    if not path_exists(spark, f"{out_dir}/{VERSIONS}"):
        return None
    known = versions(spark, out_dir)
    start = known.filter("whole").agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
    path = f"{out_dir}/{TABLE}"
    parts = known.filter(F.col("version") >= start).select("part", "version").distinct()  # COMPACT_AFTER at most, or some more
    rows = spark.read.option("basePath", path).parquet(path).join(F.broadcast(parts), "part")
    last = rows.groupBy(*KEY).agg(F.max_by(F.struct(*VALUES), "version").alias("v"))
    return last.select(*KEY, *[F.col(f"v.{c}").alias(c) for c in VALUES]).filter("order_count IS NOT NULL")


def read_demand(spark: SparkSession, out_dir: str) -> DataFrame:
    """Quantity, revenue and number of orders per product and day over all committed loads."""
    base, loads = newest(spark, out_dir), changed_loads(spark, out_dir)
    if base is not None and loads.isEmpty():
        return base
    facts = ledger.read(spark, out_dir, "fact_sales")
    if facts is None:
        raise ValueError(f"nothing was loaded into {out_dir}")
    if base is None:
        return demand_once(facts.withColumn("touched", F.lit(True)), None, parts_for(facts.count())).select(*KEY, *VALUES)
    later = checkpoint(remade(spark, out_dir, [r["load_id"] for r in loads.collect()]))
    return base.join(later.select(*KEY), KEY, "left_anti").unionByName(later.filter("order_count IS NOT NULL"))


def refresh(spark: SparkSession, out_dir: str) -> int:
    """Write the next version with the keys that changed; returns how many.

    If another job claims the version first, this one leaves it at that: readers make up for what no
    version has yet. Loads that are committed meanwhile do no harm, since totals are made anew for
    whole keys and the next version makes those keys again.
    """
    changed = spark.createDataFrame(changed_loads(spark, out_dir).collect(), "load_id string, delta int")  # a row per load
    if changed.isEmpty():
        return 0
    known = versions(spark, out_dir).agg(F.coalesce(F.max("version"), F.lit(0)).alias("n"), F.coalesce(F.max(F.when(F.col("whole"), F.col("version"))), F.lit(0)).alias("w")).first()
    number, whole = known["n"] + 1, known["n"] - known["w"] >= COMPACT_AFTER
    if whole:
        rows = read_demand(spark, out_dir)
    else:
        rows = remade(spark, out_dir, [r["load_id"] for r in changed.collect()])
    part = uuid.uuid4().hex + "~"  # no number, whatever its digits
    count = ledger.write_counted(rows.select(*KEY, *VALUES), f"{out_dir}/{TABLE}/part={part}")
    entry = changed.withColumns({"part": F.lit(part), "whole": F.lit(whole)})
    try:
        entry.coalesce(1).write.mode("error").parquet(f"{out_dir}/{VERSIONS}/version={number}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        return 0
    return count
