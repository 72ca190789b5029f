"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Native: only DataFrame functions. The mix is a row of slots of ``block_words`` words. Slot t asks
the source in whose share of [0, 1) the van der Corput point of t falls, so that every stretch of
the mix is close to the target shares. The r-th slot of a source takes block r of its documents,
which follow each other in the order of a hash; after the last block the source begins again.

A source may hold most rows: places in a source come from sums per bucket of the hash order, ranks
of slots from sums per stretch of slots. The number of buckets and stretches grows with the square
root of the rows, so that neither a bucket nor the list of buckets of one source gets large.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from demandloom.functions.expr import digest
from demandloom.llm.components import keep

WEIGHTS = (1, 2, 3)
#: Most times that a source is gone through.
MAX_EPOCHS = 3
BLOCK_WORDS = 32
#: Size up to which the table of sources is sent to all tasks.
BROADCAST_BYTES = 4 << 20
#: Least cells of [0, 1), as a power of two, by which points meet the shares they fall in.
CELL_BITS = 10


def word_count(text_col: str) -> Column:
    """Number of words between blanks and the ASCII controls tab to carriage return; null text has none."""
    return F.coalesce(F.size(F.array_remove(F.split(F.col(text_col).cast("string"), "[ \\t-\\r]+"), "")), F.lit(0)).cast("long")


def numbered(sources: DataFrame) -> DataFrame:
    """The sources with ``no``, their place by code point from 0, null last.

    Counted per range of sources and then over the ranges, so that no task sorts all of them.
    """
    order = F.col("source").asc_nulls_last()
    dealt = keep(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    by_part = dealt.groupBy("part").agg(F.count("*").alias("n"))  # one row for each partition
    before = by_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return dealt.withColumn("inner", inner).join(before, "part").select("source", "source_size", (F.col("before") + F.col("inner")).alias("no"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> tuple[DataFrame, int]:
    """(source, no, source_size, target) and the words of all sources.

    Sources weigh ``weights`` in turn and share all words; a target that is over ``max_epochs``
    times its source's size stops there, and what is over is shared again by weight, until none is.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*map(F.lit, weights))
    rows = keep(numbered(sums).withColumn("weight", F.get(cycle, F.col("no") % len(weights)).cast("long")))
    limit = F.col("source_size") * max_epochs
    total = int(rows.agg(F.sum("source_size")).first()[0] or 0)
    rate: Column = F.lit(0.0)
    stopped, before = F.col("source_size") == 0, -1  # an empty source can take nothing
    while True:  # each round stops one more source at least
        free = rows.agg(F.sum(F.when(~stopped, F.col("weight"))), F.sum(F.when(stopped, limit)), F.count(F.when(stopped, 1))).first()
        weight, held, count = int(free[0] or 0), int(free[1] or 0), int(free[2])
        if count == before or not weight:
            break
        before = count
        rate = F.lit(float(total - held)) * F.col("weight") / F.lit(float(weight))
        stopped = stopped | (rate > limit)
    return rows.withColumn("target", F.when(stopped, limit.cast("double")).otherwise(rate)), total


def placed(counted: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """A row for each of the ``copies`` of the rows, with ``start``, the words before it in its source's order.

    Documents are ordered by the MD5 of ``key``, then by key and size; source, key and size tell rows
    apart. So rows of one key, of which there may be very many, are one row for each of their sizes
    here, and a bucket holds few rows whatever the keys are.
    """
    rows = counted.withColumn("order", F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))).withColumn("all", F.col("size") * F.col("copies"))
    buckets = max(1, math.isqrt(rows.count()))
    share = F.conv(F.substring("order", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("bucket", F.shiftright(share * buckets, 32).cast("int"))
    facts = sources.select("source", "no", "source_size", "target")
    weight = facts.agg(F.count("*").alias("n"), F.sum(F.octet_length("source")).alias("b")).first()
    if 32 * weight["n"] + (weight["b"] or 0) <= BROADCAST_BYTES:  # else the rows are shuffled by source
        facts = F.broadcast(facts)
    rows = rows.join(facts, rows["source"].eqNullSafe(facts["source"])).drop(facts["source"])
    sums = rows.groupBy("no", "bucket").agg(F.sum("all").alias("words"))
    base = keep(sums.select("no", "bucket", (F.sum("words").over(Window.partitionBy("no").orderBy("bucket")) - F.col("words")).alias("base")))
    inner = Window.partitionBy("no", "bucket").orderBy("order", key, "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("all").over(inner)).join(base, ["no", "bucket"])
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    rows = rows.withColumn("copy", copy).withColumn("start", F.col("base") + F.col("upto") - F.col("all") + F.col("copy") * F.col("size"))
    return rows.drop("base", "upto", "all", "order", "bucket", "copies")


def words_of(counted: DataFrame) -> DataFrame:
    """The words of each row with its copies, as ``targets`` wants them."""
    return counted.select("source", (F.col("size") * F.col("copies")).alias("size"))


def told_apart(rows: DataFrame, keyed: DataFrame) -> DataFrame:
    """The ``rows`` of ``placed`` with the digest of a document for each copy.

    ``keyed`` has the number of ``copies`` of each digest of a source, key and size. Where there are
    several digests the copies go to them in their order; it is found by sums per first byte of the
    digest, since very many documents may have one key.
    """
    same = ["source", "key", "size"]
    many = keyed.join(_named(rows.filter("kinds > 1").select(*same).distinct()), _equal(keyed, same), "left_semi").withColumn("byte", F.substring("digest", 1, 2))
    sums = many.groupBy(*same, "byte").agg(F.sum("copies").alias("n"))
    base = sums.select(*same, "byte", (F.sum("n").over(Window.partitionBy(*same).orderBy("byte")) - F.col("n")).alias("base"))
    inner = F.sum("copies").over(Window.partitionBy(*same, "byte").orderBy("digest")) - F.col("copies")
    many = many.withColumn("inner", inner)
    first = many.join(_named(base, "byte", "base"), _equal(many, same) & (many["byte"] == F.col("_byte"))).withColumn("first", F.col("_base") + F.col("inner"))
    number = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)).alias("copy")
    given = first.select(*same, "digest", number)
    apart = rows.filter("kinds > 1").drop("digest")
    apart = apart.join(_named(given, "copy", "digest"), _equal(apart, same) & (apart["copy"] == F.col("_copy")))
    return rows.filter("kinds = 1").unionByName(apart.select(*[c for c in rows.columns if c != "digest"], F.col("_digest").alias("digest")))


def _named(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"_{c}") for c in ("source", "key", "size", *more)])


def _equal(df: DataFrame, columns: list[str]) -> Column:
    return reduce(Column.__and__, [df[c].eqNullSafe(F.col(f"_{c}")) for c in columns])


def schedule(sources: DataFrame, total: int, block_words: int = BLOCK_WORDS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(slot, no, epoch, block): which block of which source each slot of the mix takes."""
    spark = sources.sparkSession
    slots = -(-total // block_words)
    bits = max(1, (slots - 1).bit_length())
    top = Window.orderBy("no")  # a source's share begins where those before it end
    shares = _running(sources, "no", "target", "upto").withColumn("low", F.col("upto") - F.col("target"))
    last = F.col("upto") >= float(total) * (1 - 1e-12)
    scale = float(1 << bits) / max(total, 1)
    shares = shares.select("no", "source_size", (F.col("low") * scale).alias("low"), F.when(last, float(1 << bits)).otherwise(F.col("upto") * scale).alias("high"))
    shares = shares.filter("low < high")
    cell_bits = min(bits, max(CELL_BITS, sources.count().bit_length() + 2))
    width = 1 << (bits - cell_bits)
    top_cell = F.least(F.ceil(F.col("high") / width) - 1, F.lit((1 << cell_bits) - 1))
    cells = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.greatest(F.floor(F.col("low") / width), top_cell))))
    point = F.conv(F.reverse(F.lpad(F.bin("slot"), bits, "0")), 2, 10).cast("long")
    points = spark.range(slots).select(F.col("id").alias("slot"), point.alias("point")).withColumn("cell", F.floor(F.col("point") / width))
    asked = points.join(cells, "cell").filter("point >= low AND point < high").select("slot", "no", "source_size")
    stretch = max(1, math.isqrt(slots))
    asked = keep(asked.withColumn("stretch", F.floor(F.col("slot") / stretch)))
    sums = asked.groupBy("no", "stretch").agg(F.count("*").alias("n"))
    base = keep(sums.select("no", "stretch", (F.sum("n").over(Window.partitionBy("no").orderBy("stretch")) - F.col("n")).alias("base")))
    inner = F.row_number().over(Window.partitionBy("no", "stretch").orderBy("slot")) - 1
    ranked = asked.withColumn("inner", inner).join(base, ["no", "stretch"]).withColumn("rank", F.col("base") + F.col("inner"))
    blocks = F.ceil(F.col("source_size") / block_words)
    ranked = ranked.select("slot", "no", F.floor(F.col("rank") / blocks).alias("epoch"), (F.col("rank") % blocks).alias("block"))
    return ranked.filter(F.col("epoch") < max_epochs)


def _running(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """A running sum over all sources, by ranges of their numbers and then inside each range."""
    width = max(1, math.isqrt(rows.count()))
    ranged = rows.withColumn("range", F.floor(F.col(order) / width))
    sums = ranged.groupBy("range").agg(F.sum(value).alias("s"))
    before = sums.select("range", (F.sum("s").over(Window.orderBy("range")) - F.col("s")).alias("before"))
    inner = F.sum(value).over(Window.partitionBy("range").orderBy(order))
    return ranged.withColumn("inner", inner).join(before, "range").withColumn(name, F.col("before") + F.col("inner")).drop("range", "inner", "before")


def pieces(rows: DataFrame, slots: DataFrame, carry: list[str], block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix: for each slot the documents' words in it, as (slot, epoch, no, start, first, words).

    ``first`` counts from the document's first word; (no, start) tells documents with words apart.
    """
    blocks = F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))
    spread = rows.filter("size > 0").select("no", "start", "size", *carry, F.explode(blocks).alias("block"))
    low = F.greatest(F.col("start"), F.col("block") * block_words)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    return spread.join(slots, ["no", "block"]).select("slot", "epoch", "no", "start", "size", *carry, (low - F.col("start")).alias("first"), (high - low).alias("words"))


def sized_rows(docs: DataFrame, source_col: str, text_col: str, carry: dict[str, Column]) -> DataFrame:
    return docs.select(F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"), *[c.alias(k) for k, c in carry.items()])


def taken_words(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, size, source_size, target, taken): one row per input row.

    ``taken`` is how many words the mix has of the document, repeats counted. Null and empty texts
    have no words and are not taken; a null source is a source of its own, the last. Rows with equal
    ids follow each other in the order of their sizes. An empty table gives an empty result.
    """
    sized = sized_rows(docs, source_col, text_col, {"doc_id": F.col(id_col).cast("long")})
    counted = keep(sized.groupBy("source", "doc_id", "size").agg(F.count("*").alias("copies")))
    sources, total = targets(words_of(counted))
    sources = keep(sources)
    rows = keep(placed(counted, sources, "doc_id"))
    if not total:
        return rows.select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    mixed = pieces(rows, schedule(sources, total, block_words), [], block_words)
    taken = mixed.groupBy("no", "start").agg(F.sum("words").alias("taken")).withColumn("full", F.lit(True))
    full = rows.withColumn("full", F.col("size") > 0)
    return full.join(taken, ["no", "start", "full"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents of the mix, with the columns of the input.

    A document that the mix goes through several times gives as many rows. Where the mix ends inside
    a document, its row's text is the words taken with a blank between them; a text taken whole is
    unchanged. Other columns are unchanged. Documents without words are not in the mix. Rows of one
    id and size follow each other in the order of a digest of the whole rows.
    """
    sized = sized_rows(docs, source_col, text_col, {"key": F.col(id_col).cast("long"), "digest": digest(docs), "row": F.struct("*")})
    keyed = keep(sized.groupBy("source", "key", "size", "digest").agg(F.count("*").alias("copies")))
    counted = keep(keyed.groupBy("source", "key", "size").agg(F.sum("copies").alias("copies"), F.count("*").alias("kinds"), F.min("digest").alias("digest")))
    sources, total = targets(words_of(counted))
    if not total:
        return docs.limit(0)
    sources = keep(sources)
    rows = told_apart(keep(placed(counted, sources, "key")), keyed)
    mixed = pieces(rows, schedule(sources, total, block_words), ["digest"], block_words)
    parts = keep(mixed.groupBy("no", "start", "epoch", "digest").agg(F.min("first").alias("first"), F.sum("words").alias("words")))
    parts = parts.select("digest", F.struct("first", "words").alias("part"))
    rows = sized.filter("size > 0").dropDuplicates(["digest"]).select("digest", "row", "size").join(parts, "digest")
    text = F.col("row").getField(text_col)
    cut = F.array_join(F.slice(F.array_remove(F.split(text, "[ \\t-\\r]+"), ""), F.col("part.first").cast("int") + 1, F.col("part.words").cast("int")), " ")
    kept = {c: F.col("row").getField(c) for c in docs.columns} | {text_col: F.when(F.col("part.words") == F.col("size"), text).otherwise(cut)}
    return rows.select(*[c.alias(k) for k, c in kept.items()])
