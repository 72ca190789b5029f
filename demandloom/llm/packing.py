"""Best-fit packing of documents into sequences of several permitted lengths.

Documents are dealt by hash into shards of a bounded number of pieces; each shard is packed on its
own. A shard's pieces are taken from the longest to the shortest. A piece goes into the open bin
that it fills best. If it fits into none, a bin is opened, of the permitted length that costs least
per word, counting the words that the longest pieces still to come would put into it. At the end
each bin is made as short as its content allows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.llm.components import keep
from demandloom.llm.mixing import word_count

#: Permitted sequence lengths, in words.
LENGTHS = (256, 512, 1024, 2048)
#: Cost of a bin beside its length, in words: what a sequence costs however short it is.
BIN_COST = 8
#: Documents in a shard, on average.
SHARD_DOCS = 10_000


def fill(gap: int, counts: dict[int, int], present: int) -> int:
    """Words that the longest remaining pieces put into a gap, each time the longest that fits."""
    filled, limit = 0, gap
    while limit > 0 and gap > 0:
        size = (present & ((1 << (min(gap, limit) + 1)) - 1)).bit_length() - 1
        if size <= 0:
            break
        n = min(counts[size], gap // size)
        filled += n * size
        gap -= n * size
        limit = size - 1
    return filled


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, bin_cost: float = BIN_COST) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, offset of each piece in its bin, length of each bin).

    No piece may be longer than the longest length. Of pieces of equal size, and of bins with equal
    room, the first comes first.
    """
    lengths = sorted(set(lengths))
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    counts: dict[int, int] = {}
    for s in sizes:
        counts[s] = counts.get(s, 0) + 1
    present = sum(1 << s for s in counts)
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    used: list[int] = []
    room: dict[int, list[int]] = {}  # open bins by the room they have, the newest first
    rooms = 0  # a bit for each room that some bin has
    opening: dict[tuple, int] = {}
    for i in order:
        size = sizes[i]
        counts[size] -= 1
        if not counts[size]:
            present ^= 1 << size
        fits = rooms >> size
        if fits:
            gap = (fits & -fits).bit_length() - 1 + size
            at = room[gap].pop()
            if not room[gap]:
                rooms ^= 1 << gap
        else:
            at = len(used)
            used.append(0)
            gap = _opened(size, lengths, counts, present, bin_cost, opening)
        bins[i], offsets[i] = at, used[at]
        used[at] += size
        left = gap - size
        if left:
            room.setdefault(left, []).append(at)
            rooms |= 1 << left
    return bins, offsets, [next(length for length in lengths if length >= u) for u in used]


def _opened(size: int, lengths: Sequence[int], counts: dict[int, int], present: int, bin_cost: float, known: dict) -> int:
    """The length to open for a piece: least cost per word expected in the bin, the longer of equals."""
    key = (size, present)
    if key not in known:
        options = [length for length in lengths if length >= size]
        known[key] = min(options, key=lambda n: ((n + bin_cost) / (size + fill(n - size, counts, present)), -n))
    return known[key]


def cut(total: int, longest: int) -> list[tuple[int, int]]:
    """(first word, words) of the pieces of a document: whole longest sequences and a rest."""
    return [(a, min(longest, total - a)) for a in range(0, total, longest)]


def plan(docs: DataFrame, key: dict[str, Column], size: Column, lengths: Sequence[int] = LENGTHS, bin_cost: float = BIN_COST, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row per piece: the key, ``copy``, ``size`` of the document, ``first`` and ``words`` of the
    piece, ``bin_id``, ``bin_length`` and ``bin_offset``.

    Rows with equal key and size are copies and told apart by ``copy``; they are counted before they
    are dealt out, and spread over the shards like any others. Documents without words have one row
    without a bin. Shards depend on keys, sizes and the number of rows alone.
    """
    longest, names = max(lengths), list(key)
    lean = keep(docs.select(*[c.alias(k) for k, c in key.items()], size.alias("size")).groupBy(*key, "size").agg(F.count("*").alias("copies")))
    rows = lean.agg(F.sum("copies")).first()[0] or 0
    shards = max(1, math.ceil(rows / shard_docs))
    copies = lean.select(*key, "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    dealt = copies.withColumn("shard", F.pmod(F.xxhash64(*key, "size", "copy"), F.lit(shards)))

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in [*names, "size", "copy"]])
        totals = table.column("size").to_numpy()
        row, first, words = [], [], []
        for i, total in enumerate(totals.tolist()):
            for a, n in cut(total, longest):
                row.append(i)
                first.append(a)
                words.append(n)
        at, offsets, made = pack(words, lengths, bin_cost)
        base = table.column("shard")[0].as_py() << 32
        empty = np.flatnonzero(totals == 0).tolist()
        none = [None] * len(empty)
        out = table.take(pa.array(row + empty, pa.int64())).drop_columns(["shard"])
        columns = {
            "first": first + [0] * len(empty),
            "words": words + [0] * len(empty),
            "bin_id": [base + b for b in at] + none,
            "bin_length": [made[b] for b in at] + none,
            "bin_offset": offsets + none,
        }
        for name, values in columns.items():
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    schema = copies.select("*", *[F.lit(None).cast("long").alias(c) for c in ("first", "words", "bin_id", "bin_length", "bin_offset")]).schema
    return dealt.groupBy("shard").applyInArrow(packed, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: Sequence[int] = LENGTHS, bin_cost: float = BIN_COST, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(doc_id, copy, size, first, words, bin_id, bin_length, bin_offset): the pieces of all documents.

    Sizes are words. A document longer than the longest length is cut into pieces. Null and empty
    texts have one row with 0 words and no bin. Rows with equal doc_id and size are told apart by
    ``copy``, from 0. Null ids are packed like others. An empty table gives an empty result.
    """
    return plan(docs, {"doc_id": F.col(id_col).cast("long")}, word_count(text_col), lengths, bin_cost, shard_docs)


def packed_sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: Sequence[int] = LENGTHS, bin_cost: float = BIN_COST, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(bin_id, bin_length, n_words, pieces): a row per sequence, its pieces in their order.

    A piece is a struct (bin_offset, doc_id, first, words, text), its text the words with a blank
    between them. Texts are cut into their pieces before these are joined with their places. A sequence holds at most the longest length, so a row is bounded.
    """
    key = {"doc_id": F.col(id_col).cast("long"), "digest": F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)}
    pieces = plan(docs, key, word_count(text_col), lengths, bin_cost, shard_docs).filter("words > 0")
    longest = max(lengths)
    words = F.array_remove(F.split(F.col(text_col), "[ \\t-\\r]+"), "")
    cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(longest)), lambda a: F.struct(a.cast("long").alias("first"), F.array_join(F.slice("w", a + 1, longest), " ").alias("text")))
    texts = docs.select(key["doc_id"].alias("doc_id"), key["digest"].alias("digest"), words.alias("w")).select("doc_id", "digest", F.explode(cuts).alias("cut"))
    texts = texts.select("doc_id", "digest", "cut.*").dropDuplicates(["doc_id", "digest", "first"])
    same = pieces["doc_id"].eqNullSafe(texts["doc_id"]) & (pieces["digest"] == texts["digest"]) & (pieces["first"] == texts["first"])
    rows = pieces.join(texts, same).drop(texts["doc_id"], texts["digest"], texts["first"])
    piece = F.struct("bin_offset", "doc_id", "first", "words", "text")
    found = rows.groupBy("bin_id", "bin_length").agg(F.sum("words").alias("n_words"), F.sort_array(F.collect_list(piece)).alias("pieces"))
    return found.select("bin_id", "bin_length", "n_words", "pieces")
