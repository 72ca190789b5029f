"""Substring de-duplication by factoring documents against reference blocks (relative Lempel-Ziv).

The documents are cut into blocks of ascending doc_id. Every block is a reference: its words are
numbered, and its index gives for each different window of ``window`` words, the shortest factor
that counts, the first place of that window. A document is parsed from left to right against the
indexes of all earlier blocks and the earlier documents of its own. Where the index knows the window
at a word, a factor begins: it copies from that place and grows by a word as long as the next window
is known at the next place of the same block. Where it ends, the windows across its end are looked
up in turn, and the next known one begins the next factor, so adjoining or overlapping factors leave
no gap; between factors stand literal words. The factors' words are the duplicate spans.

No block is compared with every other: the sorted window hashes of a block are cut by hash range
into buckets, one group per bucket finds the earliest place of each hash, and sends it back to the
later blocks that have the hash too. So what is shuffled is the text once, about ten bytes for each
different window of a block, and a place for each window that was seen before; the most frequent
passage appears once per block.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.llm.words import Hasher, flat_text, slices, word_bounds

WINDOW = 13
#: UTF-8 bytes of text in a reference block, on average.
BLOCK_BYTES = 4 << 20
#: UTF-8 bytes of text whose window hashes meet in one bucket, on average.
BUCKET_BYTES = 16 << 20
#: Quantiles of doc_id that are known exactly; blocks between two of them are cut evenly.
QUANTILES = 256


def below(value: Column, bounds: list[int], low: int = 0) -> Column:
    """How many of the sorted bounds are at most the value, by halving."""
    if not bounds:
        return F.lit(low)
    half = len(bounds) // 2
    return F.when(value < F.lit(bounds[half]), below(value, bounds[:half], low)).otherwise(below(value, bounds[half + 1 :], low + half + 1))


def blocks(docs: DataFrame, block_bytes: int, bucket_bytes: int) -> tuple[DataFrame, int]:
    """The documents with the number of their block, which grows with doc_id, and the number of buckets.

    Documents without doc_id are dealt out by the hash of their text.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, math.ceil(total / block_bytes))
    ranges = min(count, QUANTILES)
    percents = [i / ranges for i in range(ranges + 1)]
    found = docs.agg(F.percentile_approx("doc_id", percents, 10 * QUANTILES * 10)).first()[0]
    spread = F.pmod(F.xxhash64("text"), F.lit(count))
    if not found:
        return docs.withColumn("block", spread), max(1, math.ceil(total / bucket_bytes))
    low, bounds = found[0], sorted(set(found[1:-1]) - {found[0]})
    edges = [low, *bounds, max(found[-1], *bounds) if bounds else found[-1]]
    parts = math.ceil(count / (len(bounds) + 1))
    at = below(F.col("doc_id"), bounds)
    if parts > 1:
        begin = F.get(F.array(*map(F.lit, map(float, edges[:-1]))), at)
        width = F.get(F.array(*(F.lit(float(max(b - a, 1))) for a, b in itertools.pairwise(edges))), at)
        inner = F.floor((F.col("doc_id").cast("double") - begin) / width * parts)
        at = at * parts + F.greatest(F.lit(0), F.least(inner, F.lit(parts - 1)))
    block = F.when(F.col("doc_id").isNull(), spread).otherwise(at).cast("long")
    return docs.withColumn("block", block), max(1, math.ceil(total / bucket_bytes))


def windows(texts: pa.ChunkedArray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; hash and first word (counted over all texts) of each window inside a text."""
    data, offsets = flat_text(texts)
    hasher = Hasher()
    counts = np.zeros(len(offsets) - 1, np.int64)
    hashes, first_words, words_before = [], [], 0
    for first, last in slices(offsets):
        part, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        starts, ends = word_bounds(part, at)
        text = np.searchsorted(at, starts, "right") - 1
        counts[first:last] = np.bincount(text, minlength=last - first)
        found = hasher.windows(hasher.words(part, starts, ends), size)
        inside = np.flatnonzero(text[: len(found)] == text[size - 1 :]) if len(found) else np.zeros(0, np.int64)
        hashes.append(found[inside])
        first_words.append(inside + words_before)
        words_before += len(starts)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return counts, join(hashes, np.uint64), join(first_words, np.int64)


def bucket_edges(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of the equal hash ranges begins in the sorted hashes."""
    limits = np.array([((i << 64) + buckets - 1) // buckets for i in range(buckets)], dtype=np.uint64)
    return np.r_[np.searchsorted(hashes, limits), len(hashes)]


def planes(values: np.ndarray) -> bytes:
    """Numbers by byte planes: the high bytes of sorted hashes and of places hardly change, which the shuffle's codec uses."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def unplaned(part: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(part.as_buffer(), np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind)[:, 0]


def numbered(table: pa.Table) -> pa.Table:
    """The rows in the order in which a block's words are numbered; rows without doc_id come last."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, factors, kept_text): one row per input row.

    ``factors`` is the parse, without its literal words: (first word, words, block, position), where
    the same words stand from ``position`` on in the reference ``block``, whose words are numbered
    from 0 in the order of doc_id and text. ``spans`` are the (first word, words) that factors cover:
    all words in a window whose words also begin a window in a document with a smaller doc_id.
    ``kept_text`` is the other words, unchanged, with one blank between them. Null and empty texts
    have no words. Rows without doc_id neither lose words nor make others lose any; rows with equal
    ids are not compared with each other. Windows are told apart by 64-bit hashes. An empty table
    gives an empty result.
    """
    source, buckets = blocks(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), block_bytes, bucket_bytes)

    def index(table: pa.Table) -> pa.Table:
        known = numbered(table.filter(table.column("doc_id").is_valid()))
        _, found, places = windows(known.column("text"), window)
        hashes, first = np.unique(found, return_index=True)
        places = places[first].astype(np.uint32)
        edges = bucket_edges(hashes, buckets)
        used = np.flatnonzero(np.diff(edges))
        block = table.column("block")[0].as_py()
        columns = {"bucket": pa.array(used, pa.int32()), "block": pa.array([block] * len(used), pa.int64())}
        for name, values in (("hashes", hashes), ("places", places)):
            columns[name] = pa.array([planes(values[edges[b] : edges[b + 1]]) for b in used], pa.binary())
        return pa.table(columns)

    def earliest(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        parts = [unplaned(h, np.uint64) for h in table.column("hashes")]
        sizes = [len(p) for p in parts]
        values = np.concatenate(parts)
        order = np.argsort(values, kind="stable")  # equal hashes stay in the order of their blocks
        values = values[order]
        again = np.zeros(len(values), bool)
        again[1:] = values[1:] == values[:-1]
        first = np.empty(len(values), np.int64)  # where each hash stands in the earliest block
        first[order] = order[np.maximum.accumulate(np.where(again, 0, np.arange(len(values))))]
        seen = first != np.arange(len(values))
        block_of = np.repeat(table.column("block").to_numpy().astype(np.uint32), sizes)
        place_of = np.concatenate([unplaned(x, np.uint32) for x in table.column("places")])
        out = {"block": [], "bucket": [], "seen": [], "from_block": [], "from_place": []}
        upto = np.cumsum(sizes)
        for block, a, b in zip(table.column("block").to_pylist(), upto - sizes, upto, strict=True):
            if seen[a:b].any():
                source_of = first[a:b][seen[a:b]]
                row = (block, table.column("bucket")[0].as_py(), np.packbits(seen[a:b]).tobytes(), planes(block_of[source_of]), planes(place_of[source_of]))
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
        return pa.table(out, schema=pa.schema([("block", pa.int64()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("seen", "from_block", "from_place"))]))

    def parse(table: pa.Table, seen: pa.Table) -> pa.Table:
        return factored(table, seen, window, buckets)

    hashes = source.groupBy("block").applyInArrow(index, "bucket int, block long, hashes binary, places binary")
    seen = hashes.groupBy("bucket").applyInArrow(earliest, "block long, bucket int, seen binary, from_block binary, from_place binary")
    schema = "doc_id long, n_words long, n_removed long, spans array<struct<first:long, words:long>>, factors array<struct<first:long, words:long, block:long, position:long>>, kept_text string"
    return source.groupBy("block").cogroup(seen.groupBy("block")).applyInArrow(parse, schema)


def places_of(table: pa.Table, seen: pa.Table, window: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text of a block, and for each word the block and place that the indexes give for the window there, else -1."""
    ids = table.column("doc_id").combine_chunks()
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    doc_ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
    counts, hashes, first_words = windows(table.column("text"), window)
    doc = np.searchsorted(np.cumsum(counts), first_words, "right")
    from_block, from_place = (np.full(int(counts.sum()), -1, np.int64) for _ in range(2))
    if len(doc):
        inside = known[doc]
        hashes, first_words, doc = hashes[inside], first_words[inside], doc[inside]
    if not len(hashes):
        return counts, from_block, from_place
    order = np.argsort(hashes, kind="stable")  # equal hashes stay in the order of their places, so of their doc_ids
    ordered, at = hashes[order], first_words[order]
    begins = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    block, place = np.full(len(begins), -1, np.int64), np.full(len(begins), -1, np.int64)
    edges = bucket_edges(ordered[begins], buckets)
    for bucket, flags, blocks_, places in zip(*(seen.column(c) for c in ("bucket", "seen", "from_block", "from_place")), strict=True):
        a, b = edges[bucket.as_py()], edges[bucket.as_py() + 1]
        told = a + np.flatnonzero(np.unpackbits(np.frombuffer(flags.as_buffer(), np.uint8), count=b - a))
        block[told], place[told] = unplaned(blocks_, np.uint32), unplaned(places, np.uint32)
    group = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(ordered)]))
    owner = doc_ids[doc[order]]
    here = (block[group] < 0) & (owner > owner[begins][group])  # first seen in an earlier document of this block
    from_block[at] = np.where(here, table.column("block")[0].as_py(), block[group])
    from_place[at] = np.where(here, at[begins][group], place[group])
    return counts, from_block, from_place


def factors_of(from_block: np.ndarray, from_place: np.ndarray, window: int) -> list[np.ndarray]:
    """First word, words, block and position of the factors, from the place of the window at each word.

    A factor goes on while the next window has the next place of its block. No factor runs over the
    end of a text: the words there begin no window.
    """
    known = from_block >= 0
    goes_on = np.zeros(len(known), bool)
    goes_on[1:] = known[1:] & (from_block[1:] == from_block[:-1]) & (from_place[1:] == from_place[:-1] + 1)
    first = np.flatnonzero(known & ~goes_on)
    last = np.flatnonzero(known & ~np.r_[goes_on[1:], False])
    return [first, last - first + window, from_block[first], from_place[first]]


def factored(table: pa.Table, seen: pa.Table, window: int, buckets: int) -> pa.Table:
    """The parse of a block's documents, given where earlier blocks have the windows it shares with them."""
    table = numbered(table)
    counts, from_block, from_place = places_of(table, seen, window, buckets)
    ends = np.cumsum(counts)
    factors = factors_of(from_block, from_place, window)
    depth = np.zeros(int(counts.sum()) + 1, np.int64)
    np.add.at(depth, factors[0], 1)
    np.add.at(depth, factors[0] + factors[1], -1)
    removed = np.cumsum(depth[:-1]) > 0
    factor_edges = np.searchsorted(factors[0], np.r_[0, ends])
    texts, spans, gone = [], [], []
    for text, n, end in zip(table.column("text"), counts, ends, strict=True):
        mask = removed[end - n : end]
        words = (text.as_py() or "").encode().split()
        if mask.any():
            turns = np.flatnonzero(np.diff(np.r_[False, mask, False]))
            spans.append([{"first": int(a), "words": int(b - a)} for a, b in turns.reshape(-1, 2)])
            words = itertools.compress(words, ~mask)
        else:
            spans.append([])
        gone.append(int(mask.sum()))
        texts.append(b" ".join(words))
    factors[0] = factors[0] - np.repeat(ends - counts, np.diff(factor_edges))
    parts = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in factors], names=["first", "words", "block", "position"])
    kind = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))
    columns = {
        "doc_id": table.column("doc_id"),
        "n_words": counts,
        "n_removed": pa.array(gone, pa.int64()),
        "spans": pa.array(spans, kind),
        "factors": pa.ListArray.from_arrays(pa.array(factor_edges, pa.int32()), parts),
        "kept_text": pa.array(texts, pa.binary()).cast(pa.string()),
    }
    return pa.table(columns)
