"""Benchmark decontamination by winnowing.

A window is ``window`` consecutive words of a benchmark item, or all words of a shorter one. Both
sides are winnowed alike: of the word grams in a window the least hash is its fingerprint, so two
equal windows have the same one, and no shared span of a window's length is missed. A document's
windows whose fingerprint no item has are left in the scan; the others meet the items' windows by
fingerprint and are extended there to the whole window, word by word. Adjoining hits become one span.

The scan keeps no text. Equal windows of all items are one row, which names the set of its items, so
a passage of many items meets a document once; documents with the same sets share one list of items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.llm.components import keep
from demandloom.llm.words import LOWER, PRIME, Hasher, bit_filter, flat_text, has_bit, mix, slices, word_bounds

WINDOW = 10
#: Word grams of a window among which the least hash is looked for, at most.
GRAMS = 5
#: Most bits of the filter that the fingerprints of the items set.
MOST_BITS = 1 << 24
#: Bytes that separate words: all ASCII but digits and letters.
BETWEEN = np.array([b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F for b in range(256)])


def gram_words(window: int) -> int:
    """Words of the grams that a window is winnowed by; a short window has fewer grams."""
    return window - min(GRAMS, (window + 1) // 2) + 1


def fingerprints(words: np.ndarray, window: int, hasher: Hasher) -> np.ndarray:
    """The least gram hash of each run of ``window`` words on end, told apart by the window's length."""
    grams = hasher.windows(words, gram_words(window))
    count = len(words) - window + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    least = grams[:count].copy()
    for j in range(1, window - gram_words(window) + 1):
        np.minimum(least, grams[j : count + j], out=least)
    return mix(least + np.uint64(window * PRIME & 0xFFFFFFFFFFFFFFFF))


class Words:
    """The words of some texts: their bytes in lower case, places, hashes, and the text of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hasher: Hasher):
        self.data, self.hasher = LOWER[data], hasher
        self.starts, self.ends = word_bounds(self.data, offsets, BETWEEN)
        self.text = np.searchsorted(offsets, self.starts, "right") - 1
        self.counts = np.bincount(self.text, minlength=len(offsets) - 1)
        self.first = np.cumsum(self.counts) - self.counts
        self.hashes = hasher.words(self.data, self.starts, self.ends)
        self.bytes = self.data.tobytes()

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and fingerprint of each window of ``size`` words inside a text."""
        found = fingerprints(self.hashes, size, self.hasher)
        inside = np.flatnonzero(self.text[: len(found)] == self.text[size - 1 :]) if len(found) else np.zeros(0, np.int64)
        return inside, found[inside]

    def spelled(self, first: int, size: int) -> str:
        return b" ".join([self.bytes[a:b] for a, b in zip(self.starts[first : first + size].tolist(), self.ends[first : first + size].tolist(), strict=True)]).decode()


def words_of(column: pa.Array, hasher: Hasher) -> Iterator[tuple[int, int, Words]]:
    """Ranges of the texts with their words."""
    data, offsets = flat_text(column)
    for low, high in slices(offsets):
        yield low, high, Words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], hasher)


def item_windows(items: DataFrame, item: Column, text: Column, window: int = WINDOW) -> DataFrame:
    """(size, hash, words, item): the windows of each item, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            names = batch.column(0).to_pylist()
            for low, _, words in words_of(batch.column(1), hasher):
                sizes = np.minimum(words.counts, window)
                for size in set(sizes.tolist()) - {0}:
                    first, hashes = words.windows(size)
                    mine = sizes[words.text[first]] == size
                    first, hashes = first[mine], hashes[mine]
                    spelled = [words.spelled(f, size) for f in first.tolist()]
                    owners = [names[low + t] for t in words.text[first].tolist()]
                    columns = [pa.array([size] * len(first), pa.int32()), pa.array(hashes.view(np.int64)), pa.array(spelled, pa.string()), pa.array(owners, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["size", "hash", "words", "item"])

    rows = items.select(item.cast("string").alias("item"), text.cast("string").alias("text"))
    return rows.mapInArrow(run, "size int, hash long, words string, item string").distinct()


def candidates(docs: DataFrame, doc: Column, text: Column, sizes: list[int], known: np.ndarray) -> DataFrame:
    """(doc_id, n_words, found): each row with its distinct windows whose fingerprint an item may have.

    ``found`` has size, hash and words of a window and the words ``at`` which it begins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            counts, found = np.zeros(batch.num_rows, np.int64), [{} for _ in range(batch.num_rows)]
            for low, high, words in words_of(batch.column(1), hasher):
                counts[low:high] = words.counts
                for size in sizes:
                    first, hashes = words.windows(size)
                    hit = np.flatnonzero(has_bit(known, hashes))
                    texts = words.text[first[hit]]
                    for f, h, t, at in zip(first[hit].tolist(), hashes[hit].view(np.int64).tolist(), texts.tolist(), (first[hit] - words.first[texts]).tolist(), strict=True):
                        found[low + t].setdefault((size, h, words.spelled(f, size)), []).append(at)
            rows = [[{"size": s, "hash": h, "words": w, "at": at} for (s, h, w), at in f.items()] for f in found]
            kind = pa.list_(pa.struct([("size", pa.int32()), ("hash", pa.int64()), ("words", pa.string()), ("at", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(rows, kind)], names=["doc_id", "n_words", "found"])

    rows = docs.select(doc.cast("long").alias("doc_id"), text.cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, found array<struct<size:int,hash:long,words:string,at:array<int>>>")


def merged(hits: DataFrame) -> DataFrame:
    """(row, sets, spans, n_hit): the windows of each row's ``hits`` joined where they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, total = [], []
            for row in batch.column("hits").to_pylist():
                at = np.concatenate([np.array(h["at"], np.int64) for h in row])
                end = np.repeat([h["size"] for h in row], [len(h["at"]) for h in row]) + at
                order = np.argsort(at, kind="stable")
                at, reach = at[order], np.maximum.accumulate(end[order])
                new = np.flatnonzero(np.r_[True, at[1:] > reach[:-1]])
                last = reach[np.r_[new[1:] - 1, len(at) - 1]]
                spans.append([{"first": int(a), "words": int(b - a)} for a, b in zip(at[new], last, strict=True)])
                total.append(int((last - at[new]).sum()))
            kind = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))
            columns = [batch.column("row"), batch.column("sets"), pa.array(spans, kind), pa.array(total, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "sets", "spans", "n_hit"])

    grouped = hits.groupBy("row").agg(F.array_sort(F.collect_set("set_id")).alias("sets"), F.collect_list(F.struct("size", "at")).alias("hits"))
    return grouped.mapInArrow(run, "row long, sets array<string>, spans array<struct<first:long,words:long>>, n_hit long")


def contamination(
    docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items): one row per input row.

    Words are runs of digits, ASCII letters in lower case and characters beyond ASCII. ``spans`` are
    the (first word, words) of the longest runs of words inside occurring windows, ``n_hit`` their
    words, ``items`` the sorted ids, as text, of the items with an occurring window. Null and empty
    texts have no words and match nothing, an item without words has no window. An item without id
    marks words, but names no item; rows of one id are one item. Repeated documents and rows without
    doc_id have rows of their own. Without items, or documents, nothing is hit.
    """
    windows = keep(item_windows(items, F.col(item_col), F.col(item_text_col), window))
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # 1 to window
    scanned = candidates(docs, F.col(doc_col), F.col(text_col), sizes, bit_filter(windows, "hash", MOST_BITS, 16 * windows.count()))
    scanned = keep(scanned.withColumn("row", F.monotonically_increasing_id()))

    key = ["size", "hash", "words"]
    number = F.xxhash64("item").cast("decimal(38,0)")
    signature = F.concat_ws(":", F.count("item"), F.coalesce(F.sum(number), F.lit(0)).cast("string"), F.coalesce(F.bit_xor(F.xxhash64("item", F.lit(1))), F.lit(0)))
    sets = keep(windows.groupBy(*key).agg(signature.alias("set_id")))
    of_set = sets.groupBy("set_id").agg(F.min(F.struct(*key)).alias("one")).select("set_id", "one.*")
    of_set = of_set.join(windows.filter("item IS NOT NULL"), key).select("set_id", "item")

    found = scanned.select("row", F.explode("found").alias("f")).select("row", "f.*")
    hit = keep(merged(found.join(sets, key).select("row", "size", "at", "set_id")).withColumn("kind", F.sha2(F.array_join("sets", ","), 256)))
    kinds = hit.groupBy("kind").agg(F.min("sets").alias("sets")).select("kind", F.explode("sets").alias("set_id"))
    named = kinds.join(of_set, "set_id").select("kind", "item").distinct().groupBy("kind").agg(F.array_sort(F.collect_list("item")).alias("items"))
    hit = hit.join(named, "kind", "left").select("row", "n_hit", "spans", "items")
    none = lambda name: F.coalesce(name, F.array().cast(hit.schema[name].dataType)).alias(name)
    return scanned.join(hit, "row", "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), none("spans"), none("items"))
