"""Phrases that occur together more often than their parts would: partitioned mining (SON).

The texts are dealt by hash into a fixed number of shards. Each shard is mined completely at a support
lowered to its share of the language, so a phrase that is frequent in the language is frequent in some
shard. The union of the shards' phrases are the candidates; a last pass counts all of them in all
texts. A shard may be of any size: it is mined by length, each length in one pass of all shards, and
a phrase is only looked at where both phrases one word shorter are frequent in its shard.

The passes read texts in blocks, count inside a block and send the sorted hashes and counts on, cut
by hash range. Phrases are told apart by a 64-bit hash of language and words; what a filter of bits
lets through by chance is counted too and falls out by its count. The last count also names, for each
phrase, the class of one text that holds it, classes being hashes of whole texts; a phrase is written
out from the texts of that class only, so about once, whatever the number of blocks that have it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from demandloom.llm.components import keep
from demandloom.llm.words import LOWER, MASK, PRIME, Hasher, bit_filter, flat_text, has_bit, mix, slices, word_bounds

MIN_COUNT = 100
LONGEST = 5
TOP = 2000
#: A phrase is left out if a longer one that holds it occurs this share of its times, in percent.
COVER_PERCENT = 100
#: The language of texts without one.
NO_LANG = "und"
#: Parts of the texts that are mined on their own.
SHARDS = 4
#: Bytes of text that are counted at once, and for which the counts of a group get one more range of hashes.
BLOCK_BYTES, RANGE_BYTES = 16 << 20, 64 << 20
#: Languages whose size the tasks know; in smaller ones each phrase counts as frequent in its shard.
KNOWN_LANGS = 1000
#: Most bits of the filters.
MOST_BITS = 1 << 26
#: Parts in which the phrases of a language are ranked first.
RANK_PARTS = 64
#: Classes of texts, in one of which a frequent phrase is written out.
TEXT_CLASSES = 1 << 16
#: Bytes at which a text is cut into pieces, and bytes between words.
CUTS = np.isin(np.arange(256), list(b".,;:!?\n\x0b\x0c\r"))
BETWEEN = CUTS | np.isin(np.arange(256), list(b" \t"))


def hash_of(name: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(name.encode(), 1) & MASK


def group_of(lang: str, shard: int) -> int:
    return (hash_of(lang) + shard * PRIME) & MASK


class Block:
    """The words of whole texts: hashes with their language, places, and whether the next is in the same piece."""

    def __init__(self, texts: list[pa.Array], langs: list[pa.Array], shards: list[pa.Array], classes: list[pa.Array]):
        names = pa.concat_arrays([pc.fill_null(x.cast(pa.string()), NO_LANG) for x in langs]).dictionary_encode()
        self.langs = names.dictionary.to_pylist()
        lang = names.indices.to_numpy(zero_copy_only=False)
        shard = pa.concat_arrays(shards).to_numpy(zero_copy_only=False)
        data, offsets = flat_text(pa.chunked_array(texts))
        salt = np.array([hash_of(x) for x in self.langs], dtype=np.uint64)
        self.group_of_text = salt[lang] + shard.astype(np.uint64) * np.uint64(PRIME)
        self.data, hasher = LOWER[data], Hasher()
        parts: list[tuple[np.ndarray, ...]] = []
        for low, high in slices(offsets):
            part, at = self.data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
            starts, ends = word_bounds(part, at, BETWEEN)
            text = np.searchsorted(at, starts, "right") - 1
            cut = np.cumsum(CUTS[part])[starts] if len(starts) else starts
            joined = np.zeros(len(starts), bool)
            joined[:-1] = (text[1:] == text[:-1]) & (cut[1:] == cut[:-1])
            hashes = mix(hasher.words(part, starts, ends) ^ salt[lang[low:high][text]])
            places = [(x + offsets[low]).astype(np.uint32) for x in (starts, ends)]
            parts.append((hashes, *places, joined, np.bincount(text, minlength=high - low)))
        kinds = (np.uint64, np.uint32, np.uint32, bool, np.int64)
        found = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, kind) for i, kind in enumerate(kinds)]
        self.hashes, self.starts, self.ends, self.joined, words_of_text = found
        self.groups = np.repeat(self.group_of_text, words_of_text)
        self.classes = np.repeat(pa.concat_arrays(classes).to_numpy(zero_copy_only=False).astype(np.uint16), words_of_text)
        self.words_of_lang = np.bincount(lang, weights=words_of_text, minlength=len(self.langs)).astype(np.int64).tolist()

    def spelled(self, at: np.ndarray, size: int) -> list[str]:
        """The words from each place on, with one blank between them."""
        view = memoryview(self.data)
        columns = [x[at + i].tolist() for i in range(size) for x in (self.starts, self.ends)]
        return [b" ".join([view[a:b] for a, b in zip(row[::2], row[1::2], strict=True)]).decode() for row in zip(*columns, strict=True)]

    def phrases(self, longest: int, known: np.ndarray | None, by_shard: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, places, hashes) of the phrases of each length whose shorter ones are all ``known``."""
        hashes, ok = self.hashes, np.ones(len(self.hashes), bool)
        at = np.arange(len(hashes))
        for size in range(1, longest + 1):
            if size > 1:
                both = ok[:-1] & ok[1:]
                at = np.flatnonzero(both & self.joined[:-1] if size == 2 else both)
                if size == 2:
                    hashes = hashes.copy()
                hashes[at] = mix(hashes[at] * np.uint64(PRIME) + self.hashes[at + size - 1])
            if not len(at):
                return
            yield size, at, hashes[at]
            if size < longest:
                ok = np.zeros(len(hashes), bool)
                ok[at] = True if known is None else has_bit(known, keys_of(hashes[at], self.groups[at] if by_shard else None))


def keys_of(hashes: np.ndarray, groups: np.ndarray | None) -> np.ndarray:
    """What a phrase has a bit for: itself, or itself in its shard."""
    return hashes if groups is None else mix(hashes ^ groups)


def keys_in(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """What a phrase has bits for in the class of texts from which it is written out."""
    return mix(hashes ^ (classes.astype(np.uint64) + np.uint64(1)) * np.uint64(PRIME))


def blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[Block]:
    """The batches' columns text, language, shard and class in blocks, which end with the text that fills them."""
    held: list[list[pa.Array]] = [[], [], [], []]
    size = 0
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first, before = 0, 0
        while first < batch.num_rows:
            last = min(int(np.searchsorted(upto, before + block_bytes - size)) + 1, batch.num_rows)
            for column, kept in zip(batch.columns, held, strict=True):
                kept.append(column.slice(first, last - first))
            size += int(upto[last - 1]) - before
            first, before = last, int(upto[last - 1])
            if size >= block_bytes:
                block = Block([x.cast(pa.large_binary()) for x in held[0]], *held[1:])
                held, size = [[], [], [], []], 0
                yield block
                del block
    if held[0]:
        yield Block([x.cast(pa.large_binary()) for x in held[0]], *held[1:])


def planes(values: np.ndarray) -> bytes:
    """Sorted numbers by byte planes: their high bytes hardly change, which the shuffle's codec uses."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unplaned(columns: pa.ChunkedArray, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.concatenate([np.frombuffer(x.as_buffer(), np.uint8).reshape(width, -1).T.copy().view(kind)[:, 0] for x in columns])


def frequent(rows: DataFrame, sizes: list[int], known: np.ndarray | None, by_shard: bool, support: dict[int, int], otherwise: int, ranges: int, block_bytes: int) -> DataFrame:
    """(key, hash, n): the phrases of some lengths with at least the support of their group, or ``otherwise``.

    Groups are languages in shards if ``by_shard``; else languages, and the key is that of the
    phrase in the class of one text which holds it. Only phrases whose shorter ones are all
    ``known`` are counted.
    """
    shift = np.uint64(64 - max(1, (ranges - 1).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, block_bytes):
            for size, at, hashes in block.phrases(max(sizes), known, by_shard):
                if size not in sizes:
                    continue
                mine = block.groups[at]
                for group in np.unique(block.group_of_text).tolist():
                    inside = mine == np.uint64(group)
                    if by_shard:
                        found, times = np.unique(hashes[inside], return_counts=True)
                        classes = np.zeros(0, np.uint16)
                    else:
                        found, first, times = np.unique(hashes[inside], return_index=True, return_counts=True)
                        classes = block.classes[at[inside][first]]
                    edges = np.searchsorted(found >> shift, np.arange(1 << (64 - int(shift)), dtype=np.uint64))
                    cuts = [c for c in zip(range(len(edges)), edges.tolist(), [*edges.tolist()[1:], len(found)], strict=True) if c[1] < c[2]]
                    signed = group - (1 << 64) if group >> 63 else group
                    columns = [
                        pa.array([signed] * len(cuts), pa.int64()),
                        pa.array([r for r, _, _ in cuts], pa.int32()),
                        pa.array([planes(found[a:b]) for _, a, b in cuts], pa.binary()),
                        pa.array([planes(times[a:b].astype(np.uint32)) for _, a, b in cuts], pa.binary()),
                        pa.array([planes(classes[a:b]) for _, a, b in cuts], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["part", "cut", "hashes", "times", "classes"])

    def total(table: pa.Table) -> pa.Table:
        group = table.column("part")[0].as_py() & MASK
        hashes, times = unplaned(table.column("hashes"), np.uint64), unplaned(table.column("times"), np.uint32)
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        begins = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
        sums = np.add.reduceat(times[order].astype(np.int64), begins)
        kept = sums >= support.get(group, otherwise)
        found = hashes[begins[kept]]
        if by_shard:
            keys = keys_of(found, np.uint64(group))
        else:
            keys = keys_in(found, unplaned(table.column("classes"), np.uint16)[order[begins[kept]]])
        return pa.table({"key": keys.view(np.int64), "hash": found.view(np.int64), "n": sums[kept]})

    counted = rows.mapInArrow(count, "part long, cut int, hashes binary, times binary, classes binary")
    return counted.groupBy("part", "cut").applyInArrow(total, "key long, hash long, n long")


def spelled(rows: DataFrame, known: np.ndarray, chosen: tuple[np.ndarray, np.ndarray], longest: int, block_bytes: int) -> DataFrame:
    """(lang, hash, words, size, n): phrases in the classes whose key is ``chosen``, and a row without words for the words of each language.

    Both filters look at bits of the key, the low and the high ones; ``known`` has a bit for each
    chosen phrase and those inside it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, block_bytes):
            yield batch_of(block.langs, [0] * len(block.langs), [None] * len(block.langs), 0, block.words_of_lang)
            groups = np.array([hash_of(x) for x in block.langs], dtype=np.uint64)
            order = np.argsort(groups)
            for size, at, hashes in block.phrases(longest, known, False):
                keys = keys_in(hashes, block.classes[at])
                told = np.flatnonzero(has_bit(chosen[0], keys))
                told = told[has_bit(chosen[1], keys[told] >> np.uint64(32))]
                hashes, first = np.unique(hashes[told], return_index=True)
                at = at[told[first]]
                langs = [block.langs[i] for i in order[np.searchsorted(groups[order], block.groups[at])].tolist()]
                yield batch_of(langs, hashes.view(np.int64).tolist(), block.spelled(at, size), size, [0] * len(at))

    def batch_of(langs: list, hashes: list, words: list, size: int, n: list) -> pa.RecordBatch:
        columns = [pa.array(langs, pa.string()), pa.array(hashes, pa.int64()), pa.array(words, pa.string()), pa.array([size] * len(langs), pa.int32()), pa.array(n, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "hash", "words", "size", "n"])

    return rows.mapInArrow(run, "lang string, hash long, words string, size int, n long")


def frequent_phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, longest: int = LONGEST, shards: int = SHARDS, block_bytes: int = BLOCK_BYTES
) -> tuple[DataFrame, DataFrame]:
    """(lang, size, words, f) of all phrases up to ``longest`` words with f >= ``min_count``, and (lang, n)."""
    text = F.col(text_col).cast("string")
    rows = docs.select(text.alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), *[F.pmod(F.xxhash64(text), F.lit(n)).cast("int").alias(c) for c, n in (("shard", shards), ("class", TEXT_CLASSES))])
    bytes_of = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("b"), *[F.sum(F.when(F.col("shard") == i, F.octet_length("text"))).alias(f"b{i}") for i in range(shards)])
    sizes = keep(bytes_of)
    largest = sizes.orderBy(F.desc_nulls_last("b"), "lang").limit(KNOWN_LANGS).filter("b > 0").collect()
    support = {group_of(r["lang"], i): max(1, -(-min_count * (r[f"b{i}"] or 0) // r["b"])) for r in largest for i in range(shards)}
    everything = sizes.agg(F.sum("b")).first()[0] or 0
    ranges = max(1, everything // RANGE_BYTES)

    known = candidates = None
    for size in range(1, longest + 1):
        mined = keep(frequent(rows, [size], known, True, support, 1, ranges, block_bytes))
        bits = [bit_filter(mined, c, MOST_BITS, everything) for c in ("key", "hash")]
        known, candidates = bits if size == 1 else (known | bits[0], candidates | bits[1])
    plain = rows.withColumn("shard", F.lit(0))
    total = keep(frequent(plain, list(range(1, longest + 1)), candidates, False, {}, min_count, ranges, block_bytes))
    chosen = tuple(bit_filter(total.select(c.alias("key")), "key", MOST_BITS, everything) for c in (F.col("key"), F.shiftrightunsigned("key", 32)))
    texts = spelled(plain, candidates, chosen, longest, block_bytes)
    texts = keep(texts.groupBy("lang", "hash", "size").agg(F.min("words").alias("words"), F.sum("n").alias("n")))
    found = keep(texts.filter("size > 0").join(total.select("hash", F.col("n").alias("f")), "hash").select("lang", "size", "words", "f"))
    return found, texts.filter("size = 0").select("lang", "n")


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    min_count: int = MIN_COUNT,
    longest: int = LONGEST,
    top: int = TOP,
    cover_percent: int = COVER_PERCENT,
    shards: int = SHARDS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(lang, rank, phrase, k, a, l, r, n, score): the best phrases of 2 to ``longest`` words of each language.

    Texts are cut into pieces at ``.,;:!?`` and line ends, and these into words at blanks and tabs;
    A to Z count as lower case. a, l and r are how often the phrase, its first k words and the rest
    occur inside pieces, n all words of the language. The score floor(1000 a n / (l r)) is that of
    the lowest cut, the first of equals. Phrases that nearly always stand inside a longer one are
    left out. Equal scores are ordered by a, then by phrase. Null texts have no words, texts without
    a language are ``und``; repeated rows count again; a table without words gives no rows.
    """
    phrases, words = frequent_phrases(docs, text_col, lang_col, min_count, longest, shards, block_bytes)
    parts = F.split("words", " ")
    joined = lambda first, n: F.array_join(F.slice(parts, first, n), " ")
    long = phrases.filter("size >= 2")
    cuts = long.select("lang", "words", "size", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("left", joined(F.lit(1), F.col("k"))).withColumn("right", joined(F.col("k") + 1, F.col("size") - F.col("k")))
    cuts = cuts.join(phrases.select("lang", F.col("words").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(phrases.select("lang", F.col("words").alias("right"), F.col("f").alias("r")), ["lang", "right"]).join(words, "lang")
    wide = {c: f"cast({c} AS decimal(19,0))" for c in "alrn"}
    score = F.expr(f"cast(({wide['a']} * {wide['n']} * 1000) div ({wide['l']} * {wide['r']}) AS bigint)")
    best = cuts.groupBy("lang", "words").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r", "n")).alias("b")).select("lang", "words", "b.*")

    inner = F.explode(F.array(joined(F.lit(1), F.col("size") - 1), joined(F.lit(2), F.col("size") - 1)))  # others inside are inside one of these
    covers = phrases.filter("size >= 3").select("lang", inner.alias("words"), "f").groupBy("lang", "words").agg(F.max("f").alias("longer"))
    best = best.join(covers, ["lang", "words"], "left").filter(F.coalesce(F.col("longer") * 100 < F.col("a") * cover_percent, F.lit(True)))

    order = [F.desc("score"), F.desc("a"), F.asc("words")]
    first = Window.partitionBy("lang", F.pmod(F.xxhash64("words"), F.lit(RANK_PARTS))).orderBy(*order)
    best = best.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", F.col("words").alias("phrase"), F.col("k").cast("long").alias("k"), "a", "l", "r", "n", "score")
