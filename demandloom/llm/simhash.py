"""SimHash fingerprints, bit-sliced comparison within a radius, and groups of near-duplicates."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.functions.expr import digest
from demandloom.llm.components import components, keep

SEED = 42
SHINGLE = 3
RADIUS = 3
BITS = 64
#: Parts of a fingerprint; ``parts - radius`` of them agree in any two fingerprints within the radius.
PARTS = 5
#: Fingerprints compared with each other in one piece; larger buckets are cut into pairs of pieces.
PIECE = 4096
#: (query, word) cells whose counters are held at once.
CELLS = 1 << 18
#: Planes counted before the cells are looked through for blocks to abandon.
STEP = 16


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The bits that are set in over half the hashes of the text's word shingles; 0 without words."""
    import xxhash

    words = text.lower().split()  # on bytes: A-Z only, and the six ASCII separators
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = list(itertools.accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        hashes = [xxhash.xxh64_intdigest(joined[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=False)]
    counts = bit_counts(np.array(hashes, dtype=np.uint64))
    return int(np.packbits(2 * counts > len(hashes)).view(">u8")[0])


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, highest bit first."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, BITS)
    whole = len(bits) // 255 * 255
    small = np.add.reduce(bits[:whole].reshape(-1, 255, BITS), axis=1, dtype=np.uint8)
    return small.sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: F.Column | None = None) -> DataFrame:
    """(doc_id, key, fp): one row per input row; null text counts as empty, fp is a signed 64-bit value.

    ``key`` is a text by which the caller finds the row again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            found = np.fromiter((fingerprint(t.as_py() or b"") for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found.view(np.int64))], names=["doc_id", "key", "fp"])

    key = F.lit(None).cast("string") if key is None else key
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), key.alias("key"))
    return source.mapInArrow(run, "doc_id long, key string, fp long")


def band_columns(fp: str, radius: int = RADIUS, parts: int = PARTS) -> F.Column:
    """Keys of which two fingerprints within the radius share at least one.

    The fingerprint is cut into ``parts`` parts; every choice of ``parts - radius`` of them is a
    table, whose key is the table's number with the bits of the chosen parts.
    """
    edges = [BITS * i // parts for i in range(parts + 1)]
    keys = []
    for number, chosen in enumerate(itertools.combinations(range(parts), parts - radius)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(number).alias("band"), F.col(fp).bitwiseAND(F.lit(signed).cast("long")).alias("key")))
    return F.array(*keys)


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(BITS, words): bit b of 64 fingerprints at a time in one word, the last word filled with zeros."""
    padded = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T.reshape(BITS, -1, 64), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8")[:, :, 0]


def close_cells(planes: np.ndarray, query: np.ndarray, word: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each cell (a query and a word of 64 fingerprints): the mask of those within the radius.

    The distances of a cell are counted in vertical carry-save counters, one bit of the count per
    plane; a fingerprint whose count runs over stays marked, and a cell all of whose fingerprints
    are marked is given up.
    """
    levels = (radius + 1).bit_length()
    start = (1 << levels) - 1 - radius  # counters begin so high that radius + 1 differences carry out
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    result = np.zeros(len(query), np.uint64)
    alive = np.arange(len(query))
    counters = [np.full(len(query), full if start >> i & 1 else 0, dtype=np.uint64) for i in range(levels)]
    over = np.zeros(len(query), np.uint64)
    for low in range(0, BITS, STEP):
        for bit in range(low, low + STEP):
            wanted = np.uint64(0) - ((query >> np.uint64(bit)) & np.uint64(1))
            carry = planes[bit][word] ^ wanted
            for i in range(levels):
                counters[i], carry = counters[i] ^ carry, counters[i] & carry
            over |= carry
        going = over != full
        if not going.all():
            alive, query, word, over = alive[going], query[going], word[going], over[going]
            counters = [c[going] for c in counters]
    result[alive] = ~over
    return result


def star_links(fps: np.ndarray, side: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the fingerprints of each group as their pairs within the radius do.

    ``group`` is sorted. Where a group has members on two sides, only pairs across them count.
    All pairs are compared, but of each connected set only one link per member is returned.
    """
    n = len(fps)
    bounds = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    root = np.arange(n)
    sizes = np.diff(bounds)
    words = -(-sizes // 64)
    first_word = np.r_[0, np.cumsum(words)]
    planes = np.empty((BITS, int(first_word[-1])), np.uint64)
    slots = np.full(int(first_word[-1]) * 64, -1)  # member in each bit of the words
    member_group = np.repeat(np.arange(len(sizes)), sizes)
    place = first_word[member_group] * 64 + (np.arange(n) - bounds[:-1][member_group])
    slots[place] = np.arange(n)
    spread = np.zeros(len(slots), np.uint64)
    spread[place] = fps
    planes[:] = bit_planes(spread)
    two_sided = np.maximum.reduceat(side, bounds[:-1]) != np.minimum.reduceat(side, bounds[:-1])
    cells_of = words[member_group]
    cells_of = np.where(two_sided[member_group] & (side != 0), 0, cells_of)  # the first side asks, the second answers
    first_cell = np.r_[0, np.cumsum(cells_of)]
    begin = 0
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(first_cell, first_cell[begin] + CELLS, "right")) - 1)
        count = cells_of[begin:end]
        asker = np.repeat(np.arange(begin, end), count)
        word = first_word[member_group[asker]] + np.arange(len(asker)) - np.repeat(first_cell[begin:end] - first_cell[begin], count)
        masks = close_cells(planes, fps[asker], word, radius)
        hit = np.flatnonzero(masks)
        if len(hit):
            bits = np.unpackbits(masks[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, bit = np.nonzero(bits)
            a, b = asker[hit[row]], slots[word[hit[row]] * 64 + bit]
            good = (b >= 0) & (b != a)
            good &= ~two_sided[member_group[a]] | (side[a] != side[np.maximum(b, 0)])
            join(root, a[good], b[good])
        begin = end
    linked = np.flatnonzero(root != np.arange(n))
    return fps[linked], fps[root[linked]]


def join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Put each pair under one root, the smallest of its set; ``root`` stays flat."""
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if not len(a):
            return
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            above = root[root]
            if (above == root).all():
                break
            root[:] = above


def links(prints: DataFrame, radius: int = RADIUS, parts: int = PARTS, piece: int = PIECE) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all those within the radius.

    ``prints`` has the column fp, each value once. Buckets of one band key with more than ``piece``
    fingerprints are cut into pieces, and each pair of pieces is compared in a group of its own, so
    no task holds more than two pieces; every pair of a bucket is still compared.
    """
    bands = prints.select("fp", F.explode(band_columns("fp", radius, parts)).alias("b")).select("fp", "b.band", "b.key")
    bands = keep(bands)
    sizes = keep(bands.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1").withColumn("cut", F.ceil(F.col("n") / piece).cast("int")))
    mine = F.pmod(F.xxhash64("fp"), F.col("cut")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("cut") - 1))
    pieces = (
        bands.join(sizes, ["band", "key"])
        .select("fp", "band", "key", mine.alias("mine"), others.alias("other"))
        .select("fp", "band", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"))
    )
    dealt = pieces.repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(part: dict[str, np.ndarray]) -> pa.RecordBatch:
            a, b = star_links(part["fp"].view(np.uint64), part["side"], part["group"], radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in ("fp", "band", "key", "i", "j", "side")}
            if held is not None:
                new = {k: np.concatenate([held[k], v]) for k, v in new.items()}
            changed = np.zeros(len(new["fp"]), bool)
            for k in ("band", "key", "i", "j"):
                changed[1:] |= new[k][1:] != new[k][:-1]
            group = np.cumsum(changed)
            cut = int(np.searchsorted(group, group[-1]))  # the last group may go on
            held = {k: v[cut:] for k, v in new.items()}
            if cut:
                yield linked({"fp": np.ascontiguousarray(new["fp"][:cut]), "side": new["side"][:cut], "group": group[:cut]})
        if held is not None:
            yield linked({"fp": np.ascontiguousarray(held["fp"]), "side": held["side"], "group": np.zeros(len(held["fp"]), int)})

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, key: F.Column | None = None) -> DataFrame:
    """(doc_id, key, fp, root, component_id): one row per input row; root is the group's smallest fp.

    Two documents are linked if their fingerprints differ in at most ``radius`` bits; component_id
    is the smallest doc_id of all that are reachable over links. Equal fingerprints are compared
    once. Null and empty texts have the fingerprint 0 and are linked like any other. Rows without
    doc_id belong to a component but do not name it; a component of such rows only has a null id.
    Repeated rows give repeated results; an empty table gives an empty result.
    """
    prints = keep(fingerprints(docs, id_col, text_col, key))
    heads = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("head")))
    roots = keep(components(links(heads.select("fp"), radius), "a", "b"))
    linked = heads.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = linked.groupBy("root").agg(F.min("head").alias("component_id"))
    named = keep(linked.join(keep(names), "root").select("fp", "root", "component_id"))
    return prints.join(named, "fp").select("doc_id", "key", "fp", "root", "component_id")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The input rows, with their columns, of which each group of near-duplicates keeps one.

    It is the row with the smallest doc_id; a row without one stays only if no row of its group has
    one. Of several such rows the one with the smallest digest of all its columns stays, once if it
    is repeated.
    """
    found = near_duplicates(docs, id_col, text_col, radius, digest(docs))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first"))
    rows = docs.select(F.struct("*").alias("row"), digest(docs).alias("key"))
    kept = rows.join(first.select(F.col("first.key").alias("key")), "key", "left_semi").dropDuplicates(["key"])
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def hex_digits(fp: str) -> F.Column:
    """A signed 64-bit value as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
