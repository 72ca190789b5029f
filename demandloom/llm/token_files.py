"""Token ids as flat binary files that can be memory-mapped.

A data set is a folder of shards. ``shard-00000.bin`` holds token ids on end, unsigned and little
endian, two bytes each if the vocabulary fits and four otherwise. ``shard-00000.idx`` holds, little
endian and in this order: the bytes ``TOKIDX01``, uint64 bytes per id, uint64 n documents, n + 1
uint64 offsets (in ids, from the shard's begin), n int64 document ids, n bytes that are 1 where the
document id is known. Shards follow each other in ascending document order; the first id of a shard
in the whole data set is the sum of the shards before it.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.llm.words import Hasher, flat_text, slices
from demandloom.session import scratch_path

MAGIC = b"TOKIDX01"
#: UTF-8 bytes of text in a shard, on average.
SHARD_BYTES = 16 << 20
#: Pieces whose ids a task remembers; all are forgotten when there are more.
REMEMBERED = 400_000
#: Letters before this code point are letters to every version of Unicode that splits words.
LATIN = 0x250
#: Bytes of text that are encoded at once.
SLICE = 2 << 20


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions at which a byte-level BPE's word splitting certainly begins a new piece.

    These are text starts, a blank before anything that is no white space, a lone newline between
    such characters, what follows it, and a comma or full stop after a letter. Where white space or
    a character that may begin with white space's bytes follows, no cut is made, which is always
    safe: the piece is longer then.
    """
    solid = np.ones(256, bool)  # bytes that surely begin no white space
    solid[:33] = False
    solid[[0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = False
    shown = np.zeros(256, bool)
    shown[0x21:0x7F] = True
    letter = np.zeros(256, bool)
    letter[0x41:0x5B] = letter[0x61:0x7B] = True
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    ended = np.zeros(n + 1, bool)
    ended[offsets] = True
    follows = np.zeros(n, bool)
    follows[:-1] = solid[data[1:]]
    follows &= ~ended[1:]
    cut[:-1] |= (data == 32) & follows
    line = np.zeros(n, bool)
    line[1:] = (data[1:] == 10) & shown[data[:-1]]
    line &= follows & ~ended[:-1]
    cut[:-1] |= line
    cut[1:] |= line
    stop = np.zeros(n, bool)
    stop[1:] = ((data[1:] == 44) | (data[1:] == 46)) & letter[data[:-1]]
    cut[:-1] |= stop & ~ended[:-1]
    return np.flatnonzero(cut)


class Encoder:
    """Encodes many texts with a byte-level BPE of the tokenizers library, each different piece once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        plain = type(self.tokenizer.pre_tokenizer) is ByteLevel and not self.tokenizer.pre_tokenizer.add_prefix_space
        self.pieces = plain and self.tokenizer.normalizer is None and self.tokenizer.post_processor is None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}
        self.hasher = Hasher()
        if self.pieces:  # the byte alphabet, as the library itself writes it
            splitter = ByteLevel(add_prefix_space=False, use_regex=False)
            self.letters = {}
            for c in map(chr, range(LATIN)):
                self.letters |= zip(c.encode(), splitter.pre_tokenize_str(c)[0][0], strict=True)

    def _encode(self, piece: bytes) -> bytes:
        """The piece's ids as four bytes each."""
        ids = self.known.get(piece)
        if ids is None:
            text = piece.decode()
            if text[text[0] == " " :].isalpha() and ord(max(text)) < LATIN:  # one word: no need to split it
                ids = [t.id for t in self.tokenizer.model.tokenize("".join([self.letters[b] for b in piece]))]
            else:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            ids = self.known[piece] = array("I", ids).tobytes()
        return ids

    def batch(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids on end, ids of each text) for slices of the texts; null counts as empty."""
        data, offsets = flat_text(texts)
        for first, last in slices(offsets, SLICE):
            part, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            if self.pieces:
                yield self._pieces(part, at)
            else:
                raw = part.tobytes()
                found = self.tokenizer.encode_batch([raw[a:b].decode() for a, b in zip(at, at[1:], strict=False)], add_special_tokens=False)
                lists = [e.ids for e in found]
                yield np.fromiter((i for ids in lists for i in ids), np.uint32), np.array([len(x) for x in lists], np.int64)

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        raw = data.tobytes()
        bounds = cuts(data, offsets)
        starts, ends = bounds[:-1], bounds[1:]
        which = pa.array(self.hasher.words(data, starts, ends)).dictionary_encode().indices.to_numpy()
        highest = np.maximum.accumulate(which)  # numbers are given in the order of the first places
        first = np.flatnonzero(np.r_[True, highest[1:] > highest[:-1]])
        lists = [self._encode(raw[a:b]) for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
        flat, begins = np.frombuffer(b"".join(lists), np.uint32), np.cumsum(sizes) - sizes
        counts = sizes[which]
        upto = np.cumsum(counts)
        ids = flat[np.repeat(begins[which] - (upto - counts), counts) + np.arange(upto[-1])]
        in_text = np.diff(np.r_[0, upto][np.searchsorted(bounds, offsets)])
        return ids, in_text


def open_folder(uri: str):
    """The file system of a shared folder's URI or path, and the path in it."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
    return fs.LocalFileSystem(), uri


def put(files, path: str, parts: Iterable[bytes]) -> None:
    """Write a file under another name and move it into place, so that a repeated task does no harm."""
    mine = f"{path}.{TaskContext.get().taskAttemptId()}"
    with files.open_output_stream(mine) as out:
        for p in parts:
            out.write(p)
    files.move(mine, path)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> list[tuple[int, int, int]]:
    """Write the documents' ids, each with ``end_id`` after it, and return (shard, documents, ids) by shard.

    Documents are in ascending doc_id, those without one first, equal ids in the order of their
    texts. Null texts count as empty. Only one row per shard comes back to the driver. An empty
    table gives no shards.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = source.repartitionByRange(max(1, math.ceil(total / shard_bytes)), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = Encoder(tokenizer), TaskContext.get().partitionId()
        kind = np.dtype("<u2" if encoder.size <= 1 << 16 else "<u4")
        ids, known, counts = [], [], []

        def encoded() -> Iterator[bytes]:
            for batch in batches:
                ids.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))
                known.append(batch.column(0).is_valid().to_numpy(zero_copy_only=False))
                for tokens, sizes in encoder.batch(batch.column(1)):
                    if end_id is not None:
                        tokens = np.insert(tokens, np.cumsum(sizes), end_id)
                        sizes = sizes + 1
                    counts.append(sizes)
                    yield tokens.astype(kind).tobytes()

        files, path = open_folder(folder)
        put(files, f"{path}/shard-{shard:05d}.bin", encoded())
        n = sum(map(len, ids))
        offsets = np.r_[0, np.cumsum(np.concatenate([[], *counts]))].astype("<u8")
        head = np.array([kind.itemsize, n], dtype="<u8").tobytes()
        parts = [np.concatenate([np.zeros(0, np.int64), *ids]).astype("<i8").tobytes(), np.concatenate([np.zeros(0, bool), *known]).astype(np.uint8).tobytes()]
        put(files, f"{path}/shard-{shard:05d}.idx", [MAGIC, head, offsets.tobytes(), *parts])
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "docs": pa.array([n], pa.int64()), "ids": pa.array([int(offsets[-1])], pa.int64())})

    files, path = open_folder(folder)
    files.create_dir(path, recursive=True)
    return sorted((r.shard, r.docs, r.ids) for r in dealt.mapInArrow(run, "shard int, docs long, ids long").collect())


def open_shard(folder: str, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, document ids, known) of a shard, memory-mapped where the file system is local."""
    from pyarrow import fs

    files, path = open_folder(folder)
    local = isinstance(files, fs.LocalFileSystem)

    def mapped(name: str) -> pa.Buffer:
        full = f"{path}/shard-{shard:05d}.{name}"
        source = pa.memory_map(full) if local and files.get_file_info(full).size else files.open_input_file(full)
        return source.read_buffer(source.size())

    index, tokens = mapped("idx"), mapped("bin")
    if index[:8].to_pybytes() != MAGIC:
        raise ValueError(f"shard {shard} in {folder} has no index of this format")
    width, n = (int(x) for x in np.frombuffer(index, "<u8", 2, 8))
    offsets = np.frombuffer(index, "<u8", n + 1, 24).astype(np.int64)
    at = 24 + 8 * (n + 1)
    return np.frombuffer(tokens, f"<u{width}"), offsets, np.frombuffer(index, "<i8", n, at), np.frombuffer(index, np.uint8, n, at + 8 * n).astype(bool)


def read_tokens(spark: SparkSession, folder: str, shards: list[tuple[int, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files; start counts over all shards."""
    bases, total = [], 0
    for shard, _, ids in shards:
        bases.append((shard, total))
        total += ids
    plan = spark.createDataFrame(bases, "shard int, base long").repartition(max(1, len(bases)), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens, offsets, ids, known = open_shard(folder, shard)
                sums = [zlib.crc32(tokens[a:b].astype("<u4")) for a, b in zip(offsets, offsets[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64(), mask=~known), pa.array(offsets[:-1] + base), pa.array(np.diff(offsets)), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return plan.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, tokenizer: str, end_id: int | None = 0) -> DataFrame:
    """The documents written as token files below the shared folder and read back."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    return read_tokens(spark, folder, write_tokens(docs, folder, tokenizer, end_id))
