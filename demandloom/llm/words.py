"""Vectorised word splitting and hashing over Arrow text, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What separates words: blank and the ASCII controls tab to carriage return.
SPACES = (9, 10, 11, 12, 13, 32)
#: What a byte becomes in lower case, A to Z only.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)
#: Bytes of text that are hashed at once; bounds the eight-byte arrays made for them.
SLICE_BYTES = 1 << 20
PRIME = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1


def flat_text(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts on end, and the n + 1 offsets of the texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    if data is None or not len(at) or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes each, at least one text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray, between: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where words start and end; no word runs over a text's end.

    ``between`` tells for each of the 256 bytes whether it separates words; the white space if None.
    """
    if between is None:
        between = np.zeros(256, bool)
        between[list(SPACES)] = True
    blank = between[data]
    if not len(blank):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    full = offsets[:-1] < offsets[1:]
    before, after = np.empty_like(blank), np.empty_like(blank)
    before[0] = after[-1] = True
    before[1:], after[:-1] = blank[:-1], blank[1:]
    before[offsets[:-1][full]] = True
    after[offsets[1:][full] - 1] = True
    word = ~blank
    return np.flatnonzero(word & before), np.flatnonzero(word & after) + 1


def mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int, base: int = PRIME) -> tuple[np.ndarray, np.ndarray]:
    """base^0 .. base^n modulo 2^64, and their inverses."""
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        steps = np.full(n + 1, np.uint64(b), dtype=np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def bit_filter(hashes: DataFrame, column: str, most_bits: int, wanted: int) -> np.ndarray:
    """A table of about ``wanted`` bits, one set for each hash of the column; ``has_bit`` looks them up.

    It never has more than ``most_bits`` bits: with more hashes it lets more others pass, and a
    caller which then looks exactly loses nothing.
    """
    bits = 1 << 10
    while bits < min(most_bits, wanted):
        bits *= 2
    place = hashes.select(F.col(column).bitwiseAND(F.lit(bits - 1)).alias("place"))
    cells = place.groupBy(F.expr("place >> 6").alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 AS int))")).alias("set"))
    rows = cells.toArrow()  # at most most_bits / 64 rows, which tasks make before they are shuffled
    table = np.zeros(bits // 64, np.int64)
    table[rows.column("cell").to_numpy()] = rows.column("set").to_numpy()
    return table.view(np.uint64)


def has_bit(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(64 * len(table) - 1)
    return (table[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


class Hasher:
    """Polynomial hashes modulo 2^64 of byte ranges and of word windows."""

    def __init__(self, seed: int = 1):
        self.bytes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(PRIME) + np.uint64(seed * 0x632BE59BD9B4E019 & MASK))
        self.up, self.down = powers(SLICE_BYTES)

    def _grow(self, n: int) -> None:
        if n >= len(self.up):
            self.up, self.down = powers(2 * n)

    def _ranges(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(values))
        sums = np.empty(len(values) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(values * self.up[: len(values)], out=sums[1:])
        return (sums[ends] - sums[starts]) * self.down[starts]

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = self._ranges(self.bytes[data], starts, ends)
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(PRIME))

    def windows(self, words: np.ndarray, size: int) -> np.ndarray:
        """Hash of each run of ``size`` words on end; the caller picks those inside one text."""
        if len(words) < size:
            return np.zeros(0, np.uint64)
        starts = np.arange(len(words) - size + 1)
        return mix(self._ranges(words, starts, starts + size))
