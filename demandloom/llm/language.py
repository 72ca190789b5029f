"""Language identification by a small convolutional network over bytes, trained here in numpy.

A text is cut into windows of ``WINDOW`` bytes, the last one filled up with a byte value of its own.
Each window goes through filters of several widths over byte embeddings, the maximum of each filter
over the window, and a softmax; a text's probabilities are the mean over its windows, weighted by
their bytes. For prediction, embedding and filters are folded into tables over byte pairs, so that
a filter's response is the sum of two table rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.llm.words import flat_text, slices

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
#: Value of the filling, beside the 256 bytes.
FILLING = 256
#: Bound of the training sample: windows of each language at most, and documents they come from.
WINDOWS_PER_LANGUAGE = 1200
WINDOWS_PER_DOCUMENT = 3
EPOCHS = 12
BATCH = 64
LEARNING_RATE = 0.01
#: Bytes of text and windows that are worked on at once.
SLICE_BYTES, SLICE_WINDOWS = 1 << 20, 256
UNKNOWN = "und"


@dataclass
class Network:
    """Weights; ``filters[i]`` is (WIDTHS[i] * EMBEDDING, FILTERS)."""

    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    filter_bias: np.ndarray
    dense: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], rng: np.random.Generator) -> Network:
        filters = [rng.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS]
        total = FILTERS * len(WIDTHS)
        embedding = rng.normal(0, 1, (FILLING + 1, EMBEDDING)).astype(np.float32)
        dense = rng.normal(0, total**-0.5, (total, len(languages))).astype(np.float32)
        return cls(languages, embedding, filters, np.zeros(total, np.float32), dense, np.zeros(len(languages), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, self.filter_bias, self.dense, self.bias]

    def step(self, windows: np.ndarray, wanted: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross-entropy over a batch of windows."""
        n = len(windows)
        embedded = self.embedding[windows]  # (n, WINDOW, EMBEDDING)
        pooled, places, fields = [], [], []
        for width, weights in zip(WIDTHS, self.filters, strict=True):
            field = np.concatenate([embedded[:, i : WINDOW - width + 1 + i] for i in range(width)], axis=2)
            response = field @ weights
            places.append(response.argmax(axis=1))
            pooled.append(np.take_along_axis(response, places[-1][:, None], axis=1)[:, 0])
            fields.append(field)
        summed = np.concatenate(pooled, axis=1) + self.filter_bias
        hidden = np.maximum(summed, 0)
        share = softmax(hidden @ self.dense + self.bias)
        share[np.arange(n), wanted] -= 1
        share /= n
        back = (share @ self.dense.T) * (summed > 0)
        grad_embedding = np.zeros_like(self.embedding)
        grad_filters = []
        for k, (width, weights) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            own = back[:, k * FILTERS : (k + 1) * FILTERS]
            best = np.take_along_axis(fields[k], places[k][:, :, None], axis=1)  # (n, FILTERS, width * EMBEDDING)
            grad_filters.append(np.einsum("nf,nfd->df", own, best))
            to_field = (own[:, :, None] * weights.T[None]).reshape(n, FILTERS, width, EMBEDDING)
            for i in range(width):
                np.add.at(grad_embedding, np.take_along_axis(windows, places[k] + i, axis=1), to_field[:, :, i])
        return [grad_embedding, *grad_filters, back.sum(axis=0), hidden.T @ share, share.sum(axis=0)]

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses' parts by the pair of bytes at a place, and by the pair two places on.

        A filter of width 2 has its first part only; one of width 3 adds the third byte's part.
        """
        size = FILLING + 1
        by_byte = [[self.embedding @ w[i * EMBEDDING : (i + 1) * EMBEDDING] for i in range(width)] for width, w in zip(WIDTHS, self.filters, strict=True)]
        first = np.concatenate([parts[0][:, None] + parts[1][None] for parts in by_byte], axis=2)
        second = np.concatenate([(parts[2][:, None] if len(parts) > 2 else 0) + (parts[3][None] if len(parts) > 3 else 0) + np.zeros((size, size, FILTERS), np.float32) for parts in by_byte], axis=2)
        return first.reshape(size * size, -1), second.reshape(size * size, -1)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def window_bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, text of each window, its bytes): every byte of every text is in one window."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = offsets[:-1][text] + number * WINDOW
    length = np.minimum(sizes[text] - number * WINDOW, WINDOW)
    places = begin[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < length[:, None]
    windows = np.full(places.shape, FILLING, np.int32)
    windows[inside] = data[places[inside]]
    return windows, text, length


def train(windows: np.ndarray, wanted: np.ndarray, languages: list[str], seed: int = 7) -> Network:
    """Fit by Adam on mini-batches; the same sample always gives the same network."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(languages, rng)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    t = 0
    for epoch in range(EPOCHS):
        rate = LEARNING_RATE * (0.1 if epoch >= EPOCHS * 3 // 4 else 1.0)
        order = rng.permutation(len(windows))
        for low in range(0, len(order), BATCH):
            pick = order[low : low + BATCH]
            t += 1
            for p, g, (m, v) in zip(net.parameters(), net.step(windows[pick], wanted[pick]), moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


def held_out(id_col: str) -> Column:
    """Documents that nothing is learned from: crc32 of the id's text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[list[bytes], list[str]]:
    """Windows of text and their languages, at most ``WINDOWS_PER_LANGUAGE`` of each language.

    Documents are taken by a hash of the id, their windows from places by a hash; both bounds are
    parameters of the module. Only these windows come to the driver.
    """
    known = docs.filter(F.col(id_col).isNotNull() & ~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = known.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("binary").alias("raw"))
    wanted = WINDOWS_PER_LANGUAGE // WINDOWS_PER_DOCUMENT
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    size = F.octet_length("raw")
    draw = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, wanted / n))]) if sizes else None
    if share is None:
        return [], []
    starts = F.array(*[(F.pmod(F.xxhash64("id", F.lit(10 + k)), F.greatest(F.lit(1), size - WINDOW + 1)) + 1).cast("int") for k in range(WINDOWS_PER_DOCUMENT)])
    picked = rows.filter(draw < F.element_at(share, F.col("lang"))).select("id", "lang", F.explode(F.transform(starts, lambda s: F.substring("raw", s, F.lit(WINDOW)))).alias("piece"))
    found, left = [], dict.fromkeys(sizes, WINDOWS_PER_LANGUAGE)
    for r in picked.orderBy("id", "piece").limit(2 * WINDOWS_PER_LANGUAGE * len(sizes)).collect():
        if left[r["lang"]] > 0:
            left[r["lang"]] -= 1
            found.append((bytes(r["piece"]), r["lang"]))
    return [f[0] for f in found], [f[1] for f in found]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """The network learned from a bounded sample of labelled rows; None without any."""
    pieces, langs = training_sample(docs, id_col, text_col, lang_col)
    if not pieces:
        return None
    languages = sorted(set(langs))
    data, offsets = flat_text(pa.array(pieces, pa.large_binary()))
    windows, text, _ = window_bytes(data, offsets)
    wanted = np.array([languages.index(x) for x in langs])[text]
    return train(windows, wanted, languages)


def probabilities(net: Network, tables: tuple[np.ndarray, np.ndarray], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, languages): mean over all windows of each text; texts without bytes have zeros."""
    first, second = tables
    windows, text, length = window_bytes(data, offsets)
    total = np.zeros((len(offsets) - 1, len(net.languages)), np.float64)
    tails = [WINDOW - w + 1 for w in WIDTHS]
    for low in range(0, len(windows), SLICE_WINDOWS):
        part = windows[low : low + SLICE_WINDOWS]
        pairs = part[:, :-1] * (FILLING + 1) + part[:, 1:]
        response = first[pairs]
        response[:, :-2] += second[pairs[:, 2:]]
        # at the last place of width 3 no fourth byte follows; its filters have no part for one
        response[:, -2] += second[part[:, -1] * (FILLING + 1)]
        pooled = [response[:, :tail, k * FILTERS : (k + 1) * FILTERS].max(axis=1) for k, tail in enumerate(tails)]
        hidden = np.maximum(np.concatenate(pooled, axis=1) + net.filter_bias, 0)
        share = softmax(hidden @ net.dense + net.bias)
        np.add.at(total, text[low : low + SLICE_WINDOWS], share * length[low : low + SLICE_WINDOWS, None])
    sizes = np.maximum(np.diff(offsets), 1)
    return total / sizes[:, None]


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): one row per input row.

    The prediction is the most likely language, the first in order of equals, and its probability;
    ``und`` and 0 if the text is null or has no letter, or if there was nothing to learn from.
    Texts are read whole; repeated rows give repeated results; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else None
        for batch in batches:
            data, offsets = flat_text(batch.column(2))
            names, scores = [], []
            for a, b in slices(offsets, SLICE_BYTES):
                if net is None:
                    names += [UNKNOWN] * (b - a)
                    scores += [0.0] * (b - a)
                    continue
                found = probabilities(net, tables, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                lettered = [has_letter(bytes(data[offsets[i] : offsets[i + 1]])) for i in range(a, b)]
                names += [net.languages[k] if ok else UNKNOWN for k, ok in zip(found.argmax(axis=1), lettered, strict=True)]
                scores += [min(1.0, float(x)) if ok else 0.0 for x, ok in zip(found.max(axis=1), lettered, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def has_letter(raw: bytes) -> bool:
    """Whether a UTF-8 text has a letter of any script."""
    text = raw.decode()
    return text[:64].isalpha() or any(map(str.isalpha, text))
