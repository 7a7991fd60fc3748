"""Language identification with a convolutional network over bytes, trained here in numpy.

A text is cut into windows of WINDOW bytes that cover it whole. Each byte becomes a small vector, filters of
several widths slide over the window, each filter keeps its maximum, and a softmax layer gives the languages'
probabilities. A text's probabilities are the mean over its windows, weighted by their bytes.

Training reads a bounded sample: of every language at most ``docs_per_language`` labelled texts, fewer where
there are so many languages that they would be over ``most_docs``, and at most ``windows_per_doc`` windows of
each, spread over the whole text. The rows are chosen by a hash of doc_id, so reruns give the same network.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logmill.llm.common import bucket_of, bytes_of, with_results

WINDOW, DIM, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 20
#: Windows that are looked at together.
TOGETHER = 2048
UNKNOWN = "und"


@dataclass
class ByteCNN:
    """Weights: byte vectors, the filters of all widths padded to the largest, and the softmax layer."""

    languages: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """For each place in each window the vectors of the bytes under the widest filter, side by side."""
        wide = max(WIDTHS) * DIM
        x = self.embed[windows].reshape(len(windows), -1)
        return np.lib.stride_tricks.sliding_window_view(x, wide, axis=1)[:, ::DIM].reshape(-1, wide)

    def convolve(self, windows: np.ndarray) -> np.ndarray:
        return (self.columns(windows) @ self.filters).reshape(len(windows), WINDOW - max(WIDTHS) + 1, -1)

    def probabilities(self, windows: np.ndarray, step: int = 128) -> np.ndarray:
        """Softmax for each window, shape (n, languages)."""
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for i in range(0, len(windows), step):
            pooled = np.maximum(self.convolve(windows[i : i + step]).max(1) + self.bias, 0)
            out[i : i + step] = softmax(pooled @ self.out + self.out_bias)
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def places(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that cover each text: the row, the first byte and the length of each."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[:-1][row] + nth * WINDOW
    return row, start, np.minimum(WINDOW, offsets[1:][row] - start)


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of some windows, zero-padded at their ends."""
    if not len(start):
        return np.zeros((0, WINDOW), np.uint8)
    lo, hi = int(start.min()), int(start.max()) + WINDOW
    part = data[lo:hi]
    padded = np.concatenate([part, np.zeros(hi - lo - len(part), np.uint8)]) if len(part) < hi - lo else part
    windows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[start - lo]
    short = np.flatnonzero(length < WINDOW)
    windows[short] *= np.arange(WINDOW) < length[short, None]
    return windows


def fit(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 6, batch: int = 64, rate: float = 0.004, seed: int = 7) -> ByteCNN:
    """Adam on the cross entropy; the maximum passes its gradient to the place it came from."""
    rng = np.random.default_rng(seed)
    wide, n_filters = max(WIDTHS), FILTERS * len(WIDTHS)
    mask = np.concatenate([np.repeat((np.arange(wide) < w).astype(np.float32), DIM)[:, None].repeat(FILTERS, 1) for w in WIDTHS], 1)
    net = ByteCNN(
        languages,
        rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
        (rng.normal(0, 0.25, (wide * DIM, n_filters)) * mask).astype(np.float32),
        np.zeros(n_filters, np.float32),
        rng.normal(0, 0.1, (n_filters, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    net.embed[0] = 0
    weights = [net.embed, net.filters, net.bias, net.out, net.out_bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    places = WINDOW - wide + 1
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            x, y = windows[pick], labels[pick]
            columns = net.columns(x)
            conv = (columns @ net.filters).reshape(len(x), places, -1)
            best = conv.argmax(1)
            pooled = np.take_along_axis(conv, best[:, None], 1)[:, 0] + net.bias
            hidden = np.maximum(pooled, 0)
            delta = softmax(hidden @ net.out + net.out_bias)
            delta[np.arange(len(y)), y] -= 1
            delta /= len(y)
            back = (delta @ net.out.T) * (pooled > 0)
            seen = columns.reshape(len(x), places, -1)[np.arange(len(x))[:, None], best]
            g_filters = np.einsum("nfk,nf->kf", seen, back) * mask
            under = (back[:, :, None] * net.filters.T[None]).reshape(-1, DIM)
            at = x[np.arange(len(x))[:, None, None], best[:, :, None] + np.arange(wide)].ravel()
            g_embed = np.stack([np.bincount(at, under[:, d], 256) for d in range(DIM)], 1).astype(np.float32)
            g_embed[0] = 0
            t += 1
            for w, m, v, g in zip(weights, first, second, (g_embed, g_filters, back.sum(0), hidden.T @ delta, delta.sum(0)), strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


def train(labelled: DataFrame, docs_per_language: int = 300, windows_per_doc: int = 6, most_docs: int = 19_200) -> ByteCNN | None:
    """Fit the network on (doc_id, text, lang); rows with a null text or lang are left out. None if no row is left.

    Every language is learnt. The sample reaches the driver as windows: at most most_docs (or one for each language) *
    windows_per_doc * 256 bytes. Of rows with one doc_id and language one counts, that whose text has the least hash.
    """
    known = labelled.where("text is not null and lang is not null and length(text) > 0").select("doc_id", "lang", "text")
    n = known.select("lang").distinct().count()
    if not n:
        return None
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = known.select("doc_id", "lang").withColumn("nth", nth).where(F.col("nth") <= min(docs_per_language, max(1, most_docs // n)))
    ids = chosen.select("doc_id", "lang").distinct().collect()  # bounded likewise
    small = labelled.sparkSession.createDataFrame(ids, "lm_id long, lm_lang string")
    few = known.join(F.broadcast(small), F.col("doc_id").eqNullSafe(F.col("lm_id")) & (F.col("lang") == F.col("lm_lang"))).groupBy("doc_id", "lang").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column("text"))
            row, start, length = places(offsets)
            if not len(row):
                continue
            first = np.searchsorted(row, np.arange(batch.num_rows))
            count = np.bincount(row, minlength=batch.num_rows)
            take = np.unique(np.concatenate([f + (np.arange(windows_per_doc) * c) // windows_per_doc for f, c in zip(first, count, strict=True) if c]))
            windows = [gather(data, start[k : k + 1], length[k : k + 1])[0].tobytes() for k in take]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row[take])), batch.column("lang").take(pa.array(row[take])), pa.array(windows, pa.binary())], names=["doc_id", "lang", "window"])

    rows = few.mapInArrow(sample, "doc_id long, lang string, window binary").collect()
    rows.sort(key=lambda r: (r[1], r[0] if r[0] is not None else -1, bytes(r[2])))
    langs = {r[1] for r in rows}
    names = sorted(langs)
    code = {k: i for i, k in enumerate(names)}
    windows = np.frombuffer(b"".join(bytes(r[2]) for r in rows), np.uint8).reshape(-1, WINDOW).copy()
    labels = np.array([code[r[1]] for r in rows])
    rng = np.random.default_rng(11)  # some windows are shortened, since short texts must be told apart too
    short = rng.random(len(windows)) < 0.25
    windows[short] *= np.arange(WINDOW) < rng.integers(16, WINDOW, len(windows))[short, None]
    return fit(windows, labels, names)


def predict(docs: DataFrame, net: ByteCNN | None, text: str = "text") -> DataFrame:
    """Append lang_pred and score to docs and drop the text column.

    A null text, one without any letter, and every text if there was nothing to learn from get ``und`` and 0.0.
    Texts of any length are read whole. Repeated rows are scored alike. Columns of docs that are called lang_pred,
    score or lm_letter are replaced.
    """
    docs = docs.drop("lang_pred", "score").withColumn("lm_letter", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    schema = docs.drop("lm_letter", text).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = batch.column("lm_letter").to_numpy(zero_copy_only=False).astype(bool)
            names, values = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            if net is not None and letters.any():
                data, offsets = bytes_of(batch.column(text))
                row, start, length = places(offsets)
                row, start, length = (x[letters[row]] for x in (row, start, length))
                total = np.zeros((batch.num_rows, len(net.languages)))
                for at in range(0, len(row), TOGETHER):  # windows of many texts, or a bounded part of a long one
                    part = slice(at, at + TOGETHER)
                    np.add.at(total, row[part], length[part, None] * net.probabilities(gather(data, start[part], length[part])))
                best, own = total.argmax(1), np.flatnonzero(letters)
                names[own] = np.array(net.languages, object)[best[own]]
                values[own] = np.minimum(1.0, total[own, best[own]] / np.diff(offsets)[own])
            yield with_results(batch, ["lm_letter", text], {"lang_pred": pa.array(names, pa.string()), "score": pa.array(values)})

    return docs.mapInArrow(score, schema)


def identify(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Train on the rows whose crc32(doc_id) mod folds is not 0, then predict all: doc_id, held_out, lang_pred, score."""
    docs = docs.select("doc_id", "text", "lang").withColumn("held_out", bucket_of("doc_id", folds) == 0)
    net = train(docs.where("not held_out"))
    return predict(docs.select("doc_id", "held_out", "text"), net)
