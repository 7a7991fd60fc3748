"""Quality classifier: logistic regression on hashed word 1- and 2-grams, learnt with follow-the-regularised-leader.

A word is a run of bytes without white space. Its features are the exact word, its lower-cased pair with the next
word, the word's shape (letters, capitals, digits, accents and marks as classes), and whether a word repeats one of
the two before it; each is hashed into BUCKETS weights. A text's value for a feature is its count divided by the root
of FEW plus the sum of squared counts, so long texts weigh alike. The score is the sigmoid of the sparse dot product
of these values and the weights.

Training reads a bounded sample: ``max_rows`` labelled rows, those with the smallest hash of doc_id, and of each the
``max_features`` largest values. Scoring uses whole texts and all features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmill.llm.common import bucket_of, bytes_of, chunks, with_results

BUCKETS = 1 << 18
THRESHOLD = 0.7
#: Added to the sum of squared counts, so a text of few words stays near the score of the constant.
FEW = 60.0
#: Bytes on either side of a text's middle that make the short example of a labelled text.
SHORT = 60

PRIME = np.uint64(0x100000001B3)
INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
MIX = np.uint64(0x9E3779B97F4A7C15)


def byte_classes() -> np.ndarray:
    """Lower case, capital, digit, beyond ASCII, and each mark as itself."""
    out = np.arange(256, dtype=np.uint8)
    out[48:58], out[65:91], out[97:123], out[128:] = 48, 65, 97, 128
    return out


def lowered() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


CLASSES, LOWER = byte_classes(), lowered()
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def powers(base: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h * MIX
    return ((h ^ (h >> np.uint64(29))) * MIX) >> np.uint64(64 - 18)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row and the bucket of every feature of some texts; both have one entry for each feature and its repeats.

    Word hashes are differences of one running polynomial sum over the bytes, so no word becomes an object.
    """
    lo, hi = int(offsets[0]), int(offsets[-1])
    part, n = data[lo:hi], hi - lo
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~SPACE[part]
    edge = np.zeros(n + 1, bool)
    edge[offsets[:-1][np.diff(offsets) > 0] - lo] = True  # a word never spans two texts
    edge[n] = True
    starts = np.flatnonzero(word & (edge[:-1] | ~np.concatenate([[False], word[:-1]])))
    ends = np.flatnonzero(word & (edge[1:] | ~np.concatenate([word[1:], [False]]))) + 1
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.searchsorted(offsets - lo, starts, "right") - 1
    up, down = powers(PRIME, n), powers(INVERSE, n)

    def hashed(values: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of each word the sum of value * PRIME ** (place - place of its first byte)."""
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[place], out=total[1:])
        return (total[ends] - total[starts]) * down[place[starts]]

    places = np.arange(n)
    exact = hashed(part.astype(np.uint64) + np.uint64(1), places)
    low = hashed(LOWER[part].astype(np.uint64) + np.uint64(1), places)
    shape = CLASSES[part]
    fresh = np.ones(n, bool)  # of equal classes that stand together the first counts
    fresh[1:] = shape[1:] != shape[:-1]
    fresh[starts] = True
    form = hashed(np.where(fresh, shape, 0).astype(np.uint64), np.cumsum(fresh) - 1)
    pair = np.flatnonzero(row[1:] == row[:-1])
    again = (low[pair] == low[pair + 1]).astype(np.uint64)
    again[1:] += np.where((pair[1:] == pair[:-1] + 1) & (low[pair[1:] + 1] == low[pair[:-1]]), np.uint64(2), np.uint64(0))
    buckets = [mixed(exact), mixed(form + np.uint64(0x51ED27)), mixed(low[pair] * PRIME + low[pair + 1] + np.uint64(0xABCD)), mixed(again + np.uint64(0x7EA7))]
    return np.concatenate([row, row, row[pair], row[pair]]), np.concatenate(buckets).astype(np.int64)


def sparse(row: np.ndarray, bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, bucket) in order, and the value of each."""
    key, count = np.unique(row * BUCKETS + bucket, return_counts=True)
    r, b = key // BUCKETS, key % BUCKETS
    norm = np.sqrt(np.bincount(r, count.astype(np.float64) ** 2, n) + FEW)
    return r, b, count / norm[r]


def strongest(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the entries with the largest values, in the order they came."""
    order = np.lexsort([bucket, -value, row])
    nth = np.arange(len(row)) - np.searchsorted(row, row[order])
    kept = np.sort(order[nth < most])
    return row[kept], bucket[kept], value[kept]


def dot(row: np.ndarray, bucket: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    r, b, v = sparse(row, bucket, n)
    return np.bincount(r, v * weights[b], n)


class FTRL:
    """Per-coordinate follow-the-regularised-leader for the logistic loss."""

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(self, i: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[i]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2))

    def update(self, i: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(i)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        sigma = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.alpha
        self.z[i] += g - sigma * w
        self.n[i] += g * g


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 5000, epochs: int = 3, max_features: int = 4096) -> np.ndarray:
    """Weights of BUCKETS features and, last, of the constant, from docs (doc_id, text) and labels (doc_id, quality).

    Labels with null in either column are left out, one label of each doc_id counts (the largest) and one text (that of
    the least hash). Without any label all weights are 0 and every score is 0.5. At most max_rows labelled rows and a
    short part of each reach the driver, with max_features features of 8 bytes.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).collect()
    model = FTRL()
    if not chosen:
        return model.weights()
    small = docs.sparkSession.createDataFrame(chosen, "doc_id long, quality int")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column("text"))
            for i, j in chunks(offsets):
                rows = [strongest(*sparse(*features(data, offsets[i : j + 1]), j - i), max_features)]
                for k in range(i, j):  # a short part from the middle is an example too, since short texts must be told apart
                    middle = (offsets[k] + offsets[k + 1]) // 2
                    part = np.array([max(offsets[k], middle - SHORT), min(offsets[k + 1], middle + SHORT)])
                    rows.append(sparse(*features(data, part), 1))
                at = np.concatenate([[0], np.cumsum(np.concatenate([np.bincount(rows[0][0], minlength=j - i), [len(r) for r, _, _ in rows[1:]]]))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([r[n] for r in rows]).astype(t))) for n, t in ((1, np.int32), (2, np.float32))]
                twice = [pa.concat_arrays([batch.column(c).slice(i, j - i)] * 2) for c in ("doc_id", "quality")]
                yield pa.RecordBatch.from_arrays([*twice, *lists], names=["doc_id", "quality", "i", "x"])

    few = docs.select("doc_id", "text").join(F.broadcast(small), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    found = few.mapInArrow(vectors, "doc_id long, quality int, i array<int>, x array<float>").toArrow()
    # batch by batch, so that no second copy of the sample is made
    rows = [(d, y, k, int(n), i, x) for k, b in enumerate(found.to_batches()) for d, y, n, i, x in zip(b["doc_id"].to_pylist(), b["quality"].to_pylist(), b["i"].value_lengths().to_pylist(), arrays(b["i"]), arrays(b["x"]), strict=True)]
    rows.sort(key=lambda r: (r[0], r[1], r[3], r[2]))
    rng = np.random.default_rng(3)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            _, y, _, _, i, x = rows[k]
            model.update(np.append(i, BUCKETS), np.append(x.astype(np.float64), 1.0), int(y == 1))
    return model.weights()


def arrays(lists: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column as views of its values."""
    values, at = lists.values.to_numpy(), lists.offsets.to_numpy()
    return [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Append score (0 to 1) and predicted (1 from the threshold up) to docs; the other columns stay, text too.

    A null or empty text has the score of the constant alone. Repeated rows are scored alike, and columns of docs that
    are called score or predicted are replaced.
    """
    docs = docs.drop("score", "predicted")
    schema = docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    used = np.flatnonzero(weights)
    kept = weights[used].astype(np.float32)  # most weights are 0 and don't travel

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.zeros(BUCKETS + 1)
        full[used] = kept
        for batch in batches:
            data, offsets = bytes_of(batch.column(text))
            z = np.zeros(batch.num_rows)
            for i, j in chunks(offsets):
                z[i:j] = dot(*features(data, offsets[i : j + 1]), j - i, full)
            p = 1 / (1 + np.exp(-np.clip(z + full[BUCKETS], -35, 35)))
            yield with_results(batch, [], {"score": pa.array(p), "predicted": pa.array((p >= threshold).astype(np.int32))})

    return docs.mapInArrow(apply, schema)


def learnable(labels: DataFrame, folds: int = 4, out: int = 2) -> DataFrame:
    """The labels outside the held-out fold."""
    return labels.where(bucket_of("doc_id", folds) != out)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, out: int = 2) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs; fold ``out`` of crc32(doc_id) is never learnt from."""
    weights = train(docs, learnable(labels, folds, out))
    kept = docs.select("doc_id", (bucket_of("doc_id", folds) == out).alias("held_out"), "text")
    return score(kept, weights).drop("text")
