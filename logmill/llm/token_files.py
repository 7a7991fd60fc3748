"""Token ids of documents in ORC files: written in the order of their keys, read by stripe, found by key from metadata.

Texts are dealt to files by ranges of their key, so file after file and row after row the keys ascend. A row has the key,
the ids, how many there are, and how many stand before it in its file; what all earlier files hold is summed from that
small column when it is read. ORC keeps the ids run-length encoded in stripes, with row indexes (smallest and largest key
of every few rows) and Bloom filters of the keys, so tasks read stripes in parallel and a lookup of keys passes over all
others.

A byte-level BPE never merges across its pre-tokens. Where they begin follows from the classes of neighbouring characters,
so a task finds the pre-tokens of 3 MB of text in one numpy pass, Arrow numbers the distinct ones, and the library encodes
those that the worker hasn't met yet. A text with a character whose class differs between versions of Unicode, or with
the string of an added token, is one pre-token, that is, the library encodes it whole; so are all texts where the
tokenizer is of another kind.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logmill.llm.common import bytes_of, chunks, with_results

#: Pre-tokens that a worker keeps in each of two generations, and the longest (in bytes) that is kept.
CACHE, LONGEST = 350_000, 64
#: Bytes of text that are looked at together.
TOGETHER = 3 << 20
IDS = "array<int>"
LETTER, NUMBER, OTHER, SPACE, WHITE, UNSURE = range(6)
#: Code points from here on count as unsure.
KNOWN = 0x20000
#: What the pattern takes with an apostrophe, where a pre-token begins there: fixed values.
SHORT = ("s", "t", "re", "ve", "m", "ll", "d")


@cache
def classes() -> np.ndarray:
    """The class of each code point; unsure where Unicode 3.2 and this Python's version don't agree, or have none."""
    out = np.full(KNOWN + 1, UNSURE, np.int8)
    for c in range(KNOWN):
        now, then = unicodedata.category(chr(c)), unicodedata.ucd_3_2_0.category(chr(c))
        kinds = {LETTER if k[0] == "L" else NUMBER if k[0] == "N" else OTHER for k in (now, then)}
        if len(kinds) == 1 and now not in ("Cn", "Zs", "Zl", "Zp") and then not in ("Zs", "Zl", "Zp"):
            out[c] = kinds.pop()
        elif now == then and now in ("Zs", "Zl", "Zp"):
            out[c] = WHITE
    out[0x20], out[0x09:0x0E], out[0x1C:0x20], out[0x85] = SPACE, WHITE, UNSURE, UNSURE
    return out


def begins(points: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each code point; kind is its class, first marks where texts begin, the end of the array ends the last.

    The pattern: an apostrophe with SHORT; letters, numbers or others, each with one space before; white space up to the
    last one before a word; white space.
    """
    white = (kind == SPACE) | (kind == WHITE)
    before, after = np.roll(kind, 1), np.roll(~white, -1)
    last = np.roll(first, -1)  # the next text, or the first one, begins behind it
    inner = np.where(white, ~np.roll(white, 1) | (after & ~last), (before != SPACE) & (before != kind))
    start = first | inner
    marks = np.flatnonzero((points == 0x27) & start)
    if len(marks):
        padded = np.append(points, [0] * 3)
        text_end = np.append(np.flatnonzero(first), len(points))
        room = text_end[np.searchsorted(text_end, marks, "right")] - marks
        open_ = np.ones(len(marks), bool)
        for s in SHORT:
            hit = open_ & (room > len(s))
            for k, c in enumerate(s):
                hit &= padded[marks + 1 + k] == ord(c)
            open_ &= ~hit
            start[marks[hit] + 1] = False
            behind = marks[hit] + 1 + len(s)
            start[behind[behind < len(points)]] = True
    return start


def by_pre_tokens(model: str) -> bool:
    """Whether a tokenizer's file (JSON) says that pre-tokens may be encoded one by one: byte-level BPE, nothing else in the way."""
    d = json.loads(model)
    bpe, cutter = d["model"], d.get("pre_tokenizer") or {}
    plain = bpe.get("type", "BPE") == "BPE" and not any(bpe.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "unk_token"))
    return plain and not any(d.get(k) for k in ("normalizer", "truncation", "padding")) and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space")


class Encoder:
    """Ids of texts as the library gives them; what it gave for pre-tokens is kept in two generations, the older one goes."""

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.tokenizer, self.cuts = Tokenizer.from_str(model), by_pre_tokens(model)
        added = [re.escape(t["content"].encode()) for t in json.loads(model).get("added_tokens", [])]
        self.added = re.compile(b"|".join(added)) if added else None
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def blocks(self, units: list[bytes]) -> list[bytes]:
        """The ids of each unit as little-endian bytes, four for each id."""
        young, old = self.young, self.old
        out = [young.get(u) or old.get(u) for u in units]
        new = [k for k, b in enumerate(out) if b is None]
        if new:
            found = self.tokenizer.encode_batch_fast([units[k].decode() for k in new], add_special_tokens=False)
            for k, e in zip(new, found, strict=True):
                out[k] = np.array(e.ids, "<u4").tobytes()
        young.update((u, b) for u, b in zip(units, out, strict=True) if len(u) <= LONGEST)
        if len(young) > CACHE:
            self.young, self.old = {}, young
        return out

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (bytes between offsets) one after another, and how many each text has."""
        base, counts = offsets[0], np.zeros(len(offsets) - 1, np.int64)
        own, at = data[base : offsets[-1]], offsets - base
        filled = np.flatnonzero(at[1:] > at[:-1])
        if not len(filled):
            return np.zeros(0, np.uint32), counts
        tops = at[filled]
        starts = tops
        if self.cuts:
            places = np.flatnonzero((own & 0xC0) != 0x80).astype(np.int32)
            raw = own.tobytes()
            points = np.frombuffer(raw.decode().encode("utf-32-le"), "<u4")
            first = np.zeros(len(points), bool)
            first[np.searchsorted(places, tops)] = True
            kind = classes().take(points, mode="clip")
            start = begins(points, kind, first)
            unsure = set(np.searchsorted(tops, places[kind == UNSURE], "right") - 1)
            if self.added:
                unsure |= {int(np.searchsorted(tops, m.start(), "right")) - 1 for m in self.added.finditer(raw)}
            for k in unsure:  # such a text is one unit
                a, b = np.searchsorted(places, [at[filled[k]], at[filled[k] + 1]])
                start[a + 1 : b] = False
            starts = places[start]
            del places, points, kind, first, start, raw
        ends = np.append(starts, len(own))
        units = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(own))]).dictionary_encode()
        blocks, which = self.blocks(units.dictionary.to_pylist()), units.indices.to_numpy()
        size = np.fromiter(map(len, blocks), np.int64, len(blocks)) // 4
        ids, begin = np.frombuffer(b"".join(blocks), "<u4"), np.cumsum(size) - size
        n = size[which]
        until = np.cumsum(n)
        out = ids[np.repeat(begin[which] - (until - n), n) + np.arange(until[-1])]
        counts[filled] = np.add.reduceat(n, np.searchsorted(starts, tops))
        return out, counts


_encoders: dict[int, Encoder] = {}


def encoder(model: str) -> Encoder:
    """The worker's encoder of a model, which outlives a task."""
    if (own := zlib.crc32(model.encode())) not in _encoders:
        _encoders.clear()
        _encoders[own] = Encoder(model)
    return _encoders[own]


def encoded(docs: DataFrame, model: str, end_id: int | None, text: str = "text") -> DataFrame:
    """Replace text by at (ids of the rows before it in its partition), n_tokens and ids, with end_id behind each row's."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, before = encoder(shared.value), 0
        for batch in batches:
            data, offsets = bytes_of(batch.column(text))
            for i, j in chunks(offsets, TOGETHER):
                ids, n = own.ids(data, offsets[i : j + 1])
                if end_id is not None:
                    ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
                ends = np.concatenate([[0], np.cumsum(n)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view(np.int32)))
                yield with_results(batch.slice(i, j - i), [text], {"at": pa.array(before + ends[:-1]), "n_tokens": pa.array(n), "ids": lists})
                before += int(ends[-1])

    schema = docs.drop(text).withColumns({"at": F.lit(0).cast("long"), "n_tokens": F.lit(0).cast("long"), "ids": F.lit(None).cast(IDS)}).schema
    return docs.mapInArrow(encode, schema)


def write(docs: DataFrame, model: str, path: str, end_id: int | None = None, files: int | None = None, key: str = "doc_id", text: str = "text", stripe_bytes: int = 64 << 20, stride: int = 1000) -> None:
    """Encode the texts of docs and write a row for each to ORC files under path, ascending by key.

    Null texts are empty. Null keys come first; rows of one key go by a hash of their text, and rows that repeat by where
    they were read, so a key that many rows have is spread over files too. files: how many ranges, else the session's
    shuffle partitions. Columns of docs other than key and text aren't written. Texts are shuffled, before they are
    encoded, so that each is encoded once. An empty table gives files without rows.
    """
    spark = docs.sparkSession
    order = ["lm_key", "lm_hash", "lm_row"]
    rows = docs.select(F.col(key).alias("lm_key"), F.col(text).alias("lm_text"), F.xxhash64(text).alias("lm_hash")).withColumn("lm_row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(files or int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).select("lm_key", "lm_text")
    out = encoded(dealt, model, end_id, "lm_text").select(F.col("lm_key").alias(key), F.spark_partition_id().alias("file"), "at", "n_tokens", "ids")
    settings = {"orc.bloom.filter.columns": key, "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.stripe.size": str(stripe_bytes), "orc.row.index.stride": str(stride)}
    out.write.mode("overwrite").options(**settings).orc(path)


def read(spark: SparkSession, path: str, wanted: Column | None = None) -> DataFrame:
    """The key, start (ids of all rows before it), n_tokens and ids of each row, or only of those that are wanted.

    A wanted condition on the key reaches the files, where stripes and groups of rows that can't have it are passed over.
    The sums of the files, one row each, come from one narrow column; they are broadcast while they are few.
    """
    rows = spark.read.orc(path)
    sums = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    if len(rows.inputFiles()) <= 100_000:
        before = F.broadcast(before)
    key = [c for c in rows.columns if c not in ("file", "at", "n_tokens", "ids")]
    own = rows if wanted is None else rows.where(wanted)
    return own.join(before, "file").select(*key, (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")


def with_checksum(rows: DataFrame) -> DataFrame:
    """Replace ids by ids_crc32, the CRC-32 of a row's ids as little-endian unsigned 32-bit integers."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            data, ends = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B"), lists.offsets.to_pylist()
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends, ends[1:], strict=False)]
            yield with_results(batch, ["ids"], {"ids_crc32": pa.array(crc, pa.int64())})

    return rows.mapInArrow(sums, rows.drop("ids").withColumn("ids_crc32", F.lit(0).cast("long")).schema)
