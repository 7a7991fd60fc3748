"""Token counts of a sentencepiece BPE model, by two tiers of pre-token lengths on the map side.

No piece of such a model has a word boundary mark behind another character, and none has a line feed, so merges never
cross the place before a run of spaces or before a line feed. A text is cut there into pre-tokens, and its count is the
sum of theirs. The lengths of frequent pre-tokens are broadcast once as one compact block (the joined strings and a
byte each); whatever is missing there is encoded by the worker and kept in its bounded cache. No pre-token is shuffled,
and which pre-tokens are broadcast has an effect on speed only: every count is the library's.

A model without that property (``splits`` is False) has every text encoded whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmill.llm.common import bytes_of, with_results

#: Entries of a worker's cache before it starts anew, and the longest pre-token (in characters) that is kept there.
CACHE, LONGEST = 300_000, 64
PRE_TOKEN = re.compile(r"\n[^ \n]*| +[^ \n]*")
MARK = "▁"


def processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def splits(model: bytes) -> bool:
    """Whether texts may be cut before spaces and line feeds without a change of the count."""
    p = processor(model)
    plain = p.encode("a\nb", out_type=str) == [MARK + "a", "<0x0A>", "b"] and p.encode("  a", out_type=str)[0].startswith(MARK * 2)
    return plain and not any("\n" in s or MARK in s.lstrip(MARK) for s in map(p.id_to_piece, range(p.get_piece_size())))


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text that isn't empty; a first space stands for the mark that the library puts before each text."""
    if MARK in text:
        text = text.replace(MARK, " ")
    if "  " in text or " \n" in text or text[0] in " \n":
        return PRE_TOKEN.findall(" " + text)
    return text.replace("\n", " \n").split(" ")


class Lengths(dict):
    """The second tier: pre-tokens that the broadcast table hasn't, encoded when first met.

    Keys are pre-tokens without one leading space, or with their leading line feed.
    """

    def __init__(self, model: bytes, table: dict[str, int]):
        super().__init__(table)
        self.encode, self.table = processor(model).encode, table

    def length(self, word: str) -> int:
        if word[:1] == "\n":
            return len(self.encode(word)) - 1  # the mark that is put first isn't in the text here
        return len(self.encode(word)) if word else 1

    def __missing__(self, word: str) -> int:
        n = self.length(word)
        if len(word) <= LONGEST:
            if len(self) - len(self.table) >= CACHE:
                self.clear()
                self.update(self.table)
            self[word] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        found = pre_tokens(text)
        if found[0][:1] == " ":  # the careful way keeps the leading space of each
            found = [w[1:] if w[0] == " " else w for w in found]
        return sum(map(self.__getitem__, found))


def packed(table: dict[str, int]) -> tuple[bytes, bytes]:
    """One block of joined words and one byte for each length; words longer than that have no entry."""
    kept = {w: n for w, n in table.items() if n < 256 and "\0" not in w}
    return "\0".join(kept).encode(), bytes(kept.values())


def unpacked(block: tuple[bytes, bytes]) -> dict[str, int]:
    return dict(zip(block[0].decode().split("\0"), block[1], strict=True)) if block[1] else {}


def frequent(docs: DataFrame, model: bytes, sample_rows: int = 1500, entries: int = 60_000) -> tuple[bytes, bytes]:
    """The broadcast table: the most frequent pre-tokens of sample_rows texts, those with the smallest hash of doc_id."""
    ids = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(w[1:] if w[:1] == " " else w for w in pre_tokens(text) if len(w) <= LONGEST)
        top = seen.most_common(entries)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])

    found = docs.join(F.broadcast(ids), "doc_id", "left_semi").select("text").mapInArrow(words, "word string, n long")
    rows = found.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(entries).collect()
    known = Lengths(model, {})
    return packed({r[0]: known.length(r[0]) for r in rows if r[0]})


def count_tokens(docs: DataFrame, model: bytes, limit: int | Column = 4096, text: str = "text", sample_rows: int = 1500) -> DataFrame:
    """Replace the text of docs by n_bytes, n_tokens and over_limit (n_tokens > limit).

    A null or empty text has 0 bytes and 0 tokens. Texts are never cut, repeated rows count alike, and columns of docs
    that have one of the new names are replaced. The table that is broadcast has at most 60,000 short entries.
    """
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    cuts = splits(model)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model, frequent(docs.select("doc_id", F.col(text).alias("text")), model, sample_rows) if cuts else (b"", b"")))
    schema = docs.withColumns({"n_bytes": F.lit(0).cast("long"), "n_tokens": F.lit(0).cast("long")}).drop(text).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, block = shared.value
        lengths = Lengths(model, unpacked(block))
        for batch in batches:
            column = batch.column(text)
            _, offsets = bytes_of(column)
            size = lengths.count if cuts else lambda t: len(lengths.encode(t)) if t else 0
            tokens = [size(column[i].as_py()) for i in range(batch.num_rows)]
            yield with_results(batch, [text], {"n_bytes": pa.array(offsets[1:] - offsets[:-1]), "n_tokens": pa.array(tokens, pa.int64())})

    return docs.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
