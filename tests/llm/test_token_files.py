"""Token files against the library, and what a lookup reads of them."""

import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from logmill.llm import queries, token_files
from logmill.llm.common import shared_dir

SF = "/root/testdata/sf0.001"
MODEL = Path(queries.tokenizer_path("byte_bpe_50k.json")).read_text()
TEXTS = [None, "", " ", "a", "x" * 70_000, "wörd ☃ " * 5_000, "a\x00b", "<|endoftext|> a", "it's we'll 'tis ''s I'M", "a  b \n c　d  e", "a\x1cb ᠎​c", "\U0001f600 x\U00020001"]


def library(model=MODEL):
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(model)
    return lambda t: own.encode(t or "", add_special_tokens=False).ids


def texts_of(encoder, texts):
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    ids, n = encoder.ids(np.frombuffer(b"".join(data), np.uint8), offsets)
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


def test_pre_tokens_are_the_librarys():
    own, want, rng = token_files.Encoder(MODEL), library(), random.Random(1)
    assert own.cuts
    letters = [" \n\t\r\x0b\xa0　\x85\x1c᠎'sAbté1２½☃.-́Ⅷ\0", "'stremvlda x'1", " \na'.1\xa0"]
    texts = ["".join(rng.choice(letters[k % 3]) for _ in range(rng.randrange(24))) for k in range(6000)] + ["a<|endoftext|>'s" * 2, *[t for t in TEXTS if t]]
    assert texts_of(own, texts) == [want(t) for t in texts]
    odd = [f"a {chr(c)} b{chr(c)}c\n{chr(c)}1" for c in (*range(0, 0xD800, 3), *range(0xE000, 0x20100, 3))]
    assert texts_of(own, odd) == [want(t) for t in odd]


def test_generations_and_other_tokenizers(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE", 5)
    own, want = token_files.Encoder(MODEL), library()
    texts = [f"word{i} and word{i // 2}" for i in range(50)]
    assert [texts_of(own, [t])[0] for t in texts] == [want(t) for t in texts] and len(own.young) <= 5 + 12
    model = Path(queries.tokenizer_path("word_bpe_49k.json")).read_text()
    other, same = token_files.Encoder(model), library(model)
    assert not other.cuts and texts_of(other, ["Hello  World", "", "é<|endoftext|>"]) == [same("Hello  World"), [], same("é<|endoftext|>")]


@pytest.mark.parametrize("files", [1, 5])
def test_files_against_the_library(spark, files):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([*[(100_000 + i, t) for i, t in enumerate(TEXTS)], (None, "null key"), (None, None), (-5, "minus"), *[(7, "again")] * 300], docs.schema)
    both = docs.union(more).withColumns({"at": F.lit("clash"), "ids": F.lit("clash")})
    path = f"{shared_dir(spark)}/ids"
    token_files.write(both, MODEL, path, 2, files)
    got = token_files.read(spark, path).orderBy("start").collect()
    want = library()
    assert sorted((str(r.doc_id), *r.ids) for r in got) == sorted((str(r.doc_id), *want(r.text), 2) for r in both.collect())
    keys = [-(10**9) if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys) and got[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
    sums = {r.start: r.ids_crc32 for r in token_files.with_checksum(token_files.read(spark, path)).collect()}
    assert all(sums[r.start] == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)


def test_no_rows_no_end(spark):
    path = f"{shared_dir(spark)}/ids"
    token_files.write(spark.createDataFrame([], "doc_id string, text string"), MODEL, path)
    assert token_files.read(spark, path).count() == 0
    token_files.write(spark.createDataFrame([("b", None), ("a", "x y")], "doc_id string, text string"), MODEL, path)
    assert [(r.doc_id, r.start, r.n_tokens) for r in token_files.read(spark, path).orderBy("doc_id").collect()] == [("a", 0, 2), ("b", 2, 0)]


def rows_scanned(df):
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []
    text = plan.toString()
    assert "orc" in text.lower()
    stack = [plan]
    while stack:
        node = stack.pop()
        if node.nodeName().startswith("Scan orc"):
            found.append(node.metrics().apply("numOutputRows").value())
        if node.nodeName() == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            stack.append(node.plan())
        kids = node.children()
        stack += [kids.apply(i) for i in range(kids.size())]
    return sum(found)


def test_lookup_passes_over_rows(spark):
    import pyarrow.orc

    path = f"{shared_dir(spark)}/ids"
    docs = spark.range(0, 20_000, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    token_files.write(docs, MODEL, path, 2, 1)
    files = list(Path(path.removeprefix("file:")).glob("*.orc"))
    assert [pyarrow.orc.ORCFile(str(f)).nrows for f in files] == [10_000]
    stored = spark.read.orc(path)
    assert rows_scanned(stored.where("doc_id = 4000").select("doc_id", "ids")) == 1000  # one row group, by the row index
    missing = [rows_scanned(stored.where(f"doc_id = {i}").select("doc_id", "ids")) for i in (4001, 9001, 15_003)]
    assert sum(missing) <= 1000  # between smallest and largest key; the Bloom filters know better
    one, want = token_files.read(spark, path, F.col("doc_id") == 4000).collect(), library()
    assert len(one) == 1 and one[0].start == sum(len(want(f"word {i}")) + 1 for i in range(0, 4000, 2))
