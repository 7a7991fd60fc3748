"""The fill-in-the-middle operator against a version that cuts and joins strings, and its round trip."""

import hashlib
import random
import re

import pytest

from logmill.llm import middle, queries

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [None, "", " ", " \n\t", "a", "a b", " a  b\n", "x" * 70_000, "wörd ☃ " * 5_000, "a\x00b c", "<P> a b", "a<S>b", "M> <M", "a <M>", "< P> <", "<P", "S> a <S b", "　a  b", "a b c d e f g h"]
SCHEMA = "doc_id long, text string, n string, form int, output long, restored string, other int"


def slow(key, text, percent=50):
    text = text or ""
    tokens = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(tokens)
    if not text or any(m in text for m in middle.MARKS) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if h4 % 100 < 80:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("percent", [50, 100])
def test_middle_against_strings(spark, percent):
    rng = random.Random(2)
    rows = [(10 * k + i, t) for k in range(12) for i, t in enumerate(TEXTS)] + [(None, "a b c"), (None, None), (3, "a b"), (3, "a b")]
    rows += [(1000 + i, "".join(rng.choice(" \nab<>PSMé☃") for _ in range(rng.randrange(40)))) for i in range(600)]
    docs = spark.createDataFrame([(k, t, "clash", 1, 2, "clash", 7) for k, t in rows], SCHEMA)
    got = middle.restore(middle.transform(docs, percent=percent)).collect()
    assert len(got) == len(rows) and got[0].other == 7
    want = sorted((str(k), t or "", *slow(k, t, percent)) for k, t in rows)
    assert sorted((str(r.doc_id), r.restored, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == want
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert all(r.output_sha256 == sha(r.output) and r.restored_sha256 == sha(r.restored) for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert middle.restore(middle.transform(docs.limit(0))).count() == 0


def test_pieces():
    whole = [(0, 0, 10)]
    assert [sum(e - s for _, s, e in p) for p in middle.cut(whole, 0, 10)] == [0, 10, 0]
    assert middle.cut(whole, 3, 7) == [[(0, 0, 3)], [(0, 3, 7)], [(0, 7, 10)]]
    assert middle.cut([(0, 0, 4), (1, 0, 3)], 2, 5) == [[(0, 0, 2)], [(0, 2, 4), (1, 0, 1)], [(1, 1, 3)]]
    with pytest.raises(ValueError):
        middle.undo(b"no marks", "psm", [b"<P>", b"<S>", b"<M>"])


def test_middle_own_marks_and_query(spark):
    docs = spark.createDataFrame([(i, "one two <P> three four") for i in range(40)], "doc_id long, text string")
    marks = ("", "", "é")
    got = middle.restore(middle.transform(docs, percent=100, spm_percent=30, seed=7, marks=marks), marks=marks).collect()
    assert {r.form for r in got} == {"psm", "spm"} and all(r.restored == "one two <P> three four" and all(m in r.output for m in marks) for r in got)
    rows = queries.op11_fill_in_middle(spark, "/root/testdata/sf0.001").collect()
    assert all(len(r.output_sha256) == 64 for r in rows) and sum(r.form == "plain" for r in rows) < len(rows)
