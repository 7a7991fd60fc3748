"""Near copies against all pairs of texts."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logmill.llm import near_copies
from tests.llm.test_operators import awkward, empty, slow_components


def grams(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def all_pairs(sets):
    """Pairs of distinct sets with a similarity of at least 0.8, by counting what each pair shares."""
    where, common = defaultdict(list), Counter()
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    for at in where.values():
        common.update((a, b) for k, a in enumerate(at) for b in at[k + 1 :])
    return {(sets[a], sets[b]) for (a, b), n in common.items() if Fraction(n, len(sets[a]) + len(sets[b]) - n) >= Fraction(4, 5)}


def edited(rows, rng):
    """Three copies of each text with changed words, at similarities around 0.8; families of many copies of one text."""
    out = []
    for i, text in rows:
        words = text.split()
        for k in range(3):
            w = list(words)
            for _ in range(max(1, len(w) * (k + 1) // 60)):
                w[rng.randrange(len(w))] = f"changed{rng.randrange(9)}"
            out.append((100_000 + 10 * i + k, " ".join(w)))
    long = max((t for _, t in rows if len(t.split()) < 400), key=len).split()
    for k in range(150):
        w = list(long)
        for _ in range(1 + k % 9):
            w[rng.randrange(len(w))] = f"other{rng.randrange(99)}"
        out.append((200_000 + k, " ".join(w)))
    # 4 of 5 and 8 of 10 shingles: exactly 0.8
    return out + [(300_000 + n, " ".join(f"w{m}" for m in range(n))) for n in (8, 9)] + [(300_100 + n, " ".join(f"v{m}" for m in range(n))) for n in (12, 14)]


@pytest.mark.parametrize("rows", [4, 512])
def test_near_copies_against_all_pairs(spark, monkeypatch, rows):
    monkeypatch.setattr(near_copies, "SMALL_GROUP", 4 if rows == 4 else 64)
    monkeypatch.setattr(near_copies, "MOST_COMPARED", 9 if rows == 4 else 4096)
    monkeypatch.setattr(near_copies, "tiles", partial(near_copies.tiles, rows=rows))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    some = [tuple(r) for r in docs.where("length(text) between 100 and 4000").orderBy("doc_id").limit(80).collect()]
    both = docs.union(spark.createDataFrame(edited(some, random.Random(5)), "doc_id long, text string")).union(awkward(spark).select("doc_id", "text"))
    rows = [(r.doc_id, grams(r.text)) for r in both.collect()]
    distinct = list({s for _, s in rows})
    pairs = all_pairs(distinct)
    number = {s: i for i, s in enumerate(distinct)}
    linked = {frozenset((number[a], number[b])) for a, b in pairs}
    ends = sorted({i for p in linked for i in p})
    top = dict(enumerate(range(len(distinct)))) | slow_components(ends, lambda a, b: frozenset((a, b)) in linked)
    least = {}
    for i, s in rows:
        if i is not None:
            least[top[number[s]]] = min(i, least.get(top[number[s]], i))
    got = near_copies.near_copies(both).collect()
    assert Counter(map(tuple, got)) == Counter((i, least[top[number[s]]]) for i, s in rows)
    assert len(pairs) > 300
    assert near_copies.near_copies(empty(spark)).count() == 0


def test_in_common_counts():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.int64)) for _ in range(40)]
    want = [[len(np.intersect1d(a, b)) if k != j else None for j, b in enumerate(sets)] for k, a in enumerate(sets)]
    for columns in (7, 4096):
        got = near_copies.in_common(sets, columns)
        assert all(got[i, j] == want[i][j] for i in range(40) for j in range(40) if i != j)


def test_stage_keeps_one_of_each_pair(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    once = corpus_pipeline.keep_one_copy(spark, docs, None)
    ids = [r.doc_id for r in corpus_pipeline.keep_one_of_alike(spark, once, None).select("doc_id").collect()]
    rows = once.select("doc_id", F.col("text")).collect()
    by_set = defaultdict(list)
    for r in rows:
        by_set[grams(r.text)].append(r.doc_id)
    pairs = all_pairs(list(by_set))
    kept = {grams(r.text) for r in rows if r.doc_id in set(ids)}
    assert len(pairs) >= 5 and not any(a in kept and b in kept for a, b in pairs)
