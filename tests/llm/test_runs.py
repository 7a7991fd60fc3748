"""Periodic runs against a search of every period, and the query against the same in plain Python."""

import hashlib
import random
import re
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest

from logmill.llm import queries, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(words, min_words=6, min_exponent=4):
    seen, n = {}, len(words)
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(min_words, min_exponent * q):
                seen.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in seen.items())


def left(words, found):
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic(rng, n, letters):
    words = [rng.choice(letters) for _ in range(n)]
    if n and rng.random() < 0.7:
        a = rng.randrange(n)
        p = 1 + rng.randrange(max(1, (n - a) // 3))
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        if rng.random() < 0.3:
            words[rng.randrange(n)] = "é☃"
            words *= 2
    return words


@pytest.mark.parametrize(("min_words", "min_exponent"), [(6, 4), (2, 2), (10, 2), (7, 3)])
def test_runs_against_every_period(spark, min_words, min_exponent):
    rng = random.Random(min_words)
    texts = [rng.choice(" \n\t").join(periodic(rng, rng.randrange(60), "ab" if k % 2 else "abcd")) for k in range(400)]
    texts += [None, "", " \n", "a", "a a a a a a", "a " * 3000, "x" * 70_000, "one two three four five six seven " * 900, "a b a b a b a b\x00 b", " x　x　x x x x x x"]
    rows = [(i, t, "clash", 3) for i, t in enumerate(texts)] + [(None, "a a a a a a a", "", 1), (5, texts[5], "", 1), (5, texts[5], "", 1)]
    got = runs.find(spark.createDataFrame(rows, "doc_id long, text string, runs string, other int"), min_words=min_words, min_exponent=min_exponent).collect()

    def want(key, text):
        words = WORD.findall(text or "")
        own = slow(words, min_words, min_exponent)
        return str(key), len(words), own, left(words, own)

    assert sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got) == sorted(want(r[0], r[1]) for r in rows)
    assert runs.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_array_and_lcp():
    rng = random.Random(4)
    for _ in range(200):
        parts = [[rng.randrange(3) for _ in range(rng.randrange(30))] for _ in range(3)]
        symbols = np.array([x for k, part in enumerate(parts) for x in (*part, -1 - k)])
        order, rank = runs.suffixes(symbols)
        own = symbols.tolist()
        assert order.tolist() == sorted(range(len(own)), key=lambda i: own[i:]) and rank[order].tolist() == list(range(len(own)))
        shared = [0] + [next(h for h in range(len(own)) if own[a + h] != own[b + h]) for a, b in zip(order[1:].tolist(), order.tolist(), strict=False)]
        assert runs.lcp_values(symbols, order).tolist() == shared


def test_long_periodic_text_takes_no_square_of_its_length():
    words = np.array([*(i % 3000 for i in range(200_000)), -1])
    assert runs.runs_of(words, np.array([0, 200_001]), 6, 4) == [[(0, 200_000, 3000)]]
    same = np.array([*[7] * 100_000, -1])
    assert runs.runs_of(same, np.array([0, 100_001]), 6, 4) == [[(0, 100_000, 1)]]


def test_query_against_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()

    def want(key, text):
        words = WORD.findall(text or "")
        n, h = len(words), crc32(str(key).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        own = slow(words)
        best = min(own, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        return (key, len(own), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in own)), sha(left(words, own)))

    got = queries.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == sorted(want(r.doc_id, r.text) for r in docs)
    assert sum(r.n_runs > 0 for r in got) > 5
