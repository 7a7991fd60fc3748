"""The training-data operators against brute force, exact round trips and held-out rows."""

import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from logmill.llm import decontaminate, exact_dedup, language_id, licenses, mixing, quality, queries, simhash, token_counts, url_filter, warc
from logmill.llm.common import shared_dir, stored
from logmill.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
AWKWARD = [None, "", " \n\t", "a", "x" * 70_000, "word " * 20_000, "Ünïcödé — ☃ text", "a\x00b", "▁ a  ▁▁b\n\n c ", "\n x", "A b C", "a B c"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, lm_key int"


def awkward(spark):
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else "src", None, "clash", "clash", 7) for i, t in enumerate(AWKWARD)]
    rows += [rows[3], rows[3], (None, None, None, None, None, None, None, None), (None, "a", "fr", "ß", 1, "", "", 0)]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_language_held_out(spark):
    rows = language_id.identify(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    rows = language_id.identify(awkward(spark)).collect()
    assert len(rows) == len(AWKWARD) + 4
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[0].lang_pred == by[1].lang_pred == by[2].lang_pred == "und" and by[3].lang_pred != "und"
    assert language_id.identify(empty(spark)).count() == 0
    assert {r.lang_pred for r in language_id.identify(awkward(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


@pytest.mark.parametrize("floor", [0, 2000])
def test_warc_round_trip(spark, floor):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    copy = pages.limit(5).withColumn("page_id", F.col("page_id") + 1000)
    odd = spark.createDataFrame([(None, None, None), (9001, "http://x/a b\r\n", ""), (9002, "", "é\r\n\r\n"), (9003, None, None), (9003, None, None)], pages.schema)
    rows = pages.union(copy).union(odd).collect()
    got = warc.round_trip(spark, spark.createDataFrame(rows, pages.schema), shared_dir(spark), floor).collect()
    assert len(got) == len(rows) and all(r.problem is None for r in got)
    last = defaultdict(lambda: None)
    for p in rows:
        if p.page_id is not None:
            last[p.html or ""] = max(p.page_id, last[p.html or ""] or 0)
    want = Counter()
    for p in rows:
        data = (p.html or "").encode()
        keep = last[p.html or ""] if len(data) >= floor and last[p.html or ""] != p.page_id else None
        want[(f"urn:page:{'' if p.page_id is None else p.page_id}", "response" if keep is None else "revisit", None if keep is None else f"urn:page:{keep}", data if keep is None else None, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())] += 1
    assert Counter((r.record_id, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload), r.payload_bytes, r.payload_digest) for r in got) == want


def test_warc_broken_records(spark, tmp_path):
    import struct

    import zstandard

    pack = zstandard.ZstdCompressor(write_content_size=True)
    good = warc.record(1, "http://x", b"hello", None)
    (tmp_path / "a.warc.zst").write_bytes(struct.pack("<II", warc.SKIPPABLE - 3, 4) + b"abcd" + b"".join(map(pack.compress, (good, good.replace(b"hello", b"hellO"), good[:-1], b"junk", good.replace(b"WARC-Date", b"X")))) + b"tail of no frame")
    (tmp_path / "b.warc.zst").write_bytes(b"")
    rows = warc.read(spark.createDataFrame([(f"{tmp_path}/a.warc.zst",), (f"{tmp_path}/b.warc.zst",)], "archive string")).orderBy(F.col("offset").asc_nulls_last()).collect()
    assert [(r.problem or "")[:13] for r in rows] == ["", "block digest ", "length differ", "no WARC head", "without WARC-", "broken archiv"]
    assert bytes(rows[0].payload) == b"hello"


def test_warc_archives_of_others(spark, tmp_path):
    import zstandard

    def rec(lines, block):
        return "\r\n".join(["WARC/1.0", *lines, f"content-length:{len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    own = lambda i, kind: [f"WARC-TYPE:{kind}", f"warc-record-id:<urn:x:{i}>", "WARC-Date: 2020-01-01T00:00:00Z"]
    sha = base64.b32encode(hashlib.sha1(b"hi").digest()).decode()
    http = b"HTTP/1.1 200 OK\r\ncontent-length: 2\r\n\r\nhi"
    records = [
        rec([*own(1, "warcinfo"), "Content-Type: application/warc-fields"], b"software: x\r\n\r\n"),
        rec([*own(2, "response"), "Content-Type: application/http; msgtype=response", "WARC-Target-URI:", " http://x/"], http),
        rec([*own(3, "response"), "Content-Type: application/http", f"WARC-Payload-Digest: sha1:{sha.lower()}", "WARC-Block-Digest: md5:00"], http),
        rec([*own(4, "response"), "Content-Type: application/http", "WARC-Payload-Digest: sha1:AAAA"], http),
        rec([*own(5, "resource"), "Content-Type: text/plain"], b""),
        rec([*own(6, "revisit"), "Content-Type: application/http", f"WARC-Payload-Digest: sha1:{sha}", "WARC-Refers-To: <urn:x:3>"], http[:-2]),
    ]
    pack = zstandard.ZstdCompressor(write_content_size=True)
    (tmp_path / "c.warc.zst").write_bytes(b"".join(map(pack.compress, records)))
    rows = warc.read(spark.createDataFrame([(f"{tmp_path}/c.warc.zst",)], "archive string")).orderBy("offset").collect()
    assert [r.record_id for r in rows] == [f"urn:x:{i}" for i in range(1, 7)] and rows[1].target_uri == "http://x/"
    assert [r.problem for r in rows] == [None, None, None, "payload digest differs", None, None]
    assert [None if r.payload is None else bytes(r.payload) for r in rows] == [b"software: x\r\n\r\n", b"hi", b"hi", None, b"", None]
    assert rows[1].payload_digest == sha and rows[5].payload_bytes == 2 and rows[5].refers_to == "urn:x:3"
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(spark, none, shared_dir(spark)).count() == 0


def test_warc_rolls_over_and_keeps_large_payloads(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 200)
    rng = random.Random(1)
    rows = [(i, "http://x", "".join(rng.choices("abcdefgh", k=n))) for i, n in enumerate([10, 500, 17 << 20, 0, 40])]
    got = warc.round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), shared_dir(spark)).collect()
    assert {r.record_id: len(r.payload) for r in got} == {f"urn:page:{i}": len(t) for i, _, t in rows}


def slow_probabilities(net, text):
    """The network by loops over windows, places and filters."""
    total, data = [0.0] * len(net.languages), text.encode()
    for at in range(0, len(data), language_id.WINDOW):
        window = data[at : at + language_id.WINDOW]
        x = [net.embed[b] for b in window] + [net.embed[0]] * (language_id.WINDOW - len(window))
        wide = max(language_id.WIDTHS)
        hidden = [max(0.0, max(sum(float(x[p + w][d]) * float(net.filters[w * language_id.DIM + d, f]) for w in range(wide) for d in range(language_id.DIM)) for p in range(len(x) - wide + 1)) + float(net.bias[f])) for f in range(net.filters.shape[1])]
        z = [sum(h * float(net.out[f, k]) for f, h in enumerate(hidden)) + float(net.out_bias[k]) for k in range(len(net.languages))]
        e = [math.exp(v - max(z)) for v in z]
        for k, v in enumerate(e):
            total[k] += len(window) * v / sum(e)
    return [t / len(data) for t in total]


def test_language_network_by_loops(spark):
    rows = [(i, f"{w} " * 20, k) for i, (w, k) in enumerate((w, k) for k, ws in {"aa": ["the and", "of in"], "bb": ["der und", "das ein"], "cc": ["żółw", "nie tak"]}.items() for w in ws)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language_id.train(docs)
    texts = ["the of and", "ż" * 200 + " nie", "ein x" * 60, "123", None]
    got = language_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net).orderBy("doc_id").collect()
    for r, text in zip(got[:3], texts, strict=False):
        want = slow_probabilities(net, text)
        assert r.lang_pred == net.languages[want.index(max(want))] and math.isclose(r.score, max(want), rel_tol=1e-3)
    assert [r.lang_pred for r in got[3:]] == ["und", "und"]
    many = spark.createDataFrame([(i, f"text {i}", f"l{i}") for i in range(70)], "doc_id long, text string, lang string")
    assert len(language_id.train(many).languages) == 70 and len(language_id.train(many, most_docs=10).languages) == 70


def test_quality_learner_by_loops():
    import numpy as np

    rng, model = random.Random(3), quality.FTRL()
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        sign = (z[i] > 0) - (z[i] < 0)
        return 0.0 if abs(z[i]) <= model.l1 else -(z[i] - sign * model.l1) / ((model.beta + math.sqrt(n[i])) / model.alpha + model.l2)

    for _ in range(200):
        row = {rng.randrange(40): rng.random() for _ in range(6)}
        y = rng.randrange(2)
        w = {i: weight(i) for i in row}
        p = 1 / (1 + math.exp(-sum(w[i] * x for i, x in row.items())))
        for i, x in row.items():
            g = (p - y) * x
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / model.alpha * w[i]
            n[i] += g * g
        model.update(np.array(list(row)), np.array(list(row.values())), y)
    assert all(math.isclose(float(model.weights()[i]), weight(i), abs_tol=1e-9) for i in range(40))
    data = "One two two.  three\nfour x".encode()
    r, b, v = quality.sparse(*quality.features(np.frombuffer(data, np.uint8), np.array([0, 20, len(data)])), 2)
    weights = np.array([rng.random() for _ in range(quality.BUCKETS + 1)])
    want = [sum(float(x) * weights[i] for k, i, x in zip(r, b, v, strict=True) if k == row) for row in (0, 1)]
    assert np.allclose(quality.dot(*quality.features(np.frombuffer(data, np.uint8), np.array([0, 20, len(data)])), 2, weights), want)
    kept = quality.strongest(np.array([0, 0, 0, 1]), np.array([4, 5, 6, 7]), np.array([0.1, 0.3, 0.2, 0.1]), 2)
    assert kept[1].tolist() == [5, 6, 7]


def test_token_counts_are_the_librarys(spark, docs):
    import sentencepiece

    model = open(tokenizer_path(), "rb").read()
    assert token_counts.splits(model)
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    both = docs.select("doc_id", "text").union(awkward(spark).select("doc_id", "text"))
    rng = random.Random(5)
    noise = ["".join(rng.choice(" \n\t▁aAbé<s>/.0☃\r") for _ in range(rng.randrange(40))) for _ in range(400)] + ["<s> a</s><unk>", "<0x0A>", " ", "  ", "\n\n", "a ", "a\n "]
    both = both.union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(noise)], "doc_id long, text string"))
    texts = both.collect()
    got = token_counts.count_tokens(both, model, limit=100, sample_rows=20).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()), len(sp.encode(r.text or "")), len(sp.encode(r.text or "")) > 100) for r in texts)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_counts.count_tokens(empty(spark).select("doc_id", "text"), model).count() == 0


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in rows)
    for part in (True, False):
        own = [r for r in rows if r.held_out == part]
        assert sum(r.predicted == r.quality for r in own) / len(own) > 0.9


def test_quality_edges(spark, labels):
    assert {r.score for r in quality.classify(awkward(spark), labels.limit(0)).collect()} == {0.5}
    odd = spark.createDataFrame([(3, None), (None, 1), (5, 1), (5, 0), (8, 0)], "doc_id long, quality int")
    rows = quality.classify(awkward(spark), odd).collect()
    assert len(rows) == len(AWKWARD) + 4 and len({r.score for r in rows if r.doc_id == 3}) == 1
    assert quality.classify(empty(spark), labels).count() == 0


def test_license_base_places(spark, docs):
    odd = ["GNU General\nPublic-License; GNU general public license", "cc by cc by", "CC-BY 4.0", "mit  LICENSE apache license mit license", "mit licensex", "gnu lesser general public license v3", "éapache license"]
    both = docs.select("doc_id", "text").union(spark.createDataFrame([(5000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")).union(awkward(spark).select("doc_id", "text"))
    phrases = {tuple(k.split()): v for k, v in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))}
    want = Counter()
    for r in both.collect():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(i, v) for i in range(len(words)) for k, v in phrases.items() if tuple(words[i : i + len(k)]) == k]
        want[(r.doc_id, len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({v for _, v in at})))] += 1
    rows = licenses.scan(both).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows) == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1 for r in rows)


def test_license_rules_overlap(spark):
    assert len(licenses.rules()) > 200
    texts = ["Licensed under the Apache License, Version 2.0", "GNU Lesser General Public License v3", "SPDX-License-Identifier: BSD-3-Clause", "CC BY-NC-SA 4.0", "all rights reserved"]
    rows = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [rows[i].labels for i in range(5)] == ["apache,apache-2.0", "lgpl-3.0", "bsd-3-clause", "cc-by,cc-by-nc-sa", "proprietary"]
    scanner = licenses.Scanner(licenses.rules())
    brute = [d for r, p in (x for rs in scanner.rules.values() for x in rs) for d in p.finditer(" gnu lesser general public license v3 ")]
    assert len(scanner.detect(" gnu lesser general public license v3 ")) == len(brute)


def slow_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(items, near):
    root = {i: i for i in items}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    items = list(items)
    for i, a in enumerate(items):
        for b in items[:i]:
            if near(a, b):
                root[top(a)] = top(b)
    return {i: top(i) for i in items}


@pytest.mark.parametrize("shard_rows", [1, 4096])
def test_simhash_components(spark, docs, shard_rows):
    base = docs.select("doc_id", "text").collect()
    rng, more = random.Random(2), []
    for i, r in enumerate(base[:60]):
        words = r.text.split()
        for k in range(3):
            w = list(words)
            w[rng.randrange(len(w))] = "changed"
            more.append((2000 + 10 * i + k, " ".join(w)))
    both = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")).union(awkward(spark).select("doc_id", "text"))
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in both.collect()]
    top = slow_components({f for _, f in rows}, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i, f in rows:
        if i is not None:
            least[top[f]] = min(i, least.get(top[f], i))
    got = simhash.near_duplicates(both, shard_rows=shard_rows).collect()
    assert Counter(map(tuple, got)) == Counter((i, f"{f:016x}", least[top[f]]) for i, f in rows)
    assert len(least) < len(rows) - 60
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_simhash_links_against_all_pairs(spark):
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(30)}
    for f in list(fps):
        for _ in range(12):
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                f ^= 1 << b
            fps.add(f)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    top = slow_components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    for shard_rows in (2, 4096):
        edges = simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "lm_fp long"), shard_rows=shard_rows).collect()
        assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3 for a, b in edges)
        joined = slow_components(fps, lambda a, b, e={frozenset(x) for x in edges}: frozenset((signed(a), signed(b))) in e)
        groups = lambda t: sorted(sorted(x for x in t if t[x] == y) for y in set(t.values()))
        assert groups(joined) == groups(top)


@pytest.mark.parametrize("frame", ["docs", "awkward", "single"])
def test_mix_against_brute_force(spark, docs, frame):
    table = {"docs": docs, "awkward": awkward(spark), "single": spark.createDataFrame([(1, "a b c", "x"), (2, "d " * 400, None)], "doc_id long, text string, source string")}[frame]
    rows = [(r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.source) for r in table.collect()]
    sizes = Counter()
    for _, n, s in rows:
        sizes[s] += n
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while open_:  # share, fix those above their limit, share what is left
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > 3 * sizes[s]}
        for s in over or open_:
            target[s] = 3 * sizes[s] if over else share * weight[s]
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over or open_
    got = mixing.mix(table).collect()
    assert Counter((r.doc_id, r["size"], r.source_size) for r in got) == Counter((i, n, sizes[s]) for i, n, s in rows)
    taken = Counter()
    for r in got:
        assert math.isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-9) and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-6 for s in names)
    assert Counter(map(str, got)) == Counter(map(str, mixing.mix(table.repartition(3)).collect()))
    assert mixing.mix(empty(spark)).count() == 0
    served = mixing.in_order(mixing.mix(table)).collect()
    order = [r.finish for r in served]
    assert order == sorted(order) and all(r.words > 0 and 1 <= r.copy <= 3 for r in served)
    assert sum(r.words for r in served) == sum(taken.values())
    # the words served before a copy, in its source's queue, never go beyond the level at which the budget is spent
    for s in names:
        queue, before = [r for r in served if r.source == s], 0
        for r in queue:
            assert math.isclose(r.finish, (before + r["size"]) / weight[s]) and r.words == min(r["size"], round(target[s]) - before)
            before += r["size"]
    assert Counter(map(str, mixing.mix(table.drop("size").selectExpr("doc_id", "source", "cast(coalesce(regexp_count(text, '[^ \\\\t-\\\\r]+'), 0) as long) as size"), text=None).select("doc_id", "taken").collect())) == Counter(map(str, mixing.mix(table).select("doc_id", "taken").collect()))


@pytest.mark.parametrize("capacity", [1, 1000])
def test_exact_dedup(spark, docs, capacity):
    both = docs.select("doc_id", "text").union(docs.select(F.col("doc_id") + 7, F.upper("text"))).union(awkward(spark).select("doc_id", "text"))
    rows = [(r.doc_id, re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) for r in both.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep, first = max((i for i in ids if i is not None), default=None), True
        for i in ids:
            want[(i, keep, len(ids), i == keep and first, hashlib.sha256(t.encode()).hexdigest())] += 1
            first = first and i != keep
    assert Counter(map(tuple, exact_dedup.deduplicate(both, capacity).collect())) == want
    clash = both.selectExpr("doc_id", "text", "1 as lm_key", "2 as keep_id", "3 as chain", "4 as text_sha256")
    assert exact_dedup.deduplicate(clash, capacity).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert exact_dedup.deduplicate(empty(spark)).count() == 0


def test_texts_with_one_key_form_a_chain(spark, docs, monkeypatch):
    """With keys of two bits most texts collide and must be told apart in their chain."""
    few = docs.select("doc_id", "text").union(docs.select(F.col("doc_id") + 1000, "text")).union(docs.select(F.col("doc_id") + 2000, F.lower("text")))
    want = Counter(map(tuple, exact_dedup.deduplicate(few).collect()))
    narrow = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.shiftleft(F.shiftrightunsigned(narrow(*c), 62), 62))
    assert Counter(map(tuple, exact_dedup.deduplicate(few, 1).collect())) == want
    _, slots, index = exact_dedup.build_index(few, shared_dir(spark), 1)
    assert index.count() == 4 == index.select("lm_bucket").distinct().count() == slots.count()
    assert index.selectExpr("max(size(chain)) as n").first().n > 20


def test_directory_doubles(spark):
    keys = spark.range(4000).select(F.xxhash64("id").alias("lm_key")).union(spark.range(50).select(F.lit(5).cast("long")))
    found = exact_dedup.directory(keys, 300)
    sizes = keys.distinct().join(found, exact_dedup.slot() == F.col("lm_slot")).groupBy("lm_bucket").count().collect()
    assert sum(r["count"] for r in sizes) == 4001 and max(r["count"] for r in sizes) <= 300 and len(sizes) >= 14


def test_url_rules(spark):
    urls = ["http://WWW.Example.com/en/1", "https://a.example.com/en/x?y", "http://example.com/EN/", "http://x.net/es/1#f", "http://net/fr/", "http://notnet/fr/", "x.net/es/", None, "", "http://a.com", "http://a.com/?q=http://b.net/es/", "http://b.org/es/1"]
    rows = {r.page_id: r for r in url_filter.judge(spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")).collect()}
    assert [rows[i].rule for i in range(12)] == ["www.example.com/en/", "example.com/en/", "com/", "net/es/", "net/fr/", None, None, None, None, None, "com/", None]
    assert [rows[i].host for i in (0, 5, 6, 9)] == ["www.example.com", "notnet", "", "a.com"] and rows[9].path == "" and rows[1].path == "/en/x"
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_reputation_shrinks(spark):
    rows = [(i, f"http://bad.x.org/{i}", 1) for i in range(40)] + [(100 + i, f"http://good{i}.z.org/", 0) for i in range(40)]
    rows += [(200, "http://bad.x.org/new", None), (201, "http://other.z.org/", None), (202, "http://new.y.org/", None), (203, None, None)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, bad int"), rules=(), bad="bad").collect()}
    assert [got[i].verdict for i in (200, 201, 202, 203)] == ["block", "allow", "allow", "allow"]
    assert got[201].bad_rate < got[202].bad_rate < got[200].bad_rate


def test_url_suffix_without_outcomes_stays_allowed(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = url_filter.judge(pages).select("host", "rule", "verdict", "bad_bound").collect()
    decided = {r.host.rpartition(".")[2] for r in rows if r.rule}
    unknown = [r for r in rows if r.host.rpartition(".")[2] not in decided]
    assert len(unknown) > 500 and all(r.verdict == "allow" for r in unknown)
    few = spark.createDataFrame([(i, f"http://a{i}.co.xx/", 1) for i in range(30)] + [(90, "http://new.co.xx/", None), (91, "http://new.zz/", None)], "page_id long, url string, bad int")
    got = {r.page_id: r for r in url_filter.judge(few, rules=(), bad="bad", two_labels=["co.xx"]).collect()}
    assert got[90].verdict == "block" and got[91].bad_bound < got[90].bad_bound


def slow_leaks(docs, items, least=0.8):
    """Of every window that shares a shingle with the item the similarity; the others' is 0."""
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    wanted = [(i, w) for i, t in items if (w := split(t))]
    own = {i: Counter(grams(w, min(5, len(w)))) for i, w in wanted}
    out = {}
    for doc_id, text in docs:
        words = split(text)
        there = {k: grams(words, k) for k in range(1, 6)}
        sets = {k: set(g) for k, g in there.items()}
        for item_id, item in wanted:
            k = min(5, len(item))
            if sets[k].isdisjoint(own[item_id]):
                continue
            best = 0
            for i in range(max(1, len(words) - len(item) + 1)):
                window = there[k][i : i + len(item) - k + 1]
                if any(g in own[item_id] for g in window):
                    both = sum((own[item_id] & Counter(window)).values())
                    best = max(best, both / (sum(own[item_id].values()) + len(window) - both))
            if best >= least:
                out[(doc_id, item_id)] = round(best, 9)
    return out


def test_url_rules_as_a_table(spark, monkeypatch):
    """100,000 rules, nested and repeated ones among them, against trying all; the two ways; very long urls and repeated rows."""
    rng = random.Random(21)
    words = ["a", "b", "com", "net", "example", "www", "co", "uk", "en"]
    name = lambda n: ".".join(rng.choice(words) for _ in range(rng.randrange(1, n)))
    path = lambda n: "".join("/" + rng.choice(["x", "en", "fr", "", "é"]) for _ in range(rng.randrange(n)))
    own = {name(4) + path(4): rng.choice(["allow", "block"]) for _ in range(400)} | {"": "allow", "com": "block", "/en": "block"}
    many = [(f"host{i}.org/{i}", "block") for i in range(100_000)] + list(own.items())
    urls = [f"http://{name(5)}{path(6)}?q" for _ in range(300)] + [None, "x", "http://", "http://com", "http://a.", "http://HOST7.org/7/8", "http://a.host7.org/71", "http://com/" + "en/" * 30_000, "http://com/en", "http://com/en"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")

    def want(host, path):
        fits = [(len(r), r, v) for r, v in [*own.items(), ("host7.org/7", "block")] if (host == (h := r.partition("/")[0]) or host.endswith("." + h)) and path.startswith(r[len(h):])]
        return max(fits)[1:] if fits else (None, None)

    rows = url_filter.judge(pages, many).collect()
    assert len(rows) == len(urls)
    for r in rows:
        rule, said = want(r.host, r.path)
        assert r.rule == rule and (said is None or r.verdict == said)
    few = sorted(own.items())[:50]
    key = lambda rules: sorted((r.page_id, str(r.rule), r.verdict) for r in url_filter.judge(pages, rules).collect())
    same = key(few)
    assert key(spark.createDataFrame(few, "rule string, said string")) == same
    monkeypatch.setattr(url_filter, "MOST_RULES", 1)
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 1)
    assert key(few) == same and url_filter.judge(pages.limit(0), many).count() == 0


@pytest.mark.parametrize("most", [250_000, 0])
def test_leaks_against_all_windows(spark, docs, most):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(900, "one two"), (901, ""), (902, None), (903, items[0][1]), (904, " ".join(f"w{i}" for i in range(300)))]
    base = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").limit(60).collect()]
    rng, planted = random.Random(1), []
    for i, (item_id, item) in enumerate(items):
        words = (item or "").split()
        for k in range(4):
            w = list(words)
            for _ in range(k):
                if w:
                    w[rng.randrange(len(w))] = "changed"
            planted.append((3000 + 10 * i + k, f"Before it all {' '.join(w).upper() if k == 1 else ' '.join(w)} and after"))
    for i, (item_id, item) in enumerate(items[:40]):  # words put in and left out
        w = (item or "").split()
        for _ in range(1 + i % 3):
            if w:
                at = rng.randrange(len(w))
                w[at : at + i % 2] = [] if i % 2 else [f"new{i}"]
        planted.append((6000 + i, f"so {' '.join(w)} it goes on and on " + "filler words " * 30))
    planted += [(9000, "one, two"), (9001, "x one"), (9002, " ".join(f"w{i}" for i in range(290))), (9003, None), (9004, ""), (9005, "w1 " * 3000)]
    rows = base + planted
    got = decontaminate.leaks(spark.createDataFrame([(*r, "x") for r in rows + rows[:3]], "doc_id long, text string, item_id string"), spark.createDataFrame(items + items[:1], "item_id long, text string"), most=most).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == slow_leaks(rows, items)
    assert len(got) == len({(r.doc_id, r.item_id) for r in got}) > 20


def test_leaks_edges(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.leaks(empty(spark), bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.leaks(awkward(spark), bench).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages"):
        duck.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rows, want = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLE_SQL[name])
    columns = sorted(rows.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in rows.collect()) == Counter(tuple(r[i] for i in at) for r in want.fetchall())


def test_candidates_of_a_large_benchmark(spark):
    """2,000 items of one size: a window meets the items whose shingles it has, not all of its size; short items have no radius."""
    rng = random.Random(31)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=40))) for i in range(2000)] + [(5000 + i, " ".join(rng.choices(vocabulary, k=9))) for i in range(300)]
    rows = []
    for i in range(300):
        text = dict(items)[rng.choice(items)[0]].split()
        if i % 3:
            text[rng.randrange(len(text))] = "changed"
        rows.append((i, " ".join(rng.choices(vocabulary, k=30) + text + rng.choices(vocabulary, k=30))))
    docs, bench = (spark.createDataFrame(x, f"{n} long, text string") for x, n in ((rows, "doc_id"), (items, "item_id")))
    place = shared_dir(spark)
    known = stored(decontaminate.items_of(bench), f"{place}/items")
    laid = stored(decontaminate.windows(docs, known), f"{place}/windows")
    found = decontaminate.candidates(laid, known)
    n_windows = laid.count()
    assert 200 <= n_windows <= 900 and found.distinct().count() <= 1.2 * n_windows and found.count() <= 9 * n_windows
    shingles = lambda t: Counter(zip(*(t.split()[k:] for k in range(5)), strict=False))
    want, having = set(), defaultdict(set)
    for doc, whole in rows:
        for shingle in shingles(whole):
            having[shingle].add(doc)
    for item, text in items:
        own = shingles(text)
        for doc in set().union(*(having[x] for x in own if x in having)):
            whole = dict(rows)[doc]
            words, size = whole.split(), len(text.split())
            for at in range(len(words) - size + 1):
                window = shingles(" ".join(words[at : at + size]))
                if (own & window).total() >= 0.8 * (own | window).total():
                    want.add((doc, item))
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} == want and len(want) > 100
