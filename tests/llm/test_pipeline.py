"""The pipeline against a brute-force version of its stages, and its edges."""

import re
from collections import defaultdict

import corpus_pipeline
from logmill.llm import mixing, quality
from tests.llm.test_near_copies import all_pairs, grams
from tests.llm.test_operators import AWKWARD, awkward, empty, slow_components, slow_leaks

SF = "/root/testdata/sf0.001"


def test_run_against_brute_force(spark):
    docs, labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    good = quality.score(docs, quality.train(docs, quality.learnable(labels))).where("predicted = 1").collect()
    by_text = defaultdict(list)
    for r in good:
        by_text[re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")].append(r)
    once = [max(g, key=lambda r: r.doc_id) for g in by_text.values()]
    sets = {r.doc_id: grams(r.text) for r in once}
    by_set = defaultdict(list)
    for i, g in sets.items():
        by_set[g].append(i)
    pairs = all_pairs(list(by_set))
    top = slow_components(sets, lambda a, b: sets[a] == sets[b] or (sets[a], sets[b]) in pairs or (sets[b], sets[a]) in pairs)
    least = {}
    for i, t in top.items():
        least[t] = min(i, least.get(t, i))
    alone = [r for r in once if least[top[r.doc_id]] == r.doc_id]
    leaking = {d for d, _ in slow_leaks([(r.doc_id, r.text) for r in alone], [(r.item_id, r.text) for r in bench.collect()])}
    clean = [r for r in alone if r.doc_id not in leaking]
    want = mixing.mix(docs.where(docs.doc_id.isin([r.doc_id for r in clean]))).selectExpr("doc_id", "taken", "inline(copies)").select("doc_id", "taken", "copy", "words").collect()
    got = corpus_pipeline.run(spark, SF).select("doc_id", "taken", "copy", "words").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert 0 < len(clean) < len(alone) <= len(once) < len(good) < docs.count()


def test_stages_on_awkward_rows(spark):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, awkward(spark), SF)
        if name != "source mixing":
            assert out.columns == awkward(spark).columns
        assert out.count() <= (len(AWKWARD) + 4) * (3 if name == "source mixing" else 1)
        assert stage(spark, empty(spark), SF).count() == 0
    assert corpus_pipeline.keep_one_copy(spark, awkward(spark), SF).where("doc_id = 11").count() == 1


def test_alike_rows_with_one_doc_id(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(5, " ".join(base)), (5, " ".join(f"v{i}" for i in range(60))), (7, " ".join([*base[:-1], "x"])), (None, " ".join([*base[:-1], "y"])), (None, "lone words"), (None, "lone  words")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lm_id int")
    kept = corpus_pipeline.keep_one_of_alike(spark, docs, SF).collect()
    clash = docs.selectExpr("doc_id", "text", "lm_id", "1 as lm_own", "2 as lm_sha", "3 as lm_hash")
    assert corpus_pipeline.keep_one_copy(spark, clash, SF).count() == corpus_pipeline.drop_leaks(spark, clash, SF).count() == len(rows)
    assert sorted((r.doc_id or 0, r.text[:4]) for r in kept) == [(0, "lone"), (5, "v0 v"), (5, "w0 w")]
