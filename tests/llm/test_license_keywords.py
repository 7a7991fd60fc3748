"""Each pattern of the licence rules must pass the keyword filter that stands before it."""

import itertools
import random
import re
import re._parser as sre
import time

from logmill.llm import licenses
from tests.llm.test_operators import empty


def examples(tree):
    """Texts that a parsed pattern matches: with and without each optional part, and by each alternative."""
    parts = []
    for op, arg in tree:
        kind = str(op)
        if kind == "LITERAL":
            parts.append([chr(arg)])
        elif kind == "IN":
            parts.append(["7"] if str(arg[0][0]) == "CATEGORY" else [chr(x) for _, x in arg])
        elif kind == "MAX_REPEAT":
            parts.append([t for n in {arg[0], max(1, arg[0])} for t in (examples(arg[2]) if n else [""])])
        elif kind == "SUBPATTERN":
            parts.append(examples(arg[3]))
        elif kind == "BRANCH":
            parts.append([t for x in arg[1] for t in examples(x)])
        else:
            raise ValueError(kind)
    return ["".join(x) for x in itertools.product(*parts)]


def test_every_pattern_passes_its_keyword():
    scanner = licenses.Scanner(licenses.rules())
    lost = [(r.keyword, t) for r in licenses.rules() for t in examples(sre.parse(r.pattern)) if r.pattern not in {d.rule.pattern for d in scanner.detect(f" {t} ")}]
    assert not lost


def test_phrases_alone(spark):
    texts = ["GPLv3 or later", "FreeBSD License", "Free Public License 1.0.0", "PSF License Agreement", "SSPL v1", "MPLv2", "CC license"]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.labels for r in got] == ["gpl-3.0", "bsd-2-clause", "0bsd", "python-2.0", "sspl-1.0", "mpl-2.0", "cc"]


def contained(d, found):
    """Whether another detection suppresses d, by comparing it with all."""
    def above(k):
        if not (k.start <= d.start and d.end <= k.end) or k.rule.base or k is d:
            return False
        longer = k.end - k.start > d.end - d.start
        return k.rule.confidence > d.rule.confidence or k.rule.confidence == d.rule.confidence and (longer or (k.start, k.end) == (d.start, d.end) and k.rule.rank < d.rule.rank)

    return any(map(above, found))


def test_suppression_against_all_pairs():
    rng, scanner, all_rules = random.Random(8), licenses.Scanner(licenses.rules()), licenses.rules()
    phrases = [t for r in all_rules for t in examples(sre.parse(r.pattern))[:2]]
    some = 0
    for _ in range(300):
        words = " ".join(rng.choice(phrases) for _ in range(6)).split()
        i = rng.randrange(len(words))
        found = scanner.detect(f" {' '.join(words[:i] + words[i + rng.randrange(2):])} ")
        key = lambda d: (d.start, d.end, d.rule.rank)
        want = sorted((d for d in found if d.rule.base or not contained(d, found)), key=key)
        assert sorted(licenses.resolve(found), key=key) == want
        some += len(found) - len(want)
    assert some > 500


def test_prefilter_and_places_against_every_rule(spark):
    scanner = licenses.Scanner(licenses.rules())
    every = [x for rs in scanner.rules.values() for x in rs]
    texts = ["x GNU Lesser General Public License v3, or MIT", "see the Apache License, Version 2.0; all rights reserved"]
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        words = texts[r.doc_id].lower().replace(",", " ").replace(";", " ").replace(".", " ").split()
        joined = f" {' '.join(words)} "
        assert len(scanner.detect(joined)) == sum(len(p.findall(joined)) for _, p in every)
        assert r.detections and all(re.fullmatch(d.pattern, " ".join(words[d.word : d.word + d.n_words])) for d in r.detections)


def test_licence_words_of_a_megabyte(spark):
    text = "licensed under the mit license gnu gpl v3 all rights reserved " * 17_000
    began = time.time()
    row = licenses.scan(spark.createDataFrame([(1, text, "x", 2)], "doc_id long, text string, labels string, place int")).first()
    assert row.n_words == 17_000 * 11 and row.n_base == 17_000 and row.last_word == row.n_words - 7 - 1 and row.place == 2
    assert time.time() - began < 60
    assert licenses.scan(empty(spark)).count() == 0
