"""Licence scan with ordered signature rules.

A text's words are lower-cased (A-Z) and joined by single spaces. An automaton finds which keywords occur, only the
rules with one of those run, and overlapping detections are resolved: a detection that lies inside one of a stronger
tier, or inside a longer one of its own, is suppressed. Detections of the contract's base phrases always stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from logmill.llm.common import bytes_of
from logmill.llm.license_rules import BASE, TIERS

BASE_CONFIDENCE = 0.9


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    rank: int
    confidence: float
    base: bool = False


@dataclass(frozen=True)
class Detection:
    """Of characters start to end of the joined words."""

    start: int
    end: int
    rule: Rule


def rules() -> list[Rule]:
    """All rules, strongest first; base phrases come with one rule each."""
    out = [Rule(label, phrase.split()[-1] if label != "cc-by" else "cc", phrase, i, BASE_CONFIDENCE, True) for i, (phrase, label) in enumerate(BASE.items())]
    for _, text, confidence in TIERS:
        for line in text.strip().splitlines():
            label, keyword, *patterns = (x.strip() for x in line.split(";"))
            out += [Rule(label, keyword, p, 0, confidence) for p in patterns]
    return [Rule(r.label, r.keyword, r.pattern, i, r.confidence, r.base) for i, r in enumerate(out)]


#: Bytes of words keep their value (A-Z lower-cased), all others become spaces.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Scanner:
    """The compiled rules, by keyword."""

    def __init__(self, all_rules: list[Rule]):
        self.rules: dict[str, list[tuple[Rule, re.Pattern]]] = {}
        for r in all_rules:
            # a base phrase is sought at each word, since two places can share a word
            self.rules.setdefault(r.keyword, []).append((r, re.compile(f"(?<= )(?={r.pattern} )" if r.base else f"(?<= )(?:{r.pattern})(?= )")))
        self.automaton = ahocorasick.Automaton()
        for k in self.rules:
            self.automaton.add_word(f" {k} ", k)
        self.automaton.make_automaton()

    def detect(self, joined: str) -> list[Detection]:
        """Every match of the rules that the keywords let through."""
        out = []
        for keyword in sorted({k for _, k in self.automaton.iter(joined)}):
            for rule, pattern in self.rules[keyword]:
                out += [Detection(m.start(), m.start() + len(rule.pattern) if rule.base else m.end(), rule) for m in pattern.finditer(joined)]
        return out


def resolve(found: list[Detection]) -> list[Detection]:
    """Base detections, and of the others those that no stronger one contains, nor an equally strong one that is longer.

    Of equally strong detections of the same place the one of the higher rule stays. A sweep from the left: whatever
    contains a detection starts no later, so per strength the furthest end so far tells whether one does.
    """
    kept, furthest = [d for d in found if d.rule.base], {}
    for d in sorted((d for d in found if not d.rule.base), key=lambda d: (d.start, -d.end, -d.rule.confidence, d.rule.rank)):
        if all(end < d.end for strength, end in furthest.items() if strength >= d.rule.confidence):
            kept.append(d)
        furthest[d.rule.confidence] = max(d.end, furthest.get(d.rule.confidence, 0))
    return kept


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label: string, pattern: string, word: long, n_words: long, confidence: double>>"


def scan(docs: DataFrame, text: str = "text", all_rules: list[Rule] | None = None) -> DataFrame:
    """Replace the text of docs by SCHEMA: counts, places and labels, and the detections that are kept.

    Words are numbered from 0. A null or empty text, and one without licence words, has no labels (empty strings),
    null places and score 0. The score is the confidence of the surest detection. Texts are read whole, repeated rows
    are scanned alike, and columns of docs that have one of the new names are replaced.
    """
    from pyspark.sql.types import StructType

    names = [f.name for f in StructType.fromDDL(SCHEMA)]
    docs = docs.drop(*names)
    rest = [f for f in docs.schema if f.name != text]
    ruleset = rules() if all_rules is None else all_rules
    kinds = pa.list_(pa.struct([("label", pa.string()), ("pattern", pa.string()), ("word", pa.int64()), ("n_words", pa.int64()), ("confidence", pa.float64())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(ruleset)
        for batch in batches:
            data, offsets = bytes_of(batch.column(text))
            rows = []
            for i in range(batch.num_rows):
                words = data[offsets[i] : offsets[i + 1]].tobytes().translate(WORDS).split()
                joined = f" {b' '.join(words).decode('latin-1')} "
                kept = sorted(resolve(scanner.detect(joined)), key=lambda d: (d.start, d.rule.rank))
                base = [d for d in kept if d.rule.base]
                starts = list(accumulate((len(w) + 1 for w in words), initial=1))  # of each word in joined
                place = [bisect_left(starts, d.start) for d in kept]
                at = [p for p, d in zip(place, kept, strict=True) if d.rule.base]
                rows.append((len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({d.rule.label for d in base})), ",".join(sorted({d.rule.label for d in kept})), max((d.rule.confidence for d in kept), default=0.0), [{"label": d.rule.label, "pattern": d.rule.pattern, "word": p, "n_words": bisect_left(starts, d.end) - p, "confidence": d.rule.confidence} for p, d in zip(place, kept, strict=True)]))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), kinds]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), *columns], names=[*(f.name for f in rest), *names])

    return docs.mapInArrow(apply, StructType([*rest, *StructType.fromDDL(SCHEMA)]))
