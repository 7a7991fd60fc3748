"""Periodic runs: stretches of words that repeat with a period at least min_exponent times, by an enhanced suffix array.

A task numbers the words of 1 MB of texts (or of one longer text) and sorts the suffixes of all these texts together;
words are numbered within their text and each text ends in a symbol of its own, so no suffix reaches into the next text.
Every square (a stretch twice in a row) whose last word stops it from being turned further right begins two suffixes of
one LCP interval whose depth is the period. So for each interval, the suffixes of all its children but the largest look
at which places of the suffix array the suffixes a depth before and behind them are; if inside the interval, there is a
square. Turned left as far as its words allow, it becomes a run, and squares that give the same run are one. Intervals
come from one pass over the LCP values with a stack; there is no tree.

An interval that holds a run that counts has a greater value inside (three times its depth for four repeats), so words
whose suffixes share too little aren't passed over at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmill.llm.common import bytes_of, chunks, with_results
from logmill.llm.middle import SPACE, text_array

#: Words that are joined at a time.
JOINED = 1 << 16
RUN = "array<struct<start:long,length:long,period:long>>"


def suffixes(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array and its inverse, by prefix doubling of the groups that aren't told apart yet.

    The last symbol, and each that ends a text, must occur once.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    fresh = np.append(True, symbols[order][1:] != symbols[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]  # a group's rank is its first place
    alone = fresh & np.append(fresh[1:], True)
    slots, k = np.flatnonzero(~alone), 1
    while len(slots):
        own = order[slots]
        both = rank[own] * n + rank[own + k]
        by = np.argsort(both)
        own, both = own[by], both[by]
        order[slots] = own
        fresh = np.append(True, both[1:] != both[:-1])
        rank[own] = slots[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        slots, k = slots[~(fresh & np.append(fresh[1:], True))], 2 * k
    return order, rank


def common(symbols: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols the suffixes at a and at b share: all pairs step by step, long ones in blocks that double."""
    out, left = np.zeros(len(a), np.int64), np.arange(len(a))
    for h in range(16):
        left = left[symbols[a[left] + h] == symbols[b[left] + h]]
        if not len(left):
            return out
        out[left] = h + 1
    for i in left.tolist():
        h, size = 16, 64
        while True:
            x, y = symbols[a[i] + h : a[i] + h + size], symbols[b[i] + h : b[i] + h + size]
            differs = np.flatnonzero(x[: len(y)] != y[: len(x)])
            if len(differs):
                out[i] = h + differs[0]
                break
            h, size = h + min(len(x), len(y)), 2 * size
    return out


def lcp_values(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place of the suffix array, how many symbols it shares with the place before (0 for the first).

    In text order a value is one less than the one before, unless the symbols in front of the two suffixes differ; only
    those values are counted, and together they are at most n log n long.
    """
    n = len(symbols)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    counted = (before <= 0) | (at == 0) | (symbols[at - 1] != symbols[before - 1])
    heads = np.flatnonzero(counted)
    known = heads[before[heads] >= 0]
    value = np.zeros(n, np.int64)
    value[known] = common(symbols, known, before[known])
    head = heads[np.cumsum(counted) - 1]
    return np.maximum(value[head] - (at - head), 0)[order]


def needed(depth: int, min_words: int, min_exponent: int) -> int:
    """The value that an interval of this depth has inside if it holds a run that counts: its places a period apart share that much."""
    return (max(min_exponent, min_words // depth) - 1) * depth


def squares(lcp: list[int], places: list[int], low: int, rank: list[int], symbols: list[int], min_words: int, min_exponent: int) -> list[tuple[int, int]]:
    """(period, place) of the squares that can't be turned right, among suffixes of one text that share their first word.

    lcp and places are their part of the suffix array, which begins at low there; rank and symbols are the text's.
    """
    found: list[tuple[int, int]] = []
    open_: list[list] = []  # intervals: depth, where the children begin, greatest value inside

    def look(depth: int, starts: list[int], last: int) -> None:
        ends = [*starts[1:], last + 1]
        first, last = starts[0] + low, last + low
        largest = max(range(len(starts)), key=lambda c: ends[c] - starts[c])
        for c, (a, b) in enumerate(zip(starts, ends, strict=True)):
            for i in places[a:b] if c != largest else ():
                if first <= rank[i + depth] <= last and symbols[i + depth] != symbols[i + 2 * depth]:
                    found.append((depth, i))
                if i >= depth and first <= rank[i - depth] <= last and symbols[i] != symbols[i + depth]:
                    found.append((depth, i - depth))

    for at, value in enumerate([*lcp[1:], 0], 1):
        begin, inside = at - 1, 0
        while open_ and open_[-1][0] > value:
            depth, starts, most = open_.pop()
            begin, inside = starts[0], max(inside, most)
            if inside >= needed(depth, min_words, min_exponent):
                look(depth, starts, at - 1)
        if open_ and open_[-1][0] == value:
            open_[-1][1].append(at)
            open_[-1][2] = max(open_[-1][2], inside)
        elif value:
            open_.append([value, [begin, at], max(value, inside)])
    return found


def merged(found: list[tuple[int, int]], symbols: np.ndarray, min_words: int, min_exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs that squares (period, place) of a text are part of, those that count."""
    runs: dict[tuple[int, int], int] = {}
    by_end: dict[int, list[tuple[int, int]]] = {}
    for period, place in sorted(set(found)):  # the smallest period of a run comes first
        end, least = place + 2 * period, max(min_words, min_exponent * period)
        if end < least or any(s <= place and period % q == 0 for s, q in by_end.get(end, ())):
            continue
        start, size = place, period
        while start:
            size = min(size, start)
            same = symbols[start - size : start] == symbols[start - size + period : start + period]
            if not same.all():
                start -= int(np.argmin(same[::-1]))
                break
            start, size = start - size, 2 * size
        by_end.setdefault(end, []).append((start, period))
        if end - start >= least:
            runs.setdefault((start, end), period)
    return sorted((s, e - s, q) for (s, e), q in runs.items())


def runs_of(symbols: np.ndarray, begins: np.ndarray, min_words: int, min_exponent: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text; text k has the symbols from begins[k] on, and behind them one that occurs nowhere else."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(begins) - 1)]
    if not len(symbols):
        return out
    order, rank = suffixes(symbols)
    lcp = lcp_values(symbols, order)
    zero = np.flatnonzero(lcp == 0)  # between two of them, suffixes share their first word
    deep = np.maximum.reduceat(lcp, zero) >= min(needed(q, min_words, min_exponent) for q in range(1, min_words + 1))
    stop = np.append(zero[1:], len(lcp)) - 1
    found: dict[int, list[tuple[int, int]]] = {}
    text_of, last = np.searchsorted(begins, order[zero[deep]], "right") - 1, -1
    for low, high, k in zip(zero[deep].tolist(), stop[deep].tolist(), text_of.tolist(), strict=True):  # text by text
        begin, end = begins[k], begins[k + 1]
        if k != last:
            own_rank, own_symbols, last = rank[begin:end].tolist(), symbols[begin:end].tolist(), k
        found.setdefault(k, []).extend(squares(lcp[low : high + 1].tolist(), (order[low : high + 1] - begin).tolist(), low, own_rank, own_symbols, min_words, min_exponent))
    for k, own in found.items():
        out[k] = merged(own, symbols[begins[k] : begins[k + 1]], min_words, min_exponent)
    return out


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, dictionary-encoded, and the number of the first word of each text (n + 1 numbers)."""
    own, at = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    solid = ~SPACE[own]
    edge = np.zeros(len(own), bool)
    edge[at[:-1][at[:-1] < len(own)]] = True
    starts = np.flatnonzero(solid & (edge | ~np.append(False, solid[:-1])))
    packed = np.cumsum(solid)  # white space is left out
    ends = np.append(packed[starts] - 1, packed[-1] if len(packed) else 0).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(own[solid])])
    return words.dictionary_encode(), np.searchsorted(starts, at)


def collapsed(words: pa.Array, runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, of each run only its first period."""
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    places = np.flatnonzero(kept)
    return b" ".join(b" ".join(words.take(pa.array(places[i : i + JOINED])).dictionary_decode().to_pylist()) for i in range(0, len(places), JOINED))


def find(docs: DataFrame, text: str = "text", min_words: int = 6, min_exponent: int = 4) -> DataFrame:
    """Replace text by n_words, runs (start word, length, period; by start, then period) and collapsed.

    A run is a stretch of words with smallest period q, of min_words and min_exponent * q words at least, that no word
    beside it goes on with; min_words is 2 and min_exponent 2 at least. collapsed has the words joined by one space,
    without those that any run has behind its first q. A text that is null or has no words has no runs and is empty.
    Rows that repeat come out alike, and columns that have one of the new names are replaced. A task holds some 200 bytes
    for each word of 1 MB of texts, or of one longer text.
    """
    if min_words < 2 or min_exponent < 2:
        raise ValueError("a run has two words and two periods at least")
    new = {"n_words": "long", "runs": RUN, "collapsed": "string"}
    docs = docs.drop(*[c for c in new if c != text])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column(text))
            for i, j in chunks(offsets):
                words, at = words_of(data, offsets[i : j + 1])
                n, texts = np.diff(at), np.arange(j - i)
                begins = at + np.arange(j - i + 1)  # a symbol more for each text before
                of, kinds = np.repeat(texts, n), max(1, len(words.dictionary))
                symbols = np.empty(begins[-1], np.int64)
                symbols[np.arange(len(words)) + of] = of * kinds + words.indices.to_numpy()
                symbols[begins[1:] - 1] = -1 - texts
                runs = runs_of(symbols, begins, min_words, min_exponent)
                outs = [collapsed(words.slice(at[k], n[k]), runs[k]) for k in range(j - i)]
                rows = pa.array([[{"start": s, "length": m, "period": q} for s, m, q in r] for r in runs], pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))
                yield with_results(batch.slice(i, j - i), [text], {"n_words": pa.array(n), "runs": rows, "collapsed": text_array(outs)})

    schema = docs.drop(text).withColumns({c: F.lit(None).cast(kind) for c, kind in new.items()}).schema
    return docs.mapInArrow(look, schema)
