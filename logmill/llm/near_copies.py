"""Near copies: components of texts whose word shingles have a Jaccard similarity of at least ``SIMILARITY``.

Shingles have five words, lower-cased (A-Z), between ASCII white space; a text of fewer words is one shingle. Texts of
the same words are one node. Links are found in two passes, and each is verified exactly before components are taken:

1. Fingerprints (SimHash of the distinct shingles) at most ``CLOSE`` bits apart are linked by BK-trees in pigeonhole
   shards. This joins dense groups with about one pair per text.
2. Texts of the similarity lie 9.7 bits apart on average, with a deviation of 2.9, where trees of 64 bits prune little.
   But two sets of the similarity share a shingle among the first n - ceil(0.8 n) + 1 of each in any common order. The
   order puts the shingles that a sample finds often last; the sample has an effect on speed only. Nodes that share such
   a shingle, whose sizes allow the similarity, whose fingerprints are at most ``RADIUS`` bits apart (sets under
   ``SHORT`` shingles scatter more and may be at any distance) and that pass 1 hasn't joined meet in a block. Large
   blocks are cut into tiles, and the task of a tile counts what each two of its nodes have in common. No pair is given
   out but the links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmill.llm.common import bytes_of, count_at_most, shared_dir, stored
from logmill.llm.components import connected
from logmill.llm.simhash import SEED, links

WORDS, SIMILARITY, CLOSE, RADIUS, SHORT = 5, 0.8, 3, 23, 32
#: Least texts and share of the sample, in how many of them a shingle is frequent, and how many such shingles are kept.
SAMPLE, SAMPLE_SHARE, FREQUENT, MOST_FREQUENT = 4000, 0.04, 3, 1_000_000
#: Rows of one shingle that are compared together with those of others, and those up to which rows near to none are left out.
SMALL_GROUP, MOST_COMPARED = 64, 4096
#: Rows and shingles that a part of a block has, more or less; a tile has two parts.
TILE_ROWS, TILE_SHINGLES = 512, 500_000
MIX = np.uint64(0x9E3779B97F4A7C15)
BROADCAST_ROWS = 500_000


def shingles(text: bytes, words: int = WORDS) -> tuple[int, np.ndarray]:
    """A hash of all words, and the sorted distinct hashes of the shingles (of the empty text if there is no word)."""
    found = text.lower().split()
    joined, k = b" ".join(found), min(words, len(found))
    digest = xxhash.xxh64_intdigest
    if not k:
        return digest(b"", SEED), np.array([digest(b"", SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(found) - k + 1]
    hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts.tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))
    return digest(joined, SEED), np.unique(hashes)


def majority(hashes: np.ndarray) -> int:
    """The SimHash of hashes: bits that are set in over half of them."""
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        set_bits += np.unpackbits(hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def texts_of(batch: pa.RecordBatch) -> Iterator[bytes]:
    data, offsets = bytes_of(batch.column("text"))
    return (data[offsets[i] : offsets[i + 1]].tobytes() for i in range(batch.num_rows))


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    """An Arrow column of lists of signed longs."""
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)))


def sets(docs: DataFrame, words: int) -> DataFrame:
    """node and lm_set, the distinct shingles, of each row of docs (text)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                found = [shingles(t, words) for t in texts_of(part)]
                yield pa.RecordBatch.from_arrays([pa.array(np.array([n for n, _ in found], np.uint64).view(np.int64)), lists([h for _, h in found])], names=["node", "lm_set"])

    return docs.select("text").mapInArrow(apply, "node long, lm_set array<long>")


def frequent(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles of many texts of a sample picked by a hash of the id, the least frequent first; it grows with the table."""
    share = max(SAMPLE_SHARE, SAMPLE / max(1, docs.count()))
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(10_000)) < int(10_000 * share))
    counts = sets(sample, words).select(F.explode("lm_set").alias("h")).groupBy("h").count().where(F.col("count") >= FREQUENT)
    rows = counts.orderBy(F.desc("count"), "h").limit(MOST_FREQUENT).select("h").toArrow()
    return rows["h"].to_numpy()[::-1].copy().view(np.uint64)


def least_common(n: int, share: Fraction) -> int:
    """How many of n elements a set of at least the similarity has in common."""
    return -(-n * share.numerator // share.denominator)


def marked(docs: DataFrame, words: int, share: Fraction) -> DataFrame:
    """doc_id, lm_text (a hash that tells rows of one doc_id apart), node, n (its distinct shingles), lm_fp, and lm_first: the shingles that nodes are dealt by."""
    last = frequent(docs, words)
    order = np.argsort(last)
    known = last[order]

    def first(hashes: np.ndarray) -> np.ndarray:
        n = len(hashes) - least_common(len(hashes), share) + 1
        if not len(known):
            return hashes[:n]
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        rank = np.where(known[at] == hashes, order[at], -1)
        return hashes[np.argsort(rank, kind="stable")[:n]]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n, fps, firsts = [], [], [], []
            for text in texts_of(batch):
                node, hashes = shingles(text, words)
                found.append(node)
                n.append(len(hashes))
                fps.append(majority(hashes))
                firsts.append(first(hashes))
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lm_text"), signed(found), pa.array(n, pa.int64()), signed(fps), lists(firsts)], names=["doc_id", "lm_text", "node", "n", "lm_fp", "lm_first"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("lm_text")).mapInArrow(apply, f"doc_id {kind}, lm_text long, node long, n long, lm_fp long, lm_first array<long>")


def near(i, j, root, n, fp, share: Fraction) -> np.ndarray:
    """Whether nodes i and j have two roots, and sizes and fingerprints that the similarity allows."""
    small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    return (root[i] != root[j]) & (share.numerator * large <= share.denominator * small) & ((np.bitwise_count(fp[i] ^ fp[j]) <= RADIUS) | (small < SHORT))


def with_partner(starts, sizes, root, n, fp, share: Fraction) -> np.ndarray:
    """Rows that are near to another row of their group; in groups over ``MOST_COMPARED`` all rows of mixed ones."""
    found = np.zeros(len(root), bool)
    mixed = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
    group = np.repeat(np.arange(len(starts)), sizes)
    open_ = np.flatnonzero(np.repeat(mixed & (sizes <= SMALL_GROUP), sizes))
    for d in range(1, SMALL_GROUP):
        open_ = open_[open_ + d < len(root)]
        open_ = open_[group[open_ + d] == group[open_]]
        if not len(open_):
            break
        hit = open_[near(open_, open_ + d, root, n, fp, share)]
        found[hit] = found[hit + d] = True
    for s, size in zip(starts[mixed & (sizes > SMALL_GROUP)].tolist(), sizes[mixed & (sizes > SMALL_GROUP)].tolist(), strict=True):
        if size > MOST_COMPARED:
            found[s : s + size] = True
            continue
        own = np.arange(s, s + size)
        for i in range(s, s + size):
            if not found[i]:
                hit = own[near(i, own, root, n, fp, share)]
                found[hit] = True
                found[i] = len(hit) > 0
    return found


def blocks(found: DataFrame, share: Fraction) -> DataFrame:
    """block and node, distinct: near nodes of found (node, root, n, lm_fp, lm_first) that share a first shingle are in one block.

    Of the nodes with one first shingle, without those near to none, one stands for all: that of the most frequent root
    whose mixed hash is least. Nodes with many first shingles in common so meet in few blocks, and each row read gives
    one row at most.
    """
    names = ["key", "root", "node", "n", "lm_fp"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def out(key, root, node, n, fp) -> pa.RecordBatch:
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(key)]]))
            kept = with_partner(starts, sizes, root, n, fp.view(np.uint64), share)
            group, root, node = np.repeat(np.arange(len(starts)), sizes)[kept], root[kept], node[kept]
            if not len(group):
                return pa.RecordBatch.from_arrays([pa.array(node)] * 2, names=["block", "node"])
            run = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (root[1:] != root[:-1])]))
            often = np.repeat(np.diff(np.concatenate([run, [len(group)]])), np.diff(np.concatenate([run, [len(group)]])))
            mixed = node.view(np.uint64) * MIX
            order = np.lexsort([mixed ^ (mixed >> np.uint64(31)), -often, group])
            first = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]]))
            leader = np.repeat(node[order[first]], np.diff(np.concatenate([first, [len(group)]])))  # groups are in order, so rows of one stand together
            both = np.unique(np.stack([leader, node], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["block", "node"])

        for batch in batches:
            now = [batch.column(c).to_numpy() for c in names]
            rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
            # the last key may go on in the next batch
            cut = int(np.searchsorted(rest[0], rest[0][-1])) if len(rest[0]) else 0
            if cut:
                yield out(*[x[:cut] for x in rest])
                rest = [x[cut:] for x in rest]
        if rest is not None and len(rest[0]):
            yield out(*rest)

    dealt = found.select(F.explode("lm_first").alias("key"), "root", "node", "n", "lm_fp")
    return dealt.repartition("key").sortWithinPartitions("key", "root", "node").mapInArrow(apply, "block long, node long").distinct()


def tiles(members: DataFrame, rows: int = TILE_ROWS, shingles: int = TILE_SHINGLES) -> DataFrame:
    """tile, low, high, node, root and lm_fp of members (block, node, root, lead_root, n, lm_fp): every two of a block with two roots meet in one tile.

    A block's nodes are its inner ones, which have its own root already, and the outer ones; each are dealt into parts of
    about so many rows and shingles. A tile is two parts of which one at least is outer, so a block of one root and a
    few others costs as much as it has rows, and no task holds more than two parts.
    """
    own = members.withColumn("outer", F.col("root") != F.col("lead_root"))
    parts = lambda when: F.greatest(F.ceil(F.count_if(when) / rows), F.ceil(F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)) / shingles)).cast("int")
    sizes = own.groupBy("block").agg(parts(F.col("outer")).alias("outers"), parts(~F.col("outer")).alias("inners")).where("outers > 0 and outers + inners > 0")
    dealt = own.join(sizes, "block").withColumn("part", F.pmod(F.xxhash64("node"), F.when(F.col("outer"), F.col("outers")).otherwise(F.col("inners"))).cast("int"))
    # parts of a block are numbered from 0, outer ones first
    numbered = dealt.withColumn("part", F.when(F.col("outer"), F.col("part")).otherwise(F.col("part") + F.col("outers")))
    partners = F.when(F.col("outer"), F.sequence(F.lit(0), F.col("outers") + F.col("inners") - 1)).otherwise(F.sequence(F.lit(0), F.col("outers") - 1))
    met = numbered.select("block", "node", "root", "lm_fp", "part", F.explode(partners).alias("other"))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    return met.select(F.xxhash64("block", low, high).alias("tile"), (F.col("part") == low).alias("low"), (F.col("part") == high).alias("high"), "node", "root", "lm_fp")


def in_common(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many elements each two of the sets have in common, as a sum of products of 0/1 matrices of so many columns."""
    total = np.zeros((len(sets), len(sets)))
    values, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    fresh = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column)[column] > 1  # others add nothing
    row, column = row[shared], column[shared]
    column = np.cumsum(np.concatenate([[False], column[1:] != column[:-1]])) if len(column) else column
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        i, j = np.searchsorted(column, [at, at + columns])
        part = np.zeros((len(sets), columns), np.float32)
        part[row[i:j], column[i:j] - at] = 1
        total += part @ part.T
    return total


def alike(nodes: list[int], roots: list[int], low: np.ndarray, high: np.ndarray, fp: np.ndarray, sets: list[np.ndarray], share: Fraction) -> Iterator[tuple[int, int]]:
    """Links of a tile that connect what all its links between two roots connect."""
    common, n, root = in_common(sets), np.array([len(s) for s in sets]), np.array(roots)
    top = {r: r for r in roots}

    def find(r: int) -> int:
        while top[r] != r:
            top[r] = r = top[top[r]]
        return r

    num, den = share.numerator, share.denominator
    for i in range(len(nodes)):
        met = ((low[i] & high[i + 1 :]) | (high[i] & low[i + 1 :])) & near(i, np.arange(i + 1, len(nodes)), root, n, fp, share)
        hit = met & ((num + den) * common[i, i + 1 :].astype(np.int64) >= num * (n[i] + n[i + 1 :]))
        for j in (np.flatnonzero(hit) + i + 1).tolist():
            if (a := find(roots[i])) != (b := find(roots[j])):
                top[a] = b
                yield nodes[i], nodes[j]


def linked(members: DataFrame, docs: DataFrame, found: DataFrame, words: int, share: Fraction, place: str) -> DataFrame:
    """Links (a, b) of nodes of members (block, node) in two roots that have the similarity, each found by an exact count.

    Links that the tile's other links make needless are left out.
    """
    known = found.groupBy("node").agg(F.min("root").alias("root"), F.min("n").alias("n"), F.min("lm_fp").alias("lm_fp"))
    own = members.join(known, "node").join(known.select(F.col("node").alias("block"), F.col("root").alias("lead_root")), "block")
    dealt = stored(tiles(own), f"{place}/tiles")
    texts = sets(texts_with(docs, found.join(dealt.select("node").distinct(), "node", "left_semi")), words).dropDuplicates(["node"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows = None, []

        def out() -> pa.RecordBatch:
            nodes, roots, low, high, fp, own = zip(*rows, strict=True) if rows else [()] * 6
            pairs = list(alike(nodes, roots, np.array(low), np.array(high), np.array(fp, np.int64).view(np.uint64), own, share)) if len(rows) > 1 else []
            both = np.array(pairs, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:
            column = batch.column("lm_set")
            values, at = column.values.to_numpy(), column.offsets.to_numpy()
            for k, (t, *row) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("tile", "node", "root", "low", "high", "lm_fp")), strict=True)):
                if t != tile:
                    yield out()
                    tile, rows = t, []
                rows.append((*row, values[at[k] : at[k + 1]].copy()))
        yield out()

    return dealt.join(texts, "node").repartition("tile").sortWithinPartitions("tile", "node").mapInArrow(apply, "a long, b long").distinct()


def hinted(ids: DataFrame) -> DataFrame:
    """ids (a number and a hash a row), broadcast if they are few, so that texts needn't be shuffled to meet them."""
    return F.broadcast(ids) if count_at_most(ids, BROADCAST_ROWS) else ids


def texts_with(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id and text of the rows of docs that hold the texts of the nodes of found (doc_id, node)."""
    ids = found.groupBy("node").agg(F.min("doc_id").alias("lm_id")).select("lm_id").distinct()
    return docs.select("doc_id", "text").join(hinted(ids), F.col("doc_id").eqNullSafe(F.col("lm_id")), "left_semi")


def verified(pairs: DataFrame, docs: DataFrame, found: DataFrame, words: int, share: Fraction) -> DataFrame:
    """The pairs (a, b) whose shingles have the similarity."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    own = sets(texts_with(docs, found.join(ends, "node", "left_semi")), words).dropDuplicates(["node"])
    sided = pairs.join(own.select(F.col("node").alias("a"), F.col("lm_set").alias("lm_a")), "a").join(own.select(F.col("node").alias("b"), F.col("lm_set").alias("lm_b")), "b")
    both = F.size("lm_a") + F.size("lm_b")
    common = F.size(F.array_intersect("lm_a", "lm_b"))
    return sided.where((share.numerator + share.denominator) * common >= share.numerator * both).select("a", "b")


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """doc_id and component_id (smallest doc_id of the component) of each row of docs.

    Null and empty texts are linked with texts that have no word either. Null doc_ids belong to their component but
    never name it; a component of null ids has null. Repeated rows stay repeated. Texts are read whole, other columns
    than doc_id and text aren't read, and empty tables give an empty result.
    """
    return components(docs, similarity, words).select("doc_id", "component_id")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """The rows of docs without those of a component of near copies that another row stands for, all columns.

    The row with the smallest doc_id stays (null ids come last; of rows with one doc_id and different texts the one with
    the least hash). Repeated rows stay or go together.
    """
    gone = components(docs, similarity, words).where("not stays").select(F.col("doc_id").alias("lm_id"), F.col("lm_text").alias("lm_hash")).distinct()
    gone = hinted(gone)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["lm_id"]) & (F.xxhash64(docs["text"]) == gone["lm_hash"]), "left_anti")


def components(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """doc_id, lm_text, component_id and stays (whether the row stands for its component) of each row of docs."""
    place, share = shared_dir(docs.sparkSession), Fraction(str(similarity))
    found = stored(marked(docs, words, share), f"{place}/marked")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "lm_text")
    nodes = stored(found.groupBy("node", "lm_fp").agg(F.min(first).alias("first")), f"{place}/nodes")
    prints = nodes.groupBy("lm_fp").agg(F.min("node").alias("lead"))
    same = nodes.join(prints, "lm_fp").where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    lead = lambda c: prints.select(F.col("lm_fp").alias(f"{c}_fp"), F.col("lead").alias(c))
    trees = links(prints.select("lm_fp"), CLOSE).select(F.col("a").alias("a_fp"), F.col("b").alias("b_fp")).distinct()
    close = stored(same.union(trees.join(lead("a"), "a_fp").join(lead("b"), "b_fp").select("a", "b")), f"{place}/close")
    sure = stored(verified(close, docs, found, words, share), f"{place}/sure")
    joined = connected(sure, f"{place}/dense")
    rooted = found.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = connected(sure.union(linked(blocks(rooted, share), docs, rooted, words, share, place)), f"{place}/components")
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = named.select("node", "root").join(named.groupBy("root").agg(F.min("first").alias("head")), "root").select("node", "head")
    stays = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("lm_text") == F.col("head.lm_text"))
    return found.select("doc_id", "lm_text", "node").join(heads, "node").select("doc_id", "lm_text", F.col("head.doc_id").alias("component_id"), stays.alias("stays"))
