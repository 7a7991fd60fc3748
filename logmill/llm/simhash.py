"""SimHash near-duplicates, linked with BK-trees.

A fingerprint has 64 bits, each set if it is set in over half of the hashes of the text's word shingles. Texts are
linked if their fingerprints differ in at most ``radius`` bits, and a component is what links reach.

Equal fingerprints are one node. The 64 bits are cut into radius + 1 blocks; two fingerprints within the radius agree
on one block at least, so the nodes that share a block's value are a shard, and no link is between shards only. The
task that owns a shard builds a BK-tree of it (children keyed by their Hamming distance to the parent), looks each
node up before it goes in, following only edges within the radius, and gives out a spanning forest of the links. A
shard of over ``shard_rows`` nodes is dealt once more by blocks of its remaining bits, again without loss. Trees stay
with the task that owns them: broadcast they would grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmill.llm.common import bytes_of, shared_dir, stored
from logmill.llm.components import connected

SEED, WORDS, RADIUS, SHARD_ROWS = 42, 3, 3, 4096


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Of lower-cased (A-Z) words between ASCII white space; 0 if there is no word."""
    found = text.lower().split()
    if not found:
        return 0
    joined, k = b" ".join(found), min(words, len(found))
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(found) - k + 1]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts.tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """docs with the text replaced by lm_fp, the fingerprint as a signed long; null and empty texts have 0."""
    schema = docs.withColumn("lm_fp", F.lit(0).cast("long")).drop(text).schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column(text))
            found = [fingerprint(data[offsets[i] : offsets[i + 1]].tobytes(), words) for i in range(batch.num_rows)]
            rest = [k for k in batch.schema.names if k != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in rest), pa.array(np.array(found, np.uint64).view(np.int64))], names=[*rest, "lm_fp"])

    return docs.mapInArrow(apply, schema)


class BKTree:
    """Nodes are integers; a child is kept under its distance to the parent."""

    def __init__(self, radius: int):
        self.radius, self.items, self.children = radius, [], []

    def within(self, item: int) -> list[int]:
        """Numbers of the nodes at most radius bits away."""
        found, open_ = [], [0] if self.items else []
        while open_:
            at = open_.pop()
            d = (self.items[at] ^ item).bit_count()
            if d <= self.radius:
                found.append(at)
            for edge, child in self.children[at].items():
                if d - self.radius <= edge <= d + self.radius:
                    open_.append(child)
        return found

    def add(self, item: int) -> None:
        self.items.append(item)
        self.children.append({})
        at, new = 0, len(self.items) - 1
        while at != new:
            at = self.children[at].setdefault((self.items[at] ^ item).bit_count(), new)


def forest(items: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links of a shard that connect what all its links connect, at most one fewer than items."""
    tree, root = BKTree(radius), list(range(len(items)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for k, item in enumerate(items):
        for near in tree.within(item):
            if (a := top(near)) != (b := top(k)):
                root[b] = a
                yield items[near], item
        tree.add(item)


def block_keys(bits: list[int], n: int) -> list[tuple[int, int]]:
    """n runs of the bits from, to (from the lowest), as even as can be, as (shift, width)."""
    edges = [bits[0] + (bits[1] - bits[0]) * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def piece(column, shift: int, width: int):
    return F.shiftrightunsigned(column, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def links(nodes: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges (a, b) of distinct fingerprints lm_fp that connect whatever links within the radius connect."""
    blocks = block_keys([0, 64], radius + 1)
    one = F.explode(F.array(*[F.struct(F.lit(i).alias("block"), piece(F.col("lm_fp"), s, w).alias("value")) for i, (s, w) in enumerate(blocks)]))
    dealt = nodes.select("lm_fp", one.alias("k")).select("lm_fp", "k.block", "k.value")
    large = dealt.groupBy("block", "value").count().where(F.col("count") > shard_rows).select("block", "value", F.lit(True).alias("large"))

    def rest(block: int):
        """Blocks of the bits outside this block, which a rotation brings to the front."""
        s, w = blocks[block]
        turned = F.shiftrightunsigned("lm_fp", s + w).bitwiseOR(F.shiftleft("lm_fp", 64 - s - w)) if s + w < 64 else F.col("lm_fp")
        return F.array(*[F.struct(F.lit(i).alias("part"), piece(turned, a, b).alias("part_value")) for i, (a, b) in enumerate(block_keys([0, 64 - w], radius + 1))])

    parts = rest(0)
    for b in range(1, radius + 1):
        parts = F.when(F.col("block") == b, rest(b)).otherwise(parts)
    none = F.array(F.struct(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("part_value")))
    shards = dealt.join(large, ["block", "value"], "left").select("lm_fp", "block", "value", F.explode(F.when(F.col("large"), parts).otherwise(none)).alias("p")).select("lm_fp", F.xxhash64("block", "value", "p.part", "p.part_value").alias("shard"))

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, items = None, []
        edges: list[tuple[int, int]] = []

        def out() -> pa.RecordBatch:
            both = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
            edges.clear()
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:
            for s, fp in zip(batch.column("shard").to_pylist(), batch.column("lm_fp").to_numpy().view(np.uint64).tolist(), strict=True):
                if s != shard:
                    if len(items) > 1:
                        edges.extend(forest(items, radius))
                    shard, items = s, []
                items.append(fp)
            yield out()
        if len(items) > 1:
            edges.extend(forest(items, radius))
        yield out()

    return shards.repartition("shard").sortWithinPartitions("shard", "lm_fp").mapInArrow(trees, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = WORDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id of the component) of each row of docs.

    Null and empty texts have fingerprint 0 and are linked like any other. Null doc_ids belong to their component but
    never name it; a component of null ids has null. Repeated rows stay repeated. Texts are read whole, other columns
    than doc_id and text aren't read, and empty tables give an empty result.
    """
    place = shared_dir(docs.sparkSession)
    found = stored(fingerprints(docs.select("doc_id", "text"), words=words), f"{place}/fingerprints")
    nodes = found.groupBy("lm_fp").agg(F.min("doc_id").alias("least"))
    joined = connected(links(nodes.select("lm_fp"), radius, shard_rows), f"{place}/components")
    linked = nodes.join(joined, F.col("lm_fp") == F.col("node"))
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = nodes.join(linked.select("lm_fp", "root").join(named, "root"), "lm_fp", "left").select("lm_fp", F.coalesce("component_id", "least").alias("component_id"))
    return found.join(ids, "lm_fp").select("doc_id", F.lpad(F.lower(F.hex("lm_fp")), 16, "0").alias("fingerprint"), "component_id")
