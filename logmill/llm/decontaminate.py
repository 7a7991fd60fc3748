"""Benchmark decontamination: item-sized windows, SimHash with multi-index Hamming blocks, exact verification.

Words are runs of letters and digits, lower-cased, and shingles have five of them (an item of fewer words is one
shingle). A window of an item's size whose similarity to the item is 0.8 or more shares shingles with it, so windows
are laid where a shingle of an item stands in a text, at the place that lines both up; each run of matching shingles
lays one, and remembers whose shingle it was. The windows get 64-bit fingerprints. These are looked up by item and by 8
blocks of 8 bits, each with all values up to 2 bits away: two fingerprints that differ in at most 23 bits differ in at
most 2 bits in one block, so the lookup finds all within the radius. The fingerprints of items with under SURE shingles
scatter too widely for a radius, so their windows are all verified. What is found is verified exactly: the weighted
Jaccard similarity of the windows' and the item's shingles, each weighing as often as it occurs, must reach the threshold.

All of it is DataFrame operations. The benchmark's side of each join has rows of a few numbers, without texts or
shingles, and is broadcast only if a count shows that it is small (BROADCAST_ROWS, some 10 MB); otherwise Spark joins by
shuffle, and what is shuffled for each word is as narrow. Shingles are joined to windows and items after the lookup.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmill.llm.common import count_at_most, shared_dir, stored

SHINGLE, SIMILARITY, RADIUS, BLOCKS, WIDTH, BROADCAST_ROWS = 5, 0.8, 23, 8, 8, 250_000
#: From so many shingles on, two sets of similarity 0.8 lie within the radius but for some 1e-5 of them.
SURE = 32
#: All changes of up to RADIUS // BLOCKS bits of a block.
CHANGES = [sum(1 << b for b in bits) for n in range(RADIUS // BLOCKS + 1) for bits in combinations(range(WIDTH), n)]
WINDOW = ["doc_id", "lm_text", "lm_start", "lm_size"]


def words(text: str = "text") -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingle_hashes(k: int, column: str = "lm_words") -> Column:
    """Hashes of the k words from each place on; empty if there are fewer than k words."""
    starts = F.sequence(F.lit(0), F.size(column) - k)
    return F.when(F.size(column) >= k, F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col(column), i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def once(column: Column) -> Column:
    """The column behind a generator of one row, so that no later expression evaluates it again."""
    return F.explode(F.array(column))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, its number of words, k and its shingles' hashes; texts without a word are left out, repeated rows once."""
    split = benchmark.select("item_id", words().alias("lm_words")).where(F.size("lm_words") > 0)
    sized = split.select("item_id", "lm_words", F.size("lm_words").alias("lm_size"), F.least(F.size("lm_words"), F.lit(SHINGLE)).alias("lm_k"))
    hashes = F.lit(None).cast("array<bigint>")
    for k in range(1, SHINGLE + 1):
        hashes = F.when(F.col("lm_k") == k, shingle_hashes(k)).otherwise(hashes)
    known = sized.select("item_id", "lm_size", "lm_k", hashes.alias("lm_hashes")).distinct()
    return known.withColumn("lm_item_fp", fingerprint("lm_hashes")).withColumn("lm_item_key", F.xxhash64("item_id", "lm_hashes"))


def windows(docs: DataFrame, items: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """WINDOW, lm_hashes, lm_fp and lm_items (the keys of the items whose shingles laid it) of the windows; lm_text tells rows with one doc_id apart."""
    sizes = sorted(r[0] for r in items.select("lm_k").distinct().collect())  # at most SHINGLE rows
    split = docs.select("doc_id", F.xxhash64("text").alias("lm_text"), once(words()).alias("lm_words"))
    laid = None
    for k in sizes or [SHINGLE]:
        own = items.where(F.col("lm_k") == k).select("lm_item_key", "lm_size", F.posexplode("lm_hashes").alias("lm_at", "lm_hash"), "lm_hashes")
        known = own.select("lm_item_key", "lm_hash", "lm_size", "lm_at", F.when(F.col("lm_at") > 0, F.get("lm_hashes", F.col("lm_at") - 1)).alias("lm_before")).distinct()
        hashed = split.select("doc_id", "lm_text", once(shingle_hashes(k)).alias("lm_all"))
        n_all, before = F.col("lm_n"), F.col("lm_previous")
        fresh = F.col("lm_before").isNull() | ~before.eqNullSafe(F.col("lm_before"))  # in a run of an item's shingles the first lays the window
        start = F.greatest(F.lit(0), F.least(F.col("lm_place") - F.col("lm_at"), n_all + (k - 1) - F.col("lm_size")))
        cut = F.slice("lm_all", F.col("lm_start") + 1, F.col("lm_size") - (k - 1)).alias("lm_hashes")
        facts = {"lm_n": F.size("lm_all"), "lm_previous": F.when(F.col("lm_place") > 0, F.get("lm_all", F.col("lm_place") - 1))}
        if count_at_most(known, most):  # a word's row meets the items where it stands, so the text's hashes may stay beside it
            places = hashed.select("doc_id", "lm_text", "lm_all", F.posexplode("lm_all").alias("lm_place", "lm_hash"))
            hits = places.join(F.broadcast(known), "lm_hash").withColumns(facts).where(fresh).withColumn("lm_start", start)
            found = hits.select(*WINDOW, cut, "lm_item_key").groupBy(*WINDOW).agg(F.first("lm_hashes").alias("lm_hashes"), F.collect_set("lm_item_key").alias("lm_items"))
        else:
            each = F.transform(F.sequence(F.lit(0), F.size("lm_all") - 1), lambda i: F.struct(i.alias("lm_place"), F.get("lm_all", i).alias("lm_hash"), F.when(i > 0, F.get("lm_all", i - 1)).alias("lm_previous"), F.size("lm_all").alias("lm_n")))
            places = hashed.where(F.size("lm_all") > 0).select("doc_id", "lm_text", F.inline(each))
            spans = places.join(known, "lm_hash").where(fresh).select("doc_id", "lm_text", start.alias("lm_start"), "lm_size", "lm_item_key")
            spans = spans.groupBy(*WINDOW).agg(F.collect_set("lm_item_key").alias("lm_items"))
            texts = hashed.dropDuplicates(["doc_id", "lm_text"])
            found = joined(spans, texts, ["doc_id", "lm_text"]).select(*WINDOW, cut, "lm_items")
        laid = found if laid is None else laid.union(found)  # windows of another k have another size
    return laid.withColumn("lm_fp", fingerprint("lm_hashes"))


def joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join in which null keys are equal; the keys come once."""
    other = right.select(*(F.col(k).alias(f"lm_other_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    on = reduce(and_, (F.col(k).eqNullSafe(F.col(f"lm_other_{k}")) for k in keys))
    return left.join(other, on).drop(*(f"lm_other_{k}" for k in keys))


def fingerprint(hashes: str) -> Column:
    """The SimHash of an array of hashes: a bit is set if more have it than not."""
    one = F.lit(1).cast("long")

    def bit(b: Column) -> Column:
        n = F.aggregate(hashes, F.lit(0), lambda total, h: total + F.call_function("shiftrightunsigned", h, b).bitwiseAND(one).cast("int"))
        return F.when(2 * n > F.size(hashes), F.call_function("shiftleft", one, b)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda fp, b: fp.bitwiseOR(bit(b)))


def blocks(fp: Column, changes: list[int]) -> Column:
    """(block, value) of each block and each change of its bits, to explode."""
    masks = F.array(*[F.lit(c).cast("long") for c in changes])

    def one(i: int) -> Column:
        value = F.shiftrightunsigned(fp, WIDTH * i).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("long"))
        return F.transform(masks, lambda c: F.struct(F.lit(i).alias("block"), value.bitwiseXOR(c).alias("value")))

    return F.explode(F.flatten(F.array(*map(one, range(BLOCKS)))))


def candidates(laid: DataFrame, items: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """WINDOW and lm_item_key of what is verified: each window with those of its own items that the lookup finds, or that are short.

    A pair comes once for each block in which it is found.
    """
    sure = F.size("lm_hashes") >= SURE
    own = laid.select(*WINDOW, "lm_fp", (~sure).alias("lm_short"), F.explode("lm_items").alias("lm_item_key"))
    index = items.where(sure).select("lm_item_key", "lm_item_fp", blocks(F.col("lm_item_fp"), CHANGES).alias("k")).select("lm_item_key", "k.block", "k.value", "lm_item_fp")
    probes = own.where(~F.col("lm_short")).select(*WINDOW, "lm_item_key", "lm_fp", blocks(F.col("lm_fp"), [0]).alias("k")).select(*WINDOW, "lm_item_key", "lm_fp", "k.block", "k.value")
    found = probes.join(F.broadcast(index) if count_at_most(index, most) else index, ["lm_item_key", "block", "value"]).where(F.bit_count(F.col("lm_fp").bitwiseXOR(F.col("lm_item_fp"))) <= RADIUS)
    return found.select(*WINDOW, "lm_item_key").unionByName(own.where("lm_short").select(*WINDOW, "lm_item_key"))


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, most: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, lm_text, item_id, similarity, first_word and n_words: the best window of each text for each item it leaks.

    A null or empty text, and an item without a word, leaks nothing. Texts are searched whole, however long; a text
    shorter than the item is one window. Repeated rows of docs are reported once; texts that share a doc_id are told
    apart by lm_text, a hash. Items with the same text are all reported, a null item_id too. Other columns of either
    table aren't read. Among windows of equal similarity the first counts. most: rows of the items' side up to which it
    is broadcast; the result is the same beyond.
    """
    place = shared_dir(docs.sparkSession)
    items = stored(items_of(benchmark), f"{place}/items")
    laid = stored(windows(docs.select("doc_id", "text"), items, most), f"{place}/windows")
    near = candidates(laid, items, most)
    pairs = joined(near.select(*WINDOW, "lm_item_key").distinct(), laid.select(*WINDOW, "lm_hashes"), WINDOW)
    sided = pairs.join(items.select("lm_item_key", "item_id", F.col("lm_hashes").alias("lm_item")), "lm_item_key")
    common = F.aggregate(F.array_intersect("lm_hashes", "lm_item"), F.lit(0), lambda n, h: n + F.least(times("lm_hashes", h), times("lm_item", h)))
    scored = sided.withColumn("n", common).withColumn("similarity", F.col("n") / (F.size("lm_hashes") + F.size("lm_item") - F.col("n"))).where(F.col("similarity") >= similarity)
    best = scored.groupBy("doc_id", "lm_text", "item_id").agg(F.max(F.struct("similarity", (-F.col("lm_start")).alias("at"), "lm_size")).alias("best"))
    return best.select("doc_id", "lm_text", "item_id", "best.similarity", (-F.col("best.at")).cast("long").alias("first_word"), F.col("best.lm_size").cast("long").alias("n_words"))


def times(column: str, h: Column) -> Column:
    return F.size(F.filter(F.col(column), lambda x: x == h))
