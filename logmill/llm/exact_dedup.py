"""Exact deduplication with an extendible-hash index on shared files.

Every text has a 64-bit key. A directory of at most 2**MAX_DEPTH slots, indexed by the key's first bits, sends keys to
buckets: it starts with one bucket and doubles wherever a bucket would hold over ``capacity`` keys, so buckets get as
deep as their own keys need. Only digests are shuffled at first. Texts whose key occurs once need no comparison; those
whose key repeats are compared whole, byte by byte, as grouping keys that each task combines before they are shuffled, so
a text that fills a third of the table arrives as a row per task. Entries then go to the tasks that own them: Spark
deals ranges of (bucket, key), and the owner chains the entries of a key. The index (bucket, key, chain of digest,
keeper and count) lies as Parquet in the shared folder, sorted by bucket and key, and survives lost executors. A row finds
its entry through the directory: slot, bucket, key, and in the chain its digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmill.llm.common import count_at_most, lower_ascii, shared_dir, stored

MAX_DEPTH, CAPACITY, BROADCAST_ROWS = 16, 1000, 500_000


def slot(key: str = "lm_key"):
    """The first MAX_DEPTH bits of the key."""
    return F.shiftrightunsigned(key, 64 - MAX_DEPTH)


def directory(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """lm_slot and lm_bucket for each slot that has keys: at most 2**MAX_DEPTH rows, whatever the corpus.

    A slot's bucket is its shortest prefix that at most capacity different keys share, or the whole slot.
    """
    filled = keys.select("lm_key").distinct().groupBy(slot().alias("lm_slot")).agg(F.count("*").alias("n"))
    depths = F.explode(F.array(*map(F.lit, range(MAX_DEPTH + 1)))).alias("depth")
    prefixes = filled.select("lm_slot", "n", depths).withColumn("prefix", F.expr(f"shiftright(lm_slot, {MAX_DEPTH} - depth)"))
    fits = prefixes.groupBy("depth", "prefix").agg(F.sum("n").alias("total")).where((F.col("total") <= capacity) | (F.col("depth") == MAX_DEPTH))
    known = prefixes.join(F.broadcast(fits), ["depth", "prefix"])  # fits has at most 2**(MAX_DEPTH + 1) rows
    leaf = known.groupBy("lm_slot").agg(F.min(F.struct("depth", "prefix")).alias("leaf"))
    return leaf.select("lm_slot", F.expr(f"shiftleft(leaf.prefix, {MAX_DEPTH} - leaf.depth)").cast("int").alias("lm_bucket"))


def build_index(docs: DataFrame, place: str, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keys of all rows (doc_id, lm_key, text_sha256), the directory and the index, all stored under place."""
    normal = docs.select("doc_id", lower_ascii(F.coalesce(F.col("text"), F.lit(""))).alias("lm_text"))
    keyed = normal.withColumn("lm_key", F.xxhash64("lm_text"))
    keys = stored(keyed.select("doc_id", "lm_key", F.sha2("lm_text", 256).alias("text_sha256")), f"{place}/keys")
    counted = stored(keys.groupBy("lm_key").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"), F.min("text_sha256").alias("text_sha256")), f"{place}/counted")
    slots = stored(directory(counted, capacity), f"{place}/directory")
    often = counted.where("group_size > 1").select("lm_key")
    few = count_at_most(often, BROADCAST_ROWS)  # keys of 8 bytes; otherwise Spark joins by shuffle
    same = keyed.join(F.broadcast(often) if few else often, "lm_key", "left_semi").groupBy("lm_key", "lm_text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    compared = stored(same.select("lm_key", F.sha2("lm_text", 256).alias("text_sha256"), "keep_id", "group_size"), f"{place}/compared")
    entries = in_bucket(counted.where("group_size = 1").unionByName(compared), slots)
    owned = entries.repartitionByRange("lm_bucket", "lm_key").groupBy("lm_bucket", "lm_key").agg(F.collect_list(F.struct("text_sha256", "keep_id", "group_size")).alias("chain"))
    return keys, slots, stored(owned.sortWithinPartitions("lm_bucket", "lm_key"), f"{place}/index")


def in_bucket(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """rows (lm_key) with their lm_bucket by the directory, which has at most 2**MAX_DEPTH rows."""
    return rows.join(F.broadcast(slots), slot() == F.col("lm_slot")).drop("lm_slot")


def deduplicate(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of docs, dropped ones too.

    Texts are equal if they are identical after lower-casing A-Z; null counts as empty. The row with the largest doc_id
    stays; of repeated rows with that doc_id one stays, and in a group of null doc_ids alone one row of null. Texts are
    compared whole; other columns than doc_id and text aren't read. An empty table gives an empty result.
    """
    keys, slots, index = build_index(docs, shared_dir(docs.sparkSession), capacity)
    rows = keys.groupBy("lm_key", "text_sha256", "doc_id").agg(F.count("*").alias("lm_rows"))
    met = in_bucket(rows, slots).join(index, ["lm_bucket", "lm_key"])
    found = met.withColumn("lm_entry", F.get(F.filter("chain", lambda e: e["text_sha256"] == F.col("text_sha256")), 0)).select("*", "lm_entry.keep_id", "lm_entry.group_size")
    return found.select("doc_id", "keep_id", "group_size", F.explode(F.sequence(F.lit(1).cast("long"), "lm_rows")).alias("lm_copy"), "text_sha256").select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("lm_copy") == 1)).alias("kept"), "text_sha256")
