"""The corpus pipeline: five of the training-data operators, each working on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.llm import decontaminate, exact_dedup, mixing, near_copies, quality
from logmill.llm.common import lower_ascii, shared_dir, stored, table, unused
from logmill.session import ship


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    weights = quality.train(docs, quality.learnable(table(ship(spark), sf_dir, "labels")))
    return quality.score(docs.drop("score", "predicted"), weights).where("predicted = 1").select(*docs.columns)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; of repeated rows with that id one."""
    kept = exact_dedup.deduplicate(docs).where("kept").select(F.col("doc_id").alias("lm_id"), F.col("text_sha256").alias("lm_sha"))
    own = unused("lm_own", docs)
    marked = docs.withColumn(own, F.sha2(lower_ascii(F.coalesce(F.col("text"), F.lit(""))), 256))
    found = marked.join(kept, marked["doc_id"].eqNullSafe(kept["lm_id"]) & (marked[own] == kept["lm_sha"]), "left_semi")
    return found.dropDuplicates(["doc_id", own]).drop(own)


def keep_one_of_alike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with its smallest doc_id."""
    return near_copies.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("lm_id"), F.col("lm_text").alias("lm_hash")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["lm_id"]) & (F.xxhash64(docs["text"]) == found["lm_hash"]), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy of a document that is served, with its words, by virtual finish time; taken sums a document's copies."""
    return mixing.in_order(mixing.mix(docs))


#: The name and the function of each stage, in order.
STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", keep_one_copy),
    ("SimHash near-dedup", keep_one_of_alike),
    ("benchmark decontamination", drop_leaks),
    ("source mixing", mix_sources),
]

#: The classifier and the fingerprints have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again for the next."""
    place, docs = shared_dir(spark), table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        docs = stored(out, f"{place}/{i}")
    return docs
