"""Mix sources to target weights by weighted fair queueing.

The documents of a source are shuffled by a seeded digest of doc_id and queued up to ``passes`` times over. A copy's
virtual finish time is the source's words up to and with it, divided by the source's weight; all queues together,
sorted by that time over the whole cluster, are the mix, truncated where the words of the budget are spent. The time of
that cut is known beforehand: it is the water level V at which the sources, each limited to ``passes`` times its
size, take min(passes * size, V * weight) words and the budget in all. The copy that stands across the cut gives the
words that its source has been served by then, so every source meets its target to the word.

Running sums never gather a source in one task: the digest's first digits split each source into 4,096 ranges, sums of
ranges give each range its start, and only rows of one range are summed one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logmill.llm.common import WORD

PASSES, RANGE_DIGITS = 3, 3


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, passes: int = PASSES) -> DataFrame:
    """Weight and target of each source, from lm_source, lm_size (long), lm_weight and the budget of all sizes.

    Sources are ordered by the level at which they run dry; the first whose level isn't reached fixes V, which is the
    largest of those that hold from there on. The table has a row for each source, so its window over all is small.
    """
    cap = F.col("lm_size") * passes
    by_level = Window.orderBy(F.col("lm_cap") / F.col("lm_weight"), "lm_source")
    before, everything, behind = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(), by_level.rowsBetween(0, Window.unboundedFollowing)
    leveled = sizes.withColumn("lm_cap", cap).withColumns({
        "lm_left": F.sum("lm_size").over(everything) - F.coalesce(F.sum("lm_cap").over(before), F.lit(0)),
        "lm_weights": F.sum("lm_weight").over(behind),
    })
    leveled = leveled.withColumn("lm_v", F.col("lm_left").cast("double") / F.col("lm_weights"))
    dry = F.col("lm_v") <= F.col("lm_cap") / F.col("lm_weight")
    level = F.coalesce(F.max(F.when(dry, F.col("lm_v"))).over(everything), F.lit(0.0))
    return leveled.withColumn("lm_level", level).select("lm_source", "lm_size", "lm_weight", F.least(F.col("lm_cap").cast("double"), F.col("lm_level") * F.col("lm_weight")).alias("lm_target"))


def cycle_weights(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Weights that repeat over the sources by code point, null last."""
    nth = F.row_number().over(Window.orderBy(F.col("lm_source").asc_nulls_last())) - 1
    return sources.withColumn("lm_weight", F.element_at(F.array(*map(F.lit, cycle)), (nth % len(cycle) + 1).cast("int")))


def mix(docs: DataFrame, weights=cycle_weights, passes: int = PASSES, seed: str = "mix", text: str | None = "text") -> DataFrame:
    """Append size, source_size, target, taken and copies to docs (doc_id, text, source and any other columns).

    size is the text's words (0 for null and empty texts), source_size and target are its source's. copies has the
    copies that the mix serves of the row: their number, virtual finish time and words; taken is the sum of their
    words. Null is a source like any other and comes last. Repeated rows are rows of their own; rows with the same
    doc_id keep one order by size, and alike rows share alike what they get. Without any word all targets are 0.
    weights: gives lm_weight, over 0, to a table of lm_source. text None: docs has size already. Other columns of docs
    that have one of the new names are replaced.
    """
    docs = docs.drop("source_size", "target", "taken", "copies", *(["size"] if text else []))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sized = docs.withColumns({"size": n_words(text) if text else F.col("size"), "lm_order": order}).withColumns({"lm_key": F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), "lm_range": F.substring("lm_order", 1, RANGE_DIGITS)})
    ranges = sized.groupBy("lm_key", "lm_range").agg(F.sum("size").alias("lm_sum"))
    per_source = ranges.groupBy("lm_key").agg(F.sum("lm_sum").alias("lm_size")).withColumn("lm_source", F.when(F.col("lm_key") != "", F.substring("lm_key", 2, 1 << 30)))
    goal = targets(weights(per_source.drop("lm_key")), passes).withColumn("lm_key", F.coalesce(F.concat(F.lit("="), "lm_source"), F.lit(""))).drop("lm_source")
    earlier = Window.partitionBy("lm_key").orderBy("lm_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("lm_from", F.coalesce(F.sum("lm_sum").over(earlier), F.lit(0))).drop("lm_sum").join(goal, "lm_key")
    within = Window.partitionBy("lm_key", "lm_range").orderBy("lm_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(starts, ["lm_key", "lm_range"]).withColumn("lm_at", F.col("lm_from") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    cut, copies = F.floor(F.col("lm_target") + 0.5), []
    for i in range(passes):
        at = F.lit(i) * F.col("lm_size") + F.col("lm_at")
        copies.append(F.struct(F.lit(i + 1).alias("copy"), ((at + F.col("size")) / F.col("lm_weight")).alias("finish"), served(at, F.col("size"), cut).cast("long").alias("words")))
    queued = placed.withColumn("copies", F.filter(F.array(*copies), lambda c: c["words"] > 0))
    done = queued.withColumns({"source_size": F.col("lm_size"), "target": F.col("lm_target"), "taken": F.aggregate("copies", F.lit(0).cast("long"), lambda n, c: n + c["words"])})
    return done.select(*docs.columns, *([] if "size" in docs.columns else ["size"]), "source_size", "target", "taken", "copies")


def served(start: Column, size: Column, cut: Column) -> Column:
    """Words of a copy that starts there before the cut."""
    return F.greatest(F.lit(0), F.least(size, cut - start))


def in_order(mixed: DataFrame) -> DataFrame:
    """The mix: a row for each copy that is served, with copy, finish and words, range-sorted by virtual finish time."""
    names = [c for c in mixed.columns if c not in ("copy", "finish", "words", "copies")]
    return mixed.select(*names, F.inline("copies")).orderBy("finish", "doc_id", "copy")
