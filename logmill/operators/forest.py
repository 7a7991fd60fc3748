"""Isolation forest: trees grow in parallel on small samples, windows are scored in batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logmill.operators.features import FEATURES
from logmill.session import shared_dir

TREES, SAMPLE, CONTAMINATION, SEED = 100, 256, 0.1, 42


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n leaves."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(x: np.ndarray, rng: np.random.Generator, depth: int, limit: int, nodes: list[tuple]) -> int:
    """Append the nodes (feature, cut, left, right, depth credit) of a tree; returns the root's number."""
    at = len(nodes)
    nodes.append((-1, 0.0, -1, -1, depth + average_path(len(x))))
    wide = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 and depth < limit else []
    if len(wide):
        f = int(rng.choice(wide))
        cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
        side = x[:, f] < cut
        left = grow(x[side], rng, depth + 1, limit, nodes)
        nodes[at] = (f, cut, left, grow(x[~side], rng, depth + 1, limit, nodes), 0.0)
    return at


def fit(windows: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """tree, node, feature, cut, left, right and credit of all nodes; a tree sees sample windows, those with its smallest hashes.

    Only windows whose hash for a tree is under a bound are copied to it; the bound comes from the number of windows and
    lets twice as many pass as are needed and some more, so a tree lacks none (the odds are below 1e-25), and then each
    tree keeps its smallest ones.
    """
    count = F.broadcast(windows.agg(F.count("*").alias("lm_n")))  # one row
    share = F.lit(2.0 * sample + 64) / F.greatest(F.col("lm_n"), F.lit(1))
    under = F.when(share < 1, ((share - 0.5) * 2.0**64).try_cast("long"))
    mine = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: under.isNull() | (F.xxhash64("window_start", t, F.lit(seed)) < under))
    dealt = windows.join(count).select("window_start", *[F.col(f).cast("double").alias(f) for f in FEATURES], F.explode(mine).alias("tree"))
    own = dealt.withColumn("r", F.xxhash64("window_start", "tree", F.lit(seed)))
    nth = F.row_number().over(Window.partitionBy("tree").orderBy("r", "window_start"))  # limited before the shuffle
    first = own.withColumn("nth", nth).where(F.col("nth") <= sample)
    few = first.groupBy("tree").agg(F.sort_array(F.collect_list(F.struct("nth", F.array(*FEATURES).alias("x")))).alias("rows"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for tree, rows in zip(pdf["tree"], pdf["rows"], strict=True):
                x = np.array([list(r["x"]) for r in rows], float)
                nodes: list[tuple] = []
                grow(x, np.random.default_rng(seed + int(tree)), 0, int(np.ceil(np.log2(max(2, len(x))))), nodes)
                yield pd.DataFrame([(tree, i, *n, len(x)) for i, n in enumerate(nodes)], columns=["tree", "node", "feature", "cut", "left", "right", "credit", "n"])

    return few.mapInPandas(build, "tree int, node int, feature int, cut double, left int, right int, credit double, n int")


def score(windows: DataFrame, forest: DataFrame, contamination: float = CONTAMINATION) -> DataFrame:
    """window_start, decision (below 0 is odd) and forest_vote. The forest has at most trees * 2 * sample nodes, so it is broadcast."""
    nodes = forest.orderBy("tree", "node").toPandas()
    shared = windows.sparkSession.sparkContext.broadcast([t[["feature", "cut", "left", "right", "credit"]].to_numpy() for _, t in nodes.groupby("tree")])
    norm = average_path(float(nodes["n"].max())) or 1.0

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, depth = pdf[list(FEATURES)].to_numpy(float), np.zeros(len(pdf))
            for t in shared.value:
                at = np.zeros(len(pdf), int)
                while (inner := t[at, 0] >= 0).any():
                    i = np.flatnonzero(inner)
                    below = x[i, t[at[i], 0].astype(int)] < t[at[i], 1]
                    at[i] = np.where(below, t[at[i], 2], t[at[i], 3]).astype(int)
                depth += t[at, 4]
            yield pd.DataFrame({"window_start": pdf["window_start"], "raw": -np.power(2.0, -depth / len(shared.value) / norm)})

    raw = windows.select("window_start", *[F.col(f).cast("double") for f in FEATURES]).mapInPandas(apply, "window_start long, raw double")
    place = f"{shared_dir(windows.sparkSession)}/raw"  # stored, since the limit and the rows would each score all windows
    raw.write.parquet(place)
    raw = windows.sparkSession.read.schema(raw.schema).parquet(place)
    limit = F.broadcast(raw.agg(F.percentile("raw", contamination).alias("limit")))  # one row
    decision = F.round(F.col("raw") - F.col("limit"), 4)
    return raw.join(limit).select("window_start", decision.alias("decision"), (F.col("raw") < F.col("limit")).alias("forest_vote"))
