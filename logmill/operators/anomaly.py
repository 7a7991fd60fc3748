"""Baselines and anomaly scores of feature windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logmill.operators.features import FEATURES
from logmill.operators.rules import cooldown_fold

Z_THRESHOLD, RELATIVE_FLOOR, ABSOLUTE_FLOOR, LEAST_VECTORS, LEAST_ACTIVE, STD_FLOOR, COOLDOWN = 2.5, 0.25, 1.0, 10, 5, 0.001, 1800
SEVERITY = ((0.8, "high"), (0.5, "medium"))


def long_form(windows: DataFrame) -> DataFrame:
    """A row for each window and feature, with the feature's position."""
    pairs = F.array(*[F.struct(F.lit(i).cast("long").alias("position"), F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for i, f in enumerate(FEATURES)])
    return windows.select("window_start", F.explode(pairs).alias("x")).select("window_start", "x.*")


def fit(windows: DataFrame) -> DataFrame:
    """feature, position, mean and std (population; 0 becomes a small value), or no row below 10 windows or 5 active ones."""
    total = sum((F.col(f).cast("double") for f in FEATURES), F.lit(0.0))
    enough = F.broadcast(windows.agg(F.count("*").alias("n"), F.count_if(total > 0).alias("active")).where((F.col("n") >= LEAST_VECTORS) & (F.col("active") >= LEAST_ACTIVE)))  # one row
    std = F.stddev_pop("value")
    stats = long_form(windows).groupBy("position", "feature").agg(F.avg("value").alias("mean"), F.when(std == 0, STD_FLOOR).otherwise(std).alias("std"))
    return stats.join(enough).select("position", "feature", "mean", "std")


def scored(windows: DataFrame, baseline: DataFrame, z_threshold: float = Z_THRESHOLD, floor: float = RELATIVE_FLOOR) -> DataFrame:
    """Per window and feature value, mean, std, z and flag: |z| over the threshold and the deviation over its floor.

    baseline has a row for each feature, so it is broadcast.
    """
    z = (F.col("value") - F.col("mean")) / F.col("std")
    enough = F.abs(F.col("value") - F.col("mean")) > F.greatest(F.lit(ABSOLUTE_FLOOR), F.abs("mean") * floor)
    return long_form(windows).join(F.broadcast(baseline), ["position", "feature"], "left").withColumn("z", z).withColumn("flag", F.coalesce((F.abs("z") > z_threshold) & enough, F.lit(False)))


def verdicts(features: DataFrame, votes: DataFrame | None = None, require_agreement: bool = True) -> DataFrame:
    """Per window: details of its flagged features (only z is rounded, to 2 places), score, is_anomaly, method and severity.

    votes: window_start and forest_vote of an isolation forest; without it the z check decides alone. The score is the
    share of checks that signal; with agreement all must. Windows without a baseline are no anomaly, method none.
    """
    details = F.transform(F.sort_array(F.collect_list(F.when(F.col("flag"), F.struct("position", "feature", "value", "mean", "std", F.round("z", 2).alias("z"))))), lambda x: x.dropFields("position"))
    w = features.groupBy("window_start").agg(details.alias("details"), F.max("mean").isNotNull().alias("fitted"))
    w = w.join(votes, "window_start", "left") if votes is not None else w.withColumn("forest_vote", F.lit(None).cast("boolean"))
    z_says, checks = (F.size("details") > 0).cast("int"), F.lit(1) + F.col("forest_vote").isNotNull().cast("int")
    signals = z_says + F.coalesce(F.col("forest_vote"), F.lit(False)).cast("int")
    fitted = F.col("fitted")
    score = F.when(fitted, signals / checks).otherwise(0.0)
    anomaly = fitted & (signals == checks if require_agreement else signals > 0)
    method = F.when(~fitted, "none").when(checks == 2, "z_score+isolation_forest").otherwise("z_score")
    return w.select("window_start", "details", "forest_vote", score.alias("score"), anomaly.alias("is_anomaly"), method.alias("method"), severity(score).alias("severity"))


def severity(score: Column) -> Column:
    return F.when(score >= SEVERITY[0][0], SEVERITY[0][1]).when(score >= SEVERITY[1][0], SEVERITY[1][1]).otherwise("low")


def one_place(x: Column) -> Column:
    """A number with one place behind the point, rounded as its exact binary value is, ties to even.

    The formatter of the JVM rounds the shortest decimal form instead. x * 20 - (2k + 1) has the sign of what x is beyond
    the middle of k and k + 1 tenths; in these two steps it is worked out without an error.
    """
    k = F.floor(F.abs(x) * 10)
    beyond = (F.abs(x) * 16 - (2 * k + 1)) + F.abs(x) * 4
    tenths = k + ((beyond > 0) | ((beyond == 0) & (k % 2 == 1))).cast("long")
    return F.concat(F.when(x < 0, "-").otherwise(""), F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def shortest(x: Column) -> Column:
    """A number in its shortest form, never with an exponent; whole ones end in .0."""
    text = x.cast("string")
    plain = F.regexp_replace(x.cast("decimal(38,18)").cast("string"), "0+$", "")
    return F.when(x == F.floor(x), F.concat(F.floor(x).cast("string"), F.lit(".0"))).when(text.contains("E"), plain).otherwise(text)


def message(minutes: int = 10) -> Column:
    """Window (UTC, with its offset), flagged features and the forest's word, a line each."""
    at = lambda plus: F.concat(F.date_format(F.to_utc_timestamp(F.timestamp_seconds(F.col("window_start") + plus), F.current_timezone()), "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00"))
    one = lambda d: F.concat(F.lit("  "), d["feature"], F.lit(": value="), shortest(d["value"]), F.lit(", mean="), one_place(d["mean"]), F.lit(", z="), shortest(d["z"]))
    head = F.format_string("ML Anomaly detected (score=%.2f, method=%s)", "score", "method")
    flagged = F.when(F.size("details") > 0, F.concat(F.lit("Anomalous features:\n"), F.array_join(F.transform("details", one), "\n")))
    forest = F.when(F.col("forest_vote").isNotNull(), F.concat(F.lit("\nIsolation Forest: "), F.when(F.col("forest_vote"), "anomaly").otherwise("normal")))
    return F.concat_ws("\n", head, F.concat(F.lit("Window: "), at(0), F.lit(" — "), at(minutes * 60)), F.lit(""), flagged, forest)


def anomaly_alerts(found: DataFrame, gap: int = COOLDOWN) -> DataFrame:
    """Fired alerts of anomalous windows under the one cooldown that all share; tags are ml, anomaly and the method."""
    hits = found.where("is_anomaly").withColumn("rule_id", F.lit("ml-anomaly"))
    fired = cooldown_fold(hits, ["rule_id"], "window_start", gap)
    return hits.join(fired, (hits.window_start == fired.fired_at) & (hits.rule_id == fired.rule_id), "left_semi").withColumn("tags", F.array(F.lit("ml"), F.lit("anomaly"), F.col("method")))


def moments(windows: DataFrame, pane: int) -> DataFrame:
    """Count, mean and squares around the mean of each feature over the non-empty windows of a pane: pane, position, feature, n, mean, m2.

    A row for each pane and feature, which can be stored: later panes are added without reading earlier windows.
    """
    active = long_form(windows.where("total_events > 0")).withColumn("pane", F.floor(F.col("window_start") / pane) * pane)
    return active.groupBy("pane", "position", "feature").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("*")).alias("m2"))


def merged(panes: DataFrame, *keys: str) -> DataFrame:
    """The moments of several panes as those of one, for each of the keys: the squares around the common mean are those
    around each pane's plus n times the square of how far its mean is from it."""
    both = panes.groupBy(*keys).agg(F.collect_list(F.struct("n", "mean", "m2")).alias("p"))
    total = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    mean = F.aggregate("p", F.lit(0.0), lambda a, x: a + x["n"] * x["mean"]) / F.col("n")
    m2 = F.aggregate("p", F.lit(0.0), lambda a, x: a + x["m2"] + x["n"] * (x["mean"] - F.col("mean")) * (x["mean"] - F.col("mean")))
    return both.withColumn("n", total).withColumn("mean", mean).withColumn("m2", m2).drop("p")


def rolling_baseline(windows: DataFrame, every: int = 6 * 3600, span: int = 24 * 3600) -> DataFrame:
    """fit_at, feature, mean, std and n of the non-empty windows of the last span before every fit_at, a multiple of every.

    Windows are reduced to the moments of panes of every seconds; only these, span / every rows for each fit and feature,
    are merged.
    """
    if span % every:
        raise ValueError("the span is no multiple of the time between fits")
    return baselines(moments(windows, every), every, span)


def baselines(panes: DataFrame, every: int = 6 * 3600, span: int = 24 * 3600) -> DataFrame:
    """rolling_baseline from moments of panes of every seconds, as stored ones."""
    dealt = panes.withColumn("fit_at", F.explode(F.sequence(F.col("pane") + every, F.col("pane") + span, F.lit(every).cast("long"))))
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("m2")) / F.col("n"))
    return merged(dealt, "fit_at", "position", "feature").select("fit_at", "position", "feature", "n", "mean", F.when(std == 0, STD_FLOOR).otherwise(std).alias("std"))


def save_baseline(baseline: DataFrame, path: str, fitted_at: int) -> None:
    """Append a version; the forest isn't kept, so what is loaded scores by z alone."""
    baseline.withColumn("fitted_at", F.lit(fitted_at).cast("long")).write.mode("append").parquet(path)


def load_baseline(spark, path: str) -> DataFrame:
    """The latest version."""
    all_ = spark.read.parquet(path)
    return all_.withColumn("latest", F.max("fitted_at").over(Window.partitionBy("feature"))).where("fitted_at = latest").drop("latest", "fitted_at")
