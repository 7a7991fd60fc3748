"""Events between parser and store: envelopes, normalising, quarantine, previews and delays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmill.operators.parse import CORE, EXTRA, INTS

ENVELOPE = ", ".join([f"`{c}` {'int' if c in INTS else 'string'}" for c in CORE] + [f"{k} {t}" for k, t in EXTRA.items()] + ["_bad string"])


def encode(events: DataFrame, collected_at: Column) -> DataFrame:
    """source, collected_at and the event as JSON text (data), nulls left out; line_id stays for reference."""
    flat = F.struct(*[F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp") if c == "timestamp" else F.col(c) for c in CORE], *[F.col(f"extra.{k}") for k in EXTRA])
    return events.select("line_id", "source", F.date_format(collected_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("collected_at"), F.to_json(flat).alias("data"))


def decode(envelopes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Events with defaults, and the envelopes whose data isn't a JSON object, which never come again.

    A missing or bad timestamp counts as now, a bad collected_at as null; source, host and event_type default to
    unknown, severity to info, message and raw to empty text. extra keeps its fields; nulls vanish when it is JSON again.
    """
    read = envelopes.withColumn("d", F.from_json("data", ENVELOPE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    poison = F.col("d").isNull() | F.col("d._bad").isNotNull() | ~F.coalesce(F.trim("data").startswith("{"), F.lit(False))
    defaults = {"host": "unknown", "event_type": "unknown", "severity": "info", "message": "", "raw": ""}
    core = [F.coalesce(F.try_to_timestamp("d.timestamp"), now).alias(c) if c == "timestamp" else F.coalesce(F.col(f"d.{c}"), F.lit(defaults[c])).alias(c) if c in defaults else F.col(f"d.{c}") for c in CORE]
    good = read.where(~poison).select("line_id", F.coalesce("source", F.lit("unknown")).alias("source"), F.try_to_timestamp("collected_at").alias("collected_at"), *core, F.struct(*[F.col(f"d.{k}") for k in EXTRA]).alias("extra"))
    return good, read.where(poison).select(*envelopes.columns)


def with_id(events: DataFrame) -> DataFrame:
    """id: a digest of source, host, raw line and line_id, equal whenever the same line is read again."""
    return events.withColumn("id", F.sha2(F.concat_ws("\x1f", "source", "host", "raw", F.col("line_id").cast("string")), 256))


def preview(events: DataFrame) -> DataFrame:
    """One short line for each event."""
    dash = lambda c: F.coalesce(F.col(c), F.lit("-"))
    return events.select("line_id", F.concat_ws(" ", "event_type", dash("src_ip"), dash("user"), F.substring("message", 1, 60)).alias("summary"))


def ingest_lag(events: DataFrame, created_at: Column) -> DataFrame:
    """Per source the mean seconds from event to collection and from collection to store, and the largest of both."""
    s = lambda c: F.unix_micros(c) / 1e6
    collect, keep = s(F.col("collected_at")) - s(F.col("timestamp")), s(created_at) - s(F.col("collected_at"))
    return events.groupBy("source").agg(F.count("*").alias("n"), F.avg(collect).alias("collect_s"), F.avg(keep).alias("store_s"), F.max(collect + keep).alias("longest_s"), F.percentile(collect, 0.5).alias("median_s"))


def lag_sketches(events: DataFrame) -> DataFrame:
    """source, day, n and sketch: the delays of a source and day from event to collection, as a KLL sketch of a few kB.

    Sketches of other days can be added to the stored ones without reading these days' events.
    """
    delay = F.unix_micros("collected_at") / 1e6 - F.unix_micros("timestamp") / 1e6
    return events.groupBy("source", F.to_date("timestamp").alias("day")).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(delay).alias("sketch"))


def lag_quantiles(sketches: DataFrame, ranks: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Per source the number of delays that can be told and their quantiles (rank error about 1.3 %), from the sketches alone."""
    both = sketches.groupBy("source").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return both.select("source", "n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(r)).alias(f"p{round(100 * r)}") for r in ranks])


def write_events(events: DataFrame, path: str) -> None:
    """Append to the event table, a folder for each date; a date with many rows is split over tasks and files, small ones share a task."""
    events.withColumn("event_date", F.to_date("timestamp")).hint("rebalance", "event_date").sortWithinPartitions("timestamp").write.mode("append").partitionBy("event_date").parquet(path)
