"""Feature vectors of time windows, all features in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = ("total_events", "unique_src_ips", "unique_dst_ports", "unique_event_types", "auth_failures", "auth_successes", "auth_failure_ratio", "suspicious_requests", "http_4xx_count", "firewall_blocks", "sudo_count")


#: Features that count the distinct values of a column.
DISTINCT = {"unique_src_ips": "src_ip", "unique_dst_ports": "dst_port", "unique_event_types": "event_type"}


def counts() -> dict[str, Column]:
    """The features that count events."""
    kind, status = F.col("event_type"), F.col("extra.http_status")
    return {
        "total_events": F.count("*"), "auth_failures": F.count_if(kind == "auth_failure"), "auth_successes": F.count_if(kind == "auth_success"),
        "suspicious_requests": F.count_if(F.col("extra.is_suspicious")), "http_4xx_count": F.count_if((kind == "http_request") & status.between(400, 499)),
        "firewall_blocks": F.count_if(kind == "firewall_block"), "sudo_count": F.count_if(kind == "sudo_command"),
    }


def aggregates() -> list[Column]:
    return [c.alias(n) for n, c in counts().items()] + [F.count_distinct(c).alias(n) for n, c in DISTINCT.items()]


def with_ratio(df: DataFrame) -> DataFrame:
    f, s = F.col("auth_failures"), F.col("auth_successes")
    return df.withColumn("auth_failure_ratio", F.bround(F.coalesce(F.try_divide(f, f + s), F.lit(0.0)), 4))


def tumbling(events: DataFrame, anchor: Column, minutes: int = 10) -> DataFrame:
    """window_start (seconds) and features of windows [start, start + minutes) that line up with anchor; empty windows are missing."""
    n, at = minutes * 60, F.unix_timestamp(anchor)
    start = at + F.floor((F.unix_timestamp("timestamp") - at) / n) * n
    return with_ratio(events.groupBy(start.alias("window_start")).agg(*aggregates())).select("window_start", *FEATURES)


def series(events: DataFrame, as_of: Column, hours: int = 24, minutes: int = 10) -> DataFrame:
    """All windows from hours before as_of on, empty ones as zeros; the last may pass as_of."""
    n, start = minutes * 60, F.unix_timestamp(as_of) - hours * 3600
    frame = events.sparkSession.range(1).select(F.explode(F.sequence(start, F.unix_timestamp(as_of) - 1, F.lit(n).cast("long"))).alias("window_start"))
    lo, hi = start, start + -(-hours * 3600 // n) * n
    ts = F.unix_timestamp("timestamp")
    return frame.join(tumbling(events.where((ts >= lo) & (ts < hi)), as_of - F.expr(f"interval {hours} hours"), minutes), "window_start", "left").fillna(0)


def sliding(events: DataFrame, minutes: int = 10, slide: int = 1) -> DataFrame:
    """Trailing windows, one starting every slide minutes."""
    w = F.window("timestamp", f"{minutes} minutes", f"{slide} minutes")
    return with_ratio(events.groupBy(w.alias("w")).agg(*aggregates())).select(F.unix_timestamp("w.start").alias("window_start"), *FEATURES)


def vector() -> Column:
    """The features in their fixed order."""
    return F.array(*[F.col(f).cast("double") for f in FEATURES])
