"""Text logs as tables and streams of lines, the source registry, and the ignore filter."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: name, type, path and ignore patterns of each source; enabled is true unless it says otherwise.
SOURCES = [
    {"name": "auth", "type": "syslog", "path": "/var/log/auth.log", "ignore": []},
    {"name": "nginx_access", "type": "nginx_access", "path": "/var/log/nginx/access.log", "ignore": []},
    {"name": "syslog", "type": "syslog", "path": "/var/log/syslog", "ignore": [r"\bcasaos\b"]},
]


def load_sources(config: list[dict], paths: list[str] | None = None) -> list[dict]:
    """Enabled sources; paths replace theirs only if there is one for each."""
    kept = [s for s in config if s.get("enabled", True)]
    return [s | {"path": p} for s, p in zip(kept, paths, strict=True)] if paths and len(paths) == len(kept) else kept


def tidy(df: DataFrame) -> DataFrame:
    """Without blank lines and trailing carriage returns."""
    return df.withColumn("value", F.regexp_replace("value", "\r$", "")).where(F.trim("value") != "")


def read_text(spark: SparkSession, source: dict, stream: bool = False, since: Column | None = None) -> DataFrame:
    """value and source of every line of a text log; bytes that aren't UTF-8 become U+FFFD.

    stream: files as they arrive, each once by the checkpoint, from the first file on. With since only files changed at
    that time or later are read, so a stream that starts at the present leaves out what is there already.
    """
    reader = spark.readStream if stream else spark.read
    lines = reader.text(source["path"])
    if since is not None:
        lines = lines.where(F.col("_metadata.file_modification_time") >= since)
    return tidy(lines).withColumn("source", F.lit(source["name"]))


def read_sources(spark: SparkSession, sources: list[dict]) -> DataFrame:
    out = None
    for s in load_sources(sources):
        one = read_text(spark, s)
        out = one if out is None else out.unionByName(one)
    return out


def ignored(sources: list[dict]) -> Column:
    """Whether one of its source's patterns is found in the raw line."""
    out = F.lit(False)
    for s in sources:
        if s.get("ignore"):
            out = F.when(F.col("source") == s["name"], F.col("value").rlike("|".join(f"(?:{p})" for p in s["ignore"] if re.compile(p)))).otherwise(out)
    return out


def not_ignored(lines: DataFrame, sources: list[dict]) -> DataFrame:
    return lines.where(~ignored(sources))


def accounting(lines: DataFrame, parsed: DataFrame, sources: list[dict]) -> DataFrame:
    """Per source the lines ignored, parsed and unparsed, so that nothing is dropped silently.

    parsed has an event for each line that isn't ignored and could be parsed. Only counts are shuffled.
    """
    seen = lines.groupBy("source").agg(F.count("*").alias("lm_all"), F.count_if(ignored(sources)).alias("ignored"))
    good = parsed.groupBy("source").agg(F.count("*").alias("lm_parsed"))
    done = F.coalesce("lm_parsed", F.lit(0))
    return seen.join(good, "source", "left").select("source", "ignored", done.alias("parsed"), (F.col("lm_all") - F.col("ignored") - done).alias("unparsed"))
