"""Streams: ingest and its accounting, continuous threshold counts, stateful cooldown, features, duplicate delivery and the outbox.

Every query here runs what has arrived (availableNow) with a checkpoint; with another trigger it runs on. Late rows are
those over LATE behind the newest one of the batches before.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from logmill.operators.features import DISTINCT, FEATURES, counts, with_ratio
from logmill.operators.parse import parse_lines, parser_for
from logmill.operators.rules import compare, problem_of, rule_table
from logmill.sources.lines import ignored, not_ignored

LATE = "1 hour"
ACCOUNTS = "source string, ignored long, parsed long, unparsed long"
#: State on executors' disks, which grows beyond memory and has timers.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def read_stream(spark: SparkSession, path: str, per_batch: int | None = None) -> DataFrame:
    """Rows of the Parquet files at path, as they arrive; the schema is that of the files there now.

    All files that are there are one batch. With per_batch a batch has so many files at most; rows of later batches that
    are over LATE behind earlier ones are late then, so give it only where files arrive in the order of their time.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader if per_batch is None else reader.option("maxFilesPerTrigger", per_batch)).parquet(path)


def run(df: DataFrame, place: str, trigger: dict | None = None) -> DataFrame:
    """Write the stream to a table at place, exactly once, and return the table when it has caught up.

    A query that starts here keeps its state in RocksDB, unless the session names another provider itself.
    """
    spark = df.sparkSession
    own = {k: v for k, v in ROCKSDB.items() if spark.conf.get(k, None) in (None, "", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        query = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{place}/checkpoint").option("path", f"{place}/table").trigger(**(trigger or {"availableNow": True})).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{place}/table")


def threshold_counts(tagged: DataFrame, span: str, slide: str, over: int) -> DataFrame:
    """Windows in which a group (rule_id, group_value) has more events than the threshold, once they are closed."""
    w = F.window("timestamp", span, slide)
    return tagged.withWatermark("timestamp", LATE).groupBy(w.alias("w"), "rule_id", "group_value").agg(F.count("*").alias("count")).where(F.col("count") > over).select(F.unix_timestamp("w.start").alias("window_start"), "rule_id", "group_value", "count")


def rule_counts(hits: DataFrame, rules: list, pane: int | None = None) -> DataFrame:
    """Of hits (rule_id, group_value, timestamp) the closed windows in which a group is over its rule's threshold.

    Every rule has its own timeframe, operator and threshold. Hits are counted once, in panes of pane seconds (the
    greatest common divisor of the timeframes); a window ends with every pane and has the panes of its rule's timeframe.
    Windows of the longest timeframe are laid over the panes, and those that began before a rule's own timeframe are left
    out before the counts are added. Windows without a hit don't appear. window_start and window_end are seconds.
    """
    usable = [r for r in rules if not problem_of(r) and r.seconds > 0]
    pane = pane or gcd(*[r.seconds for r in usable])
    if any(r.seconds % pane for r in usable):
        raise ValueError("a timeframe is no multiple of the pane")
    table = rule_table(hits.sparkSession, usable).select("rule_id", "timeframe_s", "op", "n")  # a row for each rule
    panes = hits.withWatermark("timestamp", LATE).groupBy(F.window("timestamp", f"{pane} seconds").alias("w"), "rule_id", "group_value").agg(F.count("*").alias("c"))
    longest = max([r.seconds for r in usable], default=pane)
    laid = panes.join(F.broadcast(table), "rule_id").withColumns({"lm_pane": F.unix_timestamp("w.start")}).withColumn("lm_w", F.window("w", f"{longest} seconds", f"{pane} seconds"))
    own = laid.where(F.col("lm_pane") >= F.unix_timestamp("lm_w.end") - F.col("timeframe_s"))
    found = own.groupBy("lm_w", "rule_id", "group_value").agg(F.sum("c").alias("count"), F.first("timeframe_s").alias("timeframe_s"), F.first("op").alias("op"), F.first("n").alias("n"))
    end = F.unix_timestamp("lm_w.end")
    return found.where(compare(F.col("count"), F.col("op"), F.col("n"))).select((end - F.col("timeframe_s")).alias("window_start"), end.alias("window_end"), "rule_id", "group_value", "count")


class Cooldown(StatefulProcessor):
    """Of a key's times those that fire; the last one that fired is its state, until its cooldown is over for good."""

    LAST = StructType([StructField("last", LongType())])

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", self.LAST)

    def over(self, last: int) -> int:
        """When (milliseconds) no hit that is still to come can fall into the cooldown of one that fired at last."""
        return (last + self.gap + 1) * 1000

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self.last.get()[0] if self.last.exists() else None
        last, fired = before, []
        for at in sorted({int(t) for pdf in rows for t in pdf["at"]}):
            if last is None or at > last + self.gap:
                fired.append(at)
                last = at
        if last != before:
            if before is not None:
                self.handle.deleteTimer(self.over(before))
            self.handle.registerTimer(self.over(last))
            self.last.update((last,))
        if fired:
            yield pd.DataFrame({"rule_id": [key[0]] * len(fired), "group_value": [key[1]] * len(fired), "missing": [key[2]] * len(fired), "fired_at": fired})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def cooldown(hits: DataFrame, gap: int) -> DataFrame:
    """Of hits (rule_id, group_value, timestamp) those that fire: the first of a key, then each over gap seconds after the last that fired.

    The state of a key is one number, and a timer removes it when the watermark has passed its cooldown, so a key that
    comes no more takes no room. Hits are put in order within a batch; one that arrives in a later batch but isn't late is
    judged when it arrives, and late ones are dropped. Needs a state store with timers (RocksDB, which run sets).
    """
    key, text = ("rule_id", "group_value", "missing"), F.lit("")
    missing = F.col("rule_id").isNull().cast("int") + 2 * F.col("group_value").isNull().cast("int")  # null keys would come row by row
    keyed = hits.where("timestamp is not null").withWatermark("timestamp", LATE).select("timestamp", F.coalesce("rule_id", text).alias("rule_id"), F.coalesce("group_value", text).alias("group_value"), missing.alias("missing"), F.unix_timestamp("timestamp").alias("at"))
    fired = keyed.groupBy(*key).transformWithStateInPandas(Cooldown(gap), "rule_id string, group_value string, missing int, fired_at long", "append", "EventTime")
    return fired.select(*[F.when(F.col("missing").bitwiseAND(bit) == 0, F.col(c)).alias(c) for c, bit in (("rule_id", 1), ("group_value", 2))], "fired_at")


def features(events: DataFrame, span: str = "10 minutes") -> DataFrame:
    """Features of closed windows, by two aggregations, since streams have no distinct counts.

    The first has a state row for each window, counted column and value; the second counts those rows when the window
    closes, so no state row grows with its window. Events are counted with their event_type.
    """
    values = F.array(*[F.struct(F.lit(n).alias("lm_name"), F.col(c).cast("string").alias("lm_value")) for n, c in DISTINCT.items()])
    each = events.withWatermark("timestamp", LATE).withColumn("lm_x", F.explode(values))
    once = F.col("lm_x.lm_name") == "unique_event_types"
    first = each.groupBy(F.window("timestamp", span).alias("lm_w"), once.alias("lm_once"), "lm_x.lm_name", "lm_x.lm_value").agg(*[c.alias(n) for n, c in counts().items()])
    sums = [F.coalesce(F.sum(F.when(F.col("lm_once"), F.col(n))), F.lit(0)).cast("long").alias(n) for n in counts()]
    distinct = [F.count_if((F.col("lm_name") == n) & F.col("lm_value").isNotNull()).alias(n) for n in DISTINCT]
    closed = first.groupBy(F.window("lm_w", span).alias("w")).agg(*sums, *distinct)
    return with_ratio(closed).select(F.unix_timestamp("w.start").alias("window_start"), *FEATURES)


def deduplicated(events: DataFrame, key: str = "line_id") -> DataFrame:
    """Events once, though a delivery may repeat within the watermark."""
    return events.withWatermark("timestamp", LATE).dropDuplicatesWithinWatermark([key])


def outbox(alerts: DataFrame, place: str, at: Column | None = None) -> DataFrame:
    """Alerts of a stream as outbox rows, one for each id, whichever batch brings it first.

    at: the time of an alert, by whose date the outbox is partitioned; ids of a batch are looked up in the dates that the
    batch has only (in one part if it's missing). An id must keep its date. A batch that runs again writes its own folder
    again, and doesn't count what it has written before as there already.
    """
    day = F.date_format(at, "yyyy-MM-dd") if at is not None else F.lit("all")
    spark, table = alerts.sparkSession, f"{place}/outbox"
    schema = StructType([*alerts.schema.fields, *spark.range(0).select(F.lit("").alias("day"), F.lit(0).cast("long").alias("batch")).schema.fields])

    def append(df: DataFrame, batch: int) -> None:
        own = df.dropDuplicates(["id"]).withColumns({"day": F.coalesce(day, F.lit("none")), "batch": F.lit(batch).cast("long")}).persist()
        days = [r[0] for r in own.select("day").distinct().collect()]  # the dates of a batch
        there = spark.read.schema(schema).parquet(table).where(F.col("day").isin(days) & (F.col("batch") != batch)).select("id")
        own.join(there, "id", "left_anti").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(table)
        own.unpersist()

    spark.createDataFrame([], schema).write.mode("append").partitionBy("day", "batch").parquet(table)  # so that there is a table
    query = alerts.writeStream.foreachBatch(append).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(table).select(*alerts.columns)


def ingest(lines: DataFrame, sources: list[dict], now: Column, place: str) -> DataFrame:
    """Parse a stream of lines (value, source) into a table of events, and account for every line of each batch.

    What happens to the lines of a source is observed in the one pass that parses and writes them: how many came, how many
    were ignored, how many became events. A batch that runs again after a failure writes its folders again, so events and
    counts stay those of one run. Returns the accounting: batch, source, ignored, parsed and unparsed; the events are at
    place/events. Sources that are disabled or of an unknown type are read by nobody and not accounted for.
    """
    spark, own = lines.sparkSession, [s for s in sources if s.get("enabled", True) and parser_for(s["type"], s["name"])]

    def store(df: DataFrame, batch: int) -> None:
        seen, events = [(Observation(), Observation()) for _ in own], None
        for s, (came, went) in zip(own, seen, strict=True):
            one = df.where(F.col("source") == s["name"]).observe(came, F.count("*").alias("n"), F.count_if(ignored([s])).alias("ignored"))
            part = parse_lines(not_ignored(one, [s]), [s], now).observe(went, F.count("*").alias("n"))
            events = part if events is None else events.unionByName(part)
        events.write.mode("overwrite").parquet(f"{place}/events/batch={batch}")
        rows = [(s["name"], came.get["ignored"], went.get["n"], came.get["n"] - came.get["ignored"] - went.get["n"]) for s, (came, went) in zip(own, seen, strict=True)]
        spark.createDataFrame(rows, ACCOUNTS).coalesce(1).write.mode("overwrite").parquet(f"{place}/accounting/batch={batch}")

    query = lines.writeStream.foreachBatch(store).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(f"{ACCOUNTS}, batch long").parquet(f"{place}/accounting")
