"""Dashboard queries over events and alerts, status changes and retention. Every time bound is given, none is read from a clock."""

from __future__ import annotations

from datetime import datetime, time, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmill.session import shared_dir

STATUSES = ("new", "acknowledged", "resolved", "false_positive")


def equal(df: DataFrame, **values) -> DataFrame:
    """Rows with these values; None and empty text don't filter."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), ((k, v) for k, v in values.items() if v not in (None, "")), df)


def search(df: DataFrame, text: str, columns=("raw", "message", "user", "src_ip")) -> DataFrame:
    """Rows with the text in one of the columns, whatever the case."""
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.lower(c).contains(text.lower()), F.lit(False)) for c in columns])
    return df.where(hit)


def since(df: DataFrame, as_of: Column, hours, column: str = "timestamp") -> DataFrame:
    """Rows of the last hours; what isn't a whole number doesn't filter."""
    try:
        return df.where(F.col(column) >= as_of - F.expr(f"interval {int(hours)} hours"))
    except (TypeError, ValueError):
        return df


def page(df: DataFrame, number: int = 1, size: int = 50, column: str = "timestamp", tie: str = "id") -> DataFrame:
    """Newest first, a page at a time."""
    return df.orderBy(F.desc(column), tie).offset(size * (number - 1)).limit(size)


def range_counts(df: DataFrame, by: str = "event_date") -> DataFrame:
    """Rows of each range of time, a row for each value of by; for a stored table they can be kept beside it."""
    return df.groupBy(by).agg(F.count("*").alias("n"))


def deep_page(df: DataFrame, counts: DataFrame, number: int, size: int = 50, by: str = "event_date", column: str = "timestamp", tie: str = "id") -> DataFrame:
    """The page that page gives, however deep, from the ranges alone that hold it.

    by must grow with column, as the date folders of an event table do; rows without it come last. The counts of the
    ranges (some bytes for each date) tell where the page lies, so other dates aren't read and only these are sorted.
    """
    skip, held, left = size * (number - 1), [], size
    for r in sorted(counts.collect(), key=lambda r: (r[by] is not None, r[by] or 0), reverse=True):
        if not held and skip >= r["n"]:
            skip -= r["n"]
            continue
        held.append(r[by])
        left -= r["n"] - (skip if len(held) == 1 else 0)
        if left <= 0:
            break
    own = df.where(F.col(by).isin([h for h in held if h is not None]) | (F.col(by).isNull() if None in held else F.lit(False)))
    return own.orderBy(F.desc(column), tie).offset(skip).limit(size)


def top(df: DataFrame, key: str, k: int = 5) -> DataFrame:
    """The k most frequent values, ties by value; null doesn't count."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("count")).orderBy(F.desc("count"), key).limit(k)


def distribution(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("count"))


def totals(events: DataFrame, alerts: DataFrame, as_of: Column) -> DataFrame:
    """One row of counts: events, events of the last hour, alerts, new ones, new ones that are high or critical."""
    e = events.agg(F.count("*").alias("events"), F.count_if(F.col("timestamp") >= as_of - F.expr("interval 1 hour")).alias("events_last_hour"))
    new = F.col("status") == "new"
    return e.join(F.broadcast(alerts.agg(F.count("*").alias("alerts"), F.count_if(new).alias("new_alerts"), F.count_if(new & F.col("severity").isin("high", "critical")).alias("urgent_alerts"))))


def listing(alerts: DataFrame, bridge: DataFrame) -> DataFrame:
    """Alerts with event_count and has_analysis instead of the analysis."""
    n = bridge.groupBy(F.col("alert_id").alias("id")).agg(F.count("*").alias("event_count"))
    return alerts.join(n, "id", "left").withColumns({"event_count": F.coalesce("event_count", F.lit(0)), "has_analysis": F.coalesce(F.col("llm_analysis") != "", F.lit(False))}).drop("llm_analysis")


def events_of(alert_ids: DataFrame, bridge: DataFrame, events: DataFrame) -> DataFrame:
    """Events of the alerts (alert_id), each with its alert."""
    return events.join(bridge.join(alert_ids, "alert_id").select("alert_id", F.col("event_id").alias("line_id")), "line_id")


def upsert_status(alerts: DataFrame, updates: DataFrame, order: str | None = None) -> DataFrame:
    """A new snapshot with the updates (id, status) of allowed status applied; nothing else changes.

    Of several updates of an id the last by the column order counts (null is first, ties go by status); without one they
    have no order, and the alphabetically last counts.
    """
    latest = F.max(F.struct(*([order] if order else []), F.col("status").alias("lm_u")))["lm_u"]
    u = updates.where(F.col("status").isin(*STATUSES)).groupBy("id").agg(latest.alias("u"))
    return alerts.join(u, "id", "left").withColumn("status", F.coalesce("u", "status")).drop("u")


def facets(df: DataFrame, names: list[str]) -> DataFrame:
    """facet, value and count of all values of some columns in one pass."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("facet"), F.col(n).cast("string").alias("value")) for n in names])).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("count"))


def retained(events: DataFrame, alerts: DataFrame, bridge: DataFrame, as_of: Column, event_days: int = 90, alert_days: int = 365, link_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """Events and alerts that stay: young alerts, young events, and old events that an alert that stays still needs.

    link_first: events linked to any alert stay, as when nothing has been deleted yet (the dry run's count).
    """
    stay = alerts.where(F.col("created_at") >= as_of - F.expr(f"interval {alert_days} days"))
    links = bridge if link_first else bridge.join(stay.select(F.col("id").alias("alert_id")), "alert_id", "left_semi")
    needed = links.select(F.col("event_id").alias("line_id"), F.lit(True).alias("lm_needed")).distinct()
    kept = events.join(needed, "line_id", "left").where((F.col("timestamp") >= as_of - F.expr(f"interval {event_days} days")) | F.col("lm_needed")).drop("lm_needed")
    return kept, stay


def dry_run(events: DataFrame, alerts: DataFrame, bridge: DataFrame, as_of: Column, event_days: int = 90, alert_days: int = 365) -> DataFrame:
    """One row: how many alerts and events would go."""
    kept, stay = retained(events, alerts, bridge, as_of, event_days, alert_days, link_first=True)
    one = lambda df, name: df.agg(F.count("*").alias(name))
    e, k, a, s = one(events, "e"), one(kept, "k"), one(alerts, "a"), one(stay, "s")
    return e.join(F.broadcast(k)).join(F.broadcast(a)).join(F.broadcast(s)).select((F.col("a") - F.col("s")).alias("alerts_to_delete"), (F.col("e") - F.col("k")).alias("events_to_delete"))


def prune_in_place(events_path: str, alerts: DataFrame, links: DataFrame, as_of: datetime, event_days: int = 90, alert_days: int = 365) -> tuple[DataFrame, DataFrame]:
    """Prune the event table at events_path (folders event_date=...) as retained does; returns what was done to each old
    date (event_date, action, kept) and the alerts that stay.

    Dates that are young aren't read, and their files stay. Of old dates only ids of events that an alert that stays still
    needs are looked for, and with a column event_date in links (alert_id, event_id) only in dates that have any: other
    dates go as folders, unread. What stays of a date is stored in the shared folder first and then replaces that date
    alone (dynamic partition overwrite), so a run that fails can be run again, or what it was writing be taken from there.
    Events without a timestamp stay. The cutoff's own date keeps its young events.
    """
    spark = alerts.sparkSession
    cutoff, oldest = (as_of - timedelta(days=d) for d in (event_days, alert_days))
    stay = alerts.where(F.col("created_at") >= F.lit(oldest))
    needed = links.join(stay.select(F.col("id").alias("alert_id")), "alert_id", "left_semi")
    path = spark._jvm.org.apache.hadoop.fs.Path(events_path)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = {s.getPath().getName().removeprefix("event_date="): s.getPath() for s in files.listStatus(path) if s.getPath().getName().startswith("event_date=2") or s.getPath().getName().startswith("event_date=1")}
    last = cutoff.date().isoformat()
    old = sorted(d for d in folders if d < last or d == last and cutoff.time() != time())
    held = [str(r[0]) for r in needed.select("event_date").distinct().collect()] if "event_date" in links.columns else old  # dates only
    part = spark.read.parquet(events_path).where(F.col("event_date").cast("string").isin([d for d in old if d in held or d == last]))
    kept = part.where(F.col("timestamp") >= F.lit(cutoff)).unionByName(part.where(F.col("timestamp") < F.lit(cutoff)).join(needed.select(F.col("event_id").alias("line_id")).distinct(), "line_id", "left_semi").select(*part.columns))
    place = f"{shared_dir(spark)}/kept"
    kept.write.partitionBy("event_date").parquet(place)
    rows = spark.read.schema(part.schema).parquet(place)
    counts = {str(r[0]): r[1] for r in rows.groupBy("event_date").count().collect()}  # a row for each old date
    if counts:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(events_path)
    for d in old:
        if d not in counts:
            files.delete(folders[d], True)
    done = [(d, "rewritten" if d in counts else "dropped", counts.get(d, 0)) for d in old]
    return spark.createDataFrame(done, "event_date string, action string, kept long"), stay


def active_days(events: DataFrame) -> DataFrame:
    """src_ip, month (its first day) and days: a bit for each day of the month on which the address was seen.

    A row of a few bytes for each address and month, which can be stored; rows of later days are added to it.
    """
    day = F.to_date("timestamp")
    return events.where("src_ip is not null and timestamp is not null").groupBy("src_ip", F.trunc(day, "month").alias("month")).agg(F.bit_or(F.expr("shiftleft(1, day(timestamp) - 1)")).alias("days"))


def persistence_of(days: DataFrame, levels=(3, 25)) -> DataFrame:
    """The row that persistence gives, from stored active_days alone, several rows of an address and month merged."""
    months = days.groupBy("src_ip", "month").agg(F.bit_or("days").alias("days"))
    own = months.groupBy("src_ip").agg(F.sum(F.bit_count("days")).alias("d"))
    return own.agg(F.count("*").alias("addresses"), *[F.count_if(F.col("d") >= n).alias(f"at_least_{n}_days") for n in levels])


def persistence(events: DataFrame, levels=(3, 25)) -> DataFrame:
    """One row: addresses seen, and how many of them on at least so many days."""
    days = events.where("src_ip is not null").groupBy("src_ip").agg(F.count_distinct(F.to_date("timestamp")).alias("d"))
    return days.agg(F.count("*").alias("addresses"), *[F.count_if(F.col("d") >= n).alias(f"at_least_{n}_days") for n in levels])


def backtest(features: DataFrame, votes: DataFrame, policies: DataFrame) -> DataFrame:
    """Alerts that survive each policy (policy, z_threshold, floor, agree), a small table, over scored feature rows."""
    windows = features.groupBy("window_start").agg(F.collect_list(F.struct("value", "mean", "z")).alias("f")).join(votes, "window_start")
    flagged = F.exists("f", lambda x: (F.abs(x["z"]) > F.col("z_threshold")) & (F.abs(x["value"] - x["mean"]) > F.when(F.col("floor") > 0, F.greatest(F.lit(1.0), F.abs(x["mean"]) * F.col("floor"))).otherwise(F.lit(-1.0))))
    alarm = F.when(F.col("agree"), flagged & F.col("forest_vote")).otherwise(flagged | F.col("forest_vote"))
    return windows.join(F.broadcast(policies)).groupBy("policy").agg(F.count_if(alarm).alias("alerts"))
