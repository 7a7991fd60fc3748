"""What is kept and added to: pruning where events lie, day bits, moments, sketches; and numbers as text."""

import os
import random
import statistics
from datetime import UTC, date, datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from logmill.operators import anomaly, briefs, views
from logmill.operators import events as ev
from logmill.operators.features import FEATURES

NOW = datetime(2026, 6, 10, 12, tzinfo=UTC)
EVENT = "line_id long, timestamp timestamp, src_ip string"


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_prune_in_place(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, NOW - timedelta(hours=rng.randrange(24 * 20)), "1.2.3.4") for i in range(400)] + [(1000, None, "x"), (1001, NOW - timedelta(days=5), "on the cutoff"), (1002, NOW - timedelta(days=5, microseconds=1), "just before")]
    events = spark.createDataFrame(rows, EVENT)
    alerts = spark.createDataFrame([("young", NOW - timedelta(days=6)), ("old", NOW - timedelta(days=40))], "id string, created_at timestamp")
    # ids of an old date that a young alert needs, of another one that only an old alert needs, and ids of no event
    by_day = {}
    for i, at, _ in rows:
        if at and at < NOW - timedelta(days=7):
            by_day.setdefault(at.date(), []).append(i)
    kept_day, lost_day = sorted(by_day)[2:4]
    links = [("young", by_day[kept_day][0]), ("young", by_day[kept_day][0]), ("old", by_day[lost_day][0]), ("young", 99_999), ("none", by_day[lost_day][1])]
    day_of = {i: at.date() for i, at, _ in rows if at}
    for with_date in (True, False):
        path = str(tmp_path / f"events-{with_date}")
        ev.write_events(events, path)
        before = files(path)
        bridge = spark.createDataFrame([(*x, day_of.get(x[1], date(1999, 1, 1))) for x in links], "alert_id string, event_id long, event_date date")
        done, stay = views.prune_in_place(path, alerts, bridge if with_date else bridge.drop("event_date"), NOW, 5, 30)
        want = views.retained(events, alerts, bridge, F.lit(NOW), 5, 30)[0]
        want = sorted(r.line_id for r in want.union(events.where("timestamp is null")).distinct().collect())
        assert sorted(r.line_id for r in spark.read.parquet(path).collect()) == want and {1000, 1001} < set(want) and 1002 not in want
        after, cutoff = files(path), str((NOW - timedelta(days=5)).date())
        young = {f for f in before if f.split("=")[1][:10] > cutoff}
        assert young and all(after[f] == before[f] for f in young)
        actions = {r.event_date: (r.action, r.kept) for r in done.collect()}
        assert actions[str(kept_day)] == ("rewritten", 1) and actions[str(lost_day)] == ("dropped", 0) and actions[cutoff][0] == "rewritten"
        assert not os.path.exists(f"{path}/event_date={lost_day}") and [r.id for r in stay.collect()] == ["young"]
        again = views.prune_in_place(path, alerts, bridge, NOW, 5, 30)[0].collect()
        assert {r.event_date for r in again} == {str(kept_day), cutoff} and sorted(r.line_id for r in spark.read.parquet(path).collect()) == want
    gone = alerts.limit(0)
    views.prune_in_place(path, gone, bridge, NOW + timedelta(days=60), 5, 30)
    assert [r.line_id for r in spark.read.parquet(path).collect()] == [1000]


def test_active_days(spark):
    rng = random.Random(4)
    rows = [(i, NOW - timedelta(days=rng.randrange(70)), rng.choice(["a", "b", None])) for i in range(90)] + [(0, NOW, "c"), (0, NOW, "c"), (0, None, "d"), (1, datetime(2026, 5, 31, tzinfo=UTC), "c"), (1, datetime(2026, 5, 1, tzinfo=UTC), "c")]
    events = spark.createDataFrame(rows, EVENT)
    bits = views.active_days(events.where("line_id % 2 = 0")).unionByName(views.active_days(events.where("line_id % 2 = 1"))).unionByName(views.active_days(events))
    want = views.persistence(events.where("timestamp is not null"), (1, 3, 20)).collect()
    assert views.persistence_of(bits, (1, 3, 20)).collect() == want and want[0].addresses == 3


def windows(spark, values):
    return spark.createDataFrame([(t, *[v if f == "total_events" else v * 1e6 + 0.5 for f in FEATURES]) for t, v in values], "window_start long, " + ", ".join(f"{f} double" for f in FEATURES))


def test_moments_merge(spark):
    rng = random.Random(7)
    values = [(t, float(rng.choice([0, rng.randrange(1, 50)]))) for t in range(-3600, 40 * 3600, 600)]
    got = anomaly.rolling_baseline(windows(spark, values), 6 * 3600, 24 * 3600).where("feature = 'sudo_count'").collect()
    assert len(got) > 8
    for r in got:
        own = [v * 1e6 + 0.5 for t, v in values if v > 0 and r.fit_at - 24 * 3600 <= t < r.fit_at]
        assert r.n == len(own) and abs(r.mean - statistics.fmean(own)) < 1e-9 * r.mean and abs(r["std"] - (statistics.pstdev(own) or 0.001)) < 1e-9 * max(1, r["std"])
    halves = [anomaly.moments(windows(spark, values[i::2]), 3600) for i in (0, 1)]
    both = anomaly.merged(halves[0].unionByName(halves[1]), "pane", "feature")
    whole = anomaly.moments(windows(spark, values), 3600)
    pairs = both.join(whole, ["pane", "feature"]).select(both.n == whole.n, F.abs(both.mean - whole.mean) <= 1e-9 * whole.mean, F.abs(both.m2 - whole.m2) <= 1e-9 * (whole.m2 + 1)).collect()
    assert len(pairs) == whole.count() and all(all(r) for r in pairs)
    assert {r["std"] for r in anomaly.rolling_baseline(windows(spark, [(0, 4.0)])).collect()} == {0.001}


def test_lag_sketches(spark):
    rng = random.Random(9)
    lags = [rng.expovariate(0.1) for _ in range(20_000)]
    rows = [("auth", NOW + timedelta(days=i % 3), NOW + timedelta(days=i % 3, microseconds=round(x * 1e6))) for i, x in enumerate(lags)] + [("web", NOW, NOW + timedelta(seconds=2)), ("web", NOW, None)]
    sketches = ev.lag_sketches(spark.createDataFrame(rows, "source string, timestamp timestamp, collected_at timestamp"))
    got = {r.source: r for r in ev.lag_quantiles(sketches, (0.5, 0.95)).collect()}
    assert sketches.count() == 4 and got["web"].p50 == 2.0 and got["web"].p95 == 2.0
    for q, name in ((0.5, "p50"), (0.95, "p95")):
        assert abs(sum(x <= got["auth"][name] for x in lags) / len(lags) - q) < 0.02


def test_numbers_as_text(spark):
    rng = random.Random(11)
    numbers = [0.0, 0.25, 0.75, 2.25, 2.35, 2.45, 0.15, 0.05, 0.95, 1.05, 0.3, 0.29999999999999998, 12.0, 1e7, 123456789.0, 0.0001, 0.0005, 0.6667, -2.25, -0.15, 9.95, 99.949999999999, 1e15] + [rng.randrange(4000) / 20 for _ in range(500)] + [rng.random() * 10 ** rng.randrange(6) for _ in range(500)]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", anomaly.one_place(F.col("x")).alias("one"), anomaly.shortest(F.round("x", 4)).alias("text"), F.round("x", 4).alias("r")).collect()
    assert all(r.one == f"{r.x:.1f}" for r in rows) and all(float(r.text) == r.r and "E" not in r.text for r in rows)
    assert {r.text for r in rows if r.x in (12.0, 1e7, 0.0005, 0.6667)} == {"12.0", "10000000.0", "0.0005", "0.6667"}


def test_deep_page_reads_its_dates_alone(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, None if i % 50 == 0 else NOW - timedelta(hours=rng.randrange(24 * 12)), "x") for i in range(700)]
    path = str(tmp_path / "events")
    ev.write_events(spark.createDataFrame(rows, EVENT), path)
    table = spark.read.parquet(path)
    counts = views.range_counts(table)
    for number in (1, 2, 7, 13, 14, 15):
        page = views.deep_page(table, counts, number, 50, tie="line_id")
        assert page.select("line_id").collect() == views.page(table, number, 50, tie="line_id").select("line_id").collect()
    assert len({f.rsplit("event_date=")[1][:10] for f in views.deep_page(table, counts, 7, 50, tie="line_id").inputFiles()}) <= 14
    plan = views.deep_page(table, counts, 7, 50, tie="line_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "event_date" in plan.split("PartitionFilters")[1][:200]
    assert views.deep_page(table.limit(0), counts.limit(0), 3, 50, tie="line_id").count() == 0


def test_the_last_update_counts(spark):
    alerts = spark.createDataFrame([("a", "new", "old"), ("b", "new", "old"), ("c", "new", "old")], "id string, status string, llm_analysis string")
    updates = spark.createDataFrame([("a", "resolved", 1), ("a", "acknowledged", 2), ("b", "resolved", 3), ("b", "odd", 4), ("b", "new", None)], "id string, status string, at int")
    assert sorted((r.id, r.status) for r in views.upsert_status(alerts, updates, "at").collect()) == [("a", "acknowledged"), ("b", "resolved"), ("c", "new")]
    results = spark.createDataFrame([("a", True, "z", 1), ("a", True, "y", 2), ("a", False, "x", 3)], "id string, ok boolean, text string, at int")
    assert sorted((r.id, r.llm_analysis) for r in briefs.store_analyses(alerts, results, "at").collect()) == [("a", "y"), ("b", "old"), ("c", "old")]
