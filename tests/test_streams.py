"""Stream queries over a table of many files that are in no order of time."""

import os
import random
from collections import Counter
from datetime import datetime, timezone

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from logmill import catalog
from logmill.operators import rules
from logmill.streaming import streams

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def many_files(tmp_path_factory):
    """The events in 1,200 files: 700 without a row arrive first, then 500 from the newest event to the oldest."""
    place = tmp_path_factory.mktemp("many")
    (place / "events.parquet").mkdir()
    events = pq.read_table(f"{SF}/events.parquet").sort_by([("ts", "descending")])
    per_file = -(-events.num_rows // 500)
    for i in range(1200):
        path = place / "events.parquet" / f"part-{i:05d}.parquet"
        pq.write_table(events.slice((i - 700) * per_file, per_file) if i >= 700 else events.slice(0, 0), path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(place)


@pytest.mark.parametrize("name", ["stream_rule_counts", "stream_features", "stream_dedup", "stream_cooldown"])
def test_many_files(spark, many_files, name):
    rows = lambda d: Counter(map(tuple, catalog.QUERIES[name](spark, d).collect()))
    assert rows(many_files) == rows(SF)


def arrive(spark, place, i, rows, schema):
    """Rows as the file of batch i."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(place / "out" / str(i)))
    (part,) = (place / "out" / str(i)).glob("*.parquet")
    (place / "in").mkdir(exist_ok=True)
    part.rename(place / "in" / f"{i}.parquet")
    os.utime(place / "in" / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))


def undo(place, batch):
    """The stream at place forgets that it has committed a batch."""
    (place / "checkpoint" / "commits" / str(batch)).unlink()
    (place / "checkpoint" / "commits" / f".{batch}.crc").unlink(missing_ok=True)


HIT = "timestamp timestamp, rule_id string, group_value string"


def hit(t, group, rule="r"):
    return datetime.fromtimestamp(t, timezone.utc), rule, group


def test_cooldown_state_goes_away(spark, tmp_path):
    batches = [
        [hit(t, g) for g in ("a", "b", "c", None) for t in (1, 1, 200, 302)],
        [hit(400, "a"), hit(700, "b"), hit(603, "a"), hit(10, "d")],
        [hit(50_000, "z")],
        [hit(50_100, "z"), hit(46_600, "a")],
        [hit(200_000, "y"), hit(50_301, "z"), hit(600, "late")],
        [hit(200_001, "y")],
    ]
    for i, rows in enumerate(batches):
        arrive(spark, tmp_path, i, rows, HIT)
    place, seen = tmp_path / "run", []
    hits = streams.read_stream(spark, str(tmp_path / "in"), 1)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    fired = sorted(((r.group_value or "-", r.fired_at) for r in streams.run(streams.cooldown(hits, 300), str(place)).collect()))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    want, last = [], {}
    for t, _, g in sorted({h for rows in batches for h in rows if h[2] != "late"}, key=lambda h: h[0]):
        t = int(t.timestamp())
        if g not in last or t > last[g] + 300:
            want.append((g or "-", t))
            last[g] = t
    assert fired == sorted(want)
    arrive(spark, tmp_path, len(batches), [hit(200_301, "y")], HIT)  # a restart
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", next(iter(streams.ROCKSDB.values())))
    query = streams.cooldown(streams.read_stream(spark, str(tmp_path / "in"), 1), 300).writeStream.format("parquet").option("checkpointLocation", f"{place}/checkpoint").option("path", f"{place}/table").trigger(availableNow=True).start()
    query.awaitTermination()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    seen = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert seen and max(seen) <= 2  # the value and the timer of y: all other keys are gone
    assert sorted(r.fired_at for r in spark.read.parquet(f"{place}/table").where("group_value = 'y'").collect()) == [200_000, 200_301]


def test_rules_of_several_timeframes_over_batches(spark, tmp_path):
    own = [rules.Rule(f"r{i}", "R", {"event_type": "x"}, f"selection | count(user) {op} {n}", timeframe=tf) for i, (op, n, tf) in enumerate(((">", 2, "10m"), (">=", 2, "5m"), ("<", 2, "15m"), ("<=", 2, "10m"), ("==", 3, "1h")))]
    rng = random.Random(6)
    batches = [[hit(rng.randrange(900 * k, 900 * k + 3000), rng.choice(["a", "b", None]), f"r{rng.randrange(5)}") for _ in range(60)] for k in range(6)] + [[hit(1, "late", "r0"), hit(60_000, "end", "r1")], [hit(120_000, "end", "r1")]]
    for i, rows in enumerate(batches):
        arrive(spark, tmp_path, i, rows, HIT)
    got = {(r.rule_id, r.group_value, r.window_start, r.window_end, r["count"]) for r in streams.run(streams.rule_counts(streams.read_stream(spark, str(tmp_path / "in"), 1), own), str(tmp_path / "run")).collect()}
    times, want, holds = {}, set(), {">": int.__gt__, ">=": int.__ge__, "<": int.__lt__, "<=": int.__le__, "==": int.__eq__}
    for t, rule, g in (h for rows in batches for h in rows if h[2] != "late"):
        times.setdefault((rule, g), []).append(int(t.timestamp()))
    for rule in own:
        for (r, g), ts in times.items():
            for end in range(300, 120_000 - 3600 + 1, 300) if r == rule.id else ():
                if (n := sum(end - rule.seconds <= t < end for t in ts)) and holds[rule.op](n, rule.n):
                    want.add((r, g, end - rule.seconds, end, n))
    assert got == want and {w[0] for w in want} == {r.id for r in own}
    with pytest.raises(ValueError):
        streams.rule_counts(streams.read_stream(spark, str(tmp_path / "in")), own, 7)


def test_outbox_has_each_alert_once(spark, tmp_path):
    schema = "id string, at timestamp, n int"
    day = 86_400
    at = lambda d: datetime.fromtimestamp(d * day, timezone.utc)
    batches = [[("a", at(0), 1), ("a", at(0), 1), ("b", at(1), 2)], [("a", at(0), 3), ("c", at(1), 4), ("x", None, 5)], [("b", at(1), 6), ("d", at(2), 7), ("x", None, 8)]]
    for i, rows in enumerate(batches):
        arrive(spark, tmp_path, i, rows, schema)
    place = str(tmp_path / "run")
    rows = lambda: sorted((r.id, r.n) for r in streams.outbox(streams.read_stream(spark, str(tmp_path / "in"), 1), place, F.col("at")).collect())
    want = [("a", 1), ("b", 2), ("c", 4), ("d", 7), ("x", 5)]
    assert rows() == want
    undo(tmp_path / "run", 2)  # as if the last batch had failed after it wrote
    assert rows() == want
    arrive(spark, tmp_path, 3, [("a", at(0), 9), ("e", at(0), 10)], schema)
    assert rows() == [*want[:4], ("e", 10), want[4]]


def test_accounting_over_batches_and_restarts(spark, tmp_path):
    from logmill.sources.lines import accounting

    sources = [{"name": "auth", "type": "syslog", "ignore": ["CRON"]}, {"name": "nginx_access", "type": "nginx_access"}, {"name": "off", "type": "syslog", "enabled": False}]
    rng = random.Random(8)
    line = {"auth": ["2026-01-01T00:00:00Z h sshd[1]: Failed password for root from 1.2.3.4 port 5", "2026-01-01T00:00:00Z h CRON[1]: x", "junk"], "nginx_access": ['1.2.3.4 - - [01/Jan/2026:00:00:00 +0000] "GET / HTTP/1.1" 200 5 "-" "x"', "no"], "off": ["x"]}
    files = [[(rng.choice(line[s]), s) for s in (rng.choice(list(line)) for _ in range(50))] for _ in range(5)]
    for i in range(3):
        arrive(spark, tmp_path, i, files[i], "value string, source string")
    now, place = F.to_timestamp(F.lit("2026-10-12 12:00:00")), str(tmp_path / "run")
    account = lambda: streams.ingest(streams.read_stream(spark, str(tmp_path / "in"), 1), sources, now, place)
    assert account().select("batch").distinct().count() == 3
    undo(tmp_path / "run", 2)  # its last batch runs again
    for i in (3, 4):
        arrive(spark, tmp_path, i, files[i], "value string, source string")
    got = {r.source: (r.a, r.b, r.c) for r in account().groupBy("source").agg(*[F.sum(x).alias(y) for x, y in (("ignored", "a"), ("parsed", "b"), ("unparsed", "c"))]).collect()}
    all_lines = spark.createDataFrame(sum(files, []), "value string, source string").where("source <> 'off'")
    want = accounting(all_lines, streams.parse_lines(streams.not_ignored(all_lines, sources), sources, now), sources)
    assert got == {r.source: (r.ignored, r.parsed, r.unparsed) for r in want.collect()} and all(min(v[1:]) > 0 for v in got.values())
    assert spark.read.parquet(f"{place}/events").count() == sum(v[1] for v in got.values())


def test_features_of_several_batches(spark, tmp_path):
    """Windows whose values are spread over batches, nulls, and an event that comes after its window has closed."""
    (tmp_path / "in").mkdir()
    row = lambda t, kind, ip, port=None: (datetime.fromtimestamp(t, timezone.utc), kind, ip, port, None, None)
    batches = [
        [row(0, "auth_failure", "a", 1), row(5, "auth_failure", "b", 1), row(700, "sudo_command", None)],
        [row(9, "auth_success", "a", 2), row(10, None, "c"), row(30_000, "auth_failure", "z")],
        [row(30_001, "firewall_block", "z", 3)],  # with this batch the first windows close
        [row(20, "auth_failure", "late")],
        [row(90_000, "auth_failure", "y")],
    ]
    schema = "timestamp timestamp, event_type string, src_ip string, dst_port int, is_suspicious boolean, http_status int"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "out" / str(i)))
        (part,) = (tmp_path / "out" / str(i)).glob("*.parquet")
        part.rename(tmp_path / "in" / f"{i}.parquet")
        os.utime(tmp_path / "in" / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    events = streams.read_stream(spark, str(tmp_path / "in"), 1).withColumn("extra", F.struct("is_suspicious", "http_status"))
    got = {r.window_start: (r.total_events, r.unique_src_ips, r.unique_dst_ports, r.unique_event_types, r.auth_failures, r.auth_successes, r.auth_failure_ratio, r.sudo_count, r.firewall_blocks) for r in streams.run(streams.features(events), str(tmp_path / "run")).collect()}
    assert got == {0: (4, 3, 2, 2, 2, 1, 0.6667, 0, 0), 600: (1, 0, 0, 1, 0, 0, 0.0, 1, 0), 30_000: (2, 1, 1, 2, 1, 0, 1.0, 0, 1)}
