"""Rules, windows, anomalies and retention on small tables."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logmill.operators import anomaly, features, forest, rules, views
from logmill.operators.parse import parse_auth

NOW = datetime(2026, 10, 12, 12)
SUDO = rules.SHIPPED[3]


def as_of():
    return F.to_timestamp(F.lit(str(NOW)))


def sudo_events(spark, items):
    """Events of (user, seconds before now)."""
    lines = [(i, f"{(NOW - timedelta(seconds=s)).isoformat()}Z vps sudo: {u} : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/ls") for i, (u, s) in enumerate(items)]
    return parse_auth(spark.createDataFrame(lines, "line_id long, value string"), as_of()).withColumn("source", F.lit("auth"))


def test_threshold_and_cooldown(spark):
    events = sudo_events(spark, [("ann", 10)] * 8 + [("bob", 10)] * 8 + [("cat", 10)] * 5 + [("dan", 400)] * 9)
    found = rules.alerts(events, rules.SHIPPED, as_of()).collect()
    assert sorted(a.group_value for a in found) == ["ann", "bob"]
    assert {(a.user, a.src_ip, a.rule_id, a["count"]) for a in found} == {("ann", None, "rule-004", 8), ("bob", None, "rule-004", 8)}
    assert "8 events detected from user=ann in last 5m" in sorted(a.message for a in found)[0]
    before = spark.createDataFrame([("rule-004", "ann", NOW - timedelta(seconds=300)), ("rule-004", "bob", NOW - timedelta(hours=2)), ("rule-001", "bob", NOW)], "rule_id string, group_value string, created_at timestamp")
    assert [a.group_value for a in rules.alerts(events, rules.SHIPPED, as_of(), before).collect()] == ["bob"]
    links = rules.evidence(events, rules.SHIPPED, rules.alerts(events, rules.SHIPPED, as_of()), as_of())
    assert links.count() == 16


def test_null_groups(spark):
    events = sudo_events(spark, [("ann", 1)] * 3).withColumn("user", F.lit(None).cast("string"))
    rule = rules.Rule("r", "R", {"event_type": "sudo_command"}, "selection | count(user) >= 3")
    assert [a.group_value for a in rules.alerts(events, [rule], as_of()).collect()] == ["None"]
    assert rules.alerts(events, [rule], as_of(), null_groups="skip").count() == 0
    few = rules.Rule("r", "R", {"event_type": "sudo_command"}, "selection | count(user) < 9")
    assert rules.alerts(events.limit(0), [few], as_of()).count() == 0


def test_selections(spark):
    events = sudo_events(spark, [("ann", 1)])
    assert events.where(rules.predicate({"service": "sudo", "target_user": "root"})).count() == 1
    assert events.where(rules.predicate({"user": "true"})).count() == 0
    assert events.where(rules.predicate({"user__in": ["ann", "x"], "command__contains": "ls"})).count() == 1
    assert events.where(rules.predicate({"no_such_field": 1})).count() == 0 == events.where(rules.predicate({"command__like": "ls"})).count()
    assert rules.Rule("x", "X", {}, "selection | count(user) >= 12 and more").n == 12 and rules.Rule("x", "X", {}, "nothing").op == ""


def test_values_are_brought_to_the_type_of_their_field(spark):
    unfit = lambda selection: rules.problem_of(rules.Rule("x", "X", selection, "selection | count(user) > 0"))
    for selection in ({"http_path": 404}, {"http_path__in": [1, 2]}, {"pid__in": ["a"]}, {"timestamp__gte": "garbage"}, {"event_type": ["a"]}, {"event_type": {"a": 1}}, {"is_suspicious": 1}, {"is_suspicious": "yes"}, {"http_status": "404"}, {"http_status": True}, {"pid": float("nan")}, {"user": "\ud800"}, {"reason": None}, {"user__gte": None}, {"user__contains": 7}, {"user__in": "ann"}, {"user__in": [None]}, {3: 3}, ["user"], "user"):
        assert unfit(selection), selection
    for selection in ({}, {"user": None}, {"user": 5}, {"pid": "77"}, {"pid": 7.5}, {"pid__gt": 10**30}, {"http_status__in": ["404", 404]}, {"timestamp__gte": datetime(2026, 1, 1)}, {"timestamp__lt": NOW.date()}, {"is_suspicious": "False"}):
        assert unfit(selection) is None, selection
    events = sudo_events(spark, [("ann", 1), (None, 1), ("5", 1)]).withColumn("user", F.nullif("user", F.lit("None")))
    finds = lambda selection: events.where(rules.predicate(selection)).count()
    assert [finds(s) for s in ({"user": None}, {"user": 5}, {"timestamp__gte": str(NOW - timedelta(seconds=2))}, {"timestamp__gt": NOW.date()}, {"pid": None}, {"pid__in": []})] == [1, 1, 3, 3, 3, 0]
    odd = [rules.Rule(7, 8, {"user": 5}, "selection | count(user) > 0", 9, "99999999999999999999d", 4, (1, 2)), rules.Rule("big", "B", {}, f"selection | count(user) > {10**30}"), rules.Rule("none", "N", {"pid": 1}, None)]
    assert [(a.rule_id, a.rule_title, a.tags) for a in rules.alerts(events, odd, as_of()).collect()] == [("7", "8", ["1", "2"])]
    assert {"value of another type: pid", "no technique tag"} <= {r.problem for r in rules.lint(rules.rule_table(spark, [rules.Rule("x", "X", {"pid": "a"}, "selection | count(user) > 0")])).collect()}


def test_rules_from_files(spark, tmp_path):
    (tmp_path / "b.yml").write_text("title: B\nid: b\ndetection:\n  selection: {event_type: x}\n  condition: selection | count(user) > 3\n  timeframe: 2h\nresponse: {cooldown: 1d}\ntags: [attack.t1]\n")
    (tmp_path / "a.yaml").write_text("title: A\nstatus: disabled\ndetection: {selection: {}, condition: x}\n")
    (tmp_path / "c.yml").write_text("title: only\n")
    (tmp_path / "d.yml").write_text(": : bad [")
    found = rules.load_rules(str(tmp_path))
    assert [(r.id, r.seconds, r.cooldown_s, r.n) for r in found] == [("b", 7200, 86400, 3)]
    assert rules.lint(rules.rule_table(spark, rules.SHIPPED)).count() == 0


def test_cooldown_fold(spark):
    hits = spark.createDataFrame([("k", t) for t in (0, 10, 299, 300, 301, 650, 900, 650)], "k string, at long")
    assert sorted(r.fired_at for r in rules.cooldown_fold(hits, ["k"], "at", 300).collect()) == [0, 301, 650]


def test_cooldown_fold_of_many_times(spark, monkeypatch):
    """A key with most of the times, keys and times that are null, repeated times, and key columns of any name."""
    monkeypatch.setattr(rules, "MOST_MOMENTS", 7)
    rng = random.Random(3)
    hits = [("hot", 1, rng.randrange(400_000)) for _ in range(30_000)] + [(rng.choice(["x", None]), rng.choice([2, None]), rng.choice([None, *range(0, 3000, 100)])) for _ in range(500)]
    got = sorted(map(tuple, rules.cooldown_fold(spark.createDataFrame(hits, "a string, b int, at long"), ["a", "b"], "at", 300).collect()), key=str)
    want, last = [], {}
    for a, b, at in sorted((h for h in set(hits) if h[2] is not None), key=lambda h: h[2]):
        if (a, b) not in last or at > last[a, b] + 300:
            want.append((a, b, at))
            last[a, b] = at
    assert got == sorted(want, key=str) and len(want) > 1000
    assert rules.cooldown_fold(spark.createDataFrame([], "a string, b int, at long"), ["a", "b"], "at", 300).count() == 0


@pytest.mark.parametrize(("period", "together"), [(301, 4096), (7, 2), (1, 3)])
def test_pointer_doubling(spark, monkeypatch, period, together):
    """The same as the walk, with keys of many, one and null values, gaps of many periods and negative times."""
    monkeypatch.setattr(rules, "TOGETHER", together)
    rng = random.Random(period)
    hits = [("hot", 1, rng.randrange(-5_000, 40_000)) for _ in range(6_000)] + [("hot", None, 50_000 * i * i + rng.randrange(400)) for i in range(300)] + [(None, 2, t) for t in range(0, 300, 3)] + [("one", 1, 7), ("few", 3, 1), ("few", 3, 2), ("few", 3, None)]
    frame = spark.createDataFrame(hits, "a string, b int, at long")
    rows = lambda most: sorted(map(str, rules.cooldown_fold(frame, ["a", "b"], "at", period - 1, most).collect()))
    walked = rows(10**6)
    assert rows(50) == walked == rows(0)



def test_replay_against_ticks(spark):
    rng = random.Random(1)
    items = [(rng.choice("ab"), rng.randrange(40_000)) for _ in range(120)]
    rule = rules.Rule("r", "R", {"event_type": "sudo_command"}, "selection | count(user) > 3", timeframe="20m", cooldown="25m")
    end = int(NOW.timestamp()) - int(datetime(1970, 1, 1).timestamp())
    got = {(r.group_value, r.fired_at) for r in rules.replay(sudo_events(spark, items), rule, F.lit(end - 45_000), F.lit(end), 60).collect()}
    want, last = set(), {}
    for tick in range(end - 45_000, end + 1, 60):
        for u in "ab":
            n = sum(1 for v, s in items if v == u and tick - rule.seconds <= end - s <= tick)
            if n > 3 and not (u in last and last[u] >= tick - rule.cooldown_s):
                want.add((u, tick))
                last[u] = tick
    assert got == want and len(want) > 5


def windows(spark, rows):
    base = dict.fromkeys(features.FEATURES, 0)
    return spark.createDataFrame([(i * 600, *[float((base | r)[f]) for f in features.FEATURES]) for i, r in enumerate(rows)], ", ".join(["window_start long", *[f"{f} double" for f in features.FEATURES]]))


def test_detector(spark):
    rng = random.Random(42)
    usual = lambda: {"total_events": 250 + rng.gauss(0, 5), "unique_src_ips": 38 + rng.gauss(0, 2), "auth_failures": 70 + rng.gauss(0, 5), "auth_failure_ratio": 1.0, "unique_event_types": 6}
    base = windows(spark, [usual() for _ in range(30)])
    fitted = anomaly.fit(base)
    calm = {"total_events": 250, "unique_src_ips": 38, "auth_failures": 70, "auth_failure_ratio": 1.0, "unique_event_types": 6}
    now = windows(spark, [calm | {"auth_successes": 1}, calm | {"auth_failures": 209}])
    scored = anomaly.scored(now, fitted)
    yes, no = (spark.createDataFrame([(0, v), (600, v)], "window_start long, forest_vote boolean") for v in (True, False))
    verdict = lambda v, **k: {r.window_start: (r.is_anomaly, r.score, r.method, r.severity) for r in anomaly.verdicts(scored, v, **k).collect()}
    assert verdict(None) == {0: (False, 0.0, "z_score", "low"), 600: (True, 1.0, "z_score", "high")}
    assert verdict(yes)[600] == (True, 1.0, "z_score+isolation_forest", "high") and verdict(no)[600] == (False, 0.5, "z_score+isolation_forest", "medium")
    assert verdict(yes)[0][0] is False and verdict(no, require_agreement=False)[600][0] is True
    assert anomaly.fit(base.limit(9)).count() == 0
    unfitted = anomaly.verdicts(anomaly.scored(now, anomaly.fit(base.limit(9)))).collect()
    assert {(r.is_anomaly, r.score, r.method) for r in unfitted} == {(False, 0.0, "none")}


def test_forest_finds_the_odd_one(spark):
    rng = random.Random(3)
    rows = [{"total_events": 100 + rng.gauss(0, 3), "auth_failures": 10 + rng.gauss(0, 1)} for _ in range(200)] + [{"total_events": 900, "auth_failures": 300}]
    w = windows(spark, rows)
    got = {r.window_start: r for r in forest.score(w, forest.fit(w, trees=40)).collect()}
    assert got[200 * 600].forest_vote and min(got.values(), key=lambda r: r.decision).window_start == 200 * 600
    assert 10 <= sum(r.forest_vote for r in got.values()) <= 21


def test_retention_keeps_evidence(spark):
    events = spark.createDataFrame([(1, NOW - timedelta(days=100)), (2, NOW - timedelta(days=100)), (3, NOW - timedelta(days=1)), (4, NOW - timedelta(days=400))], "line_id long, timestamp timestamp")
    alerts = spark.createDataFrame([("young", NOW - timedelta(days=99)), ("old", NOW - timedelta(days=400))], "id string, created_at timestamp")
    bridge = spark.createDataFrame([("young", 1), ("old", 4)], "alert_id string, event_id long")
    kept, stay = views.retained(events, alerts, bridge, as_of())
    assert sorted(r.line_id for r in kept.collect()) == [1, 3] and [r.id for r in stay.collect()] == ["young"]
    assert tuple(views.dry_run(events, alerts, bridge, as_of()).first()) == (1, 1)


def test_one_bad_rule_stops_no_other(spark):
    from logmill.plans.detection import BROKEN

    assert [rules.problem_of(r) for r in BROKEN] == ["field unknown: no_such", "comparison unknown: startswith", "condition unreadable", "group is no event column", None]
    told = {(r.rule_id, r.problem) for r in rules.lint(rules.rule_table(spark, BROKEN)).collect()}
    assert {("broken-1", "field unknown: no_such"), ("broken-2", "comparison unknown: startswith"), ("broken-3", "condition unreadable"), ("broken-4", "group is no event column")} <= told


def test_replay_of_all_rules_by_stretches(spark):
    """Rules of all operators, a group with most events, against counting at every tick; short stretches split each group."""
    rng = random.Random(12)
    events = sudo_events(spark, [(rng.choice(["hot"] * 6 + ["x", "y", None]), rng.randrange(40_000)) for _ in range(400)])
    own = [rules.Rule(f"r{i}", "R", {"event_type": "sudo_command"}, f"selection | count(user) {op} {n}", timeframe=tf, cooldown=cd) for i, (op, n, tf, cd) in enumerate(((">", 3, "10m", "20m"), (">=", 1, "3m", "1h"), ("<", 2, "30m", "5m"), ("<=", 4, "15m", "1s"), ("==", 2, "20m", None)))]
    times = {}
    for r in events.select("user", F.unix_timestamp("timestamp").alias("t")).where("user <> 'None'").collect():
        times.setdefault(r.user, []).append(r.t)
    end = int(NOW.replace(tzinfo=timezone.utc).timestamp())
    holds = {">": int.__gt__, ">=": int.__ge__, "<": int.__lt__, "<=": int.__le__, "==": int.__eq__}
    want = set()
    for rule in own:
        for user, ts in times.items():
            last = None
            for at in range(end - 36_000, end + 1, 60):
                n = sum(at - rule.seconds <= t <= at for t in ts)
                if n and holds[rule.op](n, rule.n) and (last is None or at > last + rule.cooldown_s):
                    want.add((rule.id, user, at))
                    last = at
    for stretch in (1000, 10**6):
        got = rules.replay_all(events.where("user <> 'None'"), [*own, rules.Rule("no", "N", {"pid": "x"}, "selection | count(user) > 0")], F.lit(end - 36_000), F.lit(end), 60, stretch).collect()
        assert len(got) == len(want) and set(map(tuple, got)) == want and {r.rule_id for r in got} == {r.id for r in own}


def test_forest_by_single_steps(spark):
    """Samples against sorting all hashes, and paths against a walk from node to node."""
    from logmill.operators.features import FEATURES

    rng = random.Random(5)
    rows = [(600 * i, *[float(rng.randrange(30) + 200 * (i == 7)) for _ in FEATURES]) for i in range(900)]
    windows = spark.createDataFrame(rows, "window_start long, " + ", ".join(f"{f} double" for f in FEATURES))
    nodes = forest.fit(windows, trees=12, sample=64)
    by_tree = {}
    for r in nodes.collect():
        by_tree.setdefault(r.tree, {})[r.node] = r
    hashed = windows.select("window_start", *[F.xxhash64("window_start", F.lit(t), F.lit(forest.SEED)).alias(f"h{t}") for t in range(12)]).collect()
    values = {r[0]: r[1:] for r in rows}
    for t, tree in by_tree.items():
        picked = [values[r.window_start] for r in sorted(hashed, key=lambda r: (r[f"h{t}"], r.window_start))[:64]]
        assert {r.n for r in tree.values()} == {64}
        inside = {0: picked}
        for at in sorted(tree):
            r = tree[at]
            if r.feature >= 0:
                column = [x[r.feature] for x in inside[at]]
                assert min(column) <= r.cut <= max(column)
                inside[r.left], inside[r.right] = [x for x in inside[at] if x[r.feature] < r.cut], [x for x in inside[at] if x[r.feature] >= r.cut]

    def raw(x):
        total = 0.0
        for tree in by_tree.values():
            at, depth = 0, 0
            while tree[at].feature >= 0:
                at, depth = (tree[at].left if x[tree[at].feature] < tree[at].cut else tree[at].right), depth + 1
            assert abs(tree[at].credit - depth) <= forest.average_path(64)
            total += tree[at].credit
        return -(2.0 ** (-total / 12 / forest.average_path(64)))

    scores = {w: raw(x) for w, x in values.items()}
    ordered = sorted(scores.values())
    place = 0.1 * (len(ordered) - 1)
    limit = ordered[int(place)] + (place - int(place)) * (ordered[int(place) + 1] - ordered[int(place)])
    got = forest.score(windows, nodes).collect()
    assert len(got) == 900 and all(abs(r.decision - (scores[r.window_start] - limit)) < 1e-4 for r in got)
    assert min(got, key=lambda r: r.decision).window_start == 4200
