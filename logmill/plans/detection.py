"""Queries on rules, features and anomalies."""

from __future__ import annotations

from pyspark.sql import functions as F

from logmill.operators import anomaly, features, forest, rules
from logmill.plans.base import NOW, TEST_RULES, as_of, bridge, event_table, expected, parsed, query, shared_dir, raised, snapshot, with_alerts

DAY = 86400
START = "epoch(TIMESTAMP '2024-01-01 00:00:00')::BIGINT"


def by_hour(spark, d):
    return features.tumbling(parsed(spark, d), as_of(), 60)


#: Features of windows of w seconds; ws is the window of an event.
def features_sql(w: int, source: str = "good", ws: str | None = None) -> str:
    ws = ws or f"epoch({NOW})::BIGINT + CAST(floor((t_s - epoch({NOW})::BIGINT) / {w}.0) AS BIGINT) * {w}"
    return f"""SELECT {ws} AS window_start, count(*) AS total_events, count(DISTINCT src_ip) AS unique_src_ips, count(DISTINCT dst_port) AS unique_dst_ports, count(DISTINCT event_type) AS unique_event_types,
        count(*) FILTER (event_type = 'auth_failure') AS auth_failures, count(*) FILTER (event_type = 'auth_success') AS auth_successes,
        coalesce(round_even(count(*) FILTER (event_type = 'auth_failure') / nullif(count(*) FILTER (event_type IN ('auth_failure', 'auth_success')), 0)::DOUBLE, 4), 0.0) AS auth_failure_ratio,
        count(*) FILTER (is_suspicious) AS suspicious_requests, count(*) FILTER (http_status BETWEEN 400 AND 499) AS http_4xx_count,
        count(*) FILTER (event_type = 'firewall_block') AS firewall_blocks, count(*) FILTER (event_type = 'sudo_command') AS sudo_count FROM {source} GROUP BY 1"""


NAMES = features.FEATURES
LONG_SQL = f"lf AS (SELECT window_start, unnest({list(NAMES)}) AS feature, unnest([{', '.join(f'CAST({n} AS DOUBLE)' for n in NAMES)}]) AS value, unnest(range({len(NAMES)})) AS position FROM f)"
BASE_SQL = f"f AS ({features_sql(3600)}), {LONG_SQL}, bl AS (SELECT position, feature, avg(value) AS mean, CASE WHEN stddev_pop(value) = 0 THEN 0.001 ELSE stddev_pop(value) END AS std FROM lf GROUP BY ALL), sc AS (SELECT *, (value - mean) / std AS z, abs((value - mean) / std) > 2.5 AND abs(value - mean) > greatest(1.0, abs(mean) * 0.25) AS flag FROM lf JOIN bl USING (position, feature))"
VOTE_SQL = "vt AS (SELECT window_start, (total_events % 3 = 0 OR total_events > 30) AS forest_vote FROM f)"
ROUND = lambda *cs: [F.round(c, 9).alias(c) for c in cs]


@query(expected("SELECT r.*, coalesce(c.events, 0) AS events FROM (VALUES " + ", ".join(f"('{i}', '{lv}', {tf}::BIGINT, {cd}::BIGINT, '{g}', '>', {n}::BIGINT, '{e}')" for i, lv, tf, cd, g, n, e in (("rule-001", "high", 300, 300, "src_ip", 10, "auth_failure"), ("rule-002", "medium", 300, 300, "src_ip", 10, "http_request"), ("rule-003", "medium", 300, 300, "src_ip", 20, "firewall_block"), ("rule-004", "high", 300, 300, "user", 5, "sudo_command"), ("rule-005", "critical", 3600, 86400, "user", 0, "user_added"), ("rule-006", "high", 3600, 7200, "user", 0, "sudo_failure"))) + ") r(rule_id, level, timeframe_s, cooldown_s, group_by, op, threshold, event_type) LEFT JOIN (SELECT event_type, count(*) AS events FROM good GROUP BY 1) c USING (event_type)"))
def rule_table(spark, d):
    """The shipped rules as a table, with the events of the type that each selects."""
    table = rules.rule_table(spark, rules.SHIPPED).select("rule_id", "level", "timeframe_s", "cooldown_s", "group_by", "op", F.col("n").alias("threshold"))
    kinds = spark.createDataFrame([(r.id, r.selection["event_type"]) for r in rules.SHIPPED], "rule_id string, event_type string")
    counts = parsed(spark, d).groupBy("event_type").agg(F.count("*").alias("events"))
    return table.join(kinds, "rule_id").join(counts, "event_type", "left").fillna({"events": 0})


@query(expected("SELECT event_id AS line_id FROM good WHERE event_type = 'http_request' AND is_suspicious"))
def selection_pred(spark, d):
    return parsed(spark, d).where(rules.predicate({"event_type": "http_request", "service": "nginx", "is_suspicious": "true"})).select("line_id")


@query(expected("SELECT event_id AS line_id, http_status FROM good WHERE http_status >= 400 AND http_status < 500 AND contains(http_path, 'index')"))
def selection_range(spark, d):
    return parsed(spark, d).where(rules.predicate({"http_status__gte": 400, "http_status__lt": 500, "http_path__contains": "index"})).select("line_id", F.col("extra.http_status").cast("long").alias("http_status"))


@query(with_alerts("SELECT rule_id, g AS group_value, c AS count FROM gc"))
def rule_group_count(spark, d):
    return rules.group_counts(parsed(spark, d), TEST_RULES, as_of())


ALERT_COLUMNS = "id, rule_id, rule_title, severity, message, src_ip, \"user\", group_value, tags, c AS count"


def alert_columns(df):
    return df.select("id", "rule_id", "rule_title", "severity", "message", "src_ip", "user", "group_value", F.array_join("tags", ",").alias("tags"), "count")


@query(with_alerts(f"SELECT {ALERT_COLUMNS} FROM al WHERE rule_id = 'rule-t1'"))
def ssh_brute_force(spark, d):
    return alert_columns(rules.alerts(parsed(spark, d), TEST_RULES[:1], as_of()))


@query(with_alerts(f"SELECT {ALERT_COLUMNS} FROM al"))
def all_rules_alerts(spark, d):
    return alert_columns(rules.alerts(parsed(spark, d), TEST_RULES, as_of()))


BROKEN = (
    rules.Rule("broken-1", "Unknown field", {"event_type": "auth_failure", "no_such": 1}, "selection | count(src_ip) > 0"),
    rules.Rule("broken-2", "Unknown comparison", {"http_path__startswith": "/"}, "selection | count(src_ip) > 0"),
    rules.Rule("broken-3", "Unreadable", {"event_type": "auth_failure"}, "selection"),
    rules.Rule("broken-4", "Unknown group", {"event_type": "auth_failure"}, "selection | count(no_such) > 0"),
    rules.Rule("broken-5", "Number and text", {"http_status__gte": "many", "http_path__contains": 7}, "selection | count(src_ip) > 0"),
    *[
        rules.Rule(f"broken-{6 + i}", "Value of another type", selection, "selection | count(src_ip) > 0")
        for i, selection in enumerate((
            {"http_path": 404}, {"user": 5}, {"http_path__in": [1, 2]}, {"pid__in": ["a"]}, {"timestamp__gte": "garbage"}, {"timestamp": "garbage"}, {"event_type": ["auth_failure", "http_request"]}, {"event_type": {"a": 1}},
            {"is_suspicious": 1}, {"http_status": 404.5}, {"http_status": "404"}, {"is_suspicious": "yes"}, {"pid": 10**30}, {"http_status__gt": float("nan")}, {"reason": None}, {"is_suspicious__gte": True}, {5: 5}, ["event_type"],
        ))
    ],
)


@query(with_alerts(f"SELECT {ALERT_COLUMNS} FROM al"))
def rule_isolation(spark, d):
    """Rules that can't run find nothing, and the others find what they find alone."""
    return alert_columns(rules.alerts(parsed(spark, d), (*BROKEN[:3], *TEST_RULES, *BROKEN[3:]), as_of()))


#: Selections whose values are of many types, and what they mean in SQL.
TYPED = (
    ({"http_status": 404}, "http_status = 404"), ({"http_status": 404.0}, "http_status = 404"), ({"http_status": 404.5}, "false"), ({"http_status": "404"}, "false"), ({"http_status__in": [404, "500", 200.0]}, "http_status IN (404, 200)"),
    ({"http_status__gte": 399.5, "http_status__lt": 10**30}, "http_status >= 400"), ({"is_suspicious": "TRUE"}, "is_suspicious"), ({"is_suspicious": False}, "NOT is_suspicious"), ({"is_suspicious": "yes"}, "false"), ({"is_suspicious": 1}, "false"),
    ({"user": None}, '"user" IS NULL'), ({"user": None, "event_type": "http_request"}, "\"user\" IS NULL AND event_type = 'http_request'"), ({"user": 5}, "\"user\" = '5'"), ({"dst_port": "22"}, "dst_port = 22"), ({"dst_port__in": ["22", 80]}, "dst_port IN (22, 80)"), ({"dst_port__in": ["22", "x"]}, "false"),
    ({"reason": None}, "false"), ({"event_type": ["http_request"]}, "false"), ({"event_type__in": ["http_request", None]}, "event_type = 'http_request'"), ({"timestamp__gte": "2024-01-10", "timestamp__lt": "2024-01-12T06:00:00+02:00"}, "t >= TIMESTAMP '2024-01-10 00:00:00' AND t < TIMESTAMP '2024-01-12 04:00:00'"), ({"timestamp__gte": "garbage"}, "false"), ({}, "true"),
)


@query(expected(" UNION ALL ".join(f"SELECT {i}::BIGINT AS selection, count(*) FILTER ({sql}) AS events FROM good" for i, (_, sql) in enumerate(TYPED))))
def selection_types(spark, d):
    """How many events each selection finds, all in one pass."""
    counts = parsed(spark, d).agg(F.array(*[F.count_if(rules.predicate(s)) for s, _ in TYPED]).alias("n"))
    return counts.select(F.posexplode("n").alias("selection", "events")).select(F.col("selection").cast("long"), "events")


@query(with_alerts("SELECT rule_id, group_value FROM al WHERE NOT (group_value <> 'None' AND c % 2 = 0 AND CASE WHEN rule_id = 'rule-t4' THEN 3600 ELSE c * 100 END <= CASE WHEN rule_id = 'rule-t4' THEN 86400 ELSE 300 END)"))
def rule_cooldown_tick(spark, d):
    """Earlier alerts, of half of the groups, hold back those whose cooldown isn't over."""
    e = event_table(spark, d, lean=True)
    back = F.when(F.col("rule_id") == "rule-t4", 3600).otherwise(F.col("count") * 100)
    earlier = rules.fired(e, TEST_RULES, as_of()).where("count % 2 = 0").select("rule_id", "group_value", F.timestamp_seconds(F.unix_timestamp(as_of()) - back).alias("created_at"))
    return rules.alerts(e, TEST_RULES, as_of(), earlier).select("rule_id", "group_value")


def fold_sql(keys: str, source: str, gap: int) -> str:
    """Times of each key that fire, as a recursive walk from fired time to the next one after the gap."""
    return f"""hit AS MATERIALIZED ({source}), walk AS (SELECT {keys}, min(ts) AS fired_at FROM hit GROUP BY {keys} UNION ALL
        SELECT {", ".join("w." + k.strip() for k in keys.split(","))}, (SELECT min(ts) FROM hit h WHERE {" AND ".join(f"h.{k.strip()} IS NOT DISTINCT FROM w.{k.strip()}" for k in keys.split(","))} AND h.ts > w.fired_at + {gap}) FROM walk w WHERE w.fired_at IS NOT NULL)"""


def recursive(select: str) -> str:
    return "WITH RECURSIVE " + select


@query(recursive(f"{expected('')[5:]}, " + fold_sql("group_value", "SELECT DISTINCT src_ip AS group_value, t_s AS ts FROM good WHERE event_type = 'firewall_block'", DAY) + " SELECT group_value, fired_at FROM walk WHERE fired_at IS NOT NULL"))
def rule_cooldown_fold(spark, d):
    hits = parsed(spark, d).where("event_type = 'firewall_block'").select(F.col("src_ip").alias("group_value"), F.unix_timestamp("timestamp").alias("ts"))
    return rules.cooldown_fold(hits, ["group_value"], "ts", DAY)


REPLAY_RULE = rules.Rule("rule-r", "Replay", {"event_type": "auth_failure"}, "selection | count(src_ip) > 2", "high", "7d", "1d")
TICK = 3600


@query(recursive(f"{expected('')[5:]}, ticks AS (SELECT unnest(range({START}, epoch({NOW})::BIGINT + 1, {TICK})) AS ts), own AS (SELECT src_ip, t_s FROM good WHERE event_type = 'auth_failure'), "
    + fold_sql("group_value", f"SELECT src_ip AS group_value, ts FROM ticks JOIN own ON own.t_s <= ts AND own.t_s >= ts - {7 * DAY} GROUP BY ALL HAVING count(*) > 2", DAY) + " SELECT group_value, fired_at FROM walk WHERE fired_at IS NOT NULL"))
def rule_replay(spark, d):
    return rules.replay(parsed(spark, d), REPLAY_RULE, F.unix_timestamp(F.to_timestamp(F.lit("2024-01-01 00:00:00"))), F.unix_timestamp(as_of()), TICK)


REPLAYED = (REPLAY_RULE, rules.Rule("rule-q", "Commands", {"event_type": "sudo_command"}, "selection | count(user) == 3", "high", "3d", "2d"), rules.Rule("rule-p", "Requests", {"event_type": "http_request", "http_status__gte": 500}, "selection | count(src_ip) >= 2", "low", "12h", "6h"), BROKEN[3])
PAST = {"rule-r": ("src_ip", "event_type = 'auth_failure'", 7 * DAY, "count(*) > 2", DAY), "rule-q": ('"user"', "event_type = 'sudo_command'", 3 * DAY, "count(*) = 3", 2 * DAY), "rule-p": ("src_ip", "event_type = 'http_request' AND http_status >= 500", DAY // 2, "count(*) >= 2", DAY // 4)}


@query(recursive(f"""{expected('')[5:]}, ticks AS (SELECT unnest(range({START}, epoch({NOW})::BIGINT + 1, {TICK})) AS ts),
    hit AS MATERIALIZED ({" UNION ALL ".join(f"SELECT '{k}' AS rule_id, {g} AS group_value, ts, {cd} AS gap FROM ticks JOIN good ON t_s <= ts AND t_s >= ts - {tf} WHERE {sql} AND {g} IS NOT NULL GROUP BY {g}, ts HAVING {having}" for k, (g, sql, tf, having, cd) in PAST.items())}),
    walk AS (SELECT rule_id, group_value, gap, min(ts) AS fired_at FROM hit GROUP BY ALL UNION ALL
        SELECT w.rule_id, w.group_value, w.gap, (SELECT min(ts) FROM hit h WHERE h.rule_id = w.rule_id AND h.group_value = w.group_value AND h.ts > w.fired_at + w.gap) FROM walk w WHERE w.fired_at IS NOT NULL)
    SELECT rule_id, group_value, fired_at FROM walk WHERE fired_at IS NOT NULL"""))
def rules_replay(spark, d):
    """All rules at once, each with its own timeframe, threshold and cooldown."""
    return rules.replay_all(parsed(spark, d), REPLAYED, F.unix_timestamp(F.to_timestamp(F.lit("2024-01-01 00:00:00"))), F.unix_timestamp(as_of()), TICK)


@query(with_alerts("SELECT alert_id, event_id FROM br"))
def alert_evidence(spark, d):
    e = event_table(spark, d, lean=True)
    return bridge(e, rules.alerts(e, TEST_RULES, as_of()))


@query(with_alerts("SELECT technique, count(*) AS alerts FROM (SELECT unnest(split(tags, ',')) AS technique FROM al) WHERE starts_with(technique, 'attack.t') GROUP BY 1"))
def mitre_rollup(spark, d):
    return rules.technique_rollup(raised(parsed(spark, d)))


@query(expected("""SELECT rule_id, problem, n AS selected FROM (VALUES ('bad-1', 'condition unreadable', 'auth_failure'), ('bad-1', 'no technique tag', 'auth_failure'), ('bad-2', 'cooldown under timeframe', 'user_added'), ('bad-3', 'id used twice', 'sudo_command'), ('bad-3', 'group is no event column', 'sudo_command')) v(rule_id, problem, kind)
    JOIN (SELECT event_type AS kind, count(*) AS n FROM good GROUP BY 1) USING (kind)"""))
def rule_lint(spark, d):
    """Problems of a rule list, with the events that each rule selects."""
    bad = [rules.Rule("bad-1", "a", {"event_type": "auth_failure"}, "selection only", tags=()), rules.Rule("bad-2", "b", {"event_type": "user_added"}, "selection | count(user) > 1", timeframe="1h", cooldown="5m", tags=("attack.t1",)), *[rules.Rule("bad-3", "c", {"event_type": "sudo_command"}, f"selection | count({g}) > 1", tags=("attack.t1",)) for g in ("user", "nothing")]]
    kinds = spark.createDataFrame(sorted({(r.id, r.selection["event_type"]) for r in bad}), "rule_id string, event_type string")
    n = parsed(spark, d).groupBy("event_type").agg(F.count("*").alias("selected"))
    return rules.lint(rules.rule_table(spark, bad)).join(kinds, "rule_id").join(n, "event_type").select("rule_id", "problem", "selected")


@query("SELECT field FROM (VALUES ('http_statuz'), ('no_such')) t(field)")
def field_contract(spark, d):
    used = spark.createDataFrame([(f,) for f in ("http_status", "is_suspicious", "fw_action", "auth_method", "reason", "http_statuz", "no_such")], "field string")
    return rules.missing_fields(used, parsed(spark, d))


@query(expected(features_sql(600)))
def features_10m(spark, d):
    return features.tumbling(parsed(spark, d), as_of(), 10)


@query(expected(f", f AS ({features_sql(600)}) SELECT w AS window_start, " + ", ".join(f"coalesce({n}, 0) AS {n}" for n in NAMES) + f" FROM (SELECT unnest(range(epoch({NOW})::BIGINT - 96 * 3600, epoch({NOW})::BIGINT, 600)) AS w) LEFT JOIN f ON f.window_start = w"))
def feature_series_filled(spark, d):
    return features.series(parsed(spark, d), as_of(), 96, 10)


@query(expected(f", sl AS (SELECT good.*, unnest([t_s // 300 * 300, t_s // 300 * 300 - 300]) AS w FROM good) {features_sql(600, 'sl', 'w')}"))
def features_sliding(spark, d):
    return features.sliding(parsed(spark, d), 10, 5)


@query(expected(f", f AS ({features_sql(3600)}) SELECT window_start, " + " || ',' || ".join(f"CAST(CAST(round({n} * 10000) AS BIGINT) AS VARCHAR)" for n in NAMES) + " AS vector FROM f"))
def feature_vector(spark, d):
    return by_hour(spark, d).select("window_start", F.array_join(F.transform(features.vector(), lambda x: F.round(x * 10000).cast("long").cast("string")), ",").alias("vector"))


@query(expected(f", {BASE_SQL} SELECT feature, round(mean, 9) AS mean, round(std, 9) AS std FROM bl"))
def baseline_stats(spark, d):
    return anomaly.fit(by_hour(spark, d)).select("feature", *ROUND("mean", "std"))


@query(expected(f", {BASE_SQL} SELECT window_start, feature, value, round(z, 9) AS z FROM sc WHERE flag"))
def zscore_flags(spark, d):
    w = snapshot(by_hour(spark, d))
    return anomaly.scored(w, anomaly.fit(w)).where("flag").select("window_start", "feature", "value", *ROUND("z"))


@query(expected(f", {BASE_SQL} SELECT window_start, feature, value, round(mean, 9) AS mean, round(std, 9) AS std, round(z, 2) AS z FROM sc WHERE flag"))
def anomaly_details(spark, d):
    w = snapshot(by_hour(spark, d))
    v = anomaly.verdicts(anomaly.scored(w, anomaly.fit(w)))
    return v.select("window_start", F.inline("details")).select("window_start", "feature", "value", *ROUND("mean", "std"), "z")


def votes(w):
    """A stand-in for the forest that SQL can repeat."""
    return w.select("window_start", ((F.col("total_events") % 3 == 0) | (F.col("total_events") > 30)).alias("forest_vote"))


def judged(spark, d, agree=True):
    w = snapshot(by_hour(spark, d))
    return anomaly.verdicts(anomaly.scored(w, anomaly.fit(w)), votes(w), agree)


VERDICT_SQL = f"{BASE_SQL}, {VOTE_SQL}, vd AS (SELECT window_start, forest_vote, count(*) FILTER (flag) AS flags, (CASE WHEN count(*) FILTER (flag) > 0 THEN 1 ELSE 0 END + CASE WHEN forest_vote THEN 1 ELSE 0 END) / 2.0 AS score FROM sc JOIN vt USING (window_start) GROUP BY window_start, forest_vote)"


@query(expected(f", {VERDICT_SQL} SELECT window_start, score::DOUBLE AS score, score > 0 AS is_anomaly, 'z_score+isolation_forest' AS method, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS severity FROM vd"))
def consensus_severity(spark, d):
    return judged(spark, d, agree=False).select("window_start", "score", "is_anomaly", "method", "severity")


@query(expected(f""", {VERDICT_SQL}, fl AS (SELECT window_start, string_agg('  ' || feature || ': value=' || CAST(value AS VARCHAR) || ', mean=' || printf('%.1f', mean) || ', z=' || CAST(round(z, 2) AS VARCHAR), chr(10) ORDER BY position) AS lines FROM sc WHERE flag GROUP BY 1)
    SELECT window_start, 'ML Anomaly detected (score=1.00, method=z_score+isolation_forest)' || chr(10) || 'Window: ' || strftime(make_timestamp(window_start * 1000000), '%Y-%m-%d %H:%M:%S+00:00') || ' — ' || strftime(make_timestamp((window_start + 3600) * 1000000), '%Y-%m-%d %H:%M:%S+00:00')
        || chr(10) || chr(10) || 'Anomalous features:' || chr(10) || lines || chr(10) || chr(10) || 'Isolation Forest: anomaly' AS message FROM vd JOIN fl USING (window_start) WHERE score = 1"""))
def anomaly_messages(spark, d):
    return judged(spark, d).where("is_anomaly").select("window_start", anomaly.message(60).alias("message"))


@query(recursive(f"{expected('')[5:]}, {VERDICT_SQL}, " + fold_sql("rule_id", "SELECT 'ml-anomaly' AS rule_id, window_start AS ts FROM vd WHERE score > 0", 3 * 3600) + " SELECT fired_at AS window_start, 'ml,anomaly,z_score+isolation_forest' AS tags FROM walk WHERE fired_at IS NOT NULL"))
def anomaly_cooldown(spark, d):
    return anomaly.anomaly_alerts(judged(spark, d, agree=False), 3 * 3600).select("window_start", F.array_join("tags", ",").alias("tags"))


@query(expected(f", {BASE_SQL}, fits AS (SELECT unnest(range({START}, epoch({NOW})::BIGINT + 2 * {DAY}, 21600)) AS fit_at), act AS (SELECT lf.* FROM lf JOIN f USING (window_start) WHERE total_events > 0) SELECT fit_at, feature, count(*) AS n, round(avg(value), 9) AS mean, round(CASE WHEN stddev_pop(value) = 0 THEN 0.001 ELSE stddev_pop(value) END, 9) AS std FROM fits JOIN act ON window_start >= fit_at - {DAY} AND window_start < fit_at GROUP BY ALL"))
def rolling_baseline(spark, d):
    return anomaly.rolling_baseline(by_hour(spark, d)).select("fit_at", "feature", "n", *ROUND("mean", "std"))


@query(expected(f", {BASE_SQL} SELECT feature, round(mean, 9) AS mean, round(std, 9) AS std FROM bl"))
def baseline_roundtrip(spark, d):
    path, w = f"{shared_dir(spark)}/baseline", snapshot(by_hour(spark, d))
    anomaly.save_baseline(anomaly.fit(w.where("total_events > 3")), path, 1)
    anomaly.save_baseline(anomaly.fit(w), path, 2)
    return anomaly.load_baseline(spark, path).select("feature", *ROUND("mean", "std"))


@query()
def iforest_scores(spark, d):
    from logmill.session import ship

    w = snapshot(by_hour(ship(spark), d))
    return forest.score(w, forest.fit(w))
