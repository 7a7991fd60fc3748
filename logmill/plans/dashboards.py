"""Queries on views, retention, privacy, briefs and routing."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from logmill.operators import briefs, privacy, routing, views
from logmill.operators.events import write_events
from logmill.plans.base import NOW, as_of, bridge, event_table, expected, parsed, query, raised, shared_dir, snapshot, with_alerts


def seconds():
    return F.unix_timestamp("timestamp").alias("t_s")

RECENT = f"t >= {NOW} - INTERVAL 96 HOUR"


def recent(e):
    return views.since(e, as_of(), "96")


@query(expected("SELECT event_id AS line_id, t_s FROM good WHERE severity = 'medium' AND source = 'auth' AND event_type = 'auth_failure'"))
def event_filter(spark, d):
    return views.equal(parsed(spark, d), severity="medium", source="auth", event_type="auth_failure", src_ip="").select("line_id", seconds())


@query(expected("SELECT event_id AS line_id FROM good WHERE event_type = 'sudo_command' OR http_path LIKE '%admin%'"))
def event_search(spark, d):
    e = event_table(spark, d)
    return views.search(e, "COMMAND=/USR/BIN/APT").select("line_id").union(views.search(e, "Wp-AdMin").select("line_id"))


@query(expected(f"SELECT event_id AS line_id, t_s FROM good WHERE {RECENT}"))
def event_recent(spark, d):
    return views.since(recent(parsed(spark, d)), as_of(), "soon").select("line_id", seconds())


@query(expected("SELECT event_id AS line_id, t_s FROM good ORDER BY t DESC, event_id LIMIT 50 OFFSET 50"))
def event_page(spark, d):
    return views.page(parsed(spark, d), 2, 50, tie="line_id").select("line_id", seconds())


@query(expected("SELECT event_id AS line_id, t_s FROM good ORDER BY t DESC, event_id LIMIT 50 OFFSET 4950"))
def event_page_deep(spark, d):
    """Page 100 of a stored table, a folder for each date."""
    path = f"{shared_dir(spark)}/events"
    write_events(parsed(spark, d), path)
    e = spark.read.parquet(path)
    return views.deep_page(e, views.range_counts(e), 100, 50, tie="line_id").select("line_id", seconds())


def alerts_of(spark, d):
    return raised(event_table(spark, d, lean=True))


@query(with_alerts("SELECT id, rule_id, group_value FROM al WHERE severity = 'high' AND status = 'resolved'"))
def alert_filter(spark, d):
    return views.equal(alerts_of(spark, d), severity="high", status="resolved", rule_id=None).select("id", "rule_id", "group_value")


@query(with_alerts("SELECT id, CASE WHEN severity = 'high' THEN 'resolved' ELSE status END AS status FROM al"))
def status_upsert(spark, d):
    a = alerts_of(spark, d)
    good, bad = a.where("severity = 'high'").select("id", F.lit("resolved").alias("status")), a.select("id", F.lit("deleted").alias("status"))
    return views.upsert_status(a, good.union(bad)).select("id", "status")


@query(with_alerts("SELECT id, rule_title, status, c AS event_count, llm_analysis <> '' AS has_analysis FROM al"))
def alert_list(spark, d):
    e = event_table(spark, d)
    a = raised(e)
    return views.listing(a, bridge(e, a)).select("id", "rule_title", "status", "event_count", "has_analysis")


@query(with_alerts("SELECT alert_id, good.event_id AS line_id, t_s FROM br JOIN good USING (event_id) JOIN al ON al.id = alert_id WHERE rule_id = 'rule-t3'"))
def alert_events_newest(spark, d):
    e = event_table(spark, d)
    a = raised(e)
    ids = a.where("rule_id = 'rule-t3'").select(F.col("id").alias("alert_id"))
    return views.events_of(ids, bridge(e, a), e).orderBy("alert_id", F.desc("timestamp"), "line_id").select("alert_id", "line_id", seconds())


@query(expected("SELECT facet, value, count(*) AS count FROM (SELECT unnest(['severity', 'source', 'event_type']) AS facet, unnest([severity, source, event_type]) AS value FROM good) GROUP BY ALL"))
def facet_counts(spark, d):
    return views.facets(parsed(spark, d), ["severity", "source", "event_type"])


@query(with_alerts(f"SELECT * FROM (SELECT count(*) AS events, count(*) FILTER (t >= {NOW} - INTERVAL 1 HOUR) AS events_last_hour FROM good), (SELECT count(*) AS alerts, count(*) FILTER (status = 'new') AS new_alerts, count(*) FILTER (status = 'new' AND severity IN ('high', 'critical')) AS urgent_alerts FROM al)"))
def dashboard_totals(spark, d):
    e = event_table(spark, d)
    return views.totals(e, raised(e), as_of())


@query(expected(f"SELECT src_ip, count(*) AS count FROM good WHERE {RECENT} AND src_ip IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"))
def top_ips(spark, d):
    return views.top(recent(parsed(spark, d)), "src_ip")


@query(expected(f"SELECT severity, count(*) AS count FROM good WHERE {RECENT} GROUP BY 1"))
def severity_dist(spark, d):
    return views.distribution(recent(parsed(spark, d)), "severity")


@query(expected(f"SELECT source, count(*) AS count FROM good WHERE {RECENT} GROUP BY 1"))
def source_dist(spark, d):
    return views.distribution(recent(parsed(spark, d)), "source")


OLD = f"t < {NOW} - INTERVAL 4 DAY"


@query(with_alerts(f"SELECT event_id AS line_id FROM good WHERE NOT ({OLD}) OR event_id IN (SELECT event_id FROM br JOIN al ON al.id = alert_id WHERE created_at >= {NOW} - INTERVAL 170 DAY)"))
def retention_keep(spark, d):
    e = event_table(spark, d, lean=True)
    a = raised(e)
    return views.retained(e, a, bridge(e, a), as_of(), 4, 170)[0].select("line_id")


@query(with_alerts(f"SELECT (SELECT count(*) FROM al WHERE created_at < {NOW} - INTERVAL 170 DAY) AS alerts_to_delete, (SELECT count(*) FROM good WHERE {OLD} AND event_id NOT IN (SELECT event_id FROM br)) AS events_to_delete"))
def retention_dry_run(spark, d):
    e = event_table(spark, d, lean=True)
    a = raised(e)
    return views.dry_run(e, a, bridge(e, a), as_of(), 4, 170)


@query(with_alerts(f"SELECT event_id AS line_id FROM good WHERE NOT ({OLD}) OR event_id IN (SELECT event_id FROM br JOIN al ON al.id = alert_id WHERE created_at >= {NOW} - INTERVAL 170 DAY)"))
def retention_in_place(spark, d):
    """A stored event table, a folder for each date, pruned where it lies."""
    e, path = event_table(spark, d, lean=True), f"{shared_dir(spark)}/events"
    write_events(e, path)
    a = raised(e)
    links = bridge(e, a).join(e.select(F.col("line_id").alias("event_id"), F.to_date("timestamp").alias("event_date")), "event_id")
    views.prune_in_place(path, a, links, datetime(2024, 2, 1, tzinfo=UTC), 4, 170)
    return spark.read.parquet(path).select("line_id")


@query(expected("SELECT count(*) AS addresses, count(*) FILTER (n >= 3) AS at_least_3_days, count(*) FILTER (n >= 25) AS at_least_25_days FROM (SELECT src_ip, count(DISTINCT CAST(t AS DATE)) AS n FROM good WHERE src_ip IS NOT NULL GROUP BY 1)"))
def ip_persistence_stored(spark, d):
    """Days of two deliveries that overlap, stored as bits and merged."""
    e, path = parsed(spark, d), f"{shared_dir(spark)}/days"
    for part in ("day(timestamp) <= 15", "day(timestamp) >= 12"):
        views.active_days(e.where(part)).write.mode("append").parquet(path)
    return views.persistence_of(spark.read.parquet(path))


@query(expected("SELECT count(*) AS addresses, count(*) FILTER (n >= 3) AS at_least_3_days, count(*) FILTER (n >= 25) AS at_least_25_days FROM (SELECT src_ip, count(DISTINCT CAST(t AS DATE)) AS n FROM good WHERE src_ip IS NOT NULL GROUP BY 1)"))
def ip_persistence(spark, d):
    return views.persistence(parsed(spark, d))


def _backtest_sql():
    from logmill.plans.detection import BASE_SQL, VOTE_SQL

    return expected(f""", {BASE_SQL}, {VOTE_SQL}, po(policy, zt, fl, ag) AS (VALUES ('z2.5', 2.5, 0.0, FALSE), ('z5', 5.0, 0.0, FALSE), ('agree', 2.5, 0.0, TRUE), ('agree+floor', 2.5, 0.25, TRUE)),
        pw AS (SELECT policy, window_start, ag, forest_vote, bool_or(abs(z) > zt AND abs(value - mean) > CASE WHEN fl > 0 THEN greatest(1.0, abs(mean) * fl) ELSE -1 END) AS f FROM sc JOIN vt USING (window_start), po GROUP BY ALL)
        SELECT policy, count(*) FILTER (CASE WHEN ag THEN f AND forest_vote ELSE f OR forest_vote END) AS alerts FROM pw GROUP BY 1""")


@query(_backtest_sql())
def policy_backtest(spark, d):
    from logmill.operators import anomaly
    from logmill.plans.detection import by_hour, votes

    w = snapshot(by_hour(spark, d))
    policies = spark.createDataFrame([("z2.5", 2.5, 0.0, False), ("z5", 5.0, 0.0, False), ("agree", 2.5, 0.0, True), ("agree+floor", 2.5, 0.25, True)], "policy string, z_threshold double, floor double, agree boolean")
    return views.backtest(anomaly.scored(w, anomaly.fit(w)), votes(w), policies)


SCOPE = "CASE WHEN starts_with(src_ip, '10.') THEN 'yerel' ELSE 'harici' END"


@query(expected(f"SELECT src_ip, {SCOPE} AS scope, count(*) AS n FROM good WHERE src_ip IS NOT NULL GROUP BY ALL"))
def ip_scope(spark, d):
    return parsed(spark, d).where("src_ip is not null").groupBy("src_ip").agg(F.count("*").alias("n")).select("src_ip", privacy.ip_scope(F.col("src_ip")).alias("scope"), "n")


@query(expected(f"SELECT '::ffff:' || src_ip AS address, {SCOPE} AS scope FROM good WHERE src_ip IS NOT NULL UNION SELECT '2002:' || src_port || '::' || src_ip, 'yerel' FROM good WHERE src_port < 10000 AND src_ip IS NOT NULL UNION SELECT '2a00::' || src_ip || '%eth0', 'harici' FROM good WHERE src_ip IS NOT NULL"))
def ip_scope_v6(spark, d):
    """Addresses in several IPv6 forms: mapped, with a special prefix, and with a zone."""
    e, ip = parsed(spark, d).where("src_ip is not null"), F.col("src_ip")
    forms = F.array(F.concat(F.lit("::ffff:"), ip), F.when(F.col("src_port") < 10_000, F.concat(F.lit("2002:"), F.col("src_port"), F.lit("::"), ip)), F.concat(F.lit("2a00::"), ip, F.lit("%eth0")))
    return e.select(F.explode(F.array_compact(forms)).alias("address")).distinct().select("address", privacy.ip_scope(F.col("address")).alias("scope"))


def scoped(spark, d, column):
    """A scope for each host, positions by line."""
    return parsed(spark, d).where("source <> 'nginx_access'").select(F.col("host").alias("scope_id"), F.col("line_id").alias("position"), F.col(column).alias("value"))


def label_sql(column, prefix, more="TRUE", suffix=""):
    return f"SELECT host AS scope_id, v AS value, '{prefix}' || row_number() OVER (PARTITION BY host ORDER BY p, v) {suffix} AS label FROM (SELECT host, {column} AS v, min(event_id) AS p FROM good WHERE source <> 'nginx_access' AND {column} IS NOT NULL AND {more} GROUP BY ALL)"


IP_SQL = label_sql("src_ip", "IP_", suffix="|| CASE WHEN starts_with(v, '10.') THEN ' (yerel)' ELSE ' (harici)' END")


@query(expected(IP_SQL))
def ip_labels(spark, d):
    return privacy.ip_labels(scoped(spark, d, "src_ip"))


@query(expected(label_sql('"user"', "USER_")))
def user_labels(spark, d):
    return privacy.user_labels(scoped(spark, d, "user").union(scoped(spark, d, "user").withColumn("value", F.lit("Root"))))


@query(expected(label_sql('"user"', "USER_", "\"user\" NOT IN ('u1', 'u2', 'u3')") + " UNION ALL SELECT DISTINCT host, \"user\", \"user\" FROM good WHERE source <> 'nginx_access' AND \"user\" IN ('u1', 'u2', 'u3')"))
def disclosed_labels(spark, d):
    values = snapshot(scoped(spark, d, "user"))
    return privacy.user_labels(values, values.where(F.col("value").isin("u1", "u2", "u3")).select("scope_id", "value"))


def all_labels(spark, d):
    return privacy.ip_labels(scoped(spark, d, "src_ip")).withColumn("kind", F.lit("ip")).unionByName(privacy.user_labels(scoped(spark, d, "user")).withColumn("kind", F.lit("user")))


@query(expected(f"SELECT *, 'ip' AS kind FROM ({IP_SQL}) UNION ALL SELECT *, 'user' AS kind FROM ({label_sql(chr(34) + 'user' + chr(34), 'USER_')})"))
def label_map(spark, d):
    return all_labels(spark, d)


@query(expected("SELECT host AS scope_id, count(DISTINCT src_ip) AS ips, count(DISTINCT \"user\") AS users, FALSE AS disclosed FROM good WHERE source <> 'nginx_access' GROUP BY 1"))
def label_summary(spark, d):
    return privacy.summary(all_labels(spark, d))


DOC_IPS = f"list_filter(regexp_extract_all(text, '{privacy.LOOSE}'), lambda x: regexp_matches(x, '{privacy.IPV4}') OR regexp_matches(x, '^(?:{privacy.H}:){{7}}{privacy.H}$') OR (length(x) - length(replace(x, ':', '')) <= 7 AND regexp_matches(x, '^(?:{privacy.H}(?::{privacy.H})*)?::(?:{privacy.H}(?::{privacy.H})*)?$')))"


@query(f"SELECT doc_id, CAST(coalesce(len({DOC_IPS}), 0) AS BIGINT) AS addresses, coalesce(array_to_string({DOC_IPS}, ' '), '') AS found, CAST(0 AS BIGINT) AS left_over FROM documents")
def scrub_ips_docs(spark, d):
    text = F.coalesce("text", F.lit(""))
    gone = privacy.replace_ips(text, lambda v: F.lit("IP"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.size(privacy.found_ips(text)).cast("long").alias("addresses"), F.array_join(privacy.found_ips(text), " ").alias("found"), F.size(privacy.found_ips(gone)).cast("long").alias("left_over"))


def message_sql(u, ip, dst):
    """The scrubbed message of a row of good with these labels."""
    packet = f"'IN=eth0 OUT= SRC=' || {ip} || ' DST=' || {dst} || ' LEN=60 PROTO=TCP SPT=' || port || ' DPT=' || (k + 20) || ' LEN=40'"
    return f"""CASE kind WHEN 'click' THEN click_message
        WHEN 'error' THEN CASE WHEN k % 10 <= 6 THEN 'Failed password for ' || CASE WHEN k % 10 > 4 THEN 'invalid user ' ELSE '' END || {u} || ' from ' || {ip} || ' port ' || port || ' ssh2' WHEN k % 10 = 7 THEN 'Invalid user ' || {u} || ' from ' || {ip} || ' port ' || port
            WHEN k % 10 = 8 THEN 'pam_unix(sshd:auth): authentication failure; logname= uid=0 euid=0 tty=ssh ruser= rhost=' || {ip} || ' user=' || {u} ELSE 'Connection closed by authenticating user ' || {u} || ' ' || {ip} || ' port ' || port || ' [preauth]' END
        WHEN 'purchase' THEN {u} || CASE WHEN k % 10 < 9 THEN ' : TTY=pts/0 ; PWD=<gizlendi> ; USER=root ; COMMAND=apt' ELSE ' : 3 incorrect password attempts ; TTY=pts/0 ; PWD=<gizlendi> ; USER=root ; COMMAND=sh' END
        WHEN 'signup' THEN CASE WHEN k % 10 < 8 THEN 'Accepted publickey for ' || {u} || ' from ' || {ip} || ' port ' || port || ' ssh2' ELSE 'new user: name=' || {u} || ', UID=1001, GID=1001, home=/home/' || {u} END
        ELSE CASE WHEN k % 2 = 0 THEN '[UFW BLOCK] ' || {packet} WHEN k % 10 = 1 THEN '[UFW AUDIT] ' || {packet} ELSE 'Started unit' || k || '.service' END END"""


def numbers_sql(scope, values, prefix):
    """scope, v and its label l of values (scope, v, p)."""
    kind = "|| CASE WHEN starts_with(v, '10.') THEN ' (yerel)' ELSE ' (harici)' END" if prefix == "IP_" else ""
    return f"(SELECT {scope}, v, '{prefix}' || row_number() OVER (PARTITION BY {scope} ORDER BY min(p), v) {kind} AS l FROM ({values}) WHERE v IS NOT NULL GROUP BY {scope}, v)"


@query(expected(f""", il AS {numbers_sql("host", "SELECT host, src_ip AS v, event_id * 2 AS p FROM good WHERE kind <> 'click' UNION ALL SELECT host, dst_ip, event_id * 2 + 1 FROM good", "IP_")},
    ul AS {numbers_sql("host", "SELECT host, u AS v, event_id AS p FROM good WHERE kind IN ('error', 'signup', 'purchase')", "USER_")}
    SELECT event_id AS line_id, {message_sql("ul.l", "sl.l", "dl.l")} AS message_scrubbed FROM good LEFT JOIN ul ON good.host = ul.host AND u = ul.v LEFT JOIN il AS sl ON good.host = sl.host AND src_ip = sl.v LEFT JOIN il AS dl ON good.host = dl.host AND dst_ip = dl.v"""))
def scrub_messages(spark, d):
    rows = snapshot(parsed(spark, d).select(F.col("host").alias("scope_id"), F.col("line_id").alias("row_id"), "message"))
    return privacy.scrub(rows, "message")[0].select(F.col("row_id").alias("line_id"), "message_scrubbed")


@query(expected(""", f AS (SELECT host, u, min(event_id) AS p FROM good WHERE source = 'auth' AND kind = 'purchase' GROUP BY ALL), l AS (SELECT host, u, 'USER_' || row_number() OVER (PARTITION BY host ORDER BY p, u) AS label FROM f)
    SELECT good.event_id AS line_id, 'session closed for user ' || label AS message_scrubbed FROM good JOIN l USING (host, u) WHERE event_type = 'sudo_command'"""))
def scrub_scope(spark, d):
    """A line that no pattern reads: its name is known from the scope's other lines."""
    sudo = snapshot(parsed(spark, d).where(F.col("process") == "sudo").select(F.col("host").alias("scope_id"), F.col("line_id").alias("row_id"), "event_type", "message", "user"))
    closed = sudo.where("event_type = 'sudo_command'").select("scope_id", (F.col("row_id") + (1 << 40)).alias("row_id"), F.concat(F.lit("session closed for user "), "user").alias("message"))
    out = privacy.scrub(sudo.select("scope_id", "row_id", "message").unionByName(closed), "message")[0]
    return out.where(F.col("row_id") >= 1 << 40).select((F.col("row_id") - (1 << 40)).alias("line_id"), "message_scrubbed")


@query(with_alerts(f""", bn AS (SELECT alert_id, good.*, row_number() OVER (PARTITION BY alert_id ORDER BY t DESC, event_id) AS nth FROM br JOIN good USING (event_id) QUALIFY nth <= 10),
    il AS {numbers_sql("alert_id", "SELECT id AS alert_id, src_ip AS v, 0 AS p FROM al UNION ALL SELECT alert_id, src_ip, nth FROM bn", "IP_")},
    ul AS {numbers_sql("alert_id", "SELECT id AS alert_id, CASE WHEN gb = 'user' THEN group_value END AS v, 0 AS p FROM al UNION ALL SELECT alert_id, " + '"user"' + ", nth FROM bn", "USER_")},
    bl AS (SELECT bn.alert_id, string_agg('  - [' || severity || '] ' || event_type || ' | IP: ' || coalesce(il.l, 'N/A') || ' | User: ' || coalesce(ul.l, 'N/A') || ' | Time: ' || strftime(t, '%Y-%m-%d %H:%M:%S') || ' | ' || {message_sql("ul.l", "il.l", "''")}, chr(10) ORDER BY nth) AS x
        FROM bn LEFT JOIN il ON bn.alert_id = il.alert_id AND src_ip = il.v LEFT JOIN ul ON bn.alert_id = ul.alert_id AND "user" = ul.v GROUP BY 1)
    SELECT id AS alert_id, c AS n_events, coalesce(il.l, 'N/A') AS ip_label, CASE WHEN "user" IS NULL THEN 'N/A' ELSE ul.l END AS user_label,
        rule_title || ': ' || c || ' events detected from ' || gb || '=' || CASE gb WHEN 'user' THEN ul.l ELSE il.l END || ' in last ' || tf AS message_scrubbed, x || CASE WHEN c > 10 THEN chr(10) || '  ... ve ' || (c - 10) || ' event daha' ELSE '' END AS lines
    FROM al JOIN bl ON bl.alert_id = id LEFT JOIN il ON il.alert_id = id AND src_ip = il.v LEFT JOIN ul ON ul.alert_id = id AND gb = 'user' AND group_value = ul.v"""))
def alert_brief(spark, d):
    e = event_table(spark, d)
    a = snapshot(raised(e))
    return briefs.briefs(a, snapshot(views.events_of(a.select(F.col("id").alias("alert_id")), bridge(e, a), e)))


@query(with_alerts(f"SELECT * FROM (SELECT count(*) AS events, count(*) FILTER (t >= {NOW} - INTERVAL 24 HOUR) AS events_24h, count(*) FILTER (t >= {NOW} - INTERVAL 1 HOUR) AS events_1h FROM good), (SELECT count(*) AS alerts, count(*) FILTER (status = 'new') AS new_alerts FROM al)"))
def situation_context(spark, d):
    e = event_table(spark, d)
    return briefs.situation(e, raised(e), as_of())


@query(with_alerts(""", q AS (SELECT DISTINCT src_ip FROM good WHERE src_ip IS NOT NULL),
    o AS (SELECT good.* FROM good JOIN q USING (src_ip)), ty AS (SELECT src_ip, event_type, count(*) AS n FROM o GROUP BY ALL),
    rk AS (SELECT src_ip, event_id, row_number() OVER (PARTITION BY src_ip ORDER BY t DESC, event_id DESC) AS r FROM o)
    SELECT src_ip, (SELECT count(*) FROM o WHERE o.src_ip = q.src_ip) AS total, (SELECT string_agg(event_type || '=' || n, ',' ORDER BY n DESC, event_type) FROM ty WHERE ty.src_ip = q.src_ip) AS types,
        (SELECT count(*) FROM al WHERE al.src_ip = q.src_ip) AS n_alerts, (SELECT string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY r) FROM rk WHERE rk.src_ip = q.src_ip AND r <= 5) AS last_events FROM q"""))
def ip_dossier(spark, d):
    e = event_table(spark, d)
    questions = e.where("src_ip is not null").select(F.col("line_id").alias("question_id"), F.concat(F.lit("What did "), "src_ip", F.lit(" do? 999.1.1.1 at 14:23:01")).alias("text"))
    return briefs.dossiers(briefs.asked_ips(questions, "question_id", "text").select("src_ip").distinct(), e, raised(e))


@query(with_alerts(f""", da AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, id) AS nth FROM al QUALIFY nth <= 5),
    dt AS (SELECT src_ip, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, src_ip) AS nth FROM good WHERE {RECENT} AND src_ip IS NOT NULL GROUP BY src_ip QUALIFY nth <= 5),
    de AS (SELECT *, row_number() OVER (ORDER BY t DESC, event_id) AS nth FROM good QUALIFY nth <= 10),
    il AS {numbers_sql("z", "SELECT 1 AS z, src_ip AS v, nth AS p FROM da UNION ALL SELECT 1, src_ip, nth + 5 FROM dt UNION ALL SELECT 1, src_ip, nth + 10 FROM de", "IP_")},
    ul AS {numbers_sql("z", "SELECT 1 AS z, CASE WHEN gb = 'user' THEN group_value END AS v, nth AS p FROM da UNION ALL SELECT 1, " + '"user"' + ", nth + 10 FROM de", "USER_")}
    SELECT 'alert' AS part, nth, '  - [' || severity || '] ' || rule_title || ' | IP: ' || coalesce(il.l, 'N/A') || ' | Status: ' || status || ' | ' || left(rule_title || ': ' || c || ' events detected from ' || gb || '=' || CASE gb WHEN 'user' THEN ul.l ELSE il.l END || ' in last ' || tf, 100) AS text
        FROM da LEFT JOIN il ON src_ip = il.v LEFT JOIN ul ON gb = 'user' AND group_value = ul.v
    UNION ALL SELECT 'ip', nth, '  - ' || il.l || ': ' || n || ' event' FROM dt JOIN il ON src_ip = il.v
    UNION ALL SELECT 'event', nth, '  - [' || severity || '] ' || source || '/' || event_type || ' | IP: ' || coalesce(il.l, 'N/A') || ' | User: ' || coalesce(ul.l, 'N/A') || ' | ' || strftime(t, '%Y-%m-%d %H:%M:%S') FROM de LEFT JOIN il ON src_ip = il.v LEFT JOIN ul ON "user" = ul.v
    UNION ALL SELECT 'severity', 0, severity || ': ' || count(*) FROM good WHERE {RECENT} GROUP BY severity"""))
def recent_digest(spark, d):
    e = event_table(spark, d)
    return briefs.digest(raised(e), e, as_of(), hours=96)


@query(with_alerts("SELECT id, CASE WHEN c % 2 = 0 AND (llm_analysis = '' OR severity = 'high') THEN 'fresh' ELSE llm_analysis END AS llm_analysis, llm_analysis = '' OR severity = 'high' AS was_queued FROM al"))
def analysis_queue(spark, d):
    a = alerts_of(spark, d)
    queue = briefs.analysis_queue(a, a.where("severity = 'high'").select("id"))
    results = queue.select("id", (F.col("count") % 2 == 0).alias("ok"), F.lit("fresh").alias("text"))
    return briefs.store_analyses(a, results).join(queue.select("id", F.lit(True).alias("q")), "id", "left").select("id", "llm_analysis", F.coalesce("q", F.lit(False)).alias("was_queued"))


@query(with_alerts("SELECT id, unnest(CASE severity WHEN 'critical' THEN ['dashboard', 'email', 'telegram', 'sms'] WHEN 'high' THEN ['dashboard', 'email', 'telegram'] WHEN 'medium' THEN ['dashboard', 'email'] ELSE ['dashboard'] END) AS channel FROM al"))
def route_outbox(spark, d):
    return routing.outbox(alerts_of(spark, d)).select("id", "channel")


@query(with_alerts("""SELECT id, CASE severity WHEN 'critical' THEN '🔴' WHEN 'high' THEN '🟠' WHEN 'medium' THEN '🟡' WHEN 'low' THEN '🔵' ELSE '⚪' END || ' <b>Alert</b>' || chr(10) || chr(10) || '<b>Rule:</b> ' || rule_title || chr(10) || '<b>Severity:</b> ' || upper(severity) || chr(10)
    || '<b>Source IP:</b> <code>' || coalesce(src_ip, 'N/A') || '</code>' || chr(10) || chr(10) || '<b>Details:</b>' || chr(10) || message || chr(10) || CASE WHEN tags <> '' THEN chr(10) || '🏷 ' || replace(tags, ',', ', ') ELSE '' END || chr(10) || chr(10) || '<i>Alert ID: ' || left(id, 8) || '...</i>' AS text FROM al"""))
def notify_text(spark, d):
    return alerts_of(spark, d).select("id", routing.notify_text().alias("text"))


@query(with_alerts("""SELECT id, replace(replace(replace(replace(template, '{count}', CAST(c AS VARCHAR)), '{src_ip}', coalesce(src_ip, 'N/A')), '{user}', coalesce("user", 'N/A')), '{timeframe}', tf) AS text FROM al"""))
def template_message(spark, d):
    return alerts_of(spark, d).select("id", routing.template_message().alias("text"))


@query("SELECT doc_id, left(text, 4096) AS text FROM documents")
def clip_fields(spark, d):
    return routing.clip(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))
