"""Queries that run streams over what has arrived and return their tables; their SQL is the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from logmill.operators.parse import parse_lines
from logmill.operators.rules import Rule, tagged
from logmill.plans import ingest  # noqa: F401  whose SQL is used here too
from logmill.plans.base import NOW, ORACLE_SQL, TEST_RULES, as_of, expected, query, shared_dir, with_alerts
from logmill.plans.detection import features_sql, fold_sql, recursive
from logmill.session import ship
from logmill.sources.lines import SOURCES, not_ignored
from logmill.plans.synth import lines
from logmill.streaming import streams

#: Windows are given out once the watermark, an hour behind the newest event, has passed their end.
CLOSED = "window_start + {span} <= (SELECT max(t_s) - 3600 FROM {source})"


def stream(spark, d):
    """Parsed events as they arrive; all files are one batch, since a second would have late rows where files overlap in time.

    The path is a pattern, since the table can be one file or a folder.
    """
    return parse_lines(not_ignored(lines(streams.read_stream(spark, f"{d}/events.parque[t]")), SOURCES), SOURCES, as_of())


@query(expected("SELECT event_id AS line_id, event_type, t_s FROM good"))
def stream_ingest(spark, d):
    return streams.run(stream(spark, d).select("line_id", "event_type", F.unix_timestamp("timestamp").alias("t_s")), shared_dir(spark))


@query(expected(", fb AS (SELECT * FROM good WHERE event_type = 'firewall_block'), w AS (SELECT unnest([t_s // 43200 * 43200, t_s // 43200 * 43200 - 43200]) AS window_start, src_ip AS group_value FROM fb), c AS (SELECT window_start, 'rule-s' AS rule_id, group_value, count(*) AS count FROM w GROUP BY ALL HAVING count(*) > 1) SELECT * FROM c WHERE " + CLOSED.format(span=86400, source="fb")))
def stream_rule_counts(spark, d):
    hits = stream(spark, d).where("event_type = 'firewall_block'").select("timestamp", F.lit("rule-s").alias("rule_id"), F.col("src_ip").alias("group_value"))
    return streams.run(streams.threshold_counts(hits, "1 day", "12 hours", 1), shared_dir(spark))


#: Rules with a timeframe, operator and threshold each: field in SQL, selection in SQL.
STREAM_RULES = (
    (Rule("rule-v", "Floods", {"event_type": "firewall_block"}, "selection | count(src_ip) > 1", timeframe="1d"), "src_ip", "event_type = 'firewall_block'"),
    (Rule("rule-w", "Logins", {"event_type": "auth_failure"}, "selection | count(src_ip) >= 2", timeframe="18h"), "src_ip", "event_type = 'auth_failure'"),
    (Rule("rule-x", "Single requests", {"event_type": "http_request", "http_status__gte": 500}, "selection | count(src_ip) < 2", timeframe="6h"), "src_ip", "event_type = 'http_request' AND http_status >= 500"),
    (Rule("rule-y", "Commands", {"event_type": "sudo_command"}, "selection | count(user) == 1", timeframe="12h"), '"user"', "event_type = 'sudo_command'"),
    (Rule("rule-z", "Hosts", {"is_suspicious": "true"}, "selection | count(host) <= 3", timeframe="2d"), "host", "is_suspicious"),
)
PANE = 6 * 3600
OPS = {"==": "="}
RULES_SQL = " UNION ALL ".join(f"SELECT '{r.id}' AS rule_id, {r.seconds} AS span, {g} AS group_value, t_s FROM good WHERE {sql}" for r, g, sql in STREAM_RULES)
OVER_SQL = " ".join(f"WHEN '{r.id}' THEN count(*) {OPS.get(r.op, r.op)} {r.n}" for r, *_ in STREAM_RULES)


@query(expected(f""", h AS ({RULES_SQL}), w AS (SELECT rule_id, span, group_value, unnest(range((t_s // {PANE} + 1) * {PANE}, (t_s // {PANE} + 1) * {PANE} + span, {PANE})) AS window_end FROM h)
    SELECT window_end - span AS window_start, window_end, rule_id, group_value, count(*) AS count FROM w WHERE window_end <= (SELECT max(t_s) - 3600 FROM h) GROUP BY window_end, span, rule_id, group_value HAVING CASE rule_id {OVER_SQL} END"""))
def stream_rules(spark, d):
    """Five rules in one stream, each with its own timeframe, operator and threshold."""
    rules = [r for r, *_ in STREAM_RULES]
    hits = tagged(stream(spark, d), rules, F.timestamp_seconds(F.lit(0)))
    return streams.run(streams.rule_counts(hits.select("timestamp", "rule_id", "group_value"), rules), shared_dir(spark))


@query(ORACLE_SQL["ignore_accounting"])
def stream_accounting(spark, d):
    """What became of the lines of each source, added up over the batches of a stream."""
    arriving = lines(streams.read_stream(spark, f"{d}/events.parque[t]"))
    return streams.ingest(arriving, SOURCES, as_of(), shared_dir(spark)).groupBy("source").agg(*[F.sum(c).alias(c) for c in ("ignored", "parsed", "unparsed")])


@query(recursive(f"{expected('')[5:]}, " + fold_sql("rule_id, group_value", "SELECT DISTINCT 'rule-s' AS rule_id, src_ip AS group_value, t_s AS ts FROM good WHERE event_type = 'firewall_block'", 86400) + " SELECT rule_id, group_value, fired_at FROM walk WHERE fired_at IS NOT NULL"))
def stream_cooldown(spark, d):
    hits = stream(ship(spark), d).where("event_type = 'firewall_block'").select("timestamp", F.lit("rule-s").alias("rule_id"), F.col("src_ip").alias("group_value"))
    return streams.run(streams.cooldown(hits, 86400), shared_dir(spark))


@query(expected(f", f AS ({features_sql(3600)}) SELECT * FROM f WHERE " + CLOSED.format(span=3600, source="good")))
def stream_features(spark, d):
    return streams.run(streams.features(stream(spark, d), "1 hour"), shared_dir(spark))


@query(expected("SELECT event_id AS line_id, event_type FROM good"))
def stream_dedup(spark, d):
    e = stream(spark, d).select("line_id", "event_type", "timestamp")
    twice = e.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("line_id") % 3).cast("int"))))
    return streams.run(streams.deduplicated(twice), shared_dir(spark)).select("line_id", "event_type")


@query(with_alerts("SELECT rule_id || '/' || coalesce(g, 'None') || '/' || event_id AS id, rule_id FROM tg"))
def stream_outbox(spark, d):
    hits = tagged(stream(spark, d), TEST_RULES, as_of())
    rows = hits.select(F.concat_ws("/", "rule_id", F.coalesce("group_value", F.lit("None")), F.col("line_id").cast("string")).alias("id"), "rule_id")
    return streams.outbox(rows, shared_dir(spark))
