"""What the registered queries share: the registry, the parsed events, test rules and the alerts they raise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.operators.parse import parse_lines
from logmill.operators.rules import Rule, alerts, evidence
from logmill.session import shared_dir
from logmill.sources.lines import SOURCES, not_ignored
from logmill.plans.synth import EXPECTED, as_of, read_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Thresholds that fit the density of the test tables.
TEST_RULES = (
    Rule("rule-t1", "Failed logins", {"event_type": "auth_failure", "process": "sshd"}, "selection | count(src_ip) > 2", "high", "7d", None, ("attack.credential_access", "attack.t1110"), message="{count} failed logins from {src_ip} in {timeframe}"),
    Rule("rule-t2", "Web scan", {"event_type": "http_request", "is_suspicious": "true"}, "selection | count(src_ip) > 4", "medium", "7d", None, ("attack.reconnaissance", "attack.t1595"), message="Web scan: {count} requests from {src_ip}"),
    Rule("rule-t3", "Sudo", {"event_type": "sudo_command"}, "selection | count(user) >= 5", "high", "7d", None, ("attack.privilege_escalation", "attack.t1548"), message="{count} commands by {user}"),
    Rule("rule-t4", "New account", {"event_type": "user_added"}, "selection | count(user) > 0", "critical", "3d", "24h", ("attack.persistence", "attack.t1136", "attack.t1136.001"), message="New account {user}"),
    Rule("rule-t5", "Named requests", {"event_type": "http_request"}, "selection | count(user) > 20", "low", "7d", None, (), message="Requests by {user}"),
)
CONDITIONS = {
    "rule-t1": ("event_type = 'auth_failure' AND process = 'sshd'", "c > 2", 7), "rule-t2": ("is_suspicious", "c > 4", 7), "rule-t3": ("event_type = 'sudo_command'", "c >= 5", 7),
    "rule-t4": ("event_type = 'user_added'", "c > 0", 3), "rule-t5": ("event_type = 'http_request'", "c > 20", 7),
}
NOW = "TIMESTAMP '2024-02-01 00:00:00'"

#: tg: events by rule and group; al: the alerts; br: the bridge.
ALERTS_SQL = f"""{EXPECTED},
tg AS ({" UNION ALL ".join(f"SELECT '{r.id}' AS rule_id, {'"user"' if r.group_by == 'user' else r.group_by} AS g, event_id FROM good WHERE {CONDITIONS[r.id][0]} AND t >= {NOW} - INTERVAL {CONDITIONS[r.id][2]} DAY" for r in TEST_RULES)}),
gc AS (SELECT rule_id, g, count(*) AS c FROM tg GROUP BY ALL),
rl(rule_id, rule_title, severity, tf, gb, tags, template) AS (VALUES {", ".join(f"('{r.id}', '{r.title}', '{r.level}', '{r.timeframe}', '{r.group_by}', '{','.join(r.tags)}', '{r.message}')" for r in TEST_RULES)}),
al AS (SELECT sha256(gc.rule_id || chr(31) || coalesce(g, 'None') || chr(31) || '2024-02-01 00:00:00') AS id, gc.rule_id, rule_title, severity, tf, gb, tags, template, c, coalesce(g, 'None') AS group_value,
        rule_title || ': ' || c || ' events detected from ' || gb || '=' || coalesce(g, 'None') || ' in last ' || tf AS message,
        CASE WHEN gb = 'src_ip' THEN g END AS src_ip, CASE WHEN gb = 'user' THEN g END AS "user",
        ['new', 'acknowledged', 'resolved', 'false_positive'][c % 4 + 1] AS status, CASE WHEN c % 3 = 0 THEN 'seen' ELSE '' END AS llm_analysis, {NOW} - c * INTERVAL 30 DAY AS created_at
    FROM gc JOIN rl USING (rule_id) WHERE CASE rule_id {" ".join(f"WHEN '{k}' THEN {v[1]}" for k, v in CONDITIONS.items())} END),
br AS (SELECT id AS alert_id, event_id FROM tg JOIN al ON tg.rule_id = al.rule_id AND coalesce(tg.g, 'None') = al.group_value)"""


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, sf_dir) under its name or another, with its SQL."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def expected(select: str) -> str:
    return f"WITH {EXPECTED} {select}"


def with_alerts(select: str) -> str:
    return f"WITH {ALERTS_SQL} {select}"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_lines(spark, sf_dir)


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of all lines that aren't ignored."""
    return parse_lines(not_ignored(lines(spark, sf_dir), SOURCES), SOURCES, as_of())


def raised(events: DataFrame) -> DataFrame:
    """Alerts of the test rules, with a status, an analysis and an age that depend on their count."""
    a = alerts(events, TEST_RULES, as_of())
    c = F.col("count").cast("int")
    return a.withColumns({"status": F.element_at(F.array(*map(F.lit, ("new", "acknowledged", "resolved", "false_positive"))), c % 4 + 1), "llm_analysis": F.when(c % 3 == 0, "seen").otherwise(""), "created_at": as_of() - F.make_dt_interval(c * 30)})


def bridge(events: DataFrame, found: DataFrame) -> DataFrame:
    return evidence(events, TEST_RULES, found, as_of())


def snapshot(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, so that what follows doesn't repeat its plan."""
    path = f"{shared_dir(df.sparkSession)}/snapshot"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def event_table(spark: SparkSession, sf_dir: str, lean: bool = False) -> DataFrame:
    """The parsed events as a stored table, for queries that read them more than once; lean ones are without their texts."""
    events = parsed(spark, sf_dir)
    return snapshot(events.drop("raw", "message") if lean else events)
