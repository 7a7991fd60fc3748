"""Registered queries against their SQL in DuckDB, at the smallest size: some of them, or all with LOGMILL_ALL_QUERIES=1 (five minutes)."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_point
from logmill import catalog

SF = "/root/testdata/sf0.001"
SOME = ["parse_all_normalised", "envelope_roundtrip", "all_rules_alerts", "rule_replay", "feature_series_filled", "rolling_baseline", "consensus_severity", "retention_keep", "label_map", "scrub_messages", "scrub_ips_docs", "alert_brief", "recent_digest", "ignore_accounting", "poison_quarantine", "event_sink_roundtrip", "ip_dossier", "notify_text", "stream_cooldown", "stream_features", "stream_dedup", "selection_types", "rule_isolation", "rules_replay", "anomaly_messages", "retention_in_place", "ip_persistence_stored", "ip_scope_v6", "event_page_deep", "stream_rules", "stream_accounting", "stream_outbox"]


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL) if os.environ.get("LOGMILL_ALL_QUERIES") else SOME)
def test_query_against_sql(spark, duck, name):
    rows = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLE_SQL[name])
    columns = sorted(rows.columns)
    assert columns == sorted(want.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in rows.collect())
    at = [want.columns.index(c) for c in columns]
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_contract(spark):
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert len(catalog.QUERIES) > 90
    assert entry_point.entry(spark).columns[:2] == ["id", "rule_id"]
