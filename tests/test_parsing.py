"""Parsers, stamps and the line sources against hand-written values."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logmill.functions.stamps import access_stamp, bsd_stamp, duration_seconds, iso_stamp
from logmill.operators.parse import parse_access, parse_auth, parse_lines, parse_syslog, parser_for
from logmill.operators.rules import seconds
from logmill.sources.lines import load_sources, not_ignored, read_text, tidy
from logmill.streaming.streams import run

NOW = "2026-10-12 16:15:00"
AUTH = [
    "2026-10-04T13:11:41.024533702+02:00 vmi1 sshd[3896287]: Failed password for root from 109.160.32.116 port 51012 ssh2",
    "Oct  4 13:11:41 vps sshd[123]: Invalid user admin from 1.2.3.4",
    "2026-10-04T13:11:41Z vps sshd-session[9]: Accepted publickey for maria from 2001:db8::1 port 22 ssh2",
    "2026-10-04T13:11:41Z vps sudo: maria : TTY=pts/0 ; PWD=/home/maria ; USER=root ; COMMAND=/usr/bin/apt update",
    "2026-10-04T13:11:41Z vps sudo:   maria : user NOT in sudoers ; TTY= ; PWD=/ ; USER=root ; COMMAND=/bin/sh",
    "2026-10-04T13:11:41Z vps useradd[7]: new user: name=bob, UID=1001",
    "2026-10-04T13:11:41Z vps sshd[1]: pam_unix(sshd:auth): authentication failure; logname= rhost=5.6.7.8  user=root",
    "2026-10-04T13:11:41Z vps sshd[1]: Connection closed by 1.2.3.4 port 23054",
    "2026-10-04T13:11:41Z vps CRON[5]: session opened",
    "no frame at all",
]


def now():
    return F.to_timestamp(F.lit(NOW))


def table(spark, values, source="auth"):
    return spark.createDataFrame([(i, source, v) for i, v in enumerate(values)], "line_id long, source string, value string")


def test_auth_lines(spark):
    rows = {r.line_id: r for r in parse_auth(table(spark, AUTH), now()).collect()}
    assert 9 not in rows and len(rows) == 9
    assert [(rows[i].event_type, rows[i].severity) for i in range(9)] == [
        ("auth_failure", "medium"), ("auth_failure", "medium"), ("auth_success", "info"), ("sudo_command", "low"), ("sudo_failure", "high"),
        ("user_added", "medium"), ("auth_failure", "medium"), ("connection_closed", "low"), ("auth_other", "info"),
    ]
    assert (rows[0].host, rows[0].process, rows[0].pid, rows[0].user, rows[0].src_ip, rows[0].src_port) == ("vmi1", "sshd", 3896287, "root", "109.160.32.116", 51012)
    assert rows[0].timestamp == datetime(2026, 10, 4, 11, 11, 41, 24533)
    assert (rows[1].user, rows[1].src_port, rows[1].extra.auth_method) == ("admin", None, "invalid_user")
    assert rows[2].src_ip == "2001:db8::1" and rows[3].extra.command == "/usr/bin/apt update" and rows[4].extra.reason == "user NOT in sudoers"
    assert rows[5].user == "bob" and rows[6].src_ip == "5.6.7.8" and rows[7].user is None


def test_access_lines(spark):
    values = ['1.2.3.4 - - [09/Jun/2026:14:23:01 +0300] "GET /WP-admin/x HTTP/1.1" 404 12 "-" "Mozilla"', '1.2.3.4 - bob [09/Jun/2026:14:23:01 +0300] "GET / HTTP/1.1" 502 - "http://r" "Mozilla"', "junk", '::1 - - [bad] "GET / HTTP/1.1" 200 5']
    rows = {r.line_id: r for r in parse_access(table(spark, values, "nginx_access"), now()).collect()}
    assert sorted(rows) == [0, 1, 3]
    assert rows[0].extra.is_suspicious is True and rows[0].extra.http_status == 404 and rows[0].severity == "low" and rows[0].timestamp == datetime(2026, 6, 9, 11, 23, 1)
    assert (rows[1].user, rows[1].severity, rows[1].extra.http_size, rows[1].extra.is_suspicious, rows[1].message) == ("bob", "medium", 0, False, "GET / → 502")
    assert rows[3].extra.is_suspicious is True and rows[3].timestamp == datetime.fromisoformat(NOW)


def test_firewall_last_key_wins(spark):
    values = ["Oct 12 16:00:00 vps kernel: [UFW BLOCK] IN=eth0 OUT= SRC=9.9.9.9 SRC=1.2.3.4 DST=10.0.0.1 SPT=x DPT=22 PROTO=TCP", "Oct 12 16:00:00 vps kernel: [UFW AUDIT] IN=", "Oct 12 16:00:00 vps systemd[1]: Started x"]
    rows = parse_syslog(table(spark, values, "syslog"), now()).orderBy("line_id").collect()
    assert (rows[0].event_type, rows[0].src_ip, rows[0].src_port, rows[0].dst_port, rows[0].extra.interface_out) == ("firewall_block", "1.2.3.4", None, 22, "")
    assert (rows[1].event_type, rows[1].src_ip, rows[2].event_type) == ("firewall_audit", None, "service_event")


@pytest.mark.parametrize(
    ("text", "at", "zone", "want"),
    [
        ("Oct 12 18:15:14", "2026-10-12 16:15:00", "+02:00", "2026-10-12 16:15:14"), ("Oct 12 18:15:14", "2026-10-12 16:15:00", "+03:00", "2026-10-12 15:15:14"),
        ("Dec 31 23:59:59", "2027-01-01 00:05:00", "UTC", "2026-12-31 23:59:59"), ("Feb 29 10:00:00", "2028-03-01 00:00:00", "UTC", "2028-02-29 10:00:00"),
        ("Feb 29 10:00:00", "2029-01-10 00:00:00", "UTC", "2028-02-29 10:00:00"), ("Feb 31 10:00:00", "2029-01-10 00:00:00", "UTC", "2029-01-10 00:00:00"), ("Oct  4 13:11:41", "2026-10-12 16:15:00", "UTC", "2026-10-04 13:11:41"),
    ],
)
def test_old_stamps(spark, text, at, zone, want):
    row = spark.createDataFrame([(text,)], "v string").select(bsd_stamp(F.col("v"), F.to_timestamp(F.lit(at)), zone).alias("t")).first()
    assert row.t == datetime.fromisoformat(want)


def test_iso_and_access_stamps(spark):
    values = ["2026-06-09T14:23:01Z", "2026-06-09T14:23:01.123456789+0200", "2026-06-09T14:23:01", "2026-13-40T99:00:00Z", "", "never"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(iso_stamp(F.col("v"), now()).alias("t")).collect()
    bad = datetime.fromisoformat(NOW)
    assert [r.t for r in rows] == [datetime(2026, 6, 9, 14, 23, 1), datetime(2026, 6, 9, 12, 23, 1, 123456), datetime(2026, 6, 9, 14, 23, 1), bad, bad, bad]
    assert spark.range(1).select(access_stamp(F.lit("nope"), now()).alias("t")).first().t == bad


def test_durations(spark):
    values = ["5m", "30s", "2h", "1d", "7x", "", "m", None, "abc"]
    want = [300, 30, 7200, 86400, 420, 300, 300, 300, 300]
    assert [seconds(v) for v in values] == want
    assert [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(duration_seconds(F.col("v"))).collect()] == want


def test_sources(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\n\n  \ntwo \xff\nnoise casaos x\n")
    source = {"name": "s", "type": "syslog", "path": str(tmp_path / "a.log"), "ignore": [r"\bcasaos\b", "never"]}
    rows = not_ignored(read_text(spark, source), [source]).collect()
    assert [r.value for r in rows] == ["one", "two �"]
    assert tidy(table(spark, ["x\r", " ", ""])).count() == 1
    config = [source, source | {"name": "off", "enabled": False}]
    assert [s["path"] for s in load_sources(config, ["p"])] == ["p"] and [s["path"] for s in load_sources(config, ["p", "q"])] == [source["path"]]
    assert parser_for("syslog", "my_auth") is parse_auth and parser_for("other", "x") is None
    with pytest.raises(ValueError):
        parse_lines(table(spark, ["x"]), [{"name": "x", "type": "other"}], now())


def test_a_stream_from_the_start_or_the_present(spark, tmp_path):
    """A stream reads each file once; with since it leaves out what was there before."""
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text("old 1\nold 2\n")
    os.utime(logs / "a.log", (1_700_000_000, 1_700_000_000))
    source = {"name": "s", "type": "syslog", "path": str(logs)}
    since = F.timestamp_seconds(F.lit(1_700_000_060))

    def arrived(name, **more):
        return sorted(r.value for r in run(read_text(spark, source, stream=True, **more), str(tmp_path / name)).collect())

    assert arrived("all") == ["old 1", "old 2"] and arrived("new", since=since) == []
    (logs / "b.log").write_text("new 1\n\n")
    os.utime(logs / "b.log", (1_700_000_060, 1_700_000_060))
    assert arrived("all") == ["new 1", "old 1", "old 2"] and arrived("new", since=since) == ["new 1"]
    assert sorted(r.value for r in read_text(spark, source, since=since).collect()) == ["new 1"]


def test_stamps_without_offset_mean_utc_in_any_session(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        got = spark.range(1).select(*[F.unix_timestamp(f).alias(n) for n, f in {"iso": iso_stamp(F.lit("2024-01-31T10:00:00.5"), now()), "offset": iso_stamp(F.lit("2024-01-31T10:00:00+02:00"), now()), "bsd": bsd_stamp(F.lit("Jan  9 10:00:00"), now()), "zone": bsd_stamp(F.lit("Jan  9 10:00:00"), now(), "Europe/Berlin")}.items()]).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got.asDict() == {"iso": 1706695200, "offset": 1706688000, "bsd": 1767952800, "zone": 1767949200}


def test_lines_with_breaks_inside(spark):
    line = "2024-01-31T10:00:00Z vps1 sshd[7]: Failed password for root from 1.2.3.4 port 22 ssh2"
    odd = [line + "\n", "\n" + line, line.replace("vps1 ", "vps1 \n"), "a\nb\nc\nd\ne\nf", None, ""]
    assert [r.user for r in parse_auth(table(spark, odd), now()).collect()] == ["root", "root"]
    access = '1.2.3.4 - - [31/Jan/2024:10:00:00 +0000] "GET / HTTP/1.1" 200 5 "-" "curl/8"'
    assert parse_access(table(spark, [access, access + " more", access + "\n", None], "nginx_access"), now()).count() == 2
