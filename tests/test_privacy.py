"""Pseudonyms and scrubbed text."""

import ipaddress
import random

from pyspark.sql import functions as F

from logmill.operators import briefs, privacy

SUDO = "maria : TTY=pts/0 ; PWD=/home/maria ; USER=root ; COMMAND=/usr/bin/apt install /home/maria/x.deb"


def test_ip_scope(spark):
    values = ["10.0.0.5", "185.199.108.153", "127.0.0.1", "198.51.100.7", "203.0.113.9", "100.64.0.1", "192.168.1.1", "172.31.255.255", "172.32.0.0", "::1", "2001:db8::5", "2a00:1450::1", "fe80::1", "999.1.1.1", "01.2.3.4", "x", "0.0.0.0", "255.255.255.255", "240.0.0.1"]

    def want(v):
        try:
            a = ipaddress.ip_address(v)
        except ValueError:
            return "bilinmiyor"
        return "localhost" if a.is_loopback else "yerel" if a.is_private else "harici"

    values += ["::ffff:a00:1", "2001::1", "100::1", "2001:10::1", "2002::1", "64:ff9b:1::1", "192.0.0.8", "192.0.0.9", "192.0.0.170", "0::1", "::ffff:10.0.0.1", "::ffff:127.0.0.1", "::ffff:8.8.8.8", "fe80::1%eth0", "::1%lo", "1::%", "1::%a%b", "::1.2.3.4", "::1.2.3.04", "1.2.3.4::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8::", "1::2::3", ":1::", "::", ":", ":::", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "2001:1::1", "2001:1::3", "2001:3::", "2001:2f::1", "fdff::", "fe00::", "febf::1", "FE80::A", "12345::"]
    rng = random.Random(5)
    values += [":".join(rng.choice(["", "0", "1", "ffff", "2001", "fe80", "db8", "10.0.0.1", "127.0.0.1", "g"]) for _ in range(rng.randrange(2, 10))) for _ in range(1500)]
    values += [str(ipaddress.IPv6Address(rng.choice([rng.getrandbits(128), int(ipaddress.ip_address(rng.choice(["2001::", "::ffff:0:0", "64:ff9b:1::", "fc00::", "100::"]))) + rng.getrandbits(rng.randrange(128))]) % 2**128)) for _ in range(500)] + [str(ipaddress.IPv4Address(rng.choice([rng.getrandbits(32), (192 << 24) + rng.getrandbits(12), (198 << 24) + rng.getrandbits(21)]))) for _ in range(300)]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", privacy.ip_scope(F.col("v")).alias("s")).collect()
    assert {r.v: r.s for r in rows} == {v: want(v) for v in values}


def test_numbering_and_disclosure(spark):
    values = spark.createDataFrame([("s", 1, "b"), ("s", 2, "root"), ("s", 3, "a"), ("s", 4, "b"), ("s", 5, None), ("s", 6, "N/A"), ("s", 7, "USER_9"), ("t", 1, "a")], "scope_id string, position long, value string")
    assert {tuple(r) for r in privacy.user_labels(values).collect()} == {("s", "b", "USER_1"), ("s", "a", "USER_2"), ("t", "a", "USER_1")}
    shown = spark.createDataFrame([("s", "b")], "scope_id string, value string")
    assert {tuple(r) for r in privacy.user_labels(values, shown).collect()} == {("s", "b", "b"), ("s", "a", "USER_1"), ("t", "a", "USER_1")}


def test_scrub_leaks_nothing(spark):
    texts = [SUDO, "Failed password for invalid user maria from 185.199.1.2 port 22, again 185.199.1.2 at 14:23:01", "version 999.1.1.1 and 256.1.2.3.4 stay", None, "", "ali : 3 incorrect password attempts ; COMMAND= ; x", "seen at /home/zoe/y by maria and fe80::1"]
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "scope_id string, row_id long, message string")
    out, labels = privacy.scrub(df, "message")
    rows = {r.row_id: r.message_scrubbed for r in out.collect()}
    assert rows[0] == "USER_1 : TTY=pts/0 ; PWD=<gizlendi> ; USER=root ; COMMAND=apt"
    assert rows[1] == "Failed password for invalid user USER_1 from IP_1 (harici) port 22, again IP_1 (harici) at 14:23:01"
    assert rows[2] == texts[2] and rows[3] == rows[4] == ""
    assert "COMMAND=<bos>" in rows[5] and "zoe" not in rows[6] and "fe80" not in rows[6] and "/home/USER_" in rows[6]
    again, _ = privacy.scrub(out.select("scope_id", "row_id", F.col("message_scrubbed").alias("message")), "message")
    assert {r.row_id: r.message_scrubbed for r in again.collect()}[1] == rows[1]
    assert labels.where("kind = 'ip'").count() == 2


def test_names_of_a_scope_are_replaced_everywhere(spark):
    texts = [("s", "Accepted password for yasin from 10.0.0.1 port 22"), ("s", "session closed for user yasin"), ("s", "yasin, yasin. (yasin) yasinx"), ("t", "session closed for user yasin")]
    df = spark.createDataFrame([(s, i, t) for i, (s, t) in enumerate(texts)], "scope_id string, row_id long, message string")
    rows = {r.row_id: r.message_scrubbed for r in privacy.scrub(df, "message")[0].collect()}
    assert rows[1] == "session closed for user USER_1" and rows[2] == "USER_1, yasin. (USER_1) yasinx" and rows[3] == texts[3][1]


def test_columns_come_before_the_text(spark):
    rows = [("s", 0, "1.1.1.1", "ayla", "from 2.2.2.2 for user=can"), ("s", 1, None, "root", "ayla and 1.1.1.1"), ("s", 2, "N/A", "", None), ("s", 3, "host-a", None, "x")]
    out, labels = privacy.scrub(spark.createDataFrame(rows, "scope_id string, row_id long, src_ip string, user string, message string"), "message", "src_ip", "user")
    got = {r.row_id: (r.ip_label, r.user_label, r.message_scrubbed) for r in out.collect()}
    assert got[0] == ("IP_1 (harici)", "USER_1", "from IP_2 (harici) for user=USER_2")
    assert got[1] == ("N/A", "root", "USER_1 and IP_1 (harici)") and got[2] == ("N/A", "N/A", "") and got[3] == ("IP_3 (bilinmiyor)", "N/A", "x")
    assert labels.count() == 5


def test_an_alert_without_events_has_a_brief(spark):
    alerts = spark.createDataFrame([("a", "high", "by user=can", None, "can")], "id string, severity string, message string, src_ip string, user string")
    events = spark.createDataFrame([], "alert_id string, line_id long, severity string, event_type string, timestamp timestamp, message string, src_ip string, user string")
    assert [tuple(r) for r in briefs.briefs(alerts, events).collect()] == [("a", 0, "N/A", "USER_1", "by user=USER_1", briefs.NO_EVENTS)]


def test_a_dossier_for_every_asked_address_with_events(spark):
    """Events decide what is an address: one that isn't valid has its dossier, a valid one without events has none."""
    questions = spark.createDataFrame([(1, "What did 185.199.333.1 and 10.0.0.1 do? 999.1.1.1 at 14:23:01, 8.8.8.8"), (2, "185.199.333.1, fe80::1"), (3, None)], "id long, text string")
    events = spark.createDataFrame([("185.199.333.1", "a", 2, 1), ("185.199.333.1", "a", 3, 2), ("10.0.0.1", "b", 1, 3), ("fe80::1", "b", 1, 4), ("9.9.9.9", "b", 1, 5)], "src_ip string, event_type string, s long, line_id long").withColumn("timestamp", F.timestamp_seconds("s"))
    alerts = spark.createDataFrame([("185.199.333.1",), ("8.8.8.8",)], "src_ip string")
    asked = briefs.asked_ips(questions, "id", "text")
    rows = {r.src_ip: (r.total, r.types, r.n_alerts, r.last_events) for r in briefs.dossiers(asked, events, alerts).collect()}
    assert rows == {"185.199.333.1": (2, "a=2", 1, "2,1"), "10.0.0.1": (1, "b=1", 0, "3"), "fe80::1": (1, "b=1", 0, "4")}
