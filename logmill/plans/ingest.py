"""Queries on sources, parsers and the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from logmill.functions.stamps import access_stamp, bsd_stamp, duration_seconds, iso_stamp
from logmill.operators import events as ev
from logmill.operators.parse import parse_access, parse_auth, parse_syslog
from logmill.plans.base import NOW, as_of, expected, lines, parsed, query, shared_dir, snapshot
from logmill.sources.lines import SOURCES, accounting, not_ignored

LONG = lambda *names: [F.col(n).cast("long").alias(n) for n in names]


def seconds():
    return F.unix_timestamp("timestamp").alias("t_s")


def auth(spark, d):
    return parse_auth(lines(spark, d).where("source = 'auth'"), as_of())


@query(expected("""SELECT event_id AS line_id, t_s, host, event_type, severity, src_ip, src_port, "user", pid, auth_method FROM good WHERE process = 'sshd'"""))
def parse_sshd(spark, d):
    return auth(spark, d).where(F.col("process") == "sshd").select("line_id", seconds(), "host", "event_type", "severity", "src_ip", *LONG("src_port"), "user", *LONG("pid"), "extra.auth_method")


@query(expected("""SELECT event_id AS line_id, t_s, event_type, severity, "user", CASE WHEN event_type = 'sudo_command' THEN 'root' END AS target_user,
    CASE WHEN event_type = 'sudo_command' THEN '/usr/bin/apt install pkg' || k END AS command, CASE WHEN event_type = 'sudo_command' THEN 'pts/0' END AS tty,
    CASE WHEN event_type = 'sudo_command' THEN '/home/' || u END AS pwd, CASE WHEN event_type = 'sudo_failure' THEN '3 incorrect password attempts' END AS reason FROM good WHERE process = 'sudo'"""))
def parse_sudo(spark, d):
    return auth(spark, d).where(F.col("process") == "sudo").select("line_id", seconds(), "event_type", "severity", "user", "extra.target_user", "extra.command", "extra.tty", "extra.pwd", "extra.reason")


@query(expected("""SELECT event_id AS line_id, t_s, host, event_type, severity, "user" FROM good WHERE process = 'useradd'"""))
def parse_useradd(spark, d):
    return auth(spark, d).where(F.col("process") == "useradd").select("line_id", seconds(), "host", "event_type", "severity", "user")


@query(expected("""SELECT event_id AS line_id, t_s, severity, src_ip, "user", click_message AS message, http_path, http_status, http_size, user_agent, is_suspicious FROM good WHERE source = 'nginx_access'"""), "parse_access")
def parse_access_log(spark, d):
    rows = parse_access(lines(spark, d).where("source = 'nginx_access'"), as_of())
    return rows.select("line_id", seconds(), "severity", "src_ip", "user", "message", "extra.http_path", F.col("extra.http_status").cast("long").alias("http_status"), F.col("extra.http_size").cast("long").alias("http_size"), "extra.user_agent", "extra.is_suspicious")


@query(expected("SELECT http_path, user_agent, count(*) AS n FROM good WHERE is_suspicious GROUP BY ALL"))
def suspicious_requests(spark, d):
    return parse_access(lines(spark, d).where("source = 'nginx_access'"), as_of()).where("extra.is_suspicious").groupBy("extra.http_path", "extra.user_agent").agg(F.count("*").alias("n"))


@query(expected("""SELECT event_id AS line_id, t_s, event_type, src_ip, dst_ip, src_port, dst_port, 'TCP' AS protocol, 'eth0' AS interface_in, '' AS interface_out, CASE WHEN event_type = 'firewall_block' THEN 'BLOCK' ELSE 'AUDIT' END AS fw_action FROM good WHERE process = 'kernel'"""))
def parse_firewall(spark, d):
    rows = parse_syslog(lines(spark, d).where("source = 'syslog'"), as_of()).where(F.col("process") == "kernel")
    return rows.select("line_id", seconds(), "event_type", "src_ip", "dst_ip", *LONG("src_port", "dst_port"), "extra.protocol", "extra.interface_in", "extra.interface_out", "extra.fw_action")


@query(expected("SELECT event_id AS line_id, t_s, process, pid, severity, 'Started unit' || k || '.service' AS message FROM good WHERE event_type = 'service_event'"))
def parse_service(spark, d):
    rows = parse_syslog(not_ignored(lines(spark, d).where("source = 'syslog'"), SOURCES), as_of()).where(F.col("event_type") == "service_event")
    return rows.select("line_id", seconds(), "process", *LONG("pid"), "severity", "message")


@query(expected(f"SELECT event_id AS line_id, t_s AS iso_s, t_s - 7200 AS offset_s, t_s AS bsd_s, t_s - 10800 AS access_s, epoch({NOW})::BIGINT AS bad_s FROM ev JOIN pe USING (event_id)"))
def ts_formats(spark, d):
    df, t = lines(spark, d), "event_ts"
    s = F.unix_timestamp
    old = F.concat(F.date_format(t, "MMM"), F.lit("  "), F.dayofmonth(t).cast("string"), F.date_format(t, " HH:mm:ss"))
    return df.select(
        "line_id", s(iso_stamp(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'.024533702Z'"), as_of())).alias("iso_s"), s(iso_stamp(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'+0200'"), as_of())).alias("offset_s"),
        s(bsd_stamp(old, as_of())).alias("bsd_s"), s(access_stamp(F.date_format(t, "dd/MMM/yyyy:HH:mm:ss '+0300'"), as_of())).alias("access_s"), s(iso_stamp(F.lit("2024-13-45T99:00:00Z"), as_of())).alias("bad_s"),
    )


COLUMNS = """event_id AS line_id, source, t_s, host, event_type, severity, src_ip, dst_ip, src_port, dst_port, "user", process, pid, is_suspicious, http_status"""


def narrow(df):
    return df.select("line_id", "source", seconds(), "host", "event_type", "severity", "src_ip", "dst_ip", *LONG("src_port", "dst_port"), "user", "process", *LONG("pid"), "extra.is_suspicious", F.col("extra.http_status").cast("long").alias("http_status"))


@query(expected(f"SELECT {COLUMNS} FROM good"))
def parse_all_normalised(spark, d):
    return narrow(parsed(spark, d))


@query(expected(f"SELECT {COLUMNS} FROM good"))
def envelope_roundtrip(spark, d):
    return narrow(ev.decode(ev.encode(parsed(spark, d), as_of()), as_of())[0])


def torn(spark, d):
    """Envelopes of which some are cut off or aren't objects."""
    e = ev.encode(parsed(spark, d), as_of())
    return e.withColumn("data", F.when(F.col("line_id") % 19 == 0, F.substring("data", 1, 20)).when(F.col("line_id") % 23 == 0, F.lit("[1]")).otherwise(F.col("data")))


@query(expected("SELECT event_id AS line_id, source FROM good WHERE event_id % 19 = 0 OR event_id % 23 = 0"))
def poison_quarantine(spark, d):
    return ev.decode(torn(spark, d), as_of())[1].select("line_id", "source")


@query(expected("SELECT source, count(*) FILTER (ignored) AS ignored, count(*) FILTER (NOT ignored AND NOT junk) AS parsed, count(*) FILTER (junk) AS unparsed FROM pe GROUP BY source"))
def ignore_accounting(spark, d):
    return accounting(lines(spark, d), parsed(spark, d), SOURCES)


@query(expected("SELECT source, count(*) AS n, avg(event_id % 60 + 1.0)::DOUBLE AS collect_s, 5.0::DOUBLE AS store_s, max(event_id % 60 + 6.0)::DOUBLE AS longest_s, median(event_id % 60 + 1.0)::DOUBLE AS median_s FROM good GROUP BY source"))
def ingest_lag(spark, d):
    e = parsed(spark, d).withColumn("collected_at", F.timestamp_seconds(F.unix_timestamp("timestamp") + F.col("line_id") % 60 + 1))
    return ev.ingest_lag(e, F.col("collected_at") + F.expr("interval 5 seconds"))


@query(expected("""SELECT source, count(*) AS n, true AS close FROM good GROUP BY source"""))
def ingest_lag_sketches(spark, d):
    """Delays from stored sketches of two deliveries; close says whether the ranks of the quantiles are within 2 %."""
    e, path = snapshot(parsed(spark, d).withColumn("collected_at", F.timestamp_seconds(F.unix_timestamp("timestamp") + F.col("line_id") % 60 + 1))), f"{shared_dir(spark)}/sketches"
    for part in ("line_id % 3 = 0", "line_id % 3 > 0"):
        ev.lag_sketches(e.where(part)).write.mode("append").parquet(path)
    told = F.broadcast(ev.lag_quantiles(spark.read.parquet(path), (0.5, 0.95)))  # a row for each source
    delay = F.unix_timestamp("collected_at") - F.unix_timestamp("timestamp")
    low, high = ([F.count_if(op(delay, F.col(c))).alias(f"{k}_{c}") for c in ("p50", "p95")] for k, op in (("below", lambda a, b: a < b), ("upto", lambda a, b: a <= b)))
    ranks = e.join(told.withColumnRenamed("n", "told"), "source").groupBy("source").agg(F.count("*").alias("n"), F.max("told").alias("told"), *low, *high)
    near = lambda c, r: (F.col(f"below_{c}") <= (r + 0.02) * F.col("n")) & (F.col(f"upto_{c}") >= (r - 0.02) * F.col("n"))
    return ranks.select("source", "n", (near("p50", 0.5) & near("p95", 0.95) & (F.col("told") == F.col("n"))).alias("close"))


@query(expected("""SELECT event_id AS line_id, event_type || ' ' || coalesce(src_ip, '-') || ' ' || coalesce("user", '-') || ' ' || click_message AS summary FROM good WHERE source = 'nginx_access'"""))
def preview_lines(spark, d):
    return ev.preview(parsed(spark, d).where("source = 'nginx_access'"))


@query(expected("SELECT CAST(t AS DATE)::VARCHAR AS event_date, event_type, count(*) AS n FROM good GROUP BY ALL"))
def event_sink_roundtrip(spark, d):
    path = f"{shared_dir(spark)}/events"
    ev.write_events(parsed(spark, d), path)
    return spark.read.parquet(path).groupBy(F.col("event_date").cast("string").alias("event_date"), "event_type").agg(F.count("*").alias("n"))


@query(expected("""SELECT event_id AS line_id, CASE k % 6 WHEN 0 THEN k WHEN 1 THEN k * 60 WHEN 2 THEN k * 3600 WHEN 3 THEN k * 86400 WHEN 4 THEN k * 60 ELSE 300 END AS seconds FROM ev"""), "duration_seconds")
def duration_seconds_of(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("line_id"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    units = F.element_at(F.array(*map(F.lit, ("s", "m", "h", "d", "x", ""))), (F.col("k") % 6 + 1).cast("int"))
    text = F.when(F.col("k") % 6 == 5, F.when(F.col("k") % 12 == 5, "").otherwise("xm")).otherwise(F.concat(F.col("k").cast("string"), units))
    return e.select("line_id", duration_seconds(text).alias("seconds"))
