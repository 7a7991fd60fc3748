"""Log lines rendered from the events table, which holds no lines of its own.

Every event becomes one line of one of three sources; line_id is its event_id. Some lines are junk, some carry the
old stamp without year and zone, and some belong to a process that an ignore pattern drops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.functions.choose import once

AS_OF = "2024-02-01 00:00:00"
PATHS = ("/", "/index.html", "/wp-admin/install.php", "/.env", "/api/items")
STATUSES = (200, 404, 301, 500)
AGENTS = ("Mozilla/5.0", "sqlmap/1.7", "-")


def as_of() -> Column:
    return F.to_timestamp(F.lit(AS_OF))


def derived(events: DataFrame) -> DataFrame:
    """The values that lines are made of."""
    ip = F.concat(F.when(F.col("user_id") % 5 == 0, "10.0.").otherwise("185.199."), F.floor(F.col("user_id") / 250).cast("string"), F.lit("."), (F.col("user_id") % 250).cast("string"))
    return events.select("event_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("t"), "user_id", F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("int").alias("k")).withColumns({
        "u": F.concat(F.lit("u"), F.col("user_id").cast("string")), "ip": ip,
        "host": F.concat(F.lit("vps"), (F.col("user_id") % 3).cast("string")), "port": (F.col("event_id") % 60000 + 1024).cast("string"), "id": F.col("event_id").cast("string"),
    })


def pick(values, n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def lines(events: DataFrame) -> DataFrame:
    """line_id, source and value; event_ts is the time that the line tells, for tests."""
    d, k, f = derived(events), F.col("k"), F.format_string
    kind = F.col("kind")
    sshd = (
        F.when(k % 10 <= 4, f("Failed password for %s from %s port %s ssh2", "u", "ip", "port"))
        .when(k % 10 <= 6, f("Failed password for invalid user %s from %s port %s ssh2", "u", "ip", "port"))
        .when(k % 10 == 7, f("Invalid user %s from %s port %s", "u", "ip", "port"))
        .when(k % 10 == 8, f("pam_unix(sshd:auth): authentication failure; logname= uid=0 euid=0 tty=ssh ruser= rhost=%s user=%s", "ip", "u"))
        .otherwise(f("Connection closed by authenticating user %s %s port %s [preauth]", "u", "ip", "port"))
    )
    sudo = F.when(k % 10 < 9, f("%s : TTY=pts/0 ; PWD=/home/%s ; USER=root ; COMMAND=/usr/bin/apt install pkg%s", "u", "u", "k")).otherwise(f("%s : 3 incorrect password attempts ; TTY=pts/0 ; PWD=/home/%s ; USER=root ; COMMAND=/bin/sh", "u", "u"))
    packet = f("IN=eth0 OUT= SRC=%s DST=10.1.1.1 LEN=60 PROTO=TCP SPT=%s DPT=%s LEN=40", "ip", "port", (k + 20).cast("string"))
    process = (
        F.when(kind == "error", f("sshd[%s]", "id")).when(kind == "purchase", F.lit("sudo")).when(kind == "signup", F.when(k % 10 < 8, f("sshd[%s]", "id")).otherwise(f("useradd[%s]", "id")))
        .when((k % 2 == 0) | (k % 10 == 1), F.lit("kernel")).when(F.col("event_id") % 11 == 0, F.lit("casaos")).otherwise(F.lit("systemd[1]"))
    )
    message = (
        F.when(kind == "error", sshd).when(kind == "purchase", sudo)
        .when(kind == "signup", F.when(k % 10 < 8, f("Accepted publickey for %s from %s port %s ssh2", "u", "ip", "port")).otherwise(f("new user: name=%s, UID=1001, GID=1001, home=/home/%s", "u", "u")))
        .when(k % 2 == 0, F.concat(F.lit("[UFW BLOCK] "), packet)).when(k % 10 == 1, F.concat(F.lit("[UFW AUDIT] "), packet)).otherwise(f("Started unit%s.service", "k"))
    )
    old = F.concat(F.date_format("t", "MMM "), F.lpad(F.dayofmonth("t").cast("string"), 2, " "), F.date_format("t", " HH:mm:ss"))
    stamp = F.when((kind == "error") & (F.col("event_id") % 7 == 0), old).otherwise(F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'"))
    access = f('%s - %s [%s] "GET %s HTTP/1.1" %s %s "-" "%s"', "ip", F.when(F.col("event_id") % 17 == 0, F.col("u")).otherwise("-"), F.date_format("t", "dd/MMM/yyyy:HH:mm:ss '+0000'"), pick(PATHS, k), pick(STATUSES, k).cast("string"), F.when(F.col("event_id") % 13 == 0, "-").otherwise((F.col("event_id") % 5000).cast("string")), pick(AGENTS, k))
    junk = (kind == "error") & (F.col("event_id") % 97 == 0)
    value = F.when(junk, f("not a log line %s", "id")).when(kind == "click", access).otherwise(F.concat(stamp, F.lit(" "), "host", F.lit(" "), process, F.lit(": "), message))
    source = F.when(kind == "click", "nginx_access").when(kind == "view", "syslog").otherwise("auth")
    return d.select(F.col("event_id").alias("line_id"), source.alias("source"), F.col("t").alias("event_ts"), once(value.alias("value")))


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table that has fewer splits than the cluster has cores, dealt to all of them; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spread(spark.read.parquet(f"{sf_dir}/events.parquet")))


#: The same values in DuckDB, straight from the events table: what parsing the lines must give.
EXPECTED = r"""
ev AS (SELECT event_id, date_trunc('second', ts) AS t, user_id, event_type AS kind, k, 'u' || user_id AS u, CAST(1024 + event_id % 60000 AS BIGINT) AS port,
        (CASE WHEN user_id % 5 = 0 THEN '10.0.' ELSE '185.199.' END) || (user_id // 250) || '.' || (user_id % 250) AS ip, 'vps' || (user_id % 3) AS host
    FROM (SELECT *, CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) AS k FROM events)),
pe AS (SELECT event_id, t, epoch(t)::BIGINT AS t_s, user_id, kind, k, u, port, ip,
        CASE kind WHEN 'click' THEN 'nginx_access' WHEN 'view' THEN 'syslog' ELSE 'auth' END AS source,
        CASE kind WHEN 'click' THEN 'localhost' ELSE host END AS host,
        CASE WHEN kind = 'error' THEN CASE WHEN k % 10 = 9 THEN 'connection_closed' ELSE 'auth_failure' END
            WHEN kind = 'signup' THEN CASE WHEN k % 10 < 8 THEN 'auth_success' ELSE 'user_added' END
            WHEN kind = 'purchase' THEN CASE WHEN k % 10 < 9 THEN 'sudo_command' ELSE 'sudo_failure' END
            WHEN kind = 'click' THEN 'http_request'
            WHEN k % 2 = 0 THEN 'firewall_block' WHEN k % 10 = 1 THEN 'firewall_audit' ELSE 'service_event' END AS event_type,
        CASE WHEN kind = 'click' THEN CASE WHEN k % 5 IN (2, 3) OR k % 3 IN (1, 2) THEN 'low' WHEN k % 4 = 3 THEN 'medium' ELSE 'info' END
            WHEN kind = 'error' THEN CASE WHEN k % 10 = 9 THEN 'low' ELSE 'medium' END
            WHEN kind = 'signup' THEN CASE WHEN k % 10 < 8 THEN 'info' ELSE 'medium' END
            WHEN kind = 'purchase' THEN CASE WHEN k % 10 < 9 THEN 'low' ELSE 'high' END
            WHEN k % 2 = 0 OR k % 10 = 1 THEN 'low' ELSE 'info' END AS severity,
        CASE WHEN kind IN ('error', 'click') OR (kind = 'signup' AND k % 10 < 8) OR (kind = 'view' AND (k % 2 = 0 OR k % 10 = 1)) THEN ip END AS src_ip,
        CASE WHEN kind = 'view' AND (k % 2 = 0 OR k % 10 = 1) THEN '10.1.1.1' END AS dst_ip,
        CASE WHEN (kind = 'error' AND k % 10 <> 8) OR (kind = 'signup' AND k % 10 < 8) OR (kind = 'view' AND (k % 2 = 0 OR k % 10 = 1)) THEN port END AS src_port,
        CASE WHEN kind = 'view' AND (k % 2 = 0 OR k % 10 = 1) THEN 20 + k END AS dst_port,
        CASE WHEN kind IN ('error', 'signup', 'purchase') THEN u WHEN kind = 'click' AND event_id % 17 = 0 THEN u END AS "user",
        CASE WHEN kind = 'error' OR (kind = 'signup' AND k % 10 < 8) THEN 'sshd' WHEN kind = 'signup' THEN 'useradd' WHEN kind = 'purchase' THEN 'sudo' WHEN kind = 'click' THEN 'nginx'
            WHEN k % 2 = 0 OR k % 10 = 1 THEN 'kernel' WHEN event_id % 11 = 0 THEN 'casaos' ELSE 'systemd' END AS process,
        CASE WHEN kind IN ('error', 'signup') THEN event_id WHEN kind = 'view' AND k % 2 = 1 AND k % 10 <> 1 AND event_id % 11 <> 0 THEN 1 END AS pid,
        CASE WHEN kind = 'click' THEN 'GET ' || ['/', '/index.html', '/wp-admin/install.php', '/.env', '/api/items'][k % 5 + 1] || ' → ' || [200, 404, 301, 500][k % 4 + 1] END AS click_message,
        CASE WHEN kind = 'click' THEN k % 5 IN (2, 3) OR k % 3 IN (1, 2) END AS is_suspicious,
        CASE WHEN kind = 'click' THEN CAST([200, 404, 301, 500][k % 4 + 1] AS BIGINT) END AS http_status,
        CASE WHEN kind = 'click' THEN CASE WHEN event_id % 13 = 0 THEN 0 ELSE event_id % 5000 END END AS http_size,
        CASE WHEN kind = 'click' THEN ['/', '/index.html', '/wp-admin/install.php', '/.env', '/api/items'][k % 5 + 1] END AS http_path,
        CASE WHEN kind = 'click' THEN ['Mozilla/5.0', 'sqlmap/1.7', '-'][k % 3 + 1] END AS user_agent,
        CASE WHEN kind = 'error' THEN CASE WHEN k % 10 <= 6 THEN 'password' WHEN k % 10 = 7 THEN 'invalid_user' WHEN k % 10 = 8 THEN 'pam' END WHEN kind = 'signup' AND k % 10 < 8 THEN 'publickey' END AS auth_method,
        kind = 'error' AND event_id % 97 = 0 AS junk,
        kind = 'view' AND k % 2 = 1 AND k % 10 <> 1 AND event_id % 11 = 0 AS ignored
    FROM ev),
good AS (SELECT * FROM pe WHERE NOT junk AND NOT ignored)"""
