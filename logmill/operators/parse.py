"""Parsers: lines (value, source and any other columns) to event columns, all as column expressions.

Each parser drops lines that don't have its format. Unmatched captures are null. Patterns use Unicode classes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmill.functions.choose import captures, contains_any, first_case, once, unpack
from logmill.functions.stamps import access_stamp, syslog_stamp

CORE = ["timestamp", "host", "event_type", "severity", "src_ip", "dst_ip", "src_port", "dst_port", "user", "process", "pid", "message", "raw"]
EXTRA = {
    "auth_method": "string", "target_user": "string", "command": "string", "tty": "string", "pwd": "string", "reason": "string",
    "http_method": "string", "http_path": "string", "http_status": "int", "http_size": "int", "user_agent": "string", "referer": "string", "is_suspicious": "boolean",
    "protocol": "string", "interface_in": "string", "interface_out": "string", "fw_action": "string",
}
INTS = {"src_port", "dst_port", "pid"}

# Log formats and the signs of scans.
STAMP = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?|[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}"
FRAME = rf"(?U)^({STAMP})\s+(\S+)\s+([\w\-/.]+)(?:\[(\d+)\])?:\s*(.*)$"
ADDRESS = r"([\d.a-fA-F:]+)"
FAILED = rf"Failed (password|publickey|none) for (?:invalid user )?(\S+) from {ADDRESS} port (\d+)"
ACCEPTED = rf"Accepted (password|publickey|keyboard-interactive(?:/pam)?) for (\S+) from {ADDRESS} port (\d+)"
INVALID = rf"Invalid user (\S+) from {ADDRESS}(?: port (\d+))?"
CLOSED = rf"Connection (?:closed|reset) by (?:authenticating |invalid )?(?:user (\S+) )?{ADDRESS} port (\d+)"
PAM = rf"authentication failure;.*?rhost={ADDRESS}(?:\s+user=(\S+))?"
SUDO = r"^\s*(\S+)\s*:\s*TTY=(\S*)\s*;\s*PWD=(\S*)\s*;\s*USER=(\S+)\s*;\s*COMMAND=(.+)$"
SUDO_FAILED = r"^\s*(\S+)\s*:\s*(\d+ incorrect password attempts?|user NOT in sudoers|command not allowed)"
ADDED = r"new user: name=([^,]+)"
ACCESS = rf'^{ADDRESS}\s+\S+\s+(\S+)\s+\[([^\]]+)\]\s+"([A-Z]+)\s+(\S*)\s*([^"]*)"\s+(\d{{3}})\s+(\d+|-)(?:\s+"([^"]*)"\s+"([^"]*)")?'
FIREWALL = r"\[UFW\s+([A-Z]+)\]"
PAIR = r"\b([A-Z]+)=(\S*)"
SUSPICIOUS_PATHS = (
    "/.env", "/.git", "/.aws", "/.ssh", "/wp-admin", "/wp-login", "/wordpress", "/phpmyadmin", "/pma", "/adminer", "/admin", "/administrator", "/manager/html",
    "/config", "/backup", "/dump", "/.sql", "/db.sql", "/shell", "/cmd", "/eval-stdin.php", "/vendor/phpunit", "/cgi-bin", "/actuator", "/.well-known/security",
)
SUSPICIOUS_AGENTS = (
    "nikto", "sqlmap", "nmap", "masscan", "zgrab", "nessus", "dirbuster", "gobuster", "ffuf", "wpscan", "acunetix", "havij", "metasploit", "python-requests", "curl/", "wget/",
)


def framed(lines: DataFrame, now: Column, zone: str = "UTC") -> DataFrame:
    """Syslog frame: timestamp, host, process, pid and message; lines without it are dropped.

    One pass puts the parts in an array, the stamp last, since the others can't hold a line break. A line with the
    frame never begins with one, so the empty first element tells which lines have it.
    """
    parts = lines.select("*", once(F.split(F.regexp_replace("value", FRAME, "\n$2\n$3\n$4\n$5\n$1"), "\n", 6).alias("lm_part")))
    p = lambda i: F.col("lm_part")[i]
    has = parts.where((F.size("lm_part") == 6) & (p(0) == "") & ~F.col("value").startswith("\n"))
    stamp = once(syslog_stamp(F.trim(p(5)), now, zone).alias("timestamp"))
    return has.select(*[c for c in lines.columns if c != "timestamp"], stamp, p(1).alias("host"), p(2).alias("process"), p(3).try_cast("int").alias("pid"), p(4).alias("message"), F.col("value").alias("raw"))


def own_columns(lines: DataFrame) -> list[str]:
    return [c for c in lines.columns if c not in CORE and c != "extra"]


def finished(df: DataFrame, keep: list[str], values: dict[str, Column]) -> DataFrame:
    """Core columns and extra, a struct with a type for each field."""
    core = [(values.get(c, F.col(c) if c in df.columns else F.lit(None))).cast("int" if c in INTS else "timestamp" if c == "timestamp" else "string").alias(c) for c in CORE]
    extra = F.struct(*[values.get(k, F.lit(None)).cast(t).alias(k) for k, t in EXTRA.items()])
    return df.select(*keep, *core, extra.alias("extra"))


#: Prefix of the process, pattern, event type, severity and the fields: a number is a capture, a text is the value itself.
AUTH_CASES = (
    ("sshd", FAILED, "auth_failure", "medium", {"auth_method": 1, "user": 2, "src_ip": 3, "src_port": 4}),
    ("sshd", ACCEPTED, "auth_success", "info", {"auth_method": 1, "user": 2, "src_ip": 3, "src_port": 4}),
    ("sshd", INVALID, "auth_failure", "medium", {"auth_method": "invalid_user", "user": 1, "src_ip": 2, "src_port": 3}),
    ("sshd", PAM, "auth_failure", "medium", {"auth_method": "pam", "src_ip": 1, "user": 2}),
    ("sshd", CLOSED, "connection_closed", "low", {"user": 1, "src_ip": 2, "src_port": 3}),
    ("sudo", SUDO, "sudo_command", "low", {"user": 1, "tty": 2, "pwd": 3, "target_user": 4, "command": 5}),
    ("sudo", SUDO_FAILED, "sudo_failure", "high", {"user": 1, "reason": 2}),
    ("useradd", ADDED, "user_added", "medium", {"user": 1}),
)
MAY_BE_EMPTY = {"tty", "pwd"}


def parse_auth(lines: DataFrame, now: Column, zone: str = "UTC") -> DataFrame:
    """sshd, sudo and useradd lines by prefix of the process, first match wins; all other frames are auth_other.

    The case that holds and its captures are found once per line; fields only pick from them.
    """
    df, m = framed(lines, now, zone), F.col("message")
    found = F.struct(F.lit(-1).alias("lm_case"), F.array().cast("array<string>").alias("lm_part"))
    for i, (process, pattern, *_) in reversed(list(enumerate(AUTH_CASES))):
        found = F.when(F.col("process").startswith(process) & m.rlike(pattern), F.struct(F.lit(i).alias("lm_case"), captures(m, pattern, re.compile(pattern).groups).alias("lm_part"))).otherwise(found)

    def field(name: str) -> Column:
        out = F.lit(None).cast("string")
        for i, (*_, fields) in enumerate(AUTH_CASES):
            if name in fields:
                part = F.try_element_at("lm_part", F.lit(fields[name] + 1)) if isinstance(fields[name], int) else F.lit(fields[name])
                out = F.when(F.col("lm_case") == i, part).otherwise(out)
        return out if name in MAY_BE_EMPTY else F.nullif(out, F.lit(""))

    names = {n for *_, fields in AUTH_CASES for n in fields}
    kinds = {n: F.coalesce(F.try_element_at(F.array(*[F.lit(case[at]) for case in AUTH_CASES]), F.nullif(F.col("lm_case") + 1, F.lit(0))), F.lit(other)) for n, at, other in (("event_type", 2, "auth_other"), ("severity", 3, "info"))}
    return finished(df.select("*", unpack(found)), own_columns(lines), kinds | {n: field(n) for n in sorted(names)})


def suspicious(path: Column, agent: Column) -> Column:
    """A path or an agent that scanners use, or no agent at all."""
    return contains_any(F.lower(path), SUSPICIOUS_PATHS) | contains_any(F.lower(agent), SUSPICIOUS_AGENTS) | agent.isin("", "-")


def parse_access(lines: DataFrame, now: Column, host: str = "localhost") -> DataFrame:
    """Combined access log; other lines are dropped, also values with a line break inside. Sizes that aren't numbers count as 0."""
    names = ["src_ip", "user", "stamp", "method", "path", "proto", "status", "bytes", "referer", "agent"]
    parts = lines.where(~F.col("value").contains("\n")).select(*own_columns(lines), once(captures(F.col("value"), ACCESS, len(names)).alias("lm_part")))
    has = parts.where((F.size("lm_part") == len(names) + 1))
    p = {n: F.col("lm_part")[i + 1] for i, n in enumerate(names)}
    df, odd = has.select("*", once(suspicious(p["path"], p["agent"]).alias("lm_odd"))), F.col("lm_odd")
    values = {
        "timestamp": access_stamp(p["stamp"], now), "host": F.lit(host), "event_type": F.lit("http_request"), "process": F.lit("nginx"), "raw": F.col("value"),
        "severity": F.when(odd, "low").when(p["status"].startswith("5"), "medium").otherwise("info"),
        "src_ip": p["src_ip"], "user": F.nullif(p["user"], F.lit("-")), "message": F.concat(p["method"], F.lit(" "), p["path"], F.lit(" → "), p["status"]),
        "http_method": p["method"], "http_path": p["path"], "http_status": p["status"], "http_size": F.coalesce(p["bytes"].try_cast("int"), F.lit(0)),
        "user_agent": p["agent"], "referer": p["referer"], "is_suspicious": odd,
    }
    return finished(df, own_columns(lines), values)


def last_pair(pairs: Column, key: str) -> Column:
    """The value of the last KEY=value pair with this key, null without one."""
    return F.try_element_at(F.filter(pairs, lambda x: x["k"] == key), F.lit(-1))["v"]


def parse_syslog(lines: DataFrame, now: Column, zone: str = "UTC") -> DataFrame:
    """Firewall lines and, for every other frame, service events."""
    df, m = framed(lines, now, zone), F.col("message")
    pairs = F.arrays_zip(F.regexp_extract_all(m, F.lit(PAIR), F.lit(1)).alias("k"), F.regexp_extract_all(m, F.lit(PAIR), F.lit(2)).alias("v"))
    wall_line = F.regexp_extract(m, FIREWALL, 1)  # without a match empty
    df = df.select("*", once(wall_line.alias("lm_action"))).select("*", once(F.when(F.col("lm_action") != "", pairs).alias("lm_kv")))
    action = F.col("lm_action")
    kv = lambda k: last_pair(F.col("lm_kv"), k)
    wall = {"event_type": F.when(action == "BLOCK", "firewall_block").otherwise("firewall_audit"), "severity": F.lit("low"), "src_ip": kv("SRC"), "dst_ip": kv("DST"), "src_port": kv("SPT").try_cast("int"), "dst_port": kv("DPT").try_cast("int"), "protocol": kv("PROTO"), "interface_in": kv("IN"), "interface_out": kv("OUT"), "fw_action": action}
    case = first_case(list(wall), [(action != "", wall), (None, {"event_type": F.lit("service_event"), "severity": F.lit("info")})])
    return finished(df.select("*", unpack(case)), own_columns(lines), {n: F.col(n) for n in wall})


#: Parser by source type and name; others can be added as functions from lines to events.
def parser_for(kind: str, name: str):
    if kind == "syslog":
        return parse_auth if "auth" in name else parse_syslog
    return parse_access if kind.startswith("nginx_") else None


def parse_lines(lines: DataFrame, sources: list[dict], now: Column) -> DataFrame:
    """Lines of all enabled sources, each by its own parser; sources of an unknown type are left out."""
    out = None
    for s in sources:
        parser = parser_for(s["type"], s["name"])
        if s.get("enabled", True) and parser:
            part = parser(lines.where(F.col("source") == s["name"]), now)
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no enabled source has a parser")
    return out
