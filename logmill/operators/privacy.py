"""Pseudonyms for addresses and users, and scrubbed text. A scope (scope_id) has its own numbers."""

from __future__ import annotations

from ipaddress import ip_network

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Labels, accounts that every system has, formats.
LOCALHOST, PRIVATE, PUBLIC, UNKNOWN, HIDDEN, EMPTY = "localhost", "yerel", "harici", "bilinmiyor", "<gizlendi>", "<bos>"
SYSTEM_ACCOUNTS = (
    "root", "daemon", "bin", "sys", "sync", "games", "man", "lp", "mail", "news", "uucp", "proxy", "backup", "list", "irc", "gnats", "nobody", "www-data", "nginx", "sshd", "syslog",
    "messagebus", "_apt", "redis", "postgres", "mysql", "tss", "landscape", "systemd-network", "systemd-resolve", "systemd-timesync", "uuidd", "dnsmasq", "docker", "ftp",
)
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
IPV4_LOOSE = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
H = r"[0-9a-fA-F]{1,4}"
IPV6_LOOSE = rf"\b(?:{H}:){{3,7}}{H}\b|\b(?:{H})?::(?:{H}:?){{0,6}}[0-9a-fA-F]{{0,4}}\b"
LOOSE = f"{IPV4_LOOSE}|{IPV6_LOOSE}"
IPV6 = rf"^(?:(?:{H}:){{7}}{H}|(?=(?:[^:]*:){{2,7}}[^:]*$|::(?:{H}:){{6}}{H}$|(?:{H}:){{7}}:$)(?!.*::.*::)(?:{H}(?::{H})*)?::(?:{H}(?::{H})*)?)$"
#: Networks that aren't public, and parts of them that are, by the registries of special addresses.
PRIVATE_NETS = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
)
PUBLIC_PARTS = ("192.0.0.9/32", "192.0.0.10/32")
PRIVATE_NETS_6 = ("::/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10")
PUBLIC_PARTS_6 = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")
NAME = r"([A-Za-z0-9._\-$]{1,32})"
USER_PATTERNS = (
    rf"(?i)\bfor\s+(?:invalid\s+user\s+)?{NAME}\s+from\b",
    rf"(?i)\bInvalid user\s+{NAME}\b",
    rf"(?i)\bauthenticating user\s+{NAME}\b",
    rf"(?i)\buser={NAME}",
    r"(?i)\bnew user:\s*name=([^,\s]{1,32})",
    rf"^\s*{NAME}\s*:\s*(?=TTY=|\d+ incorrect|user NOT in sudoers|command not allowed)",
)
HOME = r"/(home|Users)/([A-Za-z0-9._-]+)"
USER_LABEL, IP_LABEL = r"^USER_\d+$", r"^IP_\d+(?:\s*\([^)]*\))?$"


def numbers_of(parts: Column, base: int) -> Column:
    return F.transform(parts, lambda x: F.conv(x, base, 10).try_cast("long"))


def within(groups: Column, nets: tuple[str, ...]) -> Column:
    """Whether an address, as an array of its 4 bytes or 8 groups of 16 bits, is in one of the networks."""
    any_ = F.lit(False)
    for net in map(ip_network, nets):
        width, size = (8, 4) if net.version == 4 else (16, 8)
        first, here = int(net.network_address), F.lit(True)
        for i in range(-(-net.prefixlen // width)):
            keep = min(width, net.prefixlen - width * i)  # bits of this group that count
            value = first >> (width * (size - 1 - i)) & (1 << width) - 1
            here = here & (F.shiftright(F.get(groups, i), width - keep) == value >> (width - keep))
        any_ = any_ | here
    return any_


def ipv6_groups(text: Column) -> Column:
    """The 8 groups of an IPv6 address, which may end in an IPv4 address and a zone; null if it is none."""
    bare = F.regexp_replace(text, r"^([^%]*)%[^%]+$", "$1")
    last = numbers_of(F.split(F.substring_index(bare, ":", -1), r"\."), 10)
    pair = lambda i: F.lower(F.hex(F.get(last, i) * 256 + F.get(last, i + 1)))
    dotted = bare.contains(".")
    plain = F.when(~dotted, bare).when(F.substring_index(bare, ":", -1).rlike(IPV4), F.concat(F.regexp_replace(bare, "[^:]*$", ""), pair(0), F.lit(":"), pair(2)))
    sides = F.split(plain, "::")
    groups = lambda i: F.filter(F.split(F.coalesce(F.get(sides, i), F.lit("")), ":"), lambda x: x != "")
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(groups(0)) - F.size(groups(1))))
    return F.when(plain.rlike(IPV6), numbers_of(F.concat(groups(0), zeros, groups(1)), 16))


def is_ip(text: Column) -> Column:
    return text.rlike(IPV4) | text.rlike(IPV6)


def ip_scope(ip: Column) -> Column:
    """localhost, private, public or unknown (not an address), as the registries have it; an IPv4 address that is mapped
    into IPv6 has its own scope, a zone (``%eth0``) makes no difference."""
    four = lambda g: F.when(F.get(g, 0) == 127, LOCALHOST).when(within(g, PRIVATE_NETS) & ~within(g, PUBLIC_PARTS), PRIVATE).otherwise(PUBLIC)
    six = lambda g: F.when(within(g, ("::1/128",)), LOCALHOST).when(within(g, PRIVATE_NETS_6) & ~within(g, PUBLIC_PARTS_6), PRIVATE).otherwise(PUBLIC)
    inner = lambda g: F.array(*[F.shiftright(F.get(g, 6 + i // 2), 8 * (1 - i % 2)).bitwiseAND(255) for i in range(4)])
    mapped = lambda g: F.when(within(g, ("::ffff:0:0/96",)), four(inner(g))).otherwise(six(g))
    once = lambda groups, f: F.get(F.transform(F.array(groups), f), 0)  # noqa: E731  the groups are worked out once
    v6 = once(ipv6_groups(ip), lambda g: F.when(g.isNull(), UNKNOWN).otherwise(mapped(g)))
    return F.when(ip.rlike(IPV4), once(numbers_of(F.split(ip, r"\."), 10), four)).when(ip.contains(":"), v6).otherwise(UNKNOWN)


def numbered(values: DataFrame, prefix: str, disclosed: DataFrame | None = None) -> DataFrame:
    """scope_id, value and n: numbers by first position within the scope; disclosed values (scope_id, value) take none."""
    if disclosed is not None:
        values = values.join(disclosed, ["scope_id", "value"], "left_anti")
    first = values.groupBy("scope_id", "value").agg(F.min("position").alias("position"))
    n = F.row_number().over(Window.partitionBy("scope_id").orderBy("position", "value"))
    return first.select("scope_id", "value", F.concat(F.lit(prefix), n.cast("string")).alias("label"))


def ip_labels(values: DataFrame, disclosed: DataFrame | None = None) -> DataFrame:
    """Labels ``IP_n (scope)`` of (scope_id, position, value); empty values, N/A and labels get none, disclosed values stay."""
    real = values.where(F.col("value").isNotNull() & ~F.col("value").isin("", "N/A") & ~F.col("value").rlike(IP_LABEL))
    out = numbered(real, "IP_", disclosed).withColumn("label", F.concat("label", F.lit(" ("), ip_scope(F.col("value")), F.lit(")")))
    return out if disclosed is None else out.unionByName(disclosed.select("scope_id", "value", F.col("value").alias("label")).distinct())


def user_labels(values: DataFrame, disclosed: DataFrame | None = None) -> DataFrame:
    """Labels ``USER_n`` likewise; system accounts keep their name and take no number."""
    real = values.where(F.col("value").isNotNull() & ~F.col("value").isin("", "N/A") & ~F.lower("value").isin(*SYSTEM_ACCOUNTS) & ~F.col("value").rlike(USER_LABEL))
    out = numbered(real, "USER_", disclosed)
    return out if disclosed is None else out.unionByName(disclosed.select("scope_id", "value", F.col("value").alias("label")).distinct())


def summary(labels: DataFrame) -> DataFrame:
    """Per scope the addresses and users that have labels, and whether a value was disclosed. labels has kind, value and label."""
    return labels.groupBy("scope_id").agg(F.count_if(F.col("kind") == "ip").alias("ips"), F.count_if(F.col("kind") == "user").alias("users"), F.max(F.col("value") == F.col("label")).alias("disclosed"))


def found_ips(text: Column) -> Column:
    """Addresses in a text: loose candidates that are valid."""
    return F.filter(F.regexp_extract_all(text, F.lit(LOOSE), F.lit(0)), is_ip)


def found_users(text: Column) -> Column:
    """Names in a text, pattern by pattern, then home folders."""
    each = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in USER_PATTERNS] + [F.regexp_extract_all(text, F.lit(HOME), F.lit(2))]
    return F.flatten(F.array(*each))


def replace_ips(text: Column, label) -> Column:
    """Valid addresses replaced by label(address); what only looks like one stays."""
    gaps, hits = F.split(text, LOOSE, -1), F.regexp_extract_all(text, F.lit(LOOSE), F.lit(0))
    return F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.when(is_ip(F.get(hits, i)), label(F.get(hits, i))), F.get(hits, i), F.lit("")))), "")


def replace_names(text: Column, names: Column) -> Column:
    """Whole-word occurrences of names (array of value, label), longest first."""
    ordered = F.reverse(F.array_sort(F.transform(names, lambda n: F.struct(F.length(n["value"]).alias("l"), n["value"].alias("value"), n["label"].alias("label")))))
    pattern = lambda v: F.concat(F.lit(r"(?<![\w.-])\Q"), v, F.lit(r"\E(?![\w.-])"))
    return F.aggregate(ordered, text, lambda acc, n: F.regexp_replace(acc, pattern(n["value"]), n["label"]))


def hide_commands(text: Column) -> Column:
    """Working folders hidden, commands cut to the program's name."""
    out = F.regexp_replace(text, r"(?i)\bPWD=\S+", f"PWD={HIDDEN}")
    out = F.regexp_replace(out, r"(?i)\bCOMMAND=\s+(?=;|$)", f"COMMAND={EMPTY}")
    return F.regexp_replace(out, r"(?i)\bCOMMAND=(?!<bos>)\s*(?:[^\s;]*/)?([^\s;/]*).*?(?=\s*(?:;|$))", "COMMAND=$1")


def tokens(text: Column) -> Column:
    """What may be a name in a text: runs of the characters that names have, also without marks at their ends."""
    runs = F.regexp_extract_all(text, F.lit(r"[\w.$-]+"), F.lit(0))
    return F.array_distinct(F.concat(runs, F.transform(runs, lambda t: F.regexp_replace(t, r"^[.-]+|[.-]+$", ""))))


def scrub(df: DataFrame, text: str, ip: str | None = None, user: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Add <text>_scrubbed to df (scope_id, row_id, text) and give the labels (scope_id, kind, value, label).

    Values are numbered by row_id and place in the text; what stands in the columns ip and user comes before the text of
    its row, and ip_label and user_label (N/A without a value) are added for them. A name that one row of a scope shows is
    replaced in all rows of the scope, wherever it stands as a whole word. A null text is an empty one.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    field = lambda c: F.array(F.col(c)) if c else F.array().cast("array<string>")
    seen = lambda c, found: df.select("scope_id", "row_id", F.posexplode(F.concat(field(c), found)).alias("p", "value")).select("scope_id", F.struct("row_id", "p").alias("position"), "value")
    ips, users = ip_labels(seen(ip, found_ips(t))), user_labels(seen(user, found_users(t)))
    labels = ips.withColumn("kind", F.lit("ip")).unionByName(users.withColumn("kind", F.lit("user")))
    pair = F.struct("value", "label")
    per_row = lambda found, own, name: df.select("scope_id", "row_id", F.explode(F.array_distinct(found)).alias("value")).join(own, ["scope_id", "value"]).groupBy("scope_id", "row_id").agg(F.collect_list(pair).alias(name))
    out = df.join(per_row(F.concat(field(ip), found_ips(t)), ips, "lm_ips"), ["scope_id", "row_id"], "left").join(per_row(F.concat(field(user), found_users(t), tokens(t)), users, "lm_users"), ["scope_id", "row_id"], "left")
    none = F.array().cast("array<struct<value:string,label:string>>")
    lm_ips, lm_users = F.coalesce("lm_ips", none), F.coalesce("lm_users", none)
    label = lambda pairs, v: F.get(F.transform(F.filter(pairs, lambda x: x["value"] == v), lambda x: x["label"]), 0)
    done = {f"{text}_scrubbed": hide_commands(replace_names(replace_ips(t, lambda v: label(lm_ips, v)), lm_users))}
    for c, name, pairs in ((ip, "ip_label", lm_ips), (user, "user_label", lm_users)):
        if c:
            done[name] = F.when(F.coalesce(F.col(c), F.lit("")).isin("", "N/A"), "N/A").otherwise(F.coalesce(label(pairs, F.col(c)), F.col(c)))
    return out.withColumns(done).drop("lm_ips", "lm_users"), labels
