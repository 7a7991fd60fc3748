"""URL filter: host rules first, then an empirical-Bayes reputation of hosts.

A labelled page is blocked or not. The blocking rate of a host is shrunk towards that of its registered domain, this
towards its suffix, and this towards all pages: each level's posterior is the prior of the level below. How much the
children of a parent differ is estimated from the beta-binomial spread of their outcomes; a child's prior has the mean
of its parent's posterior, and the variance of the children around their parent plus that of the parent itself, so a
parent without outcomes widens it. A page is blocked if the lower bound of its host's posterior lies above ``limit``, so
a host of which little is known, under a suffix of which little is known, stays allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmill.llm.common import count_at_most, lower_ascii, shared_dir, stored

#: (host and path, verdict)
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Suffixes of two labels under which domains are registered, unless a caller has a longer list; all others have one label.
TWO_LABELS = ("ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "or.jp", "org.au", "org.uk")
LEVELS = ("suffix", "domain", "host")
Z, LIMIT, MOST_RULES, BROADCAST_RULES = 1.645, 0.5, 50, 200_000


def host_of(url: str = "url") -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(rules, host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; both null if none does. For the few rules that go into one expression."""
    name = verdict = F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((F.col(host) == rule_host) | F.col(host).endswith("." + rule_host)) & F.col(path).startswith(slash + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def with_rules(placed: DataFrame, rules, most: int = BROADCAST_RULES) -> DataFrame:
    """placed (host, path) with rule and said, the longest rule that fits and its verdict.

    rules: pairs of rule and verdict, or a DataFrame (rule, said). Up to MOST_RULES pairs are one expression. More are a
    table: a host's suffixes meet the hosts that have rules, and these tell which lengths their paths have, so that each
    place looks up as many starts of its path as there are lengths, and no list of rules is passed over. Places are
    looked up once each, however many rows have them. Up to most rules are broadcast; the rows are the same beyond.
    Of pairs that name a rule twice the last counts, in a table block does.
    """
    if not isinstance(rules, DataFrame) and len(rules) <= MOST_RULES:
        rule, says = longest_rule(rules)
        return placed.withColumns({"rule": rule, "said": says})
    spark, place = placed.sparkSession, shared_dir(placed.sparkSession)
    table = rules.select("rule", "said") if isinstance(rules, DataFrame) else spark.createDataFrame(list(dict(rules).items()), "rule string, said string")
    split = {"lm_host": F.substring_index("rule", "/", 1), "lm_start": F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)")}
    table = stored(table.where("rule is not null").groupBy("rule").agg(F.max("said").alias("said")).withColumns(split), f"{place}/rules")
    few = (lambda df: F.broadcast(df)) if count_at_most(table, most) else (lambda df: df)
    lengths = table.groupBy("lm_host").agg(F.collect_set(F.length("lm_start")).alias("lm_lengths"))
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    places = placed.select("host", "path").distinct()
    met = places.select("host", "path", F.explode(ends).alias("lm_host")).join(few(lengths), "lm_host")
    starts = met.select("host", "path", "lm_host", F.explode(F.filter("lm_lengths", lambda n: n <= F.length("path"))).alias("lm_n"))
    fits = starts.withColumn("lm_start", F.expr("substring(path, 1, lm_n)")).join(few(table), ["lm_host", "lm_start"])
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule"), "rule", "said")).alias("lm_best"))
    return placed.join(stored(best.select("host", "path", "lm_best.rule", "lm_best.said"), f"{place}/decided"), ["host", "path"], "left")


def suffix_and_domain(host: str = "host", two_labels=TWO_LABELS) -> dict[str, Column]:
    """The public suffix and the registered domain; a host that is a suffix itself is its own domain."""
    two = F.substring_index(host, ".", -2)
    long = two.isin(*two_labels)
    return {"suffix": F.when(long, two).otherwise(F.substring_index(host, ".", -1)), "domain": F.when(long, F.substring_index(host, ".", -3)).otherwise(two)}


def strength(groups: DataFrame) -> DataFrame:
    """One row, s: the pseudo-count that a parent's mean is worth if it is known well, from n, k and that mean m.

    By moments: under a beta-binomial with correlation r the expected value of sum(n (k/n - m)**2) is
    sum(m (1 - m) (1 + (n - 1) r)), and s is (1 - r) / r. r is kept within 0.01 and 0.9.
    """
    v = F.col("m") * (1 - F.col("m"))
    seen = groups.where("n > 0").agg(F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("m"), 2)).alias("spread"), F.sum(v).alias("v"), F.sum(v * (F.col("n") - 1)).alias("v_more"))
    r = F.least(F.lit(0.9), F.greatest(F.lit(0.01), F.coalesce(F.try_divide(F.col("spread") - F.col("v"), F.col("v_more")), F.lit(0.01))))
    return seen.select(((1 - r) / r).alias("s"))


def reputation(pages: DataFrame, two_labels=TWO_LABELS) -> DataFrame:
    """Of each host: its mean blocking rate, the bound below it, and its labelled pages n and blocked k.

    pages has host and bad (1, 0 or null for unlabelled pages). Aggregates shrink from pages to hosts to domains to
    suffixes, each from the one before, and each level is stored, so that none is computed twice.
    """
    place, both = shared_dir(pages.sparkSession), [F.sum("n").alias("n"), F.sum("k").alias("k")]
    hosts = pages.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k")).withColumns(suffix_and_domain("host", two_labels))
    counts = {"host": (hosts := stored(hosts, f"{place}/hosts")), "domain": (domains := stored(hosts.groupBy("suffix", "domain").agg(*both), f"{place}/domains")), "suffix": stored(domains.groupBy("suffix").agg(*both), f"{place}/suffixes")}
    total = lambda c, more: F.coalesce(F.sum(c), F.lit(0)) + more
    root = counts["suffix"].agg((total("k", 1) / total("n", 2)).alias("m"), total("n", 3).alias("c")).select("m", (F.col("m") * (1 - F.col("m")) / F.col("c")).alias("v"))
    above = counts["suffix"].join(F.broadcast(root))  # one row
    for level, key in zip(LEVELS, (None, ["suffix"], ["suffix", "domain"]), strict=True):
        if key:
            above = stored(above, f"{place}/{level}_above")
            above = counts[level].join(above.select(*key, F.col("post").alias("m"), F.col("spread").alias("v")), key)
        m, s = F.col("m"), F.col("s")
        wide = (m * (1 - m) - F.col("v")) / (s + 1) + F.col("v")
        above = above.join(F.broadcast(strength(above))).withColumn("s", m * (1 - m) / wide - 1)  # one row
        above = above.withColumn("post", (F.col("k") + s * m) / (F.col("n") + s)).withColumn("spread", F.col("post") * (1 - F.col("post")) / (F.col("n") + s + 1)).drop("s", "m", "v")
    return above.select("host", "n", "k", F.col("post").alias("bad_rate"), (F.col("post") - Z * F.sqrt("spread")).alias("bad_bound"))


def judge(pages: DataFrame, rules=RULES, bad: str | None = None, limit: float = LIMIT, two_labels=TWO_LABELS) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate and bad_bound of every row of pages.

    Outcomes are learnt from column bad (1 blocked, 0 not, null unlabelled) if one is named, otherwise from the pages
    that a rule decides. A null url, or one without ``://``, has empty host and path and is judged as the host '' with
    the others like it. rules: few or many, see with_rules. Repeated rows are judged alike and count as often as they occur. Columns of pages other than
    page_id, url and bad aren't read. With no outcome at all everything without a rule is allowed. two_labels: the
    suffixes of two labels under which domains are registered.
    """
    read = pages.select("page_id", "url", *([F.col(bad).cast("int").alias("bad")] if bad else []))
    placed = read.withColumns({"host": host_of(), "path": path_of()}).drop("url")
    placed = with_rules(placed, rules)
    if not bad:
        placed = placed.withColumn("bad", (F.col("said") == "block").cast("int"))
    known = reputation(placed.select("host", "bad"), two_labels)
    judged = placed.join(known.select("host", "bad_rate", "bad_bound"), "host")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("bad_bound") > limit, "block").otherwise("allow")).alias("verdict"), "bad_rate", "bad_bound")
