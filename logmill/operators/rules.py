"""Detection rules: selection, group, count over a lookback, threshold, cooldown, alert. All rules run in one plan."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, date, datetime
from functools import reduce
from operator import and_, eq, ge, gt, le, lt
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from logmill.operators.parse import CORE, EXTRA, INTS
from logmill.session import shared_dir

DEFAULT_COOLDOWN = 300
#: Seconds of some 3,000 years: further back there is no event.
LONGEST = 10**11
#: Fired moments that a task gives out at a time.
MOST_MOMENTS = 10_000
#: Buckets of a period that one task looks over.
TOGETHER = 4096
CONDITION = r"selection\s*\|\s*count\((\w+)\)\s*(>=|<=|==|>|<)\s*(\d+)"
FIELDS = {*CORE, "source", "user"}
#: What a selection may name.
KNOWN = {*FIELDS, *EXTRA, "service"}


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    selection: dict
    condition: str
    level: str = "medium"
    timeframe: str = "5m"
    cooldown: str | None = None
    tags: tuple[str, ...] = ()
    status: str = "active"
    message: str | None = None
    group_by: str = field(init=False, default="")
    op: str = field(init=False, default="")
    n: int = field(init=False, default=0)

    def __post_init__(self):
        if m := re.search(CONDITION, str(self.condition)):
            for k, v in zip(("group_by", "op", "n"), (m[1], m[2], int(m[3])), strict=True):
                object.__setattr__(self, k, v)

    @property
    def seconds(self) -> int:
        return seconds(self.timeframe)

    @property
    def cooldown_s(self) -> int:
        return seconds(self.cooldown) if self.cooldown else DEFAULT_COOLDOWN


def seconds(text: str | None) -> int:
    """Ns, Nm, Nh or Nd; another unit counts as minutes, no number or nothing as 300 s; LONGEST at most."""
    try:
        return max(-LONGEST, min(LONGEST, int(text[:-1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400}.get(text[-1].lower(), 60)))
    except (ValueError, TypeError, IndexError):
        return 300


#: Shipped rules: fixed values.
SHIPPED = (
    Rule("rule-001", "SSH Brute Force Detection", {"event_type": "auth_failure", "process": "sshd"}, "selection | count(src_ip) > 10", "high", "5m", None, ("attack.credential_access", "attack.t1110"), message="SSH brute force detected: {count} failed attempts from {src_ip} in {timeframe}"),
    Rule("rule-002", "Web Scanning", {"event_type": "http_request", "is_suspicious": "true"}, "selection | count(src_ip) > 10", "medium", "5m", None, ("attack.reconnaissance", "attack.t1595"), message="Web scan: {count} suspicious requests from {src_ip}"),
    Rule("rule-003", "Firewall Block Flood (Possible Port Scan)", {"event_type": "firewall_block"}, "selection | count(src_ip) > 20", "medium", "5m", None, ("attack.reconnaissance", "attack.t1046"), message="Possible port scan: {count} blocked connections from {src_ip}"),
    Rule("rule-004", "Suspicious Sudo Activity", {"event_type": "sudo_command"}, "selection | count(user) > 5", "high", "5m", None, ("attack.privilege_escalation", "attack.t1548"), message="Suspicious sudo activity: {count} commands by {user}"),
    Rule("rule-005", "New User Account Created", {"event_type": "user_added"}, "selection | count(user) > 0", "critical", "1h", "24h", ("attack.persistence", "attack.t1136", "attack.t1136.001"), message="New user account created: {user}"),
    Rule("rule-006", "Failed Sudo Attempt", {"event_type": "sudo_failure"}, "selection | count(user) > 0", "high", "1h", "2h", ("attack.privilege_escalation", "attack.t1548", "attack.t1548.003"), message="Failed sudo attempt by {user}"),
)


def load_rules(folder: str) -> list[Rule]:
    """Active rules of the .yml and .yaml files of a folder, by name; a file without title or detection is left out."""
    import yaml

    out = []
    for p in sorted(x for x in Path(folder).iterdir() if x.suffix in (".yml", ".yaml")):
        try:
            d = yaml.safe_load(p.read_text())
            detection, response = d["detection"], d.get("response") or {}
            rule = Rule(str(d.get("id", p.stem)), str(d["title"]), detection.get("selection") or {}, str(detection.get("condition", "")), str(d.get("level", "medium")), str(detection.get("timeframe", "5m")), response.get("cooldown"), tuple(map(str, d.get("tags") or ())), d.get("status", "active"), response.get("message"))
        except (yaml.YAMLError, KeyError, TypeError, AttributeError):
            continue
        if rule.status == "active":
            out.append(rule)
    return out


def rule_table(spark: SparkSession, rules) -> DataFrame:
    rows = [(str(r.id), str(r.title), str(r.level), str(r.condition), str(r.timeframe), r.seconds, r.cooldown_s, r.group_by, r.op, min(r.n, MOST), [str(t) for t in r.tags], str(r.message or ""), problem_of(r)) for r in rules]
    return spark.createDataFrame(rows, "rule_id string, rule_title string, level string, condition string, timeframe string, timeframe_s long, cooldown_s long, group_by string, op string, n long, tags array<string>, template string, problem string")


def field_column(name: str) -> Column:
    return F.col(f"extra.{name}") if name in EXTRA else F.col(name)


COMPARE = {"": eq, "gte": ge, "gt": gt, "lte": le, "lt": lt, "contains": lambda c, v: c.contains(v), "in": lambda c, v: c.isin(*v)}
#: The largest whole number of a column.
MOST = 2**63 - 1


class Unfit(ValueError):
    """Why a part of a selection can match no event."""


def kind_of(name: str) -> str:
    return EXTRA.get(name) or ("int" if name in INTS else "timestamp" if name == "timestamp" else "string")


def fitted(name: str, value: object) -> object:
    """The value in the type that the field has. Columns take numbers for text and text for numbers and times, as a
    database does; what stands in extra is JSON, where types are strict."""
    kind, column = kind_of(name), name not in EXTRA
    try:
        if isinstance(value, bool):
            if kind == "boolean":
                return value
        elif kind == "int":
            value = int(value) if column and isinstance(value, str) else value
            if isinstance(value, (int, float)) and not math.isnan(value):
                return value if isinstance(value, int) and abs(value) <= MOST else float(value)
        elif kind == "timestamp":
            at = datetime.fromisoformat(value) if isinstance(value, str) else value if isinstance(value, datetime) else datetime(value.year, value.month, value.day) if isinstance(value, date) else None
            if at:
                return at if at.tzinfo else at.replace(tzinfo=UTC)
        elif kind == "string" and (isinstance(value, str) or column and isinstance(value, (int, float))):
            str(value).encode()
            return str(value)
    except (ValueError, OverflowError):
        pass
    raise Unfit(f"value of another type: {name}")


def term(key: object, value: object) -> tuple[str, str, object]:
    """Field, comparison and value of a part of a selection, the value in the field's type; Unfit if no event can match."""
    name, _, how = str(key).partition("__")
    name = "process" if name == "service" else name
    if name not in KNOWN:
        raise Unfit(f"field unknown: {name}")
    if how not in COMPARE:
        raise Unfit(f"comparison unknown: {how}")
    truth = lambda v: v.lower() == "true" if isinstance(v, str) and v.lower() in ("true", "false") else v
    if how == "in":
        if not isinstance(value, (list, tuple)):
            raise Unfit(f"no list: {key}")
        fit = []
        for v in value:
            try:
                fit += [fitted(name, v)] if v is not None else []
            except Unfit:
                if name not in EXTRA:
                    raise
        if not fit:
            raise Unfit(f"no value of its type: {name}")
        return name, how, fit
    if how == "contains":
        if not isinstance(value, str):
            raise Unfit(f"value of another type: {name}")
        return name, how, value
    if value is None:
        if how or name in EXTRA:
            raise Unfit(f"never null: {name}")
        return name, how, None
    value = fitted(name, truth(value))
    if how and kind_of(name) == "boolean":
        raise Unfit(f"no order: {name}")
    return name, how, value


def problem_of(rule: Rule) -> str | None:
    """Why a rule can't run: an unreadable condition, a group or field that no event has, an unknown comparison, or a
    value that no event can have there."""
    if not rule.op:
        return "condition unreadable"
    if rule.group_by not in FIELDS:
        return "group is no event column"
    if not isinstance(rule.selection, dict):
        return "selection is no mapping"
    try:
        for key, value in rule.selection.items():
            term(key, value)
    except Unfit as e:
        return str(e)
    return None


def matches(name: str, how: str, value: object) -> Column:
    """Whether a field compares to a value of its type; null fields don't, but for equality with null."""
    c = field_column(name)
    if value is None:
        return c.isNull()
    if how == "contains":
        c = c.cast("string")
    elif kind_of(name) == "int":
        whole = lambda v: not isinstance(v, float) or v.is_integer() and abs(v) <= 2**53
        if how == "in":
            value = [int(v) for v in value if whole(v)]
        elif how == "":
            if not whole(value):
                return F.lit(False)
            value = int(value)
    if how == "in":
        value = [F.lit(v) for v in value]
    return F.coalesce(COMPARE[how](c, value if how == "in" else F.lit(value)), F.lit(False))


def predicate(selection: dict) -> Column:
    """All fields equal; service means process, true and false are booleans, null means a column without value, and a
    suffix compares: __gte __gt __lte __lt __contains __in.

    Values are brought to their field's type here, never the field, so no event can make a selection fail. A field that is
    neither a column nor in extra, an unknown suffix, or a value that the field can't have matches no event; a list is a
    value only for __in, where those of another type don't count for fields of extra.
    """
    try:
        return reduce(and_, [matches(*term(k, v)) for k, v in selection.items()], F.lit(True))
    except Unfit:
        return F.lit(False)


def tagged(events: DataFrame, rules, as_of: Column) -> DataFrame:
    """Event rows once for each rule that selects them within its lookback, with rule_id and group_value.

    The lookback has no upper end. Rules that can't run (problem_of) select nothing and don't hold up the others.
    """
    usable = [r for r in rules if not problem_of(r)]
    ts = F.unix_micros("timestamp")
    hit = [F.when(predicate(r.selection) & (ts >= F.unix_micros(as_of) - r.seconds * 1_000_000), F.struct(F.lit(str(r.id)).alias("rule_id"), field_column(r.group_by).cast("string").alias("group_value"))) for r in usable]
    none = F.array().cast("array<struct<rule_id:string,group_value:string>>")
    return events.withColumn("lm_hit", F.explode(F.array_compact(F.array(*hit)) if hit else none)).select("*", "lm_hit.*").drop("lm_hit")


def compare(n: Column, op: Column, limit: Column) -> Column:
    return F.when(op == ">", n > limit).when(op == ">=", n >= limit).when(op == "<", n < limit).when(op == "<=", n <= limit).when(op == "==", n == limit)


def group_counts(events: DataFrame, rules, as_of: Column) -> DataFrame:
    """rule_id, group_value and count; null is a group."""
    return tagged(events, rules, as_of).groupBy("rule_id", "group_value").agg(F.count("*").alias("count"))


def fired(events: DataFrame, rules, as_of: Column, null_groups: str = "emit") -> DataFrame:
    """Groups over their rule's threshold, with the rule's columns."""
    table = rule_table(events.sparkSession, [r for r in rules if not problem_of(r)]).drop("problem")
    out = group_counts(events, rules, as_of).join(F.broadcast(table), "rule_id").where(compare(F.col("count"), F.col("op"), F.col("n")))
    return out if null_groups == "emit" else out.where("group_value is not null")


def alerts(events: DataFrame, rules, as_of: Column, earlier: DataFrame | None = None, null_groups: str = "emit") -> DataFrame:
    """New alerts at as_of. earlier: alerts (rule_id, group_value, created_at) that hold back a group until its cooldown is over;
    null groups aren't held back, and their value is the text None."""
    out = fired(events, rules, as_of, null_groups)
    if earlier is not None:
        e = earlier.select(F.col("rule_id").alias("e_rule"), F.col("group_value").alias("e_value"), F.unix_micros("created_at").alias("e_at"))
        last = e.groupBy("e_rule", "e_value").agg(F.max("e_at").alias("e_at"))
        quiet = (F.col("rule_id") == F.col("e_rule")) & (F.col("group_value") == F.col("e_value")) & (F.col("e_at") >= F.unix_micros(as_of) - F.col("cooldown_s") * 1_000_000) & (F.col("group_value") != "")
        out = out.join(last, quiet, "left_anti")
    value = F.coalesce("group_value", F.lit("None"))
    return out.select(
        F.sha2(F.concat_ws("\x1f", "rule_id", value, as_of.cast("string")), 256).alias("id"), as_of.alias("created_at"), "rule_id", "rule_title", F.col("level").alias("severity"),
        F.concat("rule_title", F.lit(": "), F.col("count").cast("string"), F.lit(" events detected from "), "group_by", F.lit("="), value, F.lit(" in last "), "timeframe").alias("message"),
        F.when(F.col("group_by") == "src_ip", F.col("group_value")).alias("src_ip"), F.when(F.col("group_by") == "user", F.col("group_value")).alias("user"),
        value.alias("group_value"), "tags", F.lit("new").alias("status"), "count", "timeframe", "template",
    )


def evidence(events: DataFrame, rules, found: DataFrame, as_of: Column) -> DataFrame:
    """Bridge rows (alert_id, event_id): all selected events of each alert's group. events has line_id."""
    own = tagged(events, rules, as_of).select("rule_id", F.coalesce("group_value", F.lit("None")).alias("group_value"), F.col("line_id").alias("event_id"))
    return own.join(found.select(F.col("id").alias("alert_id"), "rule_id", "group_value"), ["rule_id", "group_value"]).select("alert_id", "event_id")


def walk(spans: DataFrame, keys: list[str], period: Column | int, step: int = 1, origin: Column | int = 0) -> DataFrame:
    """Of each key's spans (lm_a to lm_b, long seconds) the moments that fire: the first in a span, then each at least period
    seconds after the last that fired; with a step only moments at origin plus its multiples count. A key has one period.

    Spark deals keys to tasks and sorts them there, on disk where needed. A task passes over the sorted rows with the
    last fired moment of one key in memory, so no key is gathered in a row. Keys may be null.
    """
    zero, gap = (F.lit(x) if isinstance(x, int) else x for x in (origin, period))
    own = spans.select(*keys, F.col("lm_a").cast("long").alias("lm_a"), F.col("lm_b").cast("long").alias("lm_b"), zero.cast("long").alias("lm_zero"), gap.cast("long").alias("lm_gap"))
    dealt = own.repartition(*keys).sortWithinPartitions(*keys, "lm_a", "lm_b")
    schema = StructType([*[f for f in own.schema.fields if f.name in keys], StructField("fired_at", LongType())])

    def fire(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(len(keys))]
            rows, moments = [], []
            for i, (start, end, zero, period) in enumerate(zip(*(batch.column(len(keys) + j).to_pylist() for j in range(4)), strict=True)):
                own_key = tuple(c[i] for c in columns)
                if own_key != key:
                    key, last = own_key, None
                t = start if last is None else max(start, last + period)
                t = zero + -(-(t - zero) // step) * step
                while t <= end:
                    rows.append(i)
                    moments.append(t)
                    last = t
                    t = zero + -(-(t + period - zero) // step) * step
                    if len(moments) == MOST_MOMENTS:
                        yield with_moments(batch, rows, moments)
                        rows, moments = [], []
            yield with_moments(batch, rows, moments)

    def with_moments(batch: pa.RecordBatch, rows: list[int], moments: list[int]) -> pa.RecordBatch:
        at = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays([*[batch.column(i).take(at) for i in range(len(keys))], pa.array(moments, pa.int64())], names=[*keys, "fired_at"])

    return dealt.mapInArrow(fire, schema)


def pointers(times: DataFrame, period: int) -> DataFrame:
    """For each time lm_t of a key lm_k the first one of the key at least period later: lm_k, lm_t, lm_next (null without one).

    Times are dealt to buckets of a period. What is looked for stands in the next bucket behind the same place, found by a
    running minimum over the two buckets' rows, or else it is the first one of the next bucket that has any. No task has
    more than the distinct seconds of two periods, or of some thousand buckets' first times.
    """
    own = times.select("lm_k", "lm_t", F.floor(F.col("lm_t") / period).alias("lm_b")).withColumn("lm_r", F.col("lm_t") - F.col("lm_b") * period)
    both = own.withColumn("lm_kind", F.lit(1)).unionByName(own.withColumns({"lm_kind": F.lit(0), "lm_b": F.col("lm_b") + 1}))
    down = Window.partitionBy("lm_k", "lm_b").orderBy(F.desc("lm_r"), F.desc("lm_kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("lm_near", F.min(F.when(F.col("lm_kind") == 1, F.col("lm_t"))).over(down)).where("lm_kind = 0").select("lm_k", "lm_t", (F.col("lm_b") - 1).alias("lm_b"), "lm_near")
    firsts = own.groupBy("lm_k", "lm_b").agg(F.min("lm_t").alias("lm_first")).withColumns({"lm_s": F.floor(F.col("lm_b") / TOGETHER), "lm_x": F.struct("lm_b", "lm_first")})
    heads = firsts.groupBy("lm_k", "lm_s").agg(F.slice(F.array_sort(F.collect_list("lm_x")), 1, 2).alias("lm_heads"))  # of TOGETHER at most
    over, inside = Window.partitionBy("lm_k").orderBy("lm_s"), Window.partitionBy("lm_k", "lm_s").orderBy("lm_b")
    empty = F.array().cast("array<struct<lm_b:long,lm_first:long>>")
    later = heads.select("lm_k", "lm_s", F.concat(*[F.coalesce(F.lead("lm_heads", i).over(over), empty) for i in (1, 2)]).alias("lm_later"))
    after = firsts.withColumn("lm_after", F.array_compact(F.array(F.lead("lm_x", 1).over(inside), F.lead("lm_x", 2).over(inside)))).join(later, ["lm_k", "lm_s"])
    far = F.filter(F.concat("lm_after", "lm_later"), lambda x: x["lm_b"] >= F.col("lm_b") + 2)
    after = after.select("lm_k", "lm_b", F.try_element_at(far, F.lit(1))["lm_first"].alias("lm_far"))
    return near.join(after, ["lm_k", "lm_b"]).select("lm_k", "lm_t", F.coalesce("lm_near", "lm_far").alias("lm_next"))


def doubled(times: DataFrame, period: int) -> DataFrame:
    """Of the times lm_t of each key lm_k those that fire, by pointer doubling: lm_k and lm_t.

    A round lets what has fired jump along its pointers, and then joins pointers with themselves, so they reach twice as
    far: as many rounds as the number of fired times has bits. Rows of a key are spread by time in every join, and each
    round is a stored table, so a lost executor costs one round.
    """
    spark, place = times.sparkSession, shared_dir(times.sparkSession)

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{place}/{name}")
        return spark.read.schema(df.schema).parquet(f"{place}/{name}")

    jump = kept(pointers(times, period), "jump-0")
    new = kept(times.groupBy("lm_k").agg(F.min("lm_t").alias("lm_t")), "fired-0")
    fired, i = new, 0
    while True:
        i += 1
        new = kept(fired.join(jump.where("lm_next is not null"), ["lm_k", "lm_t"]).select("lm_k", F.col("lm_next").alias("lm_t")), f"fired-{i}")
        if new.isEmpty():
            return fired
        fired = fired.unionByName(new)
        then = jump.select("lm_k", F.col("lm_t").alias("lm_next"), F.col("lm_next").alias("lm_then"))
        jump = kept(jump.where("lm_next is not null").join(then, ["lm_k", "lm_next"]).select("lm_k", "lm_t", F.col("lm_then").alias("lm_next")), f"jump-{i}")


def cooldown_fold(hits: DataFrame, keys: list[str], at: str, gap: int, most: int = 2_000_000) -> DataFrame:
    """Of the times (long seconds) of each key those that fire: the first, then each over gap seconds after the last that fired.

    Times that fall in the same second are counted once, spread over all tasks, before keys are dealt; null times don't
    count. A key with up to most of them is walked by a task; those of keys with more are spread over tasks, by pointer
    doubling. These keys' table has a row for every most times at most, and is broadcast. Both ways give the same rows.
    """
    spark, place = hits.sparkSession, shared_dir(hits.sparkSession)
    distinct = hits.select(*keys, F.col(at).alias("lm_a")).where("lm_a is not null").distinct()
    distinct.write.parquet(f"{place}/times")
    times = spark.read.schema(distinct.schema).parquet(f"{place}/times")
    walked = lambda df: walk(df.withColumn("lm_b", F.col("lm_a")), keys, gap + 1)
    if times.count() <= most:  # the files know
        return walked(times)
    hot = times.groupBy(*keys).agg(F.count("*").alias("lm_n")).where(F.col("lm_n") > most).select(*[F.col(k).alias(f"lm_h_{k}") for k in keys], F.monotonically_increasing_id().alias("lm_k"))
    hot.write.parquet(f"{place}/hot")
    hot = F.broadcast(spark.read.schema(hot.schema).parquet(f"{place}/hot"))
    same = reduce(and_, [times[k].eqNullSafe(hot[f"lm_h_{k}"]) for k in keys])
    own = doubled(times.join(hot, same).select("lm_k", F.col("lm_a").cast("long").alias("lm_t")), gap + 1)
    found = own.join(hot, "lm_k").select(*[F.col(f"lm_h_{k}").alias(k) for k in keys], F.col("lm_t").alias("fired_at"))
    return walked(times.join(hot, same, "left_anti")).unionByName(found)


def replay_all(events: DataFrame, rules, start: Column, end: Column, tick: int, stretch: int = 7 * 86400) -> DataFrame:
    """rule_id, group_value and fired_at (seconds) of the alerts of all rules if they were run every tick from start to end.

    Each event raises its group's count when it comes and lowers it when its lookback ends. Running sums give the spans
    in which the threshold holds, and only those spans are walked, so no event is copied to every tick. The sums are made
    within stretches of time, on top of what each group has before a stretch, so a group isn't added up by one task.
    Groups without a value aren't held back by anything and don't take part.
    """
    usable = [r for r in rules if not problem_of(r)]
    table = F.broadcast(rule_table(events.sparkSession, usable).select("rule_id", "timeframe_s", "cooldown_s", "op", F.col("n").alias("lm_limit")))  # a row for each rule
    s, e, key = start.cast("long"), end.cast("long"), ["rule_id", "group_value"]
    hits = tagged(events, usable, F.timestamp_seconds(F.lit(0))).where("group_value is not null").select(*key, F.unix_timestamp("timestamp").alias("ts")).join(table.select("rule_id", "timeframe_s"), "rule_id")
    both = F.array(F.struct(F.col("ts").alias("at"), F.lit(1).alias("d")), F.struct((F.col("ts") + F.col("timeframe_s") + 1).alias("at"), F.lit(-1).alias("d")))
    edges = hits.select(*key, F.explode(both).alias("x")).groupBy(*key, "x.at").agg(F.sum("x.d").alias("d")).withColumn("lm_s", F.floor(F.col("at") / stretch))
    sums = edges.groupBy(*key, "lm_s").agg(F.sum("d").alias("lm_d"), F.min("at").alias("lm_first"))
    by_stretch, inside = Window.partitionBy(*key).orderBy("lm_s"), Window.partitionBy(*key, "lm_s").orderBy("at")
    sums = sums.select(*key, "lm_s", F.coalesce(F.sum("lm_d").over(by_stretch.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("lm_before"), F.lead("lm_first").over(by_stretch).alias("lm_next"))
    counted = edges.join(sums, [*key, "lm_s"]).withColumns({"n": F.col("lm_before") + F.sum("d").over(inside), "until": F.coalesce(F.coalesce(F.lead("at").over(inside), F.col("lm_next")) - 1, e)})
    spans = counted.join(table, "rule_id").where(compare(F.col("n"), F.col("op"), F.col("lm_limit")) & (F.col("n") >= 1))
    spans = spans.select(*key, F.greatest(F.col("at"), s).alias("lm_a"), F.least(F.col("until"), e).alias("lm_b"), (F.col("cooldown_s") + 1).alias("lm_period")).where("lm_a <= lm_b")
    return walk(spans, key, F.col("lm_period"), tick, s)


def replay(events: DataFrame, rule: Rule, start: Column, end: Column, tick: int) -> DataFrame:
    """group_value and fired_at of one rule's alerts, as replay_all gives them."""
    return replay_all(events, [rule], start, end, tick).drop("rule_id")


def technique_rollup(found: DataFrame) -> DataFrame:
    """Alerts per technique tag."""
    return found.select(F.explode("tags").alias("technique")).where(F.col("technique").startswith("attack.t")).groupBy("technique").agg(F.count("*").alias("alerts"))


def lint(rules: DataFrame) -> DataFrame:
    """rule_id and problem: cooldown under the timeframe, unreadable condition, whatever else problem_of finds, id used twice, no technique tag."""
    twice = rules.groupBy("rule_id").agg(F.count("*").alias("c")).where("c > 1").select("rule_id", F.lit("id used twice").alias("problem"))
    checks = [(F.col("cooldown_s") < F.col("timeframe_s"), "cooldown under timeframe"), (F.col("op") == "", "condition unreadable"), (~F.exists("tags", lambda t: t.startswith("attack.t")), "no technique tag"), (~F.col("group_by").isin(*FIELDS, ""), "group is no event column")]
    fields = F.when(~F.col("problem").isin("condition unreadable", "group is no event column"), F.col("problem"))
    own = rules.select("rule_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(p)) for c, p in checks], fields))).alias("problem"))
    return own.union(twice)


def missing_fields(used: DataFrame, events: DataFrame) -> DataFrame:
    """Fields (column field) that rules use but no event has in extra."""
    seen = events.select(F.explode(F.json_object_keys(F.to_json("extra"))).alias("field")).distinct()
    return used.select("field").distinct().join(seen, "field", "left_anti")
