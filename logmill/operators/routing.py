"""Alert routing: outbox rows and their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Channels by severity, marks, the longest field.
CHANNELS = {"info": ("dashboard",), "low": ("dashboard",), "medium": ("dashboard", "email"), "high": ("dashboard", "email", "telegram"), "critical": ("dashboard", "email", "telegram", "sms")}
MARKS = {"critical": "🔴", "high": "🟠", "medium": "🟡", "low": "🔵", "info": "⚪"}
MOST_CHARACTERS = 4096


def outbox(alerts: DataFrame) -> DataFrame:
    """A row for each alert and channel of its severity."""
    channels = F.create_map(*[x for k, v in CHANNELS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return alerts.withColumn("channel", F.explode(F.coalesce(F.try_element_at(channels, F.col("severity")), F.array(F.lit("dashboard")))))


def notify_text(name: str = "Alert") -> Column:
    """Mark, rule, severity, address, details, tags and the start of the id."""
    mark = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv]), F.col("severity")), F.lit("⚪"))
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("\n🏷 "), F.array_join("tags", ", "))).otherwise("")
    return F.concat(
        mark, F.lit(f" <b>{name}</b>\n\n<b>Rule:</b> "), F.col("rule_title"), F.lit("\n<b>Severity:</b> "), F.upper("severity"), F.lit("\n<b>Source IP:</b> <code>"),
        F.coalesce(F.nullif("src_ip", F.lit("")), F.lit("N/A")), F.lit("</code>\n\n<b>Details:</b>\n"), F.col("message"), F.lit("\n"), tags, F.lit("\n\n<i>Alert ID: "), F.substring("id", 1, 8), F.lit("...</i>"),
    )


def template_message() -> Column:
    """The rule's own text with its placeholders filled."""
    out = F.col("template")
    for k, c in (("count", F.col("count").cast("string")), ("src_ip", F.col("src_ip")), ("user", F.col("user")), ("timeframe", F.col("timeframe"))):
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(c, F.lit("N/A")))
    return out


def clip(df: DataFrame, most: int = MOST_CHARACTERS) -> DataFrame:
    """All text columns cut to so many characters."""
    return df.withColumns({c: F.substring(c, 1, most) for c, t in df.dtypes if t == "string"})
