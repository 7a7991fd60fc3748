"""Time stamps and durations of log formats, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_stamp(text: Column, now: Column) -> Column:
    """ISO 8601 with Z or an offset and any fraction, cut to microseconds; no offset means UTC; bad text means now."""
    zoned = F.regexp_replace(text, r"(:\d{2}:\d{2}(?:\.\d+)?)$", "$1Z")  # in any session zone
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(zoned, r"(\.\d{6})\d+", "$1")), now)


def bsd_stamp(text: Column, now: Column, zone: str = "UTC") -> Column:
    """``Mon d HH:mm:ss`` in local time without a year: this year's, or the last one's if this year's lies over a day
    ahead or isn't a date (29 February); bad text means now."""
    squeezed = F.regexp_replace(text, r"\s+", " ")

    def in_year(year: Column) -> Column:
        return F.to_utc_timestamp(F.try_to_timestamp(F.concat(year.cast("string"), F.lit(" "), squeezed, F.lit(" Z")), F.lit("yyyy MMM d HH:mm:ss X")), zone)

    this, last = in_year(F.year(now)), in_year(F.year(now) - 1)
    return F.coalesce(F.when(this > now + F.expr("interval 1 day"), F.coalesce(last, this)).otherwise(F.coalesce(this, last)), now)


def syslog_stamp(text: Column, now: Column, zone: str = "UTC") -> Column:
    return F.when(text.rlike(r"^\d{4}-"), iso_stamp(text, now)).otherwise(bsd_stamp(text, now, zone))


def access_stamp(text: Column, now: Column) -> Column:
    """``dd/Mon/yyyy:HH:mm:ss +hhmm``; bad text means now."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("dd/MMM/yyyy:HH:mm:ss Z")), now)


def duration_seconds(text: Column) -> Column:
    """Ns, Nm, Nh or Nd in seconds; another unit counts as minutes, no number or nothing as 300."""
    number = F.substring(text, 1, 30).substr(F.lit(1), F.length(text) - 1).try_cast("long")
    unit = F.lower(F.right(text, F.lit(1)))
    return F.coalesce(number * F.when(unit == "s", 1).when(unit == "h", 3600).when(unit == "d", 86400).otherwise(60), F.lit(300)).cast("long")
