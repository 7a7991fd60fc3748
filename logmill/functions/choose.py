"""Helpers for building column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_case(names: list[str], cases: list[tuple[Column | None, dict[str, Column]]]) -> Column:
    """A struct of text fields from the first case that holds; a case without condition is the last.

    Only the fields of that case are evaluated.
    """
    out = F.lit(None)
    for condition, values in reversed(cases):
        own = F.struct(*[values.get(n, F.lit(None)).cast("string").alias(n) for n in names])
        out = own if condition is None else F.when(condition, own).otherwise(out)
    return out


def once(*columns: Column) -> Column:
    """Columns behind a generator of one row, so that no later expression evaluates them again."""
    return F.inline(F.array(F.struct(*columns)))


def unpack(struct: Column) -> Column:
    """The fields of a struct as columns, evaluated once."""
    return F.inline(F.array(struct))


def group(text: str | Column, pattern: str, n: int) -> Column:
    """Capture n of the first match, null where it is empty or nothing matches."""
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


def captures(text: Column, pattern: str, groups: int) -> Column:
    """All captures of the first match in one pass: an array whose element 0 is empty, captures that are absent are empty too.

    The text must not hold a line break. Without a match the array has one element, the text.
    """
    return F.split(F.regexp_replace(text, f"^.*?(?:{pattern}).*$", "".join(f"\n${i + 1}" for i in range(groups))), "\n")


def contains_any(text: Column, parts) -> Column:
    """Whether the text has one of the parts."""
    return text.rlike("|".join(rf"\Q{p}\E" for p in parts))
