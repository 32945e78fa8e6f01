"""Numbers, flags, dates and the list normalisers of note headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR_SECONDS = 31_557_600.0


def as_float(c: Column) -> Column:
    """A number from "5000", "$1,500" or the like; anything else, not-a-number and infinities are 0."""
    text = F.regexp_replace(F.replace(F.trim(c.cast("string")), F.lit(","), F.lit("")), r"^\$+", "")
    value = F.when(F.lower(text).isin("true", "false", ""), None).otherwise(text).try_cast("double")
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)


def truthy(c: Column) -> Column:
    text = F.lower(F.trim(c.cast("string")))
    return F.coalesce(text.isin("true", "yes", "y", "1") | (as_float(c) != 0), F.lit(False))


def clamp_score(c: Column) -> Column:
    """Rounded half to even, within 0 and 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(c, 0).cast("int")))


def quality_multiplier(quality: Column, weight: float = 1.0) -> Column:
    return F.lit(1.0) if weight <= 0 else 1.0 + weight * (0.8 * (quality / 100.0) - 0.4)


def recency_multiplier(created_ts: Column, now: float, weight: float = 1.0) -> Column:
    """Mild boost for new, mild decay for old; 0 (unknown) is neutral. ``now`` is a parameter so that results repeat."""
    if weight <= 0:
        return F.lit(1.0)
    age = F.greatest(F.lit(0.0), (F.lit(now) - created_ts) / YEAR_SECONDS)
    delta = F.greatest(F.lit(-0.25), F.least(F.lit(0.15), 0.15 - 0.06 * age))
    return F.when(F.coalesce(created_ts, F.lit(0.0)) == 0, 1.0).otherwise(1.0 + weight * delta)


def sigmoid(x: Column) -> Column:
    return F.when(F.isnan(x), 0.0).when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def day_prefix(c: Column) -> Column:
    return F.try_to_date(F.substring(c, 1, 10))


def effective_day(created: Column, mtime_ns: Column) -> Column:
    """``created``, else the UTC day of a time in nanoseconds: whole days, so that days beyond what a timestamp holds are no error."""
    day = F.lit(86_400_000_000_000)
    return F.coalesce(created, F.date_from_unix_date(F.call_function("div", mtime_ns - F.pmod(mtime_ns, day), day).cast("int")))


def epoch_day(day: Column) -> Column:
    """Seconds at the start of the day in UTC; 0 for no day."""
    return F.coalesce((F.unix_date(day) * 86400).cast("double"), F.lit(0.0))


def normalize_list(c: Column) -> Column:
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda s: F.trim(s)), lambda s: s != "")


def normalize_cwe(c: Column) -> Column:
    return F.transform(normalize_list(c), lambda s: F.when(s.rlike(r"^\d+$"), F.concat(F.lit("CWE-"), s)).otherwise(F.upper(s)))


def cwe_tokens(c: Column) -> Column:
    """One upper-case token for each CWE: items are split at commas, semicolons and space, bare numbers get their prefix."""
    parts = F.flatten(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda s: F.split(F.upper(s), r"[,;\s]+")))
    return F.transform(F.filter(parts, lambda t: t != ""), lambda t: F.when(t.rlike(r"^\d+$"), F.concat(F.lit("CWE-"), t)).otherwise(t))


def cwe_filter_token(value: str) -> str:
    """The token a filter value means; a value that is none raises, so that a typo is not answered by nothing."""
    import re

    raw = str(value).strip().upper()
    if m := re.fullmatch(r"(?:CWE)?[-_ ]?(\d+)", raw):
        return f"CWE-{m[1]}"
    if re.fullmatch(r"[A-Z0-9]+(?:-[A-Z0-9]+)*", raw):
        return raw
    raise ValueError(f"cwe filter must look like 'CWE-79' or '79', got {value!r}")


def has_token(joined: Column, token: str) -> Column:
    return F.array_contains(F.split(F.coalesce(joined, F.lit("")), " "), token)


# ---------------------------------------------------------------- lists


def union(a: Column, b: Column) -> Column:
    """First a, then what b adds, in order; blanks are dropped."""
    return F.array_distinct(F.concat(normalize_list(a), normalize_list(b)))


def without(a: Column, drop: Column) -> Column:
    gone = F.transform(normalize_list(drop), F.lower)
    return F.filter(normalize_list(a), lambda x: ~F.array_contains(gone, F.lower(x)))


def replace_status(tags: Column, status: Column) -> Column:
    """Tags sorted, with one status/ tag."""
    return F.array_sort(F.array_union(F.filter(normalize_list(tags), lambda t: ~t.startswith("status/")), F.array(F.concat(F.lit("status/"), status))))
