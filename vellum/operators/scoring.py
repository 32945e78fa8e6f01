"""How much a note is worth, who wrote it, and what pruning does with it: single-expression decision lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import as_float, clamp_score, truthy
from ..functions.text import blank
from ..schema import NOTE_TYPES

#: The score a type starts from.
BASE = {"report": 40, "cve": 42, "technique": 78, "target": 78, "finding": 78, "writeup": 70, "tool": 78, "reference": 74}
#: Sources only a user writes (besides those of the note-taking verbs), id prefixes of the same kind.
USER_SOURCES = ("hackerone-mine", "manual", "vellum-remember", "vellum-capture-idea")  # the last two: the stamps of the verbs that write
USER_PREFIXES = ("h1mine-", "idea-", "local-")
USER_FLOOR = 72
#: Corpora that can be fetched again.
BULK_SOURCES = ("nvd", "hackerone-public", "hackerone-hacktivity", "cisa-kev")
KEEP_TYPES = ("technique", "target", "finding", "writeup", "reference", "tool")
#: What marks a body as worked through.
STEPS = r"(?im)steps?\s+to\s+reproduce|^[^\S\n]*\d+\.[^\S\n]+\S"
HEADING = r"(?m)^#{1,6}[^\S\n]+\S"
FENCE = r"(?m)^```"
HTTP = r"(?im)HTTP/\d|^(?:GET|POST|PUT|PATCH|DELETE)\s+/|\bcurl\s+-|Authorization:\s|\bBurp\b"


def extra(key: str, column: str = "extra") -> Column:
    """A field of the free-form JSON column, as text."""
    return F.get_json_object(F.col(column), f"$.{key}")


def state() -> Column:
    return F.lower(F.trim(blank(extra("state"))))


def _tags() -> Column:
    return F.transform(F.coalesce(F.col("tags"), F.array().cast("array<string>")), lambda t: F.lower(F.trim(t)))


def is_dupe() -> Column:
    return truthy(extra("is_dupe")) | F.array_contains(_tags(), "dupe") | (state() == "duplicate")


def has_bounty() -> Column:
    return truthy(extra("has_bounty")) | (as_float(extra("total_awarded_amount")) > 0) | (as_float(extra("bounty_amount")) > 0) | (F.coalesce(as_float(F.col("bounty")), F.lit(0.0)) > 0)


def is_user_authored() -> Column:
    """The user wrote, submitted or saved it: by source, id, tag or the stamp of the writing verbs."""
    source, note_id = F.lower(F.trim(blank(F.col("source")))), blank(F.col("id"))
    prefixes = "|".join(sorted({t[:4] for t in NOTE_TYPES}))
    by_id = note_id.rlike(rf"^(?:{'|'.join(USER_PREFIXES)})") | note_id.rlike(rf"^(?:{prefixes})-.+-\d{{17}}$")
    return source.isin(*USER_SOURCES) | by_id | F.array_contains(_tags(), "mine") | (blank(extra("authored_via")) != "")


def _points(severity: Column, table: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, points in table.items():
        out = F.when(severity == name, points).otherwise(out)
    return out


def structure_signals(body: Column) -> Column:
    n = F.length(body)
    size = F.when(n >= 4000, 14).when(n >= 1500, 8).when(n < 400, -10).otherwise(0)
    fences = F.least(F.lit(12.0), 4.0 * F.floor(F.regexp_count(body, F.lit(FENCE)) / 2))
    return size + fences + F.when(body.rlike(STEPS), 8).otherwise(0) + F.when(F.regexp_count(body, F.lit(HEADING)) >= 3, 5).otherwise(0) + F.when(body.rlike(HTTP), 6).otherwise(0)


def score_note() -> Column:
    """0 to 100, from the columns id, type, source, tags, severity, bounty, extra and body."""
    body, severity, votes = blank(F.col("body")), F.lower(blank(F.col("severity"))), as_float(extra("vote_count"))
    base = F.lit(40)
    for name, points in BASE.items():
        base = F.when(F.col("type") == name, points).otherwise(base)
    report = (
        F.when(has_bounty(), 15).otherwise(0)
        + F.when(state().isin("resolved", "triaged"), 8).otherwise(0)
        + F.when(votes > 0, F.least(F.lit(20.0), 4.0 * F.log2(1 + votes))).otherwise(0.0)
        - F.when(is_dupe(), 35).otherwise(0)
        + _points(severity, {"critical": 12, "high": 8, "medium": 3})
        + structure_signals(body)
    )
    kev = F.arrays_overlap(F.coalesce(F.col("tags"), F.array().cast("array<string>")), F.array(F.lit("kev"), F.lit("known-exploited")))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), as_float(extra("epss_percentile"))))
    cve = F.when(kev, 22).otherwise(0) + 15.0 * share + _points(severity, {"critical": 8, "high": 5}) + F.when(F.length(body) >= 1200, 5).otherwise(0)
    score = base + F.when(F.col("type") == "report", report).when(F.col("type") == "cve", cve).otherwise(structure_signals(body) * 0.5)
    floor = is_user_authored() & ~state().isin("duplicate", "not-applicable", "spam") & ~is_dupe()
    return clamp_score(F.when(floor, F.greatest(score, F.lit(USER_FLOOR))).otherwise(score).cast("double"))


def prune_verdict(since: int = 2025, bar: int = 62) -> Column:
    """struct(keep, reason); the first rule that fits decides, and what no rule knows is kept."""
    year, source, share = F.year("created"), blank(F.col("source")), as_float(extra("epss_percentile"))
    kev = F.arrays_overlap(F.coalesce(F.col("tags"), F.array().cast("array<string>")), F.array(F.lit("kev"), F.lit("known-exploited")))
    verdict = lambda keep, reason: F.struct(F.lit(keep).alias("keep"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    return (
        F.when(F.col("type").isin(*KEEP_TYPES), verdict(True, "authored/curated"))
        .when(~F.coalesce(F.col("type").isin("report", "cve"), F.lit(False)), verdict(True, F.concat(F.lit("kept: "), blank(F.col("type")), F.lit(" not prunable"))))
        .when(is_user_authored(), verdict(True, "user-authored"))
        .when(~source.isin(*BULK_SOURCES), verdict(True, F.concat(F.lit("kept: non-bulk source ("), F.when(source == "", "none").otherwise(source), F.lit(")"))))
        .when((F.col("type") == "report") & year.isNull(), verdict(True, "kept: undated"))
        .when((F.col("type") == "report") & (year >= since), verdict(True, f"report {since}+"))
        .when((F.col("type") == "report") & has_bounty() & (score_note() >= bar), verdict(True, "old but bountied+substantial"))
        .when(F.col("type") == "report", verdict(False, "old thin/dupe report"))
        .when(kev, verdict(True, "KEV / known-exploited"))
        .when(share >= 0.88, verdict(True, "EPSS pct >= 0.88"))
        .when(year.isNull(), verdict(True, "kept: undated"))
        .when((year >= since) & (F.lower(blank(F.col("severity"))).isin("high", "critical") | (share >= 0.60)), verdict(True, f"CVE {since}+ w/ severity/EPSS"))
        .when(year >= since, verdict(False, f"CVE {since}+ but low-signal"))
        .otherwise(verdict(False, "old low-signal CVE"))
    )


def refuse_reason() -> Column:
    """Why a note must never be moved, whatever a plan says; null if it may be."""
    source = blank(F.col("source"))
    return (
        F.when(~F.coalesce(F.col("type").isin("report", "cve"), F.lit(False)), F.concat(F.lit("type "), blank(F.col("type")), F.lit(" is never pruned")))
        .when(is_user_authored(), "user-authored")
        .when(~source.isin(*BULK_SOURCES), F.concat(F.lit("source "), source, F.lit(" is not a bulk corpus")))
        .when(F.col("created").isNull(), "undated")
    )


def prune_plan(notes: DataFrame, since: int = 2025, bar: int = 62) -> DataFrame:
    planned = notes.withColumn("verdict", prune_verdict(since, bar)).withColumn("refused", refuse_reason())
    return planned.select("*", "verdict.keep", "verdict.reason").drop("verdict")


def apply_prune(notes: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what stays, what goes to quarantine): a drop is carried out only where no hard rule refuses it."""
    drops = plan.where("NOT keep AND refused IS NULL").select("path")
    return notes.join(drops, "path", "left_anti"), notes.join(drops, "path", "left_semi")


def prune_reasons(plan: DataFrame) -> DataFrame:
    return plan.groupBy("keep", "reason").agg(F.count("*").alias("notes"))
