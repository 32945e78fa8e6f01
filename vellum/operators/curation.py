"""Curation: the best copy of an article, what is still to be judged, applying verdicts, and how good a gate is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, prefilter_reason, slugify
from ..functions.urls import url_key

GATE_CHARS = 8000
#: Reasons a keep may give.
KEEP_REASONS = ("post-cutoff", "obscure-variant", "operational-detail")


def best_copies(notes: DataFrame, seen: DataFrame | None = None, *, prefilter: bool = False) -> DataFrame:
    """The longest body of each article (url_key), the first of equals. notes: seq, id, title, url, body. Rows without a url
    are left out (``no_url``); with ``prefilter``, plain drops go before lengths are compared."""
    rows = notes.withColumn("url_key", url_key(F.col("url"))).where("url_key <> ''")
    if prefilter:
        rows = rows.where(prefilter_reason(F.col("title")).isNull())
    if seen is not None:
        rows = rows.join(seen.select("url_key").distinct(), "url_key", "left_anti")
    best = F.max_by(F.struct("seq", "id", "title", "url", "body"), F.struct(F.length(blank(F.col("body"))), -F.col("seq")))
    return rows.groupBy("url_key").agg(best.alias("b"), F.count("*").alias("copies")).select("url_key", "b.*", "copies")


def no_url(notes: DataFrame) -> DataFrame:
    return notes.where(url_key(F.col("url")) == "")


def export_lines(candidates: DataFrame) -> DataFrame:
    """One JSON object a line, the text cut to what a gate sees."""
    return candidates.select(F.to_json(F.struct("title", "url", F.substring("body", 1, GATE_CHARS).alias("text"), F.col("id").alias("source_id"))).alias("value"))


def verdict_problem() -> Column:
    """Why a verdict row cannot be applied, or null."""
    required = ("url", "decision", "already_known", "reason", "justification")
    for_keep = ("technique_title", "when_to_try", "body_md")
    empty = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c))
    missing = F.concat_ws(", ", *[empty(c) for c in required], *[F.when(F.col("decision") == "keep", empty(c)) for c in for_keep])
    return (
        F.when(missing != "", F.concat(F.lit("missing "), missing))
        .when(~F.col("decision").isin("keep", "drop"), F.concat(F.lit("bad decision '"), F.col("decision"), F.lit("'")))
        .when((F.col("decision") == "keep") & ~F.col("reason").isin(*KEEP_REASONS), F.concat(F.lit("bad keep reason '"), F.col("reason"), F.lit("' (want one of "), F.lit(", ".join(KEEP_REASONS)), F.lit(")")))
    )


def technique_id(title: Column, key: Column | None = None) -> Column:
    name = lambda cut: F.when(slugify(title, cut) == "", "technique").otherwise(slugify(title, cut))
    if key is None:
        return F.concat(F.lit("tech-"), name(70))
    return F.concat(F.lit("tech-"), name(61), F.lit("-"), F.substring(F.sha1(key.cast("binary")), 1, 8))


def apply_verdicts(verdicts: DataFrame, candidates: DataFrame, rejects: DataFrame, techniques: DataFrame) -> DataFrame:
    """What becomes of each verdict row (line, ...): action keep, drop, duplicate or skip, with note_id or problem.

    Rows of one url apply in line order, so a drop repeated in the file is a duplicate and a keep repeated rewrites its
    note; between urls, the first line that asks for a free title gets the plain id and others one with their url's hash.
    candidates: url; rejects: url; techniques: id, url.
    """
    rows = verdicts.withColumn("key", url_key(F.col("url"))).withColumn("problem", verdict_problem())
    known = candidates.select(url_key(F.col("url")).alias("key")).where("key <> ''").distinct().withColumn("has_candidate", F.lit(True))
    logged = rejects.select(url_key(F.col("url")).alias("key")).distinct().withColumn("logged", F.lit(True))
    owners = techniques.select(F.col("id").alias("plain"), url_key(F.col("url")).alias("owner")).groupBy("plain").agg(F.collect_set("owner").alias("owners"))
    mine = techniques.select(url_key(F.col("url")).alias("key"), "id").where("key <> ''").groupBy("key").agg(F.array_sort(F.collect_set("id")).alias("mine"))
    rows = rows.join(known, "key", "left").join(logged, "key", "left").join(mine, "key", "left")
    rows = rows.withColumn("problem", F.coalesce("problem", F.when(F.col("has_candidate").isNull(), F.concat(F.lit("no candidate matches "), "url"))))
    ok = F.col("problem").isNull()
    earlier = Window.partitionBy("key", "decision", ok).orderBy("line")
    rows = rows.withColumn("nth", F.row_number().over(earlier))
    rows = rows.withColumn("plain", technique_id(F.col("technique_title"))).withColumn("hashed", technique_id(F.col("technique_title"), F.col("key")))
    rows = rows.join(owners, "plain", "left")
    keep = ok & (F.col("decision") == "keep")
    first_of_title = F.first(F.when(keep, F.col("key")), ignorenulls=True).over(Window.partitionBy("plain").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    first_id = F.first(F.when(keep, F.col("plain")), ignorenulls=True).over(Window.partitionBy("key").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("title_owner", first_of_title).withColumn("first_plain", first_id)
    has = lambda c: F.coalesce(F.array_contains("mine", F.col(c)), F.lit(False))
    free = F.col("owners").isNull() & (F.col("title_owner") == F.col("key"))
    note_id = (
        F.when(has("plain"), F.col("plain"))
        .when(has("hashed"), F.col("hashed"))
        .when(F.col("mine").isNotNull() | (F.col("first_plain") != F.col("plain")), F.lit(None).cast("string"))
        .when(free, F.col("plain"))
        .otherwise(F.col("hashed"))
    )
    rows = rows.withColumn("note_id", F.when(keep, note_id))
    action = (
        F.when(~ok, "skip")
        .when((F.col("decision") == "drop") & (F.col("logged").isNotNull() | (F.col("nth") > 1)), "duplicate")
        .when(F.col("decision") == "drop", "drop")
        .when(F.col("note_id").isNull(), "skip")
        .otherwise("keep")
    )
    problem = F.coalesce("problem", F.when(keep & F.col("note_id").isNull(), F.lit("already distilled under another title")))
    return rows.select("line", "url", "key", action.alias("action"), "note_id", problem.alias("problem"), (F.col("note_id") == F.col("hashed")).alias("collided"))


def shared_technique_ids(techniques: DataFrame) -> DataFrame:
    return techniques.groupBy("id").agg(F.count_distinct(url_key(F.col("url"))).alias("articles")).where("articles > 1")


def behavioural_keep(has_technique: Column, match: Column) -> Column:
    return has_technique & (match != "knew-it")


def gate_accuracy(pairs: DataFrame) -> DataFrame:
    """total, agree, false_keeps, false_drops, errors of (got, human); got is null where judging failed."""
    return pairs.agg(
        F.count("got").alias("total"),
        F.count_if(F.col("got") == F.col("human")).alias("agree"),
        F.count_if((F.col("got") == "keep") & (F.col("human") == "drop")).alias("false_keeps"),
        F.count_if((F.col("got") == "drop") & (F.col("human") == "keep")).alias("false_drops"),
        F.count_if(F.col("got").isNull()).alias("errors"),
    )


def gate_prompt() -> Column:
    """What a judge is shown of a candidate (title, source, created, url, body)."""
    day = F.coalesce(F.date_format("created", "yyyy-MM-dd"), F.lit("unknown"))
    return F.concat(F.lit("Title: "), "title", F.lit("\nSource: "), "source", F.lit("\nPublished: "), day, F.lit("\nURL: "), F.coalesce("url", F.lit("")), F.lit("\n\n--- content ---\n"), F.substring("body", 1, GATE_CHARS))


def technique_notes(kept: DataFrame, candidates: DataFrame) -> DataFrame:
    """Notes of the verdicts to keep (key, note_id and the verdict's columns), from the candidates (source, url, created, slug)."""
    c = candidates.select(url_key(F.col("url")).alias("key"), "source", F.col("url").alias("article"), "created", "slug").dropDuplicates(["key"])
    given = F.coalesce("tags", F.array().cast("array<string>"))
    tags = F.array_sort(F.array_distinct(F.concat(F.array(F.lit("technique"), F.col("reason")), F.filter(F.transform(given, lambda t: F.trim(t)), lambda t: t != ""))))
    body = F.concat(F.lit("**When to try:** "), "when_to_try", F.lit("\n\n"), F.trim("body_md"), F.coalesce(F.concat(F.lit("\n\n---\nSource: "), "article"), F.lit("")))
    extra = F.to_json(F.struct(F.col("reason").alias("keep_reason"), "when_to_try", "already_known"))
    return kept.join(c, "key").select(F.col("note_id").alias("id"), F.lit("technique").alias("type"), F.col("technique_title").alias("title"), "source", F.col("article").alias("url"), "created", tags.alias("tags"), F.filter(F.array("slug"), lambda s: s != "").alias("links"), extra.alias("extra"), body.alias("body"))
