"""Who a record is: tombstones, known urls, ids, the same document, merging and upserting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import union
from ..functions.text import blank, slugify
from ..functions.urls import canonical_url, id_family, url_note_id


def _key(c: Column) -> Column:
    return F.nullif(F.lower(F.trim(blank(c))), F.lit(""))


def not_tombstoned(incoming: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Rows (id, url, source) that no tombstone (id, url, source) blocks.

    A tombstone blocks its id or canonical url, for its source; one without a source, or a row without one, matches any.
    Two equal joins (id, then url) against one row for each key instead of one join on a disjunction.
    """
    src = _key(F.col("source"))
    out = incoming.withColumn("_src", src)
    for key in (F.trim(blank(F.col("id"))), canonical_url(F.col("url"))):
        blocks = tombstones.select(F.nullif(key, F.lit("")).alias("_key"), src.alias("_by")).where("_key IS NOT NULL")
        blocks = blocks.groupBy("_key").agg(F.collect_set("_by").alias("_bys"), F.max(F.col("_by").isNull()).alias("_any"))
        blocked = F.coalesce(F.col("_any") | F.col("_src").isNull() | F.array_contains("_bys", F.col("_src")), F.lit(False))
        joined = out.withColumn("_key", F.nullif(key, F.lit(""))).join(blocks, "_key", "left")
        out = joined.where(F.col("_bys").isNull() | ~blocked).drop("_key", "_bys", "_any")
    return out.drop("_src")


def add_tombstones(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """What the ledger lacks of ``new``, each (id, canonical url, source) once."""
    keyed = lambda df: df.withColumn("_i", F.trim(blank(F.col("id")))).withColumn("_u", canonical_url(F.col("url"))).withColumn("_s", F.coalesce(_key(F.col("source")), F.lit("")))
    fresh = keyed(new).where("_i <> '' OR _u <> ''").dropDuplicates(["_i", "_u", "_s"])
    return fresh.join(keyed(ledger).select("_i", "_u", "_s").distinct(), ["_i", "_u", "_s"], "left_anti").select(new.columns)


def remove_tombstones(ledger: DataFrame, gone: DataFrame) -> DataFrame:
    ids = gone.select(F.trim(blank(F.col("id"))).alias("_i")).where("_i <> ''").distinct()
    return ledger.withColumn("_i", F.trim(blank(F.col("id")))).join(ids, "_i", "left_anti").drop("_i")


def unknown_urls(incoming: DataFrame, stored: DataFrame, *, family: bool = True) -> DataFrame:
    """Incoming rows (id, url) whose article is not stored, in their own id family or in any."""
    keys = lambda df: df.withColumn("_u", canonical_url(F.col("url"))).withColumn("_f", id_family(F.col("id")) if family else F.lit(""))
    known = keys(stored).where("_u <> ''").select("_u", "_f").distinct()
    return keys(incoming).join(known, ["_u", "_f"], "left_anti").select(incoming.columns)


def resolve_ids(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """The id each incoming article (seq, id, url) gets, as ``note_id``.

    Its url is stored: that note's id. Its id belongs to another url, stored or of an earlier arrival: the id with the url's
    hash. Else its own. Arrival order is the explicit column seq.
    """
    known = stored.select(canonical_url(F.col("url")).alias("_u"), F.col("id").alias("_known")).where("_u <> ''").groupBy("_u").agg(F.min("_known").alias("_known"))
    owned = stored.select("id").distinct().withColumn("_owned", F.lit(True))
    rows = incoming.withColumn("_u", canonical_url(F.col("url"))).join(known, "_u", "left").join(owned, "id", "left")
    first = F.first("_u").over(Window.partitionBy("id").orderBy("seq"))
    taken = F.coalesce("_owned", F.lit(False)) | (first != F.col("_u"))
    own = F.when(taken & (F.col("_u") != ""), url_note_id(F.col("id"), F.col("url"))).otherwise(F.col("id"))
    return rows.withColumn("note_id", F.coalesce("_known", own)).drop("_u", "_known", "_owned")


def is_title_derived(note_id: Column, title: Column) -> Column:
    return F.concat(id_family(note_id), F.lit("-"), slugify(title, 90)) == note_id


def differs_as(a: str, b: str) -> Column:
    """What makes rows a.* and b.* different documents: "id", "source" or "url"; null for the same document."""
    title = lambda t: F.lower(F.trim(F.regexp_replace(blank(F.col(f"{t}.title")), r"\s+", " ")))
    ua, ub = canonical_url(F.col(f"{a}.url")), canonical_url(F.col(f"{b}.url"))
    return (
        F.when(~F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")), "id")
        .when(~_key(F.col(f"{a}.source")).eqNullSafe(_key(F.col(f"{b}.source"))), "source")
        .when((ua == "") | (ub == "") | (ua == ub) | (title(a) == title(b)), F.lit(None).cast("string"))
        .otherwise("url")
    )


def merge_cve(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Feed records (KEV, NVD) merged into the stored note of their id; rows with ``conflict`` are to be left alone.

    Lists are united, extra is updated without nulls, scalars take what comes in, the NVD date wins, else the earliest;
    title and source stay. Columns: id, title, source, url, created, tags, cwe, severity, program, extra (map), body.
    """
    s, i = stored.alias("s"), incoming.alias("i")
    both = s.join(i, F.col("s.id") == F.col("i.id"), "full_outer")
    has_s, has_i = F.col("s.id").isNotNull(), F.col("i.id").isNotNull()
    feeds = ("cisa-kev", "nvd")
    take = lambda c: F.coalesce(F.nullif(F.col(f"i.{c}"), F.lit("")), F.col(f"s.{c}")).alias(c)
    e = F.create_map().cast("map<string,string>")
    filled = F.map_filter(F.coalesce("i.extra", e), lambda k, v: v.isNotNull())
    kept = F.map_filter(F.coalesce("s.extra", e), lambda k, v: ~F.coalesce(F.map_contains_key(filled, k), F.lit(False)))
    listed = F.when(F.map_contains_key(F.coalesce("s.extra", e), "sources"), F.split(F.element_at("s.extra", "sources"), ",")).otherwise(F.array("s.source"))
    sources = F.when(has_s & has_i, union(listed, F.array("i.source"))).otherwise(F.array(F.coalesce("s.source", "i.source")))
    extra = F.map_concat(F.map_filter(kept, lambda k, v: k != "sources"), F.map_filter(filled, lambda k, v: k != "sources"), F.when(F.size(sources) > 1, F.create_map(F.lit("sources"), F.array_join(sources, ","))).otherwise(e))
    created = (
        F.when((F.col("i.source") == "nvd") & F.col("i.created").isNotNull(), F.col("i.created"))
        .when(F.array_contains(listed, "nvd") & F.col("s.created").isNotNull(), F.col("s.created"))
        .otherwise(F.least("s.created", "i.created"))
    )
    conflict = F.when(has_s & has_i & ~((F.coalesce("s.type", F.lit("")) == "cve") & F.col("s.source").isin(*feeds)), "source")
    status = F.when(~has_s, "new").when(~has_i, "kept").when(conflict.isNotNull(), "conflict").otherwise("merged")
    return both.select(
        F.coalesce("s.id", "i.id").alias("id"),
        F.coalesce("s.type", "i.type").alias("type"),
        F.coalesce(F.nullif("s.title", F.lit("")), "i.title").alias("title"),
        F.coalesce("s.source", "i.source").alias("source"),
        take("url"),
        take("severity"),
        take("program"),
        created.alias("created"),
        union(F.col("s.tags"), F.col("i.tags")).alias("tags"),
        union(F.col("s.cwe"), F.col("i.cwe")).alias("cwe"),
        extra.alias("extra"),
        F.col("s.body").alias("stored_body"),
        F.col("i.body").alias("incoming_body"),
        F.col("i.source").alias("incoming_source"),
        status.alias("status"),
    )


def merge_own_reports(stored: DataFrame, incoming: DataFrame, no_body: str = "(no body)") -> DataFrame:
    """A user's own reports refreshed: state tags follow the state, lists are united, what the user wrote stays."""
    j = stored.alias("s").join(incoming.alias("i"), "id", "left")
    state_tags = lambda t: F.when(F.col(f"{t}.state") == "duplicate", F.array(F.col(f"{t}.state"), F.lit("dupe"))).otherwise(F.array(F.coalesce(F.nullif(F.col(f"{t}.state"), F.lit("")), F.lit("unknown"))))
    same = F.col("i.source").isNotNull() & (F.coalesce("s.source", F.lit("")) == F.coalesce("i.source", F.lit("")))
    stale = F.array_except(state_tags("s"), state_tags("i"))
    merged = lambda new, old: F.when(same, new).otherwise(old)
    written = (F.trim(blank(F.col("s.body"))) != "") & (F.trim(blank(F.col("s.body"))) != no_body)
    return j.select(
        "id",
        merged(F.coalesce("i.state", "s.state"), F.col("s.state")).alias("state"),
        merged(union(F.array_except(F.col("s.tags"), stale), F.col("i.tags")), F.col("s.tags")).alias("tags"),
        merged(union(F.col("s.cwe"), F.col("i.cwe")), F.col("s.cwe")).alias("cwe"),
        merged(F.when(written, F.col("s.body")).otherwise(F.col("i.body")), F.col("s.body")).alias("body"),
        F.when(F.col("i.source").isNull(), "kept").when(same, "merged").otherwise("conflict").alias("status"),
    )


def apply_epss(notes: DataFrame, scores: DataFrame) -> DataFrame:
    """Notes (id, epss, epss_percentile, tags) that a score (cve, epss, percentile) changes, changed. Only those are to be written."""
    j = notes.join(scores.withColumnRenamed("epss", "new_epss"), F.col("id") == F.col("cve"))
    want, has = F.col("new_epss") >= 0.5, F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), "high-epss")
    e, p = F.bround("new_epss", 5), F.bround("percentile", 5)
    changed = ~(F.col("epss").eqNullSafe(e) & F.col("epss_percentile").eqNullSafe(p) & (want == has))
    tags = F.when(want & ~has, F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit("high-epss")))).when(has & ~want, F.array_remove("tags", "high-epss")).otherwise(F.col("tags"))
    return j.where(changed).select("id", e.alias("epss"), p.alias("epss_percentile"), tags.alias("tags"))


def carrier(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """The file that holds each wanted document: of all files of its id, first those with the same document, then those at
    the title's path, then the newest, then by path. files: id, path, title, url, source, mtime; wanted: the same and title_path."""
    j = wanted.alias("w").join(files.alias("f"), F.col("w.id") == F.col("f.id"))
    rank = F.row_number().over(Window.partitionBy("w.id").orderBy(differs_as("f", "w").isNotNull(), F.col("f.path") != F.col("w.title_path"), F.col("f.mtime").desc(), F.col("f.path")))
    return j.withColumn("rank", rank).where("rank = 1").select(F.col("w.id").alias("id"), F.col("f.path").alias("path"), differs_as("f", "w").alias("conflict"))


def upsert(stored: DataFrame, incoming: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """Every row after the upsert, with status new, updated, unchanged or kept (not in the input)."""
    s, i = stored.alias("s"), incoming.alias("i")
    j = s.join(i, F.col(f"s.{key}") == F.col(f"i.{key}"), "full_outer")
    same = F.lit(True)
    for c in compare:
        same = same & F.col(f"s.{c}").eqNullSafe(F.col(f"i.{c}"))
    status = F.when(F.col(f"i.{key}").isNull(), "kept").when(F.col(f"s.{key}").isNull(), "new").when(same, "unchanged").otherwise("updated")
    pick = [F.when(F.col(f"i.{key}").isNotNull(), F.col(f"i.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in stored.columns]
    return j.select(*pick, status.alias("status"))
