"""The link graph: keys by tier, edges, expansion by hops, and resolving a reference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import all_links, link_keys, note_slug, slugify


def keys(notes: DataFrame) -> DataFrame:
    """key, path, tier: who answers to a key; only the strongest tier of each key, ties all kept.

    notes: id, title, path.
    """
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    rows = notes.select("path", F.explode(link_keys(F.col("id"), F.col("title"), stem)).alias("k")).groupBy("path", "k.key").agg(F.min("k.tier").alias("tier"))
    best = rows.groupBy("key").agg(F.min("tier").alias("tier"))  # a row for each key meets: no window over a key's claimants
    return rows.join(best, ["key", "tier"])


def edges(notes: DataFrame) -> DataFrame:
    """path, pos, key: the links of each note in order. notes: path, links, body."""
    return notes.select("path", F.posexplode(all_links(F.col("links"), F.col("body"))).alias("pos", "key"))


def expand(seeds: DataFrame, edges_df: DataFrame, keys_df: DataFrame, *, hops: int = 1, limit: int = 12, slugs: DataFrame | None = None) -> DataFrame:
    """Notes reachable from the seeds' paths, nearest first: path, hop, order (parent's place, link's place). Seeds are left
    out; with ``slugs`` (path, slug) so are notes that share a slug with one. One join for each hop."""
    seen = seeds.select("path").distinct()
    if slugs is not None:
        seen = slugs.join(slugs.join(seen, "path", "left_semi").select("slug"), "slug", "left_semi").select("path").unionByName(seen).distinct()
    frontier = seeds.select("path", F.lit("").alias("way"))
    found = []
    for hop in range(1, hops + 1):
        step = frontier.join(edges_df, "path").join(keys_df.select("key", F.col("path").alias("to")), "key")
        step = step.select(F.col("to").alias("path"), F.concat("way", F.lpad(F.col("pos").cast("string"), 8, "0"), F.lit("/"), "to").alias("way"))
        step = step.groupBy("path").agg(F.min("way").alias("way")).join(seen, "path", "left_anti")
        found.append(step.withColumn("hop", F.lit(hop)))
        seen, frontier = seen.unionByName(step.select("path")), step
    return reduce(DataFrame.unionByName, found).orderBy("hop", "way", "path").limit(limit)


def resolve(references: DataFrame, notes: DataFrame) -> DataFrame:
    """Which notes a reference (ref) means: id before path before slug before old slug before file name. Columns ref, path,
    tier, candidates; more than one candidate means the reference is ambiguous. notes: id, title, path."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    tiers = [(0, F.col("id")), (1, F.col("path")), (2, note_slug(F.col("id"), F.col("title"))), (3, note_slug(F.col("id"), F.col("title"), 80)), (4, slugify(stem))]
    claims = notes.select("path", F.explode(F.array(*[F.struct(F.lit(t).alias("tier"), k.alias("ref")) for t, k in tiers])).alias("c")).select("path", "c.tier", "c.ref")
    hits = references.select("ref").distinct().join(claims, "ref").groupBy("ref", "path").agg(F.min("tier").alias("tier"))
    best = hits.groupBy("ref").agg(F.min("tier").alias("tier"))
    hits = hits.join(best, ["ref", "tier"])
    return hits.withColumn("candidates", F.count("*").over(Window.partitionBy("ref")))
