"""Scores, pruning, gates and curation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import curation, scoring
from ..session import table
from . import query

#: The documents as notes whose header says something different for each.
_NOTE = {
    "id": "CASE WHEN n_chars % 41 = 0 THEN concat('idea-', doc_id) ELSE concat('doc-', doc_id) END",
    "type": "CASE lang WHEN 'en' THEN 'report' WHEN 'de' THEN 'cve' WHEN 'fr' THEN 'writeup' ELSE 'other' END",
    "source": "CASE n_chars % 4 WHEN 0 THEN 'hackerone-public' WHEN 1 THEN 'nvd' WHEN 2 THEN 'cisa-kev' ELSE source END",
    "severity": "CASE n_chars % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' END",
    "year": "CASE WHEN n_chars % 6 = 0 THEN NULL ELSE 2020 + n_chars % 7 END",
    "kev": "n_chars % 13 = 0",
    "dupe": "n_chars % 11 = 0",
    "votes": "n_chars % 50",
    "paid": "coalesce(toxic, 0) = 1",
    "share": "(n_chars % 100) / 100.0",
    "state": "CASE n_chars % 8 WHEN 0 THEN 'Resolved' WHEN 1 THEN 'duplicate' ELSE '' END",
}


def notes(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("body"), *[F.expr(e).alias(c) for c, e in _NOTE.items()])
    extra = F.to_json(F.struct(F.col("paid").alias("has_bounty"), F.col("votes").alias("vote_count"), F.col("dupe").alias("is_dupe"), F.col("share").alias("epss_percentile"), "state"))
    return rows.select("doc_id", "id", "type", "source", "severity", "body", F.array(F.when(F.col("kev"), "kev").otherwise("x")).alias("tags"), F.make_date("year", F.lit(1), F.lit(1)).alias("created"), F.lit(None).cast("double").alias("bounty"), extra.alias("extra"))


_N = "n AS (SELECT d.doc_id, coalesce(text, '') AS body, {} FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)".format(", ".join(f"{e.replace('doc_id', 'd.doc_id')} AS {c}" for c, e in _NOTE.items()))
_STRUCTURE = r"""(CASE WHEN length(body) >= 4000 THEN 14 WHEN length(body) >= 1500 THEN 8 WHEN length(body) < 400 THEN -10 ELSE 0 END
 + least(12.0, 4.0 * floor(len(regexp_extract_all(body, '(?m)^```')) / 2)) + CASE WHEN regexp_matches(body, '(?im)steps?\s+to\s+reproduce|^[^\S\n]*\d+\.[^\S\n]+\S') THEN 8 ELSE 0 END
 + CASE WHEN len(regexp_extract_all(body, '(?m)^#{1,6}[^\S\n]+\S')) >= 3 THEN 5 ELSE 0 END
 + CASE WHEN regexp_matches(body, '(?im)HTTP/\d|^(?:GET|POST|PUT|PATCH|DELETE)\s+/|\bcurl\s+-|Authorization:\s|\bBurp\b') THEN 6 ELSE 0 END)""".replace("[^\\S\\n]", "[ \\t\\r\\f]")
_SCORED = rf"""WITH {_N}, a AS (SELECT *, lower(state) AS st, (dupe OR lower(state) = 'duplicate') AS is_dupe, starts_with(id, 'idea-') AS mine FROM n),
b AS (SELECT *, CASE type WHEN 'report' THEN 40 + CASE WHEN paid THEN 15 ELSE 0 END + CASE WHEN st IN ('resolved', 'triaged') THEN 8 ELSE 0 END
   + CASE WHEN votes > 0 THEN least(20.0::DOUBLE, 4.0 * log2(1 + votes)) ELSE 0 END - CASE WHEN is_dupe THEN 35 ELSE 0 END
   + CASE severity WHEN 'critical' THEN 12 WHEN 'high' THEN 8 WHEN 'medium' THEN 3 ELSE 0 END + {_STRUCTURE}
 WHEN 'cve' THEN 42 + CASE WHEN kev THEN 22 ELSE 0 END + 15.0::DOUBLE * share + CASE severity WHEN 'critical' THEN 8 WHEN 'high' THEN 5 ELSE 0 END + CASE WHEN length(body) >= 1200 THEN 5 ELSE 0 END
 WHEN 'writeup' THEN 70 + 0.5 * {_STRUCTURE} ELSE 40 + 0.5 * {_STRUCTURE} END AS raw FROM a),
q AS (SELECT *, greatest(0, least(100, round_even(CASE WHEN mine AND NOT is_dupe THEN greatest(raw, 72) ELSE raw END, 0)))::INTEGER AS quality FROM b)"""
_PLAN = rf"""{_SCORED}, v AS (SELECT doc_id, CASE
 WHEN type = 'writeup' THEN 'k:authored/curated' WHEN type NOT IN ('report', 'cve') THEN 'k:kept: ' || type || ' not prunable' WHEN mine THEN 'k:user-authored'
 WHEN source NOT IN ('nvd', 'hackerone-public', 'hackerone-hacktivity', 'cisa-kev') THEN 'k:kept: non-bulk source (' || source || ')'
 WHEN type = 'report' AND year IS NULL THEN 'k:kept: undated' WHEN type = 'report' AND year >= 2025 THEN 'k:report 2025+'
 WHEN type = 'report' AND paid AND quality >= 62 THEN 'k:old but bountied+substantial' WHEN type = 'report' THEN 'd:old thin/dupe report'
 WHEN kev THEN 'k:KEV / known-exploited' WHEN share >= 0.88 THEN 'k:EPSS pct >= 0.88' WHEN year IS NULL THEN 'k:kept: undated'
 WHEN year >= 2025 AND (severity IN ('high', 'critical') OR share >= 0.60) THEN 'k:CVE 2025+ w/ severity/EPSS' WHEN year >= 2025 THEN 'd:CVE 2025+ but low-signal' ELSE 'd:old low-signal CVE' END AS r FROM q)"""


@query(f"{_SCORED} SELECT doc_id, quality FROM q")
def quality_score(spark, sf_dir):
    return notes(spark, sf_dir).select("doc_id", scoring.score_note().alias("quality"))


@query(f"{_PLAN} SELECT doc_id, substr(r, 1, 1) = 'k' AS keep, substr(r, 3) AS reason FROM v")
def prune_plan(spark, sf_dir):
    return scoring.prune_plan(notes(spark, sf_dir)).select("doc_id", "keep", "reason")


@query(f"{_PLAN} SELECT substr(r, 1, 1) = 'k' AS keep, substr(r, 3) AS reason, count(*) AS notes FROM v GROUP BY 1, 2")
def prune_reasons(spark, sf_dir):
    return scoring.prune_reasons(scoring.prune_plan(notes(spark, sf_dir)))


@query("""WITH k AS (SELECT doc_id, coalesce(text, '') AS body, md5(concat_ws('/', source, n_chars)) AS key FROM documents)
SELECT 'https://site.example/' || key AS url_key, arg_max(doc_id, (length(body), -doc_id)) AS doc_id, count(*) AS copies FROM k GROUP BY key""")
def best_copy_per_key(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("doc_id").alias("id"), F.lit("t").alias("title"), F.concat(F.lit("https://Site.example/"), F.md5(F.concat_ws("/", "source", F.col("n_chars").cast("string")).cast("binary")), F.lit("/?source=rss")).alias("url"), F.col("text").alias("body"))
    return curation.best_copies(docs).select("url_key", F.col("id").alias("doc_id"), "copies")


@query("""SELECT count(*) AS total, count(*) FILTER (got = human) AS agree, count(*) FILTER (got = 'keep' AND human = 'drop') AS false_keeps, count(*) FILTER (got = 'drop' AND human = 'keep') AS false_drops, 0::BIGINT AS errors
FROM (SELECT CASE WHEN n_chars >= 500 THEN 'keep' ELSE 'drop' END AS got, CASE WHEN quality = 1 THEN 'keep' ELSE 'drop' END AS human FROM documents JOIN labels USING (doc_id))""")
def gate_confusion(spark, sf_dir):
    pairs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return curation.gate_accuracy(pairs.select(F.when(F.col("n_chars") >= 500, "keep").otherwise("drop").alias("got"), F.when(F.col("quality") == 1, "keep").otherwise("drop").alias("human")))


@query("""WITH v AS (SELECT doc_id AS line, n_chars % 300 AS key, CASE WHEN n_chars % 2 = 0 THEN 'drop' ELSE 'keep' END AS decision, n_chars % 17 = 0 AS bad FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY key, bad OR key >= 280 ORDER BY line) AS nth FROM v)
SELECT CASE WHEN bad OR key >= 280 THEN 'skip' WHEN decision = 'keep' THEN 'keep' WHEN key < 40 OR nth > 1 THEN 'duplicate' ELSE 'drop' END AS action, count(*) AS n FROM r GROUP BY 1""")
def verdict_apply(spark, sf_dir):
    v = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("line"), F.expr("concat('https://a.example/', n_chars % 300, '/')").alias("url"), F.expr("CASE WHEN n_chars % 2 = 0 THEN 'drop' ELSE 'keep' END").alias("decision"), F.lit("no").alias("already_known"),
        F.expr("CASE WHEN n_chars % 17 = 0 THEN '' WHEN n_chars % 2 = 0 THEN 'already-known' ELSE 'post-cutoff' END").alias("reason"), F.lit("j").alias("justification"), F.expr("concat('Title ', n_chars % 300)").alias("technique_title"), F.lit("w").alias("when_to_try"), F.lit("b").alias("body_md"),
    )
    keys = v.select("url", F.expr("cast(regexp_extract(url, '([0-9]+)/$', 1) AS int)").alias("k"))
    done = curation.apply_verdicts(v, keys.where("k < 280").select("url"), keys.where("k < 40").select("url").distinct(), spark.createDataFrame([], "id string, url string"))
    return done.groupBy("action").agg(F.count("*").alias("n"))
