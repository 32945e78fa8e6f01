"""Vector search, BM25, fusion and search filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import cwe_filter_token, has_token
from ..operators import chunking, retrieval
from ..plans import search
from ..plans.keyword_index import KeywordIndex
from ..session import scratch, table
from . import SQL, query

NOW = 1706745600.0  # 2024-02-01

_DIST = "list_sum(list_transform(list_zip(e.embedding, q.qv), lambda z: pow(z[1]::DOUBLE - z[2]::DOUBLE, 2)))"
_EVERY = "vec_id % 50 = 0"  # the questions asked of the vectors: every row whose id is divisible by 50
_LISTS = f"""q AS (SELECT vec_id AS qi, embedding AS qv FROM embeddings WHERE {_EVERY}),
d AS (SELECT q.qi, e.vec_id AS chunk, e.label AS note, {_DIST} AS dist FROM embeddings e CROSS JOIN q),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qi ORDER BY dist, chunk) AS rk FROM d) WHERE rk <= 40)"""
_NOTES = f"""WITH {_LISTS},
c AS (SELECT chunk, note, sum(1.0::DOUBLE / (60 + rk)) AS sc, min(qi * 1000000 + rk) AS first_seen FROM p GROUP BY chunk, note),
n AS (SELECT *, row_number() OVER (PARTITION BY note ORDER BY sc DESC, first_seen) AS crk FROM c),
s AS (SELECT note, count(*) AS matched_chunks, max(CASE WHEN crk = 1 THEN chunk END) AS best_chunk,
  sum(CASE WHEN crk = 1 THEN sc WHEN crk <= 4 THEN 0.25::DOUBLE * sc ELSE 0 END) AS score FROM n GROUP BY note)"""
_TOK = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda t: t <> '')"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("note"))


def _lists(spark: SparkSession, sf_dir: str, pool: int = 40) -> DataFrame:
    v = _vectors(spark, sf_dir)
    asked = v.where("id % 50 = 0").select(F.col("id").alias("qi"), F.col("vector").alias("qv"))
    return retrieval.knn(v, asked, pool).select("qi", F.col("qi").alias("list_no"), "rank", F.col("id").alias("chunk"), "note")


@query(f"""WITH q AS (SELECT vec_id AS qi, embedding AS qv FROM embeddings WHERE {_EVERY}),
d AS (SELECT q.qi, e.vec_id, {_DIST} AS dist FROM embeddings e CROSS JOIN q)
SELECT * FROM (SELECT qi, vec_id, row_number() OVER (PARTITION BY qi ORDER BY dist, vec_id) AS rank FROM d) WHERE rank <= 10""")
def knn_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    asked = v.where("id % 50 = 0").select(F.col("id").alias("qi"), F.col("vector").alias("qv"))
    return retrieval.knn(v, asked, 10).select("qi", F.col("id").alias("vec_id"), "rank")


@query(f"{_NOTES} SELECT note, matched_chunks, best_chunk, round(score, 6) AS score FROM s")
def rrf_two_queries(spark, sf_dir):
    fused = retrieval.collapse(retrieval.fuse(_lists(spark, sf_dir)))
    return fused.select("note", "matched_chunks", "best_chunk", F.round("score", 6).alias("score"))


@query(f"""WITH {_LISTS},
c AS (SELECT qi, chunk, note, 1.0::DOUBLE / (60 + rk) AS sc, rk FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY qi, note ORDER BY sc DESC, rk) AS crk FROM c),
s AS (SELECT qi, note, sum(CASE WHEN crk = 1 THEN sc WHEN crk <= 4 THEN 0.25::DOUBLE * sc ELSE 0 END) AS score, min(rk) AS first_seen FROM n GROUP BY qi, note),
t AS (SELECT *, row_number() OVER (PARTITION BY qi ORDER BY score DESC, first_seen) AS place FROM s)
SELECT note, string_agg(qi::VARCHAR, ',' ORDER BY qi) AS matched_queries FROM t WHERE place <= 5 GROUP BY note""")
def rrf_attribution(spark, sf_dir):
    got = retrieval.attribute(_lists(spark, sf_dir), 5)
    return got.select("note", F.array_join(F.col("matched_queries").cast("array<string>"), ",").alias("matched_queries"))


@query(f"""WITH q AS (SELECT vec_id AS qi, embedding AS qv FROM embeddings WHERE {_EVERY}),
d AS (SELECT q.qi, e.vec_id AS chunk, e.label AS note, {_DIST} AS dist FROM embeddings e CROSS JOIN q),
r AS (SELECT *, row_number() OVER (PARTITION BY qi ORDER BY dist, chunk) AS rk FROM d),
w AS (SELECT CASE WHEN (SELECT count(DISTINCT note) FROM r WHERE rk <= 40) < 50 AND (SELECT max(n) FROM (SELECT count(*) AS n FROM r WHERE rk <= 40 GROUP BY qi)) >= 40 THEN 120 ELSE 40 END AS pool)
SELECT note, count(DISTINCT chunk) AS matched_chunks, any_value(pool)::INTEGER AS pool FROM r, w WHERE rk <= pool GROUP BY note""")
def pool_widening(spark, sf_dir):
    lists = _lists(spark, sf_dir)
    found, fullest = lists.select("note").distinct().count(), lists.groupBy("qi").count().agg(F.max("count")).first()[0]
    pool = retrieval.widened_pool(50, 40, found, fullest)
    lists = _lists(spark, sf_dir, pool) if pool != 40 else lists
    return lists.groupBy("note").agg(F.count_distinct("chunk").alias("matched_chunks")).withColumn("pool", F.lit(pool))


@query(f"""{_NOTES}, m AS (SELECT *, (note * 7) % 101 AS quality, CASE WHEN note % 5 = 0 THEN 0.0 ELSE 1577836800.0 + note * 8640000.0 END AS ts FROM s)
SELECT note, round(score * (1 + (0.8 * (quality / 100.0::DOUBLE) - 0.4)) * CASE WHEN ts = 0 THEN 1.0
  ELSE 1 + greatest(-0.25::DOUBLE, least(0.15::DOUBLE, 0.15 - 0.06 * greatest(0.0::DOUBLE, ({NOW}::DOUBLE - ts) / 31557600.0::DOUBLE))) END, 6) AS score FROM m""")
def search_reweighted(spark, sf_dir):
    notes = retrieval.collapse(retrieval.fuse(_lists(spark, sf_dir)))
    notes = notes.withColumn("quality", F.expr("(note * 7) % 101")).withColumn("created_ts", F.expr("CASE WHEN note % 5 = 0 THEN 0.0D ELSE 1577836800.0D + note * 8640000.0D END"))
    return retrieval.reweigh(notes, NOW).select("note", F.round("score", 6).alias("score"))


def _questions(spark, sf_dir) -> DataFrame:
    """Every benchmark item whose id is divisible by 50, with its whole text."""
    return table(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("qi"), F.col("text").alias("query"))


def _bm25_sql(docs: str) -> str:
    return f"""WITH q AS (SELECT item_id AS qi, unnest(list_distinct({_TOK})) AS term FROM benchmark WHERE item_id % 50 = 0),
d AS (SELECT doc_id, {_TOK} AS w FROM {docs}),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
tf AS (SELECT doc_id, term, dl, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT q.qi, tf.doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM tf JOIN q USING (term) JOIN df USING (term), st GROUP BY q.qi, tf.doc_id)
SELECT * FROM (SELECT qi, doc_id, row_number() OVER (PARTITION BY qi ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10"""


@query(_bm25_sql("documents"))
def bm25_topk(spark, sf_dir):
    top = retrieval.bm25(table(spark, sf_dir, "documents"), _questions(spark, sf_dir), 10, key="doc_id", text="text")
    return top.select("qi", F.col("id").alias("doc_id"), "rank")


@query(_bm25_sql("documents"))
def bm25_indexed(spark, sf_dir):
    """The index is written in two segments, and answered from the blocks that can matter."""
    docs, index = table(spark, sf_dir, "documents"), KeywordIndex(spark, scratch(spark), "long")
    index.add(docs.where("doc_id % 2 = 0"), key="doc_id", text="text")
    index.add(docs.where("doc_id % 2 <> 0"), key="doc_id", text="text")
    return index.search(_questions(spark, sf_dir), 10).select("qi", F.col("id").alias("doc_id"), "rank")


@query(f"WITH t AS (SELECT DISTINCT doc_id, unnest({_TOK}) AS term FROM documents) SELECT term, count(*) AS df FROM t GROUP BY term")
def bm25_stats(spark, sf_dir):
    return retrieval.postings(table(spark, sf_dir, "documents"), key="doc_id", text="text").groupBy("term").agg(F.count("*").alias("df"))


@query(_bm25_sql("(SELECT * FROM documents WHERE n_chars % 101 >= 60)"))
def min_quality_prefilter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("quality", F.expr("n_chars % 101")).where(search.where({}, 60))
    return retrieval.bm25(docs, _questions(spark, sf_dir), 10, key="doc_id", text="text").select("qi", F.col("id").alias("doc_id"), "rank")


@query("SELECT doc_id FROM documents WHERE list_contains(string_split('CWE-' || (doc_id % 90) || ' CWE-' || (n_chars % 700), ' '), 'CWE-7')")
def filter_exact_token(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("cwe_str", F.expr("concat('CWE-', doc_id % 90, ' CWE-', n_chars % 700)"))
    return docs.where(has_token(F.col("cwe_str"), cwe_filter_token("7"))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND lower(source) = 'src7' AND n_chars % 101 >= 20")
def filter_conjunctive(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumns({"type": F.col("lang"), "program": F.col("source"), "quality": F.expr("n_chars % 101")})
    return docs.where(search.where({"type": "EN", "program": "Src7"}, 20)).select("doc_id")


def notes_of(spark, sf_dir) -> DataFrame:
    """The documents as notes."""
    return table(spark, sf_dir, "documents").select(
        F.format_string("doc-%d", "doc_id").alias("id"), F.format_string("finding/doc %d.md", "doc_id").alias("path"), F.lit("finding").alias("type"), F.substring("text", 1, 40).alias("title"), F.col("source"), F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("date").alias("created"), F.lit(None).cast("timestamp").alias("ingested"), F.array("lang").alias("tags"), F.array().cast("array<string>").alias("cwe"), F.lit(None).cast("string").alias("severity"), F.col("source").alias("program"),
        F.lit(None).cast("double").alias("bounty"), F.lit("{}").alias("extra"), F.lit(0.0).alias("mtime"), F.coalesce("text", F.lit("")).alias("body"),
    )


@query()
def chunk_documents(spark, sf_dir):
    return chunking.chunks(notes_of(spark, sf_dir), window=256)


@query("SELECT doc_id, 0 AS lost, 0 AS invented, 0 AS too_long, true AS numbered FROM documents WHERE regexp_matches(text, '[^ \\t-\\r]')")
def chunk_invariants(spark, sf_dir):
    """Of the chunks of each document: words that no chunk has, words that the text does not have, chunks beyond the window, and
    whether they are numbered from 0 without a gap."""
    words = lambda c: F.array_remove(F.split(F.translate(c, "#", " "), "[ \\t-\\r]+"), "")
    notes = table(spark, sf_dir, "documents").select("doc_id", F.format_string("doc-%d", "doc_id").alias("id"), F.lit("").alias("path"), F.substring("text", 1, 40).alias("title"), F.coalesce("text", F.lit("")).alias("body"))
    cut = chunking.chunk_lists(notes, window=256, carry=["doc_id", "body"]).where(F.size("chunks") > 0)  # the chunks of one document beside its text: nothing is shuffled
    told = cut.select("doc_id", "title", "chunks", F.array_distinct(words(F.col("body"))).alias("words"), F.array_distinct(F.flatten(F.transform("chunks", lambda c: words(c["text"])))).alias("seen"), F.flatten(F.transform("chunks", lambda c: words(c["heading"]))).alias("heads"))
    context = lambda c: F.concat(F.col("title"), F.lit("\n"), F.when(c["heading"] != "", F.concat(c["heading"], F.lit("\n"))).otherwise(""))
    long = F.filter("chunks", lambda c: chunking.token_estimate(c["text"]) + chunking.token_estimate(context(c)) + 2 > 256)
    at = F.col("chunks.chunk_index")
    numbered = (F.array_max(at) + 1 == F.size(at)) & (F.array_min(at) == 0) & (F.size(F.array_distinct(at)) == F.size(at))
    return told.select("doc_id", F.size(F.array_except("words", F.concat("seen", "heads"))).alias("lost"), F.size(F.array_except("seen", "words")).alias("invented"), F.size(long).alias("too_long"), numbered.alias("numbered"))


_W = "CASE WHEN len({0}) = 1 THEN 100 WHEN len({0}) >= 15 THEN 50 * len({0}) ELSE 114 + 8 * len({0}) END"


@query(f"""
WITH runs AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[0-9]+|[^ \\t-\\rA-Za-z0-9]')) AS r FROM documents),
p AS (SELECT doc_id, r, regexp_extract_all(regexp_replace(r, '([A-Z][a-z])', ' \\1', 'g'), '[A-Z]?[a-z]+|[A-Z]+') AS parts FROM runs),
q AS (SELECT *, regexp_full_match(coalesce(parts[1], ''), '[A-Z]{{1,5}}') AS named FROM p),
c AS (SELECT *, CASE WHEN named THEN parts[2:] ELSE parts END AS words FROM q),
d AS (SELECT doc_id, CASE WHEN regexp_matches(r, '^[0-9]') THEN 40 + 60 * len(r) WHEN NOT regexp_matches(r, '^[A-Za-z]') THEN 100
    WHEN regexp_full_match(r, '[A-Z][A-Z]+') THEN greatest(150, 50 + 35 * len(r))
    WHEN regexp_full_match(r, '[A-Za-z][a-z]*') THEN CASE WHEN len(r) >= 8 AND 4 * len(regexp_extract_all(r, '[aeiouyAEIOUY]')) < len(r) THEN 70 * len(r) ELSE {_W.format("r")} END
    WHEN len(list_filter(words, lambda x: len(x) < 3 OR regexp_full_match(x, '[A-Z]+') OR NOT regexp_matches(x, '[aeiouyAEIOUY]'))) = 0
    THEN coalesce(list_sum(list_transform(words, lambda x: {_W.format("x")})), 0) + CASE WHEN NOT named THEN 0 WHEN len(parts[1]) = 1 THEN 100 ELSE greatest(150, 50 + 35 * len(parts[1])) END
    ELSE 50 + 60 * len(r) END AS cost FROM c),
t AS (SELECT doc_id, sum(cost) AS total FROM d GROUP BY doc_id)
SELECT doc_id, CAST(ceil(coalesce(total, 0) * 12 / 1000) AS INTEGER) AS tokens FROM documents LEFT JOIN t USING (doc_id)
""")
def estimate_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", chunking.token_estimate(F.col("text")).alias("tokens"))


@query()
def hybrid_search(spark, sf_dir):
    """All questions in one plan, over a stored index of chunks. Questions without text find nothing."""
    path = scratch(spark)
    search.index_rows(notes_of(spark, sf_dir)).write.option("compression", "zstd").parquet(path)
    chunks, index = spark.read.parquet(path), KeywordIndex(spark, scratch(spark))
    index.add(chunks)
    found = search.search_many(chunks, _questions(spark, sf_dir), now=NOW, k=8, index=index)
    return found.select("qi", "note_id", "title", "score", "matched_chunks", "matched_queries", "quality")


#: The default embedder in SQL: words by crc32 (no function of DuckDB: stepped through the bytes) in 64 dimensions, unit length.
_HASHED = """texts AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark WHERE item_id % 50 = 0 AND trim(text) <> ''),
words AS (SELECT side, id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS word FROM texts),
counted AS (SELECT side, id, word, count(*) AS n FROM words GROUP BY ALL),
bits AS (SELECT range AS byte, range AS c, 0 AS k FROM range(256) UNION ALL SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
lookup AS MATERIALIZED (SELECT byte, c FROM bits WHERE k = 8),
steps AS (SELECT word, hex(encode(word)) AS bytes, 0 AS pos, 4294967295::BIGINT AS crc FROM (SELECT DISTINCT word FROM counted)
  UNION ALL SELECT s.word, s.bytes, s.pos + 1, xor(s.crc // 256, l.c) FROM steps s JOIN lookup l ON l.byte = xor(s.crc % 256, ('0x' || substr(s.bytes, 2 * s.pos + 1, 2))::BIGINT) WHERE 2 * s.pos < length(s.bytes)),
hashed AS MATERIALIZED (SELECT word, xor(crc, 4294967295) % 64 AS dim FROM steps WHERE 2 * pos = length(bytes)),
cells AS (SELECT side, id, dim, sum(n) AS n FROM counted JOIN hashed USING (word) GROUP BY ALL),
norms AS (SELECT side, id, sqrt(sum(n * n)::DOUBLE)::FLOAT AS norm FROM cells GROUP BY ALL),
vectors AS MATERIALIZED (SELECT t.side, t.id, list((coalesce(c.n, 0)::FLOAT / coalesce(m.norm, 1::FLOAT))::FLOAT ORDER BY d.range) AS v
  FROM texts t CROSS JOIN range(64) d LEFT JOIN cells c ON c.side = t.side AND c.id = t.id AND c.dim = d.range LEFT JOIN norms m ON m.side = t.side AND m.id = t.id GROUP BY t.side, t.id)"""


@query(f"""WITH RECURSIVE {_HASHED},
near AS (SELECT q.id AS qi, d.id::VARCHAR AS chunk, list_sum(list_transform(list_zip(d.v, q.v), lambda z: pow(z[1]::DOUBLE - z[2]::DOUBLE, 2))) AS dist FROM vectors d, vectors q WHERE d.side = 0 AND q.side = 1),
asked AS (SELECT id AS qi, unnest(list_distinct({_TOK})) AS term FROM texts WHERE side = 1),
d AS (SELECT id, {_TOK} AS w FROM texts WHERE side = 0),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
tf AS (SELECT id, term, dl, count(*) AS tf FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
said AS (SELECT qi, id::VARCHAR AS chunk, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM tf JOIN asked USING (term) JOIN df USING (term), st GROUP BY qi, id),
lists AS (SELECT l.*, source AS note FROM (
  SELECT qi, 0 AS list_no, chunk, row_number() OVER (PARTITION BY qi ORDER BY dist, chunk) AS rk FROM near
  UNION ALL SELECT qi, 1, chunk, row_number() OVER (PARTITION BY qi ORDER BY score DESC, chunk) FROM said) l JOIN documents ON doc_id::VARCHAR = chunk WHERE rk <= 240),
pools AS (SELECT qi, CASE WHEN count(DISTINCT CASE WHEN rk <= 80 THEN note END) < 8 AND max(rk) >= 80 THEN 240 ELSE 80 END AS pool FROM lists GROUP BY qi),
fused AS (SELECT qi, chunk, note, sum(1.0::DOUBLE / (60 + rk)) AS sc, min(list_no * 1000 + rk) AS seen FROM lists JOIN pools USING (qi) WHERE rk <= pool GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qi, note ORDER BY sc DESC, seen) AS crk FROM fused),
notes AS (SELECT qi, note, count(*) AS matched_chunks, max(CASE WHEN crk = 1 THEN chunk END) AS best_chunk, max(CASE WHEN crk = 1 THEN sc END) AS best_score, min(CASE WHEN crk = 1 THEN seen END) AS seen,
  sum(CASE WHEN crk = 1 THEN sc WHEN crk <= 4 THEN 0.25::DOUBLE * sc ELSE 0 END) AS score FROM ranked GROUP BY ALL),
weighed AS (SELECT n.*, score * (1 + (0.8 * ((n_chars % 101) / 100.0::DOUBLE) - 0.4)) AS worth FROM notes n JOIN documents ON doc_id::VARCHAR = best_chunk)
SELECT qi, note, best_chunk, matched_chunks, round(worth, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qi ORDER BY worth DESC, best_score DESC, seen) AS rank FROM weighed) WHERE rank <= 8""")
def hybrid_documents(spark, sf_dir):
    """Hybrid search with each document as one chunk of its source's note, from a stored table of vectors and a stored index."""
    docs = table(spark, sf_dir, "documents")
    empty = F.lit("")
    rows = docs.select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("note_id"), F.coalesce("text", empty).alias("search_text"), F.coalesce("text", empty).alias("text"), empty.alias("title"), empty.alias("type"), empty.alias("heading"), F.expr("n_chars % 101").cast("int").alias("quality"), F.lit(0.0).alias("created_ts")
    )
    path = scratch(spark)
    search.embedded(rows).write.option("compression", "zstd").parquet(path)
    chunks, index = spark.read.parquet(path), KeywordIndex(spark, scratch(spark))
    index.add(chunks)
    found = search.search_many(chunks, _questions(spark, sf_dir), now=NOW, k=8, index=index)
    return found.select("qi", F.col("note_id").alias("note"), "best_chunk", "matched_chunks", F.round("score", 6).alias("score"), "rank")
