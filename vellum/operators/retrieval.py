"""Ranked lists and their fusion: exact vector search, BM25, reciprocal ranks, collapse to notes, re-weighting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.numbers import quality_multiplier, recency_multiplier

RRF_K = 60
EXTRA_CREDIT, MAX_EXTRA = 0.25, 3
MAX_POOL = 400
#: A query set of this many rows is broadcast (its size is counted first); a larger one is joined in blocks.
MAX_QUERIES = 6
#: Queries that are compared at once, queries and chunks that are sent at once; this many queries, and words of queries, are still broadcast.
QUERY_BLOCK, QUERY_STRIP, CHUNK_BLOCK, FEW_QUERIES, FEW_TERMS = 128, 4096, 4096, 4096, 100_000


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, v: s + v)


def top_per_query(scored: DataFrame, k: int, order: list[Column], by: str = "qi") -> DataFrame:
    """The first k rows of each query with their rank from 1. Spark keeps k rows for each task and query before it shuffles
    (a rank filter over a window is a group limit), so the shuffle does not grow with the corpus."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def knn(chunks: DataFrame, queries: DataFrame, k: int, *, vector: str = "vector", key: str = "id") -> DataFrame:
    """Exact nearest neighbours of each row of ``queries`` (qi, qv): the chunk columns, qi, dist and rank. A null vector has
    no neighbours and is none. Any number of queries: more than MAX_QUERIES meet the chunks block by block."""
    chunks, queries = chunks.where(F.col(vector).isNotNull()), queries.where("qv IS NOT NULL").select("qi", "qv")
    asked = queries.limit(FEW_QUERIES + 1).count()
    order = [F.col("dist"), F.col(key)]
    if asked <= MAX_QUERIES:
        pairs = chunks.crossJoin(F.broadcast(queries)) if asked else chunks.join(queries, F.lit(False))
        return top_per_query(pairs.withColumn("dist", squared_distance(F.col(vector), F.col("qv"))), k, order).drop("qv")
    # a block of chunks is sent once for each strip of questions, so strips are long
    blocks = _blocks(queries.repartition(-(-queries.count() // QUERY_STRIP)), QUERY_STRIP, "queries")
    # a task has one block of chunks, or few: all pairs of a task may come to Python in one batch
    held = _blocks(chunks, CHUNK_BLOCK, "chunks").repartition(max(1, -(-chunks.count() // CHUNK_BLOCK)))
    pairs = held.crossJoin(F.broadcast(blocks) if asked <= FEW_QUERIES else blocks)
    schema = StructType([*chunks.schema.fields, queries.schema["qi"], StructField("dist", DoubleType())])
    return top_per_query(pairs.mapInArrow(_nearest(k, vector, key), schema), k, order)


def _blocks(df: DataFrame, size: int, name: str) -> DataFrame:
    """The rows as Arrow streams of ``size`` rows at most."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                part, sink = batch.slice(lo, size), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_batch(part)
                yield pa.record_batch([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=[name])

    return df.mapInArrow(each, f"{name} binary")


def _nearest(k: int, vector: str, key: str):
    """The k chunks of a block that are nearest to each query of a block; of equally near ones those with the smallest keys."""

    def read(block: pa.Scalar) -> pa.Table:
        return pa.ipc.open_stream(block.as_buffer()).read_all()

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return np.array(column.to_pylist(), np.float64)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunks, queries in zip(batch.column("chunks"), batch.column("queries"), strict=True):
                rows, strip = read(chunks), read(queries)
                rows = rows.take(pc.array_sort_indices(rows.column(key).combine_chunks(), null_placement="at_start"))
                x = matrix(rows.column(vector)).T
                for lo in range(0, strip.num_rows, QUERY_BLOCK):
                    asked = strip.slice(lo, QUERY_BLOCK)
                    dist = np.zeros((asked.num_rows, rows.num_rows))
                    for a, b in zip(matrix(asked.column("qv")).T, x, strict=True):  # one dimension after the other, as squared_distance adds them
                        dist += (b[None, :] - a[:, None]) ** 2
                    near = np.argsort(dist, axis=1, kind="stable")[:, :k]
                    at = np.repeat(np.arange(asked.num_rows), near.shape[1])
                    got = rows.take(pa.array(near.ravel())).append_column("qi", asked.column("qi").take(pa.array(at)))
                    yield from got.append_column("dist", pa.array(dist[at, near.ravel()])).combine_chunks().to_batches()

    return each


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def postings(docs: DataFrame, *, key: str = "id", text: str = "search_text") -> DataFrame:
    """term, id, tf and dl of every document, for an index that is written by term."""
    words = docs.select(F.col(key).alias("id"), tokens(F.col(text)).alias("w"))
    return words.select("id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame, *, text: str = "search_text") -> DataFrame:
    """n and avgdl: one row."""
    size = F.size(tokens(F.col(text)))
    return docs.select(size.alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def bm25(docs: DataFrame, queries: DataFrame, k: int, *, key: str = "id", text: str = "search_text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best documents for each query (qi, query): id, qi, score (6 places) and rank.

    Only the queries' terms pass to the shuffle, so it carries matches, not the corpus. Any number of queries: the words of
    more than FEW_TERMS are not broadcast but joined by shuffles.
    """
    asked = queries.select("qi", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    few = asked.limit(FEW_TERMS + 1).count() <= FEW_TERMS
    small = F.broadcast if few else lambda df: df.hint("merge")
    words = docs.select(F.col(key).alias("id"), tokens(F.col(text)).alias("w"))
    matched = words.select("id", F.size("w").alias("dl"), F.explode("w").alias("term")).join(small(asked.select("term").distinct()), "term", "left_semi")
    tf = matched.groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weighed = tf.join(small(df), "term").crossJoin(F.broadcast(corpus_stats(docs, text=text))).withColumn("idf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    gain = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = weighed.join(small(asked), "term").groupBy("qi", "id").agg(F.round(F.sum(gain), 6).alias("score"))
    return top_per_query(scored, k, [F.col("score").desc(), F.col("id")])


def fuse(lists: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (list_no, rank, chunk, note): one credit for a chunk in a list. ``by``: columns
    that tell questions apart."""
    once = lists.groupBy(*by, "list_no", "chunk", "note").agg(F.min("rank").alias("rank"))
    return once.groupBy(*by, "chunk", "note").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"), F.min(F.struct("list_no", "rank")).alias("first_seen"))


def collapse(fused: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Chunks to notes: the best chunk's score and a quarter of each of the next three; ties go to what was seen first."""
    order = Window.partitionBy(*by, "note").orderBy(F.col("score").desc(), F.col("first_seen"))
    ranked = fused.withColumn("place", F.row_number().over(order))
    credit = F.when(F.col("place") == 1, F.col("score")).when(F.col("place") <= 1 + MAX_EXTRA, EXTRA_CREDIT * F.col("score")).otherwise(0.0)
    return ranked.groupBy(*by, "note").agg(
        F.count("*").alias("matched_chunks"),
        F.max(F.when(F.col("place") == 1, F.col("chunk"))).alias("best_chunk"),
        F.max(F.when(F.col("place") == 1, F.col("score"))).alias("best_score"),
        F.min(F.when(F.col("place") == 1, F.col("first_seen"))).alias("first_seen"),
        F.sum(credit).alias("score"),
    )


def pooled(lists: DataFrame, k: int, pool: int) -> DataFrame:
    """Of the lists of each question (qi), cut at the wider pool, what the question's own pool keeps: ``pool``, or the wider one
    where a list was full and gave too few notes."""
    wider = min(pool * 3, MAX_POOL) if pool < MAX_POOL else pool
    told = lists.groupBy("qi").agg(F.count_distinct(F.when(F.col("rank") <= pool, F.col("note"))).alias("found"), F.max("rank").alias("fullest"))
    limit = F.when((F.col("found") < k) & (F.col("fullest") >= pool), wider).otherwise(pool)
    return lists.join(told.select("qi", limit.alias("limit")), "qi").where("rank <= limit").drop("limit")


def reweigh(notes: DataFrame, now: float, quality_weight: float = 1.0, recency_weight: float = 1.0) -> DataFrame:
    """score times the multipliers of the columns quality and created_ts."""
    return notes.withColumn("score", F.col("score") * quality_multiplier(F.coalesce("quality", F.lit(0)), quality_weight) * recency_multiplier(F.col("created_ts"), now, recency_weight))


def final_order() -> list[Column]:
    return [F.col("score").desc(), F.col("best_score").desc(), F.col("first_seen")]


def attribute(lists: DataFrame, k: int) -> DataFrame:
    """note, matched_queries: the queries that alone would have put the note among their first k."""
    per_query = lists.select("qi", "list_no", "rank", "chunk", "note")
    once = per_query.groupBy("qi", "list_no", "chunk", "note").agg(F.min("rank").alias("rank"))
    chunks = once.groupBy("qi", "chunk", "note").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"), F.min(F.struct("list_no", "rank")).alias("first_seen"))
    place = F.row_number().over(Window.partitionBy("qi", "note").orderBy(F.col("score").desc(), F.col("first_seen")))
    credit = F.when(F.col("place") == 1, F.col("score")).when(F.col("place") <= 1 + MAX_EXTRA, EXTRA_CREDIT * F.col("score")).otherwise(0.0)
    notes = chunks.withColumn("place", place).groupBy("qi", "note").agg(F.sum(credit).alias("score"), F.min(F.when(F.col("place") == 1, F.col("first_seen"))).alias("first_seen"))
    top = top_per_query(notes, k, [F.col("score").desc(), F.col("first_seen")])
    return top.groupBy("note").agg(F.array_sort(F.collect_set("qi")).alias("matched_queries"))


def widened_pool(k: int, pool: int, notes_found: int, fullest_list: int) -> int:
    """The pool of a second run, or the same if one run is enough."""
    return min(pool * 3, MAX_POOL) if notes_found < k and pool < MAX_POOL and fullest_list >= pool else pool


def rerank(hits: DataFrame, scorer, now: float, quality_weight: float = 1.0, recency_weight: float = 1.0) -> DataFrame:
    """Replace scores by sigmoid(logit) times the multipliers. ``scorer``: Column of the judged text to a Column of logits."""
    from ..functions.numbers import sigmoid

    judged = F.concat_ws("\n", *[F.nullif(F.col(c), F.lit("")) for c in ("title", "heading", "excerpt")])
    return reweigh(hits.withColumn("score", sigmoid(scorer(judged))), now, quality_weight, recency_weight)
