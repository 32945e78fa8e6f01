"""From notes to an index and from a question to notes."""

from __future__ import annotations

import re
import warnings
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import cwe_filter_token, cwe_tokens, epoch_day, has_token
from ..functions.text import note_slug
from ..operators import chunking, retrieval, scoring
from ..session import Settings
from .keyword_index import KeywordIndex


class _Dims(dict):
    """word -> its dimension, kept for words seen before."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, word: str) -> int:
        value = self[word] = zlib.crc32(word.encode()) % self.dim
        return value


def hashed_words(texts: Iterable[str | None], dim: int = 64) -> np.ndarray:
    """The default embedder: counts of words by hash, as unit vectors. Any function of the same form can take its place."""
    texts, at = list(texts), _Dims(dim)
    out = np.zeros((len(texts), dim), np.float32)
    for i, t in enumerate(texts):
        out[i] = np.bincount([at[w] for w in re.findall("[a-z0-9]+", (t or "").lower())] or np.empty(0, int), minlength=dim)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm, norm, 1)


Embedder = Callable[[list[str]], np.ndarray]


def normalize_queries(query: str | None, queries: Iterable[str] | None = None) -> list[str]:
    """Stripped, without blanks and repeats (in any case of letters), in order; the first is the primary one."""
    out: dict[str, str] = {}
    for q in (query, *(queries or ())):
        q = (q or "").strip()
        if q:
            out.setdefault(q.casefold(), q)
    return list(out.values())


def where(filters: dict | None, min_quality: int = 0) -> Column:
    """The search filter, to stand below every ranking. A malformed CWE raises."""
    out = F.lit(True)
    for name, value in (filters or {}).items():
        if not value:
            continue
        v = str(value).strip().lower()
        if name == "cwe":
            out = out & has_token(F.col("cwe_str"), cwe_filter_token(value))
        elif name in ("type", "severity"):
            out = out & (F.col(name) == v)
        elif name == "program":
            out = out & (F.lower("program") == v)
        else:
            raise ValueError(f"no filter named {name!r}")
    return out & (F.coalesce("quality", F.lit(0)) >= min_quality) if min_quality > 0 else out


def created_ts() -> Column:
    """Seconds of the note's day; what the user wrote falls back on when it was captured or stored. 0 is unknown."""
    from ..operators.scoring import extra

    fallback = F.when(scoring.is_user_authored(), F.coalesce(F.try_to_date(F.substring(extra("captured"), 1, 10)), F.to_date("ingested")))
    return epoch_day(F.coalesce("created", fallback))


def index_rows(notes: DataFrame, embed: Embedder = hashed_words, settings: Settings = Settings()) -> DataFrame:
    """The chunk table of notes: cut, embedded with title and heading in front, with the note's columns beside."""
    dim = settings.dim

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                title, heading, text = (part.column(c).to_pylist() for c in ("title", "heading", "text"))
                got = embed(["\n".join([*filter(None, (t, h)), x]) for t, h, x in zip(title, heading, text, strict=True)])
                if got.shape != (part.num_rows, dim):
                    raise RuntimeError(f"the embedder made {got.shape}, not {(part.num_rows, dim)}")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(got.astype(np.float32)), pa.list_(pa.float32()))], names=[*part.schema.names, "vector"])

    joined = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ")
    empty = lambda c: F.coalesce(c, F.lit(""))
    meta = [
        note_slug(F.col("id"), F.col("title")).alias("slug"), F.col("type"), empty("source").alias("source"), empty("url").alias("url"), F.array_join(cwe_tokens(F.col("cwe")), " ").alias("cwe_str"), joined("tags").alias("tags_str"), joined("cwe").alias("raw_cwe"),
        empty("severity").alias("severity"), empty("program").alias("program"), F.col("mtime"), scoring.score_note().alias("quality"), created_ts().alias("created_ts"),
    ]
    beside = notes.where("path IS NOT NULL").select("id", "path", "title", "body", *meta)  # a note's columns go with its chunks: texts are not shuffled
    cut = chunking.chunks(beside, window=settings.window, overlap=settings.overlap, carry=beside.columns[4:])
    rows = cut.mapInArrow(vectors, T.StructType([*cut.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))]))
    tag = F.substring(F.sha2(F.col("path"), 256), 1, 8)
    chunk_id = F.concat_ws("::", "note_id", F.when(F.col("path") != "", tag), F.col("chunk_index").cast("string"))
    search_text = F.concat_ws("\n", *[F.nullif(c, F.lit("")) for c in (F.col("title"), F.col("heading"), F.col("text"), F.col("tags_str"), F.col("raw_cwe"))])
    rows = rows.withColumn("id", chunk_id).withColumn("search_text", search_text)
    return rows.select("id", "note_id", "slug", "type", "title", "heading", "text", "search_text", "chunk_index", "vector", "source", "url", "cwe_str", "tags_str", "severity", "program", "path", "mtime", "quality", "created_ts")


def ranked_lists(spark: SparkSession, chunks: DataFrame, queries: list[str], pool: int, embed: Embedder) -> DataFrame:
    """qi, list_no, rank, chunk, note: the vector list and the keyword list of each query."""
    vectors = embed(queries)
    asked = spark.createDataFrame([(i, q, [float(x) for x in v]) for i, (q, v) in enumerate(zip(queries, vectors, strict=True))], "qi int, query string, qv array<float>")
    near = retrieval.knn(chunks.select("id", "note_id", "vector"), asked.select("qi", "qv"), pool).select("qi", (2 * F.col("qi")).alias("list_no"), "rank", F.col("id").alias("chunk"), F.col("note_id").alias("note"))
    words = retrieval.bm25(chunks.select("id", "search_text"), asked.select("qi", "query"), pool)
    words = words.join(chunks.select("id", "note_id"), "id").select("qi", (2 * F.col("qi") + 1).alias("list_no"), "rank", F.col("id").alias("chunk"), F.col("note_id").alias("note"))
    return near.unionByName(words)


def search(spark: SparkSession, chunks: DataFrame, query: str | list[str], *, now: float, k: int = 8, filters: dict | None = None, min_quality: int = 0, pool: int = 40, embed: Embedder = hashed_words, settings: Settings = Settings(), scorer=None) -> DataFrame:
    """The k best notes: note_id, title, type, excerpt, heading, score, matched_chunks, quality, matched_queries, rank.

    The filter stands below both retrievers. A pool that was full and still gave too few notes is widened once.
    """
    queries = normalize_queries(None, [query] if isinstance(query, str) else query)
    if len(queries) > retrieval.MAX_QUERIES:
        raise ValueError(f"at most {retrieval.MAX_QUERIES} phrasings")
    if not 1 <= k <= 50:
        raise ValueError("k must be within 1 and 50")
    pool = max(pool, min(retrieval.MAX_POOL, max(80, 10 * (max(k, 20) if scorer else k))))
    allowed = chunks.where(where(filters, min_quality))
    if not queries:
        return chunks.limit(0).select("note_id", "title")
    wide = min(3 * pool, retrieval.MAX_POOL)
    lists = retrieval.pooled(ranked_lists(spark, allowed, queries, wide, embed).withColumnRenamed("qi", "asked").withColumn("qi", F.lit(0)), k, pool)
    lists = lists.drop("qi").withColumnRenamed("asked", "qi")
    notes = retrieval.collapse(retrieval.fuse(lists))
    shown = allowed.select(F.col("id").alias("best_chunk"), "note_id", "slug", "title", "type", "url", "source", "severity", "program", "path", "heading", F.substring("text", 1, 600).alias("excerpt"), "quality", "created_ts")
    hits = retrieval.reweigh(notes.join(shown, "best_chunk"), now, settings.quality_weight, settings.recency_weight)
    if scorer is not None:
        top = hits.orderBy(*retrieval.final_order()).limit(max(k, 20))
        hits = retrieval.rerank(top, scorer, now, settings.quality_weight, settings.recency_weight)
    best = hits.orderBy(*retrieval.final_order()).limit(k)
    return best.join(retrieval.attribute(lists, k), "note", "left").drop("note").orderBy(F.col("score").desc(), F.col("best_score").desc(), "first_seen")


def embedded(rows: DataFrame, embed: Embedder = hashed_words, column: str = "search_text") -> DataFrame:
    """The rows with ``vector``, the embedding of a text column (null: empty)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                got = embed([t or "" for t in part.column(column).to_pylist()]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(got), pa.list_(pa.float32()))], names=[*part.schema.names, "vector"])

    return rows.mapInArrow(each, T.StructType([*rows.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))]))


def _asked(questions: DataFrame, embed: Embedder) -> DataFrame:
    """qi, query and qv of the questions (qi, query) that have text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = embed(batch.column("query").to_pylist()).astype(np.float64)
                yield pa.record_batch([batch.column("qi"), batch.column("query"), pa.array(list(got), pa.list_(pa.float64()))], names=["qi", "query", "qv"])

    rows = questions.where(F.trim(F.coalesce("query", F.lit(""))) != "").select("qi", F.trim("query").alias("query"))
    return rows.mapInArrow(each, f"qi {rows.schema['qi'].dataType.simpleString()}, query string, qv array<double>")


def keyword_list(chunks: DataFrame, asked: DataFrame, pool: int, index: KeywordIndex | None) -> DataFrame | None:
    """qi, id and rank by words: from the index, or from the chunks themselves where there is none. An index that cannot be read
    leaves the vectors to answer alone, with a warning: then the list is None."""
    if index is None:
        return retrieval.bm25(chunks.select("id", "search_text"), asked.select("qi", "query"), pool).select("qi", "id", "rank")
    try:
        if index.store.pointer() is None:
            raise FileNotFoundError("it was never written")
        return index.search(asked.select("qi", "query"), pool).select("qi", "id", "rank")
    except Exception as e:
        warnings.warn(f"the keyword index gives no answer ({str(e).splitlines()[0][:200]}): vectors only", RuntimeWarning, stacklevel=2)
        return None


def search_many(chunks: DataFrame, questions: DataFrame, *, now: float, k: int = 8, filters: dict | None = None, min_quality: int = 0, pool: int = 40, index: KeywordIndex | None = None, embed: Embedder = hashed_words, settings: Settings = Settings()) -> DataFrame:
    """What ``search`` finds for each of many questions (qi, query), in one plan: qi, note_id, title, type, excerpt, heading, score,
    matched_chunks, best_chunk, quality, matched_queries and rank.

    The lists are made once, as long as a widened pool needs them; each question then keeps its own pool. ``index`` holds the
    words of all chunks, so it serves where no filter stands below the retrievers; with a filter the words are read from
    what the filter leaves. Questions without text find nothing.
    """
    if not 1 <= k <= 50:
        raise ValueError("k must be within 1 and 50")
    pool = max(pool, min(retrieval.MAX_POOL, max(80, 10 * k)))
    wide = min(3 * pool, retrieval.MAX_POOL)
    bare = not any((filters or {}).values()) and min_quality <= 0
    allowed = chunks if bare else chunks.where(where(filters, min_quality))
    asked = _asked(questions, embed)
    near = retrieval.knn(allowed.select("id", "note_id", "vector"), asked.select("qi", "qv"), wide).select("qi", F.lit(0).alias("list_no"), "rank", F.col("id").alias("chunk"), F.col("note_id").alias("note"))
    words = keyword_list(allowed, asked, wide, index if bare else None)
    lists = near
    if words is not None:
        lists = near.unionByName(words.join(allowed.select("id", F.col("note_id").alias("note")), "id").select("qi", F.lit(1).alias("list_no"), "rank", F.col("id").alias("chunk"), "note"))
    notes = retrieval.collapse(retrieval.fuse(retrieval.pooled(lists, k, pool), ("qi",)), ("qi",))
    # before weights: whether the question alone puts the note among its first k
    alone = F.row_number().over(Window.partitionBy("qi").orderBy(F.col("score").desc(), F.col("first_seen")))
    notes = notes.withColumn("matched_queries", F.when(alone <= k, F.array(F.lit(0))))
    hits = retrieval.reweigh(notes.join(allowed.select(F.col("id").alias("best_chunk"), "quality", "created_ts"), "best_chunk"), now, settings.quality_weight, settings.recency_weight)
    best = retrieval.top_per_query(hits, k, retrieval.final_order()).drop("quality", "created_ts")
    # texts are read for what is shown only: k rows of a question go to the chunks, which stay where they are
    few = asked.limit(retrieval.FEW_QUERIES + 1).count() <= retrieval.FEW_QUERIES
    shown = allowed.select(F.col("id").alias("best_chunk"), "note_id", "title", "type", "heading", F.substring("text", 1, 600).alias("excerpt"), "quality")
    best = shown.join(F.broadcast(best) if few else best, "best_chunk")
    return best.select("qi", "note_id", "title", "type", "excerpt", "heading", "score", "matched_chunks", "best_chunk", "quality", "matched_queries", "rank")
