"""Operator 11, target-distribution importance resampling with overlap chunking of long texts.

Features are all runs of 1 to ``runs`` consecutive words, hashed into buckets by crc32. A bucket's gain is the log ratio of its
share in the target texts and its share in the source; a document weighs the sum of its features' gains, Gumbel noise that
depends on the id and the seed alone is added, and the highest scores are drawn.

Long texts. A text over CHUNK bytes is cut at word boundaries into chunks of about CHUNK bytes. A chunk owns the words that begin
in it and carries the next ``runs`` - 1 words behind them, so every feature starts in exactly one chunk and is whole there. Chunks
are dealt over all tasks (only they are shuffled, never the short texts); counts of chunks are added up by bucket, and weights of
chunks by document. A word longer than CHUNK is never cut. Rows are told apart by id and a 128-bit digest of the text; rows equal
in both have equal weights, so each gets the sum over the chunks of one.

Ranks. Drawn rows are sorted by range and numbered by the place in their range and the sizes of the ranges before it: no task
holds all of them, and what reaches the driver is one number for each range. The score of the last drawn row is found first, from
counts by score in steps that narrow down, so that only rows at or above it are sorted.

Rows. A null or wordless text has no features and weight 0, a null id hashes as the empty string and comes after equal scores,
repeated rows count each time (in the counts, in N and in the draw). Other columns are ignored. Empty tables give no rows, and an
empty target leaves every bucket's ratio to the source's counts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import id_and_text, materialize, shuffle_partitions, table, text_chunks

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UNFOLDED = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # the same words before A-Z are lower-cased
CHUNK = 1 << 18
KNOWN = 200_000  # words whose hash a task remembers


def starts_of_chunks(text: bytes, size: int) -> Iterator[tuple[int, int]]:
    """The text as [begin, end) spans of about ``size`` bytes; no end lies inside a word."""
    begin = 0
    while begin < len(text):
        end = min(len(text), begin + size)
        inside = UNFOLDED.match(text, end - 1) if end < len(text) else None
        if inside:
            end = inside.end()
        yield begin, end
        begin = end


def carried(text: bytes, end: int, words: int) -> int:
    """Where the ``words`` words behind ``end`` end."""
    for _ in range(words):
        found = UNFOLDED.search(text, end)
        if not found:
            return len(text)
        end = found.end()
    return end


class Buckets:
    """Bucket numbers of the features of a piece of text whose first ``own`` bytes it owns."""

    def __init__(self, runs: int, buckets: int):
        self.runs, self.buckets, self.known = runs, buckets, {}

    def _crcs(self, words: list[bytes]) -> list[int]:
        if len(self.known) > KNOWN:
            self.known.clear()
        known, out = self.known, []
        for word in words:
            crc = known.get(word)
            if crc is None:
                crc = known[word] = zlib.crc32(word)
            out.append(crc)
        return out

    def of(self, piece: bytes, own: int) -> tuple[int, np.ndarray]:
        """Words that the piece owns, and the bucket of each feature that starts with one of them."""
        text = piece.lower()
        words = WORD.findall(text)
        mine = len(words) if own >= len(text) else len(WORD.findall(text, 0, own))
        crcs = self._crcs(words)
        out = [np.array(crcs[:mine], np.int64) % self.buckets]
        for length in range(2, self.runs + 1):
            # the checksum of a run goes on from that of the run without its last word
            crcs = [zlib.crc32(b" " + words[i + length - 1], c) for i, c in enumerate(crcs[: len(words) - length + 1])]
            out.append(np.array(crcs[:mine], np.int64) % self.buckets)
        return mine, np.concatenate(out)


PIECES = "doc_id {id}, digest binary, chunk int, piece binary, own int"


def pieces(base: DataFrame, runs: int, size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Short texts as they are, and long ones cut: (doc_id, text) -> short (doc_id, text) and chunks (doc_id, digest, chunk, piece, own)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches):
            for i, text in enumerate(part.column("text")):
                text = text.as_py()
                digest = xxhash.xxh3_128_digest(text)
                for k, (begin, end) in enumerate(starts_of_chunks(text, size)):
                    stop = carried(text, end, runs - 1)
                    yield pa.record_batch([part.column("doc_id").slice(i, 1), pa.array([digest], pa.binary()), pa.array([k], pa.int32()), pa.array([text[begin:stop]], pa.binary()), pa.array([end - begin], pa.int32())], names=["doc_id", "digest", "chunk", "piece", "own"])

    long = base.where(F.octet_length("text") > size)
    chunks = long.mapInArrow(cut, PIECES.format(id=base.schema["doc_id"].dataType.simpleString()))
    return base.where(F.octet_length("text") <= size), chunks.repartition(shuffle_partitions(base.sparkSession), F.xxhash64("digest", "chunk"))


def bucket_counts(base: DataFrame, runs: int, buckets: int, size: int = CHUNK) -> np.ndarray:
    """Features of all texts by bucket."""

    def count(column: str, own: str | None):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, features = np.zeros(buckets, np.int64), Buckets(runs, buckets)
            for part in text_chunks(batches, column):
                owned = part.column(own).to_pylist() if own else None
                for i, text in enumerate(part.column(column).to_pylist()):
                    if text:
                        total += np.bincount(features.of(text, owned[i] if owned else len(text))[1], minlength=buckets)
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

        return each

    short, chunks = pieces(base, runs, size)
    parts = short.select("text").mapInArrow(count("text", None), "bucket int, n long").unionByName(chunks.select("piece", "own").mapInArrow(count("piece", "own"), "bucket int, n long"))
    out = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():  # as many rows as buckets
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share in the target / share in the source)) of each bucket, both smoothed by one."""
    some, all_s, all_t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_s + some) / ((s + 1) * (all_t + some)))) for s, t in zip(map(float, source), map(float, target), strict=True)], np.int64)


def weights(base: DataFrame, gain: np.ndarray, runs: int, size: int = CHUNK) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""
    fields = "n_words long, n_features long, weight long"
    id_type = base.schema["doc_id"].dataType.simpleString()

    def weigh(column: str, keys: list[str], own: str | None):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            features = Buckets(runs, len(gain))
            for part in text_chunks(batches, column):
                owned = part.column(own).to_pylist() if own else None
                rows = [(0, 0, 0)] * part.num_rows
                for i, text in enumerate(part.column(column).to_pylist()):
                    if text:
                        words, at = features.of(text, owned[i] if owned else len(text))
                        rows[i] = (words, len(at), int(gain[at].sum()))
                yield pa.record_batch([*(part.column(k) for k in keys), *(pa.array(x, pa.int64()) for x in zip(*rows, strict=True))], names=[*keys, "n_words", "n_features", "weight"])

        return each

    short, chunks = pieces(base, runs, size)
    # a null text passes neither filter
    bare = base.where("text IS NULL").selectExpr("doc_id", "0L AS n_words", "0L AS n_features", "0L AS weight")
    short = short.mapInArrow(weigh("text", ["doc_id"], None), f"doc_id {id_type}, {fields}")
    parts = chunks.mapInArrow(weigh("piece", ["doc_id", "digest", "chunk"], "own"), f"doc_id {id_type}, digest binary, chunk int, {fields}")
    sums = parts.groupBy("doc_id", "digest").agg(F.count_if(F.col("chunk") == 0).alias("copies"), *(F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")))
    long = sums.select("doc_id", *(F.expr(f"{c} div copies").alias(c) for c in ("n_words", "n_features", "weight")), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")
    return short.unionByName(long).unionByName(bare)


def noisy(rows: DataFrame, seed: int) -> DataFrame:
    """Adds ``score``: the weight and the Gumbel noise of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return rows.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long"))


def lowest_drawn(scores: DataFrame, wanted: int) -> tuple[int, int]:
    """The ``wanted``-th highest score, and how many are above it: counts in 4,096 steps between bounds that narrow down."""
    ends = scores.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    lo, hi, above = ends["lo"], ends["hi"], 0
    while lo < hi:
        step = -(-(hi - lo + 1) // 4096)
        counts = scores.where(F.col("score").between(lo, hi)).groupBy(F.expr(f"(score - {lo}L) div {step}L").alias("step")).count()
        for row in sorted(counts.collect(), key=lambda r: -r["step"]):  # 4,096 rows at most
            if above + row["count"] >= wanted:
                lo, hi = lo + row["step"] * step, min(hi, lo + (row["step"] + 1) * step - 1)
                break
            above += row["count"]
    return lo, above


def draw(scored: DataFrame, *, least_words: int = 20, percent: int = 10) -> DataFrame:
    """Adds ``rank``: 1, 2, 3... for the floor(percent N / 100) highest scores of the N rows with ``least_words`` words or
    more (ties: smaller doc_id), null for the rest. ``scored`` is read several times (a kept table)."""
    fit = scored.where(F.col("n_words") >= least_words)
    wanted = percent * fit.count() // 100
    none = F.lit(None).cast("long")
    if not wanted:
        return scored.withColumn("rank", none)
    low, _ = lowest_drawn(fit, wanted)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc(), F.col("n_words").desc()]
    near = fit.where(F.col("score") >= low)
    laid = near.repartitionByRange(shuffle_partitions(scored.sparkSession), *order).sortWithinPartitions(*order)
    laid = materialize(laid.withColumn("place", F.monotonically_increasing_id()), "op11-order")
    part = F.shiftright("place", 33).alias("part")
    sizes = sorted((r["part"], r["count"]) for r in laid.groupBy(part).count().collect())  # a row for each range
    offsets = laid.sparkSession.createDataFrame([(int(p), int(sum(n for q, n in sizes if q < p))) for p, _ in sizes], "part long, before long")
    ranked = laid.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank"))).select(*scored.columns, "rank")
    rest = scored.where((F.coalesce("n_words", F.lit(0)) < least_words) | (F.col("score") < low)).withColumn("rank", none)
    return ranked.unionByName(rest)


def importance_resampling(docs: DataFrame, target: DataFrame, *, runs: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", chunk_bytes: int = CHUNK) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null where a row is not drawn) of every row of ``docs``, weighed
    towards the texts of ``target``."""
    base = id_and_text(docs, id_col, text_col)
    aim = target.select(F.lit(0).cast("long").alias("doc_id"), F.col(target_text).cast("binary").alias("text"))
    gain = gains(bucket_counts(base, runs, buckets, chunk_bytes), bucket_counts(aim, runs, buckets, chunk_bytes))
    scored = materialize(noisy(weights(base, gain, runs, chunk_bytes), seed), "op11-scored")
    return draw(scored, least_words=least_words, percent=percent)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance_resampling(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), runs=1, buckets=10_000, seed=2024, least_words=20, percent=10)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op11_importance_resampling": op11_importance_resampling}

#: DuckDB has no crc32: the checksum of each distinct word is stepped through its bytes, with the table of the reflected polynomial.
_SQL = r"""
WITH RECURSIVE words AS (
    SELECT 0 AS side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
    UNION ALL
    SELECT 1, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
counted AS (SELECT side, doc_id, word, count(*) AS n FROM words GROUP BY ALL),
bits AS (
    SELECT range AS byte, range AS c, 0 AS k FROM range(256)
    UNION ALL SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
lookup AS MATERIALIZED (SELECT byte, c FROM bits WHERE k = 8),
steps AS (
    SELECT word, hex(encode(word)) AS bytes, 0 AS pos, 4294967295::BIGINT AS crc FROM (SELECT DISTINCT word FROM counted)
    UNION ALL
    SELECT s.word, s.bytes, s.pos + 1, xor(s.crc // 256, l.c) FROM steps s JOIN lookup l
        ON l.byte = xor(s.crc % 256, ('0x' || substr(s.bytes, 2 * s.pos + 1, 2))::BIGINT) WHERE 2 * s.pos < length(s.bytes)),
hashed AS MATERIALIZED (SELECT word, xor(crc, 4294967295) % 10000 AS bucket FROM steps WHERE 2 * pos = length(bytes)),
totals AS (SELECT bucket, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM counted JOIN hashed USING (word) GROUP BY bucket),
sums AS (SELECT sum(s) AS big_s, sum(t) AS big_t FROM totals),
gains AS (
    SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (coalesce(big_s, 0)::DOUBLE + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (coalesce(big_t, 0)::DOUBLE + 10000))))::BIGINT AS gain
    FROM totals, sums),
weighed AS (SELECT doc_id, sum(n) AS n_words, sum(n * gain) AS weight FROM counted JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id),
scored AS (
    SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296))))::BIGINT AS score
    FROM (SELECT doc_id FROM documents) LEFT JOIN weighed USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * (SELECT count(*) FROM placed) // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""
SQL: dict[str, str] = {"op11_importance_resampling": _SQL}
