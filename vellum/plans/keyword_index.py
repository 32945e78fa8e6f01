"""A stored keyword index: postings in blocks by term, appended segment by segment, read by the blocks that can matter.

Layout. A row is a block of at most BLOCK postings of one term in one segment, by runs of ids and then the best first: a posting is
better the higher its weight at average length. Each task lays the words of its own documents out in pieces of this form; pieces
are shuffled, not postings, and cut into blocks where they meet. The row carries what bounds every posting in it (the highest tf and the smallest length), so a question can
tell from a block's head what the block is worth at most. Rows are partitioned by a hash of the term and sorted by term, so a
question reads the partitions of its terms and, of these, the row groups that hold them. Sizes of documents are blocks of the
empty term; ids that a later segment replaces or removes are blocks of the term GONE, so one append is one commit.

Search. Scores equal ``retrieval.bm25`` over the documents that are there now: n, the average length and the document
frequencies are sums over heads of blocks, less what is gone. The first blocks of each term give every question k documents
and a score that the k-th best cannot fall below. Terms that cannot reach it together, even with their best postings, find no
document alone: candidates come from the other, essential terms, of which a block is read only if its bound and the best of the
question's other terms reach that score. Blocks of the rest are read only where a candidate may stand in them (ids are dealt to
runs by hash, and a block knows its runs) and where bound and candidate reach the score together. Whatever is not read belongs to
no answer. Sums are rounded only at the end.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import retrieval
from .store import Snapshots

GONE = "\x00gone"  # no token: tokens are letters and digits
BUCKETS = 16
BLOCK = 128
RUNS = 256
MERGE = 16  # segments that are made one
SLACK = 2e-6  # bounds are compared with room for rounding
PACK = 1 << 21  # words of documents that are packed at once
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SLICE = 32 << 20  # bytes of pieces that are shuffled at once, as long as there are buckets
FEW_TERMS = 1000  # so many terms of questions are named in the scan


def block_schema(id_type: str) -> str:
    return f"term string, segment long, block long, n long, top_tf int, low_dl int, size long, low_run int, high_run int, ids array<{id_type}>, tfs array<int>, dls array<int>, bucket int"


def _bucket(term, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _by_run(term: np.ndarray, run: np.ndarray, tf: np.ndarray, dl: np.ndarray, runs: int) -> np.ndarray:
    """The order of postings: by term and run, then the best first (an order only: any is right)."""
    worse = 1 - tf / (tf + dl / 200.0 + 1)
    return np.argsort((term.astype(np.int64) * runs + run) * 65536 + (worse * 65535).astype(np.int64), kind="stable")


def _starts(term: np.ndarray, block: int) -> np.ndarray:
    begin = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    return np.flatnonzero((np.arange(len(term)) - np.repeat(begin, np.diff([*begin, len(term)]))) % block == 0)


def _pieces(block: int, runs: int):
    """id, run and words of documents -> pieces of at most ``block`` postings of one term, of at most PACK words of text at once
    (a longer document stands alone). Sizes are pieces of the empty term."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, lo = batch.column("w").offsets.to_numpy().astype(np.int64), 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PACK, "right")) - 1)
                part, lo = batch.slice(lo, hi - lo), hi
                rows, words = part.num_rows, part.column("w").flatten().dictionary_encode()
                dl, run = np.diff(part.column("w").offsets.to_numpy()), part.column("run").to_numpy()
                pairs, tf = np.unique(words.indices.to_numpy().astype(np.int64) * rows + np.repeat(np.arange(rows), dl), return_counts=True)
                term, at, tf = np.append(pairs // rows, np.full(rows, len(words.dictionary))), np.append(pairs % rows, np.arange(rows)), np.append(tf, np.zeros(rows, np.int64)).astype(np.int32)
                order = _by_run(term, run[at], tf, dl[at], runs)
                term, at, tf = term[order], at[order], tf[order]
                starts = _starts(term, block)
                ends = pa.array(np.append(starts, len(term)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, x) for x in (part.column("id").take(pa.array(at)), pa.array(tf), pa.array(dl[at]), pa.array(run[at]))]
                names = pa.concat_arrays([words.dictionary, pa.array([""], words.dictionary.type)]).take(pa.array(term[starts]))
                yield pa.record_batch([names, pa.array(np.diff([*starts, len(term)]).astype(np.int32)), pa.array(run[at[starts]]), *lists], names=["term", "n", "low_run", "ids", "tfs", "dls", "at"])

    return each


def _blocks_of_pieces(block: int, runs: int, segment: int):
    """Pieces in a row (sorted by bucket, term and low_run) -> blocks. What later pieces may stand between is held: postings of one
    term from the last piece's first run on."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []
        for batch in chain(batches, [None]):
            parts = [*held, *([batch] if batch is not None and batch.num_rows else [])]
            if not parts:
                continue
            rows = pa.Table.from_batches([pa.RecordBatch.from_arrays(x.columns, names=x.schema.names) for x in parts]).combine_chunks()
            column = lambda c, rows=rows: rows.column(c).combine_chunks()
            n, word = column("n").to_numpy(), column("term").dictionary_encode().indices.to_numpy()
            of, ids = np.repeat(np.arange(len(n)), n), column("ids").flatten()
            tf, dl, run = (column(c).flatten().to_numpy() for c in ("tfs", "dls", "at"))
            order = _by_run(word[of], run, tf, dl, runs)
            of, ids, tf, dl, run = of[order], ids.take(pa.array(order)), tf[order], dl[order], run[order]
            term, end, held = word[of], len(of), []
            starts = _starts(term, block)
            if batch is not None:
                begin = int(np.searchsorted(term, word[-1]))
                done = int(np.searchsorted(run[begin:], rows.column("low_run")[-1].as_py()))  # sorted by run within the term
                end = begin + done // block * block
                if end < len(of):
                    rest = [pa.ListArray.from_arrays(pa.array([0, len(of) - end], pa.int32()), x) for x in (ids.slice(end), *(pa.array(x[end:]) for x in (tf, dl, run)))]
                    last = rows.slice(len(n) - 1)
                    held = [pa.record_batch([last.column("term").combine_chunks(), pa.array([len(of) - end], pa.int32()), last.column("low_run").combine_chunks(), *rest, last.column("bucket").combine_chunks()], names=rows.schema.names)]
                starts = starts[starts < end]
            if not len(starts):
                continue
            tf, dl, run, cuts = tf[:end], dl[:end], run[:end], np.append(starts, end)
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), x) for x in (ids.slice(0, end), pa.array(tf), pa.array(dl))]
            yield pa.record_batch(
                [
                    column("term").take(pa.array(of[starts])), pa.array(np.full(len(starts), segment)), pa.array(number + np.arange(len(starts))), pa.array(np.diff(cuts).astype(np.int64)),
                    pa.array(np.maximum.reduceat(tf, starts)), pa.array(np.minimum.reduceat(dl, starts)), pa.array(np.add.reduceat(dl.astype(np.int64), starts)),
                    pa.array(np.minimum.reduceat(run, starts)), pa.array(np.maximum.reduceat(run, starts)), *lists, column("bucket").take(pa.array(of[starts])),
                ],
                names=["term", "segment", "block", "n", "top_tf", "low_dl", "size", "low_run", "high_run", "ids", "tfs", "dls", "bucket"],
            )
            number += len(starts)

    return each


def _packed(block: int):
    """Postings in a row (sorted by bucket, term, segment) -> blocks of at most ``block`` of one term and segment."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, None
        for batch in chain(batches, [None]):
            parts = [x for x in (held, batch) if x is not None and x.num_rows]
            if not parts:
                continue
            rows = pa.Table.from_batches([pa.RecordBatch.from_arrays(x.columns, names=x.schema.names) for x in parts]).combine_chunks()
            term, segment = rows.column("term").combine_chunks().dictionary_encode().indices.to_numpy(), rows.column("segment").to_numpy()
            new = np.concatenate([[True], (term[1:] != term[:-1]) | (segment[1:] != segment[:-1])])
            begin = np.flatnonzero(new)
            place = np.arange(len(new)) - np.repeat(begin, np.diff([*begin, len(new)]))
            cuts = np.flatnonzero(place % block == 0)
            starts, end = (cuts, len(new)) if batch is None else (cuts[:-1], int(cuts[-1]))  # the last may go on in the next batch
            held = None if batch is None else rows.slice(end).to_batches()[0]
            if not len(starts):
                continue
            full, firsts = rows.slice(0, end), pa.array(starts)
            tf, dl, run = (full.column(c).to_numpy() for c in ("tf", "dl", "run"))
            offsets = pa.array([*starts, end], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, full.column(c).combine_chunks()) for c in ("id", "tf", "dl")]
            yield pa.record_batch(
                [
                    full.column("term").combine_chunks().take(firsts), pa.array(segment[starts]), pa.array(number + np.arange(len(starts))), pa.array(np.diff([*starts, end]).astype(np.int64)),
                    pa.array(np.maximum.reduceat(tf, starts)), pa.array(np.minimum.reduceat(dl, starts)), pa.array(np.add.reduceat(dl.astype(np.int64), starts)),
                    pa.array(np.minimum.reduceat(run, starts)), pa.array(np.maximum.reduceat(run, starts)), *lists, full.column("bucket").combine_chunks().take(firsts),
                ],
                names=["term", "segment", "block", "n", "top_tf", "low_dl", "size", "low_run", "high_run", "ids", "tfs", "dls", "bucket"],
            )
            number += len(starts)

    return each


class _Segments(Snapshots):
    """Snapshots whose folders are partitioned by bucket."""

    def _write(self, rows: DataFrame, name: str | None = None) -> str:
        """``name``: a folder that was begun and has no reader yet."""
        import time

        name = name or f"part-{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        before = self.spark.conf.get(_FREE, "false")
        self.spark.conf.set(_FREE, "true")  # the shuffled pieces go when the segment is there, not when the driver collects garbage
        try:
            rows.sortWithinPartitions("bucket", "term", "block").write.mode("append").partitionBy("bucket").option("parquet.block.size", 4 << 20).option("compression", "zstd").parquet(f"{self.root}/{name}")
        finally:
            self.spark.conf.set(_FREE, before)
        return name

    def _rows(self, at: dict | None) -> DataFrame:
        if at is None:
            return self.spark.createDataFrame([], self.schema)
        parts = [self.spark.read.schema(self.schema).parquet(f"{self.root}/{d}") for d in at["dirs"]]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


class KeywordIndex:
    """Documents by their words. ``id_type``: the SQL type of ids."""

    def __init__(self, spark: SparkSession, root: str, id_type: str = "string", *, block: int = BLOCK, buckets: int = BUCKETS, runs: int = RUNS, k1: float = 1.2, b: float = 0.75):
        self.spark, self.id_type, self.block, self.buckets, self.runs, self.k1, self.b = spark, id_type, block, buckets, runs, k1, b
        self.store = _Segments(spark, root, block_schema(id_type))

    # ---- writing
    def add(self, docs: DataFrame, *, key: str = "id", text: str = "search_text") -> None:
        """Append a segment. Ids that the index holds are replaced; a null id is left out, and of rows that repeat an id the
        one with the greatest text counts."""
        docs = docs.where(F.col(key).isNotNull()).select(F.col(key).cast(self.id_type).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        if not docs.groupBy("id").count().where("count > 1").isEmpty():  # else no text is shuffled
            docs = docs.groupBy("id").agg(F.max("text").alias("text"))
        self._append(docs, docs.select("id"))
        if len((self.store.pointer() or {"dirs": []})["dirs"]) > MERGE:
            self.compact()

    def remove(self, ids: DataFrame, *, key: str = "id") -> None:
        """Append what is gone; ids that are not there are ignored."""
        self._append(None, ids.where(F.col(key).isNotNull()).select(F.col(key).cast(self.id_type).alias("id")).distinct())

    def _append(self, docs: DataFrame | None, ids: DataFrame) -> None:
        def step(at: dict | None) -> None:
            segment = (at["version"] if at else 0) + 1
            held = self._sizes(self.store._rows(at))
            gone = None
            if at is not None:
                replaced = held.join(ids, "id", "left_semi").select(F.lit(GONE).alias("term"), "id", F.lit(0).alias("tf"), "dl", "segment")
                gone = None if replaced.isEmpty() else self.store._write(self._blocks(replaced))
            name = gone if docs is None else self._written(docs, segment, gone)
            if name is not None:
                self.store._commit(at, [*(at["dirs"] if at else []), name])

        self.store._again(step)

    def _written(self, docs: DataFrame, segment: int, name: str | None) -> str:
        """The blocks of the documents (id, text), in the folder ``name`` or a new one. Pieces lie as Parquet by bucket and are
        shuffled some buckets at a time: rows of a shuffle are several times as large. Of a term with full pieces, ranges of runs
        are dealt out to several tasks."""
        words = docs.select("id", self._run().alias("run"), retrieval.tokens(F.col("text")).alias("w"))
        pieces = words.mapInArrow(_pieces(self.block, self.runs), f"term string, n int, low_run int, ids array<{self.id_type}>, tfs array<int>, dls array<int>, at array<int>").withColumn("bucket", _bucket(F.col("term"), self.buckets))
        n, held = int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.store._path(f".pieces-{uuid.uuid4().hex}")
        often = F.when(F.col("n") == self.block, F.floor(F.col("low_run") * 16 / self.runs))
        share = F.pmod(F.xxhash64("term", often), F.lit(-(-4 * n // self.buckets)))
        try:
            pieces.write.partitionBy("bucket").option("compression", "zstd").parquet(held.toString())
            slices = min(self.buckets, max(1, -(-self.store._fs().getContentSummary(held).getLength() // SLICE)))
            kept = self.spark.read.schema(pieces.schema).parquet(held.toString())
            for i in range(slices):
                some = kept.where(F.col("bucket").isin([x for x in range(self.buckets) if x % slices == i]))
                laid = some.repartition(n, "bucket", share).sortWithinPartitions("bucket", "term", "low_run")
                name = self.store._write(laid.mapInArrow(_blocks_of_pieces(self.block, self.runs, segment), block_schema(self.id_type)), name)
        finally:
            self.store._fs().delete(held, True)
        return name

    def _blocks(self, postings: DataFrame) -> DataFrame:
        """term, id, tf, dl, segment -> blocks. One sort by ranges of (bucket, term, run, weight): a frequent term is split between
        tasks, and each task packs what stands in a row. Blocks end where a task ends."""
        weight = F.col("tf") / (F.col("tf") + F.col("dl") / F.lit(200.0) + 1)  # an order only: any is right
        laid = postings.select(_bucket(F.col("term"), self.buckets).alias("bucket"), "term", F.col("segment").cast("long").alias("segment"), self._run().alias("run"), weight.alias("weight"), "id", "tf", "dl")
        order = ["bucket", "term", "segment", "run", F.col("weight").desc(), "id"]
        laid = laid.repartitionByRange(int(self.spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
        return laid.drop("weight").mapInArrow(_packed(self.block), block_schema(self.id_type))

    def _run(self):
        return F.pmod(F.xxhash64("id"), F.lit(self.runs)).cast("int")

    def compact(self) -> None:
        """All segments in one, without what is gone."""

        def step(at: dict | None) -> None:
            if at is None or len(at["dirs"]) < 2:
                return
            rows = self._present(self.store._rows(at).where(F.col("term") != GONE), self._gone(self.store._rows(at)))
            postings = rows.select("term", "id", "tf", "dl", F.lit(at["version"] + 1).cast("long").alias("segment"))
            self.store._commit(at, [self.store._write(self._blocks(postings))])

        self.store._again(step)

    # ---- reading
    @staticmethod
    def _postings(blocks: DataFrame) -> DataFrame:
        return blocks.select("*", F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("tfs").alias("tf"), F.col("dls").alias("dl")))).drop("ids", "tfs", "dls")

    def _only(self, rows: DataFrame, term: str) -> DataFrame:
        return rows.where((F.col("bucket") == F.lit(self._bucket_of(term))) & (F.col("term") == term))

    def _bucket_of(self, *terms: str):
        rows = self.spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term"), self.buckets).alias("bucket")).collect()
        return rows[0]["bucket"] if len(rows) == 1 else sorted({r["bucket"] for r in rows})

    def _gone(self, rows: DataFrame) -> DataFrame:
        """id, segment, dl of the entries that a later segment replaced or removed."""
        return self._postings(self._only(rows, GONE)).select("id", "segment", "dl")

    def _present(self, blocks: DataFrame, gone: DataFrame) -> DataFrame:
        return self._postings(blocks).join(gone.select("id", "segment"), ["id", "segment"], "left_anti")

    def _sizes(self, rows: DataFrame) -> DataFrame:
        """id, dl, segment of the documents that are there."""
        return self._present(self._only(rows, ""), self._gone(rows)).select("id", "dl", "segment")

    def stats(self) -> DataFrame:
        """n and avgdl: one row, from heads of blocks."""
        rows = self.store.read()
        there = self._only(rows, "").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
        gone = self._only(rows, GONE).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("less"), F.coalesce(F.sum("size"), F.lit(0)).alias("smaller"))
        return there.crossJoin(gone).select((F.coalesce("n", F.lit(0)) - F.col("less")).alias("n"), ((F.col("size") - F.col("smaller")) / (F.col("n") - F.col("less"))).alias("avgdl"))

    def blocks_of(self, queries: DataFrame) -> DataFrame:
        """qi and the blocks of the words of each query (qi, query)."""
        asked = queries.select("qi", F.explode(F.array_distinct(retrieval.tokens(F.col("query")))).alias("term"))
        rows = self.store.read()
        named = [r["term"] for r in asked.select("term").distinct().limit(FEW_TERMS + 1).collect()]
        if not named:
            return rows.where("false").join(asked, "term")
        few = len(named) <= FEW_TERMS
        if few:
            buckets = self._bucket_of(*named)
            rows = rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(named))
        return rows.join(F.broadcast(asked) if few else asked.hint("merge"), "term")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """The k best documents for each query (qi, query): qi, id, score (6 places) and rank, as ``retrieval.bm25`` has them."""
        rows = self.store.read()
        gone = self._gone(rows)
        changed = not gone.isEmpty()
        blocks = self.blocks_of(queries)
        heads = blocks.select("qi", "term", "segment", "block", "n", "top_tf", "low_dl", "low_run", "high_run")
        stats = F.broadcast(self.stats())  # one row
        if changed:
            # what is gone is counted in heads: then frequencies are counted from the postings that are there
            there = self._postings(blocks.drop("n")).join(gone.select("id", "segment"), ["id", "segment"], "left_anti")
            freq = there.groupBy("qi", "term").agg(F.count("*").alias("df"))
        else:
            freq = heads.groupBy("qi", "term").agg(F.sum("n").alias("df"))
        freq = freq.crossJoin(stats).select("qi", "term", "avgdl", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
        k1, b = self.k1, self.b
        gain = lambda tf, dl: F.col("idf") * F.col(tf) * (k1 + 1) / (F.col(tf) + k1 * (1 - b + b * F.col(dl) / F.col("avgdl")))
        bounded = heads.join(freq, ["qi", "term"]).select("qi", "term", "segment", "block", "low_run", "high_run", gain("top_tf", "low_dl").alias("most"))
        block = ["qi", "term", "segment", "block"]

        def gains(some: DataFrame) -> DataFrame:
            postings = self._postings(blocks.join(some.select(*block), block, "left_semi").select("qi", "term", "segment", "ids", "tfs", "dls"))
            if changed:
                postings = postings.join(gone.select("id", "segment"), ["id", "segment"], "left_anti")
            return postings.join(freq, ["qi", "term"]).select("qi", "id", gain("tf", "dl").alias("gain"))

        # a score that the k-th best reaches
        first = Window.partitionBy("qi", "term").orderBy(F.col("most").desc(), "segment", "block")
        opening = bounded.withColumn("place", F.row_number().over(first)).where("place <= 2")
        partly = gains(opening).groupBy("qi", "id").agg(F.sum("gain").alias("score"))
        floor = retrieval.top_per_query(partly, k, [F.col("score").desc(), F.col("id")]).groupBy("qi").agg(F.count("*").alias("found"), F.min("score").alias("low"))
        floor = floor.select("qi", (F.when(F.col("found") >= k, F.col("low")).otherwise(0.0) - SLACK).alias("floor"))
        # terms from the weakest on, as long as they do not reach it together
        best = bounded.groupBy("qi", "term").agg(F.max("most").alias("best")).join(floor, "qi")
        weakest = Window.partitionBy("qi").orderBy("best", "term")  # the terms of one question
        best = best.withColumn("essential", F.sum("best").over(weakest) >= F.col("floor"))
        whole = Window.partitionBy("qi")
        best = best.withColumn("total", F.sum("best").over(whole)).withColumn("rest", F.coalesce(F.sum(F.when(~F.col("essential"), F.col("best"))).over(whole), F.lit(0.0)))
        worth = bounded.join(best, ["qi", "term"])
        found = gains(worth.where("essential AND most + total - best >= floor")).groupBy("qi", "id").agg(F.sum("gain").alias("part"))
        found = found.join(best.select("qi", "rest", "floor").distinct(), "qi").where("part + rest >= floor").select("qi", "id", "part")
        tops = found.groupBy("qi", self._run().alias("run")).agg(F.max("part").alias("part")).groupBy("qi").agg(F.collect_list(F.struct("run", "part")).alias("tops"))  # a row for each run
        other = worth.where("NOT essential").join(tops, "qi").where("exists(tops, t -> t.run BETWEEN low_run AND high_run AND t.part + most + rest - best >= floor)")
        more = gains(other).join(found.select("qi", "id"), ["qi", "id"], "left_semi")
        scored = found.withColumnRenamed("part", "gain").unionByName(more).groupBy("qi", "id").agg(F.round(F.sum("gain"), 6).alias("score"))
        self.read_blocks = (worth.where("essential AND most + total - best >= floor").select(*block), other.select(*block))
        return retrieval.top_per_query(scored, k, [F.col("score").desc(), F.col("id")])
