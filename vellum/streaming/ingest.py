"""Ingest of landed pages in micro-batches: rows are saved flush by flush, so what a failing source gave before it failed stays.

A batch is cut into flushes of a fixed number of rows in order of arrival. A commit says up to which flush of which batch it goes.
Flushes of a batch are first tried together (up to TOGETHER rows), as one commit; where that fails each is a commit of its own, so that those before
the fault stay. A batch that comes again after a failure begins behind the last flush that was saved, whatever had been handed
out before. Within a run an id is saved once: later rows that repeat it are passed over.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.store import Snapshots

FLUSH = 200
TOGETHER = 100_000  # rows whose flushes are tried as one commit


def landed_pages(spark: SparkSession, path: str, item: str, *, items: str = "items", max_files: int = 50) -> DataFrame:
    """A stream of (page, position, item) from landed JSON answers; ``item`` is the schema of one item."""
    files = spark.readStream.option("wholetext", "true").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).text(path)
    answer = F.from_json("value", f"struct<`{items}`: array<{item}>>")[items]
    return files.select(F.col("_metadata.file_path").alias("page"), F.posexplode(answer).alias("position", "item"))


def numbered(batch: DataFrame) -> tuple[DataFrame, int]:
    """Adds ``n``, the row's number in the batch, page by page, and says how many numbers there are. Pages of one batch are few
    (maxFilesPerTrigger): their sizes are added up at the driver, rows are not moved."""
    spark, total, before = batch.sparkSession, 0, []
    for page, rows in sorted((r["page"], r["rows"]) for r in batch.groupBy("page").agg((F.max("position") + 1).alias("rows")).collect()):
        before.append((page, total))
        total += rows
    return batch.join(F.broadcast(spark.createDataFrame(before, "page string, before long")), "page").withColumn("n", F.col("before") + F.col("position")).drop("before"), total


class Ingest:
    """``to_rows``: rows (page, position, item, n) to rows of the store; it may raise. ``key``: the store's id column."""

    def __init__(self, store: Snapshots, run: str, to_rows: Callable[[DataFrame], DataFrame], *, key: str = "id", flush: int = FLUSH):
        self.store, self.run, self.to_rows, self.key, self.flush = store, f"ingest:{run}", to_rows, key, flush

    def _done(self, at: dict | None) -> list[int]:
        return (at["meta"] if at else {}).get(self.run, [-1, -1])

    def batch(self, rows: DataFrame, number: int) -> None:
        rows, ordered = rows.persist(), None
        try:
            ordered, total = numbered(rows)
            ordered = ordered.orderBy("n").persist()  # a batch, in order of arrival
            at, last = self._done(self.store.pointer()), -(-total // self.flush) - 1
            flushes = list(range(at[1] + 1 if at[0] == number else 0, last + 1))
            part = lambda first, end: ordered.where(F.col("n").between(first * self.flush, (end + 1) * self.flush - 1))
            while flushes:
                some = flushes[: max(1, TOGETHER // self.flush)]
                try:
                    self._save(part(some[0], some[-1]), [number, some[-1]])
                except Exception as e:
                    if len(some) == 1:
                        raise
                    warnings.warn(f"batch {number} is saved flush by flush ({str(e)[:200] or type(e).__name__})", RuntimeWarning, stacklevel=2)
                    for flush in some:
                        self._save(part(flush, flush), [number, flush])
                flushes = flushes[len(some) :]
        finally:
            rows.unpersist()
            if ordered is not None:
                ordered.unpersist()

    def _save(self, part: DataFrame, turn: list[int]) -> None:
        def step(at: dict | None) -> None:
            if self._done(at) >= turn:
                return
            made = self.to_rows(part)
            first = made.withColumn("_n", F.monotonically_increasing_id()).groupBy(self.key).agg(F.min_by(F.struct(*made.columns), "_n").alias("r")).select("r.*").persist()
            try:
                new = first
                if at is not None:  # the ids of a save (TOGETHER at most) go to the table's rows, which stay where they are
                    known = self.store._rows(at).select(self.key).join(F.broadcast(first.select(self.key)), self.key, "left_semi")
                    new = first.join(F.broadcast(known), self.key, "left_anti").select(*made.columns)
                self.store._commit(at, [*(at["dirs"] if at else []), self.store._write(new)], {self.run: turn})
            finally:
                first.unpersist()

        self.store._again(step)
        self.store.merge()

    def start(self, source: DataFrame, checkpoint: str) -> StreamingQuery:
        return source.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
