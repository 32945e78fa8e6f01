"""Incremental reindex: one diff of files and index, only what changed is cut and embedded, one commit.

A run lists the files, compares their times with the index, reads and cuts what is new or changed, and looks at the files
once more before it commits: a file that changed or went while it was read keeps its old rows, and since its time in the index
is still the old one, the next run finds it again. A file changed so shortly before the listing that a later write could carry
the same time (SETTLE_S) is indexed without a time, so that it is read again too. The scope of the commit is paths, never ids: twins
in two files do not erase each other. Rows of files that are gone go in the same commit, unless so many are gone that the
folder cannot be all there; rows of an id that was rewritten under another path go with their old path even then.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.reports import index_diff, reap_allowed
from ..schema import CHUNK
from ..session import Settings, scratch
from ..sources import notes as note_files
from . import search
from .keyword_index import KeywordIndex
from .store import Snapshots

SETTLE_S = 2.0
LISTED = 10_000  # so many changed files are named to the reader; of more, all files are read and the others left out


@dataclass(frozen=True)
class Reindexed:
    """Files by what became of them."""

    unchanged: int = 0
    indexed: int = 0
    removed: int = 0
    requeued: int = 0
    skipped: int = 0
    spared: int = 0  # gone, but too many to believe it
    deferred: int = 0  # changed, but more than this run takes on


class Reindex:
    """``files``: path and mtime of every file, looked at anew on each call. ``read``: notes (path, mtime, error, ...) of listed
    paths. ``rows``: notes to rows of the store (path, mtime, note_id, ...). ``work``: a folder that every node reaches, for what is
    listed and cut once. ``words``: a keyword index that follows the store (id, search_text)."""

    def __init__(self, spark: SparkSession, store: Snapshots, work: str, *, files: Callable[[], DataFrame], read: Callable[[DataFrame], DataFrame], rows: Callable[[DataFrame], DataFrame], words: KeywordIndex | None = None):
        self.spark, self.store, self.work, self.files, self.read, self.rows, self.words = spark, store, work.rstrip("/"), files, read, rows, words

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        import uuid

        path = f"{self.work}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def run(self, *, only: DataFrame | None = None, now: float | None = None, defer_over: int | None = None, force: bool = False) -> Reindexed:
        """One pass. ``only``: paths to look at (files that are gone are then not looked for); ``defer_over``: leave larger change
        sets to another run; ``force``: read every file again."""
        import time

        seen_at = time.time() if now is None else now
        within = (lambda df: df.join(only.select("path").distinct(), "path", "left_semi")) if only is not None else lambda df: df
        listing = self._keep(within(self.files().select("path", "mtime")), "listing")
        held = within(self.store.read().select("path", "mtime", "note_id"))
        diff = self._keep(index_diff(listing, held), "diff")
        if force:
            diff = diff.withColumn("status", F.when(F.col("status") == "unchanged", "todo").otherwise(F.col("status")))
        n = {r["status"]: r["count"] for r in diff.groupBy("status").count().collect()}
        todo, missing = n.get("todo", 0), n.get("missing", 0) if only is None else 0
        if defer_over is not None and todo + missing > defer_over:
            return Reindexed(unchanged=n.get("unchanged", 0), deferred=todo + missing)
        reap = reap_allowed(missing, todo + n.get("unchanged", 0))
        paths = diff.where("status = 'todo'").select("path")
        if todo:  # files are read once: what is cut is what the second look is held against
            usable = self._keep(self.read(paths), "notes").where("error IS NULL")
            cut = self._keep(self.rows(usable), "rows")
            usable = usable.select("path", F.col("id").alias("note_id"))

        gone = diff.where("status = 'missing'").select("path") if missing else None
        scope, new, done, again = (gone if reap else None), None, 0, 0
        if todo:
            # a second look: only what is still as it was listed is committed
            before = listing.join(paths, "path", "left_semi")
            still = self._keep(before.join(self.files().select("path", F.col("mtime").alias("later")), "path").where("mtime = later").select("path", "mtime"), "still")
            agreed = usable.join(still, "path", "left_semi")
            done, again = agreed.count(), todo - still.count()
            young = still.where(F.col("mtime") > seen_at - SETTLE_S).select("path", F.lit(True).alias("young"))
            new = cut.join(agreed.select("path"), "path", "left_semi").join(young, "path", "left").withColumn("mtime", F.when(F.col("young").isNull(), F.col("mtime"))).drop("young")
            scope = agreed.select("path") if scope is None else scope.unionByName(agreed.select("path"))
            if gone is not None and not reap:
                moved = held.join(gone, "path", "left_semi").join(agreed.select("note_id"), "note_id", "left_semi").select("path").distinct()
                scope = scope.unionByName(moved)
        if scope is not None and (done or missing):
            self._commit(self._keep(scope.distinct(), "scope"), new)
        return Reindexed(n.get("unchanged", 0), done, missing if reap else 0, again, todo - done - again, 0 if reap else missing)

    def _commit(self, scope: DataFrame, new: DataFrame | None) -> None:
        empty = self.spark.createDataFrame([], self.store.schema)
        old = None
        if self.words is not None:
            old = self._keep(self.store.read().join(scope, "path", "left_semi").select("id"), "old")
        self.store.replace_scope(empty if new is None else new, scope, "path")
        if self.words is not None:  # it follows the store; a run that ends here is made good by ``rebuild_words``
            now_there = empty.select("id", "search_text") if new is None else new.select("id", "search_text")
            self.words.remove(old.join(now_there.select("id"), "id", "left_anti"))
            self.words.add(now_there)

    def rebuild_words(self) -> None:
        """Bring the keyword index to what the store holds: chunks that are gone go, chunks it lacks come."""
        have, there = self.words._sizes(self.words.store.read()).select("id"), self.store.read().select("id", "search_text")
        self.words.remove(have.join(there.select("id"), "id", "left_anti"))
        self.words.add(there.join(have, "id", "left_anti"))

    def on_stream(self, changes: DataFrame, checkpoint: str, *, defer_over: int | None = None, told: Callable[[Reindexed], None] | None = None) -> StreamingQuery:
        """Run for the paths of each micro-batch of ``changes`` (path). A batch that comes again finds its files unchanged."""

        def batch(paths: DataFrame, number: int) -> None:
            done = self.run(only=paths, defer_over=defer_over)
            if told is not None:
                told(done)

        return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def of_vault(spark: SparkSession, root: str, index: str, *, embed: search.Embedder = search.hashed_words, settings: Settings = Settings()) -> Reindex:
    """The reindex of a folder of note files into ``index``/chunks and ``index``/words. Chunker, model and width are stamped: an
    index that was made otherwise must be made anew (``run(force=True)`` after ``store.drop()``)."""
    from pyspark.errors import AnalysisException

    walk = lambda only=None: note_files.walk(spark, root, settings.ignore_dirs, only)

    def read(paths: DataFrame) -> DataFrame:
        named = [r["path"] for r in paths.limit(LISTED + 1).collect()]
        if len(named) <= LISTED:
            try:
                return note_files.parse(walk(named))
            except AnalysisException:  # one of them went meanwhile: the second look will tell
                pass
        return note_files.parse(walk().join(paths, "path", "left_semi"))

    store, words = Snapshots(spark, f"{index.rstrip('/')}/chunks", CHUNK), KeywordIndex(spark, f"{index.rstrip('/')}/words")
    store.check_dim(settings.dim)
    return Reindex(spark, store, scratch(spark), files=lambda: walk().select("path", "mtime"), read=read, rows=lambda n: search.index_rows(n, embed, settings), words=words)
