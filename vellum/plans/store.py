"""A table of Parquet snapshots: every commit writes a new snapshot and then publishes a version, so readers see whole commits.

A version is a file of its own and never changes: the table is what the largest version says. A writer claims the next
number by creating a file that must not exist, and publishes by a rename; of two writers from one version one gets
``Conflict``, and the operations here start again from what the other left. A writer that dies leaves files nobody
reads. Files are reached through Spark's file system layer only, so the table may live in any store Spark reads.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
COMPACT_FILES = 64
MERGE = 8  # folders of one level that become one of the next
MIN_RETAIN_S = 600


class DimMismatch(RuntimeError):
    """Vectors have another width than the index was made with."""


class Conflict(RuntimeError):
    """Another writer has published, or is about to publish, the version this one began to write."""


class Snapshots:
    """Any number of readers and writers; a read resolves the version once."""

    CLAIM_S, TRIES = 600, 8  # a claim of that age without a version is a dead writer's; how often an operation starts again

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # ---- files
    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self._conf)

    def _read_text(self, name: str) -> str | None:
        fs, path = self._fs(), self._path(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _create(self, path, text: str) -> None:
        stream = self._fs().create(path, False)  # fails where the file is there already
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def _numbers(self) -> dict[str, set[int]]:
        """The numbers of the files _v<number>.<kind> by kind (json, claim). The names come as one text: a table of very many
        versions is listed without a call for each."""
        fs, top, out = self._fs(), self._path(), {"json": set(), "claim": set()}
        if fs.exists(top):
            names = self._jvm.scala.runtime.ScalaRunTime.stringOf(self._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(fs.globStatus(self._path("_v*"))))
            for number, kind in re.findall(r"/_v(\d+)\.(json|claim)(?=[,)])", names):
                out[kind].add(int(number))
        return out

    def _claimed(self, version: int) -> float:
        """When a claim was made (seconds)."""
        return self._fs().getFileStatus(self._path(f"_v{version}.claim")).getModificationTime() / 1000

    # ---- snapshots
    def pointer(self) -> dict | None:
        while versions := self._numbers()["json"]:
            text = self._read_text(f"_v{max(versions)}.json")
            if text is not None:  # else it went between listing and reading: a newer one is there
                return json.loads(text)
        return None

    def read(self) -> DataFrame:
        return self._rows(self.pointer())

    def _rows(self, at: dict | None) -> DataFrame:
        if at is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{d}" for d in at["dirs"]])

    def _commit(self, was: dict | None, dirs: list[str], meta: dict | None = None) -> None:
        """Publish the version after ``was``, the version the writer began from."""
        fs, version = self._fs(), (was["version"] if was else 0) + 1
        there = self._numbers()
        claims, published = there["claim"], there["json"]
        if any(v >= version for v in published):
            raise Conflict(f"version {version} of {self.root} is there already")
        while version in claims and time.time() - self._claimed(version) > self.CLAIM_S:
            version += 1  # its writer died before it published
        text = json.dumps({"version": version, "dirs": dirs, "meta": {**(was["meta"] if was else {}), **(meta or {})}, "at": time.time()})
        temp = self._path(f".v{version}-{uuid.uuid4().hex}")
        self._create(temp, text)
        try:
            self._create(self._path(f"_v{version}.claim"), "")
        except Exception as e:  # py4j wraps what the file system throws
            fs.delete(temp, False)
            raise Conflict(f"another writer is at version {version} of {self.root}") from e
        if any(v >= version for v in self._numbers()["json"]) or not fs.rename(temp, self._path(f"_v{version}.json")):
            raise Conflict(f"version {version} of {self.root} was overtaken")

    def _again(self, step: Callable[[dict | None], T]) -> T:
        """Run ``step`` from the current version; where another writer was faster, from what it left."""
        for turn in range(self.TRIES):
            try:
                return step(self.pointer())
            except Conflict:
                if turn == self.TRIES - 1:
                    raise
                time.sleep(0.05 * 2**turn)
        raise AssertionError

    def _write(self, rows: DataFrame, level: int = 0) -> str:
        name = f"part-{time.time_ns()}-{uuid.uuid4().hex[:8]}" + (f"-l{level}" if level else "")
        rows.write.parquet(f"{self.root}/{name}")
        return name

    def overwrite(self, rows: DataFrame, meta: dict | None = None) -> None:
        """The rows are all there is from now on, whatever other writers left."""
        name = self._write(rows)
        self._again(lambda at: self._commit(at, [name], meta))

    def append(self, rows: DataFrame) -> None:
        name = self._write(rows)
        self._again(lambda at: self._commit(at, [*(at["dirs"] if at else []), name]))

    def merge(self) -> None:
        """For tables of very many appends: MERGE folders of one level become one of the next, so folders stay few and a row
        is rewritten once for each level."""
        level = 0
        while self._again(lambda at, level=level: self._merged(at, level)):
            level += 1

    def _merged(self, at: dict | None, level: int) -> bool:
        named = lambda d: int(d.rpartition("-l")[2]) if "-l" in d else 0
        some = [d for d in (at["dirs"] if at else []) if named(d) == level][:MERGE]
        if len(some) < MERGE:
            return False
        rows = self._rows({"dirs": some}).coalesce(MERGE**level)
        self._commit(at, [*(d for d in at["dirs"] if d not in some), self._write(rows, level + 1)])
        return True

    def replace_scope(self, new: DataFrame, scope: DataFrame, on: str) -> None:
        """Within the scope (column ``on``) the new rows are all there is; rows outside stay. One commit."""
        keys = scope.select(on).distinct()

        def step(at: dict | None) -> None:
            base = self._rows(at)
            self._commit(at, [self._write(base.join(keys, on, "left_anti").select(base.columns).unionByName(new.select(base.columns)))])

        self._again(step)

    def delete(self, keys: DataFrame, on: str) -> int:
        """Rows whose key is listed go; nothing is written if there are none. Returns how many went."""
        keys = keys.select(on).distinct()

        def step(at: dict | None) -> int:
            base = self._rows(at)
            n = base.join(keys, on, "left_semi").count()
            if n:
                self._commit(at, [self._write(base.join(keys, on, "left_anti").select(base.columns))])
            return n

        return self._again(step)

    def rescore(self, scores: DataFrame) -> int:
        """New quality (note_id, quality) where it differs, kept within 0 and 100. Returns how many notes changed."""

        def step(at: dict | None) -> int:
            base = self._rows(at)
            rows = rescored(base, scores)
            changed = rows.where("changed").select("note_id").distinct().count()
            if changed:
                self._commit(at, [self._write(rows.drop("changed").select(base.columns))])
            return changed

        return self._again(step)

    def optimize(self, *, force: bool = False, retain_s: float = 3600) -> dict:
        """Small files into few, old snapshots away (not younger than ten minutes)."""

        def step(at: dict | None) -> dict:
            files = len(self._rows(at).inputFiles()) if at else 0
            compacted = bool(files > COMPACT_FILES or force and files > 1)
            if compacted:
                self._commit(at, [self._write(self._rows(at).repartition(max(1, files // COMPACT_FILES), "id"))])
            return {"files": files, "compacted": compacted}

        return {**self._again(step), "removed": self.vacuum(retain_s)}

    def vacuum(self, retain_s: float = 3600) -> int:
        fs, at = self._fs(), self.pointer()
        if at is None:
            return 0
        old = time.time() - max(MIN_RETAIN_S, retain_s)
        current = f"_v{at['version']}."
        gone = []
        for s in fs.listStatus(self._path()):
            name = s.getPath().getName()
            if s.getModificationTime() / 1000 < old and not name.startswith(current) and (name.startswith("part-") and name not in at["dirs"] or name.startswith(("_v", ".v"))):
                gone.append(s.getPath())
        for path in gone:
            fs.delete(path, True)
        return sum(p.getName().startswith("part-") for p in gone)

    def drop(self) -> None:
        self._fs().delete(self._path(), True)

    # ---- what the index was made with
    def stale_reason(self, *, chunker: str, model: str, dim: int) -> str | None:
        meta = (self.pointer() or {}).get("meta") or {}
        if not meta:
            return "the index carries no stamp"
        for name, want in (("dim", dim), ("model", model), ("chunker", chunker)):
            if meta.get(name) != want:
                return f"{name} is {meta.get(name)!r}, not {want!r}"
        return None

    def check_dim(self, dim: int) -> None:
        have = ((self.pointer() or {}).get("meta") or {}).get("dim")
        if have is not None and have != dim:
            raise DimMismatch(f"the index has vectors of {have}, the embedder makes {dim}")

    def info(self) -> dict:
        rows = self.read()
        at = self.pointer() or {"version": 0}
        return {"rows": rows.count(), "files": len(rows.inputFiles()) if at["version"] else 0, "version": at["version"]}


def rescored(base: DataFrame, scores: DataFrame) -> DataFrame:
    new = scores.groupBy("note_id").agg(F.greatest(F.lit(0), F.least(F.lit(100), F.max("quality"))).cast("int").alias("new_quality"))
    j = base.join(new, "note_id", "left")
    return j.withColumn("changed", F.coalesce(F.col("new_quality") != F.col("quality"), F.lit(False))).withColumn("quality", F.coalesce("new_quality", "quality")).drop("new_quality")


def last_copies(rows: DataFrame) -> DataFrame:
    """Of a batch (seq, note_id, path, chunk_index) that holds a file twice, the last copy whole. A new copy begins where a
    chunk index comes again."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("note_id", "path", "chunk_index").orderBy("seq"))
    file = Window.partitionBy("note_id", "path")
    numbered = rows.withColumn("_n", nth).withColumn("_copy", F.max("_n").over(file.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.withColumn("_last", F.max("_copy").over(file)).where("_copy = _last").drop("_n", "_copy", "_last")
