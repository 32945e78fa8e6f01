"""Shared pieces of the training-data operators: the shared folder, word hashing and batch slicing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
BASE_A = 0x9E3779B97F4A7C15
BASE_B = 0xC2B2AE3D27D4EB4F


def shared_dir(spark: SparkSession) -> str:
    """The folder every node can reach: spark.checkpoint.dir. Where that is unset and all runs in one process, a folder of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="vellum-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_within: ContextVar[str] = ContextVar("within", default="")


@contextmanager
def tables_within(spark: SparkSession) -> Iterator[None]:
    """Tables that operators write in this block go when it ends: what they returned must have been written by then."""
    name = f"tables-{uuid.uuid4().hex}"
    token = _within.set(f"{name}/")
    try:
        yield
    finally:
        _within.reset(token)
        remove(spark, f"{shared_dir(spark)}/{name}")


def remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back. Its shuffle files go as soon as the table is there (until then a lost
    executor's share can be made again), not when the driver next collects garbage."""
    spark = df.sparkSession
    before = spark.conf.get(_FREE, "false")
    spark.conf.set(_FREE, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_FREE, before)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there and nothing runs twice. The table stays
    for whoever reads the result; ``tables_within`` removes it where that is known to be over."""
    spark = df.sparkSession
    return _write(df, f"{shared_dir(spark)}/{_within.get()}{tag}-{uuid.uuid4().hex}")


class Workspace:
    """Tables an operator writes on its way, in a folder of the shared one that goes when the work is done.

    What an operator returns must not read from it: its last table is written by ``materialize``.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop()

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        return _write(df, f"{self.path}/{name}-{uuid.uuid4().hex[:8]}")

    def drop(self, df: DataFrame | None = None) -> None:
        """Remove the folder, or the files of one table that nothing reads any more."""
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()} if df is not None else {self.path}:
            remove(self.spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_chunks(batches: Iterable[pa.RecordBatch], column: str = "text", max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``max_bytes`` of text each (a longer text has a slice of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64).cumsum()
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, base + max_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop


class WordHashes(dict):
    """bytes -> 64-bit hash, kept for words seen before; ``trim`` bounds what is kept."""

    limit = 150_000

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()


def flat_words(texts: list[bytes | None], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs without space, tab, LF, VT, FF, CR) of all texts in a row, and where each text begins."""
    hashes.trim()
    parts, starts, total = [], [0], 0
    get = hashes.__getitem__
    for text in texts:
        if text:
            words = text.split()
            parts.append(np.fromiter(map(get, words), np.uint64, len(words)))
            total += len(words)
        starts.append(total)
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.asarray(starts, np.int64)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (at least)."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        have = _powers[base] = (both[0], both[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def prefix_sums(flat: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(flat * powers(base, max(1, len(flat)))[0][: len(flat)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, base: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Polynomial hashes of flat[start:stop] (equal content, equal hash, wherever it stands)."""
    inverse = powers(base, len(sums))[1]
    return mix((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64))


def gram_hashes(flat: np.ndarray, k: int, base: int = BASE_A) -> np.ndarray:
    """Hashes of every k consecutive values."""
    n = len(flat) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sums = prefix_sums(flat, base)
    return mix((sums[k:] - sums[:-k]) * powers(base, len(sums))[1][:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum over every ``width`` consecutive values."""
    if len(x) < width:
        return x[:0]
    have, size = x, 1
    while size * 2 <= width:
        have, size = np.minimum(have[:-size], have[size:]), size * 2
    if size < width:
        have = np.minimum(have[: len(have) - (width - size)], have[width - size :])
    return have


def free_name(name: str, taken: Iterable[str]) -> str:
    """The name of a carried column: its own, or with ``_in`` behind it where an operator's column has that name."""
    return f"{name}_in" if name.lower() in {t.lower() for t in taken} else name


def id_and_text(docs: DataFrame, id_col: str, text_col: str, carry: Iterable[str] = ()) -> DataFrame:
    """Only what an operator needs, under fixed names: doc_id, text as bytes, and carried columns."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), *carry)


class Sieve:
    """A Bloom filter of numbers: bounded in size (MOST bits), so that it may be sent to every task. It lets every member
    pass, and others the more often the more members share its bits; what passes is joined exactly afterwards."""

    MOST = 1 << 27

    def __init__(self, numbers: DataFrame):
        """numbers: one long column, read twice (a kept table)."""
        n, column = numbers.count(), numbers.columns[0]
        size = self.size = min(self.MOST, 1 << max(16, (16 * n).bit_length()))

        def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.zeros(size, bool)
            for batch in batches:
                for place in Sieve.places(batch.column(0).to_numpy(zero_copy_only=False), size):
                    found[place] = True
            yield pa.record_batch([pa.array([np.packbits(found, bitorder="little").tobytes()])], names=["flags"])

        self.bits = np.zeros(size // 8, np.uint8)
        for row in numbers.where(F.col(column).isNotNull()).coalesce(8).mapInArrow(flags, "flags binary").toLocalIterator():
            self.bits |= np.frombuffer(row["flags"], np.uint8)

    @staticmethod
    def places(numbers: np.ndarray, size: int) -> list[np.ndarray]:
        hashed = mix(numbers.astype(np.int64).view(np.uint64) ^ np.uint64(BASE_B))
        return [((hashed >> np.uint64(k)) & np.uint64(size - 1)).astype(np.int64) for k in (0, 18, 36)]

    def passes(self, numbers: np.ndarray) -> np.ndarray:
        ok = np.ones(len(numbers), bool)
        for place in self.places(numbers, self.size):
            ok &= (self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
        return ok

    def ok(self, batch: pa.RecordBatch, column: str = "doc_id") -> np.ndarray:
        values = batch.column(column)
        return self.passes(pc.fill_null(values, 0).to_numpy(zero_copy_only=False)) & pc.is_valid(values).to_numpy(zero_copy_only=False)

    def others(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """The rows whose doc_id does not pass."""
        return batch.filter(pa.array(~self.ok(batch)))


def sifted(rows: DataFrame, sieve: Sieve, column: str = "doc_id") -> DataFrame:
    """The rows whose ``column`` passes the sieve. Null passes never."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sieve.ok(batch, column)))

    return rows.mapInArrow(each, rows.schema)


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose id is not among those of ``gone`` (one long column of the same name; read several times). Only rows that a
    bounded filter of these ids lets pass are shuffled, the others stay where they are. A null id is none of them."""
    sieve, column = Sieve(gone), gone.columns[0]

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~sieve.ok(batch, column)))

    return rows.mapInArrow(others, rows.schema).unionByName(sifted(rows, sieve, column).join(gone.hint("merge"), column, "left_anti").select(rows.columns))


def connected_components(edges: DataFrame, work: Workspace) -> DataFrame:
    """Smallest node reachable from each node of ``edges`` (a long, b long): columns node, component.

    Large-star and small-star in turn, written to the workspace each round, until the edges no longer change: the labels
    of some nodes fall each round, so there is an end. Every round sends each edge to its nodes' smallest neighbours by
    joins and sums over keys, so no group is ever gathered.
    """
    cur = work.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        # large-star: strictly larger neighbours of u point at the smallest of u and its neighbours
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("mb"))
        low = low.select("a", F.least("a", "mb").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small-star: smaller neighbours of u, and u itself, point at the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        nxt = work.keep(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        seen = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        work.drop(cur)
        cur = nxt
        if before == seen:
            break
        before = seen
    nodes = cur.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = cur.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return nodes.unionByName(roots.join(nodes.select("node"), "node", "left_anti"))
