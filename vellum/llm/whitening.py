"""Operator 13, embedding whitening by an exact integer scatter.

Entries become longs, x = floor(64 c) + 1000000. The fit takes y = x - shift and adds up, in whole numbers without a limit, the
sums S_i of the dimensions and the products P_ij of every two of them. n P - S S^T does not depend on the shift and is n^2
times the covariance, exactly; only then it becomes floating point (each entry divided once, rounded once) and is taken apart
by eigh. So the fit does not depend on how rows are dealt out or in which order they are added.

How the sums stay exact. Inside a task a block of rows is written in digits of DIGIT bits; a product of two digits, added over
a block, stays below 2^53, so a floating-point matrix product of digits is exact. A task adds its blocks up as Python integers
and sends each cell as digits to the base 2^32 in longs, which Spark sums (partial sums first) without overflow. What reaches the
driver is d (d + 1) / 2 + d cells, whatever the number of rows.

Rows. A vector that is null, empty, or holds null, NaN or infinite entries is left out, and so is one whose entries leave the
range of longs when scaled. All vectors of a fit have one length: the commonest among the rest (of equally common ones the
smallest); vectors of other lengths are not of that space and are left out as well. Repeated rows count each time, a null id is
kept, other columns are ignored. Without vectors the result is empty. A direction in which the vectors do not vary (eigenvalue
below d * 2^-52 of the largest) has no whitened values: they are null there, and identity_error is over the other components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import free_name, materialize, table

SCALE, OFFSET = 64, 1_000_000
DIGIT = 20  # 2 * 20 bits and 2^13 rows: below 2^53
BLOCK = 1 << 13
LIMB = 32
MOST_DIM = 8192  # the driver decomposes a matrix of this width at most


def finite_rows(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that are whole vectors of ``dim`` entries, and their entries as longs."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    right = pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(right)
    if not len(at) or not dim:
        return at[:0], np.empty((0, dim), np.int64)
    values = vectors.take(pa.array(at)).flatten().cast(pa.float64())
    c = pc.fill_null(values, float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(c * SCALE)
    fits = (np.abs(scaled) < 2.0**62).all(axis=1)  # NaN compares as false
    return at[fits], scaled[fits].astype(np.int64) + OFFSET


def digits_of(y: np.ndarray, base: int = DIGIT) -> list[np.ndarray]:
    """y = sum of digit_k * 2^(base k), with digits from -2^(base - 1) to 2^(base - 1)."""
    out, rest, half = [], y, 1 << (base - 1)
    while True:
        low = ((rest + half) & ((1 << base) - 1)) - half
        out.append(low)
        rest = (rest - low) >> base
        if not rest.any():
            return out


class Scatter:
    """Count, sums and products of rows of longs, exact. ``add`` takes blocks of at most BLOCK rows."""

    def __init__(self, dim: int):
        self.n, self.dim = 0, dim
        self.sums = np.zeros(dim, object)
        self.products = np.zeros((dim, dim), object)
        self._near: dict[int, np.ndarray] = {}  # by power of two, what has not been added to the products yet
        self._blocks = 0

    def add(self, y: np.ndarray) -> None:
        parts = [p.astype(np.float64) for p in digits_of(y)]
        self.n += len(y)
        for k, p in enumerate(parts):
            self.sums += p.sum(axis=0).astype(np.int64).astype(object) * (1 << DIGIT * k)
            for m, q in enumerate(parts):
                power = DIGIT * (k + m)
                exact = (p.T @ q).astype(np.int64)
                self._near[power] = self._near.get(power, 0) + exact
        self._blocks += len(parts) ** 2
        if self._blocks > 256:  # 256 sums below 2^53 stay in a long
            self.settle()

    def settle(self) -> None:
        for power, cells in self._near.items():
            self.products += cells.astype(object) * (1 << power)
        self._near, self._blocks = {}, 0

    def cells(self) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """Cells that are not 0, a digit at a time: numbers of cells, the digit's place, and the digits."""
        self.settle()
        rows, columns = np.triu_indices(self.dim)
        flat = np.concatenate([np.array([self.n], object), self.sums, self.products[rows, columns]])
        place = 0
        while (at := np.flatnonzero(flat != 0)).size:
            low = np.array([v & ((1 << LIMB) - 1) for v in flat[at]], object)
            low = np.array([v - (1 << LIMB) if v >> (LIMB - 1) else v for v in low], object)
            yield at, place, low.astype(np.int64)
            rest = np.zeros(len(flat), object)
            rest[at] = (flat[at] - low) // (1 << LIMB)
            flat, place = rest, place + 1


@dataclass
class Whitening:
    """A fit: the exact count, sums and scatter, and what follows from them in floating point."""

    n: int
    dim: int
    shift: int
    sums: list[int]  # of y = x - shift
    scatter: np.ndarray  # n P - S S^T, Python integers
    values: np.ndarray = field(init=False)  # all eigenvalues, falling
    vectors: np.ndarray = field(init=False)  # columns

    def __post_init__(self) -> None:
        square = self.n * self.n
        covariance = np.array([[int(v) / square for v in row] for row in self.scatter], np.float64).reshape(self.dim, self.dim)
        values, vectors = np.linalg.eigh(covariance)
        self.values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
        largest = np.abs(vectors).argmax(axis=0)
        self.vectors = vectors * np.where(vectors[largest, np.arange(self.dim)] < 0, -1.0, 1.0)
        self.trace = sum(int(self.scatter[i, i]) for i in range(self.dim)) / square

    def varying(self) -> np.ndarray:
        return self.values > self.dim * 2.0**-52 * max(self.values[0], 0.0)

    def projection(self, components: int) -> np.ndarray:
        """Columns that take x - S/n to the whitened values; NaN where a component does not vary."""
        k = min(components, self.dim)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.varying()[:k], self.vectors[:, :k] / np.sqrt(self.values[:k]), np.nan)

    def explained(self, components: int) -> np.ndarray:
        k = min(components, self.dim)
        return self.values[:k] / self.trace if self.trace else np.zeros(k)


def common_dim(vectors: DataFrame, vector_col: str) -> int | None:
    """The commonest length among whole vectors."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for batch in batches:
            for d in pc.unique(pc.drop_null(pc.list_value_length(batch.column(0)))).to_pylist():
                found[d] = found.get(d, 0) + len(finite_rows(batch.column(0), d)[0])
        yield pa.record_batch([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["d", "n"])

    best = vectors.select(vector_col).mapInArrow(each, "d long, n long").where("d > 0 AND n > 0").groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "d").first()
    return None if best is None else best["d"]


def fit_whitening(vectors: DataFrame, *, vector_col: str = "embedding", dim: int | None = None, shift: int = OFFSET) -> Whitening | None:
    """The fit over all whole vectors; None where there are none. ``shift`` changes no result (numbers near it add up fastest)."""
    dim = dim or common_dim(vectors, vector_col)
    if dim is None:
        return None
    if dim > MOST_DIM:
        raise ValueError(f"vectors of {dim} entries: at most {MOST_DIM} can be decomposed")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Scatter(dim)
        for batch in batches:
            _, x = finite_rows(batch.column(0), dim)
            for lo in range(0, len(x), BLOCK):
                total.add(x[lo : lo + BLOCK] - shift)
        for cell, place, digit in total.cells():
            yield pa.record_batch([pa.array(cell, pa.int64()), pa.array(np.full(len(cell), place), pa.int32()), pa.array(digit)], names=["cell", "place", "digit"])

    cells = vectors.select(vector_col).mapInArrow(each, "cell long, place int, digit long").groupBy("cell", "place").agg(F.sum("digit").alias("digit"))
    rows, columns = np.triu_indices(dim)
    flat = np.zeros(1 + dim + len(rows), object)
    for row in cells.toLocalIterator():  # d (d + 1) / 2 + d + 1 cells of a few digits
        flat[row["cell"]] += int(row["digit"]) << (LIMB * row["place"])
    n, sums = int(flat[0]), [int(s) for s in flat[1 : 1 + dim]]
    if not n:
        return None
    scatter = np.zeros((dim, dim), object)
    for i, j, p in zip(rows.tolist(), columns.tolist(), flat[1 + dim :], strict=True):
        scatter[i, j] = scatter[j, i] = n * int(p) - sums[i] * sums[j]
    return Whitening(n, dim, shift, sums, scatter)


def centred(y: np.ndarray, fit: Whitening) -> tuple[np.ndarray, list[int]]:
    """(x - S/n) of each row, each entry rounded once, and the exact sum of squares of n x - S."""
    most = fit.n * (max(int(y.max(initial=0)), -int(y.min(initial=0))) + 1) + max(map(abs, fit.sums))
    if most < 1 << 62:
        z = y * fit.n - np.array(fit.sums, np.int64)
        # with two digits of 31 bits each square and product fits; their sums over the dimensions are whole numbers again
        low = z & ((1 << 31) - 1)
        high = (z - low) >> 31
        total = lambda a, b: sum(((a >> s & 0xFFFF) * b).sum(axis=1).astype(object) * (1 << s) for s in (0, 16))
        squares = (total(low, low) + (1 << 32) * total(low, high) + (1 << 62) * total(np.abs(high), np.abs(high))).tolist()
        return z / fit.n if most < 1 << 53 else (z.astype(object) / fit.n).astype(np.float64), squares
    z = y.astype(object) * fit.n - np.array(fit.sums, object)
    return (z / fit.n).astype(np.float64), (z * z).sum(axis=1).tolist()


def whiten(vectors: DataFrame, fit: Whitening, *, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each whole vector: the id, ``deviation`` (decimal text of the sum of (n x - S)^2, exact) and ``whitened``, an
    array of the components by falling eigenvalue (NaN where one does not vary). Rows keep their order; no shuffle."""
    projection = fit.projection(components)
    name = free_name(id_col, ("deviation", "whitened"))
    schema = T.StructType([T.StructField(name, vectors.schema[id_col].dataType), T.StructField("deviation", T.StringType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = finite_rows(batch.column(1), fit.dim)
            for lo in range(0, len(at), BLOCK):
                z, squares = centred(x[lo : lo + BLOCK] - fit.shift, fit)
                w = z @ projection
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1]), pa.int32()), pa.array(w.ravel()))
                yield pa.record_batch([batch.column(0).take(pa.array(at[lo : lo + BLOCK])), pa.array([str(s) for s in squares], pa.string()), lists], names=[name, "deviation", "whitened"])

    return vectors.select(id_col, vector_col).mapInArrow(each, schema)


def _added(whitened: DataFrame, width: int, mean: np.ndarray | None) -> tuple[int, np.ndarray]:
    """Over all rows: their number, and the sums of the components or, with their mean, of the products of centred ones."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width if mean is None else width * width)
        for batch in batches:
            w = batch.column(0).flatten().to_numpy().reshape(-1, width)
            n += len(w)
            total = total + (w.sum(axis=0) if mean is None else ((w - mean).T @ (w - mean)).ravel())
        yield pa.record_batch([pa.array(np.arange(-1, len(total)), pa.int32()), pa.array(np.concatenate([[float(n)], total]))], names=["cell", "part"])

    got = np.zeros(1 + (width if mean is None else width * width))
    for row in whitened.select("whitened").mapInArrow(each, "cell int, part double").groupBy("cell").agg(F.sum("part").alias("part")).toLocalIterator():
        got[row["cell"] + 1] = row["part"]
    return int(got[0]), got[1:]


def identity_error(whitened: DataFrame, width: int) -> float:
    """The largest entry of |covariance - identity| of the whitened components that vary: two passes, the mean first."""
    if not width:
        return 0.0
    n, sums = _added(whitened, width, None)
    if not n:
        return 0.0
    _, products = _added(whitened, width, sums / n)
    live = np.flatnonzero(~np.isnan(sums))
    if not len(live):
        return 0.0
    covariance = products.reshape(width, width)[np.ix_(live, live)] / n
    return float(np.abs(covariance - np.eye(len(live))).max())


RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitening_report(vectors: DataFrame, *, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Fit, whiten and check: for each whole vector and component (numbered from 1) the whitened value, the component's share
    of the variance and the one identity error. ``deviation`` is null where it leaves the range of longs (``whiten`` has it
    as text, whatever its size)."""
    spark = vectors.sparkSession
    fit = fit_whitening(vectors, vector_col=vector_col)
    name = free_name(id_col, [c.split()[0] for c in RESULT.split(", ")])
    if fit is None:
        return spark.createDataFrame([], T.StructType([T.StructField(name, vectors.schema[id_col].dataType)])).selectExpr(f"`{name}`", *(f"CAST(NULL AS {c.split()[1]}) AS {c.split()[0]}" for c in RESULT.split(", ")))
    rows = materialize(whiten(vectors.withColumnRenamed(id_col, name), fit, components=components, id_col=name, vector_col=vector_col), "op13-whitened")
    width = min(components, fit.dim)
    error = identity_error(rows, width)
    shares = F.array(*(F.lit(float(e)) for e in fit.explained(components)))
    cells = rows.select(F.col(name), F.expr("try_cast(deviation AS long)").alias("deviation"), F.posexplode("whitened").alias("at", "value"))
    return cells.select(
        F.col(name), (F.col("at") + 1).cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation",
        F.when(~F.isnan("value"), F.col("value")).alias("whitened"), F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening_report(table(spark, sf_dir, "embeddings"), components=32)


QUERIES = {"op13_whitening": op13_whitening}
SQL: dict[str, str] = {}
