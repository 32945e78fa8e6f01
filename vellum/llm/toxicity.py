"""Operator 5, toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams (three to six characters) of a text's lower-cased words, the space at either end included, hashed.
A feature's value is its share: how often it stands in the text for each thousand n-grams, so that a long text is not toxic by
length. Fitting: a bounded sample of labelled rows gives both classes' sums of each feature; the log ratio of their smoothed
shares scales it, and logistic regression on the scaled features gives the weights. Folds of the same sample (equal texts in
one fold) give scores of texts that were not fitted; the place among these that parts the classes best becomes score 0.7.
Only the sample's hashed features reach the driver. Scoring is one pass over all texts without a shuffle; the weights, at
most ``kept`` of them, go to the executors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Workspace, id_and_text, table, text_chunks

ORDERS, SPACE = (3, 4, 5, 6), 1 << 20
THRESHOLD = 0.7
FOLDS = 4
ALARM = 3.0  # what a false alarm costs, a miss costing 1, both as shares of their class

_SPACES = dict.fromkeys(b"\t\n\x0b\x0c\r", " ")


def grams(texts: list[bytes | None], only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hashed n-gram, times it stands there for each thousand n-grams of the text), each pair once and in order.

    An n-gram may have a space at its ends, none within. only: a flag for each hash; the others are left out.
    """
    parts = [" " + (t or b"").decode("utf-8", "replace").lower().translate(_SPACES) + " " for t in texts]
    row = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    spaces = np.concatenate([[0], np.cumsum(row == 32, dtype=np.int32)])
    wide, total = row.astype(np.uint64), np.zeros(len(parts), np.int64)
    rolled, found = np.zeros(len(row), np.uint64), []
    for n in range(1, max(ORDERS) + 1):
        count = len(row) - n + 1
        if count <= 0:
            break
        rolled = rolled[:count] * np.uint64(0x9E3779B97F4A7C15) + wide[n - 1 :]
        if n not in ORDERS:
            continue
        at = np.flatnonzero(spaces[n - 1 : n - 1 + count] == spaces[1 : count + 1])  # no space within
        total += np.bincount(owner[at], minlength=len(parts))
        hashed = ((rolled[at] * np.uint64(0xC2B2AE3D27D4EB4F + 2 * n)) >> np.uint64(44)).astype(np.int64)
        if only is not None:
            use = only[hashed]
            at, hashed = at[use], hashed[use]
        found.append((owner[at] << 20) | hashed)
    pairs, times = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int64),) * 2
    return pairs >> 20, pairs & (SPACE - 1), 1000 * times / total[pairs >> 20]


@dataclass(frozen=True)
class Model:
    ids: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether a hash has a weight, and its weight."""
        weight = np.zeros(SPACE)
        weight[self.ids] = self.weights
        return weight != 0, weight

    def scores(self, texts: list[bytes | None], table: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        known, weight = table or self.table()
        owner, hashed, share = grams(texts, known)
        z = np.bincount(owner, weight[hashed] * share, len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass(frozen=True)
class Sample:
    """Labelled rows as sparse features: of entry k the row, the hash and the share."""

    rows: np.ndarray
    cols: np.ndarray
    share: np.ndarray
    labels: np.ndarray

    def pick(self, flags: np.ndarray) -> Sample:
        number, use = np.cumsum(flags) - 1, flags[self.rows]
        return Sample(number[self.rows[use]], self.cols[use], self.share[use], self.labels[flags])


def worth(pos: np.ndarray, neg: np.ndarray, seen: np.ndarray, toxic: float, clean: float, *, smoothing: float = 4.0, least: int = 4, ratio_least: float = 0.7) -> tuple[np.ndarray, np.ndarray]:
    """Log-count ratio of each feature, and whether it is used, from both classes' sums of it, the rows that have it and the
    number of rows of both classes. Features of under ``least`` rows are left out, and those whose log ratio says little. Each
    class is smoothed in proportion to its mass (1,000 a row): a feature never seen has ratio 0."""
    if not toxic or not clean:
        return np.zeros(SPACE), np.zeros(SPACE, bool)
    part = toxic / (toxic + clean)
    ratio = np.log(pos + smoothing * part) - np.log(1000 * toxic + smoothing * part * SPACE) - np.log(neg + smoothing * (1 - part)) + np.log(1000 * clean + smoothing * (1 - part) * SPACE)
    return ratio, (seen >= least) & (np.abs(ratio) > ratio_least)


def fit(sample: Sample, *, ridge: float = 0.3, steps: int = 120, kept: int = 50_000) -> Model:
    """Log-count ratios times logistic regression weights (full-batch Adam). Features that are not ``worth`` it may be left
    out of the sample: they change nothing."""
    y = sample.labels.astype(float)
    if not len(y) or y.min() == y.max():  # one class or none: nothing to tell apart
        return Model(np.empty(0, np.int64), np.empty(0), 30.0 if len(y) and y[0] else -30.0)
    toxic = y[sample.rows] == 1
    pos, neg = (np.bincount(sample.cols[side], sample.share[side], SPACE) for side in (toxic, ~toxic))
    ratio, good = worth(pos, neg, np.bincount(sample.cols, minlength=SPACE), y.sum(), (1 - y).sum())
    use = good[sample.cols]
    rows = sample.rows[use].astype(np.int32)
    ids, cols = np.unique(sample.cols[use], return_inverse=True)
    cols, scale = cols.astype(np.int32), ratio[ids]
    x = sample.share[use] * scale[cols]
    w, bias = np.zeros(len(ids)), 0.0
    m, v = np.zeros(len(ids) + 1), np.zeros(len(ids) + 1)
    for step in range(1, steps + 1):
        z = np.bincount(rows, w[cols] * x, len(y)) + bias
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        grad = np.append(np.bincount(cols, e[rows] * x, len(ids)) + ridge * w / max(1, len(ids)) ** 0.5, e.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        change = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - change[:-1], bias - change[-1]
    final = w * scale
    top = np.argsort(-np.abs(final), kind="stable")[:kept]
    top = top[np.abs(final[top]) > 1e-4]
    return Model(ids[top], final[top], float(bias))


def parting(z: np.ndarray, labels: np.ndarray) -> float:
    """The place that loses least: the share of toxic rows below it plus ALARM times the share of clean rows above it."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], labels[order].astype(float)
    missed = np.concatenate([[0], np.cumsum(y)]) / max(1, y.sum())
    alarms = np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]]) / max(1, (1 - y).sum())
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    loss = np.where(edges[1:] > edges[:-1], missed + ALARM * alarms, np.inf)
    at = int(np.argmin(loss))
    return float((edges[at] + edges[at + 1]) / 2)


def fit_and_place(sample: Sample, folds: np.ndarray) -> Model:
    """The model of the whole sample, its bias moved so that the place that parts the folds' left-out rows has THRESHOLD."""
    model = fit(sample)
    z = np.zeros(len(sample.labels))
    for fold in range(FOLDS):
        out = folds == fold
        part = sample.pick(~out)
        if not out.any() or not len(part.labels) or part.labels.min() == part.labels.max():
            return model  # too few rows to judge by
        other = fit(part)
        weight = other.table()[1]
        z[out] = (np.bincount(sample.rows, weight[sample.cols] * sample.share, len(z)) + other.bias)[out]
    return replace(model, bias=model.bias - parting(z, sample.labels) + math.log(THRESHOLD / (1 - THRESHOLD)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in text_chunks(batches, max_bytes=1 << 20):
        owner, hashed, share = grams(chunk.column("text").to_pylist())
        cuts = np.searchsorted(owner, np.arange(chunk.num_rows + 1))
        spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        got = [pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (hashed.astype(np.int32), share.astype(np.float32))]
        yield pa.record_batch([*(chunk.column(c) for c in ("place", "version", "label")), *got], names=["place", "version", "label", "grams", "shares"])


def _score(model: Model):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for chunk in text_chunks(batches, max_bytes=1 << 20):
            yield pa.record_batch([chunk.column("doc_id"), pa.array(model.scores(chunk.column("text").to_pylist(), table))], names=["doc_id", "score"])

    return each


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, *, per_class: int = 2_000, fit_bytes: int = 256 << 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on labelled rows: of each class at most ``per_class`` ids, the smallest by a hash of the id, and of their texts as
    many (in that order) as have ``fit_bytes`` of features, which is what the driver holds.

    Rows with a null id, a label other than 0 and 1, or no document are left out. Of several labels for one id the toxic one
    holds. An id with several texts gives its label to each of them; equal rows count once.
    """
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    marked = marked.withColumn("place", F.xxhash64("doc_id"))
    parts = [marked.where(f"label = {k}").orderBy("place", "doc_id").limit(per_class) for k in (0, 1)]
    sample = parts[0].unionByName(parts[1])
    texts = id_and_text(docs, id_col, text_col).join(F.broadcast(sample), "doc_id")  # 2 x per_class rows of three numbers
    texts = texts.select("place", "label", F.coalesce("text", F.lit(b"")).alias("text")).distinct().withColumn("version", F.xxhash64("text"))
    with Workspace(docs.sparkSession, "op5") as work:
        found = work.keep(texts.mapInArrow(_features, "place long, version long, label int, grams binary, shares binary").repartitionByRange(8, "place"), "features")
        return fit_and_place(*_sample(lambda: found.orderBy("place", "version").toLocalIterator(), fit_bytes))


def _sample(read: Callable[[], Iterator], fit_bytes: int) -> tuple[Sample, np.ndarray]:
    """The sample and its folds. Read twice: the first pass sums the features of each fold and class, the second keeps those
    that some fit may use."""
    sums, labels, folds, held = np.zeros((2, FOLDS, SPACE), np.float32), [], [], 0
    seen = np.zeros((FOLDS, SPACE), np.int32)
    for r in read():
        held += 2 * len(r["grams"])
        if labels and held > fit_bytes:
            break
        fold, cols = r["version"] % FOLDS, np.frombuffer(r["grams"], np.int32)
        sums[r["label"], fold, cols] += np.frombuffer(r["shares"], np.float32)  # a row has each hash once
        seen[fold, cols] += 1
        labels.append(r["label"])
        folds.append(fold)
    y, fold = np.array(labels, int), np.array(folds, int)
    count = lambda label, out: float(((y == label) & (fold != out)).sum())
    good = np.zeros(SPACE, bool)
    for out in range(-1, FOLDS):
        use = [k for k in range(FOLDS) if k != out]
        good |= worth(sums[1, use].sum(axis=0, dtype=float), sums[0, use].sum(axis=0, dtype=float), seen[use].sum(axis=0), count(1, out), count(0, out))[1]
    entries = []
    for i, r in enumerate(read()):
        if i >= len(y):
            break
        cols = np.frombuffer(r["grams"], np.int32)
        use = good[cols]
        entries.append((np.full(int(use.sum()), i, np.int32), cols[use], np.frombuffer(r["shares"], np.float32)[use]))
    rows, cols, share = (np.concatenate([e[k] for e in entries]) if entries else np.empty(0, int) for k in range(3))
    return Sample(rows, cols, share, y), fold


def toxicity_scores(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from ``threshold``) for each row. Null and empty texts have the score of the
    bias alone. Repeated and null ids keep their rows. Other columns are ignored."""
    kind = docs.schema[id_col].dataType.simpleString()
    scored = id_and_text(docs, id_col, text_col).mapInArrow(_score(model), f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    return toxicity_scores(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op5_toxicity": op5_toxicity}
SQL: dict[str, str] = {}
