"""Whitening against whole-number arithmetic in plain Python."""

import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm import whitening
from vellum.llm.whitening import LIMB, Scatter, centred, digits_of, fit_whitening, identity_error, whiten, whitening_report

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, n int, component string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in vectors], SCHEMA)


def exact(vectors):
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    scatter = [[n * sum(r[i] * r[j] for r in x) - s[i] * s[j] for j in range(d)] for i in range(d)]
    return n, s, scatter, [sum((n * r[i] - s[i]) ** 2 for i in range(d)) for r in x]


def test_query_by_definition(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = sorted((r.vec_id, list(r.embedding)) for r in rows if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding))
    n, s, scatter, deviation = exact([v for _, v in rows])
    v = np.array([[float(Fraction(c, n * n)) for c in row] for row in scatter])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    z = np.array([[float(Fraction(n * (math.floor(64 * c) + 1_000_000) - t, n)) for c, t in zip(r, s, strict=True)] for _, r in rows])
    want = z @ vectors[:, :32] / np.sqrt(values[:32])
    query = whitening.op13_whitening(spark, DATA)
    assert query.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    got = query.orderBy("vec_id", "component").toPandas()
    assert len(got) == 32 * n and (got.n == n).all()
    assert got.deviation.tolist() == [d for d in deviation for _ in range(32)]
    assert got.vec_id.tolist() == [i for i, _ in rows for _ in range(32)] and got.component.tolist() == list(range(1, 33)) * n
    have = got.whitened.to_numpy().reshape(n, 32)
    sign = np.sign((have * want).sum(axis=0))
    assert np.abs(have - want * sign).max() < 1e-9
    assert np.abs(got.explained.to_numpy()[:32] / (values[:32] / np.trace(v)) - 1).max() < 1e-9
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    assert np.abs(have.T @ have / n - np.eye(32)).max() < 1e-9


def test_the_fit_is_exact_for_any_size_of_numbers(spark):
    rng = np.random.default_rng(1)
    for size in (1.0, 1e9, 2.0**54):
        vectors = [(i, (rng.normal(size=5) * size).tolist()) for i in range(300)]
        n, s, scatter, deviation = exact([v for _, v in vectors])
        for shift in (1_000_000, 0, -(1 << 40)):
            fit = fit_whitening(table(spark, vectors).repartition(7), shift=shift)
            assert fit.n == n and [t + n * shift for t in fit.sums] == s and fit.scatter.tolist() == scatter
        whitened = whiten(table(spark, vectors), fit, components=5)
        assert [int(r.deviation) for r in whitened.orderBy("vec_id").collect()] == deviation
        assert identity_error(whitened, 5) < 1e-9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0, -3.0]), (2, [0.5, 0.0, 1.0]), (2, [0.5, 0.0, 1.0]), (None, [4.0, -1.0, 0.0]), (7, [9.0, 1.0, 5.5])]
    bad = [(3, None), (4, []), (5, [1.0, None, 2.0]), (6, [nan, 1.0, 1.0]), (8, [inf, 0.0, 0.0]), (9, [1.0, 2.0]), (10, [1e300, 0.0, 0.0])]
    got = whitening_report(table(spark, good + bad), components=32).toPandas()
    assert sorted(got.vec_id.fillna(-1).tolist()) == sorted([1, 2, 2, -1, 7] * 3) and (got.n == 5).all()
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.identity_error.max() < 1e-9 and abs(got.groupby("component").explained.first().sum() - 1) < 1e-12


def test_directions_without_variance_have_no_values(spark):
    rows = table(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(10)])
    got = whitening_report(rows).toPandas()
    assert got[got.component > 1].whitened.isna().all() and got[got.component == 1].whitened.notna().all()
    assert got.identity_error[0] < 1e-9
    same = whitening_report(table(spark, [(i, [1.0, 2.0]) for i in range(4)])).toPandas()
    assert same.whitened.isna().all() and (same.explained == 0).all() and (same.deviation == 0).all() and (same.identity_error == 0).all()


@pytest.mark.parametrize("vectors", [[], [(1, None)], [(1, [])], [(1, [None])]])
def test_nothing_to_fit(spark, vectors):
    got = whitening_report(table(spark, vectors))
    assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_an_id_with_a_result_s_name(spark):
    assert whitening_report(table(spark, [(1, [1.0]), (2, [3.0])]), id_col="n").columns[0] == "n_in"


whole = st.integers(-(2**62), 2**62)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(whole, min_size=3, max_size=3), min_size=1, max_size=6))
def test_sums_are_whole_numbers(rows):
    y = np.array(rows, np.int64)
    assert sum(p.astype(object) << (20 * k) for k, p in enumerate(digits_of(y))).tolist() == rows
    total = Scatter(3)
    for _ in range(3):
        total.add(y)
    flat = [0] * 10
    for cell, place, digit in total.cells():
        for c, d in zip(cell.tolist(), digit.tolist(), strict=True):
            flat[c] += d << (LIMB * place)
    sums = [3 * sum(r[i] for r in rows) for i in range(3)]
    assert flat == [3 * len(rows), *sums, *(3 * sum(r[i] * r[j] for r in rows) for i in range(3) for j in range(i, 3))]


@pytest.mark.parametrize("size", [10, 2**20, 2**31, 2**45, 2**57])
def test_centred_rows(size):
    rng = np.random.default_rng(size)
    y = rng.integers(-size, size, (40, 4))
    fit = whitening.Whitening(40, 4, 0, [int(s) for s in y.sum(axis=0)], np.eye(4, dtype=object))
    z, squares = centred(y, fit)
    want = [[40 * int(v) - s for v, s in zip(row, fit.sums, strict=True)] for row in y]
    assert squares == [sum(v * v for v in row) for row in want]
    assert z.tolist() == [[v / 40 for v in row] for row in want]
