"""Importance resampling against its definition, a row at a time."""

import hashlib
import math
import zlib
from collections import Counter

import pytest
from conftest import rows_of, rows_of_sql
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm import importance
from vellum.llm.importance import Buckets, carried, importance_resampling, starts_of_chunks

DATA = "/root/testdata/sf0.001"


def words(text):
    out, run = [], b""
    for byte in (text or "").encode():
        byte = byte + 32 if 65 <= byte <= 90 else byte
        if byte >= 0x80 or 48 <= byte <= 57 or 97 <= byte <= 122:
            run += bytes([byte])
        elif run:
            out, run = [*out, run], b""
    return [*out, run] if run else out


def features(text, runs):
    w = words(text)
    return [b" ".join(w[i : i + k]) for k in range(1, runs + 1) for i in range(len(w) - k + 1)]


def by_definition(rows, target, runs=1, buckets=10_000, seed=2024, least=20, percent=10):
    hashed = lambda text: [zlib.crc32(f) % buckets for f in features(text, runs)]
    source, aim = Counter(b for _, t in rows for b in hashed(t)), Counter(b for t in target for b in hashed(t))
    s, t = sum(source.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (s + buckets) / ((source[b] + 1) * (t + buckets))))
    out = []
    for i, text in rows:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, hashed(text)))
        out.append([i, len(words(text)), len(features(text, runs)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    order = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0], -r[3], -r[2]))
    for k, r in enumerate(order[: percent * len(order) // 100], 1):
        r[5] = k
    return Counter(map(tuple, out))


ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "The the THE É é " * 30), (5, "The the THE É é " * 30), (5, "other words here " * 9), (None, "no id " * 25), (None, None),
    (6, "word" * 5000), (7, ("x" * 900 + " ") * 40), (8, "tie one two three four five six seven eight nine ten " * 3), (9, "tie one two three four five six seven eight nine ten " * 3), (10, "x-1_y z \x7f[q] " * 200),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, i, 1, "b") for i, t in ODD], "doc_id long, text string, score long, rank int, digest string")


@pytest.mark.parametrize("runs", [1, 3])
@pytest.mark.parametrize("size", [16, 1000, 1 << 18])
def test_odd_rows_by_definition(spark, odd, runs, size):
    target = spark.createDataFrame([("one two tie é", 1), (None, 2), ("", 3)], "text string, doc_id long")
    got = importance_resampling(odd, target, runs=runs, percent=50, chunk_bytes=size)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert rows_of(got.select(*got.columns)) == Counter(tuple(r[k] for k in (0, 2, 1, 5, 4, 3)) for r in by_definition(ODD, ["one two tie é", None, ""], runs, percent=50).elements())


def test_documents_by_definition_and_sql(spark, duck):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    query = importance.op11_importance_resampling(spark, DATA)
    want = Counter((i, n, rank, score, weight) for i, _, n, weight, score, rank in by_definition(rows, target).elements())
    assert rows_of(query) == want
    assert rows_of_sql(duck, importance.SQL["op11_importance_resampling"]) == (sorted(query.columns), want)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 20)], "doc_id long, text string")
    assert importance_resampling(none, some).count() == 0
    assert importance_resampling(some, none, percent=100).first()["rank"] == 1


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab Z9-é\n"), max_size=60), st.integers(1, 20), st.integers(1, 4))
def test_chunks_own_every_feature_once(text, size, runs):
    raw = text.encode()
    spans = list(starts_of_chunks(raw, size))
    assert b"".join(raw[a:b] for a, b in spans) == raw
    whole, parts = Buckets(runs, 97), Buckets(runs, 97)
    n, found = whole.of(raw, len(raw))
    cut = [parts.of(raw[a : carried(raw, b, runs - 1)], b - a) for a, b in spans]
    assert n == len(words(text)) == sum(k for k, _ in cut)
    assert Counter(found.tolist()) == Counter(zlib.crc32(f) % 97 for f in features(text, runs)) == Counter(b for _, f in cut for b in f.tolist())


def test_the_lowest_drawn_score_is_found_in_any_spread(spark):
    scores = [-(10**12), 10**12, 5, 5, 5, -7, 0, 3_000_000, 3_000_001]
    df = spark.createDataFrame([(s,) for s in scores], "score long")
    for wanted in range(1, len(scores) + 1):
        low, above = importance.lowest_drawn(df, wanted)
        assert low == sorted(scores)[-wanted] and above == sum(s > low for s in scores)
