"""Near-duplicates against all pairs, compared as sets of word tuples."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm import near_dups
from vellum.llm._common import Workspace
from vellum.llm.near_dups import Bounds, Parities, least_common, near_duplicates, overlaid, parity

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, cid long, n string, sketch int"


def shingles(text, k):
    fold = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    w = fold.split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def by_definition(rows, k=5, percent=85):
    sets = [shingles(t, k) for _, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, _) in enumerate(rows):
        for y, (j, _) in enumerate(rows[:x]):
            if i is not None and j is not None and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return Counter((c := None if i is None else find(i), i, c is not None and c == i, len(s)) for (i, _), s in zip(rows, sets, strict=True))


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "n", 2) for i, t in rows], SCHEMA)


def edits(rng, w, e):
    w = list(w)
    for at in rng.sample(range(len(w)), e):
        w[at] = rng.choice("abcdefgh") + str(rng.randrange(10**6))
    return w


def family(rng, words, members, most, chain=False):
    """Copies of a text with up to ``most`` changed words; of a chain, each a copy of one before."""
    out = [[f"w{rng.randrange(10**5)}" for _ in range(words)]]
    for _ in range(members):
        out.append(edits(rng, rng.choice(out) if chain else out[0], rng.randrange(1, most + 1)))
    return [" ".join(w) for w in out]


ODD = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two three four"), (7, "a b c d e f g h i j k l m"), (8, "a b c d e f g h i j k l m n"), (9, "É é é É é x"), (9, "É é é É é x"), (9, "a b c d e f g h i j k l m"), (None, "one"), (None, None), (10, " ".join(f"t{i}" for i in range(3000))), (11, " ".join(f"t{i}" for i in range(3100)))]


def test_query_by_definition(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    query = near_dups.op12_minhash_near_dedup(spark, DATA)
    assert query.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    assert rows_of(query) == by_definition(rows)


@pytest.mark.parametrize("percent, words", [(85, 5), (60, 2)])
def test_odd_rows(spark, percent, words):
    assert rows_of(near_duplicates(table(spark, ODD), percent=percent, words=words)) == by_definition(ODD, words, percent)
    assert near_duplicates(table(spark, []), percent=percent).count() == 0


@pytest.mark.parametrize("words, percent, size, long", [(150, 85, 256, 4), (400, 85, 256, 4096), (60, 85, 16, 4), (40, 60, 256, 4096)])
def test_families_of_near_copies(spark, words, percent, size, long):
    """Families with members near the bound; with size 16 most sketches are samples."""
    rng = random.Random(words + percent)
    texts = family(rng, words, 40, words // 18) + family(rng, words, 30, max(1, words // 50), chain=True) + [" ".join(edits(rng, ["same"] * words, 3)) for _ in range(10)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert rows_of(near_duplicates(table(spark, rows), percent=percent, size=size, long=long)) == by_definition(rows, 5, percent)


def test_a_common_passage_makes_no_lists(spark):
    """Sets that share much but differ enough by values of their own are in no list at all."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"u{rng.randrange(10**9)}" for _ in range(20)])) for i in range(200)]
    with Workspace(spark, "test") as work:
        index = table(spark, rows).selectExpr("doc_id", "cast(text as binary) text").mapInArrow(near_dups._index(5, 256), "doc_id long, n long, cid long, also long, sketch array<long>, parity binary")
        assert near_dups._sketch_lists(work.keep(index, "index"), 85, 256, work).count() == 0
    assert near_duplicates(table(spark, rows)).where("kept").count() == 200


def test_numbers_that_clash_keep_their_classes_apart(spark, monkeypatch):
    rows = [(i, f"text number {i // 2} of a few that are quite short") for i in range(8)]

    def all_seven(made):
        def renumbered(*args):
            def each(batches):
                for b in made(*args)(batches):
                    yield b.set_column(b.schema.get_field_index("cid"), "cid", pa.array([7] * b.num_rows, pa.int64()))

            return each

        return renumbered

    monkeypatch.setattr(near_dups, "_index", all_seven(near_dups._index))
    monkeypatch.setattr(near_dups, "_full_sets", all_seven(near_dups._full_sets))
    assert rows_of(near_duplicates(table(spark, rows))) == by_definition(rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9), st.sampled_from([60, 85, 90]), st.sampled_from([16, 256]))
def test_overlays_connect_what_links(seed, percent, size):
    rng = random.Random(seed)
    base = rng.sample(range(1, 10**12), rng.randrange(8, 120))
    sets = [set(base[rng.randrange(4) :]) | set(rng.sample(range(10**13, 10**14), rng.randrange(0, 12))) for _ in range(14)]
    members = [np.array(sorted(s), np.uint64) for s in sets]
    n, g = np.array([len(m) for m in members]), np.arange(14)
    args = np.arange(14), n, g, g > 0, [m[:size].view(np.int64) for m in members], [parity(m) for m in members], Bounds(percent, size)
    found, trusted = (list(overlaid(*args, trust)) for trust in (False, True))
    assert len(trusted) < 14 and set(trusted) <= set(found) | set(trusted)
    linked = lambda i, j: 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])

    def parts(pairs):
        comp = list(range(14))
        for a, b in pairs:
            comp = [comp[a] if c == comp[b] else c for c in comp]
        return {frozenset(k for k, c in enumerate(comp) if c == x) for x in comp}

    if size == 256:
        assert len(found) < 14 and all(linked(a, b) for a, b, _, _ in found)
        assert parts([f[:2] for f in found]) == parts([(i, j) for i in range(14) for j in range(i) if linked(i, j)])
    else:
        assert {tuple(sorted(f[:2])) for f in found} <= {(i, j) for j in range(14) for i in range(j)}


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    pool = rng.choice(2**62, 6000, replace=False).astype(np.uint64)
    sets = [np.unique(pool[rng.permutation(6000)[: rng.integers(300, 4000)]]) for _ in range(20)]
    bits = Parities([parity(s) for s in sets])
    for i, x in enumerate(sets):
        at = np.array([j for j, y in enumerate(sets) if 2 * len(x) > len(y) and 2 * len(y) > len(x)])
        assert (bits.apart(i, at) <= [len(np.setxor1d(x, sets[j])) for j in at]).all()
    near = np.sort(np.concatenate([sets[0][20:], rng.choice(2**62, 20, replace=False).astype(np.uint64)]))
    assert 34 <= Parities([parity(sets[0]), parity(near)]).apart(0, np.array([1]))[0] <= 40


def test_bounds_hold_for_sets_at_the_threshold():
    rng, bounds = np.random.default_rng(5), Bounds(85)
    assert least_common(256, 85) == bounds.sampled < 0.85 * 256
    for n in [*range(6, 60), 100, 217, 218, 240, 255, 256, 257, 300, 800]:
        for _ in range(20):
            differ = int(n * 0.15)
            common = n - differ
            extra = int(rng.integers(0, max(1, int(common / 0.85) - n + 1)))
            pool = rng.choice(2**62, n + extra, replace=False)
            a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[: n - differ], pool[n:]]))
            if 100 * len(np.intersect1d(a, b)) < 85 * len(np.union1d(a, b)):
                continue
            shared = len(np.intersect1d(a[:256], b[:256]))
            assert shared >= bounds.least(len(a)) and shared >= bounds.least(len(b))
