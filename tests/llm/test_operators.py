"""The training-data operators against brute force, on small tables and hand-made edge cases."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from conftest import DATA, rows_of, rows_of_sql
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum import llm
from vellum.llm import _common, decontamination, license_scan, ngram_join, packing, quality_rules, substring_dedup, token_counts, toxicity, url_filter, warc

EDGE = "doc_id long, text string, sig string, key int, spans string, n_words string"


def words(text):
    return (text or "").encode().split()


@pytest.fixture(scope="module")
def documents(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    return df, [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, repeated rows and ids, copies, and columns with names the operators use."""
    rng = random.Random(7)
    long = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 5) for _ in range(4000))
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, long), (7, long + " tail"), (8, passage), (9, f"x {passage} y"), (9, f"x {passage} y"), (10, f"other {passage}"), (10, "same id, other text"), (None, passage), (None, None), (11, "Ünïcode wörds — ok"), (12, "é" * 3000)]
    return spark.createDataFrame([(*r, "s", 1, "t", "u") for r in rows], EDGE), rows


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], EDGE)


# ---------------------------------------------------------------- 1


def removed(rows, width=50):
    """By the definition: words covered by a window that starts in a document with a smaller id."""
    where = collections.defaultdict(set)
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - width + 1):
            if i is not None:
                where[tuple(w[p : p + width])].add(i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if i is not None and min(where[tuple(w[p : p + width])]) < i:
                gone[p : p + width] = [True] * width
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return collections.Counter(out)


def test_op1(spark, documents):
    got = llm.QUERIES["op1_substring_dedup"](spark, DATA).collect()
    assert collections.Counter(tuple(r) for r in got) == removed(documents[1])


def test_op1_edges(edge, empty):
    df, rows = edge
    got = substring_dedup.substring_dedup(df, layout="words").select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    assert collections.Counter(tuple(r) for r in got) == removed(rows)
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_op1_original_layout_keeps_what_stands_between_words(spark):
    p = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, p), (2, f"a\n\n{p}\n b\tc  ")], "doc_id long, text string")
    got = {r["doc_id"]: (r["kept_text"], r["spans"]) for r in substring_dedup.substring_dedup(df).collect()}
    assert got[1] == (p, []) and got[2][0] == "a\n b\tc  " and [(s["first"], s["end"]) for s in got[2][1]] == [(1, 51)]


def test_op1_every_span_comes_from_the_automata(spark, documents, monkeypatch):
    """Small shards and copies of them; and without passages nothing is cut."""
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 4000)
    monkeypatch.setattr(substring_dedup, "STREAM", 3)
    got = substring_dedup.substring_dedup(documents[0], layout="words").select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    assert collections.Counter(tuple(r) for r in got) == removed(documents[1])
    confirmed = substring_dedup._confirmed
    monkeypatch.setattr(substring_dedup, "_confirmed", lambda *a: (lambda passages, routes: (passages.limit(0), routes))(*confirmed(*a)))
    assert substring_dedup.substring_dedup(documents[0]).where("n_removed > 0").count() == 0


def test_op1_a_shard_has_no_bound_on_its_words(monkeypatch):
    words = [b"%d" % i for i in range(1_200_000)]
    shard = substring_dedup.Shard([(1, words)], 50)
    assert shard.locate(2, [b"x", *words[1_150_000:1_150_060], b"y"]) == [(1, 61)] and shard.locate(1, words[:60]) == []
    monkeypatch.setattr(substring_dedup.Shard, "LETTERS", 3)  # words that share a letter are told apart
    rng = random.Random(1)
    text = [b"%d" % rng.randrange(50) for _ in range(300)]
    shard = substring_dedup.Shard([(1, text)], 10)
    assert shard.locate(2, [*text[100:130], b"x", *text[40:49]]) == [(0, 30)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b"]), min_size=4, max_size=30), min_size=1, max_size=4), st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60))
def test_op1_locate_by_definition(passages, words):
    got = substring_dedup.Shard([(i, p) for i, p in enumerate(passages)], 4).locate(99, words)
    windows = {tuple(p[i : i + 4]) for p in passages for i in range(len(p) - 3)}
    assert got == substring_dedup.joined_spans((i, i + 4) for i in range(len(words) - 3) if tuple(words[i : i + 4]) in windows)


def test_op1_a_block_of_very_many_passages_is_looked_up_once(monkeypatch):
    common = [b"c%d" % i for i in range(60)]
    passages = [(i, [*(b"l%d-%d" % (i, j) for j in range(20)), *common, *(b"r%d-%d" % (i, j) for j in range(20))]) for i in range(500)]
    shard = substring_dedup.Shard(passages, 50)
    assert len(shard.at) == 500 * 51 - 499 * 11  # windows within the common words stand there once
    compared, equal = [], substring_dedup._equal
    monkeypatch.setattr(substring_dedup, "_equal", lambda x, at, *rest: compared.append(len(at)) or equal(x, at, *rest))
    assert shard.locate(600, [b"x", *common, b"y"]) == [(1, 61)] and shard.locate(0, [b"x", *common, b"y"]) == []
    assert shard.locate(1, passages[300][1]) == [(20, 80)] and shard.locate(301, passages[300][1]) == [(0, 100)]
    assert sum(compared) < 200


def test_op1_keys_that_differ_in_content(monkeypatch):
    monkeypatch.setattr(substring_dedup, "_window_keys", lambda codes, width: np.zeros(len(codes) - width + 1, np.uint64))
    rng = random.Random(3)
    for _ in range(50):
        passages = [(i, [b"%d" % rng.randrange(3) for _ in range(rng.randrange(4, 20))]) for i in range(5)]
        words = [b"%d" % rng.randrange(3) for _ in range(40)]
        windows = {tuple(p[i : i + 4]) for o, p in passages if o < 3 for i in range(len(p) - 3)}
        want = substring_dedup.joined_spans((i, i + 4) for i in range(37) if tuple(words[i : i + 4]) in windows)
        assert substring_dedup.Shard(passages, 4).locate(3, words) == want


def test_op1_carried_columns_with_the_operator_s_names(spark):
    df = spark.createDataFrame([(1, "a b", 7, "s")], "doc_id long, text string, n_words int, spans string")
    row = substring_dedup.substring_dedup(df, carry=["n_words", "spans", "text"]).first()
    assert (row["n_words"], row["n_words_in"], row["spans_in"], row["text"]) == (2, 7, "s", "a b")


# ---------------------------------------------------------------- 2


def components(rows, k, percent):
    sets = collections.defaultdict(list)
    for i, t in rows:
        w = [x.lower() for x in words(t)]
        if i is not None:
            sets[i].append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and any(100 * len(a & b) >= percent * len(a | b) for a in sets[x] for b in sets[y] if a and b):
                a, b = find(x), find(y)
                top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_op2(documents, edge, empty, k, percent):
    for df, rows in (documents, edge):
        got = ngram_join.ngram_jaccard_join(df, words=k, percent=percent).collect()
        want = components(rows, k, percent)
        assert collections.Counter((r["doc_id"], r["n_shingles"], r["n_links"]) for r in got) == link_counts(rows, k, percent)
        assert all(r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]]) for r in got)
    assert ngram_join.ngram_jaccard_join(empty).count() == 0


def test_op2_near_copies_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(300)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_jaccard_join(df, words=3, percent=90).collect()}
    assert got == components(rows, 3, 90)


def link_counts(rows, k, percent):
    sets = []
    for i, t in rows:
        w = [x.lower() for x in words(t)]
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    links = lambda p, q: p != q and None not in (sets[p][0], sets[q][0]) and sets[p][1] and sets[q][1] and 100 * len(sets[p][1] & sets[q][1]) >= percent * len(sets[p][1] | sets[q][1])
    return collections.Counter((sets[p][0], len(sets[p][1]), sum(bool(links(p, q)) for q in range(len(sets)))) for p in range(len(sets)))


@pytest.mark.parametrize("tile", [2048, 7])
def test_op2_counts_every_link_of_a_component(spark, edge, monkeypatch, tile):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    rng = random.Random(6)
    rows = []
    for g in range(3):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(200)]
        for i in range(30):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append((100 * g + i, " ".join(w)))
            if i % 3 == 0:
                base[rng.randrange(len(base))] = f"drift{i}"  # chains: a component holds sets that do not link
    rows += rows[:4] + [(1000, rows[0][1])]
    for df, rows in ((spark.createDataFrame(rows, "doc_id long, text string"), rows), edge):
        got = collections.Counter((r["doc_id"], r["n_shingles"], r["n_links"]) for r in ngram_join.ngram_jaccard_join(df, words=3, percent=90).collect())
        assert got == link_counts(rows, 3, 90)


def test_op2_a_document_links_by_any_of_its_texts(spark):
    rng = random.Random(9)
    a, b, c = ([f"{x}{rng.randrange(400)}" for _ in range(200)] for x in "abc")
    near = lambda w: " ".join([*w[:100], "other", *w[101:]])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (1, " ".join(c)), (2, near(a)), (3, near(b)), (4, near(c)), (5, None), (4, ""), (6, " ".join(b))]
    got = [tuple(r) for r in ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=90).select("doc_id", "component_id").collect()]
    assert sorted(got) == sorted((i, 5 if i == 5 else 1) for i, _ in rows)


def test_op2_links_sets_of_very_different_sizes(spark):
    w = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(w[:n])) for i, n in enumerate((20, 39, 41, 75, 77, 100, 150, 198, 202, 260, 390))]
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["n_links"]) for r in ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=50).collect())
    assert got == link_counts(rows, 3, 50)


@pytest.mark.parametrize("tile", [2048, 16])
def test_op2_lists_with_many_unlike_members(spark, monkeypatch, tile):
    """One boilerplate in short texts of their own, some of them near copies that no centre stands for."""
    monkeypatch.setattr(ngram_join, "TILE", tile)
    rng = random.Random(11)
    boiler = [f"b{i}" for i in range(24)]
    rows = []
    for i in range(150):
        own = [f"o{i}x{j}" for j in range(rng.randrange(4, 14))]
        rows.append((2 * i, " ".join(boiler + own)))
        if i % 5 == 0:
            rows.append((2 * i + 1, " ".join([*boiler, *own, "t"])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.ngram_jaccard_join(df, words=3, percent=90).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == components(rows, 3, 90)
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["n_links"]) for r in got) == link_counts(rows, 3, 90)


def test_sieve_passes_its_members(spark):
    sieve = _common.Sieve(spark.range(0, 5000, 5).select("id"))
    passed = sieve.passes(np.arange(5000))
    assert passed[::5].all() and passed.sum() < 1200


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([80, 90]), st.integers(12, 900))
def test_op2_similar_sets_share_lists(seed, percent, n):
    """The pigeonhole bound: sets at the threshold share as many signatures as the join asks for."""
    rng = np.random.default_rng(seed)
    scheme = ngram_join.Scheme(percent)
    pool = np.unique(rng.integers(0, 2**63, 3 * n, np.uint64) * np.uint64(2))
    common = pool[:n]
    extra = int(n * (100 - percent) / percent)
    a_part = rng.integers(0, extra + 1)
    a, b = np.sort(np.concatenate([common, pool[n : n + a_part]])), np.sort(np.concatenate([common, pool[n + a_part : n + extra]]))
    if len(a) == len(b) == n or 100 * n < percent * (n + extra):
        return
    sums = lambda s: np.concatenate([np.zeros(1, np.uint64), np.cumsum(ngram_join.mix(s))])
    sa, sb = (set(np.concatenate([*scheme.signatures(s, sums(s)), np.empty(0, np.uint64)]).tolist()) for s in (a, b))
    assert len(sa & sb) >= ngram_join.SHARED


# ---------------------------------------------------------------- 3


def test_op3(spark, documents):
    items = [(r["item_id"], r["text"].encode()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    norm = lambda t: b" " + b" ".join(t.translate(decontamination.PLAIN).split()) + b" "
    exact = {(i, j) for i, t in documents[1] if t for j, x in items if norm(x) in norm(t.encode())}
    got = {(r["doc_id"], r["item_id"]) for r in llm.QUERIES["op3_benchmark_decontamination"](spark, DATA).where("distance = 0").collect()}
    assert got == exact and exact


def edited(rng, w, k):
    w = list(w)
    for _ in range(k):
        p = rng.randrange(len(w))
        if rng.random() < 0.4:
            w[p] = f"r{rng.randrange(10**6)}"
        elif rng.random() < 0.5:
            w.insert(p, f"i{rng.randrange(10**6)}")
        else:
            del w[p]
    return w


def test_op3_reaches_its_recall_and_invents_nothing(spark):
    rng = random.Random(3)
    items = [(i, [f"v{rng.randrange(3000)}" for _ in range(rng.randrange(15, 60))]) for i in range(60)]
    rows, planted = [], set()
    for d in range(120):
        w = [f"v{rng.randrange(3000)}" for _ in range(rng.randrange(0, 200))]
        if d % 2:
            i, x = rng.choice(items)
            cut = rng.randrange(len(w) + 1)
            w = w[:cut] + edited(rng, x, len(x) // 5) + w[cut:]
            planted.add((d, i))
        rows.append((d, " ".join(w)))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.benchmark_matches(docs, bench).collect()}
    assert got <= planted and len(got) >= 0.95 * len(planted)
    blocks = {(r["doc_id"], r["item_id"]) for r in decontamination.benchmark_matches(docs, bench, block_bytes=4000).collect()}
    assert blocks == got


def best_distance(item, text):
    """By the definition: the least edits that turn the item into a part of the text (a row of the table at a time: a step to
    the right costs one, so the row less its column numbers is a running minimum)."""
    text = np.array(text, object)
    columns = np.arange(len(text) + 1)
    last = np.zeros(len(text) + 1, np.int64)
    for i, w in enumerate(item, 1):
        now = np.concatenate([[i], np.minimum(last[1:] + 1, last[:-1] + (text != w))])
        last = np.minimum.accumulate(now - columns) + columns
    return int(last.min())


@pytest.mark.parametrize("size", [5, 8, 15, 30, 59, 120, 700])
def test_op3_recall_by_size_up_to_the_bound(size):
    """Of each number of edits that is allowed at least nine in ten are found, with their exact distance."""
    rng = random.Random(size)
    word = lambda: b"v%d" % rng.randrange(3000)
    items = [[word() for _ in range(size)] for _ in range(8)]
    index = decontamination.Items([(i, b" ".join(x)) for i, x in enumerate(items)], 0.8, 6, 8, 2, 3)
    for k in sorted({0, 1, size // 10, size // 5}):
        tried = found = 0
        for i, item in enumerate(items):
            for _ in range(5):
                text = [word() for _ in range(rng.randrange(20))] + [x.encode() if isinstance(x, str) else x for x in edited(rng, item, min(k, size // 5))] + [word() for _ in range(rng.randrange(20))]
                flat, starts = decontamination.flat_words([b" ".join(text)], decontamination.WordHashes())
                got = {y: far for _, y, _, _, far in decontamination.find(index, flat, starts)}
                want = best_distance(item, text)
                tried, found = tried + 1, found + (i in got)
                assert set(got) <= {i} and (i not in got or got[i] == want <= size // 5)
        assert found >= 0.9 * tried


def test_op3_nothing_is_found_but_through_the_buckets(spark, documents, monkeypatch):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert decontamination.benchmark_matches(documents[0], bench).count() > 0
    assert decontamination.benchmark_matches(documents[0], bench, walks=0).count() == 0


def test_op3_a_long_item_takes_little_memory():
    import tracemalloc

    rng = random.Random(2)
    rows = [(i, b" ".join(b"w%d" % rng.randrange(10**6) for _ in range(60))) for i in range(1000)] + [(1000, b" ".join(b"w%d" % rng.randrange(10**6) for _ in range(200_000)))]
    tracemalloc.start()
    index = decontamination.Items(rows, 0.8, 6, 8, 2, 3)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    text = rows[1000][1].split()[:3000]
    tracemalloc.stop()
    short = decontamination.Items([(1, b" ".join(text)), rows[5]], 0.8, 6, 8, 2, 3)
    flat, starts = decontamination.flat_words([b"x y " + b" ".join(text[:100] + text[120:]) + b" " + rows[5][1]], decontamination.WordHashes())
    assert [(i, far) for _, i, _, _, far in decontamination.find(short, flat, starts)] == [(0, 20), (1, 0)] and len(index.ids) == 1001


def test_op3_edges(spark, edge, empty):
    df, _ = edge
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (4, " ".join(f"p{i}" for i in range(5, 30))), (4, " ".join(f"p{i}" for i in range(5, 30)))], "item_id long, text string")
    got = decontamination.benchmark_matches(df, bench).collect()
    assert collections.Counter(r["doc_id"] for r in got) == {4: 1, 5: 1, 8: 2, 9: 4, 10: 2, None: 2}
    assert decontamination.benchmark_matches(empty, bench).count() == decontamination.benchmark_matches(df, bench.limit(0)).count() == 0
    han = "\u4e2d\u6587\u6ca1\u6709\u7a7a\u683c\u7684\u6587\u672c\u5728\u8fd9\u91cc"
    docs = spark.createDataFrame([(1, f"x {han}y"), (2, han[:4]), (3, "one"), (4, "One!"), (5, "one two")], "doc_id long, text string")
    items = spark.createDataFrame([(1, han[1:]), (2, "one")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in decontamination.benchmark_matches(docs, items).collect()} == {(1, 1, 0), (3, 2, 0), (4, 2, 0)}


# ---------------------------------------------------------------- 4 and 6


@pytest.mark.parametrize("name", ["op4_license_scan", "op6_url_filter"])
def test_native_operators_equal_their_sql_and_run_no_python(spark, duck, name):
    df = llm.QUERIES[name](spark, DATA)
    names, want = rows_of_sql(duck, llm.SQL[name])
    assert sorted(df.columns) == names and rows_of(df) == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_op4_edges(spark, edge, empty):
    rows = [(1, "MIT License, mit-license and MIT  LICENSE mit license mit license"), (2, "the mitlicense"), (3, "Licensed under CC BY-NC 4.0."), (4, "Released under the Apache License"), (5, None), (6, ""), (7, "General\nPublic. LICENSE!")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.license_scan(df).collect()}
    assert (got[1]["n_words"], got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (11, 5, 0, 9, "mit")
    assert got[2]["n_base"] == 0 and got[2]["first_word"] is None
    assert (got[3]["base_labels"], got[3]["labels"], got[3]["score"]) == ("", "cc-by-nc", 1.0)
    assert got[4]["labels"] == "apache" and got[7]["labels"] == "gpl" and got[7]["first_word"] == 0
    assert (got[5]["n_words"], got[5]["labels"], got[5]["score"]) == (0, "", 0.0) == (got[6]["n_words"], got[6]["labels"], got[6]["score"])
    assert license_scan.license_scan(edge[0]).count() == len(edge[1]) and license_scan.license_scan(empty).count() == 0


def test_op4_finds_wrapped_notices(spark):
    mit, bsd, mpl = (next(t for label, t in license_scan.TEMPLATES if label == x and len(t) > 50) for x in ("mit", "bsd", "mpl"))
    wrapped = lambda t, n, mark="": "".join(f"{mark}{' '.join(t.split()[i : i + n])}\n" for i in range(0, len(t.split()), n))
    rows = [(1, mit.replace("a copy ", "a copy\n")), (2, "x " * 500 + wrapped(bsd, 9, " * ")), (3, wrapped(mpl, 4, "rem ")), (4, wrapped(mpl, 1)), (5, "text\n\n" + " filler ".join(mpl.split())), (6, " ".join(bsd.split()[:12]) + "\nand no more")]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("mit", 1.0), 2: ("bsd", 1.0), 3: ("mpl", 1.0), 4: ("mpl", 1.0), 5: ("mpl", 1.0), 6: ("", 0.0)}


def test_op4_equals_every_run_and_line(spark):
    rng = random.Random(8)
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if w]
    rows = []
    for d in range(150):
        w = [rng.choice(["the", "of", "license", "software", "conditions", "x", "y"]) for _ in range(rng.randrange(30))]
        t = rng.choice(license_scan.TEMPLATES)[1].split()
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = rng.choice(["z", "the"])
        cut = rng.randrange(len(w) + 1)
        rows.append((d, "".join(x + rng.choice([" ", " ", "\n"]) for x in w[:cut] + t + w[cut:])))
    want = {}
    for d, text in rows:
        labels, shares = set(), [0.0]
        for label, t in license_scan.TEMPLATES:
            words, run, all_words = set(split(t)), len(split(t)) + len(split(t)) // 4, split(text)
            blocks = [split(x) for x in text.split("\n")] + [all_words[i : i + run] for i in range(len(all_words))]
            held = max(len(words & set(b)) for b in blocks)
            if 10 * held >= 9 * len(words):
                labels.add(label)
                shares.append(held / len(words))
        want[d] = (labels, max(shares))
    for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        labels, share = want[r["doc_id"]]
        assert set(filter(None, r["labels"].split(","))) == labels | set(filter(None, r["base_labels"].split(",")))
        assert r["score"] == (1.0 if r["n_base"] else share)


def test_op6_edges(spark):
    urls = [None, "", "no scheme", "https://EXAMPLE.org", "https://example.org/es/x", "https://a.b.example.org/es/x?y", "https://notexample.org/es/x", "https://org/es", "http://example.org/en/12", "http://example.org/en/2", "ftp://x.com/fr/#a", "https://x.com", "a://b://c/d", "https://example.org/es/x"]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)] + [(None, "https://x.com/de/", "z")], "page_id long, url string, key string")
    rules = url_filter.rule_table(spark)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_filter(df, rules).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("example.org", "", None, "allow")
    assert got[4][2:] == got[5][2:] == got[13][2:] == ("example.org/es/", "block") and got[6][2:] == got[7][2:] == ("org/", "allow")
    assert got[8][2:] == ("example.org/en/1", "block") and got[9][2:] == ("org/", "allow") and got[10] == ("x.com", "/fr/", "com/fr/", "allow")
    assert got[12] == ("b:", "//c/d", None, "allow") and got[None][2:] == ("com/de/", "block")
    assert {r["verdict"] for r in url_filter.url_filter(df, rules.limit(0), default="block").collect()} == {"block"}
    assert url_filter.url_filter(df.limit(0), rules).count() == 0


def test_op6_many_nested_rules(spark):
    rng = random.Random(6)
    hosts = [".".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(60)]
    rules = sorted({(rng.choice(["allow", "block"]), h, rng.choice(["/", "/x", "/x/y", ""])) for h in hosts})
    rules = list({(h, p): (v, h, p) for v, h, p in rules}.values())
    urls = [(i, f"https://{'.'.join(rng.choice('abc') for _ in range(rng.randrange(1, 6)))}{rng.choice(['', '/', '/x', '/x/y/z', '/q'])}") for i in range(500)]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.url_filter(spark.createDataFrame(urls, "page_id long, url string"), url_filter.rule_table(spark, rules)).collect()}
    for i, u in urls:
        host, _, rest = u.removeprefix("https://").partition("/")
        path = "/" + rest if "/" in u.removeprefix("https://") else ""
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i] == (max(fits)[1:] if fits else (None, "allow"))


def test_op6_ten_thousand_rules_of_one_host(spark):
    rng = random.Random(12)
    path = lambda: "/" + "/".join(rng.choice(["a", "b", "cd", "e\u00e9"]) for _ in range(rng.randrange(0, 9)))
    rules = {("h.org", path() + rng.choice(["", "/", str(rng.randrange(999))])): rng.choice(["allow", "block"]) for _ in range(11_000)}
    rules |= {("org", "/a"): "block", ("x.h.org", "/a/b"): "allow"}
    urls = [(i, f"https://{rng.choice(['h.org', 'x.h.org', 'y.x.h.org', 'org', 'g.org'])}{path()}{rng.randrange(99)}") for i in range(800)] * 2 + [(None, "https://h.org/a")]
    table = url_filter.rule_table(spark, [(v, h, p) for (h, p), v in rules.items()] + [("block", *next(iter(rules)))])
    rules[next(iter(rules))] = "block"
    got = collections.Counter((r["page_id"], r["rule"], r["verdict"]) for r in url_filter.url_filter(spark.createDataFrame(urls, "page_id long, url string"), table).collect())
    want = collections.Counter()
    for i, u in urls:
        host, _, rest = u.removeprefix("https://").partition("/")
        fits = [(len(h) + n, h + ("/" + rest)[:n], rules[h, ("/" + rest)[:n]]) for h in (host.split(".", k)[-1] for k in range(host.count(".") + 1)) for n in range(len(rest) + 2) if (h, ("/" + rest)[:n]) in rules]
        want[(i, *(max(fits)[1:] if fits else (None, "allow")))] += 1
    assert got == want


# ---------------------------------------------------------------- 5


def test_op5_learns_words_it_has_not_seen(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["an", "er", "th", "in", "re", "on"]) for _ in range(rng.randrange(1, 5)))
    rows = []
    for i in range(900):
        toxic = i % 6 == 0
        w = [word() for _ in range(rng.randrange(20, 200))]
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["zquk", "vlorp"]) + word()
        rows.append((i, " ".join(w), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df, df.where(~toxicity.held_out(F.col("doc_id"))), per_class=300)
    got = toxicity.toxicity_scores(df, model).join(df, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    hits = sum(r["predicted"] == r["toxic"] for r in got)
    assert hits >= 0.95 * len(got) and sum(r["predicted"] for r in got if r["toxic"]) >= 0.85 * sum(r["toxic"] for r in got)


def test_op5_features_by_definition():
    texts = ["Äb  cdé\nÄB ÄB".encode(), None, b"", b"x"]
    owner, hashed, share = toxicity.grams(texts)
    assert set(owner.tolist()) == {0, 3}
    want = collections.Counter()
    for word in (" äb ", " cdé ", " äb ", " äb "):
        want.update(word[i : i + n] for n in toxicity.ORDERS for i in range(len(word) - n + 1))
    assert len(hashed[owner == 0]) == len(want)
    assert sorted(share[owner == 0].tolist()) == pytest.approx(sorted(1000 * n / want.total() for n in want.values()))
    only = np.zeros(toxicity.SPACE, bool)
    only[hashed[2]] = True
    assert toxicity.grams(texts, only)[2].tolist() == [share[2]]


def test_op5_scores_by_definition():
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["good", "böse", "idiot", "tree", "x"]) for _ in range(rng.randrange(30))).encode() for _ in range(20)]
    owner, hashed, share = toxicity.grams(texts)
    model = toxicity.Model(np.unique(hashed), np.linspace(-1, 1, len(np.unique(hashed))), 0.1)
    weight = dict(zip(model.ids.tolist(), model.weights.tolist()))
    for i, score in enumerate(model.scores(texts).tolist()):
        z = 0.1 + sum(weight[h] * s for o, h, s in zip(owner.tolist(), hashed.tolist(), share.tolist()) if o == i)
        assert score == pytest.approx(1 / (1 + np.exp(-z)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(-5, 5), st.integers(0, 1)), min_size=2, max_size=30).filter(lambda x: len({b for _, b in x}) == 2))
def test_op5_the_parting_place_loses_least(rows):
    z, y = (np.array(x, float) for x in zip(*rows))
    loss = lambda c: ((z < c) & (y == 1)).sum() / y.sum() + toxicity.ALARM * ((z >= c) & (y == 0)).sum() / (1 - y).sum()
    assert loss(toxicity.parting(z, y)) == pytest.approx(min(loss(c) for c in np.arange(-6, 7) + 0.5))


def test_op5_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scores = []
    for turn in (False, True):
        own = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic"))) if turn else labels
        model = toxicity.train(docs, own.where(~toxicity.held_out(F.col("doc_id"))))
        scores.append((model.ids.tolist(), model.weights.tolist(), model.bias))
    assert scores[0] == scores[1] and len(scores[0][0]) > 100


def test_op5_features_that_are_not_worth_it_change_nothing():
    rng = np.random.default_rng(2)
    rows = [{"version": i, "label": int(i % 3 == 0), "grams": np.unique(rng.integers(0, 60, 30) + 40 * (i % 3 == 0) * (rng.random() < 0.7)).astype(np.int32)} for i in range(200)]
    for r in rows:
        share = rng.random(len(r["grams"]))
        r["shares"] = (1000 * share / share.sum()).astype(np.float32)
    whole = toxicity.Sample(np.repeat(np.arange(200), [len(r["grams"]) for r in rows]), np.concatenate([r["grams"] for r in rows]), np.concatenate([r["shares"] for r in rows]), np.array([r["label"] for r in rows]))
    sample, folds = toxicity._sample(lambda: iter([r | {"grams": r["grams"].tobytes(), "shares": r["shares"].tobytes()} for r in rows]), 1 << 30)
    assert 0 < len(sample.rows) < len(whole.rows)
    a, b = toxicity.fit_and_place(sample, folds), toxicity.fit_and_place(whole, np.arange(200) % toxicity.FOLDS)
    assert a.ids.tolist() == b.ids.tolist() and a.weights == pytest.approx(b.weights) and a.bias == pytest.approx(b.bias)


def test_op5_of_several_labels_the_toxic_one_holds(spark):
    docs = spark.createDataFrame([(i, f"text {'bad' if i % 2 else 'fine'} number{i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(i, 0) for i in range(40)] + [(3, None), (None, 1), (99, 1), (5, 7)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert all(r["predicted"] == r["doc_id"] % 2 for r in toxicity.toxicity_scores(docs, model).collect())
    few = toxicity.train(docs, labels, fit_bytes=1)
    assert not len(few.ids)


def test_op5_edges(spark, edge, empty):
    df, rows = edge
    none = toxicity.train(df, df.select("doc_id", F.lit(0).alias("toxic")))
    got = toxicity.toxicity_scores(df, none).collect()
    assert len(got) == len(rows) and all(r["predicted"] == 0 and 0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity_scores(empty, none).count() == 0
    query = llm.QUERIES["op5_toxicity"](spark, DATA).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7) for r in query)


# ---------------------------------------------------------------- 7


def test_op7(spark):
    pages = [(r["page_id"], (r["html"] or "").encode()) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    last = {}
    for i, h in pages:
        last[h] = max(i, last.get(h, i))
    want = {(i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if last[h] == i else "revisit", None if last[h] == i else last[h]) for i, h in pages}
    assert {tuple(r) for r in llm.QUERIES["op7_warc"](spark, DATA).collect()} == want


def test_op7_round_trip_with_segments(spark, tmp_path):
    rows = [(1, "u", "x" * 100_000), (2, "u", "x" * 100_000), (3, None, None), (4, "a b", ""), (5, "é", "é\r\n\r\nWARC/1.1\r\n" * 9000), (None, "z", "q"), (5, "é", "é\r\n\r\nWARC/1.1\r\n" * 9000), (7, "", "q")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_warc(df, f"file://{tmp_path}/a", segment_bytes=1000, chunk_bytes=300)
    got = warc.read_warc(spark, f"file://{tmp_path}/a").collect()
    text = lambda r: None if r["payload"] is None else bytes(r["payload"]).decode()
    assert collections.Counter((r["page_id"], r["record_type"], r["refers_to"], text(r)) for r in got) == collections.Counter(
        [("1", "revisit", "2", None), ("2", "response", None, rows[1][2]), ("3", "revisit", "4", None), ("4", "response", None, ""), ("5", "response", None, rows[4][2]), ("5", "response", None, rows[4][2]), (None, "response", None, "q"), ("7", "response", None, "q")]
    )
    assert {r["page_id"]: r["payload_bytes"] for r in got}["1"] == 100_000
    warc.write_warc(df.limit(0), f"file://{tmp_path}/b")
    assert warc.read_warc(spark, f"file://{tmp_path}/b").count() == 0


@pytest.mark.parametrize("most", [8, 1 << 27])
def test_op7_pages_that_a_filter_lets_pass(spark, tmp_path, monkeypatch, most):
    """With a filter of 8 bits every page passes: responses among them are told apart exactly."""
    monkeypatch.setattr(_common.Sieve, "MOST", most)
    rows = [(i, f"u{i}", "error page" if i % 2 else f"page {i}") for i in range(60)] + [(None, "u", "error page"), (None, "u", "alone"), (59, "u59", "error page"), (4, "again", "error page"), (7, "n", None), (8, "n", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_warc(df, f"file://{tmp_path}/a")
    got = collections.Counter(tuple(r) for r in warc.read_warc(spark, f"file://{tmp_path}/a", payloads=False).select("page_id", "record_type", "refers_to", "payload_bytes").collect())
    largest = {}
    for i, _, html in rows:
        if i is not None:
            largest[html or ""] = max(i, largest.get(html or "", i))
    own = lambda i, html: i is None or i == largest[html]
    want = [(None if i is None else str(i), "response" if own(i, h or "") else "revisit", None if own(i, h or "") else str(largest[h or ""]), len(h or "")) for i, _, h in rows]
    assert got == collections.Counter(want)


def test_op7_leaves_only_its_result(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(_common, "shared_dir", lambda s: f"file://{tmp_path}")
    llm.QUERIES["op7_warc"](spark, DATA)
    assert [p.name.split("-")[1] for p in tmp_path.iterdir()] == ["pages"]


def test_op7_archives_are_bounded_however_long_the_pages(spark, tmp_path):
    import gzip

    rng = random.Random(5)
    pages = [(i, "u", "".join(rng.choice("abcdef \n") for _ in range(4096)) * 1280, "clash", 7) for i in range(3)] + [(9, "u", "small", "clash", 7)]  # 5 MB each
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload string, digest int").coalesce(1)
    warc.write_warc(df, f"file://{tmp_path}/a", records_per_file=50)
    sizes = [len(gzip.open(f).read()) for f in (tmp_path / "a").glob("*.gz")]
    assert len(sizes) >= 9 and max(sizes) <= 50 * (33 << 10)
    got = {r["page_id"]: bytes(r["payload"]) for r in warc.read_warc(spark, f"file://{tmp_path}/a").collect()}
    assert got == {str(i): h.encode() for i, _, h, _, _ in pages}


def test_op7_faults_raise():
    assert warc.unchunked(warc.chunked(b"hello world", 4)) == b"hello world" and warc.unchunked(b"5;x=y\r\nhello\r\n0\r\nT: v\r\n\r\n") == b"hello"
    with pytest.raises(ValueError):
        warc.unchunked(b"4\r\nhello\r\n0\r\n\r\n")
    (record,) = warc.records(1, b"u", b"hi", hashlib.sha1(b"hi").hexdigest(), None, "0.1", 10_000, 100)
    assert [b for _, b in warc.parse(record + b"\r\n\r\n" + record)] == [record.split(b"\r\n\r\n", 1)[1]] * 2
    with pytest.raises(ValueError):
        list(warc.parse(record[:-3]))


# ---------------------------------------------------------------- 8 and 10

ODD = st.lists(st.sampled_from(["a", "word", " ", "  ", "\n", "\n\n", "\t", ".", ",", "é", "ß", "😀", "1234", "don't", "▁", "<|endoftext|>", "<s>", "\x00", " ", "日本"]), max_size=30).map("".join)


@pytest.fixture(scope="module")
def pieces():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.PretokenCounts(path), sentencepiece.SentencePieceProcessor(model_file=path)


@settings(max_examples=400, deadline=None)
@given(text=ODD)
def test_op8_counts_as_the_library_does(pieces, text):
    assert pieces[0].count(text) == len(pieces[1].encode(text))


def test_op8(spark, documents, edge, empty, pieces):
    for df, rows in (documents, edge):
        got = collections.Counter(tuple(r) for r in token_counts.token_counts(df).collect())
        n = [len(pieces[1].encode(t or "")) for _, t in rows]
        assert got == collections.Counter((i, len((t or "").encode()), k, k > 4096) for (i, t), k in zip(rows, n))
    assert token_counts.token_counts(empty).count() == 0


@pytest.fixture(scope="module")
def byte_bpe():
    import public_tokenizers
    import tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.Encoder(path), tokenizers.Tokenizer.from_file(path)


@settings(max_examples=400, deadline=None)
@given(text=ODD)
def test_op10_ids_are_the_library_s(byte_bpe, text):
    assert byte_bpe[0].encode(text).tolist() == byte_bpe[1].encode(text, add_special_tokens=False).ids


def test_op10_other_files_go_to_the_library():
    import public_tokenizers

    e = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert e.fast is None and e.encode("Hello there").tolist() == e.model.encode("Hello there", add_special_tokens=False).ids


def check_packing(df, rows, tok, size=1024):
    out = packing.pack_documents(df, size=size).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    want = collections.defaultdict(list)
    for i, t in rows:
        want[i].append([*tok.encode(t or "", add_special_tokens=False).ids, 0])
    assert set(by_doc) == set(want)
    for i, parts in by_doc.items():
        assert sum(p["length"] for p in parts) == sum(map(len, want[i]))
        if len(want[i]) == 1:
            ids, at = [], 0
            for p in sorted(parts, key=lambda p: p["start"]):
                assert p["start"] == at and p["doc_tokens"] == len(want[i][0])
                ids += np.frombuffer(bytes(p["ids"]), "<u4").tolist()
                at += p["length"]
            assert ids == want[i][0]
    for parts in by_seq.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= size
    return len(by_seq), sum(r["length"] for r in out)


def test_op10(spark, documents, edge, empty, byte_bpe):
    n, total = check_packing(*documents, byte_bpe[1])
    assert n <= total / 1024 + 5
    check_packing(*edge, byte_bpe[1])
    assert packing.pack_documents(empty).count() == 0
    assert llm.QUERIES["op10_packing"](spark, DATA).columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_op10_the_curve_visits_every_cell_one_step_at_a_time():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    order = cells[np.argsort(packing.hilbert_keys(cells, 3))]
    assert sorted(packing.hilbert_keys(cells, 3).tolist()) == list(range(512))
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


# ---------------------------------------------------------------- 9


def base_counts(t):
    w = words(t)
    grams = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    again = {j + d for j in range(len(w) - 4) if grams[tuple(w[j : j + 5])] > 1 for d in range(5)}
    lines = [x for x in (t or "").split("\n") if x.encode().split()]
    failed = len(w) < 10 or 100 * len(again) > 20 * len(w)
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(again), failed


def test_op9(documents, edge, empty):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for df, rows in (documents, edge):
        got = quality_rules.quality_rules(df)
        assert collections.Counter(tuple(r) for r in got.select(*names).collect()) == collections.Counter((i, *base_counts(t)) for i, t in rows)
        assert got.where("kept AND base_failed").count() == 0
    assert quality_rules.quality_rules(empty).count() == 0


def own_verdict(t):
    """kept, by the definition of the method's own rules."""
    w = words(t)
    best = [0] * len(w)
    for i in range(len(w)):
        for j in range(i + 1, len(w)):
            n = 0
            while j + n < len(w) and w[i + n] == w[j + n]:
                n += 1
            best[i], best[j] = max(best[i], n), max(best[j], n)
    marked = {i + d for i, n in enumerate(best) if n >= 12 for d in range(n)}
    return not base_counts(t)[-1] and 100 * len(marked) <= 15 * len(w) and max(best, default=0) <= 100


def test_op9_kept_by_definition(spark):
    rng = random.Random(3)
    texts = []
    for i in range(120):
        w = [f"w{rng.randrange(2000)}" for _ in range(rng.randrange(8, 200))]
        for _ in range(rng.randrange(3)):
            a, n = rng.randrange(len(w)), rng.randrange(3, 40)
            w[rng.randrange(len(w)) :][:0] = w[a : a + n]
            w += w[a : a + n]
        texts.append(" ".join(w))
    texts.append(" ".join([*(f"x{i}" for i in range(2000)), *(f"x{i}" for i in range(101))]))
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: own_verdict(t) for i, t in enumerate(texts)} and not got[120] and 20 < sum(got.values()) < 110


def test_op9_memory_of_a_text_that_repeats_itself():
    import tracemalloc

    half = np.random.default_rng(1).integers(0, 2**62, 500_000).astype(np.uint64)
    tracemalloc.start()
    got = quality_rules.longest_repeats(np.concatenate([half, half]), np.array([0, 1_000_000]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[0] == got[500_000] == 500_000 and peak < 130 * 1_000_000


def test_op9_carried_columns_with_the_operator_s_names(spark):
    df = spark.createDataFrame([(1, "a b", 7, "s", 2)], "doc_id long, text string, n_words int, kept string, key int")
    row = quality_rules.quality_rules(df, carry=["n_words", "kept", "text", "doc_id", "key"]).first()
    assert (row["n_words"], row["n_words_in"], row["kept"], row["kept_in"], row["text"], row["doc_id_in"], row["key"]) == (2, 7, False, "s", "a b", 1, 2)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=5))
def test_op9_longest_repeats(docs):
    flat = np.array([x for d in docs for x in d], np.uint64)
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    want = []
    for d in docs:
        for p in range(len(d)):
            best = 0
            for q in range(len(d)):
                n = 0
                while p != q and p + n < len(d) and q + n < len(d) and d[p + n] == d[q + n]:
                    n += 1
                best = max(best, n)
            want.append(best if best >= 4 else 0)
    assert [x if x >= 4 else 0 for x in quality_rules.longest_repeats(flat, starts).tolist()] == want
