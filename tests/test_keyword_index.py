"""The stored keyword index against BM25 over the documents that are there."""

import random
from collections import Counter

import pytest
from conftest import DATA, rows_of, rows_of_sql
from pyspark.sql import functions as F

from vellum.operators.retrieval import bm25
from vellum.plans.keyword_index import GONE, KeywordIndex
from vellum.queries import SQL
from vellum.queries import retrieval as queries

WORDS = ["the", "of", "alpha", "beta", "gamma", "delta", "Epsilon", "zéta", "x1", "y2"] + [f"w{i}" for i in range(60)]


def docs_of(spark, rng, ids, words=40):
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    return spark.createDataFrame([(i, " ".join(rng.choices(WORDS, weights, k=rng.randrange(1, words)))) for i in ids], "id long, search_text string")


def questions(spark, rng, n=6):
    rows = [(i, " ".join(rng.sample(WORDS, rng.randrange(1, 8)))) for i in range(n)] + [(n, ""), (n + 1, None), (n + 2, "nowhere found"), (n + 3, "the the THE of")]
    return spark.createDataFrame(rows, "qi int, query string")


def same(index, docs, asked, k):
    want = bm25(docs, asked, k).select("qi", "id", "score", "rank")
    assert rows_of(index.search(asked, k).select("qi", "id", "score", "rank")) == rows_of(want)


def test_query_and_statement(spark, duck):
    got = queries.bm25_indexed(spark, DATA)
    assert rows_of_sql(duck, SQL["bm25_indexed"]) == (sorted(got.columns), rows_of(got))


@pytest.mark.parametrize("block, k", [(4, 3), (128, 10)])
def test_segments_replacements_and_removals(spark, tmp_path, block, k):
    rng = random.Random(block)
    index = KeywordIndex(spark, f"file://{tmp_path}/index", "long", block=block, buckets=4)
    asked = questions(spark, rng)
    assert index.search(asked, k).count() == 0  # nothing there yet
    first, second = docs_of(spark, rng, range(80)), docs_of(spark, rng, range(80, 120))
    index.add(first)
    same(index, first, asked, k)
    index.add(second)  # new rows are found, nothing is rebuilt
    there = first.unionByName(second)
    same(index, there, asked, k)
    new = docs_of(spark, rng, range(60, 90))
    index.add(new)  # 30 ids get new words
    there = there.join(new.select("id"), "id", "left_anti").unionByName(new)
    same(index, there, asked, k)
    index.remove(spark.createDataFrame([(i,) for i in (0, 1, 65, 119, 999)], "id long"))
    there = there.where("id NOT IN (0, 1, 65, 119)")
    same(index, there, asked, k)
    stats = index.stats().first()
    assert stats["n"] == there.count() and len(index.store.pointer()["dirs"]) == 4
    index.compact()
    assert len(index.store.pointer()["dirs"]) == 1 and index.store.read().where(F.col("term") == GONE).count() == 0
    same(index, there, asked, k)


def test_odd_documents(spark, tmp_path):
    index = KeywordIndex(spark, f"file://{tmp_path}/index")
    docs = spark.createDataFrame([("a", None), ("b", ""), ("c", "word"), (None, "word"), ("d", "word word"), ("d", "a longer word")], "id string, search_text string")
    index.add(docs)
    asked = spark.createDataFrame([(1, "word")], "qi int, query string")
    same(index, spark.createDataFrame([("a", ""), ("b", ""), ("c", "word"), ("d", "word word")], "id string, search_text string"), asked, 5)
    index.add(docs.limit(0))
    assert index.search(asked, 5).count() == 2


def test_long_tails_are_not_read(spark, tmp_path):
    """A rare word decides; of the frequent one only the blocks that can matter are decoded."""
    rows = [(i, "common " * (1 + i % 9) + f"filler{i} " * (i % 7)) for i in range(3000)] + [(5000 + i, "common rare rare rare") for i in range(12)]
    docs = spark.createDataFrame(rows, "id long, search_text string")
    index = KeywordIndex(spark, f"file://{tmp_path}/index", "long", block=16)
    index.add(docs)
    asked = spark.createDataFrame([(1, "common rare")], "qi int, query string")
    same(index, docs, asked, 5)
    assert index.blocks_of(asked).count() > 150 and sum(r.count() for r in index.read_blocks) < 40


def test_the_scan_reads_the_terms_partitions_and_row_groups(spark, tmp_path):
    rng = random.Random(9)
    index = KeywordIndex(spark, f"file://{tmp_path}/index", "long")
    index.add(docs_of(spark, rng, range(50)))
    plan = index.blocks_of(spark.createDataFrame([(1, "alpha beta")], "qi int, query string"))._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [alpha,beta])" in plan.replace("beta,alpha", "alpha,beta") and "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters")[1][:60]


def test_two_writers(spark, tmp_path):
    a, b = (KeywordIndex(spark, f"file://{tmp_path}/index", "long") for _ in range(2))
    rng = random.Random(2)
    first, second = docs_of(spark, rng, range(10)), docs_of(spark, rng, range(10, 20))
    a.add(first)
    b.add(second)
    assert Counter(r["id"] for r in a._sizes(a.store.read()).collect()) == Counter(range(20))


def test_pieces_are_shuffled_and_blocks_follow_the_runs(spark, tmp_path, monkeypatch):
    """Postings are packed before the shuffle, whatever the tasks and batches; blocks of a term do not repeat the runs of others."""
    from vellum.plans import keyword_index

    monkeypatch.setattr(keyword_index, "PACK", 500)
    rows = [(i, "common " * (1 + i % 3) + f"w{i % 7} x{i}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "id long, search_text string").repartition(4)
    index = KeywordIndex(spark, f"file://{tmp_path}/index", "long", block=8, buckets=2)
    words = docs.select("id", index._run().alias("run"), F.split("search_text", " ").alias("w"))
    pieces = words.mapInArrow(keyword_index._pieces(8, 256), "term string, n int, low_run int, ids array<bigint>, tfs array<int>, dls array<int>, at array<int>")
    assert pieces.where("term = 'common'").count() < 2000 / 5  # rows of the shuffle
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)  # pieces of a term come in several batches
    try:
        index.add(docs)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    blocks = index.store.read().where("term = 'common'").collect()
    assert sum(b["n"] for b in blocks) == 2000 == len({i for b in blocks for i in b["ids"]}) and max(b["n"] for b in blocks) == 8
    assert sum(b["high_run"] - b["low_run"] for b in blocks) < 3 * 256
    assert index.store.read().where("term = ''").agg(F.sum("n")).first()[0] == 2000
    same(index, docs, spark.createDataFrame([(1, "common w3 x17")], "qi int, query string"), 5)
