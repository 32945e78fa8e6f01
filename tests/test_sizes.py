"""What only large tables meet: large ids, many flushes, many blocks in one batch."""

import pytest
from conftest import DATA, rows_of, rows_of_sql
from pyspark.sql import functions as F

from vellum.registry import QUERIES, SQL


@pytest.mark.parametrize("name", ["list_page_created", "list_page_recent"])
def test_listings_of_large_ids(spark, tmp_path, name):
    import duckdb

    spark.read.parquet(f"{DATA}/documents.parquet").withColumn("doc_id", F.expr("doc_id + 400000")).write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES[name](spark, f"file://{tmp_path}")
    assert rows_of_sql(con, SQL[name]) == (sorted(got.columns), rows_of(got))


def test_a_listing_of_ids_whose_days_no_timestamp_holds(spark, tmp_path):
    import duckdb

    spark.read.parquet(f"{DATA}/documents.parquet").withColumn("doc_id", F.expr("doc_id + 2000000000")).write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name, day in (("list_page_recent", "written"), ("list_page_created", "day")):
        got = QUERIES[name](spark, f"file://{tmp_path}").select("id", F.unix_date(day).alias("n"))  # no Python date has such a year
        assert rows_of_sql(con, f"SELECT id, {day} - DATE '1970-01-01' AS n FROM ({SQL[name]})") == (["id", "n"], rows_of(got))


def test_the_day_of_a_time_is_floored(spark):
    from vellum.functions.numbers import effective_day

    day = 86_400_000_000_000
    times = [0, 7, day - 1, day, -1, -day, -day - 1, 1_700_000_000_123_456_789]
    for kind in ("long", "decimal(38,0)"):
        rows = spark.createDataFrame([(t,) for t in times], "t long").select("t", F.unix_date(effective_day(F.lit(None).cast("date"), F.col("t").cast(kind))).alias("n"))
        assert {r["t"]: r["n"] for r in rows.collect()} == {t: t // day for t in times}


def test_many_flushes_leave_few_folders_and_each_id_once(spark, tmp_path):
    import json

    from vellum.plans.store import MERGE, Snapshots
    from vellum.streaming.ingest import Ingest, landed_pages

    for page in range(2 * MERGE + 3):  # ids of a page come again in the next one
        (tmp_path / "pages").mkdir(exist_ok=True)
        (tmp_path / f"pages/{page}.json").write_text(json.dumps({"items": [{"n": 8 * page + i} for i in range(10)]}))
    store = Snapshots(spark, f"file://{tmp_path}/store", "id string, n long")
    job = Ingest(store, "feed", lambda part: part.select(F.format_string("note-%d", "item.n").alias("id"), F.col("item.n").alias("n")), flush=4)
    job.start(landed_pages(spark, f"file://{tmp_path}/pages", "struct<n: bigint>", max_files=1), f"file://{tmp_path}/cp").awaitTermination()
    assert sorted(r["n"] for r in store.read().collect()) == list(range(8 * (2 * MERGE + 3) + 2))
    at = store.pointer()
    assert len(at["dirs"]) == 5 and at["version"] == 2 * MERGE + 3 + 2  # a commit for each batch and each merge


def test_costs_of_words_are_kept_not_made_again(monkeypatch):
    from vellum.operators import chunking

    walked = []
    monkeypatch.setattr(chunking, "_RUN", type("Runs", (), {"findall": lambda self, t, run=chunking._RUN: walked.append(len(t)) or run.findall(t)})())
    body = "\n".join("quaint words that come again, line by line." for _ in range(400))
    assert len(chunking.chunk_markdown(body, window=128)) > 20
    assert sum(walked) < 1000  # of 17,600 letters


def test_sizes_from_the_ruler_are_those_of_the_text():
    from vellum.operators import chunking as c

    for body in ("plain words here.\nand\tmore\x0bof them", "with\xa0odd spaces\x1cbetween, all over", "x" * 500 + " tail", "```\ncode is here\n```\nbehind it", "a\n\n| h |\n|-|\n| cell |\n\nb"):
        seen = c.Outline(body)
        ruler = c.Ruler(seen, 0, len(seen.lines), 60, c.estimate_tokens)
        for i in range(len(ruler.begin)):
            for j in range(i + 1, len(ruler.begin) + 1):
                text = ruler.text(i, j)
                assert ruler.size(i, j, text) == c._tokens(sum(map(c._cost, c._RUN.findall(text))))


def test_a_block_of_chunks_is_sent_once_for_a_strip_of_questions(spark, monkeypatch):
    import numpy as np

    from vellum.operators import retrieval

    sent, blocks = {}, retrieval._blocks
    monkeypatch.setattr(retrieval, "_blocks", lambda df, size, name: sent.setdefault(name, blocks(df, size, name)))
    at = np.random.default_rng(5).normal(size=(700, 3))
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(at)], "id long, vector array<double>")
    got = retrieval.knn(rows, rows.where("id < 300").select(F.col("id").alias("qi"), F.col("vector").alias("qv")), 3).collect()
    dist = ((at[:300, None] - at[None]) ** 2).sum(2)
    assert {(r["qi"], r["rank"], r["id"]) for r in got} == {(q, k + 1, int(i)) for q in range(300) for k, i in enumerate(np.argsort(dist[q], kind="stable")[:3])}
    assert sent["queries"].count() == 1


def test_short_words_are_counted_together(spark):
    from vellum.operators import chunking as c

    texts = ["ab1cd", "12ab34", "a I be", "word Words wOrd WORD ab\U0001f600cd", "sevenle eightlet", "x.yz,Ab-cD", "\xa0ab\x1ccd\n\tef", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", c.token_estimate(F.col("t")).alias("n"))
    assert {r["i"]: r["n"] for r in rows.collect()} == {i: c.estimate_tokens(t or "") for i, t in enumerate(texts)}
    assert "regexp_count" in rows._jdf.queryExecution().analyzed().toString().lower()


def test_a_word_of_many_texts_is_hashed_once(monkeypatch):
    import zlib

    import numpy as np

    from vellum.plans import search

    hashed, crc32 = [], zlib.crc32
    monkeypatch.setattr(zlib, "crc32", lambda b: hashed.append(b) or crc32(b))
    texts = ["One two, two\nthree 4x", "", None, "three é two " * 50]
    got = search.hashed_words(texts, 8)
    assert sorted(hashed) == [b"4x", b"one", b"three", b"two"]
    for row, text in zip(got, ["one two two three 4x", "", "", "three two " * 50], strict=True):
        counts = np.zeros(8, np.float32)
        for w in text.split():
            counts[crc32(w.encode()) % 8] += 1
        assert row.tolist() == (counts / (np.linalg.norm(counts) or 1)).astype(np.float32).tolist()


def test_a_task_has_few_blocks_of_chunks(spark, monkeypatch):
    """However few files the vectors stand in: Spark hands the pairs of a task to Python in one batch."""
    import numpy as np

    from vellum.operators import retrieval

    monkeypatch.setattr(retrieval, "CHUNK_BLOCK", 50)
    pairs, nearest = [], retrieval._nearest

    def counted(k, vector, key):
        def each(batches):
            for batch in batches:
                assert batch.num_rows <= 4, f"{batch.num_rows} pairs of blocks in one batch"
                yield from nearest(k, vector, key)([batch])

        pairs.append(1)
        return each

    monkeypatch.setattr(retrieval, "_nearest", counted)
    at = np.random.default_rng(7).normal(size=(1000, 3))
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(at)], "id long, vector array<double>").coalesce(1)
    got = retrieval.knn(rows, rows.where("id % 50 = 0").select(F.col("id").alias("qi"), F.col("vector").alias("qv")), 3).collect()
    dist = ((at[::50, None] - at[None]) ** 2).sum(2)
    assert pairs and {(r["qi"], r["rank"], r["id"]) for r in got} == {(50 * q, k + 1, int(i)) for q in range(20) for k, i in enumerate(np.argsort(dist[q], kind="stable")[:3])}


def _prose(texts, copies):
    import random

    rng = random.Random(11)
    bodies = [[f"w{rng.randrange(3000)}" for _ in range(120)] for _ in range(texts)]
    near = [[*b[:60], "odd", *b[60:]] for b in bodies[: texts // 2]]
    return [(i, " ".join(b)) for i, b in enumerate((bodies + near) * copies)], texts, texts // 2


def test_signatures_are_shuffled_slice_by_slice(spark, monkeypatch):
    """The index of all texts is no grouped row, and a slice of it has its share of the signatures."""
    import pyarrow as pa

    from vellum.llm import _common, ngram_join

    rows, texts, near = _prose(40, 3)
    batch = pa.record_batch([pa.array([i for i, _ in rows]), pa.array([t.encode() for _, t in rows])], names=["doc_id", "text"])
    (index,) = ngram_join._index(5, 80)(iter([batch]))
    sizes = [len(index.column(f"sigs{i}").flatten()) for i in range(ngram_join.SLICES)]
    assert len(sizes) > 1 and max(sizes) < 1.5 * sum(sizes) / len(sizes)

    plans, keep = {}, ngram_join.Workspace.keep
    monkeypatch.setattr(ngram_join.Workspace, "keep", lambda self, df, name: plans.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(self, df, name))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (_common.Sieve.MOST, 64):  # the second filter lets everything pass
        monkeypatch.setattr(_common.Sieve, "MOST", most)
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_jaccard_join(docs, words=5, percent=80, count_links=False).collect()}
        first = {i: (i % (texts + near)) % texts for i in got}
        assert got == first
    assert len(plans["slice"]) == 2 * ngram_join.SLICES
    moved = [line for some in plans.values() for plan in some for line in plan.splitlines() if any(x in line for x in ("Aggregate", "Join", "Sort", "Repartition")) and "sigs" in line]
    assert not moved, moved[0]


def test_rows_that_stay_are_not_shuffled(spark):
    from vellum.llm._common import without

    rows = spark.createDataFrame([(i if i % 97 else None, f"text {i}") for i in range(2000)], "doc_id long, text string")
    gone = rows.where("doc_id % 50 = 7").select("doc_id")
    left = without(rows, gone)
    assert sorted(r["text"] for r in left.collect()) == sorted(f"text {i}" for i in range(2000) if not i % 97 or i % 50 != 7)
    through = left.where("doc_id IS NULL OR doc_id % 50 <> 7")._jdf.queryExecution().optimizedPlan().toString()
    assert through.count("Join") == 1 and "Union" in through


def test_chunks_are_judged_beside_their_text(spark):
    """Nothing is shuffled, and each row is judged by its own text, also where rows repeat an id or have none."""
    import tempfile

    from vellum.queries.retrieval import chunk_invariants

    top = tempfile.mkdtemp()
    rows = [(1, "One line. " * 300), (1, "# Head\nsome words\n" * 40), (None, "no id here"), (2, None), (3, " \n\t"), (4, "a\xa0b # c " * 100)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{top}/documents.parquet")
    got = chunk_invariants(spark, f"file://{top}")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, got.collect())) == sorted(f"Row(doc_id={i}, lost=0, invented=0, too_long=0, numbered=True)" for i in (1, 1, 4, None))


def test_texts_stay_where_they_are_until_they_are_shown(spark, tmp_path, monkeypatch):
    """No exchange carries texts of chunks: neither when they are cut, nor when a question's best are shown; words are shuffled in slices."""
    import re

    from vellum.plans import keyword_index, search
    from vellum.queries.retrieval import NOW, notes_of

    def moved(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return [x for x in re.findall(r"Exchange hashpartitioning.*|SortMergeJoin.*", plan)]

    rows = search.index_rows(notes_of(spark, DATA))
    assert not moved(rows)
    rows.limit(300).write.parquet(f"file://{tmp_path}/chunks")
    chunks, index = spark.read.parquet(f"file://{tmp_path}/chunks"), keyword_index.KeywordIndex(spark, f"file://{tmp_path}/index")
    written, write = [], keyword_index._Segments._write
    monkeypatch.setattr(keyword_index._Segments, "_write", lambda self, df, name=None: written.append(name) or write(self, df, name))
    monkeypatch.setattr(keyword_index, "SLICE", 30_000)
    index.add(chunks)
    assert len(written) > 2 and len(set(written[1:])) == 1
    assert {p.name[:5] for p in (tmp_path / "index").iterdir() if p.is_dir()} == {"part-"}
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(["the first words", "other text of them"])], "qi long, query string")
    found = search.search_many(chunks, asked, now=NOW, k=3, index=index)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("excerpt")].count("Window")
    assert not above and "strategy=broadcast" in plan[plan.index("excerpt") :][:20000]
    assert found.groupBy("qi").count().where("count > 3").isEmpty() and found.where("length(excerpt) = 0").isEmpty() and found.count() > 0
