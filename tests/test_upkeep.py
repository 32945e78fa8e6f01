"""Reindexing, landed pages, ingest and free names."""

import json
from collections import Counter

import pytest
from conftest import DATA, rows_of, rows_of_sql
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.operators.names import free_names
from vellum.plans.keyword_index import KeywordIndex
from vellum.plans.reindex import Reindex, Reindexed
from vellum.plans.store import Snapshots
from vellum.queries import QUERIES, SQL
from vellum.sources.paged import read_pages
from vellum.streaming.ingest import Ingest, landed_pages


@pytest.mark.parametrize("name", ["reindex_states", "paged_events", "ingest_events", "free_titles"])
def test_queries_and_statements(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    assert rows_of_sql(duck, SQL[name]) == (sorted(got.columns), rows_of(got))


# ---------------------------------------------------------------- reindex

ROW = "id string, path string, note_id string, search_text string, mtime double"


class Vault:
    """Files in memory: path -> (mtime, id, text, error)."""

    def __init__(self, spark, tmp_path, words=False):
        self.spark, self.files_now, self.on_read, self.reads = spark, {}, None, []
        self.store = Snapshots(spark, f"file://{tmp_path}/store", ROW)
        self.words = KeywordIndex(spark, f"file://{tmp_path}/words") if words else None
        self.job = Reindex(spark, self.store, f"file://{tmp_path}/work", files=self.files, read=self.read, rows=self.rows, words=self.words)

    def files(self):
        return self.spark.createDataFrame([(p, f[0]) for p, f in self.files_now.items()], "path string, mtime double")

    def read(self, paths):
        asked = [r["path"] for r in paths.collect()]
        self.reads.append(sorted(asked))
        got = self.spark.createDataFrame([(p, *self.files_now[p]) for p in asked], "path string, mtime double, id string, text string, error string")
        if self.on_read:
            self.on_read()
        return got

    def rows(self, notes):
        return notes.select(F.concat("id", F.lit("@"), "path").alias("id"), "path", F.col("id").alias("note_id"), F.col("text").alias("search_text"), "mtime")

    def held(self):
        return {r["path"]: (r["mtime"], r["search_text"]) for r in self.store.read().collect()}


def test_only_what_changed_is_read(spark, tmp_path):
    v = Vault(spark, tmp_path)
    v.files_now = {f"{i}.md": (1.0, f"n{i}", f"text {i}", None) for i in range(6)}
    assert v.job.run(now=100.0) == Reindexed(indexed=6)
    assert v.job.run(now=100.0) == Reindexed(unchanged=6) and len(v.reads) == 1
    v.files_now["1.md"] = (2.0, "n1", "new 1", None)
    v.files_now["bad.md"] = (2.0, None, None, "no front matter")
    del v.files_now["2.md"]
    assert v.job.run(now=100.0) == Reindexed(unchanged=4, indexed=1, removed=1, skipped=1)
    assert v.reads[-1] == ["1.md", "bad.md"] and v.held() == {"0.md": (1.0, "text 0"), "1.md": (2.0, "new 1"), **{f"{i}.md": (1.0, f"text {i}") for i in (3, 4, 5)}}
    assert v.job.run(now=100.0, force=True).indexed == 5


def test_files_that_change_while_they_are_read_come_again(spark, tmp_path):
    v = Vault(spark, tmp_path)
    v.files_now = {p: (1.0, p, "old", None) for p in "abc"}
    v.job.run(now=100.0)
    v.files_now |= {p: (2.0, p, "new", None) for p in "abc"}

    def meanwhile():
        v.files_now["b"] = (3.0, "b", "newer", None)
        v.files_now.pop("c", None)

    v.on_read = meanwhile
    assert v.job.run(now=100.0) == Reindexed(indexed=1, requeued=2)
    assert v.held() == {"a": (2.0, "new"), "b": (1.0, "old"), "c": (1.0, "old")}
    v.on_read = None
    assert v.job.run(now=100.0) == Reindexed(unchanged=1, indexed=1, removed=1)
    assert v.held() == {"a": (2.0, "new"), "b": (3.0, "newer")}


def test_files_written_just_now_are_read_again(spark, tmp_path):
    v = Vault(spark, tmp_path)
    v.files_now = {"a": (99.0, "a", "x", None), "b": (50.0, "b", "x", None)}
    assert v.job.run(now=100.0).indexed == 2
    assert v.job.run(now=110.0) == Reindexed(unchanged=1, indexed=1)
    assert v.job.run(now=110.0) == Reindexed(unchanged=2)


def test_a_folder_that_is_not_all_there_loses_nothing_but_moved_notes(spark, tmp_path):
    v = Vault(spark, tmp_path)
    v.files_now = {f"{i}.md": (1.0, f"n{i}", "x", None) for i in range(60)}
    v.job.run(now=100.0)
    v.files_now = {"moved.md": (2.0, "n7", "moved", None)}
    assert v.job.run(now=100.0) == Reindexed(indexed=1, spared=60)
    assert len(v.held()) == 60 and "7.md" not in v.held() and v.held()["moved.md"] == (2.0, "moved")


def test_large_changes_are_left_to_another_run_and_words_follow(spark, tmp_path):
    v = Vault(spark, tmp_path, words=True)
    v.files_now = {f"{i}.md": (1.0, f"n{i}", f"word{i} same", None) for i in range(5)}
    assert v.job.run(now=100.0, defer_over=4) == Reindexed(deferred=5) and v.held() == {}
    v.job.run(now=100.0)
    v.files_now["0.md"] = (2.0, "n0", "other same", None)
    del v.files_now["1.md"]
    v.job.run(now=100.0)
    asked = spark.createDataFrame([(0, "word0"), (1, "word1"), (2, "other"), (3, "word2")], "qi int, query string")
    assert {(r["qi"], r["id"]) for r in v.words.search(asked, 5).collect()} == {(2, "n0@0.md"), (3, "n2@2.md")}
    v.words.remove(spark.createDataFrame([("n2@2.md",)], "id string"))
    v.job.rebuild_words()
    assert {r["id"] for r in v.words.search(asked, 5).where("qi = 3").collect()} == {"n2@2.md"}


def test_a_stream_of_changes_runs_for_its_paths(spark, tmp_path):
    v = Vault(spark, tmp_path)
    v.files_now = {p: (1.0, p, "x", None) for p in "abcd"}
    spark.createDataFrame([("a",), ("b",), ("a",)], "path string").write.parquet(f"file://{tmp_path}/changes")
    told = []
    stream = lambda: spark.readStream.schema("path string").parquet(f"file://{tmp_path}/changes")
    v.job.on_stream(stream(), f"file://{tmp_path}/cp", told=told.append).awaitTermination()
    assert set(v.held()) == {"a", "b"} and sum(t.indexed for t in told) == 2
    v.job.on_stream(stream(), f"file://{tmp_path}/other", told=told.append).awaitTermination()  # handed over again
    assert sum(t.indexed for t in told) == 2 and len(v.held()) == 2


def test_a_folder_of_notes_from_files_to_answers(spark, tmp_path):
    import os
    import time

    from vellum.plans import search
    from vellum.plans.reindex import of_vault

    def note(path, text, age=100.0):
        file = tmp_path / "vault" / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(f"---\nid: {file.stem}\ntype: technique\ntitle: About {file.stem}\n---\n\n{text}\n")
        os.utime(file, (time.time() - age,) * 2)

    note("technique/one.md", "Cookies that crumble in the sandwich.")
    note("technique/two.md", "Parsers that quarrel about a header.")
    note("Templates/no.md", "never seen")
    (tmp_path / "vault/technique/broken.md").write_text("no front matter")
    os.utime(tmp_path / "vault/technique/broken.md", (1e9, 1e9))
    job = of_vault(spark, f"file://{tmp_path}/vault", f"file://{tmp_path}/index")
    assert job.run() == Reindexed(indexed=2, skipped=1)
    asked = spark.createDataFrame([(0, "crumble"), (1, "gargoyle")], "qi int, query string")
    found = lambda: {(r["qi"], r["id"].split("::")[0]) for r in job.words.search(asked, 3).collect()}
    assert found() == {(0, "one")}
    note("technique/two.md", "A gargoyle.", age=50.0)
    note("technique/three.md", "Another gargoyle, with cookies.")
    (tmp_path / "vault/technique/one.md").unlink()
    assert job.run() == Reindexed(indexed=2, removed=1, skipped=1)
    assert found() == {(1, "two"), (1, "three")}
    best = search.search_many(job.store.read(), asked, now=0.0, k=2, index=job.words).where("qi = 1").orderBy("rank").collect()
    assert {r["note_id"] for r in best} == {"two", "three"}
    with pytest.warns(RuntimeWarning, match="vectors only"):
        alone = search.search_many(job.store.read(), asked, now=0.0, k=2, index=KeywordIndex(spark, f"file://{tmp_path}/nowhere"))
    assert alone.where("qi = 1").count() == 2
    filtered = search.search_many(job.store.read(), asked, now=0.0, k=2, filters={"type": "report"}, index=job.words)
    assert filtered.count() == 0


# ---------------------------------------------------------------- landed pages


def land(top, window, page, items, total):
    (top / window).mkdir(parents=True, exist_ok=True)
    (top / window / f"{page}.json").write_text(json.dumps({"items": items, "total": total}))


def test_pages_by_window_with_faults_and_resume(spark, tmp_path):
    for w in ("2024-01", "2024-02"):
        for p in range(12):
            land(tmp_path, w, p, [{"id": f"{w}/{p}/{i}"} for i in range(3)], 36)
    land(tmp_path, "2024-03", 0, [{"id": "x"}], 5)
    (tmp_path / "2024-02/4.json").unlink()
    (tmp_path / "2024-02/7.json").write_text("no json")
    rows = read_pages(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 3
    assert {(r["window"], r["page"], r["fault"]) for r in rows.where("fault IS NOT NULL").collect()} == {("2024-02", 4, "missing page"), ("2024-02", 7, "unreadable page: JSONDecodeError"), ("2024-03", None, "1 items of 5")}
    got = [json.loads(r["item"])["id"] for r in rows.where("fault IS NULL").orderBy("window", "page", "position").collect()]
    assert len(got) == 36 + 30 + 1 and got[:36] == [f"2024-01/{p}/{i}" for p in range(12) for i in range(3)]
    rest = read_pages(spark, f"file://{tmp_path}", after="2024-02/9").where("fault IS NULL")
    assert {(r["window"], r["page"]) for r in rest.select("window", "page").collect()} == {("2024-02", 10), ("2024-02", 11), ("2024-03", 0)}
    assert read_pages(spark, str(tmp_path), after="2024-03/0").where("item IS NOT NULL").count() == 0


# ---------------------------------------------------------------- ingest


def test_rows_saved_before_a_failure_stay_and_nothing_comes_twice(spark, tmp_path):
    for p in range(10):
        land(tmp_path / "pages", "w", p, [{"n": 100 * p + i} for i in range(100)] + ([{"n": 5}] if p == 9 else []), 1001)
    store = Snapshots(spark, f"file://{tmp_path}/store", "id string, n long")
    broken = F.udf(lambda n: 1 / 0 if n == 450 else n, "long")
    rows = lambda bad: lambda part: part.select(F.format_string("note-%d", "item.n").alias("id"), (broken("item.n") if bad else F.col("item.n")).alias("n"))
    source = lambda: landed_pages(spark, f"file://{tmp_path}/pages", "struct<n: bigint>", max_files=7)
    with pytest.raises(Exception, match="ZeroDivision|division by zero|FAILED|failed"):
        Ingest(store, "feed", rows(True)).start(source(), f"file://{tmp_path}/cp").awaitTermination()
    assert sorted(r["n"] for r in store.read().collect()) == list(range(400))
    Ingest(store, "feed", rows(False)).start(source(), f"file://{tmp_path}/cp").awaitTermination()
    assert sorted(r["n"] for r in store.read().collect()) == list(range(1000))  # 5 came again and was known
    version = store.pointer()["version"]
    Ingest(store, "feed", rows(False)).start(source(), f"file://{tmp_path}/cp").awaitTermination()
    assert store.pointer()["version"] == version


# ---------------------------------------------------------------- free names


def by_definition(wanted, taken):
    slots, out = {}, Counter()
    for title, n, i in taken:
        if n >= 1:
            slots.setdefault(title or "", {}).setdefault(n, set()).add(i)
    own = {}
    for title, at in slots.items():
        for n, ids in at.items():
            for i in ids - {None}:
                own[title, i] = min(n, own.get((title, i), n))
    for i, title, _ in sorted(wanted, key=lambda w: w[2]):
        title = title or ""
        n = own.get((title, i))
        if n is None:
            n = next(k for k in range(1, 10**6) if k not in slots.setdefault(title, {}))
            slots[title][n] = {i}
        out[i, n, title if n == 1 else f"{title} ({n})", title] += 1
    return out


def keeper(spark, tmp):
    import uuid

    def keep(df, name):
        path = f"file://{tmp}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep


def test_free_names_with_a_very_common_title(spark, tmp_path):
    wanted = [(i, "hot" if i % 3 else f"t{i % 7}", 10_000 - i) for i in range(1500)]
    taken = [("hot", n, None) for n in range(1, 900, 2)] + [("hot", 10**9, 1), ("hot", 700, 2), ("hot", 701, 2), ("t1", 1, None), ("t2", 2, 9), ("t3", 1, 5000), ("t3", 1, 5001), ("t4", 0, 12)]
    got = free_names(spark.createDataFrame(wanted, "id long, title string, seq long"), spark.createDataFrame(taken, "title string, n long, id long"), keeper(spark, tmp_path))
    assert rows_of(got.select("id", "n", "name", "title")) == by_definition(wanted, taken)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["a", "b", "", None]), max_size=25), st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 12), st.sampled_from([None, 0, 1, 2])), max_size=12))
def test_free_names_by_definition(spark, tmp_path, titles, taken):
    wanted = [(i, t, i) for i, t in enumerate(titles)]
    got = free_names(spark.createDataFrame(wanted, "id long, title string, seq long"), spark.createDataFrame(taken, "title string, n long, id long"), keeper(spark, tmp_path))
    assert rows_of(got.select("id", "n", "name", "title")) == by_definition(wanted, taken)
