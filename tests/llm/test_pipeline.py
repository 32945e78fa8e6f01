"""The pipeline against a plain reading of its stages, and the contract of the entry."""

import random

import pytest
from conftest import DATA
from test_operators import base_counts, check_packing, components, removed, words

import corpus_pipeline
from vellum.llm.decontamination import PLAIN


def test_pipeline(spark):
    import tokenizers
    import public_tokenizers

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "decontamination", "packing"]

    out = corpus_pipeline.quality(spark, docs, DATA).cache()
    kept = {r["doc_id"]: r["text"] for r in out.collect()}
    assert out.columns == columns
    assert {i for i, t in rows if not base_counts(t)[-1]} >= set(kept) and all(kept[i] == t for i, t in rows if i in kept)

    out = corpus_pipeline.near_duplicates(spark, out, DATA).cache()
    top = components(sorted(kept.items()), 5, 80)
    assert out.columns == columns and {r["doc_id"] for r in out.collect()} == {i for i in kept if top[i] == i}
    kept = {i: t for i, t in kept.items() if top[i] == i}

    out = corpus_pipeline.repeated_passages(spark, out, DATA).cache()
    gone = {i: (n, r) for i, n, r, _ in removed(sorted(kept.items()))}
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert out.columns == columns and set(got) == {i for i, (n, r) in gone.items() if n > r}
    assert all(len(words(t)) == gone[i][0] - gone[i][1] and (gone[i][1] == 0 or n == len(t)) for i, (t, n) in got.items())

    out = corpus_pipeline.decontamination(spark, out, DATA).cache()
    norm = lambda t: b" " + b" ".join(t.encode().translate(PLAIN).split()) + b" "
    items = [norm(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    left = {r["doc_id"]: r["text"] for r in out.collect()}
    assert out.columns == columns and set(left) == {i for i, (t, _) in got.items() if not any(x in norm(t) for x in items)}

    check_packing(out, sorted(left.items()), tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    packed = corpus_pipeline.run(spark, DATA)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(left)
    assert packed.agg({"length": "sum"}).first()[0] == packed.select("doc_id", "doc_tokens").distinct().agg({"doc_tokens": "sum"}).first()[0]


def test_the_entry_has_every_query():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {f"op{n}_" for n in range(1, 11)} <= {f"{x.split('_')[0]}_" for x in names}


KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, copies."""
    rng = random.Random(2)
    prose = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    long, passage = prose(20_000), prose(60)
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (3, " \n ", "en", "s", 3), (4, long, "en", None, 9), (5, long, "de", "s", 9), (5, long, "de", "s", 9), (6, passage, "en", "s", 1), (7, f"{prose(40)} {passage} {prose(40)}", "en", "s", 1)]
    rows += [(None, passage, "en", "s", 1), (None, None, None, None, None), (8, prose(30), "en", "s", 1), (8, prose(30), "en", "s", 2)]
    return spark.createDataFrame(rows, KIND)


def test_stages_on_odd_rows(spark, odd, tmp_path):
    items = ["w1 " * 20, odd.where("doc_id = 6").first()["text"]]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    where, ids = str(tmp_path), lambda df: sorted((r["doc_id"] for r in df.collect()), key=lambda x: (x is None, x))
    assert ids(corpus_pipeline.quality(spark, odd, where)) == [4, 5, 5, 6, 7, 8, 8, None]
    assert ids(corpus_pipeline.near_duplicates(spark, odd, where)) == [1, 2, 3, 4, 6, 7, 8, 8, None, None]
    cut = corpus_pipeline.repeated_passages(spark, odd, where)
    assert ids(cut) == [1, 2, 3, 4, 6, 7, 8, 8, None, None]
    seven = cut.where("doc_id = 7").first()
    assert len(seven["text"].split()) == 80 and seven["n_chars"] == len(seven["text"])
    assert [tuple(r) for r in cut.where("doc_id IN (1, 2)").orderBy("doc_id").collect()] == [(1, None, "en", "s", 0), (2, "", None, None, None)]
    assert ids(corpus_pipeline.decontamination(spark, odd, where)) == [1, 2, 3, 4, 5, 5, 8, 8, None]
    packed = corpus_pipeline.packing(spark, odd, where)
    assert {r["doc_id"] for r in packed.collect()} == {*range(1, 9), None}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), where).count() == 0


def test_run_leaves_only_its_result(spark):
    from pathlib import Path

    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = {p.name for p in shared.iterdir()}
    corpus_pipeline.run(spark, DATA)
    (left,) = {p.name for p in shared.iterdir()} - before
    assert [p.name for p in (shared / left).iterdir()] == ["4-packing"]
