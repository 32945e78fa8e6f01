"""Article extraction: the statement, the best run by trying all runs, and how much of bodies is kept and of furniture dropped."""

import random
import re

import pytest
from conftest import DATA, rows_of, rows_of_sql
from pyspark.sql import functions as F

from vellum.functions.text import article_blocks, best_run
from vellum.queries import QUERIES, SQL
from vellum.sources.pages import extract_article


def test_statement(spark, duck):
    got = QUERIES["extract_article"](spark, DATA)
    assert rows_of_sql(duck, SQL["extract_article"]) == (sorted(got.columns), rows_of(got))


def test_the_best_run_of_all(spark):
    rng = random.Random(1)
    rows = [[], [0], [-5], [3, -3, 3], [0, 0, 4]] + [[rng.randrange(-9, 10) for _ in range(rng.randrange(1, 12))] for _ in range(200)]
    df = spark.createDataFrame([(i, [("", w) for w in r]) for i, r in enumerate(rows)], "i int, b array<struct<text: string, worth: int>>")
    for r in df.select("i", best_run(F.col("b")).alias("r")).collect():
        w, got = rows[r["i"]], r["r"]
        runs = [(sum(w[a:b]), -b, a) for a in range(len(w)) for b in range(a + 1, len(w) + 1)]
        best = max([x for x in runs if x[0] > 0], default=None)
        assert (got["best"], got["first"], got["last"]) == ((best[0], best[2] + 1, -best[1]) if best else (0, 0, 0))


@pytest.mark.parametrize("html, want", [(None, ""), ("", ""), ("<p>short</p>", "short"), ("plain &amp; text", "plain & text")])
def test_pages_without_an_article(spark, html, want):
    assert extract_article(spark.createDataFrame([(html,)], "html string")).first()["article"] == want


def test_blocks_and_their_worth(spark):
    page = "<head><title>t</title></head><div>one <a href='/x'>two</a> three</div><!-- <p>no</p> --><script>if (a<b) c</script><p>" + "x" * 50 + "</p>"
    got = [tuple(b) for b in spark.createDataFrame([(page,)], "h string").select(article_blocks(F.col("h")).alias("b")).first()["b"] if b["text"]]
    assert got == [("one two three", 13 - 6 - 60), ("x" * 50, -10)]


def test_bodies_are_kept_and_furniture_goes(spark):
    """Pages of the given table (body: what stands in <article>; furniture: navigation, advertisement and footer)."""
    rows = extract_article(spark.read.parquet(f"{DATA}/pages.parquet").where("html IS NOT NULL")).select("html", "article").collect()
    words = lambda html: re.findall(r"\w{4,}", re.sub(r"<[^>]+>", " ", html))
    kept = body = dropped = furniture = 0
    for r in rows:
        inside = re.search(r"(?s)<article>(.*)</article>", r["html"])
        if not inside:
            continue
        have, mine = set(words(r["article"])), words(re.sub(r"(?s)<script.*?</script>", " ", inside[1]))
        around = [w for w in words(" ".join(re.findall(r'(?s)<nav>.*?</nav>|<div class="ad">.*?</div>|<footer>.*?</footer>', r["html"]))) if w not in set(mine)]
        kept, body = kept + sum(w in have for w in mine), body + len(mine)
        dropped, furniture = dropped + sum(w not in have for w in around), furniture + len(around)
    print(f"kept {kept}/{body}, dropped {dropped}/{furniture}")
    assert body > 1000 and kept >= 0.95 * body and furniture > 50 and dropped >= 0.8 * furniture
