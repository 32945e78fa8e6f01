"""Research pages: links mined from yearly lists, and landed articles as notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LEAST_SHARE, anchors, article_blocks, article_date, article_title, best_run, blank, check_article_text, clean_text, html_to_text, is_research_link, slugify
from ..functions.urls import host


def nominations(pages: DataFrame) -> DataFrame:
    """url, anchor, year: every research link of the list pages (year, html), with the longest of its anchor texts."""
    a = pages.select("year", F.explode(anchors(F.col("html"))).alias("a")).select("year", F.col("a.href").alias("url"), F.col("a.text").alias("anchor"))
    return a.where(is_research_link(F.col("url"))).groupBy("url").agg(F.max_by("anchor", F.struct(F.length("anchor"), "anchor")).alias("anchor"), F.min("year").alias("year"))


def page_title(page: Column, anchor: Column, url: Column) -> Column:
    """The page's own title; else the anchor's text; else the host."""
    return F.coalesce(article_title(page), F.nullif(anchor, F.lit("")), host(url))


def articles(links: DataFrame, fetched: DataFrame) -> DataFrame:
    """Links with their landed pages (url, html) as notes; ``reason`` says why a page is no article."""
    j = links.join(fetched, "url", "left").withColumn("text", html_to_text(F.col("html")))
    title = clean_text(page_title(F.col("html"), F.col("anchor"), F.col("url")))
    day = F.coalesce(F.when(F.year(article_date(F.col("html"), 9999)) <= F.col("year") + 1, article_date(F.col("html"), 9999)), F.make_date("year", F.lit(1), F.lit(1)))
    tags = F.array_sort(F.array_distinct(F.filter(F.array(F.lit("writeup"), F.lit("top10"), F.concat(F.lit("top10-"), F.col("year").cast("string")), host(F.col("url"))), lambda t: t != "")))
    return j.select(
        F.concat(F.lit("top10-"), slugify(title, 90)).alias("id"), F.lit("writeup").alias("type"), title.alias("title"), F.coalesce(F.nullif(host(F.col("url")), F.lit("")), F.lit("top10")).alias("source"), "url", day.alias("created"), tags.alias("tags"),
        F.concat(F.trim(F.substring("text", 1, 40_000)), F.lit("\n\n---\nSource: "), "url").alias("body"), check_article_text(F.col("text"), F.length("html")).alias("reason"),
    )


def extract_article(pages: DataFrame, page: str = "html", out: str = "article") -> DataFrame:
    """Adds the article of each page: its best run of blocks, one paragraph each; where that is under LEAST_SHARE of the page's
    plain text (or there is none), the plain text. A null page has an empty article."""
    rows = pages.withColumn("_blocks", article_blocks(F.col(page))).withColumn("_run", best_run(F.col("_blocks")))
    chosen = F.slice("_blocks", F.greatest(F.col("_run.first"), F.lit(1)), F.when(F.col("_run.best") > 0, F.col("_run.last") - F.col("_run.first") + 1).otherwise(0))
    rows = rows.withColumn("_text", F.array_join(F.filter(F.transform(chosen, lambda b: b["text"]), lambda t: t != ""), "\n\n")).withColumn("_plain", html_to_text(F.col(page)))
    kept = (F.length("_text") > 0) & (F.length("_text") >= LEAST_SHARE * F.length("_plain"))
    return rows.withColumn(out, F.when(kept, F.col("_text")).otherwise(F.col("_plain"))).drop("_blocks", "_run", "_text", "_plain")
