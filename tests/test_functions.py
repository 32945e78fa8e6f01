import pytest
from pyspark.sql import functions as F

from vellum.functions import numbers, text, urls


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items()) or "x string"
    return spark.createDataFrame([tuple(values.values()) or (None,)], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("https://www.Site.org/a/", "http://site.org/a"),
        ("https://site.org/a?utm_source=rss&p=1", "site.org/a?p=1"),
        ("https://site.org:443/a#top", "https://site.org/a"),
        ("https://site.org/a?b=2&a=1", "https://site.org/a?a=1&b=2"),
        ("https://site.org/a?ref=x&fbclid=3", "https://site.org/a"),
    ],
)
def test_one_article_has_one_key(spark, a, b):
    assert one(spark, urls.canonical_url(F.col("u")), u=a) == one(spark, urls.canonical_url(F.col("u")), u=b) != ""


@pytest.mark.parametrize(("a", "b"), [("https://s.org/?p=1", "https://s.org/?p=2"), ("https://s.org/A", "https://s.org/a"), ("https://s.org:8080/a", "https://s.org/a")])
def test_other_articles_have_other_keys(spark, a, b):
    assert one(spark, urls.canonical_url(F.col("u")), u=a) != one(spark, urls.canonical_url(F.col("u")), u=b)


def test_the_two_url_keys_are_not_the_same(spark):
    u = "HTTPS://Site.org/Path/?p=1#x"
    assert one(spark, urls.url_key(F.col("u")), u=u) == "https://site.org/Path"
    assert one(spark, urls.canonical_url(F.col("u")), u=u) == "site.org/Path?p=1"
    assert one(spark, urls.url_key(F.col("u")), u=None) == one(spark, urls.canonical_url(F.col("u")), u=None) == ""


def test_feeds_of_posts(spark):
    f = lambda u: one(spark, urls.feed_url(F.col("u")), u=u)
    assert f("https://ann.medium.com/a-title-1a3436277906") == "https://medium.com/feed/@ann"
    assert f("https://medium.com/@ann/a-title") == "https://medium.com/feed/@ann"
    assert f("https://medium.com/pub/a-title") == "https://medium.com/feed/pub"
    assert f("https://infosecwriteups.com/x") == "https://infosecwriteups.com/feed"
    assert f("https://site.org/x") is None
    assert one(spark, urls.post_id(F.col("u")), u="https://medium.com/p/a-title-1A3436277906?x=1") == "1a3436277906"


@pytest.mark.parametrize(("host", "blocked"), [("localhost", True), ("10.1.2.3", True), ("169.254.169.254", True), ("x.internal", True), ("::1", True), ("8.8.8.8", False), ("site.org", False), ("", True)])
def test_addresses_that_are_not_fetched(spark, host, blocked):
    assert (one(spark, urls.blocked_host(F.col("h")), h=host) is not None) == blocked


@pytest.mark.parametrize(("value", "want"), [("$1,500", 1500.0), ("5000", 5000.0), ("junk", 0.0), (None, 0.0), ("true", 0.0), ("NaN", 0.0), ("inf", 0.0), ("", 0.0)])
def test_as_float(spark, value, want):
    assert one(spark, numbers.as_float(F.col("x")), x=value) == want


def test_rounding_is_half_even(spark):
    assert [one(spark, numbers.clamp_score(F.col("x")), x=x) for x in (0.5, 1.5, 2.5, 140.0, -3.0)] == [0, 2, 2, 100, 0]


@pytest.mark.parametrize("value", ["79", "cwe-79", "CWE 79", "CWE_79", "CWE79"])
def test_cwe_spellings(value):
    assert numbers.cwe_filter_token(value) == "CWE-79"


@pytest.mark.parametrize("value", ["%", "CWE-", "79'", "a b"])
def test_malformed_cwe_filters_raise(value):
    with pytest.raises(ValueError):
        numbers.cwe_filter_token(value)


def test_cwe_token_is_exact(spark):
    assert not one(spark, numbers.has_token(F.col("c"), "CWE-20"), c="CWE-200 CWE-209")
    assert one(spark, F.array_join(numbers.cwe_tokens(F.col("c")), " "), c=["79, cwe-89;CWE-20"]) == "CWE-79 CWE-89 CWE-20"


def test_links(spark):
    body = "see [[Cookie Sandwich#Steps|x]] and [[dir/Other.md]] and [[#here]] and [[Cookie Sandwich]]"
    assert one(spark, text.all_links(F.col("l"), F.col("b")), l=["tech-a"], b=body) == ["tech-a", "cookie-sandwich", "other"]


def test_file_names(spark):
    name = lambda t: one(spark, text.title_to_filename(F.col("t"), F.lit("My Id")), t=t)
    assert name('a/b: "c"') == "a-b- -c-"
    assert name("con") == "con-note"
    assert name("...") == "my-id"
    assert len(name("word " * 60)) <= 150


def test_prose_and_failed_extraction(spark):
    assert one(spark, text.looks_like_prose(F.col("t")), t="これは普通の文章です。") is True
    assert one(spark, text.looks_like_prose(F.col("t")), t="\x00\x01\x02" * 50) is False
    reason = lambda t, n: spark.createDataFrame([(t, n)], "t string, n int").select(text.check_article_text(F.col("t"), F.col("n"))).first()[0]
    assert reason("", 10) == "no text extracted"
    assert reason("short", 10) == "too short"
    assert reason("word " * 100, 100_000) == "js-rendered or boilerplate"
    assert reason("word " * 100, 1_000) is None
    assert reason("word " * 100, None) is None
    assert reason("word " * 1001, 10_000_000) is None


def test_multipliers(spark):
    assert one(spark, numbers.quality_multiplier(F.lit(100))) == pytest.approx(1.4)
    assert one(spark, numbers.recency_multiplier(F.lit(0.0), 1e9)) == 1.0
    assert one(spark, numbers.recency_multiplier(F.lit(1e9), 1e9)) == pytest.approx(1.15)
    assert one(spark, numbers.recency_multiplier(F.lit(1.0), 1.7e9)) == pytest.approx(0.75)
    assert one(spark, numbers.sigmoid(F.lit(-800.0))) == 0.0


def test_article_dates_and_links(spark):
    page = '<meta property="article:published_time" content="1890-01-01"><time datetime="2023-04-05T10:00">'
    assert str(one(spark, text.article_date(F.col("p"), 2024), p=page)) == "2023-04-05"
    f = lambda u: one(spark, text.is_research_link(F.col("u")), u=u)
    assert f("https://blog.site.org/post/1") and f("https://gist.github.com/x/1")
    assert not f("https://uk.linkedin.com/in/x") and not f("https://site.org/about") and not f("https://github.com/a/b")
