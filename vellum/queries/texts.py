"""Addresses, pages, cleaning, slugs and title rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers, text, urls
from ..session import table
from ..sources import code, pages
from . import query

_REST = r"regexp_replace(regexp_replace(trim(coalesce(url, '')), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//', ''), '#.*$', '')"
HOST_SQL = rf"regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract({_REST}, '^([^/?]*)', 1), '^.*@', ''), ':\d*$', '')), '^www\.', '')"
_TRACK = ", ".join(f"'{t}'" for t in urls.TRACKING)
_PAIRS = rf"list_sort(list_transform(list_filter(string_split(regexp_extract({_REST}, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_') AND lower(split_part(p, '=', 1)) NOT IN ({_TRACK})), lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END))"
CANONICAL_SQL = rf"{HOST_SQL} || rtrim(regexp_extract({_REST}, '^[^/?]*([^?]*)', 1), '/') || CASE WHEN len({_PAIRS}) > 0 THEN '?' || array_to_string({_PAIRS}, '&') ELSE '' END"
_TEXT = r"coalesce(html, '')"
for _t in ("script", "style", "nav", "footer", "header", "form"):
    _TEXT = rf"regexp_replace({_TEXT}, '(?is)<{_t}\b[^>]*>.*?</{_t}\s*>', ' ', 'g')"
_TEXT = rf"regexp_replace({_TEXT}, '<[^>]+>', ' ', 'g')"
for _e, _c in text._ENTITIES:
    _TEXT = "replace({}, '{}', '{}')".format(_TEXT, _e, _c.replace("'", "''"))
_TEXT = rf"trim(regexp_replace({_TEXT}, '\s+', ' ', 'g'))"


@query(f"SELECT page_id, {CANONICAL_SQL} AS canonical_url FROM pages")
def canonical_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical_url"))


@query(r"""WITH k AS (SELECT page_id, rtrim(split_part(split_part(trim(coalesce(url, '')), '#', 1), '?', 1), '/') AS key FROM pages)
SELECT page_id, lower(regexp_extract(key, '^(.*?://[^/]*)', 1)) || substr(key, length(regexp_extract(key, '^(.*?://[^/]*)', 1)) + 1) AS url_key FROM k""")
def url_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.url_key(F.col("url")).alias("url_key"))


@query(f"SELECT {HOST_SQL} AS host, count(*) AS n FROM pages GROUP BY 1")
def url_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query(f"SELECT page_id, md5({_TEXT}) AS digest, length({_TEXT})::INTEGER AS n FROM pages")
def html_to_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", text.html_to_text(F.col("html")).alias("t"))
    return pages.select("page_id", F.md5(F.col("t").cast("binary")).alias("digest"), F.length("t").alias("n"))


@query(r"""WITH a AS (SELECT unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?href=["''](/[^"''#\s]+)[^>]*>([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?href=["''](/[^"''#\s]+)[^>]*>([^<]*)</a>', 2)) AS t FROM pages)
SELECT href, arg_max(t, (length(t), t)) AS longest, count(*) AS n FROM a GROUP BY href""")
def anchors_longest(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.regexp_replace("html", "(href=[\"'])/", "$1https://site.example/").alias("html"))
    a = pages.select(F.explode(text.anchors(F.col("html"))).alias("a")).select(F.regexp_replace("a.href", "^https://site.example", "").alias("href"), F.col("a.text").alias("t"))
    return a.groupBy("href").agg(F.max_by("t", F.struct(F.length("t"), "t")).alias("longest"), F.count("*").alias("n"))


@query(rf"""WITH t AS (SELECT page_id, length(html) AS page_len, {_TEXT} AS t FROM pages),
g AS (SELECT *, substr(t, 1, 20000) AS head FROM t),
p AS (SELECT *, length(regexp_replace(head, '[\p{{L}}\p{{N}}\s\x{{00A0}}\-_.,:;!?''"()\[\]{{}}/<>@#$%&*+=|\\~`^]', '', 'g')) AS bad FROM g)
SELECT page_id, CASE WHEN t = '' THEN 'no text extracted' WHEN length(t) < 400 THEN 'too short' WHEN (length(head) - bad)::DOUBLE / length(head) <= 0.9 THEN 'binary/not text'
  WHEN page_len > 0 AND length(t) < 5000 AND length(t)::DOUBLE / page_len < 0.02 THEN 'js-rendered or boilerplate' END AS reason FROM p""")
def article_guards(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.length("html").alias("page_len"), text.html_to_text(F.col("html")).alias("t"))
    return pages.select("page_id", text.check_article_text(F.col("t"), F.col("page_len")).alias("reason"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents""")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean_text(F.col("text")).cast("binary")).alias("digest"))


@query("""WITH t AS (SELECT doc_id, [upper('cwe-' || (doc_id % 90)), upper('CWE-' || (n_chars % 7))] AS c FROM documents)
SELECT doc_id, array_to_string(CASE WHEN c[1] = c[2] THEN [c[1]] ELSE c END, ' ') AS cwes FROM t""")
def extract_tokens(spark, sf_dir):
    blob = F.expr("concat(text, ' cwe-', doc_id % 90, ', CWE-', n_chars % 7, ' and cwe-', doc_id % 90)")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.extract_cwes(blob), " ").alias("cwes"))


@query(rf"""SELECT doc_id, trim(regexp_replace(lower(regexp_replace(replace(translate(coalesce(text, ''), '{text._MARKED}', '{text._FOLDED}'), 'ß', 'ss'), '[''’]', '-', 'g')), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents""")
def slugify(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.slugify(F.col("text")).alias("slug"))


_TITLE = "CASE p_size % 5 WHEN 0 THEN concat('Introducing ', p_name) WHEN 1 THEN concat('Nominations open: ', p_name) WHEN 2 THEN concat('Coming to ', p_name, ' at Black Hat') ELSE p_name END"


@query(rf"""WITH t AS (SELECT p_partkey, {_TITLE} AS title FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(title, '(?i)^\s*(introducing|announcing|meet)\s+\S') THEN 'tool-announcement'
 WHEN regexp_matches(title, '(?i)top\s+10\s+web\s+hacking\s+techniques|nominations?\s+open|call\s+for\s+nominations') THEN 'index-post'
 WHEN regexp_matches(title, '(?i)\b(previewing|coming to)\b.*\b(def\s?con|black\s?hat)\b|\bhat-trick\b') THEN 'conference-preview' END AS reason FROM t""")
def prefilter_reasons(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.prefilter_reason(F.expr(_TITLE)).alias("reason"))


_SUBJECT = "CASE p_size % 7 WHEN 0 THEN concat('Fix use-after-free in ', p_name) WHEN 1 THEN concat('Validate origin of ', p_name) WHEN 2 THEN concat('Roll ', p_name, ' security') WHEN 3 THEN concat('WeakPtr lifetime and CVE-2024 in ', p_name) ELSE p_name END"


@query(
    "WITH t AS (SELECT p_partkey, {} AS s FROM part) SELECT p_partkey, CASE WHEN regexp_matches(s, '{}') THEN '' ELSE concat_ws(',', {}) END AS classes FROM t".format(
        _SUBJECT, code.DROP_SUBJECT, ", ".join(f"CASE WHEN regexp_matches(s, '{p}') THEN '{n}' END" for n, p in code.CLASSES)
    )
)
def commit_classes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(code.commit_classes(F.expr(_SUBJECT)), ",").alias("classes"))


@query("""SELECT doc_id, array_to_string(list_distinct_ordered, ',') AS united, CASE WHEN lang IN ('en', 'de') THEN source ELSE concat_ws(',', lang, source) END AS cut,
  array_to_string(list_sort(list_distinct([lang, source, 'status/worked'])), ',') AS swapped
FROM (SELECT *, CASE WHEN lang = 'en' THEN ['en', source, 'all'] ELSE [lang, source, 'en', 'all'] END AS list_distinct_ordered FROM documents)""")
def set_ops(spark, sf_dir):
    mine, other = F.array("lang", "source", F.lit(" ")), F.array(F.lit("en"), F.lit("all"), F.col("source"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.array_join(numbers.union(mine, other), ",").alias("united"),
        F.array_join(numbers.without(mine, F.array(F.lit("EN"), F.lit("De "))), ",").alias("cut"),
        F.array_join(numbers.replace_status(F.array("lang", "source", F.lit("status/hypothesis")), F.lit("worked")), ",").alias("swapped"),
    )


_POSTS = [
    ("https://r.example/1", "Stable Channel Update", "2024-05-01", "This update includes 3 security fixes. [$3,000][ 550839154 ] High CVE-2024-1001: Use after free in Dawn. Reported by M. Smith on 2024-03-02 [TBD][ 550839155 ] Medium CVE-2024-1002: Inappropriate implementation in Extensions API. Reported by Google on 2024-03-05 We would also like to thank all."),
    ("https://r.example/2", "Extended Stable Channel Update", "2024-06-01", "Version 126.0.6478.54 includes 1 security fix. [N/A][550839199] Critical CVE-2024-1003: Type confusion in V8. Credit to A. B. Lee. As usual, our ongoing work"),
]


@query()
def release_rows(spark, sf_dir):
    posts = spark.createDataFrame(_POSTS, "url string, title string, published string, text string").withColumn("published", F.to_date("published"))
    return code.release_rows(posts)


def _bare_sql(html: str) -> str:
    out = f"regexp_replace({html}, '<[^>]+>', ' ', 'g')"
    for entity, char in text._ENTITIES:
        out = "replace({}, '{}', '{}')".format(out, entity, char.replace("'", "''"))
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


@query(rf"""WITH c AS (SELECT page_id, html, regexp_split_to_array(regexp_replace(coalesce(html, ''), '{text._UNSEEN}', ' ', 'g'), '{text._PARTING}') AS l FROM pages),
r AS (SELECT page_id, unnest(range(1, len(l) + 1)) AS k, unnest(l) AS raw FROM c),
t AS (SELECT page_id, k, {_bare_sql("raw")} AS t, coalesce(list_sum(list_transform(regexp_extract_all(raw, '{text._LINK}', 1), lambda x: length({_bare_sql("x")}))), 0) AS linked FROM r),
s AS (SELECT *, sum(CASE WHEN t = '' THEN 0 ELSE length(t) - {text.LINK_COST} * linked - {text.BLOCK_COST} END) OVER (PARTITION BY page_id ORDER BY k) AS s FROM t),
m AS (SELECT *, least(0, coalesce(min(s) OVER (PARTITION BY page_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM s),
b AS (SELECT page_id, k AS last, low FROM m WHERE s > low QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY s - low DESC, k) = 1),
f AS (SELECT b.page_id, last, coalesce(max(s.k), 0) AS before FROM b LEFT JOIN s ON s.page_id = b.page_id AND s.k < last AND s.s = low GROUP BY ALL),
a AS (SELECT page_id, string_agg(t, chr(10) || chr(10) ORDER BY k) FILTER (t <> '') AS article FROM t JOIN f USING (page_id) WHERE k BETWEEN before + 1 AND last GROUP BY page_id),
p AS (SELECT page_id, {_TEXT} AS plain FROM pages)
SELECT page_id, md5(x) AS digest, length(x)::INTEGER AS n FROM (SELECT page_id, CASE WHEN length(article) >= {text.LEAST_SHARE} * length(plain) THEN article ELSE plain END AS x FROM p LEFT JOIN a USING (page_id))""")
def extract_article(spark, sf_dir):
    got = pages.extract_article(table(spark, sf_dir, "pages").select("page_id", "html"))
    return got.select("page_id", F.md5(F.col("article").cast("binary")).alias("digest"), F.length("article").alias("n"))
