"""Vulnerability and report feeds, landed as JSON, Parquet or XML: each becomes rows of note columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import day_prefix
from ..functions.text import clean_text, extract_cwes, html_to_text, slugify
from ..functions.urls import host, url_key

KEV = "vulnerabilities array<struct<cveID:string,vendorProject:string,product:string,vulnerabilityName:string,dateAdded:string,shortDescription:string,requiredAction:string,dueDate:string,knownRansomwareCampaignUse:string,notes:string,cwes:array<string>>>"
_METRIC = "array<struct<baseSeverity:string,cvssData:struct<baseSeverity:string,baseScore:double,vectorString:string>>>"
NVD = (
    "totalResults long, vulnerabilities array<struct<cve:struct<id:string,published:string,descriptions:array<struct<lang:string,value:string>>,"
    "weaknesses:array<struct<description:array<struct<lang:string,value:string>>>>,"
    f"metrics:struct<cvssMetricV31:{_METRIC},cvssMetricV30:{_METRIC},cvssMetricV2:{_METRIC}>,references:array<struct<url:string>>>>>"
)
EPSS = "data array<struct<cve:string,epss:string,percentile:string>>"
WRITEUPS = "data array<struct<Links:array<struct<Title:string,Link:string>>,Authors:array<string>,Programs:array<string>,Bugs:array<string>,Bounty:string,PublicationDate:string,AddedDate:string>>"
REPORTS = "data array<struct<id:string,attributes:struct<state:string,title:string,vulnerability_information:string,created_at:string,triaged_at:string,closed_at:string,severity_rating:string,disclosed_at:string,total_awarded_amount:double>,relationships:struct<program:struct<data:struct<attributes:struct<name:string,handle:string>>>,weakness:struct<data:struct<attributes:struct<name:string,external_id:string>>>>>>"

#: Parts of a weakness's name and the CWE they stand for, first match wins.
WEAKNESS_CWE = (
    ("cross-site scripting", "CWE-79"), ("xss", "CWE-79"), ("sql injection", "CWE-89"), ("cross-site request forgery", "CWE-352"), ("csrf", "CWE-352"),
    ("server-side request forgery", "CWE-918"), ("ssrf", "CWE-918"), ("path traversal", "CWE-22"), ("directory traversal", "CWE-22"),
    ("insecure direct object reference", "CWE-639"), ("idor", "CWE-639"), ("improper authentication", "CWE-287"), ("improper authorization", "CWE-285"),
    ("privilege escalation", "CWE-269"), ("information disclosure", "CWE-200"), ("open redirect", "CWE-601"), ("xml external entities", "CWE-611"), ("xxe", "CWE-611"),
    ("deserialization", "CWE-502"), ("command injection", "CWE-77"), ("code injection", "CWE-94"), ("race condition", "CWE-362"), ("business logic", "CWE-840"),
    ("denial of service", "CWE-400"), ("server-side template injection", "CWE-1336"), ("ssti", "CWE-1336"), ("subdomain takeover", "CWE-350"),
)
#: The weaknesses asked for by default.
DEFAULT_CWES = ("CWE-79", "CWE-89", "CWE-352", "CWE-918", "CWE-22", "CWE-94", "CWE-77", "CWE-78", "CWE-611", "CWE-502", "CWE-287", "CWE-639", "CWE-863", "CWE-1336", "CWE-434", "CWE-384")
_STRINGS = "array<string>"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def weakness_cwe(name: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(name).contains(k), F.lit(v)) for k, v in WEAKNESS_CWE])


def _section(title: str, text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(f"## {title}\n"), text))


def kev(landed: DataFrame) -> DataFrame:
    """Known exploited vulnerabilities as notes."""
    v = landed.select(F.explode("vulnerabilities").alias("v")).select("v.*").where("cveID IS NOT NULL")
    name, vendor, product = F.coalesce("vulnerabilityName", "cveID"), F.coalesce("vendorProject", F.lit("")), F.coalesce("product", F.lit(""))
    lead = F.concat(F.lit("**"), F.trim(F.concat_ws(" ", F.nullif(vendor, F.lit("")), F.nullif(product, F.lit("")))), F.lit("** — "), name)
    body = F.concat_ws(
        "\n\n", lead, F.lit("## Summary"), F.nullif(clean_text(F.col("shortDescription")), F.lit("")), F.lit("## Required action"), F.nullif(clean_text(F.col("requiredAction")), F.lit("")),
        _section("Ransomware use", F.coalesce("knownRansomwareCampaignUse", F.lit("Unknown"))), _section("Notes", clean_text(F.col("notes"))),
    )
    tags = F.filter(F.array(F.lit("kev"), F.lit("known-exploited"), F.lower(vendor), F.lower(product)), lambda t: t != "")
    return v.select(
        F.col("cveID").alias("id"), F.lit("cve").alias("type"), F.concat("cveID", F.lit(" — "), name).alias("title"), F.lit("cisa-kev").alias("source"),
        F.concat(F.lit("https://nvd.nist.gov/vuln/detail/"), "cveID").alias("url"), day_prefix(F.col("dateAdded")).alias("created"), tags.alias("tags"),
        F.transform(F.coalesce("cwes", F.array().cast(_STRINGS)), F.upper).alias("cwe"), F.lit(None).cast("string").alias("severity"), F.nullif(vendor, F.lit("")).alias("program"),
        F.to_json(F.struct(F.col("dateAdded").alias("kev_date_added"), F.col("dueDate").alias("kev_due_date"))).alias("extra"), body.alias("body"),
    )


def nvd(landed: DataFrame) -> DataFrame:
    """Vulnerability records as notes: English description, best CVSS version, at most ten references; one row for each id;
    rejected and disputed records are left out."""
    c = landed.select(F.explode("vulnerabilities.cve").alias("c")).select("c.*").where("id IS NOT NULL")
    c = c.withColumn("desc", clean_text(F.get(F.filter("descriptions", lambda d: d["lang"] == "en"), F.lit(0))["value"]))
    c = c.where(~F.col("desc").startswith("** REJECT **") & ~F.col("desc").startswith("** DISPUTED **"))
    m = F.coalesce(*[F.get(F.col(f"metrics.cvssMetric{v}"), F.lit(0)) for v in ("V31", "V30", "V2")])
    c = c.withColumn("m", m).withColumn("severity", F.lower(F.coalesce("m.cvssData.baseSeverity", "m.baseSeverity")))
    words = F.flatten(F.transform("weaknesses", lambda w: F.transform(w["description"], lambda d: d["value"])))
    refs = F.slice(F.filter(F.transform("references", lambda r: r["url"]), lambda u: F.coalesce(u, F.lit("")) != ""), 1, 10)
    score, vector = F.col("m.cvssData.baseScore"), F.col("m.cvssData.vectorString")
    cvss = F.when(score > 0, F.concat(F.coalesce("severity", F.lit("n/a")), F.lit(" ("), score.cast("string"), F.lit(") `"), F.coalesce(vector, F.lit("")), F.lit("`")))
    listed = F.when(F.size(refs) > 0, F.array_join(F.transform(refs, lambda u: F.concat(F.lit("- "), u)), "\n"))
    short = F.when(F.length("desc") > 80, F.concat(F.substring("desc", 1, 80), F.lit("…"))).otherwise(F.col("desc"))
    rows = c.select(
        "id", F.lit("cve").alias("type"), F.concat("id", F.lit(" — "), short).alias("title"), F.lit("nvd").alias("source"), F.concat(F.lit("https://nvd.nist.gov/vuln/detail/"), "id").alias("url"),
        day_prefix(F.col("published")).alias("created"), F.array(F.lit("cve")).alias("tags"), F.array_distinct(F.filter(F.coalesce(words, F.array().cast(_STRINGS)), lambda w: w.startswith("CWE-"))).alias("cwe"),
        "severity", F.lit(None).cast("string").alias("program"), F.to_json(F.struct(score.alias("cvss_score"), vector.alias("cvss_vector"))).alias("extra"),
        F.concat_ws("\n\n", F.lit("## Description"), F.nullif("desc", F.lit("")), _section("CVSS", cvss), _section("References", listed)).alias("body"),
    )
    return rows.dropDuplicates(["id"])


def epss(landed: DataFrame) -> DataFrame:
    s = landed.select(F.explode("data").alias("s")).select("s.cve", F.col("s.epss").try_cast("double").alias("epss"), F.col("s.percentile").try_cast("double").alias("percentile"))
    return s.where("cve IS NOT NULL AND epss IS NOT NULL AND percentile IS NOT NULL").dropDuplicates(["cve"])


def batches(ids: DataFrame, size: int = 100) -> DataFrame:
    """Ids in groups of about ``size`` for a request each; groups are made by hash, so nothing is numbered in one task."""
    n = max(1, -(-ids.count() // size))
    return ids.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("batch")).agg(F.array_sort(F.collect_list("id")).alias("ids"))


def public_reports(rows: DataFrame) -> DataFrame:
    """Disclosed reports (the public Parquet layout) as notes; bodies under 40 characters are left out."""
    body = clean_text(F.col("vulnerability_information"))
    name = F.col("weakness.name")
    program = F.coalesce("team.profile.name", "team.handle")
    cwe = F.when(weakness_cwe(name).isNotNull(), F.array(weakness_cwe(name))).otherwise(extract_cwes(body, name))
    sev = F.col("structured_scope.max_severity")
    more = F.struct(name.alias("weakness"), F.coalesce(F.col("`has_bounty?`"), F.lit(False)).alias("has_bounty"), "vote_count", F.col("original_report_id").isNotNull().alias("is_dupe"))
    return rows.where(F.col("id").isNotNull() & (F.length(body) >= 40)).select(
        F.concat(F.lit("h1-"), F.col("id").cast("string")).alias("id"), F.lit("report").alias("type"),
        F.coalesce(F.nullif(clean_text(F.col("title")), F.lit("")), F.concat(F.lit("HackerOne report "), F.col("id").cast("string"))).alias("title"), F.lit("hackerone-public").alias("source"),
        F.concat(F.lit("https://hackerone.com/reports/"), F.col("id").cast("string")).alias("url"), day_prefix(F.coalesce("disclosed_at", "created_at")).alias("created"),
        F.filter(F.array(F.lit("hackerone"), F.lit("disclosed"), F.lower(name)), lambda t: t.isNotNull()).alias("tags"), cwe.alias("cwe"), F.when(sev != "none", sev).alias("severity"),
        program.alias("program"), F.to_json(more).alias("extra"), body.alias("body"),
    )


def own_reports(landed: DataFrame, *, hacktivity: bool = False, limit: int | None = None) -> DataFrame:
    """Reports of the reporting API: a user's own, or the public feed (newest first; ``limit`` counts rows considered)."""
    r = landed.select(F.explode("data").alias("r")).select("r.*").where("id IS NOT NULL").withColumn("a", F.col("attributes"))
    state, weakness = F.lower(F.coalesce("a.state", F.lit(""))), F.col("relationships.weakness.data.attributes")
    program = F.coalesce(F.col("relationships.program.data.attributes.name"), F.col("relationships.program.data.attributes.handle"))
    text = F.nullif(clean_text(F.col("a.vulnerability_information")), F.lit(""))
    title = F.nullif(clean_text(F.col("a.title")), F.lit(""))
    if hacktivity:
        r = r.orderBy(F.col("a.disclosed_at").desc_nulls_last(), "id")
        r = r.limit(limit) if limit else r
        r = r.where(text.isNotNull() | title.isNotNull())
    prefix, source = ("h1act-", "hackerone-hacktivity") if hacktivity else ("h1mine-", "hackerone-mine")
    first = [F.lit("hackerone"), F.lit("hacktivity")] if hacktivity else [F.lit("hackerone"), F.lit("mine"), F.when(state == "", "unknown").otherwise(state), F.when(state == "duplicate", "dupe")]
    return r.select(
        F.concat(F.lit(prefix), "id").alias("id"), F.lit("report").alias("type"), F.coalesce(title, F.concat(F.lit("Report "), "id")).alias("title"), F.lit(source).alias("source"),
        F.concat(F.lit("https://hackerone.com/reports/"), "id").alias("url"), day_prefix(F.coalesce("a.disclosed_at", "a.created_at")).alias("created"),
        F.filter(F.array(*first, F.lower(weakness["name"])), lambda t: t.isNotNull()).alias("tags"), extract_cwes(weakness["external_id"], text).alias("cwe"),
        F.lower("a.severity_rating").alias("severity"), program.alias("program"), state.alias("state"),
        F.to_json(F.struct(state.alias("state"), "a.triaged_at", "a.closed_at", "a.total_awarded_amount")).alias("extra"), F.coalesce(text, title if hacktivity else F.lit("(no body)")).alias("body"),
    )


def writeups(landed: DataFrame, *, since: str | None = None) -> DataFrame:
    """The write-up index as notes; with ``since`` undated entries are left out."""
    e = landed.select(F.explode("data").alias("e")).select("e.*").withColumn("l", F.get("Links", F.lit(0)))
    link, title = F.trim(F.coalesce("l.Link", F.lit(""))), clean_text(F.col("l.Title"))
    day = F.try_to_date(F.col("PublicationDate"))
    money = F.regexp_replace(F.coalesce("Bounty", F.lit("")), r"[^0-9.]", "").try_cast("double")
    lists = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast(_STRINGS)), clean_text), lambda x: x != "")
    line = lambda name, c: F.when(F.size(lists(c)) > 0, F.concat(F.lit(f"**{name}:** "), F.array_join(lists(c), ", ")))
    rows = e.where((link != "") & (title != ""))
    if since:
        rows = rows.where(day >= F.lit(since).cast("date"))
    tags = F.array_sort(F.array_distinct(F.filter(F.array(F.lit("writeup"), F.lit("pentesterland"), host(link)), lambda t: t != "")))
    return rows.select(
        F.concat(F.lit("writeup-"), slugify(title, 90)).alias("id"), F.lit("writeup").alias("type"), title.alias("title"), F.coalesce(F.nullif(host(link), F.lit("")), F.lit("pentester.land")).alias("source"),
        link.alias("url"), day.alias("created"), tags.alias("tags"), F.get(lists("Programs"), F.lit(0)).alias("program"), money.alias("bounty"),
        F.concat_ws("\n", line("Bugs", "Bugs"), line("Programs", "Programs"), line("Authors", "Authors"), F.when(F.coalesce("Bounty", F.lit("-")) != "-", F.concat(F.lit("**Bounty:** "), "Bounty")), F.lit("\n---"), F.concat(F.lit("Source: "), link)).alias("body"),
    )


RSS_ITEM = "title string, link string, pubDate string, description string, encoded string"


def rss(spark: SparkSession, path: str, *, since: str | None = None) -> DataFrame:
    """Items of landed RSS files: the longer of content and summary as text, one row for each url; undated items are kept."""
    items = spark.read.format("xml").option("rowTag", "item").option("ignoreNamespace", "true").schema(RSS_ITEM).load(path)
    day = F.coalesce(F.try_to_timestamp(F.regexp_replace("pubDate", r"^\w{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z")).cast("date"), day_prefix(F.col("pubDate")))
    text = F.when(F.length(F.coalesce("encoded", F.lit(""))) > F.length(F.coalesce("description", F.lit(""))), F.col("encoded")).otherwise(F.col("description"))
    rows = items.where("link IS NOT NULL").select(
        F.concat(F.lit("research-"), slugify(F.col("title"), 90)).alias("id"), F.lit("writeup").alias("type"), clean_text(F.col("title")).alias("title"), host(F.col("link")).alias("source"), F.trim("link").alias("url"),
        day.alias("created"), F.substring(html_to_text(text), 1, 40_000).alias("body"),
    )
    if since:
        rows = rows.where(F.col("created").isNull() | (F.col("created") >= F.lit(since).cast("date")))
    return rows.withColumn("k", url_key(F.col("url"))).dropDuplicates(["k"]).drop("k")


def bodies_from_feed(posts: DataFrame, items: DataFrame) -> DataFrame:
    """Posts (url) that a site refuses to show, with the text of the feed item of the same post id, else the same url."""
    from ..functions.urls import post_id

    key = F.coalesce(post_id(F.col("url")), url_key(F.col("url")))
    best = items.where(F.length("body") >= 400).select(key.alias("k"), F.col("body").alias("feed_body")).groupBy("k").agg(F.max_by("feed_body", F.length("feed_body")).alias("feed_body"))
    return posts.withColumn("k", key).join(best, "k", "left").drop("k")
