"""Operator 6, URL filters by a sort-merge range join. DataFrame functions only.

Canonical keys turn prefixes into intervals, and a sorted sweep finds the interval a key is in. Intervals of prefixes are nested
or apart, so each start and end of one is a boundary that says what is active from there on. Boundaries and rows are range-sorted
together by key (and row, so one key can fill many ranges) and written once; in each range a running window hands every row the
last boundary's value, and the first rows of a range take it from the ranges before.

Hosts first: a host's key is its labels in reverse, each with a dot behind it, so a host and its subdomains are the interval from
"org.example." up to "org.example/". The sweep gives every url the stack of rule hosts above it, as deep as hosts have labels
at most. Then paths: the key is rule host and path, and a rule's path is the interval of all that begin with it. The innermost
interval is the longest rule of its host, so a boundary carries one rule: its own, or at its end the one around it. The longest
over a url's rule hosts wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialize, shuffle_partitions, table

#: The rules of the registered query: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)


def url_path() -> Column:
    return F.when(F.instr("url", "://") > 0, F.regexp_extract("url", "^(?s:.*?)://[^/?#]*([^?#]*)", 1)).otherwise("")


def host_key(host: Column) -> Column:
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def host_marks(hosts: DataFrame) -> DataFrame:
    """key, value: the stack of rule hosts (column host, distinct) that are active from each boundary on, by equal joins of a
    host with the hosts above it."""
    labels = F.split("host", r"\.")
    above = hosts.select("host", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("up", "parent"))
    met = above.join(hosts.select(F.col("host").alias("parent")), "parent")
    stacks = met.groupBy("host").agg(F.collect_list("parent").alias("inside"), F.collect_list(F.when(F.col("up") > 0, F.col("parent"))).alias("outside"))  # as many as a host has labels
    key = host_key(F.col("host"))
    ends = F.array(F.struct(key.alias("key"), F.col("inside").alias("value")), F.struct(F.concat(F.expr("substring(k, 1, length(k) - 1)"), F.lit("/")).alias("key"), F.col("outside").alias("value")))
    return stacks.withColumn("k", key).select(F.explode(ends).alias("b")).select("b.key", "b.value")


def path_key(host: str | Column, path: str | Column) -> Column:
    return F.concat(host, F.lit(" "), path)


def path_marks(rules: DataFrame) -> DataFrame:
    """key, value: the innermost rule (of host, path, verdict; a host's paths distinct) that is active from each boundary on. The
    rule around another is the longest of the prefixes of its path that is a rule's."""
    rule = rules.select("host", "path", F.struct(F.concat("host", "path").alias("rule"), "verdict").alias("value"))
    prefixes = rule.where("path <> ''").select("host", "path", F.explode(F.transform(F.sequence(F.lit(0), F.length("path") - 1), lambda n: F.substr("path", F.lit(1), n))).alias("prefix"))
    around = prefixes.join(rule.select("host", F.col("path").alias("prefix"), F.col("value").alias("outer")), ["host", "prefix"]).groupBy("host", "path").agg(F.max_by("outer", F.length("prefix")).alias("outer"))
    rule = rule.join(around, ["host", "path"], "left")
    ends = F.array(F.struct(path_key("host", "path").alias("key"), F.col("value")), F.struct(F.concat(path_key("host", "path"), F.lit("\U0010ffff")).alias("key"), F.col("outer").alias("value")))
    return rule.select(F.explode(ends).alias("b")).select("b.key", "b.value")


def sweep(rows: DataFrame, marks: DataFrame, tag: str) -> DataFrame:
    """rows (key, row, ...) with the value of the last mark (key, value) at or before their key; null before the first."""
    spark, columns = rows.sparkSession, rows.columns
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != "key"]
    value = marks.select(F.struct("value").alias("mark")).schema[0].dataType  # a struct: a null value is a mark too
    events = rows.select(*columns, F.lit(1).alias("kind"), F.lit(None).cast(value).alias("mark")).unionByName(marks.select("key", *empty, F.lit(0).alias("kind"), F.struct("value").cast(value).alias("mark")))
    order = ["key", "kind", "row"]
    ranged = events.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
    ranged = materialize(ranged, tag)
    # one row for each range: the mark it hands on
    handed = ranged.groupBy("range").agg(F.max_by("mark", F.when(F.col("kind") == 0, F.col("key"))).alias("last"))
    carried = handed.select("range", F.last("last", True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    inside = F.last("mark", True).over(Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0))
    seen = ranged.withColumn("inside", inside).where("kind = 1").join(F.broadcast(carried), "range")  # a row for each range
    return seen.select(*columns, F.coalesce("inside", "carried")["value"].alias("value"))


def url_filter(urls: DataFrame, rules: DataFrame, *, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The longest fitting rule of each url: rows of id (as page_id), host, path, rule, verdict.

    rules: verdict, host, path. A rule fits its host and all subdomains where the url's path starts with the rule's; the
    longest host + path wins, and of equal rules with two verdicts "block" does. Without a rule: null and ``default``. Null urls and urls without "://" have an
    empty host and path and fit no rule. Repeated rows and null ids keep their rows. Without rules every url has ``default``.
    Other columns are ignored. Rules with a null in any column, or without a host, fit nothing.
    """
    pages = urls.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    pages = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path().alias("path"), F.monotonically_increasing_id().alias("row"))
    pages = pages.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "row").withColumn("key", host_key(F.col("host")))
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict").where("host <> '' AND path IS NOT NULL AND verdict IS NOT NULL")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    stacked = materialize(sweep(pages, host_marks(rules.select("host").distinct()), "op6-hosts"), "op6-stacks")
    asked = stacked.where("size(value) > 0").select("row", "page_id", "host", "path", F.explode("value").alias("rule_host"))
    found = sweep(asked.withColumn("key", path_key("rule_host", "path")), path_marks(rules), "op6-paths").where("value IS NOT NULL AND rule_host = substring(value.rule, 1, length(rule_host))")
    best = found.groupBy("row").agg(F.max(F.struct(F.length("value.rule").alias("size"), F.col("value.rule").alias("rule"), F.col("value.verdict").alias("verdict"))).alias("best"))
    out = stacked.join(best.hint("merge"), "row", "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return url_filter(table(spark, sf_dir, "pages"), spark.sql(f"SELECT * FROM VALUES {rows} AS t(verdict, host, path)"))


QUERIES = {"op6_url_filter": op6_url_filter}
SQL = {
    "op6_url_filter": f"""
WITH rules(verdict, host, path) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
split AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM split),
pages2 AS (SELECT page_id, translate(coalesce(raw, ''), '{_UPPER}', '{_LOWER}') AS host,
  coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM hosts),
fit AS (SELECT p.page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM pages2 p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM pages2 p LEFT JOIN fit f ON p.page_id = f.page_id
"""
}
