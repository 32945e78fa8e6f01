"""Counts, listings, ledgers, runs and ideas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import append_update as append
from ..operators import reports
from ..session import table
from . import query


@query("SELECT lang AS type, count(*) AS n FROM documents GROUP BY lang")
def count_by_type(spark, sf_dir):
    return reports.counts_by(table(spark, sf_dir, "documents").withColumnRenamed("lang", "type"), "type")


@query("""WITH n AS (SELECT md5(concat_ws('/', source, n_chars)) AS id, concat('doc/', doc_id) AS path, trim(coalesce(text, '')) AS body FROM documents)
SELECT id, count(*) AS files, string_agg(path, ',' ORDER BY path) AS paths, count(DISTINCT sha1(body)) = 1 AS identical FROM n GROUP BY id HAVING count(*) > 1""")
def duplicate_ids(spark, sf_dir):
    notes = table(spark, sf_dir, "documents").select(F.md5(F.concat_ws("/", "source", F.col("n_chars").cast("string")).cast("binary")).alias("id"), F.format_string("doc/%d", "doc_id").alias("path"), F.col("text").alias("body"))
    return reports.duplicate_ids(notes).select("id", "files", F.array_join("paths", ",").alias("paths"), "identical")


@query("SELECT user_id AS source, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in ("click", "view", "purchase", "error", "login")) + " FROM events GROUP BY user_id")
def run_counters(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.col("event_type").alias("status"))
    return reports.run_counters(runs, ["click", "view", "purchase", "error", "login"])


def _rewards(spark, sf_dir) -> DataFrame:
    """Orders as the rows of a reward ledger."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    severity = F.expr("CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'Critical' WHEN '2' THEN 'High' WHEN '3' THEN 'Medium' ELSE 'Low' END")
    return o.select(severity.alias("severity"), F.when(F.col("o_orderstatus") == "F", F.round("o_totalprice", 0)).alias("reward_usd"), F.col("c_mktsegment").alias("component"), (F.col("c_acctbal") < 0).alias("internal"), F.format_string("CVE-%d", "o_custkey").alias("cve"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("reported_on"))


_REWARDS = """r AS (SELECT CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Critical' WHEN '2' THEN 'High' WHEN '3' THEN 'Medium' ELSE 'Low' END AS severity, CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice, 0) END AS reward_usd,
 c_mktsegment AS component, c_acctbal < 0 AS internal, 'CVE-' || o_custkey AS cve, strftime(o_orderdate, '%Y-%m-%d') AS reported_on FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query(f"WITH {_REWARDS} SELECT severity, count(*) AS n, count(reward_usd) AS stated, median(reward_usd) AS median_usd, max(reward_usd) AS max_usd FROM r GROUP BY severity")
def ledger_by_severity(spark, sf_dir):
    return reports.ledger_by_severity(_rewards(spark, sf_dir))


@query(f"""WITH {_REWARDS}, s AS (SELECT component, string_agg(severity, ', ' ORDER BY o) AS severities FROM (SELECT DISTINCT component, severity, list_position(['Critical', 'High', 'Medium', 'Low'], severity) AS o FROM r) GROUP BY component)
SELECT component, count(*) AS n, count(*) FILTER (NOT internal) AS external, any_value(severities) AS severities, sum(reward_usd) AS stated_usd FROM r JOIN s USING (component) GROUP BY component ORDER BY n DESC, component LIMIT 40""")
def ledger_topn(spark, sf_dir):
    return reports.ledger_top(_rewards(spark, sf_dir), "component")


@query(f"WITH {_REWARDS} SELECT count(*) AS n, count(DISTINCT cve) AS unique_cves, count(*) FILTER (NOT internal) AS external, min(reported_on) AS first_day, max(reported_on) AS last_day FROM r")
def ledger_summary(spark, sf_dir):
    return reports.ledger_summary(_rewards(spark, sf_dir))


@query("SELECT l_partkey, arg_min(l_orderkey, (l_orderkey, l_linenumber)) AS l_orderkey, arg_min(l_linenumber, (l_orderkey, l_linenumber)) AS l_linenumber, arg_min(l_quantity, (l_orderkey, l_linenumber)) AS l_quantity FROM lineitem GROUP BY l_partkey")
def first_per_key(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    return reports.first_per_key(rows, ["l_partkey"], ["l_orderkey", "l_linenumber"])


@query("SELECT d::DATE AS start_day, least(d + INTERVAL 119 DAY, DATE '2024-06-15')::DATE AS end_day FROM generate_series(DATE '2023-01-01', DATE '2024-06-15', INTERVAL 120 DAY) t(d)")
def date_windows(spark, sf_dir):
    return reports.date_windows(spark, "2023-01-01", "2024-06-15")


def _catalog(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.format_string("doc-%06d", "doc_id").alias("id"), F.col("lang").alias("type"), F.col("source").alias("program"), F.lit(None).cast("string").alias("status"), F.array("lang", "source").alias("tags"), F.lit("manual").alias("source"),
        F.expr("CASE WHEN n_chars % 4 <> 0 THEN date_add(DATE '2020-01-01', cast(n_chars % 1500 AS int)) END").alias("created"), F.expr("cast(doc_id AS decimal(20, 0)) * 86400000000000L + 7").alias("mtime_ns"),  # days beyond 2262 are no long of nanoseconds
    )


_CATALOG = "c AS (SELECT printf('doc-%06d', doc_id) AS id, source, CASE WHEN n_chars % 4 <> 0 THEN DATE '2020-01-01' + (n_chars % 1500)::INTEGER END AS created, doc_id, DATE '1970-01-01' + doc_id::INTEGER AS written FROM documents)"


@query(f"WITH {_CATALOG}, d AS (SELECT *, coalesce(created, written) AS day FROM c WHERE source <> '' AND coalesce(created, written) >= DATE '2021-01-01') SELECT id, day FROM d ORDER BY day DESC, doc_id DESC, id LIMIT 20 OFFSET 10")
def list_page_created(spark, sf_dir):
    _, page = reports.list_notes(_catalog(spark, sf_dir), source="Manual", since="2021-01-01", limit=20, offset=10)
    return page.select("id", "day")


@query(f"WITH {_CATALOG} SELECT id, written FROM c WHERE lower(source) = 'src7' ORDER BY doc_id DESC LIMIT 20")
def list_page_recent(spark, sf_dir):
    _, page = reports.list_notes(_catalog(spark, sf_dir), tag="SRC7", sort="recent", limit=20)
    return page.select("id", "written")


_STATUS = "CASE length(text) % 7 WHEN 0 THEN 'worked' WHEN 1 THEN 'failed' WHEN 2 THEN 'partial' END"


@query(f"SELECT conv_id AS id, coalesce(arg_max(s, turn) FILTER (s IS NOT NULL), 'hypothesis') AS status, count(*) AS turns FROM (SELECT *, {_STATUS} AS s FROM conversations) GROUP BY conv_id")
def idea_lifecycle(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "turn", F.expr(_STATUS).alias("status"))
    return reports.idea_status(turns)


@query(r"""WITH t AS (SELECT conv_id, turn, regexp_replace(text, '\s+$', '') AS rt, trim(text) AS tt, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations)
SELECT conv_id, md5(string_agg(CASE WHEN n = 1 THEN CASE WHEN total = 1 THEN '' ELSE rt END ELSE chr(10) || chr(10) || '## Update 2024-02-01 00:00 UTC' || chr(10) || chr(10) || CASE WHEN n = total THEN tt || chr(10) ELSE regexp_replace(tt, '\s+$', '') END END, '' ORDER BY n)) AS digest
FROM t WHERE total > 1 GROUP BY conv_id""")
def append_update(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t")).where("size(t) > 1")  # a conversation's turns
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    body = F.aggregate(F.slice("t", 2, F.size("t")), F.get("t", F.lit(0))["text"], lambda acc, x: append(acc, x["text"], now))
    return turns.select("conv_id", F.md5(body.cast("binary")).alias("digest"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_complete FROM events")
def last_complete_carry(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("source"), "ts", F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("complete"))
    return reports.last_complete(runs).select("event_id", "last_complete")
