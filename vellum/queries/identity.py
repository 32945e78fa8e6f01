"""Tombstones, known urls, ids, merging, upserting, the snapshot store and the link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import slugify
from ..functions.urls import host
from ..operators import graph, identity, reports
from ..plans import store
from ..session import scratch, table
from . import query
from .texts import CANONICAL_SQL, HOST_SQL


@query("""WITH n AS (SELECT doc_id, concat('doc-', doc_id) AS id, source FROM documents),
t AS (SELECT concat('doc-', user_id) AS id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('SRC', event_id % 20) END AS source FROM events WHERE event_type = (SELECT min(event_type) FROM events))
SELECT doc_id FROM n WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.id = n.id AND (t.source IS NULL OR n.source IS NULL OR lower(t.source) = lower(n.source)))""")
def tombstone_block(spark, sf_dir):
    incoming = table(spark, sf_dir, "documents").select("doc_id", F.expr("concat('doc-', doc_id)").alias("id"), F.lit(None).cast("string").alias("url"), "source")
    events = table(spark, sf_dir, "events")
    kind = events.agg(F.min("event_type")).first()[0]
    stones = events.where(F.col("event_type") == kind).select(F.expr("concat('doc-', user_id)").alias("id"), F.lit(None).cast("string").alias("url"), F.expr("CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('SRC', event_id % 20) END").alias("source"))
    return identity.not_tombstoned(incoming, stones).select("doc_id")


def _articles(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """What arrives over http, and what is stored from https."""
    pages = table(spark, sf_dir, "pages").withColumn("id", F.concat(F.lit("research-"), slugify(host(F.col("url")), 90))).withColumn("seq", F.col("page_id"))
    secure = F.col("url").startswith("https://")
    return pages.where(~secure).select("page_id", "seq", "id", "url"), pages.where(secure).select("page_id", "id", "url")


_ARTICLES = rf"""p AS (SELECT page_id, url, 'research-' || trim(regexp_replace(lower({HOST_SQL}), '[^a-z0-9]+', '-', 'g'), '-') AS id, {CANONICAL_SQL} AS cu FROM pages),
i AS (SELECT * FROM p WHERE NOT starts_with(url, 'https://')), s AS (SELECT * FROM p WHERE starts_with(url, 'https://'))"""


@query(f"WITH {_ARTICLES} SELECT page_id FROM i WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.cu = i.cu AND split_part(s.id, '-', 1) = split_part(i.id, '-', 1))")
def known_url_antijoin(spark, sf_dir):
    incoming, stored = _articles(spark, sf_dir)
    return identity.unknown_urls(incoming, stored).select("page_id")


@query(f"""WITH {_ARTICLES}, k AS (SELECT cu, min(id) AS known FROM s GROUP BY cu), o AS (SELECT DISTINCT id FROM s),
f AS (SELECT i.*, k.known, o.id AS owned, first_value(i.cu) OVER (PARTITION BY i.id ORDER BY i.page_id) AS first_cu FROM i LEFT JOIN k ON k.cu = i.cu LEFT JOIN o ON o.id = i.id)
SELECT page_id, coalesce(known, CASE WHEN owned IS NOT NULL OR first_cu <> cu THEN rtrim(substr(id, 1, 69), '-') || '-' || substr(sha1(cu), 1, 8) ELSE id END) AS note_id FROM f""")
def resolve_id(spark, sf_dir):
    incoming, stored = _articles(spark, sf_dir)
    return identity.resolve_ids(incoming, stored).select("page_id", "note_id")


def _feeds(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Stored records (those with a balance) and incoming ones (those not in BUILDING)."""
    c = table(spark, sf_dir, "customer")
    kind = "CASE WHEN c_nationkey % 5 = 0 THEN 'report' ELSE 'cve' END"
    base = lambda source, tag, shift, kind: [
        F.format_string("CVE-%d", "c_custkey").alias("id"), F.expr(kind).alias("type"), F.concat(F.lit(f"{source} "), "c_name").alias("title"), F.lit(source).alias("source"), F.lit(None).cast("string").alias("url"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.col("c_nationkey") * shift).alias("created"), F.array(F.lit(tag), F.lower("c_mktsegment")).alias("tags"), F.array(F.lit("CWE-79")).alias("cwe"),
        F.when(F.col("c_nationkey") % 3 == 0, F.lit(f"{source}-sev")).alias("severity"), F.lit(None).cast("string").alias("program"), F.create_map(F.lit("k"), F.lit(source)).alias("extra"), F.lit("b").alias("body"),
    ]
    return c.where("c_acctbal >= 0").select(*base("cisa-kev", "kev", 30, kind)), c.where("c_mktsegment <> 'BUILDING'").select(*base("nvd", "cve", 40, "'cve'"))


_MERGED = """WITH s AS (SELECT * FROM customer WHERE c_acctbal >= 0), i AS (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING'),
j AS (SELECT coalesce(s.c_custkey, i.c_custkey) AS key, coalesce(s.c_name, i.c_name) AS name, coalesce(s.c_nationkey, i.c_nationkey) AS nk, lower(coalesce(s.c_mktsegment, i.c_mktsegment)) AS seg, s.c_custkey IS NOT NULL AS has_s, i.c_custkey IS NOT NULL AS has_i
  FROM s FULL OUTER JOIN i ON s.c_custkey = i.c_custkey),
m AS (SELECT 'CVE-' || key AS id, CASE WHEN has_s THEN 'cisa-kev ' ELSE 'nvd ' END || name AS title, CASE WHEN has_s THEN 'cisa-kev' ELSE 'nvd' END AS source,
  (DATE '2020-01-01' + (nk * CASE WHEN has_i THEN 40 ELSE 30 END)::INTEGER) AS created,
  CASE WHEN has_s AND has_i THEN 'kev,' || seg || ',cve' WHEN has_s THEN 'kev,' || seg ELSE 'cve,' || seg END AS tags,
  CASE WHEN nk % 3 = 0 THEN CASE WHEN has_i THEN 'nvd-sev' ELSE 'cisa-kev-sev' END END AS severity,
  CASE WHEN has_s AND has_i THEN 'cisa-kev,nvd' END AS sources,
  CASE WHEN NOT has_s THEN 'new' WHEN NOT has_i THEN 'kept' WHEN nk % 5 = 0 THEN 'conflict' ELSE 'merged' END AS status FROM j)"""


@query(f"{_MERGED} SELECT * FROM m")
def upsert_merge(spark, sf_dir):
    merged = identity.merge_cve(*_feeds(spark, sf_dir))
    return merged.select("id", "title", "source", "created", F.array_join("tags", ",").alias("tags"), "severity", F.expr("extra['sources']").alias("sources"), "status")


@query(f"{_MERGED} SELECT count(*) AS n, 0::BIGINT AS changed_by_rerun FROM m WHERE status <> 'conflict'")
def merge_idempotence(spark, sf_dir):
    stored, incoming = _feeds(spark, sf_dir)
    once = identity.merge_cve(stored, incoming).where("status <> 'conflict'")
    again = identity.merge_cve(once.withColumn("body", F.coalesce("stored_body", "incoming_body")).select(stored.columns), incoming).where("status <> 'conflict'")
    cols = ["id", "title", "source", "created", "tags", "cwe", "severity"]
    j = once.select("id", F.xxhash64(*cols).alias("a")).join(again.select("id", F.xxhash64(*cols).alias("b")), "id", "left")
    return j.agg(F.count("*").alias("n"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("changed_by_rerun"))


_PARTS = "id string, note_id string, path string, quality int"


def _snapshot(spark, rows: DataFrame, schema: str) -> store.Snapshots:
    s = store.Snapshots(spark, scratch(spark), schema)
    s.overwrite(rows)
    return s


@query("SELECT 's-' || s_suppkey AS id, 's-' || s_suppkey AS note_id, 'nation-' || s_nationkey AS path, CASE WHEN s_nationkey < 10 THEN 99 ELSE s_suppkey % 100 END AS quality FROM supplier WHERE s_nationkey >= 10 OR s_acctbal < 5000")
def replace_scope(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.format_string("s-%d", "s_suppkey").alias("id"), F.format_string("s-%d", "s_suppkey").alias("note_id"), F.format_string("nation-%d", "s_nationkey").alias("path"), F.expr("cast(s_suppkey % 100 AS int)").alias("quality"), "s_nationkey", "s_acctbal")
    s = _snapshot(spark, rows.select("id", "note_id", "path", "quality"), _PARTS)
    scope = rows.where("s_nationkey < 10")
    s.replace_scope(scope.where("s_acctbal < 5000").withColumn("quality", F.lit(99)).select("id", "note_id", "path", "quality"), scope.select("path"), "path")
    return s.read()


@query("SELECT 'p-' || p_partkey AS id, p_name AS path FROM part WHERE p_brand <> (SELECT min(p_brand) FROM part)")
def delete_scope(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = part.select(F.format_string("p-%d", "p_partkey").alias("id"), F.col("p_brand").alias("note_id"), F.col("p_name").alias("path"), F.col("p_size").cast("int").alias("quality"))
    s = _snapshot(spark, rows, _PARTS)
    s.delete(part.agg(F.min("p_brand").alias("note_id")), "note_id")
    return s.read().select("id", "path")


@query("SELECT 'p-' || p_partkey AS note_id, CASE WHEN p_retailprice > 1000 THEN least(100, p_size * 3) ELSE p_size END::INTEGER AS quality, (p_retailprice > 1000 AND least(100, p_size * 3) <> p_size) AS changed FROM part")
def rescore(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("note_id", F.format_string("p-%d", "p_partkey"))
    base = part.select("note_id", F.col("p_size").cast("int").alias("quality"))
    return store.rescored(base, part.where("p_retailprice > 1000").select("note_id", (F.col("p_size") * 3).alias("quality"))).select("note_id", "quality", "changed")


@query("""WITH n AS (SELECT conv_id, role, turn, turn % 3 AS idx, row_number() OVER (PARTITION BY conv_id, role, turn % 3 ORDER BY turn, text) AS nth FROM conversations),
c AS (SELECT *, max(nth) OVER (PARTITION BY conv_id, role ORDER BY turn ROWS UNBOUNDED PRECEDING) AS copy FROM n),
l AS (SELECT *, max(copy) OVER (PARTITION BY conv_id, role) AS last FROM c)
SELECT conv_id, role, turn FROM l WHERE copy = last""")
def dedup_last_copy(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("note_id"), F.col("role").alias("path"), (F.col("turn") % 3).alias("chunk_index"), F.col("turn").alias("seq"))
    return store.last_copies(rows).select(F.col("note_id").alias("conv_id"), F.col("path").alias("role"), F.col("seq").alias("turn"))


@query("""WITH f AS (SELECT doc_id, n_chars AS mtime FROM documents WHERE lang <> 'fr'), i AS (SELECT doc_id, n_chars + CASE WHEN n_chars % 7 = 0 THEN 1 ELSE 0 END AS mtime FROM documents WHERE lang <> 'es')
SELECT coalesce(f.doc_id, i.doc_id) AS doc_id, CASE WHEN f.doc_id IS NULL THEN 'missing' WHEN i.doc_id IS NULL OR i.mtime <> f.mtime THEN 'todo' ELSE 'unchanged' END AS status FROM f FULL OUTER JOIN i ON f.doc_id = i.doc_id""")
def index_diff(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("path", F.col("doc_id"))
    files = docs.where("lang <> 'fr'").select("path", F.col("n_chars").cast("double").alias("mtime"))
    index = docs.where("lang <> 'es'").select("path", F.expr("cast(n_chars + CASE WHEN n_chars % 7 = 0 THEN 1 ELSE 0 END AS double)").alias("mtime"))
    return reports.index_diff(files, index).select(F.col("path").alias("doc_id"), "status")


def _customers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.format_string("tech-%d", "c_custkey").alias("id"), F.col("c_mktsegment").alias("title"), F.concat(F.lit("technique/"), "c_name", F.lit(".md")).alias("path"))


_SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"
_KEYS = f"""k AS (SELECT 'technique/' || c_name || '.md' AS path, unnest([{{'t': 0, 'k': 'tech-' || c_custkey}}, {{'t': 3, 'k': {_SLUG.format('c_name')}}}, {{'t': 4, 'k': {_SLUG.format('c_mktsegment')}}}, {{'t': 5, 'k': c_custkey::VARCHAR}}]) AS e FROM customer),
m AS (SELECT path, e.k AS key, min(e.t) AS tier FROM k GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY key ORDER BY tier) AS place FROM m)"""


@query(f"WITH {_KEYS} SELECT path, key, tier::INTEGER AS tier FROM r WHERE place = 1")
def link_tiers(spark, sf_dir):
    return graph.keys(_customers(spark, sf_dir)).select("path", "key", "tier")


@query("""WITH RECURSIVE seeds AS (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5),
e AS (SELECT 'o-' || o_orderkey AS a, 'c-' || o_custkey AS b FROM orders UNION ALL SELECT 'c-' || c_custkey, 'n-' || c_nationkey FROM customer UNION ALL SELECT 'n-' || n_nationkey, 'r-' || n_regionkey FROM nation),
w(node, hop) AS (SELECT 'o-' || o_orderkey, 0 FROM seeds UNION SELECT e.b, w.hop + 1 FROM w JOIN e ON e.a = w.node WHERE w.hop < 3)
SELECT node AS path, min(hop)::INTEGER AS hop FROM w WHERE hop > 0 GROUP BY node""")
def expand_hops(spark, sf_dir):
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    link = lambda df, a, x, b, y: df.select(F.format_string(f"{a}-%d", x).alias("path"), F.lit(0).alias("pos"), F.format_string(f"{b}-%d", y).alias("key"))
    edges = link(orders, "o", "o_orderkey", "c", "o_custkey").unionByName(link(customer, "c", "c_custkey", "n", "c_nationkey")).unionByName(link(nation, "n", "n_nationkey", "r", "n_regionkey"))
    keys = edges.select(F.col("key"), F.col("key").alias("path")).distinct()
    seeds = orders.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(5).select(F.format_string("o-%d", "o_orderkey").alias("path"))
    return graph.expand(seeds, edges, keys, hops=3, limit=1000).select("path", "hop")


@query(f"""WITH c AS (SELECT 'technique/' || c_name || '.md' AS path, unnest([{{'t': 0, 'r': 'tech-' || c_custkey}}, {{'t': 1, 'r': 'technique/' || c_name || '.md'}}, {{'t': 4, 'r': {_SLUG.format('c_name')}}}]) AS e FROM customer),
refs AS (SELECT 'tech-' || s_suppkey AS ref FROM supplier UNION SELECT {_SLUG.format("replace(s_name, 'Supplier', 'Customer')")} FROM supplier),
h AS (SELECT ref, path, min(e.t) AS tier FROM refs JOIN c ON c.e.r = refs.ref GROUP BY ALL), b AS (SELECT ref, min(tier) AS tier FROM h GROUP BY ref)
SELECT h.ref, h.path, h.tier::INTEGER AS tier, count(*) OVER (PARTITION BY h.ref) AS candidates FROM h JOIN b ON h.ref = b.ref AND h.tier = b.tier""")
def resolve_reference(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    refs = s.select(F.format_string("tech-%d", "s_suppkey").alias("ref")).union(s.select(slugify(F.replace("s_name", F.lit("Supplier"), F.lit("Customer")))))
    return graph.resolve(refs, _customers(spark, sf_dir)).select("ref", "path", "tier", "candidates")
