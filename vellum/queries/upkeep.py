"""Reindexing, ingest of landed pages, and file names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.names import free_names
from ..plans.reindex import Reindex
from ..plans.store import Snapshots
from ..session import scratch, table
from ..sources.paged import read_pages
from ..streaming.ingest import Ingest, landed_pages
from . import query


def _kept(spark):
    """Writes a table into a folder of its own and reads it back."""
    top = scratch(spark)

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{top}/{name}")
        return spark.read.schema(df.schema).parquet(f"{top}/{name}")

    return keep


@query("""WITH d AS (SELECT 'doc/' || doc_id || '.md' AS path, coalesce(text, '') AS text, doc_id % 11 = 3 AS gone, doc_id % 7 = 2 AS changed, doc_id % 7 = 2 AND doc_id % 13 = 5 AS touched FROM documents)
SELECT path, (CASE WHEN changed AND NOT touched THEN 2 ELSE 1 END)::DOUBLE AS mtime, md5(CASE WHEN changed AND NOT touched THEN 'second ' || text ELSE text END) AS digest FROM d WHERE NOT gone""")
def reindex_states(spark, sf_dir):
    """The documents as files in two states: some change, some go, and some of the changed change again while they are read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.format_string("doc/%d.md", "doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    changed, gone, touched = F.expr("doc_id % 7 = 2"), F.expr("doc_id % 11 = 3"), F.expr("doc_id % 13 = 5")
    second = docs.where(~gone).withColumn("text", F.when(changed, F.concat(F.lit("second "), "text")).otherwise(F.col("text"))).withColumn("mtime", F.when(changed, 2.0).otherwise(1.0))
    later = second.withColumn("mtime", F.when(changed & touched, 3.0).otherwise(F.col("mtime")))
    looks = [docs.withColumn("mtime", F.lit(1.0))] * 2 + [second, later]
    state = {"now": looks[0]}

    def files() -> DataFrame:
        state["now"] = looks.pop(0)
        return state["now"]

    notes = lambda paths: state["now"].join(paths, "path", "left_semi").select("path", F.col("path").alias("id"), "mtime", "text", F.lit(None).cast("string").alias("error"))
    store = Snapshots(spark, scratch(spark), "path string, note_id string, text string, mtime double")
    job = Reindex(spark, store, scratch(spark), files=files, read=notes, rows=lambda n: n.select("path", F.col("id").alias("note_id"), "text", "mtime"))
    job.run()
    job.run()
    return store.read().select("path", "mtime", F.md5(F.col("text").cast("binary")).alias("digest"))


def _landed(spark, sf_dir) -> str:
    """The events as a service lands them: a window for each month, pages of about 500 items as JSON answers."""
    top = scratch(spark)
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.date_format("ts", "yyyy-MM").alias("month"))
    sizes = events.groupBy("month").agg(F.count("*").alias("total"))
    paged = events.join(sizes, "month").withColumn("pages", F.expr("cast(ceil(total / 500) as int)")).withColumn("page", F.pmod(F.xxhash64("event_id"), F.col("pages")).cast("int"))
    answers = paged.groupBy("month", "page", "total").agg(F.to_json(F.struct(F.first("total").alias("total"), F.collect_list(F.struct("event_id", "user_id", "event_type", "value")).alias("items"))).alias("answer"))  # one page

    def land(rows):
        from pyarrow import fs

        for row in rows:
            files, path = fs.FileSystem.from_uri(f"{top}/{row['month']}") if "://" in top or top.startswith("file:") else (fs.LocalFileSystem(), f"{top}/{row['month']}")
            files.create_dir(path, recursive=True)
            with files.open_output_stream(f"{path}/{row['page']}.json") as out:
                out.write(row["answer"].encode())

    answers.foreachPartition(land)
    return top


_ITEM = "struct<event_id: bigint, user_id: bigint, event_type: string, value: double>"


@query("SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS n, round(sum(value), 2) AS total, 0 AS faults FROM events GROUP BY ALL")
def paged_events(spark, sf_dir):
    """Pages of the events through the data source: one partition for each window."""
    rows = read_pages(spark, _landed(spark, sf_dir))
    item = F.from_json("item", _ITEM)
    faults = rows.where("fault IS NOT NULL").agg(F.count("*").cast("int").alias("faults"))
    return rows.where("fault IS NULL").select(F.col("window").alias("month"), item.alias("i")).groupBy("month", "i.event_type").agg(F.count("*").alias("n"), F.round(F.sum("i.value"), 2).alias("total")).crossJoin(F.broadcast(faults))


@query("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY event_type")
def ingest_events(spark, sf_dir):
    """Pages of the events through the ingest driver, flush by flush."""
    store = Snapshots(spark, scratch(spark), "id string, event_type string")
    job = Ingest(store, "events", lambda rows: rows.select(F.format_string("event-%d", "item.event_id").alias("id"), "item.event_type"), flush=20_000)
    job.start(landed_pages(spark, _landed(spark, sf_dir), _ITEM), f"{scratch(spark)}/checkpoint").awaitTermination()
    return store.read().groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'One title' ELSE source END AS title FROM documents),
t AS (SELECT title, 1 + doc_id // 10 AS n FROM d WHERE doc_id % 5 = 0),
s AS (SELECT title, n - row_number() OVER (PARTITION BY title ORDER BY n) AS below FROM (SELECT DISTINCT title, n FROM t)),
w AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY doc_id) AS r FROM d WHERE doc_id % 5 <> 0),
f AS (SELECT doc_id, title, r + (SELECT count(*) FROM s WHERE s.title = w.title AND s.below < w.r) AS n FROM w)
SELECT doc_id, n, CASE WHEN n = 1 THEN title ELSE title || ' (' || n || ')' END AS name FROM f""")
def free_titles(spark, sf_dir):
    """Half of the documents want one title; every fifth document holds a slot already."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.expr("doc_id % 2 = 0"), "One title").otherwise(F.col("source")).alias("title"))
    taken = docs.where("doc_id % 5 = 0").select("title", F.expr("1 + doc_id div 10").alias("n"), F.lit(None).cast("long").alias("id"))
    wanted = docs.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), "title", F.col("doc_id").alias("seq"))
    return free_names(wanted, taken, _kept(spark)).select(F.col("id").alias("doc_id"), "n", "name")
