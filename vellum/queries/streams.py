"""Streams run to the end of what is there, next to their batch meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch, table
from ..streaming import flows
from . import query


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files."""
    schema = table(spark, sf_dir, "events").schema
    glob = "events.parquet"
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(sf_dir)


def _finish(spark: SparkSession, df: DataFrame, mode: str) -> DataFrame:
    """Run to the end; the last batch's table (complete mode) or all rows written."""
    top = scratch(spark)
    if mode == "append":
        flows.run_to_table(df, f"{top}/rows", f"{top}/checkpoint").awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{top}/rows")

    def commit(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{top}/rows")

    df.writeStream.outputMode(mode).foreachBatch(commit).option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{top}/rows")


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start_ts, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    out = _finish(spark, flows.tumbling(_events(spark, sf_dir), "1 hour"), "complete")
    return out.select("event_type", F.col("start_ts").cast("timestamp_ntz").alias("start_ts"), "n", F.round("total", 2).alias("total"))


@query("SELECT w AS start_ts, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS w FROM events) GROUP BY w")
def stream_sliding(spark, sf_dir):
    out = _finish(spark, flows.sliding(_events(spark, sf_dir), "12 hours", "6 hours"), "complete")
    return out.select(F.col("start_ts").cast("timestamp_ntz").alias("start_ts"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start_ts, max(ts) + INTERVAL 2 HOUR AS end_ts, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf_dir):
    out = _finish(spark, flows.sessions(_events(spark, sf_dir), "2 hours"), "complete")
    return out.select("user_id", F.col("start_ts").cast("timestamp_ntz").alias("start_ts"), F.col("end_ts").cast("timestamp_ntz").alias("end_ts"), "n")


@query("SELECT count(*) AS users FROM (SELECT DISTINCT user_id FROM events)")
def stream_first_seen(spark, sf_dir):
    out = _finish(spark, flows.first_seen(_events(spark, sf_dir).select("user_id", "ts"), ["user_id"], "60 days"), "append")
    return out.agg(F.count("*").alias("users"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_sync_counts(spark, sf_dir):
    """Rows handed over by file sync, each once."""
    top = scratch(spark)

    def commit(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{top}/rows/batch={n}")

    flows.sync(_events(spark, sf_dir), commit, f"{top}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{top}/rows").groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT conv_id, coalesce(arg_max(s, turn) FILTER (s IS NOT NULL), 'hypothesis') AS status, coalesce(max(turn) FILTER (s IS NOT NULL), -1)::BIGINT AS last_turn, count(*) AS seen
FROM (SELECT *, CASE length(text) % 7 WHEN 0 THEN 'worked' WHEN 1 THEN 'failed' WHEN 2 THEN 'partial' END AS s FROM conversations) GROUP BY conv_id""")
def idea_states(spark, sf_dir):
    """The state machine of ideas over a stream of turns: what each batch tells of a conversation, the last of it."""
    top = scratch(spark)
    schema = table(spark, sf_dir, "conversations").schema
    turns = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversations*.parquet").select("conv_id", F.col("turn").cast("long").alias("turn"), F.expr("CASE length(text) % 7 WHEN 0 THEN 'worked' WHEN 1 THEN 'failed' WHEN 2 THEN 'partial' END").alias("status"))

    def commit(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{top}/rows/n={n}")

    flows.idea_lifecycle(turns).writeStream.outputMode("update").foreachBatch(commit).option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    told = spark.read.parquet(f"{top}/rows")
    return told.groupBy("conv_id").agg(F.max_by("status", "batch").alias("status"), F.max_by("last_turn", "batch").alias("last_turn"), F.sum("seen").alias("seen"))
