"""Streams: file sync in micro-batches, event-time windows with watermarks, in-run dedup, and idea lifecycles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, path: str, schema: str, *, glob: str = "*.parquet", max_files: int = 200) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files).parquet(path)


def with_event_time(events: DataFrame, lateness: str) -> DataFrame:
    """ts as an instant (Parquet has it without a zone; it is UTC) under a watermark."""
    return events.withColumn("ts", F.to_timestamp(F.col("ts"))).withWatermark("ts", lateness)


def tumbling(events: DataFrame, width: str, lateness: str = "1 hour") -> DataFrame:
    return with_event_time(events, lateness).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("start_ts"), "n", "total")


def sliding(events: DataFrame, width: str, step: str, lateness: str = "1 hour") -> DataFrame:
    return with_event_time(events, lateness).groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start_ts"), "n")


def sessions(events: DataFrame, gap: str, lateness: str = "1 hour") -> DataFrame:
    return with_event_time(events, lateness).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n")


def first_seen(rows: DataFrame, keys: list[str], lateness: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return with_event_time(rows, lateness).dropDuplicatesWithinWatermark(keys)


def sync(source: DataFrame, commit: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand every micro-batch to ``commit`` once; the checkpoint remembers what was handed over. Files that are gone are not
    seen by a stream: reports.index_diff finds them."""
    return source.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def idea_lifecycle(turns: DataFrame) -> DataFrame:
    """The status of each idea (conv_id) as its turns (turn, status or null) come in; state is one string and one number."""

    def each(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, last = state.get if state.exists else ("hypothesis", -1)
        n = 0
        for frame in frames:
            told = frame[frame["status"].notna() & (frame["turn"] > last)]
            if len(told):
                row = told.loc[told["turn"].idxmax()]
                status, last = str(row["status"]), int(row["turn"])
            n += len(frame)
        state.update((status, last))
        yield pd.DataFrame({"conv_id": [key[0]], "status": [status], "last_turn": [last], "seen": [n]})

    return turns.groupBy("conv_id").applyInPandasWithState(each, "conv_id long, status string, last_turn long, seen long", "status string, last_turn long", "update", GroupStateTimeout.NoTimeout)
