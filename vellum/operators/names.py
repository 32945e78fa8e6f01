"""File names from titles: the first free ``Title (n)`` for each note, for any number of notes that want one title.

A title's slots are 1 (the bare title), 2, 3... Notes that already hold a slot of their title keep the smallest they hold. The
others are ranked by title in order of arrival, and the r-th of a title gets the title's r-th free slot: free slots are the gaps
between taken ones, each gap knows how many free slots stand before it, and ranks meet gaps in bins of BIN ranks, so a bin joins
a bounded number of both. Behind the last gap the slot is the rank plus the number of taken slots.

Ranks come from a sort by range: a row's place in its range, less the first place of its title there, plus the title's rows
in the ranges before. So no task holds all rows of a title.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BIN = 64
Keep = Callable[[DataFrame, str], DataFrame]


def ranked_by(rows: DataFrame, group: str, order: list[str], keep: Keep, name: str) -> DataFrame:
    """Adds ``rank``, from 1 within each group. ``keep`` writes a table and reads it back: places are given once."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id())
    laid = keep(laid.withColumn("_range", F.shiftright("_at", 33)), name)
    parts = laid.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    parts = parts.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_rows")
    return laid.join(parts, [group, "_range"]).withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before") + 1).drop("_at", "_range", "_first", "_before")


def free_names(wanted: DataFrame, taken: DataFrame, keep: Keep) -> DataFrame:
    """wanted: id, title and seq (order of arrival, unique in a title); taken: title, n and id (whose slot it is). Returns id,
    title, n and name. A null title is a title like others and is named by the empty text; slots below 1 are nobody's."""
    wanted = wanted.select("id", F.coalesce("title", F.lit("")).alias("title"), "seq")
    taken = taken.select(F.coalesce("title", F.lit("")).alias("title"), F.col("n").cast("long").alias("n"), "id").where("n >= 1")
    own = taken.where("id IS NOT NULL").groupBy("title", "id").agg(F.min("n").alias("own"))
    held = wanted.join(own, ["title", "id"], "left")
    asking = ranked_by(held.where("own IS NULL").drop("own"), "title", ["seq"], keep, "asking")

    # the i-th taken slot t has t - i free ones below it; between it and the one before lies a gap
    slots = keep(ranked_by(taken.select("title", "n").distinct(), "title", ["n"], keep, "slots").withColumn("below", F.col("n") - F.col("rank")), "ranked")
    after = slots.select("title", (F.col("rank") + 1).alias("rank"), F.col("below").alias("before"))
    most = asking.groupBy("title").agg(F.max("rank").alias("most"))
    gaps = slots.join(after, ["title", "rank"], "left").withColumn("before", F.coalesce("before", F.lit(0))).where("below > before").join(most, "title").where("before < most")
    # ranks before + 1 to below get slots rank + (taken slots under the gap)
    bins = gaps.select("title", "before", "below", (F.col("rank") - 1).alias("under"), F.explode(F.expr(f"sequence((before + 1) div {BIN}, least(below, most) div {BIN})")).alias("bin"))
    binned = asking.withColumn("bin", F.expr(f"rank div {BIN}")).alias("w")
    at = (F.col("w.title") == F.col("g.title")) & (F.col("w.bin") == F.col("g.bin")) & (F.col("w.rank") > F.col("g.before")) & (F.col("w.rank") <= F.col("g.below"))
    in_gap = binned.join(bins.alias("g"), at, "left").select("w.id", "w.title", "w.rank", "g.under")
    count = slots.groupBy("title").agg(F.count("*").alias("all"))
    numbered = in_gap.join(count, "title", "left")
    numbered = numbered.select("id", "title", (F.col("rank") + F.coalesce("under", "all", F.lit(0))).alias("n"))
    out = numbered.unionByName(held.where("own IS NOT NULL").select("id", "title", F.col("own").alias("n")))
    return out.withColumn("name", F.when(F.col("n") == 1, F.col("title")).otherwise(F.concat("title", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))))
