"""Counts, listings, ledgers and run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import effective_day
from ..functions.text import blank


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def duplicate_ids(notes: DataFrame) -> DataFrame:
    """Ids that several files carry, their paths, and whether their bodies are equal."""
    digest = F.sha1(F.trim(blank(F.col("body"))).cast("binary"))
    rows = notes.groupBy("id").agg(F.count("*").alias("files"), F.array_sort(F.collect_list("path")).alias("paths"), (F.count_distinct(digest) == 1).alias("identical"))
    return rows.where("files > 1")


def index_diff(files: DataFrame, index: DataFrame) -> DataFrame:
    """path and status: unchanged (every held row has the file's mtime), todo or missing (indexed, but no file)."""
    held = index.groupBy("path").agg(F.min("mtime").alias("lo"), F.max("mtime").alias("hi"))
    j = files.select("path", "mtime").alias("f").join(held.alias("i"), "path", "full_outer")
    status = F.when(F.col("mtime").isNull(), "missing").when(F.col("lo").isNull(), "todo").when((F.col("lo") == F.col("mtime")) & (F.col("hi") == F.col("mtime")), "unchanged").otherwise("todo")
    return j.select("path", status.alias("status"))


def reap_allowed(n_missing: int, n_files: int) -> bool:
    """Whether so many indexed files may be gone: a share that large means the folder is not all there."""
    return n_missing <= max(50, n_files // 5)


def same_text(a: Column, b: str) -> Column:
    return F.lower(F.trim(blank(a))) == b.strip().lower()


def list_notes(catalog: DataFrame, *, type: str | None = None, program: str | None = None, status: str | None = None, tag: str | None = None, source: str | None = None, since: str | None = None, sort: str = "created", limit: int = 20, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(all that match, one page of them, newest first). catalog: id, type, program, status, tags, source, created, mtime_ns (long, or
    decimal for times that a long of nanoseconds does not hold)."""
    if sort not in ("created", "recent"):
        raise ValueError("sort must be 'created' or 'recent'")
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be within 1 and 500, offset not negative")
    rows = catalog.withColumn("day", effective_day(F.col("created"), F.col("mtime_ns"))).withColumn("written", effective_day(F.lit(None).cast("date"), F.col("mtime_ns")))
    if type:
        rows = rows.where(F.col("type") == type)
    for column, value in (("program", program), ("status", status), ("source", source)):
        if value:
            rows = rows.where(same_text(F.col(column), value))
    if tag:
        rows = rows.where(F.exists("tags", lambda t: F.lower(F.trim(t)) == tag.strip().lower()))
    if since:
        rows = rows.where((F.col("written") if sort == "recent" else F.col("day")) >= F.lit(since).cast("date"))
    order = [F.col("mtime_ns").desc(), F.col("id")] if sort == "recent" else [F.col("day").desc(), F.col("mtime_ns").desc(), F.col("id")]
    return rows, rows.orderBy(*order).offset(offset).limit(limit)


def ledger_by_severity(rows: DataFrame) -> DataFrame:
    """Rows, stated rewards, their exact median and maximum by severity; undecided and zero rewards are left out, not counted as 0."""
    paid = F.when(F.col("reward_usd") > 0, F.col("reward_usd"))
    return rows.groupBy("severity").agg(F.count("*").alias("n"), F.count(paid).alias("stated"), F.median(paid).alias("median_usd"), F.max(paid).alias("max_usd"))


def ledger_top(rows: DataFrame, column: str, top: int = 40) -> DataFrame:
    """The most frequent values: count, external count, severities seen (worst first), stated total."""
    place = F.transform(F.array_sort(F.collect_set(F.struct(F.expr("array_position(array('Critical','High','Medium','Low'), severity)").alias("o"), "severity"))), lambda s: s["severity"])
    out = rows.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(column).agg(F.count("*").alias("n"), F.count_if(~F.col("internal")).alias("external"), F.array_join(place, ", ").alias("severities"), F.sum(F.when(F.col("reward_usd") > 0, F.col("reward_usd"))).alias("stated_usd"))
    return out.orderBy(F.col("n").desc(), column).limit(top)


def ledger_summary(rows: DataFrame) -> DataFrame:
    day = F.nullif("reported_on", F.lit(""))
    return rows.agg(F.count("*").alias("n"), F.count_distinct("cve").alias("unique_cves"), F.count_if(~F.col("internal")).alias("external"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def first_per_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; one pass of map-side aggregation instead of a window."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*")


def date_windows(spark, first: str, last: str, days: int = 120) -> DataFrame:
    """Windows of at most ``days`` days, inclusive, one after another from first to last."""
    starts = spark.sql(f"SELECT explode(sequence(DATE '{first}', DATE '{last}', INTERVAL {int(days)} DAYS)) AS start_day")
    return starts.select("start_day", F.least(F.date_add("start_day", days - 1), F.lit(last).cast("date")).alias("end_day"))


def last_complete(runs: DataFrame) -> DataFrame:
    """Each run with the time of its source's last complete run so far. runs: source, ts, seq, complete."""
    w = Window.partitionBy("source").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("last_complete", F.last(F.when(F.col("complete"), F.col("ts")), True).over(w))


def run_counters(runs: DataFrame, statuses: list[str]) -> DataFrame:
    return runs.groupBy("source").agg(*[F.count_if(F.col("status") == s).alias(s) for s in statuses])


def tail(rows: DataFrame, order: str, n: int) -> DataFrame:
    return rows.orderBy(F.col(order).desc()).limit(n)


def idea_status(turns: DataFrame) -> DataFrame:
    """The state of each idea after its turns (id, turn, status or null): hypothesis until an outcome is recorded."""
    return turns.groupBy("id").agg(F.coalesce(F.max_by("status", F.when(F.col("status").isNotNull(), F.col("turn"))), F.lit("hypothesis")).alias("status"), F.count("*").alias("turns"))
