"""JSON-lines files that people edit: every line keeps its number and its fault."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, line (from 1), the schema's columns, and problem for lines that are no JSON object. A whole file is one row
    first, so that line numbers are those of the file; use it for ledgers and verdicts, not for corpora."""
    files = spark.read.format("binaryFile").load(path)
    utf16 = F.hex(F.substring("content", 1, 2)).isin("FFFE", "FEFF")
    text = F.when(utf16, F.decode("content", "UTF-16")).otherwise(F.decode("content", "UTF-8"))
    rows = files.select("path", F.posexplode(F.split(F.regexp_replace(text, "^﻿", ""), r"\r?\n")).alias("n", "raw")).where(F.trim("raw") != "")
    parsed = F.from_json("raw", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = rows.select(F.col("path").alias("file"), (F.col("n") + 1).alias("line"), parsed.alias("r"), F.trim("raw").startswith("{").alias("is_object"))
    bad = F.when(~F.col("is_object") | F.col("r._bad").isNotNull() | F.col("r").isNull(), "not a JSON object")
    return rows.select("file", "line", "r.*", bad.alias("problem")).drop("_bad")


def write_lines(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("append").text(path)


def read_run_state(spark: SparkSession, path: str) -> DataFrame:
    """source, last_run, last_complete of a state file (one JSON object from source to record)."""
    raw = spark.read.option("wholetext", "true").text(path)
    state = F.from_json("value", "map<string,struct<last_run:string,last_complete:string,saved:long,errors:long>>")
    return raw.select(F.explode(state).alias("source", "r")).select("source", "r.*")
