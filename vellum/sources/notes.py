"""Markdown note files with YAML front matter."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date, datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slugify
from ..schema import NOTE, NOTE_TYPES

_LISTS = ("tags", "cwe", "assets", "links")
_TEXTS = ("source", "url", "severity", "program")
_MODELLED = {"id", "type", "title", "created", "ingested", "bounty", "extra", *_LISTS, *_TEXTS}


def walk(spark: SparkSession, root: str, ignore: tuple[str, ...] = ("Templates",), only: list[str] | None = None) -> DataFrame:
    """path (below the root), mtime, length and content of every note file; hidden and underscored names, read-me files and
    ignored folders are passed over. ``only``: paths to look at, all of which must be there."""
    where = root if only is None else [f"{root.rstrip('/')}/{p}" for p in only]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(where)
    rel = F.regexp_replace(F.expr("substring(path, locate(r, path) + length(r))"), "^/+", "")
    parts = F.split("path", "/")
    hidden = F.exists(parts, lambda p: p.startswith(".") | p.startswith("_"))
    ignored = F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, ignore)))
    out = files.withColumn("r", F.lit("/" + root.split("://")[-1].strip("/"))).select(rel.alias("path"), F.unix_micros("modificationTime").cast("double").alias("micros"), "length", "content")
    return out.where(~hidden & ~ignored & (F.lower(F.element_at(parts, -1)) != "readme.md")).select("path", (F.col("micros") / 1e6).alias("mtime"), "length", "content")


def _items(value: object) -> list[str] | None:
    """A list of texts from a list or one value; None for what is neither."""
    values = value if isinstance(value, (list, tuple)) else [] if value is None else [value]
    if any(isinstance(v, (list, tuple, dict)) for v in values):
        return None
    return [s for v in values if v is not None and (s := str(v).strip())]


def _day(value: object) -> date | None:
    if isinstance(value, datetime):
        return value.date()
    if isinstance(value, date):
        return value
    return datetime.fromisoformat(str(value).strip()).date()


def _time(value: object) -> datetime:
    got = value if isinstance(value, datetime) else datetime.fromisoformat(str(value).strip())
    return got if got.tzinfo else got.replace(tzinfo=timezone.utc)


def parse_note(text: str) -> dict:
    """Columns of one note, or {"error": why it is none}. Bad optional values are kept, as text, under ``invalid``."""
    import yaml

    text = text.removeprefix("﻿")
    if not text.strip():
        return {"error": "empty file"}
    lines = text.splitlines(keepends=True)
    end = next((i for i, line in enumerate(lines[1:], 1) if line.rstrip() == "---"), None) if lines[0].rstrip() == "---" else None
    if end is None:
        return {"error": "no frontmatter"}
    try:
        head = yaml.safe_load("".join(lines[1:end]))
    except yaml.YAMLError as e:
        return {"error": f"bad frontmatter: {str(e).splitlines()[0]}"}
    if not isinstance(head, dict) or not head:
        return {"error": "no frontmatter"}
    body = "".join(lines[end + 1 :]).strip()
    missing = [k for k in ("id", "type", "title") if head.get(k) in (None, "") or isinstance(head[k], (dict, list))]
    kind = str(head.get("type", "")).strip().lower()
    if missing or kind not in NOTE_TYPES:
        return {"error": f"missing {', '.join(missing)}" if missing else f"unknown type {kind!r}"}
    out: dict = {"id": str(head["id"]), "type": kind, "title": str(head["title"]), "body": body, "error": None}
    invalid, convert = {}, {**{k: str for k in _TEXTS}, "created": _day, "ingested": _time, "bounty": lambda v: float(str(v).replace(",", "").strip().strip("$"))}
    for key, to in convert.items():
        value = head.get(key)
        try:
            out[key] = None if value is None or str(value).strip() == "" else to(value)
        except (ValueError, TypeError):
            out[key], invalid[key] = None, str(value)
    for key in _LISTS:
        out[key] = _items(head.get(key))
        if out[key] is None:
            out[key], invalid[key] = [], json.dumps(head[key], default=str)
    out["cwe"] = [f"CWE-{c}" if c.isdigit() else c.upper() for c in out["cwe"]]
    out["severity"] = out["severity"].strip().lower() if out["severity"] else None
    more = head.get("extra")
    if more is not None and not isinstance(more, dict):
        invalid["extra"], more = json.dumps(more, default=str), None
    out["extra"] = json.dumps(more or {}, default=str, ensure_ascii=False)
    out["unmodelled"] = json.dumps({str(k): v for k, v in head.items() if k not in _MODELLED}, default=str, ensure_ascii=False)
    out["invalid"] = invalid
    return out


def render_note(row: dict) -> str:
    """The file of a note: front matter without empty fields, an empty line, the body."""
    import yaml

    head = {k: row[k] for k in ("id", "type", "title")}
    head |= {k: row[k] for k in (*_TEXTS[:2], "program", "severity", "bounty") if row.get(k) not in (None, "")}
    head |= {k: row[k].isoformat() for k in ("created", "ingested") if row.get(k)}
    head |= {k: list(row[k]) for k in ("cwe", "tags", "assets", "links") if row.get(k)}
    more, rest = json.loads(row.get("extra") or "{}"), json.loads(row.get("unmodelled") or "{}")
    head |= ({"extra": more} if more else {}) | rest
    for k, v in (row.get("invalid") or {}).items():
        head.setdefault(k, v)
    return f"---\n{yaml.safe_dump(head, sort_keys=False, allow_unicode=True).strip()}\n---\n\n{(row.get('body') or '').strip()}\n"


def _arrow_schema() -> pa.Schema:
    kinds = {"double": pa.float64(), "string": pa.string(), "date": pa.date32(), "timestamp": pa.timestamp("us", "UTC"), "array<string>": pa.list_(pa.string()), "map<string,string>": pa.map_(pa.string(), pa.string())}
    return pa.schema([(n, kinds[t]) for n, t in (c.split(" ") for c in NOTE.split(", "))])


def parse(files: DataFrame) -> DataFrame:
    """Notes of ``walk``; files that are none keep their row with ``error``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow_schema()
        for batch in batches:
            rows = []
            for path, mtime, content in zip(*(batch.column(c).to_pylist() for c in ("path", "mtime", "content")), strict=True):
                try:
                    got = parse_note((content or b"").decode("utf-8"))
                except UnicodeDecodeError:
                    got = {"error": "not UTF-8"}
                rows.append({"path": path, "mtime": mtime, **got})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "mtime", "content").mapInArrow(each, NOTE)


def read_notes(spark: SparkSession, root: str, note_type: str | None = None) -> DataFrame:
    """All notes below the root; with ``note_type`` those in the folder of that name."""
    files = walk(spark, root)
    return parse(files.where(F.col("path").startswith(f"{note_type}/")) if note_type else files)


def adopt(notes_with_text: DataFrame) -> DataFrame:
    """Ids, types and titles for files without complete front matter. Columns path, text in; path, id, type, title, source out.

    The type is the first folder that names one, the title the first heading or the file's name, the id local-<name>, with
    a hash of the path where two files would share it.
    """
    folders = F.filter(F.split("path", "/"), lambda p: p.isin(*NOTE_TYPES))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    heading = F.nullif(F.trim(F.regexp_extract("text", r"(?m)^#\s+(.+)$", 1)), F.lit(""))
    base = F.concat(F.lit("local-"), slugify(stem, 60))
    rows = notes_with_text.select("path", F.coalesce(F.get(folders, F.lit(0)), F.lit("finding")).alias("type"), F.coalesce(heading, F.initcap(F.replace(stem, F.lit("-"), F.lit(" ")))).alias("title"), base.alias("base"))
    first = rows.groupBy("base").agg(F.min("path").alias("first"))
    own = F.when((F.col("path") == F.col("first")) & (F.col("base") != "local-"), F.col("base")).otherwise(F.concat(F.regexp_replace("base", "-$", ""), F.lit("-"), F.substring(F.sha1(F.col("path").cast("binary")), 1, 8)))
    return rows.join(first, "base").select("path", own.alias("id"), "type", "title", F.lit("manual").alias("source"))
