"""Landed pages of paginated services as a data source: ``spark.read.format("vellum_pages")``.

A service is asked window by window and page by page, and every answer lands as <path>/<window>/<page>.json (pages from 0). Each
window is one partition, read page by page, so windows are read side by side. A page that is not there, is no JSON, or a window
whose items are not as many as the service said is a row with ``fault`` and no item: nothing is passed over in silence, and what
did land is read all the same. ``after`` (<window>/<page>) resumes behind that page.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "window string, page int, position int, item string, fault string"


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Window(InputPartition):
    name: str
    pages: tuple[int, ...]
    first: int  # pages before it have been read


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.items, self.total = options["path"].rstrip("/"), options.get("items", "items"), options.get("total", "total")
        self.after = options.get("after", "")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, top = _files(self.path)
        pages: dict[str, list[int]] = {}
        for info in files.get_file_info(fs.FileSelector(top, recursive=True)):
            window, _, name = info.path.removeprefix(top).strip("/").rpartition("/")
            if info.type == fs.FileType.File and window and name.endswith(".json") and name[:-5].isdigit():
                pages.setdefault(window, []).append(int(name[:-5]))
        last, _, page = self.after.rpartition("/")
        out = [Window(w, tuple(sorted(p)), int(page) + 1 if w == last else 0) for w, p in sorted(pages.items()) if w >= last]
        return [w for w in out if w.pages[-1] >= w.first] or [Window("", (), 0)]

    def read(self, partition: Window) -> Iterator[tuple]:
        files, top = _files(self.path)
        w, there, count, said, whole = partition.name, set(partition.pages), 0, None, True
        for page in range(partition.pages[-1] + 1 if partition.pages else 0):
            fault = None if page in there else "missing page"
            if fault is None:
                try:
                    with files.open_input_stream(f"{top}/{w}/{page}.json") as f:
                        answer = json.loads(f.read())
                    items = answer[self.items]
                    said = answer.get(self.total, said)
                    count += len(items)
                    if page >= partition.first:
                        yield from ((w, page, i, json.dumps(item, ensure_ascii=False), None) for i, item in enumerate(items))
                except (ValueError, KeyError, TypeError) as e:
                    fault = f"unreadable page: {type(e).__name__}"
            if fault is not None:
                whole = False
                yield (w, page, None, None, fault)
        if whole and said is not None and count != said:
            yield (w, None, None, None, f"{count} items of {said}")


class Pages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vellum_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(dict(self.options))


def read_pages(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """window, page, position, item (JSON text) and fault. Options: ``items`` and ``total`` (fields of an answer), ``after``."""
    spark.dataSource.register(Pages)
    return spark.read.format("vellum_pages").options(**options).load(path)
