"""Operator 7, WARC archives: write pages as records, read archives back with segment reassembly.

Writing. The smallest rows (id, digest, length) decide which record of each payload is the response (the largest id) and
which revisit it. A record's block is an HTTP message in chunked transfer framing; a block over ``segment_bytes`` is split
into a first record and continuation records, so a record is never longer than that and its headers, and an archive has
``records_per_file`` times that at most (64 MB by default), however long the pages are. Spark's text writer puts the records into gzip files in any file system,
with the WARC record end as its line end.

Reading. Each file is parsed by record headers. Whole records are decoded where they are. Segments are grouped by origin
identifier (one page's segments, so a group is bounded by a page), ordered by segment number, verified against the stated
total length and then decoded; a record that fails any check raises an error rather than going missing. Revisits take
their payload's length from the response they refer to, whose digest must be theirs.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Sieve, Workspace, materialize, sifted, table, text_chunks

_END = b"\r\n\r\n"
_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = b"2024-01-01T00:00:00Z"
RECORD = "page_id string, record_type string, origin string, segment int, total long, refers_to string, payload_digest string, payload_bytes long, payload binary, block binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int) -> bytes:
    """The payload in chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions of chunk headers and trailers are passed over."""
    out, at = [], 0
    while True:
        stop = body.index(b"\r\n", at)
        size = int(body[at:stop].split(b";")[0], 16)
        at = stop + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The decoded payload of an HTTP response message."""
    head, _, body = block.partition(_END)
    lines = head.lower().split(b"\r\n")
    return unchunked(body) if any(x.startswith(b"transfer-encoding:") and b"chunked" in x for x in lines[1:]) else body


def _record(kind: bytes, record_id: bytes, block: bytes, more: list[tuple[bytes, bytes]]) -> bytes:
    head = [b"WARC/1.1", b"WARC-Type: " + kind, b"WARC-Record-ID: <" + record_id + b">", b"WARC-Date: " + _DATE]
    head += [k + b": " + v for k, v in more]
    return b"\r\n".join([*head, b"Content-Length: %d" % len(block)]) + _END + block


def records(page_id: object, url: bytes | None, payload: bytes | None, sha1: str, refers_to: object, serial: str, segment_bytes: int, chunk_bytes: int) -> list[bytes]:
    """The WARC records of one page: a revisit (which needs no payload, but its digest), or a response in one record or several
    segments."""
    name = f"urn:page:{page_id}".encode()
    own = f"{name.decode()}#{serial}".encode()
    target = b"".join(c if c > b" " else b"%%%02X" % c[0] for c in (bytes([b]) for b in url or b"")) or b"urn:none"
    info = [(b"WARC-Target-URI", target), (b"Content-Type", b"application/http;msgtype=response"), (b"WARC-Payload-Digest", b"sha1:" + base64.b32encode(bytes.fromhex(sha1)))]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked" + _END
    if refers_to is not None:
        return [_record(b"revisit", own, head, [*info, (b"WARC-Profile", _PROFILE), (b"WARC-Refers-To", f"<urn:page:{refers_to}>".encode())])]
    block = head + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        return [_record(b"response", own, block, info)]
    parts = [block[at : at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    out = [_record(b"response", own, parts[0], [*info, (b"WARC-Segment-Number", b"1")])]
    for i, part in enumerate(parts[1:], 2):
        more = [(b"WARC-Target-URI", target), (b"WARC-Segment-Number", b"%d" % i), (b"WARC-Segment-Origin-ID", b"<" + own + b">")]
        if i == len(parts):
            more.append((b"WARC-Segment-Total-Length", b"%d" % len(block)))
        out.append(_record(b"continuation", own + b".%d" % i, part, more))
    return out


def _to_records(segment_bytes: int, chunk_bytes: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for chunk in text_chunks(batches, "payload"):
            out = []
            for page_id, url, payload, sha1, refers_to in zip(*(chunk.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha1", "refers_to")), strict=True):
                n += 1
                out += records(page_id, url, payload, sha1, refers_to, f"{part}.{n}", segment_bytes, chunk_bytes)
            yield pa.record_batch([pa.array(out, pa.binary())], names=["record"])

    return each


def write_warc(pages: DataFrame, path: str, *, min_revisit_bytes: int = 0, segment_bytes: int = 32 << 10, chunk_bytes: int = 8 << 10, records_per_file: int = 2_000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write one page after another as WARC records into gzip files below ``path``.

    Of payloads that are equal and at least ``min_revisit_bytes`` long, the one with the largest id is the response; the
    others revisit it. Rows with a null id are responses, and so are all rows that share the largest id.
    """
    with Workspace(pages.sparkSession, "op7-write") as work:
        told = _told(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("binary").alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload")), int(min_revisit_bytes), work)
        lines = told.mapInArrow(_to_records(segment_bytes, chunk_bytes), "record binary").select(F.col("record").cast("string"))
        lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _told(base: DataFrame, least: int, work: Workspace) -> DataFrame:
    """page_id, url, payload, sha1 and refers_to of each record: responses with their payload, revisits without.

    No payload goes through an exchange but those of the few responses that a filter of the revisits lets pass. Payloads are
    equal if length, SHA-1 and SHA-256 are. Both sides of the join on payloads are tables, so that a payload that very many
    pages have is split.
    """
    known = base.select("*", F.sha2("payload", 256).alias("digest"), F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("size"))
    known = known.withColumn("mark", F.xxhash64("page_id", "digest", "sha1"))
    same, pair = ["digest", "sha1", "size"], ["page_id", "digest", "sha1"]
    marks = work.keep(known.drop("payload"), "marks")
    first = work.keep(marks.where(f"page_id IS NOT NULL AND size >= {least}").groupBy(*same).agg(F.max("page_id").alias("refers_to")), "first")
    revisits = work.keep(marks.where("page_id IS NOT NULL").join(first.hint("merge"), same).where("page_id <> refers_to").select(*pair, "url", "mark", "refers_to"), "revisits")
    sieve = Sieve(revisits.select("mark"))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~sieve.ok(batch, "mark")))

    responses = known.mapInArrow(others, known.schema)
    passed = work.keep(sifted(marks.select(*pair, "mark"), sieve, "mark").join(revisits.select(*pair).distinct().hint("merge"), pair, "left_anti"), "passed")
    if not passed.isEmpty():
        some = sifted(sifted(known, sieve, "mark"), Sieve(passed.select("mark")), "mark")
        exact = [F.col(f"k.{c}").eqNullSafe(F.col(f"p.{c}")) for c in pair]  # a null id may pass
        responses = responses.unionByName(some.alias("k").join(passed.select(*pair).distinct().alias("p"), exact, "left_semi"))
    no_id = F.lit(None).cast(base.schema["page_id"].dataType)
    return responses.select("page_id", "url", "payload", "sha1", no_id.alias("refers_to")).unionByName(revisits.select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "sha1", "refers_to"))


def _unzipped(data: bytes) -> bytes:
    """All gzip members of a file, or the file itself if it is not compressed."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        member = zlib.decompressobj(31)
        out += [member.decompress(data), member.flush()]
        data = member.unused_data.lstrip(b"\0")
    return b"".join(out)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names lower-cased) and block of each record of an archive."""
    data, at = _unzipped(data), 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        stop = data.index(_END, at)
        lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        block = data[stop + 4 : stop + 4 + size]
        if len(block) != size:
            raise ValueError("an archive ends inside a record")
        yield fields, block
        at = stop + 4 + size


def _page(record_id: str) -> str | None:
    name = record_id.strip("<>").split("#")[0].removeprefix("urn:page:")
    return None if name == "None" else name


def _checked(fields_digest: str | None, payload: bytes) -> str:
    digest = base32_sha1(payload)
    if fields_digest is not None and fields_digest != digest:
        raise ValueError("a payload does not have the digest its record states")
    return digest


_SCHEMA = pa.schema([("page_id", pa.string()), ("record_type", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("block", pa.binary())])


def _read(payloads: bool):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for fields, block in parse(content.as_py()):
                    kind, number = fields["warc-type"], int(fields.get("warc-segment-number", 0))
                    digest = fields.get("warc-payload-digest", "").partition(":")[2] or None
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    if number:
                        origin = fields["warc-record-id"] if number == 1 else fields["warc-segment-origin-id"]
                        total = fields.get("warc-segment-total-length")
                        rows.append((_page(origin), "response", origin, number, int(total) if total else None, None, digest, None, None, block))
                    elif kind == "revisit":
                        rows.append((_page(fields["warc-record-id"]), kind, None, None, None, _page(fields["warc-refers-to"]), digest, None, None, None))
                    else:
                        payload = payload_of(block)
                        rows.append((_page(fields["warc-record-id"]), kind, None, None, None, None, _checked(digest, payload), len(payload), payload if payloads else None, None))
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    return each


def _reassemble(payloads: bool):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for origin, parts in zip(batch.column("origin").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)):
                    raise ValueError(f"segments of {origin} are missing or twice there")
                block = b"".join(p["block"] for p in parts)
                if parts[-1]["total"] != len(block):
                    raise ValueError(f"segments of {origin} do not have their total length")
                payload = payload_of(block)
                rows.append((_page(origin), "response", None, None, None, None, _checked(parts[0]["payload_digest"], payload), len(payload), payload if payloads else None, None))
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    return each


def read_warc(spark: SparkSession, path: str, *, payloads: bool = True, work: Workspace | None = None) -> DataFrame:
    """The pages of all archives below ``path``: page_id (string), record_type, refers_to, payload_bytes, payload_digest (bare
    base32 SHA-1) and, if asked for, the payload (null for revisits). No archives, no rows. Tables that the result reads are
    in ``work``, else they stay in the shared folder."""
    keep = work.keep if work is not None else materialize
    files = spark.read.format("binaryFile").load(path).select("content")
    records = keep(files.mapInArrow(_read(payloads), RECORD), "op7-records")  # each archive is parsed once
    parts = records.where("origin IS NOT NULL").groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("segment", "total", "payload_digest", "block"))).alias("parts"))
    joined = parts.mapInArrow(_reassemble(payloads), RECORD)
    names = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", *["payload"] * payloads]
    found = records.where("origin IS NULL AND record_type = 'response'").unionByName(joined).select(*names)
    # only revisits, which have no payload, are joined; what they refer to is a table, so that a page many refer to is split
    responses = keep(found.where("page_id IS NOT NULL").groupBy(F.col("page_id").alias("to"), F.col("payload_digest").alias("of")).agg(F.max("payload_bytes").alias("full")), "op7-responses")
    revisits = records.where("record_type = 'revisit'").select(*names).join(responses.hint("merge"), F.expr("refers_to = to AND payload_digest = of"), "left")
    revisits = revisits.select(*[F.coalesce("payload_bytes", "full").alias("payload_bytes") if c == "payload_bytes" else c for c in names])
    return found.unionByName(revisits)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Workspace(spark, "op7") as work:  # archives and tables go when their rows are written
        path = f"{work.path}/archives"
        write_warc(table(spark, sf_dir, "pages"), path)
        back = read_warc(spark, path, payloads=False, work=work)
        return materialize(back.select(F.col("page_id").cast("long"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long")), "op7-pages")


QUERIES = {"op7_warc": op7_warc}
SQL: dict[str, str] = {}
