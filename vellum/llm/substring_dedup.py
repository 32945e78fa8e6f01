"""Operator 1, substring dedup: passages that already stand in an earlier document are cut out.

1. Seeds. Every 50-word window is known by the smallest hash among its 35 16-word grams (winnowing), so equal windows
   share their seed wherever they stand. Consecutive windows with one seed form a *run*; a document has about one run for
   every 18 words, and only runs are shuffled.
2. Confirm. A passage is kept once, where its owner, the smallest document that has it, has it first. Runs of equal content
   that stand in several documents are passages as they are. Where a seed has several contents, the windows of the owner of
   each are hashed (twice 64 bits) and summed: a window that stands in two documents is a passage of the smallest. The same
   hashes say which owners' passages a document must be looked through for, not where in it they stand.
3. Compile. The passages are dealt by owner into shards of about SHARD_BYTES. A passage is compiled as its consecutive blocks of
   half a window: a window inside a passage always holds a whole block, and blocks do not overlap, so an Aho-Corasick automaton
   is as large as its passages.
4. Stream. Every document that has a recurring seed is streamed through the automata of its owners' shards. The windows around
   each block found are looked up among the shard's (by hash, then word by word); each content is there once, so a block that very
   many passages hold costs no more than a rare one.

Owners are sums (the least place of a content, of a window), made before the shuffle where rows allow it and written before
they are joined, so that hot keys can be split. A shard that many documents name is copied for each STREAM of them. Nothing
is gathered by key but the spans of one document; memory follows the shard size and the longest text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import BASE_A, BASE_B, Sieve, WordHashes, Workspace, flat_words, free_name, gram_hashes, materialize, mix, prefix_sums, sifted, sliding_min, span_hashes, table, text_chunks

SHARD_BYTES, STREAM = 1 << 20, 4096  # of passages in an automaton; documents that go through one copy of it
_RUN = "seed long, content long, doc_id long, version int, first int, last int"
_WINDOW = "h1 long, h2 long, doc_id long, version int, first int"


def _valid_starts(starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in the row of all words) where a window of ``width`` words fits its document, and that document's number."""
    room = np.maximum(np.diff(starts) - width + 1, 0)
    doc = np.repeat(np.arange(len(room)), room)
    return np.arange(len(doc)) - np.repeat(np.cumsum(room) - room, room) + starts[:-1][doc], doc


def _runs(width: int, gram: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for chunk in text_chunks(batches):
            flat, starts = flat_words(chunk.column("text").to_pylist(), hashes)
            at, doc = _valid_starts(starts, width)
            if not len(at):
                continue
            seed = sliding_min(gram_hashes(flat, gram), width - gram + 1)[at]
            new = np.ones(len(at), bool)
            new[1:] = (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            content = span_hashes(prefix_sums(flat, BASE_B), BASE_B, at[first], at[last] + width)
            d = doc[first]
            yield pa.record_batch(
                [
                    pa.array(seed[first].view(np.int64)),
                    pa.array(content.view(np.int64)),
                    chunk.column("doc_id").take(pa.array(d)),
                    chunk.column("version").take(pa.array(d)),
                    pa.array((at[first] - starts[d]).astype(np.int32)),
                    pa.array((at[last] - starts[d]).astype(np.int32)),
                ],
                names=["seed", "content", "doc_id", "version", "first", "last"],
            )

    return each


def _window_hashes(width: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for chunk in text_chunks(batches, max_bytes=1 << 20):
            flat, starts = flat_words(chunk.column("text").to_pylist(), hashes)
            spans = chunk.column("spans")
            inner = spans.flatten()
            count = np.diff(spans.offsets.to_numpy())
            d = np.repeat(np.arange(chunk.num_rows), count)
            first = inner.field("first").to_numpy().astype(np.int64)
            size = inner.field("last").to_numpy().astype(np.int64) - first + 1
            owner = np.repeat(d, size)
            rel = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
            at = rel + starts[owner]
            both = [span_hashes(prefix_sums(flat, b), b, at, at + width).view(np.int64) for b in (BASE_A, BASE_B)]
            yield pa.record_batch(
                [pa.array(both[0]), pa.array(both[1]), chunk.column("doc_id").take(pa.array(owner)), chunk.column("version").take(pa.array(owner)), pa.array(rel.astype(np.int32))],
                names=["h1", "h2", "doc_id", "version", "first"],
            )

    return each


def joined_spans(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans [first, end) joined where they overlap or touch."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _window_keys(codes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive codes, from hashes of halves. Equal windows have equal keys; the reverse is looked up."""
    by, size = np.uint64(BASE_B), 1
    keys = mix(codes.astype(np.uint64) + np.uint64(BASE_A))
    while size * 2 <= width:
        keys, size = mix(keys[:-size] * by + keys[size:]), size * 2
    return mix(keys[: len(keys) - (width - size)] * by + keys[width - size :]) if size < width else keys


def _equal(x: np.ndarray, at: np.ndarray, y: np.ndarray, there: np.ndarray, width: int) -> np.ndarray:
    """Whether the windows of x at ``at`` are those of y at ``there``, code by code."""
    xs, ys = (np.lib.stride_tricks.sliding_window_view(z, width) for z in (x, y))
    return np.concatenate([np.empty(0, bool), *((xs[at[i : i + 65536]] == ys[there[i : i + 65536]]).all(axis=1) for i in range(0, len(at), 65536))])


class Shard:
    """The automaton of some passages: (owner, words) each; and their windows, each content once, with its smallest owner."""

    LETTERS = 1_100_000  # code points there are; words beyond share letters, which the windows tell apart

    def __init__(self, passages: list[tuple[int, list[bytes]]], width: int):
        self.width, self.block = width, width // 2
        self.letters: dict[bytes, str] = {}
        self.numbers: dict[bytes, int] | None = None  # only where words share letters
        for _, words in passages:
            for w in words:
                if w not in self.letters:
                    self.letters[w] = self.letter(len(self.letters))
        if len(self.letters) > self.LETTERS:
            self.numbers = {w: i for i, w in enumerate(self.letters)}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        flat = []
        for _, words in passages:
            row, own = self.codes(words)
            for start in range(0, len(words) - self.block + 1, self.block):
                self.automaton.add_word(row[start : start + self.block])
            flat.append(own)
        if len(self.automaton):
            self.automaton.make_automaton()
        self.flat = np.concatenate(flat) if flat else np.empty(0, np.int64)
        at, number = _valid_starts(np.cumsum([0, *map(len, flat)]), width)
        self.keys, self.at, self.owners = np.empty(0, np.uint64), at, np.array([owner for owner, _ in passages], np.int64)[number]
        if len(at):
            keys = _window_keys(self.flat, width)[at]
            order = np.lexsort((self.owners, keys))
            keys, at, owners = keys[order], at[order], self.owners[order]
            alike = np.flatnonzero(keys[1:] == keys[:-1]) + 1
            once = np.ones(len(at), bool)
            once[alike] = ~_equal(self.flat, at[alike], self.flat, at[alike - 1], width)
            self.keys, self.at, self.owners = keys[once], at[once], owners[once]

    @classmethod
    def letter(cls, number: int) -> str:
        code = number % cls.LETTERS + 2
        return chr(code if code < 0xD800 else code + 0x800)

    def codes(self, words: list[bytes]) -> tuple[str, np.ndarray]:
        """The words as letters, and as numbers that are equal only for equal words; a word of no passage is letter 1."""
        get = self.letters.get
        row = "".join([get(w, "\x01") for w in words])
        if self.numbers is not None:
            return row, np.array([self.numbers.get(w, -1) for w in words], np.int64)
        return row, np.frombuffer(row.encode("utf-32-le"), np.uint32)

    def locate(self, doc_id: int, words: list[bytes]) -> list[tuple[int, int]]:
        """Spans of the words in which a passage of a smaller document stands, of ``width`` words at least. A window is looked
        up once, however many passages hold the block that was found in it."""
        last = len(words) - self.width
        if not len(self.keys) or last < 0:
            return []
        row, own = self.codes(words)
        ends = np.fromiter((end for end, _ in self.automaton.iter(row)), np.int64) + 1
        if not len(ends):
            return []
        opens = np.zeros(last + 2, np.int64)  # windows that hold a whole block
        first, stop = np.maximum(ends - self.width, 0), np.minimum(ends - self.block, last) + 1
        np.add.at(opens, first[first < stop], 1)
        np.add.at(opens, stop[first < stop], -1)
        at = np.flatnonzero(np.cumsum(opens))
        keys = _window_keys(own, self.width)[at]
        place, found, live = np.searchsorted(self.keys, keys), np.zeros(len(at), bool), np.arange(len(at))
        while len(live):
            live = live[place[live] < len(self.keys)]
            live = live[self.keys[place[live]] == keys[live]]
            same = _equal(own, at[live], self.flat, self.at[place[live]], self.width)
            found[live[same]] = self.owners[place[live[same]]] < doc_id
            live = live[~same]  # one key of several contents
            place[live] += 1
        at = at[found]
        if not len(at):
            return []
        cut = np.flatnonzero(np.diff(at) > self.width)
        return list(zip(at[[0, *(cut + 1)]].tolist(), (at[[*cut, len(at) - 1]] + self.width).tolist(), strict=True))


def _extract(width: int):
    """Of owners' texts and the window starts of their passages: the passages' words, joined by a space."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            rows = []
            for doc_id, version, text, spans in zip(*(chunk.column(c).to_pylist() for c in ("doc_id", "version", "text", "spans")), strict=True):
                words = text.split()
                rows += [(doc_id, version, b" ".join(words[a:b])) for a, b in joined_spans((s["first"], s["last"] + width) for s in spans)]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["doc_id", "version", "text"])

    return each


def _stream(width: int):
    """Rows in order of shard, copy and kind: the passages of a shard (kind 0), then the documents that go through it (kind 1)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, passages, shard = None, [], None
        for chunk in text_chunks(batches):
            rows = []
            for now, copy, kind, doc_id, version, text in zip(*(chunk.column(c).to_pylist() for c in ("shard", "copy", "kind", "doc_id", "version", "text")), strict=True):
                if key != (now, copy):
                    key, passages, shard = (now, copy), [], None
                if kind == 0:
                    passages.append((doc_id, text.split()))
                    continue
                if shard is None:
                    shard, passages = Shard(passages, width), []
                rows += [(doc_id, version, a, b) for a, b in shard.locate(doc_id, text.split())]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "version", "first", "end"])

    return each


def _kept(text: bytes, words: list[bytes], gone: np.ndarray, layout: str) -> bytes:
    if layout == "words":
        return b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
    out, pos, start = [], 0, 0
    flips = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).reshape(-1, 2).tolist()
    i = 0
    for a, b in flips:  # walk the words to find the bytes of each span
        while i < a:
            pos = text.index(words[i], pos) + len(words[i])
            i += 1
        out.append(text[start:pos])
        while i < b:
            pos = text.index(words[i], pos) + len(words[i])
            i += 1
        start = pos
    out.append(text[start:])
    return b"".join(out)


def _cut(layout: str, carried: int, without: Sieve | None = None):
    """Texts without their spans; with ``without``, only of rows that do not pass it, which have none."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches if without is None else map(without.others, batches)):
            sizes, gone, out, kept = [], [], [], []
            spanned = chunk.column("spans").to_pylist() if without is None else [None] * chunk.num_rows
            for text, spans in zip(chunk.column("text").to_pylist(), spanned, strict=True):
                words = (text or b"").split()
                cut = joined_spans((s["first"], s["end"]) for s in spans or [])
                mark = np.zeros(len(words), bool)
                for a, b in cut:
                    mark[a:b] = True
                sizes.append(len(words))
                gone.append(int(mark.sum()))
                out.append([{"first": a, "end": b} for a, b in cut])
                kept.append(_kept(text or b"", words, mark, layout) if layout == "words" or cut else text)
            yield pa.record_batch(
                [
                    chunk.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(gone, pa.int64()),
                    pa.array(out, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))),
                    pa.array(kept, pa.binary()),
                    *[chunk.column(f"_carried{k}") for k in range(carried)],
                ],
                names=["doc_id", "n_words", "n_removed", "spans", "kept_text", *(f"_carried{k}" for k in range(carried))],
            )

    return each


def _confirmed(known: DataFrame, width: int, gram: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """The passages (owner's id and version, window starts first to last), and which documents are looked through for which
    owners' passages (doc_id, version, owner, owner_version)."""
    here = F.struct("doc_id", "version", "first", "last")
    runs = work.keep(known.mapInArrow(_runs(width, gram), _RUN), "runs")
    contents = runs.groupBy("seed", "content").agg(F.min(here).alias("own"), F.max("doc_id").alias("top"))
    contents = work.keep(contents, "contents")
    seeds = contents.groupBy("seed").agg(F.min("own.doc_id").alias("lo"), F.max("top").alias("hi"), F.count("*").alias("contents")).where("lo < hi").select("seed", "contents")
    recurring = work.keep(contents.join(seeds.hint("merge"), "seed").where("contents > 1 OR own.doc_id < top").select("seed", "content", "own", "top", "contents"), "recurring")
    work.drop(contents)
    found = runs.join(recurring.select("seed", "content", F.col("own.doc_id").alias("owner"), F.col("own.version").alias("owner_version"), (F.col("contents") > 1).alias("several")).hint("merge"), ["seed", "content"])
    found = work.keep(found.where("owner < doc_id OR several").select("doc_id", "version", "first", "last", "owner", "owner_version"), "found")
    work.drop(runs)
    partial = found.where("owner = doc_id").groupBy("doc_id", "version").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    partial = work.keep(partial, "partial")
    texts = sifted(known, Sieve(partial.select("doc_id"))).join(partial.hint("merge"), ["doc_id", "version"])
    windows = work.keep(texts.mapInArrow(_window_hashes(width), _WINDOW), "windows")
    owners = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "version", "first")).alias("own"), F.max("doc_id").alias("top")).where("own.doc_id < top")
    owners = work.keep(owners.select("h1", "h2", "own"), "owners")
    named = windows.join(owners.hint("merge"), ["h1", "h2"]).where("own.doc_id < doc_id").select("doc_id", "version", F.col("own.doc_id").alias("owner"), F.col("own.version").alias("owner_version"))
    routes = found.where("owner < doc_id").select("doc_id", "version", "owner", "owner_version").unionByName(named).distinct()
    routes = work.keep(routes, "routes")
    passages = recurring.where("own.doc_id < top").select("own.doc_id", "own.version", "own.first", "own.last").unionByName(owners.select("own.doc_id", "own.version", "own.first", F.col("own.first").alias("last")))
    return passages, routes


def _located(known: DataFrame, passages: DataFrame, routes: DataFrame, width: int, work: Workspace) -> DataFrame:
    """The spans of each document (doc_id, version, spans of first and end) in which passages of smaller documents stand."""
    spans = work.keep(passages.groupBy("doc_id", "version").agg(F.collect_set(F.struct("first", "last")).alias("spans")), "spans")
    owned = sifted(known, Sieve(spans.select("doc_id"))).dropDuplicates(["doc_id", "version"]).join(spans.hint("merge"), ["doc_id", "version"])
    owned = work.keep(owned.select("doc_id", "version", "text", "spans").mapInArrow(_extract(width), "doc_id long, version int, text binary"), "passages")
    shards = max(1, -(-int(owned.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]) // SHARD_BYTES))
    shard = lambda owner, version: F.pmod(F.xxhash64(owner, version), F.lit(shards))
    asked = work.keep(routes.select("doc_id", "version", shard("owner", "owner_version").alias("shard")).distinct(), "asked")
    copies = work.keep(asked.groupBy("shard").agg(F.expr(f"cast(ceil(count(*) / {STREAM}) as int)").alias("copies")), "copies")
    laid = owned.withColumn("shard", shard("doc_id", "version")).join(copies.hint("merge"), "shard").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    texts = sifted(known, Sieve(asked.select("doc_id"))).dropDuplicates(["doc_id", "version"]).join(asked.hint("merge"), ["doc_id", "version"])
    texts = texts.join(copies.hint("merge"), "shard").withColumn("copy", F.pmod(F.xxhash64("doc_id", "version"), F.col("copies")).cast("int"))
    columns = ["shard", "copy", "kind", "doc_id", "version", "text"]
    rows = laid.withColumn("kind", F.lit(0)).select(columns).unionByName(texts.withColumn("kind", F.lit(1)).select(columns))
    rows = rows.repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind")
    return rows.mapInArrow(_stream(width), "doc_id long, version int, first int, end int").groupBy("doc_id", "version").agg(F.collect_set(F.struct("first", "end")).alias("spans"))


def substring_dedup(docs: DataFrame, *, width: int = 50, gram: int = 16, layout: str = "original", id_col: str = "doc_id", text_col: str = "text", carry: Iterable[str] = ()) -> DataFrame:
    """Cut every word that a ``width``-word window covers whose words also stand, in a row, in a document with a smaller id.

    Returns one row per row of ``docs``: doc_id, n_words, n_removed, spans (words cut, as [first, end)), kept_text and the
    carried columns. layout "original" cuts from the text as it is; "words" joins the kept words by one space.

    Windows are judged on the input. A null text has no words (kept_text null, or empty with layout "words"); a row with a
    null id stays as it is and owns nothing; rows with one id and one text are alike; rows with one id and several texts
    are judged each on its own. Other columns of ``docs`` are ignored unless carried; a carried column whose name is one of
    the operator's own comes back as ``name_in``. An empty table gives no rows.
    """
    carry = list(carry)
    own = {"doc_id": F.col(id_col).cast("long"), "text": F.col(text_col).cast("binary")}
    base = docs.select(*(c.alias(n) for n, c in own.items()), *(F.col(c).alias(f"_carried{k}") for k, c in enumerate(carry))).withColumn("version", F.hash("text"))
    known = base.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "version", "text")
    with Workspace(docs.sparkSession, "op1") as work:
        per_doc = materialize(_located(known, *_confirmed(known, width, gram, work), width, work), "op1-spans")
    sieve = Sieve(per_doc.select("doc_id"))  # texts without a span stay where they are
    schema = "doc_id long, n_words long, n_removed long, spans array<struct<first:int,end:int>>, kept_text binary" + "".join(f", _carried{k} {docs.select(c).schema[0].dataType.simpleString()}" for k, c in enumerate(carry))
    some = sifted(base, sieve).join(per_doc.hint("merge"), ["doc_id", "version"], "left").drop("version").mapInArrow(_cut(layout, len(carry)), schema)
    cut = some.unionByName(base.drop("version").mapInArrow(_cut(layout, len(carry), sieve), schema))
    taken = ["doc_id", "n_words", "n_removed", "spans", "kept_text"]
    return cut.select(*taken[:4], F.col("kept_text").cast("string").alias("kept_text"), *(F.col(f"_carried{k}").alias(free_name(c, taken)) for k, c in enumerate(carry)))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup(table(spark, sf_dir, "documents"), layout="words")
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op1_substring_dedup": op1_substring_dedup}
SQL: dict[str, str] = {}
