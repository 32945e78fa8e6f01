"""Operator 3, benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

A benchmark item matches a place of a document if at most k of the item's n words must be inserted, deleted or replaced;
k is the share of n that ``similarity`` leaves. Items are looked for by pieces of at most PIECE words, evenly cut: if the item
has at most its share of edits, so has one of its pieces.

LSH. A piece, and a window of a document of its size, go through the CGK random walk (one random bit for each step and word says
whether the walk goes on to the next word), which turns edit distance into Hamming distance. Each sample looks at a few steps
of a walk; what it sees of every piece is a key of the bucket table. What it sees of a window is looked up there, and only
pieces found so are candidates. They go on to the exact edit distance of the whole item against the words around.

Windows that cannot match are not embedded: k edits leave one of k + 1 stretches of a piece with (n - k) / (k + 1) words, so
up to three consecutive words of some piece stand in every match, and say where the window begins and its class of sizes (not
which piece it is).

One pass over the documents, no shuffle. The items are the stated query set: they are read in blocks of bounded size, one
pass for each block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WordHashes, flat_words, gram_hashes, id_and_text, materialize, mix, table, text_chunks

ANCHOR, PIECE, CELLS = 3, 256, 1 << 21
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_OTHER = bytes(b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123))
PLAIN = bytes.maketrans(_UPPER + _OTHER, _LOWER + b" " * len(_OTHER))
_IDEOGRAPH = re.compile(rb"[\xe3-\xe9][\x80-\xbf][\x80-\xbf]")  # U+3000 to U+9FFF: scripts without spaces


def plain_texts(texts: list[bytes | None]) -> list[bytes | None]:
    """Lower-cased words with spaces between; a character of a script without spaces is a word of its own."""
    joined = np.frombuffer(b"".join(t for t in texts if t), np.uint8)
    out = [t.translate(PLAIN) if t else t for t in texts]
    if ((joined >= 0xE3) & (joined <= 0xE9)).any():
        out = [_IDEOGRAPH.sub(rb" \g<0> ", t) if t else t for t in out]
    return out


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0] .. first[0] + count[0] - 1, first[1] .. and so on in a row."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


class Items:
    """A block of items: their words, the pieces they are cut into, where the pieces' anchors are, and the bucket table."""

    def __init__(self, rows: list[tuple[int, bytes]], similarity: float, walks: int, samples: int, places: int, least: int):
        self.flat, starts = flat_words(plain_texts([t for _, t in rows]), WordHashes())
        use = np.flatnonzero(np.diff(starts) > 0)
        self.ids, self.begin, self.sizes = [rows[i][0] for i in use.tolist()], starts[use], np.diff(starts)[use]
        self.edits = np.floor(self.sizes * (1 - similarity) + 1e-9).astype(np.int64)
        self.alone = self.sizes < least
        cuts = -(-self.sizes // PIECE)
        self.piece_item = np.repeat(np.arange(len(use)), cuts)
        nth, many, size = _ranges(np.zeros(len(use), np.int64), cuts), cuts[self.piece_item], self.sizes[self.piece_item]
        self.offset = nth * size // many
        self.piece_size = (nth + 1) * size // many - self.offset
        self.piece_begin = self.begin[self.piece_item] + self.offset
        k = np.floor(self.piece_size * (1 - similarity) + 1e-9).astype(np.int64)
        self.anchor = np.clip(-(-(self.piece_size - k) // (k + 1)), 1, ANCHOR)
        # size classes: a fourth apart; a sample looks at steps that the smallest of a class is likely to walk
        lows = [1]
        while lows[-1] <= PIECE:
            lows.append(max(lows[-1] + 1, lows[-1] * 5 // 4))
        self.lows = np.array(lows)
        self.size_class = np.searchsorted(self.lows, self.piece_size, "right") - 1
        self.walks = walks
        self.looks = np.random.default_rng(3).random((walks, samples, places))
        self._index_anchors()
        self._index_buckets()

    def _index_anchors(self) -> None:
        """For each anchor length the grams, and of each its (class, offset in the piece)."""
        self.grams = {}
        for n in np.unique(self.anchor).tolist():
            pieces = np.flatnonzero(self.anchor == n)
            count = self.piece_size[pieces] - n + 1
            at = _ranges(self.piece_begin[pieces], count)
            owner = np.repeat(pieces, count)
            told = np.unique(np.stack([gram_hashes(self.flat, n)[at].view(np.int64), self.size_class[owner], at - self.piece_begin[owner]]), axis=1)
            grams, first, many = np.unique(told[0], return_index=True, return_counts=True)
            sieve = np.zeros(1 << 20, bool)
            sieve[(grams.view(np.uint64) >> np.uint64(44)).astype(np.int64)] = True
            self.grams[n] = (sieve, grams, first, many, told[1], told[2])

    def _index_buckets(self) -> None:
        keys, pieces = [], []
        for c in np.unique(self.size_class).tolist():
            own = np.flatnonzero(self.size_class == c)
            for lo in range(0, len(own), 4096):
                part = own[lo : lo + 4096]
                for seen in self.seen(self.flat, self.piece_begin[part], self.piece_begin[part] + self.piece_size[part], c):
                    keys.append(seen)
                    pieces.append(part)
        keys, pieces = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (keys, pieces))
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_piece = keys[order], pieces[order].astype(np.int64)

    def seen(self, flat: np.ndarray, begin: np.ndarray, end: np.ndarray, c: int) -> Iterator[np.ndarray]:
        """What each sample sees of the windows flat[begin:end] under the looks of size class c."""
        steps = max(2, int(1.6 * self.lows[c]))
        padded = np.append(flat, np.uint64(0))
        for walk in range(self.walks):
            at, path = begin.astype(np.int64), np.empty((steps, len(begin)), np.uint64)
            for step in range(steps):
                path[step] = word = np.where(at < end, padded[np.minimum(at, len(flat))], np.uint64(0))
                at = at + (mix(word ^ np.uint64(((walk * 4096 + step + 1) * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))) & np.uint64(1)).astype(np.int64)
            for number, look in enumerate(self.looks[walk]):
                key = np.full(len(begin), (c << 32) + (walk << 16) + number + 1, np.uint64)
                for step in np.sort((look * steps).astype(np.int64)).tolist():
                    key = mix(key ^ path[step])
                yield key

    def candidates(self, flat: np.ndarray, begin: np.ndarray, end: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
        """(window number, piece) of all pieces in a bucket that a window falls into."""
        found = []
        for key in self.seen(flat, begin, end, c):
            lo, hi = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
            hit = np.flatnonzero(hi > lo)
            if len(hit):
                many = hi[hit] - lo[hit]
                found.append((np.repeat(hit, many) * len(self.piece_item)) + self.key_piece[_ranges(lo[hit], many)])
        both = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        return both // max(1, len(self.piece_item)), both % max(1, len(self.piece_item))

    def distances(self, regions: np.ndarray, lengths: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest edit distance of each item to any part of its region, and where that part ends."""
        width = regions.shape[1]
        columns = np.arange(width + 1)
        last = np.zeros((len(regions), width + 1), np.int32)
        best = last.copy()
        for i in range(int(self.sizes[item].max())):
            cost = regions != self.flat[np.minimum(self.begin[item] + i, len(self.flat) - 1)][:, None]
            now = np.empty_like(last)
            now[:, 0] = i + 1
            now[:, 1:] = np.minimum(last[:, 1:] + 1, last[:, :-1] + cost)
            now = np.minimum.accumulate(now - columns, axis=1) + columns
            last = now.astype(np.int32)
            done = self.sizes[item] == i + 1
            best[done] = last[done]
        best = np.where(columns[None, :] <= lengths[:, None], best, 1 << 30)
        end = best.argmin(axis=1)
        return best[np.arange(len(best)), end], end


def _around(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[begin : begin + size] of each row, side by side."""
    at = begin[:, None] + np.arange(int(size.max()))
    return np.where(np.arange(int(size.max())) < size[:, None], flat[np.minimum(at, len(flat) - 1)], 0)


def windows(items: Items, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows (size class, document, first word) of the windows that hold an anchor where a piece of the class has it."""
    found = []
    for n, (sieve, grams, first, many, classes, offsets) in items.grams.items():
        own = gram_hashes(flat, n)
        at = np.flatnonzero(sieve[(own >> np.uint64(44)).astype(np.int64)])
        if not len(at):
            continue
        doc = np.searchsorted(starts, at, "right") - 1
        at, doc = at[fits := at + n <= starts[doc + 1]], doc[fits]
        here = own[at].view(np.int64)
        place = np.minimum(np.searchsorted(grams, here), len(grams) - 1)
        known = grams[place] == here
        at, doc, place = at[known], doc[known], place[known]
        posting, doc = _ranges(first[place], many[place]), np.repeat(doc, many[place])
        found.append(np.stack([classes[posting], doc, np.maximum(np.repeat(at, many[place]) - offsets[posting], starts[doc])]))
    return np.unique(np.concatenate(found, axis=1), axis=1) if found else np.empty((3, 0), np.int64)


def find(items: Items, flat: np.ndarray, starts: np.ndarray, block: int = 4096) -> list[tuple[int, int, int, int, int]]:
    """(document, item, first word, end, distance) of the best place of each item in each document."""
    looked, kept = windows(items, flat, starts), []
    for c in np.unique(looked[0]).tolist():
        doc, begin = looked[1:, looked[0] == c]
        for lo in range(0, len(doc), block):
            d, b = doc[lo : lo + block], begin[lo : lo + block]
            number, piece = items.candidates(flat, b, np.minimum(starts[d + 1], b + items.lows[c + 1]), c)
            item = items.piece_item[piece]
            kept.append(np.stack([d[number], item, b[number] - items.offset[piece]]))
    if not kept:
        return []
    doc, item, begin = np.unique(np.concatenate(kept, axis=1), axis=1)
    fits = ~items.alone[item] | (np.diff(starts)[doc] == items.sizes[item])  # an item of a few words must be the whole text
    doc, item, begin = doc[fits], item[fits], begin[fits]
    order = np.argsort(items.sizes[item], kind="stable")
    doc, item, begin = doc[order], item[order], begin[order]
    wide = items.sizes[item] + 2 * items.edits[item] + 1
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    lo = 0
    while lo < len(doc):
        hi = lo + max(1, int(np.searchsorted(wide[lo:] * np.arange(1, len(doc) - lo + 1), CELLS)))
        d, i, b = doc[lo:hi], item[lo:hi], begin[lo:hi]
        slack = items.edits[i]
        first = np.maximum(b - slack, starts[d])
        length = np.minimum(b + items.sizes[i] + slack, starts[d + 1]) - first
        distance, end = items.distances(_around(flat, first, length), length, i)
        for x, y, s, e, far, most in zip(d.tolist(), i.tolist(), (np.maximum(b, starts[d]) - starts[d]).tolist(), (first + end - starts[d]).tolist(), distance.tolist(), slack.tolist(), strict=True):
            if far <= most:
                best[x, y] = min(best.get((x, y), (far, s, e)), (far, s, e))
        lo = hi
    return [(x, y, s, e, far) for (x, y), (far, s, e) in sorted(best.items())]


def _search(items: Items):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for chunk in text_chunks(batches):
            flat, starts = flat_words(plain_texts(chunk.column("text").to_pylist()), hashes)
            found = find(items, flat, starts)
            if not found:
                continue
            d, i, s, e, far = (np.array(x, np.int64) for x in zip(*found, strict=True))
            yield pa.record_batch(
                [
                    chunk.column("doc_id").take(pa.array(d)),
                    pa.array([items.ids[x] for x in i.tolist()], pa.int64()),
                    pa.array(s),
                    pa.array(e),
                    pa.array(far),
                    pa.array(1 - far / items.sizes[i]),
                ],
                names=["doc_id", "item_id", "first_word", "end_word", "distance", "similarity"],
            )

    return each


def benchmark_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    similarity: float = 0.8,
    walks: int = 6,
    samples: int = 8,
    places: int = 2,
    least: int = 3,
    block_bytes: int = 4 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
) -> DataFrame:
    """Items that stand in documents with at most (1 - similarity) of their words edited: one row per document and item.

    Words are runs of digits, letters A-Z (lower-cased) and characters beyond ASCII; a character of a script without spaces
    (U+3000 to U+9FFF) is a word. Returns doc_id, item_id, first_word and end_word (of the best place), distance and
    similarity. Items of under ``least`` words match texts that have these words and no others; items and texts without words,
    or null, match nothing. Texts and items may be of any length. Rows with a null or repeated id are searched like any other; rows equal in all columns give equal matches.
    Repeated items give a match each. Empty tables give no rows. Other columns are ignored.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("binary").alias("text")).where("text IS NOT NULL AND item_id IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_bytes))
    kind = docs.schema[id_col].dataType.simpleString()
    base = id_and_text(docs, id_col, text_col)
    schema = f"doc_id {kind}, item_id long, first_word long, end_word long, distance long, similarity double"

    def searched(b: int) -> DataFrame:
        mine = items if blocks == 1 else items.where(F.expr(f"pmod(xxhash64(item_id, text), {blocks}) = {b}"))
        rows = sorted((r["item_id"], bytes(r["text"])) for r in mine.collect())
        return base.mapInArrow(_search(Items(rows, similarity, walks, samples, places, least)), schema)

    if blocks == 1:
        return searched(0)
    # one block after another: a block's index is gone, here and in the tasks, before the next is made
    return reduce(DataFrame.unionByName, [materialize(searched(b), f"op3-block{b}") for b in range(blocks)])


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_benchmark_decontamination": op3_benchmark_decontamination}
SQL: dict[str, str] = {}
