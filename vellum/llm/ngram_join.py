"""Operator 2, n-gram Jaccard join with set-relation skipping.

Index. A document's shingles are ordered by hash and cut into m parts of the hash range. Two sets of similarity t differ in
at most k = a (1 - t) / t members (a: size of the smaller), so of m = k + 1 + spare parts at least spare + 1 are equal, and at least
three of these are not empty. The
index has a list for each (size class, part position, content of the part): a set meets only lists of equal content at its
own positions, and every other block of the position is skipped unread. Single frequent shingles make no list.

Skipping by relation. A set that shares fewer lists than similar sets must (SHARED) is left out. In each list all members are
compared with its centre, the member that meets most others over all its lists (of near copies: the text they come from); one
comparison per member, never all pairs. From the centre's answers the others follow: members that link to the centre share
its component already. What is not connected yet is looked for by sketches only: every distance is at least the number of
bits in which two parity sketches differ (one bit for each of 1,024 hash classes: whether its count is odd). A set looks in
its lists from the shortest on and leaves out its SHARED - 1 longest, since the shortest list that similar sets share has that
many longer ones after it; so what many texts have in common makes no work by itself. Sketches of a list meet in tiles of at
most TILE by TILE inside a task, and only pairs that pass leave it. All comparisons are of whole sets.

Sets of equal content are one class before anything is compared, so copies cost one row each. Shingles are 64-bit hashes;
two sets are held equal if 63 mixed bits of their size and two 64-bit sums agree. Classes, not ids, are what is linked: a
document with several texts is in several classes, which it connects.

Links. When the components are known, every set of a component is compared once with the component's root (the set that meets
most others), which gives its difference from the root. Two sets x and z differ by d(x) + d(z) - 2 |common part of their
differences|, so all other answers inside the component, exact ones, follow from these short differences, in tiles of at most
about TILE x TILE sets. They are returned as the number of links of each row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import BASE_A, Sieve, WordHashes, Workspace, connected_components, flat_words, gram_hashes, id_and_text, materialize, mix, prefix_sums, sifted, span_hashes, table, text_chunks

SHARED = 3  # lists that two similar sets share at least
SHRINK = 0.7
SKETCH = 16  # 64-bit words
TILE = 2048
SLICES = 4  # of the index: so much of it is shuffled at once


def shingle_sets(texts: list[bytes | None], k: int, hashes: WordHashes) -> list[np.ndarray]:
    """Sorted distinct k-word shingles of each text; a text with fewer words has one shingle, one without words none."""
    flat, starts = flat_words([t.lower() if t else t for t in texts], hashes)
    grams, sums, out = gram_hashes(flat, k), prefix_sums(flat, BASE_A), []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(span_hashes(sums, BASE_A, np.array([a]), np.array([b])))
        else:
            out.append(np.empty(0, np.uint64))
    return out


class Scheme:
    """Size classes, and for each the number of parts that the pigeonhole bound asks for."""

    def __init__(self, percent: int):
        self.percent = percent
        gap = 100 - percent
        shrink = min(SHRINK, percent / 100)  # a set's smallest partner is in the class below at most
        self.bounds = [-(-percent // gap)]  # no smaller set has a partner that differs
        while self.bounds[-1] < 1 << 40:
            self.bounds.append(int(self.bounds[-1] / shrink) + 1)
        self.parts, self.empty = [], []
        for lo, hi in zip(self.bounds, self.bounds[1:]):
            differ, spare = (hi - 1) * gap // percent, SHARED + 1
            for _ in range(50):  # room for the empty parts that sets of this size have by chance
                chance = (differ + 1 + spare) * math.exp(-lo / (differ + 1 + spare))
                spare = max(spare, min(differ + SHARED + 1, math.ceil(SHARED + chance + 3 * chance**0.5)))
            self.parts.append(differ + 1 + spare)
            self.empty.append(spare + 1 - SHARED)
        self._edges: dict[int, np.ndarray] = {}

    def classes(self, n: int) -> list[int]:
        if n < self.bounds[0]:
            return []
        c = int(np.searchsorted(self.bounds, n, "right")) - 1
        return [c, c - 1] if c and -(-n * self.percent // 100) < self.bounds[c] else [c]

    def signatures(self, members: np.ndarray, sums: np.ndarray) -> list[np.ndarray]:
        """One hash per part. Empty parts have none, unless there are so many that equal parts could be these alone.
        sums: running sums of the mixed members."""
        out = []
        for c in self.classes(len(members)):
            m = self.parts[c]
            if m not in self._edges:
                if len(self._edges) > 200:
                    self._edges.clear()
                self._edges[m] = np.array([-((-i << 64) // m) for i in range(1, m)], np.uint64)
            cuts = np.concatenate([[0], np.searchsorted(members, self._edges[m]), [len(members)]])
            part = mix((sums[cuts[1:]] - sums[cuts[:-1]]) ^ (np.arange(m, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(c * 0x51ED270B)))
            full = cuts[1:] > cuts[:-1]
            out.append(part[full] if m - full.sum() <= self.empty[c] else part)
        return out


def set_class(members: np.ndarray) -> int:
    """The number of the class of sets with these members."""
    fp1 = mix(members).sum(dtype=np.uint64)
    fp2 = mix(members ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
    both = mix(np.array([fp2 ^ np.uint64(len(members))], np.uint64)) + fp1
    return int(mix(both)[0] >> np.uint64(1))


def _index(k: int, percent: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, scheme = WordHashes(), Scheme(percent)
        for chunk in text_chunks(batches):
            n, cid, sketch, sigs, sizes = [], [], [], [], []
            for members in shingle_sets(chunk.column("text").to_pylist(), k, hashes):
                mixed = mix(members)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed)])
                n.append(len(members))
                cid.append(set_class(members))
                odd = np.bincount((mixed >> np.uint64(20)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
                sketch.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                got = scheme.signatures(members, sums)
                sigs += got
                sizes.append(sum(map(len, got)))
            flat = np.concatenate(sigs) if sigs else np.empty(0, np.uint64)
            of, piece = np.repeat(np.arange(len(sizes)), sizes), flat % np.uint64(SLICES)
            pieces = []
            for i in range(SLICES):
                mine = piece == i
                offsets = np.concatenate([[0], np.cumsum(np.bincount(of[mine], minlength=len(sizes)))]).astype(np.int32)
                pieces.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[mine].view(np.int64))))
            yield pa.record_batch(
                [chunk.column("doc_id"), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), pa.array(sketch, pa.list_(pa.int64())), *pieces],
                names=["doc_id", "n", "cid", "sketch", *(f"sigs{i}" for i in range(SLICES))],
            )

    return each


def _listed(sieve: Sieve):
    """key, cid, n and signatures of texts -> a row for each signature. The sieve lets one text of each class pass, and others by
    chance: the same row may come twice."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(sieve.ok(batch, "key")))
            at = np.repeat(np.arange(some.num_rows), pc.list_value_length(some.column("sigs")).to_numpy(zero_copy_only=False))
            yield pa.record_batch([some.column("cid").take(pa.array(at)), some.column("n").take(pa.array(at)), some.column("sigs").flatten()], names=["a", "na", "sig"])

    return each


def _shared(index: DataFrame, classes: DataFrame, work: Workspace) -> DataFrame:
    """Members (a, na) of the lists (sig) that two classes or more are in. Signatures are most of what an index has, and most are of
    one class only: they are shuffled slice by slice, so what lies on disk at once is a share of them."""
    key, parts = F.xxhash64("rep", "cid").alias("key"), []
    sieve = Sieve(work.keep(classes.select(key), "keys"))
    rows = index.where("doc_id IS NOT NULL AND n > 0").withColumnRenamed("doc_id", "rep")
    for i in range(SLICES):
        some = rows.select(key, "cid", "n", F.col(f"sigs{i}").alias("sigs")).mapInArrow(_listed(sieve), "a long, na long, sig long")
        met = work.keep(some.groupBy("sig").agg(F.min("a").alias("low"), F.max("a").alias("high")).where("low < high").select("sig"), "met")
        parts.append(work.keep(some.join(met.hint("merge"), "sig").select("sig", "a", "na"), "slice"))
        work.drop(met)
    shared = work.keep(reduce(DataFrame.unionByName, parts).distinct(), "shared")
    for part in parts:
        work.drop(part)
    return shared


def _sets(k: int, sieve: Sieve):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            asked = batch.filter(pa.array(sieve.passes(batch.column("doc_id").to_numpy(zero_copy_only=False))))
            for chunk in text_chunks([asked]):
                sets = shingle_sets(chunk.column("text").to_pylist(), k, hashes)
                yield pa.record_batch([pa.array([set_class(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cid", "members"])

    return each


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        common = []
        for a, b in zip(batch.column("ma"), batch.column("mb"), strict=True):
            x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            both = np.sort(np.concatenate([x, y]), kind="stable")
            common.append(int((both[1:] == both[:-1]).sum()))
        yield pa.record_batch([batch.column("a"), batch.column("b"), batch.column("na"), batch.column("nb"), pa.array(common, pa.int64())], names=["a", "b", "na", "nb", "common"])


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [np.setxor1d(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), assume_unique=True).tobytes() for a, b in zip(batch.column("ma"), batch.column("mb"), strict=True)]
        yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(out, pa.binary())], names=["a", "b", "diff"])


class _Sets:
    """Whole sets of classes, made from the texts once for each class that is asked for. The texts are not shuffled: a pass over
    them leaves out what a bounded filter of the wanted ids rules out, and only sets go through an exchange."""

    def __init__(self, docs: DataFrame, classes: DataFrame, k: int, percent: int, work: Workspace):
        self.docs, self.classes, self.k, self.percent, self.work = docs, classes, k, percent, work
        self.parts: list[DataFrame] = []

    def table(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)

    def fetch(self, wanted: DataFrame) -> None:
        """wanted: cid, distinct."""
        if self.parts:
            wanted = wanted.join(self.table().select("cid").hint("merge"), "cid", "left_anti")
        named = self.work.keep(self.classes.join(wanted.hint("merge"), "cid").select("rep", "cid"), "wanted")
        if named.isEmpty():
            return
        made = self.docs.mapInArrow(_sets(self.k, Sieve(named.select("rep"))), "cid long, members binary")
        made = made.join(named.select("cid").hint("merge"), "cid", "left_semi").groupBy("cid").agg(F.first("members").alias("members"))
        self.parts.append(self.work.keep(made, "sets"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, na, nb) with their distance and whether they link; compared by their whole sets."""
        self.fetch(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct())
        left, right = (self.table().select(F.col("cid").alias(c), F.col("members").alias(f"m{c}")) for c in "ab")
        got = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "na", "nb", "ma", "mb").mapInArrow(_compare, "a long, b long, na long, nb long, common long")
        union = F.expr("na + nb - common")
        return self.work.keep(got.select("a", "b", "na", "nb", (100 * F.col("common") >= self.percent * union).alias("linked")), "pairs")


def _sketch_tiles(percent: int):
    """Of tiles in a row (rows in order of sig, first, second), pairs of a set that asks and one that is asked whose sizes and
    sketches leave room for a link, and which are not connected."""
    gap, most = 100 - percent, 100 + percent

    def near(rows: dict[str, np.ndarray]) -> Iterator[np.ndarray]:
        asks, asked = np.flatnonzero(rows["asks"]), np.flatnonzero(~rows["asks"])
        for i in asks.tolist():
            n, m = rows["n"][i], rows["n"][asked]
            at = asked[(100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (rows["g"][asked] != rows["g"][i])]
            apart = np.bitwise_count(rows["sketch"][at] ^ rows["sketch"][i]).sum(axis=1, dtype=np.int64)
            at = at[(n + rows["n"][at]) * gap >= most * apart]
            a, b = rows["a"][i], rows["a"][at]
            swap = b < a
            yield np.stack([np.where(swap, b, a), np.where(swap, a, b), np.where(swap, rows["n"][at], n), np.where(swap, n, rows["n"][at])])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _and_end(batches):
            if batch is not None:
                now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("sig", "first", "second", "a", "n", "g", "asks")}
                now["sketch"] = batch.column("sketch").flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH)
                held = now if held is None else {c: np.concatenate([held[c], now[c]]) for c in now}
            if held is None or not len(held["a"]):
                continue
            new = np.flatnonzero((np.diff(held["sig"]) != 0) | (np.diff(held["first"]) != 0) | (np.diff(held["second"]) != 0)) + 1
            cuts = [0, *new.tolist()] if batch is not None else [0, *new.tolist(), len(held["a"])]
            for lo, hi in zip(cuts, cuts[1:]):
                found = list(near({c: v[lo:hi] for c, v in held.items()}))
                if found and (pairs := np.concatenate(found, axis=1)).size:
                    yield pa.record_batch([pa.array(x) for x in pairs], names=["a", "b", "na", "nb"])
            held = {c: v[cuts[-1] :] for c, v in held.items()}

    return each


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _tile_links(percent: int):
    """Of the sets of a tile, which holds one or two blocks of a component: rows that link to each by the other block's sets."""

    def links(tile: pa.Table) -> pa.Table:
        cid, n, size, block = (tile.column(c).to_numpy() for c in ("cid", "n", "size", "block"))
        diffs = [np.frombuffer(x.as_buffer(), np.uint64) for x in tile.column("diff").combine_chunks()]
        d = np.array([len(x) for x in diffs], np.int64)
        flat = np.concatenate(diffs)
        order = np.argsort(flat, kind="stable")
        owner, flat = np.repeat(np.arange(len(d)), d)[order], flat[order]
        alone, rows = len(np.unique(block)) == 1 and tile.column("first")[0].as_py() == tile.column("second")[0].as_py(), np.zeros(len(cid), np.int64)
        for i, x in enumerate(diffs):
            lo, hi = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
            long = hi - lo
            at = np.repeat(lo - np.cumsum(long) + long, long) + np.arange(long.sum())
            apart = d[i] + d - 2 * np.bincount(owner[at], minlength=len(d))
            linked = (n[i] + n) * (100 - percent) >= (100 + percent) * apart
            linked &= (block != block[i]) | alone
            linked[i] = False
            rows[i] = size[linked].sum()
        return pa.table({"cid": pa.array(cid), "links": pa.array(rows)})

    return links


def _links(group: DataFrame, meets: DataFrame, sets: _Sets, work: Workspace) -> DataFrame:
    """cid and links: how many rows of other classes link to each class of a component (``group``: node, component)."""
    parts = sets.classes.join(group.withColumnRenamed("node", "cid").hint("merge"), "cid").join(meets.withColumnRenamed("a", "cid").hint("merge"), "cid", "left")
    parts = work.keep(parts.select("cid", "n", "size", "component", F.coalesce("meets", F.lit(0)).alias("meets")), "parts")
    roots = parts.groupBy("component").agg(F.max_by("cid", F.struct("meets", -F.col("cid"))).alias("root"), F.count("*").alias("many"))
    parts = work.keep(parts.join(roots.hint("merge"), "component").drop("meets"), "rooted")
    left, right = (sets.table().select(F.col("cid").alias(c), F.col("members").alias(f"m{c}")) for c in "ab")
    pairs = parts.select(F.col("cid").alias("a"), F.col("root").alias("b"))
    diffs = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "ma", "mb")
    diffs = work.keep(diffs.mapInArrow(_differences, "a long, b long, diff binary").select(F.col("a").alias("cid"), "diff"), "differences")
    blocks = F.expr(f"cast(ceil(many / {TILE}) as int)")
    tiles = parts.withColumn("block", F.pmod(F.xxhash64("cid"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tiles = tiles.select("cid", "n", "size", "block", "component", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second")).join(diffs.hint("merge"), "cid")
    return tiles.groupBy("component", "first", "second").applyInArrow(_tile_links(sets.percent), "cid long, links long").groupBy("cid").agg(F.sum("links").alias("links"))


def ngram_jaccard_join(docs: DataFrame, *, words: int = 5, percent: int = 80, count_links: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link documents whose sets of ``words``-word shingles (A-Z lower-cased) have a Jaccard similarity of ``percent`` or more.

    Returns doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included) and, unless
    ``count_links`` is off, n_links (how many other rows link to this row's text) for each row.
    Null or wordless texts have no shingles and no links. A null id keeps its row with a null component and no links, and
    counts for none. Rows that repeat an id count as one document that links by any of its texts; n_links counts them as rows.
    Other columns are ignored.
    """
    base = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    with Workspace(docs.sparkSession, "op2") as work:
        return materialize(_joined(base, words, percent, count_links, work), "op2-components")


def _joined(base: DataFrame, words: int, percent: int, count_links: bool, work: Workspace) -> DataFrame:
    known = base.where("doc_id IS NOT NULL")
    slices = ", ".join(f"sigs{i} array<long>" for i in range(SLICES))
    index = work.keep(base.mapInArrow(_index(words, percent), f"doc_id long, n long, cid long, sketch array<long>, {slices}"), "index")
    rows = work.keep(index.select("doc_id", "n", "cid"), "rows")
    # one row for each content: of copies one text is listed
    classes = work.keep(rows.where("doc_id IS NOT NULL AND n > 0").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.count("*").alias("size")), "classes")

    # members of lists with two classes or more; a set needs SHARED of them to have a partner
    shared = _shared(index, classes, work)
    counts = work.keep(shared.groupBy("sig").agg(F.count("*").alias("many")), "counts")
    listed = work.keep(shared.join(counts.hint("merge"), "sig"), "lists")
    work.drop(shared)
    meets = work.keep(listed.groupBy("a").agg(F.sum("many").alias("meets"), F.count("*").alias("listed")).where(f"listed >= {SHARED}"), "meets")
    lists = work.keep(listed.join(meets.select("a", "meets").hint("merge"), "a"), "members")
    work.drop(listed)
    sketches = sifted(index.where("doc_id IS NOT NULL AND n > 0").select(F.col("cid").alias("a"), "sketch"), Sieve(meets.select("a")), "a")
    sketches = work.keep(sketches.groupBy("a").agg(F.first("sketch").alias("sketch")), "sketches")
    work.drop(index)
    centres = lists.groupBy("sig").agg(F.max(F.struct("meets", (-F.col("a")).alias("less"), F.col("na").alias("nb"))).alias("c"), F.count("*").alias("left")).where("left > 1")
    centres = work.keep(centres.select("sig", (-F.col("c.less")).alias("b"), F.col("c.nb").alias("nb"), F.col("c.meets").alias("most")), "centres")
    pair = ["a", "b", "na", "nb"]
    near = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    differ = " + ".join(f"bit_count(sketch[{i}] ^ other[{i}])" for i in range(SKETCH))
    hopeful = lists.join(centres.hint("merge"), "sig").where(f"a <> b AND {near}").select(*pair, "most").distinct()
    hopeful = hopeful.join(sketches.hint("merge"), "a").join(sketches.select(F.col("a").alias("b"), F.col("sketch").alias("other")).hint("merge"), "b")
    hopeful = work.keep(hopeful.where(f"(na + nb) * {100 - percent} >= {100 + percent} * ({differ})").select(*pair, "most"), "hopeful")

    # first each set with its best centre, then with the centres it is not yet connected with
    sets = _Sets(known, classes, words, percent, work)
    group = work.keep(known.sparkSession.createDataFrame([], "node long, component long"), "nobody")
    found: list[DataFrame] = []
    named = lambda df, c, g: df.join(group.select(F.col("node").alias(c), F.col("component").alias(g)).hint("merge"), c, "left").withColumn(g, F.coalesce(g, c))
    if not hopeful.isEmpty():
        best = F.max_by(F.struct("b", "na", "nb"), F.struct("most", -F.col("b")))
        stars = sets.verified(work.keep(hopeful.groupBy("a").agg(best.alias("c")).select("a", "c.*").select(*pair), "best"))
        found.append(stars.where("linked").select("a", "b"))
        group = connected_components(found[0], work)
        apart = work.keep(named(named(hopeful, "a", "g"), "b", "h").where("g <> h").join(stars.select("a", "b").hint("merge"), ["a", "b"], "left_anti").select(*pair).distinct(), "apart")
        if not apart.isEmpty():
            found.append(sets.verified(apart).where("linked").select("a", "b"))
            group = connected_components(reduce(DataFrame.unionByName, found), work)

    # what the centres' answers leave open: members that are not connected with the centre of a list
    order = F.row_number().over(Window.partitionBy("a").orderBy(F.col("many").desc(), F.col("sig").desc()))
    short = lists.withColumn("back", order).where(f"back >= {SHARED}").select("sig", "a", "na")
    judged = named(named(short.join(centres.select("sig", "b").hint("merge"), "sig"), "a", "g"), "b", "h")
    judged = work.keep(judged.select("sig", "a", F.col("na").alias("n"), "g", (F.col("g") != F.col("h")).alias("open")), "judged")
    blocks = lambda c: F.expr(f"cast(ceil({c} / {TILE}) as int)")
    sizes = work.keep(judged.groupBy("sig").agg(F.count_if("open").alias("open_rows"), F.count("*").alias("all_rows")).where("open_rows > 0 AND all_rows > 1").select("sig", blocks("open_rows").alias("firsts"), blocks("all_rows").alias("seconds")), "open")
    if not sizes.isEmpty():
        laid = judged.join(sizes.hint("merge"), "sig")
        place = lambda many: F.pmod(F.xxhash64("a"), F.col(many)).cast("int")
        every = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
        asking = laid.where("open").withColumn("first", place("firsts")).withColumn("second", every("seconds")).withColumn("asks", F.lit(True))
        asked = laid.withColumn("second", place("seconds")).withColumn("first", every("firsts")).withColumn("asks", F.lit(False))
        tiles = asking.unionByName(asked).join(sketches.hint("merge"), "a").select("sig", "first", "second", "a", "n", "g", "asks", "sketch")
        tiles = tiles.repartition("sig", "first", "second").sortWithinPartitions("sig", "first", "second")
        rest = work.keep(tiles.mapInArrow(_sketch_tiles(percent), "a long, b long, na long, nb long").distinct(), "rest")
        if not rest.isEmpty():
            found.append(sets.verified(rest).where("linked").select("a", "b"))
            group = connected_components(reduce(DataFrame.unionByName, found), work)
    links = reduce(DataFrame.unionByName, found) if found else known.sparkSession.createDataFrame([], "a long, b long")
    told = classes.select("cid", "rep")
    if count_links:
        told = classes.withColumn("links", F.lit(None).cast("long"))
        if found:
            told = classes.join(_links(work.keep(group, "linked"), meets, sets, work).hint("merge"), "cid", "left")
        told = told.select("cid", "rep", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))

    # a document with several texts connects their classes
    filled = rows.where("doc_id IS NOT NULL AND n > 0")
    several = filled.groupBy("doc_id").agg(F.min("cid").alias("low"), F.max("cid").alias("high")).where("low < high")
    edges = work.keep(filled.join(several.hint("merge"), "doc_id").where("cid > low").select(F.col("cid").alias("a"), F.col("low").alias("b")).distinct(), "several")
    if not edges.isEmpty():
        group = connected_components(links.unionByName(edges), work)
    told = told.join(group.withColumnRenamed("node", "cid").hint("merge"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    told = work.keep(told, "told")
    told = told.join(told.groupBy("component").agg(F.min("rep").alias("component_id")).hint("merge"), "component").drop("component", "rep")
    filled = filled.join(told.hint("merge"), "cid")
    labels = filled.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    bare = rows.where("doc_id IS NULL OR n = 0").join(labels.hint("merge"), "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    out = ["doc_id", F.col("n").alias("n_shingles"), "component_id", *["n_links"] * count_links]
    return filled.select(*out).unionByName(bare.withColumn("n_links", F.lit(0).cast("long")).select(*out))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), words=3, percent=90)


QUERIES = {"op2_ngram_jaccard_join": op2_ngram_jaccard_join}
SQL: dict[str, str] = {}
