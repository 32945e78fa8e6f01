"""Operator 12, near-duplicates by bottom-k sketches of one hash function.

Sketch. Shingles are hashed once, by one 64-bit function; a set's sketch is its SKETCH smallest values. The values of the sketch
of a union that both sets have stand in both sketches, and the sketch of the union follows from the two: the share of its values that
both sets have estimates their similarity. A set of at most SKETCH shingles is its own sketch, and the estimate is exact.

Lists. Every retained value has a list of the sets that keep it. Linked sets have at least ``least`` values of the union's sketch in
common: the whole bound where the sketch holds the set, else the number that a share of ``percent`` misses once in 10^MISS pairs.
So, with the values of a sketch ordered from rare to frequent (counts of all sketches), two linked sets meet within their first
size - least + 1 values, and only these are listed. A value that no other set keeps has no list but its place counts, so a set with
many values of its own is in no list, and what very many texts share is last in every order.

Overlaps. Sets of equal content are one class before anything is listed. In each list all members meet its centre, the member with the
longest lists; members that link to it are one component already and need no further look. What stays open is a list that holds
sets of several components; in lists over LONG rows further centres, from outside of the largest component, are met first. Then a task
overlays the members of a list of at most LONG rows (of a longer one, a block of members outside of the largest component and
a block of all): parities of at least 2 n classes of a set's values bound every difference from below, and only sets that are not
connected yet and pass are laid side by side. Where both sketches are whole sets that settles the pair; other pairs go by the estimate from
the sketch of the union, are taken as links for the time being, and the lists that stay open are overlaid once more without
doing so. So a task sends fewer pairs than it has rows, and then the few that are near the bound and not connected. Every pair that
leaves is confirmed by exact Jaccard on the full sets.

Classes. Two sets are held equal if their 63-bit number and a second, independent 64-bit number agree; should two classes have
one number, all but one of them get numbers of their own. Classes, not ids, are what is linked: a document with several
texts connects the classes of its texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Sieve, WordHashes, Workspace, connected_components, id_and_text, materialize, mix, sifted, table, text_chunks
from .ngram_join import _and_end, _compare, set_class, shingle_sets

SKETCH = 256
MISS = 7  # a linked pair of large sets falls below the bound once in 10^7
BITS = 1024  # classes of values at least
LONG = 4096  # rows of a list that are settled in one task
CENTRES = 4  # of lists with more rows


def least_common(size: int, percent: int) -> int:
    """Of the ``size`` values of a union's sketch, how many two sets of ``percent`` similarity have in common but once in 10^MISS."""
    p, below = percent / 100, 0.0
    for common in range(size + 1):
        below += math.comb(size, common) * p**common * (1 - p) ** (size - common)
        if below > 10.0**-MISS:
            return common
    return size


class Bounds:
    """How many values linked sets share, by the size of one of them."""

    def __init__(self, percent: int, size: int = SKETCH):
        self.percent, self.size, self.sampled = percent, size, least_common(size, percent)

    def least(self, n: int) -> int:
        """Values of the union's sketch that a set of ``n`` shingles has in common with a linked one, at least."""
        if 100 * n <= self.percent * self.size:  # the union fits a sketch, whatever the partner
            return -(-n * self.percent // 100)
        return min(self.sampled, -(-min(n, self.size) * self.percent // 100))

    def listed(self) -> dict[int, tuple[int, int]]:
        """By the number of values in a sketch, the largest size first: how many are needed, and how many are listed."""
        return {n: (self.least(n), min(n, self.size) - self.least(n) + 1) for n in range(1, self.size + 1)}


def check_number(members: np.ndarray) -> int:
    """A second number of the class, independent of ``set_class``."""
    with np.errstate(over="ignore"):
        total = mix(members * np.uint64(0xA24BAED4963EE407) + np.uint64(0x9FB21C651E98DF25)).sum(dtype=np.uint64)
        return int(mix(np.array([total + np.uint64(len(members))], np.uint64)).view(np.int64)[0])


def parity(members: np.ndarray) -> np.ndarray:
    """Whether each of a power of two of classes of values, 2 n or more, has an odd number of members, as words of 64 bits. The
    bits of half as many classes are those of both halves, one over the other."""
    bits = max(BITS, 1 << (2 * len(members) - 1).bit_length()) if len(members) else BITS
    odd = np.bincount((mix(members) >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _index(words: int, size: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for chunk in text_chunks(batches):
            sets = shingle_sets(chunk.column("text").to_pylist(), words, hashes)
            sketches = [s[:size].view(np.int64) for s in sets]
            offsets = np.cumsum([0, *map(len, sketches)]).astype(np.int32)
            flat = np.concatenate(sketches) if sketches else np.empty(0, np.int64)
            yield pa.record_batch(
                [
                    chunk.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_class(s) for s in sets], pa.int64()),
                    pa.array([check_number(s) for s in sets], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    pa.array([parity(s).tobytes() for s in sets], pa.binary()),
                ],
                names=["doc_id", "n", "cid", "also", "sketch", "parity"],
            )

    return each


def _full_sets(words: int, sieve: Sieve):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for chunk in text_chunks([batch.filter(pa.array(sieve.ok(batch)))]):
                sets = shingle_sets(chunk.column("text").to_pylist(), words, hashes)
                yield pa.record_batch([pa.array([set_class(s) for s in sets], pa.int64()), pa.array([check_number(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cid", "also", "members"])

    return each


def _likely(bounds: Bounds, a: np.ndarray, b: np.ndarray, na: int, nb: int) -> tuple[bool, bool]:
    """Whether the union's sketch leaves room for a link, and whether that is certain (both sketches are whole sets)."""
    both = np.sort(np.concatenate([a, b]).view(np.uint64), kind="stable")
    same = both[1:] == both[:-1]
    if na <= bounds.size and nb <= bounds.size:
        common = int(same.sum())
        return 100 * common >= bounds.percent * (na + nb - common), True
    union = np.flatnonzero(np.concatenate([[True], ~same]))[: bounds.size]  # the smallest values of the union
    return int(np.concatenate([same, [False]])[union].sum()) >= bounds.sampled, False


def _estimates(percent: int, size: int):
    """Of pairs with both sketches, those whose union's sketch leaves room for a link."""
    bounds = Bounds(percent, size)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("sa"), batch.column("sb"), batch.column("na").to_pylist(), batch.column("nb").to_pylist(), strict=True)
            ok = [_likely(bounds, x.values.to_numpy(), y.values.to_numpy(), n, m)[0] for x, y, n, m in rows]
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(ok, pa.bool_()))

    return each


class Parities:
    """Lower bounds of the differences of sets of a tile, from parities of any widths (of sets of like size, at most twice another's)."""

    def __init__(self, rows: list[np.ndarray]):
        self.width = np.array([len(r) for r in rows], np.int64)
        self.place, self.whole, self.half = np.zeros(len(rows), np.int64), {}, {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            self.place[at] = np.arange(len(at))
            self.whole[w] = np.stack([rows[i] for i in at])
            self.half[w] = self.whole[w][:, : w // 2] ^ self.whole[w][:, w // 2 :]

    def apart(self, i: int, at: np.ndarray) -> np.ndarray:
        w, k, out = int(self.width[i]), self.place[i], np.zeros(len(at), np.int64)
        for other, mine, theirs in ((w, self.whole, self.whole), (2 * w, self.whole, self.half), (w // 2, self.half, self.whole)):
            some = self.width[at] == other
            if some.any():
                out[some] = np.bitwise_count(theirs[other][self.place[at[some]]] ^ mine[w][k]).sum(axis=1, dtype=np.int64)
        return out


def overlaid(a: np.ndarray, n: np.ndarray, g: np.ndarray, asks: np.ndarray, sketches: list[np.ndarray], parities: list[np.ndarray], bounds: Bounds, trust: bool) -> Iterator[tuple[int, int, int, int]]:
    """Pairs (a, b, na, nb) of rows that ask and rows of other components ``g``. Certain links come only where they connect two
    components, and so that all links between these rows follow from them; so do likely ones if they are to be trusted, else all."""
    bits = Parities(parities)
    group = np.unique(g, return_inverse=True)[1]
    asks = np.flatnonzero(asks)
    for k, i in enumerate(asks.tolist()):
        open_ = (group != group[i]) & (100 * np.minimum(n, n[i]) >= bounds.percent * np.maximum(n, n[i]))
        open_[asks[:k]] = False  # these have asked
        at = np.flatnonzero(open_)
        apart = bits.apart(i, at)
        keep = apart * (100 + bounds.percent) <= (n[at] + n[i]) * (100 - bounds.percent)
        order = np.argsort(apart[keep], kind="stable")
        for j in at[keep][order].tolist():
            if group[j] == group[i]:
                continue  # connected since
            near, certain = _likely(bounds, sketches[i], sketches[j], int(n[i]), int(n[j]))
            if near:
                yield int(a[i]), int(a[j]), int(n[i]), int(n[j])
                if certain or trust:
                    group[group == group[j]] = group[i]


def _overlays(percent: int, size: int, trust: bool):
    """``overlaid`` for tiles in a row (rows in order of key, first, second)."""
    bounds = Bounds(percent, size)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in _and_end(batches):
            rows = pa.Table.from_batches(held + [batch] if batch is not None else held) if held or batch is not None else None
            if rows is None or not rows.num_rows:
                continue
            key = [rows.column(c).to_numpy() for c in ("key", "first", "second")]
            new = np.flatnonzero(reduce(np.logical_or, (np.diff(c) != 0 for c in key))) + 1
            cuts = [0, *new.tolist()] if batch is not None else [0, *new.tolist(), rows.num_rows]
            found = []
            for lo, hi in zip(cuts, cuts[1:]):
                tile = rows.slice(lo, hi - lo)
                sketches = [x.values.to_numpy() for x in tile.column("sketch").combine_chunks()]
                parities = [np.frombuffer(x.as_buffer(), np.uint64) for x in tile.column("parity").combine_chunks()]
                found += overlaid(*(tile.column(c).to_numpy() for c in ("a", "n", "g", "asks")), sketches, parities, bounds, trust)
            if found:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b", "na", "nb"])
            held = rows.slice(cuts[-1]).to_batches() if batch is not None else []

    return each


class _Pairs:
    """What has been compared, and what of it links. ``meet`` takes candidate pairs (a, b, na, nb, in any order, repeated)."""

    def __init__(self, docs: DataFrame, classes: DataFrame, words: int, percent: int, size: int, work: Workspace):
        self.docs, self.classes, self.words, self.percent, self.size, self.work = docs, classes, words, percent, size, work
        self.compared: list[DataFrame] = []
        self.sets: list[DataFrame] = []
        self.group = docs.sparkSession.createDataFrame([], "node long, component long")

    def links(self) -> DataFrame | None:
        return reduce(DataFrame.unionByName, self.compared).where("linked").select("a", "b") if self.compared else None

    def components(self, rows: DataFrame, of: str, name: str) -> DataFrame:
        """Adds the component of column ``of``: its own number where nothing links to it."""
        known = self.group.select(F.col("node").alias(of), F.col("component").alias(name))
        return rows.join(known.hint("merge"), of, "left").withColumn(name, F.coalesce(name, of))

    def meet(self, candidates: DataFrame) -> None:
        low = F.col("a") < F.col("b")
        pairs = candidates.where(f"a <> b AND 100 * least(na, nb) >= {self.percent} * greatest(na, nb)")
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(low, F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(low, F.col("nb")).otherwise(F.col("na")).alias("nb")).distinct()
        if self.compared:
            pairs = pairs.join(reduce(DataFrame.unionByName, self.compared).select("a", "b").hint("merge"), ["a", "b"], "left_anti")
        for side in "ab":
            pairs = pairs.join(self.classes.select(F.col("cid").alias(side), F.col("sketch").alias(f"s{side}")).hint("merge"), side)
        pairs = self.work.keep(pairs.mapInArrow(_estimates(self.percent, self.size), "a long, b long, na long, nb long"), "likely")
        if pairs.isEmpty():
            return
        self.fetch(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct())
        whole = reduce(DataFrame.unionByName, self.sets)
        for side in "ab":
            pairs = pairs.join(whole.select(F.col("cid").alias(side), F.col("members").alias(f"m{side}")).hint("merge"), side)
        pairs = pairs.select("a", "b", "na", "nb", "ma", "mb").mapInArrow(_compare, "a long, b long, na long, nb long, common long")
        self.compared.append(self.work.keep(pairs.select("a", "b", F.expr(f"100 * common >= {self.percent} * (na + nb - common)").alias("linked")), "compared"))
        self.group = self.work.keep(connected_components(self.links(), self.work), "group")

    def fetch(self, wanted: DataFrame) -> None:
        """Full sets of classes, made again from one text each: only sets go through an exchange, and only of what is asked for."""
        if self.sets:
            wanted = wanted.join(reduce(DataFrame.unionByName, self.sets).select("cid").hint("merge"), "cid", "left_anti")
        wanted = self.work.keep(self.classes.select("rep", "number", "also", "cid").join(wanted.hint("merge"), "cid"), "wanted")
        if wanted.isEmpty():
            return
        made = self.docs.mapInArrow(_full_sets(self.words, Sieve(wanted.select("rep"))), "cid long, also long, members binary").withColumnRenamed("cid", "number")
        made = made.join(wanted.select("number", "also", "cid").hint("merge"), ["number", "also"])
        self.sets.append(self.work.keep(made.groupBy("cid").agg(F.first("members").alias("members")), "sets"))


def _sketch_lists(classes: DataFrame, percent: int, size: int, work: Workspace) -> DataFrame:
    """key, a, n: of each class the values that its partners must meet, from rare to frequent, as far as others keep them."""
    spark = classes.sparkSession
    # smaller sets link to none but their equals
    values = classes.where(f"n * {100 - percent} >= {percent}").select("cid", "n", F.explode("sketch").alias("key"))
    counts = work.keep(values.groupBy("key").agg(F.count("*").alias("many")).where("many > 1"), "counts")
    kept = sifted(values, Sieve(counts.select("key")), "key").join(counts.hint("merge"), "key")
    bounds = Bounds(percent, size)
    table_of = spark.createDataFrame([(n, *both) for n, both in bounds.listed().items()], "held int, least int, listed int")  # a row for each size of a sketch
    near = kept.groupBy("cid").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("many", "key"))).alias("keys"))  # SKETCH values at most
    near = near.withColumn("held", F.least("n", F.lit(size)).cast("int")).join(F.broadcast(table_of), "held")
    # values of its own come first in the order and take places of the prefix
    near = near.withColumn("left", F.expr("listed - (held - size(keys))")).where("size(keys) >= greatest(least, 1) AND left > 0")
    return near.select(F.explode(F.slice("keys", F.lit(1), F.col("left"))).alias("k"), F.col("cid").alias("a"), "n").select("k.key", "a", "n")


def _with_others(lists: DataFrame, work: Workspace) -> DataFrame:
    """Only lists of two members or more."""
    counts = lists.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
    return work.keep(lists.join(work.keep(counts, "counts").hint("merge"), "key"), "lists")


def _meet_centres(lists: DataFrame, pairs: _Pairs, work: Workspace) -> None:
    """The members of each list meet one of those that ``asks``: the one with the longest lists."""
    meets = work.keep(lists.groupBy("a").agg(F.sum("many").alias("meets")), "meets")
    centres = lists.where("asks").join(meets.hint("merge"), "a").groupBy("key").agg(F.max(F.struct("meets", -F.col("a"), "n", "g")).alias("c"))
    centres = work.keep(centres.select("key", (-F.col("c.col2")).alias("b"), F.col("c.n").alias("nb"), F.col("c.g").alias("h")), "centres")
    pairs.meet(lists.withColumnRenamed("n", "na").join(centres.hint("merge"), "key").where("g <> h"))


def _open_lists(lists: DataFrame, pairs: _Pairs, work: Workspace) -> DataFrame | None:
    """Lists that hold several components: their rows, with the component ``g``, and ``asks`` outside of the largest one."""
    rows = work.keep(pairs.components(lists.select("key", "a", "n", "many"), "a", "g"), "grouped")
    sizes = rows.groupBy("key", "g").agg(F.count("*").alias("rows"))
    several = sizes.groupBy("key").agg(F.max_by("g", F.struct("rows", "g")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    several = work.keep(several.select("key", "most"), "several")
    return None if several.isEmpty() else work.keep(rows.join(several.hint("merge"), "key").withColumn("asks", F.expr("g <> most")).drop("most"), "open")


def _overlay(rows: DataFrame, pairs: _Pairs, long: int, trust: bool, work: Workspace) -> None:
    """Overlay the rows of each list; of a list over ``long`` rows, every block of rows that ask and every block of all."""
    some = rows.groupBy("key").agg(F.count_if("asks").alias("asking"))
    rows = rows.join(work.keep(some, "asking").hint("merge"), "key")
    half = f"cast(ceil(2 * {{}} / {long}) as int)"
    firsts, seconds = F.expr(f"IF(many <= {long}, 1, {half.format('asking')})"), F.expr(f"IF(many <= {long}, 1, {half.format('many')})")
    place = lambda blocks: F.pmod(F.xxhash64("a"), blocks).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), blocks - 1))
    short = rows.where(f"many <= {long}").select("key", "a", "n", "g", "asks", F.lit(0).alias("first"), F.lit(0).alias("second"))
    large = rows.where(f"many > {long}")
    asking = large.where("asks").select("key", "a", "n", "g", "asks", place(firsts).alias("first"), every(seconds).alias("second"))
    asked = large.select("key", "a", "n", "g", F.lit(False).alias("asks"), every(firsts).alias("first"), place(seconds).alias("second"))
    tiles = short.unionByName(asking).unionByName(asked).join(pairs.classes.select(F.col("cid").alias("a"), "sketch", "parity").hint("merge"), "a")
    tiles = tiles.select("key", "first", "second", "a", "n", "g", "asks", "sketch", "parity").repartition("key", "first", "second").sortWithinPartitions("key", "first", "second")
    pairs.meet(work.keep(tiles.mapInArrow(_overlays(pairs.percent, pairs.size, trust), "a long, b long, na long, nb long"), "overlaid"))


def linked_classes(lists: DataFrame, pairs: _Pairs, work: Workspace, long: int) -> None:
    """Find links that connect all classes that any links connect. Linked ones share one of ``lists`` (key, a, n) or more."""
    lists = _with_others(lists, work)
    if lists.isEmpty():
        return
    _meet_centres(lists.select("*", F.col("a").alias("g"), F.lit(True).alias("asks")), pairs, work)
    rows = _open_lists(lists, pairs, work)
    for _ in range(CENTRES - 1):
        if rows is None or (large := rows.where(f"many > {long}")).isEmpty():
            break
        _meet_centres(large, pairs, work)
        rows = _open_lists(rows, pairs, work)
    if rows is None:
        return
    _overlay(rows, pairs, long, True, work)
    rows = _open_lists(rows, pairs, work)
    if rows is None:
        return
    # only where a set is larger than its sketch a link was taken on trust
    trusted = work.keep(rows.groupBy("key").agg(F.max("n").alias("largest")).where(f"largest > {pairs.size}").select("key"), "trusted")
    if not trusted.isEmpty():
        _overlay(rows.join(trusted.hint("merge"), "key"), pairs, long, False, work)


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 85, size: int = SKETCH, long: int = LONG, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link documents whose sets of ``words``-word shingles (A-Z lower-cased) have a Jaccard similarity of ``percent`` or more.

    Returns doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included) and kept (doc_id =
    component_id) of each row. Null or wordless texts have no shingles and no links. A null id keeps its row with a null
    component, is not kept and counts for none. Rows that repeat an id count as one document that links by any of its texts;
    each has its own number of shingles. Other columns are ignored, an empty table gives no rows.
    """
    base = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    with Workspace(docs.sparkSession, "op12") as work:
        out = materialize(_components(base, words, percent, size, long, work), "op12-components")
    return out


def _components(base: DataFrame, words: int, percent: int, size: int, long: int, work: Workspace) -> DataFrame:
    known = base.where("doc_id IS NOT NULL")
    index = work.keep(base.mapInArrow(_index(words, size), "doc_id long, n long, cid long, also long, sketch array<long>, parity binary"), "index")
    filled = index.where("doc_id IS NOT NULL AND n > 0")
    kinds = filled.groupBy("cid", "also").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first(F.struct("sketch", "parity")).alias("x"))
    kinds = work.keep(kinds.select(F.col("cid").alias("number"), "also", "rep", "n", "x.sketch", "x.parity"), "kinds")
    rows = work.keep(index.drop("sketch", "parity").withColumnRenamed("cid", "number"), "rows")
    work.drop(index)
    # numbers are not negative: classes that clash in theirs (none is expected) get negative ones
    clash = work.keep(kinds.groupBy("number").agg(F.count("*").alias("many"), F.min("also").alias("also")).where("many > 1").drop("many"), "clash")
    classes = kinds.withColumn("cid", F.col("number"))
    if not clash.isEmpty():
        others = kinds.join(clash.select("number").hint("merge"), "number", "left_semi").join(clash.hint("merge"), ["number", "also"], "left_anti")
        renamed = others.select("number", "also", (-F.row_number().over(Window.orderBy("number", "also"))).cast("long").alias("new"))
        classes = kinds.join(work.keep(renamed, "renamed").hint("merge"), ["number", "also"], "left").withColumn("cid", F.coalesce("new", "number")).drop("new")
        classes = work.keep(classes, "classes")
    pairs = _Pairs(known, classes, words, percent, size, work)
    linked_classes(_sketch_lists(classes, percent, size, work), pairs, work, long)

    # rows by class; a document with several texts connects their classes
    filled = rows.where("doc_id IS NOT NULL AND n > 0").join(classes.select("number", "also", "cid").hint("merge"), ["number", "also"]).select("doc_id", "n", "cid")
    filled = work.keep(filled, "filled")
    several = filled.groupBy("doc_id").agg(F.min("cid").alias("low"), F.max("cid").alias("high")).where("low < high")
    edges = work.keep(filled.join(several.hint("merge"), "doc_id").where("cid > low").select(F.col("cid").alias("a"), F.col("low").alias("b")).distinct(), "several")
    if not edges.isEmpty():
        links = pairs.links()
        pairs.group = work.keep(connected_components(edges if links is None else links.unionByName(edges), work), "group")
    told = work.keep(pairs.components(classes.select("cid", "rep"), "cid", "component"), "told")
    told = told.join(told.groupBy("component").agg(F.min("rep").alias("component_id")).hint("merge"), "component").select("cid", "component_id")
    filled = filled.join(told.hint("merge"), "cid").select("doc_id", "n", "component_id")
    labels = filled.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    bare = rows.where("doc_id IS NULL OR n = 0").select("doc_id", "n").join(labels.hint("merge"), "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return filled.unionByName(bare).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=5, percent=85)


QUERIES = {"op12_minhash_near_dedup": op12_minhash_near_dedup}
SQL: dict[str, str] = {}
