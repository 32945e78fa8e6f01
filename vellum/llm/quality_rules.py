"""Operator 9, quality rules by suffix-array repetition.

The words of a block of documents stand in one row, each word mixed with its document, so that no suffix meets one of another
document. Prefix doubling sorts the suffixes; only those whose prefix still has an equal stay in the race. Longest common prefixes of neighbours in the suffix array are measured by content hashes
(the longest length at which both agree), so no rank but the last is kept. They give for every place the longest passage that
starts there and stands in the document twice. The union of these spans is what is repeated; the rules limit its share of the
words and the longest repeat.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import BASE_A, WordHashes, flat_words, free_name, mix, prefix_sums, span_hashes, table, text_chunks

_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"


def longest_repeats(flat: np.ndarray, starts: np.ndarray, least: int = 4) -> np.ndarray:
    """For each place the length of the longest passage that starts there and also elsewhere in its document, 0 below ``least``.

    Memory: about 130 bytes a word where all of a text repeats, however often; less where little does.
    """
    n = len(flat)
    out = np.zeros(n, np.int32)
    if n < least:
        return out
    sizes = np.diff(starts)
    salt = mix(np.arange(1, len(starts), dtype=np.uint64))
    own = mix(flat + np.repeat(salt, sizes))  # a word of this document
    end = np.repeat(starts[1:], sizes).astype(np.int32)
    sums = prefix_sums(own, BASE_A)
    # a rank is the place in the suffix array of the first suffix that begins with the same h words
    order = np.argsort(own)
    key, active = own[order], order.astype(np.int32)
    del own, order
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).astype(np.int32)
    del key
    many = np.diff(begin, append=np.int32(n))
    rank = np.empty(n, np.int32)
    rank[active] = np.repeat(begin, many)
    active = active[np.repeat(many > 1, many)]
    kept, h = None, 1
    while True:
        if h == least:
            kept = active.copy()
        if not len(active):
            break
        key = rank[active].astype(np.int64) << 32
        after = np.minimum(active.astype(np.int64) + h, n - 1)
        key |= np.where(active + np.int64(h) < end[active], rank[after] + 1, 0)
        del after
        order = np.argsort(key, kind="stable").astype(np.int32)
        key, active = key[order], active[order]
        del order
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))  # of the groups from now on
        key = key[begin] >> 32
        old = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), begin, 0))
        many = np.diff(begin, append=len(active))
        rank[active] = np.repeat((key + begin - old).astype(np.int32), many)
        active = active[np.repeat(many > 1, many)]
        h *= 2
    if kept is None or not len(kept):
        return out
    suffixes = kept[np.argsort(rank[kept], kind="stable")]
    for lo in range(0, len(suffixes) - 1, 1 << 17):
        i, j = suffixes[lo : lo + (1 << 17)], suffixes[lo + 1 : lo + 1 + (1 << 17)]
        i = i[: len(j)].astype(np.int64)
        j = j.astype(np.int64)
        lcp, most = np.zeros(len(i), np.int64), np.minimum(end[i] - i, end[j] - j)
        step = 1 << int(most.max()).bit_length()
        while step:
            more = np.flatnonzero(lcp + step <= most)
            x, y, far = i[more], j[more], lcp[more] + step
            same = span_hashes(sums, BASE_A, x, x + far) == span_hashes(sums, BASE_A, y, y + far)
            lcp[more[same]] += step
            step >>= 1
        lcp[lcp < least] = 0
        np.maximum.at(out, i, lcp)
        np.maximum.at(out, j, lcp)
    return out


def _covered(repeats: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """Words of each document that lie in a repeat of ``least`` words or more."""
    marks = np.zeros(len(repeats) + 1, np.int64)
    at = np.flatnonzero(repeats >= least)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + repeats[at], -1)
    total = np.concatenate([[0], np.cumsum(np.cumsum(marks[:-1]) > 0)])
    return total[starts[1:]] - total[starts[:-1]]


def _rules(window: int, long: int, carried: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for chunk in text_chunks(batches, max_bytes=2 << 20):
            texts = [t or b"" for t in chunk.column("text").to_pylist()]
            flat, starts = flat_words(texts, hashes)
            repeats = longest_repeats(flat, starts)
            longest = [int(repeats[a:b].max()) if b > a else 0 for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            lines = [[x for x in t.split(b"\n") if x.strip(_SPACES)] for t in texts]
            yield pa.record_batch(
                [
                    chunk.column("doc_id"),
                    pa.array(np.diff(starts)),
                    pa.array([len(t.translate(None, _SPACES).decode("utf-8", "replace")) for t in texts], pa.int64()),
                    pa.array([len(t) - len(t.translate(None, _SYMBOLS)) for t in texts], pa.int64()),
                    pa.array([len(x) - len(set(x)) for x in lines], pa.int64()),
                    pa.array(_covered(repeats, starts, window)),
                    pa.array(_covered(repeats, starts, long)),
                    pa.array([x if x >= window else 0 for x in longest], pa.int64()),
                    *[chunk.column(f"_carried{k}") for k in range(carried)],
                ],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_long_repeat_words", "longest_repeat", *(f"_carried{k}" for k in range(carried))],
            )

    return each


def quality_rules(
    docs: DataFrame,
    *,
    min_words: int = 10,
    window: int = 5,
    max_repeat_percent: int = 20,
    long: int = 12,
    max_long_percent: int = 15,
    max_longest: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Iterable[str] = (),
) -> DataFrame:
    """Counts of each text and whether the rules keep it.

    base_failed: fewer than ``min_words`` words, or more than ``max_repeat_percent`` of the words lie in ``window``-word
    windows found twice or more in the text. kept: not base_failed, at most ``max_long_percent`` of the words in repeats of
    ``long`` words or more, and no repeat of over ``max_longest`` words.

    One row per row of ``docs`` in one pass without a shuffle: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_long_repeat_words, longest_repeat, base_failed, kept and the carried columns. Null counts as empty,
    which base_failed rejects. Repeated and null ids keep their rows. Other columns are ignored unless carried; a carried column whose
    name is one of the operator's own comes back as ``name_in``. Empty tables give no rows; texts may be of any length.
    """
    carry = list(carry)
    kind = docs.schema[id_col].dataType.simpleString()
    more = "".join(f", _carried{k} {docs.select(c).schema[0].dataType.simpleString()}" for k, c in enumerate(carry))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), *(F.col(c).alias(f"_carried{k}") for k, c in enumerate(carry)))
    got = rows.mapInArrow(
        _rules(window, long, len(carry)),
        f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_long_repeat_words long, longest_repeat long{more}",
    )
    failed = f"n_words < {min_words} OR 100 * n_repeat_words > {max_repeat_percent} * n_words"
    kept = f"NOT ({failed}) AND 100 * n_long_repeat_words <= {max_long_percent} * n_words AND longest_repeat <= {max_longest}"
    own = [c for c in got.columns if not c.startswith("_carried")]
    taken = [*own, "base_failed", "kept"]
    return got.select(*own, F.expr(failed).alias("base_failed"), F.expr(kept).alias("kept"), *(F.col(f"_carried{k}").alias(free_name(c, taken)) for k, c in enumerate(carry)))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = quality_rules(table(spark, sf_dir, "documents"))
    return rules.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_long_repeat_words", "longest_repeat")


QUERIES = {"op9_quality_rules": op9_quality_rules}
SQL: dict[str, str] = {}
