"""Operator 8, token counts by a whole-token shortcut.

Offline, once per worker: every vocabulary string of the form "space + word" that the library encodes alone as itself is a
*whole token*. The vocabulary is also searched for pieces that reach over a space or a line break; where there are none, no
merge can cross one, so a text's count is the sum over its pre-tokens (word with the space before it, line break with the
word after it). A pre-token that is a whole token counts one; only the rest is merged, by the library, and remembered in
two bounded generations. Texts with runs of spaces go to the library as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import id_and_text, table, text_chunks

_SPACE = "▁"
_counters: dict[str, PretokenCounts] = {}


class PretokenCounts(dict):
    """Pre-token -> number of tokens. Holds whole tokens for good and other pre-tokens while they are used."""

    limit = 200_000

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.splits = not any("\n" in p or _SPACE in p.lstrip(_SPACE) for p in pieces)
        words = [p[1:] for p in pieces if p[0] == _SPACE and len(p) > 1 and _SPACE not in p[1:]]
        self.whole = {w: 1 for w, ids in zip(words, self.model.encode(words), strict=True) if len(ids) == 1}
        # a line break is one token of its own, after the token that stands for the space put before every text
        self.splits = self.splits and len(self.model.encode("\n")) == 2 and len(self.model.encode("\n\n")) == 3
        self.old: dict[str, int] = {}
        super().__init__(self.whole)

    def __missing__(self, part: str) -> int:
        n = self.old.get(part)
        if n is None:
            n = len(self.model.encode(part)) - (part[0] == "\n")
        if len(part) <= 64:
            self[part] = n
        return n

    def count(self, text: str) -> int:
        parts = f" {text}".replace(_SPACE, " ").replace("\n", " \n").split(" ")
        if not text:
            return 0
        if not self.splits or "" in parts[1:]:
            return len(self.model.encode(text))
        if len(self) > self.limit + len(self.whole):
            self.old = dict(self)
            self.clear()
            self.update(self.whole)
        return sum(map(self.__getitem__, parts[1:]))


def _count(path: str):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(path) or _counters.setdefault(path, PretokenCounts(path))
        for chunk in text_chunks(batches):
            texts = [t or b"" for t in chunk.column("text").to_pylist()]
            yield pa.record_batch(
                [chunk.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([counter.count(t.decode("utf-8", "replace")) for t in texts], pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return each


def token_counts(docs: DataFrame, *, model_path: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of each text by a sentencepiece model, without begin, end or other added tokens.

    Returns doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit``) for each row, in one pass without a
    shuffle. Null counts as empty: no bytes, no tokens. Rows are independent: repeated ids and null ids keep their rows.
    Other columns are ignored.
    """
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    kind = docs.schema[id_col].dataType.simpleString()
    counted = id_and_text(docs, id_col, text_col).mapInArrow(_count(str(model_path)), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op8_token_counts": op8_token_counts}
SQL: dict[str, str] = {}
