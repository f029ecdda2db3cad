"""Token counts with a whole-token shortcut (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, texts
from .tokens import WordPieceCounter, once, path_of, whole_tokens


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = 2048) -> DataFrame:
    """Tokens of every whole text, without special tokens added.

    Before any text is read, every vocabulary string is proved to encode alone as
    one token or not (:func:`whole_tokens`); the set, bounded by the vocabulary, goes
    to the tasks. Pre-tokens in it count as one, only the others are merged. Special
    strings inside texts follow the library's default. A null or empty text has no
    token. One row per input row, repeated rows included; there is no shuffle.
    Returns doc_id, n_bytes, n_tokens, over_limit. Other columns are ignored.
    """
    path = tokenizer or path_of("word_bpe_49k.json")
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = once(("counter", path), lambda: WordPieceCounter(path, whole.value))
        for batch in batches:
            found = texts(batch.column("text"))
            tokens = pa.array([counter.count(t) for t in found], pa.int64())
            sizes = pa.array([len(t.encode()) for t in found], pa.int64())
            over = pa.array([n > limit for n in tokens.to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, tokens, over], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_batches(docs.select("doc_id", "text"), count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
