"""Quality rules with a hashed n-gram log-likelihood ratio (operator 5)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, slices, stage, utf8
from .tokens import Memo, once

BUCKETS = 1 << 16
#: Buckets of a histogram that are summed together; a histogram has 32 such slices.
SLICE = 1 << 11
MIX, PRIME = 1_000_003, 4_294_967_291
CHUNK = 1 << 21
#: Words whose hashes a worker remembers in a generation.
REMEMBERED = 100_000
_MARKS = b"#*$%&|<>"


def _hash(word: bytes) -> int:
    return int.from_bytes(hashlib.md5(word).digest()[:4], "big")


def features(words: list[bytes]) -> np.ndarray:
    """Buckets of the words and of the pairs of neighbouring words, A-Z lower-cased."""
    memo = once("quality-hash", lambda: Memo(lambda w: _hash(w.lower()), REMEMBERED))
    h = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
    return np.concatenate((h % BUCKETS, (h[:-1] * MIX + h[1:]) % PRIME % BUCKETS))


def repeated_words(docs: list[list[bytes]]) -> np.ndarray:
    """For each document, the words inside 3-word windows found twice or more in it."""
    lengths = np.array([len(d) for d in docs], np.int64)
    out, total = np.zeros(len(docs), np.int64), int(lengths.sum())
    if total < 3:
        return out
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for d in docs for w in d), np.int64, total)
    doc = np.repeat(np.arange(len(docs)), lengths)
    whole = doc[:-2] == doc[2:]
    at = np.flatnonzero(whole)
    if not len(at):
        return out
    # exact keys: pairs are numbered anew, so that no product leaves 64 bits
    pair = ids[at] * len(number) + ids[at + 1]
    _, pair = np.unique(pair, return_inverse=True)
    triple = pair * len(number) + ids[at + 2]
    _, triple = np.unique(triple, return_inverse=True)
    key = triple * len(docs) + doc[at]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    hit = at[counts[inverse] > 1]
    mark = np.zeros(total, bool)
    for k in range(3):
        mark[hit + k] = True
    return np.bincount(doc[mark], minlength=len(docs))


def _base(text: bytes, words: list[bytes]) -> tuple[int, int, int]:
    chars = len(text.decode("utf-8", "replace")) - sum(text.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    marks = sum(text.count(bytes([c])) for c in _MARKS)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return chars, marks, len(lines) - len(set(lines))


def _blocks(found: list[bytes]) -> Iterator[list[bytes]]:
    block, size = [], 0
    for text in found:
        block.append(text)
        size += len(text)
        if size > CHUNK:
            yield block
            block, size = [], 0
    if block:
        yield block


def labelled(labels: DataFrame, toxic: bool = False) -> DataFrame:
    """All labelled documents: doc_id, good.

    Good are documents that no label calls low in quality or toxic; bad are those that
    some label calls low in quality. Others, and null ids, are left out; with ``toxic``
    those that are toxic and not low in quality are good too.
    """
    one = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    one = one.where("q in (0, 1)" if toxic else "q = 0 or (q = 1 and t = 0)")
    return one.select("doc_id", (F.col("q") == 1).alias("good"))


#: The name from when it was a sample.
labelled_sample = labelled


class Span(NamedTuple):
    """Neighbouring scores: the ends, how many documents they have, and the best cut between two of them.

    The cut has ``lost`` good and ``dropped`` bad documents of the span below it, and lies
    between the scores ``below`` and ``above``; a span of one score has none.
    """

    low: float
    high: float
    good: int
    bad: int
    lost: int | None = None
    dropped: int | None = None
    below: float | None = None
    above: float | None = None


def _rank(lost: int, dropped: int, below: float, above: float, n_good: int, n_bad: int) -> tuple[int, float, float]:
    """Orders cuts, the best first; exact, for shares are compared as whole numbers."""
    return lost * n_bad + (n_bad - dropped) * n_good, below - above, (below + above) / 2


def span(scores: Iterable[tuple[float, int, int]], n_good: int, n_bad: int) -> Span | None:
    """The span of rising ``scores`` (score, good, bad), read once.

    Documents of lower spans add the same to the errors of all its cuts, so the best is known without them.
    """
    low = high = best = None
    good = bad = 0
    for score, more_good, more_bad in scores:
        if high is None:
            low = score
        else:
            rank = _rank(good, bad, high, score, n_good, n_bad)
            if best is None or rank < best[0]:
                best = rank, (good, bad, high, score)
        good, bad, high = good + more_good, bad + more_bad, score
    return None if high is None else Span(low, high, good, bad, *(best[1] if best else ()))


def least_of_spans(spans: list[Span], n_good: int, n_bad: int) -> float:
    """The best cut inside or between ``spans``, which together hold each score once and do not overlap."""
    if not n_good or not n_bad:
        return float("-inf")
    best, lost, dropped, high = (n_good * n_bad, 0.0, float("-inf")), 0, 0, None
    for s in sorted(spans):
        if high is not None:
            best = min(best, _rank(lost, dropped, high, s.low, n_good, n_bad))
        if s.below is not None:
            best = min(best, _rank(lost + s.lost, dropped + s.dropped, s.below, s.above, n_good, n_bad))
        lost, dropped, high = lost + s.good, dropped + s.bad, s.high
    return best[2]


def least_errors(scores: list[tuple[float, int, int]]) -> float:
    """The threshold that errs least on ``scores`` (score, good, bad), which holds each score once.

    Errors are counted as shares of their class: good documents below it and bad ones
    at or above it. It lies midway between two scores; of equal cuts the widest gap
    wins, then the lowest. Keeping all is a cut too, and the only one without either kind.
    """
    n_good, n_bad = sum(g for _, g, _ in scores), sum(b for _, _, b in scores)
    return least_of_spans([s for s in [span(sorted(scores), n_good, n_bad)] if s], n_good, n_bad)


def threshold(judged: DataFrame) -> float:
    """:func:`least_errors` of all ``judged(score, good)``, over scores of nine digits.

    The scores are sorted by range over the tasks, and each task sends its :class:`Span`.
    """
    counted = judged.groupBy(F.round("score", 9).alias("score")).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    counted = stage(counted, "counted")
    n_good, n_bad = counted.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*[batch.column(c).to_pylist() for c in ("score", "good", "bad")], strict=True))
        if found := span(rows, n_good, n_bad):
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.float64() if k in (0, 1, 6, 7) else pa.int64()) for k, x in enumerate(found)], names=list(Span._fields))

    schema = "low double, high double, good long, bad long, lost long, dropped long, below double, above double"
    spans = map_batches(counted.repartitionByRange("score").sortWithinPartitions("score"), run, schema)
    return least_of_spans([Span(*r) for r in spans.collect()], n_good, n_bad)  # a row for each task


def quality(docs: DataFrame, labels: DataFrame, min_words: int = 50, max_repeated: int = 50) -> DataFrame:
    """Base rules and the log-likelihood ratio of every document.

    Words and pairs of words are hashed into ``BUCKETS``. The raw multinomial counts
    all documents, the trusted one all good documents of :func:`labelled`; both
    are smoothed by one. A document's score is the mean over its words and pairs of
    ln(trusted / raw). The threshold is fitted on all labelled documents that pass
    the base rules by :func:`least_errors` over scores of nine digits, where toxic
    documents of good quality count as good; without either kind there is none, and
    only the base rules decide. Two reads of the texts, the first of which moves them to
    their labels; per partition one histogram of fixed size leaves each task. Null texts
    have no words. Repeated rows are scored alike, a row each; an empty table gives an
    empty result; other columns are ignored. Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, score, text_hash, kept.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    # labels grow with the documents, so they are never broadcast; they are the side that is hashed
    good = labelled(labels).where("good").hint("shuffle_hash")
    marked = docs.select("doc_id", "text").join(good, "doc_id", "left").select("text", F.col("good").isNotNull().alias("trusted"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        for batch in slices(batches):
            for trusted, text in zip(batch.column("trusted").to_pylist(), utf8(batch.column("text")), strict=True):
                if words := text.split():
                    at, own = features(words), sums[int(trusted)]
                    if len(words) > BUCKETS // 8:
                        own += np.bincount(at, minlength=BUCKETS)
                    else:
                        np.add.at(own, at, 1)
        if sums.any():
            sums[0] += sums[1]
            cut = [(k, part, sums[k, part * SLICE : (part + 1) * SLICE].tobytes()) for k in (0, 1) for part in range(BUCKETS // SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*cut, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["trusted", "slice", "counts"])

    def add(frame):
        total = np.sum([np.frombuffer(x, np.int64) for x in frame["counts"]], axis=0)
        return frame.iloc[:1].assign(counts=[total.tobytes()])

    # slices of histograms are added 64 at a time, so that no task holds those of all partitions
    schema = "trusted int, slice int, counts binary, _k int"
    step = map_batches(marked, count, "trusted int, slice int, counts binary").withColumn("_k", F.spark_partition_id())
    for _ in range(3):
        step = step.withColumn("_k", F.floor(F.col("_k") / 64).cast("int")).groupBy("trusted", "slice", "_k").applyInPandas(add, schema)
    step = step.groupBy("trusted", "slice").applyInPandas(add, schema).orderBy("slice").collect()  # two histograms
    sums = {k: np.concatenate([np.frombuffer(r.counts, np.int64) for r in step if r.trusted == k]) for k in {r.trusted for r in step}}
    zero = np.zeros(BUCKETS, np.int64)
    trusted, raw = sums.get(1, zero), sums.get(0, zero)
    ratio = spark.sparkContext.broadcast(np.log((trusted + 1) / (trusted.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, hashes, found = batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), utf8(batch.column("text"))
            at = 0
            for block in _blocks(found):
                split = [t.split() for t in block]
                repeats = repeated_words(split)
                rows = []
                for text, words, rep in zip(block, split, repeats.tolist(), strict=True):
                    n = len(words)
                    failed = n < min_words or 100 * rep > max_repeated * n
                    mean = float(ratio.value[features(words)].mean()) if n else 0.0
                    rows.append((ids[at], n, *_base(text, words), rep, failed, mean, hashes[at]))
                    at += 1
                types = [pa.int64()] * 6 + [pa.bool_(), pa.float64(), pa.int64()]
                names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "text_hash"]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, text_hash long"
    scored = stage(map_batches(texts, score, schema), "scores")
    cut = threshold(scored.where("not base_failed").join(labelled(labels, toxic=True), "doc_id"))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(cut)))
