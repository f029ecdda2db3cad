"""Packing of documents into sequences by minimum bin slack (operator 12).

A document's whole windows are sequences of their own; what is left of it is one piece
shorter than a window. How many pieces there are of each length, at most ``WINDOW``
numbers whatever the corpus, decides everything: a window is planned by a bitset
subset-sum dynamic programme over the lengths left (so many of each as there are), which
finds the multiset closest to the window, and is repeated as often as the counts allow.
If even the closest leaves slack, one more piece is cut to fill it, and its rest goes back
to the lengths left. The tail of the corpus, shorter than a window, goes in the same way to
windows of ever smaller powers of two, which need no padding.

Each piece then finds its place in the plan by its rank among pieces of its length.
"""

from __future__ import annotations

import bisect
import dataclasses
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, stage, texts
from .tokens import BytePairEncoder, once, path_of

WINDOW = 2048
#: Pieces of texts whose ids a worker remembers; fewer than elsewhere, for the documents' ids are written from the same task.
PIECES = 250_000


def closest(counts: dict[int, int], window: int) -> tuple[int, Counter]:
    """The largest sum up to ``window`` of a multiset within ``counts``, and that multiset; longer pieces first.

    Bit s of a bitset says that sum s can be had. ``counts`` of a length are taken in
    parts of 1, 2, 4 ... pieces, so each part is one shift, and the search ends once the
    window is full. Going back through the bitsets gives the parts of the best sum.
    """
    reach, steps, mask, full = 1, [], (1 << window + 1) - 1, 1 << window
    for length in sorted(counts, reverse=True):
        left = min(counts[length], window // length)
        part = 1
        while left > 0 and not reach & full:
            part = min(part, left)
            steps.append((reach, length, part))
            reach |= reach << length * part & mask
            left, part = left - part, part * 2
        if reach & full:
            break
    best = reach.bit_length() - 1
    taken, at = Counter(), best
    for before, length, part in reversed(steps):
        if not before >> at & 1:
            taken[length] += part
            at -= length * part
    return best, taken


@dataclasses.dataclass
class Plan:
    """Where the n-th piece of each length goes.

    ``starts[length]`` are the ranks at which a run of pieces of that length begins to
    be used alike; the run of the same place in ``runs`` says how: (first sequence, pieces in
    a sequence, offset of the first, tokens before a cut or 0, first rank of the rests).
    ``sequences`` is the number of planned sequences.
    """

    starts: dict[int, list[int]]
    runs: dict[int, list[tuple[int, int, int, int, int]]]
    sequences: int

    def places(self, length: int, rank: int) -> Iterator[tuple[int, int, int]]:
        """(length, sequence, offset) of each part of a piece, in its order."""
        while True:
            i = bisect.bisect_right(self.starts[length], rank) - 1
            first, each, offset, cut, rests = self.runs[length][i]
            copy, slot = divmod(rank - self.starts[length][i], each)
            if not cut:
                yield length, first + copy, offset + slot * length
                return
            yield cut, first + copy, offset
            length, rank = length - cut, rests + copy


def plan(histogram: dict[int, int], window: int = WINDOW) -> Plan:
    """Sequences for ``histogram[length]`` pieces, each shorter than ``window``."""
    left = {length: n for length, n in histogram.items() if n > 0}
    used, made = Counter(), Counter(left)
    starts, runs, sequences = {}, {}, 0

    def use(length: int, pieces: int, run: tuple[int, int, int, int, int]) -> None:
        starts.setdefault(length, []).append(used[length])
        runs.setdefault(length, []).append(run)
        used[length] += pieces
        left[length] -= pieces
        if not left[length]:
            del left[length]

    total = sum(length * n for length, n in left.items())
    while left:
        room = window if total >= window else 1 << total.bit_length() - 1
        filled, taken = closest(left, room)
        repeats = min([left[length] // n for length, n in taken.items()], default=total)
        cut = 0
        if filled < room:  # any piece that is still left is longer than the slack
            cut = max(length for length, n in left.items() if n > taken[length])
            repeats = min(repeats, left[cut] // (taken[cut] + 1))
        repeats = max(1, min(repeats, total // room))
        offset = 0
        for length, n in sorted(taken.items(), reverse=True):
            use(length, n * repeats, (sequences, n, offset, 0, 0))
            offset += n * length
        if cut:
            rest = cut - (room - filled)
            use(cut, repeats, (sequences, 1, offset, room - filled, made[rest]))
            left[rest] = left.get(rest, 0) + repeats
            made[rest] += repeats
        sequences += repeats
        total -= repeats * room
    return Plan(starts, runs, sequences)


def encoded(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """Ids of ``docs(doc_id, text)`` with their end id, and each document's number among those of its task.

    ``rest`` is what its whole windows leave, ``nth`` its number among documents of the same
    rest in the task, ``full`` the task's whole windows before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once(("encoder", tokenizer, PIECES), lambda: BytePairEncoder(tokenizer, PIECES))
        last, task, seen, full = np.array([end], encoder.dtype).tobytes(), TaskContext.get().partitionId(), Counter(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                ids = [encoder.encode(text) + last for text in texts(batch.column("text"))]
                sizes = [len(x) // encoder.dtype.itemsize for x in ids]
                nth, fulls = [], []
                for n in sizes:
                    nth.append(seen[n % WINDOW])
                    fulls.append(full)
                    seen[n % WINDOW] += 1
                    full += n // WINDOW
                longs = lambda v: pa.array(v, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), longs(sizes), pa.array(ids, pa.binary()), pa.array([task] * len(ids), pa.int32()), pa.array([n % WINDOW for n in sizes], pa.int32()), longs(nth), longs(fulls)],
                    names=["doc_id", "doc_tokens", "ids", "task", "rest", "nth", "full"],
                )

    schema = T.StructType([docs.schema["doc_id"]])
    for name, kind in (("doc_tokens", T.LongType()), ("ids", T.BinaryType()), ("task", T.IntegerType()), ("rest", T.IntegerType()), ("nth", T.LongType()), ("full", T.LongType())):
        schema = schema.add(T.StructField(name, kind))
    return map_batches(docs.select("doc_id", "text"), run, schema)


def pack(docs: DataFrame, tokenizer: str | None = None, end: int = 1) -> DataFrame:
    """Pack ``docs(doc_id, text)`` into sequences of ``WINDOW`` tokens, or of a smaller power of two for the last ones.

    Returns a row for each piece: doc_id, start (ids of its document before it), length,
    ids (little-endian integers of the tokenizer's width), doc_tokens, sequence_id (gapless
    from 0) and offset in the sequence. Every sequence is full, so nothing is padded;
    a document is cut only at whole windows and where no multiset of pieces
    fills a window. A null text is empty; ``end`` ends each document, so an empty one is one
    token. Rows that repeat, or share or lack a doc_id, are documents of their own. An
    empty table gives an empty result. Other columns are ignored.

    The driver plans from at most ``WINDOW`` counts; tasks get the plan, which is as bounded.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or path_of("byte_bpe_50k.json")
    made = stage(encoded(docs, tokenizer, end), "encoded")
    counts = stage(made.groupBy("task", "rest").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("full") + F.floor(F.col("doc_tokens") / WINDOW)).alias("upto")), "counts")
    histogram = {r.rest: r.n for r in counts.groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    histogram.pop(0, None)
    planned = plan(histogram)
    # ranks and whole windows of the tasks before
    before = counts.withColumn("first", F.sum("n").over(Window.partitionBy("rest").orderBy("task")) - F.col("n")).select("task", "rest", "first")
    tasks = counts.groupBy("task").agg(F.max("upto").alias("windows"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("task")
    tasks = tasks.withColumn("full_first", F.sum("windows").over(earlier) - F.col("windows")).select("task", "full_first")
    # the ranks grow with the tasks, so they are never broadcast; they are the side that is hashed
    located = made.join(before.join(tasks, "task").hint("shuffle_hash"), ["task", "rest"])
    width = once(("encoder", tokenizer), lambda: BytePairEncoder(tokenizer)).dtype.itemsize

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []

        def flush() -> pa.RecordBatch:
            at, *columns = zip(*out, strict=True)
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            names = ["start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            out.clear()
            return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), *arrays], names=["doc_id", *names])

        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in ("doc_tokens", "rest", "nth", "full", "first", "full_first")], strict=True)
            for i, (n, rest, nth, full, first, full_first) in enumerate(rows):
                ids = batch.column("ids")[i].as_py()
                for k in range(n // WINDOW):
                    start = k * WINDOW
                    out.append((i, start, WINDOW, ids[start * width : (start + WINDOW) * width], n, planned.sequences + full_first + full + k, 0))
                    if len(out) >= 1024:
                        yield flush()
                start = n - rest
                for length, sequence, offset in planned.places(rest, first + nth) if rest else ():
                    out.append((i, start, length, ids[start * width : (start + length) * width], n, sequence, offset))
                    start += length
                if len(out) >= 1024:
                    yield flush()
            if out:
                yield flush()

    schema = T.StructType([docs.schema["doc_id"]])
    for name, kind in (("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())):
        schema = schema.add(T.StructField(name, kind))
    return map_batches(located, place, schema)


def checksums(pieces: DataFrame, width: int = 2) -> DataFrame:
    """Pieces with the crc32 of their ids as 32-bit integers in place of the ids."""
    kind = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            crc = [zlib.crc32(np.frombuffer(b.as_buffer(), kind).astype("<u4").tobytes()) for b in batch.column("ids")]
            names = [*batch.schema.names[:at], "ids_crc32", *batch.schema.names[at + 1 :]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(crc, pa.int64()), *batch.columns[at + 1 :]], names=names)

    schema = T.StructType([T.StructField("ids_crc32", T.LongType()) if f.name == "ids" else f for f in pieces.schema])
    return map_batches(pieces, run, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, ids, and the documents' starts in it, each a window at most."""
    held = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id", "length")))
    grouped = pieces.groupBy("sequence_id").agg(held.alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return grouped.select("sequence_id", joined.alias("ids"), F.transform("p", lambda x: F.struct(x["doc_id"], x["offset"], x["length"])).alias("pieces"))
