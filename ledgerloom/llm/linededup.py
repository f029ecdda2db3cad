"""Line deduplication with two Bloom filters (operator 8)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stage, utf8

HASHES = 4
CHUNK = 1 << 16  # bytes of a filter that one row carries
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28  # 32 MB a filter at most
BITS_A_DOCUMENT = 256
#: Shares of the suspects that are joined by broadcast: no more keys than this can have one.
HOT = 10_000
_WHITE = b" \t\n\x0b\x0c\r"
#: Stands for a null doc_id: all such rows are one document, the first.
NO_ID = -(1 << 63)


def line_key(line: bytes) -> bytes:
    return line.strip(_WHITE).lower()


def long_enough(key: bytes, least: int) -> bool:
    """Whether a key has ``least`` code points or more."""
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def keys_of(text: bytes, least: int) -> set[bytes]:
    return {k for k in map(line_key, text.split(b"\n")) if long_enough(k, least)}


class Filter:
    """Bits set by ``HASHES`` probes of a 64-bit hash."""

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.mask = np.uint64(bits - 1)
        self.data = np.zeros(bits // 8, np.uint8) if data is None else data

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        return (hashes[:, None] + np.arange(HASHES, dtype=np.uint64)[None, :] * step[:, None]) & self.mask

    def add(self, hashes: np.ndarray) -> None:
        at = self._places(hashes).ravel()
        np.bitwise_or.at(self.data, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = self._places(hashes)
        return ((self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def hashed(keys) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))


def repeated_filter(docs: DataFrame, bits: int, least: int) -> bytes:
    """The filter of hashes seen in two documents or more.

    Each task sets two filters: a document's hash that the first has already goes to
    the second. Filters of tasks are joined in chunks, spread over tasks: what two
    first filters share goes to the second, so nothing that repeats is missed. A
    filter has ``bits`` bits, at most ``MOST_BITS``, whatever the input; a fuller
    filter only suspects more lines, which the exact step clears.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = Filter(bits), Filter(bits)
        for batch in batches:
            found = [h for h in (hashed(keys_of(t, least)) for t in utf8(batch.column("text"))) if len(h)]
            if not found:
                continue
            own, n = np.unique(np.concatenate(found), return_counts=True)
            again = own[(n > 1) | once.has(own)]
            if len(again):
                twice.add(again)
            once.add(own)
        for k in range(0, bits // 8, CHUNK):
            a, b = once.data[k : k + CHUNK], twice.data[k : k + CHUNK]
            if a.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([a.tobytes()]), pa.array([b.tobytes()])], names=["at", "once", "twice"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = None, None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([once.tobytes()]), pa.array([twice.tobytes()])], names=["at", "once", "twice"])

        for batch in batches:
            for k, a, b in zip(*(batch.column(c) for c in ("at", "once", "twice")), strict=True):
                a, b = np.frombuffer(a.as_buffer(), np.uint8), np.frombuffer(b.as_buffer(), np.uint8)
                if k.as_py() != at:
                    if at is not None:
                        yield out()
                    at, once, twice = k.as_py(), a.copy(), b.copy()
                else:
                    twice |= b | (once & a)
                    once |= a
        if at is not None:
            yield out()

    schema = "at long, once binary, twice binary"
    parts = map_batches(docs.select("text"), fill, schema)
    whole = map_batches(parts.repartition("at").sortWithinPartitions("at"), join, schema)
    data = np.zeros(bits // 8, np.uint8)
    for r in whole.select("at", "twice").collect():  # one filter, of a size that is bounded
        data[r["at"] : r["at"] + CHUNK] = np.frombuffer(r["twice"], np.uint8)
    return data.tobytes()


def line_dedup(docs: DataFrame, least: int = 10, bits: int | None = None) -> DataFrame:
    """Drop lines that an earlier document holds.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased.
    Keys of ``least`` code points or more that two documents hold lose all their
    lines except in the document of the smallest doc_id. Only lines that the second
    filter suspects are shuffled, as SHA-256 of the key with the doc_id; smallest and
    largest doc_id are found with map-side sums, so a line that all documents share is
    one row a task; keys that make up 1 / ``HOT`` of the suspects, so at most ``HOT`` of
    them, then find their documents by broadcast, others by a join. Null and empty
    texts are one empty line. Rows of equal doc_id are one document; null ids are one
    document, before all others, which loses no line and so stays out of the joins. Repeated rows are
    returned each; an empty table gives an empty result. Returns doc_id, kept_text,
    n_lines, n_dropped.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    if bits is None:
        bits = 1 << min(max(rows.count() * BITS_A_DOCUMENT, LEAST_BITS) - 1, MOST_BITS - 1).bit_length()
    seen = spark.sparkContext.broadcast(repeated_filter(rows, bits, least))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = Filter(bits, np.frombuffer(seen.value, np.uint8))
        for batch in batches:
            ids, digests = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
                keys = list(keys_of(text, least))
                if keys:
                    hit = [k for k, s in zip(keys, twice.has(hashed(keys)).tolist(), strict=True) if s]
                    digests += [hashlib.sha256(k).digest() for k in hit]
                    ids += [NO_ID if doc_id is None else doc_id] * len(hit)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary())], names=["_id", "digest"])

    found = stage(map_batches(rows, suspects, "_id long, digest binary"), "suspects")
    owners = found.groupBy("digest").agg(F.min("_id").alias("owner"), F.max("_id").alias("last"), F.count("*").alias("n")).where("owner < last").select("digest", "owner", "n")
    owners = stage(owners, "owners")
    hot = F.col("n") >= max(1, found.count() // HOT)
    some = found.where(F.col("_id") != NO_ID)
    often = F.broadcast(owners.where(hot).select("digest", "owner"))
    drops = some.join(often, "digest").unionByName(some.join(often, "digest", "left_anti").join(owners.where(~hot).select("digest", "owner"), "digest"))
    drops = drops.where("_id > owner").groupBy("_id").agg(F.collect_set("digest").alias("_drops"))
    marked = rows.where("doc_id is not null").join(drops, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "_drops")
    marked = marked.unionByName(rows.where("doc_id is null").withColumn("_drops", F.lit(None).cast("array<binary>")))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, drop in zip(utf8(batch.column("text")), batch.column("_drops").to_pylist(), strict=True):
                lines = text.split(b"\n")
                kept = lines
                if drop:
                    drop = set(drop)
                    kept = [x for x in lines if not (long_enough(k := line_key(x), least) and hashlib.sha256(k).digest() in drop)]
                out.append((b"\n".join(kept), len(lines), len(lines) - len(kept)))
            kept, n, gone = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())],
                names=["doc_id", "kept_text", "n_lines", "n_dropped"],
            )

    return map_batches(marked, rewrite, "doc_id long, kept_text string, n_lines long, n_dropped long")
