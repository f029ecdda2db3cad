"""SimHash near-duplicates through Golay-code fuzzy hashing (operator 7)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, map_batches, stage, utf8

#: Lengths of the three segments of a fingerprint, from the low bits; each is padded to 23 bits.
SEGMENTS = (22, 21, 21)
GENERATOR = 0b101011100011
#: Members of a key that are compared with each other; larger keys take the exact way through shared neighbours.
PAIRWISE = 64


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of all bytes at each of three places, and the error pattern of each syndrome.

    The binary Golay code [23, 12, 7] is perfect: each of the 2048 syndromes belongs
    to exactly one error pattern of at most three bits.
    """

    def syndrome(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    bits = [syndrome(1 << b) for b in range(23)]
    bytes_ = np.zeros((3, 256), np.int64)
    for place in range(3):
        for value in range(256):
            for b in range(8):
                if value >> b & 1 and 8 * place + b < 23:
                    bytes_[place, value] ^= bits[8 * place + b]
    errors = np.zeros(2048, np.int64)
    for n in (1, 2, 3):
        for places in combinations(range(23), n):
            s = e = 0
            for p in places:
                s, e = s ^ bits[p], e | 1 << p
            errors[s] = e
    return bytes_, errors


def decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    by, errors = _tables()
    s = by[0][words & 255] ^ by[1][words >> 8 & 255] ^ by[2][words >> 16 & 127]
    return (words ^ errors[s]) >> 11


def nearby(words: np.ndarray) -> np.ndarray:
    """Indices of the codewords nearest to each word and to its 23 neighbours: at most 6 different."""
    flips = np.array([0, *(1 << b for b in range(23))], np.int64)
    found = np.sort(decode(words[:, None] ^ flips[None, :]), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


def digests(words: list[bytes], shingle: int) -> Iterator[bytes]:
    """The xxHash64 digests of all word shingles, repeats included, in pieces; fewer words are one shingle."""
    if not words:
        return
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    n = max(1, len(words) - shingle + 1)
    stops = np.cumsum(lengths)
    starts = (stops - lengths)[:n].tolist()
    ends = (stops - 1)[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_digest
    for at in range(0, n, 1 << 14):
        yield b"".join([digest(joined[a:b], 42) for a, b in zip(starts[at : at + (1 << 14)], ends[at : at + (1 << 14)], strict=True)])


def folded(pieces: Iterable[bytes]) -> int:
    """The 64-bit SimHash of some digests; 0 without any."""
    n, ones = 0, np.zeros(64, np.int64)
    for raw in pieces:
        n += len(raw) // 8
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    return folded(digests(text.lower().split(), shingle))  # both touch ASCII only


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``docs(doc_id, text)`` to doc_id, text_hash and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in utf8(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(found)], names=["doc_id", "text_hash", "fp"])

    return map_batches(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), run, "doc_id long, text_hash long, fp long")


def golay_keys(points: DataFrame) -> DataFrame:
    """Keys of each fingerprint: fp, key, own.

    With two differing bits over three segments, some segment is equal and the next
    one (in a circle) differs in one bit at most. So a key is a segment with the
    Golay index of the next: ``own`` is the index nearest to the word itself, the
    others, six in all at most, are nearest to its neighbours. Of two words one bit
    apart, each has the other's own index among its keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(fps), 1 << 16):
                fp = fps[at : at + (1 << 16)]
                parts, low = [], 0
                for width in SEGMENTS:
                    parts.append((fp.view(np.uint64) >> np.uint64(low)).view(np.int64) & ((1 << width) - 1))
                    low += width
                for k in range(3):
                    exact, word = parts[k], parts[(k + 1) % 3]
                    head = (k << 60) | (exact << 12)
                    near, own = nearby(word), decode(word)
                    row, col = np.nonzero(near >= 0)
                    index = near[row, col]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(fp[row]), pa.array(head[row] | index), pa.array(index == own[row])], names=["fp", "key", "own"]
                    )

    return map_batches(points.select("fp"), run, "fp long, key long, own boolean")


def links(points: DataFrame, pairwise: int = PAIRWISE) -> DataFrame:
    """Edges (a, b) that connect all fingerprints with two or fewer differing bits.

    Keys with up to ``pairwise`` members are joined and verified bit by bit. Members of
    larger keys take an exact way whose rows grow with the members alone: two
    fingerprints differ in two bits or fewer just if some word differs from each in
    one bit or fewer, so each member goes to its 65 such words, and all that meet at a
    word are tied to the smallest. No pair is lost, and none within a large group is
    listed.
    """
    keys = stage(golay_keys(points), "keys")
    crowds = stage(keys.where("own").groupBy("key").count().where(F.col("count") > pairwise).select("key"), "crowds")
    if crowds.isEmpty():
        few, many = keys, None
    else:
        few = keys.join(crowds, "key", "left_anti")
        many = stage(keys.join(crowds, "key").select("fp").distinct(), "many")
    a = few.select("key", F.col("fp").alias("a"))
    b = few.where("own").select("key", F.col("fp").alias("b"))
    edges = a.join(b, "key").where("a < b and bit_count(a ^ b) <= 2").select("a", "b").distinct()
    if many is not None:
        flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)])
        words = many.select("fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("word"))
        first = words.groupBy("word").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select("word", "a")
        edges = edges.union(words.join(first, "word").select("a", F.col("fp").alias("b")).where("a < b").distinct())
    return edges


def _grouped(docs: DataFrame, shingle: int) -> DataFrame:
    """Every row's doc_id, text_hash, fp, root (the component's smallest fingerprint) and component_id."""
    rows = stage(fingerprints(docs, shingle), "fingerprints")
    points = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    roots = connected_components(links(points))
    joined = points.join(roots, points.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = stage(joined.join(least, "root").select("fp", "root", "component_id"), "labels")
    return rows.join(labels, "fp")


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Components of documents whose fingerprints differ in two or fewer bits.

    Equal fingerprints are one point first, so copies never meet in pairs. A text
    without words has fingerprint zero and is linked like any other; a null text has
    none. ``component_id`` is the smallest doc_id that can be reached; documents of a
    null id take part, and a component of nothing else has a null id. Repeated rows
    are returned each. An empty table gives an empty result. Returns doc_id,
    fingerprint (16 hex digits), component_id; other columns are ignored.
    """
    return _grouped(docs, shingle).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
