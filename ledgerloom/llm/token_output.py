"""Token ids in files of independent zstandard frames with a seek table (operator 1).

File layout, all integers little-endian:

* data frames: each a complete zstandard frame over whole ids, about ``FRAME``
  bytes before compression; a document that is longer spans several frames;
* one skippable frame (magic 0x184D2A50) with the document index: the length of a
  JSON header (u32), the header, doc_ids (i64 each), null marks (u8 each) and
  numbers of ids (i64 each);
* one skippable frame (magic 0x184D2A5E) with the seek table of the published
  seekable format: compressed size, decompressed size and the low 32 bits of the
  content's XXH64 for each frame, then the number of frames, a descriptor with the
  checksum flag, and 0x8F92EAB1.

A reader takes the tail, then only the frames of the documents that it wants, and
checks each frame's checksum.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, shared_dir, stage, texts
from .tokens import BytePairEncoder, once, path_of

FRAME = 1 << 18
LEVEL = 3
_SKIP, _INDEX, _SEEK, _TABLE = struct.Struct("<II"), 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_ENTRY, _FOOT = struct.Struct("<III"), struct.Struct("<IBI")


class ShardWriter:
    """Writes one shard beside its final name and moves it there when it is whole."""

    def __init__(self, uri: str, dtype: np.dtype, eos: int):
        self.fs, self.path = pyarrow.fs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.part)
        self.dtype, self.eos, self.zstd = dtype, eos, zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.held, self.size, self.frames = [], 0, []
        self.doc_ids, self.nulls, self.counts = [], [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.counts.append(len(ids) // self.dtype.itemsize)
        for at in range(0, len(ids), FRAME):
            self.held.append(ids[at : at + FRAME])
            self.size += len(self.held[-1])
            if self.size >= FRAME:
                self._flush()

    def _flush(self) -> None:
        if not self.size:
            return
        raw = b"".join(self.held)
        packed = self.zstd.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> tuple[int, int]:
        """Finish the file: its documents and ids."""
        self._flush()
        head = json.dumps({"dtype": self.dtype.str, "eos": self.eos, "documents": len(self.counts)}).encode()
        counts = np.array(self.counts, "<i8")
        body = struct.pack("<I", len(head)) + head + np.array(self.doc_ids, "<i8").tobytes() + np.array(self.nulls, "u1").tobytes() + counts.tobytes()
        self.out.write(_SKIP.pack(_INDEX, len(body)) + body)
        table = b"".join(_ENTRY.pack(*f) for f in self.frames) + _FOOT.pack(len(self.frames), 0x80, _TABLE)
        self.out.write(_SKIP.pack(_SEEK, len(table)) + table)
        self.out.close()
        self.fs.move(self.part, self.path)
        return len(self.counts), int(counts.sum())


class ShardReader:
    """Random access to the documents of one shard."""

    def __init__(self, uri: str):
        self.fs, self.path = pyarrow.fs.FileSystem.from_uri(uri)
        self.file = self.fs.open_input_file(self.path)
        end = self.file.size()
        n, flags, magic = _FOOT.unpack(self.file.read_at(_FOOT.size, end - _FOOT.size))
        if magic != _TABLE or not flags & 0x80:
            raise ValueError(f"{uri}: no seek table with checksums")
        at = end - _FOOT.size - n * _ENTRY.size
        self.frames = list(_ENTRY.iter_unpack(self.file.read_at(n * _ENTRY.size, at)))
        if _SKIP.unpack(self.file.read_at(_SKIP.size, at - _SKIP.size)) != (_SEEK, end - at):
            raise ValueError(f"{uri}: damaged seek table")
        self.offsets = np.cumsum([0, *(f[0] for f in self.frames)])
        self.starts = np.cumsum([0, *(f[1] for f in self.frames)])
        size = at - _SKIP.size - int(self.offsets[-1]) - _SKIP.size
        body = self.file.read_at(size, int(self.offsets[-1]) + _SKIP.size)
        (k,) = struct.unpack_from("<I", body)
        self.head = json.loads(body[4 : 4 + k])
        m, at = self.head["documents"], 4 + k
        self.dtype = np.dtype(self.head["dtype"])
        ids = np.frombuffer(body, "<i8", m, at)
        nulls = np.frombuffer(body, "u1", m, at + 8 * m)
        self.doc_ids = [None if z else int(x) for x, z in zip(ids, nulls, strict=True)]
        self.counts = np.frombuffer(body, "<i8", m, at + 9 * m)
        self.firsts = np.cumsum(self.counts) - self.counts

    def frame(self, k: int) -> bytes:
        packed, _, check = self.frames[k]
        raw = zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, int(self.offsets[k])))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"{self.path}: frame {k} is damaged")
        return raw

    def read(self, i: int) -> np.ndarray:
        """Ids of the i-th document; only its frames are decompressed."""
        a, b = (int(x) * self.dtype.itemsize for x in (self.firsts[i], self.firsts[i] + self.counts[i]))
        if a == b:
            return np.empty(0, self.dtype)
        k = int(np.searchsorted(self.starts, a, "right")) - 1
        raw, base = [], int(self.starts[k])
        while self.starts[k] < b:
            raw.append(self.frame(k))
            k += 1
        return np.frombuffer(b"".join(raw)[a - base : b - base], self.dtype)

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, first id's place in the shard and ids, in order, a frame at a time."""
        held, k = b"", 0
        for doc_id, first, n in zip(self.doc_ids, self.firsts, self.counts, strict=True):
            need, parts, size = int(n) * self.dtype.itemsize, [held], len(held)
            while size < need:
                parts.append(self.frame(k))
                size += len(parts[-1])
                k += 1
            held = b"".join(parts)
            yield doc_id, int(first), np.frombuffer(held[:need], self.dtype)
            held = held[need:]


def write_token_shards(docs: DataFrame, out: str, tokenizer: str, eos: int = 0) -> DataFrame:
    """Encode ``docs(doc_id, text)`` into shards below ``out``; one row per shard.

    Documents are dealt by range over (doc_id, hash of the text), so equal ids with
    different texts may part, and sorted in each range; shard numbers follow doc_id,
    nulls first. A null text is empty; ``eos`` ends each document. Rows that repeat
    are written again. An empty table gives no shard. Other columns are ignored.
    A task that runs again writes the same bytes and moves them over the same name.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"))
    ordered = rows.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once(("encoder", tokenizer), lambda: BytePairEncoder(tokenizer))
        end, writer, shard = np.array([eos], encoder.dtype).tobytes(), None, TaskContext.get().partitionId()
        uri = f"{out}/shard-{shard:07d}.tok.zst"
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")), strict=True):
                writer = writer or ShardWriter(uri, encoder.dtype, eos)
                writer.add(doc_id, encoder.encode(text) + end)
        if writer:
            n, ids = writer.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "path": [uri], "n_docs": pa.array([n], pa.int64()), "n_ids": pa.array([ids], pa.int64())})

    return map_batches(ordered, write, "shard long, path string, n_docs long, n_ids long")


def read_token_shards(shards: DataFrame) -> DataFrame:
    """Read shards back: doc_id, start, n_tokens and the checksum of each document's ids.

    ``shards`` has shard, path and start (ids in all shards before). One task reads
    one file, a frame at a time.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                found = [(doc_id, base + first, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for doc_id, first, ids in ShardReader(path)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*found, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, shards.count())
    return map_batches(shards.select("path", "start").repartitionByRange(n, "path"), read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str | None = None, out: str | None = None) -> DataFrame:
    """Write ``docs`` as token shards and describe every document from the files.

    Returns doc_id, start, n_tokens (with the end id) and ids_crc32. The manifest,
    one row for each file, is written beside the shards; running starts are summed
    over it, never over documents.
    """
    spark = docs.sparkSession
    out = out or f"{shared_dir(spark)}/tokens"
    made = stage(write_token_shards(docs, out, tokenizer or path_of("byte_bpe_50k.json")), "manifest")
    starts, total = [], 0
    for r in made.orderBy("shard").toLocalIterator():
        starts.append((r.path, total))
        total += r.n_ids
    return read_token_shards(spark.createDataFrame(starts, "path string, start long"))
