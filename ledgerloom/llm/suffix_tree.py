"""Language-model scores from a probabilistic suffix tree over words (operator 9).

The tree's symbols are words and an end. Its contexts are the last words of a text,
none to ``DEPTH`` of them; the root is the smoothed unigram. A longer context is
retained where the distribution of the next word diverges enough from that after its
suffix, and is smoothed towards it. The longest retained suffix scores each token.

Documents are cut into chunks, which are stored as packed arrays. For each depth, a
chunk sends its different n-grams once, in sorted blocks, to the bucket of their
context; the bucket sums the blocks of all chunks, tests the contexts, and answers
each block in the order of its n-grams. Contexts that are hotter than a quarter of one are
dealt by n-gram instead, and their sums are added by a grouping. So the tree lies
spread over the buckets, as large as the corpus makes it, and nothing but the
statistics of hot contexts (at most four for each bucket) reaches the driver.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stage, utf8
from .tokens import Memo, once

#: Words of the longest context.
DEPTH = 2
#: A context occurs so often in training, and its next words diverge from those of its suffix by so many nats a word, and in all.
LEAST, DIVERGENCE, EVIDENCE = 2, 0.005, 12.0
#: Weight of the suffix's distribution for each different next word of a context.
PRIOR = 2.0
#: What is added to each word's count in the root.
ROOT = 0.1
#: The divergence test reads log probabilities of the suffix in units of 1 / STEPS nats.
STEPS = 256
#: Bytes of text in a chunk, but for its last document; tokens for which there is a bucket.
CHUNK, TOKENS_A_BUCKET = 6 << 20, 1 << 20
#: Words whose hashes a worker remembers in a generation.
REMEMBERED = 50_000
FEWEST_BITS, MOST_BITS = 6, 17

#: Keys have 56 bits: of the context and of the n-gram 30 and 26, and 24 and 32 if the context is hot; the bucket tells more bits apart.
_PLAIN, _HOT = (np.uint64(34), np.uint64(26)), (np.uint64(40), np.uint64(32))


def _symbol(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


#: The end of a text and what stands before it; no word holds a line feed.
END, START = _symbol(b"\n"), _symbol(b"\n\n")


def pair(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each (context, word)."""
    x = context * np.uint64(0x9E3779B97F4A7C15)
    x = ((x ^ (x >> np.uint64(32))) + word) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def _starts() -> list[np.ndarray]:
    """The context of a text's first word, by depth."""
    one = np.array([START], np.uint64)
    out = [one]
    for _ in range(1, DEPTH):
        out.append(pair(out[-1], one))
    return out


def held_out(doc_id: int | None) -> bool:
    """Whether a document is kept from training, by the crc32 of its doc_id (null: empty)."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


_HEAD = struct.Struct("<3sQQ")


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed planes of bytes."""
    out = []
    for x in arrays:
        planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T)
        body = zstandard.compress(planes.tobytes(), 1)
        out += [_HEAD.pack(x.dtype.str.encode(), len(x), len(body)), body]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, n, size = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        dtype = np.dtype(kind.decode())
        planes = np.frombuffer(zstandard.decompress(data[at : at + size]) if n else b"", np.uint8).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype))
        at += size
    return out


def _deltas(keys: np.ndarray) -> np.ndarray:
    return np.concatenate((keys[:1], np.diff(keys)))


def _undeltas(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=np.uint64)


def _small(x: np.ndarray) -> np.ndarray:
    """Counts in the smallest unsigned type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


@dataclass
class Chunk:
    """Some documents: ids, which train, numbers of tokens, different words and the tokens as places in these."""

    ids: list
    train: np.ndarray
    lengths: np.ndarray
    vocabulary: np.ndarray
    tokens: np.ndarray

    @staticmethod
    def of(ids: list, texts: list[bytes]) -> Chunk:
        symbol = once("suffix-tree-words", lambda: Memo(_symbol, REMEMBERED))
        found, lengths = [], []
        for text in texts:
            words = text.lower().split()
            found += map(symbol.__getitem__, words)
            found.append(END)
            lengths.append(len(words) + 1)
        vocabulary, tokens = np.unique(np.array(found, np.uint64), return_inverse=True)
        return Chunk(ids, np.array([not held_out(i) for i in ids], bool), np.array(lengths, np.int64), vocabulary, tokens)

    def packed(self) -> bytes:
        nulls = np.array([i is None for i in self.ids], bool)
        ids = np.array([i or 0 for i in self.ids], np.int64)
        return pack(ids, nulls, self.train, self.lengths, _deltas(self.vocabulary), self.tokens.astype(np.uint32))

    @staticmethod
    def unpacked(data: bytes) -> Chunk:
        ids, nulls, train, lengths, steps, tokens = unpack(data)
        return Chunk([None if z else i for i, z in zip(ids.tolist(), nulls.tolist(), strict=True)], train, lengths, _undeltas(steps), tokens.astype(np.int32))


@dataclass
class Model:
    """Sums of the whole corpus: training tokens and documents, different words, and hot contexts by depth."""

    tokens: int
    docs: int
    bits: int
    words: int = 0
    hot: dict[int, tuple] = field(default_factory=dict)

    @property
    def hot_at(self) -> float:
        """A context that occurs so often is more than a quarter of a bucket's share."""
        return max(LEAST, self.tokens / (4 << self.bits))

    @property
    def floor(self) -> float:
        return self.tokens + ROOT * (self.words + 1)


@dataclass
class Slots:
    """The different n-grams of a chunk at one depth, by (bucket, hot, key), and the places where they occur."""

    places: np.ndarray
    slot: np.ndarray
    bucket: np.ndarray
    hot: np.ndarray
    key: np.ndarray
    counts: np.ndarray
    nats: np.ndarray

    def cuts(self, bits: int) -> np.ndarray:
        return np.searchsorted(self.bucket, np.arange((1 << bits) + 1))

    def blocks(self, bits: int) -> Iterator[tuple[int, bytes]]:
        cuts = self.cuts(bits)
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            own = slice(cuts[b], cuts[b + 1])
            hot, key = self.hot[own], self.key[own]
            yield b, pack(_deltas(key[~hot]), _deltas(key[hot]), _small(self.counts[own]), self.nats[own])


def _root_slots(chunk: Chunk, train: np.ndarray, bits: int) -> Slots:
    """The chunk's words, which are sorted as they are."""
    words, n = chunk.vocabulary, len(chunk.vocabulary)
    counts = np.bincount(chunk.tokens[train], minlength=n)
    return Slots(np.zeros(0, np.int32), chunk.tokens, (words >> np.uint64(64 - bits)).astype(np.int64), np.zeros(n, bool), words, counts, np.zeros(n, np.uint16))


def _slots(gram: np.ndarray, context: np.ndarray, hot: np.ndarray, places: np.ndarray, train: np.ndarray, lower: np.ndarray, bits: int) -> Slots:
    _, first, slot = np.unique(gram[places], return_index=True, return_inverse=True)
    at = places[first]
    g, c, h = gram[at], context[at], hot[at]
    mask = np.uint64((1 << bits) - 1)
    low = lambda x, n: x & np.uint64((1 << int(n)) - 1)
    bucket = np.where(h, g & mask, (c >> np.uint64(4)) & mask).astype(np.int32)
    key = np.where(h, (c >> _HOT[0]) << _HOT[1] | low(g >> np.uint64(24), _HOT[1]), (c >> _PLAIN[0]) << _PLAIN[1] | low(g, _PLAIN[1]))
    order = np.lexsort((key, h, bucket))
    back = np.empty(len(order), np.int32)
    back[order] = np.arange(len(order), dtype=np.int32)
    slot = back[slot]
    counts = np.bincount(slot[train[places]], minlength=len(order))
    nats = np.minimum(np.rint(-np.log(lower[at][order]) * STEPS), 65535).astype(np.uint16)
    return Slots(places, slot, bucket[order], h[order], key[order], counts, nats)


@dataclass
class Scores:
    """Where the answers so far lead: what to ask next, or the tokens' probabilities."""

    ask: Slots | None
    root: np.ndarray | None = None
    known: np.ndarray | None = None
    tree: np.ndarray | None = None


def climb(chunk: Chunk, answers: list[list[np.ndarray]], model: Model) -> Scores:
    """Take a chunk up the tree as far as there are answers, one list of arrays for each depth."""
    words = chunk.vocabulary[chunk.tokens]
    n = len(words)
    first = np.zeros(n, bool)
    first[np.cumsum(chunk.lengths) - chunk.lengths] = True
    train = np.repeat(chunk.train, chunk.lengths)
    if not answers:
        return Scores(_root_slots(chunk, train, model.bits))
    seen = answers[0][0][chunk.tokens]
    root = (seen + ROOT) / model.floor
    known, tree, gram = seen > 0, root, words
    for depth in range(1, DEPTH + 1):
        context, before = np.roll(gram, 1), np.roll(seen, 1)
        context[first], before[first] = _STARTS[depth - 1][0], model.docs
        gram = pair(context, words)
        slots = _slots(gram, context, before >= model.hot_at, np.flatnonzero(before >= LEAST).astype(np.int32), train, tree, model.bits)
        del context, before
        if len(answers) == depth:
            return Scores(slots)
        count, total, kinds = answers[depth]
        of = np.zeros((2, len(slots.key)), np.int64)  # occurrences and different next words of each slot's context, if it is retained
        plain = np.flatnonzero(~slots.hot)
        if len(plain):
            name, bucket = slots.key[plain] >> _PLAIN[1], slots.bucket[plain]
            run = np.cumsum(np.concatenate(([0], (name[1:] != name[:-1]) | (bucket[1:] != bucket[:-1]))))
            of[:, plain] = np.stack((total, kinds))[:, run]
        if slots.hot.any():
            names, *sums = model.hot[depth]
            of[:, slots.hot] = np.stack(sums)[:, np.searchsorted(names, (slots.key[slots.hot] >> _HOT[1]).astype(np.int64))]
        seen = np.zeros(n, np.int64)
        seen[slots.places] = count[slots.slot]
        on = of[0, slots.slot] > 0
        places, slot = slots.places[on], slots.slot[on]
        del slots, on
        weight = PRIOR * of[1, slot]
        tree = tree.copy() if depth == 1 else tree
        tree[places] = (seen[places] + weight * tree[places]) / (of[0, slot] + weight)
        del places, slot, weight
    return Scores(None, root, known, tree)


_STARTS = _starts()


def retained(n: np.ndarray, nats: np.ndarray) -> np.ndarray:
    """Whether contexts that occur ``n`` times and diverge from their suffixes by ``nats`` in all are kept."""
    return (n >= LEAST) & (nats >= EVIDENCE) & (nats >= DIVERGENCE * n)


def _sums(name: np.ndarray, counts: np.ndarray, nats: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each context, in sorted order: name, occurrences, different next words, sum of c * ln(c / lower)."""
    if not len(name):
        return name, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    starts = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
    own = counts * (np.log(np.maximum(counts, 1)) + nats / STEPS)
    return name[starts], np.add.reduceat(counts, starts), np.add.reduceat((counts > 0).astype(np.int64), starts), np.add.reduceat(own, starts)


_REPLY = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("body", pa.binary()), ("hot", pa.int64()), ("n", pa.int64()), ("kinds", pa.int64()), ("nats", pa.float64())])
_REPLY_DDL = "chunk long, bucket int, body binary, hot long, n long, kinds long, nats double"


def _answers(depth: int, bucket: int, chunks: list[int], blocks: list[bytes]) -> Iterator[dict]:
    """Sum the blocks of a bucket and answer each; rows of a null chunk hold the bucket's part of global sums."""
    parts = [unpack(b) for b in blocks]
    plain = [_undeltas(p[0]) for p in parts]
    hot = [_undeltas(p[1]) for p in parts]
    ends = [len(p) for p in plain]

    def totals(keys, pick):
        each, where = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.bincount(where, np.concatenate([pick(p[2], e) for p, e in zip(parts, ends, strict=True)]), len(each)).astype(np.int64)
        nats = np.zeros(len(each), np.uint16)
        nats[where] = np.concatenate([pick(p[3], e) for p, e in zip(parts, ends, strict=True)])
        return each, counts, nats, np.split(where, np.cumsum([len(k) for k in keys])[:-1])

    each, counts, nats, where = totals(plain, lambda x, e: x[:e])
    hot_each, hot_counts, hot_nats, hot_where = totals(hot, lambda x, e: x[e:])
    if depth:
        name = each >> _PLAIN[1]
        _, n, kinds, nats = _sums(name, counts, nats)
        keep = retained(n, nats - n * np.log(np.maximum(n, 1)))
        n, kinds = np.where(keep, n, 0), np.where(keep, kinds, 0)
        run = np.cumsum(np.concatenate(([0], name[1:] != name[:-1]))) if len(name) else np.zeros(0, np.int64)
        for x in zip(*(a.tolist() for a in _sums(hot_each >> _HOT[1], hot_counts, hot_nats)), strict=True):
            yield dict(zip(("bucket", "hot", "n", "kinds", "nats"), (bucket, *x), strict=True))
    else:
        yield {"bucket": bucket, "n": int(counts.sum()), "kinds": int((counts > 0).sum())}
    for chunk, at, hot_at in zip(chunks, where, hot_where, strict=True):
        found = np.concatenate((counts[at], hot_counts[hot_at]))
        if depth:
            of = run[at]
            of = of[np.concatenate(([True], of[1:] != of[:-1]))] if len(of) else of
            body = pack(_small(found), _small(n[of]), _small(kinds[of]))
        else:
            body = pack(_small(found))
        yield {"chunk": chunk, "bucket": bucket, "body": body}


def chunks_of(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` in chunks: chunk, body, and the training tokens, training documents and tokens of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def made():
            nonlocal number, ids, texts, size
            chunk = Chunk.of(ids, texts)
            row = (number, chunk.packed(), int(chunk.lengths[chunk.train].sum()), int(chunk.train.sum()), len(chunk.tokens))
            number, ids, texts, size = number + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["chunk", "body", "train", "docs", "tokens"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                if size >= CHUNK:
                    yield made()
        if ids:
            yield made()

    return stage(map_batches(docs.select("doc_id", "text"), run, "chunk long, body binary, train long, docs long, tokens long"), "chunks")


def _meet(chunks: DataFrame, replies: list[DataFrame]) -> DataFrame:
    """Each chunk's row, followed by the answers to it by depth and bucket."""
    rows = chunks.select("chunk", F.lit(-1).alias("depth"), F.lit(0).alias("bucket"), "body")
    for depth, reply in enumerate(replies):
        rows = rows.union(reply.where("chunk is not null").select("chunk", F.lit(depth), "bucket", "body"))
    return rows.repartition("chunk").sortWithinPartitions("chunk", "depth", "bucket") if replies else rows


def _met(batches: Iterator[pa.RecordBatch], depths: int) -> Iterator[tuple[int, Chunk, list[list[np.ndarray]]]]:
    """Chunks with the arrays of their answers, one at a time."""
    held, body, found = None, None, None

    def made():
        joined = [[np.concatenate(x).astype(np.int64) for x in zip(*map(unpack, own), strict=True)] for own in found]
        return held, Chunk.unpacked(body), joined

    for batch in batches:
        bodies = batch.column("body")
        for row, (chunk, depth) in enumerate(zip(batch.column("chunk").to_pylist(), batch.column("depth").to_pylist(), strict=True)):
            data = bodies[row].as_py()
            if depth < 0:
                if held is not None:
                    yield made()
                held, body, found = chunk, data, [[] for _ in range(depths)]
            else:
                found[depth].append(data)
    if held is not None:
        yield made()


def _exchange(chunks: DataFrame, replies: list[DataFrame], model: Model) -> DataFrame:
    """Ask for the n-grams of the next depth; the answers, stored."""
    depth = len(replies)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk, answers in _met(batches, depth):
            sent = list(climb(chunk, answers, model).ask.blocks(model.bits))
            for at in range(0, len(sent), 64):
                some = sent[at : at + 64]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in some], pa.int32()), pa.array([number] * len(some), pa.int64()), pa.array([x for _, x in some], pa.binary())], names=["bucket", "chunk", "block"])

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, blocks = None, [], []

        def rows():
            return pa.RecordBatch.from_pylist(list(_answers(depth, at, own, blocks)), schema=_REPLY)

        for batch in batches:
            for bucket, chunk, block in zip(*(batch.column(c).to_pylist() for c in ("bucket", "chunk", "block")), strict=True):
                if bucket != at and own:
                    yield rows()
                    own, blocks = [], []
                at = bucket
                own.append(chunk)
                blocks.append(block)
        if own:
            yield rows()

    sent = map_batches(_meet(chunks, replies), ask, "bucket int, chunk long, block binary")
    return stage(map_batches(sent.repartition("bucket").sortWithinPartitions("bucket"), reply, _REPLY_DDL), f"depth{depth}")


def _hot(reply: DataFrame) -> tuple:
    """Names, occurrences and different next words of hot contexts, at most four for each bucket; those not retained have none."""
    sums = reply.where("hot is not null").groupBy("hot").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds"), F.sum("nats").alias("nats")).orderBy("hot").toArrow()
    names, n, kinds, nats = (sums.column(c).to_numpy().astype(t) for c, t in (("hot", np.int64), ("n", np.int64), ("kinds", np.int64), ("nats", float)))
    keep = retained(n, nats - n * np.log(np.maximum(n, 1)))
    return names, np.where(keep, n, 0), np.where(keep, kinds, 0)


def score_texts(docs: DataFrame) -> DataFrame:
    """Score every document with the suffix tree and with its root alone.

    Documents whose crc32 of the doc_id is no multiple of ten train. Tokens are words,
    A-Z lower-cased, then an end. ``base_score`` sums the log10 probabilities of the
    root, ``(c + ROOT) / (N + ROOT * (V + 1))``, and ``score`` those of the tree. A context
    of one to ``DEPTH`` words is retained if it occurs ``LEAST`` times or more and its next
    words diverge from those of its suffix by ``EVIDENCE`` nats in all and ``DIVERGENCE`` a
    word; it gives a word ``(c + k * lower) / (n + k)``, where lower is the suffix's
    probability and k is ``PRIOR`` times the number of its different next words. What
    stands before a text is a symbol of its own. These bounds are absolute, so a larger
    corpus has a larger tree. Words are told apart by 64-bit hashes, contexts by 36 bits
    and more and next words within one by 26 and more, the more the larger the corpus.

    Null and empty texts have the end alone; repeated rows are scored each; null ids
    are hashed as an empty string and kept null; other columns are ignored. A text of
    any length stays in one chunk. An empty table gives an empty result. Returns
    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    chunks = chunks_of(docs)
    sums = chunks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("train", "docs", "tokens")]).first()
    bits = min(max((sums["tokens"] // TOKENS_A_BUCKET).bit_length(), FEWEST_BITS), MOST_BITS)
    model = Model(sums["train"], sums["docs"], bits)
    replies = []
    for depth in range(DEPTH + 1):
        replies.append(_exchange(chunks, replies, model))
        if depth:
            model.hot[depth] = _hot(replies[-1])
        else:
            model.words = replies[0].where("chunk is null").agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, chunk, answers in _met(batches, DEPTH + 1):
            found = climb(chunk, answers, model)
            at = np.cumsum(chunk.lengths) - chunk.lengths
            add = lambda x: np.add.reduceat(x, at)
            columns = [pa.array(chunk.ids, pa.int64()), ~chunk.train, chunk.lengths, add(found.known.astype(np.int64)), np.full(len(at), model.tokens), add(np.log10(found.root)), add(np.log10(found.tree))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return map_batches(_meet(chunks, replies), score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
