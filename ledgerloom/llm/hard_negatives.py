"""Hard negatives from Hilbert-ordered blocks of vectors with zone maps (operator 13).

All rows are sorted by label and place on a Hilbert curve and written as Parquet, a
block of some hundred vectors in a row, beside the block's zone map: the least and
largest value of each dimension and of the label. Anchors are packed into pages. For a
page and a block, interval arithmetic over the zone map bounds every inner product; a
block is read for an anchor only if its bounds and labels meet one of the anchor's
windows. What is read is compared exactly, so the bounds cost nothing in recall.

The positives are found in the same way with one window each, which is open above and
starts at the score of the anchor's k-th best row within its own block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, stage
from .vectors import as_binary, dimension, quantized

#: Bytes of vectors in a block, in a group of blocks that one task compares at once, and of zone maps evaluated at once.
BLOCK, GROUP, ZONES = 1 << 18, 1 << 22, 1 << 20
#: Anchors in a page.
PAGE = 4096
#: Bits of each dimension on the curve.
BITS = 2
_LEAST, _MOST = -(1 << 62), 1 << 62
_BLOCKS = "block long, n int, anchors int, low_label long, high_label long, low binary, high binary, ids binary, nulls binary, labels binary, marks binary, x binary"
_PAGES = "page long, n int, block binary, place binary, ids binary, nulls binary, labels binary, x binary, windows int, floor binary, ceiling binary, positive binary, positive_null binary"


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of points on the Hilbert curve through a grid of 2 ** bits cells a side, as rows of bytes that sort like numbers."""
    x = cells.astype(np.uint32).T.copy()
    d = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo excess turns, from the coarsest bit down
        low = np.uint32(q - 1)
        for i in range(d):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] ^= np.where(hit, low, 0).astype(np.uint32) ^ swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn ^= np.where((x[d - 1] & q) != 0, np.uint32(q - 1), 0).astype(np.uint32)
        q >>= 1
    x ^= turn
    planes = [(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


def _ints(raw: bytes, *shape: int) -> np.ndarray:
    return np.frombuffer(raw, "<i8").reshape(shape or -1)


def _raw(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, "<i8").tobytes()


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of two whole-number matrices."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(float) @ b.astype(float).T).astype("<i8") if most < 1 << 53 else a @ b.T


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each row of ``a`` with any vector in each box."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return products(up, low) + products(down, high), products(up, high) + products(down, low)


def write_blocks(rows: DataFrame, d: int) -> DataFrame:
    """``rows(id, label, anchor, x)`` as a table of blocks, by label and Hilbert curve."""
    spread = stage(rows, "vectors")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, np.zeros(d), np.zeros(d)
        for batch in batches:
            v = _ints(b"".join(batch.column("x").to_pylist()), -1, d).astype(float)
            n, sums, squares = n + len(v), sums + v.sum(axis=0), squares + (v * v).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"pos": pa.array(np.arange(2 * d + 1), pa.int64()), "value": pa.array(np.concatenate([sums, squares, [n]]))})

    got = dict(map_batches(spread.select("x"), moments, "pos long, value double").groupBy("pos").agg(F.sum("value")).collect())
    n = got.get(2 * d, 0.0) or 1.0
    mean = np.array([got.get(i, 0.0) for i in range(d)]) / n
    width = np.sqrt(np.maximum(np.array([got.get(d + i, 0.0) for i in range(d)]) / n - mean**2, 1e-9))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _ints(b"".join(batch.column("x").to_pylist()), -1, d)
            cells = np.clip(np.floor((v - mean) / width * (1 << BITS) / 4) + (1 << (BITS - 1)), 0, (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, as_binary(hilbert_keys(cells))], names=[*batch.schema.names, "curve"])

    schema = spread.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    placed = map_batches(spread, place, f"{schema}, curve binary")
    # the vector and its id are part of the order, so that a hot place of the curve is split
    order = ["label", "curve", "x", "id"]
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    per = max(1, BLOCK // (8 * d))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, k, held = TaskContext.get().partitionId() << 32, 0, []

        def block(table: pa.Table) -> pa.RecordBatch:
            x = _ints(b"".join(table.column("x").to_pylist()), -1, d)
            ids, labels = (table.column(c).fill_null(0).to_numpy() for c in ("id", "label"))
            nulls, marks = table.column("id").is_null().to_numpy(), table.column("anchor").to_numpy()
            by_id = np.lexsort((ids, nulls))  # so that ties within a block are in order
            x, ids, labels, nulls, marks = (a[by_id] for a in (x, ids, labels, nulls, marks))
            row = {"block": first + k, "n": len(x), "anchors": int(marks.sum()), "low_label": int(labels.min()), "high_label": int(labels.max()), "low": _raw(x.min(axis=0)), "high": _raw(x.max(axis=0))}
            row |= {"ids": _raw(ids), "nulls": _raw(nulls), "labels": _raw(labels), "marks": _raw(marks), "x": _raw(x)}
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 7]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds, strict=True)], names=list(row))

        for batch in batches:
            for at in range(0, batch.num_rows, per):
                held.append(batch.slice(at, per))
                while sum(b.num_rows for b in held) >= per:
                    table = pa.Table.from_batches(held)
                    yield block(table.slice(0, per))
                    held, k = table.slice(per).to_batches(), k + 1
        if sum(b.num_rows for b in held):
            yield block(pa.Table.from_batches(held))

    return stage(map_batches(ordered.select("id", "label", "anchor", "x"), pack, _BLOCKS), "blocks")


def _page(number: int, d: int, held: list[dict]) -> pa.RecordBatch:
    join = lambda k: np.concatenate([h[k] for h in held])
    n = len(join("ids"))
    row = {"page": number, "n": n} | {k: _raw(join(k)) for k in ("block", "place", "ids", "nulls", "labels", "x")} | {"windows": 1, "floor": _raw(join("floor")), "ceiling": _raw(np.full(n, _MOST)), "positive": _raw(np.zeros(n)), "positive_null": _raw(np.zeros(n))}
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 6, pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds, strict=True)], names=list(row))


def anchor_pages(table: DataFrame, d: int, k: int) -> DataFrame:
    """The anchors of all blocks in pages, each with the score of its ``k``-th best other row of its label in its own block."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, held, count = TaskContext.get().partitionId() << 32, 0, [], 0
        for batch in batches:
            for r in batch.to_pylist():
                x, labels, at = _ints(r["x"], -1, d), _ints(r["labels"]), np.flatnonzero(_ints(r["marks"]))
                scores = products(x[at], x)
                scores[labels[at][:, None] != labels] = _LEAST
                scores[np.arange(len(at)), at] = _LEAST
                best = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(at), _LEAST)
                held.append({"block": np.full(len(at), r["block"]), "place": at, "ids": _ints(r["ids"])[at], "nulls": _ints(r["nulls"])[at], "labels": labels[at], "x": x[at], "floor": best})
                count += len(at)
                if count >= PAGE:
                    yield _page(first + made, d, held)
                    made, held, count = made + 1, [], 0
        if held:
            yield _page(first + made, d, held)

    return stage(map_batches(table.where("anchors > 0").select("block", "ids", "nulls", "labels", "marks", "x"), build, _PAGES), "pages")


def choose(pages: DataFrame, table: DataFrame, d: int, same: bool) -> DataFrame:
    """Which blocks each page's anchors must read: page, block and a bit for each anchor; from the zone maps alone.

    Every page meets every bundle of zone maps once; only blocks that some anchor needs are returned.
    """
    zones = table.select("block", "low_label", "high_label", "low", "high")
    bundles = max(1, math.ceil(table.count() * 16 * d / ZONES))
    dealt = zones.withColumn("bundle", F.pmod(F.xxhash64("block"), F.lit(bundles)).cast("int"))

    def bundle(group: pa.Table) -> pa.Table:
        join = lambda c: pa.array([b"".join(group.column(c).to_pylist())], pa.binary())
        flat = lambda c: pa.array([_raw(group.column(c).to_numpy())], pa.binary())
        return pa.table({"bundle": pa.array(group.column("bundle")[:1].to_pylist(), pa.int32()), "block": flat("block"), "low_label": flat("low_label"), "high_label": flat("high_label"), "low": join("low"), "high": join("high")})

    maps = dealt.groupBy("bundle").applyInArrow(bundle, "bundle int, block binary, low_label binary, high_label binary, low binary, high binary")
    asked = pages.select("page", "windows", F.col("labels").alias("of"), F.col("x").alias("ax"), "floor", "ceiling").withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a, of, w = _ints(r["ax"], -1, d), _ints(r["of"])[:, None], r["windows"]
                least, most = bounds(a, _ints(r["low"], -1, d), _ints(r["high"], -1, d))
                low, high = _ints(r["low_label"]), _ints(r["high_label"])
                fit = (low <= of) & (of <= high) if same else (low != of) | (high != of)
                floor, ceiling = _ints(r["floor"], -1, w), _ints(r["ceiling"], -1, w)
                within = np.zeros(fit.shape, bool)
                for i in range(w):
                    lo, hi = floor[:, i : i + 1], ceiling[:, i : i + 1]
                    within |= (lo <= hi) & (most >= lo) & (least <= hi)
                within &= fit
                need = np.flatnonzero(within.any(axis=0))
                bits = np.packbits(within[:, need], axis=0)
                yield pa.RecordBatch.from_pydict({"page": pa.array([r["page"]] * len(need), pa.int64()), "block": pa.array(_ints(r["block"])[need], pa.int64()), "who": pa.array([bits[:, j].tobytes() for j in range(len(need))], pa.binary())})

    return stage(map_batches(asked.join(maps, "bundle"), decide, "page long, block long, who binary"), "chosen")


def first_in_windows(pages: DataFrame, table: DataFrame, d: int, same: bool, k: int) -> DataFrame:
    """For each window of each anchor the first ``k`` rows of its own label (or of others) whose score lies within it.

    Returns page, slot and anchor_id of the anchor, window, rank, id and score.
    """
    chosen = choose(pages, table, d, same)
    groups = max(1, math.ceil((table.agg(F.sum("n")).first()[0] or 0) * 8 * d / GROUP))
    cell = F.pmod(F.xxhash64("block", F.lit(1)), F.lit(groups)).cast("int").alias("cell")
    cells = chosen.select("page", "block", "who", cell)
    read = cells.join(table.select("block", "ids", "nulls", "labels", "x"), "block")
    asking = cells.select(F.col("page").alias("of_page"), F.col("cell").alias("of_cell")).distinct().join(pages, F.col("of_page") == F.col("page"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        page = right.slice(0, 1).to_pylist()[0]
        a, own, w = _ints(page["x"], -1, d), _ints(page["labels"]), page["windows"]
        home, place = _ints(page["block"]), _ints(page["place"])
        floor, ceiling = _ints(page["floor"], -1, w).copy(), _ints(page["ceiling"], -1, w)
        best = [np.empty((0, 5), "<i8") for _ in range(w)]  # slot, -score, null, id of the rows that lead so far
        for i in range(left.num_rows):
            r = left.slice(i, 1).to_pylist()[0]
            who = np.flatnonzero(np.unpackbits(np.frombuffer(r["who"], "u1"))[: len(a)])
            ids, nulls, labels = _ints(r["ids"]), _ints(r["nulls"]), _ints(r["labels"])
            scores = products(a[who], _ints(r["x"], -1, d))
            fit = (own[who][:, None] == labels) == same
            if same:
                here = np.flatnonzero(home[who] == r["block"])
                fit[here, place[who[here]]] = False
            for j in range(w):
                s, c = np.nonzero(fit & (scores >= floor[who, j][:, None]) & (scores <= ceiling[who, j][:, None]))
                if not len(s):
                    continue
                found = np.column_stack([who[s], -scores[s, c], nulls[c], ids[c], np.zeros(len(s), "<i8")])
                both = np.concatenate([best[j], found])
                both = both[np.lexsort((both[:, 3], both[:, 2], both[:, 1], both[:, 0]))]
                starts = np.flatnonzero(np.concatenate([[True], both[1:, 0] != both[:-1, 0]]))
                both[:, 4] = np.arange(len(both)) - np.repeat(starts, np.diff([*starts, len(both)]))
                best[j] = both[both[:, 4] < k]
                full = best[j][best[j][:, 4] == k - 1]  # lower scores than the k-th can't enter any more
                floor[full[:, 0], j] = np.maximum(floor[full[:, 0], j], -full[:, 1])
        out = np.concatenate([np.column_stack([b[:, :4], np.full(len(b), j)]) for j, b in enumerate(best)])
        asker = pa.array(_ints(page["ids"])[out[:, 0]], pa.int64(), mask=_ints(page["nulls"])[out[:, 0]] != 0)
        ids = pa.array(out[:, 3], pa.int64(), mask=out[:, 2] != 0)
        return pa.table({"page": pa.array(np.full(len(out), page["page"]), pa.int64()), "slot": pa.array(out[:, 0].astype("i4")), "anchor_id": asker, "window": pa.array(out[:, 4].astype("i4")), "id": ids, "score": pa.array(-out[:, 1])})

    led = read.groupBy("page", "cell").cogroup(asking.groupBy("of_page", "of_cell")).applyInArrow(compare, "page long, slot int, anchor_id long, window int, id long, score long")
    order = Window.partitionBy("page", "slot", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return led.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def with_windows(pages: DataFrame, positives: DataFrame, low: int, high: int) -> DataFrame:
    """Pages whose anchors ask for scores of ``low`` to ``high`` per cent of each positive's."""
    by_page = positives.groupBy("page").agg(F.collect_list(F.struct("slot", F.col("rank").cast("int").alias("rank"), "id", "score")).alias("found"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                found = r.pop("found")
                w = max(f["rank"] for f in found)
                floor, ceiling = np.ones((r["n"], w), "<i8"), np.zeros((r["n"], w), "<i8")  # an empty window where there is no positive
                ids, nulls = np.zeros((r["n"], w), "<i8"), np.ones((r["n"], w), "<i8")
                for f in found:
                    at = f["slot"], f["rank"] - 1
                    floor[at], ceiling[at] = -(-low * f["score"] // 100), high * f["score"] // 100
                    ids[at], nulls[at] = f["id"] or 0, f["id"] is None
                r |= {"windows": w, "floor": _raw(floor), "ceiling": _raw(ceiling), "positive": _raw(ids), "positive_null": _raw(nulls)}
                yield pa.RecordBatch.from_pylist([r], batch.schema.remove(batch.schema.get_field_index("found")))

    return stage(map_batches(pages.join(by_page, "page"), build, _PAGES), "windows")


def hard_negatives(rows: DataFrame, anchor: Column, key: str = "vec_id", label: str = "label", column: str = "embedding", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """For each anchor and each of its best ``positives`` the best rows of other labels that score ``low`` to ``high`` per cent of the positive.

    Scores are inner products of floor(256 * entry), higher first, ties by smaller key
    (a null key last). Returns anchor_id, positive_id, rank, negative_id, positive_score and
    negative_score. ``anchor`` says which rows are anchors, null being no. Rows without a
    label or a vector that can be used (see ``vectors.quantized``; here entries are bounded
    so that scores stay within 60 bits) take no part. Rows that repeat are rows of their
    own: each is an anchor, positive and negative by itself. An anchor without a row of its
    label, and a positive without negatives in its window, give no rows, like an empty
    table. Labels are whole numbers. Other columns are ignored.
    """
    given = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(column).alias("vector")).where("label is not null")
    d = dimension(given, "vector") or 1
    table = write_blocks(quantized(given, "vector", d, ["id", "label", "anchor"], math.isqrt((1 << 60) // d)), d)
    pages = anchor_pages(table, d, positives)
    found = stage(first_in_windows(pages, table, d, True, positives), "positives")
    mined = first_in_windows(with_windows(pages, found, low, high), table, d, False, negatives)
    positive = found.select("page", "slot", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = mined.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(positive, ["page", "slot", "window"])
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
