"""Benchmark decontamination with DataFrame functions alone (operator 10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, same_row, stage

WINDOW = 10
#: Hashes of windows that are broadcast, at most (8 bytes each); of a larger benchmark they are joined by shuffle.
BROADCAST = 10_000_000
#: Windows that are broadcast with their words and items, at most; of a larger benchmark they are joined by shuffle, for hits alone.
TEXTS = 100_000
#: Pairs of end words that prefilter windows inside the plan, at most.
PAIRS = 50_000


def words_of(text: Column) -> Column:
    """Runs of digits, letters and non-ASCII characters, A-Z lower-cased; none for null."""
    split = F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.filter(split, lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of the items: len, hash, text, items (sorted ids as strings).

    An item of fewer words, but not none, is one window. Null ids are not counted
    as items; repeated items count once.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).where("size(w) > 0")
    n = F.greatest(F.size("w") - window + 1, F.lit(1))
    texts = F.transform(F.sequence(F.lit(1), n), lambda i: F.slice("w", i, window))
    rows = items.select("item", F.explode(texts).alias("words"))
    keyed = rows.select(
        "item", F.size("words").alias("len"), F.xxhash64("words").alias("hash"), F.array_join("words", " ").alias("window"),
        F.xxhash64(F.element_at("words", 1), F.element_at("words", -1)).alias("ends"),
    )
    return keyed.groupBy("len", "hash", "window", "ends").agg(F.collect_set("item").alias("items"))


def _hits(n: int, ends: list[int] | None, hashes: list[int] | None) -> Column:
    """The windows of ``n`` words of ``w`` that pass the tests, all of them without tests."""
    places = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - (n - 1))).otherwise(F.array().cast("array<int>"))
    if ends is not None:
        places = F.filter(places, lambda i: F.xxhash64(F.get("w", i - 1), F.get("w", i + (n - 2))).isin(ends))
        places = F.filter(places, lambda i: F.xxhash64(F.slice("w", i, n)).isin(hashes))
    return F.transform(places, lambda i: F.struct(i.alias("at"), F.lit(n).alias("len"), F.xxhash64(F.slice("w", i, n)).alias("hash")))


def _with_text(found: Column) -> Column:
    """The windows with their words, which are joined for these few alone."""
    return F.transform(found, lambda x: F.struct(x["at"].alias("at"), x["len"].alias("len"), x["hash"].alias("hash"), F.array_join(F.slice("w", x["at"], x["len"]), " ").alias("window")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Mark every word of ``docs(doc_id, text)`` inside a window of ``benchmark(item_id, text)``.

    Each document stays one row until its windows are tested: first by a hash of
    their end words, then by the hash of all words, against sets that hold the
    benchmark's windows and nothing that grows with the documents. Only what passes
    leaves the row, is compared word by word with the windows, and is gathered again
    by the row. A benchmark of more than ``PAIRS`` windows is too large for a test inside
    the row: the 64-bit hashes of a document's windows, without their words, are held
    against a broadcast set of the benchmark's hashes, of more than ``BROADCAST`` windows by a
    join, and only hits go back to their rows for the comparison; the windows' words are
    broadcast up to ``TEXTS`` of them. Null texts have no words. An
    empty benchmark hits nothing, empty tables give empty results, repeated rows are
    returned each. Returns doc_id, text_hash, n_words, n_hit, n_items, items, spans
    (half-open word ranges), contaminated.
    """
    windows = stage(benchmark_windows(benchmark, window), "windows")
    lengths = windows.groupBy("len").count().collect()  # at most ``window`` rows
    total = sum(r["count"] for r in lengths)
    pairs = windows.select("ends").distinct().limit(PAIRS + 1).collect() if total <= PAIRS else None
    ends = [r["ends"] for r in pairs] if pairs else None
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("w"))
    found = F.array().cast("array<struct<at:int,len:int,hash:bigint>>")
    hashes = [r["hash"] for r in windows.select("hash").distinct().collect()] if ends else None
    for r in sorted(lengths, key=lambda r: r["len"]):
        found = F.concat(found, _hits(r["len"], ends, hashes))
    if total and not ends:
        every = windows.select("hash").distinct()
        one = rows.select("doc_id", "text_hash", F.explode(found).alias("_f")).select("doc_id", "text_hash", "_f.*")
        passed = one.join(F.broadcast(every) if total <= BROADCAST else every, "hash", "left_semi")
        passed = passed.groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).agg(F.collect_set(F.struct("at", "len", "hash")).alias("_p"))
        rows = rows.join(passed, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_t")), "left")
        found = F.col("_p")
    seen = rows.select("_row", "doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), F.explode_outer(_with_text(found)).alias("_f")).select("_row", "doc_id", "text_hash", "n_words", "_f.*")
    known = windows.select(F.col("len").alias("l"), F.col("hash").alias("h"), F.col("window").alias("t"), "items")
    same = (F.col("hash") == F.col("h")) & (F.col("len") == F.col("l")) & (F.col("window") == F.col("t"))
    if total <= TEXTS:
        joined = seen.join(F.broadcast(known), same, "left")
    else:  # rows without a hit have no hash to be shuffled by
        without = seen.where("hash is null")
        joined = seen.where("hash is not null").join(known, same, "left").unionByName(without, allowMissingColumns=True)
    hit = F.col("items").isNotNull()
    gathered = joined.groupBy("_row", "doc_id", "text_hash", "n_words").agg(
        F.collect_set(F.when(hit, F.struct("at", "len"))).alias("ranges"), F.flatten(F.collect_set("items")).alias("items")
    )
    # overlapping and touching ranges become spans
    start = F.array().cast("array<struct<a:int,b:int>>")

    def widen(spans, r):
        last, a, b = F.element_at(spans, -1), r["at"] - 1, r["at"] - 1 + r["len"]
        apart = (F.size(spans) == 0) | (F.try_element_at(spans, F.lit(-1))["b"] < a)
        return F.when(apart, F.concat(spans, F.array(F.struct(a.alias("a"), b.alias("b"))))).otherwise(
            F.concat(F.slice(spans, 1, F.greatest(F.size(spans) - 1, F.lit(0))), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], b).alias("b"))))
        )

    spans = F.aggregate(F.array_sort("ranges"), start, lambda s, r: widen(s, r))
    out = gathered.select("doc_id", "text_hash", "n_words", F.array_sort(F.array_distinct("items")).alias("items"), spans.alias("spans"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return out.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans").withColumn("contaminated", F.col("n_hit") > 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no benchmark window occurs, all columns kept.

    Rows of equal or null doc_id and different texts are judged each by its own text.
    """
    marks = contamination(docs.select("doc_id", "text"), benchmark, window).where("contaminated").select("doc_id", "text_hash").distinct()
    return docs.join(marks, same_row(docs, marks), "left_anti")
