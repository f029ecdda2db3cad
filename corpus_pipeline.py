"""A training corpus from raw documents: five stages, each over all that the one before kept.

In every stage a null text has no words, a null doc_id and a null source are values of
their own, rows that repeat are judged alike, further columns are kept as they are,
whatever their names, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import common, decontam, mixing, near_copies, quality, token_output

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the likelihood ratio keep, each judged by its own text; those without words go."""
    verdict = quality.quality(docs, common.table(spark, sf_dir, "labels")).where("kept").select("doc_id", "text_hash").distinct()
    return docs.join(verdict, common.same_row(docs, verdict), "left_semi")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word Jaccard of 0.8 or more): the smallest doc_id, a null id only in groups without others.

    Of rows with its doc_id and text the first by all other columns stays, in the order of their names.
    """
    # texts are moved once, by a merge join whatever the size, and only rows that stand there repeatedly are grouped
    surplus = near_copies.surplus(docs).hint("merge")
    repeated = surplus.where("keep")
    once = docs.join(surplus, common.same_row(docs, surplus), "left_anti")
    return once.union(common.first_rows(docs.join(repeated, common.same_row(docs, repeated), "left_semi"), ["doc_id", "text"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontam.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; repeats are equal rows, a document without words is taken as often as its source whole."""
    sizes = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    # times depend on these three alone, so rows of equal or null ids get their own
    times = mixing.mix(sizes).where("times > 0").select("doc_id", "source", (F.col("size") > 0).alias("worded"), "times").distinct()
    worded = F.coalesce(docs["text"].rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    same = docs["doc_id"].eqNullSafe(times["doc_id"]) & docs["source"].eqNullSafe(times["source"]) & (worded == times["worded"])
    copies = F.array_repeat(F.struct(*[docs[c] for c in docs.columns]), times["times"].cast("int"))
    return docs.join(times, same).select(F.explode(copies).alias("row")).select("row.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as token shards, described document by document from the files; a text without words is the end id alone."""
    return token_output.token_output(docs)


STAGES = [
    ("quality", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix_sources),
    ("tokens", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
