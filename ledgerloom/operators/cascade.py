"""The labelling cascade: the first stage with a result wins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.thresholds import Thresholds

LABEL = ["id", "category", "subcategory", "confidence", "source"]


def person_history_gate(matched: DataFrame, prior: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """Labels of known people, capped where the counterparty's history says otherwise."""
    history = prior.where("established").select("id", F.col("category").alias("prior_category"))
    out = matched.join(history, "id", "left")
    differs = F.col("prior_category").isNotNull() & (F.col("prior_category") != "Transfers")
    confidence = F.when(differs, th.defer_cap).otherwise(0.95)
    return out.select("id", F.lit("Transfers").alias("category"), "subcategory", confidence.alias("confidence"), F.lit("rule").alias("source"), F.col("name").alias("merchant"), F.coalesce(differs, F.lit(False)).alias("gated"))


def first_of(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """Labels of cheap stages side by side, of which the first counts: id, the label, stage.

    Each has at most one label a transaction. They meet as rows of one union and in one
    grouping, so only labels are shuffled, once, and no stage is computed twice.
    """
    told = [labels.select("id", F.struct(F.lit(n).alias("_n"), *LABEL[1:], F.lit(name).alias("stage")).alias("_l")) for n, (name, labels) in enumerate(stages)]
    return reduce(DataFrame.union, told).groupBy("id").agg(F.min_by("_l", "_l._n").alias("_l")).select("id", *[f"_l.{c}" for c in (*LABEL[1:], "stage")])


def annotate_cascade(txns: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One label a transaction from the first stage that has one; rows of no stage stay out.

    A stage is a function of the transactions that the ones before left, so that a
    costly one reads and computes only these. Its labels have id, category,
    subcategory, confidence, source, and a stage of their own if it stands for
    several. ``keep`` stores a stage's labels, for all later stages ask for them.
    """
    left, out = txns, None
    for name, stage in stages:
        found = stage(left)
        found = keep(found.select(*LABEL, F.col("stage") if "stage" in found.columns else F.lit(name).alias("stage")))
        out = found if out is None else out.unionByName(found)
        left = left.join(found.select("id"), "id", "left_anti")
    return out


def run_counts(txns: DataFrame, labels: DataFrame, known: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """Counts of a run by ledger: processed, by source, low confidence, failed, already labelled."""
    rows = txns.select("id", "ledger_id").join(labels, "id", "left").join(known.select("id", F.lit(True).alias("_k")), "id", "left")
    new = F.col("_k").isNull()
    n = lambda c: F.count(F.when(c, 1))
    sources = ["rule", "learned_rule", "rag_direct", "rag_prompted", "llm"]
    return rows.groupBy("ledger_id").agg(
        n(new).alias("processed"), *[n(new & (F.col("source") == s)).alias(s) for s in sources], n(new & F.col("source").isNull()).alias("failed"),
        n(new & (F.col("confidence") < th.confidence)).alias("low_confidence"), n(~new).alias("already"),
    )


#: The stages in order, as the trace names them.
STAGES = ("person", "keyword", "learned", "rag_direct", "prompted", "plain")
#: What a trace may say besides, by the names under which it is read again; absent ones are left out.
TRACED = (
    "embed_text", "best_similarity", "vote_category", "vote_share", "trusted_weight", "agreement_factor", "margin_factor", "caps_applied",
    "counterparty_prior_category", "counterparty_prior_probability", "counterparty_prior_n", "counterparty_prior_effect",
    "llm_reasoning", "raw_confidence", "dampening_factor", "calibration_bucket", "llm_model", "prompt_tokens", "prompt_truncated", "verbalized_confidence",
    "logprob_confidence", "majority_category", "majority_count", "matched_rule",
)


def skip_reasons(stage: Column, best: Column, nearest_source: Column, th: Thresholds = Thresholds()) -> Column:
    """Why each stage before the one that decided fell through."""
    far = F.concat(F.lit("rag_direct: nearest "), F.round(best, 4).cast("string"), F.lit(f" is below {th.rag_direct}"))
    direct = F.when(best.isNull(), F.lit(f"rag_direct: no neighbour of {th.similarity_floor} or more")).when(best < th.rag_direct, far)
    direct = direct.when(nearest_source.isNull(), F.lit("rag_direct: no labelled neighbour")).otherwise(F.concat(F.lit("rag_direct: donor source '"), nearest_source, F.lit("' is not trusted")))
    why = [F.lit("person: no match"), F.lit("keyword: no match"), F.lit("learned: no rule"), direct, F.lit("prompted: no answer with examples")]
    return F.slice(F.array(*why), F.lit(1), F.greatest(F.array_position(F.lit(list(STAGES)), stage).cast("int") - 1, F.lit(0)))


def reasoning_trace(labels: DataFrame, facts: DataFrame, donors: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """Why each label is what it is, as one JSON document.

    ``labels`` has id, stage, confidence; ``facts`` at most one row an id, with any of
    the columns in ``TRACED``; ``donors`` are the deduplicated neighbours. A trace holds
    stage, final_confidence, the thresholds that it was held against, the reasons why
    earlier stages fell through, the neighbours by distance, and the facts.
    """
    near = F.struct((-F.col("similarity")).alias("order"), "transaction_id", "raw_description", "category", "source", F.round(1 - F.col("similarity"), 4).alias("distance"), F.round("similarity", 4).alias("similarity"))
    lists = donors.groupBy(F.col("query_id").alias("id")).agg(F.array_sort(F.collect_list(near)).alias("neighbours"))
    lists = lists.withColumn("_nearest", F.col("neighbours")[0]["source"]).withColumn("neighbours", F.transform("neighbours", lambda x: x.dropFields("order")))
    known = [c for c in TRACED if c in facts.columns]
    gates = {
        "confidence_threshold": th.confidence, "rag_direct_threshold": th.rag_direct, "rag_similarity_floor": th.similarity_floor, "rag_margin_safe": th.margin_safe,
        "rag_agreement_exponent": th.agreement_exponent, "rag_machine_donor_weight": th.machine_weight,
    }
    out = labels.select("id", "stage", "confidence").join(facts.select("id", *known), "id", "left").join(lists, "id", "left")
    best = F.col("best_similarity") if "best_similarity" in known else F.lit(None).cast("double")
    trace = F.struct(
        "stage", F.col("confidence").alias("final_confidence"), F.create_map(*[F.lit(x) for pair in gates.items() for x in pair]).alias("thresholds"),
        skip_reasons(F.col("stage"), best, F.col("_nearest"), th).alias("skips"), *known, F.coalesce("neighbours", F.array().cast(lists.schema["neighbours"].dataType)).alias("neighbours"),
    )
    return out.select("id", F.to_json(trace).alias("reasoning"))


def normalize_category(labels: DataFrame, names: DataFrame, close: float = 0.6) -> DataFrame:
    """Map distinct ``category`` values to the taxonomy ``names(name)``: category, normalized, how.

    Exact, then without case and outer spaces, then the only name that holds the
    value or is held in it, then the closest by matching characters (``close`` or more), else
    "Uncategorized". All but the closest are joins and conditions; only what they leave,
    a few misspelt labels, is compared by a vectorised helper, name by name.
    """
    import difflib

    values = labels.select("category").where("category is not null").distinct()
    known = names.select(F.col("name")).where("name is not null").distinct()
    low = F.lower(F.trim("category"))
    # distinct labels are few and so are names; each value meets all names once
    every = known.agg(F.sort_array(F.collect_list("name")).alias("names"))
    met = values.join(F.broadcast(every), F.lit(True)).withColumn("_low", low)
    exact = F.array_contains("names", F.col("category"))
    same = F.get(F.filter("names", lambda n: F.lower(n) == F.col("_low")), F.lit(0))
    inside = F.filter("names", lambda n: F.lower(n).contains(F.col("_low")) | F.col("_low").contains(F.lower(n)))
    found = F.when(exact, F.col("category")).when(same.isNotNull(), same).when(F.size(inside) == 1, F.get(inside, F.lit(0)))
    how = F.when(exact, "exact").when(same.isNotNull(), "case").when(F.size(inside) == 1, "inside")
    told = met.select("category", "names", found.alias("normalized"), how.alias("how"))

    def nearest(category: pd.Series, listed: pd.Series) -> pd.Series:
        best = [difflib.get_close_matches(v, list(names), n=1, cutoff=close) for v, names in zip(category, listed, strict=True)]
        return pd.Series([b[0] if b else None for b in best], dtype=object)

    left = told.where("normalized is null").withColumn("normalized", F.pandas_udf(nearest, "string")("category", "names"))
    left = left.withColumn("how", F.when(F.col("normalized").isNotNull(), "close").otherwise("none")).withColumn("normalized", F.coalesce("normalized", F.lit("Uncategorized")))
    return told.where("normalized is not null").unionByName(left).drop("names")


def normalize_subcategory(labels: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """The taxonomy's spelling of each (category, subcategory), null where it has none."""
    known = F.broadcast(taxonomy.select("category", F.col("subcategory").alias("normalized"), F.lower("subcategory").alias("_low")))
    keyed = labels.withColumn("_low", F.lower(F.trim("subcategory")))
    exact = F.min_by("normalized", F.struct((F.col("normalized") != F.col("subcategory")), F.col("normalized")))
    return keyed.join(known, ["category", "_low"], "left").groupBy(*labels.columns).agg(exact.alias("normalized"))


def category_paths(categories: DataFrame) -> DataFrame:
    """"Parent > Child" of each subcategory, the name alone of a top category."""
    parent = categories.select(F.col("id").alias("parent_id"), F.col("name").alias("parent"))
    return categories.join(F.broadcast(parent), "parent_id", "left").select("id", F.concat_ws(" > ", "parent", "name").alias("path"), F.coalesce("parent", "name").alias("top"))


def parse_model_response(df: DataFrame, col: str = "response") -> DataFrame:
    """Read model answers: drop a code fence, parse JSON, else retry without ``reasoning``.

    Adds category, subcategory, merchant, tags, confidence, reasoning and ok; answers that
    can't be read, lack a category or have a confidence outside 0 to 1 are kept with ok false.
    """
    schema = "category string, subcategory string, merchant string, tags array<string>, confidence double, reasoning string"
    body = F.trim(col)
    body = F.when(body.startswith("```"), F.trim(F.regexp_replace(F.regexp_replace(body, r"^```[^\n]*\n?", ""), r"```\s*$", ""))).otherwise(F.col(col))
    salvaged = F.regexp_replace(F.regexp_replace(body, r'(?s),?\s*"reasoning"\s*:\s*\\?".*(?=,\s*"|\s*\})', ""), r'(?s),?\s*"reasoning"\s*:\s*\\?".*$', "}")
    first, second = F.from_json(body, schema), F.from_json(salvaged, schema)
    good = lambda r: r["category"].isNotNull() & r["confidence"].between(0, 1)
    parsed = F.when(good(first), first).when(good(second), second)
    out = df.withColumn("_r", parsed)
    why = F.col("_r.reasoning")
    short = F.when(F.length(why) > 160, F.concat(F.rtrim(F.substring(why, 1, 157)), F.lit("..."))).otherwise(why)
    fields = [F.col(f"_r.{c}").alias(c) for c in ("category", "subcategory", "merchant")]
    return out.select("*", *fields, F.coalesce("_r.tags", F.array().cast("array<string>")).alias("tags"), F.col("_r.confidence").alias("confidence"), short.alias("reasoning"), F.col("_r").isNotNull().alias("ok")).drop("_r")


def logprob_confidence(df: DataFrame, tokens: str = "tokens", category: str = "category") -> DataFrame:
    """exp of the summed log probabilities of the tokens that overlap the category's value.

    ``tokens`` is an array of (token, logprob). Null where the value can't be found.
    """
    text = F.array_join(F.transform(tokens, lambda t: t["token"]), "")
    key = F.locate('"category"', text)
    start = F.when((key > 0) & (F.col(category) != ""), F.expr(f"locate({category}, array_join(transform({tokens}, t -> t.token), ''), locate('\"category\"', array_join(transform({tokens}, t -> t.token), '')))"))
    begin = F.when(start > 0, start - 1)
    end = begin + F.length(category)
    zero = F.struct(F.lit(0).alias("pos"), F.lit(0.0).alias("sum"))

    def step(acc, t):
        stop = acc["pos"] + F.length(t["token"])
        over = (stop > begin) & (acc["pos"] < end)
        return F.struct(stop.alias("pos"), F.when(over, acc["sum"] + t["logprob"]).otherwise(acc["sum"]).alias("sum"))

    total = F.aggregate(tokens, zero, step)["sum"]
    return df.withColumn("logprob_confidence", F.when(begin.isNotNull(), F.least(F.lit(1.0), F.exp(total))))


def render_prompts(rows: DataFrame, categories: list[str]) -> DataFrame:
    """A prompt for each row, for batch inference: id, prompt, with_examples.

    Rows may have ``examples`` (an array) with ``majority`` and ``majority_count``, as
    ``fewshot_examples`` gives them; those that have none are asked without. A note is told, and
    null fields are left out.
    """
    fields = rows.schema["examples"].dataType.elementType.names
    label = lambda e: F.concat_ws(" > ", e["category"], e["subcategory"]) if "subcategory" in fields else e["category"]
    shown = F.array_join(F.transform("examples", lambda e: F.concat_ws(" | ", e["raw_description"], label(e), e["source"])), "\n")
    some = F.coalesce(F.size("examples") > 0, F.lit(False))
    hint = F.concat(F.lit("Most similar rows are labelled "), "majority", F.lit(" ("), F.col("majority_count").cast("string"), F.lit(")"))
    note = F.when(F.length(F.trim("note")) > 0, F.concat(F.lit("note: "), F.trim("note"))) if "note" in rows.columns else F.lit(None).cast("string")
    row = F.concat_ws(" ", "debit_credit", F.col("amount").cast("string"), "raw_description")
    return rows.select("id", F.concat_ws("\n", F.lit("Choose one of: " + ", ".join(categories)), row, note, F.when(some, shown), hint).alias("prompt"), some.alias("with_examples"))
