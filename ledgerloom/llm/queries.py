"""The corpus operators as queries over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, hard_negatives, linededup, mixing, packing, quality, sharding, simhash, suffix_tree, token_counts, token_output, whitening
from .common import table


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token shards, described from the files."""
    return token_output.token_output(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, and how many words of each the mix takes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes; equal texts stay together."""
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules of all documents, and the verdict of the likelihood ratio."""
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("score", "text_hash")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, told in four layouts, formatted and read back.

    A hash of conv_id decides how a conversation's rows are told: as turns, as lists of
    messages in either naming, or as JSON. Roles that the lists' mappings rename, and
    null ids, are told as turns.
    """
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    how = F.coalesce(F.when(F.col("role").isin(*chat.ROLES), 0).otherwise(F.pmod(F.xxhash64("conv_id"), F.lit(4))), F.lit(0))
    told = [
        F.struct("role", "text"),
        F.struct(F.array(F.struct("role", F.col("text").alias("content"))).alias("messages")),
        F.struct(F.array(F.struct(F.col("role").alias("from"), F.col("text").alias("value"))).alias("conversations")),
        F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}),
    ]
    return chat.read_chats(chat.chat_formatting(*[rows.where(how == n).select("conv_id", "turn", r.alias("record")) for n, r in enumerate(told)]))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that an earlier one holds."""
    kept = linededup.line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by the suffix tree and its root."""
    return suffix_tree.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all items of the benchmark."""
    marks = decontam.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return marks.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings along the four components of largest deviation."""
    found = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens, a row for each piece."""
    return packing.checksums(packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id 100 divides, among all vectors."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


QUERIES = {
    f.__name__: f
    for f in (op1_token_output, op2_mixing, op3_sharding, op4_token_counts, op5_quality, op6_chat_formatting, op7_near_duplicates, op8_line_dedup, op9_lm_scoring, op10_decontamination, op11_whitening, op12_packing, op13_hard_negatives)
}

_WORD = r"[^\x20\x09-\x0D]+"

SQL = {
    "op2_mixing": rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
             2.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held,
             sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
             (SELECT 1.5 * sum(source_size) FROM s)::DOUBLE AS budget FROM w),
v AS (SELECT arg_min((budget - coalesce(held, 0)) / free, (cap / w, source)) FILTER (WHERE (budget - coalesce(held, 0)) / free <= cap / w) AS level FROM o),
t AS (SELECT source, source_size, least(cap, w * level) AS target FROM w, v),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS passes FROM t),
c AS (SELECT d.*, source_size, target, passes, target - passes * source_size AS rest,
             sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
             sum(size) OVER (PARTITION BY d.source, h) AS own
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
e AS (SELECT *, min(CASE WHEN upto > rest THEN upto END) OVER (PARTITION BY source) AS edge FROM c)
SELECT doc_id, size, source_size, target,
       (size * (passes + CASE WHEN upto <= rest OR (upto = edge AND upto - rest < rest - (upto - own)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM e""",
    "op5_quality": rf"""
WITH raw AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT r, doc_id, text, regexp_extract_all(text, '{_WORD}') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM raw),
win AS (SELECT r, i, w[i] || chr(32) || w[i+1] || chr(32) || w[i+2] AS k FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM win) WHERE n > 1),
hit AS (SELECT r, count(DISTINCT i + j) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS j) GROUP BY r),
base AS (
  SELECT d.r, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN hit ON d.r = hit.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
h AS (SELECT r, doc_id, list_transform(w, lambda x: ('0x' || substr(md5(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), 1, 8))::BIGINT) AS h FROM d),
f AS (
  SELECT r, doc_id, unnest(h) % 65536 AS f FROM h
  UNION ALL SELECT r, doc_id, (h[i] * 1000003 + h[i+1]) % 4294967291 % 65536 FROM (SELECT r, doc_id, h, unnest(range(1, len(h))) AS i FROM h)),
lab AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
        HAVING min(quality) = 0 OR (min(quality) = 1 AND max(coalesce(toxic, 0)) = 0)
        ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 20000),
c AS (SELECT f, count(*) AS raw, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM lab WHERE good)) AS trusted FROM f GROUP BY f),
n AS (SELECT sum(raw) AS raw, sum(trusted) AS trusted FROM c),
q AS (SELECT f, ln((c.trusted + 1) / (n.trusted + 65536)::DOUBLE) - ln((c.raw + 1) / (n.raw + 65536)::DOUBLE) AS v FROM c, n),
s AS (SELECT r, avg(v) AS score FROM f JOIN q USING (f) GROUP BY r),
z AS (SELECT b.*, coalesce(score, 0) AS score FROM b LEFT JOIN s ON b.r = s.r),
l2 AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) IN (0, 1)
       ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 20000),
j AS (SELECT round(score, 9) AS s, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE NOT good) AS x FROM z JOIN l2 USING (doc_id) WHERE NOT base_failed GROUP BY 1),
k AS (SELECT s, lead(s) OVER (ORDER BY s) AS nx, sum(g) OVER (ORDER BY s) AS lost, sum(x) OVER () - sum(x) OVER (ORDER BY s) AS passed, sum(g) OVER () AS ng, sum(x) OVER () AS nb FROM j),
e AS (SELECT lost * nb + passed * ng AS errors, s - nx AS gap, (s + nx) / 2 AS t FROM k WHERE nx IS NOT NULL AND ng > 0 AND nb > 0
      UNION ALL SELECT coalesce(max(ng * nb), 0), 0, '-inf'::DOUBLE FROM k),
m AS (SELECT t FROM e ORDER BY errors, gap, t LIMIT 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND score >= t AS kept
FROM z, m""",
    "op6_chat_formatting": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (SELECT unnest(['<|im_start|>', '<|im_end|>', '<|endoftext|>', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>']) AS c),
e AS (
  SELECT *, length(role) + length(text) + length('<|im_start|>') + length('<|im_end|>') + 2
         + length(regexp_replace(role || text, '[^\\]', '', 'g')) + length(regexp_replace(role, '[^\n]', '', 'g'))
         + (SELECT sum((length(text) - length(replace(text, c, '')) + length(role) - length(replace(role, c, ''))) // length(c)) FROM c) AS n
  FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op8_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(coalesce(doc_id, -9223372036854775808)) AS owner FROM k WHERE length(key) >= 10 GROUP BY key
      HAVING min(coalesce(doc_id, -9223372036854775808)) < max(coalesce(doc_id, -9223372036854775808))),
m AS (SELECT k.*, owner IS NOT NULL AND owner <> coalesce(doc_id, -9223372036854775808) AS gone FROM k LEFT JOIN o USING (key))
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r""",
    "op10_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
x AS (SELECT DISTINCT item_id::VARCHAR AS item, least(10, len(w)) AS n, array_to_string(w[i:i+9], ' ') AS k
      FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0) WHERE item_id IS NOT NULL),
y AS (SELECT DISTINCT n FROM x),
p AS (SELECT r, i, n, array_to_string(w[i:i+n-1], ' ') AS k FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, y WHERE len(w) >= n)),
h AS (SELECT r, i, p.n, item FROM p JOIN x ON p.n = x.n AND p.k = x.k),
c AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS q FROM h) GROUP BY r),
s AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN s USING (r)""",
    "op13_hard_negatives": r"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
             list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
a AS (SELECT * FROM v WHERE vec_id % 100 = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, v.vec_id AS id, v.label = a.label AS same, list_dot_product(a.x, v.x)::BIGINT AS score FROM a JOIN v ON a.r <> v.r),
p AS (SELECT r, anchor_id, id AS positive_id, score AS positive_score, n FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, id) AS n FROM s WHERE same) WHERE n <= 5)
SELECT p.anchor_id, positive_id, k::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM (SELECT p.*, s.id, s.score, row_number() OVER (PARTITION BY p.r, p.n ORDER BY s.score DESC, s.id) AS k
      FROM p JOIN s ON p.r = s.r AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score) p WHERE k <= 5""",
}
