"""Registered queries of the text operators and the SQL that some are checked against."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import (blockmax_search, circulant_minhash, conversation_trie, forest_join, huffman_store, language_profiles, packing,
                           piece_counts, poisson_mix, repetition, subword_classifier, vector_codes, wrapper_extraction)
from tidemark.llm.common import read_table, remainder

TOKENIZER = "byte_bpe_50k.json"


def op1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(read_table(spark, sf_dir, "documents"), kept=["doc_id"])


def op2_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)))
    profiles = language_profiles.trained(documents, "text", "lang", ~F.col("held_out"))
    return language_profiles.identify(documents, profiles, kept=["doc_id", "held_out"])


def op3_blockmax_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return blockmax_search.top_k(documents, documents.filter(F.col("doc_id") % 20 == 0))


def op4_huffman_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = huffman_store.round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return stored.withColumnRenamed("id", "doc_id")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), digest=True)


def op6_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest_join.jaccard_join(read_table(spark, sf_dir, "documents"))


def op7_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = poisson_mix.replicate(read_table(spark, sf_dir, "documents"), count_as="copy", key_as="order_key")
    return mixed.select("doc_id", "source", "copy", "order_key", F.length("text").cast("bigint").alias("n_text_chars"),
                        F.md5("text").alias("text_md5"))


def quality_model(spark: SparkSession, sf_dir: str):
    """The classifier, fitted on labelled rows outside the held-out third."""
    documents, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    labels = labels.filter(F.coalesce(remainder("doc_id", 3), F.lit(1)) != 1)
    return subword_classifier.fit(documents, labels, "doc_id", "text", "quality")


def op8_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)))
    return subword_classifier.classify(documents, quality_model(spark, sf_dir), kept=["doc_id", "held_out"])


def op9_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper_extraction.extract(read_table(spark, sf_dir, "pages"))


def op10_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts.piece_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), kept=["doc_id"])


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, members = conversation_trie.ranked_turns(read_table(spark, sf_dir, "conversations"))
    return conversation_trie.prefix_trie(*conversation_trie.with_shared_heads(turns, members))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read_table(spark, sf_dir, "embeddings"))


def op13_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circulant_minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_repetition, op2_language_profiles, op3_blockmax_search, op4_huffman_store, op5_packing, op6_forest_join, op7_poisson_mix, op8_subword_quality,
    op9_wrapper_extraction, op10_piece_counts, op11_conversation_trie,
    op12_vector_codes, op13_circulant_minhash)}

_TOP = ", ".join(f"max(CASE WHEN n = {n} AND c > 1 THEN c * chars ELSE 0 END) AS top{n}_chars" for n in repetition.TOP_LIMITS)
_INSIDE = ", ".join(f"sum(CASE WHEN n = {n} AND cov THEN len ELSE 0 END) AS repeat{n}_chars" for n in repetition.REPEAT_LIMITS)
_LIMITS = " OR ".join([f"1000 * dup_line_chars > {repetition.LINE_LIMIT} * word_chars",
                       *(f"1000 * top{n}_chars > {limit} * word_chars" for n, limit in repetition.TOP_LIMITS.items()),
                       *(f"1000 * repeat{n}_chars > {limit} * word_chars" for n, limit in repetition.REPEAT_LIMITS.items())])
_MEASURES = ", ".join([*(f"coalesce(top{n}_chars, 0)::BIGINT AS top{n}_chars" for n in repetition.TOP_LIMITS),
                       *(f"coalesce(repeat{n}_chars, 0)::BIGINT AS repeat{n}_chars" for n in repetition.REPEAT_LIMITS)])

REPETITION_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
grams AS (
  SELECT rid, n, p, length(ws[p]) AS len, CASE WHEN p + n - 1 <= len(ws) THEN array_to_string(ws[p:p + n - 1], ' ') END AS gram
  FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS p FROM w), (SELECT unnest(range(2, 11)) AS n)),
counted AS (SELECT *, CASE WHEN gram IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY rid, n, gram) END AS c,
                   length(gram) - n + 1 AS chars FROM grams),
reach AS (SELECT *, max(CASE WHEN c > 1 THEN p + n - 1 ELSE 0 END) OVER (
                 PARTITION BY rid, n ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) >= p AS cov FROM counted),
per AS (SELECT rid, {_TOP}, {_INSIDE}, sum(CASE WHEN n = {repetition.WINDOW} AND cov THEN 1 ELSE 0 END) AS n_repeat_words
        FROM reach GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT rid, sum(c - 1) AS n_dup_lines, sum((c - 1) * length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS dup_line_chars
        FROM (SELECT rid, line, count(*) AS c FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL) GROUP BY rid),
base AS (
  SELECT d.doc_id, len(w.ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars, {_MEASURES}
  FROM d JOIN w USING (rid) LEFT JOIN per USING (rid) LEFT JOIN dup USING (rid))
SELECT *, n_words < {repetition.MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < {repetition.MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words OR {_LIMITS}) AS kept
FROM base
"""

# Poisson replication: the same hash, rates and inversion. Sums of doubles run in the order of k, as in the operator.
POISSON_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, text, source, (length(coalesce(text, '')) + 1)::BIGINT AS size,
                  coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, '')) AS ident FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS size FROM d GROUP BY source),
w AS (SELECT source, size, pow(size::DOUBLE, {poisson_mix.TEMPERATURE}) AS w FROM s),
r AS (SELECT source, 1.0::DOUBLE * (SELECT sum(size)::BIGINT FROM w) * w / ((SELECT sum(w) FROM w) * size) AS rate FROM w),
q AS (SELECT source, greatest(1, ceil(rate / {poisson_mix.PART}))::INT AS parts,
             rate / greatest(1, ceil(rate / {poisson_mix.PART})) AS mean FROM r),
cdf AS (SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM q
        UNION ALL SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < {poisson_mix.TERMS}),
draws AS (SELECT row_number() OVER () AS rid, d.*, parts FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
parts AS (SELECT rid, source, ('0x' || substr(md5('{poisson_mix.SEED}|n|' || ident || '|' || part), 1, 13))::BIGINT / {float(1 << 52)} AS u
          FROM (SELECT *, unnest(range(1, parts + 1)) AS part FROM draws)),
n AS (SELECT rid, count(*) AS n FROM parts JOIN cdf ON parts.source IS NOT DISTINCT FROM cdf.source AND cdf.c <= u GROUP BY rid)
SELECT doc_id, source, copy::INT AS copy,
       ('0x' || substr(md5('{poisson_mix.SEED}|o|' || ident || '|' || copy), 1, 13))::BIGINT / {float(1 << 52)} AS order_key,
       length(text)::BIGINT AS n_text_chars, md5(text) AS text_md5
FROM (SELECT draws.*, unnest(range(0, n)) AS copy FROM draws JOIN n USING (rid))
"""

ORACLES = {"op1_repetition": REPETITION_SQL, "op7_poisson_mix": POISSON_SQL}
