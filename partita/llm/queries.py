"""The operators' queries: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, divergence, html_extract, importance, lm_scoring, mixing, near_dedup, packing, pii, quality_classifier, quality_rules, sharding, token_counts
from .common import table

#: The vocabulary file of the packing query, by the name that public_tokenizers knows.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.kd_shards(table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_class_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = quality_classifier.remainder(5) == 1
    scored = lm_scoring.score(table(spark, sf_dir, "documents"), held_out)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.host_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.detect(docs, pii.train(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = quality_classifier.remainder(4) == 2
    scored = quality_classifier.score(docs, quality_classifier.train(docs, labels, ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality_classifier.THRESHOLD).cast("int").alias("predicted"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.train(pages))


def op9_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_kd_shards, op2_class_bigrams, op3_mix_sources, op4_host_rules, op5_pii, op6_pack, op7_quality, op8_main_text,
        op9_cross_polytope, op10_near_dedup, op11_source_audit, op12_importance, op13_token_counts,
    )
    return {f.__name__: f for f in found}


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), spans AS (
  SELECT doc_id, i, list_aggregate(list_slice(words, i, i + 4), 'string_agg', ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d WHERE len(words) >= 5)
), twice AS (
  SELECT doc_id, i FROM spans QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1
), covered AS (
  SELECT doc_id, sum(least(5, i - coalesce(before, -10))) AS n
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM twice)
  GROUP BY doc_id
), m AS (
  SELECT d.doc_id, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words
  FROM d LEFT JOIN covered USING (doc_id)
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR n_symbols > 0.1 * n_words
           OR n_dup_lines > 0.3 * n_lines
           OR (n_words > 0 AND NOT word_chars / greatest(n_words, 1) BETWEEN 2 AND 16) AS failed
  FROM m
), hosts AS (
  SELECT source, count(*) AS n, sum(failed::INT) AS f, sum(failed::INT) / count(*) AS rate FROM judged GROUP BY source
), prior AS (
  SELECT avg(rate) AS mean,
         CASE WHEN var_pop(rate) > 0
              THEN least(greatest(avg(rate) * (1 - avg(rate)) / var_pop(rate) - 1, 2), 10000) ELSE 10000 END AS weight
  FROM hosts
), verdicts AS (
  SELECT source, (f + mean * weight) / (n + weight) <= 0.5 AS host_ok FROM hosts, prior
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT failed AND host_ok AS kept
FROM judged JOIN verdicts ON judged.source IS NOT DISTINCT FROM verdicts.source
"""


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all({LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), o AS (
  SELECT r, lang, source, unnest(terms) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS c FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 10
), langs AS (
  SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), counts AS (
  SELECT lang, source, term, count(*) AS c FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL
), totals AS (
  SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN counts USING (lang, source) GROUP BY ALL
), shares AS (
  SELECT t.lang, t.source, k.term, coalesce(counts.c, 0) AS c,
         1 + (1000000000::HUGEINT * (coalesce(counts.c, 0) + 2)) // (t.n + 2 * v) AS p,
         1 + (1000000000::HUGEINT * (k.c + 2)) // (l.n + 2 * v) AS q
  FROM totals t JOIN langs l USING (lang) JOIN kept k USING (lang)
  LEFT JOIN counts ON counts.lang = t.lang AND counts.source = t.source AND counts.term = k.term
), apart AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM found QUALIFY part = 'pair' OR rank <= 10
"""

# CRC-32 of a word's bytes: one step a byte, by the table of the reflected polynomial.
OP12_SQL = rf"""
WITH steps AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS crc
  FROM range(256) AS t(i)
), words AS (
  SELECT true AS raw, doc_id, row_number() OVER () AS r, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
  UNION ALL
  SELECT false, NULL, NULL, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), features AS (
  SELECT raw, r, unnest(words) AS word FROM words
), hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(hex(word)), 2),
           lambda k: (strpos('0123456789ABCDEF', substr(hex(word), k, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(hex(word), k + 1, 1)) - 1)),
           lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM features), steps
), counts AS (
  SELECT bucket, count(*) FILTER (raw) AS s, count(*) FILTER (NOT raw) AS t FROM features JOIN hashed USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counts) + 10000)::DOUBLE / ((s + 1) * ((SELECT sum(t) FROM counts) + 10000)::DOUBLE)))::BIGINT AS gain FROM counts
), weights AS (
  SELECT r, sum(gain) AS gain FROM features JOIN hashed USING (word) JOIN gains USING (bucket) WHERE raw GROUP BY r
), noise AS (
  SELECT r, doc_id, len(words) AS n, list_reduce(list_transform(range(1, 9), lambda k: strpos('0123456789abcdef', substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), k, 1)) - 1), lambda x, y: x * 16 + y) AS h
  FROM words WHERE raw
), scored AS (
  SELECT doc_id, n, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM (SELECT doc_id, n, h, coalesce(gain // n - (CASE WHEN gain % n < 0 THEN 1 ELSE 0 END), 0)::BIGINT AS weight FROM noise LEFT JOIN weights USING (r))
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n >= 20) AS able FROM scored
)
SELECT doc_id, n::BIGINT AS n_features, weight, score, CASE WHEN n >= 20 AND place <= 10 * able // 100 THEN place END::BIGINT AS rank
FROM ranked
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_host_rules": OP4_SQL, "op11_source_audit": OP11_SQL, "op12_importance": OP12_SQL}
