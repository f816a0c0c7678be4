"""The queries opN_<name>: each operator over its whole table with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import byte_bpe, decontaminate, language_id, line_templates, quality_rules, quality_zstd, simhash, substring_dedup, toxicity, url_filter
from tidewater.llm.common import fold, table

URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def held_out(folds: int, fold_: int) -> Column:
    """Whether the id is in the fold; false for a null id, which no label has and nothing is learnt from."""
    return F.coalesce(fold("doc_id", folds) == fold_, F.lit(False)).alias("held_out")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.find(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.decide(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_zstd.train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return quality_zstd.score(docs, model).select("doc_id", held_out(5, 0), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs.select("doc_id", "text"), language_id.train(docs, fold("doc_id", 4) != 2))
    return found.select("doc_id", held_out(4, 2), "lang_pred", F.col("lang_score").alias("score"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).drop("rejected_by")


def tokenized(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return byte_bpe.tokenize(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokenized(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_templates.dedupe(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return toxicity.score(docs, model).select("doc_id", held_out(3, 1), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.group(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_substring_dedup, op2_url_filter, op3_quality_classifier, op4_language_id, op5_decontamination, op6_quality_rules, op7_byte_bpe, op8_line_dedup, op9_toxicity, op10_simhash)
}

SQL: dict[str, str] = {
    "op2_url_filter": r"""
WITH rules(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
split AS (
  SELECT row_number() OVER () AS r, page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
fit AS (
  SELECT r, page_id, host, path, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY r ORDER BY length(rh || rp) DESC NULLS LAST) AS k
  FROM split LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit WHERE k = 1""",
    "op6_quality_rules": r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, string_split(text, chr(10)) AS every,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM docs),
grams AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM parts, unnest(range(1, len(w) - 1)) AS t(i)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM grams),
covered AS (SELECT r, count(DISTINCT i + d) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS o(d) WHERE n > 1 GROUP BY r),
base AS (
  SELECT doc_id, text, every, len(w) AS n_words, length(list_aggregate(list_append(w, ''), 'string_agg', '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM parts LEFT JOIN covered USING (r)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 5 * n_symbols > 2 * n_words
    OR 10 * n_dup_lines > 3 * n_lines OR 10 * n_repeat_words > 4 * n_words
    OR 2 * (length(text) - length(replace(text, '!', ''))) > n_words
    OR 2 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > word_chars
    OR 10 * length(regexp_replace(text, '[^\p{L}]', '', 'g')) < 6 * word_chars
    OR (n_words > 200 AND n_lines * 2 > n_words)
    OR len(list_filter(every, lambda x: regexp_matches(ltrim(x), '^[-*' || chr(8226) || ']'))) * 10 > 9 * n_lines
    OR (len(list_filter(every, lambda x: regexp_matches(rtrim(x), '(\.\.\.|' || chr(8230) || ')$'))) * 10 > 3 * n_lines AND n_lines > 2)) AS kept
FROM judged""",
}
