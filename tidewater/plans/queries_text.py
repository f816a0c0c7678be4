"""Queries of text: terms, tokens, normal forms, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import patterns as pat
from tidewater.operators import facts
from tidewater.plans.catalog import query
from tidewater.schema import table


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query("F2_substring_term", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)tion\\.')")
def substring(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).where(F.col("text").rlike(pat.substring("tion."))).select("doc_id")


@query("F3_word_term", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\\bidiot\\b')")
def word(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).where(F.col("text").rlike(pat.whole_word("idiot"))).select("doc_id")


@query("F14_A30_keyword_hits", "WITH k(keyword, p) AS (VALUES ('idiot', '(?i)\\bidiot\\b'), ('licensed', '(?i)licensed'), ('the', '(?i)\\bthe\\b')) SELECT keyword, count(*) AS docs, count(DISTINCT source) AS sources, CAST(sum(n_chars) AS BIGINT) AS chars, round(count(*) FILTER (WHERE lang = 'en') / CAST(count(*) AS DOUBLE), 6) AS english FROM documents JOIN k ON regexp_matches(text, p) GROUP BY keyword")
def keywords(spark: SparkSession, d: str) -> DataFrame:
    hits = facts.keyword_hits(docs(spark, d), "text", {"idiot": pat.whole_word("idiot"), "licensed": pat.substring("licensed"), "the": pat.whole_word("the")}, {"idiot": "idiot", "licensed": "licensed", "the": "the"})
    return hits.groupBy("keyword").agg(F.count(F.lit(1)).alias("docs"), F.count_distinct("source").alias("sources"), F.sum("n_chars").alias("chars"), F.round(F.count_if(F.col("lang") == "en") / F.count(F.lit(1)), 6).alias("english"))


@query("F13_A38_tiered_screening", "WITH s AS (SELECT doc_id, regexp_matches(text, '(?i)\\bidiot\\b') AS direct, regexp_matches(text, '(?i)\\bclown\\b') AS ambiguous, regexp_matches(text, '(?i)\\btrash\\b') AND regexp_matches(text, '(?i)\\bthe\\b') AS contextual FROM documents) SELECT count(*) FILTER (WHERE direct) AS direct, count(*) FILTER (WHERE ambiguous AND NOT direct AND NOT contextual) AS ambiguous_only, count(*) FILTER (WHERE contextual) AS contextual, count(*) FILTER (WHERE direct OR ambiguous OR contextual) AS any_tier FROM s")
def screening(spark: SparkSession, d: str) -> DataFrame:
    low = pat.dash_folded(F.col("text"))
    w = lambda t: low.rlike(pat.whole_word(t))
    s = docs(spark, d).select(w("idiot").alias("direct"), w("clown").alias("ambiguous"), (w("trash") & w("the")).alias("contextual"))
    return s.agg(F.count_if("direct").alias("direct"), F.count_if(F.expr("ambiguous and not direct and not contextual")).alias("ambiguous_only"), F.count_if("contextual").alias("contextual"), F.count_if(F.expr("direct or ambiguous or contextual")).alias("any_tier"))


@query("F10_two_stage_match", "SELECT doc_id FROM documents WHERE regexp_matches(regexp_replace(text, 'https?://\\S+', ' ', 'g'), '(?i)\\bscum\\b')")
def two_stage(spark: SparkSession, d: str) -> DataFrame:
    cheap = docs(spark, d).where(F.lower("text").contains("scum"))
    return cheap.where(F.regexp_replace("text", r"https?://\S+", " ").rlike(pat.whole_word("scum"))).select("doc_id")


@query("F21_first_matching_filter", "SELECT doc_id, CASE WHEN contains(lower(text), 'moron') THEN 'moron' WHEN contains(lower(text), 'loser') THEN 'loser' END AS first_match FROM documents")
def first_match(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("text")
    return docs(spark, d).select("doc_id", F.coalesce(*[F.when(low.contains(t), t) for t in ("moron", "loser")]).alias("first_match"))


@query("X4_J10_R6_token_counts", "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{2,}')) AS token FROM documents) SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM w GROUP BY token HAVING count(*) >= 40")
def tokens(spark: SparkSession, d: str) -> DataFrame:
    w = docs(spark, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{2,})"), F.lit(1))).alias("token"))
    return w.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs")).where("n >= 40")


@query("A24_duplicate_text_share", "WITH n AS (SELECT trim(regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://\\S+', ' ', 'g'), '@[A-Za-z0-9_]+', ' ', 'g'), '\\s+', ' ', 'g')) AS k FROM documents), g AS (SELECT k, count(*) AS n FROM n GROUP BY k) SELECT CAST(sum(n) AS BIGINT) AS texts, CAST(sum(n - 1) AS BIGINT) AS duplicates, max(n) AS largest FROM g")
def duplicates(spark: SparkSession, d: str) -> DataFrame:
    g = docs(spark, d).groupBy(F.xxhash64(pat.plain(F.col("text"))).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.sum("n").alias("texts"), F.sum(F.col("n") - 1).alias("duplicates"), F.max("n").alias("largest"))


@query("X3_X7_echo_fold", "SELECT doc_id, left(trim(regexp_replace(regexp_replace(lower(text), 'https?://\\S+', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), 100) AS folded FROM documents")
def folded(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", pat.folded(F.col("text")).alias("folded"))


@query("X11_alnum_key", "SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS k FROM part")
def alnum(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", pat.key(F.col("p_name")).alias("k"))


URL = "regexp_replace(regexp_replace(lower(regexp_extract(u, '^[a-zA-Z]+://([^/?]*)', 1)), '^www\\.', ''), '$', '') || regexp_replace(regexp_extract(u, '^[a-zA-Z]+://[^/?]*([^?]*)', 1), '/$', '') || CASE WHEN q = '' THEN '' ELSE '?' || q END"
CANON = f"SELECT page_id, {URL} AS link FROM (SELECT page_id, u, array_to_string(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_')), '&') AS q FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages))"


@query("X12_canonical_url", CANON)
def canonical(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", pat.canonical_url(F.col("url")).alias("link"))


@query("A39_shared_links", f"SELECT link, count(*) AS n FROM ({CANON}) GROUP BY link HAVING count(*) >= 2")
def shared(spark: SparkSession, d: str) -> DataFrame:
    return canonical(spark, d).groupBy("link").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("X14_X15_octets_and_hash", "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, sha256(text) AS digest FROM documents")
def octets(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("digest"))


@query("R7_G3_ngram_frequency", "WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{2,}') AS w FROM documents), g AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS gram FROM w, unnest(range(1, len(w))) AS t(i)) SELECT gram, count(*) AS docs FROM g GROUP BY gram HAVING count(*) >= 25")
def ngrams(spark: SparkSession, d: str) -> DataFrame:
    w = docs(spark, d).select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{2,})"), F.lit(1)).alias("w"))
    pairs = F.expr("CASE WHEN size(w) < 2 THEN CAST(array() AS array<string>) ELSE transform(array(w), w -> array_distinct(transform(sequence(0, size(w) - 2), i -> concat(w[i], ' ', w[i + 1]))))[0] END")
    return w.select(F.explode(pairs).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("docs")).where("docs >= 25")


@query("R4_json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_valid(props) AS ok FROM events")
def json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.try_parse_json("props").isNotNull().alias("ok"))


@query("D1_D2_D3_time_parts", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, epoch_ms(o_orderdate) AS ms, CAST(date_diff('second', TIMESTAMP '1992-01-01', o_orderdate) AS BIGINT) AS seconds FROM orders")
def times(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("o_orderdate").cast("timestamp")
    return table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.unix_millis(t).alias("ms"), (F.unix_seconds(t) - F.unix_seconds(F.lit("1992-01-01").cast("timestamp"))).alias("seconds"))


@query("R1_U6_list_functions", "SELECT p_partkey, list_sort(list_distinct(string_split(p_name, ' '))) AS words, len(string_split(p_name, ' ')) AS n FROM part")
def lists(spark: SparkSession, d: str) -> DataFrame:
    w = F.split("p_name", " ")
    return table(spark, d, "part").select("p_partkey", F.array_sort(F.array_distinct(w)).alias("words"), F.size(w).cast("long").alias("n"))


@query("J15_R2_dictionary_lookup", "SELECT p_partkey, MAP {'SMALL': 1, 'LARGE': 2, 'STANDARD': 3}[split_part(p_type, ' ', 1)] AS size_class FROM part")
def lookup(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(*[F.lit(x) for kv in {"SMALL": 1, "LARGE": 2, "STANDARD": 3}.items() for x in kv])
    return table(spark, d, "part").select("p_partkey", F.try_element_at(m, F.split_part("p_type", F.lit(" "), F.lit(1))).alias("size_class"))
