"""Queries of feeds, lifts, ledgers, filters and small reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import patterns as pat
from tidewater.operators import feed, lift
from tidewater.plans.catalog import query
from tidewater.schema import posts, table
from tidewater.streaming import ledger

ONE = "*"
EPOCH_MS = 1288834974657  # fixed value: the first millisecond of time-ordered ids
FOUR_HOURS = 4 * 3600 * 1000


@query("G2_adjusted_lift", "WITH c AS (SELECT o_orderstatus AS topic, CAST(date_trunc('year', o_orderdate) AS DATE) AS year, o_orderpriority AS lang, count(*) AS n FROM orders GROUP BY ALL), t AS (SELECT year, lang, sum(n) AS n_all FROM c GROUP BY ALL), r AS (SELECT topic, lang, sum(n) / (SELECT sum(n_all) FROM t WHERE t.lang = c.lang) AS rate FROM c GROUP BY topic, lang), e AS (SELECT topic, year, sum(rate * n_all) AS expected FROM r JOIN t USING (lang) GROUP BY ALL) SELECT topic, year, CAST(sum(n) AS BIGINT) AS n, round(any_value(expected), 4) AS expected, round((sum(n) + 0.5) / (any_value(expected) + 0.5), 4) AS lift FROM c JOIN e USING (topic, year) GROUP BY topic, year")
def adjusted(spark: SparkSession, d: str) -> DataFrame:
    counts = posts(spark, d).groupBy(F.col("status").alias("topic"), F.trunc("day", "year").alias("year"), "lang").agg(F.count(ONE).alias("n"))
    totals = counts.groupBy("year", "lang").agg(F.sum("n").alias("n_all"))
    return lift.adjusted_lift(counts, totals, "topic", "year", "lang")


@query("G4_keyword_peak", "WITH c AS (SELECT o_orderpriority AS topic, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY ALL), t AS (SELECT month, sum(n) AS n_all FROM c GROUP BY ALL), s AS (SELECT topic, month, (n + 0.5) / (n_all + 1) AS share FROM c JOIN t USING (month)), k AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY share DESC, month) AS r, median(share) OVER (PARTITION BY topic) AS mid FROM s) SELECT topic, month AS peak, round(share / mid, 4) AS lift FROM k WHERE r = 1")
def keyword_peak(spark: SparkSession, d: str) -> DataFrame:
    counts = posts(spark, d).groupBy(F.col("lang").alias("topic"), F.trunc("day", "month").alias("month")).agg(F.count(ONE).alias("n"))
    return lift.peak_against_median(counts, counts.groupBy("month").agg(F.sum("n").alias("n_all")), "topic", "month")


@query("G5_discovery_lift", "WITH w AS (SELECT DISTINCT doc_id, source = 'src1' AS core, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS token FROM documents), z AS (SELECT count(DISTINCT doc_id) FILTER (WHERE core) AS a, count(DISTINCT doc_id) FILTER (WHERE NOT core) AS b FROM w), g AS (SELECT token, count(*) FILTER (WHERE core) AS n_core, count(*) FILTER (WHERE NOT core) AS n_rest FROM w GROUP BY token) SELECT token, n_core, n_rest, round(((n_core + 0.5) / (a + 1)) / ((n_rest + 0.5) / (b + 1)), 4) AS lift FROM g, z WHERE n_core >= 3")
def discovery(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), (F.col("source") == "src1").alias("core"), F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{3,})"), F.lit(1))).alias("token"))
    return lift.discovered(words, "core", 3)


@query("T10_shortlist", "WITH f AS (SELECT doc_id, source, n_chars, left(trim(regexp_replace(regexp_replace(lower(text), 'https?://\\S+', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), 100) AS fold FROM documents), b AS (SELECT *, count(*) OVER (PARTITION BY fold) - 1 AS echoes, row_number() OVER (PARTITION BY fold ORDER BY n_chars DESC, doc_id) AS r FROM f), a AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM b WHERE r = 1) SELECT doc_id, source, n_chars, echoes FROM a WHERE k <= 2 ORDER BY n_chars DESC, doc_id LIMIT 30")
def shortlist(spark: SparkSession, d: str) -> DataFrame:
    return feed.shortlist(table(spark, d, "documents"), "doc_id", pat.folded(F.col("text")), "source", "n_chars")


@query("T2_T3_T9_sort_modes", "WITH r AS (SELECT c_custkey AS id, c_nationkey AS likes, c_acctbal / 10000 AS score FROM customer) " + " UNION ALL ".join(f"(SELECT id, '{m}' AS mode FROM r ORDER BY {o}, id LIMIT 50)" for m, o in (("likes", "likes DESC"), ("negative", "score"), ("positive", "score DESC"), ("low_confidence", "abs(score)"), ("random", "md5(CAST(id AS VARCHAR))"))))
def sort_modes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("likes"), (F.col("c_acctbal") / 10000).alias("score"))
    return reduce(DataFrame.unionByName, (feed.page(rows, m).select("id", "mode") for m in ("likes", "negative", "positive", "low_confidence", "random")))


@query("T12_recent_pool", "SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 200")
def recent(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").orderBy(F.desc("ts"), "event_id").limit(200).select("event_id")


@query("T11_T13_evidence_order", "SELECT o_orderkey AS id FROM orders ORDER BY floor(o_totalprice) DESC, o_orderstatus, o_orderdate DESC, o_orderkey LIMIT 30")
def evidence(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).orderBy(F.desc("likes"), "status", F.desc("created_at"), "id").limit(30).select("id")


@query("T8_two_tiers", "SELECT 'exact' AS tier, count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def two_tiers(spark: SparkSession, d: str) -> DataFrame:
    rows = posts(spark, d)
    chosen = feed.tier(rows.count())
    few = rows if chosen == "exact" else rows.where(F.conv(F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 100 == 0)
    return few.where("status = 'F'").agg(F.lit(chosen).alias("tier"), (F.count(ONE) * (1 if chosen == "exact" else 100)).alias("n"))


@query("K10_bounded_frames", "WITH f AS (SELECT CAST(ts AS DATE) AS scope, ts, (row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) - 1) // 100 AS frame FROM events) SELECT scope, frame, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM f GROUP BY scope, frame")
def bounded(spark: SparkSession, d: str) -> DataFrame:
    return feed.frames(table(spark, d, "events"), F.to_date("ts"), 100)


@query("Z20_replay_clock", "WITH w AS (SELECT (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 1000000.0 / 3600 AS x FROM events), p AS (SELECT CASE WHEN x > 12 THEN x + 6 ELSE x END AS x FROM w) SELECT CAST(floor(x) AS BIGINT) AS tick, count(*) AS n FROM p GROUP BY 1")
def replay(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    seconds = (F.col("us") - events.agg(F.min("us")).scalar()) / 1_000_000.0
    return events.select(F.floor(feed.delivery(seconds, 3600, [(12, 18)])).alias("tick")).groupBy("tick").agg(F.count(ONE).alias("n"))


@query("Z8_Z11_completion_feed", "WITH l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id), e AS (SELECT DISTINCT source, doc_id, quality FROM documents JOIN l USING (doc_id) WHERE toxic IS DISTINCT FROM 1) SELECT source, doc_id, quality, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS cursor FROM e WHERE source IS NOT NULL")
def completion(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = table(spark, d, "documents").where("source is not null").select("source", "doc_id")
    had = docs.join(labels.where("toxic = 1"), "doc_id").select("source", "doc_id")
    return feed.ready(docs, labels.select("doc_id", "quality"), had, "source", "doc_id").select("source", "doc_id", "quality", "cursor")


@query("Z10_work_by_text", "WITH c AS (SELECT DISTINCT sha256(text) AS h FROM conversations) SELECT sha256(text) AS work, min(doc_id) AS doc_id, count(*) AS waiting FROM documents WHERE text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c WHERE h = sha256(documents.text)) GROUP BY 1")
def work(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "conversations").select(F.sha2("text", 256).alias("work")).distinct()
    new = table(spark, d, "documents").where("text is not null").select(F.sha2("text", 256).alias("work"), "doc_id")
    return new.groupBy("work").agg(F.min("doc_id").alias("doc_id"), F.count(ONE).alias("waiting")).join(known, "work", "left_anti")


@query("Z1_idempotent_append", "SELECT event_id AS seq FROM events WHERE event_type <> 'view'")
def append(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.sha2("props", 256).alias("hash"), "event_type")
    log = rows.where("event_type = 'view'").select("seq", "hash")
    return ledger.fresh(rows.select("seq", "hash").unionByName(log), log).select("seq")


@query("Z2_current_posts", "SELECT user_id AS post, arg_max(props, event_id) AS text, min(event_id) AS first_seq, max(event_id) AS last_seq FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def current(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "delete").otherwise("update")
    return ledger.latest_posts(table(spark, d, "events").select(F.col("user_id").alias("post"), F.col("event_id").alias("seq"), op.alias("operation"), F.col("props").alias("text")))


@query("Z3_like_ledger", "WITH n AS (SELECT event_id, user_id, CASE WHEN event_type <> 'error' THEN event_type END AS now FROM events), m AS (SELECT *, lag(now) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM n), x AS (SELECT was AS subject, -1 AS delta FROM m WHERE was IS DISTINCT FROM now UNION ALL SELECT now, 1 FROM m WHERE was IS DISTINCT FROM now) SELECT subject, count(*) AS moves, CAST(sum(delta) AS BIGINT) AS balance FROM x WHERE subject IS NOT NULL GROUP BY subject")
def likes(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "delete").otherwise("create")
    rows = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("like"), op.alias("operation"), F.col("event_type").alias("subject"))
    return ledger.like_deltas(rows).groupBy("subject").agg(F.count(ONE).alias("moves"), F.sum("delta").alias("balance"))


@query("Z5_account_deletes", "WITH g AS (SELECT user_id, max(event_id) FILTER (WHERE event_type = 'error') AS gone FROM events GROUP BY user_id) SELECT user_id, count(*) FILTER (WHERE event_id <= gone) AS dropped, count(*) FILTER (WHERE gone IS NULL OR event_id > gone) AS live FROM events JOIN g USING (user_id) GROUP BY user_id")
def deletes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    gone = rows.where("event_type = 'error'").groupBy("user_id").agg(F.max("event_id").alias("gone"))
    both = rows.select("user_id", "event_id").join(gone, "user_id", "left")
    return both.groupBy("user_id").agg(F.count_if(F.expr("event_id <= gone")).alias("dropped"), F.count_if(F.expr("gone is null or event_id > gone")).alias("live"))


@query("Z23_interest_tags", "WITH k(topic, p) AS (VALUES ('law', '(?i)licen[cs]e'), ('abuse', '(?i)idiot|moron'), ('the', '(?i)\\bthe\\b')) SELECT topic, source, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS heat FROM documents JOIN k ON regexp_matches(text, p) GROUP BY topic, source")
def tags(spark: SparkSession, d: str) -> DataFrame:
    topics = {"law": "(?i)licen[cs]e", "abuse": "(?i)idiot|moron", "the": pat.whole_word("the")}
    hit = F.filter(F.array(*[F.when(F.col("text").rlike(p), t) for t, p in topics.items()]), lambda x: x.isNotNull())
    return table(spark, d, "documents").select("source", "n_chars", F.explode(hit).alias("topic")).groupBy("topic", "source").agg(F.count(ONE).alias("docs"), F.sum("n_chars").alias("heat"))


@query("G22_sentence_budget", "WITH s AS (SELECT doc_id, string_split(text, '. ') AS p FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, i, len(string_split(p[i], ' ')) AS n FROM s, unnest(range(1, len(p) + 1)) AS t(i)), r AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS total FROM u) SELECT doc_id, count(*) FILTER (WHERE total <= 40) AS kept, CAST(coalesce(sum(n) FILTER (WHERE total <= 40), 0) AS BIGINT) AS words FROM r GROUP BY doc_id")
def sentences(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").where("text is not null").select("doc_id", feed.clipped(F.col("text"), 40).alias("x"))
    return x.select("doc_id", F.col("x.kept").cast("long").alias("kept"), F.col("x.n").cast("long").alias("words"))


@query("V14_measure", "WITH l AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) SELECT lang, count(*) AS n, round(avg(toxic), 6) AS plain, round(sum(toxic * ln(1 + n_chars)) / sum(ln(1 + n_chars)), 6) AS weighted FROM documents JOIN l USING (doc_id) WHERE toxic IS NOT NULL GROUP BY lang")
def measure(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic is not null")
    w = F.log1p("n_chars")
    return table(spark, d, "documents").join(labels, "doc_id").groupBy("lang").agg(F.count(ONE).alias("n"), F.round(F.avg("toxic"), 6).alias("plain"), F.round(F.sum(F.col("toxic") * w) / F.sum(w), 6).alias("weighted"))


@query("V11_search", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\\bthe\\b') ORDER BY doc_id DESC LIMIT 100")
def search(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").rlike(pat.whole_word("the"))).orderBy(F.desc("doc_id")).limit(100).select("doc_id")


@query("F4_hashtag", "SELECT page_id FROM pages WHERE regexp_matches(html, '(?i)#top(?:[^A-Za-z0-9_]|$)')")
def hashtags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").where(F.col("html").rlike(pat.hashtag("top"))).select("page_id")


@query("F8_attributes", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery') AND c_acctbal IS NOT NULL")
def attributes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where(F.lower("c_mktsegment").isin("building", "machinery") & F.col("c_acctbal").isNotNull()).select("c_custkey")


@query("F9_F24_F25_originals", "SELECT conv_id AS id, turn, CAST(NULL AS VARCHAR) AS lang FROM conversations WHERE NOT starts_with(text, 'RT @') AND coalesce(role, '') = 'user'")
def originals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").where(~F.col("text").startswith("RT @") & (F.coalesce("role", F.lit("")) == "user"))
    return rows.drop("text", "role").select(F.col("conv_id").alias("id"), "turn", F.lit(None).cast("string").alias("lang"))


@query("F12_F20_live_words", "SELECT doc_id, regexp_matches(text, '(?i)(^|[^\\pL\\pN_])(?:idiot|scum)($|[^\\pL\\pN_])') AS any_of, regexp_matches(text, '(?i)\\bthe\\b') AND regexp_matches(text, '(?i)\\band\\b') AS all_of FROM documents")
def live_words(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.rlike(pat.live_terms(["idiot", "scum"])).alias("any_of"), (text.rlike(pat.whole_word("the")) & text.rlike(pat.whole_word("and"))).alias("all_of"))


@query("F15_F16_F17_F18_gates", "WITH l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) SELECT doc_id FROM documents LEFT JOIN l USING (doc_id) WHERE q IS NOT NULL AND q >= 1 AND (lang IS NULL OR lang IN ('en', 'de')) AND (source = 'src1' OR regexp_matches(text, '(?i)\\bthe\\b'))")
def gates(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q")).where("q is not null and q >= 1")
    rows = table(spark, d, "documents").where((F.col("lang").isNull() | F.col("lang").isin("en", "de")) & ((F.col("source") == "src1") | F.col("text").rlike(pat.whole_word("the"))))
    return rows.join(labels, "doc_id").select("doc_id")


@query("F19_exclusion", "WITH n AS (SELECT doc_id, source, text, trim(regexp_replace(regexp_replace(lower(text), 'https?://\\S+|@[A-Za-z0-9_]+', ' ', 'g'), '\\s+', ' ', 'g')) AS k FROM documents) SELECT doc_id FROM n WHERE NOT regexp_matches(text, '(?i)licensed') AND source <> 'src1' AND NOT EXISTS (SELECT 1 FROM n AS p WHERE p.source = 'src1' AND p.k = n.k)")
def exclusion(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source", "text", pat.template(F.col("text")).alias("k"))
    return rows.where(~F.col("text").rlike(pat.substring("licensed")) & (F.col("source") != "src1")).join(rows.where("source = 'src1'").select("k"), "k", "left_anti").select("doc_id")


@query("J5_J18_parent_lookup", "SELECT o_orderpriority AS lang, count(*) AS likes, CAST(sum(l_quantity) AS BIGINT) AS delta FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderdate <= l_shipdate GROUP BY o_orderpriority")
def parent(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_quantity")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.col("o_orderpriority").alias("lang"))
    both = lines.join(orders, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("o_orderdate") <= F.col("l_shipdate")), "left")
    return both.groupBy("lang").agg(F.count(ONE).alias("likes"), F.sum("l_quantity").cast("long").alias("delta"))


@query("J20_Z4_context", "WITH p AS (SELECT user_id, arg_min(props, event_id) AS context FROM events WHERE event_type = 'signup' GROUP BY user_id) SELECT event_id, context FROM events LEFT JOIN p USING (user_id) WHERE event_type = 'click'")
def context(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    first = rows.where("event_type = 'signup'").groupBy("user_id").agg(F.min_by("props", "event_id").alias("context"))
    return rows.where("event_type = 'click'").select("event_id", "user_id").join(first, "user_id", "left").select("event_id", "context")


@query("A16_A17_lists", "SELECT o_orderpriority AS lang, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS states, arg_min(o_orderstatus, o_orderkey) AS a_state FROM orders GROUP BY 1")
def lists(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).groupBy("lang").agg(F.array_join(F.sort_array(F.collect_set("status")), ",").alias("states"), F.min_by("status", "id").alias("a_state"))


@query("A21_label_totals", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def label_totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count(ONE).alias("n"))


@query("A29_single_day_topics", "WITH t AS (SELECT o_custkey, count(DISTINCT CAST(o_orderdate AS DATE)) AS days FROM orders GROUP BY 1) SELECT count(*) AS topics, count(*) FILTER (WHERE days = 1) AS single_day FROM t")
def single_day(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).groupBy("author_id").agg(F.count_distinct("day").alias("days")).agg(F.count(ONE).alias("topics"), F.count_if(F.col("days") == 1).alias("single_day"))


@query("A32_D6_snapshot_buckets", "SELECT event_type AS target, epoch_us(ts) // 14400000000 * 14400000 AS bucket, count(*) AS n, round(sum(1 + ln(1 + value)), 4) AS weight, round(sum((1 + ln(1 + value)) * value) / sum(1 + ln(1 + value)), 4) AS mean FROM events GROUP BY ALL")
def snapshot_buckets(spark: SparkSession, d: str) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    w = F.log1p("value") + 1
    rows = table(spark, d, "events").groupBy(F.col("event_type").alias("target"), (F.floor(ms / FOUR_HOURS) * FOUR_HOURS).alias("bucket"))
    return rows.agg(F.count(ONE).alias("n"), F.round(F.sum(w), 4).alias("weight"), F.round(F.sum(w * F.col("value")) / F.sum(w), 4).alias("mean"))


@query("A33_spread", "WITH m AS (SELECT p_brand, sum(p_size) AS w, sum(p_size * p_retailprice) / sum(p_size) AS m, sum(p_size * p_retailprice * p_retailprice) AS q FROM part GROUP BY 1) SELECT p_brand AS target, round(sqrt(greatest(0, q / w - m * m)), 3) AS spread FROM m")
def spread(spark: SparkSession, d: str) -> DataFrame:
    w, x = F.col("p_size"), F.col("p_retailprice")
    mean = F.sum(w * x) / F.sum(w)
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("target")).agg(F.round(F.sqrt(F.greatest(F.lit(0.0), F.sum(w * x * x) / F.sum(w) - mean * mean)), 3).alias("spread"))


@query("A36_type_totals", "WITH i AS (SELECT l_returnflag AS type, l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) SELECT type, count(*) AS posts, CAST(sum(n) AS BIGINT) AS observations, count(*) FILTER (WHERE n > 1) AS repeated FROM i GROUP BY type")
def type_totals(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("type"), "l_orderkey").agg(F.count(ONE).alias("n"))
    return ids.groupBy("type").agg(F.count(ONE).alias("posts"), F.sum("n").alias("observations"), F.count_if(F.col("n") > 1).alias("repeated"))


@query("A37_unpivoted_metrics", "WITH u AS (UNPIVOT (SELECT l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME metric VALUE x) SELECT metric, count(*) AS n, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS mid, max(x) AS top FROM u GROUP BY metric")
def unpivoted(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "lineitem").unpivot([], ["l_quantity", "l_discount", "l_tax"], "metric", "x")
    return u.groupBy("metric").agg(F.count("x").alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.percentile("x", F.lit(0.5)), 6).alias("mid"), F.max("x").alias("top"))


@query("A40_hours_histogram", "WITH a AS (SELECT CAST(floor((SELECT max(epoch_us(ts)) FROM events) - epoch_us(ts)) AS BIGINT) // 3600000000 AS age FROM events), h AS (SELECT age, count(*) AS n FROM a WHERE age < 48 GROUP BY age) SELECT CAST(g AS BIGINT) AS age, coalesce(n, 0) AS n FROM range(48) AS t(g) LEFT JOIN h ON age = g")
def hours(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    ages = rows.select(F.floor((rows.agg(F.max("us")).scalar() - F.col("us")) / 3_600_000_000).alias("age")).where("age < 48").groupBy("age").agg(F.count(ONE).alias("n"))
    return spark.range(48).withColumnRenamed("id", "age").join(ages, "age", "left").select("age", F.coalesce("n", F.lit(0)).alias("n"))


@query("A41_queue_status", "SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS waiting, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 0), 2) AS reserved FROM orders")
def queue_status(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").agg(F.count_if(s == "O").alias("waiting"), F.count_if(s == "F").alias("done"), F.round(F.coalesce(F.sum(F.when(s == "P", F.col("o_totalprice"))), F.lit(0.0)), 2).alias("reserved"))


@query("A44_feeling_counts", "SELECT c_mktsegment AS target, round(avg(c_acctbal / 10000), 6) AS mean, count(*) FILTER (WHERE c_acctbal / 10000 > 0.25) AS positive, count(*) FILTER (WHERE c_acctbal / 10000 < -0.25) AS negative, count(*) FILTER (WHERE abs(c_acctbal / 10000) <= 0.25) AS neutral FROM customer GROUP BY 1")
def feelings(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("c_acctbal") / 10000
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("target")).agg(F.round(F.avg(s), 6).alias("mean"), F.count_if(s > 0.25).alias("positive"), F.count_if(s < -0.25).alias("negative"), F.count_if(F.abs(s) <= 0.25).alias("neutral"))


@query("X1_X2_text_functions", "SELECT page_id, lower(trim(url)) AS low, CAST(length(url) AS INT) AS n, left(url, 20) AS head, starts_with(url, 'https') AS safe, contains(url, 'page=') AS paged, regexp_matches(url, '[0-9]{3}') AS numbered FROM pages")
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.lower(F.trim(u)).alias("low"), F.length(u).alias("n"), F.left(u, F.lit(20)).alias("head"), u.startswith("https").alias("safe"), u.contains("page=").alias("paged"), u.rlike("[0-9]{3}").alias("numbered"))


@query("X5_X6_X10_normal_forms", "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://\\S+', ' ', 'g'), '@[A-Za-z0-9_]+', ' ', 'g'), '\\s+', ' ', 'g'))) AS plain, md5(trim(regexp_replace(regexp_replace(lower(text), 'https?://\\S+|@[A-Za-z0-9_]+', ' ', 'g'), '\\s+', ' ', 'g'))) AS template, md5(translate(lower(nfc_normalize(text)), '‐‑‒–—−', '------')) AS composed FROM documents")
def normal_forms(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", *[F.md5(x.cast("binary")).alias(n) for n, x in (("plain", pat.plain(t)), ("template", pat.template(t)), ("composed", pat.dash_folded(pat.composed(t))))])


@query("D4_D5_ids_and_times", f"WITH i AS (SELECT event_id, ts, epoch_us(ts) // 1000 AS ms, ((epoch_us(ts) // 1000 - {EPOCH_MS}) << 22) + (event_id & 4194303) AS id FROM events) SELECT event_id, id, (id >> 22) + {EPOCH_MS} AS ms, (id >> 22) + {EPOCH_MS} <> ms AS mismatch, epoch(date_trunc('second', ts)) :: BIGINT AS parsed FROM i")
def ids_and_times(spark: SparkSession, d: str) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = table(spark, d, "events").select("event_id", ms.alias("t"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("text"), (F.shiftleft(ms - EPOCH_MS, 22) + F.col("event_id").bitwiseAND(F.lit(4194303))).alias("id"))
    back = F.shiftright("id", 22) + EPOCH_MS
    return rows.select("event_id", "id", back.alias("ms"), (back != F.col("t")).alias("mismatch"), F.unix_timestamp(F.try_to_timestamp("text")).alias("parsed"))


@query("N1_N2_N3_N4_N6_arithmetic", "SELECT p_partkey, round(log2((p_size + 0.5) / 10.5) * ln(1 + p_retailprice), 6) AS burst, round(100000.0 * p_size / p_retailprice, 6) AS per_100k, greatest(-1, least(1, 2 * (p_size / 10.0) / 4 - 1)) AS scaled, CAST(p_size + 2 * p_size + 2 * floor(p_retailprice) AS BIGINT) AS engagement, TRY_CAST(right(p_brand, 2) AS INT) AS brand FROM part")
def arithmetic(spark: SparkSession, d: str) -> DataFrame:
    size, price = F.col("p_size"), F.col("p_retailprice")
    return table(spark, d, "part").select(
        "p_partkey", F.round(F.log2((size + 0.5) / 10.5) * F.log1p(price), 6).alias("burst"), F.round(100000.0 * size / price, 6).alias("per_100k"),
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (size / 10) / 4 - 1)).alias("scaled"), (size + 2 * size + 2 * F.floor(price)).alias("engagement"), F.right("p_brand", F.lit(2)).try_cast("int").alias("brand"),
    )


@query("R3_struct_order", "WITH r AS (SELECT l_orderkey, l_quantity, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber DESC) AS k FROM lineitem) SELECT l_orderkey, l_quantity, l_linenumber FROM r WHERE k = 1")
def struct_order(spark: SparkSession, d: str) -> DataFrame:
    top = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max(F.struct("l_quantity", "l_linenumber")).alias("x"))
    return top.select("l_orderkey", "x.*")


@query("R5_guarded_records", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE json_valid(props) AND TRY_CAST(json_extract_string(props, '$.k') AS INT) > 50")
def guarded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int", {"mode": "PERMISSIVE"})["k"].alias("k")).where("k > 50")
