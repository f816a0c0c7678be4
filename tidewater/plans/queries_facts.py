"""Queries of aggregates, rankings and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import facts, statistics
from tidewater.plans.catalog import query
from tidewater.plans.queries_relational import OBS, POSTS
from tidewater.schema import observations, posts, table

DAYS = f"p AS ({POSTS}), den AS (SELECT day, count(*) AS all_tweets FROM p GROUP BY day), days AS (SELECT * FROM den WHERE day <> (SELECT max(day) FROM p)), fact AS (SELECT lang AS topic, day, count(*) AS tweets, count(DISTINCT author_id) AS authors, CAST(sum(likes) AS BIGINT) AS likes FROM p GROUP BY lang, day)"


def _facts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = posts(spark, d)
    return facts.topic_days(rows, F.array("lang")), facts.denominators(rows).where("lang = '<ALL>'")


@query("A1_quality_profile", f"WITH p AS ({POSTS}) SELECT count(*) AS n, count(DISTINCT id) AS n_keys, count(*) FILTER (WHERE likes IS NULL) AS nulls_likes, min(likes) AS min_likes, max(likes) AS max_likes FROM p")
def profile(spark: SparkSession, d: str) -> DataFrame:
    return facts.profile(posts(spark, d), "id", ["likes"])


@query("A2_filtered_aggregates", f"WITH p AS ({POSTS}) SELECT day, count(*) FILTER (WHERE status = 'F') AS finished, CAST(sum(likes) FILTER (WHERE status = 'O') AS BIGINT) AS open_likes FROM p GROUP BY day")
def filtered(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).groupBy("day").agg(F.count_if(F.col("status") == "F").alias("finished"), F.sum(F.when(F.col("status") == "O", F.col("likes"))).alias("open_likes"))


@query("A3_tuple_distinct", "SELECT count(DISTINCT (l_orderkey, l_shipdate)) AS n FROM lineitem")
def tuple_distinct(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).agg(F.count_distinct(F.struct("id", "version")).alias("n"))


@query("A4_exact_distinct", "SELECT count(DISTINCT l_orderkey) AS n FROM lineitem")
def exact_distinct(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).agg(F.count_distinct("id").alias("n"))


@query("A5_A6_denominators", f"WITH p AS ({POSTS}), g AS (SELECT day, CASE WHEN grouping(lang) = 1 THEN '<ALL>' ELSE coalesce(lang, '<NULL>') END AS lang, count(*) AS tweets, count(DISTINCT author_id) AS authors, CAST(sum(likes) AS BIGINT) AS likes, count(*) FILTER (WHERE status = 'F') AS finished FROM p GROUP BY GROUPING SETS ((day, lang), (day))) SELECT *, day = (SELECT max(day) FROM p) AS partial_day FROM g")
def denominators(spark: SparkSession, d: str) -> DataFrame:
    return facts.denominators(posts(spark, d))


@query("A7_grouping_sets", f"WITH p AS ({POSTS}) SELECT day, lang, grouping(lang) AS g, count(*) AS n FROM p GROUP BY GROUPING SETS ((day), (lang))")
def grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).groupingSets([["day"], ["lang"]], "day", "lang").agg(F.grouping("lang").cast("long").alias("g"), F.count(F.lit(1)).alias("n"))


@query("A9_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 20")
def having(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n >= 20")


@query("A10_histogram_of_counts", "SELECT times, count(*) AS keys FROM (SELECT l_orderkey, count(*) AS times FROM lineitem GROUP BY 1) GROUP BY times")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return facts.repeats(observations(spark, d), F.col("id"))


@query("A11_continuous_quantiles", f"WITH p AS ({POSTS}) SELECT lang, round(quantile_cont(likes, 0.5), 4) AS p50, round(quantile_cont(likes, 0.9), 4) AS p90 FROM p GROUP BY lang")
def quantiles(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).groupBy("lang").agg(F.round(F.percentile("likes", 0.5), 4).alias("p50"), F.round(F.percentile("likes", 0.9), 4).alias("p90"))


@query("A12_approximate_quantiles")
def approximate(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).groupBy("lang").agg(F.percentile_approx("likes", [0.5, 0.9]).alias("q"))


@query("A13_conflicting_states", "SELECT l_orderkey AS id, count(DISTINCT (l_quantity, l_returnflag)) AS states FROM lineitem GROUP BY 1 HAVING count(DISTINCT (l_quantity, l_returnflag)) > 1")
def conflicting(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"))
    return rows.agg(F.count_distinct(F.struct("l_quantity", "l_returnflag")).alias("states")).where("states > 1")


@query("A14_arg_max", f"WITH p AS ({POSTS}) SELECT lang, arg_max(id, (likes, id)) AS top_id, arg_max(id, (likes, id)) FILTER (WHERE status = 'P') AS top_open FROM p GROUP BY lang")
def arg_max(spark: SparkSession, d: str) -> DataFrame:
    key = F.struct("likes", "id")
    return posts(spark, d).groupBy("lang").agg(F.max_by("id", key).alias("top_id"), F.max_by("id", F.when(F.col("status") == "P", key)).alias("top_open"))


@query("A15_string_agg", f"WITH p AS ({POSTS}) SELECT status, string_agg(DISTINCT lang, ', ' ORDER BY lang) AS langs FROM p GROUP BY status")
def string_agg(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).groupBy("status").agg(F.array_join(F.sort_array(F.collect_set("lang")), ", ").alias("langs"))


@query("A18_group_by_all", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def group_by_all(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {t} GROUP BY ALL", t=table(spark, d, "orders"))


@query("A19_weighted_mean", "SELECT d.lang, round(sum((1 + n_chars) * quality) FILTER (WHERE toxic = 0) / sum(1 + n_chars) FILTER (WHERE toxic = 0 AND quality IS NOT NULL), 6) AS weighted, round(avg(quality) FILTER (WHERE toxic = 0), 6) AS plain, count(quality) FILTER (WHERE toxic = 0) AS n, count(*) FILTER (WHERE toxic IS NULL OR toxic <> 0) AS gated_out FROM documents d LEFT JOIN labels USING (doc_id) GROUP BY d.lang")
def weighted(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").drop("text").join(table(spark, d, "labels"), "doc_id", "left")
    return facts.weighted_mean(rows, ["lang"], F.col("quality"), F.col("n_chars"), F.col("toxic") == 0)


@query("A20_label_shares", f"WITH p AS ({POSTS}) SELECT day, status, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY day) AS DOUBLE), 6) AS share FROM p GROUP BY day, status")
def shares(spark: SparkSession, d: str) -> DataFrame:
    return facts.with_shares(posts(spark, d).groupBy("day", "status").agg(F.count(F.lit(1)).alias("n")), ["day"])


@query("A22_volume_per_100k", f"WITH {DAYS} SELECT topic, day, tweets, round(tweets * 100000.0::DOUBLE / all_tweets, 4) AS per_100k FROM fact JOIN den USING (day)")
def volume(spark: SparkSession, d: str) -> DataFrame:
    rows, days = _facts(spark, d)
    joined = rows.join(days.select("day", F.col("tweets").alias("all_tweets")), "day")
    return joined.select("topic", "day", "tweets", F.round(F.col("tweets") * 100000.0 / F.col("all_tweets"), 4).alias("per_100k"))


@query("A23_language_mix", "SELECT coalesce(lang, '(null)') AS lang, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM documents GROUP BY 1 ORDER BY n DESC, lang LIMIT 12")
def mix(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").groupBy(F.coalesce("lang", F.lit("(null)")).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    return facts.with_shares(rows, []).orderBy(F.desc("n"), "lang").limit(12)


@query("A25_topic_days", f"WITH {DAYS} SELECT * FROM fact")
def topic_days(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d)[0]


@query("A26_A8_topic_facts_by_language", "WITH w AS (SELECT doc_id, lang, source, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+'))) AS topic FROM documents) SELECT topic, source, CASE WHEN grouping(lang) = 1 THEN '<ALL>' ELSE lang END AS lang, count(DISTINCT doc_id) AS docs FROM w GROUP BY GROUPING SETS ((topic, source), (topic, source, lang)) HAVING count(DISTINCT doc_id) >= 5")
def topic_facts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    # one row a document and topic, so rows are counted, not ids
    rows = docs.select("lang", "source", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Z][a-z]+)"), F.lit(1)))).alias("topic"))
    sets = rows.groupingSets([["topic", "source"], ["topic", "source", "lang"]], "topic", "source", "lang").agg(F.grouping("lang").alias("g"), F.count(F.lit(1)).alias("docs"))
    return sets.where("docs >= 5").select("topic", "source", F.when(F.col("g") == 1, "<ALL>").otherwise(F.col("lang")).alias("lang"), "docs")


@query("A27_volume_ranking", f"WITH {DAYS} SELECT topic, CAST(sum(tweets) AS BIGINT) AS tweets, count(DISTINCT day) AS days FROM fact JOIN days USING (day) GROUP BY topic HAVING sum(tweets) >= 100 ORDER BY tweets DESC, topic LIMIT 100")
def ranking(spark: SparkSession, d: str) -> DataFrame:
    return facts.volume_ranking(*_facts(spark, d), 100)


@query("A28_J2_J3_spikes", f"WITH {DAYS}, j AS (SELECT topic, day, tweets, all_tweets, sum(tweets) OVER (PARTITION BY topic) / CAST(sum(all_tweets) OVER (PARTITION BY topic) AS DOUBLE) AS base FROM fact JOIN days USING (day)) SELECT topic, day, tweets, round(tweets * 100000.0::DOUBLE / all_tweets, 4) AS per_100k, round(tweets / CAST(all_tweets AS DOUBLE) / base, 6) AS ratio FROM j WHERE tweets >= 2 ORDER BY ratio DESC, topic, day LIMIT 200")
def spikes(spark: SparkSession, d: str) -> DataFrame:
    return facts.spikes(*_facts(spark, d), 2)


@query("A34_coverage", f"WITH o AS ({OBS}), s AS (SELECT id, count(*) AS n, min(CAST(version AS DATE)) AS day FROM o GROUP BY id) SELECT day, count(*) AS tweets, CAST(sum(n) AS BIGINT) AS observations, count(*) FILTER (WHERE n > 1) AS repeated FROM s GROUP BY day")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    s = observations(spark, d).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min(F.to_date("version")).alias("day"))
    return s.groupBy("day").agg(F.count(F.lit(1)).alias("tweets"), F.sum("n").alias("observations"), F.count_if(F.col("n") > 1).alias("repeated"))


@query("A35_duration_bins", f"WITH o AS ({OBS}), s AS (SELECT id, date_diff('day', CAST(min(version) AS DATE), CAST(max(version) AS DATE)) AS days FROM o GROUP BY id) SELECT CASE WHEN days = 0 THEN '0' WHEN days <= 30 THEN '1-30' WHEN days <= 365 THEN '31-365' ELSE 'over' END AS bin, count(*) AS n FROM s GROUP BY 1")
def durations(spark: SparkSession, d: str) -> DataFrame:
    s = observations(spark, d).groupBy("id").agg(F.date_diff(F.to_date(F.max("version")), F.to_date(F.min("version"))).alias("days"))
    label = F.when(F.col("days") == 0, "0").when(F.col("days") <= 30, "1-30").when(F.col("days") <= 365, "31-365").otherwise("over")
    return s.groupBy(label.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("A45_volume_pivot", f"WITH p AS ({POSTS}) SELECT day, count(*) FILTER (WHERE status = 'F') AS F, count(*) FILTER (WHERE status = 'O') AS O, count(*) FILTER (WHERE status = 'P') AS P, count(*) AS total FROM p GROUP BY day")
def pivot(spark: SparkSession, d: str) -> DataFrame:
    return facts.pivoted(posts(spark, d), "day", "status", ["F", "O", "P"])


@query("A47_busiest_bucket", f"WITH p AS ({POSTS}), c AS (SELECT lang, day, count(*) AS n FROM p GROUP BY lang, day) SELECT lang, arg_max(day, (n, -epoch(day))) AS day, max(n) AS n FROM c GROUP BY lang")
def busiest(spark: SparkSession, d: str) -> DataFrame:
    c = posts(spark, d).groupBy("lang", "day").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("lang").agg(F.max_by("day", F.struct("n", -F.unix_date("day"))).alias("day"), F.max("n").alias("n"))


@query("A43_group_shares", "SELECT event_type, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM events GROUP BY event_type")
def group_shares(spark: SparkSession, d: str) -> DataFrame:
    return facts.with_shares(table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), [])


@query("G1_bursts", f"WITH {DAYS}, r AS (SELECT *, CASE WHEN day < DATE '1996-07-01' THEN 'before' ELSE 'from' END AS regime FROM fact JOIN days USING (day)), t AS (SELECT CASE WHEN day < DATE '1996-07-01' THEN 'before' ELSE 'from' END AS regime, sum(all_tweets) AS regime_tweets FROM days GROUP BY 1), s AS (SELECT *, sum(tweets) OVER (PARTITION BY topic, r.regime) AS topic_tweets FROM r JOIN t ON r.regime = t.regime), k AS (SELECT topic, regime, day, tweets, round(log2(((tweets + 0.5::DOUBLE) / (all_tweets + 1)) / ((topic_tweets - tweets + 0.5::DOUBLE) / (regime_tweets - all_tweets + 1))) * ln(1 + tweets), 6) AS score FROM s WHERE tweets >= 2) SELECT topic, regime, day, tweets, score FROM k QUALIFY row_number() OVER (PARTITION BY topic, regime ORDER BY score DESC, day) = 1")
def bursts(spark: SparkSession, d: str) -> DataFrame:
    return facts.bursts(*_facts(spark, d), "1996-07-01", 2)


@query("G7_stratified_shift", f"WITH p AS ({POSTS}), s AS (SELECT status, lang, created_at >= TIMESTAMP '1996-07-01' AS late, count(*) AS n, avg(likes) AS m, var_samp(likes) AS v FROM p GROUP BY ALL), w AS (SELECT a.status, least(a.n, b.n) AS w, b.m - a.m AS d, a.v / a.n + b.v / b.n AS e FROM s a JOIN s b ON a.status = b.status AND a.lang = b.lang AND NOT a.late AND b.late WHERE a.n > 1 AND b.n > 1) SELECT status, round(sum(w * d) / sum(w), 4) AS shift, round(sqrt(sum(w * w * e)) / sum(w), 4) AS error FROM w GROUP BY status")
def strata(spark: SparkSession, d: str) -> DataFrame:
    rows = posts(spark, d).withColumn("late", F.col("created_at") >= F.expr("timestamp_ntz '1996-07-01'"))
    return statistics.stratified_shift(rows, "status", "lang", "late", "likes")


@query("G8_false_discovery", f"WITH p AS ({POSTS}), c AS (SELECT author_id AS k, (count(*) FILTER (WHERE status = 'F') + 1) / CAST(count(*) + 2 AS DOUBLE) AS p FROM p GROUP BY 1), r AS (SELECT k, p, row_number() OVER (ORDER BY p, k) AS i, count(*) OVER () AS n FROM c) SELECT k, round(p, 6) AS p, round(least(1, min(p * n / i) OVER (ORDER BY i DESC)), 6) AS q FROM r")
def discovery(spark: SparkSession, d: str) -> DataFrame:
    c = posts(spark, d).groupBy(F.col("author_id").alias("k")).agg(((F.count_if(F.col("status") == "F") + 1) / (F.count(F.lit(1)) + 2)).alias("p"))
    return statistics.benjamini_hochberg(c, "k", "p")


@query("G10_period_summary", f"WITH p AS ({POSTS}) SELECT status, count(*) AS n, count(DISTINCT author_id) AS authors, round(avg(likes), 4) AS mean FROM p GROUP BY status")
def period(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("author_id").alias("authors"), F.round(F.avg("likes"), 4).alias("mean"))


@query("G11_weighted_trend", "WITH e AS (SELECT event_type AS k, epoch(date_trunc('day', ts)) / 86400 - 19723 AS x, floor(value) AS y, 1 + user_id % 3 AS w FROM events), s AS (SELECT k, sum(w) AS w, sum(w * x) AS wx, sum(w * y) AS wy, sum(w * x * x) AS wxx, sum(w * x * y) AS wxy, sum(w * y * y) AS wyy FROM e GROUP BY k) SELECT k, round((w * wxy - wx * wy) / (w * wxx - wx * wx), 6) AS slope, round((w * wxy - wx * wy) * (w * wxy - wx * wy) / ((w * wxx - wx * wx) * (w * wyy - wy * wy)), 6) AS r2 FROM s")
def trend(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    rows = e.select(F.col("event_type").alias("k"), (F.unix_date(F.to_date("ts")) - 19723).cast("double").alias("x"), F.floor("value").cast("double").alias("y"), (1 + F.col("user_id") % 3).cast("double").alias("w"))
    return statistics.weighted_trend(rows, "k").select("k", "slope", "r2")


@query("G15_score_row_validation", "SELECT count(*) FILTER (WHERE quality NOT IN (0, 1)) AS bad_quality, count(*) FILTER (WHERE toxic NOT IN (0, 1)) AS bad_toxic, count(*) - count(DISTINCT doc_id) AS repeated FROM labels")
def validation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").agg(F.count_if(~F.col("quality").isin(0, 1)).alias("bad_quality"), F.count_if(~F.col("toxic").isin(0, 1)).alias("bad_toxic"), (F.count(F.lit(1)) - F.count_distinct("doc_id")).alias("repeated"))


@query("N5_poisson_interval", f"WITH p AS ({POSTS}), c AS (SELECT lang, count(*) FILTER (WHERE {'likes > 400000'}) AS hits FROM p GROUP BY lang) SELECT lang, hits, CASE WHEN hits = 0 THEN 0.0::DOUBLE ELSE round(greatest(0, hits - 1.96 * sqrt(hits)) * 100, 4) END AS lo, CASE WHEN hits = 0 THEN 300.0::DOUBLE ELSE round((hits + 1.96 * sqrt(hits)) * 100, 4) END AS hi FROM c")
def poisson(spark: SparkSession, d: str) -> DataFrame:
    c = posts(spark, d).groupBy("lang").agg(F.count_if(F.col("likes") > 400000).alias("hits"))
    lo, hi = statistics.poisson_interval(F.col("hits"), 100)
    return c.select("lang", "hits", F.round(lo, 4).alias("lo"), F.round(hi, 4).alias("hi"))


@query("G6_cluster_bootstrap")
def bootstrap(spark: SparkSession, d: str) -> DataFrame:
    rows = posts(spark, d).withColumn("late", F.col("created_at") >= F.expr("timestamp_ntz '1996-07-01'"))
    return statistics.cluster_bootstrap(rows, "lang", "author_id", "late", "likes")


@query("W12_W13_G17_chart_summary", f"WITH p AS ({POSTS}), s AS (SELECT lang AS series, day AS x, count(*) AS y FROM p GROUP BY lang, day), c AS (SELECT *, y - lag(y) OVER (PARTITION BY series ORDER BY x) AS step FROM s) SELECT series, arg_min(y, x) AS start_y, arg_max(y, x) AS end_y, arg_min(x, (y, x)) AS low_x, arg_max(x, (y, -epoch(x))) AS high_x, arg_max(x, (abs(step), -epoch(x))) FILTER (WHERE step IS NOT NULL) AS change_x FROM c GROUP BY series")
def summary(spark: SparkSession, d: str) -> DataFrame:
    from tidewater.operators import charts

    s = posts(spark, d).groupBy(F.col("lang").alias("series"), F.col("day").alias("x")).agg(F.count(F.lit(1)).alias("y"))
    return charts.summary(s)
