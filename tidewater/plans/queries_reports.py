"""Queries of reports, rule joins, list functions, tokens and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import patterns as pat
from tidewater.operators import activity, reports, sample, statistics
from tidewater.plans.catalog import query
from tidewater.plans.spec import Spec, compile_filter
from tidewater.schema import activity as events_of
from tidewater.schema import posts, table

ONE = "*"
P = "p AS (SELECT o_orderkey AS id, o_custkey AS author_id, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS lang, o_orderstatus AS status, CAST(floor(o_totalprice) AS BIGINT) AS likes, o_orderdate AS created_at FROM orders)"
REGIME = "CASE WHEN day < DATE '1996-07-01' THEN 'before' ELSE 'from' END"
FACT = f"""{P}, f AS (SELECT lang AS topic, date_trunc('month', day)::DATE AS day, count(*) AS tweets, count(DISTINCT author_id) AS authors FROM p GROUP BY ALL),
n AS (SELECT date_trunc('month', day)::DATE AS day, count(*) AS all_tweets FROM p GROUP BY ALL), g AS (SELECT *, {REGIME} AS regime FROM n),
h AS (SELECT regime, CAST(sum(all_tweets) AS BIGINT) AS regime_all, min(day) AS first, max(day) AS last FROM g GROUP BY 1),
r AS (SELECT f.*, all_tweets, regime, regime_all, first, last, CAST(sum(tweets) OVER (PARTITION BY topic, regime) AS BIGINT) AS own FROM f JOIN g USING (day) JOIN h USING (regime)),
s AS (SELECT *, own - tweets AS baseline, ((tweets + 0.5::DOUBLE) / (all_tweets + 1)) / ((own - tweets + 0.5::DOUBLE) / (regime_all - all_tweets + 1)) AS ratio FROM r WHERE tweets >= 3 AND authors >= 3),
k AS (SELECT *, log2(ratio) * ln(1 + tweets) AS score FROM s WHERE ratio > 1), best AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY topic ORDER BY score DESC, day) = 1)"""


def _regime() -> Column:
    return F.when(F.col("day") < F.lit("1996-07-01").cast("date"), "before").otherwise("from")


def _months(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = posts(spark, d).withColumn("day", F.trunc("day", "month"))
    facts = rows.groupBy(F.col("lang").alias("topic"), "day").agg(F.count(ONE).alias("tweets"), F.count_distinct("author_id").alias("authors"))
    return facts, rows.groupBy("day").agg(F.count(ONE).alias("all_tweets"))


@query("G1_T14_burst_ranking", f"WITH {FACT} SELECT topic, day, regime, tweets, authors, baseline, round(ratio, 6) AS ratio, round(score, 6) AS score, baseline < 50 AS low_baseline, day IN (first, last) AS boundary, row_number() OVER (ORDER BY baseline < 50, score DESC, topic) AS place FROM best")
def burst_ranking(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    found = reports.burst_ranking(*_months(spark, d), _regime(), 3, 3)
    place = F.row_number().over(Window.orderBy("low_baseline", F.desc("score"), "topic"))  # of one row a topic that is ranked
    return found.withColumn("place", place).withColumns({c: F.round(c, 6) for c in ("ratio", "score")})


@query("G1_filled_series", f"WITH {FACT} SELECT topic, day, coalesce(tweets, 0) AS tweets, round(coalesce(tweets, 0) * 100000.0 / all_tweets, 4) AS per_100k FROM (SELECT topic, n.day, n.all_tweets FROM best CROSS JOIN n) LEFT JOIN (SELECT topic, day, tweets FROM f) USING (topic, day)")
def filled(spark: SparkSession, d: str) -> DataFrame:
    facts, days = _months(spark, d)
    return reports.filled_series(reports.burst_ranking(facts, days, _regime(), 3, 3), facts, days)


@query("G2_mix_adjusted", f"WITH {FACT}, c AS (SELECT lang AS topic, {REGIME} AS regime, date_trunc('month', day)::DATE AS day, status AS lang, count(*) AS n FROM p GROUP BY ALL), t AS (SELECT {REGIME} AS regime, date_trunc('month', day)::DATE AS day, status AS lang, count(*) AS n_all FROM p GROUP BY ALL), l AS (SELECT DISTINCT topic, lang FROM c), x AS (SELECT best.topic, best.tweets, l.lang, coalesce((SELECT sum(n) FROM c WHERE c.topic = best.topic AND c.lang = l.lang AND c.regime = best.regime AND c.day <> best.day), 0) AS num, coalesce((SELECT sum(n_all) FROM t WHERE t.lang = l.lang AND t.regime = best.regime AND t.day <> best.day), 0) AS den, coalesce((SELECT sum(n_all) FROM t WHERE t.lang = l.lang AND t.day = best.day), 0) AS here FROM best JOIN l USING (topic)), e AS (SELECT topic, tweets, sum((num + 0.5::DOUBLE) / (den + 1) * here) AS expected FROM x GROUP BY ALL) SELECT topic, round(expected, 6) AS expected, round((tweets + 0.5) / (expected + 0.5), 6) AS lift FROM e")
def mix_adjusted(spark: SparkSession, d: str) -> DataFrame:
    peaks = reports.burst_ranking(*_months(spark, d), _regime(), 3, 3).select("topic", "day", "regime", "tweets")
    rows = posts(spark, d).select(F.col("lang").alias("topic"), _regime().alias("regime"), F.trunc("day", "month").alias("day"), F.col("status").alias("lang"))
    counts = rows.groupBy("topic", "regime", "day", "lang").agg(F.count(ONE).alias("n"))
    return reports.adjusted_for_mix(peaks, counts, rows.groupBy("regime", "day", "lang").agg(F.count(ONE).alias("n_all")))


STOP = ("the", "and", "for", "that", "with")
GRAMS = r"""w AS (SELECT doc_id, doc_id % 8 AS day, list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: regexp_full_match(x, '[a-z][a-z0-9_]{2,}') AND x NOT IN ('the', 'and', 'for', 'that', 'with')) AS w FROM documents WHERE lang = 'en'),
g AS (SELECT DISTINCT doc_id, day, array_to_string(w[i : i + k - 1], ' ') AS term FROM w, unnest(range(1, len(w) + 1)) AS t(i), (VALUES (1), (2), (3)) AS s(k) WHERE i + k - 1 <= len(w))"""


def _grams(spark: SparkSession, d: str) -> tuple[DataFrame, Column]:
    rows = table(spark, d, "documents").where("lang = 'en'").select("doc_id", (F.col("doc_id") % 8).alias("day"), "text")
    return rows, reports.ngrams(F.col("text"), STOP)


@query("R7_ngram_frequency", f"WITH {GRAMS}, f AS (SELECT term, count(*) AS n FROM g GROUP BY 1) SELECT term, n FROM f WHERE n >= 10 AND n <= 0.2 * (SELECT count(*) FROM w)")
def ngram_frequency(spark: SparkSession, d: str) -> DataFrame:
    rows, terms = _grams(spark, d)
    return reports.document_frequency(rows, terms, 10, 0.2).select("term", "n")


@query("G3_ngram_bursts", f"WITH {GRAMS}, f AS (SELECT term, day, count(*) AS n FROM g GROUP BY ALL), t AS (SELECT *, CAST(sum(n) OVER (PARTITION BY term) AS BIGINT) AS total FROM f), z AS (SELECT day, count(*) AS n_all FROM w GROUP BY 1), q AS (SELECT *, CAST(sum(n_all) OVER (PARTITION BY day < 4) - n_all AS BIGINT) AS rest FROM z), r AS (SELECT t.*, n_all, rest, sum(n) OVER (PARTITION BY term, t.day < 4) - n AS base FROM t JOIN q USING (day) WHERE total >= 10 AND total <= 0.9 * (SELECT count(*) FROM w)), k AS (SELECT *, ((n + 0.5::DOUBLE) / (n_all + 1)) / ((base + 0.5::DOUBLE) / (rest + 1)) AS ratio FROM r), b AS (SELECT *, log2(greatest(ratio, 1.0)) * ln(1 + n) AS score FROM k WHERE n >= 3 AND total >= 12) SELECT term, day, n, total, round(ratio, 6) AS ratio, round(score, 6) AS score FROM b QUALIFY row_number() OVER (PARTITION BY term ORDER BY score DESC, day) = 1")
def ngram_bursts(spark: SparkSession, d: str) -> DataFrame:
    rows, terms = _grams(spark, d)
    daily = reports.document_frequency(rows, terms, 10, 0.9, ["day"])
    found = reports.ngram_bursts(daily, rows.groupBy("day").agg(F.count(ONE).alias("n_all")), F.col("day") < 4, 3, 12)
    return found.withColumns({c: F.round(c, 6) for c in ("ratio", "score")})


def _scored(spark: SparkSession, d: str) -> DataFrame:
    score = (F.col("likes") % 201 - 100) / 100.0
    rows = posts(spark, d).withColumn("late", F.col("created_at") >= F.expr("timestamp_ntz '1996-07-01'")).withColumn("score", score)
    label = F.when(F.col("score") < -0.2, "negative").when(F.col("score") > 0.2, "positive").otherwise("neutral")
    return rows.withColumn("label", label).withColumn("top", F.greatest(F.abs("score"), F.lit(0.34)))


@query("G10_period_details", f"WITH {P}, s AS (SELECT *, created_at >= TIMESTAMP '1996-07-01' AS late, (likes % 201 - 100) / 100.0::DOUBLE AS score FROM p), l AS (SELECT status, late, lang || '=' || count(*) AS one FROM s GROUP BY status, late, lang), m AS (SELECT status, late, string_agg(one, ',' ORDER BY one) AS languages FROM l GROUP BY ALL) SELECT status, late, count(*) AS n, count(DISTINCT author_id) AS authors, round(avg(score), 6) AS mean, round(avg(greatest(abs(score), 0.34)), 6) AS mean_top, round(count(*) FILTER (WHERE score < -0.2) / count(*)::DOUBLE, 6) AS negative, round(count(*) FILTER (WHERE score > 0.2) / count(*)::DOUBLE, 6) AS positive, any_value(languages) AS languages FROM s JOIN m USING (status, late) GROUP BY status, late")
def period_details(spark: SparkSession, d: str) -> DataFrame:
    return reports.period_summary(_scored(spark, d), ["status", "late"])


@query("G7_shift_limits", f"WITH {P}, s AS (SELECT status, lang, created_at >= TIMESTAMP '1996-07-01' AS late, count(*) AS n, avg((likes % 201 - 100) / 100.0::DOUBLE) AS m, var_samp((likes % 201 - 100) / 100.0::DOUBLE) AS v FROM p GROUP BY ALL), w AS (SELECT a.status, least(a.n, b.n) AS w, a.n AS n0, b.n AS n1, b.m - a.m AS d, a.v / a.n + b.v / b.n AS e FROM s a JOIN s b ON a.status = b.status AND a.lang = b.lang AND NOT a.late AND b.late WHERE a.n >= 10 AND b.n >= 10), x AS (SELECT status, sum(w * d) / sum(w) AS shift, sqrt(sum(w * w * e)) / sum(w) AS error, CAST(sum(n0) AS BIGINT) AS n_base, CAST(sum(n1) AS BIGINT) AS n_peak FROM w GROUP BY status) SELECT status, round(shift, 6) AS shift, round(shift - 1.96 * error, 6) AS lo, round(shift + 1.96 * error, 6) AS hi, n_base, n_peak FROM x")
def shift_limits(spark: SparkSession, d: str) -> DataFrame:
    found = reports.shifts(_scored(spark, d), "status", "lang", "late", "score")
    return found.select("status", *[F.round(c, 6).alias(c) for c in ("shift", "lo", "hi")], "n_base", "n_peak")


@query("G9_strong_shifts")
def strong_shifts(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d)
    found = reports.shifts(rows, "status", "lang", "late", "score")
    q = statistics.benjamini_hochberg(found.select("status", "p"), "status", "p").select("status", "q")
    means = rows.groupBy("status").agg(F.avg(F.when(F.col("late"), F.col("score"))).alias("m1"), F.avg(F.when(~F.col("late"), F.col("score"))).alias("m0"), F.count_if("late").alias("tweets"))
    boot = statistics.cluster_bootstrap(rows, "status", "author_id", "late", "score").withColumnsRenamed({"lo": "b_lo", "hi": "b_hi"})
    out = found.join(q, "status").join(means, "status").join(boot, "status")
    flag = reports.strong(F.col("m1") - F.col("m0"), F.col("b_lo"), F.col("b_hi"), F.col("q"), F.col("shift"), [F.col("n_base"), F.col("n_peak")])
    return out.select("status", F.round("p", 6).alias("p"), "q", flag.alias("strong"), F.round(reports.outlier_score(F.lit(2.0), F.col("shift"), F.col("tweets")), 6).alias("score"))


@query("G11_fitted_trend", "WITH e AS (SELECT event_type AS k, epoch(date_trunc('day', ts)) / 86400 - 19723 AS x, floor(value) AS y, (1 + user_id % 3)::DOUBLE AS w FROM events), a AS (SELECT * FROM e UNION ALL SELECT 'all', x, y, w FROM e), m AS (SELECT *, sum(w * x) OVER k / sum(w) OVER k AS mx, sum(w * y) OVER k / sum(w) OVER k AS my FROM a WINDOW k AS (PARTITION BY k)), s AS (SELECT k, any_value(my) AS my, any_value(mx) AS mx, sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) AS slope, min(x) AS x0, max(x) AS x1, min(y) AS low, max(y) AS high FROM m GROUP BY k) SELECT k, round(slope, 6) AS slope, round(my + slope * (x0 - mx), 6) AS start, round(my + slope * (x1 - mx), 6) AS \"end\", round(slope * (x1 - x0), 6) AS change, low, high FROM s")
def fitted(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_type").alias("k"), (F.unix_date(F.to_date("ts")) - 19723).cast("double").alias("x"), F.floor("value").cast("double").alias("y"), (1 + F.col("user_id") % 3).cast("double").alias("w"))
    return statistics.fitted_trend(rows, "k")


@query("G13_extremes", "WITH b AS (SELECT l_orderkey, arg_min(l_returnflag, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS kind, round(arg_max(l_quantity, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) - arg_min(l_quantity, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)), 4) AS quantity, round(arg_max(l_tax, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) - arg_min(l_tax, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)), 4) AS tax FROM lineitem GROUP BY 1), u AS (UNPIVOT b ON quantity, tax INTO NAME metric VALUE x), a AS (SELECT *, 'largest' AS \"end\", row_number() OVER (PARTITION BY kind, metric ORDER BY x DESC, l_orderkey) AS place FROM u UNION ALL SELECT *, 'negative', row_number() OVER (PARTITION BY kind, metric ORDER BY x, l_orderkey) FROM u WHERE x < 0) SELECT kind, metric, \"end\", CAST(place AS INT) AS place, l_orderkey FROM a WHERE place <= 5")
def extremes(spark: SparkSession, d: str) -> DataFrame:
    first = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_returnflag", first).alias("kind"), *[F.round(F.max_by(c, first) - F.min_by(c, first), 4).alias(n) for n, c in (("quantity", "l_quantity"), ("tax", "l_tax"))])
    return reports.extremes(rows, "kind", "l_orderkey", ["quantity", "tax"], 5).select("kind", "metric", "end", "place", "l_orderkey")


@query("G14_outlier_overlap", "WITH w AS (SELECT doc_id, n_chars, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{3,}'))) AS tag FROM documents), t AS (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20), a AS (SELECT tag, count(*) AS n_a FROM w SEMI JOIN t USING (doc_id) GROUP BY 1), b AS (SELECT tag, count(*) AS n_b FROM w WHERE doc_id % 10 = 0 GROUP BY 1), z AS (SELECT (SELECT sum(n_a) FROM a) AS za, (SELECT sum(n_b) FROM b) AS zb) SELECT tag, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b, round(((coalesce(n_a, 0) + 0.5::DOUBLE) / (za + 1)) / ((coalesce(n_b, 0) + 0.5::DOUBLE) / (zb + 1)), 6) AS ratio FROM a FULL JOIN b USING (tag), z")
def outlier_overlap(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    tags = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{3,})"), F.lit(1)))).alias("tag")
    top = docs.orderBy(F.desc("n_chars"), "doc_id").limit(20).select("doc_id")  # twenty rows
    return reports.overlap(docs.join(F.broadcast(top), "doc_id", "left_semi").select(tags), docs.where("doc_id % 10 = 0").select(tags), "tag")


@query("G16_classified", "WITH a AS (SELECT p_partkey, p_size / 50.0::DOUBLE AS x, (p_size % 7) / 7.0::DOUBLE AS y, (p_size % 11) / 10.0::DOUBLE AS z FROM part), b AS (SELECT p_partkey, list_filter([CASE WHEN x >= 0.5 THEN 'acme' END, CASE WHEN y >= 0.5 THEN 'bolt' END, CASE WHEN z >= 0.5 THEN 'core' END], lambda v: v IS NOT NULL) AS c FROM a) SELECT p_partkey, CASE WHEN len(c) > 0 THEN 'accepted' ELSE 'others' END AS status, array_to_string(c, ',') AS companies FROM b")
def classified(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    answers = F.create_map(F.lit("acme"), s / 50.0, F.lit("bolt"), (s % 7) / 7.0, F.lit("core"), (s % 11) / 10.0)
    return table(spark, d, "part").select("p_partkey", reports.classified(answers, 0.5).alias("x")).select("p_partkey", "x.status", F.array_join("x.companies", ",").alias("companies"))


SERIES = f"{P}, s AS (SELECT lang AS series, day AS x, count(*) AS y, count(*) AS n FROM p WHERE status = 'F' GROUP BY lang, day)"


def _series(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).where("status = 'F'").groupBy(F.col("lang").alias("series"), F.col("day").alias("x")).agg(F.count(ONE).alias("y"), F.count(ONE).alias("n"))


@query("G17_W12_annotations", f"WITH {SERIES}, c AS (SELECT *, y - lag(y) OVER w AS step, x - lag(x) OVER w AS apart FROM s WINDOW w AS (PARTITION BY series ORDER BY x)) SELECT series, x, 'largest_change' AS kind, step::DOUBLE AS value, apart::BIGINT AS days_apart FROM (SELECT * FROM c WHERE step IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series ORDER BY abs(step) DESC, x) = 1) UNION ALL SELECT series, x, 'low_n', n::DOUBLE, NULL FROM s WHERE n < 2")
def annotated(spark: SparkSession, d: str) -> DataFrame:
    return reports.annotations(_series(spark, d), 2)


@query("G18_readings", f"WITH {SERIES} SELECT series, count(*) AS samples, arg_min(y, x) AS first, arg_max(y, x) AS last, arg_min(x, (y, x)) AS low_x, min(y) AS low, arg_max(x, (y, -epoch(x))) AS high_x, max(y) AS high FROM s GROUP BY series")
def readings(spark: SparkSession, d: str) -> DataFrame:
    return reports.readings(_series(spark, d))


@query("T15_worth_saying", f"WITH {SERIES}, c AS (SELECT *, y - lag(y) OVER (PARTITION BY series ORDER BY x) AS step FROM s), m AS (SELECT series, arg_max(x, (abs(step), -epoch(x))) FILTER (WHERE step IS NOT NULL) AS x, 0 AS rank FROM c GROUP BY series UNION ALL SELECT series, arg_min(x, (y, x)), 1 FROM s GROUP BY series UNION ALL SELECT series, arg_max(x, (y, -epoch(x))), 2 FROM s GROUP BY series UNION ALL SELECT series, max(x), 3 FROM s GROUP BY series UNION ALL SELECT series, min(x), 4 FROM s GROUP BY series), o AS (SELECT series, x, min(rank) AS rank FROM m WHERE x IS NOT NULL GROUP BY ALL) SELECT series, x, CAST(row_number() OVER (PARTITION BY series ORDER BY rank) AS INT) AS place FROM o QUALIFY row_number() OVER (PARTITION BY series ORDER BY rank) <= 3")
def worth_saying(spark: SparkSession, d: str) -> DataFrame:
    return reports.worth_saying(_series(spark, d))


@query("G20_bubbles", "WITH e AS (SELECT event_type AS target, CAST(ts AS DATE) AS day, floor(value) % 11 AS s FROM events), w AS (SELECT target, day + k AS until, s FROM e, (VALUES (1), (2), (3)) AS t(k)), m AS (SELECT target, until, count(*) AS n, avg(s) AS y, sqrt(greatest(0, avg(s * s) - avg(s) * avg(s))) AS x FROM w GROUP BY ALL) SELECT target, until, round(x, 3) AS x, round(y, 4) AS y, round(sqrt(n), 6) AS size FROM m")
def bubbles(spark: SparkSession, d: str) -> DataFrame:
    s = F.floor("value") % 11
    days = table(spark, d, "events").groupBy(F.col("event_type").alias("target"), F.to_date("ts").alias("day")).agg(F.count(ONE).alias("n"), F.sum(s).alias("a"), F.sum(s * s).alias("b"))
    ends = days.withColumn("until", F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.date_add("day", k))))  # sums of days, not rows
    w = ends.groupBy("target", "until").agg(F.sum("n").alias("active"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    mean = F.col("a") / F.col("active")
    return reports.bubbles(w.select("target", "until", "active", F.round(mean, 4).alias("mean"), F.round(F.sqrt(F.greatest(F.lit(0.0), F.col("b") / F.col("active") - mean * mean)), 3).alias("spread")))


@query("G21_T16_cost_and_status", "SELECT round(2000 * (80 + 1000 / 4.0::DOUBLE) * 0.1::DOUBLE / 1e6 * 3, 6) AS usd, 0.75::DOUBLE AS reserved, true AS refused, 'FAILED' AS half, 'READY' AS more")
def cost(spark: SparkSession, d: str) -> DataFrame:
    from tidewater.operators.feed import run_status

    row = (round(reports.cost(2000, 1000, 0.1), 6), reports.reserve(1.0, 0.25, 0.5, 0.25), reports.reserve(1.0, 0.25, 0.5, 0.26) is None, run_status(10, 5), run_status(10, 6))
    return spark.createDataFrame([row], "usd double, reserved double, refused boolean, half string, more string")


@query("A34_coverage_details", "WITH o AS (SELECT l_orderkey AS id, count(*) AS n, min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem GROUP BY 1) SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority AS lang, count(*) AS tweets, CAST(sum(n) AS BIGINT) AS observations, count(*) FILTER (WHERE n > 1) AS repeated, CAST(sum(n - 1) AS BIGINT) AS extra, count(*) FILTER (WHERE epoch(b) - epoch(a) >= 3600) AS an_hour FROM o JOIN orders ON o_orderkey = id GROUP BY ALL")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(ONE).alias("n"), F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    hour = F.unix_seconds(F.col("b").cast("timestamp")) - F.unix_seconds(F.col("a").cast("timestamp")) >= 3600
    return posts(spark, d).select("id", "day", "lang").join(seen, "id").groupBy("day", "lang").agg(F.count(ONE).alias("tweets"), F.sum("n").alias("observations"), F.count_if(F.col("n") > 1).alias("repeated"), F.sum(F.col("n") - 1).alias("extra"), F.count_if(hour).alias("an_hour"))


@query("A46_companies_present", "WITH s AS (SELECT doc_id, text, n_chars, list_filter([CASE WHEN regexp_matches(text, '(?i)\\bthe\\b') THEN 'the' END, CASE WHEN regexp_matches(text, '(?i)licensed') THEN 'licensed' END], lambda x: x IS NOT NULL) AS c FROM documents WHERE source = 'src1'), t AS (SELECT unnest(c) AS company, n_chars FROM s) SELECT company, count(*) AS posts, CAST(sum(n_chars) AS BIGINT) AS likes FROM t GROUP BY 1")
def companies(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    found = F.array_compact(F.array(F.when(t.rlike(pat.whole_word("the")), "the"), F.when(t.rlike(pat.substring("licensed")), "licensed")))
    return table(spark, d, "documents").where("source = 'src1'").select(F.explode(found).alias("company"), "n_chars").groupBy("company").agg(F.count(ONE).alias("posts"), F.sum("n_chars").alias("likes"))


@query("A12_approximate_quantiles_bound", "SELECT l_returnflag AS flag, true AS near FROM lineitem GROUP BY 1")
def near_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Whether the approximate quantiles lie between the exact ones 1 % lower and higher."""
    x = F.col("l_extendedprice")
    levels = (0.1, 0.5, 0.9)
    rows = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.percentile_approx(x, F.array(*map(F.lit, levels)), F.lit(1000)).alias("a"), *[F.percentile(x, F.array(*[F.lit(q + e) for q in levels])).alias(n) for n, e in (("lo", -0.01), ("hi", 0.01))])
    return rows.select("flag", F.forall(F.arrays_zip("a", "lo", "hi"), lambda z: (z["a"] >= z["lo"]) & (z["a"] <= z["hi"])).alias("near"))


@query("F1_spec_groups", "SELECT doc_id FROM documents WHERE doc_id % 28 >= 2 AND doc_id % 28 < 20 AND (regexp_matches(text, '(?i)\\bthe\\b') OR regexp_matches(text, '(?i)licensed')) AND regexp_matches(text, '(?i)a') AND NOT regexp_matches(text, '(?i)idiot') AND regexp_matches('#' || source || '!', '(?i)#src[12]!') AND lang IN ('en', 'de')")
def spec_groups(spark: SparkSession, d: str) -> DataFrame:
    spec = Spec("2026-01-03", "2026-01-21", any_of=({"term": "the", "match": "word"}, "licensed"), all_of=("a",), none_of=("idiot",), languages=("en", "de"), originals_only=False)
    rows = table(spark, d, "documents").withColumn("at", F.date_add(F.lit("2026-01-01").cast("date"), (F.col("doc_id") % 28).cast("int")).cast("timestamp"))
    tagged = compile_filter(Spec("2026-01-01", "2026-02-01", hashtags=("src1", {"term": "#SRC2"}), originals_only=False), {"created_at": "at", "text": "tag"})
    rows = rows.where(compile_filter(spec, {"created_at": "at", "text": "text", "lang": "lang"}))
    return rows.withColumn("tag", F.concat(F.lit("#"), "source", F.lit("!"))).where(tagged).select("doc_id")


@query("F4_hashtag_ends", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 2 = 1")
def hashtag_ends(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("see #"), "c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, "s").otherwise("."))
    return table(spark, d, "customer").where(text.rlike(pat.hashtag("#Building"))).select("c_custkey")


@query("F11_preview_words", "SELECT doc_id, regexp_matches(text, '(?i)\\bthe\\b') AS short, regexp_matches(text, '(?i)licensed') AS long FROM documents")
def preview_words(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", t.rlike(pat.preview_term("the")).alias("short"), t.rlike(pat.preview_term("licensed")).alias("long"))


@query("J18_rule_join", "WITH k(segment, least) AS (VALUES ('BUILDING', 0), ('MACHINERY', 5000), ('HOUSEHOLD', 9000)) SELECT segment, count(*) AS n FROM customer JOIN k ON c_mktsegment = segment AND c_acctbal >= least GROUP BY 1")
def rule_join(spark: SparkSession, d: str) -> DataFrame:
    rules = F.broadcast(spark.createDataFrame([("BUILDING", 0), ("MACHINERY", 5000), ("HOUSEHOLD", 9000)], "segment string, least long"))
    rows = table(spark, d, "customer")
    return rows.join(rules, (F.col("c_mktsegment") == F.col("segment")) & (F.col("c_acctbal") >= F.col("least"))).groupBy("segment").agg(F.count(ONE).alias("n"))


@query("J19_json_join", "SELECT n_name, count(*) AS n FROM events JOIN nation ON TRY_CAST(json_extract_string(props, '$.k') AS INT) = n_nationkey GROUP BY 1")
def json_join(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.get_json_object("props", "$.k").try_cast("int").alias("n_nationkey"))
    return rows.join(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey").groupBy("n_name").agg(F.count(ONE).alias("n"))


@query("R1_list_functions", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(list_filter(string_split(p_name, ' '), lambda x: length(x) > 3), lambda x: upper(x)))), ',') AS words, list_contains(string_split(p_type, ' '), 'BRASS') AS brass, list_position(string_split(p_type, ' '), 'STEEL') AS steel, array_to_string(list_slice(string_split(p_type, ' '), 1, 2), ' ') AS head, len(list_concat(string_split(p_type, ' '), ['x'])) AS n FROM part")
def list_functions(spark: SparkSession, d: str) -> DataFrame:
    words, kinds = F.split("p_name", " "), F.split("p_type", " ")
    return table(spark, d, "part").select(
        "p_partkey", F.array_join(F.sort_array(F.array_distinct(F.transform(F.filter(words, lambda x: F.length(x) > 3), F.upper))), ",").alias("words"), F.array_contains(kinds, "BRASS").alias("brass"),
        F.nullif(F.array_position(kinds, "STEEL"), F.lit(0)).cast("int").alias("steel"), F.array_join(F.slice(kinds, 1, 2), " ").alias("head"), F.size(F.concat(kinds, F.array(F.lit("x")))).cast("long").alias("n"),
    )


TOKENS = {"caps": "[A-Z][a-z]+", "caps2": "[A-Z][a-z]+ [A-Z][a-z]+", "mention": "@[A-Za-z0-9_]+", "number": "[0-9]+", "domain": "https?://[a-z0-9.]+"}


@query("R6_token_families", " UNION ALL ".join(f"SELECT '{k}' AS family, token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{p}')) AS token FROM documents) GROUP BY token" for k, p in TOKENS.items()))
def token_families(spark: SparkSession, d: str) -> DataFrame:
    found = F.map_from_arrays(F.array(*map(F.lit, TOKENS)), F.array(*[F.regexp_extract_all("text", F.lit(f"({p})"), F.lit(1)) for p in TOKENS.values()]))
    rows = table(spark, d, "documents").where("text is not null").select(F.explode(found).alias("family", "tokens"))
    return rows.select("family", F.explode("tokens").alias("token")).groupBy("family", "token").agg(F.count(ONE).alias("n"))


@query("X8_X9_model_forms", "SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(^|\\s)@\\S+', '\\1@user', 'g'), '(^|\\s)http\\S+', '\\1http', 'g')) AS model, md5(lower(regexp_replace(text, 'https?://\\S+|@[A-Za-z0-9_]+|&[A-Za-z0-9_]+;|^RT\\b', ' ', 'g'))) AS burst FROM documents")
def model_forms(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    marked = F.regexp_replace(F.regexp_replace(t, r"(^|\s)@\S+", "$1@user"), r"(^|\s)http\S+", "$1http")
    return table(spark, d, "documents").select("doc_id", F.md5(marked.cast("binary")).alias("model"), F.md5(pat.burst_plain(t).cast("binary")).alias("burst"))


@query("X15_canonical_hashes", "SELECT p_partkey, sha256('{\"brand\":\"' || p_brand || '\",\"size\":' || p_size || '}') AS version, sha256(p_name) AS content FROM part")
def hashes(spark: SparkSession, d: str) -> DataFrame:
    canonical = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")))
    return table(spark, d, "part").select("p_partkey", F.sha2(canonical, 256).alias("version"), F.sha2("p_name", 256).alias("content"))


@query("X16_salted_order", "SELECT o_orderkey, ('0x' || left(md5(o_orderkey || 'a'), 8))::BIGINT % 1000 AS a, ('0x' || left(md5(o_orderkey || '/' || o_custkey), 8))::BIGINT % 1000 AS pair FROM orders")
def salted(spark: SparkSession, d: str) -> DataFrame:
    pair = sample.comparable_hash(F.concat_ws("/", "o_orderkey", "o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", (sample.salted("o_orderkey", "a") % 1000).alias("a"), (pair % 1000).alias("pair"))


INTERVALS = {"1m": 60, "5m": 300, "15m": 900, "4h": 14_400, "12h": 43_200, "24h": 86_400}


@query("Z17_six_intervals", " UNION ALL ".join(f"SELECT '{n}' AS interval, epoch_us(ts) // {s}000000 * {s}000 AS start, count(*) AS n, count(DISTINCT user_id) AS posts FROM events GROUP BY ALL" for n, s in INTERVALS.items()))
def intervals(spark: SparkSession, d: str) -> DataFrame:
    events = events_of(spark, d)
    # the finest intervals are grouped once; coarser ones from their posts, which is exact since posts are kept apart
    base = events.groupBy(activity.bucket(F.col("t"), 60_000).alias("minute"), "post").agg(F.count(ONE).alias("n"))
    one = lambda n, s: base.groupBy(F.lit(n).alias("interval"), activity.bucket(F.col("minute"), s * 1000).alias("start")).agg(F.sum("n").alias("n"), F.count_distinct("post").alias("posts"))
    return reduce(DataFrame.unionByName, [one(n, s) for n, s in INTERVALS.items()])


@query("W10_live_end", "WITH n AS (SELECT max(epoch_us(ts)) // 1000 + 1 AS now FROM events), w AS (SELECT event_id FROM events, n WHERE epoch_us(ts) // 1000 >= now - 86400000 AND epoch_us(ts) // 1000 < now) SELECT count(*) AS n, min(event_id) AS low, max(event_id) AS high FROM w")
def live_end(spark: SparkSession, d: str) -> DataFrame:
    events = events_of(spark, d)
    now = events.agg(F.max("t") + 1).scalar()
    return events.where((F.col("t") >= now - 86_400_000) & (F.col("t") < now)).agg(F.count(ONE).alias("n"), F.min("event_id").alias("low"), F.max("event_id").alias("high"))
