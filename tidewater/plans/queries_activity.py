"""Queries of event-time activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import activity as act
from tidewater.operators import state
from tidewater.plans.catalog import query
from tidewater.schema import activity, table

EVENTS = "ev AS (SELECT event_id, epoch_us(ts) AS us, epoch_us(ts) // 1000 AS t, user_id % 5 AS target, user_id AS post, CASE WHEN event_type = 'view' THEN 'post' ELSE 'like' END AS kind, CAST(CASE WHEN event_type = 'error' THEN -1 WHEN event_type = 'view' THEN 0 ELSE 1 END * ceil(value) AS BIGINT) AS delta, CAST(CAST(floor(value) AS BIGINT) % 11 AS DOUBLE) AS score, event_type = 'signup' AS opening FROM events)"
H4 = 4 * act.HOUR


def grouped(keys: str, source: str) -> str:
    k = f"{keys}, " if keys else ""
    return f"pp AS (SELECT {k}target, post, count(*) FILTER (WHERE kind = 'post') AS published, CAST(sum(CASE WHEN kind = 'like' THEN delta ELSE 0 END) AS BIGINT) AS net, arg_max(score, (t, CASE WHEN kind = 'post' THEN 0 ELSE 1 END, event_id)) AS score FROM {source} GROUP BY ALL), pw AS (SELECT *, published + ln(1 + greatest(0, net)) AS w FROM pp) SELECT {k}target, CAST(sum(published) AS BIGINT) AS volume, count(*) FILTER (WHERE w > 0) AS active, round(sum(w), 4) AS weight, round(CASE WHEN sum(w) > 0 THEN sum(w * score) / sum(w) END, 4) AS mean, round(CASE WHEN sum(w) > 0 THEN sqrt(greatest(0, sum(w * score * score) / sum(w) - pow(sum(w * score) / sum(w), 2))) END, 3) AS spread, CAST(sum(net) AS BIGINT) AS traction, arg_max(post, (net, -post)) AS top_post FROM pw GROUP BY ALL"


@query("A31_activity", f"WITH {EVENTS}, {grouped('', 'ev')}")
def total(spark: SparkSession, d: str) -> DataFrame:
    return act.aggregate(activity(spark, d), [])


@query("Z12_four_hour_buckets", f"WITH {EVENTS}, b AS (SELECT *, t // {H4} * {H4} AS start FROM ev), {grouped('start', 'b')}")
def buckets(spark: SparkSession, d: str) -> DataFrame:
    return act.bucketed(activity(spark, d), H4)


@query("Z17_display_intervals", f"WITH {EVENTS}, b AS (SELECT *, t // {6 * H4} * {6 * H4} AS start FROM ev), {grouped('start', 'b')}")
def daily(spark: SparkSession, d: str) -> DataFrame:
    return act.bucketed(activity(spark, d), 6 * H4)


START = 1704672000000  # 2024-01-08


@query("Z18_exact_window", f"WITH {EVENTS}, b AS (SELECT * FROM ev WHERE t >= {START + 12345} AND t < {START + 98765432}), {grouped('', 'b')}")
def exact(spark: SparkSession, d: str) -> DataFrame:
    return act.window(activity(spark, d), START + 12345, START + 98765432)


@query("F23_Z14_as_of_snapshot", f"WITH {EVENTS}, b AS (SELECT * FROM ev WHERE t <= {START}), {grouped('', 'b')}")
def snapshot(spark: SparkSession, d: str) -> DataFrame:
    return act.aggregate(activity(spark, d).where(F.col("t") <= START), [])


@query("W10_trailing_day", f"WITH {EVENTS}, b AS (SELECT *, unnest(generate_series(t // {H4} * {H4} + {H4}, t // {H4} * {H4} + {6 * H4}, {H4})) AS until FROM ev), {grouped('until', 'b')}")
def trailing(spark: SparkSession, d: str) -> DataFrame:
    return act.trailing(activity(spark, d), 6 * H4, H4)


@query("W7_Z16_running_balance", f"WITH {EVENTS}, o AS (SELECT *, sum(opening::INT) OVER w AS openings FROM ev WINDOW w AS (PARTITION BY post ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)) SELECT event_id, post, CAST(openings AS BIGINT) AS openings, CAST(sum(delta) OVER (PARTITION BY post, openings ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM o")
def balance(spark: SparkSession, d: str) -> DataFrame:
    return state.running_balance(activity(spark, d), ["post"], ["us", "event_id"], "delta", "opening").select("event_id", "post", "openings", "balance")


@query("W14_cumulative_traction", f"WITH {EVENTS} SELECT event_id, CAST(sum(delta) OVER (PARTITION BY target, t // {H4} ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS traction FROM ev")
def cumulative(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = activity(spark, d).withColumn("start", act.bucket(F.col("t"), H4))
    w = Window.partitionBy("target", "start").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("event_id", F.sum("delta").over(w).alias("traction"))


@query("W11_trailing_mean", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS mean FROM events")
def mean(spark: SparkSession, d: str) -> DataFrame:
    return act.sliding_mean(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 10).select("event_id", "mean")


@query("Z19_gap_filling", f"WITH {EVENTS}, c AS (SELECT target, t // {act.HOUR} * {act.HOUR} AS start, count(*) AS n FROM ev WHERE kind = 'post' GROUP BY ALL), s AS (SELECT target, unnest(generate_series(min(start), max(start), {act.HOUR})) AS start FROM c GROUP BY target) SELECT target, start, n FROM s LEFT JOIN c USING (target, start)")
def gaps(spark: SparkSession, d: str) -> DataFrame:
    c = activity(spark, d).where("kind = 'post'").groupBy("target", act.bucket(F.col("t"), act.HOUR).alias("start")).agg(F.count(F.lit(1)).alias("n"))
    return act.filled(c, act.HOUR, ["n"])


@query("J14_interval_overlap", f"WITH {EVENTS}, c AS (SELECT t // {H4} * {H4} AS start, count(*) AS n FROM ev GROUP BY ALL), w AS (SELECT user_id AS w, {START} + user_id * 777777 AS lo, {START} + user_id * 777777 + 10000000 AS hi FROM (SELECT DISTINCT user_id FROM events)) SELECT w, round(sum((least(hi, start + {H4}) - greatest(lo, start)) / CAST({H4} AS DOUBLE) * n), 4) AS n FROM c JOIN w ON start < hi AND start + {H4} > lo GROUP BY w")
def overlap(spark: SparkSession, d: str) -> DataFrame:
    events = activity(spark, d)
    c = events.groupBy(act.bucket(F.col("t"), H4).alias("start")).agg(F.count(F.lit(1)).alias("n"))
    lo = START + F.col("w") * 777777
    w = events.select(F.col("post").alias("w")).distinct().select("w", lo.alias("lo"), (lo + 10000000).alias("hi"))
    return act.overlap(c, H4, w, "n")


@query("Z15_dedupe_by_id", "SELECT user_id, count(DISTINCT event_id) AS n FROM events GROUP BY user_id")
def once(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.unionByName(e).dropDuplicates(["event_id"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("Z22_A42_five_minute_counts", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, count(*) AS n, count(DISTINCT epoch_us(ts) // 5000000) AS slots FROM events GROUP BY 1")
def slots(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("slot", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 5_000_000))
    return e.groupBy(F.window("ts", "5 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("slot").alias("slots")).select(F.col("w.start").alias("start"), "n", "slots")


@query("Z21_sequence_gaps", "WITH s AS (SELECT event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events) SELECT event_id, step FROM s WHERE step > 100")
def sequence(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    step = F.col("event_id") - F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, d, "events").select("event_id", step.alias("step")).where("step > 100")
