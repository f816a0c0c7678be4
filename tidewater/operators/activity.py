"""Event-time activity: posts and signed changes become weighted, exact windows.

A post's weight in a window is its publications there plus ln(1 + its net change there, not under 0): the net is taken per
post over the whole window before the logarithm, so windows are summed from posts, never from smaller windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000


def bucket(t: Column, size: int) -> Column:
    return (F.floor(t / size) * size).cast("long")


def moments(events: DataFrame, keys: list[str]) -> DataFrame:
    """Of each post in each group: publications, net change and its latest score with its time; these merge over groups."""
    order = F.struct("t", F.when(F.col("kind") == "post", 0).otherwise(1).alias("o"), "event_id", "score")
    return events.groupBy(*keys, "target", "post").agg(
        F.count_if(F.col("kind") == "post").alias("published"), F.sum(F.when(F.col("kind") == "like", F.col("delta")).otherwise(0)).alias("net"), F.max(F.when(F.col("score").isNotNull(), order)).alias("latest"),
    )


def weighed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("score", F.col("latest.score")).withColumn("weight", F.col("published") + F.log1p(F.greatest(F.lit(0), F.col("net")).cast("double")))


def per_post(events: DataFrame, keys: list[str]) -> DataFrame:
    """Of each post in each group: publications, net change, latest score and weight."""
    return weighed(moments(events, keys))


def aggregate(events: DataFrame, keys: list[str]) -> DataFrame:
    """Of each target (and group): posts, active posts, weight, weighted mean, spread, traction and the top post."""
    return summed(per_post(events, keys), keys)


def summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The aggregate of posts as of ``per_post``."""
    w, s = F.col("weight"), F.col("score")
    out = rows.groupBy(*keys, "target").agg(
        F.sum("published").alias("volume"), F.count_if(w > 0).alias("active"), F.sum(w).alias("w"), F.sum(w * s).alias("ws"), F.sum(w * s * s).alias("wss"),
        F.sum("net").alias("traction"), F.max_by("post", F.struct("net", -F.col("post"))).alias("top_post"),
    )
    mean = F.when(F.col("w") > 0, F.col("ws") / F.col("w"))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.when(F.col("w") > 0, F.col("wss") / F.col("w")) - mean * mean))
    return out.select(*keys, "target", "volume", "active", F.round("w", 4).alias("weight"), F.round(mean, 4).alias("mean"), F.round(F.when(F.col("w") > 0, spread), 3).alias("spread"), "traction", "top_post")


def window(events: DataFrame, start: int, end: int) -> DataFrame:
    """The aggregate over exactly [start, end)."""
    return aggregate(events.where((F.col("t") >= start) & (F.col("t") < end)), [])


def bucketed(events: DataFrame, size: int) -> DataFrame:
    return aggregate(events.withColumn("start", bucket(F.col("t"), size)), ["start"])


def trailing(events: DataFrame, span: int, step: int) -> DataFrame:
    """The aggregate over the last ``span`` at every ``step``: posts are summed by step first, and each step's sums fall in
    span / step windows."""
    steps = moments(events.withColumn("step", bucket(F.col("t"), step)), ["step"])
    ends = steps.withColumn("until", F.explode(F.sequence(F.col("step") + step, F.col("step") + span, F.lit(step))))
    merged = ends.groupBy("until", "target", "post").agg(F.sum("published").alias("published"), F.sum("net").alias("net"), F.max("latest").alias("latest"))
    return summed(weighed(merged), ["until"])


def filled(series: DataFrame, size: int, columns: list[str]) -> DataFrame:
    """A row for every target and bucket between the target's first and last; gaps have null in ``columns``."""
    spine = series.groupBy("target").agg(F.explode(F.sequence(F.min("start"), F.max("start"), F.lit(size))).alias("start"))
    return spine.join(series.select("target", "start", *columns), ["target", "start"], "left")


def overlap(buckets: DataFrame, size: int, windows: DataFrame, value: str) -> DataFrame:
    """``value`` of buckets shared out over windows (w, lo, hi) by overlap: windows meet buckets by an equi-join on starts."""
    parts = windows.withColumn("start", F.explode(F.sequence(bucket(F.col("lo"), size), bucket(F.col("hi") - 1, size), F.lit(size))))
    met = buckets.join(parts, "start")
    share = (F.least(F.col("hi"), F.col("start") + size) - F.greatest(F.col("lo"), F.col("start"))) / F.lit(float(size))
    return met.groupBy("w").agg(F.round(F.sum(share * F.col(value)), 4).alias(value))


def sliding_mean(rows: DataFrame, key: str, order: list[str], value: str, n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(n - 1), 0)
    return rows.withColumn("mean", F.round(F.avg(value).over(w), 6))
