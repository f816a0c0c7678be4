"""Statistics of shifts between periods, trends and corrected significance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.sources import scratch


def stratified_shift(rows: DataFrame, topic: str, stratum: str, late: str, value: str) -> DataFrame:
    """Mean change between periods over strata weighted by their smaller count, with its standard error."""
    s = rows.groupBy(topic, stratum).agg(*[f(F.when(F.col(late) == flag, F.col(value))).alias(f"{n}{int(flag)}") for flag in (False, True) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    s = s.where("n0 > 1 and n1 > 1").withColumn("w", F.least("n0", "n1"))
    w = F.col("w")
    shift = F.sum(w * (F.col("m1") - F.col("m0"))) / F.sum(w)
    error = F.sqrt(F.sum(w * w * (F.col("v0") / F.col("n0") + F.col("v1") / F.col("n1")))) / F.sum(w)
    return s.groupBy(topic).agg(F.round(shift, 4).alias("shift"), F.round(error, 4).alias("error"))


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows``, stored, with ``part`` (a range of the order), ``place`` in the whole order from 1 on, and ``n``, all rows.

    Ranges are numbered in parallel; only their sizes, one row a range, meet to give each range its first place.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.put(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    every = Window.orderBy("part")
    before = sizes.select("part", (F.sum("size").over(every) - F.col("size")).alias("before"), F.sum("size").over(Window.partitionBy()).alias("n"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.join(F.broadcast(before), "part").withColumn("place", own + F.col("before")).drop("before")


def benjamini_hochberg(tests: DataFrame, key: str, p: str) -> DataFrame:
    """q-values of one family of tests: the least p * n / place from here on, by ranges of the order."""
    rows = ranked(tests.select(key, p), p, key).withColumn("x", F.col(p) * F.col("n") / F.col("place"))
    least = rows.groupBy("part").agg(F.min("x").alias("x"))
    later = least.select("part", F.min("x").over(Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)).alias("later"))
    here = F.min("x").over(Window.partitionBy("part").orderBy(F.desc("place")))
    q = F.least(F.lit(1.0), here, F.col("later"))
    return rows.join(F.broadcast(later), "part").select(key, F.round(p, 6).alias("p"), F.round(q, 6).alias("q"))


def weighted_trend(rows: DataFrame, key: str) -> DataFrame:
    """Weighted least squares of y on x (columns x, y, w): slope, value at the mean, and r squared."""
    x, y, w = (F.col(c) for c in "xyw")
    s = rows.groupBy(key).agg(F.sum(w).alias("s"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * x * y).alias("sxy"), F.sum(w * y * y).alias("syy"))
    vx, vy, c = F.expr("s * sxx - sx * sx"), F.expr("s * syy - sy * sy"), F.expr("s * sxy - sx * sy")
    return s.select(key, F.round(F.try_divide(c, vx), 6).alias("slope"), F.round(F.col("sy") / F.col("s"), 6).alias("mean"), F.round(F.try_divide(c * c, vx * vy), 6).alias("r2"))


def fitted_trend(rows: DataFrame, key: str) -> DataFrame:
    """Weighted least squares of y on x by key and for all rows together (key ``all``): slope, fitted ends, change, extremes.

    Sums are centred by the weighted means of a first pass, so large x don't cancel.
    """
    both = rows.select(key, "x", "y", "w").unionByName(rows.select(F.lit("all").alias(key), "x", "y", "w"))
    x, y, w = (F.col(c) for c in "xyw")
    means = both.groupBy(key).agg((F.sum(w * x) / F.sum(w)).alias("mx"), (F.sum(w * y) / F.sum(w)).alias("my"))
    dx, dy = x - F.col("mx"), y - F.col("my")
    s = both.join(means, key).groupBy(key, "mx", "my").agg(F.try_divide(F.sum(w * dx * dy), F.sum(w * dx * dx)).alias("b"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("low"), F.max("y").alias("high"))
    b = F.coalesce("b", F.lit(0.0))
    at = lambda c: F.round(F.col("my") + b * (F.col(c) - F.col("mx")), 6)
    return s.select(key, F.round(b, 6).alias("slope"), at("x0").alias("start"), at("x1").alias("end"), F.round(b * (F.col("x1") - F.col("x0")), 6).alias("change"), "low", "high")


def poisson_interval(hits: Column, scale: float) -> tuple[Column, Column]:
    """95 % limits of a count times ``scale``; of no hits: 0 to 3 times the scale."""
    half = 1.96 * F.sqrt(hits)
    return F.when(hits == 0, 0.0).otherwise(F.greatest(F.lit(0), hits - half) * scale), F.when(hits == 0, 3.0 * scale).otherwise((hits + half) * scale)


def cluster_bootstrap(rows: DataFrame, topic: str, author: str, late: str, value: str, draws: int = 1000, bins: int = 2000, seed: int = 7, least: int = 10) -> DataFrame:
    """Interval of the mean difference between periods, drawing clusters of authors with replacement.

    Authors are hashed into ``bins`` clusters, whose sums are computed in the cluster; the draws see ``bins`` rows a
    topic at most, whatever the corpus. Topics of fewer than ``least`` rows in a period have no interval.
    """
    cluster = rows.groupBy(topic, F.pmod(F.xxhash64(author), F.lit(bins)).alias("bin")).agg(*[f(F.when(F.col(late) == flag, F.col(value))).cast("double").alias(f"{n}{int(flag)}") for flag in (False, True) for n, f in (("s", F.sum), ("n", F.count))])

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.fillna(0.0).sort_values("bin")
        if pdf["n0"].sum() < least or pdf["n1"].sum() < least:
            return pd.DataFrame({topic: [pdf[topic].iloc[0]], "lo": [np.nan], "hi": [np.nan]})
        times = np.random.default_rng(seed).multinomial(len(pdf), np.full(len(pdf), 1 / len(pdf)), draws)
        sums = times @ pdf[["s0", "n0", "s1", "n1"]].to_numpy()
        ok = (sums[:, 1] > 0) & (sums[:, 3] > 0)
        diff = sums[ok, 2] / sums[ok, 3] - sums[ok, 0] / sums[ok, 1]
        lo, hi = np.quantile(diff, [0.025, 0.975]) if len(diff) else (np.nan, np.nan)
        return pd.DataFrame({topic: [pdf[topic].iloc[0]], "lo": [lo], "hi": [hi]})

    return cluster.groupBy(topic).applyInPandas(draw, f"{topic} {rows.schema[topic].dataType.simpleString()}, lo double, hi double")
