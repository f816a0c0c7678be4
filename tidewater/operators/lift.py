"""Lifts: how much more often something occurs than other rows make one expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Added to both counts of a ratio, so that rare things neither divide by nothing nor look extreme.
SMOOTH = 0.5


def smoothed_ratio(a: Column, b: Column) -> Column:
    return (a + SMOOTH) / (b + SMOOTH)


def adjusted_lift(counts: DataFrame, totals: DataFrame, topic: str, period: str, stratum: str) -> DataFrame:
    """Observed over expected by topic and period, by indirect standardisation over strata.

    ``counts`` (topic, period, stratum, n) and ``totals`` (period, stratum, n_all). A topic's rate in each stratum, over
    all periods, times the stratum's size in a period sums to what the period would have if only the mix had changed.
    """
    rates = counts.groupBy(topic, stratum).agg(F.sum("n").alias("n_topic")).join(totals.groupBy(stratum).agg(F.sum("n_all").alias("n_stratum")), stratum)
    expected = rates.join(totals, stratum).groupBy(topic, period).agg(F.sum(F.col("n_topic") / F.col("n_stratum") * F.col("n_all")).alias("expected"))
    observed = counts.groupBy(topic, period).agg(F.sum("n").alias("n"))
    out = observed.join(expected, [topic, period])
    return out.select(topic, period, "n", F.round("expected", 4).alias("expected"), F.round(smoothed_ratio(F.col("n"), F.col("expected")), 4).alias("lift"))


def peak_against_median(counts: DataFrame, totals: DataFrame, topic: str, period: str) -> DataFrame:
    """Of each topic the period of the largest smoothed share (ties: the first) and its ratio to the median share."""
    shares = counts.join(totals, period).withColumn("share", (F.col("n") + SMOOTH) / (F.col("n_all") + 1))
    out = shares.groupBy(topic).agg(F.max_by(period, F.struct(F.col("share"), (-F.unix_date(period)).alias("b"))).alias("peak"), F.max("share").alias("top"), F.percentile("share", F.lit(0.5)).alias("mid"))
    return out.select(topic, "peak", F.round(F.col("top") / F.col("mid"), 4).alias("lift"))


def discovered(tokens: DataFrame, core: str, least: int) -> DataFrame:
    """Tokens of core rows against the rest: (doc, token, core flag) to counts and the ratio of smoothed rates.

    Each token counts once a document; ``least`` core documents are asked for. The two sizes are scalars of one row.
    """
    once = tokens.distinct()
    sizes = once.select("doc", core).distinct().agg(F.count_if(F.col(core)).alias("a"), F.count_if(~F.col(core)).alias("b"))
    found = once.groupBy("token").agg(F.count_if(F.col(core)).alias("n_core"), F.count_if(~F.col(core)).alias("n_rest")).where(F.col("n_core") >= least)
    rate = lambda n, size: (F.col(n) + SMOOTH) / (sizes.select(size).scalar() + 1)
    return found.select("token", "n_core", "n_rest", F.round(rate("n_core", "a") / rate("n_rest", "b"), 4).alias("lift"))
