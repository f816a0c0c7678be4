"""Latest state and per-key histories of versioned rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by ``order``; the planner limits each group before the shuffle."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def newest_complete(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The row of each key that is largest by those of ``columns`` that exist, nulls last."""
    have = [F.desc_nulls_last(c) for c in columns if c in rows.columns]
    return latest(rows, [key], have or [F.col(key)])


def top_n(rows: DataFrame, key: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.where(F.col("rank") <= n)


def transitions(rows: DataFrame, order: Sequence[str], metric: str) -> DataFrame:
    """Of each id: rows, rises and falls of ``metric`` and repeats of a version between neighbours in time."""
    w = Window.partitionBy("id").orderBy(*order)
    step = rows.withColumn("prev", F.lag(metric).over(w)).withColumn("same", F.lag("version").over(w) == F.col("version"))
    return step.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(metric) > F.col("prev")).alias("rises"), F.count_if(F.col(metric) < F.col("prev")).alias("falls"), F.count_if("same").alias("same_version"),
    )


def trajectories(rows: DataFrame, order: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """First and last value, change and change per hour (from one hour on) of each metric of each id."""
    at = F.struct(*order)
    out = rows.groupBy("id").agg(
        F.count(F.lit(1)).alias("observations"), F.min("version").alias("first_version"), F.max("version").alias("last_version"),
        *[f(m, at).alias(f"{n}_{m}") for m in metrics for n, f in (("first", F.min_by), ("last", F.max_by))],
    )
    seconds = F.unix_seconds(F.col("last_version").cast("timestamp")) - F.unix_seconds(F.col("first_version").cast("timestamp"))
    out = out.withColumn("seconds", seconds)
    for m in metrics:
        out = out.withColumn(f"delta_{m}", F.col(f"last_{m}") - F.col(f"first_{m}"))
        out = out.withColumn(f"hourly_{m}", F.when(F.col("seconds") >= 3600, F.round(F.col(f"delta_{m}") * 3600.0 / F.col("seconds"), 6)))
    return out


def running_balance(rows: DataFrame, key: Sequence[str], order: Sequence[str], delta: str, opening: str) -> DataFrame:
    """Signed sums since the last opening of each key; the opening's own value restarts the sum."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("openings", F.sum(F.col(opening).cast("long")).over(w))
    since = Window.partitionBy(*key, "openings").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("balance", F.sum(delta).over(since))


def as_of(rows: DataFrame, key: str, t: str, value: str, cutoffs: DataFrame) -> DataFrame:
    """For each row of ``cutoffs`` (key, at): the last value at or before it; one shuffle, by key."""
    both = rows.select(key, F.col(t).alias("at"), F.lit(0).alias("ask"), F.col(value).alias("value")).unionByName(cutoffs.select(key, "at", F.lit(1).alias("ask"), F.lit(None).cast(rows.schema[value].dataType).alias("value")))
    w = Window.partitionBy(key).orderBy("at", "ask").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("value", F.last("value", ignorenulls=True).over(w)).where("ask = 1").drop("ask")
