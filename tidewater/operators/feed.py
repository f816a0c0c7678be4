"""Feeds to consumers: shortlists, sort modes, bounded frames, replay clocks, completion, sentence budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shortlist(rows: DataFrame, key: str, fold: Column, author: str, engagement: str, per_author: int = 2, limit: int = 30) -> DataFrame:
    """The most engaging rows, texts of one fold once with their number of echoes, few of one author.

    Folds are counted before any window, so only one row of each reaches the ranking of authors.
    """
    best = rows.withColumn("fold", fold).groupBy("fold").agg(F.max_by(F.struct(key, author, engagement), F.struct(F.col(engagement), (-F.col(key)).alias("k"))).alias("x"), (F.count(F.lit(1)) - 1).alias("echoes"))
    order = [F.desc(engagement), key]
    rank = F.row_number().over(Window.partitionBy(author).orderBy(*order))
    return best.select("x.*", "echoes").withColumn("rank", rank).where(F.col("rank") <= per_author).orderBy(*order).limit(limit).drop("rank")


#: Sort modes of drill-down and evidence pages, as what comes first.
MODES = {
    "likes": lambda: F.desc("likes"),
    "newest": lambda: F.desc("created_at"),
    "negative": lambda: F.asc("score"),
    "positive": lambda: F.desc("score"),
    "low_confidence": lambda: F.asc(F.abs("score")),
    "random": lambda: F.md5(F.col("id").cast("string").cast("binary")),
}


def page(rows: DataFrame, mode: str, size: int = 50) -> DataFrame:
    """One page in a sort mode; ties by id, so a page is the same each time."""
    if mode not in MODES:
        raise ValueError(f"{mode!r} is none of {', '.join(MODES)}")
    return rows.orderBy(MODES[mode](), "id").limit(size).withColumn("mode", F.lit(mode))


def frames(events: DataFrame, scope: Column, size: int = 1000) -> DataFrame:
    """Bounds of frames of up to ``size`` events in time order within each scope (such as a day)."""
    place = F.row_number().over(Window.partitionBy("scope").orderBy("ts", "event_id")) - 1
    cut = events.withColumn("scope", scope).withColumn("frame", F.floor(place / size))
    return cut.groupBy("scope", "frame").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def delivery(elapsed: Column, speed: float, pauses: Sequence[tuple[float, float]] = ()) -> Column:
    """Wall time at which a replay reaches an event ``elapsed`` after the start; pauses are wall times in order."""
    wall = elapsed / speed
    for begin, end in pauses:
        wall = F.when(wall > begin, wall + (end - begin)).otherwise(wall)
    return wall


def ready(events: DataFrame, done: DataFrame, delivered: DataFrame, consumer: str, key: str) -> DataFrame:
    """Events whose label is there and that the consumer has not had, each once, numbered in each consumer's order."""
    new = events.join(done, key).join(delivered.select(consumer, key), [consumer, key], "left_anti").dropDuplicates([consumer, key])
    return new.withColumn("cursor", F.row_number().over(Window.partitionBy(consumer).orderBy(key)))


def clipped(text: Column, budget: int) -> Column:
    """The leading sentences that hold ``budget`` words or fewer together; sentences end at a full stop and a blank."""
    parts = F.split(text, r"\. ")
    step = lambda a, x: F.when(a["open"] & (a["n"] + F.size(F.split(x, " ")) <= budget), F.struct((a["n"] + F.size(F.split(x, " "))).alias("n"), (a["kept"] + 1).alias("kept"), F.lit(True).alias("open"))).otherwise(F.struct(a["n"].alias("n"), a["kept"].alias("kept"), F.lit(False).alias("open")))
    return F.aggregate(parts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("kept"), F.lit(True).alias("open")), step)


def tier(n_rows: int, budget: int = 30_000_000) -> str:
    """Exact where the window's rows are within the budget, else the one per cent sample."""
    return "exact" if n_rows <= budget else "sample"


def run_status(n_sampled: int, n_scored: int) -> str:
    """A run of which half of the sample or less was scored has failed."""
    return "FAILED" if 2 * n_scored <= n_sampled else "READY"
