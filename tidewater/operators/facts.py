"""Corpus facts: profiles, denominators, topic-day facts, shares and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALL, NULL = "<ALL>", "<NULL>"


def denominators(posts: DataFrame) -> DataFrame:
    """day, lang (``<ALL>`` on total rows): posts, authors, likes; the last day is partial. Authors are counted per set."""
    rows = posts.withColumn("lang", F.coalesce("lang", F.lit(NULL)))
    sets = rows.groupingSets([["day", "lang"], ["day"]], "day", "lang").agg(
        F.grouping("lang").alias("g"), F.count(F.lit(1)).alias("tweets"), F.count_distinct("author_id").alias("authors"), F.sum("likes").alias("likes"), F.count_if(F.col("status") == "F").alias("finished"),
    )
    last = posts.agg(F.max("day").alias("last"))
    named = sets.withColumn("lang", F.when(F.col("g") == 1, ALL).otherwise(F.col("lang"))).drop("g")
    return named.withColumn("partial_day", F.col("day") == last.select("last").scalar())


def topic_days(posts: DataFrame, tags: Column) -> DataFrame:
    """topic, day: facts over posts that carry the topic once or more; ``tags`` is an array."""
    tagged = posts.withColumn("topic", F.explode(F.array_distinct(tags)))
    return tagged.groupBy("topic", "day").agg(F.count(F.lit(1)).alias("tweets"), F.count_distinct("author_id").alias("authors"), F.sum("likes").alias("likes"))


def volume_ranking(facts: DataFrame, days: DataFrame, least: int, n: int = 100) -> DataFrame:
    """Topics by posts over complete days; ``days`` is the <ALL> part of the denominators."""
    full = facts.join(days.where("not partial_day").select("day"), "day")
    return full.groupBy("topic").agg(F.sum("tweets").alias("tweets"), F.count_distinct("day").alias("days")).where(F.col("tweets") >= least).orderBy(F.desc("tweets"), "topic").limit(n)


def spikes(facts: DataFrame, days: DataFrame, least: int, n: int = 200) -> DataFrame:
    """Days on which a topic's share of all posts is highest against its share over all complete days."""
    total = days.where("not partial_day").select("day", F.col("tweets").alias("all_tweets"))
    joined = facts.join(total, "day")
    by_topic = Window.partitionBy("topic")
    base = F.sum("tweets").over(by_topic) / F.sum("all_tweets").over(by_topic)
    rows = joined.withColumn("base", base).where(F.col("tweets") >= least)
    ratio = F.round(F.col("tweets") / F.col("all_tweets") / F.col("base"), 6)
    return rows.select("topic", "day", "tweets", F.round(F.col("tweets") * 100000.0 / F.col("all_tweets"), 4).alias("per_100k"), ratio.alias("ratio")).orderBy(F.desc("ratio"), "topic", "day").limit(n)


def bursts(facts: DataFrame, days: DataFrame, cut: str, least: int) -> DataFrame:
    """Best day of each topic within each collection regime (before, from ``cut``) by log2(smoothed ratio) * log1p(posts).

    The baseline is the regime's other days.
    """
    total = days.where("not partial_day").select("day", F.col("tweets").alias("all_tweets"))
    rows = facts.join(total, "day").withColumn("regime", F.when(F.col("day") < F.lit(cut).cast("date"), "before").otherwise("from"))
    all_days = total.withColumn("regime", F.when(F.col("day") < F.lit(cut).cast("date"), "before").otherwise("from")).groupBy("regime").agg(F.sum("all_tweets").alias("regime_tweets"))
    w = Window.partitionBy("topic", "regime")
    rows = rows.withColumn("topic_tweets", F.sum("tweets").over(w)).join(all_days, "regime").where(F.col("tweets") >= least)
    own = (F.col("tweets") + 0.5) / (F.col("all_tweets") + 1)
    rest = (F.col("topic_tweets") - F.col("tweets") + 0.5) / (F.col("regime_tweets") - F.col("all_tweets") + 1)
    rows = rows.withColumn("score", F.round(F.log2(own / rest) * F.log1p("tweets"), 6))
    best = rows.withColumn("n", F.row_number().over(w.orderBy(F.desc("score"), "day"))).where("n = 1")
    return best.select("topic", "regime", "day", "tweets", "score")


def with_shares(counts: DataFrame, over: Sequence[str], n: str = "n") -> DataFrame:
    return counts.withColumn("share", F.round(F.col(n) / F.sum(n).over(Window.partitionBy(*over)), 6))


def weighted_mean(rows: DataFrame, keys: Sequence[str], score: Column, weight: Column, ok: Column) -> DataFrame:
    """Mean of ``score`` weighted by 1 + weight, the plain mean, rows scored and rows gated out (a null gate too)."""
    passed = F.coalesce(ok, F.lit(False))
    s, w = F.when(passed, score), F.when(passed & score.isNotNull(), 1 + weight)
    return rows.groupBy(*keys).agg(
        F.round(F.sum(s * w) / F.sum(w), 6).alias("weighted"), F.round(F.avg(s), 6).alias("plain"), F.count(s).alias("n"), F.count_if(~passed).alias("gated_out"),
    )


def profile(rows: DataFrame, key: str, numbers: Sequence[str]) -> DataFrame:
    """One row: rows, distinct keys, and nulls, minimum, maximum of each number."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("n_keys"), *[f(c).alias(f"{name}_{c}") for c in numbers for name, f in (("nulls", lambda c: F.count_if(F.col(c).isNull())), ("min", F.min), ("max", F.max))])


def repeats(rows: DataFrame, key: Column) -> DataFrame:
    """Histogram of how often keys occur."""
    return rows.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("times")).groupBy("times").agg(F.count(F.lit(1)).alias("keys"))


def keyword_hits(posts: DataFrame, text: str, keywords: dict[str, str], literals: dict[str, str] | None = None) -> DataFrame:
    """One row for each post and keyword whose pattern its text matches, in one pass.

    ``literals`` has, in lower case, what a text must contain for a keyword's pattern to match: a cheap look before it.
    """
    low = F.lower(text)
    hits = {k: (low.contains(literals[k]) & F.col(text).rlike(p)) if literals and k in literals else F.col(text).rlike(p) for k, p in keywords.items()}
    return posts.withColumn("keyword", F.explode(F.array_compact(F.array(*[F.when(hit, F.lit(k)) for k, hit in hits.items()]))))


def pivoted(rows: DataFrame, key: str, series: str, names: Sequence[str]) -> DataFrame:
    """One row for each key, one count for each series, and their total."""
    wide = rows.groupBy(key).pivot(series, list(names)).count().na.fill(0)
    return wide.withColumn("total", sum((F.col(n) for n in names), F.lit(0)).cast("long"))
