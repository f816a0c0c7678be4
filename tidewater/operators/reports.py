"""Reports over facts and scores: ranked bursts, n-gram bursts, shifts, outliers, annotations, bubbles, classifications."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Baselines of fewer posts are flagged and rank last; supports of a shift; what a strong shift is.
LOW_BASELINE, LEAST_STRATUM, LEAST_STRONG, STRONG = 50, 10, 80, 0.15


def burst_ranking(facts: DataFrame, days: DataFrame, regime: Column, least: int = 200, authors: int = 100) -> DataFrame:
    """Of each topic its best day by log2(ratio) * log1p(tweets) among days of support and a ratio above 1.

    ``facts`` (topic, day, tweets, authors), ``days`` (day, all_tweets) of complete days, ``regime`` a column over day. The
    baseline is the other complete days of the day's regime. First come topics whose baseline isn't low, by score.
    """
    full = days.withColumn("regime", regime)
    whole = full.groupBy("regime").agg(F.sum("all_tweets").alias("regime_all"), F.min("day").alias("first"), F.max("day").alias("last"))
    rows = facts.join(full, "day").withColumn("own", F.sum("tweets").over(Window.partitionBy("topic", "regime"))).join(F.broadcast(whole), "regime")
    base, base_all = F.col("own") - F.col("tweets"), F.col("regime_all") - F.col("all_tweets")
    ratio = ((F.col("tweets") + 0.5) / (F.col("all_tweets") + 1)) / ((base + 0.5) / (base_all + 1))
    rows = rows.where((F.col("tweets") >= least) & (F.col("authors") >= authors)).withColumn("ratio", ratio).where("ratio > 1")
    rows = rows.withColumn("score", F.log2("ratio") * F.log1p("tweets"))
    best = rows.groupBy("topic").agg(F.max_by(F.struct("day", "regime", "tweets", "authors", "ratio", "score", base.alias("baseline"), (F.col("day").isin(F.col("first"), F.col("last"))).alias("boundary")), F.struct("score", (-F.unix_date("day")).alias("early"))).alias("x"))
    out = best.select("topic", "x.*").withColumn("low_baseline", F.col("baseline") < LOW_BASELINE)
    return out.orderBy("low_baseline", F.desc("score"), "topic")


def filled_series(ranking: DataFrame, facts: DataFrame, days: DataFrame) -> DataFrame:
    """topic, day, tweets and per_100k on every day for ranked topics; none is zero. Days are a calendar, so they are broadcast."""
    spine = ranking.select("topic").join(F.broadcast(days))
    rows = spine.join(facts.select("topic", "day", "tweets"), ["topic", "day"], "left").withColumn("tweets", F.coalesce("tweets", F.lit(0)))
    return rows.select("topic", "day", "tweets", F.round(F.col("tweets") * 100000.0 / F.col("all_tweets"), 4).alias("per_100k"))


def adjusted_for_mix(peaks: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """topic, expected and lift of peaks (topic, day, regime, tweets), had only the mix of languages changed.

    ``counts`` (topic, regime, day, lang, n) and ``totals`` (regime, day, lang, n_all). A language's rate is that of the
    regime's other days, smoothed, times what the peak day has of it.
    """
    regime_all = totals.groupBy("regime", "lang").agg(F.sum("n_all").alias("r_all"))
    # each language of a topic, whatever the day
    rates = peaks.join(counts.groupBy("topic", "lang").agg(F.lit(1).alias("_")).drop("_"), "topic")
    rates = rates.join(counts.groupBy("topic", "regime", "lang").agg(F.sum("n").alias("r_n")), ["topic", "regime", "lang"], "left")
    rates = rates.join(counts.select("topic", "regime", "day", "lang", "n"), ["topic", "regime", "day", "lang"], "left")
    rates = rates.join(regime_all, ["regime", "lang"], "left").join(totals, ["regime", "day", "lang"], "left").na.fill(0, ["n", "r_n", "r_all", "n_all"])
    expected = F.sum((F.col("r_n") - F.col("n") + 0.5) / (F.col("r_all") - F.col("n_all") + 1) * F.col("n_all"))
    out = rates.groupBy("topic", "tweets").agg(expected.alias("expected"))
    return out.select("topic", F.round("expected", 6).alias("expected"), F.round((F.col("tweets") + 0.5) / (F.col("expected") + 0.5), 6).alias("lift"))


def ngrams(text: Column, stop: Sequence[str], longest: int = 3, word: str = r"([a-z][a-z0-9_]{2,})") -> Column:
    """The distinct n-grams of 1 to ``longest`` words that are left without stop words."""
    kept = F.filter(F.regexp_extract_all(F.lower(text), F.lit(rf"(?<![a-z0-9_]){word}(?![a-z0-9_])"), F.lit(1)), lambda x: ~x.isin(*stop))
    none = F.array().cast("array<string>")

    def of(w: Column, k: int) -> Column:
        return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))).otherwise(none)

    # the words as a lambda's variable, so that they aren't extracted again for each n-gram
    return F.transform(F.array(kept), lambda w: F.array_distinct(F.concat(*[of(w, k) for k in range(1, longest + 1)])))[0]


def document_frequency(rows: DataFrame, terms: Column, least: int, share: float, keys: Sequence[str] = ()) -> DataFrame:
    """term (and keys) and in how many rows it is; terms of under ``least`` rows or over ``share`` of all are left out."""
    total = rows.agg(F.count(F.lit(1))).scalar()
    found = rows.select(*keys, F.explode(terms).alias("term")).groupBy("term", *keys).agg(F.count(F.lit(1)).alias("n"))
    all_ = F.sum("n").over(Window.partitionBy("term"))
    return found.withColumn("total", all_).where((F.col("total") >= least) & (F.col("total") <= total * share))


def ngram_bursts(daily: DataFrame, sizes: DataFrame, regime: Column, peak: int = 8, total: int = 35) -> DataFrame:
    """Of each term (term, day, n, total) its best day: log2 of the smoothed ratio to its regime's other days, 1 at least, times
    log1p(n). ``sizes`` has day and n_all."""
    sized = sizes.withColumn("regime", regime)
    sized = sized.withColumn("rest", F.sum("n_all").over(Window.partitionBy("regime")) - F.col("n_all"))
    rows = daily.join(F.broadcast(sized), "day").withColumn("base", F.sum("n").over(Window.partitionBy("term", "regime")) - F.col("n"))
    ratio = ((F.col("n") + 0.5) / (F.col("n_all") + 1)) / ((F.col("base") + 0.5) / (F.col("rest") + 1))
    rows = rows.where((F.col("n") >= peak) & (F.col("total") >= total)).withColumn("ratio", ratio).withColumn("score", F.log2(F.greatest(ratio, F.lit(1.0))) * F.log1p("n"))
    best = rows.groupBy("term").agg(F.max_by(F.struct("day", "n", "total", "ratio", "score"), F.struct("score", (-F.col("day")).alias("early"))).alias("x"))
    return best.select("term", "x.*")


def period_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scored posts (score, label, top, author_id, lang): n, authors, mean, label fractions, mean top probability, languages."""
    scored = rows.where("score is not null")
    n = F.count(F.lit(1))
    one = scored.groupBy(*keys).agg(
        n.alias("n"), F.count_distinct("author_id").alias("authors"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.avg("top"), 6).alias("mean_top"),
        *[F.round(F.count_if(F.col("label") == x) / n, 6).alias(x) for x in ("negative", "positive")],
    )
    langs = scored.groupBy(*keys, F.coalesce("lang", F.lit("<NULL>")).alias("lang")).agg(n.alias("n"))
    langs = langs.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "lang", "n"))), ",").alias("languages"))
    return one.join(langs, list(keys))


def two_sided(z: Column) -> Column:
    """The chance of a normal deviate at least as far from 0; Spark has no error function."""

    def tail(x: pd.Series) -> pd.Series:
        return x.map(lambda v: math.erfc(abs(v) / math.sqrt(2)) if v == v else None)

    return F.pandas_udf(tail, DoubleType())(z)


def shifts(rows: DataFrame, topic: str, stratum: str, late: str, value: str, least: int = LEAST_STRATUM) -> DataFrame:
    """Mean change between periods over strata of ``least`` rows in both, by their smaller count: limits of 95 %, p, rows used."""
    s = rows.where(F.col(value).isNotNull()).groupBy(topic, stratum).agg(*[f(F.when(F.col(late) == flag, F.col(value))).alias(f"{n}{int(flag)}") for flag in (False, True) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    s = s.where((F.col("n0") >= least) & (F.col("n1") >= least)).withColumn("w", F.least("n0", "n1"))
    w = F.col("w")
    shift = F.sum(w * (F.col("m1") - F.col("m0"))) / F.sum(w)
    error = F.sqrt(F.sum(w * w * (F.col("v0") / F.col("n0") + F.col("v1") / F.col("n1")))) / F.sum(w)
    out = s.groupBy(topic).agg(shift.alias("shift"), error.alias("error"), F.sum("n0").alias("n_base"), F.sum("n1").alias("n_peak"))
    p = F.when(F.col("error") > 0, two_sided(F.col("shift") / F.col("error"))).otherwise(F.when(F.col("shift") != 0, 0.0).otherwise(1.0))
    return out.withColumn("lo", F.col("shift") - 1.96 * F.col("error")).withColumn("hi", F.col("shift") + 1.96 * F.col("error")).withColumn("p", p)


def strong(mean_shift: Column, lo: Column, hi: Column, q: Column, shift: Column, sizes: Sequence[Column]) -> Column:
    """A shift that is large, sure, of one direction with and without strata, and rests on rows enough."""
    enough = reduce(Column.__and__, [n >= LEAST_STRONG for n in sizes])
    return F.coalesce(enough & (F.abs(mean_shift) >= STRONG) & ((lo > 0) | (hi < 0)) & (q < 0.05) & (shift * mean_shift > 0), F.lit(False))


def outlier_score(lift: Column, shift: Column, tweets: Column) -> Column:
    return F.log2(F.greatest(lift, F.lit(1.0))) * F.abs(F.coalesce(shift, F.lit(0.0))) * F.log1p(tweets)


def extremes(rows: DataFrame, kind: str, key: str, metrics: Sequence[str], n: int) -> DataFrame:
    """The ``n`` largest changes of each metric by kind and, of those below zero, the ``n`` least: kind, metric, end, place, key.

    The window's limit on row numbers lets each task drop all but its first before the shuffle.
    """
    u = rows.unpivot([kind, key], list(metrics), "metric", "x").where("x is not null")
    out = []
    for end, order, ok in (("largest", F.desc("x"), F.lit(True)), ("negative", F.asc("x"), F.col("x") < 0)):
        place = F.row_number().over(Window.partitionBy(kind, "metric").orderBy(order, key))
        out.append(u.where(ok).withColumn("place", place).where(F.col("place") <= n).withColumn("end", F.lit(end)))
    return out[0].unionByName(out[1])


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Counts of keys in two sets, with their shares and the smoothed ratio of these."""
    n = [rows.groupBy(key).agg(F.count(F.lit(1)).alias(f"n_{x}")) for x, rows in (("a", a), ("b", b))]
    both = n[0].join(n[1], key, "full").na.fill(0, ["n_a", "n_b"])
    total = [rows.agg(F.count(F.lit(1))).scalar() for rows in (a, b)]
    ratio = ((F.col("n_a") + 0.5) / (total[0] + 1)) / ((F.col("n_b") + 0.5) / (total[1] + 1))
    return both.select(key, "n_a", "n_b", F.round(ratio, 6).alias("ratio"))


def classified(answers: Column, accept: float) -> Column:
    """Of a map from company to probability: status and the companies at or above ``accept``; null where an answer is none."""
    ok = F.forall(F.map_values(answers), lambda p: p.isNotNull() & ~F.isnan(p) & p.between(0, 1)) & (F.size(answers) > 0)
    companies = F.array_sort(F.map_keys(F.map_filter(answers, lambda _, p: p >= accept)))
    return F.when(ok, F.struct(F.when(F.size(companies) > 0, "accepted").otherwise("others").alias("status"), companies.alias("companies")))


def annotations(points: DataFrame, low: int) -> DataFrame:
    """series, x, kind, value: the largest change between observed neighbours with the days between, and points of few rows.

    ``points`` has series, x (a date), y and n. Of equal changes the first counts.
    """
    w = Window.partitionBy("series").orderBy("x")
    seen = points.where("y is not null").withColumn("step", F.col("y") - F.lag("y").over(w)).withColumn("apart", F.date_diff("x", F.lag("x").over(w)))
    best = seen.where("step is not null").groupBy("series").agg(F.max_by(F.struct("x", "step", "apart"), F.struct(F.abs("step").alias("a"), (-F.unix_date("x")).alias("b"))).alias("t"))
    change = best.select("series", "t.x", F.lit("largest_change").alias("kind"), F.col("t.step").cast("double").alias("value"), F.col("t.apart").cast("long").alias("days_apart"))
    few = points.where(F.col("n") < low).select("series", "x", F.lit("low_n").alias("kind"), F.col("n").cast("double").alias("value"), F.lit(None).cast("long").alias("days_apart"))
    return change.unionByName(few)


def readings(points: DataFrame) -> DataFrame:
    """First, last, low and high point of each line (of equal values the first), and how many it has."""
    seen = points.where(F.col("y").isNotNull() & ~F.isnan(F.col("y").cast("double")))
    low, high = F.struct("y", "x"), F.struct(F.col("y"), (-F.unix_date("x")).alias("b"))
    return seen.groupBy("series").agg(F.count(F.lit(1)).alias("samples"), F.min_by("y", "x").alias("first"), F.max_by("y", "x").alias("last"), F.min_by("x", low).alias("low_x"), F.min("y").alias("low"), F.max_by("x", high).alias("high_x"), F.max("y").alias("high"))


def worth_saying(points: DataFrame, most: int = 3) -> DataFrame:
    """Of each series the first ``most`` different x of: largest change, lowest, highest, end, start."""
    change = annotations(points.withColumn("n", F.lit(None).cast("long")), 0).select("series", F.lit(0).alias("rank"), "x")
    ends = points.where("y is not null").groupBy("series").agg(F.min_by("x", F.struct("y", "x")).alias("a"), F.max_by("x", F.struct(F.col("y"), (-F.unix_date("x")).alias("b"))).alias("b"), F.max("x").alias("c"), F.min("x").alias("d"))
    marks = ends.select("series", F.posexplode(F.array("a", "b", "c", "d")).alias("rank", "x")).withColumn("rank", F.col("rank") + 1)
    once = change.unionByName(marks).groupBy("series", "x").agg(F.min("rank").alias("rank"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("series").orderBy("rank"))).where(F.col("place") <= most).select("series", "x", "place")


def bubbles(windows: DataFrame) -> DataFrame:
    """target, until, x (spread), y (mean) and size (root of posts) of windows (target, until, spread, mean, active)."""
    return windows.select("target", "until", F.col("spread").alias("x"), F.col("mean").alias("y"), F.round(F.sqrt("active"), 6).alias("size"))


def cost(posts: int, question_chars: int, usd_per_million: float, post_tokens: int = 80, margin: float = 3.0) -> float:
    """What labelling costs: one call a post with all questions, four characters a token, times a margin for retries."""
    return posts * (post_tokens + question_chars / 4) * usd_per_million / 1e6 * margin


def reserve(budget: float, spent: float, reserved: float, wanted: float) -> float | None:
    """The new reservation, or None where the budget hasn't room for it."""
    return reserved + wanted if spent + reserved + wanted <= budget + 1e-12 else None
