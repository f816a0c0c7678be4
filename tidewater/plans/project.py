"""Projects: preview a specification, score its sample once, then read charts and posts of the finished run."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions import patterns
from tidewater.operators import activity, facts, feed, reports, sample
from tidewater.plans.spec import Spec, compile_filter, problems, warnings
from tidewater.sources import scratch
from tidewater.sources.store import exists, listed

#: A post: id, created_at, text, lang, likes, author_id; the names of a source's columns for these.
COLUMNS = {"created_at": "created_at", "text": "text", "lang": "lang", "likes": "likes"}


def preview(rows: DataFrame, spec: Spec, columns: Mapping[str, str] = COLUMNS, ntz: bool = False, cap: int = 20_000, examples: int = 6) -> dict:
    """What a specification would match: ok and total, tables per_day, language_mix, duplicates and examples, and warnings.

    The source is scanned once; all figures come from the stored matches. A specification with problems comes back
    with these, and nothing is scanned.
    """
    if wrong := problems(spec):
        return {"ok": False, "errors": wrong, "spec_hash": spec.canonical_hash()}
    matched = scratch.put(rows.where(compile_filter(spec, columns, ntz)))
    at, text = F.col(columns["created_at"]), F.col(columns["text"])
    per_day = matched.groupBy(F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    total, days = per_day.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    mix = facts.with_shares(matched.groupBy(F.coalesce(columns["lang"], F.lit("<NULL>")).alias("lang")).agg(F.count(F.lit(1)).alias("n")), []).orderBy(F.desc("n"), "lang").limit(12)
    texts = matched.groupBy(patterns.template(text).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    duplicates = texts.agg(F.round(F.try_divide(F.sum("n") - F.count(F.lit(1)), F.sum("n")), 6).alias("share"), F.max("n").alias("largest"))
    shown = matched.orderBy(F.desc_nulls_last(columns["likes"]), "id").limit(examples).select("id", F.substring(text, 1, 240).alias("text"))
    return {"ok": True, "spec_hash": spec.canonical_hash(), "total": total, "per_day": per_day, "language_mix": mix, "duplicates": duplicates, "examples": shown, "warnings": warnings(spec, total, days, cap)}


class Projects:
    """Finished runs below ``root``: each a folder named by its specification's hash, with a record and a table of posts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def submit(self, spec: Spec, rows: DataFrame, score: Callable[[DataFrame], DataFrame], cap: int, ntz: bool = False) -> str:
        """The run's name. A specification that has run isn't run again; one with problems is refused.

        ``score`` adds label and score to the sampled posts: small days as wholes, large ones in proportion, ``cap`` together.
        """
        if wrong := problems(spec):
            raise ValueError(wrong)
        name = spec.canonical_hash()[:16]
        if exists(self.spark, f"{self.root}/{name}/record"):
            return name
        matched = scratch.put(rows.where(compile_filter(spec, {k: v for k, v in COLUMNS.items() if v in rows.columns}, ntz)).withColumn("day", F.to_date("created_at")))
        sampled = sample.stratified(matched, "day", "id", cap) if matched.count() else matched
        score(sampled).write.mode("overwrite").parquet(f"{self.root}/{name}/posts")
        posts = self.spark.read.parquet(f"{self.root}/{name}/posts")
        n, done = posts.agg(F.count(F.lit(1)), F.count("score")).first()
        record = {"spec": asdict(spec), "sampled": n, "scored": done, "status": feed.run_status(n, done)}
        self.spark.createDataFrame([(json.dumps(record, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/{name}/record")
        return name

    def names(self) -> list[str]:
        return [n for n in (p.rstrip("/").rsplit("/", 1)[-1] for p in listed(self.spark, self.root)) if exists(self.spark, f"{self.root}/{n}/record")]

    def status(self, name: str) -> dict:
        if not exists(self.spark, f"{self.root}/{name}/record"):
            return {"status": "UNKNOWN"}
        return json.loads(self.spark.read.text(f"{self.root}/{name}/record").first().value)

    def table(self, name: str) -> DataFrame:
        if self.status(name)["status"] != "READY":
            raise ValueError(f"{name} has no finished run")
        return self.spark.read.parquet(f"{self.root}/{name}/posts")

    def charts(self) -> dict[str, Callable[[DataFrame], DataFrame]]:
        """Chart names and how their points (series, x, y, n) come from the posts."""
        n = F.count(F.lit(1))
        by_day = lambda p, series: p.groupBy(series.alias("series"), F.col("day").alias("x"))
        return {
            "volume": lambda p: by_day(p, F.lit("posts")).agg(n.cast("double").alias("y"), n.alias("n")),
            "feeling": lambda p: facts.weighted_mean(p.where("score is not null"), ["day"], F.col("score"), F.col("likes"), F.lit(True)).select(F.lit("mean").alias("series"), F.col("day").alias("x"), F.col("weighted").alias("y"), "n"),
            "labels": lambda p: facts.with_shares(by_day(p, F.coalesce("label", F.lit("unlabelled"))).agg(n.alias("n")), ["x"]).select("series", "x", F.col("share").alias("y"), "n"),
        }

    def chart(self, name: str, chart: str, low: int = 20) -> dict[str, DataFrame]:
        points = scratch.put(self.charts()[chart](self.table(name)))
        return {"points": points, "summary": reports.readings(points), "annotations": reports.annotations(points, low), "worth_saying": reports.worth_saying(points)}

    def posts(self, name: str, mode: str = "likes", labels: Sequence[str] = (), day: str | None = None, size: int = 50) -> DataFrame:
        rows = self.table(name)
        if labels:
            rows = rows.where(F.col("label").isin(*labels))
        if day:
            rows = rows.where(F.col("day") == F.lit(day).cast("date"))
        return feed.page(rows, mode, size)


def matching(events: DataFrame, matches: Column) -> DataFrame:
    """Posts that match, and all events of matched posts; ``events`` has post and kind."""
    hit = events.where((F.col("kind") == "post") & matches).select("post").distinct()
    return events.join(hit, "post", "left_semi").unionByName(events.where(matches).join(hit, "post", "left_anti"))


def scan(events: DataFrame, matches: Column) -> DataFrame:
    """One row: how many posts and likes a search keeps, and how many targets they are about."""
    kept = matching(events, matches)
    return kept.agg(F.count_if(F.col("kind") == "post").alias("posts"), F.count_if(F.col("kind") != "post").alias("likes"), F.count_distinct("target").alias("targets"))


def feeling(events: DataFrame, matches: Column, start: int, end: int) -> DataFrame:
    """The activity of each target over [start, end) among what a search keeps."""
    return activity.window(matching(events, matches), start, end)


def found_posts(events: DataFrame, matches: Column, start: int, end: int, order: str = "likes", size: int = 20) -> DataFrame:
    """Posts published in [start, end) that a search keeps, with their balance of likes up to ``end``."""
    kept = matching(events, matches).where(F.col("t") < end)
    posts = kept.groupBy("post").agg(F.min(F.when(F.col("kind") == "post", F.col("t"))).alias("published"), F.sum(F.when(F.col("kind") == "like", F.col("delta")).otherwise(0)).alias("likes"))
    posts = posts.where((F.col("published") >= start) & (F.col("published") < end))
    return posts.orderBy(F.desc(order), "post").limit(size)


def tracking(events: DataFrame, now: int, span: int) -> DataFrame:
    """Each target's activity over the last ``span`` and the one before it, and the change of its weight."""
    late, early = (activity.window(events, now - (k + 1) * span, now - k * span) for k in (0, 1))
    both = late.select("target", "volume", "weight", "mean").join(early.select("target", F.col("weight").alias("before")), "target", "full")
    return both.select("target", F.coalesce("volume", F.lit(0)).alias("volume"), F.coalesce("weight", F.lit(0.0)).alias("weight"), "mean", F.round(F.coalesce("weight", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)), 4).alias("change"))


def snapshot(posts: DataFrame, likes: DataFrame, at: int, size: int) -> DataFrame:
    """The newest posts (post, seq, text) up to a sequence number with their balance of likes (seq, subject, delta) by then."""
    balance = likes.where(F.col("seq") <= at).groupBy(F.col("subject").alias("post")).agg(F.sum("delta").alias("likes"))
    last = posts.where(F.col("seq") <= at).withColumn("n", F.row_number().over(Window.partitionBy("post").orderBy(F.desc("seq")))).where("n = 1 and operation <> 'delete'")
    newest = last.orderBy(F.desc("seq")).limit(size).select("post", "seq")
    return newest.join(balance, "post", "left").select("post", "seq", F.coalesce("likes", F.lit(0)).alias("likes"))
