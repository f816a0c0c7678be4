"""Change-data capture: an event log by sequence number, and a like ledger that turns it into signed changes.

The functions take any DataFrame; :func:`start` runs them on a stream, one micro-batch at a time, against Parquet state.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewater.operators import activity
from tidewater.sources import store


def fresh(batch: DataFrame, log: DataFrame) -> DataFrame:
    """Events of the batch that the log lacks, once each; an equal seq with another hash stops the batch."""
    both = batch.select("seq", "hash").unionByName(log.select("seq", "hash"))
    if clash := both.groupBy("seq").agg(F.count_distinct("hash").alias("n")).where("n > 1").first():
        raise ValueError(f"event {clash.seq} came with different contents")
    return batch.dropDuplicates(["seq"]).join(log.select("seq"), "seq", "left_anti")


def like_deltas(events: DataFrame) -> DataFrame:
    """seq, subject, delta of like events (seq, like, operation, subject).

    A create adds one to its subject; if the like pointed elsewhere, that one loses one. A delete takes one away from the
    subject the like has at that time; of an unknown or deleted like it takes nothing.
    """
    before = Window.partitionBy("like").orderBy("seq")
    now = F.when(F.col("operation") == "delete", None).otherwise(F.col("subject"))
    rows = events.withColumn("now", now).withColumn("was", F.lag("now").over(before))
    parts = F.array(F.struct(F.col("was").alias("subject"), F.lit(-1).cast("long").alias("delta")), F.struct(F.col("now").alias("subject"), F.lit(1).cast("long").alias("delta")))
    moved = rows.where(~F.col("was").eqNullSafe(F.col("now"))).select("seq", F.explode(parts).alias("x"))
    return moved.where("x.subject is not null").select("seq", "x.subject", "x.delta")


def latest_posts(events: DataFrame) -> DataFrame:
    """Current text of each post by its highest sequence number; deleted posts are left out."""
    rows = events.groupBy("post").agg(F.max_by(F.struct("operation", "text"), "seq").alias("x"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    return rows.where("x.operation <> 'delete'").select("post", "x.text", "first_seq", "last_seq")


def versions(events: DataFrame) -> DataFrame:
    """post, version, text, first_seq, last_seq of each content a post has had (seq, post, operation, text); deletes make none."""
    kept = events.where("operation <> 'delete'").withColumn("version", F.sha2(F.coalesce("text", F.lit("")), 256))
    return kept.groupBy("post", "version").agg(F.min("text").alias("text"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def current_posts(events: DataFrame) -> DataFrame:
    """post, text, version, last_seq, deleted: the row of the highest seq; a tombstone keeps the last text that the post had."""
    last = events.groupBy("post").agg(F.max_by("operation", "seq").alias("operation"), F.max("seq").alias("last_seq"), F.max_by("text", F.when(F.col("operation") != "delete", F.col("seq"))).alias("text"))
    return last.select("post", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("version"), "last_seq", (F.col("operation") == "delete").alias("deleted"))


def resolved(likes: DataFrame, posts: DataFrame) -> DataFrame:
    """Likes (seq, subject) with the text that the subject's earliest event gave, whenever it came: ``known_seq`` is when both
    were there, null as long as the post hasn't been seen."""
    first = posts.groupBy(F.col("post").alias("subject")).agg(F.min_by("text", "seq").alias("context"), F.min("seq").alias("post_seq"))
    return likes.join(first, "subject", "left").select("seq", "subject", "context", F.when(F.col("post_seq").isNotNull(), F.greatest("seq", "post_seq")).alias("known_seq"))


def reset_deltas(events: DataFrame, resets: Sequence[int]) -> DataFrame:
    """As ``like_deltas``, where the source's cursor was reset at these sequence numbers: earlier changes stand, but what a like
    pointed to before a reset isn't trusted after it, since events may be missing."""
    epoch = sum((F.when(F.col("seq") >= r, 1).otherwise(0) for r in resets), F.lit(0))
    rows = events.withColumn("like", F.concat_ws("/", "like", epoch.cast("string")))
    return like_deltas(rows)


def gaps(frames: DataFrame, step: int = 1) -> DataFrame:
    """From and to of missing sequence numbers within each run (run, seq)."""
    w = Window.partitionBy("run").orderBy("seq")
    rows = frames.withColumn("before", F.lag("seq").over(w))
    return rows.where(F.col("seq") > F.col("before") + step).select("run", (F.col("before") + step).alias("from"), (F.col("seq") - step).alias("to"))


def fair(queue: DataFrame, consumer: str, order: str) -> DataFrame:
    """``turn``: the place of each row when consumers are served in rounds, one row of each a round, in their own order."""
    mine = F.row_number().over(Window.partitionBy(consumer).orderBy(order))
    return queue.withColumn("round", mine).withColumn("place", F.dense_rank().over(Window.partitionBy("round").orderBy(consumer)))


#: Sequence numbers of one part of the log; a batch looks at the parts of its own numbers only.
RANGE = 1_000_000


def put(batch: DataFrame, log_path: str) -> None:
    """Append the batch's new events to the log, which is partitioned by ranges of seq."""
    session = batch.sparkSession
    ranged = batch.withColumn("range", F.floor(F.col("seq") / RANGE)).persist()
    try:
        parts = [r[0] for r in ranged.select("range").distinct().collect()]
        log = session.createDataFrame([], batch.schema)
        if store.exists(session, log_path):
            log = session.read.schema(ranged.schema).parquet(log_path).where(F.col("range").isin(parts)).drop("range")
        new = fresh(ranged.drop("range"), log)
        new.withColumn("range", F.floor(F.col("seq") / RANGE)).write.mode("append").partitionBy("range").parquet(log_path)
    finally:
        ranged.unpersist()


def start(spark: SparkSession, source: DataFrame, log_path: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's new events to the log at ``log_path``; replays and repeated batches add nothing."""
    return source.writeStream.foreachBatch(lambda batch, _: put(batch, log_path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_buckets(stream: DataFrame, path: str, checkpoint: str, size: int) -> StreamingQuery:
    """Sums of each bucket, target and post of a stream of events (as of ``schema.activity``), batch by batch.

    There is no watermark: each batch leaves its own sums, a late event's in the bucket it belongs to, and reading merges
    them. A repeated batch writes over itself, so nothing counts twice.
    """

    def put_sums(batch: DataFrame, number: int) -> None:
        sums = activity.moments(batch.withColumn("start", activity.bucket(F.col("t"), size)), ["start"])
        sums.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put_sums).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """The aggregate of each bucket over all batches so far."""
    sums = spark.read.parquet(path)
    merged = sums.groupBy("start", "target", "post").agg(F.sum("published").alias("published"), F.sum("net").alias("net"), F.max("latest").alias("latest"))
    return activity.summed(activity.weighed(merged), ["start"])


def route(stream: DataFrame, consumer: str, wanted: Column, path: str, checkpoint: str) -> StreamingQuery:
    """Append the rows that a consumer wants to its own table, with its own cursor: one checkpoint a consumer, at least once.

    A repeated batch writes over itself.
    """

    def deliver(batch: DataFrame, number: int) -> None:
        batch.where(wanted).withColumn("consumer", F.lit(consumer)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retrying(act: Callable[[], None], tries: int = 5, first: float = 0.25, most: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> int:
    """Call ``act`` until it works, after waits that double; the batch in hand is kept. How many tries it took."""
    wait = first
    for k in range(1, tries + 1):
        try:
            act()
        except Exception:
            if k == tries:
                raise
            sleep(wait)
            wait = min(most, 2 * wait)
        else:
            return k
    raise ValueError("tries must be 1 or more")
