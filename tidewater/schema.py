"""Logical tables of the engine over whatever columns a source has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of posts: id, version, added_at (a tie-break), likes, views, author_id."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("version"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("added_at"),
        F.col("l_quantity").cast("long").alias("likes"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("views"),
        F.col("l_suppkey").alias("author_id"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a post: id, author_id, created_at, day, lang, status, likes."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("author_id"), F.col("o_orderdate").alias("created_at"), F.to_date("o_orderdate").alias("day"),
        F.col("o_orderpriority").alias("lang"), F.col("o_orderstatus").alias("status"), F.floor("o_totalprice").alias("likes"),
    )


def activity(spark: SparkSession, sf_dir: str, targets: int = 5) -> DataFrame:
    """Posts and signed changes on one timeline: event_id, t (ms), target, post, kind, delta, score."""
    events = table(spark, sf_dir, "events")
    sign = F.when(F.col("event_type") == "error", -1).when(F.col("event_type") == "view", 0).otherwise(1)
    return events.select(
        "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.col("user_id") % targets).alias("target"), F.col("user_id").alias("post"),
        F.when(F.col("event_type") == "view", "post").otherwise("like").alias("kind"), (sign * F.ceil("value")).cast("long").alias("delta"),
        (F.floor("value") % 11).cast("double").alias("score"), (F.col("event_type") == "signup").alias("opening"),
    ).withColumn("t", F.floor(F.col("us") / 1000))
