"""Readings of chart series (series, x, y)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def summary(points: DataFrame) -> DataFrame:
    """First, last, lowest and highest point, and the point after the largest change between observed neighbours.

    Of equal values the earliest counts; points without a value are passed over.
    """
    seen = points.where("y is not null").withColumn("step", F.abs(F.col("y") - F.lag("y").over(Window.partitionBy("series").orderBy("x"))))
    back = -F.unix_date("x")
    return seen.groupBy("series").agg(
        F.min_by("y", "x").alias("start_y"), F.max_by("y", "x").alias("end_y"), F.min_by("x", F.struct("y", "x")).alias("low_x"),
        F.max_by("x", F.struct(F.col("y"), back.alias("b"))).alias("high_x"), F.max_by("x", F.when(F.col("step").isNotNull(), F.struct(F.col("step"), back.alias("b")))).alias("change_x"),
    )
