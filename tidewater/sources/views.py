"""Published views: named tables with notes, registered only where their files are, and what they hold."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.sources.store import exists


@dataclass(frozen=True)
class View:
    """``make`` turns the table at ``path`` into the view; ``note`` tells a reader what to mind."""

    path: str
    note: str
    make: Callable[[DataFrame], DataFrame] = lambda rows: rows
    time: str | None = None
    facets: tuple[str, ...] = ()


def publish(spark: SparkSession, views: Mapping[str, View]) -> dict[str, str]:
    """Name to note of the views that could be registered; a missing path or an unfit schema drops one view, not the others."""
    found = {}
    for name, view in views.items():
        if not exists(spark, view.path):
            continue
        try:
            view.make(spark.read.parquet(view.path)).createOrReplaceTempView(name)
        except AnalysisException:
            continue
        found[name] = view.note
    return found


def schema(spark: SparkSession, names: Mapping[str, str]) -> DataFrame:
    """view, column, type, position and note of every column of published views."""
    rows = [(v, f.name, f.dataType.simpleString(), i, note) for v, note in names.items() for i, f in enumerate(spark.table(v).schema.fields)]
    return spark.createDataFrame(rows, "view string, column string, type string, position long, note string")


def registered(spark: SparkSession, name: str, rows: list[tuple], columns: str) -> DataFrame:
    """Rows of the driver as a table of that name; they are few, so joins may broadcast it."""
    made = F.broadcast(spark.createDataFrame(rows, columns))
    made.createOrReplaceTempView(name)
    return made


def describe(rows: DataFrame, time: str, facets: tuple[str, ...], most: int = 12) -> DataFrame:
    """One row of JSON texts and figures: coverage, columns, the values of facets that fit, and partial days at either end.

    A day at an end is partial where its first or last row is an hour or more from midnight.
    """
    day = F.to_date(time)
    span = rows.agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first"), F.max(time).alias("last"), F.count_distinct(day).alias("days"), *[F.to_json(F.slice(F.sort_array(F.collect_set(f)), 1, most)).alias(f"values_{f}") for f in facets])
    early = F.when(F.hour("first") >= 1, F.to_date("first").cast("string"))
    late = F.when(F.hour("last") < 23, F.to_date("last").cast("string"))
    columns = ",".join(rows.columns)
    return span.select("n", "first", "last", "days", F.lit(columns).alias("columns"), F.array_join(F.array_distinct(F.array_compact(F.array(early, late))), ",").alias("partial_days"), *[f"values_{f}" for f in facets])
