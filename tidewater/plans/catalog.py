"""All queries of the library's own operators by name, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.operators import facts
from tidewater.schema import posts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = posts(spark, sf_dir)
    days = facts.denominators(rows).where("lang = '<ALL>'")
    from pyspark.sql import functions as F

    return facts.spikes(facts.topic_days(rows, F.array("lang")), days, 2)


from tidewater.plans import queries_activity, queries_facts, queries_feed, queries_files, queries_relational, queries_reports, queries_service, queries_text  # noqa: E402, F401  fill the catalog
