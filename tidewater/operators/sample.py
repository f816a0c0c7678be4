"""Deterministic samples: by hash, by quota, by stratum."""

from __future__ import annotations

from collections.abc import Hashable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def comparable_hash(key: Column) -> Column:
    """The first 32 bits of an MD5: the same number in every engine."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


def bernoulli(rows: DataFrame, key: Column, n: int) -> DataFrame:
    return rows.where(comparable_hash(key) % n == 0)


def capped(rows: DataFrame, key: list[str], order: list[Column], cap: Column) -> DataFrame:
    """At most ``cap`` rows of each key, the first by ``order``; a cap is the purpose here."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_n") <= cap).drop("_n")


def salted(key: str, salt: str) -> Column:
    """A repeatable shuffle of keys, another one for each salt; of several columns pass their concatenation."""
    return comparable_hash(F.concat(F.col(key).cast("string"), F.lit(salt)))


def proportional(counts: Mapping[Hashable, int], total: int) -> dict:
    """Exactly ``total`` by largest remainder, one for each key first; the largest keys alone where there are more keys."""
    ranked = sorted(counts, key=lambda k: (-counts[k], k))
    if total < len(counts):
        return {k: int(i < total) for i, k in enumerate(ranked)}
    weight, spare = sum(counts.values()), total - len(counts)
    shares = {k: divmod(spare * n, weight) for k, n in counts.items()}
    left = spare - sum(q for q, _ in shares.values())
    extra = set(sorted(counts, key=lambda k: (-shares[k][1], -counts[k], k))[:left])
    return {k: min(counts[k], 1 + shares[k][0] + (k in extra)) for k in counts}


def allocate(counts: Mapping[Hashable, int], cap: int) -> dict:
    """How many of each stratum to take, ``cap`` together: whole strata as long as they fit into an equal share of what is
    left, then in proportion. Strata are days: a bounded list, so this is for the driver."""
    rest = {k: n for k, n in counts.items() if n > 0}
    if cap <= 0:
        return {}
    if sum(rest.values()) <= cap:
        return dict(rest)
    take: dict = {}
    while rest and (whole := {k: n for k, n in rest.items() if n * len(rest) <= cap - sum(take.values())}):
        take |= whole
        rest = {k: n for k, n in rest.items() if k not in whole}
    return take | (proportional(rest, cap - sum(take.values())) if rest else {})


def quotas(rows: DataFrame, stratum: str, size: int) -> DataFrame:
    """stratum, n, quota, of one row a stratum. Strata are days or the like: their counts are collected, their rows are not."""
    counts = {r[0]: r[1] for r in rows.where(F.col(stratum).isNotNull()).groupBy(stratum).count().collect()}
    take = allocate(counts, size)
    schema = StructType([StructField(stratum, rows.schema[stratum].dataType), StructField("n", LongType()), StructField("quota", LongType())])
    return rows.sparkSession.createDataFrame([(k, n, take.get(k, 0)) for k, n in counts.items()], schema)


def stratified(rows: DataFrame, stratum: str, key: str, size: int) -> DataFrame:
    """The first of each stratum by a repeatable shuffle, as many as its quota."""
    marked = rows.join(F.broadcast(quotas(rows, stratum, size).select(stratum, "quota")), stratum)
    return capped(marked, [stratum], [comparable_hash(F.col(key)), F.col(key)], F.col("quota")).drop("quota")
