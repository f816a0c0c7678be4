"""Small file operations through Hadoop's file systems, so any path that Spark reads will do."""

from __future__ import annotations

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession


def at(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    system, p = at(spark, path)
    return system.exists(p)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Paths in a folder without marks and hidden files, by name; a file lists itself."""
    system, p = at(spark, path)
    if not system.exists(p):
        return []
    found = sorted(x.getPath().toString() for x in system.listStatus(p))
    return [x for x in found if not x.rsplit("/", 1)[-1].startswith(("_", "."))]


def remove(spark: SparkSession, path: str) -> None:
    system, p = at(spark, path)
    system.delete(p, True)
