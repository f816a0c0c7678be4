"""Tables that a query writes and reads again, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new path below the session's ``spark.checkpoint.dir``; where it names none, on this machine alone, below a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewater-"))
        found = spark.sparkContext.getCheckpointDir()
    return f"{found.rstrip('/')}/td-{uuid.uuid4().hex}"


def put(rows: DataFrame) -> DataFrame:
    """The rows from a stored table: computed once, however often they are read."""
    path = folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
