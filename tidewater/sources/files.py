"""File sources and sinks beyond what Spark reads by itself."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidewater.sources.store import exists, listed, remove

#: A column's chunks in one file: rows and nulls, compressed size, codec, and the least and largest value as text.
FOOTER = "path string, bytes long, rows long, row_groups long, column string, nulls long, compressed long, codec string, low string, high string"


def inventory(rows: DataFrame) -> DataFrame:
    """path, bytes and rows of each file that a file scan reads."""
    m = F.col("_metadata")
    return rows.select(m.file_path.alias("path"), m.file_size.alias("bytes")).groupBy("path", "bytes").agg(F.count(F.lit(1)).alias("rows"))


def footers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One row for each column of each Parquet file, from the footers alone; files are dealt over all tasks.

    A path is a file's URI, or a local path.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path in frame["path"]:
                system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
                with system.open_input_file(name) as f:
                    meta, size = pq.read_metadata(f), f.size()
                groups = [meta.row_group(i) for i in range(meta.num_row_groups)]
                for c in range(meta.num_columns):
                    chunks = [g.column(c) for g in groups]
                    stats = [x.statistics for x in chunks]
                    known = [x for x in stats if x is not None and x.has_min_max]
                    whole = len(known) == len(stats) and known
                    nulls = sum(x.null_count for x in stats) if all(x is not None and x.has_null_count for x in stats) else None
                    out.append((path, size, meta.num_rows, len(groups), meta.schema.column(c).path, nulls, sum(x.total_compressed_size for x in chunks), ",".join(sorted({x.compression for x in chunks})), str(min(x.min for x in known)) if whole else None, str(max(x.max for x in known)) if whole else None))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in FOOTER.split(", ")])

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 1000)))
    return files.mapInPandas(read, FOOTER)


def files_of(spark: SparkSession, path: str, suffix: str = ".parquet") -> list[str]:
    """The data files in a folder, by name."""
    return [p for p in listed(spark, path) if p.endswith(suffix)]


def overlaps(meta: DataFrame) -> DataFrame:
    """One row with ``n``: 0 if no two of the files (low, high) overlap. Ranges may touch, as equal keys may reach over two files.

    Files are dealt by ``low`` and not compared two by two, so only the ends of each part meet in one task.
    """
    before = lambda w: F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    dealt = meta.where("low is not null").select("low", "high").repartitionByRange("low").withColumn("part", F.spark_partition_id())
    own = dealt.withColumn("late", (F.col("low") < before(Window.partitionBy("part").orderBy("low", "high"))).cast("int"))
    parts = own.groupBy("part").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("late").alias("n"))
    ends = parts.withColumn("late", (F.col("low") < before(Window.orderBy("part"))).cast("int"))
    return ends.agg((F.coalesce(F.sum("n"), F.lit(0)) + F.coalesce(F.sum("late"), F.lit(0))).alias("n"))


def windowed(spark: SparkSession, path: str, column: str, start: str, end: str) -> DataFrame:
    """Rows of [start, end) from those files alone whose footers say that they may hold some; the predicate stays.

    Files without statistics are read.
    """
    low, high = F.col("low").cast("timestamp_ntz"), F.col("high").cast("timestamp_ntz")
    first, last = (F.lit(x).cast("timestamp_ntz") for x in (start, end))
    kept = footers(spark, files_of(spark, path)).where(F.col("column") == column).where(F.col("low").isNull() | ((low < last) & (high >= first)))
    paths = [r.path for r in kept.select("path").collect()]
    rows = spark.read.parquet(*paths) if paths else spark.read.parquet(path).limit(0)
    at = F.col(column).cast("timestamp_ntz")
    return rows.where((at >= first) & (at < last))


def framed_events(spark: SparkSession, path: str, schema: StructType, count: int | None = None) -> DataFrame:
    """Rows of a JSON array written one element a line, or all on one line (gzip too).

    A line that is no element is an error when it is read; a number of rows other than ``count`` is one at once.
    """
    lines = spark.read.text(path).select(F.regexp_replace(F.trim("value"), "^,|,$", "").alias("v")).where("v not in ('', '[', ']')")
    whole = F.col("v").startswith("[")
    parts = F.when(whole, F.expr("from_json(v, 'array<string>')")).otherwise(F.array("v"))
    rows = lines.select("v", F.explode_outer(parts).alias("e"))
    rows = rows.select("v", F.from_json("e", StructType([*schema.fields, StructField("_bad", StringType())]), {"columnNameOfCorruptRecord": "_bad"}).alias("x"))
    bad = F.col("x").isNull() | F.col("x._bad").isNotNull()
    rows = rows.select(F.when(bad, F.raise_error(F.concat(F.lit("no event: "), F.substring("v", 1, 80)))).otherwise(F.col("x")).alias("x")).select("x.*").drop("_bad")
    if count is not None and (n := rows.count()) != count:
        raise ValueError(f"{n} events, {count} were announced")
    return rows


def write_framed(rows: DataFrame, path: str) -> None:
    """The counterpart of ``framed_events``: gzip files of one element a line, each with its comma."""
    rows.select(F.concat(F.to_json(F.struct("*")), F.lit(",")).alias("value")).write.option("compression", "gzip").text(path)


def last_wins(spark: SparkSession, path: str, key: str, schema: StructType, keep_from: str | None = None) -> DataFrame:
    """A JSON-lines log replayed: the last row of each key, without those whose ``deleted`` is true.

    The last line of a file may be torn and is then passed over; a bad line anywhere else is an error. With ``keep_from``, a
    condition, rows that don't meet it are left out, as a compaction by retention would.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i")).where("trim(value) <> ''")
    place = F.struct("_f", "_b", "_i")
    last = rows.groupBy("_f").agg(F.max(F.struct("_b", "_i")).alias("end"))
    rows = rows.join(F.broadcast(last), "_f").withColumn("x", F.from_json("value", StructType([*schema.fields, StructField("_bad", StringType())]), {"columnNameOfCorruptRecord": "_bad"}))
    torn, end = F.col("x").isNull() | F.col("x._bad").isNotNull(), F.struct("_b", "_i") == F.col("end")
    rows = rows.where(~(torn & end)).select(place.alias("at"), F.when(torn, F.raise_error(F.concat(F.lit("bad line: "), F.substring("value", 1, 80)))).otherwise(F.col("x")).alias("x"))
    rows = rows.groupBy(F.col(f"x.{key}").alias("_k")).agg(F.max_by("x", "at").alias("x")).select("x.*").drop("_bad").where("not coalesce(deleted, false)")
    return rows.where(keep_from) if keep_from else rows


def write_chunks(rows: DataFrame, path: str, key: str, files: int, rows_a_file: int = 1_000_000, block_bytes: int = 128 << 20) -> None:
    """Parquet in ranges of ``key``, sorted, at most ``rows_a_file`` rows a file and ``block_bytes`` a row group; refuses to overwrite."""
    writer = rows.repartitionByRange(files, key).sortWithinPartitions(key).write
    writer.option("compression", "zstd").option("parquet.block.size", block_bytes).option("maxRecordsPerFile", rows_a_file).mode("errorifexists").parquet(path)


def write_csv(rows: DataFrame, path: str, fields: Sequence[str]) -> None:
    """These fields in this order, under a header."""
    rows.select(*fields).write.option("header", True).mode("errorifexists").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Typed columns under a header; a value that doesn't fit its type fails the read."""
    return spark.read.schema(schema).option("header", True).option("dateFormat", date_format).option("mode", "FAILFAST").csv(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    """All or nothing, and never over something that exists."""
    rows.write.mode("errorifexists").json(path)


def report(spark: SparkSession, path: str, sections: Mapping[str, DataFrame], most: int = 1000) -> dict:
    """A JSON document of small results by section, one line in a text file; a section above ``most`` rows is refused."""
    found = {}
    for name, rows in sections.items():
        got = rows.limit(most + 1).collect()
        if len(got) > most:
            raise ValueError(f"{name} has more than {most} rows")
        found[name] = [r.asDict(recursive=True) for r in got]
    text = json.dumps(found, default=str, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return found


def write_charts(spark: SparkSession, folder: str, charts: Mapping[str, DataFrame]) -> list[str]:
    """Each chart's points as JSON lines below ``folder``; charts that aren't among them any more are removed."""
    for name, points in charts.items():
        points.coalesce(1).write.mode("overwrite").json(f"{folder}/{name}")
    stale = [p for p in listed(spark, folder) if p.rstrip("/").rsplit("/", 1)[-1] not in charts]
    for p in stale:
        remove(spark, p)
    return sorted(p.rstrip("/").rsplit("/", 1)[-1] for p in stale)


def build_once(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at ``path``: built by ``make()`` unless a finished one is there, or again by ``force``."""
    if force or not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes and SHA-256 of each file below ``path``, computed where the files are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", "([^/]+/[^/]+)$", 1)
    return files.select(name.alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).where(~F.col("name").rlike("/[_.][^/]*$"))


def verified(spark: SparkSession, path: str, expected: DataFrame, tables: Sequence[str], key: str) -> dict[str, DataFrame]:
    """The tables of a package whose files are as its manifest says and whose keys are unique; else an error."""
    wrong = manifest(spark, path).join(expected.select("name", F.col("sha256").alias("told")), "name", "full").where("not (sha256 <=> told)").select("name").limit(5).collect()
    if wrong:
        raise ValueError(f"files differ from the manifest: {[r.name for r in wrong]}")
    found = {t: spark.read.parquet(f"{path}/{t}") for t in tables}
    for name, rows in found.items():
        if rows.groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError(f"{name} has rows of one {key}")
    return found


def upsert(old: DataFrame, new: DataFrame, key: str, order: str, merge: Mapping[str, str] | str = "update") -> DataFrame:
    """Old and new rows, one a key.

    ``update``: the largest by ``order``; ``ignore``: the old one where there is one; a mapping merges each named column by
    its function (min, max, sum) and takes the others from the largest by ``order``.
    """
    if merge == "ignore":
        first = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
        return old.unionByName(first.join(old.select(key), key, "left_anti"))
    both = old.unionByName(new)
    if merge == "update":
        w = Window.partitionBy(key).orderBy(F.desc(order))
        return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    how = {"min": F.min, "max": F.max, "sum": F.sum}
    out: list[Column] = [how[merge[c]](c).alias(c) if c in merge else F.max_by(c, order).alias(c) for c in old.columns if c != key]
    return both.groupBy(key).agg(*out).select(*old.columns)
