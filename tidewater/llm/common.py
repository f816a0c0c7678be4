"""Helpers that the corpus operators share."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

# Python workers get the code of these modules with each task, so executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules["tidewater.llm"])

#: ASCII white space, as in the word rule ``[^\x20\x09-\x0D]+``.
SPACE = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only where the session names none and its master is this machine (tests), a new temporary folder is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        made = spark.sparkContext.getCheckpointDir()
        if not made:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewater-"))
            made = spark.sparkContext.getCheckpointDir()
        found = made
    return found.rstrip("/")


class Store:
    """Intermediate tables as Parquet in the shared folder; they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tw-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused(name: str, columns: Collection[str]) -> str:
    """The name, with underscores where a column has it already (names don't differ by case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id's decimal text modulo ``folds``; null for a null id, which is in no fold and never held out."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")) % folds


def words(text: Column) -> Column:
    """The maximal runs of characters that are not ASCII white space; none for a null text."""
    bare = F.trim(text, F.lit(SPACE_CHARS))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def bit_words(hashes: DataFrame, size: int) -> DataFrame:
    """One row with ``words``: an array of ``size`` / 64 longs, whose bits are set where a hash of column ``h`` falls."""
    place = F.pmod("h", F.lit(size))
    used = hashes.groupBy(F.floor(place / 64).alias("id")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).alias("word"))
    every = hashes.sparkSession.range(size // 64).join(used, "id", "left").select("id", F.coalesce("word", F.lit(0)).alias("word"))
    return every.agg(F.sort_array(F.collect_list(F.struct("id", "word"))).alias("all")).select(F.col("all.word").alias("words"))


def bit_table(hashes: DataFrame, size: int) -> DataFrame:
    """One row with ``bits``: an array of ``size`` booleans, true where a hash of column ``h`` falls."""
    return bit_words(hashes, size).select(F.expr("flatten(transform(words, x -> transform(sequence(0, 63), i -> (shiftrightunsigned(x, i) & 1L) = 1L)))").alias("bits"))


def share_of(key: Column, salt: str) -> Column:
    """A number in [0, 1) from a hash of the key."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(salt)), 11) * F.lit(2.0**-53)


def pieces(key: Column, text: Column, size: int, most: int) -> Column:
    """The whole text where it has ``most`` pieces of ``size`` characters or fewer, else ``most`` of its pieces, in order.

    Which ones is a matter of a hash of the key and the piece's number, so every part of a long text is as likely.
    """
    n = F.ceil(F.length(text) / size).cast("int")
    ranked = F.array_sort(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.xxhash64(key, i).alias("h"), i.alias("i"))))
    chosen = F.array_sort(F.transform(F.slice(ranked, 1, most), lambda x: x["i"]))
    return F.when(n <= most, F.array(text)).otherwise(F.transform(chosen, lambda i: F.substring(text, i * size + 1, F.lit(size))))


def sampled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, size: int, most: int) -> list[Row]:
    """doc_id, parts (``pieces`` of its text) and the label of about ``per_class`` documents of each label, by doc_id.

    ``labels`` has doc_id and the label, and is counted as a whole; thresholds on a hash of the id, one for each label, then
    name the documents before any text is read. Their list, about 1.2 times ``per_class`` rows a label, is broadcast to
    one scan of ``docs``, so nothing but the chosen pieces is shuffled. An id of several labels takes the largest, an id of
    several texts the smallest.
    """
    rows = labels.select("doc_id", label).where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    limits = {r[label]: 1.2 * per_class / r["count"] for r in rows.groupBy(label).count().collect()}
    if not limits:
        return []
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]), F.col(label))
    named = rows.where(share_of(F.col("doc_id"), "sample") < limit).distinct().collect()
    if not named:
        return []
    most_of: dict = {}
    for r in named:
        most_of[r.doc_id] = max(r[label], most_of.get(r.doc_id, r[label]))
    chosen = docs.sparkSession.createDataFrame(sorted(most_of.items()), rows.schema)
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    return cut(texts, size, most, label).collect()


def cut(texts: DataFrame, size: int, most: int, *names: str) -> DataFrame:
    """One row an id, by id: doc_id, the columns ``names``, and ``parts``."""
    parts = texts.select("doc_id", *names, pieces(F.col("doc_id"), F.col("text"), size, most).alias("parts"))
    return parts.groupBy("doc_id", *names).agg(F.min("parts").alias("parts")).orderBy("doc_id")


def slices(batch: pa.RecordBatch, column: int = 1, rows: int = 2000, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``rows`` rows and ``size`` bytes of text, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype("int64"))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + size, "right"))
        to = min(at + rows, max(at + 1, to))
        yield batch.slice(at, to - at)
        at = to
