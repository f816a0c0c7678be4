"""Five stages from raw documents to tokens: language, lines, near copies, benchmark passages, byte-level BPE.

Each stage gets what its predecessor kept, written as Parquet and read again, and all but the last return the columns of
``documents``. A document leaves at language ID if it has no letter or no language stands out; at line dedup if nothing is
left of its text; at near-dedup if it isn't the first of its group; at decontamination if it holds a benchmark item.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import decontaminate, language_id, line_templates, minhash, queries, simhash
from tidewater.llm.common import SPACE_CHARS, Store, bit_words, fold, table, unused

#: Share of the likeliest language; with four languages and nothing known it is a quarter.
LEAST_SHARE = 0.35

#: Places of the bit tables by which near-dedup knows most rows that a list does not name: 512 kB, as the driver holds each table
#: and sends it with every stage that asks it. A list of n
#: rows lets through its own and n / 2**22 of the others at most, which an exact join then parts; above the size all are joined.
PLACES = 1 << 22


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a language can be told."""
    found = language_id.identify(docs, language_id.train(docs, fold("doc_id", 4) != 2))
    return found.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_SHARE)).select(*docs.columns)


def dedupe_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; ``n_chars`` follows the text."""
    found = line_templates.dedupe(docs)
    left = found.where((F.col("n_dropped") == 0) | (F.trim("text", F.lit(SPACE_CHARS)) != ""))
    return left.withColumn("n_chars", F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def text_key() -> Column:
    """A hash of the whole text, a null one as empty: what a row is judged by, whatever its id."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def maybe_in(listed: DataFrame, row: str) -> Column:
    """True of all rows that the stored list has, and of few others."""
    place = F.pmod(F.col(row), F.lit(PLACES))
    word = F.get(bit_words(listed.select(F.col(row).alias("h")), PLACES).scalar(), F.floor(place / 64).cast("int"))
    return F.call_function("getbit", word, (place % 64).cast("int")) == 1


def dedupe_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies, and one row of it.

    Near copies have fingerprints within the radius of ``simhash``, or 0.8 and more of their 5-word shingles in common. Rows
    without an id are compared like others and leave for any row with one; rows of one id with unlike texts all stay.
    """
    store, key = Store(spark), text_key()
    mark = F.xxhash64("doc_id", F.col("doc_id").isNull(), key)
    rows = store.put(docs.select("doc_id", key.alias("key"), mark.alias("row")).distinct(), "rows")
    texts = docs.select(key.alias("doc_id"), "text")
    near = simhash.group(texts).where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    near = store.put(near.distinct(), "near")
    pairs = minhash.candidates(texts, store)
    for side in "ab":  # pairs within one group of fingerprints can't join groups, so their texts needn't be moved
        pairs = pairs.join(near.select(F.col("a").alias(side), F.col("b").alias(f"{side}_root")), side, "left")
    pairs = store.put(pairs.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b"), "open_pairs")
    # one row of each text of a pair, found among ids: rows are dealt by their own hash, so copies don't meet in one task
    ids = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    firsts = rows.join(ids, "key", "left_semi").groupBy("key").agg(F.min("row").alias("row")).select("row")
    # lists of rows grow with the corpus: merged at every size, so that the plan doesn't change where one outgrows a broadcast
    firsts = store.put(firsts, "firsts")
    held = docs.where("text is not null").select(mark.alias("row"), key.alias("doc_id"), "text")
    held = held.where(maybe_in(firsts, "row")).join(firsts.hint("merge"), "row", "left_semi")
    alike = minhash.confirmed(pairs, held.groupBy("doc_id").agg(F.min("text").alias("text")))
    roots = simhash.components(store, near.unionByName(alike).distinct())
    rows = rows.join(roots.withColumnRenamed("node", "key"), "key", "left")
    rows = store.put(rows.withColumn("group", F.coalesce("root", "key")), "grouped")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "row")).alias("x")
    stay = rows.groupBy("group").agg(least).select("group", F.col("x.row").alias("stays"))
    row = unused("row", docs.columns)
    leave = store.put(rows.join(stay, "group").where("row <> stays").select(F.col("row").alias(row)), "leave")
    again = store.put(docs.select(mark.alias(row)).groupBy(row).count().where("count > 1").select(row), "repeated")
    marked = docs.withColumn(row, mark)
    once = marked.join(again, row, "left_anti").unionByName(marked.join(again, row, "left_semi").dropDuplicates([row]))
    maybe = maybe_in(leave, row)
    return once.where(~maybe).unionByName(once.where(maybe).join(leave.hint("merge"), row, "left_anti")).select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; each row is judged by its text, with or without an id."""
    texts = docs.select(text_key().alias("doc_id"), "text")
    key = unused("key", docs.columns)
    held = decontaminate.find(texts, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(key)).distinct()
    return docs.withColumn(key, text_key()).join(held, key, "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text that the ids decode to."""
    found = queries.tokenized(docs)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.decode("decoded", "UTF-8").alias("text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedupe_lines),
    ("near_dedup", dedupe_documents),
    ("decontamination", drop_benchmark),
    ("byte_bpe", encode),
]

#: SQL has no suffix automata, SimHash or BPE; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, docs = Store(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store.put(stage(spark, docs, sf_dir), name)
    return docs
