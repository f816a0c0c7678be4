"""Line dedup by a log-template tree, all in Catalyst expressions.

A line goes down a tree of four levels: its number of tokens, then the leading, the middle and the last third of its
tokens. Tokens with a digit are variable fields (``<*>``) from the start. Below each node there is, beside one child for each
third's tokens, a child that stands for any tokens; a path takes that one at most once, and only where ``CONSTANT`` tokens
or more stay fixed. So a line reaches up to four leaves: the one of its own tokens, and one for each third that may
vary. Lines whose differing tokens all lie in one third share a leaf for certain, wherever in the line that third is.
Each leaf is a template.

A template recurs if it is in documents of ``min_docs`` families or more. Each line points to the first text that has one
of its templates. The family of a document at a line is the text that most of its other lines point to by their characters, without the
run of lines about it that point to the same text; where ``COPY`` of all its lines point to that text, it is that text. So a
notice of one or more lines recurs in documents that are otherwise their own, however many copies also hold it; the
lines of copied documents, whole or changed, all point to the text they were copied from, which is one family: copies
are the matter of document dedup. All lines that have a recurring template are dropped, in every document.

Lines end at ``\\n``. Lines of under ``MIN_TOKENS`` tokens are templates by their full text, with no variable fields; lines
without tokens are never dropped. A null text has no lines and stays null, an empty one stays empty. Texts of any length
are read to their end. Each row gets its result by its text, so repeated and null ids don't matter; equal texts count as
one document when families are counted. Columns n_lines and n_dropped are replaced, all others stay, whatever their names.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import Store, unused

MIN_DOCS = 3
#: Share of a document's characters that make it a copy of the text they point to.
COPY = 0.8
#: Lines of fewer tokens say too little for variable fields.
MIN_TOKENS = 3
#: Fixed tokens of a template with a third that varies.
CONSTANT = 4


#: A run of blanks that isn't one space.
UNEVEN = "[\\x09\\x0B-\\x0D][\\x20\\x09\\x0B-\\x0D]*|\\x20[\\x20\\x09\\x0B-\\x0D]+"


def with_leaves(docs: DataFrame) -> DataFrame:
    """Of each line with tokens: text_key, all (characters of the text's lines), place among all lines (at) and among
    those with tokens (k), number of characters (n), and leaves (l0 to l3)."""
    rows = docs.select(F.xxhash64("text").alias("text_key"), F.regexp_replace("text", UNEVEN, " ").alias("even"))
    rows = rows.select("text_key", F.split("even", "\n").alias("raw"), (F.length("even") - F.size(F.split("even", "\n")) + 1).alias("all"))
    lines = F.filter(F.transform("raw", lambda x, i: F.struct(i.alias("at"), x.alias("raw"))), lambda x: ~x["raw"].isin("", " "))
    rows = rows.select("text_key", "all", F.posexplode(lines).alias("k", "x")).select("text_key", "all", "k", "x.at", F.length("x.raw").alias("n"), F.trim("x.raw").alias("raw"))
    fields = F.regexp_replace("raw", "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", "<*>")
    rows = rows.withColumn("g", F.split(F.when(F.col("raw").rlike("[0-9]"), fields).otherwise(F.col("raw")), " "))
    # each step a projection of its own, since a branch of a leaf would split and hash the line again
    rows = rows.withColumn("size", F.size("g")).withColumns({"a": F.expr("size DIV 3"), "b": F.expr("2 * size DIV 3")})
    rows = rows.select("text_key", "all", "k", "at", "n", "size", F.when(F.col("size") < MIN_TOKENS, F.xxhash64("raw")).alias("short"), F.col("a").alias("w0"), F.expr("b - a").alias("w1"), F.expr("size - b").alias("w2"), F.expr("xxhash64(slice(g, 1, a))").alias("t0"), F.expr("xxhash64(slice(g, a + 1, b - a))").alias("t1"), F.expr("xxhash64(slice(g, b + 1, size - b))").alias("t2"))
    own = F.when(F.col("short").isNotNull(), F.xxhash64("size", "short")).otherwise(F.xxhash64("size", "t0", "t1", "t2"))
    others = [F.when(F.col("size") - F.col(f"w{k}") >= CONSTANT, F.xxhash64("size", F.lit(k), *(f"t{i}" for i in range(3) if i != k))).alias(f"l{k + 1}") for k in range(3)]
    return rows.select("text_key", "all", "k", "at", "n", own.alias("l0"), *others)


def recurring(lines: DataFrame, store: Store, min_docs: int = MIN_DOCS) -> DataFrame:
    """text_key and place of the lines that have a recurring template; of lines as of ``with_leaves``, equal texts repeated."""
    each = lines.select("text_key", "all", "k", "at", "n", F.explode(F.array_compact(F.array("l0", "l1", "l2", "l3"))).alias("leaf"))
    first = each.groupBy("leaf").agg(F.min("text_key").alias("first"), F.max("text_key").alias("last")).where("first < last").select("leaf", "first")
    first = store.put(first, "first")  # a stored table: its join can be split where a template is hot
    shared = each.join(first.hint("merge"), "leaf").groupBy("text_key", "k", "leaf").agg(*[F.min(c).alias(c) for c in ("all", "at", "n", "first")])
    shared = store.put(shared, "shared")
    rows = shared.groupBy("text_key", "k").agg(F.min("all").alias("all"), F.min("n").alias("n"), F.min("first").alias("first"))
    text, own = Window.partitionBy("text_key"), F.col("first") == F.col("text_key")
    by_line = text.orderBy("k")
    rows = rows.withColumn("new", F.when((F.lag("first").over(by_line) == F.col("first")) & (F.lag("k").over(by_line) == F.col("k") - 1), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("new").over(by_line.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("in_run", F.sum("n").over(Window.partitionBy("text_key", "run")))
    rows = rows.withColumn("left", F.col("all") - F.coalesce(F.sum(F.when(~own, F.col("n"))).over(text), F.lit(0)))
    rows = rows.withColumn("words", F.when(own, F.col("left")).otherwise(F.sum("n").over(Window.partitionBy("text_key", "first"))))
    # the two texts that most of this one points to; of equals, the text itself comes first
    here = F.struct("words", own.alias("own"), "first")
    self_ = F.struct(F.col("left").alias("words"), F.lit(True).alias("own"), F.col("text_key").alias("first"))
    rows = rows.withColumn("top", F.greatest(F.max(here).over(text), self_))
    rows = rows.withColumn("next", F.greatest(F.max(F.when(F.col("first") != F.col("top.first"), here)).over(text), F.when(F.col("text_key") != F.col("top.first"), self_)))
    rest = F.struct((F.col("words") - F.col("in_run")).alias("words"), own.alias("own"), F.col("first"))
    other = F.when(F.col("first") == F.col("top.first"), F.col("next")).otherwise(F.col("top"))
    family = F.when(F.col("words") >= F.col("all") * COPY, F.col("first")).otherwise(F.greatest(rest, other)["first"])
    rows = rows.select("text_key", "k", family.alias("family")).join(shared.select("text_key", "k", "leaf"), ["text_key", "k"])
    families = rows.groupBy("leaf", "text_key").agg(F.min("family").alias("family")).groupBy("leaf", "family").agg(F.count(F.lit(1)).alias("n"))
    drop = families.groupBy("leaf").agg(F.count(F.lit(1)).alias("n_families")).where(F.col("n_families") >= min_docs)
    drop = store.put(drop.select("leaf"), "templates")
    return shared.join(drop, "leaf", "left_semi").select("text_key", "at").distinct()


def dedupe(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of ``docs``, ``text`` without the lines of recurring templates, n_lines and n_dropped."""
    store = Store(docs.sparkSession)
    bad = recurring(store.put(with_leaves(docs.select("text")), "lines"), store, min_docs).groupBy("text_key").agg(F.collect_list("at").alias("bad"))
    bad = store.put(bad, "places")
    for name in ("lines", "first", "shared", "templates"):
        store.drop(name)
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # both tables grow with the corpus: they are sorted and merged at every size, and a hot key's part can be split
    key, gone = unused("text_key", rest), unused("bad", rest)
    rows = docs.select(*rest, F.xxhash64("text").alias(key)).join(bad.select(F.col("text_key").alias(key), F.col("bad").alias(gone)).hint("merge"), key, "left")
    # both in hand as lists of places: the lines themselves aren't parsed again
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col(gone), i))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    n_dropped = F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long")
    return rows.select(*[text.alias(c) if c == "text" else F.col(c) for c in rest], n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))
