"""Quality rules as a short-circuit cascade, all in Catalyst expressions.

Every rule is a cheap predicate that rejects a document. A sample tells how many of its rows each rule rejects and
how much work it does on a row (characters scanned, list entries visited). Rules run in the order of rejections per
unit of work, and a document stops at the first that rejects it. The order changes the cost and which rule gets the
blame, never the verdict: a document is kept if and only if no rule rejects it.

Null text counts as empty: no words, ``base_failed``. Rows repeat in the result as in the input, whatever their ids;
other columns of the input are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import words


@dataclass(frozen=True)
class Rule:
    """``rejects`` and ``work`` are SQL over the columns of :func:`features`; work is in character visits."""

    name: str
    rejects: str
    work: str


#: ``work`` weighs a character under a regular expression as 4 visits, a list entry under a lambda as 20.
RULES = (
    Rule("mean_word", "word_chars < 2 * n_words OR word_chars > 14 * n_words", "2"),
    Rule("symbols", "5 * n_symbols > 2 * n_words", "2"),
    Rule("dup_lines", "10 * n_dup_lines > 3 * n_lines", "2"),
    Rule("repeats", "10 * n_repeat_words > 4 * n_words", "2"),
    Rule("exclaims", "2 * (length(text) - length(replace(text, '!', ''))) > n_words", "2 * length(text)"),
    Rule("capitals", "2 * length(regexp_replace(text, '[^A-Z]', '')) > word_chars", "4 * length(text)"),
    Rule("letters", "10 * length(regexp_replace(text, '[^\\\\p{L}]', '')) < 6 * word_chars", "5 * length(text)"),
    Rule("short_lines", "n_words > 200 AND n_lines * 2 > n_words", "3"),
    Rule("bullets", "size(filter(split(text, '\\n'), x -> ltrim(x) rlike '^[-*\\u2022]')) * 10 > 9 * n_lines", "4 * length(text) + 20 * n_lines"),
    Rule("ellipses", "size(filter(split(text, '\\n'), x -> rtrim(x) rlike '(\\\\.\\\\.\\\\.|\\u2026)$')) * 10 > 3 * n_lines AND n_lines > 2", "4 * length(text) + 20 * n_lines"),
)

MIN_WORDS = 50


def repeat_words(w: str) -> Column:
    """Of the SQL expression of a word list: words that lie in a 3-word window found twice or more in the text.

    Each step is bound to a lambda variable: a filter pushed below a projection would otherwise copy the step into the
    lambdas that use it, and run it again for each entry.
    """
    grams = "CASE WHEN size(w) < 3 THEN CAST(array() AS array<bigint>) ELSE transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])) END"
    ranked = "CASE WHEN size(array_distinct(g)) = size(g) THEN CAST(array() AS array<struct<h:bigint,i:int>>) ELSE sort_array(transform(g, (h, i) -> named_struct('h', h, 'i', i))) END"
    at = "sort_array(filter(transform(r, (x, i) -> IF((i > 0 AND get(r, i - 1).h = x.h) OR (i + 1 < size(r) AND get(r, i + 1).h = x.h), x.i, -1)), v -> v >= 0))"
    total = "aggregate(transform(p, (v, i) -> IF(i + 1 < size(p), least(3, get(p, i + 1) - v), 3)), 0L, (a, x) -> a + x)"
    for name, step in (("p", at), ("r", ranked), ("g", grams)):
        total = f"element_at(transform(array({step}), {name} -> {total}), 1)"
    return F.expr(f"element_at(transform(array({w}), w -> {total}), 1)")


def features(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the counts that the rules share."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", words(F.col("text")).alias("w"), F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(" \t\x0b\x0c\r")) != "").alias("lines"))
    return rows.select(
        "doc_id", "text",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.size(F.split("text", "[#*$%&|<>]", -1)) - 1).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words("w").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words")


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> list[Rule]:
    """The rules by rejections per unit of work on a sample of about ``sample_rows`` rows, best first.

    The sample is taken by a hash of the id, so it is the same for the same table however it is partitioned.
    """
    share = max(1, docs.count() // max(1, sample_rows))
    sample = features(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0))
    met = ~base_failed()
    sums = [F.sum(F.when(met, F.expr(r.rejects).cast("int"))).alias(f"r{i}") for i, r in enumerate(rules)]
    sums += [F.sum(F.when(met, F.expr(r.work).cast("double"))).alias(f"c{i}") for i, r in enumerate(rules)]
    got = sample.agg(*sums).first()
    return [r for _, _, r in sorted((-(got[f"r{i}"] or 0) / ((got[f"c{i}"] or 0) + 1.0), i, r) for i, r in enumerate(rules))]


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> DataFrame:
    """Counts, ``base_failed``, ``kept`` and ``rejected_by`` (null, ``base`` or a rule's name) of every document."""
    verdict = F.when(F.col("base_failed"), "base")
    for rule in ordered(docs, rules, sample_rows):
        verdict = verdict.when(F.expr(rule.rejects), rule.name)
    rows = features(docs).withColumn("base_failed", base_failed()).withColumn("rejected_by", verdict)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")
