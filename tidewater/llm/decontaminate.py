"""Benchmark decontamination, all in Catalyst expressions.

A document holds an item if one of its windows, as many words long as the item, is like it: the weighted Jaccard
similarity of their word shingles, each weighted by how often it occurs, is ``similarity`` or more. Words are the runs
of letters and digits in lower case, so case, punctuation and symbols between words don't hide a passage.

1. A window that is like an item shares most shingles with it, so some of its shingles stand in a row. A bit table of
   the items' shingles, 16 bits for each, shows where a document may have such a row (above ``TABLE`` shingles a join with
   them shows it); a join with the shingles confirms it, and windows that hold enough of an item's shingles stay. No
   window that is like the item is lost here.
2. Each window and item has a 64-bit SimHash of its words. Its ``radius`` + 1 blocks are keys of an equi-join together
   with the number of words: fingerprints within the radius agree in one block at least. A pair counts at its first
   common block only, and only within the radius.
3. The similarity itself is computed for what is left.

Shingles have ``width`` words; of an item with fewer words, all of them. Items and texts of any length are compared as
wholes. Null and empty texts have no words, and items without words match nothing. Repeated rows count once (the result is
by ids); null ids are in no result, so a caller that must judge such rows gives them a key of their own. Other columns of
the inputs are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Store, bit_table

WIDTH = 5
SIMILARITY = 0.8
RADIUS = 15
#: The items' shingles are broadcast up to so many rows (24 bytes each); above, they are joined by a shuffle.
BROADCAST_SEEDS = 1_000_000
#: Up to so many shingles the bit table is used, which is then 16 MB at most.
TABLE = 1_000_000


def plain_words(text: Column) -> Column:
    line = F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))
    return F.when(F.coalesce(line, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(line, " "))


def bound(name: str, value: str, body: str) -> str:
    """SQL of ``body`` with ``name`` computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def shingles(width: int) -> str:
    """SQL of the hashes of all shingles of a word list w."""
    words = ", ".join(f"w[i + {k}]" for k in range(width))
    return f"CASE WHEN size(w) < {width} THEN CAST(array() AS array<bigint>) ELSE transform(sequence(0, size(w) - {width}), i -> xxhash64({words})) END"


def simhash(words: str) -> str:
    """SQL of the SimHash of a list of words: 16 sums, each of four counters of 16 bits; 32 of two above 16,383 words."""
    ones, high = "281479271743489L", "4611756388245323776L"  # 1 and 16384 in each counter
    few, many = [], []
    for j in range(16):
        total = f"aggregate(h, 0L, (a, x) -> a + (shiftrightunsigned(x, {j}) & {ones}))"
        # with 16383 - n/2 added, a counter over half of n reaches its bit 14
        few.append(f"shiftleft(shiftrightunsigned(({total} + (16383 - size(h) DIV 2) * {ones}) & {high}, 14), {j})")
    for j in range(32):
        total = f"aggregate(h, 0L, (a, x) -> a + (shiftrightunsigned(x, {j}) & 4294967297L))"
        # likewise with 2^30 - 1 - n/2 and bit 30
        many.append(f"shiftleft(shiftrightunsigned(({total} + (1073741823L - size(h) DIV 2) * 4294967297L) & 4611686019501129728L, 30), {j})")
    return bound("h", f"transform({words}, x -> xxhash64(x))", f"CASE WHEN size(h) <= 16383 THEN {' | '.join(few)} ELSE {' | '.join(many)} END")


def blocks(fp: str, n: int) -> list[str]:
    cuts = [64 * k // n for k in range(n + 1)]
    return [f"(shiftrightunsigned({fp}, {a}) & {(1 << b - a) - 1}L)" for a, b in zip(cuts, cuts[1:], strict=False)]


#: SQL of a sorted list as a set in which the k-th repetition of a value differs from the others.
NUMBERED = "transform(g, (x, i) -> xxhash64(x, i - array_position(g, x)))"


def shared(n: int, width: int, similarity: float) -> tuple[int, int]:
    """How many shingles an item of n words has, and how many of them a window that is like it holds at least."""
    m = n - width + 1
    return m, math.ceil(2 * similarity / (1 + similarity) * m - 1e-9)


def find(docs: DataFrame, items: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, radius: int = RADIUS, table: int = TABLE) -> DataFrame:
    """doc_id, item_id, start (of the best window, in words), n_words, hamming, similarity; one row for each item in a document."""
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    store = Store(docs.sparkSession)
    known = items.where("item_id is not null").select("item_id", plain_words(F.col("text")).alias("w")).withColumn("n", F.size("w")).where("n > 0").distinct()
    known = store.put(known, "all_items")
    short = sorted(r.n for r in known.where(f"n < {width}").select("n").distinct().collect())
    found = [find_items(docs, known.where(f"n >= {k}" if k == width else f"n = {k}"), store, k, similarity, radius, table) for k in [*short, width]]
    return reduce(DataFrame.unionByName, found)


def find_items(docs: DataFrame, known: DataFrame, store: Store, width: int, similarity: float, radius: int, table: int) -> DataFrame:
    """As ``find``, of items (item_id, w, n) of ``width`` words or more."""
    known = known.select("item_id", "n", F.expr(f"sort_array({shingles(width)})").alias("g"), F.expr(simhash("w")).alias("item_fp"))
    known = store.put(known, f"items-{width}")
    seeds = store.put(known.select("item_id", "n", F.explode(F.array_distinct("g")).alias("h")).distinct(), f"seeds-{width}")
    n_seeds, n_items = seeds.count(), known.count()
    sizes = sorted(r.n for r in known.select("n").distinct().collect())
    longest = sizes[-1] if sizes else width
    row = min((math.ceil(c / (m - c + 1)) for m, c in (shared(n, width, similarity) for n in sizes)), default=1)
    size = 1 << max(10, math.ceil(math.log2(16 * max(1, n_seeds))))
    small = (lambda df: F.broadcast(df)) if max(n_seeds, n_items * (radius + 1)) <= BROADCAST_SEEDS else (lambda df: df)

    # where a row of the items' shingles may be, with the words about it; a long row in parts of the longest item's length
    hashed = ", ".join(f"w[i + {k}]" for k in range(width))
    runs = f"filter(zip_with(filter(p, (x, k) -> k = 0 OR get(p, k - 1) <> x - 1), filter(p, (x, k) -> coalesce(get(p, k + 1) <> x + 1, true)), (x, e) -> named_struct('x', x, 'e', e)), r -> r.e - r.x + 1 >= {row})"
    base, end = f"greatest(0, x - {longest})", f"least(r.e, x + {longest}) + {longest + 1}"
    about = f"flatten(transform(b, r -> transform(sequence(r.x, r.e - {row - 1}, {longest}), x -> named_struct('base', {base}, 'ctx', slice(w, {base} + 1, {end} - {base})))))"
    rows = docs.where("doc_id is not null").select("doc_id", plain_words(F.col("text")).alias("w"))
    if n_seeds <= table:
        rows = rows.withColumn("bits", bit_table(seeds, size).scalar())
        near = f"CASE WHEN size(w) < {width} THEN CAST(array() AS array<int>) ELSE filter(sequence(0, size(w) - {width}), i -> bits[CAST(pmod(xxhash64({hashed}), {size}L) AS INT)]) END"
    else:
        rows = rows.withColumn("key", F.xxhash64("w"))
        met = rows.select("doc_id", "key", F.posexplode(F.expr(shingles(width))).alias("at", "h")).join(seeds.select("h").distinct(), "h", "left_semi")
        rows = rows.join(met.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("at")).alias("near")), ["doc_id", "key"])
        near = "near"
    rows = rows.select("doc_id", F.expr(bound("w", "w", bound("p", near, bound("b", runs, about)))).alias("places"))
    places = rows.select("doc_id", F.explode("places").alias("x")).select("doc_id", "x.base", F.col("x.ctx").alias("w"))
    places = store.put(places.distinct(), f"places-{width}")

    # windows with enough shingles of an item of their length
    hits = places.select("doc_id", "base", F.posexplode(F.expr(shingles(width))).alias("at", "h")).join(small(seeds), "h")
    hits = hits.groupBy("doc_id", "base", "n", "item_id").agg(F.sort_array(F.collect_set("at")).alias("p"))
    m, need = f"(n - {width - 1})", "CAST(ceil({share} * (n - {less}) - 1e-9D) AS INT)".format(share=repr(2 * similarity / (1 + similarity)) + "D", less=width - 1)
    start = f"flatten(transform(filter(p, (x, k) -> coalesce(get(p, k + c - 1) - x < {m}, false)), x -> sequence(greatest(0, x - ({m} - c)), x)))"
    windows = hits.select("doc_id", "base", "n", "item_id", "p", F.expr(need).alias("c")).select("doc_id", "base", "n", F.explode(F.expr(f"array_distinct({start})")).alias("s")).distinct()
    windows = windows.join(places, ["doc_id", "base"]).where("s + n <= size(w)").select("doc_id", "n", (F.col("base") + F.col("s")).alias("start"), F.expr("slice(w, s + 1, n)").alias("w"))
    # few bytes but much work: dealt over a set number of tasks, which the planner doesn't coalesce, and each window once
    windows = windows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id", "n", "start").dropDuplicates(["doc_id", "n", "start"])
    windows = windows.select("doc_id", "n", "start", F.expr(f"sort_array({shingles(width)})").alias("own"), F.expr(simhash("w")).alias("fp"))

    # fingerprints within the radius, at their first common block
    n = radius + 1
    keyed = windows.select("*", F.posexplode(F.expr(f"array({', '.join(blocks('fp', n))})")).alias("k", "v"))
    side = known.select("item_id", "n", "g", "item_fp", F.posexplode(F.expr(f"array({', '.join(blocks('item_fp', n))})")).alias("k", "v"))
    pairs = keyed.join(small(side), ["n", "k", "v"]).withColumn("x", F.expr("fp ^ item_fp"))
    first = F.coalesce(*[F.when(F.expr(f"{b} = 0"), k) for k, b in enumerate(blocks("x", n))])
    pairs = pairs.where((first == F.col("k")) & (F.bit_count("x") <= radius))

    common = F.expr(f"CAST(size(array_intersect(transform(array(own), g -> {NUMBERED})[0], transform(array(g), g -> {NUMBERED})[0])) AS DOUBLE)")
    scored = pairs.select("doc_id", "item_id", "start", "n", F.bit_count("x").alias("hamming"), (common / (F.size("own") + F.size("g") - common)).alias("similarity"))
    best = F.max(F.struct("similarity", (-F.col("hamming")).alias("h"), (-F.col("start")).alias("s"), "n"))
    out = scored.where(F.col("similarity") >= similarity).groupBy("doc_id", "item_id").agg(best.alias("b"))
    return out.select("doc_id", "item_id", (-F.col("b.s")).cast("long").alias("start"), F.col("b.n").cast("long").alias("n_words"), (-F.col("b.h")).cast("int").alias("hamming"), F.round("b.similarity", 6).alias("similarity"))
