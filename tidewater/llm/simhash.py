"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints: the text in ASCII lower case, words, shingles of ``width`` words with repeats (the whole sequence where
there are fewer words), XXH64 with seed 42; a bit is 1 if it is 1 in over half of the hashes. A text without words, a
null text included, has fingerprint 0.

Links: two fingerprints link at ``radius`` differing bits or fewer. Equal fingerprints are one node from the start. Of such a
pair one half differs in half the radius or less (one bit of three). So there are two indexes, over the fingerprints and over
those with their halves exchanged, and each looks for pairs of which the upper half differs in so few bits. An index is
sorted by Gray rank, which puts fingerprints that share many bits side by side, and dealt in ranges of the rank: cells of
equal leading bits, of about ``members`` fingerprints. Runs of them make a node that holds the bits they all share, runs of nodes
make an upper node; a cell is searched against itself and each cell that may hold partners, two trees downward together:
the differences found in the shared bits of upper nodes are carried along, and a pair of nodes is left as soon as they
exceed the radius, in all or in the upper half, or linked as a whole where the open bits can't. Cells above ``members`` are
refined by the rest of the upper half, which copies nothing between cells and a row for each bit within one; only groups that
share the whole upper half and are still larger are dealt over several tasks, one for each pair of their parts.

Components: every task gives a spanning forest, and large-star / small-star rounds over stored tables join them.

A row without id gets the component of its fingerprint, null if no row with an id shares it. Repeated rows are repeated in
the result; texts of any length are read to their end; an empty table gives an empty result. Other columns of the input are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Store, slices

SEED = 42
FAN = 8
LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, width: int) -> list[int]:
    words = (text or "").encode().lower().split()  # of bytes: both by ASCII rules
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), "int64", len(words)) + 1
    ends = np.cumsum(sizes) - 1
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip((ends - sizes + 1)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]


def fingerprints(hashes: list[list[int]]) -> np.ndarray:
    """Of each list of 64-bit hashes: the bits that over half of them have; 0 of an empty list."""
    sizes = np.array([len(h) for h in hashes], "int64")
    out = np.zeros(len(hashes), "uint64")
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    flat = np.concatenate([np.array(hashes[i], "uint64") for i in some])
    n = sizes[some]
    parts = -(-n // 255)  # bytes count the bits of up to 255 hashes at a time
    first = np.cumsum(n) - n
    chunk = np.repeat(first, parts) + (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * 255
    counts = np.zeros((len(some), 8, 8), "int64")  # [text, byte, bit in byte]
    for bit in range(8):
        lanes = np.add.reduceat((flat >> np.uint64(bit)) & LANES, chunk)
        counts[:, :, bit] = np.add.reduceat(lanes.view("uint8").reshape(-1, 8).astype("int64"), np.cumsum(parts) - parts)
    bits = 2 * counts.reshape(len(some), 64) > n[:, None]
    out[some] = np.packbits(bits, axis=1, bitorder="little").view("uint64")[:, 0]
    return out


def fingerprint(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of each whole text."""
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows=200, size=1 << 20):
                fp = fingerprints([shingle_hashes(t, width) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view("int64"))], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def gray_rank(fp: Column) -> Column:
    """Place of a code word in the order of the binary reflected Gray code."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n along the links."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (up := label[label]).tolist() != label.tolist() if n < 64 else not np.array_equal(up := label[label], label):
            label = up
    return label


UPPER = np.uint64(0xFFFFFFFF00000000)


def gray_links(fp: np.ndarray, group: np.ndarray, side: np.ndarray, split: np.ndarray, radius: int, upper: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions a, b) between members of one group, enough to connect all within ``radius`` of which the upper half
    differs in ``upper`` bits at most.

    Members come by group and Gray rank. Where ``split``, only pairs of different ``side`` are looked for.
    """
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    start = np.arange(len(fp))
    levels = [(start, start + 1, np.full(len(fp), full), fp, group)]  # children from, to, shared bits, pattern, group
    while True:
        _, _, mask, pattern, owner = levels[-1]
        new = np.concatenate([[True], owner[1:] != owner[:-1]])
        place = np.arange(len(owner)) - np.maximum.accumulate(np.where(new, np.arange(len(owner)), 0))
        first = np.flatnonzero(place % FAN == 0)
        last = np.concatenate([first[1:], [len(owner)]])
        low, high = np.bitwise_and.reduceat(pattern | ~mask, first), np.bitwise_or.reduceat(pattern & mask, first)
        low, shared = np.bitwise_and.reduceat(pattern & mask, first), np.bitwise_and.reduceat(mask, first)
        shared = shared & ~(low ^ high)
        levels.append((first, last, shared, low & shared, owner[first]))
        if len(np.unique(owner[first])) == len(first):
            break
    out_a, out_b = [], []
    heads = [np.arange(len(fp))]  # the first member under each node, by level
    for first, *_ in levels[1:]:
        heads.append(heads[-1][first])
    a = b = np.arange(len(levels[-1][0]))
    seen = np.zeros(len(a), "uint64")
    found = above = np.zeros(len(a), "int64")
    for k in range(len(levels) - 1, -1, -1):
        _, _, mask, pattern, _ = levels[k]
        common = mask[a] & mask[b]
        unlike = (pattern[a] ^ pattern[b]) & common & ~seen
        found, above = found + np.bitwise_count(unlike), above + np.bitwise_count(unlike & UPPER)
        near = (found <= radius) & (above <= upper)
        a, b, common, found, above = a[near], b[near], common[near], found[near], above[near]
        whole = found + np.bitwise_count(~common) <= radius
        if k == 0:
            whole = (a != b) & ~(split[a] & (side[a] == side[b]))
            out_a.append(a[whole])
            out_b.append(b[whole])
            break
        plain = whole & ~split[heads[k][a]]
        x, y = a[plain], b[plain]
        out_a.append(heads[k][x])
        out_b.append(heads[k][y])
        # the members under a node linked to itself as a whole all link to its first
        own = np.unique(x[x == y])
        lo = heads[k][own]
        hi = np.concatenate([heads[k], [len(fp)]])[own + 1]
        size = hi - lo
        out_a.append(np.repeat(lo, size))
        out_b.append(np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
        a, b, common, found, above = a[~plain], b[~plain], common[~plain], found[~plain], above[~plain]
        first, last = levels[k][0], levels[k][1]
        na, nb = last[a] - first[a], last[b] - first[b]
        size = na * nb
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        wide = np.repeat(nb, size)
        ca, cb = np.repeat(first[a], size) + at // wide, np.repeat(first[b], size) + at % wide
        keep = ca <= cb
        a, b, seen, found, above = ca[keep], cb[keep], np.repeat(common, size)[keep], np.repeat(found, size)[keep], np.repeat(above, size)[keep]
    return np.concatenate(out_a), np.concatenate(out_b)


def pair_of(own: Column, bits: int, low: int = 0) -> Column:
    """An array of cells to meet: (least, largest, side, split) of the cell itself, and of it and each that differs in one bit.

    ``own`` has the cell's number in ``bits`` bits from bit ``low`` on.
    """
    other = [own.bitwiseXOR(F.lit(1 << low + i)) for i in range(bits)]
    meet = [F.struct(own.alias("p"), own.alias("q"), F.lit(0).alias("side"), F.lit(False).alias("split"))]
    return F.array(*meet, *[F.struct(F.least(own, x).alias("p"), F.greatest(own, x).alias("q"), (own > x).cast("int").alias("side"), F.lit(True).alias("split")) for x in other])


def links(nodes: DataFrame, store: Store, radius: int = 3, members: int = 2048) -> DataFrame:
    """Of nodes (fp, node): a, b with a > b, which connect all nodes within the radius."""
    if radius > 3:
        raise ValueError("cells meet cells that differ in one bit, which is half of a radius of 3")
    bits = min(32, max(0, math.ceil(math.log2(max(1, nodes.count()) / members))))
    turned = F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32))
    both = nodes.select("node", F.explode(F.array(F.struct(F.lit(0).alias("order"), "fp"), F.struct(F.lit(1).alias("order"), turned.alias("fp")))).alias("x")).select("node", "x.order", "x.fp")
    both = both.withColumn("cell", F.shiftrightunsigned("fp", 64 - bits) if bits else F.lit(0).cast("long"))

    def large(rows: DataFrame, name: str, *key: str) -> DataFrame:
        """Groups above ``members``: stored, and so few (a row for each ``members`` fingerprints at most) that they are
        broadcast up to a million."""
        found = store.put(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > members), name)
        return F.broadcast(found) if found.count() <= 1_000_000 else found

    hot = large(both, "large_cells", "order", "cell").select("order", "cell", F.lit(True).alias("hot"))
    cells = both.withColumn("x", F.explode(pair_of(F.col("cell"), bits))).select("node", "fp", "order", "x.*")
    for c in "pq":
        cells = cells.join(hot.select("order", F.col("cell").alias(c), F.col("hot").alias(f"hot_{c}")), ["order", c], "left")
    is_hot = F.coalesce("hot_p", "hot_q", F.lit(False))
    cells = cells.select("node", "fp", "side", "split", F.xxhash64("order", "p", "q").alias("key"), is_hot.alias("hot"))

    # large cells of different leading bits have the rest of the half in common, those by themselves all but one of its bits
    rest = F.shiftrightunsigned("fp", 32).bitwiseAND(F.lit((1 << 32 - bits) - 1))
    equal = F.array(F.struct(rest.alias("p"), rest.alias("q"), F.col("side").alias("side"), F.col("split").alias("split")))
    finer = cells.where("hot").withColumn("x", F.explode(F.when(F.col("split"), equal).otherwise(pair_of(rest, 32 - bits))))
    finer = finer.select("node", "fp", "x.side", "x.split", F.xxhash64("key", "x.p", "x.q").alias("key"))

    # what is still large: pairs of parts. Members of two cells meet in both orders of their parts, those of one cell in one
    parts = large(finer, "large_groups", "key").select("key", F.ceil(F.col("n") / members).cast("int").alias("parts"))
    finer = finer.join(parts, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    finer = finer.withColumn("part", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    turn = F.col("split") & (F.col("side") == 1)
    p, q = F.when(turn, F.col("other")).otherwise(F.col("part")), F.when(turn, F.col("part")).otherwise(F.col("other"))
    p, q = F.when(F.col("split"), p).otherwise(F.least(p, q)), F.when(F.col("split"), q).otherwise(F.greatest(p, q))
    finer = finer.select("node", "fp", F.xxhash64("key", p, q).alias("key"), F.when(F.col("split"), F.col("side")).otherwise(F.col("part")).alias("side"), (F.col("split") | (p != q)).alias("split"))
    keyed = cells.where("not hot").select("node", "fp", "key", "side", "split").unionByName(finer.select("node", "fp", "key", "side", "split"))
    dealt = keyed.repartition("key").sortWithinPartitions("key", gray_rank(F.col("fp")))

    def solve(fp: np.ndarray, node: np.ndarray, key: np.ndarray, side: np.ndarray, split: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.concatenate([edges, [len(key)]]))
        keep = np.repeat(sizes > 1, sizes)
        fp, node, key, side, split, sizes = fp[keep], node[keep], key[keep], side[keep], split[keep], sizes[sizes > 1]
        ends, work = np.cumsum(sizes), np.cumsum(sizes * sizes)
        at = 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + 4_000_000, "right")))
            own = slice(ends[at] - sizes[at], ends[to - 1])
            a, b = gray_links(fp[own], key[own], side[own], split[own], radius, radius // 2)
            order = np.argsort(node[own], kind="stable")  # the smallest node becomes the root
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            root = roots(len(order), rank[a], rank[b])
            sorted_nodes = node[own][order]
            x, y = sorted_nodes, sorted_nodes[root]
            yield pa.RecordBatch.from_arrays([pa.array(x[x > y]), pa.array(y[x > y])], ["a", "b"])
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)])
            rows += batch.num_rows
            if rows >= 100_000:
                cols = [np.concatenate(c) for c in zip(*held, strict=True)]
                cut = int(np.searchsorted(-(cols[2] != cols[2][-1]).astype("int8"), 0, "left"))  # the last group may go on
                if cut:
                    yield from solve(cols[0][:cut].view("uint64"), *[c[:cut] for c in cols[1:]])
                held, rows = [[c[cut:] for c in cols]], rows - cut
        if rows:
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            yield from solve(cols[0].view("uint64"), *cols[1:])

    return dealt.select("fp", "node", "key", "side", "split").mapInArrow(run, "a long, b long").distinct()


def components(store: Store, found: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root of all nodes that have a smaller one in their component; ``found`` has a > b."""
    edges, before = store.put(found, "links-0"), None
    for k in range(1, max_rounds):
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if now == before or now.n == 0:
            break
        before = now
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = store.put(large, f"large-{k}")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a > b").distinct()
        edges = store.put(small, f"links-{k}")
        store.drop(f"large-{k}")
        store.drop(f"links-{k - 1}")
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def group(docs: DataFrame, width: int = 3, radius: int = 3, members: int = 2048) -> DataFrame:
    """doc_id, fp and component_id (the smallest id reachable over links, itself included) of each row."""
    store = Store(docs.sparkSession)
    marked = store.put(fingerprint(docs, width), "fingerprints")
    nodes = store.put(marked.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null"), "nodes")
    roots_ = components(store, links(nodes, store, radius, members))
    named = nodes.join(roots_, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return marked.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
