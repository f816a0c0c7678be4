"""Near copies by MinHash bands over word shingles, each pair confirmed by its exact similarity.

Words as in ``simhash``. The least values of a document's shingles under ``BANDS`` times ``ROWS`` permutations make one key
for each band. A key links its documents to the first of them (least id), so a large group gives one pair for each
document and band, not all pairs. A pair stays if the Jaccard similarity of its shingle sets is ``similarity`` or more.
The two steps are apart, so that a caller who knows some documents to be linked already can leave their pairs out and need
not move their texts.

Texts without words and rows without id have no pairs; rows with equal ids count as one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Store, slices
from tidewater.llm.substring_dedup import runs_of, word_hashes

WIDTH, SIMILARITY, BANDS, ROWS = 5, 0.8, 20, 5
#: Permutations of 64-bit hashes: products with odd numbers.
FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, dtype="int64").view("uint64") * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def shingle_set(power: np.ndarray, width: int) -> np.ndarray:
    """Sorted hashes of the shingles, from those of the words; the whole sequence is one where there are fewer words."""
    return np.unique(runs_of(power, min(width, len(power)))) if len(power) else np.zeros(0, "uint64")


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    power, sizes = word_hashes([(t or "").encode() for t in texts])
    return [shingle_set(p, width) for p in np.split(power, np.cumsum(sizes)[:-1])]


def band_keys(shingles: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, "uint64")
    for at in range(0, len(shingles), 1024):
        np.minimum(least, np.multiply.outer(FACTORS, shingles[at : at + 1024]).min(1), out=least)
    least = least.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype="uint64")
    for k in range(ROWS):
        key = (key ^ least[:, k]) * MIX
        key ^= key >> np.uint64(31)
    return key.view("int64")


def candidates(docs: DataFrame, store: Store, width: int = WIDTH) -> DataFrame:
    """a, b with a > b: ids of documents that share the key of a band, the first of which is b."""
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=1 << 20):
                sets = [(i, s) for i, s in zip(part.column(0).to_pylist(), shingle_sets(part.column(1).to_pylist(), width), strict=True) if len(s)]
                if sets:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([band_keys(s) for _, s in sets])), pa.array(np.repeat([i for i, _ in sets], BANDS))], ["key", "doc_id"])

    keys = store.put(rows.mapInArrow(sketch, "key long, doc_id long"), "bands")
    first = keys.groupBy("key").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("last")).where("b < last").select("key", "b")
    first = store.put(first, "first_bands")  # a stored table: its join can be split where a key is hot
    return store.put(keys.join(first, "key").where("doc_id > b").select(F.col("doc_id").alias("a"), "b").distinct(), "pairs")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """Of pairs (a, b) those that are alike; ``texts`` has doc_id and text, one row for each id of a pair."""
    for side in "ab":  # pairs and texts grow with the corpus: sorted and merged at every size, and a hot id's part can be split
        pairs = pairs.join(texts.select(F.col("doc_id").alias(side), F.col("text").alias(f"{side}_text")).hint("merge"), side)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, held = [], (None, None)
            for a, b, s, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held[0] != b:
                    held = b, shingle_sets([t], width)[0]
                x, y = shingle_sets([s], width)[0], held[1]
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common >= similarity * (len(x) + len(y) - common):
                    keep.append((a, b))
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*keep, strict=True)], ["a", "b"])

    return pairs.select("a", "b", "a_text", "b_text").mapInArrow(confirm, "a long, b long")
