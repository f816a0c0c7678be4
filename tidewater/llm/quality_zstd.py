"""Quality by compression: one zstandard dictionary of good text, one of bad text.

A text is cut into blocks, and every block is compressed with either dictionary. The better a dictionary suits, the
smaller the result: (bytes with the bad one - bytes with the good one) / bytes of text, over the whole text, is the
normalised difference. Endlessly repeated words are small with both, so the mean size by bytes of text goes with it.
A logistic curve over both, fitted on labelled documents that no dictionary was made from, gives the probability of
good quality.

Null and empty texts have difference 0 and size 1, and score as that; a text of any length is scored to its end. Where
the training rows lack a label, or have too little text of one for a dictionary, every score is the share of good labels, 0.5
without any label. Each row gets its result, repeated and null ids included; an id of several labels counts as the
largest of them. Other columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import sampled, slices

BLOCK = 2048
#: Dictionaries are trained on pieces of this length, so that a few texts are samples enough.
SAMPLE = 256
LEVEL = 3
DICT_BYTES = 110_000


def dictionary(texts: list[bytes], size: int = DICT_BYTES) -> bytes | None:
    """A trained dictionary; None where there is too little text to train on."""
    samples = [t[i : i + SAMPLE] for t in texts for i in range(0, len(t), SAMPLE)]
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return None


class Scale:
    """Sizes of texts under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.both = [zstandard.ZstdCompressor(level=LEVEL, dict_data=self._made(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (good, bad)]

    @staticmethod
    def _made(data: bytes) -> zstandard.ZstdCompressionDict:
        made = zstandard.ZstdCompressionDict(data)
        made.precompute_compress(level=LEVEL)
        return made

    def measure(self, text: str | None) -> tuple[float, float]:
        """Normalised difference, and the mean compressed size by bytes of text."""
        data = (text or "").encode()
        if not data:
            return 0.0, 1.0
        good, bad = (sum(len(c.compress(data[i : i + BLOCK])) for i in range(0, len(data), BLOCK)) for c in self.both)
        return (bad - good) / len(data), (bad + good) / (2 * len(data))


def design(measures: list[tuple[float, float]]) -> np.ndarray:
    d, r = np.array(measures, float).reshape(-1, 2).T
    r = np.log(np.maximum(r, 1e-4))
    return np.stack([d, r, r * r], 1)


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> dict:
    """Logistic regression of y on the standardised columns of x by Newton steps."""
    mean, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * w)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return {"mean": mean, "scale": scale, "slopes": w[:-1], "offset": float(w[-1])}


def on_curve(x: np.ndarray, curve: dict) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip((x - curve["mean"]) / curve["scale"] @ curve["slopes"] + curve["offset"], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, keep: Column, per_class: int = 1500, most: int = 4) -> dict:
    """Dictionaries and curve from about ``per_class`` labelled documents of each kind, at most ``most`` blocks of each.

    The blocks of a longer text are chosen by hash, from all of it. The share of good documents, over all labels that pass
    ``keep``, sets the curve's offset: the sample has as many of each kind.
    """
    known = labels.where(keep & F.col("quality").isin(0, 1))
    rows = sampled(docs, known, "quality", per_class, BLOCK, most)
    n = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    prior = n.get(1, 0) / sum(n.values()) if n else 0.5
    texts = [["".join(r.parts) for r in rows if r.quality == q] for q in (0, 1)]
    bad, good = (dictionary([t.encode() for t in kind[::2]]) for kind in texts)
    rest = [kind[1::2] for kind in texts]
    if bad is None or good is None or not all(rest):
        return {"good": b"", "bad": b"", "curve": None, "prior": prior}
    scale = Scale(good, bad)
    y = np.repeat([0.0, 1.0], [len(kind) for kind in rest])
    curve = fit_curve(design([scale.measure(t) for kind in rest for t in kind]), y)
    if 0 < prior < 1:
        curve["offset"] += float(np.log(prior / (1 - prior)) - np.log(y.mean() / (1 - y.mean())))
    return {"good": good, "bad": bad, "curve": curve, "prior": prior}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, difference, and the probability that the text is of good quality."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        scale = Scale(m["good"], m["bad"]) if m["curve"] else None
        for part in (p for batch in batches for p in slices(batch)):
            x = [scale.measure(t) if scale else (0.0, 1.0) for t in part.column(1).to_pylist()]
            p = on_curve(design(x), m["curve"]) if scale else np.full(len(x), m["prior"])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([a for a, _ in x], pa.float64()), pa.array(p, pa.float64())], ["doc_id", "difference", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, difference double, score double")
