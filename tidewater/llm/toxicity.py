"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents and unlabelled documents train a linear classifier over words and their inner character
4-grams, in NumPy. With p the share of toxic documents among all, the risk is p times the loss of the toxic ones as
toxic, plus the loss of the unlabelled ones as clean less p times that of the toxic ones as clean; where this
difference falls below zero, it is pushed up again, so the unlabelled toxic documents aren't learnt as clean.

Null and empty texts score as a text without features; a text of any length is scored to its end. Without confirmed examples
each score is 0. Each row gets its result, repeated and null ids included; an empty table gives an empty result. Other columns
of the inputs are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import cut, sampled, share_of, slices

WORD = re.compile(r"[^\W\d_]+")
GRAM = 4
CACHE = 300_000


def parts(word: str) -> list[str]:
    """The word itself and its character 4-grams, with marks at its ends."""
    marked = f"^{word}$"
    return [marked, *(marked[i : i + GRAM] for i in range(len(marked) - GRAM + 1))] if len(marked) > GRAM else [marked]


def features(text: str | None) -> set[str]:
    return {f for w in set(WORD.findall((text or "").lower())) for f in parts(w)}


def risk_gradient(z: np.ndarray, positive: np.ndarray, prior: float, slack: float = 0.0) -> tuple[float, np.ndarray]:
    """The non-negative risk under the logistic loss, and its derivative by the scores ``z``."""
    s = 1 / (1 + np.exp(-z))
    soft = np.logaddexp(0, z)  # loss of z as clean; less z: as toxic
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    as_toxic = prior * (soft - z)[positive].sum() / n_p
    as_clean = soft[~positive].sum() / n_u - prior * soft[positive].sum() / n_p
    clean = np.where(positive, -prior * s / n_p, s / n_u)
    if as_clean < -slack:
        return as_toxic, -clean
    return as_toxic + as_clean, clean + np.where(positive, prior * (s - 1) / n_p, 0.0)


def telling(positive: np.ndarray, unlabelled: np.ndarray, n_positive: int, n_unlabelled: int, z: float) -> np.ndarray:
    """Which features differ in frequency between both kinds by ``z`` standard errors at least."""
    share = (positive + unlabelled + 1) / (n_positive + n_unlabelled + 2)
    error = np.sqrt(share * (1 - share) * (1 / n_positive + 1 / n_unlabelled))
    return np.abs(positive / n_positive - unlabelled / n_unlabelled) >= z * error


def fit(positive: list[str], unlabelled: list[str], prior: float, steps: int = 200, rate: float = 0.05, decay: float = 2e-4, least: int = 4, z: float = 2.5) -> dict:
    """Weights by feature: full-batch Adam on the non-negative risk.

    Features of under ``least`` documents, and those as frequent in both kinds, are left out.
    """
    counts: list[Counter] = [Counter(), Counter()]
    for k, texts in enumerate((positive, unlabelled)):
        for t in texts:
            counts[k].update(features(t))
    names = sorted(f for f in counts[0].keys() | counts[1].keys() if counts[0][f] + counts[1][f] >= least)
    both = [np.array([c[f] for f in names], float) for c in counts]
    names = [f for f, ok in zip(names, telling(*both, len(positive), len(unlabelled), z), strict=True) if ok]
    index = {f: i for i, f in enumerate(names)}
    rows = [np.array(sorted(index[f] for f in features(t) if f in index), "int64") for t in [*positive, *unlabelled]]
    cols = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    is_positive = np.arange(len(rows)) < len(positive)
    w, b = np.zeros(len(names)), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        _, g = risk_gradient(np.clip(np.bincount(owner, w[cols], len(rows)) + b, -30, 30), is_positive, prior)
        gw, gb = np.bincount(cols, g[owner], len(names)) + decay * w, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        fix = np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= rate * fix * m / (np.sqrt(v) + 1e-8)
        b -= rate * fix * mb / (np.sqrt(vb) + 1e-8)
    return {"weights": {f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-3}, "bias": float(b)}


#: Characters of a training piece; a longer text is represented by pieces chosen by hash from all of it.
PIECE = 1000


def train(docs: DataFrame, labels: DataFrame, keep: Column, prior: float | None = None, n_positive: int = 1500, n_unlabelled: int = 3000, most: int = 5) -> dict:
    """From about that many documents of each kind whose ids pass ``keep``, at most ``most`` pieces of each.

    ``prior`` is the share of toxic documents; None takes it from the labels that pass ``keep``. Unlabelled documents
    are drawn from all that pass it, without a look at their labels.
    """
    toxic = sampled(docs, labels.where(keep & (F.col("toxic") == 1)), "toxic", n_positive, PIECE, most)
    pool = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull() & keep)
    n = pool.select("doc_id").count()
    if not toxic or not n:
        return {"weights": {}, "bias": -30.0}
    plain = cut(pool.where(share_of(F.col("doc_id"), "unlabelled") < 1.2 * n_unlabelled / n), PIECE, most).collect()
    if not plain:
        return {"weights": {}, "bias": -30.0}
    if prior is None:
        got = labels.where(keep).agg(F.avg("toxic").alias("p")).first().p
        prior = min(0.9, max(0.001, got or 0.0))
    return fit([" ".join(r.parts) for r in toxic], [" ".join(r.parts) for r in plain], prior)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and the probability that the whole text is toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value["weights"], sent.value["bias"]

        class Known(dict):
            def __missing__(self, word: str) -> tuple[str, ...]:
                if len(self) >= CACHE:
                    self.clear()
                got = self[word] = tuple(f for f in parts(word) if f in weights)
                return got

        known = Known()
        for part in (p for batch in batches for p in slices(batch)):
            z = np.array([sum(map(weights.__getitem__, {f for w in set(WORD.findall((t or "").lower())) for f in known[w]})) for t in part.column(1).to_pylist()], float) + bias
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
