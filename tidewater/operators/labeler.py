"""Labels from a model or a service: each distinct text once, mapped back to its rows, with where the label came from."""

from __future__ import annotations

import hashlib
import json
import math
import random
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts to answers, one a text and in their order; each answer is a mapping from a question's name to its value.
Labeler = Callable[[list[str]], Sequence[Mapping[str, object]]]


@dataclass(frozen=True)
class Question:
    """``kind`` is choice (of ``options``), noul (a probability) or score (from 0 to ``levels`` - 1)."""

    name: str
    kind: str
    options: tuple[str, ...] = ()
    levels: int = 5

    def problems(self, answer: object) -> str | None:
        """What is wrong with an answer, None if nothing is."""
        if self.kind == "choice":
            if not isinstance(answer, Mapping) or set(answer) != set(self.options):
                return f"{self.name}: the options are {sorted(self.options)}"
            if any(not is_share(p) for p in answer.values()) or abs(sum(answer.values()) - 1) > 1e-3:
                return f"{self.name}: probabilities must be 0 to 1 and sum to 1"
        elif self.kind == "noul":
            if not is_share(answer):
                return f"{self.name}: a probability must be 0 to 1"
        elif self.kind == "score":
            if not isinstance(answer, (int, float)) or isinstance(answer, bool) or not 0 <= answer <= self.levels - 1:
                return f"{self.name}: a score must be 0 to {self.levels - 1}"
        else:
            return f"{self.name}: unknown kind {self.kind!r}"
        return None


def is_share(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) and 0 <= x <= 1


def request_hash(model: str, questions: Sequence[Question]) -> str:
    body = json.dumps([model, [[q.name, q.kind, list(q.options), q.levels] for q in questions]], separators=(",", ":"))
    return hashlib.sha256(body.encode()).hexdigest()


def labelled(rows: DataFrame, text: str, label: Labeler, questions: Sequence[Question], model: str, cache: DataFrame | None = None, a_call: int = 64, tries: int = 4, pace: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """One row for each distinct text: text_hash, request (model and questions), answers as JSON, error, cached.

    Texts that ``cache`` (as returned before) holds without an error for the same request aren't asked for again. A call that
    fails is tried again after waits that double, with ``pace`` seconds between calls of a task; an answer that doesn't fit
    its question is an error of its text. Tasks that are run again ask again, and answers are immutable by hash, so the
    result is the same. Null and blank texts have no label.
    """
    asked = request_hash(model, questions)
    texts = rows.select(F.col(text).alias("text")).where(F.trim("text") != "").withColumn("text_hash", F.sha2("text", 256)).dropDuplicates(["text_hash"])
    known = cache.where((F.col("request") == asked) & F.col("error").isNull()).select("text_hash", "request", "answers", "error") if cache is not None else None
    todo = texts.join(known.select("text_hash"), "text_hash", "left_anti") if known is not None else texts

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        jitter = random.Random(7)
        for frame in frames:
            for i in range(0, len(frame), a_call):
                part, error, got = frame.iloc[i : i + a_call], None, None
                for k in range(tries):
                    try:
                        got, error = list(label(list(part["text"]))), None
                        if len(got) != len(part):
                            raise ValueError(f"{len(got)} answers to {len(part)} texts")
                        break
                    except Exception as e:
                        got, error = None, f"{type(e).__name__}: {e}"
                        if k + 1 < tries:
                            sleep(0.1 * 2**k * (1 + jitter.random()))
                answers, errors = [], []
                for one in got or [None] * len(part):
                    wrong = error if one is None else next((w for q in questions if (w := q.problems(one.get(q.name)))), None)
                    answers.append(None if wrong else json.dumps(one, sort_keys=True))
                    errors.append(wrong)
                yield pd.DataFrame({"text_hash": list(part["text_hash"]), "request": asked, "answers": answers, "error": errors})
                sleep(pace)

    new = todo.select("text", "text_hash").mapInPandas(call, "text_hash string, request string, answers string, error string").withColumn("cached", F.lit(False))
    if known is None:
        return new
    return new.unionByName(known.join(texts.select("text_hash"), "text_hash", "left_semi").withColumn("cached", F.lit(True)))


def mapped_back(rows: DataFrame, text: str, labels: DataFrame) -> DataFrame:
    """The rows with ``answers`` and ``error`` of their texts; null where a text has no label."""
    return rows.withColumn("text_hash", F.sha2(text, 256)).join(labels.select("text_hash", "answers", "error"), "text_hash", "left")


def two_stage(rows: DataFrame, text: str, categorise: Labeler, category: Question, accept: float, score: Labeler, scoring: Question, model: str, **calls: object) -> DataFrame:
    """Rows with ``state``: others (the first question's probability is below ``accept``), done with a score, or failed."""
    first = mapped_back(rows, text, labelled(rows, text, categorise, [category], model, **calls))
    p = F.get_json_object("answers", f"$.{category.name}").cast("double")
    first = first.withColumn("p", p).withColumn("first_error", F.col("error")).drop("answers", "error", "text_hash")
    accepted = first.where(F.col("p") >= accept)
    second = labelled(accepted, text, score, [scoring], model, **calls).select("text_hash", F.get_json_object("answers", f"$.{scoring.name}").cast("double").alias("score"), F.col("error").alias("second_error"))
    out = first.withColumn("text_hash", F.sha2(text, 256)).join(second, "text_hash", "left").drop("text_hash")
    state = F.when(F.col("p").isNull() | F.col("second_error").isNotNull(), "failed").when(F.col("p") < accept, "others").otherwise("done")
    return out.withColumn("state", state).drop("first_error", "second_error")


def verdict(answers: DataFrame, options: int, thin: int = 20, dominant: float = 0.9, unsure: float = 0.5) -> DataFrame:
    """Of a trial (choice, confidence): n, the largest share, the share of unsure answers, and what that says."""
    counts = answers.groupBy("choice").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") < unsure).alias("u"))
    all_ = counts.agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.sum("u").alias("u"), F.count(F.lit(1)).alias("groups"))
    share, doubt = F.round(F.col("top") / F.col("n"), 6), F.round(F.col("u") / F.col("n"), 6)
    says = F.when(F.col("n") < thin, "thin").when(share >= dominant, "dominant").when(doubt >= 0.5, "unsure").when(F.col("groups") < options, "unused options").otherwise("good")
    return all_.select("n", "groups", share.alias("largest"), doubt.alias("unsure"), says.alias("verdict"))


def confidence(probabilities: Column) -> Column:
    """Of a map from option to probability: the choice (of equals the first by name) and its probability."""
    best = F.array_max(F.transform(F.map_entries(probabilities), lambda e: F.struct(e["value"].alias("p"), e["key"].alias("k"))))
    top = F.array_min(F.map_keys(F.map_filter(probabilities, lambda _, p: p == best["p"])))
    return F.struct(top.alias("choice"), best["p"].alias("confidence"))
