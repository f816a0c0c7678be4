"""Event sources with a cursor: frames by sequence number, replayed in ranges or followed live.

``Firehose`` reads a folder of JSON lines, each a frame with ``seq``; a service over the network differs in how it fetches a
range only. Executors need this module to read it in ranges.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

FRAME = "kind string, seq long, did string, collection string, rkey string, operation string, subject string, text string, error string"


def fetch(path: str, after: int, until: int | None, collections: tuple[str, ...], limit: int | None = None) -> list[tuple[int, str]]:
    """seq and frame of those above ``after``, up to ``until``, in order; a collection that isn't asked for is passed over."""
    found = []
    for file in sorted(Path(path).glob("*.jsonl")):
        for line in file.read_text().splitlines():
            try:
                frame = json.loads(line)
                seq = int(frame["seq"])
            except (ValueError, KeyError, TypeError):
                continue  # without a number it has no place in a range; ``decoded`` is for frames that have one
            if seq > after and (until is None or seq <= until) and (not collections or frame.get("collection") in collections or "error" in frame):
                found.append((seq, line))
    return sorted(found)[:limit]


class Range(InputPartition):
    def __init__(self, after: int, until: int):
        self.after, self.until = after, until


class Replay(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.options = options

    def partitions(self) -> list[Range]:
        """Contiguous ranges of sequence numbers, the newest first."""
        low, high, n = int(self.options.get("after", 0)), int(self.options["until"]), int(self.options.get("segments", 8))
        cuts = [low + (high - low) * k // n for k in range(n + 1)]
        return [Range(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a][::-1]

    def read(self, partition: Range) -> Iterator[tuple]:
        yield from fetch(self.options["path"], partition.after, partition.until, wanted(self.options))


class Follow(SimpleDataSourceStreamReader):
    """From the cursor on, at most ``limit`` frames a micro-batch."""

    def __init__(self, options: Mapping[str, str]):
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802  Spark's name
        return {"seq": int(self.options.get("after", 0))}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = fetch(self.options["path"], start["seq"], None, wanted(self.options), int(self.options.get("limit", 250)))
        return iter(rows), {"seq": rows[-1][0] if rows else start["seq"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802  Spark's name
        yield from fetch(self.options["path"], start["seq"], end["seq"], wanted(self.options))


def wanted(options: Mapping[str, str]) -> tuple[str, ...]:
    return tuple(x for x in options.get("collections", "").split(",") if x)


class Firehose(DataSource):
    @classmethod
    def name(cls) -> str:
        return "firehose"

    def schema(self) -> str:
        return "seq long, frame string"

    def reader(self, schema: StructType) -> Replay:
        return Replay(self.options)

    def simpleStreamReader(self, schema: StructType) -> Follow:  # noqa: N802  Spark's name
        return Follow(self.options)


def decoded(frames: DataFrame) -> DataFrame:
    """Frames with ``status``: event, gap (the cursor is too old for the service), error (as it says), or corrupt."""
    x = F.from_json("frame", FRAME + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = frames.select("seq", "frame", x.alias("x"))
    status = F.when(F.col("x").isNull() | F.col("x._bad").isNotNull(), "corrupt").when(F.lower("x.error") == "outdatedcursor", "gap").when(F.col("x.error").isNotNull(), "error").otherwise("event")
    return rows.select("seq", status.alias("status"), "x.did", "x.collection", "x.rkey", "x.operation", "x.subject", "x.text", "x.error")


def seek(times: Callable[[int], float], low: int, high: int, at: float) -> int:
    """The least cursor in (low, high] of which the service's time is ``at`` or later, by probing; times don't fall."""
    while high - low > 1:
        mid = (low + high) // 2
        if times(mid) >= at:
            high = mid
        else:
            low = mid
    return high


def tail(query: StreamingQuery, seconds: float) -> None:
    """Let a live query run for so long, then stop it."""
    query.awaitTermination(seconds)
    query.stop()


def hydrated(rows: DataFrame, key: str, lookup: Callable[[list[str]], Mapping[str, Mapping]], known: DataFrame, now: float, ttl: float, a_call: int = 25) -> DataFrame:
    """``known`` (key, value as JSON, gone, fetched) brought up to date for the keys of ``rows``.

    Keys that are known, and fetched less than ``ttl`` before ``now``, aren't asked for again; the others go to ``lookup``
    ``a_call`` at a time, once each. Those that it doesn't return are gone.
    """
    asked = rows.select(F.col(key).cast("string").alias("key")).where("key is not null").distinct()
    stale = asked.join(known.where(F.col("fetched") > now - ttl).select("key"), "key", "left_anti")

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys = sorted(frame["key"])
            for i in range(0, len(keys), a_call):
                part = keys[i : i + a_call]
                got = lookup(part)
                yield pd.DataFrame({"key": part, "value": [json.dumps(got[k]) if k in got else None for k in part], "gone": [k not in got for k in part], "fetched": now})

    new = stale.mapInPandas(call, "key string, value string, gone boolean, fetched double")
    return new.unionByName(known.join(stale, "key", "left_anti").select("key", "value", "gone", "fetched"))
