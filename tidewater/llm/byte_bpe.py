"""Byte-level BPE through a sentencepiece model that is serialised straight from a rank file.

Each vocabulary entry is a byte string with a rank. Bytes are mapped to one character each (U+0100 + byte), an entry's
score is its negative rank, and normalisation is the identity, so sentencepiece merges the same pairs in the same order
as the rank file asks for. Text is split by a pattern first and each match is encoded by itself; a match that is an entry as
a whole is that entry. Decoding maps ids back to entries and entries to bytes.

A null text counts as empty and has no ids. Ids and texts of any length work; repeated rows give repeated results, and
further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from tidewater.llm import common

#: Matches that a worker remembers.
CACHE = 300_000

MAPPED = {b: 0x100 + b for b in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def mapped(data: bytes) -> str:
    return data.decode("latin-1").translate(MAPPED)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose piece ids are the ranks; the unknown piece follows the last."""
    size = max(ranks.values()) + 1
    by_rank: list[bytes | None] = [None] * size
    for word, rank in ranks.items():
        by_rank[rank] = word
    normal, unknown, unused = 1, 2, 5
    pieces = [_field(1, mapped(w).encode()) + _field(2, -float(i)) + _field(3, normal) if w is not None else _field(1, f"<gap{i}>".encode()) + _field(2, 0.0) + _field(3, unused) for i, w in enumerate(by_rank)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    trainer = _field(3, 2) + _field(4, size + 1) + _field(40, size) + b"".join(_field(k, -1) for k in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec(dict):
    """Match -> its ids as little-endian 32-bit integers; filled as matches are met."""

    def __init__(self, model: bytes, pattern: str):
        super().__init__()
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        back = {v: k for k, v in MAPPED.items()}
        n = self.pieces.get_piece_size() - 1
        self.table = [b"" if self.pieces.is_unused(i) else self.pieces.id_to_piece(i).translate(back).encode("latin-1") for i in range(n)]
        self.ranks = {w: i for i, w in enumerate(self.table) if w}
        self.find = regex.compile(pattern).findall

    def __missing__(self, match: str) -> bytes:
        data = match.encode()
        whole = self.ranks.get(data)
        ids = [whole] if whole is not None else self.pieces.encode(mapped(data))
        out = np.array(ids, "<i4").tobytes()
        if len(self) >= CACHE:
            self.clear()
        self[match] = out
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, self.find(text))), "<i4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.table.__getitem__, ids.tolist()))


def tokenize(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded (the bytes that the ids stand for) of each whole text.

    ``ranks_path`` is read by the driver; the model, under 2 MB for 50,000 entries, is broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model_bytes(read_ranks(ranks_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(sent.value, pattern)
        for batch in batches:
            for part in common.slices(batch):
                ids = [codec.encode(t or "") for t in part.column(1).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("int32")
                flat = pa.array(np.concatenate(ids), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, flat), pa.array([codec.decode(x) for x in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary")
