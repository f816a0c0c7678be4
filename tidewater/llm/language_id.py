"""Language identification by cross-parsing: longest matches against suffix automata of labelled text.

For each language a suffix automaton holds a bounded sample of its labelled text, as UTF-8 bytes of lower-case letters with
everything else as one blank, so an alphabet of any size will do. A text is cut, from left to right, into the longest
pieces that occur in that sample (a byte that doesn't occur is a piece); the fewer pieces per byte, each costed by the
logarithm of the sample's length, the closer the language.

The pieces are those of the whole text: it is parsed from many starting points at once, as rows of NumPy arrays, each
until it meets a piece that the parse from a later point begins too, from where on both are the same. What the parse
from the text's first byte needs is then put together from these stretches. So a text of any length takes
the memory of one batch.

A null text, or one without a letter, is ``und`` with score 0. Equal costs go to the alphabetically first language.
Without any labelled text every document is ``und``. Each row gets its result, repeated and null ids included, but
nothing is learnt from null ids; an id of several languages counts as the alphabetically last.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import sampled, slices

#: Bytes between two starting points.
BLOCK = 512
REST = re.compile(r"[\W\d_]+")
ENDED = 1 << 30
#: Bytes of labelled text in the automata of all languages together.
TOTAL = 1_000_000


def plain(text: str) -> bytes:
    return REST.sub(" ", text.lower()).lstrip(" ").encode("utf-8", "replace")


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all substrings; state 0 is the start."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return nxt


class Model:
    """One automaton per language, as arrays.

    A state with one way on has it in ``only`` (byte code) and ``to``; any other has a row of ``ways`` over all codes, at
    ``row``. Where no way leads on, a piece ends (``ENDED``) and the next one begins with the code at hand.
    """

    def __init__(self, texts: dict[str, bytes]):
        self.langs = sorted(texts)
        used = np.unique(np.frombuffer(b"".join(texts.values()), "uint8"))
        self.code = np.zeros(256, "uint8")  # 0: not in any sample
        self.code[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        only, to, row, ways = [], [], [], []
        self.starts, self.bits, base, rows = [], [], 0, 0
        for lang in self.langs:
            nxt = suffix_automaton(self.code[np.frombuffer(texts[lang], "uint8")].tolist())
            lost = len(nxt)  # the state after a byte that the sample lacks
            begun = np.full(width, base + lost | ENDED, "int64")
            for c, t in nxt[0].items():
                begun[c] = base + t | ENDED
            ways.append(begun)
            first, rows = rows, rows + 1
            for s, edges in enumerate([*nxt, {}]):
                single = len(edges) == 1 and s > 0
                c, t = next(iter(edges.items())) if single else (255, 0)
                only.append(c)
                to.append(base + t)
                row.append(first * width)
                if s == 0 or len(edges) > 1:
                    own = begun.copy() if s else begun & ~ENDED
                    for c, t in edges.items():
                        own[c] = base + t
                    row[-1] = rows * width
                    ways.append(own)
                    rows += 1
            self.starts.append(base)
            self.bits.append(float(np.log2(max(2, len(texts[lang])))))
            base += lost + 1
        self.only, self.to, self.row = np.array(only, "uint8"), np.array(to, "int32"), np.array(row, "int32")
        self.ways = np.concatenate(ways).astype("int32") if ways else np.zeros(0, "int32")

    def step(self, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a piece begins with the code."""
        got = np.where(self.only[state] == code, self.to[state], self.ways[self.row[state] + code])
        return got & (ENDED - 1), got >= ENDED

    def pieces(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many pieces each language needs for each text, and how many bytes each text has."""
        sizes = np.array([len(t) for t in texts], "int64")
        counts = np.zeros((len(self.langs), len(texts)), "int64")
        if not sizes.sum():
            return counts, sizes
        codes = self.code[np.frombuffer(b"".join(texts), "uint8")]
        text_end = np.cumsum(sizes)
        blocks = -(-sizes // BLOCK)
        first = np.cumsum(blocks) - blocks
        owner = np.repeat(np.arange(len(texts)), blocks)
        at = (text_end - sizes)[owner] + (np.arange(len(owner)) - first[owner]) * BLOCK
        stop = np.minimum(at + BLOCK, text_end[owner])
        # every block from its own start
        order = np.argsort(at - stop, kind="stable")
        pos, left = at[order], (stop - at)[order]
        live = np.searchsorted(-left, -np.arange(left[0]), "left")
        state = np.repeat(np.array(self.starts, "int32")[:, None], len(pos), 1)
        begins = np.zeros((len(self.langs), len(codes)), bool)
        for t in range(int(left[0])):
            n = live[t]
            here = pos[:n] + t
            state[:, :n], begins[:, here] = self.step(state[:, :n], codes[here])
        begins[:, at] = True
        # on from its end, until a piece begins where one begins in a later block
        lang, block = np.nonzero(np.broadcast_to(stop[order] < text_end[owner[order]], state.shape))
        state, block = state[lang, block], order[block]
        here, end = stop[block], text_end[owner[block]]
        more = np.zeros((len(self.langs), len(owner)), "int64")
        met = np.full(more.shape, -1, "int64")
        while len(here):
            state, new = self.step(state, codes[here])
            same = new & begins[lang, here]
            met[lang[same], block[same]] = here[same]
            new &= ~same
            more[lang[new], block[new]] += 1
            here = here + 1
            on = ~same & (here < end)
            state, lang, block, here, end = state[on], lang[on], block[on], here[on], end[on]
        # from a text's first byte, over the stretches that were met
        before = np.concatenate([np.zeros((len(self.langs), 1), "int32"), np.cumsum(begins, 1, "int32")], 1)
        lang, text = np.nonzero(np.broadcast_to(sizes > 0, counts.shape))
        entry = (text_end - sizes)[text]
        while len(lang):
            b = first[text] + (entry - (text_end - sizes)[text]) // BLOCK
            counts[lang, text] += before[lang, stop[b]] - before[lang, entry] + more[lang, b]
            entry = met[lang, b]
            on = entry >= 0
            lang, text, entry = lang[on], text[on], entry[on]
        return counts, sizes

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language that needs the fewest bits per byte, and its share among all languages (0 to 1)."""
        named = np.array([any(map(str.isalpha, t or "")) for t in texts], bool)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        counts, sizes = self.pieces([plain(t or "") for t in texts])
        cost = counts * np.array(self.bits)[:, None] / np.maximum(1, sizes)
        best = cost.argmin(0)
        share = 1 / np.exp2(-(cost - cost.min(0)) * np.minimum(sizes, 32)).sum(0)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, named, strict=True)], np.where(named, share, 0.0)


def train(docs: DataFrame, keep: Column, per_lang: int = 150, chars: int = 400, total: int = TOTAL) -> Model:
    """From about ``per_lang`` documents of each language that pass ``keep``, a piece of ``chars`` characters of each.

    The pieces are chosen by hash from whole texts. Languages share ``total`` bytes evenly, so the model is bounded
    however many there are.
    """
    texts: dict[str, list[bytes]] = {}
    for row in sampled(docs, docs.where(keep), "lang", per_lang, chars, 1):
        texts.setdefault(row.lang, []).append(plain(row.parts[0]))
    return Model({k: b" ".join(dict.fromkeys(v))[: total // len(texts)] for k, v in texts.items()})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and lang_pred, lang_score of each whole text (columns of these names are replaced)."""
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))
    rows = docs.drop("lang_pred", "lang_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.__new__(Model)
        vars(own).update(sent.value)
        for batch in batches:
            column = batch.schema.get_field_index("text")
            for part in slices(batch, column):
                langs, share = own.predict(part.column(column).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(share, pa.float64())], [*part.schema.names, "lang_pred", "lang_score"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]))
