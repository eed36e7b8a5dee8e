"""Repeated passages by relative Lempel-Ziv parsing.

Anchors (see anchors.py) gather the stretches of words that can share a window
of 35; each gathering is a reference block. A block is indexed once by a suffix
array over its words. A document's stretch is factored greedily against the
block's other places: the next factor is the longest prefix of what is left that
occurs there. A window of 35 words lies inside one factor, which is then long
enough, or straddles a border between factors; so all windows inside long
factors are repeats, and those at the borders are looked up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .anchors import Window, attach, covered, packed, unpack
from .bwt_dedup import by_anchor, found_spans
from .common import expand, keyed, pieces, raw, word_hashes, words
from .suffixes import doubled, lay_out, longest

WIDTH = 35
CHUNK = 1 << 21


def word_tokens(data: np.ndarray, offs: np.ndarray):
    start, end, at = words(data, offs)
    return word_hashes(data, start, end), at


class Block:
    """A reference block: strings of word hashes and, for every place, the
    length of the longest match that starts at another place."""

    def __init__(self, strings: list[np.ndarray]):
        size = np.array([len(s) for s in strings], np.int64)
        offs = np.concatenate(([0], np.cumsum(size)))
        _, tokens = np.unique(np.concatenate(strings), return_inverse=True)
        sym, self.start = lay_out(tokens.astype(np.int64), offs)
        levels = doubled(sym, int(size.max(initial=0)) + 1)
        order = np.argsort(levels[-1], kind="stable")
        near = longest(levels, order[:-1], order[1:])
        self.match = np.zeros(len(sym), np.int64)
        self.match[order[:-1]] = near
        self.match[order[1:]] = np.maximum(self.match[order[1:]], near)
        self.size = size

    def factors(self, i: int) -> list[tuple[int, int]]:
        """Greedy factors (start, length) of string i; a word that occurs
        nowhere else is a factor of length 1."""
        m, out, at, n = self.match[self.start[i] : self.start[i] + self.size[i]].tolist(), [], 0, int(self.size[i])
        while at < n:
            step = max(1, m[at])
            out.append((at, step))
            at += step
        return out

    def repeats(self, i: int, width: int) -> np.ndarray:
        """Starts of the windows of string i that also start elsewhere."""
        m, n, out = self.match[self.start[i] : self.start[i] + self.size[i]], int(self.size[i]), []
        for at, step in self.factors(i):
            if step >= width:
                out.append(np.arange(at, at + step - width + 1))
            border = np.arange(max(0, at - width + 1), min(at, n - width + 1))
            out.append(border[m[border] >= width])
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def _cut(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return word_tokens(*raw(col))


def _strip(batches):
    for part in (p for batch in batches for p in pieces(batch, "text", 1 << 20)):
        data, offs = raw(part.column(2))
        start, end, at = words(data, offs)
        stay = ~covered(at, part.column(3))
        left = np.concatenate(([0], np.cumsum(stay)))[at]  # words kept before each document
        size = (end - start + 1)[stay]  # each with one space
        joined = np.append(data, np.uint8(32))[expand(start[stay], size)]
        joined[np.cumsum(size) - 1] = 32
        ends = np.concatenate(([0], np.cumsum(size)))
        some = np.diff(left) > 0
        inside = np.ones(len(joined), bool)
        inside[ends[left[1:][some]] - 1] = False  # none after the last
        cut = (ends[left] - np.concatenate(([0], np.cumsum(some)))).astype(np.int32)
        kept = pa.Array.from_buffers(pa.string(), part.num_rows, [None, pa.py_buffer(cut.tobytes()), pa.py_buffer(joined[inside].tobytes())])
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), pa.array(np.diff(at) - np.diff(left)), kept], names=["doc_id", "n_words", "n_removed", "kept"])


def rlz_dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept (the words that
    stay, joined by one space). A word goes if it lies in a window of `width`
    words whose sequence also starts anywhere else, in this document or another;
    words are runs of [^\\x20\\x09-\\x0D]. Null texts are empty, shorter ones keep
    all. Repeated rows repeat each other. Other columns are ignored; an empty
    table gives an empty table."""
    rows = keyed(docs)
    win = Window(width, 6, word_tokens)

    def factored(strings: list[np.ndarray], i: np.ndarray, batch: pa.RecordBatch) -> list[np.ndarray]:
        block = Block(strings)
        return [block.repeats(k, width) for k in range(len(strings))]

    lists = found_spans(rows, win, _cut, by_anchor(win, CHUNK, np.uint64, factored))
    return attach(packed(rows), lists).select("doc_id", "h", "text", "spans").mapInArrow(unpack(_strip), "doc_id long, n_words long, n_removed long, kept string")
