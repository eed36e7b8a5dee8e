"""Sentences and words of many texts at a time, as text.py splits them.

Texts of characters under U+0180 and of the usual punctuation are read as one array of
characters in a task: their splitting costs a few passes over it. A text with any other
character is split by text.py's expressions in its row, so letters beyond these
are those of the JVM, and both give the same."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

#: Texts that are read as arrays; others have other letters or line ends, or the one letter under U+0180 that has two in
#: lower case. A possessive loop over one class: a search for its complement took ten times as long.
PLAIN = r"\A[\x{0}-\x{84}\x{86}-\x{12F}\x{131}-\x{17F}\x{2000}-\x{2027}\x{202A}-\x{206F}]*+\z"
_KNOWN = 0x180
#: Characters of texts that are read at a time.
PIECE = 1_000_000


def _table(f) -> np.ndarray:
    return np.array([f(chr(c)) for c in range(_KNOWN)] + [False])


_WORD = _table(lambda c: c == "_" or unicodedata.category(c)[0] in "LN")
_LETTER, _NUMBER = (_table(lambda c, k=k: unicodedata.category(c)[0] == k) for k in "LN")
_SPACE = _table(" \t\n\x0b\f\r".__contains__)
_STOP = _table(".!?".__contains__)
_LOWER = np.array([ord(chr(c).lower()[0]) for c in range(_KNOWN)], np.uint32)


class Scan(NamedTuple):
    """Of each text its number of sentences; of each sentence its lower-case words, characters
    and words between white space; and all words."""

    sents: np.ndarray
    sizes: np.ndarray
    chars: np.ndarray
    spaced: np.ndarray
    words: pa.Array


def other(t: Column) -> Column:
    """Whether a text isn't PLAIN."""
    return (F.octet_length(t) != F.length(t)) & ~t.rlike(PLAIN)


def split(t: Column) -> Column:
    """Sentences of a text, as listed() reads them."""
    return F.transform(T.sentences(t), lambda s: F.struct(T.lower_words(s).alias("ws"), F.length(s).alias("chars"), F.size(T.space_words(s)).alias("spaced")))


def columns(t: Column) -> tuple[Column, Column]:
    """What scans() reads: the text, or of an other one its sentences in its stead."""
    return F.when(~other(t), t).alias("plain"), F.when(other(t), split(t)).alias("split")


def strings(chars: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The characters in turn as strings of `sizes` characters."""
    width = np.append(0, np.cumsum(1 + (chars > 127) + (chars > 2047).astype(np.int64)))
    offsets = width[np.append(0, np.cumsum(sizes))].astype(np.int32)
    data = chars.astype("<u4").tobytes().decode("utf-32-le").encode()
    return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def begins(m: np.ndarray) -> np.ndarray:
    return np.flatnonzero(m & ~np.append(False, m[:-1])[: len(m)])


class Plain:
    """Plain texts as one array of characters, with a stop after each."""

    def __init__(self, texts: pa.Array):
        self.n, self.size = len(texts), pc.utf8_length(texts).to_numpy().astype(np.int64)
        self.ends = np.cumsum(self.size + 1)
        self.raw = np.frombuffer(".".join([*texts.to_pylist(), ""]).encode("utf-32-le"), np.uint32)
        self.code = np.minimum(self.raw, _KNOWN)
        self.word, self.space, stop = _WORD[self.code], _SPACE[self.code], _STOP[self.code]
        self.ink = ~(self.space | stop)
        self.piece, at = np.cumsum(stop), np.flatnonzero(self.ink)
        of = self.piece[at]
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)])
        last = np.append(first[1:], len(of))[: len(first)] - 1
        #: of each sentence its piece between stops, and where its first and last character are
        self.own, self.first, self.last = of[first], at[first], at[last]

    def per_text(self, at: np.ndarray) -> np.ndarray:
        """How many of the places are in each text."""
        return np.diff(np.append(0, np.searchsorted(at, self.ends)))

    def per_sentence(self, at: np.ndarray) -> np.ndarray:
        return np.bincount(np.searchsorted(self.own, self.piece[at]), minlength=len(self.own))

    @cached_property
    def low(self) -> np.ndarray:
        return np.where(self.code < _KNOWN, _LOWER[np.minimum(self.code, _KNOWN - 1)], self.raw)

    @cached_property
    def body(self) -> np.ndarray:
        """Which characters are of a text."""
        out = np.ones(len(self.raw), bool)
        out[self.ends - 1] = False
        return out

    @cached_property
    def scan(self) -> Scan:
        start, stopped = begins(self.word), np.flatnonzero(self.word & ~np.append(self.word[1:], False)[: len(self.word)]) + 1
        return Scan(self.per_text(self.first), self.per_sentence(start), self.last - self.first + 1, self.per_sentence(begins(self.ink)), strings(self.low[self.word], stopped - start))

    def lower_texts(self) -> list[str]:
        text = self.low.astype("<u4").tobytes().decode("utf-32-le")
        return [text[a : a + n] for a, n in zip((self.ends - 1 - self.size).tolist(), self.size.tolist())]

    def lower_sentences(self) -> list[str]:
        text = self.low.astype("<u4").tobytes().decode("utf-32-le")
        return [text[a:b] for a, b in zip(self.first.tolist(), (self.last + 1).tolist())]

    def marks(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each text how many of its characters are no letter, digit, _ or space, and how many commas."""
        return self.per_text(np.flatnonzero(self.body & ~self.word & ~self.space)), self.per_text(np.flatnonzero(self.raw == 44))

    def parsed(self) -> tuple[np.ndarray, pa.Array]:
        """Of each sentence its number of words and other characters, and those in lower case."""
        start = np.flatnonzero(self.ink & ~(self.word & np.append(False, self.word[:-1])[: len(self.word)]))
        ahead = np.append(0, np.cumsum(self.ink))[np.append(start, len(self.ink))]
        return self.per_sentence(start), strings(self.low[self.ink], np.diff(ahead))

    def spaced(self) -> tuple[np.ndarray, pa.Array]:
        """Of each text its number of words between white space, and those in lower case."""
        ink = self.body & ~self.space
        start = begins(ink)
        ahead = np.append(0, np.cumsum(ink))[np.append(start, len(ink))]
        return self.per_text(start), strings(self.low[ink], np.diff(ahead))

    def marked(self) -> np.ndarray:
        """The characters of all texts in lower case, 0 for what is no letter, number or white space."""
        good = (_LETTER[self.code] | _NUMBER[self.code] | self.space)[self.body]
        return np.where(good, self.low[self.body], 0)

    def pretokens(self) -> tuple[np.ndarray, pa.Array]:
        """Of each text its number of tokens of text.PRETOKEN, and those: runs of letters, of numbers, of white
        space and of others; a single space goes to the run after it, and a run that is one apostrophe, without
        a space, takes s, t, re, ve, m, ll or d from the letters after it."""
        kind = np.where(_LETTER[self.code], 1, np.where(_NUMBER[self.code], 2, np.where(self.space, 3, 4))).astype(np.int8)
        kind[self.ends - 1] = 0
        k = np.concatenate(([0], kind, [0, 0, 0]))
        raw = np.concatenate((self.raw, [0, 0, 0]))
        at = np.arange(len(kind))
        start = (kind != k[:-4]) & (kind != 0)
        lone = start & (self.raw == 32) & (k[2:-2] != 3) & (k[2:-2] != 0)
        after = np.append(False, lone[:-1])[: len(lone)]
        start &= ~after
        mark = at[start & (self.raw == 39) & (k[2:-2] == 1)]
        one, two = raw[mark + 1], raw[mark + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        mark, size = mark[short | long], np.where(short, 1, 2)[short | long]
        start[mark + 1] = False
        rest = mark + size + 1
        start[rest[k[rest + 1] == 1]] = True
        start = np.flatnonzero(start)
        ahead = np.append(0, np.cumsum(self.body))[np.append(start, len(kind))]
        return self.per_text(start), strings(self.raw[self.body], np.diff(ahead))


def scan(texts: pa.Array) -> Scan:
    """Of plain texts."""
    return Plain(texts).scan


def listed(split: pa.Array) -> Scan:
    each = split.flatten()
    ws = pc.struct_field(each, "ws")
    number = lambda c: pc.struct_field(each, c).to_numpy(zero_copy_only=False).astype(np.int64)
    return Scan(pc.list_value_length(split).to_numpy().astype(np.int64), pc.list_value_length(ws).to_numpy().astype(np.int64), number("chars"), number("spaced"), ws.flatten())


def runs(text: pa.Array) -> Iterator[tuple[pa.Array, Plain]]:
    """Rows of plain texts and what they hold, in runs of about PIECE characters."""
    rows = np.flatnonzero(text.is_valid().to_numpy(zero_copy_only=False))
    size, a = np.cumsum(pc.utf8_length(text).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[rows]), 0
    while a < len(rows):
        e = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + PIECE, "right")))
        own = pa.array(rows[a:e])
        yield own, Plain(text.take(own))
        a = e


def others(text: pa.Array) -> pa.Array:
    """Rows of other texts."""
    return pa.array(np.flatnonzero(~text.is_valid().to_numpy(zero_copy_only=False)))


def scans(text: pa.Array, split: pa.Array) -> Iterator[tuple[pa.Array, Scan]]:
    """Rows of columns() and what they hold, each row once."""
    for own, plain in runs(text):
        yield own, plain.scan
    own = others(text)
    if len(own):
        yield own, listed(split.take(own))
