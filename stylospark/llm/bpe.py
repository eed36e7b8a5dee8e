"""Byte-level BPE by forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no vocabulary token can't lie
inside any token of an encoding, so every such pair is a certain cut: the
fragments between cuts are encoded independently, each once per worker while it
stays in a bounded cache, and the results are concatenated.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import expand

# The public pre-tokenizer pattern of byte-level BPE.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: A unit is a run of ASCII white space and what follows up to the next; no piece crosses from one to the next.
UNITS = re.compile(r"[ \t\n\x0b\x0c\r]*[^ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+")
#: White space beyond ASCII may join pieces across units.
WIDE = regex.compile(r"[\p{White_Space}--[ \t\n\x0b\x0c\r]]", regex.V1)
#: Units kept by a worker before it starts anew.
CACHE = 500_000
NONE = np.int64(1 << 40)


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ForcedBpe:
    """Encoder and decoder of a byte-level BPE file of the tokenizers library,
    as encode(text, add_special_tokens=False) and decode(skip_special_tokens=
    False) give them. The strings of added tokens in a text become their ids."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        assert spec["model"]["type"] == "BPE" and not spec.get("normalizer"), "a byte-level BPE file is needed"
        back = {c: b for b, c in byte_chars().items()}
        self.bytes: dict[int, bytes] = {}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.ids: dict[bytes, int] = {}
        for token, i in spec["model"]["vocab"].items():
            raw = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
            self.bytes[i] = raw
            if token not in self.added:
                self.ids[raw] = i
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for k, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[bytes(back[c] for c in a), bytes(back[c] for c in b)] = k
        inside = np.zeros((256, 256), bool)
        for token in self.ids:
            for x, y in zip(token, token[1:]):
                inside[x, y] = True
        self.inside = inside
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.size = max(self.bytes) + 1
        self.byte_id = np.array([self.ids.get(bytes([b]), -1) for b in range(256)], np.int64)
        pairs = {self.ids[a] * self.size + self.ids[b]: (k, self.ids[a + b]) for (a, b), k in self.rank.items()}
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k][0] for k in sorted(pairs)], np.int64)
        self.merged = np.zeros(len(self.rank), np.int64)
        self.merged[self.pair_rank] = [pairs[k][1] for k in sorted(pairs)]
        self.start()

    def start(self) -> None:
        """An empty cache: the ids of unit u are flat[at[u]:at[u] + count[u]]."""
        self.slot: dict[str, int] = {}
        self.flat, self.at, self.count = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.used = 0

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of ids; NONE if they don't merge."""
        key = left * self.size + right
        i = np.searchsorted(self.pair_keys, key)
        i[i == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[i] == key, self.pair_rank[i], NONE)

    def fragments(self, data: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Starts of the fragments of pieces that start at `start` in data: the
        pieces' own starts and every forced boundary."""
        cut = np.zeros(len(data), bool)
        cut[1:] = ~self.inside[data[:-1], data[1:]]
        cut[start] = True
        return np.flatnonzero(cut)

    def merge(self, data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all fragments in step: each round joins, in every fragment that
        isn't done, all pairs of its lowest rank from the left. Returns the ids
        and the byte at which each begins."""
        sym, pos = self.byte_id[data], np.arange(len(data))
        frag = np.zeros(len(data), np.int64)
        frag[start] = 1
        frag = np.cumsum(frag) - 1
        done_sym, done_pos = [], []
        rank = np.full(len(sym), NONE)  # of each symbol with the next of its fragment
        inner = np.flatnonzero(frag[1:] == frag[:-1])
        rank[inner] = self.ranks(sym[inner], sym[inner + 1])
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], frag[1:] != frag[:-1])))
            low = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(sym)))
            live = np.repeat(low != NONE, size)
            done_sym.append(sym[~live]), done_pos.append(pos[~live])
            sym, pos, frag, rank = sym[live], pos[live], frag[live], rank[live]
            if not len(sym):
                break
            hit = rank == np.repeat(low[low != NONE], size[low != NONE])
            at = np.flatnonzero(hit)
            # a pair overlapping the one before it, as in aaa, waits: of a run of hits every second one counts
            run = np.concatenate(([True], at[1:] != at[:-1] + 1))
            begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
            sym[at] = self.merged[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            rank[at] = NONE
            new = np.cumsum(keep) - 1
            sym, pos, frag, rank = sym[keep], pos[keep], frag[keep], rank[keep]
            at = new[at]
            near = np.zeros(len(sym) + 1, bool)
            near[at] = near[at - 1] = True  # at[0] = 0 marks the spare last place
            touch = np.flatnonzero(near[: len(sym) - 1])
            same = frag[touch] == frag[touch + 1]
            rank[touch] = NONE
            touch = touch[same]
            rank[touch] = self.ranks(sym[touch], sym[touch + 1])
        sym, pos = np.concatenate(done_sym or [sym]), np.concatenate(done_pos or [pos])
        order = np.argsort(pos, kind="stable")
        return sym[order], pos[order]

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the units and the number of ids of each."""
        pieces, ends = [], []
        for u in units:
            if u[0] == " " and u[1:].isalpha():  # one piece by the pattern
                pieces.append(u)
            elif u[0] == " " and u[-1] in ".,!|" and u[1:-1].isalpha():
                pieces += (u[:-1], u[-1])
            else:
                pieces += PIECES.findall(u)
            ends.append(len(pieces))
        pieces = [p.encode() for p in pieces]
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(units), np.int64)
        ids, pos = self.merge(data, self.fragments(data, np.cumsum(size) - size))
        ends = np.concatenate(([0], np.cumsum(size)))[ends]
        return ids, np.diff(np.searchsorted(pos, ends, side="left"), prepend=0)

    def learn(self, units: list[str]) -> None:
        """Put the units into the cache."""
        ids, n = self.encode_units(units)
        at = self.used + np.cumsum(n) - n
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while len(self.slot) + len(units) > len(self.at):
            self.at, self.count = np.concatenate((self.at, np.zeros_like(self.at))), np.concatenate((self.count, np.zeros_like(self.count)))
        k = len(self.slot)
        self.flat[self.used : self.used + len(ids)] = ids
        self.at[k : k + len(n)], self.count[k : k + len(n)] = at, n
        self.used += len(ids)
        self.slot.update(zip(units, range(k, k + len(units))))

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts and the offset at which each text's ids begin."""
        if len(self.slot) > CACHE or self.used > 8 * CACHE:
            self.start()
        units: list[list[str | int]] = []  # an added token stands as its id
        marked = [bool(self.added) and any(a in t for a in self.added) for t in texts]
        for t, m in zip(texts, marked):
            own: list[str | int] = []
            for k, piece in enumerate(self.split.split(t) if m else [t]):
                if k % 2:
                    own.append(self.added[piece])
                elif not piece.isascii() and WIDE.search(piece):
                    own.append(piece)
                else:
                    own += UNITS.findall(piece)
            units.append(own)
        new = set().union(*units).difference(self.slot)
        if any(marked):
            new = {u for u in new if u.__class__ is str}
        if new:
            self.learn(list(new))
        out, ends = [], np.zeros(len(texts) + 1, np.int64)
        get = self.slot.get
        for i, (own, m) in enumerate(zip(units, marked)):
            k = np.fromiter([get(u) if u.__class__ is str else -1 - u for u in own] if m else map(get, own), np.int64, len(own))
            if m:
                n = np.where(k < 0, 1, self.count[np.maximum(k, 0)])
                ids = self.flat[expand(np.where(k < 0, 0, self.at[np.maximum(k, 0)]), n)]
                ids[(np.cumsum(n) - n)[k < 0]] = -1 - k[k < 0]
            else:
                ids = self.flat[expand(self.at[k], self.count[k])]
            out.append(ids)
            ends[i + 1] = ends[i] + len(ids)
        return (np.concatenate(out) if out else np.zeros(0, np.int32)).astype(np.int32), ends

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]

    def decode(self, ids) -> str:
        """Unknown ids give nothing; bytes that are no UTF-8 give U+FFFD."""
        return b"".join([self.bytes.get(i, b"") for i in ids]).decode("utf-8", "replace")


_MADE: dict[str, ForcedBpe] = {}


def coder(path: str) -> ForcedBpe:
    """One coder per worker and file."""
    if path not in _MADE:
        _MADE[path] = ForcedBpe(path)
    return _MADE[path]


def encode(text: Column, path: str) -> Column:
    """array<int> of token ids of a text column; a null text is empty and gives
    no ids. path: the tokenizer's JSON file, there on every executor."""

    @F.arrow_udf("array<int>")
    def run(col: pa.Array) -> pa.Array:
        c, flat, ends = coder(path), [], [np.zeros(1, np.int64)]
        texts = col.to_pylist()
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < 1 << 20):
                size += len(texts[end] or "")
                end += 1
            ids, e = c.encode_batch([t or "" for t in texts[at:end]])
            flat.append(ids), ends.append(e[1:] + ends[-1][-1])
            at = end
        return pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32)))

    return run(text)


def decode(ids: Column, path: str) -> Column:
    """The text of an array<int> column of token ids; null ids are empty."""

    @F.arrow_udf("string")
    def run(col: pa.Array) -> pa.Array:
        c = coder(path)
        return pa.array([c.decode(v) for v in (x.values.to_numpy().tolist() if x.is_valid else [] for x in col)], pa.string())

    return run(ids)
