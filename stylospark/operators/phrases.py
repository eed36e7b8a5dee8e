"""Phrases of a user's table in texts: one automaton over all of them, built once a
worker and run over Arrow batches, so a text is read once whatever the table holds."""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A table of more phrases is refused: it is sent to every worker.
MOST = 100_000
PHRASE, OTHER = 3, 2
_SPLIT, _SPACE = re.compile(r"[.!?]+"), " \t\n\r\x0b\x0c"


class Fingerprints:
    """Share of a generator's phrases (weight 3), patterns (2) and openings of
    sentences (2, one a sentence) that a lower-case text has, doubled, at most 1."""

    def __init__(self, rows: list[tuple[str, str, str]]):
        self.models = sorted({m for m, _, _ in rows})
        at = {m: i for i, m in enumerate(self.models)}
        self.checks = [sum(1 for m, k, _ in rows if m == own and k != "starter") for own in self.models]
        self.starters = [tuple(p for m, k, p in rows if m == own and k == "starter") for own in self.models]
        self.openings = tuple(p for own in self.starters for p in own)
        self.gains: dict[str, list[tuple[int, int]]] = {}
        for m, k, p in rows:
            if k != "starter" and p:
                self.gains.setdefault(p, []).append((at[m], PHRASE if k == "phrase" else OTHER))
        self.found = ahocorasick.Automaton()
        for p in self.gains:
            self.found.add_word(p, p)
        if self.gains:
            self.found.make_automaton()

    def scores(self, text: str) -> list[float]:
        hits = [0] * len(self.models)
        for p in {p for _, p in self.found.iter(text)} if self.gains else ():
            for i, gain in self.gains[p]:
                hits[i] += gain
        pieces = _SPLIT.split(text)
        for s in pieces:
            s = s.strip(_SPACE)
            for i, own in enumerate(self.starters) if s.startswith(self.openings) else ():
                if own and s.startswith(own):
                    hits[i] += OTHER
        checks = [c + (len(pieces) if own else 0) for c, own in zip(self.checks, self.starters)]
        return [min(1.0, h / (c * 0.5)) if c else 0.0 for h, c in zip(hits, checks)]


def checked(table: DataFrame) -> list[tuple[str, str, str]]:
    """The rows of a phrase table (model, kind: phrase, starter or pattern, phrase)."""
    rows = [tuple(r) for r in table.select("model", "kind", F.lower("phrase")).where("model is not null and phrase is not null").limit(MOST + 1).collect()]
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} phrases")
    return rows
