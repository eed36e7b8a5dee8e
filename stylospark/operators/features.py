"""Features that a document has by itself, computed in its row: no shuffle.

Arrays are made once per row and counted by a sort and the ends of its runs, so
the work is linear in the text but for that sort. Only what the language model of
the corpus gives (perplexity, stability) needs joins; see metrics.py. The SQL of
the same features over exploded tables, also there, is what tests compare with.
`keep` names columns of docs that pass through."""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat
from operator import contains
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import small_batches
from . import parses, scan


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, also where f uses it within a lambda."""
    return F.element_at(F.transform(F.array(x), f), 1)


def total(a: Column, kind: str = "double") -> Column:
    return F.aggregate(a, F.lit(0).cast(kind), lambda s, x: s + x.cast(kind))


def tally(a: Column) -> Column:
    """How often each distinct element of an array occurs."""

    def counts(s: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == F.size(s)) | (F.get(s, i - 1) != F.get(s, i)))
        return let(ends, lambda e: F.transform(e, lambda x, j: x - F.when(j > 0, F.get(e, j - 1)).otherwise(0)))

    return F.when(F.size(a) > 0, let(F.sort_array(a), counts)).otherwise(F.array().cast("array<int>"))


def entropy(counts: Column) -> Column:
    """Shannon entropy in bits of an array of counts; 0 of an empty one."""
    n = total(counts)
    return F.when(F.size(counts) > 0, F.log2(n) - F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * F.log2(c.cast("double"))) / n).otherwise(0.0)


def letters(t: Column) -> Column:
    """How often each distinct character of a string occurs."""
    own = F.filter(F.array_distinct(F.split(t, "")), lambda c: c != "")
    return F.transform(own, lambda c: F.length(t) - F.length(F.replace(t, c, F.lit(""))))


def spread(n: Column, s: Column, squares: Column) -> Column:
    """Population standard deviation of n integers from their sum and squares."""
    return F.try_divide(F.sqrt((n * squares - s * s).cast("double")), n)


def near(x: Column, digits: int) -> Column:
    return F.round(x + 1.0e-9, digits)


def _text(docs: DataFrame) -> Column:
    return F.coalesce("text", F.lit(""))


def _kinds(x: np.ndarray) -> np.ndarray:
    """The different ones, in order."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])[: len(x)]]


_STRUCTURE = ("n", "m", "s1", "s2", "w1", "w2", "syl", "vocab", "kinds2", "kinds3", "rep")


def _structure(size: np.ndarray, words: pa.Array, sents: np.ndarray, spaced: np.ndarray) -> list[np.ndarray]:
    """The columns _STRUCTURE of texts of `size` words, and of `sents` sentences of `spaced` words between white space."""
    d = len(size)
    total = lambda of, x: np.rint(np.bincount(of, x, d)).astype(np.int64)
    e = pc.dictionary_encode(words)
    v, code, doc = max(1, len(e.dictionary)), e.indices.to_numpy().astype(np.int64), np.repeat(np.arange(d), size)
    long = pc.utf8_length(e.dictionary).to_numpy().astype(np.int64)[code]
    vowels = pc.count_substring_regex(e.dictionary, "[aeiouy]+").to_numpy().astype(np.int64) - pc.ends_with(e.dictionary, "e").to_numpy(zero_copy_only=False)
    syllables = np.maximum(1, vowels)[code]
    # different words, pairs and triples of each text, numbered in turn
    kind, word = np.unique(doc * v + code, return_inverse=True)
    own = kind // v
    vocab, next_ = np.bincount(own, minlength=d), np.flatnonzero(doc[:-1] == doc[1:])
    kind, pair = np.unique(word[next_] * v + code[next_ + 1], return_inverse=True)
    own = own[kind // v]
    kinds2, third = np.bincount(own, minlength=d), np.flatnonzero(next_[:-1] + 1 == next_[1:])
    kinds3 = np.bincount(own[_kinds(pair[third] * v + code[next_[third] + 2]) // v], minlength=d)
    # in how many windows of ten words that hold a word it repeats one before it
    order = np.argsort(word, kind="stable")
    at = (np.arange(len(doc)) - (np.cumsum(size) - size)[doc])[order]
    same = np.append(False, word[order][1:] == word[order][:-1])[: len(order)]
    q = np.where(same, np.append(0, at[:-1])[: len(at)], -10)
    r = np.where(same & np.append([False, False], same[1:-1])[: len(at)], np.append([0, 0], at[:-2])[: len(at)], -1) if len(at) > 1 else np.full(len(at), -1)
    rep = np.where(at - q <= 9, np.maximum(0, np.minimum(q, size[doc[order]] - 11) - np.maximum(r + 1, at - 9) + 1), 0)
    s = np.repeat(np.arange(d), sents)
    return [size, sents, total(s, spaced), total(s, spaced**2), total(doc, long), total(doc, long**2), total(doc, syllables), vocab, kinds2, kinds3, total(doc[order], rep)]


def structural(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    a = _own(docs, "structural", keep)
    n, m = F.col("n"), F.col("m")
    a = a.withColumns({"smu": F.try_divide("s1", m), "ssd": spread(m, F.col("s1"), F.col("s2")), "wmu": F.try_divide("w1", n), "wsd": spread(n, F.col("w1"), F.col("w2"))})
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    cv = F.try_divide("ssd", "smu")
    return a.select(
        "doc_id", *keep, near(zero(F.col("smu")), 2).alias("avg_sentence_length"), near(zero(F.col("ssd")), 2).alias("std_sentence_length"), near(zero(F.col("wmu")), 2).alias("avg_word_length"), near(zero(F.col("wsd")), 2).alias("std_word_length"),
        F.col("vocab").alias("vocabulary_size"), F.round(zero(F.try_divide("vocab", n)), 4).alias("type_token_ratio"), F.round(zero(F.try_divide("n_punct", "n_chars")), 4).alias("punctuation_density"), F.round(zero(F.try_divide("n_comma", n)), 4).alias("comma_frequency"),
        F.round(F.when((m >= 2) & (F.col("smu") > 0), F.least(F.lit(1.0), cv / 2)).otherwise(0.0), 4).alias("burstiness_score"), F.round(F.when(F.col("smu") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - cv))).otherwise(0.0), 4).alias("length_uniformity"),
        F.round(F.when((m > 0) & (n > 0), F.greatest(F.lit(0.0), F.least(F.lit(100.0), 206.835 - 1.015 * F.try_divide(n, m) - 84.6 * F.try_divide("syl", n)))).otherwise(0.0), 2).alias("readability_score"),
        F.round(F.when(n > 10, F.col("rep") / ((n - 10) * 10)).otherwise(0.0), 4).alias("repetition_score"), F.round(F.when(n >= 2, F.col("kinds2") / (n - 1)).otherwise(0.0), 4).alias("bigram_diversity"), F.round(F.when(n >= 3, F.col("kinds3") / (n - 2)).otherwise(0.0), 4).alias("trigram_diversity"),
        m.alias("num_sentences"), n.alias("num_words"),
    )


def _tallied(group: np.ndarray, code: np.ndarray, kinds: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of n groups, whose members have codes under `kinds`: size, number of different codes and entropy in bits."""
    if n * kinds <= 8 * len(code) + 1024:
        count = np.bincount(group * kinds + code, minlength=n * kinds)
        at = np.flatnonzero(count)
        count, of = count[at], at // max(1, kinds)
    else:
        key, count = np.unique(group * kinds + code, return_counts=True)
        of = key // max(1, kinds)
    size = np.bincount(group, minlength=n)
    bits = np.log2(np.maximum(size, 1)) - np.bincount(of, count * np.log2(count), n) / np.maximum(size, 1)
    return size, np.bincount(of, minlength=n), np.where(size > 0, bits, 0.0)


def _coded(words: pa.Array) -> tuple[np.ndarray, int]:
    d = pc.dictionary_encode(words)
    return d.indices.to_numpy().astype(np.int64), len(d.dictionary)


_ENTROPIES = ("char_h", "word_h", "tok_h", "div", "seq", "mu", "var")


def _entropies(chars: np.ndarray, cp: np.ndarray, many: np.ndarray, spaced: pa.Array, wide: pa.Array | None, n: np.ndarray, tokens: pa.Array) -> list[np.ndarray]:
    """The columns _ENTROPIES of texts of `chars` characters, which in lower case are the `many` of cp (0: isn't
    counted) and the words `spaced` between white space; those whose length changes in lower case; and their n tokens each."""
    d = len(chars)
    doc = np.repeat(np.arange(d), many)
    kind = np.zeros(int(cp.max(initial=0)) + 1, np.int64)
    kind[cp] = 1
    kind = (np.cumsum(kind) - 1)[cp]
    kinds, good = int(kind.max(initial=-1)) + 1, cp != 0
    char_h = _tallied(doc[good], kind[good], kinds, d)[2]
    # runs of 50 words: a chunk is one of them and the next
    ink = ~((cp == 32) | ((cp > 8) & (cp < 14)))
    start = ink & ~(np.append(False, ink[:-1]) & (doc == np.append(-1, doc[:-1])))
    word, of = np.cumsum(start) - 1, doc[start]
    nw = np.bincount(of, minlength=d)
    runs = -(-nw // 50)
    first = np.cumsum(runs) - runs
    run = first[of] + (np.arange(len(of)) - (np.cumsum(nw) - nw)[of]) // 50
    total = int(runs.sum())
    of_run = np.repeat(np.arange(d), runs)
    more = np.append(of_run[:-1] == of_run[1:], False)[:total]
    here = run[word[ink & good]]
    before = here[here > 0]
    back = more[before - 1]
    k = kind[ink & good]
    both = lambda y: y + np.where(more, np.append(y[1:], 0), 0)
    words = both(np.bincount(run, minlength=total))
    length = np.bincount(word[ink], minlength=len(of))
    for i in np.flatnonzero(wide.is_valid().to_numpy(zero_copy_only=False)) if wide is not None else ():
        length[of == i] = [len(w.decode()) for w in wide[i].as_py().encode().split()]
    space = np.repeat(np.arange(total), words - 1)
    group = np.concatenate((here, before[back] - 1, space))
    h = _tallied(group, np.concatenate((k, k[here > 0][back], np.full(len(space), kinds))), kinds + 1, total)[2]
    enough = both(np.bincount(run, length, total)) + words - 1 > 20
    h, of_h = h[enough], of_run[enough]
    nh = np.bincount(of_h, minlength=d)
    mu = np.bincount(of_h, h, d) / np.maximum(nh, 1)
    var = np.bincount(of_h, (h - mu[of_h]) ** 2, d) / np.maximum(nh, 1)
    code, v = _coded(spaced)
    word_h = np.where(nw >= 5, _tallied(of, code, v, d)[2], 0.0)
    of, (code, v) = np.repeat(np.arange(d), n), _coded(tokens)
    _, different, tok_h = _tallied(of, code, v, d)
    next_ = np.flatnonzero(of[:-1] == of[1:])
    pair, code = np.unique(code[next_] * v + code[next_ + 1], return_inverse=True)
    seq = np.where(n >= 20, np.minimum(1.0, _tallied(of[next_], code, len(pair), d)[2] / 8), 0.0)
    long = n >= 10
    return [char_h, word_h, np.where(long & (chars >= 10), tok_h, 0.0), np.where(long, different / np.maximum(n, 1), 0.0), seq, mu, var, nh]


def entropies(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    a = _own(docs, "entropy", keep)
    quarter = lambda rule: F.when(rule, 0.25).otherwise(0.0)
    return a.select(
        "doc_id", *keep, "n_chars", F.round("char_h", 4).alias("char_entropy"), F.round("word_h", 4).alias("word_entropy"), F.round("tok_h", 4).alias("token_entropy"), F.round("div", 4).alias("token_diversity"), F.round("seq", 4).alias("sequence_unpredictability"), F.round("var", 4).alias("entropy_variance"), F.round("mu", 4).alias("avg_chunk_entropy"),
        F.round(1 - F.least(F.lit(1.0), F.col("char_h") / 4), 4).alias("predictability_score"), (quarter(F.col("char_h") < 3.8) + quarter(F.col("div") < 0.7) + quarter(F.col("seq") < 0.4) + quarter(F.col("var") < 0.2)).alias("ai_pattern_score"), F.col("nh").alias("num_chunks_analyzed"),
    )


_SEMANTICS = ("coh", "var", "m1", "m2", "rep", "drift", "ctx")
#: Sentences whose similarities to all others are held at a time.
BLOCK = 256


def _gram(n: int, rows: np.ndarray, cols: np.ndarray, x: np.ndarray, many: np.ndarray) -> tuple[float, float]:
    """Of n different unit vectors of the cells (rows, in order, cols, x), which stand `many` times each: sum of
    the squares of the cosines of all i <> j and how many i < j are above 0.8; BLOCK by all are formed at a time."""
    width, first = int(cols.max(initial=0)) + 1, np.searchsorted(rows, np.arange(0, n + BLOCK, BLOCK))

    def dense(i: int) -> np.ndarray:
        own = slice(first[i], first[i + 1])
        out = np.zeros((min(BLOCK, n - i * BLOCK), width))
        out[rows[own] - i * BLOCK, cols[own]] = x[own]
        return out

    squares, like, parts = 0.0, 0.0, range(-(-n // BLOCK))
    for a in parts:
        top = dense(a)
        for b in parts[a:]:
            g = top @ (top if a == b else dense(b)).T
            if a == b:
                np.fill_diagonal(g, 0.0)
            w, v = many[a * BLOCK : (a + 1) * BLOCK], many[b * BLOCK : (b + 1) * BLOCK]
            squares += float(w @ (g * g) @ v) * (1 if a == b else 2)
            above = g > 0.8000001
            if above.any():
                like += float(w @ above @ v) / (2 if a == b else 1)
    return squares, like


def _semantics(sents: np.ndarray, sizes: np.ndarray, words: pa.Array, low: list[str], nkeys: np.ndarray, keys: pa.Array) -> list[np.ndarray]:
    """n and the columns _SEMANTICS of texts of `sents` sentences of `sizes` words, which in lower case are `low`, and of
    nkeys words: cosines of sentences' words, of each with the next, of all, and of the first and last k = min(3, n / 3).
    Equal sentences count once, as often as they stand. Words of one sentence alone don't meet another's."""
    d, k, n = len(sents), len(sizes), sents
    of, sent, before = np.repeat(np.arange(d), n), np.repeat(np.arange(k), sizes), np.cumsum(n) - n
    code, v = _coded(words)
    v = max(1, v)
    cell, count = np.unique(sent * v + code, return_counts=True)
    r, c = cell // v, cell % v
    x = count / np.sqrt(np.bincount(r, count.astype(float) ** 2, k))[r]
    doc, at, place = of[r], np.searchsorted(cell, cell + v), np.arange(k) - before[of]
    met = np.flatnonzero((np.append(cell, -1)[at] == cell + v) & (place[r] + 1 < n[doc]))
    near_, shared = np.bincount(r[met], x[met] * x[at[met]], k), np.flatnonzero(np.bincount(r[met], minlength=k))
    ten, run = np.unique(of[shared] * (k + 1) + place[shared] // 10, return_inverse=True)
    blocks, owner = np.bincount(run, near_[shared]) / 10, ten // (k + 1)
    many = np.maximum(np.bincount(owner, minlength=d), 1)
    var = np.bincount(owner, (blocks - (np.bincount(owner, blocks, d) / many)[owner]) ** 2, d) / many
    # of each text its different words
    own, word = np.unique(doc * v + c, return_inverse=True)
    sums, few = np.bincount(word, x, len(own)), np.minimum(3, n // 3)
    head, tail = (np.bincount(word[m], x[m], len(own)) for m in (place[r] < few[doc], place[r] >= (n - few)[doc]))
    by = lambda y: np.bincount(own // v, y, d)
    # different sentences, and the words that several of them have
    first = np.searchsorted(r, np.arange(k + 1))
    kind, lead, times = np.unique(of * (k + 1) + parses.different(cell % v * (1 << 31) + count, first[:-1]), return_index=True, return_counts=True)
    full = first[lead] < first[lead + 1]
    lead, times = lead[full], times[full].astype(float)
    order = np.full(k, -1)
    order[lead] = np.arange(len(lead))
    used = order[r] >= 0
    several = np.bincount(word[used], minlength=len(own)) > 1
    used &= several[word]
    new = np.cumsum(several) - 1
    row, col, y = order[r[used]], new[word[used]], x[used]
    sort = np.argsort(row, kind="stable")
    row, col, y = row[sort], col[sort], y[sort]
    lead_of = of[lead]
    squares, like = np.bincount(lead_of, times**2, d), np.bincount(lead_of, times * (times - 1) / 2, d) - np.bincount(of[near_ > 0.8000001], minlength=d)
    ends = np.searchsorted(lead_of, np.arange(d + 1))
    cells, cols = np.searchsorted(row, ends), np.append(0, np.cumsum(several))[np.searchsorted(own, np.arange(d + 1) * v)]
    for i in np.flatnonzero((n > 2) & (np.diff(cells) > 0)):
        s = slice(cells[i], cells[i + 1])
        more = _gram(ends[i + 1] - ends[i], row[s] - ends[i], col[s] - cols[i], y[s], times[ends[i] : ends[i + 1]])
        squares[i], like[i] = squares[i] + more[0], like[i] + more[1]
    with np.errstate(all="ignore"):
        total = lambda y: y / (n * (n - 1.0))
        out = [np.bincount(of, near_, d) / (n - 1), var, total(by(sums**2) - n), total(squares - n), like / ((n - 1.0) * (n - 2.0) / 2), by(head * tail) / few**2, _contexts(n, low, nkeys, keys)]
    return [n, *[np.where(n < 3, np.nan, v) for v in out]]


def _contexts(sents: np.ndarray, low: list[str], nkeys: np.ndarray, keys: pa.Array) -> np.ndarray:
    """context() of many texts."""
    e = pc.dictionary_encode(keys)
    v, code, words = max(1, len(e.dictionary)), e.indices.to_numpy().astype(np.int64), e.dictionary.to_pylist()
    good = pc.match_substring_regex(e.dictionary, r"\A[a-z]{4,}\z").to_numpy(zero_copy_only=False).astype(bool)[code]
    kind, first, count = np.unique(np.repeat(np.arange(len(sents)), nkeys)[good] * v + code[good], return_index=True, return_counts=True)
    more = count > 1
    kind, first, count = kind[more], first[more], count[more]
    order = np.lexsort((first, -count, kind // v))
    of, word = (kind // v)[order], (kind % v)[order]
    ends, at, out = np.append(0, np.cumsum(sents)).tolist(), np.searchsorted(of, np.arange(len(sents) + 1)), np.zeros(len(sents))
    for i in np.flatnonzero((sents > 2) & (np.diff(at) > 0)):
        own, best = low[ends[i] : ends[i + 1]], word[at[i] : min(at[i] + 10, at[i + 1])]
        out[i] = sum(sum(map(contains, own, repeat(words[w]))) / len(own) for w in best) / len(best)
    return out


def context(keys: list[str], low: list[str]) -> float:
    """Mean share of the sentences that hold a keyword, of the ten most frequent ones used twice at least."""
    order = {w: i for i, w in reversed(list(enumerate(keys)))}
    count: dict[str, int] = {}
    for w in keys:
        count[w] = count.get(w, 0) + 1
    best = sorted((w for w in count if count[w] > 1), key=lambda w: (-count[w], order[w]))[:10]
    return sum(sum(w in s for s in low) / len(low) for w in best) / len(best) if best else 0.0


def semantic(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return semantic_scores(_own(docs, "semantic", keep), keep)


def semantic_schema(docs: DataFrame, keep: tuple[str, ...] = ()) -> str:
    kind, kept = docs.schema["doc_id"].dataType.simpleString(), "".join(f", {k} {docs.schema[k].dataType.simpleString()}" for k in keep)
    return f"doc_id {kind}, n_chars int, n long, coh double, var double, m1 double, m2 double, rep double, drift double, ctx double" + kept


def semantic_scores(f: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The features of sentence similarities from rows of semantic_schema."""
    few = F.col("n") < 3
    return f.select(
        "doc_id", *keep, "n_chars", near(F.when(few, 0.5).otherwise(F.col("coh")), 4).alias("coherence_score"), near(F.when(few, 0.5).otherwise(1 - F.least(F.lit(1.0), 5 * F.greatest(F.lit(0.0), F.col("m2") - F.col("m1") * F.col("m1")))), 4).alias("consistency_score"),
        near(F.when(F.col("n") < 5, 0.0).otherwise(F.least(F.lit(1.0), 3 * F.col("rep"))), 4).alias("repetition_score"), near(F.when(few, 0.5).otherwise(F.greatest(F.lit(0.0), 1 - F.col("drift"))), 4).alias("topic_drift_score"),
        near(F.when(few, 0.5).otherwise(F.col("ctx")), 4).alias("contextual_consistency"), near(F.when(few, 0.1).otherwise(F.col("var")), 4).alias("coherence_variance"), F.when(few, 0).otherwise(F.col("n")).cast("long").alias("num_sentences"),
    )


class Part(NamedTuple):
    """What is counted for a metric: names and types; of plain texts; of other texts by what expressions make in their row."""

    made: dict[str, str]
    plain: Callable[[scan.Plain], list[np.ndarray]]
    split: Callable[[Column], list[Column]]
    other: Callable[..., list[np.ndarray]]


_long = lambda a: pc.list_value_length(a).to_numpy().astype(np.int64)


def _plain_structure(x: scan.Plain) -> list[np.ndarray]:
    s = x.scan
    ends = np.append(0, np.cumsum(s.sizes))[np.append(0, np.cumsum(s.sents))]
    return [*_structure(np.diff(ends), s.words, s.sents, s.spaced), *x.marks()]


def _other_structure(n: np.ndarray, split: pa.Array, ws: pa.Array, *marks: pa.Array) -> list[np.ndarray]:
    s = scan.listed(split)
    return [*_structure(_long(ws), ws.flatten(), s.sents, s.spaced), *[m.to_numpy() for m in marks]]


def _plain_entropies(x: scan.Plain) -> list[np.ndarray]:
    return _entropies(x.size, x.marked(), x.size, x.spaced()[1], None, *x.pretokens())


def _other_entropies(n: np.ndarray, low: pa.Array, marked: pa.Array, wide: pa.Array, tokens: pa.Array) -> list[np.ndarray]:
    cp = np.frombuffer("".join(marked.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    words = pa.array([w for t in low.to_pylist() for w in t.encode().split()], pa.binary())
    return _entropies(n, cp, pc.utf8_length(marked).to_numpy(), words, wide, _long(tokens), tokens.flatten())


def _plain_semantics(x: scan.Plain) -> list[np.ndarray]:
    s = x.scan
    long, of = s.chars > 10, np.repeat(np.arange(x.n), s.sents)
    words = s.words.filter(pa.array(np.repeat(long, s.sizes)))
    low = x.lower_sentences()
    return _semantics(np.bincount(of[long], minlength=x.n), s.sizes[long], words, [low[i] for i in np.flatnonzero(long)], np.rint(np.bincount(of, s.sizes, x.n)).astype(np.int64), s.words)


def _other_semantics(n: np.ndarray, words: pa.Array, low: pa.Array, keys: pa.Array) -> list[np.ndarray]:
    return _semantics(_long(low), _long(words.flatten()), words.flatten().flatten(), low.flatten().to_pylist(), _long(keys), keys.flatten())


def _sentences(t: Column) -> Column:
    return T.sentences(t, 10)


_PARTS = {
    "structural": Part(dict.fromkeys((*_STRUCTURE, "n_punct", "n_comma"), "long"), _plain_structure, lambda t: [scan.split(t), T.lower_words(t), F.regexp_count(t, F.lit(r"[^\p{L}\p{N}_\s]")), F.length(t) - F.length(F.replace(t, F.lit(","), F.lit("")))], _other_structure),
    "entropy": Part(dict.fromkeys(_ENTROPIES, "double") | {"nh": "long"}, _plain_entropies, lambda t: [F.lower(t), F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}\s]", "\0"), F.when(t.contains("İ"), t), T.pretokens(t)], _other_entropies),
    "linguistic": Part({f: "long" if f.startswith("num") else "double" for f in parses.FEATURES}, lambda x: parses.counted(x.scan.sents, *x.parsed()), lambda t: [parses.sentences(t)], lambda n, ss: parses.counted(_long(ss), _long(ss.flatten()), ss.flatten().flatten())),
    "semantic": Part({"n": "long"} | dict.fromkeys(_SEMANTICS, "double"), _plain_semantics, lambda t: [F.transform(_sentences(t), T.lower_words), F.transform(_sentences(t), F.lower), T.keywords(t)], _other_semantics),
}


def counted(docs: DataFrame, names: tuple[str, ...], keep: tuple[str, ...] = (), more: dict[str, Part] | None = None) -> DataFrame:
    """doc_id, keep, _chars and _name_column of each of the named parts and of `more`: what the features of each document
    are made of, all in one scan of its text, which of plain texts is all that leaves the JVM."""
    parts = {p: _PARTS[p] for p in names} | (more or {})
    columns = [(f"_{p}_{c}", k) for p, x in parts.items() for c, k in x.made.items()]
    t, kind = _text(docs), docs.schema["doc_id"].dataType.simpleString()

    def rows(batches):
        typed = [pa.int64() if k == "long" else pa.float64() for _, k in columns]
        for b in batches:
            n = b.column(2).to_numpy().astype(np.int64)

            def row(own: pa.Array, out: list[np.ndarray]) -> pa.RecordBatch:
                x = b.take(own)  # noqa: B023
                made = [pa.array(v, k, from_pandas=True) for v, k in zip(out, typed)]
                return pa.RecordBatch.from_arrays([x.column(0), *x.columns[3 + len(parts) :], x.column(2), *made], names=["doc_id", *keep, "_chars", *[c for c, _ in columns]])

            for own, x in scan.runs(b.column(1)):
                yield row(own, [v for p in parts.values() for v in p.plain(x)])
            rest = scan.others(b.column(1)).to_numpy()
            size, a = np.cumsum(n[rest]), 0
            while a < len(rest):
                e = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + scan.PIECE, "right")))
                own = pa.array(rest[a:e])
                split = [b.column(3 + i).take(own) for i in range(len(parts))]
                yield row(own, [v for p, x in zip(parts.values(), split) for v in p.other(n[rest[a:e]], *x.flatten())])
                a = e

    small_batches(docs.sparkSession)
    other = [F.when(scan.other(t), F.struct(*[c.alias(f"c{i}") for i, c in enumerate(x.split(t))])).alias(f"_{p}") for p, x in parts.items()]
    kept = "".join(f", {k} {docs.schema[k].dataType.simpleString()}" for k in keep)
    made = "".join(f", {c} {k}" for c, k in columns)
    return docs.select("doc_id", F.when(~scan.other(t), t).alias("plain"), F.length(t).alias("_n_"), *other, *keep).mapInArrow(rows, f"doc_id {kind}{kept}, _chars int{made}")


def _own(docs: DataFrame, part: str, keep: tuple[str, ...]) -> DataFrame:
    """doc_id, keep, n_chars and what is counted for a metric, from the text if docs hasn't got it."""
    a = docs if "_chars" in docs.columns else counted(docs, (part,), keep)
    return a.select("doc_id", *keep, F.col("_chars").alias("n_chars"), *[F.col(f"_{part}_{c}").alias(c) for c in _PARTS[part].made])


def linguistic(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return parses.rounded(_own(docs, "linguistic", keep), "doc_id", *keep, "n_chars")
