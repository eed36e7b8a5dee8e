"""Dependency features from a table of parses, and a rule-based parser that makes one.

A parse is a row a token: doc_id, sent_idx, tok_idx, text, lemma, pos, dep, head_idx
(place of the head in the sentence, a root's own), is_punct, np_id (noun phrase of
the sentence, or null). parse() makes such rows of documents by closed classes,
suffixes and the nearest verb, noun or preposition; a table of a real parser's rows
has the same features by from_table().

Work is on flat arrays of many sentences. Subtree heights come by pointer jumping:
each round doubles how far up a token looks, and takes the heights found so far
along, so a sentence of n tokens takes log2(n) rounds whatever its shape. Heads that
are null, out of range or on a cycle count as roots. The features of many documents are
counted at a time, on such arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import tokens
from .language_metrics import BE, CLASSES, OVERUSED, SUFFIXES, TRANSITIONS

SCHEMA = "doc_id long, sent_idx int, tok_idx int, text string, lemma string, pos string, dep string, head_idx int, is_punct boolean, np_id int"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
TAGS = ["PUNCT", *(name for name, _ in CLASSES), *(name for name, _ in SUFFIXES), "NUM", "NOUN"]
_WORDS = {w: name for name, words in reversed(CLASSES) for w in words.split()}
_ENDS = [(tuple(ends.split()), name) for name, ends in SUFFIXES]
_PUNCT = regex.compile(r"[^\p{L}\p{N}_]")
BLOCK = 500_000


def tag(w: str) -> str:
    """Part of speech of a lower-case token: punctuation, closed class, suffix, number, else noun."""
    if _PUNCT.match(w):
        return "PUNCT"
    return _WORDS.get(w) or next((name for ends, name in _ENDS if w.endswith(ends)), "NUM" if "0" <= w < ":" else "NOUN")


def _before(mask: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The nearest marked place before each in its sentence, or -1."""
    at = np.maximum.accumulate(np.where(mask, np.arange(len(mask)), -1))
    at = np.concatenate(([-1], at[:-1]))
    return np.where(at >= start, at, -1)


def _after(mask: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(mask)
    at = np.minimum.accumulate(np.where(mask, np.arange(n), n)[::-1])[::-1]
    at = np.concatenate((at[1:], [n]))
    return np.where(at < end, at, -1)


#: Relations that attach() gives.
DEPS = ["dep", "ROOT", "det", "amod", "nummod", "prep", "cc", "advmod", "mark", "punct", "pobj", "attr", "dobj", "nsubj", "nsubjpass", "aux", "conj"]
_DEP = {name: i for i, name in enumerate(DEPS)}
_BE = frozenset(BE.split())


def attach(tags: np.ndarray, be: np.ndarray, ed: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(head, dep, np_id) of the tokens of several sentences, which begin and end at
    start and end (by token); tags and deps are places in TAGS and DEPS, be and ed say which
    lemmas are forms of be or end so. A sentence's root is its first verb, else its first
    word. Determiners, adjectives and numbers go to the next noun, prepositions and
    conjunctions to the last noun or verb; a noun is the object of a preposition
    after the last verb, else of that verb, else the subject; later verbs go to the
    verb before."""
    i = np.arange(len(tags))
    table = np.zeros((len(TAGS),), bool)

    def is_(*names):
        own = table.copy()
        own[[TAGS.index(name) for name in names]] = True
        return own[tags]

    verb, noun, prep, t_aux = is_("VERB", "AUX"), is_("NOUN", "PRON"), is_("ADP"), is_("AUX")
    first = np.flatnonzero(np.diff(np.concatenate(([-1], start))))
    sent = np.cumsum(np.bincount(first, minlength=len(i))) - 1

    def lead(mask):  # the first marked place of each token's sentence, or -1
        out = np.full(len(first), -1)
        at = np.flatnonzero(mask)[::-1]
        out[sent[at]] = at
        return out[sent]

    fv, fw = lead(verb), lead(~is_("PUNCT"))
    root = np.where(fv >= 0, fv, np.where(fw >= 0, fw, start))
    be = be & verb
    second = _after(verb, end)[np.maximum(fv, 0)]
    passive = (fv >= 0) & be[np.maximum(fv, 0)] & (second >= 0) & ed[np.maximum(second, 0)]
    lv, lp, lc, nn = _before(verb, start), _before(prep, start), _before(verb | noun, start), _after(noun, end)
    of_prep, of_verb = noun & (lp > lv), noun & (lp <= lv) & (lv >= 0)
    head, dep = root.copy(), np.full(len(i), _DEP["dep"], np.int8)

    def give(mask, to, name):
        head[mask] = np.where(to[mask] >= 0, to[mask], root[mask])
        dep[mask] = name[mask] if isinstance(name, np.ndarray) else _DEP[name]

    either = lambda mask, yes, no: np.where(mask, _DEP[yes], no if isinstance(no, np.ndarray) else _DEP[no])
    for name, rel in (("DET", "det"), ("ADJ", "amod"), ("NUM", "nummod")):
        give(is_(name), nn, rel)
    for name, rel in (("ADP", "prep"), ("CCONJ", "cc")):
        give(is_(name), lc, rel)
    for name, rel in (("ADV", "advmod"), ("SCONJ", "mark"), ("PUNCT", "punct")):
        give(is_(name), root, rel)
    give(of_prep, lp, "pobj")
    give(of_verb, lv, either(be[np.maximum(lv, 0)], "attr", "dobj"))
    give(noun & (lp < 0) & (lv < 0), root, either(fv < 0, "dep", either(passive, "nsubjpass", "nsubj")))
    give(verb, lv, either(t_aux, "aux", "conj"))
    head[i == root], dep[i == root] = i[i == root], _DEP["ROOT"]
    inside = is_("DET", "ADJ", "NUM", "NOUN", "PRON")
    run = np.cumsum(inside & ~(np.concatenate(([False], inside[:-1])) & (i > start)))
    real = np.bincount(run[inside & noun], minlength=run.max(initial=0) + 1) > 0
    base = np.where(start > 0, run[np.maximum(start - 1, 0)], 0)
    return head, dep, np.where(inside & real[run], run - base - 1, -1)


def heights(head: np.ndarray, longest: int | None = None) -> np.ndarray:
    """Levels below each token, for heads as places in the same array, of sentences of up to `longest` tokens."""
    n = len(head)
    longest = n if longest is None else longest
    up = head.copy()
    for _ in range(max(1, longest).bit_length()):  # tokens that reach no root are on a cycle or below one
        up = up[up]
    head = np.where(head[up] == up, head, np.arange(n))
    high, far, step = np.zeros(n, np.int64), head.copy(), 1
    live = head != np.arange(n)  # whose ancestor `step` levels up is there
    depth = _depths(head, longest)
    while live.any():
        at = np.flatnonzero(live)
        np.maximum.at(high, far[at], high[at] + step)
        far, step = far[far], step * 2
        live = depth >= step
    return high


def _depths(head: np.ndarray, longest: int) -> np.ndarray:
    n = len(head)
    depth, up = (head != np.arange(n)).astype(np.int64), head.copy()
    for _ in range(max(1, longest).bit_length()):
        depth, up = depth + depth[up], up[up]
    return depth


def different(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Equal numbers for equal runs of data, which begin at starts and end at the next."""
    ends = (np.append(starts, len(data)) * data.itemsize).astype(np.int32)
    runs = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
    return pc.dictionary_encode(runs).indices.to_numpy().astype(np.int64)


def scores(sents: np.ndarray, size: np.ndarray, vocab: pa.Array, code: np.ndarray, tags: np.ndarray, kinds: int, deps: list[str], dep: np.ndarray, head: np.ndarray, punct: np.ndarray, phrase: np.ndarray) -> list[np.ndarray]:
    """FEATURES of documents of `sents` sentences of `size` tokens each (one at least): lemmas as codes of
    vocab, tags under `kinds`, dep as places in deps, heads as places of tokens, phrase -1 outside of noun phrases."""
    d, k, n = len(sents), len(size), len(code)
    of, sent = np.repeat(np.arange(d), sents), np.repeat(np.arange(k), size)
    first, doc = np.cumsum(size) - size, of[sent]
    by = lambda mask: np.bincount(sent[mask], minlength=k)
    total = lambda x: np.bincount(of, x, d)
    named = lambda *names: np.isin(dep, [i for i, name in enumerate(deps) if name in names])
    tokens_, sentences = np.bincount(doc, minlength=d), np.maximum(sents, 1)
    over = np.bincount(doc[_true(pc.is_in(vocab, pa.array(OVERUSED.split())))[code]], minlength=d)
    moved, passive = by(_true(pc.match_substring_regex(vocab, "|".join(map(regex.escape, TRANSITIONS))))[code]) > 0, by(named("nsubjpass")) > 0
    # parts of speech and their neighbouring pairs
    pos = np.bincount(doc * kinds + tags, minlength=d * kinds).reshape(d, kinds)
    at = np.flatnonzero(sent[:-1] == sent[1:])
    pair, count = np.unique((doc[at] * kinds + tags[at]) * kinds + tags[at + 1], return_counts=True)
    most, pairs = np.zeros(d), np.bincount(doc[at], minlength=d)
    np.maximum.at(most, pair // (kinds * kinds), count)
    # complexity of sentences, in blocks of 100 words, and of each block with the next
    high = heights(head, int(size.max(initial=1)))
    high_max = np.maximum.reduceat(high, first) if n else np.zeros(0)
    complexity = (np.bincount(sent, high, k) / np.maximum(size, 1) + high_max) / 2
    words = by(~punct)
    all_words = total(words).astype(np.int64)
    ends = np.cumsum(words)
    before = ends - words - (np.cumsum(all_words) - all_words)[of]
    blocks = -(-np.maximum(1, all_words) // 100)
    at = (np.cumsum(blocks + 1) - blocks - 1)[of] + before // 100
    m = int((blocks + 1).sum())
    two = lambda x: x + np.append(x[1:], 0)
    chars = np.bincount(sent, pc.utf8_length(vocab).to_numpy()[code] + 1, k)
    many = two(np.bincount(at, minlength=m))
    part = two(np.bincount(at, complexity, m)) / np.maximum(many, 1)
    last = np.zeros(m, bool)
    last[np.cumsum(blocks + 1) - 1] = True
    good = ~last & (many > 0) & (two(np.bincount(at, chars, m)) > 50)
    owner = np.repeat(np.arange(d), blocks + 1)[good]
    chunks = np.bincount(owner, minlength=d)
    mean = np.bincount(owner, part[good], d) / np.maximum(chunks, 1)
    spread = np.bincount(owner, (part[good] - mean[owner]) ** 2, d) / np.maximum(chunks, 1)
    # forms of sentences and noun phrases that come again
    kept = ~named("punct", "det")
    forms = different(dep[kept].astype(np.int32), np.searchsorted(np.flatnonzero(kept), first))
    forms = np.bincount(np.unique(of * (k + 1) + forms) // (k + 1), minlength=d)
    inside = np.flatnonzero(phrase >= 0)
    inside = inside[np.lexsort((phrase[inside], sent[inside]))]
    new = np.append(True, (sent[inside][1:] != sent[inside][:-1]) | (phrase[inside][1:] != phrase[inside][:-1]))[: len(inside)]
    starts = np.flatnonzero(new)
    phrases = np.bincount(doc[inside][starts], minlength=d)
    kind, count = np.unique(doc[inside][starts] * (n + 1) + different(code[inside].astype(np.int32), starts), return_counts=True)
    again = np.bincount(kind[count > 1] // (n + 1), minlength=d)
    # sums of documents
    some = np.maximum(tokens_, 1)
    full = total(words > 0)
    mean_words = all_words / sentences
    cv = np.where(all_words > 0, np.sqrt(np.maximum(0.0, sents * total(words**2) - all_words**2)) / sentences / np.maximum(mean_words, 1e-300), 0.0)
    style = ((1 - np.minimum(1.0, np.abs(cv - 0.5))) + (1 - np.minimum(1.0, np.abs(np.bincount(doc[punct], minlength=d) / some - 0.1)))) / 2
    clauses, odd = total(by(named("cc", "mark")) * (words > 0)), total(by(named("attr", "oprd")))
    passive, moved = total(passive) / sentences, total(moved) / sentences
    fired = (over / some > 0.05).astype(int) + (most / np.maximum(pairs, 1) > 0.1) + ((sents >= 3) & (forms / sentences < 0.5)) + (odd / some > 0.02) + (again / np.maximum(phrases, 1) > 0.3)
    entropy = np.log2(some) - (pos * np.log2(np.maximum(pos, 1))).sum(1) / some
    out = [
        (pos > 0).sum(1) / some, entropy, total(complexity) / sentences, np.where(full > 0, (all_words / 10 + 0.5 * clauses) / np.maximum(full, 1), 0.0), np.maximum(0.0, 1 - np.minimum(1.0, np.abs(passive - 0.3) + np.abs(moved - 0.2))), moved, passive, style, fired / 5,
        mean, spread, sents, chunks,
    ]
    return [np.where(sents > 0, v, default) for v, default in zip(out, DEFAULTS)]


#: Without a sentence.
DEFAULTS = (0.5, 2.5, 2.5, 2.0, 0.5, 0.1, 0.2, 0.5, 0.3, 2.5, 0.2, 0, 0)
FEATURES = ["pos_diversity", "pos_entropy", "syntactic_complexity", "avg_sentence_complexity", "grammatical_consistency", "transition_word_usage", "passive_voice_ratio", "writing_style_score", "ai_pattern_score", "avg_chunk_complexity", "complexity_variance", "num_sentences", "num_chunks_analyzed"]
_KINDS = [pa.float64()] * 11 + [pa.int64()] * 2
_MADE = ", ".join(f"{f} {'long' if f.startswith('num') else 'double'}" for f in FEATURES)


def _true(mask: pa.Array) -> np.ndarray:
    return mask.to_numpy(zero_copy_only=False).astype(bool)


def tags_of(vocab: pa.Array) -> np.ndarray:
    """tag() of many tokens, as places in TAGS: only those that begin beyond ASCII are taken one by one."""
    out = np.full(len(vocab), TAGS.index("NOUN"))
    out[_true(pc.match_substring_regex(vocab, r"\A[0-9]"))] = TAGS.index("NUM")
    for ends, name in reversed(_ENDS):
        for e in ends:
            out[_true(pc.ends_with(vocab, e))] = TAGS.index(name)
    own = pc.index_in(vocab, pa.array(list(_WORDS))).fill_null(-1).to_numpy()
    out[own >= 0] = np.array([TAGS.index(name) for name in _WORDS.values()])[own[own >= 0]]
    out[_true(pc.match_substring_regex(vocab, r"\A[\x00-/:-@\[-^`{-\x7F]"))] = TAGS.index("PUNCT")
    for i in np.flatnonzero(~_true(pc.match_substring_regex(vocab, r"\A[\x00-\x7F]"))):
        out[i] = TAGS.index(tag(vocab[i].as_py()))
    return out


def _pieces(col: pa.Array):
    """Documents of sentences of tokens, in runs of about BLOCK tokens: first and last of a run, number of
    sentences of each document, of tokens of each sentence, and the tokens."""
    sents, sizes = pc.list_value_length(col).to_numpy().astype(np.int64), pc.list_value_length(col.flatten()).to_numpy().astype(np.int64)
    many = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(sents))]
    a = 0
    while a < len(col):
        e = max(a + 1, int(np.searchsorted(many, many[a] + BLOCK, "right")) - 1)
        own = col.slice(a, e - a)
        yield a, e, sents[a:e], pc.list_value_length(own.flatten()).to_numpy().astype(np.int64), own.flatten().flatten()
        a = e


def _parsed(sizes: np.ndarray, words: pa.Array):
    """vocab, codes, tags, start of each token's sentence, head, dep, np_id of sentences of tokens."""
    d = pc.dictionary_encode(words)
    vocab, code = d.dictionary, d.indices.to_numpy().astype(np.int64)
    tags = tags_of(vocab)[code]
    first = np.cumsum(sizes) - sizes
    start, end = np.repeat(first, sizes), np.repeat(first + sizes, sizes)
    be, ed = _true(pc.is_in(vocab, pa.array(list(_BE))))[code], _true(pc.ends_with(vocab, "ed"))[code]
    return vocab, code, tags, start, *attach(tags, be, ed, start, end)


def sentences(t: Column) -> Column:
    return F.transform(T.sentences(t), lambda s: F.regexp_extract_all(F.lower(s), F.lit(TOKEN), F.lit(0)))


def rounded(df: DataFrame, *front: str) -> DataFrame:
    return df.select(*front, *[F.col(f) if f.startswith("num") else F.round(F.col(f) + 1.0e-9, 4).alias(f) for f in FEATURES])


def counted(sents: np.ndarray, sizes: np.ndarray, words: pa.Array) -> list[np.ndarray]:
    """FEATURES by the rule parser of documents of `sents` sentences of `sizes` tokens."""
    vocab, code, tags, _, head, dep, phrase = _parsed(sizes, words)
    return scores(sents, sizes, vocab, code, tags, len(TAGS), DEPS, dep, head, tags == 0, phrase)


def features(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, keep, n_chars and FEATURES of each document by the rule parser, in its row."""
    from . import features as own

    return own.linguistic(docs, keep)


def parse(docs: DataFrame) -> DataFrame:
    """The tokens of docs with their tags and heads (SCHEMA; lemma: lower case)."""

    def rows(batches):
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        named = lambda codes, of: pa.DictionaryArray.from_arrays(pa.array(codes, pa.int32()), pa.array(of)).dictionary_decode()
        for b in batches:
            for a, e, sents, sizes, words in _pieces(b.column(1)):
                if not len(words):
                    continue
                _, _, tags, start, head, dep, phrase = _parsed(sizes, words)
                sent, doc = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.arange(len(sents)), sents)
                idx = (np.arange(len(sizes)) - (np.cumsum(sents) - sents)[doc])[sent]
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(a, e - a).take(pa.array(doc[sent])), pa.array(idx, pa.int32()), pa.array(np.arange(len(sent)) - start, pa.int32()), words, words, named(tags, TAGS), named(dep, DEPS),
                    pa.array(head - start, pa.int32()), pa.array(tags == 0), pa.array(phrase, pa.int32(), mask=phrase < 0),
                ], names=names)

    t = F.coalesce("text", F.lit(""))
    return tokens.spread(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), sentences(t).alias("ss")).mapInArrow(rows, SCHEMA)


def from_table(parses: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """doc_id and FEATURES from parse rows (SCHEMA), in any order; documents of docs
    without parses take the defaults. A document's tokens pass through one task, in order."""
    token = ["doc_id", "sent_idx", "tok_idx", F.lower(F.coalesce("lemma", "text", F.lit(""))).alias("lemma"), F.coalesce("pos", F.lit("X")).alias("pos"), F.coalesce("dep", F.lit("dep")).alias("dep"), "head_idx", F.coalesce("is_punct", F.lit(False)).alias("is_punct"), "np_id"]
    one = parses.select(F.col("doc_id").cast("long").alias("doc_id"), *token[1:]).repartition("doc_id").sortWithinPartitions("doc_id", "sent_idx", "tok_idx")
    names = ["doc_id", *FEATURES]

    def made(batches):
        held = []
        for b in batches:
            ids = b.column(0).fill_null(-(1 << 63)).to_numpy()
            held.append(b)
            if len(ids) and ids[-1] != held[0].column(0).fill_null(-(1 << 63))[0].as_py() and sum(x.num_rows for x in held) >= BLOCK:
                cut = int(np.flatnonzero(ids != ids[-1])[-1]) + 1 if (ids != ids[-1]).any() else 0
                if cut or len(held) > 1:
                    t = pa.Table.from_batches([*held[:-1], b.slice(0, cut)]).combine_chunks()
                    own = t["doc_id"].fill_null(-(1 << 63)).to_numpy()
                    back = int(np.count_nonzero(own == ids[-1]))  # of the document that goes on
                    yield _of_tokens(t.slice(0, len(own) - back))
                    held = [*t.slice(len(own) - back).to_batches(), b.slice(cut)]
        if held:
            yield _of_tokens(pa.Table.from_batches(held))

    def _of_tokens(t):
        if not t.num_rows:
            return pa.RecordBatch.from_arrays([pa.array([], k) for k in (pa.int64(), *_KINDS)], names=names)
        t = t.combine_chunks()
        col = lambda c: t[c].combine_chunks() if isinstance(t[c], pa.ChunkedArray) else t[c]
        num = lambda c, none: col(c).fill_null(none).to_numpy().astype(np.int64)
        coded = lambda c: (lambda e: (e.dictionary, e.indices.to_numpy().astype(np.int64)))(pc.dictionary_encode(col(c)))
        ids, idx, tok, to = num("doc_id", -(1 << 63)), num("sent_idx", -1), num("tok_idx", -1), num("head_idx", -2)
        opens = np.append(True, (ids[1:] != ids[:-1]) | (idx[1:] != idx[:-1]))
        first = np.flatnonzero(opens)
        size, sent = np.diff(np.append(first, len(ids))), np.cumsum(opens) - 1
        docs_at = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        sents = np.diff(np.append(np.searchsorted(first, docs_at), len(first)))
        # heads by the tokens' own numbers; of tokens that share one, the last
        wide = (1 << 32) + 3
        key, want = sent * wide + tok, sent * wide + to
        at = np.searchsorted(key, want, "right") - 1
        head = np.where((at >= 0) & (key[np.maximum(at, 0)] == want), at, np.arange(len(ids)))
        (vocab, code), (tags, tag_of), (deps, dep) = coded("lemma"), coded("pos"), coded("dep")
        out = scores(sents, size, vocab, code, tag_of, len(tags), deps.to_pylist(), dep, head, col("is_punct").to_numpy(zero_copy_only=False).astype(bool), num("np_id", -1))
        return pa.RecordBatch.from_arrays([col("doc_id").take(pa.array(docs_at)), *[pa.array(v, k) for v, k in zip(out, _KINDS)]], names=names)

    f = rounded(one.mapInArrow(made, f"doc_id long, {_MADE}"), "doc_id")
    if docs is None:
        return f
    filled = docs.select("doc_id").join(f, "doc_id", "left")
    return filled.select("doc_id", *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in zip(FEATURES, DEFAULTS)])


_AT = "OVER (PARTITION BY doc_id, idx ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_ALL = "OVER (PARTITION BY doc_id, idx)"
_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words.split()) + ")"
_POS = (
    r"CASE WHEN regexp_matches(w, '^[^\p{L}\p{N}_]') THEN 'PUNCT' " + " ".join(f"WHEN w IN {_IN(w)} THEN '{k}'" for k, w in CLASSES)
    + "".join(f" WHEN {' OR '.join(f"w LIKE '%{e}'" for e in ends.split())} THEN '{k}'" for k, ends in SUFFIXES) + " WHEN w >= '0' AND w < ':' THEN 'NUM' ELSE 'NOUN' END"
)
#: The same parser for DuckDB, as WITH clauses over its view `documents`: windows over the tokens of a sentence, and
#: `pz` with the tokens of all documents.
DUCK = rf"""
src AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
sn AS (SELECT doc_id, unnest(range(len(ss))) AS idx, unnest(ss) AS s FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ss FROM src)),
tw AS (SELECT doc_id, idx, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM (SELECT doc_id, idx, regexp_extract_all(lower(s), '{TOKEN}') AS ws FROM sn)),
tg AS (SELECT *, {_POS} AS p FROM tw),
ta AS (SELECT *, p IN ('VERB', 'AUX') AS verb, p IN ('NOUN', 'PRON') AS noun, p IN ('VERB', 'AUX') AND w IN {_IN(BE)} AS be, p IN ('DET', 'ADJ', 'NUM', 'NOUN', 'PRON') AS inside FROM tg),
tb AS (SELECT *, MIN(CASE WHEN verb THEN i END) {_ALL} AS fv, MIN(CASE WHEN p <> 'PUNCT' THEN i END) {_ALL} AS fw, MAX(CASE WHEN verb THEN i END) {_AT} AS lv, MAX(CASE WHEN p = 'ADP' THEN i END) {_AT} AS lp,
  MAX(CASE WHEN verb OR noun THEN i END) {_AT} AS lc, MIN(CASE WHEN noun THEN i END) OVER (PARTITION BY doc_id, idx ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nn,
  MAX_BY(be, i) FILTER (verb) {_AT} AS lvbe, CASE WHEN inside AND NOT coalesce(lag(inside) OVER (PARTITION BY doc_id, idx ORDER BY i), FALSE) THEN 1 ELSE 0 END AS opens FROM ta),
tc AS (SELECT *, coalesce(fv, fw, 0) AS root, MIN(CASE WHEN verb AND i > fv THEN i END) {_ALL} AS sv, SUM(opens) OVER (PARTITION BY doc_id, idx ORDER BY i) AS run FROM tb),
td AS (SELECT *, bool_or(i = fv AND be) {_ALL} AND bool_or(i = sv AND w LIKE '%ed') {_ALL} AS passive, bool_or(noun) OVER (PARTITION BY doc_id, idx, run, inside) AS real FROM tc),
pz AS (SELECT doc_id, idx, i, w, p, CASE WHEN i = root THEN i WHEN p IN ('DET', 'ADJ', 'NUM') THEN coalesce(nn, root) WHEN p IN ('ADP', 'CCONJ') THEN coalesce(lc, root)
    WHEN noun AND coalesce(lp, -1) > coalesce(lv, -1) THEN lp WHEN (noun OR verb) THEN coalesce(lv, root) ELSE root END AS head,
  CASE WHEN i = root THEN 'ROOT' WHEN p = 'DET' THEN 'det' WHEN p = 'ADJ' THEN 'amod' WHEN p = 'NUM' THEN 'nummod' WHEN p = 'ADP' THEN 'prep' WHEN p = 'CCONJ' THEN 'cc' WHEN p = 'ADV' THEN 'advmod' WHEN p = 'SCONJ' THEN 'mark' WHEN p = 'PUNCT' THEN 'punct'
    WHEN noun AND coalesce(lp, -1) > coalesce(lv, -1) THEN 'pobj' WHEN noun AND lv IS NOT NULL THEN CASE WHEN lvbe THEN 'attr' ELSE 'dobj' END WHEN noun THEN CASE WHEN fv IS NULL THEN 'dep' WHEN passive THEN 'nsubjpass' ELSE 'nsubj' END
    WHEN p = 'AUX' THEN 'aux' ELSE 'conj' END AS dep, p = 'PUNCT' AS punct, CASE WHEN inside AND real THEN CAST(run - 1 AS INTEGER) END AS np FROM td)"""
ROWS_SQL = f"WITH {DUCK} SELECT doc_id, CAST(idx AS INTEGER) AS sent_idx, CAST(i AS INTEGER) AS tok_idx, w AS text, w AS lemma, p AS pos, dep, CAST(head AS INTEGER) AS head_idx, punct AS is_punct, np AS np_id FROM pz"
_R = lambda c, f: f"ROUND(COALESCE({c}, {float(DEFAULTS[FEATURES.index(f)])!r}) + 1.0E-9, 4) AS {f}"
#: Features for DuckDB: heights by a recursive walk from every token to its root.
FEATURES_SQL = rf"""
SELECT * FROM (WITH RECURSIVE {DUCK},
up AS (SELECT doc_id, idx, i, head AS a, 1 AS d FROM pz WHERE head <> i UNION ALL SELECT u.doc_id, u.idx, u.i, z.head, u.d + 1 FROM up u JOIN pz z ON z.doc_id = u.doc_id AND z.idx = u.idx AND z.i = u.a WHERE z.head <> z.i),
hi AS (SELECT doc_id, idx, a AS i, MAX(d) AS h FROM up GROUP BY doc_id, idx, a),
ss AS (SELECT z.doc_id, z.idx, COUNT(*) AS n, SUM(CASE WHEN punct THEN 0 ELSE 1 END) AS words, (AVG(coalesce(h, 0)) + MAX(coalesce(h, 0))) / 2 AS c, SUM(CASE WHEN dep IN ('cc', 'mark') THEN 1 ELSE 0 END) AS clauses, MAX(CASE WHEN dep = 'nsubjpass' THEN 1 ELSE 0 END) AS passive,
  MAX(CASE WHEN regexp_matches(w, '{"|".join(TRANSITIONS)}') THEN 1 ELSE 0 END) AS moved, SUM(CASE WHEN w IN {_IN(OVERUSED)} THEN 1 ELSE 0 END) AS over, SUM(CASE WHEN dep IN ('attr', 'oprd') THEN 1 ELSE 0 END) AS odd,
  coalesce(string_agg(dep, ' ' ORDER BY z.i) FILTER (dep NOT IN ('punct', 'det')), '') AS form, SUM(length(w) + 1) AS chars FROM pz z LEFT JOIN hi ON hi.doc_id = z.doc_id AND hi.idx = z.idx AND hi.i = z.i GROUP BY z.doc_id, z.idx),
bl AS (SELECT doc_id, CAST(FLOOR(b / 100) AS BIGINT) AS b, SUM(c) AS c, COUNT(*) AS k, SUM(chars) AS chars FROM (SELECT *, SUM(words) OVER (PARTITION BY doc_id ORDER BY idx) - words AS b FROM ss) GROUP BY 1, 2),
ch AS (SELECT doc_id, b, SUM(c) / SUM(k) AS c FROM (SELECT * FROM bl UNION ALL SELECT doc_id, b - 1, c, k, chars FROM bl WHERE b > 0) WHERE b < (SELECT GREATEST(1, CEIL(SUM(words) / 100)) FROM ss x WHERE x.doc_id = doc_id) GROUP BY doc_id, b HAVING SUM(chars) > 50),
cv AS (SELECT c.doc_id, AVG(c) AS mean, VAR_POP(c) AS var, COUNT(*) AS k FROM ch c JOIN (SELECT doc_id, GREATEST(1, CEIL(SUM(words) / 100)) AS last FROM ss GROUP BY doc_id) l ON l.doc_id = c.doc_id WHERE c.b < l.last GROUP BY c.doc_id),
po AS (SELECT doc_id, COUNT(*) AS kinds, SUM(c) AS n, LOG2(SUM(c) * 1.0E0) - SUM(c * LOG2(c * 1.0E0)) / SUM(c) AS h FROM (SELECT doc_id, p, COUNT(*) AS c FROM pz GROUP BY doc_id, p) GROUP BY doc_id),
pp AS (SELECT doc_id, MAX(c) * 1.0E0 / SUM(c) AS top FROM (SELECT doc_id, p, q, COUNT(*) AS c FROM (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id, idx ORDER BY i) AS q FROM pz) WHERE q IS NOT NULL GROUP BY doc_id, p, q) GROUP BY doc_id),
ph AS (SELECT doc_id, SUM(CASE WHEN c > 1 THEN 1 ELSE 0 END) * 1.0E0 / SUM(c) AS again FROM (SELECT doc_id, t, COUNT(*) AS c FROM (SELECT doc_id, idx, np, string_agg(w, ' ' ORDER BY i) AS t FROM pz WHERE np IS NOT NULL GROUP BY doc_id, idx, np) GROUP BY doc_id, t) GROUP BY doc_id),
dd AS (SELECT doc_id, COUNT(*) AS s, SUM(n) AS n, SUM(words) AS words, AVG(c) AS c, SUM(clauses * CASE WHEN words > 0 THEN 1 ELSE 0 END) AS clauses, SUM(CASE WHEN words > 0 THEN 1 ELSE 0 END) AS filled, AVG(passive) AS passive, AVG(moved) AS moved, SUM(over) AS over, SUM(odd) AS odd, COUNT(DISTINCT form) AS forms,
  COALESCE(STDDEV_POP(words) / NULLIF(AVG(words), 0), 0) AS cv FROM ss GROUP BY doc_id)
SELECT s.doc_id, CAST(length(s.text) AS BIGINT) AS n_chars, {_R("po.kinds * 1.0E0 / po.n", "pos_diversity")}, {_R("po.h", "pos_entropy")}, {_R("dd.c", "syntactic_complexity")},
  {_R("CASE WHEN dd.filled > 0 THEN (dd.words / 10.0E0 + 0.5E0 * dd.clauses) / dd.filled WHEN dd.s > 0 THEN 0.0E0 END", "avg_sentence_complexity")}, {_R("CASE WHEN dd.s > 0 THEN GREATEST(0.0E0, 1 - LEAST(1.0E0, ABS(dd.passive - 0.3E0) + ABS(dd.moved - 0.2E0))) END", "grammatical_consistency")},
  {_R("dd.moved", "transition_word_usage")}, {_R("dd.passive", "passive_voice_ratio")}, {_R("CASE WHEN dd.s > 0 THEN (1 - LEAST(1.0E0, ABS(dd.cv - 0.5E0)) + 1 - LEAST(1.0E0, ABS((dd.n - dd.words) * 1.0E0 / dd.n - 0.1E0))) / 2 END", "writing_style_score")},
  {_R("(CASE WHEN dd.over * 1.0E0 / dd.n > 0.05E0 THEN 1 ELSE 0 END + CASE WHEN pp.top > 0.1E0 THEN 1 ELSE 0 END + CASE WHEN dd.s >= 3 AND dd.forms * 1.0E0 / dd.s < 0.5E0 THEN 1 ELSE 0 END + CASE WHEN dd.odd * 1.0E0 / dd.n > 0.02E0 THEN 1 ELSE 0 END + CASE WHEN ph.again > 0.3E0 THEN 1 ELSE 0 END) * dd.s / dd.s / 5.0E0", "ai_pattern_score")},
  {_R("CASE WHEN dd.s > 0 THEN coalesce(cv.mean, 0.0E0) END", "avg_chunk_complexity")}, {_R("CASE WHEN dd.s > 0 THEN coalesce(cv.var, 0.0E0) END", "complexity_variance")}, CAST(COALESCE(dd.s, 0) AS BIGINT) AS num_sentences, CAST(COALESCE(cv.k, 0) AS BIGINT) AS num_chunks_analyzed
FROM src s LEFT JOIN dd ON dd.doc_id = s.doc_id LEFT JOIN po ON po.doc_id = s.doc_id LEFT JOIN pp ON pp.doc_id = s.doc_id LEFT JOIN ph ON ph.doc_id = s.doc_id LEFT JOIN cv ON cv.doc_id = s.doc_id)
""".replace("WHERE b < (SELECT GREATEST(1, CEIL(SUM(words) / 100)) FROM ss x WHERE x.doc_id = doc_id) ", "")

tokens.FRAMES["linguistic_features"] = features
tokens.DUCK["linguistic_features"] = f"linguistic_features AS ({FEATURES_SQL})"
