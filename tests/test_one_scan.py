"""Structure, entropy, parses and sentences' cosines of one scan of plain texts, against the expressions of text.py."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stylospark.functions import text as T
from stylospark.operators import features, parses, scan
from stylospark.plans import detect

from test_scan import texts

MORE = ["'s", "'re", "'rex", "'ll", "'l", "'d'm", " '", "''t", "9", " 9", "x's", "\n'", "'S", "£", ",", "The cat sat on it", "Cat sat"]


def made():
    rng = random.Random(3)
    return texts() + ["".join(rng.choice(MORE + [" ", ".", "a"]) for _ in range(rng.choice([1, 2, 3, 9, 60]))) for _ in range(300)]


def test_what_is_cut_from_plain_texts_is_what_the_expressions_cut(spark):
    docs = spark.createDataFrame([*enumerate(made())], "doc_id long, text string").repartition(1)
    t = F.col("text")
    want = docs.where(~scan.other(t)).select("text", T.pretokens(t), F.flatten(parses.sentences(t)), T.space_words(F.lower(t)), F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}\s]", "\0"), F.regexp_count(t, F.lit(r"[^\p{L}\p{N}_\s]")), F.transform(T.sentences(t), F.lower)).collect()
    assert len(want) > 500
    x = scan.Plain(pa.array([r[0] for r in want]))
    n, tokens = x.pretokens()
    assert n.tolist() == [len(r[1]) for r in want] and tokens.to_pylist() == [w for r in want for w in r[1]]
    assert x.parsed()[1].to_pylist() == [w for r in want for w in r[2]]
    n, words = x.spaced()
    assert n.tolist() == [len(r[3]) for r in want] and words.to_pylist() == [w for r in want for w in r[3]]
    assert x.marked().tolist() == [ord(c) for r in want for c in r[4]]
    assert x.marks()[0].tolist() == [r[5] for r in want] and x.marks()[1].tolist() == [r[0].count(",") for r in want]
    assert x.lower_sentences() == [s for r in want for s in r[6]]


def test_plain_texts_and_others_give_the_same_features(spark):
    """Both ways a text may be read, over the same texts."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["The", "tree,", "sat", "on", "a", "Été", "house.", "it's", "forest", "garden!"]) for _ in range(rng.choice([1, 9, 40, 300])))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for name, part in features._PARTS.items():
        t = F.col("text")
        b = docs.select("text", *part.split(t)).toArrow().combine_chunks()
        n = np.array([len(v) for v in b["text"].to_pylist()])
        got = part.plain(scan.Plain(b["text"].combine_chunks()))
        want = part.other(n, *[c.combine_chunks() for c in b.columns[1:]])
        assert len(got) == len(want) == len(part.made), name
        for c, v, w in zip(part.made, got, want):
            assert np.allclose(v, w, equal_nan=True, rtol=0, atol=1e-12), (name, c)


def test_a_verdict_reads_the_text_once(spark):
    docs = spark.createDataFrame([(1, "One two. Three four.")], "doc_id long, text string")
    a = detect.metric_columns(docs, ("perplexity", "multi_perturbation_stability"))
    assert a._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_blocks_of_sentences_give_what_all_give(monkeypatch):
    rng = random.Random(8)
    sents = np.array([0, 2, 30, 1, 17])
    sizes = np.array([rng.choice([0, 1, 3, 3]) for _ in range(sents.sum())])
    words = pa.array([rng.choice(["tree", "sat", "a", "b", "c"]) for _ in range(sizes.sum())])
    low = [str(i) for i in range(len(sizes))]
    keys = np.bincount(np.repeat(np.arange(5), sents), sizes, 5).astype(int)
    want = features._semantics(sents, sizes, words, low, keys, words)
    monkeypatch.setattr(features, "BLOCK", 4)
    got = features._semantics(sents, sizes, words, low, keys, words)
    assert all(np.allclose(v, w, equal_nan=True) for v, w in zip(got, want))
    # by all pairs, of the text of 30 sentences
    at = np.append(0, np.cumsum(sizes))
    own = words.to_pylist()
    count = [[own[at[i] : at[i + 1]].count(w) for w in ("tree", "sat", "a", "b", "c")] for i in range(2, 32)]
    e = np.array(count, float)
    e /= np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-9)
    g = e @ e.T
    above = sum(g[i, j] > 0.8000001 for i in range(30) for j in range(i + 2, 30))
    assert np.isclose(got[5][2], above / (29 * 28 / 2)) and np.isclose(got[4][2], ((g**2).sum() - 30) / (30 * 29)) and np.isclose(got[3][2], (g.sum() - 30) / (30 * 29))


def test_attribution_reads_the_text_in_the_same_scan(spark):
    from stylospark.functions import fingerprints
    from stylospark.operators import verdict_rows

    part = verdict_rows.style(fingerprints.rows())
    own = ["However, it's worth noting that. So, firstly; this: is?! — an example.", "", "Well, in other words. Now, then", " ...", "in terms of Été"]
    b = spark.createDataFrame([(t,) for t in own], "text string").repartition(1).select("text", *part.split(F.col("text"))).toArrow().combine_chunks()
    got = part.plain(scan.Plain(b["text"].combine_chunks()))
    want = part.other(np.array([len(v) for v in b["text"].to_pylist()]), *[c.combine_chunks() for c in b.columns[1:]])
    assert len(got) == len(want) == len(part.made) and all(v.tolist() == w.tolist() for v, w in zip(got, want))
    assert sum(v.sum() for v in got[-7:]) > 0
    docs = spark.createDataFrame([*enumerate(own)], "doc_id long, text string")
    a = detect.metric_columns(docs, ("perplexity", "multi_perturbation_stability"), signals=True, style=part)
    assert verdict_rows.attribution(a, fingerprints.rows())._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
