"""Words and sentences read as arrays of many texts, against the expressions of text.py."""

import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from stylospark.functions import text as T
from stylospark.operators import scan

PARTS = ["the", "Cat", "Été", "ŒUVRE_2", "½", "x-y", "don't", ".", "...", "!?", " ", "  ", "\n", "\t\r\n", "\x0b", "\x1c", "\x85", "\xa0", "—", " ", "…", "\0", "ª", "×", "Ÿ", "ŉ", "a.b", " . ", "9"]
OTHERS = ["İx", "ΑΣ.Β", "日本", "😀", "ẞ", "ſ", " ", "⁰"]


def texts():
    rng = random.Random(7)
    made = ["".join(rng.choice(PARTS + ([*OTHERS] if i % 4 == 0 else [])) for _ in range(rng.choice([0, 1, 2, 5, 40, 300]))) for i in range(400)]
    return made + ["", " ", "...", "a", ".a", "a.", "\n a \n.\n", *PARTS, *OTHERS]


def test_texts_are_read_as_the_expressions_split_them(spark):
    docs = spark.createDataFrame([*enumerate(texts())], "doc_id long, text string").repartition(1)
    t = F.col("text")
    want = docs.select("doc_id", T.lower_words(t).alias("all"), F.transform(T.sentences(t), lambda s: F.struct(T.lower_words(s), F.length(s), F.size(T.space_words(s)))).alias("ss")).collect()
    want = {r.doc_id: (r["all"], [tuple(s) for s in r.ss]) for r in want}
    b = docs.select("doc_id", *scan.columns(t)).toArrow().combine_chunks().to_batches()[0]
    got, kinds = {}, []
    for rows, x in scan.scans(b.column(1), b.column(2)):
        kinds.append(len(rows))
        words, w, s = x.words.to_pylist(), 0, 0
        for i, m in zip(b.column(0).take(rows).to_pylist(), x.sents):
            own = []
            for k in range(s, s + m):
                own.append((words[w : w + x.sizes[k]], x.chars[k], x.spaced[k]))
                w += x.sizes[k]
            s += m
            got[i] = own
    assert len(kinds) == 2 and min(kinds) > 50
    assert got == {i: ss for i, (_, ss) in want.items()}
    plain = {i for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if v is not None}
    assert all(want[i][0] == [w for s in got[i] for w in s[0]] for i in plain)


def test_runs_of_texts_give_what_all_give(monkeypatch):
    own = pa.array(["A b. C", "", "d", "E! f? g"] * 5)
    none = pa.nulls(20, pa.list_(pa.struct([("ws", pa.list_(pa.string())), ("chars", pa.int32()), ("spaced", pa.int32())])))
    monkeypatch.setattr(scan, "PIECE", 9)
    parts = [*scan.scans(own, none)]
    assert len(parts) > 5 and [i for rows, _ in parts for i in rows.to_pylist()] == [*range(20)]
    assert [w for _, x in parts for w in x.words.to_pylist()] == scan.scan(own).words.to_pylist()


def test_blocks_are_not_split_in_the_row(spark):
    """Of plain texts no expression splits sentences: the whole text goes to the task."""
    from stylospark.operators import language_model as model

    docs = spark.createDataFrame([(1, "One two. Three four five"), (2, "日本 two. Three")], "doc_id long, text string")
    assert {w for r in model.blocks(docs, 0).collect() for w in r.vocab} == {"one", "two", "three", "four", "five", "日本"}
    plain, split = docs.orderBy("doc_id").select(*scan.columns(F.col("text"))).toPandas().values.T
    assert [x is None for x in plain] == [False, True] and [x is None for x in split] == [True, False]


def test_structure_against_brute_force(spark):
    from stylospark.operators import features

    rng = random.Random(9)
    made = [" ".join(rng.choice(["the", "The", "tree,", "a", "Été", "queue.", "ΑΣ", "x!"]) for _ in range(rng.choice([0, 1, 2, 3, 10, 11, 12, 60]))) for _ in range(90)] + [None, "", "..."]
    docs = spark.createDataFrame([*enumerate(made)], "doc_id long, text string").repartition(2)
    df = features.structural(docs)
    assert "array_distinct" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = {r.doc_id: r for r in df.collect()}
    assert len(got) == len(made)
    words = {r.doc_id: r.ws for r in docs.select("doc_id", T.lower_words(F.coalesce("text", F.lit(""))).alias("ws")).collect()}
    for i, ws in words.items():
        n = len(ws)
        share = lambda k: round(len({tuple(ws[j : j + k]) for j in range(n - k + 1)}) / (n - k + 1), 4) if n >= k else 0  # noqa: B023, E731
        again = sum(c > 1 for s in range(n - 10) for c in Counter(ws[s : s + 10]).values()) / ((n - 10) * 10) if n > 10 else 0
        assert (got[i].num_words, got[i].vocabulary_size, got[i].bigram_diversity, got[i].trigram_diversity) == (n, len(set(ws)), share(2), share(3))
        assert abs(got[i].repetition_score - again) < 1e-4


def test_abbreviations_are_looked_for_once(spark):
    """Texts with one of them and without, and one whose period goes makes another, as the patterns in turn give."""
    import re

    from stylospark.functions import fixed

    made = ["Dr. Who met Mr. X. He left.", "No word of them here. At all.", "He said a.d.r. Then no. More to come here.", "best. co. st. left. One two.", "", "3.14 is it... Yes it is."]
    docs = spark.createDataFrame([*enumerate(made)], "doc_id long, text string")
    want = {}
    for i, t in enumerate(made):
        for a in sorted(fixed.ABBREVIATIONS):
            t = re.sub(rf"\b{re.escape(a)}\.", a.replace(".", "<DOT>"), t, flags=re.I)
        t = re.sub(r"(\d+)\.(\d+)", r"\1<DOT>\2", t).replace("...", "<ELLIPSIS>")
        pieces = [p.replace("<DOT>", ".").replace("<ELLIPSIS>", "...").strip() for p in re.split(r"[.!?]+(?=\s+[A-Z]|$)", t)]
        want[i] = [p for p in pieces if len(p.split()) > 1]
    got = docs.select("doc_id", T.sentences_smart(F.col("text")).alias("s"))
    assert {r.doc_id: r.s for r in got.collect()} == want
    assert "CASE WHEN" in got._jdf.queryExecution().optimizedPlan().toString()
