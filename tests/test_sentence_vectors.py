"""Learned and supplied sentence vectors against dense algebra and loops over all pairs."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from stylospark.functions import text as T
from stylospark.operators import features, sentence_vectors as sv
from stylospark.plans import detect

WORDS = [["river", "water", "bank", "flood", "stream", "rain"], ["market", "price", "trade", "bank", "money", "stock"], ["song", "music", "choir", "voice", "drum", "dance"]]


def _texts():
    rng = np.random.default_rng(5)
    for i in range(24):
        topic = [WORDS[rng.integers(3)] if rng.random() < 0.3 else WORDS[i % 3] for _ in range(rng.integers(1, 60))]
        yield i, ". ".join(" ".join(rng.choice(w, rng.integers(3, 9))) for w in topic) + ("." if i % 2 else "")
    yield from [(100, None), (101, ""), (102, "!!! ... ???"), (103, "song music choir. " * 40), (104, "----------- . ----------- . ----------- . ***********")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(_texts()), "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def basis(docs):
    return sv.learn(docs, rank=6, buckets=64)


def dense(docs, idf):
    """The whole table of weighted, normalised sentences."""
    rows = docs.select(F.explode(T.sentences(F.coalesce("text", F.lit("")), 10)).alias("s")).select(F.transform(T.lower_words(F.col("s")), lambda w: F.pmod(F.xxhash64(w), F.lit(64))).alias("b")).collect()
    a = np.zeros((len(rows), 64))
    for x, r in zip(a, rows):
        for b in set(r.b):
            x[b] = (1 + np.log(r.b.count(b))) * idf[b]
    return a[np.abs(a).sum(1) > 0] / np.linalg.norm(a[np.abs(a).sum(1) > 0], axis=1, keepdims=True)


def test_projection_error_is_that_of_the_best_rank(docs, basis):
    a = dense(docs, basis.idf)
    assert basis.n == len(a)
    best = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(basis.vectors.T @ basis.vectors, np.eye(6), atol=1e-9)
    error = np.linalg.norm(a - a @ basis.vectors @ basis.vectors.T) ** 2
    assert error <= 1.02 * (best[6:] ** 2).sum() + 1e-3
    assert np.allclose(basis.shares, best[:6] ** 2 / len(a), rtol=0.02)
    assert 1 - basis.shares.sum() == pytest.approx(error / len(a), abs=1e-3)


def test_learning_does_not_depend_on_the_order_of_rows(docs, basis):
    again = sv.learn(docs.repartition(5, F.rand(3)), rank=6, buckets=64)
    assert np.array_equal(again.vectors, basis.vectors) and np.array_equal(again.idf, basis.idf)


def test_model_is_read_back(spark, basis, tmp_path):
    sv.save(spark, basis, f"{tmp_path}/basis")
    back = sv.load(spark, f"{tmp_path}/basis")
    assert all(np.array_equal(x, y) for x, y in zip(back, basis))


def by_pairs(vecs, sentences, keys):
    """The features, from loops."""
    n = len(vecs)
    if n < 3:
        return [0.5, 0.5, 0.0, 0.5, 0.5, 0.1, 0]
    cos = lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b))) if a.any() and b.any() else 0.0
    c = {(i, j): cos(vecs[i], vecs[j]) for i, j in itertools.combinations(range(n), 2)}
    begin, words = [], 0
    for s in sentences:
        begin.append(words)
        words += len(s.split())
    chunks = []
    for start in range(0, words, 100):
        inside = [i for i in range(n) if start <= begin[i] < start + 200]
        if len(inside) >= 2:
            chunks.append(np.mean([c[p] for p in zip(inside, inside[1:])]))
    k = min(3, n // 3)
    counts = {w: keys.count(w) for w in keys}
    top = sorted((w for w in counts if counts[w] > 1), key=lambda w: (-counts[w], keys.index(w)))[:10]
    far = [v > 0.8000001 for (i, j), v in c.items() if j >= i + 2]
    return [
        np.mean([c[i, i + 1] for i in range(n - 1)]), 1 - min(1, 5 * np.var(list(c.values()))), min(1, 3 * np.mean(far)) if n >= 5 else 0.0, max(0, 1 - np.mean([c[i, j] for i in range(k) for j in range(n - k, n)])),
        np.mean([np.mean([w in s.lower() for s in sentences]) for w in top]) if top else 0.0, np.var(chunks) if chunks else 0.0, n,
    ]


def check(docs, vectors, got):
    t = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", T.sentences(t, 10).alias("ss"), T.keywords(t).alias("keys")).collect()
    got = {r.doc_id: [float(x) for x in r[2:]] for r in got.collect()}
    assert len(got) == len(rows)
    for r in rows:
        vecs = [np.array(vectors.get((r.doc_id, i), [0.0]), float) for i in range(len(r.ss))]
        width = max((len(v) for v in vecs), default=1)
        want = by_pairs([np.resize(v, width) if v.any() else np.zeros(width) for v in vecs], r.ss, r["keys"])
        assert got[r.doc_id][:6] == pytest.approx(want[:6], abs=1e-4), r.doc_id
        assert got[r.doc_id][6] == (len(r.ss) if len(r.ss) >= 3 else 0)


def test_features_of_learned_vectors(docs, basis):
    made = {(r.doc_id, r.idx): r.vec for r in sv.vectors(docs, basis).collect()}
    assert all(np.linalg.norm(v) == pytest.approx(1) or not any(v) for v in made.values())
    check(docs, made, sv.semantic(docs, basis))
    plan = sv.semantic(docs, basis)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan


def test_features_of_supplied_vectors(spark, docs):
    rng = np.random.default_rng(9)
    rows = [(i, j, rng.integers(-3, 4, 5).astype(float).tolist()) for i in range(24) for j in range(60) if rng.random() < 0.9]
    rows = [(i, j, v) for i, j, v in rows if any(v)]
    odd = [(3, 0, None), (4, 1, [1.0, None, 2.0, 0.0, 0.0]), (5, 2, [1.0, float("nan"), 0.0, 0.0, 0.0]), (6, 3, [1.0, float("inf"), 0.0, 0.0, 0.0]), (7, 999, [1.0] * 5), (8, None, [1.0] * 5), (None, 0, [1.0] * 5), (999, 0, [1.0] * 5), (9, 0, [2.0])]
    taken = {(i, j): v for i, j, v in rows if (i, j) not in {(o[0], o[1]) for o in odd}}
    table = spark.createDataFrame([(i, j, v) for (i, j), v in taken.items()] + odd, "doc_id long, idx int, vec array<double>")
    check(docs, taken, sv.supplied(docs, table))
    twice = sv.supplied(docs, table.union(table))
    assert sorted(twice.collect()) == sorted(sv.supplied(docs, table).collect())


def test_no_rows(spark, docs, basis):
    none = docs.limit(0)
    empty = sv.learn(none, rank=4, buckets=32)
    assert empty.n == 0 and not empty.vectors.any()
    assert sv.semantic(none, empty).count() == 0 and sv.vectors(none, empty).count() == 0
    assert sv.semantic(docs, empty).where("coherence_score not in (0.0, 0.5)").count() == 0
    no_vectors = spark.createDataFrame([], "doc_id long, idx int, vec array<double>")
    assert sv.supplied(docs, no_vectors).count() == docs.count()


def test_verdicts_by_vectors(spark, docs, basis):
    skip = ("perplexity", "multi_perturbation_stability")
    rows = {r.doc_id: r for r in detect.metric_columns(docs, skip, vectors=basis).collect()}
    own = {r.doc_id: r for r in detect.metric_columns(docs, skip).collect()}
    assert len(rows) == docs.count() and any(rows[i].semantic_analysis != own[i].semantic_analysis for i in rows)
    assert all(rows[i].structural == own[i].structural for i in rows)
    assert detect.ensemble(docs, skip=skip, vectors=sv.vectors(docs, basis)).count() == docs.count()


def test_nearest_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    v = {i: rng.integers(-2, 3, 4).astype(float) for i in range(300)}
    odd = [(900, None), (901, []), (902, [0.0] * 4), (903, [1.0, None, 1.0, 1.0]), (904, [float("inf")] * 4), (905, [1.0] * 3)]
    table = spark.createDataFrame([(i, x.tolist()) for i, x in v.items()] + odd, "vec_id long, vec array<double>").repartition(7)
    got = {}
    for r in sv.nearest(table, table.where("vec_id % 50 = 0"), 7).collect():
        got[r.query_id, r["rank"]] = (r.vec_id, r.cosine)
    norm = {i: x / np.linalg.norm(x) for i, x in v.items() if x.any()}
    for q in range(0, 300, 50):
        if q in norm:
            best = sorted((-round(float(norm[q] @ x), 9), i) for i, x in norm.items() if i != q)[:7]
            assert [got.pop((q, k + 1)) for k in range(7)] == [(i, pytest.approx(-c, abs=1e-6)) for c, i in best]
    assert not got
    assert sv.nearest(table, table.limit(0)).count() == 0 and sv.nearest(table.limit(0), table).count() == 0
