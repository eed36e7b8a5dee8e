"""Naive Bayes support vectors: n-gram indicators scaled by class log-count
ratios, then a linear hinge-loss model fitted by dual coordinate descent.

Features of a text, hashed to `DIM` places: words and pairs of words, and one to
three neighbouring word shapes (the classes of a word's bytes, its first byte's
class, a final sign, whether it repeats the word before). Everything but the fit
runs over all rows in numpy inside Spark tasks; the fit takes a bounded sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import U64, column, mix, pieces, raw, word_hashes, words

DIM = 1 << 18
#: Labelled rows that the fit takes at most, by hash of doc_id; more aren't needed for DIM weights of this model.
SAMPLE = 6000

_CLASS = np.full(256, 16, np.uint8)  # bits: lower, upper, digit, high byte, sign
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[48:58], _CLASS[128:] = 1, 2, 4, 8


def features(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """Distinct feature places of each document."""
    start, end, at = words(data, offs)
    if not len(start):
        return [np.zeros(0, np.int64)] * (len(offs) - 1)
    h = word_hashes(data, start, end)
    cls = _CLASS[data]
    bounds = np.stack((start, end), 1).ravel()
    mask = np.bitwise_or.reduceat(cls, bounds if bounds[-1] < len(cls) else bounds[:-1])[::2].astype(np.int64)
    tail, head = data[end - 1].astype(np.int64), cls[start].astype(np.int64)
    tail = np.where(cls[end - 1] == 16, tail, 0)
    same = np.zeros(len(h), np.int64)
    same[1:] = h[1:] == h[:-1]
    shape = mix(((mask * 32 + head) * 256 + tail).astype(U64) * U64(2) + same.astype(U64))
    p2, p3 = shape[:-1] * U64(3) + shape[1:], shape[:-2] * U64(9) + shape[1:-1] * U64(3) + shape[2:]
    grams = [(h, 1), (mix(h[:-1] * U64(31) + h[1:]), 2), (mix(shape + U64(5)), 1), (mix(p2 + U64(7)), 2), (mix(p3 + U64(11)), 3)]
    place = [((g >> U64(46)).astype(np.int64), n) for g, n in grams]
    seen = np.zeros(DIM, np.int32)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        idx = np.concatenate([g[a : max(a, b - n + 1)] for g, n in place])
        k = np.arange(len(idx), dtype=np.int32)
        seen[idx] = k
        out.append(idx[seen[idx] == k])
    return out


def _feature_rows(batches):
    for batch in batches:
        for part in pieces(batch, "text"):
            f = features(*raw(part.column(part.schema.get_field_index("text"))))
            ends = np.concatenate(([0], np.cumsum([len(x) for x in f]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(f).astype(np.int32)))], ["label", "idx"])


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray, rounds: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of an L1-loss linear machine over indicator rows scaled
    by ratio and 1/sqrt(row length): coordinates of the dual in random order."""
    w, bias = np.zeros(DIM), 0.0
    x = [ratio[r] / np.sqrt(max(1, len(r))) for r in rows]
    diag = np.array([float(v @ v) + 1.0 for v in x])
    alpha, rng = np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (float(w[rows[i]] @ x[i]) + bias) - 1
            new = min(max(alpha[i] - g / diag[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * x[i]
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


class Model:
    """weights: per place, scaled by its ratio; score = 1/(1+exp(-(slope*margin+shift)))."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([float(self.weights[r].sum()) / np.sqrt(max(1, len(r))) + self.bias for r in rows])

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(rows) + self.shift, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, smooth: float = 1.0, c: float = 1.0) -> Model:
    """Fit on the texts of at most `sample` rows of labels (doc_id, quality 0/1),
    those with the smallest hashes of doc_id, half of them of each class; rows
    held out, with null ids or other labels are left out. The sample's ids are
    what is broadcast. Without rows of both classes every text scores by the
    share of label 1 (a half without any)."""
    lab = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_label")).where("_id is not null and _label in (0, 1)")
    lab = lab.where(~held_out(F.col("_id"))).distinct()
    half = [lab.where(F.col("_label") == k).orderBy(F.xxhash64("_id"), "_id").limit(sample // 2) for k in (0, 1)]
    texts = docs.select(column(docs, "doc_id", "long").alias("_id"), F.coalesce(column(docs, "text", "string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(half[0].unionByName(half[1])), "_id")
    got = rows.select(F.col("_label").alias("label"), "text").mapInArrow(_feature_rows, "label int, idx array<int>").toArrow()
    label = np.array(got["label"].to_pylist(), np.int64)
    x = [np.asarray(r.as_py(), np.int64) for r in got["idx"]]
    if len(set(label.tolist())) < 2:
        share = float(label.mean()) if len(label) else 0.5
        return Model(np.zeros(DIM), 0.0, 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    counts = np.stack([np.bincount(np.concatenate([r for r, v in zip(x, label) if v == k]), minlength=DIM) + smooth for k in (0, 1)])
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    y = np.where(label == 1, 1.0, -1.0)
    share = (label == 1).mean()
    w, bias = dual_descent(x, y, ratio, np.where(label == 1, c * 0.5 / share, c * 0.5 / (1 - share)))
    model = Model(w * ratio, bias, 1.0, 0.0)
    m = model.margins(x)
    slope, shift = 2.0, 0.0
    for _ in range(200):  # Platt scaling on the sample
        p = 1 / (1 + np.exp(-np.clip(slope * m + shift, -30, 30)))
        g = p - (label * 0.98 + 0.01)
        slope, shift = slope - 0.5 * float((g * m).mean()), shift - 0.5 * float(g.mean())
    return Model(model.weights, bias, slope, shift)


def score(docs: DataFrame, model: Model, keep: Column) -> DataFrame:
    """(kept, score): the column `keep` and the score, 0 to 1, of each whole text
    (null: empty). The model is sent to the tasks once; its size is fixed by DIM."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias, model.slope, model.shift))
    rows = docs.select(keep.alias("kept"), F.coalesce(column(docs, "text", "string"), F.lit("")).alias("text"))

    def run(batches):
        m = Model(*sent.value)
        for batch in batches:
            for part in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(m.score(features(*raw(part.column(1)))))], ["kept", "score"])

    return rows.mapInArrow(run, StructType([rows.schema["kept"], StructField("score", DoubleType())]))


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of doc_id as text is divisible by 5 (a null id: not)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


THRESHOLD = 0.3


def quality(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.3) of every row. Null
    texts are empty, null ids aren't held out; equal texts score alike; without
    labels of both classes every text scores by their share."""
    out = score(docs, fit(docs, labels, **kw), column(docs, "doc_id", "long")).withColumnRenamed("kept", "doc_id")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """docs without those that the classifier rejects; all columns stay, whatever
    their names. Null texts are judged as empty ones, repeated rows alike; an
    empty table gives an empty table."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return score(docs, fit(docs, labels, **kw), row).where(F.col("score") >= THRESHOLD).select("kept.*")
