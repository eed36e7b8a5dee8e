"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length: a range partitioning on the norm, cut into blocks.
The longest vectors give each query a first lower bound of its k-th score. A
block is skipped for a query if even its longest vector can't reach that bound;
otherwise the local cosine threshold bound / (|q| * longest) picks the pruning:
a low one leaves length pruning, a high one coordinate pruning (the products on
the query's largest coordinates, and Cauchy-Schwarz for the rest). What is left
is verified by exact integer products.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, parts

FOCUS, STEEP, BLOCK = 8, 0.35, 4096


def scaled(v: Column) -> Column:
    """floor(1024 * x) of each component; null for a vector that takes no part."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(v.isNotNull() & ~bad, F.transform(v, lambda x: F.floor(x.cast("double") * 1024.0).cast("long")))


def best(q: np.ndarray, p: np.ndarray, ids: np.ndarray, q_ids: np.ndarray, bound: np.ndarray, k: int):
    """For each query the k best rows of a block whose score is at least its
    bound, ties to the smaller id: (query index, id, score) arrays. bound is
    raised in place where k rows are found. Scores are exact while
    dimensions * (1024 * largest component)**2 is under 2**63."""
    pn, qn = np.sqrt((p.astype(float) ** 2).sum(1)), np.sqrt((q.astype(float) ** 2).sum(1))
    longest, out = pn.max(initial=0.0), []
    for i in range(len(q)):
        least = bound[i]
        slack = 1e-6 * (1.0 + abs(least))
        local = least / (qn[i] * longest) if qn[i] * longest > 0 else -np.inf
        if local > 1 + 1e-9:
            continue
        if local < STEEP or q.shape[1] <= FOCUS:
            rows = np.flatnonzero(pn * qn[i] >= least - slack) if least > 0 else np.arange(len(p))
        else:
            f = np.argpartition(-np.abs(q[i]), FOCUS)[:FOCUS]
            near = p[:, f].astype(float)
            rest = np.sqrt(np.maximum(0, qn[i] ** 2 - (q[i, f].astype(float) ** 2).sum())) * np.sqrt(np.maximum(0, pn**2 - (near**2).sum(1)))
            rows = np.flatnonzero(near @ q[i, f].astype(float) + rest >= least - slack)
        rows = rows[ids[rows] != q_ids[i]]
        score = p[rows] @ q[i]
        rows, score = rows[score >= least], score[score >= least]
        order = np.lexsort((ids[rows], -score))[:k]
        if len(order) == k:
            bound[i] = max(bound[i], float(score[order[-1]]))
        out.append((np.full(len(order), i), ids[rows[order]], score[order]))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3


def _blocks(batches):
    """Rows sorted by norm to blocks: dim, longest, n, ids and vectors as binary."""
    kind = pa.schema([("dim", pa.int32()), ("longest", pa.float64()), ("ids", pa.binary()), ("vectors", pa.binary())])
    for batch in batches:
        dims = np.array([len(v) for v in batch.column(1)], np.int64)
        for d in np.unique(dims):
            own = np.flatnonzero(dims == d)
            for a in range(0, len(own), BLOCK):
                part = batch.take(pa.array(own[a : a + BLOCK]))
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(len(part), d)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype("<i8")
                yield pa.RecordBatch.from_pylist([{"dim": int(d), "longest": float(np.sqrt((v.astype(float) ** 2).sum(1)).max()), "ids": ids.tobytes(), "vectors": v.tobytes()}], schema=kind)


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, chunk: int = 1 << 26) -> DataFrame:
    """query_id, rank, vec_id, score of the rows of (vec_id, embedding) whose
    vec_id is divisible by `every`, against all rows of another vec_id.

    Null vec_ids and vectors that are null or hold null or non-finite
    components take no part; vectors of another dimension are no candidates of a
    query. A repeated candidate row counts again; of a repeated query vec_id the
    smallest vector asks. An empty table gives an empty table. Queries are sent
    to the tasks in chunks of about `chunk` bytes of components, so what is
    broadcast is bounded; the buckets are scanned once for each chunk."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding")).alias("v")).where("vec_id is not null and v is not null")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    buckets = rows.withColumn("norm", norm).repartitionByRange(parts(vectors), F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    blocks = durable(buckets.select("vec_id", "v").mapInArrow(_blocks, "dim int, longest double, ids binary, vectors binary"), "norm-buckets")
    asks = durable(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    n_chunks = max(1, -(-8 * (asks.agg(F.sum(F.size("v"))).first()[0] or 0) // chunk))
    out = None
    for c in range(n_chunks):
        own = asks.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_chunks)) == c).groupBy(F.size("v").alias("dim")).agg(F.collect_list(F.struct("vec_id", "v")).alias("q"))
        found = _search(blocks, own, k)
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(blocks: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """Matches of one chunk of queries (a row per dimension) in all blocks."""
    queries = {r["dim"]: (np.array([x["vec_id"] for x in r["q"]], np.int64), np.array([x["v"] for x in r["q"]], np.int64).reshape(len(r["q"]), r["dim"])) for r in asks.collect()}
    bounds = {}
    for d, (q_ids, q) in queries.items():  # the block of the longest vectors of this dimension
        first = blocks.where(F.col("dim") == d).orderBy(F.desc("longest")).limit(1).collect()[0]
        bound = np.full(len(q), -np.inf)
        ids = np.frombuffer(first["ids"], "<i8")
        best(q, np.frombuffer(first["vectors"], "<i8").reshape(len(ids), d), ids, q_ids, bound, k)
        bounds[d] = bound
    sent = blocks.sparkSession.sparkContext.broadcast((queries, bounds))

    def run(parts):
        queries, bounds = sent.value
        bounds = {d: b.copy() for d, b in bounds.items()}
        for pdf in parts:
            for r in pdf.sort_values("longest", ascending=False).itertuples():
                if r.dim in queries:
                    q_ids, q = queries[r.dim]
                    ids = np.frombuffer(r.ids, "<i8")
                    i, vec, score = best(q, np.frombuffer(r.vectors, "<i8").reshape(len(ids), r.dim), ids, q_ids, bounds[r.dim], k)
                    yield pd.DataFrame({"query_id": q_ids[i.astype(np.int64)], "vec_id": vec, "score": score})

    return blocks.mapInPandas(run, "query_id long, vec_id long, score long")
