"""Semantic features from dense sentence vectors: learned from the corpus, or the user's own.

learn() factorises the corpus' table of sentences by terms at low rank, by subspace
iteration from a random start. Terms are hashed into BUCKETS columns, so all that
goes to the driver or to every task is a matrix of BUCKETS x (RANK + SPARE) numbers,
whatever the corpus. A sentence's vector is its unit row of weighted terms times the
basis. supplied() takes vectors of a table instead.

Sentences are those of more than 10 characters. A sentence without a term, or without
a supplied vector, has the zero vector, whose cosine with any other is 0."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import durable
from . import features

BUCKETS, RANK, SPARE, ROUNDS = 1 << 14, 32, 8, 4
#: Sums over the corpus are of multiples of 2**-20, so that they don't depend on the order of rows.
UNIT = 1 << 20
#: Cells of the table that a step forms vectors of, and sentences compared at a time.
CELLS, BLOCK = 1 << 15, 512


class Basis(NamedTuple):
    """idf of each bucket, the basis' vectors (buckets x rank), the share of the
    table's squares that each holds, and the number of sentences learned from."""

    idf: np.ndarray
    vectors: np.ndarray
    shares: np.ndarray
    n: int


def _sentences(docs: DataFrame, buckets: int, *more) -> DataFrame:
    ss = T.sentences(F.coalesce("text", F.lit("")), 10)
    ids = F.transform("_ss", lambda s: F.transform(T.lower_words(s), lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int")))
    return docs.select("doc_id", ss.alias("_ss"), *more).withColumn("b", ids)


def cells(column: pa.Array, idf: np.ndarray) -> tuple:
    """Of a column of documents' sentences of buckets: row, bucket and weight of each
    cell in order, and the number of sentences. Rows have length 1."""
    sentences = column.flatten()
    codes = sentences.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(len(sentences)), pc.list_value_length(sentences).to_numpy(zero_copy_only=False))
    cell, count = np.unique(rows * len(idf) + codes, return_counts=True)
    r, c = cell // len(idf), cell % len(idf)
    x = (1 + np.log(count)) * idf[c]
    norm = np.sqrt(np.bincount(r, x * x, len(sentences)))
    full = norm[r] > 0
    return r[full], c[full], x[full] / norm[r[full]], len(sentences)


def _blocks(r: np.ndarray):
    """Slices of about CELLS cells that end with a row."""
    a = 0
    while a < len(r):
        b = len(r) if a + CELLS >= len(r) else int(np.searchsorted(r, r[a + CELLS], "left"))
        b = b if b > a else int(np.searchsorted(r, r[a], "right"))
        yield slice(a, b)
        a = b


def times(r: np.ndarray, c: np.ndarray, x: np.ndarray, basis: np.ndarray):
    """Rows and their products with the basis, block by block, with the cells' slice."""
    for s in _blocks(r):
        first = np.flatnonzero(np.r_[True, np.diff(r[s]) > 0])
        yield s, r[s][first], np.add.reduceat(x[s, None] * basis[c[s]], first)


def _pass(table: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'A basis, summed by the tasks and then by bucket: one scan of the table and one
    shuffle of at most a row a bucket and task."""
    width = basis.shape[1]

    def sums(batches):
        z = np.zeros(basis.shape, np.int64)
        for batch in batches:
            r, c, x, _ = cells(batch.column(0), idf)
            for s, rows, y in times(r, c, x, basis):
                own = np.rint(UNIT * x[s, None] * y[np.searchsorted(rows, r[s])]).astype(np.int64)
                order = np.argsort(c[s], kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(c[s][order]) > 0])
                z[c[s][order][first]] += np.add.reduceat(own[order], first)
        some = np.flatnonzero(z.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some)] + [pa.array(z[some, i]) for i in range(width)], names=["bucket"] + [f"v{i}" for i in range(width)])

    names = [f"v{i}" for i in range(width)]
    got = table.select("b").mapInArrow(sums, "bucket long, " + ", ".join(f"{v} long" for v in names)).groupBy("bucket").agg(*[F.sum(v).alias(v) for v in names]).toArrow()
    out = np.zeros(basis.shape)
    out[got.column("bucket").to_numpy()] = np.stack([got.column(v).to_numpy() for v in names], 1) / UNIT
    return out


def learn(docs: DataFrame, rank: int = RANK, buckets: int = BUCKETS, rounds: int = ROUNDS, seed: int = 11) -> Basis:
    """The basis of all documents' sentences. Their buckets are written once and read
    by each of the rounds. Without a sentence of words all is zero."""
    table = durable(_sentences(docs.select("doc_id", "text"), buckets).select("b"), "sentence-terms")
    each = table.select(F.explode("b").alias("s"))
    df = np.zeros(buckets)
    for row in each.select(F.explode(F.array_distinct("s")).alias("b")).groupBy("b").count().collect():  # at most a row a bucket
        df[row.b] = row["count"]
    n = each.where(F.size("s") > 0).count()
    idf = np.where(df > 0, np.log1p(n / np.maximum(df, 1)), 0.0)
    width = min(rank + SPARE, buckets)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((buckets, width)))[0]
    if not n:
        return Basis(idf, np.zeros((buckets, rank)), np.zeros(rank), 0)
    for _ in range(rounds - 1):
        q = np.linalg.qr(_pass(table, idf, q))[0]
    g = q.T @ _pass(table, idf, q)
    values, turn = np.linalg.eigh((g + g.T) / 2)
    best = np.argsort(-values, kind="stable")[:rank]
    return Basis(idf, q @ turn[:, best], np.maximum(values[best], 0) / n, n)


def save(spark: SparkSession, basis: Basis, path: str) -> None:
    """Write the basis as a table: kind, id (bucket or vector), weight (idf or share), v, n."""
    rows = [("term", i, float(basis.idf[i]), basis.vectors[i].tolist(), basis.n) for i in range(len(basis.idf))]
    rows += [("vector", i, float(s), [], basis.n) for i, s in enumerate(basis.shares)]
    spark.createDataFrame(rows, "kind string, id int, weight double, v array<double>, n long").coalesce(1).write.parquet(path)


def load(spark: SparkSession, path: str) -> Basis:
    rows = spark.read.parquet(path).orderBy("kind", "id").collect()  # a row a bucket and vector
    terms, shares = [r for r in rows if r.kind == "term"], [r.weight for r in rows if r.kind == "vector"]
    return Basis(np.array([r.weight for r in terms]), np.array([r.v for r in terms]), np.array(shares), rows[0].n)


def vectors(docs: DataFrame, basis: Basis) -> DataFrame:
    """doc_id, idx, vec: each sentence's vector of length 1, or zero."""
    kind, rank = docs.schema["doc_id"].dataType.simpleString(), basis.vectors.shape[1]

    def rows(batches):
        for batch in batches:
            e = embed(batch.column(1), basis)
            n = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            ids = pc.take(batch.column(0), pa.array(np.repeat(np.arange(len(n)), n)))
            idx = np.arange(len(e)) - np.repeat(np.cumsum(n) - n, n)
            for a in range(0, len(e), CELLS):
                part = e[a : a + CELLS]
                vec = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * rank, pa.int32()), pa.array(part.ravel()))
                yield pa.RecordBatch.from_arrays([ids[a : a + CELLS], pa.array(idx[a : a + CELLS].astype(np.int32)), vec], names=["doc_id", "idx", "vec"])

    return _sentences(docs.select("doc_id", "text"), len(basis.idf)).select("doc_id", "b").mapInArrow(rows, f"doc_id {kind}, idx int, vec array<double>")


def embed(column: pa.Array, basis: Basis) -> np.ndarray:
    r, c, x, n = cells(column, basis.idf)
    e = np.zeros((n, basis.vectors.shape[1]))
    for _, rows, y in times(r, c, x, basis.vectors):
        e[rows] = y
    return unit(e)


def unit(e: np.ndarray) -> np.ndarray:
    norm = np.sqrt((e * e).sum(1, keepdims=True))
    return np.divide(e, norm, out=np.zeros_like(e), where=norm > 0)


def similarities(e: np.ndarray, words: np.ndarray) -> tuple:
    """Of a document's n >= 3 unit (or zero) vectors and its sentences' numbers of
    words: mean cosine of neighbours, variance of that over chunks, mean and mean
    square of all pairs' cosines, share of pairs j >= i + 2 above 0.8, and mean
    cosine of the first and last k = min(3, n / 3).

    Chunk k holds the sentences that begin within words 100 k to 100 k + 200, two at
    least. Mean and squares come from sums and from the Gram matrix of the
    dimensions; pairs above 0.8 are counted in blocks over different sentences,
    quadratic in their number."""
    n = len(e)
    near = (e[:-1] * e[1:]).sum(1)
    length = (e * e).sum(1)
    total, gram = e.sum(0), e.T @ e
    m1 = (total @ total - length.sum()) / (n * (n - 1.0))
    m2 = ((gram * gram).sum() - (length**2).sum()) / (n * (n - 1.0))
    kinds, many = np.unique(e[length > 0], axis=0, return_counts=True)
    many = many.astype(float)
    like = float((many * (many - 1) / 2).sum())
    for a in range(0, len(kinds), BLOCK):
        for b in range(a, len(kinds), BLOCK):
            g = kinds[a : a + BLOCK] @ kinds[b : b + BLOCK].T > 0.8000001
            w = many[a : a + BLOCK, None] * many[None, b : b + BLOCK] * g
            like += float(np.triu(w, 1).sum() if a == b else w.sum())
    like -= float((near > 0.8000001).sum())
    begin = np.cumsum(words) - words
    at = np.arange(0, max(1, int(words.sum())), 100)
    lo, hi = np.searchsorted(begin, at), np.searchsorted(begin, at + 200)
    some = hi - lo >= 2
    until = np.r_[0.0, np.cumsum(near)]
    chunks = (until[hi[some] - 1] - until[lo[some]]) / (hi[some] - lo[some] - 1)
    k = min(3, n // 3)
    return near.sum() / (n - 1), float(chunks.var()) if len(chunks) else 0.0, m1, m2, like / ((n - 1.0) * (n - 2.0) / 2), float(e[:k].sum(0) @ e[n - k :].sum(0)) / k**2


def _rows(vectors_of):
    """An Arrow function over doc_id, n_chars, words (of each sentence), low, keys, the
    column that vectors_of(column, counts) makes all sentences' vectors of, and kept ones."""

    def rows(batches):
        for big in batches:
            for at in range(0, len(big), 256):  # so that vectors of few documents are held
                batch = big.slice(at, 256)
                counts = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
                e = vectors_of(batch.column(5), counts)
                out = {k: [] for k in ("coh", "var", "m1", "m2", "rep", "drift", "ctx")}
                a = 0
                for n, words, low, keys in zip(counts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                    values = (*similarities(e[a : a + n], np.array(words)), features.context(keys, low)) if n >= 3 else [None] * 7
                    for v, x in zip(out.values(), values):
                        v.append(None if x is None else float(x))
                    a += n
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts.astype(np.int64))] + [pa.array(v, pa.float64()) for v in out.values()] + batch.columns[6:], names=["doc_id", "n_chars", "n", *out, *batch.schema.names[6:]])

    return rows


def _inputs(docs: DataFrame, column: str, keep: tuple[str, ...]) -> DataFrame:
    """docs with _ss and the column of vectors, as _rows reads them."""
    t = F.coalesce("text", F.lit(""))
    words = F.transform("_ss", lambda s: F.size(T.space_words(s)))
    return docs.select("doc_id", F.length(t).alias("n_chars"), words.alias("words"), F.transform("_ss", F.lower).alias("low"), T.keywords(t).alias("keys"), column, *keep)


def semantic(docs: DataFrame, basis: Basis, keep: tuple[str, ...] = ()) -> DataFrame:
    """The features of features.semantic over learned vectors, without a shuffle."""
    a = _inputs(_sentences(docs, len(basis.idf), "text", *[k for k in keep if k != "text"]), "b", keep)
    return features.semantic_scores(a.mapInArrow(_rows(lambda column, counts: embed(column, basis)), features.semantic_schema(docs, keep)), keep)


def _given(column: pa.Array, counts: np.ndarray) -> np.ndarray:
    given = column.to_pylist()
    width = max((len(s["vec"]) for d in given for s in d or () if s["vec"]), default=1)
    e, a = np.zeros((int(counts.sum()), width)), 0
    for n, d in zip(counts, given):
        own = max((len(s["vec"]) for s in d or () if s["vec"]), default=0)
        for s in reversed(d or ()):
            v = np.array(s["vec"] or [], float)
            if s["idx"] is not None and 0 <= s["idx"] < n and len(v) == own and np.isfinite(v).all():
                e[a + s["idx"], :own] = v
        a += n
    return unit(e)


def supplied(docs: DataFrame, table: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The same features over a table of sentences' vectors (doc_id, idx from 0, vec),
    gathered by document and joined by one shuffle of each side. Of several vectors of
    a sentence the smallest counts; null ones, those with null or non-finite numbers
    and those shorter than their document's longest count as missing."""
    doc = table.where(F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x))).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), F.transform("vec", lambda x: x.cast("double")).alias("vec")))).alias("_vs"))
    a = docs.select("doc_id", "text", *[k for k in keep if k != "text"]).withColumn("_ss", T.sentences(F.coalesce("text", F.lit("")), 10)).join(doc, "doc_id", "left")
    return features.semantic_scores(_inputs(a, "_vs", keep).mapInArrow(_rows(_given), features.semantic_schema(docs, keep)), keep)


#: DuckDB: the features of supplied(), from all pairs of a document's sentences; {deal} is
#: the condition that joins sentence s with its row v of the table of vectors.
SUPPLIED_SQL = """
e AS (SELECT s.doc_id, s.idx, len(list_filter(regexp_split_to_array(s.s, '\\s+'), lambda x: x <> '')) AS w, CAST(v.embedding AS DOUBLE[]) AS vec FROM sen10 s JOIN embeddings v ON {deal}),
begins AS (SELECT doc_id, idx, CAST(SUM(w) OVER (PARTITION BY doc_id ORDER BY idx) AS BIGINT) - w AS b FROM e),
cnt AS (SELECT doc_id, COUNT(*) AS n, least(3, COUNT(*) // 3) AS k FROM e GROUP BY doc_id HAVING COUNT(*) >= 3),
p AS (SELECT a.doc_id, a.idx AS i, b.idx AS j, list_cosine_similarity(a.vec, b.vec) AS c FROM e a JOIN e b ON b.doc_id = a.doc_id AND b.idx > a.idx),
all_pairs AS (SELECT p.doc_id, AVG(c) FILTER (j = i + 1) AS coh, AVG(c) AS m1, AVG(c * c) AS m2, COUNT(*) FILTER (j >= i + 2 AND c > 0.8000001) AS m, AVG(c) FILTER (i < k AND j >= n - k) AS ends FROM p JOIN cnt ON cnt.doc_id = p.doc_id GROUP BY p.doc_id),
own AS (SELECT p.doc_id, p.c, unnest(range(x.b // 100 - 1, x.b // 100 + 1)) AS chunk, y.b AS last FROM p JOIN begins x ON x.doc_id = p.doc_id AND x.idx = p.i JOIN begins y ON y.doc_id = p.doc_id AND y.idx = p.j WHERE p.j = p.i + 1),
vari AS (SELECT doc_id, VAR_POP(mu) AS v FROM (SELECT doc_id, chunk, AVG(c) AS mu FROM own WHERE chunk >= 0 AND last < 100 * chunk + 200 GROUP BY doc_id, chunk) q GROUP BY doc_id),
kw AS (SELECT doc_id, w FROM (SELECT doc_id, w, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY COUNT(*) DESC, MIN(pos)) AS r FROM keyword GROUP BY doc_id, w HAVING COUNT(*) > 1) q WHERE r <= 10),
ctx AS (SELECT doc_id, AVG(share) AS s FROM (SELECT k.doc_id, k.w, AVG(CASE WHEN INSTR(LOWER(s.s), k.w) > 0 THEN 1e0 ELSE 0e0 END) AS share FROM kw k JOIN sen10 s ON s.doc_id = k.doc_id GROUP BY k.doc_id, k.w) q GROUP BY doc_id)
SELECT d.doc_id, length(coalesce(d.text, '')) AS n_chars, ROUND(COALESCE(coh, 0.5) + 1e-9, 4) AS coherence_score, ROUND(CASE WHEN n IS NULL THEN 0.5 ELSE 1 - least(1e0, 5 * greatest(0e0, m2 - m1 * m1)) END + 1e-9, 4) AS consistency_score,
  ROUND(CASE WHEN n >= 5 THEN least(1e0, 3 * m / ((n - 1e0) * (n - 2e0) / 2)) ELSE 0e0 END + 1e-9, 4) AS repetition_score, ROUND(CASE WHEN n IS NULL THEN 0.5 ELSE greatest(0e0, 1 - ends) END + 1e-9, 4) AS topic_drift_score,
  ROUND(CASE WHEN n IS NULL THEN 0.5 ELSE COALESCE(x.s, 0) END + 1e-9, 4) AS contextual_consistency, ROUND(CASE WHEN n IS NULL THEN 0.1 ELSE COALESCE(v.v, 0) END + 1e-9, 4) AS coherence_variance, COALESCE(n, 0) AS num_sentences
FROM documents d LEFT JOIN cnt ON cnt.doc_id = d.doc_id LEFT JOIN all_pairs a ON a.doc_id = d.doc_id LEFT JOIN vari v ON v.doc_id = d.doc_id LEFT JOIN ctx x ON x.doc_id = d.doc_id
"""


def nearest(table: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, cosine: the k vectors (vec_id, vec) of the largest cosine
    with each of the queries (vec_id, vec), that of its own vec_id left out; cosines
    are rounded to 9 digits before they are ranked, ties go to the smaller vec_id.
    Vectors that are null, zero or hold null or non-finite numbers take no part.

    Queries are a stated set: they pass through the driver in blocks of at most 32 MB,
    a scan each, and all blocks are held until the plan has run. A task keeps k of its
    rows a query, so that what is shuffled grows with queries and tasks, not with pairs."""
    def good(d: DataFrame) -> DataFrame:
        bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return d.where(F.col("vec").isNotNull() & ~bad & F.exists("vec", lambda x: x != 0)).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("vec", lambda x: x.cast("double")).alias("vec"))

    rows, width = good(table), good(queries).agg(F.max(F.size("vec"))).first()[0] or 1
    step = max(1, (32 << 20) // (8 * width))
    spark, out = table.sparkSession, None
    schema = "query_id long, vec_id long, cosine double"
    block: list = []
    parts: list[DataFrame] = []

    def best(ids: np.ndarray, q: np.ndarray):
        def scan(batches):
            top_v, top_i = np.full((len(ids), 0), 0.0), np.full((len(ids), 0), 0)
            for big in batches:
                for at in range(0, len(big), 1024):
                    batch = big.slice(at, 1024)
                    same = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False) == q.shape[1]
                    batch = batch.filter(pa.array(same))
                    if not len(batch):
                        continue
                    own = batch.column(0).to_numpy()
                    x = unit(batch.column(1).flatten().to_numpy().reshape(len(own), -1))
                    v = np.round(q @ x.T, 9)
                    v[ids[:, None] == own[None, :]] = -np.inf
                    top_v, top_i = np.c_[top_v, v], np.c_[top_i, np.broadcast_to(own, v.shape)]
                    order = np.lexsort((top_i, -top_v), axis=1)[:, :k]
                    top_v, top_i = np.take_along_axis(top_v, order, 1), np.take_along_axis(top_i, order, 1)
            some = np.isfinite(top_v)
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], top_v.shape)[some]), pa.array(top_i[some]), pa.array(top_v[some])], names=["query_id", "vec_id", "cosine"])

        return rows.mapInArrow(scan, schema)

    def flush():
        for size in sorted({len(v) for _, v in block}):
            some = [(i, v) for i, v in block if len(v) == size]
            parts.append(best(np.array([i for i, _ in some], np.int64), unit(np.array([v for _, v in some]))))
        block.clear()

    for r in good(queries).toLocalIterator():
        block.append((r.vec_id, r.vec))
        if len(block) == step:
            flush()
    flush()
    for p in parts:
        out = p if out is None else out.unionByName(p)
    out = spark.createDataFrame([], schema) if out is None else out
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.round("cosine", 6).alias("cosine"))
