"""Near-duplicates by DartMinHash signatures and banded joining.

A document is a weighted set of word shingles: one that occurs tf times weighs
floor(log2(tf)) + 1, so a line repeated without end doesn't drown the rest.
Hashed darts fall on the region of each element (its weight, in unit cells, by a
rank axis); a document takes the darts of rank up to t / total weight, about t in
number, and keeps the earliest of those that hash to each coordinate, so only
elements hit are ever touched. Two documents agree at a coordinate with the
probability of their weighted Jaccard similarity. Documents with a band of
coordinates in common are candidates.

Equal sets count once, and no bucket forms all its pairs. Each bucket elects a
representative, the member that shares most buckets with others; members are
compared with it and linked. Two members of one representative r, not both linked
with it, can still be similar. Then their differences from r, D = x ^ r in cells,
must overlap by (|Dx| + |Dy| - (|x| + |y|) / 9) / 2 at least, which is a lot: most
of a difference is found in no other member. So differences are joined by prefix
filter: elements in ascending order of their frequency among the members of r,
and only as many of the first ones as an overlap of that size can't avoid. Pairs
in one component are left out; what passes is verified on whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import attach
from .common import U64, durable, keyed, mix, one_of, parts, pieces, prefix, raw, span_hash, word_hashes, words

SHINGLE, ROWS, BANDS = 5, 6, 32
SIZE = ROWS * BANDS
NONE = U64((1 << 64) - 1)
#: Members of a representative that one task compares with it.
PER_SALT = 500


def shingles(data: np.ndarray, offs: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of each document's cells, sorted by shingle: the regions
    of its shingles, cut into cells of weight 1. A document of fewer than `width`
    words is one shingle. The c-th cell of a shingle has an identity of its own,
    so common cells of two documents weigh the lesser of both weights."""
    start, end, at = words(data, offs)
    n = np.diff(at)
    grams = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), grams)
    if not len(doc):
        return np.zeros(0, U64), np.zeros(len(offs), np.int64)
    a = at[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(grams) - grams, grams)
    h = span_hash(prefix(word_hashes(data, start, end)), a, np.minimum(a + width, at[doc + 1]))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
    nth = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0)) + 1
    cell = (nth & (nth - 1)) == 0  # occurrences 1, 2, 4, 8, ... open a cell
    h, doc, nth = h[cell], doc[cell], nth[cell]
    more = nth > 1
    h[more] = mix(h[more] + nth[more].astype(U64) * U64(0x632BE59BD9B4E019))
    return h, np.searchsorted(doc, np.arange(len(n) + 1))


def darts(h: np.ndarray, offs: np.ndarray, size: int = SIZE) -> np.ndarray:
    """(documents x size) signatures: per coordinate the earliest dart, its rank
    above its identity in one number. Darts reach a cell as a Poisson process in
    rank, a region as that of all its cells. Documents without words keep NONE."""
    n = np.diff(offs)
    sig = np.full((len(n), size), NONE, U64)
    doc = np.repeat(np.arange(len(n)), n)
    reach = size * (np.log(size) + 2.5) / np.maximum(n, 1)
    todo = np.flatnonzero(n > 0)
    while len(todo):
        own = np.zeros(len(n), bool)
        own[todo] = True
        live = np.flatnonzero(own[doc])
        rank, k = np.zeros(len(live)), 0
        flat = sig.ravel()
        while len(live):
            key = h[live] + U64((k + 1) * 0xD1342543DE82EF95 % (1 << 64))
            u = mix(key)
            rank = rank - np.log(((u >> U64(11)).astype(np.float64) + 1) / float(1 << 53))
            keep = rank <= reach[doc[live]]
            live, rank, u = live[keep], rank[keep], u[keep]
            ident = mix(u ^ U64(0xA5A5A5A5A5A5A5A5))
            place = doc[live] * size + (ident >> U64(32)).astype(np.int64) % size
            value = (rank.astype(np.float32).view(np.uint32).astype(U64) << U64(32)) | (ident & U64(0xFFFFFFFF))
            np.minimum.at(flat, place, value)
            k += 1
        todo = todo[(sig[todo] == NONE).any(1)]
        sig[todo] = NONE
        reach[todo] *= 2
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(documents x bands) hashes of the bands."""
    s = sig.reshape(len(sig), BANDS, ROWS)
    key = np.arange(BANDS, dtype=U64)[None, :] * U64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        key = mix(key * U64(0xD6E8FEB86659FD93) + s[:, :, r])
    return key


def _signature_rows(batches):
    for batch in batches:
        for part in pieces(batch, "text"):
            h, offs = shingles(*raw(part.column(2)))
            sig, n = darts(h, offs), np.diff(offs)
            bands = band_keys(sig)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(identities(h, offs)), bands], names=["doc_id", "h", "n", "v", "bands"])


def identities(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A 64-bit identity of each document's cells: a sum of mixed hashes."""
    pre = np.concatenate((np.zeros(1, U64), np.cumsum(mix(h + U64(1)), dtype=U64)))
    return mix(pre[offs[1:]] - pre[offs[:-1]]).view(np.int64)


def _compare(batches):
    """Rows of (rep, v, m, text), each rep's own (v = rep) before its members:
    rep, v, rn and n (weights of both), a (weight of the difference), linked,
    delta (the difference's cells; null where rep has no other member)."""
    rep, own = None, np.zeros(0, U64)
    for batch in batches:
        for part in pieces(batch, "text", 1 << 19):
            h, offs = shingles(*raw(part.column(3)))
            out = {"rep": [], "v": [], "rn": [], "n": [], "a": [], "linked": []}
            deltas, ends = [], [0]
            for i, (r, v, m) in enumerate(zip(*(part.column(k).to_pylist() for k in range(3)))):
                cells = np.sort(h[offs[i] : offs[i + 1]])
                if v == r:
                    rep, own = r, cells
                    continue
                assert rep == r, "a member came without its representative"
                delta = np.setxor1d(own, cells, assume_unique=True)
                both = len(own) + len(cells)
                for k, x in zip(out, (r, v, len(own), len(cells), len(delta), 9 * len(delta) <= both)):
                    out[k].append(x)
                ends.append(ends[-1] + (len(delta) if m > 1 else 0))
                deltas.append(delta.view(np.int64) if m > 1 else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(deltas) if deltas else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.bool_() if k == "linked" else pa.int64()) for k, x in out.items()] + [lists], names=[*out, "delta"])


def _verify(batches):
    """Pairs (a, b, ta, tb) of similarity 0.8 or more: |x ^ y| <= (|x| + |y|) / 9."""
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        for part in pieces(batch, "ta", 1 << 19):
            (x, at), (y, to) = shingles(*raw(part.column(2))), shingles(*raw(part.column(3)))
            apart = [len(np.setxor1d(x[at[i] : at[i + 1]], y[to[i] : to[i + 1]], assume_unique=True)) for i in range(part.num_rows)]
            ok = 9 * np.array(apart, np.int64) <= np.diff(at) + np.diff(to)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], schema=kind).filter(pa.array(ok))


def components(edges: DataFrame) -> DataFrame:
    """(v, comp) of all vertices of edges (a, b): the least vertex reachable.
    Least labels spread over the edges and along labels until none changes."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = durable(both, "edges")
    labels = durable(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp")).withColumnRenamed("a", "v"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("comp").alias("near"))
        jump = labels.select(F.col("v").alias("comp"), F.col("comp").alias("over"))
        new = labels.join(near, labels["v"] == near["a"]).join(jump, "comp").select("v", F.least("comp", "near", "over").alias("new"), "comp")
        new = durable(new, "labels")
        if new.where("new < comp").isEmpty():
            return labels
        labels = new.select("v", F.col("new").alias("comp"))


def _buckets(heads: DataFrame) -> DataFrame:
    """(rep, v): every set beside the representatives of the buckets it is in."""
    rows = heads.where("n > 0").select("v", F.explode("bands").alias("b"))
    shared = durable(rows.join(rows.groupBy("b").agg(F.count("*").alias("m")).where("m > 1"), "b"), "buckets")
    known = shared.groupBy("v").agg(F.sum("m").alias("near"))
    reps = shared.join(known, "v").groupBy("b").agg(F.max(F.struct("near", "v")).alias("top")).select("b", F.col("top.v").alias("rep"))
    return durable(shared.join(reps, "b").where("v <> rep").select("rep", "v").distinct(), "members")


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """_compare's rows of all pairs (rep, v). A representative's text goes to one
    task for every PER_SALT members, each member's once for each representative."""
    rows = pairs.join(pairs.groupBy("rep").agg(F.count("*").alias("m")), "rep")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("v"), F.ceil(F.col("m") / PER_SALT)))
    heads = rows.groupBy("rep", "salt").agg(F.first("m").alias("m")).select("rep", F.col("rep").alias("v"), "m", "salt")
    rows = rows.select("rep", "v", "m", "salt").unionByName(heads).join(texts, "v")
    rows = rows.repartition(parts(rows), "rep", "salt").sortWithinPartitions("rep", "salt", F.col("v") != F.col("rep"))
    return rows.select("rep", "v", "m", "text").mapInArrow(_compare, "rep long, v long, rn long, n long, a long, linked boolean, delta array<long>")


def _level(a):
    """Weights of differences by halves of an octave."""
    return F.floor(2 * F.log2(a)).cast("int")


def _crossing(compared: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b): pairs of members of one representative, in two components, whose
    differences from it can overlap enough. An element is listed by the levels of
    both differences, so that a pair meets only where both prefixes hold it."""
    failed = compared.groupBy("rep").agg(F.count("*").alias("m"), F.count_if(~F.col("linked")).alias("failed")).where("m > 1 and failed > 0").select("rep")
    some = compared.join(failed, "rep")
    cells = some.select("rep", "v", F.explode("delta").alias("e"))
    often = cells.groupBy("rep", "e").agg(F.count("*").alias("df")).where("df > 1")
    lists = cells.join(often, ["rep", "e"]).groupBy("rep", "v").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("els"))
    x = some.drop("delta").join(lists, ["rep", "v"]).join(labels, "v", "left").withColumn("comp", F.coalesce("comp", "v"))
    # |x ^ y| <= (|x| + |y|) / 9 <= |x| / 4; of a linked x the other isn't linked
    least = F.greatest(F.lit(1.0), F.col("a") - F.col("n") / 4, F.when(F.col("linked"), (0.8 * F.col("n") + F.col("rn")) / 9).otherwise(1.0))
    x = x.withColumn("least", least).where("least <= a + n / 4")
    x = x.withColumn("lv", _level(F.col("a"))).withColumn("pl", F.explode(F.sequence(_level(F.col("least")), _level(F.col("a") + F.col("n") / 4))))
    other = F.greatest(F.col("least"), F.floor(F.pow(2.0, F.col("pl") / 2)))
    need = F.greatest(F.lit(1), F.ceil((F.col("a") + other - F.col("n") / 4) / 2 - 1e-9)).cast("int")
    x = x.withColumn("take", F.size("els") - need + 1).where("take > 0").withColumn("c", F.size("els"))
    x = x.select("rep", "v", "comp", "n", "a", "c", "lv", "pl", F.posexplode(F.slice("els", 1, F.col("take"))).alias("k", "el"))
    key = ["rep", "e", "lo", "hi"]
    x = x.select("rep", F.col("el.e").alias("e"), F.least("lv", "pl").alias("lo"), F.greatest("lv", "pl").alias("hi"), "lv", "v", "comp", "n", "a", (F.col("c") - F.col("k")).alias("left"))
    x = durable(x, "prefixes")
    # all pairs of two components have a side outside the group's largest one
    most = x.groupBy(*key, "comp").agg(F.count("*").alias("m"), F.min("lv").alias("lv"), F.max("lv").alias("to"))
    most = most.groupBy(*key).agg(F.count("*").alias("sides"), F.max(F.struct("m", "comp")).alias("top"), F.min("lv").alias("lv"), F.max("to").alias("to"))
    most = most.where("sides > 1 and lv = lo and to = hi").select(*key, F.col("top.comp").alias("top"))  # both levels are there
    open_ = durable(x.join(most, key), "open-prefixes")
    few = open_.where("comp <> top").select(*[F.col(c).alias("_" + c) for c in (*key, "lv", "v", "comp", "n", "a", "left")])
    same = [open_[c] == few["_" + c] for c in key]
    sides = (open_["lv"] + few["_lv"] == open_["lo"] + open_["hi"]) & (F.col("comp") != F.col("_comp"))
    enough = 18 * F.least("left", "_left") >= 9 * (F.col("a") + F.col("_a")) - F.col("n") - F.col("_n")
    met = open_.join(few, [*same, sides, enough, 5 * F.least("n", "_n") >= 4 * F.greatest("n", "_n")])
    return met.select(F.least("v", "_v").alias("a"), F.greatest("v", "_v").alias("b")).distinct()


def near_classes(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, h, class_id, class_size, kept.

    A class is a connected component of the documents whose weighted sets of
    five-word shingles have a Jaccard similarity of 0.8 or more (equal sets
    included; all documents without a word are one class; shorter documents are
    one shingle). class_id is the smallest doc_id of the class (null first); kept
    marks its row, or rows where that doc_id and text repeat. Signatures miss a
    pair of similarity 0.8 with probability 6e-5, more similar ones with less;
    of the pairs that share a band no link between two classes is lost. Sets are
    told apart by 64-bit hashes. Null text is empty, other columns are ignored,
    an empty table gives an empty table."""
    rows = keyed(docs)
    sig = durable(rows.mapInArrow(_signature_rows, "doc_id long, h long, n long, v long, bands array<long>"), "signatures")
    order = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), "h", "doc_id")
    heads = durable(sig.groupBy("v").agg(F.count("*").alias("copies"), F.min(order).alias("head"), F.first("n").alias("n"), F.first("bands").alias("bands")), "sets")
    pairs = _buckets(heads)
    used = pairs.select(F.explode(F.array("rep", "v")).alias("v")).distinct().join(heads.select("v", "head.doc_id", "head.h"), "v")
    texts = durable(attach(rows, used, "inner").select("v", "text").dropDuplicates(["v"]), "bucket-texts")
    compared = durable(_compared(pairs, texts), "compared")
    labels = components(compared.where("linked").select(F.col("rep").alias("a"), F.col("v").alias("b")))
    crossing = _crossing(compared, labels)
    crossing = crossing.join(texts.select(F.col("v").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("v").alias("b"), F.col("text").alias("tb")), "b")
    more = durable(crossing.select("a", "b", "ta", "tb").mapInArrow(_verify, "a long, b long"), "links")
    own = heads.join(labels, "v", "left").select("v", "copies", "head", F.coalesce("comp", "v").alias("comp"))
    if not more.isEmpty():  # links between components
        side = lambda c: labels.select(F.col("v").alias(c), F.col("comp").alias("_" + c))
        ends = more.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
        joined = components(ends.distinct()).select(F.col("v").alias("comp"), F.col("comp").alias("over"))
        own = own.join(joined, "comp", "left").select("v", "copies", "head", F.coalesce("over", "comp").alias("comp"))
    own = durable(own, "classes")
    best = own.groupBy("comp").agg(F.sum("copies").alias("class_size"), F.min("head").alias("best"))
    classes = durable(own.join(best, "comp").select("v", "class_size", "best"), "classes")
    out = sig.select("doc_id", "h", "v").join(classes, "v")
    kept = (F.coalesce("doc_id", F.lit(-(1 << 63))) == F.col("best.k")) & (F.col("h") == F.col("best.h"))
    return out.select("doc_id", "h", F.col("best.doc_id").alias("class_id"), "class_size", kept.alias("kept"))


def drop_near(docs: DataFrame) -> DataFrame:
    """docs with one row of each class of near_classes, all columns whatever their
    names. Of rows equal in doc_id and text any one stays; null texts are empty
    and near-duplicates of each other; an empty table gives an empty table."""
    keep = near_classes(docs).where("kept").select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), F.col("h").alias("x")).distinct()
    return one_of(docs, keep)
