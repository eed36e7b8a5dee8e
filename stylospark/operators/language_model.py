"""Likelihood features by a bigram model of the corpus itself.

For the features the documents are read once, in blocks of about a million words: a block
keeps its words as codes, its different pairs of neighbours with their counts, and which of
them each place has, also after a perturbation. A block's pairs are dealt by hash into
buckets, one row a block and bucket, which add up the counts of equal pairs; a block gets
back those that others have too. So a pair of words is shuffled once a block, not once an
occurrence, and the sums of a document are made where its block is. Arrays leave their task
packed: the JVM, which holds whole rows, and the shuffle get a fraction of their bytes.

model() counts the same as two tables, for what asks for pairs of any words."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable, small_batches
from . import scan, tokens
from .features import let

ROUNDS = 3
#: Words of a block.
BLOCK = 1 << 20
#: Rows of pairs in a batch.
_ROWS = 1 << 17
#: Bytes of blocks that the writer holds, and after how many of them it looks: by default after a hundred.
_WRITTEN = {"compression": "none", "parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "4"}


def _packed(x: np.ndarray) -> bytes:
    """An array of integers, the first bytes of all before the second ones, compressed."""
    x = np.ascontiguousarray(x)
    return len(x).to_bytes(8, "little") + pa.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), "zstd", asbytes=True)


def _ints(x: pa.Scalar | bytes, kind: type = np.int32) -> np.ndarray:
    """What was packed."""
    x = memoryview(x.as_buffer() if isinstance(x, pa.Scalar) else x)
    n, width = int.from_bytes(x[:8], "little"), np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(x[8:], n * width, "zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n).T).view(kind).ravel()


def _rising(x: np.ndarray) -> bytes:
    """_packed() of an array of mostly small steps, which _risen() reads."""
    return _packed(np.diff(x, prepend=x.dtype.type(0)))


def _risen(x: pa.Scalar | bytes, kind: type = np.int32) -> np.ndarray:
    return np.cumsum(_ints(x, kind), dtype=kind)


def _pair_rows(batches):
    for b in batches:
        for vocab, p1, p2, c in zip(*b.columns):
            c = _ints(c)
            on = c > 0
            p1, p2, c = _risen(p1)[on], _ints(p2)[on], c[on]
            for a in range(0, len(c), _ROWS):
                own = slice(a, a + _ROWS)
                yield pa.RecordBatch.from_arrays([vocab.values.take(pa.array(p[own])) for p in (p1, p2)] + [pa.array(c[own], pa.int64())], names=["w", "w2", "c"])


def _word_rows(batches):
    for b in batches:
        for vocab, c, last in zip(*b.columns):
            yield pa.RecordBatch.from_arrays([vocab.values, *[pa.array(_ints(x), pa.int64()) for x in (c, last)]], names=["w", "c", "last"])


def model(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs: w, w2, nll, before; words: w, floor): negative log-likelihoods of the pairs
    seen, and of a word after one that it wasn't seen after: 0.7 bigram + 0.3
    unigram with one added; before: place among the words before w2, the likeliest first. The
    corpus (documents, or blocks() of them) is counted by block; its pairs are shuffled by
    their first word, then by their second. The two tables lie in the shared folder: what uses
    them reads no document again."""
    b = docs if "vocab" in docs.columns else blocks(docs, 0)
    words = b.select("vocab", "words", "last").mapInArrow(_word_rows, "w string, c long, last long").groupBy("w").agg(F.sum("c").alias("c"), F.sum("last").alias("last"))
    words = durable(words, "words-counted")
    size = words.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    words = words.select("w", (F.col("c") - F.col("last")).alias("ctx"), (0.3 * (F.col("c") + 1) / ((size.n or 0) + size.v)).alias("one"))
    seen = b.select("vocab", "p1", "p2", "count").mapInArrow(_pair_rows, "w string, w2 string, c long").repartition("w").groupBy("w", "w2").agg(F.sum("c").alias("c"))
    pairs = seen.join(words.withColumnRenamed("one", "own"), "w").join(words.select(F.col("w").alias("w2"), "one"), "w2")
    pairs = pairs.select("w", "w2", (-F.log(0.7 * F.col("c") / F.col("ctx") + F.col("one"))).alias("nll"), "own")
    order = Window.partitionBy("w2").orderBy(F.round(F.col("nll") + -F.log("own"), 9), "w")
    return durable(pairs.select("w", "w2", "nll", F.row_number().over(order).alias("before")), "pairs-model"), words.select("w", (-F.log("one")).alias("floor"))


def _left(doc: np.ndarray, at: np.ndarray, size: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which words perturbation k leaves, of words at the places `at` of documents of `size`
    words: of every 1,000 words the tenth with the least hashes goes, of a text's first 1,000
    at least one; a text of up to five words has no perturbation."""
    h = np.fmod((ids[doc] + 17) * 7919 + k * 104729 + at * 15485863, 1000003)
    run = np.cumsum((at % 1000 == 0).astype(np.int64)) - 1
    order = np.argsort(run * 2000006 + h + 1000003, kind="stable")
    start = np.flatnonzero(at % 1000 == 0)
    long = np.diff(np.append(start, len(at)))
    gone = np.maximum(long // 10, at[start] == 0)
    left = np.empty(len(at), bool)
    left[order] = np.arange(len(at)) - start[run] >= gone[run]
    return left & (size[doc] > 5)


_INTS = ("p1", "p2", "count", "words", "last", "size", "slot", "sid", "made_slot", "made_at")
_BYTES = ("own", "made_k")
_RISING = ("p1", "made_at")
_COUNTED = "block long, n long, vocab array<string>, ids array<{}>, " + ", ".join(f"{c} binary" for c in (*_INTS, *_BYTES))


def _block(number: int, ids: pa.Array, sents: np.ndarray, sizes: np.ndarray, ok: np.ndarray, words: pa.Array, n: int) -> pa.RecordBatch:
    """The row of a block: documents of `sents` sentences of `sizes` words, ok: of over 20 characters."""
    code = pc.dictionary_encode(words)
    # in order, words next to each other are alike, which packs them better
    order = pc.sort_indices(code.dictionary).to_numpy().astype(np.int64)
    vocab, rank = code.dictionary.take(pa.array(order)), np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    code = rank[code.indices.to_numpy()]
    v, of = len(vocab), np.repeat(np.arange(len(ids)), sents)
    size = np.bincount(of, sizes, len(ids)).astype(np.int64)
    doc, sent = np.repeat(np.arange(len(ids)), size), np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(code)) - (np.cumsum(size) - size)[doc]
    here = np.flatnonzero(doc[:-1] == doc[1:])
    sid = np.where((sent[here] == sent[here + 1]) & ok[sent[here]], sent[here], -1)
    number_of = ids.cast(pa.int64(), safe=False).fill_null(0).to_numpy(zero_copy_only=False)
    bits, made = np.zeros(len(code), np.uint8), [(np.zeros(0, np.int64),) * 2]
    for k in range(1, n + 1):
        left = _left(doc, at, size, number_of, k)
        bits |= left.astype(np.uint8) << k
        kept = np.flatnonzero(left)
        p, q = kept[:-1], kept[1:]
        jump = (q > p + 1) & (doc[p] == doc[q])
        made.append((p[jump], q[jump]))
    p, q = (np.concatenate([x[i] for x in made]) for i in (0, 1))
    key, slot = np.unique(np.concatenate((code[here] * v + code[here + 1], code[p] * v + code[q])), return_inverse=True)
    place = np.zeros(len(code), np.int64)
    place[here] = np.arange(len(here))
    many = size > 1
    out = {
        "p1": key // max(1, v), "p2": key % max(1, v), "count": np.bincount(slot[: len(here)], minlength=len(key)), "words": np.bincount(code, minlength=v), "last": np.bincount(code[(np.cumsum(size) - 1)[size > 0]], minlength=v),
        "size": size[many] - 1, "slot": slot[: len(here)], "sid": sid, "made_slot": slot[len(here) :], "made_at": place[p],
    }
    small = {"own": bits[here] & bits[here + 1], "made_k": np.repeat(np.arange(len(made)), [len(x[0]) for x in made]).astype(np.uint8)}
    data = [(_rising if c in _RISING else _packed)(out[c].astype(np.int32)) for c in _INTS] + [_packed(small[c]) for c in _BYTES]
    kept = ids.filter(pa.array(many))
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (vocab, kept)]
    return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([len(code)]), *lists, *[pa.array([d], pa.binary()) for d in data]], names=["block", "n", "vocab", "ids", *_INTS, *_BYTES])


def blocks(docs: DataFrame, n: int = ROUNDS) -> DataFrame:
    """A row for each block of documents, in the shared folder; texts without words have none."""

    def made(batches):
        number, held, full = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            for rows, x in scan.scans(b.column(1), b.column(2)):
                ids, sents, ok = b.column(0).take(rows), np.append(0, np.cumsum(x.sents)), x.chars > 20
                size = np.append(0, np.cumsum(x.sizes))[sents]
                a = 0
                while a < len(ids):
                    e = max(a + 1, int(np.searchsorted(size, size[a] + BLOCK - full, "right")) - 1)
                    own = slice(sents[a], sents[e])
                    held.append((ids.slice(a, e - a), x.sents[a:e], x.sizes[own], ok[own], x.words.slice(size[a], size[e] - size[a])))
                    full, a = full + len(held[-1][4]), e
                    if full >= BLOCK or a < len(ids):
                        yield joined(number, held)
                        number, held, full = number + 1, [], 0
        if full:
            yield joined(number, held)

    def joined(number, held):
        ids, sents, sizes, ok, words = zip(*held)
        return _block(number, pa.concat_arrays(ids), np.concatenate(sents), np.concatenate(sizes), np.concatenate(ok), pa.concat_arrays(words), n)

    small_batches(docs.sparkSession)
    a = tokens.spread(docs.select("doc_id", "text")).select("doc_id", *scan.columns(F.coalesce("text", F.lit(""))))
    return durable(a.mapInArrow(made, _COUNTED.format(docs.schema["doc_id"].dataType.simpleString())), "blocks", **_WRITTEN)


_DEALT = "bucket long, block long, words binary, a binary, b binary, slot binary, c binary"
_SUMMED = "block long, slot binary, total binary"


def _joined(words: pa.Array) -> bytes:
    """Words, packed: none of them has a line end."""
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_buffer()
    return text.size.to_bytes(8, "little") + pa.compress(text, "zstd", asbytes=True)


def _parted(x: pa.Scalar) -> pa.Array:
    text = _ints(x, np.uint8).tobytes().decode()
    return pc.split_pattern(pa.array([text] if text else [], pa.string()), "\n").values


def _dealt(buckets: int):
    """Pairs, words (second code -1) and last words (-2) of each block, a row for each bucket."""

    def rows(batches):
        for b in batches:
            for i in range(b.num_rows):
                x = {c: b.column(b.schema.get_field_index(c))[i] for c in b.schema.names}
                vocab = x["vocab"].values
                v = len(vocab)
                h = pd.util.hash_array(np.append(vocab.to_numpy(zero_copy_only=False), ["", " "]).astype(object), categorize=False)
                every = np.arange(v, dtype=np.int32)
                one = np.concatenate((_risen(x["p1"]), every, every))
                two = np.concatenate((_ints(x["p2"]), np.full(v, -1, np.int32), np.full(v, -2, np.int32)))
                c = np.concatenate([_ints(x[k]) for k in ("count", "words", "last")])
                to = (((h[one] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[two] * np.uint64(0xBF58476D1CE4E5B9))) >> np.uint64(33)) % np.uint64(buckets)
                order = np.argsort(to.astype(np.int32), kind="stable").astype(np.int32)
                ends = np.append(0, np.cumsum(np.bincount(to.astype(np.int32), minlength=buckets)))
                near, used, out, block = np.zeros(v + 2, np.int32), np.zeros(v + 2, bool), [], x["block"].as_py()
                near[v], near[v + 1] = -2, -1
                for k in range(buckets):
                    s = order[ends[k] : ends[k + 1]]
                    used[one[s]] = used[two[s]] = True
                    used[v:] = False
                    local = np.flatnonzero(used)
                    near[local], used[local] = np.arange(len(local)), False
                    out.append((k, block, _joined(vocab.take(pa.array(local))), _rising(near[one[s]]), _packed(near[two[s]]), _rising(s), _packed(c[s])))
                yield pa.RecordBatch.from_arrays([pa.array(y, pa.int64() if j < 2 else pa.binary()) for j, y in enumerate(zip(*out))], names=[c.split()[0] for c in _DEALT.split(", ")])

    return rows


#: Of a bucket one in so many words at a time is looked at as the first of a pair.
_TURNS = 4


def _summed(t: pa.Table) -> pa.Table:
    """Of a bucket, the counts over all blocks of what several blocks have, by block."""
    part = lambda c, f: [f(x) for x in t[c]]
    words = [_parted(x) for x in t["words"]]
    n = np.array([len(w) for w in words])
    words = pc.dictionary_encode(pa.concat_arrays(words))
    v, code = len(words.dictionary), words.indices.to_numpy()
    first, second = part("a", _risen), part("b", _ints)
    size, shift = np.array([len(x) for x in first]), np.cumsum(n) - n
    one = np.concatenate([code[x + k] for x, k in zip(first, shift)])
    two = np.concatenate([np.where(x < 0, x + v + 2, code[np.maximum(x, 0) + k]) for x, k in zip(second, shift)]).astype(np.int32)
    del words, first, second
    c = np.concatenate(part("c", _ints))
    total = np.empty(len(c), np.int64)
    for turn in range(_TURNS):
        i = np.flatnonzero(one % _TURNS == turn)
        _, kind = np.unique(one[i].astype(np.int64) * (v + 2) + two[i], return_inverse=True)
        total[i] = np.bincount(kind, c[i])[kind]
    rows = []
    for x, e, m in zip(t["slot"], np.cumsum(size), size):
        own = slice(e - m, e)
        more = total[own] > c[own]
        rows.append((_rising(_risen(x)[more]), _packed(total[own][more])))
    return pa.table({"block": t["block"], "slot": pa.array([r[0] for r in rows], pa.binary()), "total": pa.array([r[1] for r in rows], pa.binary())})


_SUMS = "doc_id {}, c long, s double, dels array<double>, chunks array<double>, spread array<double>, sn long, smu double, sd double, lo double, hi double"


def _lists(of: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(of, minlength=n))), pa.int32()), pa.array(values, pa.float64()))


def _sums(n: int, size: float):
    """The sums of a block's documents, from its row and the counts it got back; size: words
    of the corpus and different ones."""

    def made(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [_of_block({c: left[c][i] for c in left.column_names}, right, n, size) for i in range(left.num_rows)]
        return pa.concat_tables(out)

    return made


def _of_block(x: dict, right: pa.Table, n: int, size: float) -> pa.Table:
    a = {c: (_risen if c in _RISING else _ints)(x[c]) for c in _INTS} | {c: _ints(x[c], np.uint8) for c in _BYTES}
    u, v, ids = len(a["p1"]), len(a["words"]), x["ids"].values
    c = np.concatenate((a["count"], a["words"], a["last"])).astype(np.int64)
    for s, t in zip(right["slot"], right["total"]):
        c[_risen(s)] = _ints(t, np.int64)
    seen, words, ctx = c[:u], c[u : u + v], c[u : u + v] - c[u + v :]
    nll = -np.log(0.7 * seen / np.maximum(ctx, 1)[a["p1"]] + 0.3 * (words[a["p2"]] + 1) / size)
    d, pairs = len(ids), a["size"].astype(np.int64)
    doc = np.repeat(np.arange(d), pairs)
    at = np.arange(len(doc)) - (np.cumsum(pairs) - pairs)[doc]
    own, made, to, bits, made_k = nll[a["slot"]], nll[a["made_slot"]], a["made_at"], a["own"], a["made_k"]
    add = lambda of, w, m: np.bincount(of, w, m)
    s = add(doc, own, d)
    dels = np.full((d, n), np.nan)
    with np.errstate(all="ignore"):
        for k in range(1, n + 1):
            o, j = bits >> k & 1 == 1, made_k == k
            dels[:, k - 1] = (add(doc[o], own[o], d) + add(doc[to[j]], made[j], d)) / (np.bincount(doc[o], minlength=d) + np.bincount(doc[to[j]], minlength=d))

        def runs(width: int):  # places of each document in runs of `width` pairs: run of a pair, document of a run, sum of a run and the next
            many = -(-pairs // width)
            run = (np.cumsum(many) - many)[doc] + at // width
            of = np.repeat(np.arange(d), many)
            same = np.append(of[:-1] == of[1:], False)[: len(of)]
            return run, of, lambda y: y + np.where(same, np.append(y[1:], 0), 0)

        run, of, two = runs(100)
        many = two(np.bincount(run, minlength=len(of)))
        ppl = np.exp(two(add(run, own, len(of))) / many)
        good = (many >= 10) & (ppl < 1000)
        chunks = _lists(of[good], ppl[good], d)
        if n:
            clamp = lambda y: np.clip(y, 0.5, 10.0)
            run, of, two = runs(75)
            o, j, m = bits >> 1 & 1 == 1, made_k == 1, len(of)
            many, many1 = two(np.bincount(run, minlength=m)), two(np.bincount(run[o], minlength=m) + np.bincount(run[to[j]], minlength=m))
            l, l1 = clamp(two(add(run, own, m)) / many), clamp(two(add(run[o], own[o], m) + add(run[to[j]], made[j], m)) / many1)
            good = (many >= 10) & (many1 > 0)
            spread = _lists(of[good], np.clip((l - l1) / l, 0.0, 1.0)[good], d)
        else:
            spread = _lists(np.zeros(0, np.int64), np.zeros(0), d)
        inside = a["sid"] >= 0
        _, first, sent = np.unique(a["sid"][inside], return_index=True, return_inverse=True)
        many = np.bincount(sent, minlength=len(first))
        good = many >= 4
        of, ppl = doc[inside][first][good], np.exp(add(sent, own[inside], len(first)) / many)[good]
        sn = np.bincount(of, minlength=d)
        smu = add(of, ppl, d) / sn
        sd = np.sqrt(add(of, (ppl - smu[of]) ** 2, d) / sn)
    ends = np.full((2, d), np.nan)
    np.fmin.at(ends[0], of, ppl)
    np.fmax.at(ends[1], of, ppl)
    null = lambda y: pa.array(y, pa.float64(), from_pandas=True)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(d + 1) * n, pa.int32()), null(dels.ravel()))
    return pa.table({"doc_id": ids, "c": pairs, "s": null(s), "dels": lists, "chunks": chunks, "spread": spread, "sn": pa.array(sn, pa.int64()), "smu": null(smu), "sd": null(sd), "lo": null(ends[0]), "hi": null(ends[1])})


def sums(docs: DataFrame, n: int = ROUNDS, counted: DataFrame | None = None) -> DataFrame:
    """Of each document with a pair of words: number of pairs and sum of their nll, mean after
    each of n deletions, perplexities of its chunks, relative drops of its parts, number, mean,
    deviation and range of its sentences' perplexities; counted: blocks() of them, if made before."""
    b = blocks(docs, n) if counted is None else counted
    size = b.agg(F.sum("n").alias("n"), F.count("*").alias("blocks")).first()
    if not size.blocks:
        return docs.sparkSession.createDataFrame([], _SUMS.format(docs.schema["doc_id"].dataType.simpleString()))
    kinds = b.select(F.explode("vocab").alias("w")).distinct().count()
    # a bucket holds what two blocks have, on average
    buckets = max(min(size.blocks, 64), -(-size.blocks // 2))
    dealt = b.select("block", "vocab", "p1", "p2", "count", "words", "last").mapInArrow(_dealt(buckets), _DEALT)
    total = dealt.groupBy("bucket").applyInArrow(_summed, _SUMMED)
    own = b.drop("n", "vocab")
    return own.groupBy("block").cogroup(total.groupBy("block")).applyInArrow(_sums(n, float(size.n + kinds)), _SUMS.format(docs.schema["doc_id"].dataType.simpleString()))


def features(docs: DataFrame, base: DataFrame | None = None, keep: tuple[str, ...] = (), n: int = ROUNDS) -> DataFrame:
    """doc_id, n_chars and the features of perplexity and stability (by n perturbations), and the
    columns `keep` of base (doc_id, n_chars, ...), if given. Documents without a
    pair of words take the defaults; of rows that share a doc_id one gives the features of all."""
    g = sums(docs, n)
    g = g.groupBy("doc_id").agg(F.min(F.struct(*g.columns[1:])).alias("x")).select("doc_id", "x.*").withColumnRenamed("c", "pairs").withColumn("ce", F.col("s") / F.col("pairs"))
    clamp = lambda c: F.greatest(F.lit(0.5), F.least(F.lit(10.0), c))
    base = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n_chars")) if base is None else base.select("doc_id", "n_chars", *keep)
    # a stated number: what follows is all computing, for which joined partitions of few bytes would be too few tasks
    f = base.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id").join(g, "doc_id", "left")
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v) / F.size(c)
    var = lambda c: let(mean(c), lambda m: mean(F.transform(c, lambda v: (v - m) * (v - m))))
    enough = F.coalesce(F.col("pairs") + 1 >= 5, F.lit(False))
    f = f.withColumn("ce5", F.when(enough, F.col("ce")).otherwise(0.0)).withColumn("ppl", F.when(enough & (F.col("n_chars") >= 10), F.exp("ce")).otherwise(0.0)).withColumn("chunks", F.coalesce("chunks", F.array().cast("array<double>")))
    some, parts = F.size("chunks") > 0, F.coalesce(F.size("spread") > 0, F.lit(False))
    f = f.withColumn("orig", F.when(F.col("ce").isNotNull(), clamp(F.col("ce")))).withColumn("ls", F.transform(F.filter(F.coalesce("dels", F.array().cast("array<double>")), lambda v: v.isNotNull()), clamp)).withColumn("m", F.when(F.col("orig").isNotNull(), F.size("ls")).otherwise(0))
    any_ = F.col("m") > 0
    f = f.withColumn("mean_l", F.when(any_, mean(F.col("ls")))).withColumn("drop", F.when(any_, mean(F.transform("ls", lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("orig") - v) / F.col("orig")))))))
    f = f.withColumn("curve", F.when(any_, var(F.transform("ls", lambda v: F.abs(F.col("orig") - v))))).withColumn("pv", F.when(any_, var(F.col("ls"))))
    d = F.col("drop")
    return f.select(
        "doc_id", "n_chars", *keep, F.round("ppl", 3).alias("overall_perplexity"), F.round(1 / (1 + F.exp((F.col("ppl") - 30) / 10)), 4).alias("normalized_perplexity"), F.round(F.when(some, var(F.col("chunks"))).otherwise(0.0), 2).alias("perplexity_variance"),
        F.round(F.coalesce("smu", "ppl"), 3).alias("avg_sentence_perplexity"), F.round(F.coalesce("sd", F.lit(0.0)), 3).alias("std_sentence_perplexity"), F.round(F.coalesce("lo", "ppl"), 3).alias("min_sentence_perplexity"), F.round(F.coalesce("hi", "ppl"), 3).alias("max_sentence_perplexity"), F.coalesce("sn", F.lit(0)).cast("long").alias("num_sentences_analyzed"),
        F.round(F.least(F.lit(1.0), F.col("ce5") / 5), 4).alias("cross_entropy_score"), F.round(F.when(some, mean(F.col("chunks"))).otherwise(0.0), 3).alias("avg_chunk_perplexity"), F.size("chunks").cast("long").alias("num_chunks_analyzed"),
        F.round(F.when(any_, F.col("orig")).otherwise(2.0), 4).alias("original_likelihood"), F.round(F.coalesce("mean_l", F.lit(1.8)), 4).alias("avg_perturbed_likelihood"),
        F.round(F.when(d.isNull(), 0.3).when(d > 0.5, 0.9).when(d > 0.3, 0.6 + (d - 0.3) * 1.5).when(d > 0.15, 0.3 + (d - 0.15) * 2).otherwise(d * 2), 4).alias("stability_score"),
        F.round(F.when(F.col("m") >= 2, F.least(F.lit(1.0), F.col("curve") * 3)).otherwise(0.3), 4).alias("curvature_score"), F.round(F.when(any_, F.greatest(F.lit(0.33), F.least(F.lit(3.0), F.col("orig") / F.col("mean_l"))) / 3).otherwise(0.55), 4).alias("normalized_likelihood_ratio"),
        F.round(F.when(parts, var(F.col("spread"))).otherwise(0.1), 6).alias("stability_variance"), F.round(F.coalesce("pv", F.lit(0.05)), 4).alias("perturbation_variance"), F.col("m").cast("long").alias("num_perturbations"),
    )


PERPLEXITY = ["doc_id", "n_chars", "overall_perplexity", "normalized_perplexity", "perplexity_variance", "avg_sentence_perplexity", "std_sentence_perplexity", "min_sentence_perplexity", "max_sentence_perplexity", "num_sentences_analyzed", "cross_entropy_score", "avg_chunk_perplexity", "num_chunks_analyzed"]
STABILITY = ["doc_id", "n_chars", "original_likelihood", "avg_perturbed_likelihood", "stability_score", "curvature_score", "normalized_likelihood_ratio", "stability_variance", "perturbation_variance", "num_perturbations"]
