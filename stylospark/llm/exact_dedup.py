"""Exact de-duplication by composable polynomial fingerprints.

A text, without white space, is hashed in chunks: h(c) = sum c[i] * B**(n-1-i)
mod p for two primes. Chunks combine by h(ab) = h(a) * B**len(b) + h(b), so the
chunks of a huge text are hashed in parallel by different tasks. Texts of equal
fingerprint and length are then compared chunk by chunk with one text of their
group; a text that differs after all gets a class of its own by its SHA-256.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, column, durable, one_of, pieces

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1664525)
BLOCK = 1 << 14
_TABLE: dict[int, np.ndarray] = {}


def _powers(k: int) -> np.ndarray:
    """B**0 .. B**BLOCK mod p for the k-th prime, kept per worker."""
    if k not in _TABLE:
        p, b = PRIMES[k], BASES[k]
        out = np.ones(BLOCK + 1, np.int64)
        n = 1
        while n <= BLOCK:
            m = min(n, BLOCK + 1 - n)
            out[n : n + m] = out[:m] * pow(b, n, p) % p
            n += m
        _TABLE[k] = out
    return _TABLE[k]


def combine(k: int, left: int, right: int, right_len: int) -> int:
    """Fingerprint of a concatenation, shifted by the length of its right part."""
    return (left * pow(BASES[k], right_len, PRIMES[k]) + right) % PRIMES[k]


def fingerprint(data: bytes) -> tuple[int, int]:
    """Both polynomial hashes, in blocks that numpy sums without overflow."""
    a = np.frombuffer(data, np.uint8)
    out = [0, 0]
    for at in range(0, len(a), BLOCK):
        part = a[at : at + BLOCK].astype(np.int64) + 1
        for k in (0, 1):
            h = int(np.dot(part, _powers(k)[: len(part)][::-1])) % PRIMES[k]
            out[k] = combine(k, out[k], h, len(part))
    return out[0], out[1]


def _hash_rows(batches):
    """(keys..., text) to (keys..., n, h1, h2, sha) of the text without white space."""
    for batch in batches:
        for part in pieces(batch, "text", 8 << 20):
            n, h1, h2, sha = [], [], [], []
            for t in part.column(part.schema.get_field_index("text")).cast(pa.large_binary()).to_pylist():
                t = (t or b"").translate(None, WHITE)
                a, b = fingerprint(t)
                n.append(len(t)), h1.append(a), h2.append(b), sha.append(hashlib.sha256(t).hexdigest())
            keep = [(c, part.column(i)) for i, c in enumerate(part.schema.names) if c != "text"]
            yield pa.RecordBatch.from_arrays([x for _, x in keep] + [pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sha, pa.string())], [c for c, _ in keep] + ["n", "h1", "h2", "text_sha256"])


def _combine_rows(batches):
    """parts: array of (idx, n, h1, h2) of one text to its fingerprint."""
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            r["n"], r["h1"], r["h2"] = 0, 0, 0
            for p in sorted(r.pop("parts"), key=lambda p: p["idx"]):
                r["h1"], r["h2"] = combine(0, r["h1"], p["h1"], p["n"]), combine(1, r["h2"], p["h2"], p["n"])
                r["n"] += p["n"]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("x", pa.int64()), ("n_chars", pa.int64()), ("text_sha256", pa.string()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())]))


def _cut(size: int, unit: str):
    """Rows with a column text, the last, to a row for each chunk of `size` of
    it: idx and chunk instead of text. unit: characters of the text as it is, or
    bytes of it without white space. Linear in the text."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", 4 << 20):
                row, idx, chunk = [], [], []
                for i, t in enumerate(part.column(part.num_columns - 1).to_pylist()):
                    t = t if unit == "characters" else t.encode().translate(None, WHITE)
                    for k in range(max(1, -(-len(t) // size))):
                        row.append(i), idx.append(k), chunk.append(t[k * size : (k + 1) * size])
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([c.take(at) for c in part.columns[:-1]] + [pa.array(idx, pa.int32()), pa.array(chunk, pa.string() if unit == "characters" else pa.binary())], names=[*part.schema.names[:-1], "idx", "chunk"])

    return run


def fingerprints(docs: DataFrame, huge: int = 1 << 20) -> DataFrame:
    """One row per row of docs: doc_id, x (hash of the text, tells rows of one
    doc_id apart), n_chars, n, h1, h2, text_sha256. Texts over `huge` characters
    are cut into chunks that are dealt to all tasks; their hashes are combined."""
    text = F.coalesce(column(docs, "text", "string"), F.lit(""))
    rows = docs.select(column(docs, "doc_id", "long").alias("doc_id"), F.xxhash64(text).alias("x"), F.length(text).cast("long").alias("n_chars"), text.alias("text"))
    small = rows.where(F.col("n_chars") <= huge).mapInArrow(_hash_rows, "doc_id long, x long, n_chars long, n long, h1 long, h2 long, text_sha256 string")
    clean = F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")
    big = rows.where(F.col("n_chars") > huge).withColumn("row", F.monotonically_increasing_id())
    sha = F.sha2(clean, 256).alias("sha")
    cut = big.select("doc_id", "x", "n_chars", "row", sha, "text").mapInArrow(_cut(huge, "characters"), "doc_id long, x long, n_chars long, row long, sha string, idx int, chunk string")
    cut = cut.withColumnRenamed("chunk", "text").repartition("row", "idx")
    done = cut.mapInArrow(_hash_rows, "doc_id long, x long, n_chars long, row long, sha string, idx int, n long, h1 long, h2 long, text_sha256 string")
    done = done.groupBy("doc_id", "x", "n_chars", "row", "sha").agg(F.collect_list(F.struct("idx", "n", "h1", "h2")).alias("parts"))
    done = done.select("doc_id", "x", "n_chars", F.col("sha").alias("text_sha256"), "parts").mapInArrow(_combine_rows, "doc_id long, x long, n_chars long, text_sha256 string, n long, h1 long, h2 long")
    return small.unionByName(done)


def _key():
    return F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("k")


def exact_dedup(docs: DataFrame, chunk: int = 1 << 14, per_salt: int = 2000) -> DataFrame:
    """One row per row of docs: doc_id, x, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without the characters of
    [\\x20\\x09-\\x0D]; a null text is empty, and all empty texts are one group.
    The row with the most code points, then the smallest doc_id (null first; of
    one doc_id by a hash of the text) stays; rows equal in doc_id and text are
    all marked alike (drop_copies
    leaves one of them). An empty table gives an empty table; other columns of
    docs are ignored. Hot groups: groups are pre-aggregated, and for the
    comparison the chunks of a group's representative go to one task for every
    `per_salt` members."""
    fp = durable(fingerprints(docs), "fingerprints").select("*", _key())
    key = ["n", "h1", "h2"]
    groups = fp.groupBy(*key).agg(F.count("*").alias("m"), F.min(F.struct("k", "x")).alias("rep")).where("m > 1")
    members = fp.join(groups, key).where("k <> rep.k or x <> rep.x").groupBy(*key, "k", "x").agg(F.first("rep").alias("rep"), F.first("m").alias("m"))
    members = members.withColumn("salt", F.pmod(F.xxhash64("k", "x"), F.ceil(F.col("m") / per_salt)))
    text = F.coalesce(column(docs, "text", "string"), F.lit(""))
    texts = docs.select(F.coalesce(column(docs, "doc_id", "long"), F.lit(-(1 << 63))).alias("k"), F.xxhash64(text).alias("x"), text.alias("t"))
    salts = members.groupBy(*key, "salt").agg(F.first("rep").alias("rep"))
    # one join fetches the texts of members and of representatives alike
    roles = members.select(*key, "k", "x", "salt", F.lit(False).alias("is_rep")).unionByName(salts.select(*key, F.col("rep.k").alias("k"), F.col("rep.x").alias("x"), "salt", F.lit(True).alias("is_rep")))
    cut = roles.join(texts, ["k", "x"]).select(*key, "salt", "is_rep", "k", "x", F.col("t").alias("text"))
    cut = cut.mapInArrow(_cut(chunk, "bytes"), "n long, h1 long, h2 long, salt long, is_rep boolean, k long, x long, idx int, chunk binary")
    want = F.max(F.when(F.col("is_rep"), F.col("chunk"))).over(Window.partitionBy(*key, "salt", "idx"))
    differs = cut.withColumn("want", want).where("not is_rep and not (chunk <=> want)").select("k", "x", F.lit(True).alias("differs")).distinct()
    fp = fp.join(differs, ["k", "x"], "left").withColumn("cls", F.coalesce(F.when(F.col("differs"), F.col("text_sha256")), F.lit("")))
    stay = fp.groupBy(*key, "cls").agg(F.count("*").alias("group_size"), F.min(F.struct((-F.col("n_chars")).alias("a"), "k", "x", "doc_id")).alias("best"))
    out = fp.join(stay, [*key, "cls"])
    kept = (F.col("k") == F.col("best.k")) & (F.col("x") == F.col("best.x"))
    return out.select("doc_id", "x", F.col("best.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without exact copies: the row that exact_dedup keeps of each group,
    with all its columns, whatever their names; of rows equal in doc_id and text,
    any one. Nulls and empty tables as in exact_dedup."""
    keep = exact_dedup(docs).where("kept").groupBy("text_sha256").agg(F.min(F.struct(_key(), "x")).alias("s"))
    return one_of(docs, keep.select("s.k", "s.x"))
