"""Helpers shared by the corpus operators: durable intermediate tables and
numpy views of Arrow text columns."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. Where
    that is unset, a temporary folder on one machine (tests), an error on a
    cluster, whose executors wouldn't see it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends at files
    that survive the loss of any executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def column(df: DataFrame, name: str, kind: str):
    """A column by name cast to kind, or a null of that kind if it is missing."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts: at most `rows` rows, unless the session has
    a setting of its own. With the default of 10,000 rows a batch of long texts
    takes most of a small executor's memory beside the heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def keyed(df: DataFrame) -> DataFrame:
    """(doc_id, h, text): null text is empty; h tells rows of one doc_id apart.
    Rows equal in both are interchangeable copies of one another."""
    small_batches(df.sparkSession)
    text = F.coalesce(column(df, "text", "string"), F.lit(""))
    return df.select(column(df, "doc_id", "long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def one_of(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """The rows of docs, all columns whatever their names, whose doc_id (null:
    the least number) and hash of the text are a row (k, x) of keep; of rows equal
    in both any one."""
    text = F.coalesce(column(docs, "text", "string"), F.lit(""))
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(column(docs, "doc_id", "long"), F.lit(-(1 << 63))).alias("k"), F.xxhash64(text).alias("x"))
    return marked.join(keep, ["k", "x"]).dropDuplicates(["k", "x"]).select("row.*")


def parts(df: DataFrame) -> int:
    """Partitions for a shuffle: what the session is set to."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def pieces(batch: pa.RecordBatch, name: str, limit: int = 1 << 20):
    """Slices of a batch with about `limit` bytes of text each (one row at
    least), which bounds the numpy temporaries of a task."""
    col = batch.column(batch.schema.get_field_index(name))
    size = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False))
    at, n = 0, batch.num_rows
    while at < n:
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


_POW: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, kept per worker."""
    if "p" not in _POW or len(_POW["p"]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length()) if n > 1 else 1 << 16
        for key, base in (("p", _BASE), ("q", _BASE_INV)):
            p = np.full(size, base, U64)
            p[0] = 1
            _POW[key] = np.multiply.accumulate(p)
    return _POW["p"], _POW["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix(tokens: np.ndarray) -> np.ndarray:
    """Prefix sums of token * base**position; see span_hash."""
    out = np.zeros(len(tokens) + 1, U64)
    np.cumsum(tokens.astype(U64) * powers(len(tokens) + 1)[0][: len(tokens)], out=out[1:])
    return out


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of tokens[start:end], independent of where it starts."""
    return mix((pre[end] - pre[start]) * powers(len(pre))[1][start])


_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of the maximal runs without white space, and the
    offsets of each document's words among them."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = _IS_WORD[data]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offs)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hash(prefix(data.astype(U64) + U64(1)), start, end)


def expand(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for each of the lengths, one after another."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = length > 0
    s, n = start[keep], length[keep]
    at = np.cumsum(n)[:-1]
    out[0] = s[0]
    out[at] = s[1:] - s[:-1] - n[:-1] + 1
    return np.cumsum(out)
