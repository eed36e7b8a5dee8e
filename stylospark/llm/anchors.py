"""Content-defined routing for repeated strings of a fixed length.

Every window of W tokens (bytes or words) contains a smallest K-gram by hash,
the leftmost of equals: its anchor. Equal windows have equal anchors at equal
offsets, wherever they stand, so all occurrences of a window meet under the hash
of its anchor. Consecutive windows with one anchor form a segment. A segment
whose anchor occurs once in the corpus holds no repeat; one whose whole content
occurs twice is a repeat throughout; only the others, at the edges of what is
shared, need a closer look by the caller's own method.

An anchor with very many different segments (a frequent short passage) would
make one large group. Such anchors, at most `HOT_MAX` of them, are demoted: they
are chosen only in windows that have no other; windows then meet under rarer
anchors. Demotion depends on content alone, so equal windows still meet. Groups
that are large all the same (anchors beyond that number, windows without another
one) are dealt window by window, by a hash of the whole window: exact as well,
and no group of theirs is ever held by one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as Sorted
from pyspark.sql import functions as F

from .common import U64, durable, pieces, powers, prefix, raw, span_hash

HOT_MAX = 10_000
#: Different segments of one anchor that a task takes without demotion.
HOT_GROUP = 4_000
SAMPLE = 32
#: at: the segment's start << 24 | its anchor's place in it << 12 | its length; rest: those of equal segments of the same document.
SCHEMA = "doc_id long, h long, at long, anchor long, s long, rest array<long>"
#: tokens(data, offs) gives (token values, offsets of each document's tokens).
Tokens = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Window:
    width: int  # W, 2,000 at most
    gram: int  # K
    tokens: Tokens


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, in linear time."""
    n = len(v)
    pad = -n % w
    a = np.concatenate((v, np.full(pad, np.iinfo(v.dtype).max, v.dtype))).reshape(-1, w)
    left = np.minimum.accumulate(a, 1).ravel()
    right = np.minimum.accumulate(a[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def segments(tok: np.ndarray, offs: np.ndarray, win: Window, hot: np.ndarray):
    """(document, start, length, anchor's place in it, anchor, content hash) of
    every segment; starts count from the document's first token. Contents are
    equal if anchor and content hash are, each of 64 bits."""
    n, spread = len(tok), win.width - win.gram + 1
    empty = [np.zeros(0, np.int64)] * 6
    if n < win.width:
        return empty
    pre = prefix(tok + U64(1))
    gram = (pre[win.gram :] - pre[: -win.gram]) * powers(n + 1)[1][: n - win.gram + 1]
    gram = (gram ^ (gram >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    gram ^= gram >> U64(32)
    order = gram >> U64(1)
    if len(hot):
        i = np.minimum(np.searchsorted(hot, gram), len(hot) - 1)
        order |= (hot[i] == gram).astype(U64) << U64(63)
    order = (order >> U64(31) << U64(31)) | np.arange(len(gram), dtype=U64)
    low = (sliding_min(order, spread) & U64((1 << 31) - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    valid = np.flatnonzero(doc[: n - win.width + 1] == doc[win.width - 1 :])
    if not len(valid):
        return empty
    at = low[valid]
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (valid[1:] != valid[:-1] + 1))))
    last = np.append(first[1:], len(valid)) - 1
    a, b, pos = valid[first], valid[last] + win.width, at[first]
    d = doc[a]
    return d, a - offs[d], b - a, pos - a, gram[pos].view(np.int64), span_hash(pre, a, b).view(np.int64)


def _rows(win: Window, hot: np.ndarray):
    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", 1 << 17):  # arrays that stay in a core's cache
                tok, offs = win.tokens(*raw(part.column(2)))
                d, start, size, mid, anchor, content = segments(tok, offs, win, hot)
                if not len(d):
                    continue
                order = np.lexsort((start, content, anchor, d))
                d, at, anchor, content = d[order], (start << 24 | mid << 12 | size)[order], anchor[order], content[order]
                new = np.concatenate(([True], (d[1:] != d[:-1]) | (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])))
                first = np.flatnonzero(new)
                more = np.diff(np.append(first, len(d))) - 1
                rest = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(more))).astype(np.int32)), pa.array(at[~new]), mask=pa.array(more == 0))
                i = pa.array(d[first])
                yield pa.RecordBatch.from_arrays([part.column(0).take(i), part.column(1).take(i), pa.array(at[first]), pa.array(anchor[first]), pa.array(content[first]), rest], names=["doc_id", "h", "at", "anchor", "s", "rest"])

    return run


def repeats(docs: DataFrame, win: Window, most: int = HOT_GROUP, hot_max: int = HOT_MAX) -> tuple[DataFrame, DataFrame]:
    """(known, open): segments of docs (keyed()) that may hold repeats. known:
    doc_id, h, start, len of segments that are repeats throughout. open: doc_id,
    h, start, mid (the anchor's place), len, anchor of segments that occur once and share their anchor with
    others, and of one of each of the others (again is true).

    Segments are dealt by anchor once and looked at in order, so only neighbours
    are compared. Which anchors to demote is found in one document of SAMPLE;
    windows of groups of over `most` different segments that are left are looked
    up one by one."""
    few = docs.where(F.pmod(F.xxhash64("doc_id", "h"), F.lit(SAMPLE)) == 0).mapInArrow(_rows(win, np.zeros(0, U64)), SCHEMA)
    guess = few.groupBy("anchor").agg(F.approx_count_distinct("s").alias("kinds")).where(F.col("kinds") > max(8, most // SAMPLE // 2))
    found = docs.mapInArrow(_rows(win, _hottest(guess, hot_max)), SCHEMA)
    group = Sorted.partitionBy("anchor")
    near = group.orderBy("s", "doc_id", "h", "at")
    before = F.coalesce(F.lag("s").over(near) == F.col("s"), F.lit(False))
    after = F.coalesce(F.lead("s").over(near) == F.col("s"), F.lit(False))
    seen = found.select("*", (before | after | F.col("rest").isNotNull()).alias("again"), (~before).alias("head"))
    seen = seen.withColumn("kinds", F.sum(F.col("head").cast("long")).over(group)).where("again or kinds > 1")
    shared = durable(seen.withColumn("head", F.col("head") & (F.col("kinds") > 1)), "shared-segments")
    start, mid, size = F.shiftright("at", 24).cast("int"), (F.shiftright("at", 12) % 4096).cast("int"), (F.col("at") % 4096).cast("int")
    known = shared.where("again").select("doc_id", "h", F.explode(F.concat(F.array("at"), F.coalesce("rest", F.array().cast("array<long>")))).alias("at")).select("doc_id", "h", start.alias("start"), size.alias("len"))
    heads = shared.where("head").select("doc_id", "h", start.alias("start"), mid.alias("mid"), size.alias("len"), "anchor", "again", "kinds")
    return known.unionByName(_by_window(docs, heads.where(F.col("kinds") > most), win)), heads.where(F.col("kinds") <= most).drop("kinds")


def promising(tok: np.ndarray, offs: np.ndarray, mid: np.ndarray, group: np.ndarray, win: Window, classes: int = 8):
    """(i, from, to): the segments (tok cut at offs, their anchors at mid) that
    can hold a window of another segment of their group, and the part of each
    where such windows can lie. Windows are classed by the anchor's place in
    them; those of a class all contain one stretch around the anchor, and a
    window can only be found where that stretch is another segment's too."""
    size, spread = np.diff(offs)[:, None], win.width - win.gram
    step = -(-(spread + 1) // classes)
    at = np.arange(0, spread + 1, step)[None, :]
    mid = mid.astype(np.int64)[:, None]
    least, most = np.maximum(at, mid + win.width - size), np.minimum(np.minimum(at + step - 1, spread), mid)
    some = np.argwhere(least <= most)
    i, c = some[:, 0], some[:, 1]
    left = offs[:-1][i] + mid[i, 0] - at[0, c]
    right = offs[:-1][i] + mid[i, 0] + win.gram + np.maximum(0, spread - at[0, c] - step + 1)
    key = span_hash(prefix(tok.astype(U64) + U64(1)), left, right)
    order = np.lexsort((key, c, group[i]))
    key, g, k = key[order], group[i][order], c[order]
    twin = (key[1:] == key[:-1]) & (g[1:] == g[:-1]) & (k[1:] == k[:-1])
    alive = np.zeros(len(order), bool)
    alive[order[1:][twin]] = alive[order[:-1][twin]] = True
    i, c = i[alive], c[alive]
    if not len(i):
        return i, i, i
    own, first = np.unique(i, return_index=True)
    last = np.append(first[1:], len(i)) - 1  # classes ascend within a segment
    return own, mid[own, 0] - most[own, c[last]], mid[own, 0] - least[own, c[first]] + win.width


def _windows(win: Window):
    """(doc_id, h, text, segs) to a row of each window of the segments: doc_id,
    h, start, w (hash of its tokens), again (whether its segment occurs again)."""

    def run(batches):
        for part in (p for batch in batches for p in pieces(batch, "text", 1 << 19)):
            tok, offs = win.tokens(*raw(part.column(2)))
            pre, row, at, again = prefix(tok + U64(1)), [], [], []
            for i, segs in enumerate(part.column(3).to_pylist()):
                for s in segs:
                    own = np.arange(s["start"], s["start"] + s["len"] - win.width + 1)
                    row.append(np.full(len(own), i)), at.append(own), again.append(np.full(len(own), s["again"]))
            if row:
                row, at = np.concatenate(row), np.concatenate(at)
                w = span_hash(pre, offs[row] + at, offs[row] + at + win.width)
                i = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(i), part.column(1).take(i), pa.array(at.astype(np.int32)), pa.array(w.view(np.int64)), pa.array(np.concatenate(again))], names=["doc_id", "h", "start", "w", "again"])

    return run


def _by_window(docs: DataFrame, heads: DataFrame, win: Window) -> DataFrame:
    """doc_id, h, start, len of the windows of heads that start in another head
    too, or in another copy of their own."""
    asked = heads.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "len", "again")).alias("segs"))
    rows = attach(docs, asked, "inner").select("doc_id", "h", "text", "segs").mapInArrow(_windows(win), "doc_id long, h long, start int, w long, again boolean")
    rows = durable(rows, "single-windows")
    often = rows.groupBy("w").agg(F.sum(F.when(F.col("again"), 2).otherwise(1)).alias("n")).where("n > 1").select("w")
    return rows.join(often, "w").select("doc_id", "h", "start", F.lit(win.width).alias("len"))


def _hottest(kinds: DataFrame, n: int) -> np.ndarray:
    """The n anchors of most kinds, sorted: at most HOT_MAX numbers come to the
    driver and go to the tasks."""
    rows = kinds.orderBy(F.desc("kinds"), "anchor").limit(n).select("anchor").collect()
    return np.sort(np.array([r["anchor"] for r in rows], np.int64).view(U64))


def spans_of(known: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, h, spans (array of start, len) of both."""
    both = known.select("doc_id", "h", "start", "len").unionByName(found.select("doc_id", "h", "start", "len"))
    return both.groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "len")).alias("spans"))


def _pack(batches):
    for batch in batches:
        z = zstandard.ZstdCompressor(level=3)
        text = pa.array([z.compress(t.as_buffer()) for t in batch.column(2)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text], names=["doc_id", "h", "text"])


def packed(docs: DataFrame) -> DataFrame:
    """keyed() rows with compressed texts, for a shuffle of whole texts."""
    return docs.mapInArrow(_pack, "doc_id long, h long, text binary")


def unpack(run):
    """A mapInArrow function over batches whose text column is packed, a few
    megabytes at a time."""

    def wrapped(batches):
        def plain():
            for batch in batches:
                at = batch.schema.get_field_index("text")
                for part in pieces(batch, "text", 1 << 20):
                    z = zstandard.ZstdDecompressor()
                    text = pa.array([z.decompress(t.as_buffer()) for t in part.column(at)], pa.binary()).cast(pa.string())
                    yield part.set_column(at, "text", text)

        yield from run(plain())

    return wrapped


def attach(docs: DataFrame, lists: DataFrame, how: str = "left") -> DataFrame:
    """docs with the columns of lists by (doc_id, h), null ids alike."""
    k = lists.withColumnRenamed("doc_id", "_d").withColumnRenamed("h", "_h")
    return docs.join(k, docs["doc_id"].eqNullSafe(k["_d"]) & (docs["h"] == k["_h"]), how).drop("_d", "_h")


def covered(offs: np.ndarray, spans: pa.Array) -> np.ndarray:
    """Mask of the tokens (offs: of each document) that lie in a span of their
    document; spans: a list column of (start, len), null: none."""
    step = np.zeros(int(offs[-1]) + 1, np.int32)
    flat = spans.flatten()
    sizes = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
    start = np.repeat(offs[:-1], sizes) + flat.field("start").to_numpy()
    np.add.at(step, start, 1)
    np.add.at(step, start + flat.field("len").to_numpy(), -1)
    return np.cumsum(step[:-1]) > 0
