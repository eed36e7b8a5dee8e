"""Suffix-array duplicates: shard Burrows-Wheeler transforms are merged by
iterative interleave refinement, which yields common prefixes and repeated
intervals without sorting the suffixes of the whole again.

Anchors (see anchors.py) bring together the stretches of text that can share a
200-byte string; stretches equal as a whole are settled by counting. The rest,
at the edges of what is shared, are dealt to two shards by their document, whose
transforms are merged: each round sorts the interleave stably by the symbols
before it, so after k rounds it is ordered by k symbols, and a border appears
where prefixes of k differ: common prefixes are read off the round in which a
border comes. Rows without a border after `width` bytes are a repeated interval.

Symbols are `step` bytes long: a string is `step` chains, one for each residue of
a suffix's position, which have a row for each suffix all together and need
width / step rounds only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Window, attach, covered, packed, promising, repeats, spans_of, unpack
from .common import durable, expand, keyed, parts, pieces, raw
from .suffixes import doubled, lay_out

WIDTH = 200
#: Bytes of segments that a task looks at together; fewer of them are merged.
CHUNK = 1 << 18


def byte_tokens(data: np.ndarray, offs: np.ndarray):
    return data.astype(np.uint64), offs


def step_of(width: int) -> int:
    """Bytes of a symbol: the most, up to 8, that divide the width."""
    return next(s for s in range(8, 0, -1) if width % s == 0)


def chains(data: np.ndarray, offs: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, offsets of the chains, position of each symbol in data): chain
    r of string i has the symbols at its bytes r, r + step, ..."""
    size = np.diff(offs)
    r = np.arange(step)
    n = np.maximum(0, (size[:, None] - r[None, :]) // step).ravel()
    first = (offs[:-1, None] + r[None, :]).ravel()
    ends = np.concatenate(([0], np.cumsum(n)))
    at = np.repeat(first - step * ends[:-1], n) + step * np.arange(ends[-1])
    wide = np.zeros(max(0, len(data) - step + 1), np.uint64)
    for k in range(step):
        wide = (wide << np.uint64(8)) | data[k : k + len(wide)]
    return wide[at], ends, at


def transform(sym: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bwt, place) of a shard's suffixes in order; place counts the symbols of
    all strings, each with a sentinel of its own at its end. 0 stands before a
    string's first symbol, symbol c as c + 1."""
    text, start = lay_out(sym, offs)
    if not len(text):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    order = np.argsort(doubled(text, int(np.diff(offs).max()) + 1)[-1], kind="stable")
    plain = np.maximum(text - (len(offs) - 2), 0).astype(np.int32)
    before = np.empty(len(text), np.int32)
    before[1:] = plain[:-1]
    before[start] = 0
    return before[order], order


def merge(left: np.ndarray, right: np.ndarray, n_left: int, n_right: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(interleave: True where the row is the right shard's, lcp: symbols that a
    row has in common with the row before it, as far as `depth`). n_left and
    n_right are the numbers of strings, whose sentinel rows come first."""
    n = len(left) + len(right)
    z = np.zeros(n, bool)
    z[len(left) :] = True
    lcp = np.full(n, depth, np.int32)
    lcp[:1] = 0
    border, strings = lcp < depth, n_left + n_right
    kind = np.uint16 if max(left.max(initial=0), right.max(initial=0)) < 1 << 16 else np.int32
    left, right = left.astype(kind), right.astype(kind)
    for k in range(depth):
        c = np.empty(n, kind)
        c[~z], c[z] = left, right
        order = np.argsort(c, kind="stable")
        block = np.cumsum(border, dtype=np.int32)[order]
        c, was = c[order], z
        z = z[order]
        z[:strings] = False  # sentinel rows: by string, the left shard's first
        z[n_left:strings] = True
        new = np.ones(n, bool)
        new[1:] = (c[1:] != c[:-1]) | (block[1:] != block[:-1])
        new[:strings] = True  # every sentinel is its own
        lcp[new & ~border] = k
        if (new == border).all() and (z == was).all():
            break  # nothing is refined any more
        border = new
    return z, lcp


def repeated(strings: list[np.ndarray], shard: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """For each string (bytes as numbers) the positions whose next `width` bytes
    also start elsewhere. shard: False for the strings of the left shard."""
    step, size = step_of(width), np.array([len(s) for s in strings], np.int64)
    order = np.argsort(shard, kind="stable")
    offs = np.concatenate(([0], np.cumsum(size[order])))
    data = np.concatenate([strings[i] for i in order]) if len(strings) else np.zeros(0, np.uint8)
    sym, ends, at = chains(data, offs, step)
    sym = np.unique(sym, return_inverse=True)[1].astype(np.int64)
    half = int((~shard).sum()) * step
    cut = ends[half]
    parts_ = [transform(sym[:cut], ends[: half + 1]), transform(sym[cut:], ends[half:] - cut)]
    z, lcp = merge(parts_[0][0], parts_[1][0], half, len(ends) - 1 - half, width // step)
    again = lcp >= width // step
    again[:-1] |= again[1:].copy()
    place = np.empty(len(z), np.int64)
    place[~z], place[z] = parts_[0][1], parts_[1][1] + cut + half
    place = place[again]  # among symbols with their sentinels
    chain = np.searchsorted(ends[1:] + np.arange(1, len(ends)), place, side="right")
    pos = np.sort(at[place - chain])
    bounds = np.searchsorted(pos, offs)
    out: list[np.ndarray] = [pos] * len(strings)
    for k, i in enumerate(order):
        out[i] = pos[bounds[k] : bounds[k + 1]] - offs[k]
    return out


def runs(pos: np.ndarray, width: int) -> list[tuple[int, int]]:
    """(start, length) of what windows of `width` at sorted positions cover."""
    if not len(pos):
        return []
    first = np.flatnonzero(np.concatenate(([True], pos[1:] > pos[:-1] + width)))
    last = np.append(first[1:], len(pos)) - 1
    return [(int(a), int(b + width - a)) for a, b in zip(pos[first], pos[last])]


def whole_groups(batches, chunk: int):
    """Batches of a partition sorted by anchor, cut between anchors into pieces
    of about `chunk` bytes of segments."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(batch.schema.get_field_index("anchor")).to_numpy()
        length = np.diff(raw(batch.column(batch.schema.get_field_index("segment")))[1])
        first = np.append(np.flatnonzero(np.concatenate(([not held or key[0] != last], key[1:] != key[:-1]))), len(key))
        if first[0]:  # the rest of a group
            held.append(batch.slice(0, first[0]))
            size += int(length[: first[0]].sum())
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if held and size + (more := int(length[a:b].sum())) > chunk:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            held.append(batch.slice(a, b - a))
            size += int(length[a:b].sum())
        last = key[-1]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


OPEN = "doc_id long, h long, start int, anchor long, again boolean, mid int, segment binary"
SPANS = "doc_id long, h long, start int, len int"


def by_anchor(win: Window, chunk: int, tokens: type, find):
    """A mapInArrow function from OPEN rows sorted by anchor to SPANS: what
    find(strings, rows of the batch, batch) finds in the promising parts."""

    def run(batches):
        for batch in whole_groups(batches, chunk):
            data, offs = raw(batch.column(6))
            tok, offs = data.view(tokens), offs // np.dtype(tokens).itemsize
            i, a, b = promising(tok, offs, batch.column(5).to_numpy(), batch.column(3).to_numpy(), win)
            again = batch.column(4).to_numpy(zero_copy_only=False)
            found = find([tok[x:y] for x, y in zip(offs[i] + a, offs[i] + b)], i, batch) if len(i) else []
            spans = [(k, x + at, n) for k, x, pos in zip(i.tolist(), a.tolist(), found) if not again[k] for at, n in runs(pos, win.width)]
            row, at, size = (np.array(x, np.int64) for x in zip(*spans)) if spans else [np.zeros(0, np.int64)] * 3
            start = batch.column(2).to_numpy()[row] + at
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))], names=["doc_id", "h", "start", "len"])

    return run


def open_segments(cut):
    """(doc_id, h, text, segs) to OPEN rows; cut(text column) gives the bytes of
    all tokens (of one width) and the offsets of each text's tokens."""

    def run(batches):
        for part in (p for batch in batches for p in pieces(batch, "text", 1 << 20)):
            tokens, offs = cut(part.column(2))
            segs = part.column(3)
            flat, owner = segs.flatten(), np.repeat(np.arange(len(segs)), np.diff(segs.offsets.to_numpy()))
            start, size = flat.field("start").to_numpy().astype(np.int64), flat.field("len").to_numpy().astype(np.int64)
            wide = tokens.dtype.itemsize
            data = tokens[expand(offs[owner] + start, size)]
            ends = pa.array(np.concatenate(([0], np.cumsum(size * wide))).astype(np.int32))
            binary = pa.Array.from_buffers(pa.binary(), len(size), [None, ends.buffers()[1], pa.py_buffer(data.tobytes())])
            i = pa.array(owner)
            yield pa.RecordBatch.from_arrays([part.column(0).take(i), part.column(1).take(i), flat.field("start"), flat.field("anchor"), flat.field("again"), flat.field("mid"), binary], names=["doc_id", "h", "start", "anchor", "again", "mid", "segment"])

    return run


def found_spans(rows: DataFrame, win: Window, cut, method) -> DataFrame:
    """doc_id, h, spans of the rows (keyed()): known repeats, and those that
    `method`, a mapInArrow function from OPEN rows by anchor to SPANS, finds."""
    known, rest = repeats(rows, win)
    asked = rest.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "mid", "len", "anchor", "again")).alias("segs"))
    segs = attach(packed(rows), asked, "inner").select("doc_id", "h", "text", "segs").mapInArrow(unpack(open_segments(cut)), OPEN)
    found = segs.repartition(parts(rows), "anchor").sortWithinPartitions("anchor", "doc_id", "h", "start").mapInArrow(method, SPANS)
    return durable(spans_of(known, found), "repeat-spans")


def _strip(batches):
    for part in (p for batch in batches for p in pieces(batch, "text", 1 << 20)):
        data, offs = raw(part.column(2))
        gone = covered(offs, part.column(3))
        cut = np.zeros(len(data) + 1, bool)
        cut[offs] = True
        edge = np.concatenate(([False], gone, [False]))
        first = np.flatnonzero(gone & (~edge[:-2] | cut[:-1]))
        last = np.flatnonzero(gone & (~edge[2:] | cut[1:])) + 1
        row = np.searchsorted(offs, first, side="right") - 1
        spans = pa.StructArray.from_arrays([pa.array(first - offs[row]), pa.array(last - first)], ["start", "len"])
        ends = np.concatenate(([0], np.cumsum(~gone)))[offs].astype(np.int32)
        kept = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data[~gone].tobytes())])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)), spans)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offs)), lists, kept], names=["doc_id", "n_bytes", "spans", "kept"])


def suffix_dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, spans (maximal runs of bytes
    that lie in a `width`-byte string which also starts anywhere else, in this
    document or another), kept (the other bytes). Texts are UTF-8; null is empty
    and shorter texts have no span. Repeated rows repeat each other. Other
    columns are ignored; an empty table gives an empty table."""
    rows = keyed(docs)
    win = Window(width, 16, byte_tokens)

    def merged(strings: list[np.ndarray], i: np.ndarray, batch: pa.RecordBatch) -> list[np.ndarray]:
        return repeated(strings, (batch.column(1).to_numpy()[i] & 1).astype(bool), width)

    lists = found_spans(rows, win, raw, by_anchor(win, CHUNK, np.uint8, merged))
    return attach(packed(rows), lists).select("doc_id", "h", "text", "spans").mapInArrow(unpack(_strip), "doc_id long, n_bytes long, spans array<struct<start: long, len: long>>, kept binary")


def digest(out: DataFrame) -> DataFrame:
    """The columns of the contract, from suffix_dedup's spans and kept bytes."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["len"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
