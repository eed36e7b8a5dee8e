"""Token-ID files coded with a static range asymmetric numeral system.

Documents in ascending doc_id order are cut into segments. A segment counts its
tokens first and stores one frequency table, shared by its independent blocks;
a block interleaves many coder lanes over one stream of 32-bit words. Every
block carries checkpoints (lane states within the stream, so a part of a block
can be decoded on its own) and a CRC of its ids. Segments are the binary rows of
a table written by Spark's own writer, so files are committed atomically on any
file system, and readers decode them in parallel.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_chars
from .common import column, expand, parts

MAGIC = b"RANS0001"
LOW = np.uint64(1 << 31)
SEGMENT, BLOCK, LANES, CHECK = 1 << 21, 1 << 19, 4096, 64
SCHEMA = "shard int, seg int, n_docs long, n_tokens long, payload binary"


def table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbols, frequencies, bits): counts scaled to a sum of 2**bits, none zero."""
    if len(ids) and int(ids.max()) < 1 << 22:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        counts = counts[symbols]
    else:
        symbols, counts = np.unique(ids, return_counts=True)
    bits = max(12, int(len(symbols)).bit_length() + 2)
    if not len(symbols):
        return symbols, counts, bits
    freq = np.maximum(1, counts.astype(np.int64) * (1 << bits) // counts.sum())
    spare = (1 << bits) - int(freq.sum())
    if spare >= 0:
        freq[np.argmax(freq)] += spare
    while spare < 0:
        k = np.argsort(-freq)[: max(1, min(-spare, int((freq > 1).sum())))]
        k = k[freq[k] > 1]
        freq[k] -= 1
        spare += len(k)
    return symbols, freq, bits


def encode_block(sym: np.ndarray, freq: np.ndarray, cum: np.ndarray, bits: int) -> bytes:
    """sym: indices into the table. Header, checkpoints, words."""
    n = len(sym)
    lanes = max(1, min(LANES, n // 32))
    steps = -(-n // lanes)
    x = np.full(lanes, LOW, np.uint64)
    f_all, c_all = freq[sym].astype(np.uint64), cum[sym].astype(np.uint64)
    up, sh = np.uint64(63 - bits), np.uint64(bits)
    words, marks = [], []
    for t in range(steps - 1, -1, -1):
        f, c = f_all[t * lanes : (t + 1) * lanes], c_all[t * lanes : (t + 1) * lanes]
        y = x[: len(f)]
        full = y >= (f << up)
        out = y[full]
        words.append(out.astype(np.uint32))
        y[full] = out >> np.uint64(32)
        q = y // f
        y[:] = (q << sh) + (y - q * f) + c
        if t % CHECK == 0:
            marks.append((t, x.copy()))
    words.reverse()
    at = np.concatenate(([0], np.cumsum([len(w) for w in words])))
    head = [struct.pack("<IIIII", n, lanes, len(marks), int(at[-1]), zlib.crc32(sym.astype("<u4").tobytes()))]
    for t, state in reversed(marks):
        head.append(struct.pack("<IQ", t, int(at[t])) + state.astype("<u8").tobytes())
    return b"".join(head) + np.concatenate(words).astype("<u4").tobytes()


def decode_block(data: bytes, freq: np.ndarray, cum: np.ndarray, bits: int, part: int | None = None) -> np.ndarray:
    """Indices of a block; of the part between two checkpoints, if given."""
    n, lanes, marks, n_words, crc = struct.unpack_from("<IIIII", data)
    size = 12 + 8 * lanes
    words = np.frombuffer(data, "<u4", n_words, 20 + marks * size).astype(np.uint64)
    first = 20 + (part or 0) * size
    t, at = struct.unpack_from("<IQ", data, first)
    x = np.frombuffer(data, "<u8", lanes, first + 12).astype(np.uint64)
    slots = np.repeat(np.arange(len(freq)), freq)
    f_all, c_all = freq.astype(np.uint64), cum.astype(np.uint64)
    end = -(-n // lanes) if part is None else min(-(-n // lanes), t + CHECK)
    out, mask, sh = [], np.uint64((1 << bits) - 1), np.uint64(bits)
    for t in range(t, end):
        y = x[: min(lanes, n - t * lanes)]
        slot = y & mask
        s = slots[slot.astype(np.int64)]
        y[:] = f_all[s] * (y >> sh) + slot - c_all[s]
        low = y < LOW
        k = int(low.sum())
        y[low] = (y[low] << np.uint64(32)) | words[at : at + k]
        at += k
        out.append(s)
    sym = np.concatenate(out) if out else np.zeros(0, np.int64)
    if part is None and zlib.crc32(sym.astype("<u4").tobytes()) != crc:
        raise ValueError("a token block fails its checksum")
    return sym


def pack_segment(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment: the table, its documents and its blocks. doc_ids may be null."""
    symbols, freq, bits = table(ids)
    cum = np.cumsum(freq) - freq
    place = np.zeros(int(symbols[-1]) + 1 if len(symbols) and symbols[-1] < 1 << 22 else 0, np.int32)
    if len(place):
        place[symbols] = np.arange(len(symbols))
    sym = place[ids] if len(place) else np.searchsorted(symbols, ids)
    blocks = [encode_block(sym[a : a + BLOCK], freq, cum, bits) for a in range(0, len(sym), BLOCK)]
    index = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], np.uint8).tobytes() + counts.astype("<i8").tobytes()
    head = struct.pack("<IIIQI", bits, len(symbols), len(doc_ids), len(ids), len(blocks))
    body = symbols.astype("<u4").tobytes() + freq.astype("<u4").tobytes() + index + np.array([len(b) for b in blocks], "<u8").tobytes() + b"".join(blocks)
    return MAGIC + struct.pack("<I", zlib.crc32(head + body)) + head + body


def unpack_segment(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc_ids, counts, ids) of a segment; a wrong checksum raises."""
    if data[:8] != MAGIC or zlib.crc32(data[12:]) != struct.unpack_from("<I", data, 8)[0]:
        raise ValueError("not a whole token segment")
    bits, n_sym, n_docs, n, n_blocks = struct.unpack_from("<IIIQI", data, 12)
    at = 12 + struct.calcsize("<IIIQI")
    take = lambda kind, k: np.frombuffer(data, kind, k, at)
    symbols = take("<u4", n_sym)
    at += 4 * n_sym
    freq = take("<u4", n_sym).astype(np.int64)
    at += 4 * n_sym
    docs = take("<i8", n_docs).tolist()
    at += 8 * n_docs
    docs = [None if null else d for d, null in zip(docs, take(np.uint8, n_docs))]
    at += n_docs
    counts = take("<i8", n_docs)
    at += 8 * n_docs
    sizes = take("<u8", n_blocks).astype(np.int64)
    at += 8 * n_blocks
    cum, out = np.cumsum(freq) - freq, []
    for size in sizes.tolist():
        out.append(symbols[decode_block(data[at : at + size], freq, cum, bits)])
        at += size
    return docs, counts, np.concatenate(out) if out else np.zeros(0, np.uint32)


_LETTERS = r"a-zA-Z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF"
#: Words whose pieces are known without the library's rules for whole texts: letters that neither normal forms nor
#: lower-casing change other than one by one, digits, and signs other than the apostrophe.
PLAIN = re.compile(rf"[{_LETTERS}0-9!-&(-/:-@\[-`{{-~]+")
SIGNS = b".,;:!?|$&%*#"
PIECES = re.compile(rf"[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")


class WordCache:
    """Ids of white-space separated words as the library gives them, in two
    generations: words of the older one that are met again move to the newer,
    the rest goes when that is full. A text that may hold an added token goes to
    the library whole."""

    def __init__(self, path: str, size: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.size = Tokenizer.from_file(path), size
        self.tok.no_padding(), self.tok.no_truncation()
        self.added = [t.content.encode()[:2].lower() for t in self.tok.get_added_tokens_decoder().values()]
        vocabulary = self.tok.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        # the model alone, over pieces that are normalised, split and written in byte characters here
        spec = json.load(open(path, encoding="utf-8"))
        spec["normalizer"], spec["pre_tokenizer"] = None, {"type": "WhitespaceSplit"}
        self.model = Tokenizer.from_str(json.dumps(spec))
        self.model.no_padding(), self.model.no_truncation()
        self.chars = byte_chars()
        self.old: dict[bytes, int] = {}
        self.start()

    def start(self) -> None:
        """An empty newer generation: the ids of its word k are flat[at[k]:at[k] + count[k]]."""
        self.slot: dict[bytes, int] = {}
        self.flat, self.at, self.count = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.used = 0

    def put(self, words: list[bytes], ids: np.ndarray, n: np.ndarray) -> None:
        k = len(self.slot)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while k + len(words) > len(self.at):
            self.at, self.count = np.concatenate((self.at, np.zeros_like(self.at))), np.concatenate((self.count, np.zeros_like(self.count)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.at[k : k + len(n)], self.count[k : k + len(n)] = self.used + np.cumsum(n) - n, n
        self.used += len(ids)
        self.slot.update(zip(words, range(k, k + len(words))))

    def learn(self, words: list[bytes]) -> None:
        """Cache the words. The pieces of those that are PLAIN go to the model many
        in one text and are parted at the end-of-word marks; the rest goes to the
        library one by one."""
        bare = [w for w in words if w.isalpha()]  # letters of ASCII: one piece each
        left, joint, bases, tails = [], [], [], []
        for w in words:
            if not w.isalpha():
                base = w.rstrip(SIGNS)
                if base and len(base) < len(w) and (base[-1:].isalnum() or base[-1] > 127 and PLAIN.fullmatch(base.decode()[-1])):
                    joint.append(w), bases.append(base), tails.append(w[len(base) :])
                else:
                    left.append(w)
        if joint:  # a word and the signs after it are pieces apart
            new = [x for x in {*bases, *tails}.difference(words) if x not in self.slot]
            bare += [w for w in new if w.isalpha()]
            left += [w for w in new if not w.isalpha()]
        rest, plain, marks, pieces = [], [], [], []
        for w in left:
            t = w.decode()
            if not PLAIN.fullmatch(t):
                rest.append(w)
                continue
            own = PIECES.findall(t)
            if not t.isascii():
                own = ["".join(map(self.chars.__getitem__, p.lower().encode())) for p in own]
            plain.append(w), marks.append(len(own))
            pieces.extend(own)
        rest = self._model(bare, b" ".join, [1] * len(bare), bare) + rest + self._model(plain, " ".join, marks, pieces)
        if rest:
            got = [np.array(e.ids, np.int32) for e in self.tok.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)]
            self.put(rest, np.concatenate(got), np.array([len(g) for g in got], np.int64))
        if joint:
            k = np.stack([np.fromiter(map(self.slot.__getitem__, x), np.int64, len(joint)) for x in (bases, tails)], 1)
            n = self.count[k]
            self.put(joint, self.flat[expand(self.at[k].ravel(), n.ravel())], n.sum(1))

    def _model(self, words: list[bytes], join, marks: list[int], pieces: list) -> list[bytes]:
        """Cache words of so many pieces (marks) each; those that didn't part."""
        odd, last = [], 0
        for a in range(0, len(words), 512):
            own, n = words[a : a + 512], np.array(marks[a : a + 512])
            first, last = last, last + int(n.sum())
            text = join(pieces[first:last])
            ids = np.array(self.model.encode_batch_fast([text if isinstance(text, str) else text.decode()], add_special_tokens=False)[0].ids)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == n.sum() and ends[-1] == len(ids):
                self.put(own, ids, np.diff(ends[np.cumsum(n) - 1], prepend=0))
            else:
                odd += own
        return odd

    def recall(self, words: list[bytes]) -> list[bytes]:
        """Move words of the older generation to the newer; what isn't there."""
        k = np.fromiter(map(self.old.get, words, repeat(-1)), np.int64, len(words))
        here = k >= 0
        if here.any():
            flat, at, count = self.past
            n = count[k[here]]
            self.put([w for w, x in zip(words, here.tolist()) if x], flat[expand(at[k[here]], n)], n)
        return [w for w, x in zip(words, here.tolist()) if not x]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.slot) > self.size or self.used > 8 * self.size:
            self.old, self.past = self.slot, (self.flat, self.at, self.count)
            self.start()
        raw = [t.encode() for t in texts]
        split = [[] if any(a in b for a in self.added) else b.lower().split() for b in raw]
        whole = [bool(t) and any(a in b for a in self.added) for t, b in zip(texts, raw)]
        flat = list(chain.from_iterable(split))
        k = np.fromiter(map(self.slot.get, flat, repeat(-1)), np.int64, len(flat))
        unseen = np.flatnonzero(k < 0).tolist()
        if unseen:
            new = list(dict.fromkeys([flat[i] for i in unseen]))
            if new := self.recall(new) if self.old else new:
                self.learn(new)
            k[unseen] = [self.slot[flat[i]] for i in unseen]
        n = self.count[k]
        ids = self.flat[expand(self.at[k], n)]
        ends = np.concatenate(([0], np.cumsum(n)))[np.cumsum([0] + [len(ws) for ws in split])]
        return [np.array(self.tok.encode(t, add_special_tokens=False).ids, np.int32) if w else ids[a:b] for t, w, a, b in zip(texts, whole, ends[:-1].tolist(), ends[1:].tolist())]


_MADE: dict[str, WordCache] = {}


def _write(path: str, end_id: int):
    def run(batches):
        if path not in _MADE:
            _MADE[path] = WordCache(path)
        coder = _MADE[path]
        docs, rows, seg, size, shard = [], [], 0, 0, None

        def flush():
            nonlocal docs, rows, seg, size
            counts = np.array([len(r) for r in rows], np.int64)
            payload = pack_segment(docs, counts, np.concatenate(rows))
            out = pa.RecordBatch.from_pylist([{"shard": shard, "seg": seg, "n_docs": len(docs), "n_tokens": size, "payload": payload}], schema=pa.schema([("shard", pa.int32()), ("seg", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())]))
            docs, rows, size = [], [], 0
            seg += 1
            return out

        for batch in batches:
            texts, ids = batch.column(2).to_pylist(), batch.column(1).to_pylist()
            if batch.num_rows and shard is None:
                shard = batch.column(0)[0].as_py()
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars < 1 << 20):
                    chars += len(texts[end])
                    end += 1
                for d, r in zip(ids[at:end], coder.encode_batch(texts[at:end])):
                    docs.append(d), rows.append(np.append(r, np.int32(end_id)))
                    size += len(r) + 1
                    if size >= SEGMENT:
                        yield flush()
                at = end
        if docs:
            yield flush()

    return run


def fresh() -> str:
    """A name that no other run uses."""
    return uuid.uuid4().hex


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int = 1) -> None:
    """Tokenise every text (null: empty) with the tokenizers file and append
    end_id; write the ids under `out`, rows in ascending doc_id order (null
    first; rows of one doc_id by a hash of their text, then the text). An empty
    table writes an empty set of files. Other columns are ignored."""
    text = F.coalesce(column(docs, "text", "string"), F.lit(""))
    rows = docs.select(column(docs, "doc_id", "long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    rows = rows.repartitionByRange(parts(docs), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    rows.select(F.spark_partition_id().alias("shard"), "doc_id", "text").mapInArrow(_write(tokenizer, end_id), SCHEMA).write.parquet(out)


def _read(batches):
    kind = pa.schema([("shard", pa.int32()), ("seg", pa.int32()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    for batch in batches:
        for shard, seg, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            docs, counts, ids = unpack_segment(payload.as_py())
            ends = np.concatenate(([0], np.cumsum(counts)))
            offs = pa.array((ends * 4).astype(np.int32))
            raw = pa.Array.from_buffers(pa.binary(), len(docs), [None, offs.buffers()[1], pa.py_buffer(ids.astype("<u4").tobytes())])
            n = len(docs)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard, np.int32)), pa.array(np.full(n, seg, np.int32)), pa.array(docs, pa.int64()), pa.array(ends[:-1]), pa.array(counts), raw], schema=kind)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary,
    little-endian unsigned 32-bit) of files that write_tokens wrote."""
    files = spark.read.schema(SCHEMA).parquet(path)
    segs = files.select("shard", "seg", "n_tokens")
    shards = segs.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    base = segs.withColumn("own", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(shards, "shard").select("shard", "seg", (F.col("base") + F.col("own")).alias("base"))
    rows = files.select("shard", "seg", "payload").mapInArrow(_read, "shard int, seg int, doc_id long, local long, n_tokens long, ids binary")
    if base.count() <= 1_000_000:  # a row of three numbers for each segment; more are joined by shuffling
        base = F.broadcast(base)
    return rows.join(base, ["shard", "seg"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids")
