"""WARC archives of pages, and their index by an external merge.

write() makes one WARC/1.1 record a page: of equal payloads of at least `least`
bytes the page with the largest page_id is a response, the others revisit it. A
record ends in CR LF CR LF, whose last LF is the line end of Spark's text writer:
the files are plain WARC byte for byte, on any store that Spark can write to.

index() reads archives back, a file a row, follows the Content-Lengths, checks each
payload against its digest, and sorts the captures of a file by URL key, time and
id: a run. history() merges all runs: bounds from a sample of the keys cut the key
space into ranges of even size (bounds are whole sort keys, so that one URL with
many captures is cut as well), and each range merges its slices of the runs by a
loser tree. Numbered by range and place, the captures are in one global order.

Null html is an empty payload, null url a record without a target (its key is
empty and sorts first), null page_id less than any other and null when read back.
Rows repeated whole give a record each; of rows with one page_id and equal
payloads none revisits another. Other columns aren't read.
"""

from __future__ import annotations

import gzip
import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, durable, parts

LEAST, FILE_BYTES, RANGE, SAMPLE = 1000, 32 << 20, 100_000, 64
NOBODY = -(1 << 63)
CAPTURE = "url_key string, at long, id long, run string, pos long, offset long, length long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: Sort key of a capture. Run and place in it part equal captures.
KEY = ["url_key", "at", "id", "run", "pos"]


def _digests(pages: DataFrame) -> DataFrame:
    html = F.coalesce(column(pages, "html", "string"), F.lit(""))
    return pages.select(F.coalesce(column(pages, "page_id", "long"), F.lit(NOBODY)).alias("id"), F.sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("bytes"), html.alias("html"), column(pages, "url", "string").alias("url"))


def revisits(digests: DataFrame, least: int = LEAST) -> DataFrame:
    """id, digest, refers_to of the pages that revisit another: digests has id,
    digest and bytes. Groups are counted before anything is joined to them."""
    big = digests.where(F.col("bytes") >= least)
    best = big.groupBy("digest", "bytes").agg(F.max("id").alias("refers_to"), F.min("id").alias("first")).where("first < refers_to").drop("first")
    return big.join(best, ["digest", "bytes"]).where("id < refers_to").select("id", "digest", "refers_to").distinct()


def _record(epoch: int) -> Column:
    """A record without its last line feed."""
    crlf = "\r\n"
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.when(c == NOBODY, "none").otherwise(c.cast("string")), F.lit(">"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(crlf)), F.lit(""))
    uri = F.col("url")
    for a, b in (("\r", "%0D"), ("\n", "%0A"), ("\t", "%09"), (" ", "%20")):
        uri = F.replace(uri, F.lit(a), F.lit(b))
    again = F.col("refers_to").isNotNull()
    # a date has four digits of a year: pages beyond year 9999 start again
    second = F.when(F.col("id") == NOBODY, 0).otherwise(F.pmod(F.col("id"), F.lit(200_000_000_000))) + epoch
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), F.col("bytes").cast("string"), F.lit(crlf * 2))
    body = F.when(again, http).otherwise(F.concat(http, "html"))
    size = F.octet_length(http) + F.when(again, 0).otherwise(F.col("bytes"))
    return F.concat(
        F.lit(f"WARC/1.1{crlf}"), line("WARC-Type", F.when(again, "revisit").otherwise("response")), line("WARC-Record-ID", urn(F.col("id"))), line("WARC-Target-URI", uri),
        line("WARC-Date", F.date_format(F.timestamp_seconds(second), "yyyy-MM-dd'T'HH:mm:ss'Z'")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("WARC-Refers-To", F.when(again, urn(F.col("refers_to")))), line("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", size.cast("string")), F.lit(crlf), body, F.lit("\r\n\r"),
    )


def write(pages: DataFrame, path: str, least: int = LEAST, epoch: int = 946684800, file_bytes: int = FILE_BYTES, compression: str = "gzip") -> None:
    """Archives of about file_bytes (before compression: gzip or none) each below path. pages have no capture time:
    page_id seconds after `epoch` stand for it."""
    d = _digests(pages)
    narrow = durable(d.select("id", "digest", "bytes"), "warc-digests")
    total = narrow.agg(F.sum("bytes")).first()[0] or 0
    files = max(parts(pages), -(-total // file_bytes))
    again = revisits(narrow, least)
    zone = pages.sparkSession.conf.get("spark.sql.session.timeZone")
    pages.sparkSession.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        d.repartition(files, "id", "digest").join(again, ["id", "digest"], "left").select(_record(epoch).alias("value")).write.text(path, compression=compression)
    finally:
        pages.sparkSession.conf.set("spark.sql.session.timeZone", zone)


def url_key(url: str) -> str:
    """The host's labels from last to first, then path and query: captures of one
    site sort together. Lower-case host, no scheme, user, default port or fragment."""
    try:
        u = urlsplit(url.strip())
        host, port = u.hostname or "", u.port
    except ValueError:
        return url
    if not host:
        return url
    odd = f":{port}" if port and port != {"http": 80, "https": 443}.get(u.scheme) else ""
    return ",".join(reversed(host.split("."))) + odd + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


def _page(urn: bytes | None) -> int | None:
    found = (urn or b"").strip(b"<>").rpartition(b":")[2]
    return int(found) if found.lstrip(b"-").isdigit() else None


def plain(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def captures(content: bytes) -> Iterator[tuple]:
    """Columns of CAPTURE from offset on, with url_key, at and id before them, of
    each record. A broken archive raises ValueError."""
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        first, *lines = content[at:end].split(b"\r\n")
        if end < 0 or not first.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record at byte {at}")
        h = {k.lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines)}
        size = int(h[b"content-length"])
        stop = end + 4 + size
        if content[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where it says")
        block, kind, digest = memoryview(content)[end + 4 : stop], h[b"warc-type"].decode(), h[b"warc-payload-digest"].decode().removeprefix("sha1:")
        head = content.find(b"\r\n\r\n", end + 4, stop)
        said = next(int(x.partition(b":")[2]) for x in content[end + 4 : head].split(b"\r\n") if x.lower().startswith(b"content-length:"))
        if kind == "response":
            payload = block[head + 4 - (end + 4) :]
            if len(payload) != said or hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"the payload of the record at byte {at} isn't what was written")
        uri = h.get(b"warc-target-uri", b"").decode()
        when = int(datetime.strptime(h[b"warc-date"].decode(), "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc).timestamp())
        page = _page(h[b"warc-record-id"])
        yield url_key(uri), when, NOBODY if page is None else page, at, stop + 4 - at, page, uri or None, said, digest, kind, _page(h.get(b"warc-refers-to"))
        at = stop + 4


def index(spark: SparkSession, path: str) -> DataFrame:
    """CAPTURE rows of all archives below path, written once: each file's are a sorted run."""
    schema = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64()}[f.split()[1]]) for f in CAPTURE.split(", ")])

    def read(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                own = sorted(captures(plain(content.as_py())), key=lambda c: c[:3])
                rows = [(*c[:3], name, i, *c[3:]) for i, c in enumerate(own)]
                for k in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows[k : k + 10_000]), schema)], schema=schema)

    files = spark.read.format("binaryFile").load(path).where("length > 0")
    return durable(files.select(F.element_at(F.split("path", "/"), -1).alias("run"), "content").mapInArrow(read, CAPTURE), "warc-runs")


class LoserTree:
    """Merges sorted runs. Each inner node keeps the loser of the match between the
    winners below it, so the next least head costs one path of matches."""

    def __init__(self, runs: Iterable[Iterable]):
        self.runs = [iter(r) for r in runs]
        self.heads = [self._next(i) for i in range(len(self.runs))]
        self.losers: list[int | None] = [None] * max(1, len(self.runs))
        for i in range(len(self.runs)):
            self._play(i)

    def _next(self, i: int) -> tuple:
        for item in self.runs[i]:
            return (0, item, i)
        return (1, None, i)

    def _play(self, i: int) -> None:
        node = (i + len(self.runs)) // 2
        while node:
            other = self.losers[node]
            if other is None:  # while the tree is built: waits for its opponent
                self.losers[node] = i
                return
            if self.heads[other] < self.heads[i]:
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator:
        while self.runs and not self.heads[self.losers[0]][0]:
            i = self.losers[0]
            yield self.heads[i][1]
            self.heads[i] = self._next(i)
            self._play(i)


def bounds(runs: DataFrame, ranges: int) -> list[tuple]:
    """At most ranges - 1 sort keys that cut the captures about evenly: quantiles of
    the SAMPLE * ranges captures with the least hashes. Any bounds give right results."""
    found = sorted(tuple(r) for r in runs.select(*KEY).orderBy(F.xxhash64(*KEY)).limit(SAMPLE * ranges).collect())
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []


def history(runs: DataFrame) -> DataFrame:
    """All captures of runs (CAPTURE), with range and place in it: by these two they
    are in order of URL key, time and id over all runs. A range has about RANGE
    captures, which one task merges."""
    ranges = max(1, min(parts(runs), 1 << 14), -(-runs.count() // RANGE))
    cuts = bounds(runs, ranges) if ranges > 1 else []
    names = [f.split()[0] for f in CAPTURE.split(", ")]

    def deal(batches):
        for b in batches:
            key = zip(*(b.column(k).to_pylist() for k in KEY))
            where = pa.array([bisect_right(cuts, k) for k in key], pa.int32())
            yield pa.RecordBatch.from_arrays([where, *b.columns], names=["range", *names])

    def merge(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        run, at = t["run"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False), t["pos"].to_numpy()
        rows = np.lexsort((at, run))  # the slice of each run, as it lies in it
        keys = [t[k].to_pylist() for k in KEY]
        slices = np.split(rows, np.flatnonzero(np.diff(run[rows])) + 1)
        merged = [x[-1] for x in LoserTree([[(*(k[i] for k in keys), i) for i in s.tolist()] for s in slices])]
        return t.take(pa.array(merged, pa.int64())).append_column("place", pa.array(np.arange(len(merged)), pa.int64()))

    dealt = runs.select(*names).mapInArrow(deal, "range int, " + CAPTURE)
    return dealt.groupBy("range").applyInArrow(merge, f"range int, {CAPTURE}, place long")
