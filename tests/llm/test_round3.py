"""WARC archives and their index, whitening and spelling variants against brute
force, on tables that hold nulls, empty and long texts, ties, repeated rows and
columns of clashing names."""

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from stylospark.llm import spelling, warc, whitening

PAGES = "page_id long, url string, html string, id long, digest string, run string, range int"


def pages():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("ab é\r\n<>") for _ in range(n))
    big, small = text(1500), text(200)
    out = [(i, f"http://WWW.site{i % 4}.org:80/p/{i % 7}?q={i % 3}#frag", text(rng.randint(0, 3000))) for i in range(60)]
    out += [(100 + i, "http://hot.org/", big) for i in range(9)] + [(200 + i, f"https://b.org:8443/{i}", small) for i in range(3)]
    out += [(108, "http://hot.org/", big), (None, "http://hot.org/", big), (300, None, None), (301, "", ""), (302, "no url\r\nat all", "WARC/1.1\r\nWARC-Type: x\r\n\r\n\r\n\r\nWARC/1.1\r\n" * 40)]
    out += [(303, "http://[bad", "x" * 200_000), (304, "http://x.org/a b", None), (304, "http://x.org/a b", None), (-5, "http://neg.org", "n" * 999), (-4, "http://neg.org", "n" * 999)]
    return [(p, u, h, 7, "d", "r", 1) for p, u, h in out]


def test_warc(spark, tmp_path):
    df = spark.createDataFrame(pages(), PAGES).repartition(5)
    path = f"file://{tmp_path}/archives"
    warc.write(df, path, file_bytes=20_000)
    got = warc.history(warc.index(spark, path)).orderBy("range", "place").collect()
    last = defaultdict(lambda: None)
    for p, _, h, *_ in pages():
        if p is not None:
            last[h or ""] = p if last[h or ""] is None else max(p, last[h or ""])
    want = []
    for p, _, h, *_ in pages():
        b, top = (h or "").encode(), last[h or ""]
        again = len(b) >= 1000 and top is not None and (p is None or p < top)
        want.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top if again else None))
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=repr) == sorted(want, key=repr)
    order = [(r.url_key, r["at"], r.id, r.run, r.pos) for r in got]
    assert order == sorted(order) and len({r.run for r in got}) > 3
    assert {r.url_key for r in got if r.page_id == 0} == {"org,site0,www)/p/0?q=0"} and {r.url_key for r in got if r.page_id == 200} == {"org,b:8443)/0"}
    # every archive is a run of records whose offsets and lengths lead to them
    files = {p.name: gzip.decompress(p.read_bytes()) for p in Path(f"{tmp_path}/archives").glob("part-*")}
    html = {p: h or "" for p, _, h, *_ in pages()}
    for r in got:
        rec = files[r.run][r.offset : r.offset + r.length]
        assert rec.startswith(b"WARC/1.1\r\n") and rec.endswith(b"\r\n\r\n")
        if r.record_type == "response" and r.page_id is not None:
            assert rec[:-4].endswith(html[r.page_id].encode())
    assert sum(r.length for r in got) == sum(map(len, files.values()))


def test_warc_empty_and_broken(spark, tmp_path):
    warc.write(spark.createDataFrame([], PAGES), f"file://{tmp_path}/none")
    assert warc.history(warc.index(spark, f"file://{tmp_path}/none")).count() == 0
    warc.write(spark.createDataFrame([(1, "http://a.org", "text")], "page_id long, url string, html string"), f"file://{tmp_path}/one", compression="none")
    content = next(p.read_bytes() for p in Path(f"{tmp_path}/one").glob("part-*") if p.stat().st_size)
    assert len(list(warc.captures(content))) == 1
    for broken in (content[:-1], content.replace(b"text\r\n", b"tixt\r\n"), b"x" + content):
        with pytest.raises(ValueError):
            list(warc.captures(broken))


def test_loser_tree_merges_any_runs():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16, 33):
        runs = [sorted((rng.randint(0, 20), rng.choice("ab")) for _ in range(rng.randint(0, 12))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_ranges_cut_one_url_and_lose_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE", 20)
    df = spark.range(300).select(F.col("id").alias("page_id"), F.lit("http://one.org/").alias("url"), F.col("id").cast("string").alias("html"))
    warc.write(df, f"file://{tmp_path}/a", file_bytes=1000)
    rows = warc.history(warc.index(spark, f"file://{tmp_path}/a")).orderBy("range", "place").collect()
    assert [r.page_id for r in rows] == list(range(300)) and len({r.range for r in rows}) > 4


def vectors():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 6))
    out = [(int(i), (rng.normal(size=6) @ base).tolist()) for i in range(300)]
    out += [(400 + i, out[3][1]) for i in range(50)] + [(7, out[7][1]), (None, out[8][1]), (500, None), (501, [1.0, None, 0, 0, 0, 0]), (502, [float("nan")] * 6), (503, [1.0, 2, 3, 4, 5, float("inf")]), (504, [0.0] * 6), (505, [-0.0] * 6), (506, [1.0]), (507, [])]
    return [(i, v and [None if c is None else float(c) for c in v], 1, 2.0) for i, v in out]


VECTORS = "vec_id long, embedding array<float>, component int, x double"


def test_whitening(spark):
    own = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v, *_ in vectors() if v is not None and len(v) == 6 and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in own}), dtype=object)
    n, sums = len(fit), fit.sum(0)
    mean = np.array(sums / n, float)
    y = fit.astype(float) - mean
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    got = whitening.whiten(spark.createDataFrame(vectors(), VECTORS).repartition(4)).collect()
    assert Counter(r.vec_id for r in got) == Counter(k for i, _ in own for k in [i] * 4)
    sign, by = {}, defaultdict(list)
    for i, x in own:
        by[i].append(x)
    for r in got:
        x = np.array(by[r.vec_id][0], dtype=object)
        want = float((x.astype(float) - mean) @ u[:, r.component - 1] / np.sqrt(e[r.component - 1]))
        assert r.n == n and r.deviation == int(((n * x - sums) ** 2).sum()) and abs(r.explained - e[r.component - 1] / v.trace()) < 1e-10 and r.identity_error < 1e-10
        if abs(want) > 1e-3:
            assert sign.setdefault(r.component, np.sign(want * r.whitened)) == np.sign(want * r.whitened)
        assert abs(abs(want) - abs(r.whitened)) < 1e-8


def test_whitening_without_rows_or_rank(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0, 0.0)] * 3, VECTORS)).count() == 0
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0], 0, 0.0) for i in range(10)], VECTORS)).collect()
    assert {r.component for r in line} == {1} and all(abs(r.explained - 1) < 1e-12 for r in line)


def test_factor_and_rotations():
    rng = np.random.default_rng(0)
    for d, rank in ((1, 1), (5, 5), (9, 4), (64, 64)):
        b = rng.normal(size=(d, rank)) * 10.0 ** rng.integers(-3, 3, rank)
        a = b @ b.T
        g = whitening.pivoted_cholesky(a)
        assert g.shape[1] <= max(rank, 1) + 1 and np.abs(g @ g.T - a).max() <= 1e-12 * np.abs(a).max()
        e, u = whitening.jacobi(g)
        assert np.abs(u.T @ u - np.eye(len(e))).max() < 1e-10 and np.abs(e - np.linalg.eigvalsh(a)[::-1][: len(e)]).max() < 1e-11 * e.max()


def test_deviation_beyond_64_bits_is_exact_or_an_error():
    f = object.__new__(whitening.Fit)
    f.d, f.n, f.sums = 2, 3_000_000_000, np.array([5, -7])
    x = np.array([[1, -1], [0, 0]])
    assert f.deviation(x).tolist() == [(f.n * 1 - 5) ** 2 + (-f.n + 7) ** 2, 74]


DOCS = "doc_id long, text string, word string, n long, h long, key string"


def letters():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdé÷") for _ in range(rng.randint(3, 9))) for _ in range(150)] + ["colour", "color", "colours", "Colour", "banana", "bananna", "banan", "aaaaa", "aaaaaa", "aaaa", "bbbbb"]
    words += [w[:i] + rng.choice("abcdx") + w[i + rng.randint(0, 1) :] for w in words for i in (rng.randrange(len(w)),)]
    out = [(i, " ".join(rng.choices(words, [1 + (j % 13) ** 2 for j in range(len(words))], k=rng.randint(0, 120)))) for i in range(150)]
    out += [(None, "colour colour, colour"), (500, None), (501, ""), (502, "1 2 _"), (503, "colours-colours_colours " * 3000), (504, "ab cd"), (504, "ab cd"), (505, "z" * 5000 + " " + "z" * 5000 + "\n" + "z" * 5001)]
    return [(d, t, "w", 1, 2, "k") for d, t in out]


def brute(rows):
    n = Counter()
    for d, t, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}

    def one(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, out = {}, {}
    for w, c in n.items():
        near = [x for x in n if abs(len(x) - len(w)) < 2 and x != w and one(w, x)]
        top = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = top if top and n[top] >= 2 * c else None
        out[w] = len(near)
    rows = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n[w], out[w], n[form[w]] if form[w] else None))
    return sorted(rows, key=repr)


@pytest.mark.parametrize(("most", "longest_list"), [(200_000, 64), (0, 2), (300, 1)])
def test_spelling(spark, most, longest_list):
    docs = spark.createDataFrame(letters(), DOCS).repartition(4)
    want = brute(letters())
    assert len(want) > 100 and sum(r[1] is not None for r in want) > 30 and any(r[1] != r[2] and r[1] for r in want)
    got = spelling.variants(docs, most, longest_list)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_spelling_of_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], DOCS)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None, "", 0, 0, "")], DOCS)).count() == 0


def test_bound_holds_for_every_edit():
    rng = random.Random(4)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(5, 8))) for _ in range(300)}
    counts = Counter()
    for w in words:
        s = spelling.BEGIN + w + spelling.END
        for i in range(len(s)):
            for q in range(2, 6):
                if i + q <= len(s):
                    counts[s[i : i + q]] += 1
    kept = {g: c for g, c in counts.items() if len(g) == 2 or counts[g[:-1]] > 40}
    grams = spelling.Grams(kept)
    for w in sorted(words)[:120]:
        for i in range(len(w) + 1):
            for t in {w[:i] + w[i + 1 :], *(w[:i] + c + w[i:] for c in "abc"), *(w[:i] + c + w[i + 1 :] for c in "abc")} - {w}:
                s, o = (spelling.BEGIN + x + spelling.END for x in (w, t))
                if any(o[k : k + 2] not in kept for k in range(len(o) - 1)):
                    continue
                a, b = Counter(s[p:e] for p, e in grams.cut(s)), Counter(o[p:e] for p, e in grams.cut(o))
                assert sum((a & b).values()) >= sum(a.values()) - grams.bound(s, grams.cut(s))
