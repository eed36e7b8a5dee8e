"""The training-data operators against brute force on small tables, which hold
nulls, empty and long texts, ties, repeated rows and columns of clashing names."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stylospark.llm import bpe, bwt_dedup, exact_dedup, html_blocks, mixing, near_dedup, quality, rlz_dedup, token_files, topk
from stylospark.llm.common import raw

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, source string, h long, k string, start int"


def rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(60)
    out = [(i, text(rng.randint(1, 90)), f"s{i % 3}") for i in range(40)]
    out += [(100 + i, text(20) + "\n" + passage + " " + text(15), "s1") for i in range(6)]
    base = text(200).split()
    for i in range(8):
        w = list(base)
        w[i * 20] = "changed"
        out.append((200 + i, " ".join(w), "s0"))
    out += [(300, None, None), (301, "", "s0"), (302, " \t\n ", "s2"), (None, passage, None), (303, "x" * 3000, "s2"), (304, "long " * 1500, "s0"), (304, "long " * 1500, "s0"), (305, passage.replace(" ", "  "), "s1"), (306, passage, "s1")]
    return [(d, t, s, 1, "k", 2) for d, t, s in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    return [(r[0], r[1] or "") for r in rows()]


def same(got, want):
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


def test_exact_dedup(docs, empty):
    groups = defaultdict(list)
    for d, t in texts():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), d is not None, d))
    want = []
    for n, own in groups.items():
        best = min(own, key=lambda m: (m[0], m[1], m[2] or 0))  # rows() holds no two texts of one doc_id in a group
        want += [(m[2], best[2], len(own), m[:1] == best[:1] and m[2] == best[2], hashlib.sha256(n.encode()).hexdigest()) for m in own]
    same(exact_dedup.exact_dedup(docs).drop("x").collect(), want)
    assert exact_dedup.drop_copies(docs).count() == len(groups)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_fingerprints_compose():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 70_000, dtype=np.uint8).tobytes()
    for cut in (0, 1, 12345, len(data)):
        a, b = exact_dedup.fingerprint(data[:cut]), exact_dedup.fingerprint(data[cut:])
        assert tuple(exact_dedup.combine(k, a[k], b[k], len(data) - cut) for k in (0, 1)) == exact_dedup.fingerprint(data)


def test_huge_texts_are_hashed_in_chunks(docs):
    whole = exact_dedup.fingerprints(docs).select("doc_id", "n", "h1", "h2", "text_sha256").collect()
    same(exact_dedup.fingerprints(docs, huge=100).select("doc_id", "n", "h1", "h2", "text_sha256").collect(), whole)


def covered(seqs, width):
    count = Counter(s[i : i + width] for s in seqs for i in range(len(s) - width + 1))
    out = []
    for s in seqs:
        m = bytearray(len(s))
        for i in range(len(s) - width + 1):
            if count[s[i : i + width]] > 1:
                m[i : i + width] = b"\1" * width
        out.append(m)
    return out


def test_suffix_dedup(docs, empty):
    seqs = [t.encode() for _, t in texts()]
    want = []
    for (d, _), s, m in zip(texts(), seqs, covered(seqs, 200)):
        runs = sum(1 for i in range(len(m)) if m[i] and (i == 0 or not m[i - 1]))
        want.append((d, len(s), sum(m), runs, hashlib.sha256(bytes(b for b, x in zip(s, m) if not x)).hexdigest()))
    same(bwt_dedup.digest(bwt_dedup.suffix_dedup(docs)).collect(), want)
    assert bwt_dedup.suffix_dedup(empty).count() == 0


def test_rlz_dedup(docs, empty):
    seqs = [tuple(t.encode().split()) for _, t in texts()]
    want = [(d, len(s), sum(m), b" ".join(w for w, x in zip(s, m) if not x).decode()) for (d, _), s, m in zip(texts(), seqs, covered(seqs, 35))]
    same(rlz_dedup.rlz_dedup(docs).collect(), want)
    assert rlz_dedup.rlz_dedup(empty).count() == 0


@pytest.mark.parametrize("width", [1, 2, 5, 11, 16])
def test_repeats_of_a_block(width):
    rng = random.Random(width)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 50))) for _ in range(30)] + [b"", b"ababab"]
    count = Counter(s[i : i + width] for s in strings for i in range(len(s) - width + 1))
    want = [[i for i in range(len(s) - width + 1) if count[s[i : i + width]] > 1] for s in strings]
    arrays = [np.frombuffer(s, np.uint8) for s in strings]
    for shard in (np.arange(32) % 3 == 0, np.zeros(32, bool), np.ones(32, bool)):
        assert [p.tolist() for p in bwt_dedup.repeated(arrays, shard, width)] == want
    block = rlz_dedup.Block([np.frombuffer(s, np.uint8).astype(np.uint64) for s in strings])
    assert [block.repeats(i, width).tolist() for i in range(len(strings))] == want


def test_merge_gives_common_prefixes():
    """The merged interleave is the order of all suffixes, lcp their common prefixes."""
    rng = random.Random(4)
    strings = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 40))) for _ in range(9)]
    sides = []
    for own in (strings[:4], strings[4:]):
        offs = np.concatenate(([0], np.cumsum([len(s) for s in own])))
        sides.append(bwt_dedup.transform(np.frombuffer(b"".join(own), np.uint8).astype(np.int64), offs))
    z, lcp = bwt_dedup.merge(sides[0][0], sides[1][0], 4, 5, 100)
    sides[1][1][:] += sum(map(len, strings[:4])) + 4
    place = np.empty(len(z), np.int64)
    place[~z], place[z] = sides[0][1], sides[1][1]
    suffixes = [(s[i:], k) for k, s in enumerate(strings) for i in range(len(s) + 1)]
    order = [suffixes[p] for p in place]
    assert order == sorted(suffixes)
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert lcp.tolist() == [0] + [common(a[0], b[0]) for a, b in zip(order, order[1:])]


@pytest.mark.parametrize("hot_max", [0, 3, 10_000])
def test_large_groups_keep_all_repeats(docs, monkeypatch, hot_max):
    """Demoted anchors and windows looked up one by one give what small groups give."""
    from stylospark.llm import anchors

    words, text = rlz_dedup.rlz_dedup(docs).collect(), bwt_dedup.digest(bwt_dedup.suffix_dedup(docs)).collect()
    monkeypatch.setattr(bwt_dedup, "repeats", lambda rows, win: anchors.repeats(rows, win, most=2, hot_max=hot_max))
    same(rlz_dedup.rlz_dedup(docs).collect(), words)
    same(bwt_dedup.digest(bwt_dedup.suffix_dedup(docs)).collect(), text)


def weights(text):
    """Shingle -> weight, as near_dedup's docstring has it."""
    w = text.encode().split()
    tf = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
    return {s: n.bit_length() for s, n in tf.items()}


def brute_classes(table):
    """(doc_id, class_id, class_size) by all pairs."""
    sets = [weights(t) for _, t in table]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = sum(min(n, sets[j].get(s, 0)) for s, n in a.items())
            if 9 * both >= 4 * (sum(a.values()) + sum(sets[j].values())):
                up[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(table):
        groups[find(i)].append(d)
    least = lambda ids: None if None in ids else min(ids)
    return [(d, least(g), len(g)) for g in groups.values() for d in g]


def test_near_classes(docs, empty):
    want = brute_classes(texts())
    same(near_dedup.near_classes(docs).select("doc_id", "class_id", "class_size").collect(), want)
    clash = docs.withColumns({"x": F.lit(1), "_n": F.lit(2), "row": F.lit(3)})
    got = near_dedup.drop_near(clash)
    assert got.columns == clash.columns and got.count() == len({(c, n) for _, c, n in want})
    assert near_dedup.near_classes(empty).count() == 0


def test_near_links_between_members(spark, monkeypatch):
    """Chains and cliques of members that fail against their representative are
    linked all the same, whatever the size of a group."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(150)]
    table = []
    for g in range(4):  # variants of one base, some of which share edits among themselves
        shared = rng.sample(range(150), 2 + g)
        for i in range(30):
            w = list(base)
            for k in shared if i % 2 else []:
                w[k] = f"shared{g}x{k}"
            for k in rng.sample(range(150), rng.randint(0, 4)):
                w[k] = word()
            table.append((100 * g + i, " ".join(w)))
    for i in range(20):  # a chain
        table.append((1000 + i, " ".join(base[i * 3 :] + [f"tail{k}" for k in range(i * 3)])))
    near = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(near_dedup, "PER_SALT", 7)
    got = near_dedup.near_classes(near).select("doc_id", "class_id", "class_size").collect()
    same(got, brute_classes(table))
    # with all documents in one bucket, only links between members can do it
    monkeypatch.setattr(near_dedup, "_buckets", lambda heads: heads.crossJoin(heads.agg(F.max("v").alias("rep"))).where("v <> rep").select("rep", "v"))
    got = near_dedup.near_classes(near).select("doc_id", "class_id", "class_size").collect()
    same(got, brute_classes(table))


def test_darts_estimate_weighted_similarity():
    a = " ".join(f"w{i}" for i in range(300)) + " again and again it says" * 40
    b = " ".join(f"w{i}" if i % 20 else f"x{i}" for i in range(300)) + " again and again it says" * 9
    h, offs = near_dedup.shingles(*raw(pa.array([a, b])))
    x, y = weights(a), weights(b)
    assert np.diff(offs).tolist() == [sum(x.values()), sum(y.values())]
    sig = near_dedup.darts(h, offs)
    true = sum(min(n, y.get(s, 0)) for s, n in x.items()) / sum(max(x.get(s, 0), y.get(s, 0)) for s in x.keys() | y.keys())
    assert abs((sig[0] == sig[1]).mean() - true) < 0.12


def test_mixing(docs, empty):
    got = mixing.mix_counts(docs, block_words=50).collect()
    assert len(got) == len(rows())
    size = Counter()
    for _, t, s, *_ in rows():
        size[s] += len((t or "").split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(size.values()), set()
    while True:
        free = total - sum(3 * size[s] for s in capped)
        rest = sum(weight[s] for s in names if s not in capped)
        goal = {s: 3.0 * size[s] if s in capped else free * weight[s] / rest for s in names}
        over = {s for s in names if s not in capped and goal[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    by = defaultdict(int)
    for r in got:
        s = min(names, key=lambda n: (size[n] != r.source_size, abs(goal[n] - r.target)))
        assert abs(goal[s] - r.target) < 1e-6 and r.taken <= 3 * r["size"]
        by[s] += r.taken
    longest = 2 * max(len((t or "").split()) for _, t, *_ in rows())  # two equal rows are taken alike
    assert all(abs(by[s] - goal[s]) <= longest for s in names if size[s])
    again = mixing.mix_counts(docs.repartition(3), block_words=50).collect()
    same(got, again)
    for kw in ({"block_words": 50}, {"block_words": 20, "shard_words": 40}):
        drawn = mixing.mix(docs.withColumns({"target": F.lit(1), "shard": F.lit(2), "_s": F.lit(3)}), **kw)
        rows_ = [(r.row.doc_id, r.row.text, r.shard) for r in drawn.select("row", "shard").collect()]
        assert drawn.schema["row"].dataType.names == [*docs.columns, "target", "shard", "_s"]
        want = Counter((r.doc_id, g) for r in mixing.mix_counts(docs, **kw).collect() for g in r.shards)
        assert Counter((d, g) for d, _, g in rows_) == want
    assert len({g for *_, g in rows_}) > 10  # of the last: many shards
    assert mixing.mix_counts(empty).count() == 0


def test_shards_take_blocks_by_quota(spark):
    """Every shard gets as many block draws as any other, of each source its share."""
    table = [(i, "w " * 10, "ab"[i % 10 == 0]) for i in range(4000)]
    docs = spark.createDataFrame(table, "doc_id long, text string, source string")
    *_, draws = mixing.plan(docs, weights=(2.0, 1.0), block_words=20, shard_words=1000)
    got = [(r["_s"], r.shard) for r in draws.collect()]
    per, own = Counter(g for _, g in got), defaultdict(Counter)
    for s, g in got:
        own[s][g] += 1
    assert len(per) == 64 and max(per.values()) - min(per.values()) <= 1
    for s in "ab":
        share = sum(own[s].values()) / len(got)
        assert all(abs(own[s][g] - share * n) < 6 * (share * (1 - share) * n) ** 0.5 + 1 for g, n in per.items())
    whole = mixing.split_quotas(np.array([sum(own[s].values()) for s in "ab"]), 64, 11)
    assert [[own[s][g] for g in range(64)] for s in "ab"] == whole.tolist()  # levels dealt to tasks or not


def test_columns_of_any_name_pass(spark, docs):
    clash = docs.withColumns({c: F.lit(7) for c in ("score", "_id", "_label", "kept", "row", "x", "_k", "label")})
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(40)], "doc_id long, quality int")
    assert quality.keep_good(clash, labels).columns == clash.columns
    assert exact_dedup.drop_copies(clash).columns == clash.columns


def test_splitting_tree_keeps_quotas():
    q = np.array([1000, 3, 0, 250])
    out = mixing.split_quotas(q, 8, 1)
    assert (out.sum(1) == q).all() and out.sum(0).max() - out.sum(0).min() <= 1


ODD = ["", "  a\n\nb  ", "I'll don't 's\t\tx  <|endoftext|> y", "日本語テキスト 123 ½٣ 💡💡", " " * 50 + "x" + "\n" * 30, "aaaaaaa" * 900 + "x", "é 　 x\x1c\x1d", " <|ENDOFTEXT|> İstanbul ΑΣ"]


def test_bpe(spark, docs):
    path = public.path("byte_bpe_50k.json")
    lib, own = tokenizers.Tokenizer.from_file(path), bpe.ForcedBpe(path)
    for t in ODD + [t for _, t in texts()]:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t).tolist() == ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    got = docs.select("doc_id", bpe.encode(docs.text, path).alias("ids")).withColumn("t", bpe.decode(F.col("ids"), path)).collect()
    same([(r.doc_id, r.t) for r in got], texts())


def test_token_files(spark, docs, empty, tmp_path):
    path = public.path("word_bpe_49k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    cache = token_files.WordCache(path)
    rng = random.Random(8)
    signs = "abzAZéÉßÀÿœŒ09½.,;:!?'\"@#&*()[]|~^_-/\\<>É\u0301İΣς日 \n\x1c\x7f"
    odd = ODD + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    small = token_files.WordCache(path, size=50)  # generations change all the time
    for at in range(0, len(odd), 20):
        for own in (cache, small):
            for t, ids in zip(odd[at : at + 20], own.encode_batch(odd[at : at + 20])):
                assert ids.tolist() == lib.encode(t, add_special_tokens=False).ids
    token_files.write_tokens(docs, f"{tmp_path}/a", path)
    got = token_files.read_tokens(spark, f"{tmp_path}/a").orderBy("start").collect()
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == sorted((d for d, _ in texts()), key=lambda d: (d is not None, d or 0))
    ids = lambda t: np.array(lib.encode(t, add_special_tokens=False).ids + [1], "<u4").tobytes()
    same([(r.doc_id, r.n_tokens, zlib.crc32(r.ids)) for r in got], [(d, len(ids(t)) // 4, zlib.crc32(ids(t))) for d, t in texts()])
    token_files.write_tokens(empty, f"{tmp_path}/b", path)
    assert token_files.read_tokens(spark, f"{tmp_path}/b").count() == 0


def test_range_coder():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 100, 300_000):
        ids = rng.zipf(1.3, n) % 49_000
        docs_, counts, back = token_files.unpack_segment(token_files.pack_segment([7, None], np.array([n, 0]), ids))
        assert docs_ == [7, None] and (back == ids).all()
    s, f, b = token_files.table(ids)
    cum, sym = np.cumsum(f) - f, np.searchsorted(s, ids)
    block = token_files.encode_block(sym, f, cum, b)
    part = token_files.decode_block(block, f, cum, b, 1)
    assert (part == sym[64 * 4096 : 128 * 4096]).all()
    broken = bytearray(token_files.pack_segment([1], np.array([len(ids)]), ids))
    broken[-5] ^= 1
    with pytest.raises(ValueError):
        token_files.unpack_segment(bytes(broken))


def test_top_k(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(700, 16)) * rng.uniform(0.01, 3, (700, 1))
    v[5] = v[6] = v[7]
    table = [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(v)]
    table += [(900, None), (1000, [1.0, None]), (1100, [float("nan")] * 16), (None, [1.0] * 16), (1200, [0.5, 0.5]), (1201, [0.25, 0.5])]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>")
    good = [(i, np.floor(1024 * np.array(r)).astype(np.int64)) for i, r in table if i is not None and r is not None and all(x is not None and np.isfinite(x) for x in r)]
    want = []
    for i, q in good:
        if i % 100 == 0:
            s = sorted((-int(p @ q), j) for j, p in good if j != i and len(p) == len(q))[:10]
            want += [(i, n + 1, j, -x) for n, (x, j) in enumerate(s)]
    same([tuple(map(int, r)) for r in topk.top_k(df).collect()], want)
    same([tuple(map(int, r)) for r in topk.top_k(df, chunk=400).collect()], want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_quality_on_held_out(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    table = [(i, " ".join(word() + (rng.choice(["###", "%%%"]) if i % 4 == 0 else "") for _ in range(rng.randint(5, 60)))) for i in range(400)] + [(1000, None), (1001, ""), (None, "abc")]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(400)] + [(5000, 1), (None, 0), (7, None)], "doc_id long, quality int")
    got = quality.quality(docs, labels).collect()
    assert len(got) == len(table) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in held]) > 0.95
    assert quality.quality(docs.limit(0), labels).count() == 0
    assert quality.quality(docs, labels.limit(0)).count() == len(table)


def test_html_blocks(spark):
    given = [html_blocks.blocks("<html><body><nav><ul><li><a href='/'>menu</a></li></ul></nav><article><h1>alpha beta</h1><p>gamma delta one two three</p></article></body></html>")]
    model = html_blocks.train(given)
    rng, good, n = np.random.default_rng(99), 0, 0
    for _ in range(150):
        page, y = html_blocks.layout(rng, ["alpha", "beta", "gamma", "delta", "one", "two"])
        found = html_blocks.blocks(page)
        if len(found) == len(y):
            got = model.label([html_blocks.vectors(found)])[0]
            good, n = good + int((got == np.array(y, bool)).sum()), n + len(y)
    assert good / n > 0.97
    found = html_blocks.blocks("<p>a &amp; b<b> c<br>d<p>e<script>var x='</p>';</script>&copy; f</div>")
    assert [t for _, t, _ in found] == ["a & b c d", "e", html.unescape("&copy; f")]
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "v", "<article><h1>T</h1><p>x &lt; y</p></article>")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_blocks.extract(pages).collect()}
    assert got[1].text == "" and got[2].n_chars == 0 and got[3].text == "T x < y"
    assert html_blocks.extract(pages.limit(0)).count() == 0


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(r[0], r[1], "en", r[2], 1) for r in rows()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    lib = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    text = defaultdict(set)
    for d, t in texts():
        text[d].add(t)
    assert got and all(any(lib.encode(t, add_special_tokens=False).ids == r.ids for t in text[r.doc_id]) for r in got)
    assert len({r.doc_id for r in got} & {200 + i for i in range(8)}) <= 1
    assert len({r.doc_id for r in got} & {None, 305, 306}) <= 1
