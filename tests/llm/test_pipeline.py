"""The pipeline stage by stage against brute force, with labels of both classes."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from test_llm import brute_classes

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
SPACE = re.compile(r"[\x20\x09-\x0D]")


def table():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    out = []
    for i in range(300):
        bad = i % 4 == 0
        out.append((i, " ".join(word() + (rng.choice(["###", "%%%"]) if bad else "") for _ in range(rng.randint(20, 60))), f"s{i % 5}"))
    good = [r for r in out if r[0] % 4]
    out += [(400 + i, good[i][1].replace(" ", "  ", 3), "s1") for i in range(8)]
    for i in range(8):
        w = good[20][1].split()
        w[i + 3] = word()
        out.append((500 + i, " ".join(w * 1), "s2"))
    base = [word() for _ in range(120)]
    for i in range(6):
        w = list(base)
        w[10 * i + 5] = "changed"
        out.append((600 + i, " ".join(w), None))
    return [(d, t, "en", s, len(t)) for d, t, s in out] + [(700, None, None, "s0", 0), (701, "", "en", "s3", 0)]


def targets(size):
    """Weighted shares of all words, none above three times its source's own."""
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, full, open_ = float(sum(size.values())), {}, set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s] + 1e-9}
        if not over:
            return full | share
        for s in over:
            full[s] = 3.0 * size[s]
            left -= full[s]
        open_ -= over
    return full


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.createDataFrame(table(), "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(300)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    own, rows = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, own, str(tmp_path)).write.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        own = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        rows[name] = own.collect()
        if name != "bpe":
            assert own.columns == docs.columns
    whole = {r[0]: r for r in table()}
    kept = {r.doc_id for r in rows["quality"]}
    assert all(tuple(r) == whole[r.doc_id] for r in rows["quality"]) and len(kept) == len(rows["quality"])
    assert sum(i in kept for i in range(300) if i % 4) >= 0.97 * 225 and sum(i in kept for i in range(0, 300, 4)) <= 0.03 * 75
    groups = {}
    for r in rows["quality"]:
        groups.setdefault(SPACE.sub("", r.text or ""), []).append((-len(r.text or ""), r.doc_id))
    assert sorted(r.doc_id for r in rows["exact dedup"]) == sorted(min(g)[1] for g in groups.values()) and len(groups) < len(kept)
    classes = brute_classes([(r.doc_id, r.text or "") for r in rows["exact dedup"]])
    assert sorted(r.doc_id for r in rows["near dedup"]) == sorted({c for _, c, _ in classes}) and len(rows["near dedup"]) < len(rows["exact dedup"])
    words = lambda t: len([w for w in SPACE.split(t or "") if w])
    size, taken, largest = Counter(), Counter(), Counter()
    for r in rows["near dedup"]:
        size[r.source] += words(r.text)
        largest[r.source] = max(largest[r.source], words(r.text))
    times = Counter(r.doc_id for r in rows["mixing"])
    for r in rows["mixing"]:
        taken[r.source] += words(r.text)
    want = targets(size)
    assert max(times.values()) <= 3 and set(times) <= {r.doc_id for r in rows["near dedup"]}
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in size), {s: (taken[s], want[s]) for s in size}
    lib = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    mixed = Counter((r.doc_id, r.source, tuple(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in rows["mixing"])
    assert Counter((r.doc_id, r.source, tuple(r.ids)) for r in rows["bpe"]) == mixed and all(r.n_tokens == len(r.ids) for r in rows["bpe"])
    assert Counter((r.doc_id, r.source, tuple(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == mixed
