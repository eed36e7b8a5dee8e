"""Features counted on arrays of a batch against brute force, and that no lambda walks the words of a text."""

import math
import random
import re
from collections import Counter

from stylospark.operators import features


def bits(items):
    c = Counter(items)
    n = sum(c.values())
    return math.log2(n) - sum(x * math.log2(x) for x in c.values()) / n if n else 0.0


def test_entropies_against_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["The", "--", "cat,", "Sat\x00", "été", "日本", "İ", "a b", "x1!"]) for _ in range(rng.choice([0, 1, 4, 5, 9, 11, 49, 50, 51, 99, 100, 101, 260]))) for _ in range(80)] + ["", " \n", "İİİİ İİİİ İİİİ İİİ x", "İİİİ İİİİ İİİİ İİİ xyz"]
    got = {r.doc_id: r for r in features.entropies(spark.createDataFrame([*enumerate(texts), (999, None)], "doc_id long, text string").repartition(2)).collect()}
    assert len(got) == len(texts) + 1 and got[999].char_entropy == 0
    for i, t in enumerate(texts):
        ws = [w for w in re.split("[ \t\n\x0b\f\r]+", t) if w]
        plain = lambda s: [c for c in s.lower().replace("i̇", "i̇") if c.isalnum() or c in " \t\n\r"]
        chunks = [" ".join(ws[a : a + 100]) for a in range(0, len(ws), 50)]
        h = [bits(plain(c)) for c in chunks if len(c) > 20]
        assert math.isclose(got[i].char_entropy, bits(plain(t)), abs_tol=1e-4)
        assert math.isclose(got[i].word_entropy, bits([w.lower() for w in ws]) if len(ws) >= 5 else 0, abs_tol=1e-4)
        assert got[i].num_chunks_analyzed == len(h)
        assert math.isclose(got[i].avg_chunk_entropy, sum(h) / len(h) if h else 0, abs_tol=1e-4)


def test_entropies_are_not_counted_by_lambdas(spark):
    plan = features.entropies(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan


def test_parses_are_made_and_read_as_arrays(spark):
    """Rows of many documents at a time: sentences of several documents, empty texts between them, and no list of tokens."""
    from stylospark.operators import parses

    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "dog", "was", "walked", "by", "people.", "and", "quickly", "However,", "12", "!"]) for _ in range(rng.choice([0, 1, 3, 30, 200]))) for _ in range(50)]
    docs = spark.createDataFrame([*enumerate(texts), (998, None)], "doc_id long, text string").repartition(1)
    one = {r.doc_id: r[2:] for r in parses.features(docs).collect()}
    each = {r.doc_id: r[2:] for r in parses.features(docs.repartition(40, "doc_id")).collect()}
    assert len(one) == 51 and one == each
    table = parses.from_table(parses.parse(docs), docs)
    assert {r.doc_id: r[1:] for r in table.collect()} == one
    assert "collect_list" not in table._jdf.queryExecution().optimizedPlan().toString()
