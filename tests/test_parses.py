"""Dependency features: the rule parser and its SQL, heights, and tables of other parsers."""

import duckdb
import numpy as np
import pytest

from stylospark.operators import parses

from test_features import TEXTS

MORE = [(20, "The house was painted by them because it was old. -- . The house was painted. The house was painted. The house was sold."), (21, "!!! ,,, ;;"), (22, "However, however. Therefore, thus."), (23, "a " * 30000), (24, "In of under. And or. Is was. Running.")]
ROWS = [t for t in TEXTS if t[0] is not None] + MORE


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)


def by_duck(sql):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in ROWS])
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    return [dict(zip(names, r)) for r in got.fetchall()]


def test_parses_equal_their_sql(docs):
    key = lambda r: tuple(sorted((k, str(v)) for k, v in r.items()))
    assert sorted(key(r.asDict()) for r in parses.parse(docs).collect()) == sorted(map(key, by_duck(parses.ROWS_SQL)))


def test_features_equal_their_sql_and_those_of_the_table(docs):
    want = {r["doc_id"]: r for r in by_duck(parses.FEATURES_SQL)}
    for got in (parses.features(docs), parses.from_table(parses.parse(docs), docs)):
        rows = {r.doc_id: r.asDict() for r in got.collect()}
        assert rows.keys() == want.keys()
        for d, r in rows.items():
            assert {f: r[f] for f in parses.FEATURES} == {f: pytest.approx(want[d][f], abs=1e-6) for f in parses.FEATURES}, d


def test_heights_of_any_heads():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 200):
        for _ in range(20):
            head = rng.integers(0, n, n) if rng.random() < 0.5 else np.maximum(np.arange(n) - rng.integers(0, 3, n), 0)
            root = np.zeros(n, bool)
            for i in range(n):
                seen, at = set(), i
                while head[at] != at and at not in seen:
                    seen.add(at)
                    at = head[at]
                root[i] = head[at] == at
            want = np.zeros(n, int)
            for i in np.flatnonzero(root):
                at, d = i, 0
                while head[at] != at:
                    at, d = head[at], d + 1
                    want[at] = max(want[at], d)
            assert parses.heights(head).tolist() == want.tolist()
    assert parses.heights(np.maximum(np.arange(5000) - 1, 0))[0] == 4999


def test_table_of_another_parser(spark):
    # she was seen -> passive; a cycle, a null head and one out of range count as roots; tokens come in any order
    rows = [
        (1, 0, 2, "seen", "see", "VERB", "ROOT", 2, False, None), (1, 0, 0, "She", "she", "PRON", "nsubjpass", 2, False, 0), (1, 0, 1, "was", "be", "AUX", "auxpass", 2, False, None), (1, 0, 3, ".", ".", "PUNCT", "punct", 2, True, None),
        (1, 1, 0, "A", None, "DET", "det", 1, False, 0), (1, 1, 1, "b", "b", "NOUN", None, 0, False, 0), (1, 1, 2, "c", "c", None, "attr", None, None, None), (1, 1, 3, "d", "d", "X", "oprd", 99, False, None),
        (2, 0, 0, None, None, None, None, None, None, None),
    ]
    table = spark.createDataFrame(rows, parses.SCHEMA).repartition(4)
    got = {r.doc_id: r for r in parses.from_table(table, spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")).collect()}
    assert got[1].num_sentences == 2 and got[1].passive_voice_ratio == 0.5 and got[1].syntactic_complexity == pytest.approx(((1 / 4 + 1) / 2 + 0) / 2, abs=1e-4)
    assert got[1].ai_pattern_score == pytest.approx(0.4) and got[2].num_sentences == 1 and got[3].pos_diversity == 0.5 and got[3].num_sentences == 0
    assert parses.from_table(table.limit(0)).count() == 0 and parses.from_table(spark.createDataFrame([], parses.SCHEMA)).columns == ["doc_id", *parses.FEATURES]


def test_tags_of_many_tokens_are_those_of_each():
    import pyarrow as pa

    words = ["the", "running", "ed", "_", "_a", "1a", "10th", "½", "²x", "éed", "—", "\0", "a\nb", ":", "/", "0", "ſed", "٣", "\x7f", "however", "was", "naïvely", "çing", ""]
    assert [parses.TAGS[i] for i in parses.tags_of(pa.array(words))] == [parses.tag(w) for w in words]
