"""Three-class evaluation, names of domains and levels of requests, by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stylospark.functions import fixed
from stylospark.operators import evaluation
from stylospark.plans import detect
from stylospark.streaming import events

AI, HUMAN, MIXED = (evaluation.CLASSES[c] for c in ("ai", "human", "mixed"))
#: verdict, actual, times
CASES = [(AI, "ai", 6), (HUMAN, "ai", 2), (MIXED, "ai", 1), ("Uncertain", "ai", 1), (AI, "human", 1), (HUMAN, "human", 4), (MIXED, "mixed", 2), (AI, "mixed", 1), (None, "human", 1), (AI, None, 3), (AI, "other", 2)]


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(v, a) for v, a, n in CASES for _ in range(n)]
    verdicts = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(rows)] + [(999, AI)], "doc_id long, verdict string")
    return verdicts, spark.createDataFrame([(i, a, "en") for i, (_, a) in enumerate(rows)], "doc_id long, actual string, lang string")


def test_confusion(tables):
    got = {r.actual: tuple(r)[2:] for r in evaluation.confusion(*tables, ("lang",)).collect()}
    assert got == {"ai": (10, 6, 2, 1, 1, 0.6), "human": (6, 1, 4, 0, 1, pytest.approx(4 / 6, abs=1e-6)), "mixed": (3, 1, 0, 2, 0, pytest.approx(2 / 3, abs=1e-6))}


def test_rates(tables):
    (r,) = evaluation.rates(*tables).collect()
    want = dict(n=19, accuracy=12 / 19, precision=6 / 8, recall=0.6, f1=12 / 18, false_positive_rate=2 / 9, false_negative_rate=0.4)
    assert r.asDict() == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


def test_rates_without_anything_to_divide_by(tables):
    verdicts, actual = tables
    assert evaluation.rates(verdicts, actual.limit(0)).collect() == [] and evaluation.confusion(verdicts, actual.limit(0)).count() == 0
    (r,) = evaluation.rates(verdicts.where("verdict != 'AI-Generated'"), actual.where("actual = 'human'")).collect()
    assert r.precision is None and r.recall is None and r.f1 is None and r.false_positive_rate == 0.0


def test_names_of_domains(spark):
    names = {"GENERAL": "general", " Law ": "legal", "machine learning": "ai_ml", "social media": "social_media", "Technical Engineering": "engineering", "science fiction": "creative", "my blog posts": "social_media", "zzz": None, "": None, "   ": "general", None: None, "technical doc": "technical_doc", "clin": "medical"}
    rows = [(i, n) for i, n in enumerate(names)]
    got = spark.createDataFrame(rows, "i int, name string").select("i", evaluation.domain_named(F.col("name")).alias("d")).collect()

    def by_loop(name):
        pairs = fixed.domain_aliases()
        if not name:
            return None
        n = name.lower().strip()
        for x in (n, n.replace(" ", "_")):
            if x in dict(pairs):
                return dict(pairs)[x]
        return next((d for a, d in pairs if n in a or a in n), None)

    assert {rows[r.i][1]: r.d for r in got} == {n: by_loop(n) for _, n in rows}
    for n, d in names.items():
        if n not in ("machine learning", "science fiction", "my blog posts"):
            assert by_loop(n) == d, n
    assert {d for _, d in fixed.domain_aliases()} == set(fixed.domains())


def test_documents_take_their_domain_by_any_of_its_names(spark):
    docs = spark.createDataFrame([(1, "Law"), (2, "legal"), (3, None), (4, "qqq"), (5, "news")], "doc_id long, domain string")
    got = {r.doc_id: r.d for r in docs.select("doc_id", detect.domain_of(docs).alias("d")).collect()}
    assert got == {1: "legal", 2: "legal", 3: "general", 4: "general", 5: "journalism"}
    assert docs.select(detect.domain_of(docs, "software").alias("d")).distinct().collect() == [("software_dev",)]


def test_request_log(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(t, "GET", "/a", 200, 0.123456), (t, "POST", "/b", 404, 1.0), (t, "GET", "/c", 500, 2.0), (t, None, None, 399, None), (t, "GET", "/d", None, 0.0)]
    got = events.request_log(spark.createDataFrame(rows, "ts timestamp, method string, path string, status int, duration double")).collect()
    assert [(r.level, r.duration) for r in got] == [("info", 0.1235), ("warning", 1.0), ("error", 2.0), ("info", None), (None, 0.0)]
    assert [r.message for r in got][:4] == ["API Request: GET /a -> 200", "API Client Error: POST /b -> 404", "API Server Error: GET /c -> 500", "API Request:   -> 399"]


def test_a_name_is_trimmed_once(spark):
    plan = spark.createDataFrame([("a",)], "name string").select(evaluation.domain_named(F.col("name")).alias("d"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
