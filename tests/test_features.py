"""Features computed in the row against the SQL over exploded tables, and the plan of the ensemble."""

import re

import pytest

from stylospark.operators import features, language_metrics as lm, language_model, metrics, tokens
from stylospark.plans import detect

TEXTS = [
    (1, "The cat sat. The cat sat again! However, the dog ran away quickly; why? Therefore it was raining, and they stayed inside all day."),
    (2, "word " * 230 + ". " + "Other words follow here now. " * 12 + "Other words follow here now"), (3, None), (4, ""), (5, "  \t\n"), (6, "!!! ... ???"),
    (7, "one two three four five six"), (8, "Résumé naïve 12 34 x_y don't; ÉTÉ été. Zwei drei vier fünf, sechs sieben? acht neun zehn elf zwölf"), (9, "tail repeats tail repeats tail repeats tail repeats tail. Never again; never again; never."),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)


def by_sql(text, docs):
    return metrics.run(docs.sparkSession, metrics.spark_sql(text), **{n: tokens.FRAMES[n](docs) for n in metrics.needed(text)})


@pytest.mark.parametrize("sql, made", [
    (metrics.STRUCTURAL_FEATURES, features.structural), (metrics.ENTROPY_FEATURES, features.entropies), (lm.SEMANTIC_FEATURES, features.semantic),
    (metrics.PERPLEXITY_FEATURES, lambda d: language_model.features(d, n=0).select(*language_model.PERPLEXITY)), (lm.STABILITY_FEATURES, lambda d: language_model.features(d).select(*language_model.STABILITY)),
])
def test_features_equal_their_sql(docs, sql, made):
    want, got = by_sql(sql, docs), made(docs)
    assert got.columns == want.columns
    rows = lambda df: {r[0]: [None if x is None else pytest.approx(float(x), abs=1e-6) for x in r] for r in df.collect()}
    have = {r[0]: [None if x is None else float(x) for x in r] for r in got.collect()}
    assert have == rows(want) and len(have) == len(TEXTS)


def test_row_features_need_no_shuffle(docs):
    for made in (features.structural, features.entropies, features.semantic, features.linguistic):
        plan = made(docs)._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search("Aggregate|Join|Window", plan)


def test_skipped_metrics_are_not_computed(docs):
    rows = detect.metric_rows(docs, skip=("multi_perturbation_stability", "perplexity"))
    assert "Aggregate" not in rows._jdf.queryExecution().optimizedPlan().toString()
    got = rows.where("error = 'Skipped'").groupBy("metric").count().collect()
    assert {(r.metric, r["count"]) for r in got} == {("multi_perturbation_stability", len(TEXTS)), ("perplexity", len(TEXTS))}
    assert detect.ensemble(docs, skip=("perplexity",)).count() == len(TEXTS)
    assert detect.ensemble(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["ensemble_verdict", "ensemble_methods", "metric_contributions", "ablation", "sentence_highlights", "highlight_risk", "attribution", "report_json", "verdict_summary", "perplexity_metric", "stability_metric"])
def test_plans_read_and_shuffle_little(spark, name):
    from stylospark import registry

    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    reads, exchanges, nested = len(re.findall(r"FileScan parquet", plan)), len(re.findall(r"Exchange hashpartitioning", plan)), len(re.findall(r"BroadcastNestedLoopJoin|CartesianProduct", plan))
    assert reads <= 4 and exchanges <= 20 and not nested, (reads, exchanges, nested)
