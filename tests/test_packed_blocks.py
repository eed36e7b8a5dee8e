"""Blocks of documents are packed where they are made, and whole texts come in small batches: executors hold little of them."""

import random

import numpy as np
import pyarrow as pa
import pytest

from stylospark.operators import features, language_model as model, scan

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def docs(spark, n=200):
    rng = random.Random(3)
    words = ["the", "cat", "sat", "mat", "Ran.", "hills!", "far?", *[f"odd{i}" for i in range(500)]]
    return spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.choice([0, 3, 60, 900])))) for i in range(n)], "doc_id long, text string").coalesce(1)


@pytest.mark.parametrize("kind", [np.int32, np.uint8, np.int64])
@pytest.mark.parametrize("n", [0, 1, 1000])
def test_packed_arrays_come_back(kind, n):
    x = np.random.default_rng(1).integers(0, 100, n).astype(kind)
    if kind != np.uint8:
        x[: n // 2] -= 60
    assert model._ints(model._packed(x), kind).tolist() == x.tolist()
    if kind != np.uint8:
        assert model._risen(model._rising(x), kind).tolist() == x.tolist()


def test_a_block_takes_few_bytes_a_word(spark):
    kept = model.blocks(docs(spark)).collect()
    held = sum(len(r[c]) for r in kept for c in (*model._INTS, *model._BYTES))
    assert held < 12 * sum(r.n for r in kept)


def test_dealt_words_and_pairs_take_few_bytes(spark):
    b = model.blocks(docs(spark), 0)
    rows = b.select("block", "vocab", "p1", "p2", "count", "words", "last").mapInArrow(model._dealt(8), model._DEALT).collect()
    held = sum(len(x) for r in rows for x in r[2:])
    assert len({r.bucket for r in rows}) == 8 and held < 8 * sum(r.n for r in b.select("n").collect())


def test_whole_texts_come_in_small_batches(spark):
    given = spark.conf.get(BATCH)
    for plan in (lambda d: features.counted(d, ("structural",)), model.blocks):
        spark.conf.set(BATCH, "10000")
        plan(docs(spark, 3))
        assert int(spark.conf.get(BATCH)) <= 1000
        spark.conf.set(BATCH, "7000")
        plan(docs(spark, 3))
        assert spark.conf.get(BATCH) == "7000"
    spark.conf.set(BATCH, given)


def test_a_million_characters_are_read_at_a_time():
    runs = [(own.to_pylist(), x.n) for own, x in scan.runs(pa.array(["one two. " * 50_000] * 4))]
    assert runs == [([0, 1], 2), ([2, 3], 2)]
