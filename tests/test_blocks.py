"""Features of documents by blocks: one block or many, the pairs of words aren't shuffled by occurrence."""

import random
import re

from stylospark.operators import language_model as model


def docs(spark, parts):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat", "dog", "Ran.", "hills!", "far?", f"odd{rng.randint(0, 9)}"]) for _ in range(rng.choice([0, 1, 2, 6, 40, 300, 2300]))) for _ in range(60)] + [None, "", " ... ", "one"]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts, "doc_id")


def test_many_blocks_give_what_one_gives(spark):
    one, many = (sorted(model.features(docs(spark, n)).collect()) for n in (1, 40))
    assert len(one) == 64 and one == many
    assert model.blocks(docs(spark, 40).repartition(40, "doc_id")).count() > 4


def test_pairs_are_not_joined_by_occurrence(spark):
    plan = model.features(docs(spark, 3))._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"hashpartitioning\(w", plan)


def test_rows_that_share_an_id_stay_rows(spark):
    twice = docs(spark, 3).unionAll(docs(spark, 2))
    assert model.features(twice).count() == 128


def test_each_word_is_that_of_tok_without_its_neighbours(spark):
    from stylospark.operators import tokens

    docs = spark.createDataFrame([(1, "One two, two three."), (2, None), (3, " ... "), (4, "Éa_1 x")], "doc_id long, text string")
    got = tokens.each_word(docs)
    assert got.columns == ["doc_id", "w"] and sorted(got.collect()) == sorted(tokens.tok(docs).select("doc_id", "w").collect())
