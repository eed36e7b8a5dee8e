"""Language of documents: packing of chunks, the model, and each step of the cascade."""

import random
import re

import pytest

from stylospark.operators import languages

EN = "the house on the hill was seen by the people of the town and they said that it was old"
DE = "das haus auf dem hügel wurde von den leuten der stadt gesehen und sie sagten dass es alt ist"
FR = "la maison sur la colline a été vue par les gens de la ville et ils ont dit que elle est vieille"


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, ". ".join([t] * (i + 1)), lang) for i in range(3) for t, lang in ((EN, "en"), (DE, "de"), (FR, "fr"))] + [(9, "not counted", None), (10, None, "en")]
    return languages.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_chunks_pack_sentences():
    assert list(languages.chunks("short. text")) == ["short. text"] and list(languages.chunks("")) == [""]
    rng = random.Random(2)
    for _ in range(200):
        sentences = ["x" * rng.randint(1, 400) for _ in range(rng.randint(3, 12))]
        own = list(languages.chunks(". ".join(sentences) + "." + "!" * 600))
        assert all(len(c) >= 50 for c in own)
        kept = " ".join(own).split(" ")
        assert len(kept) <= len(sentences) and all(k in sentences for k in kept)
        for a, b in zip(own, own[1:]):
            assert len(a) <= 500 and len(a) + 1 + len(b.split(" ")[0]) > 500 or len(sentences) > len(kept)
    long = ("word " * 300).strip()
    cut = list(languages.chunks(long))
    assert [len(c) for c in cut] == [499, 499, 499] or all(len(c) <= 500 for c in cut)
    assert list(languages.chunks("." * 1200))[0] == "." * 500


def test_each_step_of_the_cascade(spark, model):
    texts = {
        1: EN, 2: DE + ". " + DE, 3: None, 4: "", 5: "Дом на холме видели люди из города и они сказали что он старый", 6: "1234567 " * 30 + "und das haus der stadt gesehen dass es alt ist und die", 7: "the", 8: ". ".join([EN] * 7 + [FR] * 7),
        9: "   ", 10: "zzzz qqqq xxxx kkkk wwww", 11: EN * 3000,
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in languages.detect(docs, model).collect()}
    assert (got[1].language, got[1].method, got[1].warnings) == ("en", "chunk-model", "") and got[1].confidence > 0.6
    assert got[2].language == "de" and got[11].language == "en" and got[11].char_count == len(EN) * 3000
    assert got[3].language == got[4].language == "unknown" and got[4].method == "none" and got[3].confidence == 0
    assert (got[5].language, got[5].method, got[5].confidence) == ("ru", "heuristics", 0.7) and "Model detection failed" in got[5].warnings
    assert got[6].method == "text-model" and got[6].language == "de" and got[6].warnings == "Model detection failed, using fallback"
    assert "Text too short (3 chars, minimum 20)" in got[7].warnings
    assert "Inconsistent language" in got[8].warnings and got[8].is_multilingual
    assert (got[9].language, got[9].method, got[9].confidence) == ("en", "heuristics", 0.5) and got[10].method == "heuristics"
    bare = {r.doc_id: r for r in languages.detect(docs).collect()}
    assert {r.method for r in bare.values()} == {"heuristics", "none"} and bare[2].language == "de" and bare[8].language in ("en", "fr")
    hit = {r.doc_id: r.matches for r in languages.is_language(languages.detect(docs, model), "en", 0.6).collect()}
    assert hit[1] and not hit[2] and not hit[5]
    with pytest.raises(ValueError):
        languages.is_language(docs, "xx")


def test_model_of_nothing_and_detection_of_no_rows(spark, model):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert languages.train(none).count() == 0 and languages.detect(none, model).count() == 0 and languages.chunk_rows(none).count() == 0
    one = languages.detect(spark.createDataFrame([(1, EN)], "doc_id long, text string"), languages.train(none)).first()
    assert one.method == "heuristics" and one.language == "en"


def test_by_words_needs_no_shuffle(spark):
    docs = spark.createDataFrame([(1, EN), (2, "der die und in den von"), (3, "привет мир"), (4, None), (5, "x y")], "doc_id long, text string")
    df = languages.by_words(docs)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_id, r.language) for r in df.collect()} == {(1, "en"), (2, "de"), (3, "ru"), (4, "en"), (5, "en")}


def test_scripts_beyond_latin_are_counted_on_what_is_left(spark):
    """Each pattern but that of Latin letters reads what the Latin ones leave."""
    from stylospark.functions import fixed
    from stylospark.plans import detect

    made = ["", "Latin only, ÉŸɏ.", "Ѐя mixed латиница", "日本語 ひらがな カタカナ text", "한국어", "ɐ ʰ Ͱ Ω", "שלום abc", "ไทย", "مرحبا ݐ", "हिन्दी", "😀 ẞ ℡"]
    got = {r.doc_id: r for r in detect.scripts(spark.createDataFrame([*enumerate(made)], "doc_id long, text string")).collect()}
    for i, t in enumerate(made):
        for n, (chars, _) in fixed.SCRIPTS.items():
            assert got[i][n] == len(re.findall(f"[{chars}]", re.sub(r"[\s!-/:-@\[-`{-~]+", "", t))), (t, n)
    plan = detect.scripts(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(rest") == len(fixed.SCRIPTS) - 1
