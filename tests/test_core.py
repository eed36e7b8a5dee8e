"""Units of the library against hand-computed cases and DuckDB."""

import math
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from stylospark import registry
from stylospark.functions import fixed
from stylospark.functions import text as T
from stylospark.operators import metrics, tokens
from stylospark.plans import detect
from stylospark.sources import files

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "labels", "pages", "events", "embeddings"]


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("x")).first()["x"]


def test_cleaning(spark):
    assert value(spark, T.drop_urls, "see https://a.b/c?d and www.x.org now") == "see  and  now"
    assert value(spark, T.drop_emails, "mail me@x.org now") == "mail  now"
    assert value(spark, T.fix_encoding, "donâ€™t") == "don't"
    assert value(spark, T.normalise, "ﬁne — x") == "fine - x"
    assert value(spark, T.drop_control, "a\x00b\x07c\nd") == "abc\nd"
    assert value(spark, T.squeeze, "  a \n\n b\t") == "a b"


def test_sentences_and_words(spark):
    assert value(spark, T.sentences_smart, "Dr. Smith met Mr. Jones. They paid 3.50 euros... Really? Yes it is!") == ["dr Smith met mr Jones", "They paid 3.50 euros... Really", "Yes it is"]
    assert value(spark, T.sentences, "One two. Three!  Four?") == ["One two", "Three", "Four"]
    assert value(spark, T.words, "It's a 'quoted' x word-like 123 4-5 I") == ["It's", "a", "quoted", "word-like", "I"]
    assert value(spark, T.paragraphs, "one two three four five\n\nshort\n\nsix seven eight nine ten") == ["one two three four five", "six seven eight nine ten"]
    assert value(spark, T.keywords, "The café keeps rows of words") == ["keeps", "rows", "words"]


@pytest.mark.parametrize("n, want", [(0, 0), (5, 1), (512, 1), (513, 2), (975, 3)])
def test_chunks(spark, n, want):
    got = spark.range(1).select(T.chunks(F.split(F.lit(" ".join(["w"] * n)), " ") if n else F.array().cast("array<string>")).alias("c")).first()["c"]
    assert len(got) == want


def test_thresholds_tables():
    rows = fixed.threshold_rows()
    assert len(rows) == 96 and len(fixed.performance_rows()) == 96 and len(fixed.ensemble_rows()) == 16
    for d in fixed.domains():
        assert math.isclose(sum(r[5] for r in rows if r[0] == d), 1.0)


def test_structural_features_by_hand(spark):
    text = "The cat sat. The cat ran away from the big dog today! Yes."
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in metrics.compute(metrics.STRUCTURAL_FEATURES, docs).collect()}
    w = re.findall(r"\w+", text.lower())
    windows = [w[i : i + 10] for i in range(len(w) - 10)]
    rep = sum(sum(1 for c in Counter(x).values() if c > 1) for x in windows) / (len(windows) * 10)
    assert got[1].num_words == len(w) and got[1].num_sentences == 3 and got[1].vocabulary_size == len(set(w))
    assert got[1].repetition_score == round(rep, 4)
    assert got[1].bigram_diversity == round(len(set(zip(w, w[1:]))) / (len(w) - 1), 4)
    assert got[2].num_words == 0 and got[3].readability_score == 0


def test_entropy_by_hand(spark):
    text = " ".join(f"word{i % 7} Alpha" for i in range(90))
    got = metrics.compute(metrics.ENTROPY_FEATURES, spark.createDataFrame([(1, text)], "doc_id long, text string")).first()

    def h(items):
        c = Counter(items)
        n = sum(c.values())
        return -sum(v / n * math.log2(v / n) for v in c.values())

    assert got.char_entropy == round(h(x for x in text.lower() if x.isalnum() or x.isspace()), 4)
    assert got.word_entropy == round(h(text.lower().split()), 4)
    ws = text.split()
    chunks = [h(x for x in " ".join(ws[i : i + 100]).lower() if x.isalnum() or x.isspace()) for i in range(0, len(ws), 50) if len(" ".join(ws[i : i + 100])) > 20]
    assert got.num_chunks_analyzed == len(chunks) and got.avg_chunk_entropy == round(sum(chunks) / len(chunks), 4)


def test_probabilities_and_verdicts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(30)
    prob = detect.probabilities(docs).cache()
    assert prob.count() == 30 * 6
    assert all(abs(r.ai + r.human + r.mixed - 1) < 1e-5 and 0 <= r.ai <= 1 for r in prob.collect())
    ens = detect.ensemble(docs).collect()
    assert len(ens) == 30 and {r.verdict for r in ens} <= {"AI-Generated", "Human-Written", "Mixed (AI + Human)", "Uncertain"}
    again = detect.ensemble(docs.repartition(7)).collect()
    assert sorted(r.verdict for r in again) == sorted(r.verdict for r in ens)


def test_too_few_metrics_are_uncertain(spark):
    docs = spark.createDataFrame([(1, "Too short.")], "doc_id long, text string")
    r = detect.ensemble(docs).first()
    assert r.verdict == "Uncertain" and r.ai_probability == 0.5 and r.uncertainty == 1.0


def test_scripts_and_language(spark):
    docs = spark.createDataFrame([(1, "the cat is in the house and it is big"), (2, "Привет как дела"), (3, "abc где"), (4, "123"), (5, "le chat et la maison de la ville dans un pays")], "doc_id long, text string")
    assert {r.doc_id: r.script for r in detect.scripts(docs).collect()} == {1: "latin", 2: "cyrillic", 3: "mixed", 4: "unknown", 5: "latin"}
    assert {r.doc_id: r.language for r in detect.language(docs).collect()}[5] == "fr"


def test_files(spark):
    rows = [("a.txt", "héllo".encode()), ("b.txt", b"h\xe9llo"), ("c.rtf", rb"{\rtf1 \b hello}"), ("d.html", b"<p>a<script>x</script></p>b"), ("e.xyz", b"x"), ("f.txt", None), ("g.pdf", b"x"), ("h.md", b"")]
    got = {r.name: r for r in files.extract(spark.createDataFrame(rows, "name string, content binary")).collect()}
    assert got["a.txt"].text == "héllo" and got["b.txt"].text == "héllo" and got["b.txt"].warnings
    assert got["c.rtf"].text == "hello" and got["d.html"].text == "a\nb"
    assert all(not got[n].is_success and got[n].error for n in ("e.xyz", "f.txt", "g.pdf", "h.md"))


def test_stream_matches_batch(spark, tmp_path):
    from stylospark.streaming import events

    e = spark.read.parquet(f"{SF}/events.parquet")
    e.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    q = events.windowed(stream, "1 day", late="1 day").writeStream.format("memory").queryName("closed").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination(120)
    assert sorted(spark.table("closed").collect()) == sorted(events.windowed(e, "1 day").collect())


@pytest.mark.parametrize("name", ["structural_metric", "entropy_features", "linguistic_metric", "language_by_words", "scripts", "word_chunks", "words_of_text", "html_to_text", "sentences_long", "events_by_hour", "user_sessions", "batch_totals", "label_cohesion"])
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    key = lambda df: sorted(tuple(map(show, r)) for r in df[cols].itertuples(index=False, name=None))
    assert key(got) == key(want)


def test_tables_are_made_without_shuffles(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for make in tokens.FRAMES.values():
        assert "Exchange" not in make(docs)._jdf.queryExecution().executedPlan().toString()
