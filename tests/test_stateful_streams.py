"""Streams with state against the same rows as a table, across restarts."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stylospark.streaming import repeats as R

START = dt.datetime(2024, 1, 1)
SCHEMA = "doc_id long, ts timestamp, text string"


@pytest.fixture
def store(spark):
    spark.conf.set(*R.STORE)
    yield
    spark.conf.unset(R.STORE[0])


def rows(first, last, hot="the same text"):
    """Every third row is a copy of one text, the others come twice each."""
    for i in range(first, last):
        yield i, START + dt.timedelta(seconds=20 * i), hot if i % 3 == 0 else f"text {i // 2}"


def put(spark, path, part):
    spark.createDataFrame(list(part), SCHEMA).repartition(3).write.mode("append").parquet(path)


def run(spark, at, **options):
    q = R.write_batches(R.repeats(spark.readStream.schema(SCHEMA).parquet(f"{at}/in"), **options), f"{at}/out", f"{at}/cp", "update")
    assert q.awaitTermination(120) and q.exception() is None
    return q


def test_repeats_go_on_from_the_checkpoint_and_late_rows_are_counted(spark, store, tmp_path):
    first, second = list(rows(0, 40)) + [(None, START + dt.timedelta(seconds=805), None), (91, None, "no time")], list(rows(40, 75)) + [(92, START + dt.timedelta(seconds=1480), "")]
    put(spark, f"{tmp_path}/in", first)
    assert R.late_rows(run(spark, tmp_path)) == 0
    put(spark, f"{tmp_path}/in", second)
    assert R.late_rows(run(spark, tmp_path)) == 0
    put(spark, f"{tmp_path}/in", [(200, START, "the same text"), (201, START, "never seen in time"), (202, START + dt.timedelta(seconds=1500), "the same text")])
    assert R.late_rows(run(spark, tmp_path)) == 2
    taken = [r for r in first + second if r[1] is not None] + [(202, None, "the same text")]
    want = Counter(r[2] or "" for r in taken)
    least = {t: min((1 << 63) - 1 if r[0] is None else r[0] for r in taken if (r[2] or "") == t) for t in want}
    keys = spark.createDataFrame([(t,) for t in want], "t string").select("t", F.sha2("t", 256).alias("text_key"))
    got = {r.t: (r.first_id, r.total) for r in R.totals(spark.read.parquet(f"{tmp_path}/out")).join(keys, "text_key", "left").collect()}
    assert got == {t: (least[t], n) for t, n in want.items()}
    assert spark.read.parquet(f"{tmp_path}/out").where("not expired").groupBy("text_key").agg(F.max("total").alias("m")).join(R.totals(spark.read.parquet(f"{tmp_path}/out")), "text_key").where("m != total").count() == 0


def test_texts_are_forgotten(spark, store, tmp_path):
    put(spark, f"{tmp_path}/in", [(1, START, "a"), (2, START, "a"), (3, START, "b")])
    run(spark, tmp_path, keep="1 hour")
    put(spark, f"{tmp_path}/in", [(4, START + dt.timedelta(hours=3), "b")])
    run(spark, tmp_path, keep="1 hour")
    put(spark, f"{tmp_path}/in", [(5, START + dt.timedelta(hours=3, minutes=1), "a")])
    run(spark, tmp_path, keep="1 hour")
    out = spark.read.parquet(f"{tmp_path}/out").withColumn("a", F.col("text_key") == F.sha2(F.lit("a"), 256))
    a = [(r.first_id, r.new, r.total, r.expired) for r in out.where("a").orderBy("batch", F.desc("expired")).collect()]
    assert a == [(1, 2, 2, False), (1, 0, 2, True), (5, 1, 1, False)]


def test_a_batch_that_failed_is_written_once_and_by_the_newest_model(spark, tmp_path):
    at, models = str(tmp_path), f"{tmp_path}/models"
    word = lambda w, x: spark.createDataFrame([(w, x)], "w string, x double")
    R.publish(word("text", 1.0), models, 1)
    broken = []

    def score(batch, model):
        if broken:
            raise ValueError("stop")
        return batch.join(model, F.contains("text", "w"), "left").select("doc_id", F.coalesce("x", F.lit(0.0)).alias("x"))

    docs = lambda: spark.readStream.schema(SCHEMA).parquet(f"{at}/in")
    put(spark, f"{at}/in", rows(0, 10))
    assert R.score_by_newest(docs(), models, score, f"{at}/out", f"{at}/cp").awaitTermination(120)
    put(spark, f"{at}/in", rows(10, 20))
    broken.append(1)
    with pytest.raises(Exception, match="stop"):
        R.score_by_newest(docs(), models, score, f"{at}/out", f"{at}/cp").awaitTermination(120)
    broken.clear()
    R.publish(word("same", 2.0), models, 2)
    spark.createDataFrame([(-1, 9.0, 9)], "doc_id long, x double, model_version int").write.parquet(f"{at}/out/batch=1")  # what an attempt left
    assert R.score_by_newest(docs(), models, score, f"{at}/out", f"{at}/cp").awaitTermination(120)
    got = sorted((r.doc_id, r.x, r.model_version) for r in spark.read.parquet(f"{at}/out").collect())
    assert got == [(i, 1.0, 1) for i in range(10)] + [(i, 2.0 if i % 3 == 0 else 0.0, 2) for i in range(10, 20)]


def test_shares_of_a_stream_are_those_of_the_table(spark, tmp_path):
    put(spark, f"{tmp_path}/in", rows(0, 200))
    classes = ["a", "b", "c"]
    kind = F.element_at(F.array(*map(F.lit, classes)), (F.col("doc_id") % 7 % 3 + 1).cast("int"))
    named = lambda d: d.withColumn("verdict", F.when(F.col("doc_id") % 11 != 0, kind))
    want = R.shares(named(spark.read.parquet(f"{tmp_path}/in")), classes, "10 minutes")
    s = R.shares(named(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")), classes, "10 minutes", "1 minute")
    assert R.write_batches(s, f"{tmp_path}/out", f"{tmp_path}/cp", "update").awaitTermination(120)
    assert sorted(spark.read.parquet(f"{tmp_path}/out").drop("batch").collect()) == sorted(want.collect())
    total = sum(r.n for r in want.collect())
    assert total == 200 and any(r.share_0 + r.share_1 + r.share_2 < 0.99 for r in want.collect())
