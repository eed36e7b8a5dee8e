"""Word files, encodings, the forest, and streams of documents."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from stylospark.operators import forest, metrics
from stylospark.plans import detect
from stylospark.sources import files
from stylospark.streaming import events

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def word(body, name="word/document.xml", head=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name, f'<?xml version="1.0"?>{head}<w:document {W}><w:body>{body}</w:body></w:document>')
    return out.getvalue()


P = lambda *runs: "<w:p>" + "".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in runs) + "</w:p>"


def test_word_files(spark):
    good = word(P("First ", "line &amp; more") + P() + f"<w:tbl><w:tr><w:tc>{P('cell')}</w:tc></w:tr></w:tbl><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t></w:r></w:p>")
    rows = [("a.docx", good), ("b.docx", b"no zip"), ("c.docx", word(P("x"), "other.xml")), ("d.docx", word("<w:p>")), ("e.docx", word(P("x"), head="<!DOCTYPE d [<!ENTITY a 'b'>]>")), ("f.DOCX", good[:-30]), ("g.doc", good), ("h.docx", None), ("i.docx", b""), ("j.txt", b"plain")]
    got = {r.name: r for r in files.extract(spark.createDataFrame(rows, "name string, content binary")).collect()}
    assert got["a.docx"].text == "First line & more\n\ncell\n\na\tb\nc" and got["a.docx"].method == "docx" and got["a.docx"].is_success and got["a.docx"].warnings == []
    for name in ("b.docx", "c.docx", "d.docx", "e.docx", "f.DOCX"):
        assert not got[name].is_success and got[name].error.startswith("Not a readable Word file") and got[name].text is None
    assert got["g.doc"].error == "No parser for .doc" and got["h.docx"].error == "No content" and got["i.docx"].error == "File is empty" and got["j.txt"].text == "plain"
    with pytest.raises(ValueError):
        files.docx_text(good, most=10)


def test_encodings(spark):
    t = "Größe naïve été ende"
    rows = [("utf8.txt", t.encode()), ("bom.txt", b"\xef\xbb\xbf" + t.encode()), ("le.txt", b"\xff\xfe" + t.encode("utf-16-le")), ("be.txt", b"\xfe\xff" + t.encode("utf-16-be")), ("le0.txt", t.encode("utf-16-le")), ("be0.txt", t.encode("utf-16-be")), ("latin.txt", t.encode("latin-1")), ("win.txt", ("“" + t + "” – €").encode("cp1252")), ("odd.txt", b"\xff\xfe" + t.encode("utf-16-le") + b"x")]
    got = {r.name: r for r in files.extract(spark.createDataFrame(rows, "name string, content binary")).collect()}
    assert all(got[n].text == t for n in ("utf8.txt", "bom.txt", "le.txt", "be.txt", "le0.txt", "be0.txt", "latin.txt", "odd.txt")) and got["win.txt"].text == "“" + t + "” – €"
    assert [got[n].warnings for n in ("utf8.txt", "le0.txt", "latin.txt", "win.txt")] == [[], ["Decoded as UTF-16LE"], ["Decoded as ISO-8859-1"], ["Decoded as windows-1252"]]


def test_uploads(spark):
    names = spark.createDataFrame([("a.TXT",), ("b.docx",), ("c.rtf",), ("d",), (None,)], "n string")
    assert [r[0] for r in names.select(F.coalesce(files.upload_allowed(F.col("n")), F.lit(False))).collect()] == [True, True, False, False, False]


KIND = "array<struct<metric:string,ai:double,human:double,mixed:double,confidence:double,error:string,weight:double,factor:double>>"


def judged(spark, n=400):
    rng, out = random.Random(3), []
    for i in range(n):
        y = i % 2
        ai = {m: min(1.0, max(0.0, rng.gauss(0.65 if y and m in ("entropy", "perplexity") else 0.4, 0.15))) for m in forest.NAMES}
        out.append((i, [(m, a, 1 - a, 0.0, 0.6, "failed" if rng.random() < 0.05 else None, 0.2, 1.0) for m, a in ai.items()], (0.5, 0.5), y))
    return spark.createDataFrame(out, f"doc_id long, p {KIND}, verdict struct<ai_probability:double,human_probability:double>, y int")


def test_forest_learns_and_reloads(spark, tmp_path):
    rows = judged(spark)
    labels = rows.where("doc_id % 4 <> 0 and doc_id % 4 <> 1").select("doc_id", "y")
    model = forest.fit(rows, labels)
    path = f"file://{tmp_path}/forest"
    forest.save(model, path)
    got, again = (sorted(map(tuple, forest.score(rows, m).collect())) for m in (model, forest.load(path)))
    assert got == again and len(got) == 400 and {g[3] for g in got} == {"ml_ensemble"}
    held = [(p >= 0.5) == (d % 2 == 1) for d, p, _, _ in got if d % 4 in (0, 1)]
    assert sum(held) / len(held) > 0.85
    assert sorted(map(tuple, forest.score(rows, forest.fit(rows.repartition(7), labels.repartition(3))).collect())) == got
    assert forest.fit(rows, labels.where("y = 1")) is None and forest.fit(rows, labels.limit(0)) is None
    assert {r.method for r in forest.score(rows, None).collect()} == {"confidence_calibrated"} and forest.score(rows.limit(0), model).count() == 0


def test_stream_of_documents_is_scored_and_goes_on_from_its_checkpoint(spark, tmp_path):
    docs = [(i, f"Document number {i} has some words to score, and {i} more of them follow here.") for i in range(6)] + [(7, None), (8, "")]
    score = lambda d: metrics.compute(metrics.STRUCTURAL, d).select("doc_id", "raw", "confidence")
    schema = "doc_id long, text string"
    for part in (docs[:5], docs[5:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = events.score_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), score, f"{tmp_path}/out", f"{tmp_path}/cp")
        q.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(got) == sorted(score(spark.createDataFrame(docs, schema)).collect()) and len(got) == len(docs)


def test_detection_events(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    ens = spark.createDataFrame([(1, "Uncertain", 0.5, "general"), (2, "Human-Written", 0.7, "legal")], "doc_id long, verdict string, overall_confidence double, domain string")
    got = {r.analysis_id: r for r in detect.detection_events(ens, docs).collect()}
    assert (got["1"].text_length, got["2"].text_length, got["2"].verdict, got["2"].confidence, got["2"].domain) == (3, 0, "Human-Written", 0.7, "legal") and got["1"].ts is not None
