"""Thresholds, ensemble, attribution and highlights in a document's own row.

A row holds one struct a metric (raw, confidence, mixed, error). Joined with the
sixteen rows of domain settings, it gives an array of the metrics' probabilities,
and all verdicts are expressions over that array: none needs a shuffle. The SQL in
verdicts.py says the same over exploded tables, and is what tests compare with."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..session import small_batches
from . import phrases, scan, verdicts
from .features import Part, let

METRICS = fixed.METRICS


def settings(spark: SparkSession) -> DataFrame:
    """domain, limits (of each metric, in order), thr: sixteen rows."""
    factor = {(d, m): f for d, m, f in fixed.performance_rows()}
    limits: dict[str, list[tuple]] = {}
    for d, m, ai, human, _, weight in fixed.threshold_rows():
        limits.setdefault(d, []).append((ai, human, weight, factor[d, m]))
    rows = [(d, limits[d], thr) for d, thr in fixed.ensemble_rows()]
    return spark.createDataFrame(rows, "_d string, limits array<struct<ai_thr:double,human_thr:double,weight:double,factor:double>>, thr double")


def judged(a: DataFrame) -> DataFrame:
    """a (domain, a struct for each metric) with p: metric, ai, human, mixed,
    confidence, error, weight, factor of each metric."""
    a = a.join(F.broadcast(settings(a.sparkSession)), F.col("domain") == F.col("_d")).drop("_d")

    def one(m: Column, i: int) -> Column:
        t = F.get("limits", F.lit(i))
        raw, bad = m["raw"], m["error"].isNotNull()
        ai = F.when(bad, 0.5).when(raw >= t["ai_thr"], 0.7 + (raw - t["ai_thr"]) * 0.3).when(raw <= t["human_thr"], 0.3 - (t["human_thr"] - raw) * 0.3)
        ai = ai.when(t["ai_thr"] > t["human_thr"], 0.3 + (raw - t["human_thr"]) / (t["ai_thr"] - t["human_thr"]) * 0.4).otherwise(0.5)
        ai = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ai))
        mixed = F.when(bad, 0.0).otherwise(m["mixed"])
        total = 1 + mixed
        return F.struct(
            F.lit(METRICS[i]).alias("metric"), F.round(ai / total, 6).alias("ai"), F.round((1 - ai) / total, 6).alias("human"), F.round(mixed / total, 6).alias("mixed"),
            F.when(bad, 0.1).otherwise(m["confidence"]).alias("confidence"), m["error"].alias("error"), t["weight"].alias("weight"), t["factor"].alias("factor"),
        )

    return a.withColumn("p", F.array(*[one(F.col(m), i) for i, m in enumerate(METRICS)])).drop(*METRICS, "limits")


def _sum(v: Column, f: Callable[[Column], Column]) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + f(x))


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def calibrated(x: Column) -> Column:
    """A metric's weight times the sigmoid of its confidence."""
    return x["weight"] / (1.0 + F.exp(-10 * (x["confidence"] - 0.5)))


def probabilities(a: DataFrame) -> DataFrame:
    x = a.select("doc_id", "domain", "thr", F.explode("p").alias("x"))
    return x.select("doc_id", "x.metric", "domain", "x.weight", F.col("thr").alias("ensemble_threshold"), "x.ai", "x.human", "x.mixed", "x.confidence", "x.error")


def verdict(a: DataFrame) -> DataFrame:
    """a with the verdict of the calibrated ensemble and its numbers."""
    a = a.withColumn("v", F.filter("p", lambda x: x["error"].isNull())).withColumn("n", F.size("v"))
    v, n, enough = F.col("v"), F.col("n"), F.col("n") >= 3
    sums = {"sw": calibrated, "sa": lambda x: calibrated(x) * x["ai"] / (1 + x["mixed"]), "sh": lambda x: calibrated(x) * (1 - x["ai"]) / (1 + x["mixed"]), "sm": lambda x: calibrated(x) * x["mixed"] / (1 + x["mixed"]), "sc": lambda x: calibrated(x) * x["confidence"], "mu": lambda x: x["ai"], "mc": lambda x: x["confidence"]}
    a = a.withColumns({k: _sum(v, f) for k, f in sums.items()})
    all_ = F.col("sa") + F.col("sh") + F.col("sm")
    a = a.withColumns({"ai": F.when(enough, F.col("sa") / all_).otherwise(0.5), "human": F.when(enough, F.col("sh") / all_).otherwise(0.5), "mixed": F.when(enough, F.col("sm") / all_).otherwise(0.0), "mu": F.try_divide("mu", n)})
    a = a.withColumn("va", F.try_divide(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x["ai"] - F.col("mu")) * (x["ai"] - F.col("mu"))), n))
    sure, high = 1 - 2 * F.abs(F.col("ai") - 0.5), F.try_divide(F.size(F.filter("v", lambda x: x["confidence"] > 0.7)), n)
    agree = 1 - F.least(F.lit(1.0), 2 * F.sqrt("va"))
    a = a.withColumns({
        "conf": F.when(enough, _clamp(0.4 * F.col("sc") / F.col("sw") + 0.3 * agree + 0.2 * sure + 0.1 * high)).otherwise(0.0),
        "unc": F.when(enough, _clamp(0.4 * F.col("va") + 0.3 * (1 - F.col("mc") / n) + 0.3 * sure)).otherwise(1.0), "cons": F.when(enough, agree).otherwise(0.0),
        "thr": F.when(n > 0, F.col("thr")).otherwise(0.4),
    })
    ai, unc, line = F.col("ai"), F.col("unc"), F.col("thr") + 0.1 * F.col("unc")
    word = F.when(~enough, "Uncertain").when((F.col("mixed") > 0.25) | ((unc > 0.6) & (ai > 0.3) & (ai < 0.7)), "Mixed (AI + Human)").when(ai >= line, "AI-Generated").when(ai <= 1 - line, "Human-Written").otherwise("Uncertain")
    label = F.when((ai > 0.9) | (ai < 0.1), "Very High").when((ai > 0.8) | (ai < 0.2), "High").when((ai > 0.7) | (ai < 0.3), "Moderate").otherwise("Low")
    six = lambda c, name: F.round(c, 6).alias(name)
    own = F.struct(
        F.when(n > 0, F.col("domain")).otherwise("general").alias("domain"), n.cast("long").alias("valid_metrics"), six(F.col("ai"), "ai_probability"), six(F.col("human"), "human_probability"), six(F.col("mixed"), "mixed_probability"),
        six(F.col("conf"), "overall_confidence"), six(unc, "uncertainty"), six(F.col("cons"), "consensus"), word.alias("verdict"), label.alias("confidence_label"),
    )
    return a.select("*", own.alias("verdict_")).drop("v", "n", *sums, "ai", "human", "mixed", "va", "conf", "unc", "cons").withColumnRenamed("verdict_", "verdict")


def methods(a: DataFrame) -> DataFrame:
    """doc_id, method, ai, human, mixed by six weightings, of documents with three usable metrics."""
    a = a.select("doc_id", F.filter("p", lambda x: x["error"].isNull()).alias("v")).where(F.size("v") >= 3)
    a = a.withColumn("mu", _sum(F.col("v"), lambda x: x["ai"]) / F.size("v"))
    same = lambda x: (x["ai"], x["human"], x["mixed"])
    spread = lambda x: (x["ai"] / (1 + x["mixed"]), (1 - x["ai"]) / (1 + x["mixed"]), x["mixed"] / (1 + x["mixed"]))
    kinds = {
        "confidence_calibrated": (calibrated, spread), "domain_adaptive": (lambda x: x["weight"] * x["factor"], same), "consensus_based": (lambda x: x["weight"] * (0.5 + 0.5 * (1 - F.abs(x["ai"] - F.col("mu")))), same),
        "domain_weighted": (lambda x: x["weight"], same), "confidence_weighted": (lambda x: x["confidence"], same), "simple_average": (lambda x: F.lit(1.0), same),
    }

    def row(name: str) -> Column:
        w, of = kinds[name]
        s = [_sum(F.col("v"), lambda x, i=i: w(x) * of(x)[i]) for i in range(3)]
        return let(F.struct(*[c.alias(k) for c, k in zip(s, "ahm")], _sum(F.col("v"), w).alias("w")), lambda t: F.struct(F.lit(name).alias("method"), *[
            F.round(F.when(t["w"] > 0, t[k] / (t["a"] + t["h"] + t["m"])).otherwise(d) + 1.0e-9, 6).alias(c) for k, c, d in (("a", "ai", 0.5), ("h", "human", 0.5), ("m", "mixed", 0.0))]))

    return a.select("doc_id", F.explode(F.array(*map(row, kinds))).alias("x")).select("doc_id", "x.*")


def _ranked() -> Column:
    """Metrics by weight in the calibrated ensemble."""

    def own(total: Column) -> Column:
        w = lambda x: F.when(x["error"].isNull(), calibrated(x) / total).otherwise(0.0)
        return F.transform("p", lambda x: F.struct((-F.round(w(x), 6)).alias("order"), x["metric"].alias("metric"), w(x).alias("w"), x["ai"].alias("ai"), x["human"].alias("human"), x["confidence"].alias("confidence"), x["error"].alias("error")))

    return F.array_sort(let(_sum(F.filter("p", lambda x: x["error"].isNull()), calibrated), own))


def _part(x: Column, rank: Column) -> Column:
    w, ai = x["w"], x["ai"]
    return F.struct(
        x["metric"].alias("metric"), F.round(w, 6).alias("weight"), F.round(w * ai, 6).alias("weighted_score"), F.when(w > 0.15, "High").when(w > 0.08, "Medium").otherwise("Low").alias("contribution"),
        F.when(ai * 100 >= 60, "AI").when(ai * 100 <= 40, "HUMAN").otherwise("MIXED").alias("metric_verdict"), rank.cast("long").alias("rank"),
    )


def parts() -> Column:
    return F.transform(_ranked(), lambda x, i: _part(x, i + 1))


def contributions(a: DataFrame) -> DataFrame:
    return a.select("doc_id", F.explode(parts()).alias("x")).select("doc_id", "x.*")


def reasons() -> Column:
    """Summary, indicators, supporting and contradicting metrics, and advice, of a row with its verdict."""
    v = lambda c: F.col(f"verdict.{c}")
    band = F.when(v("overall_confidence") >= 0.8, "very high").when(v("overall_confidence") >= 0.6, "high").when(v("overall_confidence") >= 0.4, "moderate").otherwise("low")
    agree = F.when(v("consensus") >= 0.8, "strong").when(v("consensus") >= 0.6, "moderate").otherwise("low")
    ranked = F.filter(_ranked(), lambda x: x["error"].isNull())
    percent = lambda c: F.format_string("%.1f%%", F.floor(c * 1000.0 + 0.5) / 10.0)
    names = lambda rule: F.transform(F.filter("p", lambda x: x["error"].isNull() & rule(x)), lambda x: F.concat(x["metric"], F.lit(": "), percent(x["ai"]), F.lit(" AI")))
    ai, human = names(lambda x: x["ai"] >= 0.6), names(lambda x: x["ai"] <= 0.4)
    is_ai, is_human = v("verdict") == "AI-Generated", v("verdict") == "Human-Written"
    none = F.array().cast("array<string>")
    advice = F.array_compact(F.array(
        F.when(v("uncertainty") > 0.7, "High uncertainty: review by hand"), F.when(v("verdict") == "Mixed (AI + Human)", "Check the highlighted sentences"), F.when(v("overall_confidence") < 0.5, "Collect a longer text"),
    ))
    return F.struct(
        F.concat(F.lit("Verdict "), v("verdict"), F.lit(" with "), band, F.lit(" confidence and "), agree, F.lit(" consensus in domain "), v("domain")).alias("summary"),
        F.transform(F.slice(ranked, 1, 5), lambda x: F.concat(x["metric"], F.lit(" (weight "), percent(x["w"]), F.lit("): "), percent(x["ai"]), F.lit(" AI"))).alias("key_indicators"),
        F.when(is_ai, ai).when(is_human, human).otherwise(none).alias("supporting_evidence"), F.when(is_ai, human).when(is_human, ai).otherwise(none).alias("contradicting_evidence"), advice.alias("recommendations"),
    )


def ablation(a: DataFrame) -> DataFrame:
    """excluded, n, mean_ai, above_half: the calibrated ensemble without one metric."""

    def without(name: str) -> Column:
        v = F.filter("p", lambda x: x["error"].isNull() & (x["metric"] != name))
        return let(v, lambda v: F.struct(F.lit(name).alias("excluded"), F.size(v).alias("k"), F.try_divide(_sum(v, lambda x: calibrated(x) * x["ai"] / (1 + x["mixed"])), _sum(v, calibrated)).alias("ai")))

    x = a.select(F.explode(F.array(*map(without, METRICS))).alias("x")).select("x.*").where("k >= 3")
    return x.groupBy("excluded").agg(F.count("*").alias("n"), F.round(F.avg("ai") + 1.0e-9, 5).alias("mean_ai"), F.count_if(F.round("ai", 5) >= 0.5).alias("above_half"))


_READ = "array<struct<n:int,kinds:int,again:boolean,hits:int,clauses:int,factor:double>>"


def _factors(domain: np.ndarray, s: pa.Array, low: pa.Array, n: np.ndarray, again: np.ndarray) -> np.ndarray:
    """What the first rule that holds in a sentence's domain multiplies a probability by."""
    out = np.ones(len(n))
    for names, rules in fixed.SENTENCE_RULES:
        own = np.flatnonzero(np.isin(domain, names.split()))
        if not len(own):
            continue
        texts, f = {"code": s.take(pa.array(own))}, np.ones(len(own))
        lower = low.take(pa.array(own))
        for sign, factor in reversed(rules):
            if isinstance(sign, tuple):
                holds = (n[own] >= sign[0]) & (n[own] <= (np.inf if sign[1] is None else sign[1]))
            elif sign == "repetition":
                holds = again[own]
            else:
                holds = reduce(np.logical_or, [_holds(texts.get(sign, lower), w) for w in fixed.SIGNS[sign]])
                holds = holds & (n[own] >= 8) if sign == "complex" else holds
            f[holds] = factor
        out[own] = f
    return out


def _holds(texts: pa.Array, word: str) -> np.ndarray:
    return pc.match_substring(texts, word).to_numpy(zero_copy_only=False).astype(bool)


def _again(low: bytes) -> bool:
    """Whether one of at least six words, of over three letters, stands three times."""
    words = low.split()
    if len(words) < 6:
        return False
    long = [w for w in words if len(w) > 3 and (len(w) > 12 or len(w.decode()) > 3)]
    return len(long) - len(set(long)) > 1 and max(map(long.count, long)) > 2


def read(domain: pa.Array, ss: pa.Array, low: pa.Array) -> pa.Array:
    """Of documents' sentences, as they stand and in lower case: words between white space (n), different ones (kinds),
    whether one comes again, signs of a complex sentence (hits), of clauses, and the domain's factor."""
    many = pc.list_value_length(ss).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(len(many)), many)
    s, low = ss.flatten(), low.flatten()
    words = [w.split() for w in s.cast(pa.binary()).to_pylist()]
    n, kinds = np.array([len(w) for w in words], np.int32), np.array([len(set(w)) for w in words], np.int32)
    again = np.array([_again(t) for t in low.cast(pa.binary()).to_pylist()], bool)
    found = {w: _holds(low, w) for w in dict.fromkeys((*verdicts._INDICATORS, *verdicts._CLAUSES))}
    count = lambda names: sum((found[w].astype(np.int32) for w in names), np.zeros(len(n), np.int32))
    factor = _factors(domain.to_numpy(zero_copy_only=False).astype(str)[of], s, low, n, again)
    made = pa.StructArray.from_arrays([pa.array(x) for x in (n, kinds, again, count(verdicts._INDICATORS), count(verdicts._CLAUSES), factor)], names=["n", "kinds", "again", "hits", "clauses", "factor"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)), pa.int32()), made)


def _complexity(n: Column, hits: Column, clauses: Column) -> Column:
    return F.when(n < 5, 0.2).otherwise(F.least(F.lit(1.0), F.when(n > 15, 0.3).otherwise(0.0) + F.least(F.lit(0.5), 0.1 * hits) + F.least(F.lit(0.2), 0.05 * clauses)))


def sentences(t: Column) -> Column:
    """Sentences of three characters at least by the careful split, else by the plain
    one, else the whole text; none of a blank text."""
    long = lambda a: F.filter(a, lambda s: F.length(s) >= 3)
    whole = F.regexp_replace(t, r"^\s+|\s+$", "")
    return let(long(T.sentences_smart(t)), lambda a: F.when(F.size(a) > 0, a).otherwise(let(long(T.sentences(t)), lambda b: F.when(F.size(b) > 0, b).when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>")))))


def _adjusted(name: str, n: Column, kinds: Column, hard: Column, again: Column) -> Column:
    """What a sentence of n words multiplies a metric's probability by."""
    return {
        "perplexity": F.when(n < 8, 1.2).when(n > 25, 0.8).otherwise(1.0), "entropy": F.when((n > 3) & (kinds < 0.6 * n), 1.2).when((n > 3) & (kinds > 0.8 * n), 0.8).otherwise(1.0),
        "linguistic": F.when(hard < 0.3, 1.1).when(hard > 0.7, 0.9).otherwise(1.0), "structural": F.when((n < 5) | (n > 40), 0.8).when(n.between(8, 20), 1.1).otherwise(1.0),
        "semantic_analysis": F.when(again, 1.2).otherwise(1.0), "multi_perturbation_stability": F.when(n > 15, 1.1).otherwise(1.0),
    }[name]


def _percent(c: Column) -> Column:
    """A share with one digit, halves up, as printf('%.1f%%') writes it; without a formatter a row."""
    k = F.floor(c * 1000.0 + 0.5)
    return F.concat(F.floor(k / 10).cast("string"), F.lit("."), F.pmod(k, F.lit(10)).cast("string"), F.lit("%"))


def highlights(a: DataFrame) -> DataFrame:
    """doc_id, idx, n_words, sentence, ai_probability, confidence, colour, tooltip of
    each sentence of a (text, p, domain). A sentence of one or two words takes the
    first usable metric's probability; a blank text has a row that says so. A
    sentence is a row before it is judged; what is read of its words is read of many documents' at a time."""
    small_batches(a.sparkSession)
    usable = lambda m: F.get(F.filter("p", lambda x: x["error"].isNull() & (x["metric"] == m)), F.lit(0))
    first = reduce(lambda rest, m: F.coalesce(F.get(F.filter("p", lambda x: x["error"].isNull() & (x["metric"] == m) & (x["weight"] > 0)), F.lit(0))["ai"], rest), ["multi_perturbation_stability", "linguistic", "semantic_analysis", "perplexity", "entropy", "structural"], F.lit(None).cast("double"))
    a = a.select("doc_id", "domain", "p", F.size(F.filter("p", lambda x: x["error"].isNull())).alias("usable"), first.alias("first"), sentences(F.col("text")).alias("ss"))
    made = F.arrow_udf(read, _READ)(F.col("domain"), F.col("ss"), F.transform("ss", F.lower))
    a = a.select("doc_id", "domain", "usable", "first", *[usable(m).alias(f"m{i}") for i, m in enumerate(METRICS)], "ss", made.alias("made"))
    a = a.select("*", F.posexplode_outer(F.arrays_zip("ss", "made")).alias("idx", "x")).select("*", F.col("x.ss").alias("s"), "x.made.*").drop("ss", "made", "x")
    s, blank, n = F.col("s"), F.col("s").isNull(), F.col("n")
    a = a.withColumns({"n": F.coalesce(n, F.lit(0)), "hard": _complexity(n, F.col("hits"), F.col("clauses"))})
    span = F.greatest(F.lit(0.3), F.least(F.lit(1.0), n / 12.0))
    each = [F.col(f"m{i}") for i in range(len(METRICS))]
    a = a.withColumns({f"c{i}": F.when(m.isNotNull(), F.greatest(F.lit(0.1), m["confidence"] * 0.8 * span)) for i, m in enumerate(each)} | {f"ai{i}": F.when(m.isNotNull(), _clamp(m["ai"] * _adjusted(name, n, F.col("kinds"), F.col("hard"), F.col("again")))) for (i, m), name in zip(enumerate(each), METRICS)})
    a = a.withColumns({f"w{i}": m["weight"] / (1.0 + F.exp(-10 * (F.col(f"c{i}") - 0.5))) for i, m in enumerate(each)})
    total = lambda of: reduce(lambda x, i: x + F.coalesce(of(i), F.lit(0.0)), range(len(METRICS)), F.lit(0.0))
    few = (n < 3) | (F.col("usable") == 0)
    ai = F.when(few, F.when(n < 3, F.coalesce(F.col("first"), F.lit(0.5))).otherwise(0.5)).otherwise(total(lambda i: F.col(f"w{i}") * F.col(f"ai{i}")) / total(lambda i: F.col(f"w{i}")))
    c = F.when(few, F.when(n < 3, 0.2).otherwise(0.5)).otherwise(total(lambda i: F.col(f"c{i}")) / F.col("usable"))
    a = a.withColumns({"ai": ai, "c": c})
    bounded = lambda ai, f: _clamp(F.greatest(ai - 0.3, F.least(ai + 0.3, ai * f)))
    a = a.withColumns({"r": F.round(F.when(blank, 0.5).otherwise(bounded(F.col("ai"), F.col("factor"))), 6), "c": F.round(F.when(blank, 0.3).otherwise(F.col("c")), 6)})
    r = F.col("r")
    colour = F.lit(None).cast("string")
    for hi, name, _ in reversed(fixed.COLOURS):
        colour = F.when(r < hi, name).otherwise(colour)
    tops = F.slice(F.array_compact(F.array(*[F.when(each[i].isNotNull(), F.concat(F.lit(f"\n{name}: "), _percent(F.col(f"ai{i}")))) for i, name in enumerate(METRICS)])), 1, 4)
    lines = F.when(blank | few, "").otherwise(F.array_join(tops, ""))
    tip = F.concat(F.lit("AI Probability: "), _percent(r), F.lit("\nConfidence: "), _percent(F.col("c")), F.lit("\nDomain: "), F.col("domain"), F.lit("\nLength: "), n.cast("string"), F.lit(" words"), lines)
    return a.select("doc_id", F.coalesce("idx", F.lit(0)).cast("long").alias("idx"), n.cast("long").alias("n_words"), F.coalesce(s, F.lit("No text content")).alias("sentence"), r.alias("ai_probability"), F.col("c").alias("confidence"), colour.alias("colour"), tip.alias("tooltip"))


#: What stands for a feature where its metric failed.
SIGNALS = {"overall_perplexity": 50.0, "coherence_score": 0.5, "token_diversity": 0.5, "syntactic_complexity": 2.5, "stability_score": 0.5}
PUNCTUATION = {"em": "—", "semicolon": ";", "colon": ":", "comma": ",", "question": "?", "exclaim": "!"}


def style(rows: list[tuple[str, str, str]]) -> Part:
    """What attribution() reads of a text, for features.counted(): words, sentences, marks, and scores of the phrases."""
    shared: dict[str, phrases.Fingerprints] = {}
    models = sorted({m for m, _, _ in rows})

    def scores(low: Iterable[str]) -> list[np.ndarray]:
        own = shared.get("own")
        if own is None:
            own = shared["own"] = phrases.Fingerprints(rows)
        found = [own.scores(t) for t in low]
        return [*np.array(found, float).reshape(len(found), len(models)).T]

    def plain(x: scan.Plain) -> list[np.ndarray]:
        marks = [x.per_text(np.flatnonzero(x.raw == ord(c))) for c in PUNCTUATION.values()]
        return [x.per_text(scan.begins(x.body & ~x.space)), x.scan.sents, *marks, *scores(x.lower_texts())]

    def split(t: Column) -> list[Column]:
        marks = [F.length(t) - F.length(F.replace(t, F.lit(c), F.lit(""))) for c in PUNCTUATION.values()]
        return [F.size(T.space_words(t)), F.size(T.sentences(t)), *marks, F.lower(t)]

    def other(n: np.ndarray, *made: pa.Array) -> list[np.ndarray]:
        return [*[c.to_numpy() for c in made[:-1]], *scores(made[-1].to_pylist())]

    return Part(dict.fromkeys(("nw", "ns", *PUNCTUATION), "long") | {f"model{i}": "double" for i in range(len(models))}, plain, split, other)


def attribution(a: DataFrame, rows: list[tuple[str, str, str]]) -> DataFrame:
    """doc_id, model, probability, confidence, fingerprints, reasoning of a (domain, _n, what style() counts
    and the features the rules read): shares of phrases, style and rules by the domain's weights."""
    s = a.sparkSession
    place = {m: f"_style_model{i}" for i, m in enumerate(sorted({m for m, _, _ in rows}))}
    own = lambda c: F.col(f"_style_{c}")
    a = a.drop(*METRICS).withColumns({"nw": own("nw"), "ns": own("ns"), "len": F.try_divide(own("nw"), own("ns"))} | {k: F.try_divide(own(k).cast("double"), own("ns" if k in ("question", "exclaim") else "nw")) for k in PUNCTUATION})
    w = F.broadcast(fixed.frame(s, "attribution").withColumnRenamed("domain", "_d"))
    a = a.join(w, F.col("domain") == F.col("_d")).drop("_d").withColumns({f: F.when(F.col("_n") < 50, d).otherwise(F.col(f)) for f, d in SIGNALS.items()})
    ranges: dict[str, list[Column]] = {}
    for model, f, lo, hi, gain in verdicts.ranges_values():
        by = F.col("lengths") if f == "len" else F.lit(1.0)
        ranges.setdefault(model, []).append(F.when((F.col("ns") > 0) & (F.col("nw") > 0) & F.col(f).between(lo * by, hi * by), gain).otherwise(0.0))
    add = lambda cs: reduce(lambda x, y: x + y, cs, F.lit(0.0))

    def score(model: str) -> Column:
        phrase = F.least(F.lit(1.0), (F.col(place[model]) if model in place else F.lit(0.0)) * F.col("sensitivity"))
        style = F.least(F.lit(1.0), 0.3 + add(ranges.get(model, [])))
        rule = F.least(F.lit(1.0), add([F.when(F.expr(cond), strength * verdicts.RULE_WEIGHTS[kind] * (F.col(kind) if kind != "stability" else F.lit(1.0))).otherwise(0.0) for cond, strength, kind in verdicts.RULES.get(model, [])]))
        return F.struct(F.lit(model).alias("model"), F.round(F.col("by_phrase") * phrase + F.col("by_style") * style + F.col("by_rule") * rule, 9).alias("x"), phrase.alias("f"))

    a = a.withColumn("all", F.array(*map(score, verdicts.MODELS)))
    total = F.aggregate("all", F.lit(0.0), lambda acc, m: acc + m["x"])
    a = a.withColumn("ranked", let(total, lambda z: F.array_sort(F.transform("all", lambda m: F.struct((-F.round(m["x"] / z + 1.0e-9, 6)).alias("p"), m["model"].alias("model"))))))
    top = F.array_sort(F.transform(F.filter("all", lambda m: m["f"] > 0.1), lambda m: F.struct((-F.floor(m["f"] * 100 + 1.0e-9)).alias("f"), m["model"].alias("model"))))
    p, q = (-F.get("ranked", F.lit(i))["p"] for i in (0, 1))
    title = lambda c: F.initcap(F.replace(F.replace(c, F.lit("-"), F.lit(" ")), F.lit("_"), F.lit(" ")))
    percent = lambda c: F.format_string("%.1f%%", F.floor(c * 1000.0 + 0.5) / 10.0)
    a = a.select("doc_id", "domain", "ranked", p.alias("probability"), F.round(F.greatest(F.lit(0.05), F.least(F.lit(1.0), 0.8 * p + 1.5 * (p - q))), 6).alias("confidence"), F.array_join(F.transform(F.slice(top, 1, 5), lambda m: F.concat(m["model"], F.lit("="), (-m["f"]).cast("string"))), " ").alias("fingerprints"))
    likely = F.get("ranked", F.lit(0))["model"]
    known = F.col("probability") >= 0.01
    share = F.transform(F.filter(F.slice("ranked", 1, 6), lambda m: -m["p"] >= 0.01), lambda m: F.concat(F.lit("- "), title(m["model"]), F.lit(": "), percent(-m["p"])))
    notes = F.when(F.col("confidence") < 0.3, F.array(F.lit("- Low confidence attribution - text patterns are ambiguous"), F.lit("- May be human-written or from multiple AI sources"))).otherwise(F.array(F.concat(F.lit("- Calibrated for "), F.replace("domain", F.lit("_"), F.lit(" ")), F.lit(" domain"))))
    head = F.when(known, F.array(F.concat(F.lit("Predicted Model: "), title(likely)), F.concat(F.lit("Confidence: "), percent(F.col("confidence"))))).otherwise(F.array(F.lit("Most Likely: Unable to determine with high confidence")))
    reasoning = F.array_join(F.concat(head, F.array(F.concat(F.lit("Domain: "), title(F.col("domain")))), share, notes), "\n")
    return a.select("doc_id", F.when(known, likely).otherwise("unknown").alias("model"), "probability", "confidence", "fingerprints", reasoning.alias("reasoning"))
