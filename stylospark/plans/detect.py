"""The detection pipeline as one lazy plan, and its steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fingerprints, fixed
from ..operators import corpus, evaluation, features, forest, languages, metrics, phrases, sentence_vectors, tokens, verdict_rows, verdicts
from ..operators import language_metrics as lm
from ..operators import language_model as model
from ..session import durable


def domain_of(docs: DataFrame, domain: str | None = None) -> Column:
    """The given domain, or what the column `domain` means, else general."""
    if domain is None and "domain" in docs.columns:
        return F.coalesce(evaluation.domain_named(F.col("domain")), F.lit("general"))
    return F.lit(evaluation.domain_meant(domain or "general") or "general")


#: Metrics that a document's row gives: name, SQL, that of its features, and the function that computes those.
_IN_ROW = [
    ("structural", metrics.STRUCTURAL, metrics.STRUCTURAL_FEATURES, features.structural), ("entropy", metrics.ENTROPY, metrics.ENTROPY_FEATURES, features.entropies),
    ("linguistic", lm.LINGUISTIC, lm.LINGUISTIC_FEATURES, features.linguistic), ("semantic_analysis", lm.SEMANTIC, lm.SEMANTIC_FEATURES, features.semantic),
]
#: Of these, what features.counted() counts in one scan.
_COUNTED = {"structural": "structural", "entropy": "entropy", "linguistic": "linguistic", "semantic_analysis": "semantic"}
_BY_MODEL = [("perplexity", metrics.PERPLEXITY, metrics.PERPLEXITY_FEATURES), ("multi_perturbation_stability", lm.STABILITY, lm.STABILITY_FEATURES)]


#: Features that attribution reads, by the metric whose step has them.
_SIGNALS = {"structural": "length_uniformity", "entropy": "token_diversity", "linguistic": "syntactic_complexity", "semantic_analysis": "coherence_score", "perplexity": "overall_perplexity", "multi_perturbation_stability": "stability_score"}


def metric_columns(docs: DataFrame, skip: tuple[str, ...] = (), domain: str | None = None, text: bool = False, signals: bool = False, vectors: sentence_vectors.Basis | DataFrame | None = None, style: features.Part | None = None) -> DataFrame:
    """doc_id, domain, _n (characters), a struct (raw, confidence, mixed, error) for
    each metric, and the text and the features attribution reads if asked for.
    Metrics in `skip` have an error and aren't computed. Four metrics are projections
    of one scan; the language model and its look-ups are the only shuffles. Sentences
    are compared by their words, or by vectors: a learned basis, or a table (doc_id,
    idx, vec) that is joined. style: what else is counted of the texts, as _style_ columns."""
    t = F.coalesce("text", F.lit(""))
    docs = tokens.spread(docs.select("doc_id", "text", domain_of(docs, domain).alias("_domain")))
    a = docs.select("doc_id", "text", F.length(t).alias("_n"), "_domain", *([F.col("text").alias("_text")] if text else []))
    keep = ("text", "_n", "_domain", *(["_text"] if text else []))
    skipped = F.struct(F.lit(0.5).alias("raw"), F.lit(0.3).alias("confidence"), F.lit(0.0).alias("mixed"), F.lit("Skipped").alias("error"))
    more = lambda name: (_SIGNALS[name],) if signals else ()
    parts = {n: p for n, p in _COUNTED.items() if n not in skip and (n != "semantic_analysis" or vectors is None)}
    if parts or style:  # of one scan; only supplied or learned vectors need the text again
        again = vectors is not None and "semantic_analysis" not in skip
        a = features.counted(a, tuple(parts.values()), keep if again else keep[1:], {"style": style} if style else None)
        keep = tuple(a.columns[1:])
    for name, sql_text, sql, made in _IN_ROW:
        if name == "semantic_analysis":  # the last: the text isn't needed any more
            keep = tuple(c for c in keep if c != "text")
            if vectors is not None:
                by = sentence_vectors.supplied if isinstance(vectors, DataFrame) else sentence_vectors.semantic
                made = lambda d, k: by(d, vectors, k)  # noqa: B023, E731
        if name in parts:
            keep = tuple(c for c in keep if not c.startswith(f"_{parts[name]}_"))
        if name in skip:
            a = a.select("doc_id", *keep, skipped.alias(name), *[F.lit(None).cast("double").alias(c) for c in more(name)])
        else:
            a = metrics.step(sql_text, sql, made(a, keep), name, (*keep, *more(name)))
        keep = (*keep, name, *more(name))
    a, keep = a.drop("_chars"), tuple(c for c in keep if c != "_chars")
    own = [x for x in _BY_MODEL if x[0] not in skip]
    if own:
        a = model.features(docs, a.withColumnRenamed("_n", "n_chars").select("*", F.col("n_chars").alias("_n")), keep)
        for i, (name, sql_text, sql) in enumerate(own):
            rest = tuple(c for c in model.STABILITY[1:]) if i + 1 < len(own) else ()
            a = metrics.step(sql_text, sql, a, name, (*keep, *dict.fromkeys((*more(name), *rest))))
            keep = (*keep, name, *more(name))
    for name, _, _ in _BY_MODEL:
        if name in skip:
            a = a.withColumns({name: skipped} | {c: F.lit(None).cast("double") for c in more(name)})
    return a.withColumnRenamed("_domain", "domain").withColumnRenamed("_text", "text")


def metric_rows(docs: DataFrame, skip: tuple[str, ...] = (), domain: str | None = None) -> DataFrame:
    """doc_id, domain, metric, raw, confidence, mixed, error."""
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), f"{n}.raw", f"{n}.confidence", f"{n}.mixed", f"{n}.error") for n in fixed.METRICS])
    return metric_columns(docs, skip, domain).select("doc_id", "domain", F.explode(rows).alias("x")).select("doc_id", "domain", "x.*")


def judged(docs: DataFrame, domain: str | None = None, skip: tuple[str, ...] = (), text: bool = False, signals: bool = False, vectors: sentence_vectors.Basis | DataFrame | None = None) -> DataFrame:
    """A row a document with the array `p` of its metrics' probabilities: what all
    verdicts below are expressions of."""
    return verdict_rows.judged(metric_columns(docs, skip, domain, text, signals, vectors))


def probabilities(docs: DataFrame, domain: str | None = None, skip: tuple[str, ...] = (), rows: DataFrame | None = None) -> DataFrame:
    return verdict_rows.probabilities(judged(docs, domain, skip) if rows is None else rows)


def ensemble(docs: DataFrame, domain: str | None = None, skip: tuple[str, ...] = (), rows: DataFrame | None = None, vectors: sentence_vectors.Basis | DataFrame | None = None) -> DataFrame:
    return verdict_rows.verdict(judged(docs, domain, skip, vectors=vectors) if rows is None else rows).select("doc_id", "verdict.*")


def methods(docs: DataFrame, domain: str | None = None) -> DataFrame:
    return verdict_rows.methods(judged(docs, domain))


def contributions(docs: DataFrame, domain: str | None = None) -> DataFrame:
    return verdict_rows.contributions(judged(docs, domain))


def ablation(docs: DataFrame, domain: str | None = None) -> DataFrame:
    return verdict_rows.ablation(judged(docs, domain))


def highlights(docs: DataFrame, domain: str | None = None) -> DataFrame:
    return verdict_rows.highlights(judged(docs, domain, text=True))


def risk(marks: DataFrame) -> DataFrame:
    return marks.sparkSession.sql(metrics.spark_sql(verdicts.risk_sql()), marks=marks)


def attribution(docs: DataFrame, prints: DataFrame | None = None, domain: str | None = None) -> DataFrame:
    """The likeliest generator of each document; prints (model, kind, phrase) may stand
    for the fixed phrases."""
    rows = fingerprints.rows() if prints is None else phrases.checked(prints)
    return verdict_rows.attribution(metric_columns(docs, (), domain, signals=True, style=verdict_rows.style(rows)), rows)


def language(docs: DataFrame) -> DataFrame:
    """doc_id, language, matches by script and function words, without a shuffle."""
    return languages.by_words(docs)


def scripts(docs: DataFrame) -> DataFrame:
    """doc_id, script, and the characters of each script: the dominant one,
    mixed if several and none has 70 %, unknown without any."""
    t = F.coalesce("text", F.lit(""))
    t = F.regexp_replace(t, r"[\s\p{Punct}]+", "")
    names = list(fixed.SCRIPTS)
    a = docs.select("doc_id", t.alias("t")).select("doc_id", "t", languages.beyond_latin(F.col("t")).alias("rest"))
    counts = a.select("doc_id", *languages.script_counts(F.col("t"), F.col("rest")))
    total, top = sum((F.col(n) for n in names), F.lit(0)), F.greatest(*names)
    best = F.lit(None).cast("string")
    for n in reversed(names):
        best = F.when(F.col(n) == top, n).otherwise(best)
    several = sum(((F.col(n) > 0).cast("int") for n in names), F.lit(0)) > 1
    return counts.select("doc_id", F.when(total == 0, "unknown").when(several & (top / total < 0.7), "mixed").otherwise(best).alias("script"), *names)


def report(docs: DataFrame, domain: str | None = None) -> DataFrame:
    """doc_id, report: the verdict, the metrics by weight, reasons and advice as JSON, all
    from one row a document."""
    a = verdict_rows.verdict(judged(docs, domain))
    v = lambda c: F.col(f"verdict.{c}")
    sections = F.struct(
        F.struct(F.lit("1.0.0").alias("version"), F.lit("json").alias("format"), F.col("doc_id").cast("string").alias("report_id")).alias("report_metadata"),
        F.struct(v("verdict").alias("final_verdict"), v("ai_probability"), v("human_probability"), v("mixed_probability"), v("overall_confidence"), v("uncertainty").alias("uncertainty_score"), v("consensus").alias("consensus_level"), F.col("domain"), F.col("_n").alias("text_length")).alias("overall_results"),
        F.struct(F.lit("confidence_calibrated").alias("method_used"), v("confidence_label"), v("valid_metrics")).alias("ensemble_analysis"),
        verdict_rows.parts().alias("detailed_metrics"), verdict_rows.reasons().alias("detection_reasoning"),
        F.struct(F.transform(F.filter("p", lambda x: x["error"].isNotNull()), lambda x: F.concat(x["metric"], F.lit(" metric error: "), x["error"])).alias("warnings")).alias("performance_metrics"),
    )
    return a.select("doc_id", F.to_json(sections).alias("report"))


def detect(docs: DataFrame, domain: str | None = None) -> DataFrame:
    """Language, script, verdict and its numbers for every document."""
    return ensemble(docs, domain).join(language(docs), "doc_id").join(scripts(docs).select("doc_id", "script"), "doc_id")


def domain(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, domain, secondary, confidence by the words of a lexicon (domain, term):
    a table of the user's, or what corpus.learn_terms finds in labelled documents."""
    return metrics.compute(corpus.DOMAIN, docs, domain_terms=terms, tok=tokens.each_word(tokens.spread(docs)))


def adaptive_thresholds(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, metric, ai_thr, human_thr, weight, ensemble_threshold by each document's own domains."""
    s = docs.sparkSession
    return metrics.compute(corpus.ADAPTIVE, docs, domain_terms=terms, tok=tokens.each_word(tokens.spread(docs)), thresholds=fixed.frame(s, "thresholds"), domain_cfg=fixed.frame(s, "domain_cfg"))


def forest_scores(docs: DataFrame, labels: DataFrame, path: str | None = None, domain: str | None = None) -> DataFrame:
    """doc_id, ai_probability, human_probability, method by a forest learned from labels
    (doc_id, y); with a path the model is saved there and read back."""
    rows = durable(verdict_rows.verdict(judged(docs, domain)).select("doc_id", "p", "verdict"), "judged")
    model = forest.fit(rows, labels)
    if model is not None and path:
        forest.save(model, path)
        model = forest.load(path)
    return forest.score(rows, model)


def search_weights(docs: DataFrame, labels: DataFrame, units: int = 10) -> DataFrame:
    return corpus.search_weights(judged(docs), labels, units)


def adjusted_thresholds(ens: DataFrame) -> DataFrame:
    """doc_id and its verdict's threshold moved by confidence, both ways."""
    s = ens.sparkSession
    return metrics.run(s, metrics.spark_sql(corpus.ADJUSTED), ens=ens, domain_cfg=fixed.frame(s, "domain_cfg"))


def warnings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, source, warning: none or several rows of a document."""
    s = docs.sparkSession
    return metrics.run(s, metrics.spark_sql(corpus.WARNINGS), lang=language(docs), script=scripts(docs), dom=domain(docs, terms), prob=probabilities(docs))


def score_once(docs: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """score() of the distinct texts, joined back to all documents that have them."""
    key = F.sha2(F.coalesce("text", F.lit("")), 256)
    one = docs.groupBy(key.alias("_key")).agg(F.min("doc_id").alias("_doc"))
    own = docs.select("doc_id", key.alias("_key")).join(one, "_key").select("doc_id", "_doc")
    few = docs.join(one.select(F.col("_doc").alias("doc_id")), "doc_id", "left_semi")
    return own.join(score(few).withColumnRenamed("doc_id", "_doc"), "_doc").drop("_doc")


def highlight_html(marks: DataFrame) -> DataFrame:
    """doc_id, html: a span for each sentence, in order, with its colour class."""
    text = F.replace(F.replace(F.replace(F.col("sentence"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    quoted = F.replace(F.replace(F.replace(F.col("tooltip"), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("\n"), F.lit("&#10;"))
    data = lambda name, c: F.concat(F.lit(f'" data-{name}="'), c)
    span = F.concat(F.lit('<span class="'), F.col("colour"), data("index", F.col("idx").cast("string")), data("ai-probability", F.format_string("%.6f", "ai_probability")), data("confidence", F.format_string("%.6f", "confidence")), F.lit('" title="'), quoted, F.lit('">'), text, F.lit("</span>"))
    return marks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", span.alias("s")))), lambda x: x["s"]), " ").alias("html"))


def detection_events(ens: DataFrame, docs: DataFrame) -> DataFrame:
    """One log record per verdict, to append to a table or stream."""
    size = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("text_length"))
    return ens.join(size, "doc_id").select(F.col("doc_id").cast("string").alias("analysis_id"), F.current_timestamp().alias("ts"), "text_length", "verdict", F.col("overall_confidence").alias("confidence"), "domain")
