"""Queries of the library's own operators and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import language_metrics as lm
from .functions import fingerprints, fixed
from .functions import text as T
from .operators import corpus, evaluation, languages, metrics, parses, perturbations, sentence_vectors, tokens, verdicts
from .plans import detect
from .session import durable, shared
from .sources import files
from .streaming import events, repeats

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def query(oracle: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLES[name or f.__name__] = oracle
        return f

    return add


for _name, _text in {"structural_features": metrics.STRUCTURAL_FEATURES, "structural_metric": metrics.STRUCTURAL, "entropy_features": metrics.ENTROPY_FEATURES, "entropy_metric": metrics.ENTROPY, "perplexity_features": metrics.PERPLEXITY_FEATURES, "perplexity_metric": metrics.PERPLEXITY, "semantic_features": lm.SEMANTIC_FEATURES, "semantic_metric": lm.SEMANTIC, "linguistic_features": lm.LINGUISTIC_FEATURES, "linguistic_metric": lm.LINGUISTIC, "stability_features": lm.STABILITY_FEATURES, "stability_metric": lm.STABILITY}.items():
    query(metrics.duck_sql(_text), _name)(lambda spark, sf_dir, text=_text: metrics.compute(text, docs(spark, sf_dir)))


query(parses.ROWS_SQL, "parses")(lambda s, d: parses.parse(docs(s, d)))
query(f"SELECT * EXCLUDE n_chars FROM ({parses.FEATURES_SQL})", "linguistic_from_parses")(lambda s, d: parses.from_table(parses.parse(docs(s, d)), docs(s, d)))
query(metrics.duck_sql(perturbations.ROWS_SQL), "perturbations")(lambda s, d: perturbations.rows(docs(s, d)))
query(metrics.duck_sql(perturbations.STABILITY_SQL), "perturbation_stability")(lambda s, d: perturbations.stability(docs(s, d)))


_T, _C, _P, _W, _A = (fixed.values_sql(n) for n in ("thresholds", "domain_cfg", "performance", "stopwords", "attribution"))
_FINGERPRINTS = "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in fingerprints.rows()) + ") t(model, kind, phrase))"
def _named(body: str, *clauses: str) -> str:
    """DuckDB SQL of a text over named results of other texts."""
    names = [c.split(" AS ", 1)[0] for c in clauses]
    own = metrics.duck_sql(body, **{n: n for n in names}, thresholds=_T, domain_cfg=_C, performance=_P, stopwords=_W, attribution=_A, fingerprints=_FINGERPRINTS, labels="labels", documents="documents")
    head, _, tail = own.partition("\nSELECT * FROM (\n")
    need = {n for c in clauses for n in metrics.needed(c)} | set(metrics.needed(body))
    extra = [tokens.DUCK[n] for n in sorted(need) if n in tokens.DUCK and tokens.DUCK[n] not in head]
    rendered = []
    for c in clauses:
        for a, b in metrics.DUCKDB.items():
            c = c.replace(a, b)
        c = metrics.doubles(c, "E0")
        rendered.append(metrics.re.sub(r"\{(\w+)\}", lambda m: {"thresholds": _T, "domain_cfg": _C, "performance": _P}.get(m[1], m[1]), c))
    return ",\n".join([head, *extra, *rendered]) + "\nSELECT * FROM (\n" + tail


_RAW = f"raw AS ({verdicts.RAW})"
_DOM = "doc_domain AS (SELECT doc_id, 'general' AS domain FROM documents)"
_PROB = f"prob AS MATERIALIZED ({verdicts.PROBABILITIES})"
_BASE = (_RAW, _DOM)
query(_named(verdicts.PROBABILITIES, *_BASE), "metric_results")(lambda s, d: detect.probabilities(docs(s, d)))
query(_named(verdicts.ENSEMBLE, *_BASE, _PROB), "ensemble_verdict")(lambda s, d: detect.ensemble(docs(s, d)))
query(_named(verdicts.METHODS, *_BASE, _PROB), "ensemble_methods")(lambda s, d: detect.methods(docs(s, d)))
query(_named(verdicts.CONTRIBUTIONS, *_BASE, _PROB), "metric_contributions")(lambda s, d: detect.contributions(docs(s, d)))
query(_named(verdicts.HIGHLIGHTS, *_BASE, _PROB), "sentence_highlights")(lambda s, d: detect.highlights(docs(s, d)))
query(_named(verdicts.risk_sql(), *_BASE, _PROB, f"marks AS ({verdicts.HIGHLIGHTS})"), "highlight_risk")(lambda s, d: detect.risk(detect.highlights(docs(s, d))))
query(_named(verdicts.EVALUATION, *_BASE, _PROB, f"ens AS ({verdicts.ENSEMBLE})"), "evaluation")(lambda s, d: s.sql(metrics.spark_sql(verdicts.EVALUATION), ens=detect.ensemble(docs(s, d)), labels=table(s, d, "labels"), documents=table(s, d, "documents")))
query(_named(verdicts.ATTRIBUTION, _DOM), "attribution")(lambda s, d: detect.attribution(docs(s, d)))

#: Documents whose domain is dealt by doc_id, so that every domain's settings are run over the whole table.
_DEALT = f"doc_domain AS (SELECT doc_id, {fixed.domains()!r}[doc_id % 16 + 1] AS domain FROM documents)"


def _dealt(s: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, fixed.domains()))
    return docs(s, d).withColumn("domain", F.element_at(names, (F.pmod("doc_id", F.lit(16)) + 1).cast("int")))


query(_named(verdicts.ENSEMBLE, _RAW, _DEALT, _PROB), "verdict_by_domain")(lambda s, d: detect.ensemble(_dealt(s, d)))
query(_named(verdicts.HIGHLIGHTS, _RAW, _DEALT, _PROB), "highlights_by_domain")(lambda s, d: detect.highlights(_dealt(s, d)))
query(_named(verdicts.ATTRIBUTION, _DEALT), "attribution_by_domain")(lambda s, d: detect.attribution(_dealt(s, d)))
query(name="report_json")(lambda s, d: detect.report(docs(s, d)))


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: N802
    return QUERIES["ensemble_verdict"](spark, sf_dir)


@query(r"""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2""")
def events_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.windowed(table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""
    WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM b GROUP BY user_id, s""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.sessions(table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_type, count(*) AS uses, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, max(ts) AS last_used FROM events GROUP BY 1")
def usage_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.usage(table(spark, sf_dir, "events"))


@query(r"""
    WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS t FROM pages),
    b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', chr(10), 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS t FROM a)
    SELECT page_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), chr(10)) AS text FROM b""")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", files.html_text(F.coalesce("html", F.lit(""))).alias("text"))


@query(r"""
    WITH s AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '[.!?]+') AS p FROM documents)
    SELECT doc_id, CAST(unnest(range(len(p))) AS BIGINT) AS idx, unnest(p) AS sentence FROM (SELECT doc_id, list_filter(list_transform(p, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 10) AS p FROM s)""")
def sentences_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.sen10(docs(spark, sf_dir)).select("doc_id", F.col("idx").cast("long").alias("idx"), F.col("s").alias("sentence"))


@query(r"""
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents)
    SELECT doc_id, CAST(i // 462 AS BIGINT) AS chunk, array_to_string(w[i + 1:i + 512], ' ') AS text FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 512 THEN [0] ELSE range(0, len(w), 462) END) AS i FROM w)""")
def word_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = docs(spark, sf_dir).select("doc_id", F.posexplode(T.chunks(T.space_words(F.coalesce("text", F.lit(""))))).alias("chunk", "ws"))
    return c.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.array_join("ws", " ").alias("text"))


@query(r"""
    WITH a AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}_\s''-]', ' ', 'g'), '\s+'), lambda x: x <> ''), lambda x: regexp_replace(x, '^[''-]+|[''-]+$', '', 'g')) AS w FROM documents),
    b AS (SELECT doc_id, list_filter(w, lambda x: (length(x) > 1 OR lower(x) IN ('a', 'i')) AND NOT regexp_full_match(regexp_replace(x, '[''-]', '', 'g'), '\p{Nd}+')) AS w FROM a)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(list_distinct(list_transform(w, lambda x: lower(x)))) AS BIGINT) AS unique_words, md5(array_to_string(w, ' ')) AS words_md5 FROM b""")
def words_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = docs(spark, sf_dir).select("doc_id", T.words(F.coalesce("text", F.lit(""))).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct(F.transform("w", lambda x: F.lower(x)))).cast("long").alias("unique_words"), F.md5(F.array_join("w", " ")).alias("words_md5"))


@query()
def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.clean(tokens.spread(docs(spark, sf_dir))).drop("words", "sentences")


@query(r"""
    WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), 'https?://\S+', '', 'g'), 'www\.\S+', '', 'g'), '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b', '', 'g') AS t FROM documents)
    SELECT doc_id, md5(regexp_replace(regexp_replace(t, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS text_md5, CAST(length(regexp_replace(regexp_replace(t, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS BIGINT) AS n_chars FROM a""")
def links_and_space_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.squeeze(T.drop_emails(T.drop_urls(F.coalesce("text", F.lit("")))))
    return docs(spark, sf_dir).select("doc_id", F.md5(t).alias("text_md5"), F.length(t).cast("long").alias("n_chars"))


@query("""
    WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    m AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY label, i),
    c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY label)
    SELECT e.label, count(*) AS n, round(avg(list_cosine_similarity(v, c)), 6) AS cohesion FROM e JOIN c ON c.label = e.label GROUP BY e.label""")
def label_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine of each label's vectors with their mean."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    mean = v.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return v.join(mean, "label").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(dot("v", "c") / F.sqrt(dot("v", "v") * dot("c", "c"))), 6).alias("cohesion"))


@query("SELECT count(*) AS total, count(*) FILTER (length(coalesce(text, '')) >= 50) AS successful, count(*) FILTER (length(coalesce(text, '')) < 50) AS failed, count(DISTINCT coalesce(text, '')) AS texts FROM documents")
def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return docs(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(F.length(t) >= 50).alias("successful"), F.count_if(F.length(t) < 50).alias("failed"), F.count_distinct(F.sha2(t, 256)).alias("texts"))


def _scripts_sql() -> str:
    names = list(fixed.SCRIPTS)
    counts = ", ".join(f"length(regexp_replace(t, '[^{fixed.SCRIPTS[n][0]}]', '', 'g')) AS {n}" for n in names)
    total, top = " + ".join(names), f"greatest({', '.join(names)})"
    several = " + ".join(f"({n} > 0)::INT" for n in names)
    best = " ".join(f"WHEN {n} = {top} THEN '{n}'" for n in names)
    return f"""SELECT doc_id, CASE WHEN {total} = 0 THEN 'unknown' WHEN {several} > 1 AND {top} / ({total}) < 0.7 THEN 'mixed' {best} END AS script, {", ".join(names)}
      FROM (SELECT doc_id, {counts} FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\s[:punct:]]', '', 'g') AS t FROM documents))"""


@query(_scripts_sql())
def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.scripts(docs(spark, sf_dir))


query(metrics.duck_sql(verdicts.LANGUAGE, script=f"({_scripts_sql()})", stopwords=_W), "language_by_words")(lambda s, d: detect.language(docs(s, d)))


@query(rf"""
    WITH a AS (SELECT doc_id, {verdicts.smart_sql("coalesce(text, '')")} AS t FROM documents),
    b AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(t, '[.!?]+(\s+[A-Z])', chr(1) || '\1', 'g'), '[.!?]+(\r?\n|\r)?$', chr(1)), chr(1)), lambda x: regexp_replace(replace(replace(x, '<DOT>', '.'), '<ELLIPSIS>', '...'), '^\s+|\s+$', '', 'g')),
      lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda y: y <> '')) >= 2) AS s FROM a)
    SELECT doc_id, CAST(unnest(range(len(s))) AS INTEGER) AS idx, unnest(s) AS sentence FROM b""")
def sentences_smart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.spread(docs(spark, sf_dir)).select("doc_id", F.posexplode(T.sentences_smart(F.coalesce("text", F.lit("")))).alias("idx", "sentence"))


@query()
def sentences_lookbehind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.spread(docs(spark, sf_dir)).select("doc_id", F.posexplode(T.sentences_lookbehind(F.coalesce("text", F.lit("")))).alias("idx", "sentence"))


for _name, _text in {"lm_bigram": corpus.LM_BIGRAM, "lm_unigram": corpus.LM_UNIGRAM, "overlapping_chunks": corpus.OVERLAPPING}.items():
    query(metrics.duck_sql(_text), _name)(lambda spark, sf_dir, text=_text: metrics.compute(text, docs(spark, sf_dir)))

#: The tables label no domain: documents' sources, dealt over the sixteen, stand for labels.
_LABELLED = f"(SELECT text, {fixed.domains()!r}[CAST(regexp_extract(source, '[0-9]+') AS INTEGER) % 16 + 1] AS domain FROM documents)"
_TERMS = f"({corpus.TERMS_SQL.replace('{labelled}', _LABELLED)})"


def _terms(s: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, fixed.domains()))
    at = F.regexp_extract("source", "[0-9]+", 0).cast("int") % 16 + 1
    return durable(corpus.learn_terms(table(s, d, "documents").select("text", F.element_at(names, at).alias("domain"))), "domain-terms")


query(corpus.TERMS_SQL.replace("{labelled}", _LABELLED), "domain_terms")(_terms)
query(_named(corpus.search_sql(), *_BASE, _PROB), "weight_search")(lambda s, d: detect.search_weights(docs(s, d), table(s, d, "labels")))
_ENS = f"ens AS ({verdicts.ENSEMBLE})"
query(metrics.duck_sql(corpus.DOMAIN, domain_terms=_TERMS), "domain_by_lexicon")(lambda s, d: detect.domain(docs(s, d), _terms(s, d)))
query(_named(corpus.ABLATION, *_BASE, _PROB), "ablation")(lambda s, d: detect.ablation(docs(s, d)))
query(_named(corpus.CALIBRATION, *_BASE, _PROB, _ENS), "calibration")(lambda s, d: s.sql(metrics.spark_sql(corpus.CALIBRATION), ens=detect.ensemble(docs(s, d)), labels=table(s, d, "labels")))
query(_named(corpus.SUMMARY, *_BASE, _PROB, _ENS), "verdict_summary")(lambda s, d: s.sql(metrics.spark_sql(corpus.SUMMARY), ens=detect.ensemble(docs(s, d))))
query(_named(corpus.BREAKDOWN, *_BASE, _PROB, _ENS), "verdict_breakdown")(lambda s, d: s.sql(metrics.spark_sql(corpus.BREAKDOWN), ens=detect.ensemble(docs(s, d)), documents=table(s, d, "documents")))
query(name="highlight_html")(lambda s, d: detect.highlight_html(detect.highlights(docs(s, d))))
query(metrics.duck_sql(metrics.ENTROPY), "score_identical_once")(lambda s, d: detect.score_once(docs(s, d), lambda few: metrics.compute(metrics.ENTROPY, few)))
query(metrics.duck_sql(corpus.ADAPTIVE, domain_terms=_TERMS, thresholds=_T, domain_cfg=_C), "adaptive_thresholds")(lambda s, d: detect.adaptive_thresholds(docs(s, d), _terms(s, d)))
query(_named(corpus.ADJUSTED, *_BASE, _PROB, _ENS), "adjusted_thresholds")(lambda s, d: detect.adjusted_thresholds(detect.ensemble(docs(s, d))))
_MORE = (f"lang AS (SELECT * FROM ({ORACLES['language_by_words']}) x)", f"script AS ({_scripts_sql()})", f"dom AS (SELECT * FROM ({ORACLES['domain_by_lexicon']}) x)")
query(_named(corpus.WARNINGS, *_BASE, _PROB, *_MORE), "analysis_warnings")(lambda s, d: detect.warnings(docs(s, d), _terms(s, d)))


@query("""
    WITH e AS (SELECT CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) < 25 THEN 'short' WHEN CAST(json_extract(props, '$.k') AS INTEGER) < 50 THEN 'medium' ELSE 'long' END AS size_class, value FROM events)
    SELECT size_class, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM e GROUP BY 1""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return events.latency(e.withColumn("size", F.get_json_object("props", "$.k").cast("int")), "size", "value", (25, 50))
_CLEAN = f"(SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), 'https?://\\S+|www\\.\\S+', '', 'g'), '\\S+@\\S+', '', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM documents)"
_CLEAN_SCRIPT = _scripts_sql().replace("FROM documents", f"FROM {_CLEAN} cleaned")
_CLEAN_WORDS = f"SELECT q.doc_id, q.language, c.script NOT IN ('latin', 'mixed', 'unknown') AS by_script FROM ({metrics.duck_sql(verdicts.LANGUAGE, script=f'({_CLEAN_SCRIPT})', stopwords=_W).replace('FROM documents)', f'FROM {_CLEAN} cleaned)')}) q JOIN ({_CLEAN_SCRIPT}) c ON c.doc_id = q.doc_id"
query(languages.CHUNKS_SQL, "language_chunks")(lambda s, d: languages.chunk_rows(docs(s, d)))
query(languages.MODEL_SQL, "language_model")(lambda s, d: languages.train(table(s, d, "documents")))
query(languages.DETECT_SQL.replace("{words}", _CLEAN_WORDS).replace("{script}", _CLEAN_SCRIPT), "language_detected")(lambda s, d: languages.detect(tokens.spread(docs(s, d)), languages.train(table(s, d, "documents"))))
query(f"SELECT doc_id, language = 'en' AS is_english FROM ({ORACLES['language_by_words']}) x", "english")(lambda s, d: detect.language(docs(s, d)).select("doc_id", (F.col("language") == "en").alias("is_english")))


@query(r"""
    WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), 'https?://\S+|www\.\S+', '', 'g'), '\S+@\S+', '', 'g'), '\s+', ' ', 'g') AS t FROM documents)
    SELECT doc_id, md5(regexp_replace(t, '^\s+|\s+$', '', 'g')) AS text_md5, CAST(length(regexp_replace(t, '^\s+|\s+$', '', 'g')) AS BIGINT) AS n_chars FROM a""")
def cleaned_for_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.language_text(F.coalesce("text", F.lit("")))
    return docs(spark, sf_dir).select("doc_id", F.md5(t).alias("text_md5"), F.length(t).cast("long").alias("n_chars"))


@query()
def forest_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on four fifths of the labels; held_out tells the other documents."""
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    labels = table(spark, sf_dir, "labels").where(~held).select("doc_id", (F.col("quality") == 0).cast("int").alias("y"))
    return detect.forest_scores(docs(spark, sf_dir), labels, shared(spark, "forest")).withColumn("held_out", held)


query(name="semantic_by_factors")(lambda s, d: sentence_vectors.semantic(docs(s, d), sentence_vectors.learn(docs(s, d))))

#: The tables supply no sentences' vectors: those of `embeddings` are dealt over the sentences.
_DEAL = "v.vec_id = (s.doc_id * 31 + s.idx) % (SELECT count(*) FROM embeddings)"


@query("WITH " + ",\n".join(tokens.DUCK[n] for n in ("src", "sen10", "keyword")) + "," + sentence_vectors.SUPPLIED_SQL.replace("{deal}", _DEAL))
def semantic_by_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    sentences = tokens.sen10(docs(spark, sf_dir)).select("doc_id", "idx", F.pmod(F.col("doc_id") * 31 + F.col("idx"), F.lit(v.count())).alias("vec_id"))
    return sentence_vectors.supplied(docs(spark, sf_dir), sentences.join(v, "vec_id").drop("vec_id"))


@query("""
    WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    p AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.v, e.v), 9) AS c FROM e q JOIN e ON e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM p)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(c, 6) AS cosine FROM r WHERE rank <= 5""")
def vector_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return sentence_vectors.nearest(v, v.where("vec_id % 100 = 0"))


@query("SELECT sha256(coalesce(text, '')) AS text_key, min(doc_id) AS first_id, count(*) AS total FROM documents GROUP BY 1")
def stream_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream; as the table has no times all have one, so none is late."""
    path = f"{sf_dir}/documents.parquet"
    d = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path[:-1] + "?")  # a pattern: a stream's plain path must be a folder
    d = d.select("doc_id", F.timestamp_seconds(F.lit(0)).alias("ts"), "text")
    spark.conf.set(*repeats.STORE)
    out = shared(spark, "repeats")
    q = repeats.write_batches(repeats.repeats(d), out, shared(spark, "repeats-state"), "update")
    q.awaitTermination()
    return repeats.totals(spark.read.parquet(out))


_EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, " + ", ".join(f"round(count(*) FILTER (event_type = '{t}') / count(*), 6) AS share_{i}" for i, t in enumerate(_EVENT_TYPES)) + " FROM events GROUP BY 1")
def event_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.shares(table(spark, sf_dir, "events"), _EVENT_TYPES, key="event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


#: The tables mark no mixed texts: toxic ones stand for them, of the others those of quality 0 for generated ones.
_ACTUAL = "CASE WHEN toxic = 1 THEN 'mixed' WHEN quality = 0 THEN 'ai' ELSE 'human' END"
_OUTCOMES = f"SELECT l.lang, l.actual, e.verdict, CASE e.verdict WHEN 'AI-Generated' THEN 'ai' WHEN 'Human-Written' THEN 'human' WHEN 'Mixed (AI + Human)' THEN 'mixed' ELSE 'uncertain' END AS p FROM ens e JOIN (SELECT l.doc_id, d.lang, {_ACTUAL} AS actual FROM labels l JOIN documents d ON d.doc_id = l.doc_id) l ON l.doc_id = e.doc_id"


def _actual(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "labels").select("doc_id", F.expr(_ACTUAL).alias("actual")).join(table(s, d, "documents").select("doc_id", "lang"), "doc_id")


query(_named(f"""SELECT lang, actual, COUNT(*) AS n, COUNT(*) FILTER (p = 'ai') AS predicted_ai, COUNT(*) FILTER (p = 'human') AS predicted_human, COUNT(*) FILTER (p = 'mixed') AS predicted_mixed,
    COUNT(*) FILTER (p = 'uncertain') AS predicted_uncertain, ROUND(COUNT(*) FILTER (p = actual) / COUNT(*), 6) AS right FROM ({_OUTCOMES}) q GROUP BY lang, actual""", *_BASE, _PROB, _ENS), "confusion")(
    lambda s, d: evaluation.confusion(detect.ensemble(docs(s, d)), _actual(s, d), ("lang",)))
query(_named(f"""SELECT lang, COUNT(*) AS n, ROUND(AVG(CAST(p = actual AS INT)), 6) AS accuracy, ROUND(SUM(CAST(p = 'ai' AND actual = 'ai' AS INT)) / NULLIF(SUM(CAST(p = 'ai' AS INT)), 0), 6) AS precision,
    ROUND(SUM(CAST(p = 'ai' AND actual = 'ai' AS INT)) / NULLIF(SUM(CAST(actual = 'ai' AS INT)), 0), 6) AS recall, ROUND(2 * SUM(CAST(p = 'ai' AND actual = 'ai' AS INT)) / NULLIF(SUM(CAST(p = 'ai' AS INT)) + SUM(CAST(actual = 'ai' AS INT)), 0), 6) AS f1,
    ROUND(SUM(CAST(p = 'ai' AND actual <> 'ai' AS INT)) / NULLIF(SUM(CAST(actual <> 'ai' AS INT)), 0), 6) AS false_positive_rate, ROUND(SUM(CAST(p <> 'ai' AND actual = 'ai' AS INT)) / NULLIF(SUM(CAST(actual = 'ai' AS INT)), 0), 6) AS false_negative_rate
    FROM ({_OUTCOMES}) q GROUP BY lang""", *_BASE, _PROB, _ENS), "detection_rates")(lambda s, d: evaluation.rates(detect.ensemble(docs(s, d)), _actual(s, d), ("lang",)))

_ALIASES = "(SELECT * FROM (VALUES " + ", ".join(f"({i}, '{a}', '{x}')" for i, (a, x) in enumerate(fixed.domain_aliases())) + ") t(ord, alias, domain))"


@query("WITH " + ", ".join(tokens.DUCK[n] for n in ("src", "tok")) + ", names AS (SELECT DISTINCT w AS name FROM tok UNION SELECT w || ' ' || w2 FROM tok WHERE pos = 0 AND w2 IS NOT NULL)" + evaluation.NAMED_SQL.replace("{names}", "names").replace("{aliases}", _ALIASES))
def domains_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus' words, and the first two of each document, taken as names of domains."""
    t = tokens.tok(docs(spark, sf_dir))
    names = t.select(F.explode(F.array("w", F.when((F.col("pos") == 0) & F.col("w2").isNotNull(), F.concat_ws(" ", "w", "w2")))).alias("name")).where("name is not null").distinct()
    return names.select("name", evaluation.domain_named(F.col("name")).alias("domain"))


@query("""
    WITH e AS (SELECT value, 200 + 100 * (CAST(json_extract(props, '$.k') AS INTEGER) % 4) AS status FROM events)
    SELECT CASE WHEN status < 400 THEN 'info' WHEN status < 500 THEN 'warning' ELSE 'error' END AS level, count(*) AS n, round(avg(value), 6) AS mean_duration FROM e GROUP BY 1""")
def request_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests: 200 to 500 by props.k stands for the status."""
    status = (200 + 100 * (F.get_json_object("props", "$.k").cast("int") % 4)).alias("status")
    r = table(spark, sf_dir, "events").select("ts", F.lit("POST").alias("method"), F.col("event_type").alias("path"), status, F.col("value").alias("duration"), "value")
    return r.groupBy(events.severity(F.col("status")).alias("level")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_duration"))
