"""Corpus-level operators over documents, metric rows and verdicts, as SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fixed import METRICS
from . import metrics as m

#: Bigram model of the corpus: counts and context totals.
LM_BIGRAM = "SELECT w AS w1, w2, CAST(COUNT(*) AS BIGINT) AS c, CAST(SUM(COUNT(*)) OVER (PARTITION BY w) AS BIGINT) AS ctx FROM {tok} WHERE w2 IS NOT NULL GROUP BY w, w2"
LM_UNIGRAM = "SELECT w, CAST(COUNT(*) AS BIGINT) AS c FROM {tok} GROUP BY w"

#: Chunks of 200 words, each 100 after the one before: words and distinct words.
OVERLAPPING = """
WITH b AS (SELECT doc_id, CAST(FLOOR(pos / 100) AS BIGINT) AS b, LOWER(w) AS w FROM {spaced}),
live AS (SELECT DISTINCT doc_id, b FROM b),
u AS (SELECT doc_id, b AS chunk, w FROM b UNION ALL SELECT doc_id, b - 1, w FROM b WHERE b > 0)
SELECT u.doc_id, u.chunk, CAST(COUNT(*) AS BIGINT) AS n_words, CAST(COUNT(DISTINCT u.w) AS BIGINT) AS distinct_words FROM u JOIN live l ON l.doc_id = u.doc_id AND l.b = u.chunk GROUP BY u.doc_id, u.chunk
"""

#: Domain by words of its labels (a table of domain, term): share of hits per domain, the two best, and the
#: confidence rules; general with 0.5 where nothing matches.
DOMAIN = """
WITH hit AS (SELECT k.doc_id, t.domain, COUNT(*) AS c FROM {tok} k JOIN {domain_terms} t ON t.term = k.w GROUP BY k.doc_id, t.domain),
sc AS (SELECT doc_id, domain, c * 1.0 / SUM(c) OVER (PARTITION BY doc_id) AS score FROM hit),
rk AS (SELECT doc_id, domain, score, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY score DESC, domain) AS r FROM sc)
SELECT d.doc_id, COALESCE(a.domain, 'general') AS domain, CASE WHEN b.score >= 0.1 THEN b.domain END AS secondary,
  ROUND(CASE WHEN a.doc_id IS NULL THEN 0.5 WHEN b.score >= 0.1 AND a.score - b.score < 0.15 THEN (a.score + b.score) / 2 * 0.8 WHEN a.score < 0.6 THEN a.score * 0.8 ELSE a.score END, 6) AS confidence
FROM {doc} d LEFT JOIN rk a ON a.doc_id = d.doc_id AND a.r = 1 LEFT JOIN rk b ON b.doc_id = d.doc_id AND b.r = 2
"""
#: How many of a domain's words learn_terms keeps, and in how many documents a word must be.
TERMS, AT_LEAST = 200, 3


def learn_terms(labelled: DataFrame, most: int = TERMS, least: int = AT_LEAST) -> DataFrame:
    """domain, term from documents of known domains (text, domain): the words whose
    share of a domain's documents exceeds by most, in logarithms, that of all
    documents, ties by the word. Each document counts a word once; a word belongs to
    the one domain that it tells most about."""
    own = labelled.where("domain is not null").select("domain", F.array_distinct(T.lower_words(F.coalesce("text", F.lit("")))).alias("ws"))
    size = own.groupBy("domain").agg(F.count("*").alias("size"))
    total = own.agg(F.count("*").alias("total"))
    counts = own.select("domain", F.explode("ws").alias("term")).groupBy("domain", "term").agg(F.count("*").alias("c"))
    every = counts.groupBy("term").agg(F.sum("c").alias("every")).where(F.col("every") >= least)
    # the domains and their sizes are as few as the labels
    scored = counts.join(every, "term").join(F.broadcast(size), "domain").crossJoin(F.broadcast(total))
    gain = F.round(F.col("c") * F.log(F.col("c") * F.col("total") / (F.col("every") * F.col("size"))), 6)
    scored = scored.select("domain", "term", gain.alias("gain")).where("gain > 0")
    best = scored.groupBy("term").agg(F.min(F.struct((-F.col("gain")).alias("gain"), "domain")).alias("x")).select("term", "x.domain", "x.gain")
    rank = F.row_number().over(Window.partitionBy("domain").orderBy("gain", "term"))
    return best.withColumn("rank", rank).where(F.col("rank") <= most).select("domain", "term")


#: The same for DuckDB over a relation {labelled} of text and domain.
TERMS_SQL = rf"""
WITH w AS (SELECT domain, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+'))) AS term FROM {{labelled}}), z AS (SELECT domain, count(*) AS size FROM {{labelled}} GROUP BY domain), t AS (SELECT count(*) AS total FROM {{labelled}}),
c AS (SELECT domain, term, count(*) AS c FROM w GROUP BY domain, term), e AS (SELECT term, sum(c) AS every FROM c GROUP BY term HAVING sum(c) >= {AT_LEAST}),
g AS (SELECT c.domain, c.term, round(c * ln(c * total * 1.0E0 / (every * size)), 6) AS gain FROM c JOIN e ON e.term = c.term JOIN z ON z.domain = c.domain CROSS JOIN t),
b AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY gain DESC, domain) AS own FROM g WHERE gain > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY gain DESC, term) AS rank FROM b WHERE own = 1)
SELECT domain, term FROM r WHERE rank <= {TERMS}"""

#: AI probability of each document without one metric, by the calibrated ensemble, and how verdict shares move.
ABLATION = """
WITH v AS (SELECT p.doc_id, x.metric AS excluded, p.ai, p.mixed, p.weight / (1.0 + EXP(-10 * (p.confidence - 0.5))) AS w FROM {prob} p CROSS JOIN (SELECT * FROM (VALUES ('structural'), ('perplexity'), ('entropy'), ('semantic_analysis'), ('linguistic'), ('multi_perturbation_stability')) t(metric)) x WHERE x.metric <> p.metric AND p.error IS NULL),
e AS (SELECT doc_id, excluded, COUNT(*) AS n, SUM(w * ai / (1 + mixed)) / SUM(w) AS ai FROM v GROUP BY doc_id, excluded)
SELECT excluded, CAST(COUNT(*) AS BIGINT) AS n, ROUND(AVG(ai) + 1.0E-9, 5) AS mean_ai, CAST(SUM(CASE WHEN ROUND(ai, 5) >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS above_half FROM e WHERE n >= 3 GROUP BY excluded
"""

#: Five bins of uncertainty: expected and observed share of right verdicts.
CALIBRATION = """
SELECT bin, CAST(COUNT(*) AS BIGINT) AS n, ROUND(AVG(1 - uncertainty) + 1.0E-9, 5) AS expected, ROUND(AVG(ok) + 1.0E-9, 5) AS observed, ROUND(ABS(AVG(1 - uncertainty) - AVG(ok)) + 1.0E-9, 5) AS error
FROM (SELECT CAST(least(4, FLOOR(e.uncertainty * 5)) AS BIGINT) AS bin, e.uncertainty, CASE WHEN (e.ai_probability >= 0.5) = (l.quality = 0) THEN 1.0 ELSE 0.0 END AS ok FROM {ens} e JOIN {labels} l ON l.doc_id = e.doc_id) q GROUP BY bin
"""

#: Summary line and recommendations of each verdict.
SUMMARY = """
SELECT doc_id, CONCAT('Verdict ', verdict, ' with ', CASE WHEN overall_confidence >= 0.8 THEN 'very high' WHEN overall_confidence >= 0.6 THEN 'high' WHEN overall_confidence >= 0.4 THEN 'moderate' ELSE 'low' END, ' confidence and ',
  CASE WHEN consensus >= 0.8 THEN 'strong' WHEN consensus >= 0.6 THEN 'moderate' ELSE 'low' END, ' consensus in domain ', domain) AS summary,
  CASE WHEN uncertainty > 0.7 THEN 'High uncertainty: review by hand' WHEN verdict = 'Mixed (AI + Human)' THEN 'Check the highlighted sentences' WHEN overall_confidence < 0.5 THEN 'Collect a longer text' ELSE 'None' END AS recommendation,
  CASE WHEN overall_confidence < 0.3 THEN 'very_low' WHEN overall_confidence < 0.5 THEN 'low' WHEN overall_confidence < 0.7 THEN 'medium' WHEN overall_confidence < 0.85 THEN 'high' ELSE 'very_high' END AS confidence_level
FROM {ens}
"""

#: Thresholds of each document: those of its domain, or between its two domains by their scores, or, where the domain is
#: unsure and single, between it and general by confidence.
ADAPTIVE = DOMAIN[: DOMAIN.index("SELECT d.doc_id")].rstrip() + """,
p AS (SELECT d.doc_id, COALESCE(a.domain, 'general') AS d1, CASE WHEN b.score >= 0.1 THEN b.domain END AS d2, a.score AS s1, b.score AS s2,
  CASE WHEN a.doc_id IS NULL THEN 0.5 WHEN a.score < 0.6 THEN a.score * 0.8 ELSE a.score END AS conf
  FROM {doc} d LEFT JOIN rk a ON a.doc_id = d.doc_id AND a.r = 1 LEFT JOIN rk b ON b.doc_id = d.doc_id AND b.r = 2),
w AS (SELECT doc_id, d1, CASE WHEN d2 IS NOT NULL THEN d2 WHEN conf < 0.6 THEN 'general' END AS d2, CASE WHEN d2 IS NOT NULL THEN s1 / (s1 + s2) WHEN conf < 0.6 THEN conf ELSE 1.0 END AS w1 FROM p)
SELECT w.doc_id, a.metric, ROUND(a.ai_thr * w1 + COALESCE(b.ai_thr, 0.0) * (1 - w1) + 1.0E-9, 6) AS ai_thr, ROUND(a.human_thr * w1 + COALESCE(b.human_thr, 0.0) * (1 - w1) + 1.0E-9, 6) AS human_thr, ROUND(a.weight * w1 + COALESCE(b.weight, 0.0) * (1 - w1) + 1.0E-9, 6) AS weight,
  ROUND(g.ensemble_threshold * w1 + COALESCE(h.ensemble_threshold, 0.0) * (1 - w1) + 1.0E-9, 6) AS ensemble_threshold
FROM w JOIN {thresholds} a ON a.domain = w.d1 JOIN {domain_cfg} g ON g.domain = w.d1 LEFT JOIN {thresholds} b ON b.domain = w.d2 AND b.metric = a.metric LEFT JOIN {domain_cfg} h ON h.domain = w.d2
"""

#: The verdict's threshold by its confidence: raised where that is low, or lowered where it is high.
ADJUSTED = """
SELECT e.doc_id, ROUND(g.ensemble_threshold + (1 - e.overall_confidence) * 0.1 + 1.0E-9, 6) AS conservative, ROUND(g.ensemble_threshold - e.overall_confidence * 0.05 + 1.0E-9, 6) AS liberal
FROM {ens} e JOIN {domain_cfg} g ON g.domain = e.domain
"""

#: What a reader of a verdict should know: language, script, domain and failed metrics, a row each.
WARNINGS = """
SELECT doc_id, 'language' AS source, CONCAT('Non-English text detected (', language, '). Detection accuracy may be reduced.') AS warning FROM {lang} WHERE language <> 'en'
UNION ALL SELECT doc_id, 'script', 'Multilingual content detected' FROM {script} WHERE script = 'mixed'
UNION ALL SELECT doc_id, 'domain', 'Low domain classification confidence' FROM {dom} WHERE confidence < 0.5
UNION ALL SELECT doc_id, metric, CONCAT(metric, ' metric error: ', error) FROM {prob} WHERE error IS NOT NULL
"""

def candidates(units: int) -> list[tuple[int, ...]]:
    """Whole weights of six metrics that sum to `units`."""

    def parts(left: int, n: int):
        if n == 1:
            yield (left,)
            return
        for v in range(left + 1):
            for rest in parts(left - v, n - 1):
                yield (v, *rest)

    return list(parts(units, 6))


def search_weights(judged: DataFrame, labels: DataFrame, units: int = 10) -> DataFrame:
    """The weights (in shares of `units`) with the best F1 of "generated" (quality 0)
    for documents of labels (doc_id, quality), and its counts; ties to the first
    weights in order. A metric that failed has no vote, a document without any
    probability 0.5. One pass: each task adds up the counts of all candidates, of
    which the grid has comb(units + 5, 5), whatever the number of documents."""
    grid = np.array(candidates(units), np.int64)
    rows = judged.join(labels.select("doc_id", (F.col("quality") == 0).alias("y")), "doc_id")
    ai = F.transform("p", lambda x: F.when(x["error"].isNull(), F.round(x["ai"] * 1_000_000).cast("long")))

    def count(batches):
        tp, said, true = np.zeros(len(grid), np.int64), np.zeros(len(grid), np.int64), 0
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                y = part.column(0).to_numpy(zero_copy_only=False).astype(bool)
                p = np.array([[0 if v is None else v for v in r] for r in part.column(1).to_pylist()], np.int64)
                ok = np.array([[v is not None for v in r] for r in part.column(1).to_pylist()], np.int64)
                votes, weight = p @ grid.T, ok @ grid.T
                yes = (2 * votes >= 1_000_000 * weight)  # exact: the mean is one half at least
                tp += yes[y].sum(0)
                said += yes.sum(0)
                true += int(y.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(grid)), pa.int32()), pa.array(tp), pa.array(said), pa.array(np.full(len(grid), true))], names=["k", "tp", "said", "y"])

    sums = rows.select("y", ai.alias("p")).mapInArrow(count, "k int, tp long, said long, y long").groupBy("k").agg(*[F.sum(c).alias(c) for c in ("tp", "said", "y")])
    f1 = F.round(F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("said") + F.col("y")), F.lit(0.0)), 6)
    best = sums.withColumn("f1", f1).orderBy(F.desc("f1"), "k").limit(1)
    table = judged.sparkSession.createDataFrame([(i, w) for i, w in enumerate(grid.tolist())], "k int, w array<int>")
    return best.join(F.broadcast(table), "k").select(*[F.get("w", F.lit(i)).cast("long").alias(n) for i, n in enumerate(METRICS)], "tp", (F.col("said") - F.col("tp")).alias("fp"), (F.col("y") - F.col("tp")).alias("fn"), "f1")


def search_sql(units: int = 10) -> str:
    """The exhaustive search over {prob} and labels for DuckDB."""
    names = [f"g{i}.v AS w{i}" for i in range(1, 6)]
    used = lambda n: " + ".join(f"g{i}.v" for i in range(1, n + 1))
    joins = " ".join(f"JOIN g g{i} ON {used(i)} <= {units}" for i in range(2, 6))
    ai = ", ".join(f"max(CASE WHEN metric = '{m}' AND error IS NULL THEN CAST(round(ai * 1000000) AS BIGINT) END) AS p{i}" for i, m in enumerate(METRICS, 1))
    vote = " + ".join(f"w{i} * coalesce(p{i}, 0)" for i in range(1, 7))
    weight = " + ".join(f"CASE WHEN p{i} IS NULL THEN 0 ELSE w{i} END" for i in range(1, 7))
    order = ", ".join(f"w{i}" for i in range(1, 7))
    return f"""
WITH g AS (SELECT unnest(range({units} + 1)) AS v), c AS (SELECT {", ".join(names)}, {units} - ({used(5)}) AS w6 FROM g g1 {joins}),
d AS (SELECT p.doc_id, max(CASE WHEN l.quality = 0 THEN 1 ELSE 0 END) AS y, {ai} FROM {{prob}} p JOIN {{labels}} l ON l.doc_id = p.doc_id GROUP BY p.doc_id),
s AS (SELECT {order}, sum(y * yes) AS tp, sum(yes) AS said, sum(y) AS y FROM (SELECT c.*, d.y, CASE WHEN 2 * ({vote}) >= 1000000 * ({weight}) THEN 1 ELSE 0 END AS yes FROM c CROSS JOIN d) GROUP BY {order})
SELECT {", ".join(f"w{i} AS {m}" for i, m in enumerate(METRICS, 1))}, CAST(tp AS BIGINT) AS tp, CAST(said - tp AS BIGINT) AS fp, CAST(y - tp AS BIGINT) AS fn, round(coalesce(2.0E0 * tp / nullif(said + y, 0), 0), 6) AS f1 FROM s ORDER BY f1 DESC, {order} LIMIT 1"""


#: Verdicts by language and domain, with subtotals.
BREAKDOWN = """
SELECT COALESCE(s.lang, 'all') AS lang, COALESCE(e.verdict, 'all') AS verdict, CAST(COUNT(*) AS BIGINT) AS n, ROUND(AVG(e.ai_probability) + 1.0E-9, 5) AS mean_ai FROM {ens} e JOIN {documents} s ON s.doc_id = e.doc_id GROUP BY CUBE (s.lang, e.verdict)
"""
assert m.needed(DOMAIN)
