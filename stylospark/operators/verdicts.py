"""Thresholds, ensemble, verdict, attribution and highlights over metric rows.

Plain SQL over named tables, as in metrics.py. Configuration tables are joined by
their key; they have 16 to 96 rows, which Spark's own size check broadcasts."""

from __future__ import annotations

import re

from . import language_metrics as lm
from . import metrics as m

METRIC_TEXTS = {"structural": m.STRUCTURAL, "perplexity": m.PERPLEXITY, "entropy": m.ENTROPY, "semantic_analysis": lm.SEMANTIC, "linguistic": lm.LINGUISTIC, "multi_perturbation_stability": lm.STABILITY}

#: doc_id, metric, raw, confidence, mixed, error of all six metrics.
RAW = "\nUNION ALL ".join(f"SELECT doc_id, '{name}' AS metric, raw, confidence, mixed, error FROM ({text}) m_{name}" for name, text in METRIC_TEXTS.items())

#: Probabilities by the domain's thresholds (general where a domain has none); errors give (0.5, 0.5, 0) with confidence 0.1.
PROBABILITIES = """
SELECT doc_id, metric, domain, weight, ensemble_threshold, ROUND(ai / total, 6) AS ai, ROUND(human / total, 6) AS human, ROUND(mixed / total, 6) AS mixed, confidence, error FROM (
  SELECT doc_id, metric, domain, weight, ensemble_threshold, ai, 1 - ai AS human, mixed, 1 + mixed AS total, confidence, error FROM (
    SELECT r.doc_id, r.metric, d.domain, t.weight, g.ensemble_threshold, r.error, CASE WHEN r.error IS NULL THEN r.mixed ELSE 0.0 END AS mixed, CASE WHEN r.error IS NULL THEN r.confidence ELSE 0.1 END AS confidence,
      greatest(0.0, least(1.0, CASE WHEN r.error IS NOT NULL THEN 0.5 WHEN r.raw >= t.ai_thr THEN 0.7 + (r.raw - t.ai_thr) * 0.3 WHEN r.raw <= t.human_thr THEN 0.3 - (t.human_thr - r.raw) * 0.3
        WHEN t.ai_thr > t.human_thr THEN 0.3 + (r.raw - t.human_thr) / (t.ai_thr - t.human_thr) * 0.4 ELSE 0.5 END)) AS ai
    FROM {raw} r JOIN {doc_domain} d ON d.doc_id = r.doc_id
    JOIN {thresholds} t ON t.domain = d.domain AND t.metric = r.metric JOIN {domain_cfg} g ON g.domain = d.domain) a) b
"""

#: Weight of each valid metric by each method: w is normalised within the document and method.
_METHODS = {
    "confidence_calibrated": "weight / (1.0 + EXP(-10 * (confidence - 0.5)))",
    "domain_adaptive": "weight * factor",
    "consensus_based": "weight * (0.5 + 0.5 * (1 - ABS(ai - mean_ai)))",
    "domain_weighted": "weight",
    "confidence_weighted": "confidence",
    "simple_average": "1.0",
}
METHODS = """
WITH v AS (SELECT p.*, f.factor, AVG(p.ai) OVER (PARTITION BY p.doc_id) AS mean_ai, COUNT(*) OVER (PARTITION BY p.doc_id) AS valid FROM {prob} p JOIN {performance} f ON f.domain = p.domain AND f.metric = p.metric WHERE p.error IS NULL),
x AS (@UNION),
s AS (SELECT doc_id, method, SUM(w) AS sw, SUM(w * ai) AS sa, SUM(w * human) AS sh, SUM(w * mixed) AS sm FROM x WHERE valid >= 3 GROUP BY doc_id, method)
SELECT doc_id, method, ROUND(CASE WHEN sw > 0 THEN sa / (sa + sh + sm) ELSE 0.5 END + 1.0E-9, 6) AS ai, ROUND(CASE WHEN sw > 0 THEN sh / (sa + sh + sm) ELSE 0.5 END + 1.0E-9, 6) AS human, ROUND(CASE WHEN sw > 0 THEN sm / (sa + sh + sm) ELSE 0.0 END + 1.0E-9, 6) AS mixed FROM s
""".replace("@UNION", " UNION ALL ".join(
    f"SELECT doc_id, valid, '{k}' AS method, {w} AS w, " + ("ai / (1 + mixed) AS ai, (1 - ai) / (1 + mixed) AS human, mixed / (1 + mixed) AS mixed" if k == "confidence_calibrated" else "ai, human, mixed") + " FROM v" for k, w in _METHODS.items()
))

#: The verdict of each document by the confidence-calibrated ensemble.
ENSEMBLE = """
WITH v AS (SELECT *, weight / (1.0 + EXP(-10 * (confidence - 0.5))) AS w FROM {prob} WHERE error IS NULL),
s AS (SELECT doc_id, MAX(domain) AS domain, MAX(ensemble_threshold) AS thr, COUNT(*) AS n, SUM(w) AS sw, SUM(w * ai / (1 + mixed)) AS sa, SUM(w * (1 - ai) / (1 + mixed)) AS sh, SUM(w * mixed / (1 + mixed)) AS sm,
  SUM(w * confidence) AS sc, STDDEV_POP(ai) AS sd, VAR_POP(ai) AS va, AVG(confidence) AS mc, SUM(CASE WHEN confidence > 0.7 THEN 1 ELSE 0 END) AS hi FROM v GROUP BY doc_id),
e AS (SELECT d.doc_id, COALESCE(s.domain, 'general') AS domain, COALESCE(thr, 0.4) AS thr, COALESCE(n, 0) AS n, CASE WHEN n >= 3 THEN sa / (sa + sh + sm) ELSE 0.5 END AS ai, CASE WHEN n >= 3 THEN sh / (sa + sh + sm) ELSE 0.5 END AS human,
  CASE WHEN n >= 3 THEN sm / (sa + sh + sm) ELSE 0.0 END AS mixed, sc / sw AS bc, sd, va, mc, hi * 1.0 / n AS q FROM {doc} d LEFT JOIN s ON s.doc_id = d.doc_id),
u AS (SELECT *, CASE WHEN n >= 3 THEN greatest(0.0, least(1.0, 0.4 * bc + 0.3 * (1 - least(1.0, 2 * sd)) + 0.2 * (1 - 2 * ABS(ai - 0.5)) + 0.1 * q)) ELSE 0.0 END AS conf,
  CASE WHEN n >= 3 THEN greatest(0.0, least(1.0, 0.4 * va + 0.3 * (1 - mc) + 0.3 * (1 - 2 * ABS(ai - 0.5)))) ELSE 1.0 END AS unc, CASE WHEN n >= 3 THEN 1 - least(1.0, 2 * sd) ELSE 0.0 END AS cons FROM e)
SELECT doc_id, domain, CAST(n AS BIGINT) AS valid_metrics, ROUND(ai, 6) AS ai_probability, ROUND(human, 6) AS human_probability, ROUND(mixed, 6) AS mixed_probability, ROUND(conf, 6) AS overall_confidence, ROUND(unc, 6) AS uncertainty, ROUND(cons, 6) AS consensus,
  CASE WHEN n < 3 THEN 'Uncertain' WHEN mixed > 0.25 OR (unc > 0.6 AND ai > 0.3 AND ai < 0.7) THEN 'Mixed (AI + Human)' WHEN ai >= thr + 0.1 * unc THEN 'AI-Generated' WHEN ai <= 1 - (thr + 0.1 * unc) THEN 'Human-Written' ELSE 'Uncertain' END AS verdict,
  CASE WHEN ai > 0.9 OR ai < 0.1 THEN 'Very High' WHEN ai > 0.8 OR ai < 0.2 THEN 'High' WHEN ai > 0.7 OR ai < 0.3 THEN 'Moderate' ELSE 'Low' END AS confidence_label
FROM u
"""

#: One row per metric and document: weight, contribution class, share and rank in the verdict.
CONTRIBUTIONS = """
SELECT doc_id, metric, ROUND(w, 6) AS weight, ROUND(w * ai, 6) AS weighted_score, CASE WHEN w > 0.15 THEN 'High' WHEN w > 0.08 THEN 'Medium' ELSE 'Low' END AS contribution,
  CASE WHEN ai * 100 >= 60 THEN 'AI' WHEN ai * 100 <= 40 THEN 'HUMAN' ELSE 'MIXED' END AS metric_verdict, CAST(ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY ROUND(w, 6) DESC, metric) AS BIGINT) AS rank
FROM (SELECT doc_id, metric, ai, CASE WHEN error IS NULL THEN x / SUM(CASE WHEN error IS NULL THEN x ELSE 0.0 END) OVER (PARTITION BY doc_id) ELSE 0.0 END AS w
  FROM (SELECT *, weight / (1.0 + EXP(-10 * (confidence - 0.5))) AS x FROM {prob}) a) b
"""

#: For DuckDB: sentences with the metrics' probabilities adjusted to them, combined, and adjusted to the domain. Those of
#: one or two words take the first usable metric's; a blank text has a row that says so.
HIGHLIGHTS = """
WITH z0 AS (SELECT doc_id, text, @SMART AS t FROM src),
z1 AS (SELECT doc_id, text, list_filter(list_filter(list_transform(string_split(regexp_replace(regexp_replace(t, '[.!?]+(\\s+[A-Z])', chr(1) || '\\1', 'g'), '[.!?]+(\\r?\\n|\\r)?$', chr(1)), chr(1)), lambda x: regexp_replace(replace(replace(x, '<DOT>', '.'), '<ELLIPSIS>', '...'), '^\\s+|\\s+$', '', 'g')),
  lambda x: len(list_filter(regexp_split_to_array(x, '\\s+'), lambda y: y <> '')) >= 2), lambda x: length(x) >= 3) AS a, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) >= 3) AS b, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS w FROM z0),
z2 AS (SELECT doc_id, CASE WHEN len(a) > 0 THEN a WHEN len(b) > 0 THEN b WHEN w <> '' THEN [w] ELSE ['No text content'] END AS ss, len(a) = 0 AND len(b) = 0 AND w = '' AS blank FROM z1),
z3 AS (SELECT doc_id, blank, unnest(range(len(ss))) AS idx, unnest(ss) AS s FROM z2),
z4 AS (SELECT doc_id, blank, idx, s, LOWER(s) AS l, list_filter(regexp_split_to_array(s, '\\s+'), lambda x: x <> '') AS w, list_sort(list_filter(regexp_split_to_array(LOWER(s), '\\s+'), lambda x: length(x) > 3)) AS lw FROM z3),
z5 AS (SELECT z.doc_id, z.blank, z.idx, z.s, z.l, CASE WHEN blank THEN 0 ELSE len(w) END AS n, len(list_distinct(w)) AS kinds, len(w) >= 6 AND len(list_filter(range(1, len(lw) - 1), lambda i: lw[i] = lw[i + 2])) > 0 AS again, d.domain FROM z4 z JOIN {doc_domain} d ON d.doc_id = z.doc_id),
s AS (SELECT *, CASE WHEN n < 5 THEN 0.2 ELSE least(1.0, CASE WHEN n > 15 THEN 0.3 ELSE 0.0 END + least(0.5, 0.1 * (@INDICATORS)) + least(0.2, 0.05 * (@CLAUSES))) END AS complexity, @FACTOR AS factor FROM z5),
a AS (
  SELECT s.doc_id, s.idx, p.metric, p.weight, greatest(0.1, p.confidence * 0.8 * greatest(0.3, least(1.0, s.n / 12.0))) AS c,
    greatest(0.0, least(1.0, p.ai * CASE
      WHEN p.metric = 'perplexity' THEN CASE WHEN s.n < 8 THEN 1.2 WHEN s.n > 25 THEN 0.8 ELSE 1.0 END
      WHEN p.metric = 'entropy' THEN CASE WHEN s.n > 3 AND s.kinds < 0.6 * s.n THEN 1.2 WHEN s.n > 3 AND s.kinds > 0.8 * s.n THEN 0.8 ELSE 1.0 END
      WHEN p.metric = 'linguistic' THEN CASE WHEN s.complexity < 0.3 THEN 1.1 WHEN s.complexity > 0.7 THEN 0.9 ELSE 1.0 END
      WHEN p.metric = 'structural' THEN CASE WHEN s.n < 5 OR s.n > 40 THEN 0.8 WHEN s.n BETWEEN 8 AND 20 THEN 1.1 ELSE 1.0 END
      WHEN p.metric = 'semantic_analysis' THEN CASE WHEN s.again THEN 1.2 ELSE 1.0 END
      WHEN p.metric = 'multi_perturbation_stability' THEN CASE WHEN s.n > 15 THEN 1.1 ELSE 1.0 END ELSE 1.0 END)) AS ai
  FROM s JOIN {prob} p ON p.doc_id = s.doc_id WHERE p.error IS NULL AND s.n >= 3),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, idx ORDER BY @METRIC) AS r FROM a),
e AS (SELECT doc_id, idx, SUM(weight * ai / (1.0 + EXP(-10 * (c - 0.5)))) / SUM(weight / (1.0 + EXP(-10 * (c - 0.5)))) AS ai, AVG(c) AS confidence, string_agg(chr(10) || metric || ': ' || printf('%.1f%%', FLOOR(ai * 1000.0 + 0.5) / 10.0), '' ORDER BY r) FILTER (r <= 4) AS top FROM r GROUP BY doc_id, idx),
f AS (SELECT doc_id, MIN_BY(ai, @ORDER) AS ai FROM {prob} WHERE error IS NULL AND weight > 0 GROUP BY doc_id),
g AS (SELECT s.*, COALESCE(e.ai, CASE WHEN s.n BETWEEN 1 AND 2 THEN COALESCE(f.ai, 0.5) ELSE 0.5 END) AS ai0, COALESCE(e.confidence, CASE WHEN s.n = 0 THEN 0.3 WHEN s.n < 3 THEN 0.2 ELSE 0.5 END) AS confidence, COALESCE(e.top, '') AS top FROM s LEFT JOIN e ON e.doc_id = s.doc_id AND e.idx = s.idx LEFT JOIN f ON f.doc_id = s.doc_id),
h AS (SELECT *, ROUND(CASE WHEN blank THEN ai0 ELSE greatest(0.0, least(1.0, greatest(ai0 - 0.3, least(ai0 + 0.3, ai0 * factor)))) END, 6) AS r FROM g)
SELECT doc_id, CAST(idx AS BIGINT) AS idx, CAST(n AS BIGINT) AS n_words, s AS sentence, r AS ai_probability, ROUND(confidence, 6) AS confidence, CASE @COLOURS END AS colour,
  'AI Probability: ' || printf('%.1f%%', FLOOR(r * 1000.0 + 0.5) / 10.0) || chr(10) || 'Confidence: ' || printf('%.1f%%', FLOOR(ROUND(confidence, 6) * 1000.0 + 0.5) / 10.0) || chr(10) || 'Domain: ' || domain || chr(10) || 'Length: ' || n || ' words' || top AS tooltip FROM h
"""

# What makes a sentence complex, and what parts its clauses.
_INDICATORS = "although because while when if since unless until which that who whom whose and but or yet so however therefore moreover furthermore nevertheless , ; : —".split()
_CLAUSES = ", ; and but or because although".split()
_HIT = lambda words: " + ".join(f"CASE WHEN INSTR(LOWER(s), '{w}') > 0 THEN 1 ELSE 0 END" for w in words)


def smart_sql(t: str) -> str:
    """A text with the periods of abbreviations, decimals and ellipses marked, for DuckDB."""
    from ..functions.fixed import ABBREVIATIONS

    for x in sorted(ABBREVIATIONS):
        t = f"regexp_replace({t}, '(?i)(^|[^\\p{{L}}\\p{{N}}_]){re.escape(x)}\\.', '\\1{x.replace('.', '<DOT>')}', 'g')"
    return f"replace(regexp_replace({t}, '(\\d+)\\.(\\d+)', '\\1<DOT>\\2', 'g'), '...', '<ELLIPSIS>')"


def _factor_sql() -> str:
    from ..functions.fixed import SENTENCE_RULES, SIGNS

    def holds(sign) -> str:
        if isinstance(sign, tuple):
            return f"n >= {sign[0]}" + (f" AND n <= {sign[1]}" if sign[1] is not None else "")
        if sign == "repetition":
            return "again"
        found = " OR ".join(f"contains({'s' if sign == 'code' else 'l'}, '{w}')" for w in SIGNS[sign])
        return f"({found})" + (" AND n >= 8" if sign == "complex" else "")

    return "CASE " + " ".join(f"WHEN domain IN ({', '.join(repr(d) for d in names.split())}) THEN CASE " + " ".join(f"WHEN {holds(sign)} THEN {f}" for sign, f in rules) + " ELSE 1.0 END" for names, rules in SENTENCE_RULES) + " ELSE 1.0 END"


def _highlights() -> str:
    from ..functions.fixed import COLOURS, METRICS

    colours = " ".join(f"WHEN r < {hi} THEN '{name}'" for hi, name, _ in COLOURS)
    by = lambda names: "CASE metric " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(names)) + " END"
    order = by(("structural", "entropy", "perplexity", "semantic_analysis", "linguistic", "multi_perturbation_stability"))
    return HIGHLIGHTS.replace("@ORDER", order).replace("@METRIC", by(METRICS)).replace("@SMART", smart_sql("text")).replace("@FACTOR", _factor_sql()).replace("@INDICATORS", _HIT(_INDICATORS)).replace("@CLAUSES", _HIT(_CLAUSES)).replace("@COLOURS", colours)


HIGHLIGHTS = _highlights()


def risk_sql() -> str:
    """Risk of a document: mean AI probability times the weight of its colour."""
    from ..functions.fixed import COLOURS

    w = " ".join(f"WHEN colour = '{name}' THEN {risk}" for _, name, risk in COLOURS)
    return f"""SELECT doc_id, CAST(COUNT(*) AS BIGINT) AS n_sentences, ROUND(AVG(ai_probability * CASE {w} END) + 1.0E-9, 6) AS risk, ROUND(AVG(ai_probability) + 1.0E-9, 6) AS mean_ai,
      CAST(SUM(CASE WHEN ai_probability >= 0.6 THEN 1 ELSE 0 END) AS BIGINT) AS ai_sentences, CAST(SUM(CASE WHEN ai_probability <= 0.4 THEN 1 ELSE 0 END) AS BIGINT) AS human_sentences FROM {{marks}} GROUP BY doc_id"""


# Sentence lengths and punctuation frequencies of seven generators (em dash, semicolon, colon, comma per word; question, exclamation per sentence).
RANGES = """
gpt-3.5-turbo  18 25  em 0.01 0.03  semicolon 0.005 0.015
gpt-4          20 28  em 0.02 0.05  colon 0.01 0.03  semicolon 0.01 0.02
claude-3-opus  17 24  em 0.015 0.04  colon 0.008 0.025
gemini-pro     15 22  exclaim 0.01 0.03  question 0.02 0.05
llama-3        16 23  comma 0.08 0.15
deepseek-chat  14 21  comma 0.07 0.14  question 0.01 0.04
mixtral        19 26  semicolon 0.008 0.02  colon 0.006 0.018
"""
# All generators that can be named.
MODELS = "gpt-3.5-turbo gpt-4 gpt-4-turbo gpt-4o claude-3-opus claude-3-sonnet claude-3-haiku gemini-pro gemini-ultra gemini-flash llama-2 llama-3 mistral mixtral deepseek-chat deepseek-coder".split()


def ranges_values() -> list[tuple]:
    out = []
    for line in filter(None, RANGES.split("\n")):
        name, lo, hi, *rest = line.split()
        out.append((name, "len", float(lo), float(hi), 0.25))
        out += [(name, rest[i], float(rest[i + 1]), float(rest[i + 2]), 0.08) for i in range(0, len(rest), 3)]
    return out


def _rows(rows: list[tuple], cols: str) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else f"{v!r}"
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") t({cols}))"


# What the metrics' features add to a generator's score: condition, strength and metric of each rule, and the metrics' weights.
RULES = {
    "gpt-4": [("overall_perplexity < 25", 0.6, "perplexity"), ("coherence_score > 0.8", 0.7, "semantic"), ("token_diversity > 0.7", 0.5, "entropy"), ("syntactic_complexity > 3.0", 0.4, "linguistic")],
    "gpt-4-turbo": [("overall_perplexity < 25", 0.5, "perplexity"), ("coherence_score > 0.8", 0.6, "semantic")],
    "gpt-3.5-turbo": [("overall_perplexity >= 25 AND overall_perplexity < 35", 0.4, "perplexity")],
    "gemini-pro": [("overall_perplexity >= 25 AND overall_perplexity < 35", 0.3, "perplexity")],
    "claude-3-opus": [("length_uniformity > 0.7", 0.5, "structural"), ("token_diversity > 0.7", 0.6, "entropy"), ("syntactic_complexity > 3.0", 0.5, "linguistic")],
    "claude-3-sonnet": [("length_uniformity > 0.7", 0.4, "structural")],
    "mixtral": [("stability_score BETWEEN 0.4 AND 0.6", 0.4, "stability")],
    "llama-3": [("stability_score BETWEEN 0.4 AND 0.6", 0.3, "stability")],
}
RULE_WEIGHTS = {"perplexity": 0.25, "structural": 0.15, "semantic": 0.15, "entropy": 0.2, "linguistic": 0.15, "stability": 0.1}
_RULED = "CASE m.model " + " ".join(f"WHEN '{k}' THEN " + " + ".join(f"CASE WHEN {c} THEN {g * RULE_WEIGHTS[by]!r} * {'1.0' if by == 'stability' else 'wt.' + by} ELSE 0.0 END" for c, g, by in v) for k, v in RULES.items()) + " ELSE 0.0 END"
#: Features that the rules read; where the metric failed, what stands for them.
_SIGNALS = [("perplexity", "overall_perplexity", 50.0, m.PERPLEXITY_FEATURES), ("semantic", "coherence_score", 0.5, lm.SEMANTIC_FEATURES), ("entropy", "token_diversity", 0.5, m.ENTROPY_FEATURES), ("linguistic", "syntactic_complexity", 2.5, lm.LINGUISTIC_FEATURES), ("stability", "stability_score", 0.5, lm.STABILITY_FEATURES)]
SIGNALS = (
    "SELECT st.doc_id, st.length_uniformity, " + ", ".join(f"CASE WHEN f_{n}.n_chars < 50 THEN {default} ELSE f_{n}.{col} END AS {col}" for n, col, default, _ in _SIGNALS)
    + f" FROM ({m.STRUCTURAL_FEATURES}) st " + " ".join(f"JOIN ({text}) f_{n} ON f_{n}.doc_id = st.doc_id" for n, _, _, text in _SIGNALS)
)

_TITLE = lambda x: x.replace("-", " ").replace("_", " ").title()
_PERCENT = lambda c: f"printf('%.1f%%', FLOOR(({c}) * 1000.0 + 0.5) / 10.0)"
#: For DuckDB: style, rules, phrases and prediction of the likeliest generator, over tables of pairs.
ATTRIBUTION = f"""
WITH s AS (SELECT doc_id, COUNT(*) AS ns FROM {{sen}} GROUP BY doc_id), w AS (SELECT doc_id, COUNT(*) AS nw FROM {{spaced}} GROUP BY doc_id),
marks AS (SELECT doc_id, text, {", ".join(f"LENGTH(text) - LENGTH(REPLACE(text, '{c}', '')) AS {k}" for k, c in (("em", "—"), ("semicolon", ";"), ("colon", ":"), ("comma", ","), ("question", "?"), ("exclaim", "!")))} FROM src),
o AS (SELECT w.doc_id, w.nw * 1.0 / s.ns AS len, {", ".join(f"k.{k} * 1.0 / {'s.ns' if k in ('question', 'exclaim') else 'w.nw'} AS {k}" for k in ("em", "semicolon", "colon", "comma", "question", "exclaim"))} FROM w JOIN s ON s.doc_id = w.doc_id JOIN marks k ON k.doc_id = w.doc_id),
dw AS (SELECT d.doc_id, x.* FROM {{doc_domain}} d JOIN {{attribution}} x ON x.domain = d.domain),
feats AS ({" UNION ALL ".join(f"SELECT doc_id, '{k}' AS feature, {k} AS x FROM o" for k in ("len", "em", "semicolon", "colon", "comma", "question", "exclaim"))}),
st AS (SELECT f.doc_id, r.model, SUM(r.gain) AS gain FROM feats f JOIN dw ON dw.doc_id = f.doc_id JOIN {_rows(ranges_values(), "model, feature, lo, hi, gain")} r ON r.feature = f.feature AND f.x BETWEEN r.lo * CASE WHEN f.feature = 'len' THEN dw.lengths ELSE 1.0 END AND r.hi * CASE WHEN f.feature = 'len' THEN dw.lengths ELSE 1.0 END GROUP BY f.doc_id, r.model),
pc AS (SELECT doc_id, idx, trim(p, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS p FROM (SELECT doc_id, unnest(range(len(x))) AS idx, unnest(x) AS p FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[.!?]+') AS x FROM src))),
np AS (SELECT doc_id, COUNT(*) AS np FROM pc GROUP BY doc_id),
fp AS (
  SELECT c.doc_id, c.model, least(1.0, SUM(c.hit) / ((MAX(k.checks) + CASE WHEN MAX(k.starters) > 0 THEN MAX(np.np) ELSE 0 END) * 0.5)) AS score FROM (
    SELECT d.doc_id, p.model, CASE WHEN p.kind = 'phrase' THEN 3 ELSE 2 END * 1.0 AS hit FROM src d JOIN {{fingerprints}} p ON p.kind <> 'starter' AND contains(lower(d.text), p.phrase)
    UNION ALL SELECT doc_id, model, 2.0 FROM (SELECT DISTINCT x.doc_id, x.idx, p.model FROM pc x JOIN {{fingerprints}} p ON p.kind = 'starter' AND starts_with(x.p, p.phrase)) q) c
  JOIN (SELECT model, SUM(CASE WHEN kind <> 'starter' THEN 1 ELSE 0 END) AS checks, SUM(CASE WHEN kind = 'starter' THEN 1 ELSE 0 END) AS starters FROM {{fingerprints}} GROUP BY model) k ON k.model = c.model JOIN np ON np.doc_id = c.doc_id GROUP BY c.doc_id, c.model),
every AS (SELECT d.doc_id, m.model, m.title, wt.domain, least(1.0, COALESCE(fp.score, 0.0) * wt.sensitivity) AS f, ROUND(wt.by_phrase * least(1.0, COALESCE(fp.score, 0.0) * wt.sensitivity) + wt.by_style * least(1.0, 0.3 + COALESCE(st.gain, 0.0)) + wt.by_rule * least(1.0, {_RULED}), 9) AS x
  FROM {{doc}} d JOIN dw wt ON wt.doc_id = d.doc_id JOIN ({SIGNALS}) g ON g.doc_id = d.doc_id CROSS JOIN {_rows([(x, _TITLE(x)) for x in MODELS], "model, title")} m
  LEFT JOIN st ON st.doc_id = d.doc_id AND st.model = m.model LEFT JOIN fp ON fp.doc_id = d.doc_id AND fp.model = m.model),
sh AS (SELECT doc_id, domain, model, title, f, ROUND(x / SUM(x) OVER (PARTITION BY doc_id) + 1.0E-9, 6) AS p FROM every),
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY p DESC, model) AS r, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY CASE WHEN f > 0.1 THEN FLOOR(f * 100 + 1.0E-9) ELSE -1.0 END DESC, model) AS fr FROM sh),
ag AS (SELECT doc_id, max(domain) AS domain, max(CASE WHEN r = 1 THEN model END) AS model, max(CASE WHEN r = 1 THEN title END) AS title, max(CASE WHEN r = 1 THEN p END) AS p, max(CASE WHEN r = 2 THEN p END) AS q,
  coalesce(string_agg(model || '=' || CAST(CAST(FLOOR(f * 100 + 1.0E-9) AS BIGINT) AS VARCHAR), ' ' ORDER BY fr) FILTER (f > 0.1 AND fr <= 5), '') AS fingerprints, string_agg('- ' || title || ': ' || {_PERCENT("p")}, chr(10) ORDER BY r) FILTER (r <= 6 AND p >= 0.01) AS shares FROM rk GROUP BY doc_id),
cf AS (SELECT *, ROUND(greatest(0.05, least(1.0, 0.8 * p + 1.5 * (p - q))), 6) AS confidence, list_aggregate(list_transform(string_split(domain, '_'), lambda x: upper(x[1]) || x[2:]), 'string_agg', ' ') AS named FROM ag)
SELECT doc_id, CASE WHEN p < 0.01 THEN 'unknown' ELSE model END AS model, p AS probability, confidence, fingerprints,
  concat_ws(chr(10), CASE WHEN p >= 0.01 THEN 'Predicted Model: ' || title || chr(10) || 'Confidence: ' || {_PERCENT("confidence")} ELSE 'Most Likely: Unable to determine with high confidence' END, 'Domain: ' || named, shares,
    CASE WHEN confidence < 0.3 THEN '- Low confidence attribution - text patterns are ambiguous' || chr(10) || '- May be human-written or from multiple AI sources' ELSE '- Calibrated for ' || replace(domain, '_', ' ') || ' domain' END) AS reasoning
FROM cf
"""

#: Language by the script where that tells it, else by function words of Latin script: at least three, ties by the list's order.
LANGUAGE = """
SELECT d.doc_id, CASE c.script @SCRIPTS ELSE COALESCE(b.lang, 'en') END AS language, CAST(COALESCE(b.c, 0) AS BIGINT) AS matches FROM {doc} d JOIN {script} c ON c.doc_id = d.doc_id LEFT JOIN (
  SELECT doc_id, lang, c FROM (SELECT doc_id, lang, c, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY c DESC, ord) AS r FROM (
    SELECT w.doc_id, t.lang, t.ord, COUNT(DISTINCT t.word) AS c FROM (SELECT DISTINCT doc_id, LOWER(w) AS w FROM {spaced}) w JOIN {stopwords} t ON t.word = w.w GROUP BY w.doc_id, t.lang, t.ord) q) p WHERE r = 1 AND c > 2) b ON b.doc_id = d.doc_id
"""


def _language() -> str:
    from ..functions.fixed import SCRIPTS

    return LANGUAGE.replace("@SCRIPTS", " ".join(f"WHEN '{name}' THEN '{lang}'" for name, (_, lang) in SCRIPTS.items() if lang))


LANGUAGE = _language()

#: Agreement of verdicts with labels (quality 0 stands for generated): counts and rates by language, with a total.
EVALUATION = """
SELECT COALESCE(lang, 'all') AS lang, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(tp) AS BIGINT) AS tp, CAST(SUM(fp) AS BIGINT) AS fp, CAST(SUM(fn) AS BIGINT) AS fn, CAST(SUM(tn) AS BIGINT) AS tn,
  ROUND((SUM(tp) + SUM(tn)) * 1.0 / COUNT(*), 6) AS accuracy, ROUND(CASE WHEN SUM(tp) + SUM(fp) > 0 THEN SUM(tp) * 1.0 / (SUM(tp) + SUM(fp)) END, 6) AS prec, ROUND(CASE WHEN SUM(tp) + SUM(fn) > 0 THEN SUM(tp) * 1.0 / (SUM(tp) + SUM(fn)) END, 6) AS recall
FROM (SELECT s.lang, CASE WHEN e.verdict = 'AI-Generated' AND l.quality = 0 THEN 1 ELSE 0 END AS tp, CASE WHEN e.verdict = 'AI-Generated' AND l.quality = 1 THEN 1 ELSE 0 END AS fp,
    CASE WHEN e.verdict <> 'AI-Generated' AND l.quality = 0 THEN 1 ELSE 0 END AS fn, CASE WHEN e.verdict <> 'AI-Generated' AND l.quality = 1 THEN 1 ELSE 0 END AS tn
  FROM {ens} e JOIN {labels} l ON l.doc_id = e.doc_id JOIN {documents} s ON s.doc_id = e.doc_id) q GROUP BY ROLLUP (lang)
"""
assert not re.search(r"@[A-Z]+", METHODS + HIGHLIGHTS)
