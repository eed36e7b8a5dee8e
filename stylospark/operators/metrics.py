"""Features and scores of the metrics over the token tables, as SQL.

Each text is plain SQL over named tables; Spark runs it on the DataFrames of
tokens.FRAMES. Aggregations are by doc_id and partial on the map side; no
per-document array of counts is built."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from . import tokens


def run(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    """SQL over DataFrames: each name in braces is one of frames."""
    return spark.sql(text, **frames)


def needed(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


def bands(*rules: str) -> list[str]:
    return [f"(CASE {r} END)" for r in rules]


def score(rules: list[str], enough: str = "TRUE") -> str:
    """raw and confidence of banded indicators; (0.5, 0.3) without enough features."""
    n, total, square = len(rules), " + ".join(rules), " + ".join(f"{r} * {r}" for r in rules)
    mean = f"(({total}) / {n})"
    spread = f"sqrt(greatest(0.0, ({square}) / {n} - {mean} * {mean}))"
    return f"ROUND(CASE WHEN {enough} THEN {mean} ELSE 0.5 END, 6) AS raw, ROUND(CASE WHEN {enough} THEN greatest(0.1, least(0.9, 1.0 - {spread} / 0.5)) ELSE 0.3 END, 6) AS confidence"


def positive(*cols: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {c} > 0 THEN 1 ELSE 0 END" for c in cols) + ")"


STRUCTURAL_FEATURES = """
SELECT d.doc_id,
  ROUND(COALESCE(s.mu, 0) + 1.0E-9, 2) AS avg_sentence_length, ROUND(COALESCE(s.sd, 0) + 1.0E-9, 2) AS std_sentence_length,
  ROUND(COALESCE(t.mu, 0) + 1.0E-9, 2) AS avg_word_length, ROUND(COALESCE(t.sd, 0) + 1.0E-9, 2) AS std_word_length,
  CAST(COALESCE(v.vocab, 0) AS BIGINT) AS vocabulary_size, ROUND(COALESCE(v.vocab / t.n, 0), 4) AS type_token_ratio,
  ROUND(CASE WHEN d.n_chars > 0 THEN d.n_punct / d.n_chars ELSE 0 END, 4) AS punctuation_density,
  ROUND(COALESCE(d.n_comma / t.n, 0), 4) AS comma_frequency,
  ROUND(CASE WHEN s.n >= 2 AND s.mu > 0 THEN least(1.0, s.sd / s.mu / 2.0) ELSE 0 END, 4) AS burstiness_score,
  ROUND(CASE WHEN s.mu > 0 THEN greatest(0.0, least(1.0, 1.0 - s.sd / s.mu)) ELSE 0 END, 4) AS length_uniformity,
  ROUND(CASE WHEN s.n > 0 AND t.n > 0 THEN greatest(0.0, least(100.0, 206.835 - 1.015 * (t.n / s.n) - 84.6 * (t.syl / t.n))) ELSE 0 END, 2) AS readability_score,
  ROUND(CASE WHEN t.n > 10 THEN COALESCE(r.rep, 0) / ((t.n - 10) * 10) ELSE 0 END, 4) AS repetition_score,
  ROUND(CASE WHEN t.n >= 2 THEN v.bi / (t.n - 1) ELSE 0 END, 4) AS bigram_diversity,
  ROUND(CASE WHEN t.n >= 3 THEN v.tri / (t.n - 2) ELSE 0 END, 4) AS trigram_diversity,
  CAST(COALESCE(s.n, 0) AS BIGINT) AS num_sentences, CAST(COALESCE(t.n, 0) AS BIGINT) AS num_words
FROM {doc} d
LEFT JOIN (SELECT doc_id, COUNT(*) AS n, AVG(n * 1.0E0) AS mu, STDDEV_POP(n * 1.0E0) AS sd FROM {sen} GROUP BY doc_id) s ON s.doc_id = d.doc_id
LEFT JOIN (
  SELECT doc_id, COUNT(*) AS n, AVG(LENGTH(w) * 1.0E0) AS mu, STDDEV_POP(LENGTH(w) * 1.0E0) AS sd,
    SUM(greatest(1, LENGTH(REGEXP_REPLACE(REGEXP_REPLACE(w, '[aeiouy]+', '@V'@G), '[^@V]', ''@G)) - CASE WHEN w LIKE '%e' THEN 1 ELSE 0 END)) AS syl
  FROM {tok} GROUP BY doc_id) t ON t.doc_id = d.doc_id
LEFT JOIN (
  SELECT doc_id, SUM(first_w) AS vocab, SUM(first_b) AS bi, SUM(first_t) AS tri FROM (
    SELECT doc_id, 1 AS first_w, 0 AS first_b, 0 AS first_t FROM {tok} GROUP BY doc_id, w
    UNION ALL SELECT doc_id, 0, 1, 0 FROM {tok} WHERE w2 IS NOT NULL GROUP BY doc_id, w, w2
    UNION ALL SELECT doc_id, 0, 0, 1 FROM {tok} WHERE w3 IS NOT NULL GROUP BY doc_id, w, w2, w3) u GROUP BY doc_id) v ON v.doc_id = d.doc_id
LEFT JOIN (
  SELECT p.doc_id, SUM(greatest(0, least(p.q, c.n - 11) - greatest(COALESCE(p.r + 1, 0), p.pos - 9) + 1)) AS rep
  FROM (SELECT doc_id, pos, LAG(pos, 1) OVER (PARTITION BY doc_id, w ORDER BY pos) AS q, LAG(pos, 2) OVER (PARTITION BY doc_id, w ORDER BY pos) AS r FROM {tok}) p
  JOIN (SELECT doc_id, COUNT(*) AS n FROM {tok} GROUP BY doc_id) c ON c.doc_id = p.doc_id
  WHERE p.q IS NOT NULL AND p.pos - p.q <= 9 GROUP BY p.doc_id) r ON r.doc_id = d.doc_id
"""

_STRUCTURAL = bands(
    "WHEN burstiness_score < 0.3 THEN 0.7 WHEN burstiness_score < 0.5 THEN 0.5 ELSE 0.3",
    "WHEN length_uniformity > 0.7 THEN 0.7 WHEN length_uniformity > 0.5 THEN 0.5 ELSE 0.3",
    "WHEN bigram_diversity < 0.7 THEN 0.6 ELSE 0.4",
    "WHEN readability_score BETWEEN 60 AND 75 THEN 0.6 ELSE 0.4",
    "WHEN repetition_score < 0.1 THEN 0.6 WHEN repetition_score < 0.2 THEN 0.5 ELSE 0.3",
)
#: Mean of the indicators that fired, at most 0.3.
_STRUCTURAL_MIXED = """ROUND(CASE WHEN a + b + c = 0 THEN 0 ELSE least(0.3, (0.4 * a + 0.3 * b + 0.3 * c) / (a + b + c)) END, 6)"""
STRUCTURAL = f"""
SELECT doc_id, {score(_STRUCTURAL)}, {_STRUCTURAL_MIXED} AS mixed, CAST(NULL AS STRING) AS error FROM (
  SELECT *, CASE WHEN burstiness_score > 0.6 THEN 1 ELSE 0 END AS a, CASE WHEN std_sentence_length > avg_sentence_length * 0.8 THEN 1 ELSE 0 END AS b,
    CASE WHEN (type_token_ratio < 0.3 OR type_token_ratio > 0.9) AND (readability_score < 20 OR readability_score > 90) THEN 1 ELSE 0 END AS c
  FROM ({STRUCTURAL_FEATURES}) f) g
"""

#: Entropy of counts c: log2(N) - sum(c log2 c) / N.
_H = "LOG2(SUM(c) * 1.0E0) - SUM(c * LOG2(c * 1.0E0)) / SUM(c)"
ENTROPY_FEATURES = f"""
WITH letters AS (
  SELECT doc_id, CAST(FLOOR(pos / 50) AS INT) AS b, ch, COUNT(*) AS c
  FROM (SELECT doc_id, pos, @EXPLODE(LOWER(w)) AS ch FROM {{spaced}}) x WHERE @ALNUM(ch) GROUP BY 1, 2, 3),
sized AS (SELECT doc_id, CAST(FLOOR(pos / 50) AS INT) AS b, COUNT(*) AS words, SUM(LENGTH(w)) AS chars FROM {{spaced}} GROUP BY 1, 2),
spread AS (
  SELECT s.doc_id, s.b AS k, s.words, s.chars FROM sized s
  UNION ALL SELECT s.doc_id, s.b - 1, s.words, s.chars FROM sized s WHERE s.b > 0),
chunk AS (SELECT doc_id, k, SUM(words) - 1 AS spaces, SUM(chars) + SUM(words) - 1 AS len FROM spread GROUP BY doc_id, k HAVING SUM(chars) + SUM(words) - 1 > 20),
chunk_counts AS (
  SELECT doc_id, k, ch, SUM(c) AS c FROM (
    SELECT doc_id, b AS k, ch, c FROM letters UNION ALL SELECT doc_id, b - 1, ch, c FROM letters WHERE b > 0
    UNION ALL SELECT doc_id, k, ' ', spaces FROM chunk WHERE spaces > 0) u GROUP BY doc_id, k, ch),
chunk_h AS (SELECT x.doc_id, x.k, {_H} AS h FROM chunk_counts x JOIN chunk y ON y.doc_id = x.doc_id AND y.k = x.k GROUP BY x.doc_id, x.k),
chunks AS (SELECT y.doc_id, COUNT(*) AS n, AVG(COALESCE(h, 0)) AS mu, VAR_POP(COALESCE(h, 0)) AS var FROM chunk y LEFT JOIN chunk_h x ON x.doc_id = y.doc_id AND x.k = y.k GROUP BY y.doc_id),
chars AS (SELECT doc_id, {_H} AS h FROM (SELECT doc_id, ch, SUM(c) AS c FROM (SELECT doc_id, ch, c FROM letters UNION ALL SELECT doc_id, ch, COUNT(*) FROM {{white}} GROUP BY 1, 2) u GROUP BY doc_id, ch) v GROUP BY doc_id),
wordy AS (SELECT doc_id, SUM(c) AS n, {_H} AS h FROM (SELECT doc_id, LOWER(w) AS w, COUNT(*) AS c FROM {{spaced}} GROUP BY 1, 2) v GROUP BY doc_id),
toky AS (SELECT doc_id, SUM(c) AS n, COUNT(*) AS kinds, {_H} AS h FROM (SELECT doc_id, w, COUNT(*) AS c FROM {{pretok}} GROUP BY 1, 2) v GROUP BY doc_id),
pairs AS (SELECT doc_id, {_H} AS h FROM (SELECT doc_id, w, w2, COUNT(*) AS c FROM {{pretok}} WHERE w2 IS NOT NULL GROUP BY 1, 2, 3) v GROUP BY doc_id),
f AS (
  SELECT d.doc_id, d.n_chars, COALESCE(c.h, 0) AS char_h, CASE WHEN w.n >= 5 THEN w.h ELSE 0 END AS word_h,
    CASE WHEN d.n_chars >= 10 AND t.n >= 10 THEN t.h ELSE 0 END AS tok_h, CASE WHEN t.n >= 10 THEN t.kinds / t.n ELSE 0 END AS div,
    CASE WHEN t.n >= 20 THEN least(1.0, p.h / 8.0) ELSE 0 END AS seq, COALESCE(k.var, 0) AS var, COALESCE(k.mu, 0) AS mu, COALESCE(k.n, 0) AS n
  FROM {{doc}} d LEFT JOIN chars c ON c.doc_id = d.doc_id LEFT JOIN wordy w ON w.doc_id = d.doc_id LEFT JOIN toky t ON t.doc_id = d.doc_id
  LEFT JOIN pairs p ON p.doc_id = d.doc_id LEFT JOIN chunks k ON k.doc_id = d.doc_id)
SELECT doc_id, n_chars, ROUND(char_h, 4) AS char_entropy, ROUND(word_h, 4) AS word_entropy, ROUND(tok_h, 4) AS token_entropy, ROUND(div, 4) AS token_diversity,
  ROUND(seq, 4) AS sequence_unpredictability, ROUND(var, 4) AS entropy_variance, ROUND(mu, 4) AS avg_chunk_entropy, ROUND(1.0 - least(1.0, char_h / 4.0), 4) AS predictability_score,
  (CASE WHEN char_h < 3.8 THEN 0.25 ELSE 0 END + CASE WHEN div < 0.7 THEN 0.25 ELSE 0 END + CASE WHEN seq < 0.4 THEN 0.25 ELSE 0 END + CASE WHEN var < 0.2 THEN 0.25 ELSE 0 END) AS ai_pattern_score,
  CAST(n AS BIGINT) AS num_chunks_analyzed
FROM f
"""
_ENTROPY = bands(
    "WHEN char_entropy < 3.5 THEN 0.8 WHEN char_entropy < 4.0 THEN 0.6 ELSE 0.2",
    "WHEN entropy_variance < 0.1 THEN 0.9 WHEN entropy_variance < 0.3 THEN 0.5 ELSE 0.1",
    "WHEN token_diversity < 0.6 THEN 0.7 WHEN token_diversity < 0.8 THEN 0.4 ELSE 0.2",
    "WHEN sequence_unpredictability < 0.3 THEN 0.8 WHEN sequence_unpredictability < 0.5 THEN 0.5 ELSE 0.2",
    "WHEN ai_pattern_score > 0.75 THEN 0.9 WHEN ai_pattern_score > 0.5 THEN 0.7 ELSE 0.3",
)
SHORT = "CASE WHEN n_chars < 50 THEN 'Text too short' END AS error"
ENTROPY = f"""
SELECT doc_id, {score(_ENTROPY, positive("char_entropy", "token_diversity", "sequence_unpredictability", "ai_pattern_score") + " >= 2")},
  ROUND(least(0.4, (a + b + c) / (1.0 + CASE WHEN b > 0 THEN 1 ELSE 0 END + CASE WHEN c > 0 THEN 1 ELSE 0 END)), 6) AS mixed, {SHORT}
FROM (SELECT *, CASE WHEN entropy_variance > 0.5 THEN 0.6 WHEN entropy_variance > 0.3 THEN 0.3 ELSE 0.0 END AS a,
    CASE WHEN char_entropy > 0 AND word_entropy > 0 AND ABS(char_entropy - word_entropy) > 1.0 THEN 0.4 ELSE 0.0 END AS b,
    CASE WHEN ai_pattern_score BETWEEN 0.4 AND 0.6 THEN 0.3 ELSE 0.0 END AS c FROM (@ENTROPY_FEATURES) f) g
""".replace("@ENTROPY_FEATURES", ENTROPY_FEATURES)

#: Interpolated bigram model of the corpus, add-one unigrams: nll of each token after the first.
NLL = """
WITH uni AS (SELECT w, COUNT(*) AS c FROM {tok} GROUP BY w),
tot AS (SELECT SUM(c) AS n, COUNT(*) AS v FROM uni),
bi AS (SELECT w, w2, COUNT(*) AS c, SUM(COUNT(*)) OVER (PARTITION BY w) AS ctx FROM {tok} WHERE w2 IS NOT NULL GROUP BY w, w2),
p AS (SELECT b.w, b.w2, -LN(0.7E0 * b.c / b.ctx + 0.3E0 * (u.c + 1) / (t.n + t.v)) AS nll FROM bi b JOIN uni u ON u.w = b.w2 CROSS JOIN tot t)
"""
#: Of the whole text, of chunks of 200 words, and of sentences of over 20 characters and five words at least.
PERPLEXITY_FEATURES = NLL + """,
x AS (SELECT k.doc_id, k.pos, p.nll FROM {tok} k JOIN p ON p.w = k.w AND p.w2 = k.w2),
whole AS (SELECT doc_id, COUNT(*) + 1 AS n, AVG(nll) AS ce FROM x GROUP BY doc_id),
blocks AS (SELECT doc_id, CAST(FLOOR(pos / 100) AS INT) AS b, SUM(nll) AS s, COUNT(*) AS c FROM x GROUP BY 1, 2),
chunk AS (
  SELECT doc_id, k, EXP(SUM(s) / SUM(c)) AS ppl FROM (SELECT doc_id, b AS k, s, c FROM blocks UNION ALL SELECT doc_id, b - 1, s, c FROM blocks WHERE b > 0) u
  GROUP BY doc_id, k HAVING SUM(c) >= 10 AND EXP(SUM(s) / SUM(c)) < 1000),
chunks AS (SELECT doc_id, COUNT(*) AS n, AVG(ppl) AS mu, VAR_POP(ppl) AS var FROM chunk GROUP BY doc_id),
sent AS (SELECT k.doc_id, k.idx, EXP(AVG(p.nll)) AS ppl FROM {senpos} k JOIN p ON p.w = k.w AND p.w2 = k.w2 GROUP BY k.doc_id, k.idx HAVING COUNT(*) >= 4),
sents AS (SELECT x.doc_id, COUNT(*) AS n, AVG(x.ppl) AS mu, STDDEV_POP(x.ppl) AS sd, MIN(x.ppl) AS lo, MAX(x.ppl) AS hi FROM sent x JOIN {sen} s ON s.doc_id = x.doc_id AND s.idx = x.idx WHERE LENGTH(s.s) > 20 GROUP BY x.doc_id),
f AS (SELECT d.doc_id, d.n_chars, CASE WHEN w.n >= 5 AND d.n_chars >= 10 THEN EXP(w.ce) ELSE 0 END AS ppl, CASE WHEN w.n >= 5 THEN w.ce ELSE 0 END AS ce, COALESCE(k.n, 0) AS n, COALESCE(k.mu, 0) AS mu, COALESCE(k.var, 0) AS var, s.n AS sn, s.mu AS smu, s.sd, s.lo, s.hi
  FROM {doc} d LEFT JOIN whole w ON w.doc_id = d.doc_id LEFT JOIN chunks k ON k.doc_id = d.doc_id LEFT JOIN sents s ON s.doc_id = d.doc_id)
SELECT doc_id, n_chars, ROUND(ppl, 3) AS overall_perplexity, ROUND(1 / (1 + EXP((ppl - 30) / 10)), 4) AS normalized_perplexity, ROUND(var, 2) AS perplexity_variance,
  ROUND(COALESCE(smu, ppl), 3) AS avg_sentence_perplexity, ROUND(COALESCE(sd, 0), 3) AS std_sentence_perplexity, ROUND(COALESCE(lo, ppl), 3) AS min_sentence_perplexity, ROUND(COALESCE(hi, ppl), 3) AS max_sentence_perplexity,
  CAST(COALESCE(sn, 0) AS BIGINT) AS num_sentences_analyzed, ROUND(least(1.0, ce / 5.0), 4) AS cross_entropy_score, ROUND(mu, 3) AS avg_chunk_perplexity, CAST(n AS BIGINT) AS num_chunks_analyzed
FROM f
"""
_PERPLEXITY = bands(
    "WHEN normalized_perplexity > 0.7 THEN 0.8 WHEN normalized_perplexity > 0.5 THEN 0.6 ELSE 0.2",
    "WHEN perplexity_variance < 50 THEN 0.7 WHEN perplexity_variance < 200 THEN 0.4 ELSE 0.2",
    "WHEN std_sentence_perplexity < 20 THEN 0.8 WHEN std_sentence_perplexity < 50 THEN 0.5 ELSE 0.2",
    "WHEN cross_entropy_score < 0.3 THEN 0.7 WHEN cross_entropy_score < 0.6 THEN 0.4 ELSE 0.2",
    "WHEN perplexity_variance < 25 THEN 0.9 WHEN perplexity_variance < 100 THEN 0.6 ELSE 0.3",
)
PERPLEXITY = f"""
SELECT doc_id, {score(_PERPLEXITY, positive("normalized_perplexity", "perplexity_variance", "std_sentence_perplexity", "cross_entropy_score") + " >= 3")},
  ROUND(least(0.3, (CASE WHEN normalized_perplexity BETWEEN 0.4 AND 0.6 THEN 0.3 ELSE 0.0 END + CASE WHEN perplexity_variance > 200 THEN 0.4 WHEN perplexity_variance > 100 THEN 0.2 ELSE 0.0 END
    + CASE WHEN std_sentence_perplexity BETWEEN 20 AND 60 THEN 0.3 ELSE 0.0 END) / 3), 6) AS mixed, {SHORT}
FROM (@F) f
""".replace("@F", PERPLEXITY_FEATURES)

SPARK = {"@EXPLODE(LOWER(w))": "EXPLODE(SPLIT(LOWER(w), ''))", "@ALNUM(ch)": r"ch RLIKE '^[\\pL\\pN]$'", "@G": "", "@V": "\u0001"}
DUCKDB = {"@EXPLODE(LOWER(w))": "unnest(string_split(LOWER(w), ''))", "@ALNUM(ch)": r"regexp_matches(ch, '^[\pL\pN]$')", "@G": ", 'g'", "@V": "\u0001", "AS STRING": "AS VARCHAR"}


_NUMBER = re.compile(r"'(?:[^']|'')*'|(?<![\w.])\d+\.\d+(?![\dE.])")


def doubles(text: str, mark: str) -> str:
    """Decimal numbers outside of quotes as doubles."""
    return _NUMBER.sub(lambda m: m[0] if m[0][0] == "'" else m[0] + mark, text)


def spark_sql(text: str) -> str:
    text = doubles(text, "D")
    for a, b in SPARK.items():
        text = text.replace(a, b)
    return text


def duck_sql(text: str, **extra: str) -> str:
    """The text for DuckDB: token tables as WITH clauses, other names as given."""
    names = needed(text)
    text = doubles(text, "E0")
    for a, b in DUCKDB.items():
        text = text.replace(a, b)
    body = re.sub(r"\{(\w+)\}", lambda m: extra.get(m[1], m[1]), text).strip()
    clauses = [tokens.DUCK["src"]] + [tokens.DUCK[n] for n in names if n in tokens.DUCK and n not in extra]
    return "WITH " + ",\n".join(clauses) + f"\nSELECT * FROM (\n{body}\n) q"


def step(text: str, sql: str, f: DataFrame, name: str, keep: tuple[str, ...]) -> DataFrame:
    """A metric's raw, confidence, mixed and error as the struct `name`, from the
    table f of its features (their SQL in text is `sql`): a projection of f that
    keeps the columns `keep`."""
    own = spark_sql(text.replace(sql, "SELECT * FROM {f}")).replace("SELECT doc_id,", "SELECT doc_id, " + "".join(k + ", " for k in keep), 1)
    row = "struct(CAST(raw AS DOUBLE) AS raw, CAST(confidence AS DOUBLE) AS confidence, CAST(mixed AS DOUBLE) AS mixed, CAST(error AS STRING) AS error)"
    return run(f.sparkSession, own, f=f).selectExpr("doc_id", *keep, f"{row} AS {name}")


def compute(text: str, docs: DataFrame, **frames: DataFrame) -> DataFrame:
    """text over the tables of docs. Features that features.py computes in the row
    stand for their SQL."""
    from . import features
    from . import language_metrics as lm
    from . import language_model as model

    made = {
        "structural_f": (STRUCTURAL_FEATURES, features.structural), "entropy_f": (ENTROPY_FEATURES, features.entropies), "semantic_f": (lm.SEMANTIC_FEATURES, features.semantic), "linguistic_f": (lm.LINGUISTIC_FEATURES, features.linguistic),
        "perplexity_f": (PERPLEXITY_FEATURES, lambda d: model.features(d, n=0).select(*model.PERPLEXITY)), "stability_f": (lm.STABILITY_FEATURES, lambda d: model.features(d).select(*model.STABILITY)),
    }
    for name, (sql, f) in made.items():
        if sql in text:
            text = text.replace(sql, f"SELECT * FROM {{{name}}}")
            if name not in frames:
                frames[name] = f(tokens.spread(docs.select("doc_id", "text")))
    have = {n: tokens.FRAMES[n](docs) for n in needed(text) if n in tokens.FRAMES and n not in frames}
    return run(docs.sparkSession, spark_sql(text), **have, **{n: f for n, f in frames.items() if n in needed(text)})
