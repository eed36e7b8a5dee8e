"""Semantic, linguistic and stability metrics, as SQL over the token tables.

The neural parts of these metrics are replaced by Spark jobs: sentence vectors
are term frequencies, parts of speech come from closed classes and suffixes, and
likelihood is that of the corpus' bigram model."""

from __future__ import annotations

from .metrics import NLL, SHORT, bands, positive, score

#: Similarities of sentence vectors. Squares of all pairs come from term pairs within
#: sentences (||E'E||), so no sentence pairs are formed; repeated sentences are found by a
#: prefix filter on the rarest terms.
SEMANTIC_FEATURES = """
WITH tf AS (SELECT doc_id, idx, w, COUNT(*) AS c FROM {senw} GROUP BY doc_id, idx, w),
nrm AS (SELECT doc_id, idx, SUM(c * c) AS n2 FROM tf GROUP BY doc_id, idx),
e AS (SELECT t.doc_id, t.idx, t.w, t.c / SQRT(n.n2) AS x FROM tf t JOIN nrm n ON n.doc_id = t.doc_id AND n.idx = t.idx),
cnt AS (SELECT doc_id, COUNT(*) AS n FROM {sen10} GROUP BY doc_id),
adj AS (SELECT a.doc_id, a.idx, SUM(a.x * b.x) AS cosine FROM e a JOIN e b ON b.doc_id = a.doc_id AND b.w = a.w AND b.idx = a.idx + 1 GROUP BY a.doc_id, a.idx),
coh AS (SELECT doc_id, SUM(cosine) AS s FROM adj GROUP BY doc_id),
blk AS (SELECT doc_id, CAST(FLOOR(idx / 10) AS INT) AS b, SUM(cosine) / 10 AS m FROM adj GROUP BY 1, 2),
vari AS (SELECT doc_id, COUNT(*) AS n, AVG(m) AS mu, VAR_POP(m) AS v FROM blk GROUP BY doc_id),
tot AS (SELECT doc_id, SUM(s * s) AS s2 FROM (SELECT doc_id, w, SUM(x) AS s FROM e GROUP BY doc_id, w) q GROUP BY doc_id),
sq AS (SELECT doc_id, SUM(CASE WHEN w = w2 THEN g * g ELSE 2 * g * g END) AS g2 FROM (SELECT a.doc_id, a.w, b.w AS w2, SUM(a.x * b.x) AS g FROM e a JOIN e b ON b.doc_id = a.doc_id AND b.idx = a.idx AND b.w >= a.w GROUP BY a.doc_id, a.w, b.w) q GROUP BY doc_id),
df AS (SELECT doc_id, w, COUNT(*) AS f FROM tf GROUP BY doc_id, w),
pre AS (SELECT doc_id, idx, w FROM (SELECT e.doc_id, e.idx, e.w, SUM(e.x * e.x) OVER (PARTITION BY e.doc_id, e.idx ORDER BY d.f DESC, e.w) AS cum FROM e JOIN df d ON d.doc_id = e.doc_id AND d.w = e.w) q WHERE cum >= 0.6399),
cand AS (SELECT DISTINCT p.doc_id, p.idx AS i, e.idx AS j FROM pre p JOIN e ON e.doc_id = p.doc_id AND e.w = p.w AND e.idx >= p.idx + 2),
rep AS (SELECT doc_id, COUNT(*) AS m FROM (SELECT c.doc_id, c.i, c.j FROM cand c JOIN e a ON a.doc_id = c.doc_id AND a.idx = c.i JOIN e b ON b.doc_id = c.doc_id AND b.idx = c.j AND b.w = a.w GROUP BY c.doc_id, c.i, c.j HAVING SUM(a.x * b.x) > 0.8000001) q GROUP BY doc_id),
ends AS (SELECT e.doc_id, e.w, SUM(CASE WHEN e.idx < k.k THEN e.x ELSE 0 END) AS a, SUM(CASE WHEN e.idx >= k.n - k.k THEN e.x ELSE 0 END) AS b FROM e JOIN (SELECT doc_id, n, CAST(least(3, FLOOR(n / 3)) AS INT) AS k FROM cnt) k ON k.doc_id = e.doc_id GROUP BY e.doc_id, e.w),
drift AS (SELECT doc_id, SUM(a * b) AS d FROM ends GROUP BY doc_id),
kw AS (SELECT doc_id, w FROM (SELECT doc_id, w, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY COUNT(*) DESC, MIN(pos)) AS r FROM {keyword} GROUP BY doc_id, w HAVING COUNT(*) > 1) q WHERE r <= 10),
ctx AS (SELECT doc_id, AVG(share) AS s FROM (SELECT k.doc_id, k.w, AVG(CASE WHEN INSTR(LOWER(s.s), k.w) > 0 THEN 1.0 ELSE 0.0 END) AS share FROM kw k JOIN {sen10} s ON s.doc_id = k.doc_id GROUP BY k.doc_id, k.w) q GROUP BY doc_id),
f AS (
  SELECT d.doc_id, d.n_chars, COALESCE(c.n, 0) AS n, COALESCE(h.s, 0) / (c.n - 1) AS coh, COALESCE(v.v, 0) AS v, (t.s2 - c.n) / (c.n * (c.n - 1.0)) AS m1, (q.g2 - c.n) / (c.n * (c.n - 1.0)) AS m2,
    COALESCE(r.m, 0) / ((c.n - 1.0) * (c.n - 2.0) / 2) AS rep, COALESCE(g.d, 0) / POWER(least(3, FLOOR(c.n / 3)), 2) AS drift, COALESCE(x.s, 0) AS ctx
  FROM {doc} d LEFT JOIN cnt c ON c.doc_id = d.doc_id AND c.n >= 3 LEFT JOIN coh h ON h.doc_id = d.doc_id LEFT JOIN vari v ON v.doc_id = d.doc_id LEFT JOIN tot t ON t.doc_id = d.doc_id
  LEFT JOIN sq q ON q.doc_id = d.doc_id LEFT JOIN rep r ON r.doc_id = d.doc_id LEFT JOIN drift g ON g.doc_id = d.doc_id LEFT JOIN ctx x ON x.doc_id = d.doc_id)
SELECT doc_id, n_chars, ROUND(CASE WHEN n < 3 THEN 0.5 ELSE coh END + 1.0E-9, 4) AS coherence_score, ROUND(CASE WHEN n < 3 THEN 0.5 ELSE 1 - least(1.0, 5 * greatest(0.0, m2 - m1 * m1)) END + 1.0E-9, 4) AS consistency_score,
  ROUND(CASE WHEN n < 5 THEN 0.0 ELSE least(1.0, 3 * rep) END + 1.0E-9, 4) AS repetition_score, ROUND(CASE WHEN n < 3 THEN 0.5 ELSE greatest(0.0, 1 - drift) END + 1.0E-9, 4) AS topic_drift_score,
  ROUND(CASE WHEN n < 3 THEN 0.5 ELSE ctx END + 1.0E-9, 4) AS contextual_consistency, ROUND(CASE WHEN n < 3 THEN 0.1 ELSE v END + 1.0E-9, 4) AS coherence_variance, CAST(n AS BIGINT) AS num_sentences
FROM f
"""
_SEMANTIC = bands(
    "WHEN coherence_score > 0.7 THEN 0.8 WHEN coherence_score > 0.5 THEN 0.5 ELSE 0.2",
    "WHEN consistency_score > 0.8 THEN 0.9 WHEN consistency_score > 0.6 THEN 0.6 ELSE 0.3",
    "WHEN repetition_score > 0.3 THEN 0.7 WHEN repetition_score > 0.1 THEN 0.4 ELSE 0.2",
    "WHEN topic_drift_score < 0.2 THEN 0.8 WHEN topic_drift_score < 0.4 THEN 0.5 ELSE 0.3",
    "WHEN coherence_variance < 0.05 THEN 0.7 WHEN coherence_variance < 0.1 THEN 0.4 ELSE 0.2",
)
SEMANTIC = f"""
SELECT doc_id, {score(_SEMANTIC, positive("coherence_score", "consistency_score", "repetition_score", "topic_drift_score", "coherence_variance") + " >= 3")},
  ROUND(least(0.3, (CASE WHEN coherence_score BETWEEN 0.4 AND 0.6 THEN 0.3 ELSE 0.0 END + CASE WHEN coherence_variance > 0.15 THEN 0.4 WHEN coherence_variance > 0.1 THEN 0.2 ELSE 0.0 END
    + CASE WHEN repetition_score BETWEEN 0.15 AND 0.35 THEN 0.3 ELSE 0.0 END) / 3), 6) AS mixed, {SHORT}
FROM (@F) f
""".replace("@F", SEMANTIC_FEATURES)

# Words that mark a transition, and those of them whose overuse counts.
TRANSITIONS = "however therefore furthermore moreover consequently additionally nevertheless nonetheless thus hence".split()
OVERUSED = "however therefore moreover furthermore additionally"
#: Closed classes of the rule-based tagger, and forms of the verb that a passive and a predicate go with.
BE = "is are was were be been being am"
CLASSES = [
    ("DET", "the a an this that these those der die das el la los las le les un une"), ("PRON", "i you he she it we they me him her us them"),
    ("ADP", "of in on at by for with from to into over under about between"), ("CCONJ", "and or but nor yet so und y et"), ("SCONJ", "because if when while although though unless since weil wenn dass que si porque quand"),
    ("AUX", "is are was were be been am has have had do does did will would can could may might must shall should"),
]
SUFFIXES = [("ADV", "ly"), ("VERB", "ing ed"), ("ADJ", "ous ful ive al able")]
LINGUISTIC_FEATURES = "SELECT * FROM {linguistic_features}"
_LINGUISTIC = bands(
    "WHEN pos_diversity < 0.3 THEN 0.8 WHEN pos_diversity < 0.5 THEN 0.6 ELSE 0.2",
    "WHEN syntactic_complexity < 2.0 THEN 0.7 WHEN syntactic_complexity < 3.0 THEN 0.4 ELSE 0.2",
    "WHEN grammatical_consistency > 0.8 THEN 0.9 WHEN grammatical_consistency > 0.6 THEN 0.5 ELSE 0.3",
    "WHEN transition_word_usage > 0.3 THEN 0.7 WHEN transition_word_usage > 0.15 THEN 0.4 ELSE 0.2",
    "WHEN ai_pattern_score > 0.6 THEN 0.8 WHEN ai_pattern_score > 0.3 THEN 0.5 ELSE 0.2",
    "WHEN complexity_variance < 0.1 THEN 0.7 WHEN complexity_variance < 0.3 THEN 0.4 ELSE 0.2",
)
LINGUISTIC = f"""
SELECT doc_id, {score(_LINGUISTIC, positive("pos_diversity", "syntactic_complexity", "grammatical_consistency", "transition_word_usage", "ai_pattern_score", "complexity_variance") + " >= 4")},
  ROUND(least(0.3, (CASE WHEN pos_diversity BETWEEN 0.35 AND 0.55 THEN 0.3 ELSE 0.0 END + CASE WHEN complexity_variance > 0.5 THEN 0.4 WHEN complexity_variance > 0.3 THEN 0.2 ELSE 0.0 END
    + CASE WHEN ai_pattern_score BETWEEN 0.2 AND 0.6 THEN 0.3 ELSE 0.0 END) / 3), 6) AS mixed, {SHORT}
FROM (@F) f
""".replace("@F", LINGUISTIC_FEATURES)

#: Three deletions of a tenth of the words, chosen by an arithmetic hash of document, round and place. Words are
#: ranked within blocks of 1,000, which lose 100 each, so that no sort holds a whole document; link joins the blocks' ends.
STABILITY_FEATURES = NLL + """,
orig AS (SELECT b.doc_id, greatest(0.5, least(10.0, AVG(p.nll))) AS l FROM {tok} b JOIN p ON p.w = b.w AND p.w2 = b.w2 GROUP BY b.doc_id),
placed AS (SELECT doc_id, CAST(FLOOR(pos / 1000) AS INT) AS blk, pos, w FROM {tok}),
ranked AS (SELECT b.doc_id, r.k, b.blk, b.pos, b.w, COUNT(*) OVER (PARTITION BY b.doc_id, r.k, b.blk) AS n,
    ROW_NUMBER() OVER (PARTITION BY b.doc_id, r.k, b.blk ORDER BY ((b.doc_id + 17) * 7919 + r.k * 104729 + CAST(b.pos AS BIGINT) * 15485863) % 1000003, b.pos) AS rn
  FROM placed b CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) r),
kept AS (SELECT doc_id, k, blk, pos, w, LEAD(w) OVER (PARTITION BY doc_id, k, blk ORDER BY pos) AS w2 FROM ranked
  WHERE (blk > 0 OR n > 5) AND rn > CASE WHEN blk > 0 THEN FLOOR(n / 10) ELSE greatest(1, FLOOR(n / 10)) END),
ends AS (SELECT doc_id, k, blk, MIN_BY(w, pos) AS a, MAX_BY(w, pos) AS z, MAX(pos) AS at FROM kept GROUP BY doc_id, k, blk),
link AS (SELECT doc_id, k, pos, w, w2 FROM kept WHERE w2 IS NOT NULL UNION ALL SELECT x.doc_id, x.k, x.at, x.z, y.a FROM ends x JOIN ends y ON y.doc_id = x.doc_id AND y.k = x.k AND y.blk = x.blk + 1),
scored AS (SELECT t.doc_id, t.k, t.pos, COALESCE(p.nll, -LN(0.3E0 * (u.c + 1) / (z.n + z.v))) AS nll FROM link t JOIN uni u ON u.w = t.w2 CROSS JOIN tot z LEFT JOIN p ON p.w = t.w AND p.w2 = t.w2),
pert AS (SELECT doc_id, k, greatest(0.5, least(10.0, AVG(nll))) AS l FROM scored GROUP BY doc_id, k),
half AS (SELECT doc_id, CAST(FLOOR(pos / 75) AS INT) AS b, SUM(s) AS s, SUM(c) AS c, SUM(s1) AS s1, SUM(c1) AS c1 FROM (
  SELECT b.doc_id, b.pos, p.nll AS s, 1 AS c, 0.0 AS s1, 0 AS c1 FROM {tok} b JOIN p ON p.w = b.w AND p.w2 = b.w2 UNION ALL SELECT doc_id, pos, 0.0, 0, nll, 1 FROM scored WHERE k = 1) u GROUP BY 1, 2),
part AS (SELECT doc_id, k, greatest(0.5, least(10.0, SUM(s) / SUM(c))) AS l, greatest(0.5, least(10.0, SUM(s1) / SUM(c1))) AS l1 FROM (SELECT doc_id, b AS k, s, c, s1, c1 FROM half UNION ALL SELECT doc_id, b - 1, s, c, s1, c1 FROM half WHERE b > 0) u GROUP BY doc_id, k HAVING SUM(c) >= 10 AND SUM(c1) > 0),
spread AS (SELECT doc_id, VAR_POP(greatest(0.0, least(1.0, (l - l1) / l))) AS v FROM part GROUP BY doc_id),
agg AS (SELECT o.doc_id, o.l AS orig, COUNT(*) AS m, AVG(q.l) AS mean_l, AVG(greatest(0.0, least(1.0, (o.l - q.l) / o.l))) AS drop, VAR_POP(ABS(o.l - q.l)) AS curve, VAR_POP(q.l) AS pv FROM orig o JOIN pert q ON q.doc_id = o.doc_id GROUP BY o.doc_id, o.l)
SELECT d.doc_id, d.n_chars, ROUND(COALESCE(a.orig, 2.0), 4) AS original_likelihood, ROUND(COALESCE(a.mean_l, 1.8), 4) AS avg_perturbed_likelihood,
  ROUND(CASE WHEN a.drop IS NULL THEN 0.3 WHEN a.drop > 0.5 THEN 0.9 WHEN a.drop > 0.3 THEN 0.6 + (a.drop - 0.3) * 1.5 WHEN a.drop > 0.15 THEN 0.3 + (a.drop - 0.15) * 2 ELSE a.drop * 2 END, 4) AS stability_score,
  ROUND(CASE WHEN a.m >= 2 THEN least(1.0, a.curve * 3) ELSE 0.3 END, 4) AS curvature_score, ROUND(CASE WHEN a.m > 0 THEN greatest(0.33, least(3.0, a.orig / a.mean_l)) / 3 ELSE 0.55 END, 4) AS normalized_likelihood_ratio,
  ROUND(COALESCE(s.v, 0.1), 6) AS stability_variance, ROUND(COALESCE(a.pv, 0.05), 4) AS perturbation_variance, CAST(COALESCE(a.m, 0) AS BIGINT) AS num_perturbations
FROM {doc} d LEFT JOIN agg a ON a.doc_id = d.doc_id LEFT JOIN spread s ON s.doc_id = d.doc_id
"""
_WEIGHTED = [
    (0.3, "(CASE WHEN stability_score > 0.7 THEN 0.9 WHEN stability_score > 0.5 THEN 0.7 WHEN stability_score > 0.3 THEN 0.5 ELSE 0.2 END)"),
    (0.25, "(CASE WHEN curvature_score > 0.7 THEN 0.8 WHEN curvature_score > 0.5 THEN 0.6 WHEN curvature_score > 0.3 THEN 0.4 ELSE 0.2 END)"),
    (0.25, "(CASE WHEN normalized_likelihood_ratio > 0.8 THEN 0.9 WHEN normalized_likelihood_ratio > 0.6 THEN 0.7 WHEN normalized_likelihood_ratio > 0.4 THEN 0.5 ELSE 0.3 END)"),
    (0.2, "(CASE WHEN stability_variance < 0.05 THEN 0.8 WHEN stability_variance < 0.1 THEN 0.5 ELSE 0.2 END)"),
]
_OK = positive("stability_score", "curvature_score", "normalized_likelihood_ratio", "stability_variance", "perturbation_variance") + " >= 3"
_RAW = " + ".join(f"{w} * {c}" for w, c in _WEIGHTED)
_SUM, _SQ = " + ".join(c for _, c in _WEIGHTED), " + ".join(f"{c} * {c}" for _, c in _WEIGHTED)
STABILITY = f"""
SELECT doc_id, ROUND(CASE WHEN {_OK} THEN {_RAW} ELSE 0.5 END, 6) AS raw,
  ROUND(CASE WHEN {_OK} THEN greatest(0.1, least(0.9, 0.5 + 0.5 * (1 - sqrt(greatest(0.0, ({_SQ}) / 4 - POWER(({_SUM}) / 4, 2)))))) ELSE 0.3 END, 6) AS confidence,
  ROUND(least(0.3, (CASE WHEN stability_score BETWEEN 0.35 AND 0.55 THEN 0.3 ELSE 0.0 END + CASE WHEN stability_variance > 0.15 THEN 0.4 WHEN stability_variance > 0.1 THEN 0.2 ELSE 0.0 END
    + CASE WHEN normalized_likelihood_ratio BETWEEN 0.5 AND 0.8 THEN 0.3 ELSE 0.0 END) / 3), 6) AS mixed, {SHORT}
FROM (@F) f
""".replace("@F", STABILITY_FEATURES)
