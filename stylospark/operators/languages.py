"""Language of documents: a character model scored chunk by chunk, the same model over
the whole text, then script and function words; only documents that one step leaves
undecided pass to the next.

The model counts the trigrams of labelled documents by language, in 65,536 buckets of
their code points, which bounds it whatever the corpus holds. A text whose trigrams
are mostly unknown to it has no score: a Latin model doesn't judge Cyrillic text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from .features import let

BUCKETS, SHARP = 1 << 16, 20.0
#: Shares of known trigrams from which a chunk, and a whole text, have a score.
KNOWN, SOME = 0.5, 0.2
# Lengths of chunks, of a short text, scores that count, and confidences of the heuristics.
LONGEST, SHORTEST, SHORT, STRONG, LOW, BY_SCRIPT, BY_WORDS = 500, 50, 20, 0.2, 0.6, 0.7, 0.5
_SPLIT = re.compile(r"[.!?]+")


def chunks(text: str, longest: int = LONGEST, shortest: int = SHORTEST) -> Iterator[str]:
    """Sentences packed one after another into chunks of at most `longest` characters,
    of which those under `shortest` go; a text that has no other chunk, or one long
    one, is cut at every `longest` characters, or at a space in the last 30 %, up to
    which the piece then goes."""
    if len(text) <= longest:
        yield text
        return
    found, now = [], ""
    for s in filter(None, (x.strip() for x in _SPLIT.split(text))):
        if len(now) + len(s) + 1 <= longest:
            now = f"{now} {s}" if now else s
            continue
        if len(now) >= shortest:
            found.append(now)
        now = s
    if len(now) >= shortest:
        found.append(now)
    if found and not (len(found) == 1 and len(found[0]) > longest):
        yield from found
        return
    for i in range(0, len(text), longest):
        piece = text[i : i + longest]
        space = piece.rfind(" ")
        yield piece[:space].strip() if i + longest < len(text) and space > 0.7 * longest else piece


def buckets(text: str) -> np.ndarray:
    """The bucket of each trigram of a text."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    return (c[:-2] * 961 + c[1:-1] * 31 + c[2:]) % BUCKETS


def _cleaned(docs: DataFrame) -> Column:
    return T.language_text(F.coalesce("text", F.lit("")))


def chunk_rows(docs: DataFrame) -> DataFrame:
    """doc_id, chunk, text."""

    def rows(batches):
        for b in batches:
            for doc, t in zip(b.column(0), b.column(1)):
                own = list(chunks(t.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * len(own), b.schema.field(0).type), pa.array(range(len(own)), pa.int64()), pa.array(own, pa.string())], names=["doc_id", "chunk", "text"])

    return docs.select("doc_id", _cleaned(docs).alias("t")).mapInArrow(rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, chunk long, text string")


def train(docs: DataFrame) -> DataFrame:
    """lang, bucket, c: trigrams of the documents (text, lang) by language."""

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), b.column(1)):
                found = buckets(t.as_py())
                at = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                np.add.at(at, found, 1) if len(found) < 1000 else np.add(at, np.bincount(found, minlength=BUCKETS), out=at)
        for lang, at in total.items():
            some = np.flatnonzero(at)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(at[some])], names=["lang", "bucket", "c"])

    rows = docs.where("lang is not null").select("lang", F.lower(_cleaned(docs)).alias("t")).mapInArrow(count, "lang string, bucket int, c long")
    return rows.groupBy("lang", "bucket").agg(F.sum("c").alias("c"))


class Profile:
    """Log probabilities of the buckets by language; languages by name."""

    def __init__(self, rows: list):
        self.names = sorted({r.lang for r in rows})
        at = {n: i for i, n in enumerate(self.names)}
        counts = np.zeros((len(self.names), BUCKETS))
        for r in rows:
            counts[at[r.lang], r.bucket] = r.c
        self.seen = counts.sum(0) > 0
        self.logs = np.log((counts + 1) / (counts.sum(1, keepdims=True) + BUCKETS)) if rows else counts

    def scores(self, text: str, known: float) -> np.ndarray | None:
        """The probability of each language, or None for a text without a score."""
        b = buckets(text)
        if not len(b) or not self.names or self.seen[b].mean() < known:
            return None
        mean = self.logs[:, b].mean(1)
        p = np.exp(SHARP * (mean - mean.max()))
        return p / p.sum()

    def by_chunks(self, text: str) -> tuple | None:
        """(scores by language, low, inconsistent) of the chunks' three best each."""
        n = len(self.names)
        times, plain, heavy = np.zeros(n), np.zeros(n), np.zeros(n)
        k, weights, firsts = 0, 0.0, set()
        for c in chunks(text):
            p = self.scores(c.lower(), KNOWN)
            if p is None:
                continue
            best = np.argsort(-p, kind="stable")[:3]
            top = p[best[0]]
            k, weights = k + 1, weights + top
            firsts.add(int(best[0]))
            times[best] += 1
            plain[best] += p[best]
            heavy[best] += p[best] * top
        if not k:
            return None
        out = {self.names[i]: float(heavy[i] / weights if times[i] == k else plain[i] / times[i]) for i in np.flatnonzero(times)}
        return out, weights / k < LOW, len(firsts) > 1

    def whole(self, text: str) -> dict[str, float] | None:
        p = self.scores(re.sub(r"[\W\d_]+", " ", text.lower()), SOME)
        return None if p is None else {self.names[i]: float(p[i]) for i in np.argsort(-p, kind="stable")[:3]}


def beyond_latin(t: Column) -> Column:
    """The characters after the Latin ones: all other scripts lie there, and most texts have few."""
    return F.regexp_replace(t, r"[\x{0}-\x{24F}]+", "")


def script_counts(t: Column, rest: Column) -> list[Column]:
    """How many characters of each script a text has; rest: beyond_latin() of it."""
    return [F.length(F.regexp_replace(t if n == "latin" else rest, f"[^{chars}]+", "")).cast("long").alias(n) for n, (chars, _) in fixed.SCRIPTS.items()]


def heuristics(t: Column) -> tuple[Column, Column, Column]:
    """(script, language, matches) of a text, in its row: the script tells the
    language, else the function words do, at least three, ties by the list's order."""
    names = list(fixed.SCRIPTS)
    counts = lambda x: let(beyond_latin(x), lambda rest: F.array(*script_counts(x, rest)))

    def name(c: Column) -> Column:
        total, top = F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x), F.array_max(c)
        several = F.size(F.filter(c, lambda x: x > 0)) > 1
        return F.when(total == 0, "unknown").when(several & (top / total < 0.7), "mixed").otherwise(F.element_at(F.array(*map(F.lit, names)), F.array_position(c, top).cast("int")))

    script = let(let(F.regexp_replace(t, r"[\s\p{Punct}]+", ""), counts), name)
    langs: dict[str, list[str]] = {}
    for lang, _, w in fixed.language_rows():
        langs.setdefault(lang, []).append(w)
    listed = sorted({w for ws in langs.values() for w in ws})
    words = F.array_distinct(F.filter(F.split(F.lower(t), r"\s+"), lambda w: w.isin(*listed)))

    def vote(own: Column) -> Column:
        hits = F.array(*[F.size(F.array_intersect(own, F.array(*map(F.lit, ws)))) for ws in langs.values()])
        best = lambda h: F.struct(F.array_max(h).alias("c"), F.element_at(F.array(*map(F.lit, langs)), F.array_position(h, F.array_max(h)).cast("int")).alias("lang"))
        return let(hits, best)

    voted = let(words, vote)
    return script, voted, F.when(voted["c"] > 2, voted["c"]).otherwise(0).cast("long")


def by_words(docs: DataFrame) -> DataFrame:
    """doc_id, language, matches: script and function words, without a shuffle."""
    script, voted, matches = heuristics(F.coalesce("text", F.lit("")))
    a = docs.select("doc_id", script.alias("script"), voted.alias("v"), matches.alias("matches"))
    told = F.coalesce(*[F.when(F.col("script") == n, lang) for n, (_, lang) in fixed.SCRIPTS.items() if lang])
    return a.select("doc_id", F.coalesce(told, F.when(F.col("matches") > 0, F.col("v.lang")), F.lit("en")).alias("language"), "matches")


def detect(docs: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """doc_id, language, confidence, method, all_languages, script, is_multilingual,
    char_count, word_count, warnings of docs (doc_id, text) by the counts of train().
    all_languages and warnings are one string each. Without a model, or where it has
    no score, the next step decides."""
    profile = docs.sparkSession.sparkContext.broadcast(Profile(model.collect() if model is not None else []))

    def score(batches):
        for b in batches:
            out = []
            for t in b.column(1):
                text, p = t.as_py(), profile.value
                part = p.by_chunks(text)
                if part:
                    found, low, mixed = part
                    out.append(("chunk-model", [*found.items()], low, mixed))
                else:
                    found = p.whole(text)
                    out.append(("text-model" if found else None, [*(found or {}).items()], False, False))
            kinds = [pa.string(), pa.map_(pa.string(), pa.float64()), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]], names=[*b.schema.names, "method", "scores", "low", "mixed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    a = docs.select("doc_id", _cleaned(docs).alias("t"), (F.coalesce("text", F.lit("")) == "").alias("empty"))
    script, voted, matches = heuristics(F.col("t"))
    a = a.mapInArrow(score, f"doc_id {kind}, t string, empty boolean, method string, scores map<string,double>, low boolean, mixed boolean")
    a = a.select("*", script.alias("script"), voted.alias("v"), matches.alias("matches"))
    told = F.coalesce(*[F.when(F.col("script") == n, lang) for n, (_, lang) in fixed.SCRIPTS.items() if lang])
    guess = F.coalesce(told, F.when(F.col("matches") > 0, F.col("v.lang")), F.lit("en"))
    own = F.when(F.col("method").isNotNull(), F.map_entries("scores")).otherwise(F.array(F.struct(guess.alias("key"), F.when(told.isNotNull(), BY_SCRIPT).otherwise(BY_WORDS).alias("value"))))
    # rounded before ranking, ties by name
    ranked = F.array_sort(F.transform(own, lambda e: F.struct((-F.round(e["value"] + 1.0e-9, 6)).alias("v"), e["key"].alias("k"))))
    a = a.withColumns({"r": ranked, "method": F.coalesce("method", F.lit("heuristics"))})
    short = F.length("t") < SHORT
    warnings = F.array_compact(F.array(
        F.when(F.col("low"), "Low confidence across multiple chunks"), F.when(F.col("mixed"), "Inconsistent language detection across chunks"), F.when(F.col("method") == "heuristics", "Detection using heuristics, accuracy may be limited"),
        F.when(short, F.concat(F.lit("Text too short ("), F.length("t").cast("string"), F.lit(f" chars, minimum {SHORT}). Detection may be unreliable."))),
        F.when(F.col("method") != "chunk-model", "Model detection failed, using fallback"), F.when(F.col("method") == "heuristics", "Text model failed, using heuristics"),
    ))
    none = F.col("empty")
    strong = F.size(F.filter("r", lambda x: -x["v"] > STRONG)) > 1
    named = F.array_join(F.transform("r", lambda x: F.format_string("%s=%.4f", x["k"], F.floor(-x["v"] * 10000.0 + 0.5) / 10000.0)), " ")
    return a.select(
        "doc_id", F.when(none, "unknown").otherwise(F.get("r", F.lit(0))["k"]).alias("language"), F.when(none, 0.0).otherwise(-F.get("r", F.lit(0))["v"]).alias("confidence"), F.when(none, "none").otherwise(F.col("method")).alias("method"), F.when(none, "").otherwise(named).alias("all_languages"),
        "script", (~none & strong).alias("is_multilingual"), F.length("t").cast("long").alias("char_count"), F.size(T.space_words(F.col("t"))).cast("long").alias("word_count"),
        F.when(none, "Empty or invalid text").otherwise(F.array_join(warnings, "; ")).alias("warnings"),
    )


def is_language(found: DataFrame, language: str, threshold: float = 0.7) -> DataFrame:
    """doc_id, matches: whether detect() found `language` with enough confidence."""
    if language not in supported():
        raise ValueError(f"{language} isn't one of {supported()}")
    return found.select("doc_id", ((F.col("language") == language) & (F.col("confidence") >= threshold)).alias("matches"))


def supported() -> list[str]:
    return fixed.LANGUAGES.split()


_CHUNKS = rf"""
cl AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), 'https?://\S+|www\.\S+', '', 'g'), '\S+@\S+', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t, coalesce(text, '') = '' AS none FROM documents),
se AS (SELECT doc_id, unnest(range(len(ss))) AS i, unnest(ss) AS s FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(t, '[.!?]+'), lambda x: trim(x, ' ')), lambda x: x <> '') AS ss FROM cl WHERE length(t) > {LONGEST})),
wk AS (SELECT doc_id, i, CAST(length(s) AS BIGINT) AS n, CAST(0 AS BIGINT) AS c FROM se WHERE i = 0 UNION ALL
  SELECT w.doc_id, s.i, CASE WHEN w.n + length(s.s) + 1 <= {LONGEST} THEN w.n + 1 + length(s.s) ELSE length(s.s) END, w.c + CASE WHEN w.n + length(s.s) + 1 <= {LONGEST} THEN 0 ELSE 1 END FROM wk w JOIN se s ON s.doc_id = w.doc_id AND s.i = w.i + 1),
pk AS (SELECT w.doc_id, w.c, string_agg(s.s, ' ' ORDER BY s.i) AS t FROM wk w JOIN se s ON s.doc_id = w.doc_id AND s.i = w.i GROUP BY w.doc_id, w.c HAVING length(string_agg(s.s, ' ' ORDER BY s.i)) >= {SHORTEST}),
ok AS (SELECT doc_id FROM pk GROUP BY doc_id HAVING NOT (count(*) = 1 AND max(length(t)) > {LONGEST})),
fx AS (SELECT doc_id, c, CASE WHEN c + {LONGEST} < n AND sp > 0.7E0 * {LONGEST} THEN trim(substr(p, 1, sp), ' ') ELSE p END AS t FROM (
  SELECT doc_id, c, n, p, CASE WHEN instr(reverse(p), ' ') > 0 THEN length(p) - instr(reverse(p), ' ') ELSE -1 END AS sp FROM (SELECT doc_id, length(t) AS n, i AS c, substr(t, i + 1, {LONGEST}) AS p FROM (SELECT doc_id, t, unnest(range(0, length(t), {LONGEST})) AS i FROM cl WHERE length(t) > {LONGEST} AND doc_id NOT IN (SELECT doc_id FROM ok))))),
ck AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY c) - 1 AS BIGINT) AS chunk, t AS text FROM (SELECT doc_id, 0 AS c, t FROM cl WHERE length(t) <= {LONGEST} UNION ALL SELECT doc_id, c, t FROM pk WHERE doc_id IN (SELECT doc_id FROM ok) UNION ALL SELECT doc_id, c, t FROM fx))"""
_GRAMS = lambda rel, keys, t: f"(SELECT {keys}, (k[i] * 961 + k[i + 1] * 31 + k[i + 2]) % {BUCKETS} AS b FROM (SELECT *, unnest(range(1, len(k) - 1)) AS i FROM (SELECT {keys}, list_transform(string_split({t}, ''), lambda x: ord(x)) AS k FROM {rel} WHERE length({t}) > 2)))"
_MODEL = f"mo AS (SELECT lang, b, count(*) AS c FROM {_GRAMS('(SELECT lang, lower(cl.t) AS t FROM cl JOIN documents d ON d.doc_id = cl.doc_id WHERE lang IS NOT NULL)', 'lang', 't')} GROUP BY lang, b)"


def _scored(rel: str, keys: str, known: float) -> str:
    """keys, lang, p: probabilities of the languages for the texts t of a relation, if enough of their trigrams are known."""
    return f"""(WITH g AS (SELECT {keys}, b, count(*) AS n FROM {_GRAMS(rel, keys, 't')} GROUP BY ALL), z AS (SELECT lang, sum(c) + {BUCKETS} AS z FROM mo GROUP BY lang), kn AS (SELECT DISTINCT b FROM mo),
  f AS (SELECT {keys}, sum(CASE WHEN kn.b IS NULL THEN 0 ELSE n END) * 1.0E0 / sum(n) AS known FROM g LEFT JOIN kn ON kn.b = g.b GROUP BY ALL),
  m AS (SELECT {keys}, z.lang, sum(n * ln((coalesce(c, 0) + 1) * 1.0E0 / z)) / sum(n) AS m FROM g CROSS JOIN z LEFT JOIN mo ON mo.lang = z.lang AND mo.b = g.b GROUP BY {keys}, z.lang),
  e AS (SELECT {keys}, lang, exp({SHARP} * (m - max(m) OVER (PARTITION BY {keys}))) AS e FROM m)
  SELECT {keys}, lang, e / sum(e) OVER (PARTITION BY {keys}) AS p FROM e JOIN f USING ({keys}) WHERE known >= {known})"""


#: For DuckDB, over `documents` and {script} and {words}, queries of scripts and of languages by words of cleaned texts.
CHUNKS_SQL = f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, chunk, text FROM ck"
MODEL_SQL = f"WITH RECURSIVE {_CHUNKS}, {_MODEL} SELECT lang, CAST(b AS INTEGER) AS bucket, c FROM mo"
DETECT_SQL = f"""WITH RECURSIVE {_CHUNKS}, {_MODEL},
sc AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk ORDER BY p DESC, lang) AS r FROM {_scored('(SELECT doc_id, chunk, lower(text) AS t FROM ck)', 'doc_id, chunk', KNOWN)}),
t3 AS (SELECT *, max(p) OVER (PARTITION BY doc_id, chunk) AS top FROM sc WHERE r <= 3),
k AS (SELECT doc_id, count(*) AS k, sum(p) AS w, avg(p) AS mean, count(DISTINCT lang) AS firsts FROM t3 WHERE r = 1 GROUP BY doc_id),
cm AS (SELECT t3.doc_id, lang, CASE WHEN count(*) = max(k) THEN sum(p * top) / max(w) ELSE avg(p) END AS p FROM t3 JOIN k ON k.doc_id = t3.doc_id GROUP BY t3.doc_id, lang),
wm AS (SELECT doc_id, lang, p FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, lang) AS r FROM {_scored("(SELECT doc_id, regexp_replace(lower(t), '[^\\p{L}]+', ' ', 'g') AS t FROM cl WHERE doc_id NOT IN (SELECT doc_id FROM k))", 'doc_id', SOME)}) WHERE r <= 3),
hw AS (SELECT w.doc_id, w.language AS lang, CASE WHEN w.by_script THEN {BY_SCRIPT}E0 ELSE {BY_WORDS}E0 END AS p FROM ({{words}}) w WHERE w.doc_id NOT IN (SELECT doc_id FROM k) AND w.doc_id NOT IN (SELECT doc_id FROM wm)),
al AS (SELECT doc_id, 'chunk-model' AS method, lang, round(p + 1.0E-9, 6) AS p FROM cm UNION ALL SELECT doc_id, 'text-model', lang, round(p + 1.0E-9, 6) FROM wm UNION ALL SELECT doc_id, 'heuristics', lang, round(p + 1.0E-9, 6) FROM hw),
bs AS (SELECT doc_id, max(method) AS method, first(lang ORDER BY p DESC, lang) AS lang, max(p) AS p, count(*) FILTER (p > {STRONG}) AS strong, string_agg(printf('%s=%.4f', lang, floor(p * 10000.0E0 + 0.5E0) / 10000.0E0), ' ' ORDER BY p DESC, lang) AS names FROM al GROUP BY doc_id)
SELECT cl.doc_id, CASE WHEN none THEN 'unknown' ELSE bs.lang END AS language, CASE WHEN none THEN 0.0E0 ELSE p END AS confidence, CASE WHEN none THEN 'none' ELSE method END AS method, CASE WHEN none THEN '' ELSE names END AS all_languages, s.script, NOT none AND strong > 1 AS is_multilingual,
  CAST(length(t) AS BIGINT) AS char_count, CAST(len(list_filter(string_split(t, ' '), lambda x: x <> '')) AS BIGINT) AS word_count,
  CASE WHEN none THEN 'Empty or invalid text' ELSE concat_ws('; ', CASE WHEN mean < {LOW} THEN 'Low confidence across multiple chunks' END, CASE WHEN firsts > 1 THEN 'Inconsistent language detection across chunks' END, CASE WHEN method = 'heuristics' THEN 'Detection using heuristics, accuracy may be limited' END,
    CASE WHEN length(t) < {SHORT} THEN 'Text too short (' || length(t) || ' chars, minimum {SHORT}). Detection may be unreliable.' END, CASE WHEN method <> 'chunk-model' THEN 'Model detection failed, using fallback' END, CASE WHEN method = 'heuristics' THEN 'Text model failed, using heuristics' END) END AS warnings
FROM cl JOIN bs ON bs.doc_id = cl.doc_id LEFT JOIN k ON k.doc_id = cl.doc_id JOIN ({{script}}) s ON s.doc_id = cl.doc_id"""
