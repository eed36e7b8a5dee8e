"""Exploded tables of a document set, each made within the row, without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def _rows(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def spread(docs: DataFrame) -> DataFrame:
    """docs, dealt anew only where their files give fewer tasks than there are
    cores: what is computed in the row would keep to those few."""
    few = docs.rdd.getNumPartitions() < docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition("doc_id") if few else docs


def tok(df: DataFrame) -> DataFrame:
    """doc_id, pos, w, w2, w3: lower-case words and the two that follow."""
    a = _rows(df).select("doc_id", T.lower_words(F.col("text")).alias("ws"))
    item = F.transform("ws", lambda w, i: F.struct(i.alias("pos"), w.alias("w"), F.get("ws", i + 1).alias("w2"), F.get("ws", i + 2).alias("w3")))
    return a.select("doc_id", F.explode(item).alias("x")).select("doc_id", "x.*")


def each_word(df: DataFrame) -> DataFrame:
    """doc_id, w of tok(), for what asks for no neighbours: without a struct a word."""
    return _rows(df).select("doc_id", F.explode(T.lower_words(F.col("text"))).alias("w"))


def pretok(df: DataFrame) -> DataFrame:
    """doc_id, pos, w, w2: case-sensitive tokens with their leading space."""
    a = _rows(df).select("doc_id", T.pretokens(F.col("text")).alias("ws"))
    item = F.transform("ws", lambda w, i: F.struct(i.alias("pos"), w.alias("w"), F.get("ws", i + 1).alias("w2")))
    return a.select("doc_id", F.explode(item).alias("x")).select("doc_id", "x.*")


def spaced(df: DataFrame) -> DataFrame:
    """doc_id, pos, w: words between white space, as they stand."""
    return _rows(df).select("doc_id", F.posexplode(T.space_words(F.col("text"))).alias("pos", "w"))


def sen(df: DataFrame, longer: int = 0) -> DataFrame:
    """doc_id, idx, s, n: sentences and their numbers of words."""
    return _rows(df).select("doc_id", F.posexplode(T.sentences(F.col("text"), longer)).alias("idx", "s")).withColumn("n", F.size(T.space_words(F.col("s"))))


def unsplit(df: DataFrame) -> DataFrame:
    """doc_id, idx, s, n: texts without a sentence, trimmed; empty ones as 'No text content' of 0 words."""
    a = _rows(df).where(~F.col("text").rlike(r"[^.!?\s]")).select("doc_id", F.regexp_replace("text", r"^\s+|\s+$", "").alias("s"))
    return a.select("doc_id", F.lit(0).alias("idx"), F.when(F.col("s") == "", "No text content").otherwise(F.col("s")).alias("s"), F.size(T.space_words(F.col("s"))).alias("n"))


def doc(df: DataFrame) -> DataFrame:
    """doc_id and what is counted from the whole text."""
    t = F.col("text")
    return _rows(df).select("doc_id", F.length(t).alias("n_chars"), F.regexp_count(t, F.lit(r"[^\p{L}\p{N}_\s]")).alias("n_punct"), (F.length(t) - F.length(F.replace(t, F.lit(","), F.lit("")))).alias("n_comma"))


def white(df: DataFrame) -> DataFrame:
    """doc_id, ch: the white space of each text, one row a character."""
    return _rows(df).select("doc_id", F.explode(F.filter(F.split(F.regexp_replace("text", r"\S", ""), ""), lambda c: c != "")).alias("ch"))


def sen10(df: DataFrame) -> DataFrame:
    """Sentences of more than 10 characters, numbered anew."""
    return sen(df, 10)


def senw(df: DataFrame) -> DataFrame:
    """doc_id, idx, w: the lower-case words of sen10."""
    return sen10(df).select("doc_id", "idx", F.explode(T.lower_words(F.col("s"))).alias("w"))


def senpos(df: DataFrame) -> DataFrame:
    """doc_id, idx, pos, w, w2: words of all sentences and the next in the sentence."""
    a = sen(df).select("doc_id", "idx", T.lower_words(F.col("s")).alias("ws"))
    item = F.transform("ws", lambda w, i: F.struct(i.alias("pos"), w.alias("w"), F.get("ws", i + 1).alias("w2")))
    return a.select("doc_id", "idx", F.explode(item).alias("x")).select("doc_id", "idx", "x.*")


def keyword(df: DataFrame) -> DataFrame:
    """doc_id, pos, w: words of four ASCII letters at least."""
    return _rows(df).select("doc_id", F.posexplode(T.keywords(F.col("text"))).alias("pos", "w"))


#: The same tables for DuckDB, as WITH clauses over its view `documents`.
DUCK = {
    "src": "src AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)",
    "tok": r"tok AS (SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS w, unnest(ws[2:] || [NULL]) AS w2, unnest(ws[3:] || [NULL, NULL]) AS w3 FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM src) WHERE len(ws) > 1 UNION ALL SELECT doc_id, 0, ws[1], NULL, NULL FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM src) WHERE len(ws) = 1)",
    "pretok": r"pretok AS (SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS w, unnest(ws[2:] || [NULL]) AS w2 FROM (SELECT doc_id, regexp_extract_all(text, '''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+') AS ws FROM src) WHERE len(ws) > 0)",
    "spaced": r"spaced AS (SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS w FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM src))",
    "sen": r"sen AS (SELECT *, len(list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> '')) AS n FROM (SELECT doc_id, unnest(range(len(ss))) AS idx, unnest(ss) AS s FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ss FROM src)))",
    "unsplit": r"unsplit AS (SELECT doc_id, 0 AS idx, CASE WHEN t = '' THEN 'No text content' ELSE t END AS s, len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')) AS n FROM (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM src WHERE NOT regexp_matches(text, '[^.!?\s]')))",
    "sen10": r"sen10 AS (SELECT doc_id, unnest(range(len(ss))) AS idx, unnest(ss) AS s FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 10) AS ss FROM src))",
    "senw": r"senw AS (SELECT doc_id, idx, unnest(regexp_extract_all(lower(s), '[\p{L}\p{N}_]+')) AS w FROM (SELECT doc_id, unnest(range(len(ss))) AS idx, unnest(ss) AS s FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 10) AS ss FROM src)))",
    "senpos": r"senpos AS (SELECT doc_id, idx, unnest(range(len(ws))) AS pos, unnest(ws) AS w, unnest(ws[2:] || [NULL]) AS w2 FROM (SELECT doc_id, idx, regexp_extract_all(lower(s), '[\p{L}\p{N}_]+') AS ws FROM (SELECT doc_id, unnest(range(len(ss))) AS idx, unnest(ss) AS s FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ss FROM src))) WHERE len(ws) > 0)",
    "keyword": r"keyword AS (SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS w FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: regexp_matches(x, '^[a-z]{4,}$')) AS ws FROM src))",
    "doc": r"doc AS (SELECT doc_id, length(text) AS n_chars, len(regexp_extract_all(text, '[^\p{L}\p{N}_\s]')) AS n_punct, length(text) - length(replace(text, ',', '')) AS n_comma FROM src)",
    "white": r"white AS (SELECT doc_id, unnest(regexp_extract_all(text, '\s')) AS ch FROM src)",
}
FRAMES = {"tok": tok, "pretok": pretok, "spaced": spaced, "sen": sen, "unsplit": unsplit, "doc": doc, "white": white, "sen10": sen10, "senw": senw, "senpos": senpos, "keyword": keyword}
