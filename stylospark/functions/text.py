"""Cleaning and splitting of text as Column expressions; all run in the JVM but
for normalisation, which Python does for rows beyond ASCII."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import fixed

W = r"[\p{L}\p{N}_]"
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def drop_control(t: Column) -> Column:
    """Characters of categories C* go, but for newline, tab, carriage return."""
    return F.regexp_replace(t, r"[\p{C}&&[^\n\t\r]]", "")


def fix_encoding(t: Column) -> Column:
    for wrong, right in fixed.MOJIBAKE:
        t = F.replace(t, F.lit(wrong), F.lit(right))
    return t


def normalise(t: Column) -> Column:
    wide = F.when(t.rlike(r"[^\x00-\x7F]"), t)
    return F.translate(F.coalesce(_nfkc(wide), t), "—–", "--")


def drop_urls(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(t, r"https?://\S+", ""), r"www\.\S+", "")


def drop_emails(t: Column) -> Column:
    return F.regexp_replace(t, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "")


def squeeze(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^\s+|\s+$", "")


def clean_text(t: Column, encoding=True, unicode=True, urls=True, emails=True, keep_layout=False) -> Column:
    t = drop_control(t)
    for on, f in ((encoding, fix_encoding), (unicode, normalise), (urls, drop_urls), (emails, drop_emails)):
        t = f(t) if on else t
    return F.regexp_replace(t, r"\s+", " ") if keep_layout else squeeze(t)


def language_text(t: Column) -> Column:
    """Without links, words that hold an @ and repeated white space."""
    return squeeze(F.regexp_replace(F.regexp_replace(t, r"https?://\S+|www\.\S+", ""), r"\S+@\S+", ""))


def trim(t: Column) -> Column:
    """Without white space at its ends. Of ASCII this is a trim of characters; beyond it a pattern's end may be before a line end."""
    return F.when(F.octet_length(t) == F.length(t), F.btrim(t, F.lit(" \t\n\x0b\f\r"))).otherwise(F.regexp_replace(t, r"^\s+|\s+$", ""))


def non_empty(a: Column) -> Column:
    return F.filter(F.transform(a, trim), lambda x: x != "")


def space_words(t: Column) -> Column:
    return F.filter(F.split(t, r"\s+"), lambda x: x != "")


def lower_words(t: Column) -> Column:
    return F.regexp_extract_all(F.lower(t), F.lit(W + "+"), F.lit(0))


def words(t: Column) -> Column:
    """Words with apostrophes and hyphens; no single letters but a and i, no numbers."""
    raw = F.transform(space_words(F.regexp_replace(t, r"[^\p{L}\p{N}_\s'-]", " ")), lambda w: F.regexp_replace(w, r"^['-]+|['-]+$", ""))
    return F.filter(raw, lambda w: ((F.length(w) > 1) | F.lower(w).isin("a", "i")) & ~F.regexp_replace(w, "['-]", "").rlike(r"^\p{Nd}+$"))


def sentences(t: Column, longer: int = 0) -> Column:
    """Split at runs of . ! ?; pieces of more than `longer` characters."""
    return F.filter(non_empty(F.split(t, r"[.!?]+")), lambda s: F.length(s) > longer)


def sentences_lookbehind(t: Column) -> Column:
    pieces = F.split(t, r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?|\!)\s")
    return F.filter(non_empty(pieces), lambda s: F.length(s) > 10)


def sentences_smart(t: Column) -> Column:
    """Abbreviations lose their period and case, decimals and ... are kept;
    pieces of two words at least. Abbreviations are taken in sorted order."""
    whole, names = t, sorted(fixed.ABBREVIATIONS)
    for a in names:
        t = F.regexp_replace(t, rf"(?i)\b{re.escape(a)}\.", a.replace(".", "<DOT>"))
    # looked back for from a period: the names need not be tried at each character
    t = F.when(whole.rlike(rf"(?i)\.(?<=\b(?:{'|'.join(map(re.escape, names))})\.)"), t).otherwise(whole)
    t = F.replace(F.regexp_replace(t, r"(\d+)\.(\d+)", "$1<DOT>$2"), F.lit("..."), F.lit("<ELLIPSIS>"))
    back = lambda s: F.replace(F.replace(s, F.lit("<DOT>"), F.lit(".")), F.lit("<ELLIPSIS>"), F.lit("..."))
    pieces = non_empty(F.transform(F.split(t, r"[.!?]+(?=\s+[A-Z]|$)"), back))
    return F.filter(pieces, lambda s: s.rlike(r"\S\s+\S"))


def paragraphs(t: Column) -> Column:
    p = F.filter(non_empty(F.split(t, r"\n\s*\n")), lambda s: F.size(space_words(s)) >= 5)
    return F.when(F.size(p) > 0, p).otherwise(non_empty(F.array(t)))


def keywords(t: Column) -> Column:
    return F.filter(lower_words(t), lambda w: w.rlike("^[a-z]{4,}$"))


def pretokens(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(PRETOKEN), F.lit(0))


def chunks(units: Column, size: int = 512, overlap: int = 50) -> Column:
    """Runs of `size` units, each `size - overlap` after the one before."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(units) - 1, F.lit(0)), F.lit(size - overlap))
    many = F.transform(starts, lambda i: F.slice(units, i + 1, size))
    return F.when(F.size(units) == 0, F.array()).when(F.size(units) <= size, F.array(units)).otherwise(many)


def clean(df: DataFrame, shortest: int = 50, longest: int = 500_000, **options) -> DataFrame:
    """doc_id, cleaned text, words, sentences, counts, flags and errors of
    documents. A null text is empty; invalid rows are kept with their errors,
    those over `longest` characters whole."""
    t = df.select("doc_id", clean_text(F.coalesce("text", F.lit("")), **options).alias("cleaned"))
    t = t.withColumn("words", words(F.col("cleaned"))).withColumn("sentences", sentences_smart(F.col("cleaned")))
    n, s, low = F.size("words"), F.size("sentences"), F.transform("words", lambda w: F.lower(w))
    unique = F.size(F.array_distinct(low))
    total = F.aggregate("words", F.lit(0), lambda a, w: a + F.length(w))
    errors = F.array_compact(F.array(
        F.when(F.length("cleaned") < shortest, F.concat(F.lit("Text too short: "), F.length("cleaned").cast("string"), F.lit(f" chars (minimum: {shortest})"))),
        F.when(F.length("cleaned") > longest, F.concat(F.lit("Text too long: "), F.length("cleaned").cast("string"), F.lit(f" chars (maximum: {longest})"))),
        F.when(s == 0, F.lit("No valid sentences found")),
        F.when(n < 10, F.concat(F.lit("Too few words: "), n.cast("string"), F.lit(" (minimum: 10)"))),
    ))
    return t.select(
        "doc_id", "cleaned", "words", "sentences", F.length("cleaned").alias("char_count"), n.alias("word_count"), s.alias("sentence_count"), F.size(paragraphs(F.col("cleaned"))).alias("paragraph_count"),
        F.round(F.when(s > 0, n / s).otherwise(0.0), 2).alias("avg_sentence_length"), F.round(F.when(n > 0, total / n).otherwise(0.0), 2).alias("avg_word_length"),
        F.col("cleaned").rlike(r'[!@#$%^&*()\[\]{}|\\:;"<>?,./~`]').alias("has_special_chars"), F.col("cleaned").rlike(r"\p{Nd}").alias("has_numbers"), F.col("cleaned").rlike(r"\p{Lu}").alias("has_uppercase"), F.col("cleaned").rlike(r"\p{Ll}").alias("has_lowercase"),
        unique.alias("unique_words"), F.round(F.when(n > 0, unique / n).otherwise(0.0), 4).alias("lexical_diversity"), errors.alias("errors"), (F.size(errors) == 0).alias("is_valid"),
    )
