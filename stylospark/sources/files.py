"""Documents from files and bytes: binary rows in, one row with text, type,
warnings and error out. Bad rows stay, with their error."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Suffixes that are read, and those that an upload may have.
SUFFIXES = (".txt", ".text", ".md", ".markdown", ".log", ".csv", ".rtf", ".html", ".htm", ".pdf", ".doc", ".docx")
UPLOADS = (".txt", ".md", ".pdf", ".docx", ".doc")
LARGEST = 50 * 1024 * 1024
# Character references that plain HTML text needs.
REFERENCES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.[^./]+$", 0))


# What windows-1252 has where ISO-8859-1 has control characters.
_C1 = "".join(map(chr, [*range(0x80, 0x81), 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x8B, 0x8C, 0x8E, *range(0x91, 0x9D), 0x9E, 0x9F]))
_CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def encoding(content: Column) -> Column:
    """A guess from the bytes: a byte order mark, UTF-8 where they are valid, UTF-16
    where every second of the first bytes is zero, windows-1252 where there are bytes
    that ISO-8859-1 leaves to control characters, else ISO-8859-1."""
    head = F.hex(F.substring(content, 1, 64))
    return (
        F.when(head.startswith("EFBBBF"), "UTF-8").when(head.startswith("FFFE"), "UTF-16LE").when(head.startswith("FEFF"), "UTF-16BE").when(head.rlike("^(?:(?!00)..00){3}"), "UTF-16LE").when(head.rlike("^(?:00(?!00)..){3}"), "UTF-16BE")
        .when(F.is_valid_utf8(content.cast("string")), "UTF-8").when(F.decode(content, "ISO-8859-1").rlike("[\u0080-\u009f]"), "windows-1252").otherwise("ISO-8859-1")
    )


def plain(content: Column) -> Column:
    """Text of bytes by the guess of their encoding, without a byte order mark."""
    kind, latin = encoding(content), F.decode(content, "ISO-8859-1")
    even = F.substring(content, F.lit(1), (F.length(content) - F.length(content) % 2).cast("int"))
    text = F.when(kind == "UTF-8", F.decode(F.when(F.is_valid_utf8(content.cast("string")), content), "UTF-8")).when(kind == "UTF-16LE", F.decode(even, "UTF-16LE")).when(kind == "UTF-16BE", F.decode(even, "UTF-16BE")).when(kind == "windows-1252", F.translate(latin, _C1, _CP1252))
    return F.regexp_replace(F.coalesce(text, latin), "^\ufeff", "")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes, most: int = 4 * LARGEST) -> str:
    """The paragraphs of a Word file's main part, those of tables in their place, with
    an empty line between; blank ones go. ValueError for anything that isn't such a file, one
    whose part is over `most` bytes, or one with a document type, which has no use."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            part = z.getinfo("word/document.xml")
            if part.file_size > most:
                raise ValueError("its text is too large")
            xml = z.read(part)
        if b"<!DOCTYPE" in xml[:4096]:
            raise ValueError("it has a document type")
        out, line = [], []
        for event, e in ElementTree.iterparse(io.BytesIO(xml), ("start", "end")):
            if event == "start" and e.tag == _W + "p":
                line = []
            elif event == "end" and e.tag == _W + "t":
                line.append(e.text or "")
            elif event == "end" and e.tag in (_W + "tab", _W + "br", _W + "cr"):
                line.append("\t" if e.tag == _W + "tab" else "\n")
            elif event == "end" and e.tag == _W + "p":
                out.append("".join(line))
                line = []
                e.clear()
        return "\n\n".join(x for x in out if x.strip())
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, EOFError, NotImplementedError, OSError, RuntimeError) as e:
        raise ValueError(f"{type(e).__name__}: {e}") from e


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("error", StringType())]))
def _word(contents: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    def one(c) -> tuple:
        if c is None:
            return None, None
        try:
            return docx_text(bytes(c)), None
        except ValueError as e:
            return None, f"Not a readable Word file ({e})"

    for s in contents:
        yield pd.DataFrame([one(c) for c in s], columns=["text", "error"])


def rtf_text(t: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\\[a-z]+\d*\s?", ""), r"[{}]", ""))


def html_text(t: Column) -> Column:
    """Script and style go, tags become line breaks, empty lines go."""
    t = F.regexp_replace(F.regexp_replace(t, r"(?is)<(script|style)\b.*?</\1\s*>", ""), r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"<[^>]*>", "\n")
    for a, b in REFERENCES:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.array_join(F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def upload_allowed(name: Column) -> Column:
    return suffix(name).isin(*UPLOADS)


def extract(files: DataFrame) -> DataFrame:
    """(name, content) to name, suffix, size, text, method, warnings, error,
    is_success. Types that need a parser the library doesn't bring (pdf, doc) give an
    error row; so do unknown suffixes, empty, too large and broken files."""
    kind, size = suffix(F.col("name")), F.coalesce(F.length("content"), F.lit(0))
    error = F.when(F.col("content").isNull(), "No content").when(~kind.isin(*SUFFIXES), F.concat(F.lit("Unsupported file type: "), kind)).when(size > LARGEST, "File too large").when(size == 0, "File is empty").when(kind.isin(".pdf", ".doc"), F.concat(F.lit("No parser for "), kind))
    a = files.select("name", "content", kind.alias("suffix"), size.cast("long").alias("size"), error.alias("error"))
    word = F.col("suffix") == ".docx"
    # only a Word file's content goes to Python
    a = a.withColumn("word", _word(F.when(word & F.col("error").isNull(), F.col("content")))).withColumn("error", F.coalesce("error", "word.error"))
    raw, kind, good = plain(F.col("content")), F.col("suffix"), F.col("error").isNull()
    text = F.when(word, F.col("word.text")).when(kind == ".rtf", rtf_text(raw)).when(kind.isin(".html", ".htm"), html_text(raw)).otherwise(raw)
    method = F.when(word, "docx").when(kind == ".rtf", "rtf").when(kind.isin(".html", ".htm"), "html").otherwise("plain")
    guessed = F.when(good & ~word & (encoding(F.col("content")) != "UTF-8"), F.concat(F.lit("Decoded as "), encoding(F.col("content"))))
    out = a.select("name", "suffix", "size", "error", F.when(good, text).alias("text"), F.when(good, method).alias("method"), F.array_compact(F.array(guessed)).alias("warnings"))
    return out.withColumn("is_success", F.col("error").isNull())


def read(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path, any store Spark reads, as extract() gives them."""
    return extract(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("name"), "content"))
