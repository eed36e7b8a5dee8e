"""Spelling variants: pairs of words at edit distance one by an index of
variable-length grams.

A gram dictionary has every pair of letters that occurs, and a longer gram where
the gram before its last letter is in more than `threshold` words: frequent grams
are pruned in favour of the rarer ones that extend them. A word, padded, is cut into
the longest grams of the dictionary that start at each place and don't lie within
the one before. An edit can only affect a gram that it touches, that it might
extend, or that a gram across it might swallow; the most grams that any one edit of
a word affects is the word's bound B. Of two words one edit apart, the least common
gram that the edit leaves alone is hence among the first B + 1 grams of either, in
order of frequency: only these lists are merged. (As padding makes every word of
MIN_LENGTH hold a gram far enough from any edit, there is one.) What lies on one
side of such a gram is equal in both words, so lists are keyed by the gram and all
that is before it, or after it. A list of more than LIST words is cut by what its
words have in common on the other side, with one letter left out; its pairs are
found all the same. Pairs are verified by their edit distance.

Null or empty texts have no words. A null doc_id is written as an empty number.
Repeated rows count again; other columns aren't read. No word has no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, durable

# Fixed values of the contract: letters of a run, the share of runs with a letter left out, and what is a word.
RUN, ODDS, MIN_LENGTH, MIN_COUNT = "[A-Za-zÀ-ÿ]+", 97, 5, 3
SHORTEST, LONGEST, DICTIONARY, LIST = 2, 5, 200_000, 64
#: Letters before and after a word. A word of MIN_LENGTH then has 2 * LONGEST letters, which leaves a gram out of any edit's reach.
PAD = LONGEST - 2
BEGIN, END = "\x01" * PAD, "\x02" * PAD
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def counted(docs: DataFrame) -> DataFrame:
    """word, n: the words of all texts."""
    runs = F.regexp_extract_all(column(docs, "text", "string"), F.lit(RUN), F.lit(0))
    own = docs.select(F.concat(F.coalesce(column(docs, "doc_id", "long").cast("string"), F.lit("")), F.lit(":")).alias("d"), F.explode(runs).alias("w"))
    own = own.where(F.length("w") >= MIN_LENGTH).select("d", F.translate("w", _UPPER, _UPPER.lower()).alias("w"))
    own = own.select("w", F.crc32(F.encode(F.concat("d", "w"), "UTF-8")).alias("h"))
    at = F.pmod(F.col("h"), F.length("w")).cast("int")
    word = F.when(F.col("h") % ODDS == 0, F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.length("w")))).otherwise(F.col("w"))
    return own.select(word.alias("word")).where(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


def dictionary(words: DataFrame, most: int = DICTIONARY) -> dict[str, int]:
    """Grams and the places they occur at. The threshold is the least power of two
    that keeps longer grams to about `most` (pairs of letters are some 8,000 at
    most), so it has a size bound, whatever the number of words."""
    padded = F.concat(F.lit(BEGIN), "word", F.lit(END))
    # the first place has no letter before it and so on: a gram of each length at each place
    places = F.explode(F.sequence(F.lit(1), F.length("p") - SHORTEST + 1)).alias("i")
    at = words.select(padded.alias("p")).select("p", places)
    length = F.explode(F.sequence(F.lit(SHORTEST), F.least(F.lit(LONGEST), F.length("p") - F.col("i") + 1))).alias("q")
    grams = durable(at.select("p", "i", length).select(F.substring("p", F.col("i"), F.col("q")).alias("g")).groupBy("g").agg(F.count("*").alias("c")), "spelling-grams")
    parent = grams.select(F.col("g").alias("up"), F.col("c").alias("above"))
    longer = grams.where(F.length("g") > SHORTEST).withColumn("up", F.substring("g", F.lit(1), F.length("g") - 1)).join(parent, "up")
    level = F.floor(F.log2("above")).cast("int")
    sizes = {r.level: r.n for r in longer.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}
    least, total = 64, 0
    for k in range(max(sizes, default=0), 3, -1):
        total += sizes.get(k, 0)
        if total > most:
            break
        least = k
    kept = grams.where(F.length("g") == SHORTEST).unionByName(longer.where(level >= least).select("g", "c"))
    return {r.g: r.c for r in kept.toLocalIterator()}


class Grams:
    """Words cut into grams of a dictionary, and the bound of affected grams."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.starts = {g[:k] for g in counts for k in range(1, len(g))}
        self.inside = {g[a:b] for g in counts for a in range(1, len(g)) for b in range(a + 1, len(g) + 1)}

    def cut(self, s: str) -> list[tuple[int, int]]:
        """(start, end) of each gram of a padded word."""
        out, last, n = [], 0, len(s)
        for p in range(n - SHORTEST + 1):
            for e in range(min(p + LONGEST, n), p + SHORTEST - 1, -1):
                if s[p:e] in self.counts:
                    if e > last:
                        out.append((p, e))
                        last = e
                    break
        return out

    def bound(self, s: str, cut: list[tuple[int, int]]) -> int:
        """The most grams that one inserted, deleted or replaced letter affects."""
        hit = [0] * (len(s) + 2)
        for p, e in cut:
            low, high = p, e - 1 + (s[p:e] in self.starts)  # within the gram, or right after one that it might extend
            while low > 0 and s[low:e] in self.inside:  # before it, where a gram across the edit might swallow it
                low -= 1
            hit[low] += 1
            hit[high + 1] -= 1
        most = now = 0
        for i in range(len(s) - PAD + 1):
            now += hit[i]
            if i >= PAD:
                most = max(most, now)
        return most

    def keys(self, word: str) -> Iterator[tuple[str, str]]:
        """(key, rest): what is equal on one side of each gram to merge by, and the
        other side, in which the edit is."""
        s = BEGIN + word + END
        cut = self.cut(s)
        first = sorted(cut, key=lambda g: (self.counts[s[g[0] : g[1]]], s[g[0] : g[1]], g[0]))[: self.bound(s, cut) + 1]
        done = set()
        for p, e in first:
            if e <= PAD + len(word) and (0, e) not in done:
                done.add((0, e))
                yield "<" + s[PAD:e], s[max(e, PAD) : -PAD]
            if p >= PAD and (1, p) not in done:
                done.add((1, p))
                yield ">" + s[p:-PAD], s[PAD : max(PAD, min(p, len(s) - PAD))]


def _less_one(rest: Column) -> Column:
    """rest, and rest with each of its letters left out."""
    cut = F.transform(F.sequence(F.lit(1), F.length(rest)), lambda i: F.concat(F.substring(rest, F.lit(1), i - 1), F.substring(rest, i + 1, F.length(rest))))
    return F.array_distinct(F.concat(F.array(rest), F.when(F.length(rest) > 0, cut).otherwise(F.array().cast("array<string>"))))


def pairs(words: DataFrame, most: int = DICTIONARY, longest_list: int = LIST) -> DataFrame:
    """a, an, b, bn: pairs of words (column word, n) that differ by one letter
    inserted, deleted or replaced, each pair once, a < b."""
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast(dictionary(words, most))

    def lists(batches):
        grams = Grams(shared.value)
        for b in batches:
            rows = [(k, r, w, n) for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, r in grams.keys(w)]
            for i in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows[i : i + 20_000]), (pa.string(), pa.string(), pa.string(), pa.int64()))], names=["key", "rest", "word", "n"])

    lists_ = durable(words.select("word", "n").mapInArrow(lists, "key string, rest string, word string, n long"), "spelling-lists")
    size = lists_.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    sized = lists_.join(size, "key").withColumn("long", F.col("size") > longest_list)
    # the key of a short list is its own, that of a long one also what is left on its other side without a letter
    key = F.when(F.col("long"), F.transform(_less_one(F.col("rest")), lambda x: F.concat("key", F.lit("\n"), x))).otherwise(F.array("key"))
    own = sized.select(F.explode(key).alias("key"), "word", "n")
    left, right = own.select("key", F.col("word").alias("a"), F.col("n").alias("an")), own.select("key", F.col("word").alias("b"), F.col("n").alias("bn"))
    both = left.join(right, "key").where((F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) < 2))
    return both.where(F.levenshtein("a", "b", 1) == 1).select("a", "an", "b", "bn").distinct()


def _roots(links: DataFrame, chain: int) -> DataFrame:
    """word, root of links (word, form): every round doubles how far a link reaches,
    and a chain has at most `chain` links."""
    reach = links.select("word", F.col("form").alias("root"))
    for i in range(max(0, math.ceil(math.log2(max(1, chain))))):
        on = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = durable(reach.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"spelling-roots-{i}")
        reach = further.drop("moved")
        if further.where("moved").isEmpty():
            break
    return reach


def variants(docs: DataFrame, most: int = DICTIONARY, longest_list: int = LIST) -> DataFrame:
    """word, n, n_near, form, form_n, root of each word of docs."""
    words = durable(counted(docs), "spelling-words")
    found = pairs(words, most, longest_list)
    ways = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("bn").alias("c")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("an").alias("c"))))
    near = found.select(ways.alias("x")).select("x.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("c")).alias("c"), "other")).alias("top"))
    good = -F.col("top.c") >= 2 * F.col("n")
    rows = durable(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("top.other")).alias("form"), F.when(good, -F.col("top.c")).alias("form_n")), "spelling-forms")
    # a form is twice as frequent at least, so a chain is no longer than the logarithm of the largest count
    highest = rows.agg(F.max("n")).first()[0] or 1
    roots = _roots(rows.where("form is not null").select("word", "form"), int(math.log2(highest)) + 1)
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
