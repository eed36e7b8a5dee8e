"""What highlights read of sentences, and how many tasks judge them."""

from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from stylospark.functions import fixed
from stylospark.functions import text as T
from stylospark.operators import language_model, verdict_rows, verdicts

SENTENCES = [
    "Whether it holds, because nothing else does; or so they say", "same same same one two", "same same Same one two three", "été été ÉTÉ one two three", "été ét été été ét ét abc", "no", "a b c d e",
    "The algorithm has a neural network and perhaps a database", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen", "i hope that wow 👋 is cited e.g. here", "",
]


def test_sentences_are_read_as_each_by_itself():
    names = [*fixed.domains(), "general"]
    ss = [SENTENCES[i % 3 :] for i in range(len(names))] + [None, []]
    low = [None if x is None else [s.lower() for s in x] for x in ss]
    got = verdict_rows.read(pa.array([*names, "general", "general"]), pa.array(ss, pa.list_(pa.string())), pa.array(low, pa.list_(pa.string()))).to_pylist()
    for domain, own, rows in zip(names, ss, got):
        for s, r in zip(own, rows, strict=True):
            words, lower = s.encode().split(), s.lower()
            long = Counter(w for w in lower.encode().split() if len(w.decode()) > 3)
            again = len(words) >= 6 and max(long.values(), default=0) >= 3
            factor = 1.0
            rules = next((rules for group, rules in fixed.SENTENCE_RULES if domain in group.split()), [])
            for sign, f in rules:
                if isinstance(sign, tuple):
                    holds = sign[0] <= len(words) and (sign[1] is None or len(words) <= sign[1])
                elif sign == "repetition":
                    holds = again
                else:
                    holds = any(w in (s if sign == "code" else lower) for w in fixed.SIGNS[sign]) and (sign != "complex" or len(words) >= 8)
                if holds:
                    factor = f
                    break
            hits, clauses = (sum(w in lower for w in names) for names in (verdicts._INDICATORS, verdicts._CLAUSES))
            assert r == {"n": len(words), "kinds": len(set(words)), "again": again, "hits": hits, "clauses": clauses, "factor": factor}, (domain, s)
    assert got[-1] == [] and not got[-2]


def test_trimmed_as_by_the_pattern(spark):
    texts = ["  a b \t\n", "\x0b\x0cx\r", "é \u0085", " é  ", "a \n\u0085", " a ", "", " \n "]
    t = spark.createDataFrame([(x,) for x in texts], "t string")
    for r in t.select(T.trim(F.col("t")).alias("got"), F.regexp_replace("t", r"^\s+|\s+$", "").alias("want")).collect():
        assert r.got == r.want
    long = "Dr. Who met Mr. X at 3.5 p.m. in the U.S. today. Nobody came e.g. by car... Why not? The band. xdr. Y"
    got = spark.createDataFrame([(long,)], "t string").select(T.sentences_smart(F.col("t")).alias("s")).first().s
    assert got[0] == "dr Who met mr X at 3.5 p.m in the u.s today" or got[0].startswith("dr Who met mr X")


def test_small_joined_partitions_are_judged_by_more_than_one_task(spark):
    docs = spark.createDataFrame([(i, f"Some words of text {i} stand here. And others follow them.") for i in range(40)], "doc_id long, text string")
    f = language_model.features(docs)
    assert f.count() == 40
    assert f.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_metrics_are_taken_by_name_whatever_their_order(spark):
    kind = "array<struct<metric:string,ai:double,human:double,mixed:double,confidence:double,error:string,weight:double,factor:double>>"
    p = [("entropy", 0.9, 0.1, 0.0, 0.75, None, 0.2, 1.0), ("structural", 0.5, 0.5, 0.0, 0.75, None, 0.2, 1.0), ("linguistic", 0.1, 0.9, 0.0, 0.75, "Failed", 0.2, 1.0)]
    a = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve.", "none", p)], f"doc_id long, text string, domain string, p {kind}")
    r = verdict_rows.highlights(a).first()
    assert (r.n_words, r.confidence, r.ai_probability) == (12, 0.6, round((0.9 * 0.8 + 0.5 * 1.1) / 2, 6))
    assert r.tooltip == "AI Probability: 63.5%\nConfidence: 60.0%\nDomain: none\nLength: 12 words\nstructural: 55.0%\nentropy: 72.0%"
