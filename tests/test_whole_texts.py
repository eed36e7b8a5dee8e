"""Metrics of the whole text against brute force: no document is cut to a prefix."""

import math
import random
import re
from collections import Counter

from stylospark import registry
from stylospark.functions import text as T
from stylospark.operators import language_metrics as lm
from stylospark.operators import metrics, phrases, verdict_rows, verdicts
from stylospark.plans import detect


def nlls(texts):
    """nll of a pair by the interpolated bigram model of texts, and of a word after an unseen pair."""
    words = [t.lower().split() for t in texts]
    uni, bi, ctx = Counter(w for ws in words for w in ws), Counter(p for ws in words for p in zip(ws, ws[1:])), Counter(w for ws in words for w in ws[:-1])
    n, v = sum(uni.values()), len(uni)
    return lambda a, b: -math.log((0.7 * bi[a, b] / ctx[a] if bi[a, b] else 0) + 0.3 * (uni[b] + 1) / (n + v))


def mean(xs):
    xs = list(xs)
    return sum(xs) / len(xs)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_perplexity_reads_words_after_the_1024th(spark):
    texts = [" ".join(["the cat sat"] * 400 + [f"rare{i}" for i in range(900)]), "the cat sat on a mat and the dog ran off to the hills again"]
    nll = nlls(texts)
    got = {r.doc_id: r for r in metrics.compute(metrics.PERPLEXITY_FEATURES, frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ws = t.split()
        ce = mean(nll(a, b) for a, b in zip(ws, ws[1:]))
        assert math.isclose(got[i].overall_perplexity, math.exp(ce), abs_tol=2e-3)
        assert math.isclose(got[i].cross_entropy_score, min(1, ce / 5), abs_tol=2e-4)


def test_stability_reads_all_words_and_drops_a_tenth_of_each_block(spark):
    few = "one two three four five six seven"
    texts = [" ".join(["the cat sat"] * 100 + [f"odd{i % 97} cat" for i in range(1000)]), few, "the cat sat on a mat", "too few"]
    nll, clip = nlls(texts), lambda x: max(0.5, min(10.0, x))
    got = {r.doc_id: r for r in metrics.compute(lm.STABILITY_FEATURES, frame(spark, texts)).collect()}
    for i, t in enumerate(texts[:3]):
        ws = t.split()
        perturbed = []
        for k in (1, 2, 3):
            order = lambda p: (((i + 17) * 7919 + k * 104729 + p * 15485863) % 1000003, p)  # noqa: B023, E731
            gone = {p for at in range(0, len(ws), 1000) for p in sorted(range(at, min(at + 1000, len(ws))), key=order)[: max(at == 0, (min(at + 1000, len(ws)) - at) // 10)]}
            assert len(gone) == max(1, len(ws) // 10)
            left = [w for p, w in enumerate(ws) if p not in gone]
            perturbed.append(clip(mean(nll(a, b) for a, b in zip(left, left[1:]))))
        assert math.isclose(got[i].original_likelihood, clip(mean(nll(a, b) for a, b in zip(ws, ws[1:]))), abs_tol=2e-4)
        assert math.isclose(got[i].avg_perturbed_likelihood, mean(perturbed), abs_tol=2e-4) and got[i].num_perturbations == 3
    assert got[3].num_perturbations == 0


def test_domain_counts_words_after_the_400th(spark):
    terms = spark.createDataFrame([("legal", w) for w in ("contract", "law", "agreement")] + [("academic", w) for w in ("research", "thesis")], "domain string, term string")
    got = {r.doc_id: r for r in detect.domain(frame(spark, [" ".join(["plain"] * 450 + ["contract", "law", "agreement"]), "research thesis " + "plain " * 450 + "law law law"]), terms).collect()}
    assert got[0].domain == "legal" and got[0].confidence == 1.0
    assert got[1].domain == "legal" and got[1].secondary == "academic"


def test_cleaned_keeps_texts_over_the_limit_whole(spark):
    text = "Some plain words here. " * 23_000 + "Last sentence ends differently."
    r = T.clean(frame(spark, [text])).first()
    assert r.cleaned == text and r.char_count == len(text) > 500_000
    assert r.word_count == 4 * 23_000 + 4 and r.unique_words == 8 and r.sentence_count == 23_001
    assert r.errors == [f"Text too long: {len(text)} chars (maximum: 500000)"] and not r.is_valid


def test_perplexity_of_each_sentence(spark):
    sentences = ["the cat sat on the mat all day", "the dog ran after the cat all day", "zebras quarrel over unripe mangoes quietly", "the cat sat", "extraordinarily unquestionable words", "a b c d e f"]
    texts = [". ".join(sentences) + "!", "a b c d e f"]
    nll = nlls([re.sub(r"[.!]", "", t) for t in texts])
    got = {r.doc_id: r for r in metrics.compute(metrics.PERPLEXITY_FEATURES, frame(spark, texts)).collect()}
    ppl = [math.exp(mean(nll(a, b) for a, b in zip(s.split(), s.split()[1:]))) for s in sentences[:3]]
    mu = mean(ppl)
    r = got[0]
    assert r.num_sentences_analyzed == 3
    for have, want in ((r.avg_sentence_perplexity, mu), (r.std_sentence_perplexity, math.sqrt(mean((x - mu) ** 2 for x in ppl))), (r.min_sentence_perplexity, min(ppl)), (r.max_sentence_perplexity, max(ppl))):
        assert math.isclose(have, want, abs_tol=2e-3)
    r = got[1]
    assert r.num_sentences_analyzed == 0 and r.std_sentence_perplexity == 0
    assert r.avg_sentence_perplexity == r.min_sentence_perplexity == r.max_sentence_perplexity == r.overall_perplexity


P = "array<struct<metric:string,ai:double,human:double,mixed:double,confidence:double,error:string,weight:double,factor:double>>"


def judged(spark, rows, ai, failed):
    """Rows (doc_id, text, domain) as if judged with the given probabilities."""
    own = [(d, t, dom, [(m, p, 1 - p, 0.0, 0.6, "Failed" if failed(d, m) else None, 0.2, 1.0) for m, p in ai.items()]) for d, t, dom in rows]
    return spark.createDataFrame(own, f"doc_id long, text string, domain string, p {P}")


def test_highlights_of_short_sentences_and_documents_without_any(spark):
    texts = [(1, "Yes. No way! The cat sat on the mat all day long? Go.", "general"), (2, None, "general"), (3, " \n ", "general"), (4, " ... !!", "general"), (5, "Hello.", "general"), (6, "This one failed in all metrics.", "general")]
    a = judged(spark, texts, {"structural": 0.2, "entropy": 0.65, "perplexity": 0.9}, lambda d, m: m == "structural" and d == 1 or d == 6)
    marks = verdict_rows.highlights(a)
    got = {(r.doc_id, r.idx): r for r in marks.collect()}
    assert {k: r.sentence for k, r in got.items()} == {(1, 0): "No way", (1, 1): "The cat sat on the mat all day long", (2, 0): "No text content", (3, 0): "No text content", (4, 0): "... !!", (5, 0): "Hello", (6, 0): "This one failed in all metrics"}
    for k, want in {(1, 0): (0.65, 0.2), (2, 0): (0.5, 0.3), (3, 0): (0.5, 0.3), (4, 0): (0.2, 0.2), (5, 0): (0.2, 0.2), (6, 0): (0.5, 0.5)}.items():
        assert (got[k].ai_probability, got[k].confidence) == want
    assert got[1, 1].confidence > 0.2 and got[1, 0].colour == "medium-ai" and "entropy: " in got[1, 1].tooltip and "Length: 9 words" in got[1, 1].tooltip
    assert {r.doc_id: r.n_sentences for r in detect.risk(marks).collect()} == {1: 2, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1}
    html = {r.doc_id: r.html for r in detect.highlight_html(marks).collect()}[1]
    assert "No way</span>" in html and 'data-index="0"' in html and 'data-ai-probability="0.650000"' in html


def test_rules_of_each_domain_adjust_a_sentence(spark):
    plain = "Some people walked over green fields all day today"
    cases = {
        ("science", "Our algorithm walked over green fields all day"): 1.1, ("ai_ml", "This function walked over green fields all day"): 1.15, ("engineering", " ".join(["word"] * 36)): 1.05, ("creative", "Wow people walked over green fields all day"): 0.7,
        ("social_media", "They hope people walked over green fields again"): 0.8, ("blog_personal", "Some people walked over fields"): 0.8, ("legal", "According to people they walked over green fields"): 0.8, ("medical", "The diagnosis walked over green fields all day"): 1.1,
        ("academic", " ".join(["word"] * 41)): 1.1, ("business", "They leverage people walked over green fields all"): 1.05, ("marketing", "Perhaps people walked over green fields all day"): 0.9, ("journalism", " ".join(["word"] * 20)): 0.9, ("tutorial", "Firstly people walked over green fields all day"): 0.85,
        ("tutorial", "See step 1 over green fields all day long"): 0.8, ("tutorial", "People such as those over green fields all day"): 0.9, ("general", "People walked because fields all day were so green"): 0.9, ("general", "green fields green fields green fields over hills"): 1.1, ("general", plain): 1.0, ("legal", plain): 1.0,
    }
    ai = {"entropy": 0.5}
    rows = [(i, s + ".", d) for i, (d, s) in enumerate(cases)]
    got = {r.doc_id: r.ai_probability for r in verdict_rows.highlights(judged(spark, rows, ai, lambda d, m: False)).collect()}
    base = {r.doc_id: r.ai_probability for r in verdict_rows.highlights(judged(spark, [(i, t, "none") for i, t, _ in rows], ai, lambda d, m: False)).collect()}
    for i, factor in enumerate(cases.values()):
        assert math.isclose(got[i], max(base[i] - 0.3, min(base[i] + 0.3, base[i] * factor)), abs_tol=2e-6), (list(cases)[i], got[i], base[i])


def test_fingerprints_by_one_automaton():
    rows = [("a", "phrase", "of the"), ("a", "pattern", "the"), ("a", "starter", "so,"), ("b", "phrase", "he t"), ("b", "starter", "so,"), ("b", "starter", "now,"), ("c", "pattern", "zzz")]
    own = phrases.Fingerprints(rows)
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["of the ", "the", " t", "so, ", "now, ", ". ", "!", " x "]) for _ in range(rng.randint(0, 12)))
        want = []
        for m in "abc":
            hit = sum((3 if k == "phrase" else 2) for n, k, p in rows if n == m and k != "starter" and p in text)
            checks = sum(n == m and k != "starter" for n, k, _ in rows)
            first = [p for n, k, p in rows if n == m and k == "starter"]
            if first:
                pieces = re.split(r"[.!?]+", text)
                hit, checks = hit + 2 * sum(any(s.strip().startswith(p) for p in first) for s in pieces), checks + len(pieces)
            want.append(min(1.0, hit / (checks * 0.5)))
        assert own.scores(text) == want
    assert phrases.Fingerprints([]).scores("any") == []


def test_attribution_adds_the_rules_of_the_metrics(spark):
    docs = frame(spark, ["One cat sat by wide doors today. Two dogs ran from tall hills again. Six hens hid near old barns there.", "short"])
    got = {r.doc_id: r for r in detect.attribution(docs, spark.createDataFrame([], "model string, kind string, phrase string")).collect()}
    f = {n: metrics.compute(t, docs).where("doc_id = 0").first() for n, t in {"p": metrics.PERPLEXITY_FEATURES, "s": metrics.STRUCTURAL_FEATURES, "e": metrics.ENTROPY_FEATURES, "c": lm.SEMANTIC_FEATURES, "m": lm.STABILITY_FEATURES}.items()}
    x = dict.fromkeys(verdicts.MODELS, 0.0)
    low = f["p"].overall_perplexity
    fired = [(low < 25, "gpt-4", 0.15), (low < 25, "gpt-4-turbo", 0.125), (25 <= low < 35, "gpt-3.5-turbo", 0.1), (25 <= low < 35, "gemini-pro", 0.075), (f["s"].length_uniformity > 0.7, "claude-3-opus", 0.075), (f["s"].length_uniformity > 0.7, "claude-3-sonnet", 0.06),
             (f["c"].coherence_score > 0.8, "gpt-4", 0.105), (f["c"].coherence_score > 0.8, "gpt-4-turbo", 0.09), (f["e"].token_diversity > 0.7, "claude-3-opus", 0.12), (f["e"].token_diversity > 0.7, "gpt-4", 0.1), (0.4 <= f["m"].stability_score <= 0.6, "mixtral", 0.04), (0.4 <= f["m"].stability_score <= 0.6, "llama-3", 0.03)]
    assert sum(on for on, _, _ in fired) >= 4
    for on, model, gain in fired:
        x[model] += 0.35 * gain if on else 0
    # The style is that of no generator but by its sentence length, 7 words, or its punctuation, of which there is none but full stops.
    share = {k: (v + 0.09) / sum(y + 0.09 for y in x.values()) for k, v in x.items()}
    best = max(share, key=share.get)
    assert got[0].model == best and math.isclose(got[0].probability, share[best], abs_tol=1e-5)
    # Too short for the metrics: their defaults, of which stability 0.5 fires for mixtral and llama-3; the structural one has 1 as the
    # uniformity of a single sentence.
    assert got[1].model == "claude-3-opus" and math.isclose(got[1].probability, (0.09 + 0.35 * 0.075) / (16 * 0.09 + 0.35 * (0.075 + 0.06 + 0.04 + 0.03)), abs_tol=1e-5)


def test_language_of_scripts_that_tell_it(spark):
    texts = ["Привет как дела", "γεια σου κόσμε", "你好世界", "สวัสดี", "שלום עולם", "مرحبا", "नमस्ते", "안녕하세요", "ひらがな", "le chat et la maison de la ville dans un pays", "12"]
    assert {r.doc_id: r.language for r in detect.language(frame(spark, texts)).collect()} == dict(enumerate("ru el zh th he ar hi ko ja fr en".split()))


def test_identical_texts_are_scored_once(spark):
    docs = frame(spark, ["the same words in both of these documents, which are long enough", "another text of its own, which is also long enough to have a score"] * 2)
    one = detect.score_once(docs, lambda few: metrics.compute(metrics.ENTROPY, few))
    assert sorted(one.select("doc_id", "raw", "confidence", "mixed").collect()) == sorted(metrics.compute(metrics.ENTROPY, docs).select("doc_id", "raw", "confidence", "mixed").collect())
    assert {"raw", "confidence"} <= set(re.findall(r"\w+", registry.ORACLES["score_identical_once"]))
