"""Fixed values that results depend on, and the small tables made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

METRICS = ["structural", "perplexity", "entropy", "semantic_analysis", "linguistic", "multi_perturbation_stability"]

# Fixed values. Per domain: AI thresholds of the metrics in the order above, human thresholds of perplexity
# and entropy (the others' are 1 - AI threshold), weights, threshold of the ensemble.
DOMAIN_ROWS = """
general        .55 .52 .48 .55 .58 .60  .48 .52  .20 .25 .15 .18 .12 .10  .40
academic       .58 .50 .45 .58 .62 .65  .45 .50  .18 .26 .14 .20 .14 .08  .42
creative       .52 .55 .50 .52 .55 .58  .50 .55  .18 .22 .16 .20 .16 .08  .38
ai_ml          .57 .51 .47 .57 .61 .64  .46 .50  .18 .26 .14 .20 .14 .08  .41
software_dev   .58 .50 .46 .58 .60 .63  .45 .50  .17 .27 .14 .20 .14 .08  .41
technical_doc  .59 .49 .45 .59 .62 .65  .44 .49  .18 .27 .13 .20 .14 .08  .42
engineering    .58 .50 .46 .58 .61 .64  .45 .50  .18 .26 .14 .20 .14 .08  .41
science        .58 .51 .46 .58 .62 .64  .46 .50  .18 .26 .14 .20 .14 .08  .42
business       .56 .52 .48 .56 .60 .62  .48 .52  .18 .24 .15 .19 .15 .09  .40
legal          .60 .50 .44 .60 .63 .66  .44 .48  .17 .27 .13 .20 .15 .08  .43
medical        .59 .50 .45 .59 .62 .65  .45 .49  .17 .27 .13 .20 .15 .08  .43
journalism     .56 .52 .48 .56 .58 .62  .48 .52  .18 .24 .15 .20 .15 .08  .40
marketing      .54 .53 .49 .54 .57 .61  .49 .53  .19 .23 .15 .19 .16 .08  .39
social_media   .52 .54 .50 .52 .55 .60  .50 .54  .18 .20 .17 .18 .18 .09  .36
blog_personal  .53 .54 .50 .53 .56 .59  .50 .54  .19 .22 .16 .19 .16 .08  .38
tutorial       .56 .52 .48 .56 .59 .62  .48 .52  .18 .25 .15 .19 .15 .08  .40
"""

# Fixed values. Performance factors per domain, metrics in the order above.
PERFORMANCE_ROWS = """
general        1.0 1.0 1.0 1.0 1.0 1.0
academic       1.2 1.3 0.9 1.1 1.3 0.8
creative       0.9 1.1 1.2 1.0 1.1 0.9
ai_ml          1.2 1.3 0.9 1.1 1.2 0.8
software_dev   1.2 1.3 0.9 1.1 1.2 0.8
technical_doc  1.3 1.3 0.9 1.2 1.2 0.8
engineering    1.2 1.3 0.9 1.1 1.2 0.8
science        1.2 1.3 0.9 1.1 1.2 0.8
business       1.1 1.2 1.0 1.1 1.1 0.9
legal          1.3 1.3 0.9 1.2 1.3 0.8
medical        1.2 1.3 0.9 1.2 1.2 0.8
journalism     1.1 1.2 1.0 1.1 1.1 0.8
marketing      1.0 1.1 1.1 1.0 1.2 0.8
social_media   0.8 1.0 1.3 0.9 0.7 0.9
blog_personal  0.9 1.1 1.2 1.0 1.0 0.8
tutorial       1.1 1.2 1.0 1.1 1.1 0.8
"""

# Words that tell six Latin-script languages apart, in order of preference.
LATIN_WORDS = {
    "en": "the and is in to of a that it with for on this are was be have from or by",
    "es": "el la de que y en un por con no una para es al como del los se las su",
    "fr": "le de un être et à il avoir ne je son que ce du quel elle dans pour au avec",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "it": "di e il la che per un in è a non una da sono come del ma si nel anche",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais",
}

# Codes of the languages that can be named.
LANGUAGES = "en es fr de it pt ru zh ja ko ar hi nl pl tr sv vi id th el he cs ro da fi no"

# Ranges of code points of ten scripts, and the language each stands for.
SCRIPTS = {
    "latin": ("A-zÀ-ɏ", None),
    "cyrillic": ("Ѐ-ӿ", "ru"),
    "arabic": ("؀-ۿݐ-ݿ", "ar"),
    "chinese": ("一-鿿㐀-䶿", "zh"),
    "japanese": ("぀-ゟ゠-ヿ", "ja"),
    "korean": ("가-힯ᄀ-ᇿ", "ko"),
    "devanagari": ("ऀ-ॿ", "hi"),
    "greek": ("Ͱ-Ͽ", "el"),
    "hebrew": ("֐-׿", "he"),
    "thai": ("฀-๿", "th"),
}

# Abbreviations whose period ends no sentence.
ABBREVIATIONS = "dr mr mrs ms prof sr jr ph.d inc ltd corp co vs etc e.g i.e al fig vol no approx est min max avg dept assoc bros u.s u.k a.m p.m b.c a.d st ave blvd".split()

# Mojibake and its repair, in the order in which it is applied.
MOJIBAKE = [("â€™", "'"), ("â€œ", '"'), ("â€", '"'), ("Ã©", "é"), ("Ã¨", "è"), ("Ã ", "à"), ("â‚¬", "€")]

# Colour classes of a sentence by AI probability: upper bound (exclusive but for the last), class, risk weight.
COLOURS = [(0.10, "very-high-human", 0.0), (0.25, "high-human", 0.1), (0.40, "medium-human", 0.2), (0.60, "uncertain", 0.4), (0.75, "medium-ai", 0.6), (0.90, "high-ai", 0.8), (1.01, "very-high-ai", 1.0)]
MIXED_RISK = 0.7


# Fixed values. Per domain: sensitivity of fingerprints, factor of sentence lengths, weights of perplexity, structural, entropy,
# semantic and linguistic rules, and shares of fingerprints, style and rules in a generator's score.
ATTRIBUTION_ROWS = """
general        1.00 1.00  1.0 1.0 1.0 1.0 1.0  .35 .30 .35
academic       1.20 1.10  1.2 1.0 0.9 1.1 1.3  .30 .35 .35
creative       0.90 0.95  0.9 0.9 1.2 1.0 1.3  .40 .30 .30
ai_ml          1.15 1.05  1.3 1.0 0.9 1.2 1.2  .28 .37 .35
software_dev   1.15 1.05  1.2 1.1 0.9 1.1 1.0  .27 .38 .35
technical_doc  1.10 1.05  1.2 1.1 0.9 1.2 1.1  .25 .40 .35
engineering    1.10 1.05  1.2 1.1 0.9 1.1 1.2  .28 .37 .35
science        1.20 1.08  1.2 1.0 0.9 1.2 1.3  .30 .35 .35
business       1.05 1.00  1.1 1.0 1.0 1.2 1.1  .33 .35 .32
legal          1.25 1.12  1.2 1.1 0.9 1.3 1.3  .28 .40 .32
medical        1.20 1.08  1.2 1.0 0.9 1.2 1.2  .30 .38 .32
journalism     1.00 0.95  1.1 1.0 1.0 1.1 1.1  .35 .33 .32
marketing      0.95 0.92  1.0 1.0 1.1 1.1 1.2  .38 .32 .30
social_media   0.80 0.85  1.0 0.8 1.3 0.9 0.9  .45 .35 .20
blog_personal  0.90 0.95  1.0 0.9 1.2 1.0 1.1  .42 .32 .26
tutorial       1.00 1.00  1.1 1.0 1.0 1.1 1.1  .33 .35 .32
"""

# What gives away the style of a sentence; phrases are looked for in its lower-case text, code in the text itself.
SIGNS = {
    "citation": ["et al.", "ibid.", "cf.", "e.g.", "i.e.", "vol.", "pp.", "ed.", "trans.", "reference", "cited", "according to"],
    "informal": ["lol", "omg", "btw", "imo", "tbh", "afaik", "smh", "👋", "😂", "❤️", "haha", "wow", "awesome"],
    "technical": ["hereinafter", "whereas", "aforementioned", "diagnosis", "prognosis", "etiology", "algorithm", "neural network", "machine learning", "api", "endpoint", "database", "quantum", "thermodynamics", "hypothesis", "methodology"],
    "ambiguous": ["perhaps", "maybe", "possibly", "likely", "appears to", "seems to", "might be", "could be"],
    "complex": ["which", "that", "although", "because", "while", "when", "if", "however", "therefore"],
    "emotional": ["feel", "believe", "think", "wonder", "hope", "wish", "love", "hate", "frustrating", "exciting"],
    "jargon": ["synergy", "leverage", "bandwidth", "circle back", "touch base", "value add", "core competency"],
    "instruction": ["step by step", "firstly", "secondly", "finally", "note that", "remember to", "make sure"],
    "steps": ["step 1", "step 2", "step 3", "step one", "step two", "first step", "next step"],
    "examples": ["for example", "for instance", "such as", "e.g.", "as an example"],
    "code": ["function", "variable", "class", "method", "import", "def ", "void ", "public ", "private "],
}
# Per group of domains the rules for a sentence's probability, of which the first that holds counts: a sign, or a range of its number of words, and a factor.
SENTENCE_RULES = [
    ("ai_ml software_dev technical_doc engineering science", [("technical", 1.1), ("code", 1.15), ((36, None), 1.05)]),
    ("creative social_media blog_personal", [("informal", 0.7), ("emotional", 0.8), ((0, 9), 0.8)]),
    ("academic legal medical", [("citation", 0.8), ("technical", 1.1), ((41, None), 1.1)]),
    ("business marketing journalism", [("jargon", 1.05), ("ambiguous", 0.9), ((15, 25), 0.9)]),
    ("tutorial", [("instruction", 0.85), ("steps", 0.8), ("examples", 0.9)]),
    ("general", [("complex", 0.9), ("repetition", 1.1)]),
]


def domains() -> list[str]:
    return [line.split()[0] for line in DOMAIN_ROWS.split("\n") if line]


def threshold_rows() -> list[tuple]:
    """(domain, metric, ai_thr, human_thr, conf_mult, weight), 96 rows."""
    out = []
    for line in filter(None, DOMAIN_ROWS.split("\n")):
        d, *v = line.split()
        ai, own, w = v[:6], v[6:8], v[8:14]
        for i, m in enumerate(METRICS):
            human = float(own[i - 1]) if i in (1, 2) else round(1 - float(ai[i]), 2)
            out.append((d, m, float(ai[i]), human, 1.0, float(w[i])))
    return out


def ensemble_rows() -> list[tuple]:
    return [(line.split()[0], float(line.split()[-1])) for line in DOMAIN_ROWS.split("\n") if line]


def performance_rows() -> list[tuple]:
    return [(line.split()[0], m, float(f)) for line in PERFORMANCE_ROWS.split("\n") if line for m, f in zip(METRICS, line.split()[1:])]


def attribution_rows() -> list[tuple]:
    return [(line.split()[0], *map(float, line.split()[1:])) for line in ATTRIBUTION_ROWS.split("\n") if line]


def language_rows() -> list[tuple]:
    return [(lang, i, w) for i, (lang, ws) in enumerate(LATIN_WORDS.items()) for w in ws.split()]


SCHEMAS = {
    "thresholds": ("domain string, metric string, ai_thr double, human_thr double, conf_mult double, weight double", threshold_rows),
    "domain_cfg": ("domain string, ensemble_threshold double", ensemble_rows),
    "performance": ("domain string, metric string, factor double", performance_rows),
    "attribution": ("domain string, sensitivity double, lengths double, perplexity double, structural double, entropy double, semantic double, linguistic double, by_phrase double, by_style double, by_rule double", attribution_rows),
    "stopwords": ("lang string, ord int, word string", language_rows),
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = SCHEMAS[name]
    return spark.createDataFrame(rows(), schema)


def values_sql(name: str) -> str:
    """The same table as a VALUES list for other engines."""
    schema, rows = SCHEMAS[name]
    cols = ", ".join(c.split()[0] for c in schema.split(", "))
    lit = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v!r}::DOUBLE" if isinstance(v, float) else repr(v)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows())}) t({cols}))"

# Other names of the domains, in the order in which parts of names are matched.
DOMAIN_ALIASES = """
general default generic
academic education research university scholarly
creative fiction literature story narrative
ai_ml ai machinelearning ml artificialintelligence neural
software_dev software code programming development dev
technical_doc technical tech documentation docs manual
engineering engineer technical_engineering
science scientific research_science
business corporate commercial enterprise
legal law contract court juridical
medical healthcare clinical medicine health
journalism news reporting media press
marketing advertising promotional brand sales
social_media social casual informal posts
blog_personal blog personal diary lifestyle
tutorial guide howto instructional educational walkthrough
"""


def domain_aliases() -> list[tuple[str, str]]:
    """Pairs of a name and its domain, the first name on each line."""
    return [(a, line.split()[0]) for line in DOMAIN_ALIASES.strip().splitlines() for a in line.split()]
