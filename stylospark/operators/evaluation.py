"""Verdicts against what is known: three classes, rates of the generated class; names of domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .features import let

CLASSES = {"ai": "AI-Generated", "human": "Human-Written", "mixed": "Mixed (AI + Human)"}


def _joined(verdicts: DataFrame, actual: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return verdicts.select("doc_id", "verdict").join(actual.where(F.col("actual").isin(*CLASSES)).select("doc_id", "actual", *by), "doc_id")


def confusion(verdicts: DataFrame, actual: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """actual (ai, human, mixed) of a table doc_id, actual: its documents (n), how many have
    each verdict, `uncertain` those with none of the three, and the share that is right.
    Documents without a known class are left out; `by` names columns of actual."""
    is_ = {c: F.coalesce(F.col("verdict") == name, F.lit(False)) for c, name in CLASSES.items()}
    counts = [F.count_if(x).alias(f"predicted_{c}") for c, x in is_.items()]
    right = F.count_if(F.coalesce(F.col("verdict") == F.element_at(F.create_map(*[F.lit(x) for p in CLASSES.items() for x in p]), F.col("actual")), F.lit(False)))
    other = F.count_if(~(is_["ai"] | is_["human"] | is_["mixed"]))
    return _joined(verdicts, actual, by).groupBy(*by, "actual").agg(F.count(F.lit(1)).alias("n"), *counts, other.alias("predicted_uncertain"), F.round(right / F.count(F.lit(1)), 6).alias("right"))


def rates(verdicts: DataFrame, actual: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """n, accuracy over three classes, and of the generated class against the others:
    precision, recall, f1, false_positive_rate, false_negative_rate; null where there
    is nothing to divide by."""
    c = confusion(verdicts, actual, by)
    right = sum((F.when(F.col("actual") == k, F.col(f"predicted_{k}")).otherwise(0) for k in CLASSES), F.lit(0))
    ai, all_ai = F.col("actual") == "ai", F.col("predicted_ai")
    pick = lambda cond, x: F.sum(F.when(cond, x).otherwise(0))
    s = c.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(right).alias("r"), pick(ai, all_ai).alias("tp"), pick(~ai, all_ai).alias("fp"), pick(ai, F.col("n") - all_ai).alias("fn"), pick(~ai, F.col("n") - all_ai).alias("tn"))
    part = lambda a, b: F.round(F.when(b > 0, a / b), 6)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return s.where("n is not null").select(
        *by, "n", part(F.col("r"), F.col("n")).alias("accuracy"), part(tp, tp + fp).alias("precision"), part(tp, tp + fn).alias("recall"),
        part(2 * tp, 2 * tp + fp + fn).alias("f1"), part(fp, fp + tn).alias("false_positive_rate"), part(fn, fn + tp).alias("false_negative_rate"),
    )


def domain_named(name: Column) -> Column:
    """The domain that a name means: lower case, trimmed, one of the sixteen or of their
    aliases as it stands or with _ for spaces, else the first alias that is part of it
    or that it is part of; null for none, a null or an empty name."""
    pairs = fixed.domain_aliases()
    of = F.create_map(*[F.lit(x) for p in pairs for x in p])

    def meant(n: Column) -> Column:
        part = F.filter(F.array(*[F.lit(a) for a, _ in pairs]), lambda a: F.contains(a, n) | F.contains(n, a))
        exact = F.coalesce(F.try_element_at(of, n), F.try_element_at(of, F.replace(n, F.lit(" "), F.lit("_"))))
        return F.coalesce(exact, F.try_element_at(of, F.get(part, F.lit(0))))

    # trimmed once a name, not once an alias
    return F.when(name != "", let(F.regexp_replace(F.lower(name), r"^\s+|\s+$", ""), meant))


def domain_meant(name: str) -> str | None:
    """domain_named of one name, for plans whose domain is the same for all documents."""
    pairs, n = fixed.domain_aliases(), name.lower().strip()
    exact = dict(pairs).get(n) or dict(pairs).get(n.replace(" ", "_"))
    return exact or next((d for a, d in pairs if n in a or a in n), None) if name else None


#: DuckDB: domain_named of the table {names} (name), by joins with the table {aliases} (ord, alias, domain).
NAMED_SQL = """
SELECT n.name, CASE WHEN n.name <> '' THEN COALESCE(a.domain, b.domain, c.domain) END AS domain
FROM {names} n LEFT JOIN {aliases} a ON a.alias = trim(lower(n.name)) LEFT JOIN {aliases} b ON b.alias = replace(trim(lower(n.name)), ' ', '_')
  LEFT JOIN (SELECT n.name, min_by(a.domain, a.ord) AS domain FROM {names} n JOIN {aliases} a ON contains(a.alias, trim(lower(n.name))) OR contains(trim(lower(n.name)), a.alias) GROUP BY n.name) c ON c.name = n.name
"""
