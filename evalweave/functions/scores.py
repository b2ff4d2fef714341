"""Score formulas and rounding, as column expressions.

Rounding is ``floor(x * 10**n + 0.5) / 10**n`` in doubles, which any IEEE engine repeats exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, places: int) -> Column:
    scale = float(10**places)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def r2(x: Column) -> Column:
    return rounded(x, 2)


def r3(x: Column) -> Column:
    return rounded(x, 3)


def r4(x: Column) -> Column:
    return rounded(x, 4)


def _known(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def label_score(label: Column) -> Column:
    """1, 0.5 or 0 for the three grounding labels; anything else, null included, is 0.5."""
    return F.when(label == "Grounded", F.lit(1.0)).when(label == "Likely Hallucination", F.lit(0.0)).otherwise(F.lit(0.5))


def trust_score(hallucination: Column, correctness: Column, relevance: Column, clarity: Column, safety: Column, tool_accuracy: Column | None = None) -> Column:
    """Mean of five, or with a known tool accuracy .35 quality + .35 grounding + .30 tool use."""
    grounded = label_score(hallucination)
    four = [_known(c) for c in (correctness, relevance, clarity, safety)]
    total = four[0] + four[1] + four[2] + four[3]
    plain = r3((grounded + total) / F.lit(5.0))
    if tool_accuracy is None:
        return plain
    agent = r3(total / F.lit(4.0) * F.lit(0.35) + grounded * F.lit(0.35) + tool_accuracy * F.lit(0.30))
    return F.when(tool_accuracy.isNull(), plain).otherwise(agent)


def leaderboard_score(correctness: Column, relevance: Column, clarity: Column, safety: Column) -> Column:
    c, r, k, s = (_known(x) for x in (correctness, relevance, clarity, safety))
    return r2(c * F.lit(0.4) + r * F.lit(0.2) + k * F.lit(0.2) + s * F.lit(0.2))


def simulated_trust(correctness: Column, relevance: Column, clarity: Column, safety: Column) -> Column:
    return r3((correctness + relevance + clarity + safety) / F.lit(4.0))


def agent_trust(tool_accuracy: Column) -> Column:
    return r3(F.lit(0.35 * 0.80) + F.lit(0.35 * 0.75) + tool_accuracy * F.lit(0.30))


def confidence(faithfulness: Column, context: Column, risk: Column) -> Column:
    return r4(faithfulness * F.lit(0.4) + context * F.lit(0.4) + (F.lit(1.0) - risk) * F.lit(0.2))


def confidence_tier(score: Column) -> Column:
    return F.when(score >= 0.70, "High").when(score >= 0.40, "Medium").otherwise("Low")


def score_badge(score: Column) -> Column:
    return F.when(score > 0.7, "green").when(score > 0.4, "yellow").otherwise("red")


def risk_badge(risk: Column) -> Column:
    return F.when(risk < 0.2, "green").when(risk < 0.5, "yellow").otherwise("red")


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def distance_to_similarity(d: Column) -> Column:
    """Similarity from a squared distance of unit vectors, not below zero."""
    return r4(F.greatest(F.lit(0.0), F.lit(1.0) - d / F.lit(2.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine in doubles; 0 where either vector is zero. Norms known already can be given."""
    scale = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.coalesce(F.try_divide(dot(a, b), scale), F.lit(0.0))
