"""Vector arithmetic as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column, dims: int | None = None) -> Column:
    """Inner product; with ``dims`` it is unrolled, so that it stays in generated code."""
    if dims:
        total = F.get(a, F.lit(0)) * F.get(b, F.lit(0))
        for i in range(1, dims):
            total = total + F.get(a, F.lit(i)) * F.get(b, F.lit(i))
        return total
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Unit length; a zero vector stays as it is. The length is bound once, not taken again for each component."""
    bound = F.array(F.struct(a.alias("a"), norm(a).alias("n")))
    scaled = F.transform(bound, lambda s: F.when(s["n"] > 0, F.transform(s["a"], lambda x: x / s["n"])).otherwise(s["a"]))
    return F.get(scaled, F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 where one is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def fitted_to(a: Column, length: Column) -> Column:
    """``a`` cut or filled with zeros to a length."""
    return F.concat(F.slice(a, F.lit(1), F.least(F.size(a), length)), F.array_repeat(F.lit(0.0), F.greatest(length - F.size(a), F.lit(0))))


def fused(first: Column, second: Column, share: float = 0.6) -> Column:
    """Both features as unit vectors, blended ``share`` to the rest; the first alone where the second is null."""
    other = normalised(fitted_to(second, F.size(first)))
    blend = F.zip_with(normalised(first), other, lambda x, y: F.lit(share) * x + F.lit(1 - share) * y)
    return F.when(second.isNull(), normalised(first)).otherwise(normalised(blend))


def weighted_mean(scores: dict[Column, float] | list[tuple[Column, float]]) -> Column:
    """Weighted mean over the scores that aren't null; 0 without any weight."""
    pairs = list(scores.items()) if isinstance(scores, dict) else scores
    total = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for c, w in pairs), F.lit(0.0))
    value = sum((F.coalesce(c * F.lit(w), F.lit(0.0)) for c, w in pairs), F.lit(0.0))
    return F.when(total > 0, value / total).otherwise(F.lit(0.0))


def mean_of(*scores: Column) -> Column:
    return sum(scores[1:], scores[0]) / F.lit(float(len(scores)))
