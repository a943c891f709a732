"""Vector and decay expressions, in double precision throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Unit vector; null for a zero, empty or non-finite vector."""
    # The norm is bound to a variable: inside the inner function it would be evaluated for each element.
    scaled = F.transform(F.array(norm(a)), lambda n: F.when((n > 0) & (n < float("inf")), F.transform(a, lambda x: x.cast("double") / n)))
    return F.get(scaled, F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of unit vectors, clipped to [-1, 1]."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))


def rectified(c: Column) -> Column:
    return F.greatest(F.lit(0.0), c)


def temporal_weight(decay: float, age: Column) -> Column:
    """decay ^ age for a decay in (0, 1] and ages from 0; a negative age is an error."""
    if not 0 < decay <= 1:
        raise ValueError("decay lies in (0, 1]")
    weight = F.lit(1.0) if decay == 1 else F.pow(F.lit(decay), age)
    return F.when(age >= 0, weight).otherwise(F.raise_error(F.lit("negative age")).cast("double"))


def half_life_weight(half_life: float, age: Column, enabled: bool = True) -> Column:
    return F.pow(F.lit(0.5), age.cast("double") / F.lit(float(half_life))) if enabled else F.lit(1.0)


def pruning_is_safe(decay: float, window: Column, found: Column, kth: Column, k: int) -> Column:
    """Whether records of age ``window`` and more cannot enter the top ``k``: the bound is strict."""
    if decay >= 1:
        return F.lit(False)
    return F.coalesce((found >= k) & (kth > 0) & (F.pow(F.lit(decay), window) < kth), F.lit(False))


def minimum_safe_horizon(decay: float, kth: Column) -> Column:
    """Smallest window whose bound lies below the k-th score; null without decay or a positive score."""
    if decay >= 1:
        return F.lit(None).cast("long")
    return F.when(kth > 0, (F.floor(F.ln(kth) / F.ln(F.lit(decay))) + 1).cast("long"))


def recall(expected: Column, observed: Column) -> Column:
    """Share of expected ids observed; 1 where nothing is expected."""
    wanted = F.array_distinct(expected)
    return F.when(F.size(wanted) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(wanted, observed)) / F.size(wanted))
