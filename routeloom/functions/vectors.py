"""Cost and preference vectors (array<double>) as column expressions; they stay inside code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(cost: Column | str, alpha: Column | str | Sequence[float]) -> Column:
    """Scalar product; the weight of an edge under a preference.  A list of numbers gives a constant preference."""
    cost = F.col(cost) if isinstance(cost, str) else cost
    if isinstance(alpha, (list, tuple)):
        terms = [F.get(cost, F.lit(i)) * F.lit(float(a)) for i, a in enumerate(alpha)]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return total
    alpha = F.col(alpha) if isinstance(alpha, str) else alpha
    return F.aggregate(F.zip_with(cost, alpha, lambda c, a: c * a), F.lit(0.0), lambda x, y: x + y)


def vector_add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def dominates(a: Column, b: Column) -> Column:
    """Whether ``a`` is at most ``b`` in every component, so never worse for any preference."""
    return F.forall(F.zip_with(a, b, lambda x, y: x <= y), lambda x: x)


def normalise_preference(alpha: Column) -> Column:
    """Divided by its sum; equal weights if that is zero."""
    total = F.aggregate(alpha, F.lit(0.0), lambda x, y: x + y)
    size = F.size(alpha)
    return F.when(total == 0, F.transform(alpha, lambda x: F.lit(1.0) / size)).otherwise(F.transform(alpha, lambda x: F.try_divide(x, total)))
