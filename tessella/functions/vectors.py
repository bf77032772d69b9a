"""Column expressions over array<float|double> vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    """Inner product; the shorter vector decides nothing: missing elements make it null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v) -> Column:
    """Unit vector of v; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def is_zero(v) -> Column:
    return F.forall(v, lambda x: x == 0)


def l2_squared(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double")), F.lit(0.0), lambda s, d: s + d * d)


def cosine_from_l2(distance) -> Column:
    """Cosine of unit vectors from their squared distance, kept within [-1, 1]."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - distance / 2))


def pair_key(a, b) -> Column:
    """Key of an unordered pair."""
    return F.concat(F.least(a, b), F.lit("::"), F.greatest(a, b))
