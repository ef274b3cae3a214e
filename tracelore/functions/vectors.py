"""Vector expressions. Norms and dots in double, whatever the stored width."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Unit vector, null for an empty or zero one."""
    length = norm(a)
    return F.when((F.size(a) > 0) & (length > 0), F.transform(a, lambda x: x.cast("double") / length))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, unequal or zero vectors."""
    scale = norm(a) * norm(b)
    fits = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(fits & (scale > 0), dot(a, b) / scale).otherwise(F.lit(0.0))


def clears_rounded_floor(cos: Column, floor: float) -> Column:
    """(1 + cos) / 2 rounded to 7 places, so a cosine of exactly the floor passes."""
    return F.round((F.lit(1.0) + cos) / 2, 7) >= F.lit((1.0 + floor) / 2)
