"""Vector arithmetic as column expressions, inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _fold(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """Sum of products; an error where the lengths differ."""
    product = _fold(F.zip_with(a, b, lambda x, y: x * y))
    return F.when(F.size(a) == F.size(b), product).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


def norm(a: Column) -> Column:
    return F.sqrt(_fold(F.transform(a, lambda x: x * x)))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of the angle; 0 where either vector is zero."""
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def euclidean_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.when(F.size(a) == F.size(b), F.sqrt(_fold(squares))).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


def normalised(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    length = norm(a)
    return F.when(length == 0, a).otherwise(F.transform(a, lambda x: x / length))


def zeros(dimensions: int) -> Column:
    return F.array_repeat(F.lit(0.0), dimensions)


def similarity_label(similarity: Column) -> Column:
    """A percentage with one decimal, of a similarity limited to 0..1."""
    return F.format_string("%.1f%%", F.least(F.greatest(similarity, F.lit(0.0)), F.lit(1.0)) * 100)


def similarity(distance: Column, strict: bool = True) -> Column:
    """1 - distance; strict: an error outside 0..1, else limited to it."""
    s = 1 - distance
    if not strict:
        return F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))
    return F.when((s >= 0) & (s <= 1), s).otherwise(F.raise_error(F.concat(F.lit("a similarity is in 0..1, not "), s.cast("string"))).cast("double"))
