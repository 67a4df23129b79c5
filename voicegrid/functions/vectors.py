"""Vector and matrix expressions over array columns, computed in double."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to the product of the norms, so that identical unit vectors score a little under 1 and zero vectors 0.
COSINE_EPSILON = 1e-6


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, however often ``use`` mentions it, within lambdas too."""
    return F.element_at(F.transform(F.array(value), use), 1)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Similarity of two vectors; norms that are stored beside them spare two products a pair."""
    return dot(a, b) / ((norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b) + F.lit(COSINE_EPSILON))


def triplet_loss(anchor: Column, pos: Column, neg: Column, alpha: float) -> Column:
    return F.greatest(cosine(anchor, neg) - cosine(anchor, pos) + F.lit(float(alpha)), F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def softmax(v: Column) -> Column:
    """Over the elements of one array (the features of a frame)."""
    powers = once(doubles(v), lambda d: once(F.array_max(d), lambda most: F.transform(d, lambda x: F.exp(x - most))))
    return once(powers, lambda p: once(total(p), lambda whole: F.transform(p, lambda x: x / whole)))


def matrix_mean(m: Column) -> Column:
    """Mean of all cells of an array of rows."""
    cells = doubles(F.flatten(m))
    return total(cells) / F.size(cells)


def channel_mean(v: Column, channels: int) -> Column:
    """Mono samples of samples whose channels alternate; the rest of a division is left out."""
    samples = F.sequence(F.lit(0), F.floor(F.size(v) / channels).cast("int") - 1)
    return F.when(F.size(v) >= channels, F.transform(samples, lambda i: total(doubles(F.slice(v, i * channels + 1, channels))) / channels)).otherwise(F.array().cast("array<double>"))
