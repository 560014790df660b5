"""Vector arithmetic as columns; elements count as doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to a norm before dividing by it.
EPSILON = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def normalised(a: Column) -> Column:
    size = norm(a) + EPSILON
    return F.transform(a, lambda x: x.cast("double") / size)


def percent_score(distance: Column) -> Column:
    """A cosine distance as a score of a hundred."""
    return 100 * (1 - F.abs(distance))


def mean_pool(vectors: Column, mask: Column) -> Column:
    """The mean of the vectors where the mask is 1: their sum over at least 1e-9."""
    width = F.size(F.element_at(vectors, 1))
    total = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m.cast("double")), F.lit(1e-9))
    zeros = F.transform(F.sequence(F.lit(1), width), lambda _: F.lit(0.0))
    summed = F.aggregate(F.arrays_zip(vectors.alias("v"), mask.alias("m")), zeros, lambda s, x: F.zip_with(s, x["v"], lambda p, q: p + q.cast("double") * x["m"].cast("double")))
    return F.transform(summed, lambda x: x / total)
