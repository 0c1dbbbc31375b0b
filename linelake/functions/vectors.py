"""Distances of embedding columns. Element-wise sums are unrolled where the dimension is known (they stay in generated
code); otherwise they are folds over arrays."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UNROLL = 128


def _sum(a: Column, b: Column, term: Callable, dim: int | None) -> Column:
    """term(a[i], b[i]) added up in the order of i."""
    if dim is not None and dim <= UNROLL:
        return reduce(lambda x, y: x + y, [term(F.get(a, F.lit(i)).cast("double"), F.get(b, F.lit(i)).cast("double")) for i in range(dim)])
    return F.aggregate(F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda acc, x: acc + x)


def manhattan(a: Column, b: Column, dim: int | None = None) -> Column:
    return _sum(a, b, lambda x, y: F.abs(x - y), dim)


def squared_euclidean(a: Column, b: Column, dim: int | None = None) -> Column:
    return _sum(a, b, lambda x, y: (x - y) * (x - y), dim)


#: Rating by name: (value that the threshold holds against, default threshold, rating of what is kept). The Euclidean
#: threshold holds against the squared sum, the Manhattan one against the sum.
RATINGS: dict[str, tuple[Callable, float, Callable]] = {
    "manhattan": (manhattan, 64.0, lambda d: d),
    "euclidean": (squared_euclidean, 100.0, F.sqrt),
}


def register(name: str, distance: Callable, threshold: float, rating: Callable = lambda d: d) -> None:
    """Add a distance to RATINGS."""
    RATINGS[name] = (distance, threshold, rating)


def argmax(values: Column) -> Column:
    """Position (from 0) of the first largest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def scale_bytes(values: Column) -> Column:
    """Unsigned bytes as numbers from 0 to 1."""
    return F.transform(values, lambda x: x.cast("double") / 255.0)


def triplet_loss(anchor: Column, positive: Column, negative: Column, dim: int, margin: float = 0.6) -> Column:
    return F.greatest(squared_euclidean(anchor, positive, dim) - squared_euclidean(anchor, negative, dim) + F.lit(margin), F.lit(0.0))
