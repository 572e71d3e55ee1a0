"""Column expressions over ``array<double>`` vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def constant(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def sq_l2(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(sq_l2(a, b))


def l2_normalise(vector: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    norm = F.sqrt(_total(F.transform(vector, lambda x: x * x)))
    return F.transform(vector, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scaled(vector: Column, factor: Column) -> Column:
    return F.transform(vector, lambda x: x * factor)


WIDE_DIMS = 64
"""Up to this width, known when planning, a vector aggregate is one plain aggregate per dimension: these are
compiled together and shuffle nothing but the numbers. Wider vectors go through Summarizer."""


def _per_dimension(fn, vector: Column, dims: int | None) -> Column | None:
    if dims is None or dims > WIDE_DIMS:
        return None
    return F.array(*[fn(F.get(vector, F.lit(i))) for i in range(dims)])


def vector_sum(vector: Column, weight: Column | None = None, dims: int | None = None) -> Column:
    """Aggregate: element-wise sum, weighted by a positive ``weight`` if given. ``dims`` is the width, if
    known; ``vector`` should then be a plain column."""
    plain = _per_dimension(lambda v: F.sum(v if weight is None else v * weight), vector, dims)
    if plain is not None:
        return plain
    dense = array_to_vector(vector)
    return vector_to_array(Summarizer.sum(dense) if weight is None else Summarizer.sum(dense, weight))


def vector_mean(vector: Column, dims: int | None = None) -> Column:
    """Aggregate: element-wise mean."""
    plain = _per_dimension(F.avg, vector, dims)
    return vector_to_array(Summarizer.mean(array_to_vector(vector))) if plain is None else plain


def vector_max(vector: Column, dims: int | None = None) -> Column:
    """Aggregate: element-wise maximum."""
    plain = _per_dimension(F.max, vector, dims)
    return vector_to_array(Summarizer.max(array_to_vector(vector))) if plain is None else plain


def concat_array_columns(names: Sequence[str]) -> Column:
    """Number columns as one vector."""
    return F.array(*[F.col(n).cast("double") for n in names])
