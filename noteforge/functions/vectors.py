"""Vector columns: arrays of floats, accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12
#: Allowed distance of a norm from 1.
NORM_TOLERANCE = 1e-4 + 1e-4


def dot(a: Column, b: Column) -> Column:
    """inner product in double; null if a length differs or a component is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """divided by the norm, which counts at least EPS."""
    # the norm is the element of an array of one, so it is taken once and not for each component
    return F.element_at(F.transform(F.array(F.greatest(norm(v), F.lit(EPS))), lambda n: F.transform(v, lambda x: x.cast("double") / n)), 1)


def finite(v: Column) -> Column:
    """Not null and without null, NaN or infinite components."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True))


def usable(v: Column) -> Column:
    """Finite and not zero: what strict normalisation accepts."""
    return finite(v) & (norm(v) > 0)


def vector_fault(v: Column) -> Column:
    """F16: why strict normalisation refuses a vector, or null."""
    return F.when(v.isNull(), "null").when(~finite(v), "not finite").when(norm(v) <= 0, "zero")


def is_unit(v: Column, tolerance: float = NORM_TOLERANCE) -> Column:
    """finite, and its norm is 1 within the tolerance."""
    return F.coalesce(finite(v) & (F.abs(norm(v) - 1) <= tolerance), F.lit(False))
