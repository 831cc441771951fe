"""Vector column functions, evaluated JVM-side with higher-order functions
(``zip_with``/``aggregate``/``transform``) so they stay inside whole-stage
codegen. All arithmetic is in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double_array(x) -> Column:
    """To ``array<double>`` (non-array input -> NULL)."""
    return _c(x).cast("array<double>")


def dot(a, b) -> Column:
    """Sum of element products (arrays of equal length)."""
    return F.aggregate(F.zip_with(as_double_array(a), as_double_array(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(as_double_array(a), F.lit(0.0), lambda acc, v: acc + v * v))


def l2_normalize(a) -> Column:
    """V / ||v||; a zero vector stays zero (norm 0 -> divide by 1).

    The norm is accumulated once and bound in the ``finish`` step, so the
    cost is linear in the dimension (a norm referenced inside ``transform``
    would be re-evaluated per element)."""
    arr = as_double_array(a)

    def finish(acc):
        d = F.sqrt(acc)
        d = F.when(d == 0, F.lit(1.0)).otherwise(d)
        return F.transform(arr, lambda x: x / d)
    return F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v * v, finish)


def cosine(a, b) -> Column:
    """Cosine similarity; 0 when either vector is zero (undefined 0/0)."""
    den = norm(a) * norm(b)
    return F.when(den == 0, F.lit(0.0)).otherwise(dot(a, b) / den)


def clamp0(x) -> Column:
    """Similarity floor at 0 (applied after ordering)."""
    return F.greatest(F.lit(0.0), _c(x))
