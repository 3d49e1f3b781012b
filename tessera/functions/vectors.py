"""Vector column expressions (C3-C5, C8). All JVM-side higher-order functions.

Spark has no vector distance functions, so these are written with ``aggregate``,
``zip_with`` and ``transform``. A value that must be computed once per row (a norm)
is bound through a one-element array so the inner lambda does not recompute it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.config import NORM_EPS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a lambda over a Column)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a, b) -> Column:
    a, b = _col(a), _col(b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def sq_norm(a) -> Column:
    a = _col(a)
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x)


def l2_normalize(v, eps: float = NORM_EPS) -> Column:
    """V / (||v|| + eps); the zero vector stays zero."""
    v = _col(v)
    return let(F.sqrt(sq_norm(v)) + F.lit(eps), lambda n: F.transform(v, lambda x: x / n))


def cosine_similarity(a, b) -> Column:
    """C4: dot / (||a|| * ||b||); 0 when either vector is zero. Not clipped."""
    a, b = _col(a), _col(b)
    na, nb = sq_norm(a), sq_norm(b)
    return F.when((na > 0) & (nb > 0), dot(a, b) / (F.sqrt(na) * F.sqrt(nb))).otherwise(F.lit(0.0))


def clip01(x) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _col(x)))


def inner_product_clip(a, b) -> Column:
    """Inner product of (already normalised) vectors, clipped to [0, 1]."""
    return clip01(dot(a, b))


def blend_vectors(q, m, alpha: float = 0.5) -> Column:
    """normalise(q + alpha * m)."""
    q, m = _col(q), _col(m)
    return l2_normalize(F.zip_with(q, m, lambda x, y: x + F.lit(alpha) * y))


def squared_distance(a, b) -> Column:
    a, b = _col(a), _col(b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def to_double_array(v) -> Column:
    return _col(v).cast("array<double>")
