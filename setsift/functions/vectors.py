"""Dense vector expressions on ``array<float|double>`` columns (JVM-side, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import col

def _as_col(c: Column | str) -> Column:
    return col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of element products, accumulated left to right in double."""
    prod = F.zip_with(_as_col(a), _as_col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def sq_norm(a: Column | str) -> Column:
    return F.aggregate(
        F.transform(_as_col(a), lambda x: x.cast("double") * x.cast("double")),
        F.lit(0.0).cast("double"),
        lambda acc, v: acc + v,
    )


def cosine(a: Column | str, b: Column | str, norm_a: Column | None = None) -> Column:
    """Cosine similarity; 0 when either vector has zero length (library convention).

    ``norm_a``: the length of ``a``, where several cosines share it."""
    denom = (F.sqrt(sq_norm(a)) if norm_a is None else norm_a) * F.sqrt(sq_norm(b))
    return F.when(denom == F.lit(0.0), F.lit(0.0)).otherwise(dot(a, b) / denom)
