"""Column expressions on vectors, and the deterministic embedder that stands for a model offline."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for null or empty vectors, other lengths and zero norms."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm > 0)
    return F.when(usable, dot(a, b) / norm).otherwise(F.lit(0.0))


def hash_embedding(text: Column, size: int = 32) -> Column:
    """The bytes of the text's SHA-256 as numbers from 0 to 1, rounded to 6 places (size at most 32)."""
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    return F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.round(F.conv(F.substring(digest, 2 * i - 1, F.lit(2)), 16, 10).cast("double") / 255, 6))
