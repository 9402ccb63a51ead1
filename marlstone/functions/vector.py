"""Vector functions as column expressions; arithmetic is in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda acc, x: acc + x * x))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, from 0 to 2; a vector of length 0 has distance 1 to all."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, 1 - dot(a, b) / lengths).otherwise(F.lit(1.0))


def similarity(distance: Column) -> Column:
    return 1 - distance / 2


def token_vectors(v: Column, parts: int) -> Column:
    """A vector cut into equally long parts, which serve as the vectors of tokens."""
    width = (F.size(v) / parts).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice(v, i * width + 1, width))


def max_sim(query: Column, doc: Column) -> Column:
    """Mean over the query's token vectors of their best cosine with the document's, at least 0."""
    best = F.transform(query, lambda q: F.greatest(F.lit(0.0), F.array_max(F.transform(doc, lambda d: 1 - cosine_distance(q, d)))))
    n = F.size(query)
    score = F.aggregate(best, F.lit(0.0), lambda acc, x: acc + x) / n
    return F.when((n > 0) & (F.size(doc) > 0), F.round(score, 6)).otherwise(F.lit(0.0))
