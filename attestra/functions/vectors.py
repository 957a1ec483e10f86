"""Functions on arrays of numbers; arithmetic is in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 where the lengths differ; the denominator is at least 1e-12."""
    return F.when(F.size(a) != F.size(b), 0.0).otherwise(dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12)))


def softmax(a: Column) -> Column:
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(e, lambda x: x / total(e))


def entropy(p: Column) -> Column:
    """In nats; zeros count nothing."""
    return -total(F.transform(p, lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)))


def argmax(a: Column) -> Column:
    """Index from 0 of the first greatest value; null if empty."""
    return F.when(F.size(a) > 0, F.array_position(a, F.array_max(a)) - 1).cast("int")


def margin(a: Column) -> Column:
    """Greatest less second greatest value; 0 for fewer than two."""
    s = F.sort_array(a, asc=False)
    return F.when(F.size(a) < 2, 0.0).otherwise(F.element_at(s, 1) - F.try_element_at(s, F.lit(2)))


def stance_probabilities(score: Column, buckets: int = 10, tau: float = 1.0) -> Column:
    """Soft membership of a score in centres 1..buckets."""
    return softmax(F.transform(F.sequence(F.lit(1), F.lit(buckets)), lambda c: -(score - c) * (score - c) / tau))


def expectation(p: Column) -> Column:
    """Of 1..n under p."""
    return total(F.transform(p, lambda x, i: x * (i + 1)))


def coral_decode(logits: Column) -> Column:
    """Ordinal level: how many cumulative probabilities exceed one half."""
    return F.size(F.filter(logits, lambda x: 1 / (1 + F.exp(-x)) > 0.5))


def sparsemax(z: Column) -> Column:
    """Projection of z on the simplex."""
    s = F.sort_array(F.transform(z, lambda x: x.cast("double")), asc=False)
    sums = F.transform(s, lambda _, i: total(F.slice(s, F.lit(1), i + 1)))
    support = F.size(F.filter(F.transform(s, lambda x, i: 1 + (i + 1) * x > F.get(sums, i)), lambda ok: ok))
    threshold = (F.get(sums, support - 1) - 1) / support
    return F.transform(z, lambda x: F.greatest(x - threshold, F.lit(0.0)))


def gini(a: Column) -> Column:
    """0 for empty or all-zero arrays."""
    s, n, t = F.sort_array(a), F.size(a), total(a)
    weighted = total(F.transform(s, lambda x, i: x * (2 * (i + 1) - n - 1)))
    return F.when((n == 0) | (t == 0), 0.0).otherwise(weighted / (n * t))
