"""Numerically stable column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def logsigmoid(x: Column) -> Column:
    return -(F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))


def sigmoid(x: Column) -> Column:
    return F.exp(logsigmoid(x))


def softmax_pair(a: Column, b: Column, temperature: float = 1.0) -> Column:
    """Probability of the first of two logits."""
    return sigmoid((a - b) / F.lit(temperature))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once per row: what a lambda takes from outside is else worked out anew for
    every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def logsumexp(values: Column) -> Column:
    return let(F.array_max(values), lambda top: top + F.log(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))))


def log_softmax_at(logits: Column, index: Column) -> Column:
    """Log-probability of the entry at a 0-based index."""
    return F.element_at(logits, index + 1) - logsumexp(logits)


def entropy(logits: Column) -> Column:
    return let(logsumexp(logits), lambda z: F.aggregate(logits, F.lit(0.0), lambda acc, x: acc - F.exp(x - z) * (x - z)))


def jensen_shannon(student: Column, teacher: Column, beta: float = 0.5) -> Column:
    """Generalised divergence of two logit arrays; beta 0 and 1 are the two one-sided ones."""
    normal = lambda values: let(logsumexp(values), lambda z: F.transform(values, lambda x: x - z))
    p, q = normal(student), normal(teacher)

    def kl(one: Column, two: Column) -> Column:
        return F.aggregate(F.zip_with(one, two, lambda a, b: F.exp(a) * (a - b)), F.lit(0.0), lambda acc, x: acc + x)

    if beta in (0, 1):
        return kl(q, p) if beta == 0 else kl(p, q)
    mix = F.zip_with(p, q, lambda a, b: F.log((1 - beta) * F.exp(a) + beta * F.exp(b)))
    return beta * kl(q, mix) + (1 - beta) * kl(p, mix)


def clipped(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def exp_capped(x: Column, cap: float = 88.0) -> Column:
    return F.exp(F.least(x, F.lit(cap)))
