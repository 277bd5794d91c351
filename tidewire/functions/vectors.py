"""Vector functions over arrays of doubles, as Spark columns (higher-order functions, no Python).

`bind` gives an intermediate a name, so that it is computed once and not for every element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import col

EPS = 1e-8


def bind(value, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once."""
    return F.element_at(F.transform(F.array(col(value)), f), 1)


def total(v) -> Column:
    return F.aggregate(col(v), F.lit(0.0), lambda a, x: a + x)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(col(v), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(v) -> Column:
    """Length one; a zero vector stays zero."""
    return bind(v, lambda a: bind(norm(a), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))))


def cosine(a, b) -> Column:
    return bind(F.struct(col(a).alias("a"), col(b).alias("b")), lambda s: bind(norm(s.a) * norm(s.b), lambda n: F.when(n > 0, dot(s.a, s.b) / n).otherwise(F.lit(0.0))))


def standardise(v, clip: float = 8.0) -> Column:
    def spread(a, mean):
        return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(a))

    def scaled(a, mean):
        return bind(spread(a, mean), lambda sd: F.transform(a, lambda x: F.greatest(F.lit(-clip), F.least(F.lit(clip), (x - mean) / (sd + EPS)))))

    return bind(v, lambda a: bind(total(a) / F.size(a), lambda mean: scaled(a, mean)))


def softmax(v, temperature: float) -> Column:
    def powers(a):
        return bind(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp((x - top) / temperature)))

    return bind(v, lambda a: normalised(powers(a)))


def normalised(v) -> Column:
    """Sums to one."""
    return bind(v, lambda a: bind(total(a), lambda t: F.transform(a, lambda x: x / t)))


def entropy(v) -> Column:
    return -F.aggregate(col(v), F.lit(0.0), lambda a, p: a + F.greatest(p, F.lit(1e-12)) * F.log(F.greatest(p, F.lit(1e-12))))


def blend(a, b, alpha: float) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: alpha * x + (1 - alpha) * y)


def top(v, k: int) -> Column:
    """(index from 0, value) of the k largest, ties to the smaller index."""
    pairs = F.transform(col(v), lambda x, i: F.struct((-x).alias("neg"), i.alias("i"), x.alias("value")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda s: F.struct(s.i.alias("i"), s.value.alias("value")))
