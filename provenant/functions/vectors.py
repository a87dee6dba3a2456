"""Vector columns: arrays of numbers, computed in double precision inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def finite(v: Column) -> Column:
    """Whether a vector is there, is not empty, and has neither null nor non-finite components."""
    return v.isNotNull() & (F.size(v) > 0) & F.forall(doubles(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, whose value is computed once a row, however often it is used, in lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    return once(doubles(v), lambda u: once(F.greatest(norm(u), F.lit(eps)), lambda n: F.transform(u, lambda x: x / n)))


def cosine(a: Column, b: Column, eps: float = 1e-12) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def psnr(a: Column, b: Column) -> Column:
    """Peak signal-to-noise ratio of two pixel arrays; null (not infinity) for equal ones."""
    squares = F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    mse = squares / F.size(a)
    return F.when(mse > 0, 10 * F.log10(F.lit(65025.0) / mse))


def mean_abs_difference(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def retriever_loss(image: Column, target: Column) -> Column:
    return 1 - cosine(image, target)


def weighted_objective(retriever: Column, generator: Column, retriever_weight: float = 1.0, generator_weight: float = 1.0) -> Column:
    return retriever * retriever_weight + generator * generator_weight
