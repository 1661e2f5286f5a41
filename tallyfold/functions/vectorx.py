"""Array-column vector maths with higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyfold.functions.mathx import dlit


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        dlit(0),
        lambda acc, v: acc + v,
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column) -> Column:
    """a / |a|; a zero vector stays zero."""
    n = norm(a)
    return F.when(
        n > 0, F.transform(a, lambda x: x.cast("double") / n)
    ).otherwise(F.transform(a, lambda x: dlit(0)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos(a, b); 1 when either vector is zero or absent."""
    na, nb = norm(a), norm(b)
    return F.when((na > 0) & (nb > 0), dlit(1) - dot(a, b) / (na * nb)).otherwise(dlit(1))


def gauss_hermite(points: int = 20) -> tuple[list[float], list[float]]:
    """Nodes and weights so that E[g(N(m, v))] = sum w * g(m + sqrt(v) * x)."""
    import numpy as np

    x, w = np.polynomial.hermite.hermgauss(points)
    return (x * np.sqrt(2)).tolist(), (w / np.sqrt(np.pi)).tolist()


def gaussian_expectation(g, mean: Column, var: Column, points: int = 20) -> Column:
    """E[g(f)] for f ~ N(mean, var); ``g`` maps a Column to a Column."""
    nodes, weights = gauss_hermite(points)
    pairs = F.array(
        *[F.struct(F.lit(x).alias("x"), F.lit(w).alias("w")) for x, w in zip(nodes, weights)]
    )
    sd = F.sqrt(var)
    return F.aggregate(
        pairs, dlit(0), lambda acc, p: acc + p["w"] * g(mean + sd * p["x"])
    )
