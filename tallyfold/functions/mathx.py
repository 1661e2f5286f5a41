"""Scalar maths as Column expressions (stay inside whole-stage codegen)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyfold.constants import JITTER

# Abramowitz & Stegun 7.1.26: |error| < 1.5e-7.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def dlit(x: float) -> Column:
    return F.lit(float(x))


def erf(x: Column) -> Column:
    t = dlit(1) / (dlit(1) + dlit(ERF_P) * F.abs(x))
    poly = dlit(0)
    for a in reversed(ERF_A):
        poly = (poly + dlit(a)) * t
    return F.signum(x) * (dlit(1) - poly * F.exp(-x * x))


def norm_cdf(x: Column) -> Column:
    return dlit(0.5) * (dlit(1) + erf(x / dlit(math.sqrt(2))))


def norm_pdf(x: Column) -> Column:
    return F.exp(dlit(-0.5) * x * x) / dlit(math.sqrt(2 * math.pi))


def probit_link(f: Column) -> Column:
    """P(1 | f), kept inside [jitter, 1 - jitter]."""
    return norm_cdf(f) * dlit(1 - 2 * JITTER) + dlit(JITTER)


def sigmoid(x: Column) -> Column:
    return dlit(1) / (dlit(1) + F.exp(-x))


def log_sigmoid(x: Column) -> Column:
    """ln sigmoid(x) without overflow at either end."""
    return F.least(x, dlit(0)) - F.log1p(F.exp(-F.abs(x)))


def digamma(x: Column) -> Column:
    """psi(x) for x > 0: six recurrence steps, then the asymptotic series."""
    y = x + dlit(6)
    inv2 = dlit(1) / (y * y)
    series = F.ln(y) - dlit(0.5) / y - inv2 * (
        dlit(1 / 12) - inv2 * (dlit(1 / 120) - inv2 * dlit(1 / 252))
    )
    for i in range(6):
        series = series - dlit(1) / (x + dlit(i))
    return series


def safe_ln(p: Column) -> Column:
    """ln p, NULL at p <= 0 (the caller counts zeros separately)."""
    return F.when(p > 0, F.ln(p))


def np_norm_cdf(x: np.ndarray) -> np.ndarray:
    """Same polynomial as :func:`norm_cdf`, for Arrow batches."""
    z = x / math.sqrt(2)
    t = 1 / (1 + ERF_P * np.abs(z))
    poly = np.zeros_like(t)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return 0.5 * (1 + np.sign(z) * (1 - poly * np.exp(-z * z)))


def np_norm_pdf(x: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)
