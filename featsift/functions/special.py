"""Tail probabilities of the F and chi-square laws over NumPy arrays.

Used inside pandas UDFs for p values.  Degrees of freedom are whole numbers here,
which allows short forms:

* chi-square: the upper tail rises by one Poisson term for each two degrees, from
  ``exp(-x/2)`` (two degrees) or ``erfc(sqrt(x/2))`` (one degree);
* F: the tail is a regularised incomplete beta ``I_x(a, b)``.  Where it is not small,
  one minus the power series of the opposite tail (all terms positive); where it is
  small, ``x^a / (a B(a, b))`` times the integral of ``exp(-u) (1 - x exp(-u/a))^(b-1)``,
  which is smooth there, by Gauss-Laguerre quadrature.
"""

from __future__ import annotations

import math

import numpy as np

# The opposite tail's series is used while its Poisson-like mean is under this.
_SERIES_MEAN = 40.0
_NODES, _WEIGHTS = np.polynomial.laguerre.laggauss(64)


def _log_beta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def _by_series(a: float, b: float, y: np.ndarray) -> np.ndarray:
    """``1 - I_y(b, a)`` from the power series of ``I_y(b, a)``."""
    with np.errstate(divide="ignore"):
        lead = np.exp(b * np.log(y) + a * np.log1p(-y) - _log_beta(a, b)) / b
    total, term, n = np.ones_like(y), np.ones_like(y), 0
    while n < 5000 and (term > 1e-17 * total).any():
        term = term * y * (a + b + n) / (b + 1.0 + n)
        total += term
        n += 1
    return 1.0 - lead * total


def _by_quadrature(a: float, b: float, x: np.ndarray) -> np.ndarray:
    rest = -np.expm1(np.log(x)[:, None] - _NODES / a)
    integral = (rest ** (b - 1.0)) @ _WEIGHTS
    return np.exp(a * np.log(x) - _log_beta(a, b)) / a * integral


def betainc_reg(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """``I_x(a, b)`` for scalar a, b > 0 and an array x in [0, 1]; NaN stays NaN."""
    x = np.asarray(x, dtype=float)
    out = np.where(x <= 0.0, 0.0, np.where(x >= 1.0, 1.0, np.nan))
    inside = (x > 0.0) & (x < 1.0)
    near = inside & ((1.0 - x) * (a + b) <= max(_SERIES_MEAN, 4.0 * b))
    out[near] = _by_series(a, b, 1.0 - x[near])
    far = inside & ~near
    if far.any():
        out[far] = _by_quadrature(a, b, x[far])
    return np.clip(out, 0.0, 1.0)


def f_sf(f: np.ndarray, d1: float, d2: float) -> np.ndarray:
    """Survival function of the F(d1, d2) distribution; +inf -> 0."""
    f = np.asarray(f, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = np.where(np.isposinf(f), 0.0, d2 / (d2 + d1 * f))
    return betainc_reg(d2 / 2.0, d1 / 2.0, x)


_erfc = np.vectorize(math.erfc, otypes=[float])


def chi2_sf(x: np.ndarray, dof: float) -> np.ndarray:
    """Survival function of the chi-square distribution with whole ``dof`` >= 1."""
    if dof != int(dof) or dof < 1:
        raise ValueError("degrees of freedom must be a whole number")
    x = np.asarray(x, dtype=float)
    half = np.where(x >= 0, x, np.nan) / 2.0
    a = 1.0 if dof % 2 == 0 else 0.5
    tail = np.exp(-half) if a == 1.0 else _erfc(np.sqrt(half))
    with np.errstate(divide="ignore", invalid="ignore"):
        while a < dof / 2.0:
            term = np.exp(a * np.log(half) - half - math.lgamma(a + 1.0))
            tail = tail + np.where(np.isposinf(half), 0.0, term)
            a += 1.0
    return np.clip(tail, 0.0, 1.0)
