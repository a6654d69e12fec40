"""Tail probabilities over numpy arrays, and as column functions.

Tails are computed as such, never as one minus a distribution function, so very
small p-values keep their digits.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_erfc = np.frompyfunc(math.erfc, 1, 1)
_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def _floats(*args):
    return [np.array(x, float) for x in np.broadcast_arrays(*map(np.asarray, args))]


def normal_sf(x) -> np.ndarray:
    """P(Z > x)."""
    return 0.5 * np.asarray(_erfc(np.asarray(x, float) / math.sqrt(2)), float)


def betainc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    a, b, x = _floats(a, b, x)
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.clip(np.where(flip, 1 - x, x), 0, 1)
    with np.errstate(all="ignore"):
        front = np.exp(np.asarray(_lgamma(p + q), float) - np.asarray(_lgamma(p), float) - np.asarray(_lgamma(q), float) + p * np.log(z) + q * np.log1p(-z)) / p
        tiny = 1e-300
        c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 400):
            for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * c * d
            if np.all(np.abs(c * d - 1) < 1e-15):
                break
        value = front * h
    value = np.where(z <= 0, 0.0, value)
    return np.where(flip, 1 - value, value)


def gamma_q(a, x) -> np.ndarray:
    """Upper regularised incomplete gamma function."""
    a, x = _floats(a, x)
    x = np.maximum(x, 0)
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(x) - x - np.asarray(_lgamma(a), float))
        total = term = 1 / a
        for k in range(1, 600):
            term = term * x / (a + k)
            total = total + term
            if np.all(term < total * 1e-16):
                break
        low = 1 - front * total
        b = x + 1 - a
        c, d = np.full_like(x, 1e300), 1 / np.where(b == 0, 1e-300, b)
        h = d.copy()
        for k in range(1, 600):
            an = -k * (k - a)
            b = b + 2
            d = 1 / np.where(an * d + b == 0, 1e-300, an * d + b)
            c = np.where(b + an / c == 0, 1e-300, b + an / c)
            h = h * d * c
            if np.all(np.abs(c * d - 1) < 1e-15):
                break
        high = front * h
    return np.where(x <= 0, 1.0, np.where(x < a + 1, low, high))


def t_two_sided(t, df) -> np.ndarray:
    """P(|T| > |t|)."""
    t, df = _floats(t, df)
    return betainc(df / 2, 0.5, df / (df + t * t))


def f_sf(f, d1, d2) -> np.ndarray:
    """P(F > f)."""
    f, d1, d2 = _floats(f, d1, d2)
    return np.where(f <= 0, 1.0, betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * np.maximum(f, 0))))


def chi2_sf(x, df) -> np.ndarray:
    """P(X > x); 1 for x <= 0."""
    x, df = _floats(x, df)
    return np.where(x <= 0, 1.0, gamma_q(df / 2, x / 2))


def ks_sf(d: float, n: int) -> float:
    """P(D_n > d).

    Beyond n d d = 4 it is twice the one-sided tail (what both sides share is 1e-10 of it), a
    sum of positive terms; before, one minus the distribution function, which is not small
    there, by powers of a matrix of size about 2 n d.  The limit form serves n above 4000
    before and above a million beyond."""
    if n <= 0 or d <= 0:
        return 1.0
    if d >= 1:
        return 0.0
    if n * d * d > 4 and n <= 1_000_000:
        j = np.arange(int(n * (1 - d)) + 1)
        j = j[j < n * (1 - d)]
        ways = np.concatenate([[0.0], np.cumsum(np.log((n - j[1:] + 1) / j[1:]))])
        terms = ways + (j - 1) * np.log(d + j / n) + (n - j) * np.log1p(-d - j / n)
        return float(min(1.0, 2 * d * np.exp(terms).sum()))
    if n > 4000:
        x = d * (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n))
        return float(min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))))
    k = int(n * d) + 1
    m, h = 2 * k - 1, k - n * d
    i = np.arange(m)
    matrix = (i[:, None] - i[None, :] + 1 >= 0).astype(float)
    powers = h ** np.arange(1, m + 1)
    matrix[:, 0] -= powers
    matrix[m - 1, :] -= powers[::-1]
    matrix[m - 1, 0] += (2 * h - 1) ** m if 2 * h > 1 else 0
    gap = i[:, None] - i[None, :] + 1
    matrix *= np.array([[math.exp(-math.lgamma(g + 1)) if g > 0 else 1.0 for g in row] for row in gap.tolist()])
    power, scale, base, base_scale, e = np.eye(m), 0, matrix, 0, n
    while e:
        if e & 1:
            power, scale = power @ base, scale + base_scale
        base, base_scale = base @ base, base_scale * 2
        big = base.max()
        if big > 1e140:
            base, base_scale = base / 1e140, base_scale + 140
        if power.max() > 1e140:
            power, scale = power / 1e140, scale + 140
        e >>= 1
    value = power[k - 1, k - 1]
    log_value = math.log(value) + scale * math.log(10) + math.lgamma(n + 1) - n * math.log(n) if value > 0 else -math.inf
    return float(min(1.0, max(0.0, 1 - math.exp(log_value))))


def correlation_p(r, n) -> np.ndarray:
    """Two-sided p of a correlation by Student's t."""
    r, n = _floats(r, n)
    with np.errstate(all="ignore"):
        return t_two_sided(r * np.sqrt((n - 2) / np.maximum(1 - r * r, 1e-300)), n - 2)


def fisher_z_p(r, n) -> np.ndarray:
    """One-sided p of a correlation by Fisher's transform (for |r|)."""
    r, n = _floats(r, n)
    with np.errstate(all="ignore"):
        return normal_sf(np.abs(np.arctanh(r)) * np.sqrt((n - 3) / 1.06))


def _saddle(q: float, w: np.ndarray) -> float:
    """The least point of log M(s) - s q - log s between 0 and the first branch point, M being
    the moment generating function; the function is convex there."""
    low, high = 0.0, 1 / (2 * w.max())
    for _ in range(200):
        s = (low + high) / 2
        if s in (low, high):
            break
        if (w / (1 - 2 * w * s)).sum() - q - 1 / s > 0:
            high = s
        else:
            low = s
    return (low + high) / 2


def mixture_sf(q: float, weights, tolerance: float = 1e-9) -> float:
    """P(sum w_i X_i > q) for independent chi-squares of one degree of freedom.

    The tail is an integral of M(-z) exp(q z) / z along a parabola around the branch points
    of M, all on the negative axis.  It crosses that axis at the saddle point, where the
    integrand is largest and about as large as the tail, so nothing cancels and the
    relative precision is the same at 0.5 and at 1e-200.  Panels of Gauss-Legendre nodes
    follow the path until nothing is left of it; two orders must agree within
    ``tolerance``, or panels are halved, and an ArithmeticError says that this was in vain.
    """
    w = np.asarray(weights, float)
    w = w[w > w.max(initial=0) * 1e-12]
    if not len(w) or q <= 0:
        return 1.0
    if len(w) == 1:
        return float(chi2_sf(q / w[0], 1))
    w, q = np.sort(w)[::-1] / w.max(), q / w.max()
    # no more than the two largest alone: 1 - p is at most q / (2 sqrt(w1 w2))
    if q < 1e-15 * math.sqrt(w[1]):
        return 1.0
    s = _saddle(q, w)
    mu = 0.5 - s
    at_saddle = -0.5 * np.log1p(-2 * w * s).sum() - q * s - math.log(s)
    curve = (2 * (w / (1 - 2 * w * s)) ** 2).sum() + 1 / s**2
    first = min(1.0, math.sqrt(1 + s / mu) - 1, 1 / (2 * mu * math.sqrt(curve)))

    def panel(a: float, b: float, order: int) -> float:
        x, weight = _legendre(order)
        u = (a + b) / 2 + (b - a) / 2 * x
        z = -s - mu * u * u + 2j * mu * u
        logs = np.zeros(order, complex)
        for k in range(0, len(w), 4096):
            logs -= 0.5 * np.log(1 + 2 * np.outer(z, w[k : k + 4096])).sum(1)
        f = np.exp(logs + q * z - np.log(-z) - at_saddle) * (1j - u)
        return float((f.imag * weight).sum() * (b - a) / 2)

    for halved in range(8):
        sums, a, width, step = np.zeros(2), 0.0, first / 2**halved, 0
        while True:
            got = np.array([panel(a, a + width, order) for order in (24, 32)])
            sums += got
            a, step = a + width, step + 1
            if abs(got[1]) <= 1e-17 * abs(sums[1]) and step > 4 or a > 1e30:
                break
            if step >= 8 * 2**halved:  # farther out the integrand changes with the distance
                width = a / 4
        if abs(sums[1] - sums[0]) <= tolerance * abs(sums[1]):
            return float(min(1.0, max(0.0, math.exp(at_saddle) * sums[1] * 2 * mu / math.pi)))
    raise ArithmeticError("the tail did not converge")


@functools.cache
def _legendre(order: int) -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.legendre.leggauss(order)


# Column functions: one Arrow batch at a time.


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(np.where(t.isna() | (df <= 0), np.nan, t_two_sided(t.fillna(0), np.maximum(df, 1))))


@F.pandas_udf(T.DoubleType())
def chi2_pvalue(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(np.where(x.isna() | (df <= 0), np.nan, chi2_sf(x.fillna(0), np.maximum(df, 1))))


@F.pandas_udf(T.DoubleType())
def fisher_z_pvalue(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(np.where(r.isna() | (n <= 3), np.nan, fisher_z_p(r.fillna(0).clip(-1, 1), np.maximum(n, 4))))


@F.pandas_udf(T.DoubleType())
def f_pvalue(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(np.where(f.isna() | (d2 <= 0), np.nan, f_sf(f.fillna(0), np.maximum(d1, 1), np.maximum(d2, 1))))


@F.pandas_udf(T.DoubleType())
def ks_pvalue(d: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([np.nan if pd.isna(x) else ks_sf(float(x), int(k)) for x, k in zip(d, n, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def normal_tail(x: pd.Series) -> pd.Series:
    return pd.Series(normal_sf(x))
