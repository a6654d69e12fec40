"""Likelihoods of the linear mixed model y = X b + g + e, g ~ N(0, vg K), e ~ N(0, ve I).

delta = ve / vg.  After one eigendecomposition each evaluation costs O(n); grids of
log delta are evaluated at once and the best cell is refined.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

#: Bounds of log delta, grid cells of REML, step of the ML grid.
LOW, HIGH, CELLS, STEP = -10.0, 10.0, 100, 0.1


@dataclass(frozen=True)
class Fit:
    delta: float
    vg: float
    ve: float
    loglik: float

    @property
    def h2(self) -> float:
        return self.vg / (self.vg + self.ve) if self.vg + self.ve > 0 else 0.0


def descending(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh((k + k.T) / 2)
    return values[::-1].copy(), vectors[:, ::-1].copy()


def golden(f, a: np.ndarray, b: np.ndarray, steps: int = 45):
    """Maximum of f between a and b, elementwise."""
    g = (math.sqrt(5) - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    for _ in range(steps):
        left = fc > fd
        a, b = np.where(left, a, c), np.where(left, d, b)
        c, d = b - g * (b - a), a + g * (b - a)
        fc, fd = f(c), f(d)
    x = (a + b) / 2
    return x, f(x)


def residual_spectrum(k: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of S K S on the space orthogonal to x, descending."""
    n, q = x.shape
    s = np.eye(n) - x @ np.linalg.pinv(x)
    values, vectors = descending(s @ (k + np.eye(n)) @ s)
    return values[: n - q] - 1, vectors[:, : n - q]


def reml(y: np.ndarray, x: np.ndarray, k: np.ndarray) -> Fit:
    """Restricted likelihood: grid of log delta, then refinement; bounds count too."""
    return reml_spectrum(y, *residual_spectrum(k, x))


def reml_spectrum(y: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> Fit:
    """``reml`` with the ``residual_spectrum`` made before."""
    eta2 = (vectors.T @ y) ** 2
    m = len(values)

    def loglik(logs):
        d = np.maximum(values[None, :] + np.exp(np.atleast_1d(logs))[:, None], 1e-300)
        return 0.5 * (m * (math.log(m / (2 * math.pi)) - 1 - np.log((eta2 / d).sum(1))) - np.log(d).sum(1))

    delta, best = _peak(loglik, np.linspace(LOW, HIGH, CELLS + 1))
    vg = float((eta2 / (values + delta)).sum() / m)
    return Fit(delta, vg, delta * vg, best)


def reml_low_rank(y: np.ndarray, z: np.ndarray, x: np.ndarray) -> tuple[Fit, float]:
    """``reml`` of K = z z' with one covariate x, to which the columns of z are orthogonal; and the
    likelihood without K.

    K has the squares of z's singular values as eigenvalues and 0 for all else that is orthogonal to
    x, of which only the sum of squares counts, so neither K nor a basis of that is
    formed."""
    n = len(y)
    u, values = low_rank_basis(z)
    own = y - x * (x @ y) / (x @ x)
    eta2 = (u.T @ own) ** 2
    rest, m, zeros = max(float(own @ own - eta2.sum()), 0.0), n - 1, n - 1 - len(values)

    def loglik(logs):
        delta = np.exp(np.atleast_1d(logs))
        d = np.maximum(values[None, :] + delta[:, None], 1e-300)
        return 0.5 * (m * (math.log(m / (2 * math.pi)) - 1 - np.log((eta2 / d).sum(1) + rest / delta)) - np.log(d).sum(1) - zeros * np.log(delta))

    delta, best = _peak(loglik, np.linspace(LOW, HIGH, CELLS + 1))
    vg = float(((eta2 / (values + delta)).sum() + rest / delta) / m)
    return Fit(delta, vg, delta * vg, best), 0.5 * m * (math.log(m / (2 * math.pi)) - 1 - math.log(max(float(own @ own), 1e-300)))


def _peak(loglik, grid: np.ndarray) -> tuple[float, float]:
    at = loglik(grid)
    peaks = np.flatnonzero((at[1:-1] >= at[:-2]) & (at[1:-1] >= at[2:])) + 1
    x, value = grid[[0, -1]], at[[0, -1]]
    if len(peaks):
        px, pv = golden(loglik, grid[peaks - 1], grid[peaks + 1])
        x, value = np.append(x, px), np.append(value, pv)
    i = int(np.argmax(value))
    return float(math.exp(x[i])), float(value[i])


def _ml_grid() -> np.ndarray:
    return np.arange(round((HIGH - LOW) / STEP) + 1) * STEP + LOW


def ml_profile(y: np.ndarray, x: np.ndarray, values: np.ndarray):
    """Functions of log delta, all else at its best: (coefficients, vg, weights), and the
    log-likelihood of rotated y and x; values: eigenvalues of K."""
    n = len(y)

    def parts(logs):
        w = 1 / np.maximum(values[None, :] + np.exp(np.atleast_1d(logs))[:, None], 1e-300)
        xtx = np.einsum("gn,np,nq->gpq", w, x, x)
        xty = np.einsum("gn,np,n->gp", w, x, y)
        b = np.linalg.solve(xtx + 1e-12 * np.eye(x.shape[1]), xty[..., None])[..., 0]
        vg = np.maximum((w * y * y).sum(1) - (b * xty).sum(1), 1e-300) / n
        return b, vg, w

    def loglik(logs):
        _, vg, w = parts(logs)
        return -n / 2 * (math.log(2 * math.pi) + 1 + np.log(vg)) + 0.5 * np.log(w).sum(1)

    return parts, loglik


def ml(y: np.ndarray, x: np.ndarray, values: np.ndarray) -> Fit:
    """Full-rank maximum likelihood of rotated y and x; values: eigenvalues of K."""
    parts, loglik = ml_profile(y, x, values)
    delta, best = _peak(loglik, _ml_grid())
    _, vg, _ = parts(np.array([math.log(delta)]))
    return Fit(delta, float(vg[0]), float(vg[0]) * delta, best)


def information(y: np.ndarray, x: np.ndarray, values: np.ndarray, h2: float, step: float = 1e-3) -> float:
    """Observed Fisher information of h2: minus the second derivative of the profile
    likelihood, by differences; next to 0 or 1 it is taken two steps inside."""
    at = min(1 - 2 * step, max(2 * step, h2))
    h = np.array([at - step, at, at + step])
    a, b, c = ml_profile(y, x, values)[1](np.log(1 / h - 1))
    return float(-(a - 2 * b + c) / step**2)


def low_rank_basis(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular vectors of ``terms`` and the eigenvalues of terms terms'."""
    u, s, _ = np.linalg.svd(terms, full_matrices=False)
    keep = s > s.max(initial=0) * 1e-9
    return u[:, keep], s[keep] ** 2


def low_rank_ml(y: np.ndarray, x: np.ndarray, terms: np.ndarray | None = None, basis: tuple[np.ndarray, np.ndarray] | None = None) -> Fit:
    """The same with K = terms terms' of low rank: what lies outside its column space
    has variance delta alone.  Works on the singular vectors (or a ``basis`` made
    before), never on K."""
    n = len(y)
    u, values = low_rank_basis(terms) if basis is None else basis
    r = len(values)
    uy, ux = u.T @ y, u.T @ x
    yy, xy, xx = float(y @ y - uy @ uy), x.T @ y - ux.T @ uy, x.T @ x - ux.T @ ux

    def parts(logs):
        delta = np.exp(np.atleast_1d(logs))
        w = 1 / (values[None, :] + delta[:, None])
        xtx = np.einsum("gr,rp,rq->gpq", w, ux, ux) + xx / delta[:, None, None]
        xty = np.einsum("gr,rp,r->gp", w, ux, uy) + xy / delta[:, None]
        b = np.linalg.solve(xtx + 1e-12 * np.eye(x.shape[1]), xty[..., None])[..., 0]
        vg = np.maximum((w * uy * uy).sum(1) + yy / delta - (b * xty).sum(1), 1e-300) / n
        return vg, -np.log(w).sum(1) + (n - r) * np.log(delta)

    def loglik(logs):
        vg, logdet = parts(logs)
        return -n / 2 * (math.log(2 * math.pi) + 1 + np.log(vg)) - 0.5 * logdet

    delta, best = _peak(loglik, _ml_grid())
    vg, _ = parts(np.array([math.log(delta)]))
    return Fit(delta, float(vg[0]), float(vg[0]) * delta, best)


def null_loglik(y: np.ndarray, x: np.ndarray) -> float:
    n = len(y)
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    v = max(float(((y - x @ b) ** 2).sum()) / n, 1e-300)
    return -n / 2 * (math.log(2 * math.pi) + 1 + math.log(v))


def decorrelation(k: np.ndarray, delta: float) -> np.ndarray:
    """T with T (K + delta I) T' = I."""
    values, vectors = descending(k)
    return (vectors / np.sqrt(np.maximum(values + delta, 1e-12))).T


def scan_fits(u_y: np.ndarray, u_one: np.ndarray, u_x: np.ndarray, values: np.ndarray, outside: dict | None = None, restricted: bool = False) -> dict[str, np.ndarray]:
    """delta, loglik, coef and t2 (of the coefficient) of each rotated variant (rows of u_x) with an
    intercept, delta optimised for each.  Grid sums are matrix products.

    ``outside``: n and the sums of products (xx, x1, xy of each variant; oo, oy, yy) that lie
    outside the rotated space, where K has no variance.  ``restricted``: by restricted
    likelihood, for the full rank alone."""
    n, logs = outside["n"] if outside else len(u_y), _ml_grid()
    m = n - 2 if restricted else n
    size = (u_x * u_x).sum(1) * (u_one @ u_one) - (u_x @ u_one) ** 2

    def at(logs_rows: np.ndarray | None):
        if logs_rows is None:
            w = 1 / (values[:, None] + np.exp(logs)[None, :])  # n x grid
            xx, x1, xy = (u_x * u_x) @ w, (u_x * u_one) @ w, (u_x * u_y) @ w
            oo, oy, yy, logdet = (u_one * u_one) @ w, (u_one * u_y) @ w, (u_y * u_y) @ w, -np.log(w).sum(0)
        else:
            w = 1 / (values[None, :] + np.exp(logs_rows)[:, None])
            xx, x1, xy = (u_x * u_x * w).sum(1), (u_x * u_one * w).sum(1), (u_x * u_y * w).sum(1)
            oo, oy, yy, logdet = w @ (u_one * u_one), w @ (u_one * u_y), w @ (u_y * u_y), -np.log(w).sum(1)
        if outside:
            own = logs if logs_rows is None else logs_rows
            inverse = np.exp(-own)
            each = lambda v: v[:, None] * inverse if logs_rows is None else v * inverse
            xx, x1, xy = xx + each(outside["xx"]), x1 + each(outside["x1"]), xy + each(outside["xy"])
            oo, oy, yy = (u + outside[k] * inverse for u, k in ((oo, "oo"), (oy, "oy"), (yy, "yy")))
            logdet = logdet + (n - len(values)) * own
        det = xx * oo - x1 * x1
        ok = det > 1e-12 * xx * oo
        safe = np.where(ok, det, 1)
        bx, b1 = (oo * xy - x1 * oy) / safe, (xx * oy - x1 * xy) / safe
        left = np.maximum(yy - bx * xy - b1 * oy, 1e-300)
        value = -m / 2 * (math.log(2 * math.pi) + 1 + np.log(left / m)) - 0.5 * logdet
        if restricted:
            value = value + 0.5 * (np.log(np.maximum(size, 1e-300)).reshape(-1, *[1] * (value.ndim - 1)) - np.log(safe))
        return np.where(ok, value, -np.inf), bx, bx * bx * safe / oo / left * (n - 2)

    grid = at(None)[0]
    i = grid.argmax(1)
    x, value = golden(lambda q: at(q)[0], logs[np.maximum(i - 1, 0)], logs[np.minimum(i + 1, len(logs) - 1)], 30)
    _, coef, t2 = at(x)
    return {"delta": np.exp(x), "loglik": value, "coef": coef, "t2": t2}


def scan_ml(u_y: np.ndarray, u_one: np.ndarray, u_x: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """delta, log-likelihood and effect of ``scan_fits``."""
    found = scan_fits(u_y, u_one, u_x, values)
    return found["delta"], found["loglik"], found["coef"]
