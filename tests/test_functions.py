import math

import numpy as np
import pytest

from genoflux.functions import likelihood as L
from genoflux.functions import special as S
from genoflux.operators import mixed


def test_tails_against_the_jvm(spark):
    d = spark.sparkContext._jvm.org.apache.commons.math3.distribution
    for t, df in ((0.3, 4), (2.5, 17), (7.1, 60), (1.0, 1)):
        assert S.t_two_sided(t, df) == pytest.approx(2 * d.TDistribution(float(df)).cumulativeProbability(-t), rel=1e-9)
    for x, df in ((0.5, 1), (3.2, 2), (30.0, 7), (11.0, 40)):
        assert S.chi2_sf(x, df) == pytest.approx(1 - d.ChiSquaredDistribution(float(df)).cumulativeProbability(x), rel=1e-7)
    for f, a, b in ((0.7, 3, 9), (4.2, 2, 30)):
        assert S.f_sf(f, a, b) == pytest.approx(1 - d.FDistribution(float(a), float(b)).cumulativeProbability(f), rel=1e-8)
    assert S.normal_sf(1.96) == pytest.approx(0.0249979, rel=1e-5)
    assert S.chi2_sf(-1, 3) == 1 and S.t_two_sided(40, 200) > 0
    ks = spark.sparkContext._jvm.org.apache.commons.math3.stat.inference.KolmogorovSmirnovTest()
    for gap, n in ((0.2, 20), (0.1, 100), (0.05, 500), (0.3, 50), (0.5, 20), (0.03, 4000)):
        assert S.ks_sf(gap, n) == pytest.approx(1 - ks.cdf(gap, n), rel=1e-6, abs=1e-10)
    assert 0 < S.ks_sf(0.3, 1500) < 1e-100 and 0 < S.ks_sf(0.02, 20_000) < 1e-6 and S.ks_sf(1.0, 9) == 0


def test_mixture_tail():
    assert S.mixture_sf(9.0, [2.0]) == pytest.approx(float(S.chi2_sf(4.5, 1)), rel=1e-9)
    rng = np.random.default_rng(1)
    w = np.array([3, 1, 0.5, 0.2])
    draws = (rng.standard_normal((400_000, 4)) ** 2) @ w
    assert S.mixture_sf(10.0, w) == pytest.approx((draws > 10).mean(), rel=0.02)
    assert S.mixture_sf(0.0, w) == 1 and S.mixture_sf(5.0, []) == 1 and S.mixture_sf(1e-18, w) == 1
    assert S.mixture_sf(30 * 7.0, 7 * w) == pytest.approx(S.mixture_sf(30.0, w), rel=1e-12)


@pytest.mark.parametrize("n", [2, 3, 7, 40, 900])
@pytest.mark.parametrize("times", [0.2, 1, 1.4, 3, 9])
def test_mixture_tail_of_equal_weights(n, times):
    want = float(S.chi2_sf(n * times, n))
    assert S.mixture_sf(n * times, np.ones(n)) == pytest.approx(want, rel=1e-10, abs=1e-300)


def by_quadrature(q, second, third=0.0):
    """Two weights, 1 and ``second``, or three: the tail of the first over the density of the others."""
    x, weight = np.polynomial.legendre.leggauss(1500)

    def two(q):
        top = math.sqrt(q / second)
        t = (x + 1) / 2 * top
        dens = 2 * np.exp(-t * t / 2) / math.sqrt(2 * math.pi)
        return float((weight * top / 2 * dens * 2 * S.normal_sf(np.sqrt(np.maximum(q - second * t * t, 0)))).sum() + S.chi2_sf(q / second, 1))

    if not third:
        return two(q)
    x2, weight2 = np.polynomial.legendre.leggauss(150)
    top = math.sqrt(q / third)
    t = (x2 + 1) / 2 * top
    dens = 2 * np.exp(-t * t / 2) / math.sqrt(2 * math.pi)
    return sum(w * top / 2 * d * two(max(q - third * v * v, 1e-9)) for w, d, v in zip(weight2, dens, t, strict=True)) + float(S.chi2_sf(q / third, 1))


@pytest.mark.parametrize("weights", [(0.5,), (0.1,), (0.999,), (1e-3,), (0.5, 0.25), (0.8, 0.05)])
@pytest.mark.parametrize("q", [0.3, 4, 9, 15, 22, 30, 40, 55, 200])
def test_mixture_tail_is_the_quadrature(weights, q):
    """p from 0.9 down to 1e-44."""
    assert S.mixture_sf(q, [1, *weights]) == pytest.approx(by_quadrature(q, *weights), rel=1e-6)


def test_mixture_tail_of_a_decaying_spectrum():
    """p from 1e-2 to 1e-11: the first weight exactly, the others drawn under a tilted density and weighted back."""
    w, rng = 0.7 ** np.arange(25), np.random.default_rng(3)
    rest = w[1:]
    draws = (rng.standard_normal((400_000, 24)) ** 2) @ (rest / (1 - rest))
    for q in (14.0, 22.0, 32.0, 50.0):
        back = np.exp(-draws / 2 - 0.5 * np.log1p(-rest).sum()) * 2 * S.normal_sf(np.sqrt(np.maximum(q - draws, 0)))
        assert back.std() / back.mean() / math.sqrt(400_000) < 0.003
        assert S.mixture_sf(q, w) == pytest.approx(back.mean(), rel=0.01)


def _data(n=60, seed=2):
    rng = np.random.default_rng(seed)
    g = rng.integers(0, 3, (200, n)).astype(float)
    z = (g - g.mean(1, keepdims=True)) / g.std(1, keepdims=True)
    k = z.T @ z / len(z)
    return rng, g, k


def test_reml_beats_its_grid_and_scales():
    rng, _, k = _data()
    y = np.linalg.cholesky(k + 0.5 * np.eye(len(k))) @ rng.standard_normal(len(k))
    one = np.ones((len(k), 1))
    fit = L.reml(y, one, k)
    assert 0 < fit.h2 < 1
    assert L.reml(3 * y, one, k).h2 == pytest.approx(fit.h2, rel=1e-4)
    p = rng.permutation(len(k))
    assert L.reml(y[p], one, k[np.ix_(p, p)]).loglik == pytest.approx(fit.loglik, rel=1e-8)


def test_low_rank_equals_full_rank():
    rng, g, _ = _data()
    terms = (g[:20] - g[:20].mean(1, keepdims=True)).T / 4
    y, one = rng.standard_normal(60), np.ones((60, 1))
    values, vectors = L.descending(terms @ terms.T)
    full = L.ml(vectors.T @ y, vectors.T @ one, np.maximum(values, 0))
    low = L.low_rank_ml(y, one, terms)
    assert low.loglik == pytest.approx(full.loglik, rel=1e-4)


def test_scan_ml_is_ml_of_each_variant():
    rng, g, k = _data()
    y = rng.standard_normal(60)
    values, vectors = L.descending(k)
    values = np.maximum(values, 0)
    one = vectors.T @ np.ones(60)
    _, loglik, _ = L.scan_ml(vectors.T @ y, one, g[:3] @ vectors, values)
    for i in range(3):
        x = np.column_stack([one, vectors.T @ g[i]])
        assert loglik[i] == pytest.approx(L.ml(vectors.T @ y, x, values).loglik, rel=1e-4)


def test_transformed_ols_is_least_squares():
    rng, g, k = _data()
    y = rng.standard_normal(60)
    t = L.decorrelation(k, 0.7)
    r = mixed.transformed_ols(g[:4] @ t.T, t @ np.ones(60), t @ y)
    for i in range(4):
        x = np.column_stack([t @ np.ones(60), t @ g[i]])
        b, rss, *_ = np.linalg.lstsq(x, t @ y, rcond=None)
        assert r["coef"][i] == pytest.approx(b[1])
        assert r["sd_err"][i] == pytest.approx(math.sqrt(rss[0] / 58))


def test_blup_of_unrelated_samples_is_the_mean():
    y = np.array([1.0, 2.0, 4.0, np.nan])
    assert mixed.blup(np.eye(4), y, 0.5)[3] == pytest.approx(7 / 3)
