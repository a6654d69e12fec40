"""Scans by blocks, permutation, families, compounds and table statistics against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoflux.functions import likelihood as L
from genoflux.operators import joins, lm, mixed, stats


def test_scan_fits_low_rank_and_restricted():
    rng = np.random.default_rng(5)
    n, g = 40, rng.integers(0, 3, (6, 40)).astype(float)
    terms, y = rng.normal(size=(40, 5)), rng.normal(size=40)
    y += terms @ rng.normal(size=5)
    u, values = L.low_rank_basis(terms)
    x = g - g.mean(1, keepdims=True)
    u_x, u_one, u_y = x @ u, u.sum(0), u.T @ y
    outside = {"n": n, "xx": (x * x).sum(1) - (u_x * u_x).sum(1), "x1": x.sum(1) - u_x @ u_one, "xy": x @ y - u_x @ u_y, "oo": n - u_one @ u_one, "oy": y.sum() - u_one @ u_y, "yy": y @ y - u_y @ u_y}
    found = L.scan_fits(u_y, u_one, u_x, values, outside)
    for i in range(6):
        want = L.low_rank_ml(y, np.column_stack([np.ones(n), g[i]]), basis=(u, values))
        assert found["loglik"][i] == pytest.approx(want.loglik, abs=1e-6)
        v = np.linalg.inv(terms @ terms.T + want.delta * np.eye(n))
        d = np.column_stack([np.ones(n), g[i]])
        assert found["coef"][i] == pytest.approx(np.linalg.solve(d.T @ v @ d, d.T @ v @ y)[1], rel=1e-3, abs=1e-4)
    k = terms @ terms.T / 5 + 0.1 * np.eye(n)
    values, vectors = L.descending(k)
    one = vectors.T @ np.ones(n)
    found = L.scan_fits(vectors.T @ y, one, g @ vectors, values, restricted=True)
    for i in range(6):
        d = np.column_stack([np.ones(n), g[i]])
        want = L.reml(y, d, k)
        assert found["loglik"][i] == pytest.approx(want.loglik, abs=1e-6)
        v = np.linalg.inv(k + found["delta"][i] * np.eye(n))
        inverse = np.linalg.inv(d.T @ v @ d)
        b = inverse @ d.T @ v @ y
        s2 = (y - d @ b) @ v @ (y - d @ b) / (n - 2)
        assert found["t2"][i] == pytest.approx(b[1] ** 2 / (s2 * inverse[1, 1]), rel=1e-6)


def _store(spark, g):
    rows = [(1, int(100 * i + 1), [None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(g)]
    return spark.createDataFrame(rows, "chr int, pos long, g array<double>")


def test_low_rank_scan_and_marker_terms(spark):
    rng = np.random.default_rng(6)
    g = rng.integers(0, 3, (12, 30)).astype(float)
    g[3], g[5, 2], y = 1.0, np.nan, rng.normal(size=30)
    y[7] = np.nan
    v = _store(spark, g)
    terms = mixed.marker_terms(v, [(1, 1), (1, 101), (1, 301)], 30)
    z = (g[:2] - g[:2].mean(1, keepdims=True)) / g[:2].std(1, keepdims=True)
    assert np.allclose(terms @ terms.T, z.T @ z / 2)
    use = np.flatnonzero(~np.isnan(y))
    basis = L.low_rank_basis(terms[use])
    rows = {r.pos: r for r in mixed.low_rank_scan(v, y, terms).collect()}
    assert len(rows) == 11
    for i in (0, 4, 5, 11):
        x = np.where(np.isnan(g[i, use]), np.nanmean(g[i, use]), g[i, use])
        want = L.low_rank_ml(y[use], np.column_stack([np.ones(29), x]), basis=basis)
        assert rows[100 * i + 1].loglik == pytest.approx(want.loglik, abs=1e-6)


def test_full_rank_scan_has_r2_and_restricted_t(spark):
    rng = np.random.default_rng(8)
    g, k0 = rng.integers(0, 3, (5, 35)).astype(float), rng.normal(size=(35, 60))
    y = 0.7 * g[2] + rng.normal(size=35)
    v, k = _store(spark, g), k0 @ k0.T / 60
    for restricted in (False, True):
        for r in mixed.fastlmm(v, y, k, restricted).collect():
            x = g[(r.pos - 1) // 100]
            assert r.r2 == pytest.approx(r.coef**2 * x.var() / y.var(), rel=1e-9)
            d = np.column_stack([np.ones(35), x])
            inverse = np.linalg.inv(mixed.rescale(k) + r.delta * np.eye(35))
            assert r.coef == pytest.approx(np.linalg.solve(d.T @ inverse @ d, d.T @ inverse @ y)[1], rel=1e-6)
            if restricted:
                assert r.loglik == pytest.approx(L.reml(y, d, mixed.rescale(k)).loglik, abs=1e-6)


def test_kinships_by_restricted_likelihood(spark):
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(25, 40)), rng.normal(size=(25, 40))
    k1, k2, y = a @ a.T / 40, b @ b.T / 40, rng.normal(size=25)
    traits = spark.createDataFrame([("t", y.tolist()), ("part", [None, *y[1:].tolist()])], "trait string, y array<double>")
    for r in mixed.compare_kinships(traits, k1, k2, restricted=True).collect():
        use = np.arange(25 - r.n, 25)
        for k, h2, ll in ((k1, r.h2_1, r.loglik_1), (k2, r.h2_2, r.loglik_2)):
            want = L.reml(y[use], np.ones((r.n, 1)), mixed.rescale(k[np.ix_(use, use)]))
            assert (h2, ll) == (pytest.approx(want.h2, abs=1e-9), pytest.approx(want.loglik, abs=1e-9))


def test_permutation_is_a_plain_loop(spark):
    rng = np.random.default_rng(10)
    g = rng.integers(0, 3, (5, 20)).astype(float)
    g[1, 3], g[4] = np.nan, 2.0
    y = g[0] + rng.normal(size=20)
    calls = spark.createDataFrame([(1, p, s, None if np.isnan(g[p, s]) else float(g[p, s])) for p in range(5) for s in range(20)], "chr int, pos long, sample_id long, dosage double")
    traits = spark.createDataFrame([(s, float(y[s]) if s != 6 else None) for s in range(20)], "sample_id long, y double")
    use = np.array([s for s in range(20) if s != 6])
    drawn = [y[use], *(y[use][stats.permutation(19, 3, r)] for r in range(1, 41))]
    found = {r.pos: r for r in lm.permutation_p(calls, traits, 40, 3).collect()}
    assert sorted(found) == [0, 1, 2, 3]
    for p, row in found.items():
        known = ~np.isnan(g[p, use])
        r2 = [np.corrcoef(g[p, use][known], t[known])[0, 1] ** 2 for t in drawn]
        assert row.n_null == 40 and row.p == pytest.approx(np.mean([x >= r2[0] for x in r2[1:]]))
    assert lm.permutation_p(calls, traits.where("false"), 4, 3).count() == 0


def test_families_lose_their_means(spark):
    rng = np.random.default_rng(11)
    g, family = rng.integers(0, 3, (6, 40)).astype(float), np.repeat([0, 1], 20)
    y = 10.0 * family + g[1] + 0.3 * rng.normal(size=40)
    calls = spark.createDataFrame([(1, p, s, float(g[p, s])) for p in range(6) for s in range(40)], "chr int, pos long, sample_id long, dosage double")
    traits = spark.createDataFrame([(s, f"Z{family[s]}_{s}", float(y[s])) for s in range(40)], "sample_id long, name string, y double")
    own = y - np.array([y[:20].mean(), y[20:].mean()])[family]
    rows = lm.forward_families(calls, traits, 2, "name").orderBy("round").collect()
    assert rows[0].pos == 1
    want = lm.least_squares(np.column_stack([np.ones(40), g[[r.pos for r in rows]].T]), own)[3]
    assert rows[1].adj_r2 == pytest.approx(want)
    assert lm.forward_families(calls, traits, 2, "name", threshold=1e-9).collect()[0].pos == 1


def test_compounds_hold_a_variant_once(spark):
    points = spark.createDataFrame([(1, 10, "a"), (1, 30, "b"), (2, 10, "c")], "chr int, pos long, x string")
    parts = spark.createDataFrame([("k", 1, 5, 20), ("k", 1, 8, 40), ("m", 2, 1, 9), ("n", 1, 30, 30)], "compound_id string, chr int, start long, end long")
    assert sorted((r.compound_id, r.x) for r in joins.in_compounds(points, parts).collect()) == [("k", "a"), ("k", "b"), ("n", "b")]


def test_running_sums_in_many_ranges(spark):
    values = np.random.default_rng(12).permutation(3000) * 0.5
    rows = spark.createDataFrame([(float(v), int(v) % 7 + 1) for v in values], "v double, n long")
    got = {r.v: r.b for r in stats.running_before(rows, "v", "n", "b", rows=20).collect()}
    total = 0
    for v in sorted(got):
        assert got[v] == total
        total += int(v) % 7 + 1
    assert len(got) == 3000 and stats.running_before(rows.where("false"), "v", "n", "b").count() == 0


def test_median_and_contingency(spark):
    for values in ([3.0, 1.0, 2.0, None], [4.0, 1.0, 1.0, 1.0, 9.0, 7.0], [5.0], [2.0, 2.0]):
        known = [v for v in values if v is not None]
        r = stats.median(spark.createDataFrame([(v,) for v in values], "x double"), "x").first()
        assert (r.n, r["median"]) == (len(known), float(np.median(known)))
    assert stats.median(spark.createDataFrame([], "x double"), "x").first()["median"] is None
    pairs = [("a", "x")] * 5 + [("a", "y")] * 2 + [("b", "y")] * 4 + [("c", "x")] + [(None, "x"), ("a", None)]
    r = stats.contingency(spark.createDataFrame(pairs, "p string, q string"), "p", "q").first()
    o = np.array([[5, 2], [0, 4], [1, 0]], float)
    e = np.outer(o.sum(1), o.sum(0)) / o.sum()
    held = np.where(o == 0, 0.5, o)
    assert (r.chi2, r.lr, r.df) == (pytest.approx(((o - e) ** 2 / e).sum()), pytest.approx((2 * held * np.log(held / e)).sum()), 2)


def test_normality_keeps_its_digits_on_large_means(spark):
    x = np.random.default_rng(13).normal(size=300)
    near, far = (stats.ks_normal(spark.createDataFrame([(float(v + shift),) for v in x], "x double"), "x").first() for shift in (0, 1e9))
    assert far.d == pytest.approx(near.d, abs=1e-5) and not math.isnan(far.p)


def test_correlation_tests(spark):
    rng = np.random.default_rng(14)
    a = rng.normal(size=30)
    b = a + rng.normal(size=30)
    r = stats.correlation_tests(spark.createDataFrame(list(zip(a.tolist(), b.tolist(), strict=True)), "a double, b double"), "a", "b").first()
    want = math.erfc(math.atanh(r.r) * math.sqrt(27 / 1.06) / math.sqrt(2)) / 2
    assert r.p_z == pytest.approx(want, rel=1e-9)
    few = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0)], "a double, b double")
    assert math.isnan(stats.correlation_tests(few, "a", "b").select(F.coalesce("p_z", F.lit(float("nan")))).first()[0])


def test_nothing_scanned_passes_no_gate(spark):
    empty = spark.createDataFrame([], "chr int, pos long, pvalue double")
    assert lm.bonferroni(empty, 5.0).count() == 0
