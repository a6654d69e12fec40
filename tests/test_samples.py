"""Matrices in tiles, prediction without a matrix, selection in regions, weights of two kinships."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoflux.functions import likelihood as L
from genoflux.functions.special import chi2_sf, t_two_sided
from genoflux.operators import kinship, mixed, prediction


def store(spark, g, parts=3):
    rows = [(1 + i % 3, 1000 * i + 1, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(g)]
    return spark.createDataFrame(rows, "chr int, pos long, g array<double>").repartition(parts)


def plain(g, kind, scale=2.0):
    """The matrix by its definition, pair by pair of samples."""
    known = ~np.isnan(g)
    if kind == "ibs":
        out = np.array([[np.mean(1 - np.abs(g[both, i] - g[both, j]) / scale) if (both := known[:, i] & known[:, j]).any() else 0 for j in range(g.shape[1])] for i in range(g.shape[1])])
        np.fill_diagonal(out, 1)
        return out
    sd = np.nanstd(g, axis=1, ddof=1)
    g, known = g[sd > 0], known[sd > 0]
    z = (g - np.nanmean(g, axis=1, keepdims=True)) / np.nanstd(g, axis=1, ddof=1, keepdims=True)
    return np.array([[np.mean(z[both, i] * z[both, j]) if (both := known[:, i] & known[:, j]).any() else 0 for j in range(g.shape[1])] for i in range(g.shape[1])])


def as_array(cells, n):
    out = np.full((n, n), np.nan)
    for r in cells.collect():
        assert np.isnan(out[r.i, r.j])
        out[r.i, r.j] = r.k
    return out


@pytest.mark.parametrize("kind", ["ibs", "rrm"])
@pytest.mark.parametrize(("missing", "real", "tile", "chunk"), [(0, False, 7, 1 << 20), (0.2, False, 7, 2000), (0.1, True, 64, 500), (0, True, 30, 1 << 20), (0, False, 10, 100)])
def test_tiles_are_the_definition(spark, kind, missing, real, tile, chunk):
    rng = np.random.default_rng(5)
    g = rng.normal(size=(40, 30)) if real else rng.integers(0, 3, (40, 30)).astype(float)
    g[rng.random(g.shape) < missing] = np.nan
    g[3] = 1.0
    tiles = kinship.gram_tiles(store(spark, g), kind, tile=tile, chunk_bytes=chunk)
    assert tiles.agg(F.max(F.size("k"))).first()[0] <= tile
    want = plain(g, kind)
    assert np.allclose(as_array(kinship.tile_cells(tiles), 30), want, atol=1e-12)
    assert np.allclose(as_array(kinship.tile_cells(kinship.rescaled_tiles(tiles)), 30), kinship.rescale(want), atol=1e-10)
    assert np.allclose(kinship.gram(store(spark, g), kind), want, atol=1e-12)


def test_tiles_of_many_samples(spark):
    """2,000 samples in tiles of 256: 36 tiles, equal to the dense products."""
    rng = np.random.default_rng(6)
    g = rng.integers(0, 3, (60, 2000)).astype(float)
    z = (g - g.mean(1, keepdims=True)) / g.std(1, ddof=1, keepdims=True)
    found = kinship.gram_tiles(store(spark, g, 2), tile=256)
    rows = found.toArrow()
    assert rows.num_rows == sum(min(256, 2000 - a) * len(range(a, 2000, 256)) for a in range(0, 2000, 256))
    want = z.T @ z / 60
    for i, first, k in list(zip(rows["i"].to_pylist(), rows["first"].to_pylist(), rows["k"], strict=True))[::7]:
        k = k.values.to_numpy()
        assert np.allclose(k, want[i, first : first + len(k)], atol=1e-12)
    scaled = kinship.rescaled_tiles(found).where("i = 700 and bj = 3").first()
    assert np.allclose(scaled.k, kinship.rescale(want)[700, 768:1024], atol=1e-10)


def test_tiles_of_nothing(spark):
    none = spark.createDataFrame([], "chr int, pos long, g array<double>")
    assert kinship.gram_tiles(none).count() == 0 and kinship.gram(none).shape == (0, 0)
    same = spark.createDataFrame([(1, 1, [1.0, 1.0])], "chr int, pos long, g array<double>")
    assert (kinship.gram(same, "rrm") == np.eye(2)).all() and (kinship.gram(same, "ibs") == 1).all()


# --- prediction ---


@pytest.fixture(scope="module")
def herd(spark):
    rng = np.random.default_rng(9)
    g = rng.integers(0, 3, (300, 90)).astype(float)
    z = (g - g.mean(1, keepdims=True)) / g.std(1, ddof=1, keepdims=True)
    y = z.T @ rng.normal(size=300) / np.sqrt(300) * 2 + rng.normal(size=90)
    return g, z, y, store(spark, g).cache()


def test_products_are_the_matrix(spark, herd):
    g, z, _, v = herd
    rng = np.random.default_rng(1)
    w = rng.normal(size=(90, 3))
    found, squares, m = prediction.products(v, w)
    assert m == 300 and np.allclose(found, z.T @ (z @ w)) and np.allclose(squares, (z * z).sum(0))
    k = prediction.kinship_of(v, 90)
    dense = kinship.rescale(z.T @ z / 300)
    assert np.allclose(k @ w, dense @ w) and np.allclose(k.diagonal, np.diag(dense)) and np.allclose(k @ w[:, 0], dense @ w[:, 0])


def test_held_out_predictions_are_blup(spark, herd, monkeypatch):
    _, z, y, v = herd
    monkeypatch.setattr(prediction, "BLOCK", 32)
    part, other = y.copy(), y * 2 + 1
    part[::3], other[5:20] = np.nan, np.nan
    dense = kinship.rescale(z.T @ z / 300)
    found = prediction.predict_held_out(v, {"a": part, "b": other, "none": np.full(90, np.nan)}, 0.4).toPandas()
    for name, own in (("a", part), ("b", other)):
        rows = found[found.trait == name].sort_values("ordinal")
        assert (rows.known.to_numpy() == ~np.isnan(own)).all()
        assert np.allclose(rows.predicted, mixed.blup(dense, own, 0.4), atol=1e-8)
    assert set(found.trait) == {"a", "b"}
    assert np.allclose(prediction.predict_held_out(v, {"a": part}, 0.0).toPandas().predicted, np.nanmean(part))


def test_moments_find_h2(spark, herd):
    _, z, y, v = herd
    k = prediction.kinship_of(v, 90)
    dense = kinship.rescale(z.T @ z / 300)
    part = y.copy()
    part[::9] = np.nan
    use = np.flatnonzero(~np.isnan(part))
    c = np.eye(len(use)) - 1 / len(use)
    kk = c @ dense[np.ix_(use, use)] @ c
    own = c @ part[use]
    vg, ve = np.linalg.solve([[np.trace(kk @ kk), np.trace(kk)], [np.trace(kk), len(use) - 1]], [own @ kk @ own, own @ own])
    want = min(0.99, max(0.0, vg / (vg + ve)))
    assert prediction.moment_h2(k, part, probes=2000) == pytest.approx(want, abs=0.05)
    assert prediction.moment_h2(k, part) == prediction.moment_h2(k, part)
    with pytest.raises(ValueError):
        prediction.solve(k, use, 1.0, own[:, None])
    with pytest.raises(ArithmeticError):
        prediction.solve(k, use, 0.9, own[:, None], most=1)


def refitted(k, y, h2):
    """Each known sample predicted by a model without it, the others by all known."""
    out = mixed.blup(k, y, h2)
    for i in np.flatnonzero(~np.isnan(y)):
        less = y.copy()
        less[i] = np.nan
        out[i] = mixed.blup(k, less, h2)[i]
    return out


def test_terms_are_refitted_models(spark, herd):
    g, z, y, _ = herd
    y = y.copy()
    y[1::6] = np.nan
    kernel = ["a" if i < 100 else "b" if i < 112 else "wide" for i in range(300)]
    flat = np.ones(90)
    rows = [(n, [float(x) for x in r]) for n, r in zip(kernel, g, strict=True)] + [("flat", flat.tolist()), ("no share", g[0].tolist())]
    sites = spark.createDataFrame(rows, "kernel string, g array<double>")
    shares = {"a": 0.2, "b": 0.7, "wide": 0.0, "flat": 0.5}
    table = spark.createDataFrame(list(shares.items()), "kernel string, h2 double")
    dense = {n: kinship.rescale(z[[i for i in range(300) if kernel[i] == n]].T @ z[[i for i in range(300) if kernel[i] == n]]) for n in ("a", "b", "wide")}
    dense["global"] = kinship.rescale(z.T @ z / 300)
    want = {n: refitted(k, y, {**shares, "global": 0.4}[n]) for n, k in dense.items()}
    terms = prediction.global_term(spark, dense["global"], y, 0.4).unionByName(prediction.local_terms(sites, y, table)).cache()
    found = {(r.kernel, r.ordinal): r.term for r in terms.collect()}
    assert set(found) == {(n, i) for n in want for i in range(90)}
    assert all(found[n, i] == pytest.approx(want[n][i], abs=1e-8) for n, i in found)
    three = terms.where("kernel <> 'wide'")  # which is the mean alone
    predicted, weights = prediction.combined_prediction(three, y)
    x = np.column_stack([np.ones(90), want["a"], want["b"], want["global"]])
    known = ~np.isnan(y)
    b, *_ = np.linalg.lstsq(x[known], y[known], rcond=None)
    assert np.allclose([weights[n] for n in ("", "a", "b", "global")], b, atol=1e-6)
    rows = sorted(predicted.collect())
    assert [r.known for r in rows] == known.tolist() and np.allclose([r.predicted for r in rows], x @ b, atol=1e-6)
    with pytest.raises(ValueError):
        prediction.combined_prediction(three, y, most=2)


# --- windows by restricted likelihood ---


def test_local_reml_is_dense_reml(spark):
    rng = np.random.default_rng(15)
    n, m = 60, 120
    g = rng.integers(0, 3, (m, n)).astype(float)
    g[9] = 2.0
    y = g[30:34].sum(0) + rng.normal(size=n) * 2
    y[8] = np.nan
    v = store(spark, g)
    k = kinship.gram(v)
    windows = v.withColumn("w", F.floor(F.col("pos") / 6000))
    found = {r.w: r for r in mixed.local_components(windows, y, k, ["w"], restricted=True).collect()}
    assert len(found) == 20
    use = np.flatnonzero(~np.isnan(y))
    own, scaled, one = y[use], kinship.rescale(k[np.ix_(use, use)]), np.ones((len(use), 1))
    t = L.decorrelation(scaled, L.reml(own, one, scaled).delta)
    t_y, t_one = t @ own, t @ one[:, 0]
    for w, r in found.items():
        rows = [i for i in range(m) if (1000 * i + 1) // 6000 == w and i != 9]
        x = g[rows][:, use] @ t.T
        x = x - np.outer(x @ t_one, t_one) / (t_one @ t_one)
        x = x / np.sqrt((x * x).sum(1, keepdims=True) / (len(use) - 1))
        fit = L.reml(t_y, t_one[:, None], x.T @ x / len(rows))
        assert r.n_variants == len(rows) and r.loglik == pytest.approx(fit.loglik, abs=1e-6)
        assert r.v_local == pytest.approx(fit.h2, abs=1e-4)
        flat = L.reml(t_y, t_one[:, None], np.zeros((len(use), len(use)))).loglik
        assert r.pvalue == pytest.approx(float(chi2_sf(max(0.0, 2 * (fit.loglik - flat)), 1)) / 2, abs=1e-5)
    assert min(found.values(), key=lambda r: r.pvalue).w == 5


# --- regions ---


def plain_forward(t_g, names, t_one, t_y, rounds):
    """Joint fits of every candidate in every round."""
    chosen, out, n = [], [], len(t_y)
    null = t_y - t_one * (t_one @ t_y) / (t_one @ t_one)
    for r in range(1, rounds + 1):
        best = None
        for i in sorted(set(range(len(names))) - set(chosen), key=lambda i: names[i]):
            x = np.column_stack([t_one, *t_g[chosen], t_g[i]])
            if np.linalg.matrix_rank(x) < x.shape[1] or n - r - 1 < 1:
                continue
            b, *_ = np.linalg.lstsq(x, t_y, rcond=None)
            rss = float(((t_y - x @ b) ** 2).sum())
            if best is None or rss < best[1] - 1e-9:
                best = (i, rss, b[-1], np.linalg.inv(x.T @ x)[-1, -1])
        if best is None:
            break
        i, rss, b, spread = best
        chosen.append(i)
        df = n - r - 1
        out.append((r, *names[i], 1 - rss / float(null @ null) * (n - 1) / df, float(t_two_sided(abs(b) / np.sqrt(rss / df * spread), df))))
    return out


def test_forward_in_regions_is_joint_fits(spark):
    rng = np.random.default_rng(12)
    n, m = 50, 45
    g = rng.integers(0, 3, (m, n)).astype(float)
    g[7], g[13] = g[4], 1.0  # of equal variants the first by position; one that doesn't vary
    g[20, 3] = np.nan
    y = g[4] - g[10] + 0.5 * g[22] + rng.normal(size=n)
    y[6] = np.nan
    v = store(spark, g)
    names = [(1 + i % 3, 1000 * i + 1) for i in range(m)]
    regions = [("one", 1, 1, 45_000), ("two", 2, 1, 15_000), ("also two", 2, 4_001, 30_000), ("small", 3, 2_001, 5_001), ("dull", 2, 13_001, 13_001), ("none", 9, 1, 5)]
    table = spark.createDataFrame(regions, "region_id string, chr int, start long, end long")
    k = kinship.gram(v)
    found = mixed.forward_regions(v, table, y, k, 4).collect()
    use = np.flatnonzero(~np.isnan(y))
    scaled = kinship.rescale(k[np.ix_(use, use)])
    t = L.decorrelation(scaled, L.reml(y[use], np.ones((len(use), 1)), scaled).delta)
    full = np.where(np.isnan(g), np.nanmean(g[:, use], axis=1, keepdims=True), g)[:, use] @ t.T
    for name, chr_, start, end in regions:
        inside = [i for i, (c, p) in enumerate(names) if c == chr_ and start <= p <= end and i != 13]
        want = plain_forward(full[inside], [names[i] for i in inside], t @ np.ones(len(use)), t @ y[use], 4)
        got = sorted((r["round"], r.chr, r.pos, r.adj_r2, r.pvalue) for r in found if r.region_id == name)
        assert [x[:3] for x in got] == [x[:3] for x in want]
        assert np.allclose(np.array([x[3:] for x in got]), np.array([x[3:] for x in want]), rtol=1e-6, atol=1e-12)
    few = mixed.forward_regions(v, table, y, k, 4, p_limit=1e-3).collect()
    assert {(r.region_id, r["round"]) for r in few} < {(r.region_id, r["round"]) for r in found} and all(r.pvalue <= 1e-3 for r in few)
    assert mixed.forward_regions(v, table.where("false"), y, k, 2).count() == 0


# --- weights ---


def test_weights_are_the_dense_grid(spark, herd):
    g, z, y, v = herd
    k1, k2 = kinship.gram(v), kinship.gram(store(spark, g[:40]), "ibs")
    rng = np.random.default_rng(4)
    traits = {"own": y, "noise": rng.normal(size=90), "part": np.where(np.arange(90) % 4 == 0, np.nan, y), "flat": np.ones(90), "few": np.where(np.arange(90) < 2, y, np.nan)}
    rows = spark.createDataFrame([(n, [None if np.isnan(x) else float(x) for x in t]) for n, t in traits.items()], "trait string, y array<double>")
    found = {r.trait: r for r in mixed.kinship_weights(rows, k1, k2).collect()}
    assert set(found) == {"own", "noise", "part"}
    for name, r in found.items():
        use = np.flatnonzero(~np.isnan(traits[name]))
        own = traits[name][use]
        own = (own - own.mean()) / own.std(ddof=1)

        def at(percent, use=use, own=own):
            a = percent / 100
            values, vectors = L.descending(kinship.rescale(a * k1[np.ix_(use, use)] + (1 - a) * k2[np.ix_(use, use)]))
            return L.ml(vectors.T @ own, vectors.T @ np.ones((len(use), 1)), np.maximum(values, 0))

        best = lambda grid, at=at: max(grid, key=lambda p: (round(at(p).loglik, 9), -p))
        coarse = best(range(0, 101, 10))
        want = best(sorted({*range(0, 101, 10), *(p for p in range(coarse - 9, coarse + 10) if 0 <= p <= 100)}))
        assert (r.n, round(100 * r.alpha)) == (len(use), want)
        assert r.loglik == pytest.approx(at(want).loglik) and r.h2 == pytest.approx(at(want).h2, abs=1e-6)
        assert (r.h2_1, r.h2_2) == (pytest.approx(at(100).h2, abs=1e-6), pytest.approx(at(0).h2, abs=1e-6))
