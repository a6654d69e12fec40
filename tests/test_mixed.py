import numpy as np
import pytest
from pyspark.sql import functions as F

from genoflux.functions import likelihood as L
from genoflux.operators import joins, kernel_test, kinship, lm, mixed, simulate, stats

N = 80


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(8)
    g = rng.integers(0, 3, (120, N)).astype(float)
    y = 2.0 * g[17] - 1.5 * g[60] + rng.standard_normal(N)
    y[5] = np.nan
    rows = [(1 + i % 3, 1000 * i + 1, [None if (i + j) % 53 == 0 else float(v) for j, v in enumerate(r)]) for i, r in enumerate(g)]
    return g, y, spark.createDataFrame(rows, "chr int, pos long, g array<double>").repartition(4).cache()


def test_gram_is_the_long_form(spark, world):
    _, _, v = world
    few = v.where("pos < 30000")
    calls = few.select("chr", "pos", F.posexplode("g").alias("sample_id", "dosage"))
    for kind, long in (("ibs", kinship.ibs(calls)), ("rrm", kinship.rrm(calls))):
        dense = kinship.gram(few, kind)
        for r in long.where("i < j").collect()[:200]:
            assert dense[r.i, r.j] == pytest.approx(r.k, abs=1e-9)
    scaled = {(r.i, r.j): r.k for r in kinship.rescaled(kinship.tile_cells(kinship.gram_tiles(few))).collect()}
    assert scaled[3, 4] == pytest.approx(kinship.rescale(kinship.gram(few))[3, 4])


@pytest.mark.parametrize("pairs", [5, 1 << 20])
def test_pair_means_are_brute_force(spark, pairs):
    rng = np.random.default_rng(3)
    rows = [(1 + p % 2, p, f"s{s}", None if rng.random() < 0.1 else float(rng.integers(0, 3))) for p in range(1, 31) for s in range(9) if rng.random() < 0.6]
    rows += [(1, 3, "s2", 1.0), (1, 3, "s2", 2.0), (1, 5, None, 1.0), *((2, 50, f"s{s}", 0.1) for s in range(3)), (2, 51, "s0", 2.0)]
    calls = spark.createDataFrame(rows, "chr int, pos long, sample_id string, dosage double")
    regions = spark.createDataFrame([("x", 1, 1, 12), ("y", 1, 8, 40), ("z", 2, 1, 9), ("none", 3, 1, 9)], "region_id string, chr int, start long, end long")
    known = {}
    for c, p, s, d in rows:
        if s is not None and d is not None:
            known.setdefault((c, p), []).append((s, d))
    ibs, rrm, local = {}, {}, {}
    for (c, p), site in known.items():
        x = np.array([d for _, d in site])
        z = (x - x.mean()) / x.std(ddof=1) if len(set(x)) > 1 else None
        inside = [r.region_id for r in regions.collect() if r.chr == c and r.start <= p <= r.end]
        for m, (i, a) in enumerate(site):
            for n, (j, b) in enumerate(site):
                if i < j:
                    ibs.setdefault((i, j), []).append(1 - abs(a - b) / 2)
                if z is not None:
                    rrm.setdefault((i, j), []).append(z[m] * z[n])
                    for g in inside:
                        local.setdefault((g, i, j), []).append(z[m] * z[n])
    sites = kinship._by_site(calls)
    found = {(r.i, r.j): (r.k, r.n) for r in kinship._pair_means(sites, [], "ibs", pairs=pairs).collect()}
    assert found == {k: (pytest.approx(np.mean(v)), len(v)) for k, v in ibs.items()}
    found = {(r.i, r.j): (r.k, r.n) for r in kinship._pair_means(sites, [], "rrm", pairs=pairs).collect()}
    assert found == {k: (pytest.approx(np.mean(v), abs=1e-12), len(v)) for k, v in rrm.items() if k[0] <= k[1]}
    assert {(r.i, r.j): r.k for r in kinship.rrm(calls).collect()} == {k: pytest.approx(np.mean(v), abs=1e-12) for k, v in rrm.items()}
    found = {(r.region_id, r.i, r.j): r.k for r in kinship.local_rrm(calls, regions).collect()}
    assert found == {k: pytest.approx(np.mean(v), abs=1e-12) for k, v in local.items()}
    assert kinship.ibs(calls.where("pos < 0")).count() == 0


def test_dense_ibs_of_fractional_dosages(spark):
    g = np.random.default_rng(4).random((20, 6)) * 2
    g[3, 2] = g[7, 0] = np.nan
    v = spark.createDataFrame([(1, i, [None if np.isnan(x) else float(x) for x in row]) for i, row in enumerate(g)], "chr int, pos long, g array<double>").coalesce(1)
    for few in (g, np.round(g)):
        rows = v if few is g else v.withColumn("g", F.transform("g", lambda x: F.rint(x)))
        want = np.nanmean(1 - np.abs(few[:, :, None] - few[:, None, :]) / 2, axis=0)
        assert kinship.gram(rows, "ibs") == pytest.approx(want)


def test_identity_kinship_is_the_linear_scan(spark, world):
    _, y, v = world
    found = {(r.chr, r.pos): r for r in mixed.emmax(v, y, np.eye(N)).collect()}
    trait = spark.createDataFrame([(i, float(t)) for i, t in enumerate(y) if not np.isnan(t)], "sample_id long, y double")
    keep = F.expr("transform(g, (x, i) -> case when i = 5 then null else x end)")
    full = v.where(F.expr("not exists(g, x -> x is null)")).withColumn("g", keep)
    calls = full.select("chr", "pos", F.posexplode("g").alias("sample_id", "dosage"))
    scanned = lm.scan(lm.matched(calls.withColumn("sample_id", F.col("sample_id").cast("long")), trait)).collect()
    for r in scanned:
        assert found[r.chr, r.pos].t2 == pytest.approx(r.t2, rel=1e-6)


def test_selection_finds_the_causal_variants(world):
    _, y, v = world
    k = kinship.gram(v)
    rows = mixed.forward_mixed(v, y, k, 2).collect()
    assert {r.pos for r in rows} == {17001, 60001}
    sites = [(r.chr, r.pos) for r in rows]
    joint = mixed.joint_model(v, y, k, sites)
    assert joint["adj_r2"] > 0.5 and max(joint["p"][1:]) < 1e-6
    with pytest.raises(ValueError):
        mixed.joint_model(v, y, k, [(9, 9)])
    assert mixed.predict_by_markers(v, y, sites)["r"] > 0.5
    p = {r.pos: r.p for r in mixed.permutation_p_mixed(v, y, k, 100).collect()}
    assert p[17001] == 0


def test_scans_agree(world):
    _, y, v = world
    k = kinship.gram(v)
    best = mixed.fastlmm(v, y, k).orderBy("pvalue").first()
    assert best.pos in (17001, 60001)
    values, vectors = np.linalg.eigh(k)
    low = mixed.low_rank_scan(v, y, vectors * np.sqrt(np.maximum(values, 0)))
    assert low.orderBy("pvalue").first().pos == best.pos


def test_local_components(world):
    _, y, v = world
    windows = v.withColumn("w", F.floor(F.col("pos") / 10000))
    k = kinship.gram(v)
    rows = mixed.local_components(windows, y, k, ["w"]).collect()
    assert min(rows, key=lambda r: r.pvalue).w in (1, 6)
    assert all(abs(r.v_local + r.v_global + r.v_error - 1) < 1e-9 for r in rows)
    grid = mixed.local_grid(windows.where("w = 1"), y, k, ["w"], 0.25).collect()
    assert max(grid, key=lambda r: r.loglik).alpha > 0


def test_predictions(spark, world):
    g, y, v = world
    k = kinship.rescale(kinship.gram(v))
    loo = mixed.leave_one_out(spark, k, y, 0.6).toPandas().set_index("ordinal")
    i = int(loo.index[3])
    others = y.copy()
    mean = np.nanmean(y)
    others[i] = np.nan
    known = ~np.isnan(others)
    kk = k[np.ix_(known, known)]
    want = mean + 0.6 * k[i, known] @ np.linalg.solve(0.6 * kk + 0.4 * np.eye(known.sum()), others[known] - mean)
    assert loo.predicted[i] == pytest.approx(want)
    out = mixed.combined_blup(k, [k], [0.3], y, 0.5)
    assert set(out) == {"global", "sum", "weighted", "regression"} and all(len(x) == N for x in out.values())


def test_gene_test_p_is_uniform_under_the_null_and_small_else(world):
    _, y, v = world
    genes = v.withColumns({"gene": F.floor(F.col("pos") / 6000).cast("string"), "weight": F.lit(1.0)})
    rows = kernel_test.gene_p(genes, y).collect()
    best = sorted(rows, key=lambda r: r.pvalue)[:2]
    assert {r.gene for r in best} & {"2", "10"}
    null = kernel_test.gene_p(genes, np.random.default_rng(1).standard_normal(N)).toPandas()
    assert 0.2 < null.pvalue.mean() < 0.8


def test_heritability_of_noise_and_of_structure(spark, world):
    _, _, v = world
    k = kinship.rescale(kinship.gram(v))
    rng = np.random.default_rng(2)
    structured = (np.linalg.cholesky(k + 0.05 * np.eye(N)) @ rng.standard_normal(N)).tolist()
    traits = spark.createDataFrame([("g", structured), ("short", [1.0, None] + [None] * (N - 2))], "trait string, y array<double>")
    rows = mixed.heritability(traits, k).collect()
    assert [r.trait for r in rows] == ["g"] and rows[0].h2 > 0.5


def test_heritability_by_brute_force(spark, world):
    _, y, v = world
    k = kinship.gram(v, "ibs")
    traits = spark.createDataFrame([("a", [None if np.isnan(t) else float(t) for t in y]), ("b", [float(i % 7) for i in range(N)])], "trait string, y array<double>")
    rows = {r.trait: r for r in mixed.heritability(traits, k).collect()}
    use = ~np.isnan(y)
    own, kk = y[use], kinship.rescale(k[np.ix_(use, use)])

    def at(h):
        cov = h * kk + (1 - h) * np.eye(len(own))
        inv, one = np.linalg.inv(cov), np.ones(len(own))
        r = own - (one @ inv @ own) / (one @ inv @ one)
        return -len(own) / 2 * (np.log(2 * np.pi * (r @ inv @ r) / len(own)) + 1) - np.linalg.slogdet(cov)[1] / 2

    grid = np.linspace(0.001, 0.999, 999)
    best = grid[int(np.argmax([at(h) for h in grid]))]
    got = rows["a"]
    assert got.n == N - 1 and got.h2 == pytest.approx(best, abs=2e-3) and got.loglik == pytest.approx(at(got.h2), abs=1e-6)
    h = min(0.98, max(0.02, got.h2))
    assert L.information(*_rotated(own, kk), h) == pytest.approx(-(at(h + 1e-3) - 2 * at(h) + at(h - 1e-3)) / 1e-6, rel=1e-3, abs=1e-2)
    assert got.low is None or got.high - got.low == pytest.approx(2 * 1.96 / np.sqrt(got.information))
    values, vectors = np.linalg.eigh(kinship.rescale(k))
    low = {r.trait: r for r in mixed.heritability_low_rank(traits, vectors * np.sqrt(np.maximum(values, 0))).collect()}
    assert low["b"].h2 == pytest.approx(rows["b"].h2, abs=1e-4)
    both = {r.trait: r for r in mixed.compare_kinships(traits, k, np.eye(N)).collect()}
    assert both["a"].loglik_1 == pytest.approx(got.loglik) and both["a"].n == N - 1


def _rotated(y, k):
    values, vectors = L.descending(k)
    return vectors.T @ y, vectors.T @ np.ones((len(y), 1)), np.maximum(values, 0)


def test_regions_and_burdens(spark, world):
    g, y, v = world
    k = kinship.gram(v)
    regions = spark.createDataFrame([("r", 1, 1, 20000), ("s", 1, 15000, 30000), ("empty", 9, 1, 5)], "region_id string, chr int, start long, end long")
    scan = {(r.chr, r.pos): r for r in mixed.emmax(v, y, k).collect()}
    found = mixed.emmax_regions(v, regions, y, k, 120.0).collect()  # a limit of 1
    inside = {(name, c, p) for c, p in scan for name, a, b in (("r", 1, 20000), ("s", 15000, 30000)) if c == 1 and a <= p <= b}
    assert {(r.region_id, r.chr, r.pos) for r in found} == inside
    assert all(r.pvalue == pytest.approx(scan[r.chr, r.pos].pvalue, rel=1e-6) for r in found)
    few = mixed.emmax_regions(v, regions, y, k, 6.0).collect()
    assert {(r.region_id, r.pos) for r in few} == {(r.region_id, r.pos) for r in found if r.pvalue <= 0.05}
    rare = spark.createDataFrame([(1, 10, [0.0, 0.0, 0.0, 2.0, 0.0, None]), (1, 20, [2.0, 2.0, 1.0, 2.0, 2.0, 2.0]), (1, 30, [0.0, 2.0, 0.0, 2.0, 0.0, 2.0]), (1, 40, [1.0, 0.0, 2.0, 0.0, 0.0, 0.0])], "chr int, pos long, g array<double>")
    got = {r.region_id: (r.start, r.g) for r in mixed.burden_arrays(rare, regions, 6, 0.4).collect()}
    # 10: code 2 twice; 20: code 1 once; 30: six of six, common; 40: three codes, fewer twos, so code 1
    assert got == {"r": (1, [2.0, 0.0, 2.0, 2.0, 0.0, 0.0])}


def test_default_weights(spark):
    rows = spark.createDataFrame([("a", 1, 5, s, d) for s, d in enumerate([0.0, 1.0, None, 2.0, 2.0])] + [("a", 1, 6, 0, None)], "gene string, chr int, pos long, sample_id long, dosage double")
    w = {r.pos: r.weight for r in kernel_test.with_default_weights(rows).collect()}
    assert w[5] == pytest.approx(25 * (1 - 0.375) ** 24) and w[6] == 0


def test_pairs_of_blocks_give_the_same_distance_correlation(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((70, 2))
    z = x[:, :1] ** 2 + 0.1 * rng.standard_normal((70, 1))
    rows = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, z, strict=True))], "id long, a array<double>, b array<double>")
    one, many = (stats.distance_correlation(rows, "id", "a", "b", n).first() for n in (1000, 9))
    assert one.n == many.n == 70 and one.dcor == pytest.approx(many.dcor, rel=1e-9)


def test_flanking_markers_across_bins(spark):
    rng = np.random.default_rng(7)
    points, marks = ([(int(c), int(p)) for c, p in zip(rng.integers(1, 4, n), rng.integers(1, 5000, n), strict=True)] for n in (150, 25))
    marks = [m for m in marks if m[0] != 3]
    got = joins.flanking_markers(spark.createDataFrame(points, "chr int, pos long"), spark.createDataFrame(marks, "chr int, pos long"), 300).collect()
    want = {(c, p): (max((m for d, m in marks if d == c and m < p), default=None), min((m for d, m in marks if d == c and m >= p), default=None)) for c, p in points}
    assert {(r.chr, r.pos): (r.left_pos, r.right_pos) for r in got} == want and len(got) == len(want)


def test_small_tools(spark):
    rows = spark.createDataFrame([(i, float(np.exp(x))) for i, x in enumerate(np.random.default_rng(3).standard_normal(400))], "id long, v double")
    assert stats.best_transform(rows, "v").first()["transform"] == "log"
    assert stats.histogram(rows, "v", 7).agg(F.sum("n")).first()[0] == 400
    assert stats.normalized_columns(rows, ["v"]).agg(F.sum("v")).first()[0] == pytest.approx(1)
    kept = stats.jackknife(rows, "id", 5, 0.25).groupBy("round").count().collect()
    assert len(kept) == 5 and all(250 < r["count"] < 350 for r in kept)
    sites = spark.range(50).select(F.lit(1).alias("chr"), F.col("id").alias("pos"))
    assert simulate.effects(sites, "decay", 1, 0.5).agg(F.max("effect")).first()[0] == 1
    assert simulate.effects(sites, "signed", 1).where("effect < 0").count() > 5
    assert abs(simulate.effects(sites, "normal", 1).agg(F.avg("effect")).first()[0]) < 0.6
    assert np.isfinite(L.null_loglik(np.arange(5.0), np.ones((5, 1))))
