"""The packed store: round trips, pruning, and scans equal to those of doubles."""

import glob

import numpy as np
import pyarrow.parquet as pq
import pytest

from genoflux.functions.alleles import packed, unpacked
from genoflux.operators import kinship, mixed, prediction, variants
from genoflux.sources import genotypes


def store(spark, m, n, missing=0.1, seed=2):
    rng = np.random.default_rng(seed)
    g = rng.integers(0, 3, (m, n)).astype(float)
    g[rng.random(g.shape) < missing] = np.nan
    rows = [(1 + i % 2, 10 * i + 1, [None if np.isnan(x) else float(x) for x in r]) for i, r in enumerate(g)]
    return g, spark.createDataFrame(rows, "chr int, pos long, g array<double>")


@pytest.mark.parametrize("n", [1, 3, 4, 5, 17])
def test_codes_round_trip(n):
    rng = np.random.default_rng(n)
    g = rng.integers(0, 4, (30, n)).astype(float)
    g[g == 3] = np.nan
    codes = packed(g)
    assert codes.dtype == np.uint8 and codes.shape == (30, -(-n // 4))
    back = unpacked(codes)
    assert np.array_equal(back[:, :n], g, equal_nan=True) and np.isnan(back[:, n:]).all()
    for bad in (0.5, 3.0, -1.0, np.inf):
        with pytest.raises(ValueError):
            packed(np.array([[0.0, bad]]))


def test_a_store_gives_back_its_calls(spark, tmp_path):
    g, v = store(spark, 40, 13)
    names = [f"s{i}" for i in range(13)]
    genotypes.write_packed(v, names, str(tmp_path / "p"))
    rows, samples = genotypes.read_store(spark, str(tmp_path / "p"))
    assert [r.sample_id for r in samples.orderBy("ordinal").collect()] == names
    found = {(r.chr, r.pos): r.g for r in genotypes.unpack(rows, 13).collect()}
    assert found == {(1 + i % 2, 10 * i + 1): [None if np.isnan(x) else x for x in r] for i, r in enumerate(g)}
    for bad in ([(1, 1, [0.0])], [(1, 1, [0.5] * 13)]):
        with pytest.raises(Exception, match="packed|one call"):
            genotypes.write_packed(spark.createDataFrame(bad, "chr int, pos long, g array<double>"), names, str(tmp_path / f"bad{len(bad[0][2])}"))


def test_regions_prune_folders_and_row_groups(spark, tmp_path):
    _, v = store(spark, 4000, 400, 0)
    path = str(tmp_path / "p")
    genotypes.write_packed(v, [str(i) for i in range(400)], path, group_bytes=16 << 10)
    groups = [pq.ParquetFile(f).metadata for f in glob.glob(f"{path}/variants/chr=1/*.parquet")]
    spans = [(m.row_group(i).column(0).statistics.min, m.row_group(i).column(0).statistics.max) for m in groups for i in range(m.num_row_groups)]
    inside = [s for s in spans if s[1] >= 20_001 and s[0] <= 21_001]
    assert len(spans) > 4 and len(inside) < len(spans)
    rows, _ = genotypes.read_store(spark, path)
    region = variants.in_region(rows, 1, 20_001, 21_001)
    plan = region._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chr" in plan and "GreaterThanOrEqual(pos,20001)" in plan and "LessThanOrEqual(pos,21001)" in plan
    assert region.count() == 51


def test_scans_of_packed_calls_are_those_of_doubles(spark, tmp_path):
    g, v = store(spark, 90, 50)
    genotypes.write_packed(v, [str(i) for i in range(50)], str(tmp_path / "p"))
    rows, _ = genotypes.read_store(spark, str(tmp_path / "p"))
    rng = np.random.default_rng(1)
    y = np.nansum(g[:5], axis=0) + rng.normal(size=50)
    y[7] = np.nan
    k = kinship.gram(v)
    for scan in (mixed.emmax, mixed.fastlmm):
        a, b = (sorted(map(tuple, scan(x, y, k).collect())) for x in (v, rows))
        assert len(a) == len(b) == 90 and np.allclose(np.array(a, float), np.array(b, float), rtol=1e-4, atol=1e-6)
    one, two = (prediction.predict_held_out(x, {"y": y}, 0.5).toPandas().predicted for x in (v, rows))
    assert np.allclose(one, two)
