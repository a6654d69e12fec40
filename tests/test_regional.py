"""Peaks and their matrices, representatives, stores brought together, slices of gene models."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoflux.operators import joins, kinship, stats
from genoflux.sources import genotypes


def plain_peaks(hits, width):
    """In order of position; every peak so far is tried, the last that is near takes the hit."""
    found = []
    for chr_, pos, p in sorted(hits):
        near = [i for i, (c, at, _) in enumerate(found) if c == chr_ and abs(at - pos) < width]
        if not near:
            found.append((chr_, pos, p))
        elif p < found[near[-1]][2]:
            found[near[-1]] = (chr_, pos, p)
    return sorted(found)


def test_peaks_are_the_walk(spark):
    rng = np.random.default_rng(4)
    hits = [(int(c), int(pos), float(p)) for c in (1, 2, 7) for pos, p in zip(rng.choice(4000, 300, replace=False), np.round(rng.random(300), 2), strict=True)]
    rows = spark.createDataFrame(hits, "chr int, pos long, pvalue double").repartition(7)
    for width in (1, 9, 60, 10_000):
        assert sorted(map(tuple, joins.peaks(rows, width).collect())) == plain_peaks(hits, width)
    # a peak that moves takes hits that its first place did not reach
    moving = [(1, 10, 0.5), (1, 15, 0.4), (1, 22, 0.3), (1, 40, 0.9)]
    assert sorted(map(tuple, joins.peaks(spark.createDataFrame(moving, "chr int, pos long, pvalue double"), 8).collect())) == [(1, 22, 0.3), (1, 40, 0.9)]
    twice = spark.createDataFrame([(1, 5, 0.2), (1, 5, 0.1), (1, 5, None)], "chr int, pos long, pvalue double")
    assert joins.peaks(twice, 8).collect() == [(1, 5, 0.1)]
    assert joins.peaks(twice.where("chr = 3"), 8).count() == 0
    region = joins.peak_regions(joins.peaks(twice, 8), 30).first()
    assert (region.region_id, region.start, region.end) == ("1:5", 5, 35)


@pytest.mark.parametrize("kind", ["rrm", "ibs"])
@pytest.mark.parametrize("tile", [3, 64])
def test_regional_tiles_are_local_matrices(spark, kind, tile):
    rng = np.random.default_rng(8)
    g = rng.integers(0, 3, (60, 7)).astype(object)
    g[rng.random(g.shape) < 0.1] = None
    store = [(int(v % 2 + 1), int(10 * v + 1), [None if x is None else float(x) for x in g[v]]) for v in range(60)]
    variants = spark.createDataFrame(store, "chr int, pos long, g array<double>").repartition(5)
    # overlapping regions, one with nearly all rows, one of a single variant, one of none
    regions = spark.createDataFrame([("a", 1, 1, 590), ("b", 1, 100, 250), ("c", 2, 11, 11), ("d", 2, 5000, 6000)], "region_id string, chr int, start long, end long")
    tiles = kinship.regional_tiles(variants, regions, kind, tile=tile)
    got = {(r.region_id, r.i, r.j): r.k for r in kinship.tile_cells(tiles, ("region_id",)).collect()}
    assert {key[0] for key in got} == {"a", "b", "c"} and len(got) == 3 * 49
    calls = variants.select("chr", "pos", F.posexplode("g").alias("sample_id", "dosage")).where("dosage is not null")
    if kind == "rrm":
        want = {(r.region_id, r.i, r.j): r.k for r in kinship.local_rrm(calls, regions).collect()}
        assert want and all(math.isclose(got[key], k, abs_tol=1e-12) for key, k in want.items())
        assert all(got[key] == 0 for key in got.keys() - want.keys())
        return
    for name, chr_, low, high in (("a", 1, 1, 590), ("b", 1, 100, 250), ("c", 2, 11, 11)):
        rows = [x for c, pos, x in store if c == chr_ and low <= pos <= high]
        for i in range(7):
            for j in range(7):
                both = [1 - abs(x[i] - x[j]) / 2 for x in rows if x[i] is not None and x[j] is not None]
                assert math.isclose(got[name, i, j], 1 if i == j else np.mean(both) if both else 0, abs_tol=1e-12)


def test_regional_tiles_in_chunks(spark):
    rng = np.random.default_rng(9)
    rows = [(f"r{v % 3}", rng.integers(0, 3, 5).astype(float).tolist()) for v in range(90)]
    store = spark.createDataFrame(rows, "own string, g array<double>").repartition(2)
    small = {(r.own, r.i, r.bj): r.k for r in kinship.gram_tiles(store, tile=2, chunk_bytes=200, by="own").collect()}
    large = {(r.own, r.i, r.bj): r.k for r in kinship.gram_tiles(store, tile=2, by="own").collect()}
    assert small.keys() == large.keys() and len(small) == 3 * (3 + 3 + 2 + 2 + 1)
    assert all(np.allclose(small[key], large[key], atol=1e-12) for key in small)


def plain_representatives(points, centres, least):
    def near(x, among):
        return min((math.dist(x, centres[c]), c) for c in among)

    first = [near(x, range(len(centres)))[1] for x in points.values()]
    kept = [c for c in range(len(centres)) if first.count(c) >= least]
    members = {}
    for id_, x in points.items() if kept else ():
        gap, c = near(x, kept)
        members.setdefault(c, []).append((gap, id_))
    return sorted((c, min(m)[1], round(min(m)[0], 9), len(m)) for c, m in members.items())


@pytest.mark.parametrize("least", [1, 8, 20, 1000])
def test_representatives(spark, least):
    rng = np.random.default_rng(5)
    points = {f"p{i:03}": rng.integers(0, 9, 3).astype(float).tolist() for i in range(120)}  # many ties
    centres = [[0.0, 0.0, 0.0], [8.0, 8.0, 8.0], [4.0, 4.0, 4.0], [4.0, 4.0, 4.0], [8.0, 0.0, 8.0]]
    rows = spark.createDataFrame([*points.items(), ("none", None)], "id string, x array<double>").repartition(6)
    got = sorted((r.cluster, r.representative, round(r.gap, 9), r.size) for r in stats.representatives(rows, "id", "x", centres, least).collect())
    assert got == plain_representatives(points, centres, least)
    assert stats.representatives(rows, "id", "x", [], least).count() == 0
    assert stats.representatives(rows.where("id = 'x'"), "id", "x", centres, least).count() == 0


def test_best_clusters(spark):
    rng = np.random.default_rng(6)
    middles = [(0, 0), (50, 0), (0, 50)]
    points = [(10 * c + i, [float(v) for v in np.array(middles[c]) + (rng.normal(size=2) if i else 0)]) for c in range(3) for i in range(10)]
    rows = spark.createDataFrame(points, "id long, x array<double>")
    found = stats.best_clusters(rows, "id", "x", [2, 3, 4]).collect()
    assert {r.k for r in found} == {3} and sorted(r.size for r in found) == [10, 10, 10]
    for r in found:
        own = {i: np.array(x) for i, x in points if i // 10 == r.representative // 10}
        middle = np.mean(list(own.values()), axis=0)
        assert r.representative == min(own, key=lambda i: math.dist(own[i], middle))


def test_stores_are_brought_together(spark, tmp_path):
    ga = [(1, 5, [0.0, 1.0, 2.0, None]), (1, 9, [2.0, 2.0, 0.0, 1.0])]
    gb = [(2, 7, [1.0, None, 0.0]), (3, 1, [0.0, 2.0, 2.0])]
    schema = "chr int, pos long, g array<double>"
    genotypes.write_store(spark.createDataFrame(ga, schema), ["a", "b", "c", "d"], str(tmp_path / "a"))
    genotypes.write_packed(spark.createDataFrame(gb, schema), ["d", "x", "a"], str(tmp_path / "b"))
    trait = spark.createDataFrame([("a", "t", 1.5), ("a", "u", None), ("d", "t", 2.0), ("b", "t", 3.0), ("z", "t", 4.0), (None, "t", 0.0)], "sample_id string, phe_id string, value double")
    first, second = (genotypes.read_store(spark, str(tmp_path / s)) for s in "ab")
    x, y, samples = genotypes.aligned(first, second, trait)
    assert {(r.chr, r.pos): r.g for r in x.collect()} == {(1, 5): [0, None], (1, 9): [2, 1]}
    assert {(r.chr, r.pos): r.g for r in y.collect()} == {(2, 7): [0, 1], (3, 1): [2, 0]}
    assert sorted((r.ordinal, r.sample_id, r.phe_id, r.value) for r in samples.where("phe_id = 't'").collect()) == [(0, "a", "t", 1.5), (1, "d", "t", 2.0)]
    assert samples.count() == 3
    plan = x._jdf.queryExecution().sparkPlan().toString().splitlines()
    assert "BroadcastNestedLoopJoin" in next(line for line in plan if "Join" in line)  # the variants stay where they are
    nobody = genotypes.aligned(first, second, trait.where("sample_id = 'z'"))
    assert [r.g for r in nobody[0].collect()] == [[], []] and nobody[2].count() == 0


def test_slices_of_three_genes(spark, tmp_path):
    v = spark.createDataFrame([(1, 5, [0.0, 1.0, None]), (1, 20, [2.0, 0.0, 0.0]), (1, 100, [1.0, 1.0, 1.0]), (2, 5, [0.0, 0.0, 2.0])], "chr int, pos long, g array<double>")
    models = spark.createDataFrame(
        [("007", 1, 20, "rs20", "C", "G", 0.5, "EN"), ("007", 1, 5, None, None, None, None, "eQTL"), ("007", 1, 6, "rs6", "A", "C", 1.0, "EN"), ("b c", 2, 5, "rs5", "G", "T", -1.25, "NULL"), ("d", 1, 100, "rs100", "A", "G", 2.0, "EN"), ("d", 1, 5, "rsx", "T", "A", 3.0, "EN")],
        "gene string, chr int, pos long, rsid string, ref string, alt string, weight double, origin string")
    manifest = genotypes.write_slices(v, models, str(tmp_path / "s"), {"EN": ["EN"], "all": ["EN", "eQTL", "NULL"]}, 3)
    assert sorted(map(tuple, manifest.collect())) == [("007", "EN", 2, 1), ("007", "all", 3, 2), ("b c", "all", 1, 1), ("d", "EN", 2, 2), ("d", "all", 2, 2)]

    def lines(gene, subset, kind):
        files = sorted((tmp_path / "s" / "text" / f"gene={gene}" / f"subset={subset}" / f"kind={kind}").glob("part-*"))
        return "".join(f.read_text() for f in files).splitlines()

    assert lines("007", "all", "tped") == ["1 rs_5 0 5 A A A T 0 0", "1 rs20 0 20 G G C C C C"]
    assert lines("007", "all", "setid") == ["007\trs_5", "007\trs20"] and lines("007", "all", "weights") == ["rs_5\t0.0", "rs20\t0.5"]
    assert lines("007", "EN", "tped") == ["1 rs20 0 20 G G C C C C"]
    assert lines("b c", "all", "tped") == ["2 rs5 0 5 G G G G T T"] and lines("b c", "EN", "tped") == []
    assert lines("d", "EN", "weights") == ["rsx\t3.0", "rs100\t2.0"]
    back = genotypes.read_slices(spark, str(tmp_path / "s"))
    assert back.where("gene = '007'").count() == 9 and back.schema["gene"].dataType.simpleString() == "string"
    # letters are passed through; models without further columns take the defaults
    letters = spark.createDataFrame([(1, 5, ["A G", None])], "chr int, pos long, g array<string>")
    genotypes.write_slices(letters, models.select("gene", "chr", "pos"), str(tmp_path / "t"))
    assert genotypes.read_slices(spark, str(tmp_path / "t")).where("gene = 'd' and kind = 'tped'").first().value == "1 rs_5 0 5 A G 0 0"
    samples = spark.createDataFrame([(1, "n"), (0, "m")], "ordinal int, sample_id string")
    genotypes.write_tfam(samples, str(tmp_path / "fam"), spark.createDataFrame([("m", 1.5)], "sample_id string, value double"))
    assert [r.value for r in spark.read.text(str(tmp_path / "fam")).collect()] == ["m m 0 0 0 1.5", "n n 0 0 0 -9"]
