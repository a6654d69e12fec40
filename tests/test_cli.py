import numpy as np
import pytest

from genoflux.__main__ import parser, run
from genoflux.sources import tables


def test_from_files_to_results(spark, tmp_path):
    rng = np.random.default_rng(3)
    g = rng.integers(0, 3, (60, 50))
    y = 3.0 * g[20] + rng.standard_normal(50)
    ids = [f"s{j}" for j in range(50)]
    (tmp_path / "g.csv").write_text("CHR,LOC," + ",".join(ids) + "\n" + "".join(f"{1 + i % 2},{100 * i + 1}," + ",".join(map(str, r)) + "\n" for i, r in enumerate(g)))
    (tmp_path / "p.tsv").write_text("ID\theight\tfew\n" + "".join(f"{s}\t{v}\t{v if j < 5 else 'NA'}\n" for j, (s, v) in enumerate(zip(ids, y, strict=True))))
    (tmp_path / "m.tsv").write_text("g1\t1\t1\t9999\trs1_2001_A_T_0.5\trs2_2201_A_T_0.5\ng2\t2\t1\t9999\trs3_101_A_T_1\trs4_301_A_T_1\n")
    at = lambda *names: [str(tmp_path / n) for n in names]
    store, kin, phe, csv, mod = at("store", "kin", "p.tsv", "g.csv", "m.tsv")

    def call(*words):
        run(spark, parser().parse_args(list(words)))

    call("import", "--genotypes", csv, "--out", store)
    call("kinship", "--store", store, "--out", kin)
    common = ["--store", store, "--phenotypes", phe, "--min-samples", "20"]
    call("lm", *common, "--out", *at("lm"))
    call("emmax", *common, "--kinship", kin, "--out", *at("emmax"))
    for name in ("lm", "emmax"):
        best = tables.read_results(spark, str(tmp_path / name / "height"), 1.0).orderBy("pvalue").first()
        assert best.pos == 2001 and best.coef == pytest.approx(3, abs=0.7)
        assert not (tmp_path / name / "few").exists()
    call("fastlmm", *common, "--kinship", kin, "--out", *at("fl"))
    call("heritability", *common, "--kinship", kin, "--out", *at("h2"))
    call("local", *common, "--kinship", kin, "--width", "1000", "--out", *at("loc"))
    call("genes", *common, "--models", mod, "--out", *at("genes"))
    genes = spark.read.csv(str(tmp_path / "genes" / "height"), header=True, inferSchema=True).collect()
    assert {r.gene: r.pvalue < 0.001 for r in genes} == {"g1": True, "g2": False}
    (tmp_path / "r.tsv").write_text("r1\t1\t1901\t2301\nr2\t2\t101\t501\n")
    call("regions", *common, "--kinship", kin, "--regions", *at("r.tsv"), "--out", *at("reg"))
    found = spark.read.csv(str(tmp_path / "reg" / "height"), header=True, inferSchema=True).collect()
    assert {r.region_id for r in found} == {"r1", "r2"}
    assert sorted((r.chr, r.pos) for r in found) == [(1, 2001), (1, 2201), (2, 101), (2, 301), (2, 501)]
    assert min(found, key=lambda r: r.pvalue).pos == 2001
    call("burden", *common, "--kinship", kin, "--regions", *at("r.tsv"), "--rare", "0.5", "--out", *at("bur"))
    assert {r.region_id for r in spark.read.csv(str(tmp_path / "bur" / "height"), header=True).collect()} <= {"r1", "r2"}
    call("stepwise", *common, "--kinship", kin, "--rounds", "2", "--out", *at("step"))
    rounds = spark.read.csv(str(tmp_path / "step" / "height"), header=True, inferSchema=True).orderBy("round").collect()
    assert [r["round"] for r in rounds] == [1, 2] and rounds[0].pos == 2001
    call("peaks", "--store", store, "--results", *at("lm/height"), "--p", "1e-6", "--peak", "500", "--width", "1000", "--out", *at("peaks"))
    assert [r.region_id for r in spark.read.csv(str(tmp_path / "peaks" / "peaks"), header=True).collect()] == ["1:2001"]
    cells = spark.read.csv(str(tmp_path / "peaks" / "kinships"), header=True, inferSchema=True)
    z = (g[20:31:2] - g[20:31:2].mean(1, keepdims=True)) / g[20:31:2].std(1, ddof=1, keepdims=True)
    assert cells.count() == 2500 and cells.where("i = 3 and j = 7").first().k == pytest.approx((z.T @ z)[3, 7] / 6, abs=1e-9)
    call("slices", "--store", store, "--models", mod, "--out", *at("slices"))
    lines = spark.read.text(str(tmp_path / "slices" / "text" / "gene=g1" / "subset=all" / "kind=weights")).collect()
    assert sorted(r.value for r in lines) == ["rs1\t0.5", "rs2\t0.5"]
    call("fastlmm", *common, "--kinship", kin, "--reml", "--out", *at("reml"))
    best = spark.read.csv(str(tmp_path / "reml" / "height"), header=True, inferSchema=True).orderBy("pvalue").first()
    assert best.pos == 2001 and 0 < best.r2 < 1
    call("families", *common, "--rounds", "2", "--separator", "s", "--out", *at("fam"))
    assert spark.read.csv(str(tmp_path / "fam" / "height"), header=True, inferSchema=True).where("round = 1").first().pos == 2001
    (tmp_path / "c.tsv").write_text("c1\t1;1901;2301\t1;2101;2501\n")
    call("compounds", *common, "--kinship", kin, "--compounds", *at("c.tsv"), "--out", *at("com"))
    (row,) = spark.read.csv(str(tmp_path / "com" / "height"), header=True, inferSchema=True).collect()
    assert (row.compound_id, row.n_variants) == ("c1", 3)
    call("permutation", *common, "--kinship", kin, "--rounds", "50", "--out", *at("perm"))
    assert spark.read.csv(str(tmp_path / "perm" / "height"), header=True, inferSchema=True).where("pos = 2001").first().p == 0
