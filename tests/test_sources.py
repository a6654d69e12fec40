import pytest
from pyspark.sql import functions as F

from genoflux.operators import crosses, kinship, lm, simulate, variants
from genoflux.sources import genotypes, models, tables


@pytest.fixture
def write(tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    return put


def test_genotype_csv_and_store(spark, write, tmp_path):
    path = write("g.csv", "CHR,LOC,a,b,c\n2,5,0,1,2\nchr1,7,NA,0,0\nX,3,1,1,1\n")
    v, samples = genotypes.read_csv(spark, path)
    assert samples == ["a", "b", "c"]
    rows = {(r.chr, r.pos): r for r in v.collect()}
    assert rows[2, 5].g == [0, 1, 2] and rows[2, 5].mafc == 1
    assert rows[1, 7].g == [None, 0, 0] and (23, 3) in rows
    genotypes.write_store(v, samples, str(tmp_path / "store"))
    back, names = genotypes.read_store(spark, str(tmp_path / "store"))
    assert back.count() == 3 and names.count() == 3
    calls = genotypes.to_calls(back, names)
    assert variants.polymorphic(calls).collect() == [(2, 5)]
    assert genotypes.subset(v, samples, ["c", "a"]).where("chr = 2").first().g == [2, 0]
    genotypes.write_csv(v, samples, str(tmp_path / "out"))
    again, _ = genotypes.read_csv(spark, str(tmp_path / "out"))
    assert sorted(map(str, again.collect())) == sorted(map(str, v.collect()))
    with pytest.raises(Exception, match="ragged"):
        genotypes.read_csv(spark, write("r.csv", "CHR,LOC,a,b\n1,5,0\n"))[0].collect()


def test_tped(spark, write):
    tped = write("t.tped", "1 rs1 0 10 A A A G\n0 rs2 0 11 A A A A\n25 rs3 0 12 A A A A\n2\trs4\t0\t20\tC\tT\t0\t0\n")
    tfam = write("t.tfam", "f1\ta\t0\t0\t0\t1\nf2\tb\t0\t0\t0\t-9\n")
    v, samples = genotypes.read_tped(spark, tped, tfam)
    assert sorted((r.chr, r.pos, r.g) for r in v.collect()) == [(1, 10, ["A", "R"]), (2, 20, ["Y", None])]
    assert [(r.sample_id, r.phenotype) for r in samples.orderBy("ordinal").collect()] == [("a", 1.0), ("b", None)]


def test_phenotypes(spark, write, tmp_path):
    path = write("p.tsv", "ID\tx\ty\na\t1.5\tNA\nb\t*\t2\nc\t3\tN\n")
    p = tables.read_phenotypes(spark, path)
    assert sorted((r.sample_id, r.phe_id) for r in p.where("value is null").collect()) == [("a", "y"), ("b", "x"), ("c", "y")]
    assert {r.phe_id for r in tables.complete(p, 2).collect()} == {"x"}
    tables.write_phenotypes(p, str(tmp_path / "o"))
    assert tables.read_phenotypes(spark, str(tmp_path / "o")).count() == 6


def test_matrices(spark, write, tmp_path):
    for sep in (",", " ", "\t"):
        path = write("k.txt", f"a{sep}b\n1{sep}0.5\n0.5{sep}2\n")
        k = tables.read_kinship(spark, path)
        assert {(r.i, r.j): r.k for r in k.collect()} == {("a", "a"): 1, ("a", "b"): 0.5, ("b", "a"): 0.5, ("b", "b"): 2}
    tables.write_kinship(k, str(tmp_path / "k2"))
    assert sorted(map(str, tables.read_kinship(spark, str(tmp_path / "k2")).collect())) == sorted(map(str, k.collect()))
    assert kinship.asymmetries(k).count() == 0
    only = spark.createDataFrame([("a",)], "id string")
    assert tables.submatrix(k, only).count() == 1
    r = tables.read_relation(spark, write("r.csv", "#WG=1\nOBS_ID,p,q\no,1,2\n"))
    assert r.count() == 2


def test_regions_results_grid(spark, write, tmp_path):
    assert tables.read_regions(spark, write("r.tsv", "#x\ng1\t1\t5\t9\n")).collect() == [("g1", 1, 5, 9)]
    assert tables.read_compounds(spark, write("c.tsv", "c1\t1;5;9\t2;7;8\n")).count() == 2
    scan = spark.createDataFrame([(1, 5, 0.01, 0.2, 1.0, 0.5, 9), (2, 6, 0.5, 0.1, 1.0, 0.5, 1)], "chr int, pos long, pvalue double, adj_r2 double, coef double, sd_err double, mafc long")
    tables.write_results(scan, str(tmp_path / "s"), 10)
    assert tables.read_results(spark, str(tmp_path / "s"), 1.0).count() == 2
    assert [r.pos for r in tables.read_results(spark, str(tmp_path / "s"), 1.0, 0.2, 10).collect()] == [5]
    grid = tables.read_grid(spark, write("a.csv", "#h\n1, 10, -5/0.1, -4/0.9\n"))
    mass = {r.bin: r.mass for r in crosses.posterior(grid, 0.5).collect()}
    assert sum(mass.values()) == pytest.approx(1) and mass[1] > mass[0]
    assert tables.parse_sites("1_5;2_7") == [(1, 5), (2, 7)]
    path = write("m.tsv", "g\t1\t5\t50\trs1_10_A_T_0.5\trs2_20_C_G_-1\n")
    assert [(r.pos, r.weight) for r in models.read_models(spark, path, "g").collect()] == [(10, 0.5), (20, -1.0)]
    with pytest.raises(ValueError):
        models.read_models(spark, path, "absent")


def test_pedigree_markers_annotation(spark, write):
    ped = tables.read_pedigree(spark, write("p.tsv", "Fam\tId\tFa\tMo\tSex\tx\tPop\ty\tSib\nf\ta\t0\t0\t1\t\tP\t\t\nf\tb\t0\t0\t2\t\tP\t\t\nf\tc\ta\tb\t1\t\tP\t\td, e\n"))
    assert ped["both"].collect() == [("c", "a", "b")] and ped["siblings"].count() == 0
    codes = tables.read_markers(spark, write("n.tsv", "Locus\tm1\tm2\tm3\nChr\t1\t1\t1\ncM\t0\t1\t2\nMb\t0.1\t0.2\t0.3\norder\t1\t2\t3\nF1\tA\tA\tA\nF2\tB\tB\tB\nr1\tA\tN\tA\nr2\tA\tD\tB\n"))
    filled = {(r.line, r.pos): r.filled for r in crosses.fill_gaps(codes).collect()}
    assert filled["r1", 200000] == "A" and filled["r2", 200000] == "H"
    founders = tables.read_founders(spark, write("f.csv", "Chromosome,Positions,e1,e2\n1,150000,A,G\n"))
    points = spark.createDataFrame([(1, 150000)], "chr int, pos long")
    own = codes.withColumns({"parent_a": F.lit("e1"), "parent_b": F.lit("e2"), "code": F.coalesce("code", F.lit("A"))})
    assert {r.line: r.letter for r in crosses.from_founders(points, own, founders).collect()} == {"r1": "A", "r2": "A"}
    names = ["#CHROM", "POS", "REF", "ALT", "AF", "VT", "VA", "NAC"]
    notes = ["1\t5\tA\tG\t0.001\tSNP\t1:G1:E:+:nonsynonymous\t*", "1\t9\tA\tG\tx\tSNP\t1:G1\t*", "1\t6\tA\tG\t0.001\tSNP\t1:G1:E:+:synonymous\t", "2\t6\tA\tG\t0.001\tSNP\t\tUTR,x"]
    a = tables.parse_annotation(spark.createDataFrame([(x,) for x in notes], "value string"), names)
    assert sorted(r.chr for r in tables.functional_rare(a, 0.01).collect()) == [1, 2]
    assert tables.gene_extents(a).collect() == [("G1", 1, 4, 7)]


def test_shipped_shapes(spark, write):
    lines = "ID\tPHENO\n" + "".join(f"s{i}\t{1 if i < 1090 else 2}\n" for i in range(2000))
    p = tables.read_phenotypes(spark, write("e.tsv", lines))
    assert {r.value: r["count"] for r in p.groupBy("value").count().collect()} == {1.0: 1090, 2.0: 910}


def test_simulated_trait_is_found_again(spark):
    calls = spark.range(200).select(F.col("id").alias("sample_id")).join(spark.range(20).select((F.col("id") + 1).alias("pos")))
    calls = calls.select("sample_id", F.lit(1).alias("chr"), "pos", (F.pmod(F.xxhash64("sample_id", "pos"), F.lit(3))).cast("double").alias("dosage"))
    effects = spark.createDataFrame([(1, 7, 1.0)], "chr int, pos long, effect double")
    trait = simulate.with_noise(simulate.additive(calls, effects), 0.8, 4).select("sample_id", "y")
    best = lm.best_marker(lm.scan(lm.matched(calls, trait))).first()
    assert best.pos == 7
    joint = lm.selected_model(calls, trait, effects)
    assert joint["coef"][1] == pytest.approx(1, abs=0.2)
    p = {r.pos: r.p for r in lm.permutation_p(calls, trait, 30, 1).collect()}
    assert p[7] == 0


def test_letters_strict_and_not(spark):
    rows = [(1, 5, "a", "A"), (1, 5, "b", "R"), (1, 5, "c", "A"), (1, 6, "a", "C"), (1, 6, "b", "N"), (1, 6, "c", "Y"), (1, 7, "a", "A"), (1, 7, "b", "A")]
    letters = spark.createDataFrame(rows, "chr int, pos long, sample_id string, letter string")
    loose = {(r.pos, r.sample_id): r.dosage for r in variants.letters_to_dosage(letters).collect()}
    assert loose == {(5, "a"): 0, (5, "b"): 1, (5, "c"): 0, (6, "a"): 0, (6, "b"): 0, (6, "c"): 1}
    assert {r.pos for r in variants.letters_to_dosage(letters, True).collect()} == {5}


def test_lines_are_numbered_across_splits(spark, tmp_path):
    names = [f"s{i}" for i in range(40)]
    k = [[i * 100 + j for j in range(40)] for i in range(40)]
    path = tmp_path / "k.csv"
    path.write_text(",".join(names) + "\n" + "".join(",".join(map(str, r)) + "\n" for r in k))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        lines = tables.numbered_lines(spark, str(path)).orderBy("n").collect()
        found = {(r.i, r.j): r.k for r in tables.read_kinship(spark, str(path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert [r.n for r in lines] == list(range(41)) and "\n".join(r.value for r in lines) + "\n" == path.read_text()
    assert found == {(f"s{i}", f"s{j}"): float(i * 100 + j) for i in range(40) for j in range(40)}


def test_relation_is_written_as_it_is_read(spark, tmp_path):
    rows = [("o1", "p", 0.5), ("o1", "q", -1.0), ("o2", "p", 2.0)]
    tables.write_relation(spark.createDataFrame(rows, "obs_id string, pred_id string, k double"), str(tmp_path / "r"), whole=False, region=(2, 5, 9))
    (part,) = (tmp_path / "r").glob("part-*")
    assert part.read_text().splitlines() == ["#WG=false", "#Chr2:5:9;", "OBS_ID,p,q", "o1,0.5,-1.0", "o2,2.0,NaN"]
    back = tables.read_relation(spark, str(tmp_path / "r")).where("k is not null").collect()
    assert sorted((r.obs_id, r.pred_id, r.k) for r in back) == rows


def test_candidate_pairs_crosses_and_annotation_text(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("c1\t1;100;200\t1;250;350\nc0\t1;100;200\t1;250;350\nc2\t1;1;2\t2;1;2\nc3\t1;1;2\n")
    pairs = tables.paired_compounds(tables.read_compounds(spark, str(tmp_path / "c.tsv"))).collect()
    assert [tuple(r) for r in pairs] == [("c0", 1, 100, 200, 250, 350)]
    (tmp_path / "x.tsv").write_text("Col\t6909\tBur\t5719\tX1\nCol\t6909\tCvi\t6911\tX2\n")
    founders, crosses = tables.read_crosses(spark, str(tmp_path / "x.tsv"))
    assert sorted((r.id, r.name) for r in founders.collect()) == [("5719", "Bur"), ("6909", "Col"), ("6911", "Cvi")]
    assert sorted(map(tuple, crosses.collect())) == [("5719", "6909", "X1"), ("6909", "5719", "X1"), ("6909", "6911", "X2"), ("6911", "6909", "X2")]
    names = ["CHROM", "POS", "REF", "ALT", "AA", "VT", "QUAL", "AC", "AN", "AF", "ASN_AF", "AMR_AF", "AFR_AF", "EUR_AF", "VA", "NAC"]
    lines = ["2\t7\tA\tG\tA\tSNP\t9\t3\t10\t0.3\t0.1\t0.2\t0.25\t0.5\t1:g1:x:+:nonsynonymous\t", "1\t5\tC\tT\t\tINDEL\tx\t1\t8\t\t\t\t\t\t\tmiRNA"]
    own = tables.parse_annotation(spark.createDataFrame([(x,) for x in lines], "value string"), names)
    tables.write_annotation(own, str(tmp_path / "a"))
    text = [x for p in sorted((tmp_path / "a").glob("part-*")) for x in p.read_text().splitlines()]
    assert text == ["1\t5\tC\tT\t-1\t*\t1\t8\tNaN\tNaN\tNaN\tNaN\tNaN\tINDEL\tmiRNA\t*", "2\t7\tA\tG\t9\tA\t3\t10\t0.3\t0.25\t0.2\t0.1\t0.5\tSNP\t*\t1:g1:+:nonsynonymous"]


def test_siblings_of_the_same_sex(spark, tmp_path):
    head = "Fam\tId\tFa\tMo\tSex\tx\tPop\ty\tSib\n"
    people = [("m1", 1, "m2, f1, m3, m4"), ("m2", 1, "f1, m1"), ("m3", 1, "0"), ("m4", 1, "0"), ("f1", 2, "f2, m1, f3, f4"), ("f2", 2, "f2, zz"), ("f3", 2, "0"), ("f4", 2, "0")]
    (tmp_path / "p.tsv").write_text(head + "".join(f"f\t{i}\t0\t0\t{s}\t\tP\t\t{x}\n" for i, s, x in people))
    ped = tables.read_pedigree(spark, str(tmp_path / "p.tsv"))
    assert {r.id: r.siblings for r in ped["alike"].collect()} == {"m1": ["m2", "m3"], "f1": ["f2", "f3", "f4"]}
    assert {r.id: r.sibling for r in ped["sibling"].collect()} == {"m1": "m3", "m2": "m1", "f1": "f4"}
