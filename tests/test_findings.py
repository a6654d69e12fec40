"""Cases of the findings of round 3."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from genoflux.operators import kinship, lm, simulate, stats
from genoflux.sources import genotypes


def test_additive_values_do_not_depend_on_the_order_of_calls(spark):
    rng = np.random.default_rng(21)
    k, dosage = rng.integers(0, 13, 4000), rng.integers(0, 3, 4000)
    cells = [(1, i, 7, float(dosage[i])) for i in rng.permutation(4000).tolist()]
    calls = spark.createDataFrame(cells, "chr int, pos long, sample_id long, dosage double").repartition(5)
    effects = spark.createDataFrame([(1, i, float(k[i] / 13 - 0.5)) for i in range(4000)], "chr int, pos long, effect double")
    want = math.fsum(float(dosage[i]) * float(k[i] / 13 - 0.5) for i in range(4000))
    assert simulate.additive(calls, effects).first()["value"] == want


def test_rounding_ties_of_the_restricted_scan(spark):
    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for t in ("supplier", "part", "lineitem", "embeddings"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = {(v[0], v[1]): v[2] for v in c.sql(entry.oracle_sql()["fastlmm_reml_identity"]).fetchall()}
    found = {(v.chr, v.pos): v.coef for v in entry.queries()["fastlmm_reml_identity"](spark, sf).collect()}
    assert found == want


def test_symmetry_is_counted_in_one_pass(spark):
    cells = [(1, 1, 0.5), (1, 2, 0.3), (2, 1, 0.3), (1, 3, 0.1), (2, 3, 0.2), (3, 2, 0.4), (4, 1, None), (1, 4, 0.1), (5, 5, None)]
    k = spark.createDataFrame(cells, "i long, j long, k double")
    assert tuple(kinship.symmetry(k).first()) == (9, 6)
    assert tuple(kinship.symmetry(k.where("i < 3 and j < 3")).first()) == (3, 0)
    assert tuple(kinship.symmetry(k.where("i > 9")).first()) == (0, 0)
    plan = kinship.symmetry(k)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def _records_shuffled(spark, group, df):
    context = spark.sparkContext
    context.setJobGroup(group, group)
    row = tuple(df.first())
    context.setLocalProperty("spark.jobGroup.id", None)
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return row, sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)


def test_entries_beside_their_mirror_are_not_shuffled(spark):
    rng = np.random.default_rng(25)
    upper = spark.createDataFrame([(i, j, float(rng.normal())) for i in range(120) for j in range(i, 120)], "i long, j long, k double").repartition(4)
    k = kinship._square(upper, []).cache()
    assert k.count() == 120 * 120
    row, sent = _records_shuffled(spark, "beside", kinship.symmetry(k))
    assert row == (120 * 120, 0) and sent < 100
    # far from their mirrors, with one in twelve changed: all are shuffled, none is lost
    odd = k.withColumn("k", F.when((F.col("i") < F.col("j")) & (F.col("i") % 12 == 0), F.col("k") + 1).otherwise(F.col("k"))).cache()
    changed = 2 * odd.where("i < j and i % 12 = 0").count()
    assert tuple(kinship.symmetry(odd).first()) == tuple(kinship.symmetry(odd.repartition(7, "i")).first()) == (120 * 120, changed)
    names = odd.where("i <> 5 or j <> 7").select(F.format_string("s%03d", "i").alias("i"), F.format_string("s%03d", "j").alias("j"), "k")
    assert tuple(kinship.symmetry(names).first()) == (120 * 120 - 1, changed + 1) == (names.count(), kinship.asymmetries(names).count())


def test_symmetry_of_entries_without_a_number(spark):
    cells = [(1, 1, None), (2, 2, float("nan")), (1, 2, None), (2, 1, 0.1), (1, 3, float("nan")), (3, 1, float("nan")), (3, 3, 1.0), (2, 3, 0.5), (3, 2, 0.5 + 1e-10), (4, 1, 0.2), (4, 4, 1.0), (1, 4, 0.2)]
    k = spark.createDataFrame(cells, "i int, j int, k double").coalesce(1)
    assert tuple(kinship.symmetry(k).first()) == tuple(kinship.symmetry(k.orderBy("j", "i").coalesce(1)).first()) == (12, 6)


def test_symmetry_of_calls_shuffles_no_pair(spark, monkeypatch):
    rng = np.random.default_rng(26)
    cells = [(1, p, f"s{s:02}", None if rng.random() < 0.05 else float(rng.integers(0, 3))) for p in range(150) for s in rng.choice(60, 12, False)]
    calls = spark.createDataFrame(cells, "chr int, pos long, sample_id string, dosage double").cache()
    calls.count()
    want = (kinship.rrm(calls).count(), 0)
    row, sent = _records_shuffled(spark, "whole", kinship.rrm_symmetry(calls))
    assert row == want and sent < 300 < want[0]  # a row a site and block
    means = kinship._pair_means
    for pairs in (100, 3000):  # blocks in slices, blocks
        monkeypatch.setattr(kinship, "_pair_means", lambda *a, pairs=pairs, **b: means(*a, pairs=pairs, **b))
        assert tuple(kinship.rrm_symmetry(calls).first()) == want


def test_pairs_are_added_up_where_they_are_formed(spark):
    rng = np.random.default_rng(22)
    calls = spark.createDataFrame([(1, p, int(s), float(rng.integers(0, 3))) for p in range(200) for s in rng.choice(60, 12, False)], "chr int, pos long, sample_id long, dosage double").cache()
    rows = calls.collect()
    want = {}
    for p in range(200):
        site = [(r.sample_id, r.dosage) for r in rows if r.pos == p]
        for i, a in site:
            for j, b in site:
                if i < j:
                    want.setdefault((i, j), []).append(1 - abs(a - b) / 2)
    sites = kinship._stored(kinship._by_site(calls))
    for pairs in (100, 3000, 1 << 21):  # blocks, blocks in slices, one block
        found = kinship._pair_means(sites, [], "ibs", pairs=pairs)
        assert {(r.i, r.j): (r.k, r.n) for r in found.collect()} == {k: (pytest.approx(np.mean(v)), len(v)) for k, v in want.items()}
    dealt = kinship._pair_means(sites, [], "ibs")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in dealt  # whole sums: no pair is shuffled
    windows = kinship.local_ibs(calls, 50)._jdf.queryExecution().optimizedPlan().toString()
    assert "sample_id, n" not in windows and windows.count("Join") == 1  # with the last position alone


def test_permutation_takes_more_samples_than_a_dense_matrix(spark, monkeypatch):
    monkeypatch.setattr(kinship, "MOST_SAMPLES", 10)
    rng = np.random.default_rng(23)
    y, g = rng.normal(size=30), rng.integers(0, 3, (4, 30)).astype(float)
    calls = spark.createDataFrame([(1, p, f"s{s:02}", float(g[p, s])) for p in range(4) for s in range(30)], "chr int, pos long, sample_id string, dosage double")
    traits = spark.createDataFrame([(f"s{s:02}", float(y[s])) for s in range(30)], "sample_id string, y double").repartition(3)
    found = {r.pos: r.p for r in lm.permutation_p(calls, traits, 15, 5).collect()}
    drawn = [y, *(y[stats.permutation(30, 5, r)] for r in range(1, 16))]
    for p in range(4):
        r2 = [np.corrcoef(g[p], t)[0, 1] ** 2 for t in drawn]
        assert found[p] == pytest.approx(np.mean([v >= r2[0] for v in r2[1:]]))


def test_distance_correlation_joins_no_rows(spark):
    rng = np.random.default_rng(24)
    a, b = rng.normal(size=(90, 2)), rng.integers(0, 3, (90, 1)).astype(float)
    a[50:], b[50:] = a[10:50], b[10:50]  # equal rows count each
    rows = spark.createDataFrame([(i, a[i].tolist(), b[i].tolist()) for i in range(90)], "id long, a array<double>, b array<double>")
    p, q = (np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1)) for v in (a, b))
    p, q = (v - v.mean(0) - v.mean(1)[:, None] + v.mean() for v in (p, q))
    want = np.sqrt((p * q).mean() / np.sqrt((p * p).mean() * (q * q).mean()))
    for block in (7, 2048):
        found = stats.distance_correlation(rows, "id", "a", "b", block)
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert tuple(found.first()) == (90, pytest.approx(want))


def test_standings_compute_their_scores_once(spark):
    scores = spark.createDataFrame([("a", 3.0), ("b", 5.0), ("c", 3.0), ("d", 1.0)], "gene string, score double")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    found = simulate.standings(scores.mapInArrow(counted, scores.schema))
    assert {r.gene: r.standing for r in found.collect()} == {"a": 2, "b": 1, "c": 2, "d": 4}
    assert seen.value == 4


def test_transforms_are_compared_over_one_count_of_the_values(spark):
    rng = np.random.default_rng(25)
    for x in (np.exp(rng.normal(size=400)), rng.normal(size=300) ** 2 - 0.5, np.round(rng.normal(size=300)), np.sqrt(rng.normal(size=300) + 9)):
        rows = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").coalesce(1)
        seen = spark.sparkContext.accumulator(0)

        def counted(batches, seen=seen):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        found = stats.best_transform(rows.mapInArrow(counted, "v double"), "v")
        assert seen.value == len(x) + 1
        shift = 0.0 if x.min() > 0 else 1.0 - x.min()
        choices = {"none": x, "log": np.log(x + shift), "exp": np.exp((x - x.mean()) / x.std(ddof=1)), "sqrt": np.sqrt(x + shift), "square": (x + shift) ** 2}
        gaps = {k: stats.ks_normal(spark.createDataFrame([(float(v),) for v in c], "x double"), "x").first().d for k, c in choices.items()}
        best = min(gaps, key=gaps.get)
        got = found.where("v is not null").collect()
        assert {r["transform"] for r in got} == {best} and [r.transformed for r in got] == pytest.approx(choices[best].tolist())


def test_gated_selection_computes_the_calls_once_for_all_rounds(spark):
    rng = np.random.default_rng(26)
    g, e = rng.integers(0, 3, (8, 60)).astype(float), rng.normal(size=60)
    y = 2 * g[1] + g[4] + 0.5 * g[6] + 0.3 * e
    rows = spark.createDataFrame([(1, p, s, float(g[p, s])) for p in range(8) for s in range(60)], "chr int, pos long, sample_id long, dosage double")
    traits = spark.createDataFrame([(s, float(y[s])) for s in range(60)], "sample_id long, y double")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    calls = rows.mapInArrow(counted, rows.schema)
    gate = lm.candidates(calls, traits, 8.0, 0.01)  # all of them
    found = lm.forward(calls, traits, 3, gate).orderBy("round").collect()
    assert seen.value == 3 * len(g) * 60  # the scan, the frequencies, the calls of candidates
    assert [r.pos for r in found] == [1, 4, 6]
    for k, r in enumerate(found):
        x = np.column_stack([np.ones(60), *(g[q.pos] for q in found[: k + 1])])
        b, se, _, adj = lm.least_squares(x, y)
        assert r.adj_r2 == pytest.approx(adj) and r.pvalue == pytest.approx(float(lm.t_two_sided(b[-1] / se[-1], 60 - k - 2)))


def test_slices_of_many_small_genes_are_written_by_several_tasks(spark, tmp_path):
    v = spark.createDataFrame([(1, p, [float(p % 3), None]) for p in range(60)], "chr int, pos long, g array<double>")
    models = spark.createDataFrame([(f"g{p // 2:02}", 1, p) for p in range(62)], "gene string, chr int, pos long")
    manifest = genotypes.write_slices(v, models, str(tmp_path / "s"))
    assert sorted(map(tuple, manifest.collect())) == [(f"g{i:02}", "all", 2, 2 if i < 30 else 0) for i in range(31)]
    files = list((tmp_path / "s" / "text").glob("gene=*/subset=all/kind=*/part-*"))
    assert len({f.name.split("-")[1] for f in files}) > 4  # a short text is not one task's
    back = genotypes.read_slices(spark, str(tmp_path / "s"))
    assert sorted(r.value for r in back.where("kind = 'setid'").collect()) == [f"g{p // 2:02}\trs_{p}" for p in range(60)] and back.count() == 180
    order = [line for i in range(30) for f in sorted((tmp_path / "s" / "text" / f"gene=g{i:02}" / "subset=all" / "kind=weights").glob("part-*")) for line in f.read_text().splitlines()]
    assert order == [f"rs_{p}\t0.0" for p in range(60)]
