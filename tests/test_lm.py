"""Joint linear models against numpy."""

import numpy as np
import pytest

from genoflux.operators import lm


def test_too_many_sites_raise(spark):
    calls = spark.createDataFrame([(1, p, s, float((p * s) % 3)) for p in range(65) for s in range(70)], "chr int, pos long, sample_id long, dosage double")
    traits = spark.createDataFrame([(s, float(s)) for s in range(70)], "sample_id long, y double")
    with pytest.raises(ValueError, match="more sites"):
        lm.selected_model(calls, traits, calls)
    assert len(lm.selected_model(calls, traits, calls.where("pos < 64"))["coef"]) == 65


def test_forward_fits_jointly(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 3, (60, 3)).astype(float)
    g = np.column_stack([base, base[:, :1] + rng.integers(0, 2, (60, 1)), rng.integers(0, 3, (60, 6))])  # correlated markers
    y = 2 * g[:, 0] - 1.5 * g[:, 1] + g[:, 3] + rng.normal(size=60)
    calls = spark.createDataFrame([(1, p, s, float(g[s, p])) for p in range(10) for s in range(60)], "chr int, pos long, sample_id long, dosage double")
    traits = spark.createDataFrame([(s, float(y[s])) for s in range(60)], "sample_id long, y double")
    chosen = []
    for r in lm.forward(calls, traits, 4).orderBy("round").collect():
        fits = {p: lm.least_squares(np.column_stack([np.ones(60), g[:, [*chosen, p]]]), y)[3] for p in range(10) if p not in chosen}
        best = max(fits, key=fits.get)
        assert r.pos == best and abs(r.adj_r2 - fits[best]) < 1e-9
        chosen.append(best)
    assert len(chosen) == 4


def test_gate_p_and_final_coefficients(spark):
    rng = np.random.default_rng(7)
    g = rng.integers(0, 3, (70, 12)).astype(float)
    g[:, 4] = (np.arange(70) == 3) * 1.0  # rare, and the trait's best
    y = g[:, 0] - g[:, 1] + 9 * g[:, 4] + rng.normal(size=70)
    calls = spark.createDataFrame([(1, p, s, None if (p, s) == (0, 5) else float(g[s, p])) for p in range(12) for s in range(70)], "chr int, pos long, sample_id long, dosage double")
    traits = spark.createDataFrame([(s, float(y[s]) if s != 11 else None) for s in range(70)], "sample_id long, y double")
    gate = lm.candidates(calls, traits, 3.0, 0.05)
    use = [s for s in range(70) if s not in (5, 11)]
    inside = sorted(r.pos for r in gate.collect())
    assert 4 not in inside and {0, 1} <= set(inside) and len(inside) < 12
    assert 4 in {r.pos for r in lm.candidates(calls, traits, 12.0).collect()}
    found = lm.forward(calls, traits, 2, gate).orderBy("round")
    rows = found.collect()
    assert all(r.pos in inside for r in rows)
    x = np.column_stack([np.ones(len(use)), g[use][:, [r.pos for r in rows]]])
    b, se, _, adj = lm.least_squares(x, y[use])
    assert rows[1].adj_r2 == pytest.approx(adj) and rows[1].n == len(use)
    p = lm.t_two_sided(b / se, len(use) - 3)
    assert rows[1].pvalue == pytest.approx(p[2], rel=1e-9)
    last = lm.final_coefficients(calls, traits, found).orderBy("round").collect()
    assert [(r["round"], r.pos, r.n) for r in last] == [(0, None, len(use)), *((r["round"], r.pos, len(use)) for r in rows)]
    assert np.allclose([(r.coef, r.se, r.pvalue) for r in last], np.column_stack([b, se, p]))
    assert lm.forward(calls, traits, 2, gate.where("false")).count() == 0
    assert lm.final_coefficients(calls, traits, found.where("false")).count() == 1
