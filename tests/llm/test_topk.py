"""Top-k on awkward vectors, against brute force in whole numbers of any size."""

import numpy as np
from pyspark.sql import functions as F

from genoflux.llm import topk

from .cases import same


def brute(rows, k, is_query):
    """(query_id, rank, vec_id, score) by the definition; rows of vec_id and components."""
    kept = [(i, [int(np.floor(64 * np.float64(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(kept):
        if not is_query(q):
            continue
        found = []
        for m, (i, b) in enumerate(kept):
            if m != n and len(a) == len(b):
                score = min(max(sum(x * y for x, y in zip(a, b, strict=True)), -(1 << 63)), (1 << 63) - 1)
                found.append((-score, i))
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k])]
    return out


def run(spark, rows, k=4, **kind):
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = topk.top_k(topk.whole_vectors(vectors), F.col("vec_id") % 20 == 0, k=k, **kind).collect()
    return [(r.query_id, r["rank"], r.vec_id, r.score) for r in found]


def test_repeated_rows_count_each(spark):
    rng = np.random.default_rng(1)
    rows = [(i % 50, rng.normal(size=6).tolist()) for i in range(200)]
    rows += [(20, [1.0] * 6), (20, [1.0] * 6), (3, [2.0] * 6), (3, [2.0] * 6), (3, [2.0] * 6)]
    same(run(spark, rows, block=32, queries_block=4), brute(rows, 4, lambda q: q % 20 == 0))


def test_lengths_do_not_meet(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=(8, 8, 5, 0)[i % 4]).tolist()) for i in range(160)]
    rows += [(200, [1.0, None]), (220, [float("nan")]), (240, [1.0, 2.0, 3.0]), (None, [1.0] * 8)]
    same(run(spark, rows, block=16), brute(rows, 4, lambda q: q % 20 == 0))


def test_large_scores_are_exact(spark):
    big = float(1 << 18)  # 2 ** 24 after scaling
    rows = [(20, [big, big, 1 / 64, 1 / 64])]
    rows += [(i, [big * (i % 3), big, float(i) / 64, 3 / 64]) for i in range(1, 60) if i % 20]
    rows += [(40, [1e12, -1e12, 0.0, 0.0]), (60, [1e30, 1.0, -1e30, 5.0]), (80, [-1e200, 1e200, 1e250, 0.0]), (100, [0.0] * 4)]
    same(run(spark, rows, k=30, block=16), brute(rows, 30, lambda q: q % 20 == 0))


def test_sums_beyond_a_double(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-(1 << 24), 1 << 24, 8) * 16.0).tolist()) for i in range(300)]
    same(run(spark, rows, k=7, block=64), brute(rows, 7, lambda q: q % 20 == 0))


def test_bounds_save_work_and_blocks():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 16)) * 200
    v = np.rint(centres[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 16)) * 5)
    own = topk.Rings(np.arange(4000), np.arange(4000), v, centres)
    q, ids, scores = own.search(np.arange(0, 4000, 100), v[::100], np.full(40, -np.inf), 5)
    for n in range(40):
        s = v @ v[n * 100]
        want = sorted((i for i in range(4000) if i != n * 100), key=lambda i: (-s[i], i))[:5]
        assert ids[q == n].tolist() == want and scores[q == n].tolist() == s[want].astype(int).tolist()
    assert own.evaluated < 0.5 * 40 * 4000


def test_routing_reaches_fewer_blocks(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 8)) * 20
    v = centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 8)) / 4
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    found = run(spark, rows, k=5, block=128)
    whole = np.floor(64 * v)
    for q in range(0, 3000, 500):
        s = whole @ whole[q]
        want = sorted((i for i in range(3000) if i != q), key=lambda i: (-s[i], i))[:5]
        assert sorted((r, i, x) for a, r, i, x in found if a == q) == [(n + 1, i, int(s[i])) for n, i in enumerate(want)]
