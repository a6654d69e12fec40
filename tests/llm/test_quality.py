"""The quality classifier against plain loops, and the bound of its sample."""

import math
import zlib

import numpy as np

from genoflux.llm import quality

from .cases import table


def plain_boosting(x, y, trees, depth, rate=0.1, bins=64, ridge=1.0, least=1.0):
    """Row by row, node by node; returns the log odds of each row."""
    n, columns = x.shape
    share = (sum(y) + 1) / (n + 2)
    odds = [math.log(share / (1 - share))] * n
    cuts = [sorted(set(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]).tolist())) for j in range(columns)]

    def grow(rows, left):
        g, h = sum(grads[i] for i in rows), sum(weights[i] for i in rows)
        best = (1e-9, None)
        for j in range(columns) if left else ():
            for c in cuts[j]:
                low = [i for i in rows if x[i, j] <= c]
                gl, hl = sum(grads[i] for i in low), sum(weights[i] for i in low)
                if hl < least or h - hl < least:
                    continue
                gain = gl * gl / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g * g / (h + ridge)
                if gain > best[0] + 1e-12:
                    best = (gain, (j, c))
        if best[1] is None:
            for i in rows:
                odds[i] += -rate * g / (h + ridge)
            return
        j, c = best[1]
        grow([i for i in rows if x[i, j] <= c], left - 1)
        grow([i for i in rows if x[i, j] > c], left - 1)

    for _ in range(trees):
        p = [1 / (1 + math.exp(-o)) for o in odds]
        grads, weights = [a - b for a, b in zip(p, y, strict=True)], [a * (1 - a) for a in p]
        grow(list(range(n)), depth)
    return np.array(odds)


def test_boosting_is_the_plain_loop():
    rng = np.random.default_rng(8)
    x = np.zeros((160, quality.N_FEATURES))
    x[:, [2, 9, 30]] = rng.random((160, 3)).round(2)
    y = ((x[:, 2] > 0.4) ^ (x[:, 9] > 0.6)).astype(float)
    model = quality.fit(x, y, trees=6, depth=3, bins=16)
    odds = plain_boosting(x, y.tolist(), 6, 3, bins=16)
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(-odds)), atol=1e-9)


def test_flat_descent_is_the_tree():
    rng = np.random.default_rng(9)
    x = rng.random((300, quality.N_FEATURES))
    model = quality.fit(x, (x[:, 0] + x[:, 5] > 1).astype(float), trees=15)

    def down(node, row):
        if model.left[node] == node:
            return model.value[node]
        return down(model.left[node] if row[model.feature[node]] <= model.cut[node] else model.right[node], row)

    want = [model.base + sum(down(r, row) for r in model.roots) for row in x]
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(-np.array(want))), atol=1e-12)


def test_the_sample_is_bounded(spark, monkeypatch):
    seen, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y, *a: seen.append(len(x)) or fit(x, y, *a))
    own = next(i for i in range(9) if zlib.crc32(str(i).encode()) % 3 != 1)
    docs = table(spark, [(own, f"text number {i}", "en", "s", 1) for i in range(3000)])
    labels = spark.createDataFrame([(own, 1)], "doc_id long, quality int")
    quality.train(docs, labels, most=2, trees=1)
    assert seen == [2]
