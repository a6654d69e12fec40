"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a document come from its bytes and words alone.  Trees are
fitted on a bounded sample of labelled rows over binned statistics, one level at a
time from gradient histograms.  The fitted trees are flattened into five arrays,
and documents go down all of them at once, level by level, by array indexing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flat_utf8

_GROUPS = [
    b"abcdefghijklmnopqrstuvwxyz",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b" ",
    b"\n",
    b"\t\r\x0b\x0c",
    b".",
    b",",
    b"!",
    b"?",
    b";:",
    b"'\"`",
    b"()[]{}",
    b"<>/\\",
    b"#",
    b"$%&",
    b"*",
    b"|",
    b"@",
    b"-_+=~^",
]
_LUT = np.zeros((256, len(_GROUPS) + 1), np.float64)
for _i, _group in enumerate(_GROUPS):
    _LUT[list(_group), _i] = 1
_LUT[128:, -1] = 1
_END = frozenset(b".!?,;:")


def statistics(text: bytes) -> list[float]:
    """Numbers that describe one text; all zero but the first for an empty one."""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = (counts @ _LUT) / max(n, 1)
    used = counts[counts > 0] / max(n, 1)
    entropy = float(-(used * np.log2(used)).sum()) if n else 0.0
    words = text.split()
    m = len(words)
    if not m:
        return [1.0, np.log1p(n), *shares.tolist(), entropy, *[0.0] * 14]
    sizes = np.fromiter(map(len, words), np.int64, m)
    distinct = set(words)
    pairs = max(1, m - 1)
    same = sum(map(bytes.__eq__, words, words[1:])) if m > 1 else 0
    triples = len(set(zip(words, words[1:], words[2:], strict=False))) / (m - 2) if m > 2 else 1.0
    lines = [x for x in text.split(b"\n") if x.strip()]
    last = sum(x[-1] in _END for x in lines) / max(1, len(lines))
    tail = np.fromiter((x[-1] for x in words), np.uint8, m)
    letters = float(np.isin(tail, _ALNUM).mean())
    upper = sum(map(bytes.isupper, words)) / m
    return [
        0.0,
        np.log1p(n),
        *shares.tolist(),
        entropy,
        np.log1p(m),
        float(sizes.mean()),
        float(sizes.std()),
        float(np.log1p(sizes.max())),
        len(distinct) / m,
        same / pairs,
        triples,
        len(set(lines)) / max(1, len(lines)),
        np.log1p(len(lines)),
        n / max(1, len(lines)),
        last,
        letters,
        upper,
        float((sizes == 1).mean()),
    ]


_ALNUM = np.array([i for i in range(256) if chr(i).isalnum() and i < 128 or i >= 128], np.uint8)
N_FEATURES = 2 + _LUT.shape[1] + 15


@dataclass(frozen=True)
class Trees:
    """Flattened trees: node i asks if statistic feature[i] is at most cut[i] and goes
    to left[i] or right[i]; leaves point to themselves and hold value[i]."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        out = np.full(len(x), self.base)
        for s in range(0, len(x), 4096):
            own = x[s : s + 4096]
            node = np.broadcast_to(self.roots, (len(own), len(self.roots)))
            rows = np.arange(len(own))[:, None]
            for _ in range(self.depth):
                node = np.where(own[rows, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
            out[s : s + 4096] += self.value[node].sum(1)
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Boosts logistic loss.  With one class or no rows the score is a constant:
    the smoothed share of label 1."""
    n = len(y)
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(N_FEATURES)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)]) if n else np.zeros((N_FEATURES, 0), np.int64)
    parts: dict[str, list] = {k: [] for k in ("feature", "cut", "left", "right", "value")}
    roots, score = [], np.full(n, base)

    def node() -> int:
        i = len(parts["value"])
        for k, v in (("feature", 0), ("cut", 0.0), ("left", i), ("right", i), ("value", 0.0)):
            parts[k].append(v)
        return i

    for _ in range(trees if n and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-score))
        gradient, weight = p - y, p * (1 - p)
        level, rows, place = [node()], np.arange(n), np.zeros(n, np.int64)
        roots.append(level[0])
        for step in range(depth + 1):
            width, own = len(level), np.arange(len(level))
            g_rows, h_rows = gradient[rows], weight[rows]
            g_all, h_all = np.bincount(place, g_rows, width), np.bincount(place, h_rows, width)
            gain_of, split = np.full(width, 1e-9), [None] * width
            for j in range(N_FEATURES) if step < depth else ():
                slots = len(cuts[j]) + 1
                if slots < 2:
                    continue
                at = place * slots + binned[j, rows]
                g = np.bincount(at, g_rows, width * slots).reshape(width, slots).cumsum(1)[:, :-1]
                h = np.bincount(at, h_rows, width * slots).reshape(width, slots).cumsum(1)[:, :-1]
                g_rest, h_rest = g_all[:, None] - g, h_all[:, None] - h
                gain = g * g / (h + ridge) + g_rest * g_rest / (h_rest + ridge) - (g_all**2 / (h_all + ridge))[:, None]
                gain[(h < least) | (h_rest < least)] = -1
                top = gain.argmax(1)
                for i in np.flatnonzero(gain[own, top] > gain_of).tolist():
                    gain_of[i], split[i] = gain[i, top[i]], (j, int(top[i]))
            below, move = [], np.full((width, 2), -1)
            for i, at in enumerate(level):
                if split[i] is None:
                    parts["value"][at] = float(-rate * g_all[i] / (h_all[i] + ridge))
                    continue
                parts["feature"][at], parts["cut"][at] = split[i][0], float(cuts[split[i][0]][split[i][1]])
                for side, name in enumerate(("left", "right")):
                    parts[name][at], move[i, side] = node(), len(below)
                    below.append(parts[name][at])
            score[rows] += np.array([parts["value"][at] for at in level])[place]
            feature = np.array([x[0] if x else 0 for x in split])
            limit = np.array([x[1] if x else 0 for x in split])
            going = move[place, (binned[feature[place], rows] > limit[place]).astype(np.int64)]
            rows, place, level = rows[going >= 0], going[going >= 0], below
            if not below:
                break
    kinds = {"feature": np.int64, "cut": float, "left": np.int64, "right": np.int64, "value": float}
    return Trees(*(np.array(parts[k], kind) for k, kind in kinds.items()), np.array(roots, np.int64), depth, base)


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _measured(batch: pa.RecordBatch) -> np.ndarray:
    raw, bounds = flat_utf8(batch["text"])
    rows = [statistics(raw[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return np.array(rows, float).reshape(-1, N_FEATURES)


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000, trees: int = 120, depth: int = 4) -> Trees:
    """Trees fitted on at most ``most`` labelled rows that are not held out.

    The sample is the rows with the smallest hash of doc_id, so it is the same in
    every run; ``most`` bounds the labels that are broadcast and, once more, the rows that
    have them (a doc_id may repeat), so also what the driver holds.  Labels other than 0
    and 1, and null ids, are not used.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    own = own.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most)

    def run(batches):
        for batch in batches:
            x = _measured(batch)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["quality"], pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    rows = _texts(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "quality")
    rows = rows.mapInArrow(run, "doc_id long, quality int, x array<double>").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "x").limit(most).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["quality"], r["x"]))
    x = np.array([r["x"] for r in rows], float).reshape(-1, N_FEATURES)
    return fit(x, np.array([r["quality"] for r in rows], float), trees, depth)


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """One row for each row of ``docs``: doc_id, score (probability of label 1).

    Null texts count as empty; empty texts have a score like any other.  Only
    doc_id and text are read, and only text decides.  Nothing is shuffled.
    """

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                rows = batch.slice(a, 1024)
                yield pa.RecordBatch.from_arrays([rows["doc_id"], pa.array(model.scores(_measured(rows)))], ["doc_id", "score"])

    return _texts(docs).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Trees, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``, with all their columns,
    whatever their names."""
    schema = docs.schema
    place = [f.name for f in schema].index("text")

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                rows = batch.slice(a, 1024)
                text = pa.RecordBatch.from_arrays([rows.column(place)], ["text"])
                yield rows.filter(pa.array(model.scores(_measured(text)) >= least))

    return docs.mapInArrow(run, schema)
