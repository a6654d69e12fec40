"""Genetic prediction without a matrix between samples.

K = sum over variants of z z' / m with z the standardised variant (missing calls at the mean)
and m the number of variants that vary.  K V for any few columns V is one pass over the store:
a task multiplies its variants with V twice, and what tasks have is added up by blocks of
samples before it reaches the driver, which holds vectors alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kinship import MOST_SAMPLES, _lists, rescale
from .mixed import _batch, calls_of

#: Samples of a block of sums.
BLOCK = 4096


def _standardised(batch: pa.RecordBatch, samples: np.ndarray) -> np.ndarray:
    g, varies, _ = _batch(batch, samples)
    g = g[varies]
    return (g - g.mean(1, keepdims=True)) / g.std(1, ddof=1, keepdims=True)


def products(variants: DataFrame, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums over variants of z z' v (v: a row a sample, some columns) and of z * z; how many vary."""
    n, columns = v.shape
    held = variants.sparkSession.sparkContext.broadcast(v)

    def run(batches):
        total, m = np.zeros((n, columns + 1)), 0
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                z = _standardised(batch.slice(a, 1024), np.arange(n))
                total[:, :columns] += z.T @ (z @ held.value)
                total[:, columns] += (z * z).sum(0)
                m += len(z)
        if m:
            for b in range(0, n, BLOCK):
                own = total[b : b + BLOCK].ravel()
                yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([m if not b else 0]), _lists(own[None, :])], ["block", "m", "sums"])

    def add(batches):
        block, m, total = None, 0, None
        for batch in batches:
            at, flat = batch["sums"].offsets.to_numpy(), batch["sums"].values.to_numpy()
            for r in range(batch.num_rows):
                own = flat[at[r] : at[r + 1]]
                if batch["block"][r].as_py() != block:
                    if block is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([m]), _lists(total[None, :])], ["block", "m", "sums"])
                    block, m, total = batch["block"][r].as_py(), 0, np.zeros(len(own))
                m, total = m + batch["m"][r].as_py(), total + own
        if block is not None:
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([m]), _lists(total[None, :])], ["block", "m", "sums"])

    kind = "block long, m long, sums array<double>"
    rows = variants.select(calls_of(variants)).mapInArrow(run, kind).repartition("block").sortWithinPartitions("block").mapInArrow(add, kind).toArrow()
    held.unpersist()
    out = np.zeros((n, columns + 1))
    for b, own in zip(rows["block"].to_pylist(), rows["sums"], strict=True):
        own = own.values.to_numpy().reshape(-1, columns + 1)
        out[b : b + len(own)] = own
    return out[:, :columns], out[:, columns], int(sum(rows["m"].to_pylist()))


@dataclass(frozen=True)
class Kinship:
    """K of a store, scaled so that its centred trace is n - 1, known by its products alone."""

    variants: DataFrame
    n: int
    scale: float
    diagonal: np.ndarray

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        found, _, _ = products(self.variants, v.reshape(self.n, -1))
        return (found * self.scale).reshape(v.shape)


def kinship_of(variants: DataFrame, n: int) -> Kinship:
    """One pass: the trace, and the sum of all cells as 1' K 1."""
    of_ones, squares, m = products(variants, np.ones((n, 1)))
    if not m:
        raise ValueError("no variant varies")
    trace = squares.sum() - of_ones.sum() / n
    return Kinship(variants, n, (n - 1) / trace, squares * ((n - 1) / trace))


def solve(k: Kinship, use: np.ndarray, h2: float, y: np.ndarray, tolerance: float = 1e-11, most: int = 500) -> np.ndarray:
    """(h2 K + (1 - h2) I)^-1 y over the samples ``use``, by conjugate gradients: a pass an
    iteration for all columns of y, at most ``most``; an ArithmeticError if they do not do."""
    if not 0 <= h2 < 1:
        raise ValueError("h2 must be at least 0 and below 1")

    def times(v):
        wide = np.zeros((k.n, v.shape[1]))
        wide[use] = v
        return h2 * (k @ wide)[use] + (1 - h2) * v

    x = np.zeros_like(y)
    rest, way = y.copy(), y.copy()
    size = (rest * rest).sum(0)
    goal = tolerance**2 * size
    for _ in range(most):
        if (size <= goal).all():
            return x
        ahead = times(way)
        step = size / np.where(size > goal, (way * ahead).sum(0), np.inf)
        x, rest = x + step * way, rest - step * ahead
        fresh = (rest * rest).sum(0)
        way = rest + np.where(size > goal, fresh / np.where(size > 0, size, 1), 0) * way
        size = fresh
    raise ArithmeticError("conjugate gradients did not converge")


def moment_h2(k: Kinship, y: np.ndarray, probes: int = 40, seed: int = 1) -> float:
    """h2 by the moments of the trait: y'y and y'Ky against the traces of K and K K over the known
    samples.  The trace of K K is a mean over ``probes`` random signs; two passes in all."""
    use = np.flatnonzero(~np.isnan(y))
    n = len(use)
    center = lambda v: v - v.mean(0)
    own = center(y[use])
    signs = center(np.random.default_rng(seed).choice([-1.0, 1.0], (n, probes)))
    wide = np.zeros((k.n, probes + 2))
    wide[use] = np.column_stack([own, signs, np.ones(n)])
    found = (k @ wide)[use]
    k_y, k_signs = center(found[:, 0]), center(found[:, 1 : 1 + probes])
    t1 = float(k.diagonal[use].sum() - found[:, -1].sum() / n)
    t2 = float((k_signs * k_signs).sum() / probes)
    a = np.array([[t2, t1], [t1, n - 1.0]])
    vg, ve = np.linalg.solve(a, [own @ k_y, own @ own])
    return float(min(0.99, max(0.0, vg / (vg + ve)))) if vg + ve > 0 else 0.0


def predict_held_out(variants: DataFrame, traits: dict[str, np.ndarray], h2: float | None = None) -> DataFrame:
    """trait, ordinal, known, h2, predicted of every sample for each trait (NaN: held out, to be
    predicted): mean + h2 K (h2 K + (1 - h2) I)^-1 (y - mean), the inverse over known samples.

    K is never formed: a solution takes one pass over the store an iteration, and the predictions
    one more, so samples are bounded by what vectors the driver holds.  Without ``h2`` each
    trait's is found from its moments."""
    spark = variants.sparkSession
    n = len(next(iter(traits.values())))
    k, parts = kinship_of(variants, n), []
    for name, y in traits.items():
        use = np.flatnonzero(~np.isnan(y))
        if not len(use):
            continue
        share = moment_h2(k, y) if h2 is None else h2
        mean = y[use].mean()
        wide = np.zeros((n, 1))
        wide[use] = solve(k, use, share, (y[use] - mean)[:, None])
        found = mean + share * (k @ wide)[:, 0]
        parts.append(pa.table({"trait": pa.array([name] * n), "ordinal": pa.array(np.arange(n)), "known": pa.array(~np.isnan(y)), "h2": pa.array(np.full(n, share)), "predicted": pa.array(found)}))
    empty = pa.schema([("trait", pa.string()), ("ordinal", pa.int64()), ("known", pa.bool_()), ("h2", pa.float64()), ("predicted", pa.float64())]).empty_table()
    return spark.createDataFrame(pa.concat_tables(parts) if parts else empty)


# --- global and local kernels together ---


def _left_out(inverse_times, diagonal: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Predictions of each sample from all others, the mean being theirs too, from the inverse over
    all: without sample i a vector w is predicted at i as w_i - (P w)_i / P_ii."""
    n = len(y)
    found = np.column_stack([y, np.ones(n)])
    found = found - inverse_times(found) / diagonal[:, None]
    mean = (y.sum() - y) / (n - 1)
    return mean + found[:, 0] - mean * found[:, 1]


def _terms(inverse_times, diagonal, cross, y: np.ndarray, h2: float) -> np.ndarray:
    """Term of each sample: known ones left out, the others predicted from all known.

    ``cross``: times K between the others and the known samples."""
    known = ~np.isnan(y)
    own = y[known]
    out = np.empty(len(y))
    out[known] = _left_out(inverse_times, diagonal, own)
    out[~known] = own.mean() + h2 * cross(inverse_times((own - own.mean())[:, None]))[:, 0]
    return out


def global_term(spark, k: np.ndarray, y: np.ndarray, h2: float, kernel: str = "global") -> DataFrame:
    """kernel, ordinal, term for a dense kinship of all samples (y: NaN where to be predicted)."""
    if len(k) > MOST_SAMPLES:
        raise ValueError(f"{len(k)} samples; dense matrices stop at {MOST_SAMPLES}")
    known = ~np.isnan(y)
    inverse = np.linalg.inv(h2 * k[np.ix_(known, known)] + (1 - h2) * np.eye(int(known.sum())))
    found = _terms(lambda v: inverse @ v, np.diag(inverse), lambda v: k[np.ix_(~known, known)] @ v, y, h2)
    return spark.createDataFrame(pa.table({"kernel": pa.array([kernel] * len(y)), "ordinal": pa.array(np.arange(len(y))), "term": pa.array(found)}))


def local_terms(sites: DataFrame, y: np.ndarray, shares: DataFrame) -> DataFrame:
    """kernel, ordinal, term of the kinship that each region's variants make: ``sites`` has kernel
    and g, ``shares`` kernel and h2 (of at least 0 and below 1).

    A region is one group, bounded by its width; its kinship has at most as many ranks as variants,
    so all samples are left out by products with its thin singular vectors, no matrix between
    samples is inverted or formed.  Regions without a varying variant have no rows."""
    held = sites.sparkSession.sparkContext.broadcast(y)
    schema = pa.schema([("kernel", pa.string()), ("ordinal", pa.int64()), ("term", pa.float64())])

    def run(key, rows):
        y, h2 = held.value, rows["h2"][0].as_py()
        n = len(y)
        g, varies, _ = _batch(rows.combine_chunks(), np.arange(n))
        z = g[varies]
        if not len(z):
            return schema.empty_table()
        z = ((z - z.mean(1, keepdims=True)) / z.std(1, ddof=1, keepdims=True)).T
        # columns are centred, so the trace of the centred kinship is that of z z'
        z = z * np.sqrt((n - 1) / (z * z).sum())
        known = ~np.isnan(y)
        u, s, _ = np.linalg.svd(z[known], full_matrices=False)
        # (h2 z z' + (1 - h2) I)^-1 by Woodbury's identity
        shrink = h2 * s * s / (h2 * s * s + 1 - h2)
        times = lambda v: (v - u @ (shrink[:, None] * (u.T @ v))) / (1 - h2)
        diagonal = (1 - (u * u) @ shrink) / (1 - h2)
        found = _terms(times, diagonal, lambda v: z[~known] @ (z[known].T @ v), y, h2)
        return pa.table({"kernel": pa.array([key[0].as_py()] * n), "ordinal": pa.array(np.arange(n)), "term": pa.array(found)})

    rows = sites.select(F.col("kernel").cast("string").alias("kernel"), "g").join(shares.select(F.col("kernel").cast("string").alias("kernel"), F.col("h2").cast("double").alias("h2")), "kernel")
    return rows.groupBy("kernel").applyInArrow(run, "kernel string, ordinal long, term double")


def combined_prediction(terms: DataFrame, y: np.ndarray, most: int = 200) -> tuple[DataFrame, dict[str, float]]:
    """ordinal, known, predicted, and the weights (by kernel, and "" for the intercept): the trait
    regressed on the terms of its known samples, each of which was left out of its own, and those
    weights applied to every sample.  At most ``most`` kernels, fewer than known samples."""
    names = [r["kernel"] for r in terms.select("kernel").distinct().orderBy("kernel").limit(most + 1).collect()]
    known = ~np.isnan(y)
    if len(names) > most or len(names) >= known.sum():
        raise ValueError("more kernels than a joint model should have")
    wide = terms.groupBy("ordinal").pivot("kernel", names).agg(F.first("term")).orderBy("ordinal").toArrow()
    x = np.column_stack([np.ones(len(y)), *(wide[c].to_numpy() for c in names)])
    b, *_ = np.linalg.lstsq(x[known], y[known], rcond=None)
    held = F.create_map(*[F.lit(v) for pair in zip(names, b[1:].tolist(), strict=True) for v in pair])
    found = terms.groupBy("ordinal").agg((F.sum(F.col("term") * held[F.col("kernel")]) + float(b[0])).alias("predicted"))
    flags = F.array(*[F.lit(bool(v)) for v in known])
    return found.select("ordinal", F.element_at(flags, (F.col("ordinal") + 1).cast("int")).alias("known"), "predicted"), dict(zip(["", *names], b.tolist(), strict=True))
