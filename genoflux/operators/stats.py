"""Table statistics: ranks, correlation, contingency tables, normality, p-values."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from .scratch import cut


def running_before(counts: DataFrame, value: str, n: str, out: str, rows: int = 500_000, least: int = 64) -> DataFrame:
    """Adds the sum of ``n`` over all smaller values of a numeric column of distinct values.

    Rows are dealt into ranges of about ``rows`` by approximate quantiles (``least`` ranges at
    least); each range sums on its own behind the sum of those before, so no task holds more
    than about a range."""
    parts = max(least, -(-counts.count() // rows))
    splits = sorted({float(v) for v in counts.approxQuantile(value, [i / parts for i in range(1, parts)], min(0.002, 0.2 / parts))})
    smaller = lambda x: F.size(F.filter(x, lambda s: s < F.col(value)))
    if not splits:
        part = F.lit(0)
    elif len(splits) <= 64:
        part = smaller(F.array(*map(F.lit, splits)))
    else:  # every 64th split first, then those between
        every, coarse = F.array(*map(F.lit, splits)), smaller(F.array(*map(F.lit, splits[::64])))
        part = F.when(coarse == 0, 0).otherwise((coarse - 1) * 64 + smaller(F.slice(every, F.greatest(coarse - 1, F.lit(0)) * 64 + 1, F.lit(64))))
    own = counts.withColumn("_part", F.coalesce(part, F.lit(0)))
    sums = {r["_part"]: r["s"] for r in own.groupBy("_part").agg(F.sum(n).alias("s")).collect()}  # a row a range
    offsets = np.concatenate([[0], np.cumsum([sums.get(i, 0) for i in range(len(splits))])]).astype(int).tolist()
    order = Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    base = F.element_at(F.array(*[F.lit(v).cast("long") for v in offsets]), F.col("_part") + 1)
    return own.withColumn(out, base + F.coalesce(F.sum(n).over(order), F.lit(0))).drop("_part")


def median(rows: DataFrame, value: str) -> DataFrame:
    """n and the exact median of the known values (the mean of the two middle ones): counts of distinct
    values by ranges, so no task holds them all.  No known value: n 0, median null."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    own = running_before(counts, "v", "c", "_b").join(F.broadcast(total))  # one row
    holds = lambda i: (F.col("_b") <= i) & (i < F.col("_b") + F.col("c"))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    middle = own.agg(((F.max(F.when(holds(low), F.col("v"))) + F.max(F.when(holds(high), F.col("v")))) / 2).alias("median"))
    return total.join(F.broadcast(middle))  # one row


def ecdf(rows: DataFrame, value: str) -> DataFrame:
    """value and share (of known values at most this one) of each distinct value."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t"))
    return running_before(counts, "value", "_n", "_b").join(F.broadcast(total)).select("value", ((F.col("_b") + F.col("_n")) / F.col("_t")).alias("share"))  # one row


def average_ranks(rows: DataFrame, value: str, by: str | None = None, out: str = "rank") -> DataFrame:
    """Adds the rank of ``value`` in ascending order, ties sharing their mean rank.

    Ranks come from the table of distinct values (counts before each), so ties are
    aggregated first; that table is ordered within each ``by`` group."""
    keys = [by] if by else []
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    if by:
        order = Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_b", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    else:
        counts = running_before(counts, value, "_n", "_b")
    counts = counts.withColumn(out, F.col("_b") + (F.col("_n") + 1) / 2).drop("_n", "_b")
    return rows.join(counts, [*keys, value])


def pearson(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """n, r and its two-sided p over rows where both are known."""
    return _with_p(pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.count("*").alias("n"), F.corr(x, y).alias("r")))


def _with_p(found: DataFrame) -> DataFrame:
    t = F.sqrt(F.col("r") ** 2 / (1 - F.col("r") ** 2) * (F.col("n") - 2))
    return found.withColumn("p", special.t_pvalue(t, (F.col("n") - 2).cast("double")))


def spearman(pairs: DataFrame, x: str, y: str) -> DataFrame:
    rows = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    rows = average_ranks(average_ranks(rows, x, out="_rx"), y, out="_ry")
    return _with_p(rows.agg(F.count("*").alias("n"), F.corr("_rx", "_ry").alias("r")))


def correlation_tests(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """n, r, p (two-sided, by t) and p_z (one-sided, by Fisher's transform, for the size of r)."""
    return pearson(pairs, x, y).withColumn("p_z", special.fisher_z_pvalue("r", F.col("n").cast("double")))


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    """chi2 (Pearson), lr (likelihood ratio, empty cells counted as 0.5) and df of the
    table of two columns, over rows where both are known; only values that occur make rows and
    columns.

    Empty cells are never made: their expected counts sum to what the full ones leave of the
    total, and the logarithms of all expected counts to sums over the margins."""
    known = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = known.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("o"))
    by_a, by_b = cells.groupBy("a").agg(F.sum("o").alias("ra")), cells.groupBy("b").agg(F.sum("o").alias("rb"))
    margin = lambda t, c: t.agg(F.count("*").alias(f"n{c}"), F.sum(c).alias(f"s{c}"), F.sum(F.log(c)).alias(f"l{c}"))
    one = margin(by_a, "ra").join(margin(by_b, "rb"))  # a row each
    n = F.col("sra")
    full = cells.join(by_a, "a").join(by_b, "b").join(F.broadcast(one.select("sra")))  # one row
    o, e = F.col("o"), F.col("ra").cast("double") * F.col("rb") / n
    t = full.agg(F.count("*").alias("c"), F.sum((o - e) * (o - e) / e).alias("chi"), F.sum(e).alias("e"), F.sum(2 * o * F.log(o / e)).alias("lr"), F.sum(F.log(e)).alias("le")).join(one)
    empty = F.col("nra") * F.col("nrb") - F.col("c")
    rest = F.col("nrb") * F.col("lra") + F.col("nra") * F.col("lrb") - F.col("nra") * F.col("nrb") * F.log(n) - F.col("le")
    return t.select((F.col("chi") + F.when(empty > 0, n - F.col("e")).otherwise(0)).alias("chi2"), (F.col("lr") + F.when(empty > 0, empty * math.log(0.5) - rest).otherwise(0)).alias("lr"), ((F.col("nra") - 1) * (F.col("nrb") - 1)).alias("df"))


def ks_normal(rows: DataFrame, value: str) -> DataFrame:
    """n, d, p: largest distance of the empirical to the fitted normal distribution, both
    sides of each step, and its p as if the normal were not fitted."""
    known = rows.where(F.col(value).isNotNull())
    own = known.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    moments = known.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    steps = running_before(own, "v", "c", "_b").withColumn("up", F.col("_b") + F.col("c")).join(F.broadcast(moments))  # one row
    tail = special.normal_tail((F.col("v") - F.col("mean")) / F.col("sd"))
    steps = steps.withColumn("cdf", 1 - tail)
    gap = F.greatest(F.abs(F.col("up") / F.col("n") - F.col("cdf")), F.abs((F.col("up") - F.col("c")) / F.col("n") - F.col("cdf")))
    return steps.groupBy("n").agg(F.max(gap).alias("d")).withColumn("p", special.ks_pvalue("d", "n"))


def null_log_likelihood(rows: DataFrame, value: str) -> DataFrame:
    """n and logl of a normal model with a mean only, at its maximum."""
    v = F.var_pop(value)
    return rows.where(F.col(value).isNotNull()).agg(F.count("*").alias("n"), (-F.count("*") / 2.0 * (F.log(F.lit(2 * math.pi)) + 1 + F.log(v))).alias("logl"))


def standardized(rows: DataFrame, value: str, by: list[str], out: str = "z") -> DataFrame:
    """Adds (value - mean) / sd (n - 1) within groups; null where sd is 0.  Means are
    aggregated and joined, not windowed, so a hot group is not one task."""
    m = rows.groupBy(by).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return rows.join(m, by).withColumn(out, F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def centered_by_prefix(rows: DataFrame, id_: str, value: str, separator: str = "_") -> DataFrame:
    """Subtracts the mean of the family, the id's part before the separator."""
    rows = rows.withColumn("family", F.substring_index(id_, separator, 1))
    means = rows.groupBy("family").agg(F.avg(value).alias("_m"))
    return rows.join(means, "family").withColumn("centered", F.col(value) - F.col("_m")).drop("_m")


def combined_p(rows: DataFrame, p: str, by: list[str]) -> DataFrame:
    """Fisher's combination: stat = -2 sum ln p, df = 2 k, p."""
    out = rows.groupBy(by).agg((-2 * F.sum(F.log(p))).alias("stat"), (2 * F.count("*")).alias("df"))
    return out.withColumn("p", special.chi2_pvalue("stat", F.col("df").cast("double")))


def empirical_p(observed: DataFrame, null: DataFrame, by: list[str], value: str, larger: bool = True) -> DataFrame:
    """Share of null values that are as large (or as small) as the observed one."""
    rows = observed.select(*by, F.col(value).alias("_o")).join(null.select(*by, value), by)
    hit = F.col(value) >= F.col("_o") if larger else F.col(value) <= F.col("_o")
    return rows.groupBy(by).agg((F.count_if(hit) / F.count("*")).alias("p"), F.count("*").alias("n_null"))


def distance_correlation(rows: DataFrame, id_: str, x: str, y: str, block: int = 2048) -> DataFrame:
    """Distance correlation of two array columns, from sums over pairs of rows.  Rows of which a
    value is unknown take no part; ``id_`` names the rows.

    All pairs of distinct rows are compared, equal ones as one with their number, so this is
    quadratic, for the sample axis.  Rows are dealt into blocks of about ``block``; a task
    holds one block and meets all rows as they stream in, a square of distances at a time.
    The doubly centred products reduce to three sums: mean(ab), mean(a) mean(b) and
    the mean of products of row means."""
    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).where(~F.exists(x, lambda v: v.isNull()) & ~F.exists(y, lambda v: v.isNull()))
    own = known.groupBy(F.col(x).cast("array<double>").alias("x"), F.col(y).cast("array<double>").alias("y")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    one = own.agg(F.count("*").alias("d"), F.sum("w").alias("n")).first()
    blocks, total = -(-one["d"] // block) or 1, one["n"] or 0.0
    left = own.select(F.pmod(F.xxhash64("x", "y"), F.lit(blocks)).cast("int").alias("u"), F.lit(0).alias("side"), "x", "y", "w")
    right = own.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("u"), F.lit(1).alias("side"), "x", "y", "w")
    names = ["ab", "aa", "bb", "A", "B", "mab", "maa", "mbb"]

    def matrix(column) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        if p.shape[1] == 1:
            return np.abs(p - q.T)
        s = np.zeros((len(p), len(q)))
        for i in range(p.shape[1]):
            s += (p[:, i, None] - q[None, :, i]) ** 2
        return np.sqrt(s)

    def run(batches):
        unit, mine, sums = None, [], None

        def done():
            w = np.concatenate([m[2] for m in mine])
            ra, rb = sums[0] / total, sums[1] / total
            cells = [w @ sums[2], w @ sums[3], w @ sums[4], w @ ra, w @ rb, w @ (ra * rb), w @ (ra * ra), w @ (rb * rb)]
            return pa.RecordBatch.from_arrays([pa.array([float(c)]) for c in cells], names)

        for batch in batches:
            us, sides = batch["u"].to_numpy(), batch["side"].to_numpy()
            turns = [0, *(np.flatnonzero((us[1:] != us[:-1]) | (sides[1:] != sides[:-1])) + 1).tolist(), len(us)]
            for first, last in zip(turns[:-1], turns[1:], strict=True):
                if last == first:
                    continue
                rest = batch.slice(first, last - first)
                p, q, w = matrix(rest["x"]), matrix(rest["y"]), rest["w"].to_numpy()
                if us[first] != unit:
                    if sums is not None:
                        yield done()
                    unit, mine, sums = us[first], [], None
                if sides[first] == 0:
                    mine.append((p, q, w))
                    continue
                if not mine:  # no row was dealt into this block
                    continue
                if sums is None:
                    px, py = (np.concatenate([m[i] for m in mine]) for i in (0, 1))
                    sums = np.zeros((5, len(px)))
                for i in range(0, len(px), 128):
                    for j in range(0, len(p), 1024):
                        at, to = slice(i, i + 128), slice(j, j + 1024)
                        a, b, v = gaps(px[at], p[to]), gaps(py[at], q[to]), w[to]
                        sums[:, at] += np.stack([a @ v, b @ v, (a * b) @ v, (a * a) @ v, (b * b) @ v])
        if sums is not None:
            yield done()

    both = left.unionByName(right).repartition(blocks, "u").sortWithinPartitions("u", "side")
    parts = both.mapInArrow(run, ", ".join(f"{c} double" for c in names))
    n = F.lit(float(total))
    t = parts.agg(*[(F.sum(c) / n).alias(c) for c in names]).withColumns({c: F.col(c) / n for c in ("ab", "aa", "bb")})

    def cov(s: str, m: str, u: str, v: str) -> Column:
        return F.col(s) - 2 * F.col(m) + F.col(u) * F.col(v)

    return t.select(F.lit(int(total)).cast("long").alias("n"), F.sqrt(cov("ab", "mab", "A", "B") / F.sqrt(cov("aa", "maa", "A", "A") * cov("bb", "mbb", "B", "B"))).alias("dcor"))


def permutation(n: int, seed: int, round_: int) -> np.ndarray:
    """A permutation that depends on the seed and the round alone."""
    return np.random.default_rng([seed, round_]).permutation(n)


def clusters(rows: DataFrame, features: str, ks: list[int], seed: int = 1) -> DataFrame:
    """k, dbi for each number of clusters: k-means with the Davies-Bouldin index."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = rows.select(array_to_vector(features).alias("f"), F.col(features).alias("x"))
    out = []
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol="f", predictionCol="c").fit(data)
        centres = [[float(v) for v in c] for c in model.clusterCenters()]
        own = F.array(*[F.array(*map(F.lit, c)) for c in centres])
        gap = F.sqrt(F.aggregate(F.zip_with("x", F.element_at(own, F.col("c") + 1), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, t: s + t))
        spread = {r["c"]: r["s"] for r in model.transform(data).groupBy("c").agg(F.avg(gap).alias("s")).collect()}
        ids = sorted(spread)
        worst = [max([(spread[i] + spread[j]) / max(math.dist(centres[i], centres[j]), 1e-300) for j in ids if j != i], default=0.0) for i in ids]
        out.append((k, float(np.mean(worst))))
    return rows.sparkSession.createDataFrame(out, "k int, dbi double")


def _nearest(centres: str, features: str) -> Column:
    """at, gap: place and distance of the nearest of an array of centres; ties to the first."""
    gap = lambda c: F.sqrt(F.aggregate(F.zip_with(c, features, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, t: s + t))
    return F.array_min(F.transform(centres, lambda c, i: F.struct(gap(c).alias("gap"), i.alias("at"))))


def representatives(rows: DataFrame, id_: str, features: str, centres: list[list[float]], least: int = 1) -> DataFrame:
    """cluster (place of its centre), representative (id of the nearest member, ties to the
    smallest id), gap (its distance), size.

    Rows belong to the nearest centre.  A centre with fewer than ``least`` rows is dissolved, and
    its rows go to the nearest of the others; where none is left the result is empty.  Rows
    without features take no part.  The centres go to the tasks as one row; nearest members
    are found by partial minima, so the shuffle is of a row a cluster and task."""
    spark = rows.sparkSession
    own = rows.where(F.col(features).isNotNull()).select(F.col(id_).alias("_id"), F.col(features).alias("_x"))

    def assigned(kept: list[int]) -> DataFrame:
        table = spark.createDataFrame([([list(map(float, centres[i])) for i in kept], kept)], "_c array<array<double>>, _kept array<int>")
        near = own.join(F.broadcast(table)).withColumn("_n", _nearest("_c", "_x"))  # one row, of the given centres
        return near.select("_id", F.col("_n.gap").alias("gap"), F.get("_kept", F.col("_n.at")).alias("cluster"))

    every = list(range(len(centres)))
    if not every:
        return spark.createDataFrame([], f"cluster int, representative {own.schema['_id'].dataType.simpleString()}, gap double, size long")
    sizes = {r["cluster"]: r["count"] for r in assigned(every).groupBy("cluster").count().collect()}  # a row a centre
    kept = [i for i in every if sizes.get(i, 0) >= least]
    found = assigned(kept or every).groupBy("cluster").agg(F.min(F.struct("gap", "_id")).alias("m"), F.count("*").alias("size"))
    return found.where(F.lit(bool(kept))).select("cluster", F.col("m._id").alias("representative"), "m.gap", "size")


def best_clusters(rows: DataFrame, id_: str, features: str, ks: list[int], least: int = 1, seed: int = 1) -> DataFrame:
    """k, dbi and ``representatives`` of the clustering with the smallest Davies-Bouldin index
    among ``ks`` (ties to the fewest clusters)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    own = rows.where(F.col(features).isNotNull())
    best = clusters(own, features, ks, seed).orderBy("dbi", "k").first()
    model = KMeans(k=best["k"], seed=seed, featuresCol="f", predictionCol="c").fit(own.select(array_to_vector(features).alias("f")))
    found = representatives(own, id_, features, [[float(v) for v in c] for c in model.clusterCenters()], least)
    return found.select(F.lit(best["k"]).alias("k"), F.lit(best["dbi"]).alias("dbi"), *found.columns)


def best_transform(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` with transformed: of log, exp, sqrt, square and the value itself, the one
    closest to normal (smallest distance of ``ks_normal``); a shift makes values
    positive where the smallest is not.  exp is of the standardised value.

    No choice turns the order of values, so they are counted and ranked once and the distances of all
    choices come from one pass over the ranks."""
    counts = cut(rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c")))
    n, mean = F.sum("c"), F.sum(F.col("v") * F.col("c")) / F.sum("c")
    m = counts.agg(F.min("v").alias("lo"), mean.alias("mean"), n.alias("n")).first()
    centred = m["mean"] or 0.0
    sd = counts.agg(F.sqrt(F.sum((F.col("v") - centred) ** 2 * F.col("c")) / F.nullif(n - 1, F.lit(0))).alias("sd")).first()["sd"]
    shift = 0.0 if m["lo"] is None or m["lo"] > 0 else 1.0 - m["lo"]

    def choices(c: str) -> dict[str, Column]:
        v = F.col(c) + shift
        return {"none": F.col(c), "log": F.log(v), "exp": F.exp((F.col(c) - centred) / (sd or 1.0)), "sqrt": F.sqrt(v), "square": v * v}

    every = choices("v")
    means = counts.agg(*[(F.sum(c * F.col("c")) / n).alias(k) for k, c in every.items()]).first()
    spread = counts.agg(*[F.sqrt(F.sum((c - F.lit(means[k])) ** 2 * F.col("c")) / F.nullif(n - 1, F.lit(0))).alias(k) for k, c in every.items()]).first()
    steps = running_before(counts, "v", "c", "_b")

    def gap(k: str) -> Column:
        cdf = 1 - special.normal_tail((every[k] - F.lit(means[k])) / F.lit(spread[k]))
        return F.max(F.greatest(F.abs((F.col("_b") + F.col("c")) / F.lit(m["n"]) - cdf), F.abs(F.col("_b") / F.lit(m["n"]) - cdf)))

    d = steps.agg(*[gap(k).alias(k) for k in every]).first().asDict() if m["n"] and all(spread) else {}
    best = min((k for k in every if d.get(k) is not None), key=lambda k: d[k], default="none")
    return rows.withColumn("transformed", choices(value)[best]).withColumn("transform", F.lit(best))


def normalized_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each column divided by its sum (null where the sum is 0)."""
    t = rows.agg(*[F.sum(c).alias(f"_{i}") for i, c in enumerate(columns)])
    return rows.join(F.broadcast(t)).withColumns({c: F.col(c) / F.nullif(F.col(f"_{i}"), F.lit(0.0)) for i, c in enumerate(columns)}).drop(*[f"_{i}" for i in range(len(columns))])  # one row


def histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """bin, low, high, n of equal bins between the smallest and the largest value."""
    t = rows.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    own = rows.where(F.col(value).isNotNull()).join(F.broadcast(t))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / width))).otherwise(0)
    return own.groupBy(at.cast("long").alias("bin"), (F.col("lo") + at * width).alias("low"), (F.col("lo") + (at + 1) * width).alias("high")).agg(F.count("*").alias("n"))


def jackknife(rows: DataFrame, id_: str, rounds: int, share: float, seed: int = 2) -> DataFrame:
    """``rows`` once for each round (column round), each without a hashed share of the ids."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "round", id_), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    return rows.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).where(u >= share)
