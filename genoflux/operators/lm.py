"""Linear models, one variant at a time, from sums that Spark aggregates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import t_pvalue, t_two_sided

SITE = ["chr", "pos"]


def matched(calls: DataFrame, phenotypes: DataFrame) -> DataFrame:
    """Calls of samples that have the trait: chr, pos, sample_id, dosage, y."""
    known = phenotypes.where("y is not null").select("sample_id", "y")
    return calls.where("dosage is not null").join(known, "sample_id")


def scan(rows: DataFrame, x: str = "dosage", by: tuple[str, ...] = ("chr", "pos")) -> DataFrame:
    """Regression of y on ``x`` for each variant that varies: n, coef, sd_err (of the
    residuals), adj_r2, t2.

    Partial sums are combined before the shuffle, one row a variant and task."""
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.regr_slope("y", x).alias("coef"),
        F.regr_r2("y", x).alias("r2"),
        F.regr_sxx("y", x).alias("sxx"),
        F.regr_syy("y", x).alias("syy"),
    )
    out = out.where("sxx > 0 and syy > 0 and n > 2 and r2 < 1")
    r2, n = F.col("r2"), F.col("n")
    return out.select(*by, "n", "coef", F.sqrt(F.col("syy") * (1 - r2) / (n - 2)).alias("sd_err"), (1 - (1 - r2) * (n - 1) / (n - 2)).alias("adj_r2"), (r2 / (1 - r2) * (n - 2)).alias("t2"))


def with_p(scanned: DataFrame) -> DataFrame:
    return scanned.withColumn("pvalue", t_pvalue(F.sqrt("t2"), (F.col("n") - 2).cast("double")))


def bonferroni(scanned: DataFrame, threshold: float) -> DataFrame:
    """Variants with p at most threshold over the number of variants (none of none)."""
    limit = scanned.agg(F.try_divide(F.lit(float(threshold)), F.count("*")).alias("limit"))
    return scanned.join(F.broadcast(limit)).where("pvalue <= limit").drop("limit")  # one row


def best_marker(scanned: DataFrame) -> DataFrame:
    """The variant with the largest adjusted R squared; ties to the first position."""
    return scanned.orderBy(F.desc("adj_r2"), *SITE).limit(1)


def best_by_chromosome(scanned: DataFrame, value: str = "t2") -> DataFrame:
    best = F.max_by(F.struct("pos", value), F.struct(F.col(value), -F.col("pos")))
    return scanned.groupBy("chr").agg(best.alias("x")).select("chr", "x.*")


def residuals(rows: DataFrame, y: str, x: str) -> DataFrame:
    """Adds resid: y without what one covariate explains; a missing covariate is its mean."""
    fit = rows.where(F.col(y).isNotNull() & F.col(x).isNotNull()).agg(F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"), F.avg(x).alias("_m"))
    return rows.join(F.broadcast(fit)).withColumn("resid", F.col(y) - F.col("_a") - F.col("_b") * F.coalesce(x, "_m")).drop("_a", "_b", "_m")  # one row


def second_marker(calls: DataFrame, phenotypes: DataFrame, first: DataFrame) -> DataFrame:
    """Round two of forward selection: adj_r2 of the model of ``first`` (one row: chr, pos)
    and each other variant, over samples with both calls.

    Two covariates need eight sums a variant; nothing leaves the aggregation."""
    rows = matched(calls, phenotypes)
    held = rows.join(F.broadcast(first.select(*SITE)), SITE).select("sample_id", F.col("dosage").alias("w"))
    own = rows.join(held, "sample_id").withColumn("x", F.col("dosage"))
    own = own.join(F.broadcast(first.select(*SITE)), SITE, "left_anti")
    s = lambda u, v: F.covar_pop(u, v) * F.count("*")
    m = own.groupBy(SITE).agg(F.count("*").alias("n"), s("x", "x").alias("xx"), s("w", "w").alias("ww"), s("x", "w").alias("xw"), s("x", "y").alias("xy"), s("w", "y").alias("wy"), s("y", "y").alias("yy"))
    det = F.col("xx") * F.col("ww") - F.col("xw") * F.col("xw")
    bx, bw = (F.col("ww") * F.col("xy") - F.col("xw") * F.col("wy")) / F.col("det"), (F.col("xx") * F.col("wy") - F.col("xw") * F.col("xy")) / F.col("det")
    m = m.withColumn("det", det).where("det > 1e-9 and yy > 0 and n > 3")
    rss = F.col("yy") - bx * F.col("xy") - bw * F.col("wy")
    return m.select(*SITE, "n", (1 - rss / F.col("yy") * (F.col("n") - 1) / (F.col("n") - 3)).alias("adj_r2"))


def least_squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Coefficients, their standard errors, residual sd and adjusted R squared (an
    intercept is the first column)."""
    n, k = x.shape
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    r = y - x @ b
    s2 = float(r @ r) / max(n - k, 1)
    se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(x.T @ x)) * s2, 0))
    total = float(((y - y.mean()) ** 2).sum())
    return b, se, s2**0.5, 1 - (float(r @ r) / total) * (n - 1) / max(n - k, 1) if total else 0.0


def selected_model(calls: DataFrame, phenotypes: DataFrame, sites: DataFrame) -> dict:
    """Joint model of a few chosen variants (at most 64); only their calls come to the driver.

    Missing calls take the variant's mean.  coef, se and p are in order of chr, pos
    behind the intercept."""
    chosen = sites.select(*SITE).distinct().orderBy(*SITE).limit(65)
    if chosen.count() > 64:
        raise ValueError("more sites than a joint model should have")
    rows = matched(calls, phenotypes).join(F.broadcast(chosen), SITE).select(*SITE, "sample_id", "dosage", "y").toPandas()
    wide = rows.pivot_table(index="sample_id", columns=SITE, values="dosage")
    y = rows.groupby("sample_id").y.first().loc[wide.index].to_numpy()
    wide = wide.fillna(wide.mean())
    x = np.column_stack([np.ones(len(wide)), wide.to_numpy()])
    b, se, sd, adj = least_squares(x, y)
    return {"n": len(y), "coef": b, "se": se, "p": t_two_sided(b / np.where(se > 0, se, np.nan), max(1, len(y) - x.shape[1])), "sd_err": sd, "adj_r2": adj}


def joint_scan(rows: DataFrame, held: list[str]) -> DataFrame:
    """adj_r2 of the model of ``held`` columns and each variant's dosage together, and the squared t of the
    variant in it: chr, pos, n, adj_r2, t2.  Variants that the others explain, and perfect fits, have no row.

    Sums of products are aggregated, a row a variant; the small systems are solved behind."""
    names = ["dosage", *held, "y"]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = rows.groupBy(SITE).agg(F.count("*").alias("n"), *((F.covar_pop(names[i], names[j]) * F.count("*")).alias(f"s{i}_{j}") for i, j in pairs))
    k = len(names) - 1

    def run(batches):
        for batch in batches:
            m = np.zeros((batch.num_rows, k + 1, k + 1))
            for i, j in pairs:
                m[:, i, j] = m[:, j, i] = batch[f"s{i}_{j}"].to_numpy(zero_copy_only=False)
            n = batch["n"].to_numpy().astype(float)
            xx, w, yy = m[:, 0, 0], m[:, 1:k, 1:k], m[:, k, k]
            turned = np.linalg.pinv(w) if k > 1 else np.zeros((len(n), 0, 0))
            # what the held columns leave of the variant and of the trait (Frisch and Waugh)
            left = lambda u, v: m[:, u, v] - np.einsum("ni,nij,nj->n", m[:, u, 1:k], turned, m[:, 1:k, v])
            free, cross, rest = left(0, 0), left(0, k), left(k, k)
            ok = (n > k + 1) & (xx > 0) & (yy > 0) & (free > 1e-9 * xx)
            rss = rest - cross**2 / np.where(ok, free, 1)
            ok &= rss > 1e-9 * yy
            adj = 1 - rss / np.where(ok, yy, 1) * (n - 1) / np.where(ok, n - k - 1, 1)
            keep = pa.array(np.flatnonzero(ok))
            t2 = cross[ok] ** 2 / free[ok] / (rss[ok] / (n[ok] - k - 1))
            yield pa.RecordBatch.from_arrays([batch["chr"].take(keep), batch["pos"].take(keep), batch["n"].take(keep), pa.array(adj[ok]), pa.array(t2)], [*SITE, "n", "adj_r2", "t2"])

    return sums.mapInArrow(run, "chr int, pos long, n long, adj_r2 double, t2 double")


def candidates(calls: DataFrame, phenotypes: DataFrame, threshold: float, maf: float = 0.0) -> DataFrame:
    """chr, pos of variants whose own p is at most ``threshold`` over the number of variants, and
    whose folded frequency (of all calls) is at least ``maf``.

    The scan, a row a variant, is computed once, to the shared folder: it is counted and compared."""
    from .scratch import cut
    from .variants import frequencies

    passed = bonferroni(cut(with_p(scan(matched(calls, phenotypes)))), threshold).select(*SITE)
    return passed.join(frequencies(calls).where(F.col("maf") >= maf).select(*SITE), SITE, "left_semi") if maf > 0 else passed


def forward(calls: DataFrame, phenotypes: DataFrame, rounds: int, among: DataFrame | None = None) -> DataFrame:
    """Greedy selection by joint models: round, chr, pos, n, adj_r2 of the model of all chosen
    so far, pvalue of the round's variant in it.  A round compares, for each variant (of
    ``among``, if given: chr, pos), the joint fit with those chosen before, over samples whose
    calls of all of them are known.

    The calls of ``among`` are computed once, to the shared folder, for all rounds.  The p of the
    variant chosen is the only one that is computed."""
    from .scratch import cut

    if among is not None:
        calls = cut(calls.join(among, SITE, "left_semi"))
    rows, held, out = matched(calls, phenotypes), [], []
    for r in range(1, rounds + 1):
        best = joint_scan(rows, held).orderBy(F.desc(F.round("adj_r2", 9)), *SITE).first()
        if best is None:
            break
        p = t_two_sided(np.sqrt(best["t2"]), best["n"] - len(held) - 2)
        out.append((r, int(best["chr"]), int(best["pos"]), int(best["n"]), float(best["adj_r2"]), float(p)))
        here = (F.col("chr") == best["chr"]) & (F.col("pos") == best["pos"])
        held.append(f"w{r}")
        own = calls.where(here & F.col("dosage").isNotNull()).select("sample_id", F.col("dosage").alias(held[-1]))
        rows = rows.where(~here).join(own, "sample_id")
    return calls.sparkSession.createDataFrame(out, "round int, chr int, pos long, n long, adj_r2 double, pvalue double")


def final_coefficients(calls: DataFrame, phenotypes: DataFrame, chosen: DataFrame) -> DataFrame:
    """round (0: the intercept), chr, pos, n, coef, se, pvalue of the joint model of ``chosen`` (round,
    chr, pos; at most 64), over samples whose calls of all of them are known.

    Spark adds up the products; the driver solves one small system."""
    sites = [(r["round"], r["chr"], r["pos"]) for r in chosen.select("round", *SITE).orderBy("round").limit(65).collect()]
    if len(sites) > 64:
        raise ValueError("more sites than a joint model should have")
    names = [f"x{r}" for r, _, _ in sites]
    rows = phenotypes.where("y is not null").select("sample_id", F.col("y").cast("double").alias("y"))
    for name, (_, c, p) in zip(names, sites, strict=True):
        rows = rows.join(calls.where((F.col("chr") == c) & (F.col("pos") == p) & F.col("dosage").isNotNull()).select("sample_id", F.col("dosage").alias(name)), "sample_id")
    both = [*names, "y"]
    pairs = [(a, b) for i, a in enumerate(both) for b in both[i:]]
    got = rows.agg(F.count("*").alias("n"), *(F.avg(a).alias(f"m{i}") for i, a in enumerate(both)), *((F.covar_pop(a, b) * F.count("*")).alias(f"s{i}") for i, (a, b) in enumerate(pairs))).first()
    n, k, out = got["n"], len(names), []
    if n > k + 1:
        s = np.zeros((k + 1, k + 1))
        for i, (a, b) in enumerate(pairs):
            s[both.index(a), both.index(b)] = s[both.index(b), both.index(a)] = got[f"s{i}"]
        mean = np.array([got[f"m{i}"] for i in range(k + 1)], float)
        inverse = np.linalg.pinv(s[:k, :k])
        b = inverse @ s[:k, k]
        s2 = max(float(s[k, k] - b @ s[:k, k]), 0.0) / (n - k - 1)
        se = np.sqrt(np.append(1 / n + mean[:k] @ inverse @ mean[:k], np.diag(inverse)) * s2)
        coef = np.append(mean[k] - b @ mean[:k], b)
        p = np.asarray(t_two_sided(coef / np.where(se > 0, se, np.nan), n - k - 1), float)
        out = [(r, c, x, n, *map(float, v)) for (r, c, x), *v in zip([(0, None, None), *sites], coef, se, p, strict=True)]
    return calls.sparkSession.createDataFrame(out, "round int, chr int, pos long, n long, coef double, se double, pvalue double")


def forward_families(calls: DataFrame, phenotypes: DataFrame, rounds: int, id_: str = "sample_id", separator: str = "_", threshold: float | None = None, maf: float = 0.0) -> DataFrame:
    """``forward`` with the trait freed of the mean of each sample's family, the part of ``id_`` before
    the separator (the whole id where there is none).  ``threshold`` and ``maf``: the gate of
    ``candidates``, of the freed trait."""
    from .stats import centered_by_prefix

    known = phenotypes.where("y is not null").select("sample_id", F.col(id_).cast("string").alias("_id"), "y")
    own = centered_by_prefix(known, "_id", "y", separator).select("sample_id", F.col("centered").alias("y"))
    return forward(calls, own, rounds, candidates(calls, own, threshold, maf) if threshold is not None else None)


def permutation_p(calls: DataFrame, phenotypes: DataFrame, rounds: int, seed: int) -> DataFrame:
    """chr, pos, p (share of permuted traits that explain at least as much as the observed one),
    n_null (permutations that have a regression); a sample has one call of a variant.

    Calls are shuffled to a row a variant, whatever the rounds.  Samples are numbered in the order
    of their ids by a sort over all tasks; what the driver holds of the sample axis is the trait, 8
    bytes a sample, and a task that times the rounds.  A block of variants meets the traits of all
    rounds in sums over its calls alone, so samples without a call cost nothing."""
    from .scratch import cut
    from .stats import permutation

    spark = calls.sparkSession
    known = phenotypes.where("y is not null").select("sample_id", F.col("y").cast("double").alias("y")).orderBy("sample_id")
    known = cut(known.select("sample_id", "y", F.monotonically_increasing_id().alias("_m")))
    part, row = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = [(r["p"], r["n"]) for r in known.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()]  # a row a partition
    before = np.concatenate([[0], np.cumsum([n for _, n in sizes])]).astype(int).tolist()
    n = before[-1]
    first = spark.createDataFrame([(p, b) for (p, _), b in zip(sizes, before[:-1], strict=True)], "_p long, _b long")
    places = known.withColumn("_p", part).join(F.broadcast(first), "_p").select("sample_id", (F.col("_b") + row).cast("int").alias("_i"), "y")
    column, y = places.select("_i", "y").toArrow(), np.zeros(n)
    y[column["_i"].to_numpy()] = column["y"].to_numpy()
    y = y - y.mean() if n else y
    held = spark.sparkContext.broadcast(y)
    cells = calls.where("dosage is not null").join(places.select("sample_id", "_i"), "sample_id")
    cells = cells.groupBy(SITE).agg(F.collect_list(F.struct("_i", F.col("dosage").cast("double").alias("x"))).alias("c"))

    def run(batches):
        y, traits = held.value, None
        for batch in batches:
            if traits is None:
                traits = np.stack([y, *(y[permutation(len(y), seed, r)] for r in range(1, rounds + 1))])
            ends = np.cumsum(pc.list_value_length(batch["at"]).to_numpy())
            start = 0
            while start < batch.num_rows:  # blocks of about 100,000 calls
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + 100_000, "right")))
                own = batch.slice(start, stop - start)
                start = stop
                size = pc.list_value_length(own["at"]).to_numpy()
                heads, x = np.cumsum(size) - size, own["x"].flatten().to_numpy()
                t = traits[:, own["at"].flatten().to_numpy()]
                total = lambda v: np.add.reduceat(v, heads, axis=-1)
                count, sx, sxx = size.astype(float), total(x), total(x * x)
                sy, syy, sxy = total(t), total(t * t), total(t * x)
                vx, vy, both = sxx - sx * sx / count, syy - sy * sy / count, sxy - sx * sy / count
                ok = (count > 2) & (vx > 1e-12 * sxx) & (vy > 1e-12 * syy)
                r2 = both * both / np.where(ok, vx * vy, 1)
                ok &= r2 < 1 - 1e-12
                nulls = ok[1:].sum(0)
                keep = np.flatnonzero(ok[0] & (nulls > 0))
                p = ((r2[1:] >= r2[:1]) & ok[1:]).sum(0)[keep] / nulls[keep]
                yield pa.RecordBatch.from_arrays([own["chr"].take(pa.array(keep)), own["pos"].take(pa.array(keep)), pa.array(p), pa.array(nulls[keep].astype(np.int64))], [*SITE, "p", "n_null"])

    wide = cells.select(F.col("chr").cast("int").alias("chr"), F.col("pos").cast("long").alias("pos"), F.transform("c", lambda s: s["_i"]).alias("at"), F.transform("c", lambda s: s["x"]).alias("x"))
    return wide.mapInArrow(run, "chr int, pos long, p double, n_null long")


def stratified(rows: DataFrame, y: str, x: str, stratum: Column, least: int) -> DataFrame:
    """Simple regression of y on x overall (stratum null) and in each stratum of at least
    ``least`` rows."""
    both = rows.where(F.col(y).isNotNull() & F.col(x).isNotNull()).withColumn("stratum", stratum)
    fit = [F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")]
    return both.rollup("stratum").agg(F.grouping("stratum").alias("overall"), *fit).where((F.col("n") >= least) & ((F.col("overall") == 1) | F.col("stratum").isNotNull())).drop("overall")
