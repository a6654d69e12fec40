"""Mixed-model scans, heritability and local variance components.

``variants``: chr, pos, g (array in order of sample ordinals).  A trait is an array
of that length (NaN where missing).  Sample-sized matrices live on the driver and go
to the tasks as broadcast variables; variants never leave their tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import likelihood as L
from ..functions.alleles import unpacked
from ..functions.special import chi2_sf, t_two_sided
from .joins import in_regions
from .kinship import MOST_SAMPLES, _lists, rescale
from .scratch import cut
from .variants import rare_code

_SCAN = "n long, coef double, sd_err double, adj_r2 double, t2 double, pvalue double, mafc long"


def _aligned(y: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(y) > MOST_SAMPLES:
        raise ValueError(f"{len(y)} samples; dense matrices stop at {MOST_SAMPLES}")
    use = np.flatnonzero(~np.isnan(y))
    return use, y[use], k[np.ix_(use, use)]


def _batch(batch: pa.RecordBatch | pa.Table, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matrix of a batch, or of all of a table (missing calls are the variant's mean), which
    rows vary, mafc (counted as ``variants.test_minor_counts`` does)."""
    if "packed" in batch.schema.names:
        cells = batch["packed"].to_pylist()
        codes = np.frombuffer(b"".join(cells), np.uint8).reshape(len(cells), -1)
        g = (unpacked(codes) if codes.size else np.zeros((len(cells), len(use))))[:, use]
    else:
        chunks = batch["g"].chunks if isinstance(batch, pa.Table) else [batch["g"]]
        flat = [np.asarray(c.flatten().to_numpy(zero_copy_only=False), float) for c in chunks]
        g = np.concatenate(flat or [np.zeros(0)]).reshape(batch.num_rows, -1)[:, use]
    known = ~np.isnan(g)
    count = known.sum(1)
    mean = np.where(known, g, 0).sum(1) / np.maximum(count, 1)
    low, high = np.where(known, g, np.inf).min(1), np.where(known, g, -np.inf).max(1)
    code = np.where(known, np.floor(np.where(known, g, 0) + 0.5), -1)
    a, b, c = ((code == v).sum(1) for v in (0, 1, 2))
    cases = [(a > 0) & (b > 0) & (c > 0), (a > 0) & (b > 0), (a > 0) & (c > 0), (b > 0) & (c > 0)]
    mafc = np.select(cases, [np.minimum(2 * a + b, 2 * c + b), np.where(a <= b, 2 * a, b), 2 * np.minimum(a, c), np.where(b <= c, b, 2 * c)], -1)
    return np.where(known, g, mean[:, None]), (count > 0) & (low < high), mafc


def calls_of(variants: DataFrame) -> str:
    """The column that holds the calls: ``packed`` of a packed store, which the kernels decode, or g."""
    return "packed" if "packed" in variants.columns else "g"


def transformed_ols(t_x: np.ndarray, t_one: np.ndarray, t_y: np.ndarray) -> dict[str, np.ndarray]:
    """Regression of t_y on (t_one, row of t_x) without another intercept, row by row."""
    n = len(t_y)
    uu, uz, zz = t_one @ t_one, t_one @ t_y, t_y @ t_y
    uv, vv, vz = t_x @ t_one, (t_x * t_x).sum(1), t_x @ t_y
    with np.errstate(all="ignore"):
        det = uu * vv - uv * uv
        b1, b0 = (uu * vz - uv * uz) / det, (vv * uz - uv * vz) / det
        s2 = np.maximum(zz - b0 * uz - b1 * vz, 0) / (n - 2)
        t2 = b1 * b1 / (s2 * uu / det)
        # what the intercept leaves, on the variant alone
        rest = zz - 2 * b0 * uz + b0 * b0 * uu
        cross = vz - b0 * uv
        adj = 1 - (rest - cross * cross / vv) / rest * n / (n - 1)
    return {"coef": b1, "sd_err": np.sqrt(s2), "adj_r2": adj, "t2": t2, "ok": (det > 1e-10 * uu * vv) & (s2 > 0)}


def emmax(variants: DataFrame, y: np.ndarray, k: np.ndarray, fit: L.Fit | None = None, by: tuple[str, ...] = ("chr", "pos")) -> DataFrame:
    """Scan with variance components of the null model: one row (``by`` and the results)
    for each variant that varies.  One matrix product a batch, then three dot products a
    variant."""
    use, y, k = _aligned(y, k)
    k = rescale(k)
    fit = fit or L.reml(y, np.ones((len(y), 1)), k)
    t = L.decorrelation(k, fit.delta)
    held = variants.sparkSession.sparkContext.broadcast((use, t, t @ np.ones(len(y)), t @ y))

    def run(batches):
        use, t, t_one, t_y = held.value
        for batch in batches:
            g, varies, mafc = _batch(batch, use)
            r = transformed_ols(g @ t.T, t_one, t_y)
            keep = np.flatnonzero(varies & r["ok"])
            n = len(t_y)
            p = t_two_sided(np.sqrt(r["t2"][keep]), n - 2)
            yield pa.RecordBatch.from_arrays(
                [*(batch[c].take(pa.array(keep)) for c in by), pa.array(np.full(len(keep), n)), *(pa.array(r[c][keep]) for c in ("coef", "sd_err", "adj_r2", "t2")), pa.array(np.asarray(p, float)), pa.array(mafc[keep].astype(np.int64))],
                [*by, "n", "coef", "sd_err", "adj_r2", "t2", "pvalue", "mafc"],
            )

    rows = variants.select(*by, calls_of(variants))
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in variants.select(*by).schema)
    return rows.mapInArrow(run, f"{keys}, {_SCAN}")


def emmax_regions(variants: DataFrame, regions: DataFrame, y: np.ndarray, k: np.ndarray, threshold: float = 1.0) -> DataFrame:
    """The scan of variants within regions (region_id, chr, start, end) alone, those with a p
    of at most ``threshold`` over the number of all variants; a variant of several regions has
    a row in each."""
    limit = variants.agg((F.lit(threshold) / F.count("*")).alias("_limit"))
    # each variant is scanned once, whatever the number of its regions; regions meet thin results
    inside = in_regions(variants.select("chr", "pos"), regions).select("region_id", "chr", "pos")
    found = emmax(variants.join(inside.select("chr", "pos").distinct(), ["chr", "pos"], "left_semi"), y, k)
    found = found.join(F.broadcast(limit)).where("pvalue <= _limit").drop("_limit")  # one row
    return inside.join(found, ["chr", "pos"]).select("region_id", *found.columns)


def burden_arrays(variants: DataFrame, regions: DataFrame, n: int, rare: float, carrier: float = 2.0) -> DataFrame:
    """region_id, chr, start, g: for each region that holds a variant, ``carrier`` for samples that
    carry the minor code of one of its rare variants, else 0.

    Rare: fewer than int(2 n rare) minor alleles, counted as ``variants.test_minor_counts``
    does.  The minor code of two is that of the smaller class (the lower of equal ones); of
    three, 0 or else 1.  Partial maxima are combined before the shuffle: a row a region and
    sample and task."""
    code = F.transform("g", lambda x: F.floor(x + 0.5).cast("int"))
    rows = in_regions(variants.withColumn("_c", code), regions)
    sized = lambda v: F.size(F.filter("_c", lambda x: x == v))
    known = F.size(F.filter("_c", lambda x: x.isNotNull()))
    minor = rare_code(*map(sized, range(3)), known, F.lit(int(rare * n * 2)))
    cells = rows.select("region_id", "chr", "start", minor.alias("_m"), "_c").select("region_id", "chr", "start", "_m", F.posexplode("_c").alias("_i", "_x"))
    most = cells.groupBy("region_id", "chr", "start", "_i").agg(F.max(F.when(F.col("_x") == F.col("_m"), carrier).otherwise(0.0)).alias("_b"))
    return most.groupBy("region_id", "chr", "start").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_b"))), lambda s: s["_b"]).alias("g"))


def burden_emmax(variants: DataFrame, regions: DataFrame, y: np.ndarray, k: np.ndarray, rare: float) -> DataFrame:
    """The mixed scan of regions' burdens: region_id, chr, start and the results."""
    rows = burden_arrays(variants, regions, int((~np.isnan(y)).sum()), rare)
    return emmax(rows, y, k, by=("region_id", "chr", "start"))


def fastlmm(variants: DataFrame, y: np.ndarray, k: np.ndarray, restricted: bool = False) -> DataFrame:
    """Scan that fits delta anew for each variant: chr, pos, coef, delta, loglik, r2 (coef squared
    times the variant's variance over the trait's), pvalue.

    p is of the likelihood ratio against the null model.  ``restricted``: delta and loglik are
    of the restricted likelihood, and p is of the coefficient's t with n - 2 degrees of
    freedom, as restricted likelihoods of different fixed effects do not compare."""
    use, y, k = _aligned(y, k)
    values, vectors = L.descending(rescale(k))
    values = np.maximum(values, 0)
    one = vectors.T @ np.ones(len(y))
    u_y = vectors.T @ y
    null = L.ml(u_y, one[:, None], values).loglik
    held = variants.sparkSession.sparkContext.broadcast((use, vectors, values, one, u_y, null, y.var()))

    def run(batches):
        use, vectors, values, one, u_y, null, spread = held.value
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                own = batch.slice(a, 512)
                g, varies, _ = _batch(own, use)
                keep = np.flatnonzero(varies)
                fit = L.scan_fits(u_y, one, g[keep] @ vectors, values, restricted=restricted)
                p = t_two_sided(np.sqrt(fit["t2"]), len(u_y) - 2) if restricted else chi2_sf(np.maximum(2 * (fit["loglik"] - null), 0), 1)
                r2 = fit["coef"] ** 2 * g[keep].var(1) / (spread or np.nan)
                yield pa.RecordBatch.from_arrays([own["chr"].take(pa.array(keep)), own["pos"].take(pa.array(keep)), *(pa.array(np.asarray(x, float)) for x in (fit["coef"], fit["delta"], fit["loglik"], r2, p))], ["chr", "pos", "coef", "delta", "loglik", "r2", "pvalue"])

    return variants.select("chr", "pos", calls_of(variants)).mapInArrow(run, "chr int, pos long, coef double, delta double, loglik double, r2 double, pvalue double")


def _by_trait(traits: DataFrame, fit, names: list[str]) -> DataFrame:
    """trait, n and the numbers that ``fit``(y, known ordinals) gives for each trait (trait, y
    array) of three known values or more."""
    schema = pa.schema([("trait", pa.string()), ("n", pa.int64()), *[(c, pa.float64()) for c in names]])

    def run(batches):
        for batch in batches:
            rows = []
            for name, values in zip(batch["trait"].to_pylist(), batch["y"].to_pylist(), strict=True):
                y = np.array([np.nan if v is None else v for v in values], float)
                use = np.flatnonzero(~np.isnan(y))
                if len(use) >= 3:
                    rows.append(dict(zip(schema.names, (name, len(use), *fit(y[use], use)), strict=True)))
            yield pa.RecordBatch.from_pylist(rows, schema)

    return traits.select("trait", "y").mapInArrow(run, "trait string, n long, " + ", ".join(f"{c} double" for c in names))


def heritability(traits: DataFrame, k: np.ndarray) -> DataFrame:
    """trait, n, delta, vg, ve, h2, loglik (maximum likelihood), information (observed, of h2),
    low and high (h2 +- 1.96 / sqrt(information), null where that is not positive).

    A task decomposes K again only where another set of samples is known.  A K of centred
    variants has no variance along the mean, where this likelihood is unbounded and h2 runs
    to 1: IBS has not that fault."""
    if len(k) > MOST_SAMPLES:
        raise ValueError(f"{len(k)} samples; dense matrices stop at {MOST_SAMPLES}")
    held, last = traits.sparkSession.sparkContext.broadcast(k), {}

    def fit(y, use):
        key = use.tobytes()
        if key not in last:
            last.clear()
            values, vectors = L.descending(rescale(held.value[np.ix_(use, use)]))
            last[key] = np.maximum(values, 0), vectors, vectors.T @ np.ones((len(use), 1))
        values, vectors, one = last[key]
        found = L.ml(vectors.T @ y, one, values)
        info = L.information(vectors.T @ y, one, values, found.h2)
        half = 1.96 / np.sqrt(info) if info > 0 else None
        return found.delta, found.vg, found.ve, found.h2, found.loglik, info, *((found.h2 - half, found.h2 + half) if half else (None, None))

    return _by_trait(traits, fit, ["delta", "vg", "ve", "h2", "loglik", "information", "low", "high"])


def heritability_low_rank(traits: DataFrame, terms: np.ndarray) -> DataFrame:
    """trait, n, delta, vg, ve, h2, loglik with K = terms terms' (a row a sample), never formed."""
    held = traits.sparkSession.sparkContext.broadcast(terms)

    def fit(y, use):
        found = L.low_rank_ml(y, np.ones((len(y), 1)), held.value[use])
        return found.delta, found.vg, found.ve, found.h2, found.loglik

    return _by_trait(traits, fit, ["delta", "vg", "ve", "h2", "loglik"])


def heritability_restricted(traits: DataFrame, k: np.ndarray) -> DataFrame:
    """trait, n, delta, vg, ve, h2, loglik by restricted likelihood; a task decomposes K again only
    where another set of samples is known."""
    if len(k) > MOST_SAMPLES:
        raise ValueError(f"{len(k)} samples; dense matrices stop at {MOST_SAMPLES}")
    held, last = traits.sparkSession.sparkContext.broadcast(k), {}

    def fit(y, use):
        key = use.tobytes()
        if key not in last:
            last.clear()
            last[key] = L.residual_spectrum(rescale(held.value[np.ix_(use, use)]), np.ones((len(use), 1)))
        found = L.reml_spectrum(y, *last[key])
        return found.delta, found.vg, found.ve, found.h2, found.loglik

    return _by_trait(traits, fit, ["delta", "vg", "ve", "h2", "loglik"])


def compare_kinships(traits: DataFrame, k1: np.ndarray, k2: np.ndarray, restricted: bool = False) -> DataFrame:
    """trait, n, and h2 and loglik under each of two kinships (h2_1, loglik_1, h2_2, loglik_2), by
    maximum or by restricted likelihood."""
    of = heritability_restricted if restricted else heritability
    one, two = (of(traits, k).select("trait", "n", F.col("h2").alias(f"h2_{i}"), F.col("loglik").alias(f"loglik_{i}")) for i, k in ((1, k1), (2, k2)))
    return one.join(two.drop("n"), "trait")


def kinship_weights(traits: DataFrame, k1: np.ndarray, k2: np.ndarray) -> DataFrame:
    """trait, n, alpha, h2, loglik, h2_1, h2_2 with the kinship alpha k1 + (1 - alpha) k2 of the
    best likelihood: a grid of tenths from 0 to 1, then the hundredths within 0.09 of the best;
    ties go to the smaller alpha.  h2_1 and h2_2 are those of each kinship alone.

    Traits are standardised and their means are centred in the likelihood.  A task takes a
    weight and up to some 500 traits with the same known samples, decomposes that mixture once
    and fits them all; the second grid is made of the weights that some trait needs.
    Kinships are dense."""
    if len(k1) > MOST_SAMPLES:
        raise ValueError(f"{len(k1)} samples; dense matrices stop at {MOST_SAMPLES}")
    held = traits.sparkSession.sparkContext.broadcast((k1, k2))
    known = F.transform("y", lambda x: x.isNotNull() & ~F.isnan(x))
    rows = traits.select("trait", F.transform("y", lambda x: x.cast("double")).alias("y"), F.sha2(F.array_join(known.cast("array<string>"), ""), 256).alias("set"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("trait"), F.lit(1 + traits.count() // 500)))
    schema = pa.schema([("trait", pa.string()), ("n", pa.int64()), ("percent", pa.int32()), ("h2", pa.float64()), ("loglik", pa.float64())])

    def fit(key, t):
        spectrum, out = None, []
        for name, values in zip(t["trait"].to_pylist(), t["y"].to_pylist(), strict=True):
            y = np.array([np.nan if v is None else v for v in values], float)
            use = np.flatnonzero(~np.isnan(y))
            own = y[use]
            if len(use) < 3 or not own.std() > 0:
                continue
            if spectrum is None:
                a, b = (k[np.ix_(use, use)] for k in held.value)
                alpha = key[0].as_py() / 100
                values, vectors = L.descending(rescale(alpha * a + (1 - alpha) * b))
                spectrum = vectors, vectors.T @ np.ones((len(use), 1)), np.maximum(values, 0)
            vectors, one, weights = spectrum
            found = L.ml(vectors.T @ ((own - own.mean()) / own.std(ddof=1)), one, weights)
            out.append({"trait": name, "n": len(use), "percent": key[0].as_py(), "h2": found.h2, "loglik": found.loglik})
        return pa.Table.from_pylist(out, schema)

    kind = "trait string, n long, percent int, h2 double, loglik double"
    best = F.max_by(F.struct("n", "percent", "h2", "loglik"), F.struct(F.round("loglik", 9), -F.col("percent"))).alias("b")

    def fitted(grid):
        return grid.groupBy("percent", "set", "part").applyInArrow(fit, kind)

    coarse = cut(fitted(rows.withColumn("percent", F.explode(F.sequence(F.lit(0), F.lit(100), F.lit(10))))))
    at = coarse.groupBy("trait").agg(best).select("trait", F.col("b.percent").alias("at"))
    near = F.explode(F.filter(F.sequence(F.col("at") - 9, F.col("at") + 9), lambda x: (x >= 0) & (x <= 100) & (x % 10 != 0)))
    fine = fitted(rows.join(at, "trait").withColumn("percent", near).drop("at"))
    alone = lambda p: F.max(F.when(F.col("percent") == p, F.col("h2")))
    found = coarse.unionByName(fine).groupBy("trait").agg(best, alone(100).alias("h2_1"), alone(0).alias("h2_2"))
    return found.select("trait", "b.n", (F.col("b.percent") / 100).alias("alpha"), "b.h2", "b.loglik", "h2_1", "h2_2")


def local_components(sites: DataFrame, y: np.ndarray, k: np.ndarray, by: list[str], least: int = 2, restricted: bool = False) -> DataFrame:
    """Variance that the variants of each window, region or compound explain beyond K.

    ``sites``: keys ``by`` and g.  The trait is first freed of K by the null model's
    transformation; a window's standardised variants then form a low-rank kinship.
    Returns by, n_variants, loglik, pvalue (half of a chi-square of one degree),
    v_local, v_global, v_error (shares).  Windows with fewer than ``least`` varying
    variants have no row.  A window is one group: its size is bounded by its width.

    ``restricted``: all by restricted likelihood (loglik is then of that kind); the transformed
    intercept is the covariate, and the transformed variants are freed of it and standardised.
    """
    use, y, k = _aligned(y, k)
    values, vectors = L.descending(rescale(k))
    one = np.ones((len(y), 1))
    null = L.reml(y, one, rescale(k)) if restricted else L.ml(vectors.T @ y, vectors.T @ one, np.maximum(values, 0))
    t = L.decorrelation(rescale(k), null.delta)
    t_y, t_one = t @ y, t @ one
    base = L.null_loglik(t_y, t_one)
    held = sites.sparkSession.sparkContext.broadcast((use, t, t_y, t_one, base, null.h2))
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    keys = [(f.name, kinds[f.dataType.simpleString()]) for f in sites.select(*by).schema]
    fields = [("n_variants", pa.int64()), *[(c, pa.float64()) for c in ("loglik", "pvalue", "v_local", "v_global", "v_error")]]
    schema = pa.schema([*keys, *fields])

    def run(key, rows):
        use, t, t_y, t_one, base, h2 = held.value
        g, varies, _ = _batch(rows, use)
        g = g[varies]
        if len(g) < least:
            return schema.empty_table()
        if restricted:
            x, c = g @ t.T, t_one[:, 0]
            x -= np.outer(x @ c / (c @ c), c)
            size = np.sqrt((x * x).sum(1, keepdims=True) / (len(t_y) - 1))
            fit, base = L.reml_low_rank(t_y, (x / size / np.sqrt(len(g))).T, c)
        else:
            z = (g - g.mean(1, keepdims=True)) / g.std(1, keepdims=True) / np.sqrt(len(g))
            fit = L.low_rank_ml(t_y, t_one, t @ z.T)
        p = float(chi2_sf(max(0.0, 2 * (fit.loglik - base)), 1)) / 2
        rest = 1 - fit.h2
        row = {**{f: k.as_py() for (f, _), k in zip(keys, key, strict=True)}, "n_variants": len(g), "loglik": fit.loglik, "pvalue": p, "v_local": fit.h2, "v_global": rest * h2, "v_error": rest * (1 - h2)}
        return pa.Table.from_pylist([row], schema)

    text = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sites.select(*by).schema)
    out = f"{text}, n_variants long, loglik double, pvalue double, v_local double, v_global double, v_error double"
    return sites.select(*by, "g").groupBy(*by).applyInArrow(run, out)


def blup(k: np.ndarray, y: np.ndarray, h2: float, relation: np.ndarray | None = None) -> np.ndarray:
    """Predicted genetic values h2 R (h2 K + (1 - h2) I)^-1 (y - mean), plus the mean."""
    known = ~np.isnan(y)
    mean = y[known].mean()
    kk = k[np.ix_(known, known)]
    r = (k if relation is None else relation)[:, known]
    return mean + h2 * r @ np.linalg.solve(h2 * kk + (1 - h2) * np.eye(known.sum()), y[known] - mean)


def leave_one_out(spark, k: np.ndarray, y: np.ndarray, h2: float) -> DataFrame:
    """ordinal, observed, predicted, each predicted without itself, spread over tasks.

    One inverse serves all: leaving out i, the prediction is y_i - (V^-1 y)_i / (V^-1)_ii."""
    use = np.flatnonzero(~np.isnan(y))
    own = y[use] - y[use].mean()
    inverse = np.linalg.inv(h2 * k[np.ix_(use, use)] + (1 - h2) * np.eye(len(use)))
    predicted = y[use] - (inverse @ own) / np.diag(inverse)
    return spark.createDataFrame([(int(i), float(a), float(b)) for i, a, b in zip(use, y[use], predicted, strict=True)], "ordinal long, observed double, predicted double")


def trait_array(traits: DataFrame, n: int) -> np.ndarray:
    """Trait of (ordinal, y) rows as an array; the sample axis is small by design."""
    if n > MOST_SAMPLES:
        raise ValueError(f"{n} samples; dense arrays stop at {MOST_SAMPLES}")
    out = np.full(n, np.nan)
    for r in traits.where(F.col("y").isNotNull()).collect():
        out[r["ordinal"]] = r["y"]
    return out


def chosen_variants(variants: DataFrame, sites: list[tuple[int, int]], use: np.ndarray) -> np.ndarray:
    """Genotypes of a few sites (at most 64), rows in their order, missing calls at the mean."""
    if len(sites) > 64:
        raise ValueError("more sites than a joint model should have")
    at = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(p).cast("long").alias("p")) for c, p in sites])
    rows = variants.where(F.array_contains(at, F.struct(F.col("chr").alias("c"), F.col("pos").cast("long").alias("p")))).select("chr", "pos", "g").collect()
    found = {(r["chr"], r["pos"]): np.array([np.nan if v is None else v for v in r["g"]], float)[use] for r in rows}
    missing = [s for s in sites if s not in found]
    if missing:
        raise ValueError(f"no variant at {missing[0]}")
    g = np.array([found[s] for s in sites])
    mean = np.nanmean(g, axis=1, keepdims=True)
    return np.where(np.isnan(g), mean, g)


def joint_model(variants: DataFrame, y: np.ndarray, k: np.ndarray, sites: list[tuple[int, int]]) -> dict:
    """Joint fixed effects of a few variants under the null model's transformation: coef, se,
    p in order of the intercept and the sites, sd_err, adj_r2."""
    from .lm import least_squares

    use, y, k = _aligned(y, k)
    k = rescale(k)
    fit = L.reml(y, np.ones((len(y), 1)), k)
    t = L.decorrelation(k, fit.delta)
    x = np.column_stack([t @ np.ones(len(y)), t @ chosen_variants(variants, sites, use).T])
    b, se, sd, adj = least_squares(x, t @ y)
    return {"n": len(y), "coef": b, "se": se, "p": t_two_sided(b / np.where(se > 0, se, np.nan), max(1, len(y) - x.shape[1])), "sd_err": sd, "adj_r2": adj}


def forward_mixed(variants: DataFrame, y: np.ndarray, k: np.ndarray, rounds: int, p_limit: float = 1.0) -> DataFrame:
    """Forward selection under the mixed model: round, chr, pos, adj_r2.

    Each round is one pass: tasks return the variant that, with those chosen before,
    explains most; only one row a task comes back."""
    use, y, k = _aligned(y, k)
    k = rescale(k)
    t = L.decorrelation(k, L.reml(y, np.ones((len(y), 1)), k).delta)
    spark, design, out = variants.sparkSession, [t @ np.ones(len(y))], []
    t_y, n = t @ y, len(y)
    schema = "chr int, pos long, adj_r2 double, p double, x array<double>"

    for r in range(1, rounds + 1):
        q, _ = np.linalg.qr(np.column_stack(design))
        held = spark.sparkContext.broadcast((use, t, t_y - q @ (q.T @ t_y), q))
        total = float(((t_y - design[0] * (design[0] @ t_y) / (design[0] @ design[0])) ** 2).sum())
        df = n - len(design) - 1

        def run(batches, held=held, total=total, df=df):
            use, t, rest, q = held.value
            best = None
            for batch in batches:
                g, varies, _ = _batch(batch, use)
                x = g @ t.T
                free = x - (x @ q) @ q.T
                size = (free * free).sum(1)
                ok = varies & (size > 1e-9 * (x * x).sum(1))
                gain = np.where(ok, (free @ rest) ** 2 / np.where(ok, size, 1), -1)
                if not len(gain) or gain.max() < 0:
                    continue
                # equal gains, within a task as across tasks, go to the first position
                top = np.flatnonzero(gain == gain.max())
                i = min(top.tolist(), key=lambda i: (batch["chr"][i].as_py(), batch["pos"][i].as_py()))
                if best is None or gain[i] > best[0] or (gain[i] == best[0] and (batch["chr"][i].as_py(), batch["pos"][i].as_py()) < best[1:3]):
                    rss = max(float(rest @ rest) - gain[i], 1e-300)
                    best = (gain[i], batch["chr"][i].as_py(), batch["pos"][i].as_py(), 1 - rss / total * (n - 1) / df, float(t_two_sided(np.sqrt(gain[i] / (rss / df)), df)), x[i].tolist())
            if best:
                yield pa.RecordBatch.from_pylist([dict(zip(("chr", "pos", "adj_r2", "p", "x"), best[1:], strict=True))], pa.schema([("chr", pa.int32()), ("pos", pa.int64()), ("adj_r2", pa.float64()), ("p", pa.float64()), ("x", pa.list_(pa.float64()))]))

        top = variants.select("chr", "pos", "g").mapInArrow(run, schema).orderBy(F.desc("adj_r2"), "chr", "pos").first()
        if top is None or top["p"] > p_limit:
            break
        out.append((r, top["chr"], top["pos"], top["adj_r2"]))
        design.append(np.array(top["x"]))
    return spark.createDataFrame(out, "round int, chr int, pos long, adj_r2 double")


def _forward_steps(x: np.ndarray, order: np.ndarray, t_one: np.ndarray, t_y: np.ndarray, rounds: int):
    """Steps of forward selection among rows of x (transformed variants): index, adj_r2, p.

    What is chosen is projected out of all candidates and of the trait, so a round is one
    product; ``order`` ranks candidates of equal gain (the smallest first)."""
    n = len(t_y)
    base = t_one / np.sqrt(t_one @ t_one)
    free, rest = x - np.outer(x @ base, base), t_y - base * (base @ t_y)
    size0, total, chosen = (x * x).sum(1), float(rest @ rest), np.zeros(len(x), bool)
    for r in range(1, rounds + 1):
        df = n - r - 1
        size = (free * free).sum(1)
        ok = ~chosen & (size > 1e-9 * size0)
        if df < 1 or not ok.any() or not total > 0:
            return
        gain = np.where(ok, (free @ rest) ** 2 / np.where(ok, size, 1), -1.0)
        ties = np.flatnonzero(gain >= gain.max() - 1e-10 * total)
        i = int(ties[np.argmin(order[ties])])
        rss = max(float(rest @ rest) - gain[i], 1e-300)
        yield i, 1 - rss / total * (n - 1) / df, float(t_two_sided(np.sqrt(gain[i] / (rss / df)), df))
        q = free[i] / np.sqrt(size[i])
        chosen[i] = True
        free, rest = free - np.outer(free @ q, q), rest - q * (q @ rest)


def forward_regions(variants: DataFrame, regions: DataFrame, y: np.ndarray, k: np.ndarray, rounds: int, p_limit: float = 1.0) -> DataFrame:
    """Forward selection under the mixed model within every region (region_id, chr, start, end) at
    once: region_id, round, chr, pos, adj_r2, pvalue (of the step's variant among those chosen).

    Variants are transformed where they lie, each once, whatever the number of its regions; a
    region then is one group, bounded by its width, that keeps its candidates freed of those
    chosen, so all rounds of all regions are one pass and no round returns to the driver.  Of
    variants that explain the same (to 1e-10 of the trait), the one first by chr and pos is
    taken.  A region stops before ``rounds`` where nothing is left to add or a step's p is
    above ``p_limit``; one without a varying variant has no row."""
    use, y, k = _aligned(y, k)
    k = rescale(k)
    t = L.decorrelation(k, L.reml(y, np.ones((len(y), 1)), k).delta)
    held = variants.sparkSession.sparkContext.broadcast((use, t, t @ np.ones(len(y)), t @ y))

    def transform(batches):
        use, t, _, _ = held.value
        for batch in batches:
            g, varies, _ = _batch(batch, use)
            keep = pa.array(np.flatnonzero(varies))
            yield pa.RecordBatch.from_arrays([batch["chr"].take(keep), batch["pos"].take(keep), _lists(g[varies] @ t.T)], ["chr", "pos", "x"])

    schema = pa.schema([("region_id", pa.string()), ("round", pa.int32()), ("chr", pa.int32()), ("pos", pa.int64()), ("adj_r2", pa.float64()), ("pvalue", pa.float64())])

    def run(key, rows):
        _, _, t_one, t_y = held.value
        at, where = rows["chr"].to_numpy(), rows["pos"].to_numpy()
        x = rows["x"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
        order = np.empty(len(at), np.int64)
        order[np.lexsort((where, at))] = np.arange(len(at))
        out = []
        for r, (i, adj, p) in enumerate(_forward_steps(x, order, t_one, t_y, rounds), 1):
            if p > p_limit:
                break
            out.append({"region_id": key[0].as_py(), "round": r, "chr": int(at[i]), "pos": int(where[i]), "adj_r2": adj, "pvalue": p})
        return pa.Table.from_pylist(out, schema)

    # only variants of some region are transformed, and once each
    inside = in_regions(variants.select("chr", "pos"), regions).select("region_id", "chr", "pos")
    sites = inside.select("chr", "pos").distinct()
    moved = variants.select("chr", "pos", "g").join(sites, ["chr", "pos"], "left_semi").mapInArrow(transform, "chr int, pos long, x array<double>")
    rows = inside.withColumn("region_id", F.col("region_id").cast("string")).join(moved, ["chr", "pos"])
    return rows.groupBy("region_id").applyInArrow(run, "region_id string, round int, chr int, pos long, adj_r2 double, pvalue double")


def marker_terms(variants: DataFrame, sites: list[tuple[int, int]], n: int) -> np.ndarray:
    """Terms (a row a sample) of the kinship of a few variants (at most 64), standardised; those that
    do not vary count for nothing.  No matrix between samples is formed."""
    g = chosen_variants(variants, sites, np.arange(n))
    sd = g.std(1, keepdims=True)
    return ((g - g.mean(1, keepdims=True)) / np.where(sd > 0, sd, 1)).T / np.sqrt(max(1, int((sd > 0).sum())))


def low_rank_scan(variants: DataFrame, y: np.ndarray, terms: np.ndarray) -> DataFrame:
    """Scan with K = terms terms' of low rank: delta is fitted anew for each variant, and the
    likelihood compared with the null model's: chr, pos, coef, delta, loglik, pvalue.

    Variants are turned into the terms' space by blocks; what lies outside enters by sums."""
    use = np.flatnonzero(~np.isnan(y))
    y, terms = y[use], terms[use]
    u, values = L.low_rank_basis(terms)
    null = L.low_rank_ml(y, np.ones((len(y), 1)), basis=(u, values)).loglik
    held = variants.sparkSession.sparkContext.broadcast((use, u, values, y, null))

    def run(batches):
        use, u, values, y, null = held.value
        u_one, u_y = u.sum(0), u.T @ y
        known = {"n": len(y), "oo": len(y) - u_one @ u_one, "oy": y.sum() - u_one @ u_y, "yy": y @ y - u_y @ u_y}
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                own = batch.slice(a, 512)
                g, varies, _ = _batch(own, use)
                keep = np.flatnonzero(varies)
                x = g[keep] - g[keep].mean(1, keepdims=True)  # the intercept takes the mean; differences keep their digits
                u_x = x @ u
                fit = L.scan_fits(u_y, u_one, u_x, values, known | {"xx": (x * x).sum(1) - (u_x * u_x).sum(1), "x1": x.sum(1) - u_x @ u_one, "xy": x @ y - u_x @ u_y})
                p = np.asarray(chi2_sf(np.maximum(2 * (fit["loglik"] - null), 0), 1), float)
                yield pa.RecordBatch.from_arrays([own["chr"].take(pa.array(keep)), own["pos"].take(pa.array(keep)), *(pa.array(v.copy()) for v in (fit["coef"], fit["delta"], fit["loglik"], p))], ["chr", "pos", "coef", "delta", "loglik", "pvalue"])

    return variants.select("chr", "pos", calls_of(variants)).mapInArrow(run, "chr int, pos long, coef double, delta double, loglik double, pvalue double")


def local_grid(sites: DataFrame, y: np.ndarray, k: np.ndarray, by: list[str], step: float = 0.1) -> DataFrame:
    """loglik and h2 of each window for each weight alpha of its own kinship beside K: by,
    alpha, loglik, h2.  A grid of tenths, then hundredths around the best."""
    use, y, k = _aligned(y, k)
    held = sites.sparkSession.sparkContext.broadcast((use, y, rescale(k)))
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    keys = [(f.name, kinds[f.dataType.simpleString()]) for f in sites.select(*by).schema]
    schema = pa.schema([*keys, ("alpha", pa.float64()), ("loglik", pa.float64()), ("h2", pa.float64())])

    def run(key, rows):
        use, y, k = held.value
        g, varies, _ = _batch(rows, use)
        g = g[varies]
        if len(g) < 2:
            return schema.empty_table()
        z = (g - g.mean(1, keepdims=True)) / g.std(1, keepdims=True)
        own = rescale(z.T @ z / len(z))
        one = np.ones((len(y), 1))

        def at(alpha):
            values, vectors = L.descending(alpha * own + (1 - alpha) * k)
            return L.ml(vectors.T @ y, vectors.T @ one, np.maximum(values, 0))

        fits = {round(a, 4): at(a) for a in np.arange(0, 1 + step / 2, step)}
        best = max(fits, key=lambda a: fits[a].loglik)
        for i in range(-5, 6):
            a = round(best + i * step / 10, 4)
            if 0 <= a <= 1 and a not in fits:
                fits[a] = at(a)
        name = {f: v.as_py() for (f, _), v in zip(keys, key, strict=True)}
        return pa.Table.from_pylist([{**name, "alpha": a, "loglik": f.loglik, "h2": f.h2} for a, f in sorted(fits.items())], schema)

    text = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sites.select(*by).schema)
    return sites.select(*by, "g").groupBy(*by).applyInArrow(run, f"{text}, alpha double, loglik double, h2 double")


def combined_blup(k: np.ndarray, local: list[np.ndarray], shares: list[float], y: np.ndarray, h2: float) -> dict[str, np.ndarray]:
    """Predictions from the global kinship, each local one, their sum, one weighted kinship,
    and a regression of the trait on all predictions (fitted on the known samples)."""
    known = ~np.isnan(y)
    whole = blup(k, y, h2)
    parts = [blup(m, y, s) for m, s in zip(local, shares, strict=True)]
    rest = max(0.0, 1 - sum(shares))
    mixed = rest * k + sum(s * m for s, m in zip(shares, local, strict=True))
    x = np.column_stack([np.ones(len(y)), whole, *parts])
    b, *_ = np.linalg.lstsq(x[known], y[known], rcond=None)
    return {"global": whole, "sum": whole + sum(p - y[known].mean() for p in parts), "weighted": blup(mixed, y, h2), "regression": x @ b}


def predict_by_markers(variants: DataFrame, y: np.ndarray, sites: list[tuple[int, int]], seed: int = 3, test_share: float = 0.3) -> dict:
    """Multiple regression on chosen variants, fitted on a hashed part of the samples;
    predictions and their correlation with the trait on the rest."""
    use = np.flatnonzero(~np.isnan(y))
    g = chosen_variants(variants, sites, use)
    test = np.random.default_rng(seed).random(len(use)) < test_share
    x = np.column_stack([np.ones(len(use)), g.T])
    b, *_ = np.linalg.lstsq(x[~test], y[use][~test], rcond=None)
    predicted = x[test] @ b
    r = float(np.corrcoef(predicted, y[use][test])[0, 1]) if test.sum() > 2 else float("nan")
    return {"ordinal": use[test], "predicted": predicted, "r": r}


def permutation_p_mixed(variants: DataFrame, y: np.ndarray, k: np.ndarray, rounds: int, seed: int = 1) -> DataFrame:
    """chr, pos, p: share of permuted (transformed) traits with a t2 at least the observed
    one.  All rounds of a batch are one matrix product."""
    use, y, k = _aligned(y, k)
    k = rescale(k)
    t = L.decorrelation(k, L.reml(y, np.ones((len(y), 1)), k).delta)
    t_one, t_y = t @ np.ones(len(y)), t @ y
    rest = t_y - t_one * (t_one @ t_y) / (t_one @ t_one)
    rng = np.random.default_rng(seed)
    shuffled = np.stack([rest, *(rng.permutation(rest) for _ in range(rounds))])
    held = variants.sparkSession.sparkContext.broadcast((use, t, t_one, shuffled))

    def run(batches):
        use, t, t_one, traits = held.value
        base = t_one / np.sqrt(t_one @ t_one)
        traits = traits - np.outer(traits @ base, base)
        for batch in batches:
            g, varies, _ = _batch(batch, use)
            x = g @ t.T
            x = x - np.outer(x @ base, base)
            size = (x * x).sum(1)
            keep = np.flatnonzero(varies & (size > 1e-12))
            r2 = (x[keep] @ traits.T) ** 2 / size[keep, None] / (traits * traits).sum(1)
            p = (r2[:, 1:] >= r2[:, :1]).mean(1)
            yield pa.RecordBatch.from_arrays([batch["chr"].take(pa.array(keep)), batch["pos"].take(pa.array(keep)), pa.array(p)], ["chr", "pos", "p"])

    return variants.select("chr", "pos", "g").mapInArrow(run, "chr int, pos long, p double")
