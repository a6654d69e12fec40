"""Weighted kernel gene tests: Q = sum of w^2 S^2 over a gene's variants, S = g'(y - mean)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import mixture_sf
from .mixed import _batch


def score_q(rows: DataFrame) -> DataFrame:
    """gene, n_variants, q from rows of gene, weight, chr, pos, dosage (null: the variant's
    mean), y.  Sums alone: S = sum g (y - mean y) over known calls, as a missing call at
    the mean adds mean g times what the known ones lack."""
    mean = rows.groupBy("sample_id").agg(F.first("y").alias("y")).agg(F.avg("y").alias("m"))
    own = rows.join(F.broadcast(mean)).withColumn("e", F.col("y") - F.col("m"))  # one row
    per = own.groupBy("gene", "weight", "chr", "pos").agg(F.sum(F.col("dosage") * F.col("e")).alias("ge"), F.avg("dosage").alias("mg"), F.sum(F.when(F.col("dosage").isNull(), F.col("e"))).alias("me"))
    s = F.coalesce("ge", F.lit(0.0)) + F.coalesce(F.col("mg") * F.col("me"), F.lit(0.0))
    return per.groupBy("gene").agg(F.count("*").alias("n_variants"), F.sum(F.col("weight") ** 2 * s * s).alias("q"))


def gene_p(sites: DataFrame, y: np.ndarray, binary: bool = False) -> DataFrame:
    """gene, n_variants, q, pvalue from rows of gene, weight, g: Q against its mixture of
    chi-squares under a model with a mean only.  All genes at once, a gene a group."""
    use = np.flatnonzero(~np.isnan(y))
    own = y[use]
    mean = own.mean()
    v = mean * (1 - mean) if binary else own.var(ddof=1)
    held = sites.sparkSession.sparkContext.broadcast((use, own - mean, v))

    def run(rows: pa.Table) -> pa.Table:
        use, e, v = held.value
        rows = rows.combine_chunks()
        g, _, _ = _batch(rows, use)
        w = rows["weight"].to_numpy()
        q = float(((w * (g @ e)) ** 2).sum())
        z = (g - g.mean(1, keepdims=True)) * w[:, None]
        small = z @ z.T if len(z) <= z.shape[1] else z.T @ z
        lam = np.linalg.eigvalsh(small) * v
        return pa.table({"gene": pa.array([rows["gene"][0].as_py()]), "n_variants": pa.array([len(w)], pa.int64()), "q": pa.array([q]), "pvalue": pa.array([mixture_sf(q, lam[lam > 0]) if (lam > 0).any() else 1.0])})

    return sites.select("gene", "weight", "g").groupBy("gene").applyInArrow(run, "gene string, n_variants long, q double, pvalue double")


def with_default_weights(rows: DataFrame) -> DataFrame:
    """``rows`` with the weight that ``beta_weight`` gives each variant at its folded frequency
    among them (0 where no call is known)."""
    freq = F.avg("dosage") / 2
    maf = rows.select("chr", "pos", "sample_id", "dosage").distinct().groupBy("chr", "pos").agg(freq.alias("_f"))
    maf = maf.select("chr", "pos", F.coalesce(beta_weight(F.least("_f", 1 - F.col("_f"))), F.lit(0.0)).alias("weight"))
    return rows.drop("weight").join(maf, ["chr", "pos"])


def beta_weight(maf, a: float = 1.0, b: float = 25.0):
    """Default weight of an unweighted model: the beta(a, b) density at the frequency."""
    import math

    c = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    return F.lit(c) * F.pow(maf, a - 1) * F.pow(1 - maf, b - 1)
