"""Command line: ``spark-submit`` or ``python -m genoflux COMMAND ...``.

import     genotype CSV to a variant store
kinship    IBS or RRM matrix of a store, rescaled, to a matrix file
lm         linear scan of each trait
emmax      mixed-model scan of each trait
fastlmm    scan with a refitted variance ratio
heritability   of each trait
local      variance components of half-overlapping windows
genes      kernel test of all gene models
regions    mixed-model scan within the regions of a file
burden     mixed-model scan of the burdens of rare variants of such regions
stepwise   forward selection under the mixed model
families   forward selection by linear models, with family means taken off the trait
compounds  variance components of the compounds of a file
permutation   p of each variant by permuted traits under the mixed model
peaks      peaks of a scan's results, and the RRM matrix of the region behind each
slices     plink text of all gene models, with a manifest
"""

from __future__ import annotations

import argparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import joins, kernel_test, kinship, lm, mixed, variants
from .sources import genotypes, models, tables


def _traits(spark, args, samples: DataFrame):
    """Name and array of each trait that enough samples have, in order of the store."""
    found = tables.complete(tables.read_phenotypes(spark, args.phenotypes), args.min_samples).join(samples, "sample_id")
    n = samples.count()
    for name in [r["phe_id"] for r in found.select("phe_id").distinct().orderBy("phe_id").collect()]:
        yield name, mixed.trait_array(found.where(F.col("phe_id") == name).select("ordinal", F.col("value").alias("y")), n)


def _matrix(spark, path: str, samples: DataFrame) -> np.ndarray:
    """A matrix file in the store's order of samples."""
    n = samples.count()
    i = samples.select(F.col("sample_id").alias("i"), F.col("ordinal").alias("a"))
    j = samples.select(F.col("sample_id").alias("j"), F.col("ordinal").alias("b"))
    rows = tables.read_kinship(spark, path).join(i, "i").join(j, "j").groupBy("a").agg(F.collect_list("b").alias("b"), F.collect_list(F.struct("b", "k")).alias("x"))
    rows = rows.select("a", F.transform("x", lambda s: s["b"]).alias("b"), F.transform("x", lambda s: s["k"]).alias("k"))
    out = np.full((n, n), np.nan)
    if n > kinship.MOST_SAMPLES:
        raise ValueError(f"{n} samples; dense matrices stop at {kinship.MOST_SAMPLES}")
    for r in rows.toLocalIterator():  # a row a sample
        out[r["a"], r["b"]] = [np.nan if x is None else x for x in r["k"]]
    if np.isnan(out).any():
        raise ValueError("the matrix lacks samples of the store")
    return out


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.command == "import":
        own, names = genotypes.read_csv(spark, args.genotypes)
        return genotypes.write_store(own, names, args.out)
    v, samples = genotypes.read_store(spark, args.store)
    if args.command == "kinship":
        dense = kinship.tile_cells(kinship.rescaled_tiles(kinship.gram_tiles(v, args.kind)))
        a, b = samples.select(F.col("ordinal").alias("i"), F.col("sample_id").alias("x")), samples.select(F.col("ordinal").alias("j"), F.col("sample_id").alias("y"))
        return tables.write_kinship(dense.join(a, "i").join(b, "j").select(F.col("x").alias("i"), F.col("y").alias("j"), "k"), args.out)
    if "packed" in v.columns and args.command in ("peaks", "slices"):
        v = genotypes.unpack(v, samples.count())
    if args.command == "peaks":
        found = joins.peak_regions(joins.peaks(tables.read_results(spark, args.results, args.p), args.peak), args.width)
        found.orderBy("chr", "start").write.csv(f"{args.out}/peaks", header=True)
        cells = kinship.tile_cells(kinship.regional_tiles(v, found), ("region_id",))
        return cells.orderBy("region_id", "i", "j").write.csv(f"{args.out}/kinships", header=True)
    if args.command == "slices":
        own = models.read_models(spark, args.models).withColumn("chr", F.regexp_replace("chr", "^chr", "").try_cast("int"))
        genotypes.write_tfam(samples, f"{args.out}/tfam")
        genotypes.write_slices(v, own, args.out)
        return None
    k = _matrix(spark, args.kinship, samples) if getattr(args, "kinship", None) else None
    for name, y in _traits(spark, args, samples):
        out = f"{args.out}/{name}"
        if args.command == "lm":
            trait = spark.createDataFrame([(i, float(t)) for i, t in enumerate(y) if not np.isnan(t)], "ordinal int, y double")
            calls = v.select("chr", "pos", F.posexplode("g").alias("ordinal", "dosage")).where("dosage is not null")
            found = lm.with_p(lm.scan(calls.join(F.broadcast(trait), "ordinal")))  # the sample axis
            found = found.join(variants.import_minor_counts(calls), ["chr", "pos"])
            tables.write_results(lm.bonferroni(found, args.p), out, int((~np.isnan(y)).sum()))
        elif args.command == "emmax":
            found = mixed.emmax(v, y, k).persist()  # counted, then filtered
            tables.write_results(lm.bonferroni(found, args.p), out, int((~np.isnan(y)).sum()))
            found.unpersist()
        elif args.command == "fastlmm":
            found = mixed.fastlmm(v, y, k, args.reml).persist()
            lm.bonferroni(found, args.p).orderBy("chr", "pos").write.csv(out, header=True)
            found.unpersist()
        elif args.command == "heritability":
            trait = spark.createDataFrame([(name, [None if np.isnan(t) else float(t) for t in y])], "trait string, y array<double>")
            mixed.heritability(trait, k).write.csv(out, header=True)
        elif args.command == "local":
            mixed.local_components(variants.in_tiling_windows(v, args.width), y, k, ["chr", "start"]).orderBy("chr", "start").write.csv(out, header=True)
        elif args.command == "regions":
            mixed.emmax_regions(v, tables.read_regions(spark, args.regions), y, k, args.p).orderBy("region_id", "chr", "pos").write.csv(out, header=True)
        elif args.command == "burden":
            mixed.burden_emmax(v, tables.read_regions(spark, args.regions), y, k, args.rare).orderBy("chr", "start", "region_id").write.csv(out, header=True)
        elif args.command == "stepwise":
            mixed.forward_mixed(v, y, k, args.rounds, args.p).orderBy("round").write.csv(out, header=True)
        elif args.command == "compounds":
            own = joins.in_compounds(v, tables.read_compounds(spark, args.compounds))
            mixed.local_components(own, y, k, ["compound_id"]).orderBy("compound_id").write.csv(out, header=True)
        elif args.command == "permutation":
            mixed.permutation_p_mixed(v, y, k, args.rounds).orderBy("chr", "pos").write.csv(out, header=True)
        elif args.command == "families":
            trait = samples.join(spark.createDataFrame([(i, float(t)) for i, t in enumerate(y) if not np.isnan(t)], "ordinal int, y double"), "ordinal")
            calls = v.select("chr", "pos", F.posexplode("g").alias("ordinal", "dosage")).where("dosage is not null")
            own = trait.select(F.col("ordinal").alias("sample_id"), F.col("sample_id").alias("name"), "y")
            found = lm.forward_families(calls.withColumnRenamed("ordinal", "sample_id"), own, args.rounds, "name", args.separator, args.p, args.maf)
            found.orderBy("round").write.csv(out, header=True)
        elif args.command == "genes":
            sites = models.read_models(spark, args.models).withColumn("chr", F.regexp_replace("chr", "^chr", "").try_cast("int"))
            kernel_test.gene_p(v.join(sites.select("gene", "chr", "pos", "weight"), ["chr", "pos"]), y).orderBy("pvalue").write.csv(out, header=True)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="genoflux", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("import", "kinship", "lm", "emmax", "fastlmm", "heritability", "local", "genes", "regions", "burden", "stepwise", "families", "compounds", "permutation", "peaks", "slices"):
        p = commands.add_parser(name)
        p.add_argument("--out", required=True, help="a new folder")
        if name == "import":
            p.add_argument("--genotypes", required=True)
            continue
        p.add_argument("--store", required=True)
        if name == "kinship":
            p.add_argument("--kind", choices=("ibs", "rrm"), default="rrm")
            continue
        if name == "peaks":
            p.add_argument("--results", required=True, help="of a scan")
            p.add_argument("--p", type=float, required=True, help="a hit if p < this")
            p.add_argument("--peak", type=int, required=True, help="hits nearer than this share a peak")
            p.add_argument("--width", type=int, required=True, help="of the region behind a peak")
            continue
        if name == "slices":
            p.add_argument("--models", required=True)
            continue
        p.add_argument("--phenotypes", required=True)
        p.add_argument("--min-samples", type=int, default=100)
        if name not in ("lm", "genes", "families"):
            p.add_argument("--kinship", required=True)
        if name in ("regions", "burden"):
            p.add_argument("--regions", required=True)
        if name == "burden":
            p.add_argument("--rare", type=float, required=True, help="largest minor frequency of a rare variant")
        if name in ("stepwise", "families", "permutation"):
            p.add_argument("--rounds", type=int, default=1000 if name == "permutation" else 5)
        if name == "fastlmm":
            p.add_argument("--reml", action="store_true", help="restricted likelihood")
        if name == "compounds":
            p.add_argument("--compounds", required=True)
        if name == "families":
            p.add_argument("--separator", default="_", help="a family is what stands before it in a sample's name")
            p.add_argument("--p", type=float, default=1000.0, help="a variant may enter if p <= this / number of variants")
            p.add_argument("--maf", type=float, default=0.0)
        if name == "stepwise":
            p.add_argument("--p", type=float, default=1.0, help="of a variant that may enter")
        if name in ("lm", "emmax", "fastlmm", "regions"):
            p.add_argument("--p", type=float, default=1000.0, help="kept if p <= this / number of variants")
        if name == "local":
            p.add_argument("--width", type=int, required=True)
        if name == "genes":
            p.add_argument("--models", required=True)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    run(SparkSession.builder.appName("genoflux").getOrCreate(), args)


if __name__ == "__main__":
    main()
