"""Inbred lines of crosses: gaps in marker codes, genotypes from founders; posterior of a
grid search; genome-wide axes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .simulate import uniform


def fill_gaps(codes: DataFrame, seed: int = 5) -> DataFrame:
    """``codes`` (line, chr, pos, code; null where unknown) with filled.

    Between equal flanks: that code; at an edge: the one flank; next to H: the nearer
    flank more likely, by distance; between A and B: H.  A chromosome without any code
    stays null."""
    order = Window.partitionBy("line", "chr").orderBy("pos")
    ahead = order.rowsBetween(Window.unboundedPreceding, 0)
    behind = order.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("code").isNotNull(), F.col("pos"))
    rows = codes.withColumns({"l": F.last("code", True).over(ahead), "lp": F.last(at, True).over(ahead), "r": F.first("code", True).over(behind), "rp": F.first(at, True).over(behind)})
    near = uniform(seed, "line", "chr", "pos") < (F.col("rp") - F.col("pos")) / (F.col("rp") - F.col("lp"))
    mixed = F.when((F.col("l") == "H") | (F.col("r") == "H"), F.when(near, F.col("l")).otherwise(F.col("r"))).otherwise("H")
    filled = F.when(F.col("l").isNull(), F.col("r")).when(F.col("r").isNull(), F.col("l")).when(F.col("l") == F.col("r"), F.col("l")).otherwise(mixed)
    return rows.withColumn("filled", F.coalesce("code", filled)).drop("l", "lp", "r", "rp")


def from_founders(points: DataFrame, codes: DataFrame, founders: DataFrame, seed: int = 6) -> DataFrame:
    """line, chr, pos, letter: genotype of each line (line, parent_a, parent_b in ``codes`` rows of
    line, chr, pos, code, parent_a, parent_b) at each of ``points``, from the founders
    (founder, chr, pos, base) by the codes of the flanking markers.

    Flanks that agree decide; else one of them, the nearer more likely.  H gives both bases."""
    from ..functions.alleles import to_iupac
    from .joins import flanking_markers

    flanks = flanking_markers(points, codes.select("chr", "pos").distinct())
    lines = codes.select("line", "parent_a", "parent_b").distinct()
    own = codes.select("line", "chr", "pos", "code")
    left = own.select("line", "chr", F.col("pos").alias("left_pos"), F.col("code").alias("l"))
    right = own.select("line", "chr", F.col("pos").alias("right_pos"), F.col("code").alias("r"))
    rows = flanks.join(lines.select("line", F.lit(1).alias("k")), F.lit(1) == F.col("k")).drop("k")
    rows = rows.join(left, ["line", "chr", "left_pos"], "left").join(right, ["line", "chr", "right_pos"], "left")
    near = uniform(seed, "line", "chr", "pos") < (F.col("right_pos") - F.col("pos")) / (F.col("right_pos") - F.col("left_pos"))
    code = F.when(F.col("l").isNull(), F.col("r")).when(F.col("r").isNull(), F.col("l")).when(F.col("l") == F.col("r"), F.col("l")).otherwise(F.when(near, F.col("l")).otherwise(F.col("r")))
    rows = rows.withColumn("code", code).join(lines, "line")
    base = lambda p, n: founders.select(F.col("founder").alias(p), "chr", "pos", F.col("base").alias(n))
    rows = rows.join(base("parent_a", "a"), ["parent_a", "chr", "pos"], "left").join(base("parent_b", "b"), ["parent_b", "chr", "pos"], "left")
    letter = F.when(F.col("code") == "A", to_iupac(F.col("a"), F.col("a"))).when(F.col("code") == "B", to_iupac(F.col("b"), F.col("b"))).when(F.col("code") == "H", to_iupac(F.col("a"), F.col("b")))
    return rows.select("line", "chr", "pos", letter.alias("letter"))


def posterior(cells: DataFrame, width: float) -> DataFrame:
    """region_id, bin, mass from (region_id, loglik, h2): likelihoods, relative to the region's
    best, summed in bins of h2 and divided by the region's sum."""
    best = cells.groupBy("region_id").agg(F.max("loglik").alias("_b"))
    own = cells.join(best, "region_id").withColumn("w", F.exp(F.col("loglik") - F.col("_b")))
    bins = own.groupBy("region_id", F.floor(F.col("h2") / width).alias("bin")).agg(F.sum("w").alias("w"))
    total = bins.groupBy("region_id").agg(F.sum("w").alias("_t"))
    return bins.join(total, "region_id").select("region_id", "bin", (F.col("w") / F.col("_t")).alias("mass"))


def offsets(points: DataFrame) -> DataFrame:
    """chr, offset: summed lengths (largest position) of the chromosomes before."""
    lengths = points.groupBy("chr").agg(F.max("pos").alias("len"))
    before = Window.partitionBy(F.lit(0)).orderBy("chr").rowsBetween(Window.unboundedPreceding, -1)  # a row a chromosome
    return lengths.select("chr", F.coalesce(F.sum("len").over(before), F.lit(0)).alias("offset"))


def manhattan(results: DataFrame, p: str = "pvalue") -> DataFrame:
    """chr, pos, x (position on a genome-wide axis), y (-log10 p; 300 for p of 0)."""
    rows = results.join(F.broadcast(offsets(results)), "chr")  # a row a chromosome
    return rows.select("chr", "pos", (F.col("pos") + F.col("offset")).alias("x"), F.when(F.col(p) <= 0, 300.0).otherwise(-F.log10(p)).alias("y"))
