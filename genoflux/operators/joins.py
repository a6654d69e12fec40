"""Joins on positions: regions, genes, flanking markers, nearby hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Default width of the bins over which intervals and positions meet.
BIN = 1 << 20


def in_regions(points: DataFrame, regions: DataFrame, width: int = BIN) -> DataFrame:
    """Each row of ``points`` (chr, pos) with each closed region (region_id, chr, start,
    end) that holds it.

    Both sides meet on chr and a bin of positions, an equi-join that Spark may
    broadcast or shuffle and split; a region is entered in each bin it touches."""
    own = regions.select("region_id", F.col("chr").alias("r_chr"), "start", "end", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("r_bin"))
    rows = points.withColumn("bin", F.floor(F.col("pos") / width))
    on = (F.col("chr") == F.col("r_chr")) & (F.col("bin") == F.col("r_bin")) & F.col("pos").between(F.col("start"), F.col("end"))
    return rows.join(own, on).drop("bin", "r_bin", "r_chr")


def in_compounds(points: DataFrame, compounds: DataFrame) -> DataFrame:
    """``points`` (chr, pos and others) with compound_id, once for each compound (compound_id, chr,
    start, end of its parts) that holds them, however many of its parts do.  Parts meet positions
    alone."""
    parts = compounds.select(F.col("compound_id").alias("region_id"), "chr", "start", "end")
    inside = in_regions(points.select("chr", "pos").distinct(), parts).select(F.col("region_id").alias("compound_id"), "chr", "pos").distinct()
    return inside.join(points, ["chr", "pos"])


def gene_of_points(points: DataFrame, genes: DataFrame, width: int = BIN) -> DataFrame:
    """Each distinct (chr, pos) in a gene with one gene: the last in order of ``ord`` wins."""
    rows = in_regions(points.select("chr", "pos").distinct(), genes.withColumnRenamed("gene", "region_id"), width)
    rows = rows.join(genes.select(F.col("gene").alias("region_id"), "ord"), "region_id")
    return rows.groupBy("chr", "pos").agg(F.max_by("region_id", "ord").alias("gene"))


def flanking_markers(points: DataFrame, markers: DataFrame, width: int = BIN) -> DataFrame:
    """chr, pos, left_pos (nearest marker before), right_pos (nearest at or behind).

    One sort within each bin of positions over both sides; what earlier and later bins
    hold comes from a table of a row a bin.  No range join."""
    both = points.select("chr", "pos").distinct().withColumn("marker", F.lit(None).cast("long")).withColumn("kind", F.lit(1))
    both = both.unionByName(markers.select("chr", "pos").distinct().withColumn("marker", F.col("pos")).withColumn("kind", F.lit(2)))
    both = both.withColumn("bin", F.floor(F.col("pos") / width))
    before, behind = (Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)
    bins = Window.partitionBy("chr").orderBy("bin")
    ends = both.groupBy("chr", "bin").agg(F.min("marker").alias("lo"), F.max("marker").alias("hi"))
    ends = ends.select("chr", "bin", F.max("hi").over(bins.rowsBetween(*before)).alias("from_left"), F.min("lo").over(bins.rowsBetween(*behind)).alias("from_right"))
    order = Window.partitionBy("chr", "bin").orderBy("pos", "kind")
    left, right = F.max("marker").over(order.rowsBetween(*before)), F.min("marker").over(order.rowsBetween(*behind))
    rows = both.select("chr", "pos", "bin", "kind", left.alias("left_pos"), right.alias("right_pos")).where("kind = 1").join(ends, ["chr", "bin"])
    return rows.select("chr", "pos", F.coalesce("left_pos", "from_left").alias("left_pos"), F.coalesce("right_pos", "from_right").alias("right_pos"))


def first_per_site(rows: DataFrame, order: str) -> DataFrame:
    """One row for each chr and pos: the first by ``order``."""
    names = [c for c in rows.columns if c not in ("chr", "pos")]
    best = rows.groupBy("chr", "pos").agg(F.min_by(F.struct(*names), order).alias("x"))
    return best.select("chr", "pos", "x.*")


def without_common(points: DataFrame, panel: DataFrame, least: int) -> DataFrame:
    """Rows whose (chr, pos) a reference panel does not have ``least`` times or more (column ac)."""
    return points.join(panel.where(F.col("ac") >= least).select("chr", "pos"), ["chr", "pos"], "left_anti")


def with_defaults(points: DataFrame, table: DataFrame) -> DataFrame:
    """Left join of rsid, ref, alt, weight with the defaults rs_<pos>, A, T, 0.0."""
    rows = points.join(table, ["chr", "pos"], "left")
    return rows.withColumns({"rsid": F.coalesce("rsid", F.concat(F.lit("rs_"), F.col("pos").cast("string"))), "ref": F.coalesce("ref", F.lit("A")), "alt": F.coalesce("alt", F.lit("T")), "weight": F.coalesce("weight", F.lit(0.0))})


def near_best_hits(hits: DataFrame, width: int) -> DataFrame:
    """chr, pos, pvalue of the hits left when each hit, best p first, removes all others of
    its chromosome nearer than ``width``.

    Order-dependent, so one task a chromosome; meant for hits below a threshold."""
    import numpy as np
    import pyarrow as pa

    def run(t: pa.Table) -> pa.Table:
        pos, p = t["pos"].to_numpy(), t["pvalue"].to_numpy()
        order, kept = np.lexsort((pos, p)), []
        taken = np.zeros(0, np.int64)
        for i in order.tolist():
            at = int(np.searchsorted(taken, pos[i]))
            near = [taken[j] for j in (at - 1, at) if 0 <= j < len(taken)]
            if all(abs(int(x) - int(pos[i])) >= width for x in near):
                taken = np.insert(taken, at, pos[i])
                kept.append(i)
        return t.select(["chr", "pos", "pvalue"]).take(pa.array(kept, pa.int64()))

    return hits.select("chr", "pos", "pvalue").groupBy("chr").applyInArrow(run, hits.select("chr", "pos", "pvalue").schema)


def peaks(hits: DataFrame, width: int) -> DataFrame:
    """chr, pos, pvalue of the peaks of ``hits``: taken in order of position, a hit nearer than
    ``width`` to the last peak of its chromosome joins it, and moves it to itself where its p is
    smaller; another begins a peak.  Of hits at one position the smallest p counts; a null p is
    no hit.

    A peak depends on those before it, so a chromosome is read in order by one task, which
    holds no more than the last peak of it; meant for hits below a threshold."""
    import pyarrow as pa

    def run(batches):
        last = None
        for batch in batches:
            done = []
            for hit in zip(*(batch[c].to_pylist() for c in ("chr", "pos", "pvalue")), strict=True):
                if last is None or hit[0] != last[0] or hit[1] - last[1] >= width:
                    done += [last] if last else []
                    last = hit
                elif hit[2] < last[2]:
                    last = hit
            if done:
                yield rows(done)
        if last:
            yield rows([last])

    def rows(found):
        chrs, at, p = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(chrs, pa.int32()), pa.array(at, pa.int64()), pa.array(p, pa.float64())], ["chr", "pos", "pvalue"])

    own = hits.where("pvalue is not null").groupBy(F.col("chr").cast("int").alias("chr"), F.col("pos").cast("long").alias("pos")).agg(F.min("pvalue").cast("double").alias("pvalue"))
    return own.repartition("chr").sortWithinPartitions("chr", "pos").mapInArrow(run, "chr int, pos long, pvalue double")


def peak_regions(found: DataFrame, width: int) -> DataFrame:
    """region_id (chr:pos), chr, start, end, pvalue: ``width`` positions behind each peak, as
    windows that are named by their start have it."""
    return found.select(F.concat_ws(":", F.col("chr").cast("string"), F.col("pos").cast("string")).alias("region_id"), "chr", F.col("pos").alias("start"), (F.col("pos") + width).alias("end"), "pvalue")
