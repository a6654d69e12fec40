"""Allele statistics, filters and windows over long calls.

``calls``: chr, pos, sample_id, dosage (null where missing).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SITE = ["chr", "pos"]


def in_region(calls: DataFrame, chr_: int, start: int, end: int) -> DataFrame:
    """Rows of a closed interval; both filters reach a Parquet scan."""
    return calls.where((F.col("chr") == chr_) & F.col("pos").between(start, end))


def at_site(calls: DataFrame, chr_: int, pos: int) -> DataFrame:
    return calls.where((F.col("chr") == chr_) & (F.col("pos") == pos))


def _count(condition: Column) -> Column:
    return F.count_if(condition).cast("long")


def import_minor_counts(calls: DataFrame, known: str | None = None) -> DataFrame:
    """chr, pos, mafc: the smaller of the number of zeros and of ones and twos, rounding down
    after + 0.1; and the number of known calls, if ``known`` names its column."""
    code = F.floor(F.col("dosage") + 0.1)
    more = [_count(F.col("dosage").isNotNull()).alias(known)] if known else []
    return calls.groupBy(SITE).agg(F.least(_count(code == 0), _count(code.isin(1, 2))).alias("mafc"), *more)


def test_minor_counts(calls: DataFrame) -> DataFrame:
    """chr, pos, mafc, minor as counted when a variant is tested (codes by int(x + 0.5)).

    Two codes: the size of the smaller class, doubled unless that code is 1; three
    codes 0, 1, 2: the smaller allele count; anything else: -1.  Ties go to the lower
    code.  ``minor`` is the code of the minor homozygote or class, null where mafc is -1.
    """
    code = F.floor(F.col("dosage") + 0.5)
    n = [_count(code == i) for i in range(3)]
    rows = calls.groupBy(SITE).agg(*[x.alias(f"n{i}") for i, x in enumerate(n)], _count(F.col("dosage").isNotNull()).alias("n"))
    n0, n1, n2, n = (F.col(c) for c in ("n0", "n1", "n2", "n"))
    classes = sum((x > 0).cast("int") for x in (n0, n1, n2))
    clean = n0 + n1 + n2 == n
    first = F.when(n0 > 0, 0).otherwise(1)
    second = F.when(n2 > 0, 2).otherwise(1)
    of = lambda c: F.when(c == 0, n0).when(c == 1, n1).otherwise(n2)
    low = F.when(of(first) <= of(second), first).otherwise(second)
    two = of(low) * F.when(low == 1, 1).otherwise(2)
    zeros, twos = 2 * n0 + n1, 2 * n2 + n1
    mafc = F.when(~clean, -1).when(classes == 2, two).when(classes == 3, F.least(zeros, twos)).otherwise(-1)
    minor = F.when(clean & (classes == 2), low).when(clean & (classes == 3), F.when(zeros <= twos, 0).otherwise(2))
    return rows.select(*SITE, mafc.cast("long").alias("mafc"), minor.cast("int").alias("minor"))


def frequencies(calls: DataFrame, scale: float = 2.0) -> DataFrame:
    """chr, pos, n (non-missing), freq, maf (folded)."""
    rows = calls.groupBy(SITE).agg(_count(F.col("dosage").isNotNull()).alias("n"), F.sum("dosage").alias("s")).where("n > 0")
    freq = F.col("s") / (F.lit(scale) * F.col("n"))
    return rows.select(*SITE, "n", freq.alias("freq"), F.when(freq >= 0.5, 1 - freq).otherwise(freq).alias("maf"))


def polymorphic(calls: DataFrame) -> DataFrame:
    """Sites whose known dosages differ."""
    return calls.groupBy(SITE).agg(F.min("dosage").alias("a"), F.max("dosage").alias("b")).where("a < b").select(*SITE)


def tiling_windows(calls: DataFrame, width: int) -> DataFrame:
    """chr, start, end of windows of ``width``, half overlapping, while start < last position."""
    if width < 2:
        raise ValueError("a window needs two positions")
    last = calls.groupBy("chr").agg(F.max("pos").alias("last")).where("last > 1")
    starts = F.explode(F.sequence(F.lit(1).cast("long"), F.col("last") - 1, F.lit(width // 2).cast("long")))
    return last.select("chr", starts.alias("start")).withColumn("end", F.col("start") + width - 1)


def in_tiling_windows(sites: DataFrame, width: int) -> DataFrame:
    """``sites`` with start of each covering window: at most three rows a site, no range join.

    Windows that begin at or behind a chromosome's last position do not exist."""
    step = width // 2
    last = sites.groupBy("chr").agg(F.max("pos").alias("last"))
    low = F.greatest(F.lit(0), F.ceil((F.col("pos") - width) / step)).cast("long")
    high = F.floor((F.col("pos") - 1) / step).cast("long")
    rows = sites.withColumn("k", F.explode(F.sequence(low, high))).withColumn("start", F.col("k") * step + 1).drop("k")
    return rows.join(last, "chr").where("start < last and pos between start and start + " + str(width - 1)).drop("last")


def rare_code(n0: Column, n1: Column, n2: Column, known: Column, limit: Column) -> Column:
    """The code whose carriers a burden counts, or null: of a variant with fewer than ``limit``
    minor alleles, counted as ``test_minor_counts`` does, the code of the smaller class of two (the
    lower of equal ones), and of three classes 0 or else 1.  n0 to n2: calls of each code."""
    first, second = F.when(n0 > 0, 0).otherwise(1), F.when(n2 > 0, 2).otherwise(1)
    of = lambda c: F.when(c == 0, n0).when(c == 1, n1).otherwise(n2)
    low = F.when(of(first) <= of(second), first).otherwise(second)
    classes = sum((x > 0).cast("int") for x in (n0, n1, n2))
    zeros, others = 2 * n0 + n1, 2 * n2 + n1
    clean = n0 + n1 + n2 == known
    code = F.when(clean & (classes == 2), low).when(clean & (classes == 3), F.when(zeros < others, 0).otherwise(1))
    count = F.when(classes == 2, of(low) * F.when(low == 1, 1).otherwise(2)).otherwise(F.least(zeros, others))
    return F.when(count < limit, code)


def burden(calls: DataFrame, regions: DataFrame, rare: float, carrier: float = 2.0) -> DataFrame:
    """region_id, sample_id, burden: ``carrier`` if the sample has the minor code (see
    ``rare_code``) of a rare variant of the region, else 0, for samples with a known call in it.

    Rare: fewer than int(2 n rare) minor alleles of n known calls, the rule of the array form
    (``mixed.burden_arrays``) too."""
    from .joins import in_regions

    code = F.floor(F.col("dosage") + 0.5)
    counts = calls.groupBy(SITE).agg(*[_count(code == i).alias(f"n{i}") for i in range(3)], _count(F.col("dosage").isNotNull()).alias("n"))
    n0, n1, n2, n = (F.col(c) for c in ("n0", "n1", "n2", "n"))
    minor = counts.select(*SITE, rare_code(n0, n1, n2, n, F.floor(n * 2 * F.lit(rare))).alias("code"))
    rows = in_regions(calls.where("dosage is not null").join(minor, SITE).withColumn("carries", F.coalesce(code == F.col("code"), F.lit(False))), regions)
    return rows.groupBy("region_id", "sample_id").agg(F.max(F.when(F.col("carries"), carrier).otherwise(0.0)).alias("burden"))


def to_letters(bases: DataFrame) -> DataFrame:
    """chr, pos, sample_id, letter from two bases a call (columns a1, a2)."""
    from ..functions.alleles import to_iupac

    return bases.select(*SITE, "sample_id", to_iupac(F.col("a1"), F.col("a2")).alias("letter"))


def letters_to_dosage(letters: DataFrame, strict: bool = False) -> DataFrame:
    """chr, pos, sample_id, dosage: number of minor alleles; sites without exactly two
    alleles go.  Unknown letters count as the major homozygote, or with ``strict`` take
    their site with them.  Of two alleles as frequent as each other the alphabetically
    first is major."""
    from ..functions.alleles import from_iupac

    pair = from_iupac(F.col("letter"))
    rows = letters.withColumn("pair", pair)
    alleles = rows.where("pair is not null").select(*SITE, F.explode(F.array(F.substring("pair", 1, 1), F.substring("pair", 2, 1))).alias("allele"))
    counts = alleles.groupBy(*SITE, "allele").agg(F.count("*").alias("n"))
    sites = counts.groupBy(SITE).agg(F.count("*").alias("kinds"), F.min(F.struct((-F.col("n")).alias("n"), "allele")).alias("major")).where("kinds = 2")
    if strict:
        sites = sites.join(rows.where("pair is null").select(*SITE).distinct(), SITE, "left_anti")
    dosage = F.when(F.col("pair").isNull(), 0.0).otherwise((F.substring("pair", 1, 1) != F.col("major.allele")).cast("double") + (F.substring("pair", 2, 1) != F.col("major.allele")).cast("double"))
    return rows.join(sites, SITE).select(*SITE, "sample_id", dosage.alias("dosage"))
