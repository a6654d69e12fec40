"""Readers and writers of genotype text and of the Parquet variant store.

Text is read as lines and split by Spark; no schema is inferred.  Ragged rows are an
error where the number of samples is known.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.alleles import MISSING, chromosome, import_minor_count, packed, to_iupac


def number(text: Column) -> Column:
    """A double; the usual marks of missing values and NaN become null."""
    value = F.when(~F.trim(text).isin(*MISSING), F.trim(text).try_cast("double"))
    return F.when(~F.isnan(value), value)


def header(spark: SparkSession, path: str, separator: str) -> list[str]:
    """Cells of a file's first line (without # comment lines)."""
    first = spark.read.text(path).where(~F.col("value").startswith("#")).first()
    return first["value"].split(separator) if first else []


def read_csv(spark: SparkSession, path: str, letters: bool = False) -> tuple[DataFrame, list[str]]:
    """Variants (chr, pos, mafc, g in order of the header's samples) and the sample ids.

    The first line is CHR,LOC,<ids>.  Rows may be in any order; chromosome labels may
    be numbers or names (chr1, X).  With ``letters`` g holds strings."""
    names = header(spark, path, ",")
    samples = names[2:]
    cells = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split("value", ",").alias("c")).where(F.col("c")[1] != names[1])
    checked = F.when(F.size("c") == len(names), F.col("c")).otherwise(F.raise_error(F.concat(F.lit("ragged row: "), F.array_join("c", ",")))).alias("c")
    rows = cells.select(checked).select(chromosome(F.trim(F.col("c")[0])).alias("chr"), F.col("c")[1].cast("long").alias("pos"), F.slice("c", 3, len(samples)).alias("g"))
    if letters:
        return rows, samples
    rows = rows.withColumn("g", F.transform("g", number))
    return rows.select("chr", "pos", import_minor_count(F.col("g")).alias("mafc"), "g"), samples


def write_store(variants: DataFrame, samples: list[str], path: str) -> None:
    """The variant store: Parquet by chromosome, sorted by position, so that a region is a
    partition and a few row groups; sample ids beside it."""
    variants.repartition("chr", F.floor(F.col("pos") / 5_000_000)).sortWithinPartitions("chr", "pos").write.partitionBy("chr").parquet(f"{path}/variants")
    variants.sparkSession.createDataFrame(list(enumerate(samples)), "ordinal int, sample_id string").coalesce(1).write.parquet(f"{path}/samples")


def write_packed(variants: DataFrame, samples: list[str], path: str, group_bytes: int = 4 << 20) -> None:
    """The packed store: chr, pos and the calls (0, 1, 2, missing) as two bits each (column
    ``packed``), a 32nd of what doubles take.

    Parquet by chromosome, sorted by position, in row groups of about ``group_bytes``, whose
    statistics of position let a region be read without the others.  Another call is an error,
    so is a row that has not one for each sample."""
    n = len(samples)

    def run(batches):
        for batch in batches:
            flat = batch["g"].flatten().to_numpy(zero_copy_only=False)
            if (np.diff(batch["g"].offsets.to_numpy()) != n).any():
                raise ValueError("a row has not one call for each sample")
            codes = packed(np.asarray(flat, float).reshape(batch.num_rows, n))
            bounds = np.arange(batch.num_rows + 1, dtype=np.int32) * codes.shape[1]
            cells = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([batch["chr"], batch["pos"], cells], ["chr", "pos", "packed"])

    rows = variants.select(F.col("chr").cast("int").alias("chr"), F.col("pos").cast("long").alias("pos"), F.transform("g", lambda x: x.cast("double")).alias("g"))
    rows = rows.repartition("chr", F.floor(F.col("pos") / 5_000_000)).sortWithinPartitions("chr", "pos").mapInArrow(run, "chr int, pos long, packed binary")
    rows.write.option("parquet.block.size", group_bytes).partitionBy("chr").parquet(f"{path}/variants")
    variants.sparkSession.createDataFrame(list(enumerate(samples)), "ordinal int, sample_id string").coalesce(1).write.parquet(f"{path}/samples")


def unpack(variants: DataFrame, n: int) -> DataFrame:
    """``variants`` of a packed store of n samples with g (array of doubles, null: missing) in
    place of ``packed``."""
    byte = lambda i: F.conv(F.hex(F.substring("packed", (F.floor(i / 4) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    code = lambda i: F.floor(byte(i) / F.pow(F.lit(4), i % 4)).cast("int") % 4
    g = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(code(i) < 3, code(i).cast("double"))) if n else F.array().cast("array<double>")
    return variants.withColumn("g", g).drop("packed")


def read_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Variants (with g, or packed, as they were written) and samples of a store."""
    return spark.read.parquet(f"{path}/variants"), spark.read.parquet(f"{path}/samples")


def subset(variants: DataFrame, samples: list[str], chosen: list[str]) -> DataFrame:
    """Columns of g for the chosen samples, in their order; unknown ids are an error."""
    place = {s: i for i, s in enumerate(samples)}
    at = F.array(*[F.lit(place[s]) for s in chosen])
    return variants.withColumn("g", F.transform(at, lambda i: F.get("g", i)))


def aligned(first: tuple[DataFrame, DataFrame], second: tuple[DataFrame, DataFrame], trait: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two stores (variants and samples each, packed or not) and a trait (sample_id and others),
    brought to the samples that all three have: both stores' variants with g in a common
    order, and samples with the trait (ordinal and the trait's columns).

    The order is that of the first store.  A sample_id that repeats in a store counts by its
    first ordinal; one that repeats in the trait keeps a row of each, with one ordinal; null
    ids are no ids.  Only places go to the tasks, one row a store (the sample axis); genotypes
    are permuted where they are scanned, so no variant is shuffled."""

    def own(samples: DataFrame) -> DataFrame:
        return samples.where("sample_id is not null").groupBy("sample_id").agg(F.min("ordinal").alias("ordinal"))

    a, b = own(first[1]).withColumnRenamed("ordinal", "at_a"), own(second[1]).withColumnRenamed("ordinal", "at_b")
    common = a.join(b, "sample_id").join(trait.select("sample_id").distinct(), "sample_id", "left_semi")
    places = common.agg(F.array_sort(F.collect_list(F.struct("at_a", "at_b", "sample_id"))).alias("s"))

    def permuted(store: tuple[DataFrame, DataFrame], at: str) -> DataFrame:
        variants = store[0]
        if "packed" in variants.columns:
            variants = unpack(variants, store[1].count())
        table = places.select(F.transform("s", lambda x: x[at]).alias("_at"))
        return variants.join(F.broadcast(table)).withColumn("g", F.transform("_at", lambda i: F.get("g", i))).drop("_at")  # one row, of places

    ordered = places.select(F.posexplode("s").alias("ordinal", "x")).select("ordinal", "x.sample_id")
    return permuted(first, "at_a"), permuted(second, "at_b"), trait.drop("ordinal").join(ordered, "sample_id")


def to_calls(variants: DataFrame, samples: DataFrame) -> DataFrame:
    """chr, pos, sample_id, dosage."""
    rows = variants.select("chr", "pos", F.posexplode("g").alias("ordinal", "dosage"))
    return rows.join(F.broadcast(samples), "ordinal").select("chr", "pos", "sample_id", "dosage")  # the sample axis


def _text(x: Column) -> Column:
    """Whole numbers without decimals; null as NA."""
    whole = F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))
    return F.coalesce(whole, F.lit("NA"))


def write_csv(variants: DataFrame, samples: list[str], path: str) -> None:
    """Lines chr,pos,<values> behind a header, a text file a partition, in order."""
    line = F.concat_ws(",", F.col("chr").cast("string"), F.col("pos").cast("string"), F.array_join(F.transform("g", _text), ","))
    rows = variants.select("chr", "pos", line.alias("value"))
    head = variants.sparkSession.createDataFrame([(-1, -1, ",".join(["CHR", "LOC", *samples]))], "chr int, pos long, value string")
    head.unionByName(rows).orderBy("chr", "pos").select("value").write.text(path)


def read_tped(spark: SparkSession, tped: str, tfam: str) -> tuple[DataFrame, DataFrame]:
    """Variants with letters (chr, pos, rsid, g) and samples (ordinal, fid, sample_id, phenotype).

    Blanks or tabs separate.  Chromosome 0, those above 22, and position 0 are left out;
    phenotype -9 is null."""
    fam = spark.read.text(tfam).select(F.split(F.trim("value"), r"\s+").alias("c"), F.monotonically_increasing_id().alias("k"))
    from pyspark.sql import Window

    value = F.col("c")[5].try_cast("double")
    samples = fam.select((F.row_number().over(Window.orderBy("k")) - 1).alias("ordinal"), F.col("c")[0].alias("fid"), F.col("c")[1].alias("sample_id"), F.when(value != -9, value).alias("phenotype"))
    cells = spark.read.text(tped).select(F.split(F.trim("value"), r"\s+").alias("c"))
    alleles = F.slice("c", F.lit(5), F.size("c") - 4)
    pairs = F.transform(F.sequence(F.lit(0), F.size("c") - 6, F.lit(2)), lambda i: to_iupac(F.get(alleles, i), F.get(alleles, i + 1)))
    rows = cells.select(chromosome(F.col("c")[0]).alias("chr"), F.col("c")[3].try_cast("long").alias("pos"), F.col("c")[1].alias("rsid"), pairs.alias("g"))
    return rows.where("chr between 1 and 22 and pos > 0"), samples


def _letters(x: Column) -> Column:
    """The pair of letters of a call, by the row's ref and alt."""
    pair = lambda a, b: F.concat_ws(" ", a, b)
    return F.when(x.isNull(), F.lit("0 0")).when(x == 0, pair("ref", "ref")).when(x == 1, pair("ref", "alt")).otherwise(pair("alt", "alt"))


def plink_lines(variants: DataFrame, gene: str) -> dict[str, DataFrame]:
    """Text lines of a gene's slice (columns chr, pos, rsid, ref, alt, weight, g of 0/1/2):
    tped, setid and weights.  0: ref ref, 1: ref alt, 2: alt alt, null: 0 0."""
    tped = F.concat_ws(" ", F.col("chr").cast("string"), "rsid", F.lit("0"), F.col("pos").cast("string"), F.array_join(F.transform("g", _letters), " "))
    rows = variants.orderBy("chr", "pos")
    return {"tped": rows.select(tped.alias("value")), "setid": rows.select(F.concat_ws("\t", F.lit(gene), "rsid").alias("value")), "weights": rows.select(F.concat_ws("\t", "rsid", F.col("weight").cast("string")).alias("value"))}


#: Parts of the text of a gene's slice.
SLICE_KINDS = ("tped", "setid", "weights")


def write_slices(variants: DataFrame, models: DataFrame, path: str, subsets: dict[str, list[str]] | None = None, parts: int | None = None) -> DataFrame:
    """Slices of all gene models in one pass over a store: text folders
    ``path/text/gene=<gene>/subset=<subset>/kind=<tped, setid or weights>``, and the manifest,
    which is returned and stands in ``path/manifest``: gene, subset, n_sites (of the model),
    n_found (written).

    ``variants`` has chr, pos and g, of 0/1/2 (null: missing) or of letter pairs ("A G") that
    are passed through; ``models`` gene, chr, pos and any of origin, rsid, ref, alt, weight
    (nulls and absent columns: rs_<pos>, A, T, 0.0).  ``subsets`` names the origins of each
    set of files, one site in as many sets as list its origin; without it there is one, all.
    A site that a model lists twice is written twice.  Sites the store lacks are only counted.

    Models meet the store by chr and pos; text lines are ranged by gene, subset, kind and position, so a
    large gene spreads over tasks, and its files in order of their names are in order of
    position.  Files cost more than their bytes do, so there are as many tasks as a shuffle has
    (``parts``), however short the text.  The manifest counts the lines where models meet the store; neither
    files nor genotypes are read for it."""
    plain = {"rsid": F.concat(F.lit("rs_"), F.col("pos").cast("string")), "ref": F.lit("A"), "alt": F.lit("T"), "weight": F.lit(0.0)}
    own = models.withColumns({c: F.coalesce(c, d) if c in models.columns else d for c, d in plain.items()})
    chosen = F.array(*[F.when(F.col("origin").isin(o), F.lit(n)) for n, o in subsets.items()]) if subsets else F.array(F.lit("all"))
    own = own.select("gene", F.explode(F.array_compact(chosen)).alias("subset"), "chr", "pos", *plain)
    letters = isinstance(variants.schema["g"].dataType.elementType, T.StringType)
    pair = lambda x: F.coalesce(x, F.lit("0 0")) if letters else _letters(x)
    tped = F.concat_ws(" ", F.col("chr").cast("string"), "rsid", F.lit("0"), F.col("pos").cast("string"), F.array_join(F.transform("g", pair), " "))
    lines = {"tped": tped, "setid": F.concat_ws("\t", "gene", "rsid"), "weights": F.concat_ws("\t", "rsid", F.col("weight").cast("string"))}
    found = variants.select("chr", "pos", "g").join(own, ["chr", "pos"])
    rows = found.select("gene", "subset", "pos", "chr", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), lines[k].alias("value")) for k in SLICE_KINDS])).alias("x")).select("gene", "subset", "x.kind", "chr", "pos", "x.value")
    order = ["gene", "subset", "kind", "chr", "pos", "value"]
    spark = variants.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged.select("gene", "subset", "kind", "value").write.partitionBy("gene", "subset", "kind").text(f"{path}/text")
    written = variants.select("chr", "pos").join(own, ["chr", "pos"]).groupBy("gene", "subset").agg(F.count("*").alias("n_found"))
    manifest = own.groupBy("gene", "subset").agg(F.count("*").alias("n_sites")).join(written, ["gene", "subset"], "left")
    manifest.select("gene", "subset", "n_sites", F.coalesce("n_found", F.lit(0).cast("long")).alias("n_found")).write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_slices(spark: SparkSession, path: str) -> DataFrame:
    """gene, subset, kind, value: all lines that ``write_slices`` wrote."""
    return spark.read.schema("value string, gene string, subset string, kind string").text(f"{path}/text").select("gene", "subset", "kind", "value")


def write_tfam(samples: DataFrame, path: str, trait: DataFrame | None = None) -> None:
    """The samples (ordinal, sample_id) as tfam lines in order, with a trait's value (sample_id,
    value; null or none: -9)."""
    own = samples if trait is None else samples.join(trait.select("sample_id", "value"), "sample_id", "left")
    value = F.lit("-9") if trait is None else F.coalesce(F.col("value").cast("string"), F.lit("-9"))
    own.orderBy("ordinal").select(F.concat_ws(" ", "sample_id", "sample_id", F.lit("0"), F.lit("0"), F.lit("0"), value).alias("value")).write.text(path)
