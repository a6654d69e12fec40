"""Readers and writers of traits, matrices, regions, results and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.alleles import chromosome
from .genotypes import header, number


def lines(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """Cells (column c) of the lines that are neither empty nor # comments."""
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return rows.select(F.split("value", separator).alias("c"))


def read_phenotypes(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """sample_id, phe_index, phe_id, value (null where missing) of a wide trait table."""
    names = header(spark, path, separator)
    rows = lines(spark, path, separator).where(F.col("c")[0] != names[0])
    cells = F.posexplode(F.slice("c", 2, len(names) - 1)).alias("phe_index", "text")
    rows = rows.select(F.col("c")[0].alias("sample_id"), cells)
    ids = F.array(*map(F.lit, names[1:]))
    return rows.select("sample_id", "phe_index", F.get(ids, F.col("phe_index")).alias("phe_id"), number(F.col("text")).alias("value"))


def complete(phenotypes: DataFrame, least: int = 0) -> DataFrame:
    """Known values of the traits that have at least ``least`` of them."""
    known = phenotypes.where("value is not null")
    enough = known.groupBy("phe_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return known.join(enough.select("phe_id"), "phe_id", "left_semi")


def union_of_ids(phenotypes: DataFrame) -> DataFrame:
    """One row a sample of any trait, a column a trait, null where it has none."""
    return phenotypes.groupBy("sample_id").pivot("phe_id").agg(F.first("value"))


def write_phenotypes(phenotypes: DataFrame, path: str) -> None:
    """Tab-separated, a header, NA for missing."""
    union_of_ids(phenotypes).orderBy("sample_id").withColumnRenamed("sample_id", "ID").write.csv(path, sep="\t", header=True, nullValue="NA")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and n (from 0) of the lines of a file, or of files in order of their paths, however they
    are split: lines are counted within each split, and splits (a row each) follow each other by
    their first byte."""
    at = [F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s")]
    rows = spark.read.text(path).select("value", *at, F.monotonically_increasing_id().alias("_k"))
    sizes = rows.groupBy("_f", "_s").agg(F.count("*").alias("_c"))
    before = sizes.select("_f", "_s", (F.sum("_c").over(Window.orderBy("_f", "_s")) - F.col("_c")).alias("_b"))
    within = F.row_number().over(Window.partitionBy("_f", "_s").orderBy("_k")) - 1
    return rows.withColumn("_r", within).join(before, ["_f", "_s"]).select("value", (F.col("_b") + F.col("_r")).alias("n"))


def separator_of(first_line: str) -> str:
    """The one of comma, blank and tab that splits a line into most cells."""
    return max(",", " ", "\t", key=lambda s: len(first_line.split(s)))


def read_kinship(spark: SparkSession, path: str) -> DataFrame:
    """i, j, k of a square matrix file: a line of ids, then a line a row in that order."""
    first = spark.read.text(path).first()["value"]
    sep = separator_of(first)
    ids = [x for x in first.strip().split(sep) if x]
    rows = numbered_lines(spark, path).withColumn("r", (F.col("n") - 1).cast("int")).where("r >= 0")
    names = F.array(*map(F.lit, ids))
    cells = rows.select("r", F.posexplode(F.split(F.trim("value"), sep)).alias("c", "text"))
    return cells.select(F.get(names, F.col("r")).alias("i"), F.get(names, F.col("c")).alias("j"), number(F.col("text")).alias("k")).where("i is not null and j is not null")


def write_kinship(kinship: DataFrame, path: str, separator: str = ",") -> None:
    """The square matrix with a line of ids first; rows and columns by id."""
    per = kinship.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "k"))).alias("x"))
    body = per.select(F.col("i"), F.array_join(F.transform("x", lambda s: s["k"].cast("string")), separator).alias("value"))
    head = per.agg(F.array_join(F.array_sort(F.collect_list("i")), separator).alias("value")).select(F.lit("").alias("i"), "value")
    head.unionByName(body).coalesce(1).sortWithinPartitions("i").select("value").write.text(path)


def submatrix(kinship: DataFrame, rows: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """Entries whose i is in ``rows`` and j in ``columns`` (default: rows); column id."""
    other = rows if columns is None else columns
    return kinship.join(rows.select(F.col("id").alias("i")), "i", "left_semi").join(other.select(F.col("id").alias("j")), "j", "left_semi")


def read_relation(spark: SparkSession, path: str) -> DataFrame:
    """obs_id, pred_id, k; # lines are comments, the header starts with OBS_ID."""
    names = header(spark, path, ",")
    rows = lines(spark, path, ",").where(F.col("c")[0] != names[0])
    ids = F.array(*map(F.lit, names[1:]))
    cells = rows.select(F.col("c")[0].alias("obs_id"), F.posexplode(F.slice("c", 2, len(names) - 1)).alias("p", "text"))
    return cells.select("obs_id", F.get(ids, F.col("p")).alias("pred_id"), number(F.col("text")).alias("k"))


def write_relation(relation: DataFrame, path: str, whole: bool = True, region: tuple[int, int, int] | None = None) -> None:
    """What ``read_relation`` reads: a comment that says whether the whole genome is meant, one with the
    region (chr, start, end) if there is one, the ids of the predicted, then a line an observed
    sample, by id.  Pairs without a value are NaN."""
    ids = relation.select("pred_id").distinct()
    cells = relation.select("obs_id").distinct().join(ids).join(relation, ["obs_id", "pred_id"], "left")  # every cell is written
    text = F.coalesce(F.col("k").cast("string"), F.lit("NaN"))
    per = cells.groupBy("obs_id").agg(F.array_sort(F.collect_list(F.struct("pred_id", text.alias("t")))).alias("x"))
    body = per.select(F.lit(2).alias("o"), F.col("obs_id").cast("string").alias("i"), F.concat_ws(",", F.col("obs_id").cast("string"), F.transform("x", lambda s: s["t"])).alias("value"))
    names = ids.agg(F.array_sort(F.collect_list("pred_id")).alias("x")).select(F.lit(1).alias("o"), F.lit("").alias("i"), F.concat_ws(",", F.lit("OBS_ID"), F.col("x").cast("array<string>")).alias("value"))
    place = "#" + (f"Chr{region[0]}:{region[1]}:{region[2]};" if region else "")
    head = relation.sparkSession.createDataFrame([(0, "0", f"#WG={str(whole).lower()}"), (0, "1", place)], "o int, i string, value string")
    head.unionByName(names).unionByName(body).coalesce(1).sortWithinPartitions("o", "i").select("value").write.text(path)


def paired_compounds(compounds: DataFrame) -> DataFrame:
    """Candidate pairs among ``read_compounds``: compounds of exactly two parts on one chromosome;
    of those with the same parts, the one with the smallest id: compound_id, chr, start_1, end_1,
    start_2, end_2."""
    at = lambda i, c: F.max(F.when(F.col("part") == i, F.col(c))).alias(f"{c}_{i}")
    wide = compounds.groupBy("compound_id").agg(F.count("*").alias("n"), F.min("chr").alias("chr"), F.max("chr").alias("last"), *[at(i, c) for i in (1, 2) for c in ("start", "end")])
    parts = ["chr", "start_1", "end_1", "start_2", "end_2"]
    return wide.where("n = 2 and chr = last").groupBy(*parts).agg(F.min("compound_id").alias("compound_id")).select("compound_id", *parts)


def read_crosses(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Of tab-separated lines name, id, name, id, cross: founders (id, name) and crosses (one, other,
    cross_id), a row for either order of the two."""
    c = F.col("c")
    rows = spark.read.text(path).select(F.split("value", "\t").alias("c")).where(F.size("c") >= 5)
    both = F.array(*[F.struct(c[i + 1].alias("id"), c[i].alias("name")) for i in (0, 2)])
    turns = F.array(*[F.struct(c[i].alias("one"), c[4 - i].alias("other"), c[4].alias("cross_id")) for i in (1, 3)])
    return rows.select(F.explode(both).alias("x")).select("x.*").distinct(), rows.select(F.explode(turns).alias("x")).select("x.*").distinct()


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """region_id, chr, start, end of tab-separated lines; # starts a comment."""
    c = F.col("c")
    rows = lines(spark, path, "\t").where(F.size("c") >= 4)
    return rows.select(c[0].alias("region_id"), chromosome(c[1]).alias("chr"), c[2].cast("long").alias("start"), c[3].cast("long").alias("end"))


def read_compounds(spark: SparkSession, path: str) -> DataFrame:
    """compound_id, part (from 1), chr, start, end of lines id, chr;start;end, ..."""
    c = F.col("c")
    rows = lines(spark, path, "\t").select(c[0].alias("compound_id"), F.posexplode(F.slice("c", F.lit(2), F.size("c") - 1)).alias("p", "text"))
    rows = rows.select("compound_id", (F.col("p") + 1).alias("part"), F.split("text", ";").alias("t")).where(F.size("t") == 3)
    t = F.col("t")
    return rows.select("compound_id", "part", chromosome(t[0]).alias("chr"), t[1].cast("long").alias("start"), t[2].cast("long").alias("end"))


def read_results(spark: SparkSession, path: str, p_limit: float, maf: float = 0.0, n: int = 0) -> DataFrame:
    """chr, pos, pvalue, adj_r2, coef, se, mafc of a scan's file, below p_limit and with a
    minor count of at least 2 n maf."""
    c = F.col("c")
    rows = lines(spark, path, ",").where(c[0].try_cast("int").isNotNull())
    rows = rows.select(c[0].cast("int").alias("chr"), c[1].cast("long").alias("pos"), *[number(c[i]).alias(k) for i, k in enumerate(("pvalue", "adj_r2", "coef", "se"), 2)], F.get("c", F.lit(6)).try_cast("long").alias("mafc"))
    return rows.where((F.col("pvalue") < p_limit) & (F.coalesce("mafc", F.lit(0)) >= 2 * n * maf))


def write_results(results: DataFrame, path: str, sample_size: int) -> None:
    """Two # lines, then rows by position."""
    names = ["chr", "pos", "pvalue", "adj_r2", "coef", "sd_err", "mafc"]
    body = results.select("chr", "pos", F.concat_ws(",", *[F.col(n).cast("string") for n in names]).alias("value"))
    notes = [(-2, -2, f"#SampleSize={sample_size}"), (-1, -1, "#chr,location,pvalue,AdjustedR2,coefficient,Sd_Err,MAF_count")]
    head = results.sparkSession.createDataFrame(notes, "chr int, pos long, value string")
    head.unionByName(body).orderBy("chr", "pos").select("value").write.text(path)


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """region_id, chr, start, loglik, h2 of lines chr, position, loglik/h2, ..."""
    rows = lines(spark, path, r",\s*").where(F.col("c")[0].try_cast("int").isNotNull())
    c = F.col("c")
    rows = rows.select(c[0].cast("int").alias("chr"), c[1].cast("long").alias("start"), F.explode(F.slice("c", F.lit(3), F.size("c") - 2)).alias("cell"))
    cell = F.split("cell", "/")
    return rows.select(F.concat_ws(":", F.col("chr").cast("string"), F.col("start").cast("string")).alias("region_id"), "chr", "start", number(cell[0]).alias("loglik"), number(cell[1]).alias("h2")).where("loglik is not null and h2 is not null")


def parse_sites(text: str) -> list[tuple[int, int]]:
    """Pairs of a list such as 1_5;2_7."""
    return [(int(a), int(b)) for a, b in (x.split("_") for x in text.split(";") if x)]


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    """line, chr, pos, code of a cross's marker table: rows Locus, Chr, cM, start in Mb, order,
    two founders, then a line each; tab-separated, a column a marker.

    Codes N, D, _, . and blanks are missing (null)."""
    rows = numbered_lines(spark, path).select("n", F.split("value", "\t").alias("c"))
    name = F.col("c")[0]
    cells = rows.select("n", name.alias("line"), F.posexplode(F.slice("c", F.lit(2), F.size("c") - 1)).alias("m", "text"))
    chrs = cells.where("n = 1").select("m", chromosome(F.trim("text")).alias("chr"))
    places = cells.where("n = 3").select("m", (F.col("text").try_cast("double") * 1_000_000).cast("long").alias("pos"))
    code = F.when(F.trim("text").isin("A", "B", "C", "H"), F.trim("text"))
    return cells.where("n > 6").join(chrs, "m").join(places, "m").select("line", "chr", "pos", code.alias("code"))


def read_founders(spark: SparkSession, path: str) -> DataFrame:
    """founder, chr, pos, base of a comma-separated table Chromosome,Positions,<founders>."""
    names = header(spark, path, ",")
    rows = lines(spark, path, ",").where(F.col("c")[0] != names[0])
    ids = F.array(*map(F.lit, names[2:]))
    cells = rows.select(chromosome(F.col("c")[0]).alias("chr"), F.col("c")[1].cast("long").alias("pos"), F.posexplode(F.slice("c", 3, len(names) - 2)).alias("f", "base"))
    return cells.select(F.get(ids, F.col("f")).alias("founder"), "chr", "pos", F.when(F.col("base").isin("A", "C", "G", "T"), F.col("base")).alias("base"))


def read_pedigree(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Relations of a tab-separated pedigree (fam, id, father, mother, sex, ..., siblings):
    people (id, sex, population), parents (id, parent, of the same sex), both (id, father,
    mother), siblings (id, sibling), alike (id, siblings: those of the same sex in their order; a
    male's first two, all of a female) where there are two or more, and sibling (id, sibling:
    the last of those, or the only one)."""
    names = header(spark, path, "\t")
    rows = lines(spark, path, "\t").where(F.col("c")[0] != names[0])
    c = F.col("c")
    people = rows.select(c[1].alias("id"), c[2].alias("father"), c[3].alias("mother"), c[4].try_cast("int").alias("sex"), F.get("c", F.lit(6)).alias("population"), F.get("c", F.lit(8)).alias("sibs"))
    known = people.select(F.col("id").alias("k"))
    both = people.join(known, people["father"] == F.col("k"), "left_semi").join(known, F.col("mother") == F.col("k"), "left_semi")
    parent = people.select("id", F.when(F.col("sex") == 1, F.col("father")).otherwise(F.col("mother")).alias("parent"))
    listed = people.where("sibs is not null").select("id", "sex", F.posexplode(F.split("sibs", r",\s*")).alias("_i", "sibling"))
    sibs = listed.select("id", "sibling")
    sexes = people.select(F.col("id").alias("sibling"), F.col("sex").alias("_s"))
    same = listed.join(sexes, "sibling").where("sex = _s and sex in (1, 2) and id <> sibling")
    same = same.groupBy("id", "sex").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "sibling"))), lambda s: s["sibling"]).alias("_x"))
    alike = same.select("id", F.when(F.col("sex") == 1, F.slice("_x", 1, 2)).otherwise(F.col("_x")).alias("siblings"))
    return {
        "alike": alike.where(F.size("siblings") > 1),
        "sibling": alike.select("id", F.element_at("siblings", -1).alias("sibling")),
        "people": people.select("id", "sex", "population"),
        "parents": parent.join(known, F.col("parent") == F.col("k"), "left_semi"),
        "both": both.select("id", "father", "mother"),
        "siblings": sibs.join(known, F.col("sibling") == F.col("k"), "left_semi"),
    }


#: Non-coding elements that an annotation may name.
NON_CODING = ("miRNA", "snRNA", "snoRNA", "rRNA", "lincRNA", "misc_RNA", "UTR", "PGENE", "TFPEAK", "TFMOTIF", "ENHANCER")


def parse_annotation(rows: DataFrame, names: list[str]) -> DataFrame:
    """Typed annotation fields from tab-separated lines (column value), by column name.

    A field that does not parse is -1 (counts), null (frequencies) or * (text); a VA entry
    of fewer than five parts gives no gene."""
    cells = rows.select(F.split("value", "\t").alias("c"))
    at = {n.lstrip("#"): i for i, n in enumerate(names)}
    get = lambda n: F.get("c", F.lit(at[n])) if n in at else F.lit(None).cast("string")
    text = lambda n: F.coalesce(F.nullif(get(n), F.lit("")), F.lit("*"))
    count = lambda n: F.coalesce(get(n).try_cast("int"), F.lit(-1))
    va = F.split(get("VA"), ":")
    nac = F.split(get("NAC"), ",")[0]
    return cells.select(
        chromosome(get("CHROM")).alias("chr"),
        get("POS").try_cast("long").alias("pos"),
        *[text(n).alias(n.lower()) for n in ("REF", "ALT", "AA", "VT")],
        *[count(n).alias(n.lower()) for n in ("QUAL", "AC", "AN")],
        *[number(get(n)).alias(n.lower()) for n in ("AF", "ASN_AF", "AMR_AF", "AFR_AF", "EUR_AF")],
        F.when(F.size(va) >= 5, F.get(va, F.lit(1))).alias("gene"),
        F.when(F.size(va) >= 5, F.get(va, F.lit(3))).alias("strand"),
        F.when(F.size(va) >= 5, F.get(va, F.lit(4))).alias("function"),
        F.when(nac.isin(*NON_CODING), nac).otherwise("*").alias("nac"),
    )


#: The order of an annotation's fields in text.
ANNOTATION_FIELDS = ("ref", "alt", "qual", "aa", "ac", "an", "af", "afr_af", "amr_af", "asn_af", "eur_af", "vt", "nac")


def write_annotation(annotation: DataFrame, path: str) -> None:
    """Tab-separated text, a line a variant by chr and pos: these two, the fields of
    ``ANNOTATION_FIELDS`` (an unknown frequency is NaN), and 1:gene:strand:function, or * without a
    gene."""
    field = lambda n: F.coalesce(F.col(n).cast("string"), F.lit("NaN" if n.endswith("af") else "*"))
    gene = F.when(F.col("gene").isNotNull(), F.concat_ws(":", F.lit("1"), "gene", F.coalesce("strand", F.lit("*")), F.coalesce("function", F.lit("*")))).otherwise("*")
    value = F.concat_ws("\t", F.col("chr").cast("string"), F.col("pos").cast("string"), *map(field, ANNOTATION_FIELDS), gene)
    annotation.select("chr", "pos", value.alias("value")).orderBy("chr", "pos").select("value").write.text(path)


def functional(annotation: DataFrame) -> DataFrame:
    """Adds functional: a coding change (a SNP whose function is known and not synonymous,
    or an indel or structural variant in a gene), or a non-coding element."""
    coding = (F.col("vt") == "SNP") & ~F.col("function").isin("synonymous", "*") | F.col("vt").isin("INDEL", "SV")
    return annotation.withColumn("functional", F.coalesce(F.col("function").isNotNull() & coding, F.lit(False)) | (F.col("nac") != "*"))


def functional_rare(annotation: DataFrame, rare: float) -> DataFrame:
    """Functional variants below a frequency."""
    return functional(annotation).where((F.col("af") < rare) & F.col("functional")).drop("functional")


def gene_extents(annotation: DataFrame) -> DataFrame:
    """gene, chr, start, end: from one before its first variant to one behind its last."""
    return annotation.where("gene is not null").groupBy("gene", "chr").agg((F.min("pos") - 1).alias("start"), (F.max("pos") + 1).alias("end"))
