"""Gene models: lines of gene, chr, start, end and rsid_pos_ref_alt_weight tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_models(lines: DataFrame) -> DataFrame:
    """gene, chr, start, end, rsid, pos, ref, alt, weight: a row a token of lines (column value)."""
    cells = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#")).select(cells.alias("c")).where(F.size("c") > 4)
    token = F.explode(F.slice("c", F.lit(5), F.size("c") - 4))
    rows = rows.select(F.col("c")[0].alias("gene"), F.col("c")[1].alias("chr"), F.col("c")[2].try_cast("long").alias("start"), F.col("c")[3].try_cast("long").alias("end"), token.alias("token"))
    rows = rows.withColumn("t", F.split("token", "_")).where(F.size("t") == 5)
    t = F.col("t")
    return rows.select("gene", "chr", "start", "end", t[0].alias("rsid"), t[1].try_cast("long").alias("pos"), t[2].alias("ref"), t[3].alias("alt"), t[4].try_cast("double").alias("weight"))


def read_models(spark: SparkSession, path: str, gene: str | None = None) -> DataFrame:
    """Models of a file, or of one gene of it; an absent gene is an error."""
    rows = parse_models(spark.read.text(path))
    if gene is not None:
        rows = rows.where(F.col("gene") == gene)
        if rows.isEmpty():
            raise ValueError(f"no model of {gene} in {path}")
    return rows
