"""A corpus pipeline of five operators, each over all that the one before has kept.

quality classifier, exact dedup, near-dedup (SimHash proposes, shingles decide), source mixing, BPE encoding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoflux.llm import bpe, exact_dedup, mixing, near, quality
from genoflux.llm.common import kept_table
from genoflux.llm.queries import splitting_pattern, tokenizer_path

#: Near copies: five-word shingles of a similarity of 4 / 5 or more.
NEAR = {"width": 5, "share": (4, 5)}


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The table, written with a number of its own for each row, and that column's name, which
    is none of its own: an id may be null or repeat, a number not."""
    name = "_row"
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    return kept_table(docs.withColumn(name, F.monotonically_increasing_id()), "numbered", "zstd"), name


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; the others go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row, though ids be null or repeat."""
    rows, number = _numbered(docs)
    kept = exact_dedup.exact_duplicates(rows, number).where("kept").select(F.col("row").alias(number))
    return rows.join(kept, number, "left_semi").select(*docs.columns)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id."""
    rows, number = _numbered(docs)
    surplus = near.surplus(rows.select(F.col(number).alias("row"), "doc_id", "text"), **NEAR).withColumnRenamed("row", number)
    return rows.join(near.few(surplus), number, "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, not at all included; rows that share an id, or
    have none, are taken one by one, so each source keeps to its target."""
    rows, number = _numbered(docs)
    taken = mixing.copies(rows, carry=number).where("copies > 0").select(F.col("carried").alias(number), "copies")
    found = rows.join(taken.withColumnRenamed("copies", number + "n"), number)
    times = F.explode(F.sequence(F.lit(1), F.col(number + "n").cast("int")))
    return found.select(*docs.columns, times.alias(number + "n")).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and a check that the ids decode to the text."""
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    found = bpe.decode(bpe.encode(docs, path, splitting_pattern()), path)
    return found.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", good), ("exact_dedup", distinct), ("near_dedup", unlike), ("mixing", mixed), ("bpe", encoded)]

#: Trees, fingerprints, random rounding and BPE are beyond SQL; tests hold the
#: stages against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
