"""Genetics tables that Spark and SQL derive alike from whole given tables.

calls: a supplier is a sample, a part a variant, a line item a genotype call.
variants: a vector is a variant and each of its components a sample's genotype, so
the variant axis grows with the data and the sample axis stays small and dense.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CHR = "cast({k} % 5 + 1 as int)"
_POS = "cast(1 + {k} * 1000 + ({k} * 7919) % 997 as bigint)"
_DOSAGE = """case when (l_suppkey + l_partkey) % 41 = 0 then null
    when l_partkey % 7 = 4 then cast(0 as double)
    when cast(max(l_quantity) as bigint) % 7 < 4 then cast(0 as double)
    when cast(max(l_quantity) as bigint) % 7 < 6 then cast(1 as double)
    else cast(2 as double) end"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def site(k: str) -> list:
    return [F.expr(_CHR.format(k=k)).alias("chr"), F.expr(_POS.format(k=k)).alias("pos")]


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, chr, pos, dosage."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max("l_quantity").alias("q"))
    dosage = F.expr(_DOSAGE.replace("max(l_quantity)", "q"))
    return rows.select(F.col("l_suppkey").alias("sample_id"), *site("l_partkey"), dosage.alias("dosage"))


def phenotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, y (null in one nation), cc (1 control, 2 case)."""
    y = F.when(F.col("s_nationkey") != 7, F.col("s_acctbal"))
    cc = F.when(F.col("s_acctbal") > 4500, 2).otherwise(1)
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample_id"), y.alias("y"), cc.alias("cc"), F.col("s_nationkey").cast("double").alias("w"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region_id, chr, start, end."""
    rows = table(spark, sf_dir, "part").select(F.expr(_CHR.format(k="p_partkey")).alias("chr"), "p_size").distinct()
    start = F.col("p_size").cast("long") * 40000 + 1
    return rows.select(F.concat_ws(":", F.col("chr").cast("string"), F.col("p_size").cast("string")).alias("region_id"), "chr", start.alias("start"), (start + 29999).alias("end"))


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gene, chr, pos, weight."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("gene"), *site("p_partkey"), "p_size")
    return rows.select("gene", "chr", "pos", ((F.col("pos") % 13).cast("double") / F.lit(13.0)).alias("weight"), F.expr("case when p_size < 20 then 'EN' when p_size < 40 then 'eQTL' else 'NULL' end").alias("origin"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chr, pos, g."""
    g = F.transform("embedding", lambda x: (F.floor(F.abs(x.cast("double")) * 16) % 3).cast("double"))
    return table(spark, sf_dir, "embeddings").select((F.col("label") + 1).cast("int").alias("chr"), (F.col("vec_id") * 1000 + 1).cast("long").alias("pos"), g.alias("g"))


def array_trait(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ordinal, y: a trait of the array store's samples, from integer sums."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("ordinal", "x"))
    whole = F.floor(F.col("x").cast("double") * 1000) * (F.col("label") - 4)
    return rows.groupBy("ordinal").agg((F.sum(whole).cast("double") / 1000).alias("y"))


def array_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The array store in long form."""
    return variants(spark, sf_dir).select("chr", "pos", F.posexplode("g").alias("sample_id", "dosage"))


#: The same tables for the SQL side.
SQL = f"""
calls as (
  select l_suppkey as sample_id, {_CHR.format(k='l_partkey')} as chr, {_POS.format(k='l_partkey')} as pos, {_DOSAGE} as dosage
  from lineitem group by l_suppkey, l_partkey),
pheno as (
  select s_suppkey as sample_id, case when s_nationkey <> 7 then s_acctbal end as y,
         case when s_acctbal > 4500 then 2 else 1 end as cc, cast(s_nationkey as double) as w from supplier),
regions as (
  select distinct concat(cast({_CHR.format(k='p_partkey')} as varchar), ':', cast(p_size as varchar)) as region_id,
         {_CHR.format(k='p_partkey')} as chr, cast(p_size as bigint) * 40000 + 1 as "start", cast(p_size as bigint) * 40000 + 30000 as "end" from part),
models as (
  select p_brand as gene, {_CHR.format(k='p_partkey')} as chr, {_POS.format(k='p_partkey')} as pos,
         cast({_POS.format(k='p_partkey')} % 13 as double) / cast(13 as double) as weight,
         case when p_size < 20 then 'EN' when p_size < 40 then 'eQTL' else 'NULL' end as origin from part),
acalls as (
  select label + 1 as chr, vec_id * 1000 + 1 as pos, i - 1 as sample_id,
         cast(cast(floor(abs(cast(embedding[i] as double)) * 16) as bigint) % 3 as double) as dosage
  from embeddings, unnest(range(1, len(embedding) + 1)) as u(i)),
atrait as (
  select i - 1 as ordinal, cast(sum(cast(floor(cast(embedding[i] as double) * 1000) as bigint) * (label - 4)) as double) / 1000 as y
  from embeddings, unnest(range(1, len(embedding) + 1)) as u(i) group by i)
"""
