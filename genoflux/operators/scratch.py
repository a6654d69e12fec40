"""Cutting lineage, and folders, on storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _base(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  Where that is unset a local session takes a temporary
    one; on a cluster that is an error."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or (held.get() if held.isDefined() else None)
    if base is None and context.master.startswith("local"):
        base = f"file://{tempfile.mkdtemp(prefix='genoflux-')}"
    if base is None:
        raise ValueError("spark.checkpoint.dir is not set")
    if not held.isDefined():
        context.setCheckpointDir(base)
    return base


def cut(df: DataFrame) -> DataFrame:
    """The table, written to the shared folder and read from there."""
    _base(df.sparkSession)
    return df.checkpoint()


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{_base(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
