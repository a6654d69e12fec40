"""Helpers shared by the corpus operators: text buffers, group counts, folders."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows without a doc_id sort behind all others where an order is needed.
NO_ID = 2**63 - 1


def flat_utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the row bounds in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(bounds):
        bounds = np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, size: int):
    """Row ranges of about ``size`` bytes each (one row at least)."""
    row, rows = 0, len(bounds) - 1
    while row < rows:
        end = int(np.searchsorted(bounds, bounds[row] + size, "right")) - 1
        end = min(rows, max(row + 1, end))
        yield row, end
        row = end


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts (one scan)."""
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def shares(total: int, each: int, least: int = 1) -> int:
    """How many parts of about ``each`` make up ``total``."""
    return max(least, math.ceil(total / each))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors see.

    Where that is unset a local session takes a temporary folder; on a cluster that is
    an error.
    """
    return f"{_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _checkpoint_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif spark.sparkContext.master.startswith("local"):
            base = f"file://{tempfile.mkdtemp(prefix='genoflux-')}"
        else:  # a folder of this machine is none of the executors'
            raise ValueError("spark.checkpoint.dir is not set")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base


def cut(df: DataFrame) -> DataFrame:
    """Writes a table to the shared checkpoint folder and reads it from there."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def kept_table(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Like ``cut``, as compressed Parquet, for wide binary rows."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_groups(rows: DataFrame, groups: DataFrame, on: str, size: str, share: int = 1000) -> DataFrame:
    """``rows`` joined to one row a group (column ``on``, never null; ``size``: its rows).

    Groups of more than one row in ``share`` are fewer than ``share``, so those, and
    only those, are broadcast: their rows stay where they are, however many.  The
    others are joined by a shuffle in which none is large.  Both tables are read
    more than once, so they should be cut before.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.where(F.col(size) > total / share)
    rest = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(groups.where(F.col(size) <= total / share), on)
    return rows.join(F.broadcast(hot), on).unionByName(rest)
