"""Exact dedup by content-defined chunk recipes.

A text without white space is cut where a rolling hash of its last eight bytes
says so, so equal passages give equal chunks wherever they stand.  A document
becomes a short recipe: the ordered identifiers of its chunks.  Only digests
are shuffled, never texts.  The identifiers are verified: if two chunks with
one identifier differ in their SHA-256, recipes that name it take the SHA-256
instead.  Equal recipes then mean equal texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, flat_utf8, join_groups, kept_table, slices

WHITE = b" \t\n\x0b\x0c\r"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)
_RECIPES = "row long, doc_id long, n_points long, text_sha256 string, recipe binary, proofs array<binary>"
_ENTRY = 12


def chunk_bounds(raw: np.ndarray, average: int, least: int, most: int) -> list[int]:
    """Ends of the chunks of one normalised text; only its content decides."""
    n = len(raw)
    if n <= least:
        return [n] if n else []
    h = raw.astype(np.uint64) + np.uint64(1)
    for step in (1, 2, 4):
        h = (h[:-step] * _ODD) ^ h[step:]
        h ^= h >> _SHIFT
    ends, last = [], 0
    for at in (np.flatnonzero(h % np.uint64(average) == 0) + 8).tolist():
        while at - last > most:
            last += most
            ends.append(last)
        if at - last >= least:
            ends.append(at)
            last = at
    while n - last > most:
        last += most
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def _recipe(text: bytes, average: int, least: int, most: int) -> tuple[str, bytes, list[bytes]]:
    entries, proofs, start = [], [], 0
    for end in chunk_bounds(np.frombuffer(text, np.uint8), average, least, most):
        chunk = text[start:end]
        entries.append(xxhash.xxh64_intdigest(chunk).to_bytes(8, "little") + len(chunk).to_bytes(4, "little"))
        proofs.append(hashlib.sha256(chunk).digest())
        start = end
    return hashlib.sha256(text).hexdigest(), b"".join(entries), proofs


def recipes(docs: DataFrame, row: str | None = None, average: int = 1024, least: int = 256, most: int = 8192) -> DataFrame:
    """row (the column of that name, else 0), doc_id, n_points (code points of the text), text_sha256 (of the text
    without white space), recipe (12 bytes a chunk) and proofs (SHA-256 of each
    chunk).  A null text counts as empty: an empty recipe."""

    def run(batches):
        for batch in batches:
            points = pc.fill_null(pc.utf8_length(batch["text"]), 0)
            raw, bounds = flat_utf8(batch["text"])
            for a, b in slices(bounds, 4 << 20):
                made = [_recipe(raw[bounds[i] : bounds[i + 1]].tobytes().translate(None, WHITE), average, least, most) for i in range(a, b)]
                sha, entries, proofs = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch["row"].slice(a, b - a), batch["doc_id"].slice(a, b - a).cast(pa.int64()), points.slice(a, b - a).cast(pa.int64()), pa.array(sha, pa.string()), pa.array(entries, pa.binary()), pa.array(proofs, pa.list_(pa.binary()))],
                    ["row", "doc_id", "n_points", "text_sha256", "recipe", "proofs"],
                )

    number = F.lit(0) if row is None else F.col(row)
    return docs.select(number.cast("long").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _RECIPES)


def colliding(found: DataFrame) -> DataFrame:
    """Chunk identifiers that stand for more than one content (column entry)."""
    at = F.posexplode("proofs").alias("k", "proof")
    return (
        found.select("recipe", at)
        .select(F.substring("recipe", F.col("k") * _ENTRY + 1, F.lit(_ENTRY)).alias("entry"), "proof")
        .groupBy("entry")
        .agg(F.min("proof").alias("a"), F.max("proof").alias("b"))
        .where("a <> b")
        .select("entry")
    )


def verified(found: DataFrame, clashes: DataFrame) -> DataFrame:
    """Recipes in which identifiers that clash are replaced by SHA-256 digests.

    Each clashing entry becomes 12 zero bytes and the digest, so that no plain
    entry can be taken for it (a chunk of no bytes never occurs)."""
    at = F.posexplode_outer("proofs").alias("k", "proof")
    entry = F.substring("recipe", F.col("k") * _ENTRY + 1, F.lit(_ENTRY))
    rows = found.withColumn("number", F.monotonically_increasing_id())
    rows = kept_table(rows, "recipes")
    parts = rows.select("number", "recipe", at).select("number", "k", "proof", entry.alias("entry"))
    parts = parts.join(clashes.withColumn("clash", F.lit(True)), "entry", "left")
    named = F.when(F.col("clash"), F.concat(F.lit(b"\x00" * _ENTRY), F.col("proof"))).otherwise(F.col("entry"))
    lists = parts.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("k", named.alias("name")))).alias("list"))
    joined = F.aggregate("list", F.lit(b""), lambda s, x: F.concat(s, F.coalesce(x["name"], F.lit(b""))))
    return rows.drop("recipe").join(lists.select("number", joined.alias("recipe")), "number").drop("number")


def exact_duplicates(docs: DataFrame, row: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    With ``row``, the name of a column of unique numbers, also row; then just one row of
    a group is kept, of those that would be kept the one with the smallest number.

    Texts are equal when they are so without the characters space and 0x09 to
    0x0D; null counts as empty, and all empty texts are equal.  The row with the
    most code points stays, of those the one with the smallest doc_id (a null
    doc_id is larger than any).  Rows that repeat a doc_id and its text are
    kept or dropped together.  A hot group meets in one row by partial sums, and that
    row is broadcast to its members.  Other columns of
    ``docs`` are not read.
    """
    found = kept_table(recipes(docs, row), "recipes")
    clashes = colliding(found)
    if clashes.limit(1).count():
        found = verified(found, clashes)
    rows = found.drop("proofs")
    extra = [] if row is None else ["row"]
    order = F.struct((-F.col("n_points")).alias("fewer"), F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))
    groups = rows.groupBy("recipe").agg(F.count("*").alias("group_size"), F.min(order).alias("best")).select("recipe", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row") == F.col("keep_row"))
    return join_groups(rows, cut(groups), "recipe", "group_size").select(*extra, "doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
