"""Near copies by exact shingle similarity; SimHash bits only propose the pairs.

A row's distinct shingles give 256 SimHash bits.  At a similarity of 0.8 a bit differs
with probability 0.15, so one of many samples of bits very likely agrees: each sample is
a table of buckets.  Pairs of one bucket within a wide radius, by the bit-sliced counters
of ``simhash``, are close; a bucket gives edges that connect what is close in it, never
all pairs.  Keys take a few bits less than the logarithm of the rows, so buckets keep
their size as the corpus grows, and there are more tables instead: work grows with the
power 1.24 of the rows, not with their square.

Components of these edges are clusters: no pair at 0.8 that shares a bucket lies in two
of them.  Within a cluster all close pairs are decided by their sets of shingles, as
64-bit hashes, in tasks that hold two tiles of it; they too give edges that connect.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, flat_utf8, kept_table
from .components import components
from .simhash import all_planes, close_pairs, close_to

WORDS = 4
#: Bits of a key at least; rows to a bucket of random keys; the share of pairs at 0.8 that
#: would meet in no table if tables were independent.  They sample the same 256 bits, so more
#: do: of 12,000 pairs of 180 shingles 0.0013 at the tables of 10^5 rows, 0.0085 at those of 10^7
#: and 0.0228 at those of 10^9.
LEAST_BITS, PER_BUCKET, MISSED = 14, 8, 1e-4
#: Bits of 256; at 0.8 the mean is 39 and the deviation 6, for very short texts 48 and 6.
RADIUS = 64
_SMALL = 32
#: Nodes, and shingles, of a tile of a cluster.
TILE, TILE_SHINGLES = 1024, 1 << 20
#: Rows (of 8 bytes) up to which a list of rows is broadcast.
MOST_BROADCAST = 1_000_000
_STEPS = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_SKETCH = "row long, doc_id long, node long, n int, " + ", ".join(f"f{i} long" for i in range(WORDS))


def shingles(text: bytes, width: int) -> set[bytes]:
    """Distinct shingles of a text (UTF-8); fewer words than ``width`` make one."""
    words = text.lower().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def hashed(text: bytes, width: int) -> np.ndarray:
    """Ascending hashes of the distinct shingles."""
    found = shingles(text, width)
    return np.sort(np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sketch(text: bytes, width: int, step: int = 1 << 15) -> tuple[int, int, np.ndarray]:
    """Name of the set of shingles, its size, and its SimHash bits as words."""
    hashes = hashed(text, width)
    counts = np.zeros((WORDS, 64), np.int64)
    for a in range(0, len(hashes), step):
        for i in range(WORDS):
            own = _mixed(hashes[a : a + step] + _STEPS[i])
            counts[i] += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    bits = np.packbits(counts * 2 > len(hashes), axis=1, bitorder="little").view(np.uint64).ravel()
    return xxhash.xxh64_intdigest(hashes.tobytes()), len(hashes), bits


def sketches(rows: DataFrame, width: int) -> DataFrame:
    """row, doc_id, node, n and the bits of rows of row, doc_id and text; null counts as empty."""

    def run(batches):
        for batch in batches:
            raw, bounds = flat_utf8(batch["text"])
            made = [sketch(raw[a:b].tobytes(), width) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            bits = np.array([x[2] for x in made], np.uint64).reshape(-1, WORDS).view(np.int64)
            node = np.array([x[0] for x in made], np.uint64).view(np.int64)
            columns = [batch["row"], batch["doc_id"], pa.array(node), pa.array([x[1] for x in made], pa.int32()), *(pa.array(bits[:, i].copy()) for i in range(WORDS))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "node", "n", *(f"f{i}" for i in range(WORDS))])

    return rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SKETCH)


def tables_for(rows: int) -> tuple[int, int]:
    """Number of tables and bits of a key for so many rows."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(rows, 1) / PER_BUCKET)))
    agree = (1 - math.acos(8 / 9) / math.pi) ** bits  # sets of one size at 0.8: a cosine of 8 / 9
    return math.ceil(math.log(MISSED) / math.log1p(-agree)), bits


def _samples(tables: int, bits: int) -> np.ndarray:
    """Places of the bits of each table's key; all bits are used about equally often."""
    rng, per = np.random.default_rng(11), 64 * WORDS // bits
    dealt = [rng.permutation(64 * WORDS)[: per * bits].reshape(per, bits) for _ in range(-(-tables // per))]
    return np.concatenate(dealt)[:tables]


def bucket_numbers(words: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """Bucket of each row of words in each table; the table is its upper part."""
    flat = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")
    out = np.empty((len(words), tables), np.int64)
    for t, places in enumerate(_samples(tables, bits)):
        out[:, t] = flat[:, places] @ (1 << np.arange(bits, dtype=np.int64)) + (t << bits)
    return out


def _entries(nodes: DataFrame, tables: int, bits: int) -> DataFrame:
    """Each node in the bucket of every table: bucket, node, n and the bits."""
    names = ["node", "n", *(f"f{i}" for i in range(WORDS))]

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                bucket = bucket_numbers(np.column_stack([part[f"f{i}"].to_numpy() for i in range(WORDS)]), tables, bits)
                columns = [pa.array(np.repeat(part[k].to_numpy(), tables)) for k in names]
                yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel()), *columns], ["bucket", *names])

    return nodes.select(names).mapInArrow(run, "bucket long, node long, n int, " + ", ".join(f"f{i} long" for i in range(WORDS)))


def _like_sized(n, x, y, share) -> np.ndarray:
    """Do the sizes of two sets allow the similarity?"""
    a, b = n[x].astype(np.int64), n[y].astype(np.int64)
    return np.minimum(a, b) * share[1] >= np.maximum(a, b) * share[0]


def connect(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Joins the labels of the ends of edges, in place; a label is the smallest index."""
    while True:
        own = label[x] != label[y]
        x, y = x[own], y[own]
        if not len(x):
            return
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], least)
        np.minimum.at(label, label[y], least)
        while (label[label] != label).any():
            label[:] = label[label]


def _linked(bucket, node, n, bits, share):
    """Edges that connect the close pairs of each bucket (sorted), over all its nodes."""
    names, at = np.unique(node, return_inverse=True)
    label = np.arange(len(names))
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    sizes = np.diff(np.append(starts, len(bucket)))

    def join(x, y):
        own = _like_sized(n, x, y, share) & (label[at[x]] != label[at[y]])
        x, y = x[own], y[own]
        near = close_pairs(bits[x], bits[y], RADIUS)
        connect(label, at[x[near]], at[y[near]])

    for size in np.unique(sizes[(sizes > 1) & (sizes <= _SMALL)]).tolist():
        first = starts[sizes == size]
        i, j = np.triu_indices(size, 1)
        each = max(1, (1 << 16) // len(i))
        for a in range(0, len(first), each):
            join((first[a : a + each, None] + i).ravel(), (first[a : a + each, None] + j).ravel())
    for s, size in zip(starts[sizes > _SMALL].tolist(), sizes[sizes > _SMALL].tolist(), strict=True):
        sliced = all_planes(bits[s : s + size])
        for a in range(0, size, 128):
            i, j = np.nonzero(close_to(bits[s + a : s + min(size, a + 128)], bits[s : s + size], RADIUS, sliced))
            x, y = s + a + i, s + j
            own = (x < y) & _like_sized(n, x, y, share)
            connect(label, at[x[own]], at[y[own]])
    moved = np.flatnonzero(label != np.arange(len(label)))
    return names[label[moved]], names[moved]


def _in_groups(batches, key: str, made, most: int, kinds: dict):
    """Results of ``made`` for whole runs of equal keys, some ``most`` rows at a time."""
    held = {k: [np.zeros(0, kind)] for k, kind in kinds.items()}
    rows = 0
    for batch in batches:
        for k in kinds:
            held[k].append(batch[k].to_numpy(zero_copy_only=False))
        rows += batch.num_rows
        if rows > most:
            held = {k: [np.concatenate(v)] for k, v in held.items()}
            own = held[key][0]
            whole = int(np.flatnonzero(own == own[-1])[0])
            if whole:
                yield from made({k: v[0][:whole] for k, v in held.items()})
                held = {k: [v[0][whole:]] for k, v in held.items()}
                rows -= whole
    if rows:
        yield from made({k: np.concatenate(v) for k, v in held.items()})


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def proposals(nodes: DataFrame, share: tuple[int, int], tile: int = 4096) -> DataFrame:
    """Edges a, b that connect nodes (node, n and bits) that share a bucket and are close.

    A bucket of more than ``tile`` nodes is dealt over pairs of tiles, a task each."""
    tables, bits = tables_for(nodes.count())
    rows = _entries(nodes, tables, bits)
    hot = cut(rows.groupBy("bucket").count().where(F.col("count") > tile))
    parts = F.coalesce(F.ceil(F.col("count") / F.lit(tile)), F.lit(1)).cast("int")
    rows = rows.join(few(hot), "bucket", "left").withColumn("parts", parts)  # at most tables * nodes / tile of them
    own, other = F.pmod(F.xxhash64(F.lit(7), "node"), F.col("parts")), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    kept = ["node", "n", *(f"f{i}" for i in range(WORDS))]
    rows = rows.withColumn("own", own).select("bucket", "own", "parts", *kept, other.alias("next"))
    # buckets whose names clash are compared together, which finds no less
    bucket = F.when(F.col("parts") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("own", "next"), F.greatest("own", "next")))
    rows = rows.select(bucket.alias("bucket"), *kept)

    def run(batches):
        def made(held):
            bits = np.column_stack([held[f"f{i}"].view(np.uint64) for i in range(WORDS)])
            yield _edges(*_linked(held["bucket"], held["node"], held["n"], bits, share))

        yield from _in_groups(batches, "bucket", made, 50_000, {k: np.int32 if k == "n" else np.int64 for k in ("bucket", *kept)})

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long")


def few(rows: DataFrame) -> DataFrame:
    """A list of rows, broadcast up to a bound."""
    return F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows


def _common(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets: bits of the shingles that several hold."""
    names, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    several = np.bincount(at, minlength=len(names)) > 1
    column = np.cumsum(several) - 1
    use = several[at]
    owner, at = owner[use], column[at[use]]
    total, out = int(several.sum()), np.zeros(len(x), np.int64)
    for s in range(0, total, 1 << 12):  # bits of so many shingles at a time
        own = (at >= s) & (at < s + (1 << 12))
        held = np.zeros((len(sets), 1 << 12), bool)
        held[owner[own], at[own] - s] = True
        words = np.packbits(held, axis=1).view(np.uint64)
        words = words[:, : -(-(min(total - s, 1 << 12)) // 64)]
        for a in range(0, len(x), 1 << 14):
            i, j = x[a : a + (1 << 14)], y[a : a + (1 << 14)]
            out[a : a + (1 << 14)] += np.bitwise_count(words[i] & words[j]).sum(1, dtype=np.int64)
    return out


def _decided(node, tile, bits, sets, share):
    """Edges that connect the similar pairs of a group: of one tile, or between two."""
    n, label, two = np.array([len(s) for s in sets]), np.arange(len(node)), tile.min() != tile.max()
    step = max(1, (1 << 18) // len(node))
    for a in range(0, len(node), step):
        x, y = np.nonzero(close_to(bits[a : a + step], bits, RADIUS))
        x += a
        own = (x < y) & _like_sized(n, x, y, share) & (label[x] != label[y])
        if two:
            own &= tile[x] != tile[y]
        x, y = x[own], y[own]
        if len(x):
            both = _common(sets, x, y)
            similar = both * share[1] >= share[0] * (n[x] + n[y] - both)
            connect(label, x[similar], y[similar])
    moved = np.flatnonzero(label != np.arange(len(label)))
    return node[label[moved]], node[moved]


def decided(members: DataFrame, width: int, share: tuple[int, int], tile: int = TILE) -> DataFrame:
    """Edges a, b that connect nodes of one cluster whose texts have the similarity.

    ``members``: cluster, node, n, text and the bits.  A cluster of more than ``tile``
    nodes, or many shingles, is dealt over pairs of tiles, so a task holds two tiles."""
    counts = members.groupBy("cluster").agg(F.count("*").alias("k"), F.sum("n").alias("s"))
    large = counts.where((F.col("k") > tile) | (F.col("s") > TILE_SHINGLES))
    parts = F.greatest(F.ceil(F.col("k") / tile), F.ceil(F.col("s") / TILE_SHINGLES), F.lit(1)).cast("int")
    large = large.select("cluster", F.least(parts, F.col("k")).cast("int").alias("parts"))
    rows = members.join(few(cut(large)), "cluster", "left")
    rows = rows.withColumn("parts", F.coalesce("parts", F.lit(1)))
    bits = [f"f{i}" for i in range(WORDS)]

    def sets(batches):
        for batch in batches:
            raw, bounds = flat_utf8(batch["text"])
            found = [hashed(raw[a:b].tobytes(), width).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in ("cluster", "node", "parts", *bits)), pa.array(found, pa.binary())], ["cluster", "node", "parts", *bits, "set"])

    typed = "cluster long, node long, parts int, " + ", ".join(f"{f} long" for f in bits) + ", set binary"
    rows = rows.select("cluster", "node", "parts", *bits, "text").mapInArrow(sets, typed)
    own, other = F.pmod(F.xxhash64(F.lit(9), "node"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.withColumn("own", own).withColumn("next", other)
    group = F.xxhash64("cluster", F.least("own", "next"), F.greatest("own", "next"))
    rows = rows.select(group.alias("group"), "own", "node", *bits, "set")

    def run(batches):
        def made(held):
            words = np.column_stack([held[f].view(np.uint64) for f in bits])
            starts = np.flatnonzero(np.concatenate([[True], held["group"][1:] != held["group"][:-1]]))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(words)], strict=True):
                found = [np.frombuffer(x, np.uint64) for x in held["set"][a:b]]
                yield _edges(*_decided(held["node"][a:b], held["own"][a:b], words[a:b], found, share))

        yield from _in_groups(batches, "group", made, 2048, {"group": np.int64, "own": np.int32, "node": np.int64, **{f: np.int64 for f in bits}, "set": object})

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "group").sortWithinPartitions("group").mapInArrow(run, "a long, b long")


def surplus(rows: DataFrame, width: int = 5, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """Column row of those rows (row, unique; doc_id; text; a table that was written) that
    stand in a component of near copies behind another one.

    Rows are linked if their sets of shingles have a Jaccard similarity of ``share`` or
    more; those without words are equal.  The smallest doc_id of a component stays, null
    last, of its rows the one with the smallest row.  No step makes a row for each pair.
    """
    made = kept_table(sketches(rows, width), "sketches")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    bits = [f"f{i}" for i in range(WORDS)]
    nodes = cut(made.groupBy("node").agg(F.min(order).alias("best"), F.first("n").alias("n"), *(F.first(f).alias(f) for f in bits)))
    clusters = components(cut(proposals(nodes, share).distinct())).withColumnRenamed("root", "cluster")
    named = cut(nodes.select("node", "n", *bits, F.col("best.row").alias("row")).join(clusters, "node"))
    chosen = few(named.select("row"))
    members = kept_table(rows.select("row", "text").join(chosen, "row", "left_semi").join(named, "row"), "members")
    roots = components(decided(members, width, share))
    owners = nodes.select("node", "best").join(roots, "node", "left")
    kept = owners.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best")).select(F.col("best.row").alias("row"))
    return cut(made.select("row").join(kept, "row", "left_anti"))
