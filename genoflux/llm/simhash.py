"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints that differ in at most ``radius`` bits agree in all but ``radius`` of
any blocks of bits, so each is entered in a bucket for every choice of agreeing
blocks.  Within a bucket the fingerprints stand vertically: one bit plane for each
of the 64 bits, 64 of them in a word.  Carry-save counters, a few words wide, add
the planes' differences for all of them at once, and rows of words are abandoned
once every counter in them has passed the radius.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, flat_utf8, join_groups
from .components import components

SEED = 42
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_LANES = 1 << 16


def fingerprint(text: bytes, width: int = 3, seeds: tuple[int, ...] = (SEED,), step: int = 1 << 17) -> list[int]:
    """64-bit SimHash of the shingles of one text (UTF-8), repeats included, for each seed.

    Bit i is set if more than half of the shingles' XXH64 have it set.  Fewer
    words than ``width`` make one shingle; no words give 0."""
    words = text.lower().split()
    if not words:
        return [0] * len(seeds)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    counts = np.zeros((len(seeds), 64), np.int64)
    for a in range(0, n, step):
        b = min(n, a + step)
        first, last = starts[a:b].tolist(), ends[min(a + width, len(words)) - 1 :][: b - a].tolist()
        shingles = [joined[s:e] for s, e in zip(first, last, strict=True)]
        for i, seed in enumerate(seeds):
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, b - a)
            counts[i] += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return [int.from_bytes(np.packbits(c * 2 > n, bitorder="little").tobytes(), "little") for c in counts]


def fingerprints(docs: DataFrame, width: int = 3, second: bool = False) -> DataFrame:
    """doc_id, fp and other (signed 64-bit integers) of each row; null texts count as
    empty.  ``other`` is a second fingerprint, with another seed, or 0."""
    seeds = (SEED, SEED + 1) if second else (SEED,)

    def run(batches):
        for batch in batches:
            raw, bounds = flat_utf8(batch["text"])
            made = [fingerprint(raw[a:b].tobytes(), width, seeds) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            found = np.array(made, np.uint64).reshape(-1, len(seeds)).view(np.int64)
            other = found[:, 1] if second else np.zeros(len(found), np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found[:, 0].copy()), pa.array(other.copy())], ["doc_id", "fp", "other"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long, other long")


class Counter:
    """Counts up to ``radius`` in each bit lane, in carry-save form; above, a sticky bit."""

    def __init__(self, shape, radius: int):
        self.digits = [np.zeros(shape, np.uint64) for _ in range((radius + 1).bit_length())]
        self.over = np.zeros(shape, np.uint64)
        self.limit = radius + 1

    def add(self, lanes: np.ndarray) -> None:
        for digit in self.digits:
            lanes, digit[...] = digit & lanes, digit ^ lanes
        self.over |= lanes

    def passed(self) -> np.ndarray:
        """Lanes whose count is above the radius: the digits, read as a number, reach the limit."""
        above, equal = np.zeros_like(self.over), np.full_like(self.over, _FULL)
        for place in reversed(range(len(self.digits))):
            digit = self.digits[place]
            if self.limit >> place & 1:
                equal &= digit
            else:
                above |= equal & digit
                equal &= ~digit
        return self.over | above | equal

    def keep(self, rows: np.ndarray) -> None:
        self.digits = [d[rows] for d in self.digits]
        self.over = self.over[rows]

    def pick(self, lanes: np.ndarray, n: int) -> None:
        """Of a row of n lanes, those named, close together."""
        *self.digits, self.over = (_packed(_lanes(d[None, :], n)[0][lanes]) for d in (*self.digits, self.over))


def planes(values: np.ndarray) -> np.ndarray:
    """64 bit planes of 64-bit values; lane i of a plane is value i."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _packed(bits: np.ndarray) -> np.ndarray:
    padded = np.zeros(-(-len(bits) // 64) * 64, bool)
    padded[: len(bits)] = bits
    return np.packbits(padded, bitorder="little").view(np.uint64)


def _lanes(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")[:, :n].astype(bool)


def _rows(values: np.ndarray) -> np.ndarray:
    return values if values.ndim == 2 else values[:, None]


def all_planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of rows of 64-bit words, one word after another."""
    return np.concatenate([planes(values[:, i]) for i in range(values.shape[1])])


def close_to(queries: np.ndarray, values: np.ndarray, radius: int, sliced: np.ndarray | None = None) -> np.ndarray:
    """Boolean matrix: which values are within ``radius`` bits of each query.  Both are
    64-bit values or rows of them."""
    queries, values = _rows(queries), _rows(values)
    sliced = all_planes(values) if sliced is None else sliced
    close = np.zeros((len(queries), len(values)), bool)
    if not close.size:
        return close
    rows, counter = np.arange(len(queries)), Counter((len(queries), sliced.shape[1]), radius)
    for bit in range(len(sliced)):
        flip = np.where(queries[rows, bit // 64] >> np.uint64(bit % 64) & np.uint64(1), _FULL, np.uint64(0))
        counter.add(sliced[bit][None, :] ^ flip[:, None])
        if bit % 8 == 7:
            alive = ~(counter.passed() == _FULL).all(1)
            if not alive.all():
                rows = rows[alive]
                counter.keep(alive)
                if not len(rows):
                    return close
    close[rows] = ~_lanes(counter.passed(), len(values))
    return close


def close_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """For pairs of values (or rows of them), lane by lane: are they within ``radius`` bits?
    Lanes that have passed it after a word are given up."""
    left, right = _rows(left), _rows(right)
    found = np.zeros(len(left), bool)
    for a in range(0, len(left), _LANES):
        alive = np.arange(a, min(a + _LANES, len(left)))
        counter = Counter(-(-len(alive) // 64), radius)
        for word in range(left.shape[1]):
            for plane in planes(left[alive, word] ^ right[alive, word]):
                counter.add(plane)
            near = ~_lanes(counter.passed()[None, :], len(alive))[0]
            if not near.all():
                counter.pick(near, len(alive))
                alive = alive[near]
            if not len(alive):
                break
        found[alive] = True
    return found


def _forest(values: np.ndarray, others: np.ndarray, radius: int, other_radius: int | None, block: int = 256) -> list[tuple[int, int]]:
    """Edges that connect what is connected within the radius, at most n - 1."""
    n, edges = len(values), []
    label, sliced = np.arange(n), planes(values)
    for a in range(0, n, block):
        close = close_to(values[a : a + block], values, radius, sliced)
        if other_radius is not None:
            i, j = np.nonzero(close)
            far = ~close_pairs(others[i + a], others[j], other_radius)
            close[i[far], j[far]] = False
        for i in (np.flatnonzero(close.sum(1) > 1) + a).tolist():
            near = np.flatnonzero(close[i - a])
            labels = np.unique(label[near])
            if len(labels) > 1:
                edges += [(i, int(near[np.argmax(label[near] == x)])) for x in labels if x != label[i]]
                label[np.isin(label, labels)] = labels[0]
    return edges


def _link(bucket: np.ndarray, values: np.ndarray, others: np.ndarray, radius: int, other_radius: int | None, small: int = 48):
    """Indexes of pairs of linked values within runs of equal bucket numbers (sorted)."""
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    sizes = np.diff(np.append(starts, len(bucket)))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in np.unique(sizes[(sizes > 1) & (sizes <= small)]).tolist():  # pairs of all small buckets as lanes
        first = starts[sizes == size]
        i, j = np.triu_indices(size, 1)
        for a in range(0, len(first), max(1, _LANES // len(i))):
            own = first[a : a + max(1, _LANES // len(i)), None]
            x, y = (own + i).ravel(), (own + j).ravel()
            close = close_pairs(values[x], values[y], radius)
            x, y = x[close], y[close]
            if other_radius is not None:
                close = close_pairs(others[x], others[y], other_radius)
                x, y = x[close], y[close]
            left.append(x)
            right.append(y)
    for s, size in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
        pairs = np.array(_forest(values[s : s + size], others[s : s + size], radius, other_radius), np.int64).reshape(-1, 2) + s
        left.append(pairs[:, 0])
        right.append(pairs[:, 1])
    return np.concatenate(left), np.concatenate(right)


def block_keys(fp, blocks: int, agree: int):
    """One struct of table and key for each choice of ``agree`` of the blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    whole = [sum(masks[i] for i in chosen) for chosen in combinations(range(blocks), agree)]
    signed = [m - (1 << 64) if m >> 63 else m for m in whole]
    return F.array(*[F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(signed)])


def links(nodes: DataFrame, radius: int = 2, blocks: int = 4, other_radius: int | None = None, tile: int = 4096) -> DataFrame:
    """Edges a, b between nodes (columns node, fp, other; node names a distinct pair of
    fp and other) that connect all those whose fp differ in at most ``radius`` bits, and
    whose other differ in at most ``other_radius``, directly or over others.

    Every pair within the radius shares a bucket of one of the tables (blocks
    choose blocks - radius); how many blocks there are changes the work only.  A
    bucket of more than ``tile`` nodes is dealt over tiles, and each pair of tiles
    is compared by a task of its own, so no task holds more than two tiles.  A
    bucket gives a spanning forest, or the close pairs of at most 48 nodes, never
    all pairs.
    """
    if radius >= blocks:
        raise ValueError("more blocks than differing bits are needed")
    rows = cut(nodes.select("node", "fp", "other", F.explode(block_keys(F.col("fp"), blocks, blocks - radius)).alias("x")))
    counts = cut(rows.groupBy("x").agg(F.count("*").alias("n")).where("n > 1"))
    rows = join_groups(rows, counts, "x", "n").select("node", "fp", "other", "x.t", "x.key", "n")
    parts = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    own = F.pmod(F.xxhash64(F.lit(7), "node"), F.col("parts")).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.select("node", "fp", "other", "t", "key", "own", other.alias("next"))
    bucket = F.xxhash64("t", "key", F.least("own", "next"), F.greatest("own", "next"))
    rows = rows.select("node", "fp", "other", bucket.alias("bucket"))

    def run(batches):
        bucket, node, fp, other = (np.zeros(0, np.int64) for _ in range(4))

        def made(end):
            x, y = _link(bucket[:end], fp[:end].view(np.uint64), other[:end].view(np.uint64), radius, other_radius)
            return pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y])], ["a", "b"])

        for batch in batches:
            bucket, node, fp, other = (np.concatenate([x, batch[k].to_numpy()]) for x, k in ((bucket, "bucket"), (node, "node"), (fp, "fp"), (other, "other")))
            whole = int(np.searchsorted(bucket, bucket[-1])) if len(bucket) else 0  # the last may go on
            if whole > 10_000:
                yield made(whole)
                bucket, node, fp, other = (x[whole:] for x in (bucket, node, fp, other))
        if len(bucket):
            yield made(len(bucket))

    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long")


def classes(prints: DataFrame, radius: int = 2, blocks: int = 4, other_radius: int | None = None) -> DataFrame:
    """doc_id, fp and component_id of rows of doc_id, fp and other.

    component_id is the smallest doc_id that can be reached over links (see
    ``links``), a document's own included (null only if no document of the component
    has an id).  Equal fingerprints are one node, so copies are never paired.
    """
    node = F.col("fp") if other_radius is None else F.xxhash64("fp", "other")
    prints = prints.withColumn("node", node)
    distinct = cut(prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp"), F.min("other").alias("other"), F.count("*").alias("n")))
    roots = components(links(distinct.select("node", "fp", "other"), radius, blocks, other_radius))
    owners = cut(distinct.select("node", "least", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = cut(owners.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")))
    found = cut(join_groups(owners, least, "root", "members").select("node", "n", "component_id"))
    return join_groups(prints, found, "node", "n").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, blocks: int = 4, other_radius: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fp, component_id (see ``classes``).

    Words are lower-cased in A-Z only.  Texts without words (null, empty, blank)
    have fingerprint 0 and link like any other.  A larger radius finds weaker
    copies but also meets chance, which grows with the corpus; ``other_radius``
    bounds the difference of a second fingerprint as well.  Only doc_id and text
    are read.
    """
    return classes(cut(fingerprints(docs, width, other_radius is not None)), radius, blocks, other_radius)
