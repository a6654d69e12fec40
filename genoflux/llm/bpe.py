"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pieces of the corpus are counted by a Spark aggregation.  Those of a
partition form one long token sequence; an inverted index gives, for each token pair,
the positions where it stands.  The merges are replayed in rank order; each one visits
only its own positions and enters the pairs it makes with the two neighbours.  So a
piece is replayed once, whatever the number of documents and tasks that hold it.

The ids go back to the tasks that assemble documents as a broadcast table of bounded
size: all pieces of the corpus or, beyond the bound, the most frequent ones.  The
others are then replayed, in the same way, by the tasks that meet them.
"""

from __future__ import annotations

import base64
from collections import Counter
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, flat_utf8, slices
from .pieces import PieceTable, Splitter

_ENCODED = "doc_id long, n_tokens long, ids binary"


def read_ranks(lines) -> dict[bytes, int]:
    """Token bytes and ranks from lines of base64 and rank."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class MergeReplay:
    """Encodes many pieces at once; each must be non-empty bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        keys, made = [], []
        for name, rank in ranks.items():
            for i in range(1, len(name)):
                left, right = ranks.get(name[:i]), ranks.get(name[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    made.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], 2**62)
        self.made = np.append(np.array(made, np.int64)[order], -1)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair forms, -1 for none; tokens below 0 form none."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.made[at], -1)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of tokens of each word, and the ids in a row."""
        known = np.array([self.ranks.get(w, -1) for w in words], np.int64)
        rest = [w for w, r in zip(words, known.tolist(), strict=True) if r < 0]
        counts = np.ones(len(words), np.int64)
        if not rest:
            return counts, known.astype(np.uint32)
        made_counts, made = self._replay(rest)
        counts[known < 0] = made_counts
        out = np.empty(int(counts.sum()), np.uint32)
        is_made = np.repeat(known < 0, counts)
        out[is_made] = made
        out[~is_made] = known[known >= 0]
        return counts, out

    def _replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # token -1 stands before, between and after the words, -2 where one was merged away
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        tokens = np.full(int(ends[-1]) + 1, -1, np.int64)
        inner = np.ones(len(tokens), bool)
        inner[0] = False
        inner[ends] = False
        tokens[inner] = self.single[np.frombuffer(b"".join(words), np.uint8)]
        after, before = np.arange(1, len(tokens) + 1), np.arange(-1, len(tokens) - 1)
        where: dict[int, list[np.ndarray]] = {}  # positions of a token pair
        pairs: dict[int, list[int]] = {}  # those that a rank merges: equal ranks take turns from the left
        heap: list[int] = []

        def enter(positions, ranks):
            found = ranks >= 0
            positions, ranks = positions[found], ranks[found]
            if not len(positions):
                return
            pair = tokens[positions] << 32 | tokens[after[positions]]
            order = np.argsort(pair, kind="stable")
            positions, ranks, pair = positions[order], ranks[order], pair[order]
            bounds = [0, *(np.flatnonzero(pair[1:] != pair[:-1]) + 1).tolist(), len(pair)]
            for key, rank, a, b in zip(pair[bounds[:-1]].tolist(), ranks[bounds[:-1]].tolist(), bounds, bounds[1:], strict=False):
                if key not in where:
                    where[key] = []
                    if rank not in pairs:
                        pairs[rank] = []
                        heappush(heap, rank)
                    pairs[rank].append(key)
                where[key].append(positions[a:b])

        enter(np.arange(len(tokens) - 1), self.pair_ranks(tokens[:-1], tokens[1:]))
        while heap:
            rank = heappop(heap)
            lists = [x for key in pairs.pop(rank) for x in where.pop(key)]
            at = lists[0]
            if len(lists) > 1 or not (at[1:] > at[:-1]).all():
                at = np.unique(np.concatenate(lists))
            left, j = tokens[at], after[at]
            stands = self.pair_ranks(left, tokens[j]) == rank  # a neighbour may have changed
            if not stands.all():
                at, j = at[stands], j[stands]
            if not len(at):
                continue
            if len(at) > 1 and (j[:-1] == at[1:]).any():  # overlapping pairs: the leftmost wins
                keep, taken = [], -1
                for i, k in zip(at.tolist(), j.tolist(), strict=True):
                    if i != taken:
                        keep.append(i)
                        taken = k
                at = np.array(keep)
                j = after[at]
            k, h = after[j], before[at]
            tokens[at], tokens[j] = rank, -2
            after[at], before[k] = k, at
            rows = np.concatenate([h, at])
            enter(rows, self.pair_ranks(tokens[rows], tokens[after[rows]]))
        alive = np.concatenate([[0], np.cumsum(tokens >= 0)])
        bounds = alive[np.concatenate([[0], ends])]
        return np.diff(bounds), tokens[tokens >= 0].astype(np.uint32)


def distinct_pieces(docs: DataFrame, pattern: str, most: int = 400_000, longest: int | None = None) -> DataFrame:
    """piece and n: the distinct matches of the pattern in all texts (of ``longest`` code
    points at most), and how often each occurs; counted within tasks first, at most
    ``most`` at a time."""

    def run(batches):
        split, found = Splitter(pattern), Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["piece", "n"])

        for batch in batches:
            raw, bounds = flat_utf8(batch["text"])
            for a, b in slices(bounds, 1 << 20):
                pieces = split([raw[bounds[i] : bounds[i + 1]].tobytes().decode() for i in range(a, b)])[0]
                found.update(pieces if longest is None else (p for p in pieces if len(p) <= longest))
                if len(found) > most:
                    yield rows()
                    found.clear()
        yield rows()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def replayed(pieces: DataFrame, held, most_bytes: int = 1 << 20) -> DataFrame:
    """piece, n and ids (little-endian unsigned 32-bit) of a table of distinct pieces.

    The pieces of a partition are one sequence with one index, replayed once; where they are
    more than ``most_bytes`` (an index takes some 50 times that), once for each so many."""

    def run(batches):
        replay, waiting, size = None, [], 0

        def done():
            nonlocal replay
            replay = replay or MergeReplay(held.value)
            table = pa.Table.from_batches(waiting).combine_chunks()
            counts, flat = replay(pc.cast(table["piece"], pa.binary()).to_pylist())
            made = table.append_column("ids", binary_rows(flat.astype("<u4"), counts * 4))
            return made.to_batches(max_chunksize=10_000)

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                size += batch["piece"].nbytes
            if size > most_bytes:
                yield from done()
                waiting, size = [], 0
        if waiting:
            yield from done()

    return pieces.mapInArrow(run, "piece string, n long, ids binary")


def most_frequent(pieces: DataFrame, most: int) -> DataFrame:
    """The rows of ``pieces`` (n: at least 1) above the least count that leaves at most ``most`` of them.

    Counts are compared in steps of an eighth of a power of two, of which there are at most
    some 500, so no rows are ordered in one place."""
    step = F.floor(F.log2("n") * 8)
    least, total = None, 0
    for row in sorted(pieces.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        total += row["count"]
        if total > most:
            break
        least = row["step"]
    return pieces.where(F.lit(False) if least is None else step >= least)


def encode(docs: DataFrame, ranks_path: str, pattern: str, most: int = 300_000, longest: int = 128) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit) of each row's text.

    Null and empty texts have no ids.  Rows keep their doc_id, null or repeated;
    other columns are not read.  Documents never leave their task, so only distinct
    pieces are shuffled; ``ranks_path`` is a vocabulary file of fixed size that the
    driver opens.  At most ``most`` pieces of ``longest`` bytes or less are broadcast with
    their ids, so their bytes are bounded too; longer ones, a text without a break among
    them, are replayed where they stand.  That changes the work, never the result.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(_vocabulary(ranks_path))
    found = cut(replayed(distinct_pieces(docs, pattern, longest=longest), held))
    found = found.where(F.octet_length("piece") <= longest)
    found = most_frequent(found, most)
    rows = found.select("piece", "ids").toArrow()
    ids, bounds = flat_binary(rows["ids"])
    common = spark.sparkContext.broadcast((rows["piece"].to_pylist(), np.diff(bounds) // 4, ids.view("<u4").astype(np.uint32)))

    def run(batches):
        replay = None

        def others(words):
            nonlocal replay
            replay = replay or MergeReplay(held.value)
            return replay([w.encode() for w in words])

        table = PieceTable(pattern, others, known=common.value)
        for batch in batches:
            raw, bounds = flat_utf8(batch["text"])
            for first, last in slices(bounds, 16 << 20):
                parts = [(first + a, first + b) for a, b in slices(bounds[first : last + 1], 1 << 20)]
                texts = ([raw[bounds[i] : bounds[i + 1]].tobytes().decode() for i in range(a, b)] for a, b in parts)
                for (a, b), (ids, counts) in zip(parts, table.blocks(texts), strict=True):
                    yield pa.RecordBatch.from_arrays(
                        [batch["doc_id"].slice(a, b - a).cast(pa.int64()), pa.array(counts, pa.int64()), binary_rows(ids.astype("<u4"), counts * 4)],
                        ["doc_id", "n_tokens", "ids"],
                    )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _ENCODED)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds ``decoded``, the bytes that the ids stand for, to doc_id, n_tokens and ids.

    Null ids decode to no bytes; an id without a token is an error."""
    spark = encoded.sparkSession
    held = spark.sparkContext.broadcast(_vocabulary(ranks_path))

    def run(batches):
        names = sorted(held.value.items(), key=lambda x: x[1])
        at = np.zeros(names[-1][1] + 2, np.int64)
        for name, rank in names:
            at[rank + 1] = len(name)
        sizes = at[1:].copy()
        at, letters = np.cumsum(at), np.frombuffer(b"".join(k for k, _ in names), np.uint8)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                rows = batch.slice(start, 512)
                cells = [x or b"" for x in rows["ids"].to_pylist()]
                texts = []
                for cell in cells:
                    ids = np.frombuffer(cell, "<u4")
                    texts.append(_letters(ids, at, sizes, letters))
                yield pa.RecordBatch.from_arrays([rows["doc_id"], rows["n_tokens"], rows["ids"], pa.array(texts, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, _ENCODED + ", decoded binary")


def _letters(ids: np.ndarray, at: np.ndarray, sizes: np.ndarray, letters: np.ndarray, step: int = 1 << 18) -> bytes:
    parts = []
    for s in range(0, len(ids), step):
        own = ids[s : s + step]
        size = sizes[own]
        if not size.all():
            raise ValueError("an id has no token")
        ends = np.cumsum(size)
        parts.append(letters[np.repeat(at[own] - ends + size, size) + np.arange(int(ends[-1]))].tobytes())
    return b"".join(parts)


def binary_rows(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column over one buffer; ``sizes`` are in bytes."""
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(values.tobytes())])


def flat_binary(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column and the row bounds in them."""
    cells = column.to_pylist()
    return np.frombuffer(b"".join(cells), np.uint8), np.concatenate([[0], np.cumsum(np.fromiter(map(len, cells), np.int64, len(cells)))])


def _vocabulary(path: str) -> dict[bytes, int]:
    """The ranks; a vocabulary is of fixed size, whatever the corpus is."""
    with open(path, "rb") as f:
        return read_ranks(f)
