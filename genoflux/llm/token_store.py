"""Token ids as directly addressable codes.

An id is split into chunks of ``WIDTH`` bits, lowest first.  Level 0 holds the
first chunk of every id; a level's continuation bitmap says which of its ids go
on, and those have their next chunk in the level above, at the position that the
number of continuation bits before them gives.  A rank directory holds that
number at every ``BLOCK``-th bit, so one id is found by one directory entry and a
popcount of at most one block on each level: no block is decoded.

Segments are rows of a Parquet table, so that any store Spark can write holds
them.  Columns: part, seq (order of the segments), n_tokens, doc_ids (bitmap of
null ids in no_ids), ends (token position behind each document), and levels, a
list of structs of chunks, more (continuation bitmap) and ranks.  All numbers in
binary columns are little-endian: doc_ids and ends 8 bytes, ranks 4, chunks 1.  Pages
are not compressed; the codes are small, and a token needs no decompression.
``token_at`` looks tokens up by their positions in the whole store.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NO_ID, cut, flat_utf8, shares, slices, text_bytes
from .pieces import PieceTable

WIDTH = 8
BLOCK = 512
#: Rows (of 24 bytes) up to which the starts of segments are broadcast.
MOST_BROADCAST = 200_000
_LEVEL = "struct<chunks:binary,more:binary,ranks:binary>"
_SEGMENT = f"part long, seq long, n_tokens long, doc_ids binary, no_ids binary, ends binary, levels array<{_LEVEL}>"
_ARROW_LEVELS = pa.list_(pa.struct([("chunks", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())]))


def pack(ids: np.ndarray) -> list[dict]:
    """Levels of a sequence of unsigned 32-bit ids; an empty one has one empty level."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >= 1 << WIDTH
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(rest) // BLOCK) * BLOCK, np.uint8)
        padded[: len(rest)] = more
        ranks = np.concatenate([[0], np.cumsum(padded.reshape(-1, BLOCK).sum(1, dtype=np.int64))]).astype("<u4")
        levels.append({"chunks": (rest & ((1 << WIDTH) - 1)).astype(np.uint8).tobytes(), "more": bits.tobytes(), "ranks": ranks.tobytes()})
        if not more.any():
            return levels
        rest = rest[more] >> WIDTH


class Codes:
    """Reads the levels of one segment in place."""

    def __init__(self, levels):
        self.levels = [(np.frombuffer(x["chunks"], np.uint8), np.frombuffer(x["more"], np.uint8), np.frombuffer(x["ranks"], "<u4")) for x in levels]

    def __getitem__(self, at: int) -> int:
        """One id, by one rank lookup a level."""
        value = 0
        for depth, (chunks, more, ranks) in enumerate(self.levels):
            value |= int(chunks[at]) << (WIDTH * depth)
            if not more[at >> 3] >> (at & 7) & 1:
                break
            block = at // BLOCK
            before = int.from_bytes(more[block * BLOCK // 8 : at // 8].tobytes() + bytes([more[at >> 3] & ((1 << (at & 7)) - 1)]), "little").bit_count()
            at = int(ranks[block]) + before
        return value

    def between(self, start: int, end: int) -> np.ndarray:
        """The ids from start to end, end exclusive."""
        return self._level(0, start, end)

    def _rank(self, depth: int, at: int) -> int:
        _, more, ranks = self.levels[depth]
        block = at // BLOCK
        own = more[block * BLOCK // 8 : at // 8].tobytes()
        if at & 7:
            own += bytes([more[at >> 3] & ((1 << (at & 7)) - 1)])
        return int(ranks[block]) + int.from_bytes(own, "little").bit_count()

    def _level(self, depth: int, start: int, end: int) -> np.ndarray:
        chunks, more, _ = self.levels[depth]
        values = chunks[start:end].astype(np.uint32)
        bits = np.unpackbits(more[start >> 3 : (end + 7) >> 3], bitorder="little")[start & 7 :][: end - start].astype(bool)
        if bits.any():
            first = self._rank(depth, start)
            values[bits] |= self._level(depth + 1, first, first + int(bits.sum())) << np.uint32(WIDTH)
        return values


class LibraryPieces:
    """Counts and flat ids of pieces, by the tokenizers library.

    Pieces of a blank and letters split the same when they stand in a row, so the
    library gets them by the hundred; a token with a leading blank begins a piece."""

    def __init__(self, library, row: int = 256, batch: int = 64):
        self.library, self.row, self.batch = library, row, batch
        names = library.get_vocab()
        self.begins = np.zeros(max(names.values()) + 1, bool)
        self.begins[[i for name, i in names.items() if name.startswith("\u0120")]] = True

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        call = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        return [np.array(x.ids, np.uint32) for s in range(0, len(texts), self.batch) for x in call(texts[s : s + self.batch], add_special_tokens=False)]

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        chained = np.fromiter((w[0] == " " and w[1:].isalpha() for w in words), bool, len(words))
        counts = np.zeros(len(words), np.int64)
        own = [w for w, c in zip(words, chained.tolist(), strict=True) if c]
        rows = self._encode(["".join(own[a : a + self.row]) for a in range(0, len(own), self.row)])
        flat = np.concatenate(rows) if rows else np.zeros(0, np.uint32)
        first = np.flatnonzero(self.begins[flat])
        if len(first) != len(own) or len(own) and first[0]:
            chained[:] = False  # a vocabulary that does not split so
            flat, first = flat[:0], first[:0]
        counts[chained] = np.diff(np.append(first, len(flat)))
        found = [x for s in range(0, len(words), 4096) for x in self._encode([w for w, c in zip(words[s : s + 4096], chained[s : s + 4096].tolist(), strict=True) if not c])]
        counts[~chained] = np.fromiter(map(len, found), np.int64, len(found))
        out = np.empty(int(counts.sum()), np.uint32)
        is_chained = np.repeat(chained, counts)
        out[is_chained] = flat
        out[~is_chained] = np.concatenate(found) if found else []
        return counts, out


class AddedTokens:
    """The vocabulary's added tokens, which the library takes out of a text before it
    splits it: the longest of those that begin first, not normalized ones before others."""

    def __init__(self, vocabulary: dict):
        added = [x for x in vocabulary.get("added_tokens") or [] if x["content"]]
        if added and any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] and vocabulary.get("normalizer") for x in added):
            raise ValueError("added tokens that depend on what surrounds them, or on a normalizer, are not supported")
        self.ids = {x["content"]: x["id"] for x in added}
        turns = [sorted((x["content"] for x in added if x["normalized"] is late), key=len, reverse=True) for late in (False, True)]
        self.turns = [re.compile(f"({'|'.join(map(re.escape, names))})") for names in turns if names]

    def cut(self, text: str) -> tuple[list[str], list[int]]:
        """The texts between added tokens, and the ids of these, one fewer."""
        parts, ids = [text], []
        if not any(name in text for name in self.ids):
            return parts, ids
        for turn in self.turns:
            between, ids, old = [], [], ids
            for i, part in enumerate(parts):
                found = turn.split(part)
                between += found[::2]
                ids += [self.ids[x] for x in found[1::2]] + old[i : i + 1]
            parts = between
        return parts, ids

    def blocks(self, table: PieceTable, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of each text."""
        own = [self.cut(x) for x in texts]
        ((flat, sizes),) = table.blocks([[x for parts, _ in own for x in parts]])
        ids = np.fromiter((i for _, found in own for i in found), np.uint32)
        if not len(ids):
            return flat, sizes
        n = np.fromiter((len(parts) for parts, _ in own), np.int64, len(own))
        last = np.zeros(len(sizes), bool)
        last[np.cumsum(n) - 1] = True  # an id follows every part but a text's last
        flat = np.insert(flat, np.cumsum(sizes)[~last], ids)
        return flat, np.add.reduceat(sizes, np.cumsum(n) - n) + n - 1


@lru_cache(maxsize=1)
def _piece_table(vocabulary: str, pattern: str) -> PieceTable:
    """The table of a vocabulary (JSON).  A worker keeps the last one for its next tasks, so that
    pieces of the corpus are encoded about once a worker, not once a task; its bounds
    hold all the same."""
    from tokenizers import Tokenizer

    return PieceTable(pattern, LibraryPieces(Tokenizer.from_str(vocabulary)), 450_000)


def _segments(docs, table: PieceTable, added: AddedTokens, part: int, end_id: int, most: int):
    """Rows of the table for documents in order: (doc_ids, texts) batches in."""
    names, counts, ids, held, seq = [], [], [], 0, 0

    def row():
        all_names, all_counts = np.concatenate(names), np.concatenate(counts)
        levels = pack(np.concatenate(ids))
        blank = all_names == NO_ID
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([int(all_counts.sum())], pa.int64()), pa.array([all_names.astype("<i8").tobytes()], pa.binary()), pa.array([np.packbits(blank, bitorder="little").tobytes()], pa.binary()), pa.array([np.cumsum(all_counts).astype("<i8").tobytes()], pa.binary()), pa.array([levels], _ARROW_LEVELS)],
            ["part", "seq", "n_tokens", "doc_ids", "no_ids", "ends", "levels"],
        )

    for own, texts in docs:
        flat, sizes = added.blocks(table, texts)
        ends = np.cumsum(sizes)
        names.append(own)
        counts.append(sizes + 1)
        ids.append(np.insert(flat, ends, end_id))
        held += len(flat) + len(sizes)
        if held >= most:
            yield row()
            names, counts, ids, held, seq = [], [], [], 0, seq + 1
    if held:
        yield row()


def write(docs: DataFrame, tokenizer_path: str, pattern: str, path: str, end_id: int = 0, part_bytes: int = 20 << 20, segment_tokens: int = 1 << 19) -> None:
    """Encodes the texts with the tokenizers library and writes segments to ``path``.

    Documents stand in ascending order of doc_id (null last), those that share
    one by text; each is followed by ``end_id``.  A null text counts as empty.
    The vocabulary's added tokens keep their ids, as the library gives them.
    Other columns are not read.  An empty table gives a table without rows.
    """
    parts = shares(text_bytes(docs), part_bytes)
    with open(tokenizer_path, encoding="utf-8") as f:  # a vocabulary: of fixed size
        vocabulary = json.load(f)
    added = AddedTokens(vocabulary)
    # these are cut out of the texts; pieces must not be searched for them again
    held = docs.sparkSession.sparkContext.broadcast(json.dumps(vocabulary | {"added_tokens": []}))

    def run(batches):
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads cost memory

        def blocks():
            for batch in batches:
                raw, bounds = flat_utf8(batch["text"])
                own = batch["doc_id"].fill_null(NO_ID).to_numpy(zero_copy_only=False)
                for a, b in slices(bounds, 1 << 20):
                    yield own[a:b], [raw[bounds[i] : bounds[i + 1]].tobytes().decode() for i in range(a, b)]

        yield from _segments(blocks(), _piece_table(held.value, pattern), added, TaskContext.get().partitionId(), end_id, segment_tokens)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_last()).sortWithinPartitions(*order).mapInArrow(run, _SEGMENT).write.option("parquet.block.size", 16 << 20).option("compression", "uncompressed").parquet(path)


def with_starts(segments: DataFrame) -> DataFrame:
    """Adds ``start``: the number of tokens in all segments before.

    First within each part, then over one row a part."""
    sizes = segments.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    within = Window.partitionBy("part").orderBy("seq")
    inner = sizes.select("part", "seq", (F.sum("n_tokens").over(within) - F.col("n_tokens")).alias("inner"))
    starts = cut(inner.join(parts, "part").select("part", "seq", (F.col("base") + F.col("inner")).alias("start")))
    # a row a segment: small enough to go to the segments, up to a bound
    return segments.join(F.broadcast(starts) if starts.count() <= MOST_BROADCAST else starts, ["part", "seq"])


def token_at(spark: SparkSession, path: str, positions: DataFrame, column: str = "position", run: int = 1 << 16, most_parts: int = 1000) -> DataFrame:
    """position and id of tokens of a store, by their positions in the order of all tokens.

    ``positions``: a table with the column; each distinct one gives a row, with a null id
    if it is null or outside the store.  A position finds its segment by the segments'
    starts; where few parts are asked for, only their files are read.  In a segment a
    token is one directory entry and a popcount a level.  A segment's positions go to it
    at most about ``run`` at a time, so no list is unbounded.
    """
    shift = 19
    segments = spark.read.schema(_SEGMENT).parquet(path)
    starts = cut(with_starts(segments.select("part", "seq", "n_tokens")).where("n_tokens > 0"))
    end = F.col("start") + F.col("n_tokens") - 1
    bins = starts.select("part", "seq", "start", end.alias("end"), F.explode(F.sequence(F.shiftright("start", shift), F.shiftright(end, shift))).alias("bin"))
    asked = positions.select(F.col(column).cast("long").alias("position")).distinct()
    found = asked.withColumn("bin", F.shiftright("position", shift)).join(bins, "bin").where("position between start and end")
    found = cut(found.select("position", "part", "seq", (F.col("position") - F.col("start")).alias("at")))
    turn = F.floor(F.pmod(F.xxhash64("position"), F.lit(1 << 40)) / F.lit((1 << 40) // max(1, (1 << shift) // run)))
    lists = found.groupBy("part", "seq", turn.alias("turn")).agg(F.collect_list("position").alias("positions"), F.collect_list("at").alias("at"))
    parts = [r["part"] for r in found.select("part").distinct().limit(most_parts + 1).collect()]
    if len(parts) <= most_parts:
        segments = segments.where(F.col("part").isin(parts))

    def look(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                codes, at = Codes(batch["levels"][i].as_py()), batch["at"][i].as_py()
                yield pa.RecordBatch.from_arrays([batch["positions"][i].values, pa.array([codes[j] for j in at], pa.int64())], ["position", "id"])

    ids = segments.select("part", "seq", "levels").join(lists, ["part", "seq"]).select("levels", "positions", "at").mapInArrow(look, "position long, id long")
    return asked.join(ids, "position", "left")


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of a token table: doc_id, start, n_tokens, ids
    (little-endian unsigned 32-bit, with the end id)."""

    def run(batches):
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                codes, ends = Codes(row["levels"]), np.frombuffer(row["ends"], "<i8")
                names = np.frombuffer(row["doc_ids"], "<i8")
                blank = np.unpackbits(np.frombuffer(row["no_ids"], np.uint8), bitorder="little")[: len(names)].astype(bool)
                starts = np.concatenate([[0], ends[:-1]])
                for a in range(0, len(names), 256):
                    b = min(len(names), a + 256)
                    whole = codes.between(int(starts[a]), int(ends[b - 1])).astype("<u4").tobytes()  # documents follow each other
                    at = 4 * (np.append(starts[a:b], ends[b - 1]) - starts[a])
                    cells = [whole[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[a:b], pa.int64(), mask=blank[a:b]), pa.array(starts[a:b] + row["start"], pa.int64()), pa.array((ends - starts)[a:b], pa.int64()), pa.array(cells, pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    segments = spark.read.schema(_SEGMENT).parquet(path)
    return with_starts(segments).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def crc32(cell: bytes) -> int:
    """Checksum of a document's ids, as ``F.crc32`` gives it."""
    return zlib.crc32(cell)
