"""Line dedup by range-partitioned line hashes.

Lines become 128-bit hashes of their keys, ranged by hash with document (largest
first) and position behind it, so that a line of many documents spreads over as
many ranges as it needs.  A range is read as a stream: the first document of a hash
keeps its lines, those of its third and later ones go, those of the second go once a
third is seen.  Only the first and the last hash of a range can reach into another one;
what these leave open is settled by two summary rows a range.  What comes back is a
compressed bitmap for each document that loses a line, never a text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, flat_utf8, kept_table, shares, slices

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ENTRY = "key binary, doc long, text_key binary, line int"
_DROP, _OPEN, _BORDER = 0, 1, 2
_STREAM = "kind int, key binary, doc long, text_key binary, line int, last long, docs long, part int"


def _named(docs: DataFrame) -> DataFrame:
    """doc (doc_id, or NO_ID), the text, and its MD5: rows equal in these have equal results."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), text.alias("text")).withColumn("text_key", F.unhex(F.md5("text")))


def line_bounds(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each line (without its line feed) of texts that stand in a row, and how many lines each text has."""
    feeds = np.flatnonzero(raw == 10)
    lines = np.diff(np.searchsorted(feeds, bounds)) + 1
    stops = np.cumsum(lines)
    ends, starts = np.empty(int(stops[-1]) if len(stops) else 0, np.int64), np.empty(int(stops[-1]) if len(stops) else 0, np.int64)
    closing = np.zeros(len(ends), bool)
    closing[stops - 1] = True
    ends[closing], ends[~closing] = bounds[1:], feeds
    starts[stops - lines] = bounds[:-1]
    opening = np.zeros(len(starts), bool)
    opening[stops - lines] = True
    starts[~opening] = feeds + 1
    return starts, ends, lines


def line_keys(raw: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Row, line and key (128 bits) of the lines of ``least`` code points or more, without
    blanks at both ends; also the lines of each row."""
    starts, ends, lines = line_bounds(raw, bounds)
    solid = np.flatnonzero(~_SPACE[raw])
    low, high = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    full = np.flatnonzero(high > low)
    a, b = solid[low[full]], solid[high[full] - 1] + 1
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    long = before[b] - before[a] >= least
    full, a, b = full[long], a[long], b[long]
    data = memoryview(_LOWER[raw].tobytes())
    keys = [xxhash.xxh3_128_digest(data[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    stops = np.cumsum(lines)
    row = np.searchsorted(stops, full, "right")
    return row, full - (stops - lines)[row], lines, keys


def line_entries(docs: DataFrame, least_points: int) -> DataFrame:
    """key, doc, text_key and line of each line that counts."""

    def run(batches):
        for batch in batches:
            names = list(zip(batch["doc"].to_pylist(), batch["text_key"].to_pylist(), strict=True))
            first = {name: i for i, name in reversed(list(enumerate(names)))}
            table = batch.take(pa.array(sorted(first.values()), pa.int64()))  # rows that repeat count once
            raw, bounds = flat_utf8(table["text"])
            for x, y in slices(bounds, 4 << 20):
                row, line, _, keys = line_keys(raw[bounds[x] : bounds[y]], bounds[x : y + 1] - bounds[x], least_points)
                at = pa.array(row + x)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), table["doc"].take(at), table["text_key"].take(at), pa.array(line, pa.int32())], ["key", "doc", "text_key", "line"])

    return _named(docs).select("doc", "text_key", "text").mapInArrow(run, _ENTRY)


def _settle(least_docs: int):
    """Reads a range in order: lines that go, lines that a border leaves open, and the borders."""
    sure = max(1, least_docs - 1)

    def rows(kind: int, table: pa.Table, key: bytes | None = None) -> pa.RecordBatch:
        n, none = table.num_rows, pa.nulls(table.num_rows, pa.int64())
        cells = [pa.array(np.full(n, kind, np.int32)), pa.array([key] * n, pa.binary()), *(table[c].combine_chunks() for c in ("doc", "text_key", "line")), none, none, pa.nulls(n, pa.int32())]
        return pa.RecordBatch.from_arrays(cells, ["kind", "key", "doc", "text_key", "line", "last", "docs", "part"])

    def run(batches):
        part, held = TaskContext.get().partitionId(), []
        key, first, last, count, leading = None, 0, 0, 0, False  # of the hash that the stream is in

        def border():
            row = {"kind": _BORDER, "key": key, "doc": first, "text_key": None, "line": None, "last": last, "docs": count, "part": part}
            kinds = {"kind": pa.int32(), "key": pa.binary(), "text_key": pa.binary(), "line": pa.int32(), "part": pa.int32()}
            return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.int64())) for k, v in row.items()], list(row))

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            keys, docs = np.frombuffer(b"".join(table["key"].to_pylist()), np.uint64).reshape(-1, 2), table["doc"].to_numpy()
            fresh = np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])
            other = fresh | np.concatenate([[True], docs[1:] != docs[:-1]])
            begin = np.flatnonzero(fresh)
            size = np.diff(np.append(begin, len(keys)))
            nth = np.cumsum(other) - 1  # which document of its hash a line is in, from 0
            nth -= np.repeat(nth[begin], size)
            same, start = key == keys[0].tobytes(), key is None
            if same:
                nth[: size[0]] += count - int(docs[0] == last)
            total = np.repeat(nth[begin + size - 1] + 1, size)
            border_run = np.arange(len(keys)) < (size[0] if start or (same and leading) else 0)
            gone = (nth >= sure) | (~border_run & (nth >= 1) & (total >= least_docs))
            waits = ~gone & ~border_run & (nth >= 1) & (np.arange(len(keys)) >= begin[-1])
            if same and total[0] >= least_docs:
                yield from (rows(_DROP, t) for t in held)
                held = []
            if not same and leading:
                yield border()
            if gone.any():
                yield rows(_DROP, table.filter(pa.array(gone)))
            if (open_ := border_run & ~gone).any():
                yield rows(_OPEN, table.filter(pa.array(open_)), keys[0].tobytes())
            if same or start:
                first = first if same else int(docs[0])
                key, last, count, leading = keys[0].tobytes(), int(docs[size[0] - 1]), int(total[0]), start or leading
            if len(begin) > 1 or not (same or start):
                if (same or start) and leading:
                    yield border()
                held, at = [], int(begin[-1])
                key, first, last, count, leading = keys[-1].tobytes(), int(docs[at]), int(docs[-1]), int(total[-1]), False
            if waits.any():
                held.append(table.filter(pa.array(waits)))
        if key is not None:
            yield border()
            yield from (rows(_OPEN, t, key) for t in held)

    return run


def _bitmaps(batches):
    """Bitmaps of documents whose lines that go follow each other."""
    name, lines = None, []

    def packed(name, lines):
        bits = np.ones((int(max(x[-1] for x in lines)) // 8 + 1) * 8, bool)
        bits[np.concatenate(lines)] = False
        return (*name, int((~bits).sum()), zlib.compress(np.packbits(bits).tobytes()))

    def batch_of(done):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.int64(), pa.binary(), pa.int64(), pa.binary()), strict=True)], ["doc", "text_key", "n_dropped", "keep"])

    for batch in batches:
        if not batch.num_rows:
            continue
        docs, keys, line = batch["doc"].to_numpy(), batch["text_key"].to_pylist(), batch["line"].to_numpy()
        as_array = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
        begin = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (as_array[1:] != as_array[:-1]).any(1)]))
        done = []
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(docs)], strict=True):
            own = (int(docs[a]), keys[a])
            if own != name:
                if name is not None:
                    done.append(packed(name, lines))
                name, lines = own, []
            lines.append(line[a:b])
        if done:
            yield batch_of(done)
    if name is not None:
        yield batch_of([packed(name, lines)])


def keep_bitmaps(docs: DataFrame, least_points: int = 20, least_docs: int = 3, range_lines: int = 500_000) -> DataFrame:
    """doc (doc_id; the largest long for none), text_key (MD5 of the text), n_dropped, keep.

    One row for each document that loses lines: ``keep`` is a zlib-compressed bitmap, a
    bit a line, 0 where the line goes; lines behind its end stay.  A line's key is the
    line without `[\\x20\\x09-\\x0D]` at both ends, A-Z lower-cased.  Keys of at least
    ``least_points`` code points in at least ``least_docs`` documents lose their lines in all
    documents but that with the largest doc_id.  Rows that share a doc_id are one
    document, and so are rows without one, which is the largest.
    """
    lines = kept_table(line_entries(docs, least_points), "lines")
    parts = shares(lines.count(), range_lines, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["key", F.desc("doc"), "text_key", "line"]
    found = kept_table(lines.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_settle(least_docs), _STREAM), "settled")
    # two rows a range at most: broadcast whatever the corpus
    borders = found.where(F.col("kind") == _BORDER)
    again = (F.lag("last").over(Window.partitionBy("key").orderBy("part")) == F.col("doc")).cast("long")
    borders = borders.select("key", "doc", (F.col("docs") - F.coalesce(again, F.lit(0))).alias("docs"))
    borders = borders.groupBy("key").agg(F.sum("docs").alias("n"), F.max("doc").alias("top")).where(F.col("n") >= least_docs)
    opened = found.where(F.col("kind") == _OPEN).select("key", "doc", "text_key", "line").join(F.broadcast(borders), "key").where("doc <> top")
    gone = found.where(F.col("kind") == _DROP).select("doc", "text_key", "line").unionByName(opened.select("doc", "text_key", "line"))
    return gone.repartition("doc", "text_key").sortWithinPartitions("doc", "text_key", "line").mapInArrow(_bitmaps, "doc long, text_key binary, n_dropped long, keep binary")


def without_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_lines, n_dropped, keep (null: all), kept
    (the lines that stay, joined by line feeds)."""

    def run(batches):
        for batch in batches:
            raw, bounds = flat_utf8(batch["text"])
            bits, dropped, kept = batch["keep"].to_pylist(), np.zeros(batch.num_rows, np.int64), []
            lines = np.zeros(batch.num_rows, np.int64)
            for x, y in slices(bounds, 4 << 20):
                own = raw[bounds[x] : bounds[y]]
                data, edge = own.tobytes(), bounds[x : y + 1] - bounds[x]
                lines[x:y] = np.diff(np.concatenate([[0], np.cumsum(own == 10)])[edge]) + 1
                for i in range(x, y):
                    text = data[edge[i - x] : edge[i - x + 1]]
                    if bits[i] is not None:
                        stay = np.unpackbits(np.frombuffer(zlib.decompress(bits[i]), np.uint8))[: lines[i]]
                        parts = text.split(b"\n")
                        dropped[i] = int((stay == 0).sum())
                        text = b"\n".join([parts[j] for j in np.flatnonzero(stay).tolist()] + parts[len(stay) :])
                    kept.append(text)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(lines), pa.array(dropped), batch["keep"], pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_lines", "n_dropped", "keep", "kept"])

    rows = _named(docs).join(bitmaps.drop("n_dropped").hint("shuffle_hash"), ["doc", "text_key"], "left")
    return rows.select("doc_id", "text", "keep").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, keep binary, kept string")


def remove_repeated_lines(docs: DataFrame, least_points: int = 20, least_docs: int = 3) -> DataFrame:
    """Bitmaps made and applied: see ``keep_bitmaps`` and ``without_lines``.

    A null or empty text is one empty line and stays.  Rows that repeat have equal
    results.  Only doc_id and text are read.
    """
    return without_lines(docs, keep_bitmaps(docs, least_points, least_docs))
