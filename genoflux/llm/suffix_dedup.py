"""Repeated byte strings by a depth-limited radix sort of suffixes.

A full suffix array orders suffixes to their ends; for strings of at least 50 bytes
an order through 50 bytes is enough, since equal groups at that depth are exactly
the repeated strings.  The sort goes by most significant digit, eight bytes at a
time, and drops what is settled after each pass (``windows.radix_order``).

Only suffixes at anchors are entered, about one in 20: every 50-byte string has one,
and equal strings have it at the same offset.  An entry is ordered twice, by the
bytes from its anchor on and by those before it, backwards, so that groups of equal
strings show at every offset of the anchor.  As in any radix sort a pass begins by
counting: the first digit, an anchor with half of the rest of a string on one side, is
counted by hash over the corpus, and entries whose digits occur once are settled
before anything else of them is moved.  All later digits are bytes of the texts, so
equal groups are equal strings.  A group of documents enters an equal stretch once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import binary_rows
from .common import NO_ID, flat_utf8, shares
from .windows import Group, Shape, Sketch, Texts, common_grams, grouped, make_group, repeated_windows

#: A 64-bit number for each byte, from a rule of its own.
_BYTES = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ (np.arange(1, 257, dtype=np.uint64) << np.uint64(40))
_OUT = "doc_id long, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept binary"


def runs(gone: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of True within one document, and how many
    each document has.  ``ends``: where documents end in the flat array."""
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    edge = np.zeros(len(gone) + 1, bool)
    edge[starts] = True
    edge[len(gone)] = True
    begin = gone.copy()
    begin[1:] &= ~gone[:-1] | edge[1:-1]
    finish = gone.copy()
    finish[:-1] &= ~gone[1:] | edge[1:-1]
    low = np.flatnonzero(begin)
    return low, np.flatnonzero(finish) + 1, np.diff(np.searchsorted(low, np.concatenate([[0], ends])))


def first_digits(group: Group, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the first digits of the distinct spans: those to the left, then those to
    the right; and which distinct spans have one on each side, by number."""
    x, f = group.spans, group.first
    left = np.flatnonzero(x.offset[f] >= shape.half)
    right = np.flatnonzero(x.offset[f].astype(np.int64) - x.more[f] <= shape.rest - shape.half)
    return np.concatenate([x.left[f[left]], x.right[f[right]]]), left, right


def remove_repeated_bytes(docs: DataFrame, depth: int = 50, digit: int | None = None, group_bytes: int = 8 << 20, bucket_bytes: int = 8 << 20, sample_bytes: int = 32 << 20) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, removed (maximal
    runs, in bytes, end exclusive), kept (the other bytes).

    A byte goes if a string of ``depth`` bytes that covers it also starts in a
    document with a smaller doc_id; strings never cross documents.  Null texts
    count as empty; shorter texts stay whole.  Rows without a doc_id come after all
    others and do not remove each other, nor do rows that share a doc_id.  Only
    doc_id and text are read.  ``digit``: bytes of an anchor (by the size of the
    corpus, 8 to 16); ``sample_bytes`` of texts tell which of them are common and
    make bad anchors.  Both change the work only.
    """
    rows, _, total = grouped(docs, group_bytes)
    if digit is None:
        digit = min(max(2, depth // 3), 8 if total < 1 << 34 else 12 if total < 1 << 40 else 16)
    shape = Shape(depth, digit, False, True)
    common = common_grams(rows, digit, lambda raw: _BYTES[raw], total, sample_bytes)

    def load(t: pa.Table) -> Group:
        raw, bounds = flat_utf8(t["text"])
        return make_group(Texts(t["doc_id"].to_numpy(), t["sub"].to_numpy(), bounds[1:], lambda a, b: _BYTES[raw[a:b]], raw), shape, common.value)

    def choose(group: Group, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct spans that share a digit; their windows on that side."""
        _, left, right = first_digits(group, shape)
        side = np.zeros((2, len(group.first)), bool)
        side[0, left], side[1, right] = counted[: len(left)], counted[len(left) :]
        which = np.flatnonzero(side.any(0))
        offset, more, half = group.spans.offset[group.first[which]].astype(np.int64), group.spans.more[group.first[which]], shape.half
        low = np.where(side[0, which], 0, np.maximum(0, offset - (shape.rest - half)))
        high = np.where(side[1, which], more, np.minimum(more, offset - half))
        return which, low, high

    def result(t: pa.Table, group: Group, gone: np.ndarray) -> pa.Table:
        raw, bounds = flat_utf8(t["text"])
        low, high, counts = runs(gone, group.texts.ends)
        base = np.repeat(bounds[:-1], counts)
        spans = pa.StructArray.from_arrays([pa.array(low - base), pa.array(high - base)], ["start", "end"])
        removed = np.bincount(np.repeat(np.arange(len(counts)), counts), high - low, len(counts)).astype(np.int64)
        sizes = np.diff(bounds)
        return pa.Table.from_arrays(
            [pa.array(group.texts.ids, mask=group.texts.ids == NO_ID), pa.array(sizes), pa.array(removed), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), spans), binary_rows(raw[~gone], sizes - removed)],
            ["doc_id", "n_bytes", "n_removed", "removed", "kept"],
        )

    # two digits for one in about 20 bytes, and 16 counters for each
    bits = max(16, (total * 3 // 2).bit_length())
    sketch = Sketch(bits, shares(1 << bits, 8 << 20, 16), 1)
    return repeated_windows(rows, shares(total, bucket_bytes, 16), shape, load, lambda group: first_digits(group, shape)[0], choose, sketch, result, _OUT)
