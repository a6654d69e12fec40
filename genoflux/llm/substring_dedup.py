"""Substring dedup: repeated word windows behind a count-min prefilter.

Every group of documents makes a sparse count-min sketch, rows of counters
addressed by hashes of its windows; the sketches are merged, a range of counters at
a time.  A counter is at least what it counts, so windows of which one counter says
less than two are unique.  The others, and no repeated window is missing, are grouped
exactly, word by word (see ``windows``).  The merged sketch is a table of counter
ranges that grows with the corpus; a group gets back one bit for each counter it has
used, so nothing is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .bpe import binary_rows
from .common import NO_ID, flat_utf8, shares, slices
from .windows import Grams, Group, Shape, Sketch, Texts, grouped, join_hash, make_group, repeated_windows

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BYTES = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) ^ (np.arange(1, 257, dtype=np.uint64) << np.uint64(36))
_LONG = 64
_OUT = "doc_id long, n_words long, n_removed long, kept binary"


def word_bounds(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in texts that stand in a row, and where the
    words of each text end."""
    inside = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[bounds] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(finish) + 1, np.searchsorted(starts, bounds[1:])


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 17) -> np.ndarray:
    """64-bit hash of each word: of its first and its last 2^j bytes, which cover
    it, and of its length."""
    out = np.zeros(len(starts), np.uint64)
    size = ends - starts
    for s in range(0, len(raw), step):
        i, j = np.searchsorted(starts, [s, s + step])
        if i == j:
            continue
        grams = Grams(_BYTES[raw[s : s + step + _LONG]])
        length, low = size[i:j], starts[i:j] - s
        own = np.zeros(j - i, np.uint64)
        for power in range(_LONG.bit_length() - 1):
            part = 1 << power
            which = np.flatnonzero((length >= part) & (length < 2 * part))
            if len(which):
                h = grams[part]
                own[which] = join_hash(h[low[which]], h[low[which] + length[which] - part])
        out[i:j] = join_hash(own, length.astype(np.uint64))
    for i in np.flatnonzero(size >= _LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]].tobytes(), 9)
    return out


def normal_words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts with one blank behind each word and no other white space; start and end
    of each word there; where the words of each text end."""
    starts, ends, stops = word_bounds(raw, bounds)
    size = ends - starts
    fresh = np.cumsum(size + 1) - size - 1
    out = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    inside = ~_SPACE[raw]
    at = np.ones(len(out), bool)
    at[fresh + size] = False
    out[at] = raw[inside]
    return out, fresh, fresh + size, stops


def window_hashes(group: Group, shape: Shape, step: int = 1 << 17) -> np.ndarray:
    """Hash of each window of the group, span by span."""
    spans, total = group.spans, int(group.texts.ends[-1]) if len(group.texts.ends) else 0
    stops = np.cumsum(spans.more + 1)
    at = np.repeat(spans.low - stops + spans.more + 1, spans.more + 1) + np.arange(int(stops[-1]) if len(stops) else 0)
    out = np.empty(len(at), np.uint64)
    for s in range(0, total, step):
        i, j = np.searchsorted(at, [s, s + step])
        if j > i:
            out[i:j] = Grams(group.texts.tokens(s, min(total, s + step + shape.window)))[shape.window][at[i:j] - s]
    return out


def remove_repeated_words(docs: DataFrame, window: int = 20, gram: int = 8, group_bytes: int = 8 << 20, bucket_bytes: int = 12 << 20) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept (the other
    words, joined by one blank, UTF-8).

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged.  A word goes if a window of ``window``
    words that covers it has also started earlier: in a document with a smaller
    doc_id, or before it in the same document.  Null texts have no words; shorter
    texts stay whole.  Rows without a doc_id come after all others; rows that share
    a doc_id follow each other by the XXH64 of their texts (signed), then by text.
    Only doc_id and text are read.
    """
    shape = Shape(window, gram, True, False)
    rows, _, total = grouped(docs, group_bytes)
    # about eight counters in a row for each window, as many as words
    bits = max(16, (total * 8 // 6).bit_length())
    sketch = Sketch(bits, shares(1 << bits, 8 << 20, 16))

    def load(t: pa.Table) -> Group:
        raw, starts, ends, stops = normal_words(*flat_utf8(t["text"]))
        words = word_hashes(raw, starts, ends)
        return make_group(Texts(t["doc_id"].to_numpy(), t["sub"].to_numpy(), stops, lambda a, b: words[a:b], raw, starts, ends), shape)

    def choose(group: Group, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct spans with windows that may be repeated; the first and last of these."""
        counts = group.spans.more + 1
        if not len(counts):
            return (np.zeros(0, np.int64),) * 3
        begin = np.cumsum(counts) - counts
        at = np.arange(len(keep)) - np.repeat(begin, counts)
        low = np.minimum.reduceat(np.where(keep, at, 1 << 30), begin)[group.first]
        high = np.maximum.reduceat(np.where(keep, at, -1), begin)[group.first]
        which = np.flatnonzero(high >= 0)
        return which, low[which], high[which]

    def result(t: pa.Table, group: Group, gone: np.ndarray) -> pa.Table:
        raw, starts, ends, stops = group.texts.raw, group.texts.starts, group.texts.stops, group.texts.ends
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], stops])]
        firsts = np.concatenate([[0], stops[:-1]])
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[np.concatenate([[0], stops])])
        cells = []
        for a, b in slices(bounds, 1 << 20):
            own = np.arange(firsts[a], stops[b - 1])
            own = own[~gone[own]]
            size = ends[own] - starts[own] + 1
            stop = np.cumsum(size)
            at = np.repeat(starts[own] - stop + size, size) + np.arange(int(stop[-1]) if len(stop) else 0)
            text = raw[np.minimum(at, max(0, len(raw) - 1))] if len(at) else np.zeros(0, np.uint8)
            text[stop - 1] = 0x20
            cut = np.concatenate([[0], stop])[np.searchsorted(own, np.append(firsts[a:b], stops[b - 1]))]
            cells += [text[x : max(x, y - 1)].tobytes() for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        sizes = np.fromiter(map(len, cells), np.int64, len(cells))
        return pa.Table.from_arrays(
            [pa.array(group.texts.ids, mask=group.texts.ids == NO_ID), pa.array(stops - firsts), pa.array(removed), binary_rows(np.frombuffer(b"".join(cells), np.uint8), sizes)],
            ["doc_id", "n_words", "n_removed", "kept"],
        )

    return repeated_windows(rows, shares(total, bucket_bytes, 16), shape, load, lambda group: window_hashes(group, shape), choose, sketch, result, _OUT)
