"""Windows of W tokens that occur more than once in a corpus, by a depth-limited radix sort.

Used by the byte and the word operator.  Ordering every suffix would move many times
the corpus, so the suffixes that are ordered start at anchors.  A window's anchor is
the k-token gram in it with the smallest key, the leftmost of equals: the content
alone decides, so equal windows have equal anchors at equal offsets.  Successive
windows with one anchor form a span; it is sent once, with its tokens.

Entries meet by anchor.  They are ordered, most significant digit first, by the tokens
of the anchor, then by those that follow it, and a second time by those before it,
nearest first, each through the window's depth; an entry that is alone in its group
after a pass is settled and leaves.  How deep neighbours agree on both sides says
which windows can repeat.  A window is repeated where an entry has the same group to
its right and to its left at the window's own depths: such groups are exactly the
equal windows, token by token.

Documents are dealt into groups of bounded size by a hash of doc_id and text.  A group
sends each distinct span once, whatever its number of copies, and gets back a mask of
the windows it has to act on.  Texts are shuffled once and read from there.  Hashes
choose anchors and places; equality is always decided on the tokens.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, flat_utf8, shares, text_bytes

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S1, _S2 = np.uint64(32), np.uint64(29)
_STEP = 1 << 17
#: Bits of the table of common grams.
COMMON_BITS = 18
MESSAGE = "b int, g long, kind int, n long, body binary"
_FIELDS = pa.schema([("b", pa.int32()), ("g", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), ("body", pa.binary())])
_ZSTD = "zstd"

def join_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a concatenation from the hashes of its two parts."""
    h = left * _C1
    h += right
    h ^= h >> _S1
    h *= _C2
    h ^= h >> _S2
    return h


class Grams:
    """Hashes of all grams of one token array, by doubling; made on demand."""

    def __init__(self, tokens: np.ndarray):
        self.made = {1: tokens}

    def __getitem__(self, size: int) -> np.ndarray:
        """``[size][i]``: hash of tokens i to i + size; shorter than the array by size - 1."""
        if size not in self.made:
            half = 1 << (size - 1).bit_length() - 1  # the largest power of two below
            left, right = self[half], self[size - half]
            n = max(0, len(self.made[1]) - size + 1)
            self.made[size] = join_hash(left[:n], right[half : half + n])
        return self.made[size]


@dataclass
class Spans:
    """Spans of a group in order of position; positions are in its flat token array."""

    low: np.ndarray  # first window
    more: np.ndarray  # windows after the first
    anchor: np.ndarray  # hash of the anchor
    span: np.ndarray  # hash of the content
    offset: np.ndarray  # of the anchor in the first window
    left: np.ndarray  # hash of the anchor and ``half`` tokens before it, if a window reaches so far
    right: np.ndarray  # and with those behind it


@dataclass(frozen=True)
class Shape:
    window: int
    gram: int
    by_place: bool  # within a document, does an earlier place count as earlier?
    letters: bool  # are the tokens bytes, not words?

    def __post_init__(self):
        if not 1 <= self.gram < self.window <= self.gram + 63:
            raise ValueError("a window must exceed its anchor, by 63 tokens at most")

    @property
    def rest(self) -> int:
        return self.window - self.gram

    @property
    def half(self) -> int:
        return max(1, self.rest // 2)


def find_spans(tokens: Callable[[int, int], np.ndarray], ends: np.ndarray, shape: Shape, common: np.ndarray | None = None) -> Spans:
    """Spans of texts that stand in a row.

    ``tokens(a, b)`` gives 64-bit tokens of a flat range; ``ends``: where texts
    end.  ``common``: for each value of a gram's upper bits, how common such grams are
    (0 to 3); rarer ones are preferred as anchors.  Works in blocks, so memory beyond
    the result is bounded.  A block's border may cut a span in two; that costs a
    comparison, never a match."""
    w, k = shape.window, shape.gram
    total = int(ends[-1]) if len(ends) else 0
    parts = []
    for s in range(0, total, _STEP):
        e = min(total, s + _STEP)
        grams = Grams(tokens(s, min(total, e + w)))
        n = min(e, total - w + 1) - s  # windows that start in this block
        if n <= 0:
            continue
        valid = _within(ends, s, n, w)
        if not valid.any():
            continue
        reach, size = w - k + 1, 1
        found = grams[k][: n + w - k]
        key = (found >> np.uint64(2)) & np.uint64(0xFFFFFFFFFFF80000) | np.arange(len(found), dtype=np.uint64)
        if common is not None:
            key |= common[(found >> np.uint64(64 - COMMON_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(62)
        while size * 2 <= reach:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        if size < reach:
            key = np.minimum(key[:n], key[reach - size :][:n])
        place = (key[:n] & np.uint64(0x7FFFF)).astype(np.int64)  # of the anchor, from s
        change = np.ones(n + 1, bool)
        change[1:n] = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1])
        cuts = np.flatnonzero(change)
        low, stop = cuts[:-1], cuts[1:]
        real = valid[low]
        low, more = low[real], (stop - low - 1)[real]
        a, whole = place[low], grams[w]
        inner = join_hash(join_hash(whole[low], whole[low + more]), (a - low).astype(np.uint64) * np.uint64(4096) + more.astype(np.uint64))
        anchor, near = grams[k][a], grams[shape.half]
        left, right = join_hash(anchor, near[np.maximum(a - shape.half, 0)]), join_hash(near[np.minimum(a + k, len(near) - 1)], anchor)
        parts.append((low + s, more, anchor, inner, (a - low).astype(np.uint8), left, right))
    if not parts:
        none = np.zeros(0, np.int64)
        return Spans(none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(np.uint8), none.astype(np.uint64), none.astype(np.uint64))
    return Spans(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _within(ends: np.ndarray, s: int, n: int, w: int) -> np.ndarray:
    """Do windows that start at s to s + n lie within a text?"""
    i, j = np.searchsorted(ends, [s + 1, s + n + w])
    over = np.zeros(n + 1, np.int32)
    np.add.at(over, np.maximum(ends[i:j] - w + 1 - s, 0), 1)
    np.add.at(over, np.minimum(ends[i:j] - s, n), -1)
    return np.cumsum(over[:n]) == 0


@dataclass
class Texts:
    """Texts of a group that stand in a row, in order of doc_id and hash."""

    ids: np.ndarray  # doc_id of each text, ascending
    subs: np.ndarray  # hash of each text
    ends: np.ndarray  # where its tokens end
    tokens: Callable[[int, int], np.ndarray]  # 64-bit hashes of tokens
    raw: np.ndarray  # bytes, words parted by one blank
    starts: np.ndarray | None = None  # first byte of each token, where tokens are words
    stops: np.ndarray | None = None  # and the byte behind it


@dataclass
class Group:
    """A group of documents, its spans, and the distinct ones in a fixed order."""

    texts: Texts
    spans: Spans
    text: np.ndarray  # of each span
    place: np.ndarray  # of each span's first window in its document
    order: np.ndarray  # spans sorted by content, then position
    entry: np.ndarray  # number of the distinct span, along order
    first: np.ndarray  # the earliest span of each distinct one

    def bytes_of(self, low: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and number of bytes of runs of tokens."""
        if self.texts.starts is None:
            return low, tokens
        start = self.texts.starts[low]
        return start, self.texts.stops[low + tokens - 1] - start


def gathered(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bytes of ranges of an array, one after another."""
    stop = np.cumsum(size)
    return raw[np.repeat(start - stop + size, size) + np.arange(int(stop[-1]) if len(stop) else 0)]


def _equal(group: Group, shape: Shape, left: np.ndarray, right: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """Do spans have the same tokens, as many windows, and the anchor at the same place?"""
    x = group.spans
    out = (x.more[left] == x.more[right]) & (x.offset[left] == x.offset[right])
    a, n = group.bytes_of(x.low[left], x.more[left] + shape.window)
    b, m = group.bytes_of(x.low[right], x.more[right] + shape.window)
    out &= n == m
    at = np.flatnonzero(out)
    for s in range(0, len(at), step):
        i = at[s : s + step]
        differ = gathered(group.texts.raw, a[i], n[i]) != gathered(group.texts.raw, b[i], n[i])
        out[i] = ~np.logical_or.reduceat(differ, np.cumsum(n[i]) - n[i])
    return out


def make_group(texts: Texts, shape: Shape, common: np.ndarray | None = None) -> Group:
    spans = find_spans(texts.tokens, texts.ends, shape, common)
    text = np.searchsorted(texts.ends, spans.low, "right")
    starts = np.concatenate([[0], texts.ends[:-1]]) if len(texts.ends) else texts.ends
    n = np.arange(len(texts.ids))
    new = np.ones(len(n), bool)
    new[1:] = (texts.ids[1:] != texts.ids[:-1]) | (texts.subs[1:] != texts.subs[:-1])
    head = np.maximum.accumulate(np.where(new, n, 0)) if len(n) else n  # equal rows follow each other
    place = spans.low - starts[head[text]]
    key = spans.anchor * _C1 ^ spans.span
    order = np.argsort(key, kind="stable")
    own = key[order]
    new = np.ones(len(order), bool)
    new[1:] = own[1:] != own[:-1]
    group = Group(texts, spans, text, place, order, np.cumsum(new) - 1, order[new])
    bad = np.zeros(len(order), bool)
    bad[~new] = ~_equal(group, shape, order[~new], group.first[group.entry[~new]])
    if bad.any():  # equal hashes of unequal spans: such a span stands for itself
        order, new = np.concatenate([order[~bad], order[bad]]), np.concatenate([new[~bad], np.ones(int(bad.sum()), bool)])
        group = Group(texts, spans, text, place, order, np.cumsum(new) - 1, order[new])
    return group


# Message bodies: columns one after another, each as byte planes, which compress well.


def pack(*columns: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns)


def unpack(body: bytes, n: int, *kinds) -> list[np.ndarray]:
    out, at, raw = [], 0, np.frombuffer(body, np.uint8)
    for kind in map(np.dtype, kinds):
        size = n * kind.itemsize
        out.append(np.ascontiguousarray(raw[at : at + size].reshape(kind.itemsize, n).T).view(kind).reshape(n))
        at += size
    return out


def steps(at: np.ndarray) -> np.ndarray:
    return np.diff(at, prepend=0).astype(np.uint32)


def table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_FIELDS), _FIELDS, strict=True)], schema=_FIELDS)


def bucket_of(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return ((anchor >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)


def by_bucket(bucket: np.ndarray, buckets: int):
    """Indexes that fall in each bucket that has some."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        yield b, order[cuts[b] : cuts[b + 1]]


def _kinds(shape: Shape) -> list:
    """Columns of a message: number of the span, windows after the first, offset of the
    anchor, doc_id; where it matters, hash of the text and place; where words, bytes."""
    return [np.uint32, np.uint8, np.uint8, np.int64, *([np.int64, np.uint32] if shape.by_place else []), *([] if shape.letters else [np.uint32])]


def send_spans(group: Group, g: int, shape: Shape, buckets: int, chosen: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Table:
    """Distinct spans of the group, each once, with their bytes.  ``chosen``: numbers of
    distinct spans, and the first and last window of each that matter."""
    x, (at, begin, last), rows = group.spans, chosen, []
    for b, own in by_bucket(bucket_of(x.anchor[group.first[at]], buckets), buckets):
        f, low, more = group.first[at[own]], begin[own], (last - begin)[own]
        start, size = group.bytes_of(x.low[f] + low, more + shape.window)
        columns = [steps(at[own]), more.astype(np.uint8), (x.offset[f] - low).astype(np.uint8), group.texts.ids[group.text[f]]]
        if shape.by_place:
            columns += [group.texts.subs[group.text[f]], (group.place[f] + low).astype(np.uint32)]
        if not shape.letters:
            columns.append(size.astype(np.uint32))
        rows.append((b, g, 0, len(own), pack(*columns) + pa.compress(gathered(group.texts.raw, start, size).tobytes(), _ZSTD, asbytes=True)))
    return table(rows)


def radix_order(digits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of digits, most significant digit first, and how many digits each
    row in that order shares with the one before it (-1: it is the first).

    A pass only touches rows that are not alone in their group."""
    n = len(digits)
    order, shared = np.arange(n), np.full(n, digits.shape[1], np.int64)
    head = np.zeros(n + 1, bool)
    head[[0, n]] = True
    if n:
        shared[0] = -1
    for d in range(digits.shape[1]):
        own = np.flatnonzero(~(head[:-1] & head[1:]))
        if not len(own):
            break
        run = np.cumsum(head[:-1])[own]
        key = digits[order[own], d]
        by = np.lexsort((key, run)) if run[-1] > run[0] else np.argsort(key, kind="stable")
        order[own] = order[own[by]]
        key = key[by]
        new = own[1:][(key[1:] != key[:-1]) & (run[1:] == run[:-1])]
        head[new] = True
        shared[new] = d
    return order, shared


def _digits(tokens: np.ndarray) -> tuple[np.ndarray, int]:
    """Rows of bytes or of 32-bit numbers as rows of 64-bit digits; tokens in a digit."""
    per = 8 // tokens.itemsize
    wide = np.zeros((len(tokens), max(1, -(-tokens.shape[1] // per)) * per), tokens.dtype.newbyteorder(">"))
    wide[:, : tokens.shape[1]] = tokens
    return wide.view(">u8").astype(np.uint64), per


def common_depth(tokens: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ordered by group and tokens, and how many tokens each shares with the one
    before it; -1 where the group is another."""
    digits, per = _digits(tokens)
    digits = np.concatenate([group.astype(np.uint64)[:, None], digits], axis=1)
    order, shared = radix_order(digits)
    depth = np.where(shared <= 0, -1, tokens.shape[1])
    part = np.flatnonzero((shared > 0) & (shared < digits.shape[1]))
    at = shared[part]
    differ = digits[order[part], at] ^ digits[order[part - 1], at]
    depth[part] = (at - 1) * per
    for i in range(1, per):  # leading tokens that agree
        depth[part] += differ < np.uint64(1) << np.uint64(64 - 64 // per * i)
    return order, depth


def _word_numbers(raw: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of runs (parted by one blank; runs end at ``stops``), equal
    for equal words, and where the words of each run end."""
    cut = np.append(raw == 0x20, False)
    cut[stops] = True
    cuts = np.flatnonzero(cut)
    starts = np.concatenate([[0], cuts[:-1] + (raw[np.minimum(cuts[:-1], len(raw) - 1)] == 0x20)])
    words = pa.array([], pa.binary())
    if len(cuts):
        size = cuts - starts
        bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(raw[raw != 0x20].tobytes())])
    return words.dictionary_encode().indices.to_numpy().astype(np.uint32), np.searchsorted(cuts, stops, "right")


def meet_spans(messages: pa.Table, shape: Shape) -> pa.Table:
    """For every group, which windows of its distinct spans occur earlier, as masks."""
    kinds = _kinds(shape)
    width = sum(np.dtype(k).itemsize for k in kinds)
    cols, blobs, owner, gs = [], [], [], []
    for row, (g, n, body) in enumerate(zip(messages["g"].to_pylist(), messages["n"].to_pylist(), messages["body"].to_pylist(), strict=True)):
        own = unpack(body, n, *kinds)
        size = own[-1].astype(np.int64) if not shape.letters else own[1].astype(np.int64) + shape.window
        blobs.append(np.frombuffer(pa.decompress(body[n * width :], int(size.sum()), _ZSTD), np.uint8))
        cols.append((np.cumsum(own[0].astype(np.int64)), *own[1:6 if shape.by_place else 4], size))
        owner.append(np.full(n, row))
        gs.append(g)
    at, more, offset, doc, *place, size = (np.concatenate(x) for x in zip(*cols, strict=True))
    owner, raw, stops = np.concatenate(owner), np.concatenate(blobs), np.cumsum(size)
    del cols, blobs
    tokens, stops = (raw, stops) if shape.letters else _word_numbers(raw, stops)
    more, offset = more.astype(np.int64), offset.astype(np.int64)
    first = stops - more - shape.window  # of each span's tokens
    mask = repeated(tokens, first, more, offset, [*place[::-1], doc], shape)
    rows = []
    told = np.flatnonzero(mask)
    for row, own in by_bucket(owner[told], len(gs)):
        i = told[own]
        rows.append((0, gs[row], 1, len(i), pack(steps(at[i]), mask[i], offset[i].astype(np.uint8))))
    return table(rows)


def _context(tokens: np.ndarray, start: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """``width`` tokens from each start; 0 from number ``valid`` on."""
    out = sliding_window_view(tokens, width)[start]
    out[np.arange(width) >= valid[:, None]] = 0
    return out


def repeated(tokens: np.ndarray, first: np.ndarray, more: np.ndarray, offset: np.ndarray, turn: list[np.ndarray], shape: Shape) -> np.ndarray:
    """A mask for each span: bit i says that its window i occurs earlier.

    ``first``: where a span's tokens begin; ``turn``: what orders spans, the last the
    most significant, which is the document.  Unless places count, only an occurrence
    in an earlier document is earlier."""
    k, rest, n = shape.gram, shape.rest, len(first)
    padded = np.concatenate([np.zeros(rest, tokens.dtype), tokens, np.zeros(rest + k, tokens.dtype)])
    anchor = first + offset + rest
    order, shared = radix_order(_digits(sliding_window_view(padded, k)[anchor])[0])
    label = np.empty(n, np.int64)
    whole = -(-k * tokens.itemsize // 8)
    label[order] = np.cumsum(shared < whole)
    sides = []
    alone = np.bincount(label)[label] == 1  # settled by the anchor itself
    rows = np.flatnonzero(~alone)
    mask = np.zeros(n, np.uint64)
    if not len(rows):
        return mask
    label, anchor, more, offset, turn = label[rows], anchor[rows], more[rows], offset[rows], [x[rows] for x in turn]
    for side in (0, 1):  # what follows the anchor; what stands before it, backwards
        if side == 0:
            context = _context(padded, anchor + k, more + rest - offset, rest)
        else:
            context = np.ascontiguousarray(sliding_window_view(padded, rest)[anchor - rest][:, ::-1])
            context[np.arange(rest) >= offset[:, None]] = 0
        sides.append(common_depth(context, label))
        del context
    # spans that are equal as a whole: the earliest stands for all
    ranks = []
    for order, depth in sides:
        rank = np.empty(len(rows), np.int64)
        rank[order] = np.cumsum(depth < rest)
        ranks.append(rank)
    key = (offset * 64 + more).astype(np.int64)
    by = np.lexsort((*turn, key, ranks[1], ranks[0]))
    new = np.ones(len(by), bool)
    new[1:] = (key[by][1:] != key[by][:-1]) | (ranks[0][by][1:] != ranks[0][by][:-1]) | (ranks[1][by][1:] != ranks[1][by][:-1])
    chief = np.empty(len(by), np.int64)
    chief[by] = by[new][np.cumsum(new) - 1]
    is_chief = chief == np.arange(len(by))
    # how deep the nearest other chief agrees, on each side
    deepest, places, depths = [], [], []
    for order, depth in sides:
        at = np.flatnonzero(is_chief[order])
        own = np.minimum.reduceat(depth[: at[-1] + 1], np.concatenate([[0], at[:-1] + 1]))
        own[0] = -1
        chiefs = order[at]
        best = np.full(len(by), -1, np.int64)
        best[chiefs] = np.maximum(own, np.append(own[1:], -1))
        pos = np.empty(len(by), np.int64)
        pos[chiefs] = np.arange(len(chiefs))
        deepest.append(best)
        places.append(pos)
        depths.append(own)
    # window i of a span has offset - i tokens before its anchor
    low = np.maximum(offset - more, rest - deepest[0])
    high = np.minimum(offset, deepest[1])
    low[~is_chief | (deepest[0] < 0) | (deepest[1] < 0)] = 1 << 20
    count = np.maximum(high - low + 1, 0)
    spans = np.repeat(np.arange(len(by)), count)
    before = low[spans] + np.arange(len(spans)) - np.repeat(np.cumsum(count) - count, count)
    found = np.zeros(len(by), np.uint64)
    for o, own in by_bucket(before, rest + 1):
        e = spans[own]
        right = np.cumsum(depths[0] < rest - o)[places[0][e]]
        left = np.cumsum(depths[1] < o)[places[1][e]]
        pair = right * (len(by) + 1) + left
        window = offset[e] - o
        keys = [x[e] for x in turn]
        if shape.by_place:
            keys[0] = keys[0].astype(np.int64) + window
        turned = np.lexsort((*keys, pair))
        p = pair[turned]
        new = np.ones(len(p), bool)
        new[1:] = p[1:] != p[:-1]
        if shape.by_place:
            hit = ~new
        else:
            d = keys[-1][turned]
            hit = d > d[np.flatnonzero(new)[np.cumsum(new) - 1]]
        e, window = e[turned[hit]], window[turned[hit]]
        found[e] |= np.uint64(1) << window.astype(np.uint64)  # a span has one window of this offset
    every = (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - more.astype(np.uint64)))
    later = ~is_chief if shape.by_place else turn[-1] > turn[-1][chief]
    mask[rows] = np.where(later, every, found[chief])
    return mask


def covered(group: Group, answers: pa.Table, shape: Shape) -> np.ndarray:
    """Boolean per token of the group: is it in a window that occurs earlier?"""
    w, spans = shape.window, group.spans
    n = int(group.texts.ends[-1]) if len(group.texts.ends) else 0
    mask, begin = np.zeros(len(group.first), np.uint64), np.zeros(len(group.first), np.int64)
    for size, body in zip(answers["n"].to_pylist(), answers["body"].to_pylist(), strict=True):
        step, own, offset = unpack(body, size, np.uint32, np.uint64, np.uint8)
        at = np.cumsum(step.astype(np.int64))
        mask[at], begin[at] = own, spans.offset[group.first[at]].astype(np.int64) - offset  # bit 0 is this window
    # behind the first of its kind in the group, a span goes as a whole
    head = group.first[group.entry]
    ids = group.texts.ids[group.text]
    same = group.order == head if shape.by_place else ids[group.order] == ids[head]
    gone = group.order[~same]
    low, stop = [spans.low[gone]], [spans.low[gone] + spans.more[gone] + w]
    kin, entry = group.order[same], group.entry[same]
    hit = mask[entry] > 0
    kin, entry = kin[hit], entry[hit]
    for s in range(0, len(kin), 1 << 15):
        e = entry[s : s + (1 << 15)]
        bits = np.unpackbits(mask[e].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        i, j = np.nonzero(bits)
        at = spans.low[kin[s : s + (1 << 15)]][i] + begin[e][i] + j
        low.append(at)
        stop.append(at + w)
    low, stop = np.concatenate(low), np.concatenate(stop)
    order = np.argsort(low)
    low, stop = low[order], np.maximum.accumulate(stop[order])
    head = np.ones(len(low), bool)
    head[1:] = low[1:] > stop[:-1]
    marks = np.zeros(n + 1, np.int8)
    marks[low[head]] = 1
    marks[stop[np.append(head[1:], True)] if len(head) else stop] = -1
    return np.cumsum(marks[:n], dtype=np.int8).view(bool)


class Sketch:
    """Addresses of a count-min sketch of ``rows`` rows of 2 ** bits counters.

    The counters of a row are dealt into ranges; a message is one range of one row."""

    def __init__(self, bits: int, ranges: int, rows: int = 2):
        self.bits, self.rows = bits, rows
        self.width = -(-(1 << bits) // ranges)
        self.ranges = -(-(1 << bits) // self.width)

    def cells(self, windows: np.ndarray, row: int) -> np.ndarray:
        seed = np.full(len(windows), 0x51ED270B + 0x1F123BB5 * row, np.uint64)
        return (join_hash(seed, windows) >> np.uint64(64 - self.bits)).astype(np.int64)

    def send(self, windows: np.ndarray, g: int) -> pa.Table:
        """The sketch of a group's windows: its counters and their counts."""
        rows = []
        for row in range(self.rows):
            cells, counts = np.unique(self.cells(windows, row), return_counts=True)
            cuts = np.searchsorted(cells, np.arange(self.ranges + 1) * self.width)
            for part in np.flatnonzero(np.diff(cuts)).tolist():
                own = slice(cuts[part], cuts[part + 1])
                number = row * self.ranges + part
                rows.append((number, g, number, cuts[part + 1] - cuts[part], pack(steps(cells[own] - part * self.width), counts[own].astype(np.uint32))))
        return table(rows)

    def merge(self, messages: pa.Table) -> pa.Table:
        """Adds the sketches of one range; tells each group which of its counters are above one."""
        total = np.zeros(self.width, np.uint32)
        told = []
        for g, kind, n, body in zip(messages["g"].to_pylist(), messages["kind"].to_pylist(), messages["n"].to_pylist(), messages["body"].to_pylist(), strict=True):
            step, counts = unpack(body, n, np.uint32, np.uint32)
            at = np.cumsum(step.astype(np.int64))
            total[at] += np.minimum(counts, np.uint32(0xFFFFFFFF) - total[at])
            told.append((g, kind, at))
        return table([(0, g, kind, len(at), np.packbits(total[at] > 1).tobytes()) for g, kind, at in told])

    def repeated(self, windows: np.ndarray, messages: pa.Table) -> np.ndarray:
        """Boolean: do all counters call the window repeated?"""
        bits = {k: np.unpackbits(np.frombuffer(body, np.uint8))[:n].astype(bool) for k, n, body in zip(messages["kind"].to_pylist(), messages["n"].to_pylist(), messages["body"].to_pylist(), strict=True)}
        keep = np.ones(len(windows), bool)
        for row in range(self.rows):
            own, at = np.unique(self.cells(windows, row), return_inverse=True)  # in the order in which they were sent
            told = [bits[k] for k in range(row * self.ranges, (row + 1) * self.ranges) if k in bits]
            keep &= (np.concatenate(told) if told else np.zeros(len(own), bool))[at]
        return keep


def grouped(docs: DataFrame, group_bytes: int) -> tuple[DataFrame, int, int]:
    """doc_id, text, its hash and g, shuffled by g; the number of groups; the bytes of all texts.

    Rows meet in a group by doc_id and text together, so that many rows without a
    doc_id, or with one, are dealt like others."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = text_bytes(rows)
    groups = shares(total, group_bytes, 16)
    rows = rows.withColumn("sub", F.xxhash64("text"))
    return rows.withColumn("g", F.pmod(F.xxhash64("doc_id", "sub"), F.lit(groups))).repartition(groups, "g"), groups, total


def common_grams(rows: DataFrame, gram: int, letters: Callable[[np.ndarray], np.ndarray], total: int, sample_bytes: int):
    """A broadcast table of how common byte grams are, by the upper bits of their hash:
    0 to 3, for each factor of 16 above the mean.  Its size is fixed.

    From about ``sample_bytes`` of texts, chosen by hash."""
    spark = rows.sparkSession
    parts = shares(total, sample_bytes)

    def run(batches):
        counts = np.zeros(1 << COMMON_BITS, np.int64)
        for batch in batches:
            raw, _ = flat_utf8(batch["text"])
            for s in range(0, len(raw), _STEP):
                found = Grams(letters(raw[s : s + _STEP + gram - 1]))[gram]
                counts += np.bincount((found >> np.uint64(64 - COMMON_BITS)).astype(np.int64), minlength=len(counts))
        cells = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts[cells])], ["cell", "n"])

    chosen = rows.where(F.pmod(F.xxhash64(F.lit(3), "doc_id", "sub"), F.lit(parts)) == 0).select("text")
    found = chosen.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(1 << COMMON_BITS)
    counts[found["cell"].to_numpy(np.int64)] = found["n"].to_numpy(float)
    mean = max(counts.mean(), 1.0)
    return spark.sparkContext.broadcast(sum((counts > mean * 16**i).astype(np.uint8) for i in (1, 2, 3)))


def in_order(rows: pa.Table) -> pa.Table:
    """Rows of a group by doc_id, hash and text, so that every pass sees the same order."""
    rows = rows.combine_chunks()
    ids, subs = rows["doc_id"].to_numpy(), rows["sub"].to_numpy()
    order = np.lexsort((subs, ids))
    rows, ids, subs = rows.take(pa.array(order)), ids[order], subs[order]
    if ((ids[1:] == ids[:-1]) & (subs[1:] == subs[:-1])).any():
        rows = rows.sort_by([("doc_id", "ascending"), ("sub", "ascending"), ("text", "ascending")])
    return rows


def repeated_windows(rows: DataFrame, buckets: int, shape: Shape, load, marks, choose, sketch: Sketch, result, schema: str) -> DataFrame:
    """The passes over grouped rows (see ``grouped``).

    ``load(table)``: a Group of a table in order.  ``marks(group)``: hashes to count in
    the sketch, and ``choose(group, counted)``, with a boolean for each mark that is
    counted more than once, names the distinct spans that go on, and the first and last
    of their windows that matter.  ``result(table, group, covered)``: the rows to return.
    """

    def number(t: pa.Table) -> int:
        return t["g"][0].as_py()

    def count(t: pa.Table) -> pa.Table:
        t = in_order(t)
        return sketch.send(marks(load(t)), number(t))

    def send(t: pa.Table, m: pa.Table) -> pa.Table:
        if not t.num_rows:
            return table([])
        t = in_order(t)
        group = load(t)
        return send_spans(group, number(t), shape, buckets, choose(group, sketch.repeated(marks(group), m)))

    def finish(t: pa.Table, m: pa.Table) -> pa.Table:
        t = in_order(t)
        group = load(t)
        return result(t, group, covered(group, m, shape))

    counted = rows.groupBy("g").applyInArrow(count, MESSAGE).groupBy("b").applyInArrow(lambda m: sketch.merge(m), MESSAGE)
    sent = rows.groupBy("g").cogroup(counted.groupBy("g")).applyInArrow(send, MESSAGE)
    answers = sent.groupBy("b").applyInArrow(lambda m: meet_spans(m, shape), MESSAGE)
    return rows.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(finish, schema)
