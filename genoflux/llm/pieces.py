"""Token ids of texts from those of their distinct pieces.

A byte-level BPE treats each match of the splitting pattern on its own.  A task
therefore looks up each distinct piece once and assembles documents by gathering
from one flat array of ids.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import regex

#: Fixed value: the splitting pattern that ``split_bounds`` implements over arrays.
ARRAY_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 0


@cache
def _kinds() -> np.ndarray:
    """Kind of every code point, as the regex library classes it."""
    kinds = np.full(0x110000, _OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, name in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(name, every):
            kinds[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    return kinds


def split_bounds(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Starts of the matches of ARRAY_PATTERN in texts that stand in a row.

    ``points``: code points of all texts; ``ends``: the end of each text.  The
    matches cover every text, so the starts say all."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _kinds()[points]
    first = np.ones(n + 1, bool)  # starts of runs of one kind within one text
    np.not_equal(kind[1:], kind[:-1], out=first[1:n])
    closed = np.zeros(n + 1, bool)  # here a text begins or ends
    closed[0] = True
    closed[ends] = True
    first |= closed
    start = first[:n].copy()
    # a run of white space that something follows gives up its last character
    run = np.flatnonzero(first)
    stop = run[1:]
    white = kind[run[:-1]] == _SPACE
    last = (stop - 1)[white & ~closed[stop]]
    start[last] = True
    plain = last[points[last] == 32]
    start[plain + 1] = False  # a blank belongs to what follows
    # contractions: an apostrophe alone in its run, no blank before it, then letters
    quote = np.flatnonzero((points == 39) & start & first[1:])
    quote = quote[quote + 1 < n]
    quote = quote[~closed[quote + 1] & (kind[quote + 1] == _LETTER)]
    if len(quote):
        one = points[quote + 1]
        two = np.where(quote + 2 < n, points[np.minimum(quote + 2, n - 1)], 0)
        two = np.where(closed[np.minimum(quote + 2, n)], 0, two)
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[quote[single | double] + 1] = False
        for found, size in ((single, 2), (double, 3)):
            at = quote[found] + size
            at = at[at < n]
            start[at] = True
    return np.flatnonzero(start)


class _Numbered(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


class Splitter:
    """Cuts texts into the matches of a pattern."""

    def __init__(self, pattern: str):
        self.by_array = pattern == ARRAY_PATTERN
        self.split = regex.compile(pattern).findall

    def __call__(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The pieces of all texts in a row; how many each text has."""
        if not self.by_array:
            lists = [self.split(t) for t in texts]
            return [p for x in lists for p in x], np.fromiter(map(len, lists), np.int64, len(lists))
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        joined = "".join(texts)
        starts = split_bounds(np.frombuffer(joined.encode("utf-32-le"), np.uint32), ends)
        bounds = [*starts.tolist(), len(joined)]
        return [joined[a:b] for a, b in zip(bounds, bounds[1:], strict=False)], np.diff(np.searchsorted(starts, np.concatenate([[0], ends])))


class PieceTable:
    """Ids of the distinct pieces a task has met.

    ``encode`` maps a list of new pieces to (counts, flat ids); ``known`` are pieces,
    counts and flat ids to begin with.  The table goes back to those when it holds more
    than ``most`` others, or ``most_points`` code points of them, so its memory is bounded;
    that changes time, never results.
    """

    def __init__(self, pattern: str, encode, most: int = 400_000, known: tuple[list[str], np.ndarray, np.ndarray] | None = None, most_points: int = 1 << 25):
        self.split, self.encode, self.most_points = Splitter(pattern), encode, most_points
        self.known = known or ([], np.zeros(0, np.int64), np.zeros(0, np.uint32))
        self.most = most + len(self.known[0])
        self._clear()

    def _clear(self):
        names, self.counts, self.flat = self.known
        self.points = 0
        self.index = _Numbered(zip(names, range(len(names)), strict=True))
        self.starts = np.cumsum(self.counts) - self.counts

    def _numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces of all texts in a row; how many each text has."""
        found, sizes = self.split(texts)
        return np.fromiter(map(self.index.__getitem__, found), np.int32, len(found)), sizes

    def blocks(self, groups):
        """For each group of texts: ids of all its texts in a row, and the number
        of each text.  New pieces of all groups are encoded together."""
        if len(self.index) > self.most or self.points > self.most_points:
            self._clear()
        old = len(self.index)
        try:
            numbers = [self._numbers(texts) for texts in groups]
            if len(self.index) > old:
                new = list(self.index)[old:]
                self.points += sum(map(len, new))
                counts, flat = self.encode(new)
                self.counts = np.concatenate([self.counts, counts])
                self.flat = np.concatenate([self.flat, flat])
                self.starts = np.cumsum(self.counts) - self.counts
        except BaseException:
            self._clear()  # numbers without ids must not outlive an error
            raise
        for where, sizes in numbers:
            counts = self.counts[where]
            ends = np.cumsum(counts)
            total = int(ends[-1]) if len(ends) else 0
            out = self.flat[np.repeat(self.starts[where] - ends + counts, counts) + np.arange(total)] if total else np.zeros(0, np.uint32)
            yield out, np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])])
