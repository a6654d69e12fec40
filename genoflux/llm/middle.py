"""Fill-in-the-middle forms, cut by an indexable skip list.

The lines of a text are the units of a skip list.  Every link of a lane carries how
many units, code points and bytes it passes, so going down the lanes and adding up
widths arrives at a rank exactly, and says at which code point and byte it lies,
without a look at what is passed.  The lists of all texts of a block stand side by side
in arrays, and their cuts go down together.  No row leaves its partition.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flat_utf8, slices

#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class SkipLists:
    """Skip lists over the units of several texts.

    ``sizes``: units of each text; ``points`` and ``octets``: of each unit, text after
    text.  A text of n units has the nodes 0 to n, node r standing behind r units; node 0
    is in every lane, the others in a lane with half the chance of the lane below.
    """

    def __init__(self, sizes: np.ndarray, points: np.ndarray, octets: np.ndarray):
        heads = np.cumsum(sizes + 1) - sizes - 1
        total = int(sizes.sum()) + len(sizes)
        link = np.ones(total, bool)
        link[heads + sizes] = False
        widths = np.zeros((3, total), np.int64)
        widths[0, link], widths[1, link], widths[2, link] = 1, points, octets
        height = np.arange(total, dtype=np.uint64) * _MIX
        height ^= height >> np.uint64(32)
        height[heads] = np.uint64(0)  # divisible by every power of two
        self.lanes = []
        down = np.arange(total)
        while True:
            self.lanes.append((heads, down, ~link, widths))
            if len(down) == len(sizes) or len(self.lanes) > 60:
                return
            keep = np.flatnonzero(height & np.uint64(1) == 0)
            height = height[keep] >> np.uint64(1)
            # widths of the links that are passed add up; those behind a text's last node are never followed
            widths = np.add.reduceat(widths, keep, axis=1) if len(keep) else widths[:, :0]
            heads = np.searchsorted(keep, heads)
            link = np.ones(len(keep), bool)
            link[np.append(heads[1:], len(keep)) - 1] = False
            down = keep

    def find(self, text: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Code points and bytes before the node of that rank, for each pair of text and rank
        (two rows)."""
        sums = np.zeros((3, len(text)), np.int64)
        at = self.lanes[-1][0][text]
        for k in range(len(self.lanes) - 1, -1, -1):
            _, down, last, widths = self.lanes[k]
            moving = np.arange(len(text))
            while len(moving):
                here = at[moving]
                moving, here = (x[~last[here] & (sums[0, moving] + widths[0, here] <= rank[moving])] for x in (moving, here))
                sums[:, moving] += widths[:, here]
                at[moving] += 1
            if k:
                at = down[at]
        assert (sums[0] == rank).all()
        return sums[1:]


def line_units(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of each text (a line feed ends its line), code points and bytes of each line."""
    closing = np.zeros(len(raw) + 1, bool)
    closing[1:] = raw == 10
    closing[bounds] = True
    ends = np.flatnonzero(closing[1:]) + 1
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)]
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    sizes = np.diff(np.searchsorted(ends, bounds, "right")) if len(bounds) > 1 else np.zeros(0, np.int64)
    return sizes, before[ends] - before[starts], ends - starts


def _draws(seed: int, doc_id: int | None) -> list[int]:
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n (lines), form, prefix_chars,
    middle_chars (code points; null if plain), output.

    A text is cut into lines (a line feed belongs to the line it ends).  Of the sha256 of
    ``seed:doc_id`` (nothing for a null doc_id) four 32-bit numbers are drawn: two cut
    ranks from 0 to n, a number that leaves the text plain if it is ``rate`` or more in a
    hundred, and one that says spm below ``spm`` in a hundred, else psm.  psm is prefix,
    suffix, middle with their marks before them, spm is suffix, prefix, middle.  An empty
    or null text, and one that contains a mark, stays plain.  Rows that repeat have equal
    results.  Only doc_id and text are read.
    """
    if any(a != b and (a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)) + (a != b))) for a in marks for b in marks):
        raise ValueError("marks must not overlap each other or themselves")
    before_prefix, before_suffix, before_middle = (m.encode() for m in marks)

    def rows(ids: list, raw: np.ndarray, bounds: np.ndarray, marked: np.ndarray) -> pa.RecordBatch:
        sizes, points, octets = line_units(raw, bounds)
        draws = np.array([_draws(seed, d) for d in ids], np.int64).reshape(-1, 4)
        plain = (sizes == 0) | marked | (draws[:, 2] % 100 >= rate)
        which = np.flatnonzero(~plain)
        cuts = np.sort(draws[which, :2] % (sizes[which, None] + 1), axis=1)
        lists = SkipLists(sizes, points, octets)
        at = lists.find(np.repeat(which, 2), cuts.ravel()).reshape(2, len(which), 2)
        data, output = raw.tobytes(), []
        first, second = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        first[which], second[which] = at[1, :, 0], at[1, :, 1]
        backward = draws[:, 3] % 100 < spm
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if plain[i]:
                output.append(data[a:b])
                continue
            x, y = a + int(first[i]), a + int(second[i])
            parts = (before_suffix, data[y:b], before_prefix, data[a:x]) if backward[i] else (before_prefix, data[a:x], before_suffix, data[y:b])
            output.append(b"".join((*parts, before_middle, data[x:y])))
        chars = np.zeros((2, len(ids)), np.int64)
        chars[0, which], chars[1, which] = at[0, :, 0], at[0, :, 1] - at[0, :, 0]
        form = np.where(plain, "plain", np.where(backward, "spm", "psm")).tolist()
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(form, pa.string()), pa.array(chars[0], mask=plain), pa.array(chars[1], mask=plain), pa.array(output, pa.binary()).cast(pa.string())],
            ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
        )

    def run(batches):
        for batch in batches:
            marked = np.zeros(batch.num_rows, bool)
            for m in marks:
                marked |= pc.fill_null(pc.match_substring(batch["text"], m), False).to_numpy(zero_copy_only=False)
            ids = batch["doc_id"].to_pylist()
            raw, bounds = flat_utf8(batch["text"])
            for a, b in slices(bounds, 4 << 20):
                yield rows(ids[a:b], raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], marked[a:b])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _OUT)


def restored(form: Column, output: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The exact text, from an output and its form alone."""
    p, s, m = map(F.lit, marks)
    behind = lambda mark: F.split_part(output, mark, F.lit(2))
    middle = behind(m)
    psm = F.concat(F.split_part(behind(p), s, F.lit(1)), middle, F.split_part(behind(s), m, F.lit(1)))
    spm = F.concat(F.split_part(behind(p), m, F.lit(1)), middle, F.split_part(behind(s), p, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
