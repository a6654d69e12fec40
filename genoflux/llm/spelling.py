"""Spelling variants: words one letter apart, found by PartEnum signatures.

A word is the set of its letters, each copy of a letter being another element, so two
words one insertion, deletion or replacement apart differ in at most two elements.
The elements are dealt to parts; two sets that differ in at most two elements are equal
on all parts but two (or, with two levels of parts, on all but fewer of some
first-level part).  So each word signs every such choice of parts, words that share a
signature meet, and no pair is missed.  What meets is verified: words one letter apart
agree in their first or in their last half, so within a signature only those that
share a half are compared, which keeps the work of a large one nearly linear.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, flat_utf8, kept_table, shares, slices

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ASCII = np.zeros(256, bool)
_ASCII[97:123] = True
_CHUNK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# --- words ---


def letters_only(raw: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased and a blank for each that is not of a letter a-z or U+00C0 to U+00FF."""
    out = _LOWER[raw]
    latin = raw == 0xC3  # leads exactly the letters U+00C0 to U+00FF
    keep = _ASCII[out] | latin
    keep[1:] |= latin[:-1]
    out[~keep] = 0x20
    return out


def shortened(word: bytes, h: int) -> bytes:
    """The word without its code point ``h % length``."""
    text = word.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def word_counts(docs: DataFrame, slip: int = 199, least_points: int = 6, most_held: int = 200_000) -> DataFrame:
    """word, n: how often each word of ``least_points`` code points or more occurs in all texts.

    Words are maximal runs `[A-Za-z\\u00C0-\\u00FF]+`, A-Z lower-cased.  Of a run whose
    crc32 (UTF-8 of ``doc_id:run``; nothing for a null doc_id) ``slip`` divides, the code
    point crc32 % length is left out (0: of no run).  Texts are counted in tasks, at
    most ``most_held`` words at a time.
    """

    def full(word: bytes) -> bool:
        return len(word) >= least_points and len(word) - word.count(b"\xc3") >= least_points

    def run(batches):
        held: Counter = Counter()

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        def settle(prefix: int, own: Counter):
            for w, n in own.items():
                h = zlib.crc32(w, prefix)
                if slip and h % slip == 0:
                    w = shortened(w, h)
                if full(w):
                    held[w] += n

        for batch in batches:
            raw, bounds = flat_utf8(batch["text"])
            ids = batch["doc_id"].to_pylist()
            for x, y in slices(bounds, 4 << 20):
                data = letters_only(raw[bounds[x] : bounds[y]]).tobytes() if y - x > 1 else None
                for i in range(x, y):
                    prefix, own, at = zlib.crc32(f"{'' if ids[i] is None else ids[i]}:".encode()), Counter(), int(bounds[i])
                    if data is not None:
                        # letters of two bytes never reach over a text's end
                        settle(prefix, Counter(data[at - bounds[x] : bounds[i + 1] - bounds[x]].split()))
                    else:  # one long text, in pieces that end between words
                        end, rest = int(bounds[i + 1]), []
                        while at < end:
                            stop = min(end, at + _CHUNK)
                            while stop < end and raw[stop] & 0xC0 == 0x80:
                                stop += 1
                            piece = letters_only(raw[at:stop]).tobytes()
                            last = piece.rfind(b" ") if stop < end else len(piece)
                            if last < 0:
                                rest.append(piece)
                            else:
                                own.update(b"".join([*rest, piece[:last]]).split())
                                rest = [piece[last:]]
                            at = stop
                            if len(own) > most_held:
                                settle(prefix, own)
                                own.clear()
                                if len(held) > most_held:
                                    yield flush()
                        own.update(b"".join(rest).split())
                        settle(prefix, own)
                    if len(held) > most_held:
                        yield flush()
        if held:
            yield flush()

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


# --- signatures ---


def choices(distance: int, first: int, second: int) -> list[tuple[int, ...]]:
    """Sets of parts (first-level part f has the parts f * second to f * second + second - 1)
    such that two sets of elements that differ in at most ``distance`` of them are equal on
    all parts of one of these."""
    spare = math.ceil((distance + 1) / first) - 1  # differences of the first-level part that has the fewest
    if spare >= second:
        raise ValueError("too few parts for this distance")
    return [tuple(f * second + p for p in c) for f in range(first) for c in itertools.combinations(range(second), second - spare)]


def part_hashes(words: pa.Array, parts: int) -> np.ndarray:
    """A hash of each word's elements in each part (rows: words)."""
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(length)), length)
    order = np.lexsort((points, owner))
    letter, row = points[order], owner[order]
    head = np.concatenate([[True], (letter[1:] != letter[:-1]) | (row[1:] != row[:-1])]) if len(row) else np.zeros(0, bool)
    begin = np.flatnonzero(head)
    copy = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row))))
    element = _mixed((letter.astype(np.uint64) << np.uint64(32)) + copy.astype(np.uint64) + _ODD)
    out = np.zeros((len(length), parts), np.uint64)
    np.add.at(out, (row, (element % np.uint64(parts)).astype(np.int64)), _mixed(element))
    return out


def signatures(words: DataFrame, distance: int, first: int, second: int) -> DataFrame:
    """signature, word, n: a row for each word and choice of parts."""
    chosen = choices(distance, first, second)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                own = batch.slice(a, 2000)
                hashes = part_hashes(own["word"], first * second)
                made = np.empty((own.num_rows, len(chosen)), np.uint64)
                with np.errstate(over="ignore"):
                    for k, c in enumerate(chosen):
                        made[:, k] = _mixed(sum((_mixed(hashes[:, p] + np.uint64(p + 1) * _ODD) for p in c), np.full(own.num_rows, k + 1, np.uint64)))
                at = pa.array(np.repeat(np.arange(own.num_rows), len(chosen)))
                yield pa.RecordBatch.from_arrays([pa.array(made.ravel().view(np.int64)), own["word"].take(at), own["n"].take(at)], ["signature", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "signature long, word string, n long")


def one_apart(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes one word the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    p = 0
    while p < len(a) and a[p] == b[p]:
        p += 1
    return a[p:] == b[p + 1 :] if len(a) < len(b) else a[p + 1 :] == b[p + 1 :]


def close_pairs(words: list[str]) -> set[tuple[int, int]]:
    """Pairs (i < j) of words one apart."""
    if len(words) < 2:
        return set()
    if len(words) < 12:
        return {(i, j) for j in range(1, len(words)) for i in range(j) if one_apart(words[i], words[j])}
    halves: dict = {}
    for i, w in enumerate(words):
        m = len(w) // 2
        halves.setdefault((len(w), 0, w[:m]), ([], []))[0].append(i)
        halves.setdefault((len(w), 1, w[m:]), ([], []))[0].append(i)
        m = (len(w) - 1) // 2  # as the longer word of a pair
        halves.setdefault((len(w) - 1, 0, w[:m]), ([], []))[1].append(i)
        halves.setdefault((len(w) - 1, 1, w[m + 1 :]), ([], []))[1].append(i)
    found = set()
    for short, long in halves.values():
        for k, i in enumerate(short):
            found.update((min(i, j), max(i, j)) for j in itertools.chain(short[:k], long) if one_apart(words[i], words[j]))
    return found


def near_pairs(words: DataFrame, first: int = 1, second: int | None = None, distance: int = 2) -> DataFrame:
    """word, other, other_n for both directions of each pair of words one apart, once or more often.

    ``words``: distinct words and their n.  The number of parts grows with the words
    (7, and one more each time they are eight times as many), so a signature's words stay few.
    """
    words = words.where("word is not null")
    total = words.count()
    if second is None:
        second = 7 + max(0, round(math.log(max(1, total) / 200_000, 8)))

    def run(batches):
        key, held = None, ([], [])

        def pairs(own):
            return [x for i, j in close_pairs(own[0]) for x in ((own[0][i], own[0][j], own[1][j]), (own[0][j], own[0][i], own[1][i]))]

        def batch_of(found):
            a, b, n = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n, pa.int64())], ["word", "other", "other_n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch["signature"].to_numpy()
            begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            end = np.append(begin[1:], len(keys))
            inner = (end - begin > 1) | (begin == 0) | (end == len(keys))  # others stand alone
            words, n, found = batch["word"].to_pylist(), batch["n"].to_pylist(), []
            for a, b in zip(begin[inner].tolist(), end[inner].tolist(), strict=True):
                if key is None or keys[a] != key:
                    found += pairs(held)
                    key, held = keys[a], ([], [])
                held[0].extend(words[a:b])
                held[1].extend(n[a:b])
            if found:
                yield batch_of(found)
        if found := pairs(held):
            yield batch_of(found)

    chosen = len(choices(distance, first, second))
    parts = shares(total * chosen, 2_000_000, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    signed = signatures(words, distance, first, second)
    return signed.repartition(parts, "signature").sortWithinPartitions("signature").mapInArrow(run, "word string, other string, other_n long")


# --- forms ---


def roots(forms: DataFrame) -> DataFrame:
    """word, root of ``forms`` (word, form): the end of the way that starts at each word.

    Each round doubles the steps, until no root has a form.  There are no circles, as n
    grows along the way.
    """
    state = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        state = cut(state.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), "further"))
        if not state.where("further is not null").limit(1).count():
            return state.select("word", "root")
        state = state.drop("further")


def variants(docs: DataFrame, slip: int = 199, least_points: int = 6, least_n: int = 5, times: int = 5, first: int = 1, second: int | None = None) -> DataFrame:
    """One row for each word of ``docs``: word, form, root, n, n_near, form_n.

    Words (see ``word_counts``) occur at least ``least_n`` times.  Two are near if exactly
    one inserted, deleted or replaced code point makes one the other.  A word's form is
    its near word of largest n (ties: the smallest in code-point order) if that n is at
    least ``times`` its own, else null; its root is what following forms ends at, itself if
    it has none (``times`` above 1, so that ways end).  Null and empty texts have no words; rows that repeat count each.  Only
    doc_id and text are read.
    """
    words = kept_table(word_counts(docs, slip, least_points).where(F.col("n") >= least_n), "words")
    near = near_pairs(words, first, second).select("word", F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other")).alias("near"), F.lit(None).cast("long").alias("n"))
    own = words.select("word", F.lit(None).cast(near.schema["near"].dataType).alias("near"), "n")
    # a word has few near ones: an alphabet's letters times twice its length
    found = own.unionByName(near).groupBy("word").agg(F.max("n").alias("n"), F.collect_set("near").alias("near"))
    best = F.array_min("near")
    found = found.select("word", "n", F.size("near").cast("long").alias("n_near"), F.when(-best["less"] >= times * F.col("n"), best).alias("best"))
    found = kept_table(found.select("word", "n", "n_near", F.col("best.other").alias("form"), (-F.col("best.less")).alias("form_n")), "near")
    ends = roots(found.where("form is not null").select("word", "form"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
