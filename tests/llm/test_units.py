"""Fill-in-the-middle, line dedup and spelling variants against brute force."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from genoflux.llm import line_dedup, middle, spelling

from .cases import ROWS, same, table

LINES = ["a line of twenty code points", "  A LINE of twenty code points\t", "another one that is long enough é", "short", "", "  kept blank of twenty points  ", "x" * 19, "y" * 20]


def lined(seed, n=60, many=9):
    rng = np.random.default_rng(seed)
    return [(int(i) if i % 7 else None, "\n".join(LINES[int(x)] for x in rng.integers(0, len(LINES), int(rng.integers(0, many)))), "en", "s", 1) for i in range(n)]


MORE = [
    (30, "<P> is here\nand more", "en", "a", 1),
    (31, "\n\n\n", "en", "a", 1),
    (32, "one line", "en", "a", 1),
    (33, "\r\nwith\rreturns\r\n", "en", "a", 1),
    (34, "<\n<P\n<\nS>", "en", "a", 1),
    (35, "é\n𝄞𝄞\n" * 3000 + "end", "en", "a", 1),
]


# --- fill in the middle ---


def brute_middle(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    if not text or any(m in text for m in middle.MARKS) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, y, z = ("".join(p) for p in (units[:a], units[a:b], units[b:]))
    form = "spm" if h[3] % 100 < spm else "psm"
    return doc_id, n, form, len(x), len(y), f"<S>{z}<P>{x}<M>{y}" if form == "spm" else f"<P>{x}<S>{z}<M>{y}"


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (40, 0), (0, 50), (100, 100)])
def test_middle_is_brute_force(spark, rate, spm):
    rows = ROWS + MORE + lined(1)
    found = middle.fill_in_middle(table(spark, rows), rate=rate, spm=spm)
    found = found.withColumn("restored", middle.restored(F.col("form"), F.col("output"))).collect()
    same([tuple(r)[:6] for r in found], [brute_middle(r[0], r[1], rate=rate, spm=spm) for r in rows])
    same([(r.doc_id, r.restored) for r in found], [(r[0], r[1] or "") for r in rows])
    assert {r.form for r in found} >= ({"psm", "spm"} if (rate, spm) == (100, 50) else {"plain"})
    assert middle.fill_in_middle(table(spark, [])).count() == 0


def test_marks_must_be_apart(spark):
    for marks in (("<P>", "<P>x", "<M>"), ("aba", "<S>", "<M>"), ("<PX", "XS>", "<M>")):
        with pytest.raises(ValueError):
            middle.fill_in_middle(table(spark), marks=marks)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 30)), max_size=70), min_size=1, max_size=5), st.data())
def test_lanes_reach_every_rank(texts, data):
    sizes = np.array([len(t) for t in texts])
    flat = np.array([w for t in texts for w in t], np.int64).reshape(-1, 2)
    lists = middle.SkipLists(sizes, flat[:, 0], flat[:, 1])
    asked = [(t, r) for t in range(len(texts)) for r in range(len(texts[t]) + 1)]
    got = lists.find(*np.array(asked).T)
    assert got.T.tolist() == [[sum(w[k] for w in texts[t][:r]) for k in (0, 1)] for t, r in asked]
    # each express lane holds fewer nodes than the one below, and all widths of a text
    assert all(len(a[1]) >= len(b[1]) for a, b in itertools.pairwise(lists.lanes))


# --- lines ---


def brute_lines(rows, least=20, documents=3):
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", s))
    rank = lambda d: 2**63 - 1 if d is None else d
    holds = {}
    for r in rows:
        for s in (r[1] or "").split("\n"):
            holds.setdefault(key(s), set()).add(rank(r[0]))
    gone = {k: max(v) for k, v in holds.items() if len(k) >= least and len(v) >= documents}
    out = []
    for r in rows:
        parts = (r[1] or "").split("\n")
        keep = [s for s in parts if gone.get(key(s), rank(r[0])) == rank(r[0])]
        out.append((r[0], len(parts), len(parts) - len(keep), "\n".join(keep)))
    return out


@pytest.mark.parametrize(("size", "documents", "batch"), [(500_000, 3, 10_000), (40, 3, 7), (7, 2, 10_000), (11, 4, 3), (3, 3, 1)])
def test_lines_are_brute_force(spark, size, documents, batch):
    rows = ROWS + MORE + lined(2) + lined(3, 25, 30)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        docs = table(spark, rows)
        found = line_dedup.without_lines(docs, line_dedup.keep_bitmaps(docs, least_docs=documents, range_lines=size)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    same([(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in found], brute_lines(rows, documents=documents))
    assert sum(r.n_dropped for r in found) > 20


def test_a_line_of_all_documents_spreads(spark):
    """One line in every document: its ranges are even, and all but one document lose it."""
    docs = table(spark, [(i, f"the line that all documents share\nline of its own {i:09}", "en", "s", 1) for i in range(3000)])
    entries = line_dedup.line_entries(docs, 20)
    order = ["key", F.desc("doc"), "text_key", "line"]
    sizes = entries.repartitionByRange(10, *order).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 2 * 6000 / 10
    found = line_dedup.without_lines(docs, line_dedup.keep_bitmaps(docs, range_lines=600)).collect()
    assert [r.doc_id for r in found if not r.n_dropped] == [2999] and len(found) == 3000


def test_lines_of_nothing(spark):
    assert line_dedup.remove_repeated_lines(table(spark, [])).count() == 0
    found = line_dedup.remove_repeated_lines(table(spark, [(1, None, "x", "s", 1), (2, "", "x", None, 1), (3, "\n", "x", None, 1)])).collect()
    same([(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in found], [(1, 1, 0, ""), (2, 1, 0, ""), (3, 2, 0, "\n")])


# --- spelling ---


def brute_words(rows, slip=199, least=6):
    n = Counter()
    for r in rows:
        for w in re.findall(r"[A-Za-zÀ-ÿ]+", r[1] or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{w}".encode())
            if slip and h % slip == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                n[w] += 1
    return n


def brute_variants(rows, slip=199, least=6, least_n=5, times=5):
    n = {w: c for w, c in brute_words(rows, slip, least).items() if c >= least_n}
    forms, out = {}, []
    for w in n:
        near = [x for x in n if spelling.one_apart(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        forms[w] = best if best is not None and n[best] >= times * n[w] else None, len(near)
    for w in n:
        root = w
        while forms[root][0]:
            root = forms[root][0]
        form = forms[w][0]
        out.append((w, form, root, n[w], forms[w][1], n[form] if form else None))
    return out


def spelled(seed=5, n=80):
    rng = np.random.default_rng(seed)
    base = ["lettering", "Çéþßæøå", "aaaaaaa", "banana", "listen", "silent", "enlist", "tinsel"]
    words = [*base, "a" * 300]
    for w in base:
        for _ in range(6):
            i, c = int(rng.integers(0, len(w))), "abé÷z"[int(rng.integers(0, 5))]
            words += [w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]]
    p = 1 / np.arange(1, len(words) + 1) ** 1.3
    pick = lambda k: " ".join(words[int(x)] for x in rng.choice(len(words), k, p=p / p.sum()))
    chain = (901, "lanterns " * 200 + "lanternz " * 30 + "lanternzy " * 5, "en", "s", 1)
    return [(int(i) if i % 5 else None, pick(60), "en", "s", 1) for i in range(n)] + [(900, pick(3000), "en", "s", 1)] * 2 + [chain]


@pytest.mark.parametrize(("slip", "first", "second"), [(199, 1, None), (3, 1, 4), (0, 2, 4), (7, 3, 2)])
def test_variants_are_brute_force(spark, slip, first, second):
    rows = ROWS + MORE + spelled()
    found = spelling.variants(table(spark, rows), slip=slip, first=first, second=second).collect()
    same([(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found], brute_variants(rows, slip))
    assert any(r.form for r in found)
    assert slip in (3, 7) or any(r.form and r.form != r.root for r in found)


def test_long_texts_are_counted_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(spelling, "_CHUNK", 64)
    rows = [(1, "é" * 400 + " words and words, Ünder ÿÿÿÿÿÿ " * 200, "en", "s", 1)]
    run = spelling.word_counts(table(spark, rows), 3, 1, most_held=2)
    same([(r.word, r.n) for r in run.collect()], list(brute_words(rows, 3, 1).items()))


def test_variants_of_nothing(spark):
    assert spelling.variants(table(spark, [])).count() == 0
    assert spelling.variants(table(spark, [(1, None, "x", "s", 1), (2, "", "x", None, 1), (3, "12 ab", "x", None, 1)])).count() == 0


WORD = st.text("abé", min_size=1, max_size=9)


@settings(max_examples=300, deadline=None)
@given(st.lists(WORD, unique=True, max_size=40))
def test_close_pairs_are_all(words):
    want = {(i, j) for j in range(len(words)) for i in range(j) if spelling.one_apart(words[i], words[j])}
    assert spelling.close_pairs(words) == want


@settings(max_examples=300, deadline=None)
@given(WORD, st.integers(0, 8), st.sampled_from("abéz"), st.sampled_from("idr"), st.sampled_from([(1, 3), (1, 7), (2, 2), (2, 4), (3, 1), (3, 3)]))
def test_signatures_miss_no_pair(word, at, letter, kind, levels):
    at = min(at, len(word) - 1)
    other = {"i": word[:at] + letter + word[at:], "d": word[:at] + word[at + 1 :], "r": word[:at] + letter + word[at + 1 :]}[kind]
    assert other == word or spelling.one_apart(word, other)
    hashes = spelling.part_hashes(pa.array([word, other]), levels[0] * levels[1])
    assert any((hashes[0, list(c)] == hashes[1, list(c)]).all() for c in spelling.choices(2, *levels))


def test_too_few_parts():
    with pytest.raises(ValueError):
        spelling.choices(2, 1, 2)


@pytest.mark.parametrize(("a", "b", "near"), [("abc", "abd", True), ("abc", "ab", True), ("abc", "xabc", True), ("abc", "abc", False), ("abc", "acb", False), ("", "a", True), ("ab", "abcd", False), ("é", "e", True)])
def test_one_apart(a, b, near):
    assert spelling.one_apart(a, b) is near and spelling.one_apart(b, a) is near
