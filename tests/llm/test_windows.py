"""The radix sort behind the two repeat removers, against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from genoflux.llm import suffix_dedup, windows

from .cases import same


def test_radix_order_is_lexicographic():
    rng = np.random.default_rng(0)
    for n, d in ((0, 2), (1, 3), (500, 4)):
        digits = rng.integers(0, 3, (n, d)).astype(np.uint64)
        order, shared = windows.radix_order(digits)
        rows = [tuple(r) for r in digits[order].tolist()]
        assert rows == sorted(map(tuple, digits.tolist()))
        for i in range(1, n):
            want = next((j for j in range(d) if rows[i][j] != rows[i - 1][j]), d)
            assert shared[i] == want


@pytest.mark.parametrize("kind", [np.uint8, np.uint32])
def test_common_depth(kind):
    rng = np.random.default_rng(1)
    tokens, group = rng.integers(0, 2, (300, 13)).astype(kind), rng.integers(0, 4, 300)
    order, depth = windows.common_depth(tokens, group)
    for i in range(1, 300):
        a, b = order[i - 1], order[i]
        want = -1 if group[a] != group[b] else next((j for j in range(13) if tokens[a][j] != tokens[b][j]), 13)
        assert depth[i] == want


def brute(rows, w):
    """Removed bytes of each row: windows that start in a document with a smaller id."""
    first = {}
    for name, text in rows:
        for i in range(len(text) - w + 1):
            first[text[i : i + w]] = min(first.get(text[i : i + w], name), name)
    out = []
    for name, text in rows:
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - w + 1):
            if first[text[i : i + w]] < name:
                gone[i : i + w] = True
        out.append((name, gone.tobytes()))
    return out


@pytest.mark.parametrize("weak", [False, True])
def test_groups_and_masks(weak, monkeypatch):
    """With hashes of three bits nearly all spans clash; the bytes still decide."""
    whole = windows.join_hash
    if weak:
        monkeypatch.setattr(windows, "join_hash", lambda a, b: whole(a, b) & np.uint64(0xE000000000000000))
    rng, w = np.random.default_rng(2), 9
    shape = windows.Shape(w, 3, False, True)
    rows = [(int(rng.integers(0, 25)), bytes(rng.integers(97, 99, int(rng.integers(0, 60))).astype(np.uint8))) for _ in range(40)]
    rows += [(30, rows[3][1]), (31, rows[3][1] + b"x"), (31, rows[5][1])]
    groups, sent = [], []
    for g in range(3):
        own = sorted((r for i, r in enumerate(rows) if i % 3 == g))
        ids, raw = np.array([r[0] for r in own]), np.frombuffer(b"".join(r[1] for r in own), np.uint8)
        ends = np.cumsum([len(r[1]) for r in own])
        texts = windows.Texts(ids, np.arange(len(own)), ends, lambda a, b, raw=raw: suffix_dedup._BYTES[raw[a:b]], raw)
        group = windows.make_group(texts, shape)
        groups.append((own, group))
        every = np.arange(len(group.first))
        sent.append(windows.send_spans(group, g, shape, 2, (every, np.zeros(len(every), np.int64), group.spans.more[group.first])))
    m = pa.concat_tables(sent).combine_chunks()
    answers = pa.concat_tables([windows.meet_spans(m.filter(pa.compute.equal(m["b"], b)), shape) for b in (0, 1) if b in m["b"].to_pylist()])
    got = []
    for g, (own, group) in enumerate(groups):
        gone = windows.covered(group, answers.filter(pa.compute.equal(answers["g"], g)), shape)
        bounds = np.concatenate([[0], group.texts.ends])
        got += [(r[0], gone[a:b].tobytes()) for r, a, b in zip(own, bounds[:-1], bounds[1:], strict=True)]
    same(got, brute(rows, w))


def test_rows_of_one_id_are_dealt(spark):
    docs = spark.createDataFrame([(None, f"text number {i} of many") for i in range(400)] + [(7, f"row {i}") for i in range(400)], "doc_id long, text string")
    rows, groups, _ = windows.grouped(docs, 512)
    sizes = [r["count"] for r in rows.groupBy("g").count().collect()]
    assert len(sizes) > groups / 2 and max(sizes) < 200
