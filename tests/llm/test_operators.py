import hashlib
import re
import zlib
from itertools import groupby

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from genoflux.llm import bpe, exact_dedup, mixing, pieces, pii, quality, simhash, substring_dedup, suffix_dedup, token_store, topk
from genoflux.llm.common import shared_folder

from .cases import ROWS, ordered, same, squeezed, table, words

RANKS = P.path("byte_bpe_50k.tiktoken")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# --- quality ---


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.random((1500, quality.N_FEATURES))
    y = ((x[:, 3] > 0.5) ^ (x[:, 7] > 0.3)).astype(float)
    model = quality.fit(x[:1000], y[:1000], trees=60)
    assert ((model.scores(x[1000:]) >= 0.5) == y[1000:]).mean() > 0.95
    same_model = quality.fit(x[:1000], y[:1000], trees=60)
    assert (model.scores(x) == same_model.scores(x)).all()
    for labels in (np.zeros(10), np.ones(10), np.zeros(0)):
        assert np.isfinite(quality.fit(x[: len(labels)], labels).scores(x[:3])).all()


def test_quality_on_awkward_rows(spark):
    docs = table(spark)
    labels = spark.createDataFrame([(5, 1), (3, 1), (18, 0), (19, 0), (99, 1), (None, 1), (12, None), (16, 7)], "doc_id long, quality int")
    model = quality.train(docs, labels, trees=3)
    found = quality.score(docs, model).collect()
    assert len(found) == len(ROWS) and all(0 <= r.score <= 1 for r in found)
    assert quality.keep_good(docs, model, 0.0).schema == docs.schema
    assert quality.keep_good(docs, model, 0.0).count() == len(ROWS) and quality.keep_good(docs, model, 1.1).count() == 0
    assert quality.score(table(spark, []), quality.train(table(spark, []), labels)).count() == 0


def test_quality_held_out(spark):
    root = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    scored = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).toPandas()
    assert ((scored.score >= 0.5) == (scored.quality == 1)).mean() > 0.95


def test_held_out_is_crc32(spark):
    ids = spark.range(50).select(F.col("id"), quality.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in ids)


# --- personal data ---


def brute_pii(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        double = "".join(str(int(c) * 2) if i % 2 else c for i, c in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and sum(map(int, double)) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.BASE.index(s[0])))


@settings(max_examples=600, deadline=None)
@given(st.one_of(*[st.text(a, max_size=60) for a in ("12. -", "+1 ().-2a", "a@b.c+1-", "0123456789 -", "0123456789.@+ -()a:/é")]))
def test_pii_base_spans(text):
    assert [s for s in pii.find(text) if s[0] in pii.BASE] == brute_pii(text)


def test_pii_rows(spark):
    found = pii.personal_data(table(spark)).collect()
    same([(r.doc_id, [(s.kind, s.start, s.end) for s in r.spans]) for r in found], [(r[0], pii.find(r[1] or "")) for r in ROWS])
    kinds = {s[0] for r in ROWS for s in pii.find(r[1] or "")}
    assert {"email", "ip", "card", "phone", "url", "iban"} <= kinds
    docs = table(spark)
    out = pii.redact(docs)
    assert out.schema == docs.schema and out.where("text like '%<card>%'").count() == 1 and out.where("text is null").count() == 1
    assert pii.personal_data(table(spark, [])).count() == 0


# --- repeated bytes and words ---


def brute_bytes(rows, depth):
    seen, out = set(), []
    for _, same_id in groupby(ordered(rows), key=lambda r: r[0]):
        own = set()
        for r in same_id:
            b = (r[1] or "").encode()
            gone = bytearray(len(b))
            for p in range(len(b) - depth + 1):
                w = b[p : p + depth]
                if w in seen:
                    gone[p : p + depth] = b"\1" * depth
                own.add(w)
            runs = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
            out.append((r[0], len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
        seen |= own
    return out


def brute_words(rows, window):
    seen, out = set(), []
    for r in ordered(rows):
        w = words(r[1])
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if key in seen:
                gone[p : p + window] = [True] * window
            seen.add(key)
        out.append((r[0], len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()))
    return out


@pytest.mark.parametrize("group_bytes", [1 << 23, 1 << 9])
def test_repeated_bytes(spark, group_bytes):
    found = suffix_dedup.remove_repeated_bytes(table(spark), group_bytes=group_bytes, bucket_bytes=1 << 16).collect()
    got = [(r.doc_id, r.n_bytes, r.n_removed, [(s.start, s.end) for s in r.removed], bytes(r.kept)) for r in found]
    same(got, brute_bytes(ROWS, 50))


@pytest.mark.parametrize("group_bytes", [1 << 23, 1 << 9])
def test_repeated_words(spark, group_bytes):
    found = substring_dedup.remove_repeated_words(table(spark), group_bytes=group_bytes, bucket_bytes=1 << 16).collect()
    same([(r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in found], brute_words(ROWS, 20))


def test_repeats_by_chance(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), " ".join("ab"[x] * int(1 + y) for x, y in zip(rng.integers(0, 2, 90), rng.integers(0, 2, 90), strict=True)), "en", "s", 1) for i in range(60)]
    rows += [(100 + i, rows[i][1][20:150] + rows[i + 1][1][10:120], "en", "s", 1) for i in range(40)]
    found = suffix_dedup.remove_repeated_bytes(table(spark, rows), depth=12, digit=4, group_bytes=2000, bucket_bytes=1000).collect()
    same([(r.doc_id, r.n_bytes, r.n_removed, [(s.start, s.end) for s in r.removed], bytes(r.kept)) for r in found], brute_bytes(rows, 12))
    found = substring_dedup.remove_repeated_words(table(spark, rows), window=6, gram=3, group_bytes=2000, bucket_bytes=1000).collect()
    same([(r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in found], brute_words(rows, 6))


def test_repeats_of_nothing(spark):
    assert suffix_dedup.remove_repeated_bytes(table(spark, [])).count() == 0
    assert substring_dedup.remove_repeated_words(table(spark, [])).count() == 0


# --- mixing ---


def test_targets_are_levelled(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 5), ("d", 300), (None, 700), ("z", 0)], "source string, size long")
    found = {r.source: r for r in mixing.source_targets(sizes).collect()}
    order = ["a", "b", "c", "d", "z", None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full, open_, left = {}, set(order), 2015.0
    while True:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > 3 * found[s].source_size}
        if not above:
            break
        for s in above:
            full[s] = 3.0 * found[s].source_size
            left -= full[s]
        open_ -= above
    for s in order:
        assert found[s].target == pytest.approx(full.get(s, level * weight[s]))


def test_mixing_rows(spark):
    a = mixing.copies(table(spark)).collect()
    assert len(a) == len(ROWS)
    same([(r.doc_id, r.size) for r in a], [(r[0], len(words(r[1]))) for r in ROWS])
    assert all(0 <= r.copies <= 3 for r in a)
    same(a, mixing.copies(table(spark)).collect())
    assert mixing.copies(table(spark, [])).count() == 0
    blank = mixing.copies(table(spark, [(1, None, "x", "s", 1), (2, "", "x", None, 1)])).collect()
    assert [r.copies for r in blank] == [0, 0]


def test_mixing_keeps_to_targets(spark):
    rows = [(i, "w " * (1 + i * 37 % 50), "en", "hot" if i % 3 else f"s{i % 7}", 1) for i in range(3000)]
    found = mixing.copies(table(spark, rows)).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 50 for r in found)


def test_pivotal_rounding_is_fair(spark):
    rows = spark.range(1200).select(F.struct(F.lit("s").alias("source"), F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("row")).alias("id"), (F.col("id") % 9 + 1).cast("double").alias("s"), F.lit(0.3).alias("p"))
    found = mixing.pivotal_rounding(rows).toPandas()
    assert len(found) == 1200 and set(found.p) == {0.0, 1.0}
    assert abs((found.p * found.s).sum() - 0.3 * found.s.sum()) <= 5
    assert abs(found.p.mean() - 0.3) < 0.05


# --- SimHash ---


def brute_fingerprint(text, width):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute_components(ids, fps, radius):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [least[find(i)] for i in range(len(ids))]


def test_simhash_rows(spark):
    found = simhash.near_duplicates(table(spark)).collect()
    ids, fps = [r[0] for r in ROWS], [brute_fingerprint(r[1], 3) for r in ROWS]
    same([(r.doc_id, r.fp % (1 << 64), r.component_id) for r in found], list(zip(ids, fps, brute_components(ids, fps, 2), strict=True)))
    assert simhash.near_duplicates(table(spark, [])).count() == 0


@pytest.mark.parametrize(("radius", "blocks", "tile"), [(2, 4, 4096), (3, 5, 40), (7, 9, 30)])
def test_links_connect_what_is_close(spark, radius, blocks, tile):
    rng = np.random.default_rng(radius)
    values = [int(x) for x in rng.integers(0, 1 << 63, 150)]
    for _ in range(150):  # chains and a dense group
        v = values[int(rng.integers(0, 40))]
        for b in rng.choice(64, int(rng.integers(1, radius + 2)), replace=False):
            v ^= 1 << int(b)
        values.append(v)
    values = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    nodes = spark.createDataFrame([(v, v, 0) for v in values], "node long, fp long, other long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(nodes, radius, blocks, tile=tile)).collect()}
    got = [roots.get(v, v) for v in values]
    assert got == brute_components(values, [v % (1 << 64) for v in values], radius)


def test_bit_sliced_counts():
    rng = np.random.default_rng(3)
    v = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    v[100:] = v[0] ^ (np.uint64(1) << rng.integers(0, 63, 200).astype(np.uint64))
    i, j = np.triu_indices(300, 1)
    for radius in (0, 1, 2, 3, 6, 10):
        want = np.bitwise_count(v[:, None] ^ v[None, :]) <= radius
        assert (simhash.close_to(v, v, radius) == want).all()
        assert (simhash.close_pairs(v[i], v[j], radius) == want[i, j]).all()


# --- BPE ---


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("ab'sreld  \n\t1½é日\u00a0\u2003.!-"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=4))
def test_array_splitting_is_the_pattern(texts):
    import regex

    assert P.PATTERN == pieces.ARRAY_PATTERN
    joined = "".join(texts)
    ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
    starts = pieces.split_bounds(np.frombuffer(joined.encode("utf-32-le"), np.uint32), ends)
    got = [joined[a:b] for a, b in zip(starts, [*starts[1:], len(joined)], strict=False)]
    assert got == [p for t in texts for p in regex.findall(P.PATTERN, t)]


def test_bpe_is_the_library(spark):
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = bpe.read_ranks(f)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = bpe.decode(bpe.encode(table(spark), RANKS, P.PATTERN), RANKS).collect()
    want = [(r[0], library.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in ROWS]
    same([(r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in found], want)
    assert all(r.n_tokens * 4 == len(r.ids) for r in found)
    assert bpe.encode(table(spark, []), RANKS, P.PATTERN).count() == 0
    replay = bpe.MergeReplay(ranks)
    counts, flat = replay([b"aaaaaaaaa", b"hello", b"\xff\xfe\x00", b"the the"])
    assert counts.sum() == len(flat)


def test_frequent_pieces_are_bounded(spark):
    counts = [1] * 50 + [2] * 20 + [7, 9, 100, 100, 5000]
    pieces = spark.createDataFrame([(f"p{i}", n) for i, n in enumerate(counts)], "piece string, n long")
    for most in (0, 1, 3, 5, 24, 25, 74, 75, 1000):
        found = sorted((r.n for r in bpe.most_frequent(pieces, most).collect()), reverse=True)
        assert len(found) <= most and found == sorted(counts, reverse=True)[: len(found)]
        assert most not in (5, 25, 75) or len(found) == most
    assert bpe.most_frequent(pieces.where("false"), 9).count() == 0


# --- top-k ---


def test_top_k_is_brute_force(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 8)).round(2)
    v[50:60] = v[50]  # ties
    rows = [(int(i), [float(x) for x in r]) for i, r in enumerate(v)]
    rows += [(400, None), (401, [float("nan")] * 8), (402, [None] * 8), (403, [float("inf")] * 8), (None, [0.1] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = np.floor(64 * v).astype(int)
    found = topk.top_k(topk.whole_vectors(vectors), F.col("vec_id") % 20 == 0, k=7, block=64, queries_block=4).collect()
    want = []
    for q in range(0, 300, 20):
        s = whole @ whole[q]
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:7]
        want += [(q, n + 1, i, int(s[i])) for n, i in enumerate(best)]
    same([(r.query_id, r["rank"], r.vec_id, r.score) for r in found], want)
    few = topk.top_k(topk.whole_vectors(vectors.where("vec_id in (0, 3)")), F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in few] == [(0, 1, 3)]
    assert topk.top_k(topk.whole_vectors(vectors.where("false")), F.col("vec_id") % 20 == 0).count() == 0


# --- exact dedup ---


def test_exact_duplicates(spark):
    found = exact_dedup.exact_duplicates(table(spark)).collect()
    groups = {}
    for r in ROWS:
        groups.setdefault(squeezed(r[1]), []).append(r)
    want = []
    for body, rows in groups.items():
        keep = min(rows, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        want += [(r[0], keep, len(rows), r[0] == keep, sha(body)) for r in rows]
    same([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found], want)
    assert exact_dedup.exact_duplicates(table(spark, [])).count() == 0


def test_colliding_chunks_are_told_apart(spark, monkeypatch):
    found = exact_dedup.recipes(table(spark))
    assert exact_dedup.colliding(found).count() == 0
    # recipes of one identifier for all chunks: only the proofs can tell them apart
    size = F.size("proofs")
    weak = found.withColumn("recipe", F.expr("cast(repeat('abcdefghijkl', size(proofs)) as binary)")).where(size > 0)
    clashes = exact_dedup.colliding(weak)
    assert clashes.count() == 1
    per = exact_dedup.verified(weak, clashes).groupBy("recipe").agg(F.count_distinct("text_sha256").alias("n")).collect()
    assert all(r.n == 1 for r in per) and len(per) == weak.select("text_sha256").distinct().count()


# --- token store ---


def test_token_store(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    path = shared_folder(spark, "test-tokens")
    token_store.write(table(spark), P.path("byte_bpe_50k.json"), P.PATTERN, path, part_bytes=100_000, segment_tokens=500)
    found = token_store.read(spark, path).collect()
    want, start = [], 0
    for r in ordered(ROWS):
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [0]
        want.append((r[0], start, len(ids), ids))
        start += len(ids)
    same([(r.doc_id, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in found], want)
    empty = shared_folder(spark, "test-empty")
    token_store.write(table(spark, []), P.path("byte_bpe_50k.json"), P.PATTERN, empty)
    assert token_store.read(spark, empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500))
def test_codes_are_addressable(ids):
    values = np.array(ids, np.uint32)
    codes = token_store.Codes(token_store.pack(values))
    assert codes.between(0, len(ids)).tolist() == ids
    for i in range(0, len(ids), 97):
        assert codes[i] == ids[i]
        assert codes.between(i, min(len(ids), i + 5)).tolist() == ids[i : i + 5]
