"""The near-dedup stage against brute force over five-word shingles."""

import numpy as np

from pyspark.sql import functions as F

import corpus_pipeline
from genoflux.llm import near
from genoflux.llm.common import cut
from genoflux.llm.components import components

from .cases import words


def brute(rows, width=5):
    """Row positions that stay, by similarity of all pairs."""
    sets = []
    for _, text in rows:
        w = words(text.lower())
        sets.append({" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    best = {}
    for i, (name, _) in enumerate(rows):
        key = (name is None, name or 0, i)
        best[find(i)] = min(best.get(find(i), key), key)
    return sorted(k[2] for k in best.values())


def variants(rng, base, count, changes):
    out = []
    for _ in range(count):
        own = list(base)
        for at in rng.choice(len(own), int(rng.integers(changes[0], changes[1])), replace=False):
            own[at] = f"new{rng.integers(1 << 40)}"
        out.append(" ".join(own))
    return out


def corpus():
    rng, texts = np.random.default_rng(5), []
    for g in range(60):  # pairs around 0.8: three of 150 changed words give about 0.81
        base = [f"w{g}x{rng.integers(5000)}" for _ in range(150)]
        texts += [" ".join(base), *variants(rng, base, 2, (1, 7))]
    return [(i + 1, t) for i, t in enumerate(texts)]


def test_stage_is_brute_force(spark, small):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id for r in corpus_pipeline.unlike(spark, docs, small).collect()}
    want = {rows[i][0] for i in brute(rows)}
    assert not want - got  # nothing is linked below the similarity
    assert len(got - want) <= 1, got - want


def test_dense_buckets_are_brute_force(spark, small):
    rng, texts = np.random.default_rng(6), []
    base = [f"w{rng.integers(5000)}" for _ in range(120)]
    texts += variants(rng, base, 250, (0, 4))
    rows = [(i + 1, t) for i, t in enumerate(texts)] + [(None, ""), (900, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id for r in corpus_pipeline.unlike(spark, docs, small).collect()}
    assert got == {rows[i][0] for i in brute(rows)}


def test_tiles_connect_the_same(spark):
    rows = [(i, i, t) for i, t in corpus()]
    table = spark.createDataFrame(rows, "row long, doc_id long, text string")
    nodes = cut(near.sketches(table, 5))

    def groups(edges):
        return {(r.node, r.root) for r in components(edges).collect()}

    found = [groups(near.proposals(nodes, (4, 5), tile=t)) for t in (4096, 3)]
    assert found[0] and found[0] == found[1]
    members = cut(nodes.join(table.select("row", "text"), "row").withColumn("cluster", F.lit(1).cast("long")))
    found = [groups(near.decided(members, 5, (4, 5), tile=t)) for t in (1024, 20)]
    assert found[0] and found[0] == found[1]


def test_bit_slices_count_rows_of_words():
    from genoflux.llm.simhash import close_pairs, close_to

    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, (200, near.WORDS), dtype=np.uint64)
    other = base.copy()
    for i in range(200):
        for at in rng.choice(256, int(rng.integers(0, 140)), replace=False).tolist():
            other[i, at // 64] ^= np.uint64(1) << np.uint64(at % 64)
    assert not len(close_pairs(base[:0], other[:0], near.RADIUS)) and close_to(base[:0], other, 3).shape == (0, 200)
    far = np.bitwise_count(base ^ other).sum(1)
    assert (close_pairs(base, other, near.RADIUS) == (far <= near.RADIUS)).all() and 20 < (far <= near.RADIUS).sum() < 180
    whole = np.bitwise_count(base[:70, None] ^ other[None]).sum(2)
    assert (close_to(base[:70], other, near.RADIUS) == (whole <= near.RADIUS)).all()


def test_keys_grow_with_the_rows():
    assert near.tables_for(0)[1] == near.LEAST_BITS
    for rows in (10**5, 10**7, 10**9):
        tables, bits = near.tables_for(rows)
        assert rows / 2**bits <= near.PER_BUCKET and tables < 6 * rows**0.25


def test_share_of_pairs_that_meet_in_no_table():
    """Pairs of sets of 180 shingles at exactly 0.8, at the tables of small and large corpora."""
    rng, shared, own = np.random.default_rng(6), 160, 20
    bits = []
    for _ in range(1000):
        h = rng.integers(0, 1 << 63, shared + 2 * own, dtype=np.uint64)
        for part in (h[: shared + own], np.concatenate([h[:shared], h[shared + own :]])):
            counts = [np.unpackbits(near._mixed(part + s).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for s in near._STEPS]
            bits.append(np.packbits(np.array(counts) * 2 > len(part), axis=1, bitorder="little").view(np.uint64).ravel())
    words = np.array(bits)
    for rows, most in ((10**5, 0.01), (10**7, 0.03), (10**9, 0.05)):
        found = near.bucket_numbers(words, *near.tables_for(rows))
        missed = 1 - (found[::2] == found[1::2]).any(1).mean()
        assert missed < most
