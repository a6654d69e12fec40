"""The stages against brute-force versions on the smallest documents."""

from collections import Counter

import public_tokenizers as P
import pytest

import corpus_pipeline
from genoflux.llm import queries

from .cases import squeezed, table


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, small).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_columns(stages):
    for name in ("quality", "exact_dedup", "near_dedup", "mixing"):
        assert stages[name].columns == stages["documents"].columns


def test_quality_keeps_the_good(stages, spark, small):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    kept = ids(stages["quality"])
    good = [d for d in ids(stages["documents"]) if labels.get(d) == 1]
    assert sum(d in kept for d in good) > 0.95 * len(good)


def test_one_of_equal_texts(stages):
    before = {r.doc_id: squeezed(r.text) for r in stages["quality"].collect()}
    after = {r.doc_id: squeezed(r.text) for r in stages["exact_dedup"].collect()}
    assert sorted(after.values()) == sorted(set(before.values()))


def test_near_copies_leave_one(stages):
    before, after = ids(stages["exact_dedup"]), ids(stages["near_dedup"])
    assert set(after) <= set(before) and len(after) > 0.9 * len(before)


def test_mix_and_tokens(stages):
    import tiktoken

    from genoflux.llm.bpe import read_ranks

    mixed = stages["mixing"].collect()
    assert max(Counter(r.doc_id for r in mixed).values()) <= 3
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(f), special_tokens={})
    want = Counter((r.doc_id, len(library.encode_ordinary(r.text or ""))) for r in mixed)
    assert Counter((r.doc_id, r.n_tokens) for r in stages["bpe"].collect()) == want


def test_awkward_rows_pass(spark, small):
    docs = table(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        docs.collect()


def with_ids_missing(spark):
    """60 documents of ten words, a third without an id, some repeated; a column named like an inner one."""
    rows = [(None if i % 3 == 0 else i // 2, " ".join(f"w{i}x{k}" for k in range(10)), "a" if i % 6 < 3 else "b", f"own {i}") for i in range(60)]
    return spark.createDataFrame(rows + rows[:4], "doc_id long, text string, source string, _row string").repartition(3)


def test_rows_without_ids_keep_to_their_targets(spark, small):
    docs = with_ids_missing(spark)
    found = corpus_pipeline.mixed(spark, docs, small)
    assert found.columns == docs.columns
    rows = found.collect()
    taken = Counter(r.source for r in rows)
    size = Counter(r.source for r in docs.collect())
    want = {r.source: r.target for r in corpus_pipeline.mixing.source_targets(docs.selectExpr("source", "10L as size")).collect()}
    assert all(abs(10 * taken[s] - want[s]) <= 10 for s in size), (taken, want)
    per, have = Counter(r._row for r in rows), Counter(r._row for r in docs.collect())
    assert set(per) <= set(have) and all(n <= 3 * have[k] for k, n in per.items())


def test_one_row_of_equal_texts_whatever_the_ids(spark, small):
    docs = with_ids_missing(spark)
    found = corpus_pipeline.distinct(spark, docs, small).collect()
    assert len(found) == 60 and len({r.text for r in found}) == 60
    assert all(r._row == f"own {int(r.text.split('x')[0][1:])}" for r in found)
    near = corpus_pipeline.unlike(spark, docs, small).collect()
    assert len(near) == 60 and {r._row for r in near} == {f"own {i}" for i in range(60)}


def test_long_pieces_are_not_broadcast(spark):
    """A text of five million letters is one piece; it is encoded where it stands."""
    from genoflux.llm import bpe

    path = P.path("byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame([(1, "ab" * 2_500_000), (2, "ab ab"), (3, "x" * 129)], "doc_id long, text string")
    assert bpe.distinct_pieces(docs, P.PATTERN, longest=128).agg({"n": "sum"}).first()[0] == 2
    found = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, path, P.PATTERN), path).collect()}
    assert bytes(found[1].decoded) == b"ab" * 2_500_000 and bytes(found[3].decoded) == b"x" * 129


def test_registered(spark, small):
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert {f"op{n}" for n in range(1, 14)} <= {k.split("_")[0] for k in queries.QUERIES}
    assert queries.QUERIES["pipeline"](spark, small).count() > 0
