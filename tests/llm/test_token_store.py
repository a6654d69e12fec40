"""Added tokens of the vocabulary in the texts, against the library."""

import numpy as np
import public_tokenizers as P
from tokenizers import AddedToken, Tokenizer

from genoflux.llm import token_store
from genoflux.llm.common import shared_folder

END = "<|endoftext|>"
TEXTS = ["end of doc.<|endoftext|>Next doc", END, END + END, f"a  {END}  b\n{END}", "<|endoftext|", "none at all", "", f" {END} don't{END}'s x", None]


def check(spark, library, path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2)
    out = shared_folder(spark, "test-added")
    token_store.write(docs, path, P.PATTERN, out, segment_tokens=7)
    got = {r.doc_id: (r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in token_store.read(spark, out).collect()}
    start = 0
    for i, text in enumerate(TEXTS):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        assert got[i] == (start, ids), text
        start += len(ids)


def test_added_tokens_keep_their_ids(spark):
    path = P.path("byte_bpe_50k.json")
    check(spark, Tokenizer.from_file(path), path)


def test_the_longest_added_token(spark, tmp_path):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.add_tokens([AddedToken("doc", normalized=True), AddedToken("doc.<", normalized=True), AddedToken("t all", normalized=False)])
    path = str(tmp_path / "own.json")
    library.save(path)
    check(spark, library, path)


def test_tokens_by_position(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{rng.integers(3000)}" for _ in range(int(rng.integers(0, 60))))) for i in range(120)]
    docs, out = spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/store"
    token_store.write(docs, P.path("byte_bpe_50k.json"), P.PATTERN, out, part_bytes=4000, segment_tokens=200)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    flat = [x for _, text in rows for x in [*library.encode(text, add_special_tokens=False).ids, 0]]
    asked = sorted({int(x) for x in rng.integers(0, len(flat), 300)} | {0, len(flat) - 1})
    table = spark.createDataFrame([(x,) for x in [*asked, asked[0], len(flat), -1, None]], "position long")
    for most in (1000, 2):
        got = {r.position: r.id for r in token_store.token_at(spark, out, table, run=1 << 12, most_parts=most).collect()}
        assert got == {**{x: flat[x] for x in asked}, len(flat): None, -1: None, None: None}
