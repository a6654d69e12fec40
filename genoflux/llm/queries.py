"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, line_dedup, middle, mixing, pii, quality, simhash, spelling, substring_dedup, suffix_dedup, token_store, topk
from .common import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def splitting_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    found = quality.score(docs, model)
    return found.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(_table(spark, sf_dir, "documents"))
    counts = [F.size(F.expr(f"filter(spans, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in pii.BASE]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeated_bytes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.copies(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    found = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), path, splitting_pattern()), path)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.whole_vectors(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeated_words(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "tokens")
    token_store.write(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), splitting_pattern(), path)
    return token_store.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    text = middle.restored(F.col("form"), F.col("output"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.remove_repeated_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_pii": op2_pii,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_mixing": op4_mixing,
    "op5_simhash": op5_simhash,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_top_k": op7_top_k,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_token_store": op10_token_store,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_line_dedup": op12_line_dedup,
    "op13_spelling": op13_spelling,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op3_suffix_dedup": """
        with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
        b as (select doc_id, p, substr(h, 2 * p + 1, 2) as byte, case when 2 * p + 100 <= length(h) then substr(h, 2 * p + 1, 100) end as w
          from d, unnest(range(length(h) // 2)) as u(p)),
        f as (select w, min(doc_id) as first_doc from b where w is not null group by w having count(*) > 1),
        r as (select b.doc_id, b.p, b.byte, coalesce(f.first_doc < b.doc_id, false) as starts from b left join f on f.w = b.w),
        c as (select doc_id, p, byte, max(starts) over (partition by doc_id order by p rows between 49 preceding and current row) as gone from r),
        e as (select doc_id, p, byte, gone, gone and not coalesce(lag(gone) over (partition by doc_id order by p), false) as head from c),
        g as (select doc_id, count(*) filter (where gone) as n_removed, count(*) filter (where head) as n_spans,
            coalesce(string_agg(byte, '' order by p) filter (where not gone), '') as kept from e group by doc_id)
        select d.doc_id, length(d.h) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256
        from d left join g on g.doc_id = d.doc_id""",
    "op9_substring_dedup": r"""
        with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
        b as (select doc_id, p, words[p] as word, case when p + 19 <= len(words) then array_to_string(words[p:p + 19], ' ') end as w
          from d, unnest(range(1, len(words) + 1)) as u(p)),
        f as (select *, w is not null and row_number() over (partition by w order by doc_id, p) > 1 as starts from b),
        c as (select doc_id, p, word, max(starts) over (partition by doc_id order by p rows between 19 preceding and current row) as gone from f),
        g as (select doc_id, count(*) filter (where gone) as n_removed, coalesce(string_agg(word, ' ' order by p) filter (where not gone), '') as kept from c group by doc_id)
        select d.doc_id, cast(len(words) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
        from d left join g on g.doc_id = d.doc_id""",
    "op7_top_k": """
        with w as (
          select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v
          from embeddings
          where embedding is not null and vec_id is not null
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (
          select q.vec_id as query_id, c.vec_id, cast(list_inner_product(cast(q.v as double[]), cast(c.v as double[])) as bigint) as score
          from w q, w c where q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
        r as (
          select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
          from s)
        select query_id, rank, vec_id, score from r where rank <= 20""",
    "op8_exact_dedup": r"""
        with t as (
          select doc_id, length(coalesce(text, '')) as n,
                 regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as body
          from documents),
        g as (
          select body, count(*) as group_size, first(doc_id order by n desc, doc_id) as keep_id
          from t group by body)
        select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.body) as text_sha256
        from t join g using (body)""",
    "op11_fill_in_middle": r"""
        with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
        e as (select *, cast(len(u) as bigint) as n, cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2,
            cast('0x' || substr(h, 25, 8) as bigint) as h4 from d),
        f as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
            case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from e),
        g as (select *, array_to_string(u[1:a], '') as prefix, array_to_string(u[a + 1:b], '') as middle, array_to_string(u[b + 1:n], '') as suffix from f)
        select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
          sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
          sha256(t) as restored_sha256 from g""",
    "op12_line_dedup": r"""
        with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as u from documents),
        l as (select doc_id, p, u[p] as line, translate(regexp_replace(regexp_replace(u[p], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
          from d, unnest(range(1, len(u) + 1)) as x(p)),
        r as (select k, max(doc_id) as top from l where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
        m as (select l.doc_id, p, line, coalesce(l.doc_id <> r.top, false) as gone from l left join r on l.k = r.k)
        select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by p) filter (where not gone), '')) as kept_sha256
        from m group by doc_id""",
    # crc32 by half bytes; near words meet in a pattern with one letter starred, or in the longer word without one
    "op13_spelling": r"""
        with recursive r as (
          select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) as run from documents),
        q as (select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n from r group by all),
        b as (select run, n, list_transform(string_split(regexp_replace(hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || run)), '(..)', '\1 ', 'g')[:-2], ' '), lambda x: cast('0x' || x as bigint)) as bytes from q),
        z as (select [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
                      3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108] as t),
        c as (select run, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(xor(xor(c, x) >> 4, t[(xor(c, x) & 15) + 1]) >> 4, t[(xor(xor(c, x) >> 4, t[(xor(c, x) & 15) + 1]) & 15) + 1])), 4294967295) as h from b, z),
        s as (select case when h % 199 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from c),
        w as (select word, cast(sum(n) as bigint) as n from s where length(word) >= 6 group by word having sum(n) >= 5),
        p as (select word, n, substr(word, 1, i) || '*' || substr(word, i + 2) as k, substr(word, 1, i) || substr(word, i + 2) as d from w, unnest(range(length(word))) as x(i)),
        e as (select a.word, b.word as other, b.n as other_n from p a join p b on a.k = b.k and a.word <> b.word
              union select w.word, p.word, p.n from w join p on w.word = p.d union select p.word, w.word, w.n from w join p on w.word = p.d),
        f as (select word, count(*) as n_near, first(other order by other_n desc, other) as other, max(other_n) as other_n from e group by word),
        g as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when other_n >= 5 * w.n then other end as form, case when other_n >= 5 * w.n then other_n end as form_n from w left join f on f.word = w.word),
        o as (select word, word as root, form as ahead from g union all select o.word, g.word, g.form from o join g on g.word = o.ahead)
        select g.word, form, root, n, n_near, form_n from g join (select word, root from o where ahead is null) as x on x.word = g.word""",
}
