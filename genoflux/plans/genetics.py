"""Registered queries of the statistical operators, each with the same result in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alleles
from ..operators import crosses, joins, kernel_test, kinship, lm, mixed, prediction, scratch, simulate, stats, variants
from ..sources import genotypes
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None):
    """Enters a query, and its SQL behind the derived tables."""

    def enter(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE_SQL[key] = f"with {fx.SQL.strip()}, {sql.strip()}" if re.match(r"\w+ as \(", sql.lstrip()) else f"with {fx.SQL.strip()} {sql.strip()}"
        return f

    return enter


def r(c, digits: int = 6):
    """Rounded, without a negative zero.  Where exact ties are common (slopes of small
    tables) queries add 1e-8 first, in both engines, so that the last bit can't decide."""
    return F.round(c, digits) + F.lit(0.0)


def near(c, digits: int):
    """``r`` of values that are exact decimals but for the last bits: these go first, so a tie rounds up."""
    return r(F.round(c, 9), digits)


def _t_p(t2: str, n: str) -> str:
    """SQL of P(|T| > t) with n - 2 degrees of freedom, a whole number: the finite series
    in cos of atan(t / sqrt(df)), one for even and one for odd degrees."""
    df, c2 = f"({n} - 2)", f"({n} - 2) / ({n} - 2 + {t2})"
    even = f"coalesce(list_sum(list_transform(range(0, {df} // 2), lambda k: exp(lgamma(k + 0.5::double) - lgamma(k + 1.0::double)) / sqrt(pi()) * pow({c2}, k))), 0)"
    odd = f"coalesce(list_sum(list_transform(range(0, ({df} - 1) // 2), lambda k: exp(lgamma(k + 1.0::double) - lgamma(k + 1.5::double)) * sqrt(pi()) / 2 * pow({c2}, k))), 0)"
    s = f"sqrt({t2} / ({df} + {t2}))"
    return f"(case when {df} % 2 = 0 then 1 - {s} * {even} else 1 - 2 / pi() * (atan(sqrt({t2} / {df})) + {s} * sqrt({c2}) * {odd}) end)"


def _chi1_p(h: str) -> str:
    """SQL of P(chi-square of one degree > 2 h): that of the normal distribution, by the series of erf."""
    return f"(case when {h} > 16 then 0 else 1 - exp(-({h})) * list_sum(list_transform(range(0, 120), lambda k: pow({h}, k + 0.5::double) / exp(lgamma(k + 1.5::double)))) end)"


# --- scans, filters, allele statistics ---


@register("select chr, pos, sample_id, dosage from calls where chr = 2 and pos between 100000 and 900000")
def region_scan(spark, sf_dir):
    return variants.in_region(fx.calls(spark, sf_dir), 2, 100_000, 900_000).select("chr", "pos", "sample_id", "dosage")


@register("select chr, pos, sample_id, dosage from calls where chr = 3 and pos = 7599")
def point_lookup(spark, sf_dir):
    return variants.at_site(fx.calls(spark, sf_dir), 3, 7599).select("chr", "pos", "sample_id", "dosage")


@register("""select chr, pos, least(count(*) filter (where floor(dosage + cast(0.1 as double)) = 0), count(*) filter (where floor(dosage + cast(0.1 as double)) in (1, 2))) as mafc
from calls group by chr, pos""")
def allele_count_import(spark, sf_dir):
    return variants.import_minor_counts(fx.calls(spark, sf_dir))


@register("""q as (select chr, pos, count(*) filter (where dosage = 0) as a, count(*) filter (where dosage = 1) as b, count(*) filter (where dosage = 2) as c from calls group by chr, pos)
select chr, pos, cast(case when a > 0 and b > 0 and c > 0 then least(2 * a + b, 2 * c + b)
   when a > 0 and b > 0 then case when a <= b then 2 * a else b end
   when a > 0 and c > 0 then 2 * least(a, c)
   when b > 0 and c > 0 then case when b <= c then b else 2 * c end else -1 end as bigint) as mafc,
 cast(case when a > 0 and b > 0 and c > 0 then case when 2 * a + b <= 2 * c + b then 0 else 2 end
   when a > 0 and b > 0 then case when a <= b then 0 else 1 end
   when a > 0 and c > 0 then case when a <= c then 0 else 2 end
   when b > 0 and c > 0 then case when b <= c then 1 else 2 end end as integer) as minor from q""")
def mafc_test_time(spark, sf_dir):
    return variants.test_minor_counts(fx.calls(spark, sf_dir))


@register("""q as (select chr, pos, count(dosage) as n, sum(dosage) / (2.0::double * count(dosage)) as f from calls group by chr, pos having count(dosage) > 0)
select chr, pos, n, round(case when f >= 0.5 then 1 - f else f end, 6) + 0.0 as maf from q where case when f >= 0.5 then 1 - f else f end >= 0.2""")
def maf_folded_filter(spark, sf_dir):
    return variants.frequencies(fx.calls(spark, sf_dir)).where("maf >= 0.2").select("chr", "pos", "n", r("maf").alias("maf"))


@register("""q as (select chr, pos, sum(dosage) / (2.0::double * count(dosage)) as f from calls group by chr, pos having count(dosage) > 0)
select chr, pos, f > 0.3 as above, f < 0.3 as below from q""")
def freq_above_below(spark, sf_dir):
    return variants.frequencies(fx.calls(spark, sf_dir)).select("chr", "pos", (F.col("freq") > 0.3).alias("above"), (F.col("freq") < 0.3).alias("below"))


@register("""q as (select chr, pos, least(count(*) filter (where dosage = 0), count(*) filter (where dosage in (1, 2))) as mafc, count(dosage) as n from calls group by chr, pos)
select chr, pos, mafc from q where n > 0 and mafc / (2.0::double * n) between 0.05 and 0.15""")
def maf_range(spark, sf_dir):
    calls = fx.calls(spark, sf_dir)
    rows = variants.import_minor_counts(calls, known="n")
    return rows.where((F.col("n") > 0) & (F.col("mafc") / (2.0 * F.col("n"))).between(0.05, 0.15)).select("chr", "pos", "mafc")


@register("select chr, pos from calls group by chr, pos having min(dosage) < max(dosage)")
def monomorphic_filter(spark, sf_dir):
    return variants.polymorphic(fx.calls(spark, sf_dir))


@register("""select label + 1 as chr, vec_id * 1000 + 1 as pos,
 list_sum(list_transform(embedding, lambda x: cast(floor(abs(cast(x as double)) * 16) as bigint) % 3)) / (2.0::double * len(embedding)) as freq from embeddings""")
def array_frequency(spark, sf_dir):
    return fx.variants(spark, sf_dir).select("chr", "pos", alleles.frequency(F.col("g")).alias("freq"))


@register("""q as (select chr, max(pos) as last from calls group by chr)
select chr, s as "start", s + 49999 as "end" from q, unnest(generate_series(cast(1 as bigint), last - 1, 25000)) as u(s)""")
def window_tiling(spark, sf_dir):
    return variants.tiling_windows(fx.calls(spark, sf_dir), 50_000)


@register("""q as (select chr, max(pos) as last from calls group by chr),
w as (select chr, s from q, unnest(generate_series(cast(1 as bigint), last - 1, 25000)) as u(s)),
p as (select distinct chr, pos from calls)
select w.chr, w.s as "start", count(*) as n from w join p on p.chr = w.chr and p.pos between w.s and w.s + 49999 group by w.chr, w.s""")
def window_counts(spark, sf_dir):
    sites = fx.calls(spark, sf_dir).select("chr", "pos").distinct()
    return variants.in_tiling_windows(sites, 50_000).groupBy("chr", "start").agg(F.count("*").alias("n"))


def _letters(spark, sf_dir):
    rows = fx.calls(spark, sf_dir)
    base = F.when(F.col("dosage") == 0, F.struct(F.lit("A").alias("a"), F.lit("A").alias("b"))).when(F.col("dosage") == 1, F.struct(F.lit("G").alias("a"), F.lit("A").alias("b"))).when(F.col("dosage") == 2, F.struct(F.lit("G").alias("a"), F.lit("G").alias("b")))
    return variants.to_letters(rows.select("chr", "pos", "sample_id", base["a"].alias("a1"), base["b"].alias("a2")))


@register("select chr, pos, sample_id, case dosage when 0 then 'A' when 1 then 'R' when 2 then 'G' end as letter from calls")
def iupac_encode(spark, sf_dir):
    return _letters(spark, sf_dir)


@register("""q as (select chr, pos, sum(2 - dosage) as na, sum(dosage) as ng from calls where dosage is not null group by chr, pos having sum(2 - dosage) > 0 and sum(dosage) > 0)
select c.chr, c.pos, c.sample_id, case when c.dosage is null then 0.0::double when na >= ng then c.dosage else 2 - c.dosage end as dosage from calls c join q using (chr, pos)""")
def iupac_to_num(spark, sf_dir):
    return variants.letters_to_dosage(_letters(spark, sf_dir))


# --- joins and sets ---


@register("""select region_id, count(*) as n from regions r join (select distinct chr, pos from calls) p on p.chr = r.chr and p.pos between r."start" and r."end" group by region_id""")
def region_range_join(spark, sf_dir):
    sites = fx.calls(spark, sf_dir).select("chr", "pos").distinct()
    return joins.in_regions(sites, fx.regions(spark, sf_dir)).groupBy("region_id").agg(F.count("*").alias("n"))


@register("""q as (select p_size, {c} as chr, cast(p_size as bigint) * 40000 + 1 as s from (select distinct p_size, p_partkey % 5 as k5 from part) x(p_size, k5))
select cast(p_size as bigint) as compound_id, count(*) as n from q join (select distinct chr, pos from calls) p on p.chr = q.chr and p.pos between q.s and q.s + 29999 group by p_size""".format(c="cast(k5 + 1 as int)"))
def compound_union(spark, sf_dir):
    parts = fx.regions(spark, sf_dir)
    sites = fx.calls(spark, sf_dir).select("chr", "pos").distinct()
    rows = joins.in_regions(sites, parts).withColumn("compound_id", F.split("region_id", ":")[1].cast("long"))
    return rows.groupBy("compound_id").agg(F.count("*").alias("n"))


@register("""q as (select gene, chr, pos, row_number() over (order by gene) as one from models)
select p.chr, p.pos, max(m.g) as gene from (select distinct chr, pos from calls) p
join (select chr, min(pos) - 1 as s, max(pos) + 1 as e, gene as g from models group by gene, chr) m on m.chr = p.chr and p.pos between m.s and m.e group by p.chr, p.pos""")
def point_in_gene(spark, sf_dir):
    genes = fx.models(spark, sf_dir).groupBy("gene", "chr").agg((F.min("pos") - 1).alias("start"), (F.max("pos") + 1).alias("end"))
    genes = genes.select(F.concat_ws("|", "gene", F.col("chr").cast("string")).alias("gene"), F.col("gene").alias("ord"), "chr", "start", "end")
    found = joins.gene_of_points(fx.calls(spark, sf_dir), genes)
    return found.select("chr", "pos", F.substring_index("gene", "|", 1).alias("gene"))


@register("""q as (select distinct chr, pos from calls), m as (select distinct {c} as chr, cast(c_custkey * 3500 as bigint) as pos from customer)
select q.chr, q.pos, max(case when m.pos < q.pos then m.pos end) as left_pos, min(case when m.pos >= q.pos then m.pos end) as right_pos from q left join m on m.chr = q.chr group by q.chr, q.pos""".format(c="cast(c_custkey % 5 + 1 as int)"))
def flanking_marker(spark, sf_dir):
    markers = fx.table(spark, sf_dir, "customer").select(F.expr("cast(c_custkey % 5 + 1 as int)").alias("chr"), (F.col("c_custkey") * 3500).cast("long").alias("pos"))
    return joins.flanking_markers(fx.calls(spark, sf_dir), markers)


@register("""select chr, pos, count(*) as n from calls c where not exists (
  select 1 from (select {c} as chr, {p} as pos from part where p_size >= 25) x where x.chr = c.chr and x.pos = c.pos) group by chr, pos""".format(c="cast(p_partkey % 5 + 1 as int)", p="cast(1 + p_partkey * 1000 + (p_partkey * 7919) % 997 as bigint)"))
def rare_antijoin(spark, sf_dir):
    panel = fx.table(spark, sf_dir, "part").select(*fx.site("p_partkey"), F.col("p_size").alias("ac"))
    return joins.without_common(fx.calls(spark, sf_dir), panel, 25).groupBy("chr", "pos").agg(F.count("*").alias("n"))


@register("""select p.chr, p.pos, coalesce(case when m.origin = 'EN' then 'rs' || cast(m.pos as varchar) end, 'rs_' || cast(p.pos as varchar)) as rsid,
 coalesce(case when m.origin = 'EN' then 'G' end, 'A') as ref, coalesce(case when m.origin = 'EN' then 'C' end, 'T') as alt, coalesce(case when m.origin = 'EN' then m.weight end, 0.0) as weight
from (select distinct chr, pos from calls) p left join models m on m.chr = p.chr and m.pos = p.pos""")
def weight_lookup(spark, sf_dir):
    table = fx.models(spark, sf_dir).where("origin = 'EN'").select("chr", "pos", F.concat(F.lit("rs"), F.col("pos").cast("string")).alias("rsid"), F.lit("G").alias("ref"), F.lit("C").alias("alt"), "weight")
    return joins.with_defaults(fx.calls(spark, sf_dir).select("chr", "pos").distinct(), table)


@register("select p.chr, p.pos, coalesce(m.origin, 'NULL') as origin from (select distinct chr, pos from calls) p left join models m using (chr, pos)")
def snp_origin_label(spark, sf_dir):
    sites, m = fx.calls(spark, sf_dir).select("chr", "pos").distinct(), fx.models(spark, sf_dir)
    en, eqtl = m.where("origin = 'EN'").select("chr", "pos", F.lit("EN").alias("e")), m.where("origin = 'eQTL'").select("chr", "pos", F.lit("eQTL").alias("q"))
    return sites.join(en, ["chr", "pos"], "left").join(eqtl, ["chr", "pos"], "left").select("chr", "pos", F.coalesce("e", "q", F.lit("NULL")).alias("origin"))


@register("""select gene, cast(count(*) as bigint) as n_snps, round(sum(weight), 6) + 0.0 as w from models where origin = 'EN' group by gene""")
def elastic_net_parse(spark, sf_dir):
    from ..sources.models import parse_models

    token = F.concat_ws("_", F.concat(F.lit("rs"), F.col("pos").cast("string")), F.col("pos").cast("string"), F.lit("A"), F.lit("T"), F.col("weight").cast("string"))
    m = fx.models(spark, sf_dir).where("origin = 'EN'")
    lines = m.groupBy("gene").agg(F.concat_ws("\t", F.lit("1"), F.min("pos").cast("string"), F.max("pos").cast("string"), F.array_join(F.collect_list(token), "\t")).alias("rest"))
    parsed = parse_models(lines.select(F.concat_ws("\t", "gene", "rest").alias("value")))
    return parsed.groupBy("gene").agg(F.count("*").alias("n_snps"), r(F.sum("weight")).alias("w"))


@register("select sample_id, y, count(*) as n_calls from calls join pheno using (sample_id) where y is not null and dosage is not null group by sample_id, y")
def sample_match(spark, sf_dir):
    return lm.matched(fx.calls(spark, sf_dir), fx.phenotypes(spark, sf_dir)).groupBy("sample_id", "y").agg(F.count("*").alias("n_calls"))


@register("select o_custkey as id from orders union select c_custkey from customer")
def ids_union(spark, sf_dir):
    return fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).union(fx.table(spark, sf_dir, "customer").select("c_custkey")).distinct()


@register("select o_custkey as id from orders intersect select c_custkey from customer")
def ids_intersect(spark, sf_dir):
    return fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).intersect(fx.table(spark, sf_dir, "customer").select("c_custkey"))


@register("select c_custkey as id from customer except select o_custkey from orders where o_orderstatus = 'F'")
def ids_except(spark, sf_dir):
    return fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).join(fx.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")), "id", "left_anti").distinct()


@register("""select a.chr, a.pos, count(*) as n from calls a join models b on a.chr = b.chr and a.pos = b.pos where b.origin = 'EN' group by a.chr, a.pos""")
def position_merge(spark, sf_dir):
    return fx.calls(spark, sf_dir).join(fx.models(spark, sf_dir).where("origin = 'EN'").select("chr", "pos"), ["chr", "pos"]).groupBy("chr", "pos").agg(F.count("*").alias("n"))


@register("""q as (select distinct chr, pos from calls), c as (select chr, pos from models where origin = 'eQTL')
select q.chr, q.pos from q where exists (select 1 from c where c.chr = q.chr and c.pos between q.pos and q.pos + 4000)""")
def causal_hit(spark, sf_dir):
    sites = fx.calls(spark, sf_dir).select("chr", "pos").distinct()
    return simulate.causal_hits(sites, fx.models(spark, sf_dir).where("origin = 'eQTL'"), 4000)


@register("""q as (select chr, pos, min(dosage) as first_dosage from calls where sample_id = (select min(sample_id) from calls c where c.chr = calls.chr and c.pos = calls.pos) group by chr, pos)
select chr, pos, sample_id, dosage from (select *, row_number() over (partition by chr, pos order by sample_id) as k from calls) where k = 1""")
def first_per_site(spark, sf_dir):
    return joins.first_per_site(fx.calls(spark, sf_dir), "sample_id").select("chr", "pos", "sample_id", "dosage")


# --- linear models ---

_LM = """q as (select chr, pos, count(*) as n, regr_slope(y, dosage) as coef, regr_r2(y, dosage) as r2, regr_sxx(y, dosage) as sxx, regr_syy(y, dosage) as syy
  from calls join pheno using (sample_id) where y is not null and dosage is not null group by chr, pos),
s as (select chr, pos, n, coef, sqrt(syy * (1 - r2) / (n - 2)) as sd_err, 1 - (1 - r2) * (n - 1) / (n - 2) as adj_r2, r2 / (1 - r2) * (n - 2) as t2
  from q where sxx > 0 and syy > 0 and n > 2 and r2 < 1) """


def _scanned(spark, sf_dir):
    return lm.scan(lm.matched(fx.calls(spark, sf_dir), fx.phenotypes(spark, sf_dir)))


@register(_LM + "select chr, pos, n, round(coef + 1e-8, 6) + 0.0 as coef, round(sd_err, 4) + 0.0 as sd_err, round(adj_r2, 6) + 0.0 as adj_r2, round(t2, 6) + 0.0 as t2 from s")
def lm_scan(spark, sf_dir):
    return _scanned(spark, sf_dir).select("chr", "pos", "n", r(F.col("coef") + 1e-8).alias("coef"), r("sd_err", 4).alias("sd_err"), r("adj_r2").alias("adj_r2"), r("t2").alias("t2"))


@register(_LM + f""", p as (select chr, pos, n, coef, adj_r2, t2, {_t_p("t2", "n")} as pvalue from s)
select chr, pos, n, round(coef + 1e-8, 6) + 0.0 as coef, round(adj_r2, 6) + 0.0 as adj_r2, round(pvalue + 1e-8, 6) + 0.0 as pvalue from p where pvalue <= 1000.0::double / (select count(*) from p)""")
def lm_scan_bonferroni(spark, sf_dir):
    found = lm.bonferroni(lm.with_p(_scanned(spark, sf_dir)), 1000.0)
    return found.select("chr", "pos", "n", r(F.col("coef") + 1e-8).alias("coef"), r("adj_r2").alias("adj_r2"), r(F.col("pvalue") + 1e-8).alias("pvalue"))


@register(_LM + "select chr, pos, n, round(adj_r2, 6) + 0.0 as adj_r2 from s order by adj_r2 desc, chr, pos limit 1")
def best_marker(spark, sf_dir):
    return lm.best_marker(_scanned(spark, sf_dir)).select("chr", "pos", "n", r("adj_r2").alias("adj_r2"))


@register(_LM + "select chr, pos, round(t2, 6) + 0.0 as t2 from (select *, row_number() over (partition by chr order by t2 desc, pos) as k from s) where k = 1")
def best_by_chromosome(spark, sf_dir):
    return lm.best_by_chromosome(_scanned(spark, sf_dir)).select("chr", "pos", r("t2").alias("t2"))


@register(_LM + """, b as (select chr, pos from s order by adj_r2 desc, chr, pos limit 1),
h as (select c.sample_id, c.dosage as w from calls c join b using (chr, pos) where c.dosage is not null),
m as (select c.chr, c.pos, count(*) as n, covar_pop(c.dosage, c.dosage) * count(*) as xx, covar_pop(h.w, h.w) * count(*) as ww, covar_pop(c.dosage, h.w) * count(*) as xw,
  covar_pop(c.dosage, p.y) * count(*) as xy, covar_pop(h.w, p.y) * count(*) as wy, covar_pop(p.y, p.y) * count(*) as yy
  from calls c join pheno p using (sample_id) join h using (sample_id) where c.dosage is not null and p.y is not null
  and not exists (select 1 from b where b.chr = c.chr and b.pos = c.pos) group by c.chr, c.pos)
select chr, pos, n, round(1 - (yy - (ww * xy - xw * wy) / (xx * ww - xw * xw) * xy - (xx * wy - xw * xy) / (xx * ww - xw * xw) * wy) / yy * (n - 1) / (n - 3), 5) + 0.0 as adj_r2
from m where xx * ww - xw * xw > 1e-9 and yy > 0 and n > 3""")
def lm_stepwise_round2(spark, sf_dir):
    calls, pheno = fx.calls(spark, sf_dir), fx.phenotypes(spark, sf_dir)
    best = lm.best_marker(lm.scan(lm.matched(calls, pheno)))
    return lm.second_marker(calls, pheno, best).select("chr", "pos", "n", r("adj_r2", 5).alias("adj_r2"))


_FREE = "xx * ww - xw * xw > 1e-9::double * xx * ww and xx > 0 and yy > 0 and n > 3"


@register(_LM + """, b as (select chr, pos, n, adj_r2 from s where sd_err * sd_err * (n - 2) > 1e-9::double * (select max(syy) from q q2 where q2.chr = s.chr and q2.pos = s.pos) order by round(adj_r2, 9) desc, chr, pos limit 1),
h as (select c.sample_id, c.dosage as w from calls c join b using (chr, pos) where c.dosage is not null),
m as (select c.chr, c.pos, count(*) as n, covar_pop(c.dosage, c.dosage) * count(*) as xx, covar_pop(h.w, h.w) * count(*) as ww, covar_pop(c.dosage, h.w) * count(*) as xw,
  covar_pop(c.dosage, p.y) * count(*) as xy, covar_pop(h.w, p.y) * count(*) as wy, covar_pop(p.y, p.y) * count(*) as yy
  from calls c join pheno p using (sample_id) join h using (sample_id) where c.dosage is not null and p.y is not null
  and not exists (select 1 from b where b.chr = c.chr and b.pos = c.pos) group by c.chr, c.pos),
f as (select *, (yy - (ww * xy - xw * wy) / (xx * ww - xw * xw) * xy - (xx * wy - xw * xy) / (xx * ww - xw * xw) * wy) / yy as left_over from m where {free}),
t as (select chr, pos, n, 1 - left_over * (n - 1) / (n - 3) as adj_r2 from f where left_over > 1e-9::double order by round(1 - left_over * (n - 1) / (n - 3), 9) desc, chr, pos limit 1)
select cast(1 as integer) as round, chr, pos, n, round(adj_r2, 5) + 0.0 as adj_r2 from b union all select cast(2 as integer), chr, pos, n, round(adj_r2, 5) + 0.0 from t""".format(free=_FREE))
def lm_forward_two(spark, sf_dir):
    return lm.forward(fx.calls(spark, sf_dir), fx.phenotypes(spark, sf_dir), 2).select("round", "chr", "pos", "n", r("adj_r2", 5).alias("adj_r2"))


# candidates by their own p and frequency, then two rounds with the p of each
@register(_LM + f""", p0 as (select chr, pos, {_t_p("t2", "n")} as pvalue from s), f0 as (select chr, pos, sum(dosage) / 2 / count(dosage) as f from calls group by chr, pos having count(dosage) > 0),
d as (select chr, pos from p0 join f0 using (chr, pos) where pvalue <= 300.0::double / (select count(*) from p0) and least(f, 1 - f) >= 0.1),
b as (select s.chr, s.pos, s.n, s.adj_r2, t2 from s join d using (chr, pos) order by round(adj_r2, 9) desc, chr, pos limit 1),
h as (select c.sample_id, c.dosage as w from calls c join b using (chr, pos) where c.dosage is not null),
m as (select c.chr, c.pos, count(*) as n, covar_pop(c.dosage, c.dosage) * count(*) as xx, covar_pop(h.w, h.w) * count(*) as ww, covar_pop(c.dosage, h.w) * count(*) as xw,
  covar_pop(c.dosage, p.y) * count(*) as xy, covar_pop(h.w, p.y) * count(*) as wy, covar_pop(p.y, p.y) * count(*) as yy
  from calls c join d using (chr, pos) join pheno p using (sample_id) join h using (sample_id) where c.dosage is not null and p.y is not null
  and not exists (select 1 from b where b.chr = c.chr and b.pos = c.pos) group by c.chr, c.pos),
g as (select *, pow(xy - xw * wy / ww, 2) / (xx - xw * xw / ww) as gain, yy - wy * wy / ww as rest from m where {_FREE}),
t as (select chr, pos, n, 1 - (rest - gain) / yy * (n - 1) / (n - 3) as adj_r2, gain / (rest - gain) * (n - 3) as t2 from g where rest - gain > 1e-9::double * yy order by round(1 - (rest - gain) / yy * (n - 1) / (n - 3), 9) desc, chr, pos limit 1),
o as (select 1 as round, chr, pos, n, adj_r2, t2, n as m from b union all select 2, chr, pos, n, adj_r2, t2, n - 1 from t)
select cast(round as integer) as round, chr, pos, n, round(adj_r2, 5) + 0.0 as adj_r2, round({_t_p("t2", "m")}, 6) + 0.0 as pvalue from o""")
def lm_forward_gated(spark, sf_dir):
    calls, pheno = fx.calls(spark, sf_dir), fx.phenotypes(spark, sf_dir)
    found = lm.forward(calls, pheno, 2, lm.candidates(calls, pheno, 300.0, 0.1))
    return found.select("round", "chr", "pos", "n", r("adj_r2", 5).alias("adj_r2"), r("pvalue").alias("pvalue"))


# two rounds with the mean of each nation taken off the trait; a sample's id begins with its nation
_FAMILY = "fam as (select sample_id, y - avg(y) over (partition by w) as y from pheno where y is not null), "


@register(_FAMILY + ORACLE_SQL["lm_forward_two"][len(f"with {fx.SQL.strip()}, ") :].replace("join pheno", "join fam"))
def lm_forward_families(spark, sf_dir):
    own = fx.phenotypes(spark, sf_dir).withColumn("name", F.concat_ws("_", F.col("w").cast("int").cast("string"), F.col("sample_id").cast("string")))
    return lm.forward_families(fx.calls(spark, sf_dir), own, 2, "name").select("round", "chr", "pos", "n", r("adj_r2", 5).alias("adj_r2"))


@register()
def lm_forward_coefficients(spark, sf_dir):
    calls, pheno = fx.calls(spark, sf_dir), fx.phenotypes(spark, sf_dir)
    return lm.final_coefficients(calls, pheno, lm.forward(calls, pheno, 2, lm.candidates(calls, pheno, 300.0, 0.1)))


@register()
def lm_forward(spark, sf_dir):
    return lm.forward(fx.calls(spark, sf_dir), fx.phenotypes(spark, sf_dir), 3)


@register("""q as (select regr_slope(y, w) as b, regr_intercept(y, w) as a from pheno)
select sample_id, round(y - a - b * w, 6) + 0.0 as resid from pheno, q""")
def residualise_trait(spark, sf_dir):
    return lm.residuals(fx.phenotypes(spark, sf_dir), "y", "w").select("sample_id", r("resid").alias("resid"))


@register("""select cast(cc as int) as stratum, count(*) as n, round(regr_slope(y, w), 6) + 0.0 as slope, round(regr_r2(y, w), 6) + 0.0 as r2 from pheno where y is not null and w is not null
group by rollup(cc) having count(*) >= 3""")
def stratified_regression(spark, sf_dir):
    found = lm.stratified(fx.phenotypes(spark, sf_dir), "y", "w", F.col("cc").cast("int"), 3)
    return found.select("stratum", "n", r("slope").alias("slope"), r("r2").alias("r2"))


@register()
def perm_pvalue(spark, sf_dir):
    return lm.permutation_p(fx.calls(spark, sf_dir), fx.phenotypes(spark, sf_dir), 20, 11)


# --- relationship matrices ---


@register("""select a.sample_id as i, b.sample_id as j, round(avg(1 - abs(a.dosage - b.dosage) / 2.0::double), 8) + 0.0 as k, count(*) as n
from calls a join calls b on a.chr = b.chr and a.pos = b.pos and a.sample_id < b.sample_id where a.dosage is not null and b.dosage is not null group by a.sample_id, b.sample_id""")
def ibs_kinship(spark, sf_dir):
    return kinship.ibs(fx.calls(spark, sf_dir)).select("i", "j", r("k", 8).alias("k"), "n")


_RRM = """m as (select chr, pos, avg(dosage) as mu, stddev_samp(dosage) as sd from {c} group by chr, pos),
z as (select c.chr, c.pos, c.sample_id, (c.dosage - mu) / sd as z from {c} c join m using (chr, pos) where sd > 0 and c.dosage is not null) """


@register("q as (select 1)," + _RRM.format(c="calls") + "select a.sample_id as i, b.sample_id as j, round(avg(a.z * b.z), 6) + 0.0 as k from z a join z b on a.chr = b.chr and a.pos = b.pos group by a.sample_id, b.sample_id")
def rrm_kinship(spark, sf_dir):
    return kinship.rrm(fx.calls(spark, sf_dir)).select("i", "j", r("k").alias("k"))


@register("q as (select 1)," + _RRM.format(c="acalls") + ", k as (select a.sample_id as i, b.sample_id as j, avg(a.z * b.z) as k from z a join z b on a.chr = b.chr and a.pos = b.pos group by a.sample_id, b.sample_id), t as (select sum(case when i = j then k end) as d, sum(k) as s, count(*) filter (where i = j) as n from k) select i, j, round(k * (n - 1) / (d - s / n), 6) + 0.0 as k from k, t")
def kinship_rescale(spark, sf_dir):
    tiles = kinship.rescaled_tiles(kinship.gram_tiles(fx.variants(spark, sf_dir)))
    return kinship.tile_cells(tiles).select("i", "j", r("k").alias("k"))


@register("""select a.sample_id as i, b.sample_id as j, round(avg(1 - abs(a.dosage - b.dosage) / 2.0::double), 8) + 0.0 as k from acalls a join acalls b on a.chr = b.chr and a.pos = b.pos group by a.sample_id, b.sample_id""")
def ibs_dense(spark, sf_dir):
    return kinship.tile_cells(kinship.gram_tiles(fx.variants(spark, sf_dir), "ibs")).select("i", "j", r("k", 8).alias("k"))


@register("q as (select 1)," + _RRM.format(c="calls") + """select region_id, a.sample_id as i, b.sample_id as j, round(avg(a.z * b.z), 6) + 0.0 as k from z a join z b on a.chr = b.chr and a.pos = b.pos
join regions r on r.chr = a.chr and a.pos between r."start" and r."end" group by region_id, a.sample_id, b.sample_id""")
def local_rrm(spark, sf_dir):
    return kinship.local_rrm(fx.calls(spark, sf_dir), fx.regions(spark, sf_dir)).select("region_id", "i", "j", r("k").alias("k"))


@register("""o as (select c.* from calls c join pheno p using (sample_id) where p.cc = 1), d as (select c.* from calls c join pheno p using (sample_id) where p.cc = 2),
om as (select chr, pos, avg(dosage) as mu, stddev_samp(dosage) as sd from o group by chr, pos), dm as (select chr, pos, avg(dosage) as mu, stddev_samp(dosage) as sd from d group by chr, pos),
oz as (select chr, pos, sample_id, (dosage - mu) / sd as z from o join om using (chr, pos) where sd > 0 and dosage is not null), dz as (select chr, pos, sample_id, (dosage - mu) / sd as z from d join dm using (chr, pos) where sd > 0 and dosage is not null)
select oz.sample_id as obs_id, dz.sample_id as pred_id, round(avg(oz.z * dz.z), 6) + 0.0 as k from oz join dz using (chr, pos) group by oz.sample_id, dz.sample_id""".replace("o as (", "q as (select 1), o as (", 1))
def relation_matrix(spark, sf_dir):
    rows = fx.calls(spark, sf_dir).join(fx.phenotypes(spark, sf_dir).select("sample_id", "cc"), "sample_id")
    return kinship.relation(rows.where("cc = 1").drop("cc"), rows.where("cc = 2").drop("cc")).select("obs_id", "pred_id", r("k").alias("k"))


_IN_REGION = """o as (select region_id, c.* from calls c join pheno p using (sample_id) join regions g on g.chr = c.chr and c.pos between g."start" and g."end" where p.cc = 1),
d as (select region_id, c.* from calls c join pheno p using (sample_id) join regions g on g.chr = c.chr and c.pos between g."start" and g."end" where p.cc = 2)"""
_Z = "{z} as (select *, (dosage - avg(dosage) over (partition by region_id, chr, pos)) / stddev_samp(dosage) over (partition by region_id, chr, pos) as z from {t} where dosage is not null)"


@register(f"""{_IN_REGION}, {_Z.format(z="oz", t="o")}, {_Z.format(z="dz", t="d")}
select region_id, oz.sample_id as obs_id, dz.sample_id as pred_id, round(avg(oz.z * dz.z), 6) + 0.0 as k from oz join dz using (region_id, chr, pos) where isfinite(oz.z) and isfinite(dz.z) group by 1, 2, 3""")
def relation_matrix_regions(spark, sf_dir):
    rows = fx.calls(spark, sf_dir).join(fx.phenotypes(spark, sf_dir).select("sample_id", "cc"), "sample_id")
    found = kinship.local_relation(rows.where("cc = 1").drop("cc"), rows.where("cc = 2").drop("cc"), fx.regions(spark, sf_dir))
    return found.select("region_id", "obs_id", "pred_id", r("k").alias("k"))


@register("q as (select 1)," + _RRM.format(c="calls") + """, k as (select a.sample_id as i, b.sample_id as j from z a join z b on a.chr = b.chr and a.pos = b.pos group by 1, 2)
select cast(count(*) as bigint) as n_pairs, cast(count(*) filter (where not exists (select 1 from k t where t.i = k.j and t.j = k.i)) as bigint) as n_asymmetric from k""")
def kinship_symmetry(spark, sf_dir):
    return kinship.rrm_symmetry(fx.calls(spark, sf_dir))


# --- table statistics ---


_R_P = _t_p("(r * r / (1 - r * r) * (n - 2))", "n")


@register(f"""q as (select count(*) as n, corr(y, w) as r from pheno where y is not null and w is not null)
select n, round(r, 8) + 0.0 as r, round({_R_P}, 6) + 0.0 as p from q""")
def trait_corr_pearson(spark, sf_dir):
    return stats.pearson(fx.phenotypes(spark, sf_dir), "y", "w").select("n", r("r", 8).alias("r"), r("p").alias("p"))


@register(f"""q as (select rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0::double as a, rank() over (order by w) + (count(*) over (partition by w) - 1) / 2.0::double as b from pheno where y is not null and w is not null),
c as (select count(*) as n, corr(a, b) as r from q) select n, round(r, 8) + 0.0 as r, round({_R_P}, 6) + 0.0 as p from c""")
def trait_corr_spearman(spark, sf_dir):
    return stats.spearman(fx.phenotypes(spark, sf_dir), "y", "w").select("n", r("r", 8).alias("r"), r("p").alias("p"))


@register(f"""q as (select count(*) as n, corr(y, w) as r from pheno where y is not null and w is not null)
select n, round(r, 8) + 0.0 as r, round({_R_P}, 6) + 0.0 as p, round({_chi1_p("pow(atanh(abs(r)), 2) * (n - 3) / 1.06::double / 2")} / 2, 6) + 0.0 as p_z from q""")
def trait_corr_tests(spark, sf_dir):
    return stats.correlation_tests(fx.phenotypes(spark, sf_dir), "y", "w").select("n", r("r", 8).alias("r"), r("p").alias("p"), r("p_z").alias("p_z"))


@register("select count(o_totalprice) as n, round(median(cast(o_totalprice as double)), 6) + 0.0 as median from orders")
def price_median(spark, sf_dir):
    return stats.median(fx.table(spark, sf_dir, "orders"), "o_totalprice").select("n", r("median").alias("median"))


@register("""select s_suppkey, round(s_acctbal / (select sum(s_acctbal) from supplier), 9) + 0.0 as balance, round(s_nationkey / (select cast(sum(s_nationkey) as double) from supplier), 9) + 0.0 as nation from supplier""")
def normalized_columns(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").cast("double").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return stats.normalized_columns(rows, ["balance", "nation"]).select("s_suppkey", r("balance", 9).alias("balance"), r("nation", 9).alias("nation"))


@register("select o_orderkey, cast(rank() over (order by o_totalprice) + (count(*) over (partition by o_totalprice) - 1) / 2.0::double as double) as rank from orders")
def avg_ranks(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return stats.average_ranks(rows, "o_totalprice").select("o_orderkey", F.col("rank").cast("double").alias("rank"))


@register("""q as (select l_returnflag as a, l_linestatus as b, count(*) as o from lineitem group by 1, 2), ra as (select a, sum(o) as ra from q group by a), rb as (select b, sum(o) as rb from q group by b), n as (select sum(o) as n from q),
f as (select ra.a, rb.b, coalesce(q.o, 0) as o, cast(ra as double) * rb / n as e from ra cross join rb cross join n left join q on q.a = ra.a and q.b = rb.b)
select round(sum((o - e) * (o - e) / e), 6) + 0.0 as chi2, round(sum(2 * (case when o = 0 then 0.5 else o end) * ln((case when o = 0 then 0.5 else o end) / e)), 6) + 0.0 as lr, (count(distinct a) - 1) * (count(distinct b) - 1) as df from f""")
def chi_square_table(spark, sf_dir):
    return stats.contingency(fx.table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus").select(r("chi2").alias("chi2"), r("lr").alias("lr"), "df")


@register("""q as (select c_acctbal as value, count(*) as c from customer where c_acctbal is not null group by 1)
select value, sum(c) over (order by value) / cast(sum(c) over () as double) as share from q""")
def ks_ecdf(spark, sf_dir):
    return stats.ecdf(fx.table(spark, sf_dir, "customer"), "c_acctbal")


@register()
def ks_normality(spark, sf_dir):
    return stats.ks_normal(fx.table(spark, sf_dir, "customer"), "c_acctbal").select("n", r("d").alias("d"), r("p").alias("p"))


@register("select count(y) as n, round(-count(y) / 2.0::double * (ln(2 * pi()) + 1 + ln(var_pop(y))), 4) + 0.0 as logl from pheno")
def null_loglik(spark, sf_dir):
    return stats.null_log_likelihood(fx.phenotypes(spark, sf_dir), "y").select("n", r("logl", 4).alias("logl"))


@register("select o_orderkey, round((o_totalprice - avg(o_totalprice) over (partition by o_orderpriority)) / stddev_samp(o_totalprice) over (partition by o_orderpriority), 6) + 0.0 as z from orders")
def standardize(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return stats.standardized(rows, "o_totalprice", ["o_orderpriority"]).select("o_orderkey", r("z").alias("z"))


@register("""q as (select concat(cast(c_nationkey as varchar), '_', cast(c_custkey as varchar)) as id, c_acctbal as y from customer)
select id, round(y - avg(y) over (partition by split_part(id, '_', 1)), 6) + 0.0 as centered from q""")
def family_mean_center(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "customer").select(F.concat_ws("_", F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_acctbal").alias("y"))
    return stats.centered_by_prefix(rows, "id", "y").select("id", r("centered").alias("centered"))


@register("""select user_id, round(-2 * sum(ln(1 / (1 + abs(value)))), 6) + 0.0 as stat, 2 * count(*) as df from events where value is not null group by user_id""")
def fisher_combined(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "events").where("value is not null").select("user_id", (1 / (1 + F.abs("value"))).alias("p"))
    return stats.combined_p(rows, "p", ["user_id"]).select("user_id", r("stat").alias("stat"), "df")


@register("""q as (select o_custkey, min(o_totalprice) as o from orders group by o_custkey)
select o_custkey, round(count(*) filter (where o_totalprice >= o) / cast(count(*) as double), 6) as p, count(*) as n_null from orders join q using (o_custkey) group by o_custkey""")
def empirical_pvalue(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    observed = rows.groupBy("o_custkey").agg(F.min("o_totalprice").alias("o_totalprice"))
    found = stats.empirical_p(observed, rows, ["o_custkey"], "o_totalprice")
    return found.select("o_custkey", F.round("p", 6).alias("p"), "n_null")


@register("""x as (select s_suppkey as i, cast(s_acctbal as double) as a, cast(s_nationkey as double) as b from supplier),
p as (select l.i, abs(l.a - r.a) as a, abs(l.b - r.b) as b from x l, x r),
ra as (select i, avg(a) as ma, avg(b) as mb from p group by i), g as (select avg(a) as ga, avg(b) as gb from p), j as (select l.i, r.i as j, abs(l.a - r.a) as a, abs(l.b - r.b) as b from x l, x r),
c as (select j.a - u.ma - v.ma + ga as a, j.b - u.mb - v.mb + gb as b from j join ra u on u.i = j.i join ra v on v.i = j.j, g)
select count(distinct i) as n, round((select sqrt(avg(a * b) / sqrt(avg(a * a) * avg(b * b))) from c), 6) + 0.0 as dcor from ra""".replace("x as", "q as (select 1), x as", 1))
def distance_correlation(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "supplier").select("s_suppkey", F.array(F.col("s_acctbal").cast("double")).alias("a"), F.array(F.col("s_nationkey").cast("double")).alias("b"))
    return stats.distance_correlation(rows, "s_suppkey", "a", "b").select("n", r("dcor").alias("dcor"))


@register()
def cluster_choice(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    return stats.clusters(rows, "x", [2, 3, 4]).select("k", r("dbi", 4).alias("dbi"))


# representatives of the clusters around the mean vectors of labels; clusters below 30 rows are dissolved
@register("""q as (select vec_id, label, list_transform(embedding, lambda v: cast(v as double)) as x from embeddings),
m as (select label, i, avg(x[i]) as v from q, unnest(range(1, len(x) + 1)) as u(i) group by label, i), c as (select label, list(v order by i) as c from m group by label),
d as (select vec_id, c.label, sqrt(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))) as gap from q, c),
f as (select vec_id, arg_min(label, (gap, label)) as label from d group by vec_id), k as (select label from f group by label having count(*) >= 30),
g as (select vec_id, arg_min(label, (gap, label)) as cluster, min(gap) as gap from d where label in (from k) group by vec_id)
select cast(cluster as int) as cluster, arg_min(vec_id, (gap, vec_id)) as representative, round(min(gap), 6) as gap, count(*) as size from g group by 1""")
def cluster_representatives(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    means = rows.select("label", F.posexplode("x").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("v")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("c"))
    centres = [[x["v"] for x in row["c"]] for row in means.orderBy("label").collect()]  # a row a label
    return stats.representatives(rows, "vec_id", "x", centres, 30).select("cluster", "representative", r("gap").alias("gap"), "size")


@register()
def cluster_choice_representatives(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    return stats.best_clusters(rows, "vec_id", "x", [2, 3, 4], 10).select("k", r("dbi", 4).alias("dbi"), "cluster", "representative", r("gap", 4).alias("gap"), "size")


# --- axes, crosses, posterior ---


@register("q as (select chr, max(pos) as len from calls group by chr) select chr, cast(coalesce(sum(len) over (order by chr rows between unbounded preceding and 1 preceding), 0) as bigint) as \"offset\" from q")
def chrom_offsets(spark, sf_dir):
    return crosses.offsets(fx.calls(spark, sf_dir))


@register("""q as (select chr, max(pos) as len from calls group by chr), o as (select chr, coalesce(sum(len) over (order by chr rows between unbounded preceding and 1 preceding), 0) as o from q), f as (select chr, pos, avg(dosage) / 2 + 0.001 as p from calls group by chr, pos)
select f.chr, f.pos, cast(f.pos + o as bigint) as x, round(-log10(p), 6) + 0.0 as y from f join o using (chr) where p is not null""")
def manhattan_points(spark, sf_dir):
    rows = fx.calls(spark, sf_dir).groupBy("chr", "pos").agg((F.avg("dosage") / 2 + 0.001).alias("pvalue"))
    return crosses.manhattan(rows).where("y is not null").select("chr", "pos", F.col("x").cast("long").alias("x"), r("y").alias("y"))


@register("""q as (select user_id as region_id, value as l, cast(event_id % 20 as double) / 20 as h from events where value is not null), b as (select region_id, max(l) as b from q group by region_id),
w as (select region_id, cast(floor(h / 0.25::double) as bigint) as bin, sum(exp(l - b)) as w from q join b using (region_id) group by 1, 2)
select region_id, bin, round(w / sum(w) over (partition by region_id), 6) + 0.0 as mass from w""")
def alpha_posterior(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "events").where("value is not null").select(F.col("user_id").alias("region_id"), F.col("value").alias("loglik"), ((F.col("event_id") % 20).cast("double") / 20).alias("h2"))
    return crosses.posterior(rows, 0.25).select("region_id", "bin", r("mass").alias("mass"))


@register("""q as (select o_custkey as line, o_orderkey as pos, case when o_orderstatus = 'F' then 'A' when o_orderstatus = 'O' then 'B' end as code from orders),
f as (select *, last_value(code ignore nulls) over (partition by line order by pos rows between unbounded preceding and current row) as l, first_value(code ignore nulls) over (partition by line order by pos rows between current row and unbounded following) as r from q)
select line, pos, coalesce(code, case when l is null then r when r is null then l when l = r then l else 'H' end) as filled from f""")
def ril_gap_fill(spark, sf_dir):
    code = F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "B")
    rows = fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("line"), F.lit(1).alias("chr"), F.col("o_orderkey").alias("pos"), code.alias("code"))
    return crosses.fill_gaps(rows).select("line", "pos", "filled")


# --- rare variants and genes ---

_CODES = """c as (select chr, pos, count(*) filter (where floor(dosage + 0.5) = 0) as n0, count(*) filter (where floor(dosage + 0.5) = 1) as n1, count(*) filter (where floor(dosage + 0.5) = 2) as n2, count(dosage) as n from calls group by chr, pos),
k as (select chr, pos, n, case when n0 > 0 and n1 > 0 and n2 > 0 then case when 2 * n0 + n1 < 2 * n2 + n1 then 0 else 1 end
   when n0 > 0 and n1 > 0 then case when n0 <= n1 then 0 else 1 end when n0 > 0 and n2 > 0 then case when n0 <= n2 then 0 else 2 end when n1 > 0 and n2 > 0 then case when n1 <= n2 then 1 else 2 end end as code,
  case when n0 > 0 and n1 > 0 and n2 > 0 then least(2 * n0 + n1, 2 * n2 + n1) when n0 > 0 and n1 > 0 then case when n0 <= n1 then 2 * n0 else n1 end when n0 > 0 and n2 > 0 then 2 * least(n0, n2) when n1 > 0 and n2 > 0 then case when n1 <= n2 then n1 else 2 * n2 end end as minor from c),"""
_BURDEN = _CODES + """b as (select region_id, sample_id, max(case when floor(dosage + 0.5) = code and minor < floor(n * 2 * 0.15::double) then 2.0::double else 0.0::double end) as burden
  from calls join k using (chr, pos) join regions g on g.chr = calls.chr and calls.pos between g."start" and g."end" where dosage is not null group by region_id, sample_id) """


@register("q as (select 1), " + _BURDEN + "select region_id, sample_id, burden from b")
def burden_collapse(spark, sf_dir):
    return variants.burden(fx.calls(spark, sf_dir), fx.regions(spark, sf_dir), 0.15)


@register("q as (select 1), " + _BURDEN + """, s as (select region_id, count(*) as n, regr_slope(y, burden) as coef, regr_r2(y, burden) as r2, regr_sxx(y, burden) as sxx, regr_syy(y, burden) as syy from b join pheno using (sample_id) where y is not null group by region_id)
select region_id, n, round(coef + 1e-8, 6) + 0.0 as coef, round(r2 / (1 - r2) * (n - 2), 5) + 0.0 as t2 from s where sxx > 0 and syy > 0 and n > 2 and r2 < 1""")
def burden_lm(spark, sf_dir):
    rows = variants.burden(fx.calls(spark, sf_dir), fx.regions(spark, sf_dir), 0.15).join(fx.phenotypes(spark, sf_dir).where("y is not null"), "sample_id")
    return lm.scan(rows, "burden", ("region_id",)).select("region_id", "n", r(F.col("coef") + 1e-8).alias("coef"), r("t2", 5).alias("t2"))


def _gene_rows(spark, sf_dir):
    calls = fx.calls(spark, sf_dir).join(fx.phenotypes(spark, sf_dir).where("y is not null").select("sample_id", "y"), "sample_id")
    return calls.join(fx.models(spark, sf_dir).where("origin = 'EN'").select("gene", "chr", "pos", "weight"), ["chr", "pos"])


_S = """x as (select m.gene, {w} as weight, c.chr, c.pos, c.sample_id, c.dosage, p.y from calls c join pheno p using (sample_id) join models m on m.chr = c.chr and m.pos = c.pos {j} where m.origin = 'EN' and p.y is not null),
mu as (select avg(y) as m from (select sample_id, min(y) as y from x group by sample_id)),
v as (select gene, weight, chr, pos, avg(dosage) as mg from x group by 1, 2, 3, 4),
s as (select x.gene, x.weight, x.chr, x.pos, sum(coalesce(x.dosage, v.mg, 0) * (x.y - mu.m)) as s from x join v using (gene, weight, chr, pos), mu group by 1, 2, 3, 4) """
_Q = _S + "select gene, count(*) as n_variants, round(sum(weight * weight * s * s), 2) + 0.0 as q from s group by gene"


@register("q as (select 1), " + _Q.format(w="m.weight", j=""))
def gene_score_q(spark, sf_dir):
    return kernel_test.score_q(_gene_rows(spark, sf_dir)).select("gene", "n_variants", r("q", 2).alias("q"))


@register("q as (select 1), " + _Q.format(w="cast(1 as double)", j=""))
def gene_score_q_unweighted(spark, sf_dir):
    return kernel_test.score_q(_gene_rows(spark, sf_dir).withColumn("weight", F.lit(1.0))).select("gene", "n_variants", r("q", 2).alias("q"))


@register("""q as (select chr, pos, avg(dosage) / 2 as f from calls join pheno using (sample_id) where y is not null group by chr, pos), """ + _S.format(w="coalesce(25 * pow(1 - least(q.f, 1 - q.f), 24), 0)", j="join q on q.chr = c.chr and q.pos = c.pos") + """select gene, count(*) as n_variants, round(ln(sum(weight * weight * s * s) + 1), 6) + 0.0 as log_q from s group by gene""")
def gene_score_q_default(spark, sf_dir):
    found = kernel_test.score_q(kernel_test.with_default_weights(_gene_rows(spark, sf_dir)))
    return found.select("gene", "n_variants", r(F.log(F.col("q") + 1)).alias("log_q"))


def _samples(spark, sf_dir) -> int:
    """Length of the sample axis of the array store."""
    return fx.table(spark, sf_dir, "embeddings").agg(F.max(F.size("embedding"))).first()[0] or 0


def _array_trait(spark, sf_dir):
    return mixed.trait_array(fx.array_trait(spark, sf_dir), _samples(spark, sf_dir))


@register()
def gene_kernel_p(spark, sf_dir):
    rows = fx.variants(spark, sf_dir).withColumns({"gene": F.concat(F.lit("g"), (F.floor(F.col("pos") / 25000)).cast("string")), "weight": (F.col("pos") % 13 + 1).cast("double") / 13})
    found = kernel_test.gene_p(rows, _array_trait(spark, sf_dir))
    return found.select("gene", "n_variants", r("q", 3).alias("q"), r("pvalue", 5).alias("pvalue"))


# one variant a gene: q over its scale is a chi-square of one degree, whose tail is that of the normal
# distribution, here by the series of erf
@register("""q as (select cast(cast(floor(pos / 1000) as bigint) as varchar) as gene, chr, pos, count(*) as n, sum(dosage * (y - m)) as s, var_pop(dosage) * count(*) as d from acalls join atrait on ordinal = sample_id, (select avg(y) as m from atrait) group by chr, pos),
z as (select gene, pow(s, 2) as q, pow(s, 2) / d / (select var_samp(y) from atrait) / 2 as h from q where d > 0)
select gene, round(q, 3) + 0.0 as q, round(case when h > 16 then 0 else 1 - exp(-h) * list_sum(list_transform(range(0, 120), lambda k: pow(h, k + 0.5::double) / exp(lgamma(k + 1.5::double)))) end, 6) + 0.0 as pvalue from z""")
def gene_kernel_p_single(spark, sf_dir):
    rows = fx.variants(spark, sf_dir).select(F.floor(F.col("pos") / 1000).cast("long").cast("string").alias("gene"), F.lit(1.0).alias("weight"), "g")
    found = kernel_test.gene_p(rows, _array_trait(spark, sf_dir)).where("pvalue < 1 or q > 1e-9")
    return found.select("gene", r("q", 3).alias("q"), r("pvalue").alias("pvalue"))


# --- mixed models ---


@register()
def emmax_scan(spark, sf_dir):
    v = fx.variants(spark, sf_dir)
    return mixed.emmax(v, _array_trait(spark, sf_dir), kinship.gram(v))


@register("""q as (select chr, pos, count(*) as n, regr_slope(y, dosage) as coef, regr_r2(y, dosage) as r2, regr_sxx(y, dosage) as sxx from acalls join atrait on ordinal = sample_id group by chr, pos)
select chr, pos, n, round(coef + 1e-7, 4) + 0.0 as coef, round(r2 / (1 - r2) * (n - 2) + 1e-7, 4) + 0.0 as t2 from q where sxx > 0 and r2 < 1""")
def emmax_identity_kinship(spark, sf_dir):
    y = _array_trait(spark, sf_dir)
    found = mixed.emmax(fx.variants(spark, sf_dir), y, np.eye(len(y)))
    return found.select("chr", "pos", "n", r(F.col("coef") + 1e-7, 4).alias("coef"), r(F.col("t2") + 1e-7, 4).alias("t2"))


# a packed store is written, and a region of it scanned: a folder and a few row groups
@register("""q as (select chr, pos, count(*) as n, regr_slope(y, dosage) as coef, regr_r2(y, dosage) as r2, regr_sxx(y, dosage) as sxx from acalls join atrait on ordinal = sample_id where chr = 3 and pos between 50000 and 2000000 group by chr, pos)
select chr, pos, n, round(coef + 1e-7, 4) + 0.0 as coef, round(r2 / (1 - r2) * (n - 2) + 1e-7, 4) + 0.0 as t2 from q where sxx > 0 and r2 < 1""")
def packed_region_scan(spark, sf_dir):
    y = _array_trait(spark, sf_dir)
    path = scratch.folder(spark, "packed")
    genotypes.write_packed(fx.variants(spark, sf_dir), [str(i) for i in range(len(y))], path)
    v, _ = genotypes.read_store(spark, path)
    found = mixed.emmax(variants.in_region(v, 3, 50_000, 2_000_000), y, np.eye(len(y)))
    return found.select("chr", "pos", "n", r(F.col("coef") + 1e-7, 4).alias("coef"), r(F.col("t2") + 1e-7, 4).alias("t2"))


@register()
def emmax_regions(spark, sf_dir):
    v = fx.variants(spark, sf_dir)
    return mixed.emmax_regions(v, fx.regions(spark, sf_dir), _array_trait(spark, sf_dir), kinship.gram(v), 100.0)


@register(f"""q as (select chr, pos, count(*) as n, regr_slope(y, dosage) as coef, regr_r2(y, dosage) as r2, regr_sxx(y, dosage) as sxx from acalls join atrait on ordinal = sample_id group by chr, pos),
s as (select chr, pos, n, coef, r2 / (1 - r2) * (n - 2) as t2 from q where sxx > 0 and r2 < 1), p as (select *, {_t_p("t2", "n")} as pvalue from s)
select region_id, p.chr, p.pos, round(coef + 1e-7, 4) + 0.0 as coef, round(pvalue, 5) + 0.0 as pvalue from p join regions g on g.chr = p.chr and p.pos between g."start" and g."end" where pvalue <= 100.0::double / (select count(*) from q)""")
def emmax_regions_identity(spark, sf_dir):
    y = _array_trait(spark, sf_dir)
    found = mixed.emmax_regions(fx.variants(spark, sf_dir), fx.regions(spark, sf_dir), y, np.eye(len(y)), 100.0)
    return found.select("region_id", "chr", "pos", r(F.col("coef") + 1e-7, 4).alias("coef"), r("pvalue", 5).alias("pvalue"))


@register()
def burden_emmax(spark, sf_dir):
    v = fx.variants(spark, sf_dir)
    return mixed.burden_emmax(v, fx.regions(spark, sf_dir), _array_trait(spark, sf_dir), kinship.gram(v), 0.3)


@register("""q as (select chr, pos, count(*) filter (where dosage = 0) as a, count(*) filter (where dosage = 1) as b, count(*) filter (where dosage = 2) as c, count(*) as n from acalls group by chr, pos),
m as (select chr, pos, n, case when a > 0 and b > 0 and c > 0 then case when 2 * a + b < 2 * c + b then 0 else 1 end
   when a > 0 and b > 0 then case when a <= b then 0 else 1 end when a > 0 and c > 0 then case when a <= c then 0 else 2 end when b > 0 and c > 0 then case when b <= c then 1 else 2 end end as code,
  case when a > 0 and b > 0 and c > 0 then least(2 * a + b, 2 * c + b) when a > 0 and b > 0 then case when a <= b then 2 * a else b end when a > 0 and c > 0 then 2 * least(a, c) when b > 0 and c > 0 then case when b <= c then b else 2 * c end end as mafc from q),
u as (select region_id, sample_id, max(case when dosage = code and mafc < floor(n * 0.6::double) then 2.0::double else 0.0::double end) as burden from acalls join m using (chr, pos) join regions g on g.chr = acalls.chr and acalls.pos between g."start" and g."end" group by 1, 2),
s as (select region_id, count(*) as n, regr_slope(y, burden) as coef, regr_r2(y, burden) as r2, regr_sxx(y, burden) as sxx from u join atrait on ordinal = sample_id group by region_id)
select region_id, n, round(coef + 1e-7, 4) + 0.0 as coef, round(r2 / (1 - r2) * (n - 2) + 1e-7, 4) + 0.0 as t2 from s where sxx > 0 and r2 < 1""")
def burden_emmax_identity(spark, sf_dir):
    y = _array_trait(spark, sf_dir)
    found = mixed.burden_emmax(fx.variants(spark, sf_dir), fx.regions(spark, sf_dir), y, np.eye(len(y)), 0.3)
    return found.select("region_id", "n", r(F.col("coef") + 1e-7, 4).alias("coef"), r(F.col("t2") + 1e-7, 4).alias("t2"))


@register()
def fastlmm_scan(spark, sf_dir):
    v = fx.variants(spark, sf_dir)
    return mixed.fastlmm(v, _array_trait(spark, sf_dir), kinship.gram(v))


# under an identity kinship delta does not matter, and the fits are those of least squares
_OLS = """q as (select chr, pos, count(*) as n, regr_slope(y, dosage) as coef, regr_r2(y, dosage) as r2 from acalls join atrait on ordinal = sample_id group by chr, pos having var_pop(dosage) > 0)"""


@register(f"""{_OLS} select chr, pos, round(coef, 4) + 0.0 as coef, round(r2, 6) + 0.0 as r2, round({_chi1_p("(-n * ln(1 - r2) / 2)")}, 6) + 0.0 as pvalue from q""")
def fastlmm_identity(spark, sf_dir):
    found = mixed.fastlmm(fx.variants(spark, sf_dir), _array_trait(spark, sf_dir), np.eye(_samples(spark, sf_dir)))
    return found.select("chr", "pos", near("coef", 4).alias("coef"), r("r2").alias("r2"), r("pvalue").alias("pvalue"))


@register(f"""{_OLS} select chr, pos, round(coef, 4) + 0.0 as coef, round(r2, 6) + 0.0 as r2, round({_t_p("(r2 / (1 - r2) * (n - 2))", "n")}, 6) + 0.0 as pvalue from q""")
def fastlmm_reml_identity(spark, sf_dir):
    found = mixed.fastlmm(fx.variants(spark, sf_dir), _array_trait(spark, sf_dir), np.eye(_samples(spark, sf_dir)), restricted=True)
    return found.select("chr", "pos", near("coef", 4).alias("coef"), r("r2").alias("r2"), r("pvalue").alias("pvalue"))


@register()
def fastlmm_reml(spark, sf_dir):
    v = fx.variants(spark, sf_dir)
    return mixed.fastlmm(v, _array_trait(spark, sf_dir), kinship.gram(v), restricted=True)


def _marker_terms(spark, sf_dir):
    """Terms of a kinship of some 30 variants, spread over the chromosomes."""
    v = fx.variants(spark, sf_dir)
    sites = [(s["chr"], s["pos"]) for s in simulate.evenly_spaced(v.select("chr", "pos"), 3).orderBy("chr", "pos").limit(64).collect()]
    return mixed.marker_terms(v, sites, _samples(spark, sf_dir))


def _label_traits(spark, sf_dir):
    """trait, y: the mean vector of each label."""
    traits = fx.table(spark, sf_dir, "embeddings").select(F.concat(F.lit("label"), F.col("label").cast("string")).alias("trait"), F.posexplode("embedding").alias("o", "x"))
    return traits.groupBy("trait", "o").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy("trait").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "m"))), lambda s: s["m"]).alias("y"))


@register()
def heritability(spark, sf_dir):
    return mixed.heritability(_label_traits(spark, sf_dir), kinship.gram(fx.variants(spark, sf_dir), "ibs"))


@register()
def heritability_low_rank(spark, sf_dir):
    return mixed.heritability_low_rank(_label_traits(spark, sf_dir), _marker_terms(spark, sf_dir))


@register()
def kinships_compared(spark, sf_dir):
    v = fx.variants(spark, sf_dir)
    return mixed.compare_kinships(_label_traits(spark, sf_dir), kinship.gram(v), kinship.gram(v, "ibs"))


@register()
def kinships_compared_reml(spark, sf_dir):
    v = fx.variants(spark, sf_dir)
    return mixed.compare_kinships(_label_traits(spark, sf_dir), kinship.gram(v), kinship.gram(v, "ibs"), restricted=True)


@register()
def local_vc(spark, sf_dir):
    v = fx.variants(spark, sf_dir)
    k = kinship.gram(v)
    windows = variants.in_tiling_windows(v, 60_000)
    return mixed.local_components(windows, _array_trait(spark, sf_dir), k, ["chr", "start"])


@register()
def compound_vc(spark, sf_dir):
    v = fx.variants(spark, sf_dir)
    compounds = joins.in_regions(v, fx.regions(spark, sf_dir)).withColumn("compound_id", F.split("region_id", ":")[1].cast("long"))
    return mixed.local_components(compounds, _array_trait(spark, sf_dir), kinship.gram(v), ["compound_id"])


@register()
def region_vc(spark, sf_dir):
    v = fx.variants(spark, sf_dir)
    return mixed.local_components(joins.in_regions(v, fx.regions(spark, sf_dir)), _array_trait(spark, sf_dir), kinship.gram(v), ["region_id"])


@register()
def gblup_predict(spark, sf_dir):
    v = fx.variants(spark, sf_dir)
    k = kinship.rescale(kinship.gram(v))
    y = _array_trait(spark, sf_dir)
    return mixed.leave_one_out(spark, k, y, 0.5)


@register()
def gblup_held_out(spark, sf_dir):
    y = _array_trait(spark, sf_dir)
    y[1::4] = np.nan  # held out
    found = prediction.predict_held_out(fx.variants(spark, sf_dir), {"weighted": y})
    return found.select("trait", "ordinal", "known", r("h2").alias("h2"), r("predicted", 4).alias("predicted"))


@register()
def local_vc_reml(spark, sf_dir):
    v = fx.variants(spark, sf_dir)
    windows = variants.in_tiling_windows(v, 60_000)
    return mixed.local_components(windows, _array_trait(spark, sf_dir), kinship.gram(v), ["chr", "start"], restricted=True)


@register()
def gblup_with_local(spark, sf_dir):
    v, y = fx.variants(spark, sf_dir), _array_trait(spark, sf_dir)
    y[2::5] = np.nan  # to be predicted
    local = v.withColumn("kernel", F.concat(F.lit("chr"), F.col("chr").cast("string")))
    shares = local.select("kernel").distinct().withColumn("h2", F.lit(0.3))
    terms = prediction.global_term(spark, kinship.rescale(kinship.gram(v)), y, 0.5).unionByName(prediction.local_terms(local, y, shares))
    found, _ = prediction.combined_prediction(terms, y)
    return found.select("ordinal", "known", r("predicted", 4).alias("predicted"))


@register()
def kinship_weights(spark, sf_dir):
    v = fx.variants(spark, sf_dir)
    odd, even = (kinship.gram(v.where(F.col("chr") % 2 == i), "ibs") for i in (1, 0))
    return mixed.kinship_weights(_label_traits(spark, sf_dir), odd, even)


@register()
def forward_by_region(spark, sf_dir):
    v = fx.variants(spark, sf_dir)
    return mixed.forward_regions(v, fx.regions(spark, sf_dir), _array_trait(spark, sf_dir), kinship.gram(v), 3)


# the joint model of two variants by its sums; what the first explains is projected out of the second
@register(f"""q as (select region_id, chr, pos from (select distinct chr, pos from acalls) v join regions g using (chr) where pos between g."start" and g."end"),
c as (select chr, pos, count(*) as n, corr(dosage, y) as r from acalls join atrait on ordinal = sample_id group by chr, pos having var_pop(dosage) > 0),
f1 as (select region_id, chr, pos, n, r * r as r2, row_number() over (partition by region_id order by round(r * r, 9) desc, chr, pos) as turn from q join c using (chr, pos)),
a1 as (select * from f1 where turn = 1),
x as (select q.region_id, q.chr, q.pos, a.dosage as x, w.dosage as w, t.y as y from q join a1 on a1.region_id = q.region_id and (a1.chr <> q.chr or a1.pos <> q.pos)
  join acalls a on a.chr = q.chr and a.pos = q.pos join acalls w on w.chr = a1.chr and w.pos = a1.pos and w.sample_id = a.sample_id join atrait t on t.ordinal = a.sample_id),
m as (select region_id, chr, pos, count(*) as n, var_pop(x) as xx, var_pop(w) as ww, covar_pop(x, w) as xw, covar_pop(x, y) as xy, covar_pop(w, y) as wy, var_pop(y) as yy from x group by 1, 2, 3),
g2 as (select *, pow(xy - xw * wy / ww, 2) / (xx - xw * xw / ww) as gain, yy - wy * wy / ww as rest from m where xx - xw * xw / ww > 1e-9 * xx),
f2 as (select *, row_number() over (partition by region_id order by round(gain / yy, 9) desc, chr, pos) as turn from g2),
o as (select region_id, 1 as round, chr, pos, n, 1 - (1 - r2) * (n - 1) / (n - 2) as adj, r2 / (1 - r2) * (n - 2) as t2 from a1
  union all select region_id, 2, chr, pos, n - 1, 1 - (rest - gain) / yy * (n - 1) / (n - 3), gain / (rest - gain) * (n - 3) from f2 where turn = 1)
select region_id, cast(round as integer) as round, chr, pos, round(adj, 6) + 0.0 as adj_r2, round({_t_p("t2", "n")}, 6) + 0.0 as pvalue from o""")
def forward_by_region_identity(spark, sf_dir):
    y = _array_trait(spark, sf_dir)
    found = mixed.forward_regions(fx.variants(spark, sf_dir), fx.regions(spark, sf_dir), y, np.eye(len(y)), 2)
    return found.select("region_id", "round", "chr", "pos", r("adj_r2").alias("adj_r2"), r("pvalue").alias("pvalue"))


# --- simulated traits ---


@register("""q as (select 1), e as (select chr, pos, weight from models where origin = 'EN')
select sample_id, round(sum(coalesce(dosage, 0) * weight), 6) + 0.0 as value from calls join e using (chr, pos) group by sample_id""")
def sim_additive(spark, sf_dir):
    effects = fx.models(spark, sf_dir).where("origin = 'EN'").select("chr", "pos", F.col("weight").alias("effect"))
    found = simulate.additive(fx.calls(spark, sf_dir), effects)
    return found.select("sample_id", r("value").alias("value"))


@register("""q as (select sample_id, sum(case when origin = 'EN' then coalesce(dosage, 0) * weight else 0 end) as en, sum(case when origin = 'eQTL' then coalesce(dosage, 0) * weight else 0 end) as eq from calls join models using (chr, pos) where origin in ('EN', 'eQTL') group by sample_id),
v as (select var_pop(en) as ve, var_pop(eq) as vq from q) select sample_id, round(en + case when vq > 0 then sqrt(ve / vq) * sqrt(0.4::double / 0.6::double) else 0 end * eq, 6) + 0.0 as value from q, v""")
def sim_two_origins(spark, sf_dir):
    effects = fx.models(spark, sf_dir).select("chr", "pos", F.col("weight").alias("effect"), "origin")
    return simulate.two_origins(fx.calls(spark, sf_dir), effects, 0.6).select("sample_id", r("value").alias("value"))


@register("""q as (select sample_id, sum(coalesce(dosage, 0) * (weight - 0.5::double)) as v from calls join models using (chr, pos) where origin = 'EN' group by sample_id) select sample_id, cast(v > 0 as integer) as "case" from q""")
def sim_threshold(spark, sf_dir):
    effects = fx.models(spark, sf_dir).where("origin = 'EN'").select("chr", "pos", (F.col("weight") - 0.5).alias("effect"))
    return simulate.liability(simulate.additive(fx.calls(spark, sf_dir), effects)).select("sample_id", "case")


@register("""select sample_id, cast(sum(coalesce(dosage, 0)) >= 3 as integer) as "case" from calls join models using (chr, pos) where origin = 'EN' group by sample_id""")
def sim_heterogeneity(spark, sf_dir):
    return simulate.heterogeneity(fx.calls(spark, sf_dir), fx.models(spark, sf_dir).where("origin = 'EN'"), 3)


@register("""q as (select region_id, sample_id, least(2.0::double, sum(dosage)) as v from calls c join regions g on g.chr = c.chr and c.pos between g."start" and g."end" where dosage is not null group by region_id, sample_id)
select sample_id, sum(v) as value from q group by sample_id""")
def sim_region_cap2(spark, sf_dir):
    return simulate.region_capped(fx.calls(spark, sf_dir), fx.regions(spark, sf_dir))


_PARTS = """q as (select p_size, chr, s, part from (select distinct p_size, p_partkey % 5 as k from part) x(p_size, k), lateral (select cast(k + 1 as int) as chr, cast(p_size as bigint) * 40000 + 1 as s, case when k = 0 then 1 when k = 1 then 2 end as part) where part is not null),
h as (select p_size, part, sample_id, least(2.0::double, sum(dosage)) as v from calls c join q on q.chr = c.chr and c.pos between q.s and q.s + 29999 where dosage is not null group by 1, 2, 3),
t as (select cast(p_size as varchar) as compound_id, sample_id, coalesce(max(case when part = 1 then v end), 0) as a, coalesce(max(case when part = 2 then v end), 0) as b from h group by 1, 2) """


def _compound(kind, sql):
    def query(spark, sf_dir):
        parts = fx.regions(spark, sf_dir).where("chr in (1, 2)").select(F.split("region_id", ":")[1].alias("compound_id"), F.col("chr").alias("part"), "chr", "start", "end")
        return simulate.compound(fx.calls(spark, sf_dir), parts, kind)

    register(_PARTS + f"select compound_id, sample_id, {sql} as value from t", f"sim_compound_{kind}")(query)


for _kind, _sql in (("add", "a + b"), ("hetero", "cast(a > 0 or b > 0 as double)"), ("both", "cast(a > 0 and b > 0 as double)"), ("compensate", "cast((a > 0) <> (b > 0) as double)")):
    _compound(_kind, _sql)


def _pair(kind, sql):
    def query(spark, sf_dir):
        calls = fx.calls(spark, sf_dir).where("dosage is not null")
        # two variants a sample: the largest dosage on chromosomes 1 and 2
        best = calls.where("chr in (1, 2)").groupBy("chr", "sample_id").agg(F.avg("dosage").alias("m")).select("chr", F.lit(1).cast("long").alias("pos"), "sample_id", (F.col("m") > 0.45).cast("double").alias("dosage"))
        return simulate.two_variant(best, (1, 1), (2, 1), kind)

    register("q as (select sample_id, avg(dosage) filter (where chr = 1) > 0.45 as x, avg(dosage) filter (where chr = 2) > 0.45 as y from calls where dosage is not null group by sample_id) " + f"select sample_id, cast({sql} as double) as value from q where x is not null and y is not null", f"sim_{kind}")(query)


for _kind, _sql in (("and", "x and y"), ("or", "x or y"), ("xor", "x <> y")):
    _pair(_kind, _sql)


def _epistasis(kind, sql):
    def query(spark, sf_dir):
        # four sites: the variants of highest frequency on the first four chromosomes
        freq = variants.frequencies(fx.calls(spark, sf_dir)).where("chr <= 4")
        sites = freq.groupBy("chr").agg(F.max_by("pos", F.struct("freq", -F.col("pos"))).alias("pos"))
        return simulate.epistasis(fx.calls(spark, sf_dir), sites, kind).select("sample_id", r("value").alias("value"))

    register("""q as (select chr, pos, avg(dosage) as f from calls where dosage is not null and chr <= 4 group by chr, pos), s as (select chr, pos, f from (select *, row_number() over (partition by chr order by f desc, pos) as k from q) where k = 1),
l as (select chr, pos from s order by f desc, chr, pos limit 1), x as (select c.sample_id, sum(case when l.chr is not null then dosage else 0 end) as l, sum(case when l.chr is null then dosage else 0 end) as r from calls c join s using (chr, pos) left join l on l.chr = c.chr and l.pos = c.pos where dosage is not null group by c.sample_id) """ + f"select sample_id, {sql} + 0.0 as value from x", f"sim_epistasis_{kind}")(query)


for _kind, _sql in (("canalization", "case when l > 0 then 0 else r end"), ("sign", "case when l > 0 then -r else r end"), ("compensation", "abs(l - r)")):
    _epistasis(_kind, _sql)


# --- prioritisation ---


def _mutations(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem").join(fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return rows.select(F.col("p_brand").alias("gene"), F.col("l_suppkey").alias("sample_id"), (F.col("l_returnflag") != "A").alias("is_case"), F.concat_ws("_", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string")).alias("site"), F.col("l_quantity").alias("score"))


_MUT = """m as (select p_brand as gene, l_suppkey as sample_id, l_returnflag <> 'A' as is_case, concat(cast(l_partkey as varchar), '_', cast(l_linenumber as varchar)) as site, l_quantity as score from lineitem join part on p_partkey = l_partkey),
k as (select gene, site from m group by gene, site having not bool_or(not is_case)),
t as (select *, row_number() over (partition by gene, sample_id order by score desc, site) as r from m join k using (gene, site) where is_case),
p as (select gene, sample_id, max(case when r = 1 then score end) as s1, max(case when r = 2 then score end) as s2 from t where r <= 2 group by 1, 2),
g as (select gene, sum(case when s1 >= 20 then s1 * 0.1::double + 1 else 0 end) as score, count(*) as n_cases, sum(coalesce(s2, 0)) as second from p group by gene) """


@register("q as (select 1), " + _MUT + "select gene, round(score, 6) + 0.0 as score, n_cases, second from g")
def gene_priority_score(spark, sf_dir):
    return simulate.gene_scores(_mutations(spark, sf_dir), 20.0, 0.1).select("gene", r("score").alias("score"), "n_cases", "second")


@register("q as (select 1), " + _MUT + "select gene, rank() over (order by round(score, 6) desc) as standing from g")
def gene_standing(spark, sf_dir):
    scores = simulate.gene_scores(_mutations(spark, sf_dir), 20.0, 0.1).select("gene", F.round("score", 6).alias("score"))
    return simulate.standings(scores).select("gene", F.col("standing").cast("long").alias("standing"))


@register("""q as (select l_linenumber as round, p_brand as gene, sum(l_quantity) as score from lineitem join part on p_partkey = l_partkey group by 1, 2), s as (select *, rank() over (partition by round order by score desc) as standing from q),
c as (select distinct p_brand as gene from part where p_size = 10), h as (select round, count(*) filter (where c.gene is not null and standing <= 8) as k from s left join c using (gene) group by round)
select count(*) as n_rounds, count(*) filter (where k >= 3) as n_success, count(*) filter (where k >= 3) / cast(count(*) as double) as power from h""")
def power_summary(spark, sf_dir):
    part = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("gene"), "p_size")
    scores = fx.table(spark, sf_dir, "lineitem").join(part, "l_partkey").groupBy(F.col("l_linenumber").alias("round"), "gene").agg(F.sum("l_quantity").alias("score"))
    return simulate.power(simulate.standings(scores, ["round"]), part.where("p_size = 10").select("gene").distinct(), 8, 3)


@register("""q as (select l_linenumber as round, l_partkey as compound_id, bool_or(l_quantity > 25) as e, bool_or(l_quantity > 25 and l_returnflag = 'A') and bool_or(l_quantity > 25 and l_returnflag = 'R') as b from lineitem group by 1, 2),
r as (select round, bool_or(e) as e, bool_or(b) as b from q group by round) select count(*) as n_rounds, count(*) filter (where e) / cast(count(*) as double) as either, count(*) filter (where b) / cast(count(*) as double) as both from r""")
def paired_power(spark, sf_dir):
    hits = fx.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("round"), F.col("l_partkey").alias("compound_id"), F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2).otherwise(3).alias("part"), (F.col("l_quantity") > 25).alias("hit"))
    return simulate.paired_power(hits)


@register("""q as (select l_shipdate as d, l_linenumber as round, count(*) filter (where l_returnflag = 'A') as controls, count(*) filter (where l_returnflag = 'R') as cases from lineitem group by 1, 2)
select concat(cast(cast(d as date) as varchar), '_', cast(round as varchar)) as round, controls, cases from q where cases > 0 and controls / cast(cases as double) between 0.9 and 1.1""")
def balanced_rounds(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem").select(F.concat_ws("_", F.to_date("l_shipdate").cast("string"), F.col("l_linenumber").cast("string")).alias("round"), F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "R", 1).alias("case"))
    return simulate.balanced_rounds(rows)


@register()
def proximity_clusters(spark, sf_dir):
    hits = lm.with_p(_scanned(spark, sf_dir)).where("pvalue < 0.05")
    return joins.near_best_hits(hits, 50_000)





@register("""q as (select chr, max(pos) as last from calls group by chr),
w as (select chr, s from q, unnest(generate_series(cast(1 as bigint), last - 1, 100000)) as u(s)),
c as (select w.chr, w.s, pos, sample_id, dosage from calls join w on w.chr = calls.chr and pos between s and s + 199999 where dosage is not null)
select a.chr, a.s as "start", a.sample_id as i, b.sample_id as j, round(avg(1 - abs(a.dosage - b.dosage) / 2.0::double), 8) + 0.0 as k, count(*) as n
from c a join c b on a.chr = b.chr and a.s = b.s and a.pos = b.pos and a.sample_id < b.sample_id group by 1, 2, 3, 4""")
def window_ibs(spark, sf_dir):
    return kinship.local_ibs(fx.calls(spark, sf_dir), 200_000).select("chr", "start", "i", "j", r("k", 8).alias("k"), "n")


_HITS = f"""s as (select chr, pos, count(*) as n, regr_r2(y, dosage) as r2, regr_sxx(y, dosage) as sxx from acalls join atrait on ordinal = sample_id group by chr, pos),
t as (select chr, pos, n, r2 / (1 - r2) * (n - 2) as t2 from s where sxx > 0 and r2 < 1), h as (select chr, pos, {_t_p("t2", "n")} as pvalue from t),
w as (select *, row_number() over (partition by chr order by pos) as k from h where pvalue < 0.2),
walk as (with recursive x as (select chr, k, pos, pvalue, 1 as peak from w where k = 1
  union all select w.chr, w.k, case when w.pos - x.pos >= 20000 or w.pvalue < x.pvalue then w.pos else x.pos end, case when w.pos - x.pos >= 20000 or w.pvalue < x.pvalue then w.pvalue else x.pvalue end,
    case when w.pos - x.pos >= 20000 then x.peak + 1 else x.peak end from x join w on w.chr = x.chr and w.k = x.k + 1) select * from x),
peaks as (select chr, arg_max(pos, k) as pos, arg_max(pvalue, k) as pvalue from walk group by chr, peak)"""


def _peaks(spark, sf_dir):
    calls = fx.array_calls(spark, sf_dir).join(F.broadcast(fx.array_trait(spark, sf_dir)), F.col("ordinal") == F.col("sample_id"))  # the sample axis
    return joins.peaks(lm.with_p(lm.scan(calls)).where("pvalue < 0.2"), 20_000)


@register("q as (select 1)," + _HITS + "select chr, pos, round(pvalue, 6) as pvalue from peaks")
def scan_peaks(spark, sf_dir):
    return _peaks(spark, sf_dir).select("chr", "pos", r("pvalue").alias("pvalue"))


@register("q as (select 1)," + _HITS + "," + _RRM.format(c="acalls") + """select concat(p.chr, ':', p.pos) as region_id, a.sample_id as i, b.sample_id as j, round(avg(a.z * b.z), 6) + 0.0 as k from z a join z b on a.chr = b.chr and a.pos = b.pos
join peaks p on p.chr = a.chr and a.pos between p.pos and p.pos + 15000 group by 1, 2, 3""")
def peak_kinships(spark, sf_dir):
    regions = joins.peak_regions(_peaks(spark, sf_dir), 15_000)
    tiles = kinship.regional_tiles(fx.variants(spark, sf_dir), regions)
    return kinship.tile_cells(tiles, ("region_id",)).select("region_id", "i", "j", r("k").alias("k"))


# two stores, written and read: the second packed, of other samples in another order; kinships of those that both and the trait have
@register("""q as (select cast(sample_id as varchar) as s, chr, pos, dosage from acalls where sample_id % 5 <> 1 and sample_id % 3 <> 0),
a as (select 'first' as store, chr, pos, s, dosage from q where chr <= 5 union all select 'second', chr, pos, s, dosage from q where chr > 5)
select x.store, x.s as i, y.s as j, round(avg(1 - abs(x.dosage - y.dosage) / 2.0::double), 8) + 0.0 as k from a x join a y on x.store = y.store and x.chr = y.chr and x.pos = y.pos group by 1, 2, 3""")
def two_stores_matched(spark, sf_dir):
    v, trait = fx.variants(spark, sf_dir), fx.array_trait(spark, sf_dir)
    n = trait.count()
    names, path = [str(i) for i in range(n)], scratch.folder(spark, "stores")
    genotypes.write_store(v.where("chr <= 5"), names, f"{path}/first")
    turned = [s for s in reversed(names) if int(s) % 3]
    genotypes.write_packed(genotypes.subset(v.where("chr > 5"), names, turned), turned, f"{path}/second")
    known = trait.where("ordinal % 5 <> 1").select(F.col("ordinal").cast("string").alias("sample_id"), "y")
    first, second, samples = genotypes.aligned(genotypes.read_store(spark, f"{path}/first"), genotypes.read_store(spark, f"{path}/second"), known)
    cells = [kinship.tile_cells(kinship.gram_tiles(x, "ibs")).withColumn("store", F.lit(name)) for name, x in (("first", first), ("second", second))]
    ids = F.broadcast(samples.select("ordinal", "sample_id"))  # the sample axis
    out = cells[0].unionByName(cells[1])
    for side in ("i", "j"):
        out = out.join(ids.withColumnsRenamed({"ordinal": side, "sample_id": f"{side}_id"}), side)
    return out.select("store", F.col("i_id").alias("i"), F.col("j_id").alias("j"), r("k", 8).alias("k"))


# slices of all gene models, written as text by gene, subset of origins and kind, and read back
_SLICES = """m as (select concat('G', cast(vec_id // 25 as varchar)) as gene, label + 1 as chr, vec_id * 1000 + 1 as pos, case when vec_id % 4 < 3 then concat('rs', cast(vec_id as varchar)) else concat('rs_', cast(vec_id * 1000 + 1 as varchar)) end as rsid,
  cast(vec_id % 8 as double) / 8 as weight, vec_id % 3 as o from embeddings union all select 'G0', 99, 5, 'rs_5', 0.0, 0),
n as (select gene, 'EN' as subset, chr, pos, rsid, weight from m where o = 0 union all select gene, 'eQTL', chr, pos, rsid, weight from m where o = 1 union all select gene, 'both', chr, pos, rsid, weight from m where o < 2)"""


def _slices(spark, sf_dir):
    k = F.col("vec_id")
    rows = fx.table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("G"), F.floor(k / 25).cast("string")).alias("gene"), (F.col("label") + 1).cast("int").alias("chr"), (k * 1000 + 1).cast("long").alias("pos"),
        F.when(k % 4 < 3, F.concat(F.lit("rs"), k.cast("string"))).alias("rsid"), ((k % 8).cast("double") / 8).alias("weight"), F.get(F.array(F.lit("EN"), F.lit("eQTL"), F.lit("NULL")), (k % 3).cast("int")).alias("origin"))
    absent = spark.createDataFrame([("G0", 99, 5, None, None, "EN")], rows.schema)
    path = scratch.folder(spark, "slices")
    return path, genotypes.write_slices(fx.variants(spark, sf_dir), rows.unionByName(absent), path, {"EN": ["EN"], "eQTL": ["eQTL"], "both": ["EN", "eQTL"]})


@register("q as (select 1)," + _SLICES + """, g as (select chr, pos, string_agg(case dosage when 0 then 'A A' when 1 then 'A T' else 'T T' end, ' ' order by sample_id) as g from acalls group by chr, pos)
select gene, subset, kind, case kind when 'tped' then concat_ws(' ', chr, rsid, '0', pos, g) when 'setid' then concat(gene, chr(9), rsid) else concat(rsid, chr(9), cast(weight as varchar)) end as value from n join g using (chr, pos), unnest(['tped', 'setid', 'weights']) as u(kind)""")
def model_slices(spark, sf_dir):
    return genotypes.read_slices(spark, _slices(spark, sf_dir)[0])


@register("q as (select 1)," + _SLICES + "select gene, subset, count(*) as n_sites, count(*) filter (where chr <> 99) as n_found from n group by 1, 2")
def model_manifest(spark, sf_dir):
    return _slices(spark, sf_dir)[1]


@register()
def emmax_forward(spark, sf_dir):
    v = fx.variants(spark, sf_dir)
    return mixed.forward_mixed(v, _array_trait(spark, sf_dir), kinship.gram(v), 3)


@register()
def low_rank_scan(spark, sf_dir):
    return mixed.low_rank_scan(fx.variants(spark, sf_dir), _array_trait(spark, sf_dir), _marker_terms(spark, sf_dir))


@register()
def local_alpha_grid(spark, sf_dir):
    v = fx.variants(spark, sf_dir)
    windows = variants.in_tiling_windows(v, 120_000)
    return mixed.local_grid(windows, _array_trait(spark, sf_dir), kinship.gram(v), ["chr", "start"], 0.2)


@register()
def emmax_permutation(spark, sf_dir):
    v = fx.variants(spark, sf_dir)
    return mixed.permutation_p_mixed(v, _array_trait(spark, sf_dir), kinship.gram(v), 200)


@register()
def trait_transform(spark, sf_dir):
    return stats.best_transform(fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", "transform", r("transformed", 4).alias("transformed"))


@register("""q as (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders)
select cast(least(9, floor((o_totalprice - lo) / ((hi - lo) / 10))) as bigint) as bin, count(*) as n from orders, q group by 1""")
def price_histogram(spark, sf_dir):
    return stats.histogram(fx.table(spark, sf_dir, "orders"), "o_totalprice", 10).select("bin", "n")


@register("""q as (select chr, pos, row_number() over (partition by chr order by pos) - 1 as k, count(*) over (partition by chr) as n from (select distinct chr, pos from calls))
select chr, pos from q where k % greatest(1, n // 10) = 0 and k // greatest(1, n // 10) < 10""")
def evenly_spaced(spark, sf_dir):
    return simulate.evenly_spaced(fx.calls(spark, sf_dir).select("chr", "pos").distinct(), 10).select("chr", "pos")


@register("select gene, chr, pos, weight from models order by abs(weight) desc, chr, pos limit 15")
def top_effects(spark, sf_dir):
    return simulate.top_effects(fx.models(spark, sf_dir), 15).select("gene", "chr", "pos", "weight")


@register()
def drawn_study(spark, sf_dir):
    people = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.floor(F.col("c_custkey") / 3).alias("family"))
    carriers = fx.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id"))
    return simulate.draw_study(people, carriers, 0.02, 0.6, 50, 50, 5, 9)
