"""Simulated traits over calls, and the scoring of simulated studies.

Every random draw is a hash of a seed and the row's keys, so runs agree and tasks
need no shared state.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut
from .stats import running_before


def uniform(seed: int, *keys) -> Column:
    """Uniform in (0, 1) from a seed and columns."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def normal(seed: int, *keys) -> Column:
    return F.sqrt(-2 * F.log(uniform(seed, *keys))) * F.cos(2 * math.pi * uniform(seed + 1, *keys))


def _site(calls: DataFrame, site: tuple[int, int], name: str) -> DataFrame:
    return calls.where((F.col("chr") == site[0]) & (F.col("pos") == site[1]) & F.col("dosage").isNotNull()).select("sample_id", F.col("dosage").alias(name))


def two_variant(calls: DataFrame, a: tuple[int, int], b: tuple[int, int], kind: str) -> DataFrame:
    """sample_id, value (0 or 1): and, or, xor of carrying the allele of two variants."""
    rows = _site(calls, a, "x").join(_site(calls, b, "y"), "sample_id")
    x, y = F.col("x") > 0, F.col("y") > 0
    value = {"and": x & y, "or": x | y, "xor": x != y}[kind]
    return rows.select("sample_id", value.cast("double").alias("value"))


def exact_sum(x: Column) -> Column:
    """Sum that does not depend on the order of rows: parts of 2^-20 and what is left of them are
    added up apart, each without rounding while sums of the first stay below 2^33."""
    coarse = F.rint(x * float(1 << 20)) / float(1 << 20)
    return F.sum(coarse) + F.sum(x - coarse)


def additive(calls: DataFrame, effects: DataFrame) -> DataFrame:
    """sample_id, value: sum of dosage times effect over variants with one; missing calls add nothing.

    Effects of both signs may cancel to the last bit, so the sum is that of ``exact_sum``."""
    rows = calls.join(effects.select("chr", "pos", "effect"), ["chr", "pos"])
    return rows.groupBy("sample_id").agg(exact_sum(F.coalesce("dosage", F.lit(0.0)) * F.col("effect")).alias("value"))


def two_origins(calls: DataFrame, effects: DataFrame, ratio: float) -> DataFrame:
    """sample_id, value: effects of origin EN, plus those of origin eQTL scaled so that EN
    has the share ``ratio`` of the variance."""
    rows = calls.join(effects, ["chr", "pos"]).where(F.col("origin").isin("EN", "eQTL"))
    part = lambda o: F.sum(F.when(F.col("origin") == o, F.coalesce("dosage", F.lit(0.0)) * F.col("effect")).otherwise(0.0))
    sums = rows.groupBy("sample_id").agg(part("EN").alias("en"), part("eQTL").alias("eq"))
    v = sums.agg(F.var_pop("en").alias("ve"), F.var_pop("eq").alias("vq"))
    scale = F.when(F.col("vq") > 0, F.sqrt(F.col("ve") / F.col("vq")) * math.sqrt((1 - ratio) / ratio)).otherwise(0.0)
    return sums.join(F.broadcast(v)).select("sample_id", (F.col("en") + scale * F.col("eq")).alias("value"))  # one row


def with_noise(values: DataFrame, h2: float, seed: int) -> DataFrame:
    """Adds y = value + noise so that value has the share ``h2`` of the variance."""
    v = values.agg(F.sqrt(F.var_pop("value") * (1 - h2) / h2).alias("_sd"))
    return values.join(F.broadcast(v)).withColumn("y", F.col("value") + F.col("_sd") * normal(seed, "sample_id")).drop("_sd")  # one row


def liability(values: DataFrame) -> DataFrame:
    """Adds case: 1 where value is above 0, else 0."""
    return values.withColumn("case", (F.col("value") > 0).cast("int"))


def heterogeneity(calls: DataFrame, effects: DataFrame, least: int) -> DataFrame:
    """sample_id, case: carries at least ``least`` alleles over the causal variants."""
    rows = calls.join(effects.select("chr", "pos"), ["chr", "pos"])
    return rows.groupBy("sample_id").agg((F.sum(F.coalesce("dosage", F.lit(0.0))) >= least).cast("int").alias("case"))


def region_capped(calls: DataFrame, regions: DataFrame, cap: int = 2) -> DataFrame:
    """sample_id, value: alleles carried in each region, at most ``cap``, summed over regions."""
    from .joins import in_regions

    per = in_regions(calls.where("dosage is not null"), regions).groupBy("region_id", "sample_id").agg(F.least(F.lit(float(cap)), F.sum("dosage")).alias("v"))
    return per.groupBy("sample_id").agg(F.sum("v").alias("value"))


def compound(calls: DataFrame, parts: DataFrame, kind: str, cap: int = 2) -> DataFrame:
    """compound_id, sample_id, value of two-part compounds: add (sum), hetero (1 if either part
    is hit), both (1 if both are), compensate (1 if just one is)."""
    from .joins import in_regions

    key = parts.withColumn("region_id", F.concat_ws("|", "compound_id", F.col("part").cast("string")))
    hit = in_regions(calls.where("dosage is not null"), key).groupBy("region_id", "sample_id").agg(F.least(F.lit(float(cap)), F.sum("dosage")).alias("v"))
    hit = hit.join(key.select("region_id", "compound_id", "part"), "region_id")
    one = lambda i: F.coalesce(F.max(F.when(F.col("part") == i, F.col("v"))), F.lit(0.0))
    two = hit.groupBy("compound_id", "sample_id").agg(one(1).alias("a"), one(2).alias("b"))
    a, b = F.col("a") > 0, F.col("b") > 0
    value = {"add": F.col("a") + F.col("b"), "hetero": (a | b).cast("double"), "both": (a & b).cast("double"), "compensate": (a != b).cast("double")}[kind]
    return two.select("compound_id", "sample_id", value.alias("value"))


def epistasis(calls: DataFrame, sites: DataFrame, kind: str) -> DataFrame:
    """sample_id, value over four variants; the one with the highest frequency controls.

    canalization: carriers of the controller have 0, others the sum of the rest.
    sign: the rest count negative in carriers.  compensation: the absolute difference of
    the controller and the rest."""
    rows = calls.where("dosage is not null").join(sites.select("chr", "pos"), ["chr", "pos"])
    freq = rows.groupBy("chr", "pos").agg(F.avg("dosage").alias("f"))
    lead = freq.agg(F.max_by(F.struct("chr", "pos"), F.struct("f", -F.col("chr"), -F.col("pos"))).alias("x")).select(F.col("x.chr").alias("c"), F.col("x.pos").alias("p"))
    own = rows.join(F.broadcast(lead)).withColumn("leads", (F.col("chr") == F.col("c")) & (F.col("pos") == F.col("p")))  # one row
    s = own.groupBy("sample_id").agg(F.sum(F.when(F.col("leads"), F.col("dosage")).otherwise(0.0)).alias("l"), F.sum(F.when(~F.col("leads"), F.col("dosage")).otherwise(0.0)).alias("r"))
    value = {"canalization": F.when(F.col("l") > 0, 0.0).otherwise(F.col("r")), "sign": F.when(F.col("l") > 0, -F.col("r")).otherwise(F.col("r")), "compensation": F.abs(F.col("l") - F.col("r"))}[kind]
    return s.select("sample_id", value.alias("value"))


def with_background(values: DataFrame, background: DataFrame, share: float) -> DataFrame:
    """sample_id, value: sqrt(share) of the unit-variance value and sqrt(1 - share) of the background."""
    rows = values.join(background.select("sample_id", F.col("value").alias("b")), "sample_id")
    m = rows.agg(F.stddev_pop("value").alias("sv"), F.stddev_pop("b").alias("sb"))
    own = F.coalesce(F.col("value") / F.nullif(F.col("sv"), F.lit(0.0)), F.lit(0.0)) * math.sqrt(share)
    rest = F.coalesce(F.col("b") / F.nullif(F.col("sb"), F.lit(0.0)), F.lit(0.0)) * math.sqrt(1 - share)
    return rows.join(F.broadcast(m)).select("sample_id", (own + rest).alias("value"))  # one row


def pick(sites: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` sites in the order of a hash."""
    return sites.orderBy(F.xxhash64(F.lit(seed), "chr", "pos"), "chr", "pos").limit(n)


def balanced_rounds(rows: DataFrame, low: float = 0.9, high: float = 1.1) -> DataFrame:
    """Rounds whose controls over cases lie in [low, high]: round, controls, cases."""
    n = rows.groupBy("round").agg(F.count_if(F.col("case") == 0).alias("controls"), F.count_if(F.col("case") == 1).alias("cases"))
    return n.where((F.col("cases") > 0) & (F.col("controls") / F.col("cases")).between(low, high))


# Prioritisation of genes in rare-disease studies.


def gene_scores(mutations: DataFrame, least: float, weight: float) -> DataFrame:
    """gene, score, n_cases from (gene, sample_id, is_case, site, score) rows: variants seen
    in controls do not count; a case's best remaining score counts score * weight + 1
    if it is at least ``least``.  second: the sum of the cases' second-best scores."""
    # a site seen in any control is out; decided by one aggregation a site
    seen = mutations.groupBy("gene", "site").agg(F.max(F.when(~F.col("is_case"), 1).otherwise(0)).alias("in_control"))
    own = mutations.where("is_case").join(seen.where("in_control = 0").select("gene", "site"), ["gene", "site"])
    turn = Window.partitionBy("gene", "sample_id").orderBy(F.desc("score"), "site")
    top = own.withColumn("r", F.row_number().over(turn)).where("r <= 2")
    per = top.groupBy("gene", "sample_id").agg(F.max(F.when(F.col("r") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("r") == 2, F.col("score"))).alias("s2"))
    return per.groupBy("gene").agg(F.sum(F.when(F.col("s1") >= least, F.col("s1") * weight + 1).otherwise(0.0)).alias("score"), F.count("*").alias("n_cases"), F.sum(F.coalesce("s2", F.lit(0.0))).alias("second"))


def standings(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds standing: 1 + number of genes with a larger score (within ``by``).

    The order is over the table of distinct scores.  Without ``by`` that is read several times, so
    scores are computed once, to the shared folder."""
    keys = by or []
    scores = scores if keys else cut(scores)
    counts = scores.groupBy(*keys, "score").agg(F.count("*").alias("_n"))
    if keys:
        order = Window.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("standing", F.coalesce(F.sum("_n").over(order), F.lit(0)) + 1).drop("_n")
    else:
        counts = running_before(counts.withColumn("_v", -F.col("score")), "_v", "_n", "_b").withColumn("standing", F.col("_b") + 1).drop("_n", "_v", "_b")
    return scores.join(counts, [*keys, "score"])


def power(standing: DataFrame, causal: DataFrame, top: int, least: int) -> DataFrame:
    """n_rounds, n_success, power: share of rounds with at least ``least`` causal genes among
    the first ``top``."""
    hit = standing.join(causal.select("gene", F.lit(True).alias("causal")), "gene", "left")
    rounds = hit.groupBy("round").agg(F.count_if(F.coalesce("causal", F.lit(False)) & (F.col("standing") <= top)).alias("k"))
    ok = F.count_if(F.col("k") >= least)
    return rounds.agg(F.count("*").alias("n_rounds"), ok.alias("n_success"), (ok / F.count("*")).alias("power"))


def causal_hits(results: DataFrame, causal: DataFrame, width: int) -> DataFrame:
    """Results whose window [pos, pos + width] holds a causal position of the chromosome."""
    own = causal.select(F.col("chr").alias("c"), F.col("pos").alias("p"), F.floor(F.col("pos") / max(1, width)).alias("k")).distinct()
    rows = results.withColumn("k", F.explode(F.array(F.floor(F.col("pos") / max(1, width)), F.floor(F.col("pos") / max(1, width)) + 1)))
    on = (rows["chr"] == own["c"]) & (rows["k"] == own["k"]) & own["p"].between(rows["pos"], rows["pos"] + width)
    return rows.join(own, on, "left_semi").drop("k").distinct()


def paired_power(hits: DataFrame) -> DataFrame:
    """n_rounds, either, both from (round, compound_id, part, hit): shares of rounds in which
    one part, or both parts, of some compound were found."""
    per = hits.groupBy("round", "compound_id").agg(F.bool_or("hit").alias("e"), (F.bool_or(F.col("hit") & (F.col("part") == 1)) & F.bool_or(F.col("hit") & (F.col("part") == 2))).alias("b"))
    rounds = per.groupBy("round").agg(F.bool_or("e").alias("e"), F.bool_or("b").alias("b"))
    return rounds.agg(F.count("*").alias("n_rounds"), (F.count_if("e") / F.count("*")).alias("either"), (F.count_if("b") / F.count("*")).alias("both"))


def effects(sites: DataFrame, kind: str, seed: int, decay: float = 0.95) -> DataFrame:
    """chr, pos, effect of causal sites: normal (infinitesimal), decay (powers in the order of
    a hash), signed (decay with a random sign)."""
    if kind == "normal":
        return sites.select("chr", "pos", normal(seed, "chr", "pos").alias("effect"))
    turn = Window.partitionBy(F.lit(0)).orderBy(F.xxhash64(F.lit(seed), "chr", "pos"), "chr", "pos")  # the causal sites
    size = F.pow(F.lit(decay), F.row_number().over(turn) - 1)
    sign = F.when(uniform(seed + 7, "chr", "pos") < 0.5, -1.0).otherwise(1.0) if kind == "signed" else F.lit(1.0)
    return sites.select("chr", "pos", (size * sign).alias("effect"))


def top_effects(models: DataFrame, n: int) -> DataFrame:
    """The ``n`` variants with the largest absolute weight."""
    return models.orderBy(F.desc(F.abs("weight")), "chr", "pos").limit(n)


def evenly_spaced(sites: DataFrame, n: int) -> DataFrame:
    """``n`` sites of each chromosome, evenly spread in order of position."""
    order = Window.partitionBy("chr").orderBy("pos")
    count = sites.groupBy("chr").agg(F.count("*").alias("_n"))
    rows = sites.withColumn("_k", F.row_number().over(order) - 1).join(count, "chr")
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / n))
    return rows.where((F.col("_k") % step == 0) & (F.col("_k") / step < n)).drop("_k", "_n")


def draw_study(people: DataFrame, carriers: DataFrame, prevalence: float, penetrance: float, cases: int, controls: int, rounds: int, seed: int) -> DataFrame:
    """round, id, is_case: a case-control draw of each round.

    ``people``: id, family; ``carriers``: id of those who carry a causal mutation.  A
    carrier is ill with ``penetrance``, others with ``prevalence``; one person a family
    is drawn, in the order of a hash, until there are enough of either kind."""
    own = people.join(carriers.select("id", F.lit(True).alias("carries")).distinct(), "id", "left")
    tries = own.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    risk = F.when(F.col("carries"), penetrance).otherwise(prevalence)
    tries = tries.withColumn("is_case", uniform(seed, "round", "id") < risk)
    first = tries.groupBy("round", "family").agg(F.min_by(F.struct("id", "is_case"), F.xxhash64(F.lit(seed + 3), "round", "id")).alias("x")).select("round", "x.id", "x.is_case")
    turn = Window.partitionBy("round", "is_case").orderBy(F.xxhash64(F.lit(seed + 5), "round", "id"), "id")
    wanted = F.when(F.col("is_case"), cases).otherwise(controls)
    return first.withColumn("k", F.row_number().over(turn)).where(F.col("k") <= wanted).drop("k")
