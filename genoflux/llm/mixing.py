"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the expected number of copies of each of its
documents.  Whole copies are sure; the fractions are rounded so that a source's
taken words keep to its target: two documents with fractional probabilities
exchange mass, in words, in a random direction until one of them is 0 or 1.
Chunks of documents are folded that way, what is left of each chunk goes up a
tree of the same shape.  Chunks are folded from the longest document down, so that
what stays open at the top is short; it goes to the nearer side, which keeps a
source within half of that document of its target.  All of it is DataFrame
expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
_SPARE = 1e-9


def words_in(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, n_docs, target from rows of source and size.

    Sources in order of code points, null last, weigh 5, 2, 1 and so on.  Targets
    share the sum of all sizes by weight; those that would be above three times
    their source stop there and the excess is shared again.  That is the level at
    which the sum of min(3 * size, level * weight) equals the total: sources in
    order of 3 * size / weight are full up to one, and the rest share what is
    left.  The windows run over one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    per = per.withColumn("place", rank).withColumn("weight", F.element_at(weights, (F.col("place") % len(WEIGHTS) + 1).cast("int")))
    full = MOST_COPIES * F.col("source_size").cast("double")
    per = per.withColumn("full", full).withColumn("turn", F.col("full") / F.col("weight"))
    up = Window.orderBy("turn", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("total", F.sum("source_size").over(every)).withColumn("all_weight", F.sum("weight").over(every))
    before = F.sum("full").over(up) - F.col("full")
    left = F.col("all_weight") - (F.sum("weight").over(up) - F.col("weight"))
    per = per.withColumn("level", (F.col("total") - before) / left)
    open_level = F.min(F.when(F.col("level") <= F.col("turn"), F.struct("turn", "place", "level"))).over(every)["level"]
    per = per.withColumn("open", open_level)
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least("full", F.col("open") * F.col("weight")))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def _fold(items: Column, seed: int, level: int) -> Column:
    """Folds a chunk: struct of done (documents with 0 or 1) and open (at most one).

    ``open`` and ``x`` have probability p and size s; with words as mass, moving
    d words raises one p by d / s and lowers the other by d / s.  The chance of
    each direction is such that expectations stay.
    """
    kind = "struct<id:struct<source:string,doc_id:bigint,row:bigint>,s:double,p:double>"
    start = F.struct(F.lit(None).cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("open"))
    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), start["open"].alias("open"))

    def settled(x, p):
        return F.struct(x["id"].alias("id"), x["s"].alias("s"), p.alias("p"))

    def step(state, x):
        a = state["open"]
        u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(level), a["id"], x["id"]), F.lit(1 << 30)) + 0.5) / float(1 << 30)
        up = F.least((1 - a["p"]) * a["s"], x["p"] * x["s"])  # words that a can gain
        down = F.least(a["p"] * a["s"], (1 - x["p"]) * x["s"])  # words that a can lose
        gain = F.when(u * (up + down) < down, up).otherwise(-down)
        pa = a["p"] + gain / a["s"]
        px = x["p"] - gain / x["s"]
        near = lambda p: F.when(p < _SPARE, 0.0).when(p > 1 - _SPARE, 1.0).otherwise(p)
        pa, px = near(pa), near(px)
        done_a, done_x = (pa == 0) | (pa == 1), (px == 0) | (px == 1)
        none = F.array().cast(f"array<{kind}>")
        more = F.concat(F.when(done_a, F.array(settled(a, pa))).otherwise(none), F.when(done_x, F.array(settled(x, px))).otherwise(none))
        left = F.when(~done_a, settled(a, pa)).when(~done_x, settled(x, px))
        paired = F.struct(F.concat(state["done"], more).alias("done"), left.cast(kind).alias("open"))
        return F.when(a.isNull(), F.struct(state["done"].alias("done"), x.cast(kind).alias("open"))).otherwise(paired)

    return F.aggregate(items, start, step)


def pivotal_rounding(rows: DataFrame, seed: int = 17, fan: int = 128) -> DataFrame:
    """id, s, p of ``rows`` (id: struct of source, doc_id, row; s: size above 0; 0 < p < 1)
    with every p rounded to 0.0 or 1.0.

    A level deals the documents of each source into chunks of about ``fan`` by a
    hash, so a source of any size is spread; what each chunk leaves open is the
    next level's input.  The levels number log(rows) / log(fan).
    """
    rounded, level = None, 0
    rows = rows.withColumn("source", F.col("id.source"))
    while True:
        counts = rows.groupBy("source").agg(F.count("*").alias("n"))
        largest = counts.agg(F.max("n")).first()[0]
        if not largest:
            return rounded if rounded is not None else rows.select("id", "s", "p")
        chunks = F.greatest(F.lit(1), F.ceil(F.col("n") / fan))
        dealt = rows.join(counts.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own")))
        dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed + level), "id"), chunks.cast("long")))
        lists = dealt.groupBy("source", "chunk").agg(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("longest"), F.xxhash64(F.lit(seed), "id").alias("turn"), "id", "s", "p"))).alias("list"))
        items = F.transform("list", lambda x: F.struct(x["id"].alias("id"), x["s"].alias("s"), x["p"].alias("p")))
        folded = cut(lists.select("source", _fold(items, seed, level).alias("f")))
        done = folded.select(F.explode("f.done").alias("x")).select("x.id", "x.s", "x.p")
        rounded = done if rounded is None else rounded.unionByName(done)
        rows = folded.where("f.open is not null").select("source", "f.open.id", "f.open.s", "f.open.p")
        if largest <= fan:  # one chunk a source: what it leaves open goes to the nearer side
            last = rows.select("id", "s", F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0).alias("p"))
            return rounded.unionByName(last)
        level += 1


def copies(docs: DataFrame, seed: int = 17, carry: str | None = None) -> DataFrame:
    """doc_id, source, row, size, source_size, target, copies of each row of ``docs``, and
    ``carried``, its column ``carry``, if one is named.

    Null texts have size 0; documents of size 0 and sources of size 0 get no
    copies.  ``row`` numbers rows that share source, doc_id and size, so repeated
    rows are rounded on their own.  Only doc_id, source and text are read.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_in(F.col("text")).alias("size"), *([] if carry is None else [F.col(carry).alias("carried")]))
    same = Window.partitionBy("doc_id", "source", "size").orderBy(F.lit(0))
    sized = cut(sized.withColumn("row", F.row_number().over(same).cast("long")))
    targets = cut(source_targets(sized))
    rows = sized.join(targets.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own"))).drop("own", "n_docs")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    ratio = F.when(F.abs(ratio - F.round(ratio)) < _SPARE, F.round(ratio)).otherwise(ratio)
    rows = rows.withColumn("whole", F.floor(ratio)).withColumn("part", ratio - F.floor(ratio))
    open_rows = rows.where("part > 0 and size > 0").select(F.struct("source", "doc_id", "row").alias("id"), F.col("size").cast("double").alias("s"), F.col("part").alias("p"))
    rounded = pivotal_rounding(open_rows, seed).where("p = 1.0").select(F.col("id.source").alias("r_source"), F.col("id.doc_id").alias("r_doc"), F.col("id.row").alias("r_row"), F.col("s").cast("long").alias("r_size"))
    on = F.col("doc_id").eqNullSafe(F.col("r_doc")) & F.col("source").eqNullSafe(F.col("r_source")) & (F.col("row") == F.col("r_row")) & (F.col("size") == F.col("r_size"))
    joined = rows.join(rounded, on, "left")
    count = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("whole") + F.col("r_row").isNotNull().cast("long"))
    return joined.select("doc_id", "source", "row", "size", "source_size", "target", count.cast("long").alias("copies"), *([] if carry is None else ["carried"]))
