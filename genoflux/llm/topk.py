"""Exact top-k inner products by pivot-table elimination.

An inner product is a distance in disguise: 2 q.x = |q|^2 + |x|^2 - |q - x|^2.  A
table holds the distances of the candidates to many pivots, so |d(q, p) - d(x, p)|
bounds |q - x| from below for every pivot p, and the largest of these bounds gives
the smallest upper bound on q.x.  It is used twice, each time against the k-th best
score known so far:

* between blocks: candidates are dealt into blocks by their nearest pivot.  A
  query's first floor is its k-th score among a bounded sample; it is only sent to
  the blocks whose intervals of distances leave room above the floor;
* within a block: rings of candidates with like distances are taken in the order of
  their bounds, and a query leaves a ring whose bound its k-th score beats.

Scores are exact integers, bounds have a margin for rounding, so nothing is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shares

_RING = 128
#: Blocks at most, so that the table of their intervals can be broadcast; beyond, blocks grow.
MOST_BLOCKS = 16_384
_LONG = (-(1 << 63), (1 << 63) - 1)
_PLACED = "rid long, vec_id long, v array<double>, is_query boolean, dim int, cell int"
_ROUTED = "rid long, vec_id long, v array<double>, dim int, c long, floor double"
_OUT = "rid long, query_id long, vec_id long, score long"


def whole_vectors(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component, whole numbers held as doubles;
    vectors that are null or hold null or non-finite components, and rows without
    vec_id, are left out."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null")
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    # numbers from 2 ** 53 on have no fraction left
    whole = F.transform("x", lambda c: F.when(F.abs(c * scale) < 2.0**53, F.floor(c * scale).cast("double")).otherwise(c * scale))
    return rows.where(fine).select("vec_id", whole.alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(n, len(flat) // max(n, 1))


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of each vector to each pivot."""
    squares = (vectors * vectors).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * (vectors @ pivots.T)
    return np.sqrt(np.maximum(squares, 0))


def upper_bounds(queries: np.ndarray, to: np.ndarray, low: np.ndarray, high: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Upper bounds on the inner product of each query with what lies in each group.

    ``to``: distances of the queries to the pivots; ``low``, ``high``: the groups'
    intervals of such distances, a row a group; ``top``: the largest square norm."""
    least = np.zeros((len(queries), len(low)))
    for j in range(to.shape[1]):
        d = to[:, j, None]
        np.maximum(least, low[:, j] - d, out=least)
        np.maximum(least, d - high[:, j], out=least)
    both = (queries * queries).sum(1)[:, None] + top
    # sums below 2 ** 53 are exact; beyond, a distance near 0 is off by the root of its rounding
    slack = np.where(both < 2.0**50, 1e-9, 1e-6)
    bounds = (both - least * least) / 2 + both * slack + 1e-6
    return np.where(np.isnan(bounds), np.inf, bounds)  # squares beyond a double bound nothing


def exact_scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exact; the nearest long where they exceed it."""

    def whole(x):
        return np.array([int(v) for v in x.ravel().tolist()], object).reshape(x.shape)

    sums = (whole(left) * whole(right)).sum(1) if left.shape[1] else [0] * len(left)
    return np.array([min(max(int(s), _LONG[0]), _LONG[1]) for s in sums], np.int64)


def best_of(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int, n: int):
    """Indexes of the k best of each query, in order; ties go to the smaller id.  And the
    k-th score of each of ``n`` queries, the lowest number where there are fewer."""
    # a long has no negative of its lowest value, but all have a complement
    order = np.lexsort((ids, ~scores, query))
    q = query[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    floor = np.full(n, -np.inf)
    last = order[place == k - 1]
    floor[query[last]] = np.where(scores[last] == _LONG[0], -np.inf, scores[last])
    return order[place < k], floor


class Rings:
    """A block's candidates in rings of like distances to the pivots."""

    def __init__(self, rids: np.ndarray, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray):
        table = distances(vectors, pivots)
        order = np.argsort(table[:, table.sum(0).argmin()] if table.size else np.zeros(len(ids)), kind="stable")
        self.rids, self.ids, self.vectors, table, self.pivots = rids[order], ids[order], vectors[order], table[order], pivots
        self.squares = (self.vectors * self.vectors).sum(1)
        self.cuts = np.arange(0, len(ids), _RING)
        self.low, self.high = np.minimum.reduceat(table, self.cuts), np.maximum.reduceat(table, self.cuts)
        self.top = np.maximum.reduceat(self.squares, self.cuts)

    def search(self, rids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int):
        """Numbers of queries, candidate ids and scores of the k best of each query that
        reach its floor."""
        n, self.evaluated = len(queries), 0
        bounds = upper_bounds(queries, distances(queries, self.pivots), self.low, self.high, self.top)
        norms = np.sqrt((queries * queries).sum(1))
        floors = floors.copy()
        found = [np.zeros(0, np.int64)] * 3
        held, waiting = [], 0
        for r in np.argsort(-bounds.max(0), kind="stable").tolist():
            alive = np.flatnonzero(bounds[:, r] >= floors)  # an equal score may still win its tie
            if not len(alive):
                continue
            a, b = int(self.cuts[r]), min(int(self.cuts[r]) + _RING, len(self.ids))
            self.evaluated += len(alive) * (b - a)
            scores = queries[alive] @ self.vectors[a:b].T
            reach = norms[alive] * np.sqrt(self.top[r])
            sure = reach < 2.0**53
            slack = np.where(sure, 0, reach * 1e-9)
            hit = ~(scores < (floors[alive] - slack)[:, None]) & (rids[alive][:, None] != self.rids[a:b])
            i, j = np.nonzero(hit)
            own = np.zeros(len(i), np.int64)
            exact = sure[i]
            own[exact] = np.rint(scores[i[exact], j[exact]]).astype(np.int64)
            if not exact.all():
                far = ~exact
                own[far] = exact_scores(queries[alive[i[far]]], self.vectors[a + j[far]])
            held.append((alive[i], self.ids[a + j], own))
            waiting += len(i)
            if waiting > 4 * k * n or len(held) == 1 and not len(found[0]):
                found, floors, held, waiting = *self._merge(found, held, floors, k, n), [], 0
        return self._merge(found, held, floors, k, n)[0]

    @staticmethod
    def _merge(found, held, floors, k, n):
        q, ids, scores = (np.concatenate(x) for x in zip(found, *held, strict=True))
        best, own = best_of(q, ids, scores, k, n)
        return [q[best], ids[best], scores[best]], np.maximum(floors, own)


def choose_pivots(found: np.ndarray, n: int) -> np.ndarray:
    """Far-apart rows of a sample, one after another."""
    if not len(found):
        return found
    chosen, gap = [0], np.full(len(found), np.inf)
    while len(chosen) < min(n, len(found)):
        gap = np.minimum(gap, ((found - found[chosen[-1]]) ** 2).sum(1))
        if not gap.max():
            break
        chosen.append(int(gap.argmax()))
    return found[chosen]


def _sample(rows: DataFrame, dim: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and vectors of a bounded sample of rows of one length, by smallest hash."""
    own = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("rid"), "rid").limit(most).select("rid", "v").collect()
    return np.array([r["rid"] for r in own], np.int64), np.array([r["v"] for r in own], float).reshape(len(own), dim)


def _first_floors(rids, queries, sample_ids, sample, k: int) -> np.ndarray:
    """The k-th score of each query in the sample, lowered by the rounding."""
    floors = np.full(len(queries), -np.inf)
    if len(sample) <= k:
        return floors
    for a in range(0, len(queries), 256):
        scores = queries[a : a + 256] @ sample.T
        scores[rids[a : a + 256][:, None] == sample_ids] = -np.inf
        kth = np.partition(scores, len(sample) - k, axis=1)[:, len(sample) - k]
        reach = np.sqrt((queries[a : a + 256] ** 2).sum(1) * (sample**2).sum(1).max())
        # a score beyond a long is given as the nearest long; so is the floor
        floors[a : a + 256] = np.minimum(kth - np.where(reach < 2.0**53, 0, reach * 1e-9), 2.0**62)
    return np.where(np.isnan(floors), -np.inf, floors)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, pivots: int = 16, block: int = 4096, queries_block: int = 4096, sample: int = 2048) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best for each query row.

    ``vectors``: vec_id, v (see ``whole_vectors``).  Every row is a candidate for
    every query but itself: repeated rows each count, and rows that repeat a query's
    id are candidates and, if they are queries, have k rows of their own.  Vectors of
    different lengths have no product and do not meet.  Fewer than k candidates give
    all.  No queries or no candidates give no rows.  Scores are exact; one beyond a
    long is given, and ranked, as the nearest long.  Pivots and first floors come from
    a sample of ``sample`` rows of the commonest length and only change the time.
    Extra columns are not read.
    """
    spark = vectors.sparkSession
    rows = cut(vectors.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"), F.size("v").alias("dim")))
    common = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    dim = int(common["dim"]) if common else 0
    sampled, found = _sample(rows, dim, sample)
    chosen = choose_pivots(found, pivots)

    def place(batches):
        """The nearest pivot of each row; rows of another length go behind the pivots."""
        for batch in batches:
            own = batch["dim"].to_numpy() == dim
            cell = np.full(batch.num_rows, len(chosen), np.int32)
            if own.any() and len(chosen):
                v = _matrix(batch["v"].filter(pa.array(own)), int(own.sum()))
                cell[own] = distances(v, chosen).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    placed = cut(rows.mapInArrow(place, _PLACED))
    counts = placed.groupBy("dim", "cell").count()
    total, n_queries = placed.agg(F.count("*"), F.count_if("is_query")).first()
    size = max(block, -(-total // MOST_BLOCKS))
    query_blocks = shares(n_queries, queries_block)
    # cells of the commonest length are as many as pivots; of the others, one a length
    parts = counts.select("dim", "cell", F.ceil(F.col("count") / size).cast("int").alias("parts"))
    common_cells, others = parts.where(F.col("dim") == dim), parts.where(F.col("dim") != dim)
    dealt = placed.where(F.col("dim") == dim).join(F.broadcast(common_cells), ["dim", "cell"]).unionByName(placed.where(F.col("dim") != dim).join(others, ["dim", "cell"]))
    block_of = F.shiftleft(F.col("cell").cast("long"), 40) + F.pmod(F.xxhash64("rid"), F.col("parts"))
    dealt = cut(dealt.select("rid", "vec_id", "v", "is_query", "dim", block_of.alias("c")))

    def intervals(t: pa.Table) -> pa.Table:
        v = _matrix(t["v"], t.num_rows)
        d = distances(v, chosen)
        return pa.table({"c": t["c"][:1], "low": [d.min(0).tolist()], "high": [d.max(0).tolist()], "top": [float((v * v).sum(1).max())]})

    table = dealt.where(F.col("dim") == dim).groupBy("c").applyInArrow(intervals, "c long, low array<double>, high array<double>, top double").collect()
    blocks = np.array([r["c"] for r in table], np.int64)
    low, high = (np.array([r[x] for r in table], float).reshape(len(table), len(chosen)) for x in ("low", "high"))
    top = np.array([r["top"] for r in table], float)
    held = spark.sparkContext.broadcast((sampled, found, chosen, blocks, low, high, top))

    def route(batches):
        """Each query once for every block that may hold one of its k best."""
        sampled, found, chosen, blocks, low, high, top = held.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                rids, queries = batch["rid"].to_numpy(), _matrix(batch["v"], batch.num_rows)
                floors = _first_floors(rids, queries, sampled, found, k)
                bounds = upper_bounds(queries, distances(queries, chosen), low, high, top)
                row, to = np.nonzero(bounds >= floors[:, None])
                for a in range(0, len(row), 8192):
                    own = pa.array(row[a : a + 8192])
                    part = batch.select(["rid", "vec_id", "v", "dim"]).take(own)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(blocks[to[a : a + 8192]]), pa.array(floors[row[a : a + 8192]])], ["rid", "vec_id", "v", "dim", "c", "floor"])

    asking = dealt.where("is_query")
    routed = asking.where(F.col("dim") == dim).select("rid", "vec_id", "v", "dim").mapInArrow(route, _ROUTED)
    odd = dealt.where(F.col("dim") != dim).select("dim", "c").distinct()
    rest = asking.where(F.col("dim") != dim).select("rid", "vec_id", "v", "dim").join(odd, "dim").select("rid", "vec_id", "v", "dim", "c", F.lit(float("-inf")).alias("floor"))
    routed = cut(routed.unionByName(rest).withColumn("q", F.pmod(F.xxhash64(F.lit(2), "rid"), F.lit(query_blocks)).cast("int")))
    met = routed.select("dim", "c", "q").distinct()
    whole = dealt.join(met, ["dim", "c"]).select("rid", "vec_id", "v", "dim", "c", "q", F.lit(None).cast("double").alias("floor"))

    def run(t: pa.Table) -> pa.Table:
        rids, ids, v = t["rid"].to_numpy(), t["vec_id"].to_numpy(), _matrix(t["v"], t.num_rows)
        asks = np.asarray(t["floor"].is_valid())
        near = chosen if v.shape[1] == dim else np.zeros((0, v.shape[1]))
        if not asks.any() or asks.all():
            return pa.table([pa.array([], pa.int64())] * 4, ["rid", "query_id", "vec_id", "score"])
        rings = Rings(rids[~asks], ids[~asks], v[~asks], near)
        q, own, scores = rings.search(rids[asks], v[asks], t["floor"].to_numpy()[asks], k)
        return pa.table([pa.array(x, pa.int64()) for x in (rids[asks][q], ids[asks][q], own, scores)], ["rid", "query_id", "vec_id", "score"])

    best = whole.unionByName(routed.select(whole.columns)).groupBy("dim", "c", "q").applyInArrow(run, _OUT)
    turn = Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
