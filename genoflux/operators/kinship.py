"""Relationship matrices between samples.

Long form: (i, j, k) from calls, a site's calls in one row.  Array form: ``variants`` with g in order of sample
ordinals; tasks add up tiles of the matrix over their variants, and tiles of one place
meet by a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import folder

#: Samples beyond which a dense matrix does not belong on a driver.
MOST_SAMPLES = 10_000


#: Pairs that a task forms at once, and distinct ones that it holds.
PAIRS = 1 << 21


def _by_site(calls: DataFrame, name: str = "a") -> DataFrame:
    """chr, pos and the known calls of the site as an array ``name``: a site has at most as
    many as there are samples.  Calls of no sample are left out."""
    own = F.collect_list(F.when(F.col("dosage").isNotNull() & F.col("sample_id").isNotNull(), F.struct("sample_id", F.col("dosage").cast("double").alias("v"))))
    return calls.groupBy("chr", "pos").agg(own.alias(name)).where(F.size(name) > 0)


def _spread(x: np.ndarray, site: np.ndarray, n: int) -> np.ndarray:
    """(x - mean) / sd (n - 1) within sites; NaN where a site has one value only."""
    count = np.bincount(site, minlength=n)
    low, high = np.full(n, np.inf), np.full(n, -np.inf)
    np.minimum.at(low, site, x)
    np.maximum.at(high, site, x)
    with np.errstate(all="ignore"):
        c = x - (np.bincount(site, x, n) / count)[site]
        sd = np.sqrt(np.bincount(site, c * c, n) / (count - 1))
        return np.where((low < high)[site], c / sd[site], np.nan)


def _side(column: pa.Array, kind: str):
    """Sample values (dictionary), and for each call: code, value, site; sorted by site and code."""
    site = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    calls = column.flatten()
    coded = calls.field("sample_id").dictionary_encode()
    up = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(up), np.int64)
    rank[up.to_numpy()] = np.arange(len(up))
    code = rank[coded.indices.to_numpy()] if len(up) else np.zeros(0, np.int64)
    x = calls.field("v").to_numpy(zero_copy_only=False)
    if kind == "rrm":
        x = _spread(x, site, len(column))
        use = ~np.isnan(x)
        code, x, site = code[use], x[use], site[use]
    turn = np.lexsort((code, site))
    return coded.dictionary.take(up), code[turn], x[turn], site[turn]


def _stored(sites: DataFrame) -> DataFrame:
    """The table, written to the shared folder, as it is read for its sizes and for its pairs."""
    path = folder(sites.sparkSession, "sites")
    sites.write.parquet(path)
    return sites.sparkSession.read.schema(sites.schema).parquet(path)


def _blocks(sites: DataFrame, by: list[str], pairs: int) -> tuple[list, int, int]:
    """First samples of ranges of column a that cut the matrix of any value of ``by`` into blocks of
    about ``pairs`` distinct cells; the number of slices of sites in which a block is added up; the
    number of partitions.  Blocks have a row each here, samples stay where they are."""
    two = "b" in sites.columns
    formed = F.size("a") * (F.size("b") if two else (F.size("a") + 1) / 2)
    per = sites.groupBy(*by).agg(F.sum(formed).alias("p")) if by else sites.agg(F.sum(formed).alias("p"))
    most, every = (int(v or 0) for v in per.agg(F.max("p"), F.sum("p")).first())
    if most <= pairs:
        return [], 1, max(1, -(-every // (2 * pairs)))
    samples = lambda c: sites.select(F.explode(f"{c}.sample_id").alias("s")).distinct()
    left = samples("a").count()
    cells = min(most, left * samples("b").count() if two else left * (left + 1) // 2)
    n = min(left, -(-cells // pairs))
    starts = samples("a").repartitionByRange(n, "s").groupBy(F.spark_partition_id()).agg(F.min("s").alias("s")).orderBy("s").collect() if n > 1 else []
    return [r["s"] for r in starts[1:]], min(256, 1 + most // (4 * n * pairs)), -(-every // (2 * pairs))


def _runs_of(*columns: np.ndarray) -> np.ndarray:
    """Bounds of runs of rows that agree in all columns."""
    turns = np.zeros(len(columns[0]), bool)
    for c in columns:
        turns[1:] |= c[1:] != c[:-1]
    return np.append(np.append(0, np.flatnonzero(turns)), len(turns)) if len(turns) else np.zeros(1, np.int64)


def _ranges(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first, first + 1, ... (``many`` of each), one after the other."""
    return np.repeat(first - np.cumsum(many) + many, many) + np.arange(int(many.sum()))


def _list_of(values: pa.Array, many: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)), pa.int32()), values)


def _cells(unit: pa.Table, kind: str, scale: float, two: bool, pairs: int):
    """i, j, sum and number of the pairs of rows that ``_pair_means`` deals to one place."""
    unit = unit.combine_chunks()

    def flat(ids: str, values: str):
        coded = pc.dictionary_encode(unit[ids].combine_chunks().flatten())
        up = pc.sort_indices(coded.dictionary)
        rank = np.empty(len(up), np.int64)
        rank[up.to_numpy()] = np.arange(len(up))
        code = rank[coded.indices.to_numpy()] if len(up) else np.zeros(0, np.int64)
        return coded.dictionary.take(up), code, unit[values].combine_chunks().flatten().to_numpy(zero_copy_only=False), pc.list_value_length(unit[ids]).to_numpy().astype(np.int64)

    left_ids, code, x, size = flat("ids", "x")
    right_ids, r_code, r_x, r_size = flat("r_ids", "r_x") if two else (left_ids, code, x, size)
    own = unit["m"].to_numpy().astype(np.int64)
    left = _ranges(np.cumsum(size) - size, own)
    ends = np.repeat(np.cumsum(r_size), own)
    first = np.repeat(np.cumsum(r_size) - r_size, own) if two else left
    many = ends - first
    # left samples are few: numbered on their own, so that the block is small
    some, row = np.unique(code[left], return_inverse=True)
    n_cells, width = len(some) * len(right_ids), len(right_ids)
    dense = n_cells <= 4 * pairs
    sums, counts, keys = (np.zeros(n_cells), np.zeros(n_cells), None) if dense else ([], [], [])

    def reduced():
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        return [key], [np.bincount(at, np.concatenate(sums), len(key))], [np.bincount(at, np.concatenate(counts), len(key))]

    total, a, held = np.cumsum(many), 0, 0
    while a < len(left):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + pairs, "right")))
        p, q = np.repeat(np.arange(a, b), many[a:b]), _ranges(first[a:b], many[a:b])
        u = left[p]
        if kind == "ibs":
            apart = code[u] != r_code[q]
            p, u, q = p[apart], u[apart], q[apart]
            value, weight = 1 - np.abs(x[u] - r_x[q]) / scale, np.ones(len(p))
        else:
            # two calls of one sample at a site meet in both orders
            weight = np.where((code[u] == r_code[q]) & (u != q), 2.0, 1.0) if not two else np.ones(len(p))
            value = x[u] * r_x[q] * weight
        key, a = row[p] * width + r_code[q], b
        if dense:
            sums += np.bincount(key, value, n_cells)
            counts += np.bincount(key, weight, n_cells)
            continue
        keys, sums, counts = [*keys, key], [*sums, value], [*counts, weight]
        held += len(key)
        if held > 4 * pairs:
            keys, sums, counts = reduced()
            held = 0
    if dense:
        key = np.flatnonzero(counts)
        s, n = sums[key], counts[key]
    elif keys:
        (key,), (s,), (n,) = reduced()
    else:
        key = s = n = np.zeros(0, np.int64)
    for a in range(0, len(key), 1 << 16):
        at = slice(a, a + (1 << 16))
        yield left_ids.take(pa.array(some[key[at] // width])), right_ids.take(pa.array(key[at] % width)), pa.array(s[at].astype(float)), pa.array(n[at].astype(np.int64))


def _pair_means(sites: DataFrame, by: list[str], kind: str, scale: float = 2.0, pairs: int = PAIRS, then=None) -> DataFrame:
    """by, i, j, k, n: mean over shared calls of 1 - |difference| / scale (``ibs``, i < j) or
    of the product of standardised calls (``rrm``; i <= j, or all i of column a with all j of
    column b where there is one).  ``sites`` is read for its sizes first.

    No pair is shuffled, only calls: a site's row goes to each block of rows of the matrix (a range
    of samples, see ``_blocks``) in which it has calls, with the calls that these meet.  A task
    takes one block after the other, and holds the calls of one and its distinct pairs, about
    ``pairs``.  Blocks of a matrix whose pairs meet often are added up in slices, whose sums meet
    behind.  ``then``: a function of Arrow batches of these rows and the schema of what it makes of
    them, where only that is wanted; it runs in the tasks that have them."""
    two = "b" in sites.columns
    keys = sites.select(*by).schema
    sample = sites.schema["a"].dataType.elementType["sample_id"].dataType.simpleString()
    r_sample = sites.schema["b"].dataType.elementType["sample_id"].dataType.simpleString() if two else sample
    starts, slices, parts = _blocks(sites, by, pairs)
    place = [*by, "_block", "_slice"]

    def deal(batches):
        edges = np.array(starts)
        for batch in batches:
            ids, code, x, site = _side(batch["a"], kind)
            r_ids, r_code, r_x, r_site = _side(batch["b"], kind) if two else (ids, code, x, site)
            if not len(code) or not len(r_code):
                continue
            block = np.searchsorted(edges, ids.to_numpy(zero_copy_only=False), "right")[code] if len(edges) else np.zeros(len(code), np.int64)
            bounds = _runs_of(site, block)
            at, own = bounds[:-1], np.diff(bounds)
            first = np.searchsorted(r_site, site[at], "left") if two else at
            many = np.searchsorted(r_site, site[at], "right") - first
            some = many > 0
            at, own, first, many = at[some], own[some], first[some], many[some]
            total, a = np.cumsum(many), 0
            while a < len(at):
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + (1 << 20), "right")))
                rows, l, q = pa.array(site[at[a:b]]), _ranges(at[a:b], own[a:b]), _ranges(first[a:b], many[a:b])
                met = [_list_of(r_ids.take(pa.array(r_code[q])), many[a:b]), _list_of(pa.array(r_x[q]), many[a:b])]
                out = [*(batch[c].take(rows) for c in by), pa.array(block[at[a:b]].astype(np.int32)), batch["_slice"].take(rows), pa.array(own[a:b].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*out, *([_list_of(ids.take(pa.array(code[l])), own[a:b]), _list_of(pa.array(x[l]), own[a:b])] if two else []), *met], [*place, "m", "ids", "x", *(["r_ids", "r_x"] if two else [])])
                a = b

    def add(batches):
        held, key = [], None

        def done():
            for cells in _cells(pa.Table.from_batches(held), kind, scale, two, pairs):
                yield pa.RecordBatch.from_arrays([*(pa.repeat(held[0][c][0], len(cells[0])) for c in by), *cells], [*by, "i", "j", "s", "n"])

        for batch in batches:
            bounds = _runs_of(*(batch[c].dictionary_encode(null_encoding="encode").indices.to_numpy() for c in place))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = tuple(batch[c][a].as_py() for c in place)
                if held and own != key:
                    yield from done()
                    held = []
                key = own
                held.append(batch.slice(a, b - a))
        if held:
            yield from done()

    text = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keys)
    lists = f"ids array<{sample}>, x array<double>" + (f", r_ids array<{r_sample}>, r_x array<double>" if two else "")
    if starts:  # sites are sent many times over: by as many tasks as take them, so that none has more to send than it can hold
        sites = sites.repartition(parts, "chr", "pos")
    own = sites.select(*by, F.pmod(F.xxhash64("chr", "pos"), F.lit(slices)).cast("int").alias("_slice"), *(["a", "b"] if two else ["a"]))
    dealt = own.mapInArrow(deal, f"{text}_block int, _slice int, m int, {lists}")

    def means(batches):
        for batch in add(batches):
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in (*by, "i", "j")), pc.divide(batch["s"], pc.cast(batch["n"], pa.float64())), batch["n"]], [*by, "i", "j", "k", "n"])

    met = dealt.repartition(parts, *place).sortWithinPartitions(*place)
    if then and slices == 1:
        return met.mapInArrow(lambda batches: then[0](means(batches)), then[1])
    sums = met.mapInArrow(add, f"{text}i {sample}, j {r_sample}, s double, n long")
    if slices == 1:
        return sums.select(*by, "i", "j", (F.col("s") / F.col("n")).alias("k"), "n")
    whole = sums.groupBy(*by, "i", "j").agg((F.sum("s") / F.sum("n")).alias("k"), F.sum("n").alias("n"))
    return whole.mapInArrow(*then) if then else whole


def _square(upper: DataFrame, by: list[str]) -> DataFrame:
    """Both triangles of a symmetric matrix given by the upper one."""
    mirror = F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))))
    return upper.select(*by, mirror.alias("x"), "k").select(*by, "x.i", "x.j", "k")


def ibs(calls: DataFrame, scale: float = 2.0) -> DataFrame:
    """i, j, k for i < j: mean of 1 - |difference| / scale over shared known calls; n."""
    return _pair_means(_stored(_by_site(calls)), [], "ibs", scale)


def rrm(calls: DataFrame) -> DataFrame:
    """i, j, k: mean product of standardised dosages over shared known calls."""
    return _square(_pair_means(_stored(_by_site(calls)), [], "rrm"), [])


def relation(observed: DataFrame, predicted: DataFrame) -> DataFrame:
    """Rectangular form of ``rrm``: obs_id, pred_id, k over variants in both stores."""
    sites = _stored(_by_site(observed).join(_by_site(predicted, "b"), ["chr", "pos"]))
    return _pair_means(sites, [], "rrm").select(F.col("i").alias("obs_id"), F.col("j").alias("pred_id"), "k")


def local_relation(observed: DataFrame, predicted: DataFrame, regions: DataFrame) -> DataFrame:
    """``relation`` of each region: region_id, obs_id, pred_id, k."""
    from .joins import in_regions

    sites = _stored(_by_site(observed).join(_by_site(predicted, "b"), ["chr", "pos"]))
    return _pair_means(in_regions(sites, regions), ["region_id"], "rrm").select("region_id", F.col("i").alias("obs_id"), F.col("j").alias("pred_id"), "k")


def local_rrm(calls: DataFrame, regions: DataFrame) -> DataFrame:
    """``rrm`` of each region: region_id, i, j, k."""
    from .joins import in_regions

    return _square(_pair_means(in_regions(_stored(_by_site(calls)), regions), ["region_id"], "rrm"), ["region_id"])


def rescaled(kinship: DataFrame) -> DataFrame:
    """Full square kinship times (n - 1) / trace of its centred form, which is
    sum of the diagonal less the mean row sum: two sums, no matrix product."""
    t = kinship.agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("k"))).alias("d"), F.sum("k").alias("s"), F.count_if(F.col("i") == F.col("j")).alias("n"))
    return kinship.join(F.broadcast(t)).select("i", "j", (F.col("k") * (F.col("n") - 1) / (F.col("d") - F.col("s") / F.col("n"))).alias("k"))  # one row


def asymmetries(kinship: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Entries whose mirror is absent or differs."""
    mirror = kinship.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("k").alias("m"))
    return kinship.join(mirror, ["i", "j"], "left").where(F.col("m").isNull() | (F.abs(F.col("k") - F.col("m")) > tolerance))


def _mirrored(batches):
    """``_square`` of Arrow batches: an entry and its mirror are neighbours."""
    for batch in batches:
        i, j = batch["i"], batch["j"]
        many = np.where(pc.equal(i, j).to_numpy(zero_copy_only=False), 1, 2)
        row = pa.array(np.repeat(np.arange(len(many)), many))
        low = np.zeros(len(row), bool)
        low[np.cumsum(many)[many == 2] - 1] = True
        low, i, j = pa.array(low), i.take(row), j.take(row)
        yield pa.RecordBatch.from_arrays([pc.if_else(low, j, i), pc.if_else(low, i, j), batch["k"].take(row)], ["i", "j", "k"])


def _settled(batches, tolerance: float):
    """i, j, k of the entries that are neither on the diagonal nor beside their mirror.  Those that are
    have one row a batch instead: their number n, and how many ``differ``."""
    same = lambda a, b: pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
    for batch in batches:
        if not batch.num_rows:
            continue
        i, j, k = batch["i"], batch["j"], batch["k"].to_numpy(zero_copy_only=False)
        own = same(i, j)
        beside = same(i[:-1], j[1:]) & same(j[:-1], i[1:]) & ~own[:-1]
        beside[1:] &= ~beside[:-1]
        left = ~own
        left[:-1] &= ~beside
        left[1:] &= ~beside
        with np.errstate(all="ignore"):
            apart = ~(np.abs(k[:-1] - k[1:]) <= tolerance)  # nulls and NaN too
        n, differ = own.sum() + 2 * beside.sum(), (own & ~np.isfinite(k)).sum() + 2 * (beside & apart).sum()
        rows, some = int(left.sum()), pa.array(left)
        ends = [pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array([int(v)], pa.int64())]) for v in (n, differ)]
        yield pa.RecordBatch.from_arrays([*(pa.concat_arrays([batch[c].filter(some), pa.nulls(1, batch[c].type)]) for c in ("i", "j", "k")), *ends], ["i", "j", "k", "n", "differ"])


def _symmetry(rows: DataFrame, tolerance: float) -> DataFrame:
    """n_pairs, n_asymmetric of what ``_settled`` gives: entries that are left are counted under one key
    with their mirror."""
    k, i, j, done = F.col("k"), F.col("i"), F.col("j"), F.col("done")
    cells = rows.groupBy(F.col("n").isNotNull().alias("done"), F.least(i, j).alias("lo"), F.greatest(i, j).alias("hi")).agg(
        F.count("*").alias("rows"), F.count("k").alias("known"), F.count_if(i < j).alias("up"), F.count_if(i > j).alias("down"), F.min("k").alias("low"), F.max("k").alias("high"), F.sum("n").alias("n"), F.sum("differ").alias("differ"))
    alone = (F.col("lo") != F.col("hi")) & ((F.col("up") == 0) | (F.col("down") == 0))
    differs = alone | (F.col("known") < F.col("rows")) | (F.col("high") - F.col("low") > tolerance)
    n, differ = F.when(done, F.col("n")).otherwise(F.col("rows")), F.when(done, F.col("differ")).when(differs, F.col("rows"))
    return cells.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n_pairs"), F.coalesce(F.sum(differ), F.lit(0)).alias("n_asymmetric"))


def symmetry(kinship: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """n_pairs, n_asymmetric: entries, and those of ``asymmetries``, by one pass over a matrix that has
    no entry twice.

    Entries beside their mirror are decided where they stand; the others are shuffled, under one key with
    their mirror.  No table is joined with itself."""
    i, j = (kinship.schema[c].dataType.simpleString() for c in ("i", "j"))
    rows = kinship.select("i", "j", F.col("k").cast("double").alias("k"))
    return _symmetry(rows.mapInArrow(lambda batches: _settled(batches, tolerance), f"i {i}, j {j}, k double, n long, differ long"), tolerance)


def rrm_symmetry(calls: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """``symmetry`` of ``rrm``, whose entries are formed, mirrored and compared in one task and never
    leave it: what is shuffled are calls, and the sums of slices where there are some."""
    sample = calls.schema["sample_id"].dataType.simpleString()
    then = (lambda batches: _settled(_mirrored(batches), tolerance), f"i {sample}, j {sample}, k double, n long, differ long")
    return _symmetry(_pair_means(_stored(_by_site(calls)), [], "rrm", then=then), tolerance)


class _Kernel:
    """Sums over the variants of a chunk (a row each, NaN: missing) for any two slices of samples."""

    def __init__(self, g: np.ndarray, kind: str, scale: float):
        self.kind, self.scale = kind, scale
        known = ~np.isnan(g)
        if kind == "rrm":
            m = known.sum(1)
            mean = np.where(known, g, 0).sum(1) / np.maximum(m, 1)
            c = np.where(known, g - mean[:, None], 0)
            sd = np.sqrt((c * c).sum(1) / np.maximum(m - 1, 1))
            use = sd > 0
            self.x, known = c[use] / sd[use, None], known[use]
        else:
            self.x = np.where(known, g, 0)
            self.values = np.unique(g[known])
        self.rows = len(known)
        self.known = None if known.all() else known.astype(float)

    def between(self, a: slice, b: slice) -> tuple[np.ndarray, np.ndarray | None]:
        """Sum of similarities and, where calls are missing, numbers of variants known in both."""
        x, y = self.x[:, a], self.x[:, b]
        both = None if self.known is None else self.known[:, a].T @ self.known[:, b]
        if self.kind == "rrm":
            return x.T @ y, both
        top = np.full((x.shape[1], y.shape[1]), float(self.rows)) if both is None else both.copy()
        k, l = (np.ones_like(x), np.ones_like(y)) if self.known is None else (self.known[:, a], self.known[:, b])
        if len(self.values) <= 8:
            # |a - b| is the sum of the gaps between neighbouring values that lie between a and b
            for low, gap in zip(self.values[:-1], np.diff(self.values), strict=True):
                u, v = k * (x > low), l * (y > low)
                top -= (u.T @ (l - v) + (k - u).T @ v) * (gap / self.scale)
        else:
            for i in range(self.rows):
                top -= np.where(np.outer(k[i], l[i]) > 0, np.abs(x[i][:, None] - y[i][None, :]), 0) / self.scale
        return top, both


def _lists(x: np.ndarray) -> pa.Array:
    """A list column of the rows of a matrix, over its own buffer."""
    bounds = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))


def gram_tiles(variants: DataFrame, kind: str = "rrm", scale: float = 2.0, tile: int = 256, chunk_bytes: int = 128 << 20, by: str | None = None) -> DataFrame:
    """IBS or RRM matrix of an array store in tiles: i, bj, first, k, the cells of row i in block
    column bj, which begins at column ``first``; from the block of the diagonal on to the right.
    With ``by`` (a column without nulls), one matrix for each of its values, in that column.

    Missing calls are left out pair by pair.  A task holds a chunk of its variants and the two
    sums (of similarities and of known pairs) of one tile at a time; tiles of one place meet by
    a shuffle and are added up row by row as they stream in.  What is shuffled is the matrix once
    for each chunk, and nothing of its size is ever in one place, so the samples are not
    bounded by what the driver or a task can hold.  Variants with one value of ``by`` are not
    brought together first, only sorted within their partitions: their sums meet.
    """
    n = variants.select(F.max(F.size("g"))).first()[0] or 0

    def run(batches):
        def tiles(part, held):
            kernel = _Kernel(np.concatenate(held), kind, scale)
            if not kernel.rows:
                return
            for a in range(0, n, tile):
                for b in range(a, n, tile):
                    top, both = kernel.between(slice(a, a + tile), slice(b, b + tile))
                    rows, size = len(top), pa.array(np.full(len(top), kernel.rows))
                    yield pa.RecordBatch.from_arrays([pa.array([part] * rows, pa.string()), pa.array(np.arange(a, a + rows)), pa.array(np.full(rows, b // tile, np.int32)), size, _lists(top), pa.nulls(rows, pa.list_(pa.float64())) if both is None else _lists(both)], ["part", "i", "bj", "n", "top", "both"])

        held, size, part = [], 0, None
        for batch in batches:
            g = np.asarray(batch["g"].flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, n)
            for own, first, last in _runs(batch["part"]):
                if size and (own != part or size > chunk_bytes):
                    yield from tiles(part, held)
                    held, size = [], 0
                part = own
                held.append(g[first:last])
                size += held[-1].nbytes
        if size:
            yield from tiles(part, held)

    def add(batches):
        """Adds up rows of the same place, which follow each other."""
        place, top, both = None, None, None

        def row():
            with np.errstate(all="ignore"):
                k = np.where(both > 0, top / both, 0)
            part, i, bj = place
            if kind == "ibs" and bj * tile <= i < bj * tile + len(k):
                k[i - bj * tile] = 1
            return pa.RecordBatch.from_arrays([pa.array([part], pa.string()), pa.array([i]), pa.array([bj], pa.int32()), pa.array([bj * tile]), _lists(k[None, :])], ["part", "i", "bj", "first", "k"])

        for batch in batches:
            i, bj, n_rows = (batch[c].to_numpy() for c in ("i", "bj", "n"))
            parts = batch["part"].to_pylist()
            at, flat = batch["top"].offsets.to_numpy(), batch["top"].values.to_numpy()
            known_at, known = batch["both"].offsets.to_numpy(), batch["both"].values.to_numpy()
            done = []
            for r in range(batch.num_rows):
                own = flat[at[r] : at[r + 1]]
                pairs = known[known_at[r] : known_at[r + 1]] if known_at[r + 1] > known_at[r] else float(n_rows[r])
                if place == (parts[r], i[r], bj[r]):
                    top, both = top + own, both + pairs
                    continue
                if place is not None:
                    done.append(row())
                place, top, both = (parts[r], int(i[r]), int(bj[r])), own.copy(), np.zeros(len(own)) + pairs
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
        if place is not None:
            yield row()

    rows = variants.select(F.lit("").alias("part") if by is None else F.col(by).cast("string").alias("part"), "g")
    parts = (rows if by is None else rows.sortWithinPartitions("part")).mapInArrow(run, "part string, i long, bj int, n long, top array<double>, both array<double>")
    place = ["i", "bj"] if by is None else ["part", "i", "bj"]
    whole = parts.repartition(*place).sortWithinPartitions(*place).mapInArrow(add, "part string, i long, bj int, first long, k array<double>")
    return whole.drop("part") if by is None else whole.withColumnRenamed("part", by)


def _runs(parts: pa.Array) -> list[tuple[str, int, int]]:
    """Value, first and end of each run of equal values."""
    if not len(parts):
        return []
    starts = [0, *(np.flatnonzero(pc.not_equal(parts[1:], parts[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist()]
    return [(parts[a].as_py(), a, b) for a, b in zip(starts, [*starts[1:], len(parts)], strict=True)]


def regional_tiles(variants: DataFrame, regions: DataFrame, kind: str = "rrm", scale: float = 2.0, tile: int = 256) -> DataFrame:
    """The matrix of each closed region (region_id, chr, start, end) of an array store, as
    ``gram_tiles`` gives it, in one job: region_id, i, bj, first, k.  A variant in several
    regions counts in each; a region without variants has no rows."""
    from .joins import in_regions

    rows = in_regions(variants.select("chr", "pos", "g"), regions)
    return gram_tiles(rows.select("region_id", "g"), kind, scale, tile, by="region_id")


def _diagonal():
    return F.when((F.col("i") >= F.col("first")) & (F.col("i") < F.col("first") + F.size("k")), F.element_at("k", (F.col("i") - F.col("first") + 1).cast("int")))


def rescaled_tiles(tiles: DataFrame) -> DataFrame:
    """``rescaled`` of a matrix in tiles: the diagonal and the sum of all cells are added up
    where the tiles are; those right of the diagonal's block stand for two."""
    whole = F.aggregate("k", F.lit(0.0), lambda s, x: s + x) * F.when(_diagonal().isNull(), 2).otherwise(1)
    t = tiles.agg(F.sum(_diagonal()).alias("d"), F.sum(whole).alias("s"), F.count(_diagonal()).alias("n"))
    factor = (F.col("n") - 1) / (F.col("d") - F.col("s") / F.col("n"))
    return tiles.join(F.broadcast(t)).select("i", "bj", "first", F.transform("k", lambda x: x * factor).alias("k"))  # one row


def tile_cells(tiles: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """i, j, k of the full square (of each value of ``by``)."""
    cells = tiles.select(*by, "i", _diagonal().isNull().alias("apart"), "first", F.posexplode("k").alias("c", "k")).select(*by, "i", (F.col("first") + F.col("c")).alias("j"), "apart", "k")
    both = F.explode(F.when(F.col("apart"), F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).otherwise(F.array(F.struct("i", "j"))))
    return cells.select(*by, both.alias("x"), "k").select(*by, "x.i", "x.j", "k")


def gram(variants: DataFrame, kind: str = "rrm", scale: float = 2.0) -> np.ndarray:
    """The matrix of ``gram_tiles`` as one array, for dense algebra on the driver."""
    n = variants.select(F.max(F.size("g"))).first()[0] or 0
    if n > MOST_SAMPLES:
        raise ValueError(f"{n} samples; use gram_tiles or the long form")
    rows, out = gram_tiles(variants, kind, scale, 1024).toArrow(), np.zeros((n, n))
    if not rows.num_rows:
        return np.eye(n)
    at = 0
    flat = rows["k"].combine_chunks().flatten().to_numpy()
    for i, first, size in zip(rows["i"].to_pylist(), rows["first"].to_pylist(), pc.list_value_length(rows["k"]).to_pylist(), strict=True):
        out[i, first : first + size] = flat[at : at + size]
        at += size
    for a in range(0, n, 1024):  # what lies below the diagonal blocks was not sent
        out[a + 1024 :, a : a + 1024] = out[a : a + 1024, a + 1024 :].T
    return out


def rescale(k: np.ndarray) -> np.ndarray:
    n = len(k)
    return k * (n - 1) / (np.trace(k) - k.sum() / n)


def local_ibs(calls: DataFrame, width: int, scale: float = 2.0) -> DataFrame:
    """``ibs`` of each half-overlapping tiling window: chr, start, i, j, k, n (i < j)."""
    from .variants import in_tiling_windows

    return _pair_means(in_tiling_windows(_stored(_by_site(calls)), width), ["chr", "start"], "ibs", scale)
