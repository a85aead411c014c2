"""Exact vector search with an adaptive cut-off, concepts, and near-duplicate groups of photos."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galeria.functions.scalars import dot
from galeria.plans.shared import checkpoint, components, partitions, stored


def literal(vector: list[float]) -> Column:
    """A query vector as a constant; the optimizer folds the text into one literal."""
    return F.from_json(F.lit(str([float(x) for x in vector])), "array<double>")


def vector_of(vectors: DataFrame, key: int, id_: str = "id", vector: str = "vector") -> list[float] | None:
    """The stored vector of one row, for use as a query."""
    row = vectors.where(F.col(id_) == key).select(vector).first()
    return row and row[0]


def scores(vectors: DataFrame, query: list[float], id_: str = "id", vector: str = "vector") -> DataFrame:
    """``id, score`` of all vectors of the query's length."""
    rows = vectors.where(F.size(vector) == len(query))
    return rows.select(F.col(id_).alias("id"), dot(F.col(vector), literal(query)).alias("score"))


def score_stats(scored: DataFrame) -> DataFrame:
    """Count, mean and population deviation (at least 1e-6) of the scores."""
    return scored.agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.greatest(F.stddev_pop("score"), F.lit(1e-6)).alias("std"))


def search(
    vectors: DataFrame, query: list[float], strictness: float = 2.2, least: int = 12, most: int = 800, exclude: int | None = None,
    id_: str = "id", vector: str = "vector",
) -> DataFrame:
    """``id, score, rank``: the best ``least``, and up to ``most`` with score >= mean + strictness * deviation.

    The statistics hold all vectors, an excluded one too; they are one row, fetched to
    become constants of the plan. Only the best ``most`` rows are ranked.
    """
    scored = scores(vectors, query, id_, vector)
    s = score_stats(scored).first()
    if not s["n"]:
        return scored.withColumn("rank", F.lit(0)).limit(0)
    if exclude is not None:
        scored = scored.where(F.col("id") != exclude)
    top = scored.orderBy(F.desc("score"), "id").limit(most)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "id"))  # over ``most`` rows at most
    return top.withColumn("rank", rank).where((F.col("rank") <= least) | (F.col("score") >= s["mean"] + strictness * s["std"]))


def similar(vectors: DataFrame, key: int, strictness: float = 2.2, **names) -> DataFrame:
    """Items like a stored one: stricter by 0.6, 300 at most, without itself."""
    query = vector_of(vectors, key, **names)
    return search(vectors, query or [], strictness + 0.6, most=300, exclude=key, **names)


def search_within(vectors: DataFrame, query: list[float], allowed: DataFrame) -> DataFrame:
    """``id, section, score, ts_ms``: allowed items (``id``, ``ts_ms``) by score (section 0), then those without a vector."""
    scored = scores(vectors, query)
    inside = allowed.join(scored, "id").select("id", F.lit(0).alias("section"), "score", "ts_ms")
    rest = allowed.join(scored, "id", "left_anti").select("id", F.lit(1).alias("section"), F.lit(None).cast("double").alias("score"), "ts_ms")
    return inside.unionByName(rest)


def best_per_concept(vectors: DataFrame, concepts: list[tuple[int, list[float]]]) -> DataFrame:
    """``concept, id, score``: each concept's best item; an item that several concepts find stays with the first.

    Concepts are a short list of queries; each row scores against all of them in one pass.
    """
    each = F.array(*(F.struct(F.lit(k).alias("concept"), dot(F.col("vector"), literal(q)).alias("score")) for k, q in concepts))
    scored = vectors.select("id", F.explode(each).alias("c")).select("id", "c.*")
    best = scored.groupBy("concept").agg(F.max_by(F.struct("id", "score"), F.struct(F.col("score"), -F.col("id"))).alias("b"))
    first = best.select("concept", "b.id", "b.score").groupBy("id").agg(F.min_by(F.struct("concept", "score"), "concept").alias("f"))
    return first.select("f.concept", "id", "f.score")


def near_pairs(items: DataFrame, threshold: float = 0.93, window_ms: int = 20 * 60 * 1000, block: int = 1 << 24, most_pivots: int = 2048) -> DataFrame:
    """``a, b``: items (``id``, ``ts_ms``, ``vector``) within the window whose vectors' product reaches the threshold.

    Items meet by time buckets, not all with all: the earlier item stands in its bucket, the
    later one in its own and the one before. A bucket is met as products of matrices, and
    only vectors of one length meet. One of more than ``block`` comparisons, or of four times
    their root in rows, such as one burst or one of missing times, goes through ``burst_pairs``.
    """
    return _linked(items, threshold, window_ms, block, most_pivots, trees=False)


def near_groups(items: DataFrame, threshold: float = 0.93, window_ms: int = 20 * 60 * 1000, block: int = 1 << 24, most_pivots: int = 2048) -> DataFrame:
    """``id, grp``: the ``groups`` of ``near_pairs``, found without all the pairs.

    A bucket, or a block of one, gives a tree for all that its pairs connect: fewer edges
    than it has items. What is connected there already is not compared again.
    """
    return groups(_linked(items, threshold, window_ms, block, most_pivots, trees=True))


def _linked(items: DataFrame, threshold: float, window_ms: int, block: int, most_pivots: int, trees: bool) -> DataFrame:
    rows = items.select(F.floor(F.col("ts_ms") / window_ms).alias("k"), F.size("vector").alias("d"), "id", F.col("ts_ms").alias("ts"), F.col("vector").alias("v"))
    rows, _ = stored(rows.where(F.col("k").isNotNull() & F.forall("v", lambda x: x.isNotNull())), "items")  # read four times
    n = rows.groupBy("k", "d").agg(F.count("*").alias("n"))
    size = n.join(n.select((F.col("k") - 1).alias("k"), "d", F.col("n").alias("next")), ["k", "d"], "left").withColumn("next", F.coalesce("next", F.lit(0)))
    both = F.col("n") + F.col("next")
    hot = checkpoint(size.where((F.col("n") * both > block) | (both > 4 * math.sqrt(block))))
    sides = F.array(F.struct("k", F.lit(True).alias("own")), F.struct((F.col("k") - 1).alias("k"), F.lit(False).alias("own")))
    calm = rows.withColumn("side", F.explode(sides)).select("side.*", "d", "id", "ts", "v")
    lengths = [r["d"] for r in hot.select("d").distinct().collect()]
    if lengths:
        calm = calm.join(hot.select("k", "d"), ["k", "d"], "left_anti").select("k", "own", "d", "id", "ts", "v")
    kind = T.StructType([T.StructField(c, rows.schema["id"].dataType) for c in "ab"])
    dealt = calm.repartition(partitions(rows), "k", "d").sortWithinPartitions("k", "d", "ts")
    out = dealt.mapInArrow(_buckets(threshold, window_ms, trees), kind)
    for d in lengths:
        ours = rows.where(F.col("d") == d).drop("d")
        later = ours.withColumn("k", F.explode(F.array("k", F.col("k") - 1)))
        out = out.union(burst_pairs(ours, later, hot.where(F.col("d") == d).drop("d"), threshold, window_ms, block, most_pivots, trees))
    return out


def burst_cells(rows: DataFrame, later: DataFrame, hot: DataFrame, threshold: float, block: int, most_pivots: int = 2048) -> tuple[DataFrame, DataFrame]:
    """The earlier items in their cell and the later ones in every cell where a partner may be: ``k, cell, p, q, id, ts, v`` of both.

    Some items of each hot bucket are its pivots, drawn so that a sample of the bucket lies
    within the threshold's angle of them. An item's cell is the pivot at the smallest angle
    and the ring around it, as wide as that angle, in which it lies. Angles obey the triangle
    inequality: an item whose angle to a pivot is larger than to its own by over twice the
    threshold's has no partner there, and partners lie in the same ring or the next. So
    nothing is lost. Where the sample shows that pivots would rule out too little for the
    copies that they make, the bucket is one cell. Cells of more than ``block`` comparisons
    are dealt out: ``p`` are slices of the earlier items, ``q`` of the later ones. Vectors
    must have one length.
    """
    both = rows.select("k", "id", "v").join(hot, "k")
    share = F.least(F.lit(1.0), F.lit(1.5 * SAMPLE) / F.col("n"))
    drawn = both.where((F.xxhash64("id") / F.lit(2.0**64) + 0.5 <= share) & (_norm("v") > 0))
    first = F.row_number().over(Window.partitionBy("k").orderBy(F.xxhash64("id"), "id"))
    drawn = drawn.withColumn("r", first).where(F.col("r") <= SAMPLE).select("k", F.col("v").cast("array<double>").alias("v"))
    longest = later.join(hot, "k").groupBy("k").agg(F.max(_norm("v")).alias("longest"))
    per = hot.join(longest, "k").withColumn("slices", F.ceil((F.col("n") + F.col("next")) / F.lit(4096.0)))
    about = per.select("k", "longest", (F.col("n") + F.col("next")).alias("rows"))
    pivots = drawn.join(about, "k").groupBy("k").applyInArrow(_spread(threshold, most_pivots, math.sqrt(block)), "k long, pivots array<array<double>>")
    per = checkpoint(per.join(pivots, "k", "left"))

    def angles(df: DataFrame, own: bool) -> DataFrame:
        parts = per.select("k", "pivots", "longest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
        met = df.join(per.select("k", "slices"), "k").select("k", F.pmod(F.xxhash64("id"), F.col("slices")).alias("slice"), "id", "ts", "v")
        kind = T.StructType([df.schema[c] for c in ("k", "id", "ts", "v")]).add("cell", T.IntegerType())
        return met.groupBy("k", "slice").cogroup(parts.groupBy("k", "slice")).applyInArrow(_angles(threshold, own), kind)

    homes, _ = stored(angles(rows, True), "homes")
    there = homes.groupBy("k", "cell").agg(F.count("*").alias("n"))
    visits, _ = stored(angles(later, False).join(checkpoint(there), ["k", "cell"]).drop("n"), "visits")
    counts = there.join(visits.groupBy("k", "cell").agg(F.count("*").alias("m")), ["k", "cell"])
    side = F.lit(math.sqrt(block))
    counts = checkpoint(counts.select("k", "cell", F.ceil(F.col("n") / side).alias("ps"), F.ceil(F.col("m") / side).alias("qs")))
    salt = lambda c: F.pmod(F.xxhash64("id", F.lit(5)), F.col(c))
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    a = homes.join(counts, ["k", "cell"]).withColumn("p", salt("ps")).withColumn("q", each("qs"))
    b = visits.join(counts, ["k", "cell"]).withColumn("p", each("ps")).withColumn("q", salt("qs"))
    columns = ["k", "cell", "p", "q", "id", "ts", "v"]
    return a.select(*columns), b.select(*columns)


def burst_pairs(rows: DataFrame, later: DataFrame, hot: DataFrame, threshold: float, window_ms: int, block: int, most_pivots: int = 2048, trees: bool = False) -> DataFrame:
    """``a, b`` of the hot buckets: the cells of ``burst_cells`` met block by block, as products of matrices."""
    a, b = burst_cells(rows, later, hot, threshold, block, most_pivots)
    keys, kind = ["k", "cell", "p", "q"], T.StructType([T.StructField(c, rows.schema["id"].dataType) for c in "ab"])
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(_products(threshold, window_ms, trees), kind)


def _norm(v: str) -> Column:
    return F.sqrt(dot(F.col(v), F.col(v)))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


#: Slack of angles in radians, rings of a pivot at most, and items of a bucket that its pivots are chosen from.
SLACK, RINGS, SAMPLE = 1e-6, 1 << 12, 4096


def _far(threshold: float, longest: float | None) -> float | None:
    """The largest angle of two vectors that reach the threshold; infinite if any may, None if none does."""
    if threshold <= 0:
        return math.inf
    limit = threshold / longest**2 if longest else math.inf
    return None if limit > 1 + SLACK else math.acos(min(1.0, limit)) + SLACK


def _spread(threshold: float, most: int, side: float):
    """A bucket's sample to its pivots: each next one is the item farthest from those before, until all are near one.

    None are left where meeting the whole bucket costs less, a copy of an item counting as
    ``side`` / 64 products; an item stands in up to three rings of each pivot that it visits.
    """

    def run(sample: pa.Table) -> pa.Table:
        x, far = _matrix(sample["v"]), _far(threshold, sample["longest"][0].as_py())
        x /= np.sqrt((x * x).sum(1))[:, None]
        chosen: list[int] = []
        if far is not None and math.isfinite(far):
            nearest, at, close = np.full(len(x), -2.0), 0, math.cos(min(math.pi, far))
            while len(chosen) < most:
                chosen.append(at)
                nearest = np.maximum(nearest, x @ x[at])
                at = int(nearest.argmin())
                if nearest[at] >= close:
                    break
            angle = np.arccos(np.clip(x @ x[chosen].T, -1, 1))
            visits, homes = angle - angle.min(1)[:, None] <= 2 * far, np.bincount(angle.argmin(1), minlength=len(chosen))
            share, copies = float(homes @ visits.sum(0)) / len(x) ** 2, 3 * visits.sum() / len(x)
            if share + copies * side / 64 / sample["rows"][0].as_py() >= 1:
                chosen = []
        return pa.table({"k": sample["k"].slice(0, 1), "pivots": pa.array([x[chosen].tolist()], pa.list_(pa.list_(pa.float64())))})

    return run


def _angles(threshold: float, own: bool):
    """A slice of a bucket's items and its pivots to items by cell: the home cell only, or every cell that may hold a partner."""

    def run(items: pa.Table, per: pa.Table) -> pa.Table:
        x, far, pivots = _matrix(items["v"]), _far(threshold, per["longest"][0].as_py()), per["pivots"][0].as_py()
        norms = np.sqrt((x * x).sum(1))
        if threshold > 0:  # without a length, or with too short ones, no product reaches it
            keep = np.flatnonzero((norms > 0) & (far is not None))
            x, items, norms = x[keep], items.take(pa.array(keep)), norms[keep]
        if not pivots or not len(x):
            rows, cells = np.arange(len(x)), np.zeros(len(x), np.int64)
        else:
            angle = np.arccos(np.clip(x @ np.array(pivots).T / norms[:, None], -1, 1))
            home = angle.argmin(1)
            least = angle[np.arange(len(x)), home]
            rows, at = (np.arange(len(x)), home) if own else np.nonzero(angle - least[:, None] <= 2 * far)
            ring = np.minimum(angle[rows, at] // far, RINGS - 1).astype(np.int64)
            if not own:  # a partner's ring is this one or one beside it
                rows, at = np.repeat(rows, 3), np.repeat(at, 3)
                ring = (ring[:, None] + np.array([-1, 0, 1])).ravel()
                fits = (ring >= 0) & (ring < RINGS)
                rows, at, ring = rows[fits], at[fits], ring[fits]
            cells = at * RINGS + ring
        taken = items.take(pa.array(rows))
        return pa.table({n: taken[n] for n in ("k", "id", "ts", "v")} | {"cell": pa.array(cells.astype(np.int32))})

    return run


def _meet(first: pa.Table, second: pa.Table, threshold: float, window_ms: int, trees: bool, rows: int = 256) -> Iterator[pa.Table]:
    """Earlier and later items (``id``, ``ts``, ``v``) to the pairs ``a, b`` that reach the threshold, or to trees of what these connect.

    Products near the threshold are added again in the order of the elements, so they are
    those of ``dot``. A tree is a star about its smallest id; an item that pairs with itself
    is one of its own.
    """
    if not first.num_rows or not second.num_rows:
        return
    first, second = (t.take(pc.sort_indices(t["ts"])).combine_chunks() for t in (first, second))
    ids = pa.concat_arrays([c for t in (first, second) for c in t["id"].chunks])
    code = pc.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64) - 1
    known = pc.is_valid(ids).to_numpy(zero_copy_only=False)
    n = first.num_rows
    (ta, xa), (tb, xb) = ((t["ts"].to_numpy(), _matrix(t["v"])) for t in (first, second))
    with np.errstate(all="ignore"):
        norm = max(np.sqrt((xa * xa).sum(1)).max() * np.sqrt((xb * xb).sum(1)).max(), 0.0)
    slack = 1e-9 + 1e-15 * xa.shape[1] * norm if math.isfinite(norm) else math.inf

    def pairs(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(all="ignore"):
            s = xa[i] @ xb[j].T
            p, q = np.nonzero(~(s < threshold - slack))  # what is no number is larger than all numbers
            s, p, q = s[p, q], i[p], j[q]
            ok = (tb[q] - ta[p] <= window_ms) & ((ta[p] < tb[q]) | ((ta[p] == tb[q]) & (code[p] < code[n + q]) & known[p] & known[n + q]))
            s, p, q = s[ok], p[ok], q[ok]
            unsure = np.flatnonzero(~(np.abs(s - threshold) > slack))
            total = np.zeros(len(unsure))
            for c in range(xa.shape[1] if len(unsure) else 0):
                total += xa[p[unsure], c] * xb[q[unsure], c]
        s[unsure] = total
        keep = ~(s < threshold)
        return p[keep], n + q[keep]

    tree, own = np.arange(code.max() + 1), np.zeros(code.max() + 1, bool)
    for at in range(0, n, rows):
        i = np.arange(at, min(n, at + rows))
        j = np.arange(np.searchsorted(tb, ta[i[0]], "left"), np.searchsorted(tb, ta[i[-1]] + window_ms, "right"))
        if not len(j):
            continue
        if not trees:
            p, q = pairs(i, j)
            yield pa.table({"a": ids.take(pa.array(p)), "b": ids.take(pa.array(q))})
            continue
        largest = np.bincount(tree[code[n + j]]).argmax()  # its items need not meet each other
        inside = (tree[code[i]] == largest) & (np.count_nonzero(tree == largest) > 1)
        for i_, j_ in ((i[~inside], j), (i[inside], j[tree[code[n + j]] != largest])):
            if len(i_) and len(j_):
                p, q = (code[x] for x in pairs(i_, j_))
                own[p[p == q]] = True
                _unite(tree, p, q)
    if trees:
        _, where = np.unique(code, return_index=True)
        leaves = np.flatnonzero((tree != np.arange(len(tree))) | own)
        a, b = where[tree[leaves]], where[leaves]
        yield pa.table({"a": ids.take(pa.array(a)), "b": ids.take(pa.array(b))})


def _unite(tree: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Roots of numbers, the smallest of each tree, after edges between ``p`` and ``q``."""
    while True:
        a, b = tree[p], tree[q]
        other = a != b
        if not other.any():
            return
        p, q, a, b = p[other], q[other], a[other], b[other]
        np.minimum.at(tree, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := tree[tree], tree):
            tree[:] = up


def _buckets(threshold: float, window_ms: int, trees: bool, each: int = 1 << 16):
    """Rows in the order of (``k``, ``d``, ``ts``) to what ``_meet`` gives of each bucket; one bucket is held at a time."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            k, d = batch.column("k").to_numpy(), batch.column("d").to_numpy()
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]) | (d[1:] != d[:-1])) + 1).tolist(), len(k)]
            for lo, hi in pairwise(cuts):
                if held and key != (k[lo], d[lo]):
                    yield from meet(held)
                    held = []
                key = (k[lo], d[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from meet(held)

    def meet(held: list[pa.RecordBatch]) -> Iterator[pa.Table]:
        rows = pa.Table.from_batches(held)
        return _meet(rows.filter(rows["own"]), rows, threshold, window_ms, trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = [], 0
        for t in found(batches):
            out, n = [*out, t] if t.num_rows else out, n + t.num_rows
            if n >= each:
                yield from pa.concat_tables(out).combine_chunks().to_batches()
                out, n = [], 0
        if out:
            yield from pa.concat_tables(out).combine_chunks().to_batches()

    return run


def _products(threshold: float, window_ms: int, trees: bool = False):
    """Earlier and later items of a block to what ``_meet`` gives of them."""

    def run(first: pa.Table, second: pa.Table) -> pa.Table:
        found = list(_meet(first, second, threshold, window_ms, trees))
        return pa.concat_tables(found) if found else pa.table({c: first["id"].slice(0, 0) for c in "ab"})

    return run


def groups(pairs: DataFrame) -> DataFrame:
    """``id, grp``: connected components of ``pairs(a, b)``, named by their smallest id."""
    pairs = checkpoint(pairs.select("a", "b"))  # joined once, read twice
    found = components(pairs)
    alone = pairs.where("a = b").select(F.col("a").alias("v"), F.col("a").alias("comp")).distinct().join(found, "v", "left_anti")
    return found.unionByName(alone).select(F.col("v").alias("id"), F.col("comp").alias("grp"))
