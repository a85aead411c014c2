"""Approximate nearest neighbours by cosine over balanced posting lists.

Centroids come from balanced k-means on a bounded sample and are searched through a
neighbour graph in memory. Every vector is posted to its nearest list and, near a border,
to further lists; a query reads the lists whose centroid distance is within a ratio of the
nearest one's. Long lists are split into blocks by the vectors' ids, and the queries of a
list as well, so a task holds a bounded block of each. Scores are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galeria.llm.common import checkpoint, lowest, stored, table
from galeria.plans.numbering import lookup


@dataclass
class Index:
    """Unit centroids and, for each, its nearest centroids."""

    centroids: np.ndarray
    graph: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, lists: int, rounds: int = 10, degree: int = 24, seed: int = 3, rows: int = 2048) -> Index:
        """Balanced spherical k-means: centroids of few vectors move into the fullest lists. Works by blocks of ``rows``."""
        rng = np.random.default_rng(seed)
        x = np.unique(x, axis=0)
        c = x[rng.permutation(len(x))[:lists]]
        for _ in range(rounds):
            near = np.concatenate([(x[at : at + rows] @ c.T).argmax(1) for at in range(0, len(x), rows)])
            sizes = np.bincount(near, minlength=len(c))
            sums = np.zeros_like(c)
            np.add.at(sums, near, x)
            norms = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), c)
            few = np.flatnonzero(sizes < 0.25 * len(x) / len(c))
            full = np.argsort(-sizes, kind="stable")[: len(few)]
            for a, b in zip(few, full, strict=False):
                own = np.flatnonzero(near == b)
                if sizes[b] > 2 * len(x) / len(c):
                    c[a] = x[own[rng.integers(len(own))]]
        nearest = lambda part: np.argsort(-(part @ c.T), axis=1, kind="stable")[:, : min(degree, len(c))]
        return Index(c, np.concatenate([nearest(c[at : at + rows]) for at in range(0, len(c), rows)]))

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids of each row: (ids, distances), nearest first, by best-first search of the graph."""
        k, n = len(self.centroids), len(x)
        beam = min(beam, k)
        starts = np.unique(np.linspace(0, k - 1, min(k, max(beam, 8))).astype(int))
        ids = np.broadcast_to(starts, (n, len(starts))).copy()
        sims = x @ self.centroids[starts].T
        done = np.zeros(ids.shape, bool)
        rows = np.arange(n)
        while rows.size:
            best = np.where(done[rows], -np.inf, sims[rows])
            at = best.argmax(1)
            open_ = best[np.arange(len(rows)), at] > -np.inf
            rows, at = rows[open_], at[open_]
            if not rows.size:
                break
            done[rows, at] = True
            near = self.graph[ids[rows, at]]
            s = np.einsum("rd,rnd->rn", x[rows], self.centroids[near])
            s[(near[:, :, None] == ids[rows][:, None, :]).any(2)] = -np.inf
            all_ids, all_sims = np.concatenate([ids[rows], near], 1), np.concatenate([sims[rows], s], 1)
            all_done = np.concatenate([done[rows], np.zeros(near.shape, bool)], 1)
            keep = np.argsort(-all_sims, axis=1, kind="stable")[:, : ids.shape[1]]
            ids[rows], sims[rows] = np.take_along_axis(all_ids, keep, 1), np.take_along_axis(all_sims, keep, 1)
            done[rows] = np.take_along_axis(all_done, keep, 1) | (sims[rows] == -np.inf)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
        sims = np.take_along_axis(sims, order, 1)
        return np.take_along_axis(ids, order, 1), np.sqrt(np.maximum(2 - 2 * sims, 0))

    def postings(self, x: np.ndarray, ratio: float, most: int, beam: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs: the nearest list and up to ``most`` in all within the ratio that add a direction."""
        ids, d = self.search(x, beam)
        chosen = np.zeros(ids.shape, bool)
        chosen[:, 0] = True
        for j in range(1, ids.shape[1]):
            ok = (d[:, j] <= ratio * d[:, 0]) & (chosen.sum(1) < most)
            for i in range(j):
                apart = np.sqrt(np.maximum(2 - 2 * (self.centroids[ids[:, j]] * self.centroids[ids[:, i]]).sum(1), 0))
                ok &= ~chosen[:, i] | (apart > 0.6 * d[:, j])
            chosen[:, j] = ok
        rows, at = np.nonzero(chosen)
        return rows, ids[rows, at]

    def probes(self, x: np.ndarray, ratio: float, beam: int, sizes: np.ndarray, least: int, slack: float = 1.05) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs of the lists that a query reads: all within the ratio, and the nearest ones until they hold ``least`` vectors.

        From the ``beam`` nearest centroids that the search found, the walk goes on along the
        graph through every centroid within the ratio, with some slack, however many they are.
        """
        ids, d = self.search(x, beam)
        before = np.cumsum(sizes[ids], axis=1) - sizes[ids]
        limit = ratio * d[:, 0]
        rows, at = np.nonzero((d <= limit[:, None]) | (before < least))
        out = [(rows, ids[rows, at])]
        seen = np.zeros((len(x), len(self.centroids)), bool)
        np.put_along_axis(seen, ids, True, 1)
        rows, at = np.nonzero(d <= slack * limit[:, None])
        lists = ids[rows, at]
        while rows.size:
            near = np.unique(np.repeat(rows, self.graph.shape[1]) * len(self.centroids) + self.graph[lists].ravel())
            rows, lists = np.divmod(near, len(self.centroids))
            new = ~seen[rows, lists]
            rows, lists = rows[new], lists[new]
            seen[rows, lists] = True
            parts = [np.einsum("rd,rd->r", x[rows[i : i + 65536]], self.centroids[lists[i : i + 65536]]) for i in range(0, len(rows), 65536)]
            far = np.sqrt(np.maximum(2 - 2 * np.concatenate([np.empty(0), *parts]), 0))
            inside, go = far <= limit[rows], far <= slack * limit[rows]
            out.append((rows[inside], lists[inside]))
            rows, lists = rows[go], lists[go]
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component to between 0.5 and 1: exact, and no square leaves the range of doubles."""
    _, e = np.frexp(np.abs(x).max(1, initial=0))
    half = -e // 2  # in two steps: the power itself may leave the range
    return np.ldexp(np.ldexp(x, half[:, None]), (-e - half)[:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _deal(choose, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows, lists = choose(_unit(_matrix(part.column(2), dim)))
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), *(part.column(i).take(take) for i in range(3))], ["list", "id", "row", "v"])

    return run


def _score(k: int, dim: int):
    def run(posted: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if posted.num_rows and asked.num_rows:
            ids, own, x = posted["id"].to_numpy(), posted["row"].to_numpy(), _scaled(_matrix(posted["v"], dim))
            order = np.argsort(ids, kind="stable")
            ids, own, x = ids[order], own[order], np.ascontiguousarray(x[order])
            norms = np.sqrt((x * x).sum(1))
            qids, qown, q = asked["id"].to_numpy(), asked["row"].to_numpy(), _scaled(_matrix(asked["v"], dim))
            qnorms = np.sqrt((q * q).sum(1))
            for a in range(0, len(q), 256):
                rough = (q[a : a + 256] @ x.T) / norms / qnorms[a : a + 256, None]
                rough[(qids[a : a + 256, None] == ids) & (qown[a : a + 256, None] == own)] = -np.inf
                for i, near_to in enumerate(rough, a):
                    kth = np.partition(near_to, -k)[-k] if len(near_to) > k else -np.inf
                    near = np.flatnonzero((near_to >= kth - 1e-9) & (near_to > -np.inf))
                    exact = (x[near] * q[i]).sum(1) / (norms[near] * qnorms[i])  # one order of adding: equal vectors tie
                    best = np.lexsort((own[near], ids[near], -exact))[:k]
                    out.extend((int(qids[i]), int(qown[i]), int(ids[near[b]]), int(own[near[b]]), float(exact[b])) for b in best)
        columns = list(zip(*out, strict=True)) if out else ((),) * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(FOUND, columns, kinds, strict=True)})

    return run


FOUND = ("query_id", "query_row", "vec_id", "vec_row", "score")


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of vectors that take part: not null, not zero, finite."""
    v = F.col(f"`{vector}`")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("v"))
    return rows.where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0))


def neighbours(
    vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, lists: int | None = None, sample: int = 20_000,
    replicas: int = 3, border: float = 1.15, ratio: float = 1.3, beam: int = 32, block: int = 4096, most_sample: int = 200_000,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every row of ``queries`` (a condition on ``id``).

    All usable rows are indexed, in as many lists as the root of their number unless
    ``lists`` says otherwise. The centroids are fitted on ``sample`` different rows or eight
    a list, at most ``most_sample``, those with the smallest hash of id and vector; the lists
    are at most an eighth of ``most_sample``, which the driver and each task hold. A query
    reads every list within the ratio. Null, zero and non-finite vectors, and those of
    another length than the most frequent one, take no part; vectors are scaled by powers of
    two first, so no finite component is too large or small for a score. Rows that repeat an
    id are rows of their own: each is a query if its id is one, and a candidate for the
    others; ties go to the smaller id. Other columns are not read. An empty table gives no
    rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not dims:
        return empty
    dim, n = dims[0]["d"], dims[0]["count"]
    rows = rows.where(F.size("v") == dim)
    if rows.groupBy("id").count().where("count > 1").isEmpty():
        rows = rows.select("id", F.lit(0).cast("long").alias("row"), "v")
    else:  # written with their numbers, which tell rows of one id apart
        rows, _ = stored(rows.select("id", F.monotonically_increasing_id().alias("row"), "v"), "vectors")
    lists = lists or int(min(most_sample // 8, max(1, round(n**0.5))))
    sample = min(most_sample, max(sample, 8 * lists))
    got = lowest(rows.withColumn("h", F.xxhash64("id", "v")), "h", sample, n, F.first("v").alias("v")).orderBy("h").select("v").toArrow()["v"]
    index = Index.fit(_unit(_matrix(got, dim)), lists)
    sent = spark.sparkContext.broadcast(index)  # at most most_sample / 8 centroids

    schema = rows.select(F.lit(0).alias("list"), "id", "row", "v").schema
    posted = checkpoint(rows.mapInArrow(_deal(lambda u: sent.value.postings(u, border, replicas), dim), schema))

    def counted(df: DataFrame) -> np.ndarray:
        sizes = {r["list"]: r["count"] for r in df.groupBy("list").count().collect()}
        return np.array([sizes.get(i, 0) for i in range(len(index.centroids))])

    sizes, least = counted(posted), 10 * k * replicas
    asked = checkpoint(rows.where(queries).mapInArrow(_deal(lambda u: sent.value.probes(u, ratio, beam, sizes, least), dim), schema))
    own, other = (lookup((-(-n // block)).tolist())[F.col("list")] for n in (sizes, counted(asked)))
    salt = lambda count: F.pmod(F.xxhash64("id", "row"), count)
    each = lambda count: F.explode(F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1)))
    posted = posted.select("list", salt(own).alias("p"), each(other).alias("q"), "id", "row", "v")
    asked = asked.select("list", each(own).alias("p"), salt(other).alias("q"), "id", "row", "v")
    met = posted.groupBy("list", "p", "q").cogroup(asked.groupBy("list", "p", "q"))
    found = met.applyInArrow(_score(k, dim), "query_id long, query_row long, vec_id long, vec_row long, score double")
    found = found.groupBy(*FOUND[:4]).agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id", "vec_row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest found of every vector whose id is divisible by 50."""
    return neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 50 == 0)
