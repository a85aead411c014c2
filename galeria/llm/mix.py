"""Mixing sources to target weights, by packed blocks and drawn slots.

Each source's documents, in the order of (doc_id, size), form one stream of words that is
packed into blocks of a fixed length. Source counts of every output shard are multinomial
draws from what is left of the sources' quotas; a source's draws, counted through all
shards, map through pseudorandom permutations of its block numbers, one per round over the
blocks, so no block comes a second time before all have come once; a source's last draw is
cut to the words its target still asks. Slots and blocks then meet in a join by (source,
block number).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galeria.llm.common import fresh, stored, table
from galeria.llm.shard import _mixed, permute
from galeria.plans.shared import partitions

# Weights of the sources by code point, repeating; the share of all words; the most repeats.
WEIGHTS, SHARE, REPEATS = (5.0, 2.0, 1.0), 1.5, 2


def word_count(text: Column) -> Column:
    """How many words ``[^\\x20\\x09-\\x0D]+`` a text has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> list[float]:
    """Words asked of each source: by weight, none above ``repeats`` times its size, the excess reshared."""
    caps = [repeats * s for s in sizes]
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, left, free = [0.0] * len(sizes), share * sum(sizes), [i for i, c in enumerate(caps) if c > 0]
    while free:
        level = left / sum(w[i] for i in free)
        over = {i for i in free if w[i] * level >= caps[i]}
        if not over:
            for i in free:
                out[i] = w[i] * level
            break
        for i in sorted(over):
            out[i], left = float(caps[i]), left - caps[i]
        free = [i for i in free if i not in over]
    return out


def round_key(seed: int, source: int, rounds: np.ndarray | int) -> np.ndarray:
    """The key of a source's permutation in a round."""
    return (np.uint64(seed) << np.uint64(40)) + (np.uint64(source) << np.uint64(8)) + np.asarray(rounds, np.uint64)


def quotas(sizes: list[int], wanted: list[float], block: int, repeats: int = REPEATS, seed: int = 0) -> list[tuple[int, int, int]]:
    """(blocks, draws, words of the last draw) of each source, so that it takes its target, rounded to words.

    Whole rounds take all of its words; the rest goes by blocks in the order of the next
    round's permutation, the last of them cut. A stream's last block may be short: its place
    in that order, which the inverse permutation tells, decides how many draws there are.
    """
    size = np.array(sizes, np.int64)
    target = np.minimum([round(w) for w in wanted], repeats * size).astype(np.int64)
    n = -(-size // block)
    rounds, rest = np.divmod(target, np.maximum(size, 1))
    tail = size - (n - 1) * block
    draws, last = rounds * n, np.full(len(size), block, np.int64)
    at = np.flatnonzero(rest > 0)
    if len(at):
        key = round_key(seed, 0, rounds[at]) + (at.astype(np.uint64) << np.uint64(8))
        short = permute(n[at] - 1, n[at], key, inverse=True).astype(np.int64)
        words = lambda q: block * q - np.where(short < q, block - tail[at], 0)
        q = -(-rest[at] // block)
        q = np.where(words(q) < rest[at], -(-(rest[at] + block - tail[at]) // block), q)
        draws[at] += q
        last[at] = rest[at] - words(q - 1)
    return list(zip(n.tolist(), draws.tolist(), last.tolist(), strict=True))


def shard_counts(draws: list[int], slots: int, seed: int | list[int]) -> Iterator[np.ndarray]:
    """Each shard's source counts: multinomial over the quotas' rests, what exceeds a rest is drawn again."""
    rng, rest = np.random.default_rng(seed), np.array(draws, np.int64)
    while rest.sum():
        counts, n = np.zeros_like(rest), min(slots, int(rest.sum()))
        while n:
            free = rest - counts
            counts = np.minimum(rest, counts + rng.multinomial(n, free / free.sum()))
            n = min(slots, int(rest.sum())) - int(counts.sum())
        rest = rest - counts
        yield counts


def _slots(shared, block: int, slots: int, seed: int):
    """Groups of shards (first shard, first draws and draws of the sources) to slots; ``shared`` has the quotas."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quota = shared.value
        for b in rows:
            for shard, used, counts in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                used, counts = (c.values.to_numpy().astype(np.int64) for c in (used, counts))
                for at, own in enumerate(shard_counts(counts, slots, [seed, 1, shard])):
                    source = np.repeat(np.arange(len(own)), own)
                    slot = np.arange(len(source))
                    draw = used[source] + slot - np.repeat(np.cumsum(own) - own, own)
                    n, all_, last = quota[:, source]
                    rounds, place = np.divmod(draw, n)
                    index = permute(place, n, round_key(seed, 0, rounds) + (source.astype(np.uint64) << np.uint64(8)))
                    most = np.where(draw == all_ - 1, last, block)
                    used += own
                    columns = (np.full(len(source), shard + at), slot, source, rounds, index, most)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c.astype(np.int64)) for c in columns], ["shard", "slot", "source_index", "round", "block", "most"]
                    )

    return run


class Mixture:
    """The mixture of ``docs``: its packed streams and its drawn slots.

    ``rows``: documents with ``size``, ``source_index``, ``part``, ``place`` (the row's
    identity) and ``first_word`` in its source's stream. ``slots``: (shard, slot,
    source_index, round, block, most), ``most`` words of the block being taken. Every shard
    but the last has ``slots`` slots. Shards are drawn in tasks, by at most ``groups``
    groups; the groups' source counts, drawn on the driver, are at most 4 million numbers. Sources are at most
    ``max_sources``, a few numbers each on the driver; of over ``sent_sources`` these meet the rows by a shuffle. Null sources are a source of their
    own, the last; null and empty texts have no words and are never taken; repeated rows
    each have a place in the stream. An empty table has no sources and no slots.
    """

    def __init__(
        self, docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", block: int = 64,
        slots: int = 4096, seed: int = 0, keep: list[str] | None = None, max_sources: int = 1_000_000, groups: int = 4096, sent_sources: int = 100_000,
    ) -> None:
        spark = docs.sparkSession
        self.block, self.names = block, {c: fresh(docs, c) for c in ("size", "source_index", "part", "place", "first_word", "arrival")}
        size, index, part, place, first, arrival = self.names.values()
        kept = [f"`{c}`" for c in (docs.columns if keep is None else dict.fromkeys([*keep, source, key]))]
        sized = docs.withColumn(size, word_count(F.col(f"`{text}`"))).select(*kept, size)
        order = [F.col(f"`{source}`").asc_nulls_last(), F.col(f"`{key}`"), F.col(size)]
        dealt = sized.withColumn(arrival, F.monotonically_increasing_id()).repartitionByRange(partitions(docs), *order, arrival)
        dealt = dealt.sortWithinPartitions(*order, arrival).drop(arrival)
        at = F.monotonically_increasing_id()
        dealt = dealt.withColumn(part, F.shiftright(at, 33)).withColumn(place, at.bitwiseAND(F.lit((1 << 33) - 1)))
        rows, self.path = stored(dealt, "mix")

        sums = rows.groupBy(F.col(f"`{source}`").alias("s"), F.col(part).alias("p")).agg(F.sum(size).alias("n"))
        if sums.select("s").distinct().count() > max_sources:
            raise ValueError(f"more than {max_sources} sources")
        got = sums.toArrow()  # at most partitions + sources rows
        sums = list(zip(*(got[c].to_pylist() for c in "spn"), strict=True))
        self.sources = sorted({s for s, _, _ in sums}, key=lambda s: (s is None, s or ""))
        number = {s: i for i, s in enumerate(self.sources)}
        starts, sizes = [], [0] * len(self.sources)
        for s, p, words in sorted(sums, key=lambda r: (number[r[0]], r[1])):
            starts.append((s, number[s], p, sizes[number[s]]))
            sizes[number[s]] += words
        self.sizes, self.targets = sizes, targets(sizes)
        quota = quotas(sizes, self.targets, block, seed=seed)
        few = len(sums) <= sent_sources
        self.sent = F.broadcast if few else (lambda df: df.hint("merge"))

        kind = rows.schema[source].dataType.simpleString()
        columns = list(zip(*starts, strict=True)) if starts else [(), (), (), ()]
        types = (got.schema.field("s").type, pa.int64(), pa.int64(), pa.int64())
        starts = spark.createDataFrame(pa.table({c: pa.array(v, t) for c, v, t in zip(("s", "i", "p", "start"), columns, types, strict=True)}), f"s {kind}, i long, p long, start long")
        narrow = rows.select(F.col(f"`{source}`").alias("s"), F.col(part).alias("p"), F.col(place).alias("at"), F.col(key).alias("key"), F.col(size).alias("n"))
        narrow = narrow.join(self.sent(starts), narrow["s"].eqNullSafe(starts["s"]) & (narrow["p"] == starts["p"])).select(narrow["p"], "at", "key", "n", "i", "start")
        before = F.sum("n").over(Window.partitionBy("p", "i").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
        self.narrow = narrow.withColumn("first", F.col("start") + F.coalesce(before, F.lit(0))).drop("start")
        self.rows = rows

        draws = [d for _, d, _ in quota]
        shards = -(-sum(draws) // slots)
        together = -(-shards // max(1, min(groups, (1 << 22) // max(1, len(sizes)))))  # shards of a group
        plan, used = [], np.zeros(len(sizes), np.int64)
        for group, counts in enumerate(shard_counts(draws, slots * together, [seed, 0]) if shards else ()):
            plan.append((group * together, used, counts))
            used = used + counts
        tasks = max(1, min(len(plan), partitions(docs)))
        lists = (pa.array([p[k] for p in plan], pa.list_(pa.int64())) for k in (1, 2))
        plan = pa.table({"shard": pa.array([p[0] for p in plan], pa.int64()), **dict(zip(("used", "counts"), lists, strict=True))})
        plan = spark.createDataFrame(plan, "shard long, used array<long>, counts array<long>").repartition(tasks, "shard")
        shared = spark.sparkContext.broadcast(np.array(quota, np.int64).reshape(-1, 3).T)  # three numbers a source
        kinds = "shard long, slot long, source_index long, round long, block long, most long"
        self.slots = plan.mapInArrow(_slots(shared, block, slots, seed), kinds)

    def pieces(self) -> DataFrame:
        """One row per document and block it lies in: p, at, key, n, i, block, words lo to hi of the document."""
        b = self.block
        last = F.expr(f"(first + n - 1) div {b}")
        blocks = F.when(F.col("n") > 0, F.sequence(F.expr(f"first div {b}"), last))
        out = self.narrow.select("*", F.explode_outer(blocks).alias("block"))
        lo = F.greatest(F.col("block") * b - F.col("first"), F.lit(0))
        hi = F.least(F.col("block") * b + b - F.col("first"), F.col("n"))
        within = F.greatest(F.col("first") - F.col("block") * b, F.lit(0))  # words of the block before the document's
        return out.withColumns({"lo": lo, "hi": hi, "within": within})

    def taken(self) -> DataFrame:
        """Every document row with the words that the mixture takes of it, repeats counted."""
        whole = F.col("most") == self.block
        times = self.slots.groupBy("source_index", "block").agg(F.count_if(whole).alias("times"), F.coalesce(F.max(F.when(~whole, F.col("most"))), F.lit(0)).alias("cut"))
        times = times.withColumnRenamed("source_index", "i").hint("merge")  # grows with the words: never to be broadcast
        met = self.pieces().join(times, ["i", "block"], "left")
        own = F.col("hi") - F.col("lo")  # of a cut block, the words before its cut
        words = F.sum(F.coalesce(own * F.col("times") + F.greatest(F.lit(0), F.least(own, F.col("cut") - F.col("within"))), F.lit(0)))
        return met.groupBy("p", "at", "key", "n", "i").agg(words.alias("taken"))

    def documents(self, text: str, n_chars: str | None, columns: list[str]) -> DataFrame:
        """The mixture as documents: one row per document and round that takes words of it.

        A row's text is the document's if the round takes all its words, else the taken
        runs of words as they stand, joined by single spaces.
        """
        drawn = self.slots.select(F.col("source_index").alias("i"), "block", "round", "most").hint("merge")
        met = self.pieces().join(drawn, ["i", "block"]).withColumn("hi", F.least(F.col("hi"), F.col("lo") + F.col("most") - F.col("within")))
        met = met.where("hi > lo").groupBy("p", "at", "n", "round")
        part, place = self.names["part"], self.names["place"]
        runs = fresh(self.rows, "runs")
        met = met.agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("runs"), F.sum(F.col("hi") - F.col("lo")).alias("got"))
        met = met.select(F.col("p").alias(part), F.col("at").alias(place), F.when(F.col("got") < F.col("n"), F.col("runs")).alias(runs))
        rows = self.rows.join(met.hint("merge"), [part, place])
        cut = cut_words(F.col(f"`{text}`"), F.col(runs))
        rows = rows.withColumn(text, F.when(F.col(runs).isNull(), F.col(f"`{text}`")).otherwise(cut))
        if n_chars:
            rows = rows.withColumn(n_chars, F.length(f"`{text}`").cast(rows.schema[n_chars].dataType))
        return rows.select(*(f"`{c}`" for c in columns))


def cut_words(text: Column, runs: Column) -> Column:
    """The runs of words [lo, hi) of a text with single spaces between runs; runs that touch stand as in the text."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))

    def cut(w: Column) -> Column:
        run = lambda r: F.array_join(F.slice(w, (r["lo"] + 1).cast("int"), (r["hi"] - r["lo"]).cast("int")), "")
        return F.array_join(F.transform(runs, lambda r: F.rtrim(run(r), F.lit(" \t\n\x0b\x0c\r"))), " ")

    return F.transform(F.array(words), cut)[0]  # so the text is split once, not once for each run


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, its source's size and target, and the words taken of it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixture = Mixture(docs, keep=["doc_id", "source"])
    sources = pa.table({"i": pa.array(range(len(mixture.sizes)), pa.int64()), "source_size": pa.array(mixture.sizes, pa.int64()), "target": pa.array(mixture.targets, pa.float64())})
    sources = spark.createDataFrame(sources, "i long, source_size long, target double")
    return mixture.taken().join(mixture.sent(sources), "i").select(
        F.col("key").alias("doc_id"), F.col("n").alias("size"), "source_size", "target", "taken"
    )


_KEY = "((i::UHUGEINT * 256 + rounds::UHUGEINT + (k + 1)::UHUGEINT * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT)"


def _network(rounds: int = 6) -> str:
    """SQL: one pass of the sources' places ``w(i, x, v)`` through their Feistel networks."""
    inner = "SELECT w.i, x, v // side AS a, v % side AS b, side FROM w JOIN dim ON dim.i = w.i WHERE step = 0 OR v >= blocks"
    for k in range(rounds):
        inner = f"SELECT z.i, x, b AS a, xor(a, f[{k + 1}][CAST(b AS INT) + 1]) AS b, side FROM ({inner}) z JOIN fs ON fs.i = z.i"
    return f"SELECT i, x, a * side + b AS v, 1 AS step FROM ({inner})"


ORACLE_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n FROM documents),
s AS (SELECT source, sum(n)::BIGINT AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
weighed AS (SELECT *, list_extract(CAST([5, 2, 1] AS DOUBLE[]), CAST(i % 3 + 1 AS INT)) AS w, 2.0::DOUBLE * size AS cap, (SELECT 1.5::DOUBLE * sum(size) FROM s) AS all_ FROM s),
levels AS (
  SELECT *, (all_ - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
capped AS (SELECT *, bool_and(w * level >= cap) OVER (ORDER BY cap / w, i) AS full_ FROM levels),
aims AS (SELECT *, CASE WHEN full_ THEN cap ELSE w * (SELECT first(level ORDER BY cap / w, i) FROM capped WHERE NOT full_) END AS target FROM capped),
dim AS MATERIALIZED (
  SELECT *, words // size AS rounds, words % size AS rest, size - (blocks - 1) * 64 AS tail, CAST(pow(2, greatest(1, ceil(log2(greatest(blocks, 2)) / 2 + 1e-9))) AS BIGINT) AS side
  FROM (SELECT source, i, size, target, least(CAST(round_even(target, 0) AS BIGINT), 2 * size) AS words, (size + 63) // 64 AS blocks FROM aims) WHERE size > 0),
rk AS ({_mixed(f"(SELECT i, side, k, {_KEY} AS z FROM dim, range(6) x(k))", "z", "i, side, k", "q")}),
fx AS ({_mixed("(SELECT i, k, b, side, (q + b::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM rk, LATERAL (SELECT unnest(range(side)) AS b))", "z", "i, k, b, side", "y")}),
fs AS MATERIALIZED (SELECT i, list(l ORDER BY k) AS f FROM (SELECT i, k, list(CAST(y % side::UHUGEINT AS BIGINT) ORDER BY b) AS l FROM fx GROUP BY i, k) GROUP BY i),
w AS (SELECT i, x, x AS v, 0 AS step FROM dim, LATERAL (SELECT unnest(range(blocks)) AS x) WHERE rest > 0 UNION ALL {_network()}),
placed AS MATERIALIZED (SELECT w.i, x, v FROM w JOIN dim ON dim.i = w.i WHERE step = 1 AND v < blocks),
short AS (SELECT dim.*, coalesce(x, 0) AS place FROM dim LEFT JOIN placed p ON p.i = dim.i AND p.v = dim.blocks - 1),
one AS (SELECT *, (rest + 63) // 64 AS q FROM short),
two AS (SELECT * EXCLUDE q, CASE WHEN 64 * q - CASE WHEN place < q THEN 64 - tail ELSE 0 END < rest THEN (rest + 64 - tail + 63) // 64 ELSE q END AS q FROM one),
cut AS (SELECT *, rest - (64 * (q - 1) - CASE WHEN place < q - 1 THEN 64 - tail ELSE 0 END) AS last FROM two),
drawn AS (SELECT p.i, p.v AS block, CASE WHEN p.x = q - 1 THEN last ELSE 64 END AS most FROM placed p JOIN cut ON cut.i = p.i WHERE p.x < q),
where_ AS (SELECT row, doc_id, n, d.source, coalesce(sum(n) OVER (PARTITION BY d.source ORDER BY doc_id, n, row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM d),
pieces AS (SELECT row, i, first, n, unnest(range(first // 64, (first + n - 1) // 64 + 1)) AS block FROM where_ JOIN cut ON cut.source IS NOT DISTINCT FROM where_.source WHERE n > 0),
part AS (SELECT row, sum(greatest(0, least(first + n, pieces.block * 64 + most) - greatest(first, pieces.block * 64))) AS got FROM pieces JOIN drawn ON drawn.i = pieces.i AND drawn.block = pieces.block GROUP BY row)
SELECT doc_id, n AS size, aims.size AS source_size, aims.target, CAST(coalesce(cut.rounds, 0) * n + coalesce(got, 0) AS BIGINT) AS taken
FROM where_ JOIN aims ON aims.source IS NOT DISTINCT FROM where_.source LEFT JOIN cut ON cut.i = aims.i LEFT JOIN part USING (row)
"""


def mix_documents(docs: DataFrame, text: str = "text", source: str = "source", n_chars: str | None = "n_chars", **options) -> DataFrame:
    """The mixture of ``docs`` as documents with the same columns; see ``Mixture`` for odd rows."""
    has = n_chars if n_chars in docs.columns else None
    return Mixture(docs, text, source, **options).documents(text, has, docs.columns)
