"""Near-duplicate documents: MinHash with tensored banding, verified on full shingle sets.

A document's signature is two collections of ``m`` small hashes, each over ``k`` minhashes:
2 * m * k minhashes instead of the 2 * m * m * k that m * m independent tables of 2 * k
rows would take. Table (i, j) is keyed by the pair (A_i, B_j); a pair of documents is a
candidate if any table holds both, that is, if some A and some B agree. With similarity s
that fails with a chance of 1 - (1 - (1 - s**k)**m)**2: 7e-5 at 0.85 for k = 2, m = 8.

Rows with equal shingle sets are one class before any pairing; classes are numbered in the
order of their smallest document. In every bucket each class is first linked to the
bucket's first class (a star, never all pairs) and verified. Buckets that still span
several components are finished exactly: their classes outside the bucket's largest
component meet, through a filter on rare shingles, positions and sizes, every class they
could still be similar to; shingles that stand in the same sets count as one there. Joins by a key that many rows may share (bucket, class, shingle)
have a plain shuffle of a stored table on both sides, which adaptive execution splits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from galeria.llm.common import checkpoint, components, fresh, path_of, running, scratch, stored, table
from galeria.plans.numbering import counted

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of ``size`` words (fewer words: one shingle; none: empty)."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(size, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = _mix(out * _BASE + h[i : len(h) - n + 1 + i])
    out.sort()
    first = np.empty(len(out), bool)
    first[0] = True
    np.not_equal(out[1:], out[:-1], out=first[1:])
    return out[first]


def _signatures(size: int, k: int, m: int, seed: int):
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, 2 * m * k, np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, 2 * m * k, np.uint64)

    def keys(held: list[np.ndarray]) -> list[list[int]]:
        """The half keys of some sets, all of their minhashes over one array."""
        flat, starts = np.concatenate(held), np.cumsum([0, *map(len, held[:-1])])
        mixed = np.full((len(held), 2 * m), 1, np.uint64)
        for i in range(k):
            for j in range(2 * m):
                v = flat * a[j * k + i]
                v += b[j * k + i]
                v ^= v >> np.uint64(32)
                mixed[:, j] = _mix(mixed[:, j] * _BASE + np.minimum.reduceat(v, starts))
        return mixed.view(np.int64).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sets = [], []
            sigs: list[list[int] | None] = [None] * batch.num_rows
            held, rows, total = [], [], 0
            with np.errstate(over="ignore"):
                for row, text in enumerate(batch.column(2)):
                    s = shingles(text.as_py(), size)
                    n.append(len(s))
                    sets.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    if len(s):
                        held.append(s)
                        rows.append(row)
                        total += len(s)
                    if held and (total >= 1 << 14 or row == batch.num_rows - 1):
                        for r, sig in zip(rows, keys(held), strict=True):
                            sigs[r] = sig
                        held, rows, total = [], [], 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))],
                ["doc_id", "text_key", "n", "set_key", "sig"],
            )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), size).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["rep", "shingles"])

    return run


def _similar(n_a, n_b, both, percent: int):
    return F.lit(100) * both >= F.lit(percent) * (n_a + n_b - both)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs (a, b), those whose full sets are similar."""
    one = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    met = pairs.join(two, "b").join(one, "a")
    both = F.size(F.array_intersect("sa", "sb"))
    return met.where(_similar(F.size("sa"), F.size("sb"), both, percent)).select("a", "b")


def _text_key(text: Column) -> Column:
    """What tells two texts under one key apart; empty for null."""
    return F.coalesce(F.md5(text), F.lit(""))


def _grouped(docs: DataFrame, text: str, key: str, words: int, percent: int, k: int, m: int, seed: int) -> DataFrame:
    """A row per document: ``doc_id, text_key, n, grp, component_id, n_links``; ``grp`` is null without words or key."""
    with scratch(docs.sparkSession) as keep:
        source = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), _text_key(F.col(f"`{text}`")).alias("text_key"), F.col(f"`{text}`").alias("text"))
        signed = source.mapInArrow(_signatures(words, k, m, seed), "doc_id long, text_key string, n long, set_key binary, sig array<long>")
        signed, _ = stored(signed, "signatures")
        classes = signed.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key")
        classes = classes.agg(F.min(F.struct("doc_id", "text_key", "n", "sig")).alias("r")).select("set_key", "r.*")
        reps, _ = counted(classes, ["doc_id", "set_key"], "rep")

        # Classes that share no A or no B with another one are in no bucket with another.
        halves = reps.select("rep", F.posexplode("sig").alias("i", "h"))
        often = halves.groupBy("i", "h").agg(F.count("*").alias("c")).where("c > 1")
        sides = halves.join(often, ["i", "h"], "left_semi").groupBy("rep").agg(
            F.bool_or(F.col("i") < m).alias("x"), F.bool_or(F.col("i") >= m).alias("y")
        )
        alive, _ = stored(reps.join(sides.where("x AND y"), "rep", "left_semi").select("rep", "n", "sig"), "alive")
        keys = F.flatten(
            F.transform(F.slice("sig", 1, m), lambda x, i: F.transform(F.slice("sig", m + 1, m), lambda y, j: F.xxhash64(x, y, i * m + j)))
        )
        tables = alive.select("rep", "n", F.explode(keys).alias("bucket"))
        leads = tables.groupBy("bucket").agg(F.min("rep").alias("lead"), F.min_by("n", "rep").alias("lead_n"), F.count("*").alias("c"))
        leads = checkpoint(leads.where("c > 1").drop("c"))
        members, _ = stored(tables.join(leads, "bucket"), "buckets")

        wanted = members.select("rep").distinct()
        wanted = reps.join(wanted, "rep", "left_semi").select("rep", "doc_id", "text_key")
        sets = source.join(wanted, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]).select("rep", "text")
        sets, _ = stored(sets.mapInArrow(_sets(words), "rep long, shingles array<long>"), "sets")
        fits = F.lit(100) * F.least("n", "lead_n") >= F.lit(percent) * F.greatest("n", "lead_n")
        stars = members.where((F.col("rep") != F.col("lead")) & fits).select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
        links = checkpoint(_verified(stars, sets, percent))
        labels = components(links)

        links = checkpoint(links.union(_remaining(members, sets, labels, percent)).distinct())
        labels = components(links)

        degree = links.select("a").union(links.select(F.col("b").alias("a"))).groupBy(F.col("a").alias("rep")).agg(F.count("*").alias("n_links"))
        grp = reps.select("set_key", "rep").join(labels.withColumnRenamed("v", "rep"), "rep", "left").join(degree, "rep", "left")
        grp = grp.select("set_key", F.coalesce("comp", "rep").alias("grp"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
        first = reps.select(F.col("rep").alias("grp"), F.col("doc_id").alias("component_id"))
        of_class = checkpoint(grp.join(first, "grp"))
        out = signed.select("doc_id", "text_key", "n", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")).join(of_class, "set_key", "left")
        out = checkpoint(
            out.select("doc_id", "text_key", "n", "grp", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
        )
        keep.add(path_of(out))
    return out


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, percent: int = 80, k: int = 2, m: int = 8, seed: int = 7
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept, n_links``.

    Documents whose shingle sets have a Jaccard similarity of at least ``percent`` / 100 are
    linked; a component's id is its smallest ``key`` (integers). Null and empty texts have no
    shingles and are linked with nothing; a text of fewer than ``words`` words is one
    shingle. Each row is a document, rows that repeat a key too, whether their texts are
    equal or not; ``n_links`` counts verified links of the text's class with other classes
    on the way. A row with a null key stands for no component, and ``kept`` is null. An
    empty table gives no rows.
    """
    out = _grouped(docs, text, key, words, percent, k, m, seed)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "n_links")


def _remaining(members: DataFrame, sets: DataFrame, labels: DataFrame, percent: int, block: int = 1 << 24) -> DataFrame:
    """Links still missing: of one bucket's classes in different components, found by a shared prefix and verified.

    Shingles that stand in the same sets are one atom, whose weight is their number: a block
    that many pages share is one atom, not hundreds of shingles. With atoms ordered from
    rare to common, similar sets of n shingles share one among the first
    n - ceil(percent * n / 100) + 1 shingles of either; so no link is lost. A set that has
    ``left`` shingles from such a place on fits no partner of more than ``most`` shingles,
    so of two partners the smaller one has ``most`` >= its own size: only such entries look
    for a partner, among entries of the same atom as large as itself or larger. Sizes go in
    bands, two at most for each search. Pages of one template, unlike enough to be no links,
    thus form no pairs; other pairs are given once, at their first common atom. An atom and
    band of over ``block`` comparisons is dealt out.
    """
    named = members.join(labels.withColumnRenamed("v", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("comp", "rep").alias("comp"))
    sizes = named.groupBy("bucket", "comp").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("bucket").agg(F.count("*").alias("parts"), F.max(F.struct("c", "comp")).alias("top")).where("parts > 1")
    rest = named.join(checkpoint(mixed.select("bucket", F.col("top.comp").alias("top"))), "bucket")
    # a class outside the largest component of any of its buckets is to be finished
    rest = checkpoint(rest.groupBy("rep").agg(F.first("comp").alias("comp"), F.bool_or(F.col("comp") != F.col("top")).alias("out")))
    full = rest.join(sets, "rep")
    tokens = full.select("rep", "comp", "out", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    # sets that hold a shingle are told apart by 128 bits of a sum over them
    held_by = [F.bit_xor(F.xxhash64("rep", F.lit(k))).alias(f"h{k}") for k in (1, 2)]
    common = checkpoint(tokens.groupBy("s").agg(F.count("*").alias("f"), *held_by).where("f > 1"))
    # a set's single shingles come first in its order: their number is what it has more than the shared ones
    own = tokens.join(common, "s").repartition("rep").groupBy("rep", "comp", "out", "n", "f", "h1", "h2").agg(F.count("*").cast("int").alias("w"))
    own = own.groupBy("rep", "comp", "out", "n").agg(F.array_sort(F.collect_list(F.struct("f", "h1", "h2", "w"))).alias("atoms"))
    atoms, _ = stored(own.withColumn("shared", F.aggregate("atoms", F.lit(0), lambda t, x: t + x["w"])), "atoms")
    free = F.col("n") - F.ceil(F.col("n") * percent / 100.0) + 1 - (F.col("n") - F.col("shared"))
    before = running(F.transform("atoms", lambda x: x["w"]), lambda u, v: u + v)
    names = F.transform("atoms", lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2")))
    prefix = atoms.where(free > 0).select("rep", "comp", "out", "n", "shared", free.alias("free"), names.alias("names"), before.alias("before"))
    places = F.filter(F.arrays_zip("names", "before"), lambda z: z["before"] < F.col("free"))
    prefix = prefix.select("rep", "comp", "out", "n", "shared", "names", F.posexplode(places).alias("p", "z"))
    # from its first common atom on, a pair can share no more than either set has left
    left = F.col("shared") - F.col("z.before")
    most = F.floor(left * (100 + percent) / percent + 1e-9).cast("int") - F.col("n")
    pre = F.slice("names", F.lit(1), F.col("p"))
    prefix = prefix.select("rep", "comp", "out", "n", left.alias("left"), F.col("z.names.h1").alias("h1"), F.col("z.names.h2").alias("h2"), pre.alias("pre"), most.alias("most"))
    prefix = prefix.where(F.col("most") * 100 >= F.col("n") * percent)
    band = lambda c: F.floor(F.log(c.cast("double")) / math.log(100 / percent)).cast("int")
    prefix, _ = stored(prefix.withColumns({"band": band(F.col("n")), "to": band(F.col("most"))}), "prefixes")

    at = ["h1", "h2", "band"]
    side = lambda s: [F.col(c).alias(f"{c[0] if c != 'left' else 'l'}{s}") for c in ("comp", "n", "left", "most", "out", "pre")]
    large = prefix.select(*at, F.col("rep").alias("x"), *side("x"))
    seek = prefix.where("most >= n").select("h1", "h2", F.explode(F.sequence("band", F.least(F.col("to"), F.col("band") + 1))).alias("band"), F.col("rep").alias("y"), *side("y"))
    counts = large.groupBy(*at).agg(F.count("*").alias("u")).join(seek.groupBy(*at).agg(F.count("*").alias("v")), at)
    hot = checkpoint(counts.where(F.col("u") * F.col("v") > block).select(*at, F.least(F.col("u"), F.ceil(F.col("u") * F.col("v") / block)).alias("k")))
    if hot.isEmpty():
        met = large.join(seek, at)
    else:
        large = large.join(hot, at, "left").withColumn("salt", F.pmod(F.xxhash64("x"), F.coalesce("k", F.lit(1)))).drop("k")
        seek = seek.join(hot, at, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1))).drop("k")
        met = large.join(seek, [*at, "salt"])
    pairs = met.where(
        (F.col("cx") != F.col("cy")) & (F.col("ox") | F.col("oy")) & (F.col("ny") <= F.col("mx")) & (F.col("nx") <= F.col("my"))
        & ((F.col("nx") > F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") > F.col("y"))))
        & _similar(F.col("nx"), F.col("ny"), F.least("lx", "ly"), percent)
        & ~F.arrays_overlap("px", "py")
    )
    pairs, _ = stored(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), "pairs")
    return _weighed(pairs, atoms, percent)


def _weighed(pairs: DataFrame, atoms: DataFrame, percent: int, each: int = 1 << 18) -> DataFrame:
    """Of distinct pairs (a, b), those whose sets' atoms are similar.

    Classes are dealt into as many groups as make squares of about ``each`` pairs, and a
    square gets the atoms of its two groups once, not once a pair.
    """
    n = pairs.count()
    groups = max(1, math.ceil(math.sqrt(n / each)))
    of = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(groups)).cast("int")
    squares = pairs.select(of("a").alias("g"), of("b").alias("h"), "a", "b")
    wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct()
    held = atoms.join(wanted, "rep", "left_semi").select("rep", "n", F.col("atoms.h1").alias("h1"), F.col("atoms.h2").alias("h2"), F.col("atoms.w").alias("w"), of("rep").alias("own"))
    all_ = F.sequence(F.lit(0), F.lit(groups - 1))
    places = F.array_distinct(F.concat(F.transform(all_, lambda o: F.struct(F.col("own").alias("g"), o.alias("h"))), F.transform(all_, lambda o: F.struct(o.alias("g"), F.col("own").alias("h")))))
    held = held.withColumn("z", F.explode(places)).select("z.g", "z.h", "rep", "n", "h1", "h2", "w")
    return squares.groupBy("g", "h").cogroup(held.groupBy("g", "h")).applyInArrow(_linked(percent), "a long, b long")


def _linked(percent: int):
    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        a, b = pairs["a"].to_numpy(), pairs["b"].to_numpy()
        if not len(a):
            return pa.table({"a": a, "b": b})
        flat = lambda c: sets[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        reps, size, w = sets["rep"].to_numpy(), sets["n"].to_numpy(), flat("w").astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(sets["w"]).to_numpy().astype(np.int64))])
        both = np.empty(len(w), [("h1", np.int64), ("h2", np.int64)])
        both["h1"], both["h2"] = flat("h1"), flat("h2")
        atom = np.unique(both, return_inverse=True)[1]
        order = np.argsort(reps, kind="stable")
        x, y = (order[np.searchsorted(reps, v, sorter=order)] for v in (a, b))
        by = np.argsort(x, kind="stable")
        starts = np.flatnonzero(np.diff(x[by], prepend=-1))
        mark, shared = np.zeros(atom.max(initial=0) + 1, np.int64), np.zeros(len(a), np.int64)
        for rows in np.split(by, starts[1:]):  # a class and all its partners at a time
            own = slice(ends[x[rows[0]]], ends[x[rows[0]] + 1])
            mark[atom[own]] = w[own]
            sums = np.concatenate([[0], np.cumsum(mark[np.concatenate([atom[ends[j] : ends[j + 1]] for j in y[rows]])])])
            stop = np.cumsum(ends[y[rows] + 1] - ends[y[rows]])
            shared[rows] = sums[stop] - sums[np.concatenate([[0], stop[:-1]])]
            mark[atom[own]] = 0
        keep = 100 * shared >= percent * (size[x] + size[y] - shared)
        return pa.table({"a": a[keep], "b": b[keep]})

    return run


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets are at least 85 % similar."""
    out = near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


ORACLE_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + 2], ' ') AS sh
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM g UNION SELECT r.a, g.b FROM reach r JOIN g ON g.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, least(doc_id, coalesce(m, doc_id)) = doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def deduplicated(
    docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, percent: int = 80, k: int = 2, m: int = 8, seed: int = 7
) -> DataFrame:
    """``docs`` with one document of each group: the smallest key's, once.

    Null and empty texts and those without words are in no group: each stays, once for a
    key and text. Rows without a key all stay. Under one key unlike texts are unlike
    documents: each group keeps its own. Other columns of rows equal in key and text are
    those of any one of them. An empty table gives no rows.
    """
    found = _grouped(docs, text, key, words, percent, k, m, seed)
    id_, text_key = fresh(docs, "kept_id"), fresh(docs, "kept_text")
    first = found.where("grp IS NOT NULL").groupBy("grp").agg(F.min(F.struct("doc_id", "text_key")).alias("r")).select("r.*")
    kept = first.unionByName(found.where("grp IS NULL AND doc_id IS NOT NULL").select("doc_id", "text_key").distinct())
    kept = kept.select(F.col("doc_id").alias(id_), F.col("text_key").alias(text_key))
    keyed = docs.withColumns({id_: F.col(f"`{key}`").cast("long"), text_key: _text_key(F.col(f"`{text}`"))})
    once = keyed.join(kept, [id_, text_key], "left_semi").dropDuplicates([id_, text_key]).drop(id_, text_key)
    return once.union(docs.where(F.col(f"`{key}`").isNull()))
