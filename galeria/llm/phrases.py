"""Collocations: frequent phrases of 2 to 5 words by level-wise passes, scored by their weakest cut.

A phrase can only be frequent if both of its overlapping sub-phrases are. Each pass reads
the texts, takes the phrases of the level before from broadcast filters and counts what is
left, in blocks within tasks before anything is shuffled. The filters are bits of bounded
size (Bloom filters): a false positive costs a counted phrase, which the exact count drops
again, so results do not depend on their size. Cuts are scored by joins of the level tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galeria.llm.common import scratch, stored, table
from galeria.plans.shared import partitions

#: Bytes of a text by what they are here: A-Z in lower case, breaks as one byte that UTF-8 has not.
BREAK = b"\xff"
BYTES = bytes(b + 32 if 65 <= b <= 90 else 255 if chr(b) in ".,;:!?\n\x0b\x0c\r" else b for b in range(256))
#: Bytes of text in one block of a pass, bits for each phrase of a filter, and a filter's bits at most.
BLOCK, EACH, MOST_BITS = 4 << 20, 16, 1 << 26
PRIME, FIRST, SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _seed(part: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(part.encode(), seed=11))


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w, seed=7) for w in words], np.uint64)


def places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each hash in a filter of so many bits, a power of two."""
    a = h * FIRST
    a ^= a >> np.uint64(31)
    b = a * SECOND
    b ^= b >> np.uint64(29)
    mask = np.uint64(bits - 1)
    return a & mask, b & mask


def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    found = np.ones(len(h), bool)
    for place in places(h, 8 * len(bits)):
        found &= (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return found


def _blocks(parts: list[str], texts: list[str | None]) -> Iterator[tuple[str, list[bytes]]]:
    """The texts of each part as tokens, in blocks of about ``BLOCK`` bytes; breaks stand between pieces and texts."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    tokens = lambda p: (p, (b" " + BREAK + b" ").join(held.pop(p)).replace(BREAK, b" " + BREAK + b" ").split())
    for part, text in zip(parts, texts, strict=True):
        if text:
            held.setdefault(part, []).append(text.encode("utf-8", "surrogatepass").translate(BYTES))
            size[part] = size.get(part, 0) + len(text)
            if size[part] > BLOCK:
                yield tokens(part)
                size[part] = 0
    for part in list(held):
        yield tokens(part)


def _phrases(tokens: list[bytes], part: str, filters: list[np.ndarray]) -> tuple[list[bytes], np.ndarray, int]:
    """The distinct phrases of ``len(filters) + 1`` words all of whose shorter ones may be frequent, their counts, and the number of words."""
    coded = pa.array(tokens, pa.binary()).dictionary_encode()
    words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    is_word = np.array([w != BREAK for w in words], bool)[codes] if words else np.zeros(0, bool)
    total, k = int(is_word.sum()), len(filters) + 1
    if k == 1:
        counts = np.bincount(codes, minlength=len(words))
        keep = [i for i, w in enumerate(words) if w != BREAK]
        return [words[i] for i in keep], counts[keep], total
    h, seed = _hashes(words), _seed(part)
    run, ok = h[codes], is_word
    for level, bits in enumerate(filters, 1):
        ok = ok.copy()
        at = np.flatnonzero(ok)
        ok[at] = has(bits, run[at] ^ seed)
        ok = ok[:-1] & ok[1:]
        run = run[:-1] * PRIME + h[codes[level:]]
    at = np.flatnonzero(ok)
    same = codes[at]
    for j in range(1, k):
        same = pd.factorize(same * len(words) + codes[at + j])[0].astype(np.int64)
    counts = np.bincount(same) if len(same) else np.zeros(0, np.int64)
    first = np.zeros(len(counts), np.int64)
    first[same[::-1]] = at[::-1]
    return [b" ".join(tokens[i : i + k]) for i in first.tolist()], counts, total


def _pass(shared: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [b.value for b in shared]
        for batch in batches:
            for part, tokens in _blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                phrases, counts, total = _phrases(tokens, part, filters)
                if not filters:  # the number of words, under no phrase
                    phrases, counts = [*phrases, None], [*counts.tolist(), total]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(phrases), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], ["part", "phrase", "f"]
                )

    return run


def _marks(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[bytes, np.uint64] = {}
            h = np.zeros(batch.num_rows, np.uint64)
            seeds: dict[str, np.uint64] = {}
            for i, (part, phrase) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                run = 0
                for w in phrase.encode("utf-8", "surrogatepass").split(b" "):
                    if w not in known:
                        known[w] = xxhash.xxh64_intdigest(w, seed=7)
                    run = (run * int(PRIME) + known[w]) & (2**64 - 1)
                if part not in seeds:
                    seeds[part] = _seed(part)
                h[i] = np.uint64(run) ^ seeds[part]
            place = np.unique(np.concatenate(places(h, bits)))
            cells, first = np.unique(place >> np.uint64(6), return_index=True)
            one = np.uint64(1) << (place & np.uint64(63))
            masks = np.bitwise_or.reduceat(one, first) if len(first) else one
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int64)), pa.array(masks.view(np.int64))], ["cell", "mask"])

    return run


def bit_filter(level: DataFrame, most_bits: int = MOST_BITS) -> np.ndarray:
    """Bits of the phrases of a level: 16 each, up to ``most_bits``; only these come to the driver."""
    bits = 1 << 10
    while bits < most_bits and bits < EACH * level.count():
        bits *= 2
    marks = level.select("part", "phrase").mapInArrow(_marks(bits), "cell long, mask long").groupBy("cell").agg(F.bit_or("mask").alias("mask"))
    got, out = marks.toArrow(), np.zeros(bits >> 6, np.int64)
    out[got["cell"].to_numpy()] = got["mask"].to_numpy()
    return out.view(np.uint8)


def levels(docs: DataFrame, text: str, part: str, least: int, longest: int, most_bits: int = MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """Level tables as one, ``part, phrase, k, f`` of all phrases of 1 to ``longest`` words that occur ``least`` times, and the words of each part, ``part, n``.

    Written to the shared folder, level by level.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("und")).alias("part"), F.col(f"`{text}`").alias("t"))
    shared, tables, words = [], [], None
    for k in range(1, longest + 1):
        counts = rows.mapInArrow(_pass(shared), "part string, phrase string, f long").groupBy("part", "phrase").agg(F.sum("f").alias("f"))
        held, _ = stored(counts.where(F.col("phrase").isNull() | (F.col("f") >= least)), f"phrases{k}")
        if k == 1:
            words = held.where("phrase IS NULL").select("part", F.col("f").alias("n"))
        level = held.where("phrase IS NOT NULL")
        tables.append(level.withColumn("k", F.lit(k)))
        if k == longest or level.isEmpty():
            break
        shared.append(spark.sparkContext.broadcast(bit_filter(level, most_bits)))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out, words


def scored(grams: DataFrame, words: DataFrame) -> DataFrame:
    """``part, phrase, k, a, l, r, n, score`` of the phrases of two words and more: the cut that scores lowest, the first of equals.

    Scores are whole numbers by decimals of 38 digits: counts may reach 10**17.
    """
    rows = grams.where("k > 1").select("part", "phrase", "k", F.col("f").alias("a")).join(words, "part")
    cuts = rows.withColumn("cut", F.explode(F.expr("sequence(1, k - 1)")))
    cuts = cuts.withColumns({"left": F.expr("substring_index(phrase, ' ', cut)"), "right": F.expr("substring_index(phrase, ' ', cut - k)")})
    side = lambda name, count: grams.select("part", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(side("left", "l"), ["part", "left"]).join(side("right", "r"), ["part", "right"])
    big = lambda c: F.col(c).cast("decimal(17,0)")
    cuts = cuts.withColumns({"over": F.lit(1000).cast("decimal(4,0)") * big("a") * big("n"), "under": big("l") * big("r")})
    cuts = cuts.withColumn("score", F.expr("over div under"))
    low = F.min(F.struct("score", "cut", "l", "r")).alias("c")
    return cuts.groupBy("part", "phrase", "k", "a", "n").agg(low).select("part", "phrase", "k", "a", "c.l", "c.r", "n", "c.score")


def outside(phrases: DataFrame, percent: int = 100) -> DataFrame:
    """The phrases that stand in no longer one with at least ``percent`` percent of their count.

    Counts never grow with a phrase, so if a longer one covers a phrase, one that is longer
    by a single word does.
    """
    subs = F.array(F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring_index(phrase, ' ', 1 - k)"))
    over = phrases.where("k > 2").select("part", F.explode(subs).alias("phrase"), F.col("a").alias("f"))
    over = over.groupBy("part", "phrase").agg(F.max("f").alias("f"))
    rows = phrases.join(over, ["part", "phrase"], "left")
    return rows.where(F.col("f").isNull() | (F.col("f") * 100 < F.col("a") * percent)).drop("f")


def best(phrases: DataFrame, most: int) -> DataFrame:
    """The first ``most`` phrases of each part, with their rank: first in slices of a part, then of the slices' best."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    slices = F.pmod(F.xxhash64("phrase"), F.lit(partitions(phrases)))
    rank = F.row_number()
    rows = phrases.withColumn("slice", slices)
    rows = rows.withColumn("rank", rank.over(Window.partitionBy("part", "slice").orderBy(*order))).where(F.col("rank") <= most)
    return rows.withColumn("rank", rank.over(Window.partitionBy("part").orderBy(*order))).where(F.col("rank") <= most).drop("slice")


def collocations(
    docs: DataFrame, text: str = "text", part: str = "lang", least: int = 100, longest: int = 5, percent: int = 100, most: int | None = 2000, most_bits: int = MOST_BITS
) -> DataFrame:
    """``part, rank, phrase, a, l, r, n, score``: phrases of 2 to ``longest`` words that occur ``least`` times, by the score of their weakest cut.

    Words are lower-cased in A-Z only; phrases stay within the pieces between ``.,;:!?`` and
    line ends, and overlapping occurrences all count. A null text is empty, a null part
    ``und``; texts without words add nothing; repeated rows are documents of their own;
    texts are read whole, whatever their length; an empty table gives no rows. ``most`` is
    the length of each part's report, None for all phrases (without ranks).
    """
    grams, words = levels(docs, text, part, least, longest, most_bits)
    found = outside(scored(grams, words), percent)
    columns = ["part", "phrase", "a", "l", "r", "n", "score"]
    return found.select(*columns) if most is None else best(found, most).select("part", "rank", *columns[1:])


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language over all documents."""
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    with scratch(spark) as keep:
        out, path = stored(collocations(docs), "collocations")
        keep.add(path)
    return out.withColumnRenamed("part", "lang").withColumn("rank", F.col("rank").cast("long"))


_GRAMS = " UNION ALL ".join(
    f"SELECT lang, list_aggregate(list_slice(w, i, i + {k - 1}), 'string_agg', ' ') AS phrase, {k} AS k FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM s WHERE len(w) >= {k})"
    for k in range(1, 6)
)

ORACLE_SQL = rf"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
 p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
 s AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
 g AS ({_GRAMS}),
 c AS (SELECT lang, phrase, k, count(*) AS f FROM g GROUP BY ALL),
 n AS (SELECT lang, sum(f) AS n FROM c WHERE k = 1 GROUP BY 1),
 a AS (SELECT * FROM c WHERE k > 1 AND f >= 100),
 x AS (SELECT lang, phrase, k, f, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM a),
 y AS (SELECT x.lang, x.phrase, x.k, x.f AS a, l.f AS l, r.f AS r, n.n, cut, CAST(1000 AS HUGEINT) * x.f * n.n // (CAST(l.f AS HUGEINT) * r.f) AS score FROM x JOIN n ON n.lang = x.lang
  JOIN c l ON l.lang = x.lang AND l.k = cut AND l.phrase = array_to_string(w[1:cut], ' ') JOIN c r ON r.lang = x.lang AND r.k = x.k - cut AND r.phrase = array_to_string(w[cut + 1:], ' ')),
 z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
 o AS (SELECT z.* FROM z WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.lang = z.lang AND a.k > z.k AND 100 * a.f >= 100 * z.a AND contains(' ' || a.phrase || ' ', ' ' || z.phrase || ' '))),
 q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
 SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM q WHERE rank <= 2000"""
