"""How filters interact: what each removes, doubles and alone catches in every order of application.

The sets of filters already applied form a lattice; an order of n filters is a path of n
edges through it, and what an edge removes is the same on every path. Documents are counted
by the set of filters that they fail, each such profile counts on all n * 2**(n - 1) edges
(80 for five filters), and the aggregated edges are joined to the steps of all orders.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galeria.llm.common import table

#: A filter that needs the whole table: the text is that of a document with a smaller key.
COPIES = "copies"
MOST_FILTERS = 7


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


#: Failure conditions by letter, from a non-null text.
FILTERS: dict[str, Callable[[Column], Column] | str] = {
    "A": lambda t: F.size(_words(t)) < 100,
    "B": lambda t: 100 * F.size(F.array_distinct(_words(t))) < 80 * F.size(_words(t)),
    "C": lambda t: 100 * (F.length(t) - F.length(F.regexp_replace(t, "[A-Z]+", ""))) > 10 * F.length(t),
    "D": lambda t: t.rlike("[#$%&*|]"),
    "E": COPIES,
}


def profiles(docs: DataFrame, labels: DataFrame, filters: dict = FILTERS, text: str = "text", part: str = "lang", key: str = "doc_id") -> DataFrame:
    """``part, mask, n, good, toxic``: documents by the set of filters they fail (bit i for the i-th filter).

    Texts are read once and only a digest of each moves on. Rows of one text, part and label
    are counted before they meet by their text, so a text that a third of all rows share is
    a few rows there. A null text is empty, a null part the empty string. Rows that repeat a
    key are each a document, none a copy of the others; rows without a key are never copies
    and make none. A document with several label rows has what any of them says; null or no
    labels say nothing. An empty table gives no rows.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    bits = [F.when(f(t), 1 << i).otherwise(0) for i, f in enumerate(filters.values()) if f != COPIES]
    own = sum(bits[1:], bits[0]) if bits else F.lit(0)
    rows = docs.select(
        F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        own.cast("int").alias("mask"), F.unhex(F.sha2(t, 256)).alias("digest"),
    )
    rows = rows.groupBy("key", "part", "mask", "digest").agg(F.count("*").alias("n"))
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    said = labels.groupBy(F.col(f"`{key}`").alias("key")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    rows = rows.join(said, "key", "left").fillna(0, ["good", "toxic"])
    same = rows.groupBy("digest", "mask", "part", "good", "toxic", F.col("key").isNull().alias("lost")).agg(
        F.sum("n").alias("n"), F.min(F.struct("key", "n")).alias("first")
    )
    first = F.min(F.when(~F.col("lost"), F.col("first.key"))).over(Window.partitionBy("digest"))
    originals = F.when(F.col("lost"), F.col("n")).when(F.col("first.key") == F.col("first_key"), F.col("first.n")).otherwise(0)
    same = same.withColumn("first_key", first).withColumn("originals", originals)
    copy = 1 << list(filters.values()).index(COPIES) if COPIES in filters.values() else 0
    split = F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), F.col("originals").alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(copy)).alias("mask"), (F.col("n") - F.col("originals")).alias("n")),
    ))
    out = same.select("part", "good", "toxic", split.alias("m")).groupBy("part", F.col("m.mask").alias("mask"))
    counted = lambda c: F.sum(F.when(F.col(c) == 1, F.col("m.n")).otherwise(0))
    return out.agg(F.sum("m.n").alias("n"), counted("good").alias("good"), counted("toxic").alias("toxic")).where("n > 0")


def edges(profiles: DataFrame, filters: int) -> DataFrame:
    """Counts on each lattice edge of each part: ``part, s`` (bits of the filters applied before), ``f`` (the next one), and what happens there.

    ``shapley`` sums what filter ``f`` removes over all orders: an edge lies on as many
    paths as there are orders before and after it.
    """
    rows = profiles.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit((1 << filters) - 1))))
    rows = rows.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(filters - 1)))).withColumn("bit", F.expr("shiftleft(1, f)"))
    rows = rows.where(F.col("s").bitwiseAND(F.col("bit")) == 0)
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("s")) != 0
    total = lambda condition, c="n": F.sum(F.when(condition, F.col(c)).otherwise(0))
    out = rows.groupBy("part", "s", "f").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"), total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    paths = F.array(*(F.lit(factorial(k) * factorial(filters - 1 - k)).cast("long") for k in range(filters)))
    weight = F.element_at(paths, F.bit_count("s") + 1)
    return out.withColumn("shapley", F.sum(F.col("removed") * weight).over(Window.partitionBy("part", "f")))


def steps(spark: SparkSession, letters: str) -> DataFrame:
    """``filter_order, step, s, f``: every order of the filters as a path of lattice edges."""
    rows = []
    for order in permutations(range(len(letters))):
        s = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(letters[i] for i in order), step, s, f))
            s |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, s int, f int")


def interaction_audit(docs: DataFrame, labels: DataFrame, filters: dict = FILTERS, **columns: str) -> DataFrame:
    """A row per part, order of the filters and step: documents kept, removed, redundant, failing this filter only, good and toxic ones lost, and the filter's removals over all orders.

    ``filters`` maps letters to failure conditions, of 1 to 7 filters (n! orders). Documents
    are defined as in ``profiles``, where their columns can be named. The steps (600 for five
    filters) are sent to every task; their number depends on the filters alone.
    """
    if not 1 <= len(filters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters, not {len(filters)}")
    counts = edges(profiles(docs, labels, filters, **columns), len(filters))
    paths = counts.join(F.broadcast(steps(docs.sparkSession, "".join(filters))), ["s", "f"])
    return paths.select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents in all 120 orders, by language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return interaction_audit(docs, table(spark, sf_dir, "labels"))


_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"

ORACLE_SQL = rf"""WITH l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
 d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
 w AS (SELECT doc_id, part, t, {_WORDS} AS words, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
 m AS (SELECT part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
  [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words), 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > first_id, false)] AS fails
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
 p AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
 i AS (SELECT unnest(range(1, 6)) AS i),
 o AS (SELECT [a.i, b.i, c.i, e.i, f.i] AS o FROM i a JOIN i b ON b.i <> a.i JOIN i c ON c.i NOT IN (a.i, b.i) JOIN i e ON e.i NOT IN (a.i, b.i, c.i) JOIN i f ON f.i NOT IN (a.i, b.i, c.i, e.i)),
 s AS (SELECT o, CAST(unnest(range(1, 6)) AS INT) AS step FROM o),
 e AS (SELECT p.*, array_to_string(list_transform(o, lambda k: 'ABCDE'[k]), '') AS filter_order, step, o[step] AS f,
  fails[o[step]] AS fails_here, len(list_filter(o[1:step - 1], lambda k: fails[k])) > 0 AS gone FROM p, s),
 r AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT gone AND NOT fails_here), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND fails_here), 0) AS removed,
  coalesce(sum(n) FILTER (gone AND fails_here), 0) AS redundant, coalesce(sum(n) FILTER (fails_here AND len(list_filter(fails, lambda x: x)) = 1), 0) AS unique_fails,
  coalesce(sum(good) FILTER (NOT gone AND fails_here), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails_here), 0) AS toxic_lost FROM e GROUP BY ALL)
 SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r"""
