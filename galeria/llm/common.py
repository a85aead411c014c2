"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galeria.plans.shared import checkpoint, components, discard, fresh, path_of, scratch, shared_dir, stored

__all__ = ["ascii_lower", "checkpoint", "components", "discard", "fresh", "lowest", "path_of", "running", "scratch", "shared_dir", "stored", "table"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; null stays null. Texts of ASCII take the shorter way."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def lowest(rows: DataFrame, h: str, most: int, about: int, *values: Column) -> DataFrame:
    """``h`` and ``values`` of the groups with the ``most`` smallest hashes ``h``: a bounded sample of the distinct hashes.

    A cut keeps larger hashes out of the shuffle. It starts from ``about`` rows as if all
    were distinct, and is widened by what it finds until it holds enough, so a hash that
    very many rows share changes nothing of what is taken.
    """
    share = 1.25 * most / max(1, about)
    while True:
        low = rows if share >= 1 else rows.where(F.col(h) <= int(-(2**63) + share * 2**64))
        first = low.groupBy(h).count().orderBy(h).limit(most).agg(F.count("*").alias("n"), F.max(h).alias("last")).first()
        if share >= 1 or first["n"] == most:
            break
        share = max(4 * share, 1.25 * most * share / max(1, first["n"]))
    return low.where(F.col(h) <= (first["last"] if first["n"] else 0)).groupBy(h).agg(*values)


def running(values: Column, op, zero: int = 0, block: int = 64) -> Column:
    """For each element of an int array, ``op`` over those before it.

    Arrays grow by one element at a time only within blocks and over the blocks' totals, so
    the copies stay few where a text has very many matches.
    """
    none = F.from_json(F.lit("[]"), "array<int>")

    def before(xs: Column, start: Column) -> Column:
        step = lambda acc, x: F.struct(op(acc["a"], x).alias("a"), F.array_append(acc["out"], acc["a"]).alias("out"))
        return F.aggregate(xs, F.struct(start.alias("a"), none.alias("out")), step, lambda acc: acc["out"])

    def whole(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / block).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(v, b * block + 1, F.lit(block)))
        totals = lambda bs: F.transform(bs, lambda x: F.aggregate(x, F.lit(zero), op))
        parts = lambda bs: F.transform(F.arrays_zip(bs.alias("b"), before(totals(bs), F.lit(zero)).alias("s")), lambda z: before(z["b"], z["s"]))
        return F.flatten(F.transform(F.array(blocks), parts)[0])

    return F.transform(F.array(values), lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(none))[0]
