"""Row numbers over a whole table without one task that sorts it all."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galeria.plans.shared import fresh, partitions, stored


def lookup(values: list[int]) -> Column:
    """A constant array; the optimizer folds the JSON text into one literal."""
    return F.from_json(F.lit(json.dumps(values)), T.ArrayType(T.LongType()))


def counted(df: DataFrame, order: list[Column | str], name: str) -> tuple[DataFrame, int]:
    """``df`` with a global row number 0 .. n - 1 in the order of ``order``, and n.

    Range partitioning on ``order`` and then on the row's arrival: a value that a third of
    all rows hold is spread over partitions, and rows equal in ``order`` may change places.
    The sorted rows are written to the shared folder with their partition and place, so
    that counts and numbers come from the same rows. Only one count per partition comes to
    the driver, and Spark's sample of the order columns: some hundred rows a partition, three
    million at most.
    """
    arrival, part, place = fresh(df, "arrival"), fresh(df, "part"), fresh(df, "place")
    dealt = df.withColumn(arrival, F.monotonically_increasing_id()).repartitionByRange(partitions(df), *order, arrival)
    at = F.monotonically_increasing_id()  # the partition's number, then 33 bits of position
    dealt = dealt.sortWithinPartitions(*order, arrival).drop(arrival)
    held, _ = stored(dealt.withColumns({part: F.shiftright(at, 33).cast("int"), place: at.bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    total, firsts = 0, {}
    for p, count in sorted((r[part], r["count"]) for r in held.groupBy(part).count().collect()):
        firsts[p], total = total, total + count
    base = lookup([firsts.get(p, 0) for p in range(max(firsts, default=0) + 1)])
    return held.withColumn(name, base[F.col(part)] + F.col(place)).drop(part, place), total


def numbered(df: DataFrame, *order: Column | str, name: str = "pos") -> DataFrame:
    """``df`` with a row number from 0 in the given order; see ``counted``."""
    return counted(df, list(order), name)[0]
