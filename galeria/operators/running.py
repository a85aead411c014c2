"""Ordered running values without one task a key: a prefix scan over range partitions.

Rows are range-partitioned by key and order, so the rows of one key, however many, lie in
consecutive partitions. Each partition computes its own running values; what the last key
of a partition has gathered there is one small row, and these rows, one a partition, are
folded on the driver into what each partition starts with.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeria.plans.shared import fresh, partitions, stored


@dataclass
class Running:
    """What to carry along a key's rows, by the names of the new columns.

    ``sums``: sums so far, the row itself included, null before the first value.
    ``lasts``: the latest value that is not null, the row itself included.
    ``before``: the value of the row before, null where that is null or there is none.
    ``totals``: sums over all rows of the key, those behind the row too; 0 without values.
    ``number``: a column for the row's number within its key, from 1.
    """

    sums: dict[str, Column] = field(default_factory=dict)
    lasts: dict[str, Column] = field(default_factory=dict)
    before: dict[str, Column] = field(default_factory=dict)
    totals: dict[str, Column] = field(default_factory=dict)
    number: str | None = None


def prefix_scan(df: DataFrame, keys: list[str], order: list[Column | str], what: Running) -> DataFrame:
    """``df`` with the running values of ``what`` over the rows of each of ``keys`` in the given order.

    Without ``keys`` the whole table is one key. Null keys are a key of their own; rows that
    are equal in ``order`` are taken as they arrive; an empty table gives no rows. No task
    holds more than a range partition, and a key of all rows is spread over all of them: the
    arrival order is the last part of the range. The dealt rows are written to the shared
    folder once, so that numbers, carried values and result come from the same rows; one
    row a partition comes to the driver.
    """
    sums = dict(what.sums) | ({what.number: F.lit(1).cast("long")} if what.number else {})
    inputs = {(kind, n): c for kind, of in (("s", sums), ("l", what.lasts), ("b", what.before), ("t", what.totals)) for n, c in of.items()}
    part, place, arrival = fresh(df, "part"), fresh(df, "place"), fresh(df, "arrival")
    own = {k: fresh(df, f"scan_{i}") for i, k in enumerate(inputs)}
    dealt = df.withColumns({own[k]: c for k, c in inputs.items()} | {arrival: F.monotonically_increasing_id()})
    sorting = [*(F.col(f"`{k}`") for k in keys), *order, arrival]
    dealt = dealt.repartitionByRange(partitions(df), *sorting).sortWithinPartitions(*sorting).drop(arrival)
    at = F.monotonically_increasing_id()
    held, _ = stored(dealt.withColumns({part: F.shiftright(at, 33).cast("int"), place: at.bitwiseAND(F.lit((1 << 33) - 1))}), "scanned")

    carried = _carried(held, keys, part, place, own)
    w = Window.partitionBy(part, *(f"`{k}`" for k in keys)).orderBy(place)
    so_far, whole = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    names = {c: fresh(df, c) for c in ("first_key", "last_key", "start", "rest")}
    first, last, start, rest = names.values()
    met = held.join(F.broadcast(carried.withColumnsRenamed({"part": part, **names})), part, "left")
    same, goes_on = F.col(first) == _key(keys), F.col(last) == _key(keys)
    new: dict[str, Column] = {}
    for (kind, name), column in own.items():
        mine, from_before = F.col(column), F.when(same, F.col(start)[column])
        if kind == "s":
            total = F.sum(mine).over(so_far)
            new[name] = F.when(total.isNull(), from_before).otherwise(total + F.coalesce(from_before, F.lit(0)))
        elif kind == "l":
            new[name] = F.coalesce(F.last(mine, ignorenulls=True).over(so_far), from_before)
        elif kind == "t":
            behind = F.when(goes_on, F.col(rest)[column])
            new[name] = sum((F.coalesce(x, F.lit(0)) for x in (from_before, behind)), F.coalesce(F.sum(mine).over(whole), F.lit(0)))
        else:
            new[name] = F.when(F.row_number().over(w) == 1, from_before).otherwise(F.lag(mine).over(w))
    return met.withColumns(new).drop(part, place, *names.values(), *own.values())


def _key(keys: list[str]) -> Column:
    """A row's key as one value, equal for null keys too."""
    return F.to_json(F.struct(*(F.col(f"`{k}`").cast("string").alias(f"k{i}") for i, k in enumerate(keys)))) if keys else F.lit("")


def _carried(held: DataFrame, keys: list[str], part: str, place: str, own: dict[tuple[str, str], str]) -> DataFrame:
    """``part, first_key, last_key, start, rest``: each partition's outer keys, what the partitions before gathered for the first and those behind have for the last."""
    spark, key = held.sparkSession, _key(keys)
    ends = held.groupBy(F.col(part).alias("p")).agg(F.min_by(key, place).alias("first"), F.max_by(key, place).alias("last"))
    outer = held.join(F.broadcast(ends), F.col(part) == F.col("p")).where((key == F.col("first")) | (key == F.col("last")))
    tail, head = key == F.col("last"), key == F.col("first")
    of = {
        "s": lambda c: F.sum(F.when(tail, F.col(c))),
        "l": lambda c: F.max_by(c, F.when(tail & F.col(c).isNotNull(), F.col(place))),
        "b": lambda c: F.max_by(c, F.when(tail, F.col(place))),
        "t": lambda c: F.sum(F.when(tail, F.col(c))),
    }
    sides = [of[kind](c).alias(c) for (kind, _), c in own.items()]
    heads = {c: f"head_{c}" for (kind, _), c in own.items() if kind == "t"}
    found = outer.groupBy("p", "first", "last").agg(*sides, *(F.sum(F.when(head, F.col(c))).alias(h) for c, h in heads.items()))
    kinds = {c: found.schema[c].dataType.simpleString() for c in own.values()}
    ends = sorted(found.collect(), key=lambda r: r["p"])  # one row a partition
    add = lambda a, b: b if a is None else a if b is None else a + b

    starts, at, now = [], None, {}
    for r in ends:
        starts.append(tuple(now[c] for c in own.values()) if at == r["first"] and now else None)
        gathered = {c: r[c] for c in own.values()}
        if starts[-1] and r["first"] == r["last"]:  # the key fills the partition: it goes on
            for (kind, _), c in own.items():
                if kind in "st":
                    gathered[c] = add(now[c], gathered[c])
                elif kind == "l" and gathered[c] is None:
                    gathered[c] = now[c]
        at, now = r["last"], gathered
    rests: list[tuple | None] = [None] * len(ends)
    for i in range(len(ends) - 2, -1, -1):
        r, after = ends[i], ends[i + 1]
        if r["last"] == after["first"]:
            further = rests[i + 1] if after["first"] == after["last"] and rests[i + 1] else [None] * len(heads)
            rests[i] = tuple(add(after[h], x) for h, x in zip(heads.values(), further, strict=True))
    rows = [(r["p"], r["first"], r["last"], start, rest or None) for r, start, rest in zip(ends, starts, rests, strict=True)]
    struct = lambda columns: "struct<" + ", ".join(f"`{c}`: {kinds[c]}" for c in columns) + ">"
    return spark.createDataFrame(rows, f"part int, first_key string, last_key string, start {struct(own.values())}, rest {struct(heads) if heads else 'int'}")


def next_event(starts: DataFrame, events: DataFrame, key: str, at: str, event: str) -> DataFrame:
    """``starts`` with the first later event of their key: rows of ``events`` with an equal ``key`` and a larger ``at``; null if there is none.

    Both are sorted together, latest first, and each start takes the last event seen: an
    as-of join whose tasks are range partitions, however many rows share a key. Starts and
    events need ``key`` and ``at``, events also ``event``, a column that starts must not have.
    """
    side = fresh(starts, "is_event")
    both = starts.withColumns({side: F.lit(False), event: F.lit(None).cast(events.schema[event].dataType)})
    both = both.unionByName(events.select(key, at, event).withColumn(side, F.lit(True)), allowMissingColumns=True)
    seen = fresh(both, "seen")
    out = prefix_scan(both, [key], [F.desc(at), F.col(side)], Running(lasts={seen: F.col(event)}))
    return out.where(~F.col(side)).drop(side, event).withColumnRenamed(seen, event)
