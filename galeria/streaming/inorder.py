"""Streams taken in the order of their event time, with state by key.

Events wait in their key's state until the watermark has passed them, then go through a
step one after the other, so a stream gives what the table operator gives, whatever the
order of arrival within the watermark's delay. State holds the waiting events and one row
a key. It needs the RocksDB state store: see ``use_rocksdb``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Let the session's streams keep their state in RocksDB."""
    spark.conf.set(PROVIDER, ROCKSDB)


class InOrder(StatefulProcessor):
    """Waiting events by key, and a row of state that ``step(state, event)`` replaces: it gives (new state, rows out)."""

    def __init__(self, step: Callable, waiting: T.StructType, state: T.StructType, out: list[str]) -> None:
        self.step, self.waiting_schema, self.state_schema, self.out = step, waiting, state, out

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_schema)
        self.held = handle.getValueState("held", self.state_schema)

    def _call_at(self, rows: list[tuple]) -> None:
        at = min(r[0] for r in rows)
        if at not in {t for t in self.handle.listTimers()}:
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(r) for pdf in rows for r in pdf.astype(object).where(pdf.notna(), None)[self.waiting_schema.names].itertuples(index=False)]
        if new:
            self.waiting.appendList(new)
            self._call_at(new)
        yield pd.DataFrame(columns=self.out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = [tuple(r) for r in self.waiting.get()]
        due = sorted((r for r in rows if r[0] <= now), key=lambda r: (r[1], r[2]))
        rest = [r for r in rows if r[0] > now]
        state, out = (tuple(self.held.get()) if self.held.exists() else None), []
        for r in due:
            state, found = self.step(state, r)
            out += found
        if state is not None:
            self.held.update(state)
        if rest:
            self.waiting.put(rest)
            self._call_at(rest)
        else:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=self.out).astype(object)

    def close(self) -> None:
        pass


def in_order(events: DataFrame, key: str, step: Callable, values: dict[str, Column], state: str, out: T.StructType, late: str, order: str = "event_id") -> DataFrame:
    """The rows that ``step`` gives for the events of each key in the order of (ts, ``order``).

    ``step(state, event)`` gets the key's state, a tuple or None, and the event as a tuple:
    milliseconds, timestamp in microseconds, ``order``, then ``values``. Events later than
    ``late`` behind the newest are dropped by the watermark; events without a time are too.
    """
    if events.sparkSession.conf.get(PROVIDER, "") != ROCKSDB:
        raise ValueError("streams in order keep their state in RocksDB: call use_rocksdb(spark) first")
    micros = F.unix_micros("ts")
    rows = events.where("ts IS NOT NULL").select(
        F.timestamp_micros(micros).alias("ts"), F.col(key).alias("key"), F.ceil(micros / 1000).cast("long").alias("at_ms"), micros.alias("at_us"), F.col(order).alias("at_id"),
        *(c.alias(n) for n, c in values.items()),
    ).withWatermark("ts", late)
    waiting = T.StructType([f for f in rows.schema.fields if f.name not in ("ts", "key")])
    processor = InOrder(step, waiting, T._parse_datatype_string(state), out.names)
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="EventTime")


def _schema(events: DataFrame, **names: str) -> T.StructType:
    return T.StructType([T.StructField(n, events.schema[c].dataType) for n, c in names.items()])


def latest_values_stream(events: DataFrame, key: str, kinds: list[str], late: str = "0 seconds") -> DataFrame:
    """The stream of ``streams.latest_values``: every event with the latest value of each kind."""
    columns = [f"latest_{k}" for k in kinds]

    def step(state, e):
        _, _, event, who, kind, value = e
        state = list(state or [None] * len(kinds))
        if kind in kinds and value is not None:
            state[kinds.index(kind)] = value
        return tuple(state), [(event, who, *state)]

    out = _schema(events, event_id="event_id", **{key: key}, **dict.fromkeys(columns, "value"))
    kind = events.schema["value"].dataType.simpleString()
    values = {"who": F.col(key), "kind": F.col("event_type"), "value": F.col("value")}
    return in_order(events, key, step, values, ", ".join(f"v{i} {kind}" for i in range(len(kinds))), out, late)


def _kept(events: DataFrame) -> tuple[dict[str, Column], T.StructType]:
    """All columns of the events to wait with, and to come out again; times anew, as a stream has one watermark."""
    anew = lambda f: F.timestamp_micros(F.unix_micros(f"`{f.name}`")) if isinstance(f.dataType, T.TimestampType) else F.col(f"`{f.name}`")
    return {f"c{i}": anew(f) for i, f in enumerate(events.schema.fields)}, events.schema


def changes_stream(events: DataFrame, key: str, value: str, late: str = "0 seconds") -> DataFrame:
    """The stream of ``streams.changes``: events whose value is not that of the key's event before."""
    values, out = _kept(events)
    at = 3 + events.columns.index(value)

    def step(state, e):
        new = state is None or state[0] != e[at]
        return (e[at],), [e[3:]] if new else []

    return in_order(events, key, step, values, f"last {events.schema[value].dataType.simpleString()}", out, late)


def after_first_stream(events: DataFrame, key: str, late: str = "0 seconds") -> DataFrame:
    """The stream of ``streams.after_first``: all but each key's first event."""
    values, out = _kept(events)
    return in_order(events, key, lambda state, e: ((True,), [] if state is None else [e[3:]]), values, "seen boolean", out, late)


def switched_stream(events: DataFrame, scope: str, key: str, selects: Column, late: str = "0 seconds") -> DataFrame:
    """The stream of ``streams.switched``: events of the key that their scope has selected last."""
    values, out = _kept(events)
    at = 3 + events.columns.index(key)

    def step(state, e):
        if e[-1]:
            return (e[at],) if e[at] is not None else state, []
        return state, [e[3:-1]] if state is not None and e[at] is not None and state[0] == e[at] else []

    return in_order(events, scope, step, values | {"selects": F.coalesce(selects, F.lit(False))}, f"now {events.schema[key].dataType.simpleString()}", out, late)
