"""Stream operators; each works on a stream and on a table, and the tests hold one against the other."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galeria.operators.persons import Leaders
from galeria.operators.running import Running, prefix_scan
from galeria.plans.shared import fresh
from galeria.streaming.inorder import after_first_stream, changes_stream, latest_values_stream, switched_stream
from galeria.streaming.snapshots import upsert_batches

__all__ = [
    "after_first", "changes", "cluster_stream", "debounced", "event_stream", "latest_values", "live_counts", "periodic", "start_once", "switch_latest", "switched", "upsert_batches",
]


def event_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files under ``path``, with timestamps that watermarks accept."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def debounced(events: DataFrame, key: str, gap: str, late: str = "0 seconds") -> DataFrame:
    """``key, ts, event_id``: the last event of every burst, a burst ending with ``gap`` of silence.

    On a stream a burst is given out once the watermark has passed its end.
    """
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    last = F.max(F.struct("ts", "event_id")).alias("last")
    bursts = rows.groupBy(F.session_window("ts", gap), F.col(key)).agg(last)
    return bursts.select(key, "last.ts", "last.event_id")


def latest_values(events: DataFrame, key: str, kinds: list[str]) -> DataFrame:
    """Every event with the latest value of each kind so far, null before the first; on a table by ``prefix_scan``, on a stream with state by key."""
    if events.isStreaming:
        return latest_values_stream(events, key, kinds)
    latest = {f"latest_{k}": F.when(F.col("event_type") == k, F.col("value")) for k in kinds}
    return prefix_scan(events, [key], ["ts", "event_id"], Running(lasts=latest)).select("event_id", key, *latest)


def changes(events: DataFrame, key: str, value: str) -> DataFrame:
    """Events whose value is not that of the key's event before; a first event is one, nulls are values."""
    if events.isStreaming:
        return changes_stream(events, key, value)
    before, number = fresh(events, "before"), fresh(events, "number")
    rows = prefix_scan(events, [key], ["ts", "event_id"], Running(before={before: F.col(value)}, number=number))
    return rows.where((F.col(number) == 1) | ~F.col(value).eqNullSafe(F.col(before))).drop(before, number)


def after_first(events: DataFrame, key: str) -> DataFrame:
    """All but each key's first event."""
    if events.isStreaming:
        return after_first_stream(events, key)
    number = fresh(events, "number")
    return prefix_scan(events, [key], ["ts", "event_id"], Running(number=number)).where(F.col(number) > 1).drop(number)


def live_counts(events: DataFrame) -> DataFrame:
    """Count and sum by type; as a stream for output mode complete or update."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def cluster_stream(faces: DataFrame, threshold: float) -> DataFrame:
    """``model, id, cluster`` of a stream of faces (``model, id, embedding``): online clusters kept as state per model.

    Rows of one micro-batch are taken in the order of ids.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([], [])
        leaders = Leaders(threshold, [list(c) for c in held[0]], list(held[1]))
        rows = pd.concat(list(batches)).sort_values("id")
        out = pd.DataFrame({"model": key[0], "id": rows["id"], "cluster": [leaders.add(v) for v in rows["embedding"]]})
        state.update(([list(map(float, c)) for c in leaders.centers], [int(n) for n in leaders.counts]))
        yield out

    grouped = faces.select(F.col("model").cast("string").alias("model"), "id", "embedding").groupBy("model")
    return grouped.applyInPandasWithState(
        run, "model string, id long, cluster int", "centers array<array<double>>, counts array<long>", "append", "NoTimeout"
    )


def switch_latest(keys: DataFrame, events: DataFrame) -> DataFrame:
    """Events of the newest key only (``keys``: ``ts, key``), the older ones' are dropped (a table operator; see ``switched`` for streams)."""
    newest = keys.agg(F.max_by("key", "ts").alias("key"))
    return events.join(F.broadcast(newest), "key")


def switched(events: DataFrame, scope: str, key: str, selects: Column) -> DataFrame:
    """Events of the key that their scope has selected last: rows where ``selects`` holds select their key, the others pass while theirs is the selected one.

    Before the first selection nothing passes; a null key is never selected.
    """
    if events.isStreaming:
        return switched_stream(events, scope, key, selects)
    now, own = fresh(events, "selected"), fresh(events, "selects")
    rows = events.withColumn(own, F.coalesce(selects, F.lit(False)))
    rows = prefix_scan(rows, [scope], ["ts", "event_id"], Running(lasts={now: F.when(F.col(own), F.col(key))}))
    return rows.where(~F.col(own) & (F.col(now) == F.col(key))).drop(now, own)


def start_once(spark: SparkSession, writer, name: str, replace: bool = False):
    """The running query of that name, or the writer started under it; ``replace`` stops a running one first."""
    for query in spark.streams.active:
        if query.name == name:
            if not replace:
                return query
            query.stop()
    return writer.queryName(name).start()


def periodic(spark: SparkSession, writer, name: str, every: str):
    """The running query of that name, or the writer started under it with a batch every ``every``, such as "24 hours"; a batch that takes longer delays the next."""
    return start_once(spark, writer.trigger(processingTime=every), name)
