"""Streams in order against the table operators, their state, and restarts."""

from __future__ import annotations

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from galeria.streaming import inorder
from galeria.streaming import streams as ST

FIELDS = "event_id long, user_id long, event_type string, value double, ts timestamp"


@pytest.fixture()
def rocks(spark):
    before = spark.conf.get(inorder.PROVIDER)
    inorder.use_rocksdb(spark)
    yield spark
    spark.conf.set(inorder.PROVIDER, before)


@pytest.fixture()
def shuffled(spark, small, tmp_path):
    """Events in files by time, rows of neighbouring minutes mixed; the table."""
    rows = spark.read.parquet(f"{small}/events.parquet").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    rows = rows.withColumn("user_id", F.col("user_id") % 40).orderBy("ts").limit(600)
    held = sorted(rows.collect(), key=lambda r: (r["ts"], r["event_id"]))
    for k in range(0, len(held), 150):
        part = held[k : k + 150]
        part = part[1::2] + part[::2]
        spark.createDataFrame(part, FIELDS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    end = held[-1]["ts"] + dt.timedelta(days=1)  # lets the watermark pass all of them, and waits itself
    spark.createDataFrame([(-1, -1, "end", 0.0, end)], FIELDS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    return f"{tmp_path}/events", spark.createDataFrame(held, FIELDS)


def run(stream, path, name):
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/{name}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


OPERATORS = {
    "latest": lambda e: ST.latest_values(e, "user_id", ["view", "purchase"]),
    "changes": lambda e: ST.changes(e, "user_id", "event_type"),
    "after_first": lambda e: ST.after_first(e, "user_id"),
    "switched": lambda e: ST.switched(e, "user_id", "event_type", F.col("event_id") % 3 == 0),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_stream_equals_table(rocks, shuffled, tmp_path, name):
    path, table = shuffled
    stream = rocks.readStream.schema(FIELDS).option("maxFilesPerTrigger", 1).parquet(path)
    query = run(OPERATORS[name](stream), str(tmp_path), name)
    got, want = rows(rocks.read.parquet(f"{tmp_path}/{name}")), rows(OPERATORS[name](table))
    assert got == want and got
    state = query.lastProgress.stateOperators[0]
    users = table.select("user_id").distinct().count()
    assert state.numRowsTotal <= 2 * users + 10  # nothing waits any more: one row a key


def test_restart_goes_on_where_it_stopped(rocks, shuffled, tmp_path):
    path, table = shuffled
    files = sorted(f for f in rocks.read.parquet(path).inputFiles())
    parts = [rocks.read.parquet(f) for f in files]
    order = sorted(range(len(parts)), key=lambda i: parts[i].agg(F.min("ts")).first()[0])
    for i, k in enumerate(order):
        parts[k].coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = rocks.readStream.schema(FIELDS).parquet(f"{tmp_path}/in")
        run(ST.changes(stream, "user_id", "event_type"), str(tmp_path), "again")
    assert rows(rocks.read.parquet(f"{tmp_path}/again")) == rows(ST.changes(table, "user_id", "event_type"))


def test_the_state_store_is_checked(spark, shuffled):
    path, _ = shuffled
    with pytest.raises(ValueError, match="use_rocksdb"):
        ST.after_first(spark.readStream.schema(FIELDS).parquet(path), "user_id")


def test_values_wait_for_the_watermark(rocks, tmp_path):
    schema = "event_id long, user_id long, event_type string, value double, ts timestamp"
    at = lambda s: F.timestamp_seconds(F.lit(s))
    frame = lambda rows: rocks.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    batches = [[(1, 1, "view", 1.0, 100), (2, 1, "buy", 2.0, 105)], [(3, 1, "view", 3.0, 102), (4, 2, "view", 4.0, 200)], [(6, 2, "buy", 6.0, 300)], [(5, 1, "view", 5.0, 101)]]
    for i, b in enumerate(batches):
        frame(b).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = rocks.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    run(inorder.latest_values_stream(stream, "user_id", ["view", "buy"], late="10 seconds"), str(tmp_path), "late")
    got = {r["event_id"]: (r["latest_view"], r["latest_buy"]) for r in rocks.read.parquet(f"{tmp_path}/late").collect()}
    assert got[1] == (1.0, None) and got[3] == (3.0, None) and got[2] == (3.0, 2.0) and got[4] == (4.0, None)
    assert 5 not in got and 6 not in got  # too late, and still waiting


def test_a_periodic_job_runs_once_a_period(spark, tmp_path):
    rows = lambda i: spark.createDataFrame([(i,)], "k long").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    rows(0)
    stream = spark.readStream.schema("k long").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    seen = []
    writer = stream.writeStream.option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda df, n: seen.append(df.count()))
    query = ST.periodic(spark, writer, "backup", "1 hour")
    try:
        deadline = time.monotonic() + 60
        while not seen and time.monotonic() < deadline:
            time.sleep(0.2)
        rows(1)
        time.sleep(2)
        assert seen == [1] and ST.periodic(spark, writer, "backup", "1 hour").id == query.id
    finally:
        query.stop()
