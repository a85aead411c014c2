"""Versions by buckets, the change feed, and what a crash or a restart leaves."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from galeria.streaming import snapshots as SN

SCHEMA = "k long, v string, x double"


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def replayed(changes):
    """The table that a feed's rows make, version by version."""
    held = {}
    for r in sorted(changes, key=lambda r: r["version"]):
        key = r["k"]
        assert (r["op"] == "insert") == (key not in held)
        if r["op"] == "delete":
            assert held.pop(key) == (r["k"], r["v"], str(r["x"]))
        else:
            held[key] = (r["k"], r["v"], str(r["x"]))
    return held


def batches(seed, n):
    r = random.Random(seed)
    return [[(r.choice([*range(40), None]), r.choice(["put", "put", "remove"]), r.choice("abc"), r.choice([None, 1.5, float("nan")]), i) for i in range(25)] for _ in range(n)]


def test_versions_equal_a_dictionary_and_the_feed_replays_them(spark, tmp_path):
    store, held, states = SN.Snapshots(spark, f"{tmp_path}/t", ["k"], buckets=8), {}, []
    assert store.read() is None and store.manifest() is None
    for number, rows in enumerate(batches(3, 5)):
        df = spark.createDataFrame(rows, "k long, op string, v string, x double, seq long").repartition(3)
        assert store.apply(df, number, "seq") == number + 1
        for k, op, v, x, _ in rows:
            held.pop(k, None)
            if op == "put":
                held[k] = (k, v, str(x))
        states.append(dict(held))
    for version, want in enumerate(states, 1):
        got = {r["k"]: (r["k"], r["v"], str(r["x"])) for r in store.read(version).collect()}
        assert got == want
        feed = SN.changes_between(spark, f"{tmp_path}/t", until=version).collect()
        assert replayed(feed) == want
    late = SN.changes_between(spark, f"{tmp_path}/t", after=3).collect()
    assert {r["version"] for r in late} <= {4, 5} and late
    store.forget(3)
    assert store.versions() == [3, 4, 5] and {r["k"] for r in store.read().collect()} == set(states[-1])
    with pytest.raises(Exception, match="forgotten"):
        SN.changes_between(spark, f"{tmp_path}/t", after=1).collect()


def written(path):
    return sum(p.stat().st_size for p in Path(path).rglob("*.parquet"))


def test_a_batch_writes_the_buckets_it_touches(spark, tmp_path):
    store = SN.Snapshots(spark, f"{tmp_path}/t", ["k"], buckets=64)
    big = spark.range(200_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"), F.lit(0.5).alias("x"))
    store.apply(big, 0)
    whole = written(f"{tmp_path}/t")
    store.apply(spark.createDataFrame([(5, "new", 1.0)], SCHEMA), 1)
    assert written(f"{tmp_path}/t") - whole < whole / 40
    feed = SN.changes_between(spark, f"{tmp_path}/t", after=1).collect()
    assert [(r["op"], r["k"], r["v"]) for r in feed] == [("update", 5, "new")] and store.read().count() == 200_000


def test_a_crash_before_the_manifest_leaves_the_table(spark, tmp_path, monkeypatch):
    store = SN.Snapshots(spark, f"{tmp_path}/t", ["k"], buckets=4)
    store.apply(spark.createDataFrame([(1, "a", 0.0), (2, "b", 0.0)], SCHEMA), 0)

    def crash(self, manifest):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(SN.Snapshots, "_commit", crash)
        with pytest.raises(OSError, match="lost"):
            store.apply(spark.createDataFrame([(1, "x", 0.0), (3, "c", 0.0)], SCHEMA), 1)
    assert store.versions() == [1] and table(store.read()) == [(1, "a", 0.0), (2, "b", 0.0)]
    again = spark.createDataFrame([(1, "x", 0.0), (3, "c", 0.0)], SCHEMA)
    assert store.apply(again, 1) == 2 and store.apply(again, 1) == 2  # the repeat is harmless
    assert table(store.read()) == [(1, "x", 0.0), (2, "b", 0.0), (3, "c", 0.0)]
    assert len(SN.changes_between(spark, f"{tmp_path}/t", after=1).collect()) == 2


def test_another_writer_of_the_same_version_is_told(spark, tmp_path):
    store = SN.Snapshots(spark, f"{tmp_path}/t", ["k"])
    store.apply(spark.createDataFrame([(1, "a", 0.0)], SCHEMA), 0)
    with pytest.raises(OSError, match="another writer"):
        store._commit(store.manifest())


def feed(spark, tmp_path, name):
    got = []
    query = SN.change_stream(spark, f"{tmp_path}/t").writeStream.foreachBatch(lambda df, n: got.extend(df.collect()))
    query.option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
    return got


def test_the_stream_goes_on_after_a_restart(spark, tmp_path):
    store, all_ = SN.Snapshots(spark, f"{tmp_path}/t", ["k"], buckets=4), []
    with pytest.raises(Exception, match="no version"):
        SN.change_stream(spark, f"{tmp_path}/t")
    for number, rows in enumerate(batches(7, 4)):
        store.apply(spark.createDataFrame(rows, "k long, op string, v string, x double, seq long"), number, "seq")
        if number != 1:  # one restart finds two versions
            new = feed(spark, tmp_path, "state")
            assert {r["version"] for r in new} <= set(range(number, number + 2)) and new
            all_ += new
    assert feed(spark, tmp_path, "state") == []  # a restart repeats nothing
    assert replayed(all_) == {r["k"]: (r["k"], r["v"], str(r["x"])) for r in store.read().collect()}
    assert len(all_) == SN.changes_between(spark, f"{tmp_path}/t").count()


def test_removing_all_and_nothing(spark, tmp_path):
    store = SN.Snapshots(spark, f"{tmp_path}/t", ["k"], buckets=2)
    none = spark.createDataFrame([], SCHEMA)
    assert store.apply(none, 0) == 1 and store.read().count() == 0
    store.apply(spark.createDataFrame([(1, "a", 0.0)], SCHEMA), 1)
    store.apply(spark.createDataFrame([(1, "remove"), (9, "remove")], "k long, op string").withColumns({"v": F.lit("z"), "x": F.lit(0.0)}), 2)
    assert store.read().count() == 0 and [(r["version"], r["op"], r["v"]) for r in SN.changes_between(spark, f"{tmp_path}/t").collect()] == [(2, "insert", "a"), (3, "delete", "a")]
