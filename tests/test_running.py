"""Prefix scans, as-of joins and the replay of merges against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from galeria.operators import catalog as C
from galeria.operators import maintain as M
from galeria.operators import merges as G
from galeria.operators.running import Running, next_event, prefix_scan
from galeria.streaming import streams as ST


def scanned(rows, keys, n):
    """Rows (key, order, value) with sum, last, before, number and total."""
    out, state = [], {}
    total = {}
    for k, _, v in rows:
        total[k] = total.get(k, 0) + (v or 0)
    for k, o, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        s = state.setdefault(k if keys else None, {"sum": None, "last": None, "before": None, "n": 0})
        s["n"] += 1
        before = s["before"]
        if v is not None:
            s["sum"], s["last"] = (s["sum"] or 0) + v, v
        out.append((k, o, v, s["sum"], s["last"], before, s["n"], total[k]))
        s["before"] = v
    return sorted(out, key=str)


@pytest.mark.parametrize(("parts", "share"), [(1, 0.3), (7, 0.3), (16, 1.0), (16, 0.0)])
def test_scan_equals_a_loop(spark, parts, share):
    r = random.Random(parts)
    rows = [("hot" if r.random() < share else r.choice(["a", "b", None, "", f"k{i % 9}"]), i, r.choice([None, i % 7, -1])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o long, v long").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        for keys in (["k"], []):
            ordered = rows if keys else [(None, o, v) for _, o, v in rows]
            got = prefix_scan(df, keys, ["o"], Running({"sum": F.col("v")}, {"last": F.col("v")}, {"before": F.col("v")}, {"total": F.col("v")}, "n"))
            got = sorted((((r["k"] if keys else None), r["o"], r["v"], r["sum"], r["last"], r["before"], r["n"], r["total"]) for r in got.collect()), key=str)
            assert got == scanned(ordered, keys, parts)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_one_key_runs_in_as_many_tasks_as_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(64_000).select(F.lit("one").alias("job"), F.col("id").alias("at"), (F.col("id") % 5).alias("ms"), F.lit("done").alias("outcome"))
        out = M.progress(df, "job", ["at"], "outcome", "ms").select("at", "done", "ms_mean", F.spark_partition_id().alias("p"))
        seen = out.agg(F.countDistinct("p").alias("p"), F.count_if(F.col("done") != F.col("at") + 1).alias("wrong")).first()
        assert seen["wrong"] == 0 and seen["p"] > 30  # 64 pieces of the job, dealt by hash
        pieces = out.groupBy("p").agg(F.sum("done"), F.count("*").alias("c")).agg(F.max("c"), F.max("sum(done)")).first()[0]
        assert pieces < 64_000 / 8
        assert out.where("at = 9").first()["ms_mean"] == 2.0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scan_of_nothing_and_clashing_names(spark):
    empty = spark.createDataFrame([], "k string, o long, part int")
    assert prefix_scan(empty, ["k"], ["o"], Running(number="n")).count() == 0
    df = spark.createDataFrame([("a", 1, 5, 6, "x"), ("a", 2, 5, 6, "y")], "k string, o long, part int, place int, scan_0 string")
    got = prefix_scan(df, ["k"], ["o"], Running(before={"b": F.col("scan_0")}))
    assert got.columns == [*df.columns, "b"] and {tuple(r) for r in got.collect()} == {("a", 1, 5, 6, "x", None), ("a", 2, 5, 6, "y", "x")}


def test_progress_and_headers_equal_windows(spark, small):
    log = spark.read.parquet(f"{small}/events.parquet").select("user_id", "ts", "event_id", "event_type", "value")
    log = log.withColumn("ms", F.when(F.col("event_id") % 4 > 0, F.col("value").cast("long")))
    log = log.withColumn("outcome", F.when(F.col("event_type") == "view", "done").otherwise("failed"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    want = log.select("event_id", F.count_if(F.col("outcome") == "done").over(w).alias("done"), F.avg("ms").over(w).alias("mean"))
    got = M.progress(log, "user_id", ["ts", "event_id"], "outcome", "ms").select("event_id", "done", "ms_mean")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    items = spark.createDataFrame([(i, "ab"[i // 3 % 2] if i % 5 else None) for i in range(40)], "id long, album string")
    heads, last = [], "no album"
    for i in range(39, -1, -1):
        album = "ab"[i // 3 % 2] if i % 5 else None
        if album != last:
            heads.append((39 - i, album))
        last = album
    assert [tuple(r) for r in C.headers(items, F.col("album"), F.desc("id")).orderBy("pos").collect()] == heads


def test_next_event(spark):
    r = random.Random(2)
    starts = [(r.choice("aab"), r.randint(0, 50), i) for i in range(60)]
    events = [(r.choice("aac"), at) for at in r.sample(range(50), 30)]
    got = next_event(spark.createDataFrame(starts, "k string, at long, i long"), spark.createDataFrame([(k, at, at) for k, at in events], "k string, at long, e long"), "k", "at", "e")
    want = {i: min((at for x, at in events if x == k and at > t), default=None) for k, t, i in starts}
    assert {r["i"]: r["e"] for r in got.collect()} == want


def plain_replay(faces, log):
    state = {i: [p, c] for i, p, c in faces}
    for _, kind, face, person, other in sorted(log, key=lambda a: (a[0], a[1], *(x if x is not None else -1 for x in (a[3], a[4], a[2])))):
        if kind == "merge":
            if person is not None and other is not None:
                for s in state.values():
                    if s[0] == other:
                        s[0] = person
        elif face in state:
            if kind in ("confirm", "assign"):
                state[face] = [person, kind == "confirm"]
            elif kind == "reject" and person is not None and state[face][0] == person:
                state[face] = [None, False]
    return sorted((i, *s) for i, s in state.items())


def plain_rejections(rejections, log):
    held = [list(r) for r in rejections]
    for _, kind, face, person, other in sorted(log, key=lambda a: (a[0], a[1], *(x if x is not None else -1 for x in (a[3], a[4], a[2])))):
        if kind == "merge" and person is not None and other is not None:
            for h in held:
                if h[1] == other:
                    h[1] = person
        elif kind == "reject" and face is not None and person is not None:
            held.append([face, person])
        elif kind == "unreject":
            held = [h for h in held if h != [face, person]]
    return sorted({tuple(h) for h in held})


LOG = "seq long, kind string, face_id long, person_id long, other_id long"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replay_equals_a_loop(spark, seed):
    r = random.Random(seed)
    people = list(range(12))
    faces = [(i, r.choice([*people, None]), r.random() < 0.3) for i in range(60)]
    log = []
    for seq in range(150):
        kind = r.choice(["merge", "merge", "merge", "confirm", "assign", "reject", "reject", "reject", "unreject", "other"])
        face = r.choice([*range(60), 99, None]) if kind != "merge" else None
        log.append((seq, kind, face, r.choice([*people, *people, None]), r.choice([*people, None]) if kind == "merge" else None))
    df = spark.createDataFrame(log, LOG).repartition(3)
    got = G.replay(spark.createDataFrame(faces, "id long, person_id long, confirmed boolean"), df)
    assert sorted(map(tuple, got.collect())) == plain_replay(faces, log)
    rejections = sorted({(r.randint(0, 20), r.choice(people)) for _ in range(40)})
    got = G.replay_rejections(spark.createDataFrame(rejections, "face_id long, person_id long"), df)
    assert sorted(map(tuple, got.collect())) == plain_rejections(rejections, log)


def test_a_pair_that_both_persons_reject_stays_once(spark):
    log = spark.createDataFrame([(1, "merge", None, 5, 6)], LOG)
    got = G.replay_rejections(spark.createDataFrame([(1, 5), (1, 6), (2, 6), (None, 6)], "face_id long, person_id long"), log)
    assert sorted(map(tuple, got.collect())) == [(1, 5), (2, 5)]


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_names_go_with_merges(spark, seed):
    r = random.Random(seed)
    people = {i: f"n{i}" if r.random() < 0.25 else None for i in range(60)}
    state, log = dict(people), []
    for seq in range(50):
        kept, gone = r.sample(sorted(state), 2) if r.random() < 0.9 else [r.choice(sorted(state))] * 2
        log.append((seq, "merge", None, kept, gone))
        if kept != gone:
            name = state.pop(gone)
            state[kept] = state[kept] or name
    log += [(99, "merge", None, None, 3), (100, "merge", None, 3, None), (101, "confirm", 1, 3, None)]
    got = G.replay_persons(spark.createDataFrame(list(people.items()), "id long, name string"), spark.createDataFrame(log, LOG).repartition(3))
    assert sorted(map(tuple, got.collect())) == sorted(state.items())


def test_long_chains_and_empty_logs(spark):
    n = 3000
    log = spark.range(n).select(F.col("id").alias("seq"), F.lit("merge").alias("kind"), F.lit(None).cast("long").alias("face_id"), (F.col("id") + 1).alias("person_id"), F.col("id").alias("other_id"))
    faces = spark.createDataFrame([(1, 0, True), (2, n - 1, False), (3, None, False), (4, n + 5, True)], "id long, person_id long, confirmed boolean")
    forest = G.Forest.of(G.timed(log))
    assert len(forest.rounds) <= 13
    assert sorted(map(tuple, G.replay(faces, log).collect())) == [(1, n, True), (2, n, False), (3, None, False), (4, n + 5, True)]
    assert sorted(map(tuple, G.replay(faces, log.limit(0)).collect())) == [(1, 0, True), (2, n - 1, False), (3, None, False), (4, n + 5, True)]


def test_a_row_never_holds_the_log(spark):
    log = spark.createDataFrame([(1, "merge", None, 5, 6)], LOG)
    faces = spark.createDataFrame([(1, 6, True)], "id long, person_id long, confirmed boolean")
    assert "collect_list" not in G.replay(faces, log)._jdf.queryExecution().toString()


def test_switching_by_scope(spark):
    rows = [(i, f"u{i % 3}", i % 5 if i % 7 else None, i % 4 == 0, i) for i in range(120)]
    df = spark.createDataFrame(rows, "event_id long, scope string, key long, sel boolean, ts long").withColumn("ts", F.timestamp_seconds("ts"))
    now, want = {}, []
    for i, scope, key, sel, _ in rows:
        if sel:
            now[scope] = key if key is not None else now.get(scope)
        elif key is not None and now.get(scope) == key:
            want.append(i)
    assert sorted(r["event_id"] for r in ST.switched(df, "scope", "key", F.col("sel")).collect()) == want
