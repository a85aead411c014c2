"""Small cases: kernels, labels, people, lists, files and streams."""

from __future__ import annotations

import datetime as dt
import json
import math
import threading
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark import InheritableThread
from pyspark.sql import functions as F

from galeria.functions import kernels as K
from galeria.functions import scalars as S
from galeria.operators import catalog as C
from galeria.operators import maintain as M
from galeria.operators import merges as G
from galeria.operators import persons as P
from galeria.operators import search as V
from galeria.plans import event_queries as EQ
from galeria.plans.numbering import numbered
from galeria.plans.shared import checkpoint, components, partitions, path_of, scratch, stored
from galeria.sources import tables as T
from galeria.streaming import streams as ST
from galeria.streaming.snapshots import Snapshots


@given(st.lists(st.floats(-0.25, 0.25, width=32), max_size=50))
def test_half_floats_come_back(v):
    back = K.decode_half(K.encode_half(np.array(v, np.float32)))
    assert all(abs(a - b) <= max(1e-3 * abs(a), 1e-6) for a, b in zip(v, back, strict=True))


def test_half_floats_at_the_edges():
    v = np.array([0, 1, -1, 0.5, 65504, 1e-5, 1e9, -1e9, np.inf], np.float32)
    assert K.decode_half(K.encode_half(v)).tolist()[:5] == [0, 1, -1, 0.5, 65504]
    assert np.isinf(K.decode_half(K.encode_half(v))[6:]).all()


def test_merging_takes_the_lowest_rank_then_the_leftmost():
    ranks = {("a", "b"): 1, ("b", "c"): 0, ("a", "bc"): 2}
    assert K.merge(list("abc"), ranks) == ["abc"]
    assert K.merge(list("abab"), {("a", "b"): 0}) == ["ab", "ab"]
    assert K.merge(list("aaa"), {("a", "a"): 0}) == ["aa", "a"]
    assert K.merge([], ranks) == []


def test_word_and_piece_ids():
    vocab = {"h": 1, "i": 2, "hi</w>": 3, "i</w>": 4, "!</w>": 5, "7</w>": 6, "8</w>": 7, "'s</w>": 8, "'": 9, "s</w>": 10}
    ids = K.clip_ids("  HI\n hi!78's ", vocab, {("h", "i</w>"): 0, ("'", "s</w>"): 1}, 0)
    assert ids == [3, 3, 5, 6, 7, 8]
    assert K.piece_ids("a ä", {"a": 1, "▁": 2, "<0xC3>": 3, "<0xA4>": 4, "a▁": 5}, {("a", "▁"): 0}, 0) == [5, 3, 4]


def test_long_texts_merge_fast_and_alike():
    rng = np.random.default_rng(3)
    ranks = {("a", "b"): 3, ("b", "a"): 1, ("ab", "a"): 0, ("ba", "b"): 2, ("a", "a"): 4, ("aa", "ba"): 5}

    def plain(symbols):
        symbols = list(symbols)
        while True:
            best = min(((ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in ranks), default=None)
            if best is None:
                return symbols
            symbols[best[1] : best[1] + 2] = [symbols[best[1]] + symbols[best[1] + 1]]

    for n in (1, 2, 7, 60, 300):
        text = "".join(rng.choice(list("abc"), n, p=[0.5, 0.4, 0.1]))
        assert K.merge(list(text), ranks) == plain(text)
    assert "".join(K.merge(list("ab" * 100_000), ranks)) == "ab" * 100_000


def test_encoders_equal_a_public_library():
    tokenizers = pytest.importorskip("tokenizers")
    rng = np.random.default_rng(6)
    letters = "abcdeth"
    merges = [("t", "h"), ("th", "e</w>"), ("a", "b"), ("ab", "c"), ("c", "d"), ("d", "e"), ("ab", "cd"), ("e", "a"), ("h", "e</w>"), ("b", "a"), ("a", "a</w>")]
    vocab = {s: i for i, s in enumerate(["<unk>", *letters, *(x + "</w>" for x in letters), *dict.fromkeys(a + b for a, b in merges)])}
    theirs = tokenizers.Tokenizer(tokenizers.models.BPE(vocab, merges, unk_token="<unk>", end_of_word_suffix="</w>"))
    ranks = K.known_merges(vocab, merges)
    for n in rng.integers(1, 40, 200):
        word = "".join(rng.choice(list(letters), n))
        assert K.clip_ids(word, vocab, ranks, 0) == theirs.encode(word).ids
    pieces = [("▁", "t"), ("t", "h"), ("▁t", "h"), ("a", "b"), ("b", "a"), ("ab", "ab")]
    vocab = {s: i for i, s in enumerate(["<unk>", "▁", *letters, *dict.fromkeys(a + b for a, b in pieces), *(f"<0x{b:02X}>" for b in range(256))])}
    theirs = tokenizers.Tokenizer(tokenizers.models.BPE(vocab, pieces, unk_token="<unk>", byte_fallback=True))
    ranks = K.known_merges(vocab, pieces)
    for n in rng.integers(1, 60, 200):
        text = "".join(rng.choice([*letters, " ", "ä", "日", "Z"], n))
        assert K.piece_ids(text, vocab, ranks, 0) == theirs.encode(text.replace(" ", "▁")).ids


def test_encoders_give_ids_by_slices():
    """A batch of 40 MB of text: its ids never stand in memory at once."""
    texts = ["ab " * 33_000] * 400 + [None, ""]
    encode = K.tokenizer("pieces", {"<unk>": 0, "a": 1, "b": 2, "▁": 3}, [], length=7).func
    assert [len(x) for x in K.slices(pa.array(texts))] == [10] * 39 + [12]
    assert [len(x) for x in K.slices(pa.array(["x" * 9, "", None, "xy", "z"]), 2)] == [1, 3, 1] and not list(K.slices(pa.array([], pa.string())))
    got = list(encode(iter([pa.array(texts[:2] + texts[-2:])])))
    assert [r for x in got for r in x.to_pylist()] == [[1, 2, 3, 1, 2, 3, 1]] * 2 + [None, [1, 0, 0, 0, 0, 0, 0]]
    encode = K.tokenizer("pieces", {"<unk>": 0, "a": 1, "b": 2, "▁": 3}, []).func
    sizes = [x.nbytes for x in encode(iter([pa.array(texts[:25])]))]
    assert len(sizes) == 3 and max(sizes) < 5 << 20


def test_tokenizer_files(spark, tmp_path):
    model = {"vocab": {"a": 5, "b</w>": 6, "ab</w>": 7, "b": 8, " c": 9, "<unk>": 3}, "merges": ["a b</w>", "a b</w>", ["a", "b"], "x y"], "end_of_word_suffix": "</w>", "unk_token": "<unk>"}
    data = {"model": model, "added_tokens": [{"id": 1, "content": "<|startoftext|>"}, {"id": 2, "content": "<|endoftext|>"}, {"id": 99, "content": "a"}]}
    (tmp_path / "t.json").write_text(json.dumps(data))
    t = T.read_tokenizer(spark, f"{tmp_path}/t.json")
    assert t["kind"] == "clip" and t["vocab"]["a"] == 5 and (t["begin"], t["end"], t["unknown"]) == (1, 2, 3)
    assert K.known_merges(t["vocab"], t["merges"]) == {("a", "b</w>"): 0}
    df = spark.createDataFrame([("AB ab q",), ("a " * 20,), ("",), (None,)], "text string")
    got = [r[0] for r in df.select(K.tokenizer(**t, length=6)("text")).collect()]
    assert got == [[1, 7, 7, 3, 2, 0], [1, 3, 3, 3, 3, 2], [1, 2, 0, 0, 0, 0], None]
    assert K.framed([7, 8, 9], [], 2, 3) == [7, 8, 2]


def test_suppression_keeps_the_best():
    boxes = pd.DataFrame({"image": 1, "id": [1, 2, 3], "score": [0.5, 0.9, 0.8], "l": [0, 0.05, 5.0], "t": 0.0, "r": [1, 1.05, 6.0], "b": 1.0})
    assert K.suppress(boxes)["id"].tolist() == [2, 3]


def test_names_in_queries():
    assert K.match_names("Anna und Anna Maria am See", ["Anna", "Anna Maria"]) == (["Anna Maria", "Anna"], "am See")
    assert K.match_names("annabell mit hut", ["Anna"]) == ([], "annabell hut")
    assert K.match_names("Hund & Katze", []) == ([], "Hund & Katze")


def test_queries_meet_names_by_their_words(spark):
    names = ["Ida", "Ida B.", "Mary Ann", "J.R. Smith", "Bo", "bo", "Ann", "Person 1", "Person 12", "Ö"]
    asked = ["ida, bo!", "IDA b. at the sea", "mary  ann", "Mary Ann und Ann.", "j.r. smith? bo.", "Person 12", "person 1.", "nobody", "", "idaho bob", "ö mit Bo"]
    got = {r["query"]: (r["names"], r["rest"]) for r in P.matched_queries(spark.createDataFrame([(q,) for q in [*asked, None]], "query string"), spark.createDataFrame([(n,) for n in [*names, None, "", " "]], "name string")).collect()}
    assert got == {q: K.match_names(q, [n for n in names if n]) for q in asked}
    assert P.matched_queries(spark.createDataFrame([("Ida",)], "query string"), spark.createDataFrame([], "name string")).first()["names"] == []


def test_day_labels(spark):
    today = dt.date(2024, 3, 1)
    days = [dt.date(2024, 3, 1), dt.date(2024, 2, 29), dt.date(2024, 2, 27), dt.date(2024, 2, 24), dt.date(2024, 2, 23), dt.date(2023, 12, 31), dt.date(2024, 3, 9)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = [r[0] for r in df.select(S.day_header(F.col("d"), today)).collect()]
    assert got == ["Heute", "Gestern", "Dienstag", "Samstag", "Fr., 23. Februar", "So., 31. Dezember 2023", "Sa., 9. März"]


def test_byte_labels(spark):
    df = spark.createDataFrame([(0,), (999,), (1500,), (2500,), (1_250_000_000,), (1_350_000_000,), (-2_000_000,)], "n long")
    assert [r[0] for r in df.select(S.fmt_bytes(F.col("n"))).collect()] == ["0 B", "999 B", "2 KB", "2 KB", "1,2 GB", "1,4 GB", "-2 MB"]


def test_memories_at_leap_days(spark):
    items = spark.createDataFrame([(1, dt.date(2020, 2, 29)), (2, dt.date(2022, 2, 25)), (3, dt.date(2022, 3, 4)), (4, dt.date(2023, 2, 28)), (5, dt.date(2019, 12, 31))], "id long, date date")
    assert {tuple(r) for r in C.memories(items, dt.date(2023, 2, 28)).collect()} == {(1, 3), (2, 1)}


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).withColumn("x", (F.col("id") * 7919) % 1000).repartition(5)
    got = [r["x"] for r in numbered(df, F.desc("x")).orderBy("pos").collect()]
    assert got == list(range(999, -1, -1))
    assert numbered(df.limit(0), F.col("x")).count() == 0


def test_partitions_follow_the_input(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert partitions(docs) == 4 and partitions(docs.select("doc_id", "text"), each=1000, most=50) == 50
    assert partitions(docs.join(docs.select("doc_id"), "doc_id"), each=1) == 4  # no estimate through a join


def test_scratch_clears_what_was_written(spark):
    df = spark.range(10)
    with scratch(spark) as keep:
        gone, path = stored(df, "gone")
        kept = checkpoint(df.withColumn("x", F.col("id") * 2))
        keep.add(path_of(kept))
    assert kept.count() == 10
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files)


def test_scratch_is_of_its_thread(spark):
    started, written, read = threading.Event(), threading.Event(), []

    def other():
        with scratch(spark):
            held, path = stored(spark.range(7), "other")
            started.set()
            written.wait(60)
            read.append((held.count(), path))

    def exists(path):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    thread = InheritableThread(target=other)
    with scratch(spark):
        thread.start()
        assert started.wait(60)
        mine, path = stored(spark.range(5), "mine")
        with scratch(spark) as keep:  # what an inner block keeps is the outer one's
            inner = stored(spark.range(3), "inner")[1]
            keep.add(inner)
        assert exists(inner) and mine.count() == 5
    written.set()
    thread.join(120)
    assert read[0][0] == 7 and not exists(path) and not exists(inner) and not exists(read[0][1])


def test_near_pairs_at_the_window(spark):
    v = [1.0, 0.0]
    items = spark.createDataFrame([(1, 0, v), (2, 0, v), (3, 100, v), (4, 201, v), (5, 301, [0.0, 1.0])], "id long, ts_ms long, vector array<double>")
    assert {tuple(r) for r in V.near_pairs(items, 0.9, 100).collect()} == {(1, 2), (1, 3), (2, 3)}
    hot = items.unionByName(spark.createDataFrame([(10 + i, 5000, v) for i in range(30)], items.schema))
    assert sorted(map(tuple, V.near_pairs(hot, 0.9, 100, block=40).collect())) == sorted(map(tuple, V.near_pairs(hot, 0.9, 100).collect()))
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(40, 30)], "a long, b long")
    assert {tuple(r) for r in V.groups(chain).collect()} == {(i, 1) for i in range(1, 21)} | {(30, 30), (40, 30)}


def test_search_of_nothing_and_other_lengths(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<double>")
    assert V.search(v, [1.0, 0.0, 0.0]).count() == 0
    assert [r["id"] for r in V.search(v, [1.0, 0.0], least=1, strictness=9.0).collect()] == [1]


def test_upserts_and_updates(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y")], "k long, v string")
    assert {tuple(r) for r in M.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "x"), (3, "y")}
    assert {tuple(r) for r in M.update_where(old, F.col("k") > 1, v=F.lit("z")).collect()} == {(1, "a"), (2, "z")}


def test_leaders_in_order():
    leaders = P.Leaders(0.9)
    e = np.eye(3)
    assert [leaders.add(v) for v in (e[0], e[1], e[0], (e[0] + 0.1 * e[1]) / np.linalg.norm(e[0] + 0.1 * e[1]), e[2])] == [0, 1, 0, 0, 2]
    assert leaders.counts == [3, 1, 1] and abs(np.linalg.norm(leaders.centers[0]) - 1) < 1e-12


def test_leaders_pass_in_batches(spark):
    rng = np.random.default_rng(4)
    rows = [(None if i % 3 == 0 else f"m{i % 3}", i, rng.normal(size=3).tolist()) for i in rng.permutation(90).tolist()]
    faces = spark.createDataFrame(rows, "model string, id long, embedding array<double>").repartition(3)
    loose = faces.select("id", F.lit(None).cast("long").alias("person_id"), F.lit(False).alias("confirmed"), "embedding", *(F.lit(0.0).alias(c) for c in ("score", "l", "r")))
    want, one, everyone = set(), {}, P.Leaders(0.5)
    for model, i, v in sorted(rows, key=lambda r: r[1]):
        want.add((model, i, one.setdefault(model, P.Leaders(0.5)).add(v)))
    whole = {(i, -1 - everyone.add(v)) for _, i, v in sorted(rows, key=lambda r: r[1])}
    people = spark.createDataFrame([], "id long, name string, cover_face_id long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got, again = P.leader_clusters(faces, 0.5), P.regrouped(people, loose, 0.5)[1]
        assert {tuple(r) for r in got.collect()} == want and {tuple(r) for r in again.collect()} == whole
        for df in (got, again):  # no task takes a whole group as one frame
            assert "GroupsInPandas" not in df._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_copies_are_equal_to_the_end(spark):
    files = spark.createDataFrame([(1, 5, "abcdX"), (2, 5, "abcdY"), (3, 5, "abcdX"), (4, 3, "abc"), (5, 3, "abc")], "id long, size long, content string")
    got = C.exact_duplicates(files, prefix=4).select("size", "n", "first_id", "reclaimable").collect()
    assert {tuple(r) for r in got} == {(5, 2, 1, 5), (3, 2, 4, 3)}


def test_replay(spark):
    faces = spark.createDataFrame([(1, 7, False), (2, 8, False), (3, None, False), (4, 9, True)], "id long, person_id long, confirmed boolean")
    log = [(1, "confirm", 1, 8, None), (2, "merge", None, 5, 8), (3, "reject", 2, 5, None), (4, "assign", 3, 9, None), (5, "reject", 4, 1, None)]
    log = spark.createDataFrame(log, "seq long, kind string, face_id long, person_id long, other_id long")
    assert {tuple(r) for r in G.replay(faces, log).collect()} == {(1, 5, True), (2, None, False), (3, 9, False), (4, 9, True)}


def test_regrouping(spark):
    e = np.eye(3).tolist()
    faces = [(1, 7, True, e[0]), (2, 7, False, e[1]), (3, None, False, e[0]), (4, 8, False, e[1]), (5, 9, False, e[2])]
    faces = spark.createDataFrame([(*f, 0.5, 0.0, 0.1) for f in faces], "id long, person_id long, confirmed boolean, embedding array<double>, score double, l double, r double")
    people = spark.createDataFrame([(7, None, 2), (8, None, 4), (9, "Ida", 5)], "id long, name string, cover_face_id long")
    kept, again = P.regrouped(people, faces, 0.9)
    assert {tuple(r) for r in kept.collect()} == {(7, None, 1, 1), (9, "Ida", 0, None)}
    assert {tuple(r) for r in again.collect()} == {(1, 7), (2, -1), (3, 7), (4, -1), (5, -2)}
    named = spark.createDataFrame([(1, "Ida"), (2, "Idris"), (3, "Bo")], "id long, name string")
    assert [r[0] for r in P.rename_suggestions(named, " ID", 1).collect()] == ["Idris"]


def test_exif_and_crops(spark):
    df = spark.createDataFrame([({"Make": "A", "Model": "B", "FNumber": "1.8", "ExposureTime": "0.004", "PhotographicSensitivity": "100", "FocalLength": "24"},), ({},)], "e map<string,string>")
    got = [tuple(r) for r in df.select(*(c.alias(n) for n, c in S.exif_display(F.col("e")).items())).collect()]
    assert got == [("A B", "f/1,8", "1/250 s", "ISO 100", "24,0 mm"), (None, None, None, None, None)]
    box = tuple(F.lit(x) for x in (0.75, 0.5, 1.0, 0.75))
    assert tuple(spark.range(1).select(S.face_crop(box, F.lit(1000), F.lit(500))).first()[0]) == (575, 75, 425)


def test_many_centers_meet_in_blocks(spark):
    rng = np.random.default_rng(2)
    x, c = rng.normal(size=(50, 4)), rng.normal(size=(9, 4))
    c[7] = c[2]  # equal centers: the smaller person
    faces = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(90, [1.0])], "id long, embedding array<double>")
    centers = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "person_id long, centroid array<double>")
    no = [(i, i % 9) for i in range(50)] + [(3, p) for p in range(9)] + [(4, 77)]
    want = {}
    for i in range(50):
        allowed = [p for p in range(9) if (i, p) not in no]
        if allowed:
            score = max((float((x[i] * c[p]).sum()), -p) for p in allowed)
            want[i] = (-score[1] if score[0] >= 0.1 else None, score[0])
    no = spark.createDataFrame(no, "face_id long, person_id long")
    for options in ({}, {"part_bytes": 96}, {"part_bytes": 96, "most_parts": 9}, {"part_bytes": 96, "slice_rows": 7}):
        got = {r["face_id"]: (r["person_id"], r["score"]) for r in P.assign_nearest(faces, centers, no, 0.1, **options).collect()}
        assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-12 for i in want)
    assert P.assign_nearest(faces, centers.limit(0), no, 0.1).count() == 0


def test_components_of_a_long_chain(spark):
    """Many rounds, each of which must cost as much as the one before."""
    ids = np.random.default_rng(3).permutation(5000).tolist()
    edges = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a long, b long").repartition(4)
    began = time.perf_counter()
    out = components(edges, 0)
    assert {(r["n"], r["m"]) for r in out.groupBy("comp").agg(F.count("*").alias("n"), F.min("v").alias("m")).collect()} == {(5000, 0)}
    assert time.perf_counter() - began < 90


def plain_pairs(rows, threshold, window):
    x = np.array([v for _, _, v in rows])
    s = x @ x.T
    return {
        (a, b) for i, (a, ta, _) in enumerate(rows) for j, (b, tb, _) in enumerate(rows)
        if s[i, j] >= threshold and (ta, a) < (tb, b) and tb - ta <= window
    }


@pytest.mark.parametrize(("threshold", "length"), [(0.93, 1.0), (0.93, 1.3), (0.2, 1.0), (-0.1, 1.0), (1.9, 1.0)])
def test_bursts_lose_no_pair(spark, threshold, length):
    rng = np.random.default_rng(4)
    scenes = rng.normal(size=(12, 8))
    x = scenes[rng.integers(12, size=300)] + 0.15 * rng.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x *= rng.uniform(0.7, length, size=(300, 1)) if length > 1 else 1
    x[5] = 0
    rows = [(i, int(rng.integers(0, 2500)), v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, ts_ms long, vector array<double>")
    want = plain_pairs(rows, threshold, 1000)
    for block in (1 << 24, 200):
        got = [tuple(r) for r in V.near_pairs(df, threshold, 1000, block=block, most_pivots=9).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert want or threshold > 1


@pytest.mark.parametrize(("threshold", "block"), [(0.3, 1 << 24), (0.3, 200), (0.93, 200), (-0.1, 200)])
def test_groups_need_no_pairs(spark, threshold, block):
    """Trees of links: fewer edges than a block has items, groups as of all pairs; ids may repeat, vectors miss parts."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(240, 16))
    x[:40] = x[0] + 0.1 * x[:40]
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, int(rng.integers(0, 6000)), v.tolist()) for i, v in enumerate(x)]
    rows += [(7, 100, [1.0] + [0.0] * 15), (900, 9000, [1.0, 1.0]), (900, 9001, [1.0, 1.0]), (901, 9001, [None, 1.0]), (902, 9001, None), (903, 9001, [math.nan, 1.0])]
    df = spark.createDataFrame(rows, "id long, ts_ms long, vector array<double>")
    pairs = [tuple(r) for r in V.near_pairs(df, threshold, 1000, block=block, most_pivots=9).collect()]
    sound = [r for r in rows if r[2] and None not in r[2]]
    assert sorted(pairs) == sorted(
        (a, b) for a, ta, v in sound for b, tb, w in sound
        if len(v) == len(w) and (ta, a) < (tb, b) and tb - ta <= 1000 and not sum(p * q for p, q in zip(v, w, strict=True)) < threshold
    )
    made = spark.createDataFrame(pairs, "a long, b long")
    got = V.near_groups(df, threshold, 1000, block=block, most_pivots=9).collect()
    assert len(pairs) > 200 and sorted(map(tuple, got)) == sorted(map(tuple, V.groups(made).collect())) and (900, 900) in map(tuple, got)


def test_a_large_group_is_ranked_by_many_tasks(spark):
    rng = np.random.default_rng(10)
    pdf = pd.DataFrame(rng.integers(0, 4, size=(4000, 5)), columns=["is_favorite", "width", "height", "size", "ts_ms"])
    pdf["id"], pdf["grp"] = np.arange(4000), np.where(np.arange(4000) < 3900, 5.0, np.where(np.arange(4000) < 3950, 6, np.nan))
    df, _ = stored(spark.createDataFrame(pdf).withColumn("grp", F.nanvl("grp", F.lit(None).cast("double"))), "ranked")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the small result goes to one task in the end
    try:
        out = C.best_first(df, "grp").withColumn("task", F.spark_partition_id()).toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert out[out["grp"] == 5]["task"].nunique() > 1 and dict(C.best_first(df, "grp").dtypes)["rank"] == "int"
    pdf["pixels"] = pdf["width"] * pdf["height"]
    want = pdf.sort_values(["is_favorite", "pixels", "size", "ts_ms", "id"], ascending=[False, False, False, True, True])
    want["rank"] = want.groupby("grp", dropna=False).cumcount() + 1
    assert dict(zip(out["id"], out["rank"], strict=True)) == dict(zip(want["id"], want["rank"], strict=True))
    assert ((out["rank"] > 1) == out["preselected"]).all()


def test_groups_of_dense_times_have_few_edges(spark):
    rng = np.random.default_rng(8)
    rows = [(i, int(rng.integers(0, 4000)), v.tolist()) for i, v in enumerate(rng.normal(size=(2000, 4)))]
    df = spark.createDataFrame(rows, "id long, ts_ms long, vector array<double>")
    edges = V._linked(df, 0.25, 1000, 1 << 24, 2048, trees=True)
    assert V.near_pairs(df, 0.25, 1000).count() > 100 * len(rows) and edges.count() <= 2 * len(rows)


def test_bursts_without_structure_are_not_copied_to_pivots(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"id": np.arange(3000), "ts": 0, "v": rng.normal(size=(3000, 64)).tolist()})
    rows = spark.createDataFrame(pdf, "id long, ts long, v array<double>").withColumn("k", F.lit(0).cast("long"))
    a, b = V.burst_cells(rows, rows, spark.createDataFrame([(0, 3000, 0)], "k long, n long, next long"), 20.0, 1 << 20)
    assert a.count() + b.count() <= 4 * 3000 * 3


def test_bursts_multiply_few(spark):
    """A burst of 20,000 photos of 100 scenes: cells hold a tenth of all pairs at most."""
    rng = np.random.default_rng(6)
    n = 20_000
    x = rng.normal(size=(100, 32))[rng.integers(100, size=n)] + 0.2 * rng.normal(size=(n, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    pdf = pd.DataFrame({"id": np.arange(n), "ts": rng.integers(0, 1000, n), "v": x.tolist()})
    rows = spark.createDataFrame(pdf, "id long, ts long, v array<double>").withColumn("k", F.lit(0).cast("long"))
    hot = spark.createDataFrame([(0, n, 0)], "k long, n long, next long")
    a, b = V.burst_cells(rows, rows, hot, 0.93, 1 << 24)
    keys = ["k", "cell", "p", "q"]
    met = a.groupBy(*keys).count().withColumnRenamed("count", "n").join(b.groupBy(*keys).count(), keys)
    assert met.agg(F.sum(F.col("n") * F.col("count"))).first()[0] < n * (n - 1) / 2 / 10


def test_components_of_few_and_many_edges(spark):
    edges = spark.createDataFrame([(1, 2), (5, 2), (7, 8), (9, 9), (8, 10), (10, 7), (3, 1)], "a long, b long")
    want = {(1, 1), (2, 1), (3, 1), (5, 1), (7, 7), (8, 7), (10, 7)}
    for few in (8192, 0):
        assert {tuple(r) for r in components(edges, few).collect()} == want
        assert components(edges.limit(0), few).count() == 0


def test_colour_matrices_compose():
    a, b = np.eye(5), np.eye(5)
    a[:4], b[:4] = np.array(EQ.saturation(0.3)).reshape(4, 5), np.array(EQ.shifted((2.0, 1.0, 0.5), (1.0, 2.0, 3.0))).reshape(4, 5)
    assert np.allclose(np.array(EQ.saturation(1.0)).reshape(4, 5)[:3, :3], np.eye(3))
    rgb = np.array([10.0, 20.0, 30.0, 255.0, 1.0])
    grey = np.array([0.213, 0.715, 0.072]) @ rgb[:3]
    want = 0.7 * grey + 0.3 * (rgb[:3] * [2.0, 1.0, 0.5] + [1.0, 2.0, 3.0]) + 0.7 * (np.array([0.213, 0.715, 0.072]) @ (rgb[:3] * [1.0, 0.0, -0.5] + [1.0, 2.0, 3.0]))
    assert np.allclose((a @ b @ rgb)[:3], want)


def test_colour_matrix_columns(spark):
    a, b = EQ.saturation(0.3), EQ.shifted((2.0, 1.0, 0.5), (1.0, 2.0, 3.0))
    lit = lambda m: F.array(*(F.lit(float(x)) for x in m))
    got = spark.range(1).select(EQ.concat_matrix(lit(a), lit(b))).first()[0]
    full = lambda m: np.vstack([np.array(m).reshape(4, 5), [0, 0, 0, 0, 1]])
    assert np.allclose(np.array(got).reshape(4, 5), (full(a) @ full(b))[:4])


def test_files_and_jobs(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/deep/a.jpg").write_bytes(b"x" * 10)
    (tmp_path / "in/b.txt").write_bytes(b"y")
    found = T.list_files(spark, f"{tmp_path}/in", "*.jpg").collect()
    assert [(r["path"].rsplit("/", 1)[1], r["length"]) for r in found] == [("a.jpg", 10)]
    (tmp_path / "job.json").write_text(json.dumps({"ids": [3, 1, 2], "settings": {"quality": "80"}}))
    jobs = T.read_jobs(spark, f"{tmp_path}/job.json").orderBy("position").collect()
    assert [r["id"] for r in jobs] == [3, 1, 2] and jobs[0]["settings"] == {"quality": "80"}


def drained(query):
    query.processAllAvailable()
    query.stop()


@pytest.fixture()
def event_files(spark, small, tmp_path):
    rows = spark.read.parquet(f"{small}/events.parquet")
    rows.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 250).parquet(f"{tmp_path}/events")
    return f"{tmp_path}/events", rows


def test_live_counts_stream(spark, event_files):
    path, rows = event_files
    stream = ST.live_counts(ST.event_stream(spark, path, rows.schema))
    drained(stream.writeStream.outputMode("complete").format("memory").queryName("live").start())
    assert sorted(map(tuple, spark.table("live").collect())) == sorted(map(tuple, ST.live_counts(rows).collect()))


def test_debounced_stream(spark, event_files):
    path, rows = event_files
    stream = ST.debounced(ST.event_stream(spark, path, rows.schema), "user_id", "6 hours")
    drained(stream.writeStream.outputMode("append").format("memory").queryName("calm").start())
    whole = {tuple(r) for r in ST.debounced(rows.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "6 hours").collect()}
    got = {tuple(r) for r in spark.table("calm").collect()}
    assert got and got <= whole and len(got) > 0.8 * len(whole)  # the last bursts stay open


def test_cluster_stream_equals_table(spark, small, tmp_path):
    faces = T.faces(spark, small).select((F.col("id") % 3).cast("string").alias("model"), "id", "embedding")
    for k in range(3):
        faces.where(F.floor(F.col("id") / 170) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/faces")
    stream = spark.readStream.schema(faces.schema).parquet(f"{tmp_path}/faces")
    drained(ST.cluster_stream(stream, 0.25).writeStream.outputMode("append").format("memory").queryName("clusters").start())
    want = {tuple(r) for r in P.leader_clusters(faces, 0.25).collect()}
    assert {tuple(r) for r in spark.table("clusters").collect()} == want


def test_upserts_by_batch_and_one_query_a_name(spark, tmp_path):
    schema = "k long, v string"
    for i, rows in enumerate(([(1, "a"), (2, "b")], [(2, "x"), (3, "y")], [(1, "z")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    writer = ST.upsert_batches(stream, f"{tmp_path}/out", ["k"]).option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="0 seconds")
    one = ST.start_once(spark, writer, "upserts")
    assert ST.start_once(spark, writer, "upserts").id == one.id
    drained(one)
    assert {tuple(r) for r in Snapshots(spark, f"{tmp_path}/out", ["k"]).read().collect()} == {(1, "z"), (2, "x"), (3, "y")}
    two = ST.start_once(spark, stream.writeStream.format("memory"), "other")
    three = ST.start_once(spark, stream.writeStream.format("memory"), "other", replace=True)
    assert three.id != two.id and not two.isActive
    drained(three)
