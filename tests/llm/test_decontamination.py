"""The benchmark's automaton: its memory, its parts and items longer than a part."""

from __future__ import annotations

import random

from pyspark.sql import functions as F
from test_text_operators import contaminated

from galeria.llm import decontam


def test_memory_of_a_part():
    r = random.Random(0)
    vocab = ["".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 9))) for _ in range(30_000)]
    text, size = [], 0
    while size < 1 << 20:
        text.append(r.choice(vocab))
        size += len(text[-1]) + 1
    found = decontam.Matcher([("a", " ".join(text))], 10)
    assert found.trie.get_stats()["total_size"] < 160 * size
    assert found.scan([w.encode() for w in text[500:600]]) == ([(0, 100)], {"a"})


def test_long_items_in_parts(spark):
    r = random.Random(1)
    vocab = [f"w{i}" for i in range(60)] + ["été", "日本"]
    make = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, make(n)) for i, n in enumerate((400, 30, 9, 10, 1, 250))] + [(None, make(12)), (7, None), (8, "...")]
    docs = [(i, make(40) + " " + " ".join((items[i % 7][1] or "").split()[3 * i : 3 * i + 10 + i % 4]) + " " + make(20)) for i in range(60)]
    bench = spark.createDataFrame(items, "item_id int, text string")
    df = spark.createDataFrame([*docs, (99, None)], "doc_id long, text string").repartition(3)
    want = {d: contaminated(t, [(i, x) for i, x in items if i is not None]) for d, t in docs}
    unnamed = {d: contaminated(t, items)[1] for d, t in docs}
    for most, bits in ((1 << 20, 1 << 27), (300, 1 << 27), (300, 1 << 10)):
        out, (n, hits, ids, _) = decontam.contamination(df, bench, max_items_bytes=most, most_bits=bits)
        rows = out.collect()
        assert len(rows) == len(docs) + 1
        for x in rows:
            if x["doc_id"] != 99:
                n_words, _, n_items, digest, _ = want[x["doc_id"]]
                assert (x[n], len(x[ids]), decontam.digest(x[ids])) == (n_words, n_items, digest)
                assert sum(h["end"] - h["first"] for h in x[hits]) == unnamed[x["doc_id"]]


def test_large_benchmarks_equal_the_automaton(spark, small):
    """The whole tables, through the automaton and through the windows' keys."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").withColumn("row", F.lit("x"))
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    found = []
    for most in (1 << 20, 1000):
        out, names = decontam.contamination(docs, bench, max_items_bytes=most)
        found.append(sorted((r["doc_id"], *(str(r[n]) for n in names)) for r in out.collect()))
        assert out.columns == ["doc_id", "text", "row", *names]
    assert found[0] == found[1] and sum(len(r[2]) > 2 for r in found[0]) > 1


def test_one_word_items_of_a_large_benchmark(spark):
    docs = spark.createDataFrame([(i, "yes " * (i % 50)) for i in range(300)], "doc_id long, text string")
    bench = spark.createDataFrame([("a", "Yes"), ("b", "no"), ("c", "x " * 300)], "item_id string, text string")
    out, (n, hits, ids, _) = decontam.contamination(docs, bench, max_items_bytes=10)
    for r in out.collect():
        k = r["doc_id"] % 50
        assert (r[n], [tuple(h) for h in r[hits]], r[ids]) == (k, [(0, k)] if k else [], ["a"] if k else [])
    assert decontam.contamination(docs.limit(0), bench, max_items_bytes=10)[0].count() == 0
