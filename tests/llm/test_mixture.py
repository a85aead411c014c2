"""The mixture: quotas to the word, and ``taken`` recomputed from the slots in plain Python."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from galeria.llm import mix, shard


def test_inverse_permutation():
    for n in (1, 2, 3, 16, 17, 1000, 4097):
        x = shard.permute(np.arange(n), n, 5)
        assert shard.permute(x, n, 5, inverse=True).tolist() == list(range(n))


def test_quotas_take_the_targets():
    r = random.Random(3)
    for block in (1, 7, 64):
        sizes = [r.choice((0, 1, r.randint(1, 300), r.randint(1, 5000))) for _ in range(40)] + [100, 60, 45]
        wanted = mix.targets(sizes)
        for i, (size, target, (n, draws, last)) in enumerate(zip(sizes, wanted, mix.quotas(sizes, wanted, block, seed=2), strict=True)):
            taken = 0
            for d in range(draws):
                k = int(shard.permute(np.array([d % n]), n, mix.round_key(2, i, d // n))[0])
                words = min(block, size - k * block)
                taken += min(last, words) if d == draws - 1 else words
            assert taken == round(target), (block, size, target)


def test_taken_from_the_slots(spark):
    r = random.Random(4)
    docs = [(i, r.choice(("a", "b", "b", "c", None)), " ".join(f"w{r.randint(0, 99)}" for _ in range(r.choice((0, 1, 5, 40, 200))))) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(4)
    m = mix.Mixture(df, block=16, slots=8, seed=1)
    slots = m.slots.collect()
    sizes = defaultdict(int)
    for s in slots:
        sizes[s["shard"]] += 1
    assert sorted(sizes) == list(range(len(sizes))) and all(n == 8 for k, n in sizes.items() if k < len(sizes) - 1)
    stream = defaultdict(list)  # every source's words in order, as (document, word)
    for doc_id, source, text in sorted(docs, key=lambda d: (d[1] is None, d[1] or "", d[0])):
        stream[m.sources.index(source)] += [(doc_id, k) for k in range(len(text.split()))]
    want, rounds = defaultdict(int), defaultdict(set)
    for s in slots:
        for doc_id, k in stream[s["source_index"]][16 * s["block"] : 16 * s["block"] + s["most"]]:
            want[doc_id] += 1
            assert (doc_id, k) not in rounds[s["round"]]
            rounds[s["round"]].add((doc_id, k))
    got = {x["key"]: x["taken"] for x in m.taken().collect()}
    assert got == {d: want[d] for d, *_ in docs}
    per = defaultdict(int)
    for d, source, _ in docs:
        per[m.sources.index(source)] += got[d]
    assert [per[i] for i in range(len(m.sources))] == [round(t) for t in m.targets]
    out = mix.mix_documents(df, n_chars=None, block=16, slots=8, seed=1).groupBy("doc_id").agg(F.sum(mix.word_count(F.col("text"))).alias("n"))
    assert {x["doc_id"]: x["n"] for x in out.collect()} == {d: n for d, n in want.items() if n}


def test_shards_in_groups_keep_their_size(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.repeat(F.lit("w "), 50).alias("text"))
    slots = mix.Mixture(docs, block=8, slots=16, groups=4).slots.groupBy("shard").count().orderBy("shard").collect()
    assert [x["shard"] for x in slots] == list(range(len(slots))) and len(slots) > 16
    assert all(x["count"] == 16 for x in slots[:-1])


def test_mixture_equals_sql(spark, small):
    import duckdb

    got = mix.op9_mix(spark, small).select("doc_id", "size", "source_size", "target", "taken").collect()
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    assert sorted(map(tuple, got)) == sorted(duck.sql(mix.ORACLE_SQL).fetchall())


def test_very_many_sources(spark):
    """A source for every two documents: targets to the word, by a shuffle of what is known of the sources."""
    n = 40_000
    docs = spark.range(2 * n).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % n).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")).alias("text"))
    m = mix.Mixture(docs, block=8, keep=["doc_id", "source"], sent_sources=100)
    got = m.taken().groupBy("i").agg(F.sum("taken").alias("t"), F.max(F.col("taken") - 2 * F.col("n")).alias("over")).collect()
    assert len(got) == n and all(r["t"] == round(m.targets[r["i"]]) and r["over"] <= 0 for r in got)
