"""The trained models against direct computation, the permutation's SQL, and odd rows through the whole pipeline."""

from __future__ import annotations

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from galeria.llm import langid, quality, shard

DOCS = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def texts(spark, small):
    return [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").limit(60).collect()]


def test_language_scores_equal_a_direct_convolution(texts):
    rng = np.random.default_rng(2)
    x = np.concatenate([langid.windows((t or "").encode())[:6] for t in texts])
    net = langid.Network.fit(x, rng.integers(3, size=len(x)), ["a", "b", "c"], epochs=1)
    got = net.scorer(chunk=50)(x)
    e = net.embed[x].astype(np.float64)
    tops = []
    for w, f, b in zip(langid.WIDTHS, net.filters, net.biases, strict=True):
        at = np.stack([e[:, i : i + w].reshape(len(x), -1) @ f + b for i in range(langid.WINDOW - w + 1)], 1)
        tops.append(np.maximum(at, 0).max(1))
    s = np.concatenate(tops, 1) @ net.out + net.bias
    want = np.exp(s - s.max(1, keepdims=True))
    assert np.allclose(got, want / want.sum(1, keepdims=True), atol=1e-4)


def test_language_of_a_text_is_the_weighted_mean_of_its_windows(spark, texts):
    rng = np.random.default_rng(4)
    x = np.concatenate([langid.windows((t or "").encode())[:2] for t in texts])
    net = langid.Network.fit(x, rng.integers(2, size=len(x)), ["a", "b"], epochs=1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out, pred, score = langid.predict(df, net)
    run = net.scorer()
    for r in out.collect():
        data = (r["text"] or "").encode()
        if not langid.has_letter(r["text"]):
            assert (r[pred], r[score]) == ("und", 0)
            continue
        w = langid.windows(data)
        p = np.average(run(w), axis=0, weights=[min(langid.STEP, max(1, len(data) - langid.STEP * k)) for k in range(len(w))])
        assert r[pred] == net.langs[int(p.argmax())] and abs(r[score] - p.max()) < 1e-5


def test_quality_scores_equal_dense_algebra(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    scorer, rates, good = quality.fit(docs, bits=8)
    out, score = quality.scored(docs, scorer)
    for r in out.collect():
        m = quality.measures(r["text"])
        x = np.zeros(256)
        for i, v in quality.hashed(r["text"], m, 8).items():
            x[i] += v
        want = 1 / (1 + np.exp(-np.clip(x @ scorer.weights + scorer.bias, -30, 30))) if m else 0.0
        assert abs(r[score] - want) < 1e-9
    votes = Counter(quality.votes(quality.measures(t)) for t in texts)
    again, share, posterior = quality.estimate(dict(votes))
    assert np.allclose(again, rates) and abs(share - good) < 1e-12
    # the posteriors are a fixed point: Bayes' rule with the estimated rates gives them again
    for pattern, p in posterior.items():
        odds = share / (1 - share)
        for j, v in enumerate(pattern):
            if v != "0":
                odds *= again[j, 1, "-+".index(v)] / again[j, 0, "-+".index(v)]
        assert abs(odds / (1 + odds) - p) < 1e-4


def test_shards_equal_the_permutation_and_sql(spark, small):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    rows = sorted((k, len(t) + 1, zlib.crc32(t)) for k, t in rows)
    at = shard.permute(np.arange(len(rows)), len(rows), 0).tolist()
    want = sorted((*r, p % 16, p // 16) for r, p in zip(rows, at, strict=True))
    got = shard.op6_shard(spark, small).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
    assert sorted(map(tuple, got)) == want
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    assert sorted(duck.sql(f"SELECT doc_id, size, text_crc32, shard, slot FROM ({shard.ORACLE_SQL})").fetchall()) == want


ODD = [(1, None), (2, ""), (3, "  \n "), (4, "word " * 30_000), (None, "one two three four five six seven eight nine ten eleven twelve."), (6, "!!! ??? ###"),
       (7, "The same words stand here twice. They are read by all."), (7, "The same words stand here twice. They are read by all."), (7, "Other words under one key are another document. Yes."),
       (8, "the same words stand here TWICE. they are read by all.")]


def test_odd_rows_and_empty_tables_through_the_pipeline(spark, tmp_path):
    docs = spark.createDataFrame([(k, t, None, f"s{i % 2}" if i % 3 else None, len(t or "")) for i, (k, t) in enumerate(ODD)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("shard", F.lit("x")).withColumn("ROW", F.lit(1)).withColumn("hits", F.lit(2))
    bench = spark.createDataFrame([(1, None), (2, "seven eight"), (3, "")], "item_id long, text string")
    for name, rows in (("odd", docs), ("empty", docs.limit(0))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, f"{tmp_path}/odd")
        assert seen.columns == docs.columns, name
        assert stage(spark, docs.limit(0), f"{tmp_path}/odd").count() == 0
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd")
    rows = out.collect()
    assert out.columns[: len(docs.columns)] == docs.columns and len(rows) > 0
    assert all(r["text"] and r["text"].split() for r in rows)
    assert not any("seven eight" in r["text"] for r in rows)
    deduped = dict(corpus_pipeline.STAGES)["MinHash near-dedup"](spark, docs, f"{tmp_path}/odd").collect()
    assert sorted(str(r["doc_id"]) for r in deduped) == sorted(["1", "2", "3", "4", "None", "6", "7", "7"])


def test_a_key_of_many_rows_keeps_every_language(spark):
    """20,000 rows under one key: the sample neither loses a language nor grows beyond its bound."""
    r = F.pmod(F.xxhash64("id"), F.lit(26)).cast("int")
    word = lambda a: F.concat(*(F.char(F.lit(a) + (r + i) % 5) for i in range(6)), F.lit(" "))
    many = lambda key: spark.range(20_000).select(F.lit(key).cast("long").alias("doc_id"), F.lit("aa").alias("lang"), F.concat(F.repeat(word(97), 40), F.col("id").cast("string")).alias("text"))
    few = spark.range(300).select((F.col("id") + 1000).alias("doc_id"), F.lit("zz").alias("lang"), F.repeat(word(117), 40).alias("text"))
    held = []
    fit = langid.Network.fit
    try:
        langid.Network.fit = staticmethod(lambda x, y, langs, **o: held.append((len(x), langs)) or fit(x, y, langs, epochs=1))
        for key in (7, 115):
            langid.train(many(key).union(few), per_lang=400, per_text=8)
    finally:
        langid.Network.fit = fit
    for windows, langs in held:
        assert langs == ["aa", "zz"] and 400 < windows <= 2 * 400 * 8


def test_few_texts_in_many_rows_are_all_learned(spark, monkeypatch):
    texts = [f"{'This is a plain sentence with several words in it. ' * (i % 7 + 1)} {i}" if i % 2 else f"BUY NOW!!! $$$ {i} " * 20 for i in range(40)]
    learned = []
    fit = quality.Scorer.fit
    monkeypatch.setattr(quality.Scorer, "fit", staticmethod(lambda rows, labels, bits: learned.append(len(rows)) or fit(rows, labels, bits)))
    for rows, n in ((400_000, 40), (60_000, 6)):
        docs = spark.createDataFrame(list(enumerate(texts[:n])), "k int, text string")
        docs = spark.range(rows).select((F.col("id") % n).cast("int").alias("k")).join(F.broadcast(docs), "k").select("text")
        scorer, _, _ = quality.fit(docs)
        assert learned[-1] == n
    out, score = quality.scored(spark.createDataFrame([(t,) for t in texts], "text string"), scorer)
    by = {r["text"]: r[score] for r in out.collect()}
    assert all((by[t] > 0.5) == bool(i % 2) for i, t in enumerate(texts))


def test_a_bounded_sample_takes_the_lowest_hashes(spark):
    from galeria.llm.common import lowest

    df = spark.range(5000).select(F.xxhash64(F.col("id") % 700).alias("h"), "id")
    want = sorted(r[0] for r in df.select("h").distinct().collect())
    for most, about in ((50, 5000), (700, 5000), (900, 5000), (10, 10**9), (50, 1)):
        assert sorted(r["h"] for r in lowest(df, "h", most, about, F.first("id")).collect()) == want[:most]
    assert lowest(df.limit(0), "h", 10, 0, F.first("id")).count() == 0
