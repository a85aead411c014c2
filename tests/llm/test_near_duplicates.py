"""Near-duplicates where keys repeat and where many pages share one template."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from galeria.llm import dedup


def test_unlike_texts_under_one_key_both_stay(spark):
    one, two = "a b c d e f g", "h i j k l m n"
    rows = [(1, one, "p"), (1, two, "q"), (2, one, "r"), (3, two, "s"), (4, None, "t"), (4, None, "t"), (4, "", "u"), (None, one, "v"), (None, one, "v"), (5, "A b c d e f g", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_id string")
    out = dedup.deduplicated(docs)
    assert out.columns == docs.columns
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in out.collect())
    assert got == sorted([("1", one), ("1", two), ("4", "None"), ("4", ""), ("None", one), ("None", one)])
    found = dedup.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    assert sorted(r["component_id"] for r in found if r["doc_id"] in (1, 2, 3, 5)) == [1, 1, 1, 1, 1]


def template(n, shared=182, own=18, seed=0):
    """Pages of one template: ``own`` of their single words differ, so that pairs have 3-word sets of about 0.82."""
    r = random.Random(seed)
    base = [f"t{i}" for i in range(shared + own)]
    at = range(5, shared + own, (shared + own) // own)
    out = []
    for k in range(n):
        w = list(base)
        for j in list(at)[: own // 3]:
            w[j] = f"x{k}_{j}_{r.random()}"
        out.append((k, " ".join(w)))
    return out


def test_pages_of_one_template_make_no_pairs(spark, monkeypatch):
    docs = spark.createDataFrame(template(600), "doc_id long, text string").repartition(4)
    seen = []
    whole = dedup._weighed

    def counted(pairs, *args):
        seen.append(pairs.count())
        return whole(pairs, *args)

    monkeypatch.setattr(dedup, "_weighed", counted)
    got = dedup.near_duplicates(docs, words=3, percent=85).collect()
    assert all(r["component_id"] == r["doc_id"] and r["n_links"] == 0 for r in got)
    assert seen == [0]
    linked = dedup.near_duplicates(docs, words=3, percent=80).select("component_id").distinct().count()
    assert linked == 1


def test_hot_shingles_are_dealt_out(spark, monkeypatch):
    from test_text_operators import components

    docs = template(60, seed=1) + [(1000 + k, t.replace("t50 ", f"y{k % 4} ").replace("t90 ", f"z{k % 3} ")) for k, t in template(40, seed=2)]
    want = components(docs, 3, 83)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    plain = dedup._remaining
    for block in (1 << 24, 8):
        monkeypatch.setattr(dedup, "_remaining", lambda *a, block=block: plain(*a, block=block))
        got = dedup.near_duplicates(df.withColumn("n", F.lit(0)), words=3, percent=83).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def blocks(n, of=40, take=34, words=25, seed=0, shuffled=False):
    """Pages that are each a choice of common blocks."""
    r = random.Random(seed)
    held = [" ".join(f"b{i}w{j}" for j in range(words)) for i in range(of)]
    out = []
    for k in range(n):
        some = r.sample(range(of), take)
        out.append((k, " ".join(held[i] for i in (some if shuffled else sorted(some)))))
    return out


def test_pages_of_common_blocks(spark, monkeypatch):
    """Links equal a comparison of all pairs, and a pair is verified once, by its atoms."""
    from test_text_operators import components

    seen = []
    whole = dedup._weighed

    def counted(pairs, atoms, percent, each=1 << 18):
        rows = [tuple(r) for r in pairs.collect()]
        seen.append((len(rows), len(set(rows)), atoms.agg(F.max(F.size("atoms"))).first()[0]))
        return whole(pairs, atoms, percent, 500)

    monkeypatch.setattr(dedup, "_weighed", counted)
    for seed, shuffled in ((1, False), (2, True)):
        docs = blocks(120, of=20, take=17, words=12, seed=seed, shuffled=shuffled)
        want = components(docs, 3, 85)
        assert 1 < len({c for _, c in want.values()}) < 120 or shuffled
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        got = dedup.near_duplicates(df, words=3, percent=85).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(n == once for n, once, _ in seen) and max(n for n, _, _ in seen) > 500
    assert max(width for _, _, width in seen) < 17 * 10  # atoms, not shingles
