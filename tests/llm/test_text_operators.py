"""Operators over texts against plain Python, and on odd tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from galeria.llm import decontam, dedup, langid, licenses, mix, pii, quality, shard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LICENSES = "Under the MIT License. see Apache-License 2.0! GNU General Public License, MIT license MIT license"
PRIVATE = "ÄÖ mail a.b@c-d.org. or x@y ip 10.0.0.255 999.1.1.1 card 4111 1111 1111 1111 call +1 (212) 555-0100 ☎ 1.2.3.4.5.6.7.8 a@b.c.@d.e"
ODD = [
    (1, None, "en", None, 0),
    (2, "", None, "b", 0),
    (3, "   \t\n ", "en", "a", 6),
    (4, LICENSES, "en", "a", 90),
    (5, PRIVATE, "de", "a", 120),
    (6, "word " * 30_000, "en", "b", 150_000),
    (7, "One two three four five six seven eight nine ten eleven twelve", "en", "a", 60),
    (7, "One two three four five six seven eight nine ten eleven twelve", "en", "a", 60),
    (8, "one TWO three four five six seven eight nine ten eleven twelve", "en", None, 60),
    (9, "12345 67890 !!! ???", "fr", "b", 20),
    (10, "ÀÉ ñandú İstanbul ß 日本語 𝒳𝒴", "es", "b", 30),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture()
def as_table(spark, tmp_path):
    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


# -------------------------------------------------------------------- near duplicates


def components(docs, size, percent):
    """Components by comparing all pairs."""
    sets = {}
    for key, text, *_ in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[key] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: (len(s), find(k)) for k, s in sets.items()}


def test_near_duplicates_of_odd_rows(odd):
    got = dedup.near_duplicates(odd.withColumn("N", F.lit(1)).withColumn("rep", F.lit("x")), words=3, percent=85).collect()
    assert len(got) == len(ODD)
    want = components(ODD, 3, 85)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert want[8][1] == 7


def test_near_duplicates_of_chains_and_groups(spark):
    base = [f"w{i}" for i in range(120)]
    docs = [(1000 + k, " ".join(base[k : k + 100])) for k in range(12)]  # a chain: ends are unlike
    for k in range(60):  # a group around one text, at growing distance
        w = [f"v{i}" for i in range(100)]
        for j in range(k // 4):
            w[(7 * j + k) % 100] = f"x{k}_{j}"
        docs.append((2000 + k, " ".join(w)))
    docs += [(3000 + k, "the same few words again") for k in range(30)] + [(4000 + k, f"only {k} of these words") for k in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in dedup.near_duplicates(df, words=3, percent=85).collect()}
    assert got == components(docs, 3, 85)
    kept = dedup.deduplicated(df, words=3, percent=85).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({c for _, c in got.values()})


def test_near_duplicates_of_whole_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in dedup.op1_near_duplicates(spark, small).collect()}
    assert got == components(rows, 3, 85)


def test_near_duplicates_of_nothing(empty, spark):
    assert dedup.near_duplicates(empty).count() == 0
    assert dedup.deduplicated(spark.createDataFrame([(None, "a b c d e f"), (None, None)], "doc_id long, text string")).count() == 2


# -------------------------------------------------------------------- licenses


def license_row(text):
    w = words(text)
    places = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = sorted(i for i, _ in places)
    return len(w), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted({x for _, x in places}))


def test_licenses_against_python(spark, odd, small, as_table):
    more = spark.read.parquet(f"{small}/documents.parquet").select(*odd.columns)
    docs = odd.union(more.withColumn("doc_id", F.col("doc_id") + 1000))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = licenses.op2_license_scan(spark, as_table(documents=docs)).collect()
    assert len(got) == len(ODD) + more.count()
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == license_row(texts[r["doc_id"]])
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])


def test_license_rules_suppress_and_gate(spark):
    texts = ["Licensed under the GNU Lesser General Public License v2.1 or later.", "SPDX-License-Identifier: Apache-2.0", "Licensed under CC BY-NC 4.0.",
             "a license to fish", "The Mozilla Public License, version 2.0 and the BSD License"]
    docs = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    out, (_, found) = licenses.scan(docs.withColumn("Norm", F.lit(0)).withColumn("detections", F.lit("")))
    labels = {r["doc_id"]: [x["label"] for x in r[found]] for r in out.collect()}
    assert labels[0] == ["lgpl"] and labels[1] == ["apache"] and labels[3] == []
    assert "cc-by-nc" in labels[2] and labels[4] == ["mpl", "bsd"]
    assert 200 <= len(licenses.rules()) <= 400


def test_every_grant_of_every_family_is_found(spark):
    grants = "licensed released distributed published available provided covered governed".split()
    rows = [(f"This program is {g} {p} the {f[2]} v2 or later.", label) for label, f in licenses.FAMILIES.items() for g in grants for p in ("under", "by", "subject to")]
    out, (_, found) = licenses.scan(spark.createDataFrame(rows, "text string, label string").repartition(8))
    assert [tuple(r) for r in out.where(~F.array_contains(F.col(found)["label"], F.col("label"))).select("text", "label").collect()] == []


# -------------------------------------------------------------------- benchmark


def contaminated(text, items, size=10):
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(size, len(v))
        for i in range(len(v) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == v[i : i + n]:
                    hit |= set(range(j, j + n))
                    ids.add(str(item))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


ITEMS = [(1, "two three four five six seven eight nine ten eleven"), (10, "SIX seven"), (2, None), (3, "..."), (4, "word word"), (5, "ñandú"),
         (6, "three four five six seven eight nine ten eleven twelve thirteen"), (7, "six seven")]


def test_contamination_against_python(spark, odd, as_table):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = odd.where("doc_id <> 6")
    got = decontam.op4_decontaminate(spark, as_table(documents=docs, benchmark=bench)).collect()
    texts = {d: t for d, t, *_ in ODD}
    for r in got:
        assert tuple(r)[1:] == contaminated(texts[r["doc_id"]], ITEMS)
    assert len(got) == len(ODD) - 1


def test_contamination_in_parts_and_offsets(spark, odd, empty):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = odd.withColumn("N_WORDS", F.lit("mine"))
    one, (n, hits, items, offsets) = decontam.contamination(docs, bench)
    parts, names = decontam.contamination(docs, bench, max_items_bytes=20)
    assert n == "n_words_"
    key = lambda df, names: sorted(map(str, df.select("doc_id", *names).collect()))
    assert key(one, (n, hits, items, offsets)) == key(parts, names)
    row = one.where("doc_id = 8").first()
    a, b = row[offsets][0]
    assert row["text"].encode()[a:b].decode() == "TWO three four five six seven eight nine ten eleven twelve"
    assert one.where("doc_id = 6").first()[hits][0]["end"] == 30_000
    assert decontam.clean(empty, bench).count() == 0
    assert decontam.clean(odd, bench.limit(0)).count() == len(ODD)
    assert {r["doc_id"] for r in decontam.clean(odd, bench).collect()} == {1, 2, 3, 4, 5, 9}


# -------------------------------------------------------------------- quality


def test_quality_learns_without_labels(spark, small):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scorer, rates, good = quality.fit(docs)
    assert 0.7 < good < 0.97 and (rates[:, 1, 1] > 0.9).all()
    out, score = quality.scored(docs, scorer, keep=["doc_id"])
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = out.join(labels, "doc_id").select((F.col(score) >= 0.5).alias("kept"), "quality").collect()
    assert sum(r["kept"] == bool(r["quality"]) for r in rows) / len(rows) > 0.97
    assert all(r["kept"] for r in rows if r["quality"])


def test_quality_of_odd_rows(odd, empty):
    docs = odd.withColumn("quality_score", F.lit(2))
    scorer, _, _ = quality.fit(docs)
    out, score = quality.scored(docs, scorer)
    rows = out.collect()
    assert score == "quality_score_" and len(rows) == len(ODD)
    assert all(r[score] == 0 for r in rows if not (r["text"] or "").split()) and all(0 <= r[score] <= 1 for r in rows)
    assert quality.filtered(empty).count() == 0
    assert quality.filtered(docs).columns == docs.columns


def test_estimate_recovers_accuracies():
    import numpy as np

    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.7
    right = rng.random((20_000, 5)) < np.array([0.95, 0.9, 0.8, 0.75, 0.7])
    silent = rng.random((20_000, 5)) < 0.3
    counts = defaultdict(int)
    for row in np.where(silent, "0", np.where(right == y[:, None], "+", "-")):
        counts["".join(row)] += 1
    rates, good, _ = quality.estimate(counts)
    assert abs(good - 0.7) < 0.03
    assert np.abs((rates[:, 1, 1] + rates[:, 0, 0]) / 2 - np.array([0.95, 0.9, 0.8, 0.75, 0.7])).max() < 0.04


# -------------------------------------------------------------------- shards


def test_permutation_is_a_bijection():
    import numpy as np

    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        for key in (0, 9):
            assert sorted(shard.permute(np.arange(n), n, key).tolist()) == list(range(n))


def test_shards_of_odd_rows(spark, odd, empty, as_table):
    got = shard.op6_shard(spark, as_table(documents=odd)).collect()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    counts = [len(by.get(k, ())) for k in range(16)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(ODD)
    texts = {d: t for d, t, *_ in ODD}
    for r in got:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
    assert shard.sharded_documents(empty).count() == 0
    clash = odd.withColumn("shard", F.lit(1)).withColumn("Size", F.lit(2))
    out = shard.sharded_documents(clash)
    assert out.columns == [*clash.columns, "shard_", "slot"]


def test_shards_do_not_depend_on_partitions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    place = lambda df: sorted(map(tuple, shard.sharded_documents(df).select("doc_id", "shard", "slot").collect()))
    assert place(docs) == place(docs.repartition(7)) == place(docs.orderBy(F.desc("doc_id")))


# -------------------------------------------------------------------- languages


def test_languages(spark, small):
    got = langid.op8_language(spark, "/root/testdata/sf0.01").collect()
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) / len(held) > 0.97


def test_languages_of_odd_rows(spark, odd, empty, as_table):
    docs = odd.withColumn("score", F.lit("x"))
    got = {r["doc_id"]: r for r in langid.op8_language(spark, as_table(documents=docs)).collect()}
    assert all(got[d]["lang_pred"] == "und" and got[d]["score"] == 0 for d in (1, 2, 3, 9))
    assert all(got[d]["lang_pred"] in {"en", "de", "fr", "es"} for d in (4, 5, 6, 7, 8, 10))
    out, pred, score = langid.predict(empty, langid.train(empty))
    assert out.count() == 0 and (pred, score) == ("lang_pred", "score")


def test_every_language_is_learned(spark):
    rows = [(100 * k + i, f"{chr(0x4E00 + k) * 9} word {i}", f"l{k:02}") for k in range(70) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.train(docs, most_rows=140).langs == langid.train(docs).langs == [f"l{k:02}" for k in range(70)]


def test_windows_cover_every_byte():
    import numpy as np

    for n in (0, 1, 127, 128, 129, 253, 254, 1000):
        data = bytes((i % 255) + 1 for i in range(n))
        w = langid.windows(data)
        joined = bytes(np.concatenate([w[0], *(x[langid.WINDOW - langid.STEP :] for x in w[1:])]))
        assert joined.rstrip(b"\0") == data


# -------------------------------------------------------------------- mixture


def test_targets_reshare_what_is_over():
    t = mix.targets([10, 100, 100, 0])
    assert t[0] == 20 and t[3] == 0 and abs(sum(t) - 315) < 1e-9 and all(x <= 2 * s for x, s in zip(t, (10, 100, 100, 0), strict=True))
    assert mix.targets([]) == [] and mix.targets([0, 0]) == [0, 0]


def test_mixture(spark, small):
    got = [tuple(r) for r in mix.op9_mix(spark, small).collect()]
    rows = spark.read.parquet(f"{small}/documents.parquet").collect()
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows}
    source = {r["doc_id"]: r["source"] for r in rows}
    taken, target = defaultdict(int), {}
    for doc, n, total, want, t in got:
        assert n == size[doc] and 0 <= t <= 2 * n
        assert total == sum(size[d] for d in size if source[d] == source[doc])
        taken[source[doc]] += t
        target[source[doc]] = want
    assert len(got) == len(rows) and abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    assert all(abs(taken[s] - target[s]) <= 130 for s in target)
    assert sorted(got) == sorted(tuple(r) for r in mix.op9_mix(spark, small).collect())


def test_mixture_of_odd_rows(spark, odd, empty):
    docs = odd.withColumn("runs", F.lit(1)).withColumn("size", F.lit(2)).withColumn("part", F.lit(3))
    m = mix.Mixture(docs)
    assert m.sources == ["a", "b", None]
    taken = {(r["key"], r["at"], r["p"]): (r["n"], r["taken"]) for r in m.taken().collect()}
    assert len(taken) == len(ODD) and all(t <= 2 * n for n, t in taken.values())
    out = mix.mix_documents(docs)
    rows = out.collect()
    assert out.columns == docs.columns
    assert sum(len(r["text"].split()) for r in rows) == sum(t for _, t in taken.values())
    assert mix.mix_documents(empty).count() == 0 and mix.Mixture(empty).taken().count() == 0


def test_cut_words(spark):
    df = spark.createDataFrame([("a b\tc  d\ne f", [(0, 2), (2, 4), (5, 6)])], "t string, r array<struct<lo:int,hi:int>>")
    assert df.select(mix.cut_words(F.col("t"), F.col("r"))).first()[0].split() == ["a", "b", "c", "d", "f"]


# -------------------------------------------------------------------- personal data


def personal(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


TRICKY = ["1 " * 20_000, "a" * 100_000, "x@" + "a." * 5_000 + "b", "1.1.1.1.1.1.1.1.1", "+1 2 3 4 5 6 7 8 9 0 1 2 +44 20 7946 0958", "0255.1.1.1 256.1.1.1", "me (at) site (dot) org",
          "ssn 123-45-6789", "4111-1111-1111-1111 4111111111111111", "😀 a@b.co 😀 +49 30 1234567", "@@@a@b.c..d", "+" * 5_000]


def test_personal_data_against_python(spark, odd, small, as_table):
    more = spark.read.parquet(f"{small}/documents.parquet").select(*odd.columns)
    tricky = spark.createDataFrame([(5000 + i, t, None, None, 0) for i, t in enumerate(TRICKY)], SCHEMA)
    docs = odd.union(tricky).union(more.withColumn("doc_id", F.col("doc_id") + 10_000))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = pii.op10_pii(spark, as_table(documents=docs)).collect()
    assert len(got) == len(ODD) + len(TRICKY) + more.count()
    for r in got:
        base = personal(texts[r["doc_id"]])
        named = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(named).encode()).hexdigest()
        spans = [x for x in r["spans"].split(",") if x]
        assert set(named) <= set(spans)
        assert spans == sorted(spans, key=lambda x: (int(x.split(":")[1]), pii.KINDS.index(x.split(":")[0]), int(x.split(":")[2])))


def test_added_spans_and_redaction(spark):
    rows = [(1, "reach me at john (at) site (dot) com please", 1), (2, "her ssn 123-45-6789 is here", 1), (3, "order 123-45-6789 shipped", 1), (4, "mail a@b.org or call +1 212 555 0100.", 1), (5, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    out, spans = pii.find(docs)
    kinds = {r["doc_id"]: [s["kind"] for s in r[spans]] for r in out.collect()}
    assert spans == "spans_" and kinds[1] == ["email"] and kinds[2] == ["ssn"] and kinds[3] == [] and kinds[5] == []
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[4] == "mail [email] or call [phone]." and clean[3] == rows[2][1] and clean[5] is None
    trees, _ = pii.model(spark)
    assert len(trees.trees) == 24


def test_empty_tables(spark, empty, as_table):
    path = as_table(documents=empty, benchmark=spark.createDataFrame([], "item_id long, text string"))
    for query in (licenses.op2_license_scan, decontam.op4_decontaminate, shard.op6_shard, quality.op5_quality, langid.op8_language, mix.op9_mix, pii.op10_pii, dedup.op1_near_duplicates):
        assert query(spark, path).count() == 0
