"""Added spans: secrets, precision and recall on texts of another generator, and overlaps in plain Python."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from galeria.llm import pii


def test_secrets(spark):
    hexa = "e7fbfec6a80404dc513b99d3fdbf2a6e53400638"
    rows = [(f'then token = "{hexa}" the', 1), (f"reverted in commit {hexa}.", 0), ("password: hunter2-blue", 1), ("-----BEGIN RSA PRIVATE KEY-----", 1), ("see src/main/java/2020-some-long-name-of-a-file", 0),
            ("A perfectly ordinary sentence about Donaudampfschifffahrtsgesellschaften.", 0), ("a" * 5000 + "1", 0), (None, 0)]
    out, spans = pii.find(spark.createDataFrame(rows, "text string, want int"))
    for r in out.collect():
        assert any(s["kind"] == "secret" for s in r[spans]) == bool(r["want"]), r["text"]
    first = out.first()
    s = first[spans][0]
    assert first["text"][s["start"] : s["end"]] == hexa


def test_thresholds_on_texts_of_another_generator(spark):
    trees, cuts = pii.model(spark)
    made = pii.made_texts(1000, seed=77, held_out=True)
    docs = spark.createDataFrame([(k, *m) for k, m in enumerate(made)], "k int, text string, a int, b int, y int")
    out, spans = pii.find(docs)
    hit, real, wrong, found = defaultdict(int), defaultdict(int), 0, 0
    for r in out.collect():
        got = [s for s in r[spans] if s["start"] < r["b"] and s["end"] > r["a"]]
        added = [s for s in got if not s["base"]]
        found += len(added)
        wrong += sum(pii.KINDS.index(s["kind"]) != r["y"] for s in added)
        if r["y"] >= 0:
            real[r["y"]] += 1
            hit[r["y"]] += any(pii.KINDS.index(s["kind"]) == r["y"] for s in got)
    assert wrong <= 0.15 * found
    assert sum(hit.values()) >= 0.85 * sum(real.values()), {pii.KINDS[k]: (hit[k], real[k]) for k in real}


def test_added_spans_against_python(spark, small):
    """Scores by the trees, thresholds and overlaps recomputed from the candidates."""
    trees, cuts = pii.model(spark)
    made = [m[0] for m in pii.made_texts(120, seed=5)] + [m[0] for m in pii.made_texts(120, seed=6, held_out=True)]
    texts = [" ".join(made[i : i + 4]) for i in range(0, len(made), 4)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    all_ = {r["doc_id"]: r["c"] for r in docs.select("doc_id", pii.candidates(F.col("text")).alias("c")).collect()}
    out, spans = pii.find(docs)
    for r in out.collect():
        rows = []
        for c in all_[r["doc_id"]]:
            score = 1.0 if c["base"] else float(trees.predict(np.array([[c["f"][f] for f in pii.FEATURES]]))[0])
            if c["base"] or score >= cuts[c["kind"]]:
                rows.append((c["start"], -c["end"], not c["base"], c["kind"]))
        want, reach = [], 0
        for start, end, added, kind in sorted(rows):
            if not added or -end > reach:
                want.append((start, kind, -end))
            reach = max(reach, -end)
        assert [(s["start"], pii.KINDS.index(s["kind"]), s["end"]) for s in r[spans]] == sorted(want)


def test_redaction_of_many_and_overlapping_spans(spark):
    many = "ä a@b.org, 10.0.0.1; " * 5000
    rows = [(1, many), (2, "a@b.org"), (3, "id +1 212 555 0100.20.30.40 end"), (4, ""), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    out, spans = pii.find(docs)
    got = {r["doc_id"]: (r["text"], r[spans]) for r in out.collect()}
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[1] == "ä [email], [ip]; " * 5000 and clean[2] == "[email]" and clean[4] == "" and clean[5] is None
    for k, (text, found) in got.items():
        want, to = "", 0
        for s in found or ():
            if s["start"] >= to:
                want += text[to : s["start"]] + f"[{s['kind']}]"
            to = max(to, s["end"])
        assert clean[k] == (None if text is None else want + text[to:])
