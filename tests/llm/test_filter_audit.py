"""Filter interaction against plain Python: every order applied document by document."""

from __future__ import annotations

import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from galeria.llm import audit

SCHEMA, LABELS = "doc_id long, lang string, text string", "doc_id long, quality int, toxic int"


def failing(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = set()
    if len(words) < 100:
        out.add("A")
    if 100 * len(set(words)) < 80 * len(words):
        out.add("B")
    if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text):
        out.add("C")
    if re.search("[#$%&*|]", text):
        out.add("D")
    return out


def brute(docs, labels):
    """All rows, applying each order to the documents one filter after the other."""
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, t in labels if t == 1} - {None}
    rows = [(i, lang or "", text or "") for i, lang, text in docs]
    fails = []
    for i, _, text in rows:
        copy = i is not None and any(j is not None and j < i and t == text for j, _, t in rows)
        fails.append(failing(text) | ({"E"} if copy else set()))
    out = {}
    for part in {p for _, p, _ in rows}:
        mine = [(i, f) for (i, p, _), f in zip(rows, fails, strict=True) if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left, gone = list(mine), []
            for step, f in enumerate(order, 1):
                removed = [x for x in left if f in x[1]]
                redundant = sum(f in x[1] for x in gone)
                left = [x for x in left if f not in x[1]]
                gone += removed
                shapley[f] += len(removed)
                lost = [sum(i in s for i, _ in removed) for s in (good, toxic)]
                out[part, "".join(order), step] = [len(left), len(removed), redundant, sum(x[1] == {f} for x in mine), *lost]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def found(spark, docs, labels, **columns):
    rows = audit.interaction_audit(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS), **columns).collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in rows}
    assert len(out) == len(rows)
    return out


def corpus(seed, n):
    r = random.Random(seed)
    texts = [None, "", " \t\n", "#", "é" * 40, "ABC d", "Word " * 120, " ".join(f"w{i}" for i in range(150)), " ".join(f"X{i} $" for i in range(110)), "x y " * 60]
    texts += [" ".join(r.choice(["a", "B", "c|", "dd", f"e{i}"]) for i in range(r.randint(0, 160))) for _ in range(n // 4)]
    docs = [(i, r.choice(["en", "de", None, ""]), r.choice(texts)) for i in range(n)]
    return docs, [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, n, 2)]


def test_equals_filters_applied_in_order(spark):
    docs, labels = corpus(3, 80)
    docs += [(5, "en", docs[4][2]), (5, "en", docs[4][2]), (None, "en", "same"), (None, "de", "same"), (90, "de", "same"), (91, "en", "same"), (-4, None, "same")]
    labels += [(5, 1, 0), (5, 0, 1), (None, 1, 1), (7000, 1, 1)]
    assert found(spark, docs, labels) == brute(docs, labels)


def test_no_documents_and_no_labels(spark):
    assert found(spark, [], []) == {}
    docs = [(1, "en", "a")]
    got = found(spark, docs, [])
    assert got == brute(docs, []) and len(got) == 600


def test_a_text_that_most_rows_share(spark):
    docs = [(i, "en" if i % 3 else "de", "shared $ text") for i in range(500)] + [(600 + i, "fr", f"text {i}") for i in range(20)]
    got = found(spark, docs, [(0, 1, 1), (1, 1, 0)])
    assert got == brute(docs, [(0, 1, 1), (1, 1, 0)])


def test_clashing_columns_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "en", "word " * 300_000, 5), (2, "en", "Word " * 300_000, 6)], "doc_id long, lang string, text string, mask int")
    labels = spark.createDataFrame([(1, 1, 0, "x")], "doc_id long, quality int, toxic int, part string")
    got = {(r["filter_order"], r["step"]): r for r in audit.interaction_audit(docs, labels).collect()}
    assert got["BACDE", 1]["removed"] == 2 and got["BACDE", 1]["good_lost"] == 1 and got["ACBDE", 2]["removed"] == 1


def test_other_filters_and_their_number(spark):
    docs = spark.createDataFrame([(1, "en", "ab"), (2, "en", "b"), (3, "en", "")], SCHEMA)
    labels = spark.createDataFrame([], LABELS)
    two = {"x": lambda t: t.contains("a"), "y": lambda t: t.contains("b")}
    rows = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["shapley"]) for r in audit.interaction_audit(docs, labels, two).collect()}
    assert rows == {("xy", 1): (2, 1, 0, 1), ("xy", 2): (1, 1, 1, 3), ("yx", 1): (1, 2, 0, 3), ("yx", 2): (1, 0, 1, 1)}
    with pytest.raises(ValueError, match="filters"):
        audit.interaction_audit(docs, labels, {})


def test_shapley_sums_to_what_all_filters_remove(spark, small):
    rows = audit.op11_filter_audit(spark, small).where(F.col("filter_order") == "ABCDE").collect()
    for part in {r["part"] for r in rows}:
        mine = [r for r in rows if r["part"] == part]
        assert sum(r["shapley"] for r in mine) == 120 * sum(r["removed"] for r in mine)
