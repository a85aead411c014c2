"""License rules: every rule through its gates, wordings, suppression, and long texts."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from galeria.llm import licenses

try:
    from re import _parser as sre
except ImportError:  # older Python
    import sre_parse as sre


def sample(pattern, r):
    """A random string that a rule's words match."""

    def run(node):
        out = []
        for op, arg in node:
            op = str(op)
            if op == "LITERAL":
                out.append(chr(arg))
            elif op == "NOT_LITERAL":
                out.append("z")
            elif op == "IN":
                kind, value = arg[0]
                if str(kind) == "RANGE":
                    out.append(chr(r.randint(*value)))
                elif str(kind) == "LITERAL":
                    out.append(chr(r.choice([v for k, v in arg if str(k) == "LITERAL"])))
                else:
                    out.append("z")
            elif op == "BRANCH":
                out.append(run(r.choice(arg[1])))
            elif op == "SUBPATTERN":
                out.append(run(arg[-1]))
            elif op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                low, high, inner = arg
                out += [run(inner) for _ in range(r.randint(low, min(int(high), low + 2)))]
            elif op != "ASSERT":
                raise ValueError(op)
        return "".join(out)

    return run(sre.parse(pattern))


def python_scan(text):
    """All rules ungated and the suppression, in plain Python: (first, end, rule)."""
    words = [w for w in re.split(licenses.SEPARATORS, text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if w]
    norm = f" {' '.join(words)} " if words else " "
    hits = []
    for r in licenses.rules():
        for m in re.finditer(r["pattern"], norm):
            first = norm[: m.start()].count(" ") - 1
            hits.append((first, -(first + m[0].count(" ") + 1), r["priority"], r["id"]))
    hits.sort()
    out = []
    for i, (first, end, priority, rule) in enumerate(hits):
        if not any(p <= priority and e <= end for _, e, p, _ in hits[:i]):
            out.append((first, -end, rule))
    return out


TEXTS = [
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Licensed under GPLv3",
    "licensed under the LGPLv2.1 licence",
    "This file is available under the BSD.",
    "You need a fishing licence.",
    "Dual licensed under the MIT License and the GNU General Public License, version 2 or later; see LICENSE. Apache-2.0 licensed parts: SPDX-License-Identifier: Apache-2.0",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
    "http://www.apache.org/licenses/LICENSE-2.0 and https://creativecommons.org/licenses/by-nc-sa/4.0/",
    "die License mit der wir leben", "", "ÄÖÜ MIT LICENSE İ mit-license", None,
]


def test_wordings_are_found(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    out, (_, found) = licenses.scan(docs)
    labels = {r["doc_id"]: {x["label"] for x in r[found]} for r in out.collect()}
    assert labels[0] == {"mit"} and labels[1] == {"bsd"} and labels[2] == {"gpl"} and labels[3] == {"lgpl"} and labels[4] == {"bsd"} and labels[5] == set()
    assert labels[6] == {"mit", "gpl", "apache"} and labels[7] == {"bsd-3-clause"} and labels[8] == {"apache", "cc-by-nc-sa"} and labels[12] == set()


def test_every_rule_through_its_gates(spark):
    r = random.Random(5)
    rows = [(rule["id"], rule["label"], f"One. {sample(rule['pattern'][9:-6], r)}, two.") for rule in licenses.rules() for _ in range(3)]
    rows += [(1000 + i, "", t or "") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "rule int, label string, text string").repartition(8)
    key = lambda df, c: sorted((x["rule"], x["text"], [(h["first"], h["end"], h["rule"]) for h in x[c]]) for x in df.collect())
    gated, (_, a) = licenses.scan(docs)
    free, (_, b) = licenses.scan(docs, gated=False)
    got = key(gated, a)
    assert got == key(free, b)
    assert got == sorted((rule, text, python_scan(text)) for rule, _, text in rows)
    assert all(hits for rule, _, hits in got if rule < 1000)


@pytest.mark.parametrize("n", [20_000])
def test_many_matches_in_one_text(spark, n):
    docs = spark.createDataFrame([(1, "mit license so " * n), (2, "x " * n)], "doc_id long, text string")
    began = time.perf_counter()
    out, (_, found) = licenses.scan(docs)
    rows = {x["doc_id"]: x["k"] for x in out.select("doc_id", F.size(found).alias("k")).collect()}
    assert rows == {1: n, 2: 0} and time.perf_counter() - began < 60


def test_long_runs_of_numbers_in_every_rule(spark):
    """Numbers after a name, as a table has them: no rule may recurse over them."""
    r = random.Random(7)
    rules = [x for x in licenses.rules() if licenses.VERSION in x["pattern"]]
    assert len(rules) > 200
    bare = [sample(x["pattern"][9:-6].replace(licenses.VERSION, " version 1"), r) for x in rules]
    rows = [(x["id"], f"{text}{' 1' * 100_000} end") for x, text in zip(rules, bare, strict=True) if text.endswith(" 1")]
    assert len(rows) > 200
    docs = spark.createDataFrame([(i, t[: t.index(" 1 1")]) for i, t in rows], "rule int, text string").repartition(16)
    docs = docs.withColumn("text", F.concat("text", F.repeat(F.lit(" 1"), 100_000), F.lit(" end")))
    out, (_, found) = licenses.scan(docs)
    got = {x["rule"]: x["end"] for x in out.select("rule", F.array_max(f"{found}.end").alias("end")).collect()}
    assert len(got) == len(rows) and all(end is not None and end > 100_000 for end in got.values())


def test_repeats_of_groups_are_bounded_or_possessive():
    for rule in licenses.rules():
        assert not re.search(r"\)[*+](?!\+)", rule["pattern"]), rule["pattern"]


def test_numbers_stop_before_a_word(spark):
    docs = spark.createDataFrame([(1, "mit license version 2 0x"), (2, "mit license version 2 0 or later.")], "doc_id long, text string")
    out, (_, found) = licenses.scan(docs)
    assert {x["doc_id"]: x[found][0]["end"] for x in out.collect()} == {1: 4, 2: 7}


NOT_LICENSES = [
    "The weather data provided by Elastic covers ten years.", "Slides published by Boost last week.", "These examples are distributed by Ruby and Tom.",
    "The function is provided by PHP itself.", "The figures released by ISC show growth.", "A study published by MIT 2020.", "Headers provided by Apache 2 servers, offered by X11 and w3c.",
]


def test_names_of_others_are_no_licenses(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(NOT_LICENSES)], "doc_id long, text string")
    out, (_, found) = licenses.scan(docs)
    assert {x["doc_id"]: [d["label"] for d in x[found]] for x in out.collect()} == {i: [] for i in range(len(NOT_LICENSES))}
    kept = ["covered by the GPL version 2", "published under Boost", "provided by the PHP License", "distributed under MIT", "governed by the MPL 2.0"]
    out, (_, found) = licenses.scan(spark.createDataFrame([(i, t) for i, t in enumerate(kept)], "doc_id long, text string"))
    assert [[d["label"] for d in x[found]] for x in out.orderBy("doc_id").collect()] == [["gpl"], ["bsl"], ["php"], ["mit"], ["mpl"]]
