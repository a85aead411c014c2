"""Collocations against plain Python, and the filters of the passes."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from galeria.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, longest=5, percent=100, most=2000):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    held = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    rows = []
    for (lang, p), a in held.items():
        if any(m == lang and len(q) > len(p) and 100 * b >= percent * a and inside(p, q) for (m, q), b in held.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        rows.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    out = []
    for lang in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(lang, rank, *r[1:]) for rank, r in enumerate(mine[:most], 1)]
    return sorted(out)


def found(spark, docs, **options):
    return sorted(tuple(r) for r in phrases.collocations(spark.createDataFrame(docs, "lang string, text string"), **options).collect())


def corpus(seed, n):
    r = random.Random(seed)
    words = ["the", "The", "new", "york", "city", "of", "é", " ", "x\x00", "ÀB", "a1", "(b)"]
    glue = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "; ", "\r\n", "\x1c"]
    text = lambda: "".join(r.choice(words) + r.choice(glue) for _ in range(r.randint(0, 60))) + r.choice(["New York City of new york", "", "?!"])
    return [(r.choice(["en", "en", "de", None, "und", ""]), r.choice([text(), text(), None, "", "..."])) for _ in range(n)]


@pytest.mark.parametrize(("bits", "least", "percent"), [(1 << 26, 4, 100), (1 << 10, 4, 100), (1 << 10, 3, 80)])
def test_equals_plain_counting(spark, bits, least, percent):
    docs = corpus(least, 150)
    want = brute(docs, least, percent=percent)
    assert len(want) > 40
    assert found(spark, docs, least=least, percent=percent, most_bits=bits) == want


def test_report_takes_the_first_of_each_part(spark):
    docs = corpus(8, 150)
    assert found(spark, docs, least=2, most=7) == brute(docs, 2, most=7)
    assert len(found(spark, docs, least=2, most=None)) == len(brute(docs, 2, most=10**9))


def test_small_blocks_give_the_same(monkeypatch):
    docs = [(lang or "und", text) for lang, text in corpus(5, 60)]
    whole = Counter()
    for size in (1 << 20, 100):
        monkeypatch.setattr(phrases, "BLOCK", size)
        total = Counter()
        for part, tokens in phrases._blocks([lang for lang, _ in docs], [t for _, t in docs]):
            everything = np.full(128, 255, np.uint8)
            for p, c in zip(*phrases._phrases(tokens, part, [everything] * 2)[:2], strict=True):
                total[part, p] += int(c)
        whole = whole or total
    assert total == whole and len(total) > 100


def test_overlaps_long_texts_and_nothing(spark):
    assert found(spark, []) == []
    assert found(spark, [("en", None), (None, ""), ("en", ".")], least=1) == []
    docs = [("en", "a " * 20_000), ("en", "a a a"), ("de", "b" * 100_000)]
    assert found(spark, docs, least=100, longest=3) == [("en", 1, "a a", 20_001, 20_003, 20_003, 20_003, 999), ("en", 2, "a a a", 19_999, 20_003, 20_001, 20_003, 999)]


def test_scores_beyond_64_bits(spark):
    grams = spark.createDataFrame([("en", "a", 1, 4 * 10**15), ("en", "b", 1, 3 * 10**15), ("en", "a b", 2, 2 * 10**15)], "part string, phrase string, k int, f long")
    words = spark.createDataFrame([("en", 9 * 10**16)], "part string, n long")
    assert phrases.scored(grams, words).first()["score"] == 1000 * 2 * 10**15 * 9 * 10**16 // (12 * 10**30)


def test_filters_hold_every_phrase(spark):
    rows = [("en", f"w{i} x{i % 7}", 2, 5) for i in range(3000)]
    bits = phrases.bit_filter(spark.createDataFrame(rows, "part string, phrase string, k int, f long"))
    assert 8 * len(bits) == 1 << 16
    h = np.array([((phrases.xxhash.xxh64_intdigest(f"w{i}".encode(), seed=7) * int(phrases.PRIME)) + phrases.xxhash.xxh64_intdigest(f"x{i % 7}".encode(), seed=7)) & (2**64 - 1) for i in range(6000)], np.uint64)
    has = phrases.has(bits, h ^ phrases._seed("en"))
    assert has[:3000].all() and has[3000:].mean() < 0.05


def test_clashing_columns(spark):
    docs = spark.createDataFrame([("en", "a b. a b", 1)], "lang string, text string, part int")
    assert phrases.collocations(docs, least=2).first()["phrase"] == "a b"
