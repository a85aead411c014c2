"""The whole pipeline against plain Python."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark import InheritableThread
from test_text_operators import components, words

import corpus_pipeline
from galeria.llm import dedup, mix, phrases, quality, shard, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def benchmark_windows(items, size=10):
    out = defaultdict(set)
    for _, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            out[n].add(tuple(w[i : i + n]))
    return out


def mixed(docs):
    """(doc_id, text) rows that the mixture gives of (doc_id, text, source)."""
    by = defaultdict(list)
    for doc_id, text, source in docs:
        by[source].append((doc_id, len(WORD.findall(text or "")), text))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(n for _, n, _ in by[s]) for s in names]
    out = []
    for i, (name, (n, draws, last)) in enumerate(zip(names, mix.quotas(sizes, mix.targets(sizes), 64), strict=True)):
        stream = [(d, k) for d, count, _ in sorted(by[name]) for k in range(count)]
        taken = defaultdict(set)  # (document, round): its words that are taken
        for draw in range(draws):
            r = draw // n
            at = int(shard.permute(np.array([draw % n]), n, mix.round_key(0, i, r))[0])
            for d, k in stream[64 * at : 64 * at + (last if draw == draws - 1 else 64)]:
                taken[d, r].add(k)
        texts = {d: t for d, _, t in by[name]}
        for (d, _), ks in taken.items():
            found = list(WORD.finditer(texts[d]))
            if len(ks) == len(found):
                out.append((d, texts[d]))
                continue
            runs = []
            for k in sorted(ks):
                if runs and runs[-1][1] == k:
                    runs[-1][1] = k + 1
                else:
                    runs.append([k, k + 1])
            out.append((d, " ".join(texts[d][found[a].start() : found[b - 1].end()] for a, b in runs)))
    return out


def test_pipeline_equals_plain_python(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet")
    docs = [(r["doc_id"], r["text"], r["source"]) for r in table.collect()]
    scorer, _, _ = quality.fit(table)
    docs = [d for d in docs if scorer.score(quality.hashed(d[1], quality.measures(d[1]), scorer.bits)) >= 0.5]
    kept = components(docs, 5, 80)
    docs = [d for d in docs if kept[d[0]][1] == d[0]]
    windows = benchmark_windows([tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()])

    def clean(text):
        w = words(text)
        return not any(tuple(w[i : i + n]) in found for n, found in windows.items() for i in range(len(w) - n + 1))

    docs = [d for d in docs if clean(d[1])]
    rows = mixed(docs)
    got = corpus_pipeline.run(spark, small).collect()
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)  # noqa: E731  spaces between runs that touch stand as in the text
    assert Counter((r["doc_id"], plain(r["text"])) for r in got) == Counter((d, plain(t)) for d, t in rows)
    order = sorted((r["doc_id"], len(r["text"].encode()) + 1, zlib.crc32(r["text"].encode())) for r in got)
    places = shard.permute(np.arange(len(order)), len(order), 0).tolist()
    want = Counter((*o, p % 16, p // 16) for o, p in zip(order, places, strict=True))
    assert Counter((r["doc_id"], len(r["text"].encode()) + 1, zlib.crc32(r["text"].encode()), r["shard"], r["slot"]) for r in got) == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_operators_in_two_threads(spark, small):
    """Two operators at once: neither clears what the other still reads."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    jobs = {
        "dedup": lambda: sorted(tuple(r) for r in dedup.near_duplicates(docs, words=3, percent=85).collect()),
        "phrases": lambda: sorted(tuple(r) for r in phrases.op13_collocations(spark, small).collect()),
        "urls": lambda: sorted(tuple(r) for r in urls.op3_url_filter(spark, small).collect()),
    }
    alone, together = {n: f() for n, f in jobs.items()}, {}
    threads = [InheritableThread(target=lambda n=n, f=f: together.update({n: f()})) for n, f in jobs.items()]
    for t in threads:
        t.start()
    for t in threads:
        t.join(300)
    assert together == alone
