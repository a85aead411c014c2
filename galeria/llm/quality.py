"""Quality by a weak-label model: heuristic labellers, expectation-maximisation, a hashed linear scorer.

Overlapping labellers vote good, bad or nothing on every document. Votes are counted by
pattern over all documents; expectation-maximisation on these counts estimates how each
labeller votes on good and on bad documents. The patterns' posteriors then label a bounded
sample on which a logistic scorer over hashed features is trained; the scorer decides.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galeria.llm.common import fresh, lowest, table

UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
SYMBOLS = b"#$%&*^~<>{}[]\\=_@"
SHAPES = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
RUNS = re.compile(rb"(.)\1+")


def measures(text: str | None) -> dict[str, float] | None:
    """Rates of one whole text, each 0 to 1 but for words; None without words."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    words = data.split()
    if not words:
        return None
    n, size = len(words), len(data)
    count = lambda chars: size - len(data.translate(None, chars))
    lines = [x for x in (y.strip() for y in data.split(b"\n")) if x]
    return {
        "words": n,
        "upper": count(UPPER) / max(1, count(LETTERS)),
        "letters": count(LETTERS) / size,
        "digits": count(DIGITS) / size,
        "symbols": count(SYMBOLS) / size,
        "bang": min(1.0, data.count(b"!") / n),
        "bars": words.count(b"|") / n,
        "lone": (n - len(data.translate(None, MARKS).split())) / n,  # words of marks alone are gone without them
        "runs": sum(map(eq, words, words[1:])) / n,
        "lines": 1 - sum(len(x) for x in set(lines)) / sum(len(x) for x in lines),
        "distinct": len(set(words)) / min(n, 200),
        "stops": min(1.0, (data.count(b".") + data.count(b"?")) / n),
    }


def _rule(name: str, bad: float, good: float, least: int = 1):
    """A labeller: bad beyond one bound of a rate, good within the other, else no vote."""

    def vote(m: dict[str, float]) -> int:
        if m["words"] < least:
            return 0
        v = m[name]
        return -1 if (v >= bad if bad > good else v <= bad) else 1 if (v <= good if bad > good else v >= good) else 0

    return vote


#: Overlapping labellers by name: rate, bound of bad, bound of good, least words.
LABELLERS = {
    "shouting": _rule("upper", 0.3, 0.15, 8),
    "exclaiming": _rule("bang", 0.2, 0.02, 8),
    "symbols": _rule("symbols", 0.03, 0.005, 8),
    "letters": _rule("letters", 0.6, 0.75, 30),
    "tables": _rule("bars", 0.1, 0.01, 8),
    "fragments": _rule("lone", 0.15, 0.03, 8),
    "stuttering": _rule("runs", 0.25, 0.1, 20),
    "echoing": _rule("lines", 0.5, 0.15, 40),
    "vocabulary": _rule("distinct", 0.15, 0.3, 60),
    "digits": _rule("digits", 0.6, 0.2, 8),
}


def votes(m: dict[str, float] | None) -> str:
    """The labellers' votes as a string of +, - and 0; all 0 without words."""
    return "".join("-0+"[(f(m) if m else 0) + 1] for f in LABELLERS.values())


class _Places(dict):
    """The hashed place of a word's shape, with runs of one sign as one, computed once while their number is bounded."""

    def __init__(self, bits: int) -> None:
        super().__init__()
        self.mask = (1 << bits) - 1

    def __missing__(self, shape: bytes) -> int:
        if len(self) > 1 << 17:
            self.clear()
        i = self[shape] = zlib.crc32(b"shape " + RUNS.sub(rb"\1", shape)[:16]) & self.mask
        return i


@lru_cache(maxsize=4)
def _places(bits: int) -> _Places:
    return _Places(bits)


def hashed(text: str | None, m: dict[str, float] | None, bits: int) -> dict[int, float]:
    """Hashed features: shares of word shapes, and the rates' bins."""
    if not m:
        return {}
    shapes = text.encode("utf-8", "surrogatepass").translate(SHAPES).split()
    out = {i: c / m["words"] for i, c in Counter(map(_places(bits).__getitem__, shapes)).items()}
    for name, v in m.items():
        step = min(8, int(math.log2(v + 1))) if name == "words" else math.ceil(min(1.0, v) * 10)
        i = zlib.crc32(f"{name} {step}".encode()) & ((1 << bits) - 1)
        out[i] = out.get(i, 0.0) + 1.0
    return out


def estimate(counts: dict[str, int], rounds: int = 100) -> tuple[np.ndarray, float, dict[str, float]]:
    """Expectation-maximisation over vote patterns.

    Returns P(vote | class, voted) as (labeller, class bad/good, vote -/+), P(good), and each
    pattern's posterior of good. A labeller that does not vote says nothing about the class.
    A pseudo-count says that labellers are right more often than wrong, so the classes keep
    their meaning.
    """
    patterns = sorted(counts)
    if not patterns:
        return np.empty((0, 2, 2)), 1.0, {}
    signs = np.array([[("-", "0", "+").index(c) - 1 for c in p] for p in patterns])
    cast = np.stack([signs < 0, signs > 0], 2).astype(float)  # pattern, labeller, vote
    n = np.array([counts[p] for p in patterns], float)
    post = np.array([0.9 if "-" not in p else 0.05 if p.count("-") > 1 else 0.2 for p in patterns])
    prior = np.array([[3.0, 1.0], [1.0, 3.0]])
    for _ in range(rounds):
        w = np.stack([n * (1 - post), n * post])
        rates = np.einsum("yp,pjv->jyv", w, cast) + prior
        rates /= rates.sum(2, keepdims=True)
        good = (w[1].sum() + 1) / (n.sum() + 2)
        log = np.einsum("pjv,jyv->yp", cast, np.log(rates))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1] + np.log((1 - good) / good), -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return rates, float(good), dict(zip(patterns, post.tolist(), strict=True))


@dataclass
class Scorer:
    """A logistic model over 2**bits hashed features."""

    weights: np.ndarray
    bias: float
    bits: int

    @staticmethod
    def fit(rows: list[dict[int, float]], labels: np.ndarray, bits: int, epochs: int = 30, rate: float = 0.5) -> Scorer:
        """Adagrad on soft labels, in the rows' order."""
        w, g, b, gb = np.zeros(1 << bits), np.full(1 << bits, 1e-6), 0.0, 1e-6
        sparse = [(np.fromiter(r, int, len(r)), np.fromiter(r.values(), float, len(r))) for r in rows]
        for _ in range(epochs):
            for (i, x), y in zip(sparse, labels, strict=True):
                d = 1 / (1 + np.exp(-np.clip(w[i] @ x + b, -30, 30))) - y
                g[i] += (d * x) ** 2
                gb += d * d
                w[i] -= rate * d * x / np.sqrt(g[i])
                b -= rate * d / np.sqrt(gb)
        return Scorer(w, b, bits)

    def score(self, row: dict[int, float]) -> float:
        """P(good); 0 for a text without words."""
        if not row:
            return 0.0
        z = self.bias + sum(self.weights[i] * x for i, x in row.items())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = Counter(votes(measures(t.as_py())) for t in batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array(list(found.values()), pa.int64())], ["votes", "n"])


def _examples(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for t in batch.column(1):
                m = measures(t.as_py())
                got.append((votes(m), hashed(t.as_py(), m, bits)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([v for v, _ in got]), pa.array([list(f) for _, f in got], pa.list_(pa.int32())),
                 pa.array([list(f.values()) for _, f in got], pa.list_(pa.float64()))], ["h", "votes", "i", "x"],
            )

    return run


def _scores(scorer: Scorer, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(batch.num_columns - 1):
                text = t.as_py()
                out.append(scorer.score(hashed(text, measures(text), scorer.bits)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64())], [*batch.schema.names[:-1], name])

    return run


def fit(docs: DataFrame, text: str = "text", max_rows: int = 8000, bits: int = 14) -> tuple[Scorer, np.ndarray, float]:
    """The scorer, the labellers' estimated rates and the share of good documents.

    Vote patterns, at most 3 to the number of labellers, are counted over all documents. The
    scorer learns from at most ``max_rows`` different texts with words, those with the
    smallest hashes: a bounded sample, whatever the size of the table and however often a
    text is repeated. Texts without words count as votes of nobody; equal texts are learned
    once; a table without any text with words gives a scorer that has learned nothing, and
    nothing but texts without words, which score 0, can meet it there.
    """
    texts = docs.select(F.col(f"`{text}`").alias("t"))
    counts = texts.mapInArrow(_votes, "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()
    counts = {r["votes"]: r["n"] for r in counts}
    rates, good, posterior = estimate(counts)
    wordy = texts.where(F.col("t").rlike(r"[^\x20\x09-\x0D]")).withColumn("h", F.xxhash64("t", F.lit(3)))
    some = lowest(wordy, "h", max_rows, sum(counts.values()), F.first("t").alias("t"))
    rows = some.mapInArrow(_examples(bits), "h long, votes string, i array<int>, x array<double>")
    rows = sorted(rows.collect(), key=lambda r: r["h"])
    labels = np.array([posterior.get(r["votes"], 0.5) for r in rows])
    return Scorer.fit([dict(zip(r["i"], r["x"], strict=True)) for r in rows], labels, bits), rates, good


def scored(docs: DataFrame, scorer: Scorer, text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """``docs`` (or its columns ``keep``) with the probability of good, and that column's name.

    Null and empty texts and texts without words score 0. Repeated rows each keep their row.
    """
    name, value = fresh(docs, "quality_score"), fresh(docs, "text_")
    kept = [f for f in docs.schema.fields if keep is None or f.name in keep]
    rows = docs.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{text}`").alias(value))
    return rows.mapInArrow(_scores(scorer, name), T.StructType([*kept, T.StructField(name, T.DoubleType())])), name


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, and whether it is kept (0.5 or more)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer, _, _ = fit(docs)
    out, score = scored(docs, scorer, keep=["doc_id"])
    return out.select("doc_id", F.col(score).alias("score"), (F.col(score) >= 0.5).alias("kept"))


def filtered(docs: DataFrame, text: str = "text", least: float = 0.5, **options) -> DataFrame:
    """The documents that score at least ``least``, with their own columns.

    Null and empty texts and those without words score 0 and go; very long texts are read
    whole; repeated rows are judged alike and each stay or go; an empty table gives no rows.
    """
    scorer, _, _ = fit(docs, text, **options)
    out, score = scored(docs, scorer, text)
    return out.where(F.col(score) >= least).select(*(F.col(f"`{c}`") for c in docs.columns))
