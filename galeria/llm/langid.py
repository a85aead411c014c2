"""Language identification with a byte convolutional network trained in numpy.

Bytes are embedded, convolved by filters of several widths, max-pooled over a fixed-length
window and classified by softmax. A text's probabilities are the means over all its
windows, weighted by their bytes. Training takes a bounded sample of labelled rows;
prediction reads whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galeria.llm.common import fresh, table

WINDOW, WIDTHS = 128, (2, 3, 4)
STEP = WINDOW - max(WIDTHS) + 1
ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    """Whether a text has a Unicode letter."""
    return bool(text) and (bool(ASCII_LETTER.search(text)) or any(c.isalpha() for c in text))


def windows(data: bytes) -> np.ndarray:
    """All windows of a text's bytes, overlapping so that each filter sees each place once; zero-padded."""
    n = max(1, -(-(len(data) - WINDOW + STEP) // STEP))
    held = np.zeros((n - 1) * STEP + WINDOW, np.uint8)
    held[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(held, WINDOW)[::STEP]


@dataclass
class Network:
    """Parameters: embeddings, filters (width * dim, n) and biases per width, the last layer."""

    langs: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, langs: list[str], dim: int = 8, n: int = 16, epochs: int = 6, batch: int = 64, seed: int = 5) -> Network:
        """Adam on the cross entropy of windows ``x`` (rows, WINDOW) with classes ``y``."""
        rng = np.random.default_rng(seed)
        p = [rng.normal(0, 0.3, (256, dim))]
        p += [rng.normal(0, 1 / np.sqrt(w * dim), (w * dim, n)) for w in WIDTHS]
        p += [np.zeros(n) for _ in WIDTHS]
        p += [rng.normal(0, 0.1, (n * len(WIDTHS), len(langs))), np.zeros(len(langs))]
        p = [v.astype(np.float32) for v in p]
        m, v, t, k = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0, len(WIDTHS)
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                e = p[0][x[rows]]
                views, tops, places = [], [], []
                for i, w in enumerate(WIDTHS):
                    view = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(len(rows), -1, w * dim)
                    z = view @ p[1 + i] + p[1 + k + i]
                    at = z.argmax(1)
                    views.append(view)
                    places.append(at)
                    tops.append(np.take_along_axis(z, at[:, None], 1)[:, 0])
                h = np.maximum(np.concatenate(tops, 1), 0)
                s = h @ p[-2] + p[-1]
                s = np.exp(s - s.max(1, keepdims=True))
                s /= s.sum(1, keepdims=True)
                s[np.arange(len(rows)), y[rows]] -= 1
                s /= len(rows)
                g = [np.zeros_like(a) for a in p]
                g[-2], g[-1] = h.T @ s, s.sum(0)
                dh = (s @ p[-2].T) * (h > 0)
                for i, w in enumerate(WIDTHS):
                    d, at = dh[:, i * n : i * n + n], places[i]
                    picked = views[i][np.arange(len(rows))[:, None], at]
                    g[1 + i] = np.einsum("rfc,rf->cf", picked, d)
                    g[1 + k + i] = d.sum(0)
                    back = np.einsum("rf,cf->rfc", d, p[1 + i]).reshape(len(rows), n, w, dim)
                    where = x[rows][np.arange(len(rows))[:, None, None], at[:, :, None] + np.arange(w)]
                    np.add.at(g[0], where, back)
                t += 1
                for a, b, c, q in zip(p, m, v, g, strict=True):
                    b += 0.1 * (q - b)
                    c += 0.001 * (q * q - c)
                    a -= 0.01 * (b / (1 - 0.9**t)) / (np.sqrt(c / (1 - 0.999**t)) + 1e-8)
        return Network(langs, p[0], p[1 : 1 + k], p[1 + k : 1 + 2 * k], p[-2], p[-1])

    def scorer(self, chunk: int = 1024):
        """A function from windows to class probabilities; filters become look-ups by byte pairs."""
        dim = self.embed.shape[1]
        taps = [[self.embed @ f[i * dim : i * dim + dim] for i in range(len(f) // dim)] for f in self.filters]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        two = pair(*taps[0])
        three, third = pair(*taps[1][:2]), taps[1][2]
        four, last = pair(*taps[2][:2]), pair(*taps[2][2:])

        def run(x: np.ndarray) -> np.ndarray:
            out = np.empty((len(x), len(self.langs)), np.float32)
            for at in range(0, len(x), chunk):
                b = x[at : at + chunk]
                p = b[:, :-1].astype(np.int32) * 256 + b[:, 1:]
                tops = [
                    two.take(p, 0).max(1),
                    (three.take(p[:, :-1], 0) + third.take(b[:, 2:], 0)).max(1),
                    (four.take(p[:, :-2], 0) + last.take(p[:, 2:], 0)).max(1),
                ]
                h = np.maximum(np.concatenate([t + c for t, c in zip(tops, self.biases, strict=True)], 1), 0)
                s = h @ self.out + self.bias
                s = np.exp(s - s.max(1, keepdims=True))
                out[at : at + chunk] = s / s.sum(1, keepdims=True)
            return out

        return run


def _sample(per_text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, order, data = [], [], []
            for lang, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = windows(text.encode("utf-8", "surrogatepass")) if has_letter(text) else []
                for i in sorted(set(np.linspace(0, len(w) - 1, per_text).astype(int))) if len(w) else ():
                    langs.append(lang)
                    order.append(key)
                    data.append(w[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(order, pa.int64()), pa.array(data, pa.binary())], ["lang", "k", "w"])

    return run


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = 400, most_rows: int = 25_600, per_text: int = 8) -> Network:
    """A network of all languages, from at most ``per_lang`` rows each; fewer where that makes over ``most_rows``, one at least.

    Rows are chosen by a hash of their key and text, so rows that repeat a key neither
    crowd a language out nor add to its number, and ``per_text`` windows spread over each
    whole text; only these windows come to the driver. Rows without a language are not
    learned; null texts and those without a letter give no windows and are not chosen;
    equal rows count once; an empty table gives a network without languages.
    """
    rows = docs.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").alias("key"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", F.xxhash64("key", "text").alias("k"), "text")
    langs = rows.groupBy("lang").agg(F.approx_count_distinct("k", 0.02).alias("n"))
    many = langs.count()
    per_lang = max(1, min(per_lang, most_rows // max(1, many)))
    bounded = F.broadcast if many <= most_rows else (lambda df: df)  # at most ``most_rows`` languages, and as many rows, go to every task
    # before the window only rows of so low a hash that over twice as many as asked are left of each language, 34 at least
    low = F.col("k") / F.lit(2.0**63) <= F.least(F.lit(1.0), 4.0 * (per_lang + 16) / F.col("n") - 1.0)
    likely = rows.select("lang", "k").join(bounded(langs), "lang").where(low).select("lang", "k").distinct()
    first = F.row_number().over(Window.partitionBy("lang").orderBy("k"))
    chosen = likely.withColumn("r", first).where(F.col("r") <= per_lang).select("lang", "k")
    texts = rows.join(bounded(chosen), ["lang", "k"]).select("lang", "k", "text")
    got = texts.mapInArrow(_sample(per_text), "lang string, k long, w binary").distinct().orderBy("lang", "k", "w").collect()
    names = sorted({r["lang"] for r in got})
    number = {n: i for i, n in enumerate(names)}
    x = np.frombuffer(b"".join(bytes(r["w"]) for r in got), np.uint8).reshape(-1, WINDOW)
    return Network.fit(x, np.array([number[r["lang"]] for r in got], int), names) if names else Network([], *[None] * 5)


def _predict(network: Network, added: tuple[str, str], bytes_at_once: int = 4 << 20):
    def flush(held: list[np.ndarray], sizes: list[int], score) -> np.ndarray:
        counts = [len(w) for w in held]
        p = score(np.concatenate(held)).astype(np.float64)
        weight = np.concatenate([np.minimum(STEP, np.maximum(1, n - STEP * np.arange(c))) for n, c in zip(sizes, counts, strict=True)])
        at = np.concatenate([[0], np.cumsum(counts)[:-1]])
        total = np.add.reduceat(p * weight[:, None], at, axis=0)
        return total / np.add.reduceat(weight, at)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = network.scorer() if network.langs else None
        for batch in batches:
            n = batch.num_rows
            pred, best = ["und"] * n, np.zeros(n)
            held, sizes, rows, size = [], [], [], 0

            def done():
                p = flush(held, sizes, score)
                for i, c in zip(rows, p.argmax(1), strict=True):
                    pred[i] = network.langs[c]
                best[rows] = p.max(1)
                held.clear(), sizes.clear(), rows.clear()

            for i, value in enumerate(batch.column(batch.num_columns - 1)):
                value = value.as_py()
                if score is None or not has_letter(value):
                    continue
                data = value.encode("utf-8", "surrogatepass")
                held.append(windows(data))
                sizes.append(len(data))
                rows.append(i)
                size += len(data)
                if size >= bytes_at_once:
                    done()
                    size = 0
            if rows:
                done()
            names = [*batch.schema.names[:-1], *added]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred), pa.array(np.clip(best, 0, 1))], names)

    return run


def predict(docs: DataFrame, network: Network, text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, str, str]:
    """``docs`` (or its columns ``keep``) with the predicted language and its probability; also their names.

    Null texts and texts without a letter are ``und`` with probability 0. Repeated rows each
    keep their row.
    """
    names = fresh(docs, "lang_pred"), fresh(docs, "score")
    kept = [f for f in docs.schema.fields if keep is None or f.name in keep]
    value = fresh(docs, "text_")
    rows = docs.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{text}`").alias(value))
    added = [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]
    return rows.mapInArrow(_predict(network, names), T.StructType([*rows.schema.fields[:-1], *added])), *names


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; learned from rows whose key's CRC-32 modulo 3 is not 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    network = train(docs.where(~held))
    out, pred, score = predict(docs.select("doc_id", "text"), network, keep=["doc_id"])
    return out.select("doc_id", held.alias("held_out"), F.col(pred).alias("lang_pred"), F.col(score).alias("score"))
