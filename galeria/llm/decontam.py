"""Benchmark decontamination with one Aho-Corasick automaton over normalised items.

Every item's windows (``window`` consecutive words; an item of fewer words is one window)
become patterns of a single automaton over words. A document's words are scanned once;
match ends are word numbers, and word numbers map to byte offsets of the original text. A
benchmark too large for one automaton is found by the keys of its windows instead.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest, xxh64_intdigest

from galeria.llm.common import checkpoint, fresh, stored, table
from galeria.llm.phrases import PRIME, has, places

#: Separators become spaces and A-Z become lower case; bytes of 0x80 and more are parts of words.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
SPACES = re.compile(rb"[^\x20]+")


def words(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(NORMAL).split() if text else []


class Matcher:
    """One automaton of the windows of all items; a word is two letters, so its memory grows with words, not letters.

    The two letters have alphabets of their own, of about the root of the vocabulary each:
    matches start and end at words, and no node has many children to search.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], window: int) -> None:
        split = [(item_id, words(text)) for item_id, text in items]
        often = Counter(w for _, ws in split for w in ws)
        side = math.isqrt(max(0, len(often) - 1)) + 1
        # the most frequent words first, as children are searched in the order of their coming
        self.letters = {w: chr(0x100 + i // side) + chr(0x100 + side + i % side) for i, w in enumerate(sorted(often, key=lambda w: (-often[w], w)))}
        found: dict[str, tuple[int, set[str]]] = {}
        for item_id, ws in split:
            line, n = self.line(ws), min(window, len(ws))
            for i in range(len(ws) - n + 1) if n else ():
                ids = found.setdefault(line[2 * i : 2 * (i + n)], (n, set()))[1]
                if item_id is not None:
                    ids.add(item_id)
        self.values = [(n, tuple(ids)) for n, ids in found.values()]
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, pattern in enumerate(found):
            self.trie.add_word(pattern, i)
        if found:
            self.trie.make_automaton()

    def line(self, ws: list[bytes]) -> str:
        """Words as letters; a word of no item has letters that no pattern has."""
        get = self.letters.get
        return "".join([get(w, "\0\0") for w in ws])

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit ranges of words (end exclusive, merged) and ids of occurring items."""
        if not self.values or not ws:
            return [], set()
        items: set[str] = set()
        ranges = []
        for end, i in self.trie.iter(self.line(ws)):
            n, ids = self.values[i]
            last = (end + 1) // 2
            ranges.append((last - n, last))
            items.update(ids)
        return _merge(ranges), items


_BUILT: dict[str, Matcher] = {}


def _matcher(token: str, items: Callable[[], list], window: int) -> Matcher:
    """The matcher of a benchmark, built once a Python worker, which holds one at a time."""
    if token not in _BUILT:
        _BUILT.clear()
        _BUILT[token] = Matcher(items(), window)
    return _BUILT[token]


def spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of words as ranges of the original text's UTF-8 bytes."""
    if not ranges:
        return []
    at = [m.span() for m in SPACES.finditer(text.encode("utf-8", "surrogatepass").translate(NORMAL))]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


PAIRS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def _pairs(values: list) -> pa.Array:
    return pa.array([[{"first": a, "end": b} for a, b in r] for r in values], PAIRS)


def _keys(window: int):
    """Slices of items (id, text) to their windows: a key of 128 bits, the filter's hash and the item's id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hashes, lengths, ids = [], [], [], []
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ws = words(text.as_py())
                n = min(window, len(ws))
                if n:
                    h = _rolled(_hashed(ws), n)
                    hashes.append(h)
                    keys += [xxh3_128_digest(b" ".join(ws[i : i + n])) for i in range(len(h))]
                    lengths += [n] * len(h)
                    ids += [item_id] * len(h)
            h = np.concatenate([np.empty(0, np.uint64), *hashes]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(h), pa.array(lengths, pa.int32()), pa.array(ids, pa.string())], ["key", "h", "n", "id"])

    return run


def _hashed(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, ws), np.uint64, len(ws))


def _rolled(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of n words, from those of the words; unlike for unlike n."""
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, n, np.uint64)
        for j in range(n):
            out = out * PRIME + h[j : len(h) - n + 1 + j]
    return out


def _marks(bits: int):
    """Hashes to the words of a bit filter that they set, once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            place = np.unique(np.concatenate(places(h, bits)))
            cells, first = np.unique(place >> np.uint64(6), return_index=True)
            one = np.uint64(1) << (place & np.uint64(63))
            masks = np.bitwise_or.reduceat(one, first) if len(first) else one
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int64)), pa.array(masks.view(np.int64))], ["cell", "mask"])

    return run


def _bits(windows: DataFrame, most: int) -> np.ndarray:
    """A filter of the windows' hashes of 16 bits each, at most ``most``; a false positive costs a looked-up key."""
    bits = 1 << 10
    while bits < most and bits < 16 * windows.count():
        bits *= 2
    got = windows.select("h").mapInArrow(_marks(bits), "cell long, mask long").groupBy("cell").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[got["cell"].to_numpy()] = got["mask"].to_numpy()
    return out.view(np.uint8)


def _candidates(shared, lengths: list[int]):
    """(row, text) to (row, key, n, at): the windows that pass the filter, each once a row with all its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            rows, keys, sizes, at = [], [], [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ws = words(text.as_py())
                h = _hashed(ws)
                for n in lengths:
                    found: dict[bytes, list[int]] = {}
                    if n <= len(ws):
                        for i in np.flatnonzero(has(bits, _rolled(h, n))).tolist():
                            found.setdefault(xxh3_128_digest(b" ".join(ws[i : i + n])), []).append(i)
                    rows += [row] * len(found)
                    keys += found.keys()
                    at += found.values()
                    sizes += [n] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(at, pa.list_(pa.int32()))], ["row", "key", "n", "at"])

    return run


def _finish(matcher: Callable[[], Matcher] | None, text: str, names: tuple[str, str, str, str], keep: list[str]):
    """Rows with words, hits, items and offsets; hits come from a matcher, or from columns of these names."""
    n_words, hits, items, offsets = names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = matcher and matcher()
        for batch in batches:
            at = {c: i for i, c in enumerate(batch.schema.names)}
            count, old, ids, where = [], [], [], []
            given = None if found else (batch.column(at[hits]).to_pylist(), batch.column(at[items]).to_pylist())
            for i, value in enumerate(batch.column(at[text])):
                value = value.as_py()
                ws = words(value)
                if found:
                    ranges, got = found.scan(ws)
                else:
                    ranges, got = _merge([(x["first"], x["end"]) for x in given[0][i] or ()]), set(given[1][i] or ())
                count.append(len(ws))
                old.append(ranges)
                ids.append(sorted(got))
                where.append(spans(value, ranges))
            new = {n_words: pa.array(count, pa.int64()), hits: _pairs(old), items: pa.array(ids, pa.list_(pa.string())), offsets: _pairs(where)}
            kept = [(c, batch.column(i)) for c, i in at.items() if c in keep]
            yield pa.RecordBatch.from_arrays([*(v for _, v in kept), *new.values()], [*(c for c, _ in kept), *new])

    return run


def _slices(window: int, most: int):
    """Items cut into runs of words of at most ``most`` bytes (one window at least) that overlap by a window less one word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = [], []
            for item_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ws, at = words(value.as_py()), 0
                while at < len(ws):
                    end, size = min(len(ws), at + window), 0
                    size = sum(len(w) + 1 for w in ws[at:end])
                    while end < len(ws) and size + len(ws[end]) + 1 <= most:
                        size += len(ws[end]) + 1
                        end += 1
                    ids.append(item_id)
                    texts.append(b" ".join(ws[at:end]).decode("utf-8", "surrogatepass"))
                    at = len(ws) if end == len(ws) else end - window + 1
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["id", "text"])

    return run


def contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = 10, max_items_bytes: int = 1 << 20, keep_text: bool = True, most_bits: int = 1 << 27
) -> tuple[DataFrame, tuple[str, str, str, str]]:
    """``docs`` with four columns more: words, hit word ranges, item ids and hit byte ranges.

    Returns the frame and the four names (clashing names get an underscore). A benchmark of
    at most ``max_items_bytes`` of text, a checked size, is sent to the executors and
    scanned for by one automaton in one pass over the texts; it takes about 160 bytes for
    each of text. Of a larger one only a bit filter of its windows goes there, at most
    ``most_bits``: the texts are written once to the shared folder, one pass gives the
    windows that pass the filter, once a row, and these meet the benchmark's by a key of 128
    bits. However large the benchmark is, texts are read twice and no task holds it.
    ``keep_text=False`` leaves the text column out of the result.
    Null and empty texts have no words and no hits; items without words match nothing; an
    item without an id still marks words. Repeated rows each keep their row. An empty
    benchmark hits nothing; an empty table gives no rows.
    """
    spark = docs.sparkSession
    names = tuple(fresh(docs, c) for c in ("n_words", "hit_words", "hit_items", "hit_bytes"))
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text")).distinct()
    items = checkpoint(items.mapInArrow(_slices(window, max(1, min(max_items_bytes, 1 << 20) // 4)), "id string, text string"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    pair = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))
    kinds = (T.LongType(), pair, T.ArrayType(T.StringType()), pair)
    added = [T.StructField(c, k) for c, k in zip(names, kinds, strict=True)]
    kept = [f for f in docs.schema.fields if keep_text or f.name != text]
    if size <= max_items_bytes:
        rows = spark.sparkContext.broadcast([(r["id"], r["text"]) for r in items.collect()])
        token = uuid.uuid4().hex
        matcher = lambda: _matcher(token, lambda: rows.value, window)
        return docs.mapInArrow(_finish(matcher, text, names, [f.name for f in kept]), T.StructType([*kept, *added])), names

    row = fresh(docs, "row")
    held, _ = stored(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    windows, _ = stored(items.mapInArrow(_keys(window), "key binary, h long, n int, id string"), "windows")
    lengths = sorted(r[0] for r in windows.select("n").distinct().collect())  # at most ``window``
    shared = spark.sparkContext.broadcast(_bits(windows, most_bits))
    found, _ = stored(held.select(row, F.col(f"`{text}`")).mapInArrow(_candidates(shared, lengths), "row long, key binary, n int, at array<int>"), "candidates")
    known, _ = stored(windows.groupBy("key").agg(F.collect_set("id").alias("ids")), "keys")
    met = found.join(known, "key").groupBy("row").agg(F.collect_list(F.struct("n", "at")).alias("hits"), F.collect_list("ids").alias("ids"))
    ranges = F.flatten(F.transform("hits", lambda x: F.transform(x["at"], lambda i: F.struct(i.cast("long").alias("first"), (i + x["n"]).cast("long").alias("end")))))
    met = met.select(F.col("row").alias(row), ranges.alias(names[1]), F.array_distinct(F.flatten("ids")).alias(names[2]))
    out = held.join(met, row, "left").drop(row)
    return out.mapInArrow(_finish(None, text, names, [f.name for f in kept]), T.StructType([*kept, *added])), names


def digest(ids: list[str]) -> str:
    """What ``items_sha256`` holds, in plain Python."""
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words and occurring items of every document against the whole benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, (n_words, hits, items, _) = contamination(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    n_hit = F.aggregate(hits, F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["first"])
    return found.select(
        "doc_id",
        F.col(n_words).alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
cut AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS p FROM cut),
ns AS (SELECT DISTINCT n FROM iw),
places AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, ns WHERE len(w) >= n),
hits AS (SELECT r, k, iw.n, item_id FROM (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS p FROM places) x JOIN iw ON iw.n = x.n AND iw.p = x.p),
hit_words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS j FROM hits) GROUP BY r),
hit_items AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents without any hit word, with their own columns; see ``contamination`` for odd rows, which all stay."""
    found, (_, hits, _, _) = contamination(docs, benchmark, text, **options)
    return found.where(F.size(hits) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))
