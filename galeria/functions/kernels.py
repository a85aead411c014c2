"""Vectorised Python functions: half floats, byte-pair encoding, box suppression, name matching."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T


def encode_half(v: np.ndarray) -> bytes:
    """IEEE half floats, little-endian; rounding to nearest even, overflow to infinity."""
    with np.errstate(over="ignore"):
        return np.asarray(v, np.float32).astype("<f2").tobytes()


def decode_half(data: bytes) -> np.ndarray:
    """The inverse of ``encode_half``."""
    return np.frombuffer(data, "<f2").astype(np.float32)


@F.pandas_udf(T.BinaryType())
def to_half(v: pd.Series) -> pd.Series:
    """array<float> to half floats; null stays null."""
    return v.map(lambda x: None if x is None else encode_half(x))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_half(b: pd.Series) -> pd.Series:
    """Half floats to array<float>; null stays null."""
    return b.map(lambda x: None if x is None else decode_half(x))


# Fixed value: how text is cut before merging: contractions, letters, single digits, other marks.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """A printable letter for each byte: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def merge(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Merge the adjacent pair of the lowest rank, the leftmost of equals, until none is left.

    A heap of pairs over a linked list: time grows with n log n.
    """
    out: list[str | None] = list(symbols)
    before, after = list(range(-1, len(out) - 1)), list(range(1, len(out) + 1))
    heap = [(ranks[pair], i, pair) for i, pair in enumerate(zip(out, out[1:], strict=False)) if pair in ranks]
    heapify(heap)

    def push(i: int, j: int) -> None:
        if i >= 0 and j < len(out) and (pair := (out[i], out[j])) in ranks:
            heappush(heap, (ranks[pair], i, pair))

    while heap:
        _, i, pair = heappop(heap)
        j = after[i]
        if out[i] != pair[0] or j >= len(out) or out[j] != pair[1]:
            continue  # one of them has been merged since
        out[i], out[j], after[i] = pair[0] + pair[1], None, after[j]
        if after[j] < len(out):
            before[after[j]] = i
        push(before[i], i)
        push(i, after[i])
    return [s for s in out if s is not None]


def known_merges(vocab: dict[str, int], merges: list[tuple[str, str]]) -> dict[tuple[str, str], int]:
    """Ranks of the merges whose sides and result the vocabulary has; of repeated ones the first counts."""
    ranks: dict[tuple[str, str], int] = {}
    for i, (a, b) in enumerate(merges):
        if a in vocab and b in vocab and a + b in vocab:
            ranks.setdefault((a, b), i)
    return ranks


#: Stands for symbols that the vocabulary has not, before any merging; no merge has it.
UNKNOWN = ""


def clip_ids(text: str, vocab: dict[str, int], ranks: dict[tuple[str, str], int], unknown: int, end: str = "</w>") -> list[int]:
    """Ids of a lower-cased text: words cut by ``PIECES``, bytes as letters, an end mark on each word's last."""
    text = re.sub(r"\s+", " ", unicodedata.normalize("NFC", text)).lower()
    out: list[int] = []
    for piece in PIECES.findall(text):
        letters = [byte_letters()[b] for b in piece.encode()]
        letters[-1] += end
        out += [vocab.get(s, unknown) for s in merge([x if x in vocab else UNKNOWN for x in letters], ranks)]
    return out


def piece_ids(text: str, vocab: dict[str, int], ranks: dict[tuple[str, str], int], unknown: int) -> list[int]:
    """Ids of a text as one word, spaces as U+2581; characters that are not in the vocabulary fall back to bytes."""
    symbols: list[str] = []
    for c in text.replace(" ", "▁"):
        symbols += [c] if c in vocab else [f"<0x{b:02X}>" for b in c.encode()]
    return [vocab.get(s, unknown) for s in merge([x if x in vocab else UNKNOWN for x in symbols], ranks)]


def framed(ids: list[int], head: list[int], end: int, length: int, pad: int = 0) -> list[int]:
    """Exactly ``length`` ids: the head, as many ids as fit, the end mark, padding."""
    out = [*head, *ids][: length - 1] + [end]
    return out + [pad] * (length - len(out))


def tokenizer(kind: str, vocab: dict[str, int], merges: list[tuple[str, str]], unknown: int = 0, begin: int = 0, end: int = 1, length: int | None = None, pad: int = 0):
    """An Arrow UDF string -> array<int> for ``kind`` "clip" or "pieces".

    With ``length`` the ids are framed: "clip" texts have a begin and an end mark, "pieces"
    an end mark. ``galeria.sources.tables.read_tokenizer`` gives all but the last two.
    Ids are four bytes each, and go out by slices of texts, so a task holds Spark's batch
    of texts and the ids of one slice.
    """
    ranks = known_merges(vocab, merges)
    encode = clip_ids if kind == "clip" else piece_ids

    def one(text: str | None) -> list[int] | None:
        if text is None:
            return None
        ids = encode(text, vocab, ranks, unknown)
        return ids if length is None else framed(ids, [begin] if kind == "clip" else [], end, length, pad)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in slices(batch):
                rows = [None if x is None else np.array(x, np.int32) for x in (one(t.as_py()) for t in texts)]
                ends = np.cumsum([0, *(0 if r is None else len(r) for r in rows)], dtype=np.int32)
                values = np.concatenate([np.empty(0, np.int32), *(r for r in rows if r is not None)])
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=pa.array([r is None for r in rows]))

    return ids


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[pa.Array]:
    """An array of texts in slices of ``most`` bytes, or of one text, at most."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), "right")))
        yield texts.slice(at, to - at)
        at = to


def suppress(boxes: pd.DataFrame, most: float = 0.4) -> pd.DataFrame:
    """Of one image's boxes, by score, those that overlap no kept one by more than ``most``."""
    kept: list = []
    for b in boxes.sort_values(["score", "id"], ascending=[False, True]).itertuples():
        for k in kept:
            w, h = min(b.r, k.r) - max(b.l, k.l), min(b.b, k.b) - max(b.t, k.t)
            both = max(w, 0) * max(h, 0)
            union = (b.r - b.l) * (b.b - b.t) + (k.r - k.l) * (k.b - k.t) - both
            if union > 0 and both / union > most:
                break
        else:
            kept.append(b)
    return pd.DataFrame([(k.image, k.id, k.score) for k in kept], columns=["image", "id", "score"])


def match_names(query: str, names: list[str]) -> tuple[list[str], str]:
    """Names that stand in a query, the longest first, and the rest without them and without joining words."""
    rest, found = f" {query.strip()} ", []
    # The borders of a name, and the joining words.
    for name in sorted(names, key=lambda n: (-len(n), n)):
        pattern = re.compile(r"(?i)(?:(?<=\s)|^)" + re.escape(name) + r"(?=\s|$|[,.!?])")
        if pattern.search(rest):
            found.append(name)
            rest = pattern.sub(" ", rest)
    rest = re.sub(r"(?i)\b(und|and|mit|with|&)\b", " ", rest)
    return found, re.sub(r"\s+", " ", rest).strip()
