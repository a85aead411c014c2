"""Encoding and decoding with a SentencePiece model through a table of distinct chunks.

The library turns spaces into a marker and cuts the marked text into pieces of its
vocabulary. Where no piece has a marker behind another character, no piece and no merge
crosses the place before a run of markers: a text is cut there into chunks (the markers and
the word behind them), each distinct chunk is segmented once, and the ids and the decoded
text are joined back by position. Chunks that are common in the corpus stand in one table
that every task gets, of bounded size; a rarer one is segmented once by each task that
meets it, while as many of them again are remembered.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galeria.llm.common import checkpoint, fresh, scratch, table

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Bounds of the table that goes to every task: chunks, and UTF-8 bytes of one. A worker remembers as many rarer ones.
MOST_CHUNKS, LONGEST = 1 << 16, 64
#: Bytes of text in one block.
BLOCK = 4 << 20


@lru_cache(maxsize=2)
def _processor(model: bytes):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_proto=model)


def splittable(model: bytes) -> bool:
    """Whether chunks are independent: spaces are only marked, one marker is put first, and no piece has a marker behind another character."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    m.ParseFromString(model)
    spec, pieces = m.normalizer_spec, {p.piece for p in m.pieces}
    plain = spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces and not spec.precompiled_charsmap
    return plain and not m.trainer_spec.treat_whitespace_as_suffix and MARK in pieces and not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)


def chunks(text: str) -> list[str]:
    """The marked text, cut before every run of markers, each without its first marker; nothing of an empty text."""
    return [c[1:] for c in CHUNK.findall(MARK + text.replace(" ", MARK))] if text else []


def cut(texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """The chunks of texts in up to two groups: (rows, chunks of all of them, how many each has).

    Where single spaces stand between words, the words are the chunks.
    """
    plain = pc.and_(pc.invert(pc.match_substring_regex(texts, f"  |{MARK}|^ | $")), pc.greater(pc.binary_length(texts), 0))
    plain = pc.fill_null(plain, False).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(plain)
    if len(rows):
        words = pc.split_pattern(texts.take(pa.array(rows)), " ")
        yield rows, words.flatten(), pc.list_value_length(words).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(~plain)
    if len(rows):
        own = [chunks(t or "") for t in texts.take(pa.array(rows)).to_pylist()]
        yield rows, pa.array([c for cs in own for c in cs], pa.string()), np.array([len(cs) for cs in own], np.int64)


def segment(model: bytes, found: list[str]) -> list[tuple[list[int], str]]:
    """Ids and decoded text of each chunk; the library itself puts the first marker back."""
    sp = _processor(model)
    ids = sp.encode(found, num_threads=1)
    ids = [i if c else [sp.piece_to_id(MARK)] for c, i in zip(found, ids, strict=True)]
    return [(i, " " + d) for i, d in zip(ids, sp.decode(ids, num_threads=1) if ids else [], strict=True)]


def _blocks(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of rows of about ``BLOCK`` bytes: their first row and texts; one text alone may be longer."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    number = (np.cumsum(sizes) - sizes) // BLOCK
    starts = np.flatnonzero(np.diff(number, prepend=-1))
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(sizes)], strict=False):
        yield start, texts.slice(start, end - start)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, texts in _blocks(batch.column(0)):
            for _, found, _ in cut(texts):
                found = found.filter(pc.less_equal(pc.binary_length(found), LONGEST))
                counts = pc.value_counts(found)
                yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], ["chunk", "n"])


def common_chunks(docs: DataFrame, text: str = "text", most: int = MOST_CHUNKS) -> DataFrame:
    """``chunk, n``: the commonest distinct chunks of all texts, at most ``most``, without their first marker.

    All chunks of up to ``LONGEST`` bytes are counted, once a block before they are
    shuffled. The least count that is taken comes from a histogram of the counts' magnitudes,
    so no task sorts the chunks.
    """
    counts = docs.select(F.col(f"`{text}`")).mapInArrow(_count, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    counts = checkpoint(counts.where("n > 1").withColumn("size", F.floor(F.log2("n") * 16).cast("int")))  # read twice
    held, least = 0, None
    for r in sorted(counts.groupBy("size").count().collect(), key=lambda r: -r["size"]):
        held += r["count"]
        if held > most:
            break
        least = r["size"]
    return counts.where(F.lit(False) if least is None else F.col("size") >= least).select("chunk", "n")


def _segmented(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_pylist()
            got = segment(model.value, found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([i for i, _ in got], pa.list_(pa.int32())), pa.array([d for _, d in got], pa.string())], ["chunk", "ids", "decoded"]
            )

    return run


def chunk_table(docs: DataFrame, model, text: str = "text", most: int = MOST_CHUNKS) -> DataFrame:
    """``chunk, ids, decoded`` of the commonest chunks, each segmented once."""
    return common_chunks(docs, text, most).select("chunk").mapInArrow(_segmented(model), "chunk string, ids array<int>, decoded string")


def _joined(model: bytes, known: dict[str, tuple], lately: dict[str, tuple], texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Ids and decoded texts of a block: its distinct chunks, looked up or segmented, put back by position."""
    rows, all_ids, all_decoded = [], [], []
    for at, found, sizes in cut(texts):
        coded = found.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [c for c in distinct if c not in known and c not in lately]
        if len(lately) + len(new) > MOST_CHUNKS:
            lately.clear()
            new = [c for c in distinct if c not in known]
        extra = dict(zip(new, segment(model, new), strict=True))
        got = [known.get(c) or lately.get(c) or extra[c] for c in distinct]
        lately.update((c, v) for c, v in extra.items() if len(c) <= LONGEST and len(lately) < MOST_CHUNKS)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        ids = pa.array([i for i, _ in got], pa.list_(pa.int32())).take(coded.indices)
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))]).astype(np.int32)
        words = pa.array([d for _, d in got], pa.string()).take(coded.indices)
        rows.append(at)
        all_ids.append(pa.ListArray.from_arrays(pa.array(ends[offsets]), ids.flatten()))
        all_decoded.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), words), ""))
    order = pa.array(np.argsort(np.concatenate(rows)))
    ids, decoded = (pa.concat_arrays(x).take(order) if len(rows) > 1 else x[0] for x in (all_ids, all_decoded))
    return ids, pc.utf8_slice_codeunits(decoded, 1)


def _whole(model: bytes, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    sp = _processor(model)
    ids = sp.encode([t or "" for t in texts.to_pylist()], num_threads=1)
    return pa.array(ids, pa.list_(pa.int32())), pa.array(sp.decode(ids, num_threads=1), pa.string())


def _encoded(model, held, names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lately = None if held is None else _known(held), {}
        for batch in batches:
            for at, texts in _blocks(batch.column(batch.num_columns - 1)):
                ids, decoded = _whole(model.value, texts) if known is None else _joined(model.value, known, lately, texts)
                rest = batch.slice(at, len(texts)).columns[:-1]
                yield pa.RecordBatch.from_arrays([*rest, ids, decoded], [*batch.schema.names[:-1], *names])

    return run


_KNOWN: dict = {}


def _known(held) -> dict[str, tuple]:
    """The broadcast table as a dictionary, made once a worker."""
    t = held.value
    if _KNOWN.get("of") is not t:
        _KNOWN.update(of=t, rows=dict(zip(t["chunk"].to_pylist(), zip(t["ids"].to_pylist(), t["decoded"].to_pylist(), strict=True), strict=True)))
    return _KNOWN["rows"]


def encoded(docs: DataFrame, model: str, text: str = "text", keep: list[str] | None = None, most: int = MOST_CHUNKS) -> tuple[DataFrame, str, str]:
    """``docs`` (or its columns ``keep``) with the ids of each whole text and what they decode to; also these columns' names.

    ``model`` is a file's path, read on the driver. Null and empty texts have no ids and
    decode to the empty text; markers that stand in a text decode to spaces, as the library
    does it. Repeated rows each keep their row, and an empty table gives none. Where
    ``splittable`` does not hold, whole texts go to the library.
    """
    with open(model, "rb") as file:
        data = file.read()
    context = docs.sparkSession.sparkContext
    shared, held = context.broadcast(data), None
    if splittable(data):
        with scratch(docs.sparkSession):
            held = context.broadcast(chunk_table(docs, shared, text, most).toArrow())
    names, value = (fresh(docs, "ids"), fresh(docs, "decoded")), fresh(docs, "text_")
    kept = [f for f in docs.schema.fields if keep is None or f.name in keep]
    rows = docs.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{text}`").alias(value))
    added = [T.StructField(names[0], T.ArrayType(T.IntegerType())), T.StructField(names[1], T.StringType())]
    return rows.mapInArrow(_encoded(shared, held, names), T.StructType([*rows.schema.fields[:-1], *added])), *names


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, ids, decoded = encoded(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    joined = F.array_join(F.col(ids).cast("array<string>"), ",")
    return out.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2(F.col(decoded), 256).alias("decoded_sha256"))
