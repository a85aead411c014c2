"""Encoding by distinct chunks against the library on whole texts."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from galeria.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "   ", "a", " a", "a ", "a  b", "  a  b  ", "▁", "▁▁ ▁", "a▁b", "a ▁ b", "\x00", "a\x00 b", "\n\n a\tb\r\n", "<s> </s> <unk> <0x0A>", "ｆ ﬁ　x", "😀 👩‍👩‍👧 é é",
    "﻿​  ", "x" * 5000, "ab " * 5000, " " * 3000, "▁" * 1000 + " a", "日本語 テキスト", "\U0010ffff ",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def same(rows, library, texts):
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "")
        assert r["ids"] == ids, repr(texts[r["doc_id"]])[:80]
        assert r["decoded"] == library.decode(ids)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def random_texts(seed, n):
    r = random.Random(seed)
    letters = "abcdefgh  \n\t.,▁éß漢😀 '-0129TheThe"
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 200))) for _ in range(n)]


@pytest.mark.parametrize("most", [0, 20, pieces.MOST_CHUNKS])
def test_equals_the_library(spark, library, most):
    texts = ODD + random_texts(4, 200)
    out, ids, decoded = pieces.encoded(frame(spark, texts), MODEL, most=most)
    assert (ids, decoded) == ("ids", "decoded")
    same(out.collect(), library, texts)


@pytest.mark.parametrize("most", [0, 3, 1 << 16])
def test_blocks_of_texts(spark, library, monkeypatch, most):
    monkeypatch.setattr(pieces, "BLOCK", 50)
    monkeypatch.setattr(pieces, "MOST_CHUNKS", most)
    texts = ODD + random_texts(5, 50)
    runs = list(pieces._blocks(pieces.pa.array(texts)))
    assert len(runs) > 20 and [t for _, held in runs for t in held.to_pylist()] == texts
    assert [at for at, _ in runs] == [sum(len(h) for _, h in runs[:i]) for i in range(len(runs))]
    data, lately = open(MODEL, "rb").read(), {}
    known = {"the": pieces.segment(data, ["the"])[0]}
    for _, held in runs:
        ids, decoded = pieces._joined(data, known, lately, held)
        assert ids.to_pylist() == [library.encode(t or "") for t in held.to_pylist()]
        assert decoded.to_pylist() == [library.decode(library.encode(t or "")) for t in held.to_pylist()]
        assert len(lately) <= most
    assert list(pieces._blocks(pieces.pa.array([], pieces.pa.string()))) == []


def test_a_model_whose_chunks_are_not_independent(spark, library, tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    m.ParseFromString(open(MODEL, "rb").read())
    assert pieces.splittable(m.SerializeToString())
    m.normalizer_spec.remove_extra_whitespaces = True
    changed = tmp_path / "changed.model"
    changed.write_bytes(m.SerializeToString())
    assert not pieces.splittable(changed.read_bytes())
    other = sentencepiece.SentencePieceProcessor(model_file=str(changed))
    texts = ["a  b", None, "", "  c "]
    same(pieces.encoded(frame(spark, texts), str(changed))[0].collect(), other, texts)
    m.normalizer_spec.remove_extra_whitespaces = False
    m.pieces.add(piece="a▁b", score=-1.0)
    assert not pieces.splittable(m.SerializeToString())


def test_common_chunks_are_the_commonest(spark):
    texts = ["a a a a a a a a b b b b c", "a b c d", None, "", "x" * 100, "  a"]
    got = {r["chunk"]: r["n"] for r in pieces.common_chunks(frame(spark, texts), most=2).collect()}
    assert got == {"a": 9, "b": 5}
    assert {r["chunk"] for r in pieces.common_chunks(frame(spark, texts)).collect()} == {"a", "b", "c"}
    assert pieces.common_chunks(frame(spark, [])).count() == 0


def test_empty_table_repeated_rows_and_clashing_names(spark, library):
    assert pieces.encoded(frame(spark, []), MODEL)[0].count() == 0
    docs = spark.createDataFrame([(1, "a b", 7), (1, "a b", 7)], "doc_id long, text string, ids int")
    out, ids, decoded = pieces.encoded(docs, MODEL)
    rows = out.collect()
    assert ids == "ids_" and [r["ids"] for r in rows] == [7, 7] and all(r[ids] == library.encode("a b") for r in rows)


def test_query_equals_the_library(spark, small, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    rows = pieces.op12_pieces(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))
