"""Encoding against the sentencepiece library, and round trips."""

import struct

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from gaplens.llm import sentencepieces as sp

RAW = open(sp.MODEL, "rb").read()
CODEC = sp.Codec(RAW)


def whole(texts, raw=RAW):
    return sentencepiece.SentencePieceProcessor(model_proto=raw).encode(list(texts), num_threads=1)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\0"), min_size=1, max_size=40), max_size=4))
def test_parity_on_any_text(texts):
    texts = [*texts, "<s> </s> <unk> <0x41>", "  two  spaces   here ", "a▁b", "é🙂\n\n\tq", "hello" * 30]
    ids, exact, same = CODEC.encode(texts)
    assert [i.tolist() for i in ids] == whole(texts) == CODEC.whole(texts)
    assert all(same) and exact == ["▁" not in t for t in texts]
    assert all(a == b or "▁" in a for a, b in zip(texts, CODEC.decode(ids)))


def test_whole_texts_are_verified_and_words_forgotten():
    codec = sp.Codec(RAW, memo_mb=0, whole=1)
    texts = ["some words and some more", "", "x" * 5000, "a▁b", "zwei  Wörter\n"]
    for _ in range(2):
        ids, exact, same = codec.encode(texts)
        assert [i.tolist() for i in ids] == whole(texts) and all(same) and exact == [True, True, True, False, True]
    assert 0 < codec.held < 10_000 and all(len(w) <= sp.LONG_WORD for w in codec.memo)
    codec.memo[" some"] = codec.memo[" and"]  # a wrong word is found out on the whole text
    codec.most = 1 << 30
    assert codec.encode(texts)[2][0] is False


def message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
        elif isinstance(value, int):
            key = number << 3
            out += (bytes([key]) if key < 128 else bytes([key & 127 | 128, key >> 7])) + bytes([value])
        else:
            size = len(value)
            out += bytes([number << 3 | 2]) + (bytes([size]) if size < 128 else bytes([size & 127 | 128, size >> 7])) + value
    return out


def hand_made(kind, strip):
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    normal = ["▁th", "▁the", "he", "re", "▁", "t", "h", "e", "r", "▁there", "th", "er", "▁re", "he r".replace(" ", "")]
    pieces += [(p, -0.7 * k - 1.0, 1) for k, p in enumerate(dict.fromkeys(normal))]
    out = b"".join(message((1, message((1, p.encode()), (2, score), (3, k)))) for p, score, k in pieces)
    return out + message((2, message((3, kind), (35, 1)))) + message((3, message((1, b"identity"), (3, 1), (4, strip))))


@pytest.mark.parametrize("kind", [sp.UNIGRAM, sp.BPE])
@pytest.mark.parametrize("strip", [0, 1])
def test_parity_of_other_models(kind, strip):
    raw = hand_made(kind, strip)
    codec = sp.Codec(raw)
    texts = ["the there", "her the  re", " therethe", "thé other 🙂", "eee rrr hhh ttt", "he  ", "x"]
    ids, exact, same = codec.encode(texts)
    assert [i.tolist() for i in ids] == whole(texts, raw) == codec.whole(texts)
    assert all(same)


def test_query(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = sp.op4_sentencepiece(spark, small).collect()
    assert len(got) == len(docs)
    for r, ids in zip(got, whole([docs[r.doc_id] for r in got])):
        assert (r.n_tokens, r.ids_sha256, r.exact, r.parity) == (len(ids), sp.ids_sha256(ids), True, True)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " "), (None, "word"), (5, "word"), (5, "word"), (6, "long " * 100_000), (7, "▁")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, ids int")
    got = [(r.row.doc_id, r.n_tokens, r.exact, r.parity) for r in sp.encoded(df).collect()]
    assert sorted(got, key=str)[:3] == [(1, 0, True, True), (2, 0, True, True), (3, 1, True, True)]
    assert all(p and (e or i == 7) for i, _, e, p in got)
    assert sp.encoded(df.limit(0)).count() == 0
