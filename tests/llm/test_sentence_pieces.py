"""Merge rounds against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from scriptorium.llm.common import read_table
from scriptorium.llm.sentence_pieces import PieceCoder, decode_documents, default_model, encode_documents, piece_report

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=default_model())


def want(i, text):
    ids = LIBRARY.encode(text or "", add_bos=True, add_eos=True)
    digest = lambda x: hashlib.sha256(x).hexdigest()
    return i, len(ids), digest(np.array(ids, "<u4").tobytes()), digest(LIBRARY.decode(ids).encode())


ODD = [
    "", " ", "  ", "   ", " a", "a ", "a  b", "\n", " \n ", "\u2581", "a\u2581b \u2581\u2581", "<s> </s> <unk> <0x41> <pad>", "\u0000x", "e\u0301 ﬁ ½",
    "日本語のテキスト", "😀😀 family 👨‍👩‍👧", "\ufffd\u200b\u3000", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "banana" * 50, "hello,world.(x) " * 3,
    "http://a.b/c?d=e&f=%20" * 20, "-" * 999, "= " * 70, "\t\t\tif x:\n\t\t\t\treturn    y\r\n", "ab" * 500, "\u2581x\u2581 y",
]


@pytest.fixture(scope="module")
def coder():
    return PieceCoder(default_model())


def test_odd_texts(coder):
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode_many(ODD)] == [LIBRARY.encode(t, add_bos=True, add_eos=True) for t in ODD]
    for text in ODD:
        ids = LIBRARY.encode(text)
        assert coder.decode(ids) == LIBRARY.decode(ids)


def test_random_texts(coder):
    rng = random.Random(3)
    alphabets = ["ab", "aeiourst nl", "  \u2581a\n", "abcdefghijklmnopqrstuvwxyzABCDEF .,'\"-_/\\0123456789", "éèüßñ çàê", "".join(map(chr, range(32, 2000)))]
    texts = ["".join(rng.choices(rng.choice(alphabets), k=rng.randrange(0, 300))) for _ in range(1500)]
    for text, got in zip(texts, coder.encode_many(texts)):
        ids = np.frombuffer(got, "<u4").tolist()
        assert ids == LIBRARY.encode(text, add_bos=True, add_eos=True), text
        assert coder.decode(ids) == LIBRARY.decode(ids)


def test_any_ids_decode_alike(coder):
    rng = random.Random(4)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(300)]) for _ in range(rng.randrange(12))]
        assert coder.decode(ids) == LIBRARY.decode(ids), ids


def test_a_long_text_without_blanks(coder):
    rng = random.Random(5)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=20_000)) + "z" * 5000
    assert np.frombuffer(coder.encode_many([text])[0], "<u4").tolist()[1:-1] == LIBRARY.encode(text)


def test_memory_is_bounded(coder, monkeypatch):
    monkeypatch.setattr("scriptorium.llm.sentence_pieces.WORDS_KEPT", 5)
    texts = ["one two three", "four five six seven", "one " + "x" * 60]
    for text in texts:
        assert np.frombuffer(coder.encode_many([text])[0], "<u4").tolist() == LIBRARY.encode(text, add_bos=True, add_eos=True)


def test_given_table(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    assert sorted(map(tuple, piece_report(docs).collect())) == sorted(want(r.doc_id, r.text) for r in docs.collect())


def test_odd_rows(spark):
    rows = [(1, None), (None, "a b"), (2, ""), (2, ""), (3, "word " * 40_000), *((10 + k, t) for k, t in enumerate(ODD))]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id bigint, text string, ids int")
    assert sorted(map(tuple, piece_report(docs).collect()), key=str) == sorted((want(*r) for r in rows), key=str)
    assert piece_report(docs.limit(0)).count() == 0
    back = decode_documents(encode_documents(docs))
    expected = [(i, LIBRARY.decode(LIBRARY.encode(t or ""))) for i, t in rows]
    assert sorted(map(tuple, back.collect()), key=str) == sorted(expected, key=str)
