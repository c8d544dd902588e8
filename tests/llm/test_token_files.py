"""Token files: exact round trips, and the report against the library itself."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scriptorium.llm.common import read_table
from scriptorium.llm.token_files import (
    CachedEncoder, TokenFile, TokenFileWriter, default_tokenizer, from_planes, read_token_files, to_planes, token_report,
    write_token_files,
)

ENCODER = CachedEncoder(default_tokenizer())


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    for ids in ([], [0], [1, 2**32 - 1, 77], list(range(1000))):
        x = np.array(ids, np.uint32)
        assert from_planes(to_planes(x, kind), len(x), kind).tolist() == ids


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_file_round_trip_and_random_access(kind):
    rng, sink = np.random.default_rng(1), pa.BufferOutputStream()
    docs = [(k, rng.integers(0, 50257, n).astype(np.uint32)) for k, n in enumerate([0, 1, 5, 300, 1000, 0, 64, 63])] + [(None, np.arange(3, dtype=np.uint32))]
    writer = TokenFileWriter(sink, kind, block_ids=64)
    for i, ids in docs:
        writer.add(i, ids)
    writer.close()
    file = TokenFile(pa.BufferReader(sink.getvalue()))
    every = np.concatenate([x for _, x in docs])
    assert [(i, n, c) for i, n, c in file.documents()] == [(i, len(x), zlib.crc32(x.astype("<u4").tobytes())) for i, x in docs]
    for start, n in ((0, 0), (0, 1), (63, 2), (100, 500), (len(every) - 3, 3)):
        assert file.ids(start, n).tolist() == every[start : start + n].tolist()
    with pytest.raises(ValueError):
        TokenFile(pa.BufferReader(b"x" * 100))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab1é€ \n\t.'  \x1c")) , max_size=30) | st.text(max_size=20))
def test_pieces_give_the_library_s_ids(text):
    assert ENCODER.encode(text).tobytes() == ENCODER.whole(text)


def test_special_token_strings():
    for text in ("<|endoftext|>", "a <|endoftext|> b", "a b<|endoftext|>c d"):
        assert ENCODER.encode(text).tobytes() == ENCODER.whole(text)


def brute(rows):
    library, at, out = Tokenizer.from_file(default_tokenizer()), 0, []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_table(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert sorted(map(tuple, token_report(docs).collect())) == brute(rows)


def test_odd_rows(spark, tmp_path):
    rows = [(3, None, 1), (1, "", 1), (2, "long " * 100000, 1), (2, "other", 1), (5, "same", 1), (5, "same", 1), (None, "no id", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start int")
    manifest = write_token_files(docs, f"file://{tmp_path}/a", block_ids=512, file_ids=1000, kind="bit")
    got = sorted(map(tuple, read_token_files(manifest).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 1, 2, 2, 3, 5, 5]
    assert got[0][1] == 0 and all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))
    by = {(r[0], r[2], r[3]) for r in got}
    assert by == {(i, n, c) for i, _, n, c in brute([(i, t) for i, t, _ in rows])}
    assert manifest.agg({"n_docs": "sum"}).first()[0] == 7
    assert token_report(docs.limit(0), f"file://{tmp_path}/b").count() == 0
