"""Decontamination against a plain scan, in one block and in many."""

import hashlib
import re

import pyarrow as pa
import pytest

from scriptorium.llm.common import read_table
from scriptorium.llm.decontaminate import _item_sets, _scanned, contamination_report, drop_contaminated, find_contamination, remove_spans

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, size=10):
    wins = {}
    for item, text in items:
        w = words(text)
        for p in range(max(1, len(w) - size + 1)) if w else ():
            wins.setdefault(tuple(w[p : p + size]), set()).add(str(item) if item is not None else "null")
    lengths = {len(w) for w in wins}
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for p in range(len(w) - n + 1):
                if (key := tuple(w[p : p + n])) in wins:
                    hit |= set(range(p, p + n))
                    found |= wins[key]
        names = ",".join(sorted(found))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture
def odd(spark):
    passage = " ".join(f"w{k}" for k in range(14))
    docs = [(1, None, 9), (2, "", 9), (3, "...", 9), (4, f"A {passage.upper()}! z", 9), (5, "It says: short ITEM.", 9),
            (5, "It says: short ITEM.", 9), (6, passage[:-4] + " x " + passage, 9), (None, passage, 9), (7, "é1 É1", 9), (7, "other", 9),
            (8, "pad " * 200000 + passage, 9)]
    items = [(1, passage, "a"), (2, passage[3:], "b"), (2, passage[3:], "b"), (3, "Short-item", "c"), (4, None, "d"), (5, "?!", "e"),
             (None, "é1", "f")]
    return (spark.createDataFrame(docs, "doc_id bigint, text string, n_words int"),
            spark.createDataFrame(items, "item_id bigint, text string, items string"))


@pytest.mark.parametrize("block_windows", [500000, 3])
def test_odd_rows_equal_a_plain_scan(spark, odd, block_windows):
    docs, items = odd
    expected = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = find_contamination(docs, items, block_windows=block_windows)
    rows = [(r.doc_id, r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated)
            for r in got.collect()]
    assert sorted(rows, key=str) == expected


def test_tables_equal_a_plain_scan(spark, sf_dir):
    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    expected = brute(docs.select("doc_id", "text").collect(), items.select("item_id", "text").collect())
    assert sorted(map(tuple, contamination_report(docs, items).collect()), key=str) == expected
    assert any(r[-1] for r in expected)


def test_removal(spark, odd):
    docs, items = odd
    kept = drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 7]
    cut = {r.text for r in remove_spans(docs, items).where("doc_id = 5 or doc_id = 4").collect()}
    assert cut == {"It says: .", "A ! z"}
    assert drop_contaminated(docs, items.limit(0)).count() == docs.count()
    assert contamination_report(docs.limit(0), items).count() == 0


def test_a_prompt_that_many_items_and_documents_share_is_gathered_once(spark):
    prompt = "read the passage below and then answer each of the questions"
    items = spark.createDataFrame([(i, f"{prompt} q{i}") for i in range(200)], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, f"{prompt} doc {i}") for i in range(150)] + [(999, "none")], "doc_id bigint, text string")
    assert _item_sets(*_scanned(docs, items)).count() == 1
    rows = contamination_report(docs, items).collect()
    assert sorted(map(tuple, rows), key=str) == brute(docs.collect(), items.collect())
    assert {r.n_items for r in rows if r.doc_id < 999} == {200}


def test_blocks_are_bounded_by_bytes(spark, odd):
    docs, items = odd
    whole = sorted(map(tuple, find_contamination(docs, items).drop("key").collect()), key=str)
    assert sorted(map(tuple, find_contamination(docs, items, block_bytes=100).drop("key").collect()), key=str) == whole


def test_scanned_in_small_parts(spark, monkeypatch):
    """Texts are cut into words by the megabyte and the thousand rows: a whole batch at once took an executor's memory."""
    from scriptorium.llm import common, decontaminate

    sizes = []

    class Seen(decontaminate.Words):
        def __init__(self, texts):
            sizes.append(sum(map(len, texts)))
            super().__init__(texts)

    monkeypatch.setattr(decontaminate, "Words", Seen)
    batch = pa.RecordBatch.from_pydict({"item": [str(k) for k in range(2500)], "data": [b"some words " * 100] * 2500})
    found = {}

    class Table:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            found["rows"] = sum(b.num_rows for b in run([batch]))
            return self

        def distinct(self):
            return self

    decontaminate.benchmark_windows(Table())
    assert found["rows"] == 2500 * 191 and max(sizes) <= decontaminate.PIECE_BYTES + 1100
    assert [b.num_rows for b in common.slices([batch])] == [1000, 1000, 500]
