"""Poisson replication: draws, shares and odd rows."""

import collections
import math

import pytest

from scriptorium.llm.common import read_table
from scriptorium.llm.mixing import mix_sources, mixture, source_rates


def test_equal_shares_of_the_table(spark, sf_dir):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    rates = {r.source: r for r in source_rates(docs).collect()}
    share = sum(r["size"] for r in rates.values()) / len(rates)
    assert all(math.isclose(r.rate * r["size"], share) for r in rates.values())
    rows = mixture(docs).select("doc_id", "source", "mix_copy", "mix_key").collect()
    assert len({r.mix_key for r in rows}) == len(rows)
    copies = collections.Counter(r.doc_id for r in rows)
    assert all({r.mix_copy for r in rows if r.doc_id == i} == set(range(n)) for i, n in list(copies.items())[:50])
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixture(docs).select("doc_id", "source", "mix_copy", "mix_key").collect()))


@pytest.mark.parametrize("rate", [0.3, 1.0, 6.5])
def test_counts_follow_the_poisson_distribution(spark, rate):
    n = 20000
    docs = spark.range(n).selectExpr("id AS doc_id", "'x' AS source", "'' AS text")
    rows = mix_sources(docs, {"x": 2.0}, total_chars=int(n * rate)).groupBy("doc_id").count().groupBy("count").count().collect()
    got = {r[0]: r[1] for r in rows}
    got[0] = n - sum(got.values())
    chi = 0.0
    for k in range(14):
        expected = n * math.exp(-rate) * rate**k / math.factorial(k)
        if expected > 5:
            chi += (got.get(k, 0) - expected) ** 2 / expected
    assert chi < 40


def test_weights_and_odd_rows(spark):
    rows = [(k, "text", s, 5) for k in range(400) for s in ("a", "b", None)] + [(None, None, "a", 5), (7, "", "c", 5), (1, "text", "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, mix_copy int")
    out = mix_sources(docs, {"a": 1.0, None: 3.0, "c": -2.0, "unknown": 1.0})
    assert set(out.columns) == {"doc_id", "text", "source", "mix_copy", "mix_key"}
    by = collections.Counter(r.source for r in out.collect())
    assert by["b"] == by["c"] == 0 and 2 < by[None] / by["a"] < 4
    assert mix_sources(docs.limit(0)).count() == 0
    assert mix_sources(docs, {"nobody": 1.0}).count() == 0


def test_ranges_of_parts_change_no_result(spark):
    """One short document has to fill half the mixture; a repeated row and a text of two sources draw for themselves."""
    rows = [(k, "word " * 40, "large") for k in range(300)] + [(900, "x", "tiny"), (900, "x", "tiny"), (900, "x", None), (901, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    names = ["doc_id", "text", "source", "mix_copy", "mix_key"]
    whole, dealt = (sorted(map(repr, mix_sources(docs, range_parts=n).select(names).collect())) for n in (1 << 40, 7))
    assert whole == dealt
    copies = collections.Counter((r.source, r.mix_copy) for r in mix_sources(docs, range_parts=7).where("doc_id = 900").collect())
    tiny = [n for (source, _), n in copies.items() if source == "tiny"]
    assert len(tiny) > 1000 and set(tiny) == {2}  # both rows, numbered alike and without a gap
    assert {c for s, c in copies if s == "tiny"} == set(range(len(tiny)))
