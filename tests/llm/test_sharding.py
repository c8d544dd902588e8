"""Histogram sort: balance, gapless slots, exact counts and groups."""

import collections
import zlib

from pyspark.sql import functions as F

from scriptorium.llm.common import read_table
from scriptorium.llm.sharding import LOW, cell_of, intervals, shard_documents, shard_report, sort_key, write_shards


def check(rows, shards=8, slack=0.02, biggest=0):
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(sizes.values()) / shards
    assert all(abs(sizes[s] - mean) <= slack * mean + biggest for s in range(shards))


def test_table(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    rows = shard_report(docs).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all((r["size"], r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id])) for r in rows)
    check(rows, biggest=max(map(len, texts.values())))
    of = collections.defaultdict(set)
    for r in rows:
        of[texts[r.doc_id]].add(r.shard)
    assert sum(len(s) > 1 for s in of.values()) == 0


def test_a_group_of_a_third_is_parted_only_as_balance_needs(spark):
    rows = [(k, "same text" * 20, 1) for k in range(3000)] + [(k, f"text {k} " * 20, 1) for k in range(3000, 9000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, shard int")
    got = shard_documents(docs).collect()
    check(got, biggest=200)
    shards = {r.shard for r in got if r.text.startswith("same")}
    assert shards == set(range(min(shards), max(shards) + 1))


def test_small_cells_keep_shards_and_gapless_slots(spark, monkeypatch):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    whole = {r.doc_id: r.shard for r in shard_report(docs).collect()}
    monkeypatch.setattr("scriptorium.llm.sharding.CELL_BYTES", 700)
    rows = shard_report(docs).collect()
    check(rows, biggest=max(r["size"] for r in rows))
    assert {r.doc_id: r.shard for r in rows} == whole


def test_a_frequent_text_is_dealt_over_its_interval_s_cells(spark):
    keyed = spark.range(200_000).selectExpr("id as doc_id", "if(id % 1000 = 0, 'copy', concat('text ', id)) as text").withColumn("key", sort_key())
    cells = keyed.select("text", cell_of(F.col("key"), F.lit(0), [64]).alias("c")).groupBy("text", "c.__part").count().where("text = 'copy'")
    sizes = [r["count"] for r in cells.collect()]
    assert sum(sizes) == 200 and len(sizes) > 50 and max(sizes) < 15


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, 7), (1, None, 7), (2, "", 7), (None, "é", 7), (3, "long " * 100000, 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, slot int")
    got = shard_documents(docs).collect()
    assert len(got) == 5 and sorted(r["size"] for r in got) == [1, 1, 1, 3, 500001]
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert shard_documents(docs.limit(0)).count() == 0
    write_shards(docs, f"{tmp_path}/shards")
    assert spark.read.parquet(f"{tmp_path}/shards").count() == 5


def test_intervals_count_exactly(spark):
    keys = [LOW, -5, -5, -5, 0, 1, 2**63 - 1, 2**63 - 1, 77, 1 << 40]
    parts = intervals(spark.createDataFrame([(k, 10) for k in keys], "key bigint, size bigint"), 15, (100, 10))
    assert parts[0].start == LOW and sum(p.rows for p in parts) == 10
    for p, q in zip(parts, [*parts[1:], None]):
        end = q.start if q else 2**63
        assert p.rows == sum(p.start <= k < end for k in keys) and p.size == 10 * p.rows
        assert p.size <= 15 or len({k for k in keys if p.start <= k < end}) == 1 or end - p.start <= 16


def test_no_python_in_the_plan(spark, sf_dir):
    plan = shard_report(read_table(spark, sf_dir, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("hashpartitioning") == 1
