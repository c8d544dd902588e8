"""The pipeline against plain Python, stage by stage in one go."""

import hashlib
import math
from collections import Counter

import corpus_pipeline
import test_decontaminate
import test_near_copies
import test_quality
import test_token_files

from scriptorium.llm.common import read_table


def draws(rows):
    """Copies of (doc_id, text, source) rows for equal source shares."""
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text or "") + 1
    total, out = sum(sizes.values()), []
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    for i, text, source in rows:
        rate = 1.0 / len(sizes) * total / sizes[source]
        parts = max(1, math.ceil(rate / 4.0))
        p = c = math.exp(-rate / parts)
        table = [c]
        for k in range(1, 40):
            p = p * (rate / parts) / k
            c += p
            table.append(c)
        row = md5("|".join(["11", *([] if i is None else [str(i)]), md5(text or "")]))
        for j in range(1, parts + 1):
            u = int(md5(f"{row}|{j}")[:13], 16) / 2**52
            out += [(i, text)] * sum(x <= u for x in table)
    return out


def brute(rows, items):
    rows = [r for r in rows if test_quality.brute(r[1])[-1]]
    kept = set(test_near_copies.brute_kept([(i, t) for i, t, _ in rows]))
    rows = [r for r in rows if r[0] in kept]
    bad = {r[0] for r in test_decontaminate.brute([(i, t) for i, t, _ in rows], items) if r[-1]}
    mixed = draws([r for r in rows if r[0] not in bad])
    return test_token_files.brute(sorted(mixed))


def test_run(spark, sf_dir):
    rows = [(r.doc_id, r.text, r.source) for r in read_table(spark, sf_dir, "documents").collect()]
    items = [(r.item_id, r.text) for r in read_table(spark, sf_dir, "benchmark").collect()]
    got = sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()), key=lambda r: r[1])
    want = brute(rows, items)
    assert got == want and 0 < len({r[0] for r in got}) < len(rows)


def test_stages_keep_the_columns_and_pass_an_empty_table(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").selectExpr("*", "1 AS size", "'x' AS words").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, docs, sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == 0


def test_stages_take_odd_rows(spark, sf_dir):
    good = " ".join(f"word{k}" for k in range(60))
    rows = [(1, None, None), (2, "", "a"), (None, good, "a"), (None, good, "a"), (3, good + " end", None), (3, good + " end", None), (4, good, "b")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id bigint, text string, source string, size int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "source", "size"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()
