"""Quality measures and verdicts against plain Python."""

import collections
import re

import pytest

from scriptorium.llm.common import read_table
from scriptorium.llm.quality import base_rules, keep_good, method_rules, ordered, quality_report, rejected_by


def brute(text):
    t = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    out = (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    letters, upper = sum(x.isalpha() for x in t), sum(x.isupper() for x in t)
    junk = (out[2] * 10 > len(w) or t.count("!") * 10 > 3 * len(w) or upper * 10 > letters * 6 or out[3] * 2 > len(lines)
            or out[1] > 40 * len(w) or letters * 5 < len(t))
    return (*out, failed, not failed and not junk)


ODD = [None, "", " \t\n", "a", "one two three four five six seven eight " * 2, "one two three four five six seven eight " * 3 + "x y",
       "x\n\nx\n \nx\ty", "\x0bé€𝄞 \x0c#*$%&|<>\r\n", "ein Wort nach dem anderen und noch eines " * 4000, "A! " * 40,
       "  no-break space " * 12, " ".join(f"w{k}" for k in range(3000))]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(k, t, -1, "m") for k, t in enumerate(ODD * 2)], "doc_id bigint, text string, n_words int, m string")


def test_odd_texts(spark, odd):
    got = {r.doc_id: tuple(r)[1:] for r in quality_report(odd).collect()}
    assert got == {k: brute(t) for k, t in enumerate(ODD * 2)}
    assert quality_report(odd.limit(0)).count() == 0


def test_table(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: tuple(r)[1:] for r in quality_report(docs).collect()}
    assert got == {k: brute(t) for k, t in texts.items()}
    kept = {k for k, v in got.items() if v[-1]}
    assert {r.doc_id for r in keep_good(docs).collect()} == kept and 0 < len(kept) < len(texts)


def test_filter_keeps_columns_and_any_order_gives_the_same_rows(spark, odd):
    rules = base_rules() + method_rules()
    kept = keep_good(odd)
    assert kept.columns == odd.columns
    forward = {r.doc_id for r in odd.where(rejected_by(rules).isNull()).collect()}
    backward = {r.doc_id for r in odd.where(rejected_by(rules[::-1]).isNull()).collect()}
    assert {r.doc_id for r in kept.collect()} == forward == backward


def test_order_uses_rejections(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    rules = method_rules()
    names = [r.name for r in ordered(docs, rules)]
    assert sorted(names) == sorted(r.name for r in rules)
    assert max(names.index("symbols"), names.index("shouting")) < min(names.index("word_length"), names.index("no_letters"))


def test_no_python_in_the_plan(spark, sf_dir):
    plan = quality_report(read_table(spark, sf_dir, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
