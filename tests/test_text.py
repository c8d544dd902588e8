"""Golden rows, and a plain-Python statement of the definitions on adversarial strings."""

import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.schema import TEXT_FEATURES

GOLDEN = [
    (
        "JOHN: Hi! Who?\nMARY ANN: [cries] No.\nINT. DARK ROOM - NIGHT (rain)\n",
        "hi! who? no. . dark room night",
        [67, 13, 4, 4.153846, 1, 0, 5, 2.6, 1.624808, 0.5, 2, 7.692308, 7.692308, 15.384615, 1, 13],
    ),
    ("", "", [0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]),
    ("   ", "", [3, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]),
    ("...!!!", "...!!!", [6, 1, 1, 6, 1, 0, 0, 0, 0, 0, 0, 300, 0, 0, 0, 1]),
    (
        "Hello there\nmy old friend\nNote: run",
        "run",
        [35, 7, 3, 4.142857, 1, 0, 1, 7, 0, 0, 0, 0, 0, 0, 0, 7],
    ),
    (
        "BOB:\nBOB: x\nEXT ROOF\nat 12:30 scene 5 caf\xe9",
        "x roof at caf",
        [42, 10, 4, 3.3, 0.9, 0, 1, 10, 0, 0.5, 1, 0, 0, 0, 1, 10],
    ),
    ("a b c" + chr(0x1C) + "d", "a b c d", [7, 4, 1, 1, 1, 0, 1, 4, 0, 0, 0, 0, 0, 0, 0, 4]),
    ("(un\nclosed) [ok]", "un closed", [16, 3, 2, 4.666667, 1, 0, 1, 3, 0, 0, 0, 0, 0, 33.333333, 0, 3]),
    (
        "He ran. He jumped. He fell.",
        "he ran. he jumped. he fell.",
        [27, 6, 1, 3.666667, 0.666667, 0, 3, 2, 0, 0, 0, 0, 0, 0, 0, 6],
    ),
]


def py_clean(text):
    """The cleaning steps by their definitions."""
    text = text.lower()
    for pattern, flags in [
        (r"\[.*?\]", 0), (r"\(.*?\)", 0), (r"^[A-Z][A-Z\s]+:", re.M | re.I), (r"\d{1,2}:\d{2}(:\d{2})?", 0),
        (r"\bscene\s*\d+\b", re.I), (r"\bint\.?\b|\bext\.?\b", re.I), (r"[^a-zA-Z0-9'.,!?\s]", 0), (r"\s+", 0),
    ]:
        text = re.sub(pattern, " ", text, flags=flags)
    return text.strip()


def py_features(text):
    """The sixteen features by their definitions."""
    words, lines = text.split(), text.split("\n")
    n = len(words)
    sizes = [len(s.split()) for s in re.split(r"[.!?]+", text) if s.strip()]
    mean = sum(sizes) / len(sizes) if sizes else 0
    cues = re.findall(r"^[A-Z][A-Z\s]+:", text, re.M)
    directions = len(re.findall(r"\[.*?\]", text)) + len(re.findall(r"\(.*?\)", text))
    scenes = len(re.findall(r"\b(INT|EXT)\.?\s", text, re.I))
    return [
        len(text), n, len(lines),
        sum(map(len, words)) / n if n else 0, len(set(words)) / n if n else 0,
        sum(len(w) >= 8 for w in words) / n if n else 0,
        len(sizes), mean, math.sqrt(sum((s - mean) ** 2 for s in sizes) / len(sizes)) if sizes else 0,
        len(cues) / len(lines), len({c[:-1].strip() for c in cues}),
        text.count("!") / max(n, 1) * 100, text.count("?") / max(n, 1) * 100, directions / max(n, 1) * 100,
        scenes, n / max(scenes, 1),
    ]


def measure(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    out = X.text_features(df).withColumn("clean", X.clean_text(F.col("text")))
    return [(r["clean"], [r[f] for f in TEXT_FEATURES]) for r in out.orderBy("id").collect()]


def test_golden_rows(spark):
    for (text, clean, features), (got_clean, got) in zip(GOLDEN, measure(spark, [g[0] for g in GOLDEN])):
        assert got_clean == clean, text
        assert [round(v, 6) for v in got] == features, text


ADVERSARIAL = [
    "A:\nAB:\nA :x\nA\nB:", "ONE\nTWO\nTHREE\n4: x", "ONE\nTWO: [a [b] c] (d (e) f) ]", "\xa0NB\xa0SP:\u2003wide\u2028sep\x85next",
    "int int. ext.int inter print int.x INT\tEXT\n", "scene12 scene 3a scene\n4 obscene 5 Scene\xa06", "1:23 12:345 123:45:67:89 9:9",
    "\u017fcene 5 \u0131nt. \u212aING: \u017fOS: go", "caf\xe9int int\xe9 \xe9 int\u0301", "x'y don't -- a.b,c!d?e", "\r\nTAB\there\r\n",
    "word\n" * 50 + "end:", "word\n" * 50 + "end.", "a " * 100 + "b. " * 3, "\U0001f600 emoji \U0001f600\U0001f600 longerword8 exactly8 ok",
    "[open (close] )", "....", ". . .", "!?", "a.b.c", "  lead and trail  ", "\x00nul\x01ctl", "\u0660\u0661:\u0662\u0663 digits",
]


def test_adversarial_strings_match_definitions(spark):
    for text, (clean, got) in zip(ADVERSARIAL, measure(spark, ADVERSARIAL)):
        assert clean == py_clean(text), repr(text)
        assert got == pytest.approx(py_features(text), abs=1e-9), repr(text)


@settings(max_examples=6, deadline=None)
@given(
    st.lists(
        st.text(alphabet=list("aAbBiInNtTeExXsScC 019.:!?[]()'-\n\t_") + ["\xa0", "\xe9", "\u2028", "\x1c"], max_size=60),
        min_size=100, max_size=200,
    )
)
def test_random_strings_match_definitions(spark, texts):
    for text, (clean, got) in zip(texts, measure(spark, texts)):
        assert clean == py_clean(text), repr(text)
        assert got == pytest.approx(py_features(text), abs=1e-9), repr(text)


def test_unpunctuated_lines_stay_linear(spark):
    """A megabyte of short lines without punctuation must not take minutes."""
    import time

    big = "lonely word\n" * 90_000
    start = time.time()
    [(clean, features)] = measure(spark, [big])
    assert features[1] == 180_000 and len(clean) == len(big) - 1
    assert time.time() - start < 30


def test_no_shuffle_and_pruned_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    plan = X.text_features(docs).drop("text", "lang")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "BatchEvalPython" not in plan and "ArrowEval" not in plan
    assert "lang" not in plan.split("ReadSchema")[1]


def test_symbols_class_is_one_table(spark):
    """Wide spaces stay, all else is replaced; the class itself has no ranges beyond Latin-1."""
    assert "\\x{" not in X.NOT_KEPT.split("](?")[0]
    rows = [(chr(c) + "a" + chr(c),) for c in [*range(1, 0x300), *range(0x1670, 0x1690), *range(0x1FF0, 0x2070), 0x2FFF, 0x3000, 0x3001, 0x1F600]]
    plain = f"[^{X.KEPT}{X.WHITESPACE}]"
    found = spark.createDataFrame(rows, "text string").select(X.strip_symbols(F.col("text")).alias("a"), F.regexp_replace("text", plain, " ").alias("b"))
    assert found.where("a <> b").isEmpty()


def test_clean_text_skips_steps_without_a_sign(spark):
    """The guards change no result."""
    texts = ["", "plain words", "[x] a", "(y) b", "BOB: hi 10:30 there", "scene 12 here", "SCENE 3: (z) [w]", "int. house", "\u017fcene 4", None]
    plain = F.col("text")
    for step in (X.text_lower, X.strip_brackets, X.strip_parens, X.strip_speakers, X.strip_timestamps, X.strip_scene_numbers, X.strip_int_ext):
        plain = step(plain)
    plain = F.trim(F.regexp_replace(plain, X.NOT_KEPT_RUN, " "))
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert df.where(~X.clean_text(F.col("text")).eqNullSafe(plain)).isEmpty()
    assert "contains" in df.select(X.clean_text(F.col("text")))._jdf.queryExecution().toString().lower()
