"""Repair of conversations against a search over all edits, one conversation at a time."""

import functools
import hashlib
import itertools
import random
import re
import sys
import zlib

import pytest

from scriptorium.llm.common import read_table
from scriptorium.llm.repair import IDENTITY, Rope, product, repair_conversations, repair_grammar, repair_report, row_matrix, sequence_matrices

BLANK = " \t\n\x0b\x0c\r"


def brute_repair(rows):
    """(cost, edits, repaired rows) of (role, text, fault) rows, from the end to the start."""
    sys.setrecursionlimit(100_000)
    inserted = {0: "u", 1: "u", 2: "a", 3: "u"}
    moves = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    @functools.cache
    def best(i, state, inserts):
        options = []
        if inserts < 3:
            cost, edits = best(i, moves[state, inserted[state]], inserts + 1)
            options.append((cost + 2, "I" + edits))
        if i == len(rows):
            return min([*options, (0, "")]) if state in (0, 3) else min(options, default=(10**9, ""))
        role, _, fault = rows[i]
        cost, edits = best(i + 1, state, 0)
        options.append((cost + 3, "D" + edits))
        if fault not in ("blank", "duplicate"):
            extra = fault == "truncated"
            if (state, role[:1]) in moves:
                cost, edits = best(i + 1, moves[state, role[:1]], 0)
                options.append((cost + extra, "K" + edits))
            cost, edits = best(i + 1, moves[state, inserted[state]], 0)
            options.append((cost + 2 + extra, "R" + edits))
        return min(options)

    for i in range(len(rows), -1, -1):  # keeps the recursion shallow
        for state, inserts in itertools.product(range(4), range(4)):
            best(i, state, 3 - inserts)
    cost, edits = best(0, 0, 0)
    out, i, state = [], 0, 0
    for e in edits:
        name = {"u": "user", "a": "assistant"}[inserted[state]]
        if e != "I":
            i += 1
        if e == "D":
            continue
        role, text = (name, "") if e == "I" else (rows[i - 1][0] if e == "K" else name, rows[i - 1][1])
        out.append((role, text))
        state = moves[state, role[0]]
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out))
    return cost, edits, out


def brute(table):
    fill = lambda x: " " if x is None else x
    groups = {}
    for conv, turn, role, text in table:
        code = zlib.crc32(f"{fill(conv)}:{fill(turn)}".encode()) % 20
        role, text = fill(role), fill(text)
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        groups.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(code, 1))
    out = []
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        marked, seen = [], set()
        for _, role, text in rows:
            core = text.rstrip(BLANK)
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        counts = [sum(f == k for *_, f in marked) for k in ("blank", "duplicate", "truncated")]
        cost, edits, fixed = brute_repair(marked)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out.append((conv, gaps, *counts, illegal, cost, edits, digest))
    return sorted(out, key=str)


def report(df, **kw):
    columns = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    return sorted(map(tuple, repair_report(df, **kw).select(*columns).collect()), key=str)


def test_ropes_compare_as_strings():
    rng = random.Random(1)
    ropes = [Rope("".join(rng.choices("DI", k=rng.randrange(1, 4)))) for _ in range(6)]
    for _ in range(300):
        ropes.append(rng.choice(ropes) + rng.choice(ropes))
        if ropes[-1].size > 200:
            ropes.pop()
    for _ in range(3000):
        a, b = rng.choice(ropes), rng.choice(ropes)
        assert (a < b) == (str(a) < str(b)) and len(str(a)) == a.size


def test_grammar_spells_the_sequences_again():
    rng = random.Random(2)
    for _ in range(200):
        sequences = [[rng.randrange(3) for _ in range(rng.randrange(30))] for _ in range(rng.randrange(6))]
        rules, left = repair_grammar(sequences, 3)

        def spell(s):
            return [s] if s < 3 else [x for part in rules[s - 3] for x in spell(part)]

        assert [[x for s in one for x in spell(s)] for one in left] == sequences
        pairs = [p for one in left for p in zip(one, one[1:])]
        assert max((pairs.count(p) for p in pairs if p[0] != p[1]), default=1) == 1


def test_products_do_not_depend_on_grouping():
    """The least edits at each step are the least over all, however rows are grouped."""
    rng = random.Random(3)
    symbols = ["s", "u", "a", "x", "st", "ut", "at", "xt", "-"]
    for _ in range(150):
        sequence = tuple(rng.choice(symbols) for _ in range(rng.randrange(9)))
        matrices = [row_matrix(s) for s in sequence]
        left = functools.reduce(product, matrices, IDENTITY)
        right = functools.reduce(lambda acc, m: product(m, acc), reversed(matrices), IDENTITY)
        read = lambda m: {k: (c, str(e)) for k, (c, e) in m.items()}
        assert read(left) == read(right) == read(sequence_matrices([sequence, sequence[::-1], sequence * 2])[sequence])


def test_given_table(spark, sf_dir):
    table = read_table(spark, sf_dir, "conversations")
    assert report(table) == brute([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("unit_rows", [1, 3, 50_000])
def test_odd_rows(spark, unit_rows):
    rng = random.Random(unit_rows)
    roles = ["user", "assistant", "system", "tool", "", " ", None, "User", "åssistant"]
    texts = ["Hi.", "What now?", "It is", "", " \n", None, "Done!", "é. \t", "long text " * 3000]
    rows = [(c, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for c in [None, *range(40)] for _ in range(rng.randrange(14))]
    rows += [(77, k, ("user", "assistant")[k % 2], f"Turn {k}.") for k in range(400)]  # a long conversation
    rows += [(78, 5, "user", "Same.")] * 60
    docs = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, fault string")
    assert report(docs.repartition(5), unit_rows=unit_rows) == brute(rows)
    assert report(docs.limit(0)) == []


def test_repaired_rows_without_damage(spark):
    rows = [("a", 1, "user", "Hi."), ("a", 2, "user", "There?"), ("b", 1, "assistant", "Yes."), ("c", 1, "system", "Be kind."), ("c", 2, "user", "Ok."), ("c", 3, "assistant", "Ok.")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    got = {}
    for r in repair_conversations(df).orderBy("part", "seq").collect():
        got.setdefault(r.conv_id, []).append((list(zip(r.roles, r.texts)), r.edits, r.cost))
    assert [x for rows, *_ in got["a"] for x in rows] == [("user", "Hi."), ("assistant", "There?")]
    assert [x for rows, *_ in got["b"] for x in rows] == [("user", ""), ("assistant", "Yes.")]
    assert [c for *_, c in got["c"] if c is not None] == [0]
