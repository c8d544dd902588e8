"""Repair of the turn structure of conversations at the least cost.

Rows are sorted by conversation and turn over all tasks; a conversation that reaches over
a task's edge, or is long, falls into *units*, all others are one unit. A row is a symbol:
its role's initial and whether it must go (blank, duplicate) or is truncated.

The states of the grammar ``(s?(ua)+)?`` make a row a min-plus matrix: the cost and the
edits from each state to each. The symbols of a task's units are compressed by Re-Pair;
each rule has the product of its two matrices, whose edits are ropes, worked out once
from the bottom up and used by all conversations that contain it. A unit's matrix is the
product of the symbols left, and a conversation's edits follow from its units' matrices.

Edits of equal cost are told apart by their initials, the least in ASCII order. Products
keep that order because insertions stand before the row they precede: edits over the
same rows are then never a proper beginning of one another. Only behind the last row
insertions come last, and there whole strings are compared.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import settle

UNIT_ROWS = 50_000
UNIT_CHARS = 4 << 20
BATCH_ROWS = 50_000

# --- fixed values: costs of the edits, and the moves of the grammar -----------
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
START, OPENED, ASKED, DONE = range(4)
MOVES = {(START, "s"): OPENED, (START, "u"): ASKED, (OPENED, "u"): ASKED, (ASKED, "a"): DONE, (DONE, "u"): ASKED}
NEXT = {START: "u", OPENED: "u", ASKED: "a", DONE: "u"}  # the only role besides s that a state takes
NAMES = {"u": "user", "a": "assistant"}
TAILS = {START: "", OPENED: "II", ASKED: "I", DONE: ""}
LEGAL = {"su", "ua", "au"}
GONE = "-"  # the symbol of a row that must be deleted

BLANKS = " \t\n\x0b\x0c\r"


class Rope:
    """A string as a tree of shared parts."""

    __slots__ = ("left", "right", "leaf", "size")

    def __init__(self, leaf: str = "", left: Rope | None = None, right: Rope | None = None):
        self.leaf, self.left, self.right = leaf, left, right
        self.size = left.size + right.size if left else len(leaf)

    def __add__(self, other: Rope) -> Rope:
        return other if not self.size else self if not other.size else Rope("", self, other)

    def leaves(self) -> Iterator[str]:
        stack = [self]
        while stack:
            node = stack.pop()
            if node.left:
                stack += (node.right, node.left)
            else:
                yield node.leaf

    def __str__(self) -> str:
        return "".join(self.leaves())

    def __lt__(self, other: Rope) -> bool:
        """Character order; parts that both share are passed over whole."""
        mine, theirs = [self], [other]
        while mine and theirs:
            a, b = mine[-1], theirs[-1]
            if a is b:
                mine.pop()
                theirs.pop()
            elif a.left and (a.size >= b.size or not b.left):
                mine[-1:] = (a.right, a.left)
            elif b.left:
                theirs[-1:] = (b.right, b.left)
            else:
                n = min(len(a.leaf), len(b.leaf))
                if a.leaf[:n] != b.leaf[:n]:
                    return a.leaf < b.leaf
                mine[-1:] = [Rope(a.leaf[n:])] if len(a.leaf) > n else []
                theirs[-1:] = [Rope(b.leaf[n:])] if len(b.leaf) > n else []
        return not mine and bool(theirs)


EMPTY = Rope()
Cell = tuple[int, Rope]  # cost and edits
Matrix = dict[tuple[int, int], Cell]  # by (state before, state behind)
IDENTITY: Matrix = {(p, p): (0, EMPTY) for p in range(4)}


def better(a: Cell, b: Cell | None) -> bool:
    return b is None or a[0] < b[0] or (a[0] == b[0] and a[1] is not b[1] and a[1] < b[1])


def product(x: Matrix, y: Matrix) -> Matrix:
    """First ``x``, then ``y``: the least cost, and of equal costs the least edits."""
    out: Matrix = {}
    for (p, r), (cost, edits) in x.items():
        for q in range(4):
            if (then := y.get((r, q))) is not None:
                total, known = cost + then[0], out.get((p, q))
                if known is None or total <= known[0]:
                    cell = (total, edits + then[1])
                    if better(cell, known):
                        out[p, q] = cell
    return out


def row_matrix(symbol: str) -> Matrix:
    """Matrix of a row: insertions, then one edit of the row. A symbol is initial and ``t`` if truncated, or ``-``."""
    out: Matrix = {}
    extra = TRUNCATED if symbol.endswith("t") else 0

    def offer(p: int, q: int, cost: int, edits: str):
        cell = (cost, Rope(edits))
        if better(cell, out.get((p, q))):
            out[p, q] = cell

    for p in range(4):
        at, cost, edits = p, 0, ""
        for _ in range(3):  # none, one or two insertions; more come back to the same states
            if symbol != GONE:
                if (p_next := MOVES.get((at, symbol[0]))) is not None:
                    offer(p, p_next, cost + KEEP + extra, edits + "K")
                offer(p, MOVES[at, NEXT[at]], cost + REROLE + extra, edits + "R")
            offer(p, at, cost + DELETE, edits + "D")
            at, cost, edits = MOVES[at, NEXT[at]], cost + INSERT, edits + "I"
    return out


def repair_grammar(sequences: list[list[int]], fresh: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Re-Pair: the rules, numbered from ``fresh`` on, and the sequences that are left.

    The most frequent pair of neighbours becomes a symbol, until none occurs twice.
    """
    symbol = [s for sequence in sequences for s in (*sequence, -1)]
    n = len(symbol)
    ahead, back = list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], set[int]] = {}

    def note(at: int, add: bool) -> None:
        if at < 0 or ahead[at] >= n or symbol[at] < 0 or symbol[ahead[at]] < 0:
            return
        pair = symbol[at], symbol[ahead[at]]
        if add:
            found = places.setdefault(pair, set())
            found.add(at)
            if len(found) > 1:
                heapq.heappush(heap, (-len(found), pair))
        else:
            places.get(pair, set()).discard(at)

    heap: list[tuple[int, tuple[int, int]]] = []
    for at in range(n - 1):
        if symbol[at] >= 0 and symbol[at + 1] >= 0:
            places.setdefault((symbol[at], symbol[at + 1]), set()).add(at)
    heap = [(-len(found), pair) for pair, found in places.items() if len(found) > 1]
    heapq.heapify(heap)
    rules: list[tuple[int, int]] = []
    while heap:
        count, pair = heapq.heappop(heap)
        found = places.get(pair, ())
        if len(found) != -count:
            if len(found) > 1:
                heapq.heappush(heap, (-len(found), pair))
            continue
        made = fresh + len(rules)
        rules.append(pair)
        for at in sorted(places.pop(pair)):
            second = ahead[at]
            if symbol[at] != pair[0] or second >= n or symbol[second] != pair[1]:
                continue  # an overlapping occurrence was replaced
            note(back[at], False)
            note(second, False)
            symbol[at], symbol[second] = made, -2
            ahead[at] = ahead[second]
            if ahead[at] < n:
                back[ahead[at]] = at
            note(back[at], True)
            note(at, True)
    out, current = [], []
    at = 0
    while at < n:
        if symbol[at] == -1:
            out.append(current)
            current = []
        elif symbol[at] >= 0:
            current.append(symbol[at])
        at += 1
    return rules, out


def sequence_matrices(sequences: Iterable[tuple[str, ...]]) -> dict[tuple[str, ...], Matrix]:
    """The matrix of each distinct sequence of symbols, over one grammar."""
    distinct = sorted(set(sequences))
    terminals = sorted({s for sequence in distinct for s in sequence})
    number = {s: k for k, s in enumerate(terminals)}
    rules, left = repair_grammar([[number[s] for s in sequence] for sequence in distinct], len(terminals))
    matrices = [row_matrix(s) for s in terminals]
    for a, b in rules:
        matrices.append(product(matrices[a], matrices[b]))
    out = {}
    for sequence, symbols in zip(distinct, left, strict=True):
        matrix = IDENTITY
        for s in symbols:
            matrix = product(matrix, matrices[s])
        out[sequence] = matrix
    return out


def finish(vector: dict[int, Cell]) -> tuple[int, int, str]:
    """(cost, state before the trailing insertions, whole edits) of the cheapest way to an end of the grammar."""
    ends = [(cost + INSERT * len(TAILS[q]), str(edits) + TAILS[q], q) for q, (cost, edits) in vector.items()]
    cost, edits, q = min(ends)
    return cost, q, edits


@dataclass
class Unit:
    """Rows of one conversation that follow one another, as runs of equal rows."""

    conv_id: object
    part: int
    seq: int
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    symbols: list[str] = field(default_factory=list)
    chars: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0  # distinct ones
    low: int | None = None
    high: int | None = None
    first: str | None = None  # initials of the first and the last role
    last: str | None = None

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        initial = role[:1]
        if self.last is not None:
            self.illegal += self.last + initial not in LEGAL
        self.first, self.last = initial if self.first is None else self.first, initial
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)
        known = initial if initial in ("s", "u", "a") else "x"
        self.symbols.append(GONE if fault in ("blank", "duplicate") else known + ("t" if fault == "truncated" else ""))


STATS = ("blank", "duplicate", "truncated", "illegal")


def repaired_rows(roles: list[str], texts: list[str], state: int, edits: str) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits, from a state of the grammar on."""
    out_roles, out_texts, at = [], [], 0
    for edit in edits:
        if edit == "I":
            out_roles.append(NAMES[NEXT[state]])
            out_texts.append("")
            state = MOVES[state, NEXT[state]]
            continue
        if edit != "D":
            role = roles[at] if edit == "K" else NAMES[NEXT[state]]
            out_roles.append(role)
            out_texts.append(texts[at])
            state = MOVES[state, role[0]]
        at += 1
    return out_roles, out_texts


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies, fault, later) of distinct rows, and one row with 0 copies a conversation.

    ``fault`` is that of the first copy, ``later`` that of the others: blank, duplicate
    (role and text stand in an earlier row of the conversation), truncated or none. Rows
    that are alike are counted before any shuffle.
    """
    alike = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = alike.groupBy("conv_id", "role", "text").agg(F.min(place).alias("at"))
    first = first.select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("text").alias("_text"), "at")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("text") == F.col("_text"))
    joined = alike.join(first, same).withColumn("first", place.eqNullSafe(F.col("at")))
    core = F.rtrim("text", F.lit(BLANKS))
    fault = (
        F.when(core == "", "blank").when(~F.col("first"), "duplicate").when(~F.right(core, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    )
    later = F.when(core == "", "blank").otherwise("duplicate")
    return joined.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"), later.alias("later"))


def _type(df: DataFrame) -> str:
    return df.schema["conv_id"].dataType.simpleString()


def _unit_schema(kind: str) -> str:
    return (
        f"conv_id {kind}, part int, seq int, whole boolean, roles array<string>, texts array<string>, edits string, cost bigint, gaps bigint, "
        "blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, low bigint, high bigint, first string, last string, "
        "states array<int>, costs array<bigint>, audits array<string>"
    )


def _gaps(units: list[dict]) -> int:
    turns, low, high = 0, None, None
    for u in units:
        if u["low"] is not None:
            turns += u["turns"] - (u["low"] == high)
            low, high = u["low"] if low is None else low, u["high"]
    return 0 if low is None else high - low + 1 - turns


def find_units(ordered: DataFrame, unit_rows: int = UNIT_ROWS, unit_chars: int = UNIT_CHARS) -> DataFrame:
    """Whole conversations, repaired, and the units of those that may go on elsewhere with their matrices.

    ``ordered`` has the rows of ``faults`` in order of conversation and turn.
    """
    kind = _type(ordered)

    def rows_of(units: list[tuple[Unit, bool]], schema: pa.Schema) -> pa.RecordBatch:
        matrices = sequence_matrices(tuple(u.symbols) for u, _ in units)
        out = []
        for u, whole in units:
            matrix = matrices[tuple(u.symbols)]
            row = {k: getattr(u, k) for k in ("conv_id", "part", "seq", *STATS, "turns", "low", "high", "first", "last")} | {"whole": whole}
            if whole:
                cost, _, edits = finish({q: cell for (p, q), cell in matrix.items() if p == START})
                roles, texts = repaired_rows(u.roles, u.texts, START, edits)
                row |= {"roles": roles, "texts": texts, "edits": edits, "cost": cost, "gaps": _gaps([row])}
            else:
                row |= {"roles": u.roles, "texts": u.texts, "states": [4 * p + q for p, q in matrix],
                        "costs": [c for c, _ in matrix.values()], "audits": [str(a) for _, a in matrix.values()]}
            out.append(row)
        return pa.RecordBatch.from_pylist(out, schema=schema)

    def run(batches):
        part, seq, current, edge = TaskContext.get().partitionId(), 0, None, True
        waiting: list[tuple[Unit, bool]] = []
        schema = None
        for batch in batches:
            schema = schema or _arrow_schema(batch.schema.field("conv_id").type)
            for conv, turn, role, text, copies, fault, later in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current is None or conv != current.conv_id:
                    if current is not None:
                        waiting.append((current, not edge))
                        edge = False
                    current, seq = Unit(conv, part, seq), seq + 1
                for k in range(copies):
                    current.add(turn, role, text, later if k else fault)
                    if len(current.symbols) >= unit_rows or current.chars >= unit_chars:
                        waiting.append((current, False))
                        edge = True  # the conversation goes on in another unit
                        current, seq = Unit(conv, part, seq), seq + 1
                        if sum(len(u.symbols) for u, _ in waiting) >= BATCH_ROWS or sum(u.chars for u, _ in waiting) >= unit_chars:
                            yield rows_of(waiting, schema)
                            waiting = []
                if len(waiting) >= 1000:
                    yield rows_of(waiting, schema)
                    waiting = []
        if current is not None:
            waiting.append((current, False))
        if waiting:
            yield rows_of(waiting, schema)

    columns = ("conv_id", "turn", "role", "text", "copies", "fault", "later")
    return ordered.select(*columns).mapInArrow(run, _unit_schema(kind))


def _arrow_schema(conv: pa.DataType) -> pa.Schema:
    words, numbers = pa.list_(pa.string()), pa.int64()
    return pa.schema([
        ("conv_id", conv), ("part", pa.int32()), ("seq", pa.int32()), ("whole", pa.bool_()), ("roles", words), ("texts", words),
        ("edits", pa.string()), *((k, numbers) for k in ("cost", "gaps", *STATS, "turns", "low", "high")), ("first", pa.string()),
        ("last", pa.string()), ("states", pa.list_(pa.int32())), ("costs", pa.list_(numbers)), ("audits", words),
    ])


def join_units(units: DataFrame) -> DataFrame:
    """(part, seq, state, edits, final, and the conversation's figures on its final unit) of the conversations in units.

    A group holds its units' figures and edits, a byte a row and pair of states, but no texts.
    """

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["seq"]))
        vector: dict[int, Cell] = {START: (0, EMPTY)}
        trail = []
        for row in rows:
            cells = {divmod(k, 4): (c, Rope(a)) for k, c, a in zip(row["states"], row["costs"], row["audits"], strict=True)}
            ahead: dict[int, Cell] = {}
            came: dict[int, int] = {}
            for (p, q), (cost, edits) in cells.items():
                if p in vector:
                    cell = (vector[p][0] + cost, vector[p][1] + edits)
                    if better(cell, ahead.get(q)):
                        ahead[q], came[q] = cell, p
            trail.append((came, cells))
            vector = ahead
        cost, q, _ = finish(vector)
        tail, edits, states = TAILS[q], [], []
        for came, cells in reversed(trail):
            p = came[q]
            edits.append(str(cells[p, q][1]))
            states.append(p)
            q = p
        edits, states = edits[::-1], states[::-1]
        edits[-1] += tail
        figures = {k: sum(r[k] for r in rows) for k in STATS} | {"cost": cost, "gaps": _gaps(rows)}
        full = [r for r in rows if r["first"] is not None]
        figures["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(full, full[1:], strict=False))
        out = [
            {"part": r["part"], "seq": r["seq"], "state": s, "edits": e, "final": k == len(rows) - 1} | (figures if k == len(rows) - 1 else {})
            for k, (r, s, e) in enumerate(zip(rows, states, edits, strict=True))
        ]
        return pa.Table.from_pylist(out, schema=pa.schema([
            ("part", pa.int32()), ("seq", pa.int32()), ("state", pa.int32()), ("edits", pa.string()), ("final", pa.bool_()),
            *((k, pa.int64()) for k in ("cost", "gaps", *STATS)),
        ]))

    small = units.select("conv_id", "part", "seq", *STATS, "turns", "low", "high", "first", "last", "states", "costs", "audits")
    figures = ", ".join(f"{k} bigint" for k in ("cost", "gaps", *STATS))
    return small.groupBy("conv_id").applyInArrow(join, f"part int, seq int, state int, edits string, final boolean, {figures}")


def repair_conversations(conversations: DataFrame, unit_rows: int = UNIT_ROWS, unit_chars: int = UNIT_CHARS) -> DataFrame:
    """Repaired conversations in units: (conv_id, part, seq, whole, final, roles, texts, edits, cost and figures).

    ``conversations`` has (conv_id, turn, role, text) and may have ``copies``, how often a
    row stands there (0: not at all, but its conversation is known). A conversation's
    units in order of (part, seq) are its rows after the edits; figures stand on its final
    one. Rows are taken by turn, nulls first, then role and text. Null roles and texts are
    one space. A null conv_id is a conversation of its own; one without rows stays empty.
    """
    copies = F.col("copies").cast("long") if "copies" in conversations.columns else F.lit(1).cast("long")
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *filled, copies.alias("copies"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"))]
    known = rows.select("conv_id").distinct().select("conv_id", *none, F.lit(0).cast("long").alias("copies"), *(F.lit("").alias(c) for c in ("fault", "later")))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    ordered = faults(rows.where("copies > 0")).unionByName(known).repartitionByRange(*order).sortWithinPartitions(*order)
    units = settle(find_units(ordered, unit_rows, unit_chars), "repair-units")
    columns = ["conv_id", "part", "seq", "whole", "final", "roles", "texts", "edits", "cost", "gaps", *STATS]
    whole = units.where("whole").withColumn("final", F.lit(True)).select(*columns)
    open_ = units.where("not whole")
    plan = join_units(open_)
    placed = open_.select("conv_id", "part", "seq", "whole", "roles", "texts").join(plan, ["part", "seq"])
    kind = _type(conversations)
    schema = f"conv_id {kind}, part int, seq int, whole boolean, final boolean, roles array<string>, texts array<string>, edits string, " + ", ".join(
        f"{k} bigint" for k in ("cost", "gaps", *STATS)
    )

    def run(batches):
        for batch in batches:
            at = {name: k for k, name in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                roles, texts, state, edits = (row.column(at[c]).to_pylist()[0] for c in ("roles", "texts", "state", "edits"))
                roles, texts = repaired_rows(roles, texts, state, edits)
                made = {"roles": pa.array([roles], pa.list_(pa.string())), "texts": pa.array([texts], pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([made.get(c, row.column(at[c])) for c in columns], names=columns)

    return whole.unionByName(placed.mapInArrow(run, schema))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text, copies) after one of five kinds of damage, by a hash of conversation and turn."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.pmod(F.crc32(F.concat_ws(":", text("conv_id"), text("turn")).cast("binary")), F.lit(20))
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), code.alias("code")).select(
        "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1).alias("copies"),
    )


def repair_report(conversations: DataFrame, unit_rows: int = UNIT_ROWS, unit_chars: int = UNIT_CHARS) -> DataFrame:
    """Figures, edits and digest of every conversation after damage and repair, one row each.

    A digest is a chain over all of a conversation's bytes, so the units of one that has
    several pass one task as a stream, in order; nothing but its edits is held there.
    """
    fixed = repair_conversations(damaged(conversations), unit_rows, unit_chars)
    lines = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    pieces = fixed.select("conv_id", "part", "seq", "whole", "final", "gaps", *STATS, "cost", "edits", lines.cast("binary").alias("lines"))
    figures = ["conv_id", "gaps", *STATS, "cost"]
    whole = pieces.where("whole").select(*figures, F.col("edits").alias("audit"), F.sha2("lines", 256).alias("repaired_sha256"))
    order = ["conv_id", "part", "seq"]
    parts = pieces.where("not whole").repartition("conv_id").sortWithinPartitions(*order)
    kind = _type(conversations)

    def run(batches):
        digest, edits = None, []
        for batch in batches:
            at = {name: k for k, name in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                final, some, data = (batch.column(at[c])[k].as_py() for c in ("final", "edits", "lines"))
                edits.append(some)
                if data:
                    if digest is None:
                        digest = hashlib.sha256()
                    else:
                        digest.update(b"\n")
                    digest.update(data)
                if final:
                    row = batch.slice(k, 1)
                    made = [pa.array(["".join(edits)]), pa.array([(digest or hashlib.sha256()).hexdigest()])]
                    yield pa.RecordBatch.from_arrays([*(row.column(at[c]) for c in figures), *made], names=[*figures, "audit", "repaired_sha256"])
                    digest, edits = None, []

    streamed = parts.mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{k} bigint" for k in figures[1:]) + ", audit string, repaired_sha256 string")
    return whole.unionByName(streamed)
