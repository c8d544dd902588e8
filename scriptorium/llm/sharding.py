"""Sharding by histogram sort, in DataFrame operations only.

Every row has a 64-bit key: its upper 40 bits are a hash of the text, its lower 24
bits one of the id, so equal texts are neighbours in key order and a boundary can
still fall inside a very large group of them. Starting from the whole key range,
each round counts exact bytes and rows below all candidate boundaries, across all
partitions at once, and splits only the intervals that are still too heavy, until
no interval holds more than ``tolerance`` of a shard. Splitters are the interval
ends nearest to equal bytes. Only then do the rows move, once, to the interval
they belong to; a shard is a run of intervals, and a row's slot is its interval's
first slot plus its place inside it. An interval is numbered in cells of ``CELL_BYTES``
or so, dealt by the hash of the id, so that a text that fills an interval is parted too.

The driver sees at most ``shards / tolerance`` heavy intervals and ``FAN`` counts
for each, whatever the table's size.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.llm.common import let, settle, text_bytes

TOLERANCE = 0.01
FAN_BITS = 6
CELL_BYTES = 64 << 20
ID_BITS = 24
LOW, BITS = -(1 << 63), 64


@dataclass(frozen=True)
class Interval:
    """Keys from ``start`` on that agree with it in all but the last ``bits`` bits."""

    start: int
    bits: int
    size: int
    rows: int


def sort_key() -> Column:
    """40 bits of the text's hash, then 24 of the id's."""
    text = F.xxhash64(text_bytes()).bitwiseAND(F.lit(-(1 << ID_BITS)))
    return text.bitwiseOR(F.xxhash64(F.col("doc_id")).bitwiseAND(F.lit((1 << ID_BITS) - 1)))


def _position(key: Column, starts: list[int]) -> Column:
    """Index of the last start that is not above the key: a binary search in a constant array."""
    steps = max(1, (len(starts) - 1).bit_length())
    padded = F.lit(starts + [(1 << 63) - 1] * ((1 << steps) - len(starts)))
    inside = [F.lit(1 << s) for s in reversed(range(steps))]

    def step(at: Column, jump: Column) -> Column:
        # the padding equals the largest key, so a jump must also stay inside the list
        ok = (at + jump < len(starts)) & (F.get(padded, at + jump) <= key)
        return F.when(ok, at + jump).otherwise(at)

    return F.aggregate(F.array(*inside), F.lit(0), step)


def intervals(keyed: DataFrame, limit: int, total: tuple[int, int]) -> list[Interval]:
    """Intervals in key order that cover all keys, none over ``limit`` bytes unless a single key is.

    ``keyed`` has (key, size). Each round is one pre-aggregated count over the keys
    that lie in heavy intervals.
    """
    done, heavy = [], [Interval(LOW, BITS, *total)]
    while heavy:
        starts, bits = [i.start for i in heavy], heavy[0].bits
        at = _position(F.col("key"), starts)
        # the high word of key - start, so that neither sign nor overflow matters
        offset = F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(LOW)), bits - FAN_BITS) if bits < BITS else (
            F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(LOW)), BITS - FAN_BITS)
        )
        child = offset.bitwiseAND(F.lit((1 << FAN_BITS) - 1))
        chosen = keyed.withColumn("parent", at)
        if bits < BITS:
            same = F.shiftright(F.col("key"), bits) == F.shiftright(F.get(F.lit(starts), F.col("parent")), bits)
            chosen = chosen.where(same)
        counts = chosen.groupBy("parent", child.alias("child")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
        below = bits - FAN_BITS
        found = {(r.parent, r.child): (r["size"], r["rows"]) for r in counts.collect()}
        following = []
        for k, parent in enumerate(heavy):
            for c in range(1 << FAN_BITS):
                size, rows = found.get((k, c), (0, 0))
                part = Interval(parent.start + (c << below), below, size, rows)
                (following if size > limit and below >= FAN_BITS else done).append(part)
        heavy = following
    return sorted(done, key=lambda i: i.start)


def cell_of(key: Column, run: Column, cells: list[int]) -> Column:
    """The run and one of its ``cells[run]`` cells, by the id's hash: equal texts are dealt over all of them."""
    part = F.pmod(key.bitwiseAND(F.lit((1 << ID_BITS) - 1)), F.get(F.lit(cells), run)).cast("int")
    return F.struct(run.alias("__run"), part.alias("__part"))


def splitters(parts: list[Interval], shards: int) -> list[int]:
    """Index of the first interval of each shard after the first, nearest to equal bytes."""
    ends, total = [], 0
    for p in parts:
        total += p.size
        ends.append(total)
    out = []
    for s in range(1, shards):
        goal = total * s / shards
        k = bisect.bisect_left(ends, goal)
        nearer = k if k and goal - ends[k - 1] <= ends[k] - goal else k + 1
        out.append(max(nearer, out[-1] if out else 0))
    return out


def shard_documents(documents: DataFrame, shards: int = 8, tolerance: float = TOLERANCE) -> DataFrame:
    """Every column of ``documents`` with ``shard``, ``slot`` and ``size``, shards nearly equal in bytes.

    ``size`` is the text's UTF-8 bytes (null: none) plus one. Slots run from 0
    without gaps in each shard, interval by interval in key order. Equal texts stay together unless a
    splitter must fall inside their group to keep the shards equal. Rows alike in
    id and text have one key and are never parted. Columns named shard, slot or
    size that the input has are replaced. An empty table gives no rows.
    """
    docs = documents.drop("shard", "slot", "size")
    measured = docs.withColumn("size", (F.octet_length(text_bytes()) + 1).cast("bigint")).withColumn("__key", sort_key())
    keyed = settle(measured.select(F.col("__key").alias("key"), "size"), "shard-keys")
    sums = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    limit = max(1, int(sums[0] * tolerance / shards))
    parts = intervals(keyed, limit, (sums[0], sums[1]))
    # runs of light intervals become one, so that each holds about ``limit``
    runs: list[Interval] = []
    for p in parts:
        if runs and runs[-1].size + p.size <= limit:
            runs[-1] = Interval(runs[-1].start, 0, runs[-1].size + p.size, runs[-1].rows + p.rows)
        else:
            runs.append(p)
    firsts = splitters(runs, shards)
    shard_of = [bisect.bisect_right(firsts, k) for k in range(len(runs))]
    slots, at = [], {}
    for shard, run in zip(shard_of, runs, strict=True):
        slots.append(at.get(shard, 0))
        at[shard] = slots[-1] + run.rows
    starts = [r.start for r in runs]
    cells = [max(1, -(-r.size // CELL_BYTES)) for r in runs]

    def located(df: DataFrame, key: str) -> DataFrame:
        """Adds the run and the cell of it that one task numbers."""
        # generated, not aliased: a join on it must not carry these expressions to its other side
        return df.select("*", F.inline(F.array(let(_position(F.col(key), starts), lambda run: cell_of(F.col(key), run, cells)))))

    before = Window.partitionBy("__run").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = located(keyed, "key").groupBy("__run", "__part").agg(F.count(F.lit(1)).alias("n"))
    bases = counts.select("__run", "__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    # a few bytes for each cell, measured once written
    bases = settle(bases, "shard-bases")
    placed = located(measured, "__key").join(bases, ["__run", "__part"])
    place = F.row_number().over(Window.partitionBy("__run", "__part").orderBy("__key", "doc_id")) - 1
    return placed.withColumn("__place", place + F.col("__base")).select(
        *docs.columns,
        F.get(F.lit(shard_of), F.col("__run")).alias("shard"),
        (F.get(F.lit(slots), F.col("__run")) + F.col("__place")).cast("bigint").alias("slot"),
        "size",
    )


def write_shards(documents: DataFrame, folder: str, shards: int = 8) -> None:
    """Parquet, one folder a shard, rows in slot order inside each file."""
    shard_documents(documents, shards).write.partitionBy("shard").parquet(folder)


def shard_report(documents: DataFrame, shards: int = 8) -> DataFrame:
    """Shard and slot of every document under the law of equal bytes."""
    placed = shard_documents(documents.select("doc_id", "text"), shards)
    return placed.select(
        "doc_id", "size", F.crc32(text_bytes()).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
