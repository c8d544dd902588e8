"""Removal of repeated byte strings with per-shard suffix arrays.

A byte goes if it lies in a string of ``length`` bytes that starts anywhere else.

1. Anchors. Every string of ``length`` bytes holds ``length - GRAM + 1`` grams; the
   one with the smallest hash is its anchor. Equal strings have equal anchors at
   equal distances, so only starts whose anchor hash occurs twice can repeat.
   Neighbouring starts share an anchor: a *run* of starts is one row, not each start.
2. Shards. Runs with one anchor hash go to one shard, equal contexts (the bytes that
   a run's strings cover) folded into one with a count. A shard's contexts are laid
   end to end, sorted by Larsson-Sadakane refinement, and compared by Kasai's common
   prefixes: starts with ``length`` bytes in common form a class, and a class with
   two starts, or of a context that occurs twice, repeats.
3. Hot anchors. The contexts of an anchor hash are dealt over several shards if they
   are many, so no task holds an unbounded group. Such a shard also gives one digest
   a class, sorted; the shards' sorted digests are merged by binary search, and a
   class found in two shards repeats.

Only rows of runs are shuffled until the bytes of contexts that can still repeat are
fetched. Matches never cross documents, as runs and contexts end with their text.
Anchors, contexts and merged digests are compared by hashes of 64, 128 and 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import pieces, settle, text_bytes
from scriptorium.llm.suffix_arrays import common_prefixes, repeated_classes, suffix_array

LENGTH = 400
GRAM = 200
SHARD_BYTES = 2 << 20
SHARD_CONTEXTS = 200  # contexts of one anchor hash that one shard takes
PIECE_BYTES = 1 << 20
_NO_ID = -(1 << 63)
_PLACE = np.uint64((1 << 28) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = [mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(k)) for k in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, np.uint64)
        known[0] = 1
        known = _POWERS[base] = np.multiply.accumulate(known)
    return known[:n]


class Sums:
    """Prefix sums that give the hash of any byte range at once."""

    def __init__(self, data: np.ndarray, table: int):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.add.accumulate(_BYTES[table][data] * _powers(_BASE, len(data)), out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * _powers(_INVERSE, len(self.sums))[starts])


def _window_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, from minima of blocks' beginnings and ends."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs_of(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first start, number of starts, anchor hash, two context hashes) of each run."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return tuple(np.empty(0, np.int64) for _ in range(3)) + tuple(np.empty(0, np.uint64) for _ in range(3))
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    begins = ends - np.fromiter(map(len, texts), np.int64, len(texts))
    first, second = Sums(data, 0), Sums(data, 1)
    places = np.arange(len(data) - gram + 1)
    grams = first.of(places, places + gram)
    # the place breaks ties towards the left, so equal strings still agree
    anchors = _window_least((grams & ~_PLACE) | places.astype(np.uint64), length - gram + 1) & _PLACE
    cuts = np.flatnonzero(np.diff(anchors) != 0) + 1
    starts = np.unique(np.concatenate([[0], cuts, begins[begins < len(anchors)]]))
    stops = np.append(starts[1:], len(anchors))
    text = np.searchsorted(ends, starts, side="right")
    stops = np.minimum(stops, ends[text] - length + 1)
    some = stops > starts
    starts, stops, text = starts[some], stops[some], text[some]
    covered = stops + length - 1
    return (
        text, starts - begins[text], stops - starts, grams[anchors[starts].astype(np.int64)],
        first.of(starts, covered), second.of(starts, covered),
    )


def slices(texts: list[bytes], length: int = LENGTH, size: int = PIECE_BYTES) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(text number, offset, bytes) lists of about ``size``; a longer text comes in overlapping slices."""
    for at, part in pieces(texts, size):
        if len(part) > 1 or len(part[0]) <= 2 * size:
            yield list(range(at, at + len(part))), [0] * len(part), part
        else:
            for offset in range(0, max(1, len(part[0]) - length + 1), size):
                yield [at], [offset], [part[0][offset : offset + size + length - 1]]


RUN_SCHEMA = "did bigint, tid bigint, start int, n int, anchor bigint, c1 bigint, c2 bigint"


def text_runs(identified: DataFrame, length: int = LENGTH) -> DataFrame:
    """All runs of all texts; ``identified`` has (did, tid, data)."""

    def run(batches):
        for batch in batches:
            ids, tids = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for number, offset, part in slices(batch.column(2).to_pylist(), length):
                text, start, n, *hashes = runs_of(part, length)
                at, off = np.array(number)[text], np.array(offset)[text]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at]), pa.array(tids[at]), pa.array((start + off).astype(np.int32)), pa.array(n.astype(np.int32)),
                     *(pa.array(h.view(np.int64)) for h in hashes)],
                    names=["did", "tid", "start", "n", "anchor", "c1", "c2"],
                )

    return identified.where(F.octet_length("data") >= length).mapInArrow(run, RUN_SCHEMA)


def _ranges(marks: np.ndarray) -> list[tuple[int, int]]:
    """(first, behind last) of each run of true marks."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def shard_repeats(contexts: list[bytes], starts: list[int], counts: list[int], length: int = LENGTH):
    """For the contexts of a shard: marks of the starts that repeat in it, and each start's class.

    ``starts`` is the number of starts of each context, ``counts`` how often it occurs.
    """
    text = np.frombuffer(b"".join(contexts), np.uint8)
    order, words = suffix_array(text, length)
    classes = repeated_classes(order, common_prefixes(order, words, length), length)
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    n = np.array(starts, np.int64)
    own = np.repeat(np.cumsum(sizes) - sizes - np.cumsum(n) + n, n) + np.arange(n.sum())  # the starts' places in the text
    of = classes[own]
    weight = np.bincount(of, np.repeat(np.array(counts, np.int64), n), minlength=len(text) + 1)
    return weight[of] > 1, of, own, text


FOUND = pa.schema([
    ("anchor", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("first", pa.list_(pa.int32())), ("behind", pa.list_(pa.int32())),
    ("salt", pa.int32()), ("open", pa.list_(pa.int32())), ("d1", pa.list_(pa.int64())), ("d2", pa.list_(pa.int64())),
])
FOUND_SQL = (
    "anchor bigint, c1 bigint, c2 bigint, first array<int>, behind array<int>, salt int, "
    "open array<int>, d1 array<bigint>, d2 array<bigint>"
)


def search_shards(contexts: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Repeats of each context within its shard; of hot anchors also the digests of unresolved starts.

    ``contexts`` has (anchor, salt, shards, c1, c2, n, times, bytes), partitioned and
    sorted by anchor and salt. A shard is a run of whole (anchor, salt) groups of
    about ``shard_bytes``.
    """

    def shard(rows: list[tuple]) -> pa.RecordBatch:
        anchors, salts, shards, c1, c2, n, times, data = zip(*rows, strict=True)
        marks, _, own, text = shard_repeats(list(data), list(n), list(times), length)
        sums = [Sums(text, 0), Sums(text, 1)] if max(shards) > 1 else None
        out, at = [], 0
        for k in range(len(rows)):
            mine = marks[at : at + n[k]]
            ranges = _ranges(mine)
            row = {"anchor": anchors[k], "c1": c1[k], "c2": c2[k], "first": [a for a, _ in ranges], "behind": [b for _, b in ranges],
                   "salt": salts[k], "open": [], "d1": [], "d2": []}
            if shards[k] > 1:  # the digest of every start: others may hold it too
                places = own[at : at + n[k]]
                row["open"] = list(range(n[k]))
                row["d1"], row["d2"] = (s.of(places, places + length).view(np.int64).tolist() for s in sums)
            at += n[k]
            if ranges or row["open"]:
                out.append(row)
        return pa.RecordBatch.from_pylist(out, schema=FOUND)

    def run(batches):
        waiting, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= shard_bytes and row[:2] != waiting[-1][:2]:
                    yield shard(waiting)
                    waiting, size = [], 0
                waiting.append(row)
                size += len(row[-1])
        if waiting:
            yield shard(waiting)

    return contexts.select("anchor", "salt", "shards", "c1", "c2", "n", "times", "bytes").mapInArrow(run, FOUND_SQL)


def shared_between(salts: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Marks of the digests that another shard holds too.

    Each shard's digests are sorted; a shard is merged into those before it by binary
    search, and what it meets there is marked on both sides.
    """
    marks = np.zeros(len(digests), bool)
    merged, places = digests[:0], np.empty(0, np.int64)
    for salt in np.unique(salts):
        mine = np.flatnonzero(salts == salt)
        mine = mine[np.argsort(digests[mine], kind="stable")]
        values = digests[mine]
        low, high = (np.searchsorted(merged, values, side=s) for s in ("left", "right"))
        met = high > low
        marks[mine[met]] = True
        met_values = np.unique(values[met])
        low, high = (np.searchsorted(merged, met_values, side=s) for s in ("left", "right"))
        for a, b in zip(low.tolist(), high.tolist(), strict=True):
            marks[places[a:b]] = True
        at = np.searchsorted(merged, values)
        merged, places = np.insert(merged, at, values), np.insert(places, at, mine)
    return marks


def merge_shards(found: DataFrame) -> DataFrame:
    """(anchor, c1, c2, at): starts of hot anchors' contexts that repeat in another shard."""
    each = found.where("size(open) > 0").select("anchor", "c1", "c2", "salt", F.explode(F.arrays_zip("open", "d1", "d2")).alias("x"))
    each = each.select("anchor", "c1", "c2", "salt", F.col("x.open").alias("at"), F.col("x.d1").alias("d1"), F.col("x.d2").alias("d2"))
    # a shard speaks once for a class, so a common string is a row a shard
    classes = each.select("d1", "d2", "salt").distinct()
    dealt = classes.repartition("d1", "d2").sortWithinPartitions("d1", "d2")
    digest = np.dtype([("d1", np.int64), ("d2", np.int64)])

    def run(batches):
        kept: list[np.ndarray] = []
        for batch in batches:
            kept.append(np.array(list(zip(*(c.to_pylist() for c in batch.columns), strict=True)), np.int64).reshape(-1, 3))
            if sum(map(len, kept)) < 500_000:
                continue
            rows = np.concatenate(kept)
            same = (rows[:, :2] == rows[-1, :2]).all(axis=1)  # the last digest may go on in the next batch
            yield _batch(rows[~same])
            kept = [rows[same]]
        if kept:
            yield _batch(np.concatenate(kept))

    def _batch(rows: np.ndarray) -> pa.RecordBatch:
        values = np.zeros(len(rows), digest)
        values["d1"], values["d2"] = rows[:, 0], rows[:, 1]
        _, numbers = np.unique(values, return_inverse=True)  # order as numbers: structs can't be searched
        shared = np.unique(values[shared_between(rows[:, 2], numbers)])
        return pa.RecordBatch.from_arrays([pa.array(shared["d1"]), pa.array(shared["d2"])], names=["d1", "d2"])

    shared = dealt.mapInArrow(run, "d1 bigint, d2 bigint")
    return each.join(shared, ["d1", "d2"]).select("anchor", "c1", "c2", "at")


def repeated_spans(documents: DataFrame, length: int = LENGTH, shard_contexts: int = SHARD_CONTEXTS) -> tuple[DataFrame, DataFrame]:
    """The identified documents (doc_id, did, tid, data) and their covered stretches (did, tid, start, behind).

    A null doc_id is treated as an id of its own; rows alike in id and text are one
    text that occurs as often as it has rows.
    """
    data = text_bytes()
    identified = documents.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("did"), F.xxhash64(data).alias("tid"), data.alias("data")
    )
    scanned = text_runs(identified.select("did", "tid", "data"), length)
    # Written first: a join of two plain exchanges is one that Spark can split where an anchor is hot.
    often = settle(scanned.groupBy("anchor").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("anchor"), "repeats-anchors")
    runs = settle(scanned.join(often, "anchor", "left_semi"), "repeats-runs")
    contexts = settle(
        runs.groupBy("anchor", "c1", "c2").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("did", "tid", "start", "n")).alias("at")),
        "repeats-contexts",
    )
    groups = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("contexts"))
    shards = F.ceil(F.col("contexts") / shard_contexts).cast("int")
    # contexts alone under their anchor repeat as a whole, as their anchor occurs twice
    several = settle(groups.where("contexts > 1").select("anchor", shards.alias("shards")), "repeats-groups")
    wanted = contexts.join(several, "anchor").select(
        "anchor", F.pmod(F.xxhash64("c1", "c2"), F.col("shards")).cast("int").alias("salt"), "shards", "c1", "c2", "times", "at.*"
    )
    cut = F.struct("anchor", "salt", "shards", "c1", "c2", "n", "times", "start")
    by_text = wanted.groupBy("did", "tid").agg(F.collect_list(cut).alias("cuts"))
    one_each = identified.select("did", "tid", "data").join(by_text, ["did", "tid"])
    fetched = one_each.select("did", "tid", "data", F.explode("cuts").alias("x")).select(
        "x.*", F.substring(F.col("data"), F.col("x.start") + 1, F.col("x.n") + (length - 1)).alias("bytes")
    ).dropDuplicates(["anchor", "c1", "c2"])
    dealt = fetched.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
    found = settle(search_shards(dealt, length), "repeats-found")
    inner = found.select("anchor", "c1", "c2", F.explode(F.arrays_zip("first", "behind")).alias("x"))
    inner = inner.select("anchor", "c1", "c2", F.col("x.first").alias("first"), F.col("x.behind").alias("behind"))
    merged = merge_shards(found).select("anchor", "c1", "c2", F.col("at").alias("first"), (F.col("at") + 1).alias("behind"))
    whole = contexts.where("times > 1").select("anchor", "c1", "c2", F.lit(0).alias("first"), F.col("at.n").alias("behind"))
    verdicts = inner.unionByName(merged).unionByName(whole)
    spans = runs.join(verdicts, ["anchor", "c1", "c2"]).select(
        "did", "tid", (F.col("start") + F.col("first")).alias("start"), (F.col("start") + F.col("behind") + (length - 1)).alias("behind")
    )
    return identified, spans


def cover(n_bytes: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of the spans, as maximal stretches."""
    out: list[tuple[int, int]] = []
    for start, behind in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], behind))
        else:
            out.append((start, behind))
    return [(a, min(b, n_bytes)) for a, b in out]


def without_repeats(documents: DataFrame, length: int = LENGTH, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """(doc_id, n_bytes, removed array<struct<start, behind>>, kept binary) of every document row.

    ``removed`` are the maximal stretches that repeat, judged on the input; ``kept``
    is what is left, joined. Texts under ``length`` bytes, empty and null ones keep
    all their bytes.
    """
    identified, spans = repeated_spans(documents, length, shard_contexts)
    lists = spans.distinct().groupBy("did", "tid").agg(F.collect_list(F.struct("start", "behind")).alias("spans"))
    joined = identified.join(lists, ["did", "tid"], "left").select("doc_id", "data", "spans")
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            sizes, removed, kept = [], [], []
            for data, found in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = data.as_py()
                gone = cover(len(text), [(x["start"], x["behind"]) for x in found or ()])
                edges = [0, *(e for pair in gone for e in pair), len(text)]
                sizes.append(len(text))
                removed.append([{"start": a, "behind": b} for a, b in gone])
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            stretch = pa.struct([("start", pa.int32()), ("behind", pa.int32())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(stretch)), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "removed", "kept"],
            )

    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, removed array<struct<start: int, behind: int>>, kept binary")


def repeat_report(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """Counts of removed bytes and stretches, and the digest of the rest, one row per document."""
    cut = without_repeats(documents, length)
    gone = F.aggregate("removed", F.lit(0).cast("bigint"), lambda a, x: a + x["behind"] - x["start"])
    return cut.select(
        "doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


