"""Benchmark decontamination with a broadcast hash set of test n-grams.

The benchmark's windows are distinct word sequences, shared out by a hash of the window
into blocks of about ``BLOCK_WINDOWS`` windows or ``BLOCK_BYTES``, whichever asks for more blocks. One block at a time is
sent to the tasks as a sorted array of hashes and the windows' text, so what a
task holds has a bound whatever the benchmark's size; a benchmark over the bound
costs further passes over the documents, not memory. A task hashes every token
window of its documents with prefix sums over whole Arrow batches, looks the
hashes up, and compares the words of each hit, so the result does not depend on
the hash.

Documents with the same representatives have the same items: those are gathered once
for each set of representatives, not once a document, and the report joins their count
and digest alone. Dropping documents and cutting spans need no items.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import pieces, settle, slices, text_bytes

WINDOW_WORDS = 10
BLOCK_WINDOWS = 500_000
PIECE_BYTES = 1 << 20  # of text cut into words at once, which takes some fifty times as much memory
BLOCK_BYTES = 128 << 20  # of windows and representatives: words have no length limit
_B = np.uint64(0x9E3779B97F4A7C15)  # odd: it has an inverse modulo 2^64
_B_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_W = np.uint64(0xC2B2AE3D27D4EB4F)
_W_INVERSE = np.uint64(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))

# A word is a run of digits, letters and everything outside ASCII. In UTF-8 the
# latter are the bytes from 128 on, so words can be cut on bytes.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base, inverse) -> np.ndarray:
    """Polynomial hash of each values[start:end], independent of where it lies."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.add.accumulate((values + np.uint64(1)) * _powers(base, n), out=sums[1:])
    return (sums[ends] - sums[starts]) * _powers(inverse, n + 1)[starts]


class Words:
    """Words of many texts at once: ``data`` are the lower-cased bytes, ``doc`` the text of each word."""

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        # a blank after each text keeps words from running over its end
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self.data = _LOWER[raw]
        inside = np.zeros(len(raw) + 1, np.int8)
        inside[1:] = _IS_WORD[self.data]
        steps = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
        if len(self.ends) < len(self.starts):
            self.ends = np.append(self.ends, len(raw))
        self.text_ends = np.cumsum(sizes + 1)
        self.doc = np.searchsorted(self.text_ends, self.starts, side="right")
        self.hashes = _mixed(_range_hashes(self.data.astype(np.uint64), self.starts, self.ends, _B, _B_INVERSE))

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each run of ``length`` words inside one text."""
        n = len(self.starts) - length + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        first = np.arange(n)
        first = first[self.doc[first] == self.doc[first + length - 1]]
        return first, _range_hashes(self.hashes, first, first + length, _W, _W_INVERSE)

    def joined(self, first: int, length: int) -> bytes:
        """The words of a window, joined by single blanks."""
        return b" ".join(
            self.data[a:b].tobytes()
            for a, b in zip(self.starts[first : first + length], self.ends[first : first + length], strict=True)
        )


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """(window binary, n_words int, item string), distinct: the windows and the items that have them.

    An item of fewer words than ``window``, but not none, is one window. Rows
    without words, null texts included, have no window. A null item_id is the
    item named ``null``; rows that repeat an item_id are one item.
    """

    def run(batches):
        for batch in slices(batches):
            ids, out, lengths, names = batch.column(0).to_pylist(), [], [], []
            for at, part in pieces(batch.column(1).to_pylist(), PIECE_BYTES):
                words = Words(part)
                counts = np.bincount(words.doc, minlength=len(part))
                ends = np.cumsum(counts)
                for k, n in enumerate(counts):
                    size = min(window, int(n))
                    for first in range(ends[k] - n, ends[k] - size + 1) if n else ():
                        out.append(words.joined(first, size))
                        lengths.append(size)
                        names.append(ids[at + k])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out, pa.binary()), pa.array(lengths, pa.int32()), pa.array(names, pa.string())],
                names=["window", "n_words", "item"],
            )

    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), text_bytes().alias("data"))
    return named.mapInArrow(run, "window binary, n_words int, item string").distinct()


def represented(pairs: DataFrame) -> DataFrame:
    """(window, n_words, rep): ``rep`` is the smallest window with the same items.

    Neighbouring windows mostly share their items, so a document's items follow
    from a few representatives. Item sets are compared by count and two sums of
    item hashes, pre-aggregated, so that a window of very many items needs no list.
    """
    sets = pairs.groupBy("window", "n_words").agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("item")).alias("x"),
        F.sum(F.xxhash64(F.lit("item"), "item").cast("decimal(20,0)")).alias("y"),
    )
    reps = sets.groupBy("n", "x", "y").agg(F.min("window").alias("rep"))
    return sets.join(reps, ["n", "x", "y"]).select("window", "n_words", "rep")


class Block:
    """A bounded share of the windows, ready for lookups."""

    def __init__(self, rows: list):
        self.by_length: dict[int, tuple[np.ndarray, dict[int, list[int]]]] = {}
        self.windows = [bytes(r.window) for r in rows]
        self.reps = [bytes(r.rep) for r in rows]
        lengths = np.array([r.n_words for r in rows], np.int64)
        for length in sorted(set(lengths.tolist())):
            of = np.flatnonzero(lengths == length)
            words = Words([self.windows[i] for i in of])
            first, hashes = words.windows(length)
            meant: dict[int, list[int]] = {}
            for h, text in zip(hashes.tolist(), words.doc[first].tolist(), strict=True):
                meant.setdefault(h, []).append(int(of[text]))
            self.by_length[length] = (np.sort(np.array(list(meant), np.uint64)), meant)

    def hits(self, words: Words) -> Iterator[tuple[int, int, int]]:
        """(first word, length, window index) of each verified occurrence."""
        for length, (known, meant) in self.by_length.items():
            first, hashes = words.windows(length)
            if not len(first):
                continue
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            for k in np.flatnonzero(known[at] == hashes).tolist():
                text = words.joined(int(first[k]), length)
                for window in meant[int(hashes[k])]:
                    if self.windows[window] == text:
                        yield int(first[k]), length, window


def _scan(documents: DataFrame, block) -> DataFrame:
    """(doc_id, key, n_words, hits array<int>, reps array<binary>) of every document under one block."""

    def run(batches):
        held = block.value
        for batch in slices(batches):
            texts = batch.column(2).to_pylist()
            counts, hits, found = np.zeros(len(texts), np.int64), [[] for _ in texts], [[] for _ in texts]
            for at, part in pieces(texts, PIECE_BYTES):
                words = Words(part)
                n = np.bincount(words.doc, minlength=len(part))
                counts[at : at + len(part)] = n
                base = np.cumsum(n) - n
                hit, seen = np.zeros(len(words.starts), bool), set()
                for first, length, window in held.hits(words):
                    hit[first : first + length] = True
                    seen.add((int(words.doc[first]), held.reps[window]))
                for k in np.flatnonzero(hit).tolist():
                    doc = int(words.doc[k])
                    hits[at + doc].append(int(k - base[doc]))
                for doc, rep in sorted(seen):
                    found[at + doc].append(rep)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts), pa.array(hits, pa.list_(pa.int32())),
                 pa.array(found, pa.list_(pa.binary()))],
                names=["doc_id", "key", "n_words", "hits", "reps"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.mapInArrow(
        run, f"doc_id {kind}, key string, n_words bigint, hits array<int>, reps array<binary>"
    )


def _scanned(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, block_windows: int = BLOCK_WINDOWS, block_bytes: int = BLOCK_BYTES
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n_words, hits, set, reps) of each document row, and the windows' items.

    ``set`` is a digest of the representatives; null where there are none.
    """
    spark = documents.sparkSession
    pairs = settle(benchmark_windows(benchmark, window), "decontaminate-pairs")
    windows = settle(represented(pairs), "decontaminate-windows")
    size = windows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("window") + F.octet_length("rep")).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // block_windows), -(-(size["bytes"] or 0) // block_bytes))
    numbered = windows.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)))
    # A row is told by its id and text, so that rows with equal ids stay apart.
    keyed = documents.select("doc_id", F.sha2(text_bytes(), 256).alias("key"), text_bytes().alias("data"))
    scans = []
    for b in range(blocks):  # one after the other: driver and tasks hold one block at a time
        rows = numbered.where(F.col("block") == b).select("window", "n_words", "rep").collect()
        held = spark.sparkContext.broadcast(Block(rows))
        scans.append(settle(_scan(keyed, held), "decontaminate-hits"))
        held.destroy()
    if blocks == 1:
        scanned = scans[0]
    else:
        whole = scans[0].select("doc_id", "key", "n_words")
        later = [s.where("size(reps) > 0").select("doc_id", "key", "hits", "reps") for s in scans]
        merged = reduce(DataFrame.unionByName, later).distinct().groupBy("doc_id", "key").agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
            F.flatten(F.collect_list("reps")).alias("reps"),
        )
        a, b = whole.alias("a"), merged.alias("b")
        same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key"))
        scanned = a.join(b, same, "left").select("a.doc_id", "a.key", "n_words", "hits", "reps")
        scanned = settle(scanned, "decontaminate-merged")
    hits = F.coalesce("hits", F.array().cast("array<int>")).alias("hits")
    listed = F.array_join(F.transform(F.array_sort(F.array_distinct("reps")), F.hex), ",")
    known = F.when(F.size("reps") > 0, F.sha2(listed, 256)).alias("set")
    return scanned.select("doc_id", "key", "n_words", hits, known, "reps"), pairs


def _item_sets(scanned: DataFrame, pairs: DataFrame) -> DataFrame:
    """(set, items): the sorted items of each set of representatives."""
    sets = scanned.where("set is not null").select("set", "reps").dropDuplicates(["set"])
    return (
        sets.select("set", F.explode("reps").alias("window"))
        .join(pairs.select("window", "item"), "window")
        .groupBy("set")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )


def _with_sets(scanned: DataFrame, sets: DataFrame) -> DataFrame:
    """Each row with what its set has. Rows without a set, the most by far, enter no shuffle."""
    hit = scanned.where("set is not null").join(sets, "set", "left")
    return hit.unionByName(scanned.where("set is null"), allowMissingColumns=True)


def find_contamination(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, block_windows: int = BLOCK_WINDOWS, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, hits, contaminated), one row per document row.

    ``hits`` are the positions of hit words, ascending; ``items`` the ids with an
    occurring window, as sorted strings. Null and wordless texts have no words and
    no hits. An empty benchmark hits nothing.
    """
    scanned, pairs = _scanned(documents, benchmark, window, block_windows, block_bytes)
    found = F.coalesce("items", F.array().cast("array<string>"))
    return _with_sets(scanned, _item_sets(scanned, pairs)).select(
        "doc_id", "key", "n_words", F.size("hits").cast("bigint").alias("n_hit"),
        F.size(found).cast("bigint").alias("n_items"), found.alias("items"), "hits", (F.size("hits") > 0).alias("contaminated"),
    )


def contamination_report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Counts and a digest of the items, one row per document."""
    scanned, pairs = _scanned(documents, benchmark)
    sets = _item_sets(scanned, pairs).select(
        "set", F.size("items").cast("bigint").alias("n"), F.sha2(F.concat_ws(",", "items"), 256).alias("digest")
    )
    return _with_sets(scanned, sets).select(
        "doc_id", "n_words", F.size("hits").cast("bigint").alias("n_hit"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n_items"),
        F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without a hit word; every column stays."""
    bad = _scanned(documents, benchmark)[0].where("size(hits) > 0").select(
        F.col("doc_id").alias("__bad_id"), F.col("key").alias("__bad_key")
    ).distinct()
    same = documents["doc_id"].eqNullSafe(bad["__bad_id"]) & (F.sha2(text_bytes(), 256) == bad["__bad_key"])
    return documents.join(bad, same, "left_anti")


def remove_spans(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All rows, with each run of hit words cut from its text, ends of the run included.

    Blanks and marks around a run stay. Null stays null.
    """
    found = _scanned(documents, benchmark)[0].where("size(hits) > 0").select(
        F.col("doc_id").alias("__bad_id"), F.col("key").alias("__bad_key"), F.col("hits").alias("__hits")
    ).dropDuplicates(["__bad_id", "__bad_key"])
    same = documents["doc_id"].eqNullSafe(found["__bad_id"]) & (F.sha2(text_bytes(), 256) == found["__bad_key"])
    joined = documents.join(found, same, "left").drop("__bad_id", "__bad_key")

    @F.pandas_udf("string")
    def cut(texts, hits):
        import pandas as pd

        out = []
        for text, at in zip(texts, hits, strict=True):
            if at is None or not len(at):
                out.append(text)
                continue
            data, words = text.encode(), Words([text.encode()])
            kept, end = [], 0
            for run in np.split(np.asarray(at), np.flatnonzero(np.diff(at) > 1) + 1):
                kept.append(data[end : words.starts[run[0]]])
                end = int(words.ends[run[-1]])
            out.append((b"".join(kept) + data[end:]).decode())
        return pd.Series(out, dtype=object)

    return joined.withColumn("text", cut("text", "__hits")).drop("__hits")
