"""Collocations: frequent phrases that are rarer in their parts than chance would have it.

1. Shards. A task lays a few megabytes of texts end to end as numbers of their words, with
   a separator between pieces. Over them it builds a bidirectional FM-index: suffixes in
   order of their first ``depth`` words, the words before them (the transform), and the
   same of the reversed sequence. A phrase is an interval in both. Extending it by a word
   narrows the reversed interval by one step of the transform and moves the forward one by
   the number of smaller words met; all intervals of a level are extended at once. An
   interval's width is the phrase's count, the words before and behind it are its left
   and right extensions.
2. Sums. Counts of a phrase are added over all shards.
3. Levels. A phrase can only be frequent if its words, and its pairs of words, are. A
   first pass counts words, a second pairs, a third longer phrases; words and pairs that
   are rare split the sequence of the next. Most phrases are rare and need no text, so the
   second and third pass sum hashes, in packed blocks of hash ranges, and mark those that
   occur often enough in bitmaps of fixed size. The last pass counts by text what is
   marked. Equal hashes and a full bitmap only let more rows pass, they never lose one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.bitmaps import LANES, bitmap, lanes, marked
from scriptorium.llm.common import settle, text_bytes
from scriptorium.llm.repeats import Sums, mixed

DEPTH = 4
LEAST = 30
BEST = 2000
SHARD_BYTES = 4 << 20
BLOCK_HASHES = 1 << 20  # hashes a task packs at a time
HASH_BYTES = 6  # that are sent, besides those that the range tells
TOP_PARTS = 64  # in which a language's best are sought before they meet
BITMAP_BITS = 1 << 26
NO_LANG = "und"
ENDS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + ENDS + b"\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * len(ENDS) + b" ")


def word_hashes(langs: pa.Array, words: pa.Array) -> np.ndarray:
    """64-bit hash of each (language, word)."""

    def hashes(values: pa.Array) -> np.ndarray:
        values = values.cast(pa.large_binary())
        ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
        data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(values) else np.empty(0, np.uint8)
        return Sums(data, 0).of(ends[:-1] - ends[0], ends[1:] - ends[0])

    encoded = langs.dictionary_encode()
    return mixed(hashes(words) + hashes(encoded.dictionary)[encoded.indices.to_numpy()])


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first ^ ((second << np.uint64(17)) | (second >> np.uint64(47))))


def phrase_hashes(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hash of each row of word numbers, from left to right."""
    out = hashes[words[:, 0]]
    for k in range(1, words.shape[1]):
        out = pair_hashes(out, hashes[words[:, k]])
    return out


@dataclass
class Shard:
    """Texts as word numbers from 1, separators 0; a word of two languages has two numbers."""

    ids: np.ndarray
    words: pa.Array  # the first stands for the separator
    langs: pa.Array

    def hashes(self) -> np.ndarray:
        return word_hashes(self.langs, self.words)


def shard_of(rows: list[tuple[str, bytes]]) -> Shard:
    """A shard of (language, text) rows; pieces end at ``.,;:!?`` and line breaks."""
    by_lang: dict[str, list[bytes]] = {}
    for lang, text in rows:
        by_lang.setdefault(lang, []).append(text)
    none = pa.array([""], pa.large_string())
    parts, words, langs, n = [np.zeros(1, np.int32)], [none], [none], 1
    for lang, texts in by_lang.items():
        data = pa.py_buffer(b"\n".join(texts).translate(_PLAIN).replace(b"\n", b" \n "))
        whole = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, data.size], np.int64)), data])
        tokens = pc.split_pattern(whole, " ").flatten().dictionary_encode()
        is_word = pc.invert(pc.is_in(tokens.dictionary, value_set=pa.array(["", "\n"], pa.large_string()))).to_numpy(zero_copy_only=False)
        number = np.where(is_word, n - 1 + np.cumsum(is_word), -1).astype(np.int32)
        number[pc.equal(tokens.dictionary, "\n").to_numpy(zero_copy_only=False)] = 0
        ids = number[tokens.indices.to_numpy()]
        parts += [ids[ids >= 0], np.zeros(1, np.int32)]
        words.append(tokens.dictionary.filter(pa.array(is_word)))
        langs.append(pa.array([lang], pa.large_string()).take(pa.array(np.zeros(int(is_word.sum()), np.int32))))
        n += int(is_word.sum())
    return Shard(np.concatenate(parts), pa.concat_arrays(words), pa.concat_arrays(langs))


@dataclass
class Sequence:
    """Word numbers and separators, and whether a word of the same piece stood before and behind each in the text."""

    ids: np.ndarray
    follows: np.ndarray
    leads: np.ndarray

    @staticmethod
    def of(ids: np.ndarray) -> Sequence:
        inner = ids != 0
        return Sequence(ids, inner & np.roll(inner, 1), inner & np.roll(inner, -1))

    def only(self, known: np.ndarray) -> Sequence:
        """Words that are not known become separators; runs of those are one."""
        ids = np.where(known[self.ids], self.ids, 0)
        kept = np.concatenate([[True], (ids[1:] != 0) | (ids[:-1] != 0)])
        return Sequence(ids[kept], self.follows[kept], self.leads[kept])

    def split(self, passing: np.ndarray) -> Sequence:
        """Separators come between the neighbours that are not passing."""
        at = np.flatnonzero(~passing) + 1
        return Sequence(np.insert(self.ids, at, 0), np.insert(self.follows, at, False), np.insert(self.leads, at, False))


class FMIndex:
    """Interval search over a cyclic sequence of word numbers, for phrases of up to ``depth`` words."""

    def __init__(self, ids: np.ndarray, joined: np.ndarray, depth: int):
        order = self._order(ids, depth)
        self.before = np.roll(ids, 1)[order]  # the transform
        row = np.empty(len(ids), np.int32)
        row[order] = np.arange(len(ids), dtype=np.int32)
        self.step = np.roll(row, 1)[order]  # a row's place after one step to the left
        self.joined = np.concatenate([[0], np.cumsum(joined[order], dtype=np.int32)])

    @staticmethod
    def _order(ids: np.ndarray, depth: int) -> np.ndarray:
        """Suffixes sorted by their first ``depth`` words or more, doubling the length each round."""
        rank, h = ids.astype(np.int64), 1
        order = np.argsort(rank) if depth == 1 else None
        while h < depth:
            key = rank * (int(rank.max()) + 1) + np.roll(rank, -h)
            order, h = np.argsort(key), 2 * h
            if h < depth:
                key = key[order]
                rank[order] = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
        return order

    def extended(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many rows of each interval have a word of their piece before them in the text."""
        return self.joined[high] - self.joined[low]


Level = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
NO_PHRASES: Level = (np.empty((0, 2), np.int32), *(np.empty(0, np.int64),) * 3)


def phrases_of(text: Sequence, n_words: int, depth: int = DEPTH) -> Iterator[Level]:
    """Level by level (word numbers of each phrase, count, left extensions, right extensions)."""
    ids = text.ids
    if not ids.any():
        return
    ahead, back = FMIndex(ids, text.follows, depth), FMIndex(ids[::-1], text.leads[::-1], depth)
    count = np.bincount(ids, minlength=n_words)
    begin = np.cumsum(count) - count
    word = np.flatnonzero(count[1:]) + 1
    count, low, back_low, words = count[word], begin[word], begin[word].copy(), word[:, None].astype(np.int32)
    for level in range(1, depth + 1):
        yield words, count, ahead.extended(low, low + count), back.extended(back_low, back_low + count)
        if level == depth or not len(count):
            return
        # every row of every interval, by interval and the word behind the phrase
        owner = np.repeat(np.arange(len(count)), count)
        first = np.cumsum(count) - count
        place = np.arange(len(owner)) - (first - back_low)[owner]
        key = owner * np.int64(n_words) + back.before[place]
        by = np.argsort(key)
        key, step = key[by], back.step[place[by]]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(heads, len(key)))
        least = np.minimum.reduceat(step, heads)  # the rows of a phrase are neighbours: the least is its interval's first
        parent, following = np.divmod(key[heads], n_words)
        smaller = heads - first[parent]
        real = following != 0
        parent, following = parent[real], following[real].astype(np.int32)
        low, back_low, count = low[parent] + smaller[real], least[real].astype(np.int64), sizes[real]
        words = np.concatenate([words[parent], following[:, None]], axis=1)


ROWS_A_BATCH = 100_000


def _shards(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[Shard]:
    waiting, size = [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            if waiting and size + len(text) > shard_bytes:
                yield shard_of(waiting)
                waiting, size = [], 0
            waiting.append((lang, text))
            size += len(text)
    if waiting:
        yield shard_of(waiting)


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), text_bytes().alias("data"))


def _counted(documents: DataFrame, find: Callable[[Shard], Iterator[Level]], shard_bytes: int) -> DataFrame:
    """(lang, phrase, size, f, lefts, rights) of the phrases that ``find`` gives, summed over all shards."""

    def run(batches):
        for shard in _shards(batches, shard_bytes):
            for found, *counts in find(shard):
                for at in range(0, len(found), ROWS_A_BATCH):
                    some = found[at : at + ROWS_A_BATCH]
                    columns = [shard.words.take(pa.array(some[:, k])) for k in range(some.shape[1])]
                    phrase = columns[0] if len(columns) == 1 else pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string()))
                    yield pa.RecordBatch.from_arrays(
                        [shard.langs.take(pa.array(some[:, 0])).cast(pa.string()), phrase.cast(pa.string()),
                         pa.array(np.full(len(some), len(columns), np.int32)),
                         *(pa.array(c[at : at + ROWS_A_BATCH].astype(np.int64)) for c in counts)],
                        names=["lang", "phrase", "size", "f", "lefts", "rights"],
                    )

    parts = _texts(documents).mapInArrow(run, "lang string, phrase string, size int, f bigint, lefts bigint, rights bigint")
    return parts.groupBy("lang", "phrase", "size").agg(*(F.sum(c).alias(c) for c in ("f", "lefts", "rights")))


def _word_lanes(words: DataFrame, bits: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield lanes(word_hashes(batch.column(0), batch.column(1)), bits)

    return words.select("lang", "phrase").mapInArrow(run, LANES)


def _summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and the sums of their counts."""
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    joined, weights = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(joined)
    joined, weights = joined[order], weights[order]
    heads = np.flatnonzero(np.concatenate([[True], joined[1:] != joined[:-1]]))
    return joined[heads], np.add.reduceat(weights, heads)


def _frequent_lanes(
    documents: DataFrame, find: Callable[[Shard], tuple[np.ndarray, np.ndarray]], least: int, shard_bytes: int, bits: int
) -> DataFrame:
    """Bitmap lanes of the hashes whose counts, as ``find`` gives them for each shard, reach ``least`` together.

    A task sends a row for a range of hashes, with the sorted hashes and counts as bytes;
    a range's rows are added up as they come.
    """
    spark = documents.sparkSession
    ranges = 1 << max(6, int(spark.conf.get("spark.sql.shuffle.partitions")) * 4 - 1).bit_length()
    shift = np.uint64(64 - (ranges.bit_length() - 1))

    def block(hashes: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        summed, weights = _summed(hashes, counts)
        of = (summed >> shift).astype(np.int64)
        heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        cuts = list(zip(heads.tolist(), [*heads[1:].tolist(), len(of)], strict=True))
        sent = np.ascontiguousarray(summed.view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES])  # the lower bytes
        packed = [pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (sent, weights.astype(np.uint32))]
        return pa.RecordBatch.from_arrays([pa.array(of[heads].astype(np.int32)), *packed], names=["range", "hashes", "counts"])

    def pack(batches):
        hashes, counts, n = [], [], 0
        for shard in _shards(batches, shard_bytes):
            some, weights = find(shard)
            hashes.append(some)
            counts.append(weights)
            n += len(some)
            if n >= BLOCK_HASHES:
                yield block(hashes, counts)
                hashes, counts, n = [], [], 0
        if n:
            yield block(hashes, counts)

    def add(batches):
        current, hashes, counts, n = None, [], [], 0

        def result():
            summed, weights = _summed(hashes, counts)
            often = summed[weights >= least]
            return [lanes(often, bits)] if len(often) else []

        for batch in batches:
            for of, some, weights in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if of != current:
                    yield from result()
                    current, hashes, counts, n = of, [], [], 0
                received = np.zeros((len(weights.as_py()) // 4, 8), np.uint8)
                received[:, :HASH_BYTES] = np.frombuffer(some.as_py(), np.uint8).reshape(-1, HASH_BYTES)
                hashes.append(received.view(np.uint64).reshape(-1))
                counts.append(np.frombuffer(weights.as_py(), np.uint32).astype(np.int64))
                n += len(hashes[-1])
                if n >= 4 * BLOCK_HASHES and n > 2 * len(hashes[0]):
                    summed, weights = _summed(hashes, counts)
                    hashes, counts, n = [summed], [weights], len(summed)
        yield from result()

    packed = _texts(documents).mapInArrow(pack, "range int, hashes binary, counts binary")
    return packed.repartition("range").sortWithinPartitions("range").mapInArrow(add, LANES)


def frequent_phrases(
    documents: DataFrame, depth: int = DEPTH, least: int = LEAST, shard_bytes: int = SHARD_BYTES, bits: int = BITMAP_BITS
) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``depth`` words that occur ``least`` times or more, and each language's number of words.

    (lang, phrase, size, f, lefts, rights): occurrences, and how many of them have a word
    of the same piece before and behind. Letters A to Z are lowered; a null lang is
    ``und`` and a null text is empty; repeated rows count each.
    """

    def words(shard: Shard):
        text = Sequence.of(shard.ids)
        counts, lefts, rights = (np.bincount(text.ids[x], minlength=len(shard.words)) for x in (..., text.follows, text.leads))
        found = np.flatnonzero(counts[1:]) + 1
        yield found[:, None], counts[found], lefts[found], rights[found]

    all_words = settle(_counted(documents, words, shard_bytes), "phrases-words")
    totals = all_words.groupBy("lang").agg(F.sum("f").alias("n"))
    often = all_words.where(F.col("f") >= least)
    if depth < 2:
        return often, totals
    word_marks = bitmap(_word_lanes(often, bits), bits)

    def known_words(shard: Shard, hashes: np.ndarray) -> Sequence:
        known = marked(word_marks.value, hashes)
        known[0] = False
        return Sequence.of(shard.ids).only(known)

    def pairs(shard: Shard) -> tuple[np.ndarray, np.ndarray]:
        hashes = shard.hashes()
        *_, (words, counts, _, _) = [NO_PHRASES, *phrases_of(known_words(shard, hashes), len(shard.words), 2)]
        return phrase_hashes(hashes, words), counts

    pair_marks = bitmap(_frequent_lanes(documents, pairs, least, shard_bytes, bits), bits)

    def levels(shard: Shard) -> Iterator[tuple[np.ndarray, Level]]:
        """Hashes of the phrases of each level from two words on, and the level."""
        hashes = shard.hashes()
        text = known_words(shard, hashes)
        first, second = text.ids[:-1], text.ids[1:]
        known = marked(pair_marks.value, pair_hashes(hashes[first], hashes[second]))
        for level in phrases_of(text.split((first == 0) | (second == 0) | known), len(shard.words), depth):
            if level[0].shape[1] > 1:
                yield phrase_hashes(hashes, level[0]), level

    def longer(shard: Shard) -> tuple[np.ndarray, np.ndarray]:
        found = [(h, level[1]) for h, level in levels(shard) if level[0].shape[1] > 2]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))

    long_marks = bitmap(_frequent_lanes(documents, longer, least, shard_bytes, bits), bits) if depth > 2 else None

    def phrases(shard: Shard) -> Iterator[Level]:
        for hashes, level in levels(shard):
            if level[0].shape[1] == 2:
                yield level
            else:
                kept = marked(long_marks.value, hashes)
                yield tuple(x[kept] for x in level)

    several = settle(_counted(documents, phrases, shard_bytes).where(F.col("f") >= least), "phrases-several")
    return often.unionByName(several), totals


def collocations(
    documents: DataFrame, depth: int = DEPTH, least: int = LEAST, best: int = BEST, shard_bytes: int = SHARD_BYTES, bits: int = BITMAP_BITS
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``best`` phrases of 2 to ``depth`` words.

    A phrase scores floor(2000000 a / (l + r)) at the cut where that is lowest, the
    smallest of equals. Phrases inside a longer frequent one that makes up 80 % of them
    are dropped. Order: score, count, then phrase by its bytes. An empty table, or one
    without a phrase that is frequent enough, gives no row.
    """
    known, totals = frequent_phrases(documents, depth, least, shard_bytes, bits)
    known = known.select("lang", "phrase", "size", "f")
    several = known.where("size > 1")
    words = F.split("phrase", " ")
    part = lambda start, length: F.array_join(F.slice(words, start, length), " ")
    cuts = several.select("lang", "phrase", "size", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("*", part(1, F.col("k")).alias("head"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    parts = known.where(F.col("size") < depth)
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    cuts = cuts.withColumn("score", F.expr("(cast(2000000 as decimal(38,0)) * cast(a as decimal(19,0))) div (l + r)"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    at = F.explode(F.sequence(F.lit(1), F.col("size") - F.col("length") + 1))
    inside = several.where("size > 2").select("*", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("length"))
    inside = inside.select("lang", "phrase", "f", "length", at.alias("start")).select(
        "lang", F.array_join(F.slice(words, F.col("start"), F.col("length")), " ").alias("phrase"), "f"
    )
    most = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    whole = scored.join(most, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 5 < F.col("a") * 4))
    order = (F.desc("cut.score"), F.desc("a"), F.asc("phrase"))
    # the best of each part first: a language's last window sees a bounded number of rows
    part_of = F.pmod(F.xxhash64("phrase"), F.lit(TOP_PARTS)).alias("part")
    in_parts = whole.select("*", part_of).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    ranked = in_parts.where(F.col("rank") <= best).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    ranked = ranked.where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select(
        "lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score")
    )
