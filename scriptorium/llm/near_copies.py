"""All pairs of texts with a Jaccard similarity of 0.8 or more over five-word shingles.

A prefix-filtered set join. Put both texts' shingles in one common order: two sets
of n and m with a similarity of s or more share one among the first n - ceil(s n) + 1
of the one and the first m - ceil(s m) + 1 of the other. Any order will do; shingles
that a sample finds often come last, so common lines stay out of the prefixes. Texts
of equal words are folded to one key first.

SimHash proposes first: fingerprints over the same shingles, within the operator's two bits
by its covering tables. Two bits are far narrower than 0.8, so the join finds the rest.

Texts that share a prefix shingle form a bucket; of buckets with the same members one is
enough, that of the first shingle in the order. A shingle's place bounds the overlap: if it is
the first that two texts share, they share no more than either has from there on. So a text
stays in a bucket only if its place leaves enough for the smallest member, and a pair needs
that on both sides. Texts of one origin that were changed too much to be similar have their
rare shingles first, and leave the buckets of those they have in common. Buckets are not paired in full: every text is first compared with two centers of
its largest bucket, and so is every member of a bucket that this leaves in several
components, with ten centers more if need be, which joins the members of a group
of near copies; then only members of different components are paired, those outside of
a bucket's largest component with all others. Left out are pairs already connected, so
the components are those of all pairs. Candidates pass an upper bound of the overlap by
bitmaps of two bits a shingle or more, and the rest is verified on whole sets (of 64-bit hashes).

Texts are told apart by a 64-bit hash of their words. A second one is compared for every
text, and if two texts ever agree in the first alone, all begins anew with other hashes.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.bitmaps import bitmap, column_lanes, marked
from scriptorium.llm.common import settle, slices, text_bytes
from scriptorium.llm.simhash import components, links, majority
from scriptorium.session import new_path, run_folder

WORDS = 5
SEED = 42
NUMER, DENOM = 4, 5  # a similarity of 4/5
BITMAP_LONGS = 16  # of a bitmap at least: it grows with its set, as a full one tells nothing
CENTERS = (2, 12)  # ranks of the centers tried first, and of those tried where that was not enough
SAMPLE = 16  # one text of so many tells which shingles are common; it orders, and decides no pair
COMMON = 500_000  # so many are ordered by their frequency, the others by their hash


def shingles_of(data: bytes, width: int = WORDS, seed: int = SEED) -> tuple[int, np.ndarray]:
    """Hash of the words, and the sorted distinct shingle hashes; a short text is one shingle."""
    words = data.lower().split()
    key = int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), seed)).astype(np.int64))
    if not words:
        return key, np.zeros(0, np.int64)
    if len(words) < width:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(itertools.islice(words, k, None) for k in range(width)), strict=False))
    return key, np.unique(np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), np.uint64).view(np.int64))


def prefix_of(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 shingles, rare ones first and then by hash."""
    n = len(shingles)
    if not n:
        return shingles
    often = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        often = np.where(common[at] == shingles, counts[at], 0)
    return shingles[np.lexsort((shingles, often))[: n - -(-NUMER * n // DENOM) + 1]]


def bitmap_of(shingles: np.ndarray) -> np.ndarray:
    """A bit for each shingle, in a power of two of at least two bits a shingle."""
    longs = BITMAP_LONGS
    while longs * 64 < 2 * len(shingles):
        longs *= 2
    bits = np.zeros(longs * 64, np.uint8)
    bits[(shingles.view(np.uint64) % np.uint64(len(bits))).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view("<i8")


def _marked(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.xxhash64("text").alias("mark"), text_bytes().alias("data"))


def _sets(texts: DataFrame, seed: int, wanted: Broadcast | None = None) -> DataFrame:
    """(key, shingles) of each distinct text of a task's rows; of ``wanted``, if given, only texts whose mark has its bit set.

    So the texts stay where they are: only sets travel.
    """

    def run(batches):
        seen: set[int] = set()
        for batch in slices(batches):
            found, values = {}, batch.column(0)
            if wanted:
                hits = marked(wanted.value, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
                values = values.filter(pa.array(hits))
            for value in values:
                key, shingles = shingles_of(value.as_py(), seed=seed)
                if key not in seen:
                    seen.add(key)
                    found[key] = shingles
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64()))], names=["key", "shingles"]
                )

    return texts.select("data", "mark").mapInArrow(run, "key bigint, shingles array<bigint>")


def common_shingles(documents: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the most frequent shingles of a sample, sorted by hash."""
    some = _marked(documents).where(F.pmod("mark", F.lit(sample)) == 0)
    counted = _sets(some, seed).select(F.explode("shingles").alias("h")).groupBy("h").count().where("count > 1")
    found = counted.orderBy(F.desc("count"), "h").limit(COMMON).toArrow()
    hashes, counts = (found.column(k).to_numpy().astype(np.int64) for k in (0, 1))
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def _rows(documents: DataFrame, seed: int) -> DataFrame:
    """(doc_id, mark, key, proof, n, bits, print) of each row; a text met before in the task has no bits and no print.

    ``proof`` is a second hash of the words.
    """

    def run(batches):
        seen: set[int] = set()
        for batch in slices(batches):
            keys, proofs, sizes, bits, prints = [], [], [], [], []
            for value in batch.column(2):
                data = value.as_py()
                key, shingles = shingles_of(data, seed=seed)
                proofs.append(int(np.uint64(xxhash.xxh64_intdigest(b" ".join(data.lower().split()), ~seed & 0xFFFF)).astype(np.int64)))
                keys.append(key)
                sizes.append(len(shingles))
                bits.append(None if key in seen else bitmap_of(shingles))
                prints.append(None if key in seen or not len(shingles) else int(np.uint64(majority(shingles.view(np.uint64))).astype(np.int64)))
                seen.add(key)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.int64()), pa.array(proofs, pa.int64()), pa.array(sizes, pa.int32()),
                 pa.array(bits, pa.list_(pa.int64())), pa.array(prints, pa.int64())],
                names=["doc_id", "mark", "key", "proof", "n", "bits", "print"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return _marked(documents).mapInArrow(run, f"doc_id {kind}, mark bigint, key bigint, proof bigint, n int, bits array<bigint>, print bigint")


def _prefixes(documents: DataFrame, common: np.ndarray, counts: np.ndarray, seed: int, wanted: Broadcast | None = None) -> DataFrame:
    """(h, key, p) of each prefix shingle of each distinct text of a task's rows; read anew from the texts, not stored.

    ``p`` is the shingle's place among those of its text. Of ``wanted``, if given, only shingles whose bit is set.
    """

    def run(batches):
        seen: set[int] = set()
        for batch in slices(batches):
            keys, prefixes, places = [], [], []
            for value in batch.column(0):
                key, shingles = shingles_of(value.as_py(), seed=seed)
                if key not in seen:
                    seen.add(key)
                    found = prefix_of(shingles, common, counts)
                    at = np.flatnonzero(marked(wanted.value, found.view(np.uint64))) if wanted else np.arange(len(found))
                    prefixes.append(found[at])
                    places.append(at.astype(np.int32))
                    keys.append(np.full(len(at), key, np.int64))
            if keys:
                columns = [pa.array(np.concatenate(c)) for c in (prefixes, keys, places)]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "key", "p"])

    return documents.select(text_bytes().alias("data")).mapInArrow(run, "h bigint, key bigint, p int")


def _enough(overlap: Column, n: Column, m: Column) -> Column:
    return overlap * (NUMER + DENOM) >= (n + m) * NUMER


def _sizes_fit(n: Column, m: Column) -> Column:
    return F.least(n, m) * DENOM >= F.greatest(n, m) * NUMER


def _alone(x: Column, y: Column) -> Column:
    """Bits that only ``x`` has. A bitmap twice as long as the other is folded to its length.

    Sets of sizes that fit differ by less than two, so bitmaps differ by no more.
    """

    def folded(bits: Column, longs: Column) -> Column:
        halves = F.slice(bits, F.lit(1), longs), F.slice(bits, longs + 1, longs)
        return F.when(F.size(bits) > longs, F.zip_with(*halves, lambda p, q: p.bitwiseOR(q))).otherwise(bits)

    longs = F.least(F.size(x), F.size(y))
    only = F.zip_with(folded(x, longs), folded(y, longs), lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q))))
    return F.aggregate(only, F.lit(0), lambda s, k: s + k)


def _bits_fit(n: Column, x: Column, m: Column, y: Column) -> Column:
    """Whether bitmaps leave enough in common: a bit that only one side has stands for at least one shingle that only it has."""
    return _enough(F.least(n - _alone(x, y), m - _alone(y, x)), n, m)


def _verified(pairs: DataFrame, rows: DataFrame, documents: DataFrame, name: str, seed: int) -> DataFrame:
    """The (a, b) among ``pairs``, of sizes that fit, that are similar enough."""
    pairs = settle(pairs, f"near-pairs-{name}")
    paired = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    known = rows.where("bits is not null").select("key", "n", "bits").join(paired, "key", "left_semi").dropDuplicates(["key"])
    left = known.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
    right = known.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
    likely = settle(
        pairs.join(left, "a").join(right, "b").where(_bits_fit(F.col("na"), F.col("bits_a"), F.col("nb"), F.col("bits_b"))).select("a", "b"),
        f"near-likely-{name}",
    )
    wanted = likely.select(F.col("a").alias("key")).union(likely.select("b")).distinct()
    marks = rows.join(wanted, "key", "left_semi").groupBy("key").agg(F.min("mark").alias("mark")).select("mark").distinct()
    near = bitmap(column_lanes(marks, "mark"))
    sets = _sets(_marked(documents), seed, near).join(wanted, "key", "left_semi").dropDuplicates(["key"])
    sets = settle(sets, f"near-sets-{name}")
    near.destroy()
    left, right = (sets.select(F.col("key").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    overlap = F.size(F.array_intersect("set_a", "set_b"))
    return likely.join(left, "a").join(right, "b").where(_enough(overlap, F.size("set_a"), F.size("set_b"))).select("a", "b")


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _buckets(documents: DataFrame, common: np.ndarray, counts: np.ndarray, seed: int) -> DataFrame:
    """(h, key, p) of the shingles that several texts share, one shingle for each set of members: the first in the order.

    The texts are read twice: first to learn which shingles are shared, then for the
    members of those alone, as most shingles are not.
    """
    first = _prefixes(documents, common, counts, seed).repartition("h").distinct()
    seal = [F.bit_xor(F.xxhash64("key", F.lit(k))).alias(f"s{k}") for k in (1, 2)]  # of the members, whatever their order
    sealed = first.groupBy("h").agg(
        F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.min_by("p", "key").alias("p"), F.max("key").alias("high"), *seal
    )
    chosen = settle(sealed.where("n > 1").groupBy("n", "low", "high", "s1", "s2").agg(F.min_by("h", "p").alias("h")).select("h"), "near-shared")
    members = _prefixes(documents, common, counts, seed, bitmap(column_lanes(chosen, "h"))).distinct()
    return members.join(chosen, "h", "left_semi")


def _proposed(rows: DataFrame) -> DataFrame:
    """(a, b) of keys whose fingerprints SimHash ties, and whose sizes fit; each is tied to one other of its fingerprint."""
    known = rows.where("print is not null").select("key", "n", "print").distinct()
    firsts = known.groupBy("print").agg(F.min(F.struct("key", "n")).alias("f")).select("print", F.col("f.key").alias("y"), F.col("f.n").alias("m"))
    firsts = settle(firsts, "near-prints")
    within = known.join(firsts, "print").where("key <> y").select(F.col("key").alias("x"), "n", "y", "m")
    tied = links(firsts.select(F.col("print").alias("fingerprint")))
    ends = (firsts.select(F.col("print").alias(p), F.col("y").alias(k), F.col("m").alias(c)) for p, k, c in (("fingerprint", "x", "n"), ("center", "y", "m")))
    across = tied.join(next(ends), "fingerprint").join(next(ends), "center").select("x", "n", "y", "m")
    return _pairs(within.unionByName(across).where(_sizes_fit(F.col("n"), F.col("m"))))


def similar_texts(documents: DataFrame, rows: DataFrame, common: np.ndarray, counts: np.ndarray, seed: int = SEED) -> DataFrame:
    """(node, root) of each key that is similar enough to another, over all such pairs."""
    sizes = rows.where("bits is not null").select("key", "n").distinct()
    buckets = settle(_buckets(documents, common, counts, seed), "near-buckets")
    wide = settle(buckets.join(sizes, "key"), "near-wide")
    smallest = wide.groupBy("h").agg(F.min("n").alias("m"))
    fits = _enough(F.col("n") - F.col("p"), F.col("n"), F.col("m"))
    members = settle(wide.join(smallest, "h").where(fits).select("h", "key", "n", "p"), "near-members")

    def centers(ranks: range, known: DataFrame, compared: DataFrame | None = None) -> DataFrame:
        """Pairs of members (or of those ``compared``) with their bucket's centers, where those are of different components."""
        ranked = (F.min(F.struct(F.xxhash64("key", F.lit(k)).alias("rank"), "key", "n", "root")) for k in ranks)
        chosen = known.groupBy("h").agg(F.array_distinct(F.transform(F.array(*ranked), lambda c: F.struct(c["key"].alias("y"), c["n"].alias("m"), c["root"].alias("ry")))).alias("c"))
        pairs = (known if compared is None else compared).join(chosen, "h").select(F.col("key").alias("x"), "n", F.col("root").alias("rx"), F.inline("c"))
        return _pairs(pairs.where((F.col("rx") != F.col("ry")) & _sizes_fit(F.col("n"), F.col("m"))))

    def rooted(ties: DataFrame, of: DataFrame) -> DataFrame:
        roots = components(ties, "a", "b").withColumnsRenamed({"node": "key"})
        return of.join(roots, "key", "left").select("h", "key", "n", "p", F.coalesce("root", "key").alias("root"))

    def unfinished(known: DataFrame) -> DataFrame:
        """Members of the buckets with several components, and the largest of those."""
        counted = known.groupBy("h", "root").count().groupBy("h").agg(
            F.count(F.lit(1)).alias("k"), F.max_by("root", F.struct("count", "root")).alias("major")
        )
        return known.join(counted.where("k > 1").drop("k"), "h")

    few, many = CENTERS
    apart = members.withColumn("root", F.col("key"))
    # A group of near copies lies in many buckets: one for each text ties most of it, with as many pairs as texts.
    sized = members.join(members.groupBy("h").agg(F.count(F.lit(1)).alias("size")), "h")
    led = sized.groupBy("key").agg(F.max_by(F.struct("h", "n"), F.struct("size", "h")).alias("of"))
    led = led.select("of.h", "key", "of.n", F.col("key").alias("root"))
    tried = _proposed(rows).unionByName(centers(range(few), apart, led)).distinct()
    ties = settle(_verified(tried, rows, documents, "led", seed), "near-ties-led")
    open_ = settle(unfinished(rooted(ties, members)), "near-open-led")
    if open_.isEmpty():  # every bucket is one component: no pair is left
        return components(ties, "a", "b")
    more = _verified(centers(range(few), open_), rows, documents, "few", seed)
    ties = settle(ties.unionByName(more), "near-ties-few")
    open_ = settle(unfinished(rooted(ties, open_.select("h", "key", "n", "p"))), "near-open-few")
    if open_.isEmpty():  # every bucket is one component: no pair is left
        return components(ties, "a", "b")
    more = _verified(centers(range(few, many), open_), rows, documents, "many", seed)
    ties = settle(ties.unionByName(more), "near-ties-many")
    open_ = settle(unfinished(rooted(ties, open_.select("h", "key", "n", "p"))), "near-open-many")
    if open_.isEmpty():  # every bucket is one component: no pair is left
        return components(ties, "a", "b")
    # Bitmaps are compared in the join itself, so only pairs that may be similar are rows.
    held = rows.where("bits is not null").select("key", "bits").join(open_.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    full = open_.join(held, "key")
    minor = full.where("root <> major").select("h", F.col("key").alias("x"), "n", "p", "bits", F.col("root").alias("rx"))
    every = full.select(
        "h", F.col("key").alias("y"), F.col("n").alias("m"), F.col("p").alias("q"), F.col("bits").alias("bits_y"), F.col("root").alias("ry"), "major"
    )
    n, m = F.col("n"), F.col("m")
    crossed = minor.join(every, "h").where(
        (F.col("rx") != F.col("ry")) & ((F.col("ry") == F.col("major")) | (F.col("x") < F.col("y"))) & _sizes_fit(n, m)
        & _enough(F.least(n - F.col("p"), m - F.col("q")), n, m) & _bits_fit(n, F.col("bits"), m, F.col("bits_y"))
    )
    return components(ties.unionByName(_verified(_pairs(crossed), rows, documents, "crossed", seed)), "a", "b")


def _settled_rows(documents: DataFrame) -> tuple[DataFrame, int]:
    """The rows, and the seed under which no two texts have one key."""
    for seed in range(SEED, SEED + 1000):
        rows = settle(_rows(documents, seed), "near-rows")
        if rows.groupBy("key").agg((F.min("proof") != F.max("proof")).alias("two")).where("two").isEmpty():
            return rows, seed
    raise RuntimeError("texts could not be told apart by 1000 hashes")


def drop_near_copies(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row of each group of similar texts: the smallest doc_id, nulls last, then the smallest text hash.

    Groups are the components of all pairs at 0.8 or more. Rows are told apart by
    (doc_id, text), so a repeated or missing doc_id takes no other text with it.
    Blank and null texts are one group. Keeps every column.
    """
    seen_path = new_path(documents.sparkSession, "near-seen")
    with run_folder(documents.sparkSession):  # what is written on the way goes with the stage
        rows, seed = _settled_rows(documents)
        found = similar_texts(documents, rows, *common_shingles(documents, sample, seed), seed).withColumnRenamed("node", "key")
        grouped = rows.select("doc_id", "mark", "key").join(found, "key", "left").select(
            "doc_id", "mark", F.coalesce("root", "key").alias("root")
        )
        place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "mark")
        best = grouped.groupBy("root").agg(F.min(place).alias("best"))
        seen = grouped.groupBy("root", "doc_id", "mark").count()
        seen = settle(seen.join(best, "root").select(
            F.col("doc_id").alias("__id"), F.col("mark").alias("__of"), "count", place.eqNullSafe(F.col("best")).alias("stays")
        ), path=seen_path)
    marked = documents.withColumn("__mark", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__mark") == F.col("__of"))
    kept = marked.join(seen.where("not stays"), same, "left_anti")
    repeated = seen.where("stays and count > 1")
    if not repeated.isEmpty():
        once = kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "__mark"])
        kept = kept.join(repeated, same, "left_anti").unionByName(once)
    return kept.drop("__mark")
