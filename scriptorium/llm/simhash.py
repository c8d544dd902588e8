"""SimHash near-duplicates by covering locality-sensitive hashing.

Each document gets a 64-bit fingerprint over its word shingles. To find every
pair of fingerprints within ``radius`` bits, each bit position i carries a
nonzero vector phi(i) of radius + 1 bits. Table v, one for each nonzero vector,
keeps the bits with odd <phi(i), v>. Any ``radius`` differing positions span at
most ``radius`` dimensions, so some v is orthogonal to all of their vectors and
its table keeps none of them: the pair agrees there. No pair can be missed.

Inside a bucket the fingerprints agree on the kept bits, and two of them are
within 2r bits exactly if they have a common neighbour within r bits. So each
fingerprint names its neighbours over the bits that the table drops, and those
naming the same one are tied to the smallest of them. Rows stay in proportion to
fingerprints at every bucket size; no pairs are made, and none need checking.
The radius must be even, as both sides walk half of it.

Components come from alternating large-star and small-star rounds on the ties,
each round a pre-aggregated grouping and a join, checkpointed to shared storage.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import checkpointed, settle, text_bytes

BITS = 64
SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2


def fingerprint_of(data: bytes, shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Majority bits of the shingles' XXH64; zero without words."""
    words = data.lower().split()  # on bytes: A-Z only, and blanks 09-0D and 20 only
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(itertools.islice(words, k, None) for k in range(shingle)), strict=False))
    return majority(np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    counts = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 65536):  # bounded unpacking of very long texts
        block = hashes[start : start + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fingerprint long) of each row; a null or blank text has fingerprint 0.

    The long is the unsigned fingerprint's two's complement. Rows with equal
    doc_id stay apart; a null doc_id stays null.
    """

    def run(batches):
        for batch in batches:
            values = [fingerprint_of(x, shingle) for x in batch.column(1).to_pylist()]
            signed = np.array(values, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed)], names=["doc_id", "fingerprint"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", text_bytes().alias("data")).mapInArrow(run, f"doc_id {kind}, fingerprint bigint")


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The 2^(radius+1) - 1 masks of the covering family, as unsigned integers."""
    vectors = 2 ** (radius + 1) - 1
    phi = [1 + i % vectors for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (phi[i] & v).bit_count() % 2) for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _neighbours(mask: int, radius: int) -> list[int]:
    """XOR patterns of up to radius/2 dropped bits: two within ``radius`` meet at one of them."""
    if radius % 2:
        raise ValueError("the radius must be even: both sides walk half of it")
    dropped = [1 << i for i in range(BITS) if not mask >> i & 1]
    return [sum(c) for k in range(radius // 2 + 1) for c in itertools.combinations(dropped, k)]


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Ties (fingerprint, center): their components are those of all pairs within ``radius``.

    ``prints`` holds distinct fingerprints. A tie joins a fingerprint to the
    smallest one that shares a neighbour with it inside a bucket, and both are
    within ``radius`` of each other's neighbour by construction.
    """
    masks = covering_masks(radius)
    tables = F.array(*(F.struct(F.lit(k).alias("t"), F.lit(_signed(m)).alias("mask")) for k, m in enumerate(masks)))
    keyed = prints.select("fingerprint", F.explode(tables).alias("m")).select(
        "fingerprint", F.col("m.t").alias("t"), F.col("fingerprint").bitwiseAND(F.col("m.mask")).alias("kept")
    )
    # Buckets with one member hold no pair: only the members of the others walk on.
    shared = keyed.groupBy("t", "kept").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("t", "kept")
    crowded = keyed.join(shared, ["t", "kept"], "left_semi")
    flips = F.array(*(F.array(*(F.lit(_signed(x)) for x in _neighbours(m, radius))) for m in masks))
    walked = crowded.select("t", "fingerprint", F.explode(F.get(flips, F.col("t"))).alias("flip")).select(
        "t", "fingerprint", F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("spot")
    )
    walked = settle(walked.select("t", "spot", "fingerprint"), "simhash-spots")
    centers = walked.groupBy("t", "spot").agg(F.min("fingerprint").alias("center"), F.count(F.lit(1)).alias("n"))
    tied = walked.join(centers.where("n > 1").drop("n"), ["t", "spot"]).where("fingerprint <> center")
    return tied.select("fingerprint", "center").distinct()


def components(edges: DataFrame, a: str = "fingerprint", b: str = "center") -> DataFrame:
    """(node, root): the smallest node reachable from each node that has an edge.

    Large-star and small-star rounds: every round replaces edges by edges to the
    smallest neighbour, and a hub's edges are folded by a partial minimum before
    they are shuffled. Ends when a round changes nothing. Nodes without an edge
    do not appear; self-edges and nulls are dropped.
    """
    current = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    )
    current = checkpointed(current.distinct())
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: each neighbour above u points at u's smallest
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = checkpointed(large.where("u <> v").distinct())
        # small star: u and its smaller neighbours point at the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = checkpointed(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        if current.count() == following.count() and current.exceptAll(following).isEmpty():
            return following.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                following.select(F.col("v").alias("node"), F.col("v").alias("root"))
            ).distinct()
        current = following


def near_duplicates(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``documents``.

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` is the smallest
    doc_id reachable over links of ``radius`` or fewer differing bits, so a
    document alone has its own. Equal fingerprints link at zero bits and are
    folded to one node first. Blank and null texts share fingerprint zero. A null
    doc_id counts as no id: it never becomes a component id unless all are null.
    """
    docs = settle(fingerprints(documents), "simhash-prints")
    prints = docs.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"))
    prints = settle(prints, "simhash-distinct")
    found = components(links(prints.select("fingerprint"), radius))
    rooted = prints.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root")
    )
    firsts = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(firsts, "root").select("fingerprint", "component_id")
    return docs.join(named, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each near-duplicate group: the row with the smallest doc_id.

    Keeps every column. Rows that repeat a doc_id are one document, of which one
    row stays. Rows without an id have nothing to be named by and stay, each.
    """
    found = near_duplicates(documents, radius).where("doc_id <> component_id")
    gone = found.select(F.col("doc_id").alias("__gone_id")).distinct()
    kept = documents.join(gone, documents["doc_id"] == gone["__gone_id"], "left_anti")
    repeated = kept.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        return kept
    nameless = kept.where("doc_id is null")
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(nameless)
