"""Train/test split by a hash of the document key.

The hash of a key never changes, so a document stays on its side when the corpus
grows, is reordered or repartitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.schema import DEFAULTS, Settings

BUCKETS = 10_000


def _hash(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")))


def hash_bucket(key: Column, seed: int = DEFAULTS.seed) -> Column:
    """A number below 10,000 from the first 32 bits of the key's MD5."""
    return F.conv(F.substring(_hash(key, seed), 1, 8), 16, 10).cast("long") % BUCKETS


def train_test_split(df: DataFrame, key: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``split``: ``test`` for the configured share of hash buckets. No shuffle."""
    cut = round(settings.test_size * BUCKETS)
    side = F.when(hash_bucket(F.col(key), settings.seed) < cut, F.lit("test")).otherwise(F.lit("train"))
    return df.withColumn("split", side)


def exact_train_test_split(df: DataFrame, key: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``split`` with exactly ``ceil(test_size * n)`` test rows for unique keys.

    The test rows are the smallest hashes. Their cut-off is found without a
    global sort: rows are counted by the first four hash digits, and only the
    one group of equal digits that holds the cut-off is sorted, which is about
    1/65536 of the rows.
    """
    hashed = df.withColumn("_hash", _hash(F.col(key), settings.seed))
    prefix = F.substring("_hash", 1, 4)
    groups = hashed.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()
    total = sum(g["n"] for g in groups)
    wanted = -(-total * round(settings.test_size * 1_000_000) // 1_000_000)
    below = 0
    cut = F.lit(False)
    for group in groups:
        if below + group["n"] > wanted:
            inside = hashed.where(prefix == group["p"]).select("_hash").orderBy("_hash").limit(wanted - below + 1)
            last = inside.agg(F.max("_hash")).first()[0]
            cut = F.col("_hash") < last
            break
        below += group["n"]
    else:
        cut = F.lit(True)
    side = F.when(cut, F.lit("test")).otherwise(F.lit("train"))
    return hashed.withColumn("split", side).drop("_hash")
