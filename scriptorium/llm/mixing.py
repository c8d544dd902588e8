"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the output over its size.
Each document draws its number of copies by inverting the Poisson distribution of
that mean at a number hashed from (seed, doc_id, text), so a repeated or lost task
draws the same. Copies are exploded, dealt over all partitions by a hashed key and
sorted by it there: one exchange, after which each partition is a uniform random
share of the mixture in random order, and ``mix_key`` orders the whole.

A large mean is the sum of ``parts`` independent Poisson draws of at most
``PART_MEAN`` each (the sum of Poisson variables is Poisson), so the tables of
cumulative probabilities stay short at any rate. A source of few and short documents
may need very many copies of one: parts beyond ``RANGE_PARTS`` are drawn in ranges, dealt
over all tasks, and a running sum over the ranges numbers the copies. All is DataFrame
expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import let, settle

SEED = 11
PART_MEAN = 4.0
RANGE_PARTS = 4096  # draws of one row in one task: about 16,000 copies
TABLE = 40  # the chance of 40 or more at mean 4 is below 1e-25, under the resolution of a draw


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 random bits, from the MD5 of the joined parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def source_rates(
    documents: DataFrame, weights: dict[str | None, float] | None = None, total_chars: int | None = None
) -> DataFrame:
    """(source, size, rate): one row for each source with a target.

    ``size`` counts a document as its characters plus one, so empty documents
    count. ``weights`` give each source's share of the output's size, scaled to sum
    one; sources without a weight, or with none above zero, get rate 0 and leave
    the mixture. Without ``weights`` all sources get equal shares. ``total_chars``
    is the output's expected size, by default that of the input. A null source is
    a source like any other.
    """
    size = F.coalesce(F.length("text"), F.lit(0)).cast("bigint") + 1
    sizes = settle(documents.groupBy("source").agg(F.sum(size).alias("size")), "mix-sizes")
    if weights is None:
        weighted = sizes.withColumn("weight", F.lit(1.0))
    else:
        given = documents.sparkSession.createDataFrame(list(weights.items()), "__source string, weight double")
        weighted = sizes.join(given, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
        weighted = weighted.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    sums = weighted.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    total = total_chars if total_chars is not None else sums["size"] or 0
    share = F.col("weight") / F.lit(sums["weight"] or 1.0)
    return weighted.select("source", "size", (share * F.lit(total).cast("bigint") / F.col("size")).alias("rate"))


def _cumulative(mean: Column) -> Column:
    """P(X <= k) for k below ``TABLE``, by the recurrence of the terms."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TABLE - 1)), start, step, lambda acc: acc["all"])


def _drawn(first: Column, last: Column) -> Column:
    """The sum of a row's draws ``first`` to ``last``."""
    draws = F.transform(
        F.sequence(first, last),
        lambda j: let(_uniform(F.col("__row"), j.cast("string")), lambda u: F.size(F.filter("__table", lambda c: c <= u))),
    )
    return F.aggregate(draws, F.lit(0).cast("bigint"), lambda a, b: a + b)


def _in_ranges(rows: DataFrame, range_parts: int) -> DataFrame:
    """``rows`` once for each range of parts with a copy; adds ``__n`` and ``__start``.

    Rows alike in id, text and source draw alike, so ranges are drawn for one of them.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number given is not coalesced: rows are small, their work is not
    width = F.lit(range_parts).cast("bigint")
    ranges = rows.select("__row", "__source", "__parts", "__table").dropDuplicates(["__row", "__source"]).withColumn(
        "__range", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__parts") - 1) / width)))
    )
    drawn = ranges.repartition(tasks, "__row", "__range").select(
        "__row", "__source", "__range",
        _drawn(F.col("__range") * width + 1, F.least((F.col("__range") + 1) * width, F.col("__parts"))).alias("__n"),
    )
    before = Window.partitionBy("__row", "__source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    numbered = settle(drawn, "mix-ranges").withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    numbered = numbered.withColumnsRenamed({"__row": "__of", "__source": "__from"}).where("__n > 0")
    same = (F.col("__row") == F.col("__of")) & F.col("__source").eqNullSafe(F.col("__from"))
    return rows.join(numbered, same).repartition(tasks, "__row", "__range")


def mix_sources(
    documents: DataFrame,
    weights: dict[str | None, float] | None = None,
    total_chars: int | None = None,
    seed: int = SEED,
    range_parts: int = RANGE_PARTS,
) -> DataFrame:
    """Every column of ``documents``, each row as often as drawn, in global random order.

    Adds ``mix_copy`` (0, 1, ... within a row's copies) and ``mix_key`` (order of the
    mixture); a column of these names that the input has is replaced. Rows alike in
    doc_id and text draw alike. Null ids and texts are hashed as empty strings.
    ``range_parts`` deals the work of a row with many copies, and changes no result. A row
    of more than 2^31 copies is an error.
    """
    rates = source_rates(documents, weights, total_chars)
    parts = F.greatest(F.ceil(F.col("rate") / PART_MEAN), F.lit(1)).cast("bigint")
    tables = settle(rates.select(
        F.col("source").alias("__source"), parts.alias("__parts"), _cumulative(F.col("rate") / parts).alias("__table")
    ), "mix-tables")
    docs = documents.drop("mix_copy", "mix_key")
    names = docs.columns
    # a row a source: joined as AQE measures it, without moving documents while it is small
    drawn = docs.join(tables, docs["source"].eqNullSafe(tables["__source"])).withColumn(
        "__row", F.md5(F.concat_ws("|", F.lit(str(seed)), docs["doc_id"].cast("string"), F.md5(F.coalesce("text", F.lit("")))))
    )
    one = F.lit(1).cast("bigint")
    counted = [
        drawn.where(F.col("__parts") <= range_parts).withColumn("__n", _drawn(one, F.col("__parts"))).where("__n > 0").withColumn("__start", one - 1)
    ]
    if not tables.where(F.col("__parts") > range_parts).isEmpty():
        counted.append(_in_ranges(drawn.where(F.col("__parts") > range_parts), range_parts))
    numbers = F.explode(F.sequence(F.col("__start").cast("int"), (F.col("__start") + F.col("__n") - 1).cast("int"))).alias("mix_copy")
    copied = reduce(DataFrame.unionByName, [rows.select(*(docs[c] for c in names), "__row", numbers) for rows in counted])
    keyed = copied.withColumn("mix_key", F.md5(F.concat_ws("|", F.col("__row"), F.lit("order"), F.col("mix_copy").cast("string"))))
    return keyed.drop("__row").repartition("mix_key").sortWithinPartitions("mix_key")


def mixture(documents: DataFrame) -> DataFrame:
    """The mixture of equal source shares, texts included."""
    return mix_sources(documents.select("doc_id", "source", "text"))
