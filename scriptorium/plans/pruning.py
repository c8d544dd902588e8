"""Minimum split size for a fitted forest, which Spark ML trees do not have.

A node with fewer rows than the limit would not have been split; whether it is has no
influence on any node outside of it. So a forest grown without the limit and cut there
is one grown with it. (A boosted ensemble is not: its later trees follow the earlier.)

The cut works on the node table that Spark ML saves: a row a node, numbered in pre-order
within its tree, with the number of training rows that reached it.
"""

from __future__ import annotations

from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.session import new_path


def cut_small_splits(nodes: DataFrame, min_split: int) -> DataFrame:
    """The saved node table (treeID, nodeData), where nodes under ``min_split`` rows are leaves.

    Rows only get fewer on the way down, so the nodes that fall away are those whose
    parent is too small. The rest is numbered anew: a left child follows its parent, and
    a right child is looked up.
    """
    node = F.col("nodeData")
    flat = nodes.select("treeID", node["id"].alias("id"), node["rawCount"].alias("n"), node["leftChild"].alias("left"), node["rightChild"].alias("right"), "nodeData")
    small = flat.where(F.col("n") < min_split)
    gone = small.select("treeID", F.explode(F.array("left", "right")).alias("id")).where("id >= 0")
    place = F.row_number().over(Window.partitionBy("treeID").orderBy("id")) - 1  # a tree has at most two nodes a training row
    kept = flat.join(gone, ["treeID", "id"], "left_anti").withColumn("place", place)
    targets = kept.select("treeID", F.col("id").alias("right"), F.col("place").alias("right_place"))
    whole = kept.join(targets, ["treeID", "right"], "left")
    leaf = (F.col("n") < min_split) | (F.col("left") < 0)
    none = F.lit(-1)
    kind = {f.name: f.dataType for f in nodes.schema["nodeData"].dataType.fields}
    no_split = F.struct(none.alias("featureIndex"), F.array().cast("array<double>").alias("leftCategoriesOrThreshold"), none.alias("numCategories")).cast(kind["split"])
    changed = {
        "id": F.col("place"),
        "impurity": F.when(leaf, F.lit(-1.0)).otherwise(node["impurity"]),
        "gain": F.when(leaf, F.lit(-1.0)).otherwise(node["gain"]),
        "leftChild": F.when(leaf, none).otherwise(F.col("place") + 1),
        "rightChild": F.when(leaf, none).otherwise(F.col("right_place")),
        "split": F.when(leaf, no_split).otherwise(node["split"]),
    }
    rebuilt = F.struct(*(changed.get(name, node[name]).cast(t).alias(name) for name, t in kind.items()))
    return whole.select("treeID", rebuilt.alias("nodeData"))


def with_min_split(model: RandomForestRegressionModel, spark: SparkSession, min_split: int) -> RandomForestRegressionModel:
    """The forest as if nodes with fewer than ``min_split`` rows had never been split."""
    if min_split <= 2:  # every split has two rows at least
        return model
    grown, cut = new_path(spark, "forest"), new_path(spark, "forest-cut")
    model.write().save(grown)
    cut_small_splits(spark.read.parquet(f"{grown}/data"), min_split).write.parquet(f"{cut}/data")
    spark.read.parquet(f"{grown}/treesMetadata").write.parquet(f"{cut}/treesMetadata")
    spark.read.text(f"{grown}/metadata").coalesce(1).write.text(f"{cut}/metadata")
    return RandomForestRegressionModel.load(cut)
