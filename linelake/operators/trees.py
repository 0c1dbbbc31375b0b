"""Random forests as tables: their nodes, the nodes that lines visit, and how far lines are apart by them."""

from __future__ import annotations

import uuid

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linelake.plans.session import checkpointed


def fit_forest(df: DataFrame, features: list[str], label: str, trees: int = 5, depth: int = 4, seed: int = 1) -> RandomForestClassificationModel:
    rows = df.select(array_to_vector(F.array(*[F.col(c).cast("double") for c in features])).alias("_v"), F.col(label).cast("double").alias("_y"))
    return RandomForestClassifier(featuresCol="_v", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def forest_nodes(model: RandomForestClassificationModel, spark) -> DataFrame:
    """tree, node, left, right, feature, threshold of every node; a leaf has -1 for its children. Of continuous features."""
    checkpointed(spark.range(1))  # sets the shared folder where it is unset
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/forest-{uuid.uuid4().hex[:12]}"
    model.write().overwrite().save(path)
    saved = spark.read.parquet(f"{path}/data")
    tree = next(c for c in saved.columns if c.lower() == "treeid")
    return saved.select(F.col(tree).alias("tree"), "nodeData.*").select(
        "tree", F.col("id").alias("node"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), F.col("split.featureIndex").alias("feature"), F.get(F.col("split.leftCategoriesOrThreshold"), F.lit(0)).alias("threshold")
    )


def decision_paths(df: DataFrame, nodes: DataFrame, keys: list[str], features: list[str], most: int = 30) -> DataFrame:
    """keys, tree, node: every node that a line visits, from the root down: one join with the nodes a level. A value up to the threshold
    goes left; a null goes right. A forest is as small as its depth allows, so its nodes go to all tasks."""
    nodes = F.broadcast(checkpointed(nodes))
    roots = [x.tree for x in nodes.filter("node = 0").select("tree").collect()]
    now = df.select(*keys, F.array(*[F.col(c).cast("double") for c in features]).alias("_x"), F.explode(F.array(*map(F.lit, roots))).alias("tree"), F.lit(0).alias("node"))
    found = []
    for _ in range(most):
        at = checkpointed(now.join(nodes, ["tree", "node"]))
        found.append(at.select(*keys, "tree", "node"))
        left = F.coalesce(F.get("_x", F.col("feature")) <= F.col("threshold"), F.lit(False))
        now = at.filter(F.col("left") >= 0).select(*keys, "_x", "tree", F.when(left, F.col("left")).otherwise(F.col("right")).alias("node"))
        if now.isEmpty():
            break
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def path_distances(paths: DataFrame, pairs: DataFrame, key: str, trees: int) -> DataFrame:
    """id1, id2, d of pairs (id1, id2): the nodes that only one of both visits, as a mean over the trees. Two paths of a tree part
    once and for all, so what they share is how many nodes down their last common one lies."""
    deep = paths.groupBy(key).agg(F.count("*").alias("n"))
    side = lambda k: paths.select(F.col(key).alias(k), "tree", "node")
    shared = pairs.select("id1", "id2").join(side("id1"), "id1").join(side("id2"), ["id2", "tree", "node"]).groupBy("id1", "id2").agg(F.count("*").alias("same"))
    size = lambda k, n: deep.select(F.col(key).alias(k), F.col("n").alias(n))
    whole = pairs.select("id1", "id2").join(size("id1", "n1"), "id1").join(size("id2", "n2"), "id2").join(shared, ["id1", "id2"], "left")
    return whole.select("id1", "id2", ((F.col("n1") + F.col("n2") - 2 * F.coalesce("same", F.lit(0))) / F.lit(float(trees))).alias("d"))
