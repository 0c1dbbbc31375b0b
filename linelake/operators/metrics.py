"""Scores of clusterings and embeddings, from contingency tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def contingency(df: DataFrame, a: str, b: str, keys: list[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def nmi(df: DataFrame, a: str, b: str) -> DataFrame:
    """Normalised mutual information with the arithmetic mean of the entropies; 1 where both are one cluster."""
    c = contingency(df, a, b)
    side = lambda x: c.groupBy(x).agg(F.sum("n").alias(f"n_{x}"))
    both = c.join(side("a"), "a").join(side("b"), "b").crossJoin(F.broadcast(c.agg(F.sum("n").alias("total"))))
    mutual = both.agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("n_a") * F.col("n_b")))).alias("mi"))

    def entropy(x: str) -> DataFrame:
        total = side(x).agg(F.sum(f"n_{x}").alias("total"))
        p = F.col(f"n_{x}") / F.col("total")
        return side(x).crossJoin(F.broadcast(total)).agg((-F.sum(p * F.log(p))).alias(f"h_{x}"))

    mean = (F.col("h_a") + F.col("h_b")) / 2
    return mutual.crossJoin(entropy("a")).crossJoin(entropy("b")).select(F.when(mean == 0, 1.0).otherwise(F.col("mi") / F.when(mean == 0, 1.0).otherwise(mean)).alias("nmi"))


def iou(df: DataFrame, truth: str, predicted: str, keys: list[str]) -> DataFrame:
    """For each group, the mean over true clusters of the best intersection over union with a predicted cluster."""
    c = contingency(df, truth, predicted, keys)
    sizes = lambda x: c.groupBy(*keys, x).agg(F.sum("n").alias(f"n_{x}"))
    both = c.join(sizes("a"), [*keys, "a"]).join(sizes("b"), [*keys, "b"])
    best = both.groupBy(*keys, "a").agg(F.max(F.col("n") / (F.col("n_a") + F.col("n_b") - F.col("n"))).alias("best"))
    return best.groupBy(*keys).agg((F.sum("best") / F.count("*")).alias("iou"), F.count("*").alias("n_clusters"))


def background_counts(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """True and false positives of background, and how many lines are judged right."""
    return df.agg(F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"), F.count_if(truth == predicted).alias("right"))


def silhouette(pairs: DataFrame) -> DataFrame:
    """score of each item from pairs (id1, c1, c2, d) of an item with each other one: (b - a) / max(a, b), where a is
    the mean distance within its cluster and b the least mean distance to another; alone in its cluster: 0."""
    means = pairs.groupBy("id1", "c1", "c2").agg(F.avg("d").alias("d"))
    both = means.groupBy("id1", "c1").agg(F.max(F.when(F.col("c1") == F.col("c2"), F.col("d"))).alias("a"), F.min(F.when(F.col("c1") != F.col("c2"), F.col("d"))).alias("b"))
    most = F.greatest("a", "b")
    return both.select("id1", F.coalesce(F.when(most > 0, (F.col("b") - F.col("a")) / most), F.lit(0.0)).alias("score"))


def summary(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.sum(value).alias("sum"), F.sum(F.abs(value)).alias("l1"), F.stddev_pop(value).alias("std"), F.max(value).alias("max"), F.min(value).alias("min"))


def mean_zero(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The columns less their mean in each group."""
    w = W.partitionBy(*keys)
    return df.withColumns({c: F.col(c) - F.avg(c).over(w) for c in columns})


def row_distances(pairs: DataFrame, keys: list[str], item: str = "id1", other: str = "id2", distance: str = "d") -> DataFrame:
    """keys, id1, id2 (id1 <> id2), d: distances between the rows of a distance matrix, each row taken as a vector. pairs:
    every item with every other one and itself, of one group (keys); an item's row is one array, and groups are as
    small as a frame's lines."""
    rows = pairs.groupBy(*keys, F.col(item).alias("id1")).agg(F.transform(F.array_sort(F.collect_list(F.struct(other, distance))), lambda x: x[distance]).alias("r1"))
    both = rows.join(rows.select(*keys, F.col("id1").alias("id2"), F.col("r1").alias("r2")), keys).filter("id1 <> id2")
    square = F.aggregate(F.zip_with("r1", "r2", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return both.select(*keys, "id1", "id2", F.sqrt(square).alias("d"))
