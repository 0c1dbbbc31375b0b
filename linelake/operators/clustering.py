"""Grouping of lines and points: components under a distance, k-means, k-medoids, mean shift, single linkage, merging.

Groups that the line pipeline bounds (the lines of a frame, the points beside a line) are handled by one task each;
whatever can grow with the data is a distributed loop whose rounds are checkpointed."""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linelake.plans.session import checkpointed


def neighbours(points: DataFrame, key: str, coordinates: list[str], radius: float) -> DataFrame:
    """u, v (u < v) of points within the radius: joined by grid cell, so that only the cells around a point are met."""
    cell = [F.floor(F.col(c) / radius).cast("long").alias(f"g{i}") for i, c in enumerate(coordinates)]
    own = points.select(F.col(key).alias("u"), *[F.col(c).alias(f"a{i}") for i, c in enumerate(coordinates)], *cell)
    around = F.array(*[F.struct(*[F.lit(d).alias(f"d{i}") for i, d in enumerate(x)]) for x in itertools.product((-1, 0, 1), repeat=len(coordinates))])
    other = points.select(F.col(key).alias("v"), *[F.col(c).alias(f"b{i}") for i, c in enumerate(coordinates)], *cell).withColumn("d", F.explode(around))
    other = other.select("v", *[f"b{i}" for i in range(len(coordinates))], *[(F.col(f"g{i}") + F.col(f"d.d{i}")).alias(f"g{i}") for i in range(len(coordinates))])
    square = reduce(lambda x, y: x + y, [(F.col(f"a{i}") - F.col(f"b{i}")) * (F.col(f"a{i}") - F.col(f"b{i}")) for i in range(len(coordinates))])
    return own.join(other, [f"g{i}" for i in range(len(coordinates))]).filter((F.col("u") < F.col("v")) & (square <= radius * radius)).select("u", "v")


def components(edges: DataFrame, nodes: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component: the smallest node that can be reached. edges u, v; nodes node. Large-star and small-star rounds:
    in turn, all larger neighbours and all smaller ones are hung on a node's least neighbour."""
    now, before = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()), None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        down = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        now = checkpointed(down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
    else:
        raise RuntimeError("components did not settle")
    return nodes.select("node").join(now, nodes["node"] == now["u"], "left").select("node", F.coalesce("v", "node").alias("component"))


def kmeans(df: DataFrame, columns: list[str], k: int, seed: int = 1) -> DataFrame:
    """df with `cluster`; with no more rows than k, all are 0."""
    if df.limit(k + 1).count() <= k:
        return df.withColumn("cluster", F.lit(0))
    vectors = df.withColumn("_v", array_to_vector(F.array(*[F.col(c).cast("double") for c in columns])))
    model = KMeans(k=k, maxIter=100, tol=0.01, seed=seed, featuresCol="_v", predictionCol="cluster").fit(vectors)
    return model.transform(vectors).drop("_v")


def scaled_by_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns over their mean over all rows; a mean of 0 leaves them."""
    means = df.agg(*[F.avg(c).alias(f"_{c}") for c in columns])
    return df.crossJoin(F.broadcast(means)).select(*[c for c in df.columns if c not in columns], *[F.when(F.col(f"_{c}") == 0, F.col(c)).otherwise(F.try_divide(F.col(c), f"_{c}")).alias(c) for c in columns])


def kmedoids(distances: DataFrame, keys: list[str], k: int, most_rounds: int = 50) -> DataFrame:
    """keys, id, medoid: k medoids of each group (the lines of a frame, whose distance matrix fits in memory).
    distances: keys, id1, id2, d, both directions and the diagonal. Starts from the k smallest ids; ties go to the
    smaller id; a group of no more than k lines has each as its own medoid."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(pdf[["id1", "id2"]].to_numpy(), return_inverse=True)
        at = at.reshape(-1, 2)
        d = np.full((len(ids), len(ids)), np.inf)
        d[at[:, 0], at[:, 1]] = pdf["d"].to_numpy(float)
        medoids = np.arange(min(k, len(ids)))
        for _ in range(most_rounds):
            own = medoids[np.argmin(d[:, medoids], axis=1)]
            cost = np.where(own[:, None] == own, d, 0.0).sum(1)
            new = np.array([min(np.flatnonzero(own == m), key=lambda i: (cost[i], i)) for m in np.unique(own)])
            new.sort()
            if np.array_equal(new, medoids):
                break
            medoids = new
        out = pd.DataFrame({"id": ids, "medoid": ids[medoids[np.argmin(d[:, medoids], axis=1)]]})
        for c in reversed(keys):
            out.insert(0, c, pdf[c].iloc[0])
        return out

    kind = distances.schema["id1"].dataType.simpleString()
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in distances.select(*keys).schema), f"id {kind}, medoid {kind}"])
    return distances.groupBy(*keys).applyInPandas(one, schema)


def mean_shift(df: DataFrame, keys: list[str], coordinates: list[str], weight: str, radius: float = 1.7, shifts: int = 20) -> DataFrame:
    """part: the pieces of each group (the lines of one label of one scene, which fit in memory). From the first line
    not yet in a piece, the weighted mean of all lines in the radius is shifted until it stays."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_id")
        x, w = pdf[coordinates].to_numpy(float), np.maximum(pdf[weight].to_numpy(float), 1e-12)
        part, number = np.full(len(pdf), -1), 0
        while (part < 0).any():
            centre = x[np.flatnonzero(part < 0)[0]]
            for _ in range(shifts):
                inside = (np.linalg.norm(x - centre, axis=1) < radius) & (part < 0)
                if not inside.any():
                    break
                moved = np.average(x[inside], axis=0, weights=w[inside])
                if np.allclose(moved, centre, atol=1e-9):
                    break
                centre = moved
            inside = (np.linalg.norm(x - centre, axis=1) < radius) & (part < 0)
            inside[np.flatnonzero(part < 0)[0]] = True
            part[inside] = number
            number += 1
        return pdf.assign(part=part)

    return df.groupBy(*keys).applyInPandas(one, T.StructType([*df.schema.fields, T.StructField("part", T.IntegerType())]))


def single_linkage(df: DataFrame, keys: list[str], coordinates: list[str], most: int = 16) -> DataFrame:
    """cluster: each group (the lines of a frame) cut at its n - 1 longest links of the minimum spanning tree, for the
    n from 2 to `most` with the best mean silhouette; groups of fewer than 3 lines are one cluster."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_id")
        x = pdf[coordinates].to_numpy(float)
        n = len(x)
        label = np.zeros(n, int)
        if n >= 3:
            d = np.linalg.norm(x[:, None] - x[None], axis=2)
            best, near, of, inside = [], d[0].copy(), np.zeros(n, int), np.zeros(n, bool)
            inside[0] = True
            for _ in range(n - 1):
                j = int(np.argmin(np.where(inside, np.inf, near)))
                best.append((near[j], of[j], j))
                inside[j] = True
                of = np.where(d[j] < near, j, of)
                near = np.minimum(near, d[j])
            best.sort()
            score = -2.0
            for k in range(2, min(most, n - 1) + 1):
                root = np.arange(n)
                for _, a, b in best[: n - k]:
                    root[root == root[b]] = root[a]
                own = np.unique(root, return_inverse=True)[1]
                sums = np.stack([d[:, own == c].sum(1) for c in range(k)], 1)
                size = np.bincount(own, minlength=k)
                a = sums[np.arange(n), own] / np.maximum(size[own] - 1, 1)
                other = sums / size
                other[np.arange(n), own] = np.inf
                b = other.min(1)
                s = np.where(size[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0).mean()
                if s > score:
                    score, label = s, own
        return pdf.assign(cluster=label)

    return df.groupBy(*keys).applyInPandas(one, T.StructType([*df.schema.fields, T.StructField("cluster", T.IntegerType())]))


def merge_lines(df: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of a frame in the order of their ids; each is merged into the first kept line that equals it (nearly
    parallel, an end within sqrt 2), whose box then grows. df: keys, line_id, x0, y0, x1, y1."""

    def rate(a, b):
        d = b[0] - a[0]
        return np.nan if d == 0 and b[1] == a[1] else np.copysign(np.inf, b[1] - a[1]) if d == 0 else (b[1] - a[1]) / d

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[np.ndarray] = []
        first = []
        for i, line in zip(*(lambda p: (p["line_id"], p[["x0", "y0", "x1", "y1"]].to_numpy(float)))(pdf.sort_values("line_id"))):
            for k, other in enumerate(kept):
                u, v = line[:2] - line[2:], other[:2] - other[2:]
                size = (u @ u) * (v @ v)
                ends = min(((line[a : a + 2] - other[b : b + 2]) ** 2).sum() for a in (0, 2) for b in (0, 2))
                if size > 0 and (u @ v) ** 2 / size > 0.98 and ends < 2:
                    xs, ys = np.append(line[::2], other[::2]), np.append(line[1::2], other[1::2])
                    up = rate(line[:2], line[2:]) + rate(other[:2], other[2:])
                    low, high = (ys.min(), ys.max()) if up > 0 else (ys.max(), ys.min())
                    kept[k] = np.array([xs.min(), low, xs.max(), high])
                    break
            else:
                kept.append(line)
                first.append(i)
        out = pd.DataFrame(np.array(kept).reshape(-1, 4), columns=["x0", "y0", "x1", "y1"])
        out.insert(0, "line_id", first)
        for k in keys:
            out.insert(0, k, pdf[k].iloc[0])
        return out[[*keys, "line_id", "x0", "y0", "x1", "y1"]]

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys, "line_id").schema), "x0 double, y0 double, x1 double, y1 double"])
    return df.select(*keys, "line_id", "x0", "y0", "x1", "y1").groupBy(*keys).applyInPandas(one, schema)


def fuse_groups(df: DataFrame, group: list[str]) -> DataFrame:
    """One line per group: the two ends farthest apart along the first line's direction, most frequent label and class
    (ties: the smaller). df: line_id, sx .. ez, label, class_id."""
    first = W.partitionBy(*group)
    d = [F.min_by(F.col(f"e{k}") - F.col(f"s{k}"), "line_id").over(first).alias(f"d{k}") for k in "xyz"]
    ends = df.select("*", *d)
    along = lambda p: sum((F.col(f"d{k}") * F.col(f"{p}{k}") for k in "xyz"), F.lit(0.0))
    points = ends.select(*group, "line_id", "label", "class_id", F.explode(F.array(*[F.struct(along(p).alias("t"), *[F.col(f"{p}{k}").alias(k) for k in "xyz"]) for p in "se"])).alias("p"))
    box = points.groupBy(*group).agg(F.min("p").alias("low"), F.max("p").alias("high"), F.count_distinct("line_id").alias("n_lines"))
    return box.select(*group, *[F.col(f"low.{k}").alias(f"s{k}") for k in "xyz"], *[F.col(f"high.{k}").alias(f"e{k}") for k in "xyz"], "n_lines")


def random_order(column: Column | str, seed: int) -> Column:
    """A seeded order that is the same on every engine run and partitioning."""
    return F.xxhash64(F.lit(seed), column)
