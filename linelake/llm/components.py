"""Connected components of an edge table, on the cluster."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linelake.llm.common import materialize


def forest(pairs: np.ndarray) -> np.ndarray:
    """Edges (node, smallest node it is joined to) for an (n, 2) array of links: a star for each component."""
    if not len(pairs):
        return pairs.reshape(0, 2)
    nodes, inverse = np.unique(pairs, return_inverse=True)
    a, b = inverse.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            break
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return np.stack([nodes[own], nodes[root[own]]], 1)


def _contract(edges: DataFrame) -> DataFrame:
    """Each task's edges as stars: the same components with fewer, shorter paths."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                own = forest(np.stack([np.asarray(batch.column(0)), np.asarray(batch.column(1))], 1))
                yield pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1])], ["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) of every node of the edges u, v (longs, not null). Large-star and
    small-star rounds in turn until nothing changes; each round is written to the shared folder, so that no round
    depends on executors of an earlier one. No edges give no rows; loops and repeated edges change nothing."""
    now = materialize(_contract(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.filter("u <> v").distinct()  # u > v from here on
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = materialize(small.filter("u <> v").distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
