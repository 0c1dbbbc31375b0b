"""Matching of lines and clusters by the distance of their embeddings.

Pairs come from an equi-join on a table of frame pairs, so that work is dealt by frame pair and never a cross join of
all lines. Orders end in ids, so equal ratings have one result."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linelake.functions.vectors import RATINGS
from linelake.operators import blocks


def frame_pairs(lines: DataFrame, gap: int = 1) -> DataFrame:
    """f1, f2: each frame and the one `gap` after it."""
    f = lines.select(F.col("frame_id").alias("f1")).distinct()
    g = lines.select(F.col("frame_id").alias("f2")).distinct()
    return f.join(g, F.col("f2") == F.col("f1") + gap)


def candidates(lines: DataFrame, pairs: DataFrame, method: str = "euclidean", threshold: float | None = None, dim: int | None = None) -> DataFrame:
    """f1, f2, id1, id2, rating of each pair of lines of two paired frames whose distance is at most the threshold."""
    distance, default, rating = RATINGS[method]
    a = lines.select(F.col("frame_id").alias("f1"), F.col("line_id").alias("id1"), F.col("embedding").alias("v1"))
    b = lines.select(F.col("frame_id").alias("f2"), F.col("line_id").alias("id2"), F.col("embedding").alias("v2"))
    both = pairs.join(a, "f1").join(b, "f2").select("f1", "f2", "id1", "id2", distance(F.col("v1"), F.col("v2"), dim).alias("d"))
    return both.filter(F.col("d") <= (default if threshold is None else threshold)).select("f1", "f2", "id1", "id2", rating(F.col("d")).alias("rating"))


def n_best(found: DataFrame, n: int) -> DataFrame:
    """The n best matches of each line of the first frame, with their rank from 1."""
    w = W.partitionBy("f1", "f2", "id1").orderBy("rating", "id2")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def best_by_ratio(found: DataFrame, ratio: float = 0.8) -> DataFrame:
    """The best match of each line, where it is the only one or its rating is below `ratio` times the second's."""
    w = W.partitionBy("f1", "f2", "id1").orderBy("rating", "id2")
    top = found.withColumn("rank", F.row_number().over(w)).filter("rank <= 2").withColumn("next", F.lead("rating").over(w))
    return top.filter("rank = 1").filter(F.col("next").isNull() | (F.try_divide("rating", "next") < ratio)).drop("rank", "next")


def bounded_queue(df: DataFrame, keys: list[str], value: str, sequence: str, size: int, ascending: bool = True) -> DataFrame:
    """The first `size` rows of each group by value; of equal values the earlier stays."""
    order = F.col(value).asc() if ascending else F.col(value).desc()
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(order, sequence))).filter(F.col("rank") <= size)


def greedy(found: DataFrame, most_rounds: int = 8) -> DataFrame:
    """One-to-one matches in the order of (rating, id1, id2): in rounds, every pair that is the best of both of its
    lines is taken and its lines leave; the result is that of taking pairs one by one. A few rounds take nearly all;
    chains in which each pair waits for the next are then finished by pairs of frames."""
    taken = None
    spark = found.sparkSession
    own = lambda side: W.partitionBy("f1", "f2", side).orderBy("rating", "id1", "id2")
    left = _cut(found)
    for _ in range(most_rounds):
        if left.isEmpty():
            break
        best = left.withColumn("r1", F.row_number().over(own("id1"))).withColumn("r2", F.row_number().over(own("id2"))).filter("r1 = 1 and r2 = 1").drop("r1", "r2")
        best = _cut(best)
        taken = best if taken is None else taken.unionByName(best)
        left = left.join(best.select("f1", "f2", "id1"), ["f1", "f2", "id1"], "left_anti").join(best.select("f1", "f2", "id2"), ["f1", "f2", "id2"], "left_anti")
        left = _cut(left.select(*found.columns))
    else:
        rest = greedy_in_frames(left)
        taken = rest if taken is None else taken.unionByName(rest)
    return taken if taken is not None else spark.createDataFrame([], found.schema)


def _cut(df: DataFrame) -> DataFrame:
    from linelake.plans.session import checkpointed

    return checkpointed(df)


def greedy_in_frames(found: DataFrame) -> DataFrame:
    """The same, one task for each pair of frames, whose candidates (a few ten thousands) fit in memory."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rating", "id1", "id2"], kind="stable")
        used1, used2, keep = set(), set(), np.zeros(len(pdf), bool)
        for k, (a, b) in enumerate(zip(pdf["id1"], pdf["id2"])):
            if a not in used1 and b not in used2:
                used1.add(a)
                used2.add(b)
                keep[k] = True
        return pdf[keep]

    return found.groupBy("f1", "f2").applyInPandas(one, found.schema)


#: Bytes of a block of the map in single precision, and rows of a block of the clusters that are compared with it.
BLOCK_BYTES, ASKED_ROWS = 64 << 20, 1 << 16


def block_counts(rows: int, dim: int, tasks: int, block_rows: int | None = None) -> tuple[int, int]:
    """Into how many blocks the map and the clusters are cut: as few as memory allows, and `tasks` cells at least."""
    maps = max(1, -(-rows // (block_rows or max(1, BLOCK_BYTES // (4 * dim)))))
    return maps, max(1, min(rows, max(-(-rows // ASKED_ROWS), -(-tasks // maps))))


def nearest_elsewhere(clusters: DataFrame, k: int, dim: int, key: str = "frame_id", block_rows: int | None = None) -> DataFrame:
    """For each cluster, of the 2k + 1 nearest clusters (itself among them), the first k of other frames: id1, id2,
    frame1, floor1, floor2, d2, rank. Exact search of every cluster against the whole map. Both sides are cut into
    blocks, and a task compares a block of the clusters with one of the map (`block_rows` rows, BLOCK_BYTES by default),
    so that a row is sent once for each block of the other side only. Each such cell emits a row's 2k + 1 nearest; Spark
    merges the cells' lists."""
    most = 2 * k + 1
    tasks = 4 * clusters.sparkSession.sparkContext.defaultParallelism
    maps, asks = block_counts(clusters.count(), dim, tasks, block_rows)
    number = "float" if dict(clusters.dtypes)["embedding"] == "array<float>" else "double"
    a = clusters.select(F.col("line_id").alias("id"), F.col(key).alias("frame"), F.col("floor_id").alias("floor"), F.col("embedding").cast(f"array<{number}>").alias("v"))
    own = lambda blocks, *more: F.pmod(F.xxhash64("id", *map(F.lit, more)), F.lit(blocks))
    every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    columns = ["id", "frame", "floor", "v"]
    map_rows = a.select(own(maps).alias("map"), every(asks).alias("ask"), F.lit(0).alias("role"), *columns)
    asked = a.select(every(maps).alias("map"), own(asks, 1).alias("ask"), F.lit(1).alias("role"), *columns)
    cells = map_rows.unionByName(asked).repartition(min(maps * asks, 4 * tasks), "map", "ask").sortWithinPartitions("map", "ask", "role")

    def near(batches):
        cell, parts, block = None, [], None
        for batch in batches:
            head = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], 1)
            cuts = np.flatnonzero((head[1:] != head[:-1]).any(1)) + 1
            for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(head))):
                if not hi:
                    continue
                rows = [*(batch.column(i).to_numpy(zero_copy_only=False)[lo:hi] for i in (3, 4, 5)), blocks.matrix(batch.column(6).slice(lo, hi - lo), dim)]
                if tuple(head[lo][:2]) != cell:
                    cell, parts, block = tuple(head[lo][:2]), [], None
                if head[lo][2] == 0:
                    parts.append(rows)
                    continue
                if parts:
                    block = [np.concatenate(x) for x in zip(*parts)]
                    parts, block[3] = [], blocks.Block(block[3])
                if block:
                    yield compare(*rows[:3], blocks.Block(rows[3]), *block)

    def compare(ids, frames, floors, v, ids2, frames2, floors2, v2):
        i, j, d2 = blocks.nearest(v, v2, ids2, most)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[i], frames[i], floors[i], ids2[j], frames2[j], floors2[j], d2)], ["id1", "frame1", "floor1", "id2", "frame2", "floor2", "d2"])

    parts = cells.mapInArrow(near, "id1 long, frame1 long, floor1 long, id2 long, frame2 long, floor2 long, d2 double")
    w = W.partitionBy("id1").orderBy("d2", "id2")
    ranked = parts.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)
    return ranked.filter("frame1 <> frame2").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("frame2", "place")
