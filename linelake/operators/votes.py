"""Votes, counts and group summaries. All are partial aggregates: no group is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linelake.functions import geometry as G


def majority(df: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """The most frequent label of each group; of equally frequent ones the smallest; null labels don't vote, and a
    group without votes gets 0."""
    counted = df.groupBy(*keys, label).agg(F.count(label).alias("n"))
    best = F.max_by(F.col(label), F.when(F.col("n") > 0, F.struct("n", -F.col(label))))
    return counted.groupBy(*keys).agg(F.coalesce(best, F.lit(0)).alias(label), F.sum("n").alias("votes"))


def sampled_labels(lines: DataFrame, image: DataFrame, keys: list[str], camera: tuple[float, float, float, float], size: tuple[int, int], samples: int = 10) -> DataFrame:
    """keys, label, votes: what most of `samples` + 1 points of a 3-D line (sx .. ez, in camera axes) see in the instance
    image (frame_id, u, v, label; one row a pixel) of its frame. Points beside the image see its border; a pixel without
    a row has label 0; of equally frequent labels the smallest wins."""
    at = lines.withColumn("_t", F.explode(F.transform(F.sequence(F.lit(0), F.lit(samples)), lambda k: k / F.lit(float(samples)))))
    u, v = G.project(G.start() + (G.end() - G.start()) * F.col("_t"), *camera)
    inside = lambda x, most: F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(most - 1)).cast("long")
    seen = at.select(*keys, *([] if "frame_id" in keys else ["frame_id"]), inside(u, size[0]).alias("u"), inside(v, size[1]).alias("v"))
    return majority(seen.join(image, ["frame_id", "u", "v"], "left").withColumn("label", F.coalesce("label", F.lit(0))), keys)


def plane_label(points: DataFrame, keys: list[str], furthest: bool) -> DataFrame:
    """keys, label: the majority label of the side (0 or 1) whose points have the mean nearest to the origin, or furthest
    from it; of equally far sides it is side 1. points: keys, side, label, x, y, z. A side without points takes no part."""
    means = points.groupBy(*keys, "side").agg(*[F.avg(c).alias(c) for c in "xyz"]).withColumn("far", G.Vec.of("x", "y", "z").norm())
    both = majority(points, [*keys, "side"]).join(means.select(*keys, "side", "far"), [*keys, "side"])
    best = F.max_by("label", F.struct("far", "side")) if furthest else F.min_by("label", F.struct("far", -F.col("side")))
    return both.groupBy(*keys).agg(best.alias("label"))


def class_of_instance(lines: DataFrame, classes: DataFrame, on: list[str], label: str = "label") -> DataFrame:
    """lines with class_id from classes (on, class_id; on includes the label). Label 0 without a class has class 0; any
    other label without one is an error."""
    unknown = F.raise_error(F.concat(F.lit("no class of instance "), F.col(label).cast("string"))).cast("long")
    found = F.coalesce(F.col("class_id").cast("long"), F.when(F.col(label) == 0, F.lit(0).cast("long")).otherwise(unknown))
    return lines.drop("class_id").join(classes, on, "left").withColumn("class_id", found)


def first_by(df: DataFrame, keys: list[str], value: str, *order: Column | str) -> DataFrame:
    """The value of each group's first row in an order."""
    return df.groupBy(*keys).agg(F.min_by(F.col(value), F.struct(*order)).alias(value))


def first_of_others(df: DataFrame, others: DataFrame, key: str, same: list[str], apart: str, value: str, order: Column) -> DataFrame:
    """key, value: for each key of df, the value of the first row of others, in an order (a struct that ends in an id),
    that has the same `same` and another `apart`; keys without one go. Of a group of others a row asks for the first
    row, or for the first one that is apart from it, so these two are all that is joined."""
    first = F.min(F.struct(order.alias("o"), F.col(value).alias("v"))).alias("_f")
    heads = others.filter(F.col(apart).isNotNull()).groupBy(*same, apart).agg(first).withColumn("_r", F.row_number().over(W.partitionBy(*same).orderBy("_f")))
    two = heads.filter("_r <= 2").groupBy(*same).agg(*[F.min(F.when(F.col("_r") == r, F.struct(F.col("_f").alias("f"), F.col(apart).alias("a")))).alias(f"_{r}") for r in (1, 2)])
    found = F.when(F.col(apart) != F.col("_1.a"), F.col("_1.f")).when(F.col(apart) == F.col("_1.a"), F.col("_2.f"))
    return df.join(two, same).select(key, found.alias("_f")).filter("_f is not null").groupBy(key).agg(F.min("_f").alias("_f")).select(key, F.col("_f.v").alias(value))


def histogram(df: DataFrame, keys: list[str], value: str, size: int) -> DataFrame:
    """keys, counts: how often each of 0 .. size - 1 stands in a group, zeros included."""
    counts = [F.count_if(F.col(value) == i) for i in range(size)]
    return df.groupBy(*keys).agg(F.array(*counts).alias("counts"))


def length_histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    """bin, low, density: bins of `width` from half a width below the least value, as many as begin below half a width
    above the greatest; the last one includes its upper edge, what lies above it is left out, and densities sum to 1
    over the width."""
    ends = df.agg((F.min(value) - width / 2).alias("low"), (F.max(value) + width / 2).alias("high"))
    bins = F.greatest(F.ceil((F.col("high") - F.col("low")) / width) - 1, F.lit(1))
    placed = df.crossJoin(F.broadcast(ends.withColumn("bins", bins))).withColumn("bin", F.floor((F.col(value) - F.col("low")) / width))
    edge = F.col("low") + F.col("bins") * width
    placed = placed.withColumn("bin", F.when(F.col(value) == edge, F.col("bins") - 1).otherwise(F.col("bin"))).filter(F.col("bin") < F.col("bins"))
    counted = placed.groupBy("bin", "low").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select(F.col("bin").cast("long"), "n", (F.col("n") / (F.col("total") * width)).alias("density"))


def padded_labels(df: DataFrame, keys: list[str], label: str, size: int) -> DataFrame:
    """labels: the distinct labels of a group in order, cut or filled with -1 to `size`; n: how many there are. Labels
    of a group are at most as many as there are classes."""
    out = df.groupBy(*keys).agg(F.array_sort(F.collect_set(label)).alias("own"))
    return out.select(*keys, F.slice(F.concat("own", F.array_repeat(F.lit(-1), size)), 1, size).alias("labels"), F.size("own").cast("long").alias("n"))


def compact_labels(df: DataFrame, keys: list[str], label: str, background: Column) -> DataFrame:
    """label_id: labels numbered from 1 in their order within a group; background 0."""
    w = W.partitionBy(*keys).orderBy("_own")
    own = df.withColumn("_own", F.when(~background, F.col(label)))
    ids = own.filter("_own is not null").select(*keys, "_own").distinct().withColumn("label_id", F.row_number().over(w))
    return own.join(ids, [*keys, "_own"], "left").withColumn("label_id", F.coalesce("label_id", F.lit(0))).drop("_own")


def keep_top_labels(df: DataFrame, keys: list[str], label: str, size: int) -> DataFrame:
    """The rows of the `size` most frequent labels of each group; of equal counts the smaller label."""
    w = W.partitionBy(*keys).orderBy(F.desc("n"), label)
    top = df.groupBy(*keys, label).agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= size)
    return df.join(top.select(*keys, label), [*keys, label], "left_semi")


def valid_frames(df: DataFrame, frame: list[str], label: str, background: Column, more_than: int, cluster: int) -> DataFrame:
    """Frames of more than so many lines with a non-background cluster of at least so many."""
    clusters = df.groupBy(*frame, label).agg(F.count("*").alias("n"), F.max(F.when(background, 1).otherwise(0)).alias("bg"))
    return clusters.groupBy(*frame).agg(F.sum("n").alias("n_lines"), F.count_if((F.col("bg") == 0) & (F.col("n") >= cluster)).alias("n_clusters")).filter((F.col("n_lines") > more_than) & (F.col("n_clusters") >= 1))


def sample_n(df: DataFrame, keys: list[str], order: Column, tie: str, n: int) -> DataFrame:
    """n rows of each group, in an order such as a seeded hash."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(order, tie))).filter(F.col("_r") <= n).drop("_r")


def vote_floor(matches: DataFrame, query: str = "frame1", floor: str = "floor2", also: tuple[str, ...] = ()) -> DataFrame:
    """The floor most matches of a frame lie on; of equal counts the one that came first (by id1, rank). Columns `also`,
    which the frame determines, go along."""
    counted = matches.groupBy(query, *also, floor).agg(F.count("*").alias("n"), F.min(F.struct("id1", "rank")).alias("first"))
    return counted.groupBy(query, *also).agg(F.min_by(floor, F.struct(-F.col("n"), F.col("first"))).alias("voted"), F.sum("n").alias("n_matches"))


def dense_instances(df: DataFrame, keys: list[str], class_col: str, instance: str) -> DataFrame:
    """instance_id: (class, instance) pairs numbered from 1 in their order within a group; class 0 is skipped: 0."""
    w = W.partitionBy(*keys).orderBy(class_col, instance)
    ids = df.filter(F.col(class_col) != 0).select(*keys, class_col, instance).distinct().withColumn("instance_id", F.row_number().over(w))
    return df.join(ids, [*keys, class_col, instance], "left").withColumn("instance_id", F.coalesce("instance_id", F.lit(0)))


def connected_around_mean(df: DataFrame, keys: list[str], distance: str, first: float = 0.1, gap: float = 0.05) -> DataFrame:
    """connected: the nearest point lies within `first` of the mean and no two neighbours in order are more than `gap`
    apart."""
    w = W.partitionBy(*keys).orderBy(distance)
    step = df.withColumn("_step", F.col(distance) - F.lag(distance).over(w))
    return step.groupBy(*keys).agg((F.min(distance) <= first).alias("near"), F.coalesce(F.bool_and(F.col("_step") <= gap), F.lit(True)).alias("tight")).select(*keys, (F.col("near") & F.col("tight")).alias("connected"))


def z_buffer(points: DataFrame, image: list[str], z: str, values: list[str], tie: list[str]) -> DataFrame:
    """The nearest point (z > 0) of each pixel; of equal depths the first by `tie`."""
    near = F.min_by(F.struct(z, *values), F.struct(z, *tie))
    return points.filter(F.col(z) > 0).groupBy(*image).agg(near.alias("p"), F.count("*").alias("n_points")).select(*image, "p.*", "n_points")
