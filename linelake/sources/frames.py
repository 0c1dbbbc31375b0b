"""Frames: pose files, image folders, and topics of a data set joined to frames by their time stamps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linelake.functions import geometry as G


def read_poses(spark: SparkSession, path: str, skip: int = 3) -> DataFrame:
    """frame_id, stamp (ns), eye, target and up of each second row after the header of a pose file."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("row", "line"))
    numbers = lines.filter((F.col("row") >= skip) & ((F.col("row") - skip) % 2 == 0) & (F.trim("line") != "")).withColumn("n", F.split(F.trim("line"), r"\s+"))
    fields = [F.col("n")[i + 1].cast("double").alias(name) for i, name in enumerate(f"{p}{c}" for p in ("eye", "target", "up") for c in "xyz")]
    return numbers.select(F.floor((F.col("row") - skip) / 2).cast("int").alias("frame_id"), (F.col("n")[0].cast("double") * 1e9).cast("long").alias("stamp"), *fields)


def constant_poses(spark: SparkSession, n: int) -> DataFrame:
    """The rows of a pose file of n frames that never moves, each twice."""
    return spark.range(2 * n).select(F.floor(F.col("id") / 2).cast("int").alias("frame_id"), F.lit(0.0).alias("eyex"), F.lit(0.0).alias("eyey"), F.lit(0.0).alias("eyez"), F.lit(0.0).alias("targetx"), F.lit(0.0).alias("targety"), F.lit(1.0).alias("targetz"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, frame_id, content of image files; decoding is the caller's."""
    return spark.read.format("binaryFile").load(path).select("path", F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("int").alias("frame_id"), "content")


def synchronised(*topics: DataFrame, on: tuple[str, ...] = ("scene_id", "stamp")) -> DataFrame:
    """Topics joined where all have a message with exactly the same stamp."""
    return reduce(lambda a, b: a.join(b, list(on)), topics)


#: Data sets: how many topics a frame needs, how they are matched, and the size of its images where it is fixed.
ADAPTERS = {
    "interiornet": {"topics": 6, "sync": "exact", "size": None},
    "scenenet": {"topics": 5, "sync": "exact", "size": (320, 240)},
    "scenenn": {"topics": 5, "sync": "exact", "size": None},
    "freiburg": {"topics": 4, "sync": "approximate", "size": None},
}


def adapt(name: str, topics: list[DataFrame], slop: float = 0.02) -> DataFrame:
    """Frames of a data set from its topics."""
    a = ADAPTERS[name]
    if len(topics) != a["topics"]:
        raise ValueError(f"{name} needs {a['topics']} topics")
    if a["sync"] == "exact":
        return synchronised(*topics)
    return reduce(lambda x, y: approximately(x, y, slop), topics)


def approximately(a: DataFrame, b: DataFrame, slop: float, bucket: float | None = None) -> DataFrame:
    """Each message of a (scene_id, stamp in seconds) with the nearest of b within `slop` seconds; of equally near
    ones the earlier. An equi-join on buckets of time, each message of b in three."""
    width = bucket or slop
    ka = a.withColumn("_k", F.floor(F.col("stamp") / width))
    other = [c for c in b.columns if c not in ("scene_id", "stamp")]
    kb = b.select("scene_id", F.col("stamp").alias("_t"), *other).withColumn("_k", F.explode(F.array(*[F.floor(F.col("_t") / width) + d for d in (-1, 0, 1)])))
    near = ka.join(kb, ["scene_id", "_k"]).filter(F.abs(F.col("stamp") - F.col("_t")) <= slop)
    return near.groupBy(*a.columns).agg(F.min_by(F.struct(*other), F.struct(F.abs(F.col("stamp") - F.col("_t")), "_t")).alias("_m")).select(*a.columns, *[F.col(f"_m.{c}").alias(c) for c in other])


def points_of_depth(pixels: DataFrame, fx: float, fy: float, cx: float, cy: float) -> DataFrame:
    """x, y, z of depth pixels (frame_id, u, v, depth)."""
    return pixels.select("*", *G.back_project(F.col("u"), F.col("v"), F.col("depth"), fx, fy, cx, cy).aliased("x", "y", "z"))


def cropped(pixels: DataFrame, margin: int, width: int, height: int) -> DataFrame:
    """Pixels inside a margin, counted anew from its corner."""
    inside = pixels.filter((F.col("u") >= margin) & (F.col("u") < width - margin) & (F.col("v") >= margin) & (F.col("v") < height - margin))
    return inside.withColumns({"u": F.col("u") - margin, "v": F.col("v") - margin})
