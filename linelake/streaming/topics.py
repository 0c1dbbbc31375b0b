"""Structured Streaming versions of the frame operators, and the batch forms that they agree with."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sync_exact(topics: list[DataFrame], on: str = "stamp", late: str = "10 minutes") -> DataFrame:
    """Topics with the same stamp in all; state of a stamp goes when the watermark has passed it. Works on batches
    and on streams; each topic's other columns need names of their own."""
    return reduce(lambda a, b: a.join(b, on), [t.withWatermark(on, late) if t.isStreaming else t for t in topics])


def sync_approximate(a: DataFrame, b: DataFrame, slop: str = "1 second", late: str = "10 minutes") -> DataFrame:
    """All pairs of messages (a.stamp, b.stamp2) at most `slop` apart. Time is cut into steps of `slop`, in which one side
    is looked up once and the other in three, so pairs come from an equi-join (a stream needs one)."""
    if a.isStreaming:
        a, b = a.withWatermark("stamp", late), b.withWatermark("stamp2", late)
    near = F.expr(f"stamp2 >= stamp - interval {slop} and stamp2 <= stamp + interval {slop}")
    step = F.expr(f"unix_micros(timestamp_micros(0) + interval {slop})")
    at = lambda c: F.floor(F.unix_micros(F.col(c)) / step).cast("long")
    around = F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: at("stamp2") + k))
    return a.withColumn("_step", at("stamp")).join(b.withColumn("_step2", around), near & (F.col("_step") == F.col("_step2"))).drop("_step", "_step2")


def first_frames(frames: DataFrame, key: str = "frame_id", stamp: str = "stamp", late: str = "10 minutes") -> DataFrame:
    """The first message of each frame."""
    if frames.isStreaming:
        return frames.withWatermark(stamp, late).dropDuplicatesWithinWatermark([key])
    w = W.partitionBy(key).orderBy(stamp)
    return frames.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def count_frames(frames: DataFrame, scene: str = "scene_id", stamp: str = "stamp", step: int = 1) -> DataFrame:
    """number: 0, step, 2 step ... of a scene's frames in the order of their stamps; a new scene starts anew."""
    if not frames.isStreaming:
        return frames.withColumn("number", (F.row_number().over(W.partitionBy(scene).orderBy(stamp)) - 1) * step)
    schema = T.StructType([*frames.schema.fields, T.StructField("number", T.IntegerType())])

    def number(key, parts, state: GroupState):
        n = state.get[0] if state.exists else 0
        for pdf in parts:
            pdf = pdf.sort_values(stamp, kind="stable")
            yield pdf.assign(number=range(n * step, (n + len(pdf)) * step, step))
            n += len(pdf)
        state.update((n,))

    return frames.groupBy(scene).applyInPandasWithState(number, schema, "n int", "append", GroupStateTimeout.NoTimeout)


def with_previous(lines: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Pairs (line, line of the frame before it in the scene) for matching: scene_id, frame_id, line_id, embedding and
    prev_line_id, prev_embedding. A stream keeps the last frame's lines of each scene as its state."""
    if not lines.isStreaming:
        prev = lines.select("scene_id", (F.col("frame_id") + 1).alias("frame_id"), F.col("line_id").alias("prev_line_id"), F.col("embedding").alias("prev_embedding"))
        return lines.select("scene_id", "frame_id", "line_id", "embedding").join(prev, ["scene_id", "frame_id"])
    schema = "scene_id long, frame_id long, line_id long, embedding array<float>, prev_line_id long, prev_embedding array<float>"

    def pair(key, parts, state: GroupState):
        last, ids, vectors = state.get if state.exists else (None, [], [])
        pdf = pd.concat(list(parts)).sort_values(["frame_id", "line_id"])
        for frame, own in pdf.groupby("frame_id"):
            if last is not None and frame == last + 1 and len(ids):
                before = pd.DataFrame({"prev_line_id": list(ids), "prev_embedding": list(vectors)})
                yield own[["scene_id", "frame_id", "line_id", "embedding"]].merge(before, how="cross")
            last, ids, vectors = int(frame), own["line_id"].tolist(), [[float(x) for x in v] for v in own["embedding"]]
        state.update((last, ids, vectors))

    return lines.groupBy("scene_id").applyInPandasWithState(pair, schema, "last long, ids array<long>, vectors array<array<float>>", "append", GroupStateTimeout.NoTimeout)


def full_histogram(frames: DataFrame, n: int, value: str = "length", width: float = 0.02) -> DataFrame:
    """bin, n of the lines of the first n frames (frame numbers below n), once they are all there; later frames are
    not taken. A stream runs this in complete mode; before the n-th frame the result is empty."""
    taken = frames.filter(F.col("number") < n)
    seen = taken.groupBy(F.floor(F.col(value) / width).alias("bin")).agg(F.count("*").alias("n"), F.collect_set("number").alias("frames"))
    return seen


def histogram_when_full(hist: DataFrame, n: int) -> DataFrame:
    """The batch part of full_histogram: rows only when all n frames are there."""
    total = hist.select(F.explode("frames").alias("f")).agg(F.count_distinct("f").alias("k"))
    return hist.crossJoin(F.broadcast(total)).filter(F.col("k") >= n).select("bin", "n")


def with_pose(messages: DataFrame, poses: DataFrame, stamp: str = "stamp") -> DataFrame:
    """Messages with the pose of their very stamp; those without one go. poses (a static table or a stream with a
    watermark) has one row for each stamp."""
    return messages.join(poses, stamp)
