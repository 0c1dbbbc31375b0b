"""Streams that wait: latest poses, histograms of the first frames, and a sink that writes a batch once.

Each has a batch form that the stream agrees with, whatever its micro-batches are."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest_pose(messages: DataFrame, poses: DataFrame, key: str, values: list[str], stamp: str = "stamp", bucket: str = "hour") -> DataFrame:
    """messages with the values of the latest pose of their key that isn't later than they are; null without one. Of poses with one stamp
    the greatest values win. Each key's time is cut into buckets, so that one key's rows are sorted in many tasks; only the last
    pose of a bucket is handed on to later ones."""
    pose = F.struct(stamp, *values)
    at = F.date_trunc(bucket, F.col(stamp)).alias("_bucket")
    own = messages.withColumn("_bucket", at)
    known = poses.select(key, at, pose.alias("_pose"))
    lasts = known.groupBy(key, "_bucket").agg(F.max("_pose").alias("_last")).unionByName(own.select(key, "_bucket").distinct().withColumn("_last", F.lit(None).cast(known.schema["_pose"].dataType)))
    # a row a bucket: its own last pose, if any, and the last one of the buckets before
    lasts = lasts.groupBy(key, "_bucket").agg(F.max("_last").alias("_last"))
    before = F.last("_last", True).over(W.partitionBy(key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    carried = lasts.select(key, "_bucket", before.alias("_pose"))
    asks = own.select(key, "_bucket", F.col(stamp).alias("_at"), F.lit(1).alias("_ask"), F.lit(None).cast(known.schema["_pose"].dataType).alias("_pose"), F.struct(*messages.columns).alias("_row"))
    none = F.lit(None).cast(asks.schema["_row"].dataType).alias("_row")
    told = known.unionByName(carried).filter("_pose is not null").select(key, "_bucket", F.col(f"_pose.{stamp}").alias("_at"), F.lit(0).alias("_ask"), "_pose", none)
    order = W.partitionBy(key, "_bucket").orderBy("_at", "_ask", "_pose").rowsBetween(W.unboundedPreceding, 0)
    seen = told.unionByName(asks).withColumn("_found", F.last("_pose", True).over(order)).filter("_ask = 1")
    return seen.select("_row.*", *[F.col(f"_found.{v}").alias(v) for v in values])


def latest_pose_stream(messages: DataFrame, poses: DataFrame, key: str, values: list[str], stamp: str = "stamp", late: str = "10 seconds") -> DataFrame:
    """latest_pose of two streams, of messages (key, stamp, message_id) and poses (key, stamp, values: doubles). A
    message waits until the watermark has passed it, so poses that come late, but not by more than `late`, still count.
    State: a key's waiting messages and the poses that these or later ones can need."""
    rows = messages.select(key, stamp, F.col("message_id").cast("long").alias("message_id"), F.lit(None).cast("array<double>").alias("pose"))
    rows = rows.unionByName(poses.select(key, stamp, F.lit(None).cast("long").alias("message_id"), F.array(*[F.col(v).cast("double") for v in values]).alias("pose")))
    kind = dict(messages.dtypes)[key]
    schema = f"{key} {kind}, {stamp} timestamp, message_id long, {', '.join(f'{v} double' for v in values)}"

    def work(keys, parts, state: GroupState):
        waiting, known = ([list(x) for x in state.get[0]], [(t, list(p)) for t, p in state.get[1]]) if state.exists else ([], [])
        for pdf in parts:
            for t, m, p in zip(pdf[stamp], pdf["message_id"], pdf["pose"]):
                t = int(pd.Timestamp(t).value // 1000)
                if p is None:
                    waiting.append([t, int(m)])
                else:
                    known.append((t, [float(x) for x in p]))
        known.sort()
        passed = state.getCurrentWatermarkMs() * 1000
        ready = sorted(x for x in waiting if x[0] <= passed)
        waiting = sorted(x for x in waiting if x[0] > passed)
        out = []
        for t, m in ready:
            old = [p for at, p in known if at <= t]
            out.append((keys[0], pd.Timestamp(t, unit="us"), m, *(old[-1] if old else [None] * len(values))))
        # of the poses that the watermark has passed, the last is enough
        gone = [x for x in known if x[0] <= passed]
        known = gone[-1:] + [x for x in known if x[0] > passed]
        state.update((waiting, known))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, stamp, "message_id", *values])

    held = "waiting array<struct<t: long, m: long>>, known array<struct<t: long, p: array<double>>>"
    return rows.withWatermark(stamp, late).groupBy(key).applyInPandasWithState(work, schema, held, "append", GroupStateTimeout.EventTimeTimeout)


def first_frames_histogram(frames: DataFrame, n: int, key: str = "scene_id", order: str = "stamp", lengths: str = "lengths", width: float = 0.02) -> DataFrame:
    """key, bin, n_lines: how the line lengths of a key's first n frames are spread over bins of `width`, given once, when
    the n-th frame is there; frames after it are refused, and without it there is no row. frames: a row a frame, with an array
    of lengths. A stream takes frames as they come, and those of one micro-batch by `order`."""
    if not frames.isStreaming:
        w = W.partitionBy(key)
        taken = frames.withColumn("_r", F.row_number().over(w.orderBy(order))).withColumn("_n", F.count("*").over(w)).filter((F.col("_r") <= n) & (F.col("_n") >= n))
        return taken.select(key, F.explode(lengths).alias("_x")).groupBy(key, F.floor(F.col("_x") / width).cast("long").alias("bin")).agg(F.count("*").alias("n_lines"))
    kind = dict(frames.dtypes)[key]

    def work(keys, parts, state: GroupState):
        seen, bins = (state.get[0], dict(zip(state.get[1], state.get[2]))) if state.exists else (0, {})
        pdf = pd.concat(list(parts)).sort_values(order, kind="stable").head(max(0, n - seen))
        if not len(pdf):
            return
        for own in pdf[lengths]:
            for x in own:
                b = math.floor(x / width)
                bins[b] = bins.get(b, 0) + 1
        seen += len(pdf)
        full = seen >= n
        state.update((seen, [], []) if full else (seen, list(bins), list(bins.values())))
        if full:
            yield pd.DataFrame({key: keys[0], "bin": list(bins), "n_lines": list(bins.values())})

    return frames.select(key, order, lengths).groupBy(key).applyInPandasWithState(work, f"{key} {kind}, bin long, n_lines long", "seen int, bins array<long>, counts array<long>", "append", GroupStateTimeout.NoTimeout)


def write_once(path: str) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: each micro-batch is written under its number, in place of what an earlier try of it
    left, so that a restart repeats no row. read_written() reads what is there."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def read_written(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)
