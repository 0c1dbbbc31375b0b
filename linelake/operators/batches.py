"""Frames and clusters as training input: fixed shapes, masks, and numbered batches.

Lines have scene_id, frame_id, line_id (their order in the frame), label, class_id and geometry columns. What is
collected are the lines of one frame and the clusters of one instance of a scene, which the data model bounds; frames are
numbered without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linelake.plans.session import checkpointed

NORMALS = tuple(f"n{k}{c}" for k in "12" for c in "xyz")
ENDS = ("sx", "sy", "sz", "ex", "ey", "ez")
#: The columns of a line's geometry, in their order; the line's length comes last.
GEOMETRY = (*ENDS, *NORMALS, "open1", "open2", "length")


def numbered(df: DataFrame, order: list[Column | str], name: str = "number", start: Column | int = 0) -> DataFrame:
    """df with dense numbers from `start` on in an order that has no ties: rows are sorted over ranges, of which the
    driver learns the sizes alone (a row a range)."""
    own = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    sizes = own.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    at, offsets = 0, []
    for x in sizes:
        offsets.append((x.part, at))
        at += x.n
    known = F.broadcast(df.sparkSession.createDataFrame(offsets, "_part long, _base long"))
    rows = own.withColumn("_part", part).join(known, "_part")
    place = F.col("_base") + F.col("_m").bitwiseAND((1 << 33) - 1)
    return rows.withColumn(name, place + start).drop("_m", "_part", "_base")


def valid_frames(lines: DataFrame, background: list[int], least: int = 30) -> DataFrame:
    """scene_id, frame_id, n_lines, n_clusters of the frames with more than `least` lines and a cluster that is no background."""
    real = ~F.col("class_id").isin(background)
    counted = lines.groupBy("scene_id", "frame_id").agg(F.count("*").alias("n_lines"), F.count_distinct(F.when(real, F.col("label"))).alias("n_clusters"))
    return counted.filter((F.col("n_lines") > least) & (F.col("n_clusters") > 0))


def training_plan(frames: DataFrame, batch_size: int, seed: int | None = None) -> DataFrame:
    """frames with number and batch: in the order of scenes and frames, or, with a seed, in a scattered order that is
    the same in every run."""
    order = ["scene_id", "frame_id"] if seed is None else [F.xxhash64(F.lit(seed), "scene_id", "frame_id"), "scene_id", "frame_id"]
    return numbered(frames, order).withColumn("batch", F.expr(f"number div {batch_size}"))


def scene_clusters(lines: DataFrame, background: list[int], least: int = 5) -> DataFrame:
    """scene_id, label, class_id, n_clusters, clusters (frame_id, instance, lines; by frame): the clusters of `least` or
    more lines that are no background themselves, by instance over the frames of a scene. The class of a cluster is that of its first line; clusters of
    background classes are all of label 0. An instance's class is that of its first cluster, the largest of its first frame."""
    real = ~F.col("class_id").isin(background)
    each = lines.groupBy("scene_id", "frame_id", "label").agg(F.count_if(real).alias("n"), F.min_by("class_id", "line_id").alias("class_id"), F.array_sort(F.collect_list("line_id")).alias("lines"))
    each = each.filter(F.col("n") >= least).withColumn("instance", F.col("label")).withColumn("label", F.when(F.col("class_id").isin(background), 0).otherwise(F.col("label")))
    held = F.struct("frame_id", "instance", "lines")
    first = F.struct("frame_id", -F.col("n"), "instance")
    return each.groupBy("scene_id", "label").agg(F.min_by("class_id", first).alias("class_id"), F.count("*").alias("n_clusters"), F.array_sort(F.collect_list(held)).alias("clusters"))


def _padded(column: str, size: int, fill: Column) -> Column:
    return F.concat(F.col(column), F.array_repeat(fill, F.lit(size) - F.size(column)))


def frame_inputs(lines: DataFrame, background: list[int], most_lines: int = 300, most_clusters: int = 30, mean: tuple[float, float, float] = (0.0, 0.0, 3.0), scale: float = 2.0, seed: int = 0) -> DataFrame:
    """scene_id, frame_id, n_lines, lines (most_lines rows of GEOMETRY), labels, valid, background (most_lines each),
    unique_labels (most_clusters), cluster_count of each frame.

    Of a frame with more lines, those with the smallest hashes of (seed, line) stay, in their order. Ends lose the mean and are divided by
    the scale; the length is that of the result. Labels are numbered from 1 in their order; background lines have 0. Padding is 0 and false,
    but for unique_labels, whose padding is -1; where class 0 is background, padding counts as background too."""
    chosen = F.row_number().over(W.partitionBy("scene_id", "frame_id").orderBy(F.xxhash64(F.lit(seed), "line_id"), "line_id"))
    some = lines.withColumn("_r", chosen).filter(F.col("_r") <= most_lines)
    moved = {c: (F.col(c) - mean["xyz".index(c[1])]) / scale for c in ENDS}
    number = F.dense_rank().over(W.partitionBy("scene_id", "frame_id").orderBy("label"))
    behind = F.col("class_id").isin(background)
    some = some.withColumns(moved | {"_number": number, "_behind": behind})
    length = F.sqrt(sum(((F.col(f"e{c}") - F.col(f"s{c}")) * (F.col(f"e{c}") - F.col(f"s{c}")) for c in "xyz"), F.lit(0.0)))
    row = F.array(*[F.col(c).cast("double") for c in (*ENDS, *NORMALS)], F.col("open1").cast("double"), F.col("open2").cast("double"), length)
    line = F.struct("line_id", row.alias("g"), F.when(F.col("_behind"), 0).otherwise(F.col("_number")).alias("label"), F.col("_behind").alias("behind"))
    frames = some.groupBy("scene_id", "frame_id").agg(F.array_sort(F.collect_list(line)).alias("l"))
    zero, none = F.array_repeat(F.lit(0.0), len(GEOMETRY)), F.lit(0 in background)
    frames = frames.select("scene_id", "frame_id", F.size("l").alias("n_lines"), F.col("l.g").alias("g"), F.col("l.label").alias("label"), F.col("l.behind").alias("behind"))
    unique = F.array_sort(F.array_distinct(F.filter("label", lambda x: x > 0)))
    frames = frames.withColumn("unique", unique)
    return frames.select(
        "scene_id", "frame_id", "n_lines", _padded("g", most_lines, zero).alias("lines"), _padded("label", most_lines, F.lit(0)).alias("labels"),
        F.concat(F.array_repeat(F.lit(True), F.col("n_lines")), F.array_repeat(F.lit(False), F.lit(most_lines) - F.col("n_lines"))).alias("valid"), _padded("behind", most_lines, none).alias("background"),
        F.slice(F.concat(F.col("unique"), F.array_repeat(F.lit(-1), most_clusters)), 1, most_clusters).alias("unique_labels"), F.size("unique").alias("cluster_count"),
    )


def line_batches(lines: DataFrame, background: list[int], batch_size: int, least: int = 30, seed: int | None = None, **how) -> DataFrame:
    """frame_inputs of the valid frames, with their number and batch."""
    plan = training_plan(valid_frames(lines, background, least), batch_size, seed).select("scene_id", "frame_id", "number", "batch")
    return frame_inputs(lines.join(plan.select("scene_id", "frame_id"), ["scene_id", "frame_id"], "left_semi"), background, **how).join(plan, ["scene_id", "frame_id"])


def new_labels(parts: DataFrame, keys: list[str], label: str = "label", part: str = "part", reserved: int = 65_535) -> DataFrame:
    """parts (keys, label, part: 0 for the part that keeps its label, 1 .. for those split off) with new_label: parts
    that are split off are numbered from one more than the greatest label but the reserved one, in the order of keys, label and part. Rows of one
    (keys, label, part) get one number; parts of the reserved label are numbered like others."""
    greatest = parts.filter(F.col(label) != reserved).agg(F.coalesce(F.max(label), F.lit(0)).cast("long")).first()[0]
    split = parts.filter(F.col(part) > 0).select(*keys, label, part).distinct()
    given = numbered(split, [*keys, label, part], "_new", greatest + 1)
    known = [F.col(c).alias(f"_{c}") for c in (*keys, label, part)]
    same = None
    for c in (*keys, label, part):
        own = parts[c].eqNullSafe(F.col(f"_{c}"))
        same = own if same is None else same & own
    return parts.join(given.select(*known, "_new"), same, "left").select(*parts.columns, F.coalesce("_new", F.col(label).cast("long")).alias("new_label"))
