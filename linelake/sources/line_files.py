"""Text line files: detection files (38 columns), training files (26 fields and a trailing space), 2-D files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_XYZ = "xyz"
#: Columns of a detection file, in order: a fixed format.
DETECTION = (
    [f"s{c}" for c in _XYZ] + [f"e{c}" for c in _XYZ] + [f"h1{c}" for c in "abcd"] + [f"h2{c}" for c in "abcd"] + [f"c1{c}" for c in "rgb"] + [f"c2{c}" for c in "rgb"]
    + ["type", "label", "class_id"] + [f"n1{c}" for c in _XYZ] + [f"n2{c}" for c in _XYZ] + ["open1", "open2"] + [f"o{c}" for c in _XYZ] + ["qx", "qy", "qz", "qw"]
)
_WHOLE = {"type", "label", "class_id", "open1", "open2", "frame"} | {f"c{k}{c}" for k in (1, 2) for c in "rgb"}
#: Columns of a training file, in order: a fixed format.
TRAINING = ["image_path"] + [f"s{c}" for c in _XYZ] + [f"e{c}" for c in _XYZ] + [f"n1{c}" for c in _XYZ] + [f"n2{c}" for c in _XYZ] + ["open1", "open2", "label", "type", "class_id", "frame"] + [f"o{c}" for c in _XYZ] + ["qx", "qy", "qz", "qw"]
PLANE_2D = ["x0", "y0", "x1", "y1"]


def _schema(names: list[str], text: set[str] = frozenset()) -> str:
    return ", ".join(f"{n} {'string' if n in text else 'int' if n in _WHOLE else 'double'}" for n in names)


def frame_of(path: Column | str) -> Column:
    """Frame number at the end of a file's name."""
    return F.regexp_extract(path, r"_(\d+)(?:\.\w+)?$", 1).try_cast("int") if hasattr(Column, "try_cast") else F.regexp_extract(path, r"_(\d+)(?:\.\w+)?$", 1).cast("int")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    df = spark.read.schema(schema).option("sep", " ").csv(path)
    return df.withColumn("file", F.col("_metadata.file_path")).withColumn("frame_id", frame_of("file"))


def read_detection(spark: SparkSession, path: str) -> DataFrame:
    """Lines of detection files; empty files give none."""
    return _read(spark, path, _schema(DETECTION))


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """Lines of training files. open1 and open2 are written as True and False."""
    schema = _schema(TRAINING, {"image_path", "open1", "open2"}) + ", trailing string"
    df = _read(spark, path, schema).drop("trailing")
    return df.withColumns({c: F.col(c) == "True" for c in ("open1", "open2")})


def read_2d(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, _schema(PLANE_2D))


def as_records(lines: DataFrame) -> DataFrame:
    """Detection rows as nested records."""
    pack = lambda name, *cols: F.struct(*cols).alias(name)
    return lines.select(
        "frame_id", pack("start", "sx", "sy", "sz"), pack("end", "ex", "ey", "ez"), F.array(pack("h", *[F.col(f"h1{c}").alias(c) for c in "abcd"]), pack("h", *[F.col(f"h2{c}").alias(c) for c in "abcd"])).alias("hessians"),
        "type", "label", "class_id", pack("pose", "ox", "oy", "oz", "qx", "qy", "qz", "qw"),
    )


def frame_poses(lines: DataFrame) -> DataFrame:
    """The pose of each file's first line."""
    pose = [f"o{c}" for c in _XYZ] + ["qx", "qy", "qz", "qw"]
    return lines.withColumn("_row", F.monotonically_increasing_id()).groupBy("frame_id").agg(*[F.min_by(c, "_row").alias(c) for c in pose])


def write_detection(lines: DataFrame, path: str, mode: str = "ignore") -> None:
    """One folder per frame of space-separated detection rows."""
    lines.select("frame_id", *DETECTION).repartition("frame_id").write.mode(mode).partitionBy("frame_id").option("sep", " ").csv(path)


def write_training(lines: DataFrame, path: str, mode: str = "ignore") -> None:
    """Training rows, each with the trailing space that readers expect; existing output stays."""
    as_text = lines.withColumns({c: F.when(F.col(c), "True").otherwise("False") for c in ("open1", "open2")})
    rows = as_text.select("frame_id", F.concat(F.concat_ws(" ", *[F.col(c).cast("string") for c in TRAINING]), F.lit(" ")).alias("value"))
    rows.repartition("frame_id").write.mode(mode).partitionBy("frame_id").text(path)


def write_2d(lines: DataFrame, path: str, mode: str = "ignore") -> None:
    lines.select(*PLANE_2D).write.mode(mode).option("sep", " ").csv(path)


def with_images(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Lines whose image exists (column image_path in both)."""
    return lines.join(files.select("image_path"), "image_path", "left_semi")


def not_yet(manifest: DataFrame, done: DataFrame, key: str = "name", most: int | None = None) -> DataFrame:
    """Entries of a manifest that are not among those done, in order, at most `most`."""
    left = manifest.join(done.select(key), key, "left_anti").orderBy(key)
    return left if most is None else left.limit(most)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Predictions with their labels, geometries, backgrounds and validities, in folders by scene."""
    predictions.write.mode("overwrite").partitionBy("scene_id").parquet(path)


def load_scenes(spark: SparkSession, path: str, other_lighting: bool = False) -> DataFrame:
    """Training lines of all scenes below a folder (path/scene/..._frame_number), with scene, lighting and line_id, the place of a
    line in its file from 0 on. With other_lighting, the frames of the folder's sibling `<path>_random` are there too (lighting
    'random'), of those scenes that the folder has. Empty files give no lines; frames with one number in both are told apart
    by lighting. Line numbers come from the places of rows in their files, so files are read whole."""
    schema = _schema(TRAINING, {"image_path", "open1", "open2"}) + ", trailing string"

    def read(folder: str, lighting: str) -> DataFrame:
        name = F.element_at(F.split(F.col("file"), "/"), -2)
        rows = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
        lines_ = rows.select(name.alias("scene"), F.lit(lighting).alias("lighting"), "file", F.posexplode(F.split("value", "\n")).alias("line_id", "row")).filter("trim(row) <> ''")
        return lines_.withColumn("r", F.from_csv("row", schema, {"sep": " "})).select("scene", "lighting", "file", frame_of("file").alias("frame_id"), F.col("line_id").cast("long").alias("line_id"), "r.*").drop("trailing")

    lines = read(path, "normal")
    if other_lighting:
        more = read(f"{path.rstrip('/')}_random", "random")
        lines = lines.unionByName(more.join(lines.select("scene").distinct(), "scene", "left_semi"))
    return lines.withColumns({c: F.col(c) == "True" for c in ("open1", "open2")})


def with_descriptors(frames: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Frames (scene, lighting, frame_id) with the descriptor of their raw image (path, descriptor), which lies at
    scene/cam0/data/frame.png, or under random_lighting_cam0 for the other lighting. Frames without one keep a null."""
    part = lambda k: F.regexp_extract("path", r"([^/]+)/(random_lighting_)?cam0/data/(\d+)\.png$", k)
    known = descriptors.select(part(1).alias("scene"), F.when(part(2) == "", "normal").otherwise("random").alias("lighting"), part(3).alias("_frame"), "descriptor").filter("_frame <> ''")
    known = known.withColumn("frame_id", F.col("_frame").cast("int")).drop("_frame")
    return frames.join(known, ["scene", "lighting", "frame_id"], "left")
