"""Scenes from files, descriptors by path, models as hooks."""

import numpy as np
from pyspark.sql import functions as F

from linelake.operators import batches, inference
from linelake.sources import line_files as S


def row(i, frame, label):
    return " ".join(map(str, [f"img_{i}.png", *[float(i)] * 6, *[0.5] * 6, "True", "False", label, 2, 7, frame, *[0.0] * 6, 1.0])) + " "


def test_scenes_with_another_lighting(spark, tmp_path):
    for base, scene, frame, n in (("a", "s1", 3, 2), ("a", "s1", 12, 1), ("a", "s2", 3, 0), ("a", "s3", 4, 3), ("a_random", "s1", 3, 4), ("a_random", "s9", 3, 4)):
        folder = tmp_path / base / scene
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{scene}_frame_{frame}").write_text("".join(row(i, frame, i + 1) + "\n" for i in range(n)))
    one = S.load_scenes(spark, str(tmp_path / "a"))
    assert {(x.scene, x.frame_id, x.n) for x in one.groupBy("scene", "frame_id").agg(F.count("*").alias("n")).collect()} == {("s1", 3, 2), ("s1", 12, 1), ("s3", 4, 3)}
    first = one.filter("scene = 's3'").orderBy("line_id").collect()
    assert [(x.line_id, x.sx, x.label, x.open1, x.open2, x.qw) for x in first] == [(i, float(i), i + 1, True, False, 1.0) for i in range(3)]
    both = S.load_scenes(spark, str(tmp_path / "a"), other_lighting=True)
    assert {(x.lighting, x.scene, x.n) for x in both.groupBy("lighting", "scene").agg(F.count("*").alias("n")).collect()} == {("normal", "s1", 3), ("normal", "s3", 3), ("random", "s1", 4)}


def test_descriptors_by_path(spark):
    frames = spark.createDataFrame([("s", "normal", 2), ("s", "random", 2), ("s", "normal", 9)], "scene string, lighting string, frame_id int")
    known = spark.createDataFrame([("/a/s/cam0/data/2.png", [1.0]), ("/a/s/random_lighting_cam0/data/2.png", [2.0]), ("/a/s/cam0/data/9.jpg", [3.0])], "path string, descriptor array<double>")
    assert {(x.lighting, x.frame_id, tuple(x.descriptor or ())) for x in S.with_descriptors(frames, known).collect()} == {("normal", 2, (1.0,)), ("random", 2, (2.0,)), ("normal", 9, ())}


def test_models_are_hooks(spark):
    df = spark.createDataFrame([(i, None if i == 3 else [float(i), 1.0]) for i in range(10)], "k long, x array<double>").repartition(3)

    def load():
        w = np.array([[1.0, 0.0, 2.0], [0.0, 1.0, 0.0]], np.float32)
        return lambda x: x @ w

    got = {x.k: x.embedding for x in inference.predict(df, load, "x", normalise=True, batch=2).collect()}
    assert got[3] is None
    for k in (0, 1, 9):
        want = np.array([k, 1.0, 2 * k]) / np.linalg.norm([k, 1.0, 2 * k])
        assert np.allclose(got[k], want, atol=1e-6)


def test_clusters_of_padded_frames(spark):
    names = [*batches.ENDS, *batches.NORMALS]
    df = spark.createDataFrame([(0, f, f * 10 + i, i, 5, *[float(i)] * 12, True, False) for f in range(2) for i in range(3 + f)], ", ".join(["scene_id long", "frame_id long", "line_id long", "label int", "class_id int", *[f"{c} double" for c in names], "open1 boolean", "open2 boolean"]))
    frames = batches.frame_inputs(df, [0], most_lines=6, most_clusters=3)

    def load():
        # the class of a line is its place in the frame modulo 2
        return lambda x: np.tile(np.eye(2, dtype=np.float32)[np.arange(6) % 2].ravel(), (len(x), 1))

    got = {x.frame_id: x.clusters for x in inference.clusters_of_frames(frames, load).collect()}
    assert got == {0: [0, 1, 0, -1, -1, -1], 1: [0, 1, 0, 1, -1, -1]}
