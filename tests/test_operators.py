import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from linelake.operators import clustering, matching, pixels, planes, votes
from linelake.sources import frames, line_files, settings


def test_majority_ties_and_none(spark):
    df = spark.createDataFrame([(1, 5), (1, 3), (2, 7), (2, 7), (2, 1), (3, None)], "k int, label int")
    assert sorted(map(tuple, votes.majority(df, ["k"]).select("k", "label").collect())) == [(1, 3), (2, 7), (3, 0)]


def test_bounded_queue(spark):
    df = spark.createDataFrame([(1, v, i) for i, v in enumerate((3.0, 1.0, 2.0, 1.0))], "k int, v double, i int")
    assert [r.i for r in matching.bounded_queue(df, ["k"], "v", "i", 3).orderBy("rank").collect()] == [1, 3, 2]
    assert [r.i for r in matching.bounded_queue(df, ["k"], "v", "i", 1, False).collect()] == [0]


def test_best_by_ratio_of_equal_and_single(spark):
    df = spark.createDataFrame([(0, 1, 1, 1, 0.0), (0, 1, 1, 2, 0.0), (0, 1, 2, 1, 5.0), (0, 1, 3, 1, 1.0), (0, 1, 3, 2, 2.0)], "f1 long, f2 long, id1 long, id2 long, rating double")
    assert sorted((r.id1, r.id2) for r in matching.best_by_ratio(df).collect()) == [(2, 1), (3, 1)]


def test_kmeans_separates_cubes(spark):
    corners = [(x, y, z) for x in (0.0, 1.0) for y in (0.0, 1.0) for z in (0.0, 1.0)]
    df = spark.createDataFrame([(i, x + s, y, z) for s in (0.0, 30.0) for i, (x, y, z) in enumerate(corners)], "i int, x double, y double, z double")
    got = clustering.kmeans(df, ["x", "y", "z"], 2).select("x", "cluster").collect()
    assert len({r.cluster for r in got if r.x < 2}) == 1 and len({r.cluster for r in got}) == 2
    assert {r.cluster for r in clustering.kmeans(df.limit(2), ["x", "y", "z"], 5).collect()} == {0}


def test_components_do_not_depend_on_order(spark):
    edges = [(1, 2), (3, 2), (4, 5), (9, 4), (7, 7)]
    nodes = spark.createDataFrame([(i,) for i in range(1, 11)], "node long")
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 9: 4, 6: 6, 7: 7, 8: 8, 10: 10}
    for e in (edges, edges[::-1], [(b, a) for a, b in edges]):
        assert {r.node: r.component for r in clustering.components(spark.createDataFrame(e, "u long, v long"), nodes).collect()} == want


def test_planes(spark):
    points = [(0, float(x), float(y), 1.0) for x in range(3) for y in range(3)]
    r = planes.fit_planes(spark.createDataFrame([*points, (1, 0.0, 0.0, 0.0)], "k int, x double, y double, z double"), ["k"]).collect()
    assert len(r) == 1 and (r[0].a, r[0].b, r[0].c, r[0].d) == pytest.approx((0, 0, 1, -1), abs=1e-9)


def test_ransac_inliers_lie_on_a_plane(spark):
    rng = np.random.default_rng(0)
    flat = [(0, float(x), float(y), 0.0) for x, y in rng.random((40, 2))]
    df = spark.createDataFrame([*flat, *((0, *map(float, p)) for p in rng.random((5, 3)) + 1)], "k int, x double, y double, z double")
    got = planes.ransac(df, ["k"]).collect()
    assert len(got) == 40 and all(abs(r.z) < 0.005 for r in got)
    assert planes.ransac(df.limit(5), ["k"]).count() == 0


def test_single_linkage_and_mean_shift(spark):
    rows = [(0, i, float(i % 2) * 10 + i * 0.01, 0.0, 0.0, 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "k int, line_id int, x double, y double, z double, w double")
    for got in (clustering.single_linkage(df, ["k"], ["x", "y", "z"]).select("line_id", "cluster"), clustering.mean_shift(df, ["k"], ["x", "y", "z"], "w").select("line_id", "part")):
        parts = dict(map(tuple, got.collect()))
        assert len({parts[i] for i in range(0, 10, 2)}) == 1 and len(set(parts.values())) == 2


def test_inliers_drop_zero_depth(spark):
    cloud = spark.createDataFrame([(0, u, v, float(u), float(v), 0.0 if (u, v) == (0, 0) else float("nan") if u == 2 else 1.0) for u in range(4) for v in range(4)], "frame_id int, u int, v int, x double, y double, z double")
    px = spark.createDataFrame([(0, 1, 1, 1), (0, 1, 2, 2), (0, 2, 0, 0), (0, 2, 1, 2)], "frame_id int, line_id int, u int, v int")
    assert {(r.line_id, r.u) for r in pixels.inliers(px, cloud, ["line_id"]).collect()} == {(1, 1)}


def test_merge_lines(spark):
    df = spark.createDataFrame([(0, 1, 0.0, 0.0, 10.0, 10.0), (0, 2, 10.0, 10.0, 30.0, 30.0), (0, 3, 0.0, 50.0, 90.0, 50.0)], "f int, line_id int, x0 double, y0 double, x1 double, y1 double")
    assert sorted((r.line_id, r.x1) for r in clustering.merge_lines(df, ["f"]).collect()) == [(1, 30.0), (3, 90.0)]


def test_line_files_round_trip(spark, tmp_path):
    names = line_files.DETECTION
    row = {n: (1 if n in line_files._WHOLE else 0.5) for n in names}
    df = spark.createDataFrame([tuple(row[n] for n in names)], ", ".join(f"{n} {'int' if n in line_files._WHOLE else 'double'}" for n in names)).withColumn("frame_id", F.lit(7))
    assert len(names) == 38
    line_files.write_detection(df, str(tmp_path / "d"))
    got = line_files.read_detection(spark, str(tmp_path / "d" / "frame_id=7")).select(*names).first()
    assert got.asDict() == row
    (tmp_path / "e_3.txt").write_text("")
    assert line_files.read_detection(spark, str(tmp_path / "e_3.txt")).count() == 0


def test_training_file_has_trailing_space(spark, tmp_path):
    path = tmp_path / "scene_frame_12"
    path.write_text("a/b.png " + " ".join(["0.5"] * 12) + " True False 3 1 4 12 " + " ".join(["0.25"] * 7) + " \n")
    r = line_files.read_training(spark, str(path)).first()
    assert (r.image_path, r.open1, r.open2, r.label, r.frame, r.qw, r.frame_id) == ("a/b.png", True, False, 3, 12, 0.25, 12)


def test_poses(spark, tmp_path):
    rows = [f"{i}.5 " + " ".join(str(float(k)) for k in range(9)) for i in range(4)]
    (tmp_path / "cam").write_text("#\n#\n#\n" + "\n".join(rows) + "\n")
    got = frames.read_poses(spark, str(tmp_path / "cam")).orderBy("frame_id").collect()
    assert [(r.frame_id, r.stamp, r.eyex, r.upz) for r in got] == [(0, 500_000_000, 0.0, 8.0), (1, 2_500_000_000, 0.0, 8.0)]


def test_settings():
    assert settings.LineSettings().match_ratio == 0.8
    with pytest.raises(ValueError):
        settings.LineSettings(match_ratio=2.0)
    assert settings.read_settings("a 1\nb x y # c\na -2") == {"a": -2, "b": "x y"}


def test_adapters_check_their_topics(spark):
    t = spark.createDataFrame([(0, 1)], "scene_id int, stamp int")
    with pytest.raises(ValueError):
        frames.adapt("scenenn", [t])
    assert frames.adapt("scenenet", [t.withColumn(f"c{i}", F.lit(i)) for i in range(5)]).count() == 1


def test_length_histogram_leaves_out_what_lies_above(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.2, 0.2)], "v double")
    got = votes.length_histogram(df, "v", 0.1).orderBy("bin").collect()
    assert sum(r.n for r in got) == 2 and math.isclose(sum(r.density for r in got) * 0.1, 1.0)


def test_lines_are_lifted_from_a_roof(spark):
    cloud = spark.range(240 * 320).select(F.lit(0).alias("frame_id"), (F.col("id") % 320).cast("int").alias("u"), F.floor(F.col("id") / 320).cast("int").alias("v"))
    depth = F.when(F.col("u") <= 160, F.col("u")).otherwise(320 - F.col("u"))
    cloud = cloud.select("*", (F.col("v") * 0.01).alias("x"), (depth * 0.01).alias("y"), (depth * 0.01).alias("z"))
    line = spark.createDataFrame([(0, 1, 160.0, 100.0, 160.0, 200.0)], "frame_id int, line_id int, x0 double, y0 double, x1 double, y1 double")
    for r in (pixels.lifted_ends(line, cloud, ["line_id"]).first(), pixels.lifted(line, cloud, 320, 240).first()):
        assert (r.sx, r.sy, r.sz, r.ex, r.ey, r.ez) == pytest.approx((1, 1.6, 1.6, 2, 1.6, 1.6), abs=1e-5)


def test_segment_distances_agree(spark, sf):
    from linelake.functions import geometry as G
    from linelake.operators.lines import segment_distances
    from linelake.plans.carriers import Carriers

    df = segment_distances(Carriers(spark, sf).pair.limit(500)).withColumn("other", G.segment_distance(G.start("a"), G.end("a"), G.start("b"), G.end("b")))
    assert df.agg(F.max(F.abs(F.col("distance") - F.col("other")))).first()[0] < 1e-9
