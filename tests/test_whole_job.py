"""Queries that once read a part of their input, on small tables of their own."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from linelake.operators import lines, planes
from linelake.plans import line_queries, relational_queries


def embeddings(tmp_path, vectors):
    pd.DataFrame({"vec_id": np.arange(len(vectors)), "embedding": [np.asarray(v, np.float32) for v in vectors], "label": np.arange(len(vectors), dtype=np.int32) % 10}).to_parquet(tmp_path / "embeddings.parquet")
    return str(tmp_path)


def medoids_by_force(x, k):
    medoids = list(range(min(k, len(x))))
    while True:
        own = [min(medoids, key=lambda m: (abs(a - x[m]), m)) for a in x]
        new = sorted(min((i for i, o in enumerate(own) if o == m), key=lambda i: (sum(abs(x[i] - x[j]) for j, o in enumerate(own) if o == m), i)) for m in set(own))
        if new == medoids:
            return own
        medoids = new


def test_kmedoids_clusters_every_line(spark, tmp_path):
    rng = np.random.default_rng(4)
    vectors = np.zeros((227, 64))
    vectors[:, 0] = rng.permutation(227) * 37 % 500 / 512  # exact in binary
    got = {r.id: r.medoid for r in relational_queries.QUERIES["kmedoids"](spark, embeddings(tmp_path, vectors)).collect()}
    want = {}
    for frame in range(0, 227, 25):
        want |= {frame + i: frame + m for i, m in enumerate(medoids_by_force(vectors[frame : frame + 25, 0].tolist(), 3))}
    assert got == want


def test_ransac_takes_no_patches_across_a_gap(spark):
    grid = [(x * 0.02, y * 0.02) for x in range(5) for y in range(5)]
    apart = [(x + s, y, 0.0) for s in (0.0, 1.0) for x, y in grid]  # 50 points in two patches on z = 0
    whole = [(x * 0.02, 3.0, 1.0 + z * 0.02) for x in range(6) for z in range(5)]  # 30 points in one patch on y = 3
    df = spark.createDataFrame([(k, *p) for k, own in ((0, apart + whole), (1, apart), (2, whole)) for p in own], "k int, x double, y double, z double")
    got = planes.ransac(df, ["k"], gap=0.05).collect()
    assert {tuple(r)[1:] for r in got if r.k == 0} == set(whole)
    assert not [r for r in got if r.k == 1]
    assert {tuple(r)[1:] for r in got if r.k == 2} == set(whole)


def test_descriptor_vocabulary_sees_all_dimensions(spark, tmp_path):
    vectors = np.random.default_rng(5).normal(0, 0.01, (40, 64))
    vectors[::2, 20] += 0.8  # two kinds that agree in the first 16 dimensions
    vectors[1::2, 63] += 0.8
    got = {r.line_id: r.cluster for r in line_queries.QUERIES["descriptor_vocabulary"](spark, embeddings(tmp_path, vectors)).collect()}
    assert len(got) == 40 and not {got[i] for i in range(0, 40, 2)} & {got[i] for i in range(1, 40, 2)}


def test_strip_colours_follow_each_line(spark, tmp_path):
    vectors = np.zeros((2, 64))
    vectors[0, :5] = [-0.375, 0.25, 0, -0.125, 0.25]  # pixels (40, 180) to (120, 180)
    vectors[1, :5] = [0.25, -0.25, 0, 0.375, -0.25]  # (240, 60) to (280, 60)
    points = [(60, 183, 2), (61, 183, 4), (60, 177, 5), (250, 62, 1), (250, 100, 7), (105, 100, 7)]  # u, v, class; the instance is v % 16
    pd.DataFrame({"l_orderkey": 0, "l_partkey": [p[0] for p in points], "l_suppkey": [p[1] for p in points], "l_linenumber": np.array([p[2] for p in points], np.int32), "l_quantity": 1.0, "l_extendedprice": 1.0}).to_parquet(tmp_path / "lineitem.parquet")
    got = {(r.line_id, r.side): (r.r, r.g) for r in line_queries.QUERIES["strip_colours"](spark, embeddings(tmp_path, vectors)).collect()}
    assert got == {(0, 1): (90, 183 % 16), (0, 0): (150, 177 % 16), (1, 1): (30, 62 % 16)}


def test_approximate_neighbours_recall(spark):
    centres = np.random.default_rng(6).normal(size=(12, 64))
    x = np.repeat(centres, 20, 0) + np.random.default_rng(7).normal(0, 0.7, (240, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "line_id long, embedding array<double>")
    got = {(r.u, r.v): r.distance for r in lines.approximate_neighbours(df, "embedding", "line_id", 1.2).collect()}
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    want = {(u, v) for u in range(240) for v in range(u + 1, 240) if d[u, v] <= 1.2}
    assert set(got) <= want and len(got) >= 0.9 * len(want) > 0
    assert all(abs(far - d[k]) < 1e-9 for k, far in got.items())


def test_greedy_matching_ends_on_long_chains(spark):
    from linelake.operators import matching

    rows = [(1, 2, i, i, float(2 * i - 1)) for i in range(1, 221)] + [(1, 2, i + 1, i, float(2 * i)) for i in range(1, 220)]
    found = spark.createDataFrame(rows, "f1 long, f2 long, id1 long, id2 long, rating double")
    a, b = (sorted(map(tuple, f(found).collect())) for f in (matching.greedy, matching.greedy_in_frames))
    assert len(a) == 220 and a == b


def test_nearest_elsewhere_by_force(spark):
    import random

    from linelake.operators import matching

    r = random.Random(1)
    rows = [(i, i // 5, i % 3, [round(r.random(), 1) for _ in range(3)]) for i in range(60)] + [(100, 70, 0, [0.5, 0.5, 0.5]), (101, 71, 0, [0.5, 0.5, 0.5])]
    df = spark.createDataFrame(rows, "line_id long, frame_id long, floor_id long, embedding array<float>")
    wide = {i: [float(x) for x in v] for i, *_, v in df.collect()}
    for k, block in ((1, 4096), (4, 9), (2, 1)):
        want = set()
        for i, f, g, _ in rows:
            d = sorted((sum((a - b) ** 2 for a, b in zip(wide[i], wide[j])), j) for j, *_ in rows)[: 2 * k + 1]
            near = [(j, rank) for rank, j in enumerate((j for _, j in d if dict((x[0], x[1]) for x in rows)[j] != f), 1)][:k]
            want |= {(i, j, rank) for j, rank in near}
        got = matching.nearest_elsewhere(df, k, 3, block_rows=block)
        assert {(x.id1, x.id2, x["rank"]) for x in got.collect()} == want
    assert matching.nearest_elsewhere(df.limit(0), 2, 3).count() == 0


def test_nearest_in_blocks_by_force():
    from linelake.operators import blocks

    r = np.random.default_rng(9)
    missing = r.normal(1e3, 1e-9, (5000, 5))
    missing[17] = np.nan
    for a, b in (
        (r.normal(size=(300, 64)).astype(np.float32), r.normal(size=(6000, 64)).astype(np.float32)),
        (r.random((300, 3)).round(1).astype(np.float32), r.random((6000, 3)).round(1).astype(np.float32)),  # many ties
        (missing[15:20], missing), (r.normal(size=(9, 4)) * 1e200, r.normal(size=(5000, 4)) * 1e200), (missing[:3], missing[:5]),
    ):
        ids, d = r.permutation(len(b)), np.zeros((len(a), len(b)))
        with np.errstate(all="ignore"):
            for j in range(a.shape[1]):
                d += (a[:, j, None].astype(np.float64) - b[None, :, j]) ** 2
        want = {(i, int(j), d[i, j].tobytes()) for i in range(len(a)) for j in np.lexsort((ids, d[i]))[:9]}
        got = blocks.nearest(blocks.Block(a), blocks.Block(b), ids, 9)
        assert {(int(i), int(j), x.tobytes()) for i, j, x in zip(*got)} == want
        near = {(i, j, d[i, j].tobytes()) for i, j in np.argwhere(d <= 0.5).tolist()}
        got = {(int(i), int(j), x.tobytes()) for part in blocks.within(blocks.Block(a), blocks.Block(b), 0.5) for i, j, x in zip(*part)}
        assert near <= got


def test_nearest_sends_a_row_to_few_blocks():
    from linelake.operators import matching

    assert sum(matching.block_counts(120_000, 64, 24)) <= 25
    assert sum(matching.block_counts(720_000, 64, 24)) <= 25  # blocks of 4,096 rows would be 352


def test_code_of_coinciding_lines_compiles(spark, sf):
    from linelake.plans.geometry_queries import QUERIES

    spark.conf.set("spark.sql.codegen.fallback", "false")
    spark.conf.set("spark.sql.codegen.factoryMode", "CODEGEN_ONLY")
    try:
        assert QUERIES["lines_coincide"](spark, sf).count() > 0
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
        spark.conf.unset("spark.sql.codegen.factoryMode")


def test_labels_sampled_along_lines(spark):
    from linelake.operators import votes

    lines = spark.createDataFrame([(1, 7, -0.5, 0.0, 1.0, 0.5, 0.0, 1.0), (2, 7, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0), (3, 8, 5.0, 5.0, 1.0, 9.0, 9.0, 1.0)], "line_id long, frame_id long, sx double, sy double, sz double, ex double, ey double, ez double")
    image = spark.createDataFrame([(7, u, 5, 4 if u < 3 else 2) for u in range(7)] + [(8, 9, 9, 6)], "frame_id long, u long, v long, label long")
    got = {x.line_id: (x.label, x.votes) for x in votes.sampled_labels(lines, image, ["line_id"], (10.0, 10.0, 5.0, 5.0), (10, 10)).collect()}
    # line 1 sees columns 0 .. 9 and the border: three times 4, four times 2, four times nothing, which is 0
    assert got == {1: (0, 11), 2: (2, 11), 3: (6, 11)}


def test_plane_labels(spark):
    from linelake.operators import votes

    rows = [(1, 0, 5, 0.0, 0.0, 1.0), (1, 0, 5, 0.0, 0.0, 3.0), (1, 0, 6, 0.0, 0.0, 2.0), (1, 1, 8, 0.0, 0.0, 4.0), (2, 0, 3, 1.0, 0.0, 0.0), (2, 1, 4, 0.0, 1.0, 0.0), (3, 0, 9, 1.0, 1.0, 1.0)]
    p = spark.createDataFrame(rows, "line_id long, side int, label long, x double, y double, z double")
    near, far = ({x.line_id: x.label for x in votes.plane_label(p, ["line_id"], f).collect()} for f in (False, True))
    assert near == {1: 5, 2: 4, 3: 9} and far == {1: 8, 2: 4, 3: 9}


def test_unknown_instances_are_an_error(spark):
    import pytest

    from linelake.operators import votes

    classes = spark.createDataFrame([(1, 10), (2, 20)], "label long, class_id long")
    lines = spark.createDataFrame([(1, 1), (2, 0), (3, 2)], "line_id long, label long")
    assert {x.line_id: x.class_id for x in votes.class_of_instance(lines, classes, ["label"]).collect()} == {1: 10, 2: 0, 3: 20}
    with pytest.raises(Exception, match="no class of instance 7"):
        votes.class_of_instance(spark.createDataFrame([(1, 7)], "line_id long, label long"), classes, ["label"]).collect()


def test_predictions_round_trip(spark, tmp_path):
    from linelake.sources.line_files import write_predictions

    df = spark.createDataFrame([(0, 1, 5, 2, True, False), (1, 2, 6, 6, False, True)], "scene_id int, line_id int, label int, prediction int, background boolean, valid boolean")
    write_predictions(df, f"file://{tmp_path}/p")
    assert sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/p").select(*df.columns).collect())) == sorted(map(tuple, df.collect()))


def test_place_recognition_searches_once(spark, sf):
    plan = relational_queries.QUERIES["place_recognition"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_first_of_others_by_force(spark):
    import random

    from linelake.operators import votes

    r = random.Random(3)
    rows = [(r.choice(range(40)), r.choice([None, 0, 1, 2]), r.choice([None, 0, 1, 2])) for _ in range(70)]  # keys repeat
    df = spark.createDataFrame(rows, "k long, g long, a long")
    got = votes.first_of_others(df, df.withColumnRenamed("k", "o"), "k", ["g"], "a", "o", F.struct(F.col("o") * 7 % 11, "o"))
    want = {}
    for k in {x[0] for x in rows}:
        ok = [o for o, g, a in rows for k2, g2, a2 in rows if k2 == k and None not in (g, a, a2) and g == g2 and a != a2]
        want |= {k: min(ok, key=lambda o: (o * 7 % 11, o))} if ok else {}
    assert {x.k: x.o for x in got.collect()} == want


def test_triplets_make_no_pairs(spark, sf):
    plan = relational_queries.QUERIES["triplets"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "AND NOT (f" not in plan  # rows of a label are never all joined with each other


def test_approximate_neighbours_in_blocks(spark):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    x = np.random.default_rng(8).normal(0, 0.2, (300, 8))
    x[7] = x[9]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(3, x[3].tolist())], "line_id long, embedding array<double>")
    rows = df.distinct().select("line_id", array_to_vector("embedding").alias("f"))
    model = BucketedRandomProjectionLSH(inputCol="f", outputCol="h", numHashTables=4, bucketLength=0.5, seed=1).fit(rows)
    pairs = model.approxSimilarityJoin(rows, rows, 0.6, "d").filter("datasetA.line_id < datasetB.line_id")
    want = sorted((r.datasetA.line_id, r.datasetB.line_id, r.d) for r in pairs.collect())
    assert len(want) > 1000
    for size in (None, 40, 1):
        df_ = lines.approximate_neighbours(df, "embedding", "line_id", 0.6, block_rows=size)
        assert sorted(map(tuple, df_.collect())) == want
    plan = df_._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan.splitlines()[0]  # pairs aren't shuffled


def test_near_lines_by_force(spark):
    r = np.random.default_rng(11)
    p = r.uniform(-1, 1, (900, 3))
    ends = r.uniform(-1, 1, (14, 6))
    ends[1, 3:], ends[2, 0], ends[3, 3:] = ends[1, :3], np.nan, ends[3, :3] + [0, 0, 5]
    points = spark.createDataFrame([(i % 3, i, *map(float, x)) for i, x in enumerate(p)], "f long, i long, x double, y double, z double")
    own = spark.createDataFrame([(i % 4, i, *map(float, x)) for i, x in enumerate(ends)], "f long, line_id long, sx double, sy double, sz double, ex double, ey double, ez double")
    whole = points.join(own, "f")
    near = lines.near_lines(points, own, ["f"], 0.07)
    assert sorted(near.columns) == sorted(whole.columns)
    assert 5 * near.count() < whole.count()
    got, want = (sorted(map(tuple, planes.covered(x, own, ["f", "line_id"], 0.07).collect())) for x in (near, whole))
    assert got == want and len(want) > 3
