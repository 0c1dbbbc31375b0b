"""Detection, labels by type, coinciding lines, batches and trees against plain versions and golden cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linelake.functions import geometry as G
from linelake.operators import batches, detection, fusion, labelling, lifting, pixels, trees
from linelake.sources.settings import LineSettings

CAMERA, SIZE = (100.0, 100.0, 32.0, 24.0), (64, 48)


# detection


def image(spark, frames):
    rows = [(f, int(u), int(v), int(a[v, u])) for f, a in frames.items() for v in range(a.shape[0]) for u in range(a.shape[1])]
    return spark.createDataFrame(rows, "frame_id long, u int, v int, grey int").repartition(4)


def canny_by_force(a, low, high):
    h, w = a.shape
    p = np.pad(a.astype(int), 1, mode="edge")
    gx = sum(k * (p[1 + dv : h + 1 + dv, 2:] - p[1 + dv : h + 1 + dv, :-2]) for dv, k in ((-1, 1), (0, 2), (1, 1)))
    gy = sum(k * (p[2:, 1 + du : w + 1 + du] - p[:-2, 1 + du : w + 1 + du]) for du, k in ((-1, 1), (0, 2), (1, 1)))
    m = np.pad(abs(gx) + abs(gy), 1)
    thin = np.zeros((h, w), bool)
    for v in range(h):
        for u in range(w):
            here, x, y = m[v + 1, u + 1], abs(gx[v, u]), abs(gy[v, u])
            if here <= low:
                continue
            if y * 32768 < x * detection.FLAT:
                ok = here > m[v + 1, u] and here >= m[v + 1, u + 2]
            elif y * 32768 > x * (detection.FLAT + 65536):
                ok = here > m[v, u + 1] and here >= m[v + 2, u + 1]
            else:
                s = 1 if (gx[v, u] < 0) == (gy[v, u] < 0) else -1
                ok = here > m[v, u + 1 - s] and here > m[v + 2, u + 1 + s]
            thin[v, u] = ok
    out = {(u, v) for v in range(h) for u in range(w) if thin[v, u] and m[v + 1, u + 1] > high}
    stack = list(out)
    while stack:
        u, v = stack.pop()
        for x in range(max(0, u - 1), min(w, u + 2)):
            for y in range(max(0, v - 1), min(h, v + 2)):
                if thin[y, x] and (x, y) not in out:
                    out.add((x, y))
                    stack.append((x, y))
    return out


@pytest.fixture(scope="module")
def frames():
    r = np.random.default_rng(3)
    noise = r.integers(0, 256, (24, 32))
    box = np.zeros((24, 32), int)
    box[6:18, 8:26] = 200
    slope = np.array([[250 if v > u else 20 for u in range(32)] for v in range(24)])
    return {0: noise, 1: box, 2: slope, 3: np.full((24, 32), 77), 4: r.integers(0, 40, (24, 32))}


def test_edges_by_force(spark, frames):
    got = detection.canny(image(spark, frames), (32, 24)).collect()
    for f, a in frames.items():
        assert {(x.u, x.v) for x in got if x.frame_id == f} == canny_by_force(a, 50, 200), f


def test_segments_of_a_box(spark, frames):
    own = image(spark, {1: frames[1], 2: frames[2], 3: frames[3]})
    found = detection.detect_lines(own, (32, 24), detection.HOUGH, s=LineSettings(hough_threshold=8, hough_min_length=8)).collect()
    assert not [x for x in found if x.frame_id == 3]
    box = [(x.x0, x.y0, x.x1, x.y1) for x in found if x.frame_id == 1]
    flat = [b for b in box if b[1] == b[3] and abs(b[0] - b[2]) >= 14]
    steep = [b for b in box if b[0] == b[2] and abs(b[1] - b[3]) >= 8]
    assert len({b[1] for b in flat}) >= 2 and len({b[0] for b in steep}) >= 2
    assert any(abs(abs((y1 - y0) / (x1 - x0)) - 1) < 0.1 and abs(x1 - x0) > 12 for x0, y0, x1, y1 in ((x.x0, x.y0, x.x1, x.y1) for x in found if x.frame_id == 2) if x1 != x0)


def test_detectors_are_chosen_by_number(spark, frames):
    own = image(spark, {1: frames[1]})
    mine = lambda img: img.select("frame_id", *[F.lit(float(k)).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))]).limit(1)
    assert detection.detect_lines(own, (32, 24), 77, {detection.LSD: mine}).count() == 1
    with pytest.raises(ValueError):
        detection.detect_lines(own, (32, 24), detection.EDL)


# labels by type


def labels_by_force(line, points, classes, background, s):
    """points: (u, v) to (x, y, z, label)."""
    a, b = np.array(line[:3]), np.array(line[3:6])
    planes = {0: np.array(line[6:10]), 1: np.array(line[10:14])}

    def strips(p, q):
        flat = [(x[0] * 100 / x[2] + 32, x[1] * 100 / x[2] + 24) for x in (p, q)]
        (x0, y0), (x1, y1) = flat
        n = math.hypot(x1 - x0, y1 - y0)
        out = {0: [], 1: []}
        for (u, v), x in points.items():
            t = ((u - x0) * (x1 - x0) + (v - y0) * (y1 - y0)) / n**2
            off = ((v - y0) * (x1 - x0) - (u - x0) * (y1 - y0)) / n
            if 0 <= t <= 1 and 0.5 <= abs(off) <= min(5, n * 0.5) + 0.5 and not math.isnan(x[0]):
                out[1 if off > 0 else 0].append(x)
        return out

    near = lambda x, k: abs(planes[k][:3] @ np.array(x[:3]) + planes[k][3]) < s.max_plane_error

    def both(found):
        left = [x for x in found[1] if near(x, 1)] or found[1]
        return [found[0] + [x for x in found[0] if near(x, 0)], left]

    def most(rows):
        labels = [x[3] for x in rows]
        return min(set(labels), key=lambda k: (-labels.count(k), k)) if labels else 0

    if line[14] == 0:
        k = 1 if not planes[0].any() else 0
        sides = [[x for x in rows if near(x, k)] for rows in strips(a, b).values()]
        return most(sides[1] if len(sides[1]) > len(sides[0]) else sides[0])
    right, left = map(most, both(strips(a, b)))
    d = (b - a) / np.linalg.norm(b - a) * s.extension_length
    more = [x[3] for p, q in ((a - d, a), (b, b + d)) for rows in both(strips(p, q)) for x in rows]
    one, other = (right, left) if more.count(right) < more.count(left) else (left, right)
    return other if classes.get(one) in background else one


def test_labels_by_type(spark):
    r = random.Random(4)
    points, rows = {}, []
    for f in range(6):
        for u in range(64):
            for v in range(48):
                z = 1.0 if u < 32 else 1.0 + 0.02 * f + r.choice([0, 0, 0.01])
                x = ((u - 32) * z / 100, (v - 24) * z / 100, z, 1 + (u > 30) + 2 * (v > 24 + r.randint(-2, 2)))
                points[f, u, v] = x if r.random() > 0.05 else (math.nan, math.nan, math.nan, 1)
    s = LineSettings(extension_length=0.05)
    zero = (0.0, 0.0, 0.0, 0.0)
    for f in range(6):
        for k, kind in enumerate((0, 0, 1, 3)):
            x = r.uniform(-0.05, 0.05)
            near, far = (0.0, 0.0, 1.0, -1.0), (0.0, 0.0, 1.0, -(1.0 + 0.02 * f))
            planes = {0: (near, zero), 1: (zero, far)}[k] if kind == 0 else (far, near)
            rows.append((f, k, x, -0.12 + 0.01 * k, 1.0, x + 0.03, 0.11, 1.0, *planes[0], *planes[1], kind))
    names = ["frame_id", "line_id", *lifting.ENDS, *lifting.RIGHT, *lifting.LEFT, "type"]
    own = spark.createDataFrame(rows, ", ".join(f"{n} {'double' if n not in ('frame_id', 'line_id', 'type') else 'long'}" for n in names))
    cloud = spark.createDataFrame([(*k, *x[:3]) for k, x in points.items()], "frame_id long, u int, v int, x double, y double, z double")
    seen = spark.createDataFrame([(*k, x[3]) for k, x in points.items()], "frame_id long, u int, v int, label long")
    classes = {1: 7, 2: 1, 3: 7, 4: 9}
    known = spark.createDataFrame(list(classes.items()), "label long, class_id long")
    for background in ([], [1], [7, 9]):
        got = {(x.frame_id, x.line_id): x.label for x in labelling.labels_by_type(own, cloud, seen, known, ["frame_id", "line_id"], CAMERA, SIZE, background, s).collect()}
        for row in rows:
            mine = {(u, v): x for (f, u, v), x in points.items() if f == row[0]}
            assert got[row[:2]] == labels_by_force(row[2:], mine, classes, background, s), row
    assert len(set(got.values())) > 1


# coinciding lines


def test_coinciding_by_index(spark):
    r = random.Random(7)

    def line(i):
        p = [r.uniform(-1, 1) for _ in range(3)]
        d = [r.gauss(0, 1) for _ in range(3)]
        n = math.sqrt(sum(x * x for x in d)) or 1
        long = 10 ** r.uniform(-2, 1)
        return (i % 2, i, *p, *[a + b / n * long for a, b in zip(p, d)])

    first = [line(i) for i in range(150)]
    second = []
    for g, i, *p in first:
        for k in range(4):  # near ones: moved along, turned a little, cut
            a, b = np.array(p[:3]), np.array(p[3:])
            t0, t1 = r.uniform(-0.5, 1.2), r.uniform(-0.5, 1.5)
            wobble = lambda: np.array([r.gauss(0, 0.02) for _ in range(3)])
            second.append((g, len(second), *(a + (b - a) * t0 + wobble()), *(a + (b - a) * t1 + wobble())))
    second += [line(i) for i in range(1000, 1100)] + [(0, 5000, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    schema = "g int, line_id long, sx double, sy double, sz double, ex double, ey double, ez double"
    a = spark.createDataFrame(first, schema)
    b = spark.createDataFrame([(x[0], x[1], *map(float, x[2:])) for x in second], schema)
    got = {(x.id1, x.id2) for x in fusion.coinciding(a, b, ["g"], "line_id").collect()}
    side = lambda df, p: df.select("g", F.col("line_id").alias(f"id{'ab'.index(p) + 1}"), *[F.col(c).alias(p + c) for c in fusion.ENDS])
    every = side(a, "a").join(side(b, "b"), "g").filter(G.coincide(G.start("a"), G.end("a"), G.start("b"), G.end("b")))
    want = {(x.id1, x.id2) for x in every.select("id1", "id2").collect()}
    assert got == want and len(want) > 100
    plan = fusion.coinciding(a, b, ["g"], "line_id")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


# batches


def test_numbers_are_dense(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1009).alias("x")).repartition(7)
    got = batches.numbered(df, ["x"], start=5).orderBy("x").collect()
    assert [x.number for x in got] == list(range(5, 1005))
    assert batches.numbered(df.limit(0), ["x"]).count() == 0


def test_new_labels_spare_the_reserved_one(spark):
    parts = spark.createDataFrame([(0, 3, 0), (0, 3, 1), (0, 65_535, 1), (1, 3, 1), (1, 9, 0)], "scene_id long, label long, part int")
    got = {(x.scene_id, x.label, x.part): x.new_label for x in batches.new_labels(parts, ["scene_id"]).collect()}
    assert got == {(0, 3, 0): 3, (0, 3, 1): 10, (0, 65_535, 1): 11, (1, 3, 1): 12, (1, 9, 0): 9}


def test_frames_of_many_lines_keep_a_seeded_choice(spark):
    df = spark.createDataFrame([(0, f, f * 100 + i, i % 3, i % 3, *[float(i)] * 12, True, False) for f in range(2) for i in range(40)], ", ".join(["scene_id long", "frame_id long", "line_id long", "label int", "class_id int", *[f"{c} double" for c in (*batches.ENDS, *batches.NORMALS)], "open1 boolean", "open2 boolean"]))
    one = batches.frame_inputs(df, [0], most_lines=16, most_clusters=4).orderBy("frame_id").collect()
    again = batches.frame_inputs(df.repartition(5), [0], most_lines=16, most_clusters=4).orderBy("frame_id").collect()
    assert one == again
    for x in one:
        assert x.n_lines == 16 and len(x.lines) == len(x.labels) == len(x.valid) == 16 and len(x.lines[0]) == 15 and all(x.valid)
        assert x.unique_labels == [2, 3, -1, -1] and x.cluster_count == 2
        assert [lab == 0 for lab in x.labels] == list(x.background)
    seeded = batches.training_plan(df.select("scene_id", "frame_id").distinct(), 1, seed=3)
    assert sorted(x.number for x in seeded.collect()) == [0, 1]


# trees


def test_paths_follow_the_fitted_trees(spark):
    r = random.Random(9)
    rows = [(i, r.gauss(0, 1), r.gauss(0, 1)) for i in range(80)]
    df = spark.createDataFrame([(i, x, y, int(x > 0) + 2 * int(y > 0.3)) for i, x, y in rows], "line_id long, x double, y double, label int")
    model = trees.fit_forest(df, ["x", "y"], "label", trees=3, depth=3)
    nodes = {(n.tree, n.node): n for n in trees.forest_nodes(model, spark).collect()}
    assert sum(1 for _, n in nodes if n == 0) == 3
    seen = {}
    for x in trees.decision_paths(df, trees.forest_nodes(model, spark), ["line_id"], ["x", "y"]).collect():
        seen.setdefault(x.line_id, set()).add((x.tree, x.node))
    for i, *values in rows:
        want = set()
        for t in range(3):
            n = 0
            while n >= 0:
                want.add((t, n))
                node = nodes[t, n]
                n = -1 if node.left < 0 else node.left if values[node.feature] <= node.threshold else node.right
        assert seen[i] == want
    pairs = spark.createDataFrame([(i, j) for i in range(20) for j in range(i)], "id1 long, id2 long")
    paths = trees.decision_paths(df, trees.forest_nodes(model, spark), ["line_id"], ["x", "y"])
    for x in trees.path_distances(paths, pairs, "line_id", 3).collect():
        assert x.d == pytest.approx(len(seen[x.id1] ^ seen[x.id2]) / 3)


# walks and ends


def test_open_ends_beside_the_image_and_behind_things(spark):
    own = spark.createDataFrame([(0, 0, -0.1, 0.0, 1.0, 0.1, 0.0, 1.0), (0, 1, 0.0, 0.0, 1.0, 0.319, 0.0, 1.0), (1, 2, -0.1, 0.0, 1.0, 0.1, 0.0, 1.0)], "frame_id long, line_id long, sx double, sy double, sz double, ex double, ey double, ez double")
    depth = spark.createDataFrame([(f, u, v, 0.5 if f == 1 and u > 40 else 1.1) for f in range(2) for u in range(64) for v in range(48)], "frame_id long, u int, v int, depth double")
    got = {x.line_id: (x.open1, x.open2) for x in pixels.open_ends(own, depth, ["frame_id", "line_id"], CAMERA, SIZE).collect()}
    assert got == {0: (False, False), 1: (False, True), 2: (False, True)}
