"""Lines lifted from scenes that are cast ray by ray."""

import numpy as np
import pandas as pd
import pytest

from linelake.operators import lifting

F, CX, CY, SIZE = 150.0, 80.0, 60.0, (160, 120)
CAMERA = (F, F, CX, CY)


def room(k, m):
    """A wall at z = 1.2 and a floor at y = 0.3."""
    return min(1.2, 0.3 / m if m > 0 else np.inf)


SCENES = {
    0: lambda u, v, k, m: 1.0,  # a wall
    1: lambda u, v, k, m: room(k, m),
    2: lambda u, v, k, m: 0.7 if u > 120 else room(k, m),  # something stands at the end of the line
    3: lambda u, v, k, m: 1.0 / (1.0 - 0.8 * abs(k)),  # a convex corner
    4: lambda u, v, k, m: 1.0 if u < 80 else 2.0,  # a step in depth
    5: lambda u, v, k, m: 0.0 if u == 60 and v == 32 else 1.0,  # no depth at a place
}
LINES = {0: (40.0, 30.0, 120.0, 30.0), 1: (40.0, 97.5, 120.0, 97.5), 2: (120.0, 97.5, 40.0, 97.5), 3: (80.0, 30.0, 80.0, 90.0), 4: (79.5, 90.0, 79.5, 30.0), 5: (40.0, 30.0, 120.0, 30.0), 6: (500.0, 10.0, 600.0, 10.0)}


@pytest.fixture(scope="module")
def lifted(spark):
    rows = []
    for f, scene in SCENES.items():
        for u in range(SIZE[0]):
            for v in range(SIZE[1]):
                k, m = (u - CX) / F, (v - CY) / F
                z = scene(u, v, k, m)
                rows.append((f, u, v, k * z, m * z, z))
    cloud = spark.createDataFrame(pd.DataFrame(rows, columns=["frame_id", "u", "v", "x", "y", "z"])).cache()
    lines = spark.createDataFrame([(f % 6, f, *xy) for f, xy in LINES.items()], "frame_id long, line_id long, x0 double, y0 double, x1 double, y1 double")
    yield {r.line_id: r for r in lifting.lift(lines, cloud, ["frame_id", "line_id"], CAMERA, SIZE).collect()}, lines, cloud
    cloud.unpersist()


def ends(r):
    return np.array([[r.sx, r.sy, r.sz], [r.ex, r.ey, r.ez]])


def test_types(lifted):
    assert {k: r.type for k, r in lifted[0].items()} == {0: 1, 1: 2, 2: 3, 3: 2, 4: 0}


def test_places(lifted):
    got = lifted[0]
    assert np.allclose(ends(got[0]), [[-40 / F, -30 / F, 1.0], [40 / F, -30 / F, 1.0]], atol=0.02)
    assert np.allclose(ends(got[1]), [[-40 / F * 1.2, 0.3, 1.2], [40 / F * 1.2, 0.3, 1.2]], atol=0.02)
    assert got[2].sx > 0.28 and got[2].ex < -0.28  # in the order of its 2-D line
    assert np.allclose(ends(got[3])[:, [0, 2]], [[0, 1], [0, 1]], atol=1e-6) and got[3].sy < got[3].ey
    assert np.allclose(ends(got[4]), [[-1 / F, 30 / F, 1.0], [-1 / F, -30 / F, 1.0]], atol=1e-6)  # through the last column before the step


def test_planes(lifted):
    got = lifted[0]
    plane = lambda r, side: np.array([r[f"{side}{c}"] for c in "abcd"])
    assert np.allclose(plane(got[1], "l"), [0, -1, 0, 0.3], atol=1e-6) and np.allclose(plane(got[1], "r"), [0, 0, -1, 1.2], atol=1e-6)
    front, gone = sorted((plane(got[4], s) for s in "rl"), key=lambda p: -abs(p).sum())
    assert np.allclose(front, [0, 0, -1, 1], atol=1e-6) and not gone.any()


def test_patterns_of_prolonged_lines(spark, lifted):
    got, lines, cloud = lifted
    own = lines.sparkSession.createDataFrame([r.asDict() for r in got.values() if r.line_id in (1, 2)])
    found = {r.line_id: r.pattern for r in lifting.prolonged_patterns(own, cloud, ["frame_id", "line_id"], CAMERA, SIZE).collect()}
    assert found == {1: "1111", 2: "0011"}


def test_prolonged_pieces(spark):
    one = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 2.0, 0.0, 1.0)], "line_id long, sx double, sy double, sz double, ex double, ey double, ez double")
    got = {(r.tip, r.step): (r.sx, r.ex) for r in lifting.prolonged(one, 0.5).collect()}
    assert got == {(0, k): (-0.5 * (k + 1), 0.0) for k in range(5)} | {(1, k): (2.0, 2.0 + 0.5 * (k + 1)) for k in range(5)}


def test_empty(spark, lifted):
    _, lines, cloud = lifted
    keys = ["frame_id", "line_id"]
    assert lifting.lift(lines.limit(0), cloud, keys, CAMERA, SIZE).count() == 0
    assert lifting.lift(lines, cloud.limit(0), keys, CAMERA, SIZE).count() == 0


def test_lines_of_frames_without_points_have_no_strips(spark):
    rows = [(f, 1, -0.3, 0.0, 1.0, 0.3, 0.0, 1.0, *[0.0, 0.0, 1.0, -1.0] * 2) for f in range(3)]
    own = spark.createDataFrame(rows, "frame_id long, line_id long, sx double, sy double, sz double, ex double, ey double, ez double, ra double, rb double, rc double, rd double, la double, lb double, lc double, ld double")
    cloud = spark.createDataFrame([(1, u, v, (u - 160) / 200, (v - 120) / 200, 1.0) for u in range(320) for v in range(110, 131)], "frame_id long, u int, v int, x double, y double, z double")
    counts = lifting.prolonged_counts(own, cloud, ["frame_id", "line_id"], (200.0, 200.0, 160.0, 120.0), (320, 240))
    assert {x.frame_id for x in counts.collect()} == {1}
    assert "LeftSemi" in counts._jdf.queryExecution().optimizedPlan().toString()
    found = lifting.prolonged_patterns(own, cloud, ["frame_id", "line_id"], (200.0, 200.0, 160.0, 120.0), (320, 240))
    assert {x.frame_id: x.pattern for x in found.collect()} == {0: "0000", 1: "1111", 2: "0000"}
