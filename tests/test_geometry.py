"""Golden cases of the geometry functions."""

import math

import pytest
from pyspark.sql import functions as F

from linelake.functions import geometry as G


def value(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def V(*x):
    return G.Vec.of(*map(float, x))


def test_clamp_and_nan(spark):
    got = value(spark, *[G.clamp(x, 0.0, 3.0) for x in (1, -1, 10, float("nan"))])
    assert got[:3] == (1, 0, 3) and math.isnan(got[3])


def test_truncate(spark):
    assert value(spark, G.truncate(1.2399, 2), G.truncate(-1.2399, 2)) == (1.23, -1.23)
    with pytest.raises(ValueError):
        G.truncate(1.0, 7)


def test_equal_floats(spark):
    nan = float("nan")
    assert value(spark, G.equal_floats(1.0, 1.000001), G.equal_floats(1.0, 1.1), G.equal_floats(nan, nan), G.equal_floats(1e6, 1e6 + 0.5)) == (True, False, False, True)


def test_division(spark):
    a, b, c = value(spark, G.div(1.0, 0.0), G.div(-1.0, 0.0), G.div(0.0, 0.0))
    assert (a, b) == (math.inf, -math.inf) and math.isnan(c)


def test_equal_2d(spark):
    line = lambda *x: tuple(map(float, x))
    a = line(0, 0, 10, 10)
    assert value(spark, G.equal_2d(a, a), G.equal_2d(a, line(10, 10, 30, 30)), G.equal_2d(line(0, 0, 0, 10), line(0, 0, 10, 0)), G.equal_2d(line(1, 1, 1, 1), a)) == (True, True, False, False)


def test_points_and_planes(spark):
    r3 = math.sqrt(3)
    assert value(spark, G.point_to_line(V(0, 0, 0), V(1, 0, 0), V(0, 1, 0)), G.plane_d(V(1, 2, 3), V(5, 6, 7)), G.point_to_plane((V(1, 0, 0), 2.0), V(4, 5, 2))) == (1, -38, 6)
    h = (V(1 / r3, 1 / r3, 1 / r3), -3 / r3)
    got = value(spark, G.point_to_plane(h, V(0, 0, 0)), *G.onto_plane(V(33, 33, 33), h).c, *G.onto_plane(V(456, 3, 2), (V(1, 0, 0), 0.0)).c)
    assert got == pytest.approx((r3, 1, 1, 1, 0, 3, 2))
    n, d = G.plane_of_points(V(3, 5, 1), V(5, 17, 1), V(190, 3, 1))
    assert value(spark, *n.c, d) == pytest.approx((0, 0, -1, 1))
    assert value(spark, *G.on_both_planes((V(1, 0, 0), 1.0), (V(0, 1, 0), 0.0), V(0, 0, 1)).c) == pytest.approx((-1, 0, 0))
    assert value(spark, *G.plane_meets_line((V(0, 0, 1), -1.0), V(0, 0, 0), V(0, 0, 2)).c) == (0, 0, 1)


CLIPS = [
    ((-100, -20, 40, 60), (0, 37.142857, 40, 60)), ((-20, -30, 40, 60), (0, 0, 40, 60)), ((340, -20, 40, 60), (265, 0, 40, 60)), ((334, -3, 40, 60), (320, 0, 40, 60)),
    ((340, 260, 40, 60), (310, 240, 40, 60)), ((348, 258, 40, 60), (320, 240, 40, 60)), ((-40, 260, 40, 60), (0, 160, 40, 60)), ((-2, 249, 40, 60), (0, 240, 40, 60)),
    ((-100, 10, 40, 60), (0, 45.7142857, 40, 60)), ((330, 10, 40, 60), (320, 11.724138, 40, 60)), ((100, -10, 40, 60), (91.428571, 0, 40, 60)), ((120, 250, 40, 60), (115.789474, 240, 40, 60)),
    ((10, -60, -20, 60), (0, 0, 0, 0)), ((340, -40, 10, -60), (0, 0, 0, 0)), ((100, 260, -10, 180), (72.5, 240, 0, 187.272727)), ((340, 100, -10, 180), (320, 104.5714286, 0, 177.714286)),
    ((10, 100, 180, 200), (10, 100, 180, 200)), ((0, 10, 180, 200), (0, 10, 180, 200)), ((0, 10, 180, -200), (0, 10, 8.5714286, 0)), ((-1.55502, 23.2056, 174, -2.74736e-6), (0, 23, 174, 0)),
    ((-20, 10, -10, 10), (0, 0, 0, 0)),
]


@pytest.mark.parametrize("line,want", CLIPS)
def test_fit_to_bounds(spark, line, want):
    assert value(spark, *G.fit_to_bounds(tuple(map(float, line)), 320, 240)) == pytest.approx(want, abs=2e-3)


def test_line_distances(spark):
    p = G.perpendicular_distance
    assert value(spark, p(V(0, 0, 0), V(1, 0, 0), V(0, 0, 1), V(0, 1, 1)), p(V(0, 0, 0), V(1, 0, 0), V(0, 2, 0), V(1, 2, 0)), p(V(0, 0, 0), V(1, 0, 0), V(0, 0, 0), V(0, 1, 0))) == (1, 2, 0)
    s = G.segment_distance
    got = value(spark, s(V(0, 0, 0), V(1, 0, 0), V(0, 0, 1), V(1, 0, 1)), s(V(0, 0, 0), V(1, 0, 0), V(3, 0, 0), V(4, 0, 0)), s(V(0, 0, 0), V(2, 0, 0), V(1, -1, 1), V(1, 1, 1)), s(V(0, 0, 0), V(0, 0, 0), V(1, 0, 0), V(2, 0, 0)))
    assert got[:3] == (1, 2, 1) and math.isnan(got[3])


def test_swapping_ends_changes_nothing(spark, sf):
    from linelake.plans.carriers import Carriers

    pair = Carriers(spark, sf).pair.limit(200)
    a, b, c, d = G.start("a"), G.end("a"), G.start("b"), G.end("b")
    off = pair.select(F.abs(G.segment_distance(a, b, c, d) - G.segment_distance(b, a, d, c)).alias("x"), F.abs(G.nearest_difference_squared(a, b, c, d) - G.nearest_difference_squared(b, a, c, d)).alias("y"))
    assert off.agg(F.max("x"), F.max("y")).first() == pytest.approx((0, 0), abs=1e-9)


def test_rotation_is_orthogonal(spark):
    rows = G.rotation(0.5, 0.5, 0.5, 0.5)
    assert value(spark, *G.transform(rows, V(1, 2, 3)).c) == pytest.approx((3, 1, 2))


def test_walk(spark):
    left, right = value(spark, G.pixel_walk(2.5, 0.3, 2.1, 3.9), G.pixel_walk(2.5, 0.3, 7.3, 0.7, left=False))
    assert left == [2, 2, 2, 2]
    assert len(right) == 1


def test_orthonormal_of_axis(spark):
    n, v = G.pluecker(V(0, 1, 0), V(1, 1, 0))
    got = value(spark, *G.orthonormal(n, v))
    assert all(math.isfinite(x) for x in got) and got[3] == pytest.approx(math.pi / 4)
