"""Geometry of 2-D and 3-D segments, planes and cameras as column expressions.

NaN is never in bounds, never equal, and passes clamps; a division by zero gives infinity or NaN as in floating-point
arithmetic, never an error. A zero-length line stands for "no line"."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Num = Column | float | int


def col(x: Num | str) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def div(a: Num, b: Num) -> Column:
    """a / b as floating-point hardware divides."""
    a, b = col(a), col(b)
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(F.try_divide(a, b))  # 0 * inf is NaN, too


@dataclass(frozen=True)
class Vec:
    """A vector whose components are columns."""

    c: tuple[Column, ...]

    @staticmethod
    def of(*names: Num | str) -> Vec:
        return Vec(tuple(col(n) for n in names))

    def __add__(self, o: Vec) -> Vec:
        return Vec(tuple(a + b for a, b in zip(self.c, o.c)))

    def __sub__(self, o: Vec) -> Vec:
        return Vec(tuple(a - b for a, b in zip(self.c, o.c)))

    def __neg__(self) -> Vec:
        return Vec(tuple(-a for a in self.c))

    def __mul__(self, k: Num) -> Vec:
        return Vec(tuple(a * k for a in self.c))

    def over(self, k: Num) -> Vec:
        return Vec(tuple(div(a, k) for a in self.c))

    def dot(self, o: Vec) -> Column:
        return reduce(lambda x, y: x + y, [a * b for a, b in zip(self.c, o.c)])

    def cross(self, o: Vec) -> Vec:
        (a, b, c), (d, e, f) = self.c, o.c
        return Vec((b * f - c * e, c * d - a * f, a * e - b * d))

    def norm(self) -> Column:
        return F.sqrt(self.dot(self))

    def unit(self) -> Vec:
        return self.over(self.norm())

    def aliased(self, *names: str) -> list[Column]:
        return [c.alias(n) for c, n in zip(self.c, names)]

    def when(self, condition: Column, other: Vec) -> Vec:
        """self where the condition holds, other elsewhere."""
        return Vec(tuple(F.when(condition, a).otherwise(b) for a, b in zip(self.c, other.c)))


def start(p: str = "") -> Vec:
    return Vec.of(*(f"{p}s{k}" for k in "xyz"))


def end(p: str = "") -> Vec:
    return Vec.of(*(f"{p}e{k}" for k in "xyz"))


# scalars


def clamp(v: Num, low: Num, high: Num) -> Column:
    v = col(v)
    return F.when(~F.isnan(v) & (v < low), col(low)).when(~F.isnan(v) & (v > high), col(high)).otherwise(v)


def truncate(v: Num, decimals: int) -> Column:
    """Cut towards 0 after 0 to 6 decimals."""
    if not 0 <= decimals <= 6:
        raise ValueError("decimals must be from 0 to 6")
    v, p = col(v), float(10**decimals)
    return F.when(v >= 0, F.floor(v * p).cast("double") / p).otherwise(F.ceil(v * p).cast("double") / p)


def equal_floats(a: Num, b: Num) -> Column:
    """Within 1e-5 after truncation to 6 decimals; above 10^4 within a millionth; NaN equals nothing."""
    a, b = col(a), col(b)
    large = (F.abs(a) > 1e4) & (F.abs(b) > 1e4)
    near = F.when(large, F.abs(a - b) <= 1e-6 * F.greatest(F.abs(a), F.abs(b))).otherwise(F.abs(truncate(a, 6) - truncate(b, 6)) <= 1e-5)
    return ~F.isnan(a) & ~F.isnan(b) & near


def in_bounds(x: Num, y: Num, width: float, height: float, tight: bool = False) -> Column:
    x, y = col(x), col(y)
    upper = (x < width) & (y < height) if tight else (x <= width) & (y <= height)
    return ~F.isnan(x) & ~F.isnan(y) & (x >= 0) & (y >= 0) & upper


def slope(x0: Num, y0: Num, x1: Num, y1: Num) -> Column:
    return div(col(y1) - col(y0), col(x1) - col(x0))


def radians(degrees: Num) -> Column:
    return col(degrees) * (math.pi / 180)


# planes


def plane_d(normal: Vec, point: Vec) -> Column:
    return -normal.dot(point)


def point_to_plane(h: tuple[Vec, Num], p: Vec) -> Column:
    """Distance of p from the plane (unit normal, d)."""
    return F.abs(h[0].dot(p) + col(h[1]))


def towards_origin(h: tuple[Vec, Num]) -> tuple[Vec, Column]:
    n, d = h[0], col(h[1])
    return (-n).when(d < 0, n), F.when(d < 0, -d).otherwise(d)


def towards_point(h: tuple[Vec, Num], p: Vec) -> tuple[Vec, Column]:
    """The plane with p on the side that its normal points to."""
    n, d = h[0], col(h[1])
    below = n.dot(p) + d < 0
    return (-n).when(below, n), F.when(below, -d).otherwise(d)


def onto_plane(p: Vec, h: tuple[Vec, Num]) -> Vec:
    n, d = h[0], col(h[1])
    return p - n * (n.dot(p) + d)


def plane_of_points(a: Vec, b: Vec, c: Vec) -> tuple[Vec, Column]:
    n = (b - a).cross(c - a).unit()
    return n, plane_d(n, a)


def plane_meets_line(h: tuple[Vec, Num], p: Vec, direction: Vec) -> Vec:
    """The point of the line p + t direction on the plane; NaN or infinite when they are parallel."""
    t = -div(h[0].dot(p) + col(h[1]), h[0].dot(direction))
    return p + direction * t


def on_both_planes(h1: tuple[Vec, Num], h2: tuple[Vec, Num], direction: Vec) -> Vec:
    """A point on the intersection of two planes, with 0 in the last component (z, y, x) in which the intersection
    runs by more than 0.1."""
    (a, b, c), (e, f, g) = h1[0].c, h2[0].c
    p, q = -col(h1[1]), -col(h2[1])

    def solve(a1, b1, r1, a2, b2, r2):
        det = a1 * b2 - b1 * a2
        return div(r1 * b2 - b1 * r2, det), div(a1 * r2 - r1 * a2, det)

    zero = F.lit(0.0)
    xz, yz = solve(a, b, p, e, f, q)
    xy, zy = solve(a, c, p, e, g, q)
    yx, zx = solve(b, c, p, f, g, q)
    by_z, by_y = Vec((xz, yz, zero)), Vec((xy, zero, zy))
    dx, dy, dz = direction.c
    return by_z.when(F.abs(dz) > 0.1, by_y.when(F.abs(dy) > 0.1, Vec((zero, yx, zx))))


# lines


def point_to_line(a: Vec, b: Vec, p: Vec) -> Column:
    """Distance of p from the infinite line through a and b."""
    return div((p - a).cross(p - b).norm(), (b - a).norm())


def onto_line(a: Vec, b: Vec, p: Vec) -> Vec:
    d = (b - a).unit()
    return a + d * (p - a).dot(d)


def similar_length(l1: Column, l2: Column, ratio: float = 1.5) -> Column:
    """Neither length is more than `ratio` times the other."""
    return ~((div(l1, l2) > ratio) | (div(l2, l1) > ratio))


def perpendicular_distance(a1: Vec, b1: Vec, a2: Vec, b2: Vec) -> Column:
    """Distance of two infinite lines; of parallel ones, that of a point of the second."""
    n = (a1 - b1).cross(a2 - b2)
    size = n.norm()
    return F.when(size < 1e-6, point_to_line(a1, b1, a2)).otherwise(F.abs(n.dot(a2 - a1)) / F.when(size < 1e-6, F.lit(1.0)).otherwise(size))


def mean_difference_squared(a1: Vec, b1: Vec, a2: Vec, b2: Vec) -> Column:
    d = (a1 + b1) * 0.5 - (a2 + b2) * 0.5
    return d.dot(d)


def nearest_difference_squared(a1: Vec, b1: Vec, a2: Vec, b2: Vec) -> Column:
    return F.least(*[(p - q).dot(p - q) for p in (a1, b1) for q in (a2, b2)])


def segment_distance(a0: Vec, a1: Vec, b0: Vec, b1: Vec) -> Column:
    """Shortest distance of two segments: the inner solution where it lies in both, else the nearest of an end of one
    and the other segment. A zero-length segment gives NaN."""
    u, v, w = a1 - a0, b1 - b0, a0 - b0
    uu, uv, vv, uw, vw = u.dot(u), u.dot(v), v.dot(v), u.dot(w), v.dot(w)
    det = uu * vv - uv * uv
    s, t = div(uv * vw - vv * uw, det), div(uu * vw - uv * uw, det)
    gap = w + u * s - v * t

    def end_to(p: Vec, q: Vec, d: Vec, dd: Column) -> Column:
        k = clamp(div((p - q).dot(d), dd), 0.0, 1.0)
        g = p - (q + d * k)
        return g.dot(g)

    ends = F.least(end_to(a0, b0, v, vv), end_to(a1, b0, v, vv), end_to(b0, a0, u, uu), end_to(b1, a0, u, uu))
    inner = (det > 1e-12) & (s >= 0) & (s <= 1) & (t >= 0) & (t <= 1)
    return F.when((uu == 0) | (vv == 0), F.lit(float("nan"))).otherwise(F.sqrt(F.when(inner, gap.dot(gap)).otherwise(ends)))


def coincide(a1: Vec, b1: Vec, a2: Vec, b2: Vec, angle: float = 0.15, distance: float = 0.015) -> Column:
    """Nearly one line: a small angle, either end of the second near the first line, and a common stretch. In squares of
    scalar products, without roots and quotients, so that the expression stays small; lines of length zero never do."""
    u, v, p, q = b1 - a1, b2 - a2, a2 - a1, b2 - a1
    uu, uv, up, uq = u.dot(u), u.dot(v), u.dot(p), u.dot(q)
    far = lambda w, along: w.dot(w) * uu - along * along  # noqa: E731  squared distance from the line, times uu
    near = (far(p, up) < distance * distance * uu) | (far(q, uq) < distance * distance * uu)
    low, high = F.least(up, uq), F.greatest(up, uq)
    common = ((low < 0) & (high > 0)) | ((low > 0) & (low < uu))
    return (uv * uv > math.cos(angle) ** 2 * uu * v.dot(v)) & near & common


def equal_2d(l1: tuple[Num | str, ...], l2: tuple[Num | str, ...], cos2: float = 0.98, distance2: float = 2.0) -> Column:
    """Nearly parallel, and some ends within a squared distance."""
    p = [Vec.of(*l1[:2]), Vec.of(*l1[2:])]
    q = [Vec.of(*l2[:2]), Vec.of(*l2[2:])]
    u, v = p[0] - p[1], q[0] - q[1]
    cosine = div(u.dot(v) * u.dot(v), u.dot(u) * v.dot(v))
    least = F.least(*[(a - b).dot(a - b) for a in p for b in q])
    return ~F.isnan(cosine) & (cosine > cos2) & (least < distance2)


def merged_2d(l1: tuple[str, ...], l2: tuple[str, ...]) -> list[Column]:
    """The box around two lines, as the diagonal that the sum of their slopes points along."""
    xs, ys = [col(l[i]) for l in (l1, l2) for i in (0, 2)], [col(l[i]) for l in (l1, l2) for i in (1, 3)]
    up = slope(*l1) + slope(*l2)
    rising = ~F.isnan(up) & (up > 0)
    low, high = F.least(*ys), F.greatest(*ys)
    return [F.least(*xs), F.when(rising, low).otherwise(high), F.greatest(*xs), F.when(rising, high).otherwise(low)]


def shrunk_2d(line: tuple[str, ...], coefficient: float) -> list[Column]:
    """Both ends moved in by (1 - coefficient) / 2; lines that would be shorter than 1 stay."""
    a, b = Vec.of(*line[:2]), Vec.of(*line[2:])
    step = (b - a).unit() * ((1 - coefficient) / 2)
    p, q = a + step, b - step
    short = (q - p).norm() < 1
    return [*a.when(short, p).c, *b.when(short, q).c]


def rectangles_2d(line: tuple[str, ...], offset: float = 0.5, most: float = 5.0, relative: float = 0.5) -> tuple[list[Vec], list[Vec]]:
    """Corners of the strips left and right of a line."""
    a, b = Vec.of(*line[:2]), Vec.of(*line[2:])
    d = b - a
    n = d.norm()
    size = F.when(F.lit(most) > n * relative, n * relative).otherwise(F.lit(most))
    out = []
    for side in (Vec((-d.c[1], d.c[0])), Vec((d.c[1], -d.c[0]))):
        near, far = side * div(offset, n), side * div(F.lit(offset) + size, n)
        out.append([a + near, a + far, b + near, b + far])
    return out[0], out[1]


def stretch_in_bounds(line: tuple[str, ...], width: float, height: float) -> tuple[Column, Column]:
    """Where a 2-D line enters [0, width] x [0, height] and where it leaves it, as parts of its length; null for a line
    that doesn't touch it."""
    x0, y0, x1, y1 = map(col, line)
    enter, leave, out = [F.lit(0.0)], [F.lit(1.0)], F.lit(False)
    for p, d, most in ((x0, x1 - x0, width), (y0, y1 - y0, height)):
        at0, at1, still = div(-p, d), div(F.lit(float(most)) - p, d), d == 0
        enter.append(F.when(still, 0.0).otherwise(F.least(at0, at1)))
        leave.append(F.when(still, 1.0).otherwise(F.greatest(at0, at1)))
        out = out | (still & ((p < 0) | (p > most)))
    return F.when(~out, F.greatest(*enter)), F.least(*leave)


def cut_to(line: tuple[str, ...], a: Column, b: Column, width: float, height: float) -> list[Column]:
    """The part of a 2-D line from a to b; 0, 0, 0, 0 if a is null or beyond b."""
    x0, y0, x1, y1 = map(col, line)
    sides = ((x0, x1 - x0, width), (y0, y1 - y0, height))
    begin = [F.when(a > 0, clamp(p + d * a, 0.0, most)).otherwise(p) for p, d, most in sides]
    finish = [F.when(b < 1, clamp(p + d * b, 0.0, most)).otherwise(p + d) for p, d, most in sides]
    return [F.when(F.isnull(a) | (a > b), 0.0).otherwise(c) for c in (*begin, *finish)]


def none_if_short(line: tuple[str, ...], least: float = 1e-4) -> list[Column]:
    """The 2-D line; 0, 0, 0, 0 if it is shorter than `least`."""
    x0, y0, x1, y1 = map(col, line)
    return [F.when(F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) < least, 0.0).otherwise(c) for c in (x0, y0, x1, y1)]


def fit_to_bounds(line: tuple[str, ...], width: float, height: float) -> list[Column]:
    """The part of a 2-D line in [0, width] x [0, height]; 0, 0, 0, 0 if there is none of 1e-4 or more. As one expression;
    operators.lines.fit_to_bounds does the same step by step, which compiles faster."""
    return none_if_short(tuple(cut_to(line, *stretch_in_bounds(line, width, height), width, height)))


def oriented(a: Vec, b: Vec, ref_a: Vec, ref_b: Vec) -> tuple[Vec, Vec]:
    """The ends in the order of a reference line: swapped when both are nearer to the other's opposite end."""
    swap = ((a - ref_b).norm() < (a - ref_a).norm()) & ((b - ref_a).norm() < (b - ref_b).norm())
    return b.when(swap, a), a.when(swap, b)


def pixel_walk(x0: Num, y0: Num, x1: Num, y1: Num, left: bool = True) -> Column:
    """For each pixel row from y0 to y1, the column of the edge: floored on the left side, raised on the right."""
    x0, y0, x1, y1 = map(col, (x0, y0, x1, y1))
    rows = F.sequence(F.floor(F.least(y0, y1)).cast("int"), F.floor(F.greatest(y0, y1)).cast("int"))
    rate = div(x1 - x0, y1 - y0)
    cut = F.floor if left else F.ceil

    def at(r):
        y = F.least(F.greatest(r.cast("double") + 0.5, F.least(y0, y1)), F.greatest(y0, y1))
        return cut(F.when(y1 == y0, F.least(x0, x1) if left else F.greatest(x0, x1)).otherwise(x0 + (y - y0) * rate)).cast("int")

    return F.transform(rows, at)


# poses and cameras


def rotation(qx: Num, qy: Num, qz: Num, qw: Num) -> list[Vec]:
    """Rows of the rotation matrix of a unit quaternion."""
    x, y, z, w = map(col, (qx, qy, qz, qw))
    return [
        Vec((1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w))),
        Vec((2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w))),
        Vec((2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y))),
    ]


def transform(rows: list[Vec], p: Vec, shift: Vec | None = None) -> Vec:
    out = Vec(tuple(r.dot(p) for r in rows))
    return out + shift if shift else out


def look_at(eye: Vec, target: Vec, up: Vec) -> tuple[list[Vec], Vec]:
    """Rows of the rotation into a camera at `eye` that looks at `target`, and the shift. up: a point above the eye."""
    z = (target - eye).unit()
    x = z.cross(up - eye).unit()
    y = z.cross(x)
    rows = [x, y, z]
    return rows, -transform(rows, eye)


def project(p: Vec, fx: float, fy: float, cx: float, cy: float) -> tuple[Column, Column]:
    x, y, z = p.c
    return div(x * fx, z) + cx, div(y * fy, z) + cy


def back_project(u: Num, v: Num, depth: Num, fx: float, fy: float, cx: float, cy: float) -> Vec:
    z = col(depth)
    return Vec(((col(u) - cx) * z / fx, (col(v) - cy) * z / fy, z))


def transform_line(rows: list[Vec], shift: Vec) -> list[Column]:
    """A line's ends moved and its two normals turned: sx .. n2z."""
    ends = [transform(rows, Vec.of(*(f"{p}{c}" for c in "xyz")), shift) for p in "se"]
    normals = [transform(rows, Vec.of(*(f"{p}{c}" for c in "xyz"))) for p in ("n1", "n2")]
    return [x for p, v in zip(("s", "e", "n1", "n2"), ends + normals) for x in v.aliased(*(f"{p}{c}" for c in "xyz"))]


def intrinsics(width: Num, height: Num, fx: Num, fy: Num) -> tuple[Column, Column, Column, Column]:
    """fx, fy, cx, cy of a camera whose axis meets the middle of its image."""
    return col(fx), col(fy), col(width) / 2.0, col(height) / 2.0


def intrinsics_of_view(width: Num, height: Num, across: Num, upright: Num) -> tuple[Column, Column, Column, Column]:
    """The same from the fields of view, in degrees."""
    focal = lambda size, angle: col(size) / 2.0 / F.tan(F.radians(col(angle) / 2.0))
    return intrinsics(width, height, focal(width, across), focal(height, upright))


def ray_to_depth(u: Num, v: Num, length: Num, fx: float, fy: float, cx: float, cy: float) -> Column:
    """Depth in whole millimetres (cut) of a point at a distance along the pixel's ray."""
    x, y = (col(u) - cx) / fx, (col(v) - cy) / fy
    return (col(length) / F.sqrt(x * x + y * y + 1.0)).cast("int")


def virtual_camera(a: Vec, b: Vec, origin: Vec) -> tuple[list[Vec], Vec]:
    """Rotation (rows) and shift of the camera at `origin` whose x axis is the line."""
    x = (b - a).unit()
    z = ((a + b) * 0.5 - origin).unit()
    rows = [x, z.cross(x).unit(), z]
    return rows, -transform(rows, origin)


# representations


def centre_direction(a: Vec, b: Vec) -> tuple[Vec, Vec]:
    d = (b - a).unit()
    return (a + b).over(2.0), (-d).when(d.c[0] < 0, d)


def pluecker(a: Vec, b: Vec) -> tuple[Vec, Vec]:
    return a.cross(b), b - a


def orthonormal(n: Vec, v: Vec) -> list[Column]:
    """Four angles of a line: Euler angles (static x, y, z) of (n, v, n x v), and that of its two norms."""
    c = n.cross(v)
    u, w, q = n.unit(), v.unit(), c.unit()
    side = F.sqrt(u.c[0] * u.c[0] + u.c[1] * u.c[1])
    regular = side > 1e-8
    one = F.when(regular, F.atan2(w.c[2], q.c[2])).otherwise(F.atan2(-q.c[1], w.c[1]))
    three = F.when(regular, F.atan2(u.c[1], u.c[0])).otherwise(F.lit(0.0))
    return [one, F.atan2(-u.c[2], side), three, F.atan2(v.norm(), n.norm())]


def length_of(a: Vec, b: Vec) -> Column:
    return (b - a).norm()


def ramp(value: Num, low: tuple[int, int, int], high: tuple[int, int, int]) -> list[Column]:
    """Colour between two fixed ones, by a value from 0 to 1."""
    v = clamp(value, 0.0, 1.0)
    return [F.floor(F.lit(float(a)) + v * float(b - a)).cast("int") for a, b in zip(low, high)]


def heat(value: Num) -> list[Column]:
    """Blue, cyan, green, yellow, red, in four equal steps from 0 to 1."""
    v = clamp(value, 0.0, 1.0)
    points = [(0, 0, 255), (0, 255, 255), (0, 255, 0), (255, 255, 0), (255, 0, 0)]
    out = []
    for i in range(3):
        c = ramp(v * 4 - 3, points[3], points[4])[i]
        for k in (2, 1, 0):
            c = F.when(v < (k + 1) / 4, ramp(v * 4 - k, points[k], points[k + 1])[i]).otherwise(c)
        out.append(c)
    return out
