"""Queries of the geometry functions over the line carriers, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from linelake.functions import geometry as G
from linelake.functions import vectors as V
from linelake.operators import lines
from linelake.operators.cameras import virtual_camera_origins
from linelake.operators.lines import segment_distances
from linelake.plans.carriers import LINE, PAIR, PX, PX_PAIR, Carriers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Carriers(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


def micro(c):
    """Millionths, cut: equal in engines whose last bits differ."""
    return F.floor(c * 1e6 + 0.5).cast("long")


# text of SQL expressions


def vec(p: str) -> list[str]:
    return [f"{p}{c}" for c in "xyz"]


def sub(a, b):
    return [f"({x} - {y})" for x, y in zip(a, b)]


def add(a, b):
    return [f"({x} + {y})" for x, y in zip(a, b)]


def times(a, k):
    return [f"({x} * {k})" for x in a]


def over(a, k):
    return [f"({x} / {k})" for x in a]


def dot(a, b):
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b)) + ")"


def cross(a, b):
    return [f"({a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[2]} * {b[0]} - {a[0]} * {b[2]})", f"({a[0]} * {b[1]} - {a[1]} * {b[0]})"]


def norm(a):
    return f"sqrt({dot(a, a)})"


def named(values, names):
    return ", ".join(f"{v} AS {n}" for v, n in zip(values, names))


A, B = vec("s"), vec("e")
A1, B1, A2, B2 = vec("as"), vec("ae"), vec("bs"), vec("be")
N1, N2 = vec("n1"), vec("n2")


@query("clamp", f"WITH {LINE} SELECT line_id, CASE WHEN sx < -0.05 THEN -0.05 WHEN sx > 0.05 THEN 0.05 ELSE sx END AS v FROM v_line")
def _(c):
    return c.line.select("line_id", G.clamp("sx", -0.05, 0.05).alias("v"))


@query("truncate", f"WITH {LINE} SELECT line_id, CASE WHEN sx >= 0 THEN floor(sx * 1000.0) / 1000.0 ELSE ceil(sx * 1000.0) / 1000.0 END AS v FROM v_line")
def _(c):
    return c.line.select("line_id", G.truncate("sx", 3).alias("v"))


@query("equal_floats", f"WITH {PAIR}, t AS (SELECT id1, id2, asx, bsx, CASE WHEN asx >= 0 THEN floor(asx * 1e6) / 1e6 ELSE ceil(asx * 1e6) / 1e6 END AS p, CASE WHEN bsx >= 0 THEN floor(bsx * 1e6) / 1e6 ELSE ceil(bsx * 1e6) / 1e6 END AS q FROM v_pair) SELECT id1, id2, abs(p - q) <= 1e-5 AS same FROM t WHERE abs(asx - bsx) < 1e-3")
def _(c):
    return c.pair.filter(F.abs(F.col("asx") - F.col("bsx")) < 1e-3).select("id1", "id2", G.equal_floats("asx", "bsx").alias("same"))


@query("in_bounds", f"WITH {PX} SELECT line_id, x0 >= 0 AND y0 >= 0 AND x0 < 200 AND y0 < 150 AS inside FROM v_px")
def _(c):
    return c.px.select("line_id", G.in_bounds("x0", "y0", 200, 150, True).alias("inside"))


@query("slope", f"WITH {PX} SELECT line_id, (y1 - y0) / (x1 - x0) AS slope FROM v_px")
def _(c):
    return c.px.select("line_id", G.slope("x0", "y0", "x1", "y1").alias("slope"))


def _unit_normal():
    return over(N1, norm(N1))


@query("plane_error", f"WITH {LINE}, h AS (SELECT line_id, {named(_unit_normal(), ['ux', 'uy', 'uz'])}, sx, sy, sz, ex, ey, ez FROM v_line) SELECT line_id, -{dot(vec('u'), A)} AS d, abs({dot(vec('u'), B)} + -{dot(vec('u'), A)}) AS error FROM h")
def _(c):
    u = G.Vec.of("n1x", "n1y", "n1z").unit()
    d = G.plane_d(u, G.start())
    return c.line.select("line_id", d.alias("d"), G.point_to_plane((u, d), G.end()).alias("error"))


@query("plane_directions", f"WITH {LINE} SELECT line_id, {named([f'CASE WHEN n2x < 0 THEN -({x}) ELSE {x} END' for x in N1], ['ax', 'ay', 'az'])}, CASE WHEN n2x < 0 THEN -(n2x) ELSE n2x END AS d, {dot(N1, A)} + n2x < 0 AS flipped FROM v_line")
def _(c):
    n, d = G.towards_origin((G.Vec.of("n1x", "n1y", "n1z"), "n2x"))
    at_point = G.towards_point((G.Vec.of("n1x", "n1y", "n1z"), "n2x"), G.start())[0]
    return c.line.select("line_id", *n.aliased("ax", "ay", "az"), d.alias("d"), (at_point.c[0] != F.col("n1x")).alias("flipped"))


@query("point_line", f"WITH {PAIR} SELECT id1, id2, {norm(cross(sub(A2, A1), sub(A2, B1)))} / {norm(sub(B1, A1))} AS distance FROM v_pair")
def _(c):
    return c.pair.select("id1", "id2", G.point_to_line(G.start("a"), G.end("a"), G.start("b")).alias("distance"))


_d1 = over(sub(B1, A1), norm(sub(B1, A1)))


@query("project_on_line", f"WITH {PAIR}, t AS (SELECT *, {named(_d1, ['dx', 'dy', 'dz'])} FROM v_pair) SELECT id1, id2, {named(add(A1, times(vec('d'), dot(sub(A2, A1), vec('d')))), ['x', 'y', 'z'])} FROM t")
def _(c):
    return c.pair.select("id1", "id2", *G.onto_line(G.start("a"), G.end("a"), G.start("b")).aliased("x", "y", "z"))


@query("project_on_plane", f"WITH {LINE}, h AS (SELECT *, {named(_unit_normal(), ['ux', 'uy', 'uz'])} FROM v_line) SELECT line_id, {named(sub(A, times(vec('u'), f'({dot(vec("u"), A)} + n2x)')), ['x', 'y', 'z'])} FROM h")
def _(c):
    return c.line.select("line_id", *G.onto_plane(G.start(), (G.Vec.of("n1x", "n1y", "n1z").unit(), "n2x")).aliased("x", "y", "z"))


_n = cross(sub(B, A), sub(N1, A))


@query("plane_of_points", f"WITH {LINE}, t AS (SELECT *, {named(_n, ['mx', 'my', 'mz'])} FROM v_line), u AS (SELECT *, {named(over(vec('m'), norm(vec('m'))), ['ux', 'uy', 'uz'])} FROM t) SELECT line_id, {named(vec('u'), 'abc')}, -{dot(vec('u'), A)} AS d FROM u")
def _(c):
    n, d = G.plane_of_points(G.start(), G.end(), G.Vec.of("n1x", "n1y", "n1z"))
    return c.line.select("line_id", *n.aliased(*"abc"), d.alias("d"))


@query("plane_meets_line", f"WITH {LINE}, t AS (SELECT *, -(({dot(N1, A)} + 0.5) / {dot(N1, sub(B, A))}) AS t FROM v_line) SELECT line_id, {named(add(A, times(sub(B, A), 't')), ['x', 'y', 'z'])} FROM t")
def _(c):
    return c.line.select("line_id", *G.plane_meets_line((G.Vec.of("n1x", "n1y", "n1z"), 0.5), G.start(), G.end() - G.start()).aliased("x", "y", "z"))


_xy = lambda r1, r2, a1, b1, a2, b2: (f"(({r1}) * {b2} - {b1} * ({r2})) / ({a1} * {b2} - {b1} * {a2})", f"({a1} * ({r2}) - ({r1}) * {a2}) / ({a1} * {b2} - {b1} * {a2})")
_z = _xy("-(sx)", "-(ex)", "n1x", "n1y", "n2x", "n2y")
_y = _xy("-(sx)", "-(ex)", "n1x", "n1z", "n2x", "n2z")
_x = _xy("-(sx)", "-(ex)", "n1y", "n1z", "n2y", "n2z")
_case = lambda a, b, k: f"CASE WHEN abs(ez) > 0.1 THEN {a} WHEN abs(ey) > 0.1 THEN {b} ELSE {k} END"


@query("plane_intersection", f"WITH {LINE} SELECT line_id, {_case(_z[0], _y[0], '0.0')} AS x, {_case(_z[1], '0.0', _x[0])} AS y, {_case('0.0', _y[1], _x[1])} AS z FROM v_line")
def _(c):
    p = G.on_both_planes((G.Vec.of("n1x", "n1y", "n1z"), "sx"), (G.Vec.of("n2x", "n2y", "n2z"), "ex"), G.end())
    return c.line.select("line_id", *p.aliased("x", "y", "z"))


@query("project_px", f"WITH {LINE} SELECT line_id, round_even((sx * 600.0) / (sz + 2) + 319.5, 0)::INT AS u, round_even((sy * 600.0) / (sz + 2) + 239.5, 0)::INT AS v FROM v_line")
def _(c):
    u, v = G.project(G.Vec.of("sx", "sy", F.col("sz") + 2), 600.0, 600.0, 319.5, 239.5)
    return c.line.select("line_id", F.rint(u).cast("int").alias("u"), F.rint(v).cast("int").alias("v"))


@query("shrink_2d", f"""WITH {PX}, t AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS n FROM v_px),
 u AS (SELECT *, x0 + (x1 - x0) / n * 0.25 AS p0, y0 + (y1 - y0) / n * 0.25 AS q0, x1 - (x1 - x0) / n * 0.25 AS p1, y1 - (y1 - y0) / n * 0.25 AS q1 FROM t),
 w AS (SELECT *, sqrt((p1 - p0) * (p1 - p0) + (q1 - q0) * (q1 - q0)) < 1 AS short FROM u)
 SELECT line_id, {", ".join(f"CASE WHEN short THEN {a} ELSE {b} END AS {a}" for a, b in (("x0", "p0"), ("y0", "q0"), ("x1", "p1"), ("y1", "q1")))} FROM w""")
def _(c):
    return c.px.select("line_id", *[x.alias(n) for x, n in zip(G.shrunk_2d(("x0", "y0", "x1", "y1"), 0.5), ("x0", "y0", "x1", "y1"))])


_m = "((ay1 - ay0) / (ax1 - ax0) + (by1 - by0) / (bx1 - bx0) > 0)"
_ys = "ay0, ay1, by0, by1"


@query("merge_2d", f"WITH {PX_PAIR} SELECT id1, id2, least(ax0, ax1, bx0, bx1) AS x0, CASE WHEN {_m} THEN least({_ys}) ELSE greatest({_ys}) END AS y0, greatest(ax0, ax1, bx0, bx1) AS x1, CASE WHEN {_m} THEN greatest({_ys}) ELSE least({_ys}) END AS y1 FROM v_px_pair")
def _(c):
    return c.px_pair.select("id1", "id2", *[x.alias(n) for x, n in zip(G.merged_2d(("ax0", "ay0", "ax1", "ay1"), ("bx0", "by0", "bx1", "by1")), ("x0", "y0", "x1", "y1"))])


_ends2 = ", ".join(f"(a{x} - b{p}) * (a{x} - b{p}) + (a{y} - b{q}) * (a{y} - b{q})" for x, y in (("x0", "y0"), ("x1", "y1")) for p, q in (("x0", "y0"), ("x1", "y1")))
_dd = "((ax0 - ax1) * (bx0 - bx1) + (ay0 - ay1) * (by0 - by1))"


@query("lines_equal_2d", f"WITH {PX_PAIR} SELECT id1, id2 FROM v_px_pair WHERE {_dd} * {_dd} / (((ax0 - ax1) * (ax0 - ax1) + (ay0 - ay1) * (ay0 - ay1)) * ((bx0 - bx1) * (bx0 - bx1) + (by0 - by1) * (by0 - by1))) > 0.9 AND least({_ends2}) < 200.0")
def _(c):
    return c.px_pair.filter(G.equal_2d(("ax0", "ay0", "ax1", "ay1"), ("bx0", "by0", "bx1", "by1"), 0.9, 200.0)).select("id1", "id2")


_rect = """t AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS n FROM v_px), u AS (SELECT *, CASE WHEN 5.0 > n * 0.5 THEN n * 0.5 ELSE 5.0 END AS size FROM t)"""


@query("rectangles_2d", f"WITH {PX}, {_rect} SELECT line_id, x0 + -(y1 - y0) * (0.5 / n) AS lx0, y0 + (x1 - x0) * (0.5 / n) AS ly0, x1 + -(y1 - y0) * ((0.5 + size) / n) AS lx3, y1 + (x1 - x0) * ((0.5 + size) / n) AS ly3, x0 + (y1 - y0) * (0.5 / n) AS rx0, y0 + -(x1 - x0) * (0.5 / n) AS ry0 FROM u")
def _(c):
    left, right = G.rectangles_2d(("x0", "y0", "x1", "y1"))
    return c.px.select("line_id", *left[0].aliased("lx0", "ly0"), *left[3].aliased("lx3", "ly3"), *right[0].aliased("rx0", "ry0"))


def clipped() -> str:
    """CTEs that cut the lines of v_wide to 320 x 240: k has p0, q0, p1, q1 and whether nothing is left."""
    at = "t AS (SELECT *, x1 - x0 AS dx, y1 - y0 AS dy FROM v_wide), "
    at += "u AS (SELECT *, CASE WHEN dx = 0 THEN 0.0 ELSE least(-x0 / dx, (320.0 - x0) / dx) END AS ex, CASE WHEN dx = 0 THEN 1.0 ELSE greatest(-x0 / dx, (320.0 - x0) / dx) END AS lx, CASE WHEN dy = 0 THEN 0.0 ELSE least(-y0 / dy, (240.0 - y0) / dy) END AS ey, CASE WHEN dy = 0 THEN 1.0 ELSE greatest(-y0 / dy, (240.0 - y0) / dy) END AS ly FROM t), "
    at += "w AS (SELECT *, greatest(0.0, ex, ey) AS a, least(1.0, lx, ly) AS b, (dx = 0 AND (x0 < 0 OR x0 > 320)) OR (dy = 0 AND (y0 < 0 OR y0 > 240)) AS outside FROM u), "
    box = lambda v, hi: f"CASE WHEN {v} < 0.0 THEN 0.0 WHEN {v} > {hi} THEN {hi} ELSE {v} END"
    at += f"z AS (SELECT *, CASE WHEN a > 0 THEN {box('x0 + dx * a', '320.0')} ELSE x0 END AS p0, CASE WHEN a > 0 THEN {box('y0 + dy * a', '240.0')} ELSE y0 END AS q0, CASE WHEN b < 1 THEN {box('x0 + dx * b', '320.0')} ELSE x0 + dx END AS p1, CASE WHEN b < 1 THEN {box('y0 + dy * b', '240.0')} ELSE y0 + dy END AS q1 FROM w), "
    return at + "k AS (SELECT *, outside OR a > b OR sqrt((p1 - p0) * (p1 - p0) + (q1 - q0) * (q1 - q0)) < 1e-4 AS nothing FROM z) "


def _clip_sql() -> str:
    return f"WITH {PX}, v_wide AS (SELECT line_id, x0 * 4 - 480 AS x0, y0 * 4 - 360 AS y0, x1 * 4 - 480 AS x1, y1 * 4 - 360 AS y1 FROM v_px), {clipped()} SELECT line_id, CASE WHEN nothing THEN 0.0 ELSE p0 END AS x0, CASE WHEN nothing THEN 0.0 ELSE q0 END AS y0, CASE WHEN nothing THEN 0.0 ELSE p1 END AS x1, CASE WHEN nothing THEN 0.0 ELSE q1 END AS y1 FROM k"


@query("fit_to_bounds", _clip_sql())
def _(c):
    wide = c.px.select("line_id", *[(F.col(x) * 4 - m).alias(x) for x, m in (("x0", 480), ("y0", 360), ("x1", 480), ("y1", 360))])
    return lines.fit_to_bounds(wide.select("line_id", "x0", "y0", "x1", "y1"), 320, 240)


_swap = f"{norm(sub(A2, B1))} < {norm(sub(A2, A1))} AND {norm(sub(B2, A1))} < {norm(sub(B2, B1))}"


@query("orient", f"WITH {PAIR} SELECT id1, id2, CASE WHEN {_swap} THEN bex ELSE bsx END AS sx, CASE WHEN {_swap} THEN bsx ELSE bex END AS ex FROM v_pair")
def _(c):
    a, b = G.oriented(G.start("b"), G.end("b"), G.start("a"), G.end("a"))
    return c.pair.select("id1", "id2", a.c[0].alias("sx"), b.c[0].alias("ex"))


_pn = cross(sub(A1, B1), sub(A2, B2))


@query("dist_perpendicular", f"WITH {PAIR} SELECT id1, id2, CASE WHEN {norm(_pn)} < 1e-6 THEN {norm(cross(sub(A2, A1), sub(A2, B1)))} / {norm(sub(B1, A1))} ELSE abs({dot(_pn, sub(A2, A1))}) / {norm(_pn)} END AS d FROM v_pair")
def _(c):
    return c.pair.select("id1", "id2", G.perpendicular_distance(G.start("a"), G.end("a"), G.start("b"), G.end("b")).alias("d"))


_mid = sub(times(add(A1, B1), "0.5"), times(add(A2, B2), "0.5"))


@query("dist_mean_squared", f"WITH {PAIR} SELECT id1, id2, {dot(_mid, _mid)} AS d FROM v_pair")
def _(c):
    return c.pair.select("id1", "id2", G.mean_difference_squared(G.start("a"), G.end("a"), G.start("b"), G.end("b")).alias("d"))


@query("dist_nearest_squared", f"WITH {PAIR} SELECT id1, id2, least({', '.join(dot(sub(p, q), sub(p, q)) for p in (A1, B1) for q in (A2, B2))}) AS d FROM v_pair")
def _(c):
    return c.pair.select("id1", "id2", G.nearest_difference_squared(G.start("a"), G.end("a"), G.start("b"), G.end("b")).alias("d"))


def _segment_sql() -> str:
    u, v, w = sub(B1, A1), sub(B2, A2), sub(A1, A2)
    t = f"t AS (SELECT *, {dot(u, u)} AS uu, {dot(u, v)} AS uv, {dot(v, v)} AS vv, {dot(u, w)} AS uw, {dot(v, w)} AS vw FROM v_pair), "
    t += "d AS (SELECT *, uu * vv - uv * uv AS det, (uv * vw - vv * uw) / (uu * vv - uv * uv) AS s, (uu * vw - uv * uw) / (uu * vv - uv * uv) AS t FROM t), "

    def end_to(p, q, dv, dd):
        k = f"{dot(sub(p, q), dv)} / {dd}"
        k = f"(CASE WHEN {k} < 0.0 THEN 0.0 WHEN {k} > 1.0 THEN 1.0 ELSE {k} END)"
        g = sub(p, add(q, times(dv, k)))
        return dot(g, g)

    gap = sub(add(w, times(u, "s")), times(v, "t"))
    ends = f"least({end_to(A1, A2, v, 'vv')}, {end_to(B1, A2, v, 'vv')}, {end_to(A2, A1, u, 'uu')}, {end_to(B2, A1, u, 'uu')})"
    return f"WITH {PAIR}, {t} e AS (SELECT id1, id2, sqrt(CASE WHEN det > 1e-12 AND s >= 0 AND s <= 1 AND t >= 0 AND t <= 1 THEN {dot(gap, gap)} ELSE {ends} END) AS d FROM d) SELECT id1, id2, floor(d * 1e6 + 0.5)::BIGINT AS d FROM e"


@query("dist_segments", _segment_sql())
def _(c):
    return segment_distances(c.pair).select("id1", "id2", micro(F.col("distance")).alias("d"))


@query("similar_length", f"WITH {PAIR} SELECT id1, id2 FROM v_pair WHERE NOT ({norm(sub(B1, A1))} / {norm(sub(B2, A2))} > 1.5 OR {norm(sub(B2, A2))} / {norm(sub(B1, A1))} > 1.5)")
def _(c):
    return c.pair.filter(G.similar_length(G.length_of(G.start("a"), G.end("a")), G.length_of(G.start("b"), G.end("b")))).select("id1", "id2")


_u1, _u2 = over(sub(B1, A1), norm(sub(B1, A1))), over(sub(B2, A2), norm(sub(B2, A2)))


def coincide_rows() -> str:
    """CTEs that take the coinciding ones (angle 0.8, distance 0.15) of v_pair: same_."""
    t = f"t AS (SELECT *, {named(_u1, ['px', 'py', 'pz'])}, {named(_u2, ['qx', 'qy', 'qz'])}, {norm(sub(B1, A1))} AS n FROM v_pair), "
    P = vec("p")
    t += f"w AS (SELECT *, {dot(P, sub(A2, A1))} AS x, {dot(P, sub(B2, A1))} AS y, {norm(cross(P, sub(A2, A1)))} AS d1, {norm(cross(P, sub(B2, A1)))} AS d2 FROM t)"
    return f"{t}, same_ AS (SELECT * FROM w WHERE abs({dot(P, vec('q'))}) > {math.cos(0.8)!r} AND (d1 < 0.15 OR d2 < 0.15) AND ((least(x, y) < 0 AND greatest(x, y) > 0) OR (least(x, y) > 0 AND least(x, y) < n)))"


@query("lines_coincide", f"WITH {PAIR}, {coincide_rows()} SELECT id1, id2 FROM same_")
def _(c):
    return c.pair.filter(G.coincide(G.start("a"), G.end("a"), G.start("b"), G.end("b"), 0.8, 0.15)).select("id1", "id2")


_q = "t AS (SELECT *, sqrt(n1x * n1x + n1y * n1y + n1z * n1z + n2x * n2x) AS qn FROM v_line), q AS (SELECT *, n1x / qn AS i, n1y / qn AS j, n1z / qn AS k, n2x / qn AS w FROM t)"


@query("pose_transform", f"WITH {LINE}, {_q} SELECT line_id, (1 - 2 * (j * j + k * k)) * sx + (2 * (i * j - k * w)) * sy + (2 * (i * k + j * w)) * sz + ex AS x, (2 * (i * j + k * w)) * sx + (1 - 2 * (i * i + k * k)) * sy + (2 * (j * k - i * w)) * sz + ey AS y, (2 * (i * k - j * w)) * sx + (2 * (j * k + i * w)) * sy + (1 - 2 * (i * i + j * j)) * sz + ez AS z FROM q")
def _(c):
    n = F.sqrt(F.col("n1x") * F.col("n1x") + F.col("n1y") * F.col("n1y") + F.col("n1z") * F.col("n1z") + F.col("n2x") * F.col("n2x"))
    df = c.line.withColumn("qn", n).select("line_id", *[f"{p}{k}" for p in "se" for k in "xyz"], *[(F.col(a) / F.col("qn")).alias(b) for a, b in (("n1x", "i"), ("n1y", "j"), ("n1z", "k"), ("n2x", "w"))])
    return df.select("line_id", *G.transform(G.rotation(*map(F.col, "ijkw")), G.start(), G.end()).aliased("x", "y", "z"))


_turn = (0.1, -0.3, 0.5, math.sqrt(1 - 0.01 - 0.09 - 0.25))


def _turned_sql() -> str:
    x, y, z, w = _turn
    rows = [(1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)), (2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)), (2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y))]
    own = [f"floor(({' + '.join(f'{k!r}::DOUBLE * {p}{c}' for k, c in zip(r, 'xyz'))}{f' + {m}' if p in 'se' else ''}) * 1e6 + 0.5)::BIGINT AS {p}{d}" for p in ("s", "e", "n1", "n2") for d, r, m in zip("xyz", rows, (1, -2, 3))]
    return f"WITH {LINE} SELECT line_id, {', '.join(own)} FROM v_line"


@query("transform_lines", _turned_sql())
def _(c):
    moved = c.line.select("line_id", *G.transform_line(G.rotation(*map(F.lit, _turn)), G.Vec((F.lit(1.0), F.lit(-2.0), F.lit(3.0)))))
    return moved.select("line_id", *[micro(F.col(x)).alias(x) for x in moved.columns[1:]])


@query("intrinsics", "SELECT kind, floor(fx * 1e6 + 0.5)::BIGINT AS fx, floor(fy * 1e6 + 0.5)::BIGINT AS fy, cx, cy FROM (VALUES ('focal', 600::DOUBLE, 600::DOUBLE, 320::DOUBLE, 240::DOUBLE), ('view', 160 / tan(radians(30)), 120 / tan(radians(22.5)), 160::DOUBLE, 120::DOUBLE)) AS t(kind, fx, fy, cx, cy)")
def _(c):
    row = lambda kind, k: c.spark.range(1).select(F.lit(kind).alias("kind"), *[micro(x).alias(n) if n[0] == "f" else x.alias(n) for n, x in zip(("fx", "fy", "cx", "cy"), k)])
    return row("focal", G.intrinsics(640.0, 480.0, 600.0, 600.0)).unionByName(row("view", G.intrinsics_of_view(320.0, 240.0, 60.0, 45.0)))


def _look_sql() -> str:
    z = over(sub(B, A), norm(sub(B, A)))
    t = f"t AS (SELECT *, {named(z, ['zx', 'zy', 'zz'])} FROM v_line), "
    x = cross(vec("z"), sub(N1, A))
    t += f"u AS (SELECT *, {named(x, ['cx', 'cy', 'cz'])} FROM t), w AS (SELECT *, {named(over(vec('c'), norm(vec('c'))), ['xx', 'xy', 'xz'])} FROM u)"
    y = cross(vec("z"), vec("x"))
    return f"WITH {LINE}, {t} SELECT line_id, xx, {y[0]} AS yx, zx, -{dot(vec('x'), A)} AS tx FROM w"


@query("look_at", _look_sql())
def _(c):
    rows, shift = G.look_at(G.start(), G.end(), G.Vec.of("n1x", "n1y", "n1z"))
    return c.line.select("line_id", rows[0].c[0].alias("xx"), rows[1].c[0].alias("yx"), rows[2].c[0].alias("zx"), shift.c[0].alias("tx"))


@query("back_project", f"WITH {PX} SELECT line_id, (x0 - 159.5) * 2.5 / 600.0 AS x, (y0 - 119.5) * 2.5 / 600.0 AS y, trunc(2500.0 / sqrt(((x0 - 159.5) / 600.0) * ((x0 - 159.5) / 600.0) + ((y0 - 119.5) / 600.0) * ((y0 - 119.5) / 600.0) + 1.0))::INT AS mm FROM v_px")
def _(c):
    p = G.back_project(F.col("x0"), F.col("y0"), F.lit(2.5), 600.0, 600.0, 159.5, 119.5)
    return c.px.select("line_id", p.c[0].alias("x"), p.c[1].alias("y"), G.ray_to_depth(F.col("x0"), F.col("y0"), F.lit(2500.0), 600.0, 600.0, 159.5, 119.5).alias("mm"))


def camera_sql() -> str:
    x = over(sub(B, A), norm(sub(B, A)))
    t = f"t AS (SELECT *, {named(x, ['dx', 'dy', 'dz'])}, {named(times(add(A, B), '0.5'), ['mx', 'my', 'mz'])} FROM v_line), "
    unit = lambda v: over(v, norm(v))
    neg = lambda v: [f"(-{k})" for k in v]
    flat = [f"CASE WHEN {norm(N1)} <= 0.001 AND type = 0 THEN n2{k} ELSE n1{k} END" for k in "xyz"]
    sums = [unit(add(N1, N2)), unit(sub(N1, N2)), unit(sub(neg(N1), N2)), unit(add(neg(N1), N2))]
    rows = [f"SELECT line_id, {i} AS i, dx, dy, dz, mx, my, mz, {named(z, ['zx', 'zy', 'zz'])} FROM t WHERE type {op} 2" for op, zs in (("<", [flat, [f"-({k})" for k in flat]]), (">=", sums)) for i, z in enumerate(zs)]
    t += f"u AS ({' UNION ALL '.join(rows)}), v AS (SELECT *, {named(sub(vec('z'), times(vec('d'), dot(vec('z'), vec('d')))), ['px', 'py', 'pz'])} FROM u), "
    t += f"w AS (SELECT line_id, i, {named(sub(vec('m'), times(over(vec('p'), norm(vec('p'))), '0.25')), ['x', 'y', 'z'])} FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY sqrt(x * x + y * y + z * z), i) AS r FROM w)"
    return f"WITH {LINE}, {t} SELECT line_id, floor(x * 1e6 + 0.5)::BIGINT AS x, floor(y * 1e6 + 0.5)::BIGINT AS y, floor(z * 1e6 + 0.5)::BIGINT AS z FROM r WHERE r = 1"


@query("virtual_camera", camera_sql())
def _(c):
    return virtual_camera_origins(c.line, 0.25).select("line_id", *[micro(F.col(f"cam{k}")).alias(k) for k in "xyz"])


@query("normalise", f"WITH {LINE} SELECT line_id, sx / 2.0 AS half, sz - 3.0 AS centred, {norm(sub(B, A))} AS length FROM v_line")
def _(c):
    return c.line.select("line_id", (F.col("sx") / 2.0).alias("half"), (F.col("sz") - 3.0).alias("centred"), G.length_of(G.start(), G.end()).alias("length"))


_dir = over(sub(B, A), norm(sub(B, A)))


@query("centre_direction", f"WITH {LINE}, t AS (SELECT *, {named(_dir, ['dx', 'dy', 'dz'])} FROM v_line) SELECT line_id, {named(over(add(A, B), '2.0'), ['cx', 'cy', 'cz'])}, {', '.join(f'CASE WHEN dx < 0 THEN -{k} ELSE {k} END AS o{k}' for k in ('dx', 'dy', 'dz'))} FROM t")
def _(c):
    m, d = G.centre_direction(G.start(), G.end())
    return c.line.select("line_id", *m.aliased("cx", "cy", "cz"), *d.aliased("odx", "ody", "odz"))


@query("pluecker", f"WITH {LINE} SELECT line_id, {named(cross(A, B), ['nx', 'ny', 'nz'])}, {named(sub(B, A), ['vx', 'vy', 'vz'])} FROM v_line")
def _(c):
    n, v = G.pluecker(G.start(), G.end())
    return c.line.select("line_id", *n.aliased("nx", "ny", "nz"), *v.aliased("vx", "vy", "vz"))


def _orthonormal_sql() -> str:
    t = f"t AS (SELECT line_id, {named(cross(A, B), ['nx', 'ny', 'nz'])}, {named(sub(B, A), ['vx', 'vy', 'vz'])} FROM v_line), "
    t += f"u AS (SELECT *, {named(cross(vec('n'), vec('v')), ['cx', 'cy', 'cz'])}, {norm(vec('n'))} AS nn, {norm(vec('v'))} AS vn FROM t)"
    cn = norm(vec("c"))
    m = lambda x: f"floor({x} * 1e6 + 0.5)::BIGINT"
    return f"WITH {LINE}, {t} SELECT line_id, {m(f'atan2(vz / vn, cz / {cn})')} AS t1, {m('atan2(-(nz / nn), sqrt(nx / nn * (nx / nn) + ny / nn * (ny / nn)))')} AS t2, {m('atan2(ny / nn, nx / nn)')} AS t3, {m('atan2(vn, nn)')} AS t4 FROM u"


@query("orthonormal", _orthonormal_sql())
def _(c):
    return c.line.select("line_id", *[micro(x).alias(f"t{i + 1}") for i, x in enumerate(G.orthonormal(*G.pluecker(G.start(), G.end())))])


@query("heat_colour", f"WITH {LINE}, t AS (SELECT line_id, least(greatest(sx * 2 + 0.5, 0.0), 1.0) AS v FROM v_line) SELECT line_id, CASE WHEN v < 0.5 THEN 0 WHEN v < 0.75 THEN floor((v * 4 - 2) * 255.0)::INT ELSE 255 END AS r, CASE WHEN v < 0.25 THEN floor(v * 4 * 255.0)::INT WHEN v < 0.75 THEN 255 ELSE floor(255.0 + (v * 4 - 3) * -255.0)::INT END AS g, CASE WHEN v < 0.25 THEN 255 WHEN v < 0.5 THEN floor(255.0 + (v * 4 - 1) * -255.0)::INT ELSE 0 END AS b FROM t")
def _(c):
    return c.line.select("line_id", *[x.alias(n) for x, n in zip(G.heat(F.col("sx") * 2 + 0.5), "rgb")])


@query("scale_descriptor", f"WITH {LINE}, t AS (SELECT line_id, list_transform(embedding[1:4], lambda x: floor(abs(x::DOUBLE) * 255) / 255.0) AS d FROM v_line) SELECT line_id, d[1] AS d1, d[4] AS d4 FROM t")
def _(c):
    raw = F.transform(F.slice("embedding", 1, 4), lambda x: F.floor(F.abs(x.cast("double")) * 255))
    return c.line.select("line_id", V.scale_bytes(raw)[0].alias("d1"), V.scale_bytes(raw)[3].alias("d4"))


@query("argmax", f"WITH {LINE} SELECT line_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS best FROM v_line")
def _(c):
    return c.line.select("line_id", V.argmax(F.col("embedding")).alias("best"))


@query("path_parts", "SELECT page_id, split_part(url, '/', -2) AS scene, split_part(url, '/', -1) AS name, split_part(split_part(url, '/', -1), '?', 1) AS frame, split_part(split_part(url, '/', 3), '.', 1) AS floor FROM pages")
def _(c):
    parts = F.split("url", "/")
    return c.path.select("page_id", F.element_at(parts, -2).alias("scene"), F.element_at(parts, -1).alias("name"), F.substring_index(F.element_at(parts, -1), "?", 1).alias("frame"), F.substring_index(F.element_at(parts, 3), ".", 1).alias("floor"))


@query("scene_filter", "SELECT page_id FROM pages WHERE contains(url, '/fr/') OR NOT (contains(url, 'utm_source') OR contains(url, 'm.'))")
def _(c):
    has = lambda *x: [F.col("url").contains(k) for k in x]
    white, (b1, b2) = has("/fr/")[0], has("utm_source", "m.")
    return c.path.filter(white | ~(b1 | b2)).select("page_id")


@query("pixel_walk")
def _(c):
    return c.px.select("line_id", F.posexplode(G.pixel_walk("x0", "y0", "x1", "y1")).alias("row", "u"))


@query("augment_flip", f"WITH {LINE} SELECT line_id, CASE WHEN line_id * 7919 % 10 < 5 THEN ex ELSE sx END AS sx, CASE WHEN line_id * 7919 % 10 < 5 THEN sx ELSE ex END AS ex FROM v_line")
def _(c):
    flip = F.col("line_id") * 7919 % 10 < 5
    return c.line.select("line_id", F.when(flip, F.col("ex")).otherwise(F.col("sx")).alias("sx"), F.when(flip, F.col("sx")).otherwise(F.col("ex")).alias("ex"))
