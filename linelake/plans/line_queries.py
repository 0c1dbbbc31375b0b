"""Queries of the line-level rules over the carriers, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from linelake.functions import geometry as G
from linelake.operators import batches, cameras, clustering, detection, fusion, labelling, lifting, lines, metrics, pixels, planes, trees, votes
from linelake.plans.carriers import DIM, LINE, PAIR, PID, POINT, PX, Carriers
from linelake.plans.geometry_queries import camera_sql, clipped, coincide_rows, cross, dot, micro, norm, sub, times, vec
from linelake.sources.settings import LineSettings

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Carriers(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


_mid = times([f"({a} + {b})" for a, b in zip(vec("s"), vec("e"))], "0.5")


def _facing() -> str:
    turned = ", ".join(f"CASE WHEN {dot(vec(n), _mid)} > 0 THEN -{n}{c} ELSE {n}{c} END AS t{n[1]}{c}" for n in ("n1", "n2") for c in "xyz")
    swap = f"{norm(vec('t1'))} > 1e-3 AND {norm(vec('t2'))} > 1e-3 AND {dot(cross(vec('t1'), vec('t2')), sub(vec('e'), vec('s')))} < 0"
    out = ", ".join(f"CASE WHEN swap THEN t{b}{c} ELSE t{a}{c} END AS n{a}{c}" for a, b in (("1", "2"), ("2", "1")) for c in "xyz")
    return f"WITH {LINE}, t AS (SELECT *, {turned} FROM v_line), u AS (SELECT *, {swap} AS swap FROM t) SELECT line_id, {out} FROM (SELECT line_id, swap, {', '.join(f't{k}{c}' for k in '12' for c in 'xyz')} FROM u)"


@query("facing_normals", _facing())
def _(c):
    return lines.facing_normals(c.line).select("line_id", *[f"n{k}{x}" for k in "12" for x in "xyz"])


_uv = "t AS (SELECT line_id, sx, sy, sz, ex, ey, ez, (sx * 300.0) / (sz + 1) + 160.0 AS u0, (sy * 300.0) / (sz + 1) + 120.0 AS v0, (ex * 300.0) / (ez + 1) + 160.0 AS u1, (ey * 300.0) / (ez + 1) + 120.0 AS v1 FROM v_line)"


def _valid() -> str:
    w = "w AS (SELECT *, u0 + n AS x0, v0 AS y0, u1 AS x1, v1 - n AS y1 FROM (SELECT *, (line_id % 5) * 4.0 AS n FROM t))"
    p = "p AS (SELECT *, sz + 1 AS az, ez + 1 AS bz, u1 - u0 AS du, v1 - v0 AS dv, x1 - x0 AS dx, y1 - y0 AS dy FROM w)"
    r, o = "sqrt(du * du + dv * dv)", "sqrt(dx * dx + dy * dy)"
    cond = f"sqrt(sx * sx + sy * sy + az * az) > 1e-3 AND sqrt(ex * ex + ey * ey + bz * bz) > 1e-3 AND sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy) + (bz - az) * (bz - az)) >= 0.15"
    cond += " AND (x0 + x1) / 2 >= 2.0 AND (y0 + y1) / 2 >= 2.0 AND (x0 + x1) / 2 <= 318.0 AND (y0 + y1) / 2 <= 238.0"
    cond += f" AND {r} >= 2 AND abs((du * dx + dv * dy) / ({r} * {o})) >= 0.95 AND NOT ({r} / {o} > 2.0 OR {o} / {r} > 2.0)"
    return f"WITH {LINE}, {_uv}, {w}, {p} SELECT line_id FROM p WHERE {cond}"


@query("valid_lines", _valid())
def _(c):
    df = c.line.select("line_id", "sx", "sy", (F.col("sz") + 1).alias("sz"), "ex", "ey", (F.col("ez") + 1).alias("ez"))
    (u0, v0), (u1, v1) = G.project(G.start(), 300.0, 300.0, 160.0, 120.0), G.project(G.end(), 300.0, 300.0, 160.0, 120.0)
    n = (F.col("line_id") % 5) * 4.0
    df = df.select("*", (u0 + n).alias("x0"), v0.alias("y0"), u1.alias("x1"), (v1 - n).alias("y1"))
    return lines.valid_lines(df, 320, 240, 300.0, 160.0, 120.0).select("line_id")


@query("gated_labels", f"WITH {LINE} SELECT line_id, CASE WHEN type = 0 THEN CASE WHEN sx < ex THEN label ELSE class_id + 1 END WHEN type IN (1, 3) THEN CASE WHEN n1x <= n2x THEN label ELSE class_id + 1 END ELSE 7 END AS label FROM v_line")
def _(c):
    label = lines.gated_label(F.col("type"), F.col("label"), F.col("class_id") + 1, F.col("sx") < F.col("ex"), F.lit(7), F.col("n1x"), F.col("n2x"))
    return c.line.select("line_id", label.alias("label"))


@query("background_labels", f"WITH {LINE} SELECT line_id, CASE WHEN label NOT IN (0, 9) AND type IN (0, 9) THEN type::INT ELSE label END AS label FROM v_line")
def _(c):
    return c.line.select("line_id", lines.background_first(F.col("label"), F.col("label"), F.col("type").cast("int"), F.col("type"), [0, 9]).alias("label"))


@query("orthographic", f"WITH {POINT}, p AS (SELECT *, floor((u - 40) / 4.0)::INT AS pu, floor((v - 20) / 4.0)::INT AS pv FROM v_point WHERE (u - 40) / 4.0 >= 0 AND (u - 40) / 4.0 < 64 AND (v - 20) / 4.0 >= 0 AND (v - 20) / 4.0 < 48) SELECT frame_id, pu AS u, pv AS v, min(z) AS z, count(*) AS n_points FROM p GROUP BY ALL")
def _(c):
    p = c.point.select("frame_id", F.col("u").cast("double").alias("x"), F.col("v").cast("double").alias("y"), "z", *PID)
    return lines.orthographic(p, ["frame_id"], (40.0, 20.0), (64, 48), 4.0, PID)


@query("last_frames", f"WITH {LINE} SELECT f.frame_id, count(*) AS n FROM (SELECT DISTINCT frame_id FROM v_line) f JOIN v_line l ON l.frame_id BETWEEN f.frame_id - 2 AND f.frame_id GROUP BY ALL")
def _(c):
    return lines.last_frames(c.line, c.line.select("frame_id", "line_id"), 3).groupBy("frame_id").agg(F.count("*").alias("n"))


@query("pruned_scenes", f"WITH {LINE}, f AS (SELECT scene_id, frame_id, count_if(label > 2) AS n_lines FROM v_line GROUP BY ALL), e AS (SELECT *, count(*) OVER (PARTITION BY scene_id) AS n, row_number() OVER (PARTITION BY scene_id ORDER BY frame_id * 7919 % 101, frame_id) AS r FROM f WHERE n_lines >= 16) SELECT scene_id, frame_id, n_lines FROM e WHERE n >= 2 AND r <= 3")
def _(c):
    f = c.line.groupBy("scene_id", "frame_id").agg(F.count_if(F.col("label") > 2).alias("n_lines"))
    return lines.pruned_scenes(f, 2, 3, 16, F.col("frame_id") * 7919 % 101)




@query("pair_divergence", f"WITH {LINE}, a AS (SELECT line_id, label, [abs(x::DOUBLE) for x in embedding[1:8]] AS p FROM v_line), j AS (SELECT x.line_id, x.label = y.label AS same, list_sum([x.p[i] * ln((x.p[i] + 1e-10) / (y.p[i] + 1e-10)) for i in range(1, 9)]) AS k1, list_sum([y.p[i] * ln((y.p[i] + 1e-10) / (x.p[i] + 1e-10)) for i in range(1, 9)]) AS k2 FROM a x JOIN a y ON y.line_id = x.line_id + 1) SELECT line_id, floor((CASE WHEN same THEN k1 + k2 ELSE greatest(2.0 - k1, 0.0) + greatest(2.0 - k2, 0.0) END) * 1e5 + 0.5)::BIGINT AS loss FROM j")
def _(c):
    own = F.transform(F.slice("embedding", 1, 8), lambda x: F.abs(x.cast("double")))
    a = c.line.select("line_id", "label", own.alias("p"))
    b = c.line.select((F.col("line_id") - 1).alias("line_id"), F.col("label").alias("l2"), own.alias("q"))
    loss = lines.pair_divergence(F.col("p"), F.col("q"), F.col("label") == F.col("l2"))
    return a.join(b, "line_id").select("line_id", F.floor(loss * 1e5 + 0.5).cast("long").alias("loss"))


@query("cross_entropy", f"WITH {LINE} SELECT line_id, floor(-(CASE WHEN label = 0 THEN ln(abs(sx) + 1e-10) ELSE ln(1 - abs(sx) + 1e-10) END) * 1e6 + 0.5)::BIGINT AS loss FROM v_line")
def _(c):
    return c.line.select("line_id", F.floor(lines.cross_entropy(F.col("label") == 0, F.abs("sx")) * 1e6 + 0.5).cast("long").alias("loss"))


@query("frame_counts", f"WITH {LINE}, n AS (SELECT label, count(DISTINCT frame_id) AS n FROM v_line GROUP BY ALL) SELECT min(n) AS least, max(n) AS greatest, count_if(n > 1) AS over_1, count_if(n > 3) AS over_3 FROM n")
def _(c):
    return lines.frame_counts(c.line.select("label", "frame_id").distinct(), "label")


@query("fused_frames", f"WITH {LINE}, k AS (SELECT label AS k, frame_id, type AS label, (line_id % 3) AS class_id, (line_id * 37 % 101) AS n_pixels FROM v_line), l AS (SELECT k, label, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, label) AS r FROM k GROUP BY k, label), c AS (SELECT k, class_id, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, class_id) AS r FROM k GROUP BY k, class_id), i AS (SELECT k, frame_id AS image_frame, count(*) OVER (PARTITION BY k) AS n_frames, row_number() OVER (PARTITION BY k ORDER BY n_pixels DESC, frame_id) AS r FROM k) SELECT k, l.label, c.class_id, image_frame, n_frames FROM l JOIN c USING (k) JOIN i USING (k) WHERE l.r = 1 AND c.r = 1 AND i.r = 1")
def _(c):
    k = c.line.select(F.col("label").alias("k"), "frame_id", F.col("type").alias("label"), (F.col("line_id") % 3).alias("class_id"), (F.col("line_id") * 37 % 101).alias("n_pixels"))
    return lines.fused_frames(k, ["k"])


_near = f"WITH {LINE}, {POINT}, j AS (SELECT l.frame_id, l.line_id, sx, sy, sz, ex, ey, ez, p.u / 320.0 - 0.5 AS x, p.v / 240.0 - 0.5 AS y, p.z / 50.0 - 0.5 AS z FROM v_line l JOIN v_point p USING (frame_id)), q AS (SELECT *, sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy) + (ez - sz) * (ez - sz)) AS n FROM j), d AS (SELECT *, (x - sx) * ((ex - sx) / n) + (y - sy) * ((ey - sy) / n) + (z - sz) * ((ez - sz) / n) AS t, sqrt(((y - sy) * (z - ez) - (z - sz) * (y - ey)) * ((y - sy) * (z - ez) - (z - sz) * (y - ey)) + ((z - sz) * (x - ex) - (x - sx) * (z - ez)) * ((z - sz) * (x - ex) - (x - sx) * (z - ez)) + ((x - sx) * (y - ey) - (y - sy) * (x - ex)) * ((x - sx) * (y - ey) - (y - sy) * (x - ex))) / n AS far FROM q)"


def _points_and_lines(c: Carriers):
    points = c.point.select("frame_id", (F.col("u") / 320.0 - 0.5).alias("x"), (F.col("v") / 240.0 - 0.5).alias("y"), (F.col("z") / 50.0 - 0.5).alias("z"))
    return points, c.line.select("frame_id", "line_id", "sx", "sy", "sz", "ex", "ey", "ez")


def _beside(c: Carriers):
    points, own = _points_and_lines(c)
    return points.join(own, "frame_id"), own


@query("covered_tenths", f"{_near} SELECT frame_id, line_id, min(least(floor(t / n * 10), 9))::INT AS first_bin, max(least(floor(t / n * 10), 9))::INT AS last_bin, count(*) AS n FROM d WHERE far <= 0.1 AND t / n >= 0 AND t / n <= 1 GROUP BY ALL")
def _(c):
    points, own = _points_and_lines(c)
    return planes.covered(lines.near_lines(points, own, ["frame_id"], 0.1), own, ["frame_id", "line_id"], 0.1)


@query("share_around_centre", f"{_near} SELECT frame_id, line_id, round(count_if(t / n > 0.25 AND t / n < 0.75) / count(*), 6) AS share FROM d GROUP BY ALL")
def _(c):
    return planes.share_around_centre(*_beside(c), ["frame_id", "line_id"]).withColumn("share", F.round("share", 6))


@query("point_extents", f"{_near}, g AS (SELECT frame_id, line_id, sx, ex, n, min(t) AS low, max(t) AS high, count(*) AS k FROM d GROUP BY ALL) SELECT line_id, floor((CASE WHEN k >= 10 THEN sx + (ex - sx) / n * low ELSE sx END) * 1e6 + 0.5)::BIGINT AS sx, floor((CASE WHEN k >= 10 THEN sx + (ex - sx) / n * high ELSE ex END) * 1e6 + 0.5)::BIGINT AS ex, k AS n FROM g UNION ALL SELECT line_id, floor(sx * 1e6 + 0.5)::BIGINT, floor(ex * 1e6 + 0.5)::BIGINT, 0 FROM v_line WHERE frame_id NOT IN (SELECT frame_id FROM v_point)")
def _(c):
    df = planes.extents(*_beside(c), ["frame_id", "line_id"])
    return df.select("line_id", *[F.floor(F.col(k) * 1e6 + 0.5).cast("long").alias(k) for k in ("sx", "ex")], "n")


@query("forest")
def _(c):
    return lines.forest_distance(c.line.select("line_id", "sx", "sy", "sz", "label"), ["sx", "sy", "sz"], "label").select("line_id", "predicted")


@query("approximate_neighbours")
def _(c):
    return lines.approximate_neighbours(c.line.select("line_id", "embedding"), "embedding", "line_id", 1.2)


@query("descriptor_vocabulary")
def _(c):
    names = [f"d{i}" for i in range(DIM)]
    df = c.line.select("line_id", *[F.get("embedding", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return clustering.kmeans(df, names, lines.vocabulary_size(df.count())).select("line_id", "cluster")


@query("nearest_point", f"{_near} SELECT frame_id, line_id, floor(min(far) * 1e6 + 0.5)::BIGINT AS distance FROM d GROUP BY ALL")
def _(c):
    points, own = _beside(c)
    return lines.nearest_point(points, own, ["frame_id", "line_id"], ["x", "y", "z"]).select("frame_id", "line_id", F.floor(F.col("distance") * 1e6 + 0.5).cast("long").alias("distance"))


@query("mean_distance", f"{_near}, g AS (SELECT line_id, avg(far) AS r FROM d GROUP BY ALL) SELECT line_id, round(coalesce(r, 1e9), 5) AS rating FROM v_line LEFT JOIN g USING (line_id)")
def _(c):
    return lines.mean_distance(*_beside(c), ["frame_id", "line_id"]).select("line_id", F.round("rating", 5).alias("rating"))


@query("distance_gaps", f"WITH {LINE}, p AS (SELECT a.frame_id, abs(a.sx - b.sx) AS d FROM v_line a JOIN v_line b ON a.frame_id = b.frame_id AND a.line_id < b.line_id), s AS (SELECT frame_id, d - lag(d) OVER (PARTITION BY frame_id ORDER BY d) AS s FROM p) SELECT frame_id, count_if(s >= 0.01) + 1 AS parts FROM s GROUP BY ALL")
def _(c):
    return lines.gaps(c.pair.select("frame_id", F.abs(F.col("asx") - F.col("bsx")).alias("d")), ["frame_id"], "d", 0.01)


def _fused() -> str:
    d = f"{norm(sub(vec('ae'), vec('as')))}"
    u = ", ".join(f"(ae{c} - as{c}) / {d} AS d{c}" for c in "xyz")
    t = [dot(sub(vec(p), vec("as")), vec("d")) for p in ("as", "ae", "bs", "be")]
    return f"WITH {PAIR}, t AS (SELECT *, {u} FROM v_pair), w AS (SELECT *, least({', '.join(t)}) AS low, greatest({', '.join(t)}) AS high FROM t) SELECT id1, id2, " + ", ".join(f"as{c} + d{c} * {k} AS {p}{c}" for p, k in (("s", "low"), ("e", "high")) for c in "xyz") + " FROM w"


@query("fused_pairs", _fused())
def _(c):
    a, b = lines.fused_pair(G.start("a"), G.end("a"), G.start("b"), G.end("b"))
    return c.pair.select("id1", "id2", *a.aliased("sx", "sy", "sz"), *b.aliased("ex", "ey", "ez"))


@query("side_colours", f"WITH {PX}, {POINT}, j AS (SELECT l.line_id, (p.u + p.v) % 2 AS side, p.class_id * 30 AS r, p.instance AS g FROM v_px l JOIN v_point p ON p.frame_id = l.frame_id AND p.u BETWEEN 100 AND 110) SELECT line_id, side, floor(sum(r) / count(*))::INT AS r, floor(sum(g) / count(*))::INT AS g FROM j GROUP BY ALL")
def _(c):
    here = c.px.select("frame_id", "line_id").join(c.point.filter(F.col("u").between(100, 110)).select("frame_id", "u", "v").distinct(), "frame_id").withColumn("side", (F.col("u") + F.col("v")) % 2)
    image = c.point.select("frame_id", "u", "v", (F.col("class_id") * 30).alias("r"), F.col("instance").alias("g"), F.lit(0).alias("b"))
    return pixels.mean_colour(here, image, ["line_id"]).drop("b")


def _strip_colours() -> str:
    return f"""WITH {PX}, {POINT}, n AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS n FROM v_px),
 j AS (SELECT l.line_id, l.n, ((p.u - x0) * (x1 - x0) + (p.v - y0) * (y1 - y0)) / (l.n * l.n) AS t, ((p.v - y0) * (x1 - x0) - (p.u - x0) * (y1 - y0)) / l.n AS off, p.class_id * 30 AS r, p.instance AS g FROM n l JOIN v_point p ON p.frame_id = l.frame_id)
 SELECT line_id, CASE WHEN off > 0 THEN 1 ELSE 0 END AS side, floor(sum(r) / count(*))::INT AS r, floor(sum(g) / count(*))::INT AS g FROM j WHERE t >= 0 AND t <= 1 AND abs(off) >= 0.5 AND abs(off) <= least(5.0, n * 0.5) + 0.5 GROUP BY ALL"""


@query("strip_colours", _strip_colours())
def _(c):
    image = c.point.select("frame_id", "u", "v", (F.col("class_id") * 30).alias("r"), F.col("instance").alias("g"), F.lit(0).alias("b"))
    near = pixels.strip_pixels(c.px, ["frame_id", "line_id"], 320, 240).join(image.select("frame_id", "u", "v"), ["frame_id", "u", "v"], "left_semi")
    return pixels.mean_colour(near, image, ["line_id"]).drop("b")


_sampled = f"WITH {LINE}, {POINT}, img AS (SELECT frame_id, u, v, min(instance) AS label FROM v_point GROUP BY ALL), s AS (SELECT line_id, frame_id, {', '.join(f's{c} + (e{c} - s{c}) * (k / 10::DOUBLE) AS {c}' for c in 'xyz')} FROM (SELECT line_id, frame_id, sx, sy, sz + 1.5::DOUBLE AS sz, ex, ey, ez + 1.5::DOUBLE AS ez FROM v_line), (SELECT unnest(range(0, 11)) AS k)), q AS (SELECT line_id, frame_id, least(greatest(floor(x * 200::DOUBLE / z + 160), 0), 319)::BIGINT AS u, least(greatest(floor(y * 200::DOUBLE / z + 120), 0), 239)::BIGINT AS v FROM s), c AS (SELECT line_id, coalesce(label, 0) AS label, count(*) AS n FROM q LEFT JOIN img USING (frame_id, u, v) GROUP BY ALL) SELECT line_id, label, 11::BIGINT AS votes FROM c QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY n DESC, label) = 1"


@query("sampled_labels", _sampled)
def _(c):
    image = c.point.groupBy("frame_id", "u", "v").agg(F.min("instance").alias("label"))
    own = c.line.withColumns({"sz": F.col("sz") + 1.5, "ez": F.col("ez") + 1.5})
    return votes.sampled_labels(own.select("line_id", "frame_id", "sx", "sy", "sz", "ex", "ey", "ez"), image, ["line_id"], (200.0, 200.0, 160.0, 120.0), (320, 240))


def _plane_label(order: str) -> str:
    strips = _strip_colours()
    strips = strips[: strips.rindex(" SELECT line_id, CASE")].replace("p.class_id * 30 AS r, p.instance AS g", "p.instance AS label, (p.u - 160) * p.z / 200::DOUBLE AS x, (p.v - 120) * p.z / 200::DOUBLE AS y, p.z AS z")
    return f"""{strips}, k AS (SELECT line_id, CASE WHEN off > 0 THEN 1 ELSE 0 END AS side, label, x, y, z FROM j WHERE t >= 0 AND t <= 1 AND abs(off) >= 0.5 AND abs(off) <= least(5.0, n * 0.5) + 0.5),
 m AS (SELECT line_id, side, sqrt(avg(x) * avg(x) + avg(y) * avg(y) + avg(z) * avg(z)) AS far FROM k GROUP BY ALL),
 b AS (SELECT line_id, side, label FROM k GROUP BY line_id, side, label QUALIFY row_number() OVER (PARTITION BY line_id, side ORDER BY count(*) DESC, label) = 1)
 SELECT line_id, label FROM b JOIN m USING (line_id, side) QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY {order}) = 1"""


def _strip_labels(c, furthest: bool):
    near = pixels.strip_pixels(c.px, ["frame_id", "line_id"], 320, 240)
    cloud = c.point.select("frame_id", "u", "v", F.col("instance").alias("label"), *G.back_project("u", "v", F.col("z").cast("double"), 200.0, 200.0, 160.0, 120.0).aliased("x", "y", "z"))
    return votes.plane_label(near.hint("merge").join(cloud, ["frame_id", "u", "v"]), ["line_id"], furthest)


@query("closest_plane_label", _plane_label("far, side DESC"))
def _(c):
    return _strip_labels(c, False)


@query("furthest_plane_label", _plane_label("far DESC, side DESC"))
def _(c):
    return _strip_labels(c, True)


@query("class_of_known_instance", f"WITH {LINE}, {POINT}, m AS (SELECT instance, min(class_id) AS class_id FROM v_point GROUP BY ALL) SELECT line_id, coalesce(m.class_id, 0) AS class_id FROM (SELECT line_id, label % 16 AS label FROM v_line) l LEFT JOIN m ON m.instance = l.label")
def _(c):
    classes = c.point.groupBy(F.col("instance").alias("label")).agg(F.min("class_id").alias("class_id"))
    return votes.class_of_instance(c.line.select("line_id", (F.col("label") % 16).alias("label")), classes, ["label"]).select("line_id", "class_id")


@query("labelled_inliers", f"WITH {POINT}, q AS (SELECT frame_id, u, v, z FROM v_point WHERE abs(z - 20) <= 5), n AS (SELECT DISTINCT frame_id, u, v, instance FROM v_point) SELECT frame_id, instance, count(*) AS n FROM q JOIN n USING (frame_id, u, v) GROUP BY ALL")
def _(c):
    points = c.point.select("frame_id", F.lit(0).alias("line_id"), F.lit(0).alias("side"), "u", "v", F.col("u").cast("double").alias("x"), F.col("v").cast("double").alias("y"), "z")
    plane = c.spark.createDataFrame([(0, 0, 0.0, 0.0, 1.0, -20.0)], "line_id int, side int, a double, b double, c double, d double")
    found = pixels.labelled_inliers(points, plane, c.point.select("frame_id", "u", "v", "instance").distinct(), ["line_id"], 5.0)
    return found.groupBy("frame_id", "instance").agg(F.count("*").alias("n"))


def _prolonged() -> str:
    d = ", ".join(f"(e{c} - s{c}) / {norm(sub(vec('e'), vec('s')))} AS d{c}" for c in "xyz")
    tip = ", ".join([*(f"CASE WHEN tip = 0 THEN s{c} - d{c} * reach ELSE e{c} END AS pa{c}" for c in "xyz"), *(f"CASE WHEN tip = 0 THEN s{c} ELSE e{c} + d{c} * reach END AS pb{c}" for c in "xyz")])
    flat = ", ".join(f"{p}{c} * 200 / {p}z + {m} AS {n}" for p, c, m, n in (("pa", "x", 160, "x0"), ("pa", "y", 120, "y0"), ("pb", "x", 160, "x1"), ("pb", "y", 120, "y1")))
    digit = lambda t, k: f"coalesce(max(CASE WHEN tip = {t} AND side = {k} AND step = last{t} AND fit >= 1 THEN 1 END), 0)"
    last = lambda t: f"(SELECT coalesce(min(g.step), 4) FROM (SELECT unnest(range(0, 4)) AS step) g WHERE (SELECT count(*) FROM k WHERE k.line_id = l.line_id AND k.tip = {t} AND k.step = g.step AND fit >= 1) < 2) AS last{t}"
    return f"""WITH {LINE}, {POINT}, o AS (SELECT line_id, frame_id, sx, sy, sz + 1.5 AS sz, ex, ey, ez + 1.5 AS ez, n1x, n1y, n1z, n2x, n2y, n2z FROM v_line), w AS (SELECT *, {d} FROM o),
 r AS (SELECT *, (step + 1) * 0.2::DOUBLE AS reach FROM w, (SELECT unnest(range(0, 2)) AS tip), (SELECT unnest(range(0, 5)) AS step)),
 t AS (SELECT line_id, frame_id, tip, step, n1x, n1y, n1z, n2x, n2y, n2z, {tip} FROM r), f AS (SELECT *, {flat} FROM t WHERE paz > 0 AND pbz > 0),
 n AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS n FROM f),
 j AS (SELECT line_id, tip, step, n, ((p.u - x0) * (x1 - x0) + (p.v - y0) * (y1 - y0)) / (n * n) AS t, ((p.v - y0) * (x1 - x0) - (p.u - x0) * (y1 - y0)) / n AS off, n1x, n1y, n1z, n2x, n2y, n2z, (p.u - 160) * p.z / 200::DOUBLE AS x, (p.v - 120) * p.z / 200::DOUBLE AS y, p.z AS z FROM n JOIN v_point p ON p.frame_id = n.frame_id AND p.u BETWEEN least(x0, x1) - 8 AND greatest(x0, x1) + 8 AND p.v BETWEEN least(y0, y1) - 8 AND greatest(y0, y1) + 8),
 k AS (SELECT line_id, tip, step, CASE WHEN off > 0 THEN 1 ELSE 0 END AS side, count(*) FILTER (abs(CASE WHEN off > 0 THEN n2x * x + n2y * y + n2z * z ELSE n1x * x + n1y * y + n1z * z END) < 1) AS fit FROM j WHERE t >= 0 AND t <= 1 AND abs(off) >= 0.5 AND abs(off) <= least(5.0, n * 0.5) + 0.5 GROUP BY ALL),
 l AS (SELECT l.line_id, {last(0)}, {last(1)} FROM v_line l)
 SELECT l.line_id, concat({digit(0, 1)}, {digit(0, 0)}, {digit(1, 1)}, {digit(1, 0)}) AS pattern FROM l LEFT JOIN k USING (line_id) GROUP BY l.line_id"""


@query("prolonged_patterns", _prolonged())
def _(c):
    own = c.line.withColumns({"sz": F.col("sz") + 1.5, "ez": F.col("ez") + 1.5})
    planes_ = [F.col(f"{n}{x}").alias(p + q) for n, p in (("n1", "r"), ("n2", "l")) for x, q in zip("xyz", "abc")]
    own = own.select("frame_id", "line_id", *lifting.ENDS, *planes_, F.lit(0.0).alias("rd"), F.lit(0.0).alias("ld"))
    cloud = c.point.select("frame_id", "u", "v", *G.back_project("u", "v", F.col("z").cast("double"), 200.0, 200.0, 160.0, 120.0).aliased("x", "y", "z"))
    s = LineSettings(max_plane_error=1.0, extension_length=0.2, min_points_in_prolonged_rect=1, max_points_for_empty_rect=1)
    return lifting.prolonged_patterns(own, cloud, ["frame_id", "line_id"], (200.0, 200.0, 160.0, 120.0), (320, 240), s).select("line_id", "pattern")


def _labels_by_type() -> str:
    d = ", ".join(f"(e{c} - s{c}) / {norm(sub(vec('e'), vec('s')))} * 0.2 AS d{c}" for c in "xyz")
    tip = ", ".join([*(f"CASE piece WHEN 1 THEN s{c} - d{c} WHEN 2 THEN e{c} ELSE s{c} END AS pa{c}" for c in "xyz"), *(f"CASE piece WHEN 1 THEN s{c} WHEN 2 THEN e{c} + d{c} ELSE e{c} END AS pb{c}" for c in "xyz")])
    flat = ", ".join(f"{p}{c} * 200 / {p}z + {m} AS {n}" for p, c, m, n in (("pa", "x", 160, "x0"), ("pa", "y", 120, "y0"), ("pb", "x", 160, "x1"), ("pb", "y", 120, "y1")))
    far = lambda n: f"abs({n}x * x + {n}y * y + {n}z * z)"
    best = lambda side, w: f"coalesce((SELECT label FROM r WHERE r.line_id = l.line_id AND piece = 0 AND side = {side} AND {w} > 0 ORDER BY {w} DESC, label LIMIT 1), 0)"
    near = lambda side: f"(SELECT coalesce(sum(near), 0) FROM r WHERE r.line_id = l.line_id AND piece = 0 AND side = {side})"
    beyond = lambda of: f"(SELECT coalesce(sum(w), 0) FROM r WHERE r.line_id = m.line_id AND piece > 0 AND label = m.{of})"
    return f"""{_sampled.replace(" SELECT line_id, label, 11::BIGINT AS votes FROM c QUALIFY", ", edges AS (SELECT line_id, label FROM c QUALIFY", 1)}),
 px1 AS (SELECT frame_id, u, v, min(z) AS z, min(instance) AS label FROM v_point GROUP BY ALL), o AS (SELECT line_id, frame_id, type, sx, sy, sz + 1.5 AS sz, ex, ey, ez + 1.5 AS ez, CASE WHEN type = 0 AND line_id % 8 = 0 THEN 0 ELSE n1x END AS n1x, CASE WHEN type = 0 AND line_id % 8 = 0 THEN 0 ELSE n1y END AS n1y, CASE WHEN type = 0 AND line_id % 8 = 0 THEN 0 ELSE n1z END AS n1z, n2x, n2y, n2z FROM v_line), o2 AS (SELECT *, {d} FROM o),
 pieces AS (SELECT *, {tip} FROM o2, (SELECT unnest(range(0, 3)) AS piece) WHERE type <> 2 AND (piece = 0 OR type IN (1, 3))),
 v_wide AS (SELECT line_id, frame_id, piece, type, n1x, n1y, n1z, n2x, n2y, n2z, {flat} FROM pieces WHERE paz > 0 AND pbz > 0), {clipped()},
 j AS (SELECT line_id, piece, type, n1x, n1y, n1z, n2x, n2y, n2z, n, ((p.u - p0) * (p1 - p0) + (p.v - q0) * (q1 - q0)) / (n * n) AS t, ((p.v - q0) * (p1 - p0) - (p.u - p0) * (q1 - q0)) / n AS off, (p.u - 160) * p.z / 200::DOUBLE AS x, (p.v - 120) * p.z / 200::DOUBLE AS y, p.z::DOUBLE AS z, p.label
  FROM (SELECT *, sqrt((p1 - p0) * (p1 - p0) + (q1 - q0) * (q1 - q0)) AS n FROM k WHERE NOT nothing) f JOIN px1 p ON p.frame_id = f.frame_id AND p.u BETWEEN least(p0, p1) - 8 AND greatest(p0, p1) + 8 AND p.v BETWEEN least(q0, q1) - 8 AND greatest(q0, q1) + 8),
 g AS (SELECT line_id, piece, CASE WHEN off > 0 THEN 1 ELSE 0 END AS side, label, count(*) AS n, count(*) FILTER (CASE WHEN type = 0 THEN CASE WHEN n1x = 0 AND n1y = 0 AND n1z = 0 THEN {far('n2')} ELSE {far('n1')} END WHEN off > 0 THEN {far('n2')} ELSE {far('n1')} END < 1) AS near FROM j WHERE t >= 0 AND t <= 1 AND abs(off) >= 0.5 AND abs(off) <= least(5.0, j.n * 0.5) + 0.5 GROUP BY ALL),
 r AS MATERIALIZED (SELECT *, CASE WHEN side = 0 THEN n + near WHEN sum(near) OVER (PARTITION BY line_id, piece, side) > 0 THEN near ELSE n END AS w FROM g),
 m AS MATERIALIZED (SELECT line_id, type, {best(0, 'w')} AS r0, {best(1, 'w')} AS l0, CASE WHEN {near(1)} > {near(0)} THEN {best(1, 'near')} ELSE {best(0, 'near')} END AS jump FROM v_line l WHERE type <> 2),
 h AS (SELECT *, {beyond('r0')} < {beyond('l0')} AS right_fewer FROM m), b AS (SELECT instance, min(class_id) AS class_id FROM v_point GROUP BY ALL)
 SELECT line_id, CASE WHEN type = 0 THEN jump WHEN coalesce(class_id IN (1, 2), false) THEN CASE WHEN right_fewer THEN l0 ELSE r0 END ELSE CASE WHEN right_fewer THEN r0 ELSE l0 END END::BIGINT AS label FROM h LEFT JOIN b ON b.instance = CASE WHEN right_fewer THEN r0 ELSE l0 END
 UNION ALL SELECT line_id, edges.label::BIGINT FROM edges JOIN v_line USING (line_id) WHERE type = 2"""


@query("labels_by_type", _labels_by_type())
def _(c):
    own = c.line.withColumns({"sz": F.col("sz") + 1.5, "ez": F.col("ez") + 1.5})
    bare = (F.col("type") == 0) & (F.col("line_id") % 8 == 0)  # half of the discontinuities have their plane on the left
    planes_ = [F.when(bare & (n == "n1"), 0.0).otherwise(F.col(f"{n}{x}")).alias(p + q) for n, p in (("n1", "r"), ("n2", "l")) for x, q in zip("xyz", "abc")]
    own = own.select("frame_id", "line_id", "type", *lifting.ENDS, *planes_, F.lit(0.0).alias("rd"), F.lit(0.0).alias("ld"))
    image = c.point.groupBy("frame_id", "u", "v").agg(F.min("z").alias("z"), F.min("instance").alias("label"))
    cloud = image.select("frame_id", "u", "v", *G.back_project("u", "v", F.col("z").cast("double"), 200.0, 200.0, 160.0, 120.0).aliased("x", "y", "z"))
    classes = c.point.groupBy(F.col("instance").alias("label")).agg(F.min("class_id").alias("class_id"))
    s = LineSettings(max_plane_error=1.0, extension_length=0.2)
    return labelling.labels_by_type(own, cloud, image.select("frame_id", "u", "v", "label"), classes, ["frame_id", "line_id"], (200.0, 200.0, 160.0, 120.0), (320, 240), [1, 2], s).select("line_id", "label")


# detection: images of 20 x 15 pixels, each with the points of 16 x 16 of the carrier's

GREY = "v_grey AS (SELECT frame_id, u // 16 AS u, v // 16 AS v, (sum(z * 37 + l_linenumber * 11) % 256)::BIGINT AS grey FROM v_point GROUP BY ALL)"


def _canny() -> str:
    ask = "SELECT frame_id, u, v, m, k, slant, u + k * CASE WHEN y < x THEN 1 WHEN y > steep THEN 0 WHEN (gx < 0) = (gy < 0) THEN 1 ELSE -1 END AS ou, v + k * CASE WHEN y < x THEN 0 ELSE 1 END AS ov FROM (SELECT *, y >= x AND y <= steep AS slant FROM (SELECT *, abs(gx) * 13573 AS x, abs(gy) * 32768 AS y, abs(gx) * (13573 + 65536) AS steep FROM m)), (SELECT unnest([-1, 1]) AS k) WHERE m > 50"
    return f"""WITH RECURSIVE {POINT}, {GREY}, grid AS (SELECT frame_id, u, v FROM (SELECT DISTINCT frame_id FROM v_grey), (SELECT unnest(range(0, 20)) AS u), (SELECT unnest(range(0, 15)) AS v)),
 st AS (SELECT g.frame_id, g.u, g.v, du, dv, coalesce(i.grey, 0) AS grey FROM grid g, (SELECT unnest([-1, 0, 1]) AS du), (SELECT unnest([-1, 0, 1]) AS dv) LEFT JOIN v_grey i ON i.frame_id = g.frame_id AND i.u = least(greatest(g.u + du, 0), 19) AND i.v = least(greatest(g.v + dv, 0), 14)),
 gr AS (SELECT frame_id, u, v, sum(grey * du * (2 - abs(dv)))::BIGINT AS gx, sum(grey * dv * (2 - abs(du)))::BIGINT AS gy FROM st GROUP BY ALL), m AS (SELECT *, abs(gx) + abs(gy) AS m FROM gr),
 ask AS ({ask}), thin AS MATERIALIZED (SELECT a.frame_id, a.u, a.v, a.m FROM ask a LEFT JOIN m o ON o.frame_id = a.frame_id AND o.u = a.ou AND o.v = a.ov GROUP BY ALL HAVING bool_and(a.m > coalesce(o.m, 0) OR (k = 1 AND NOT slant AND a.m = coalesce(o.m, 0)))),
 edge(frame_id, u, v) AS (SELECT frame_id, u, v FROM thin WHERE m > 200 UNION SELECT t.frame_id, t.u, t.v FROM edge e JOIN thin t ON t.frame_id = e.frame_id AND abs(t.u - e.u) <= 1 AND abs(t.v - e.v) <= 1)"""


def _hough() -> str:
    angles = ", ".join(f"({k}, {round(math.cos(math.pi * k / 180) * 1_000_000)}, {round(math.sin(math.pi * k / 180) * 1_000_000)})" for k in range(180))
    return f"{_canny()}, an(theta, c, s) AS (VALUES {angles}), ol AS (SELECT frame_id, u, v, theta, floor((u * c + v * s + 500000) / 1000000::DOUBLE)::BIGINT AS rho, (v * c - u * s)::BIGINT AS along FROM edge, an), vo AS (SELECT frame_id, theta, rho, count(*) AS votes FROM ol GROUP BY ALL)"


def _segments() -> str:
    return f"""{_hough()}, pk AS (SELECT * FROM vo a WHERE votes >= 6 AND NOT EXISTS (SELECT 1 FROM vo b WHERE b.frame_id = a.frame_id AND abs(b.theta - a.theta) <= 1 AND abs(b.rho - a.rho) <= 1 AND (b.votes > a.votes OR (b.votes = a.votes AND (b.theta, b.rho) < (a.theta, a.rho))))),
 on_ AS (SELECT ol.*, coalesce(along - lag(along) OVER l > 3000000, false) AS far FROM ol JOIN pk USING (frame_id, theta, rho) WINDOW l AS (PARTITION BY frame_id, theta, rho ORDER BY along, u, v)),
 pt AS (SELECT *, sum(far::INT) OVER (PARTITION BY frame_id, theta, rho ORDER BY along, u, v) AS part FROM on_),
 en AS (SELECT frame_id, theta, rho, part, min({{'along': along, 'u': u, 'v': v}}) AS a, max({{'along': along, 'u': u, 'v': v}}) AS b, count(*) AS n FROM pt GROUP BY ALL)
 SELECT frame_id, theta, rho, a.u::DOUBLE AS x0, a.v::DOUBLE AS y0, b.u::DOUBLE AS x1, b.v::DOUBLE AS y1, n FROM en WHERE sqrt((b.u - a.u) * (b.u - a.u) + (b.v - a.v) * (b.v - a.v)) >= 4"""


def _edges(c):
    grey = (F.sum(F.col("z").cast("long") * 37 + F.col("l_linenumber").cast("long") * 11) % 256).alias("grey")
    image = c.point.groupBy("frame_id", F.expr("u div 16").alias("u"), F.expr("v div 16").alias("v")).agg(grey)
    return clustering.checkpointed(detection.canny(image, (20, 15)))


@query("canny_edges", f"{_canny()} SELECT frame_id, u, v FROM edge")
def _(c):
    return _edges(c)


@query("hough_votes", f"{_hough()} SELECT * FROM vo")
def _(c):
    return detection.hough_votes(_edges(c))


@query("hough_segments", _segments())
def _(c):
    return detection.segments(_edges(c), 6, 4.0, 3.0)


# maps put together: the first and second frame of each pair of frames

_MAPS = f"{LINE}, a_ AS (SELECT *, frame_id // 2 AS place FROM v_line WHERE frame_id % 2 = 0), b_ AS (SELECT *, frame_id // 2 AS place FROM v_line WHERE frame_id % 2 = 1), v_pair AS (SELECT a_.place, a_.line_id AS id1, b_.line_id AS id2, {', '.join(f'{p}_.{k}{c} AS {p}{k}{c}' for p in 'ab' for k in 'se' for c in 'xyz')} FROM a_ JOIN b_ USING (place))"


def _coinciding() -> str:
    return f"{_MAPS}, {coincide_rows()}"


def _maps(c):
    own = c.line.select("line_id", (F.floor(F.col("frame_id") / 2)).alias("place"), (F.col("frame_id") % 2).alias("map"), *lifting.ENDS)
    return own.filter("map = 0").drop("map"), own.filter("map = 1").drop("map")


@query("coinciding_lines", f"WITH {_coinciding()} SELECT place, id1, id2 FROM same_")
def _(c):
    return fusion.coinciding(*_maps(c), ["place"], "line_id", 0.8, 0.15)


@query("group_lines", f"WITH RECURSIVE {_coinciding()}, e_ AS (SELECT id1 * 2 AS u, id2 * 2 + 1 AS v FROM same_), s_ AS (SELECT u, v FROM e_ UNION ALL SELECT v, u FROM e_), n_ AS (SELECT line_id, place, 0 AS map, line_id * 2 AS node FROM a_ UNION ALL SELECT line_id, place, 1, line_id * 2 + 1 FROM b_), r(node, m) AS (SELECT node, node FROM n_ UNION SELECT s_.v, r.m FROM r JOIN s_ ON s_.u = r.node WHERE r.m < s_.v) SELECT place, map, line_id, min(m) AS member_of FROM n_ JOIN r USING (node) GROUP BY ALL")
def _(c):
    return fusion.group_lines(*_maps(c), ["place"], "line_id", 0.8, 0.15)


def _fused() -> str:
    names = [f"n{k}{c}" for k in "12" for c in "xyz"]
    own = ", ".join(f"{p}.{n} AS {p}{n}" for p in "ab" for n in (*lifting.ENDS, *names, "open1"))
    A0, A1, B0, B1 = vec("as"), vec("ae"), vec("bs"), vec("be")
    u, v = sub(A1, A0), sub(B1, B0)
    t = f"t AS (SELECT *, {norm(u)} AS l1, {norm(v)} AS l2, {dot(u, sub(B0, A0))} AS x3, {dot(u, sub(B1, A0))} AS x4, {norm(cross(u, sub(B0, A0)))} AS d3, {norm(cross(u, sub(B1, A0)))} AS d4, abs({dot(u, v)}) AS dd, {', '.join(f'{dot(vec(f"an{i}"), vec(f"bn{j}"))} AS c{i}{j}' for i in '12' for j in '12')} FROM p)"
    over = "((least(x3, x4) < 0 AND greatest(x3, x4) > 0) OR (least(x3, x4) > 0 AND least(x3, x4) < l1))"
    start = lambda c: f"CASE WHEN x3 < x4 AND x3 < 0 THEN bs{c} WHEN x4 < x3 AND x4 < 0 THEN be{c} ELSE as{c} END"
    end = lambda c: f"CASE WHEN x3 < x4 AND x3 >= 0 AND x4 > l1 THEN be{c} WHEN x4 < x3 AND x4 >= 0 AND x3 > l1 THEN bs{c} ELSE ae{c} END"
    zero = lambda n: f"({n}x = 0 AND {n}y = 0 AND {n}z = 0)"

    def fuse(i, j, c):
        a, b = f"an{i}", f"bn{j}"
        total = norm([f"({a}{x} + {b}{x})" for x in "xyz"])
        return f"CASE WHEN {zero(a)} THEN {b}{c} WHEN {zero(b)} THEN {a}{c} WHEN c{i}{j} > {math.cos(1.52)!r} THEN ({a}{c} + {b}{c}) / {total} WHEN l1 > l2 THEN {a}{c} ELSE {b}{c} END"

    def normal(which, c):
        cases = "".join(f" WHEN c{x} > c{y} AND c{y} > {math.cos(1.52)!r} THEN {fuse(*pairs_[which], c)}" for x, y, *pairs_ in (("11", "21", "11", "22"), ("21", "11", "21", "12"), ("12", "22", "12", "21"), ("22", "12", "22", "11")))
        return f"CASE{cases} WHEN l1 > l2 THEN an{which + 1}{c} ELSE bn{which + 1}{c} END"

    out = ", ".join([*(f"round(({start(c)}) * 1e6)::BIGINT AS fs{c}" for c in "xyz"), *(f"round(({end(c)}) * 1e6)::BIGINT AS fe{c}" for c in "xyz"), *(f"round(({normal(k, c)}) * 1e6)::BIGINT AS fn{k + 1}{c}" for k in (0, 1) for c in "xyz")])
    return f"WITH {LINE}, p AS (SELECT a.line_id AS id1, b.line_id AS id2, {own} FROM v_line a JOIN v_line b ON a.frame_id = b.frame_id AND a.line_id < b.line_id), {t} SELECT id1, id2, aopen1 AS fopen1, {out} FROM t WHERE l1 > 0 AND l2 > 0 AND dd > {math.cos(0.8)!r} * l1 * l2 AND d3 < 0.15 AND d4 < 0.15 AND {over}"


@query("fused_lines", _fused())
def _(c):
    names = [*lifting.ENDS, *batches.NORMALS, "open1"]
    side = lambda p, k: c.line.select("frame_id", F.col("line_id").alias(k), *[F.col(n).alias(p + n) for n in names], F.lit(False).alias(f"{p}open2"))
    pairs = side("a", "id1").join(side("b", "id2"), "frame_id").filter("id1 < id2")
    whole = [f"f{n}" for n in (*lifting.ENDS, *batches.NORMALS)]
    return fusion.fused_lines(pairs, 0.8, 0.15, 1.52).select("id1", "id2", "fopen1", *[F.round(F.col(n) * 1e6).cast("long").alias(n) for n in whole])


# training input

_BACK = [0, 1, 2]
_IN = "(0, 1, 2)"


def _inputs() -> str:
    moved = ", ".join(f"(s{c} - {m}) / 2.0 AS s{c}, (e{c} - {m}) / 2.0 AS e{c}" for c, m in (("x", "0.0"), ("y", "0.0"), ("z", "3.0")))
    geometry = ", ".join([*lifting.ENDS, *batches.NORMALS, "open1::DOUBLE", "0.0", "sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy) + (ez - sz) * (ez - sz))"])
    pad = lambda items, fill: f"array_to_string(list_concat({items}, list_transform(range(0, 30 - n_lines), lambda i: {fill})), ',')"
    return f"""WITH {LINE}, ok AS (SELECT scene_id, frame_id, row_number() OVER (ORDER BY scene_id, frame_id) - 1 AS number FROM (SELECT scene_id, frame_id, count(*) AS n, count(DISTINCT label) FILTER (class_id NOT IN {_IN}) AS k FROM v_line GROUP BY ALL) WHERE n > 20 AND k > 0),
 m AS (SELECT scene_id, frame_id, line_id, label, class_id IN {_IN} AS behind, {moved}, {', '.join(batches.NORMALS)}, open1, dense_rank() OVER (PARTITION BY scene_id, frame_id ORDER BY label) AS number FROM v_line),
 l AS (SELECT scene_id, frame_id, line_id, behind, CASE WHEN behind THEN 0 ELSE number END AS label, list_transform([{geometry}], lambda x: round(x * 1e6)::BIGINT) AS g FROM m),
 f AS (SELECT scene_id, frame_id, count(*) AS n_lines, flatten(list(g ORDER BY line_id)) AS g, list(label ORDER BY line_id) AS label, list(behind::INT ORDER BY line_id) AS behind, list_sort(list_distinct(list(label) FILTER (label > 0))) AS u FROM l GROUP BY ALL)
 SELECT scene_id, frame_id, number, number // 4 AS batch, n_lines, array_to_string(list_concat(g, list_transform(range(0, 15 * (30 - n_lines)), lambda i: 0)), ',') AS lines, {pad('label', '0')} AS labels, {pad('behind', '1')} AS background,
 array_to_string(list_concat(u, list_transform(range(0, 8), lambda i: -1))[1:8], ',') AS unique_labels, len(u) AS cluster_count FROM f JOIN ok USING (scene_id, frame_id)"""


@query("line_batches", _inputs())
def _(c):
    own = c.line.withColumn("open2", F.lit(False))
    rows = batches.line_batches(own, _BACK, 4, 20, most_lines=30, most_clusters=8)
    flat = F.array_join(F.transform(F.flatten("lines"), lambda x: F.round(x * 1e6).cast("long").cast("string")), ",")
    joined = lambda n: F.array_join(F.transform(n, lambda x: x.cast("int").cast("string")), ",").alias(n)
    return rows.select("scene_id", "frame_id", "number", "batch", F.col("n_lines").cast("long").alias("n_lines"), flat.alias("lines"), joined("labels"), joined("background"), joined("unique_labels"), F.col("cluster_count").cast("long").alias("cluster_count"))


@query("scene_clusters", f"WITH {LINE}, e AS (SELECT scene_id, frame_id, label AS instance, count(*) FILTER (class_id NOT IN {_IN}) AS n, arg_min(class_id, line_id) AS class_id, array_to_string(list(line_id ORDER BY line_id), ' ') AS lines FROM v_line GROUP BY ALL HAVING count(*) FILTER (class_id NOT IN {_IN}) >= 2), g AS (SELECT *, CASE WHEN class_id IN {_IN} THEN 0 ELSE instance END AS label FROM e) SELECT scene_id, label, first(class_id ORDER BY frame_id, n DESC, instance) AS class_id, count(*) AS n_clusters, string_agg(frame_id || ':' || instance || ':' || lines, ';' ORDER BY frame_id, instance) AS clusters FROM g GROUP BY ALL")
def _(c):
    rows = batches.scene_clusters(c.line, _BACK, 2)
    one = lambda x: F.concat(x.frame_id.cast("string"), F.lit(":"), x.instance.cast("string"), F.lit(":"), F.array_join(F.transform(x.lines, lambda i: i.cast("string")), " "))
    return rows.withColumn("clusters", F.array_join(F.transform("clusters", one), ";"))


@query("new_labels", f"WITH {LINE}, p AS (SELECT line_id, scene_id, label, line_id % 3 AS part FROM v_line), s AS (SELECT scene_id, label, part, row_number() OVER (ORDER BY scene_id, label, part) AS k FROM (SELECT DISTINCT scene_id, label, part FROM p WHERE part > 0)) SELECT line_id, coalesce((SELECT max(label) FROM p WHERE label <> 7) + k, p.label)::BIGINT AS new_label FROM p LEFT JOIN s ON s.scene_id = p.scene_id AND s.label = p.label AND s.part = p.part")
def _(c):
    parts = c.line.select("line_id", "scene_id", "label", (F.col("line_id") % 3).alias("part"))
    return batches.new_labels(parts, ["scene_id"], reserved=7).select("line_id", "new_label")


# open ends, jumps, nearest patches, views, silhouettes of rows

_IMAGE = "px1 AS (SELECT frame_id, u, v, min(z) AS z FROM v_point GROUP BY ALL)"
_SHIFTED = "o AS (SELECT line_id, frame_id, sx, sy, sz + 1.5::DOUBLE AS sz, ex, ey, ez + 1.5::DOUBLE AS ez FROM v_line)"


def _image(c):
    return c.point.groupBy("frame_id", "u", "v").agg(F.min("z").alias("z"))


def _open() -> str:
    tip = ", ".join([*(f"CASE WHEN tip = 1 THEN e{c} ELSE s{c} END AS f{c}" for c in "xyz"), *(f"CASE WHEN tip = 1 THEN s{c} ELSE e{c} END AS g{c}" for c in "xyz")])
    n = "sqrt((gx * 200 / gz - fx * 200 / fz) * (gx * 200 / gz - fx * 200 / fz) + (gy * 200 / gz - fy * 200 / fz) * (gy * 200 / gz - fy * 200 / fz))"
    return f"""WITH {LINE}, {POINT}, {_IMAGE}, {_SHIFTED}, t AS (SELECT line_id, frame_id, tip, {tip} FROM o, (SELECT unnest([1, 2]) AS tip)), r AS (SELECT line_id, frame_id, tip, {', '.join(f'g{c} + (g{c} - f{c}) * (2.0 / {n}) AS {c}' for c in 'xyz')} FROM t),
 p AS (SELECT line_id, frame_id, tip, x * 200 / z + 160 AS pu, y * 200 / z + 120 AS pv, sqrt(x * x + y * y + z * z) AS far FROM r), q AS (SELECT *, pu >= 0 AND pu < 320 AND pv >= 0 AND pv < 240 AS inside FROM p),
 e AS (SELECT line_id, tip, NOT inside OR coalesce(i.z / 20::DOUBLE, 0.0) < far - 0.1 AS open FROM q LEFT JOIN px1 i ON i.frame_id = q.frame_id AND inside AND i.u = round_even(pu, 0)::BIGINT AND i.v = round_even(pv, 0)::BIGINT)
 SELECT line_id, bool_or(tip = 1 AND open) AS open1, bool_or(tip = 2 AND open) AS open2 FROM e GROUP BY line_id"""


@query("open_ends", _open())
def _(c):
    own = c.line.select("frame_id", "line_id", "sx", "sy", (F.col("sz") + 1.5).alias("sz"), "ex", "ey", (F.col("ez") + 1.5).alias("ez"))
    depth = _image(c).select("frame_id", "u", "v", (F.col("z").cast("double") / 20.0).alias("depth"))
    return pixels.open_ends(own, depth, ["frame_id", "line_id"], (200.0, 200.0, 160.0, 120.0), (320, 240)).select("line_id", "open1", "open2")


_WALK = """w(line_id, frame_id, step, u, v) AS (SELECT line_id, frame_id, 0, ax, ay FROM b0 UNION ALL SELECT w.line_id, w.frame_id, step + 1, u + floor((bx - u) / sqrt((bx - u) * (bx - u) + (by_ - v) * (by_ - v)) + 0.5)::INT, v + floor((by_ - v) / sqrt((bx - u) * (bx - u) + (by_ - v) * (by_ - v)) + 0.5)::INT FROM w JOIN b0 USING (line_id) WHERE u <> bx OR v <> by_)"""


def _jumps() -> str:
    return f"""WITH RECURSIVE {PX}, {POINT}, px1 AS (SELECT frame_id, u, v, min(z) AS z FROM v_point GROUP BY ALL), b0 AS (SELECT line_id, frame_id, floor(x0)::INT AS ax, floor(y0)::INT AS ay, floor(x1)::INT AS bx, floor(y1)::INT AS by_, trunc(least(x0, x1))::INT AS lowx, trunc(greatest(x0, x1))::INT AS highx, trunc(least(y0, y1))::INT AS lowy, trunc(greatest(y0, y1))::INT AS highy FROM v_px),
 {_WALK}, s AS (SELECT w.line_id, w.frame_id, step, unnest(range(least(greatest(u - 1, lowx), highx), least(greatest(u + 1, lowx), highx) + 1)) AS pu, least(greatest(v - 1, lowy), highy) AS v0, least(greatest(v + 1, lowy), highy) AS v1 FROM w JOIN b0 USING (line_id) WHERE step > 0),
 p AS (SELECT line_id, frame_id, step, pu, unnest(range(v0, v1 + 1)) AS pv FROM s), m AS (SELECT line_id, step, coalesce(sum((i.u - 160) * (i.z / 400::DOUBLE) / 200::DOUBLE), 0.0) / count(*) AS x, coalesce(sum((i.v - 120) * (i.z / 400::DOUBLE) / 200::DOUBLE), 0.0) / count(*) AS y, coalesce(sum(i.z / 400::DOUBLE), 0.0) / count(*) AS z FROM p LEFT JOIN px1 i ON i.frame_id = p.frame_id AND i.u = pu AND i.v = pv GROUP BY ALL),
 d AS (SELECT line_id, sqrt((x - lag(x) OVER l) * (x - lag(x) OVER l) + (y - lag(y) OVER l) * (y - lag(y) OVER l) + (z - lag(z) OVER l) * (z - lag(z) OVER l)) AS d FROM m WINDOW l AS (PARTITION BY line_id ORDER BY step))
 SELECT line_id, NOT coalesce(bool_or(d > 0.01), false) AS valid FROM b0 LEFT JOIN d USING (line_id) GROUP BY line_id"""


@query("without_jumps", _jumps())
def _(c):
    cloud = _image(c).select("frame_id", "u", "v", *G.back_project("u", "v", F.col("z").cast("double") / 400.0, 200.0, 200.0, 160.0, 120.0).aliased("x", "y", "z"))
    return pixels.without_jumps(c.px, cloud, ["frame_id", "line_id"], 0.01).select("line_id", "valid")


def _shortest() -> str:
    box = lambda x, most: f"unnest(range(least(greatest({x}::INT - 1, 0), {most}), least(greatest({x}::INT + 1, 0), {most}) + 1))"
    end = lambda k, p: f"e{k} AS (SELECT line_id, u AS {p}u, v AS {p}v, x AS {p}x, y AS {p}y, z AS {p}z FROM (SELECT line_id, frame_id, u, {box(f'trunc(y{k})', 19)} AS v FROM (SELECT line_id, frame_id, y{k}, {box(f'trunc(x{k})', 14)} AS u FROM v_small)) JOIN cl USING (frame_id, u, v))"
    return f"""WITH {PX}, {POINT}, cl AS (SELECT frame_id, u // 16 AS u, v // 16 AS v, min(u)::DOUBLE AS x, min(v)::DOUBLE AS y, min(z)::DOUBLE AS z FROM v_point GROUP BY ALL), v_small AS (SELECT line_id, frame_id, x0 / 16.0 AS x0, y0 / 16.0 AS y0, x1 / 16.0 AS x1, y1 / 16.0 AS y1 FROM v_px), {end(0, 's')}, {end(1, 'e')}
 SELECT line_id, sx, sy, sz, ex, ey, ez FROM e0 JOIN e1 USING (line_id) QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY (sx - ex) * (sx - ex) + (sy - ey) * (sy - ey) + (sz - ez) * (sz - ez), su, sv, eu, ev) = 1"""


@query("shortest_lines", _shortest())
def _(c):
    cloud = c.point.groupBy("frame_id", F.expr("u div 16").alias("cu"), F.expr("v div 16").alias("cv")).agg(*[F.min(a).cast("double").alias(b) for a, b in (("u", "x"), ("v", "y"), ("z", "z"))]).withColumnsRenamed({"cu": "u", "cv": "v"})
    small = c.px.select("frame_id", "line_id", *[(F.col(x) / 16.0).alias(x) for x in ("x0", "y0", "x1", "y1")])
    return pixels.shortest_lines(small, cloud, ["frame_id", "line_id"], (20, 15)).drop("frame_id")


def _views() -> str:
    base = camera_sql().split(" SELECT line_id, floor(x")[0].replace(f"WITH {LINE}", f"WITH {LINE.replace('v_line AS', 'v_line0 AS', 1)}, v_line AS (SELECT * REPLACE (sz + 1.5::DOUBLE AS sz, ez + 1.5::DOUBLE AS ez) FROM v_line0)", 1)
    A, B, O = vec("s"), vec("e"), vec("o")
    n = "sqrt((ex * 200 / ez - sx * 200 / sz) * (ex * 200 / ez - sx * 200 / sz) + (ey * 200 / ez - sy * 200 / sz) * (ey * 200 / ez - sy * 200 / sz))"
    mid = times([f"({a} + {b})" for a, b in zip(A, B)], "0.5")
    z = sub(mid, O)
    return f"""{base}, {POINT}, pt AS (SELECT frame_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, price, (u - 160) * (z / 20::DOUBLE) / 200::DOUBLE AS px, (v - 120) * (z / 20::DOUBLE) / 200::DOUBLE AS py, z / 20::DOUBLE AS pz, class_id FROM v_point),
 k AS (SELECT line_id, frame_id, sx, sy, sz, ex, ey, ez, r.x AS ox, r.y AS oy, r.z AS oz, {norm(sub(B, A))} AS length, {n} AS n FROM v_line JOIN r USING (line_id) WHERE r = 1),
 k1 AS (SELECT *, least(120, trunc(n * 1.5)::INT) AS width, {', '.join(f'({b} - {a}) / length AS x{c}' for a, b, c in zip(A, B, 'xyz'))}, {', '.join(f'({x}) / {norm(z)} AS z{c}' for x, c in zip(z, 'xyz'))} FROM k WHERE n * 1.5 > 40 AND n / length > 50),
 k2 AS (SELECT *, trunc(width / 1.5)::INT AS height, {', '.join(f'{x} AS c{c}' for x, c in zip(cross(vec('z'), vec('x')), 'xyz'))} FROM k1), k3 AS (SELECT *, {norm(vec('c'))} AS cn FROM k2),
 l AS (SELECT line_id, width, height, length, class_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, price, xx * (px - ox) + xy * (py - oy) + xz * (pz - oz) AS qx, cx / cn * (px - ox) + cy / cn * (py - oy) + cz / cn * (pz - oz) AS qy, zx * (px - ox) + zy * (py - oy) + zz * (pz - oz) AS qz FROM k3 JOIN pt USING (frame_id)),
 i AS (SELECT *, trunc(qx * (width / (length * 1.5)) + width / 2)::INT AS u, trunc(qy * (height / length) + height / 2)::INT AS v FROM l WHERE qx >= -(length * 1.5) / 2 AND qx < length * 1.5 / 2 AND qy >= -length / 2 AND qy < length / 2 AND qz >= 0 AND qz < 0.5)
 SELECT line_id, width, height, u, v, floor(qz * 1e6 + 0.5)::BIGINT AS z, class_id, n_points, (floor(qz * 1000.0) % 256)::BIGINT AS depth8 FROM (SELECT *, count(*) OVER (PARTITION BY line_id, u, v) AS n_points, row_number() OVER (PARTITION BY line_id, u, v ORDER BY qz, {', '.join(PID)}) AS rk FROM i WHERE u >= 0 AND u < width AND v >= 0 AND v < height) WHERE rk = 1"""


@query("line_views", _views())
def _(c):
    own = c.line.withColumns({"sz": F.col("sz") + 1.5, "ez": F.col("ez") + 1.5}).select("frame_id", "line_id", "type", *lifting.ENDS, *batches.NORMALS)
    points = c.point.select("frame_id", "class_id", *PID, *G.back_project("u", "v", F.col("z").cast("double") / 20.0, 200.0, 200.0, 160.0, 120.0).aliased("x", "y", "z"))
    rows = cameras.line_views(own, points, ["frame_id", "line_id"], (200.0, 200.0, 160.0, 120.0), ["class_id"], PID)
    return rows.select("line_id", "width", "height", "u", "v", micro(F.col("z")).alias("z"), "class_id", "n_points", F.col("depth8").cast("long").alias("depth8"))


@query("silhouette_of_rows", f"WITH {LINE}, d AS (SELECT a.frame_id, a.line_id AS id1, b.line_id AS id2, sqrt((a.sx - b.sx) * (a.sx - b.sx) + (a.sy - b.sy) * (a.sy - b.sy)) AS d FROM v_line a JOIN v_line b USING (frame_id)), q AS (SELECT x.frame_id, x.id1, y.id1 AS id2, sqrt(sum((x.d - y.d) * (x.d - y.d))) AS d FROM d x JOIN d y ON x.frame_id = y.frame_id AND x.id2 = y.id2 AND x.id1 <> y.id1 GROUP BY ALL), m AS (SELECT id1, a.label AS c1, b.label AS c2, avg(d) AS d FROM q JOIN v_line a ON a.line_id = id1 JOIN v_line b ON b.line_id = id2 GROUP BY ALL), s AS (SELECT id1, max(CASE WHEN c1 = c2 THEN d END) AS a, min(CASE WHEN c1 <> c2 THEN d END) AS b FROM m GROUP BY ALL) SELECT id1, round(coalesce(CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) END, 0.0), 5) + 0.0 AS score FROM s")
def _(c):
    side = lambda p: c.line.select("frame_id", F.col("line_id").alias(f"id{p}"), F.col("sx").alias(f"x{p}"), F.col("sy").alias(f"y{p}"))
    d = F.sqrt((F.col("x1") - F.col("x2")) * (F.col("x1") - F.col("x2")) + (F.col("y1") - F.col("y2")) * (F.col("y1") - F.col("y2")))
    rows = metrics.row_distances(side(1).join(side(2), "frame_id").select("frame_id", "id1", "id2", d.alias("d")), ["frame_id"])
    label = lambda p: c.line.select(F.col("line_id").alias(f"id{p}"), F.col("label").alias(f"c{p}"))
    return metrics.silhouette(rows.join(label(1), "id1").join(label(2), "id2")).withColumn("score", F.round("score", 5) + 0.0)


@query("forest_distance")
def _(c):
    model = trees.fit_forest(c.line, list(lifting.ENDS), "label")
    paths = trees.decision_paths(c.line, trees.forest_nodes(model, c.spark), ["line_id"], list(lifting.ENDS))
    return trees.path_distances(paths, c.pair, "line_id", 5)
