"""Pixels beside lines and what lies at them: pixels are exploded and joined by (frame, u, v), never by rectangles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linelake.functions import geometry as G
from linelake.operators.lines import settled


def steps(x0: str, y0: str, x1: str, y1: str) -> Column:
    """Pixels along a line, one for each step of its longer side: array of (step, u, v)."""
    n = F.greatest(F.abs(F.col(x1) - F.col(x0)), F.abs(F.col(y1) - F.col(y0)))
    count = F.ceil(n).cast("int")

    def at(i):
        t = G.div(i.cast("double"), F.greatest(count, F.lit(1)).cast("double"))
        return F.struct(i.alias("step"), F.rint(F.col(x0) + (F.col(x1) - F.col(x0)) * t).cast("int").alias("u"), F.rint(F.col(y0) + (F.col(y1) - F.col(y0)) * t).cast("int").alias("v"))

    return F.transform(F.sequence(F.lit(0), count), at)


def strip_pixels(lines: DataFrame, keys: list[str], width: int, height: int, offset: float = 0.5, most: float = 5.0) -> DataFrame:
    """keys, side (0 right, 1 left), u, v of the pixels in the strips beside each 2-D line. A pixel is in a strip when
    its centre is."""
    line = ("x0", "y0", "x1", "y1")
    x0, y0, x1, y1 = map(F.col, line)
    flat = F.abs(x1 - x0) >= F.abs(y1 - y0)  # walk along the longer side, and look a strip's width to either side of it
    p0, p1, q0, q1 = F.when(flat, x0).otherwise(y0), F.when(flat, x1).otherwise(y1), F.when(flat, y0).otherwise(x0), F.when(flat, y1).otherwise(x1)
    across = math.ceil((most + offset) * math.sqrt(2)) + 1
    ok = lines.filter((F.greatest(x0, x1) >= 0) & (F.least(x0, x1) < width) & (F.greatest(y0, y1) >= 0) & (F.least(y0, y1) < height) & (p0 != p1))
    n = (G.Vec.of(*line[2:]) - G.Vec.of(*line[:2])).norm()
    ok = ok.select(*keys, *line, flat.alias("_flat"), p0.alias("_p0"), q0.alias("_q0"), p1.alias("_p1"), F.try_divide(q1 - q0, p1 - p0).alias("_slope"), n.alias("_n"))
    flat, p0, q0, p1, slope, n = (F.col(c) for c in ("_flat", "_p0", "_q0", "_p1", "_slope", "_n"))
    low, high = F.greatest(F.least(p0, p1) - most - 1, F.lit(0.0)), F.least(F.greatest(p0, p1) + most + 1, F.when(flat, float(width - 1)).otherwise(float(height - 1)))
    along = ok.withColumn("_k", F.explode(F.sequence(F.floor(low).cast("int"), F.floor(high).cast("int"))))
    middle = F.floor(G.clamp(q0 + (F.col("_k") - p0) * slope, -1e6, 1e6)).cast("int")  # a line may run far past the image
    near = along.withColumn("_j", F.explode(F.sequence(middle - across, middle + across + 1)))
    cells = near.withColumn("u", F.when(flat, F.col("_k")).otherwise(F.col("_j"))).withColumn("v", F.when(flat, F.col("_j")).otherwise(F.col("_k")))
    cells = cells.filter((F.col("u") >= 0) & (F.col("u") < width) & (F.col("v") >= 0) & (F.col("v") < height))
    d, p = G.Vec.of(*line[2:]) - G.Vec.of(*line[:2]), G.Vec((F.col("u").cast("double"), F.col("v").cast("double"))) - G.Vec.of(*line[:2])
    t, off = G.div(p.dot(d), n * n), G.div(p.c[1] * d.c[0] - p.c[0] * d.c[1], n)
    size = F.least(F.lit(most), n * 0.5)
    inside = (t >= 0) & (t <= 1) & (F.abs(off) >= offset) & (F.abs(off) <= size + offset)
    return cells.filter(inside).select(*keys, F.when(off > 0, 1).otherwise(0).alias("side"), "u", "v")


def inliers(pixels: DataFrame, cloud: DataFrame, keys: list[str]) -> DataFrame:
    """Points at the pixels; NaN points are left out, and a line with a zero (no depth) point anywhere goes wholly."""
    # the pixels of all strips grow with the lines, whatever their estimate says: neither side is sent to all tasks
    found = pixels.hint("merge").join(cloud, ["frame_id", "u", "v"])
    zero = (F.col("x") == 0) & (F.col("y") == 0) & (F.col("z") == 0)
    bad = found.filter(zero).select(*keys).distinct()
    return found.filter(~(F.isnan("x") | F.isnan("y") | F.isnan("z"))).join(bad.hint("merge"), keys, "left_anti")


def labelled_inliers(points: DataFrame, planes: DataFrame, instances: DataFrame, keys: list[str], within: float) -> DataFrame:
    """Points near their side's plane (keys, side, a, b, c, d) with the instance label of their pixel."""
    near = G.point_to_plane((G.Vec.of("a", "b", "c"), F.col("d")), G.Vec.of("x", "y", "z")) <= within
    return points.join(planes, [*keys, "side"]).filter(near).join(instances, ["frame_id", "u", "v"])


def lifted(lines: DataFrame, cloud: DataFrame, width: int, height: int) -> DataFrame:
    """3-D lines from the points at both ends' pixels; lines with a missing or NaN end go."""
    ends = lines.withColumns({f"{p}{c}": F.floor(F.col(f"{c}{i}")).cast("int") for i, p in ((0, "a"), (1, "b")) for c in "xy"})
    ends = ends.filter(G.in_bounds(F.col("x0"), F.col("y0"), width, height, True) & G.in_bounds(F.col("x1"), F.col("y1"), width, height, True))
    point = lambda p: cloud.filter(~(F.isnan("x") | F.isnan("y") | F.isnan("z"))).select("frame_id", F.col("u").alias(f"{p}x"), F.col("v").alias(f"{p}y"), *[F.col(c).alias(f"{'s' if p == 'a' else 'e'}{c}") for c in "xyz"])
    return ends.join(point("a"), ["frame_id", "ax", "ay"]).join(point("b"), ["frame_id", "bx", "by"]).drop("ax", "ay", "bx", "by")


def lifted_ends(lines: DataFrame, cloud: DataFrame, keys: list[str]) -> DataFrame:
    """3-D lines from the first and last pixels along them that have a point."""
    walk = lines.select("frame_id", *keys, F.explode(steps("x0", "y0", "x1", "y1")).alias("p")).select("frame_id", *keys, "p.*")
    seen = walk.join(cloud.filter(~(F.isnan("x") | F.isnan("y") | F.isnan("z"))), ["frame_id", "u", "v"])
    ends = seen.groupBy("frame_id", *keys).agg(F.min_by(F.struct("x", "y", "z"), "step").alias("a"), F.max_by(F.struct("x", "y", "z"), "step").alias("b"), F.count("*").alias("n"))
    return ends.select("frame_id", *keys, *[F.col(f"a.{c}").alias(f"s{c}") for c in "xyz"], *[F.col(f"b.{c}").alias(f"e{c}") for c in "xyz"], "n")


def shifted_best(rated: DataFrame, keys: list[str], also: tuple[str, ...] = ()) -> DataFrame:
    """Of a line and its neighbours one pixel to either side (shift 0, -1, 1), the best rated; the line itself unless
    another is strictly better. The columns `also` of the best go along."""
    order = F.struct("rating", F.when(F.col("shift") == 0, 0).when(F.col("shift") < 0, 1).otherwise(2))
    return rated.groupBy(*keys).agg(F.min_by(F.struct("shift", "rating", *also), order).alias("b")).select(*keys, "b.*")


def mean_colour(pixels: DataFrame, image: DataFrame, keys: list[str]) -> DataFrame:
    """Whole-number mean colour of each side; pixels outside the image count in the divisor."""
    both = pixels.join(image, ["frame_id", "u", "v"], "left")
    return both.groupBy(*keys, "side").agg(*[F.floor(F.coalesce(F.sum(c), F.lit(0)) / F.count("*")).cast("int").alias(c) for c in "rgb"])


def line_open(tip: Column, beyond: Column, jump: float = 0.1) -> Column:
    """Whether a line goes on behind something: the depth two pixels past its end is missing or nearer by a jump."""
    return beyond.isNull() | F.isnan(beyond) | (beyond == 0) | (tip - beyond > jump)


def jumps(walk: DataFrame, keys: list[str], z: str = "z", least: float = 0.1) -> DataFrame:
    """n_jumps of depth along a pixel walk (column step)."""
    from pyspark.sql import Window as W

    step = walk.withColumn("_d", F.abs(F.col(z) - F.lag(z).over(W.partitionBy(*keys).orderBy("step"))))
    return step.groupBy(*keys).agg(F.count_if(F.col("_d") > least).alias("n_jumps"))


def open_ends(lines: DataFrame, depth: DataFrame, keys: list[str], camera: tuple[float, float, float, float], size: tuple[int, int], past: float = 2.0, jump: float = 0.1) -> DataFrame:
    """keys, open1, open2: whether a 3-D line (sx .. ez) goes on behind something at its start and at its end. The line is
    prolonged by `past` pixels; that end is open where the point there lies beside the image, or where the depth
    (frame_id, u, v, depth; one row a pixel, none is 0) of its pixel is nearer than the point by more than `jump`. A line without
    length in the image is open at both ends."""
    named = lambda names, v: dict(zip(names.split(), v.c))
    rows = lines.select(*keys, *[F.col(f"{p}{c}") for p in "se" for c in "xyz"], F.explode(F.array(F.lit(1), F.lit(2))).alias("tip"))
    first = F.col("tip") == 1
    rows = settled(rows, named("_ax _ay _az", G.end().when(first, G.start())) | named("_bx _by _bz", G.start().when(first, G.end())))
    a, b = G.Vec.of("_ax", "_ay", "_az"), G.Vec.of("_bx", "_by", "_bz")
    rows = settled(rows, named("_u0 _v0 _u1 _v1", G.Vec((*G.project(a, *camera), *G.project(b, *camera)))))
    n = (G.Vec.of("_u1", "_v1") - G.Vec.of("_u0", "_v0")).norm()
    rows = settled(rows, named("_px _py _pz", b + (b - a) * G.div(F.lit(past), n)))
    reach = G.Vec.of("_px", "_py", "_pz")
    rows = settled(rows, named("pu pv", G.Vec(G.project(reach, *camera))) | {"far": reach.norm()})
    inside = ~F.isnan("pu") & ~F.isnan("pv") & (F.col("pu") >= 0) & (F.col("pu") < size[0]) & (F.col("pv") >= 0) & (F.col("pv") < size[1])
    at = [F.when(inside, F.rint(c)).cast("long").alias(n) for c, n in (("pu", "u"), ("pv", "v"))]
    seen = rows.withColumn("inside", inside).select(*keys, "tip", "inside", "far", *at).join(depth.select("frame_id", "u", "v", "depth"), ["frame_id", "u", "v"], "left")
    is_open = ~F.col("inside") | (F.coalesce("depth", F.lit(0.0)) < F.col("far") - jump)
    return seen.groupBy(*keys).agg(F.bool_or((F.col("tip") == 1) & is_open).alias("open1"), F.bool_or((F.col("tip") == 2) & is_open).alias("open2"))


def _greedy_walk() -> Column:
    """Pixels (step, u, v) from (ax, ay) to (bx, by), each a step in the rounded direction of what is left."""
    most = (F.abs(F.col("bx") - F.col("ax")) + F.abs(F.col("by") - F.col("ay"))).cast("int")
    begin = F.struct(F.col("ax").alias("u"), F.col("ay").alias("v"), F.array().cast("array<struct<step: int, u: int, v: int>>").alias("seen"))

    def step(state, k):
        du, dv = F.col("bx") - state.u, F.col("by") - state.v
        n = F.sqrt(du * du + dv * dv)
        u, v = (c + F.floor(d / n + 0.5).cast("int") for c, d in ((state.u, du), (state.v, dv)))
        return F.when(n == 0, state).otherwise(F.struct(u.alias("u"), v.alias("v"), F.concat(state.seen, F.array(F.struct(k.alias("step"), u.alias("u"), v.alias("v")))).alias("seen")))

    return F.when(most > 0, F.aggregate(F.sequence(F.lit(1), most), begin, step, lambda s: s.seen))


def without_jumps(lines: DataFrame, cloud: DataFrame, keys: list[str], most: float = 0.1) -> DataFrame:
    """keys, valid: whether the means of 3 x 3 points, at each pixel on the way along a 2-D line (x0 .. y1), move by
    no more than `most` from one pixel to the next. Patches are cut to the box of the line; a pixel without a row is the
    point (0, 0, 0); means with NaN don't count as moving. A line of one pixel is valid."""
    whole = lines.select(*keys, *[F.floor(c).cast("int").alias(n) for c, n in (("x0", "ax"), ("y0", "ay"), ("x1", "bx"), ("y1", "by"))], *[f(F.col(f"{c}0"), F.col(f"{c}1")).cast("int").alias(f"{n}{c}") for n, f in (("low", F.least), ("high", F.greatest)) for c in "xy"])
    walk = whole.select(*keys, "lowx", "highx", "lowy", "highy", F.explode(_greedy_walk()).alias("w")).select(*keys, "lowx", "highx", "lowy", "highy", "w.*")
    span = lambda at, c: F.sequence(G.clamp(F.col(at) - 1, F.col(f"low{c}"), F.col(f"high{c}")), G.clamp(F.col(at) + 1, F.col(f"low{c}"), F.col(f"high{c}")))
    patch = walk.select(*keys, "step", F.explode(span("u", "x")).alias("u"), span("v", "y").alias("_v")).select(*keys, "step", "u", F.explode("_v").alias("v"))
    seen = patch.hint("merge").join(cloud.select("frame_id", "u", "v", "x", "y", "z"), ["frame_id", "u", "v"], "left")
    means = seen.groupBy(*keys, "step").agg(*[(F.coalesce(F.sum(c), F.lit(0.0)) / F.count("*")).alias(c) for c in "xyz"])
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy("step")
    moved = G.Vec(tuple(F.col(c) - F.lag(c).over(w) for c in "xyz")).norm()
    bad = means.withColumn("_d", moved).groupBy(*keys).agg(F.bool_or((F.col("_d") > most) & ~F.isnan("_d")).alias("bad"))
    return lines.select(*keys).join(bad, keys, "left").select(*keys, (~F.coalesce("bad", F.lit(False))).alias("valid"))


def shortest_lines(lines: DataFrame, cloud: DataFrame, keys: list[str], size: tuple[int, int]) -> DataFrame:
    """keys, sx .. ez: of the points of 3 x 3 pixels around the start of a 2-D line and of those around its end, the two
    nearest to each other (of equal pairs the first by start column, start row, end column, end row). Columns are cut to the image's
    height and rows to its width. Pixels without a row and NaN points are left out; without points at an end there is no row."""
    cut = lambda c, most: G.clamp(c, F.lit(0), F.lit(most - 1))
    spans = {}
    for k in "01":
        x, y = F.col(f"x{k}").cast("int"), F.col(f"y{k}").cast("int")
        spans[k] = (F.sequence(cut(x - 1, size[1]), cut(x + 1, size[1])), F.sequence(cut(y - 1, size[0]), cut(y + 1, size[0])))
    whole = cloud.filter(~F.isnan("x")).select("frame_id", "u", "v", "x", "y", "z")

    def end(k, name):
        own = lines.select(*keys, F.explode(spans[k][0]).alias("u"), spans[k][1].alias("_v")).select(*keys, "u", F.explode("_v").alias("v"))
        found = own.hint("merge").join(whole, ["frame_id", "u", "v"])
        return found.select(*keys, F.struct("u", "v").alias(f"{name}p"), *[F.col(c).alias(f"{name}{c}") for c in "xyz"])

    pairs = end("0", "s").join(end("1", "e"), keys)
    d = G.Vec.of("sx", "sy", "sz") - G.Vec.of("ex", "ey", "ez")
    best = F.min(F.struct(d.dot(d).alias("d"), "sp", "ep", *[f"{p}{c}" for p in "se" for c in "xyz"])).alias("b")
    return pairs.groupBy(*keys).agg(best).select(*keys, *[F.col(f"b.{p}{c}").alias(f"{p}{c}") for p in "se" for c in "xyz"])
