"""Lines of an image lifted to 3-D by the planes beside them.

A 2-D line gets a first guess from the depths along it, points in the strips to either side, a plane a side, and from
these its place and type: 0 at a discontinuity, 1 on one plane, 2 an edge of an object, 3 an intersection of two.

Tables: lines have `keys` (frame_id among them) and x0 .. y1 in pixels or sx .. ez in space; the cloud is frame_id, u, v,
x, y, z as seen from a camera (fx, fy, cx, cy) at the origin. Planes are ra .. rd (right of the line) and la .. ld (left),
with normals towards the origin; a side that doesn't count is all 0. What is grouped is the pixels beside one line, whose
number the image bounds; rows only meet in equi-joins on the keys or on pixels.

Lines without depth at an end, outside the image, with a point (0, 0, 0) or too few points beside them give no row; NaN
and null points count as missing. Of equally near points the smallest (x, y, z) is taken. What several later steps need
(guesses, points of planes, lines before their types) is checkpointed, so that it is worked out once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linelake.functions import geometry as G
from linelake.operators import lines as L
from linelake.operators import pixels, planes
from linelake.plans.session import checkpointed
from linelake.sources.settings import LineSettings

ENDS = ("sx", "sy", "sz", "ex", "ey", "ez")
FLAT = ("x0", "y0", "x1", "y1")
RIGHT, LEFT = ("ra", "rb", "rc", "rd"), ("la", "lb", "lc", "ld")
STEPS = 5

Camera = tuple[float, float, float, float]


def _plane(names: tuple[str, ...]) -> tuple[G.Vec, Column]:
    return G.Vec.of(*names[:3]), F.col(names[3])


def _vec(column: str, names: str) -> G.Vec:
    return G.Vec(tuple(F.col(column).getField(n) for n in names.split()))


def _named(names: str, *vectors: G.Vec) -> dict[str, Column]:
    return dict(zip(names.split(), [c for v in vectors for c in v.c]))


def prolonged(lines: DataFrame, length: float, steps: int = STEPS) -> DataFrame:
    """lines with tip (0 before the start, 1 past the end) and step (0 ..): the piece of (step + 1) * length that goes on
    from that end, in the direction of the line, as sx .. ez."""
    d, reach = G.Vec.of("_dx", "_dy", "_dz"), (F.col("step") + 1) * length
    rows = L.settled(lines, _named("_dx _dy _dz", (G.end() - G.start()).unit()))
    rows = rows.withColumn("tip", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    before = F.col("tip") == 0
    a, b = (G.start() - d * reach).when(before, G.end()), G.start().when(before, G.end() + d * reach)
    return L.settled(rows, _named(" ".join(ENDS), a, b)).drop("_dx", "_dy", "_dz")


def prolonged_counts(lines: DataFrame, cloud: DataFrame, keys: list[str], camera: Camera, size: tuple[int, int], error: float = 0.005, length: float = 0.08) -> DataFrame:
    """keys, tip, step, side (0 right, 1 left), n, n_fit: the points in the strips beside the prolonged pieces of lines
    (with ra .. ld), and how many of them lie within `error` of that side's plane. Strips without points have no row."""
    (u0, v0), (u1, v1) = G.project(G.start(), *camera), G.project(G.end(), *camera)
    own = [*keys, "tip", "step", *RIGHT, *LEFT]
    lines = lines.join(cloud.select("frame_id").distinct(), "frame_id", "left_semi")  # a line has thousands of pixels in its strips
    flat = prolonged(lines.select(*keys, *ENDS, *RIGHT, *LEFT), length).filter((F.col("sz") > 0) & (F.col("ez") > 0))
    flat = L.settled(flat, dict(zip(FLAT, (u0, v0, u1, v1))))
    near = pixels.strip_pixels(flat.filter(~reduce(lambda a, b: a | b, [F.isnan(c) for c in FLAT])), own, *size)
    seen = near.hint("merge").join(cloud.filter(~F.isnan("x")), ["frame_id", "u", "v"])
    p = G.Vec.of("x", "y", "z")
    far = F.when(F.col("side") == 0, G.point_to_plane(_plane(RIGHT), p)).otherwise(G.point_to_plane(_plane(LEFT), p))
    return seen.groupBy(*keys, "tip", "step", "side").agg(F.count("*").alias("n"), F.count_if(far < error).alias("n_fit"))


def prolonged_patterns(lines: DataFrame, cloud: DataFrame, keys: list[str], camera: Camera, size: tuple[int, int], s: LineSettings = LineSettings()) -> DataFrame:
    """keys, pattern: whether the planes left and right go on before the start, and left and right past the end (four
    digits). Each end is prolonged step by step while both planes go on beside it, four times at most; the digits are
    those of its last step. All steps are counted at once, and the last one is picked from bits."""
    counts = prolonged_counts(lines, cloud, keys, camera, size, s.max_plane_error, s.extension_length)
    goes_on = (F.col("n") >= s.min_points_in_prolonged_rect) & (F.col("n_fit") >= s.max_points_for_empty_rect)
    bit = F.when(goes_on, F.pow(F.lit(2), "step").cast("long")).otherwise(F.lit(0).cast("long"))
    strips = [(tip, side) for tip in (0, 1) for side in (1, 0)]
    bits = counts.groupBy(*keys).agg(*[F.sum(F.when((F.col("tip") == t) & (F.col("side") == k), bit).otherwise(0)).alias(f"_{t}{k}") for t, k in strips])
    found = lines.select(*keys).join(bits, keys, "left").select(*keys, *[F.coalesce(f"_{t}{k}", F.lit(0)).alias(f"_{t}{k}") for t, k in strips])

    def last(tip: int) -> Column:
        both = F.col(f"_{tip}0").bitwiseAND(F.col(f"_{tip}1"))
        return F.coalesce(*[F.when(F.bit_get(both, F.lit(k)) == 0, k) for k in range(STEPS - 1)], F.lit(STEPS - 1))

    found = found.withColumns({f"_last{t}": last(t) for t in (0, 1)})
    return found.select(*keys, F.concat(*[F.bit_get(F.col(f"_{t}{k}"), F.col(f"_last{t}")).cast("string") for t, k in strips]).alias("pattern"))


def rated(lines: DataFrame, cloud: DataFrame, keys: list[str], size: tuple[int, int]) -> DataFrame:
    """keys, shift, rating, sx .. ez: the 3-D line between the first and the last point along a 2-D line, or along the
    line one pixel to either side of it if that one's points keep nearer to their line (mean distance)."""
    x0, y0, x1, y1 = (F.col(c) for c in FLAT)
    n = F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))

    def moved(sign: int) -> list[Column]:
        across = [F.floor(G.div((y1 - y0) * sign, n) + 0.5), F.floor(G.div((x1 - x0) * -sign, n) + 0.5)]
        return [G.clamp(F.floor(c) + across[i % 2], 0.0, size[i % 2] - 1.0).alias(FLAT[i]) for i, c in enumerate((x0, y0, x1, y1))]

    ways = F.array(*[F.struct(F.lit(k).alias("shift"), *(moved(k) if k else [c.alias(m) for c, m in zip((x0, y0, x1, y1), FLAT)])) for k in (0, -1, 1)])
    three = lines.filter(n > 0).select(*keys, F.inline(ways))
    walk = three.select(*keys, "shift", F.explode(pixels.steps(*FLAT)).alias("p")).select(*keys, "shift", "p.*")
    seen = walk.hint("merge").join(cloud.filter(~F.isnan("x")), ["frame_id", "u", "v"])
    w = W.partitionBy(*keys, "shift")
    here = F.struct("step", "x", "y", "z")
    seen = seen.withColumns({"_a": F.min(here).over(w), "_b": F.max(here).over(w)})
    a, b = _vec("_a", "x y z"), _vec("_b", "x y z")
    far = G.point_to_line(a, b, G.Vec.of("x", "y", "z"))
    one = seen.groupBy(*keys, "shift").agg(F.avg(F.when(F.col("step") < F.col("_b.step"), far)).alias("rating"), F.any_value("_a").alias("_a"), F.any_value("_b").alias("_b"))
    none = F.isnull("rating") | F.isnan("rating") | (a.norm() == 0) | (b.norm() == 0)
    one = one.select(*keys, "shift", F.when(none, 1e9).otherwise(F.col("rating")).alias("rating"), *a.aliased(*ENDS[:3]), *b.aliased(*ENDS[3:]))
    return pixels.shifted_best(one, keys, ENDS)


def on_planes(guesses: DataFrame, inliers: DataFrame, cloud: DataFrame, keys: list[str], camera: Camera, size: tuple[int, int], s: LineSettings = LineSettings()) -> DataFrame:
    """keys, x0 .. y1, sx .. ez, type, ra .. ld of the guesses (x0 .. y1 and sx .. ez) that the points of their planes
    (keys, side, x, y, z) bear out.

    Two planes that meet the other's points within `max_dist_between_planes`: type 1 if they are nearly parallel, the
    guess cut to its points; else the line where they meet, cut likewise: 2 if convex, or if both planes go on past
    neither end or past both, else 3. Otherwise type 0: the guess seen onto the plane nearer to the origin and moved
    through that plane's point nearest to it in the image; only this plane stays. A line goes if too few points lie
    on it (types 1 to 3), if less than a quarter of them lie in its middle half, or if its planes are neither convex nor
    concave. Its ends come in the order of the 2-D line's."""
    fits = planes.fit_planes(inliers, [*keys, "side"], means=True)
    one = F.struct("a", "b", "c", "d", "mx", "my", "mz")
    sides = fits.groupBy(*keys).agg(F.any_value(F.when(F.col("side") == 0, one), F.lit(True)).alias("_r"), F.any_value(F.when(F.col("side") == 1, one), F.lit(True)).alias("_l"))
    rows = guesses.select(*keys, *FLAT, *ENDS).join(sides, keys)
    right, left = ((_vec(c, "a b c"), F.col(c).getField("d")) for c in ("_r", "_l"))
    turned = [F.coalesce(c, F.lit(0.0)) for h in (right, left) for c in (lambda t: (*t[0].c, t[1]))(G.towards_origin(h))]
    rows = L.settled(rows, dict(zip((*RIGHT, *LEFT), turned)))
    right, left = _plane(RIGHT), _plane(LEFT)
    mr, ml = _vec("_r", "mx my mz"), _vec("_l", "mx my mz")
    apart = [F.abs((mr - ml).dot(h[0])) < s.max_dist_between_planes for h in (right, left)]
    meet = F.coalesce(apart[0] & apart[1], F.lit(False))
    rows = L.settled(rows, {
        "_kind": F.when(~meet, 0).when(F.abs(right[0].dot(left[0])) > 0.95, 1).otherwise(2),
        "_nearer": F.when(F.isnull("_l"), 0).when(F.isnull("_r"), 1).when(mr.norm() < ml.norm(), 0).otherwise(1),
    }).drop("_r", "_l")
    kind, nearer, side = F.col("_kind"), F.col("_nearer"), F.col("side")
    rows = L.settled(rows, _named("_dx _dy _dz", right[0].cross(left[0]).unit()))
    d = G.Vec.of("_dx", "_dy", "_dz")
    at = G.on_both_planes(right, left, d)
    front = (right[0].when(nearer == 0, left[0]), F.when(nearer == 0, right[1]).otherwise(left[1]))
    seen = [L.discontinuity_end(p, q, front, p) for p, q in ((G.start(), G.end()), (G.end(), G.start()))]
    a, b = seen[0].when(kind == 0, at.when(kind == 2, G.start())), seen[1].when(kind == 0, (at + d).when(kind == 2, G.end()))
    tips = "_ax _ay _az _bx _by _bz"
    q0, q1 = (G.Vec(G.project(v, *camera)) for v in (G.start(), G.end()))
    rows = L.settled(rows, _named(tips, a, b) | _named("_u0 _v0 _u1 _v1", q0, q1)).drop("_dx", "_dy", "_dz")

    # all points of a line lie in one task from here on: its windows and its group share the join's partitions
    w = W.partitionBy(*keys)
    points = inliers.select(*keys, "side", "x", "y", "z").hint("merge").join(rows.hint("merge"), keys)
    p, a, b = G.Vec.of("x", "y", "z"), G.Vec.of("_ax", "_ay", "_az"), G.Vec.of("_bx", "_by", "_bz")
    points = L.settled(points, _named("_u _v", G.Vec(G.project(p, *camera))))
    q0, way, q = G.Vec.of("_u0", "_v0"), G.Vec.of("_u1", "_v1") - G.Vec.of("_u0", "_v0"), G.Vec.of("_u", "_v")
    points = points.withColumn("_off", G.div(F.abs((q - q0).c[0] * way.c[1] - (q - q0).c[1] * way.c[0]), way.norm()))
    points = points.withColumn("_near", F.min(F.when((kind == 0) & (side == nearer), F.struct("_off", "x", "y", "z"))).over(w))
    foot = G.onto_plane(_vec("_near", "x y z"), front)
    points = L.settled(points, _named("_mx _my _mz", foot))
    foot = G.Vec.of("_mx", "_my", "_mz")
    points = L.settled(points, _named("_mx _my _mz", foot - G.onto_line(a, b, foot)))
    move = G.Vec.of("_mx", "_my", "_mz")
    lost = reduce(lambda x, y: x | y, [F.isnan(c) for c in (*(a + move).c, *(b + move).c)])
    ends = [e.when(kind > 0, g.when(lost, e + move)) for e, g in ((a, G.start()), (b, G.end()))]
    points = L.settled(points, _named(tips, *ends))
    on = ((kind > 0) | (side == nearer)) & (G.point_to_line(a, b, p) <= s.max_deviation)
    points = L.settled(points, {"_t": F.when(on, (p - a).dot((b - a).unit()))})
    points = points.withColumns({"_low": F.when(kind > 0, F.min("_t").over(w)).otherwise(0.0), "_high": F.when(kind > 0, F.max("_t").over(w)).otherwise((b - a).norm())})
    place = G.div(F.col("_t") - F.col("_low"), F.col("_high") - F.col("_low"))
    before = lambda k, h: F.count_if((side == k) & (h[0].dot(p) + h[1] > 0)) >= F.count_if((side == k) & (h[0].dot(p) + h[1] <= 0))
    kept = [*FLAT, *RIGHT, *LEFT, "_kind", "_nearer", "_low", "_high", "_ax", "_ay", "_az", "_bx", "_by", "_bz"]
    found = points.groupBy(*keys).agg(
        F.any_value(F.struct(*kept)).alias("_k"), F.count("_t").alias("_n"), F.avg(F.when(F.isnotnull("_t"), F.when((place > 0.25) & (place < 0.75), 1.0).otherwise(0.0))).alias("_share"),
        before(0, left).alias("_f0"), before(1, right).alias("_f1"),
    ).select(*keys, "_k.*", "_n", "_share", "_f0", "_f1")
    found = found.filter((F.coalesce("_share", F.lit(1.0)) >= 0.25) & ((kind == 0) | (F.col("_n") >= s.min_points_in_line)) & ((kind < 2) | (F.col("_f0") == F.col("_f1"))))
    d = (b - a).unit()
    found = L.settled(found, _named(tips, *(a + d * F.col(t) for t in ("_low", "_high"))))
    found = L.settled(found, _named("_u0 _v0 _u1 _v1", *(G.Vec(G.project(v, *camera)) for v in (a, b))))
    first, last, ref, flat = a, b, (G.Vec.of(*FLAT[:2]), G.Vec.of(*FLAT[2:])), (G.Vec.of("_u0", "_v0"), G.Vec.of("_u1", "_v1"))
    swap = ((flat[0] - ref[1]).norm() < (flat[0] - ref[0]).norm()) & ((flat[1] - ref[0]).norm() < (flat[1] - ref[1]).norm())
    gone = {c: F.when((kind == 0) & (nearer != k), 0.0).otherwise(F.col(c)) for k, names in ((0, RIGHT), (1, LEFT)) for c in names}
    found = found.select(*keys, *FLAT, "_kind", "_f0", *last.when(swap, first).aliased(*ENDS[:3]), *first.when(swap, last).aliased(*ENDS[3:]), *[v.alias(k) for k, v in gone.items()])
    found = checkpointed(found)
    concave = found.filter((kind == 2) & F.col("_f0"))
    patterns = prolonged_patterns(concave, cloud, keys, camera, size, s)
    kinds = found.join(patterns, keys, "left").withColumn("type", F.when(kind < 2, kind).when(F.isnull("pattern"), 2).otherwise(planes.extended_type(F.col("pattern"))).cast("int"))
    return kinds.select(*keys, *FLAT, *ENDS, "type", *RIGHT, *LEFT)


def lift(lines: DataFrame, cloud: DataFrame, keys: list[str], camera: Camera, size: tuple[int, int], s: LineSettings = LineSettings()) -> DataFrame:
    """on_planes of 2-D lines: cut to the image, shrunk a little for the first guess, with the planes of the points in
    their strips (both strips need `min_points_in_rect` points). A plane of one side alone makes a discontinuity."""
    fitted = L.fit_to_bounds(lines.select(*keys, *FLAT), *size)
    fitted = fitted.filter(reduce(lambda a, b: a | b, [F.col(c) != 0 for c in FLAT]))
    shorter = L.settled(fitted, dict(zip(FLAT, G.shrunk_2d(FLAT, 0.8))))
    guesses = checkpointed(fitted.join(rated(shorter, cloud, keys, size).filter(F.col("rating") <= s.max_rating).drop("shift", "rating"), keys))
    near = pixels.inliers(pixels.strip_pixels(guesses, keys, *size, s.rectangle_offset, s.max_rect_size), cloud.select("frame_id", "u", "v", "x", "y", "z"), keys)
    both = near.groupBy(*keys).agg(F.count_if(F.col("side") == 0).alias("_r"), F.count_if(F.col("side") == 1).alias("_l")).filter(F.least("_r", "_l") >= s.min_points_in_rect)
    near = near.join(both.select(*keys), keys, "left_semi").select(*keys, "side", "x", "y", "z")
    inliers = planes.ransac(near, [*keys, "side"], s.ransac_rounds, s.max_plane_error, s.min_inliers, gap=s.max_inlier_gap, share=s.min_inlier_share, stop=s.ransac_stop)
    return on_planes(guesses, checkpointed(inliers), cloud, keys, camera, size, s)
