"""Virtual cameras that look at lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linelake.functions import geometry as G
from linelake.operators.lines import settled


def _struct(v: G.Vec) -> Column:
    return F.struct(*[c.alias(k) for c, k in zip(v.c, "xyz")])


def _vec(c: Column) -> G.Vec:
    return G.Vec(tuple(c.getField(k) for k in "xyz"))


def virtual_camera_origins(lines: DataFrame, distance: float) -> DataFrame:
    """lines with camx, camy, camz: of the places at `distance` from a line's middle, across the line and along or
    against its surfaces' normals (edges and intersections: along their sums and differences), the one nearest to the
    origin; the first of equals. lines: sx .. ez, n1x .. n2z, type. Worked out step by step, so that generated code
    stays small."""
    a, b, n1, n2, kind = G.start(), G.end(), G.Vec.of("n1x", "n1y", "n1z"), G.Vec.of("n2x", "n2y", "n2z"), F.col("type")
    single = n2.when((kind == 0) & (n1.norm() <= 0.001), n1)  # of a discontinuity: the normal that is there
    flat = F.array(_struct(single), _struct(-single))
    sums = F.array(*[_struct(v) for v in (n1 + n2, n1 - n2, -n1 - n2, -n1 + n2)])
    units = F.transform("_c", lambda z: _struct(_vec(z).unit()))
    df = lines.withColumn("_x", _struct((b - a).unit())).withColumn("_m", _struct((a + b) * 0.5))
    df = df.withColumn("_c", F.when(kind < 2, flat).otherwise(sums)).withColumn("_c", F.when(kind < 2, F.col("_c")).otherwise(units))
    df = df.withColumn("_c", F.transform("_c", lambda z: _struct(_vec(z) - _vec(F.col("_x")) * _vec(z).dot(_vec(F.col("_x"))))))
    df = df.withColumn("_c", F.transform("_c", lambda p: _struct(_vec(F.col("_m")) - _vec(p).unit() * distance)))
    best = F.array_min(F.transform("_c", lambda o, i: F.struct(_vec(o).norm().alias("r"), i.alias("i"), o.alias("o"))))
    return df.withColumn("_b", best.getField("o")).select(*lines.columns, *[F.col(f"_b.{k}").alias(f"cam{k}") for k in "xyz"])


def dense_enough(views: DataFrame, least: float = 40.0, per_length: float = 50.0) -> DataFrame:
    """Views (n_pixels, length) with enough pixels, and enough for the line's length."""
    return views.filter((F.col("n_pixels") * 1.5 > least) & (G.div(F.col("n_pixels").cast("double"), F.col("length")) > per_length))


def line_views(lines: DataFrame, points: DataFrame, keys: list[str], camera: tuple[float, float, float, float], values: list[str], tie: list[str], distance: float = 0.25, depth: float = 0.5, most: int = 120) -> DataFrame:
    """keys, width, height, u, v, z, values, n_points, depth8: the image of each line (frame_id among the keys; sx .. ez,
    n1x .. n2z, type, in camera axes) that its virtual camera takes of the frame's points (frame_id, x, y, z), seen in parallel: a
    box of 1.5 by 1 lengths of the line and of `depth` in front of the camera, at most `most` pixels wide. Of a pixel's points
    the nearest is taken, then the first by `tie`. depth8 are the millimetres modulo 256, as an 8-bit image holds them.
    Lines that dense_enough leaves out have no image; pixels without points have no row.

    Points only meet the lines whose boxes lie near: boxes are put into classes of size (powers of 2), each with its own grid, and a point is
    looked up in its one cell of each class that its frame has."""
    (u0, v0), (u1, v1) = G.project(G.start(), *camera), G.project(G.end(), *camera)
    a, b, origin = G.start(), G.end(), G.Vec.of("camx", "camy", "camz")
    own = settled(lines, {"n_pixels": G.Vec((u1 - u0, v1 - v0)).norm(), "length": (b - a).norm()})
    own = dense_enough(virtual_camera_origins(own.filter(F.col("length") > 0), distance))
    rows, _ = G.virtual_camera(a, b, origin)
    turn = {f"_{n}{c}": x for n, row in zip("abc", rows) for c, x in zip("xyz", row.c)}
    own = settled(own, turn | {"width": F.least(F.lit(most), (F.col("n_pixels") * 1.5).cast("int"))}).withColumn("height", (F.col("width") / 1.5).cast("int"))
    middle, half = (a + b) * 0.5, F.sqrt(F.col("length") * F.col("length") * (0.75 * 0.75 + 0.5 * 0.5) + max(distance, depth) ** 2)
    own = settled(own, {"_half": half, "_mx": middle.c[0], "_my": middle.c[1], "_mz": middle.c[2], "class": F.ceil(F.log2(half * 2)).cast("int")})
    side = F.pow(F.lit(2.0), "class")
    for c in "xyz":
        own = own.withColumn(f"g{c}", F.explode(F.sequence(F.floor((F.col(f"_m{c}") - F.col("_half")) / side), F.floor((F.col(f"_m{c}") + F.col("_half")) / side))))
    grid = ["frame_id", "class", "gx", "gy", "gz"]
    boxes = own.select(*keys, "class", "gx", "gy", "gz", "width", "height", "length", *turn, *[F.col(f"cam{c}") for c in "xyz"])
    seen = points.join(own.select("frame_id", "class").distinct(), "frame_id").withColumns({f"g{c}": F.floor(F.col(c) / side) for c in "xyz"})
    met = seen.join(boxes, grid)
    off = G.Vec.of("x", "y", "z") - origin
    local = {f"_p{c}": G.Vec.of(f"_{n}x", f"_{n}y", f"_{n}z").dot(off) for n, c in zip("abc", "xyz")}
    met = settled(met, local)
    wide, high = F.col("length") * 1.5, F.col("length")
    px, py, pz = (F.col(f"_p{c}") for c in "xyz")
    inside = met.filter((px >= -wide / 2) & (px < wide / 2) & (py >= -high / 2) & (py < high / 2) & (pz >= 0) & (pz < depth))
    pixel = lambda p, n, size: (p * (F.col(n) / size) + F.col(n) / 2).cast("int")
    shot = inside.withColumns({"u": pixel(px, "width", wide), "v": pixel(py, "height", high)}).filter((F.col("u") >= 0) & (F.col("u") < F.col("width")) & (F.col("v") >= 0) & (F.col("v") < F.col("height")))
    near = F.min_by(F.struct(pz.alias("z"), *values), F.struct(pz.alias("z"), *tie))
    image = shot.groupBy(*keys, "width", "height", "u", "v").agg(near.alias("p"), F.count("*").alias("n_points"))
    return image.select(*keys, "width", "height", "u", "v", "p.*", "n_points").withColumn("depth8", F.floor(F.col("z") * 1000.0) % 256)
