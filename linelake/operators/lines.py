"""Line-level rules: facing normals, validity, labels, orthographic images, windows of frames, losses."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linelake.functions import geometry as G
from linelake.operators import blocks


def facing_normals(lines: DataFrame) -> DataFrame:
    """lines with both normals turned towards the camera at the origin, and, where both are there, in the order that
    makes (n1 x n2) point along the line."""
    middle = (G.start() + G.end()) * 0.5
    turned = {}
    for k in ("n1", "n2"):
        n = G.Vec.of(*(f"{k}{c}" for c in "xyz"))
        away = n.dot(middle) > 0
        turned |= {f"_{k}{c}": x for c, x in zip("xyz", (-n).when(away, n).c)}
    df = lines.withColumns(turned)
    a, b = G.Vec.of("_n1x", "_n1y", "_n1z"), G.Vec.of("_n2x", "_n2y", "_n2z")
    both = (a.norm() > 1e-3) & (b.norm() > 1e-3)
    swap = both & (a.cross(b).dot(G.end() - G.start()) < 0)
    first, second = b.when(swap, a), a.when(swap, b)
    own = [c for c in lines.columns if c[:2] not in ("n1", "n2") or len(c) != 3]
    return df.select(*own, *first.aliased("n1x", "n1y", "n1z"), *second.aliased("n2x", "n2y", "n2z"))


def valid_lines(lines: DataFrame, width: float, height: float, f: float, cx: float, cy: float, least: float = 0.15, border: float = 2.0, origin: float = 1e-3, cosine: float = 0.95) -> DataFrame:
    """3-D lines (sx .. ez) that agree with their 2-D lines (x0 .. y1): ends off the origin, long enough, the middle off
    the image's border, reprojected to two pixels or more, along the 2-D line and of like length."""
    a, b = G.start(), G.end()
    (u0, v0), (u1, v1) = G.project(a, f, f, cx, cy), G.project(b, f, f, cx, cy)
    re, own = G.Vec((u1 - u0, v1 - v0)), G.Vec.of("x1", "y1") - G.Vec.of("x0", "y0")
    mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = (mx >= border) & (my >= border) & (mx <= width - border) & (my <= height - border)
    along = F.abs(G.div(re.dot(own), re.norm() * own.norm()))
    return lines.filter((a.norm() > origin) & (b.norm() > origin) & ((b - a).norm() >= least) & inside).filter(~F.isnan(along) & (re.norm() >= 2) & (along >= cosine) & G.similar_length(re.norm(), own.norm(), 2.0))


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are worked out once: later expressions and filters refer to their values, where a plain
    projection would be merged into each of its uses and make generated code too long to compile."""
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def fit_to_bounds(lines: DataFrame, width: float, height: float) -> DataFrame:
    """lines with x0 .. y1 cut to [0, width] x [0, height]; 0, 0, 0, 0 where less than 1e-4 is left."""
    flat = ("x0", "y0", "x1", "y1")
    rows = settled(lines, dict(zip(("_a", "_b"), G.stretch_in_bounds(flat, width, height))))
    rows = settled(rows, dict(zip(flat, G.cut_to(flat, F.col("_a"), F.col("_b"), width, height)))).drop("_a", "_b")
    return settled(rows, dict(zip(flat, G.none_if_short(flat))))


def gated_label(kind: Column, right: Column, left: Column, near_right: Column, both: Column, right_votes: Column, left_votes: Column) -> Column:
    """Instance label of a line by its type: of a discontinuity that of the nearer side, of a line on a plane or an
    intersection the one with fewer votes, of an edge that of all votes together."""
    fewer = F.when(right_votes <= left_votes, right).otherwise(left)
    return F.when(kind == 0, F.when(near_right, right).otherwise(left)).when(kind.isin(1, 3), fewer).otherwise(both)


def background_first(label: Column, label_class: Column, other: Column, other_class: Column, background: list[int]) -> Column:
    """The label, unless its class is no background and the other's is: then the other."""
    return F.when(~label_class.isin(background) & other_class.isin(background), other).otherwise(label)


def orthographic(points: DataFrame, keys: list[str], low: tuple[float, float], size: tuple[int, int], scale: float, tie: list[str]) -> DataFrame:
    """keys, u, v, z, n_points: the nearest point of each pixel of a parallel view along z; points on the lower edges
    are in, on the upper edges out; places are cut to whole pixels."""
    u, v = ((F.col(c) - lo) / scale for c, lo in zip("xy", low))
    inside = points.filter((u >= 0) & (u < size[0]) & (v >= 0) & (v < size[1]))
    seen = inside.withColumns({"u": F.floor(u).cast("int"), "v": F.floor(v).cast("int")})
    return seen.groupBy(*keys, "u", "v").agg(F.min_by("z", F.struct("z", *tie)).alias("z"), F.count("*").alias("n_points"))


def last_frames(frames: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """items of each frame and the n - 1 before it: frame_id and item columns; an equi-join, each item in n frames."""
    other = [c for c in items.columns if c != "frame_id"]
    spread = items.withColumn("frame_id", F.explode(F.sequence(F.col("frame_id"), F.col("frame_id") + n - 1)))
    return frames.select("frame_id").distinct().join(spread, "frame_id").select("frame_id", *other)


def pruned_scenes(frames: DataFrame, least_frames: int, most_frames: int, least_lines: int, order: Column) -> DataFrame:
    """Frames (scene_id, frame_id, n_lines) of enough lines, of scenes that have enough of them, at most so many a
    scene, in a seeded order."""
    w = W.partitionBy("scene_id")
    enough = frames.filter(F.col("n_lines") >= least_lines).withColumn("_n", F.count("*").over(w)).filter(F.col("_n") >= least_frames)
    return enough.withColumn("_r", F.row_number().over(w.orderBy(order, "frame_id"))).filter(F.col("_r") <= most_frames).select("scene_id", "frame_id", "n_lines")


def pair_divergence(p: Column, q: Column, same: Column, margin: float = 2.0, tiny: float = 1e-10) -> Column:
    """Clustering loss of two lines' class distributions: their symmetric divergence where they belong together, what
    lacks of the margin where not."""
    kl = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * F.log((x + tiny) / (y + tiny))), F.lit(0.0), lambda s, x: s + x)
    d = lambda a, b: F.when(same, kl(a, b)).otherwise(F.greatest(F.lit(margin) - kl(a, b), F.lit(0.0)))
    return d(p, q) + d(q, p)


def cross_entropy(truth: Column, p: Column, tiny: float = 1e-10) -> Column:
    return -F.when(truth, F.log(p + tiny)).otherwise(F.log(1 - p + tiny))


def frame_counts(frames: DataFrame, key: str) -> DataFrame:
    """How many frames a scene has: least, greatest, scenes of more than one and of more than three."""
    n = frames.groupBy(key).agg(F.count("*").alias("n"))
    return n.agg(F.min("n").alias("least"), F.max("n").alias("greatest"), F.count_if(F.col("n") > 1).alias("over_1"), F.count_if(F.col("n") > 3).alias("over_3"))


def fused_frames(frames: DataFrame, key: list[str]) -> DataFrame:
    """One row per line seen in several frames: most frequent label and class (ties: smallest), the image with most
    pixels (ties: first frame), and in how many frames."""
    counted = lambda c: frames.groupBy(*key, c).agg(F.count("*").alias("n")).groupBy(*key).agg(F.max_by(c, F.struct("n", -F.col(c))).alias(c))
    image = frames.groupBy(*key).agg(F.min_by("frame_id", F.struct(-F.col("n_pixels"), "frame_id")).alias("image_frame"), F.count("*").alias("n_frames"))
    return counted("label").join(counted("class_id"), key).join(image, key)


def forest_distance(df: DataFrame, features: list[str], label: str, trees: int = 5, depth: int = 4, seed: int = 1) -> DataFrame:
    """df with `predicted` from a random forest, and `votes`: its trees' votes, by which lines can be compared."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.withColumn("_v", array_to_vector(F.array(*[F.col(c).cast("double") for c in features]))).withColumn("_y", F.col(label).cast("double"))
    model = RandomForestClassifier(featuresCol="_v", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed, predictionCol="predicted", rawPredictionCol="_raw", probabilityCol="_p").fit(rows)
    return model.transform(rows).withColumn("votes", vector_to_array("_raw")).drop("_v", "_y", "_raw", "_p")


def vocabulary_size(descriptors: int, most: int = 512, each: int = 10) -> int:
    """How many words a vocabulary of so many descriptors has: `most`, as long as each has `each` descriptors on
    average, and 2 at least."""
    return max(2, min(most, descriptors // each))


#: Rows of a bucket that are compared at once, at least and at most.
LEAST_ROWS, MOST_ROWS = 4096, 1 << 16


def approximate_neighbours(df: DataFrame, vector: str, key: str, radius: float, tables: int = 4, bucket: float = 0.5, seed: int = 1, block_rows: int | None = None) -> DataFrame:
    """u, v (u < v), distance of most pairs within a radius, by random-projection hashing: of all pairs that share a
    bucket of one table or more. Buckets are cut into blocks, and a task compares two blocks; a pair is told in the
    first table in which it shares a bucket, so that no pairs are shuffled. Vectors have one length."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    number = "float" if dict(df.dtypes)[vector] == "array<float>" else "double"
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(vector).cast(f"array<{number}>").alias("v")).distinct()
    rows = rows.withColumn("_v", array_to_vector(F.col("v").cast("array<double>")))
    model = BucketedRandomProjectionLSH(inputCol="_v", outputCol="_h", numHashTables=tables, bucketLength=bucket, seed=seed).fit(rows)
    hashed = model.transform(rows).withColumn("h", F.array(*[F.get(vector_to_array(F.get("_h", F.lit(i))), F.lit(0)).cast("long") for i in range(tables)]))
    hashed = hashed.select("k", "v", "h", F.posexplode("h").alias("t", "b"))
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    size = block_rows or min(max(math.ceil(rows.count() / math.sqrt(tasks)), LEAST_ROWS), MOST_ROWS)  # cells grow with the square of blocks
    # buckets of more than a block are few, whatever the number of rows
    large = hashed.groupBy("t", "b").agg(F.ceil(F.count("*") / size).alias("blocks")).filter("blocks > 1")
    placed = hashed.join(F.broadcast(large), ["t", "b"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("k", "t"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = placed.select("t", "b", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("role"), "k", "h", "v")
    cells = cells.repartition(4 * tasks, "t", "b", "i", "j").sortWithinPartitions("t", "b", "i", "j", "role")
    return cells.mapInArrow(partial(_pairs_of_cells, radius), "u long, v long, distance double")


def _pairs_of_cells(radius: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, v, distance for rows t, b, i, j, role, k, h, v: in a cell (t, b, i, j) those of role 0 are compared with those of role 1,
    and, where i = j, with each other."""
    cell, parts, first = None, [], None

    def joined(parts):
        k, h, v = (np.concatenate(x) for x in zip(*parts))
        return k, h, blocks.Block(v)

    def pairs(x, y):
        t = int(cell[0])
        for rows, cols, d2 in blocks.within(x[2], y[2], radius * radius * (1 + 1e-12)):
            a, b, d = x[0][rows], y[0][cols], np.sqrt(d2)
            ok = (d < radius) & ((a < b) if x is y else (a != b)) & (x[1][rows, :t] != y[1][cols, :t]).all(1)
            if ok.any():
                a, b = a[ok], b[ok]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(d[ok])], ["u", "v", "distance"])

    def ended():
        if parts and cell[2] == cell[3]:
            own = joined(parts)
            yield from pairs(own, own)

    for batch in batches:
        head = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(5)], 1)
        cuts = np.flatnonzero((head[1:] != head[:-1]).any(1)) + 1
        for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(head))):
            if not hi:
                continue
            h, v = (batch.column(i).slice(lo, hi - lo) for i in (6, 7))
            rows = (np.asarray(batch.column(5))[lo:hi], blocks.matrix(h, len(h[0])), blocks.matrix(v, len(v[0])))
            if tuple(head[lo][:4]) != cell:
                yield from ended()
                cell, parts, first = tuple(head[lo][:4]), [], None
            if head[lo][4] == 0:
                parts.append(rows)
            elif parts or first:
                first = first or joined(parts)
                parts = []
                yield from pairs(first, (*rows[:2], blocks.Block(rows[2])))
    yield from ended()


def beside(points: DataFrame, own: DataFrame, keys: list[str]) -> DataFrame:
    """Points with the ends of their lines: as they are where they have them already."""
    return points if "sx" in points.columns else points.join(own, keys)


def near_lines(points: DataFrame, own: DataFrame, on: list[str], within: float) -> DataFrame:
    """points (x, y, z) with each line (sx .. ez) of the same `on` that they lie within a distance of, and with a few others.
    Lines are listed by the cells of space around them, as wide as the distance, and points meet them there."""
    a, b = G.start(), G.end()
    m = F.ceil((b - a).norm() / within)
    rows = own.join(points.select(*on).distinct(), on, "left_semi").filter((m > 0) & (m < 1 << 31))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), m)).alias("_k"), m.alias("_m"))
    rows = settled(rows, dict(zip(("_x", "_y", "_z"), ((a + (b - a) * (F.col("_k") / F.col("_m"))) * (1 / within)).c)))
    # no point is further than 1.5 cells from the nearest of these places; what rounding adds stays below 0.1
    step = lambda c, o: F.floor(c) + o
    apart = lambda c, o: F.greatest(step(c, o) - F.col(c), F.col(c) - step(c, o + 1), F.lit(0.0))
    rows = rows.withColumn("_o", F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("xyz", o)]) for o in product(range(-2, 3), repeat=3)])))
    axes = [(f"_{n}", F.col("_o").getField(n)) for n in "xyz"]
    rows = rows.filter(sum((apart(c, o) * apart(c, o) for c, o in axes), F.lit(0.0)) <= 1.6 * 1.6)
    listed = rows.select(*own.columns, F.xxhash64(*[step(c, o) for c, o in axes]).alias("_cell")).distinct()
    at = points.withColumn("_cell", F.xxhash64(*[F.floor(F.col(n) * (1 / within)) for n in "xyz"]))
    return at.join(listed.hint("shuffle_hash"), [*on, "_cell"]).drop("_cell")


def nearest_point(points: DataFrame, own: DataFrame, keys: list[str], tie: list[str]) -> DataFrame:
    """The point of each group nearest to its (infinite) line, and its distance; ties by `tie`."""
    d = G.point_to_line(G.start(), G.end(), G.Vec.of("x", "y", "z"))
    return beside(points, own, keys).groupBy(*keys).agg(F.min(F.struct(d.alias("distance"), *tie)).alias("p")).select(*keys, "p.*")


def mean_distance(points: DataFrame, own: DataFrame, keys: list[str], missing: float = 1e9) -> DataFrame:
    """rating: the mean distance of a line's points (NaN points left out); lines without points get `missing`."""
    d = G.point_to_line(G.start(), G.end(), G.Vec.of("x", "y", "z"))
    seen = beside(points, own, keys).filter(~F.isnan("x") & ~F.isnan("y") & ~F.isnan("z")).groupBy(*keys).agg(F.avg(d).alias("rating"))
    return own.join(seen, keys, "left").select(*keys, F.coalesce("rating", F.lit(missing)).alias("rating"))


def gaps(pairs: DataFrame, keys: list[str], distance: str, least: float) -> DataFrame:
    """parts: one more than the gaps of at least `least` between neighbours in the order of a group's distances."""
    step = F.col(distance) - F.lag(distance).over(W.partitionBy(*keys).orderBy(distance))
    return pairs.withColumn("_s", step).groupBy(*keys).agg((F.count_if(F.col("_s") >= least) + 1).alias("parts"))


def fused_pair(a1: G.Vec, b1: G.Vec, a2: G.Vec, b2: G.Vec) -> tuple[G.Vec, G.Vec]:
    """One segment along the first: from the least to the greatest projection of all four ends."""
    d = (b1 - a1).unit()
    t = [(p - a1).dot(d) for p in (a1, b1, a2, b2)]
    return a1 + d * F.least(*t), a1 + d * F.greatest(*t)


def discontinuity_end(a: G.Vec, b: G.Vec, plane: tuple[G.Vec, Column], camera_ray: G.Vec) -> G.Vec:
    """Where the ray from the camera at the origin meets the plane; the line's start if they are parallel."""
    return G.plane_meets_line(plane, G.Vec.of(0.0, 0.0, 0.0), camera_ray).when(F.abs(plane[0].dot(camera_ray)) > 1e-9, a)


def segment_distances(pairs: DataFrame, first: str = "a", second: str = "b", name: str = "distance") -> DataFrame:
    """pairs with the shortest distance of two segments, as geometry.segment_distance, worked out from the scalar
    products of their directions u, v and of w between their starts, each of them computed once."""
    a, b = G.start(first), G.start(second)
    u, v, w = G.end(first) - a, G.end(second) - b, a - b
    dots = {"_uu": u.dot(u), "_uv": u.dot(v), "_vv": v.dot(v), "_uw": u.dot(w), "_vw": v.dot(w), "_ww": w.dot(w)}
    uu, uv, vv, uw, vw, ww = (F.col(k) for k in dots)
    df = pairs.withColumns(dots)
    df = df.withColumn("_det", uu * vv - uv * uv)
    df = df.withColumns({"_s": G.div(uv * vw - vv * uw, F.col("_det")), "_t": G.div(uu * vw - uv * uw, F.col("_det"))})
    df = df.withColumns({"_k0": G.clamp(G.div(vw, vv), 0.0, 1.0), "_k1": G.clamp(G.div(vw + uv, vv), 0.0, 1.0), "_k2": G.clamp(G.div(-uw, uu), 0.0, 1.0), "_k3": G.clamp(G.div(uv - uw, uu), 0.0, 1.0)})
    s, t, k0, k1, k2, k3 = (F.col(k) for k in ("_s", "_t", "_k0", "_k1", "_k2", "_k3"))
    ends = F.least(ww - 2 * k0 * vw + k0 * k0 * vv, ww + 2 * uw + uu - 2 * k1 * (vw + uv) + k1 * k1 * vv, ww + 2 * k2 * uw + k2 * k2 * uu, vv - 2 * vw + ww - 2 * k3 * (uv - uw) + k3 * k3 * uu)
    gap = ww + s * s * uu + t * t * vv + 2 * s * uw - 2 * t * vw - 2 * s * t * uv
    inner = (F.col("_det") > 1e-12) & (s >= 0) & (s <= 1) & (t >= 0) & (t <= 1)
    d = F.sqrt(F.greatest(F.when(inner, gap).otherwise(ends), F.lit(0.0)))
    return df.select(*pairs.columns, F.when((uu == 0) | (vv == 0), F.lit(float("nan"))).otherwise(d).alias(name))
