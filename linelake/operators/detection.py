"""Line segments of images, from tables of pixels: gradients, edges and a Hough transform.

An image is frame_id, u, v and grey (whole numbers, a row a pixel; a pixel without a row is 0). Its pixels are never brought together: stencils are rows that
each pixel sends to its neighbours, hysteresis is a connected component of edge pixels, and the accumulator is a partial
aggregate over pixels and angles. Only the edge pixels on one line are sorted together; an image has at most a few times its
diagonal of them. Sines and cosines are whole millionths, so that places in the accumulator are exact.

Empty images have no edges; repeated pixels are the caller's to merge; null greys count as 0."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linelake.operators import clustering
from linelake.sources.settings import LineSettings

LSD, EDL, FAST, HOUGH = range(4)

MILLION = 1_000_000
ANGLES = 180
#: A gradient is flat below tan(22.5 degrees) and steep above tan(67.5 degrees), in units of 2 ** -15.
FLAT = round(math.tan(math.pi / 8) * (1 << 15))


def _weights(at: Column, step: int, size: int) -> tuple[Column, Column]:
    """What a pixel gives to the one `step` further along an axis: weights of the difference and of the mean. Pixels at
    the border stand for those beyond it too."""
    if step:
        return F.lit(-step), F.lit(1)
    first, last = (at == 0).cast("int"), (at == size - 1).cast("int")
    return last - first, first + last + 2


def gradients(image: DataFrame, size: tuple[int, int]) -> DataFrame:
    """frame_id, u, v, gx, gy: Sobel gradients of 3 x 3 pixels where they aren't both 0."""
    grey = F.coalesce(F.col("grey").cast("long"), F.lit(0).cast("long"))
    sent = []
    for du in (-1, 0, 1):
        for dv in (-1, 0, 1):
            (dx, mx), (dy, my) = _weights(F.col("u"), du, size[0]), _weights(F.col("v"), dv, size[1])
            sent.append(F.struct((F.col("u") + du).alias("u"), (F.col("v") + dv).alias("v"), (grey * dx * my).alias("gx"), (grey * mx * dy).alias("gy")))
    rows = image.filter(grey != 0).select("frame_id", F.explode(F.array(*sent)).alias("s")).select("frame_id", "s.*")
    rows = rows.filter((F.col("u") >= 0) & (F.col("u") < size[0]) & (F.col("v") >= 0) & (F.col("v") < size[1]))
    return rows.groupBy("frame_id", "u", "v").agg(F.sum("gx").alias("gx"), F.sum("gy").alias("gy")).filter((F.col("gx") != 0) | (F.col("gy") != 0))


def thin_edges(found: DataFrame, low: int) -> DataFrame:
    """frame_id, u, v, size (|gx| + |gy|) of pixels above `low` that are the largest across their edge. Of two equal
    ones side by side, or one above the other, the one with the smaller place stays."""
    sized = found.withColumn("size", F.abs("gx") + F.abs("gy"))
    x, y = F.abs("gx") * FLAT, F.abs("gy") * (1 << 15)
    steep = x + F.abs("gx") * (1 << 16)
    sign = F.when((F.col("gx") < 0) == (F.col("gy") < 0), 1).otherwise(-1)
    du = F.when(y < x, 1).when(y > steep, 0).otherwise(sign)
    dv = F.when(y < x, 0).otherwise(1)
    ask = F.explode(F.array(*[F.struct((F.col("u") + du * k).alias("ou"), (F.col("v") + dv * k).alias("ov"), F.lit(k == 1).alias("after"), ((y >= x) & (y <= steep)).alias("slant")) for k in (-1, 1)]))
    asks = sized.filter(F.col("size") > low).select("frame_id", "u", "v", "size", ask.alias("a")).select("frame_id", "u", "v", "size", "a.*")
    other = sized.select("frame_id", F.col("u").alias("ou"), F.col("v").alias("ov"), F.col("size").alias("osize"))
    seen = asks.join(other, ["frame_id", "ou", "ov"], "left").withColumn("osize", F.coalesce("osize", F.lit(0).cast("long")))
    larger = (F.col("size") > F.col("osize")) | (F.col("after") & ~F.col("slant") & (F.col("size") == F.col("osize")))
    return seen.groupBy("frame_id", "u", "v", "size").agg(F.bool_and(larger).alias("top")).filter("top").drop("top")


def canny(image: DataFrame, size: tuple[int, int], low: int = 50, high: int = 200) -> DataFrame:
    """frame_id, u, v of edge pixels: thin edges above `low` that hang together (with all eight neighbours) with one above `high`."""
    thin = clustering.checkpointed(thin_edges(gradients(image, size), low))
    node = (F.col("frame_id").cast("long") * size[1] + F.col("v")) * size[0] + F.col("u")
    own = thin.select(node.alias("node"), "frame_id", "u", "v", (F.col("size") > high).alias("strong"))
    step = F.explode(F.array(*[F.struct((F.col("u") + du).alias("u"), (F.col("v") + dv).alias("v")) for du, dv in ((1, 0), (-1, 1), (0, 1), (1, 1))]))
    links = own.select("frame_id", F.col("node").alias("a"), step.alias("s")).select("frame_id", "a", "s.*").join(own.select("frame_id", "u", "v", F.col("node").alias("b")), ["frame_id", "u", "v"])
    named = own.join(clustering.components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), own.select("node")), "node")
    alive = named.groupBy("component").agg(F.bool_or("strong").alias("alive")).filter("alive").drop("alive")
    return named.join(alive, "component", "left_semi").select("frame_id", "u", "v")


def _angles() -> Column:
    turn = [(k, round(math.cos(math.pi * k / ANGLES) * MILLION), round(math.sin(math.pi * k / ANGLES) * MILLION)) for k in range(ANGLES)]
    return F.explode(F.array(*[F.struct(F.lit(k).alias("theta"), F.lit(c).cast("long").alias("c"), F.lit(s).cast("long").alias("s")) for k, c, s in turn]))


def _on_lines(edges: DataFrame) -> DataFrame:
    """A row for each edge pixel and angle (in steps of a degree): theta, rho (distance of the line from the origin in whole pixels),
    along (the pixel's place along it, in millionths)."""
    rows = edges.select("frame_id", "u", "v", _angles().alias("t")).select("frame_id", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), "t.*")
    rho = F.floor((F.col("u") * F.col("c") + F.col("v") * F.col("s") + MILLION // 2) / MILLION).cast("long")
    return rows.select("frame_id", "u", "v", "theta", rho.alias("rho"), (F.col("v") * F.col("c") - F.col("u") * F.col("s")).alias("along"))


def hough_votes(edges: DataFrame) -> DataFrame:
    """frame_id, theta, rho, votes: the accumulator over edge pixels."""
    return _on_lines(edges).groupBy("frame_id", "theta", "rho").agg(F.count("*").alias("votes"))


def peaks(votes: DataFrame, threshold: int) -> DataFrame:
    """The cells of `threshold` votes or more that no neighbour in angle or distance exceeds; of equal neighbours the first stays."""
    much = votes.filter(F.col("votes") >= threshold)
    around = F.explode(F.array(*[F.struct((F.col("theta") + a).alias("theta"), (F.col("rho") + b).alias("rho"), F.lit((a, b) < (0, 0)).alias("first")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]))
    asks = much.select("frame_id", F.col("theta").alias("own_theta"), F.col("rho").alias("own_rho"), F.col("votes").alias("own"), around.alias("o")).select("frame_id", "own_theta", "own_rho", "own", "o.*")
    beaten = asks.join(much, ["frame_id", "theta", "rho"]).filter((F.col("votes") > F.col("own")) | (F.col("first") & (F.col("votes") == F.col("own"))))
    return much.join(beaten.select("frame_id", F.col("own_theta").alias("theta"), F.col("own_rho").alias("rho")).distinct(), ["frame_id", "theta", "rho"], "left_anti")


def segments(edges: DataFrame, threshold: int = 10, least: float = 10.0, gap: float = 10.0) -> DataFrame:
    """frame_id, theta, rho, x0, y0, x1, y1, n: along each peak line, the stretches of edge pixels without gaps of more
    than `gap`, of a length of `least` or more."""
    on = _on_lines(edges).join(peaks(hough_votes(edges), threshold).select("frame_id", "theta", "rho"), ["frame_id", "theta", "rho"])
    line = W.partitionBy("frame_id", "theta", "rho").orderBy("along", "u", "v")
    far = (F.col("along") - F.lag("along").over(line) > gap * MILLION).cast("int")
    parts = on.withColumn("far", F.coalesce(far, F.lit(0))).withColumn("part", F.sum("far").over(line))
    place = F.struct("along", "u", "v")
    ends = parts.groupBy("frame_id", "theta", "rho", "part").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("n"))
    length = F.sqrt(F.pow(F.col("b.u") - F.col("a.u"), 2) + F.pow(F.col("b.v") - F.col("a.v"), 2))
    return ends.filter(length >= least).select("frame_id", "theta", "rho", *[F.col(f"{p}.{c}").cast("double").alias(n) for p, c, n in (("a", "u", "x0"), ("a", "v", "y0"), ("b", "u", "x1"), ("b", "v", "y1"))], "n")


def detect_lines(image: DataFrame, size: tuple[int, int], detector: int = LSD, others: Mapping[int, Callable[[DataFrame], DataFrame]] | None = None, s: LineSettings = LineSettings()) -> DataFrame:
    """frame_id, x0, y0, x1, y1 by a detector: HOUGH is built in; LSD, EDL and FAST are functions of the image, given in
    `others`. A number that is none of the four means LSD."""
    detector = detector if detector in (LSD, EDL, FAST, HOUGH) else LSD
    if others and detector in others:
        return others[detector](image).select("frame_id", "x0", "y0", "x1", "y1")
    if detector != HOUGH:
        raise ValueError(f"no function for detector {detector} was given")
    edges = clustering.checkpointed(canny(image, size, s.canny_low, s.canny_high))
    return segments(edges, s.hough_threshold, s.hough_min_length, s.hough_max_gap).select("frame_id", "x0", "y0", "x1", "y1")
