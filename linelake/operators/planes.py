"""Planes beside lines: fits, inliers, line types and extents, from points that are joined to lines by pixel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linelake.functions import geometry as G
from linelake.operators import lines as L
from linelake.operators.lines import beside


def fit_planes(points: DataFrame, keys: list[str], means: bool = False) -> DataFrame:
    """keys, a, b, c, d, n: the least-squares plane of each group of at least 3 points (z >= 0 side of the normal up);
    with `means` also mx, my, mz, the mean of its points. Covariances are partial sums on the cluster; only a 3 x 3
    matrix per group is decomposed."""
    xyz = ["x", "y", "z"]
    sums = [F.sum(F.col(i) * F.col(j)).alias(i + j) for k, i in enumerate(xyz) for j in xyz[k:]]
    total = points.filter(~F.isnan("x") & ~F.isnan("y") & ~F.isnan("z")).groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in xyz], *sums).filter("n >= 3")

    def solve(batches):
        for pdf in batches:
            n = pdf["n"].to_numpy(float)
            mean = pdf[xyz].to_numpy(float) / n[:, None]
            cov = np.empty((len(pdf), 3, 3))
            for k, i in enumerate(xyz):
                for m, j in enumerate(xyz):
                    cov[:, k, m] = pdf[min(i, j) + max(i, j)].to_numpy(float) / n - mean[:, k] * mean[:, m]
            normal = np.linalg.eigh(cov)[1][:, :, 0] if len(pdf) else np.zeros((0, 3))
            lead = np.take_along_axis(normal, np.argmax(np.abs(normal) > 1e-9, 1)[:, None], 1) if len(pdf) else normal[:, :1]
            normal = normal * np.where(lead < 0, -1, 1)
            out = pdf[keys].copy()
            out[["a", "b", "c"]] = normal
            out["d"] = -(normal * mean).sum(1)
            out["n"] = pdf["n"]
            if means:
                out[["mx", "my", "mz"]] = mean
            yield out

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in points.select(*keys).schema), "a double, b double, c double, d double, n long", *(["mx double, my double, mz double"] if means else [])])
    return total.mapInPandas(solve, schema)


def ransac(points: DataFrame, keys: list[str], rounds: int = 300, inlier: float = 0.005, least: int = 10, seed: int = 1, first: float = 0.1, gap: float | None = None, share: float = 0.0, stop: float = 0.8) -> DataFrame:
    """points of each group (those beside one side of a line) that lie on the plane through three of them with the most
    inliers, of the planes with at least `least`; a group without such a plane gives none. With a `gap` (0.05 in the
    reference) only planes count whose inliers are connected around their mean, as in votes.connected_around_mean;
    without it any do. A best plane of less than `share` of the points is none. Ends early above `stop` of them."""

    def connected(p: np.ndarray) -> bool:
        far = np.sort(np.linalg.norm(p - p.mean(0), axis=1))
        return gap is None or bool(far[0] <= first and (np.diff(far) <= gap).all())

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[["x", "y", "z"]].to_numpy(float)
        rng, best = np.random.default_rng(seed), np.zeros(len(p), bool)
        for _ in range(rounds if len(p) >= 3 else 0):
            a, b, c = p[rng.choice(len(p), 3, replace=False)]
            n = np.cross(b - a, c - a)
            size = np.linalg.norm(n)
            if size < 1e-12:
                continue
            inside = np.abs((p - a) @ (n / size)) < inlier
            if inside.sum() > best.sum() and inside.sum() >= least and connected(p[inside]):
                best = inside
                if best.sum() > stop * len(p):
                    break
        return pdf[best & (best.sum() >= share * len(p))]

    return points.groupBy(*keys).applyInPandas(one, points.schema)


def extents(points: DataFrame, lines: DataFrame, keys: list[str], least: int = 10) -> DataFrame:
    """The stretch of each line (keys, sx .. ez) that its points cover, from the least and greatest projections; lines
    of fewer than `least` points keep their ends."""
    a, b = G.start(), G.end()
    along = (G.Vec.of("x", "y", "z") - a).dot((b - a).unit())
    seen = beside(points, lines, keys).groupBy(*keys).agg(F.min(along).alias("low"), F.max(along).alias("high"), F.count("*").alias("n"))
    both = lines.join(seen, keys, "left")
    d, enough = (b - a).unit(), F.coalesce(F.col("n") >= least, F.lit(False))
    return both.select(*keys, *(a + d * F.col("low")).when(enough, a).aliased("sx", "sy", "sz"), *(a + d * F.col("high")).when(enough, b).aliased("ex", "ey", "ez"), F.coalesce("n", F.lit(0)).alias("n"))


def covered(points: DataFrame, lines: DataFrame, keys: list[str], within: float = 0.02, bins: int = 10) -> DataFrame:
    """first_bin, last_bin: the part of a line, in tenths, that has points within a distance; lines without any go."""
    a, b, p, n = G.start(), G.end(), G.Vec.of("x", "y", "z"), F.col("_n")
    # each step's values are worked out once: in one expression they would be repeated until it no longer compiles
    rows = L.settled(beside(points, lines, keys).select(*keys, *p.c, *a.c, *b.c), {"_n": (b - a).norm()})
    rows = L.settled(rows, dict(zip(("_dx", "_dy", "_dz"), (b - a).over(n).c)) | {"_across": (p - a).cross(p - b).norm()})
    rows = L.settled(rows, {"_t": (p - a).dot(G.Vec.of("_dx", "_dy", "_dz")), "_far": G.div(F.col("_across"), n)})
    near = L.settled(rows, {"_t": G.div(F.col("_t"), n)}).filter((F.col("_far") <= within) & (F.col("_t") >= 0) & (F.col("_t") <= 1))
    place = F.least(F.floor(F.col("_t") * bins), F.lit(bins - 1)).cast("int")
    return near.groupBy(*keys).agg(F.min(place).alias("first_bin"), F.max(place).alias("last_bin"), F.count("*").alias("n"))


def share_around_centre(points: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """share of a line's points between a quarter and three quarters of its length."""
    a, b = G.start(), G.end()
    t = G.div((G.Vec.of("x", "y", "z") - a).dot((b - a).unit()), (b - a).norm())
    return beside(points, lines, keys).groupBy(*keys).agg(F.avg(F.when((t > 0.25) & (t < 0.75), 1.0).otherwise(0.0)).alias("share"))


def convexity(points: DataFrame, keys: list[str], side: str, other: str) -> DataFrame:
    """Whether two planes meet convexly as seen from the origin: votes of the signed distances of each side's points
    from the other's plane (columns `side` 0 or 1 and `other`). Both sides in front: concave; both behind: convex;
    anything else: mixed."""
    front = lambda s: F.count_if((F.col(side) == s) & (F.col(other) > 0)) >= F.count_if((F.col(side) == s) & (F.col(other) <= 0))
    return points.groupBy(*keys).agg(front(0).alias("f0"), front(1).alias("f1")).select(*keys, F.when(F.col("f0") & F.col("f1"), "concave").when(~F.col("f0") & ~F.col("f1"), "convex").otherwise("mixed").alias("shape"))


def line_type(n_right: Column, n_left: Column, angle_cos: Column, gap: Column, least: int = 10, same: float = 0.95, jump: float = 0.1) -> Column:
    """0 discontinuity: one side has too few points, or the sides are a jump apart; 1 one plane; 2 two planes (edge or
    intersection, told apart by going past the ends: see extended_type); null: neither side has a plane."""
    right, left = n_right >= least, n_left >= least
    return F.when(~right & ~left, F.lit(None)).when(right != left, 0).when(gap > jump, 0).when(F.abs(angle_cos) > same, 1).otherwise(2).cast("int")


def extended_type(pattern: Column) -> Column:
    """Edge (2) or intersection (3) from which of the four prolonged strips still lie on their planes."""
    return F.when(pattern.isin("0000", "1111"), 2).otherwise(3)


def folded_pattern(pattern: Column) -> Column:
    """The least of a pattern of four strips and its mirrors: sides swapped, ends swapped, both."""
    at = lambda *i: F.concat(*[F.substring(pattern, k, 1) for k in i])
    return F.least(at(1, 2, 3, 4), at(2, 1, 4, 3), at(3, 4, 1, 2), at(4, 3, 2, 1))
