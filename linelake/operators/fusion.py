"""Lines of two maps of one place put together: coinciding ones found by an index, grouped, and fused.

Lines have a group (what the two maps have in common), a key and sx .. ez; fusing also reads both normals n1x .. n2z and
open1, open2. Lines of length 0 coincide with none. Groups come out as rows, so none is collected."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linelake.functions import geometry as G
from linelake.operators import clustering
from linelake.operators.lines import settled

ENDS = ("sx", "sy", "sz", "ex", "ey", "ez")


def _cells(spacing: Column, around: tuple[int, ...]) -> Column:
    """Grid cells (of twice the spacing) that hold points along the line, at most a spacing apart, and those around."""
    a, d = G.start(), G.end() - G.start()
    n = F.ceil(G.div(d.norm(), spacing)).cast("int")
    places = F.sequence(F.lit(0), n)

    def cell(i):
        p = a + d * G.div(i.cast("double"), F.greatest(n, F.lit(1)).cast("double"))
        return F.struct(*[F.floor(x / (spacing * 2)).cast("long").alias(c) for x, c in zip(p.c, "xyz")])

    near = [F.struct(*[F.lit(k).alias(c) for k, c in zip(x, "xyz")]) for x in itertools.product(around, repeat=3)]
    own = F.transform(places, cell)
    if len(near) == 1:
        return F.array_distinct(own)
    spread = F.transform(own, lambda c: F.transform(F.array(*near), lambda s: F.struct(*[(c[k] + s[k]).alias(k) for k in "xyz"])))
    return F.array_distinct(F.flatten(spread))


def coinciding(first: DataFrame, second: DataFrame, group: list[str], key: str, angle: float = 0.15, distance: float = 0.015) -> DataFrame:
    """group, id1 (of first), id2 (of second): the pairs that geometry.coincide finds, by an index.

    A line of the second map that coincides with one of the first has a point beside it, no further away than
    r = distance + sin(angle) * length. Lines of the second map are put into classes of length (powers of 2), each with
    its own r and a grid of cells of 2 r; they are met in the cells along themselves and around these, by the lines of
    the first map in the cells along themselves. A line has at most a few cells for each r that fits into it, so no pair outside
    common cells is formed. Lines of the first map are looked up once for each class that their group has."""
    least = math.floor(math.log2(max(distance, 1e-9)))
    lone = (G.end() - G.start()).norm() > 0
    size = F.greatest(F.ceil(F.log2((G.end() - G.start()).norm())), F.lit(least)).cast("int")
    r = lambda k: F.lit(distance) + math.sin(min(angle, math.pi / 2)) * F.pow(F.lit(2.0), k)
    one = first.filter(lone).select(*group, F.col(key).alias("id1"), *[F.col(c).alias(c) for c in ENDS])
    two = second.filter(lone).select(*group, F.col(key).alias("id2"), *ENDS).withColumn("class", size)
    met = two.withColumn("cell", F.explode(_cells(r(F.col("class")), (-1, 0, 1)))).select(*group, "class", "cell", "id2", *[F.col(c).alias("b" + c) for c in ENDS])
    asks = one.join(two.select(*group, "class").distinct(), group).withColumn("cell", F.explode(_cells(r(F.col("class")), (0,)))).select(*group, "class", "cell", "id1", *[F.col(c).alias("a" + c) for c in ENDS])
    pairs = asks.join(met, [*group, "class", "cell"])
    return pairs.filter(G.coincide(G.start("a"), G.end("a"), G.start("b"), G.end("b"), angle, distance)).select(*group, "id1", "id2").distinct()


def group_lines(first: DataFrame, second: DataFrame, group: list[str], key: str, angle: float = 0.15, distance: float = 0.015) -> DataFrame:
    """group, map (0 first, 1 second), key, member_of: lines that coincide, directly or through others, have the same
    member_of; so has no other line. It numbers a group's lines: twice the smallest key, one more if that is of the second map only."""
    edges = coinciding(first, second, group, key, angle, distance).select((F.col("id1") * 2).alias("u"), (F.col("id2") * 2 + 1).alias("v"))
    own = first.select(*group, F.lit(0).alias("map"), key).unionByName(second.select(*group, F.lit(1).alias("map"), key)).withColumn("node", F.col(key).cast("long") * 2 + F.col("map"))
    return own.join(clustering.components(edges, own.select("node").distinct()), "node").select(*group, "map", key, F.col("component").alias("member_of"))


def _none(v: G.Vec) -> Column:
    return (v.c[0] == 0) & (v.c[1] == 0) & (v.c[2] == 0)


def fused_normal(n1: G.Vec, n2: G.Vec, longer: Column, cosine: Column, angle: float) -> G.Vec:
    """One normal of two: the other where one is missing, their mean direction where they are near, else the longer line's."""
    near = cosine > math.cos(angle)
    kept = (n1 + n2).unit().when(near, n1.when(longer, n2))
    return n2.when(_none(n1), n1.when(_none(n2), kept))


def fused_lines(pairs: DataFrame, angle: float = 0.05, distance: float = 0.025, normal_angle: float = 0.1) -> DataFrame:
    """The pairs (columns a.. and b.. of two lines: asx .. aez, an1x .. an2z, aopen1, aopen2) that lie on one line, with
    fsx .. fez, fn1x .. fn2z, fopen1, fopen2: the first line, prolonged to an end of the second where that reaches past it. Distances
    and overlaps are measured with the first line's direction at its full length; openness stays the first line's. Each normal is fused with the
    other line's that is nearer to it than to its fellow, in the order of the tests: first with first, second with
    first, first with second, second with second; if none is near, the longer line's normals stay."""
    a0, a1, b0, b1 = G.start("a"), G.end("a"), G.start("b"), G.end("b")
    d1, d2 = a1 - a0, b1 - b0
    (l1, l2), rows = (F.col("_l1"), F.col("_l2")), pairs
    rows = settled(rows, {"_l1": d1.norm(), "_l2": d2.norm(), "_x3": d1.dot(b0 - a0), "_x4": d1.dot(b1 - a0), "_d3": d1.cross(b0 - a0).norm(), "_d4": d1.cross(b1 - a0).norm(), "_dd": F.abs(d1.dot(d2))})
    x3, x4 = F.col("_x3"), F.col("_x4")
    low, high = F.least(x3, x4), F.greatest(x3, x4)
    over = ((low < 0) & (high > 0)) | ((low > 0) & (low < l1))
    rows = rows.filter((l1 > 0) & (l2 > 0) & (F.col("_dd") > math.cos(angle) * l1 * l2) & (F.col("_d3") < distance) & (F.col("_d4") < distance) & over)
    new_start = b0.when((x3 < x4) & (x3 < 0), b1.when((x4 < x3) & (x4 < 0), a0))
    new_end = b1.when((x3 < x4) & (x3 >= 0) & (x4 > l1), b0.when((x4 < x3) & (x4 >= 0) & (x3 > l1), a1))
    n = {f"{p}{k}": G.Vec.of(*(f"{p}n{k}{c}" for c in "xyz")) for p in "ab" for k in "12"}
    rows = settled(rows, {f"_c{i}{j}": n[f"a{i}"].dot(n[f"b{j}"]) for i in "12" for j in "12"})
    c = {f"{i}{j}": F.col(f"_c{i}{j}") for i in "12" for j in "12"}
    least, longer = math.cos(normal_angle), l1 > l2
    fuse = lambda i, j: fused_normal(n[f"a{i}"], n[f"b{j}"], longer, c[f"{i}{j}"], normal_angle)
    first = n["a1"].when(longer, n["b1"])
    second = n["a2"].when(longer, n["b2"])
    for better, worse, one, two in (("22", "12", ("2", "2"), ("1", "1")), ("12", "22", ("1", "2"), ("2", "1")), ("21", "11", ("2", "1"), ("1", "2")), ("11", "21", ("1", "1"), ("2", "2"))):
        case = (c[better] > c[worse]) & (c[worse] > least)
        first, second = fuse(*one).when(case, first), fuse(*two).when(case, second)
    out = {f"f{k}": x for k, x in zip(ENDS, (*new_start.c, *new_end.c))} | {f"fn{k}{x}": v for k, own in (("1", first), ("2", second)) for x, v in zip("xyz", own.c)}
    rows = settled(rows, out)
    return rows.withColumns({"fopen1": F.col("aopen1"), "fopen2": F.col("aopen2")}).drop(*[x for x in rows.columns if x.startswith("_")])
