"""Instance labels of 3-D lines by their type, from the labelled points beside them and beside their prolongations.

Lines have `keys` (frame_id among them), `type` (0 discontinuity, 1 on a plane, 2 edge, 3 intersection), sx .. ez and the
planes ra .. rd (right) and la .. ld (left), a side without a plane all 0. The cloud is frame_id, u, v, x, y, z; instances
are frame_id, u, v, label; both have a row a pixel, and a pixel without one has no point.

What a line of a type gets:

* discontinuity: the label of most points near its only plane, of the side where more of them lie (the right one, if
  equally many do).
* on a plane, intersection: of the most frequent labels of both sides, the one less frequent beside the line's
  prolongation at both ends (left, if equally frequent), unless its class is background: then the other.
* edge: what most of eleven points along the line see.

A strip's votes: to the right each point has one vote, and another when it is near the plane; to the left only points near the
plane have one, unless none is near: then all do. Of equally frequent labels the smallest wins; without votes it is 0.
Pieces that reach behind the camera have no strips."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linelake.functions import geometry as G
from linelake.operators import lines as L
from linelake.operators import pixels, votes
from linelake.operators.lifting import ENDS, FLAT, LEFT, RIGHT, Camera
from linelake.sources.settings import LineSettings

#: Where the strips lie: beside the line itself, before its start, past its end.
OWN, BEFORE, AFTER = 0, 1, 2


def pieces(lines: DataFrame, length: float) -> DataFrame:
    """lines with `piece`: each line itself, and for those on a plane and intersections its prolongations by length."""
    which = F.when(F.col("type").isin(1, 3), F.array(*map(F.lit, (OWN, BEFORE, AFTER)))).otherwise(F.array(F.lit(OWN)))
    rows = L.settled(lines, dict(zip(("_dx", "_dy", "_dz"), (G.end() - G.start()).unit().c))).withColumn("piece", F.explode(which))
    d, piece = G.Vec.of("_dx", "_dy", "_dz"), F.col("piece")
    a = (G.start() - d * length).when(piece == BEFORE, G.end().when(piece == AFTER, G.start()))
    b = G.start().when(piece == BEFORE, (G.end() + d * length).when(piece == AFTER, G.end()))
    return L.settled(rows, dict(zip(ENDS, (*a.c, *b.c)))).drop("_dx", "_dy", "_dz")


def none(names: tuple[str, ...]) -> Column:
    """Whether a plane is all 0."""
    return reduce(lambda x, y: x & y, [F.col(n) == 0 for n in names])


def strip_votes(lines: DataFrame, cloud: DataFrame, instances: DataFrame, keys: list[str], camera: Camera, size: tuple[int, int], s: LineSettings) -> DataFrame:
    """keys, piece, side (0 right, 1 left), label, n (points), near (of them, those near the plane that counts)."""
    (u0, v0), (u1, v1) = G.project(G.start(), *camera), G.project(G.end(), *camera)
    flat = L.settled(pieces(lines, s.extension_length).filter((F.col("sz") > 0) & (F.col("ez") > 0)), dict(zip(FLAT, (u0, v0, u1, v1))))
    flat = L.fit_to_bounds(flat.filter(~reduce(lambda a, b: a | b, [F.isnan(c) for c in FLAT])), *map(float, size))
    flat = flat.filter((F.col("x0") != F.col("x1")) | (F.col("y0") != F.col("y1")))
    strips = pixels.strip_pixels(flat, [*keys, "piece", "type", *RIGHT, *LEFT], *size, s.rectangle_offset, s.max_rect_size)
    seen = strips.hint("merge").join(cloud.filter(~F.isnan("x")), ["frame_id", "u", "v"]).join(instances.select("frame_id", "u", "v", "label"), ["frame_id", "u", "v"])
    p = G.Vec.of("x", "y", "z")
    right, left = (G.point_to_plane((G.Vec.of(*n[:3]), F.col(n[3])), p) for n in (RIGHT, LEFT))
    only = F.when(none(RIGHT), left).otherwise(right)
    far = F.when(F.col("type") == 0, only).when(F.col("side") == 0, right).otherwise(left)
    return seen.groupBy(*keys, "piece", "side", "label").agg(F.count("*").alias("n"), F.count_if(far < s.max_plane_error).alias("near"))


def _best(rows: str, votes_: str) -> str:
    """The label with most votes, as an expression over an array of rows; 0 without votes."""
    return f"coalesce(get(array_sort(transform(filter({rows}, x -> x.{votes_} > 0), x -> struct(-x.{votes_} as votes, x.label as label))), 0).label, 0L)"


def _sum(rows: str, value: str) -> str:
    return f"aggregate({rows}, 0L, (a, x) -> a + x.{value})"


def labels_by_type(lines: DataFrame, cloud: DataFrame, instances: DataFrame, classes: DataFrame, keys: list[str], camera: Camera, size: tuple[int, int], background: list[int], s: LineSettings = LineSettings()) -> DataFrame:
    """keys, label of each line. classes: label, class_id, a row a label of all frames, or with frame_id of each; a label
    without a class is no background. What is collected for a line are its votes by label, whose number its strips bound."""
    counted = strip_votes(lines.filter(F.col("type") != 2), cloud, instances, keys, camera, size, s)
    vote = F.struct("piece", "side", F.col("label").cast("long").alias("label"), "n", "near")
    held = lines.select(*keys, "type").filter(F.col("type") != 2).join(counted.groupBy(*keys).agg(F.collect_list(vote).alias("votes")), keys, "left")
    rows = held.withColumn("votes", F.coalesce("votes", F.expr("array()").cast("array<struct<piece: int, side: int, label: long, n: long, near: long>>")))
    # points near the left plane by piece: where there are none, all points vote
    for piece in (OWN, BEFORE, AFTER):
        rows = rows.withColumn(f"_left{piece}", F.expr(_sum(f"filter(votes, x -> x.piece = {piece} and x.side = 1)", "near")))
    left = "CASE x.piece WHEN 0 THEN _left0 WHEN 1 THEN _left1 ELSE _left2 END"
    own = f"CASE WHEN x.side = 0 THEN x.n + x.near WHEN ({left}) > 0 THEN x.near ELSE x.n END"
    rows = rows.withColumn("votes", F.expr(f"transform(votes, x -> struct(x.piece, x.side, x.label, x.near, {own} as votes))"))
    side = lambda k: f"filter(votes, x -> x.piece = {OWN} and x.side = {k})"
    rows = rows.withColumns({"_near0": F.expr(_sum(side(0), "near")), "_near1": F.expr(_sum(side(1), "near")), "_right": F.expr(_best(side(0), "votes")), "_left": F.expr(_best(side(1), "votes"))})
    rows = rows.withColumn("_jump", F.expr(f"CASE WHEN _near1 > _near0 THEN {_best(side(1), 'near')} ELSE {_best(side(0), 'near')} END"))
    beyond = lambda of: F.expr(_sum(f"filter(votes, x -> x.piece <> {OWN} and x.label = {of})", "votes"))
    rows = rows.withColumns({"_n0": beyond("_right"), "_n1": beyond("_left")})
    fewer, other = F.when(F.col("_n0") < F.col("_n1"), F.col("_right")).otherwise(F.col("_left")), F.when(F.col("_n0") < F.col("_n1"), F.col("_left")).otherwise(F.col("_right"))
    on = ["frame_id", "label"] if "frame_id" in classes.columns else ["label"]
    named = rows.withColumns({"label": fewer, "_other": other}).join(classes.select(*on, "class_id"), on, "left")
    behind = F.coalesce(F.col("class_id").isin(background), F.lit(False))
    label = F.when(F.col("type") == 0, F.col("_jump")).otherwise(F.when(behind, F.col("_other")).otherwise(F.col("label")))
    edges = votes.sampled_labels(lines.filter(F.col("type") == 2), instances, keys, camera, size)
    return named.select(*keys, label.cast("long").alias("label")).unionByName(edges.select(*keys, F.col("label").cast("long").alias("label")))
