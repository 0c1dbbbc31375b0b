"""Queries of the relational operators (matching, votes, scores, pixels, clusters, streams) over the carriers."""

from __future__ import annotations

from pyspark.sql import functions as F

from linelake.functions import geometry as G
from linelake.functions import vectors as V
from linelake.operators import clustering, matching, metrics, pixels, planes, votes
from linelake.plans.carriers import DIM, LINE, PAIR, PID, POINT, PX, TICK, Carriers
from linelake.plans.geometry_queries import micro
from linelake.sources import frames as S
from linelake.streaming import topics

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Carriers(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


# matching

_sum = lambda term: " + ".join(term(f"a.embedding[{i}]::DOUBLE", f"b.embedding[{i}]::DOUBLE") for i in range(1, DIM + 1))
_sq = _sum(lambda x, y: f"({x} - {y}) * ({x} - {y})")
_l1 = _sum(lambda x, y: f"abs({x} - {y})")


def _match(distance: str, rating: str, most: float) -> str:
    return f"{LINE}, d AS (SELECT a.frame_id AS f1, b.frame_id AS f2, a.line_id AS id1, b.line_id AS id2, {distance} AS d FROM v_line a JOIN v_line b ON b.frame_id = a.frame_id + 1), m AS (SELECT f1, f2, id1, id2, {rating} AS rating FROM d WHERE d <= {most})"


EUCLID, MANHATTAN = _match(_sq, "sqrt(d)", 100.0), _match(_l1, "d", 64.0)


def _found(c: Carriers, method: str = "euclidean"):
    return matching.candidates(c.line, matching.frame_pairs(c.line), method, dim=DIM)


@query("match_nbest", f"WITH {EUCLID} SELECT f1, f2, id1, id2, rating, row_number() OVER w AS rank FROM m WINDOW w AS (PARTITION BY f1, f2, id1 ORDER BY rating, id2) QUALIFY rank <= 3")
def match_nbest(c):
    return matching.n_best(_found(c), 3).withColumn("rank", F.col("rank").cast("long"))


@query("match_manhattan", f"WITH {MANHATTAN} SELECT f1, f2, id1, id2, rating, row_number() OVER w AS rank FROM m WINDOW w AS (PARTITION BY f1, f2, id1 ORDER BY rating, id2) QUALIFY rank <= 2")
def _(c):
    return matching.n_best(_found(c, "manhattan"), 2).withColumn("rank", F.col("rank").cast("long"))


@query("match_best_ratio", f"WITH {EUCLID}, t AS (SELECT *, row_number() OVER w AS r, lead(rating) OVER w AS nxt FROM m WINDOW w AS (PARTITION BY f1, f2, id1 ORDER BY rating, id2)) SELECT f1, f2, id1, id2, rating FROM t WHERE r = 1 AND (nxt IS NULL OR rating / nxt < 0.97)")
def _(c):
    return matching.best_by_ratio(_found(c), 0.97)


@query("match_greedy", f"WITH RECURSIVE {EUCLID}, o AS (SELECT *, row_number() OVER (PARTITION BY f1 ORDER BY rating, id1, id2) AS k FROM m), g(f1, f2, k, id1, id2, rating, used1, used2) AS (SELECT f1, f2, k, id1, id2, rating, [id1], [id2] FROM o WHERE k = 1 UNION ALL SELECT n.f1, n.f2, n.k, n.id1, n.id2, n.rating, list_append(g.used1, n.id1), list_append(g.used2, n.id2) FROM g JOIN LATERAL (SELECT * FROM o WHERE o.f1 = g.f1 AND o.k > g.k AND NOT list_contains(g.used1, o.id1) AND NOT list_contains(g.used2, o.id2) ORDER BY o.k LIMIT 1) n ON true) SELECT f1, f2, id1, id2, rating FROM g")
def _(c):
    return matching.greedy(_found(c))


@query("match_greedy_in_frames")
def _(c):
    return matching.greedy_in_frames(_found(c))


@query("match_previous_frame", f"WITH {LINE} SELECT b.scene_id, b.frame_id, b.line_id, a.line_id AS prev_line_id FROM v_line a JOIN v_line b ON b.frame_id = a.frame_id + 1 AND a.scene_id = b.scene_id")
def _(c):
    return topics.with_previous(c.line).drop("embedding", "prev_embedding")


@query("bounded_queue", f"WITH {LINE} SELECT frame_id, line_id, row_number() OVER (PARTITION BY frame_id ORDER BY sx DESC, line_id) AS rank FROM v_line QUALIFY rank <= 4")
def _(c):
    return matching.bounded_queue(c.line.select("frame_id", "line_id", "sx"), ["frame_id"], "sx", "line_id", 4, False).select("frame_id", "line_id", F.col("rank").cast("long").alias("rank"))


# place recognition

_knn = f"{LINE}, d AS (SELECT a.line_id AS id1, a.frame_id AS frame1, a.floor_id AS floor1, b.line_id AS id2, b.frame_id AS frame2, b.floor_id AS floor2, {_sq} AS d2 FROM v_line a CROSS JOIN v_line b), p AS (SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY d2, id2) AS place FROM d QUALIFY place <= 9), n AS (SELECT id1, frame1, floor1, id2, floor2, d2, row_number() OVER (PARTITION BY id1 ORDER BY d2, id2) AS rank FROM p WHERE frame1 <> frame2 QUALIFY rank <= 4)"
_vote = _knn + ", v AS (SELECT frame1, floor1, floor2, count(*) AS n, min(id1 * 100 + rank) AS first FROM n GROUP BY ALL), w AS (SELECT frame1, floor1, floor2 AS voted, sum(n) OVER (PARTITION BY frame1) AS total, row_number() OVER (PARTITION BY frame1 ORDER BY n DESC, first) AS r FROM v)"


def _near(c: Carriers):
    return matching.nearest_elsewhere(c.line, 4, DIM)


@query("knn_elsewhere", f"WITH {_knn} SELECT id1, id2, rank FROM n")
def _(c):
    return _near(c).select("id1", "id2", F.col("rank").cast("long").alias("rank"))


@query("knn_vote", f"WITH {_vote} SELECT frame1, voted, total::BIGINT AS n_matches FROM w WHERE r = 1")
def _(c):
    return votes.vote_floor(_near(c))


@query("place_recognition", f"WITH {_vote} SELECT count(*) AS n_frames, count_if(voted = floor1) AS n_right, count_if(voted = floor1) / count(*) AS ratio FROM w WHERE r = 1")
def place_recognition(c):
    voted = votes.vote_floor(_near(c), also=("floor1",))
    right = F.count_if(F.col("voted") == F.col("floor1"))
    return voted.agg(F.count("*").alias("n_frames"), right.alias("n_right"), F.try_divide(right, F.count("*")).alias("ratio"))


@query("first_elsewhere", f"WITH {_knn} SELECT id1, id2 FROM p WHERE frame1 <> frame2 AND place <= 3 QUALIFY row_number() OVER (PARTITION BY id1 ORDER BY place) = 1")
def _(c):
    return matching.nearest_elsewhere(c.line, 1, DIM).select("id1", "id2")


# votes and counts


@query("majority_label", f"WITH {POINT}, n AS (SELECT frame_id, u, class_id, count(*) AS n FROM v_point GROUP BY ALL) SELECT frame_id, u, class_id, total::BIGINT AS votes FROM (SELECT *, sum(n) OVER (PARTITION BY frame_id, u) AS total, row_number() OVER (PARTITION BY frame_id, u ORDER BY n DESC, class_id) AS r FROM n) WHERE r = 1")
def _(c):
    return votes.majority(c.point, ["frame_id", "u"], "class_id")


@query("count_label", f"WITH {POINT} SELECT frame_id, count_if(class_id = 3) AS n FROM v_point GROUP BY ALL")
def _(c):
    return c.point.groupBy("frame_id").agg(F.count_if(F.col("class_id") == 3).alias("n"))


@query("first_class", f"WITH {POINT} SELECT frame_id, instance, class_id FROM v_point QUALIFY row_number() OVER (PARTITION BY frame_id, instance ORDER BY v * 320 + u, {', '.join(PID)}) = 1")
def _(c):
    return votes.first_by(c.point, ["frame_id", "instance"], "class_id", F.col("v") * 320 + F.col("u"), *PID)


@query("mean_point", f"WITH {POINT} SELECT frame_id, instance, round(sum(u)::DOUBLE / count(*), 6) AS u, round(sum(v)::DOUBLE / count(*), 6) AS v FROM v_point GROUP BY ALL")
def _(c):
    return c.point.groupBy("frame_id", "instance").agg(F.round(F.sum("u").cast("double") / F.count("*"), 6).alias("u"), F.round(F.sum("v").cast("double") / F.count("*"), 6).alias("v"))


@query("count_by_type", f"WITH {LINE} SELECT frame_id, count_if(type = 0) AS t0, count_if(type = 1) AS t1, count_if(type = 2) AS t2, count_if(type = 3) AS t3 FROM v_line GROUP BY ALL")
def _(c):
    return c.line.groupBy("frame_id").agg(*[F.count_if(F.col("type") == t).alias(f"t{t}") for t in range(4)])


@query("padded_labels", f"WITH {LINE}, t AS (SELECT frame_id, list_sort(list_distinct(list(label))) AS l FROM v_line GROUP BY ALL) SELECT frame_id, array_to_string(list_concat(l, [-1, -1, -1, -1, -1, -1])[1:6], ',') AS labels, len(l)::BIGINT AS n FROM t")
def _(c):
    return votes.padded_labels(c.line, ["frame_id"], "label", 6).select("frame_id", F.concat_ws(",", F.transform("labels", lambda x: x.cast("string"))).alias("labels"), "n")


@query("valid_frames", f"WITH {LINE}, t AS (SELECT frame_id, label, count(*) AS n FROM v_line GROUP BY ALL) SELECT frame_id, sum(n)::BIGINT AS n_lines, count_if(label NOT IN (0, 9) AND n >= 3) AS n_clusters FROM t GROUP BY ALL HAVING sum(n) > 20 AND n_clusters >= 1")
def _(c):
    return votes.valid_frames(c.line, ["frame_id"], "label", F.col("label").isin(0, 9), 20, 3)


@query("top_clusters", f"WITH {LINE}, t AS (SELECT frame_id, label, row_number() OVER (PARTITION BY frame_id ORDER BY count(*) DESC, label) AS r FROM v_line GROUP BY frame_id, label) SELECT l.line_id FROM v_line l JOIN t USING (frame_id, label) WHERE r <= 3")
def _(c):
    return votes.keep_top_labels(c.line, ["frame_id"], "label", 3).select("line_id")


@query("compact_labels", f"WITH {LINE} SELECT line_id, CASE WHEN label IN (0, 9) THEN 0 ELSE dense_rank() OVER (PARTITION BY frame_id, label IN (0, 9) ORDER BY label) END AS label_id FROM v_line")
def _(c):
    return votes.compact_labels(c.line, ["frame_id"], "label", F.col("label").isin(0, 9)).select("line_id", F.col("label_id").cast("long").alias("label_id"))


@query("dense_instances", f"WITH {POINT}, t AS (SELECT DISTINCT frame_id, class_id % 4 AS class_id, instance FROM v_point) SELECT frame_id, class_id, instance, CASE WHEN class_id = 0 THEN 0 ELSE row_number() OVER (PARTITION BY frame_id, class_id = 0 ORDER BY class_id, instance) END AS instance_id FROM t")
def _(c):
    df = c.point.select("frame_id", (F.col("class_id") % 4).alias("class_id"), "instance").distinct()
    return votes.dense_instances(df, ["frame_id"], "class_id", "instance").select("frame_id", "class_id", "instance", F.col("instance_id").cast("long").alias("instance_id"))


@query("non_background", f"WITH {LINE} SELECT line_id FROM v_line WHERE label NOT IN (0, 9)")
def _(c):
    return c.line.filter(~F.col("label").isin(0, 9)).select("line_id")


@query("other_floors", f"WITH {LINE}, s AS (SELECT DISTINCT scene_id, floor_id FROM v_line) SELECT a.scene_id, b.scene_id AS other FROM s a JOIN s b ON a.floor_id <> b.floor_id")
def _(c):
    s = c.line.select("scene_id", "floor_id").distinct()
    floors = [x.floor_id for x in s.select("floor_id").distinct().collect()]  # about a thousand at most
    asks = s.withColumn("f2", F.explode(F.array(*map(F.lit, floors)))).filter("f2 <> floor_id")
    return asks.join(s.select(F.col("scene_id").alias("other"), F.col("floor_id").alias("f2")), "f2").select("scene_id", "other")


@query("sample_n", f"WITH {LINE} SELECT frame_id, line_id FROM v_line QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY line_id * 7919 % 1009, line_id) <= 5")
def _(c):
    return votes.sample_n(c.line, ["frame_id"], F.col("line_id") * 7919 % 1009, "line_id", 5).select("frame_id", "line_id")


@query("triplets", f"WITH {LINE}, p AS (SELECT a.line_id AS anchor, b.line_id AS positive FROM v_line a JOIN v_line b ON a.label = b.label AND a.scene_id = b.scene_id AND a.frame_id <> b.frame_id QUALIFY row_number() OVER (PARTITION BY a.line_id ORDER BY b.line_id * 7919 % 1009, b.line_id) = 1), n AS (SELECT a.line_id AS anchor, b.line_id AS negative FROM v_line a JOIN v_line b ON a.floor_id <> b.floor_id AND a.class_id = b.class_id QUALIFY row_number() OVER (PARTITION BY a.line_id ORDER BY b.line_id * 7919 % 1009, b.line_id) = 1) SELECT anchor, positive, negative FROM p JOIN n USING (anchor)")
def _(c):
    order = F.struct(F.col("other") * 7919 % 1009, "other")
    a = c.line.select(F.col("line_id").alias("anchor"), "label", "class_id", "scene_id", "floor_id", "frame_id")
    b = c.line.withColumnRenamed("line_id", "other")
    pos = votes.first_of_others(a, b, "anchor", ["label", "scene_id"], "frame_id", "other", order).withColumnRenamed("other", "positive")
    neg = votes.first_of_others(a, b, "anchor", ["class_id"], "floor_id", "other", order).withColumnRenamed("other", "negative")
    return pos.join(neg, "anchor")


@query("rating_filter", f"WITH {LINE} SELECT line_id FROM v_line WHERE abs(sx) * 1e7 <= 1e6")
def _(c):
    return c.line.filter(F.abs("sx") * 1e7 <= 1e6).select("line_id")


@query("images_present", f"WITH {LINE} SELECT line_id FROM v_line WHERE EXISTS (SELECT 1 FROM pages WHERE page_id = line_id AND contains(url, '/en/'))")
def _(c):
    return c.line.join(c.path.filter(F.col("url").contains("/en/")), F.col("line_id") == F.col("page_id"), "left_semi").select("line_id")


@query("not_downloaded", "SELECT page_id FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels) ORDER BY page_id LIMIT 50")
def _(c):
    from linelake.sources.line_files import not_yet

    return not_yet(c.path.select("page_id"), c.table("labels").select(F.col("doc_id").alias("page_id")), "page_id", 50)


# pixels and points


@query("z_buffer", f"WITH {POINT} SELECT frame_id, u, v, z, class_id, n_points FROM (SELECT *, count(*) OVER (PARTITION BY frame_id, u, v) AS n_points, row_number() OVER (PARTITION BY frame_id, u, v ORDER BY z, {', '.join(PID)}) AS r FROM v_point WHERE z > 0) WHERE r = 1")
def _(c):
    return votes.z_buffer(c.point, ["frame_id", "u", "v"], "z", ["class_id"], PID)


@query("pixel_occupancy", f"WITH {POINT} SELECT frame_id, count(DISTINCT u * 1000 + v) AS n FROM v_point WHERE u >= 8 AND u < 312 AND v >= 8 AND v < 232 GROUP BY ALL")
def _(c):
    return S.cropped(c.point, 8, 320, 240).groupBy("frame_id").agg(F.count_distinct(F.col("u") * 1000 + F.col("v")).alias("n"))


@query("zero_depth", f"WITH {POINT} SELECT frame_id, instance, count(*) AS n FROM v_point GROUP BY ALL HAVING NOT bool_or(z = 1)")
def _(c):
    return c.point.groupBy("frame_id", "instance").agg(F.count("*").alias("n"), F.bool_or(F.col("z") == 1).alias("bad")).filter("not bad").drop("bad")


@query("gap_connected", f"WITH {POINT}, s AS (SELECT frame_id, instance, z, z - lag(z) OVER (PARTITION BY frame_id, instance ORDER BY z) AS step FROM v_point) SELECT frame_id, instance, min(z) <= 2 AND coalesce(bool_and(step <= 2), true) AS connected FROM s GROUP BY ALL")
def _(c):
    return votes.connected_around_mean(c.point, ["frame_id", "instance"], "z", 2.0, 2.0)


@query("strip_inliers")
def _(c):
    lines = c.px.select("frame_id", "line_id", "x0", "y0", "x1", "y1")
    near = pixels.strip_pixels(lines, ["frame_id", "line_id"], 320, 240)
    return near.join(c.point.select("frame_id", "u", "v", "z"), ["frame_id", "u", "v"]).groupBy("line_id", "side").agg(F.count("*").alias("n"))


def _strip_sql() -> str:
    return f"""WITH {PX}, {POINT}, n AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS n FROM v_px),
 j AS (SELECT l.line_id, l.n, ((p.u - x0) * (x1 - x0) + (p.v - y0) * (y1 - y0)) / (l.n * l.n) AS t, ((p.v - y0) * (x1 - x0) - (p.u - x0) * (y1 - y0)) / l.n AS off FROM n l JOIN v_point p ON p.frame_id = l.frame_id)
 SELECT line_id, CASE WHEN off > 0 THEN 1 ELSE 0 END AS side, count(*) AS n FROM j WHERE t >= 0 AND t <= 1 AND abs(off) >= 0.5 AND abs(off) <= least(5.0, n * 0.5) + 0.5 GROUP BY ALL"""


SQL["strip_inliers"] = _strip_sql()


@query("walk_ends")
def _(c):
    cloud = c.point.groupBy("frame_id", "u", "v").agg(F.min("z").alias("z")).withColumns({"x": F.col("u") * 1.0, "y": F.col("v") * 1.0})
    return pixels.lifted_ends(c.px, cloud, ["line_id"])


@query("shifted_best", f"WITH {LINE} SELECT frame_id, (CASE WHEN abs(sy) < abs(sx) AND abs(sy) <= abs(sz) THEN -1 WHEN abs(sz) < abs(sx) THEN 1 ELSE 0 END) AS shift, line_id FROM v_line")
def _(c):
    rated = c.line.select("frame_id", "line_id", F.explode(F.array(*[F.struct(F.lit(s).alias("shift"), F.abs(k).alias("rating")) for s, k in ((0, "sx"), (-1, "sy"), (1, "sz"))])).alias("r")).select("frame_id", "line_id", "r.*")
    return pixels.shifted_best(rated, ["frame_id", "line_id"]).drop("rating")


@query("fit_planes")
def _(c):
    return planes.fit_planes(c.point.select("frame_id", "instance", (F.col("u") / 320).alias("x"), (F.col("v") / 240).alias("y"), F.col("z").alias("z")), ["frame_id", "instance"])


@query("ransac")
def _(c):
    p = c.point.select("frame_id", (F.col("u") / 320).alias("x"), (F.col("v") / 240).alias("y"), F.when(F.col("class_id") < 5, 0.0).otherwise(F.col("z")).alias("z"))
    return planes.ransac(p, ["frame_id"], gap=0.05).groupBy("frame_id").agg(F.count("*").alias("n"))


@query("line_types", f"WITH {LINE} SELECT line_id, CASE WHEN label < 2 AND class_id < 1 THEN NULL WHEN (label >= 2) <> (label >= 4) THEN 0 WHEN abs(ex) > 0.1 THEN 0 WHEN abs(sx) > 0.95 THEN 1 WHEN label < 2 THEN NULL ELSE 2 END::INT AS kind FROM v_line")
def _(c):
    n = F.when(F.col("label") >= 2, 10).otherwise(0)
    m = F.when(F.col("label") >= 4, 10).otherwise(0)
    return c.line.select("line_id", planes.line_type(n, m, F.col("sx"), F.abs("ex")).alias("kind"))


SQL["line_types"] = f"WITH {LINE} SELECT line_id, CASE WHEN label < 2 THEN NULL WHEN label < 4 THEN 0 WHEN abs(ex) > 0.1 THEN 0 WHEN abs(sx) > 0.95 THEN 1 ELSE 2 END::INT AS kind FROM v_line"


@query("strip_patterns", f"WITH {LINE}, p AS (SELECT line_id, concat((sx > 0)::INT, (sy > 0)::INT, (sz > 0)::INT, (ex > 0)::INT) AS p FROM v_line) SELECT least(p, concat(p[2], p[1], p[4], p[3]), concat(p[3], p[4], p[1], p[2]), concat(p[4], p[3], p[2], p[1])) AS pattern, count(*) AS n, min(CASE WHEN p IN ('0000', '1111') THEN 2 ELSE 3 END) AS kind FROM p GROUP BY 1")
def _(c):
    p = F.concat(*[(F.col(k) > 0).cast("int").cast("string") for k in ("sx", "sy", "sz", "ex")])
    return c.line.select(p.alias("p")).groupBy(planes.folded_pattern(F.col("p")).alias("pattern")).agg(F.count("*").alias("n"), F.min(planes.extended_type(F.col("p"))).alias("kind"))


@query("convexity", f"WITH {LINE} SELECT frame_id, CASE WHEN a AND b THEN 'concave' WHEN NOT a AND NOT b THEN 'convex' ELSE 'mixed' END AS shape FROM (SELECT frame_id, count_if(type < 2 AND sx > 0) >= count_if(type < 2 AND sx <= 0) AS a, count_if(type >= 2 AND sx > 0) >= count_if(type >= 2 AND sx <= 0) AS b FROM v_line GROUP BY ALL)")
def _(c):
    return planes.convexity(c.line.withColumn("side", F.when(F.col("type") < 2, 0).otherwise(1)), ["frame_id"], "side", "sx")


@query("line_open", f"WITH {LINE} SELECT line_id, ex = 0 OR sx - ex > 0.1 AS open FROM v_line")
def _(c):
    return c.line.select("line_id", pixels.line_open(F.col("sx"), F.col("ex")).alias("open"))


# histograms and scores

_len = "sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy) + (ez - sz) * (ez - sz))"


@query("length_histogram", f"WITH {LINE}, l AS (SELECT {_len} AS n FROM v_line), e AS (SELECT min(n) - 0.02 / 2 AS low, max(n) + 0.02 / 2 AS high FROM l), b AS (SELECT n, low, greatest(ceil((high - low) / 0.02) - 1, 1) AS bins FROM l, e), p AS (SELECT CASE WHEN n = low + bins * 0.02 THEN bins - 1 ELSE floor((n - low) / 0.02) END AS bin, bins FROM b) SELECT bin::BIGINT AS bin, count(*) AS n, count(*) / (sum(count(*)) OVER () * 0.02) AS density FROM p WHERE bin < bins GROUP BY bin")
def _(c):
    return votes.length_histogram(c.line.select(G.length_of(G.start(), G.end()).alias("n")), "n", 0.02)


@query("bow_histogram", f"WITH {LINE} SELECT frame_id, array_to_string([{', '.join(f'count_if(label = {i})' for i in range(12))}], ',') AS counts FROM v_line GROUP BY ALL")
def _(c):
    return votes.histogram(c.line, ["frame_id"], "label", 12).select("frame_id", F.concat_ws(",", F.transform("counts", lambda x: x.cast("string"))).alias("counts"))


_c = f"{LINE}, c AS (SELECT label AS a, (frame_id % 7)::INT AS b, count(*) AS n FROM v_line GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM c)"


@query("nmi", f"WITH {_c} SELECT round((SELECT sum(n / t * ln(n * t / (na * nb))) FROM s) / (((SELECT -sum(p * ln(p)) FROM (SELECT DISTINCT a, na / t AS p FROM s)) + (SELECT -sum(p * ln(p)) FROM (SELECT DISTINCT b, nb / t AS p FROM s))) / 2), 6) AS nmi")
def _(c):
    return metrics.nmi(c.line.withColumn("g", F.col("frame_id") % 7), "label", "g").select(F.round("nmi", 6).alias("nmi"))


@query("iou", f"WITH {LINE}, c AS (SELECT frame_id, label AS a, type AS b, count(*) AS n FROM v_line GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY frame_id, a) AS na, sum(n) OVER (PARTITION BY frame_id, b) AS nb FROM c), m AS (SELECT frame_id, a, max(n / (na + nb - n)) AS best FROM s GROUP BY ALL) SELECT frame_id, round(sum(best) / count(*), 6) AS iou, count(*) AS n_clusters FROM m GROUP BY ALL")
def _(c):
    return metrics.iou(c.line, "label", "type", ["frame_id"]).withColumn("iou", F.round("iou", 6))


@query("background_counts", f"WITH {LINE} SELECT count_if(label = 0 AND sx > 0) AS tp, count_if(label <> 0 AND sx > 0) AS fp, count_if((label = 0) = (sx > 0)) AS \"right\" FROM v_line")
def _(c):
    return metrics.background_counts(c.line, F.col("label") == 0, F.col("sx") > 0)


@query("summary", f"WITH {LINE} SELECT round(sum(sx), 6) AS sum, round(sum(abs(sx)), 6) AS l1, round(stddev_pop(sx), 6) AS std, max(sx) AS max, min(sx) AS min FROM v_line")
def _(c):
    return metrics.summary(c.line, "sx").withColumns({k: F.round(k, 6) for k in ("sum", "l1", "std")})


@query("mean_zero", f"WITH {LINE} SELECT line_id, round(sx - avg(sx) OVER (PARTITION BY frame_id), 6) + 0.0 AS sx FROM v_line")
def _(c):
    return metrics.mean_zero(c.line, ["frame_id"], ["sx"]).select("line_id", (F.round("sx", 6) + 0.0).alias("sx"))


@query("triplet_loss", f"WITH {LINE} SELECT a.line_id, greatest(({_sq}) - ({_sq.replace('b.embedding', 'c.embedding')}) + 0.6, 0.0) AS loss FROM v_line a JOIN v_line b ON b.line_id = a.line_id + 1 JOIN v_line c ON c.line_id = a.line_id + 2")
def _(c):
    shifted = lambda n: c.line.select((F.col("line_id") - n).alias("line_id"), F.col("embedding").alias(f"v{n}"))
    df = c.line.select("line_id", F.col("embedding").alias("v0")).join(shifted(1), "line_id").join(shifted(2), "line_id")
    return df.select("line_id", V.triplet_loss(F.col("v0"), F.col("v1"), F.col("v2"), DIM).alias("loss"))


@query("silhouette", f"WITH {PAIR.replace('a.line_id < b.line_id', 'a.line_id <> b.line_id')}, d AS (SELECT id1, (SELECT label FROM v_line WHERE line_id = id1) AS c1, (SELECT label FROM v_line WHERE line_id = id2) AS c2, sqrt((asx - bsx) * (asx - bsx) + (asy - bsy) * (asy - bsy)) AS d FROM v_pair), m AS (SELECT id1, c1, c2, avg(d) AS d FROM d GROUP BY ALL), s AS (SELECT id1, max(CASE WHEN c1 = c2 THEN d END) AS a, min(CASE WHEN c1 <> c2 THEN d END) AS b FROM m GROUP BY ALL) SELECT id1, round(coalesce(CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) END, 0.0), 5) + 0.0 AS score FROM s")
def _(c):
    a = c.line.select("frame_id", F.col("line_id").alias("id1"), F.col("label").alias("c1"), F.col("sx").alias("x1"), F.col("sy").alias("y1"))
    b = c.line.select("frame_id", F.col("line_id").alias("id2"), F.col("label").alias("c2"), F.col("sx").alias("x2"), F.col("sy").alias("y2"))
    d = a.join(b, "frame_id").filter("id1 <> id2").withColumn("d", F.sqrt((F.col("x1") - F.col("x2")) ** 2 + (F.col("y1") - F.col("y2")) ** 2))
    return metrics.silhouette(d).withColumn("score", F.round("score", 5) + 0.0)


# clusters

_near3 = f"{LINE}, e AS (SELECT a.line_id AS u, b.line_id AS v FROM v_line a JOIN v_line b ON a.line_id < b.line_id AND (a.sx - b.sx) * (a.sx - b.sx) + (a.sy - b.sy) * (a.sy - b.sy) + (a.sz - b.sz) * (a.sz - b.sz) <= 0.04 * 0.04)"


@query("neighbours", f"WITH {_near3} SELECT u, v FROM e")
def _(c):
    return clustering.neighbours(c.line, "line_id", ["sx", "sy", "sz"], 0.04)


@query("components", f"WITH RECURSIVE {_near3}, b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e), r(node, m) AS (SELECT line_id, line_id FROM v_line UNION SELECT b.v, r.m FROM r JOIN b ON b.u = r.node WHERE r.m < b.v) SELECT node, min(m) AS component FROM r GROUP BY node")
def _(c):
    return clustering.components(clustering.neighbours(c.line, "line_id", ["sx", "sy", "sz"], 0.04), c.line.select(F.col("line_id").alias("node")))


@query("scaled_by_mean", f"WITH {LINE} SELECT line_id, round(sx / (SELECT avg(sx) FROM v_line), 5) AS sx FROM v_line")
def _(c):
    return clustering.scaled_by_mean(c.line.select("line_id", "sx"), ["sx"]).select("line_id", F.round("sx", 5).alias("sx"))


@query("kmeans")
def _(c):
    return clustering.kmeans(c.line.select("line_id", "sx", "sy", "sz"), ["sx", "sy", "sz"], 4).select("line_id", "cluster")


@query("kmedoids")
def _(c):
    a, b = c.line.select("frame_id", F.col("line_id").alias("id1"), F.col("sx").alias("x")), c.line.select("frame_id", F.col("line_id").alias("id2"), F.col("sx").alias("y"))
    return clustering.kmedoids(a.join(b, "frame_id").select("frame_id", "id1", "id2", F.abs(F.col("x") - F.col("y")).alias("d")), ["frame_id"], 3).select("id", "medoid")


@query("mean_shift")
def _(c):
    df = c.line.select("scene_id", "label", "line_id", "sx", "sy", "sz", G.length_of(G.start(), G.end()).alias("length"))
    return clustering.mean_shift(df, ["scene_id", "label"], ["sx", "sy", "sz"], "length", 0.2).select("line_id", "part")


@query("single_linkage")
def _(c):
    return clustering.single_linkage(c.line.select("frame_id", "line_id", "sx", "sy", "sz"), ["frame_id"], ["sx", "sy", "sz"]).select("line_id", "cluster")


@query("merge_lines")
def _(c):
    return clustering.merge_lines(c.px, ["frame_id"])


@query("fuse_groups")
def _(c):
    return clustering.fuse_groups(c.line, ["frame_id", "label"])


# frames and topics


@query("sync_exact", f"WITH {TICK}, s AS (SELECT stamp, topic FROM v_tick GROUP BY ALL), t AS (SELECT topic, row_number() OVER (ORDER BY topic) AS k FROM (SELECT DISTINCT topic FROM v_tick)) SELECT s.stamp FROM s JOIN t USING (topic) WHERE k <= 3 GROUP BY s.stamp HAVING count(*) = 3")
def _(c):
    names = [r[0] for r in c.tick.select("topic").distinct().orderBy("topic").limit(3).collect()]
    return topics.sync_exact([c.tick.filter(F.col("topic") == n).groupBy("stamp").agg(F.count("*").alias(f"n{i}")) for i, n in enumerate(names)]).select("stamp")


@query("sync_approximate", f"WITH {TICK}, t AS (SELECT topic, row_number() OVER (ORDER BY topic) AS k FROM (SELECT DISTINCT topic FROM v_tick)), a AS (SELECT event_id, epoch_us(ts) AS s FROM v_tick JOIN t USING (topic) WHERE k = 1), b AS (SELECT event_id AS other, epoch_us(ts) AS s2 FROM v_tick JOIN t USING (topic) WHERE k = 2) SELECT event_id, other FROM a JOIN b ON abs(s - s2) <= 60000000 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(s - s2), s2) = 1")
def _(c):
    first, second = (r[0] for r in c.tick.select("topic").distinct().orderBy("topic").limit(2).collect())
    us = F.unix_micros(F.col("ts").cast("timestamp")).cast("double")
    side = lambda n: c.tick.filter(F.col("topic") == n).select(F.lit(0).alias("scene_id"), us.alias("stamp"), "event_id")
    return S.approximately(side(first), side(second).withColumnRenamed("event_id", "other"), 6e7).select("event_id", "other")


@query("frame_counter", f"WITH {TICK} SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 2 AS number FROM v_tick")
def _(c):
    return topics.count_frames(c.tick.withColumn("at", F.struct("ts", "event_id")), "user_id", "at", 2).select("event_id", F.col("number").cast("long").alias("number"))


@query("first_frames", f"WITH {TICK} SELECT user_id, event_id FROM v_tick QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def _(c):
    return topics.first_frames(c.tick.withColumn("at", F.struct("ts", "event_id")), "user_id", "at").select("user_id", "event_id")


@query("pose_at_stamp", f"WITH {TICK}, p AS (SELECT stamp, min(value) AS x, count(*) AS n FROM v_tick WHERE event_id % 3 = 0 GROUP BY ALL) SELECT event_id, x, n FROM v_tick JOIN p USING (stamp)")
def _(c):
    poses = c.tick.filter("event_id % 3 = 0").groupBy("stamp").agg(F.min("value").alias("x"), F.count("*").alias("n"))
    return topics.with_pose(c.tick.select("event_id", "stamp"), poses).select("event_id", "x", "n")


@query("merged_maps", f"WITH {LINE}, f AS (SELECT DISTINCT floor_id, scene_id, frame_id FROM v_line) SELECT a.frame_id, b.frame_id AS twin FROM f a LEFT JOIN f b ON a.floor_id = b.floor_id AND a.scene_id = b.scene_id AND b.frame_id = a.frame_id + 1")
def _(c):
    f = c.line.select("floor_id", "scene_id", "frame_id").distinct()
    return f.join(f.select("floor_id", "scene_id", (F.col("frame_id") - 1).alias("frame_id"), F.col("frame_id").alias("twin")), ["floor_id", "scene_id", "frame_id"], "left").select("frame_id", "twin")


@query("class_of_instance", f"WITH {POINT}, m AS (SELECT frame_id, instance, class_id FROM v_point QUALIFY row_number() OVER (PARTITION BY frame_id, instance ORDER BY v * 320 + u, {', '.join(PID)}) = 1), {LINE} SELECT line_id, coalesce(m.class_id, 0) AS class_id FROM v_line l LEFT JOIN m ON m.frame_id = l.frame_id AND m.instance = l.label")
def _(c):
    m = votes.first_by(c.point, ["frame_id", "instance"], "class_id", F.col("v") * 320 + F.col("u"), *PID)
    return c.line.select("line_id", "frame_id", F.col("label").alias("instance")).join(m, ["frame_id", "instance"], "left").select("line_id", F.coalesce("class_id", F.lit(0)).alias("class_id"))


_nodes = f"{LINE}, p AS (SELECT a.line_id, a.frame_id, t.tree, (floor((a.line_id * (t.tree + 3)) % 16) / d.div)::INT + d.base AS node FROM v_line a, (SELECT unnest([0, 1, 2]) AS tree) t, (SELECT unnest([1, 2, 4]) AS div, unnest([100, 200, 300]) AS base) d)"


@query("tree_distance", f"WITH {_nodes} SELECT id1, id2, n / 3.0 AS d FROM (SELECT a.line_id AS id1, b.line_id AS id2, 18 - 2 * count(p2.node) AS n FROM v_line a JOIN v_line b ON a.frame_id = b.frame_id AND a.line_id < b.line_id JOIN p p1 ON p1.line_id = a.line_id LEFT JOIN p p2 ON p2.line_id = b.line_id AND p1.tree = p2.tree AND p1.node = p2.node GROUP BY ALL)")
def _(c):
    visit = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), ((F.col("line_id") * (t + 3)) % 16 / d).cast("int").alias("x"), F.lit(b).alias("base")) for t in range(3) for d, b in ((1, 100), (2, 200), (4, 300))]))
    v = c.line.select("frame_id", "line_id", visit.alias("n")).select("frame_id", "line_id", "n.tree", (F.col("n.x") + F.col("n.base")).alias("node"))
    a = v.withColumnRenamed("line_id", "id1")
    b = v.withColumnRenamed("line_id", "id2")
    both = a.join(b, ["frame_id", "tree", "node"]).filter("id1 < id2").groupBy("id1", "id2").agg(F.count("*").alias("same"))
    pairs = c.pair.select("id1", "id2").join(both, ["id1", "id2"], "left")
    return pairs.select("id1", "id2", ((18 - 2 * F.coalesce("same", F.lit(0))) / 3.0).cast("double").alias("d"))


SQL["tree_distance"] = SQL["tree_distance"].replace("n / 3.0 AS d", "n::DOUBLE / 3.0::DOUBLE AS d").replace("(floor((a.line_id * (t.tree + 3)) % 16) / d.div)::INT", "floor((a.line_id * (t.tree + 3)) % 16 / d.div)::INT")
