"""Line, pixel, point, tick and path tables made from generic tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FIELDS = [f"{p}{c}" for p in ("s", "e", "n1", "n2") for c in "xyz"]
DIM = 64
GEOMETRY = _FIELDS[:6]


class Carriers:
    """Lazy views over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def line(self) -> DataFrame:
        e = F.col("embedding")
        i = F.col("vec_id")
        return self.table("embeddings").select(
            i.alias("line_id"), F.floor(i / 25).alias("frame_id"), F.floor(i / 100).alias("scene_id"), (F.floor(i / 100) % 3).alias("floor_id"), (i % 4).alias("type"),
            F.col("label"), F.col("label").alias("class_id"), *[F.get(e, F.lit(k)).cast("double").alias(n) for k, n in enumerate(_FIELDS)], (F.get(e, F.lit(12)) > 0).alias("open1"), "embedding",
        )

    @cached_property
    def px(self) -> DataFrame:
        """Lines in pixels of a 320 x 240 image."""
        return self.line.select("line_id", "frame_id", (F.col("sx") * 320 + 160).alias("x0"), (F.col("sy") * 240 + 120).alias("y0"), (F.col("ex") * 320 + 160).alias("x1"), (F.col("ey") * 240 + 120).alias("y1"))

    def _pairs(self, df: DataFrame, columns: list[str]) -> DataFrame:
        a = df.select("frame_id", F.col("line_id").alias("id1"), *[F.col(c).alias("a" + c) for c in columns])
        b = df.select("frame_id", F.col("line_id").alias("id2"), *[F.col(c).alias("b" + c) for c in columns])
        return a.join(b, "frame_id").filter("id1 < id2")

    @cached_property
    def pair(self) -> DataFrame:
        """Pairs of lines of a frame."""
        return self._pairs(self.line, GEOMETRY)

    @cached_property
    def px_pair(self) -> DataFrame:
        return self._pairs(self.px, ["x0", "y0", "x1", "y1"])

    @cached_property
    def point(self) -> DataFrame:
        return self.table("lineitem").select(
            (F.col("l_orderkey") % 64).alias("frame_id"), (F.col("l_partkey") % 320).alias("u"), (F.col("l_suppkey") % 240).alias("v"), F.col("l_quantity").alias("z"),
            (F.col("l_suppkey") % 16).alias("instance"), F.col("l_linenumber").cast("long").alias("class_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("price"),
        )

    @cached_property
    def tick(self) -> DataFrame:
        return self.table("events").select("event_id", "user_id", F.col("event_type").alias("topic"), "ts", F.date_trunc("hour", "ts").alias("stamp"), "value")

    @cached_property
    def path(self) -> DataFrame:
        return self.table("pages").select("page_id", "url")


PID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price"]

LINE = f"""v_line AS (SELECT vec_id AS line_id, vec_id // 25 AS frame_id, vec_id // 100 AS scene_id, (vec_id // 100) % 3 AS floor_id, vec_id % 4 AS type, label, label AS class_id,
 {", ".join(f"embedding[{k + 1}]::DOUBLE AS {n}" for k, n in enumerate(_FIELDS))}, embedding[13] > 0 AS open1, embedding FROM embeddings)"""
PX = LINE + ", v_px AS (SELECT line_id, frame_id, sx * 320 + 160 AS x0, sy * 240 + 120 AS y0, ex * 320 + 160 AS x1, ey * 240 + 120 AS y1 FROM v_line)"


def _pair_sql(name: str, of: str, columns: list[str]) -> str:
    own = ", ".join([*(f"a.{c} AS a{c}" for c in columns), *(f"b.{c} AS b{c}" for c in columns)])
    return f"{name} AS (SELECT a.frame_id, a.line_id AS id1, b.line_id AS id2, {own} FROM {of} a JOIN {of} b ON a.frame_id = b.frame_id AND a.line_id < b.line_id)"


PAIR = LINE + ", " + _pair_sql("v_pair", "v_line", GEOMETRY)
PX_PAIR = PX + ", " + _pair_sql("v_px_pair", "v_px", ["x0", "y0", "x1", "y1"])
POINT = """v_point AS (SELECT l_orderkey % 64 AS frame_id, l_partkey % 320 AS u, l_suppkey % 240 AS v, l_quantity AS z, l_suppkey % 16 AS instance, l_linenumber::BIGINT AS class_id,
 l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS price FROM lineitem)"""
TICK = "v_tick AS (SELECT event_id, user_id, event_type AS topic, ts, date_trunc('hour', ts) AS stamp, value FROM events)"
