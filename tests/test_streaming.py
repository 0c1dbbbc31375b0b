"""Streams give what their batch forms give."""

import pytest
from pyspark.sql import functions as F

from linelake.streaming import topics


def run(spark, df, name):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return sorted(map(tuple, spark.table(name).collect()), key=str)


@pytest.fixture
def folder(spark, tmp_path):
    def make(df, name):
        df.coalesce(1).write.parquet(str(tmp_path / name))
        return spark.readStream.schema(df.schema).parquet(str(tmp_path / name)), df

    return make


def stamps(spark, name, seconds):
    return spark.createDataFrame([(s, i) for i, s in enumerate(seconds)], f"s long, {name} long").select(F.timestamp_seconds("s").alias("stamp"), name)


def test_sync(spark, folder):
    (a, a0), (b, b0) = folder(stamps(spark, "x", [1, 2, 3]), "a"), folder(stamps(spark, "y", [2, 3, 4]), "b")
    want = sorted(map(tuple, topics.sync_exact([a0, b0]).collect()), key=str)
    assert run(spark, topics.sync_exact([a, b]), "sync") == want and len(want) == 2


def test_frame_counter(spark, folder):
    df = spark.createDataFrame([(1, 5), (1, 6), (2, 1), (1, 9)], "scene_id long, stamp long")
    s, b = folder(df, "f")
    assert run(spark, topics.count_frames(s, step=3), "count") == sorted(map(tuple, topics.count_frames(b, step=3).collect()), key=str)


def test_previous_frame(spark, folder):
    df = spark.createDataFrame([(0, f, f * 10 + i, [float(i)]) for f in range(3) for i in range(2)], "scene_id long, frame_id long, line_id long, embedding array<float>")
    s, b = folder(df, "p")
    cols = ["frame_id", "line_id", "prev_line_id"]
    want = sorted(map(tuple, topics.with_previous(b).select(*cols).collect()), key=str)
    assert run(spark, topics.with_previous(s).select(*cols), "prev") == want and len(want) == 8


def test_histogram_waits_for_all_frames(spark):
    df = spark.createDataFrame([(n, 0.01 * n) for n in range(4)], "number int, length double")
    assert topics.histogram_when_full(topics.full_histogram(df, 4), 4).count() > 0
    assert topics.histogram_when_full(topics.full_histogram(df.filter("number < 3"), 4), 4).count() == 0
