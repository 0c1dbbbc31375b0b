"""Streams over several micro-batches give what their batch forms give, late rows and restarts included."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from linelake.streaming import stateful, topics


@pytest.fixture
def files(spark, tmp_path):
    """A stream that reads one of the given lists of rows after the other, and all of them as a batch."""

    def make(name, lists, schema, later=()):
        folder = tmp_path / name
        for i, rows in enumerate(lists):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
            for f in glob.glob(str(folder / "part-*")):
                os.utime(f, (1_000_000 + i, 1_000_000 + i)) if os.path.getmtime(f) > 2_000_000 else None
        batch = spark.read.schema(schema).parquet(str(folder))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder)), batch

    return make


def run(spark, df, name, tmp_path, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    q.stop()
    return sorted(map(tuple, spark.table(name).collect()), key=str)


def times(df, *names):
    return df.withColumns({n: F.timestamp_seconds(n) for n in names})


def test_approximate_sync_over_batches(spark, files, tmp_path):
    a, a0 = files("a", [[(1, 10), (5, 11)], [(9, 12)], [(30, 13)]], "stamp long, x long")
    b, b0 = files("b", [[(2, 20)], [(8, 21), (10, 22)], [(40, 23)]], "stamp2 long, y long")
    make = lambda p, q: topics.sync_approximate(times(p, "stamp"), times(q, "stamp2"), "1 second", "1 minute")
    want = sorted(map(tuple, make(a0, b0).collect()), key=str)
    assert len(want) == 3 and run(spark, make(a, b), "near", tmp_path) == want


def test_first_frames_over_batches(spark, files, tmp_path):
    s, b = files("f", [[(1, 1, 7), (2, 2, 8)], [(1, 3, 9), (3, 4, 10)], [(2, 5, 11)]], "frame_id long, stamp long, x long")
    make = lambda d: topics.first_frames(times(d, "stamp"), late="1 hour")
    assert run(spark, make(s), "first", tmp_path) == sorted(map(tuple, make(b).collect()), key=str)


def test_latest_pose(spark, files, tmp_path):
    poses = [[(1, 100, 1.0), (1, 110, 2.0)], [(1, 104, 3.0), (2, 90, 9.0)], [(1, 7300, 4.0), (2, 7400, 5.0)]]
    messages = [[(1, 105, 1), (1, 99, 2)], [(1, 112, 3), (2, 100, 4), (3, 100, 5)], [(1, 7301, 6), (2, 7300, 7), (1, 7400, 8), (2, 7500, 9)]]
    m, m0 = files("m", messages, "scene_id long, stamp long, message_id long")
    p, p0 = files("p", poses, "scene_id long, stamp long, x double")
    batch = stateful.latest_pose(times(m0, "stamp"), times(p0, "stamp"), "scene_id", ["x"])
    got = {r.message_id: r.x for r in batch.collect()}
    assert got == {1: 3.0, 2: None, 3: 2.0, 4: 9.0, 5: None, 6: 4.0, 7: 9.0, 8: 4.0, 9: 5.0}
    out = run(spark, stateful.latest_pose_stream(times(m, "stamp"), times(p, "stamp"), "scene_id", ["x"], late="60 seconds"), "pose", tmp_path)
    found = {r[2]: r[3] for r in out}
    # the last messages wait for a watermark that no later row moves on
    assert set(found) >= {1, 2, 3, 4, 5, 6, 7} and all(found[k] == got[k] for k in found)
    assert len(out) == len(found)


def test_histogram_of_the_first_frames(spark, files, tmp_path):
    lists = [[(1, 1, [0.01, 0.03]), (2, 1, [0.5])], [(1, 2, [0.01]), (1, 3, [0.9])], [(2, 2, [0.01, 0.5]), (3, 9, [0.2])]]
    s, b = files("h", lists, "scene_id long, stamp long, lengths array<double>")
    want = sorted(map(tuple, stateful.first_frames_histogram(b, 2).collect()), key=str)
    assert want == [(1, 0, 2), (1, 1, 1), (2, 0, 1), (2, 25, 2)]
    assert run(spark, stateful.first_frames_histogram(s, 2), "hist", tmp_path) == want


def test_sink_repeats_no_row_after_a_restart(spark, files, tmp_path):
    s, b = files("k", [[(1, 1)], [(2, 2)], [(3, 3)]], "id long, x long")
    path, checkpoint = str(tmp_path / "out"), str(tmp_path / "check")

    def go():
        q = s.writeStream.foreachBatch(stateful.write_once(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination(90)
        q.stop()

    go()
    want = sorted(map(tuple, b.collect()))
    assert sorted(map(tuple, stateful.read_written(spark, path).select("id", "x").collect())) == want
    for f in glob.glob(f"{checkpoint}/commits/*2*") + glob.glob(f"{checkpoint}/commits/.*2*"):
        os.remove(f)  # as if the last batch had been written, but not committed
    go()
    assert sorted(map(tuple, stateful.read_written(spark, path).select("id", "x").collect())) == want


def test_batch_pose_against_brute_force(spark):
    import random

    r = random.Random(2)
    poses = sorted({(r.randrange(3), r.randrange(20_000)) for _ in range(80)})
    poses = [(k, t, float(i)) for i, (k, t) in enumerate(poses)]
    messages = [(r.randrange(4), r.randrange(20_000), i) for i in range(300)]
    m = times(spark.createDataFrame(messages, "k long, stamp long, message_id long"), "stamp")
    p = times(spark.createDataFrame(poses, "k long, stamp long, x double"), "stamp")
    got = {x.message_id: x.x for x in stateful.latest_pose(m, p, "k", ["x"], bucket="minute").collect()}
    for k, t, i in messages:
        old = [x for kk, tt, x in poses if kk == k and tt <= t]
        assert got[i] == (old[-1] if old else None)
