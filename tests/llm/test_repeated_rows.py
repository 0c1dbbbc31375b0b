"""One id many times, with one text or many, and many rows without an id: every operator stays within bounds and right."""

import random

import pytest
from pyspark.sql import functions as F

from linelake.llm import jaccard, packing, quality, recompress, toxicity
from tests.llm.data import WORDS
from tests.llm.test_text_operators import repeats_by_force

N = 3_000


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    text = " ".join(r.choices(WORDS, k=60))
    many = [" ".join(r.choices(WORDS, k=25)) for _ in range(N)]
    return [(1, text)] * N + [(2, t) for t in many] + [(None, f"{t} null") for t in many[: N // 2]] + [(None, text)] * (N // 2) + [(3, text), (4, many[0] + " x"), (5, None), (6, "")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()


def test_substring_dedup(spark, docs, rows):
    small = [x for x in dict.fromkeys(rows) if x[0] is not None]
    gone = {}
    for i, (doc, text) in enumerate(sorted(small, key=lambda x: x[0])):
        gone[i] = (doc, text)
    out = recompress.remove_repeats(docs, window=20)
    assert out.count() == len(rows)
    got = out.filter("doc_id in (1, 3)").select("doc_id", "_n_removed").distinct().collect()
    assert sorted(map(tuple, got)) == [(1, 0), (3, 60)]  # equal rows are one document; another id with its text is a repeat
    assert out.filter("doc_id is null and _n_removed > 0").count() == 0
    assert [x._n_removed for x in out.filter("doc_id = 4").collect()] == [repeats_by_force([(2, rows[N][1]), (4, rows[N][1] + " x")], 20)[4].count(True)]


def test_jaccard(spark, docs, rows):
    out = jaccard.similar(docs, width=4, percent=85)
    assert out.count() == len(rows)
    got = {x.doc_id: x for x in out.groupBy("doc_id").agg(F.min("component_id").alias("low"), F.max("component_id").alias("high"), F.count("*").alias("n")).collect()}
    assert (got[1].low, got[1].high, got[3].low) == (1, 1, 1)
    assert (got[2].low, got[2].high, got[4].low) == (2, 2, 2)
    assert (got[5].low, got[6].low) == (5, 6)
    bare = out.filter("doc_id is null").groupBy("component_id").count().collect()
    assert {(x.component_id, x["count"]) for x in bare} >= {(1, N // 2)}
    kept = jaccard.near_duplicates(docs, width=4, percent=85)
    assert kept.filter("doc_id in (3, 4)").count() == 0 and kept.filter("doc_id in (5, 6)").count() == 2 and kept.filter("doc_id is null").count() == N


def test_packing(spark, docs, rows):
    pieces = packing.encode_pieces(docs).drop("ids").cache()
    packed = packing.pack(pieces, shard=500)
    assert packed.count() == pieces.count()
    shards = max(1, -(-pieces.count() // 500))
    sizes = [x["count"] for x in packed.groupBy(F.col("sequence_id") % shards).count().collect()]
    assert len(sizes) == shards and max(sizes) < 700
    full = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert full.filter("n <> end or n > 2048").count() == 0


def test_classifier_sample(spark, docs, rows):
    out = quality.judge(docs, sample=200)
    assert out.count() == len(rows)
    described = quality.describe(docs)
    chosen = described.filter(F.pmod(F.xxhash64("doc_id", "hash"), F.lit(1 << 30)) < int(0.9 * 200 / len(rows) * (1 << 30))).dropDuplicates(["doc_id", "hash"])
    assert chosen.count() < 300


def test_toxicity_sample(spark, docs, rows):
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, sample=100)
    assert toxicity.severity(docs, model).count() == len(rows)
