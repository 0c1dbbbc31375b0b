"""Each pipeline stage against plain rules, on documents with planted cases."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linelake.llm.common import alnum_words
from tests.llm.data import awkward
from tests.llm.test_text_operators import repeats_by_force

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    r = random.Random(4)
    clean = [x.text for x in df.join(spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1"), "doc_id").orderBy("doc_id").limit(20).collect()]
    voc = " ".join(clean).split()
    passage = " ".join(r.choices(voc, k=55))
    mine = [(90_001, clean[0]), (90_002, clean[1] + " end"), (90_003, " ".join(r.choices(voc, k=90)) + "\n" + item), (90_004, " ".join(r.choices(voc, k=80)) + "\n" + passage), (90_005, passage + "\n" + " ".join(r.choices(voc, k=80))), (90_006, None)]
    more = spark.createDataFrame(mine, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    return df.unionByName(more.select(*df.columns)).cache()


def test_stages(spark, sf, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "best-fit packing"]
    ids = lambda d: {x.doc_id for x in d.select("doc_id").collect()}

    good = STAGES["quality classifier"](spark, docs, sf).cache()
    assert good.dtypes == docs.dtypes
    assert good.count() < docs.count() and 90_006 in ids(good)

    single = STAGES["n-gram Jaccard join"](spark, docs, sf).cache()
    assert single.columns == docs.columns and not ids(single) & {90_001, 90_002} and {90_003, 90_004, 90_005, 90_006} <= ids(single)

    cut = STAGES["substring dedup"](spark, single, sf).cache()
    assert cut.columns == docs.columns and cut.count() == single.count()
    gone = repeats_by_force([(x.doc_id, x.text) for x in single.collect()], corpus_pipeline.PASSAGE)
    before = {x.doc_id: x.text for x in single.collect()}
    for x in cut.collect():
        left = [w for w, g in zip((before[x.doc_id] or "").encode().split(), gone[x.doc_id]) if not g]
        assert (x.text or "").encode().split() == left
        assert x.text is None or x.n_chars == len(x.text)
        if not any(gone[x.doc_id]):
            assert x.text == before[x.doc_id]
    assert sum(gone[90_005]) >= 55

    clean = STAGES["benchmark decontamination"](spark, docs, sf)
    assert clean.columns == docs.columns and 90_003 not in ids(clean)
    items = [alnum_words(x.text.encode()) for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in items for i in range(max(1, len(w) - 9)) if w}
    left, sizes = ids(clean), {len(t) for t in windows}
    for x in docs.collect():
        w = alnum_words((x.text or "").encode())
        hit = any(tuple(w[i : i + k]) in windows for k in sizes for i in range(len(w) - k + 1))
        assert (x.doc_id in left) != hit

    packed = STAGES["best-fit packing"](spark, docs, sf)
    assert ids(packed) == ids(docs)


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and {"doc_id", "piece", "start", "length", "sequence_id", "offset"} <= set(out.columns)


def test_stages_on_awkward_documents(spark, sf):
    df, rows = awkward(spark, [(5, None), (5, "another text of the same id"), (None, None)])
    for name in ("_id", "id", "hash", "found", "starts", "_n_words", "part"):
        df = df.withColumn(name, F.lit("clash"))
    df = df.cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, sf)
        assert out.columns == df.columns, name
        assert 0 < out.count() <= len(rows), name
        # rows without a text or without words pass each filter
        assert out.filter("text is null").count() == sum(t is None for _, t in rows), name
    packed = STAGES["best-fit packing"](spark, df, sf)
    assert packed.filter("piece = 0").count() == len(rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), sf).count() == 0, name
