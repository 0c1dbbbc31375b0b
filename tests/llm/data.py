"""Awkward documents: nulls, empty and long texts, ties, repeated rows, other columns with clashing names."""

import random

from pyspark.sql import functions as F

WORDS = [f"w{i}" for i in range(300)]


def awkward(spark, more=(), seed=1):
    r = random.Random(seed)
    passage = r.choices(WORDS, k=60)
    rows = [(i, " ".join(r.choices(WORDS, k=r.randint(0, 80)))) for i in range(40)]
    rows += [(100 + i, " ".join(r.choices(WORDS, k=r.randint(5, 30)) + passage + r.choices(WORDS, k=10))) for i in range(6)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), rows[5], rows[5]]
    rows += [(300, None), (301, ""), (302, "  \n\t "), (303, "a b"), (304, "A  b"), (305, "é Ü K á"), (None, rows[7][1]), (306, " ".join(r.choices(WORDS, k=30_000))), (307, "x " * 500), (308, "y" * 20_000)]
    rows += list(more)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name in ("n", "cell", "name", "row", "rank", "ids", "n_words", "label"):
        df = df.withColumn(name, F.lit("clash"))
    return df, rows


def words(text):
    return (text or "").encode().split()
