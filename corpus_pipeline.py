"""A training corpus from raw documents: quality, near duplicates, repeated passages, benchmark leaks, sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of documents; the last returns a row per piece with its place in a sequence.

Defined results: each row is judged by its own text, also where ids repeat or are null; a row without an id is in no
group of near copies and loses no passage; null texts stay null up to the last stage, where
they are empty; other columns pass through to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linelake.llm.common import materialize, table
from linelake.llm.decontaminate import decontaminate
from linelake.llm.jaccard import near_duplicates
from linelake.llm.packing import encode_pieces, pack
from linelake.llm.quality import keep_good
from linelake.llm.recompress import remove_repeats

#: Words of a passage from which a repeat of it is cut.
PASSAGE = 50


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier keeps."""
    return keep_good(docs)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near copies (five-word shingles, 0.8)."""
    return near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of PASSAGE words or more that stand earlier too; the rest keeps its layout."""
    cut = remove_repeats(docs, window=PASSAGE, counts=False)
    if "n_chars" not in cut.columns:
        return cut
    kind = dict(docs.dtypes)["n_chars"]
    return cut.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten words in a row of a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: the documents packed into sequences."""
    pieces = encode_pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(materialize(pieces, "pieces"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicate),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("best-fit packing", sequences),
]

ORACLE_SQL = None  # no SQL for the fitted classifier; tests hold each stage against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
