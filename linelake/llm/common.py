"""Helpers shared by the training-data operators: scratch tables in the cluster's shared folder, word splitting
and hashing over Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Documents of one Arrow batch are handled in slices of at most this many bytes of text (or one document).
SLICE_BYTES = 4 << 20

_scratch: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, where it is unset (tests), a new local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_before.isDefined():
            return set_before.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="linelake-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def delete(spark: SparkSession, path: str) -> None:
    jvm, sc = spark._jvm, spark.sparkContext
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: this cuts the lineage, and a lost executor
    loses nothing of it. The shuffle files of the write go at once; the table goes at the end of the application."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/linelake-{app}/{tag}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    if app not in _scratch:
        _scratch[app] = []
        atexit.register(release, spark)
    _scratch[app].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a materialized table that nothing reads any more."""
    spark = df.sparkSession
    _scratch[spark.sparkContext.applicationId].remove(df.scratch_path)
    delete(spark, df.scratch_path)


def release(spark: SparkSession) -> None:
    """Delete the scratch tables of this application. Results not yet written can't be computed afterwards."""
    try:
        paths = _scratch.pop(spark.sparkContext.applicationId, [])
        for path in paths:
            delete(spark, path)
    except Exception:  # noqa: BLE001  at exit the JVM may be gone already
        return


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have in any case of letters, made from the given ones."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def text_hash(text: Column) -> Column:
    """128 bits of a text in hexadecimal; null is like empty."""
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def without(docs: DataFrame, bad: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs without the rows whose id and text_hash are those of a row of bad. What is decided by the text holds for the
    rows with this text alone, also where ids repeat or are null."""
    own_id, own_hash = fresh(docs, "id", "hash")
    bad = bad.toDF(own_id, own_hash).distinct()
    same = F.col(id_col).cast("long").eqNullSafe(F.col(own_id)) & (text_hash(F.col(text_col)) == F.col(own_hash))
    return docs.join(bad, same, "left_anti")


#: Keys that hold more than one in this many rows are fewer than this many; they are dealt into SALTS parts.
HOT, SALTS = 1000, 64


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """rows joined with groups (a row per key, with the number of its rows in `size`, which goes). The rows of a hot key
    are dealt over several tasks; hot keys are fewer than HOT by what they are, so they can be broadcast."""
    total, most = groups.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    if most * HOT <= total:
        return rows.join(groups.drop(size).hint("shuffle_hash"), keys)
    part, hot = fresh(rows, "part", "hot")
    much = groups.filter(F.col(size) * HOT > total).select(*keys, F.lit(True).alias(hot))
    dealt = rows.join(F.broadcast(much), keys, "left").withColumn(part, F.when(F.col(hot), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0)).drop(hot)
    parts = F.sequence(F.lit(0).cast("long"), F.when(F.col(size) * HOT > total, SALTS - 1).otherwise(0).cast("long"))
    return dealt.join(groups.withColumn(part, F.explode(parts)).drop(size).hint("shuffle_hash"), [*keys, part]).drop(part)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, text: int, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch with the bytes of their text column, each of at most `most` bytes or one row."""
    whole = batch.column(text).cast(pa.binary())
    sizes = np.zeros(batch.num_rows, np.int64)
    if batch.num_rows:
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(whole), 0), np.int64)
    at, n = 0, batch.num_rows
    ends = np.cumsum(sizes)
    while at < n:
        base = ends[at] - sizes[at]
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        part = batch.slice(at, to - at)
        yield part, texts(part.column(text))
        at = to


class WordHashes(dict):
    """Word (bytes) to a 64-bit name that is the same in every process. It forgets all above `most` words."""

    def __init__(self, most: int = 250_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Whether a byte is ASCII white space, as bytes.split() takes it.
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])

MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit names of all runs of n items; h must have at least n."""
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * MULT + h[k : k + len(out)]
    return mix(out)


#: Bytes to themselves, A-Z to a-z, and every byte that is no letter, digit or part of a non-ASCII character to a space.
ALNUM = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())


def alnum_words(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z."""
    return text.translate(ALNUM).split()


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """mapInArrow with state per task: make() gives the function of a batch."""

    def run(batches):
        each = make()
        for batch in batches:
            yield from each(batch)

    return df.mapInArrow(run, schema)


def extended(schema: T.StructType, **more: str) -> T.StructType:
    """A schema and further fields, by name and type; the given one stays as it is."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in more.items())).fields])


def crc_mod(column: Column, n: int) -> Column:
    return F.crc32(column.cast("string").cast("binary")) % n
