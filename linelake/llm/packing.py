"""Best-fit packing of documents into sequences of a fixed number of tokens, by sum of squares.

Each document's ids end with id 0. A document that is longer than a sequence is cut from its end into full pieces,
so that only its first piece is shorter. Full pieces fill a sequence of their own. The others are placed one by one:
of all gaps g that the piece fits into, and a new sequence, the one is taken after which the sum over all gaps of the
squared number of open sequences with that gap is smallest. The cost of a placement depends on the histogram of gaps
alone, so a shard of any number of pieces needs memory for its pieces' lengths and `capacity` counters.

Shards of about SHARD pieces are packed apart; each leaves a few sequences open, however many pieces it has. Only
identifiers and lengths are shuffled, never ids. Long pieces come first within a shard, so that short ones, of which
there are many kinds, fill the gaps at its end.

Defined results: the string of an added token in a text gets that token's id; null text is empty, and an empty document is one piece of one id; no documents give no rows; of
equal pieces the one with the smaller (doc_id, piece) is placed first; repeated rows are packed each; other columns
are not read.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linelake.llm.common import MULT, SPACE, extended, map_arrow, mix, slices, table

CAPACITY = 2048
SHARD = 50_000
END_ID = 0

_encoders: dict = {}

#: Runs this long without white space go to the tokenizer whose cost stays near linear in the length of a word.
LONG_RUN = 5_000


def longest_run(text: bytes, least: int) -> int:
    """Length of the longest run without white space; 0 for texts shorter than `least`."""
    if len(text) < least:
        return 0
    space = np.flatnonzero(SPACE[np.frombuffer(text, np.uint8)])
    return int(np.diff(space, prepend=-1, append=len(text)).max()) - 1


class Encoder:
    """Ids of the byte-level vocabulary of `vocabulary` (a tokenizers file). A file of the same name with the suffix
    .tiktoken beside it holds the same vocabulary as ranks and gives the same ids several times as fast; it is used
    where it exists, but for texts with a string of an added token (it has the token's id, as `tokenizers` gives it
    without further settings) and for those with very long words."""

    def __init__(self, vocabulary: str):
        import os

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.slow = Tokenizer.from_file(vocabulary)
        self.added = [x.content.encode() for x in self.slow.get_added_tokens_decoder().values()]
        self.fast, ranks = None, vocabulary.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding(os.path.basename(ranks), pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_, special_tokens={})

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.decode("utf-8", "replace")
        if self.fast is None or any(x in text for x in self.added) or longest_run(text, LONG_RUN) >= LONG_RUN:
            return np.array(self.slow.encode(words, add_special_tokens=False).ids, "<u4")
        return np.asarray(self.fast.encode_to_numpy(words), "<u4")


def encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit): each document's ids, cut for the capacity."""
    path = vocabulary or default_vocabulary()
    names = ["doc_id", "piece", "start", "length", "ids"]

    def make():
        encode = encoder(path)

        def each(batch):
            for part, data in slices(batch, 1):
                keys, rows = part.column(0).to_pylist(), []
                for key, text in zip(keys, data):
                    ids = np.append(encode(text), np.uint32(END_ID)).astype("<u4")
                    first = (len(ids) - 1) % capacity + 1
                    start = 0
                    for k in range(1 + (len(ids) - first) // capacity):
                        end = first + k * capacity
                        rows.append((key, k, start, end - start, ids[start:end].tobytes()))
                        start = end
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

        return each

    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), make, "doc_id long, piece int, start long, length long, ids binary")


def place(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, taken in the order given."""
    count = np.zeros(capacity + 1, np.int64)  # of open sequences by gap; gap 0 is closed and never counted
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        # the change of the sum of squares, less 2; the last choice is a new sequence
        cost = 2 * (count[: capacity - s + 1] - np.where(count[s:] > 0, count[s:], -(1 << 40)))
        cost[-1] = 2 * count[capacity - s]
        cost[[0, -1]] -= 1
        g = int(np.argmin(cost)) + s
        if g == capacity:
            number, made = made, made + 1
        else:
            number = open_[g].pop()
            count[g] -= 1
        where[i], offset[i] = number, capacity - g
        if g > s:
            open_[g - s].append(number)
            count[g - s] += 1
    return where, offset


def in_turn(lengths: np.ndarray, ids: np.ndarray, piece: np.ndarray, capacity: int) -> np.ndarray:
    """Order in which pieces are placed: those longer than a fifth of a sequence, longest first, then the others in a
    scattered order."""
    short = lengths <= capacity // 5
    scattered = mix(ids.astype(np.uint64) * MULT + piece.astype(np.uint64))
    return np.lexsort((piece, ids, np.where(short, scattered, np.uint64(0)), np.where(short, 0, -lengths), short))


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """The pieces' columns with sequence_id and offset. The first five columns of encode_pieces are read, but ids; pieces
    should be a stored table, as rows are dealt by their place in it. Columns `_null` and `_shard` go."""
    pieces = pieces.drop("_null", "_shard")
    pieces = pieces.select("doc_id", "piece", "start", "length", *[c for c in pieces.columns if c not in ("doc_id", "piece", "start", "length", "ids")])
    columns = [*pieces.columns, "sequence_id", "offset"]
    pieces = pieces.withColumn("_null", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0).cast("long")))  # pandas would round ids beside nulls
    n = pieces.count()
    shards = max(1, -(-n // shard))
    schema = extended(pieces.schema, sequence_id="long", offset="long")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, piece = pdf["doc_id"].to_numpy(np.int64), pdf["piece"].to_numpy(np.int64)
        pdf = pdf.iloc[in_turn(pdf["length"].to_numpy(), ids, piece, capacity)]
        where, offset = place(pdf["length"].to_numpy(), capacity)
        out = pdf.drop(columns="_shard")
        return out.assign(sequence_id=where * shards + int(pdf["_shard"].iloc[0]), offset=offset)[schema.names]

    # by the row: rows that share an id, or have none, are dealt like all others
    dealt = pieces.withColumn("_shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    return dealt.groupBy("_shard").applyInPandas(one, schema).withColumn("doc_id", F.when(~F.col("_null"), F.col("doc_id"))).select(*columns)


def sequences(pieces: DataFrame, packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves, from encode_pieces() and pack() of the same documents."""
    joined = pieces.join(packed.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"])
    return joined.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p")).select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linelake.llm.common import materialize

    pieces = encode_pieces(table(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(materialize(pieces, "pieces"))
