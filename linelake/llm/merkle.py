"""Merkle manifest of a data set: a digest per row, a tree per group, a tree over the groups, and a proof for each row.

H is the lower-case hexadecimal SHA-256 of its inputs in a row, digests as hexadecimal text. A leaf is H of a row's
fields, each as its UTF-8 byte count, a colon and its value, or `-` for null. In a group the leaves ascend by id; while
several nodes remain, every FANOUT neighbours (the last run may be shorter, even one) become their H. What remains is the
group's subroot. The subroots, by group (null first), give the root in the same way.

Rows are sorted once, by group and id, over ranges of which a hot group may take many; all that the driver learns is how
the ranges' ends meet. From then on the leaves of a group are matrices of 64-byte digests: blocks of FANOUT ** HEIGHT
leaves, aligned in their group, so that every block is a subtree. A task hashes the rows of a block's reshaped matrix
level by level; the blocks' tops are the leaves of the next tree, until one is left. On the way back each block gets
the siblings above it, and those of each leaf inside it come from index arithmetic on the block's levels.

Defined results: a null is `-` in a leaf; rows without a group are a group of their own, the first; rows without an id come first
in their group; rows that share group and id ascend by their leaf; repeated rows are a leaf each; a group of one row
has its leaf as its subroot, and a proof without siblings (the H of nothing); an empty table has no root and no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linelake.llm.common import map_arrow, materialize, table

FANOUT = 3
HEIGHT = 7  # levels of a block, which has FANOUT ** HEIGHT leaves
HEX = 64  # bytes of a digest


def digest(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def field(value: Column) -> Column:
    own = value.cast("string")
    return F.when(own.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(own).cast("string"), F.lit(":"), own))


def leaf(*values: Column) -> Column:
    """H of a row's fields."""
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def matrix(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint8).reshape(-1, HEX)


def above(nodes: np.ndarray) -> np.ndarray:
    """The next level: full runs are rows of the reshaped matrix, a shorter last run is hashed by itself."""
    full = len(nodes) // FANOUT
    runs = nodes[: full * FANOUT].reshape(full, FANOUT * HEX)
    return matrix([digest(r.tobytes()) for r in runs] + [digest(nodes[full * FANOUT :].tobytes())] * (full * FANOUT < len(nodes)))


def levels(data: bytes, block: int, height: int) -> list[np.ndarray]:
    """All levels of a block of that number, leaves first. A block that isn't the only one of its group has `height`
    levels above them: there, a single node is hashed again like any run."""
    out = [np.frombuffer(data, np.uint8).reshape(-1, HEX)]
    only = block == 0 and len(out[0]) < FANOUT**height
    while len(out[-1]) > 1 if only else len(out) <= height:
        out.append(above(out[-1]))
    return out


def siblings(rows: list[np.ndarray], k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the nodes at these places of level k: where their run begins, their own place, and where their run ends."""
    first = at // FANOUT * FANOUT
    return first, at, np.minimum(first + FANOUT, len(rows[k]))


def _chunks(leaves: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """Matrices of neighbouring leaves of one group, in the order of column `order`: group, part (number of the range), first
    (whether the part begins with this group), at (place of its first leaf among the group's in this part), n, ids,
    digests and others (digests that go with the leaves)."""
    tie = F.monotonically_increasing_id() % 4096  # equal rows are alike, and may lie in several ranges
    keyed = leaves.select(F.col(group).alias("g"), F.col(order).alias("id"), "leaf", "other", tie.alias("tie"))
    by = ["g", "id", "leaf", "tie"]
    rows = keyed.repartitionByRange(*by).sortWithinPartitions(*by).select("g", "id", "leaf", "other")
    kinds = dict(rows.dtypes)

    def run(batches) -> Iterator[pa.RecordBatch]:
        part, seen, held = TaskContext.get().partitionId(), [], []  # seen: first group; held: (ids, leaves, others)
        now, done = None, 0

        def flush():
            ids, own, other = map(pa.concat_arrays, zip(*held))
            data = [pa.array([x], pa.binary()) for x in (b"".join(own.to_pylist()), b"".join(other.to_pylist()))]
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            g = pa.array([now], group_type)
            return pa.RecordBatch.from_arrays([g, pa.array([part]), pa.array([now == seen[0]]), pa.array([done]), pa.array([len(ids)]), lists, *data], ["g", "part", "first", "at", "n", "ids", "digests", "others"])

        for batch in batches:
            group_type = batch.column(0).type
            g = batch.column(0).dictionary_encode(null_encoding="encode")
            code = np.asarray(g.indices)
            ends = np.append(np.flatnonzero(code[1:] != code[:-1]) + 1, len(code)) if len(code) else []
            lo = 0
            for hi in ends:
                own = g.dictionary[int(code[lo])].as_py()
                if not seen:
                    seen.append(own)
                    now = own
                if own != now:
                    if held:
                        yield flush()
                    now, done, held = own, 0, []
                while lo < hi:
                    room = size - sum(len(x[0]) for x in held)
                    take = min(room, hi - lo)
                    held.append((batch.column(1).slice(lo, take), batch.column(2).slice(lo, take).cast(pa.binary()), batch.column(3).slice(lo, take).cast(pa.binary())))
                    lo += take
                    if take == room:
                        yield flush()
                        done, held = done + size, []
        if held:
            yield flush()

    return rows.mapInArrow(run, f"g {kinds['g']}, part long, first boolean, at long, n long, ids array<{kinds['id']}>, digests binary, others binary")


def _offsets(chunks: DataFrame) -> DataFrame:
    """part, offset: how many leaves of a part's first group lie in earlier parts. Two groups a part are looked at."""
    each = chunks.groupBy("part", "g").agg(F.sum("n").alias("n"), F.max("first").alias("first"))
    last = F.max_by(F.struct("g", "n"), F.struct(~F.col("first"), F.col("g").isNotNull(), "g")).alias("last")
    ends = each.groupBy("part").agg(F.max_by(F.struct("g", "n"), "first").alias("begin"), last, F.count("*").alias("groups")).orderBy("part").collect()
    out, group, before = [], object(), 0
    for x in ends:
        offset = before if x.begin.g == group else 0
        out.append((x.part, offset))
        group, before = (x.begin.g, offset + x.begin.n) if x.groups == 1 else (x.last.g, x.last.n)
    return chunks.sparkSession.createDataFrame(out, "part long, offset long")


def _pieces(chunks: DataFrame, size: int) -> DataFrame:
    """The chunks cut where blocks meet: g, block, at (place of the first leaf in the group), ids, digests, others."""
    placed = chunks.join(F.broadcast(_offsets(chunks)), "part").withColumn("at", F.col("at") + F.when(F.col("first"), F.col("offset")).otherwise(0))
    blocks = F.explode(F.sequence(F.expr(f"at div {size}"), F.expr(f"(at + n - 1) div {size}")))
    low = F.greatest(F.col("block") * size - F.col("at"), F.lit(0))
    high = F.least((F.col("block") + 1) * size - F.col("at"), F.col("n"))
    cut = placed.withColumn("block", blocks).withColumn("low", low.cast("int")).withColumn("many", (high - low).cast("int"))
    own = [F.expr(f"substring({c}, low * {HEX} + 1, many * {HEX})").alias(c) for c in ("digests", "others")]
    return cut.select("g", "block", (F.col("at") + F.col("low")).alias("at"), F.expr("slice(ids, low + 1, many)").alias("ids"), *own)


def _blocks(pieces: DataFrame, height: int) -> DataFrame:
    """Aligned blocks: g, block, ids, digests, others, top (the block's node)."""
    kinds = dict(pieces.dtypes)

    def whole(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at").combine_chunks()
        ids = pa.concat_arrays([x.flatten() for x in rows["ids"].chunks])
        nodes, others = (b"".join(rows[c].to_pylist()) for c in ("digests", "others"))
        block = rows["block"][0].as_py()
        top = levels(nodes, block, height)[-1].tobytes()
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.Table.from_arrays([rows["g"].slice(0, 1), pa.array([block]), lists, *[pa.array([x], pa.binary()) for x in (nodes, others, top)]], ["g", "block", "ids", "digests", "others", "top"])

    return pieces.groupBy("g", "block").applyInArrow(whole, f"g {kinds['g']}, block long, ids {kinds['ids']}, digests binary, others binary, top binary")


@dataclass
class Tree:
    """Tables of blocks, from those of the leaves to those with one block a group."""

    heights: list[DataFrame]
    height: int  # levels of a block

    def tops(self) -> DataFrame:
        """g, node: the last node of each group."""
        return self.heights[-1].select("g", F.col("top").alias("node"))


def grow(leaves: DataFrame, group: str, order: str, tag: str, height: int = HEIGHT) -> Tree:
    """The trees of all groups. leaves: the group, the column of the order, leaf and other."""
    chunks = materialize(_chunks(leaves, group, order, FANOUT**height), f"{tag}-chunks")
    heights = [materialize(_blocks(_pieces(chunks, FANOUT**height), height), f"{tag}-blocks")]
    while (heights[-1].agg(F.max("block")).first()[0] or 0) > 0:
        at = F.col("block")
        nodes = heights[-1].select("g", F.expr(f"block div {FANOUT**height}").alias("block"), at.alias("at"), F.array(at).alias("ids"), F.col("top").alias("digests"), F.col("top").alias("others"))
        heights.append(materialize(_blocks(nodes, height), f"{tag}-blocks"))
    return Tree(heights, height)


#: Left and right siblings of each level of a way up, lowest first.
WAY = "array<struct<left: string, right: string>>"


def _item(kind: str) -> str:
    return kind.removeprefix("array<").removesuffix(">")


def _ways(blocks: DataFrame, height: int) -> DataFrame:
    """g, id, way, tip of each entry of blocks (g, ids, digests, block, way, tip): the siblings within the block, then the block's own."""
    kinds = dict(blocks.dtypes)

    def make():
        def each(batch):
            for g, block, ids, data, way, tip in zip(*(batch.column(k).to_pylist() for k in range(6))):
                rows = levels(data, block, height)
                text = [x.tobytes().decode() for x in rows]
                ups = []
                for i in range(len(ids)):
                    own, at = [], i
                    for k in range(len(rows) - 1):
                        a, b, c = (int(x) * HEX for x in siblings(rows, k, np.int64(at)))
                        own.append({"left": text[k][a:b], "right": text[k][b + HEX : c]})
                        at //= FANOUT
                    ups.append(own + way)
                kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(ids), batch.column(0).type), pa.array(ids, batch.column(2).type.value_type), pa.array(ups, kind), pa.array([tip] * len(ids), pa.string())], ["g", "id", "way", "tip"])

        return each

    return map_arrow(blocks.select("g", "block", "ids", "digests", "way", "tip"), make, f"g {kinds['g']}, id {_item(kinds['ids'])}, way {WAY}, tip string")


def descend(tree: Tree, ends: DataFrame) -> DataFrame:
    """The leaves' blocks with way and tip: ends has g, way and tip of each group's last node."""
    blocks = tree.heights[-1].join(ends, F.col("g").eqNullSafe(F.col("end_g"))).drop("end_g")
    for lower in reversed(tree.heights[:-1]):
        up = _ways(blocks, tree.height).toDF("up_g", "up_block", "way", "tip")
        blocks = lower.join(up, F.col("g").eqNullSafe(F.col("up_g")) & (F.col("block") == F.col("up_block"))).drop("up_g", "up_block")
    return blocks


class Proofs:
    """Of a block's leaves: digests of the proofs, and the roots that other leaves lead to with the same siblings."""

    def __init__(self, data: bytes, block: int, height: int, way: list[dict]):
        self.rows = levels(data, block, height)
        self.bytes = [x.tobytes() for x in self.rows]
        self.up = [(x["left"].encode(), x["right"].encode()) for x in way]
        every = np.arange(len(self.rows[0]))
        self.ends = []  # by level, in bytes: run begins, own node, run ends
        for k in range(len(self.rows) - 1):
            self.ends.append([(x * HEX).tolist() for x in siblings(self.rows, k, every // FANOUT**k)])

    def of(self, i: int) -> list[tuple[bytes, bytes]]:
        own = []
        for b, (first, at, end) in zip(self.bytes, self.ends):
            own.append((b[first[i] : at[i]], b[at[i] + HEX : end[i]]))
        return own + self.up

    def check(self, i: int, leaf_: bytes) -> tuple[str, str]:
        way = self.of(i)
        node = leaf_
        for left, right in way:
            node = digest(left, node, right)
        return digest(*(x for pair in way for x in pair)).decode(), node.decode()


def prove(blocks: DataFrame, height: int = HEIGHT, full: bool = False) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (from the other leaf), verified of each leaf of blocks as
    descend() gives them, with the root in a column; with `full`, also the siblings (left and right of each level)."""
    kind = _item(dict(blocks.dtypes)["ids"])

    def make():
        def each(batch):
            for block, ids, data, others, way, tip, root in zip(*(batch.column(k).to_pylist() for k in range(7))):
                p = Proofs(data, block, height, way)
                found = [p.check(i, others[i * HEX : (i + 1) * HEX]) for i in range(len(ids))]
                proof, folded = [x for x, _ in found], [x for _, x in found]
                own = p.bytes[0].decode()
                columns = [pa.array(ids, batch.column(1).type.value_type), pa.array([own[i * HEX : (i + 1) * HEX] for i in range(len(ids))]), pa.array([tip] * len(ids), pa.string()), pa.array([root] * len(ids), pa.string()), pa.array(proof), pa.array(folded), pa.array([x == root for x in folded])]
                if full:
                    ups = [[{"left": a.decode(), "right": b.decode()} for a, b in p.of(i)] for i in range(len(ids))]
                    columns.append(pa.array(ups, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "siblings"][: len(columns)])

        return each

    more = f", siblings {WAY}" if full else ""
    return map_arrow(blocks.select("block", "ids", "digests", "others", "way", "tip", "root"), make, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean{more}")


def manifest(leaves: DataFrame, group_col: str = "source", id_col: str = "doc_id", full: bool = False, height: int = HEIGHT) -> DataFrame:
    """prove() for the trees of leaves (group, id, leaf, other): one tree a group and one over the groups."""
    tree = grow(leaves, group_col, id_col, "leaves", height)
    node = F.col("node").cast("string")
    top = grow(tree.tops().select(F.lit(0).alias("all"), F.col("g").alias("name"), node.alias("leaf"), node.alias("other")), "all", "name", "groups", height)
    root = top.tops().first()
    end = top.tops().select(F.col("g").alias("end_g"), F.array().cast(WAY).alias("way"), F.lit(None).cast("string").alias("tip"))
    ways = _ways(descend(top, end), height).select(F.col("id").alias("name"), "way")
    own = tree.tops().join(ways, F.col("g").eqNullSafe(F.col("name"))).select(F.col("g").alias("end_g"), "way", node.alias("tip"))
    return prove(descend(tree, own).withColumn("root", F.lit(root and root.node.decode()).cast("string")), height, full)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    cut = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = even & (F.instr("text", "\n") > 0)
    own = docs.select("source", "doc_id", leaf(*fields, F.col("text")).alias("leaf"), F.when(changed, leaf(*fields, cut)).alias("changed"))
    return manifest(own.select("source", "doc_id", "leaf", F.coalesce("changed", "leaf").alias("other")))
