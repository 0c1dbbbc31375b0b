"""N-gram Jaccard join: documents whose sets of word n-grams reach a Jaccard similarity, as connected components.

The documents by n-grams incidence matrix A is multiplied with its own transpose in blocks; an entry of the product is
the overlap of two documents. Bounds from the sizes say what need not be multiplied:

* Two sets of sizes a and b link only when the overlap is at least t (a + b) / (1 + t), hence at least t a and t b. In
  one global order of the n-grams, two linked sets share one among the first a - ceil(t a) + 1 of each. Only these
  columns of A choose the blocks. The order puts n-grams that stand in many documents last; any order gives the same
  links, so the counts behind it may be rough.
* A column's documents form a cell with the column's smallest document id; columns with the same smallest id share a
  cell. Linked documents share a column, hence a cell, and so all links are found within cells.
* The overlap within these first columns is accumulated per cell; documents that have no partner there whose overlap
  reaches what their sizes ask leave the cell before any text is fetched. Those that the cell leaves open are compared
  once more by all their first columns, those of their other cells included.
* In a cell of at most BLOCK documents, all overlaps are accumulated over blocks of columns in one product. In a larger
  cell, all documents are first compared with its smallest id; those linked with it are one component already and need
  not be compared with each other. The others, in blocks of BLOCK, are each multiplied with the whole cell.

Equal sets count once: the smallest id stands for its class, and of the others next to none gets into a cell (a bit map
of fixed size tells them from the first ones), so copies are never paired. The product is sparse: the columns of few
documents add one to each of their pairs, and those of many are taken together in dense blocks. A block's product leaves
its task only as the edges of a spanning forest, never as pairs. Frequent digests, columns and cells are dealt over
several tasks.

N-grams go by 64-bit names. Texts travel compressed, and their sets are built where they are multiplied: names don't
compress, and the words of a text do.

Defined results: words are runs without ASCII white space, A-Z lower-cased; a text of fewer words than n has its whole
sequence as its one n-gram; null and empty texts have size 0 and link with nothing; rows without an id get the
component of their text's class; rows that share an id are one node of the graph, each gets a row with the component of
its text's class, and each is dropped for its own text; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linelake.llm.common import HOT, WordHashes, discard, join_groups, map_arrow, materialize, mix, rolling, slices, table, text_hash, without
from linelake.llm.components import connected_components, forest
from linelake.llm.recompress import rank_texts

WIDTH = 5
PERCENT = 80
BLOCK = 512
COLUMNS = 2048
DENSE = 32  # documents from which on a column goes into a dense block
PAIRS = 1 << 22  # pairs that sparse columns add up at once
STREAM_BYTES = 64 << 20  # of sets that are multiplied with a block at once
PRODUCT = 4096  # documents of a cell whose first columns are multiplied in one task; larger cells go by blocks only

PARTS = 3  # of the columns, that are shuffled one after the other
BUCKETS = 1 << 20  # counters for the order of n-grams
SIEVE = 1 << 26  # bits of the map that leaves out documents without a partner; a full map only costs time


def shingle_set(text: bytes, names: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit names of the text's distinct n-grams."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = names.of(words)
    if len(words) < width:
        return mix(rolling(h, len(words)) + np.uint64(len(words)))
    return np.unique(rolling(h, width))


def bucket(s: np.ndarray) -> np.ndarray:
    return (s & np.uint64(BUCKETS - 1)).astype(np.int64)


def prefix(s: np.ndarray, weight: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first n-grams of a set in the global order, of which linked sets share one."""
    n = len(s)
    k = n + -(-percent * n // 100) * -1 + 1
    w = weight[bucket(s)]
    if w.any():
        return s[np.lexsort((s, w))[:k]]
    return s[:k]


def links(a: np.ndarray | int, b: np.ndarray | int, overlap: np.ndarray | int, percent: int):
    """Whether sets of sizes a and b with this overlap link, in whole numbers."""
    return (overlap * (100 + percent) >= percent * (a + b)) & (overlap > 0)


def product(at: np.ndarray, doc: np.ndarray, docs: int, rows: slice, cols: slice) -> np.ndarray:
    """Rows and columns of A times its transpose, for an incidence of docs by columns given as (column, document) in
    column order. Columns of fewer than DENSE documents add one for each of their pairs; the others are multiplied in
    blocks of COLUMNS."""
    high, wide = rows.stop - rows.start, cols.stop - cols.start
    out = np.zeros((high, wide), np.float32)
    if not len(at):
        return out
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    size = np.diff(np.append(first, len(at)))
    many = np.repeat(size, size)
    begin = np.repeat(first, size)
    left = np.flatnonzero((many < DENSE) & (doc >= rows.start) & (doc < rows.stop))
    ends = np.cumsum(many[left])
    lo = 0
    while lo < len(left):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
        own = left[lo:hi]
        k = many[own]
        other = doc[np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(begin[own], k)]
        cell = (np.repeat(doc[own], k) - rows.start) * wide + other - cols.start
        cell = cell[(other >= cols.start) & (other < cols.stop)]
        out += np.bincount(cell, minlength=high * wide).reshape(high, wide)
        lo = hi
    dense = many >= DENSE
    at, doc = at[dense], doc[dense]
    at = np.cumsum(np.append(0, at[1:] != at[:-1])) if len(at) else at
    last = int(at[-1]) + 1 if len(at) else 0
    for lo in range(0, last, COLUMNS):
        a, b = np.searchsorted(at, (lo, lo + COLUMNS))
        block = np.zeros((docs, min(COLUMNS, last - lo)), np.float32)
        block[doc[a:b], at[a:b] - lo] = 1
        out += block[rows] @ block[cols].T
    return out


def incidence(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(column, document) in column order, of the columns that several sets share."""
    h = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    same = h[1:] == h[:-1]
    keep = np.append(same, False) | np.append(False, same)
    at = np.cumsum(np.append(True, ~same))[keep]
    doc = doc[keep]
    return (np.cumsum(np.append(0, at[1:] != at[:-1])) if len(at) else at), doc


def overlaps(rows: list[np.ndarray], cols: list[np.ndarray]) -> np.ndarray:
    """The overlap of each set of rows with each of cols (the same list: with each other)."""
    square = rows is cols
    at, doc = incidence(rows if square else rows + cols)
    n = len(rows) if square else len(rows) + len(cols)
    return product(at, doc, n, slice(0, len(rows)), slice(0 if square else len(rows), n))


class Cell:
    """The documents of one cell (or of one block of a large cell) as they stream by."""

    def __init__(self, percent: int):
        self.percent, self.key = percent, None
        self.ids, self.sets, self.own, self.more, self.held = [], [], [], [], 0

    def product(self, a_ids, a, b_ids, b) -> np.ndarray:
        sizes_a, sizes_b = (np.array([len(x) for x in y], np.int64) for y in (a, b))
        found = np.argwhere(links(sizes_a[:, None], sizes_b[None, :], overlaps(a, b).astype(np.int64), self.percent))
        pairs = np.stack([np.array(a_ids, np.int64)[found[:, 0]], np.array(b_ids, np.int64)[found[:, 1]]], 1)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        return pairs if len(a) == 1 else forest(pairs)

    def add(self, key, role: int, doc: int, s: np.ndarray):
        out = []
        if key != self.key:
            out += self.end()
            self.key = key
        if role == 0:
            self.ids.append(doc)
            self.sets.append(s)
        else:
            self.own.append(doc)
            self.more.append(s)
            self.held += s.nbytes
            if len(self.own) == BLOCK or self.held >= STREAM_BYTES:
                out += self.stream()
        return out

    def stream(self):
        out = [self.product(self.ids, self.sets, self.own, self.more)] if self.ids and self.own else []
        self.own, self.more, self.held = [], [], 0
        return out

    def end(self):
        out = self.stream()
        if len(self.ids) > 1 and self.key is not None and not self.key[2]:
            out.append(self.product(self.ids, self.sets, self.ids, self.sets))
        self.ids, self.sets = [], []
        return out


def _profile(docs: DataFrame, width: int) -> DataFrame:
    """For each document its id, the hash of its text, size and digest of its set; and each task's most frequent counters
    of n-grams."""
    names = ["doc_id", "hash", "n", "digest", "bucket", "seen"]

    def run(batches):
        words, counts = WordHashes(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part, data in slices(batch, 2):
                sets = [shingle_set(x, words, width) for x in data]
                counts += np.bincount(bucket(np.concatenate(sets)), minlength=BUCKETS)
                n = len(sets)
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names)
        heavy = np.flatnonzero(counts > counts.mean() + 6 * counts.mean() ** 0.5 + 4)
        k = len(heavy)
        if k:
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.string()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(heavy), pa.array(counts[heavy])], names)

    return docs.mapInArrow(run, "doc_id long, hash string, n long, digest binary, bucket long, seen long")


def _entries(docs: DataFrame, reps: DataFrame, weight: np.ndarray, width: int, percent: int) -> DataFrame:
    """key, doc_id, n (its size): the columns that choose a document's blocks, of the documents reps and a few others."""
    sent = docs.sparkSession.sparkContext.broadcast((weight, _sieve(reps)))

    def make():
        words = WordHashes()
        heavy = np.zeros(BUCKETS, np.int64)
        heavy[sent.value[0][0]] = sent.value[0][1]

        def each(batch):
            for part, data in slices(_sieved(batch, 2, sent.value[1]), 1):
                sets = [shingle_set(x, words, width) for x in data]
                keys = [prefix(s, heavy, percent) if len(s) else s for s in sets]
                times = [len(k) for k in keys]
                ids, sizes = np.repeat(np.asarray(part.column(0)), times), np.repeat(np.array([len(s) for s in sets], np.int32), times)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(ids), pa.array(sizes)], ["key", "doc_id", "n"])

        return each

    return map_arrow(_marked(docs), make, "key long, doc_id long, n int")


def least_shared(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """For sizes a and b of a cell's documents: how many of the first columns each two must share to link. Columns
    behind the earlier end of their two prefixes add no more than what follows the longer prefix."""
    after = lambda n: -(-percent * n // 100) - 1  # noqa: E731  columns that are not among the first
    need = -(-percent * (a[:, None] + b[None, :]) // (100 + percent))
    return np.maximum(need - np.maximum(after(a)[:, None], after(b)[None, :]), 1)


PLACES = "cell long, doc_id long, n int, m int, all int, keys binary"
_NAMES = ["cell", "doc_id", "n", "m", "all", "keys"]


def _shared(entries: DataFrame) -> list[DataFrame]:
    """doc_id, n, key, cell of the columns that several documents share. Columns go by parts, one after the other, so that
    the disk holds the shuffles of one part at a time."""
    out = []
    for p in range(PARTS):
        own = entries.filter(F.pmod("key", F.lit(PARTS)) == p)
        columns = own.groupBy("key").agg(F.min("doc_id").alias("cell"), F.max("doc_id").alias("last"), F.count("*").alias("size"))
        shared = materialize(columns.filter("cell < last").select("key", "cell", "size"), "columns")
        out.append(materialize(join_groups(own, shared, ["key"], "size").select("doc_id", "n", "key", "cell"), "shared"))
        discard(shared)
    return out


def _places(held: DataFrame) -> DataFrame:
    """cell, doc_id, n, m, all, keys: a row for each cell of a document, with the document's columns there; m: how
    many cells the document has; all: how many columns in all of them. held: doc_id, n, key, cell."""

    def make():
        def each(batch):
            out = []
            for doc, n, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                cells, keys = (np.asarray(found.values.field(k)) for k in (0, 1))
                order = np.lexsort((keys, cells))
                cells, keys = cells[order], keys[order]
                cuts = np.append(0, np.flatnonzero(np.diff(cells)) + 1)
                out += [(int(cells[x]), doc, n, len(cuts), len(cells), keys[x:y].tobytes()) for x, y in zip(cuts, np.append(cuts[1:], len(cells)))]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], _NAMES)

        return each

    by_doc = held.groupBy("doc_id", "n").agg(F.collect_list(F.struct("cell", "key")).alias("found"))
    return map_arrow(by_doc, make, PLACES)


def survivors(rows: list[tuple], percent: int) -> list[int]:
    """Numbers of the rows (cell, doc_id, n, m, all, keys) of a cell that may link with another. Overlaps of the first
    columns are accumulated in the cell. A pair's other common columns lie in its other cells: they are at most as many
    as either has there, and where the pair has several common cells (the smaller m at most), one of them holds a fair
    share of all. The first bound keeps a linked pair in each of its cells, the second in one."""
    if len(rows) < 2:
        return []
    keys = [np.frombuffer(x[5], np.int64) for x in rows]
    n, m, every = (np.array([x[k] for x in rows], np.int64) for k in (2, 3, 4))
    elsewhere = every - np.array([len(k) for k in keys])
    at, doc = incidence(keys)
    out = []
    for lo in range(0, len(rows), BLOCK):
        own = slice(lo, min(lo + BLOCK, len(rows)))
        shared, need = product(at, doc, len(rows), own, slice(0, len(rows))), least_shared(n[own], n, percent)
        may = (shared > 0) & (shared + np.minimum(elsewhere[own, None], elsewhere[None, :]) >= need) & (shared * np.minimum(m[own, None], m[None, :]) >= need)
        may &= np.minimum(n[own, None], n[None, :]) * 100 >= percent * np.maximum(n[own, None], n[None, :])
        may[np.arange(own.stop - lo), np.arange(lo, own.stop)] = False
        out += (np.flatnonzero(may.any(1)) + lo).tolist()
    return out


def _prune(places: DataFrame, percent: int) -> DataFrame:
    """The places of documents that may link with another of their cell. Cells of more than PRODUCT documents pass; so do,
    where they lie, those of more than BLOCK that hold more than a thousandth of all places (fewer than a thousand)."""
    sizes = places.groupBy("cell").agg(F.count("*").alias("n"))
    total = places.count()
    hot = F.broadcast(sizes.filter((F.col("n") > BLOCK) & (F.col("n") * HOT > total)).select("cell"))
    dealt = places.join(hot, "cell", "left_anti").repartition("cell").sortWithinPartitions("cell", "doc_id")

    def run(batches):
        group, passing, cell = [], False, None
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        for batch in batches:
            out = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if row[0] != cell:
                    out += group if passing else [group[i] for i in survivors(group, percent)]
                    group, passing, cell = [], False, row[0]
                group.append(row)
                if len(group) > PRODUCT:
                    out, group, passing = out + group, [], True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], _NAMES)
        out = group if passing else [group[i] for i in survivors(group, percent)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], _NAMES)

    return dealt.mapInArrow(run, PLACES).unionByName(places.join(hot, "cell", "left_semi"))


def partners(a: list[np.ndarray], b: list[np.ndarray], n: np.ndarray, percent: int) -> np.ndarray:
    """Which of the documents of a and b have a partner in b (in a, if b is empty), by all their first columns: as many are
    common as their sizes (n, of both) ask for."""
    at, doc = incidence(a + b)
    cols, found = slice(len(a), len(n)) if b else slice(0, len(a)), np.zeros(len(n), bool)
    for lo in range(0, len(a), BLOCK):
        own = slice(lo, min(lo + BLOCK, len(a)))
        may = product(at, doc, len(n), own, cols) >= least_shared(n[own], n[cols], percent)
        may &= np.minimum(n[own, None], n[None, cols]) * 100 >= percent * np.maximum(n[own, None], n[None, cols])
        if not b:
            may[np.arange(own.stop - lo), np.arange(lo, own.stop)] = False
        found[own] |= may.any(1)
        found[cols] |= may.any(0)
    return found


def _paired(places: DataFrame, kept: DataFrame, percent: int) -> DataFrame:
    """The cell, doc_id of kept whose document has a partner in the cell by all its first columns, those of its other cells
    included. A cell's own columns leave open how many more two documents have in common, so with more documents ever
    more of them pass its bounds. Cells of more than BLOCK documents are cut into blocks, each compared with each."""
    marked = places.join(kept.withColumn("kept", F.lit(True)), ["cell", "doc_id"], "left")
    docs = marked.groupBy("doc_id", "n").agg(F.collect_list("keys").alias("keys"), F.collect_list(F.when(F.col("kept"), F.col("cell"))).alias("cells"))
    large = kept.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).filter("blocks > 1")
    rows = docs.withColumn("cell", F.explode("cells")).join(F.broadcast(large), "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc_id", "cell"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("role"), "doc_id", "n", "keys")
    dealt = rows.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "doc_id")

    def run(batches):
        group, cell = ([], []), None

        def ended():
            a, b = group
            if len(a) + len(b) < 2 or cell[1] != cell[2] and not (a and b):
                return
            every = a + b
            found = partners([x[2] for x in a], [x[2] for x in b], np.array([x[1] for x in every], np.int64), percent)
            ids = [x[0] for x, ok in zip(every, found) if ok]
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array([cell[0]] * len(ids), pa.int64()), pa.array(ids, pa.int64())], ["cell", "doc_id"])

        for batch in batches:
            for c, i, j, role, doc, n, keys in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if (c, i, j) != cell:
                    yield from ended()
                    group, cell = ([], []), (c, i, j)
                group[role].append((doc, n, np.frombuffer(b"".join(keys), np.int64)))
        yield from ended()

    return dealt.mapInArrow(run, "cell long, doc_id long").distinct()


def _multiply(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """u, v: links in cells. rows: cell, block, within, role, doc_id, z."""
    rows = rows.select("cell", "block", "crossed", "role", "doc_id", "z")
    dealt = rows.repartition("cell", "block").sortWithinPartitions("cell", "block", "role", "doc_id")

    def run(batches):
        words, cell = WordHashes(), Cell(percent)
        for batch in batches:
            out, columns = [], [batch.column(i).to_pylist() for i in range(6)]
            for c, b, crossed, role, doc, z in zip(*columns):
                out += cell.add((c, b, crossed), role, doc, shingle_set(zlib.decompress(z), words, width))
            if out:
                yield _edges(out)
        if out := cell.end():
            yield _edges(out)

    return dealt.mapInArrow(run, "u long, v long")


def _edges(found: list[np.ndarray]) -> pa.RecordBatch:
    own = np.concatenate(found).reshape(-1, 2).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1])], ["u", "v"])


def _sieve(ids: DataFrame) -> np.ndarray:
    """A bit map of SIEVE bits in which each doc_id sets one: what is told to the tasks has a fixed size."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(SIEVE))
    words = ids.select(bit.alias("b")).select(F.shiftright("b", 5).alias("word"), F.expr("shiftleft(1L, cast(b & 31 as int))").alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    bits = np.zeros(SIEVE // 32, np.uint32)
    bits[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64).astype(np.uint32)
    return bits


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, text and the document's bit of a bit map."""
    return docs.filter("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(SIEVE)).alias("b"))


def _sieved(batch: pa.RecordBatch, k: int, bits: np.ndarray) -> pa.RecordBatch:
    """The rows of a batch whose bit, in column k, is set."""
    b = np.asarray(batch.column(k))
    return batch.filter(pa.array((bits[b >> 5] >> (b & 31).astype(np.uint32)) & 1 == 1))


def _compressed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and compressed text of the documents among ids and a few others: tasks leave out most by a bit map."""
    sent = docs.sparkSession.sparkContext.broadcast(_sieve(ids))

    def make():
        bits = sent.value

        def each(batch):
            for part, data in slices(_sieved(batch, 2, bits), 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([zlib.compress(x, 1) for x in data], pa.binary())], ["doc_id", "z"])

        return each

    return map_arrow(_marked(docs), make, "doc_id long, z binary")


def similar(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, hash (text_hash of the text), n_shingles, component_id (smallest id that can be reached by links) of each
    document."""
    text = F.col(text_col).cast("string")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text).alias("hash"), text.alias("text"))
    profile = materialize(_profile(docs, width), "profile")
    sized = profile.filter("bucket is null").select("doc_id", "hash", "n", "digest")
    shared = sized.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    if not shared.isEmpty():
        return _by_rank(docs, sized, width, percent, block)
    return _similar(docs, profile, width, percent, block).drop("digest")


def _by_rank(docs: DataFrame, sized: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """similar() where ids repeat: a node for each id and text, numbered in their order. Nodes of one id are joined
    afterwards, so a cell never holds more than its nodes, and equal rows are one."""
    ranks, single = rank_texts(docs.filter("doc_id is not null"))
    ranks = materialize(ranks, "ranks")
    own = materialize(single(ranks).select(F.col("rank").alias("doc_id"), "hash", "text"), "texts")
    found = materialize(_similar(own, materialize(_profile(own, width), "profile"), width, percent, block), "found")
    first = ranks.groupBy("doc_id").agg(F.min("rank").alias("v"), F.count("*").alias("size"))
    edges = join_groups(ranks.select("doc_id", F.col("rank").alias("u")), first, ["doc_id"], "size").filter("u <> v").select("u", "v")
    joined = connected_components(edges.unionByName(found.filter("component_id <> doc_id").select(F.col("doc_id").alias("u"), F.col("component_id").alias("v"))))
    least = joined.join(ranks.select(F.col("rank").alias("component"), F.col("doc_id").alias("least")), "component").select(F.col("node").alias("rank"), "least")
    named = ranks.join(least, "rank", "left").select("doc_id", "hash", "rank", "n", F.coalesce("least", "doc_id").alias("component_id"))
    sizes = found.select(F.col("doc_id").alias("rank"), "digest", F.col("n_shingles"))
    whole = materialize(named.join(sizes, "rank"), "named")
    rows = join_groups(sized.filter("doc_id is not null").select("doc_id", "hash"), whole.select("doc_id", "hash", "n_shingles", "component_id", "n"), ["doc_id", "hash"], "n")
    classes = whole.filter("n_shingles > 0").groupBy("digest").agg(F.min("component_id").alias("component_id"))
    bare = sized.filter("doc_id is null").join(classes, "digest", "left").select("doc_id", "hash", F.col("n").alias("n_shingles"), "component_id")
    return rows.select("doc_id", "hash", "n_shingles", "component_id").unionByName(bare)


def _similar(docs: DataFrame, profile: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """similar(), with digest (of the set), for documents (doc_id, hash, text) whose ids don't repeat, but for null."""
    docs = docs.drop("hash")
    heavy = profile.filter("bucket is not null").groupBy("bucket").agg(F.sum("seen").alias("seen")).toPandas()  # BUCKETS rows at most
    weight = np.stack([heavy["bucket"].to_numpy(np.int64), heavy["seen"].to_numpy(np.int64)])

    # classes of equal sets; the smallest id stands for its class
    sized = profile.filter("bucket is null").select("doc_id", "hash", "n", "digest")
    classes = materialize(sized.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members")), "classes")
    reps = classes.filter("rep is not null").select(F.col("rep").alias("doc_id")).distinct()

    # cells
    entries = materialize(_entries(docs, reps, weight, width, percent), "entries")
    held = _shared(entries)
    discard(entries)
    places = materialize(_places(held[0] if len(held) == 1 else reduce(DataFrame.unionByName, held)), "places")
    for x in held:
        discard(x)
    may = materialize(_prune(places, percent).select("cell", "doc_id").join(reps, "doc_id", "left_semi").distinct(), "may")
    kept = materialize(_paired(places, may, percent), "kept")
    sizes = materialize(kept.groupBy("cell").agg(F.count("*").alias("size")).filter("size > 1").withColumn("members", F.col("size")), "sizes")
    cells = materialize(join_groups(kept, sizes, ["cell"], "members"), "cells")
    for x in (places, may, kept):
        discard(x)
    texts = _compressed(docs, cells.select("doc_id").distinct())

    # cells of one block, and the first step of larger ones
    small = cells.filter(F.col("size") <= block).select("cell", F.lit(0).alias("block"), F.lit(False).alias("crossed"), F.lit(0).alias("role"), "doc_id")
    large = cells.filter(F.col("size") > block)
    centres = large.groupBy("cell", "size").agg(F.min("doc_id").alias("doc_id"))
    part = F.pmod(F.xxhash64("doc_id", "cell"), F.ceil(F.col("size") / block)).cast("int")
    spread = centres.withColumn("block", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("size") / block) - 1).cast("int"))))
    first = spread.select("cell", "block", F.lit(True).alias("crossed"), F.lit(0).alias("role"), "doc_id").unionByName(large.select("cell", part.alias("block"), F.lit(True).alias("crossed"), F.lit(1).alias("role"), "doc_id"))
    # cells grow with the documents: one plan at every size, no broadcast while they happen to be few
    edges = materialize(_multiply(small.unionByName(first).hint("merge").join(texts, "doc_id"), width, percent), "links")
    if not large.isEmpty():
        edges = edges.unionByName(_rest(large, centres.select("cell", F.col("doc_id").alias("centre")), edges, docs, width, percent, block))
    components = connected_components(edges)
    named = classes.join(components, classes["rep"] == components["node"], "left")
    named = materialize(named.select("digest", F.coalesce("component", "rep").alias("component_id"), "members"), "components")
    linked = join_groups(sized.filter("n > 0"), named, ["digest"], "members").select("doc_id", "hash", "digest", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return linked.unionByName(sized.filter("n = 0").select("doc_id", "hash", "digest", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _rest(large: DataFrame, centres: DataFrame, edges: DataFrame, docs: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """Links of large cells among the documents that are not linked with their cell's centre, and between these and
    the others, block by block."""
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).select(F.col("u").alias("centre"), F.col("v").alias("doc_id")).distinct()
    members = large.join(centres, "cell").select("cell", "doc_id", "centre")
    linked = members.join(near, ["centre", "doc_id"], "left_semi").select("cell", "doc_id", F.lit(True).alias("near"))
    marked = members.join(linked, ["cell", "doc_id"], "left").select("cell", "doc_id", (F.col("near").isNotNull() | (F.col("doc_id") == F.col("centre"))).alias("near"))
    far = marked.filter("not near").groupBy("cell").agg(F.count("*").alias("n"))
    own = materialize(marked.join(far, "cell").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.when(~F.col("near"), F.pmod(F.xxhash64("doc_id", "cell"), F.col("blocks"))).cast("int")), "blocks")
    asks = own.filter("not near").select("cell", F.col("own").alias("block"), F.lit(False).alias("crossed"), F.lit(0).alias("role"), "doc_id")
    upto = F.when(F.col("near"), F.col("blocks")).otherwise(F.col("own"))  # blocks of smaller number see a far member
    told = own.filter(upto > 0).withColumn("block", F.explode(F.sequence(F.lit(0), (upto - 1).cast("int")))).select("cell", "block", F.lit(False).alias("crossed"), F.lit(1).alias("role"), "doc_id")
    return materialize(_multiply(asks.unionByName(told).hint("merge").join(_compressed(docs, own.select("doc_id").distinct()), "doc_id"), width, percent), "links")


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """The documents without those that link, directly or not, with one of smaller id; all columns are kept. Documents
    without words or without an id are kept."""
    drop = similar(docs, **how).filter("component_id < doc_id").select("doc_id", "hash")
    return without(docs, drop, how.get("id_col", "doc_id"), how.get("text_col", "text"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"), width=4, percent=85).drop("hash")
