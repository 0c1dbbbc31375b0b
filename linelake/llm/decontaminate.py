"""Benchmark decontamination with suffix arrays over the training documents.

Each task cuts its documents into shards and builds a suffix array over each shard's words. A word that no benchmark
item holds matches nothing, so it only ends a stretch; suffixes that begin in a stretch too short for any window are
left out. Every suffix of every item is then binary-searched in every shard: each further word narrows the range of
suffixes that agree with it, down to the longest verbatim match and all its places. All suffixes are searched
together, and those that agree share one range, so that the work grows with the words of the shard and the places that
match, not with their product.

The benchmark reaches the tasks by broadcast, in blocks of at most BLOCK_BYTES of text; a larger benchmark takes one
pass over the documents per block, one after the other. The documents then get row numbers in a stored table, and the
passes' results, not the texts, are shuffled and merged by these numbers.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A window is `width` consecutive
words of an item; an item of fewer words, but not none, is one window.

Defined results: null or empty texts have no words, no windows and no hits; an item id of null is the empty string;
items of equal id count once; an empty benchmark hits nothing; no documents give no rows; of equally long matches the
first item (by id as string), then the first place is reported; repeated documents and those of null id are judged each,
whatever the size of the benchmark, and one of them is removed for its own text alone; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linelake.llm.common import alnum_words, extended, map_arrow, materialize, slices, table, text_hash, without

WIDTH = 10
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 8 << 20

RESULT = {"n_words": "long", "n_hit": "long", "items": "array<string>", "spans": "array<struct<start:long,end:long>>", "longest": "long", "longest_item": "string", "longest_at": "long"}


@dataclass
class Tests:
    """A block of items as word numbers: words of all items in a row, and where the suffixes begin."""

    vocabulary: dict[bytes, int]
    words: np.ndarray
    starts: np.ndarray  # of suffixes that hold a window
    ends: np.ndarray  # of the suffixes' items
    need: np.ndarray  # window length of the suffixes' items
    item: np.ndarray  # number of the suffixes' items
    rank: np.ndarray  # of each item's id among the ids
    names: list[str]  # the distinct ids in their order

    @property
    def shortest(self) -> int:
        return int(self.need.min()) if len(self.need) else 1 << 30

    @property
    def longest(self) -> int:
        return int((self.ends - self.starts).max()) if len(self.need) else 0


def tests(items: list[tuple[str, bytes]], width: int = WIDTH) -> Tests:
    vocabulary: dict[bytes, int] = {}
    parts, sizes, names = [], [], []
    for name, text in sorted(items):
        found = alnum_words(text)
        parts.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary) + 1) for w in found), np.int64, len(found)))
        sizes.append(len(found))
        names.append(name)
    words = np.concatenate([*parts, np.zeros(0, np.int64)])
    n = np.array(sizes, np.int64)
    need = np.minimum(width, n)
    windows = np.where(n > 0, n - need + 1, 0)
    base = np.cumsum(n) - n
    starts = expand(base, base + windows)
    distinct = sorted(set(names))
    number = {x: i for i, x in enumerate(distinct)}
    rank = np.array([number[x] for x in names], np.int64)
    return Tests(vocabulary, words, starts, np.repeat(base + n, windows), np.repeat(need, windows), np.repeat(np.arange(len(n)), windows), rank, distinct)


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of s in the order of their first `depth` numbers, by prefix doubling."""
    rank, k = np.unique(s, return_inverse=True)[1].astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while k < depth:
        after = np.zeros(len(s), np.int64)
        after[:-k or None] = rank[k:] + 1 if k < len(s) else 0
        key = rank * (len(s) + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        new = np.cumsum(np.append(0, sorted_[1:] != sorted_[:-1]))
        rank = np.empty(len(s), np.int64)
        rank[order] = new
        if len(s) == 0 or new[-1] == len(s) - 1:
            break
        k *= 2
    return order


class Shard:
    """A suffix array over the stretches of known words of some documents; ids has 0 between documents."""

    def __init__(self, ids: np.ndarray, shortest: int, depth: int):
        known = np.flatnonzero(ids)
        cut = np.flatnonzero(np.diff(known) > 1) + 1
        begins, ends = known[np.append(0, cut)] if len(known) else known, known[np.append(cut, len(known)) - 1] + 1 if len(known) else known
        long = ends - begins >= shortest
        begins, ends = begins[long], ends[long]
        sizes = ends - begins + 1
        base = np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        self.place = np.arange(total) - np.repeat(base - begins, sizes)  # in ids
        self.s = np.where(np.arange(total) - np.repeat(base, sizes) < np.repeat(sizes - 1, sizes), ids[np.minimum(self.place, len(ids) - 1)], 0)
        room = np.repeat(base + sizes - 1, sizes) - np.arange(total)
        order = suffix_array(self.s, depth)
        self.sa = order[room[order] >= shortest]
        self.heads = self.s[self.sa]

    def narrow(self, lo: np.ndarray, hi: np.ndarray, depth: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts of the ranges lo..hi of suffixes, which agree in `depth` words, whose next one is `word`: both
        ends of all ranges by binary search at once."""
        if depth == 0:
            return np.searchsorted(self.heads, word, "left"), np.searchsorted(self.heads, word, "right")
        out = []
        for side in (word, word + 1):
            a, b = lo.copy(), hi.copy()
            left = np.flatnonzero(a < b)
            while len(left):
                mid = (a[left] + b[left]) >> 1
                less = self.s[self.sa[mid] + depth] < side[left]
                a[left[less]], b[left[~less]] = mid[less] + 1, mid[~less]
                left = left[a[left] < b[left]]
            out.append(a)
        return out[0], out[1]

    def matches(self, t: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows that occur: (suffix number in sa, words, number of the item) of each place and item; and for each
        number in sa the longest match there and its first item (0: no window occurs there). All suffixes of the items
        are searched together, word by word; where several of them agree, their common range is looked at once."""
        found, reach, best = [], np.zeros(len(self.sa), np.int64), np.zeros(len(self.sa), np.int64)
        k = np.arange(len(t.starts))
        lo, hi = np.zeros(len(k), np.int64), np.full(len(k), len(self.sa), np.int64)
        depth = 0
        while len(k):
            lo, hi = self.narrow(lo, hi, depth, t.words[t.starts[k] + depth])
            depth += 1
            there = lo < hi
            k, lo, hi = k[there], lo[there], hi[there]
            hit = t.need[k] <= depth
            order = np.lexsort((t.rank[t.item[k]], lo))
            order = order[hit[order]]
            first = order[np.append(True, lo[order][1:] != lo[order][:-1])] if len(order) else order
            at = expand(lo[first], hi[first])
            reach[at], best[at] = depth, np.repeat(t.rank[t.item[k[first]]], hi[first] - lo[first])
            new = np.flatnonzero(t.need[k] == depth)
            if len(new):
                kinds = np.unique(np.stack([lo[new], hi[new], t.rank[t.item[k[new]]]], 1), axis=0)
                found.append((kinds, depth))
            more = t.starts[k] + depth < t.ends[k]
            k, lo, hi = k[more], lo[more], hi[more]
        return found, reach, best


def expand(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    size = hi - lo
    return np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)


def spans(covered: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])]


def judge(texts: list[bytes], t: Tests) -> list[tuple]:
    """(n_words, n_hit, items, spans, longest, its item, its place) of each text, by one shard over all of them."""
    found = [np.fromiter((t.vocabulary.get(w, 0) for w in alnum_words(x)), np.int64) for x in texts]
    sizes = np.array([len(x) for x in found], np.int64)
    base = np.cumsum(sizes + 1) - (sizes + 1)
    ids = np.zeros(int((sizes + 1).sum()), np.int64)
    for b, x in zip(base, found):
        ids[b : b + len(x)] = x
    out = [(n, 0, [], [], 0, None, None) for n in sizes.tolist()]
    shard = Shard(ids, t.shortest, t.longest)
    found, reach, best = shard.matches(t)
    if not found:
        return out
    place = shard.place[shard.sa]
    doc = np.searchsorted(base, place, side="right") - 1
    edge = np.zeros(len(ids) + 1, np.int64)
    pairs = []
    for kinds, depth in found:
        ranges = np.unique(kinds[:, :2], axis=0)  # of a window that several items hold, once
        at = place[expand(ranges[:, 0], ranges[:, 1])]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + depth, -1)
        # documents of each range, then range by item, so that a window's places count once for each document
        number = np.repeat(np.arange(len(ranges)), ranges[:, 1] - ranges[:, 0])
        own = np.unique(number * len(texts) + doc[expand(ranges[:, 0], ranges[:, 1])])
        by = np.searchsorted(own // len(texts), np.arange(len(ranges) + 1))
        r = np.searchsorted(ranges[:, 0], kinds[:, 0])  # ranges of one length that begin alike are the same
        many = by[r + 1] - by[r]
        pairs.append(np.unique((own[expand(by[r], by[r + 1])] % len(texts)) * len(t.names) + np.repeat(kinds[:, 2], many)))
    covered = np.cumsum(edge[:-1]) > 0
    pairs = np.unique(np.concatenate(pairs))
    cuts = np.searchsorted(pairs // len(t.names), np.arange(len(texts) + 1))
    hits = np.flatnonzero(reach)
    hits = hits[np.lexsort((place[hits], best[hits], -reach[hits], doc[hits]))]
    hits = hits[np.append(True, doc[hits][1:] != doc[hits][:-1])]
    for h in hits.tolist():
        d = int(doc[h])
        own = covered[base[d] : base[d] + sizes[d]]
        items = [t.names[i] for i in (pairs[cuts[d] : cuts[d + 1]] % len(t.names)).tolist()]
        out[d] = (int(sizes[d]), int(own.sum()), items, spans(own), int(reach[h]), t.names[best[h]], int(place[h] - base[d]))
    return out


def _pass(docs: DataFrame, t: Tests) -> tuple[DataFrame, Broadcast]:
    """The columns of docs but the last, the text, with the results for a block of items; and the block as sent."""
    block = docs.sparkSession.sparkContext.broadcast(t)
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.int64(), pa.string(), pa.int64())
    own = docs.columns[:-1]
    names = [*own, *RESULT]

    def make():
        def each(batch):
            for part, data in slices(batch, len(own), SHARD_BYTES):
                rows = judge(data, block.value)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(own)], *(pa.array(list(c), k) for c, k in zip(zip(*rows), kinds))], names)

        return each

    return map_arrow(docs, make, extended(docs.drop("text").schema, **RESULT)), block


def _merge(passes: DataFrame) -> DataFrame:
    """The passes' results of each row as one."""
    open_ = "named_struct('done', cast(array() as array<struct<start:bigint,end:bigint>>), 'at', cast(-1 as bigint), 'to', cast(-1 as bigint))"
    joined = "if(x.start <= a.to, named_struct('done', a.done, 'at', a.at, 'to', greatest(a.to, x.end)), named_struct('done', if(a.to < 0, a.done, array_append(a.done, named_struct('start', a.at, 'end', a.to))), 'at', x.start, 'to', x.end))"
    closed = "if(a.to < 0, a.done, array_append(a.done, named_struct('start', a.at, 'end', a.to)))"
    every = passes.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("hash").alias("hash"), F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("every"), F.min(F.struct((-F.col("longest")).alias("less"), "longest_item", "longest_at")).alias("best"),
    ).withColumn("spans", F.expr(f"aggregate(every, {open_}, (a, x) -> {joined}, a -> {closed})"))
    n_hit = F.expr("aggregate(spans, cast(0 as bigint), (a, x) -> a + x.end - x.start)")
    return every.select("doc_id", "hash", "n_words", n_hit.alias("n_hit"), "items", "spans", (-F.col("best.less")).alias("longest"), "best.longest_item", "best.longest_at")


def find_matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per document: doc_id, hash (text_hash of its text), n_words, n_hit, items (ids of items with an occurring
    window), spans of hit words, and the longest verbatim match with its item and place (word numbers from 0)."""
    text = F.col(text_col).cast("string")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text).alias("hash"), text.alias("text"))
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * total // block_bytes) if total > block_bytes else 1)
    if blocks > 1:
        docs = materialize(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "hash", "text"), "documents")
    every = None
    for b in range(blocks):
        own = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        found, sent = _pass(docs, tests([(r.item, r.text.encode()) for r in own.toLocalIterator()], width))
        if blocks == 1:
            return found
        # each pass is stored, so that driver and tasks hold one block at a time
        found = materialize(found if every is None else found.filter("n_hit > 0"), "pass")
        sent.destroy()
        every = found if every is None else every.unionByName(found)
    return _merge(every)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that hold no window of the benchmark, with all their columns."""
    found = find_matches(docs, benchmark, **how).filter("n_hit > 0").select("doc_id", "hash")
    return without(docs, found, how.get("id_col", "doc_id"), how.get("text_col", "text"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "longest", "longest_item", "longest_at",
    )
