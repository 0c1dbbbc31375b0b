"""Collocations: phrases of two to five words that stand together more often than their parts would by chance.

Counts come from depth-limited tries. A shard is up to SHARD words of a task's texts; its trie is built level by level
in numpy (a node is its parent and a word, the root's children are the languages), serialised in the order of its words
and cut at the bounds of prefix ranges. The runs of one range meet in one task, which merges them window by window and
keeps the paths that reach the least count. Ranges are so many that each holds about RANGE places of phrases; their
bounds are quantiles of phrases drawn by hash, and only even out the work. A path that stands everywhere is one entry a
shard, so no phrase, however frequent, is more than that in any task.

A phrase is no more frequent than its parts, so words are counted first, then pairs of frequent words, then longer
phrases along frequent pairs. Tasks learn the frequent ones from a bit map of fixed size: one that is too full lets more
through, and changes no count.

The frequent paths, sorted, are one trie again. A walk along it gives the counts of each phrase's left parts from its
ancestors (what stands above the beginning of a range comes from the ends of the ranges before), and suffix links, from
a phrase to the one without its first word, hand on the counts of its right parts, one depth after the other.

Defined results: null texts are empty; a null language is `und`; a phrase lies within a piece of a text, which ends at
`. , ; : ! ?` or a line break; copies and repeated rows count each; ties go to the smallest cut, and in the ranking to
the larger count, then to the phrase in the order of its bytes; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import io
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linelake.llm.common import MULT, map_arrow, materialize, mix, slices, table

DEPTH = 5
LEAST = 100
TOP = 2000
SHARD = 1 << 20  # words of a shard
RANGE = 8 << 20  # places of phrases in a prefix range, about
WINDOW = 8192  # paths of a run that are looked at together
SIEVE = 1 << 27  # bits of the map of frequent words and pairs
DRAWN = 64  # phrases that a shard draws for the bounds

BREAK = b"."  # no word: the text's own are breaks
_breaks = bytes(10 if b in b".,;:!?\x0a\x0b\x0c\x0d" else b for b in bytes(range(256)).lower())


def pieces(text: bytes) -> bytes:
    """The text in lower case, with a break as a word of its own wherever a piece ends."""
    return text.translate(_breaks).replace(b"\n", b" . ") + b" . "


class Numbers(dict):
    """Word to its number, in the order of their first places."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class Shard:
    """Words of a task's texts, as numbers, with their languages."""

    def __init__(self):
        self.numbers = Numbers({BREAK: 0})
        self.langs: dict[str, int] = {}
        self.words: list[np.ndarray] = []
        self.lang: list[np.ndarray] = []
        self.size = 0

    def add(self, langs: list[str], texts: list[bytes]) -> None:
        counts, number = [], self.numbers.__getitem__
        for t in texts:
            own = pieces(t).split()
            counts.append(len(own))
            self.words.append(np.fromiter(map(number, own), np.int32, len(own)))
        self.lang.append(np.repeat(np.array([self.langs.setdefault(g, len(self.langs)) for g in langs], np.int32), counts))
        self.size += sum(counts)

    def trie(self, bits: np.ndarray | None = None) -> Trie:
        return Trie(list(self.langs), list(self.numbers), np.concatenate(self.lang), np.concatenate(self.words), bits)


def name(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode() + b"\0" + word)


def name_of_pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * MULT + second)


def in_sieve(bits: np.ndarray, names: np.ndarray) -> np.ndarray:
    at = (names % np.uint64(SIEVE)).astype(np.int64)
    return (bits[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1


class Trie:
    """Levels of a count trie: node j of a level has a parent in the level before, a last word and a count. Words are
    numbered in their order, and so are the nodes of a level in that of their paths. With a bit map, only the words of
    which it holds the names are there; without one, words are in any order and the first level is all there is."""

    def __init__(self, langs: list[str], words: list[bytes], lang: np.ndarray, word: np.ndarray, bits: np.ndarray | None = None):
        by_name = sorted(range(len(langs)), key=lambda i: langs[i].encode())
        place = np.empty(len(langs), np.int64)
        place[by_name] = np.arange(len(langs))
        self.langs = [langs[i] for i in by_name]
        wide = len(words)
        keys = place[lang] * wide + word
        count = np.bincount(keys, minlength=len(langs) * wide)
        count[::wide] = 0  # breaks
        nodes = np.flatnonzero(count)
        rank = np.full(wide, -1, np.int64)
        if bits is None:
            rank[:] = np.arange(wide)
            self.words = words
        else:
            names = np.fromiter((name(self.langs[k // wide], words[k % wide]) for k in nodes.tolist()), np.uint64, len(nodes))
            good = in_sieve(bits, names)
            nodes, names = nodes[good], names[good]
            order = sorted(np.unique(nodes % wide).tolist(), key=words.__getitem__)
            rank[order] = np.arange(len(order))
            self.words = [words[i] for i in order]
            turn = np.lexsort((rank[nodes % wide], nodes // wide))
            nodes, self.names = nodes[turn], names[turn]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(nodes // wide, rank[nodes % wide], count[nodes])]
        number = np.full(len(count), -1, np.int32)
        number[nodes] = np.arange(len(nodes))
        self.first = self.node = number[keys]  # of the path that begins at each place; -1 where there is none
        self.word = rank[word].astype(np.int32)

    def grow(self, live: np.ndarray, last: bool = False) -> None:
        """One more level, with the paths that begin where live says so and the path before is alive."""
        d = len(self.levels)
        at = np.flatnonzero(live)
        wide = np.int64(len(self.words))
        found = np.unique(self.node[at] * wide + self.word[at + d], return_inverse=not last, return_counts=True)
        self.levels.append((found[0] // wide, found[0] % wide, found[-1]))
        if not last:
            self.node = np.full(len(self.word), -1, np.int32)
            self.node[at] = found[1]

    def longer(self) -> np.ndarray:
        """Where the last level's paths can go on: the next word is there."""
        d = len(self.levels)
        out = self.node >= 0
        out[len(out) - d :] = False
        out[: len(out) - d] &= self.first[d:] >= 0
        return out

    def frequent_pairs(self, bits: np.ndarray) -> np.ndarray:
        """Where a pair begins of which the bit map holds the name."""
        at = np.flatnonzero(self.longer())
        out = np.zeros(len(self.word), bool)
        out[at] = in_sieve(bits, name_of_pair(self.names[self.first[at]], self.names[self.first[at + 1]]))
        return out

    def path(self, depth: int, j: int) -> tuple[bytes, ...]:
        """Language and words of node j."""
        own: list[bytes] = []
        for d in range(depth - 1, -1, -1):
            parent, word, _ = self.levels[d]
            own.append(self.words[word[j]])
            j = parent[j]
        return (self.langs[j].encode(), *own[::-1])

    def paths(self, depth: int) -> tuple[pa.Array, pa.Array]:
        """Languages and phrases of a level's nodes, in order."""
        words = pa.array(self.words, pa.binary())
        lang = text = None
        for parent, word, _ in self.levels[:depth]:
            last = words.take(pa.array(word))
            if text is None:
                lang, text = pa.array([x.encode() for x in self.langs], pa.binary()).take(pa.array(parent)), last
            else:
                up = pa.array(parent)
                lang, text = lang.take(up), pc.binary_join_element_wise(text.take(up), last, pa.scalar(b" "))
        return lang, text


def key(lang: bytes, phrase: bytes) -> tuple[bytes, ...]:
    return (lang, *phrase.split(b" "))


RUN = pa.schema([("lang", pa.binary()), ("path", pa.binary()), ("n", pa.int64())])


def serialised(rows: pa.Table) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, RUN, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows, max_chunksize=WINDOW)
    return sink.getvalue()


def cut(trie: Trie, depth: int, bounds: list[tuple[bytes, ...]]) -> Iterator[tuple[int, bytes]]:
    """A level of a trie by prefix ranges: range and its run, which is sorted."""
    lang, text = trie.paths(depth)
    rows = pa.Table.from_arrays([lang, text, pa.array(trie.levels[depth - 1][2].astype(np.int64))], schema=RUN)
    at, every = 0, range(len(lang))
    for r in range(len(bounds) + 1):
        to = bisect_left(every, bounds[r], lo=at, key=lambda j: trie.path(depth, j)) if r < len(bounds) else len(lang)
        if to > at:
            yield r, serialised(rows.slice(at, to - at))
        at = to


def merged(runs: list[bytes], least: int) -> Iterator[pa.Table]:
    """The k-way merge of sorted runs: windows of all runs up to the smallest path that a run with more to come has got to
    are added up together."""
    streams = [pa.ipc.open_stream(r) for r in runs]
    heads = [next(s, None) for s in streams]
    after = [next(s, None) for s in streams]
    while any(h is not None for h in heads):
        open_ = [h for h, more in zip(heads, after) if h is not None and more is not None]
        last = min((key(h["lang"][-1].as_py(), h["path"][-1].as_py()) for h in open_), default=None)
        taken = []
        for i, h in enumerate(heads):
            if h is None:
                continue
            lang, path = h["lang"], h["path"]
            n = h.num_rows if last is None else bisect_right(range(h.num_rows), last, key=lambda j: key(lang[j].as_py(), path[j].as_py()))
            if n:
                taken.append(h.slice(0, n))
            if n < h.num_rows:
                heads[i] = h.slice(n)
            else:
                heads[i], after[i] = after[i], next(streams[i], None)
        sums = pa.Table.from_batches(taken).group_by(["lang", "path"]).aggregate([("n", "sum")])
        sums = sums.filter(pc.greater_equal(sums["n_sum"], least))
        if sums.num_rows:
            yield sums.select(["lang", "path", "n_sum"])


def _shards(docs: DataFrame, work, schema: str) -> DataFrame:
    """work(shard) gives the batches of each shard."""

    def run(batches):
        shard = Shard()
        for batch in batches:
            for part, data in slices(batch, 1):
                shard.add(part.column(0).to_pylist(), data)
                if shard.size >= SHARD:
                    yield from work(shard)
                    shard = Shard()
        if shard.size:
            yield from work(shard)

    return docs.mapInArrow(run, schema)


def _words(docs: DataFrame, deepest: int) -> DataFrame:
    """kind, lang, path, n: the words of each shard (w), all words of a language (n), phrases for the bounds (b)."""

    def work(shard: Shard):
        trie = shard.trie()
        lang, text = trie.paths(1)
        parent, _, count = trie.levels[0]
        total = np.bincount(parent, count, len(trie.langs)).astype(np.int64)
        langs = pa.array([x.encode() for x in trie.langs], pa.binary())
        # places spread over the shard, of phrases of up to three words
        at = np.unique(np.linspace(0, len(trie.word) - 1, DRAWN).astype(np.int64))
        at = at[trie.word[at] > 0]  # breaks are 0
        drawn = []
        for i in at.tolist():
            own = trie.word[i : i + min(3, deepest)].tolist()
            own = own[: own.index(0)] if 0 in own else own
            drawn.append((trie.langs[parent[trie.node[i]]].encode(), b" ".join(trie.words[w] for w in own)))
        for kind, a, b, n in (("w", lang, text, count), ("n", langs, pa.array([b""] * len(langs), pa.binary()), total), ("b", *(pa.array([x[k] for x in drawn], pa.binary()) for k in (0, 1)), np.ones(len(drawn), np.int64))):
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(a), pa.string()), a.cast(pa.string()), b, pa.array(n)], ["kind", "lang", "path", "n"])

    return _shards(docs, work, "kind string, lang string, path binary, n long")


def _bounds(drawn: DataFrame, ranges: int) -> list[tuple[bytes, ...]]:
    """Quantiles of drawn phrases; at most 32 a range come to the driver."""
    some = drawn.orderBy(F.xxhash64("lang", "path", F.monotonically_increasing_id())).limit(32 * ranges).select("lang", "path").collect()
    every = sorted(key(x.lang.encode(), bytes(x.path)) for x in some)
    return sorted({every[len(every) * r // ranges] for r in range(1, ranges)}) if every else []


def _sieve(frequent: DataFrame) -> np.ndarray:
    """A bit map in which each frequent path sets the bit of its name."""

    def make():
        def each(batch):
            names = []
            for lang, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.array([name(lang, w) for w in path.split(b" ")], np.uint64)
                names.append(own[0] if len(own) == 1 else name_of_pair(own[:1], own[1:])[0])
            at = (np.array(names, np.uint64) % np.uint64(SIEVE)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(np.int64(1) << (at & 31))], ["word", "mask"])

        return each

    rows = map_arrow(frequent.select("lang", "path"), make, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    bits = np.zeros(SIEVE // 32, np.uint32)
    bits[rows["word"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64).astype(np.uint32)
    return bits


def _frequent(docs: DataFrame, bounds: list, words: np.ndarray, pairs: np.ndarray | None, deepest: int, least: int) -> DataFrame:
    """lang, path, n of the frequent pairs of frequent words; with the bit map of frequent pairs, of longer phrases."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((bounds, words, pairs))

    def work(shard: Shard):
        bounds, words, pairs = sent.value
        trie = shard.trie(words)
        if pairs is None:
            trie.grow(trie.longer(), last=True)
        else:
            live = fine = trie.frequent_pairs(pairs)
            trie.grow(live)
            for d in range(3, deepest + 1):
                live = trie.longer() & live
                live[: 2 - d] &= fine[d - 2 :]
                if not live.any():
                    break
                trie.grow(live, last=d == deepest)
        rows = [x for d in range(2 if pairs is None else 3, len(trie.levels) + 1) for x in cut(trie, d, bounds)]
        for lo in range(0, len(rows), 64):
            some = rows[lo : lo + 64]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in some], pa.int64()), pa.array([x for _, x in some], pa.binary())], ["range", "run"])

    def merge(rows: pa.Table) -> pa.Table:
        found = list(merged(rows["run"].to_pylist(), least))
        out = pa.concat_tables(found) if found else RUN.empty_table()
        return pa.Table.from_arrays([out.column(0).cast(pa.string()), out.column(1), out.column(2)], ["lang", "path", "n"])

    runs = _shards(docs, work, "range long, run binary")
    return runs.groupBy("range").applyInArrow(merge, "lang string, path binary, n long")


def _walk(trie: DataFrame) -> DataFrame:
    """lang, path, depth, n, lefts (the counts of the first 1, 2, ... words), stem and link (the path without its last and
    without its first word) of each path of a trie, in the order of its paths. Ancestors in earlier ranges are missing at the beginning of lefts; the row `end` of each range has those
    of what follows: its path is null, and lefts are the counts along its last path."""
    words = F.split(F.col("path").cast("string"), " ")
    rows = trie.select("lang", "path", "n", words.alias("w")).repartitionByRange("lang", "w").sortWithinPartitions("lang", "w").select("lang", "path", "n")

    def run(batches):
        part, stack = TaskContext.get().partitionId(), []
        names = ["lang", "path", "depth", "n", "lefts", "stem", "link", "part", "ends"]
        kinds = [pa.string(), pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.binary())]
        for batch in batches:
            out = []
            for lang, path, n in zip(*(c.to_pylist() for c in batch.columns)):
                own = key(lang.encode(), path)
                while stack and own[: len(stack[-1][0])] != stack[-1][0]:
                    stack.pop()
                out.append((lang, path, len(own) - 1, n, [x for _, x in stack], b" ".join(own[1:-1]), b" ".join(own[2:]), part, None))
                stack.append((own, n))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names)
        if stack:
            row = ("", None, len(stack), 0, [x for _, x in stack], None, None, part, [*stack[-1][0]])
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)

    return rows.mapInArrow(run, "lang string, path binary, depth int, n long, lefts array<long>, stem binary, link binary, part int, ends array<binary>")


def _with_lefts(trie: DataFrame, tag: str) -> DataFrame:
    """The rows of _walk, whole."""
    walked = materialize(_walk(trie), tag)
    ends = walked.filter("path is null").orderBy("part").collect()  # one a range
    carried, open_ = [], []  # open_: (path, count) along the last path so far
    for e in ends:
        carried.append((e.part, [n for _, n in open_]))
        last = tuple(bytes(x) for x in e.ends)
        own = [(last[: len(last) - e.depth + i + 1], n) for i, n in enumerate(e.lefts)]
        open_ = [x for x in open_ if last[: len(x[0])] == x[0] and len(x[0]) < len(own[0][0])] + own
    above = trie.sparkSession.createDataFrame(carried, "part int, above array<long>")
    missing = F.col("depth") - 1 - F.size("lefts")
    lefts = F.when(missing > 0, F.concat(F.slice("above", F.lit(1), missing), F.col("lefts"))).otherwise(F.col("lefts"))
    return walked.filter("path is not null").join(F.broadcast(above), "part").select("lang", "path", "depth", "n", lefts.alias("lefts"), "stem", "link")


def _with_rights(trie: DataFrame, deepest: int) -> DataFrame:
    """The phrases of two words and more, with rights: the counts of all but the first 1, 2, ... words."""
    done = [trie.filter("depth = 1").select("lang", "path", "n", F.array().cast("array<long>").alias("rights"))]
    out = []
    for d in range(2, deepest + 1):
        right = done[-1].select(F.col("lang").alias("r_lang"), F.col("path").alias("r_path"), F.col("n").alias("r_n"), F.col("rights").alias("r_rights"))
        rows = trie.filter(F.col("depth") == d).join(right, (F.col("lang") == F.col("r_lang")) & (F.col("link") == F.col("r_path")))
        rows = materialize(rows.select("lang", "path", "n", "lefts", "stem", "link", F.concat(F.array("r_n"), "r_rights").alias("rights")), f"links{d}")
        out.append(rows)
        done.append(rows)
    every = out[0]
    for rows in out[1:]:
        every = every.unionByName(rows)
    return every


def collocations(docs: DataFrame, deepest: int = DEPTH, least: int = LEAST, top: int | None = TOP, lang_col: str = "lang", text_col: str = "text", places: int = RANGE) -> DataFrame:
    """lang, rank, phrase, a (its count), l and r (of both parts at the cut with the lowest score), n (all words of the
    language), score = floor(1000 a n / (l r)) of the phrases that stand `least` times, but those that are always part of one
    longer phrase. The first `top` of each language, or all."""
    own = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    seen = materialize(_words(own, deepest), "words")
    totals = seen.filter("kind = 'n'").groupBy("lang").agg(F.sum("n").alias("total"))
    words = materialize(seen.filter("kind = 'w'").groupBy("lang", "path").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "level1")
    ranges = max(1, -(-(deepest - 1) * (seen.filter("kind = 'n'").agg(F.sum("n")).first()[0] or 0) // places))
    bounds = _bounds(seen.filter("kind = 'b'"), ranges)
    single = _sieve(words)
    pairs = materialize(_frequent(own, bounds, single, None, 2, least), "level2")
    found = words.unionByName(pairs)
    if deepest > 2:
        found = found.unionByName(materialize(_frequent(own, bounds, single, _sieve(pairs), deepest, least), "level3"))
    trie = materialize(_with_lefts(found, "walk"), "trie")
    every = _with_rights(trie, deepest)
    # always part of a phrase that is one word longer, or longer still: then the one between is as frequent
    inner = every.filter("size(lefts) > 1")
    held = inner.filter("element_at(lefts, -1) = n").select("lang", F.col("stem").alias("path")).union(inner.filter("rights[0] = n").select("lang", F.col("link").alias("path"))).distinct()
    big = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = F.transform(F.arrays_zip("lefts", "rights"), lambda x: F.struct(x.lefts.alias("l"), x.rights.alias("r")))
    scored = every.join(held, ["lang", "path"], "left_anti").join(totals, "lang").withColumn("cuts", cuts)
    scored = scored.withColumn("a", big("n")).withColumn("total_", big("total"))
    score = "transform(cuts, (x, i) -> struct(cast(1000 as decimal(4,0)) * a * total_ div (cast(x.l as decimal(19,0)) * cast(x.r as decimal(19,0))) as score, i as k, x.l as l, x.r as r))"
    best = scored.withColumn("best", F.array_min(F.expr(score)))
    rows = best.select("lang", F.col("path").cast("string").alias("phrase"), F.col("n").alias("a"), "best.l", "best.r", F.col("total").alias("n"), "best.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = rows.withColumn("rank", rank)
    ranked = ranked if top is None else ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
