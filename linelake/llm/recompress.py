"""Substring dedup by recompression: exact repeats of at least `window` words, within and across documents.

Recompression replaces the words of all documents by ever longer symbols, in Spark rounds. In a round each document's
sequence is first cut into runs of equal symbols, then, several times, into pairs: a bit of each symbol says whether it
is a left or a right one, and a left symbol is joined with a right one behind it. Whether two neighbours join depends
on these two alone, so equal substrings get equal symbols inside; only the outermost symbols at either end of a
substring can depend on what stands around it. Then Spark names the round's symbols globally: all places of a symbol
are brought together, the symbol is named by its first place, and each place learns this name. A symbol with one place
only stands in no repeat: it is dropped, and its neighbours are never joined across it. So the sequences shrink from
round to round to what is shared, until symbols are whole passages.

1. Rounds. The first takes the texts, each further one the named symbols of the one before.
2. Repeats are revealed by shared symbols. A place of a long symbol behind its first place is a repeat as a whole, so
   nothing inside it is looked at again. Of the other windows, those go on whose inner symbols of the first round are
   all shared; the name of the first of them and the distance to it say with which windows a window may be equal.
3. Repeats are verified by their words: what may be equal (windows and long symbols) is brought together by that name
   and a digest of its words, and what starts behind the first place of its kind is a repeat.
4. Each word that a repeat covers goes.

A window without an inner symbol (within one long run, say) is named by digests of its words alone.

The places of a symbol meet in one shuffle. Symbols that hold more than a thousandth of all places, which are about a
thousand at most, are left out of it: their first places are combined in the tasks and sent to all.

Defined results: words are runs without ASCII white space; null, empty and short texts hold no window and lose nothing;
of equal windows the one with the smallest (id, place) stays; a window may repeat one that it overlaps; rows without an
id lose nothing and take nothing from others; rows that share an id are documents of their own, in the order of a
64-bit hash of their texts, and equal rows are one document; an empty table gives no rows; columns of the input named
_n_words or _n_removed give way when these are asked for, all others stay.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linelake.llm.common import HOT, MULT, WordHashes, discard, extended, fresh, map_arrow, materialize, mix, slices, table

WINDOW = 20
ROUNDS = 3
PAIRINGS = 6  # of a later round
SLICE = 2 << 20  # bytes of text whose symbols are held at once
PLACE_BITS = 30  # of a place in its document, as a text has less than 2 ** 31 bytes; the document's rank has the rest
SHARE = 256  # of so many places one is looked at to find the most frequent symbols
LONG = 5  # symbols of the first round in a symbol that may be a repeat as a whole
LOW = (1 << PLACE_BITS) - 1


def pairings(window: int) -> int:
    """Pairings of the first round, so that a window mostly has three or four inner symbols."""
    return max(1, int(math.log(max(window, 8) / 6) / math.log(4 / 3) + 1e-9))


def parse(h: np.ndarray, cut: np.ndarray, levels: int, maps: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of a sequence and where they start, by one naming of runs and `levels` of pairs; and, with maps, two maps
    of all boundaries 0..n: a stretch from a to b has the inner symbols from later[a] to earlier[b], whatever stands around
    it (none where later[a] >= earlier[b]). cut: before which items the sequence is interrupted (the first is)."""
    n = len(h)
    later, earlier = (np.arange(n + 1 if maps else 0, dtype=np.int32) for _ in range(2))
    head = cut.copy()
    head[1:] |= h[1:] != h[:-1]
    start = np.flatnonzero(head).astype(np.int32)
    ends = np.append(start[1:], np.int32(n))
    count = ends - start
    sym = h[start]
    long = count > 1
    sym[long] = mix(sym[long] * MULT + count[long].astype(np.uint64))
    if maps:  # the outermost runs may go on outside
        later[:n], earlier[1:] = np.repeat(ends, count), np.repeat(start, count)
    step = later.copy()
    for level in range(1, levels + 1):
        after = np.append(start[1:], np.int32(n))
        left = (sym >> np.uint64(level)) & np.uint64(1) == 1  # names are random, and so are their bits
        if maps:
            inner = np.where(left, start, after)
            step[start], step[n] = inner, n
            later = step[later]
            step[0], step[after] = 0, inner
            earlier = step[earlier]
        pair = np.flatnonzero(left[:-1] & ~left[1:] & ~cut[start[1:]])
        joined = mix((sym[pair] + np.uint64(level)) * MULT + sym[pair + 1])
        keep = np.ones(len(sym), bool)
        keep[pair + 1] = False
        sym = sym.copy()
        sym[pair] = joined
        sym, start = sym[keep], start[keep]
    return sym, start, later, earlier


class Words:
    """The words of some documents in a row: names, where the documents begin and end, and the first round's symbols."""

    def __init__(self, data: list[bytes], names: WordHashes, levels: int, maps: bool = True):
        found = [names.of(x.split()) for x in data]
        self.h = np.concatenate(found)
        sizes = [len(x) for x in found]
        self.ends = np.cumsum(sizes)
        self.begins = np.append(0, self.ends[:-1])
        cut = np.zeros(len(self.h) + 1, bool)
        cut[self.begins] = True
        self.sym, self.start, self.later, self.earlier = parse(self.h, cut[:-1], levels, maps)
        self.of = np.repeat(np.arange(len(data), dtype=np.int32), sizes)  # document of each word
        self.doc = self.of[self.start]  # and of each symbol
        self.first = np.searchsorted(self.start, self.begins)  # symbol of each document

    def digests(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Digests of the words from a to b; equal words have equal ones wherever they stand."""
        n = len(self.h)
        up, down = _powers(n)
        sums = np.append(np.zeros(1, np.uint64), np.cumsum(self.h * up[:n]))
        return mix((sums[b] - sums[a]) * down[a])


_power: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2 ** 64, and their inverses, from 0 to n."""
    if not _power or len(_power[0]) <= n:
        base = int(MULT) | 1
        made = [np.full(2 * n + 1000, x, np.uint64) for x in (base, pow(base, -1, 1 << 64))]
        for x in made:
            x[0] = 1
        _power[:] = [np.cumprod(x, dtype=np.uint64) for x in made]
    return _power[0], _power[1]


def _numbers(column: pa.Array, kind=np.int64) -> np.ndarray:
    return np.asarray(pa.compute.fill_null(column, 0), kind)


def _first_symbols(own: DataFrame, window: int) -> DataFrame:
    """name, at: each place of a symbol of the first round. own: text, rank."""
    levels = pairings(window)

    def make():
        names = WordHashes()

        def each(batch):
            for part, data in slices(batch, 0, SLICE):
                w = Words(data, names, levels, maps=False)
                keep = (w.ends - w.begins >= window)[w.doc]
                doc = w.doc[keep]
                at = (_numbers(part.column(1))[doc] << PLACE_BITS) | (np.flatnonzero(keep) - w.first[doc])
                yield pa.RecordBatch.from_arrays([pa.array(w.sym[keep].view(np.int64)), pa.array(at)], ["name", "at"])

        return each

    return map_arrow(own, make, "name long, at long")


def _marks(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, place, count, name of the symbols in a column of lists, by document and place."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))
    flat = lists.flatten()
    doc = np.repeat(np.arange(len(sizes)), sizes)
    packed, name = np.asarray(flat.field(0)), np.asarray(flat.field(1))
    return doc, packed >> PLACE_BITS, packed & LOW, name


def _next_symbols(state: DataFrame) -> DataFrame:
    """at, count (of the first round's symbols that it spans), name, made: the symbols of a further round. Those that
    are not made keep their global name."""

    def make():
        def each(batch):
            doc, place, count, name = _marks(batch.column(1))
            if not len(doc):
                return
            cut = np.ones(len(doc), bool)
            cut[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + count[:-1])
            h = mix(name.view(np.uint64) * MULT + count.view(np.uint64))
            sym, start, _, _ = parse(h, cut, PAIRINGS)
            last = np.append(start[1:], len(doc)) - 1
            made = last > start
            at = (np.asarray(batch.column(0))[doc[start]] << PLACE_BITS) | place[start]
            span = place[last] + count[last] - place[start]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(span), pa.array(np.where(made, sym.view(np.int64), name[start])), pa.array(made)], ["at", "count", "name", "made"])

        return each

    return map_arrow(state.select("rank", "marks"), make, "at long, count long, name long, made boolean")


def _named(places: DataFrame, *keys: str) -> DataFrame:
    """The places whose symbol stands several times (in equal rows at one place), with `first`, the first of them: the
    symbol's global name. The places of a symbol are brought together once. Those of the most frequent symbols stay
    where they are and get the names by broadcast: symbols with more than a thousandth of all places, of which there
    are about HOT at most. Which these are is told from one place in SHARE (more of few places); it changes no result."""
    total = places.count()
    share = min(SHARE, max(1, total // (16 * HOT)))
    seen = places.filter(F.pmod(F.xxhash64("at"), F.lit(share)) == 0).groupBy(*keys).agg(F.count("*").alias("n"))
    hot = seen.filter(F.col("n") > max(16, total // (share * HOT))).drop("n").collect()
    own = W.partitionBy(*keys)
    rest, first = places, None
    if hot:
        much = F.broadcast(places.sparkSession.createDataFrame(hot, places.select(*keys).schema))
        mine, rest = (places.join(much, list(keys), how) for how in ("left_semi", "left_anti"))
        names = mine.groupBy(*keys).agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
        first = mine.join(F.broadcast(names), list(keys))
    named = rest.withColumns({"first": F.min("at").over(own), "n": F.count("*").over(own)}).filter("n > 1").drop("n")
    return named if first is None else named.unionByName(first)


def _by_document(rows: DataFrame, tag: str, column: str, low: str, value: str) -> DataFrame:
    """rank and a list of structs for each document of the rows, which have `at`: its place with `low` in one number,
    and `value`. The rows of a document are brought together in their order, and lists are cut from whole batches."""
    sorted_ = rows.select("at", F.col(low).cast("long"), F.col(value).cast("long")).repartition(F.shiftright("at", PLACE_BITS)).sortWithinPartitions("at")

    def run(batches):
        held: list[pa.RecordBatch] = []  # the rows of the last document so far
        for batch in batches:
            if not batch.num_rows:
                continue
            rank = np.asarray(batch.column(0)) >> PLACE_BITS
            if held and held[0].column(0)[0].as_py() >> PLACE_BITS != rank[0]:
                yield whole(held)
                held = []
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            if len(cuts):
                yield whole([*held, batch.slice(0, cuts[0])])
                if len(cuts) > 1:
                    yield lists(batch.slice(cuts[0], cuts[-1] - cuts[0]), cuts - cuts[0])
                held = []
                batch = batch.slice(cuts[-1])
            held.append(batch)
        if held:
            yield whole(held)

    def whole(parts):
        batch = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        return lists(batch, np.array([0, batch.num_rows]))

    def lists(batch, ends):
        at = np.asarray(batch.column(0))
        places = pa.array(((at & LOW) << PLACE_BITS) + np.asarray(batch.column(1)))
        rows = pa.StructArray.from_arrays([places, batch.column(2)], ["place", "name"])
        return pa.RecordBatch.from_arrays([pa.array(at[ends[:-1]] >> PLACE_BITS), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)], ["rank", column])

    return materialize(sorted_.mapInArrow(run, f"rank long, {column} array<struct<place: long, name: long>>"), tag)


def _rounds(own: DataFrame, window: int, rounds: int) -> tuple[DataFrame, list[DataFrame]]:
    """The named symbols of the first round by document, and the long symbols (at, count, name) of all further ones."""
    places = materialize(_first_symbols(own, window), "symbols")
    first = _by_document(_named(places, "name").select("at", F.lit(1).alias("count"), F.col("first").alias("name")), "state", "marks", "count", "name")
    discard(places)
    state, long = first, []
    for k in range(1, rounds):
        symbols = materialize(_next_symbols(state), "symbols")
        if state is not first:
            discard(state)
        named = materialize(_named(symbols.filter("made").select("at", "count", "name"), "name", "count").select("at", "count", F.col("first").alias("name")), "long")
        long.append(named)
        if k + 1 < rounds:
            state = _by_document(named.unionByName(symbols.filter("not made").select("at", "count", "name")), "state", "marks", "count", "name")
        discard(symbols)
    return first, long


def _candidates(marked: DataFrame, window: int) -> DataFrame:
    """symbol, digest, at, length of what may be a repeat or what a repeat repeats: long symbols, and windows that lie
    in no long symbol behind its first place and have no inner symbol with one place only. marked: text, rank, marks
    (of the first round), long (of the others)."""
    levels = pairings(window)

    def make():
        names = WordHashes()

        def each(batch):
            for part, data in slices(batch, 0, SLICE):
                w = Words(data, names, levels)
                rank, n = _numbers(part.column(1)), len(w.h)
                if not n:
                    continue
                # long symbols
                doc, place, count, name = _marks(part.column(3))
                i = w.first[doc] + place
                a, b = w.start[i].astype(np.int64), np.append(w.start, n)[i + count].astype(np.int64)
                behind = ((rank[doc] << PLACE_BITS) | place) > name
                keep = b - a >= window
                doc, count, name, a, b, behind = doc[keep], count[keep], name[keep], a[keep], b[keep], behind[keep]
                yield _rows(mix(name.view(np.uint64) * MULT + count.view(np.uint64)), w.digests(a, b), rank[doc], a - w.begins[doc], b - a)
                reach = np.zeros(n, np.int64)
                np.maximum.at(reach, a[behind], b[behind])
                reach = np.maximum.accumulate(reach)
                # windows
                doc, place, _, name = _marks(part.column(2))
                first = np.full(len(w.sym), -1, np.int64)
                first[w.first[doc] + place] = name
                single = np.append(0, np.cumsum(first < 0))
                p = np.arange(n)
                p = p[(p + window <= w.ends[w.of]) & (reach < p + window)]
                lo, hi = w.later[p], w.earlier[p + window]
                number = np.cumsum(np.bincount(w.start, minlength=n + 1)) - 1  # of the symbol that starts there
                number[n] = len(w.sym)
                inner = lo < hi
                some = ~inner | (single[number[np.minimum(lo, n)]] == single[number[np.minimum(hi, n)]])
                p, lo, inner = p[some], lo[some], inner[some]
                symbol = np.empty(len(p), np.uint64)
                symbol[inner] = mix(first[number[lo[inner]]].view(np.uint64)) + (lo[inner] - p[inner]).astype(np.uint64) * MULT
                q, other = p[~inner], np.zeros((~inner).sum(), np.uint64)
                for k in range(window):
                    other = mix(other * MULT + w.h[q + k])
                symbol[~inner] = other
                doc = w.of[p]
                yield _rows(symbol, w.digests(p, p + window), rank[doc], p - w.begins[doc], np.full(len(p), window))

        return each

    return map_arrow(marked, make, "symbol long, digest long, at long, length int")


def _rows(symbol: np.ndarray, digest: np.ndarray, rank: np.ndarray, place: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(symbol.view(np.int64)), pa.array(digest.view(np.int64)), pa.array((rank << PLACE_BITS) | place), pa.array(length.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, ["symbol", "digest", "at", "length"])


def _ranks(ids: DataFrame) -> DataFrame:
    """The columns of ids (doc_id and hash among them) and rank: places of the documents in their order, from a range-partitioned sort and its partitions'
    sizes."""
    sorted_ = materialize(ids.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash").select(*ids.columns, F.monotonically_increasing_id().alias("m")), "ids")
    part = F.shiftright("m", 33).alias("part")
    sizes = sorted_.groupBy(part).count().orderBy("part").collect()  # a row for each partition
    offsets, total = [], 0
    for r in sizes:
        offsets.append((r["part"], total))
        total += r["count"]
    if total >= 1 << (63 - PLACE_BITS):
        raise ValueError(f"{total} documents are more than places can tell apart")
    small = ids.sparkSession.createDataFrame(offsets, "part long, base long")
    low = F.col("m").bitwiseAND((1 << 33) - 1)
    return sorted_.select(*ids.columns, "m", part).join(F.broadcast(small), "part").select(*ids.columns, (F.col("base") + low).alias("rank"))


def rank_texts(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """doc_id, hash, n (how many rows share both), rank of the documents (doc_id, hash, text); and a function that joins
    the documents with a table of these columns and others: a row for each rank, however many rows are equal."""
    ranks = _ranks(docs.groupBy("doc_id", "hash").agg(F.count("*").alias("n")))
    several = not ranks.filter("n > 1").isEmpty()

    def single(by_rank: DataFrame) -> DataFrame:
        own = docs.join(by_rank, ["doc_id", "hash"])
        if not several:
            return own
        return own.filter("n = 1").unionByName(own.filter("n > 1").dropDuplicates(["rank"]))

    return ranks, single


def repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, hash (of the text), found: stretches whose words also start earlier (place: start, in words from 0, times
    2 ** PLACE_BITS, and length)."""
    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text")).filter("doc_id is not null and text is not null")
    ranks, single = rank_texts(own)
    first, long = _rounds(single(ranks).select("text", "rank"), window, rounds)
    several = long[0]
    for x in long[1:]:
        several = several.unionByName(x)
    passages = _by_document(several.filter(F.col("count") >= LONG), "passages", "long", "count", "name")
    marked = ranks.join(first, "rank", "left").join(passages, "rank", "left")
    found = materialize(_candidates(single(marked).select("text", "rank", "marks", "long"), window), "candidates")
    for x in (first, passages, *long):
        discard(x)
    later = _named(found, "symbol", "digest").filter("at > first")
    stretches = _by_document(later.select("at", "length", F.lit(0).alias("none")), "stretches", "found", "length", "none")
    discard(found)
    return stretches.join(ranks, "rank").select("doc_id", "hash", "found")


_word = re.compile(rb"[^\x20\x09-\x0D]+")


def remove(text: bytes, starts: np.ndarray, lengths: np.ndarray, layout: bool) -> tuple[bytes, int, int]:
    """The text without the words of the stretches, its words, and how many went. With layout, the rest of the
    text stays as it is; otherwise its words are joined by one space."""
    words = text.split()
    n = len(words)
    if not len(starts):
        return (text if layout else b" ".join(words)), n, 0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    gone = np.cumsum(edge[:n]) > 0
    if not layout:
        return b" ".join([w for w, g in zip(words, gone.tolist()) if not g]), n, int(gone.sum())
    begins = [m.start() for m in _word.finditer(text)] + [len(text)]
    change = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
    out, at = [], 0
    for a, b in zip(change[::2].tolist(), change[1::2].tolist()):
        out.append(text[at : begins[a]])
        at = begins[b]
    return b"".join([*out, text[at:]]), n, int(gone.sum())


def remove_repeats(docs: DataFrame, window: int = WINDOW, layout: bool = True, id_col: str = "doc_id", text_col: str = "text", counts: bool = True) -> DataFrame:
    """docs with the repeats cut from its text, and, with counts, _n_words and _n_removed. A null text stays null."""
    if counts:
        docs = docs.drop("_n_words", "_n_removed")
    found_id, found_hash, found = fresh(docs, "id", "hash", "found")
    stretches = repeats(docs, window, id_col, text_col).toDF(found_id, found_hash, found)
    same = (F.col(id_col).cast("long") == F.col(found_id)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(found_hash))
    joined = docs.join(stretches, same, "left").select(*[F.col(f"`{c}`") for c in docs.columns], found)
    k, last = docs.columns.index(text_col), len(docs.columns)
    schema = extended(docs.schema, _n_words="long", _n_removed="long") if counts else docs.schema
    names = schema.names

    def make():
        def each(batch):
            for part, data in slices(batch, k):
                lists = part.column(last)
                sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))
                flat, to = lists.flatten(), np.cumsum(sizes)
                start, length = np.asarray(flat.field(0)) >> PLACE_BITS, np.asarray(flat.field(0)) & LOW
                rows = [remove(x, start[b - n : b], length[b - n : b], layout) for x, n, b in zip(data, sizes.tolist(), to.tolist())]
                kept = pa.array([r[0] for r in rows], pa.binary()).cast(pa.string())
                if layout:
                    kept = pa.compute.if_else(pa.compute.is_valid(part.column(k)), kept, pa.scalar(None, pa.string()))
                own = [kept if i == k else part.column(i) for i in range(last)]
                if counts:
                    own += [pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())]
                yield pa.RecordBatch.from_arrays(own, names)

        return each

    return map_arrow(joined, make, schema)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), layout=False)
    return cut.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
