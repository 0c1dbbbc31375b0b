"""Hidden Markov language model: scores texts by their exact likelihood.

A text is a row of symbols with an end. The SYMBOLS most frequent words are symbols of their own; any other word is one
of CLASSES symbols (by its last characters), times the probability of the word within its class. So the model is a
distribution over whole texts of any words.

Counts of words come from all training documents, are combined in the tasks, and stay a table on the cluster; only the
counts of the most frequent words (HEAD at most) reach the tasks by broadcast, and the counts of all other words are
joined. Baum-Welch: each task runs the scaled forward and backward recursions over its training documents and emits
expected counts of starts, transitions and emissions; Spark sums them over all tasks, and the driver normalises a
table of fixed size. Scores come from the scaled forward recursion: the sum of the logarithms of its scales.

Training texts are those whose id's crc32 leaves a remainder other than 0 when divided by FOLDS.

Defined results: words are runs without ASCII white space, A-Z lower-cased; null and empty texts are the end alone; a
null id counts as an empty one, and is held out; with no training documents all words are unknown and all symbols
equally likely; repeated rows count as often as they stand, and get a row each; other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linelake.llm.common import MULT, SPACE, crc_mod, map_arrow, materialize, mix, slices, table

FOLDS = 10
STATES = 8
SYMBOLS = 16_384
CLASSES = 256
HEAD = 1 << 18
ROUNDS = 4
ADDED = 0.1  # to each count
END = 0  # the end's name
CHUNK = 200_000  # tokens whose recursions run side by side

LONG = 256  # bytes; words from here on are named one by one
SLICE = 1 << 20  # bytes of text whose words are named at once

_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first bytes of eight


@functools.cache
def _kinds() -> np.ndarray:
    """Classes by the last two bytes of a word, then those of words of one byte."""
    ends = [bytes([a, b]) for a in range(256) for b in range(256)] + [bytes([a]) for a in range(256)]
    return np.array([xxhash.xxh3_64_intdigest(x) & (CLASSES - 1) for x in ends], np.int64)


def word_names(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Names of the words of all texts, one after the other, and each text's number of words. A name has 63 bits, is not
    END, and its last bits are the word's class. All words are named at once, in blocks of eight bytes."""
    text = b" " + b" ".join(data).lower() + b" " * 8
    raw = np.frombuffer(text, np.uint8)
    space = SPACE[raw]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edges[::2], edges[1::2]
    length = end - start
    block = np.ndarray(len(raw) - 7, "<u8", text, strides=(1,))  # at each byte
    h = mix((block[start] & _KEEP[np.minimum(length, 8)]) + length.astype(np.uint64) * MULT)
    rest, at = np.flatnonzero(length > 8), 8
    while len(rest) and at < LONG:
        left = length[rest] - at
        h[rest] = mix(h[rest] * MULT + (block[start[rest] + at] & _KEEP[np.minimum(left, 8)]))
        rest, at = rest[left > 8], at + 8
    for i in rest.tolist():
        h[i] = xxhash.xxh3_64_intdigest(text[start[i] : end[i]])
    last = raw[end - 1].astype(np.int64)
    kind = _kinds()[np.where(length > 1, raw[end - 2].astype(np.int64) * 256 + last, 65_536 + last)]
    places = np.cumsum([len(x) + 1 for x in data])  # behind each text
    words = np.diff(np.searchsorted(start, places), prepend=0)
    return (h >> np.uint64(2)).astype(np.int64) & -CLASSES | 1 << 62 | kind, words


def _counts(docs: DataFrame) -> DataFrame:
    """name, n: how often each word stands in the training documents; a row for each name and some millions of words."""

    def run(batches):
        held, size = [], 0

        def emit():
            name, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(name), pa.array(n.astype(np.int64))], ["name", "n"])

        for batch in batches:
            for _, data in slices(batch, 0, SLICE):
                name, _ = word_names(data)
                held += [name, np.full(len(data), END, np.int64)]
                size += len(name) + len(data)
                if size > 4_000_000:
                    yield emit()
                    held, size = [], 0
        if held:
            yield emit()

    return docs.filter("not held_out").select("text").mapInArrow(run, "name long, n long")


@dataclass
class Vocabulary:
    names: np.ndarray  # of the head, sorted
    counts: np.ndarray
    symbols: np.ndarray  # of the head's names; -1: by class
    total: int  # N
    distinct: int  # V
    class_count: np.ndarray  # of words that go by class
    class_distinct: np.ndarray

    @property
    def size(self) -> int:
        return SYMBOLS + CLASSES + 1  # the last is the end

    def base(self, counts):
        return np.log10((counts + ADDED) / (self.total + ADDED * (self.distinct + 1)))

    def within(self) -> np.ndarray:
        """Denominators of the classes."""
        return self.class_count + ADDED * (self.class_distinct + 1)

    def frequencies(self) -> np.ndarray:
        """Probabilities of the symbols by their counts."""
        f = np.full(self.size, ADDED)
        own = self.symbols >= 0
        f[self.symbols[own]] += self.counts[own]
        f[SYMBOLS : SYMBOLS + CLASSES] += self.class_count
        return f / f.sum()


def vocabulary(counts: DataFrame) -> Vocabulary:
    kind = F.col("name").bitwiseAND(CLASSES - 1)
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # the least step of counts at and above which there are at most HEAD words: no task sends more than its part
    step = F.floor(F.log2("n") * 16)
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("v")).orderBy(F.desc("step")).collect()  # some hundred rows
    least, words = 1 << 30, 0
    for r in steps:
        words += r["v"]
        if words > HEAD:
            break
        least = r["step"]
    head = counts.filter((step >= least) | (F.col("name") == END)).toPandas().sort_values(["n", "name"], ascending=[False, True])
    by_class = counts.filter(F.col("name") != END).groupBy(kind.alias("kind")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()
    class_count, class_distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    class_count[by_class["kind"]] = by_class["n"]
    class_distinct[by_class["kind"]] = by_class["v"]
    name, n = head["name"].to_numpy(np.int64), head["n"].to_numpy(np.int64)
    symbols = np.full(len(name), -1)
    words = np.flatnonzero(name != END)[:SYMBOLS]
    symbols[words] = np.arange(len(words))
    symbols[name == END] = SYMBOLS + CLASSES
    np.subtract.at(class_count, name[words] & (CLASSES - 1), n[words])
    np.subtract.at(class_distinct, name[words] & (CLASSES - 1), 1)
    order = np.argsort(name)
    return Vocabulary(name[order], n[order], symbols[order], int(total), int(distinct), class_count, class_distinct)


class Head:
    """Places of names in the sorted names of the head, which their upper bits spread evenly."""

    def __init__(self, names: np.ndarray, bits: int = 20):
        self.names, self.shift = np.append(names, np.iinfo(np.int64).max), 62 - bits
        self.first = np.searchsorted(names, np.arange(1 << bits, 2 << bits) << self.shift)

    def __call__(self, name: np.ndarray) -> np.ndarray:
        """Below 0 for names that are not there."""
        at = self.first[(name >> self.shift) - (1 << 62 - self.shift)]
        rest = np.flatnonzero(self.names[at] < name)
        while len(rest):
            at[rest] += 1
            rest = rest[self.names[at[rest]] < name[rest]]
        return np.where(self.names[at] == name, at, -1)


ENCODED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, inside double, symbols binary, tail array<long>, times array<int>"


def _encode(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """Each document's symbols, what the head says about its words, and its words that are not in the head."""
    sent = docs.sparkSession.sparkContext.broadcast(v)
    names_out = [x.split()[0] for x in ENCODED.split(", ")]

    def make():
        v = sent.value
        head, kind = Head(v.names), v.names & (CLASSES - 1)
        # by place; the last is for words that are not in the head
        inside = np.append(np.where(v.symbols >= 0, 0.0, np.log10(v.counts + ADDED) - np.log10(v.within())[kind]), 0.0)
        base = np.append(v.base(v.counts), 0.0)
        symbol = np.append(np.where(v.symbols >= 0, v.symbols, SYMBOLS + kind), SYMBOLS + CLASSES).astype(np.uint16)
        end = 0 if len(v.names) and v.names[0] == END else -1
        unseen_end = 0.0 if end >= 0 else float(v.base(0))

        def each(batch):
            for part, data in slices(batch, 3, SLICE):
                name, words = word_names(data)
                last = np.cumsum(words + 1) - 1  # the ends' places
                first = last - words
                is_word = np.ones(int(last[-1]) + 1, bool)
                is_word[last] = False
                own = head(name)
                at = np.full(len(is_word), end)
                at[is_word] = own
                row, out = symbol[at], np.flatnonzero(own < 0)
                tail, doc = name[out], np.repeat(np.arange(len(words)), words)[out]
                row[np.flatnonzero(is_word)[out]] = SYMBOLS + (tail & (CLASSES - 1))
                order = np.lexsort((tail, doc))
                tail, doc = tail[order], doc[order]
                new = np.flatnonzero(np.append(True, (tail[1:] != tail[:-1]) | (doc[1:] != doc[:-1]))[: len(tail)])
                ends = pa.array(np.append(0, np.cumsum(np.bincount(doc[new], minlength=len(words)))), pa.int32())
                times = np.diff(new, append=len(tail)).astype(np.int32)
                starts = np.append(first, len(row)).astype(np.int32) * 2
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), part.column(2), pa.array(words + 1), pa.array(np.add.reduceat((at >= 0).astype(np.int64), first)),
                    pa.array(np.add.reduceat(base[at], first) + unseen_end), pa.array(np.add.reduceat(inside[at], first)),
                    pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(starts), pa.py_buffer(row)]),
                    pa.ListArray.from_arrays(ends, pa.array(tail[new])), pa.ListArray.from_arrays(ends, pa.array(times)),
                ], names_out)

        return each

    return map_arrow(docs.select("row", "doc_id", "held_out", "text"), make, ENCODED)


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # states by symbols

    @staticmethod
    def begin(frequencies: np.ndarray, states: int = STATES, seed: int = 7) -> Hmm:
        """States that stay, with emissions scattered around the frequencies."""
        emit = frequencies * np.exp(np.random.default_rng(seed).normal(0, 0.5, (states, len(frequencies))))
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return Hmm(np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True))

    def maximise(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, frequencies: np.ndarray) -> Hmm:
        """The model of expected counts, smoothed: no probability is 0."""
        start, move, emit = start + 0.1, move + 0.1, emit + 1000.0 * frequencies
        return Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def chunks(docs: list[np.ndarray], most: int = CHUNK) -> Iterator[list[int]]:
    """Numbers of documents of like length, of at most `most` tokens together (or one document)."""
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    at = 0
    while at < len(order):
        size, to = 0, at
        while to < len(order) and (to == at or size + len(docs[order[to]]) <= most):
            size += len(docs[order[to]])
            to += 1
        yield order[at:to]
        at = to


def side_by_side(docs: list[np.ndarray]) -> tuple[np.ndarray, list[int], list[int]]:
    """The symbols of all first places, then those of all second ones, and so on (docs are in order of falling length);
    how many documents have each place, and where its symbols begin."""
    lengths = np.array([len(x) for x in docs])
    count = len(docs) - np.cumsum(np.bincount(lengths))[:-1]
    at = np.cumsum(count) - count
    symbol = docs[0]
    if len(docs) > 1:
        step = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        symbol = np.empty(len(step), np.int64)
        symbol[at[step] + np.repeat(np.arange(len(docs)), lengths)] = np.concatenate(docs)
    return symbol, count.tolist(), at.tolist()


class Recursion:
    """Scaled forward (and backward) recursions of documents side by side; docs are in order of falling length."""

    def __init__(self, m: Hmm, docs: list[np.ndarray]):
        self.symbol, self.count, self.at = side_by_side(docs)
        self.m, one = m, np.ones(len(m.start))
        self.out = np.ascontiguousarray(m.emit.T)[self.symbol]
        self.alpha, self.scale = np.empty_like(self.out), np.empty(len(self.out))
        before = np.broadcast_to(m.start, (len(docs), len(m.start)))
        for t, (lo, n) in enumerate(zip(self.at, self.count)):
            a, c = self.alpha[lo : lo + n], self.scale[lo : lo + n]
            np.multiply(before[:n] @ m.move if t else before, self.out[lo : lo + n], out=a)
            np.dot(a, one, out=c)
            a /= c[:, None]
            before = a

    def expected(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, transitions and emissions. It can be had once, as it is computed in place."""
        m, s = self.m, len(self.m.start)
        move = np.zeros((s, s))
        b = np.ones((self.count[0], s))
        gamma, out = self.alpha, self.out
        out /= self.scale[:, None]
        back = np.ascontiguousarray(m.move.T)
        last = len(self.count) - 1
        for t in range(last, -1, -1):
            lo, n = self.at[t], self.count[t]
            if t < last:
                hi, k = self.at[t + 1], self.count[t + 1]
                w = out[hi : hi + k]
                w *= b[:k]
                move += gamma[lo : lo + k].T @ w
                np.dot(w, back, out=b[:k])
            gamma[lo : lo + n] *= b[:n]
        emit = np.stack([np.bincount(self.symbol, gamma[:, j], minlength=m.emit.shape[1]) for j in range(s)])
        return gamma[: self.count[0]].sum(0), move * m.move, emit


def log_likelihoods(m: Hmm, docs: list[np.ndarray]) -> np.ndarray:
    """Scaled forward recursions of documents side by side (in order of falling length): of each document one row of
    states and the sum so far are held, however long it is."""
    out = np.zeros(len(docs))
    if not docs:
        return out
    symbol, count, at = side_by_side(docs)
    emit, one = np.ascontiguousarray(m.emit.T), np.ones(len(m.start))
    a = np.broadcast_to(m.start, (len(docs), len(m.start)))
    for t, (lo, n) in enumerate(zip(at, count)):
        a = (a[:n] @ m.move if t else a) * emit[symbol[lo : lo + n]]
        c = a @ one
        a /= c[:, None]
        out[:n] += np.log(c)
    return out


def _symbols(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for x in column.to_pylist()]


def baum_welch(encoded: DataFrame, v: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> Hmm:
    """Train on the documents of `encoded` that are not held out."""
    spark, size = encoded.sparkSession, v.size
    f = v.frequencies()
    model = Hmm.begin(f, states)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def run(batches, sent=sent):
            m = sent.value
            sums = [np.zeros(states), np.zeros((states, states)), np.zeros((states, size))]
            for batch in batches:
                docs = _symbols(batch.column(0))
                for own in chunks(docs):
                    for total, part in zip(sums, Recursion(m, [docs[i] for i in own]).expected()):
                        total += part
            flat = np.concatenate([x.ravel() for x in sums])
            key = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(flat[key])], ["key", "value"])

        summed = encoded.filter("not held_out").select("symbols").mapInArrow(run, "key long, value double").groupBy("key").agg(F.sum("value").alias("value")).toPandas()
        flat = np.zeros(states + states * states + states * size)
        flat[summed["key"]] = summed["value"]
        start, move, emit = np.split(flat, [states, states + states * states])
        model = model.maximise(start, move.reshape(states, states), emit.reshape(states, size), f)
        sent.unpersist()
    return model


def _likelihoods(encoded: DataFrame, model: Hmm) -> DataFrame:
    sent = encoded.sparkSession.sparkContext.broadcast(model)

    def make():
        m = sent.value

        def each(batch):
            docs = _symbols(batch.column(1))
            out = np.zeros(len(docs))
            for own in chunks(docs):
                out[own] = log_likelihoods(m, [docs[i] for i in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(i) for i in range(2, batch.num_columns)), pa.array(out / math.log(10))], ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "inside", "likelihood"])

        return each

    return map_arrow(encoded.select("row", "symbols", "doc_id", "held_out", "n_tokens", "n_known", "base", "inside"), make, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, inside double, likelihood double")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (base-10 logarithms) of each document."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = own.withColumn("held_out", crc_mod(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), FOLDS) == 0).withColumn("row", F.monotonically_increasing_id())
    counts = materialize(_counts(own).groupBy("name").agg(F.sum("n").alias("n")), "counts")
    v = vocabulary(counts)
    encoded = materialize(_encode(own, v), "encoded")

    # words that are not in the head: their counts are joined
    tail = encoded.select("row", F.explode(F.arrays_zip("tail", "times")).alias("w")).select("row", F.col("w.tail").alias("name"), F.col("w.times").alias("times"))
    n = F.coalesce("n", F.lit(0))
    within = F.array(*[F.lit(math.log10(x)) for x in v.within().tolist()])
    seen = tail.join(counts, "name", "left").select("row", "times", n.alias("n"), F.log10(n + F.lit(ADDED)).alias("weight"), F.get(within, F.col("name").bitwiseAND(CLASSES - 1).cast("int")).alias("denominator"))
    sums = seen.groupBy("row").agg(F.sum(F.col("times") * F.col("weight")).alias("weights"), F.sum(F.col("times") * F.col("denominator")).alias("denominators"), F.sum("times").alias("n_tail"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known_tail"))
    sums = materialize(sums, "tail")

    scored = _likelihoods(encoded, baum_welch(encoded, v, states, rounds))
    log_all = math.log10(v.total + ADDED * (v.distinct + 1))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scored.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("known_tail")).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("weights") - zero("n_tail") * F.lit(log_all)).alias("base_score"),
        (F.col("likelihood") + F.col("inside") + zero("weights") - zero("denominators")).alias("score"),
    )


def op8_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
