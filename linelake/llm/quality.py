"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good (1), bad (-1) or nothing (0) on each document. Expectation-maximisation over
all documents estimates each labeller's accuracy and the share of good documents, without any labels: the counts of
vote patterns, of which there are at most 3 ** labellers, are all that it needs, and they are summed over all documents.
Each document's posterior is then the soft label for a linear scorer over hashed features of word shapes, which also
judges what no labeller covers. The scorer is fitted on the driver from at most SAMPLE documents, chosen by the hashes
of their ids and texts (equal rows once); all documents are scored whole.

Features and votes come from one pass over the texts and are a small table from then on.

Defined results: null and empty texts get no votes and no features, and are kept; rows that repeat
an id are each judged, and removed, by their own text; a null id is an id like any other; an empty table gives no rows; with no votes at all every text
is kept; ties (a score of 0.5) are kept; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linelake.llm.common import map_arrow, materialize, rolling, slices, table, text_hash, without

SAMPLE = 20_000
DIMENSIONS = 1 << 14
KEEP = 0.5

_symbol = regex.compile(r"[^\w\s.,;:!?'\"()-]")
_plain = regex.compile(r"\p{L}\p{Ll}*[.,;:!?]?")
_shape = [(regex.compile(r"\p{Lu}+"), "A"), (regex.compile(r"[^\P{L}A]+"), "a"), (regex.compile(r"\p{N}+"), "0")]


class Words(dict):
    """Word to its number in `facts`, whose columns are: the feature of the word's shape, characters that are no letters
    or digits, all characters, flags. Flags: 1 capitals, 2 symbols, 4 a bar, 8 plain, 16 short and lower-case. `names`
    has 64-bit names of the words."""

    def __init__(self):
        super().__init__()
        self.facts, self.names = np.zeros((0, 4), np.int64), np.zeros(0, np.uint64)
        self.new: list[tuple[int, int, int, int, int]] = []

    def __missing__(self, word: bytes) -> int:
        w = word.decode("utf-8", "replace")
        shape = w
        for pattern, to in _shape:
            shape = pattern.sub(to, shape)
        shape = shape[:6] + shape[-6:] if len(shape) > 12 else shape
        letters = [c for c in w if c.isalpha()]
        flags = (len(letters) > 1 and all(c.isupper() for c in letters)) + 2 * bool(w != "|" and _symbol.search(w)) + 4 * (w == "|")
        flags += 8 * bool(_plain.fullmatch(w)) + 16 * (len(w) <= 3 and w.islower() and w.isalpha())
        self.new.append((xxhash.xxh3_64_intdigest(shape.encode()) % DIMENSIONS, sum(not c.isalnum() for c in w), len(w), flags, xxhash.xxh3_64_intdigest(word)))
        number = self[word] = len(self)
        return number

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Facts and names of the words."""
        if len(self) > 300_000:
            self.clear()
            self.facts, self.names = self.facts[:0], self.names[:0]
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            self.facts = np.concatenate([self.facts, np.array([x[:4] for x in self.new], np.int64)])
            self.names = np.concatenate([self.names, np.array([x[4] for x in self.new], np.uint64)])
            self.new = []
        return self.facts[numbers], self.names[numbers]


def _vote(share: np.ndarray, bad: float, good: float = -np.inf) -> np.ndarray:
    return np.where(share >= bad, -1, np.where(share <= good, 1, 0))


#: Names of the labellers, in the order of their votes. The first five see one defect each and never vote good; each
#: defect also moves some of the others.
LABELLERS = ("symbols", "bars", "capitals", "repetition", "variety", "plainness", "punctuation", "function words")

#: Words in a row of which the labeller of variety counts the distinct ones: single words repeat the more the longer a
#: good text is, runs of four don't.
RUN = 4


class Texts:
    """Votes and features of some documents in a row."""

    def __init__(self, data: list[bytes], table_: Words):
        found = [x.split() for x in data]
        facts, self.names = table_.of([w for own in found for w in own])
        self.docs, self.n = len(data), np.array([len(x) for x in found], np.int64)
        self.doc = np.repeat(np.arange(self.docs), self.n)
        self.shape, self.marks, self.size, self.flags = facts.T
        within = self.doc[1:] == self.doc[:-1]
        self.follows = np.flatnonzero(within)  # words that another of the same document follows
        self.same = self.count(self.doc[1:][within & (self.names[1:] == self.names[:-1])])

    def count(self, doc: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(doc, weights, minlength=self.docs)

    def distinct_runs(self) -> np.ndarray:
        """Share of distinct runs of RUN words among all of a document; 1 where there is none."""
        m = len(self.names) - RUN + 1
        if m < 1:
            return np.ones(self.docs)
        p = np.flatnonzero(self.doc[:m] == self.doc[RUN - 1 :])
        run, own = rolling(self.names, RUN)[p], self.doc[p]
        order = np.lexsort((run, own))
        run, own = run[order], own[order]
        new = np.ones(len(p), bool)
        new[1:] = (run[1:] != run[:-1]) | (own[1:] != own[:-1])
        return np.where(self.n >= RUN, self.count(own[new]) / np.maximum(self.n - RUN + 1, 1), 1.0)

    def votes(self) -> np.ndarray:
        n = np.maximum(self.n, 1)
        share = [self.count(self.doc[self.flags & bit > 0]) / n for bit in (1, 2, 4, 8, 16)]
        same = self.same / n
        marks = self.count(self.doc, self.marks) / np.maximum(self.count(self.doc, self.size), 1)
        plain = np.maximum(0.0, share[3] - same)
        some = self.n >= 20
        every = [
            _vote(share[1], 0.1),
            _vote(share[2], 0.1),
            _vote(share[0], 0.15),
            _vote(same, 0.1),
            np.where(some, _vote(-self.distinct_runs(), -0.5), 0),
            np.where(plain >= 0.85, 1, np.where(plain < 0.7, -1, 0)),
            _vote(marks, 0.09, 0.06),
            np.where(some, np.where((share[4] >= 0.08) & (same < 0.1), 1, np.where(share[4] < 0.04, -1, 0)), 0),
        ]
        return np.where(self.n[:, None] > 0, np.stack(every, 1), 0)

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many features each document has, their numbers and values: counts of word shapes, of pairs of shapes, and
        of words that repeat the one before or don't; of length 1 together."""
        f = self.follows
        pairs = (self.shape[f] * 31 + self.shape[f + 1] * 17) % DIMENSIONS
        some = np.flatnonzero(self.n)
        keys, counts = np.unique(np.concatenate([self.doc * DIMENSIONS + self.shape, self.doc[f] * DIMENSIONS + pairs, some * DIMENSIONS + 1, some * DIMENSIONS + 2]), return_counts=True)
        counts = counts.astype(np.float64)
        counts[np.searchsorted(keys, some * DIMENSIONS + 1)] += self.same[some] - 1
        counts[np.searchsorted(keys, some * DIMENSIONS + 2)] += (self.n - self.same)[some] - 1
        doc = keys // DIMENSIONS
        return self.count(doc), keys % DIMENSIONS, counts / np.sqrt(self.count(doc, counts * counts))[doc]


def vote_pattern(votes: np.ndarray) -> np.ndarray:
    return (votes + 1) @ 3 ** np.arange(len(LABELLERS) - 1, -1, -1)


def unpattern(pattern: np.ndarray) -> np.ndarray:
    k = len(LABELLERS)
    return (pattern[:, None] // 3 ** np.arange(k - 1, -1, -1)[None, :]) % 3 - 1


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, hash (text_hash of the text), pattern of votes, features (numbers and values) of each document."""

    def make():
        table_ = Words()

        def each(batch):
            for part, data in slices(batch, 2):
                t = Texts(data, table_)
                many, keys, values = t.features()
                ends = pa.array(np.append(0, np.cumsum(many)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((keys, pa.int32()), (values, pa.float32()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(vote_pattern(t.votes())), *lists], ["doc_id", "hash", "pattern", "keys", "values"])

        return each

    text = F.col(text_col).cast("string")
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text).alias("hash"), text.alias("text")), make, "doc_id long, hash string, pattern long, keys array<int>, values array<float>")


@dataclass
class LabelModel:
    prior: float  # share of good documents
    right: np.ndarray  # labellers by (bad, good): P(the right vote), given that it votes

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """P(good) of rows of votes."""
        good = np.where(v == 1, np.log(self.right[:, 1]), np.where(v == -1, np.log1p(-self.right[:, 1]), 0)).sum(1) + np.log(self.prior)
        bad = np.where(v == -1, np.log(self.right[:, 0]), np.where(v == 1, np.log1p(-self.right[:, 0]), 0)).sum(1) + np.log1p(-self.prior)
        return 1 / (1 + np.exp(np.clip(bad - good, -60, 60)))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """Labellers' accuracies from vote patterns and how many documents have each. A labeller starts as mostly right,
    and one that rarely errs on good texts may miss many bad ones: the two kinds have accuracies of their own."""
    v = unpattern(patterns)
    # a bad vote is rare and says more: labellers start as sure of their bad votes
    m = LabelModel(0.8, np.tile([0.4, 0.98], (v.shape[1], 1)))
    for _ in range(rounds):
        p = m.posterior(v)
        good, bad = counts * p, counts * (1 - p)
        right = np.stack([((v == -1) * bad[:, None]).sum(0) + 1.0, ((v == 1) * good[:, None]).sum(0) + 9.0], 1)
        wrong = np.stack([((v == 1) * bad[:, None]).sum(0) + 1.0, ((v == -1) * good[:, None]).sum(0) + 1.0], 1)
        share = right / (right + wrong)
        m = LabelModel(float(np.clip((good.sum() + 4) / (counts.sum() + 5), 0.01, 0.99)), np.clip(share, 0.01, 0.999))
    return m


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def __call__(self, many: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Scores of documents by how many features each has and all their numbers and values."""
        s = np.bincount(np.repeat(np.arange(len(many)), many), self.weights[keys] * values, minlength=len(many)) + self.bias
        return 1 / (1 + np.exp(np.clip(-s, -60, 60)))


def fit_scorer(keys: list[np.ndarray], values: list[np.ndarray], target: np.ndarray, rounds: int = 300) -> Scorer:
    """Logistic regression on soft labels; good and bad weigh the same together."""
    if not len(target):
        return Scorer(np.zeros(DIMENSIONS), 4.0)
    rows = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    cols, vals = np.concatenate(keys).astype(np.int64), np.concatenate(values).astype(np.float64)
    good = float(np.clip(target.mean(), 0.02, 0.98))
    weigh = target / good + (1 - target) / (1 - good)
    weigh /= weigh.mean()
    w, b = np.zeros(DIMENSIONS), 0.0
    m1, m2 = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, vals * w[cols], minlength=len(keys)) + b, -60, 60)))
        g = (target - p) * weigh / len(keys)
        grad = np.append(np.bincount(cols, vals * g[rows], minlength=DIMENSIONS) - 1e-6 * w, g.sum())
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.99 * m2 + 0.01 * grad * grad
        move = 0.2 * m1 / (1 - 0.9**step) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
        w, b = w + move[:-1], b + float(move[-1])
    return Scorer(w, b)


def judge(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, hash (text_hash of the text), votes, posterior, score, keep of each document."""
    described = materialize(describe(docs, id_col, text_col), "features")
    seen = described.groupBy("pattern").agg(F.count("*").alias("n")).toPandas()  # at most 3 ** labellers rows
    model = expectation_maximisation(seen["pattern"].to_numpy(np.int64), seen["n"].to_numpy(np.float64))
    # a share of the hashes that holds somewhat fewer than `sample` documents, so that no task sends more than its part;
    # rows with one id and text are one document here, and rows without an id differ by their texts
    share = 1.0 if seen["n"].sum() <= sample else 0.9 * sample / float(seen["n"].sum())
    chosen = described.filter(F.pmod(F.xxhash64("doc_id", "hash"), F.lit(1 << 30)) < int(share * (1 << 30))).dropDuplicates(["doc_id", "hash"])
    held = chosen.filter(F.size("keys") > 0).select(F.xxhash64("doc_id", "hash").alias("h"), "doc_id", "hash", "pattern", "keys", "values").toPandas()
    held = held.sort_values(["h", "doc_id", "hash"], kind="stable").head(sample)
    target = model.posterior(unpattern(held["pattern"].to_numpy(np.int64)))
    scorer = fit_scorer(list(held["keys"]), list(held["values"]), target)
    sent = docs.sparkSession.sparkContext.broadcast((model, scorer))

    def make():
        model, scorer = sent.value

        def each(batch):
            v = unpattern(np.asarray(batch.column(2)))
            many = np.asarray(pa.compute.list_value_length(batch.column(3)))
            s = scorer(many, np.asarray(batch.column(3).flatten()), np.asarray(batch.column(4).flatten(), np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(v.tolist(), pa.list_(pa.int32())), pa.array(model.posterior(v)), pa.array(s), pa.array((s >= KEEP) | (many == 0))], ["doc_id", "hash", "votes", "posterior", "score", "keep"])

        return each

    return map_arrow(described, make, "doc_id long, hash string, votes array<int>, posterior double, score double, keep boolean")


def keep_good(docs: DataFrame, **how) -> DataFrame:
    """The documents that the classifier keeps, with all their columns."""
    bad = judge(docs, **how).filter("not keep").select("doc_id", "hash")
    return without(docs, bad, how.get("id_col", "doc_id"), how.get("text_col", "text"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("hash")
