"""Toxicity as severity grades by cumulative-link ordinal regression on sparse text features.

Features are hashed words and word beginnings (4 to 10 characters) of the lower-cased text. The labels say only toxic or
not; among toxic training documents the grade (1 to GRADES - 1) is the quantile of how many features they hold that the labels
mark as toxic beyond doubt, so that a text with more of them is graded higher. The model is
P(grade <= k) = logistic(threshold_k - w x): one weight vector, shared by all thresholds, which are kept in order. The
result is the expected severity, the sum over k of P(grade > k), with the most probable grade and P(grade > 0).

The model is fitted on the driver from at most SAMPLE labelled documents, those with the smallest hashes of their ids (of an id's rows, equal ones once);
features that few sample documents hold, or that the label doesn't depend on, are left out. All documents are scored
whole, where they lie: the model (at most FEATURES weights) is broadcast, and nothing is shuffled.

Defined results: null and empty texts have no features and get the severity of the thresholds alone; labels of null, or
of ids without a text, are not used; of repeated labels for an id all count; with no labels, or only one kind, every
severity is 0; repeated rows get a row each; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linelake.llm.common import WordHashes, map_arrow, materialize, mix, rolling, slices, table, text_hash

SAMPLE = 8_000
BEGINNINGS = (4, 5, 6, 7, 8, 10)  # lengths of word beginnings
SKETCH = 6  # minimal hashes by which near copies are told
FEATURES = 20_000
GRADES = 4
EVIDENCE = 16.0  # least log-likelihood gain (nats) of a feature's dependence on the label
MARGIN = 0.5  # P(grade > 0) from which a text counts as toxic

_splitter = re.compile(r"[^\W_]+")


class Names(dict):
    """Word to the hashes of its features."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        own = {word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)}
        value = self[word] = tuple(xxhash.xxh3_64_intdigest(x.encode()) >> 1 for x in own)
        return value


def counts(text: bytes, names: Names, known: dict[int, int] | None = None) -> dict[int, int]:
    """How often each feature (of the known ones, by their number) stands in the text."""
    out: dict[int, int] = {}
    for w in _splitter.findall(text.decode("utf-8", "replace").lower()):
        for f in names[w]:
            if known is not None:
                f = known.get(f)
                if f is None:
                    continue
            out[f] = out.get(f, 0) + 1
    return out


@dataclass
class Model:
    numbers: dict[int, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def grades(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, one row for each score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))

    def score(self, found: dict[int, int]) -> float:
        return float(sum(self.weights[f] * np.log1p(n) for f, n in found.items()))


EMPTY = Model({}, np.zeros(0), np.full(GRADES - 1, 60.0))


def distinct(sketches: list, most: int = SKETCH) -> list[int]:
    """Numbers of the texts that are no near copies of an earlier one: else what copies have in common by chance would
    count as evidence. Texts that share one of a few minimal hashes of their word 4-grams count as copies."""
    seen: set[tuple[int, int]] = set()
    out = []
    for i, s in enumerate(sketches):
        least = set(enumerate(s[:most]))
        if not least & seen:
            out.append(i)
        seen |= least
    return out


def sketch(text: bytes, hashes: WordHashes) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    grams = rolling(hashes.of(words), min(4, len(words)))
    return [int(mix(grams + np.uint64(k)).min()) >> 1 for k in range(SKETCH)]


def fit(rows: np.ndarray, cols: np.ndarray, counted: np.ndarray, toxic: np.ndarray, gains: np.ndarray, features: np.ndarray, rounds: int = 400) -> Model:
    """The ordinal model, by gradient steps with momentum; L2 holds the weights. Row rows[i] holds feature cols[i]
    counted[i] times; gains above 0 mark features of toxic texts."""
    vals = np.log1p(counted)
    m, d = len(toxic), len(features)
    sure = gains[cols] > 0
    marks = np.bincount(rows[sure], vals[sure], minlength=m)
    cuts = np.quantile(marks[toxic == 1], np.arange(1, GRADES - 1) / (GRADES - 1))
    grade = np.where(toxic == 1, 1 + np.searchsorted(cuts, marks, side="right"), 0)
    w = np.zeros(d)
    weigh = np.where(toxic == 1, max(1.0, float((1 - toxic.mean()) / toxic.mean())), 1.0)  # both kinds weigh the same
    weigh /= weigh.mean()
    # threshold_k = base + sum of exp(gaps): always in order
    levels = np.arange(GRADES - 1)
    base, gaps = 0.0, np.zeros(GRADES - 2)
    state = [np.zeros(d), np.zeros(1), np.zeros(GRADES - 2)]
    square = [np.zeros(d), np.zeros(1), np.zeros(GRADES - 2)]
    pick = np.arange(m)
    for step in range(1, rounds + 1):
        theta = base + np.append(0, np.cumsum(np.exp(gaps)))
        score = np.bincount(rows, vals * w[cols], minlength=m)
        above = 1 / (1 + np.exp(np.clip(theta[None, :] - score[:, None], -60, 60)))  # P(grade > k)
        edge = np.concatenate([np.ones((m, 1)), above, np.zeros((m, 1))], 1)
        p = np.maximum(edge[pick, grade] - edge[pick, grade + 1], 1e-9)
        slope = edge * (1 - edge)
        up, down = weigh * slope[pick, grade] / p, weigh * slope[pick, grade + 1] / p  # of log p by score - threshold
        g_score = up - down
        g_theta = np.zeros(GRADES - 1)
        np.add.at(g_theta, np.clip(grade - 1, 0, None), np.where(grade > 0, -up, 0))
        np.add.at(g_theta, np.minimum(grade, GRADES - 2), np.where(grade < GRADES - 1, down, 0))
        g_w = np.bincount(cols, vals * g_score[rows], minlength=d) / m - 1e-5 * w
        g_gaps = np.array([g_theta[levels > j].sum() for j in range(GRADES - 2)]) * np.exp(gaps) / m
        moves = []
        for k, g in enumerate((g_w, np.array([g_theta.sum() / m]), g_gaps)):
            state[k] = 0.9 * state[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            moves.append(0.1 * state[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8))
        w, base, gaps = w + moves[0], base + float(moves[1][0]), gaps + moves[2]
    return Model(dict(zip(features.tolist(), range(d))), w, base + np.append(0, np.cumsum(np.exp(gaps))))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on the `sample` labelled documents whose ids have the smallest hashes. Features are counted and chosen on
    the cluster; the driver gets the chosen ones of each sample document."""
    spark = docs.sparkSession
    labelled = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), (F.col(label_col) > 0).cast("int").alias("_toxic"))
    picked = labelled.orderBy(F.xxhash64("_id"), "_id", "_toxic").limit(sample)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("_text"), text_hash(text).alias("_hash")).join(F.broadcast(picked), "_id").filter("_text is not null")

    def make():
        names, hashes = Names(), WordHashes()

        def each(batch):
            for part, data in slices(batch, 1):
                found = [counts(x, names) for x in data]
                kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()))
                own = [pa.array(list(c), k) for c, k in zip(([sketch(x, hashes) for x in data], [list(f) for f in found], [list(f.values()) for f in found]), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), *own], ["id", "toxic", "hash", "sketch", "keys", "times"])

        return each

    held = materialize(map_arrow(rows.select("_id", "_text", "_toxic", "_hash"), make, "id long, toxic int, hash string, sketch array<long>, keys array<long>, times array<int>").withColumn("row", F.monotonically_increasing_id()), "sample")
    # an id may have many rows: equal ones count once, and no more than `sample` come to the driver
    single = held.groupBy("id", "toxic", "hash").agg(F.min_by(F.struct("row", "sketch"), "row").alias("x"))
    texts = single.orderBy(F.xxhash64("id", "hash"), "id", "hash", "toxic").limit(sample).select("x.row", "id", "toxic", "x.sketch").toPandas().sort_values(["id", "toxic", "row"], kind="stable")
    texts = texts.iloc[distinct(list(texts["sketch"].map(list)))]
    toxic = texts["toxic"].to_numpy(np.int64)
    if not len(toxic) or toxic.min() == toxic.max():
        return EMPTY
    p = float(toxic.mean())
    kept = held.join(F.broadcast(spark.createDataFrame([(int(r), i) for i, r in enumerate(texts["row"])], "row long, number long")), "row")
    n, x = F.col("n"), F.col("x")
    gain = F.when(x > 0, x * F.log(x / n / F.lit(p))).otherwise(0.0) + F.when(x < n, (n - x) * F.log((n - x) / n / F.lit(1 - p))).otherwise(0.0)
    seen = kept.select("toxic", F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"), F.sum("toxic").alias("x"))
    chosen = seen.withColumn("gain", gain).filter(F.col("gain") >= EVIDENCE).select("key", F.when(x > n * F.lit(p), F.col("gain")).otherwise(-F.col("gain")).alias("gain"))
    chosen = chosen.orderBy(F.desc(F.abs("gain")), "key").limit(FEATURES).toPandas()
    if not len(chosen):
        return EMPTY
    index = spark.createDataFrame([(int(k), i) for i, k in enumerate(chosen["key"])], "key long, feature long")
    cells = kept.select("number", F.explode(F.arrays_zip("keys", "times")).alias("c")).select("number", F.col("c.keys").alias("key"), F.col("c.times").alias("times")).join(F.broadcast(index), "key").toPandas()
    cells = cells.sort_values(["number", "feature"])
    return fit(*(cells[c].to_numpy(np.int64) for c in ("number", "feature", "times")), toxic, chosen["gain"].to_numpy(), chosen["key"].to_numpy(np.int64))


def severity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_severity, grade, p_toxic, toxic of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m, names = sent.value, Names()

        def each(batch):
            for part, data in slices(batch, 1):
                above = m.grades(np.array([m.score(counts(x, names, m.numbers)) for x in data]))
                edge = np.concatenate([np.ones((len(data), 1)), above, np.zeros((len(data), 1))], 1)
                grade = np.argmax(edge[:, :-1] - edge[:, 1:], 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(above.sum(1)), pa.array(grade.astype(np.int32)), pa.array(above[:, 0]), pa.array(above[:, 0] >= MARGIN)], ["doc_id", "expected_severity", "grade", "p_toxic", "toxic"])

        return each

    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), make, "doc_id long, expected_severity double, grade int, p_toxic double, toxic boolean")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return severity(docs, train(docs, table(spark, sf_dir, "labels")))
