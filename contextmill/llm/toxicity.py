"""Toxicity: cumulative-link ordinal regression over sparse word features.

Grades are ordered; the thresholds between them share one weight per feature, so that
P(grade <= k) = sigmoid(threshold_k - sum of weights). The model is fitted on a bounded sample of
labelled documents and gives every document its expected severity. Features are words and
beginnings of words; only those whose presence speaks for toxicity are used, with weights of
zero or more, so that nothing else in a text can excuse what it says.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contextmill.llm.words import Words, alphanumeric, mix, slices, tidy
from contextmill.session import materialise

#: Labelled documents the model is fitted on, at most about this many, by a hash of id and row number.
FIT_ROWS = 20_000
#: Selected features at most; least documents and least z value of a feature. More than half of
#: the sample's documents that have it must be toxic.
FEATURES, LEAST_DOCS, LEAST_Z = 4096, 5, 4.0
#: Documents whose likelihood a weight has to improve, about.
PENALTY = 4.0
#: Least weight, in a first fit of toxic against clean, of a feature that goes on to the grades.
TELLING = 0.5
#: Bytes of the beginnings of words, besides whole words.
PREFIXES = (4, 5, 6)
#: Ordered grades of toxic documents: as many parts of equal size by amount of evidence.
TOXIC_GRADES = 3
_FILTER_BITS = 20


def features(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, feature of each): whole words, then their beginnings where they are longer."""
    yield np.arange(len(words)), words.hashes()
    lengths = words.ends - words.starts
    up, _ = words.splitter.bytes.to(max(PREFIXES))
    for n in PREFIXES:
        at = np.flatnonzero(lengths > n)
        total = np.full(len(at), n, np.uint64)
        for i in range(n):
            total += words.splitter.value[words.data[words.starts[at] + i]] * up[i]
        yield at, mix(total ^ np.uint64(0x5851F42D4C957F2D))


@dataclass
class Model:
    """Sorted features with their weights, and the thresholds between occupied grades."""

    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(TOXIC_GRADES, 20.0))
    #: Least probability of a grade above zero at which a document is called toxic.
    cutoff: float = 0.5

    def __post_init__(self):
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[self.features >> np.uint64(64 - _FILTER_BITS)] = True

    def found(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature number, count) of the model's features, by text and feature."""
        texts, numbers = [], []
        for at, values in features(words) if len(self.features) else ():
            hit = np.flatnonzero(self.maybe[values >> np.uint64(64 - _FILTER_BITS)])
            spot = np.minimum(np.searchsorted(self.features, values[hit]), len(self.features) - 1)
            real = self.features[spot] == values[hit]
            texts.append(words.text_of(at[hit[real]]))
            numbers.append(spot[real])
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        key = np.concatenate(texts) * len(self.features) + np.concatenate(numbers)
        key, n = np.unique(key, return_counts=True)
        return key // len(self.features), key % len(self.features), n

    def above(self, words: Words) -> np.ndarray:
        """texts x thresholds: the probability that the grade is above each threshold."""
        text, number, n = self.found(words)
        score = np.bincount(text, self.weights[number] * np.log1p(n), len(words.counts))
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -30, 30)))


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, width: int,
                top: int, penalty: float = PENALTY, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the cumulative-link model by projected Adam steps.

    Weights are zero or more and their sum is penalised, so a feature gets one only if it tells
    more than those it comes with: words of much copied toxic documents get none. Sparse input as coordinate lists. Grades without rows get no threshold of their own: theirs
    equals the next lower one that is occupied, so the grade has probability zero.
    """
    levels = np.unique(grades)
    if len(levels) < 2:
        return np.zeros(width), np.where(np.arange(1, top + 1) <= (levels[0] if len(levels) else 0), -20.0, 20.0)
    rank = np.searchsorted(levels, grades)
    n, cuts = len(grades), len(levels) - 1
    share = np.clip(np.cumsum(np.bincount(rank))[:-1] / n, 1e-6, 1 - 1e-6)
    start = np.log(share / (1 - share))
    # Thresholds are a first one and positive steps, whose logarithms are fitted.
    steps = np.concatenate((start[:1], np.log(np.maximum(np.diff(start), 1e-3))))
    weights = np.zeros(width)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    moments = [np.zeros(width + cuts), np.zeros(width + cuts)]
    edge = np.concatenate
    for t in range(1, rounds + 1):
        theta = np.cumsum(edge((steps[:1], np.exp(steps[1:]))))
        score = np.bincount(rows, weights[columns] * values, n)
        below = sigmoid(edge((theta, [40.0]))[rank] - score)
        lower = np.where(rank > 0, sigmoid(edge(([0.0], theta))[rank] - score), 0.0)
        p = np.maximum(below - lower, 1e-9)
        up = np.where(rank < cuts, below * (1 - below), 0.0) / p
        down = np.where(rank > 0, lower * (1 - lower), 0.0) / p
        by_score = (up - down) / n  # of the negative log likelihood
        by_theta = (np.bincount(rank, -up / n, cuts + 1)[:cuts] + np.bincount(rank, down / n, cuts + 1)[1:])
        by_steps = np.cumsum(by_theta[::-1])[::-1].copy()
        by_steps[1:] *= np.exp(steps[1:])
        gradient = edge((np.bincount(columns, by_score[rows] * values, width) + penalty / n, by_steps))
        moments = [0.9 * moments[0] + 0.1 * gradient, 0.999 * moments[1] + 0.001 * gradient**2]
        move = 0.1 * (moments[0] / (1 - 0.9**t)) / (np.sqrt(moments[1] / (1 - 0.999**t)) + 1e-8)
        weights = np.maximum(weights - move[:width], 0)
        steps = steps - move[width:]
    theta = np.cumsum(edge((steps[:1], np.exp(steps[1:]))))
    # Threshold k parts grades below k from k and above.
    return weights, np.array([
        theta[i - 1] if 0 < (i := int(np.searchsorted(levels, k))) <= cuts else (-20.0 if i == 0 else 20.0)
        for k in range(1, top + 1)])


def _cutoff(scores: np.ndarray, toxic: np.ndarray, threshold: float) -> float:
    """The probability that parts the sample with the fewest errors, midway to the next lower score."""
    levels, at = np.unique(-scores, return_inverse=True)
    gain = np.cumsum(np.bincount(at, np.where(toxic, 1, -1)))
    best = int(np.argmax(gain))
    if gain[best] <= 0:
        return 1.0
    score = -levels[best] if best + 1 == len(levels) else -(levels[best] + levels[best + 1]) / 2
    return float(1 / (1 + np.exp(threshold - score)))


def _counts(source: DataFrame) -> DataFrame:
    """(feature, toxic, clean): documents of each kind that have the feature."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = alphanumeric()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                words = splitter.split(part.column("text"))
                bad = np.asarray(part.column("toxic").cast(pa.int64()))
                for at, values in features(words):
                    of = words.text_of(at)
                    order = np.lexsort((of, values))
                    values, of = values[order], of[order]
                    fresh = np.ones(len(values), bool)
                    fresh[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
                    values, of = values[fresh], of[fresh]
                    known, begin = np.unique(values, return_index=True)
                    if len(known):
                        toxic = np.add.reduceat(bad[of], begin)
                        n = np.diff(np.append(begin, len(values)))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(known.astype(np.int64)), pa.array(toxic), pa.array(n - toxic)], ["feature", "toxic", "clean"])

    part = source.mapInArrow(tidy(count), "feature bigint, toxic bigint, clean bigint")
    return part.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int) -> DataFrame:
    """(text, toxic) of labelled documents: all, or by a hash of id and row number about ``rows`` of them.

    A document is toxic if any of its labels is above zero; NULL ids and labels are left out. The
    bound is on rows of ``docs``, of which an id may have very many.
    """
    marks = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
    marks = marks.groupBy(F.col(key).alias("__id")).agg((F.max(label) > 0).cast("int").alias("toxic"))
    held = docs.select(F.col(key).alias("__id"), F.col(text).alias("text"))
    total = held.groupBy("__id").count().join(marks, "__id").agg(F.sum("count")).first()[0] or 0
    share = min(1.0, 0.95 * rows / max(1, total))
    numbered = held.withColumn("row", F.monotonically_increasing_id())
    some = numbered.filter(F.pmod(F.xxhash64(F.lit("fit"), "__id", "row"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # The chosen ids are as many as the bound allows at any input size; texts are not shuffled.
    chosen = marks.join(some.select("__id"), "__id", "left_semi")
    return some.join(F.broadcast(chosen), "__id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS) -> Model:
    """The model of a bounded sample of labelled documents.

    Labels say toxic or not; grades of toxic documents come from the amount of evidence, that is
    how often telling features occur, in ``TOXIC_GRADES`` parts of equal size. Without labels
    of both kinds the model has no features and calls nothing toxic unless all labels do.
    """
    sample = materialise(labelled_sample(docs, labels, key, text, label, rows), "labelled")
    size = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    if not bad or not good:
        return Model(thresholds=np.full(TOXIC_GRADES, -20.0 if bad else 20.0))
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    c, d = F.lit(bad) - F.col("toxic") + 0.5, F.lit(good) - F.col("clean") + 0.5
    z = F.log(a * d / (b * c)) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    chosen = (
        _counts(sample).filter(F.col("toxic") + F.col("clean") >= LEAST_DOCS).withColumn("z", z)
        .filter((F.col("z") >= LEAST_Z) & (F.col("toxic") > F.col("clean"))).orderBy(F.desc("z"), "feature").limit(FEATURES).select("feature").collect()
    )
    picked = Model(np.sort(np.array([r.feature for r in chosen], np.int64).astype(np.uint64)), np.zeros(len(chosen)))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = alphanumeric()
        for batch in batches:
            for part in slices(batch, "text"):
                text_no, number, n = picked.found(splitter.split(part.column("text")))
                ends = np.searchsorted(text_no, np.arange(part.num_rows + 1))
                cut = lambda x: [x[i:j].astype(np.int32).tobytes() for i, j in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("toxic"), pa.array(cut(number), pa.binary()), pa.array(cut(n), pa.binary())],
                    ["toxic", "numbers", "counts"])

    made = sorted(map(tuple, sample.mapInArrow(tidy(sparse), "toxic int, numbers binary, counts binary").collect()))
    numbers = [np.frombuffer(bytes(r[1]), np.int32) for r in made]
    counts = [np.frombuffer(bytes(r[2]), np.int32) for r in made]
    toxic = np.array([r[0] for r in made]) == 1
    row = np.repeat(np.arange(len(made)), [len(x) for x in numbers])
    column, n = np.concatenate(numbers).astype(np.int64), np.concatenate(counts)
    telling = fit_ordinal(row, column, np.log1p(n), toxic.astype(int), len(chosen), 1)[0] > TELLING
    row, column, n = (x[telling[column]] for x in (row, column, n))
    amount = np.bincount(row, n, len(made))
    cuts = np.quantile(amount[toxic], np.arange(1, TOXIC_GRADES) / TOXIC_GRADES)
    grades = np.where(toxic, 1 + np.searchsorted(cuts, amount, "left"), 0)
    used = np.cumsum(telling) - 1
    weights, thresholds = fit_ordinal(row, used[column], np.log1p(n), grades, int(telling.sum()), TOXIC_GRADES)
    scores = np.bincount(row, weights[used[column]] * np.log1p(n), len(made))
    return Model(picked.features[telling], weights, thresholds, _cutoff(scores, toxic, thresholds[0]))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with severity (expected grade), grade (the likeliest), p_toxic and toxic.

    ``toxic`` says that the probability of a grade above zero reaches the model's cutoff. NULL and empty texts are scored
    by the thresholds alone. Columns of ``docs`` with these four names are replaced. A text is read as a whole: one very long text is a slice of its own and takes
    some 30 times its bytes in its task.
    """
    new = ("severity", "grade", "p_toxic", "toxic")
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c not in new])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, own = alphanumeric(), held.value
        for batch in batches:
            for part in slices(batch, text):
                above = own.above(splitter.split(part.column(text)))
                bound = np.hstack((np.ones((len(above), 1)), above, np.zeros((len(above), 1))))
                columns = {name: part.column(name) for name in part.schema.names}
                columns["severity"] = pa.array(np.round(above.sum(axis=1), 6))
                columns["grade"] = pa.array(np.argmax(bound[:, :-1] - bound[:, 1:], axis=1), pa.int32())
                columns["p_toxic"] = pa.array(np.round(above[:, 0], 6))
                columns["toxic"] = pa.array(above[:, 0] >= own.cutoff)
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    made = (T.DoubleType(), T.IntegerType(), T.DoubleType(), T.BooleanType())
    return kept.mapInArrow(tidy(rate), T.StructType([*kept.schema.fields, *map(T.StructField, new, made)]))


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the toxic ones, in the columns of ``docs``."""
    new = [c for c in docs.columns if c in ("severity", "grade", "p_toxic", "toxic")]
    carried = docs.withColumnsRenamed({c: f"__own_{c}" for c in new})
    scored = score(carried, fit(docs, labels, key, text), text).filter("not toxic")
    back = scored.drop("severity", "grade", "p_toxic", "toxic").withColumnsRenamed({f"__own_{c}": c for c in new})
    return back.select(*[f"`{c}`" for c in docs.columns])
