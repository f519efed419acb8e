"""Quality classifier by positive-unlabelled learning.

Trusted positives are training rows labelled good; unlabelled web text is every training row, with
its label unseen, of which a share, the class prior, is good. The classifier is logistic on dense
features of a text and minimises the non-negative unbiased risk

    prior · E_P[loss(+)] + max(0, E_U[loss(-)] - prior · E_P[loss(-)])

With the logistic loss the unbiased risk is convex, so Newton steps find its least value; a step
that lets the second part fall below zero, or the risk rise, is halved, so the model cannot gain by
overfitting the positives. The prior is estimated from the same rows: no set of documents
can have a smaller share among the unlabelled than the prior times its share among the
positives, so the least ratio over the sets that a first classifier cuts off, each with enough
positives, bounds it.

Nothing is sampled. Features of the whole texts are written once; each step is one pass over
those of the training rows that sums the risk, its gradient and its curvature in partial
sums, and only their 600 values, or the counts of BINS score bins, reach the driver.

A training row is one with crc32(doc_id as text) mod 3 other than 1. Labels, lang,
source and doc_id are no inputs of a score.

Defined cases: null and empty texts have defined features and a score; a null doc_id is held
out of training; repeated rows count as often as they stand and get equal scores; a doc_id with
several labels is good if one says so; without training positives every score is 0.5;
other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from feedlake.llm import bytescan
from feedlake.llm.common import documents, staged

FOLDS, HELD_OUT = 3, 1
STEPS, HALVINGS, GAIN, DECAY = 40, 12, 0.1, 1e-4
LEAST_SHARE = 0.1  # of the positives, in a set that bounds the prior
N_FEATURES = 22
BINS, REACH = 4096, 30.0  # of the margins that bound the prior


def fold(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_PLAIN_MARK = np.zeros(256, dtype=bool)
_PLAIN_MARK[[ord(c) for c in ".,;:?'\"-()"]] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def features(texts: pa.Array) -> np.ndarray:
    """A row of N_FEATURES numbers for each text, from its bytes, words and lines."""
    data, offsets = bytescan.utf8(texts)
    start, end, hashes, first = bytescan.words(data, offsets)
    n_bytes = np.diff(offsets).astype(float)
    n_words = np.diff(first).astype(float)
    per_byte, per_word = 1 / np.maximum(n_bytes, 1), 1 / np.maximum(n_words, 1)

    def total(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(flags, dtype=float)])
        return sums[at[1:]] - sums[at[:-1]]

    letters = total(_LETTER[data], offsets)
    other = ~(_LETTER | _DIGIT | _PLAIN_MARK | _BLANK)[data]
    breaks = total(data == 10, offsets)
    sizes = (end - start).astype(float)
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = hashes[1:] == hashes[:-1]
    near = np.zeros(len(hashes), dtype=bool)
    near[2:] = hashes[2:] == hashes[:-2]
    wordless = np.ones(len(hashes), dtype=bool)
    last_mark = np.zeros(len(hashes), dtype=bool)
    capital = np.zeros(len(hashes), dtype=bool)
    if len(hashes):
        marks = np.concatenate([[0], np.cumsum(_LETTER[data])])
        wordless = marks[end] == marks[start]
        odd_sums = np.concatenate([[0], np.cumsum(other)])
        last_mark = odd_sums[end] > odd_sums[start]
        upper_sums = np.concatenate([[0], np.cumsum(_UPPER[data])])
        capital = (upper_sums[end] - upper_sums[start] >= 2) & (2 * (upper_sums[end] - upper_sums[start]) > end - start)
    distinct = np.zeros(len(texts))
    common = np.zeros(len(texts))
    for row, (a, b) in enumerate(zip(first, first[1:])):
        if b > a:
            _, counts = np.unique(hashes[a:b], return_counts=True)
            distinct[row], common[row] = len(counts), counts.max()
    columns = [
        np.log1p(n_bytes),
        np.log1p(n_words),
        n_words == 0,
        n_words < 5,
        n_words < 20,
        letters * per_byte,
        total(_UPPER[data], offsets) / np.maximum(letters, 1),
        total(_DIGIT[data], offsets) * per_byte,
        total(_PLAIN_MARK[data], offsets) * per_byte,
        np.sqrt(total(other, offsets) * per_byte),
        np.sqrt(total(data == ord("|"), offsets) * per_byte),
        np.sqrt(total(data == ord("!"), offsets) * per_byte),
        total(wordless, first) * per_word,
        total(last_mark, first) * per_word,
        total(capital, first) * per_word,
        np.sqrt(total(same, first) * per_word),
        np.sqrt(total(near, first) * per_word),
        total(sizes, first) * per_word / 10,
        np.sqrt(np.maximum(total(sizes**2, first) * per_word - (total(sizes, first) * per_word) ** 2, 0)) / 10,
        distinct / np.maximum(n_words, 1) ** 0.9,
        common * per_word,
        np.log1p(n_words / (breaks + 1)),
    ]
    return np.stack(columns, axis=1).astype(np.float64)


def feature_rows(docs: DataFrame) -> DataFrame:
    """doc_id and features of each row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in bytescan.slices(whole)):
            found = pa.array(list(features(batch.column("text")).astype(np.float32)), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(read, "doc_id long, x array<float>")


def least_hashed(rows: DataFrame, n: int) -> DataFrame:
    """n rows, as if drawn: those with the least hash of their id."""
    return rows.orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(n)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, N_FEATURES)


def sigmoid(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -REACH, REACH)))


class Model:
    """A logistic model on scaled features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.mean, self.scale, self.weights = mean, scale, weights

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.ones((len(x), 1)), np.clip((x - self.mean) / self.scale, -8, 8)])

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))

    def with_weights(self, weights: np.ndarray) -> Model:
        return Model(self.mean, self.scale, weights)


def total(rows: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum over all rows of the vector that ``of`` makes of features and marks; None without rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = None
        for batch in batches:
            if batch.num_rows:
                found = of(matrix(batch.column("x")), batch.column("positive").to_numpy(zero_copy_only=False))
                mine = found if mine is None else mine + found
        if mine is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(mine), dtype=np.int32)), pa.array(mine)], names=["at", "value"])

    parts = rows.select("x", "positive").mapInArrow(read, "at int, value double")
    summed = sorted(parts.groupBy("at").agg(F.sum("value").alias("value")).collect())
    return np.array([row["value"] for row in summed]) if summed else None


class Risk(NamedTuple):
    value: float
    negative: float  # the part that must not fall below zero
    gradient: np.ndarray
    curvature: np.ndarray


def risk_sums(model: Model) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """What the risk needs of some rows: sums, so that parts of the rows may be added."""

    def of(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        rows = model.scaled(x)
        margin = rows @ model.weights
        loss, s = np.logaddexp(0, margin), sigmoid(margin)
        curvature = (rows * (s * (1 - s))[:, None]).T @ rows
        own = [loss.sum(), loss[positive].sum(), margin[positive].sum()]
        return np.concatenate([own, s @ rows, rows[positive].sum(axis=0), curvature.ravel()])

    return of


def risk(sums: np.ndarray, n: float, n_positive: float, prior: float, weights: np.ndarray) -> Risk:
    """The unbiased risk with a small ridge. loss(+) - loss(-) of a margin is its negative."""
    k = len(weights)
    ridge = DECAY * np.concatenate([[0], np.ones(k - 1)])
    value = sums[0] / n - prior * sums[2] / n_positive + (ridge * weights**2).sum() / 2
    gradient = sums[3 : 3 + k] / n - prior * sums[3 + k : 3 + 2 * k] / n_positive + ridge * weights
    # The last term only keeps the equations solvable where a feature is constant.
    curvature = sums[3 + 2 * k :].reshape(k, k) / n + np.diag(ridge) + 1e-9 * np.eye(k)
    return Risk(value, sums[0] / n - prior * sums[1] / n_positive, gradient, curvature)


def fit(risk_at: Callable[[np.ndarray], Risk], weights: np.ndarray) -> np.ndarray:
    """Newton steps, halved until the risk falls and its second part is not negative.

    Where the second part bounds a step, the fit ends once such a step lowers the risk by less than GAIN.
    """
    now = risk_at(weights)
    for _ in range(STEPS):
        step = np.linalg.solve(now.curvature, -now.gradient)
        if -(now.gradient @ step) < 1e-9:
            break
        bounded = False
        for _ in range(HALVINGS):
            tried = risk_at(weights + step)
            bounded |= tried.negative < 0
            if tried.value < now.value and tried.negative >= 0:
                break
            step = step / 2
        else:
            break
        gain = now.value - tried.value
        weights, now = weights + step, tried
        if bounded and gain < GAIN:
            break
    return weights


def margin_counts(model: Model) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """How many rows, and how many positives, lie in each of BINS ranges of the margin."""

    def of(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        at = np.clip((model.margin(x) + REACH) * (BINS / (2 * REACH)), 0, BINS - 1).astype(int)
        return np.concatenate([np.bincount(part, minlength=BINS) for part in (at, at[positive])]).astype(float)

    return of


def bounded_prior(counts: np.ndarray) -> float:
    """The least ratio of shares over the sets above a margin."""
    every, positive = (np.cumsum(part[::-1]) for part in np.split(counts, 2))
    share_u, share_p = every / every[-1], positive / positive[-1]
    # Two standard errors, for the least of many ratios is found by chance as well.
    slack = 2 * np.sqrt(np.maximum(share_u * (1 - share_u), 1e-9) / every[-1])
    enough = share_p >= LEAST_SHARE
    return float(np.clip(((share_u + slack)[enough] / share_p[enough]).min(), 0.05, 0.99))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    return train_on(staged(feature_rows(docs), "quality-features"), labels)


def train_on(rows: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on the features of all training rows."""
    allowed = F.coalesce(fold(FOLDS) != HELD_OUT, F.lit(False))
    good = labels.filter(allowed & (F.col("quality") == 1)).select(F.col("doc_id").cast("long")).distinct()
    marked = rows.filter(allowed).join(good.withColumn("good", F.lit(True)), "doc_id", "left")
    marked = staged(marked.select("x", F.coalesce("good", F.lit(False)).alias("positive")), "quality-training")

    moments = total(marked, lambda x, positive: np.concatenate([[len(x), positive.sum()], x.sum(axis=0), (x**2).sum(axis=0)]))
    if moments is None or not moments[1]:
        return None
    n, n_positive = moments[:2]
    mean, square = np.split(moments[2:] / n, 2)
    model = Model(mean, np.maximum(np.sqrt(np.maximum(square - mean**2, 0)), 1e-6), np.zeros(N_FEATURES + 1))

    def fitted(prior: float) -> Model:
        def risk_at(weights: np.ndarray) -> Risk:
            return risk(total(marked, risk_sums(model.with_weights(weights))), n, n_positive, prior, weights)

        return model.with_weights(fit(risk_at, model.weights))

    return fitted(bounded_prior(total(marked, margin_counts(fitted(0.5)))))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every row."""
    return score_rows(feature_rows(docs), model)


def score_rows(rows: DataFrame, model: Model | None) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.score(matrix(batch.column("x"))) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(read, "doc_id long, score double")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    rows = staged(feature_rows(documents(spark, sf_dir)), "quality-features")
    model = train_on(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_rows(rows, model).select(
        "doc_id",
        F.coalesce(fold(FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
