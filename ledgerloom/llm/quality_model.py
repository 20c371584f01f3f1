"""Quality classifier: logistic regression on hashed word n-grams, fitted by follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.hashed_words import BITS, Words, features
from ledgerloom.llm.support import calibrated, held_out, stored, training_rows

#: Labelled documents that the model is fitted on, at most.
TRAINING_ROWS = 20_000
THRESHOLD = 0.3
#: Shards that are fitted by themselves and averaged, and passes over a shard.
SHARDS, PASSES = 4, 4
UNIT = 1e-9


@dataclass(frozen=True)
class Model:
    """Weights of the buckets and a bias at the end, and what turns their sum into a probability."""

    weights: np.ndarray
    slope: float = 1.0
    bias: float = 0.0


@dataclass(frozen=True)
class Rates:
    """Step size and regularisation of the updates."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1


class Leader:
    """Weights as the leader over all past linearised losses, with per-coordinate steps."""

    def __init__(self, size: int, rates: Rates) -> None:
        self.z, self.n, self.rates = np.zeros(size), np.zeros(size), rates

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, r = self.z[at], self.rates
        shrunk = np.sign(z) * np.maximum(np.abs(z) - r.l1, 0)
        return -shrunk / ((r.beta + np.sqrt(self.n[at])) / r.alpha + r.l2)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        n = self.n[at]
        step = (np.sqrt(n + g * g) - np.sqrt(n)) / self.rates.alpha
        self.z[at] += g - step * w
        self.n[at] = n + g * g


def _with_bias(at: np.ndarray, x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The last coordinate, beside the buckets, is always 1."""
    return np.r_[at, 1 << bits], np.r_[x, 1.0]


def _fit_shard(bits: int, passes: int, rates: Rates) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rows = Words(), []
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist()):
                rows.append((*_with_bias(*features(text.as_py(), words, bits), bits), label))
        if not rows:
            return
        leader = Leader((1 << bits) + 1, rates)
        for _ in range(passes):
            for at, x, label in rows:
                leader.learn(at, x, label)
        w = leader.weights(slice(None))
        used = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.array(np.rint(w[used] / UNIT).astype(np.int64), pa.int64())], names=["bucket", "w"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAINING_ROWS, shards: int = SHARDS,
        passes: int = PASSES, bits: int = BITS, rates: Rates = Rates()) -> Model:
    """Weights of 2 ** bits buckets and a bias, from at most `rows` labelled documents that are not held out.

    Few updates leave weights small, so the sums of the same documents are then set to probabilities (`calibrated`).

    Documents are dealt to shards by a hash of their id and learnt in the order of it, so a rerun gives the same
    weights. The mean over shards is taken of whole numbers of 1e-9, whose sum doesn't depend on the order of rows. Each
    shard holds its sparse vectors, rows / shards of them at most. Without labelled rows all weights are zero.
    """
    sample = stored(training_rows(docs, labels, label, rows).select(
        F.xxhash64("doc_id").alias("h"), "doc_id", "label", F.col("text").cast("binary").alias("text")), "training")
    dealt = sample.repartition(shards, F.pmod("h", F.lit(shards))).sortWithinPartitions("h", "doc_id").select("text", "label")
    means = dealt.mapInArrow(_fit_shard(bits, passes, rates), "bucket long, w long").groupBy("bucket").agg(F.sum("w").alias("w"))
    weights = np.zeros((1 << bits) + 1)
    for r in means.toLocalIterator():  # at most one row for each bucket
        weights[r["bucket"]] = r["w"] * UNIT / shards
    sums = sample.select("label", F.round(sum_column(F.col("text"), Model(weights), docs), 3).alias("x"))
    found = sums.groupBy("label", "x").agg(F.count("*").alias("n")).orderBy("label", "x").collect()  # at most `rows` pairs
    if len({r["label"] for r in found}) < 2:
        return Model(weights)
    slope, bias = calibrated(np.array([[r["x"]] for r in found]), np.array([r["label"] for r in found]), np.array([float(r["n"]) for r in found]))
    return Model(weights, float(slope), float(bias))


def _summer(sent, bits: int) -> Callable[[pa.Array], pa.Array]:
    words = Words()

    def run(texts: pa.Array) -> pa.Array:
        w, out = sent.value, []
        for text in texts:
            at, x = features(text.as_py(), words, bits)
            out.append(float(w[at] @ x + w[-1]))
        return pa.array(out, pa.float64())

    return run


def sum_column(text: Column, model: Model, docs: DataFrame) -> Column:
    sent = docs.sparkSession.sparkContext.broadcast(model.weights)
    return F.arrow_udf(_summer(sent, int(len(model.weights) - 1).bit_length() - 1), T.DoubleType())(text.cast("binary"))


def score_column(text: Column, model: Model, docs: DataFrame) -> Column:
    total = sum_column(text, model, docs) * model.slope + model.bias
    return F.round(1 / (1 + F.exp(-F.least(F.greatest(total, F.lit(-35.0)), F.lit(35.0)))), 6)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (how likely label 1 is), predicted (1 from 0.3 on) of every row of `docs`.

    A text without words, null too, gets the score of the bias; without any training rows every score is 0.5. Rows
    without an id count as held out. Only texts enter a score.
    """
    scored = docs.select("doc_id", score_column(F.col("text"), fit(docs, labels), docs).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
