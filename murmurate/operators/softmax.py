"""Softmax regression by mini-batches, which can go on from saved coefficients.

A text is the sum of its hashed words over the root of their number. The coefficients are a number per
slot and class, so what the driver holds and sends to the tasks is bounded by ``features``; the
rows stay where they are. A step computes the gradient of one batch: every task adds up its
rows per slot and class, one aggregate adds up the tasks. Rows are dealt to batches once, as
folders, so that a step reads its batch only.

Slots are divided into ``LAYERS`` equal layers. Going on from a model may freeze the lowest of
them: their coefficients stay as they were, the others and the biases learn on.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurate.operators.learn import tokens
from murmurate.session import scratch

FEATURES = 1 << 16
LAYERS = 12
#: A label is a place in the list of classes, so a very large one is a mistake.
MOST_CLASSES = 1000
#: Words that a task works on at once, whatever an Arrow batch holds; a text is not cut.
PIECE = 1 << 17


def slots(text: Column, features: int = FEATURES, max_tokens: int | None = None) -> Column:
    """Slot of every word of a text; a null text has none."""
    words = F.coalesce(tokens(text), F.array().cast("array<string>"))
    words = words if max_tokens is None else F.slice(words, 1, max_tokens)
    return F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("int"), F.lit(features)))


def layer(slot: np.ndarray, features: int) -> np.ndarray:
    return slot * LAYERS // features


def _pieces(column: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """The texts in runs of at most ``PIECE`` words, or one longer text: their places, all slots in a row, and how many each text has."""
    ends, start = column.offsets.to_numpy(), 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + PIECE, "right")) - 1)
        yield slice(start, stop), column.slice(start, stop - start).flatten().to_numpy(), np.diff(ends[start : stop + 1])
        start = stop


def _chances(slot: np.ndarray, size: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Probability of each class for every text; the words are summed class by class."""
    ends, logits = np.cumsum(size), np.empty((len(size), len(bias)))
    for k in range(len(bias)):
        total = np.concatenate([[0.0], np.cumsum(weights[k, slot])])
        logits[:, k] = (total[ends] - total[ends - size]) / np.sqrt(np.maximum(size, 1)) + bias[k]
    out = np.exp(logits - logits.max(axis=1, keepdims=True))
    return out / out.sum(axis=1, keepdims=True)


def _all_chances(column: pa.Array, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    found = [_chances(slot, size, weights, bias) for _, slot, size in _pieces(column)]
    return np.concatenate([np.empty((0, len(bias))), *found])


def _sums(batches: Iterable[pa.RecordBatch], weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the gradients of the rows (``slots``, ``label``) per class and slot, and per class."""
    total, biases = np.zeros_like(weights), np.zeros(len(bias))
    for batch in batches:
        label = batch.column(1).to_numpy()
        for rows, slot, size in _pieces(batch.column(0)):
            error = _chances(slot, size, weights, bias)
            error[np.arange(len(error)), label[rows]] -= 1
            for k in range(len(total)):
                total[k] += np.bincount(slot, np.repeat(error[:, k] / np.sqrt(np.maximum(size, 1)), size), total.shape[1])
            biases += error.sum(axis=0)
    return total, biases


@dataclass(frozen=True)
class SoftmaxModel:
    """``weights`` has a row per class and a column per slot."""

    weights: np.ndarray
    bias: np.ndarray
    text: str = "clean_text"
    max_tokens: int | None = None

    @property
    def features(self) -> int:
        return self.weights.shape[1]

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``probability`` (a vector) and ``prediction``; ties go to the smaller class."""
        weights, bias = self.weights, self.bias
        sent = df.sparkSession.sparkContext.broadcast((weights, bias))

        @F.arrow_udf("array<double>")
        def chances(column: pa.Array) -> pa.Array:
            found = _all_chances(column, *sent.value)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))

        scored = df.withColumn("_chances", chances(slots(F.col(self.text), self.features, self.max_tokens)))
        best = F.array_position("_chances", F.array_max("_chances")) - 1
        return scored.withColumns({"probability": array_to_vector("_chances"), "prediction": best.cast("double")}).drop("_chances")

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """``class, slot, weight``: the numbers that are not zero, and the biases with slot -1."""
        which, slot = np.nonzero(self.weights)
        table = pa.table(
            {
                "class": pa.array(np.concatenate([which, np.arange(len(self.bias))]), pa.int32()),
                "slot": pa.array(np.concatenate([slot, np.full(len(self.bias), -1)]), pa.int32()),
                "weight": np.concatenate([self.weights[which, slot], self.bias]),
            }
        )
        return spark.createDataFrame(table)

    def save(self, spark: SparkSession, path: str) -> None:
        """One folder of coefficients and one line of settings; the settings come last."""
        self.coefficients(spark).write.parquet(f"{path}/coefficients")
        about = json.dumps({"features": self.features, "classes": len(self.bias), "text": self.text, "max_tokens": self.max_tokens})
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{path}/settings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> SoftmaxModel:
        about = json.loads(spark.read.text(f"{path}/settings").first().value)
        weights, bias = np.zeros((about["classes"], about["features"])), np.zeros(about["classes"])
        found = spark.read.parquet(f"{path}/coefficients").toArrow()
        which, slot, value = (found.column(c).to_numpy() for c in ("class", "slot", "weight"))
        weights[which[slot >= 0], slot[slot >= 0]] = value[slot >= 0]
        bias[which[slot < 0]] = value[slot < 0]
        return SoftmaxModel(weights, bias, about["text"], about["max_tokens"])


def _gradient(rows: DataFrame, model: SoftmaxModel) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the gradients of the log losses of ``rows`` (``slots``, ``label``), by one aggregate."""
    weights, bias = model.weights, model.bias
    sent = rows.sparkSession.sparkContext.broadcast((weights, bias))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, biases = _sums(batches, *sent.value)
        which, slot = np.nonzero(total)
        which, slot, value = np.concatenate([which, np.arange(len(biases))]), np.concatenate([slot, np.full(len(biases), -1)]), np.concatenate([total[which, slot], biases])
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(slot, pa.int32()), pa.array(value)], ["class", "slot", "value"])

    summed = rows.select("slots", "label").mapInArrow(add, "class int, slot int, value double").groupBy("class", "slot").agg(F.sum("value").alias("value")).toArrow()
    sent.unpersist()
    which, slot, value = (summed.column(c).to_numpy() for c in ("class", "slot", "value"))
    gradient, of_bias = np.zeros_like(weights), np.zeros_like(bias)
    gradient[which[slot >= 0], slot[slot >= 0]] = value[slot >= 0]
    of_bias[which[slot < 0]] = value[slot < 0]
    return gradient, of_bias


@dataclass(frozen=True)
class Fitted:
    model: SoftmaxModel
    batch_size: int
    frozen: int


def fit(
    rows: DataFrame,
    start: SoftmaxModel | None = None,
    text: str = "clean_text",
    label: str = "label",
    learning_rate: float = 3.0,
    epochs: int = 3,
    batch_size: int | None = None,
    weight_decay: float = 0.001,
    freeze_layers: int = 6,
    features: int = FEATURES,
    max_tokens: int | None = None,
    classes: int = 3,
) -> Fitted:
    """A model of ``rows``; from ``start``, its shape is kept and its lowest layers are frozen.

    Without ``batch_size`` an epoch has eight batches. Rows without label are not learned from.
    """
    if start is not None:
        features, max_tokens = start.features, start.max_tokens
    spark = rows.sparkSession
    known = rows.where(F.col(label).isNotNull()).select(slots(F.col(text), features, max_tokens).alias("slots"), F.col(label).cast("int").alias("label"))
    with scratch(spark) as keep:
        dealt = keep(known.withColumn("row", F.monotonically_increasing_id()), "words")
        counted = dealt.agg(F.count("*").alias("n"), F.min("label").alias("least"), F.max("label").alias("most")).first()
        n, most = counted.n, counted.most or 0
        if (counted.least or 0) < 0 or most >= MOST_CLASSES:
            raise ValueError(f"labels are places from 0 to {MOST_CLASSES - 1}")
        classes = max(classes, most + 1, len(start.bias) if start else 0)
        weights, bias = np.zeros((classes, features)), np.zeros(classes)
        if start is not None:
            weights[: len(start.bias)], bias[: len(start.bias)] = start.weights, start.bias
        size = batch_size or max(1, math.ceil(n / 8))
        batches = max(1, math.ceil(n / size))
        dealt = keep(dealt.withColumn("batch", F.pmod(F.xxhash64("row"), F.lit(batches)).cast("int")).drop("row"), "batches", "batch")
        held = {row.batch: row.n for row in dealt.groupBy("batch").agg(F.count("*").alias("n")).collect()}
        frozen = freeze_layers if start is not None else 0
        open_slots = layer(np.arange(features), features) >= frozen
        for step in range(epochs * batches):
            n_batch = held.get(step % batches)
            if not n_batch:
                continue
            gradient, of_bias = _gradient(dealt.where(F.col("batch") == step % batches), SoftmaxModel(weights, bias))
            changed = weights * (1 - learning_rate * weight_decay) - learning_rate * gradient / n_batch
            weights = np.where(open_slots[None], changed, weights)
            bias = bias - learning_rate * of_bias / n_batch
    return Fitted(SoftmaxModel(weights, bias, text, max_tokens), size, frozen)
