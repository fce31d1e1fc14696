"""Quality of whole texts by supervised subword embeddings.

Every word and every byte n-gram of a text has a learned vector in a hashed table; a
document is the average of its vectors and a softmax layer turns that average into the
probability of each class. The table and the layer are trained together by stochastic
gradient descent in numpy. A word that repeats the one before it also counts as the
pair "same word again".

The model is fitted on a bounded sample of labelled documents (``SAMPLE`` ids, those of
least hash, one row of each), in one task. Scores use whole texts; as the average and the layer are linear, a table
slot is reduced to one number before the texts are read, and only that table of fixed
size is sent to the tasks.

Definitions. A null or empty text has the average zero, so its score is that of the bias.
Without labelled rows, or with one class only, the score is 0.5 or that class. Labels that
contradict each other for one id are not learned from. Rows are scored one by one:
repeated rows repeat their result and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmurate.llm import blocks

BITS = 16
SIZES = (3, 4)
DIMENSIONS = 16
SAMPLE = 6000
_SAME = np.uint32(1)


def slots(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each family of features: slots, and where those of each text begin (an array per text plus the end)."""
    hashes, begins = blocks.words(data, offsets)
    place = (hashes >> np.uint64(64 - bits)).astype(np.uint32)
    yield place, begins
    if len(hashes):
        same = np.flatnonzero(hashes[1:] == hashes[:-1]) + 1
        inner = np.zeros(len(hashes) + 1, bool)
        inner[begins] = True
        same = same[~inner[same]]
        yield np.full(len(same), _SAME), np.searchsorted(same, begins)
    for size in SIZES:
        gram = blocks.grams(data, size, bits)
        # n-grams that cross into the next text are left out
        ends = np.maximum(offsets[1:] - size + 1, offsets[:-1])
        keep = np.zeros(len(gram) + 1, np.int64)
        np.add.at(keep, np.minimum(offsets[:-1], len(gram)), 1)
        np.add.at(keep, np.minimum(ends, len(gram)), -1)
        inside = np.cumsum(keep[:-1]) > 0
        lengths = np.maximum(offsets[1:] - offsets[:-1] - size + 1, 0)
        yield gram[inside], np.concatenate(([0], np.cumsum(lengths)))


def _place(bits: int) -> str:
    """The narrowest type of a slot."""
    return "<u2" if bits <= 16 else "<u4"


def _counted(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, data, offsets in blocks.blocks(batch.column(0)):
            found = list(slots(data, offsets, bits))
            rows = []
            for k in range(len(offsets) - 1):
                places, counts = np.unique(np.concatenate([s[b[k] : b[k + 1]] for s, b in found]), return_counts=True)
                rows.append((places, (counts / max(1, counts.sum())).astype(np.float32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).slice(first, len(rows)), batch.column(2).slice(first, len(rows)), pa.array([p.astype(_place(bits)).tobytes() for p, _ in rows], pa.binary()), pa.array([w.tobytes() for _, w in rows], pa.binary())],
                ["known_id", "label", "places", "weights"],
            )


@dataclass(frozen=True)
class Model:
    """One number per slot and the bias; the score is the logistic function of bias plus average."""

    table: np.ndarray
    bias: float
    bits: int = BITS

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total, count = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
        for place, begins in slots(data, offsets, self.bits):
            run = np.concatenate(([0.0], np.cumsum(self.table[place], dtype=np.float64)))
            total += run[begins[1:]] - run[begins[:-1]]
            count += np.diff(begins)
        return 1 / (1 + np.exp(-np.clip(self.bias + total / np.maximum(count, 1), -50, 50)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, dimensions: int = DIMENSIONS, epochs: int = 12, rate: float = 0.25, seed: int = 7) -> Model:
    """Stochastic gradient descent over ``(slots, weights, label 0 or 1)``, one document a step."""
    labels = np.array([y for _, _, y in rows], int)
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(1 << bits, np.float32), 0.0 if not len(labels) else 50.0 * (2 * int(labels[0]) - 1), bits)
    random = np.random.default_rng(seed)
    vectors = random.normal(0, 1 / dimensions, (1 << bits, dimensions)).astype(np.float32)
    layer = random.normal(0, 0.1, (dimensions, 2)).astype(np.float32)
    bias = np.log(np.bincount(labels, minlength=2) / len(labels)).astype(np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in random.permutation(len(rows)):
            places, weights, label = rows[k]
            hidden = weights @ vectors[places]
            out = hidden @ layer + bias
            error = np.exp(out - out.max())
            error /= error.sum()
            error[label] -= 1
            back = layer @ error
            layer -= step * np.outer(hidden, error)
            bias -= 0.1 * step * error
            # as in embedding training, each vector of the average takes the whole step
            vectors[places] -= step * back
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]), bits)


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, sample: int = SAMPLE, bits: int = BITS) -> Model:
    """Fit on at most ``sample`` rows of ``labels`` (``doc_id``, ``quality`` 0 or 1) for which ``learn_from`` holds."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    if learn_from is not None:
        known = known.where(learn_from)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other")).where("label = other").select(F.col("doc_id").alias("known_id"), "label")
    known = known.orderBy(F.xxhash64("known_id"), "known_id").limit(sample)  # a row is an id and a label, so this may be broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("known_id"))
    # of rows that share an id one is learned from; every task sends one of them at most
    one = texts.groupBy("known_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").cast("int").alias("label"))
    kind = labels.schema["doc_id"].dataType.simpleString()
    counted = one.select("text", "known_id", "label").mapInArrow(lambda batches: _counted(batches, bits), f"known_id {kind}, label int, places binary, weights binary")
    # the sample is bounded, so one task trains; the driver gets a number per slot
    found = counted.repartition(1).mapInArrow(lambda batches: _trained(batches, bits), "numbers binary, bias double").first()
    if found is None:
        return train([], bits)
    return Model(np.frombuffer(bytes(found["numbers"]), np.float32), found["bias"], bits)


def _trained(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        rows += zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 1)), strict=True)
    if rows:
        model = train([(np.frombuffer(p, _place(bits)), np.frombuffer(w, np.float32), label) for _, p, w, label in sorted(rows)], bits)
        yield pa.RecordBatch.from_arrays([pa.array([model.table.tobytes()], pa.binary()), pa.array([model.bias])], ["numbers", "bias"])


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score`` (the probability of quality 1) and ``predicted`` for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.concatenate([sent.value.score(data, offsets) for _, data, offsets in blocks.blocks(batch.column(1))] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(apply, f"doc_id {kind}, score double, predicted int")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all columns, that score at least ``threshold``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.concatenate([sent.value.score(data, offsets) for _, data, offsets in blocks.blocks(batch.column(at))] or [np.zeros(0)])
            yield batch.filter(pa.array(score >= threshold))

    return docs.mapInArrow(keep, docs.schema)
