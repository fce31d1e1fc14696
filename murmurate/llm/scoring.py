"""Scoring of whole texts by cross-entropy difference of two matched n-gram models.

The tokens are the bytes of the text, so the target model and the background model share
one vocabulary of 256. Both are interpolated models of orders one to ``ORDER`` with the same
weights. N-grams are counted exactly: a row for each distinct n-gram with its count in the
target and in all, added up in the tasks before it is shuffled. The table grows with the
corpus and stays a table of Spark; neither the driver nor a task holds it.

Documents are dealt into pieces of about ``PIECE`` bytes. A piece asks for each of its
distinct n-grams once, so a frequent n-gram has a row for each piece and no more; these rows
meet the table by joins, and the losses found meet the texts of their piece again. An n-gram
that the models have not seen gets its chance from its shorter ends.

A document's score is its loss per token under the background model minus that under the
target model: the greater, the more the text looks like the target. A target much smaller
than the corpus has the rougher estimates, which costs all texts alike.

Definitions. A null or empty text has zero losses and score zero. A document is of the
target if ``target`` holds for its row (null: it is not). Without target tokens both models are
flat where nothing was seen. Rows are scored one by one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmurate.llm import blocks
from murmurate.session import written

#: At most four, as the bytes of an n-gram are the lower 32 bits of its number; its order stands above them.
ORDER = 4
#: Weight of each order from one up, then what is left for the flat distribution.
WEIGHTS = (0.02, 0.08, 0.25, 0.64, 0.01)
PIECE = 4 << 20
#: Distinct n-grams a task adds up before it hands them on.
HELD = 1 << 20


def _ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last ``ORDER`` bytes up to each place as a number, and how many of them belong to the text."""
    key = np.zeros(len(data), np.uint32)
    for k in range(min(ORDER, len(data))):
        key[k:] |= data[: len(data) - k].astype(np.uint32) << np.uint32(8 * k)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    return key, np.minimum(place + 1, ORDER)


def _cut(key: np.ndarray, order: int) -> np.ndarray:
    return key & np.uint32((1 << 8 * order) - 1)


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers and how often each stands there."""
    key = np.sort(key)
    begins = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    return key[begins], np.diff(np.append(begins, len(key)))


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    n = np.concatenate([n for _, n in parts])
    return grams, np.stack([np.bincount(at, n[:, side], len(grams)).astype(np.int64) for side in (0, 1)], axis=1)


def counts(docs: DataFrame, target: Column) -> DataFrame:
    """``gram_order, gram, in_target, in_all``: sums over all documents; order zero has the number of tokens."""

    def rows(grams: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for first in range(0, len(grams), 50_000):
            part = slice(first, first + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array((grams[part] >> 32).astype(np.int32)), pa.array(grams[part]), pa.array(n[part, 0]), pa.array(n[part, 1])], ["gram_order", "gram", "in_target", "in_all"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            texts, chosen = batch.column(0), np.array(batch.column(1).fill_null(False))
            for wanted, side in ((chosen, 1), (~chosen, 0)):
                for _, data, offsets in blocks.blocks(texts.filter(pa.array(wanted))):
                    key, inside = _ends(data, offsets)
                    held.append((np.zeros(1, np.int64), np.array([[side * len(data), len(data)]])))
                    for order in range(1, ORDER + 1):
                        grams, n = _distinct(_cut(key[inside >= order], order))
                        held.append((grams.astype(np.int64) | order << 32, np.stack((side * n, n), axis=1)))
                    if sum(len(g) for g, _ in held) > HELD:
                        held = [_added(held)]
                        if len(held[0][0]) > HELD // 2:
                            yield from rows(*held.pop())
        if held:
            yield from rows(*_added(held))

    texts = docs.select(F.col("text"), F.coalesce(target, F.lit(False)).alias("target"))
    found = texts.mapInArrow(add, "gram_order int, gram long, in_target long, in_all long")
    return found.groupBy("gram_order", "gram").agg(F.sum("in_target").alias("in_target"), F.sum("in_all").alias("in_all"))


def _last(gram: Column, order: int) -> Column:
    """The last ``order`` bytes of a longer n-gram."""
    return gram.bitwiseAND(F.lit((1 << 8 * order) - 1).cast("long")).bitwiseOR(F.lit(order << 32).cast("long"))


def _context(gram: Column, order: int) -> Column:
    """All bytes of an n-gram but the last one."""
    return F.shiftright(gram.bitwiseAND(F.lit((1 << 32) - 1).cast("long")), 8).bitwiseOR(F.lit((order - 1) << 32).cast("long"))


@dataclass(frozen=True)
class Model:
    """Counts of both corpora, a row for each distinct n-gram."""

    table: DataFrame

    def losses(self, asked: DataFrame) -> DataFrame:
        """``gram, target_loss, background_loss`` of the byte that ends each of the n-grams in ``asked``.

        Built from order one up: an n-gram meets its count, that of its context and the chance of its
        shorter end, each of which at most 256 n-grams share.
        """
        sides = ("in_target", "in_all")
        out, shorter = [], None
        for order in range(1, ORDER + 1):
            here = asked.where(F.shiftright("gram", 32) >= order).select(_last(F.col("gram"), order).alias("gram")).distinct()
            seen = self.table.where(F.col("gram_order") == order).select("gram", *sides)
            context = self.table.where(F.col("gram_order") == order - 1).select(F.col("gram").alias("context"), *(F.col(x).alias(f"{x}_before") for x in sides))
            here = here.join(seen, "gram", "left").withColumn("context", _context(F.col("gram"), order)).join(context, "context", "left")
            if shorter is not None:
                here = here.withColumn("end", _last(F.col("gram"), order - 1)).join(shorter.select(F.col("gram").alias("end"), *(F.col(f"{x}_chance").alias(f"{x}_end") for x in sides)), "end")
            chances = []
            for x in sides:
                share = F.when(F.col(f"{x}_before") > 0, F.least(F.coalesce(F.col(x), F.lit(0)) / F.col(f"{x}_before"), F.lit(1.0))).otherwise(1 / 256)
                before = F.lit(WEIGHTS[-1] / 256) if shorter is None else F.col(f"{x}_end")
                chances.append((before + WEIGHTS[order - 1] * share).alias(f"{x}_chance"))
            shorter = written(here.select("gram", *chances), "chances")
            # near its start a text has no longer context
            rest = sum(WEIGHTS[order:ORDER]) / 256
            out.append(shorter.select("gram", *((-F.log(F.col(f"{x}_chance") + rest)).alias(name) for x, name in zip(sides, ("target_loss", "background_loss"), strict=True))))
        found = out[0]
        for more in out[1:]:
            found = found.unionByName(more)
        return found


def fit(docs: DataFrame, target: Column, bits: int | None = None) -> Model:
    """Count both corpora. ``bits`` was the size of a hash table; n-grams are exact now and it has no effect."""
    return Model(written(counts(docs, target), "grams"))


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first, size = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        lengths = np.array(pc.binary_length(batch.column(1)).fill_null(0)).astype(np.int64)
        begins = size + np.cumsum(lengths) - lengths
        size += int(lengths.sum())
        yield pa.RecordBatch.from_arrays([pa.array(first + begins // PIECE), batch.column(0), batch.column(1)], ["piece", "doc_id", "text"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct n-grams of each piece; a piece that is read by two tasks asks twice, which does no harm."""

    def rows(piece: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        grams = np.unique(np.concatenate(parts))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), piece)), pa.array(grams)], ["piece", "gram"])

    open_piece, parts = -1, []
    for batch in batches:
        pieces = batch.column(0).to_numpy()
        begins = np.flatnonzero(np.concatenate((np.ones(min(1, len(pieces)), bool), pieces[1:] != pieces[:-1])))
        for begin, end in zip(begins, np.append(begins[1:], len(pieces)), strict=True):
            if pieces[begin] != open_piece and parts:
                yield rows(open_piece, parts)
                parts = []
            open_piece = int(pieces[begin])
            for _, data, offsets in blocks.blocks(batch.column(1).slice(begin, end - begin)):
                key, inside = _ends(data, offsets)
                parts += [_distinct(_cut(key[inside == order], order))[0].astype(np.int64) | order << 32 for order in range(1, ORDER + 1)]
    if parts:
        yield rows(open_piece, parts)


def _scored(texts: pa.Table, losses: pa.Table) -> pa.Table:
    grams = losses["gram"].to_numpy()
    order = np.argsort(grams, kind="stable")
    grams, loss = grams[order], np.stack([losses[name].to_numpy()[order] for name in ("target_loss", "background_loss")])
    ids, out = texts["doc_id"].combine_chunks(), []
    for first, data, offsets in blocks.blocks(texts["text"]):
        key, inside = _ends(data, offsets)
        gram = (key & ((1 << 8 * inside) - 1).astype(np.uint32)).astype(np.int64) | inside << 32
        found = loss[:, np.searchsorted(grams, gram)] if len(gram) else np.zeros((2, 0))
        runs = np.concatenate((np.zeros((2, 1)), np.cumsum(found, axis=1)), axis=1)
        n = np.diff(offsets)
        mean = (runs[:, offsets[1:]] - runs[:, offsets[:-1]]) / np.maximum(n, 1)
        out.append((n, mean[0], mean[1], mean[1] - mean[0]))
    columns = [np.concatenate(x) for x in zip(*out, strict=True)]
    return pa.Table.from_arrays([ids, *(pa.array(x) for x in columns)], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, score``; losses are means per token in nats."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = written(docs.select("doc_id", "text").mapInArrow(_dealt, f"piece long, doc_id {kind}, text string"), "pieces")
    asked = written(pieces.select("piece", "text").mapInArrow(_asked, "piece long, gram long"), "asked")
    losses = model.losses(asked)
    found = asked.join(losses, "gram").select("piece", "gram", "target_loss", "background_loss")
    both = pieces.groupBy("piece").cogroup(found.groupBy("piece"))
    return both.applyInArrow(_scored, f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, score double")
