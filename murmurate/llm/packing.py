"""Packing of tokenised documents into fixed windows: concatenate and cut.

Two passes over the partitions. The first tokenises each document once, writes the
ids below the shared folder and numbers the tokens within its partition. The totals
of the partitions, one row each, are summed up in order, which places every document
in one global run of tokens. The second pass cuts that run every ``window`` tokens:
a piece of a document is a row, and a document that crosses a boundary gives one
piece on each side. No document moves between tasks and only the last window may be
short, so the padding of the whole corpus is below one window.

Definitions. A null text is the empty text, whose only token is the end mark. A null
id is kept as it is. Repeated rows are documents of their own. An empty table gives
no pieces. Columns besides the id and the text are ignored. A text of any length is one document,
whose ids are one value of a row; memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurate.llm import tokens
from murmurate.session import work_path

WINDOW = 2048
END = 1
#: Texts per call of the tokeniser.
_TEXTS = 64


def tokenize(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """Ids by the ``tokenizers`` file at ``path`` whose words ``pattern`` cuts, a special token's string as that token:
    ``part, place, doc_id, doc_tokens, ids``: ids are little-endian unsigned 32-bit, ``place`` counts tokens of the partition before."""
    kind, last = docs.schema[doc_id].dataType.simpleString(), np.array([end], "<u4")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, place = tokens.byte_level(path, pattern), TaskContext.get().partitionId(), 0
        for batch in batches:
            for first in range(0, batch.num_rows, _TEXTS):
                piece = batch.slice(first, _TEXTS)
                ids = [np.append(code.encode(x or ""), last).tobytes() for x in piece.column(1).to_pylist()]
                size = np.array([len(x) // 4 for x in ids], np.int64)
                begin = place + np.cumsum(size) - size
                place += int(size.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(ids), pa.int32()), pa.array(begin), piece.column(0), pa.array(size), pa.array(ids, pa.binary())],
                    ["part", "place", "doc_id", "doc_tokens", "ids"],
                )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, f"part int, place long, doc_id {kind}, doc_tokens long, ids binary")


def cut(placed: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pieces of documents whose first token is number ``at`` of the global run."""
    kind = placed.schema["doc_id"].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, _TEXTS):
                rows = batch.slice(first, _TEXTS)
                at, size = (rows.column(k).to_numpy() for k in (1, 2))
                low, high = at // window, (at + size - 1) // window
                count = high - low + 1
                row = np.repeat(np.arange(rows.num_rows), count)
                sequence = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                begin = np.maximum(sequence * window, at[row])
                length = np.minimum((sequence + 1) * window, (at + size)[row]) - begin
                start = begin - at[row]
                ids = rows.column(3).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(size[row]), pa.array(sequence), pa.array(begin - sequence * window),
                        pa.array([ids[r][4 * s : 4 * (s + n)] for r, s, n in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)], pa.binary()),
                    ],
                    ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )

    return placed.select("doc_id", "at", "doc_tokens", "ids").mapInArrow(
        pieces, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    )


def pack(docs: DataFrame, path: str, pattern: str, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """One row per piece: document, place in it, place in its sequence and the ids.

    The totals of the partitions are the only rows that meet in one task and that are
    broadcast: one row for each task of the first pass.
    """
    spark = docs.sparkSession
    folder = work_path(spark, "packing")
    coded = tokenize(docs, path, pattern, doc_id, text, end)
    coded.write.option("compression", "zstd").parquet(folder)
    coded = spark.read.schema(coded.schema).parquet(folder)
    totals = coded.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    before = F.expr("sum(total) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    bases = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    return cut(coded.join(F.broadcast(bases), "part").withColumn("at", F.col("base") + F.col("place")), window)
