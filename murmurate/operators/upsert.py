"""Insert or update predictions by post id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmurate.schemas import PREDICTION_FIELDS


def one_per_post(incoming: DataFrame, order: Column, key: str = "id_str") -> DataFrame:
    """Rows reduced to one per post: first metadata, last prediction.

    The aggregate combines on the map side, so a post that fills a third of the
    rows reaches the shuffle as one row per task. Whole structs are compared
    by ``order``, which keeps the columns of one row together.
    """
    last = [c for c in PREDICTION_FIELDS if c in incoming.columns]
    first = [c for c in incoming.columns if c not in last and c != key]
    grouped = incoming.groupBy(key).agg(
        F.min_by(F.struct(*first), order).alias("_first"),
        F.max_by(F.struct(*last), order).alias("_last"),
    )
    return grouped.select(
        *[
            F.col(c) if c == key else F.col(f"_last.{c}" if c in last else f"_first.{c}")
            for c in incoming.columns
        ]
    )


def upsert(
    existing: DataFrame,
    incoming: DataFrame,
    order: Column,
    key: str = "id_str",
    complete: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Merge a batch into the existing posts: one aggregate over both, what exists comes first.

    With ``complete`` the batch is reduced to one row per post first, and ``complete`` adds, by a join,
    the columns that the batch does not bring, such as long texts. It has to keep every row it is given.
    """
    if complete:
        incoming, order = complete(one_per_post(incoming, order, key)), F.lit(0)
    batch = incoming.withColumn("_order", order)
    place = batch.schema["_order"].dataType
    columns = existing.columns
    both = existing.withColumns({"_new": F.lit(False), "_order": F.lit(None).cast(place)}).unionByName(
        batch.select(*columns, F.lit(True).alias("_new"), "_order")
    )
    return one_per_post(both, F.struct("_new", "_order"), key).select(*columns)
