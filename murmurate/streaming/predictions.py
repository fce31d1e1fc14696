"""Score and store posts as they arrive, and count predictions by event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from murmurate.operators.rows import check_constraints, split_accepted
from murmurate.schemas import REQUIRED_FIELDS
from murmurate.session import scratch
from murmurate.sources.store import PredictionStore

# Run over what has arrived, then stop.
ONCE = {"availableNow": True}


def file_stream(
    spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None, **options
) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def store_stream(
    posts: DataFrame,
    to_records: Callable[[DataFrame], DataFrame],
    store: PredictionStore,
    checkpoint: str,
    order: Column | None = None,
    refused: str | None = None,
    trigger: dict | None = None,
    complete: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Every micro-batch is scored by ``to_records`` and upserted.

    A batch that is repeated after a failure leaves the table as it was, so the
    result is exact. State is the table only. ``refused`` is a folder for the
    records that break a rule of the table, with their reasons, per batch. Without
    ``order``, rows of one post count in the order of ``_row`` if the records carry
    it, else in that of their times. ``trigger`` says when batches run, by default once over all
    that has arrived. ``complete`` adds columns that the records do not bring, as in
    :meth:`PredictionStore.upsert`; ``to_records`` leaves out the rows for which there are none, and
    a completed row that breaks a rule fails the batch.
    """

    def completed(posts: DataFrame) -> DataFrame:
        checked = check_constraints(complete(posts))
        fails = F.when(F.size("reasons") > 0, F.raise_error(F.concat_ws(", ", "reasons")).cast("boolean"))
        return checked.where(F.coalesce(fails, F.lit(True))).drop("reasons")

    def save(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession) as keep:
            records = keep(to_records(batch), "records") if refused else to_records(batch)
            later = [c for c in REQUIRED_FIELDS if c not in records.columns] if complete else []
            accepted, rejected = split_accepted(records, later)
            if refused:
                rejected.write.mode("overwrite").parquet(f"{refused}/batch={batch_id}")
            place = F.col("_row") if "_row" in accepted.columns else None
            store.upsert(accepted, place if order is None else order, completed if complete else None)

    return (
        posts.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ONCE))
        .start()
    )


def window_counts(
    predictions: DataFrame, width: str, delay: str = "1 hour", at: str = "predicted_at"
) -> DataFrame:
    """Predictions per label and tumbling window; later ones than ``delay`` are dropped."""
    return (
        predictions.withWatermark(at, delay)
        .groupBy(F.window(at, width).alias("w"), "pred_label")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.col("w.start").alias("time"), "pred_label", "count")
    )


def write_updates(
    counts: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Changed counts of every micro-batch as Parquet, one folder per batch.

    A repeated batch overwrites its own folder.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        counts.writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ONCE))
        .start()
    )


def read_updates(spark: SparkSession, path: str, keys: list[str], value: str = "count") -> DataFrame:
    """The last value of every key."""
    return (
        spark.read.parquet(path).groupBy(*keys).agg(F.max_by(value, "batch").alias(value))
    )


def first_of_each(
    posts: DataFrame, at: str, delay: str, key: str = "id_str", salts: int = 16
) -> DataFrame:
    """One row per post; a repeat is recognised within ``delay``.

    Repeats are dropped per post and salt first, so that the repeats of a hot
    post are spread over tasks and at most ``salts`` of them meet in one. The salt is a hash
    of the row, so a task that is run again deals its rows alike. Which repeat stays is open;
    :func:`earliest_of_each` keeps the first in time.
    """
    salted = posts.withWatermark(at, delay).withColumn(
        "_salt", F.pmod(F.xxhash64(*posts.columns), F.lit(salts))
    )
    return (
        salted.dropDuplicatesWithinWatermark([key, "_salt"])
        .dropDuplicatesWithinWatermark([key])
        .drop("_salt")
    )


def earliest_of_each(posts: DataFrame, at: str, gap: str, delay: str, key: str = "id_str") -> DataFrame:
    """The earliest row of each session of a post: of its repeats that follow each other within ``gap``.

    A session ends ``gap`` after its last row and is given out, once, when the watermark (the latest time
    less ``delay``) has passed that; what comes later than that is dropped. Of rows of one time the least
    in all columns stays. State is a row per open session.
    """
    rest = [c for c in posts.columns if c not in (at, key)]
    row = F.struct(at, *rest)
    sessions = posts.withWatermark(at, delay).groupBy(key, F.session_window(at, gap).alias("_session"))
    return sessions.agg(F.min(row).alias("_row")).select(*(F.col(c) if c == key else F.col(f"_row.{c}").alias(c) for c in posts.columns))


def append_parquet(
    df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or ONCE))
        .start()
    )
