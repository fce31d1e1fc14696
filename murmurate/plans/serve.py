"""Score batches of posts and store the predictions."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurate.functions.scalar import Clock, clock, parse_created_at
from murmurate.operators.aggregates import batch_stats, value_counts
from murmurate.operators.learn import Scorer, score_batch, score_posts
from murmurate.operators.rows import (
    require_columns,
    split_accepted,
    typed_requests,
    with_defaults,
)
from murmurate.schemas import PREDICTION
from murmurate.session import scratch
from murmurate.sources.csv import read_csv, write_csv
from murmurate.sources.store import PredictionStore


def prediction_records(
    scored: DataFrame, run_id: str | None, as_of: Clock, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Scored posts as prediction records: defaults, parsed date, run and time.

    Failed rows make no record. The time is one per batch; ``keep`` names
    columns to carry along, such as the row order.
    """
    df = with_defaults(scored.where(F.col("hf_label") != "error"))
    created = df.schema["created_at"].dataType.typeName()
    return df.withColumns(
        {
            "created_at": parse_created_at(F.col("created_at"))
            if created == "string"
            else F.col("created_at"),
            "original_label": F.col("label"),
            "model_run_id": F.lit(run_id).cast("string"),
            "predicted_at": clock(as_of),
        }
    ).select([f.name for f in PREDICTION.fields] + list(keep))


def request_records(
    scorer: Scorer, run_id: str | None, as_of: Clock, column: str = "value"
) -> Callable[[DataFrame], DataFrame]:
    """From JSON requests to prediction records, for a batch or a stream of them.

    Requests that break the record's types are left out, as are those that
    cannot be scored. ``_row`` keeps the order of arrival.
    """

    def records(requests: DataFrame) -> DataFrame:
        parsed = typed_requests(
            requests.withColumn("_row", F.monotonically_increasing_id()), column
        ).where("accepted")
        posts = parsed.drop(column, "accepted")
        return prediction_records(score_posts(posts, scorer), run_id, as_of, ("_row",))

    return records


def _report(scored: DataFrame, started: float) -> dict:
    """Statistics of a scored batch: counts, label distribution, mean score, time."""
    elapsed = (time.monotonic() - started) * 1000
    stats = batch_stats(scored).first().asDict()
    stats["label_distribution"] = {
        r.pred_label: r["count"] for r in value_counts(scored, "pred_label").collect()
    }
    stats["inference_time_ms"] = round(elapsed, 2)
    stats["avg_time_per_prediction_ms"] = round(elapsed / max(stats["total_predictions"], 1), 2)
    return stats


def score_texts_job(
    spark: SparkSession, source: str, target: str, scorer: Scorer, line_breaks: bool = True
) -> dict:
    """CSV with ``text`` to ``<target>/predictions_batch.csv``; statistics of the batch.

    The scored rows are written once and read again, so the model runs once.
    """
    with scratch(spark) as keep:
        started = time.monotonic()
        scored = keep(score_batch(read_csv(spark, source, line_breaks=line_breaks), scorer), "scored")
        report = _report(scored, started)
        report["output"] = write_csv(scored, f"{target}/predictions_batch.csv")
    return report


def score_posts_job(
    spark: SparkSession,
    source: str,
    target: str,
    scorer: Scorer,
    store: PredictionStore,
    run_id: str | None,
    as_of: Clock,
    line_breaks: bool = True,
) -> dict:
    """CSV of posts to scored CSV and to the store; statistics and what became of the rows.

    Rows of one post count in the order of the file names and of their places in the
    files. ``saved`` are the records that keep the rules of the table, ``rejected``
    those that do not.
    """
    posts = require_columns(read_csv(spark, source, line_breaks=line_breaks), ["id_str", "clean_text"])
    place = F.struct(
        F.input_file_name().alias("file"),
        F.expr("input_file_block_start()").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    posts = posts.withColumn("_row", place)
    stamp = spark.range(1).select(F.date_format(clock(as_of), "yyyyMMdd_HHmmss")).first()[0]
    with scratch(spark) as keep:
        started = time.monotonic()
        scored = keep(
            score_posts(posts, scorer), "scored"
        )
        report = _report(scored, started)
        report["output"] = write_csv(
            scored.drop("_row"), f"{target}/predictions_batch_tweet_{stamp}.csv"
        )
        accepted, rejected = split_accepted(prediction_records(scored, run_id, as_of, ("_row",)))
        store.upsert(accepted, F.col("_row"))
        report["rejected"] = rejected.count()
    report["saved"] = report["total_predictions"] - report["failed"] - report["rejected"]
    return report
