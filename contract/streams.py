"""Streaming forms, run to the end of the given events."""

from pyspark.sql import functions as F

from contract.stored import _UPSERT, _upserted, as_predictions, texts_of, with_document
from contract.views import query
from murmurate.schemas import PREDICTION
from murmurate.session import work_path
from murmurate.sources.store import PredictionStore
from murmurate.streaming import predictions as ST


def _records(events):
    """Events as prediction rows, by the same derivation as the batch input."""
    return as_predictions(events).withColumn("predicted_at", F.col("predicted_at").cast("timestamp"))


def _stream(v):
    """The events table as a stream, be it one file or (by the pattern) a folder of files."""
    return ST.file_stream(v.spark, f"{v.folder}/events.parquet*", v.events.schema)


@query("stream_score", "texted", _UPSERT)
def stream_score(v):
    """Rows are scored and reduced to one per post before the texts of the documents are joined to them."""
    store = PredictionStore(v.spark, work_path(v.spark, "stream-store"))
    n_documents = v.documents.count()
    documents = v.documents.where(F.col("text").isNotNull())  # a record without text is refused

    def to_records(batch):
        df = _records(with_document(batch, documents, n_documents)).withColumns(
            {
                "id_str": F.concat(F.lit("post_"), F.col("user_id").cast("string")),
                "doc_ref": F.col("event_id") % n_documents,
            }
        )
        missing = [f for f in PREDICTION.fields if f.name not in (*df.columns, "full_text", "clean_text")]
        return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})

    ST.store_stream(
        _stream(v),
        to_records,
        store,
        work_path(v.spark, "stream-check"),
        F.struct("predicted_at", "event_id"),
        complete=texts_of(documents),
    ).awaitTermination()
    return _upserted(store.read())


def _counts(unit: str) -> str:
    return f"""SELECT cast(date_trunc('{unit}', predicted_at) AS timestamp) AS time, pred_label,
      count(*) AS count FROM predictions GROUP BY 1, 2"""


def _tumbling(v, width):
    path = work_path(v.spark, "windows")
    counts = ST.window_counts(_records(_stream(v)), width)
    ST.write_updates(counts, path, work_path(v.spark, "windows-check")).awaitTermination()
    return ST.read_updates(v.spark, path, ["time", "pred_label"])


@query("stream_tumbling", "predictions", _counts("hour"))
def stream_tumbling(v):
    return _tumbling(v, "1 hour")


@query("stream_tumbling_day", "predictions", _counts("day"))
def stream_tumbling_day(v):
    return _tumbling(v, "1 day")


@query("stream_dedupe", "predictions", """
    SELECT DISTINCT concat('post_', cast(user_id AS varchar)) AS id_str FROM predictions""")
def stream_dedupe(v):
    path = work_path(v.spark, "distinct")
    posts = _records(_stream(v)).select(
        F.concat(F.lit("post_"), F.col("user_id").cast("string")).alias("id_str"), "predicted_at"
    )
    once = ST.first_of_each(posts, "predicted_at", "40 days").select("id_str")
    ST.append_parquet(once, path, work_path(v.spark, "distinct-check")).awaitTermination()
    return v.spark.read.parquet(path)


@query("stream_earliest", "predictions", """
    WITH marked AS (
        SELECT *, predicted_at - lag(predicted_at) OVER (PARTITION BY user_id ORDER BY predicted_at, event_id) > interval '6 hours' AS opens
        FROM predictions),
      numbered AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY user_id ORDER BY predicted_at, event_id) AS session FROM marked),
      sessions AS (
        SELECT concat('post_', cast(user_id AS varchar)) AS id_str, min(predicted_at) AS predicted_at, max(predicted_at) AS last,
          arg_min(event_id, (predicted_at, event_id)) AS event_id, arg_min(pred_label, (predicted_at, event_id)) AS pred_label
        FROM numbered GROUP BY user_id, session)
    SELECT id_str, cast(predicted_at AS timestamp) AS predicted_at, event_id, pred_label FROM sessions
    WHERE last + interval '6 hours' <= (SELECT max(predicted_at) FROM predictions) - interval '1 hour'""")
def stream_earliest(v):
    path = work_path(v.spark, "earliest")
    posts = _records(_stream(v)).select(
        F.concat(F.lit("post_"), F.col("user_id").cast("string")).alias("id_str"), "predicted_at", "event_id", "pred_label"
    )
    once = ST.earliest_of_each(posts, "predicted_at", "6 hours", "1 hour")
    ST.append_parquet(once, path, work_path(v.spark, "earliest-check")).awaitTermination()
    return v.spark.read.parquet(path)


@query("stream_late", "predictions", """
    SELECT date_trunc('hour', predicted_at) AS time, pred_label, count(*) AS count
    FROM predictions
    WHERE predicted_at >= timestamp '2024-01-16' AND date_trunc('hour', predicted_at)
      + interval '1 hour' <= (SELECT max(predicted_at) FROM predictions) - interval '1 hour'
    GROUP BY 1, 2""")
def stream_late(v):
    """The first half of the events arrives last, too late to be counted. Each part is a batch of as many files.

    Spark compares a batch with the watermark of the batch before the last, so
    the second half comes in two batches.
    """
    landing = work_path(v.spark, "landing")
    files = v.spark.sparkContext.defaultParallelism
    half, three_quarters = (F.lit(d).cast("timestamp_ntz") for d in ("2024-01-16", "2024-01-23"))
    ts = F.col("ts")
    for part in ((ts >= half) & (ts < three_quarters), ts >= three_quarters, ts < half):
        v.events.where(part).repartition(files).write.mode("append").parquet(landing)
    stream = ST.file_stream(v.spark, landing, v.events.schema, files_per_batch=files)
    path = work_path(v.spark, "late")
    counts = ST.window_counts(_records(stream), "1 hour")
    ST.append_parquet(counts, path, work_path(v.spark, "late-check")).awaitTermination()
    return v.spark.read.parquet(path)
