"""Train, judge and log a model."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurate import files
from murmurate.functions.scalar import Clock, clock
from murmurate.operators.evaluate import basic_metrics, class_report, confusion_matrix, pair_counts
from murmurate.operators.rows import as_label, drop_missing, require_columns
from murmurate.operators.runs import pick_stage_model, register_versions
from murmurate.operators.softmax import SoftmaxModel, fit
from murmurate.operators.split import only, stratified_split
from murmurate.schemas import CLASSES, MIN_F1_MACRO, RUNS, VERSIONS
from murmurate.session import scratch, written
from murmurate.sources.tables import write_reports


@dataclass
class Training:
    model: SoftmaxModel
    metrics: dict[str, float]
    accepted: bool
    run_uuid: str


def training_rows(df: DataFrame) -> DataFrame:
    """Rows with text and label, label as an integer."""
    require_columns(df, ["clean_text", "label"])
    return drop_missing(df, ["clean_text", "label"]).withColumn("label", as_label(F.col("label")))


def split_rows(
    data: DataFrame, key: list[str], keep: Callable[..., DataFrame] = written
) -> tuple[DataFrame, DataFrame]:
    """Train and validation rows; the split is made once and kept as files."""
    split = keep(stratified_split(training_rows(data), key), "split", "split")
    return only(split, "train"), only(split, "validation")


def evaluate(model: PipelineModel | SoftmaxModel, df: DataFrame) -> DataFrame:
    """Counts per (true, predicted) class, with the sum of their log losses."""
    chance = F.coalesce(
        F.get(vector_to_array("probability"), F.col("label").cast("int")), F.lit(0.0)
    )
    scored = model.transform(df).withColumns(
        {
            "prediction": F.col("prediction").cast("int"),
            "loss": -F.ln(F.greatest(chance, F.lit(1e-15))),
        }
    )
    return pair_counts(scored, extra=[F.sum("loss").alias("loss")])


def evaluate_job(model: PipelineModel | SoftmaxModel, df: DataFrame, folder: str) -> str:
    """Metrics, class report and confusion matrix of a labelled set, as files."""
    with scratch(df.sparkSession) as keep:
        pairs = keep(evaluate(model, training_rows(df)), "pairs")  # the model runs once
        return write_reports(basic_metrics(pairs), class_report(pairs), confusion_matrix(pairs, CLASSES), folder)


def newest_model(
    spark: SparkSession, runs_folder: str, model_folder: str, experiment_id: int
) -> str | None:
    """Path of the model of the newest run, if there is a run and it saved one."""
    if not files.exists(spark, f"{runs_folder}/runs"):
        return None
    newest = (
        spark.read.schema(RUNS)
        .parquet(f"{runs_folder}/runs")
        .where((F.col("experiment_id") == experiment_id) & F.col("deleted_time").isNull())
        .orderBy(F.desc_nulls_first("start_time"), F.desc_nulls_last("end_time"), "run_uuid")
        .first()
    )
    path = f"{model_folder}/{newest.run_uuid}" if newest else None
    return path if path and files.exists(spark, path) else None


def train(
    spark: SparkSession,
    week: DataFrame,
    key: list[str],
    as_of: Clock,
    runs_folder: str,
    model_folder: str,
    experiment_id: int = 0,
    threshold: float = MIN_F1_MACRO,
    params: dict | None = None,
    model_name: str = "sentiment",
    stage: str = "Staging",
) -> Training:
    """Split, fit, evaluate, log, and save and register the model if its macro F1 passes.

    If the newest run has a model, training goes on from its coefficients, with the lowest
    layers frozen; earlier weeks are not read again. Otherwise it starts afresh. ``params`` are
    those of :func:`murmurate.operators.softmax.fit`. The run starts at ``as_of`` and ends as much
    later as it took.
    """
    started = time.monotonic()
    previous = newest_model(spark, runs_folder, model_folder, experiment_id)
    incremental = previous is not None
    settings = {"learning_rate": 3.0, "epochs": 3, "weight_decay": 0.001, **(params or {})}
    with scratch(spark) as keep:
        train_rows, validation_rows = split_rows(week, key, keep)
        fitted = fit(train_rows, SoftmaxModel.load(spark, previous) if incremental else None, **settings)
        model = fitted.model
        pairs = keep(evaluate(model, validation_rows), "pairs")
        metrics = basic_metrics(pairs).first().asDict()
        metrics["loss"] = pairs.agg(F.sum("loss") / F.sum("n")).first()[0]

    accepted = (metrics["f1_macro"] or 0.0) >= threshold
    stamp = spark.range(1).select(F.date_format(clock(as_of), "yyyyMMdd_HHmmss")).first()[0]
    name = f"sentiment-{'incremental' if incremental else 'fresh'}-{stamp}"
    run_uuid = f"{name}-{uuid.uuid4().hex}"
    if accepted:
        model.save(spark, f"{model_folder}/{run_uuid}")
    log_run(
        spark,
        runs_folder,
        run_uuid,
        name,
        experiment_id,
        as_of,
        time.monotonic() - started,
        params={
            "epochs": str(settings["epochs"]),
            "learning_rate": str(settings["learning_rate"]),
            "batch_size": str(fitted.batch_size),
            "weight_decay": str(settings["weight_decay"]),
            "freeze_layers": str(fitted.frozen),
            "features": str(model.features),
            "is_incremental": str(incremental),
            "min_f1_macro_threshold": str(threshold),
            "model_accepted": str(accepted),
        },
        metrics={f"eval_{k}": v for k, v in metrics.items() if v is not None},
        tags={"model_status": "accepted" if accepted else "rejected"},
    )
    if accepted:
        register_model(spark, runs_folder, model_name, run_uuid, stage)
    return Training(model, metrics, accepted, run_uuid)


def model_versions(spark: SparkSession, runs_folder: str) -> DataFrame:
    """The registered versions; none yet gives an empty frame."""
    path = f"{runs_folder}/versions"
    if not files.exists(spark, path):
        return spark.createDataFrame([], VERSIONS)
    return spark.read.schema(VERSIONS).parquet(path)


def register_model(
    spark: SparkSession, runs_folder: str, model_name: str, run_uuid: str, stage: str = "Staging"
) -> None:
    """Append the model of a run as the next version of its name."""
    new = spark.createDataFrame([(model_name, stage, run_uuid)], "model_name string, stage string, run_uuid string")
    register_versions(model_versions(spark, runs_folder), new).write.mode("append").parquet(f"{runs_folder}/versions")


def serving_model(
    spark: SparkSession, runs_folder: str, model_folder: str, model_name: str = "sentiment"
) -> PipelineModel | SoftmaxModel:
    """The registered model that serves: the highest version in the first stage that has one."""
    chosen = pick_stage_model(model_versions(spark, runs_folder).where(F.col("model_name") == model_name)).first()
    if chosen is None:
        raise ValueError(f"no version of {model_name} is in a serving stage")
    path = f"{model_folder}/{chosen.run_uuid}"
    return SoftmaxModel.load(spark, path) if files.exists(spark, f"{path}/coefficients") else PipelineModel.load(path)


def log_run(
    spark: SparkSession,
    folder: str,
    run_uuid: str,
    name: str,
    experiment_id: int,
    as_of: Clock,
    seconds: float,
    params: dict[str, str],
    metrics: dict[str, float],
    tags: dict[str, str],
) -> None:
    """Append one run that took so many seconds to the run tables; the run itself comes last."""
    now = clock(as_of)
    run = spark.range(1).select(
        F.lit(run_uuid).alias("run_uuid"),
        F.lit(name).alias("name"),
        F.lit("FINISHED").alias("status"),
        F.lit(experiment_id).alias("experiment_id"),
        now.alias("start_time"),
        F.timestamp_micros(F.unix_micros(now) + F.lit(round(seconds * 1e6))).alias("end_time"),
        F.lit(None).cast("timestamp").alias("deleted_time"),
    )
    for table, pairs in (("params", params), ("tags", tags)):
        rows = [(run_uuid, k, v) for k, v in pairs.items()]
        spark.createDataFrame(rows, "run_uuid string, key string, value string").coalesce(
            1
        ).write.mode("append").parquet(f"{folder}/{table}")
    rows = [(run_uuid, k, float(v)) for k, v in metrics.items()]
    spark.createDataFrame(rows, "run_uuid string, key string, value double").select(
        "*", F.lit(0).cast("long").alias("step"), now.alias("timestamp")
    ).coalesce(1).write.mode("append").parquet(f"{folder}/metrics")
    run.write.mode("append").parquet(f"{folder}/runs")
