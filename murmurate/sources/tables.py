"""Run tables, views and small report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurate.schemas import EXPERIMENTS, METRICS, PARAMS, RUNS, TAGS

RUN_TABLES = {
    "experiments": EXPERIMENTS,
    "runs": RUNS,
    "metrics": METRICS,
    "params": PARAMS,
    "tags": TAGS,
}


def as_record(df: DataFrame, schema) -> DataFrame:
    """Columns of the record; times given in epoch milliseconds become timestamps."""
    out = []
    for f in schema.fields:
        c = F.col(f.name)
        if f.dataType.typeName() == "timestamp" and df.schema[f.name].dataType.typeName() == "long":
            c = F.timestamp_millis(c)
        elif not df.schema[f.name].dataType.typeName().startswith("timestamp"):
            c = c.cast(f.dataType)
        out.append(c.alias(f.name))
    return df.select(out)


def read_runs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The five run tables from ``<folder>/<table>`` Parquet."""
    return {
        name: as_record(spark.read.parquet(f"{folder}/{name}"), schema)
        for name, schema in RUN_TABLES.items()
    }


def register(frames: dict[str, DataFrame]) -> None:
    """Make frames known to SQL under their names."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, bounds: tuple, parts: int, **options):
    """A database table in parallel ranges of a numeric or date key."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url,
            dbtable=table,
            partitionColumn=key,
            lowerBound=str(bounds[0]),
            upperBound=str(bounds[1]),
            numPartitions=parts,
            **options,
        )
        .load()
    )


def write_reports(metrics: DataFrame, classes: DataFrame, confusion: DataFrame, folder: str) -> str:
    """Evaluation results: metrics as JSON, class report and confusion matrix as CSV.

    The three frames have a row per metric set or class, so one file each.
    """
    metrics.coalesce(1).write.mode("overwrite").json(f"{folder}/eval_metrics")
    for name, df in (("classification_report", classes), ("confusion_matrix", confusion)):
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
    return folder
