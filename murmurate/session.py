"""Spark session settings and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from murmurate import files

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Texts go to Python in small batches, as one post may be long.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def build_session(app: str = "murmurate", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the library counts on; ``conf`` adds to them.

    Shuffle partitions are left to the cluster: adaptive execution merges the
    small ones, so a cluster sets them for its largest shuffle.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as ``spark.checkpoint.dir`` names it.

    Where the setting is missing and everything runs in one process, a temporary
    folder is made and used for checkpoints for the rest of the session. On a
    cluster the setting has to be there, as executors do not share local folders.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        folder = tempfile.mkdtemp(prefix="murmurate-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _work_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/murmurate/{spark.sparkContext.applicationId}"


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, kept until :func:`discard_work`."""
    return f"{_work_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def discard_work(spark: SparkSession) -> None:
    """Delete what this application wrote below the shared folder by :func:`work_path`."""
    files.delete(spark, _work_folder(spark))


def written(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """Write a frame that is read more than once below the shared folder and read it back.

    What follows starts from the files, so it neither repeats the work nor loses
    it with an executor.
    """
    path = work_path(df.sparkSession, name)
    df.write.partitionBy(*partitions).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Gives a :func:`written` whose files are deleted at the end of the block."""
    paths = []

    def keep(df: DataFrame, name: str, *partitions: str) -> DataFrame:
        path = work_path(spark, name)
        paths.append(path)
        df.write.partitionBy(*partitions).parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        for path in paths:
            files.delete(spark, path)
