"""The few file operations that DataFrame readers and writers do not offer.

All go through Hadoop's FileSystem, so they work on any storage Spark can read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Rename; what stood at the target is deleted only after the move has worked."""
    fs, p = _fs(spark, source)
    _, q = _fs(spark, target)
    if fs.makeQualified(p).equals(fs.makeQualified(q)):
        raise ValueError(f"{source} would replace itself")
    _, aside = _fs(spark, f"{target.rstrip('/')}.replaced-{uuid.uuid4().hex[:12]}")
    moved = fs.exists(q) and fs.rename(q, aside)
    if not fs.rename(p, q):
        if moved:
            fs.rename(aside, q)
        raise OSError(f"could not rename {source} to {target}")
    if moved:
        fs.delete(aside, True)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def glob(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match ``pattern`` (one level, files or folders)."""
    fs, p = _fs(spark, pattern)
    return sorted(s.getPath().toString() for s in (fs.globStatus(p) or []))
