"""Contract checks of a labelled dataset."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurate.schemas import CLASSES, MIN_DATASET_ROWS


def _check(name: str, passed: Column, observed: Column, expected: int) -> Column:
    return F.struct(
        F.lit(name).alias("check"),
        passed.alias("passed"),
        observed.cast("long").alias("observed"),
        F.lit(expected).cast("long").alias("expected"),
    )


def check_dataset(
    spark: SparkSession,
    read: Callable[[], DataFrame],
    columns: Sequence[str] = ("clean_text", "label"),
    classes: Sequence[int] = CLASSES,
    min_rows: int = MIN_DATASET_ROWS,
) -> DataFrame:
    """Dataset is there, has its columns, no missing label, labels in range, enough rows.

    One row per check from one aggregate over the data. ``observed`` counts the
    offending rows for ``no_null`` and ``range``, all rows for ``min_rows``. A
    dataset that cannot be read fails ``exists`` and is not checked further; one
    without label fails the checks on it.
    """
    try:
        df = read()
    except (AnalysisException, FileNotFoundError):
        missing = _check("exists", F.lit(False), F.lit(0), 1)
        return spark.range(1).select(F.inline(F.array(missing)))
    present = sum(c in df.columns for c in columns)
    label = F.col("label") if "label" in df.columns else F.lit(None)
    counted = df.agg(
        F.count_if(label.isNull()).alias("nulls"),
        F.count_if(~F.coalesce(label.isin(*classes), F.lit(False))).alias("outside"),
        F.count(F.lit(1)).alias("total"),
    )
    return counted.select(
        F.inline(
            F.array(
                _check("exists", F.lit(True), F.lit(1), 1),
                _check("columns", F.lit(present == len(columns)), F.lit(present), len(columns)),
                _check("no_null", F.col("nulls") == 0, F.col("nulls"), 0),
                _check("range", F.col("outside") == 0, F.col("outside"), 0),
                _check("min_rows", F.col("total") >= min_rows, F.col("total"), min_rows),
            )
        )
    )
