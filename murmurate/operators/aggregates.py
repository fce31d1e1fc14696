"""Grouped counts, shares and batch statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmurate.functions.scalar import percentage, round_numeric


def value_counts(df: DataFrame, *keys: str, name: str = "count") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def share_of_total(counted: DataFrame, count: str = "count", within: Sequence[str] = ()) -> DataFrame:
    """Add ``percentage`` of the total (or of the total per ``within`` key).

    The window runs over the aggregated rows, one per group, never over the
    input.
    """
    total = F.sum(count).over(Window.partitionBy(*within))
    return counted.withColumn("percentage", percentage(F.col(count), total))


def share_where(df: DataFrame, condition: Column) -> DataFrame:
    """Percentage of rows that meet a condition, in one pass; NULL for no rows."""
    return df.agg(percentage(F.count_if(condition), F.count(F.lit(1))).alias("percentage"))


def pivot_keys(
    df: DataFrame, keys: Sequence[str], by: Sequence[str] = ("run_uuid",), rename: dict | None = None
) -> DataFrame:
    """Key/value rows to one row per ``by`` with the largest value of each key."""
    names = rename or {}
    return (
        df.where(F.col("key").isin(*keys))
        .groupBy(*by)
        .agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(names.get(k, k)) for k in keys])
    )


def average_of(key: str, places: int = 4) -> Column:
    """Mean of the values of one key in key/value rows."""
    return round_numeric(F.avg(F.when(F.col("key") == key, F.col("value"))), places)


def batch_stats(df: DataFrame) -> DataFrame:
    """Counts and mean scores of a scored batch, in one aggregate.

    ``average_confidence_score`` leaves out failed rows (score 0) and is 0 when
    all failed.
    """
    return df.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.count_if(F.col("hf_label") == "error").alias("failed"),
        round_numeric(
            F.coalesce(F.avg(F.when(F.col("pred_score") > 0, F.col("pred_score"))), F.lit(0.0)), 4
        ).alias("average_confidence_score"),
        round_numeric(F.avg("pred_score"), 4).alias("mean_score"),
    )


def step_counts(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows left after each of a chain of filters, counted in one pass."""
    alive = F.lit(True)
    counts = [F.count(F.lit(1)).alias("rows_in")]
    for name, keep in steps:
        alive = alive & F.coalesce(keep, F.lit(False))
        counts.append(F.count_if(alive).alias(name))
    return df.agg(*counts)


def choose_best(df: DataFrame, score: str, threshold: float) -> DataFrame:
    """One row: ``accurate`` if the best score passes the threshold, else ``inaccurate``."""
    return df.agg(
        F.when(F.max(score) > threshold, "accurate").otherwise("inaccurate").alias("choice")
    )


#: Registers of a sketch as a power of two; the error of a count is 1.04 / sqrt(4096), 1.6 per cent, as one deviation.
SKETCH = 12


def daily_sketches(df: DataFrame, value: str, at: str = "predicted_at", precision: int = SKETCH) -> DataFrame:
    """``day, sketch``: a mergeable sketch of the different values of a day, of bounded size. Nulls count for nothing."""
    return df.groupBy(F.to_date(at).alias("day")).agg(F.hll_sketch_agg(value, F.lit(precision)).alias("sketch"))


def rolling_distinct(sketches: DataFrame, days: int) -> DataFrame:
    """``day, users``: different values in the ``days`` days up to each day that has a sketch, from sketches alone."""
    spread = sketches.select(F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("later"), "day", "sketch")
    united = spread.groupBy(F.date_add("day", F.col("later")).alias("day")).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("users"))
    return united.join(sketches.select("day"), "day", "left_semi")
