"""Hourly sums of predictions, and measures that read rows and sums alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmurate.functions.scalar import Clock, clock, confidence_band
from murmurate.schemas import COUNT_FIELDS

#: What a row of sums stands for.
KEYS = ("predicted_at", "pred_label", "lang", "confidence_range")


def hourly(p: DataFrame, at: Column | None = None) -> DataFrame:
    """Predictions as sums per hour, label, language and band; ``predicted_at`` becomes the hour, or ``at``.

    Sums, numbers and extremes of every measure add up to those of any longer time.
    """
    hour = F.date_trunc("hour", "predicted_at").cast(p.schema["predicted_at"].dataType)
    sums = [F.sum(c).alias(c) for c in COUNT_FIELDS] + [F.count(c).alias(f"n_{c}") for c in COUNT_FIELDS]
    return p.groupBy(
        (hour if at is None else at).alias("predicted_at"), "pred_label", "lang", confidence_band(F.col("pred_score")).alias("confidence_range")
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("pred_score").alias("score"),
        F.count("pred_score").alias("n_score"),
        F.min("pred_score").alias("least_score"),
        F.max("pred_score").alias("most_score"),
        *sums,
    )


class Rows:
    """Measures over single predictions."""

    def __init__(self):
        self.count = F.count(F.lit(1))
        self.least, self.most = F.min("pred_score"), F.max("pred_score")
        self.band = confidence_band(F.col("pred_score"))

    def count_if(self, condition: Column) -> Column:
        return F.count_if(condition)

    def mean(self, name: str) -> Column:
        return F.avg("pred_score" if name == "score" else name)


class Sums:
    """The same measures over hourly sums."""

    def __init__(self):
        self.count = F.sum("n")
        self.least, self.most = F.min("least_score"), F.max("most_score")
        self.band = F.col("confidence_range")

    def count_if(self, condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    def mean(self, name: str) -> Column:
        return F.try_divide(F.sum(name).cast("double"), F.sum(f"n_{name}"))


def measures(p: DataFrame) -> Rows | Sums:
    return Sums() if "confidence_range" in p.columns else Rows()


def since_hour(rows: DataFrame, sums: DataFrame, as_of: Clock, window: str) -> DataFrame:
    """Sums of the time from ``as_of`` less ``window``: whole hours from ``sums``, the cut one at its start from ``rows``.

    The cut hour stands at the start of the window, so a report over the window counts it.
    """
    start = clock(as_of, rows.schema["predicted_at"].dataType.simpleString()) - F.expr(f"INTERVAL {window}")
    first = F.date_trunc("hour", start)
    first = F.when(first == start, first).otherwise(first + F.expr("INTERVAL 1 HOUR"))
    at, day = F.col("predicted_at"), F.col("predicted_date")
    cut = hourly(rows.where((at >= start) & (at < first) & (day >= start.cast("date")) & (day <= first.cast("date"))), start)
    whole = sums.where((at >= first) & (day >= first.cast("date")))
    return whole.drop("predicted_date").unionByName(cut)
