"""Classification metrics from one count per (true, predicted) pair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmurate.functions.scalar import round_numeric

PLACES = 6


def pair_counts(
    df: DataFrame, y: str = "label", yhat: str = "prediction", extra: Sequence[Column] = ()
) -> DataFrame:
    """Rows per (true, predicted) class, and further aggregates if wanted."""
    return df.groupBy(F.col(y).alias("y"), F.col(yhat).alias("yhat")).agg(
        F.count(F.lit(1)).alias("n"), *extra
    )


def _per_class(pairs: DataFrame) -> DataFrame:
    """Hits, support and predictions of every class that is true or predicted."""
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(
            F.col("y").alias("class"),
            F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(zero).alias("hits"),
            F.col("n").alias("support"),
            zero.alias("predicted"),
        ),
        F.struct(
            F.col("yhat").alias("class"),
            zero.alias("hits"),
            zero.alias("support"),
            F.col("n").alias("predicted"),
        ),
    )
    sums = (
        pairs.select(F.inline(sides))
        .groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("hits", "support", "predicted")])
    )

    def ratio(a, b):
        return F.coalesce(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))

    return sums.withColumns(
        {
            "precision": ratio(F.col("hits"), F.col("predicted")),
            "recall": ratio(F.col("hits"), F.col("support")),
            "f1": ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")),
        }
    )


def _weighted(c: str):
    return F.sum(F.col(c) * F.col("support")) / F.nullif(F.sum("support").cast("double"), F.lit(0.0))


def basic_metrics(pairs: DataFrame) -> DataFrame:
    """One row: accuracy, macro F1, weighted precision, recall and F1."""
    return _per_class(pairs).agg(
        *[
            round_numeric(c, PLACES).alias(name)
            for name, c in {
                "accuracy": F.sum("hits") / F.nullif(F.sum("support").cast("double"), F.lit(0.0)),
                "f1_macro": F.avg("f1"),
                "precision": _weighted("precision"),
                "recall": _weighted("recall"),
                "f1_score": _weighted("f1"),
            }.items()
        ]
    )


def class_report(pairs: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, then the summary rows.

    The ``accuracy`` row repeats its value in all four columns.
    """
    classes = _per_class(pairs)
    columns = ["precision", "recall", "f1", "support"]
    rows = classes.select(
        F.col("class").cast("string").alias("class"),
        *[F.col(c).cast("double").alias(c) for c in columns],
    )
    accuracy = F.sum("hits") / F.nullif(F.sum("support").cast("double"), F.lit(0.0))
    summary = classes.agg(
        F.array(
            F.struct(F.lit("accuracy").alias("class"), *[accuracy.alias(c) for c in columns]),
            F.struct(
                F.lit("macro avg").alias("class"),
                *[F.avg(c).alias(c) for c in columns[:3]],
                F.sum("support").cast("double").alias("support"),
            ),
            F.struct(
                F.lit("weighted avg").alias("class"),
                *[_weighted(c).alias(c) for c in columns[:3]],
                F.sum("support").cast("double").alias("support"),
            ),
        ).alias("rows")
    ).select(F.inline("rows"))
    out = rows.unionByName(summary)
    return out.select(
        "class",
        *[round_numeric(F.col(c), PLACES).alias("f1_score" if c == "f1" else c) for c in columns],
    )


def confusion_counts(pairs: DataFrame) -> DataFrame:
    """The matrix in long form, whatever the number of classes: ``true_label, pred_label, n``, zeros included."""
    classes = pairs.agg(F.array_distinct(F.concat(F.collect_set("y"), F.collect_set("yhat"))).alias("all"))
    cells = classes.select(F.explode("all").alias("true_label"), "all").select(
        "true_label", F.explode("all").alias("pred_label")
    )
    counted = pairs.select(F.col("y").alias("true_label"), F.col("yhat").alias("pred_label"), "n")
    return cells.join(counted, ["true_label", "pred_label"], "left").na.fill(0, ["n"])


def confusion_matrix(pairs: DataFrame, classes: Sequence[int]) -> DataFrame:
    """Dense matrix: a row per true class, a column ``pred_<class>`` per class.

    The columns are the classes the caller names; a pair with another class fails
    the query. Without names see :func:`confusion_counts`.
    """
    known = F.col("y").isin(*classes) & F.col("yhat").isin(*classes)
    pairs = pairs.where(
        F.when(known, True).otherwise(
            F.raise_error(F.concat_ws(" ", F.lit("a class that is not named:"), "y", "yhat")).cast("boolean")
        )
    )
    empty = pairs.sparkSession.createDataFrame([(c, c, 0) for c in classes], "y int, yhat int, n long")
    dense = pairs.select(F.col("y").cast("int"), F.col("yhat").cast("int"), "n").unionByName(empty)
    return (
        dense.groupBy(F.col("y").alias("true_label"))
        .agg(
            *[
                F.sum(F.when(F.col("yhat") == c, F.col("n")).otherwise(0)).alias(f"pred_{c}")
                for c in classes
            ]
        )
    )
