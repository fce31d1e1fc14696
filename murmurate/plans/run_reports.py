"""Reports over training runs.

``t`` holds the five run tables by name. Key/value tables are reduced to one row
per run before they are joined, so that metrics, parameters and tags do not
multiply each other. Reports on the newest runs pick those first and read the
key/value rows of no other run.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurate.functions.scalar import (
    Clock,
    accepted_flag,
    accepted_text,
    duration_minutes,
    round_numeric,
)
from murmurate.operators.aggregates import average_of, pivot_keys, share_of_total
from murmurate.operators.joins import rows_of
from murmurate.operators.rows import recent
from murmurate.operators.runs import latest_runs
from murmurate.schemas import MIN_F1_MACRO

Tables = Mapping[str, DataFrame]


def active_runs(t: Tables, experiment: str) -> DataFrame:
    """Runs of the experiment that are not deleted."""
    wanted = t["experiments"].where(F.col("name") == experiment).select("experiment_id")
    return t["runs"].where(F.col("deleted_time").isNull()).join(wanted, "experiment_id")


def window_runs(t: Tables, experiment: str, as_of: Clock, window: str) -> DataFrame:
    """Active runs that started in the window."""
    return recent(active_runs(t, experiment), "start_time", as_of, window)


def _named(runs: DataFrame) -> DataFrame:
    return runs.withColumnRenamed("name", "run_name")


def _values(
    t: Tables, runs: DataFrame, wanted: Mapping[str, Mapping[str, str]], pick: Callable = F.max
) -> DataFrame:
    """One row per run of a top-n result: per table the picked value of each key, under the given name.

    The key/value tables are one stream of rows, so the few runs are broadcast once.
    """
    parts, columns = [], []
    for table, keys in wanted.items():
        is_number = table == "metrics"
        value = F.col("value")
        parts.append(
            t[table].where(F.col("key").isin(*keys)).select(
                "run_uuid",
                F.concat(F.lit(f"{table}."), "key").alias("place"),
                (value if is_number else F.lit(None).cast("double")).alias("number"),
                (F.lit(None).cast("string") if is_number else value).alias("text"),
            )
        )
        columns += [
            pick(F.when(F.col("place") == f"{table}.{key}", F.col("number" if is_number else "text"))).alias(name)
            for key, name in keys.items()
        ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows_of(rows, F.broadcast(runs)).groupBy("run_uuid").agg(*columns)


def _same(*keys: str) -> dict[str, str]:
    return {key: key for key in keys}


def latest_run(t: Tables, experiment: str) -> DataFrame:
    runs = latest_runs(t["runs"], t["experiments"], experiment, 1)
    values = _values(
        t,
        runs,
        {
            "metrics": _same("eval_accuracy", "eval_f1_macro", "eval_loss"),
            "params": _same("model_accepted", "epochs", "learning_rate", "is_incremental"),
            "tags": _same("model_status"),
        },
    )
    return runs.join(values, "run_uuid", "left").select(
        F.col("run_uuid").alias("run_id"),
        F.col("name").alias("run_name"),
        "status",
        "start_time",
        "end_time",
        "eval_accuracy",
        "eval_f1_macro",
        "eval_loss",
        "model_accepted",
        "model_status",
        "epochs",
        "learning_rate",
        "is_incremental",
    )


def f1_over_time(t: Tables, experiment: str, as_of: Clock, threshold: float = MIN_F1_MACRO) -> DataFrame:
    runs = window_runs(t, experiment, as_of, "30 days")
    scores = t["metrics"].where(F.col("key") == "eval_f1_macro").select("run_uuid", "value")
    return scores.join(runs, "run_uuid").select(
        F.col("start_time").alias("time"),
        F.col("value").alias("f1_macro_score"),
        F.col("name").alias("run_name"),
        accepted_text(F.col("value"), threshold).alias("status"),
    ).orderBy(F.asc_nulls_last("time"))


def acceptance_rate(t: Tables, experiment: str, as_of: Clock) -> DataFrame:
    """Grouped by the raw value: several texts other than ``True`` give several rows."""
    params = t["params"].where(F.col("key") == "model_accepted")
    runs = window_runs(t, experiment, as_of, "30 days")
    counted = rows_of(params, runs).groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    return share_of_total(counted).select(
        F.when(F.col("value") == "True", "Accepted").otherwise("Rejected").alias("status"),
        "count",
        "percentage",
    )


def average_metrics(t: Tables, experiment: str, as_of: Clock) -> DataFrame:
    """Means over metric rows, not over runs."""
    runs = window_runs(t, experiment, as_of, "7 days")
    return rows_of(t["metrics"], runs).agg(
        average_of("eval_accuracy").alias("avg_accuracy"),
        average_of("eval_f1_macro").alias("avg_f1_macro"),
        average_of("eval_loss").alias("avg_loss"),
        F.count_distinct("run_uuid").alias("total_runs"),
    )


def compare_runs(t: Tables, experiment: str, n: int = 10) -> DataFrame:
    runs = latest_runs(t["runs"], t["experiments"], experiment, n)
    values = _values(
        t,
        runs,
        {
            "metrics": {"eval_f1_macro": "f1_macro", "eval_accuracy": "accuracy", "eval_loss": "loss"},
            "params": {
                "epochs": "epochs",
                "learning_rate": "lr",
                "model_accepted": "accepted",
                "is_incremental": "incremental",
            },
        },
    )
    out = _named(runs).join(values, "run_uuid", "left")
    return out.orderBy(F.desc_nulls_first("start_time"), "run_uuid").select(
        "start_time",
        "run_name",
        *[round_numeric(F.col(c), 4).alias(c) for c in ("f1_macro", "accuracy", "loss")],
        "epochs",
        "lr",
        "accepted",
        "incremental",
        duration_minutes(F.col("start_time"), F.col("end_time")).alias("duration_min"),
    )


def duration_trend(t: Tables, experiment: str, as_of: Clock) -> DataFrame:
    ended = recent(active_runs(t, experiment), "start_time", as_of, "30 days").where(
        F.col("end_time").isNotNull()
    )
    kind = pivot_keys(rows_of(t["params"], ended), ["is_incremental"])
    return _named(ended).join(kind, "run_uuid", "left").orderBy(F.asc_nulls_last("start_time")).select(
        F.col("start_time").alias("time"),
        "run_name",
        duration_minutes(F.col("start_time"), F.col("end_time")).alias("duration_minutes"),
        "is_incremental",
    )


def latest_status(t: Tables, experiment: str) -> DataFrame:
    """1 or 0 for the newest run; of repeated keys the smallest value counts."""
    runs = latest_runs(t["runs"], t["experiments"], experiment, 1)
    wanted = {"params": {"model_accepted": "accepted"}, "metrics": {"eval_f1_macro": "f1_score"}}
    return runs.join(_values(t, runs, wanted, F.min), "run_uuid", "left").select(
        F.col("start_time").alias("time"),
        accepted_flag(F.col("accepted")).alias("is_accepted"),
        "f1_score",
    )


def incremental_vs_fresh(t: Tables, experiment: str, as_of: Clock) -> DataFrame:
    runs = window_runs(t, experiment, as_of, "30 days")
    kind = t["params"].where(F.col("key") == "is_incremental").select(
        "run_uuid", F.col("value").alias("training_type")
    )
    return (
        rows_of(t["metrics"], runs)
        .join(rows_of(kind, runs), "run_uuid")
        .groupBy("training_type")
        .agg(
            average_of("eval_f1_macro").alias("avg_f1_macro"),
            average_of("eval_accuracy").alias("avg_accuracy"),
            F.count_distinct("run_uuid").alias("run_count"),
        )
    )


def metrics_detail(t: Tables, experiment: str, as_of: Clock) -> DataFrame:
    runs = _named(window_runs(t, experiment, as_of, "7 days"))
    return t["metrics"].join(runs, "run_uuid").orderBy(
        F.desc_nulls_first("start_time"), F.asc_nulls_last("key")
    ).select(
        F.col("start_time").alias("time"),
        "run_name",
        F.col("key").alias("metric_name"),
        round_numeric(F.col("value"), 4).alias("metric_value"),
        "step",
        "timestamp",
    )


def param_distribution(
    t: Tables,
    experiment: str,
    as_of: Clock,
    keys=("epochs", "learning_rate", "batch_size", "freeze_layers"),
) -> DataFrame:
    runs = window_runs(t, experiment, as_of, "30 days")
    params = t["params"].where(F.col("key").isin(*keys))
    counted = rows_of(params, runs).groupBy("key", "value").agg(
        F.count(F.lit(1)).alias("usage_count")
    )
    return (
        share_of_total(counted, "usage_count", ["key"])
        .withColumnRenamed("key", "parameter")
        .orderBy("parameter", F.desc("usage_count"))
    )
