"""Training runs: log rows, acceptance, model selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurate.schemas import MIN_F1_MACRO

# Stages a model is taken from, best first.
SERVING_STAGES = ("Production", "Staging")


def key_values(wide: DataFrame, columns: Mapping[str, str], kind: str = "string") -> DataFrame:
    """One row per run and key from a wide frame; ``columns`` maps key to column.

    Missing values are not logged.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(key).alias("key"), F.col(c).cast(kind).alias("value"))
            for key, c in columns.items()
        ]
    )
    return wide.select("run_uuid", F.inline(pairs)).where(F.col("value").isNotNull())


def gate(df: DataFrame, score: str = "eval_f1_macro", threshold: float = MIN_F1_MACRO) -> DataFrame:
    """Add ``model_accepted`` (``True`` / ``False``) and ``model_status``.

    A run without a score counts as 0 and is rejected.
    """
    ok = F.coalesce(F.col(score), F.lit(0.0)) >= threshold
    return df.withColumns(
        {
            "model_accepted": F.when(ok, "True").otherwise("False"),
            "model_status": F.when(ok, "accepted").otherwise("rejected"),
        }
    )


def latest_runs(runs: DataFrame, experiments: DataFrame, experiment: str, n: int = 1) -> DataFrame:
    """The newest ``n`` runs of an experiment that are not deleted."""
    wanted = experiments.where(F.col("name") == experiment).select("experiment_id")
    return (
        runs.where(F.col("deleted_time").isNull())
        .join(wanted, "experiment_id")
        .orderBy(F.desc_nulls_first("start_time"), "run_uuid")
        .limit(n)
    )


def pick_latest_model(
    runs: DataFrame,
    experiments: DataFrame,
    artifacts: DataFrame,
    experiment: str,
    fallback: bool = False,
) -> DataFrame:
    """``(run_uuid, model_uri)`` of the newest run, if it has a model.

    Only the newest run is looked at, so one without a model hides the older
    ones; ``fallback`` searches back to the newest run that has one.
    """
    models = artifacts.where(F.col("path") == "model").select("run_uuid")
    if fallback:
        runs = runs.join(models, "run_uuid", "left_semi")
    latest = latest_runs(runs, experiments, experiment).select("run_uuid")
    if not fallback:
        latest = models.join(F.broadcast(latest), "run_uuid", "left_semi").distinct()
    return latest.select(
        "run_uuid", F.concat(F.lit("runs:/"), F.col("run_uuid"), F.lit("/model")).alias("model_uri")
    )


def pick_stage_model(versions: DataFrame, stages: Sequence[str] = SERVING_STAGES) -> DataFrame:
    """Per model, the highest version of the first stage that has one."""
    rank = F.coalesce(*[F.when(F.col("stage") == s, F.lit(-i)) for i, s in enumerate(stages)])
    return (
        versions.where(F.col("stage").isin(*stages))
        .groupBy("model_name")
        .agg(F.max_by(F.struct("version", "stage", "run_uuid"), F.struct(rank, "version")).alias("m"))
        .select("model_name", "m.*")
    )


def register_versions(versions: DataFrame, new: DataFrame) -> DataFrame:
    """New rows ``(model_name, stage, run_uuid)`` with the next version of their model.

    Older versions keep their stage. At most one new version per model.
    """
    last = versions.groupBy("model_name").agg(F.max("version").alias("last"))
    return new.join(last, "model_name", "left").select(
        "model_name",
        (F.coalesce(F.col("last"), F.lit(0)) + 1).cast("long").alias("version"),
        "stage",
        "run_uuid",
    )
