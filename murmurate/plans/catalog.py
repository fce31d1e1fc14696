"""All reports by name, for use from SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from murmurate.functions.scalar import Clock
from murmurate.plans import prediction_reports as P
from murmurate.plans import run_reports as R


def run_report_frames(t: R.Tables, experiment: str, as_of: Clock) -> dict[str, DataFrame]:
    """The ten reports over training runs."""
    return {
        "latest_run": R.latest_run(t, experiment),
        "f1_over_time": R.f1_over_time(t, experiment, as_of),
        "acceptance_rate": R.acceptance_rate(t, experiment, as_of),
        "average_metrics": R.average_metrics(t, experiment, as_of),
        "compare_runs": R.compare_runs(t, experiment),
        "duration_trend": R.duration_trend(t, experiment, as_of),
        "latest_status": R.latest_status(t, experiment),
        "incremental_vs_fresh": R.incremental_vs_fresh(t, experiment, as_of),
        "metrics_detail": R.metrics_detail(t, experiment, as_of),
        "param_distribution": R.param_distribution(t, experiment, as_of),
    }


def prediction_report_frames(p: DataFrame, as_of: Clock) -> dict[str, DataFrame]:
    """The thirteen reports over predictions."""
    return {
        "sentiment_share": P.sentiment_share(p, as_of),
        "positive_percentage": P.label_percentage(p, as_of, "positive"),
        "negative_percentage": P.label_percentage(p, as_of, "negative"),
        "neutral_percentage": P.label_percentage(p, as_of, "neutral"),
        "daily_trend": P.daily_trend(p, as_of),
        "confidence": P.confidence(p, as_of),
        "engagement": P.engagement(p, as_of),
        "top_users": P.top_users(p, as_of),
        "hourly_trend": P.hourly_trend(p, as_of),
        "feed": P.feed(p, as_of),
        "by_language": P.by_language(p, as_of),
        "confidence_bands": P.confidence_bands(p, as_of),
        "daily_summary": P.daily_summary(p, as_of),
    }
