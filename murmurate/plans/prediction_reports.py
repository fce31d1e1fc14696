"""Reports over stored predictions.

Each is one aggregate over the rows of the window; labels are put into title
case after the aggregate, on a row per group. Those that ask for no single post or user
also take hourly sums (:mod:`murmurate.operators.rollup`) in place of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurate.functions.scalar import (
    Clock,
    initcap,
    percentage,
    preview,
    round_numeric,
    trunc_time,
)
from murmurate.operators.aggregates import share_of_total
from murmurate.operators.rollup import measures
from murmurate.operators.rows import recent

def _count(p: DataFrame):
    return measures(p).count.alias("count")


def _sentiment():
    return initcap(F.col("pred_label")).alias("sentiment")


def _labelled(label: str):
    return F.count_if(F.col("pred_label") == label)


def _window(p: DataFrame, as_of: Clock, window: str) -> DataFrame:
    return recent(p, "predicted_at", as_of, window)


def sentiment_share(p: DataFrame, as_of: Clock) -> DataFrame:
    counted = _window(p, as_of, "7 days").groupBy("pred_label").agg(_count(p))
    return share_of_total(counted).orderBy(F.desc("count")).select(_sentiment(), "count", "percentage")


def label_percentage(p: DataFrame, as_of: Clock, label: str) -> DataFrame:
    m = measures(p)
    share = percentage(m.count_if(F.col("pred_label") == label), m.count)
    return _window(p, as_of, "7 days").agg(share.alias("percentage"))


def _trend(p: DataFrame, as_of: Clock, unit: str, window: str) -> DataFrame:
    counted = (
        _window(p, as_of, window)
        .groupBy(trunc_time(p, unit, "predicted_at").alias("time"), "pred_label")
        .agg(_count(p))
    )
    return counted.orderBy("time", "pred_label").select("time", _sentiment(), "count")


def daily_trend(p: DataFrame, as_of: Clock) -> DataFrame:
    return _trend(p, as_of, "day", "30 days")


def hourly_trend(p: DataFrame, as_of: Clock) -> DataFrame:
    return _trend(p, as_of, "hour", "7 days")


def confidence(p: DataFrame, as_of: Clock) -> DataFrame:
    m = measures(p)
    return (
        _window(p, as_of, "7 days")
        .groupBy("pred_label")
        .agg(
            round_numeric(m.mean("score"), 4).alias("avg_confidence"),
            round_numeric(m.least, 4).alias("min_confidence"),
            round_numeric(m.most, 4).alias("max_confidence"),
            m.count.alias("total_predictions"),
        )
        .orderBy(F.desc_nulls_first("avg_confidence"))
        .select(
            _sentiment(), "avg_confidence", "min_confidence", "max_confidence", "total_predictions"
        )
    )


def engagement(p: DataFrame, as_of: Clock) -> DataFrame:
    m = measures(p)
    return (
        _window(p, as_of, "7 days")
        .groupBy("pred_label")
        .agg(
            m.count.alias("tweet_count"),
            F.sum("favorite_count").alias("total_favorites"),
            F.sum("retweet_count").alias("total_retweets"),
            F.sum("reply_count").alias("total_replies"),
            F.sum("quote_count").alias("total_quotes"),
            round_numeric(m.mean("favorite_count"), 2).alias("avg_favorites"),
            round_numeric(m.mean("retweet_count"), 2).alias("avg_retweets"),
        )
        .orderBy(F.desc("tweet_count"))
        .select(
            _sentiment(),
            "tweet_count",
            "total_favorites",
            "total_retweets",
            "total_replies",
            "total_quotes",
            "avg_favorites",
            "avg_retweets",
        )
    )


def top_users(p: DataFrame, as_of: Clock, n: int = 10) -> DataFrame:
    """Busiest users with their label counts; equal counts go by name."""
    return (
        _window(p, as_of, "7 days")
        .where(F.col("username").isNotNull())
        .groupBy("username")
        .agg(
            F.count(F.lit(1)).alias("total_tweets"),
            _labelled("positive").alias("positive_count"),
            _labelled("negative").alias("negative_count"),
            _labelled("neutral").alias("neutral_count"),
            round_numeric(F.avg("pred_score"), 4).alias("avg_confidence"),
        )
        .orderBy(F.desc("total_tweets"), "username")
        .limit(n)
    )


def feed(p: DataFrame, as_of: Clock, n: int = 50) -> DataFrame:
    """Newest predictions of the last day; equal times go by id."""
    newest = (
        _window(p, as_of, "24 hours")
        .orderBy(F.desc_nulls_first("predicted_at"), "id_str")
        .limit(n)
    )
    return newest.select(
        F.col("predicted_at").alias("time"),
        "username",
        _sentiment(),
        round_numeric(F.col("pred_score"), 4).alias("confidence"),
        preview(F.col("clean_text")).alias("tweet_preview"),
        "favorite_count",
        "retweet_count",
        "model_run_id",
    )


def by_language(p: DataFrame, as_of: Clock) -> DataFrame:
    counted = (
        _window(p, as_of, "7 days")
        .where(F.col("lang").isNotNull())
        .groupBy("lang", "pred_label")
        .agg(_count(p))
    )
    return (
        share_of_total(counted, "count", ["lang"])
        .orderBy("lang", F.desc("count"))
        .select(F.col("lang").alias("language"), _sentiment(), "count", "percentage")
    )


def confidence_bands(p: DataFrame, as_of: Clock) -> DataFrame:
    counted = (
        _window(p, as_of, "7 days")
        .groupBy(measures(p).band.alias("confidence_range"))
        .agg(_count(p))
    )
    return share_of_total(counted).orderBy(F.desc("confidence_range"))


def daily_summary(p: DataFrame, as_of: Clock) -> DataFrame:
    """Totals per day. A post with a missing counter adds nothing to the engagement."""
    four = F.col("favorite_count") + F.col("retweet_count") + F.col("reply_count") + F.col("quote_count")
    return (
        _window(p, as_of, "30 days")
        .groupBy(trunc_time(p, "day", "predicted_at").alias("date"))
        .agg(
            F.count(F.lit(1)).alias("total_predictions"),
            F.count_distinct("username").alias("unique_users"),
            round_numeric(F.avg("pred_score"), 4).alias("avg_confidence"),
            _labelled("positive").alias("positive"),
            _labelled("negative").alias("negative"),
            _labelled("neutral").alias("neutral"),
            F.sum(four).alias("total_engagement"),
        )
        .orderBy(F.desc("date"))
    )
