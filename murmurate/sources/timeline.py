"""Landed timeline responses (nested JSON) to flat posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurate.functions.scalar import strip_reply
from murmurate.functions.text import squeeze_harvested
from murmurate.operators.rows import derive_post_columns, project_fields, sorted_columns
from murmurate.schemas import TIMELINE

_SEARCH = "data.search_by_raw_query.search_timeline.timeline.instructions"
_THREAD = "data.threaded_conversation_with_injections_v2.instructions"


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    """Responses, one JSON document per line."""
    return spark.read.schema(TIMELINE).json(path)


def entries(responses: DataFrame) -> DataFrame:
    """One row per entry of either envelope; the thread envelope wins."""
    listed = F.coalesce(
        F.get(F.col(_THREAD), F.lit(0))["entries"], F.get(F.col(_SEARCH), F.lit(0))["entries"]
    )
    return responses.select(F.explode(listed).alias("entry")).select("entry.*")


def valid_results(listed: DataFrame, mode: str = "search") -> DataFrame:
    """Results of entries that are no promotion and have a post and a user.

    In ``detail`` mode the result sits in the first item of the entry, and only
    answers (posts that mention someone) are kept.
    """
    if mode == "detail":
        box = F.get(F.col("content.items"), F.lit(0))["item"]["itemContent"]
    elif mode == "search":
        box = F.col("content.itemContent")
    else:
        raise ValueError(f"unknown mode {mode}")
    result = box["tweet_results"]["result"]
    out = listed.where(~F.col("entryId").contains("promoted")).select(result.alias("result"))
    out = out.where(
        F.col("result").isNotNull()
        & (
            F.col("result.core.user_results").isNotNull()
            | F.col("result.tweet.core.user_results").isNotNull()
        )
    )
    if mode == "detail":
        mention = F.get(F.col("result.legacy.entities.user_mentions"), F.lit(0))
        out = out.where(mention.isNotNull())
    return out


def flatten(responses: DataFrame, mode: str = "search") -> DataFrame:
    """Flat posts with the kept fields, columns in alphabetical order."""
    post = F.coalesce(F.col("result.legacy"), F.col("result.tweet.legacy"))
    user = F.coalesce(
        F.col("result.core.user_results.result.legacy"),
        F.col("result.tweet.core.user_results.result.legacy"),
    )
    profile = F.col("result.core.user_results.result.core")
    flat = valid_results(entries(responses), mode).select(
        post.alias("post"), user.alias("user"), profile.alias("profile")
    )
    text = squeeze_harvested(F.col("post.full_text"))
    if mode == "detail":
        mention = F.get(F.col("post.entities.user_mentions"), F.lit(0))["screen_name"]
        text = strip_reply(text, mention)
    flat = flat.select(
        "post.*",
        F.col("profile.screen_name").alias("screen_name"),
        F.col("user.location").alias("profile_location"),
        F.col("post.entities.media").alias("media"),
        F.col("post.in_reply_to_screen_name").alias("reply_to"),
        text.alias("_text"),
    ).withColumn("full_text", F.col("_text"))
    return sorted_columns(project_fields(derive_post_columns(flat)))
