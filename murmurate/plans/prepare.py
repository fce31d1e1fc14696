"""From raw posts to the weekly labelled dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from murmurate import files
from murmurate.functions.emoji import country_names
from murmurate.functions.text import with_clean_text
from murmurate.operators.graph import reply_edges
from murmurate.operators.rows import (
    add_label_column,
    keep_languages,
    require_columns,
    valid_labels,
)
from murmurate.schemas import INDONESIAN
from murmurate.sources.csv import (
    WRITE_OPTIONS,
    dated_files,
    insert_csv,
    read_csv,
    union_dated,
    write_csv,
)
from murmurate.sources.timeline import flatten, read_timeline


def clean_posts(
    df: DataFrame,
    languages: Sequence[str] = INDONESIAN,
    emoji_names: dict[str, str] | None = None,
) -> DataFrame:
    """Posts in the given languages with ``clean_text`` added."""
    require_columns(df, ["full_text"])
    return with_clean_text(keep_languages(df, languages), emoji_names=emoji_names)


def clean_job(
    spark: SparkSession,
    source: str,
    target: str,
    languages: Sequence[str] = INDONESIAN,
    line_breaks: bool = True,
) -> dict[str, int]:
    """CSV to cleaned CSV ``<target>/cleaned.csv``; row counts come with the one pass."""
    read, kept = Observation(), Observation()
    raw = read_csv(spark, source, line_breaks=line_breaks).observe(read, F.count(F.lit(1)).alias("rows"))
    out = clean_posts(raw, languages, country_names(spark)).observe(kept, F.count(F.lit(1)).alias("rows"))
    write_csv(out, f"{target}/cleaned.csv")
    return {"rows_in": read.get["rows"], "rows_out": kept.get["rows"]}


def unlabeled_job(spark: SparkSession, source: str, target: str, day: str) -> str:
    """Cleaned CSV to ``<target>/cleaned_unlabeled_<day>.csv`` with an empty label."""
    return write_csv(
        add_label_column(read_csv(spark, source)), f"{target}/cleaned_unlabeled_{day}.csv"
    )


def merge_week(
    spark: SparkSession, pattern: str, as_of: str, prefix: str = "labeled_"
) -> DataFrame | None:
    """Valid labelled rows of the files of the last week; None when there is no file."""
    merged = union_dated(spark, dated_files(spark, pattern, as_of, prefix))
    if merged is None:
        return None
    return valid_labels(require_columns(merged, ["clean_text", "label"]))


def merge_job(
    spark: SparkSession, pattern: str, target: str, as_of: str, prefix: str = "labeled_"
) -> dict[str, int | str] | None:
    """Weekly dataset as ``<target>/weekly.csv``, and its rows before and after the check of labels.

    None when there is no file; fails when no valid row is left.
    """
    read, kept = Observation(), Observation()
    merged = union_dated(spark, dated_files(spark, pattern, as_of, prefix))
    if merged is None:
        return None
    merged = require_columns(merged, ["clean_text", "label"]).observe(read, F.count(F.lit(1)).alias("rows"))
    valid = valid_labels(merged).observe(kept, F.count(F.lit(1)).alias("rows"))
    staged = write_csv(valid, f"{target}/weekly.csv.staged")
    if not kept.get["rows"]:
        files.delete(spark, staged)
        raise ValueError("no valid labelled row is left")
    files.rename(spark, staged, f"{target}/weekly.csv")
    return {"output": f"{target}/weekly.csv", "rows_in": read.get["rows"], "rows_out": kept.get["rows"]}


def harvest_job(
    spark: SparkSession, source: str, target: str, mode: str = "search", insert: str = "APPEND", wanted: int | None = None
) -> str:
    """Landed timeline responses to flat posts in ``target``; ``wanted`` is how many posts are taken, if not all."""
    posts = flatten(read_timeline(spark, source), mode)
    return insert_csv(posts if wanted is None else posts.limit(wanted), target, insert)


def reply_edges_job(spark: SparkSession, source: str, target: str) -> str:
    """Who answers whom, as quoted CSV ``source,target``."""
    edges = reply_edges(read_csv(spark, source))
    edges.write.options(**WRITE_OPTIONS, quoteAll="true").mode("overwrite").csv(target)
    return target
