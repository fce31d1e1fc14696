"""Joins of runs with their key/value rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows_of(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Key/value rows of the given runs; rows of others are dropped in the scan."""
    return rows.join(runs.select("run_uuid"), "run_uuid", "left_semi")


def left_join_many(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join where one key may hold a large part of ``right``.

    Adaptive execution splits a hot key on either side of an inner join, but not
    on the right of a left join; so the matches are an inner join, and the rows
    without match are found against the distinct keys.
    """
    matched = left.join(right, key)
    unmatched = left.join(right.select(key).distinct(), key, "left_anti")
    absent = {
        f.name: F.lit(None).cast(f.dataType) for f in right.schema.fields if f.name != key
    }
    return matched.unionByName(unmatched.withColumns(absent))
