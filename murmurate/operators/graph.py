"""Reply edges."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurate.operators.rows import either_filled, require_columns


def reply_edges(df: DataFrame) -> DataFrame:
    """``(source, target)`` of every post with a user or an addressee, repeats kept."""
    require_columns(df, ["username", "in_reply_to_screen_name"])
    return either_filled(df, "username", "in_reply_to_screen_name").select(
        F.coalesce("username", F.lit("")).alias("source"),
        F.coalesce("in_reply_to_screen_name", F.lit("")).alias("target"),
    )
