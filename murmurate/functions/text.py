"""Text normalisation as native column expressions.

The steps run in a fixed order: lower case first, so that the markers put in
later (``HTTPURL``, ``@USER``) stay upper case; entities go after emoji.
Java's ``\\w`` and ``\\s`` are ASCII only, so Unicode classes are spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmurate.functions.emoji import demojize

WORD = r"[\p{L}\p{N}_]"
SPACE_SET = r"\t\n\x0B\f\r\x1c-\x1f\x85\p{Z}"
SPACE = f"[{SPACE_SET}]"
# The site's own notion of a blank, that of JavaScript, differs from the above.
HARVEST_SPACE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

_TRIM = f"^{SPACE}+|{SPACE}+$"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def lower(c: Column) -> Column:
    return F.lower(c)


def mask_urls(c: Column) -> Column:
    return F.regexp_replace(c, f"http[^{SPACE_SET}]+|www[^{SPACE_SET}]+", "HTTPURL")


def mask_mentions(c: Column) -> Column:
    return F.regexp_replace(c, f"@{WORD}+", "@USER")


def drop_entities(c: Column) -> Column:
    return F.regexp_replace(c, f"&{WORD}+;", "")


def join_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"[\r\n\t]+", " ")


def squeeze_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def squeeze_harvested(c: Column) -> Column:
    """Two or more spaces become one blank; a single line break stays."""
    return F.regexp_replace(c, f"{HARVEST_SPACE}{{2,}}", " ")


def clean(c: Column, emoji_names: dict[str, str] | None = None) -> Column:
    """The whole normalisation of one post as one expression.

    Line breaks need no step of their own here: spaces take them in.
    """
    masked = mask_mentions(mask_urls(lower(text_or_empty(c))))
    return squeeze_spaces(drop_entities(demojize(masked, emoji_names)))


def with_clean_text(
    df: DataFrame,
    source: str = "full_text",
    target: str = "clean_text",
    emoji_names: dict[str, str] | None = None,
) -> DataFrame:
    """Add the normalised text, as :func:`clean` gives it.

    Each step is a column of its own, so that a cheap search decides whether
    its pattern is run at all and nothing is computed twice.
    """
    t = F.col("_text")

    def only_if(found: Column, changed: Column) -> Column:
        return F.when(found, changed).otherwise(t)

    steps = [
        lower(text_or_empty(F.col(source))),
        only_if(t.contains("http") | t.contains("www"), mask_urls(t)),
        only_if(t.contains("@"), mask_mentions(t)),
        demojize(t, emoji_names),
        only_if(t.contains("&") & t.contains(";"), drop_entities(t)),
    ]
    for step in steps:
        df = df.withColumn("_text", step)
    return df.withColumn(target, squeeze_spaces(t)).drop("_text")
