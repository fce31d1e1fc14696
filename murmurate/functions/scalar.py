"""Scalar expressions used by the reports and the scoring path."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmurate.schemas import LABEL_NAMES

Clock = str | datetime


def clock(as_of: Clock, like: str = "timestamp") -> Column:
    """The fixed "now" as a literal of the type of the column it meets.

    It is cast from text, so that a naive value means the same wall clock for
    zoned and zone-less columns.
    """
    text = as_of if isinstance(as_of, str) else as_of.isoformat(sep=" ")
    return F.lit(text).cast(like)


def round_numeric(c: Column, places: int) -> Column:
    """ROUND over NUMERIC: decimal, half away from zero, given back as double.

    The decimal takes the shortest text of the number with all its places, so it
    is rounded once. From 2**53 on a number has no fraction and stays as it is, as do NaN
    and infinities.
    """
    number = c.cast("double")
    plain = ~F.isnan(number) & (F.abs(number) < 2.0**53)
    return F.when(plain, F.round(number.cast("decimal(38,18)"), places).cast("double")).otherwise(number)


def percentage(part: Column, whole: Column) -> Column:
    """Share in percent with two decimals; NULL where the whole is zero."""
    return round_numeric(
        part.cast("double") * F.lit(100.0) / F.nullif(whole.cast("double"), F.lit(0.0)), 2
    )


def initcap(c: Column) -> Column:
    """First letter of every alphanumeric run in upper case, the rest in lower case."""
    runs = F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))
    return F.array_join(
        F.transform(runs, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(w.substr(2, 2**30)))),
        "",
    )


def preview(c: Column, length: int = 100) -> Column:
    return F.left(c, F.lit(length))


def duration_minutes(start: Column, end: Column) -> Column:
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return round_numeric(micros.cast("double") / F.lit(6e7), 2)


def trunc_time(df: DataFrame, unit: str, column: str) -> Column:
    """Start of the day or hour, in the type of the column."""
    return F.date_trunc(unit, column).cast(df.schema[column].dataType)


def accepted_text(score: Column, threshold: float) -> Column:
    return F.when(score >= threshold, "Accepted").otherwise("Rejected")


def accepted_flag(value: Column) -> Column:
    """Boolean parameters are logged as text; only ``True`` counts."""
    return F.when(value == "True", 1).otherwise(0)


def confidence_band(score: Column) -> Column:
    """Five text bands, lower bound inclusive."""
    return (
        F.when(score >= 0.9, "0.9-1.0 (Very High)")
        .when(score >= 0.8, "0.8-0.9 (High)")
        .when(score >= 0.7, "0.7-0.8 (Medium)")
        .when(score >= 0.6, "0.6-0.7 (Low)")
        .otherwise("0.0-0.6 (Very Low)")
    )


# Day, month, day of month, time, offset and year of a post's own date.
_POST_DATE = (
    r"^(?i)(Mon|Tue|Wed|Thu|Fri|Sat|Sun) [A-Z]{3} \d{1,2} \d{1,2}:\d{1,2}:\d{1,2} [+-]\d{4} \d{4}$"
)


def parse_created_at(c: Column) -> Column:
    """``Wed Oct 10 20:19:24 +0000 2018`` to a timestamp, anything else to NULL.

    Spark does not parse week days, so the day is checked and cut off.
    """
    return F.when(
        c.rlike(_POST_DATE), F.try_to_timestamp(c.substr(5, 100), F.lit("MMM d H:m:s Z yyyy"))
    )


def argmax(values: Column) -> Column:
    """Index of the largest value, the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def softmax_top(values: Column) -> Column:
    """The largest softmax share of an array of logits."""
    top = F.array_max(values).cast("double")
    total = F.aggregate(
        values, F.lit(0.0), lambda acc, x: acc + F.exp(x.cast("double") - top)
    )
    return F.lit(1.0) / total


def label_name(c: Column, names: dict[str, str] = LABEL_NAMES) -> Column:
    """Readable label; a value the map does not know passes through."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), c)


def first_word(c: Column) -> Column:
    return F.get(F.split(c, " "), F.lit(0))


def strip_reply(c: Column, reply_to: Column) -> Column:
    """Cut the first ``@reply_to`` out of a text whose second character is ``@``.

    A plain ``@name`` first word stays, as its ``@`` is the first character. The
    character before the ``@`` is one of the basic plane and not a blank.
    """
    needle = F.concat(F.lit("@"), reply_to, F.lit(" "))
    at = F.position(needle, c)
    cut = F.concat(
        F.substring(c, F.lit(1), at - 1),
        F.substring(c, at + F.char_length(needle), F.char_length(c)),
    )
    return F.when(c.rlike(r"^[\x{00}-\x{1F}\x{21}-\x{FFFF}]@") & (at > 0), cut).otherwise(c)


def file_day(path: Column, prefix: str) -> Column:
    """Date in a file name ``<prefix><y-m-d>.csv``; NULL when there is none."""
    text = F.regexp_extract(path, rf"(?:^|/)\Q{prefix}\E([^/]*)\.csv(?:/|$)", 1)
    return F.when(
        text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"),
        F.try_to_timestamp(text, F.lit("y-M-d")).cast("date"),
    )


def timestamp_name(prefix: str, as_of: Clock) -> Column:
    """``<prefix>_YYYYmmdd_HHMMSS``, the name of a run or of an output file."""
    return F.concat(F.lit(prefix + "_"), F.date_format(clock(as_of), "yyyyMMdd_HHmmss"))
