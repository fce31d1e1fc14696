"""Projection, filters and record checks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmurate.functions.scalar import Clock, clock
from murmurate.functions.text import lower
from murmurate.schemas import (
    CLASSES,
    COUNT_FIELDS,
    INDONESIAN,
    MAX_LENGTHS,
    NA_TOKENS,
    POST_FIELDS,
    REQUIRED_FIELDS,
    SCORING_REQUEST,
)


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def project_fields(df: DataFrame, fields: Sequence[str] = POST_FIELDS) -> DataFrame:
    """The listed fields that exist, in list order."""
    return df.select([f for f in fields if f in df.columns])


def sorted_columns(df: DataFrame) -> DataFrame:
    return df.select(sorted(df.columns))


def normalize_na(df: DataFrame, tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """Texts that mean "missing" become NULL."""
    texts = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
    return df.select(
        [
            F.when(~F.col(c).isin(*tokens), F.col(c)).alias(c) if c in texts else F.col(c)
            for c in df.columns
        ]
    )


def derive_post_columns(df: DataFrame) -> DataFrame:
    """Columns a harvested post gets on top of the site's own fields.

    Reads ``screen_name``, ``media`` (array of structs), ``profile_location``
    and ``reply_to``; a post without a user has no address.
    """
    return df.withColumns(
        {
            "username": F.col("screen_name"),
            "tweet_url": F.concat(
                F.lit("https://x.com/"), F.col("screen_name"), F.lit("/status/"), F.col("id_str")
            ),
            "image_url": F.coalesce(
                F.get(F.col("media"), F.lit(0))["media_url_https"], F.lit("")
            ),
            "location": F.coalesce(F.col("profile_location"), F.lit("")),
            "in_reply_to_screen_name": F.coalesce(F.col("reply_to"), F.lit("")),
        }
    ).drop("screen_name", "media", "profile_location", "reply_to")


def keep_languages(df: DataFrame, languages: Sequence[str] = INDONESIAN) -> DataFrame:
    """Posts in the given languages; a frame without ``lang`` passes whole."""
    return df.where(F.col("lang").isin(*languages)) if "lang" in df.columns else df


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def as_label(c: Column, strict: bool = True) -> Column:
    """Label as an integer, fractions cut off; bad text fails unless not strict."""
    if strict:
        return c.cast("double").cast("int")
    return c.try_cast("double").try_cast("int")


def valid_labels(
    df: DataFrame, classes: Sequence[int] = CLASSES, strict: bool = True
) -> DataFrame:
    """Labelled rows whose class is known, label as a 64-bit integer."""
    return (
        drop_missing(df, ["label"])
        .withColumn("label", as_label(F.col("label"), strict))
        .where(F.col("label").isin(*classes))
        .withColumn("label", F.col("label").cast("bigint"))
    )


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def either_filled(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(filled(F.col(a)) | filled(F.col(b)))


def recent(df: DataFrame, column: str, as_of: Clock, window: str) -> DataFrame:
    """Rows with ``column >= as_of - window`` (``'7 days'``), no upper bound.

    A table partitioned by the day of that column (``predicted_at`` →
    ``predicted_date``) is pruned by a second predicate, which Spark does not
    infer from the first.
    """
    since = clock(as_of, df.schema[column].dataType.simpleString()) - F.expr(f"INTERVAL {window}")
    out = df.where(F.col(column) >= since)
    day = column.removesuffix("_at") + "_date"
    if day in df.columns:
        out = out.where(F.col(day) >= since.cast("date"))
    return out


def _day(text: str) -> str:
    """``DD-MM-YYYY`` (anything after a blank is ignored) to ``YYYY-MM-DD``."""
    return datetime.strptime(text.split(" ")[0], "%d-%m-%Y").date().isoformat()


def keyword_search(
    df: DataFrame,
    words: Sequence[str] = (),
    since: str | None = None,
    until: str | None = None,
    target: int | None = None,
    text: str = "full_text",
    at: str = "created_at",
) -> DataFrame:
    """Posts that hold all words, any case, with ``since <= day < until``.

    ``target`` is the number of posts wanted, if not all.
    """
    for word in words:
        df = df.where(lower(F.col(text)).contains(word.lower()))
    df = in_days(df, at, since, until)
    return df if target is None else df.limit(target)


def in_days(df: DataFrame, at: str, since: str | None, until: str | None) -> DataFrame:
    """Rows with ``since <= at < until``, days as ``DD-MM-YYYY``."""
    kind = df.schema[at].dataType.simpleString() if at in df.columns else "timestamp"
    if since:
        df = df.where(F.col(at) >= F.lit(_day(since)).cast(kind))
    if until:
        df = df.where(F.col(at) < F.lit(_day(until)).cast(kind))
    return df


def add_label_column(df: DataFrame) -> DataFrame:
    """An empty label for the annotators to fill in."""
    return df.withColumn("label", F.lit(""))


def with_defaults(df: DataFrame, record=SCORING_REQUEST) -> DataFrame:
    """Every column of the record: absent ones as NULL, absent counters as 0.

    A counter that is there and NULL stays NULL.
    """
    columns = {}
    for field in record.fields:
        absent = F.lit(0 if field.name in COUNT_FIELDS else None)
        c = F.col(field.name) if field.name in df.columns else absent
        columns[field.name] = c.cast(field.dataType)
    return df.withColumns(columns)


def typed_requests(df: DataFrame, column: str = "body") -> DataFrame:
    """Parse JSON request bodies into scoring requests.

    Counters may come as numbers or as text; an absent one is 0, one that is there and
    null stays NULL. ``accepted`` is false where the body is not JSON, a counter is no number
    or a required field is missing; the row stays, with its body.
    """
    names = [f.name for f in SCORING_REQUEST.fields]
    texts = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_corrupt"]])
    parsed = F.from_json(
        F.col(column), texts, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    )
    fields, ok = [], F.col("_r._corrupt").isNull()
    for n in names:
        raw = F.col(f"_r.{n}")
        if n in COUNT_FIELDS:
            number = raw.try_cast("bigint")
            there = F.coalesce(F.array_contains("_keys", n), F.lit(False))
            fields.append(F.when(there, number).otherwise(F.coalesce(number, F.lit(0))).alias(n))
            ok = ok & (raw.isNull() | number.isNotNull())
        else:
            fields.append(raw.alias(n))
    ok = ok & F.col("_r.id_str").isNotNull() & F.col("_r.clean_text").isNotNull()
    kept = [c for c in df.columns if c not in names]
    return df.withColumns({"_r": parsed, "_keys": F.json_object_keys(column)}).select(
        *kept, *fields, F.coalesce(ok, F.lit(False)).alias("accepted")
    )


def check_constraints(df: DataFrame, later: Sequence[str] = ()) -> DataFrame:
    """Add ``reasons``: the rules of the prediction record that a row breaks.

    ``later`` names columns that the rows are given afterwards; they are not looked for.
    """
    rules = [(f"{c} is null", F.col(c).isNull()) for c in REQUIRED_FIELDS if c not in later]
    rules.append(
        ("pred_score outside 0..1", (F.col("pred_score") < 0) | (F.col("pred_score") > 1))
    )
    rules += [
        (f"{c} longer than {n}", F.char_length(F.col(c)) > n)
        for c, n in MAX_LENGTHS.items()
        if c in df.columns
    ]
    return df.withColumn(
        "reasons", F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))
    )


def split_accepted(df: DataFrame, later: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows that may be stored, and rows that may not with their reasons."""
    checked = check_constraints(df, later)
    accepted = checked.where(F.size("reasons") == 0).drop("reasons")
    return accepted, checked.where(F.size("reasons") > 0)
