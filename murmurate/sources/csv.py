"""CSV, the hand-over format between the stages.

Fields may hold quotes and line breaks, so files are read with ``multiLine`` and
one file is one task: the writers here therefore bound the rows of a file, and
the stages use Parquet between themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmurate import files
from murmurate.functions.scalar import clock, file_day
from murmurate.operators.rows import normalize_na

ROWS_PER_FILE = 1_000_000

# A header that differs from the first one, and a row with too many or too few fields, fail the read.
READ_OPTIONS = {
    "header": "true",
    "escape": '"',
    "encoding": "UTF-8",
    "enforceSchema": "false",
    "mode": "FAILFAST",
}
WRITE_OPTIONS = {
    "header": "true",
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = None,
    line_breaks: bool = True,
) -> DataFrame:
    """A CSV file or folder of files with one header, missing values as NULL.

    Columns are texts, or of the schema's types: those are cast after the read,
    so that the file's own header gives the order and ids are never numbers.
    Without ``line_breaks`` in the fields a large file is read by many tasks.
    """
    options = {**READ_OPTIONS, "multiLine": str(line_breaks).lower()}
    df = normalize_na(spark.read.options(**options).csv(path))
    if schema is None:
        return df
    return df.select(
        [
            F.col(f.name).cast(f.dataType).alias(f.name)
            for f in schema.fields
            if f.name in df.columns
        ]
    )


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Header, UTF-8, bounded files; NULL and empty text are both an empty field."""
    df.write.options(**WRITE_OPTIONS, maxRecordsPerFile=ROWS_PER_FILE).mode(mode).csv(path)
    return path


def append_csv(df: DataFrame, path: str) -> str:
    """Append with every value quoted and empty lines left out."""
    rows = df.na.drop(how="all")
    rows.write.options(**WRITE_OPTIONS, quoteAll="true", maxRecordsPerFile=ROWS_PER_FILE).mode(
        "append"
    ).csv(path)
    return path


def drop_repeated_headers(df: DataFrame) -> DataFrame:
    """Leave out rows that only repeat the column names (a second header)."""
    is_header = F.lit(True)
    for c in df.columns:
        is_header = is_header & F.col(c).eqNullSafe(F.lit(c))
    return df.where(~is_header)


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    return drop_repeated_headers(read_csv(spark, path))


def insert_csv(df: DataFrame, path: str, mode: str = "REPLACE") -> str:
    """REPLACE keeps what was there as ``….old.csv`` (``….old`` without that ending); APPEND adds to it."""
    spark = df.sparkSession
    if mode not in ("REPLACE", "APPEND"):
        raise ValueError(f"unknown insert mode {mode}")
    path = path.rstrip("/")
    if mode == "REPLACE" and files.exists(spark, path):
        files.rename(spark, path, old_version(path))
    return append_csv(df, path)


def old_version(path: str) -> str:
    return f"{path.removesuffix('.csv')}.old.csv" if path.endswith(".csv") else f"{path}.old"


def dated_files(
    spark: SparkSession, pattern: str, as_of: str, prefix: str = "labeled_", days: int = 7
) -> DataFrame:
    """``day, path`` of the files that a pattern finds and whose name, or that of their folder,
    is ``<prefix><date>.csv`` with a date among the last ``days`` and ``as_of``.

    The listing is Spark's; no content is read.
    """
    if not files.glob(spark, pattern):
        return spark.createDataFrame([], "day date, path string")
    listed = spark.read.format("binaryFile").load(pattern).select("path")
    last = clock(as_of).cast("date")
    return listed.select(file_day(F.col("path"), prefix).alias("day"), "path").where(
        F.col("day").between(F.date_sub(last, days), last)
    )


def union_dated(spark: SparkSession, dated: DataFrame) -> DataFrame | None:
    """The files in one frame, matched by column name, no row dropped; None if there are none.

    Files with the same header are one read, and only the names of the few files of
    the window come to the driver.
    """
    by_header: dict[tuple[str, ...], list[str]] = {}
    for row in dated.orderBy("day", "path").collect():
        by_header.setdefault(tuple(spark.read.options(**READ_OPTIONS).csv(row["path"]).columns), []).append(row["path"])
    out = None
    for paths in by_header.values():
        df = read_csv(spark, paths)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
