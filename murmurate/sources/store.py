"""The prediction table, and predictions as Parquet folders by day."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmurate import files
from murmurate.functions.scalar import Clock
from murmurate.operators import rollup
from murmurate.operators.upsert import one_per_post, upsert
from murmurate.schemas import PREDICTION
from murmurate.session import scratch

PARTITION = "predicted_date"


def with_day(df: DataFrame) -> DataFrame:
    return df.withColumn(PARTITION, F.col("predicted_at").cast("date"))


def write_by_day(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Write by day, rows of a file ordered by label and user.

    The rebalance hint brings a day's rows together and splits a day that is
    too large for one task; the order lets readers skip row groups.
    """
    df = df if PARTITION in df.columns else with_day(df)
    return _write_days(df.hint("rebalance", PARTITION), path, mode, "pred_label", "username")


def _write_days(df: DataFrame, path: str, mode: str, *order: str) -> str:
    (
        df.sortWithinPartitions(PARTITION, *order)
        .write.partitionBy(PARTITION)
        .option("partitionOverwriteMode", "dynamic")
        .mode(mode)
        .parquet(path)
    )
    return path


class PredictionStore:
    """Predictions of posts, one row per post, as a table partitioned by day; one writer at a time.

    A batch changes the days that its posts enter and the days that they leave. The ids of the
    table, read without any other column and only where files may hold ids of the batch, say
    which these are. Only those days are read, merged with the batch by one aggregate and
    published by dynamic partition overwrite; all other days stay as they are.

    The merged days stand complete below ``pending`` before the first one is published. A writer
    that dies while it publishes leaves them there, and the next one publishes them again first,
    which gives the same table. Readers see the table's plain Parquet folders.

    With ``hourly`` the sums of the changed days are published with them, so that late and
    re-scored posts count where they belong.
    """

    def __init__(self, spark: SparkSession, path: str, hourly: bool = False):
        self.spark = spark
        self.hourly = hourly
        self.path = path.rstrip("/")
        self.table = f"{self.path}/by-day"
        self.sums = f"{self.path}/hourly"
        self.pending = f"{self.path}/pending"

    def _rows(self, path: str) -> DataFrame:
        return self.spark.read.schema(T.StructType([*PREDICTION.fields, T.StructField(PARTITION, T.DateType())])).parquet(path)

    def read(self) -> DataFrame:
        """The table, with the day of each prediction; a condition on the day leaves other days unread."""
        if not files.exists(self.spark, self.table):
            return with_day(self.spark.createDataFrame([], PREDICTION))
        return self._rows(self.table)

    def summaries(self, as_of: Clock, window: str) -> DataFrame:
        """Hourly sums of the last ``window``, which the reports take in place of the rows; an hour that the window cuts is summed from its rows."""
        if not files.exists(self.spark, self.sums):
            return rollup.hourly(self.read().where(F.lit(False)))
        return rollup.since_hour(self.read(), self.spark.read.parquet(self.sums), as_of, window)

    def _left(self, batch: DataFrame, least: str, most: str) -> set:
        """The days in which posts of the batch stand."""
        if not files.exists(self.spark, self.table):
            return set()
        standing = self.read().where(F.col("id_str").between(least, most)).select("id_str", PARTITION)
        met = standing.join(batch.select("id_str"), "id_str", "left_semi")
        return {r[0] for r in met.select(PARTITION).distinct().collect()}

    def upsert(
        self,
        incoming: DataFrame,
        order: Column | None = None,
        complete: Callable[[DataFrame], DataFrame] | None = None,
    ) -> None:
        """Store a batch; the same batch stored twice gives the same table.

        Columns that stand in another table, such as long texts, need not come with the batch:
        ``complete`` adds them, by a join, to the one row per post that stays, so they are neither sorted nor
        shuffled with the rows that do not stay. It has to keep every row it is given; other columns of the batch
        are there for it, with the values of the post's first row.
        """
        self.recover()
        order = F.col("predicted_at") if order is None else order
        kinds = {f.name: f.dataType for f in PREDICTION.fields}
        typed = incoming.withColumn("_order", F.struct(order)).select(
            *[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in (incoming.columns if complete else kinds)], "_order"
        )
        stay = one_per_post(typed, F.col("_order")).drop("_order")
        if complete:
            stay = complete(stay).select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()])
        with scratch(self.spark) as keep:
            batch = keep(with_day(stay), "batch")
            about = batch.agg(F.min("id_str").alias("least"), F.max("id_str").alias("most"), F.count("*").alias("n")).first()
            if not about.n:
                return
            # a row per day
            days = {r[0] for r in batch.select(PARTITION).distinct().collect()} | self._left(batch, about.least, about.most)
            touched = F.col(PARTITION).isin([d for d in days if d is not None])
            if None in days:
                touched = F.coalesce(touched, F.lit(True))
            merged = upsert(self.read().where(touched).drop(PARTITION), batch.drop(PARTITION), F.col("predicted_at"))
            files.delete(self.spark, self.pending)
            write_by_day(merged, f"{self.pending}/rows")
            self.spark.createDataFrame([(d,) for d in days], "day date").coalesce(1).write.parquet(f"{self.pending}/days")
        self._publish()

    def recover(self) -> None:
        """Publish what a writer that died had ready."""
        if files.exists(self.spark, f"{self.pending}/days/_SUCCESS"):
            self._publish()

    def _publish(self) -> None:
        """Replace the days of the pending rows, and delete those that all posts have left.

        The pending rows stand by day already, so they are copied without another shuffle.
        """
        rows = self._rows(f"{self.pending}/rows")
        left = {r.day for r in self.spark.read.schema("day date").parquet(f"{self.pending}/days").collect()}
        emptied = left - {r[0] for r in rows.select(PARTITION).distinct().collect()}
        _write_days(rows, self.table, "overwrite", "pred_label", "username")
        if self.hourly:
            _write_days(with_day(rollup.hourly(rows)).hint("rebalance", PARTITION), self.sums, "overwrite", "pred_label")
        for day in emptied:
            for path in (self.table, self.sums):
                files.delete(self.spark, f"{path}/{PARTITION}={day or '__HIVE_DEFAULT_PARTITION__'}")
        files.delete(self.spark, self.pending)
