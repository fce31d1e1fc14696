import datetime as dt
import re

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

import __spark_entry__ as entry
from murmurate import files
from murmurate.operators.upsert import one_per_post, upsert
from murmurate.plans import prediction_reports
from murmurate.schemas import PREDICTION
from murmurate.session import work_path
from murmurate.sources.store import PARTITION, PredictionStore
from murmurate.streaming import predictions as ST


def records(spark, rows):
    """(id, favourites, label, day of January)"""
    df = spark.createDataFrame(rows, "id_str string, favorite_count long, pred_label string, day int")
    df = df.withColumns(
        {
            "predicted_at": F.make_timestamp(F.lit(2024), F.lit(1), "day", F.lit(1), F.lit(0), F.lit(0)),
            "full_text": F.lit("f"),
            "clean_text": F.lit("c"),
            "hf_label": F.lit("LABEL_1"),
            "pred_score": F.lit(0.5),
        }
    ).drop("day")
    for f in PREDICTION.fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df.select([f.name for f in PREDICTION.fields])


def content(df):
    return sorted((r.id_str, r.favorite_count, r.pred_label, r.predicted_at.day) for r in df.collect())


FIRST = [("a", 1, "positive", 1), ("b", 2, "neutral", 1), ("c", 3, "neutral", 2)]
SECOND = [("c", 9, "negative", 5), ("d", 4, "positive", 5), ("d", 7, "negative", 6), ("d", 8, "neutral", 7)]
WANT = [("a", 1, "positive", 1), ("b", 2, "neutral", 1), ("c", 3, "negative", 5), ("d", 4, "neutral", 7)]


def test_first_metadata_and_last_prediction(spark):
    at = F.col("predicted_at")
    got = upsert(records(spark, FIRST), records(spark, SECOND), at)
    assert content(got) == WANT


def test_null_metadata_of_the_first_row_stays(spark):
    df = records(spark, [("a", None, "neutral", 1), ("a", 5, "positive", 2)])
    assert content(one_per_post(df, F.col("predicted_at"))) == [("a", None, "positive", 2)]


def test_store_equals_upsert_and_is_idempotent(spark):
    store = PredictionStore(spark, work_path(spark, "t"))
    assert store.read().count() == 0
    for rows in (FIRST, SECOND, SECOND):
        store.upsert(records(spark, rows))
    assert content(store.read()) == WANT
    assert {r[0] for r in store.read().select(PARTITION).collect()} == {
        dt.date(2024, 1, d) for d in (1, 5, 7)
    }


@pytest.mark.parametrize("cut", range(1, 7))
def test_batches_may_be_cut_anywhere(spark, cut):
    store = PredictionStore(spark, work_path(spark, "t"))
    rows = FIRST + SECOND
    store.upsert(records(spark, rows[:cut]))
    store.upsert(records(spark, rows[cut:]))
    assert content(store.read()) == WANT


def test_only_the_days_a_batch_enters_or_leaves_are_written(spark):
    store = PredictionStore(spark, work_path(spark, "t"))
    store.upsert(records(spark, FIRST))
    before = set(files.glob(spark, f"{store.table}/*/*.parquet"))
    store.upsert(records(spark, SECOND))
    after = set(files.glob(spark, f"{store.table}/*/*.parquet"))
    days = lambda paths: {p.split("predicted_date=")[1][:10] for p in paths}
    assert days(before & after) == {"2024-01-01"} and days(before - after) == {"2024-01-02"}
    assert days(after - before) == {"2024-01-05", "2024-01-07"}
    assert not files.exists(spark, store.pending)


@pytest.mark.parametrize("published", [0, 1, 2])
def test_a_writer_that_died_is_finished_by_the_next(spark, published, monkeypatch):
    """It died before the first day was published, between two days, or before a day that was left was deleted."""
    store = PredictionStore(spark, work_path(spark, "t"))
    store.upsert(records(spark, FIRST))
    with monkeypatch.context() as m:
        m.setattr(PredictionStore, "_publish", lambda self: None)
        store.upsert(records(spark, SECOND))
    for path in files.glob(spark, f"{store.pending}/rows/predicted_date=*")[:published]:
        day = path.rsplit("/", 1)[1]
        files.delete(spark, f"{store.table}/{day}")
        if published == 2:
            spark.read.parquet(path).write.parquet(f"{store.table}/{day}")
    store.recover()
    assert content(store.read()) == WANT and not files.exists(spark, store.pending)
    store.recover()
    assert content(store.read()) == WANT


def test_rows_that_were_not_complete_are_dropped(spark):
    store = PredictionStore(spark, work_path(spark, "t"))
    store.upsert(records(spark, FIRST))
    records(spark, SECOND[:1]).write.parquet(f"{store.pending}/rows/predicted_date=2024-01-05")
    store.upsert(records(spark, SECOND))
    assert content(store.read()) == WANT


def test_posts_without_time_have_a_day_of_their_own(spark):
    store = PredictionStore(spark, work_path(spark, "t"))
    timeless = records(spark, [("x", 1, "neutral", 1), ("y", 1, "neutral", 1)]).withColumn("predicted_at", F.lit(None).cast("timestamp"))
    store.upsert(timeless)
    store.upsert(records(spark, [("x", 5, "positive", 3)]))
    assert sorted((r.id_str, r.favorite_count, r.pred_label, r.predicted_at is None) for r in store.read().collect()) == [("x", 1, "positive", False), ("y", 1, "neutral", True)]
    store.upsert(records(spark, [("y", 5, "positive", 3)]))
    assert store.read().where(F.col(PARTITION).isNull()).count() == 0 and store.read().count() == 2


def test_a_day_may_lose_all_posts_and_get_others(spark):
    store = PredictionStore(spark, work_path(spark, "t"))
    store.upsert(records(spark, [("a", 1, "neutral", 1), ("b", 2, "neutral", 2)]))
    store.upsert(records(spark, [("a", 9, "positive", 2), ("b", 9, "positive", 1)]))
    assert content(store.read()) == [("a", 1, "positive", 2), ("b", 2, "positive", 1)]


def test_merging_is_one_shuffle(spark):
    merged = upsert(records(spark, FIRST), records(spark, SECOND), F.col("predicted_at"))
    text = merged._jdf.queryExecution().simpleString()
    assert text.count("Exchange") == 1 and "Join" not in text


@pytest.mark.parametrize(
    "report",
    ["sentiment_share", "daily_trend", "confidence", "hourly_trend", "by_language", "confidence_bands", "daily_summary"],
)
def test_reports_on_the_published_table_read_their_days_only(spark, report):
    store = PredictionStore(spark, work_path(spark, "t"))
    store.upsert(records(spark, FIRST + SECOND))
    text = getattr(prediction_reports, report)(store.read(), "2024-01-09 00:00:00")._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^]]*predicted_date[^]]*>=", text)


def test_an_empty_batch_changes_nothing(spark):
    store = PredictionStore(spark, work_path(spark, "t"))
    store.upsert(records(spark, []))
    store.upsert(records(spark, FIRST))
    store.upsert(records(spark, []))
    assert content(store.read()) == sorted(FIRST)


def test_stream_equals_batch_over_many_batches(spark):
    landing = work_path(spark, "landing")
    rows = FIRST + SECOND
    for i in range(len(rows)):
        records(spark, rows[i : i + 1]).coalesce(1).write.mode("append").parquet(landing)
    store = PredictionStore(spark, work_path(spark, "t"))
    stream = ST.file_stream(spark, landing, PREDICTION, files_per_batch=1)
    ST.store_stream(stream, lambda df: df, store, work_path(spark, "c")).awaitTermination()
    assert content(store.read()) == WANT


def test_stream_drops_repeats_of_a_hot_post(spark):
    landing, out = work_path(spark, "landing"), work_path(spark, "out")
    hot = [("hot", i, "neutral", 1 + i % 5) for i in range(200)] + FIRST
    records(spark, hot).repartition(4).write.parquet(landing)
    stream = ST.file_stream(spark, landing, PREDICTION)
    once = ST.first_of_each(stream, "predicted_at", "10 days").select("id_str")
    ST.append_parquet(once, out, work_path(spark, "c")).awaitTermination()
    assert sorted(r.id_str for r in spark.read.parquet(out).collect()) == ["a", "b", "c", "hot"]


def test_a_repeated_batch_overwrites_its_updates(spark):
    landing, out, check = (work_path(spark, x) for x in ("landing", "out", "c"))
    records(spark, FIRST).write.parquet(landing)
    for _ in range(2):
        counts = ST.window_counts(ST.file_stream(spark, landing, PREDICTION), "1 day")
        ST.write_updates(counts, out, check + str(_)).awaitTermination()
    got = sorted((r.time.day, r.pred_label, r["count"]) for r in ST.read_updates(spark, out, ["time", "pred_label"]).collect())
    assert got == [(1, "neutral", 1), (1, "positive", 1), (2, "neutral", 1)]


@pytest.mark.parametrize(
    "report",
    ["sentiment_share", "daily_trend", "confidence", "hourly_trend", "by_language", "confidence_bands", "engagement"],
)
def test_reports_on_sums_equal_those_on_rows(spark, report):
    store = PredictionStore(spark, work_path(spark, "t"), hourly=True)
    df = spark.range(400).select(
        F.concat(F.lit("p"), F.col("id") % 300).alias("id_str"),
        F.expr("timestamp_seconds(1704067200 + id * 7919)").alias("predicted_at"),
        F.element_at(F.array(*map(F.lit, ["positive", "negative", "neutral"])), (F.col("id") % 3 + 1).cast("int")).alias("pred_label"),
        F.when(F.col("id") % 5 > 0, F.element_at(F.array(F.lit("in"), F.lit("en")), (F.col("id") % 2 + 1).cast("int"))).alias("lang"),
        F.when(F.col("id") % 11 > 0, (F.col("id") * 37 % 1000) / 1000).alias("pred_score"),
        *(F.when(F.col("id") % 7 > 0, F.col("id") % 13).alias(c) for c in ("favorite_count", "retweet_count", "reply_count", "quote_count")),
    )
    df = df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in PREDICTION.fields if f.name not in df.columns})
    for k in range(4):  # later batches move posts to later days and are late themselves
        store.upsert(df.where(F.col("predicted_at").cast("long") % 4 == k))
    assert store.read().count() == 300
    make = getattr(prediction_reports, report)
    for as_of in ("2024-02-04 00:00:00", "2024-01-31 13:25:07"):
        window = "30 days" if report == "daily_trend" else "7 days"
        assert list(map(tuple, make(store.summaries(as_of, window), as_of).collect())) == list(map(tuple, make(store.read(), as_of).collect())) != []


def _plans(spark, run):
    """Texts of the plans of the writes that ``run`` starts."""
    seen, write = [], DataFrameWriter.parquet

    def noted(self, path, *args, **kwargs):
        if isinstance(path, str) and "/batch-" in path:
            seen.append(self._df._jdf.queryExecution().optimizedPlan().toString())
        return write(self, path, *args, **kwargs)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(DataFrameWriter, "parquet", noted)
        run()
    return seen


def _texts(spark, rows):
    """A text of its own for every post, in another table."""
    table = spark.createDataFrame([(x, f"text of {x}") for x in sorted({r[0] for r in rows})], "post string, body string")
    added = table.select(F.col("post").alias("ref"), F.col("body").alias("full_text"), F.col("body").alias("clean_text"))
    return lambda posts: posts.join(added, "ref").drop("ref")


def _without_texts(spark, rows):
    return records(spark, rows).drop("full_text", "clean_text").withColumn("ref", F.col("id_str"))


def test_texts_join_the_rows_that_stay_only(spark):
    store = PredictionStore(spark, work_path(spark, "t"))
    for rows in (FIRST, SECOND, SECOND):
        plans = _plans(spark, lambda rows=rows: store.upsert(_without_texts(spark, rows), complete=_texts(spark, rows)))
        assert [p.index("Join Inner") < p.index("Aggregate") for p in plans] == [True]
    assert content(store.read()) == WANT
    assert all(r.full_text == r.clean_text == f"text of {r.id_str}" for r in store.read().collect())


def test_a_stream_may_join_texts_to_the_rows_that_stay(spark):
    landing, rows = work_path(spark, "landing"), FIRST + SECOND
    records(spark, rows).repartition(3).write.parquet(landing)
    stream = lambda: ST.file_stream(spark, landing, PREDICTION, files_per_batch=1)
    to_records = lambda df: df.drop("full_text", "clean_text").withColumn("ref", F.col("id_str"))
    store = PredictionStore(spark, work_path(spark, "t"))
    ST.store_stream(stream(), to_records, store, work_path(spark, "c"), complete=_texts(spark, rows)).awaitTermination()
    whole = PredictionStore(spark, work_path(spark, "t"))
    ST.store_stream(stream(), lambda df: df, whole, work_path(spark, "c")).awaitTermination()
    assert content(store.read()) == content(whole.read())
    assert all(r.full_text == f"text of {r.id_str}" for r in store.read().collect())
    without = lambda df: _texts(spark, rows)(df).withColumn("full_text", F.lit(None).cast("string"))
    with pytest.raises(StreamingQueryException, match="full_text is null"):
        ST.store_stream(stream(), to_records, PredictionStore(spark, work_path(spark, "t")), work_path(spark, "c"), complete=without).awaitTermination()


def test_publishing_shuffles_no_rows(spark, monkeypatch):
    store, seen, write = PredictionStore(spark, work_path(spark, "t")), [], DataFrameWriter.parquet

    def noted(self, path, *args, **kwargs):
        seen.extend([self._df._jdf.queryExecution().executedPlan().toString()] if path == store.table else [])
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    store.upsert(records(spark, FIRST + SECOND))
    assert len(seen) == 1 and "Exchange" not in seen[0] and "Sort [" in seen[0]
    assert content(store.read()) == WANT


def test_a_batch_without_texts_gets_them_after_it_is_reduced(spark):
    at, rows = F.col("predicted_at"), SECOND
    merged = upsert(records(spark, FIRST), _without_texts(spark, rows), at, complete=_texts(spark, rows))
    assert content(merged) == WANT
    assert {r.id_str: r.full_text for r in merged.collect()} == {"a": "f", "b": "f", "c": "f", "d": "text of d"}


@pytest.mark.parametrize("name", ["upsert_predictions"])
def test_queries_join_texts_to_the_rows_that_stay_only(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Join Inner") < plan.rindex("Aggregate")
