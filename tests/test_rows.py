import datetime as dt

import pytest
from pyspark.sql import functions as F

from contract.views import AS_OF, EXPERIMENT, RUNS_AS_OF, Tables
from murmurate.functions import scalar as S
from murmurate.operators import rows as O
from murmurate.operators.aggregates import batch_stats, choose_best, share_of_total, value_counts
from murmurate.operators.graph import reply_edges
from murmurate.operators.quality import check_dataset
from murmurate.plans.catalog import prediction_report_frames, run_report_frames
from murmurate.sources.tables import register


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Wed Oct 10 20:19:24 +0000 2018", dt.datetime(2018, 10, 10, 20, 19, 24)),
        ("Wed Oct 10 20:19:24 +0700 2018", dt.datetime(2018, 10, 10, 13, 19, 24)),
        ("2018-10-10", None),
        ("Xyz Oct 10 20:19:24 +0000 2018", None),
        ("Wed Oct 32 20:19:24 +0000 2018", None),
        (None, None),
    ],
)
def test_post_dates(spark, text, want):
    assert one(spark, text, S.parse_created_at) == want


@pytest.mark.parametrize(
    "text, want",
    [("very-positive", "Very-Positive"), ("LABEL_3", "Label_3"), ("a b", "A B"), ("", ""), (None, None)],
)
def test_initcap(spark, text, want):
    assert one(spark, text, S.initcap) == want


@pytest.mark.parametrize("x, want", [(0.44775, 0.4478), (-0.44775, -0.4478), (1.00005, 1.0001), (None, None)])
def test_round_is_half_away_from_zero(spark, x, want):
    assert one(spark, x, lambda c: S.round_numeric(c, 4), "double") == want


@pytest.mark.parametrize(
    "score, band",
    [(0.9, "0.9-1.0 (Very High)"), (0.8999, "0.8-0.9 (High)"), (0.6, "0.6-0.7 (Low)"),
     (0.59, "0.0-0.6 (Very Low)"), (None, "0.0-0.6 (Very Low)")],
)
def test_bands(spark, score, band):
    assert one(spark, score, S.confidence_band, "double") == band


def test_argmax_takes_the_first_of_equals(spark):
    assert one(spark, [1.0, 3.0, 3.0], S.argmax, "array<double>") == 1


@pytest.mark.parametrize(
    "text, want",
    [('"@budi halo @budi x', '"halo @budi x'), ("@budi halo", "@budi halo"), ("x@budi y", "xy"),
     ("😀@budi y", "😀@budi y"), ('"@ani halo', '"@ani halo')],
)
def test_reply_prefix(spark, text, want):
    assert one(spark, text, lambda c: S.strip_reply(c, F.lit("budi"))) == want


@pytest.mark.parametrize(
    "path, day",
    [("/a/labeled_2024-01-05.csv", dt.date(2024, 1, 5)), ("/a/labeled_2024-1-5.csv/part-0", dt.date(2024, 1, 5)),
     ("/a/labeled_x.csv", None), ("/a/labeled_2024-02-31.csv", None), ("/a/other.csv", None)],
)
def test_file_day(spark, path, day):
    assert one(spark, path, lambda c: S.file_day(c, "labeled_")) == day


def test_labels_fail_fast_or_not(spark):
    df = spark.createDataFrame([("1",), ("2.9",), ("x",), (None,), ("7",)], "label string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        O.valid_labels(df).collect()
    assert sorted(r.label for r in O.valid_labels(df, strict=False).collect()) == [1, 2]


def test_missing_columns_are_named(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="b, c"):
        O.require_columns(df, ["a", "b", "c"])
    with pytest.raises(ValueError):
        O.require_rows(df.where("a > 1"), "empty")


def test_language_filter_needs_the_column(spark):
    df = spark.createDataFrame([("in", 1), ("en", 2), (None, 3)], "lang string, x int")
    assert [r.x for r in O.keep_languages(df).collect()] == [1]
    assert O.keep_languages(df.drop("lang")).count() == 3


def test_recent_has_no_upper_bound_and_includes_the_edge(spark):
    rows = [("2024-01-24 00:00:00",), ("2024-01-23 23:59:59",), ("2025-01-01 00:00:00",)]
    df = spark.createDataFrame(rows, "t string").select(F.col("t").cast("timestamp").alias("predicted_at"))
    assert O.recent(df, "predicted_at", "2024-01-31 00:00:00", "7 days").count() == 2


def test_requests(spark):
    bodies = [
        '{"id_str": "1", "clean_text": "a", "favorite_count": 3}',
        '{"id_str": "2", "clean_text": "a", "favorite_count": "4"}',
        '{"id_str": "3", "clean_text": "a", "favorite_count": "many"}',
        '{"clean_text": "a"}',
        '{"id_str": "5"}',
        "no json",
        None,
    ]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    got = O.typed_requests(df).orderBy("i").collect()
    assert [r.accepted for r in got] == [True, True, False, False, False, False, False]
    assert [r.favorite_count for r in got[:2]] == [3, 4]
    assert got[0].quote_count == 0 and got[0].body == bodies[0]


def test_constraints(spark):
    df = spark.createDataFrame(
        [("1", "f", "c", "positive", "LABEL_2", 1.0), ("2", None, "c", "p", "h", 1.5)],
        "id_str string, full_text string, clean_text string, pred_label string, hf_label string, pred_score double",
    )
    accepted, rejected = O.split_accepted(df)
    assert [r.id_str for r in accepted.collect()] == ["1"]
    assert rejected.first().reasons == ["full_text is null", "pred_score outside 0..1"]


def test_edges_keep_repeats(spark):
    df = spark.createDataFrame(
        [("a", "b"), ("a", "b"), ("a", None), (None, "b"), (None, None), ("", "")],
        "username string, in_reply_to_screen_name string",
    )
    got = sorted(tuple(r) for r in reply_edges(df).collect())
    assert got == [("", "b"), ("a", ""), ("a", "b"), ("a", "b")]


def test_quality(spark):
    df = spark.createDataFrame([("a", 0), ("b", None), ("c", 5)], "clean_text string, label int")
    got = {r.check: (r.passed, r.observed) for r in check_dataset(spark, lambda: df).collect()}
    assert got == {
        "exists": (True, 1), "columns": (True, 2), "no_null": (False, 1), "range": (False, 2),
        "min_rows": (False, 3),
    }
    missing = check_dataset(spark, lambda: spark.read.parquet("/nowhere/at/all")).collect()
    assert [(r.check, r.passed) for r in missing] == [("exists", False)]


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "pred_label string, hf_label string, pred_score double")
    assert share_of_total(value_counts(empty, "pred_label")).count() == 0
    stats = batch_stats(empty).first()
    assert stats.total_predictions == 0 and stats.average_confidence_score == 0.0
    assert choose_best(empty, "pred_score", 8).first().choice == "inaccurate"


def test_keyword_search(spark):
    df = spark.createDataFrame(
        [(1, "Makan SIANG gratis", "2024-01-05"), (2, "makan gratis", "2024-01-06"), (3, "siang makan", "2024-01-07")],
        "i int, full_text string, created_at string",
    ).withColumn("created_at", F.col("created_at").cast("timestamp"))
    found = O.keyword_search(df, ["makan", "Siang"], since="05-01-2024", until="07-01-2024")
    assert [r.i for r in found.collect()] == [1]
    assert O.keyword_search(df, ["gratis"], target=1).count() == 1


def test_reports_from_sql(spark):
    tables = Tables(spark, "/root/testdata/sf0.001")
    frames = {
        **run_report_frames(tables.runs_tables, EXPERIMENT, RUNS_AS_OF),
        **prediction_report_frames(tables.texted, AS_OF),
    }
    register(frames)
    assert len(frames) == 23
    assert spark.sql("SELECT sum(percentage) FROM sentiment_share").first()[0] == pytest.approx(100, abs=0.05)
    assert spark.sql("SELECT * FROM latest_run").count() == 1
    total = spark.sql("SELECT sum(total_predictions) FROM daily_summary").first()[0]
    assert total == spark.sql("SELECT sum(count) FROM daily_trend").first()[0]
