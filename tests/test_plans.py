"""What the physical plans must and must not hold."""

import re

import pytest

import __spark_entry__ as entry
from contract import Tables
from murmurate.operators.joins import left_join_many
from murmurate.operators.rows import recent
from murmurate.operators.upsert import one_per_post
from murmurate.operators.split import stratified_split
from murmurate.session import work_path
from murmurate.sources.store import PARTITION, write_by_day

FOLDER = "/root/testdata/sf0.001"


def plan(df, mode="formatted"):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    )


def named(spark, name):
    return plan(entry.queries()[name](spark, FOLDER))


REPORTS = [n for n in entry.queries() if n.startswith("q")]


@pytest.mark.parametrize("name", REPORTS)
def test_no_cross_join_and_no_python_in_reports(spark, name):
    text = named(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "EvalPython" not in text and "InPandas" not in text


@pytest.mark.parametrize("name", [n for n in REPORTS if n >= "q11"])
def test_time_filter_reaches_the_scan(spark, name):
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(ts", named(spark, name))


def test_reports_read_only_their_columns(spark):
    schema = re.search(r"ReadSchema: (\S+)", named(spark, "q11_sentiment_share")).group(1)
    assert schema == "struct<ts:timestamp_ntz,event_type:string>"


def test_aggregates_combine_before_the_shuffle(spark):
    for name in ("q11_sentiment_share", "q15_top_users", "q20_daily_summary"):
        assert "partial_" in named(spark, name)
    df = Tables(spark, FOLDER).predictions
    assert "partial_min_by" in plan(one_per_post(df, df.predicted_at))


def test_top_rows_are_not_sorted_globally(spark):
    for name in ("q15_top_users", "q17_feed", "q01_latest_run"):
        assert "TakeOrderedAndProject" in named(spark, name)


def test_days_are_pruned(spark):
    df = Tables(spark, FOLDER).predictions
    path = write_by_day(
        df.withColumn("predicted_at", df.predicted_at.cast("timestamp")), work_path(spark, "days")
    )
    text = plan(recent(spark.read.parquet(path), "predicted_at", "2024-01-31 00:00:00", "7 days"))
    assert re.search(rf"PartitionFilters: \[.*{PARTITION}.*>= 2024-01-24", text)


def test_split_by_unique_keys_is_a_filter(spark):
    """With unique keys nothing is shuffled or ranked to place the rows."""
    rows = [(f"k{i}", i % 3, "t") for i in range(90)]
    df = spark.createDataFrame(rows, "key string, label int, text string")
    text = plan(stratified_split(df, ["key"]), "simple")
    assert "Window" not in text and "Exchange" not in text


def test_scripts_name_no_cluster_local_folder():
    import pathlib

    for path in pathlib.Path(entry.__file__).parent.glob("murmurate/**/*.py"):
        text = path.read_text()
        assert "/tmp" not in text and "localCheckpoint" not in text
        if path.name != "session.py":
            assert "tempfile" not in text


def test_a_cluster_has_to_name_its_shared_folder():
    from types import SimpleNamespace

    from murmurate.session import shared_folder

    def session(master):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda x: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(session(master))
    assert shared_folder(session("local[4]"))


def runs_and_rows(spark):
    runs = spark.createDataFrame([("a",), ("b",), ("c",)], "run_uuid string")
    rows = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9)], "run_uuid string, value int")
    return runs, rows


def test_left_join_with_a_hot_right_key_can_be_split(spark):
    runs, rows = runs_and_rows(spark)
    got = left_join_many(runs, rows, "run_uuid")
    want = runs.join(rows, "run_uuid", "left")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "LeftOuter" not in plan(got)


def test_run_reports_start_no_job_when_built(spark):
    for name in [n for n in REPORTS if n < "q11"]:
        named(spark, name)  # the footers are read once per process
        spark.sparkContext.setJobGroup(f"build {name}", name)
        entry.queries()[name](spark, FOLDER)
        spark.sparkContext.setJobGroup("", "")
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup(f"build {name}")


def test_reports_of_a_window_do_not_shuffle_all_rows(spark):
    """Key/value rows meet the runs by broadcast; what is exchanged is aggregated."""
    for name in ("q03_acceptance_rate", "q04_avg_metrics", "q10_param_distribution"):
        text = named(spark, name)
        assert "SortMergeJoin" not in text and "partial_" in text
