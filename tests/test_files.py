import pytest

from murmurate import files
from murmurate.plans import prepare
from murmurate.session import work_path
from murmurate.sources import csv as C
from murmurate.sources.tables import as_record
from murmurate.schemas import RUNS


def write(path, text):
    path.write_bytes(text)
    return str(path)


def test_quotes_breaks_bom_and_missing(spark, tmp_path):
    path = write(
        tmp_path / "x.csv",
        b'\xef\xbb\xbfclean_text,label\r\n"he said ""hi""\nnew, line",1.0\r\n"x",\r\n"NA",2\r\n',
    )
    got = [tuple(r) for r in C.read_csv(spark, path).collect()]
    assert got == [('he said "hi"\nnew, line', "1.0"), ("x", None), (None, "2")]


def test_round_trip(spark):
    rows = [(" lead", "tail "), ('q"q', "a,b"), ("l1\nl2", "\ttab"), ("back\\slash", "é😂"), ("x", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    path = C.write_csv(df, work_path(spark, "trip"))
    assert sorted(map(tuple, C.read_csv(spark, path).collect()), key=str) == sorted(rows, key=str)


def test_appended_headers_are_dropped(spark, tmp_path):
    path = write(tmp_path / "y.csv", b'"a","b"\r\n"1","2"\r\n"a","b"\r\n"3","4"\r\n')
    assert sorted(map(tuple, C.read_appended(spark, path).collect())) == [("1", "2"), ("3", "4")]


def test_replace_keeps_the_old_file(spark):
    path = work_path(spark, "ins") + ".csv"
    frame = lambda *x: spark.createDataFrame([(i,) for i in x], "a string")
    C.insert_csv(frame("1"), path)
    C.insert_csv(frame("2", "3"), path)
    C.insert_csv(frame("4"), path, "APPEND")
    assert C.read_csv(spark, path).count() == 3
    assert C.read_csv(spark, C.old_version(path)).count() == 1
    with pytest.raises(ValueError):
        C.insert_csv(frame("1"), path, "MERGE")


def daily(tmp_path, **days):
    for day, text in days.items():
        (tmp_path / f"labeled_{day[1:].replace('_', '-')}.csv").write_text(text)
    return f"{tmp_path}/labeled_*.csv"


def test_week_has_eight_days_and_columns_meet_by_name(spark, tmp_path):
    pattern = daily(
        tmp_path,
        d2024_01_24="label,clean_text\n0,edge\n",
        d2024_01_31="clean_text,label,extra\nlast,2,e\nblank,,e\nbig,9,e\n",
        d2024_01_23="clean_text,label\ntoo old,1\n",
        d2024_02_01="clean_text,label\ntoo new,1\n",
        d2024_1_30="clean_text,label\nshort,1.0\n",
        dnot_a_day="clean_text,label\nskipped,1\n",
    )
    merged = prepare.merge_week(spark, pattern, "2024-01-31")
    got = {(r.clean_text, r.label, r.extra) for r in merged.collect()}
    assert got == {("edge", 0, None), ("last", 2, "e"), ("short", 1, None)}
    assert dict(merged.dtypes)["label"] == "bigint"


def test_merge_job_ends(spark, tmp_path):
    assert prepare.merge_job(spark, f"{tmp_path}/labeled_*.csv", str(tmp_path), "2024-01-31") is None
    pattern = daily(tmp_path, d2024_01_30="clean_text,label\na,9\n")
    with pytest.raises(ValueError):
        prepare.merge_job(spark, pattern, str(tmp_path), "2024-01-31")
    pattern = daily(tmp_path, d2024_01_29="clean_text\na\n", d2024_01_30="clean_text\na\n")
    with pytest.raises(ValueError, match="label"):
        prepare.merge_job(spark, pattern, str(tmp_path), "2024-01-31")


def test_clean_and_unlabeled_jobs(spark, tmp_path):
    source = write(tmp_path / "raw.csv", 'full_text,lang\n"Halo @Budi",in\nBonjour,fr\n'.encode())
    counts = prepare.clean_job(spark, source, str(tmp_path))
    assert counts == {"rows_in": 2, "rows_out": 1}
    path = prepare.unlabeled_job(spark, f"{tmp_path}/cleaned.csv", str(tmp_path), "2024-01-31")
    assert path.endswith("cleaned_unlabeled_2024-01-31.csv")
    row = C.read_csv(spark, path).first()
    assert (row.clean_text, row.label) == ("halo @USER", None)
    with pytest.raises(ValueError, match="full_text"):
        prepare.clean_posts(spark.createDataFrame([(1,)], "x int"))


def test_epoch_milliseconds_become_timestamps(spark):
    df = spark.createDataFrame(
        [("r", "n", "FINISHED", 1, 1706659200000, None, None)],
        "run_uuid string, name string, status string, experiment_id int, start_time long, "
        "end_time long, deleted_time long",
    )
    assert str(as_record(df, RUNS).first().start_time) == "2024-01-31 00:00:00"


def test_file_operations(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    spark.range(1).write.parquet(a)
    spark.range(2).write.parquet(b)
    files.rename(spark, a, b)
    assert not files.exists(spark, a) and spark.read.parquet(b).count() == 1
    files.delete(spark, b)
    assert not files.exists(spark, b)


def test_replace_without_the_ending_keeps_everything(spark):
    path = work_path(spark, "a.csv.d") + "/plain"
    frame = lambda *x: spark.createDataFrame([(i,) for i in x], "a string")
    C.insert_csv(frame("1"), path)
    C.insert_csv(frame("2", "3"), path)
    assert C.read_csv(spark, path).count() == 2
    assert C.read_csv(spark, path + ".old").count() == 1
    C.insert_csv(frame("4"), path)
    assert [r.a for r in C.read_csv(spark, path).collect()] == ["4"]
    assert C.read_csv(spark, path + ".old").count() == 2
    with pytest.raises(ValueError, match="itself"):
        files.rename(spark, path, path)
    assert C.read_csv(spark, path).count() == 1


def test_files_with_swapped_headers_are_no_one_table(spark, tmp_path):
    write(tmp_path / "a.csv", b"id_str,full_text,lang\n1,one,in\n")
    write(tmp_path / "b.csv", b"lang,id_str,full_text\nin,2,two\n")
    with pytest.raises(Exception, match="(?i)header"):
        C.read_csv(spark, f"{tmp_path}/*.csv").collect()
    dated = spark.createDataFrame([(None, f"{tmp_path}/{n}.csv") for n in "ab"], "day date, path string")
    got = {(r.id_str, r.full_text, r.lang) for r in C.union_dated(spark, dated).collect()}
    assert got == {("1", "one", "in"), ("2", "two", "in")}


def test_rows_with_too_many_fields_fail(spark, tmp_path):
    path = write(tmp_path / "x.csv", b"a,b\n1,2\n3,4,5\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        C.read_csv(spark, path).collect()


def test_prefix_is_text_and_stands_at_the_start_of_a_name(spark, tmp_path):
    for name in ("x_labeled_2024-01-30.csv", "labeledX2024-01-30.csv", "labeled_2024-01-30.csv"):
        write(tmp_path / name, b"clean_text,label\na,1\n")
    found = C.dated_files(spark, f"{tmp_path}/*.csv", "2024-01-31").collect()
    assert [r.path.rsplit("/", 1)[1] for r in found] == ["labeled_2024-01-30.csv"]
    assert C.dated_files(spark, f"{tmp_path}/*.csv", "2024-01-31", "labeled.").count() == 0
