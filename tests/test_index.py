"""Keyword index, sketches and the earliest row of a post."""

import random
import re

import pytest
from pyspark.sql import functions as F

from murmurate.functions import scalar as S
from murmurate.operators import aggregates as A
from murmurate.operators import rows as O
from murmurate.session import work_path
from murmurate.sources.keyword_index import FOLDERS, candidates, indexed_search, write_index
from murmurate.streaming import predictions as ST


@pytest.fixture(scope="module")
def indexed(spark):
    rng = random.Random(1)
    words = ["halo", "HALO!", "@budi", "@budiman", "pasar", "harga", "naik", "x y", "é", "a&b"] + [f"w{k}" for k in range(300)]
    rows = [(str(k), " ".join(rng.choices(words, k=rng.randint(0, 12))), f"2024-01-{1 + k % 28:02d} 10:00:00") for k in range(600)]
    rows += [("n", None, "2024-01-02 00:00:00"), ("e", "", None), ("t", "halo @budi", None)]
    posts = spark.createDataFrame(rows, "id_str string, full_text string, t string").withColumn("created_at", F.col("t").cast("timestamp"))
    path = work_path(spark, "index")
    write_index(posts, path)
    return posts, path


@pytest.mark.parametrize(
    ("words", "since", "until"),
    [(["halo"], None, None), (["Halo", "@budi"], None, None), (["alo", "ud"], "05-01-2024", "20-01-2024"), (["@budi pasar"], None, None), (["absent", "halo"], None, None), ([], "03-01-2024", None), (["", "harga"], None, "09-01-2024"), ([""], None, None)],
)
def test_index_finds_what_the_scan_finds(spark, indexed, words, since, until):
    posts, path = indexed
    want = sorted(r.id_str for r in O.keyword_search(posts, words, since, until).collect())
    assert sorted(r.id_str for r in indexed_search(posts, path, words, since, until).collect()) == want


def test_only_folders_of_the_words_are_read(spark, indexed):
    plan = candidates(spark, indexed[1], ["w17", "pasar"])._jdf.queryExecution().toString()
    read = re.findall(r"PartitionFilters: \[([^]]*folder[^]]*)\]", plan)
    assert read and all(0 < len(re.findall(r"\d+", x.split("folder", 1)[1])) < FOLDERS / 8 for x in read)
    # the rarer word comes first: its folders are read for the inner side
    assert plan.index("Contains(word") >= 0 or "contains" in plan.lower()


def test_sketches_add_up_within_their_error(spark):
    df = spark.range(60_000).select(
        (F.col("id") * 7 % 20_011).cast("string").alias("username"),
        F.expr("timestamp_seconds(1704067200 + id % 10 * 86400)").alias("predicted_at"),
    ).unionByName(spark.sql("SELECT cast(NULL AS string) AS username, timestamp'2024-01-01' AS predicted_at"))
    sketches = A.daily_sketches(df, "username")
    exact = {r.day: r.n for r in df.groupBy(F.to_date("predicted_at").alias("day")).agg(F.count_distinct("username").alias("n")).collect()}
    assert all(abs(r.users - exact[r.day]) <= 5 * 0.01625 * exact[r.day] for r in A.rolling_distinct(sketches, 1).collect())
    whole = max(A.rolling_distinct(sketches, 10).collect(), key=lambda r: r.day)
    assert abs(whole.users - 20_011) <= 5 * 0.01625 * 20_011
    assert A.rolling_distinct(A.daily_sketches(df.limit(0), "username"), 7).count() == 0


def test_numbers_beyond_fractions_are_not_rounded(spark):
    values = [1e21, -1e300, 2.0**53, 2.0**53 - 1, 1.005, None, float("nan"), float("inf")]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(S.round_numeric(F.col("v"), 2).alias("x")).collect()]
    assert got[:6] == [1e21, -1e300, 2.0**53, 2.0**53 - 1, 1.01, None] and got[6] != got[6] and got[7] == float("inf")


def test_a_counter_that_is_null_stays_null(spark):
    bodies = ['{"id_str": "1", "clean_text": "a", "favorite_count": null}', '{"id_str": "1", "clean_text": "a"}']
    got = O.typed_requests(spark.createDataFrame([(b,) for b in bodies], "body string")).collect()
    assert [(r.favorite_count, r.accepted) for r in got] == [(None, True), (0, True)]


def test_the_earliest_row_of_a_session_stays(spark):
    landing, out = work_path(spark, "landing"), work_path(spark, "out")
    rows = [("a", 3, "late"), ("a", 1, "first"), ("a", 1, "second"), ("a", 2, "mid"), ("a", 20, "again"), ("b", 5, "only"), ("z", 90, "closes")]
    df = spark.createDataFrame(rows, "id_str string, h int, what string").withColumn("at", F.expr("timestamp_seconds(1704067200 + h * 3600)")).drop("h")
    df.repartition(3).write.parquet(landing)
    once = ST.earliest_of_each(ST.file_stream(spark, landing, df.schema), "at", "2 hours 1 minute", "1 hour")
    ST.append_parquet(once, out, work_path(spark, "c")).awaitTermination()
    assert sorted((r.id_str, r.what) for r in spark.read.parquet(out).collect()) == [("a", "again"), ("a", "first"), ("b", "only")]
