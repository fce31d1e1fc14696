"""The stages of the pipeline, one after the other, on the smallest tables and on odd rows."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from murmurate.llm import queries
from murmurate.session import work_path

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_stages_keep_the_columns_and_take_effect(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "pii", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = work_path(spark, name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4]
    assert docs.where(F.col("text").contains("[EMAIL]")).count() > 0
    assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
    pieces = corpus_pipeline.packed(spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == sizes[-1]
    assert pieces.agg(F.sum("length")).first()[0] == pieces.where("start = 0").agg(F.sum("doc_tokens")).first()[0]


def test_odd_documents_pass_all_stages(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, None if k % 9 == 0 else " ".join(rng.choices("alpha beta gamma delta epsilon".split(), k=k)), "en", None, k) for k in range(60)]
    folder = str(tmp_path)
    spark.createDataFrame([*rows, (None, "no id", "en", "s", 5), rows[5], rows[5]], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_each_operator_has_its_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES if name.startswith("op"))
    assert numbers == list(range(1, 14))
