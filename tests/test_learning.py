import hashlib
import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from murmurate import files
from murmurate.operators import evaluate as E
from murmurate.operators import learn as L
from murmurate.operators import runs as R
from murmurate.operators import softmax as S
from murmurate.operators import split as SP
from murmurate.operators.subwords import encode
from murmurate.plans import serve
from murmurate.plans.learn import evaluate_job, model_versions, newest_model, register_model, serving_model, train
from murmurate.session import work_path
from murmurate.sources.csv import read_csv, write_csv
from murmurate.sources.store import PredictionStore
from murmurate.streaming import predictions as ST


def expected_quota(counts, fraction=0.2):
    total = sum(counts.values())
    wanted = math.ceil(round(total * fraction, 9))
    exact = {k: wanted * n / total for k, n in counts.items()}
    short = wanted - sum(math.floor(x) for x in exact.values())
    order = sorted(exact, key=lambda k: (-(exact[k] - math.floor(exact[k])), k))
    return {k: math.floor(exact[k]) + (order.index(k) < short) for k in counts}


def brute(rows):
    """rows of (key, label, text) → multiset of validation rows"""
    quota = expected_quota(Counter(r[1] for r in rows))
    out = Counter()
    for label, q in quota.items():
        ranked = sorted(
            (r for r in rows if r[1] == label),
            key=lambda r: hashlib.md5(f"{r[0]}|42".encode()).hexdigest(),
        )
        out.update(ranked[:q])
    return out


@pytest.mark.parametrize(
    "rows",
    [
        [(f"k{i}", i % 3, "t") for i in range(101)],
        [(f"k{i}", 1, "t") for i in range(10)],
        [(f"k{i}", 0 if i < 97 else 2, "t") for i in range(100)],
        [("same", 1, "copy")] * 60 + [(f"k{i}", i % 3, "t") for i in range(60)],
        [("only", 2, "copy")] * 7,
        [("k", 0, "t")],
    ],
)
def test_split_equals_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "key string, label int, text string")
    got = SP.stratified_split(df, ["key"]).collect()
    validation = Counter((r.key, r.label, r.text) for r in got if r.split == "validation")
    assert validation == brute(rows)
    assert Counter((r.key, r.label, r.text) for r in got) == Counter(rows)


def test_split_copies_are_written_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(SP, "_CHUNK", 10)
    rows = [("same", 1, "copy")] * 95
    got = SP.stratified_split(
        spark.createDataFrame(rows, "key string, label int, text string"), ["key"]
    ).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"train": 76, "validation": 19}


def test_hot_key_at_the_cut_is_not_ranked_as_a_whole(spark):
    """A key with most rows of its class: rows of one bucket only are left to rank."""
    rows = [("hot", 1, f"t{i}") for i in range(400)] + [(f"k{i}", 1, "t") for i in range(100)]
    df = spark.createDataFrame(rows, "key string, label int, text string").repartition(4)
    got = SP.stratified_split(df, ["key"])
    assert got.count() == 500 and got.where("split = 'validation'").count() == 100
    assert got.select("key", "text").distinct().count() == 500
    again = SP.stratified_split(df.repartition(7), ["key"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))


def test_quotas():
    assert SP.quotas({0: 50, 1: 46, 2: 268}, 0.2) == {0: 10, 1: 9, 2: 54}
    assert SP.quotas({1: 1}, 0.2) == {1: 1}


def test_split_of_equal_keys_with_different_rows_keeps_the_quota(spark):
    rows = [("same", 1, f"t{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "key string, label int, text string")
    got = SP.stratified_split(df, ["key"])
    assert got.where("split = 'validation'").count() == 10 and got.count() == 50
    assert got.select("text").distinct().count() == 50


def test_split_of_nothing(spark):
    df = spark.createDataFrame([], "key string, label int, text string")
    assert SP.stratified_split(df, ["key"]).count() == 0


def pairs(spark, rows):
    return E.pair_counts(spark.createDataFrame(rows, "label int, prediction int"))


def test_metrics_with_a_class_that_is_never_predicted(spark):
    p = pairs(spark, [(0, 0), (0, 1), (1, 1), (2, 1)])
    m = E.basic_metrics(p).first()
    # f1: class 0 2/3, class 1 1/2, class 2 0
    assert m.accuracy == 0.5
    assert m.f1_macro == pytest.approx((2 / 3 + 0.5 + 0) / 3, abs=1e-6)
    assert m.precision == pytest.approx((1 * 2 + 1 / 3) / 4, abs=1e-6)
    assert m.recall == pytest.approx(0.5, abs=1e-6)
    report = {r["class"]: r for r in E.class_report(p).collect()}
    assert report["2"].precision == 0.0 and report["2"].support == 1.0
    assert report["accuracy"].support == 0.5
    assert report["macro avg"].recall == pytest.approx((0.5 + 1 + 0) / 3, abs=1e-6)


def test_metrics_of_one_class_and_of_nothing(spark):
    assert E.basic_metrics(pairs(spark, [(1, 1)])).first().f1_macro == 1.0
    assert E.basic_metrics(pairs(spark, [])).first().accuracy is None


def test_confusion_is_dense(spark):
    got = E.confusion_matrix(pairs(spark, [(0, 2), (0, 2), (2, 2)]), (0, 2)).orderBy("true_label").collect()
    assert [tuple(r) for r in got] == [(0, 0, 2), (2, 0, 1)]
    got = E.confusion_matrix(pairs(spark, [(0, 2)]), (0, 1, 2)).orderBy("true_label").collect()
    assert [tuple(r) for r in got] == [(0, 0, 0, 1), (1, 0, 0, 0), (2, 0, 0, 0)]


def test_confusion_has_no_cap_and_loses_no_class(spark):
    got = E.confusion_counts(pairs(spark, [(i, (i + 1) % 1001) for i in range(1001)]))
    assert got.count() == 1001 * 1001 and got.where("n = 1").count() == 1001
    with pytest.raises(Exception, match="not named"):
        E.confusion_matrix(pairs(spark, [(0, 2), (5, 0)]), (0, 1, 2)).collect()
    assert E.confusion_counts(pairs(spark, [])).count() == 0


def test_split_keeps_all_classes_and_refuses_what_it_is_not_given(spark):
    rows = [(f"k{i}", i % 4, "t") for i in range(400)]
    df = spark.createDataFrame(rows, "key string, label int, text string")
    got = SP.stratified_split(df, ["key"])
    sizes = Counter((r.label, r.split) for r in got.collect())
    assert sizes == {(c, s): n for c in range(4) for s, n in (("train", 80), ("validation", 20))}
    with pytest.raises(ValueError, match="3"):
        SP.stratified_split(df, ["key"], classes=(0, 1, 2))
    with pytest.raises(ValueError, match="None"):
        SP.stratified_split(df.withColumn("label", F.lit(None).cast("int")), ["key"])


def test_tokens_are_cut_and_padded(spark):
    df = spark.createDataFrame([("a b c",), ("",)], "t string")
    words = df.select(L.padded_tokens(L.tokens(F.col("t")), 2).alias("w")).collect()
    assert [r.w for r in words] == [["a", "b"], ["[PAD]", "[PAD]"]]


def test_unscorable_rows_do_not_fail_the_batch(spark):
    df = spark.createDataFrame(
        [("1", "a", [0.0, 1.0, 5.0]), ("2", None, [5.0, 0.0, 0.0]), ("3", "b", None)],
        "id_str string, clean_text string, logits array<double>",
    )
    got = L.score_posts(df, L.logits_scorer()).orderBy("id_str").collect()
    assert [(r.hf_label, r.pred_label) for r in got] == [
        ("LABEL_2", "positive"), ("error", "error"), ("error", "error"),
    ]
    assert got[0].pred_score == pytest.approx(1 / (1 + math.exp(-4) + math.exp(-5)))
    assert got[1].pred_score == 0.0 and got[1].clean_text is None


def test_gate_edges(spark):
    df = spark.createDataFrame([("a", 0.8), ("b", 0.79), ("c", None)], "run_uuid string, eval_f1_macro double")
    got = {r.run_uuid: r.model_status for r in R.gate(df).collect()}
    assert got == {"a": "accepted", "b": "rejected", "c": "rejected"}


def test_stage_choice(spark):
    df = spark.createDataFrame(
        [("m", 1, "Production", "r1"), ("m", 2, "Production", "r2"), ("m", 9, "Staging", "r9"),
         ("n", 3, "Staging", "r3"), ("o", 1, "Archived", "r1")],
        "model_name string, version long, stage string, run_uuid string",
    )
    got = {r.model_name: r.version for r in R.pick_stage_model(df).collect()}
    assert got == {"m": 2, "n": 3}
    new = spark.createDataFrame([("m", "Staging", "x"), ("z", "Staging", "y")], "model_name string, stage string, run_uuid string")
    assert {r.model_name: r.version for r in R.register_versions(df, new).collect()} == {"m": 10, "z": 1}


def test_newest_run_hides_older_models(spark):
    runs = spark.createDataFrame(
        [("old", 1, "2024-01-01"), ("new", 1, "2024-01-02")], "run_uuid string, experiment_id int, d string"
    ).select("*", F.col("d").cast("timestamp").alias("start_time"), F.lit(None).cast("timestamp").alias("deleted_time"))
    experiments = spark.createDataFrame([(1, "x")], "experiment_id int, name string")
    artifacts = spark.createDataFrame([("old", "model"), ("new", "logs")], "run_uuid string, path string")
    assert R.pick_latest_model(runs, experiments, artifacts, "x").count() == 0
    found = R.pick_latest_model(runs, experiments, artifacts, "x", fallback=True).first()
    assert found.model_uri == "runs:/old/model"


@pytest.fixture(scope="module")
def trained(spark):
    words = {0: "buruk jelek", 1: "biasa saja", 2: "bagus mantap"}
    rows = [(f"{i}", f"teks {words[i % 3]} {i}", i % 3) for i in range(150)]
    week = spark.createDataFrame(rows, "id_str string, clean_text string, label int")
    folder, models = work_path(spark, "runs"), work_path(spark, "models")
    result = train(spark, week, ["id_str"], "2024-01-31 10:20:30", folder, models,
                   params={"epochs": 5, "features": 1 << 10})
    return result, week, folder, models


def test_training_accepts_a_good_model(spark, trained):
    result, week, folder, models = trained
    assert result.accepted and result.metrics["f1_macro"] >= 0.8
    assert result.run_uuid.startswith("sentiment-fresh-20240131_102030-")
    tags = spark.read.parquet(f"{folder}/tags").first()
    assert (tags.key, tags.value) == ("model_status", "accepted")
    logged = {r.key: r.value for r in spark.read.parquet(f"{folder}/metrics").collect()}
    assert {"eval_accuracy", "eval_f1_macro", "eval_loss"} <= set(logged)
    assert 0 < logged["eval_loss"] < math.log(3)
    run = spark.read.parquet(f"{folder}/runs").where(F.col("run_uuid") == result.run_uuid).first()
    assert str(run.start_time) == "2024-01-31 10:20:30" and run.end_time > run.start_time
    assert (run["name"], run.status) == ("sentiment-fresh-20240131_102030", "FINISHED")
    out = evaluate_job(result.model, week, work_path(spark, "reports"))
    assert spark.read.json(f"{out}/eval_metrics").first().accuracy >= 0.8


def test_accepted_models_are_registered_and_served(spark, trained):
    result, week, folder, models = trained
    assert [tuple(r) for r in model_versions(spark, folder).collect()] == [("sentiment", 1, "Staging", result.run_uuid)]
    scored = L.model_scorer(serving_model(spark, folder, models))(week.select("id_str", "clean_text"))
    assert scored.where(F.col("hf_label").isNull()).count() == 0 and scored.count() == week.count()
    with pytest.raises(ValueError, match="other"):
        serving_model(spark, folder, models, "other")
    empty = work_path(spark, "none")
    assert model_versions(spark, empty).count() == 0
    for run in ("r1", "r2"):
        register_model(spark, empty, "m", run)
    register_model(spark, empty, "m", "r3", "Production")
    register_model(spark, empty, "m", "r4")
    assert sorted((r.version, r.run_uuid) for r in model_versions(spark, empty).collect()) == [(1, "r1"), (2, "r2"), (3, "r3"), (4, "r4")]
    with pytest.raises(Exception, match="r3"):
        serving_model(spark, empty, models, "m")


def test_training_rejects_a_poor_model(spark, trained):
    _, week, folder, models = trained
    assert newest_model(spark, folder, models, 0) == f"{models}/{trained[0].run_uuid}"
    assert newest_model(spark, folder, models, 1) is None
    result = train(spark, week, ["id_str"], "2024-02-01 00:00:00", folder, models + "x",
                   threshold=1.01, params={"epochs": 1, "features": 1 << 4})
    assert not result.accepted
    assert result.run_uuid.startswith("sentiment-fresh")
    # The rejected run is the newest now and hides the older model.
    assert newest_model(spark, folder, models, 0) is None
    assert not files.exists(spark, models + "x")


def test_scoring_job_stores_and_counts(spark, trained):
    result = trained[0]
    source = write_csv(
        spark.createDataFrame(
            [("1", "F1", "bagus mantap", "7"), ("2", "F2", None, "1"), ("1", "F1b", "buruk jelek", "9"),
             ("3", None, "biasa saja", "2")],
            "id_str string, full_text string, clean_text string, favorite_count string",
        ).coalesce(1),
        work_path(spark, "in"),
    )
    target = work_path(spark, "out")
    store = PredictionStore(spark, work_path(spark, "store"))
    report = serve.score_posts_job(
        spark, source, target, L.model_scorer(result.model), store, "run_1", "2024-01-31 10:20:30"
    )
    counts = {k: report[k] for k in ("total_predictions", "failed", "saved", "rejected")}
    assert counts == {"total_predictions": 4, "failed": 1, "saved": 2, "rejected": 1}
    assert report["label_distribution"] == {"positive": 1, "negative": 1, "neutral": 1, "error": 1}
    rows = store.read().collect()
    assert [(r.id_str, r.full_text, r.favorite_count, r.pred_label) for r in rows] == [
        ("1", "F1", 7, "negative")
    ]
    written = read_csv(spark, f"{target}/predictions_batch_tweet_20240131_102030.csv")
    assert written.where("hf_label = 'error'").count() == 1 and written.count() == 4


def test_first_row_of_a_post_is_that_of_the_first_file(spark, trained):
    """Two files hold one post; Spark may read the larger second one first."""
    folder = work_path(spark, "two")
    rows = [[("1", "first", "bagus", "1")], [("1", "second", "buruk", "2")] + [(str(i), "F", "biasa " * 50, "3") for i in range(10, 300)]]
    for k, part in enumerate(rows):
        write_csv(
            spark.createDataFrame(part, "id_str string, full_text string, clean_text string, favorite_count string").coalesce(1),
            f"{folder}/day={k}",
        )
    store = PredictionStore(spark, work_path(spark, "store"))
    serve.score_posts_job(
        spark, f"{folder}/day=*", work_path(spark, "out"), L.model_scorer(trained[0].model), store, "run_1", "2024-01-31 10:20:30"
    )
    row = store.read().where("id_str = '1'").first()
    assert (row.full_text, row.favorite_count, row.pred_label) == ("first", 1, "negative")


def test_request_stream_is_scored_and_stored(spark, trained):
    landing, refused = work_path(spark, "requests"), work_path(spark, "refused")
    bodies = [
        '{"id_str": "1", "clean_text": "bagus mantap", "full_text": "F", "reply_count": "3"}',
        '{"id_str": "2", "clean_text": "buruk jelek"}',
        '{"id_str": 3',
        '{"id_str": "4", "full_text": "F"}',
    ]
    spark.createDataFrame([(b,) for b in bodies], "value string").coalesce(1).write.text(landing)
    store = PredictionStore(spark, work_path(spark, "store"))
    to_records = serve.request_records(
        L.model_scorer(trained[0].model), "run_1", "2024-01-31 10:20:30"
    )
    ST.store_stream(
        spark.readStream.text(landing), to_records, store, work_path(spark, "c"), F.col("_row"), refused
    ).awaitTermination()
    rows = store.read().collect()
    assert [(r.id_str, r.pred_label, r.reply_count) for r in rows] == [("1", "positive", 3)]
    assert [r.id_str for r in spark.read.parquet(refused).collect()] == ["2"]


def test_text_job(spark, trained):
    source = write_csv(spark.createDataFrame([("bagus mantap",)], "text string"), work_path(spark, "in"))
    scorer = lambda df: L.model_scorer(trained[0].model)(
        df.withColumnRenamed("text", "clean_text")
    ).withColumnRenamed("clean_text", "text")
    report = serve.score_texts_job(spark, source, work_path(spark, "out"), scorer)
    assert read_csv(spark, report["output"]).first().pred_label == "positive"
    assert report["total_predictions"] == 1 and report["average_confidence_score"] > 0.5
    with pytest.raises(ValueError, match="text"):
        L.score_batch(spark.createDataFrame([("a",)], "clean_text string"), scorer)


def test_training_goes_on_from_the_saved_coefficients(spark):
    folder, models = work_path(spark, "runs"), work_path(spark, "models")
    weeks = [
        spark.createDataFrame([(f"{w}{i}", f"{word} kata{i % 7} {w}", i % 3) for i, word in enumerate(["buruk", "biasa", "bagus"] * 30)], "id_str string, clean_text string, label int")
        for w in ("satu", "dua")
    ]
    first = train(spark, weeks[0], ["id_str"], "2024-01-01 00:00:00", folder, models, threshold=0.0, params={"features": 1 << 8})
    second = train(spark, weeks[1], ["id_str"], "2024-01-08 00:00:00", folder, models, threshold=0.0, stage="Production")
    frozen = S.layer(np.arange(1 << 8), 1 << 8) < 6
    assert second.model.features == 1 << 8 and "incremental" in second.run_uuid
    assert (second.model.weights[:, frozen] == first.model.weights[:, frozen]).all()
    assert (second.model.weights[:, ~frozen] != first.model.weights[:, ~frozen]).any()
    assert np.array_equal(S.SoftmaxModel.load(spark, f"{models}/{second.run_uuid}").weights, second.model.weights)
    params = spark.read.parquet(f"{folder}/params").groupBy("key").agg(F.collect_set("value").alias("v"))
    logged = {r["key"]: set(r.v) for r in params.collect()}
    assert logged["freeze_layers"] == {"0", "6"} and logged["learning_rate"] == {"3.0"} and logged["batch_size"] == {"9"}
    assert isinstance(serving_model(spark, folder, models), S.SoftmaxModel)
    assert [r.stage for r in model_versions(spark, folder).orderBy("version").collect()] == ["Staging", "Production"]


def test_gradient_equals_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [(" ".join(rng.choice(["a", "b", "c", "d", "é"], rng.integers(0, 9))), int(rng.integers(0, 4))) for _ in range(60)] + [(None, 1), ("a", None)]
    df = spark.createDataFrame(rows, "clean_text string, label int").repartition(3)
    x = np.zeros((61, 16))
    for k, (text, _) in enumerate(rows[:61]):
        words = (text or "").split()
        for w in words:
            x[k, int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % 16] += 1 / math.sqrt(len(words))
    y = np.eye(4)[[label for _, label in rows[:61]]]
    weights, bias = np.zeros((4, 16)), np.zeros(4)
    for _ in range(4):
        p = np.exp(x @ weights.T + bias)
        error = p / p.sum(axis=1, keepdims=True) - y
        weights, bias = weights * (1 - 0.5 * 0.01) - 0.5 * error.T @ x / 61, bias - 0.5 * error.mean(axis=0)
    fitted = S.fit(df, learning_rate=0.5, weight_decay=0.01, epochs=4, batch_size=1000, features=16)
    assert np.allclose(fitted.model.weights, weights) and np.allclose(fitted.model.bias, bias)
    wrong = S.fit(df.withColumn("label", F.lit(0)), learning_rate=0.5, weight_decay=0.01, epochs=4, batch_size=1000, features=16)
    assert not np.allclose(wrong.model.weights[0], weights[0])
    scored = fitted.model.transform(df).collect()
    assert all(abs(sum(r.probability) - 1) < 1e-12 for r in scored) and len(scored) == 62
    assert S.fit(df.limit(0), features=16).model.weights.shape == (3, 16)
    with pytest.raises(ValueError, match="999"):
        S.fit(df.withColumn("label", F.lit(-1)), features=16)


def test_unique_keys_are_split_in_two_passes(spark, monkeypatch):
    """One pass counts buckets, one counts within the bucket of each cut; further levels are for repeated keys."""
    passes, advance = [], SP._advance

    def counted(rows, label, cuts, level, n):
        if level == "_key_bucket" or any(cut.need and not cut.settled for cut in cuts.values()):
            passes.append(level)
        advance(rows, label, cuts, level, n)

    monkeypatch.setattr(SP, "_advance", counted)
    df = spark.range(5000).select(F.col("id").cast("string").alias("id_str"), (F.col("id") % 3).alias("label"))
    got = SP.stratified_split(df, ["id_str"]).groupBy("label", "split").count().collect()
    assert sum(r["count"] for r in got if r.split == "validation") == 1000 and sum(r["count"] for r in got) == 5000
    assert passes in (["_key_bucket"], ["_key_bucket", "_key_bucket_2"])


def _longest(word, vocabulary):
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in vocabulary:
                out.append(piece)
                at = end
                break
        else:
            return ["[UNK]"]
    return out if len(word) <= 100 else ["[UNK]"]


def test_subwords_equal_plain_longest_match(spark):
    rng = random.Random(7)
    vocabulary = {"".join(rng.choices("abcé", k=rng.randint(1, 4))) for _ in range(60)} | {"##" + "".join(rng.choices("abcé", k=rng.randint(1, 3))) for _ in range(30)} | {"a" * 101, "##😀"}
    texts = [" ".join("".join(rng.choices("abcé😀", k=rng.randint(1, 9))) for _ in range(rng.randint(0, 14))) for _ in range(150)]
    texts += [None, "", " ", "a" * 101, "ab " * 300, "same", "same", "b" * 5000]
    df = spark.createDataFrame([(k % 150, t, "x") for k, t in enumerate(texts)], "id long, clean_text string, piece string")
    pieces = spark.createDataFrame([(p,) for p in [*vocabulary, *vocabulary, None]], "piece string")
    found = encode(df, pieces, length=16).collect()
    assert len(found) == len(texts) and found[0].asDict().keys() == {"id", "clean_text", "piece", "input_pieces", "attention_mask"}
    for r in found:
        want = [p for w in (r.clean_text or "").split() for p in _longest(w, vocabulary)][:14]
        want = ["[CLS]", *want, "[SEP]"]
        assert r.input_pieces == want + ["[PAD]"] * (16 - len(want))
        assert r.attention_mask == [1] * len(want) + [0] * (16 - len(want))
    assert encode(df.limit(0), pieces).count() == 0 and encode(df.where("id = 5"), pieces.limit(0)).count() == 2


def _slot_lists(sizes):
    ends = np.concatenate([[0], np.cumsum(sizes)])
    slots = np.random.default_rng(7).integers(0, S.FEATURES, ends[-1])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(slots, pa.int32()))


def test_memory_of_a_task_does_not_follow_its_arrow_batch():
    column, weights, bias = _slot_lists([1000] * 3000), np.zeros((3, S.FEATURES)), np.zeros(3)
    batch = pa.RecordBatch.from_arrays([column, pa.array(np.arange(3000) % 3, pa.int32())], ["slots", "label"])
    for run in (lambda: S._all_chances(column, weights, bias), lambda: S._sums([batch], weights, bias)):
        tracemalloc.start()
        run()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 16e6  # an array of doubles over the 3 million words alone is 24 MB per class


@pytest.mark.parametrize("piece", [1, 5, 64, 1 << 17])
def test_pieces_lose_no_text(piece, monkeypatch):
    monkeypatch.setattr(S, "PIECE", piece)
    sizes = [0, 0, 3, 70, 1, 0, 4, 5, 0, 200, 0]
    whole = _slot_lists([9, 1, *sizes])
    column = whole.slice(2)  # as a slice it does not start at zero
    weights = np.random.default_rng(1).normal(size=(4, S.FEATURES))
    bias, label = np.array([0.1, 0.0, -0.2, 0.3]), np.arange(len(sizes)) % 4
    logits = np.array([[weights[k, x].sum() / max(len(x), 1) ** 0.5 + bias[k] for k in range(4)] for x in (np.array(v, int) for v in column.to_pylist())])
    want = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    assert np.allclose(S._all_chances(column, weights, bias), want, rtol=1e-9)
    assert S._all_chances(column.slice(0, 0), weights, bias).shape == (0, 4)
    error = want - np.eye(4)[label]
    total = np.zeros_like(weights)
    for e, x in zip(error, column.to_pylist()):
        for slot in x:
            total[:, slot] += e / len(x) ** 0.5
    got, biases = S._sums([pa.RecordBatch.from_arrays([column, pa.array(label, pa.int32())], ["slots", "label"])], weights, bias)
    assert np.allclose(got, total, atol=1e-9) and np.allclose(biases, error.sum(axis=0))
