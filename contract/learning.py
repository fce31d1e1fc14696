"""Split, features, training, evaluation and model selection."""

from dataclasses import replace

from pyspark.sql import functions as F

from contract.sqltext import SPACE_SET, rnd
from contract.views import EXPERIMENT, RUNS_AS_OF, query
from murmurate.functions.scalar import round_numeric
from murmurate.operators import evaluate as E
from murmurate.operators import learn as L
from murmurate.operators import runs as R
from murmurate.operators.aggregates import pivot_keys
from murmurate.operators.rows import valid_labels
from murmurate.operators.softmax import FEATURES, LAYERS, fit
from murmurate.operators.split import stratified_split
from murmurate.operators.subwords import encode
from murmurate.plans.learn import evaluate, split_rows, train
from murmurate.schemas import LABEL_NAMES
from murmurate.session import work_path, written


_QUOTA = """counts AS (SELECT label, count(*) AS n FROM valid GROUP BY label),
      wanted AS (SELECT ceil(round(sum(n) * 0.2, 9)) AS w, sum(n) AS total FROM counts),
      exact AS (SELECT label, n, w * n / total AS x, w FROM counts, wanted),
      quota AS (SELECT label, n, floor(x) + CASE WHEN
          row_number() OVER (ORDER BY x - floor(x) DESC, label) <= w - sum(floor(x)) OVER ()
          THEN 1 ELSE 0 END AS q FROM exact)"""


@query("stratified_split", "valid", f"""
    WITH {_QUOTA},
      ranked AS (SELECT doc_id, label, row_number() OVER (
          PARTITION BY label ORDER BY md5(concat(id_str, '|42'))) AS place FROM valid)
    SELECT doc_id, r.label, CASE WHEN place <= q THEN 'validation' ELSE 'train' END AS split
    FROM ranked r JOIN quota ON r.label = quota.label""")
def split(v):
    rows = valid_labels(v.labeled).select("doc_id", "id_str", "label")
    return stratified_split(rows, ["id_str"]).drop("id_str")


_WORDS = f"[w for w in regexp_split_to_array(clean_text, '[{SPACE_SET}]+') if w <> '']"


@query("featurize", "labeled", f"""
    SELECT doc_id, cast(len(words) AS bigint) AS n_words, md5(array_to_string(words, ' ')) AS text_hash,
      md5(array_to_string(list_concat(words[1:128],
        [('[PAD]') for _ in range(greatest(0, 128 - len(words)))]), ' ')) AS input_hash
    FROM (SELECT doc_id, {_WORDS} AS words FROM labeled)""")
def featurize(v):
    words = v.labeled.select("doc_id", L.tokens(F.col("clean_text")).alias("words"))
    return words.select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        F.md5(F.array_join("words", " ")).alias("text_hash"),
        F.md5(F.array_join(L.padded_tokens(F.col("words")), " ")).alias("input_hash"),
    )


_PIECES = """pieces AS (SELECT DISTINCT substr(w, 1, 3) AS piece FROM every
        UNION SELECT concat('##', substr(w, 4, 2)) FROM every WHERE length(w) >= 5
        UNION SELECT concat('##', w) FROM every WHERE length(w) <= 2
        UNION SELECT concat('##', c) FROM (SELECT unnest(string_split('aeinorst', '')) AS c))"""


@query("featurize_subwords", "labeled", f"""
    WITH RECURSIVE texts AS (SELECT doc_id, {_WORDS} AS words FROM labeled),
      every AS (SELECT DISTINCT unnest(words) AS w FROM texts),
      {_PIECES},
      short AS (SELECT w FROM every WHERE length(w) <= 100),
      starts AS (SELECT w, unnest(range(1, length(w) + 1)) AS spot FROM short),
      cut AS (SELECT w, spot, max(n) AS n FROM (SELECT w, spot, unnest(range(1, least(4, length(w) - spot + 2))) AS n FROM starts)
        JOIN pieces ON piece = CASE WHEN spot = 1 THEN '' ELSE '##' END || substr(w, spot, n) GROUP BY w, spot),
      walk AS (
        SELECT w, 1 AS spot, cast([] AS varchar[]) AS found FROM short
        UNION ALL SELECT k.w, k.spot + n, list_append(found, CASE WHEN k.spot = 1 THEN '' ELSE '##' END || substr(k.w, k.spot, n))
        FROM walk k JOIN cut ON cut.w = k.w AND cut.spot = k.spot),
      whole AS (SELECT w, found FROM walk WHERE spot = length(w) + 1),
      taken AS (SELECT doc_id, unnest(words[1:126]) AS w, unnest(range(len(words[1:126]))) AS place FROM texts),
      listed AS (SELECT doc_id, flatten(list(coalesce(found, ['[UNK]']) ORDER BY place))[1:126] AS found
        FROM taken LEFT JOIN whole ON whole.w = taken.w GROUP BY doc_id),
      filled AS (SELECT t.doc_id, list_concat(['[CLS]'], coalesce(found, []), ['[SEP]']) AS f FROM texts t LEFT JOIN listed l ON l.doc_id = t.doc_id)
    SELECT doc_id, cast(len(f) AS bigint) AS attended,
      md5(array_to_string(list_concat(f, [('[PAD]') FOR _ IN range(128 - len(f))]), ' ')) AS input_hash FROM filled""")
def featurize_subwords(v):
    """The vocabulary is a rule over the words themselves: first three letters, two letters further on, a few single ones."""
    rows = written(v.labeled.select("doc_id", "clean_text"), "texts")
    w = F.col("w")
    every = rows.select(F.explode(L.tokens(F.col("clean_text"))).alias("w")).distinct()
    inner = lambda c: F.concat(F.lit("##"), c).alias("piece")
    single = v.spark.createDataFrame([(f"##{c}",) for c in "aeinorst"], "piece string")
    vocabulary = every.select(F.substring(w, 1, 3).alias("piece")).union(every.where(F.length(w) >= 5).select(inner(F.substring(w, 4, 2)))).union(every.where(F.length(w) <= 2).select(inner(w))).union(single)
    found = encode(rows, written(vocabulary.distinct(), "vocabulary"))
    return found.select("doc_id", F.aggregate("attention_mask", F.lit(0), lambda t, x: t + x).cast("bigint").alias("attended"), F.md5(F.array_join("input_pieces", " ")).alias("input_hash"))


def _labelled(v):
    return valid_labels(v.labeled).select("doc_id", "id_str", "clean_text", "label")


def _quota(rows: str) -> str:
    return _QUOTA.replace("FROM valid", f"FROM {rows}").replace("counts", f"counts_{rows}").replace("wanted", f"wanted_{rows}").replace("exact", f"exact_{rows}").replace("quota AS", f"quota_{rows} AS")


def _halves(rows: str) -> str:
    """``split_<rows>``: the rows with their words, slots and part of the split."""
    return f"""{_quota(rows)},
      split_{rows} AS (
        SELECT p.doc_id, p.label, p.words, len(p.words) AS n, CASE WHEN place <= q THEN 'validation' ELSE 'train' END AS split
        FROM (SELECT doc_id, label, {_WORDS} AS words, row_number() OVER (
            PARTITION BY label ORDER BY md5(concat(id_str, '|42'))) AS place FROM {rows}) p
          JOIN quota_{rows} q ON q.label = p.label)"""


_SLOT = f"cast(concat('0x', substr(md5(w), 1, 7)) AS bigint) % {FEATURES}"


def _chances(rows: str, weights: str) -> str:
    """``chance_<rows>``: doc_id, label and the probabilities of the classes by ``weights`` and its biases (slot -1)."""
    summed = ", ".join(f"coalesce(sum(t.w{c}), 0) / sqrt(greatest(any_value(r.n), 1)) + any_value(b.w{c}) AS x{c}" for c in range(3))
    powers = " + ".join(f"exp(x{c})" for c in range(3))
    return f"""terms_{rows} AS (SELECT doc_id, {_SLOT} AS slot FROM (SELECT doc_id, unnest(words) AS w FROM {rows})),
      chance_{rows} AS (SELECT doc_id, label, {", ".join(f"exp(x{c}) / ({powers}) AS p{c}" for c in range(3))} FROM (
        SELECT r.doc_id, any_value(r.label) AS label, {summed}
        FROM {rows} r LEFT JOIN terms_{rows} s ON s.doc_id = r.doc_id LEFT JOIN {weights} t ON t.slot = s.slot
          CROSS JOIN (SELECT * FROM {weights} WHERE slot = -1) b GROUP BY r.doc_id))"""


def _gradient(rows: str) -> str:
    """``gradient_<rows>``: mean gradient per slot, biases at slot -1, from the chances of the rows."""
    error = ", ".join(f"(c.p{k} - CASE WHEN c.label = {k} THEN 1 ELSE 0 END) AS e{k}" for k in range(3))
    return f"""error_{rows} AS (SELECT doc_id, {error} FROM chance_{rows} c),
      gradient_{rows} AS (
        SELECT slot, {", ".join(f"sum(e{k} / sqrt(n)) / (SELECT count(*) FROM {rows}) AS g{k}" for k in range(3))}
        FROM terms_{rows} t JOIN error_{rows} e ON e.doc_id = t.doc_id JOIN {rows} r ON r.doc_id = t.doc_id GROUP BY slot
        UNION ALL SELECT -1, {", ".join(f"avg(e{k})" for k in range(3))} FROM error_{rows})"""


_NONE = "zero AS (SELECT -1 AS slot, 0.0 AS w0, 0.0 AS w1, 0.0 AS w2)"


def _first_step(rows: str) -> str:
    """``first``: the coefficients after one step from zero over the train rows."""
    return f"""{_halves(rows)},
      {_NONE}, train_{rows} AS (SELECT * FROM split_{rows} WHERE split = 'train'),
      {_chances(f"train_{rows}", "zero")},
      {_gradient(f"train_{rows}")},
      first AS (SELECT slot, {", ".join(f"{-RATE} * g{k} AS w{k}" for k in range(3))} FROM gradient_train_{rows})"""


#: One step over all train rows, which SQL can follow.
RATE, DECAY, FROZEN = 3.0, 0.001, 6
ONE_STEP = {"epochs": 1, "batch_size": 1 << 40, "learning_rate": RATE, "weight_decay": DECAY, "freeze_layers": FROZEN}


@query("train_classifier", "valid", f"""
    WITH {_first_step("valid")},
      judged AS (SELECT * FROM split_valid WHERE split = 'validation'),
      {_chances("judged", "first")}
    SELECT label, (SELECT count(*) FROM train_valid t WHERE t.label = c.label) AS train_rows, count(*) AS judged_rows,
      count(*) FILTER (list_position([p0, p1, p2], greatest(p0, p1, p2)) - 1 = label) AS hits,
      {rnd("sum(-ln([p0, p1, p2][label + 1]))", 6)} AS loss
    FROM chance_judged c GROUP BY label""")
def train_classifier(v):
    """Fit on the train rows, judge on the validation rows: rows, hits and log losses per class."""
    train_rows, validation_rows = split_rows(_labelled(v), ["id_str"])
    model = fit(train_rows, **ONE_STEP).model
    pairs = written(evaluate(model, validation_rows), "pairs")
    hits = F.coalesce(F.sum(F.when(F.col("y") == F.col("yhat"), F.col("n"))), F.lit(0))
    judged = pairs.groupBy(F.col("y").cast("bigint").alias("label")).agg(
        F.sum("n").alias("judged_rows"), hits.alias("hits"), round_numeric(F.sum("loss"), 6).alias("loss")
    )
    learned = train_rows.groupBy(F.col("label").cast("bigint").alias("label")).agg(F.count(F.lit(1)).alias("train_rows"))
    return learned.join(judged, "label").select("label", "train_rows", "judged_rows", "hits", "loss")


_LAYER = f"CASE WHEN slot < 0 THEN -1 ELSE slot * {LAYERS} // {FEATURES} END"


def _digest(weights: str, kind: str, frozen: int) -> str:
    return f"""SELECT '{kind}' AS is_incremental, '{frozen}' AS freeze_layers, 'accepted' AS model_status, cast({_LAYER} AS int) AS layer, class,
      {rnd("sum(weight)", 6)} AS total, {rnd("sum(abs(weight))", 6)} AS size
      FROM (SELECT slot, unnest([0, 1, 2]) AS class, unnest([w0, w1, w2]) AS weight FROM {weights}) GROUP BY ALL"""


@query("train_incremental", "valid documents", f"""
    WITH older AS (SELECT v.* FROM valid v JOIN documents d ON d.doc_id = v.doc_id WHERE lang = 'en'),
      newer AS (SELECT v.* FROM valid v JOIN documents d ON d.doc_id = v.doc_id WHERE lang IS DISTINCT FROM 'en'),
      {_first_step("older")},
      {_halves("newer")}, train_newer AS (SELECT * FROM split_newer WHERE split = 'train'),
      {_chances("train_newer", "first")},
      {_gradient("train_newer")},
      second AS (
        SELECT slot, {", ".join(f"""CASE WHEN slot < 0 THEN w{k} - {RATE} * g{k} WHEN {_LAYER} < {FROZEN} THEN w{k}
          ELSE w{k} * (1 - {RATE} * {DECAY}) - {RATE} * g{k} END AS w{k}""" for k in range(3))}
        FROM (SELECT coalesce(f.slot, g.slot) AS slot, {", ".join(f"coalesce(w{k}, 0) AS w{k}, coalesce(g{k}, 0) AS g{k}" for k in range(3))}
          FROM first f FULL JOIN gradient_train_newer g ON g.slot = f.slot))
    {_digest("first", "False", 0)}
    UNION ALL {_digest("second", "True", FROZEN)}""")
def train_incremental(v):
    """Two sets in turn: the second run starts from the coefficients of the first and reads the second set only.

    Per run, layer of slots and class: the sum of the saved coefficients and of their sizes.
    """
    rows = _labelled(v).join(v.documents.select("doc_id", "lang"), "doc_id")
    older = rows.where(F.col("lang") == "en").drop("lang")
    newer = rows.where(~F.col("lang").eqNullSafe("en")).drop("lang")
    folder, models = work_path(v.spark, "runs"), work_path(v.spark, "models")
    runs = [train(v.spark, part, ["id_str"], RUNS_AS_OF, folder, models, threshold=0.0, params=ONE_STEP) for part in (older, newer)]
    logged = {t: v.spark.read.parquet(f"{folder}/{t}") for t in ("params", "tags")}
    sides = pivot_keys(logged["params"], ["is_incremental", "freeze_layers"]).join(pivot_keys(logged["tags"], ["model_status"]), "run_uuid")
    saved = [v.spark.read.parquet(f"{models}/{run.run_uuid}/coefficients").withColumn("run_uuid", F.lit(run.run_uuid)) for run in runs]
    place = F.when(F.col("slot") < 0, -1).otherwise(F.expr(f"slot * {LAYERS} div {FEATURES}")).cast("int")
    found = saved[0].unionByName(saved[1]).groupBy("run_uuid", place.alias("layer"), "class")
    sums = found.agg(round_numeric(F.sum("weight"), 6).alias("total"), round_numeric(F.sum(F.abs("weight")), 6).alias("size"))
    return sums.join(sides, "run_uuid").select("is_incremental", "freeze_layers", "model_status", "layer", "class", "total", "size")


@query("model_gate", "metrics", """
    SELECT run_uuid, max(CASE WHEN key = 'eval_f1_macro' THEN value END) AS eval_f1_macro,
      CASE WHEN coalesce(max(CASE WHEN key = 'eval_f1_macro' THEN value END), 0) >= 0.8
        THEN 'True' ELSE 'False' END AS model_accepted,
      CASE WHEN coalesce(max(CASE WHEN key = 'eval_f1_macro' THEN value END), 0) >= 0.8
        THEN 'accepted' ELSE 'rejected' END AS model_status
    FROM metrics WHERE key IN ('eval_f1_macro', 'eval_accuracy') GROUP BY run_uuid""")
def model_gate(v):
    scores = pivot_keys(v.metrics, ["eval_f1_macro", "eval_accuracy"]).drop("eval_accuracy")
    return R.gate(scores)


@query("run_log", "metrics", """
    SELECT run_uuid, key, max(value) AS value FROM metrics
    WHERE key IN ('eval_accuracy', 'eval_f1_macro', 'eval_loss') GROUP BY run_uuid, key""")
def run_log(v):
    keys = ["eval_accuracy", "eval_f1_macro", "eval_loss"]
    return R.key_values(pivot_keys(v.metrics, keys), {k: k for k in keys}, "double")


_SCORED = """SELECT concat('v', vec_id) AS id_str,
      concat('LABEL_', list_position(logits, list_max(logits)) - 1) AS hf_label,
      ['negative', 'neutral', 'positive'][list_position(logits, list_max(logits))] AS pred_label,
      1 / list_sum([exp(cast(x AS double) - list_max(logits)) for x in logits]) AS pred_score,
      md5(text) AS text_hash
    FROM worded"""


@query("score_batch", "worded", f"""
    SELECT id_str, hf_label, pred_label, {rnd('pred_score', 8)} AS pred_score, text_hash FROM ({_SCORED})""")
def score_batch(v):
    texts = v.worded.select(
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id_str"), "text", "logits"
    )
    scored = L.score_batch(texts, L.logits_scorer())
    return scored.select(
        "id_str",
        "hf_label",
        "pred_label",
        round_numeric(F.col("pred_score"), 8).alias("pred_score"),
        F.md5("text").alias("text_hash"),
    )


@query("score_documents", "valid documents", f"""
    WITH {_first_step("valid")},
      texts AS (SELECT doc_id, 0 AS label, {_WORDS.replace("clean_text", "coalesce(text, '')")} AS words FROM documents),
      scored AS (SELECT *, len(words) AS n FROM texts),
      {_chances("scored", "first")}
    SELECT doc_id, ['negative', 'neutral', 'positive'][list_position([p0, p1, p2], greatest(p0, p1, p2))] AS pred_label,
      {rnd("greatest(p0, p1, p2)", 6)} AS pred_score FROM chance_scored""")
def score_documents(v):
    """Every document scored by a model fitted on the train rows of the labelled ones."""
    model = replace(fit(split_rows(_labelled(v), ["id_str"])[0], **ONE_STEP).model, text="text")
    return L.score_batch(v.documents, L.model_scorer(model)).select(
        "doc_id", "pred_label", round_numeric(F.col("pred_score"), 6).alias("pred_score")
    )


_CLASSES = """
    classes AS (
      SELECT class, sum(hit) AS hits, sum(true_one) AS support, sum(pred_one) AS predicted FROM (
        SELECT y AS class, CASE WHEN y = yhat THEN 1 ELSE 0 END AS hit, 1 AS true_one, 0 AS pred_one
        FROM pairs UNION ALL SELECT yhat, 0, 0, 1 FROM pairs) GROUP BY class),
    scores AS (
      SELECT class, support, hits,
        CASE WHEN predicted = 0 THEN 0 ELSE cast(hits AS double) / predicted END AS precision,
        CASE WHEN support = 0 THEN 0 ELSE cast(hits AS double) / support END AS recall,
        CASE WHEN support + predicted = 0 THEN 0
          ELSE cast(2 * hits AS double) / (support + predicted) END AS f1
      FROM classes)"""


def _w(c: str) -> str:
    return f"sum({c} * support) / sum(support)"


_ACC = "cast(sum(hits) AS double) / sum(support)"


@query("metrics_basic", "pairs", f"""
    WITH {_CLASSES}
    SELECT {rnd(_ACC, 6)} AS accuracy, {rnd('avg(f1)', 6)} AS f1_macro,
      {rnd(_w('precision'), 6)} AS precision, {rnd(_w('recall'), 6)} AS recall,
      {rnd(_w('f1'), 6)} AS f1_score FROM scores""")
def metrics_basic(v):
    return E.basic_metrics(E.pair_counts(v.pairs, "y", "yhat"))


@query("class_report", "pairs", f"""
    WITH {_CLASSES},
    rows AS (
      SELECT cast(class AS varchar) AS class, precision, recall, f1, cast(support AS double) AS support
      FROM scores
      UNION ALL SELECT 'accuracy', {_ACC}, {_ACC}, {_ACC}, {_ACC} FROM scores
      UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM scores
      UNION ALL SELECT 'weighted avg', {_w('precision')}, {_w('recall')}, {_w('f1')}, sum(support)
      FROM scores)
    SELECT class, {rnd('precision', 6)} AS precision, {rnd('recall', 6)} AS recall,
      {rnd('f1', 6)} AS f1_score, {rnd('support', 6)} AS support FROM rows""")
def class_report(v):
    return E.class_report(E.pair_counts(v.pairs, "y", "yhat"))


@query("confusion", "pairs", "SELECT y AS true_label, " + ", ".join(
    f"cast(sum(CASE WHEN yhat = {c} THEN 1 ELSE 0 END) AS bigint) AS pred_{c}" for c in (0, 1, 2)
) + " FROM pairs GROUP BY y")
def confusion(v):
    return E.confusion_matrix(E.pair_counts(v.pairs, "y", "yhat"), (0, 1, 2))


@query("confusion_counts", "pairs", """
    WITH classes AS (SELECT y AS c FROM pairs UNION SELECT yhat FROM pairs)
    SELECT a.c AS true_label, b.c AS pred_label,
      (SELECT count(*) FROM pairs WHERE y = a.c AND yhat = b.c) AS n
    FROM classes a CROSS JOIN classes b""")
def confusion_counts(v):
    return E.confusion_counts(E.pair_counts(v.pairs, "y", "yhat"))


_NEWEST = f"""SELECT r.run_uuid FROM runs r JOIN experiments e ON r.experiment_id = e.experiment_id
    {{join}} WHERE e.name = '{EXPERIMENT}' AND r.deleted_time IS NULL
    ORDER BY r.start_time DESC NULLS FIRST, r.run_uuid LIMIT 1"""


@query("pick_model_latest", "runs experiments artifacts", f"""
    SELECT 'newest' AS rule, n.run_uuid, concat('runs:/', n.run_uuid, '/model') AS model_uri
    FROM ({_NEWEST.format(join='')}) n JOIN artifacts a ON a.run_uuid = n.run_uuid AND a.path = 'model'
    UNION ALL
    SELECT 'fallback' AS rule, n.run_uuid, concat('runs:/', n.run_uuid, '/model') AS model_uri
    FROM ({_NEWEST.format(join="JOIN artifacts a ON a.run_uuid = r.run_uuid AND a.path = 'model'")}) n""")
def pick_model_latest(v):
    def pick(rule, fallback):
        return R.pick_latest_model(
            v.runs, v.experiments, v.artifacts, EXPERIMENT, fallback
        ).withColumn("rule", F.lit(rule))

    return pick("newest", False).unionByName(pick("fallback", True))


@query("pick_model_stage", "versions", """
    SELECT model_name, version, stage, run_uuid FROM (
      SELECT *, row_number() OVER (PARTITION BY model_name
        ORDER BY CASE stage WHEN 'Production' THEN 0 ELSE 1 END, version DESC) AS place
      FROM versions WHERE stage IN ('Production', 'Staging')) WHERE place = 1""")
def pick_model_stage(v):
    return R.pick_stage_model(v.versions)


@query("register_version", "versions", """
    SELECT model_name, max(version) + 1 AS version, 'Staging' AS stage, 'run_new' AS run_uuid
    FROM versions GROUP BY model_name
    UNION ALL SELECT model_name, version, stage, run_uuid FROM versions""")
def register_version(v):
    new = v.versions.select("model_name").distinct().select(
        "model_name", F.lit("Staging").alias("stage"), F.lit("run_new").alias("run_uuid")
    )
    return R.register_versions(v.versions, new).unionByName(v.versions)
