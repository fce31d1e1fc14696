"""Projection, filters, joins, aggregates, windows, order, sets and scalar functions."""

from pyspark.sql import functions as F

from contract.reports import BANDS, SENTIMENT, _avg, _cases
from contract.sqltext import pct, rnd, runs_of, since
from contract.views import AS_OF, EXPERIMENT, query
from murmurate.functions import scalar as S
from murmurate.operators import aggregates as A
from murmurate.operators import rows as O
from murmurate.operators.graph import reply_edges
from murmurate.operators.joins import left_join_many, rows_of
from murmurate.operators.quality import check_dataset
from murmurate.operators.runs import latest_runs
from murmurate.plans.run_reports import active_runs
from murmurate.schemas import POST_FIELDS, SCORING_REQUEST
from murmurate.session import work_path
from murmurate.sources.keyword_index import indexed_search, write_index

# --- projection, filter, constraint ------------------------------------------


@query("project_fields", "posts", f"SELECT {', '.join(POST_FIELDS)} FROM posts")
def project_fields(v):
    return O.project_fields(v.posts.withColumn("extra", F.lit(1)))


@query("sorted_columns", "predictions", """
    SELECT concat('lang,pred_label,predicted_at,username') AS column_order, lang, pred_label,
      predicted_at, username FROM predictions""")
def sorted_columns(v):
    df = O.sorted_columns(v.predictions.select("username", "predicted_at", "lang", "pred_label"))
    return df.withColumn("column_order", F.lit(",".join(df.columns)))


@query("derive_tweet_columns", "posts", """
    SELECT id_str, username,
      CASE WHEN username IS NOT NULL
        THEN 'https://x.com/' || username || '/status/' || id_str END AS tweet_url,
      coalesce(image_url, '') AS image_url, coalesce(location, '') AS location,
      coalesce(in_reply_to_screen_name, '') AS in_reply_to_screen_name
    FROM posts""")
def derive_tweet_columns(v):
    picture = F.struct(F.col("image_url").alias("media_url_https"))
    raw = v.posts.select(
        "id_str",
        F.col("username").alias("screen_name"),
        F.when(F.col("image_url").isNotNull(), F.array(picture)).otherwise(
            F.array().cast("array<struct<media_url_https:string>>")
        ).alias("media"),
        F.col("location").alias("profile_location"),
        F.col("in_reply_to_screen_name").alias("reply_to"),
    )
    return O.derive_post_columns(raw)


@query("lang_filter", "posts", "SELECT id_str, lang FROM posts WHERE lang IN ('in', 'id')")
def lang_filter(v):
    return O.keep_languages(v.posts).select("id_str", "lang")


@query("require_columns", "labeled", """
    SELECT 'label' AS dropped, 'missing required columns: label' AS message, count(*) AS rows
    FROM labeled""")
def require_columns(v):
    try:
        O.require_columns(v.labeled.drop("label"), ["clean_text", "label"])
        message = "none"
    except ValueError as e:
        message = str(e)
    return O.require_columns(v.labeled, ["clean_text", "label"]).agg(
        F.lit("label").alias("dropped"), F.lit(message).alias("message"),
        F.count(F.lit(1)).alias("rows"),
    )


@query("drop_missing", "labeled", """
    SELECT doc_id, label FROM labeled WHERE label IS NOT NULL AND clean_text IS NOT NULL""")
def drop_missing(v):
    return O.drop_missing(v.labeled, ["clean_text", "label"]).select("doc_id", "label")


@query("valid_labels", "valid", "SELECT doc_id, label FROM valid")
def valid_labels(v):
    return O.valid_labels(v.labeled).select("doc_id", "label")


@query("either_present", "posts", """
    SELECT id_str, username, in_reply_to_screen_name FROM posts
    WHERE coalesce(username, '') <> '' OR coalesce(in_reply_to_screen_name, '') <> ''""")
def either_present(v):
    return O.either_filled(v.posts, "username", "in_reply_to_screen_name").select(
        "id_str", "username", "in_reply_to_screen_name"
    )


@query("recent_filter", "predictions", " UNION ALL ".join(
    f"SELECT '{w}' AS width, count(*) AS rows, min(predicted_at) AS first FROM predictions WHERE {since(w)}"
    for w in ("24 hours", "7 days", "30 days")))
def recent_filter(v):
    out = None
    for width in ("24 hours", "7 days", "30 days"):
        one = O.recent(v.predictions, "predicted_at", AS_OF, width).agg(
            F.lit(width).alias("width"), F.count(F.lit(1)).alias("rows"),
            F.min("predicted_at").alias("first"),
        )
        out = one if out is None else out.unionByName(one)
    return out


@query("key_predicates", "runs params", """
    SELECT r.run_uuid, p.key, p.value FROM runs r JOIN params p ON r.run_uuid = p.run_uuid
    WHERE r.deleted_time IS NULL AND r.end_time IS NOT NULL AND r.experiment_id = 2
      AND p.key IN ('epochs', 'batch_size')""")
def key_predicates(v):
    runs = v.runs.where(
        F.col("deleted_time").isNull()
        & F.col("end_time").isNotNull()
        & (F.col("experiment_id") == 2)
    )
    params = v.params.where(F.col("key").isin("epochs", "batch_size"))
    return runs.join(params, "run_uuid").select("run_uuid", "key", "value")


_CREATED = """CASE WHEN regexp_matches(created_at, '^[A-Z][a-z]{2} ')
      THEN cast(try_strptime(created_at, '%a %b %d %H:%M:%S %z %Y') AS timestamp) END"""


@query("keyword_search", "posts", f"""
    SELECT id_str, created_at FROM posts
    WHERE contains(lower(full_text), 'halo') AND contains(lower(full_text), '@budi')
      AND {_CREATED} >= timestamp '2024-01-05' AND {_CREATED} < timestamp '2024-01-20'""")
def keyword_search(v):
    posts = v.posts.withColumn("at", S.parse_created_at(F.col("created_at")))
    return O.keyword_search(
        posts, ["Halo", "@budi"], since="05-01-2024", until="20-01-2024 10:00", at="at"
    ).select("id_str", "created_at")


@query("keyword_search_indexed", "posts", f"""
    SELECT id_str, created_at FROM posts
    WHERE contains(lower(full_text), 'halo') AND contains(lower(full_text), '@budi')
      AND {_CREATED} >= timestamp '2024-01-05' AND {_CREATED} < timestamp '2024-01-20'""")
def keyword_search_indexed(v):
    posts = v.posts.withColumn("at", S.parse_created_at(F.col("created_at")))
    path = work_path(v.spark, "index")
    write_index(posts, path, at="at")
    return indexed_search(posts, path, ["Halo", "@budi"], since="05-01-2024", until="20-01-2024 10:00", at="at").select("id_str", "created_at")


@query("add_label_column", "posts", "SELECT id_str, '' AS label FROM posts")
def add_label_column(v):
    return O.add_label_column(v.posts.select("id_str"))


_GOOD = "event_id % 7 <> 0 AND event_id % 9 <> 0 AND event_id % 10 <> 0"


@query("typed_record", "predictions", f"""
    SELECT event_id, {_GOOD} AS accepted, CASE WHEN {_GOOD} THEN favorite_count END AS favorite_count,
      CASE WHEN {_GOOD} THEN CASE WHEN event_id % 2 = 0 THEN quote_count ELSE coalesce(quote_count, 0) END END AS quote_count
    FROM predictions""")
def typed_record(v):
    number = F.col("event_id")
    fields = F.struct(
        F.when(number % 10 != 0, F.col("id_str")).alias("id_str"),
        F.col("clean_text"),
        F.when(number % 9 == 0, "banyak")
        .otherwise(F.col("favorite_count").cast("string"))
        .alias("favorite_count"),
        F.col("quote_count"),
    )
    # every other body names the fields that are null
    body = F.when(number % 2 == 0, F.to_json(fields, {"ignoreNullFields": "false"})).otherwise(F.to_json(fields))
    body = F.when(number % 7 == 0, F.concat(F.lit("no json "), body)).otherwise(body)
    ok = F.col("accepted")
    return O.typed_requests(v.texted.select("event_id", body.alias("body"))).select(
        "event_id",
        "accepted",
        F.when(ok, F.col("favorite_count")).alias("favorite_count"),
        F.when(ok, F.col("quote_count")).alias("quote_count"),
    )


@query("row_constraints", "texted", """
    SELECT reason, count(*) AS rows FROM (
      SELECT CASE WHEN event_id % 12 = 0 THEN 'clean_text is null'
        WHEN event_id % 14 = 0 THEN 'pred_score outside 0..1'
        WHEN event_id % 16 = 0 THEN 'username longer than 100' ELSE 'accepted' END AS reason
      FROM texted) GROUP BY reason""")
def row_constraints(v):
    number = F.col("event_id")
    df = v.texted.withColumns(
        {
            "clean_text": F.when(number % 12 != 0, F.col("clean_text")),
            "pred_score": F.when((number % 14 == 0) & (number % 12 != 0), 1.5).otherwise(
                F.col("pred_score")
            ),
            "username": F.when(
                (number % 16 == 0) & (number % 12 != 0) & (number % 14 != 0), F.repeat(F.lit("u"), 101)
            ).otherwise(F.col("username")),
        }
    )
    accepted, rejected = O.split_accepted(df)
    return A.value_counts(
        rejected.select(F.explode("reasons").alias("reason")), "reason", name="rows"
    ).unionByName(
        accepted.agg(F.lit("accepted").alias("reason"), F.count(F.lit(1)).alias("rows"))
    )


@query("with_default", "predictions", """
    SELECT id_str, username, quote_count, favorite_count,
      cast(NULL AS varchar) AS location, cast(0 AS bigint) AS retweet_count
    FROM predictions""")
def with_default(v):
    p = v.predictions.select("id_str", "username", "quote_count", "favorite_count")
    return O.with_defaults(p, SCORING_REQUEST).select(
        "id_str", "username", "quote_count", "favorite_count", "location", "retweet_count"
    )


# --- joins --------------------------------------------------------------------


@query("join_inner", "runs experiments", f"SELECT r.run_uuid, e.name {runs_of()}")
def join_inner(v):
    return active_runs(v.runs_tables, EXPERIMENT).select(
        "run_uuid", F.lit(EXPERIMENT).alias("name")
    )


@query("join_one_to_many", "runs experiments metrics params", f"""
    SELECT 'metrics' AS side, count(*) AS rows {runs_of('JOIN metrics m ON r.run_uuid = m.run_uuid')}
    UNION ALL
    SELECT 'params' AS side, count(*) AS rows {runs_of('JOIN params p ON r.run_uuid = p.run_uuid')}""")
def join_one_to_many(v):
    runs = active_runs(v.runs_tables, EXPERIMENT).select("run_uuid")

    def size(side):
        return runs.join(v.view(side).select("run_uuid"), "run_uuid").agg(
            F.lit(side).alias("side"), F.count(F.lit(1)).alias("rows")
        )

    return size("metrics").unionByName(size("params"))


def _max(side: str, key: str) -> str:
    return f"max({side}.value) FILTER (WHERE {side}.key = '{key}')"


_SIDES = ("LEFT JOIN metrics m ON r.run_uuid = m.run_uuid "
          "LEFT JOIN params p ON r.run_uuid = p.run_uuid "
          "LEFT JOIN tags t ON r.run_uuid = t.run_uuid")


def _sides(v):
    t = v.runs_tables
    out = runs = active_runs(t, EXPERIMENT).select("run_uuid")
    for table, keys in (
        ("metrics", ["eval_f1_macro", "eval_loss"]),
        ("params", ["epochs", "learning_rate"]),
        ("tags", ["model_status"]),
    ):
        out = out.join(A.pivot_keys(rows_of(t[table], runs), keys), "run_uuid", "left")
    return out


@query("join_left_eav", "runs experiments metrics params tags", f"""
    SELECT r.run_uuid, {_max('m', 'eval_f1_macro')} AS eval_f1_macro,
      {_max('m', 'eval_loss')} AS eval_loss, {_max('p', 'epochs')} AS epochs,
      {_max('p', 'learning_rate')} AS learning_rate, {_max('t', 'model_status')} AS model_status
    {runs_of(_SIDES)} GROUP BY r.run_uuid""")
def join_left_eav(v):
    return _sides(v)


@query("join_left_on_predicate", "runs experiments metrics", f"""
    SELECT r.run_uuid, m.value AS f1
    {runs_of("LEFT JOIN metrics m ON r.run_uuid = m.run_uuid AND m.key = 'eval_f1_macro'")}""")
def join_left_on_predicate(v):
    scores = v.metrics.where(F.col("key") == "eval_f1_macro").select(
        "run_uuid", F.col("value").alias("f1")
    )
    return left_join_many(
        active_runs(v.runs_tables, EXPERIMENT).select("run_uuid"), scores, "run_uuid"
    )


@query("join_fanout", "runs experiments metrics params tags", f"""
    SELECT r.run_uuid, count(DISTINCT m.value) AS metric_values,
      count(DISTINCT p.key) AS param_keys, count(DISTINCT t.key) AS tag_keys
    {runs_of(_SIDES)} GROUP BY r.run_uuid""")
def join_fanout(v):
    t = v.runs_tables
    out = runs = active_runs(t, EXPERIMENT).select("run_uuid")
    for table, column, name in (
        ("metrics", "value", "metric_values"),
        ("params", "key", "param_keys"),
        ("tags", "key", "tag_keys"),
    ):
        counted = rows_of(t[table], runs).groupBy("run_uuid").agg(F.count_distinct(column).alias(name))
        out = out.join(counted, "run_uuid", "left")
    return out.na.fill(0)


@query("label_map", "predictions", """
    SELECT id_str, CASE WHEN event_id % 9 = 0 THEN 'LABEL_7' ELSE hf_label END AS hf_label,
      CASE WHEN event_id % 9 = 0 THEN 'LABEL_7' ELSE pred_label END AS label
    FROM predictions""")
def label_map(v):
    p = v.predictions.select(
        "id_str",
        F.when(F.col("event_id") % 9 == 0, "LABEL_7").otherwise(F.col("hf_label")).alias("hf_label"),
    )
    return p.withColumn("label", S.label_name(F.col("hf_label")))


# --- aggregates ---------------------------------------------------------------


@query("agg_count", "predictions", """
    SELECT pred_label, lang, count(*) AS n FROM predictions GROUP BY pred_label, lang""")
def agg_count(v):
    return A.value_counts(v.predictions, "pred_label", "lang", name="n")


@query("agg_count_distinct", "predictions", """
    SELECT pred_label, count(DISTINCT username) AS users FROM predictions GROUP BY pred_label""")
def agg_count_distinct(v):
    return v.predictions.groupBy("pred_label").agg(F.count_distinct("username").alias("users"))


@query("agg_users_sketch", "predictions", """
    WITH seen AS (SELECT DISTINCT cast(predicted_at AS date) AS day, username FROM predictions)
    SELECT d.day, count(DISTINCT s.username) AS users
    FROM (SELECT DISTINCT day FROM seen) d JOIN seen s ON s.day <= d.day AND s.day > d.day - 7 GROUP BY d.day""")
def agg_users_sketch(v):
    """Users of the week up to each day from daily sketches; a few hundred users are counted exactly by a sketch."""
    return A.rolling_distinct(A.daily_sketches(v.predictions, "username"), 7)


@query("agg_avg_min_max", "predictions", f"""
    SELECT lang, {rnd('avg(pred_score)', 4)} AS mean, min(pred_score) AS low, max(pred_score) AS high,
      {rnd('avg(retweet_count)', 2)} AS mean_retweets
    FROM predictions GROUP BY lang""")
def agg_avg_min_max(v):
    return v.predictions.groupBy("lang").agg(
        S.round_numeric(F.avg("pred_score"), 4).alias("mean"),
        F.min("pred_score").alias("low"),
        F.max("pred_score").alias("high"),
        S.round_numeric(F.avg("retweet_count"), 2).alias("mean_retweets"),
    )


@query("agg_sum", "predictions", f"""
    SELECT username, {_cases('_count')}, cast(sum(favorite_count) AS bigint) AS favorites,
      cast(sum(favorite_count + retweet_count + reply_count + quote_count) AS bigint) AS engagement
    FROM predictions GROUP BY username""")
def agg_sum(v):
    total = sum((F.col(c) for c in ("retweet_count", "reply_count", "quote_count")), F.col("favorite_count"))
    return v.predictions.groupBy("username").agg(
        *[
            F.count_if(F.col("pred_label") == x).alias(f"{x}_count")
            for x in ("positive", "negative", "neutral")
        ],
        F.sum("favorite_count").alias("favorites"),
        F.sum(total).alias("engagement"),
    )


@query("agg_pivot", "metrics", f"""
    SELECT run_uuid, {', '.join(f"{_max('metrics', k)} AS {k}" for k in
                                ('eval_accuracy', 'eval_f1_macro', 'eval_loss'))}
    FROM metrics WHERE key IN ('eval_accuracy', 'eval_f1_macro', 'eval_loss') GROUP BY run_uuid""")
def agg_pivot(v):
    return A.pivot_keys(v.metrics, ["eval_accuracy", "eval_f1_macro", "eval_loss"])


@query("agg_conditional_avg", "metrics", f"""
    SELECT step, {_avg('eval_accuracy')} AS accuracy, {_avg('train_loss')} AS loss
    FROM metrics m GROUP BY step""")
def agg_conditional_avg(v):
    return v.metrics.groupBy("step").agg(
        A.average_of("eval_accuracy").alias("accuracy"), A.average_of("train_loss").alias("loss")
    )


@query("agg_having", "params", """
    SELECT key, value, count(*) AS n FROM params GROUP BY key, value HAVING key = 'is_incremental'""")
def agg_having(v):
    return A.value_counts(v.params, "key", "value", name="n").where(
        F.col("key") == "is_incremental"
    )


@query("agg_group_expr", "predictions", f"""
    SELECT cast(date_trunc('day', predicted_at) AS timestamp) AS day, {BANDS} AS band, count(*) AS n
    FROM predictions GROUP BY 1, 2""")
def agg_group_expr(v):
    return v.predictions.groupBy(
        S.trunc_time(v.predictions, "day", "predicted_at").alias("day"),
        S.confidence_band(F.col("pred_score")).alias("band"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("agg_global", "predictions", f"""
    SELECT count(*) AS rows, count(DISTINCT username) AS users,
      {rnd('avg(pred_score)', 4)} AS mean FROM predictions""")
def agg_global(v):
    return v.predictions.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("username").alias("users"),
        S.round_numeric(F.avg("pred_score"), 4).alias("mean"),
    )


@query("agg_scalar_subquery", "predictions", f"""
    SELECT {pct('count(*)', '(SELECT count(*) FROM predictions)')} AS percentage
    FROM predictions WHERE pred_label = 'negative'""")
def agg_scalar_subquery(v):
    return A.share_where(v.predictions, F.col("pred_label") == "negative")


@query("value_counts", "predictions", """
    SELECT pred_label, count(*) AS count FROM predictions GROUP BY pred_label""")
def value_counts(v):
    return A.value_counts(v.predictions, "pred_label")


def _with_errors(v):
    failed = F.col("event_id") % 21 == 0
    return v.predictions.withColumns(
        {
            "hf_label": F.when(failed, "error").otherwise(F.col("hf_label")),
            "pred_score": F.when(failed, 0.0).otherwise(F.col("pred_score")),
        }
    )


@query("batch_stats", "predictions", f"""
    SELECT count(*) AS total_predictions,
      cast(sum(CASE WHEN event_id % 21 = 0 THEN 1 ELSE 0 END) AS bigint) AS failed,
      {rnd('coalesce(avg(CASE WHEN event_id % 21 <> 0 AND pred_score > 0 THEN pred_score END), 0)', 4)}
        AS average_confidence_score,
      {rnd('avg(CASE WHEN event_id % 21 = 0 THEN 0 ELSE pred_score END)', 4)} AS mean_score
    FROM predictions""")
def batch_stats(v):
    return A.batch_stats(_with_errors(v))


@query("step_counts", "labeled", """
    SELECT count(*) AS rows_in, count(label) AS labelled,
      cast(sum(CASE WHEN label IN ('0', '1', '2.0') THEN 1 ELSE 0 END) AS bigint) AS in_range
    FROM labeled""")
def step_counts(v):
    label = O.as_label(F.col("label"))
    return A.step_counts(
        v.labeled, [("labelled", F.col("label").isNotNull()), ("in_range", label.isin(0, 1, 2))]
    )


@query("choose_best", "metrics", """
    SELECT CASE WHEN max(value) > 0.8 THEN 'accurate' ELSE 'inaccurate' END AS choice
    FROM metrics WHERE key = 'eval_accuracy'""")
def choose_best(v):
    return A.choose_best(v.metrics.where(F.col("key") == "eval_accuracy"), "value", 0.8)


# --- windows ------------------------------------------------------------------


@query("share_of_total", "predictions", f"""
    SELECT lang, count(*) AS count, {pct('count(*)', 'sum(count(*)) OVER ()')} AS percentage
    FROM predictions GROUP BY lang""")
def share_of_total(v):
    return A.share_of_total(A.value_counts(v.predictions, "lang"))


@query("share_within", "predictions", f"""
    SELECT pred_label, lang, count(*) AS count,
      {pct('count(*)', 'sum(count(*)) OVER (PARTITION BY pred_label)')} AS percentage
    FROM predictions GROUP BY pred_label, lang""")
def share_within(v):
    return A.share_of_total(
        A.value_counts(v.predictions, "pred_label", "lang"), within=["pred_label"]
    )


# --- order and limit ----------------------------------------------------------


@query("latest_one", "runs experiments", f"""
    SELECT r.run_uuid, r.start_time {runs_of()}
    ORDER BY r.start_time DESC NULLS FIRST, r.run_uuid LIMIT 1""")
def latest_one(v):
    return latest_runs(v.runs, v.experiments, EXPERIMENT).select("run_uuid", "start_time")


@query("top_n", "predictions", """
    SELECT username, count(*) AS n FROM predictions WHERE username IS NOT NULL
    GROUP BY username ORDER BY n DESC, username LIMIT 10""")
def top_n(v):
    counted = A.value_counts(v.predictions.where(F.col("username").isNotNull()), "username", name="n")
    return counted.orderBy(F.desc("n"), "username").limit(10)


@query("sort_multi", "predictions", """
    SELECT lang, pred_label, count(*) AS n FROM predictions GROUP BY lang, pred_label
    ORDER BY lang NULLS LAST, n DESC NULLS FIRST, pred_label""")
def sort_multi(v):
    return A.value_counts(v.predictions, "lang", "pred_label", name="n").orderBy(
        F.asc_nulls_last("lang"), F.desc_nulls_first("n"), "pred_label"
    )


@query("limit_target", "predictions", "SELECT least(count(*), 300) AS rows FROM predictions")
def limit_target(v):
    return v.predictions.limit(300).agg(F.count(F.lit(1)).alias("rows"))


# --- sets ---------------------------------------------------------------------


@query("union_weekly", "labeled posts", """
    SELECT id_str, label, NULL AS username FROM labeled
    UNION ALL SELECT id_str, NULL AS label, username FROM posts""")
def union_weekly(v):
    return v.labeled.select("label", "id_str").unionByName(
        v.posts.select("username", "id_str"), allowMissingColumns=True
    )


# --- scalar functions ---------------------------------------------------------


@query("fn_initcap", "predictions", f"SELECT id_str, {SENTIMENT} FROM predictions")
def fn_initcap(v):
    return v.predictions.select("id_str", S.initcap(F.col("pred_label")).alias("sentiment"))


@query("fn_left", "posts", "SELECT id_str, left(full_text, 100) AS preview FROM posts")
def fn_left(v):
    return v.posts.select("id_str", S.preview(F.col("full_text")).alias("preview"))


@query("fn_round_numeric", "predictions", f"""
    SELECT id_str, {rnd('value * 1.0005', 4)} AS r4, {rnd('-value * 1.0005', 2)} AS r2, value * 1e22 AS huge
    FROM (SELECT p.id_str, e.value FROM predictions p JOIN events e ON p.event_id = e.event_id)""")
def fn_round_numeric(v):
    value = F.col("value") * 1.0005
    return v.events.select(
        F.col("event_id").cast("string").alias("id_str"),
        S.round_numeric(value, 4).alias("r4"),
        S.round_numeric(-F.col("value") * 1.0005, 2).alias("r2"),
        S.round_numeric(F.col("value") * 1e22, 2).alias("huge"),
    )


@query("fn_case", "metrics params", """
    SELECT m.run_uuid, CASE WHEN m.value >= 0.80 THEN 'Accepted' ELSE 'Rejected' END AS status,
      CASE WHEN p.value = 'True' THEN 1 ELSE 0 END AS flag
    FROM metrics m JOIN params p ON m.run_uuid = p.run_uuid
    WHERE m.key = 'eval_f1_macro' AND p.key = 'model_accepted'""")
def fn_case(v):
    scores = v.metrics.where(F.col("key") == "eval_f1_macro")
    flags = v.params.where(F.col("key") == "model_accepted")
    return scores.select("run_uuid", S.accepted_text(F.col("value"), 0.80).alias("status")).join(
        flags.select("run_uuid", S.accepted_flag(F.col("value")).alias("flag")), "run_uuid"
    )


@query("fn_nullif", "predictions", """
    SELECT id_str, favorite_count / nullif(cast(reply_count AS double), 0) AS per_reply
    FROM predictions""")
def fn_nullif(v):
    replies = F.nullif(F.col("reply_count").cast("double"), F.lit(0.0))
    return v.predictions.select("id_str", (F.col("favorite_count") / replies).alias("per_reply"))


@query("fn_date_trunc", "predictions", """
    SELECT id_str, cast(date_trunc('day', predicted_at) AS timestamp) AS day,
      cast(date_trunc('hour', predicted_at) AS timestamp) AS hour FROM predictions""")
def fn_date_trunc(v):
    return v.predictions.select(
        "id_str",
        S.trunc_time(v.predictions, "day", "predicted_at").alias("day"),
        S.trunc_time(v.predictions, "hour", "predicted_at").alias("hour"),
    )


@query("fn_duration_min", "runs", f"""
    SELECT run_uuid, {rnd('cast(epoch_us(end_time) - epoch_us(start_time) AS double) / 6e7', 2)}
      AS minutes FROM runs""")
def fn_duration_min(v):
    return v.runs.select(
        "run_uuid", S.duration_minutes(F.col("start_time"), F.col("end_time")).alias("minutes")
    )


@query("fn_confidence_band", "predictions", f"SELECT id_str, {BANDS} AS band FROM predictions")
def fn_confidence_band(v):
    return v.predictions.select("id_str", S.confidence_band(F.col("pred_score")).alias("band"))


@query("fn_parse_created_at", "posts", f"SELECT id_str, {_CREATED} AS created FROM posts")
def fn_parse_created_at(v):
    return v.posts.select("id_str", S.parse_created_at(F.col("created_at")).alias("created"))


@query("fn_argmax", "pairs logits", """
    SELECT vec_id, cast(list_position(logits, list_max(logits)) - 1 AS int) AS best FROM logits""")
def fn_argmax(v):
    return v.logits.select("vec_id", S.argmax(F.col("logits")).alias("best"))


_TOP = "1 / list_sum([exp(cast(x AS double) - list_max(logits)) for x in logits])"


@query("fn_softmax_top1", "logits", f"""
    SELECT vec_id, concat('LABEL_', list_position(logits, list_max(logits)) - 1) AS hf_label,
      {rnd(_TOP, 8)} AS score FROM logits""")
def fn_softmax_top1(v):
    return v.logits.select(
        "vec_id",
        F.concat(F.lit("LABEL_"), S.argmax(F.col("logits")).cast("string")).alias("hf_label"),
        S.round_numeric(S.softmax_top(F.col("logits")), 8).alias("score"),
    )


_WORD = "split_part(full_text, ' ', 1)"
_NEEDLE = "'@' || in_reply_to_screen_name || ' '"


@query("fn_first_word", "posts", f"""
    WITH t AS (SELECT id_str, in_reply_to_screen_name,
        CASE length(id_str) % 2 WHEN 0 THEN '"' ELSE '' END
          || '@' || coalesce(in_reply_to_screen_name, 'x') || ' ' || full_text AS full_text
      FROM posts)
    SELECT id_str, {_WORD} AS word,
      CASE WHEN regexp_matches(full_text, '^[^ ]@') AND strpos(full_text, {_NEEDLE}) > 0
        THEN substr(full_text, 1, strpos(full_text, {_NEEDLE}) - 1)
          || substr(full_text, strpos(full_text, {_NEEDLE}) + length({_NEEDLE}))
        ELSE full_text END AS stripped
    FROM t""")
def fn_first_word(v):
    quote = F.when(F.length("id_str") % 2 == 0, '"').otherwise("")
    text = F.concat(
        quote, F.lit("@"), F.coalesce("in_reply_to_screen_name", F.lit("x")), F.lit(" "), "full_text"
    )
    return v.posts.withColumn("full_text", text).select(
        "id_str",
        S.first_word(F.col("full_text")).alias("word"),
        S.strip_reply(F.col("full_text"), F.col("in_reply_to_screen_name")).alias("stripped"),
    )


@query("fn_file_date", "labeled", """
    SELECT doc_id, CASE WHEN doc_id % 13 = 12 THEN NULL
      ELSE make_date(2024, 1, cast(1 + doc_id % 28 AS int)) END AS day FROM labeled""")
def fn_file_date(v):
    day = F.concat(F.lit("2024-1-"), (1 + F.col("doc_id") % 28).cast("string"))
    text = F.when(F.col("doc_id") % 13 == 12, "draft").otherwise(day)
    path = F.concat(F.lit("/x/labeled_"), text, F.lit(".csv"))
    return v.labeled.select("doc_id", S.file_day(path, "labeled_").alias("day"))


@query("fn_timestamp_name", "predictions", """
    SELECT pred_label, 'predictions_20240131_000000' AS name, count(*) AS n
    FROM predictions GROUP BY pred_label""")
def fn_timestamp_name(v):
    return A.value_counts(v.predictions, "pred_label", name="n").withColumn(
        "name", S.timestamp_name("predictions", AS_OF)
    )


@query("fn_text_length", "posts", "SELECT id_str, length(full_text) AS n FROM posts")
def fn_text_length(v):
    return v.posts.select("id_str", F.char_length("full_text").cast("bigint").alias("n"))


# --- graph and quality --------------------------------------------------------


@query("reply_edges", "posts", """
    SELECT coalesce(username, '') AS source, coalesce(in_reply_to_screen_name, '') AS target
    FROM posts WHERE username IS NOT NULL OR in_reply_to_screen_name IS NOT NULL""")
def reply_edges_query(v):
    return reply_edges(v.posts)


_CHECKS = {
    "exists": ("cast(1 AS bigint)", 1),
    "columns": ("cast(2 AS bigint)", 2),
    "no_null": ("cast(sum(CASE WHEN label IS NULL THEN 1 ELSE 0 END) AS bigint)", 0),
    "range": ("cast(sum(CASE WHEN label IN ('0', '1', '2.0') THEN 0 ELSE 1 END) AS bigint)", 0),
    "min_rows": ("count(*)", 100),
}


def _dq(name: str) -> None:
    observed, expected = _CHECKS[name]
    sign = ">=" if name == "min_rows" else "="

    @query(f"dq_{name}", "labeled", f"""
        SELECT '{name}' AS check, {observed} {sign} {expected} AS passed, {observed} AS observed,
          cast({expected} AS bigint) AS expected FROM labeled HAVING count(*) >= 0""")
    def dq(v):
        return check_dataset(
            v.spark, lambda: v.labeled.withColumn("label", O.as_label(F.col("label")))
        ).where(F.col("check") == name)


for _name in _CHECKS:
    _dq(_name)
