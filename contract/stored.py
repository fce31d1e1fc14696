"""Readers, writers, the store, and jobs made of them."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from contract.sqltext import cleaned, harvest_space, rnd
from contract.views import AS_OF, VIEWS, query

from murmurate.functions.scalar import clock, file_day, round_numeric

from murmurate.operators import evaluate as E
from murmurate.operators.learn import logits_scorer, score_posts
from murmurate.operators.rows import normalize_na, recent
from murmurate.operators.upsert import one_per_post, upsert
from murmurate.plans import prepare as P
from murmurate.plans.prepare import merge_week
from murmurate.plans.serve import prediction_records
from murmurate.schemas import POST
from murmurate.session import work_path, written
from murmurate.sources import csv as C
from murmurate.sources import timeline as TL
from murmurate.sources.store import PredictionStore, write_by_day
from murmurate.sources.tables import register, write_reports

_POST_COLUMNS = [f.name for f in POST.fields]
_POSTS = f"SELECT {', '.join(_POST_COLUMNS)} FROM posts"


@query("csv_scan", "posts", _POSTS)
def csv_scan(v):
    path = C.write_csv(v.posts.select(_POST_COLUMNS), work_path(v.spark, "scan"))
    return C.read_csv(v.spark, path, POST)


@query("csv_sink", "posts", """
    SELECT count(*) AS rows, count(lang) AS with_lang, cast(sum(length(full_text)) AS bigint) AS chars,
      cast(sum(CASE WHEN contains(full_text, chr(10)) THEN 1 ELSE 0 END) AS bigint) AS with_breaks
    FROM posts""")
def csv_sink(v):
    path = C.write_csv(v.posts, work_path(v.spark, "sink"))
    return C.read_csv(v.spark, path).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("lang").alias("with_lang"),
        F.sum(F.char_length("full_text")).alias("chars"),
        F.count_if(F.contains("full_text", F.lit("\n"))).alias("with_breaks"),
    )


@query("csv_append_sink", "posts", """
    SELECT id_str, username, full_text FROM posts
    UNION ALL SELECT id_str, username, lang AS full_text FROM posts""")
def csv_append_sink(v):
    columns = ["id_str", "username", "full_text"]
    path = work_path(v.spark, "append")
    first = v.posts.select(columns)
    again = v.posts.select("id_str", "username", F.col("lang").alias("full_text"))
    # A restarted writer puts its header in once more.
    header = v.spark.range(1).select([F.lit(c).alias(c) for c in columns])
    C.append_csv(first.unionByName(header), path)
    C.append_csv(again, path)
    return C.read_appended(v.spark, path)


@query("insert_mode", "posts", """
    SELECT 'current' AS version, count(*) AS rows FROM (
      SELECT id_str FROM posts UNION ALL SELECT id_str FROM posts WHERE lang IS NULL)
    UNION ALL SELECT 'old' AS version, count(*) AS rows FROM posts WHERE lang IS NOT NULL""")
def insert_mode(v):
    path = work_path(v.spark, "insert") + ".csv"
    posts = v.posts.select("id_str", "lang")
    C.insert_csv(posts.where("lang IS NOT NULL"), path, "REPLACE")
    C.insert_csv(posts, path, "REPLACE")
    C.insert_csv(posts.where("lang IS NULL"), path, "APPEND")

    def size(version, where):
        return C.read_csv(v.spark, where).agg(
            F.lit(version).alias("version"), F.count(F.lit(1)).alias("rows")
        )

    return size("current", path).unionByName(size("old", C.old_version(path)))


_PREFIX = "file=labeled_"


def _write_days(v) -> str:
    """Labelled rows as one folder per day, named as the daily files are."""
    folder = work_path(v.spark, "daily")
    day = F.date_sub(clock(AS_OF).cast("date"), (F.col("doc_id") % 12).cast("int"))
    name = F.concat(
        F.lit("labeled_"),
        F.when(F.col("doc_id") % 37 == 0, "draft").otherwise(F.date_format(day, "yyyy-MM-dd")),
        F.lit(".csv"),
    )
    v.labeled.withColumn("file", name).write.partitionBy("file").options(**C.WRITE_OPTIONS).csv(folder)
    return f"{folder}/file=labeled_*.csv"


_IN_WEEK = "doc_id % 37 <> 0 AND doc_id % 12 <= 7"


@query("dated_files", "labeled", f"""
    SELECT doc_id, cast(date '2024-01-31' - cast(doc_id % 12 AS int) AS date) AS day
    FROM labeled WHERE {_IN_WEEK}""")
def dated_files(v):
    found = C.dated_files(v.spark, _write_days(v), AS_OF, _PREFIX)
    paths = [row["path"] for row in found.select("path").collect()]
    rows = v.spark.read.options(**C.READ_OPTIONS, multiLine="true").csv(paths)
    return rows.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), file_day(F.col("_metadata.file_path"), _PREFIX).alias("day")
    )


@query("merge_weekly", "labeled", f"""
    SELECT doc_id, clean_text, cast(cast(label AS double) AS bigint) AS label FROM labeled
    WHERE label IN ('0', '1', '2.0') AND {_IN_WEEK}""")
def merge_weekly(v):
    return merge_week(v.spark, _write_days(v), AS_OF, _PREFIX).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "clean_text", "label"
    )


def _write_timeline(v) -> str:
    """Search responses: one response per conversation, one entry per post."""
    number = F.col("id_str").cast("bigint")
    tweet = F.struct(
        *[F.col(c) for c in (
            "created_at", "id_str", "full_text", "lang", "user_id_str", "conversation_id_str",
            "in_reply_to_screen_name", "quote_count", "reply_count", "retweet_count",
            "favorite_count",
        )],
        F.struct(
            F.when(
                F.col("image_url").isNotNull(),
                F.array(F.struct(F.col("image_url").alias("media_url_https"))),
            ).alias("media")
        ).alias("entities"),
    )
    user = F.struct(
        F.struct(
            F.struct(
                F.struct(F.col("location")).alias("legacy"),
                F.struct(F.col("username").alias("screen_name")).alias("core"),
            ).alias("result")
        ).alias("user_results")
    )
    # Every tenth is a promotion, every fifteenth has no result, every seventh is
    # nested one level deeper.
    direct = F.struct(
        F.when(number % 7 != 0, tweet).alias("legacy"),
        F.when(number % 7 != 0, user).alias("core"),
        F.when(number % 7 == 0, F.struct(tweet.alias("legacy"), user.alias("core"))).alias("tweet"),
    )
    entry = F.struct(
        F.concat(F.when(number % 10 == 0, "promoted-").otherwise("tweet-"), "id_str").alias("entryId"),
        F.struct(
            F.struct(
                F.struct(F.when(number % 15 != 0, direct).alias("result")).alias("tweet_results")
            ).alias("itemContent")
        ).alias("content"),
    )
    responses = v.posts.groupBy(
        "conversation_id_str", (F.floor(number / 100)).alias("page")
    ).agg(F.collect_list(entry).alias("entries"))
    listed = F.array(F.struct("entries"))
    thread = F.col("conversation_id_str").cast("int") % 2 == 0
    envelope = F.struct(
        F.struct(
            F.when(thread, F.struct(listed.alias("instructions"))).alias(
                "threaded_conversation_with_injections_v2"
            ),
            F.when(
                ~thread,
                F.struct(F.struct(F.struct(listed.alias("instructions")).alias("timeline")).alias(
                    "search_timeline"
                )),
            ).alias("search_by_raw_query"),
        ).alias("data")
    )
    path = work_path(v.spark, "timeline")
    responses.select(F.to_json(envelope).alias("value")).write.text(path)
    return path


_SPACES = harvest_space("full_text")
_NESTED = "cast(id_str AS bigint) % 7 = 0"


@query("timeline_flatten", "posts", f"""
    SELECT conversation_id_str, created_at, favorite_count, {_SPACES} AS full_text, id_str,
      coalesce(image_url, '') AS image_url,
      coalesce(in_reply_to_screen_name, '') AS in_reply_to_screen_name, lang,
      coalesce(location, '') AS location, quote_count, reply_count, retweet_count,
      CASE WHEN {_NESTED} OR username IS NULL THEN NULL
        ELSE concat('https://x.com/', username, '/status/', id_str) END AS tweet_url,
      user_id_str, CASE WHEN {_NESTED} THEN NULL ELSE username END AS username
    FROM posts WHERE cast(id_str AS bigint) % 10 <> 0 AND cast(id_str AS bigint) % 15 <> 0""")
def timeline_flatten(v):
    return TL.flatten(TL.read_timeline(v.spark, _write_timeline(v)))


@query("drop_invalid_entries", "posts", """
    SELECT count(*) AS rows FROM posts
    WHERE cast(id_str AS bigint) % 10 <> 0 AND cast(id_str AS bigint) % 15 <> 0""")
def drop_invalid_entries(v):
    entries = TL.entries(TL.read_timeline(v.spark, _write_timeline(v)))
    return TL.valid_results(entries).agg(F.count(F.lit(1)).alias("rows"))


@query("fn_json_path", "posts", """
    SELECT concat(CASE WHEN cast(id_str AS bigint) % 10 = 0 THEN 'promoted-' ELSE 'tweet-' END, id_str)
        AS entry_id,
      CASE WHEN cast(id_str AS bigint) % 15 <> 0 AND cast(id_str AS bigint) % 7 <> 0
        THEN image_url END AS picture
    FROM posts""")
def fn_json_path(v):
    legacy = "content.itemContent.tweet_results.result.legacy"
    return TL.entries(TL.read_timeline(v.spark, _write_timeline(v))).select(
        F.col("entryId").alias("entry_id"),
        F.get(F.col(f"{legacy}.entities.media"), F.lit(0))["media_url_https"].alias("picture"),
    )


def _write_thread(v) -> str:
    """Thread responses: one response per turn, its text an answer to the other role."""
    other = F.when(F.col("role") == "user", "assistant").otherwise("user")
    quote = F.when(F.col("turn") % 2 == 0, '"').otherwise("")
    tweet = F.struct(
        F.concat_ws("-", "conv_id", "turn").alias("id_str"),
        F.concat(quote, F.lit("@"), other, F.lit(" "), F.col("text")).alias("full_text"),
        other.alias("in_reply_to_screen_name"),
        F.struct(
            F.when(F.col("turn") > 0, F.array(F.struct(other.alias("screen_name")))).alias(
                "user_mentions"
            )
        ).alias("entities"),
    )
    user = F.struct(
        F.struct(
            F.struct(F.struct(F.col("role").alias("screen_name")).alias("core")).alias("result")
        ).alias("user_results")
    )
    result = F.struct(tweet.alias("legacy"), user.alias("core")).alias("result")
    item = F.struct(F.struct(result).alias("tweet_results")).alias("itemContent")
    entry = F.struct(
        F.lit("conversationthread").alias("entryId"),
        F.struct(F.array(F.struct(F.struct(item).alias("item"))).alias("items")).alias("content"),
    )
    thread = F.struct(F.array(F.struct(F.array(entry).alias("entries"))).alias("instructions"))
    path = work_path(v.spark, "thread")
    v.conversations.select(
        F.to_json(
            F.struct(F.struct(thread.alias("threaded_conversation_with_injections_v2")).alias("data"))
        ).alias("value")
    ).write.text(path)
    return path


_OTHER = "CASE role WHEN 'user' THEN 'assistant' ELSE 'user' END"


@query("timeline_detail", "conversations", f"""
    WITH t AS (SELECT *, {harvest_space(f"concat('@', {_OTHER}, ' ', text)")} AS squeezed FROM conversations)
    SELECT concat(conv_id, '-', turn) AS id_str, role AS username,
      {_OTHER} AS in_reply_to_screen_name,
      CASE WHEN turn % 2 = 0
        THEN concat('"', substr(squeezed, length(concat('@', {_OTHER}, ' ')) + 1))
        ELSE squeezed END AS full_text
    FROM t WHERE turn > 0""")
def timeline_detail(v):
    return TL.flatten(TL.read_timeline(v.spark, _write_thread(v)), "detail").select(
        "id_str", "username", "in_reply_to_screen_name", "full_text"
    )


@query("table_scan", "predictions runs", """
    SELECT 'predictions' AS name, count(*) AS rows FROM predictions
    UNION ALL SELECT 'runs' AS name, count(*) AS rows FROM runs""")
def table_scan(v):
    register({"scan_predictions": v.predictions, "scan_runs": v.runs})
    return v.spark.sql(
        "SELECT 'predictions' AS name, count(*) AS rows FROM scan_predictions "
        "UNION ALL SELECT 'runs', count(*) FROM scan_runs"
    )


@query("partitioned_store", "predictions", """
    SELECT cast(predicted_at AS date) AS predicted_date, pred_label, count(*) AS rows,
      min(username) AS first_user
    FROM predictions WHERE predicted_at >= timestamp '2024-01-24' GROUP BY 1, 2""")
def partitioned_store(v):
    path = write_by_day(
        v.predictions.withColumn("predicted_at", F.col("predicted_at").cast("timestamp")),
        work_path(v.spark, "by-day"),
    )
    stored = v.spark.read.parquet(path)
    return (
        recent(stored, "predicted_at", AS_OF, "7 days")
        .groupBy("predicted_date", "pred_label")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("username").alias("first_user"))
    )


def as_predictions(events):
    """Events as prediction rows, by the derivation of the view."""
    events.createOrReplaceTempView("arriving")
    return events.sparkSession.sql(VIEWS["predictions"][1].replace("FROM events", "FROM arriving"))


def with_document(events, documents, n_documents):
    """The events whose document is there; only the ids of the documents are read."""
    ids = documents.select(F.col("doc_id").alias("_doc"))
    return events.join(ids, F.col("event_id") % n_documents == F.col("_doc"), "left_semi")


def texts_of(documents):
    """Adds the texts of their documents to rows with ``doc_ref``; a text is shuffled once and named twice."""
    texts = documents.select(F.col("doc_id").alias("doc_ref"), F.col("text").alias("full_text"))
    return lambda posts: posts.join(texts, "doc_ref").withColumn("clean_text", F.col("full_text"))


# A user stands for a post here: every event of the user scores it again.
def _rescored(v):
    """The rows of ``texted`` without the texts, which ``texts_of`` adds by ``doc_ref``."""
    n_documents = v.documents.count()
    events = as_predictions(with_document(v.events, v.documents, n_documents))
    return events.withColumns(
        {"id_str": F.concat(F.lit("post_"), F.col("user_id").cast("string")), "doc_ref": F.col("event_id") % n_documents}
    )


_UPSERT = """
    WITH ranked AS (
      SELECT concat('post_', cast(user_id AS varchar)) AS post, *,
        row_number() OVER (PARTITION BY user_id ORDER BY predicted_at, event_id) AS first,
        row_number() OVER (PARTITION BY user_id ORDER BY predicted_at DESC, event_id DESC) AS last
      FROM texted)
    SELECT a.post AS id_str, a.username, a.favorite_count, a.created_at, md5(a.full_text) AS text_hash,
      b.pred_label, b.hf_label, b.pred_score, b.model_run_id, b.predicted_at
    FROM ranked a JOIN ranked b ON a.post = b.post AND a.first = 1 AND b.last = 1"""


def _upserted(df):
    return df.select(
        "id_str", "username", "favorite_count", "created_at", F.md5("full_text").alias("text_hash"),
        "pred_label", "hf_label", "pred_score", "model_run_id", "predicted_at",
    )



@query("upsert_predictions", "texted", _UPSERT)
def upsert_predictions(v):
    """A batch into a table; texts are joined to the one row per post that stays."""
    order = F.struct("predicted_at", "event_id")
    half = clock("2024-01-16 00:00:00", "timestamp_ntz")
    df = _rescored(v).drop("user_id", "conversation_id_str")
    first = df.where(F.col("predicted_at") < half)
    second = df.where(F.col("predicted_at") >= half)
    complete = texts_of(v.documents)
    table = written(complete(one_per_post(first, order)), "table")
    return _upserted(upsert(table, second, order, complete=complete))


@query("store_upsert", "texted", _UPSERT)
def store_upsert(v):
    """Two batches, whose texts are joined to the one row per post that stays."""
    store = PredictionStore(v.spark, work_path(v.spark, "store"))
    df = _rescored(v).withColumns(
        {
            c: F.lit(None).cast("string")
            for c in ("tweet_url", "user_id_str", "location", "image_url", "original_label")
        }
    )
    half = clock("2024-01-16 00:00:00", "timestamp_ntz")
    for part in (F.col("predicted_at") < half, F.col("predicted_at") >= half):
        store.upsert(df.where(part), F.struct("predicted_at", "event_id"), texts_of(v.documents))
    return _upserted(store.read())


@query("normalize_na", "labeled", """
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 THEN NULL ELSE 'ok' END AS value
    FROM labeled""")
def normalize_na_query(v):
    number = F.col("doc_id")
    value = F.when(number % 3 == 0, "N/A").when(number % 5 == 0, "").otherwise("ok")
    return normalize_na(v.labeled.select("doc_id", value.alias("value")))


_HITS = "sum(CASE WHEN y = yhat THEN 1 ELSE 0 END)"


@query("report_sink", "pairs", f"""
    SELECT {rnd(f'cast({_HITS} AS double) / count(*)', 6)} AS accuracy,
      cast(3 + 3 AS bigint) AS report_rows, cast(count(*) AS bigint) AS in_matrix
    FROM pairs""")
def report_sink(v):
    pairs = E.pair_counts(v.pairs, "y", "yhat")
    folder = write_reports(
        E.basic_metrics(pairs),
        E.class_report(pairs),
        E.confusion_matrix(pairs, (0, 1, 2)),
        work_path(v.spark, "reports"),
    )
    matrix = v.spark.read.option("header", True).csv(
        f"{folder}/confusion_matrix", schema="true_label int, pred_0 long, pred_1 long, pred_2 long"
    )
    report = v.spark.read.option("header", True).csv(f"{folder}/classification_report")
    metrics = v.spark.read.schema("accuracy double").json(f"{folder}/eval_metrics")
    return metrics.select(
        "accuracy",
        report.select(F.count(F.lit(1))).scalar().alias("report_rows"),
        matrix.select(F.sum(F.expr("pred_0 + pred_1 + pred_2"))).scalar().alias("in_matrix"),
    )


@query("score_tweets", "worded", f"""
    SELECT concat('v', vec_id) AS id_str,
      CASE WHEN vec_id % 9 = 0 THEN 'error'
        ELSE concat('LABEL_', list_position(logits, list_max(logits)) - 1) END AS hf_label,
      CASE WHEN vec_id % 9 = 0 THEN 'error'
        ELSE ['negative', 'neutral', 'positive'][list_position(logits, list_max(logits))] END
        AS pred_label,
      CASE WHEN vec_id % 9 = 0 THEN 0.0 ELSE
        {rnd('1 / list_sum([exp(cast(x AS double) - list_max(logits)) for x in logits])', 8)} END
        AS pred_score,
      CASE WHEN vec_id % 9 <> 0 THEN md5(text) END AS text_hash
    FROM worded""")
def score_tweets(v):
    posts = v.worded.select(
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id_str"),
        F.when(F.col("vec_id") % 9 != 0, F.col("text")).alias("clean_text"),
        "logits",
    )
    scored = score_posts(posts, logits_scorer()).withColumn("text_hash", F.md5("clean_text"))
    scored = scored.drop("clean_text", "logits")
    return scored.withColumn("pred_score", round_numeric(F.col("pred_score"), 8))


@query("scored_records", "worded", """
    SELECT concat('v', vec_id) AS id_str, 'run_1' AS model_run_id, cast(0 AS bigint) AS reply_count,
      timestamp '2024-01-31' AS predicted_at, md5(text) AS text_hash
    FROM worded WHERE vec_id % 9 <> 0""")
def scored_records(v):
    posts = v.worded.select(
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id_str"),
        F.when(F.col("vec_id") % 9 != 0, F.col("text")).alias("clean_text"),
        "logits",
    )
    scored = score_posts(posts, logits_scorer()).drop("logits")
    return prediction_records(scored, "run_1", AS_OF).select(
        "id_str", "model_run_id", "reply_count", "predicted_at", F.md5("clean_text").alias("text_hash")
    )




# --- whole jobs ---------------------------------------------------------------

_VALID_ENTRY = "cast(id_str AS bigint) % 10 <> 0 AND cast(id_str AS bigint) % 15 <> 0"


@query("harvest_job", "posts", f"""
    SELECT id_str, nullif({_SPACES}, '') AS full_text, lang, copy FROM posts, (VALUES (1), (2)) copies(copy)
    WHERE {_VALID_ENTRY}""")
def harvest_job(v):
    """Responses are taken twice: the second time is appended to the first."""
    source, path = _write_timeline(v), work_path(v.spark, "harvest") + ".csv"
    P.harvest_job(v.spark, source, path, insert="REPLACE")
    P.harvest_job(v.spark, source, path, insert="APPEND")
    place = Window.partitionBy("id_str").orderBy("id_str")
    return C.read_appended(v.spark, path).select(
        "id_str", "full_text", "lang", F.row_number().over(place).alias("copy")
    )


@query("harvest_target", "posts", f"""
    SELECT least(count(*), 25) AS rows, 1 AS one_header FROM posts WHERE {_VALID_ENTRY}""")
def harvest_target(v):
    """Only so many posts are wanted."""
    path = P.harvest_job(v.spark, _write_timeline(v), work_path(v.spark, "harvest"), wanted=25)
    return C.read_appended(v.spark, path).agg(
        F.count(F.lit(1)).alias("rows"), F.lit(1).alias("one_header")
    )


@query("reply_edges_job", "posts", """
    SELECT username AS source, in_reply_to_screen_name AS target FROM posts
    WHERE username IS NOT NULL OR in_reply_to_screen_name IS NOT NULL""")
def reply_edges_job(v):
    posts = C.write_csv(v.posts, work_path(v.spark, "answers"))
    return C.read_csv(v.spark, P.reply_edges_job(v.spark, posts, work_path(v.spark, "edges")))


@query("merge_job", "labeled", f"""
    SELECT count(*) AS rows_in, count(*) FILTER (WHERE label IN ('0', '1', '2.0')) AS rows_out,
      count(*) FILTER (WHERE label IN ('0', '1', '2.0')) AS written
    FROM labeled WHERE {_IN_WEEK}""")
def merge_job(v):
    report = P.merge_job(v.spark, _write_days(v), work_path(v.spark, "week"), AS_OF, _PREFIX)
    return C.read_csv(v.spark, report["output"]).agg(
        F.lit(report["rows_in"]).cast("long").alias("rows_in"),
        F.lit(report["rows_out"]).cast("long").alias("rows_out"),
        F.count(F.lit(1)).alias("written"),
    )


@query("clean_job", "posts", f"""
    SELECT id_str, nullif({cleaned('full_text')}, '') AS clean_text FROM posts WHERE lang IN ('in', 'id')""")
def clean_job(v):
    folder = work_path(v.spark, "cleaned")
    P.clean_job(v.spark, C.write_csv(v.posts, work_path(v.spark, "raw")), folder)
    return C.read_csv(v.spark, f"{folder}/cleaned.csv").select("id_str", "clean_text")
