"""Dashboard reports over runs and predictions."""

from pyspark.sql import functions as F

from contract.sqltext import initcap, pct, rnd, runs_of, since
from contract.views import AS_OF, EXPERIMENT, RUNS_AS_OF, query
from murmurate.plans import prediction_reports as P
from murmurate.plans import run_reports as R
from murmurate.schemas import PREDICTION
from murmurate.session import work_path
from murmurate.sources.store import PredictionStore

RUN_VIEWS = "experiments runs metrics params tags"
_MINUTES = rnd("cast(epoch_us(end_time) - epoch_us(start_time) AS double) / 6e7", 2)


def _active(days: str | None = None) -> str:
    """Runs of the experiment that are not deleted, in a window if wanted."""
    window = f"AND {since(days, 'start_time', RUNS_AS_OF)}" if days else ""
    return f"""SELECT * FROM runs WHERE deleted_time IS NULL {window} AND experiment_id IN (
        SELECT experiment_id FROM experiments WHERE name = '{EXPERIMENT}')"""


def _newest(n: int) -> str:
    return f"{_active()} ORDER BY start_time DESC NULLS FIRST, run_uuid LIMIT {n}"


def _wide(table: str, keys: dict[str, str], runs: str = "chosen") -> str:
    """One row per chosen run, with the largest value of each key."""
    values = ", ".join(f"max(value) FILTER (WHERE key = '{key}') AS {name}" for key, name in keys.items())
    return f"SELECT run_uuid, {values} FROM {table} WHERE run_uuid IN (SELECT run_uuid FROM {runs}) GROUP BY run_uuid"


def _same(*keys: str) -> dict[str, str]:
    return {key: key for key in keys}


@query("q01_latest_run", RUN_VIEWS, f"""
    WITH chosen AS ({_newest(1)}),
      scores AS ({_wide('metrics', _same('eval_accuracy', 'eval_f1_macro', 'eval_loss'))}),
      settings AS ({_wide('params', _same('model_accepted', 'epochs', 'learning_rate', 'is_incremental'))}),
      marks AS ({_wide('tags', _same('model_status'))})
    SELECT run_uuid AS run_id, name AS run_name, status, start_time, end_time, eval_accuracy,
      eval_f1_macro, eval_loss, model_accepted, model_status, epochs, learning_rate, is_incremental
    FROM chosen LEFT JOIN scores USING (run_uuid) LEFT JOIN settings USING (run_uuid)
      LEFT JOIN marks USING (run_uuid)""")
def q01(v):
    return R.latest_run(v.runs_tables, EXPERIMENT)


_M = "JOIN metrics m ON r.run_uuid = m.run_uuid"
_PJ = "JOIN params p ON r.run_uuid = p.run_uuid"


@query("q02_f1_over_time", RUN_VIEWS, f"""
    SELECT r.start_time AS time, m.value AS f1_macro_score, r.name AS run_name,
      CASE WHEN m.value >= 0.80 THEN 'Accepted' ELSE 'Rejected' END AS status
    {runs_of(_M, '30 days')} AND m.key = 'eval_f1_macro'""")
def q02(v):
    return R.f1_over_time(v.runs_tables, EXPERIMENT, RUNS_AS_OF)


@query("q03_acceptance_rate", RUN_VIEWS, f"""
    SELECT CASE WHEN p.value = 'True' THEN 'Accepted' ELSE 'Rejected' END AS status,
      count(*) AS count, {pct('count(*)', 'sum(count(*)) OVER ()')} AS percentage
    {runs_of(_PJ, '30 days')} AND p.key = 'model_accepted' GROUP BY p.value""")
def q03(v):
    return R.acceptance_rate(v.runs_tables, EXPERIMENT, RUNS_AS_OF)


def _avg(k: str) -> str:
    return rnd(f"avg(CASE WHEN m.key = '{k}' THEN m.value END)", 4)


@query("q04_avg_metrics", RUN_VIEWS, f"""
    SELECT {_avg('eval_accuracy')} AS avg_accuracy, {_avg('eval_f1_macro')} AS avg_f1_macro,
      {_avg('eval_loss')} AS avg_loss, count(DISTINCT r.run_uuid) AS total_runs
    {runs_of(_M, '7 days')}""")
def q04(v):
    return R.average_metrics(v.runs_tables, EXPERIMENT, RUNS_AS_OF)


@query("q05_compare_runs", RUN_VIEWS, f"""
    WITH chosen AS ({_newest(10)}),
      scores AS ({_wide('metrics', {'eval_f1_macro': 'f1', 'eval_accuracy': 'acc', 'eval_loss': 'lost'})}),
      settings AS ({_wide('params', {'epochs': 'epochs', 'learning_rate': 'lr',
                                     'model_accepted': 'accepted', 'is_incremental': 'incremental'})})
    SELECT start_time, name AS run_name, {rnd('f1', 4)} AS f1_macro, {rnd('acc', 4)} AS accuracy,
      {rnd('lost', 4)} AS loss, epochs, lr, accepted, incremental, {_MINUTES} AS duration_min
    FROM chosen LEFT JOIN scores USING (run_uuid) LEFT JOIN settings USING (run_uuid)""")
def q05(v):
    return R.compare_runs(v.runs_tables, EXPERIMENT)


@query("q06_duration_trend", RUN_VIEWS, f"""
    WITH chosen AS (SELECT * FROM ({_active('30 days')}) WHERE end_time IS NOT NULL),
      settings AS ({_wide('params', _same('is_incremental'))})
    SELECT start_time AS time, name AS run_name, {_MINUTES} AS duration_minutes, is_incremental
    FROM chosen LEFT JOIN settings USING (run_uuid)""")
def q06(v):
    return R.duration_trend(v.runs_tables, EXPERIMENT, RUNS_AS_OF)


@query("q07_latest_status", RUN_VIEWS, f"""
    WITH chosen AS ({_newest(1)})
    SELECT start_time AS time,
      CASE WHEN (SELECT min(value) FROM params p WHERE p.run_uuid = chosen.run_uuid
        AND key = 'model_accepted') = 'True' THEN 1 ELSE 0 END AS is_accepted,
      (SELECT min(value) FROM metrics m WHERE m.run_uuid = chosen.run_uuid
        AND key = 'eval_f1_macro') AS f1_score
    FROM chosen""")
def q07(v):
    return R.latest_status(v.runs_tables, EXPERIMENT)


@query("q08_incremental_vs_fresh", RUN_VIEWS, f"""
    WITH chosen AS ({_active('30 days')}),
      kinds AS (SELECT run_uuid, value AS training_type FROM params WHERE key = 'is_incremental'
        AND run_uuid IN (SELECT run_uuid FROM chosen))
    SELECT training_type,
      {rnd("avg(value) FILTER (WHERE key = 'eval_f1_macro')", 4)} AS avg_f1_macro,
      {rnd("avg(value) FILTER (WHERE key = 'eval_accuracy')", 4)} AS avg_accuracy,
      count(DISTINCT run_uuid) AS run_count
    FROM kinds JOIN metrics USING (run_uuid) GROUP BY training_type""")
def q08(v):
    return R.incremental_vs_fresh(v.runs_tables, EXPERIMENT, RUNS_AS_OF)


@query("q09_metrics_detail", RUN_VIEWS, f"""
    SELECT r.start_time AS time, r.name AS run_name, m.key AS metric_name,
      {rnd('m.value', 4)} AS metric_value, m.step, m.timestamp
    {runs_of(_M, '7 days')}""")
def q09(v):
    return R.metrics_detail(v.runs_tables, EXPERIMENT, RUNS_AS_OF)


@query("q10_param_distribution", RUN_VIEWS, f"""
    SELECT p.key AS parameter, p.value, count(*) AS usage_count,
      {pct('count(*)', 'sum(count(*)) OVER (PARTITION BY p.key)')} AS percentage
    {runs_of(_PJ, '30 days')}
      AND p.key IN ('epochs', 'learning_rate', 'batch_size', 'freeze_layers')
    GROUP BY p.key, p.value""")
def q10(v):
    return R.param_distribution(v.runs_tables, EXPERIMENT, RUNS_AS_OF)


SENTIMENT = f"{initcap('pred_label')} AS sentiment"


@query("q11_sentiment_share", "predictions", f"""
    SELECT {SENTIMENT}, count(*) AS count,
      {pct('count(*)', 'sum(count(*)) OVER ()')} AS percentage
    FROM predictions WHERE {since('7 days')} GROUP BY pred_label""")
def q11(v):
    return P.sentiment_share(v.predictions, AS_OF)


for _letter, _label in (("a", "positive"), ("b", "negative"), ("c", "neutral")):

    @query(f"q11{_letter}_{_label}", "predictions", f"""
        SELECT {pct('count(*)', f"(SELECT count(*) FROM predictions WHERE {since('7 days')})")}
          AS percentage
        FROM predictions WHERE {since('7 days')} AND pred_label = '{_label}'""")
    def q11_one(v, label=_label):
        return P.label_percentage(v.predictions, AS_OF, label)


def _trend(unit: str, days: str) -> str:
    return f"""
    SELECT cast(date_trunc('{unit}', predicted_at) AS timestamp) AS time, {SENTIMENT},
      count(*) AS count
    FROM predictions WHERE {since(days)} GROUP BY date_trunc('{unit}', predicted_at), pred_label"""


@query("q12_daily_trend", "predictions", _trend("day", "30 days"))
def q12(v):
    return P.daily_trend(v.predictions, AS_OF)


@query("q13_confidence", "predictions", f"""
    SELECT {SENTIMENT}, {rnd('avg(pred_score)', 4)} AS avg_confidence,
      {rnd('min(pred_score)', 4)} AS min_confidence, {rnd('max(pred_score)', 4)} AS max_confidence,
      count(*) AS total_predictions
    FROM predictions WHERE {since('7 days')} GROUP BY pred_label""")
def q13(v):
    return P.confidence(v.predictions, AS_OF)


@query("q14_engagement", "predictions", f"""
    SELECT {SENTIMENT}, count(*) AS tweet_count,
      cast(sum(favorite_count) AS bigint) AS total_favorites,
      cast(sum(retweet_count) AS bigint) AS total_retweets,
      cast(sum(reply_count) AS bigint) AS total_replies,
      cast(sum(quote_count) AS bigint) AS total_quotes,
      {rnd('avg(favorite_count)', 2)} AS avg_favorites,
      {rnd('avg(retweet_count)', 2)} AS avg_retweets
    FROM predictions WHERE {since('7 days')} GROUP BY pred_label""")
def q14(v):
    return P.engagement(v.predictions, AS_OF)


def _cases(suffix: str) -> str:
    return ", ".join(
        f"cast(sum(CASE WHEN pred_label = '{x}' THEN 1 ELSE 0 END) AS bigint) AS {x}{suffix}"
        for x in ("positive", "negative", "neutral")
    )


@query("q15_top_users", "predictions", f"""
    SELECT username, count(*) AS total_tweets, {_cases('_count')},
      {rnd('avg(pred_score)', 4)} AS avg_confidence
    FROM predictions WHERE {since('7 days')} AND username IS NOT NULL
    GROUP BY username ORDER BY total_tweets DESC, username LIMIT 10""")
def q15(v):
    return P.top_users(v.predictions, AS_OF)


@query("q16_hourly", "predictions", _trend("hour", "7 days"))
def q16(v):
    return P.hourly_trend(v.predictions, AS_OF)


@query("q17_feed", "texted", f"""
    SELECT predicted_at AS time, username, {SENTIMENT}, {rnd('pred_score', 4)} AS confidence,
      left(clean_text, 100) AS tweet_preview, favorite_count, retweet_count, model_run_id
    FROM texted WHERE {since('24 hours')} ORDER BY predicted_at DESC, id_str LIMIT 50""")
def q17(v):
    return P.feed(v.texted, AS_OF)


@query("q18_by_language", "predictions", f"""
    SELECT lang AS language, {SENTIMENT}, count(*) AS count,
      {pct('count(*)', 'sum(count(*)) OVER (PARTITION BY lang)')} AS percentage
    FROM predictions WHERE {since('7 days')} AND lang IS NOT NULL GROUP BY lang, pred_label""")
def q18(v):
    return P.by_language(v.predictions, AS_OF)


BANDS = """CASE WHEN pred_score >= 0.9 THEN '0.9-1.0 (Very High)'
      WHEN pred_score >= 0.8 THEN '0.8-0.9 (High)' WHEN pred_score >= 0.7 THEN '0.7-0.8 (Medium)'
      WHEN pred_score >= 0.6 THEN '0.6-0.7 (Low)' ELSE '0.0-0.6 (Very Low)' END"""


@query("q19_confidence_bands", "predictions", f"""
    SELECT {BANDS} AS confidence_range, count(*) AS count,
      {pct('count(*)', 'sum(count(*)) OVER ()')} AS percentage
    FROM predictions WHERE {since('7 days')} GROUP BY 1""")
def q19(v):
    return P.confidence_bands(v.predictions, AS_OF)


@query("q20_daily_summary", "predictions", f"""
    SELECT cast(date_trunc('day', predicted_at) AS timestamp) AS date,
      count(*) AS total_predictions, count(DISTINCT username) AS unique_users,
      {rnd('avg(pred_score)', 4)} AS avg_confidence, {_cases('')},
      cast(sum(favorite_count + retweet_count + reply_count + quote_count) AS bigint)
        AS total_engagement
    FROM predictions WHERE {since('30 days')} GROUP BY 1""")
def q20(v):
    return P.daily_summary(v.predictions, AS_OF)


# Reports on the published table and its hourly sums; the window starts within an hour.
_LATE = "2024-01-31 00:25:00"


def _published(v):
    """The events in two batches; the second scores every third post of the first again, and moves it to another day."""
    columns = {f.name: F.lit(None).cast(f.dataType) for f in PREDICTION.fields if f.name not in v.predictions.columns}
    rows = v.predictions.withColumns(columns)
    store = PredictionStore(v.spark, work_path(v.spark, "published"), hourly=True)
    moved = F.when(F.col("event_id") % 3 == 0, F.col("predicted_at") - F.expr("INTERVAL 36 HOUR")).otherwise(F.col("predicted_at"))
    store.upsert(rows.where("event_id % 3 = 0 OR event_id % 2 = 0").withColumn("predicted_at", moved))
    store.upsert(rows.where("event_id % 3 = 0 OR event_id % 2 = 1"))
    return store


@query("published_share", "predictions", f"""
    SELECT {SENTIMENT}, count(*) AS count, {pct('count(*)', 'sum(count(*)) OVER ()')} AS percentage
    FROM predictions WHERE {since('7 days')} GROUP BY pred_label""")
def published_share(v):
    return P.sentiment_share(_published(v).read(), AS_OF)


def _sums(v, report, window="7 days"):
    return report(_published(v).summaries(_LATE, window), _LATE)


def _late(sql: str) -> str:
    return sql.replace(AS_OF, _LATE)


@query("rollup_hourly", "predictions", _late(_trend("hour", "7 days")))
def rollup_hourly(v):
    return _sums(v, P.hourly_trend)


@query("rollup_engagement", "predictions", _late(f"""
    SELECT {SENTIMENT}, count(*) AS tweet_count,
      cast(sum(favorite_count) AS bigint) AS total_favorites, cast(sum(retweet_count) AS bigint) AS total_retweets,
      cast(sum(reply_count) AS bigint) AS total_replies, cast(sum(quote_count) AS bigint) AS total_quotes,
      {rnd('avg(favorite_count)', 2)} AS avg_favorites, {rnd('avg(retweet_count)', 2)} AS avg_retweets
    FROM predictions WHERE {since('7 days')} GROUP BY pred_label"""))
def rollup_engagement(v):
    return _sums(v, P.engagement)


@query("rollup_by_language", "predictions", _late(f"""
    SELECT lang AS language, {SENTIMENT}, count(*) AS count,
      {pct('count(*)', 'sum(count(*)) OVER (PARTITION BY lang)')} AS percentage
    FROM predictions WHERE {since('7 days')} AND lang IS NOT NULL GROUP BY lang, pred_label"""))
def rollup_by_language(v):
    return _sums(v, P.by_language)
