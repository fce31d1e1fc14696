"""Record layouts and fixed values shared by every stage."""

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------

# Fields kept from a harvested post.
POST_FIELDS = [
    "created_at",
    "id_str",
    "full_text",
    "quote_count",
    "reply_count",
    "retweet_count",
    "favorite_count",
    "lang",
    "user_id_str",
    "conversation_id_str",
    "username",
    "tweet_url",
    "image_url",
    "location",
    "in_reply_to_screen_name",
]

COUNT_FIELDS = ["favorite_count", "quote_count", "reply_count", "retweet_count"]

# Language codes of Indonesian posts (the site uses the old code "in").
INDONESIAN = ("in", "id")

# 0 = negative, 1 = neutral, 2 = positive.
CLASSES = (0, 1, 2)
LABEL_NAMES = {"LABEL_0": "negative", "LABEL_1": "neutral", "LABEL_2": "positive"}

# Texts that a CSV reader of the pandas family takes as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# Longest texts the prediction record takes, by column.
MAX_LENGTHS = {
    "id_str": 50,
    "conversation_id_str": 50,
    "lang": 10,
    "user_id_str": 50,
    "username": 100,
    "in_reply_to_screen_name": 100,
    "pred_label": 20,
    "hf_label": 20,
    "original_label": 20,
    "model_run_id": 100,
}
REQUIRED_FIELDS = ("id_str", "full_text", "clean_text", "pred_label", "hf_label", "pred_score")

# What a later prediction of the same post replaces; the rest keeps its first value.
PREDICTION_FIELDS = ["pred_label", "hf_label", "pred_score", "model_run_id", "predicted_at"]

MIN_F1_MACRO = 0.80
MIN_DATASET_ROWS = 100
MAX_TOKENS = 128

# --- records ----------------------------------------------------------------

POST = T.StructType(
    [
        T.StructField(f, T.LongType() if f in COUNT_FIELDS else T.StringType())
        for f in POST_FIELDS
    ]
)

# A scoring request: a post with its cleaned text and, if known, its label.
SCORING_REQUEST = T.StructType(
    [
        T.StructField("id_str", T.StringType()),
        T.StructField("clean_text", T.StringType()),
        T.StructField("full_text", T.StringType()),
        T.StructField("conversation_id_str", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("tweet_url", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("user_id_str", T.StringType()),
        T.StructField("username", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("favorite_count", T.LongType()),
        T.StructField("quote_count", T.LongType()),
        T.StructField("reply_count", T.LongType()),
        T.StructField("retweet_count", T.LongType()),
        T.StructField("image_url", T.StringType()),
        T.StructField("in_reply_to_screen_name", T.StringType()),
        T.StructField("label", T.StringType()),
    ]
)

PREDICTION = T.StructType(
    [
        T.StructField("id_str", T.StringType()),
        T.StructField("conversation_id_str", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("tweet_url", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("full_text", T.StringType()),
        T.StructField("clean_text", T.StringType()),
        T.StructField("user_id_str", T.StringType()),
        T.StructField("username", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("favorite_count", T.LongType()),
        T.StructField("quote_count", T.LongType()),
        T.StructField("reply_count", T.LongType()),
        T.StructField("retweet_count", T.LongType()),
        T.StructField("image_url", T.StringType()),
        T.StructField("in_reply_to_screen_name", T.StringType()),
        T.StructField("pred_label", T.StringType()),
        T.StructField("hf_label", T.StringType()),
        T.StructField("pred_score", T.DoubleType()),
        T.StructField("original_label", T.StringType()),
        T.StructField("predicted_at", T.TimestampType()),
        T.StructField("model_run_id", T.StringType()),
    ]
)

# Run metadata: one row per run, then key/value rows.
EXPERIMENTS = T.StructType().add("experiment_id", T.IntegerType()).add("name", T.StringType())
VERSIONS = T.StructType(
    [
        T.StructField("model_name", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("stage", T.StringType()),
        T.StructField("run_uuid", T.StringType()),
    ]
)

RUNS = (
    T.StructType()
    .add("run_uuid", T.StringType())
    .add("name", T.StringType())
    .add("status", T.StringType())
    .add("experiment_id", T.IntegerType())
    .add("start_time", T.TimestampType())
    .add("end_time", T.TimestampType())
    .add("deleted_time", T.TimestampType())
)
METRICS = (
    T.StructType()
    .add("run_uuid", T.StringType())
    .add("key", T.StringType())
    .add("value", T.DoubleType())
    .add("step", T.LongType())
    .add("timestamp", T.TimestampType())
)
PARAMS = (
    T.StructType()
    .add("run_uuid", T.StringType())
    .add("key", T.StringType())
    .add("value", T.StringType())
)
TAGS = PARAMS

# Timeline responses: only the parts that are read.
_TWEET = T.StructType(
    [
        T.StructField("created_at", T.StringType()),
        T.StructField("id_str", T.StringType()),
        T.StructField("full_text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("user_id_str", T.StringType()),
        T.StructField("conversation_id_str", T.StringType()),
        T.StructField("in_reply_to_screen_name", T.StringType()),
        T.StructField("quote_count", T.LongType()),
        T.StructField("reply_count", T.LongType()),
        T.StructField("retweet_count", T.LongType()),
        T.StructField("favorite_count", T.LongType()),
        T.StructField(
            "entities",
            T.StructType()
            .add("media", T.ArrayType(T.StructType().add("media_url_https", T.StringType())))
            .add("user_mentions", T.ArrayType(T.StructType().add("screen_name", T.StringType()))),
        ),
    ]
)
_USER_BOX = T.StructType().add(
    "user_results",
    T.StructType().add(
        "result",
        T.StructType()
        .add("legacy", T.StructType().add("location", T.StringType()))
        .add("core", T.StructType().add("screen_name", T.StringType())),
    ),
)
_RESULT = (
    T.StructType()
    .add("legacy", _TWEET)
    .add("core", _USER_BOX)
    .add("tweet", T.StructType().add("legacy", _TWEET).add("core", _USER_BOX))
)
_ITEM = T.StructType().add("tweet_results", T.StructType().add("result", _RESULT))
ENTRY = (
    T.StructType()
    .add("entryId", T.StringType())
    .add(
        "content",
        T.StructType()
        .add("itemContent", _ITEM)
        .add(
            "items",
            T.ArrayType(T.StructType().add("item", T.StructType().add("itemContent", _ITEM))),
        ),
    )
)
_INSTRUCTIONS = T.ArrayType(T.StructType().add("entries", T.ArrayType(ENTRY)))
TIMELINE = T.StructType().add(
    "data",
    T.StructType()
    .add(
        "threaded_conversation_with_injections_v2",
        T.StructType().add("instructions", _INSTRUCTIONS),
    )
    .add(
        "search_by_raw_query",
        T.StructType().add(
            "search_timeline",
            T.StructType().add("timeline", T.StructType().add("instructions", _INSTRUCTIONS)),
        ),
    ),
)
