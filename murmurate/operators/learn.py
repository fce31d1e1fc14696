"""Features, training and scoring with Spark ML."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmurate.functions.scalar import argmax, label_name, softmax_top
from murmurate.functions.text import SPACE_SET
from murmurate.schemas import LABEL_NAMES, MAX_TOKENS

Scorer = Callable[[DataFrame], DataFrame]


def tokens(text: Column) -> Column:
    """Words of a text, in order."""
    return F.filter(F.split(text, f"[{SPACE_SET}]+"), lambda w: w != "")


def padded_tokens(words: Column, length: int = MAX_TOKENS, pad: str = "[PAD]") -> Column:
    """Exactly ``length`` tokens, as a model of fixed input length takes them."""
    fill = F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(length) - F.size(words)))
    return F.concat(F.slice(words, 1, length), fill)


def text_classifier(
    text: str = "clean_text",
    label: str = "label",
    features: int = 1 << 16,
    max_iter: int = 30,
    reg: float = 0.01,
    max_tokens: int | None = None,
) -> Pipeline:
    """Hashed, weighted words and a multinomial logistic regression.

    ``max_tokens`` cuts a text as a model of fixed input length does; without it
    the whole text counts. The fit is distributed; what the driver holds is a
    coefficient per feature and class.
    """
    cut = "words" if max_tokens is None else f"slice(words, 1, {int(max_tokens)})"
    return Pipeline(
        stages=[
            RegexTokenizer(
                inputCol=text, outputCol="words", pattern=f"[{SPACE_SET}]+", toLowercase=False
            ),
            SQLTransformer(statement=f"SELECT *, {cut} AS kept_words FROM __THIS__"),
            HashingTF(inputCol="kept_words", outputCol="counts", numFeatures=features),
            IDF(inputCol="counts", outputCol="features"),
            LogisticRegression(
                labelCol=label, family="multinomial", maxIter=max_iter, regParam=reg,
                aggregationDepth=3,
            ),
        ]
    )


_SCRATCH = ["words", "kept_words", "counts", "features", "rawPrediction", "probability"]


def model_scorer(model: PipelineModel | Transformer) -> Scorer:
    """A fitted pipeline as a scorer: adds ``hf_label`` and ``pred_score``."""

    def score(df: DataFrame) -> DataFrame:
        out = model.transform(df)
        return out.withColumns(
            {
                "hf_label": F.concat(F.lit("LABEL_"), F.col("prediction").cast("int").cast("string")),
                "pred_score": F.array_max(vector_to_array("probability")),
            }
        ).drop("prediction", *_SCRATCH)

    return score


def logits_scorer(logits: str = "logits") -> Scorer:
    """Scorer for frames that already carry an array of logits."""

    def score(df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                "hf_label": F.concat(F.lit("LABEL_"), argmax(F.col(logits)).cast("string")),
                "pred_score": softmax_top(F.col(logits)),
            }
        )

    return score


def score_batch(
    df: DataFrame, scorer: Scorer, text: str = "text", names: dict[str, str] = LABEL_NAMES
) -> DataFrame:
    """Add ``hf_label``, ``pred_label`` and ``pred_score`` to every row."""
    if text not in df.columns:
        raise ValueError(f"missing required columns: {text}")
    return scorer(df).withColumn("pred_label", label_name(F.col("hf_label"), names))


def score_posts(
    df: DataFrame, scorer: Scorer, text: str = "clean_text", names: dict[str, str] = LABEL_NAMES
) -> DataFrame:
    """As :func:`score_batch`, but a row that cannot be scored does not fail the batch.

    A row without text, or without a score, gets ``('error', 'error', 0.0)``.
    """
    columns = df.columns
    guarded = df.withColumns(
        {"_text": F.col(text), text: F.coalesce(F.col(text), F.lit(""))}
    )
    scored = scorer(guarded)
    bad = F.col("_text").isNull() | F.col("hf_label").isNull() | F.col("pred_score").isNull()
    return scored.withColumns(
        {
            text: F.col("_text"),
            "hf_label": F.when(bad, "error").otherwise(F.col("hf_label")),
            "pred_score": F.when(bad, 0.0).otherwise(F.col("pred_score")),
        }
    ).withColumn("pred_label", label_name(F.col("hf_label"), names)).select(
        *columns, "hf_label", "pred_label", "pred_score"
    )
