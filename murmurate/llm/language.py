"""Language of whole texts by hierarchical discrimination.

First a linear model predicts the language family; within that family a linear support
vector machine for each pair of languages votes. All work on one vector per text: hashed
byte n-grams of the lower-cased letters, square-rooted counts, unit length. The models
are fitted in numpy on a bounded sample per language (``SAMPLE`` rows, those of least
hash), of which only the vectors reach the driver; languages are counted over all rows.

Definitions. ``und`` with score 0 stands for a text that is null or has no letter, and
for every text if no language could be learned. With a single learned language that one
is predicted. Ties go to the language first in the alphabet. The score is the product of
the logistic values of the family margin and of the narrowest pair margin. Rows are
treated one by one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmurate.llm import blocks

BITS = 13
SIZES = (1, 2, 3)
SAMPLE = 400
#: Languages of a family, by ISO 639-1 code; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indic": "bn gu hi mr ne or pa si ur",
    "turkic": "az kk ky tk tr tt ug uz",
    "uralic": "et fi hu",
    "austronesian": "id jv mg ms su tl",
    "semitic": "am ar he mt",
    "dravidian": "kn ml ta te",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
#: Every byte that is no letter of ASCII and no part of a longer character counts as one blank.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[:128] = 32
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_LETTER = r"\p{L}"


def family(lang: str) -> str:
    return _FAMILY.get(lang.split("-")[0].lower(), lang)


def vectors(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> np.ndarray:
    """A row of unit length for each text."""
    data = _CLASS[data]
    out = np.zeros((len(offsets) - 1, 1 << bits), np.float32)
    found = [blocks.grams(data, size, bits) for size in SIZES]
    for k, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        row = out[k]
        for size, gram in zip(SIZES, found, strict=True):
            if end - begin >= size:
                row += np.bincount(gram[begin : end - size + 1], minlength=1 << bits)
    np.sqrt(out, out=out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _rows(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Vectors of a lower-cased column, at most 256 texts at a time."""
    column = pc.utf8_lower(pc.fill_null(column, ""))
    for start in range(0, len(column), 256):
        for first, data, offsets in blocks.blocks(column.slice(start, 256)):
            yield start + first, vectors(data, offsets)


def svm(x: np.ndarray, y: np.ndarray, strength: float = 1e-4, epochs: int = 30, seed: int = 3) -> np.ndarray:
    """Weights (the last one is the bias) of a linear support vector machine; ``y`` holds 1 and -1.

    Stochastic subgradient descent on the hinge loss in small batches; both classes weigh the same.
    """
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    random = np.random.default_rng(seed)
    weigh = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    w, mean, step = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    for epoch in range(epochs):
        for rows in np.array_split(random.permutation(len(x)), max(1, len(x) // 32)):
            step += 1
            rate = 1 / (strength * (step + 1000))
            wrong = rows[y[rows] * (x[rows] @ w) < 1]
            w *= 1 - rate * strength
            w += rate / len(rows) * ((y[wrong] * weigh[wrong]) @ x[wrong])
            w *= min(1.0, strength**-0.5 / max(np.linalg.norm(w), 1e-9))
        if 2 * epoch >= epochs:
            mean += w
    return mean / (epochs - epochs // 2 if epochs > 1 else 1)


@dataclass(frozen=True)
class Model:
    families: list[str]
    family_weights: np.ndarray
    languages: dict[str, list[str]]
    pairs: dict[str, list[tuple[int, int, np.ndarray]]] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
        margin = x @ self.family_weights.T
        chosen = margin.argmax(1)
        score = _logistic(margin[np.arange(len(x)), chosen]) if len(self.families) > 1 else np.ones(len(x))
        lang = np.empty(len(x), object)
        for k, name in enumerate(self.families):
            rows, codes = np.flatnonzero(chosen == k), self.languages[name]
            votes, least = np.zeros((len(rows), len(codes))), np.full((len(rows), len(codes)), np.inf)
            for a, b, w in self.pairs[name]:
                side = x[rows] @ w
                votes[:, a] += side >= 0
                votes[:, b] += side < 0
                least[:, a] = np.minimum(least[:, a], side)
                least[:, b] = np.minimum(least[:, b], -side)
            best = votes.argmax(1)
            lang[rows] = np.array(codes, object)[best]
            if len(codes) > 1:
                score[rows] *= _logistic(least[np.arange(len(rows)), best])
        return lang, score


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(2 * x, -50, 50)))


def train(x: np.ndarray, lang: np.ndarray) -> Model | None:
    """Family models against the rest, and a model for each pair of languages in a family."""
    if not len(lang):
        return None
    names = np.array([family(code) for code in lang])
    families = sorted(set(names))
    weights = np.array([svm(x, np.where(names == name, 1.0, -1.0)) if len(families) > 1 else np.zeros(x.shape[1] + 1) for name in families])
    languages = {name: sorted(set(lang[names == name])) for name in families}
    pairs = {}
    for name, codes in languages.items():
        pairs[name] = []
        for a, b in combinations(range(len(codes)), 2):
            rows = (lang == codes[a]) | (lang == codes[b])
            pairs[name].append((a, b, svm(x[rows], np.where(lang[rows] == codes[a], 1.0, -1.0))))
    return Model(families, weights, languages, pairs)


def fit(docs: DataFrame, learn_from: Column | None = None, sample: int = SAMPLE) -> Model | None:
    """Fit on ``sample`` different texts of each language, those of least hash, among the rows for which ``learn_from`` holds."""
    known = docs.where(F.col("lang").isNotNull() & (F.col("lang") != "") & F.col("text").isNotNull() & F.col("text").rlike(_LETTER))
    if learn_from is not None:
        known = known.where(learn_from)
    known = known.select("text", "lang", F.xxhash64("text").alias("hash"))
    least = Window.partitionBy("lang").orderBy("hash")
    drawn = known.select("lang", "hash").distinct().withColumn("place", F.row_number().over(least)).where(F.col("place") <= sample)
    drawn = drawn.select(F.col("lang").alias("of"), F.col("hash").alias("drawn"))
    # copies are one text; every task sends one of them at most
    chosen = known.join(drawn, (F.col("lang") == F.col("of")) & (F.col("hash") == F.col("drawn"))).groupBy("lang", "hash").agg(F.min("text").alias("text")).select("text", "lang")

    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, x in _rows(batch.column(0)):
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(first, len(x)), pa.array([row.tobytes() for row in x.astype(np.float16)], pa.binary())], ["lang", "vector"])

    found = chosen.mapInArrow(vectorise, "lang string, vector binary").toArrow().combine_chunks()
    rows = sorted(zip(found["lang"].to_pylist(), found["vector"].to_pylist(), strict=True))
    if not rows:
        return None
    return train(np.frombuffer(b"".join(v for _, v in rows), np.float16).reshape(len(rows), -1).astype(np.float32), np.array([code for code, _ in rows]))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` for every row, from the text alone."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, x in _rows(batch.column(1)):
                lang, score = sent.value.predict(x) if sent.value else (np.full(len(x), "und", object), np.zeros(len(x)))
                spoken = pc.match_substring_regex(pc.fill_null(batch.column(1).slice(first, len(x)), ""), _LETTER).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(x)), pa.array(np.where(spoken, lang, "und"), pa.string()), pa.array(np.where(spoken, score, 0.0))], ["doc_id", "lang_pred", "score"]
                )

    return docs.select("doc_id", "text").mapInArrow(apply, f"doc_id {kind}, lang_pred string, score double")
