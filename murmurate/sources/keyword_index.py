"""Keyword search by an inverted index of words.

A word of the lower-cased text is posted once per post and day. Postings are Parquet folders by a
hash of the word, ordered by word, with a vocabulary beside them: each word, its folder and how
many posts hold it. A keyword may stand inside a word, so the vocabulary says which words hold it;
then only their folders are read. Keywords go rarest first and each one is asked only of the
posts that are left. What remains is held against the texts, so the result is that of the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurate.functions.text import SPACE_SET, lower
from murmurate.operators.rows import in_days, keyword_search

FOLDERS = 256


def write_index(posts: DataFrame, path: str, key: str = "id_str", text: str = "full_text", at: str = "created_at") -> None:
    """Index all posts that have an id; the vocabulary comes last."""
    words = F.explode(F.array_distinct(F.split(lower(F.col(text)), f"[{SPACE_SET}]+"))).alias("word")
    folder = F.pmod(F.xxhash64("word"), F.lit(FOLDERS)).cast("int")
    postings = posts.where(F.col(key).isNotNull()).select(words, F.to_date(F.col(at)).alias("day"), F.col(key).alias("post")).where("word <> ''").withColumn("folder", folder)
    # a frequent word is split over files, a folder's files hold runs of words
    postings.hint("rebalance", "folder").sortWithinPartitions("folder", "word", "day").write.partitionBy("folder").parquet(f"{path}/postings")
    stored = posts.sparkSession.read.parquet(f"{path}/postings")
    stored.groupBy("word", "folder").agg(F.count("*").alias("posts")).write.parquet(f"{path}/vocabulary")


def _words(vocabulary: DataFrame, keyword: str) -> DataFrame:
    return vocabulary.where(F.col("word").contains(keyword))


def candidates(spark: SparkSession, path: str, words: Sequence[str], since: str | None = None, until: str | None = None) -> DataFrame:
    """Ids of the posts whose words hold every keyword, each blank-separated part in some word."""
    vocabulary, postings = spark.read.parquet(f"{path}/vocabulary"), spark.read.parquet(f"{path}/postings")
    parts = list(dict.fromkeys(part for word in words for part in word.lower().split()))
    found, left = {}, None
    for part in parts:
        # a row per folder, of which there are FOLDERS
        folders = _words(vocabulary, part).groupBy("folder").agg(F.sum("posts").alias("posts")).collect()
        found[part] = ([r.folder for r in folders], sum(r.posts for r in folders))
    for part in sorted(parts, key=lambda p: found[p][1]):
        asked = in_days(postings.where(F.col("folder").isin(found[part][0])), "day", since, until)
        asked = asked.where(F.col("word").contains(part))
        if left is not None:
            asked = asked.join(left, "post", "left_semi")
        left = asked.select("post").distinct()
    return left


def indexed_search(
    posts: DataFrame, path: str, words: Sequence[str], since: str | None = None, until: str | None = None, key: str = "id_str", text: str = "full_text", at: str = "created_at"
) -> DataFrame:
    """As :func:`murmurate.operators.rows.keyword_search` over indexed posts: only candidates are held against the texts."""
    if not any(word.split() for word in words):
        return keyword_search(posts, words, since, until, text=text, at=at)
    found = candidates(posts.sparkSession, path, words, since, until).select(F.col("post").alias("_post"))
    met = posts.join(found, F.col(key) == F.col("_post"), "left_semi")
    return keyword_search(met, words, since, until, text=text, at=at)
