"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only.

A window is as many words of a document as a benchmark item has. Its shingles (runs of
``SHINGLE`` words) give a SimHash of 64 bits. Windows meet items of their size through a
multi-index: the bits are cut into ``BLOCKS`` blocks, the items are posted under every value
within one bit of theirs in each block, and two fingerprints that differ in at most
``RADIUS`` < 2 * BLOCKS bits agree within one bit in some block. So the join finds every
pair within the radius. Each of them is verified by the exact weighted similarity of their
shingles (weight: how often a shingle occurs; least weights over greatest weights).

Windows are opened only where a shingle of some item stands, at the place where the item
would begin. This loses nothing: without a common shingle the similarity is zero. No use is
made of which item that was.

Only windows move between tasks. Spark broadcasts the index if its files are small and
joins by shuffle, splitting hot keys, if not.

Definitions. Words are runs of letters and digits of the lower-cased text. An item of
fewer than ``SHINGLE`` words has all of its words as its one shingle and is found wherever they stand
in a row, so a benchmark should hold no item that is a common phrase. Null and empty texts have no words and match nothing.
A window at the edge of a document is cut there. Repeated documents repeat their matches once
per id; a match of a null id has a null id. Repeated items match each for themselves; items
without id are left out. Of equal matches the first window counts. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmurate.session import written

SHINGLE = 5
SIMILARITY = 0.8
BITS = 64
BLOCKS = 11
RADIUS = 21
_SEPARATOR = r"[^\p{L}\p{N}]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _SEPARATOR), "")


def _shingles(words: str, size: int) -> Column:
    """Hash of the ``size`` words from each place."""
    n = F.size(words)
    hashed = F.transform(F.sequence(F.lit(0), n - F.lit(size)), lambda i: F.xxhash64(*(F.get(words, i + F.lit(k)) for k in range(size))))
    return F.when(n >= size, hashed).otherwise(F.array().cast("array<bigint>"))


def simhash(shingles: str) -> Column:
    """Bit b is set if more shingles have it set than not."""

    def bit(b: Column) -> Column:
        votes = F.aggregate(shingles, F.lit(0), lambda total, h: total + F.when(F.getbit(h, b) == 1, 1).otherwise(-1))
        return F.when(votes > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))

    bits = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), bit)
    return F.aggregate(bits, F.lit(0).cast("long"), lambda total, x: F.call_function("shiftleft", total, F.lit(1)).bitwiseOR(x))


def _limits() -> list[tuple[int, int]]:
    """First bit and width of each block."""
    edges = [k * BITS // BLOCKS for k in range(BLOCKS + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _blocks(fingerprint: Column, neighbours: bool) -> Column:
    """``(block, value)`` for each block; with ``neighbours`` also each value that differs in one bit."""
    out = []
    for k, (first, width) in enumerate(_limits()):
        value = F.shiftrightunsigned(fingerprint, first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        flips = [0, *(1 << b for b in range(width))] if neighbours else [0]
        out += [F.struct(F.lit(k).alias("block"), value.bitwiseXOR(F.lit(x).cast("long")).alias("value")) for x in flips]
    return F.explode(F.array(*out))


def similarity(a: str, b: str) -> Column:
    """Sum of the least over the sum of the greatest weights of the shingles of two lists."""

    def weight(shingles: str, h: Column) -> Column:
        return F.size(F.filter(shingles, lambda x: x == h))

    common = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda total, h: total + F.least(weight(a, h), weight(b, h)))
    return common / (F.size(a) + F.size(b) - common)


def index(benchmark: DataFrame) -> DataFrame:
    """``item_id, n_words, shingle_words, shingles, fingerprint`` of the items that have words."""
    items = benchmark.where(F.col("item_id").isNotNull()).select("item_id", _words(F.col("text")).alias("words")).withColumn("n_words", F.size("words")).where("n_words > 0")
    by_size = F.array().cast("array<bigint>")
    for size in range(1, SHINGLE):
        by_size = F.when(F.col("n_words") == size, _shingles("words", size)).otherwise(by_size)
    items = items.withColumn("shingles", F.when(F.col("n_words") >= SHINGLE, _shingles("words", SHINGLE)).otherwise(by_size))
    return items.select("item_id", "n_words", F.least("n_words", F.lit(SHINGLE)).alias("shingle_words"), "shingles", simhash("shingles").alias("fingerprint"))


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """``doc_id, text_key, item_id, first_word, n_words, distance, similarity``: the best window of each document and item."""
    if radius >= 2 * BLOCKS:
        raise ValueError(f"the index guarantees a radius below {2 * BLOCKS}")
    items = written(index(benchmark), "items")
    sizes = sorted(row["shingle_words"] for row in items.select("shingle_words").distinct().collect())  # at most five rows
    postings = written(items.select("n_words", "shingle_words", F.posexplode("shingles").alias("item_place", "shingle")).distinct(), "item-shingles")
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), _words(F.col("text")).alias("words"))
    opened = None
    for size in sizes or [SHINGLE]:
        # an item of fewer words than a full shingle is one shingle of its own size
        shingled = texts.select("doc_id", "text_key", F.size("words").alias("length"), F.posexplode(_shingles("words", size)).alias("place", "shingle"))
        at = shingled.join(postings.where(F.col("shingle_words") == size).select("n_words", "item_place", F.col("shingle").alias("same")), F.col("shingle") == F.col("same"))
        first = F.greatest(F.col("place") - F.col("item_place"), F.lit(0))
        last = F.least(F.col("place") - F.col("item_place") + F.col("n_words"), F.col("length"))
        found = at.select("doc_id", "text_key", F.lit(size).alias("shingle_words"), "n_words", first.alias("first_word"), (last - first).alias("width"))
        opened = found if opened is None else opened.unionByName(found)
    opened = written(opened.distinct(), "windows")

    known = opened.select(F.col("doc_id").alias("known_id"), F.col("text_key").alias("known_key")).distinct()
    hits = texts.join(known, F.col("doc_id").eqNullSafe(F.col("known_id")) & (F.col("text_key") == F.col("known_key")), "left_semi").dropDuplicates(["doc_id", "text_key"])
    lists = hits.select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), *(_shingles("words", size).alias(f"shingles_{size}") for size in sizes or [SHINGLE]))
    joined = opened.join(lists, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")))
    own = F.array().cast("array<bigint>")
    for size in sizes:
        run = F.slice(f"shingles_{size}", F.col("first_word") + 1, F.greatest(F.col("width") - F.lit(size - 1), F.lit(0)))
        own = F.when(F.col("shingle_words") == size, run).otherwise(own)
    windows = joined.select("doc_id", "text_key", "n_words", "first_word", own.alias("shingles")).withColumn("fingerprint", simhash("shingles"))

    posted = items.select("item_id", F.col("n_words").alias("item_words"), F.col("shingles").alias("item_shingles"), F.col("fingerprint").alias("item_fingerprint"), _blocks(F.col("fingerprint"), True).alias("at")).select("*", "at.block", "at.value").drop("at")
    asked = windows.select("*", _blocks(F.col("fingerprint"), False).alias("at")).select("*", F.col("at.block").alias("own_block"), F.col("at.value").alias("own_value")).drop("at")
    near = asked.join(posted, (F.col("n_words") == F.col("item_words")) & (F.col("own_block") == F.col("block")) & (F.col("own_value") == F.col("value")))
    distance = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint")))
    near = near.withColumn("distance", distance).where(F.col("distance") <= radius).withColumn("similarity", similarity("shingles", "item_shingles")).where(F.col("similarity") >= threshold)
    best = F.max(F.struct("similarity", (-F.col("first_word")).alias("back"), (-F.col("distance")).alias("close"), "n_words"))
    found = near.groupBy("doc_id", "text_key", "item_id").agg(best.alias("best"))
    return found.select("doc_id", "text_key", "item_id", (-F.col("best.back")).alias("first_word"), F.col("best.n_words"), (-F.col("best.close")).alias("distance"), F.col("best.similarity"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, that hold no passage of the benchmark."""
    found = written(matches(docs, benchmark).select(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key")).distinct(), "contaminated")
    return docs.join(found, docs["doc_id"].eqNullSafe(found["found_id"]) & (F.xxhash64(docs["text"]) == found["found_key"]), "left_anti")
