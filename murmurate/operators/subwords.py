"""Subword features: longest-match segmentation over a vocabulary table, fixed length, attention mask.

A word is cut from its start into the longest pieces of the vocabulary; pieces inside a word
carry a mark. A word that cannot be cut to its end, or that is longer than ``LONGEST_WORD``, is
the unknown piece. Each different word is cut once, by a join of its substrings with the
vocabulary, and the texts meet the words that are left of them after truncation: of a text no more
words are needed than the input has places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurate.operators.learn import tokens
from murmurate.schemas import MAX_TOKENS
from murmurate.session import written

INSIDE, UNKNOWN, FIRST, LAST, PAD = "##", "[UNK]", "[CLS]", "[SEP]", "[PAD]"
LONGEST_WORD = 100


def segment(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``word, pieces`` of the different words; ``vocabulary`` has a column ``piece``."""
    known = vocabulary.select("piece").where("piece IS NOT NULL").distinct()
    inner = F.regexp_replace("piece", f"^{INSIDE}", "")
    longest = known.select(F.max(F.length(inner))).first()[0] or 0
    words = words.select("word").where("word <> ''").distinct()
    starts = words.where(F.length("word") <= LONGEST_WORD).select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("start"))
    sizes = F.sequence(F.lit(1), F.least(F.lit(max(1, longest)), F.length("word") - F.col("start") + 1))
    cut = starts.select("word", "start", F.explode(sizes).alias("size"))
    part = F.substring("word", F.col("start"), F.col("size"))
    cut = cut.withColumn("part", F.when(F.col("start") == 1, part).otherwise(F.concat(F.lit(INSIDE), part)))
    met = cut.join(known, F.col("part") == F.col("piece")).groupBy("word", "start").agg(F.max("size").alias("size"))
    # a row per place of a word, so at most LONGEST_WORD
    sizes = met.groupBy(F.col("word").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("start", "size"))).alias("sizes"))
    walk = F.expr(f"""aggregate(sequence(1, length(word)), named_struct('next', 1, 'pieces', cast(array() AS array<string>)),
        (s, at) -> if(at = s.next AND sizes[at] IS NOT NULL,
            named_struct('next', at + sizes[at], 'pieces', array_append(s.pieces, concat(if(at = 1, '', '{INSIDE}'), substring(word, at, sizes[at])))), s))""")
    walked = words.join(sizes, F.col("word") == F.col("of"), "left").withColumn("walk", F.when(F.col("sizes").isNotNull(), walk))
    whole = F.col("walk.next") == F.length("word") + 1
    return walked.select("word", F.when(whole, F.col("walk.pieces")).otherwise(F.array(F.lit(UNKNOWN))).alias("pieces"))


def encode(df: DataFrame, vocabulary: DataFrame, text: str = "clean_text", length: int = MAX_TOKENS) -> DataFrame:
    """``df`` with ``input_pieces`` of exactly ``length`` places and ``attention_mask`` (1 for a place that is not padding).

    A null text has no words. Rows stay as they are, repeats included.
    """
    room = length - 2
    rows = written(df.withColumns({"_row": F.monotonically_increasing_id(), "_words": F.slice(F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")), 1, room)}), "words")
    each = rows.select("_row", F.posexplode("_words").alias("at", "word"))
    cut = segment(each, vocabulary).withColumnRenamed("word", "of_word")
    met = each.join(cut, F.col("word") == F.col("of_word")).groupBy(F.col("_row").alias("_of")).agg(F.array_sort(F.collect_list(F.struct("at", "pieces"))).alias("_cut"))
    pieces = F.slice(F.flatten(F.coalesce(F.col("_cut.pieces"), F.array().cast("array<array<string>>"))), 1, room)
    filled = F.concat(F.array(F.lit(FIRST)), pieces, F.array(F.lit(LAST)))
    out = rows.join(met, F.col("_row") == F.col("_of"), "left").withColumn("_filled", filled)
    fill = F.lit(length) - F.size("_filled")
    return out.withColumns(
        {
            "input_pieces": F.concat("_filled", F.array_repeat(F.lit(PAD), fill)),
            "attention_mask": F.concat(F.array_repeat(F.lit(1), F.size("_filled")), F.array_repeat(F.lit(0), fill)),
        }
    ).select(*df.columns, "input_pieces", "attention_mask")
