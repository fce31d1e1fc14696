"""The registered queries of the numbered operators, each over its whole table.

A query reads its tables, applies the operator with production parameters and keeps the
columns that its contract names. ``SQL`` holds the checking statements of those that SQL
can express.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurate.llm import crosstoken, decontaminate, language, licenses, neardup, negatives, neighbours, outliers, outliers_sql, packing, pii, quality, scoring, warc
from murmurate.session import work_path, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: The two tokenisers that are aligned.
BYTE_PIECES, SENTENCE_PIECES = VOCABULARY, public_tokenizers.path("piece_bpe_32k.model")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def importable(spark: SparkSession) -> None:
    """Lets Python workers that share this machine's files import the package; a cluster gets it by ``--py-files``."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in path:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, *path]))


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _fold(parts: int):
    """Which part of the documents a row belongs to, by the checksum of its id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts))


@query
def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = language.fit(docs, learn_from=F.coalesce(_fold(4), F.lit(0)) != 2)
    found = language.identify(docs, model)
    return found.select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.matches(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "first_word", "n_words", "distance", "similarity")


@query
def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(_table(spark, folder, "documents"))
    return found.select("doc_id", *(f"n_{kind}" for kind in pii.BASE), "base_sha256", "spans")


@query
def op4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    archive = work_path(spark, "warc")
    warc.write(_table(spark, folder, "pages"), archive)
    return warc.read(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(_table(spark, folder, "documents"), VOCABULARY, public_tokenizers.PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op7_cross_entropy(spark: SparkSession, folder: str) -> DataFrame:
    """Documents labelled as of good quality and not toxic are the target, all documents the background."""
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    good = labels.where("quality = 1 AND toxic = 0").select(F.col("doc_id").alias("good_id")).distinct()
    # the labels grow with the documents, so they meet by a shuffle at every size
    marked = docs.select("doc_id", "text").join(good.hint("merge"), F.col("doc_id") == F.col("good_id"), "left")
    return scoring.score(docs, scoring.fit(marked, F.col("good_id").isNotNull()))


def learned_quality(spark: SparkSession, folder: str) -> quality.Model:
    return quality.fit(_table(spark, folder, "documents"), _table(spark, folder, "labels"), learn_from=_fold(3) != 1)


@query
def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.scores(_table(spark, folder, "documents"), learned_quality(spark, folder))
    return found.select("doc_id", F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op9_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, folder, "documents"), size=2)


@query
def op10_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query
def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    found = crosstoken.align(_table(spark, folder, "documents"), BYTE_PIECES, SENTENCE_PIECES, public_tokenizers.PATTERN)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query
def op12_outliers(spark: SparkSession, folder: str) -> DataFrame:
    stats = written(outliers.statistics(_table(spark, folder, "documents"), ["doc_id"]), "statistics")
    return outliers.judge(stats, outliers.fit(stats)).select("document.doc_id", *outliers.NUMBERS, "base_failed", "kept")


@query
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of every seventh id are moved on by one, as mislabelled rows would be."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, label)


@query
def licenses_base(spark: SparkSession, folder: str) -> DataFrame:
    """The part of operator 10 that SQL can express: words, and the places of the base phrases."""
    found = licenses.scan(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


@query
def pii_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The part of operator 3 that SQL can express: how many base spans of each kind a document has."""
    return pii.find(_table(spark, folder, "documents")).select("doc_id", *(f"n_{kind}" for kind in pii.BASE))


_BITS = [f"{k:04b}" for k in range(16)]

SQL["op5_warc"] = f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
      b AS (SELECT page_id, payload, min(page_id) OVER (PARTITION BY payload) AS first_id,
          array_to_string([{_BITS}[strpos('0123456789abcdef', c)] for c in string_split(sha1(payload), '')], '') AS bits
        FROM p)
    SELECT page_id, cast(octet_length(encode(payload)) AS bigint) AS payload_bytes,
      array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * cast(bits[5 * i + 1] AS int)
          + 8 * cast(bits[5 * i + 2] AS int) + 4 * cast(bits[5 * i + 3] AS int)
          + 2 * cast(bits[5 * i + 4] AS int) + cast(bits[5 * i + 5] AS int), 1) for i in range(32)], '') AS payload_digest,
      CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> first_id THEN first_id END AS refers_to
    FROM b"""

SQL["op9_minhash"] = r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, list_filter(regexp_split_to_array(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
        FROM documents),
      sets AS (
        SELECT doc_id, CASE WHEN len(w) < 2 THEN w
          ELSE list_distinct([concat(w[i], ' ', w[i + 1]) for i in range(1, len(w))]) END AS s FROM words),
      shingles AS (SELECT doc_id, unnest(s) AS g FROM sets),
      common AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
        FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
      links AS (
        SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
        WHERE 100 * n >= 80 * (len(x.s) + len(y.s) - n)),
      both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
      reached AS (
        SELECT doc_id, doc_id AS other FROM documents
        UNION SELECT r.doc_id, l.b FROM reached r JOIN both_ways l ON l.a = r.other)
    SELECT s.doc_id, cast(len(s.s) AS bigint) AS n_shingles, min(r.other) AS component_id,
      s.doc_id = min(r.other) AS kept
    FROM sets s JOIN reached r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.s"""

SQL["op12_outliers"] = outliers_sql.sql()

SQL["op13_hard_negatives"] = """
    WITH usable AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
          list_transform(embedding, lambda x: cast(floor(256 * cast(x AS double)) AS bigint)) AS q
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      parts AS (SELECT vec_id, label, unnest(q) AS x, unnest(range(len(q))) AS d FROM usable),
      scores AS (
        SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, cast(sum(a.x * b.x) AS bigint) AS score
        FROM parts a JOIN parts b ON a.d = b.d AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 GROUP BY ALL),
      positives AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE label = anchor_label
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT p.anchor_id, positive_id, cast(row_number() OVER w AS int) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label
      AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)
    QUALIFY row_number() OVER w <= 3"""

_PHRASES = {phrase: f"[{', '.join(repr(w) for w in phrase.split())}]" for phrase in licenses.BASE}
_FOUND = [f"[i for i in range(len(w)) if w[i + 1:i + {len(p.split())}] = {words}]" for p, words in _PHRASES.items()]

SQL["licenses_base"] = rf"""
    WITH words AS (
        SELECT doc_id, list_filter(regexp_split_to_array(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
      found AS (SELECT doc_id, w, [{", ".join(_FOUND)}] AS each, {list(licenses.BASE.values())} AS labels FROM words)
    SELECT doc_id, cast(len(w) AS bigint) AS n_words, cast(len(flatten(each)) AS bigint) AS n_base,
      cast(list_min(flatten(each)) AS bigint) AS first_word, cast(list_max(flatten(each)) AS bigint) AS last_word,
      array_to_string(list_sort(list_distinct([labels[k] for k in range(1, len(labels) + 1) if len(each[k]) > 0])), ',') AS base_labels
    FROM found"""

SQL["pii_counts"] = r"""
    WITH spans AS (
        SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS emails,
          regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ips,
          [regexp_replace(x, '[^0-9]', '', 'g') for x in regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+')] AS cards,
          [regexp_replace(x, '[^0-9]', '', 'g') for x in regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]')] AS phones
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
    SELECT doc_id, cast(len(emails) AS bigint) AS n_email,
      cast(len([x for x in ips if list_max([cast(p AS hugeint) for p in string_split(right(x, 100), '.')]) <= 255]) AS bigint) AS n_ip,
      cast(len([x for x in cards if len(x) BETWEEN 16 AND 19 AND list_sum([
          CASE WHEN k % 2 = 0 THEN cast(reverse(x)[k + 1] AS int)
            ELSE cast(reverse(x)[k + 1] AS int) * 2 - CASE WHEN reverse(x)[k + 1] >= '5' THEN 9 ELSE 0 END END for k in range(len(x))]) % 10 = 0]) AS bigint) AS n_card,
      cast(len([x for x in phones if len(x) BETWEEN 8 AND 15]) AS bigint) AS n_phone
    FROM spans"""
