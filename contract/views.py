"""Inputs of the registered queries, derived from the given tables.

The derivations are SQL that Spark and DuckDB both read; the checking SQL gets
them as common table expressions. Every row of a table is used.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from murmurate.sources.tables import RUN_TABLES

# Schemas of the table files seen so far, so that a footer is read once.
_SCHEMAS: dict[str, StructType] = {}

AS_OF = "2024-01-31 00:00:00"
RUNS_AS_OF = "2001-08-02 00:00:00"
EXPERIMENT = "ASIA"

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Endings that make every cleaning step fire, one per post in turn.
SUFFIXES = [
    "' Halo @Budi cek https://t.co/AbC &amp; OK'",
    "' awwww yes'",
    "' mail A.B@Example.com now'",
    "concat('  a', chr(160), chr(160), 'b', chr(10), chr(10), 'c', chr(9), ' d ')",
    "' WWW.x.id'",
    "' @josé_1 hi'",
    "' &lt;b&gt; x&y; &'",
    "' @@a'",
    "' HTTP://A b'",
    "' a&amp;b'",
    "concat(' ', chr(28), chr(28), 'a', chr(28), chr(133), 'b \ufeff\ufeffc', chr(133), chr(133), 'd')",
    "' mantap 😂 👍🏽 ❤️ 🇮🇩 🙏 👨‍👩‍👧 👩🏿‍💻 2️⃣ 🤷‍♀️ 🏳️‍🌈 😡'",
    "''",
]

_SUFFIX = "CASE doc_id % 13 " + " ".join(
    f"WHEN {i} THEN {s}" for i, s in enumerate(SUFFIXES)
) + " END"


def _text(x: str) -> str:
    return f"cast({x} AS string)"


# name → (inputs, SQL); a pair of SQL texts where the dialects differ (Spark, DuckDB).
VIEWS: dict[str, tuple[list[str], str | tuple[str, str]]] = {
    # One harvested post per document.
    "posts": (["documents"], f"""
        SELECT {_text('doc_id')} AS id_str,
          {_text('doc_id % 40')} AS conversation_id_str,
          CASE WHEN doc_id % 23 = 0 THEN 'yesterday' ELSE
            concat('Mon Jan ', lpad({_text('1 + doc_id % 28')}, 2, '0'), ' ',
              lpad({_text('doc_id % 24')}, 2, '0'), ':05:09 +0000 2024') END AS created_at,
          concat('https://x.com/user_', {_text('doc_id % 150')}, '/status/', {_text('doc_id')}) AS tweet_url,
          CASE WHEN doc_id % 11 = 0 THEN NULL WHEN lang = 'en' THEN 'in'
            WHEN lang = 'es' THEN 'id' ELSE lang END AS lang,
          concat(text, {_SUFFIX}) AS full_text,
          {_text('doc_id % 150')} AS user_id_str,
          CASE WHEN doc_id % 13 = 0 THEN NULL
            ELSE concat('user_', {_text('doc_id % 150')}) END AS username,
          CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END AS location,
          doc_id % 97 AS favorite_count,
          CASE WHEN doc_id % 19 = 0 THEN NULL ELSE doc_id % 7 END AS quote_count,
          doc_id % 17 AS reply_count,
          doc_id % 31 AS retweet_count,
          CASE WHEN doc_id % 3 = 0 THEN NULL
            ELSE concat('https://pbs/', {_text('doc_id')}, '.jpg') END AS image_url,
          CASE WHEN doc_id % 4 = 0 THEN NULL
            ELSE concat('user_', {_text('doc_id % 149')}) END AS in_reply_to_screen_name
        FROM documents"""),
    # One stored prediction per event.
    "predictions": (["events"], f"""
        SELECT {_text('event_id')} AS id_str,
          {_text('user_id')} AS conversation_id_str,
          ts - interval '1' hour AS created_at,
          CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'en'
            WHEN event_id % 5 = 0 THEN 'id' ELSE 'in' END AS lang,
          CASE WHEN event_id % 13 = 0 THEN NULL
            ELSE concat('user_', {_text('user_id')}) END AS username,
          CASE WHEN event_id % 4 = 0 THEN NULL
            ELSE concat('user_', {_text('event_id % 150')}) END AS in_reply_to_screen_name,
          event_id % 97 AS favorite_count,
          event_id % 31 AS retweet_count,
          event_id % 17 AS reply_count,
          CASE WHEN event_id % 19 = 0 THEN NULL ELSE event_id % 7 END AS quote_count,
          CASE WHEN event_type IN ('purchase', 'signup') THEN 'positive'
            WHEN event_type = 'error' THEN 'negative' ELSE 'neutral' END AS pred_label,
          CASE WHEN event_type IN ('purchase', 'signup') THEN 'LABEL_2'
            WHEN event_type = 'error' THEN 'LABEL_0' ELSE 'LABEL_1' END AS hf_label,
          cast((event_id * 37) % 1000 AS double) / 1000 AS pred_score,
          concat('run_', {_text('event_id % 5')}) AS model_run_id,
          ts AS predicted_at,
          event_id, user_id
        FROM events"""),
    # The same with the text of a document; every document is used in turn.
    "texted": (["predictions", "documents"], """
        SELECT p.*, d.text AS full_text, d.text AS clean_text
        FROM (SELECT *, event_id % (SELECT count(*) FROM documents) AS doc_ref
              FROM predictions) p
        JOIN documents d ON d.doc_id = p.doc_ref"""),
    "experiments": (["region"], "SELECT r_regionkey AS experiment_id, r_name AS name FROM region"),
    "runs": (["orders"], f"""
        SELECT concat('run_', {_text('o_orderkey')}) AS run_uuid,
          concat('job-', {_text('o_orderkey')}) AS name,
          'FINISHED' AS status,
          cast(o_custkey % 5 AS int) AS experiment_id,
          o_orderdate + (o_orderkey % 86400) * interval '1' second AS start_time,
          CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderdate
            + (o_orderkey % 86400 + 60 + (o_orderkey * 7) % 5400) * interval '1' second
            END AS end_time,
          CASE WHEN o_orderstatus = 'P' AND o_orderkey % 10 = 0 THEN o_orderdate
            ELSE NULL END AS deleted_time
        FROM orders"""),
    "metrics": (["lineitem"], f"""
        SELECT concat('run_', {_text('l_orderkey')}) AS run_uuid,
          CASE l_linenumber WHEN 1 THEN 'eval_accuracy' WHEN 2 THEN 'eval_f1_macro'
            WHEN 3 THEN 'eval_loss' ELSE 'train_loss' END AS key,
          l_discount * 5 + l_tax * 5 AS value,
          cast(l_linenumber AS bigint) AS step,
          l_shipdate AS timestamp
        FROM lineitem"""),
    "params": (["orders"], " UNION ALL ".join(
        f"SELECT concat('run_', {_text('o_orderkey')}) AS run_uuid, '{key}' AS key, {value} AS value FROM orders"
        for key, value in {
            "model_accepted": "CASE WHEN o_orderkey % 4 = 0 THEN 'False' ELSE 'True' END",
            "is_incremental": "CASE WHEN o_orderkey % 3 = 0 THEN 'False' ELSE 'True' END",
            "epochs": _text("2 + o_orderkey % 3"),
            "learning_rate": "CASE WHEN o_orderkey % 2 = 0 THEN '2e-05' ELSE '5e-05' END",
            "batch_size": "CASE WHEN o_orderkey % 5 < 2 THEN '16' ELSE '32' END",
            "freeze_layers": "CASE WHEN o_orderkey % 3 = 0 THEN '0' ELSE '6' END",
        }.items())),
    "tags": (["orders"], f"""
        SELECT concat('run_', {_text('o_orderkey')}) AS run_uuid, 'model_status' AS key,
          CASE WHEN o_orderkey % 4 = 0 THEN 'rejected' ELSE 'accepted' END AS value
        FROM orders"""),
    "artifacts": (["orders"], f"""
        SELECT concat('run_', {_text('o_orderkey')}) AS run_uuid,
          CASE WHEN o_orderkey % 4 = 0 THEN 'logs' ELSE 'model' END AS path
        FROM orders"""),
    "versions": (["part"], f"""
        SELECT p_brand AS model_name, p_partkey AS version,
          CASE p_size % 4 WHEN 0 THEN 'Production' WHEN 1 THEN 'Staging'
            WHEN 2 THEN 'Archived' ELSE 'None' END AS stage,
          concat('run_', {_text('p_partkey')}) AS run_uuid
        FROM part"""),
    # One labelled text per label; some without label or with one out of range.
    "labeled": (["labels", "documents"], f"""
        SELECT l.doc_id, {_text('l.doc_id')} AS id_str, d.text AS clean_text,
          CASE WHEN l.doc_id % 17 = 0 THEN NULL WHEN l.doc_id % 29 = 0 THEN '7'
            WHEN l.toxic = 1 THEN '0' WHEN l.quality = 1 THEN '2.0' ELSE '1' END AS label
        FROM labels l JOIN documents d ON d.doc_id = l.doc_id"""),
    "valid": (["labeled"], """
        SELECT doc_id, id_str, clean_text, cast(cast(label AS double) AS bigint) AS label
        FROM labeled WHERE label IN ('0', '1', '2.0')"""),
    # Three numbers from all dimensions of a vector; whole millionths, so that the sums are exact.
    "logits": (["embeddings"], (
        """SELECT vec_id, label % 3 AS y, transform(array(0, 1, 2), k -> cast(aggregate(
            filter(embedding, (x, i) -> i % 3 = k), cast(0 AS bigint),
            (total, x) -> total + cast(floor(cast(x AS double) * 1e6) AS bigint)) AS double) / 1e6) AS logits
          FROM embeddings""",
        """SELECT vec_id, label % 3 AS y, [cast(list_sum([cast(floor(cast(embedding[i] AS double) * 1e6) AS bigint)
            for i in range(k + 1, len(embedding) + 1, 3)]) AS double) / 1e6 for k in [0, 1, 2]] AS logits
          FROM embeddings""",
    )),
    # The same with the text of a document; every document is used in turn.
    "worded": (["logits", "documents"], """
        SELECT l.*, d.text
        FROM (SELECT *, vec_id % (SELECT count(*) FROM documents) AS doc_ref FROM logits) l
        JOIN documents d ON d.doc_id = l.doc_ref"""),
    "pairs": (["logits"], (
        "SELECT y, cast(array_position(logits, array_max(logits)) - 1 AS int) AS yhat FROM logits",
        "SELECT y, cast(list_position(logits, list_max(logits)) - 1 AS int) AS yhat FROM logits",
    )),
}


def _closure(names: list[str]) -> list[str]:
    """The views and tables that the given ones need, inputs first."""
    out: list[str] = []

    def add(name: str) -> None:
        if name in out:
            return
        if name in VIEWS:
            for needed in VIEWS[name][0]:
                add(needed)
        out.append(name)

    for name in names:
        add(name)
    return out


def _with(names: list[str], dialect: int) -> str:
    parts = []
    for name in _closure(names):
        if name in VIEWS:
            sql = VIEWS[name][1]
            parts.append(f"{name} AS ({sql if isinstance(sql, str) else sql[dialect]})")
    return "WITH " + ", ".join(parts) + " " if parts else ""


def check_sql(names: list[str], body: str) -> str:
    """SQL for DuckDB: the views as common table expressions, then ``body``."""
    prefix = _with(names, 1)
    if prefix and body.lstrip()[:15].upper() == "WITH RECURSIVE ":
        return prefix.rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + ", " + body.lstrip()[15:]
    if prefix and body.lstrip()[:5].upper() == "WITH ":
        return prefix.rstrip() + ", " + body.lstrip()[5:]
    return prefix + body


class Tables:
    """The derived inputs as DataFrames, for one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        # Times without zone in the tables are meant, and checked, as UTC.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def view(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self._base(name) if name in BASE else self._derived(name)
        return self._frames[name]

    def _base(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

    def _derived(self, name: str) -> DataFrame:
        for needed in _closure([name]):
            if needed in BASE:
                self.view(needed).createOrReplaceTempView(needed)
        return self.spark.sql(f"{_with([name], 0)}SELECT * FROM {name}")

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS or name in BASE:
            return self.view(name)
        raise AttributeError(name)

    @property
    def runs_tables(self) -> Mapping[str, DataFrame]:
        """The five run tables by name, derived when asked for."""
        return _RunTables(self)


class _RunTables(Mapping):
    def __init__(self, tables: Tables):
        self._tables = tables

    def __getitem__(self, name: str) -> DataFrame:
        if name not in RUN_TABLES:
            raise KeyError(name)
        return self._tables.view(name)

    def __iter__(self):
        return iter(RUN_TABLES)

    def __len__(self) -> int:
        return len(RUN_TABLES)


REGISTRY: dict[str, tuple] = {}


def query(name: str, needs: str = "", sql: str | None = None):
    """Register a query under ``name``; ``needs`` lists the views its SQL uses."""

    def add(fn):
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = (fn, check_sql(needs.split(), sql) if sql else None)
        return fn

    return add
