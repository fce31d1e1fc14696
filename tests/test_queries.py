"""Every registered query against its SQL at the smallest scale."""

import check
import pytest

import __spark_entry__ as entry
from contract import REGISTRY

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return check.database(FOLDER)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_equals_sql(spark, db, name):
    ok, text = check.compare(spark, db, FOLDER, name)
    assert ok, text


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 3


def test_reports_are_ordered(spark):
    q = entry.queries()
    counts = [r["count"] for r in q["q11_sentiment_share"](spark, FOLDER).collect()]
    assert counts == sorted(counts, reverse=True)
    times = [r.time for r in q["q17_feed"](spark, FOLDER).collect()]
    assert times == sorted(times, reverse=True)
    days = [r.date for r in q["q20_daily_summary"](spark, FOLDER).collect()]
    assert days == sorted(days, reverse=True)
    rows = [(r.lang is None, r.lang or "", -r.n) for r in q["sort_multi"](spark, FOLDER).collect()]
    assert rows == sorted(rows)


def test_every_query_has_its_sql():
    assert not [n for n, (_, sql) in REGISTRY.items() if not sql]


def test_names_are_plain():
    assert not [n for n in REGISTRY if n.startswith(("pipeline", "op"))]
    assert set(REGISTRY) <= set(entry.queries())
