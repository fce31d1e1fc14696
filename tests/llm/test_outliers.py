"""Quality rules by robust outliers (12) against plain Python and numpy."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmurate.llm import outliers
from murmurate.session import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\t\x0b\x0c\r ", "a", "a a a a", "x y\nx y\n \nx y", "# * $", "é b c 😀", "same", "same", "l\r\nl\r\nl"]


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    runs = list(zip(words, words[1:], words[2:], strict=False))
    count = Counter(runs)
    repeated = {i + k for i, run in enumerate(runs) if count[run] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    numbers = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(repeated))
    return (*numbers, len(words) < 50 or 100 * len(repeated) > 50 * len(words))


def prose(rng, n, symbols=False):
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(n)]
    lines = [words[k : k + 12] for k in range(0, n, 12)]
    return "\n".join(" ".join(w + "###" * symbols for w in line) for line in lines)


def corpus(rng):
    """A hot source with junk in a tenth of its texts, small sources of two languages, one lone text."""
    rows = []
    for k in range(1200):
        lang, source = ("en", "hot") if k % 3 else (rng.choice(["en", "de"]), f"s{k % 60}")
        rows.append((k, prose(rng, rng.randint(50, 400), symbols=k % 10 == 1), lang, source))
    rows += [(2000, prose(rng, 80, True), "xx", "lone"), (2001, prose(rng, 80), None, None)]
    return rows


def reference(rows):
    """The estimates and verdicts by numpy, groups as dictionaries."""
    stats = [plain(text) for _, text, _, _ in rows]
    pair = [(lang, source) for _, _, lang, source in rows]
    n = Counter(p for p, s in zip(pair, stats, strict=True) if not s[5])
    of_lang, rest = Counter(), 0
    for p, count in n.items():
        if count < outliers.LEAST:
            of_lang[p[0]] += count
    rest = sum(c for c in of_lang.values() if c < outliers.LEAST)
    group = [None if s[5] else (1, *p) if n[p] >= outliers.LEAST else (2, p[0]) if of_lang[p[0]] >= outliers.LEAST else (3,) if rest >= outliers.LEAST else None for p, s in zip(pair, stats, strict=True)]
    kept, square = [not s[5] for s in stats], [None] * len(rows)
    floors = np.array(outliers.FLOORS)
    for g in set(group) - {None}:
        at = [k for k in range(len(rows)) if group[k] == g]
        x = np.array([[math.log(s[0]), math.log(s[1] / s[0]), math.sqrt(s[2] / s[0]), math.log(1 + s[3]), math.asin(math.sqrt(s[4] / s[0]))] for s in (stats[k] for k in at)])
        width = floors / outliers.SLOTS
        cells = np.sort(np.floor(x / width), axis=0)
        quarter = lambda k: (cells[math.ceil(len(x) * k / 4) - 1] + 0.5) * width  # noqa: B023, E731
        centre, spread = quarter(2), np.diag(np.maximum((quarter(3) - quarter(1)) / 1.349, floors) ** 2)
        for _ in range(outliers.STEPS):
            away = x - centre
            bins = np.floor(outliers.BINS * np.log(np.einsum("ij,jk,ik->i", away, np.linalg.inv(spread), away) + 1e-9))
            core = x[bins <= np.sort(bins)[math.ceil(outliers.COVERAGE * len(x)) - 1]]
            centre, spread = core.mean(axis=0), outliers.CONSISTENCY * np.cov(core.T, bias=True) + np.diag(floors**2)
        away = x - centre
        for k, d in zip(at, np.einsum("ij,jk,ik->i", away, np.linalg.inv(spread), away), strict=True):
            square[k], kept[k] = d, d <= outliers.CUTOFF
    return stats, square, kept


def judged(docs):
    stats = written(outliers.statistics(docs), "statistics")
    return outliers.judge(stats, outliers.fit(stats))


def test_statistics_equal_plain_python(spark):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choices("ab \n\t#é", k=rng.randint(0, 200))) for _ in range(300)]
    docs = spark.createDataFrame([(k, t, "x", "y", "z") for k, t in enumerate(texts)], "doc_id long, text string, words string, lang string, source string")
    found = {r["document"]["doc_id"]: tuple(r[c] for c in (*outliers.NUMBERS, "base_failed")) for r in outliers.statistics(docs).collect()}
    assert [found[k] for k in range(len(texts))] == [plain(t) for t in texts]


@pytest.mark.parametrize("salted", [False, True])
def test_verdicts_equal_numpy(spark, monkeypatch, salted):
    if salted:
        monkeypatch.setattr(outliers, "BROADCAST", 0)
    rows = corpus(random.Random(2))
    found = {r["document"]["doc_id"]: r for r in judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    stats, square, kept = reference(rows)
    for k, row in enumerate(rows):
        own = found[row[0]]
        assert tuple(own[c] for c in (*outliers.NUMBERS, "base_failed")) == stats[k]
        assert (own["distance"] is None) == (square[k] is None)
        assert square[k] is None or math.isclose(own["distance"], square[k], rel_tol=1e-6, abs_tol=1e-6)
        assert own["kept"] == kept[k]
    junk = {k for k, (_, text, _, _) in enumerate(rows) if "###" in text and rows[k][0] < 2000}
    assert not any(kept[k] for k in junk) and all(kept[k] or stats[k][5] for k in range(len(rows)) if k not in junk)


def test_a_third_of_all_rows_equal_and_a_source_of_copies(spark):
    rng = random.Random(3)
    same = prose(rng, 120)
    rows = [(k, same if k % 3 == 0 else prose(rng, 150), "en", "one") for k in range(600)]
    found = judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert found.where("kept").count() == 600


def test_odd_rows_keep_their_columns_and_repeats(spark):
    rows = [(None if k % 4 == 0 else 7, t, 1, "m", None, "s") for k, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_words int, grp string, lang string, source string")
    found = judged(docs)
    assert found.count() == len(ODD) and not found.where("kept").count()
    assert outliers.accepted(docs).columns == docs.columns
    good = docs.limit(1).withColumn("text", F.lit(prose(random.Random(4), 90)))
    assert [r["n_words"] for r in outliers.accepted(good).collect()] == [1]
    assert judged(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["a" * 5_000_000, " " * 5_000_000, "7" * 5_000_000, "word " * 1_000_000], ids=["letters", "blanks", "digits", "words"])
def test_very_long_texts(spark, text):
    docs = spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string")
    row = outliers.statistics(docs).drop("document").first()
    n = len(text.split())
    assert (row["n_words"], row["word_chars"], row["n_repeat_words"]) == (n, len("".join(text.split())), n if n > 3 else 0)
