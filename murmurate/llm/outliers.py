"""Quality rules by robust multivariate outliers, in DataFrame functions only.

Every text gets five numbers: words, characters in words, symbols, repeated lines and words
in repeated runs of three. Two fixed rules reject short and repetitive texts. The others are
transformed to a vector that is roughly normal among ordinary texts,

    ln words, ln characters a word, root of symbols a word,
    ln (1 + repeated lines), arc sine of the root of the share of repeated words,

and judged against the texts of the same language and source: a minimum covariance
determinant estimate gives centre and covariance of the ``COVERAGE`` least scattered texts,
and a text whose squared Mahalanobis distance exceeds ``CUTOFF`` is rejected.

The estimate starts from medians and quartile ranges and takes ``STEPS`` concentration steps.
A step measures all texts by the estimate so far, takes the nearest ones up to the coverage and
estimates anew from them, which never raises the determinant. No group is gathered or sorted:
texts are added up by group and logarithmic bin of distance (count, sums and products), and
the bins of a group, some hundreds at most, are summed in order until the coverage is
reached; the last one counts whole. Medians come from counts by group and bin in the same
way. So a source that holds a third of all rows is combined before it is shuffled.

A dimension that does not vary in the core of a group (no symbols at all) has no covariance of
its own; ``FLOORS`` are added as the deviations below which a difference is no evidence. Groups
below ``LEAST`` texts are judged with the other small sources of their language, then with
all small rests together; if those are fewer too, nothing is rejected.

Estimates are a row per group. Up to ``BROADCAST`` of them are sent to the tasks; beyond,
both sides meet by group and one of ``SALTS`` numbers, so a large source is many keys.

Definitions. Words are runs of other characters than blank and the ASCII tab and line
characters. A null text is empty and fails the rule on short texts. Null languages and sources
are values of their own. Rows are judged one by one: repeated rows repeat their result, and ids
play no role. An empty table gives no rows. Very long texts are taken whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmurate.session import written

COVERAGE = 0.6
#: Covariance of the nearest six tenths of a five-dimensional normal sample to that of the whole.
CONSISTENCY = 1.684
#: Chance of a larger squared distance in five normal dimensions: one in seven million.
CUTOFF = 40.0
STEPS = 5
LEAST = 100
FLOORS = (0.4, 0.06, 0.06, 0.5, 0.18)
#: Bins for each doubling of e of the squared distance, and for each floor in a dimension.
BINS, SLOTS = 16, 4
BROADCAST = 10_000
SALTS = 64
SYMBOLS = "#*$%&|<>"

NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_BLANKS = " \t\n\x0b\x0c\r"
_DIMENSIONS = range(len(FLOORS))
_PAIRS = [(i, j) for i in _DIMENSIONS for j in range(i + 1)]


def statistics(docs: DataFrame, carry: list[str] | None = None, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``document`` (a struct of the columns ``carry``, of all by default), ``lang``, ``source``, the numbers and ``base_failed``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry or docs.columns)).alias("document"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), whole.alias("text"))
    found = found.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    found = found.withColumn("runs", F.expr("if(size(words) < 3, cast(array() AS array<string>), transform(sequence(0, size(words) - 3), i -> concat(words[i], ' ', words[i + 1], ' ', words[i + 2])))"))
    # without a repeated run nothing is sorted
    found = found.withColumn("sorted", F.when(F.size(F.array_distinct("runs")) < F.size("runs"), F.array_sort(F.transform("runs", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    starts = F.expr("array_sort(transform(filter(sorted, (s, k) -> coalesce(s.x = get(sorted, k - 1).x, false) OR coalesce(s.x = get(sorted, k + 1).x, false)), s -> s.i))")
    # a run adds the words that the run before it does not hold
    covered = F.expr("aggregate(starts, named_struct('last', -3, 'n', 0L), (t, s) -> named_struct('last', s, 'n', t.n + least(3, s - t.last)), t -> t.n)")
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, _BLANKS, "") != "")
    found = found.withColumn("starts", starts).withColumn("lines", lines)
    found = found.select(
        "document",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", _BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    return found.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def _vector() -> list[Column]:
    each = lambda name: F.col(name) / F.col("n_words")
    values = [F.log("n_words"), F.log(each("word_chars")), F.sqrt(each("n_symbols")), F.log(1 + F.col("n_dup_lines")), F.asin(F.sqrt(each("n_repeat_words")))]
    # texts without words have no vector and fail the first rule anyway
    return [F.when(~F.col("base_failed"), v).alias(f"x{i}") for i, v in enumerate(values)]


def _total(terms: list[Column]) -> Column:
    out = terms[0]
    for term in terms[1:]:
        out = out + term
    return out


def _met(rows: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """Rows with the columns of their group's row; ``row`` numbers the rows, ``n`` is the number of groups."""
    if n <= BROADCAST:
        return rows.join(F.broadcast(groups), "grp", "left")
    dealt = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(dealt, ["grp", "salt"], "left").drop("salt")


def _grouped(stats: DataFrame) -> DataFrame:
    """``lang, source, grp``: which texts each pair of language and source is judged with (null: with none)."""
    sizes = stats.where("NOT base_failed").groupBy("lang", "source").agg(F.count("*").alias("n"))
    small = sizes.where(F.col("n") < LEAST)
    of_lang = small.groupBy(F.col("lang").alias("of_lang")).agg(F.sum("n").alias("n_lang"))
    rest = of_lang.where(F.col("n_lang") < LEAST).agg(F.coalesce(F.sum("n_lang"), F.lit(0)).alias("n_rest"))
    named = lambda level, *columns: F.to_json(F.struct(F.lit(level).alias("level"), *columns))
    found = sizes.join(of_lang, F.col("lang").eqNullSafe(F.col("of_lang")), "left").join(F.broadcast(rest))
    grp = F.when(F.col("n") >= LEAST, named(1, "lang", "source")).when(F.col("n_lang") >= LEAST, named(2, "lang")).when(F.col("n_rest") >= LEAST, named(3))
    return found.select(F.struct("lang", "source").alias("pair"), grp.alias("grp"))


def _start(rows: DataFrame) -> DataFrame:
    """Medians as centres and quartile ranges as deviations, from counts by bins."""
    cells = F.array(*(F.struct(F.lit(i).alias("dim"), F.floor(F.col(f"x{i}") / F.lit(FLOORS[i] / SLOTS)).alias("bin")) for i in _DIMENSIONS))
    counts = rows.select("grp", F.explode(cells).alias("c")).groupBy("grp", "c.dim", "c.bin").agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("grp", "dim").orderBy("bin"))).withColumn("all", F.sum("n").over(Window.partitionBy("grp", "dim")))
    quarter = lambda i, k: (F.min(F.when((F.col("dim") == i) & (4 * F.col("upto") >= k * F.col("all")), F.col("bin"))) + 0.5) * F.lit(FLOORS[i] / SLOTS)
    deviation = lambda i: F.greatest((quarter(i, 3) - quarter(i, 1)) / 1.349, F.lit(FLOORS[i]))
    cells = [quarter(i, 2).alias(f"m{i}") for i in _DIMENSIONS] + [(1 / deviation(i)).alias(f"w{i}{i}") for i in _DIMENSIONS]
    return upto.groupBy("grp").agg(*cells, *(F.lit(0.0).alias(f"w{i}{j}") for i, j in _PAIRS if i > j))


def _whitened(frame: DataFrame) -> DataFrame:
    """The inverse of the lower Cholesky root (``w``) of the covariances ``c``, by rows."""
    for i, j in sorted(_PAIRS, key=lambda p: (p[1], p[0])):
        inner = [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)]
        left = F.col(f"c{i}{j}") - _total(inner) if inner else F.col(f"c{i}{j}")
        frame = frame.withColumn(f"l{i}{j}", F.sqrt(left) if i == j else left / F.col(f"l{j}{j}"))
    for i in _DIMENSIONS:
        for j in range(i, -1, -1):
            inner = [F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)]
            frame = frame.withColumn(f"w{i}{j}", (-_total(inner) if inner else F.lit(1.0)) / F.col(f"l{i}{i}"))
    return frame.select("grp", *(f"m{i}" for i in _DIMENSIONS), *(f"w{i}{j}" for i, j in _PAIRS))


def _distance() -> Column:
    """Squared Mahalanobis distance of a row that has met its estimate."""
    sides = [_total([F.col(f"w{i}{j}") * (F.col(f"x{j}") - F.col(f"m{j}")) for j in range(i + 1)]) for i in _DIMENSIONS]
    return _total([s * s for s in sides])


def _concentrated(rows: DataFrame, estimates: DataFrame, n: int) -> DataFrame:
    """Estimates from the texts nearest by the ones given."""
    near = _met(rows, estimates, n).withColumn("bin", F.floor(BINS * F.log(_distance() + 1e-9)))
    away = [F.col(f"x{i}") - F.col(f"m{i}") for i in _DIMENSIONS]
    sums = [F.sum(away[i]).alias(f"s{i}") for i in _DIMENSIONS] + [F.sum(away[i] * away[j]).alias(f"q{i}{j}") for i, j in _PAIRS]
    binned = near.groupBy("grp", "bin").agg(F.count("*").alias("n"), *sums, *(F.min(f"m{i}").alias(f"m{i}") for i in _DIMENSIONS))
    upto = F.sum("n").over(Window.partitionBy("grp").orderBy("bin"))
    core = binned.withColumn("before", upto - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy("grp"))).where(F.col("before") < COVERAGE * F.col("all"))
    total = core.groupBy("grp").agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in _DIMENSIONS), *(F.sum(f"q{i}{j}").alias(f"q{i}{j}") for i, j in _PAIRS), *(F.min(f"m{i}").alias(f"m{i}") for i in _DIMENSIONS))
    mean = lambda i: F.col(f"s{i}") / F.col("n")
    scatter = lambda i, j: CONSISTENCY * (F.col(f"q{i}{j}") / F.col("n") - mean(i) * mean(j)) + (FLOORS[i] ** 2 if i == j else 0.0)
    return _whitened(total.select("grp", *((F.col(f"m{i}") + mean(i)).alias(f"m{i}") for i in _DIMENSIONS), *(scatter(i, j).alias(f"c{i}{j}") for i, j in _PAIRS)))


@dataclass(frozen=True)
class Estimates:
    """``pairs``: the group of each language and source; ``groups``: centre and whitening of each group."""

    pairs: DataFrame
    groups: DataFrame
    n_pairs: int
    n_groups: int


def _assigned(stats: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """``stats`` with vectors and groups; texts that fail a fixed rule have none."""
    rows = stats.withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("pair", F.struct("lang", "source")).select("*", *_vector())
    known = pairs.withColumnRenamed("grp", "of_pair").withColumn("grp", F.to_json("pair")).drop("pair")
    met = _met(rows.withColumn("grp", F.to_json("pair")), known, n).drop("pair", "grp")
    return met.withColumn("grp", F.when(~F.col("base_failed"), F.col("of_pair"))).drop("of_pair")


def fit(stats: DataFrame) -> Estimates:
    """Minimum covariance determinant estimates over all texts of ``stats``, which is read more than once."""
    pairs = written(_grouped(stats), "pairs")
    n_pairs = pairs.count()
    rows = _assigned(stats, pairs, n_pairs).where("grp IS NOT NULL").select("row", "grp", *(f"x{i}" for i in _DIMENSIONS))
    rows = written(rows, "vectors")
    estimates = written(_start(rows), "start")
    n_groups = estimates.count()
    for _ in range(STEPS):
        estimates = written(_concentrated(rows, estimates, n_groups), "estimates")
    return Estimates(pairs, estimates, n_pairs, n_groups)


def judge(stats: DataFrame, fitted: Estimates) -> DataFrame:
    """``stats`` with ``distance`` (squared; null without an estimate) and ``kept``."""
    met = _met(_assigned(stats, fitted.pairs, fitted.n_pairs), fitted.groups, fitted.n_groups)
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))
    return met.withColumn("distance", _distance()).withColumn("kept", kept).select(*stats.columns, "distance", "kept")


def accepted(docs: DataFrame, **columns: str) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are kept."""
    fitted = fit(written(statistics(docs, docs.columns[:1], **columns), "statistics"))
    return judge(statistics(docs, **columns), fitted).where("kept").select("document.*")
