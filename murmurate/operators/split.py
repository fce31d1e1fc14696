"""Exact stratified split into train and validation rows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmurate.session import scratch

# Hex digits of a hash that make a bucket; each level takes as many more, so a level has 16^4 values at most.
_PREFIX = 4
# Copies of one row that a single task writes out.
_CHUNK = 1_000_000
# Finer and finer: buckets of the key, key, buckets of the whole row.
_LEVELS = ("_key_bucket", "_key_bucket_2", "_key", "_row_bucket", "_row_bucket_2")


def quotas(counts: Mapping[int, int], fraction: float) -> dict[int, int]:
    """Validation rows per class: ``ceil(fraction * n)`` in all, by largest remainder."""
    total = sum(counts.values())
    wanted = math.ceil(round(total * fraction, 9))
    exact = {c: wanted * n / total for c, n in counts.items()}
    out = {c: math.floor(x) for c, x in exact.items()}
    by_remainder = sorted(exact, key=lambda c: (out[c] - exact[c], c))
    for c in by_remainder[: wanted - sum(out.values())]:
        out[c] += 1
    return out


@dataclass
class _Cut:
    """Where the quota of a class ends: the value at each level, and what is still needed there."""

    need: int
    values: list[str] = field(default_factory=list)
    settled: bool = False

    def inside(self) -> Column:
        """Rows that share every value of the cut."""
        same = F.lit(True)
        for name, value in zip(_LEVELS, self.values):
            same = same & (F.col(name) == value)
        return same

    def split(self) -> Column:
        """Part of a row; NULL for a row at a cut that is not settled."""
        if not self.values:
            return F.lit("train")
        out = None
        for name, value in zip(_LEVELS, self.values):
            c = F.col(name)
            out = (F if out is None else out).when(c < value, "validation").when(c > value, "train")
        return out.otherwise(F.lit("validation" if self.settled else None))


def _advance(rows: DataFrame, label: str, cuts: dict[int, _Cut], level: str, n: Column) -> None:
    """Take the cut of each open class one level further, in one aggregate.

    The running count goes over values of the level, not over rows: over buckets,
    or over the keys of one bucket.
    """
    open_cuts = {c: cut for c, cut in cuts.items() if cut.need and not cut.settled}
    if not open_cuts:
        return
    here, need = F.lit(False), F.lit(0).cast("long")
    for c, cut in open_cuts.items():
        here = here | ((F.col(label) == c) & cut.inside())
        need = F.when(F.col(label) == c, cut.need).otherwise(need)
    upto = F.sum("n").over(Window.partitionBy(label).orderBy(level))
    found = (
        rows.where(here)
        .groupBy(label, level)
        .agg(n.alias("n"))
        .withColumns({"upto": upto, "need": need})
        .where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
    )
    # One row per class.
    for r in found.collect():
        cut = cuts[r[label]]
        cut.values.append(r[level])
        cut.need = r.need - (r.upto - r.n)
        cut.settled = cut.need == r.n


def stratified_split(
    df: DataFrame,
    key: Sequence[str],
    label: str = "label",
    fraction: float = 0.2,
    seed: int = 42,
    classes: Sequence[int] | None = None,
) -> DataFrame:
    """Add ``split`` (``train`` / ``validation``) with the exact quota per class.

    Rows go in the order of ``md5(key, seed)``, rows of one key in the order of
    their own hash. A class may hold a third of all rows, and so may a key, so
    neither is ranked as a group. Counts per hash bucket give the bucket in which
    the quota of a class ends, counts per key in that bucket give the key; with
    unique keys all rows are settled then, each by comparing its hash: two passes. Only for
    a key that is repeated at the very cut the rows of one more bucket are
    ranked, with equal rows counted as one, and written out again after that.

    All labels found take part. With ``classes``, a label that is not named fails the
    split, as does a row without label; no row is left out.
    """
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    rows = df.withColumn("_key", digest).withColumns(
        {
            "_key_bucket": F.left("_key", F.lit(_PREFIX)),
            "_key_bucket_2": F.left("_key", F.lit(2 * _PREFIX)),
            "_row_bucket": F.left(F.md5(F.to_json(F.struct(*df.columns))), F.lit(_PREFIX)),
            "_row_bucket_2": F.left(F.md5(F.to_json(F.struct(*df.columns))), F.lit(2 * _PREFIX)),
        }
    )
    each = F.count(F.lit(1))
    with scratch(df.sparkSession) as keep:
        # one pass gives the classes, their quotas and the bucket in which each ends
        buckets = keep(rows.groupBy(label, _LEVELS[0]).agg(each.alias("n")), "buckets")
        counts = {r[label]: r.n for r in buckets.groupBy(label).agg(F.sum("n").alias("n")).collect()}
        unknown = [c for c in counts if c is None or (classes is not None and c not in classes)]
        if unknown:
            raise ValueError(f"rows with labels that cannot be split: {unknown}")
        cuts = {c: _Cut(q) for c, q in quotas(counts, fraction).items()} if counts else {}
        _advance(buckets, label, cuts, _LEVELS[0], F.sum("n"))
    for level in _LEVELS[1:]:
        _advance(rows, label, cuts, level, each)

    split, need = F.lit(None).cast("string"), F.lit(0).cast("long")
    for c, cut in cuts.items():
        split = F.when(F.col(label) == c, cut.split()).otherwise(split)
        need = F.when(F.col(label) == c, cut.need).otherwise(need)
    placed = rows.withColumn("split", split)
    settled = placed.where(F.col("split").isNotNull()).select(*df.columns, "split")
    if all(cut.settled or not cut.values for cut in cuts.values()):
        return settled

    distinct = (
        placed.where(F.col("split").isNull())
        .groupBy(*df.columns)
        .agg(F.count(F.lit(1)).alias("_copies"))
        .withColumn("_need", need)
    )
    order = Window.partitionBy(label).orderBy(F.md5(F.to_json(F.struct(*df.columns))))
    before = F.sum("_copies").over(order.rowsBetween(Window.unboundedPreceding, -1))
    taken = F.greatest(
        F.lit(0), F.least(F.col("_copies"), F.col("_need") - F.coalesce(before, F.lit(0)))
    )
    parts = F.array(
        F.struct(F.lit("validation").alias("split"), F.col("_taken").alias("_n")),
        F.struct(F.lit("train").alias("split"), (F.col("_copies") - F.col("_taken")).alias("_n")),
    )
    ranked = distinct.withColumn("_taken", taken).select(*df.columns, F.inline(parts))
    return settled.unionByName(_copies(ranked.where("_n > 0"), "_n"))


def _copies(df: DataFrame, n: str) -> DataFrame:
    """Every row ``n`` times; many copies of a row are spread over tasks."""
    size = F.lit(_CHUNK).cast("long")
    chunks = df.withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / size)))
    ).hint("rebalance")
    count = F.least(size, F.col(n) - F.col("_chunk") * size)
    return chunks.withColumn(
        "_copy", F.explode(F.sequence(F.lit(1).cast("long"), count))
    ).drop("_chunk", "_copy", n)


def only(df: DataFrame, part: str) -> DataFrame:
    return df.where(F.col("split") == part).drop("split")
