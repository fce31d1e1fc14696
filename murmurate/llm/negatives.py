"""Hard negatives by zone maps over blocks in Hilbert order.

The different vectors, as whole numbers, are written as Parquet blocks along a Hilbert curve, so
that the vectors of a block lie near each other, and each block carries the least and the
largest number of every dimension and the labels it holds. What an anchor looks for is a list
of windows of scores. Interval arithmetic over the zone map gives bounds of the inner product
of the anchor with every vector of a block, and only blocks whose bounds meet a window, and that
hold a label of the wanted kind, are read. Scores are inner products of whole numbers, exact,
so nothing depends on the order of additions.

There are two searches. The first finds the nearest rows of the anchor's own label; its window
begins at the score that ``positives + 1`` vectors of the anchor's surroundings on the curve
reach. The second has a window for each positive, ``low`` to ``high`` per cent of its score; the
scores of the surroundings raise its lower end to that of the last negative wanted, which can
only be passed. Both windows are starts and no limits: a window that the surroundings do not
fill begins at its own end, and every block that may reach into it is read.

How much is spared is up to the data: with clusters a zone map is narrow and most blocks are
left out, with many independent dimensions it is as wide as the data and all are read.

How it is spread: zone maps come in pages of ``PAGE`` blocks and anchors in chunks of
neighbours on the curve; a page meets a chunk in one row and gives the list of blocks to be
read, each with its anchors; that list meets the blocks by a join. Neither zone maps nor
anchors are sent to all tasks, no task holds more than a page, a chunk or a block at once, and
what is read goes down with every block that a bound leaves out.

The curve runs through ``AXES`` principal axes, fitted on the ``SAMPLE`` vectors of least hash;
they decide the order only, never a result.

Definitions. Rows without id, label or vector, or with a null or non-finite component, take no
part. A component x is ``floor(256 x)``, held within the bounds at which a score still is a
64-bit number (some millions). Rows equal in id, label and vector count once; other rows that
share an id are rows of their own. Vectors are compared within equal dimensions, those without
components among themselves. Equal vectors of one label are searched once and keep the smallest
ids, as many as can be returned, so a third of all rows may be equal. Ties go to the smaller
id. An anchor without positives, or a positive without negatives, gives no row; an empty table
none at all. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmurate.session import written

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
SCALE = 256
#: Vectors in a block, blocks around an anchor that give its first scores, zone maps in a page, blocks whose anchors make a chunk.
BLOCK, AROUND, PAGE, CHUNK = 256, 4, 256, 32
#: Axes of the curve and bits for each.
AXES, BITS = 8, 7
SAMPLE = 4096
#: Bytes of vectors in a range of the curve.
RANGE = 32 << 20
_LEAST, _MOST = -(1 << 62), 1 << 62


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points with whole coordinates of ``bits`` bits, a column per axis.

    The coordinates are turned into those of the curve's own frame from the coarsest bit to the
    finest (Skilling's transform), coded by Gray's rule and interleaved.
    """
    x = [cells[:, k].astype(np.int64) for k in range(cells.shape[1])]
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for k in range(len(x)):
            upper = (x[k] >> level & 1).astype(bool)
            swap = np.where(upper, 0, (x[0] ^ x[k]) & below)
            x[0] = np.where(upper, x[0] ^ below, x[0] ^ swap)
            x[k] = x[k] ^ swap if k else x[0]
    for k in range(1, len(x)):
        x[k] = x[k] ^ x[k - 1]
    turn = np.zeros(len(cells), np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0) if x else turn
    place = np.zeros(len(cells), np.int64)
    for level in range(bits - 1, -1, -1):
        for k in range(len(x)):
            place = place << 1 | (x[k] ^ turn) >> level & 1
    return place


def _axes(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mean, principal axes, and least number and width on each axis."""
    mean = sample.mean(axis=0)
    away = sample - mean
    axes = np.linalg.eigh(away.T @ away)[1][:, ::-1][:, :AXES] if sample.shape[1] else np.zeros((0, 0))
    on_axes = away @ axes
    low = on_axes.min(axis=0)
    return mean, axes, low, np.maximum(on_axes.max(axis=0) - low, 1e-9)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole vectors, exact; by floating point where it holds them exactly."""
    largest = lambda x: int(np.abs(x).max(initial=0))
    if a.shape[1] * largest(a) * largest(b) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def bounds(asked: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each vector with any vector between ``low`` and ``high``, a row per block."""
    up, down = np.maximum(asked, 0), np.minimum(asked, 0)
    return products(up, low) + products(down, high), products(up, high) + products(down, low)


def _whole(x: bytes | list[bytes], n: int, width: int) -> np.ndarray:
    return np.frombuffer(x if isinstance(x, bytes) else b"".join(x), "<i4").astype(np.int64).reshape(n, width)


def _entries(vectors: DataFrame, is_anchor: Column, label: Column, keep: int) -> tuple[DataFrame, DataFrame]:
    """The different vectors of each label with their smallest ids, and the anchors."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    # the bound keeps 95 times a score within 64 bits
    bound = F.floor(F.sqrt(F.lit(2.0**54) / F.greatest(F.size("embedding"), F.lit(1)))).cast("double")
    q = F.transform("embedding", lambda x: F.floor(F.greatest(-bound, F.least(bound, F.lit(float(SCALE)) * x))).cast("int"))
    rows = rows.where("label IS NOT NULL").select("vec_id", "label", "asks", q.alias("q"))
    rows = written(rows, "vectors")
    smallest = Window.partitionBy("q", "label").orderBy("vec_id")
    # Spark keeps that many per task before it shuffles
    ranked = rows.select("q", "label", "vec_id").withColumn("place", F.dense_rank().over(smallest)).where(F.col("place") <= keep)
    ids = ranked.groupBy("q", "label").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    anchors = rows.where("asks").select("vec_id", F.col("label").alias("of_label"), F.col("q").alias("of_q")).distinct()
    same = (F.col("q") == F.col("of_q")) & (F.col("label") == F.col("of_label"))
    entries = ids.join(anchors.select("of_q", "of_label").distinct(), same, "left").select("q", "label", "ids", F.col("of_q").isNotNull().alias("asks"))
    # numbers of rows are fixed once they are written
    entries = written(entries.withColumn("entry", F.monotonically_increasing_id()), "entries")
    return entries, written(anchors.join(entries, same).select(F.col("vec_id").alias("anchor_id"), F.col("entry").alias("of_entry")), "anchors")


def _placed(entries: DataFrame) -> DataFrame:
    """Entries with the dimension and their place on the curve; vectors become bytes."""
    picked = entries.select("q").orderBy(F.xxhash64("q"), "q").limit(SAMPLE).toArrow().column("q").to_pylist()
    of_width: dict[int, list[list[int]]] = {}
    for q in picked:
        of_width.setdefault(len(q), []).append(q)
    # a fixed number of vectors, so their axes may go along with the code
    fitted = {width: _axes(np.array(q, np.float64).reshape(len(q), width)) for width, q in of_width.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.array(x, np.int64) for x in batch.column(0).to_pylist()]
            keys = np.zeros(len(vectors), np.int64)
            for width in {len(x) for x in vectors} & fitted.keys() - {0}:
                mean, axes, low, size = fitted[width]
                rows = [k for k, x in enumerate(vectors) if len(x) == width]
                on_axes = (np.stack([vectors[k] for k in rows]) - mean) @ axes
                keys[rows] = hilbert(np.clip((on_axes - low) / size * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(x) for x in vectors], pa.int32()), pa.array(keys), pa.array([x.astype("<i4").tobytes() for x in vectors], pa.binary()), *(batch.column(k) for k in (1, 2, 3, 4))],
                ["width", "place", "q", "label", "ids", "asks", "entry"],
            )

    return entries.select("q", "label", "ids", "asks", "entry").mapInArrow(place, "width int, place long, q binary, label long, ids array<long>, asks boolean, entry long")


_ASKED = "array<struct<entry: long, label: long, q: binary, floor: long, others: binary>>"
_BLOCK = f"part int, at int, width int, low array<int>, high array<int>, holds array<long>, ids array<array<long>>, labels array<long>, entries array<long>, q binary, asked {_ASKED}"


def _surroundings(rows: list[dict], q: np.ndarray, labels: np.ndarray, keep: int, block: int) -> list[list[dict]]:
    """For each block of a stretch of the curve, its anchors with the scores that the stretch gives."""
    out: list[list[dict]] = [[] for _ in range(0, len(rows), block)]
    at = [k for k, row in enumerate(rows) if row["asks"]]
    for k, scores in zip(at, products(q[at], q), strict=True):
        own = np.sort(scores[labels == labels[k]])[::-1]
        others = np.sort(scores[labels != labels[k]])
        out[k // block].append({"entry": rows[k]["entry"], "label": int(labels[k]), "q": rows[k]["q"], "floor": int(own[keep - 1]) if len(own) >= keep else _LEAST, "others": others.astype("<i8").tobytes()})
    return out


def _cut(keep: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, held = TaskContext.get().partitionId(), 0, []

        def blocks() -> pa.RecordBatch:
            nonlocal at
            width = held[0]["width"]
            q, labels = _whole([r["q"] for r in held], len(held), width), np.array([r["label"] for r in held])
            asked = _surroundings(held, q, labels, keep, block)
            out = []
            for k, anchors in enumerate(asked):
                rows, own = held[k * block : (k + 1) * block], q[k * block : (k + 1) * block]
                names = labels[k * block : (k + 1) * block]
                out.append({"part": part, "at": at, "width": width, "low": own.min(axis=0).tolist(), "high": own.max(axis=0).tolist(), "holds": np.unique(names).tolist(), "ids": [r["ids"] for r in rows], "labels": names.tolist(), "entries": [r["entry"] for r in rows], "q": b"".join(r["q"] for r in rows), "asked": anchors})
                at += 1
            held.clear()
            return pa.RecordBatch.from_pylist(out, schema=_arrow_of_block())

        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["width"] != held[0]["width"] or len(held) == AROUND * block):
                    yield blocks()
                held.append(row)
        if held:
            yield blocks()

    return run


def _arrow_of_block() -> pa.Schema:
    long = pa.int64()
    asked = pa.struct([("entry", long), ("label", long), ("q", pa.binary()), ("floor", long), ("others", pa.binary())])
    return pa.schema([
        ("part", pa.int32()), ("at", pa.int32()), ("width", pa.int32()), ("low", pa.list_(pa.int32())), ("high", pa.list_(pa.int32())),
        ("holds", pa.list_(long)), ("ids", pa.list_(pa.list_(long))), ("labels", pa.list_(long)), ("entries", pa.list_(long)), ("q", pa.binary()), ("asked", pa.list_(asked)),
    ])


def blocked(placed: DataFrame, keep: int, block: int = BLOCK) -> DataFrame:
    """The blocks in the order of the curve, numbered from 0, with their zone maps and anchors; equal places are split by a hash."""
    size = placed.agg(F.sum(F.length("q") + F.lit(64)).alias("bytes")).first()["bytes"] or 0
    ranged = placed.withColumn("tie", F.xxhash64("q", "label")).repartitionByRange(max(1, math.ceil(size / RANGE)), "width", "place", "tie")
    rows = ranged.sortWithinPartitions("width", "place", "tie", "q", "label").drop("tie", "place")
    blocks = written(rows.select("width", "q", "label", "ids", "asks", "entry").mapInArrow(_cut(keep, block), _BLOCK), "blocks")
    # one row per task of the pass before
    totals = blocks.groupBy("part").agg(F.count("*").alias("blocks"))
    before = F.expr("sum(blocks) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    bases = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    return blocks.join(F.broadcast(bases), "part").withColumn("block", F.col("base") + F.col("at")).drop("base", "part", "at")


def _listed(same: bool):
    """For each page of zone maps and chunk of anchors: the blocks to be read, each with its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                asked, zones = batch.column(0)[row].values, batch.column(1)[row].values
                q = [x or b"" for x in asked.field("q").to_pylist()]
                width = len(q[0]) // 4
                low, high = (zones.field(f).flatten().to_numpy().astype(np.int64).reshape(len(zones), width) for f in ("low", "high"))
                least, most = bounds(_whole(q, len(q), width), low, high)
                labels, holds = asked.field("label").to_numpy(), zones.field("holds")
                number = np.diff(holds.offsets.to_numpy())
                of_block, flat = np.repeat(np.arange(len(zones)), number), holds.flatten().to_numpy()
                wanted = np.zeros(least.shape, bool)
                for label in np.unique(labels):
                    has = np.bincount(of_block[flat == label], minlength=len(zones)) > 0
                    wanted[labels == label] = has if same else number > has
                met = np.zeros(least.shape, bool)
                lows, highs = (asked.field(f) for f in ("low", "high"))
                of_asked = np.repeat(np.arange(len(asked)), np.diff(lows.offsets.to_numpy()))
                for k, start, end in zip(of_asked.tolist(), lows.flatten().to_pylist(), highs.flatten().to_pylist(), strict=True):
                    met[k] |= (most[k] >= start) & (least[k] <= end)
                block, who = np.nonzero((wanted & met).T)
                read, count = np.unique(block, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [zones.field("block").take(pa.array(read)), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), asked.take(pa.array(who)))], ["block", "asked"]
                )

    return run


def _read(same: bool, keep: int):
    """The best rows of a block for each window of the anchors that read it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                asked = batch.column(0)[row].values
                labels, ids = batch.column(1)[row].values.to_numpy(), batch.column(2)[row].as_py()
                q = [x or b"" for x in asked.field("q").to_pylist()]
                width = len(q[0]) // 4
                numbers = batch.column(4)[row].values.to_numpy()
                scores = products(_whole(q, len(q), width), _whole(batch.column(3)[row].as_py() or b"", len(labels), width))
                kind = (asked.field("label").to_numpy()[:, None] == labels[None]) == same
                lows, highs = asked.field("low").to_pylist(), asked.field("high").to_pylist()
                first = np.array([x[0] for x in ids])
                out: list[tuple] = []
                for window in range(max(map(len, lows))):
                    start = np.array([x[window] if window < len(x) else 1 for x in lows])
                    end = np.array([x[window] if window < len(x) else 0 for x in highs])
                    who, which = np.nonzero(kind & (scores >= start[:, None]) & (scores <= end[:, None]))
                    value = scores[who, which]
                    order = np.lexsort((first[which], -value, who))
                    who, which, value = who[order], which[order], value[order]
                    rank = np.arange(len(who)) - np.searchsorted(who, who)
                    for k, x, v in zip(*(a[rank < keep].tolist() for a in (who, which, value)), strict=True):
                        # the smallest ids of an entry are all it may need
                        out += [(k, window, v, x, i) for i in ids[x][:keep]]
                who, window, value, which, found = zip(*out, strict=True) if out else ((),) * 5
                entries = asked.field("entry").to_numpy()[np.array(who, np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(entries, pa.int64()), pa.array(window, pa.int32()), pa.array(value, pa.int64()), pa.array(numbers[np.array(which, np.int64)], pa.int64()), pa.array(found, pa.int64())],
                    ["entry", "window", "score", "of", "vec_id"],
                )

    return run


def _searched(asking: DataFrame, blocks: DataFrame, n_blocks: int, page: int, same: bool, keep: int) -> DataFrame:
    """``entry, window, place, score, of, vec_id``: the first ``keep`` rows in each window of every anchor.

    ``asking`` has ``entry, chunk, width, label, q`` and the lists ``low`` and ``high`` of windows.
    """
    zones = blocks.groupBy(F.col("width").alias("of_width"), F.expr(f"block div {page}").alias("page")).agg(F.collect_list(F.struct("block", "low", "high", "holds")).alias("zones"))
    chunks = asking.where(F.size("low") > 0).groupBy("width", "chunk").agg(F.collect_list(F.struct("entry", "label", "q", "low", "high")).alias("asked"))
    # the stated anchors against all zone maps, in chunks and pages
    met = chunks.withColumn("of_page", F.explode(F.sequence(F.lit(0), F.lit((n_blocks - 1) // page))))
    met = met.join(zones.hint("merge"), (F.col("of_page") == F.col("page")) & (F.col("width") == F.col("of_width")))
    asked = "array<struct<entry: long, label: long, q: binary, low: array<long>, high: array<long>>>"
    listed = met.select("asked", "zones").mapInArrow(_listed(same), f"to_read long, asked {asked}")
    read = listed.join(blocks.select("block", "labels", "ids", F.col("q").alias("vectors"), "entries").hint("merge"), F.col("to_read") == F.col("block"))
    found = read.select("asked", "labels", "ids", "vectors", "entries").mapInArrow(_read(same, keep), "entry long, window int, score long, of long, vec_id long")
    best = Window.partitionBy("entry", "window").orderBy(F.desc("score"), "vec_id", "of")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= keep)


def mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK, page: int = PAGE, chunk: int = CHUNK) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows of ``vectors`` for which ``is_anchor`` holds."""
    keep = positives + 1  # one of them may be the anchor itself
    entries, anchors = _entries(vectors, is_anchor, label, max(keep, negatives))
    placed = written(_placed(entries), "placed")
    blocks = written(blocked(placed, keep, block), "numbered")
    n_blocks = max(1, blocks.count())
    asking = blocks.select("width", F.expr(f"block div {chunk}").alias("chunk"), F.explode("asked").alias("x")).select("width", "chunk", "x.*")
    blocks = blocks.drop("asked")

    window = lambda least, most: (F.array(least).alias("low"), F.array(most).alias("high"))
    near = written(_searched(asking.select("entry", "chunk", "width", "label", "q", *window(F.col("floor"), F.lit(_MOST))), blocks, n_blocks, page, True, keep), "near")
    positive = near.groupBy(F.col("entry").alias("near_of")).agg(F.array_sort(F.collect_list(F.struct("place", "score", "of", "vec_id"))).alias("positives"))
    asking = written(asking.join(positive.hint("merge"), F.col("entry") == F.col("near_of")).drop("near_of"), "asking")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = [], []
            for others, found in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True):
                known = np.frombuffer(others, "<i8")
                scores = [x["score"] for x in found]
                end = [high * s // 100 for s in scores]
                upto = np.searchsorted(known, end, "right")
                starts.append([max(-(-low * s // 100), int(known[k - negatives]) if k >= negatives else _LEAST) for s, k in zip(scores, upto.tolist(), strict=True)])
                ends.append(end)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], ["entry", "chunk", "width", "label", "q", "low", "high"])

    asked = asking.select("entry", "chunk", "width", "label", "q", "others", "positives").mapInArrow(windows, "entry long, chunk long, width int, label long, q binary, low array<long>, high array<long>")
    far = written(_searched(asked, blocks, n_blocks, page, False, negatives), "far")
    negative = far.groupBy(F.col("entry").alias("far_of"), "window").agg(F.array_sort(F.collect_list(F.struct("place", "score", "vec_id"))).alias("negatives"))

    # each anchor takes the positives of its vector but itself, and what was found for each
    each = asking.select("entry", F.posexplode("positives").alias("at", "p")).join(negative.hint("merge"), (F.col("entry") == F.col("far_of")) & (F.col("at") == F.col("window")), "left")
    found = F.struct(F.col("p.place").alias("place"), F.col("p.score").alias("score"), F.col("p.of").alias("of"), F.col("p.vec_id").alias("vec_id"), "negatives")
    listed = each.groupBy("entry").agg(F.array_sort(F.collect_list(found)).alias("positives"))
    met = anchors.join(listed, F.col("of_entry") == F.col("entry"))
    others = F.slice(F.filter("positives", lambda p: ~((p.vec_id == F.col("anchor_id")) & (p.of == F.col("entry")))), 1, positives)
    pairs = met.select("anchor_id", F.explode(others).alias("p")).select("anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("p.score").alias("positive_score"), F.explode("p.negatives").alias("n"))
    return pairs.select("anchor_id", "positive_id", F.col("n.place").alias("rank"), F.col("n.vec_id").alias("negative_id"), "positive_score", F.col("n.score").alias("negative_score"))
