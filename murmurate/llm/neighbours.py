"""Nearest neighbours of largest inner product by collision-counting hashing.

Each vector has one number per random projection, and each projection of a group of vectors
is a sorted array. For a query, windows around its own numbers open in all arrays at once and
widen step by step (virtual rehashing). Edges cut each array into runs of equal length, and the
vectors before each edge are kept in bits; a window ends at the next edges outside, so that its
vectors are two rows of bits apart, and collisions are added 64 vectors to a word. A vector
whose number of collisions reaches ``THRESHOLD`` of the projections is verified by the inner
product of the original vectors in double precision. Where a floor is known (see below), products
in single precision tell first which of them cannot reach it, whatever their rounding.

When the search ends is decided by what it has found and not by a share of the block. The
windows widen until ``SHARE`` of the block, and ``k`` vectors at least, are verified; then
once more, to the width at which a vector as near as the ``k``-th best found so far collides
often enough with probability ``SURE``. Any true neighbour is at least that near, so each is
verified with that probability, whatever the dimension and the lengths are. Vectors without
structure, or of many dimensions, cost more verification and not recall.

Largest inner products become smallest distances by one more coordinate that gives all
vectors of a group the norm of its longest (the query gets zero there). The vectors of a block
are grouped by length, longest first, so that a long vector does not flatten the others. A
group whose longest vector cannot reach the ``k``-th best is left out, which loses nothing.
Blocks and groups of any size are searched alike.

Blocks hold about ``BLOCK`` different vectors and queries come in blocks too. Both are written
once, a file for each block, and every pair of blocks is read from there where it meets: nothing
is copied, shuffled or broadcast for the product, and no task grows with the data, as it reads
so many files as Spark puts into a partition. The first block is searched
first: its ``k``-th best is a floor for the others, whose windows open at once at the width
that a vector as near as the floor needs, and which return nothing below it. Equal vectors are
indexed once, with the ``k + 1`` smallest ids of those that have it: no query can need more of
them.

Definitions. Vectors that are null, empty, zero, or hold null or non-finite components take
no part, neither do rows without id. Vectors are compared within equal dimensions only.
Repeated rows count once; an id with several vectors is near by its best. Ties go to the
smaller id. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from math import comb
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmurate.session import written

PROJECTIONS = 128
THRESHOLD = 0.6
SURE = 0.95
SHARE = 0.02
STEP = 1.2
BLOCK = 16_384
QUERIES = 4096
#: Queries that the first block is searched for at once, which finds their floors.
FIRST = 512
#: Runs of equal length that a sorted array is cut into; a window holds whole runs.
BINS = 128
#: The longest vector of a group has at most this many times the norm of its shortest.
RANGE = 1.2
#: What single precision may take from a distance: the root of its smallest part of one, with room.
ROUNDING = 1e-3
#: Queries whose products in single precision are made at once.
AT_ONCE = 64


def _padded(x: np.ndarray, norm: float) -> np.ndarray:
    rest = np.maximum(norm * norm - np.einsum("ij,ij->i", x, x, dtype=np.float64), 0)
    return np.hstack([x, np.sqrt(rest)[:, None].astype(np.float32)])


def _reach(projections: int, threshold: int, sure: float) -> float:
    """Half a window, in distances, at which a vector meets ``threshold`` of the windows with probability ``sure``."""

    def met(p: float) -> float:
        return sum(comb(projections, c) * p**c * (1 - p) ** (projections - c) for c in range(threshold, projections + 1))

    low, high = 0.0, 1.0
    for _ in range(40):
        p = (low + high) / 2
        low, high = (low, p) if met(p) >= sure else (p, high)
    # a projection of a distance is normal with that distance as deviation
    return NormalDist().inv_cdf((1 + min(high, 1 - 1e-9)) / 2)


def _added(x: list[np.ndarray], y: list[np.ndarray]) -> list[np.ndarray]:
    """Sums of numbers that are given bit by bit, lowest first, 64 numbers to a word."""
    out, carry = [x[0] ^ y[0]], x[0] & y[0]
    for a, b in zip(x[1:], y[1:], strict=True):
        either = a ^ b
        out.append(either ^ carry)
        carry = (a & b) | (either & carry)
    return [*out, carry]


def _reached(windows: np.ndarray, threshold: int) -> np.ndarray:
    """Places whose bits are set in at least ``threshold`` rows of ``windows``."""
    count = [windows]
    while (rows := len(count[0])) > 1:
        if rows % 2:
            count = [np.concatenate((bits, np.zeros_like(bits[:1]))) for bits in count]
        half = (rows + 1) // 2
        count = _added([bits[:half] for bits in count], [bits[half:] for bits in count])
    enough = np.full_like(windows[0], ~np.uint64(0))
    for i, bits in enumerate(count):
        enough = bits[0] & enough if threshold >> i & 1 else bits[0] | enough
    return np.flatnonzero(np.unpackbits(enough.view(np.uint8)).view(bool))


class _Group:
    """The sorted projection arrays of vectors of similar norm; ``rows`` are their places in the block."""

    def __init__(self, rows: np.ndarray, exact: np.ndarray, norm: float, asked: np.ndarray, lines: np.ndarray, threshold: int):
        self.rows, self.exact, self.norm, self.threshold = rows, exact[rows], norm, threshold
        # vectors and queries are scaled to norm one, so that windows have one scale
        self.index, self.asked = _padded((self.exact / norm).astype(np.float32), 1.0), asked
        numbers, self.centres = np.ascontiguousarray((self.index @ lines).T), (asked @ lines).astype(np.float32)
        n, bins = len(rows), min(BINS, len(rows))
        self.edges = np.sort(numbers, axis=1)[:, np.arange(1, bins) * n // bins]
        # the vectors before each edge, in bits: none before the first, all before the last
        before = np.zeros((len(numbers), bins + 1, -(-n // 64)), np.uint64)
        for line, edges, bits in zip(numbers, self.edges, before.view(np.uint8), strict=True):
            bits[1:-1, : -(-n // 8)] = np.packbits(line < edges[:, None], axis=1)
            bits[-1, : -(-n // 8)] = np.packbits(np.ones(n, bool))
        # rows of bits are taken into the same room for each query
        self.bits = before.reshape(-1, before.shape[2])
        self.first = np.arange(len(numbers)) * (bins + 1)
        self.room = np.empty((2, len(numbers), before.shape[2]), np.uint64)
        self.step = 0
        self.rough, self.made = np.zeros((0, n), np.float32), 0

    def _colliding(self, q: int, half: float) -> np.ndarray:
        """Vectors in enough of the windows, which end at the next edges outside."""
        low, high = (np.count_nonzero(self.edges <= (self.centres[q] + np.float32(way * half))[:, None], axis=1) for way in (-1, 1))
        for edge, room in zip((low, high + 1), self.room, strict=True):
            self.bits.take(self.first + edge, axis=0, out=room, mode="clip")
        return _reached(np.bitwise_xor(*self.room, out=self.room[0]), self.threshold)

    def _at(self, q: int, step: int) -> np.ndarray:
        return self._colliding(q, 0.4 * STEP**step)

    def _values(self, found: np.ndarray, query: np.ndarray) -> np.ndarray:
        return (self.exact @ query)[found] if 4 * len(found) > len(self.exact) else self.exact[found] @ query

    def _reaching(self, q: int, found: np.ndarray, least: float) -> np.ndarray:
        """Those of ``found`` whose cosine may be ``least``: no more than single precision errs by is taken off."""
        if not 0 <= q - self.made < len(self.rough):
            self.made = q
            self.rough = self.asked[q : q + AT_ONCE] @ self.index.T
        short = self.rough[q - self.made][found] < least - 2.0**-23 * (self.index.shape[1] + 4)
        return found[~short]

    def verified(self, q: int, query: np.ndarray, enough: int, best: np.ndarray, k: int, reach: float, floor: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Vectors verified and their inner products; ``best`` has the largest ones of the groups before.

        With a ``floor`` among the best, double precision is left to those that may reach the ``k``-th best.
        """
        n = len(self.rows)
        enough = max(enough, k - len(best))
        if enough >= n:
            return self.rows, self.exact @ query
        found, value, half = np.zeros(0, np.int64), np.zeros(0), 0.0
        if enough > 0:
            # the first step with enough, which is the same wherever one starts to look for it
            found = self._at(q, self.step)
            while len(found) < enough:
                self.step += 1
                found = self._at(q, self.step)
            while self.step and len(less := self._at(q, self.step - 1)) >= enough:
                self.step, found = self.step - 1, less
            value, half = self._values(found, query), 0.4 * STEP**self.step
        reached = np.partition(np.concatenate((best, value)), -k)[-k]
        cosine = reached / (float(np.linalg.norm(query)) * self.norm)
        needed = reach * math.sqrt(max(0.0, 2 - 2 * cosine)) + ROUNDING
        if needed > half:
            found = self._colliding(q, needed)
            if floor:
                found = self._reaching(q, found, cosine)
            value = self._values(found, query)
        return self.rows[found], value


def search(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int, share: float = SHARE, projections: int = PROJECTIONS, seed: int = 5, floors: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its number, rows of ``vectors`` with the ``k`` largest verified inner products, and these.

    ``floors`` has for each query the ``k``-th best inner product known from elsewhere, or minus
    infinity; of a query with a floor only products that reach it are looked for and returned.
    """
    n, exact, wanted = len(vectors), vectors.astype(np.float64), queries.astype(np.float64)
    norms = np.linalg.norm(exact, axis=1)
    asked = np.hstack([(wanted / np.linalg.norm(wanted, axis=1, keepdims=True)).astype(np.float32), np.zeros((len(queries), 1), np.float32)])
    lines = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, projections)).astype(np.float32)
    enough, threshold = int(np.ceil(share * n)), int(np.ceil(THRESHOLD * projections))
    reach = _reach(projections, threshold, SURE)
    falling = np.argsort(-norms, kind="stable")
    groups, first = [], 0
    while first < n:
        norm = float(norms[falling[first]])
        last = int(np.searchsorted(-norms[falling], -norm / RANGE, "right"))
        groups.append(_Group(np.sort(falling[first:last]), exact, norm, asked, lines, threshold))
        first = last
    for q, query in enumerate(wanted):
        length = float(np.linalg.norm(query))
        rows, value = np.zeros(0, np.int64), np.zeros(0)
        known = np.full(k if floors is not None and floors[q] > -np.inf else 0, -np.inf if floors is None else floors[q])
        for group in groups:
            best = np.concatenate((known, value))
            best = np.sort(np.partition(best, -k)[-k:] if len(best) > k else best)
            least = 0 if len(known) else max(0, enough - len(rows))
            # the margin is for the rounding of the norms
            if not least and len(best) == k and group.norm * length * (1 + 1e-9) < best[0]:
                break
            more, values = group.verified(q, query, least, best, k, reach, bool(len(known)))
            if len(known):
                more, values = more[values >= known[0]], values[values >= known[0]]
            rows, value = np.concatenate((rows, more)), np.concatenate((value, values))
        near = np.flatnonzero(value >= np.partition(value, -k)[-k]) if len(value) > k else np.arange(len(value))
        top = near[np.lexsort((ids[rows[near]], -value[near]))[:k]]
        yield q, rows[top], value[top]


def _matrix(cells: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block."""
    ids = cells.field("rep").to_numpy()
    flat = cells.field("embedding").flatten().to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), -1)


def _searched(k: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, vectors = _matrix(batch.column(0)[row].values)
                asking = batch.column(1)[row].values
                asked, queries = _matrix(asking)
                out = [(asked[q], ids[rows], values) for q, rows, values in search(vectors, ids, queries, k, share, floors=asking.field("floor").to_numpy())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([q for q, _, _ in out], [len(r) for _, r, _ in out]), pa.int64()), pa.array(np.concatenate([r for _, r, _ in out]), pa.int64()), pa.array(np.concatenate([v for _, _, v in out]))],
                    ["asked", "rep", "score"],
                )

    return run


def _usable(embedding: Column) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & finite & F.exists(embedding, lambda x: x != 0)


def _blocks(rows: DataFrame, blocks: int, name: str, *columns: str) -> DataFrame:
    """One file for each block and dimension, with the block's vectors in an array."""
    dealt = rows.withColumn(name, F.pmod(F.xxhash64("rep"), F.lit(blocks)))
    packed = dealt.groupBy(name, F.size("embedding").alias(f"{name}_dimension")).agg(F.collect_list(F.struct("rep", "embedding", *columns)).alias(f"{name}_rows"))
    return written(packed, f"{name}_blocks", name)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every row of ``vectors`` for which ``is_query`` holds."""
    # single precision stays, everything else is taken as double; minus zero becomes zero
    kind = "float" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    rows = vectors.where(F.col("vec_id").isNotNull() & _usable(F.col("embedding")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast(kind) + F.lit(0.0).cast(kind)).alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    # of equal vectors the smallest ids; Spark keeps that many per task before it shuffles
    smallest = Window.partitionBy("embedding").orderBy("vec_id")
    ranked = rows.select("vec_id", "embedding").withColumn("place", F.dense_rank().over(smallest)).where(F.col("place") <= k + 1)
    distinct = written(ranked.groupBy("embedding").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).withColumn("rep", F.col("ids")[0]), "vectors")
    same = distinct.select(F.col("embedding").alias("same"), "rep")
    queries = written(rows.where("asks").join(same, F.col("embedding") == F.col("same")).select(F.col("vec_id").alias("query_id"), "rep").distinct(), "queries")
    asked = distinct.join(queries.select(F.col("rep").alias("asked")).distinct(), F.col("rep") == F.col("asked"), "left_semi")

    n, m = distinct.count(), queries.select("rep").distinct().count()
    data_blocks = max(1, -(-n // block))

    def searched(data: DataFrame, asked: DataFrame, at_once: int) -> DataFrame:
        """What each block of the index has for each block of the stated queries, which meet once."""
        asking = _blocks(asked, max(1, -(-m // at_once)), "asking", "floor")
        # pairs of files: a shuffle or a broadcast would hold a copy of a block for each block that it meets
        met = data.hint("shuffle_replicate_nl").join(asking, F.col("data_dimension") == F.col("asking_dimension"))
        return met.select("data_rows", "asking_rows").mapInArrow(_searched(k + 1, share), "asked long, rep long, score double")

    data = _blocks(distinct, data_blocks, "data")
    none = F.lit(float("-inf"))
    found = searched(data.where("data = 0"), asked.withColumn("floor", none), FIRST)
    if data_blocks > 1:
        # the k + 1 best of the first block are a floor for what the others have to look for
        found = written(found, "first")
        floors = found.groupBy("asked").agg(F.min("score").alias("floor"), F.count("score").alias("of")).where(F.col("of") > k)
        known = asked.join(floors, F.col("rep") == F.col("asked"), "left").select("rep", "embedding", F.coalesce("floor", none).alias("floor"))
        found = found.unionByName(searched(data.where("data > 0"), known, QUERIES))
    # a query needs no more than k + 1 different vectors, each with its smallest ids
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "rep")
    found = written(found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).drop("place"), "found")
    near = found.join(distinct.select(F.col("rep").alias("of"), "ids"), F.col("rep") == F.col("of")).select("asked", "score", F.explode("ids").alias("vec_id"))
    top = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    near = near.groupBy("asked", "vec_id").agg(F.max("score").alias("score")).withColumn("place", F.row_number().over(top)).where(F.col("place") <= k + 1).drop("place")
    each = queries.join(near, F.col("rep") == F.col("asked")).where("vec_id != query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
