"""Alignment of two tokenisations of the same text by galloping intersection.

Both tokenisers cut the same bytes, so each gives a sorted list of byte offsets at which its
tokens end. The shorter list drives: each of its ends is searched in the longer one, from the
place of an end before it by steps of doubling size, then by halving. Offsets in both lists
cut the text into groups, the least runs of tokens of one side that cover the same bytes as a
run of the other side; the difference of two neighbouring ranks is the range of tokens that a
token overlaps. The ends of many documents stand in one list, as each starts where the one
before it ends on both sides, so a search is a few array operations for a block of documents.

Counts over the corpus are gathered in blocks of documents: a block lists its different
pairs of ids once, these lists are added up to the pair counts, and the counts return to the
blocks by a join on the pair. A pair that stands in every document is a row per block and
not per document, so neither side has a hot key. Blocks hold ``BLOCK`` bytes of text, or one
text that is longer; memory follows the longest text.

Definitions. A text that is null or empty, or that one of the tokenisers does not give back
byte by byte, has no tokens: its numbers are zero and its groups are the empty string. Rows
are documents of their own; rows with the same id or text, or without id, stay and each counts
for the pairs. An empty table gives no rows. Columns besides the id and the text are ignored.
Very long texts are whole and are a block of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmurate.llm import tokens
from murmurate.session import written

BLOCK = 2 << 20
#: Every so many ends of the shorter list are searched first; those between start from the one before.
STRIDE = 8


def gallop(keys: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each of the rising ``keys``, how many of the rising ``ends`` lie before it."""
    low = np.repeat(gallop(keys[::STRIDE], ends), STRIDE)[: len(keys)] if len(keys) > 1 else np.zeros(len(keys), np.int64)
    high, active, step = np.full(len(keys), len(ends), np.int64), np.arange(len(keys)), 1
    while len(active):
        probe = np.minimum(low[active] + step - 1, len(ends))
        passed = (probe < len(ends)) & (ends[np.minimum(probe, len(ends) - 1)] < keys[active]) if len(ends) else np.zeros(len(active), bool)
        high[active[~passed]] = probe[~passed]
        active = active[passed]
        low[active] = probe[passed] + 1
        step *= 2
    active = np.flatnonzero(low < high)
    while len(active):
        middle = (low[active] + high[active]) >> 1
        less = ends[middle] < keys[active]
        low[active[less]] = middle[less] + 1
        high[active[~less]] = middle[~less]
        active = active[low[active] < high[active]]
    return low


def overlaps(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links ``(short token, long token)``, and the last token of each group on either side, from the two lists of ends.

    Both lists end at the same offset.
    """
    before = gallop(short, long)
    common = long[before] == short if len(short) else np.zeros(0, bool)
    first = np.concatenate(([0], (before + common)[:-1])) if len(short) else before
    count = before - first + 1
    left = np.repeat(np.arange(len(short)), count)
    right = np.repeat(first, count) + np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
    cut = np.flatnonzero(common)
    return left, right, cut, before[cut]


class _Side:
    """A tokeniser with the sizes, bytes and decimal texts of its tokens."""

    def __init__(self, coder, last: str, lead: str = ""):
        self.encode = lambda text: coder.encode(lead + text)
        pieces = coder.pieces()
        self.sizes = np.array([len(x) for x in pieces], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        #: each id followed by a comma, and by the mark that ends the tokens of a group
        self.inner = np.array([f"{k}," for k in range(len(pieces))], object)
        self.final = np.array([f"{k}{last}" for k in range(len(pieces))], object)

    def exact(self, ids: list[np.ndarray], wholes: list[bytes]) -> np.ndarray:
        """Whether the bytes of each list of ids are those of its text."""
        flat = np.concatenate([*ids, np.zeros(0, "<u4")])
        sizes = self.sizes[flat]
        ends = np.cumsum(sizes)
        at = np.cumsum([0, *map(len, ids)])
        of_text = np.concatenate(([0], ends))[at]
        joined = self.bytes[np.arange(of_text[-1]) + np.repeat(self.begins[flat] - (ends - sizes), sizes)]
        whole = np.frombuffer(b"".join(wholes), np.uint8)
        of_whole = np.cumsum([0, *map(len, wholes)])
        same = np.diff(of_text) == np.diff(of_whole)
        if same.all() and np.array_equal(joined, whole):
            return same
        return same & np.array([np.array_equal(joined[i:j], whole[k:m]) for i, j, k, m in zip(of_text[:-1], of_text[1:], of_whole[:-1], of_whole[1:], strict=True)], bool)


def _texts_of_groups(a: np.ndarray, b: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray, left: _Side, right: _Side) -> np.ndarray:
    """The decimal ids of both sides in the order of groups, each with the mark that follows it."""
    out = np.empty(len(a) + len(b), object)
    for ids, own, cut, other, side in ((a, 0, a_cut, np.concatenate(([0], b_cut + 1)), left), (b, 1, b_cut, np.concatenate(([0], a_cut + 1)), right)):
        last = np.zeros(len(ids) + 1, np.int64)
        last[cut + 1] = 1
        group = np.cumsum(last)[:-1]
        shown = side.inner[ids]
        shown[cut] = side.final[ids[cut]]
        out[np.arange(len(ids)) + other[group + own]] = shown
    return out


def _aligned(a: list[np.ndarray], b: list[np.ndarray], left: _Side, right: _Side) -> dict:
    """Links and groups of documents in all of which one side is the shorter."""
    flat_a, flat_b = (np.concatenate([*x, np.zeros(0, "<u4")]).astype(np.int64) for x in (a, b))
    ends_a, ends_b = np.cumsum(left.sizes[flat_a]), np.cumsum(right.sizes[flat_b])
    if len(flat_a) <= len(flat_b):
        link_a, link_b, cut_a, cut_b = overlaps(ends_a, ends_b)
    else:
        link_b, link_a, cut_b, cut_a = overlaps(ends_b, ends_a)
    from_a, from_b = (np.cumsum([0, *map(len, x)]) for x in (a, b))
    shown = _texts_of_groups(flat_a, flat_b, cut_a, cut_b, left, right)
    texts = ["".join(shown[i:j].tolist())[:-1] for i, j in zip(from_a[:-1] + from_b[:-1], from_a[1:] + from_b[1:], strict=True)]
    document = np.repeat(np.arange(len(a)), np.diff(from_a))[link_a]
    return {
        "pair": flat_a[link_a] * len(right.sizes) + flat_b[link_b],
        "document": document,
        "groups": np.diff(np.searchsorted(cut_a, from_a)),
        "links": np.bincount(document, minlength=len(a)),
        "texts": texts,
    }


def _block(texts: list[str | None], left: _Side, right: _Side) -> tuple[dict[str, list], tuple[np.ndarray, np.ndarray]]:
    """A row of numbers per text, and the different pairs of the block with their numbers of links."""
    none = np.zeros(0, "<u4")
    a, b = ([side.encode(text) if text else none for text in texts] for side in (left, right))
    wholes = [b" " + text.encode() if text else b"" for text in texts]
    sound = left.exact(a, wholes) & right.exact(b, wholes)
    a, b = ([ids if good else none for ids, good in zip(side, sound, strict=True)] for side in (a, b))
    shorter = np.array([len(x) <= len(y) for x, y in zip(a, b, strict=True)], bool)
    order, parts = [], []
    for rows in (np.flatnonzero(shorter), np.flatnonzero(~shorter)):
        parts.append(_aligned([a[k] for k in rows], [b[k] for k in rows], left, right))
        order += rows.tolist()
    document = np.concatenate([parts[0]["document"], parts[1]["document"] + int(shorter.sum())])
    pairs, place = np.unique(np.concatenate([p["pair"] for p in parts]), return_inverse=True)
    found, times = np.unique(document * max(1, len(pairs)) + place, return_counts=True)
    owner, place = np.divmod(found, max(1, len(pairs)))
    at = np.searchsorted(owner, np.arange(len(texts) + 1))
    narrow = "<u2" if len(pairs) <= 1 << 16 else "<u4"
    shown = parts[0]["texts"] + parts[1]["texts"]
    rows = {
        "row": order,
        "n_a": [len(a[k]) for k in order],
        "n_b": [len(b[k]) for k in order],
        "n_groups": np.concatenate([p["groups"] for p in parts]),
        "n_links": np.concatenate([p["links"] for p in parts]),
        "groups": shown,
        "groups_sha256": [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in shown],
        "places": [place[i:j].astype(narrow).tobytes() for i, j in zip(at[:-1], at[1:], strict=True)],
        "times": [times[i:j].astype("<u4").tobytes() for i, j in zip(at[:-1], at[1:], strict=True)],
    }
    total = np.zeros(len(pairs), np.int64)
    np.add.at(total, place, times)
    return rows, (pairs, total)


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def blocks_of(docs: DataFrame, a: str, b: str, pattern: str, with_groups: bool = False, doc_id: str = "doc_id", text: str = "text", size: int = BLOCK) -> DataFrame:
    """A row per block: its documents, and its different pairs of ids with their links.

    ``a`` is a byte-level vocabulary of ``tokenizers`` that reads a blank and the text, ``b`` a
    ``sentencepiece`` model, which adds the blank.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    fields = ["doc_id", *_NUMBERS, *(["groups"] if with_groups else []), "groups_sha256", "places", "times"]
    types = {"doc_id": kind, "groups": "string", "groups_sha256": "string", "places": "binary", "times": "binary"}
    schema = f"block long, docs array<struct<{', '.join(f'{f}: {types.get(f, "bigint")}' for f in fields)}>>, a array<int>, b array<int>, n array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = _Side(tokens.byte_level(a, pattern, False), "|", " ")
        right = _Side(tokens.sentence_pieces(b), ";")
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = np.cumsum([0, *(len(x) if x else 0 for x in batch.column(1).to_pylist())])
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(sizes, sizes[first] + size, "right")) - 1)
                rows, (pairs, n) = _block(batch.column(1).slice(first, last - first).to_pylist(), left, right)
                rows["doc_id"] = batch.column(0).slice(first, last - first).take(pa.array(rows["row"], pa.int64()))
                cells = [rows[f] if isinstance(rows[f], pa.Array) else pa.array(rows[f], {"places": pa.binary(), "times": pa.binary()}.get(f) or (pa.string() if "groups" in f and f != "n_groups" else pa.int64())) for f in fields]
                docs_of = pa.StructArray.from_arrays(cells, fields)
                listed = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                one, other = np.divmod(pairs, len(right.sizes))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), listed(docs_of), listed(pa.array(one, pa.int32())), listed(pa.array(other, pa.int32())), listed(pa.array(n, pa.int64()))],
                    ["block", "docs", "a", "b", "n"],
                )
                block += 1
                first = last

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``a, b, links, best``: how many links hold a pair over all blocks, and whether no other pair of its ``b`` has more.

    A ``b`` has at most a row per token of the other vocabulary.
    """
    pairs = blocks.select(F.explode(F.arrays_zip("a", "b", "n")).alias("x")).groupBy(F.col("x.a").alias("a"), F.col("x.b").alias("b")).agg(F.sum("x.n").alias("links"))
    return pairs.withColumn("best", F.col("links") == F.max("links").over(Window.partitionBy("b")))


def _summed(batches: Iterator[pa.RecordBatch], fields: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            docs = batch.column(0)[row].values
            known = batch.column(1)[row].values if batch.column(1)[row].is_valid else None
            links = known.field("links").to_numpy() if known is not None else np.zeros(0, np.int64)
            best = known.field("best").to_numpy(zero_copy_only=False) if known is not None else np.zeros(0, bool)
            narrow = "<u2" if len(links) <= 1 << 16 else "<u4"
            n_best, total = [], []
            for places, times in zip(docs.field("places").to_pylist(), docs.field("times").to_pylist(), strict=True):
                at, n = np.frombuffer(places, narrow), np.frombuffer(times, "<u4").astype(np.int64)
                n_best.append(int(n[best[at]].sum()))
                total.append(int((n * links[at]).sum()))
            yield pa.RecordBatch.from_arrays([*(docs.field(f) for f in fields), pa.array(n_best, pa.int64()), pa.array(total, pa.int64())], [*fields, "n_best", "count_sum"])


def align(docs: DataFrame, a: str, b: str, pattern: str, with_groups: bool = False, doc_id: str = "doc_id", text: str = "text", size: int = BLOCK) -> DataFrame:
    """A row per document: numbers of tokens, groups and links, the digest of its groups (and the groups themselves), ``n_best`` and ``count_sum``."""
    kind = docs.schema[doc_id].dataType.simpleString()
    blocks = written(blocks_of(docs, a, b, pattern, with_groups, doc_id, text, size), "aligned")
    counts = pair_counts(blocks).select(F.col("a").alias("of_a"), F.col("b").alias("of_b"), "links", "best")
    places = blocks.select("block", F.posexplode(F.arrays_zip("a", "b")).alias("place", "x")).select("block", "place", "x.a", "x.b")
    # the pairs grow with the vocabularies and the blocks, so they meet by a shuffle at every size
    met = places.join(counts.hint("merge"), (F.col("a") == F.col("of_a")) & (F.col("b") == F.col("of_b")))
    known = met.groupBy(F.col("block").alias("of")).agg(F.array_sort(F.collect_list(F.struct("place", "links", "best"))).alias("known"))
    rows = blocks.select("block", "docs").join(known.hint("merge"), F.col("block") == F.col("of"), "left").select("docs", "known")
    fields = ["doc_id", *_NUMBERS, *(["groups"] if with_groups else []), "groups_sha256"]
    types = {"doc_id": kind, "groups": "string", "groups_sha256": "string"}
    return rows.mapInArrow(lambda batches: _summed(batches, fields), ", ".join(f"{f} {types.get(f, 'bigint')}" for f in fields) + ", n_best bigint, count_sum bigint")
