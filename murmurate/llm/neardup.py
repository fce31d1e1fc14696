"""Near-duplicates by a signature-coordinate inverted join.

A document is the set of its word shingles. Documents with the same set are one class.
Each class has a MinHash signature; it is posted under each coordinate-value pair of the
first ``POSTED`` coordinates. Two classes above the wanted similarity agree in at least
``least(POSTED)`` of these, so they meet in the prefix of the rarest pairs of each: pairs
that only one class has are skipped, and common passages hardly ever enter a prefix.
Candidates are retained if their whole signatures agree in at least ``least(SIGNATURE)``
coordinates; links are confirmed on the full sets. ``least`` lies ``SAFETY`` standard
deviations below the mean of two sets that are just similar enough.

Links matter only as far as they connect, which saves large groups from all their pairs.
First each posting list draws ``LEADERS`` leaders, and a class is confirmed with those of
its leaders whose signatures agree best and those that were drawn first. Then members of a
list that are not yet connected are compared one by one, those outside the list's largest
component with all others. Where that component is large, blocks of those outside it meet
all of its documents within tasks, which report links only. Lists all of whose pairs have
met already are left out. So no link between different components is left out, and nothing
is capped.

Signatures, a few hundred bytes a class, are what the candidates are found with. Texts move
only for the two confirmations: a leader's text goes ahead of those of its members through
one sorted shuffle, so a task holds the sets of two documents; a leader with many members
is dealt over several tasks.

Definitions. Words are runs without blank after lower-casing A-Z; a text with fewer words
than a shingle is one shingle. Null texts and texts without words have no set and link with
nothing: each is a component of its own. Rows that share an id are one document, linked as
any of their texts is. A row without id links with nothing and is kept. The component is the smallest id that can be
reached. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmurate.llm import blocks
from murmurate.session import written

SHINGLE = 5
PERCENT = 80
SIGNATURE = 256
POSTED = 20
SAFETY = 4.2
LEADERS = 3
#: Leaders that a class is confirmed with: so many by agreement and so many by order of draw.
CONFIRMED = 2
#: Members of a leader that one task confirms.
MEMBERS = 1000
#: A list's largest component is large from so many of its members on; documents of a block that meets it.
LARGE = 32
MEETING = 64
_random = np.random.default_rng(11)
_FACTORS = _random.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _random.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64)


def least(coordinates: int, percent: int = PERCENT) -> int:
    """Agreeing coordinates that two sets of just this similarity reach but for some in 100,000 cases."""
    p = percent / 100
    return max(1, math.floor(coordinates * p - SAFETY * math.sqrt(coordinates * p * (1 - p))))


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(SIGNATURE, np.uint32(0xFFFFFFFF), np.uint32)
    for first in range(0, len(shingles), 2048):
        part = (shingles[None, first : first + 2048] ^ _MASKS[:, None]) * _FACTORS[:, None] >> np.uint64(32)
        np.minimum(out, part.min(axis=1).astype(np.uint32), out=out)
    return out.view(np.int32)


def _key(shingles: np.ndarray) -> bytes | None:
    """Equal for equal sets: two sums of scrambled members."""
    if not len(shingles):
        return None
    return np.array([blocks.mix(shingles).sum(), blocks.mix(shingles * np.uint64(0x9E3779B97F4A7C15)).sum()], np.uint64).tobytes()


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for first, data, offsets in blocks.blocks(column):
        hashes, begins = blocks.words(data, offsets)
        yield first, [blocks.shingles(hashes[begins[k] : begins[k + 1]], size) for k in range(len(offsets) - 1)]


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n_shingles, set_key, posted, signature`` of each row; the last three are null without words.

    ``posted`` has the first coordinates, ``signature`` 8 bits of every one.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in _sets(batch.column(1), size):
                found = [signature(x) if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(sets)), pa.array([len(x) for x in sets], pa.int64()), pa.array([_key(x) for x in sets], pa.binary()),
                        pa.array([None if x is None else x[:POSTED] for x in found], pa.list_(pa.int32())), pa.array([None if x is None else x.astype(np.int8) for x in found], pa.list_(pa.int8())),
                    ],
                    ["doc_id", "n_shingles", "set_key", "posted", "signature"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        sketch, "doc_id long, n_shingles long, set_key binary, posted array<int>, signature array<tinyint>"
    )


def prefixes(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``id, n_shingles, prefix``: the rarest coordinate-value pairs that each class shares with another; a class without any is left out."""
    value = F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    posted = classes.select("id", "n_shingles", F.posexplode("posted").alias("coordinate", "value"))
    posted = posted.select("id", "n_shingles", F.shiftleft(F.col("coordinate").cast("long"), 32).bitwiseOR(value).alias("token"))
    shared = posted.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("token").alias("shared"), "n")
    by_class = posted.join(shared, F.col("token") == F.col("shared")).groupBy("id", "n_shingles").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("rarest"))  # at most POSTED a class
    prefix = POSTED - least(POSTED, percent) + 1
    # the pairs that the class has alone are the rarest of all and come first
    taken = F.slice("rarest", 1, F.greatest(F.lit(0), F.lit(prefix - POSTED) + F.size("rarest")))
    return by_class.select("id", "n_shingles", taken.getField("token").alias("prefix")).where(F.size("prefix") > 0)


def _agree(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda total, x: total + x)


def _similar_sizes(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def pairwise(pairs: DataFrame) -> DataFrame:
    """Different pairs ``a, b`` of document ids as comparisons of each ``a`` with its ``b``, for :func:`compared`."""
    leaders = pairs.groupBy(F.col("a").alias("leader")).agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("parts"))
    members = pairs.join(leaders, F.col("a") == F.col("leader")).select(F.lit(True).alias("every"), "a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.lit(True).alias("is_member"), F.col("b").alias("wanted"))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    return members.union(leaders.select(F.lit(True), "leader", parts, F.lit(False), "leader"))


def meetings(outside: DataFrame, labels: DataFrame) -> DataFrame:
    """Comparisons of documents ``id`` with all of the component ``largest``, for :func:`compared`; ``labels`` as :func:`stars` gives them.

    The documents outside come in blocks, and those of the component one after the other.
    """
    blocks_ = outside.groupBy("largest").agg(F.ceil(F.count(F.lit(1)) / MEETING).alias("parts"))
    members = labels.groupBy(F.col("label").alias("of")).agg(F.ceil((F.count(F.lit(1)) + 1) / MEMBERS).alias("splits"))
    sizes = members.join(blocks_, F.col("of") == F.col("largest")).select("of", "splits", "parts")
    splits = F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits") - 1))
    leading = outside.join(sizes, F.col("largest") == F.col("of")).select("largest", F.pmod(F.xxhash64("id"), F.col("parts")).alias("block"), "splits", "id").select("largest", "block", "splits", "id", splits.alias("split"))
    leading = leading.select(F.lit(False).alias("every"), F.col("largest").alias("a"), (F.col("block") * F.col("splits") + F.col("split")).alias("part"), F.lit(False).alias("is_member"), F.col("id").alias("wanted"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    members = labels.join(sizes, F.col("label") == F.col("of")).select("label", "node", "splits", "parts").union(sizes.select("of", "of", "splits", "parts"))
    members = members.select("label", "node", "splits", F.pmod(F.xxhash64("node"), F.col("splits")).alias("split"), each.alias("block"))
    members = members.select(F.lit(False).alias("every"), F.col("label").alias("a"), (F.col("block") * F.col("splits") + F.col("split")).alias("part"), F.lit(True).alias("is_member"), F.col("node").alias("wanted"))
    return leading.union(members)


def compared(dealt: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links ``a, b`` by the full sets between the members of each ``(every, a, part)`` and the documents that lead it.

    With ``every``, all links; without, one of each document that leads at most. A link may come
    twice where rows share an id.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([packer.compress((x or "").encode()) for x in batch.column(1).to_pylist()], pa.binary())], ["id", "text"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        group, leading, marks = None, [], None
        for batch in batches:
            out = []
            for start in range(0, batch.num_rows, 64):
                rows = batch.slice(start, 64)
                texts = pa.array([unpacker.decompress(x).decode() for x in rows.column(5).to_pylist()], pa.large_string())
                sets = [x for _, found in _sets(texts, size) for x in found]
                for every, a, part, is_member, number, own in zip(*(rows.column(k).to_pylist() for k in range(5)), sets, strict=True):
                    if (every, a, part) != group:
                        group, leading, marks = (every, a, part), [], None
                    if not is_member:
                        leading.append((number, own))
                        continue
                    chosen = range(len(leading))
                    if not every:
                        if marks is None:
                            marks = np.array([signature(x)[:SIGNATURE] for _, x in leading]).reshape(len(leading), -1)
                        chosen = np.flatnonzero((marks == signature(own)).sum(axis=1) >= least(SIGNATURE, percent)).tolist() if len(leading) else []
                    linked_now = []
                    for k in chosen:
                        other = leading[k][1]
                        common = len(np.intersect1d(own, other, assume_unique=True))
                        if common and 100 * common >= percent * (len(own) + len(other) - common):
                            out.append((leading[k][0], number))
                            linked_now.append(k)
                    if not every and linked_now:
                        leading = [x for k, x in enumerate(leading) if k not in linked_now]
                        marks = np.delete(marks, linked_now, axis=0)
            columns = list(zip(*out, strict=True)) or [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["a", "b"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id IS NOT NULL").mapInArrow(packed, "id long, text binary")
    # as many texts as there are documents may be wanted, so they meet by a shuffle at every size
    rows = texts.join(dealt.hint("merge"), F.col("id") == F.col("wanted")).select("every", "a", "part", "is_member", "id", "text")
    return rows.repartition("every", "a", "part").sortWithinPartitions("every", "a", "part", "is_member").mapInArrow(compare, "a long, b long")


def stars(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node that each node of the edges ``a, b`` can reach, where it is another one.

    Alternating stars: every node hands its larger neighbours to its smallest one, then its
    smaller ones, until each component is one star. The first step is an aggregate and a join,
    as a centre may have all of its component for neighbours; the second goes through the
    smaller neighbours in order, which leaves out repeated ones.
    """

    def star(edges: DataFrame) -> DataFrame:
        # edges run from a larger to a smaller node
        centre = edges.union(edges.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("centre"))
        moved = edges.join(centre, F.col("b") == F.col("node")).select("a", F.col("centre").alias("b"))
        smaller = Window.partitionBy("a").orderBy("b")
        seen = moved.select("a", "b", F.first("b").over(smaller).alias("centre"), F.lag("b").over(smaller).alias("before"))
        # the first one takes the node itself along
        return seen.where("before IS NULL OR before != b").select(F.when(F.col("before").isNull(), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("centre").alias("b"))

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    mark, before = state(now), None
    while mark != before:
        now = written(star(now), "edges")
        mark, before = state(now), mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("label"))


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node that each node of the edges ``a, b`` can reach."""
    found = stars(edges)
    return found.union(found.select("label", "label").distinct())


def links(classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs ``a, b`` of class ids that connect everything that is connected by confirmed links."""
    facts = written(prefixes(classes, percent), "prefixes")
    lists = facts.select(F.explode("prefix").alias("token"), "id", "n_shingles")
    facts = written(classes.select("id", "signature").join(facts.select(F.col("id").alias("member"), "n_shingles", "prefix"), F.col("id") == F.col("member")).drop("member"), "members")

    def retained(one: str, two: str) -> Column:
        sizes = _similar_sizes(F.col(f"{one}.n_shingles"), F.col(f"{two}.n_shingles"), percent)
        return sizes & (_agree(f"{one}.signature", f"{two}.signature") >= least(SIGNATURE, percent))

    draws = [F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("draw"), "id", "n_shingles")) for turn in range(LEADERS)]
    drawn = F.array_distinct(F.transform(F.array(*draws), lambda x: F.struct(x["id"].alias("id"), x["n_shingles"].alias("n_shingles"))))
    leaders = written(lists.groupBy(F.col("token").alias("list")).agg(drawn.alias("leaders"), F.count(F.lit(1)).alias("members")), "leaders")
    met = lists.join(leaders, F.col("token") == F.col("list")).select(F.explode("leaders").alias("leader"), "id", "n_shingles").where("leader.id != id")
    pairs = met.where(_similar_sizes(F.col("leader.n_shingles"), F.col("n_shingles"), percent)).select(F.col("leader.id").alias("a"), F.col("id").alias("b")).distinct()
    near = pairs.join(facts.alias("one"), F.col("a") == F.col("one.id")).join(facts.alias("two"), F.col("b") == F.col("two.id")).where(retained("one", "two"))
    # at most LEADERS of each list in its prefix
    near = near.select("b", F.struct(_agree("one.signature", "two.signature").alias("agree"), "a").alias("leader")).groupBy("b").agg(F.collect_list("leader").alias("met"))
    best = F.slice(F.sort_array("met", False), 1, CONFIRMED).getField("a")
    foremost = F.slice(F.sort_array(F.transform("met", lambda x: F.struct(F.xxhash64(x["a"], F.lit(0)).alias("draw"), x["a"].alias("a")))), 1, CONFIRMED).getField("a")
    near = near.select("b", F.array_union(best, foremost).alias("first"), F.explode("met.a").alias("a"))
    near = written(near.select("a", "b", F.array_contains("first", F.col("a")).alias("first")), "near")
    labels = stars(compared(pairwise(near.where("first").select("a", "b")), docs, size, percent))

    # candidates that the leaders' turn has left
    left = near.where("NOT first").select("a", "b")
    for side in ("a", "b"):
        left = left.join(labels.select(F.col("node").alias(f"{side}_node"), F.col("label").alias(f"{side}_label")), F.col(side) == F.col(f"{side}_node"), "left")
    left = left.where(~F.coalesce("a_label", "a").eqNullSafe(F.coalesce("b_label", "b"))).select("a", "b")

    # lists with two members at least that were no leaders; in others all pairs have met
    entries = lists.join(leaders.where(F.col("members") > F.size("leaders") + 1).select("list"), F.col("token") == F.col("list"), "left_semi")
    entries = written(entries.select("token", "id").join(labels, F.col("id") == F.col("node"), "left").select("token", "id", F.coalesce("label", "id").alias("label")), "entries")
    shares = entries.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("token").alias("list"))
    mixed = shares.agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.max("n").alias("n"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    open_ = entries.join(mixed, F.col("token") == F.col("list")).withColumn("main", F.col("label") == F.col("largest"))
    open_ = written(open_.select("token", "id", "label", "main", "largest", (F.col("n") >= LARGE).alias("large")), "open")
    outside = open_.where("large AND NOT main").select("id", "largest").distinct()
    marked = open_.where("NOT (large AND main)").join(facts.withColumnRenamed("id", "fact"), F.col("id") == F.col("fact"))
    open_ = written(marked.select("token", "id", "label", "main", "n_shingles", "signature", "prefix"), "marked")
    rest = open_.where("NOT main").alias("one").join(
        open_.alias("two"),
        (F.col("one.token") == F.col("two.token"))
        & (F.col("one.label") != F.col("two.label"))
        & (F.col("two.main") | (F.col("one.id") < F.col("two.id")))
        # of the lists that a pair shares, the first has to find it
        & (F.array_min(F.array_intersect("one.prefix", "two.prefix")) == F.col("one.token"))
        & retained("one", "two"),
    )
    rest = written(left.union(rest.select(F.col("one.id").alias("a"), F.col("two.id").alias("b"))).distinct(), "pairs")
    found = compared(pairwise(rest).union(meetings(outside, labels)), docs, size, percent)
    # the components found so far are stars
    return labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(found)


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``."""
    rows = written(sketches(docs, size), "sketches")
    usable = rows.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    # equal keys have equal columns
    classes = usable.groupBy("set_key").agg(F.min("doc_id").alias("id"), *(F.first(name).alias(name) for name in ("n_shingles", "posted", "signature")))
    classes = written(classes, "classes")
    rows = rows.join(classes.select(F.col("set_key").alias("key"), "id"), (F.col("set_key") == F.col("key")) & F.col("doc_id").isNotNull(), "left").select("doc_id", "n_shingles", "id")
    rows = written(rows, "rows")
    # an id with several texts links their classes
    several = rows.where("id IS NOT NULL").groupBy("doc_id").agg(F.min("id").alias("b"), F.max("id").alias("high")).where("b != high").select(F.col("doc_id").alias("several"), "b")
    joined = rows.join(several, F.col("doc_id") == F.col("several")).where("id IS NOT NULL").select(F.col("id").alias("a"), "b")
    labels = stars(joined.union(links(classes, docs, size, percent)))
    out = rows.join(labels, F.col("id") == F.col("node"), "left")
    component = F.coalesce("label", "id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _apart(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with a number of its own for each id and text where an id repeats, and those numbers with the ids (null: none repeats).

    The numbers lie below all ids.
    """
    own = F.col("doc_id").cast("long")
    ids = docs.where(own.isNotNull()).groupBy(own.alias("_of_id")).agg(F.count(F.lit(1)).alias("n"))
    ids = written(ids.where("n > 1").select("_of_id"), "repeated")
    if ids.isEmpty():
        return docs, None
    digest = F.coalesce(F.sha2("text", 256), F.lit(""))
    low = docs.agg(F.least(F.min(own), F.lit(0))).first()[0]
    repeated = docs.join(ids, own == ids["_of_id"], "left_semi")
    names = repeated.select(own.alias("_of_id"), digest.alias("_digest")).distinct()
    names = written(names.withColumn("_number", F.lit(low - 1) - F.monotonically_increasing_id()), "names")
    met = repeated.join(names, (own == names["_of_id"]) & (digest == names["_digest"]))
    renamed = met.select(*(names["_number"].alias("doc_id") if c == "doc_id" else repeated[c] for c in docs.columns))
    single = docs.join(ids, own == ids["_of_id"], "left_anti").withColumn("doc_id", own)
    return single.unionByName(renamed), names.select("_number", F.col("_of_id").alias("_id_of_number"))


def kept(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with all columns, less those with a near-duplicate that stays; the document of the smallest id of a group stays.

    A document is an id and a text: rows equal in both are one, of which one stays, while rows that
    share an id only are compared like any others. Rows without id stay.
    """
    apart, names = _apart(docs)
    rows = written(near_duplicates(apart, size, percent), "near-duplicates").where("doc_id IS NOT NULL")
    if names is None:
        gone = written(rows.where("NOT kept").select(F.col("doc_id").alias("gone_id")), "gone")
        return docs.join(gone.hint("merge"), docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")
    nodes = rows.groupBy("doc_id", "component_id").count().join(names, F.col("doc_id") == F.col("_number"), "left")
    best = nodes.groupBy("component_id").agg(F.min_by("doc_id", F.struct(F.coalesce("_id_of_number", "doc_id"), "doc_id")).alias("_stays"))
    stays = written(best.select("_stays").join(names, F.col("_stays") == F.col("_number"), "left").select("_stays", "_id_of_number"), "stays")
    # rows of ids that do not repeat by their id, the others by id and text, one of each
    single = apart.where(F.col("doc_id").isNull()).unionByName(apart.join(stays.where("_id_of_number IS NULL").hint("merge"), F.col("doc_id") == F.col("_stays"), "left_semi"))
    several = apart.join(stays.where("_id_of_number IS NOT NULL").hint("merge"), F.col("doc_id") == F.col("_stays"))
    row = F.struct(*(F.col("_id_of_number").alias(c) if c == "doc_id" else apart[c] for c in docs.columns))
    several = several.groupBy("_stays").agg(F.first(row).alias("row")).select("row.*")
    found = single.unionByName(several)
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)).select(*docs.columns)
