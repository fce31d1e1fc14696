"""Hard negatives (13) against brute force, and how many blocks the zone maps leave out."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from murmurate.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, step=10):
    """``(anchor, positive, rank, negative, scores)`` by going through all rows."""
    usable = []
    for vec_id, x, label in rows:
        if vec_id is not None and x is not None and label is not None and all(v is not None and math.isfinite(v) for v in x):
            usable.append((vec_id, label, tuple(math.floor(256 * float(np.float32(v))) for v in x)))
    usable, out = sorted(set(usable)), []
    for a in usable:
        if a[0] % step:
            continue
        near = [(-sum(x * y for x, y in zip(a[2], b[2], strict=True)), b[0], b) for b in usable if b != a and len(b[2]) == len(a[2])]
        for score, positive, _ in sorted(n for n in near if n[2][1] == a[1])[:5]:
            fitting = sorted(n for n in near if n[2][1] != a[1] and 50 * -score <= 100 * -n[0] <= 95 * -score)
            out += [(a[0], positive, k + 1, n[1], -score, -n[0]) for k, n in enumerate(fitting[:3])]
    return sorted(out)


def mined(spark, rows, step=10, **sizes):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("entry", F.lit(1)).withColumn("q", F.lit("x")).withColumn("place", F.lit(None).cast("string"))
    found = negatives.mine(docs, F.col("vec_id") % step == 0, F.col("label"), **sizes)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()))


def clustered(rng, n, width=16, centres=12, spread=0.03):
    middle = rng.normal(size=(centres, width))
    middle /= np.linalg.norm(middle, axis=1, keepdims=True)
    x = middle[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, width))
    return [(int(k), [float(v) for v in row], int(rng.integers(0, 4))) for k, row in enumerate(x)]


@pytest.mark.parametrize("block", [16, negatives.BLOCK])
def test_mining_equals_brute_force(spark, block):
    rng = np.random.default_rng(1)
    rows = clustered(rng, 400) + [(1000 + int(k), [float(v) for v in row], int(k % 3)) for k, row in enumerate(rng.normal(size=(150, 16)))]
    assert mined(spark, rows, block=block, page=3, chunk=2) == plain(rows) != []


def test_odd_rows_ties_and_hot_vectors(spark):
    rng = np.random.default_rng(2)
    same = [0.5, -0.25, 1.0]
    rows = [(int(k), same, 0 if k % 2 else 1) for k in range(60)]  # a third of all rows have one vector
    rows += [(100 + int(k), [float(v) for v in rng.integers(-3, 4, 3) / 4], int(rng.integers(0, 2))) for k in range(120)]
    rows += [(20, [1.0, 0.5, 0.25], 0), (20, [1.0, 0.5, 0.25], 0), (20, [0.0, 0.0, 0.0], 1), (30, same, None), (40, None, 1), (50, [1.0, None, 0.0], 1), (70, [1.0, float("nan"), 0.0], 1), (80, [float("inf"), 0.0, 1.0], 0), (None, same, 0)]
    rows += [(500 + k, [0.5 + k / 64, 1.0], k % 2) for k in range(12)] + [(600 + k, [], k % 2) for k in range(12)]  # other dimensions, and none
    assert mined(spark, rows, block=8) == plain(rows) != []
    assert any(r[0] == 600 for r in plain(rows))


def test_empty_table_lone_label_and_huge_numbers(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == []
    huge = [(k, [3e38, -3e38], k % 2) for k in range(12)]
    assert all(abs(s) < 1 << 55 for r in mined(spark, huge) for s in r[4:])


def test_zone_maps_leave_blocks_out(spark, monkeypatch):
    read, keep = [], negatives.written

    def noted(frame, name, *rest):
        out = keep(frame, name, *rest)
        read.append((name, out))
        return out

    monkeypatch.setattr(negatives, "written", noted)
    rows = clustered(np.random.default_rng(3), 3000, centres=30)
    assert mined(spark, rows, step=50, block=32) == plain(rows, step=50)
    blocks = next(f for name, f in read if name == "numbered")
    asking = next(f for name, f in read if name == "asking").collect()
    zones = [(np.array(r["low"]), np.array(r["high"]), set(r["holds"])) for r in blocks.collect()]
    anchors = [(np.frombuffer(r["q"], "<i4").astype(np.int64), r["label"], r["floor"]) for r in asking]
    asked = sum(label in holds and int(negatives.bounds(q[None], low[None], high[None])[1][0, 0]) >= floor for q, label, floor in anchors for low, high, holds in zones)
    assert asked < 0.25 * len(anchors) * len(zones)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 4), st.integers(1, 3), st.integers(0, 2**31))
def test_curve_visits_every_cell_by_single_steps(axes, bits, seed):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
    cells = cells[np.random.default_rng(seed).permutation(len(cells))]
    place = negatives.hilbert(cells, bits)
    assert sorted(place.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(place)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**31))
def test_bounds_hold_every_vector(seed):
    rng = np.random.default_rng(seed)
    block, asked = rng.integers(-300, 300, (9, 5)), rng.integers(-300, 300, (4, 5))
    least, most = negatives.bounds(asked, block.min(axis=0)[None], block.max(axis=0)[None])
    scores = negatives.products(asked, block)
    assert (scores >= least).all() and (scores <= most).all() and scores.tolist() == (asked @ block.T).tolist()
