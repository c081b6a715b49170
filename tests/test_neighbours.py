import numpy as np
import pytest

from ledgerloom.operators import neighbours
from ledgerloom.operators.neighbours import knn_join, median_boxes

CATS, NUMS = ["c", "d"], ["x", "y"]
SCHEMA = "row_key string, c string, d string, x double, y double, label double"


def brute(probes, refs, k):
    known = {i: {r[i] for r in refs} for i in (1, 2)}
    out = {}
    for p in probes:
        ranked = []
        for r in refs:
            d = (p[3] - r[3]) ** 2 + (p[4] - r[4]) ** 2
            for i in (1, 2):
                d += (0.0 if p[i] == r[i] else 2.0) if p[i] in known[i] else 1.0
            ranked.append((d, r[0], r[5]))
        out[p[0]] = sorted(ranked)[:k]
    return out


def check(spark, probes, refs, k, **options):
    got = {}
    rows = knn_join(
        spark.createDataFrame([p[:5] + (0.0,) for p in probes], SCHEMA), spark.createDataFrame(refs, SCHEMA), k, CATS, NUMS, **options
    )
    for r in rows.orderBy("row_key", "place").collect():
        got.setdefault(r.row_key, []).append((r.distance_sq, r.ref_key, r.label))
    assert got == brute(probes, refs, k)


def rows(n, seed, spread=50, prefix="r"):
    rng = np.random.default_rng(seed)
    return [
        (f"{prefix}{i:04d}", "abc"[rng.integers(3)], "uvwxyz"[rng.integers(6)], float(rng.integers(spread)), float(rng.integers(5)), float(i))
        for i in range(n)
    ]


def test_many_boxes(spark):
    probes = rows(150, 1, prefix="p") + [("unseen", "none", "u", 7.0, 1.0, 0.0), ("far", "a", "u", 1e6, -1e6, 0.0)]
    check(spark, probes, rows(700, 2), 5, chunk_rows=64)


def test_hot_rows_and_hot_boxes(spark):
    # A third of the references are alike, another third share their numbers.
    refs = [(f"h{i:04d}", "a", "u", 3.0, 1.0, float(i)) for i in range(200)]
    refs += [(f"s{i:04d}", "abc"[i % 3], "uvwxyz"[i % 6], 4.0, 1.0, float(i)) for i in range(200)] + rows(200, 3)
    probes = [(f"p{i:04d}", "a", "u", 3.0, 1.0, 0.0) for i in range(120)] + rows(60, 4, prefix="q")
    check(spark, probes, refs, 7, chunk_rows=32, max_boxes=4)


def test_fewer_references_than_neighbours(spark):
    check(spark, rows(10, 5, prefix="p"), rows(3, 6), 7)


def test_one_box_and_constant_numbers(spark):
    refs = [(f"r{i}", "abc"[i % 3], "u", 1.0, 1.0, float(i)) for i in range(40)]
    check(spark, rows(20, 7, prefix="p"), refs, 4, chunk_rows=8)


@pytest.mark.parametrize("count", [1, 2, 7, 64])
def test_boxes_cover_all_rows(count):
    rng = np.random.default_rng(0)
    x = np.column_stack([rng.integers(0, 4, 500), rng.normal(size=500)]).astype(float)
    boxes = median_boxes(x, count)
    at = boxes.locate(x)
    assert len(boxes.low) <= count and at.min() >= 0 and at.max() < len(boxes.low)
    inside = (x >= boxes.low[at]).all(axis=1) & (x <= boxes.high[at]).all(axis=1)
    assert inside.all() and (boxes.gap_sq(x)[np.arange(len(x)), at] == 0).all()


def test_boxes_are_chunked_only_beyond_what_a_task_holds(spark, monkeypatch):
    # Every chunk is sent once per chunk of the other side, and answers with k candidates per probe.
    told = []
    counts = neighbours._chunk_counts

    def watched(*given):
        told.append(counts(*given))
        return told[-1]

    monkeypatch.setattr(neighbours, "_chunk_counts", watched)
    check(spark, rows(60, 8, prefix="p"), rows(3000, 9, spread=400), 5, max_boxes=1)
    assert [[r[1] for r in t.collect()] for t in told] == [[1], [1], [1]]


@pytest.mark.parametrize("leaf", [4, 4096])
def test_leaves_within_a_chunk(spark, monkeypatch, leaf):
    monkeypatch.setattr(neighbours, "LEAF_ROWS", leaf)
    monkeypatch.setattr(neighbours, "_CELLS", 300)
    refs = rows(400, 9) + [(f"h{i:04d}", "a", "u", 3.0, 1.0, float(i)) for i in range(60)]
    check(spark, rows(90, 8, prefix="p") + [("unseen", "none", "u", 7.0, 1.0, 0.0), ("far", "a", "u", 1e6, -1e6, 0.0)], refs, 5)


def test_a_probe_is_measured_against_few_references(monkeypatch):
    """Every probe was measured in full against all references of its box."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    n = 4_000
    refs = pa.table({"ref_key": [f"r{i:05d}" for i in range(n)], "c": rng.choice(list("abc"), n), "x": rng.uniform(0, 1_000, n), "y": rng.uniform(0, 50, n), "label": np.zeros(n)})
    probes = pa.table({"c": rng.choice(list("abc"), 500), "c_known": np.ones(500, bool), "x": rng.uniform(0, 1_000, 500), "y": rng.uniform(0, 50, 500)})
    measured = []
    whole, single = neighbours._Side.distances, neighbours._Side.pairs
    monkeypatch.setattr(neighbours._Side, "distances", lambda self, r, f: measured.append(len(r) * len(f)) or whole(self, r, f))
    monkeypatch.setattr(neighbours._Side, "pairs", lambda self, r, f: measured.append(len(r)) or single(self, r, f))
    side = neighbours._Side(probes, refs, ["c"], ["x", "y"])
    row, ref, d = side.nearest(5, None)
    assert sum(measured) < 0.2 * n * 500
    every = whole(side, np.arange(500), np.arange(n))
    np.testing.assert_array_equal(ref[np.argsort(row, kind="stable")].reshape(500, 5), np.argsort(every, axis=1, kind="stable")[:, :5])
