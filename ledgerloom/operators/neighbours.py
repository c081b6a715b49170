"""Exact k-nearest-neighbour join on mixed columns.

Distance squared is the sum of squared gaps of the numeric columns plus, per
category column, 2 where the values differ (1 where the probe's value never
occurs in the reference rows), which is Euclidean distance on one-hot columns.

The reference rows are cut into boxes along their numeric columns. A probe
first meets one bounded chunk of its own box, which yields an upper bound of
its k-th distance; then it visits only the boxes that reach within this bound.
Hot boxes are split into chunks on both sides, so a task holds at most one
chunk of probes and one of references. There the references are cut on into
leaves, and a probe meets only the leaves within its bound. Box edges come from a
sample and decide balance only: the result is exact for any edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.session import materialise

SAMPLE_ROWS = 20_000
PART_ROWS = 1 << 19  # references of a shuffle partition, about
BOX_ROWS = 4_096  # references a box is meant to hold, as long as ``max_boxes`` allow it
LEAF_ROWS = 256  # references of a leaf within a chunk, where their numbers differ
_SLICE = 256  # probes per distance matrix, at most
_CELLS = 1 << 20  # and its entries


@dataclass(frozen=True)
class Boxes:
    """Axis-aligned boxes from median cuts; ``cuts`` is (axis, edge, left, right) per inner node."""

    cuts: list[tuple[int, float, int, int]]
    low: np.ndarray
    high: np.ndarray

    def locate(self, x: np.ndarray) -> np.ndarray:
        """Box number per row; negative node numbers are leaves."""
        node = np.zeros(len(x), dtype=np.int64) if self.cuts else np.full(len(x), -1)
        while (node >= 0).any():
            rows = np.flatnonzero(node >= 0)
            axis, edge, left, right = (np.array(column) for column in zip(*self.cuts))
            at = node[rows]
            node[rows] = np.where(x[rows, axis[at]] <= edge[at], left[at], right[at])
        return -node - 1

    def gap_sq(self, x: np.ndarray, among: np.ndarray | None = None) -> np.ndarray:
        """Least possible squared distance from each row to each box, or to some of them."""
        low, high = (self.low, self.high) if among is None else (self.low[among], self.high[among])
        total = np.zeros((len(x), len(low)))
        for axis in range(low.shape[1]):
            column = x[:, axis : axis + 1]
            outside = np.maximum(np.maximum(low[:, axis] - column, column - high[:, axis]), 0.0)
            total += outside * outside
        return total

    def within(self, x: np.ndarray, limit: float) -> np.ndarray:
        """The boxes that any of these rows may reach within a squared distance."""
        total = np.zeros(len(self.low))
        for axis in range(self.low.shape[1]):
            least, most = np.fmin.reduce(x[:, axis]), np.fmax.reduce(x[:, axis])
            outside = np.fmax(np.fmax(self.low[:, axis] - most, least - self.high[:, axis]), 0.0)
            total += outside * outside
        return np.flatnonzero(total <= _wider(limit))


def median_boxes(sample: np.ndarray, count: int) -> Boxes:
    """Cut the widest axis of the fullest box at its median until there are ``count`` boxes."""
    width = sample.shape[1]
    cuts: list[list] = []
    leaves = [(sample, np.full(width, -np.inf), np.full(width, np.inf), None)]
    done = []
    while leaves and len(leaves) + len(done) < count:
        leaves.sort(key=lambda leaf: len(leaf[0]))
        rows, low, high, parent = leaves.pop()
        spread = np.ptp(rows, axis=0) if len(rows) else np.zeros(width)
        axis = int(np.argmax(spread)) if width else 0
        if len(rows) < 2 or spread[axis] == 0:
            done.append((rows, low, high, parent))
            continue
        edge = float(np.median(rows[:, axis]))
        if edge == rows[:, axis].max():
            edge = float(rows[rows[:, axis] < edge, axis].max())
        here = len(cuts)
        cuts.append([axis, edge, None, None])
        if parent:
            cuts[parent[0]][parent[1]] = here
        goes_left = rows[:, axis] <= edge
        left_high, right_low = high.copy(), low.copy()
        left_high[axis] = right_low[axis] = edge
        leaves.append((rows[goes_left], low, left_high, (here, 2)))
        leaves.append((rows[~goes_left], right_low, high, (here, 3)))
    final = leaves + done
    for number, (_, _, _, parent) in enumerate(final):
        if parent:
            cuts[parent[0]][parent[1]] = -number - 1
    return Boxes([tuple(c) for c in cuts], np.array([f[1] for f in final]), np.array([f[2] for f in final]))


@dataclass(frozen=True)
class _Leaves:
    """References cut at medians within a task; ``order`` holds their positions leaf by leaf."""

    cuts: list[tuple[int, float, int, int]]  # axis, edge, left, right; negative numbers are leaves
    order: np.ndarray
    start: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, y: np.ndarray) -> "_Leaves":
        cuts: list[list] = []
        leaves: list[np.ndarray] = []
        todo: list[tuple] = [(np.arange(len(y)), None)]
        while todo:
            rows, parent = todo.pop()
            axis, left = -1, None
            if len(rows) > LEAF_ROWS and y.shape[1]:
                here = y[rows]
                axis = int(np.argmax(here.max(axis=0) - here.min(axis=0)))
                column = here[:, axis]
                edge = np.partition(column, len(column) // 2)[len(column) // 2]
                left = column < edge
                if not left.any():
                    left = column <= edge
                elif np.isfinite(edge):
                    edge = column[left].max()
            if left is None or left.all() or not left.any():
                number = -len(leaves) - 1
                leaves.append(rows)
            else:
                number = len(cuts)
                cuts.append([axis, float(edge), 0, 0])
                todo += [(rows[left], (number, 2)), (rows[~left], (number, 3))]
            if parent:
                cuts[parent[0]][parent[1]] = number
        low, high = (np.array([f.reduce(y[rows], axis=0) for rows in leaves]) for f in (np.fmin, np.fmax))
        start = np.cumsum([0, *map(len, leaves)])
        return cls([tuple(c) for c in cuts], np.concatenate(leaves), start, low, high)

    def locate(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64) if self.cuts else np.full(len(x), -1)
        axis, edge, left, right = (np.array(column) for column in zip(*self.cuts)) if self.cuts else ([],) * 4
        while (node >= 0).any():
            rows = np.flatnonzero(node >= 0)
            at = node[rows]
            node[rows] = np.where(x[rows, axis[at]] <= edge[at], left[at], right[at])
        return -node - 1

    def rows(self, leaves: np.ndarray) -> np.ndarray:
        """Positions of the references of some leaves, in order."""
        return np.sort(np.concatenate([self.order[self.start[i] : self.start[i + 1]] for i in leaves]))

    def gap_sq(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros((len(x), len(self.low)))
        for axis in range(self.low.shape[1]):
            column = x[:, axis : axis + 1]
            outside = np.fmax(np.fmax(self.low[:, axis] - column, column - self.high[:, axis]), 0.0)
            total += outside * outside
        return total


def _wider(limit: np.ndarray) -> np.ndarray:
    """Widened a little: a gap is summed in another order than distances."""
    return limit * (1 + 1e-9) + 1e-9


class _Side:
    """Probes and references of a task: their numbers and the codes of their categories. References are put in the order of their keys."""

    def __init__(self, probes: pa.Table, refs: pa.Table, cats, nums):
        self.refs = refs = refs.take(pc.sort_indices(refs, sort_keys=[("ref_key", "ascending")]))
        self.x, self.y = (_numbers(t, nums) for t in (probes, refs))
        codes = []
        for c in cats:
            both = pc.dictionary_encode(pa.chunked_array([*probes.column(c).chunks, *refs.column(c).chunks], probes.schema.field(c).type).combine_chunks())
            both = both.combine_chunks() if isinstance(both, pa.ChunkedArray) else both
            codes.append(both.indices.fill_null(-1).to_numpy(zero_copy_only=False))
        self.mine, self.theirs = [c[: len(probes)] for c in codes], [c[len(probes) :] for c in codes]
        self.known = [probes.column(f"{c}_known").to_numpy().astype(bool) for c in cats]

    def distances(self, rows: np.ndarray, refs: np.ndarray) -> np.ndarray:
        x, y = self.x[rows], self.y[refs]
        d = np.zeros((len(rows), len(refs)))
        for axis in range(x.shape[1]):
            gap = x[:, axis : axis + 1] - y[:, axis]
            d += gap * gap
        for mine, theirs, known in zip(self.mine, self.theirs, self.known, strict=True):
            unknown = ~known[rows]
            differs = 2.0 * (mine[rows, None] != theirs[refs])
            if unknown.any():
                differs[unknown] = 1.0
            d += differs
        return d

    def pairs(self, rows: np.ndarray, refs: np.ndarray) -> np.ndarray:
        """The distances of single pairs, summed in the same order."""
        d = np.zeros(len(rows))
        for x, y in zip(self.x.T, self.y.T, strict=True):
            gap = x[rows] - y[refs]
            d += gap * gap
        for mine, theirs, known in zip(self.mine, self.theirs, self.known, strict=True):
            d += np.where(known[rows], 2.0 * (mine[rows] != theirs[refs]), 1.0)
        return d

    def nearest(self, k: int, radius: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probe positions, reference positions, squared distances): up to ``k`` per probe by distance, then key, within a radius."""
        found = []
        leaves = _Leaves.of(self.y) if len(self.y) else None
        at = leaves.locate(self.x) if leaves else np.zeros(0, np.int64)
        order = np.argsort(at, kind="stable") if leaves else at
        edges = np.flatnonzero(np.diff(at[order])) + 1
        for run in np.split(order, edges) if len(order) else ():
            own = leaves.rows([at[run[0]]])
            step = max(1, min(_SLICE, _CELLS // max(1, len(own))))
            for start in range(0, len(run), step):
                found += self._block(run[start : start + step], own, leaves, k, radius)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*found))

    def _block(self, rows: np.ndarray, own: np.ndarray, leaves: _Leaves, k: int, radius: np.ndarray | None):
        limit = np.full(len(rows), np.inf) if radius is None else radius[rows]
        d = self.distances(rows, own)
        limit = _within(d, limit, k)
        reached = np.flatnonzero((leaves.gap_sq(self.x[rows]) <= _wider(limit)[:, None]).any(axis=0))
        if len(leaves.low) == 1 or not len(reached) or not self.x.shape[1]:
            yield _chosen(rows, own, d, limit, k)
            return
        # The two widest axes tell nearly all pairs apart; only the others are measured in full.
        refs = leaves.rows(reached)
        axes = np.argsort(np.fmax.reduce(self.y[refs], axis=0) - np.fmin.reduce(self.y[refs], axis=0))[-2:]
        step = max(1, _CELLS // len(refs))
        for start in range(0, len(rows), step):
            here, reach = rows[start : start + step], limit[start : start + step]
            least = sum((self.x[here, axis][:, None] - self.y[refs, axis]) ** 2 for axis in axes)
            row, place = np.nonzero(~(least > _wider(reach)[:, None]))
            near = self.pairs(here[row], refs[place])
            keep = near <= reach[row]
            yield _first(here, refs, row[keep], place[keep], near[keep], k)


def _within(d: np.ndarray, limit: np.ndarray, k: int) -> np.ndarray:
    """The limit, or the k-th distance where that is less."""
    return np.fmin(limit, np.partition(d, k - 1, axis=1)[:, k - 1]) if d.shape[1] >= k else limit


def _chosen(rows: np.ndarray, refs: np.ndarray, d: np.ndarray, limit: np.ndarray, k: int):
    row, place = np.nonzero(d <= limit[:, None])
    return _first(rows, refs, row, place, d[row, place], k)


def _first(rows: np.ndarray, refs: np.ndarray, row: np.ndarray, place: np.ndarray, near: np.ndarray, k: int):
    """The ``k`` nearest of each row, by distance, then place."""
    order = np.lexsort((place, near, row))
    row, place, near = row[order], place[order], near[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return rows[row[keep]], refs[place[keep]], near[keep]


def _numbers(table: pa.Table, nums) -> np.ndarray:
    """rows x numbers, missing ones not a number."""
    columns = [table.column(c).to_numpy().astype(float) for c in nums]
    return np.stack(columns, axis=1) if columns else np.zeros((len(table), 0))


def knn_join(
    probes: DataFrame,
    refs: DataFrame,
    k: int,
    cats,
    nums,
    *,
    key: str = "row_key",
    label: str = "label",
    chunk_rows: int = 16_384,
    max_boxes: int = 4096,
) -> DataFrame:
    """Rows (key, place, ref_key, distance_sq, label): the ``k`` nearest references per probe.

    Ties are broken by the reference key. Every probe row is numbered, so rows
    that share a key, or have none, each get their ``k`` places. Each chunk of a
    box is sent once per chunk of the other side, and answers with up to ``k``
    candidates per probe, so boxes are chunked only beyond what a task can hold.
    """
    cats, nums = list(cats), list(nums)
    doubles = [F.col(c).cast("double").alias(c) for c in nums]
    refs = materialise(refs.select(F.col(key).alias("ref_key"), F.col(label).cast("double").alias("label"), *cats, *doubles))
    numbered = probes.select(F.monotonically_increasing_id().alias("probe_id"), F.col(key).cast("string").alias("probe_key"), *cats, *doubles)
    probes = _with_known(materialise(numbered), refs, cats)

    n_refs = refs.count()
    share = min(1.0, SAMPLE_ROWS / max(1, n_refs))
    sample = refs.select(*nums).sample(share, seed=7).limit(2 * SAMPLE_ROWS).toPandas().to_numpy(float)
    boxes = median_boxes(sample, max(1, min(max_boxes, n_refs // max(1, min(BOX_ROWS, chunk_rows // 2)))))

    # Only the k first keys of rows alike in every column can be among k nearest.
    # Sorting by a hash first tells most rows apart by one number.
    alike = W.partitionBy("_hash", *cats, *nums).orderBy("ref_key")
    distinct = refs.withColumn("_hash", F.xxhash64(*cats, *nums) if cats or nums else F.lit(0))
    distinct = distinct.withColumn("_copy", F.row_number().over(alike)).where(F.col("_copy") <= k).drop("_copy", "_hash")
    refs = materialise(_located(distinct, boxes, nums))
    ref_chunks = _chunk_counts(refs, chunk_rows, "ref_chunks")
    refs = _chunked(refs, ref_chunks, "ref_chunks", "ref_key", "ref_chunk")

    probes = materialise(_located(probes, boxes, nums))
    first = refs.where(F.col("ref_chunk") == 0)
    visits = materialise(_visits(probes, first, boxes, k, cats, nums, chunk_rows, n_refs))

    probe_chunks = _chunk_counts(visits, chunk_rows, "probe_chunks")
    left = (
        _chunked(visits, probe_chunks, "probe_chunks", "probe_id", "probe_chunk")
        .join(F.broadcast(ref_chunks), "box")
        .withColumn("ref_chunk", F.explode(F.sequence(F.lit(0), F.col("ref_chunks") - 1)))
        .drop("ref_chunks")
    )
    right = refs.join(F.broadcast(probe_chunks), "box").withColumn(
        "probe_chunk", F.explode(F.sequence(F.lit(0), F.col("probe_chunks") - 1))
    )
    by = ["box", "ref_chunk", "probe_chunk"]

    def meet(key: tuple[pa.Scalar, ...], mine: pa.Table, theirs: pa.Table) -> pa.Table:
        near = [pa.array([], pa.int64())] * 2 + [pa.array([], _NEAR)]
        if len(mine) and len(theirs):
            side = _Side(mine, theirs, cats, nums)
            row, ref, d = side.nearest(k, mine.column("radius_sq").to_numpy())
            order = np.argsort(row, kind="stable")
            row, ref, d = row[order], pa.array(ref[order]), d[order]
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
            told = [pa.array(d), *[_whole(side.refs.column(c).take(ref)) for c in ("ref_key", "label")]]
            items = pa.StructArray.from_arrays(told, fields=list(_NEAR.value_type))
            lists = pa.ListArray.from_arrays(pa.array([*first, len(row)], pa.int32()), items)
            near = [*[_whole(mine.column(c).take(pa.array(row[first]))) for c in ("probe_id", "probe_key")], lists.cast(_NEAR)]
        return pa.table([near[0], near[1].cast(pa.string()), near[2]], names=["probe_id", "probe_key", "near"])

    candidates = (
        _dealt(left, by, n_refs)
        .groupBy(*by)
        .cogroup(_dealt(right, by, n_refs).groupBy(*by))
        .applyInArrow(meet, "probe_id bigint, probe_key string, near array<struct<distance_sq:double,ref_key:string,label:double>>")
    )
    # A probe's candidates are few: up to k per chunk it visited.
    each = candidates.groupBy("probe_id").agg(F.first("probe_key").alias(key), F.flatten(F.collect_list("near")).alias("near"))
    placed = each.select(key, F.posexplode(F.slice(F.array_sort("near"), 1, k)).alias("place", "n"))
    return placed.select(key, (F.col("place") + 1).alias("place"), "n.ref_key", "n.distance_sq", "n.label")


_NEAR = pa.list_(pa.struct([("distance_sq", pa.float64()), ("ref_key", pa.string()), ("label", pa.float64())]))


def _whole(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _with_known(probes: DataFrame, refs: DataFrame, cats) -> DataFrame:
    """Marks per category column whether the probe's value occurs among the references."""
    if not cats:
        return probes
    seen = materialise(refs.select(*cats).distinct())
    for c in cats:
        values = seen.select(F.col(c), F.lit(True).alias(f"{c}_known")).distinct()
        probes = probes.join(values, c, "left").withColumn(f"{c}_known", F.coalesce(f"{c}_known", F.lit(False)))
    return probes


def _dealt(df: DataFrame, by, n_refs: int) -> DataFrame:
    """Spread chunks over all cores: few bytes here are much arithmetic, so the
    partitions must not be merged by size."""
    spark = df.sparkSession
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism, n_refs // PART_ROWS)
    return df.repartition(partitions, *by)


def _located(df: DataFrame, boxes: Boxes, nums) -> DataFrame:
    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(box=boxes.locate(frame[nums].to_numpy(float)).astype("int32"))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(place, f"{fields}, box int")


def _chunk_counts(df: DataFrame, chunk_rows: int, name: str) -> DataFrame:
    """Chunks per box: at most one short row per box, so it may be broadcast."""
    counts = df.groupBy("box").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias(name))
    return materialise(counts)


def _chunked(df: DataFrame, counts: DataFrame, name: str, key: str, chunk: str) -> DataFrame:
    number = F.pmod(F.xxhash64(key), F.col(name)).cast("int")
    return df.join(F.broadcast(counts), "box").withColumn(chunk, number).drop(name)


def _visits(probes: DataFrame, first: DataFrame, boxes: Boxes, k: int, cats, nums, chunk_rows: int, n_refs: int) -> DataFrame:
    """One row per probe and box it has to visit, with the bound of its k-th distance.

    A probe whose own box holds fewer than ``k`` references has no bound yet
    and visits every box.
    """
    counts = _chunk_counts(probes, chunk_rows, "probe_chunks")
    mine = _chunked(probes, counts, "probe_chunks", "probe_id", "probe_chunk")
    theirs = first.join(F.broadcast(counts), "box").withColumn(
        "probe_chunk", F.explode(F.sequence(F.lit(0), F.col("probe_chunks") - 1))
    )
    columns = [c for c in probes.columns if c != "box"]

    def bound(key: tuple[pa.Scalar, ...], here: pa.Table, near_by: pa.Table) -> pa.Table:
        radius = np.full(len(here), np.inf)
        if len(near_by) >= k and len(here):
            row, _, d = _Side(here, near_by, cats, nums).nearest(k, None)
            # In order of distance: the last one of a probe is its k-th, if it has as many.
            n = np.bincount(row, minlength=len(here))
            farthest = np.full(len(here), -np.inf)
            np.maximum.at(farthest, row, d)
            radius = np.where(n >= k, farthest, np.inf)
        x = _numbers(here, nums)
        reach = []
        for start in range(0, len(here), _SLICE):
            part = x[start : start + _SLICE]
            limit = _wider(radius[start : start + _SLICE])
            near = boxes.within(part, limit.max())
            gap = boxes.gap_sq(part, near)
            reach += [near[row] for row in gap <= limit[:, None]]
        lists = pa.ListArray.from_arrays(
            pa.array(np.cumsum([0, *map(len, reach)]), pa.int32()), pa.array(np.concatenate(reach) if reach else [], pa.int32())
        )
        out = here.select(columns).append_column("radius_sq", pa.array(radius, pa.float64()))
        return out.append_column("boxes", lists)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in probes.schema.fields if f.name != "box")
    by = ["box", "probe_chunk"]
    found = (
        _dealt(mine, by, n_refs)
        .groupBy(*by)
        .cogroup(_dealt(theirs, by, n_refs).groupBy(*by))
        .applyInArrow(bound, f"{fields}, radius_sq double, boxes array<int>")
    )
    return found.withColumn("box", F.explode("boxes")).drop("boxes")
