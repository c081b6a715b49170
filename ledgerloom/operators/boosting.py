"""Boosted trees; rows are packed into blocks once, and only sums leave the tasks that hold them.

Rows stand in their blocks column by column, and each task adds up its rows per
(node, feature, code); these sums are sent to be weighed. A number with more
than ``forests.CODES`` values is coded by bins, and its values are kept beside
the codes: the bins' sums bound the gain of any cut inside a bin, and where a bin
may hold the best cut its values are added up one by one in a second pass. So
every value is a possible cut, however many rows or values there are.

AdaBoost.R2 joins trees on weighted resamples by their weighted median. In each
round every row is drawn as often as its weight says, by a hash of (seed,
round, row), so a retried task draws the same rows; all rows are then weighed
anew by their error on the tree. The state of a round is a written table, which
replaces the one before it.

Gradient boosting with squared loss grows each tree on what the trees before it
left of the labels. The residuals are written every ``WRITTEN`` rounds; between
them they follow from the rows' codes and the few trees since.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import forests as fo
from ledgerloom.operators.forests import Coder, Top, Tree, _between, child_names, learn_codes, resampled
from ledgerloom.session import Rounds

WRITTEN = 10  # rounds of gradient boosting between written residuals
BLOCK_ROWS = 1 << 16  # rows packed into one record, about
TASK_ROWS = 1 << 13  # fewer are not worth a task of their own


# -- rows in blocks ---------------------------------------------------------------------------

_PLAIN = "codes binary, exact binary, label binary"
_KEYED = f"{_PLAIN}, rows binary, w binary, total double"


@dataclass
class Block:
    """features x rows of codes, the values of the wide numbers, and per row a target and how often it counts (once, if None)."""

    codes: np.ndarray
    exact: dict[int, np.ndarray]
    y: np.ndarray
    w: np.ndarray | None = None

    def entries(self, top: Top) -> np.ndarray:
        return top.entries(self.codes.T, exact=self.exact)

    def answers(self, top: Top) -> np.ndarray:
        at, out = self.entries(top), np.zeros(len(self.y))
        for name, value in top.values.items():
            out[at == np.uint64(name)] = value
        return out


Opener = Callable[[pa.RecordBatch], Iterator[Block]]


def _blocks(train: DataFrame, coder: Coder, parts: int, keyed: bool = False) -> DataFrame:
    """The labelled rows, about ``BLOCK_ROWS`` a record; ``keyed``: with their hashes and a weight of 1 each."""
    wide = coder.wide

    def told(held: list[list[pa.Array]]) -> pa.RecordBatch:
        row, label, *columns = [pa.concat_arrays(x) for x in zip(*held, strict=True)]
        raw = coder.raw(columns)
        packed = [coder.codes(raw).T, raw[:, wide].T, label.to_numpy(zero_copy_only=False)]
        packed += [row.to_numpy(zero_copy_only=False), np.ones(len(row))] if keyed else []
        arrays = [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in packed]
        arrays += [pa.array([float(len(row))])] if keyed else []
        return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in (_KEYED if keyed else _PLAIN).split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch.columns)
                n += len(batch)
            if n >= BLOCK_ROWS:
                yield told(held)
                held, n = [], 0
        if n:
            yield told(held)

    rows = train.where(F.col("label").isNotNull()).select(
        F.xxhash64("row_key").alias("row"), F.col("label").cast("double").alias("label"),
        *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(coder.cats)],
        *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(coder.nums)],
    )
    return rows.repartition(parts).mapInArrow(run, _KEYED if keyed else _PLAIN)


def _parts(spark: SparkSession, rows: int) -> int:
    """As many parts as there are cores, more where a part would hold many blocks."""
    return max(min(-(-rows // TASK_ROWS), 2 * spark.sparkContext.defaultParallelism), -(-rows // (4 * BLOCK_ROWS)), 1)


def _packed(batch: pa.RecordBatch, coder: Coder) -> Iterator[tuple[Block, dict[str, bytes]]]:
    """Each record as a block whose target is its label, and its bytes."""
    for r in batch.to_pylist():
        label = np.frombuffer(r["label"])
        values = np.frombuffer(r["exact"]).reshape(len(coder.wide), len(label))
        codes = np.frombuffer(r["codes"], np.uint16).reshape(len(coder.sizes), len(label))
        yield Block(codes, dict(zip(coder.wide, values, strict=True)), label), r


def _residuals(coder: Coder, shift: float, since: list[Top], rate: float) -> Opener:
    """What is left of the labels."""

    def opened(batch: pa.RecordBatch) -> Iterator[Block]:
        for block, _ in _packed(batch, coder):
            block.y = block.y - shift
            if since:
                block.y = block.y - rate * sum((block.answers(t) for t in since), np.zeros(len(block.y)))
            yield block

    return opened


def _resamples(coder: Coder, shift: float, seed: int, turn: int, scale: float) -> Opener:
    """The labels, less ``shift``, and how often each row is drawn."""

    def opened(batch: pa.RecordBatch) -> Iterator[Block]:
        for block, r in _packed(batch, coder):
            block.y = block.y - shift
            block.w = resampled(seed, turn, np.frombuffer(r["rows"], np.int64), np.frombuffer(r["w"]) * scale)
            yield block

    return opened


def _left(coder: Coder, opened: Opener):
    """The blocks with what is left of the labels in their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = pa.array([b.y.tobytes() for b in opened(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("codes"), batch.column("exact"), left], ["codes", "exact", "label"])

    return run


# -- shallow trees from sums per code ---------------------------------------------------------

_SUMS = "part int, node bigint, feature int, low double, high double, codes binary, n binary, s binary, up binary"


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()),
             "array<double>": pa.list_(pa.float64())}
    fields = [c.split() for c in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def _node_sums(coder: Coder, opened: Opener, top: Top, nodes: dict[int, float]):
    """Rows and sums of what the targets exceed their node's value in ``nodes`` by, per (node, feature, code) that
    occurs in a task, for wide numbers the sums of the positive ones too, and the least and greatest of the node."""
    sizes = [size + (f < len(coder.cats)) for f, size in enumerate(coder.sizes)]
    known = np.array(sorted(nodes), np.uint64)
    start = np.array([nodes[int(name)] for name in known])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = len(known)
        n, s, up = ([np.zeros(many * size) for size in sizes] for _ in range(3))
        low, high = np.full(many, np.inf), np.full(many, -np.inf)
        for batch in batches:
            for block in opened(batch):
                at = block.entries(top)
                place = np.minimum(np.searchsorted(known, at), many - 1)
                mine = known[place] == at
                here = np.flatnonzero(mine if block.w is None else mine & (block.w > 0))
                place, y = place[here], block.y[here] - start[place[here]]
                w = None if block.w is None else block.w[here].astype(float)
                sums = y if w is None else w * y
                positive = np.maximum(sums, 0.0) if coder.wide else None
                for f, size in enumerate(sizes):
                    key = place * size + block.codes[f][here]
                    n[f] += np.bincount(key, w, many * size)
                    s[f] += np.bincount(key, sums, many * size)
                    if f in coder.wide:
                        up[f] += np.bincount(key, positive, many * size)
                for i in range(many):
                    mine = y[place == i] if many > 1 else y
                    if len(mine):
                        low[i], high[i] = min(low[i], mine.min()), max(high[i], mine.max())
        told = []
        for i, name in enumerate(known.astype(np.int64).tolist()):
            for f, size in enumerate(sizes):
                ni, si, ui = (x[f][i * size : (i + 1) * size] for x in (n, s, up))
                code = np.flatnonzero(ni)
                if len(code):
                    told.append((TaskContext.get().partitionId(), name, f, low[i], high[i], code.astype(np.uint16).tobytes(), ni[code].tobytes(), si[code].tobytes(), ui[code].tobytes() if f in coder.wide else b""))
        yield _table(told, _SUMS)

    return run


_BEST = (
    "node bigint, feature int, mean double, score double, threshold double, last_code int, codes array<int>, left_mean double, "
    "right_mean double, rows double, bins array<int>, bounds array<double>, n array<double>, s array<double>, next array<int>"
)


def _best_cut(coder: Coder, nodes: dict[int, float]):
    """The best cut of one node on one feature; no score if there is none.

    For a wide number: the best gain of a cut between bins as ``score``, and per bin a bound
    for the cuts inside and at its end, rows and sum before it, and the next bin with rows.
    """
    n_cats = len(coder.cats)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        node, f = (k.as_py() for k in key)
        n, s, up = (np.zeros(coder.sizes[f] + 1) for _ in range(3))
        for r in sorted(table.to_pylist(), key=lambda r: r["part"]):
            code = np.frombuffer(r["codes"], np.uint16)
            n[code] += np.frombuffer(r["n"])
            s[code] += np.frombuffer(r["s"])
            if f in coder.wide:
                up[code] += np.frombuffer(r["up"])
        start, rows = nodes[node % (1 << 64)], n.sum()
        mean = s.sum() / rows
        low, high = min(table.column("low").to_pylist()) - mean, max(table.column("high").to_pylist()) - mean
        code = np.flatnonzero(n)
        n, s, up = n[code], s[code] - n[code] * mean, up[code]
        best, bins = (None, 0.0, 0, None, 0.0, 0.0), ([], [], [], [], [])
        if low < high and f in coder.wide:
            floor, bounds, before_n, before_s = fo.bin_bounds(n, s, up, mean, max(-low, high))
            best = (floor if len(code) > 1 else None, *best[1:])
            bins = (code, bounds, before_n, before_s, np.append(code[1:], -1))
        elif low < high and len(code) > 1:
            if f < n_cats:
                order = np.lexsort((code, s / n))
                code, n, s = code[order], n[order], s[order]
            nl, sl = np.cumsum(n)[:-1], np.cumsum(s)[:-1]
            gains = sl * sl / nl + sl * sl / (rows - nl)
            score = gains.max()
            k = int(np.argmax(gains >= score * (1 - fo.TIE)))
            means = start + mean + sl[k] / nl[k], start + mean - sl[k] / (rows - nl[k])
            if f < n_cats:
                best = (score, 0.0, 0, code[: k + 1].tolist(), *means)
            else:
                values = coder.values[f - n_cats]
                middle = _between(values[code[k : k + 1]], values[code[k + 1 : k + 2]])[0]
                # Rows that were not drawn may have codes in between: they go by the threshold too.
                last = int(np.searchsorted(values, middle, "right")) - 1
                best = (score, float(middle), last, None, *means)
        return pa.Table.from_batches([_table([(node, f, start + mean, *best, rows, *bins)], _BEST)])

    return run


_VALUES = "part int, node bigint, feature int, x binary, n binary, s binary"


def _value_sums(coder: Coder, opened: Opener, top: Top, asked: dict[tuple[int, int], "Asked"]):
    """Rows and sums per value in the bins that are asked for, as ``_node_sums`` gives them per code."""
    marks = {}
    for (name, f), a in asked.items():
        marks[name, f] = np.zeros(coder.sizes[f], bool)
        marks[name, f][[*a.bins, *a.next]] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {key: [] for key in asked}
        for batch in batches:
            for block in opened(batch):
                at = block.entries(top)
                for (name, f), mark in marks.items():
                    mine = (at == np.uint64(name)) & mark[block.codes[f]]
                    here = np.flatnonzero(mine if block.w is None else mine & (block.w > 0))
                    if len(here):
                        y, w = block.y[here] - asked[name, f].start, np.ones(len(here)) if block.w is None else block.w[here].astype(float)
                        held[name, f].append(fo.per_value(block.exact[f][here], w, w * y))
        told = []
        for (name, f), parts in held.items():
            if parts:
                x, n, s = fo.per_value(*[np.concatenate(c) for c in zip(*parts, strict=True)])
                told.append((TaskContext.get().partitionId(), int(np.uint64(name).astype(np.int64)), f, x.tobytes(), n.tobytes(), s.tobytes()))
        yield _table(told, _VALUES)

    return run


@dataclass
class Asked:
    """Bins of one node and wide number that may hold the best cut, by ``_best_cut``'s figures."""

    start: float  # what the sums are taken from
    mean: float
    rows: float
    bins: list[int]
    n: list[float]
    s: list[float]
    next: list[int]


def _best_value(coder: Coder, asked: dict[tuple[int, int], Asked]):
    """The best cut at any value of the bins asked for."""
    n_cats = len(coder.cats)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        node, f = (k.as_py() for k in key)
        a = asked[node % (1 << 64), f]
        parts = sorted(table.to_pylist(), key=lambda r: r["part"])
        x, n, s = fo.per_value(*[np.concatenate([np.frombuffer(r[c]) for r in parts]) for c in ("x", "n", "s")])
        values = coder.values[f - n_cats]
        code = np.minimum(np.searchsorted(values, x, "left"), len(values) - 1)
        best = fo.best_value(x, code, n, s - n * (a.mean - a.start), a.bins, a.n, a.s, a.rows)
        if best is None:
            told = (None, 0.0, 0, None, 0.0, 0.0)
        else:
            score, threshold, _, left, right = best
            told = (score, threshold, 0, None, a.mean + left, a.mean + right)
        return pa.Table.from_batches([_table([(node, f, a.mean, *told, a.rows, [], [], [], [], [])], _BEST)])

    return run


def _cuts(blocks: DataFrame, coder: Coder, opened: Opener, top: Top, nodes: dict[int, float]) -> dict[int, list]:
    """Per node the best cut of each feature."""
    tasks = blocks.sparkSession.sparkContext.defaultParallelism
    sums = blocks.mapInArrow(_node_sums(coder, opened, top, nodes), _SUMS)
    sums = sums.repartition(min(tasks, len(nodes) * len(coder.sizes)), "node", "feature")
    found: dict[int, list] = {}
    for r in sums.groupBy("node", "feature").applyInArrow(_best_cut(coder, nodes), _BEST).collect():
        found.setdefault(r["node"] % (1 << 64), []).append(r)
    asked: dict[tuple[int, int], Asked] = {}
    for name, rows in found.items():
        least = max((r["score"] for r in rows if r["score"] is not None), default=0.0) * (1 - 2 * fo.TIE)
        for r in rows:
            keep = [i for i, bound in enumerate(r["bounds"]) if bound >= least and bound > 0]
            if keep:
                bins, n, s, after = ([r[c][i] for i in keep] for c in ("bins", "n", "s", "next"))
                asked[name, r["feature"]] = Asked(nodes[name], r["mean"], r["rows"], bins, n, s, [b for b in after if b >= 0])
        found[name] = [r for r in rows if r["feature"] not in coder.wide or (name, r["feature"]) not in asked]
    if asked:
        sums = blocks.mapInArrow(_value_sums(coder, opened, top, asked), _VALUES)
        sums = sums.repartition(min(tasks, len(asked)), "node", "feature")
        for r in sums.groupBy("node", "feature").applyInArrow(_best_value(coder, asked), _BEST).collect():
            found[r["node"] % (1 << 64)].append(r)
    # What stands for a wide number without bins asked for is no cut.
    return {
        name: [(r["feature"], r["mean"], None if len(r["bins"]) else r["score"], r) for r in sorted(rows, key=lambda r: r["feature"])]
        for name, rows in found.items()
    }


def _shallow(blocks: DataFrame, coder: Coder, depth: int, tree: int, opened: Opener, shift: float = 0.0) -> Top:
    """One tree on the targets, a pass or two over the blocks per level; every leaf's value, plus ``shift``, is known here."""
    top, nodes = Top(tree), {tree: 0.0}
    for level in range(max(depth, 1)):
        cuts = _cuts(blocks, coder, opened, top, nodes)
        nodes = {}
        for name, found in sorted(cuts.items()):
            best, score = None, -np.inf
            for _, _, gain, r in found:
                if gain is not None and gain > score * (1 + fo.TIE):
                    best, score = r, gain
            if best is None or depth < 1:
                top.values[name] = found[0][1] + shift
                continue
            left, right = (int(x) for x in child_names(np.array([name], np.uint64)))
            codes = None if best["codes"] is None else np.array(best["codes"])
            top.splits[name] = (best["feature"], best["threshold"], best["last_code"], codes, left, right)
            if level + 1 < depth:
                nodes |= {left: best["left_mean"], right: best["right_mean"]}
            else:
                top.values |= {left: best["left_mean"] + shift, right: best["right_mean"] + shift}
        if not nodes:
            break
    return top


# -- fits -------------------------------------------------------------------------------------


def _missed(coder: Coder, top: Top):
    """Per task the greatest error of a tree, and the sum of weight times error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for block, r in _packed(batch, coder):
                error = np.abs(block.answers(top) - block.y)
                told.append((float(error.max()), float(np.frombuffer(r["w"]) @ error)))
            yield _table(told, "worst double, missed double")

    return run


def _weighed(coder: Coder, top: Top, beta: float, worst: float):
    """The blocks with new weights: a row's is taken times ``beta``, the less the greater its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = [np.frombuffer(r["w"]) * beta ** (1.0 - np.abs(block.answers(top) - block.y) / worst) for block, r in _packed(batch, coder)]
            kept = [batch.column(c) for c in ("codes", "exact", "label", "rows")]
            told = [pa.array([x.tobytes() for x in w], pa.binary()), pa.array([float(x.sum()) for x in w], pa.float64())]
            yield pa.RecordBatch.from_arrays([*kept, *told], [c.split()[0] for c in _KEYED.split(", ")])

    return run


def fit_adaboost(train: DataFrame, cats, nums, rounds: int, depth: int, *, seed: int = 42) -> "BoostedModel":
    """Linear loss. Ends early at a perfect tree, or at one whose mean loss is a half or more, which is not kept
    unless it is the first."""
    spark = train.sparkSession
    coder = learn_codes(train, cats, nums)
    seen = train.agg(F.count("label").alias("n"), F.avg(F.col("label").cast("double")).alias("mean")).first()
    total = n = seen["n"]
    shift = seen["mean"] or 0.0
    written = Rounds()
    state = written.write(_blocks(train, coder, _parts(spark, n), keyed=True))
    trees: list[Tree] = []
    votes: list[float] = []
    for turn in range(rounds):
        top = _shallow(state, coder, depth, turn, _resamples(coder, shift, seed, turn, n / total), shift)
        tree = Tree(top, {})
        told = state.mapInArrow(_missed(coder, top), "worst double, missed double")
        seen = told.agg(F.max("worst").alias("worst"), F.sum("missed").alias("missed")).first()
        if not seen["worst"]:
            trees.append(tree)
            votes.append(1.0)
            break
        loss = seen["missed"] / seen["worst"] / total
        if loss >= 0.5:
            if not trees:
                trees, votes = [tree], [1.0]
            break
        beta = loss / (1.0 - loss)
        trees.append(tree)
        votes.append(math.log(1.0 / beta))
        if turn + 1 < rounds:
            state = written.write(state.mapInArrow(_weighed(coder, top, beta, seen["worst"]), _KEYED))
            total = state.agg(F.sum("total")).first()[0]
    written.close(spark)
    return BoostedModel(coder, trees, votes)


def fit_gradient(train: DataFrame, cats, nums, rounds: int, depth: int, rate: float, *, seed: int = 42) -> "GradientModel":
    """Squared loss, from the mean label on; a leaf answers with the mean residual of its rows. No labels: 0."""
    spark = train.sparkSession
    coder = learn_codes(train, cats, nums)
    seen = train.agg(F.count("label").alias("n"), F.avg(F.col("label").cast("double")).alias("mean")).first()
    base = seen["mean"] or 0.0
    written = Rounds()
    state = written.write(_blocks(train, coder, _parts(spark, seen["n"])))
    shift, trees, since = base, [], []
    for turn in range(rounds):
        if len(since) == WRITTEN:
            state = written.write(state.mapInArrow(_left(coder, _residuals(coder, shift, since, rate)), _PLAIN))
            shift, since = 0.0, []
        top = _shallow(state, coder, depth, turn, _residuals(coder, shift, since, rate))
        trees.append(Tree(top, {}))
        since.append(top)
    written.close(spark)
    return GradientModel(coder, trees, base, rate)


class BoostedModel:
    """Trees with vote weights; the answer is the weighted median of their predictions."""

    kind = "boosted"
    needs_vectors = False

    def __init__(self, coder: Coder, trees: list[Tree], votes: list[float]):
        self.coder, self.trees, self.votes = coder, trees, votes

    def predict(self, df: DataFrame) -> DataFrame:
        coder, trees, votes = self.coder, self.trees, np.array(self.votes)

        def median(*columns: pa.Array) -> pa.Array:
            raw = coder.raw(list(columns))
            told = np.stack([t.predict(raw, len(coder.cats)) for t in trees], axis=1)
            order = np.argsort(told, axis=1, kind="stable")
            reached = np.cumsum(votes[order], axis=1)
            at = (reached >= 0.5 * reached[:, -1:]).argmax(axis=1)
            return pa.array(told[np.arange(len(told)), order[np.arange(len(told)), at]])

        return df.withColumn("prediction", F.arrow_udf(median, "double")(*coder.cats, *coder.nums))

    def save(self, path: str, spark: SparkSession) -> dict:
        return {"votes": self.votes, **_write_trees(path, spark, self.coder, self.trees)}

    @classmethod
    def load(cls, spark: SparkSession, path: str, meta: dict) -> "BoostedModel":
        return cls(*_read_trees(spark, path, meta), meta["votes"])


class GradientModel:
    """A start value and trees whose answers are added at a rate."""

    kind = "gradient"
    needs_vectors = False

    def __init__(self, coder: Coder, trees: list[Tree], base: float, rate: float):
        self.coder, self.trees, self.base, self.rate = coder, trees, base, rate

    def predict(self, df: DataFrame) -> DataFrame:
        coder, trees, base, rate = self.coder, self.trees, self.base, self.rate

        def added(*columns: pa.Array) -> pa.Array:
            raw = coder.raw(list(columns))
            return pa.array(base + rate * sum((t.predict(raw, len(coder.cats)) for t in trees), np.zeros(len(raw))))

        return df.withColumn("prediction", F.arrow_udf(added, "double")(*coder.cats, *coder.nums))

    def stages(self):
        """A column with each tree's answer and the prediction before it, in order."""
        coder, trees, base, rate = self.coder, self.trees, self.base, self.rate

        def told(*columns: pa.Array) -> pa.Array:
            raw = coder.raw(list(columns))
            each = np.stack([t.predict(raw, len(coder.cats)) for t in trees], axis=1)
            before = base + rate * (np.cumsum(each, axis=1) - each)
            pairs = pa.StructArray.from_arrays([pa.array(each.ravel()), pa.array(before.ravel())], ["value", "before"])
            return pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1) * len(trees), pa.int32()), pairs)

        return F.arrow_udf(told, "array<struct<value:double,before:double>>")(*coder.cats, *coder.nums)

    def save(self, path: str, spark: SparkSession) -> dict:
        return {"base": self.base, "rate": self.rate, **_write_trees(path, spark, self.coder, self.trees)}

    @classmethod
    def load(cls, spark: SparkSession, path: str, meta: dict) -> "GradientModel":
        return cls(*_read_trees(spark, path, meta), meta["base"], meta["rate"])


def _write_trees(path: str, spark: SparkSession, coder: Coder, trees: list[Tree]) -> dict:
    lines = [json.dumps(["labels", list(x)]) for x in coder.labels]
    lines += [json.dumps(["values", x.tolist()]) for x in coder.values]
    lines += [json.dumps(["tree", t.told()]) for t in trees]
    spark.createDataFrame(list(enumerate(lines)), "i int, line string").coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
    return {"cats": list(coder.cats), "nums": list(coder.nums)}


def _read_trees(spark: SparkSession, path: str, meta: dict) -> tuple[Coder, list[Tree]]:
    told = [json.loads(r["line"]) for r in spark.read.parquet(f"{path}/trees").orderBy("i").collect()]
    coder = Coder(
        tuple(meta["cats"]), tuple(meta["nums"]), tuple(tuple(x) for kind, x in told if kind == "labels"),
        tuple(np.array(x, float) for kind, x in told if kind == "values"),
    )
    return coder, [Tree.read(x) for kind, x in told if kind == "tree"]
