"""Forests of fully grown regression trees, built and walked in bounded pieces.

A category is coded by its place among the sorted labels; a number is kept as it
is, and every value of it is a possible cut. All trees grow together. While a
node holds more than ``LOCAL_ROWS`` rows, its split is found from sums over all
tasks, one level of all trees at a time. A node with fewer rows is finished in
its own group, level by level over all its nodes at once; there a number is
coded by its place among the group's own values. Where the one ends and the other
begins changes no split, but for sums added in another order.

``random_forest`` draws rows with replacement (Poisson weights) and takes the
best cut over all features; a category splits after its labels are ordered by
their mean. In large nodes sums over bins bound the gain of the cuts inside each
bin, and bins that may hold the best cut are added up value by value.
``random_cuts`` uses all rows; a number's cut is drawn between its
least and greatest value in the node, a category's candidates are its labels
one by one, and the best of these is taken. All draws are hashes of (seed, tree,
row) or (seed, tree, node, feature), so retries and partitioning change nothing.

Rows are dealt to the nodes for at most ``DEALT_BYTES`` of trees at a time, and
the shuffle files of one block of trees are released before the next.

A fitted forest is a table with one row per finished piece, packed as arrays. A
forest of up to ``HELD_BLOCKS`` blocks of ``BLOCK_BYTES`` is scored in one pass
over the rows per block. The pieces of a larger one never pass through the
driver: each row is dealt to the piece it reaches in every tree, again for
``DEALT_BYTES`` at a time, and the answers are added up per chunk of rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import Rounds, materialise, release_shuffles, scratch_path

LOCAL_ROWS = 1 << 19  # rows of a node, counted as often as drawn, that one group finishes
CODES = 65_535  # labels of a category, and values of a number that boosting tells apart by codes alone
QUANTILES = 4_095  # bins of its numbers with more values
BINS = 512  # bins of a number in a forest's large nodes
GATHERED = 1 << 15  # rows packed at a time
SUMS_BYTES = 64 << 20  # grouped sums a task holds at once
BLOCK_BYTES = 64 << 20  # packed nodes a scoring pass hands to each executor
HELD_BLOCKS = 1  # such passes; beyond them rows are dealt to the pieces
DEALT_BYTES = 2 << 30  # rows dealt to trees at a time, before compression
CHUNK = 16  # bits of a row number within a chunk of scored rows
UNLIMITED = 1 << 30
TIE = 1e-9  # gains this close count as equal: the first feature and the lowest cut win

LEAF = 255
_PIECE = "tree int, entry bigint, nodes int, features binary, numbers binary, lefts binary"
_ANSWER = "chunk bigint, tree int, answers binary"
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _hash(*parts) -> np.ndarray:
    """64 bits from any whole numbers or arrays of them."""
    total = np.zeros(1, np.uint64)
    for part in parts:
        total = _mix(total + _STEP + np.asarray(part).astype(np.uint64))
    return total


def _uniform(*parts) -> np.ndarray:
    return (_hash(*parts) >> np.uint64(11)).astype(float) / float(1 << 53)


# P(X <= k) of a Poisson variable with mean 1: how often a row is drawn.
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 18)]))


def row_weights(seed: int, tree: int, rows: np.ndarray) -> np.ndarray:
    """How often each row is drawn into a tree's sample."""
    return np.searchsorted(_POISSON, _uniform(seed, tree, rows), "right").astype(np.uint32)


def resampled(seed: int, turn: int, rows: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """How often each row is drawn when its expected count is given: Poisson draws, rounded normal ones beyond 32."""
    u = _uniform(seed, turn, rows)
    many = expected > 32
    left = np.where(many, 0.0, expected)
    out = np.zeros(len(rows), np.int64)
    chance = np.exp(-left)
    reached = chance.copy()
    rest = np.flatnonzero((u >= reached) & ~many)
    k, short, left, chance, reached = 0, u[rest], left[rest], chance[rest], reached[rest]
    while len(rest) and k < 200:
        k += 1
        out[rest] = k
        chance = chance * left / k
        reached = reached + chance
        on = short >= reached
        rest, short, left, chance, reached = rest[on], short[on], left[on], chance[on], reached[on]
    if many.any():
        radius = np.sqrt(-2 * np.log(1 - u[many]))
        turned = radius * np.cos(2 * np.pi * _uniform(seed, turn, rows[many], 1))
        out[many] = np.maximum(np.rint(expected[many] + np.sqrt(expected[many]) * turned), 0).astype(np.int64)
    return out.astype(np.uint32)


@dataclass(frozen=True)
class Coder:
    """The labels of each category and the distinct values of each number; a forest as a whole needs no values."""

    cats: tuple[str, ...]
    nums: tuple[str, ...]
    labels: tuple[tuple[str, ...], ...]
    values: tuple[np.ndarray, ...]
    wide: tuple[int, ...] = ()  # the numbers of which only bins are coded; ``values`` holds where these end

    @property
    def sizes(self) -> list[int]:
        return [len(x) for x in (*self.labels, *self.values)]

    def raw(self, columns: list[pa.Array]) -> np.ndarray:
        """rows x features: label places (one beyond the last if unknown) and the numbers; a missing number sorts first."""
        out = []
        for labels, column in zip(self.labels, columns):
            place = pc.index_in(_whole(column).cast(pa.string()), value_set=pa.array(labels, pa.string()))
            out.append(place.fill_null(len(labels)).to_numpy(zero_copy_only=False).astype(float))
        for column in columns[len(self.cats) :]:
            x = _whole(column).cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
            out.append(np.where(np.isnan(x), -np.inf, x))
        return np.stack(out, axis=1) if out else np.zeros((0, 0))

    def codes(self, raw: np.ndarray) -> np.ndarray:
        out = raw.copy()
        for i, values in enumerate(self.values, len(self.cats)):
            out[:, i] = np.minimum(np.searchsorted(values, raw[:, i], "left"), len(values) - 1)
        return out.astype(np.uint16 if max(self.sizes, default=0) <= CODES + 1 else np.uint32)


def _whole(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def learn_labels(train: DataFrame, cats) -> tuple[tuple[str, ...], ...]:
    """The sorted labels of each category; at most ``CODES`` of one reach the driver, more raise."""
    labels = []
    for c in cats:
        found = [r[0] for r in train.select(F.col(c).cast("string")).distinct().limit(CODES + 1).collect()]
        if len(found) > CODES:
            raise ValueError(f"{c} has more than {CODES} labels")
        labels.append(tuple(sorted(x for x in found if x is not None)))
    return tuple(labels)


def _number(c: str):
    """A missing number sorts first."""
    return F.coalesce(F.when(F.isnan(c), None).otherwise(F.col(c).cast("double")), F.lit(float("-inf")))


def bin_edges(column: DataFrame, most: int, bins: int) -> tuple[np.ndarray, bool]:
    """The values of the column ``x``, or where there are more than ``most`` the ends of about ``bins`` bins; whether these are bins."""
    found = [r[0] for r in column.distinct().limit(most + 1).collect()]
    many = len(found) > most
    if many:
        places = [i / bins for i in range(bins + 1)]
        found = set(column.agg(F.percentile_approx("x", places, 10 * bins)).first()[0])
    return np.array(sorted(found) or [0.0]), many


def learn_codes(train: DataFrame, cats, nums) -> Coder:
    """At most ``CODES`` labels or values per column reach the driver; a number with more of them is coded by bins."""
    values, wide = [], []
    labels = learn_labels(train, cats)
    for c in nums:
        found, many = bin_edges(train.select(_number(c).alias("x")), CODES, QUANTILES)
        if many:
            wide.append(len(cats) + len(values))
        values.append(found)
    return Coder(tuple(cats), tuple(nums), labels, tuple(values), tuple(wide))


# -- cuts of a number by bins, then by the values of the bins that may hold the best one -------


def per_value(x: np.ndarray, n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight and sum per value, in order."""
    order = np.argsort(x, kind="stable")
    x = x[order]
    heads = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[heads], np.add.reduceat(n[order], heads), np.add.reduceat(s[order], heads)


def bin_bounds(n: np.ndarray, s: np.ndarray, up: np.ndarray, mean: float, reach: float):
    """(best gain of a cut between bins, per bin a bound for cuts inside it and at its end, weight and sum before it).

    ``s`` are the bins' sums around the node's mean, ``up`` the sums of the positive
    targets before ``mean`` was taken from them, ``reach`` is the greatest target around the mean.
    """
    down = s + n * mean - up
    before_n, before_s = np.cumsum(n) - n, np.cumsum(s) - s
    total = n.sum()
    after = total - before_n - n
    most = np.maximum(np.abs(before_s + down - max(mean, 0.0) * n), np.abs(before_s + up - min(mean, 0.0) * n))
    with np.errstate(divide="ignore", invalid="ignore"):
        # The sum on a side is at most its weight times the reach.
        sides = [np.fmin(most * most / x, reach * most) for x in (before_n, after)]
        nl, sl = (before_n + n)[:-1], (before_s + s)[:-1]
        gains = sl * sl / nl + sl * sl / (total - nl)
    return float(gains.max(initial=0.0)), sum(sides) * (1 + 1e-6), before_n, before_s


def best_value(x, code, n, s, bins, before_n, before_s, rows):
    """(gain, threshold, weight to the left, left mean, right mean) of the best cut behind a value of ``bins``, or None; what follows these bins is given too."""
    at = np.minimum(np.searchsorted(bins, code), len(bins) - 1)
    inside = np.asarray(bins)[at] == code
    first = np.searchsorted(code, bins)[at]
    nl, sl = np.cumsum(n), np.cumsum(s)
    nl = np.asarray(before_n)[at] + nl - (nl - n)[first.clip(max=len(x) - 1)]
    sl = np.asarray(before_s)[at] + sl - (sl - s)[first.clip(max=len(x) - 1)]
    here = np.flatnonzero(inside[:-1])
    if not len(here):
        return None
    nl, sl = nl[here], sl[here]
    gains = sl * sl / nl + sl * sl / (rows - nl)
    k = int(np.argmax(gains >= gains.max() * (1 - TIE)))
    threshold = float(_between(x[here[k : k + 1]], x[here[k : k + 1] + 1])[0])
    return float(gains.max()), threshold, nl[k], sl[k] / nl[k], -sl[k] / (rows - nl[k])


# -- growing one node to its end -------------------------------------------------------------


@dataclass
class Piece:
    """A subtree in breadth-first order; node 0 is where it enters.

    ``feature`` is LEAF at a leaf, whose value is in ``number``. A number goes
    left if it is at most ``number``, a category if (node, label) is in ``sets``.
    Children stand side by side: ``left`` and the one behind it.
    """

    feature: np.ndarray
    number: np.ndarray
    left: np.ndarray
    sets: np.ndarray

    def packed(self, n_cats: int) -> dict[str, bytes]:
        """Its bytes, without what follows from the order of the nodes and without the numbers of category splits."""
        return {
            "features": self.feature.tobytes(),
            "numbers": self.number[self.feature >= n_cats].tobytes(),
            "lefts": (self.sets >> 16).astype(np.uint32).tobytes() + (self.sets & 0xFFFF).astype(np.uint16).tobytes(),
        }

    @classmethod
    def unpacked(cls, features: bytes, numbers: bytes, lefts: bytes, n_cats: int) -> "Piece":
        feature = np.frombuffer(features, np.uint8)
        number, left = np.zeros(len(feature)), np.zeros(len(feature), np.int32)
        number[feature >= n_cats] = np.frombuffer(numbers)
        inner = np.flatnonzero(feature != LEAF)
        left[inner] = 1 + 2 * np.arange(len(inner))
        n = len(lefts) // 6
        return cls(feature, number, left, np.frombuffer(lefts, np.uint32, n).astype(np.int64) << 16 | np.frombuffer(lefts, np.uint16, n, 4 * n))


def _runs(node: np.ndarray, code: np.ndarray, size: int, n_nodes: int, w: np.ndarray, s: np.ndarray):
    """Weight and sum per (node, code) that occurs, in that order."""
    key = node * size + code
    if n_nodes * size <= 4 * len(key) + 1024:
        weight = np.bincount(key, w, n_nodes * size)
        at = np.flatnonzero(weight)
        return at // size, at % size, weight[at], np.bincount(key, s, n_nodes * size)[at]
    if n_nodes * size < 1 << 32:
        key = key.astype(np.uint32)
    order = np.argsort(key)
    key = key[order].astype(np.int64)
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    at = key[heads]
    return at // size, at % size, np.add.reduceat(w[order], heads), np.add.reduceat(s[order], heads)


def _by_mean(run_node, run_code, run_mean) -> np.ndarray:
    """The order by (node, mean, code) of runs that stand by (node, code): two plain sorts, and a third one for equal means."""
    rank = np.empty(len(run_node), np.int64)
    rank[np.argsort(run_mean)] = np.arange(len(rank))
    order = np.argsort(run_node * len(rank) + rank)
    node, mean = run_node[order], run_mean[order]
    alike = (node[1:] == node[:-1]) & (mean[1:] == mean[:-1])
    if alike.any():
        tied = np.zeros(run_node[-1] + 1, bool)
        tied[node[1:][alike]] = True
        places = np.flatnonzero(tied[run_node])  # the same in both orders
        order[places] = places[np.lexsort((run_code[places], run_mean[places], run_node[places]))]
    return order


def _best_prefix(run_node, run_w, run_s, total_w, total_s):
    """Per node the best place to cut its ordered runs: (score, run) with score -inf for none."""
    first = np.flatnonzero(np.concatenate([[True], run_node[1:] != run_node[:-1]]))
    wl, sl = np.cumsum(run_w), np.cumsum(run_s)
    wl, sl = wl - (wl - run_w)[first][run_node], sl - (sl - run_s)[first][run_node]
    wr, sr = total_w[run_node] - wl, total_s[run_node] - sl
    last = np.concatenate([first[1:], [len(run_node)]]) - 1
    wr[last] = 1.0
    score = sl * sl / wl + sr * sr / wr
    score[last] = -np.inf
    best = np.maximum.reduceat(score, first)
    hit = np.flatnonzero(score >= best[run_node] * (1 - TIE))
    chosen = hit[np.concatenate([[True], run_node[hit][1:] != run_node[hit][:-1]])]
    return best, chosen


def split_level(coder: Coder, node, codes, w, s, total_w, total_s, cuts=None):
    """The best split of each node of a level; rows are in node order, ``s`` best around each node's mean.

    Returns (feature or -1, threshold, last code to the left, per category the
    (node, code) pairs to the left). ``cuts(feature, low, high)`` gives the cut
    values to take instead of the best ones.
    """
    n_nodes, n_cats = len(total_w), len(coder.cats)
    best = np.full(n_nodes, -np.inf)
    feature = np.full(n_nodes, -1)
    threshold, last_code = np.zeros(n_nodes), np.zeros(n_nodes, np.int64)
    lefts: list[tuple[np.ndarray, np.ndarray]] = []
    every = np.arange(n_nodes)
    first = np.searchsorted(node, every)
    for f, size in enumerate(coder.sizes):
        code = codes[:, f].astype(np.int64)
        is_cat = f < n_cats
        if is_cat or cuts is None:
            run_node, run_code, run_w, run_s = _runs(node, code, size + is_cat, n_nodes, w, s)
        if is_cat and cuts is None:
            order = _by_mean(run_node, run_code, run_s / run_w)
            run_code, run_w, run_s = run_code[order], run_w[order], run_s[order]
        if is_cat and cuts is not None:
            # Each label against the rest.
            wr, sr = total_w[run_node] - run_w, total_s[run_node] - run_s
            alone = wr <= 0
            score = np.where(alone, -np.inf, run_s * run_s / run_w + sr * sr / np.where(alone, 1.0, wr))
            start = np.searchsorted(run_node, every)
            found = np.maximum.reduceat(score, start)
            hit = np.flatnonzero(score >= found[run_node] * (1 - TIE))
            chosen = hit[np.concatenate([[True], run_node[hit][1:] != run_node[hit][:-1]])]
        elif cuts is None:
            found, chosen = _best_prefix(run_node, run_w, run_s, total_w, total_s)
        else:
            values = coder.values[f - n_cats]
            low, high = np.minimum.reduceat(code, first), np.maximum.reduceat(code, first)
            cut = cuts(f, values[low], values[high])
            cut_code = np.clip(np.searchsorted(values, cut, "right") - 1, low, np.maximum(high - 1, low))
            goes = code <= cut_code[node]
            wl, sl = np.add.reduceat(w * goes, first), np.add.reduceat(s * goes, first)
            wr, sr = total_w - wl, total_s - sl
            fits = high > low
            found = np.where(fits, sl * sl / np.where(fits, wl, 1.0) + sr * sr / np.where(fits, wr, 1.0), -np.inf)
        better = found > best * (1 + TIE)
        if is_cat:
            inside = better[run_node]
            inside &= (np.arange(len(run_node)) <= chosen[run_node]) if cuts is None else (np.arange(len(run_node)) == chosen[run_node])
            lefts.append((run_node[inside], run_code[inside]))
        elif cuts is None:
            values = coder.values[f - n_cats]
            here = chosen[better]
            below, above = run_code[here], run_code[np.minimum(here + 1, len(run_code) - 1)]
            threshold[better], last_code[better] = _between(values[below], values[above]), below
        else:
            # What is compared later must part the rows as the codes do.
            above = values[np.minimum(cut_code + 1, len(values) - 1)]
            threshold[better] = np.where(cut < above, cut, values[cut_code])[better]
            last_code[better] = cut_code[better]
        best = np.where(better, found, best)
        feature[better] = f
    lefts = [(n[feature[n] == f], c[feature[n] == f]) for f, (n, c) in enumerate(lefts)]
    return feature, threshold, last_code, lefts


def _between(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The middle, or the lower value where rounding would reach the upper one."""
    with np.errstate(invalid="ignore"):
        middle = np.where(np.isfinite(low), low + (high - low) / 2, low)
    return np.where(middle < high, middle, low)


def goes_left(coder: Coder, node, codes, feature, last_code, lefts) -> np.ndarray:
    """Which rows of a level's nodes go left, given each node's split."""
    f = feature[node]
    out = codes[np.arange(len(node)), np.maximum(f, 0)].astype(np.int64) <= last_code[node]
    for i, (left_node, left_code) in enumerate(lefts):
        rows = np.flatnonzero(f == i)
        size = coder.sizes[i] + 1
        split = feature == i
        place, n = np.cumsum(split) - 1, np.count_nonzero(split)
        key, left_key = place[node[rows]] * size + codes[rows, i], place[left_node] * size + left_code
        if n * size <= 16 * len(rows) + 1024:
            left = np.zeros(n * size, bool)
            left[left_key] = True
            out[rows] = left[key]
        else:
            out[rows] = np.isin(key, left_key)
    return out


def _parted(parent: np.ndarray, goes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, child) for rows that stand in the order of n parents: each one's left rows, then its right ones."""
    left, right = np.flatnonzero(goes), np.flatnonzero(~goes)
    left_of, right_of = parent[left], parent[right]
    n_left, n_right = np.bincount(left_of, minlength=n), np.bincount(right_of, minlength=n)
    order = np.empty(len(parent), np.int64)
    order[np.arange(len(left)) + (np.cumsum(n_right) - n_right)[left_of]] = left
    order[np.arange(len(right)) + np.cumsum(n_left)[right_of]] = right
    return order, np.repeat(np.arange(2 * n), np.stack([n_left, n_right], axis=1).ravel())


def random_cutter(seed: int, tree: int, names: np.ndarray):
    """Cuts for ``split_level``, drawn per (tree, node, feature)."""

    def cuts(f: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        low, high = (np.nan_to_num(x, neginf=-1e300) for x in (low, high))
        return low + _uniform(seed, tree, names, f) * (high - low)

    return cuts


def child_names(names: np.ndarray) -> np.ndarray:
    """Ids of the left and right children of nodes, side by side."""
    return np.stack([_hash(names, 1), _hash(names, 2)], axis=1).ravel()


def grow(coder: Coder, codes: np.ndarray, label: np.ndarray, w: np.ndarray, depth: int, *, tree=0, seed=0, name=0, random_cuts=False) -> Piece:
    """The whole subtree over these rows: nodes are split until labels or features are all alike."""
    shift = np.average(label, weights=w)
    y, w = label - shift, w.astype(float)
    node = np.zeros(len(y), np.int64)
    names = np.array([name], np.uint64)
    out_feature, out_number, out_left, out_sets = [], [], [], []
    before = 0
    pick = np.arange(len(y))  # the row of ``codes`` each row has
    while len(names):
        n_nodes = len(names)
        total_w = np.bincount(node, w, n_nodes)
        mean = np.bincount(node, w * y, n_nodes) / total_w
        s = w * (y - mean[node])
        total_s = np.zeros(n_nodes)
        first = np.searchsorted(node, np.arange(n_nodes))
        mixed = np.maximum.reduceat(y, first) > np.minimum.reduceat(y, first)
        feature = np.full(n_nodes, LEAF, np.uint8)
        number = mean + shift
        left = np.zeros(n_nodes, np.int32)
        if depth > 0 and mixed.any():
            place = np.cumsum(mixed) - 1
            rows = np.flatnonzero(mixed[node])
            sub, codes, y, w, s = place[node[rows]], codes.take(pick[rows], axis=0), y[rows], w[rows], s[rows]
            cutter = random_cutter(seed, tree, names[mixed]) if random_cuts else None
            chosen, threshold, last_code, lefts = split_level(coder, sub, codes, w, s, total_w[mixed], total_s[mixed], cutter)
            found = chosen >= 0
            at = np.flatnonzero(mixed)[found]
            feature[at] = chosen[found]
            number[at] = np.where(chosen[found] < len(coder.cats), 0.0, threshold[found])
            left[at] = before + n_nodes + 2 * np.arange(len(at))
            for left_node, left_code in lefts:
                out_sets.append((before + np.flatnonzero(mixed)[left_node]) << 16 | left_code)
            rows = np.flatnonzero(found[sub])
            goes = goes_left(coder, sub, codes, chosen, last_code, lefts)[rows]
            order, node = _parted((np.cumsum(found) - 1)[sub[rows]], goes, len(at))
            pick = rows[order]
            y, w = y[pick], w[pick]
            names = child_names(names[at])
        else:
            names = names[:0]
        out_feature.append(feature)
        out_number.append(number)
        out_left.append(left)
        before += n_nodes
        depth -= 1
    sets = np.sort(np.concatenate([np.zeros(0, np.int64), *out_sets]))
    return Piece(np.concatenate(out_feature), np.concatenate(out_number), np.concatenate(out_left), sets)


def walk(piece: Piece, raw: np.ndarray, n_cats: int) -> np.ndarray:
    """The leaf value of each row of raw features."""
    at = np.zeros(len(raw), np.int64)
    active = np.arange(len(raw))
    while len(active):
        here = at[active]
        f = piece.feature[here]
        inner = f != LEAF
        active, here, f = active[inner], here[inner], f[inner]
        if not len(active):
            break
        x = raw[active, f]
        right = x > piece.number[here]
        cat = np.flatnonzero(f < n_cats)
        if len(cat):
            key = here[cat] << 16 | x[cat].astype(np.int64)
            place = np.minimum(np.searchsorted(piece.sets, key), max(len(piece.sets) - 1, 0))
            right[cat] = piece.sets[place] != key
        at[active] = piece.left[here] + right
    return piece.number[at]


# -- the upper levels -----------------------------------------------------------------------


class Top:
    """The nodes of one tree above its pieces, by id.

    A node without a split is an entry: its piece is grown apart, or it is a
    leaf whose value is known here.
    """

    def __init__(self, tree: int):
        self.tree = tree
        self.splits: dict[int, tuple] = {}  # id: feature, threshold, last code, codes to the left, left id, right id
        self.values: dict[int, float] = {}

    def entries(self, codes: np.ndarray, raw: np.ndarray | None = None, n_cats: int = 0, exact: dict[int, np.ndarray] | None = None) -> np.ndarray:
        """The id of the entry each row reaches, by codes or by raw features; ``exact``: the values of features whose codes are bins."""
        at = np.full(len(codes if raw is None else raw), self.tree, np.uint64)
        self._down(self.tree, np.arange(len(at)), codes, raw, exact or {}, at)
        return at

    def _down(self, name, rows, codes, raw, exact, at) -> None:
        todo = [(name, rows)]
        while todo:
            name, rows = todo.pop()
            split = self.splits.get(name)
            if split is None or not len(rows):
                at[rows] = name
                continue
            f, threshold, last_code, left_codes, left, right = split
            x = exact[f][rows] if f in exact else codes[rows, f] if raw is None else raw[rows, f]
            if left_codes is not None:
                goes = np.isin(x, left_codes)
            else:
                goes = x <= (last_code if raw is None and f not in exact else threshold)
            todo += [(left, rows[goes]), (right, rows[~goes])]

    def told(self) -> list:
        return [self.tree, [[n, *s[:3], None if s[3] is None else list(map(int, s[3])), *s[4:]] for n, s in self.splits.items()], list(self.values.items())]

    @classmethod
    def read(cls, told: list) -> "Top":
        top = cls(told[0])
        top.splits = {n: (f, t, c, None if codes is None else np.array(codes), left, right) for n, f, t, c, codes, left, right in told[1]}
        top.values = dict(map(tuple, told[2]))
        return top


# -- rows as columns --------------------------------------------------------------------------


def _cells(train: DataFrame, coder: Coder) -> DataFrame:
    """Hash and label of each labelled row, the places of its labels, and its numbers."""

    def placed(labels: tuple[str, ...]):
        known = pa.array(labels, pa.string())

        def place(column: pa.Array) -> pa.Array:
            return pc.index_in(column, value_set=known).fill_null(len(labels)).cast(pa.int32())

        return F.arrow_udf(place, "int")

    cats = [placed(labels)(F.col(c).cast("string")) for c, labels in zip(coder.cats, coder.labels, strict=True)]
    return train.where(F.col("label").isNotNull()).select(
        F.xxhash64("row_key").alias("row"), F.col("label").cast("double").alias("label"),
        *[x.alias(f"f{i}") for i, x in enumerate([*cats, *[_number(c) for c in coder.nums]])],
    )


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, label, rows x features) of about ``GATHERED`` rows at a time."""

    def told(held: list[list[pa.Array]]):
        row, label, *features = [pa.concat_arrays(x).to_numpy(zero_copy_only=False) for x in zip(*held, strict=True)]
        return row, label, np.array(features, float).reshape(len(features), -1).T

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch.columns)
            n += batch.num_rows
        if n >= GATHERED:
            yield told(held)
            held, n = [], 0
    if n:
        yield told(held)


def _kinds(cells: DataFrame, coder: Coder) -> tuple[int, list[type]]:
    """(rows, the least type per feature that holds all of its places or numbers as they are)."""
    tests = []
    for i in range(len(coder.cats), len(coder.sizes)):
        x = F.col(f"f{i}")
        tests.append(F.struct(
            F.min(F.rint(x) == x).alias("whole"), F.min(x).alias("low"), F.max(x).alias("high"), F.min(x.cast("float").cast("double") == x).alias("short")
        ).alias(f"t{i}"))
    seen = cells.agg(F.count(F.lit(1)).alias("n"), *tests).first()
    kinds: list[type] = [np.uint8 if len(labels) < 256 else np.uint16 for labels in coder.labels]
    for t in seen[1:]:
        if t["whole"] and t["low"] >= 0 and t["high"] < 1 << 16:
            kinds.append(np.uint8 if t["high"] < 1 << 8 else np.uint16)
        else:
            kinds.append(np.float32 if t["short"] else np.float64)
    return seen["n"], kinds


def _weights(seed: int, bootstrap: bool, tree: int, rows: np.ndarray) -> np.ndarray:
    return row_weights(seed, tree, rows) if bootstrap else np.ones(len(rows), np.uint32)


# -- splits of nodes with many rows -----------------------------------------------------------


class _Level:
    """The nodes of some trees that are split together; each has a place in its tree's sorted ids."""

    def __init__(self, tops: dict[int, Top], wide: dict[int, list[int]], seed: int, bootstrap: bool):
        self.tops, self.seed, self.bootstrap = tops, seed, bootstrap
        self.ids = {t: np.array(sorted(ids), np.uint64) for t, ids in wide.items()}

    def met(self, batches: Iterator[pa.RecordBatch]):
        """(tree, places of the nodes, weight, label, features) of the rows that are drawn into a tree and reach one of its nodes."""
        for rows, label, raw in _gathered(batches):
            for t, ids in self.ids.items():
                w, at = _weights(self.seed, self.bootstrap, t, rows), self.tops[t].entries(raw, raw)
                place = np.minimum(np.searchsorted(ids, at), len(ids) - 1)
                here = np.flatnonzero((ids[place] == at) & (w > 0))
                if len(here) == len(rows):
                    yield t, place, w.astype(float), label, raw
                elif len(here):
                    yield t, place[here], w[here].astype(float), label[here], raw[here]


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], list(columns))


_CELL = "tree int, node bigint, feature int, bin int, w double, s double, up double, low double, high double"


def _level_sums(level: _Level, counts: list[int], edges: list[np.ndarray | None], means: dict[int, float]):
    """Per (tree, node, feature, bin): weight and sum around the node's value in ``means``, that of the positive
    ones, and the least and greatest of the node; added up within a task.

    A category's bins are its labels, a number's end at ``edges``. A number without edges has one bin, with its own least and greatest value.
    """
    offsets = np.concatenate([[0], np.cumsum(counts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {t: np.zeros((3, len(ids) * offsets[-1])) for t, ids in level.ids.items()}
        ends = {t: np.stack([np.full((len(ids), len(counts)), x) for x in (np.inf, -np.inf)]) for t, ids in level.ids.items()}
        start = {t: np.array([means[int(i)] for i in ids]) for t, ids in level.ids.items()}
        last, binned = None, None
        for t, place, w, label, raw in level.met(batches):
            if last is not raw:
                last, binned = raw, [np.minimum(np.searchsorted(e, raw[:, f]), len(e) - 1) if e is not None else raw[:, f].astype(np.int64) if n > 1 else 0
                                     for f, (n, e) in enumerate(zip(counts, edges, strict=True))]
            y = label - start[t][place]
            s = w * y
            up, size = np.maximum(s, 0.0), sums[t].shape[1]
            order = np.argsort(place, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(place[order]) > 0]))
            node = place[order][first]
            for f, n in enumerate(counts):
                key = place * offsets[-1] + (offsets[f] + binned[f])
                sums[t][0] += np.bincount(key, w, size)
                sums[t][1] += np.bincount(key, s, size)
                if n > 1 and edges[f] is not None:
                    sums[t][2] += np.bincount(key, up, size)
                x = (y if n > 1 or edges[f] is not None else raw[:, f])[order]
                ends[t][0, node, f] = np.minimum(ends[t][0, node, f], np.minimum.reduceat(x, first))
                ends[t][1, node, f] = np.maximum(ends[t][1, node, f], np.maximum.reduceat(x, first))
        for t, ids in level.ids.items():
            key = np.flatnonzero(sums[t][0])
            place, cell = key // offsets[-1], key % offsets[-1]
            f = np.searchsorted(offsets, cell, "right") - 1
            w, s, up = sums[t][:, key]
            yield _batch({
                "tree": np.full(len(key), t, np.int32), "node": ids[place].astype(np.int64), "feature": f.astype(np.int32), "bin": (cell - offsets[f]).astype(np.int32),
                "w": w, "s": s, "up": up, "low": ends[t][0, place, f], "high": ends[t][1, place, f],
            })

    return run


_SPLIT = """tree int, node bigint, w double, mean double, feature int, score double, threshold double, codes array<int>, left_w double,
    left_mean double, right_mean double, low array<double>, high array<double>, asked array<int>, bins array<int>, next array<int>, before_w array<double>, before_s array<double>"""
_FIELDS = [x.split()[0] for x in _SPLIT.split(",")]


def _level_splits(coder: Coder, edges: list[np.ndarray | None], many: list[bool], means: dict[int, float], random_cuts: bool):
    """The best split of a node that its sums tell, feature -1 if none, and what is still to be asked for.

    Of drawn cuts, numbers have only their least and greatest value told. Else a number coded by
    bins has those told that may hold a better cut, with weight and sum before each.
    """
    n_cats = len(coder.cats)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tree, name = (k.as_py() for k in key)
        f, b, w, s, up, low, high = (table.column(c).to_numpy() for c in ("feature", "bin", "w", "s", "up", "low", "high"))
        first = f == f.min()
        total = w[first].sum()
        mean, start = s[first].sum() / total, means[name % (1 << 64)]
        least = greatest = None
        best = (-np.inf, -1, 0.0, None, 0.0, 0.0, 0.0)
        least_gain, bounds = 0.0, []
        for i in range(len(edges)):
            here = np.flatnonzero(f == i)
            here = here[np.argsort(b[here])]
            code, wi, si = b[here], w[here], s[here] - w[here] * mean
            if i >= n_cats and random_cuts:
                continue
            reach = max(mean - low[here].min(), high[here].max() - mean)
            if reach <= 0 or (len(here) < 2 and not many[i]):
                continue
            if many[i]:
                found = bin_bounds(wi, si, up[here], mean, reach)
                least_gain = max(least_gain, found[0])
                bounds.append((i, code, *found[1:]))
                continue
            if i < n_cats and not random_cuts:
                order = np.lexsort((code, si / wi))
                code, wi, si = code[order], wi[order], si[order]
            one = i < n_cats and random_cuts
            wl, sl = (wi, si) if one else (np.cumsum(wi)[:-1], np.cumsum(si)[:-1])
            gains = sl * sl / wl + sl * sl / (total - wl)
            score = gains.max()
            if score <= best[0] * (1 + TIE):
                continue
            k = int(np.argmax(gains >= score * (1 - TIE)))
            sides = wl[k], sl[k] / wl[k], -sl[k] / (total - wl[k])
            if i < n_cats:
                best = (score, i, 0.0, [int(c) for c in (code[k : k + 1] if one else code[: k + 1])], *sides)
            else:
                best = (score, i, float(_between(edges[i][code[k : k + 1]], edges[i][code[k + 1 : k + 2]])[0]), None, *sides)
        least_gain = max(least_gain, best[0]) * (1 - 2 * TIE)
        asked: list[tuple] = []
        for i, code, bound, before_w, before_s in bounds:
            after = np.append(code[1:], -1)
            keep = np.flatnonzero((bound >= least_gain) & (bound > 0))
            asked += zip([i] * len(keep), code[keep].tolist(), after[keep].tolist(), before_w[keep], before_s[keep], strict=True)
        if random_cuts:
            nums = [np.flatnonzero(f == i) for i in range(n_cats, len(edges))]
            least, greatest = [low[x].min() for x in nums], [high[x].max() for x in nums]
        told = (tree, name, total, start + mean, best[1], best[0], best[2], best[3], best[4], start + mean + best[5], start + mean + best[6], least, greatest)
        columns = list(zip(*asked, strict=True)) if asked else [()] * 5
        ints, doubles = pa.list_(pa.int32()), pa.list_(pa.float64())
        kinds = [pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), *[pa.float64()] * 2, ints, *[pa.float64()] * 3, doubles, doubles, ints, ints, ints, doubles, doubles]
        return pa.table({c: pa.array([x], k) for c, x, k in zip(_FIELDS, (*told, *map(list, columns)), kinds, strict=True)})

    return run


def _left_sums(level: _Level, n_cats: int, cuts: dict[int, tuple], means: dict[int, float]):
    """Per (tree, node, number): weight and sum, around the node's mean, of the rows at or below the drawn cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {t: np.array([cuts[int(i)] for i in ids]) for t, ids in level.ids.items()}
        start = {t: np.array([means[int(i)] for i in ids]) for t, ids in level.ids.items()}
        sums = {t: np.zeros((2, *x.shape)) for t, x in at.items()}
        for t, place, w, label, raw in level.met(batches):
            s, n = w * (label - start[t][place]), len(at[t])
            for f in range(at[t].shape[1]):
                goes = raw[:, n_cats + f] <= at[t][place, f]
                sums[t][0, :, f] += np.bincount(place[goes], w[goes], n)
                sums[t][1, :, f] += np.bincount(place[goes], s[goes], n)
        for t, ids in level.ids.items():
            nodes, width = at[t].shape
            yield _batch({
                "tree": np.full(nodes * width, t, np.int32), "node": np.repeat(ids.astype(np.int64), width),
                "feature": np.tile(np.arange(n_cats, n_cats + width, dtype=np.int32), nodes), "w": sums[t][0].ravel(), "s": sums[t][1].ravel(),
            })

    return run


def _asked_values(level: _Level, edges: list[np.ndarray | None], asked: dict[int, dict[int, list]], means: dict[int, float]):
    """Weight and sum, around the node's mean, per value in the bins that are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], list] = {}
        for t, place, w, label, raw in level.met(batches):
            for f, edge in enumerate(edges):
                if edge is None:
                    continue
                marks = np.zeros((len(level.ids[t]), len(edge)), bool)
                for i, name in enumerate(level.ids[t].tolist()):
                    marks[i, [b for x in asked[name].get(f, ()) for b in x[:2] if b >= 0]] = True
                if not marks.any():
                    continue
                here = np.flatnonzero(marks[place, np.minimum(np.searchsorted(edge, raw[:, f]), len(edge) - 1)])
                for i in np.unique(place[here]):
                    mine = here[place[here] == i]
                    name = int(level.ids[t][i])
                    held.setdefault((t, name, f), []).append(per_value(raw[mine, f], w[mine], w[mine] * (label[mine] - means[name])))
        for (t, name, f), parts in held.items():
            x, w, s = per_value(*[np.concatenate(c) for c in zip(*parts, strict=True)])
            yield _batch({
                "tree": np.full(1, t, np.int32), "node": np.array([name], np.uint64).astype(np.int64), "feature": np.full(1, f, np.int32),
                "x": [x.tobytes()], "w": [w.tobytes()], "s": [s.tobytes()],
            })

    return run


def _asked_splits(edges: list[np.ndarray | None], asked: dict[int, dict[int, list]], total: dict[int, float]):
    """The best cut of a node on one number, from its values."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tree, name, f = (k.as_py() for k in key)
        x, w, s = per_value(*[np.concatenate([np.frombuffer(r) for r in table.column(c).to_pylist()]) for c in ("x", "w", "s")])
        bins, _, before_w, before_s = zip(*asked[name % (1 << 64)][f], strict=True)
        code = np.minimum(np.searchsorted(edges[f], x), len(edges[f]) - 1)
        found = best_value(x, code, w, s, bins, before_w, before_s, total[name % (1 << 64)])
        score, threshold, left_w, left, right = found or (-np.inf, 0.0, 0.0, 0.0, 0.0)
        return pa.table({
            "tree": pa.array([tree], pa.int32()), "node": [name], "feature": pa.array([f], pa.int32()), "score": [float(score)], "threshold": [float(threshold)],
            "left_w": [float(left_w)], "left_mean": [float(left)], "right_mean": [float(right)],
        })

    return run


@dataclass
class _Split:
    """The best split of one node so far; feature -1 for none."""

    tree: int
    w: float
    mean: float
    score: float
    feature: int
    threshold: float
    codes: list[int] | None
    left_w: float
    left_mean: float
    right_mean: float

    def offered(self, score, feature, threshold, left_w, left_mean, right_mean) -> None:
        """Takes a cut of a number if it is better; of equal ones that of the first feature."""
        known = self.score * (1 + TIE) if feature > self.feature else self.score * (1 - TIE)
        if score > known:
            self.score, self.feature, self.threshold, self.codes = score, feature, threshold, None
            self.left_w, self.left_mean, self.right_mean = left_w, left_mean, right_mean


def _split_nodes(
    cells: DataFrame, coder: Coder, near: dict[int, Top], here: dict[int, list[int]], edges, many: list[bool], means: dict[int, float],
    seed: int, random_cuts: bool,
) -> dict[int, _Split]:
    """The splits of some trees' large nodes, in two passes over the rows."""
    n_cats, level = len(coder.cats), _Level(near, here, seed, not random_cuts)
    counts = [len(labels) + 1 for labels in coder.labels] + [1 if e is None else len(e) for e in edges[n_cats:]]
    sums = cells.mapInArrow(_level_sums(level, counts, edges, means), _CELL).groupBy("tree", "node", "feature", "bin")
    sums = sums.agg(*[F.sum(c).alias(c) for c in ("w", "s", "up")], F.min("low").alias("low"), F.max("high").alias("high"))
    found: dict[int, _Split] = {}
    asked: dict[int, dict[int, list]] = {}
    cuts: dict[int, tuple] = {}
    for r in sums.groupBy("tree", "node").applyInArrow(_level_splits(coder, edges, many, means, random_cuts), _SPLIT).collect():
        name = r["node"] % (1 << 64)
        found[name] = _Split(*(r[c] for c in ("tree", "w", "mean", "score", "feature", "threshold", "codes", "left_w", "left_mean", "right_mean")))
        if r["w"] <= LOCAL_ROWS:
            continue
        if random_cuts:
            low, high = np.array(r["low"]), np.array(r["high"])
            drawn = [random_cutter(seed, r["tree"], np.array([name], np.uint64))(n_cats + i, low[i : i + 1], high[i : i + 1])[0] for i in range(len(low))]
            cuts[name] = tuple(np.where(low < high, np.minimum(drawn, np.nextafter(high, -np.inf)), np.inf))
        else:
            for f, *x in zip(*(r[c] for c in ("asked", "bins", "next", "before_w", "before_s")), strict=True):
                asked.setdefault(name, {}).setdefault(f, []).append(x)
    open_ = set(cuts if random_cuts else asked)
    if not open_:
        return found
    level = _Level(near, {t: [i for i in ids if i in open_] for t, ids in here.items() if open_ & set(ids)}, seed, not random_cuts)
    mean, total = {name: found[name].mean for name in open_}, {name: found[name].w for name in open_}
    if random_cuts:
        sums = cells.mapInArrow(_left_sums(level, n_cats, cuts, mean), "tree int, node bigint, feature int, w double, s double")
        for r in sums.groupBy("node", "feature").agg(F.sum("w").alias("w"), F.sum("s").alias("s")).orderBy("node", "feature").collect():
            name = r["node"] % (1 << 64)
            w, s, all_, m = r["w"], r["s"], total[name], mean[name]
            if 0 < w < all_:
                found[name].offered(s * s / w + s * s / (all_ - w), r["feature"], float(cuts[name][r["feature"] - n_cats]), w, m + s / w, m - s / (all_ - w))
        return found
    sums = cells.mapInArrow(_asked_values(level, edges, asked, mean), "tree int, node bigint, feature int, x binary, w binary, s binary")
    best = sums.groupBy("tree", "node", "feature").applyInArrow(
        _asked_splits(edges, asked, total), "tree int, node bigint, feature int, score double, threshold double, left_w double, left_mean double, right_mean double"
    )
    for r in best.orderBy("node", "feature").collect():
        name = r["node"] % (1 << 64)
        m = mean[name]
        found[name].offered(r["score"], r["feature"], r["threshold"], r["left_w"], m + r["left_mean"], m + r["right_mean"])
    return found


def _grow_tops(cells: DataFrame, coder: Coder, trees: int, depth: int, seed: int, random_cuts: bool, rows: int) -> dict[int, Top]:
    """Split the nodes with more than LOCAL_ROWS rows, one level and block of trees at a time."""
    tops = {t: Top(t) for t in range(trees)}
    if depth <= 0 or rows <= LOCAL_ROWS:
        return tops
    n_cats, n_nums = len(coder.cats), len(coder.nums)
    edges: list[np.ndarray | None] = [None] * (n_cats + n_nums)
    many = [False] * len(edges)
    for i in range(n_cats, len(edges) if not random_cuts else n_cats):
        edges[i], many[i] = bin_edges(cells.select(F.col(f"f{i}").alias("x")), BINS, BINS)
    middle = cells.agg(F.avg("label")).first()[0]
    wide, means = {t: [t] for t in tops}, {t: middle for t in tops}
    width = 24 * (sum(len(labels) + 1 for labels in coder.labels) + sum(1 if e is None else len(e) for e in edges[n_cats:]))
    while wide and depth > 0:
        depth -= 1
        grown: dict[int, list[int]] = {}
        below: dict[int, float] = {}
        waiting = sorted(wide)
        while waiting:
            block, size = [], 0
            while waiting and (not block or size + len(wide[waiting[0]]) * width <= SUMS_BYTES):
                size += len(wide[waiting[0]]) * width
                block.append(waiting.pop(0))
            here, near = {t: wide[t] for t in block}, {t: tops[t] for t in block}
            for name, r in _split_nodes(cells, coder, near, here, edges, many, means, seed, random_cuts).items():
                if r.w <= LOCAL_ROWS:
                    continue
                if r.feature < 0:
                    tops[r.tree].values[name] = r.mean
                    continue
                left, right = (int(x) for x in child_names(np.array([name], np.uint64)))
                codes = None if r.codes is None else np.array(r.codes)
                tops[r.tree].splits[name] = (r.feature, r.threshold, 0, codes, left, right)
                if depth == 0:
                    tops[r.tree].values |= {left: r.left_mean, right: r.right_mean}
                for child, w, m in ((left, r.left_w, r.left_mean), (right, r.w - r.left_w, r.right_mean)):
                    if w > LOCAL_ROWS:
                        grown.setdefault(r.tree, []).append(child)
                        below[child] = m
        wide, means = grown, below
    return tops


# -- fitting and scoring --------------------------------------------------------------------


def _counted(w: np.ndarray) -> np.ndarray:
    """Weights in the least type that holds them; none at all where each row counts once."""
    most = w.max()
    return w[:0].astype(np.uint8) if most == 1 and w.min() == 1 else w.astype(np.min_scalar_type(most))


def _dealt(kinds: list[type], tops: list[Top], seed: int, bootstrap: bool):
    """Rows packed by the entry they reach: one record per (tree, entry) and some thousand rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, label, raw in _gathered(batches):
            columns = [label, *[x.astype(kind) for kind, x in zip(kinds, raw.T, strict=True)]]
            every = b"".join([bytes(1), *[x.tobytes() for x in columns]])
            trees, entries, packed, size = [], [], [], 0
            for top in tops:
                w = _weights(seed, bootstrap, top.tree, rows)
                at = top.entries(raw, raw) if top.splits else np.full(len(rows), top.tree, np.uint64)
                for name in np.unique(at):
                    here = np.flatnonzero((at == name) & (w > 0))
                    if not len(here) or int(name) in top.values:
                        continue
                    trees.append(top.tree)
                    entries.append(name.astype(np.int64))
                    if len(here) == len(rows) and not bootstrap:
                        packed.append(every)
                    else:
                        counted = _counted(w[here])
                        packed.append(b"".join([bytes([counted.itemsize if len(counted) else 0]), *[x[here].tobytes() for x in columns], counted.tobytes()]))
                    size += len(packed[-1])
                if size > SUMS_BYTES or top is tops[-1]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(trees, pa.int32()), pa.array(entries, pa.int64()), pa.array(packed, pa.binary())], ["tree", "entry", "packed"]
                    )
                    trees, entries, packed, size = [], [], [], 0

    return run


def _opened(packed: bytes, kinds: list[type]):
    """(label, features, weights) of one dealt record."""
    size, at = packed[0], 1
    n = (len(packed) - 1) // (8 + sum(np.dtype(k).itemsize for k in kinds) + size)
    columns = []
    for kind in (np.float64, *kinds):
        columns.append(np.frombuffer(packed, kind, n, at))
        at += n * np.dtype(kind).itemsize
    w = np.frombuffer(packed, f"u{size}", n, at).astype(np.uint32) if size else np.ones(n, np.uint32)
    return *columns, w


def _places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values and the place of each element among them."""
    if x.dtype.kind == "u":
        seen = np.bincount(x) > 0
        return np.flatnonzero(seen).astype(float), (np.cumsum(seen) - 1)[x]
    values, place = np.unique(x, return_inverse=True)
    return values.astype(float), place


def _finished(coder: Coder, kinds: list[type], depths: dict[int, int], depth: int, seed: int, random_cuts: bool):
    """Grow one entry's subtree from its packed rows; numbers are coded by their places among the values these rows have."""
    n_cats = len(coder.cats)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tree, entry = (k.as_py() for k in key)
        label, *features, w = (np.concatenate(x) for x in zip(*[_opened(p, kinds) for p in table.column("packed").to_pylist()], strict=True))
        # Sums must not depend on the order in which batches arrive; rows of equal hash are alike.
        order = np.argsort(_hash(label.view(np.int64), *[x if x.dtype.kind == "u" else x.astype(float).view(np.int64) for x in features], w), kind="stable")
        found = [_places(x) for x in features[n_cats:]]
        here = Coder(coder.cats, coder.nums, coder.labels, tuple(values for values, _ in found))
        codes = np.empty((len(label), len(features)), np.uint16 if max(here.sizes, default=0) <= CODES + 1 else np.uint32)
        for i, x in enumerate([*features[:n_cats], *[place for _, place in found]]):
            codes[:, i] = x[order]
        name = entry % (1 << 64)
        piece = grow(here, codes, label[order], w[order], depth - depths.get(name, 0), tree=tree, seed=seed, name=name, random_cuts=random_cuts)
        return pa.table({
            "tree": pa.array([tree], pa.int32()), "entry": pa.array([entry], pa.int64()), "nodes": pa.array([len(piece.feature)], pa.int32()),
            **{c: [x] for c, x in piece.packed(n_cats).items()},
        })

    return run


def _depths(tops: dict[int, Top]) -> dict[int, int]:
    """How deep each entry below a split stands."""
    out: dict[int, int] = {}
    for top in tops.values():
        for _, _, _, _, left, right in (top.splits[n] for n in top.splits):
            out[left] = out[right] = 0
        todo = [(top.tree, 0)]
        while todo:
            name, d = todo.pop()
            out[name] = d
            if name in top.splits:
                todo += [(child, d + 1) for child in top.splits[name][4:]]
    return out


def fit_forest(
    train: DataFrame, cats, nums, trees: int, depth: int | None = None, *, seed: int = 42, random_cuts: bool = False
) -> "ForestModel":
    """A forest on (row_key, the feature columns, label); trees are grown to the end unless a depth is given."""
    depth = UNLIMITED if depth is None else depth
    spark = train.sparkSession
    coder = Coder(tuple(cats), tuple(nums), learn_labels(train, cats), tuple(np.zeros(0) for _ in nums))
    tasks = 4 * spark.sparkContext.defaultParallelism
    cells = materialise(_cells(train, coder).repartition(tasks, "row"))
    rows, kinds = _kinds(cells, coder)
    tops = _grow_tops(cells, coder, trees, depth, seed, random_cuts, rows)
    size = 12 + sum(np.dtype(k).itemsize for k in kinds)
    path = scratch_path(spark, "pieces")
    for block in _tree_blocks(list(tops.values()), rows * size):
        entries = sum(len(t.splits) + 1 for t in block)
        dealt = cells.mapInArrow(_dealt(kinds, block, seed, not random_cuts), "tree int, entry bigint, packed binary")
        grouped = dealt.repartition(max(1, min(entries, max(tasks, entries // 16))), "tree", "entry").groupBy("tree", "entry")
        pieces = grouped.applyInArrow(_finished(coder, kinds, _depths({t.tree: t for t in block}), depth, seed, random_cuts), _PIECE)
        pieces.write.mode("append").option("compression", "zstd").parquet(path)
        del dealt, grouped, pieces
        release_shuffles(spark)
    return ForestModel(coder, list(tops.values()), spark.read.schema(_PIECE).parquet(path))


def _tree_blocks(tops: list[Top], tree_bytes: int) -> Iterator[list[Top]]:
    """As many trees at a time as deal ``DEALT_BYTES`` of rows, one at least."""
    most = max(1, DEALT_BYTES // max(1, tree_bytes))
    for i in range(0, len(tops), most):
        yield tops[i : i + most]


@dataclass
class Tree:
    """One small tree, held by the driver."""

    top: Top
    pieces: dict[int, Piece]

    def predict(self, raw: np.ndarray, n_cats: int) -> np.ndarray:
        at = self.top.entries(raw, raw, n_cats)
        out = np.zeros(len(raw))
        for name, value in self.top.values.items():
            out[at == np.uint64(name)] = value
        for name, piece in self.pieces.items():
            rows = np.flatnonzero(at == np.uint64(name))
            out[rows] = walk(piece, raw[rows], n_cats)
        return out

    def told(self) -> list:
        """What JSON can hold of it."""
        return [self.top.told(), [[n, *[x.tolist() for x in (p.feature, p.number, p.left, p.sets)]] for n, p in self.pieces.items()]]

    @classmethod
    def read(cls, told: list) -> "Tree":
        kinds = (np.uint8, np.float64, np.int32, np.int64)
        return cls(Top.read(told[0]), {n: Piece(*[np.array(x, k) for x, k in zip(p, kinds, strict=True)]) for n, *p in told[1]})


def _told(x: np.ndarray) -> bytes:
    """Their size and the numbers, in four bytes each where that loses nothing."""
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    return b"\x04" + short.tobytes() if (short == x).all() else b"\x08" + x.tobytes()


def _sent(coder: Coder, tops: list[Top], slices: int):
    """Raw features and row numbers, packed by the piece they reach; the chunks of a piece are dealt over slices."""
    n_cats = len(coder.cats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(0).to_numpy()
            raw = coder.raw(batch.columns[1:])
            part = (_hash(place >> CHUNK) % np.uint64(slices)).astype(np.int64)
            records: list[tuple] = []
            for top in tops:
                at = top.entries(raw, raw, n_cats)
                for name in np.unique(at):
                    if int(name) in top.values:
                        continue
                    for s in np.unique(part[at == name]):
                        here = np.flatnonzero((at == name) & (part == s))
                        columns = [x.astype(np.uint16).tobytes() for x in raw[here, :n_cats].T] + [_told(x) for x in raw[here, n_cats:].T]
                        records.append((top.tree, name.astype(np.int64), s, b"".join([np.int64(len(here)).tobytes(), place[here].tobytes(), *columns])))
            trees, entries, part_of, packed = zip(*records) if records else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(trees, pa.int32()), pa.array(entries, pa.int64()), pa.array(part_of, pa.int32()), pa.array(packed, pa.binary())],
                ["tree", "entry", "slice", "packed"],
            )

    return run


def _answered(coder: Coder):
    """The answers of one piece for the rows sent to it, by chunk."""
    n_cats, width = len(coder.cats), len(coder.sizes)

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, pieces: pa.Table) -> pa.Table:
        chunks, answers = [], []
        if len(rows) and len(pieces):
            [piece] = [Piece.unpacked(*(p[c] for c in ("features", "numbers", "lefts")), n_cats) for p in pieces.to_pylist()]
            places, values = [], []
            for p in rows.column("packed").to_pylist():
                n = int(np.frombuffer(p, np.int64, 1)[0])
                raw, at = np.empty((n, width)), 8 + 8 * n
                for i in range(width):
                    size = 2 if i < n_cats else p[at]
                    at += i >= n_cats
                    raw[:, i] = np.frombuffer(p, np.uint16 if i < n_cats else f"f{size}", n, at)
                    at += size * n
                places.append(np.frombuffer(p, np.int64, n, 8))
                values.append(walk(piece, raw, n_cats))
            place, value = np.concatenate(places), np.concatenate(values)
            order = np.argsort(place)
            place, value = place[order], value[order]
            found, first = np.unique(place >> CHUNK, return_index=True)
            for chunk, low, high in zip(found, first, [*first[1:], len(place)], strict=True):
                chunks.append(chunk)
                answers.append((place[low:high] & ((1 << CHUNK) - 1)).astype(np.uint16).tobytes() + value[low:high].tobytes())
        return pa.table({
            "chunk": pa.array(chunks, pa.int64()), "tree": pa.array([key[0].as_py()] * len(chunks), pa.int32()),
            "answers": pa.array(answers, pa.binary()),
        })

    return run


def _pairs(answers: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(answers) // 10
    return np.frombuffer(answers, np.uint16, n), np.frombuffer(answers, np.float64, n, 2 * n)


def _added(table: pa.Table) -> pa.Table:
    """One chunk's answers added up tree by tree; the sum so far stands as tree -1."""
    total, seen = np.zeros(1 << CHUNK), np.zeros(1 << CHUNK, bool)
    trees = table.column("tree").to_numpy()
    answers = table.column("answers").to_pylist()
    for i in np.argsort(trees, kind="stable"):
        place, value = _pairs(answers[i])
        total[place] += value
        seen[place] = True
    place = np.flatnonzero(seen)
    return pa.table({
        "chunk": table.column("chunk")[:1], "tree": pa.array([-1], pa.int32()),
        "answers": pa.array([place.astype(np.uint16).tobytes() + total[place].tobytes()], pa.binary()),
    })


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row numbers and sums of the chunks."""
    for batch in batches:
        for chunk, answers in zip(batch.column("chunk").to_pylist(), batch.column("answers").to_pylist(), strict=True):
            place, total = _pairs(answers)
            yield pa.RecordBatch.from_arrays([pa.array(chunk << CHUNK | place.astype(np.int64)), pa.array(total)], ["place", "total"])


class ForestModel:
    """The mean over the trees of a written table of pieces."""

    kind = "forest"
    needs_vectors = False

    def __init__(self, coder: Coder, tops: list[Top], pieces: DataFrame):
        self.coder, self.tops, self.pieces = coder, tops, pieces

    def blocks(self) -> list[list[tuple[int, int]]]:
        """(tree, entry) of all pieces, cut into blocks of bounded bytes."""
        size = F.octet_length("features") + F.octet_length("numbers") + F.octet_length("lefts")
        out: list[list[tuple[int, int]]] = []
        room = 0
        for r in self.pieces.select("tree", "entry", size.alias("size")).orderBy("tree", "entry").collect():
            if not out or room < r["size"]:
                out.append([])
                room = BLOCK_BYTES
            out[-1].append((r["tree"], r["entry"]))
            room -= r["size"]
        return out or [[(0, 0)]]

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``. Each pass but the last writes the sum so far."""
        blocks = self.blocks()
        if len(blocks) > HELD_BLOCKS:
            return self._dealt_predict(df)
        total = _free("total", df.columns)
        known = [t for t in self.tops if t.values]
        out = df.withColumn(total, F.lit(0.0))
        for i, block in enumerate(blocks):
            sums = self._block_sum(df.sparkSession, block)
            out = out.withColumn(total, F.col(total) + (sums + self._known_sum(known) if known and i == 0 else sums))
            if i + 1 < len(blocks):
                out = materialise(out)
        return out.select(*df.columns, (F.col(total) / len(self.tops)).alias("prediction"))

    def _dealt_predict(self, df: DataFrame) -> DataFrame:
        """Each row is sent to the piece it reaches in every tree; the pieces stay where they were written.

        Rows are numbered in a written table, and a chunk's answers are added in
        the order of the trees, so retries change nothing.
        """
        coder, spark = self.coder, df.sparkSession
        place = _free("place", df.columns)
        numbered = materialise(df.withColumn(place, F.monotonically_increasing_id()))
        columns = numbered.select(F.col(place).alias("place"), *[F.col(c) for c in (*coder.cats, *coder.nums)])
        rows = numbered.count()
        walked = [t for t in self.tops if t.splits or t.tree not in t.values]
        tasks = 4 * spark.sparkContext.defaultParallelism
        state, written = None, Rounds()
        for block in _tree_blocks(walked, rows * (10 + 2 * len(coder.cats) + 8 * len(coder.nums))):
            entries = sum(len(t.splits) + 1 for t in block)
            slices = -(-rows * len(block) // (LOCAL_ROWS * entries)) or 1
            parts = max(1, min(entries * slices, max(tasks, entries * slices // 16)))
            sent = columns.mapInArrow(_sent(coder, block, slices), "tree int, entry bigint, slice int, packed binary")
            pieces = self.pieces.where(F.col("tree").isin([t.tree for t in block]))
            pieces = pieces.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
            key = ("tree", "entry", "slice")
            both = sent.repartition(parts, *key).groupBy(*key).cogroup(pieces.repartition(parts, *key).groupBy(*key))
            answers = both.applyInArrow(_answered(coder), _ANSWER)
            answers = answers if state is None else answers.unionByName(state)
            state = written.write(answers.groupBy("chunk").applyInArrow(_added, _ANSWER))
            del sent, pieces, both, answers
            release_shuffles(spark)
        total = _free("total", numbered.columns)
        sums = spark.createDataFrame([], f"{place} bigint, {total} double")
        if state is not None:
            sums = state.mapInArrow(_placed, "place bigint, total double").toDF(place, total)
        out = numbered.join(sums, place, "left").withColumn(total, F.coalesce(total, F.lit(0.0)))
        known = [t for t in self.tops if t.values]
        if known:
            out = out.withColumn(total, F.col(total) + self._known_sum(known))
        return out.select(*df.columns, (F.col(total) / len(self.tops)).alias("prediction"))

    def _known_sum(self, known: list[Top]):
        """The sum of the values known above the pieces, for each row."""
        coder = self.coder

        def told(*columns: pa.Array) -> pa.Array:
            raw = coder.raw(list(columns))
            total = np.zeros(len(raw))
            for top in known:
                at = top.entries(raw, raw, len(coder.cats))
                for name, value in top.values.items():
                    total[at == np.uint64(name)] += value
            return pa.array(total)

        return F.arrow_udf(told, "double")(*coder.cats, *coder.nums)

    def _block_sum(self, spark: SparkSession, block: list[tuple[int, int]]):
        """The sum of the leaf values in one block's pieces, for each row."""
        (first_tree, first), (last_tree, last) = block[0], block[-1]
        after = (F.col("tree") > first_tree) | ((F.col("tree") == first_tree) & (F.col("entry") >= first))
        until = (F.col("tree") < last_tree) | ((F.col("tree") == last_tree) & (F.col("entry") <= last))
        packed = [tuple(r) for r in self.pieces.where(after & until).collect()]
        coder = self.coder
        tops = {t.tree: t for t in self.tops if t.tree in {p[0] for p in packed}}
        held = spark.sparkContext.broadcast((packed, tops))

        def walked(*columns: pa.Array) -> pa.Array:
            raw = coder.raw(list(columns))
            packed, tops = held.value
            total = np.zeros(len(raw))
            reached: dict[int, np.ndarray] = {}
            for tree, entry, _, *arrays in packed:
                piece = Piece.unpacked(*arrays, len(coder.cats))
                if not tops[tree].splits:
                    total += walk(piece, raw, len(coder.cats))
                    continue
                if tree not in reached:
                    reached = {tree: tops[tree].entries(raw, raw, len(coder.cats))}
                rows = np.flatnonzero(reached[tree] == np.uint64(entry % (1 << 64)))
                total[rows] += walk(piece, raw[rows], len(coder.cats))
            return pa.array(total)

        return F.arrow_udf(walked, "double")(*coder.cats, *coder.nums)

    def save(self, path: str, spark: SparkSession) -> dict:
        """Writes the pieces and what is needed to enter them."""
        self.pieces.write.mode("overwrite").parquet(f"{path}/pieces")
        lines = [(json.dumps(["labels", list(x)]),) for x in self.coder.labels]
        lines += [(json.dumps(["values", x.tolist()]),) for x in self.coder.values]
        lines += [(json.dumps(["top", t.told()]),) for t in self.tops]
        numbered = [(i, line) for i, (line,) in enumerate(lines)]
        spark.createDataFrame(numbered, "i int, line string").coalesce(1).write.mode("overwrite").parquet(f"{path}/codes")
        return {"cats": list(self.coder.cats), "nums": list(self.coder.nums)}

    @classmethod
    def load(cls, spark: SparkSession, path: str, meta: dict) -> "ForestModel":
        told = [json.loads(r["line"]) for r in spark.read.parquet(f"{path}/codes").orderBy("i").collect()]
        coder = Coder(
            tuple(meta["cats"]), tuple(meta["nums"]), tuple(tuple(x) for kind, x in told if kind == "labels"),
            tuple(np.array(x, float) for kind, x in told if kind == "values"),
        )
        return cls(coder, [Top.read(x) for kind, x in told if kind == "top"], spark.read.schema(_PIECE).parquet(f"{path}/pieces"))


def _free(name: str, taken) -> str:
    """A column name that is not in use."""
    have = {c.lower() for c in taken}
    while name in have:
        name = f"{name}_"
    return name
