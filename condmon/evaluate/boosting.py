"""Gradient-boosted trees on absolute loss from histograms, for several models at once.

Features become at most 255 bins, cut at quantiles of a mergeable sketch, plus a bin for missing values whose side each
split learns. Rows lie in blocks of bins, labels and margins, stored once. Every step of a round (one level of all trees, or all leaf medians)
is one aggregate over the blocks: each block gives small tables per model and feature, their sums are formed and searched for
the best split by (model, feature), and only the best splits reach the driver. All models, of all methods and folds, go through
the same passes; a fold leaves its group out when it fills the tables. Margins are stored every KEPT rounds, so training goes
on where it is instead of starting again.

Up to ALONE_BLOCKS times BLOCK_ROWS rows (1,048,576) are bytes that any task can hold, and a job for each of up to 18,000 steps costs far more than the
step. Then each model's steps run one after another in a task of its own, which joins the blocks, by the same functions and with the same result.
There only the smaller child of every node is counted; its sibling is what the node's own table has left. At the root the rows not drawn
are counted and taken from the tables of all rows, which change from round to round only where a sign has changed. Counts are whole, so all of that is exact.

Leaves take the median residual, to 1/MEDIAN_BINS of the residuals' range; counts are whole numbers, so results do not depend on partitions.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from condmon.session import stored

BLOCK_ROWS = 1 << 18
ALONE_BLOCKS = 4    # so many blocks of rows are made one, and each model grows in a task
ALONE_BYTES = 1 << 28   # unless their bins are more than that
BINS = 256          # the first is for missing values
BIN_ROWS = 3        # rows that a bin has on the average, at least
MEDIAN_BINS = 2048
KEPT = 40           # rounds between two writings of the margins
PIECE = 1 << 14     # rows walked at once, whose places stay in a core's cache
TOGETHER = 64       # features times nodes searched at once, whose tables stay in a core's cache
RANGE, LEAF = -1, -2  # tables that are not of a feature

_INT, _BYTES = T.IntegerType(), T.BinaryType()
BLOCKS = T.StructType([T.StructField(c, _BYTES) for c in ("x", "y", "u", "fold", "margin")] + [T.StructField("n", _INT)])
TABLES = T.StructType([T.StructField("m", _INT), T.StructField("f", _INT), T.StructField("v", _BYTES)])
FOUND = T.StructType([T.StructField("m", _INT), T.StructField("f", _INT), T.StructField("gain", T.ArrayType(T.DoubleType())),
                      T.StructField("cut", T.ArrayType(_INT)), T.StructField("left", T.ArrayType(_INT))])
MODELS = T.StructType([T.StructField("m", _INT), T.StructField("model", _BYTES)])


@dataclass(frozen=True)
class Settings:
    rounds: int = 3000
    patience: int = 150
    depth: int = 5
    step: float = 0.03
    min_leaf: int = 10
    l2: float = 1.0
    row_share: float = 0.8
    feature_share: float = 0.8
    es_frac: float = 0.15
    min_es: int = 30
    seed: int = 42


@dataclass
class Tree:
    """Splits in heap order (feature -1: all rows go left) and one value per leaf."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    @classmethod
    def bare(cls, depth: int) -> Tree:
        n = 2 ** depth - 1
        return cls(np.full(n, -1), np.zeros(n, int), np.zeros(n, int), np.zeros(n + 1))

    def leaf(self, x: np.ndarray, levels: int) -> np.ndarray:
        """Number of each row's node inside level `levels`."""
        node = np.zeros(len(x), int)
        for level in range(levels):
            node = self.down(x, node, level)
        return node

    def down(self, x: np.ndarray, node: np.ndarray, level: int) -> np.ndarray:
        """Node inside level `level` + 1 of rows that are in `node` of `level`."""
        nodes = slice(2 ** level - 1, 2 ** (level + 1) - 1)
        f = self.feature[nodes]
        if not (f >= 0).any():
            return 2 * node
        right = np.arange(BINS) > self.cut[nodes, None]
        right[:, 0] = self.left[nodes] == 0
        right &= (f >= 0)[:, None]
        child, f = (2 * np.arange(len(f))[:, None] + right).ravel(), np.maximum(f, 0)
        if x.ndim == 3:     # pairs of features, as pack() lays them
            first, step = (f >> 1) * x.strides[0] + (f & 1), x.strides[1]
        else:               # by rows or by columns, as x lies
            first, step = f * x.strides[1], x.strides[0]
        flat, below = x.ravel(order="K"), np.empty(len(node), int)
        away = np.arange(min(len(node), PIECE)) * step
        cells, bins = np.empty(len(away), int), np.empty(len(away), np.uint8)
        for i in range(0, len(node), PIECE):
            mine = node[i:i + PIECE]
            at, found = cells[:len(mine)], bins[:len(mine)]
            first.take(mine, out=at, mode="clip")   # no place is outside; other modes copy what they write
            at += away[:len(mine)]
            flat[i * step:].take(at, out=found, mode="clip")
            np.multiply(mine, BINS, out=at)
            at += found
            child.take(at, out=below[i:i + PIECE], mode="clip")
        return below

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaf(x, int(math.log2(len(self.value))))]


def stacked(trees: Sequence[Tree]) -> list[np.ndarray]:
    """Features, cuts, sides and values of many trees, a row for each."""
    return [np.stack([getattr(t, c) for t in trees]) for c in ("feature", "cut", "left", "value")]


def added_up(trees: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """Sum of the values of stacked trees by row. A few rows go down many trees at once."""
    out, rows, flat = np.zeros(len(x)), np.arange(len(x)) * x.shape[1], x.ravel()
    size = max(1, PIECE // max(1, len(x)))
    for i in range(0, len(trees[0]), size):
        feature, cut, left, value = (v[i:i + size] for v in trees)
        node = np.arange(len(value))[:, None] + np.zeros(len(x), int)    # of all these trees' nodes in the level
        for level in range(int(math.log2(value.shape[1]))):
            nodes = slice(2 ** level - 1, 2 ** (level + 1) - 1)
            f, c, m = (v[:, nodes].ravel() for v in (feature, cut, left))
            if (f >= 0).any():
                late = (m == 0).astype(np.uint8)    # where missing values go right: one bin less makes them the last
                c = np.where(f >= 0, c - late, BINS).astype(np.int16)
                bins = flat.take(np.maximum(f, 0).take(node) + rows) - late.take(node)
                node = 2 * node + (bins > c.take(node))
            else:
                node = 2 * node
        for v in value.ravel().take(node):
            out += v
    return out


@dataclass
class Growing:
    """One model on its way. `trees` begins with the median of the labels."""

    number: int
    features: list[int]
    hold: int                       # fold left out, -1 for none
    es_share: float
    settings: Settings
    bins: int = BINS
    trees: list[Tree] = field(default_factory=list)
    kept: int = 0                   # trees inside the stored margins
    level: int = -1                 # -1: range of the labels
    tree: Tree | None = None
    low: float = 0.0
    high: float = 0.0
    best: tuple[float, int] = (math.inf, 1)
    losses: list[float] = field(default_factory=list)
    gains: dict = field(default_factory=dict)
    done: bool = False

    def result(self) -> bytes:
        trees = [(t.feature, t.cut, t.left, t.value) for t in self.trees]
        return pickle.dumps((trees, self.best, self.losses, self.gains))

    def take(self, result: bytes) -> None:
        trees, self.best, self.losses, self.gains = pickle.loads(result)
        self.trees, self.done = [Tree(*t) for t in trees], True

    def tried(self) -> list[int]:
        """Features of the tree that grows now."""
        rng = np.random.default_rng([self.settings.seed, self.number, len(self.trees)])
        n = max(1, math.ceil(self.settings.feature_share * len(self.features)))
        return sorted(rng.permutation(self.features)[:n].tolist())

    def advance(self, found: dict) -> None:
        """Take in what the blocks gave for this step: {table: (gain, cut, left)}."""
        if RANGE in found:
            self.low, self.high, loss, fit, held = found[RANGE][0]
            if not fit:
                self.done = True
                return
            if self.trees:
                self.losses.append(loss / held if held else math.nan)
                if self.losses[-1] < self.best[0] or not held:
                    self.best = (self.losses[-1], len(self.trees))
                self.done = len(self.trees) - self.best[1] >= self.settings.patience or len(self.trees) > self.settings.rounds
                if self.done:
                    self.trees = self.trees[:self.best[1]]
                    return
            self.tree = Tree.bare(self.settings.depth)
            if not self.trees:
                self.level = self.settings.depth
                return
        if LEAF in found:
            first = not self.trees
            self.tree.value = np.array(found[LEAF][0]) * (1.0 if first else self.settings.step)
            self.trees.append(self.tree)
            self.tree, self.level = None, -1 if self.level < 0 else 0
            return
        tried = sorted(f for f in found if f >= 0)
        if not tried:  # a model without features is a series of medians
            self.level = self.settings.depth
            return
        gain, cut, left = (np.array([found[f][i] for f in tried]) for i in range(3))
        best, nodes = gain.argmax(0), np.arange(2 ** self.level)  # the first feature wins a tie
        at = 2 ** self.level - 1 + nodes
        good = gain[best, nodes] > 1e-9
        self.tree.feature[at] = np.where(good, np.array(tried)[best], -1)
        self.tree.cut[at], self.tree.left[at] = cut[best, nodes], left[best, nodes]
        for node in np.flatnonzero(good):
            f = tried[best[node]]
            self.gains[f] = self.gains.get(f, 0.0) + float(gain[best[node], node])
        self.level += 1


class Block:
    """Rows of a block, with the margin of every model."""

    def __init__(self, row: dict, models: int):
        n = row["n"]
        self.x = np.frombuffer(row["x"], np.uint8).reshape(n, -1)   # pairs of features, once a model grows alone
        self.y, self.u = np.frombuffer(row["y"]), np.frombuffer(row["u"], np.uint64)
        self.fold = np.frombuffer(row["fold"], np.int32)
        self.stored = np.frombuffer(row["margin"]).reshape(models, n) if row["margin"] else None
        self.margins: dict[int, np.ndarray] = {}
        self.has: dict[int, int] = {}
        self.parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.place: tuple | None = None     # (model, tree, level, node of each row)
        self.hashes: tuple | None = None    # (model, those of the rows that fit it)
        self.drawn: tuple | None = None     # (model, tree, rows, sign, tried features)
        self.undrawn = np.zeros(0, int)     # rows that fit the model and were not drawn
        self.base: tuple | None = None      # (model, signs of the rows that fit it, their tables by feature)
        self.rest: tuple | None = None      # (model, tree, residuals before it)
        self.room: dict[int, np.ndarray] = {}   # memory for the tables of a level
        self.upto: tuple | None = None      # (model, tree, level, its tables summed up over the bins)

    @classmethod
    def joined(cls, rows: list[dict], hold: int) -> Block:
        """The rows of many blocks without those of a fold, in the order of their hashes, so that no sum depends on the blocks."""
        parts = [cls(r, 0) for r in rows]
        fold, y, u = (np.concatenate([getattr(p, c) for p in parts]) for c in ("fold", "y", "u"))
        mine = np.flatnonzero(fold != hold)
        mine = mine[np.lexsort((y[mine], u[mine]))]
        whole, x = parts[0], np.concatenate([p.x for p in parts])
        whole.x, whole.y, whole.u, whole.fold = x[mine], y[mine], u[mine], fold[mine]
        return whole

    def pack(self) -> None:
        """From now on two features of a row lie together and are fetched at once: (pair, row, feature of the pair)."""
        if self.x.ndim == 2:
            n, many = self.x.shape
            pairs = np.zeros(((many + 1) // 2, n, 2), np.uint8)
            for f in range(many):
                pairs[f >> 1, :, f & 1] = self.x[:, f]
            self.x = pairs

    def bins(self, features: Iterable[int], rows: np.ndarray) -> Iterator[np.ndarray]:
        """The bins of some rows by feature, fetched in pairs."""
        pair = None
        for f in features:
            if pair != f >> 1:
                pair = f >> 1
                both = self.x[pair].view("<u2")[:, 0].take(rows)
            yield both >> 8 if f & 1 else both & 255

    def margin(self, number: int) -> np.ndarray:
        if number not in self.margins:
            self.margins[number] = np.zeros(len(self.y)) if self.stored is None else self.stored[number].copy()
        return self.margins[number]

    def catch_up(self, model: Growing) -> np.ndarray:
        margin, first = self.margin(model.number), self.has.get(model.number, model.kept)
        for number, tree in enumerate(model.trees[first:], first):
            depth = int(math.log2(len(tree.value)))
            margin += tree.value[self.nodes(model, number, tree, depth)]
        self.has[model.number] = len(model.trees)
        return margin

    def residuals(self, model: Growing) -> np.ndarray:
        if self.rest is None or self.rest[:2] != (model.number, len(model.trees)):
            self.rest = model.number, len(model.trees), self.y - self.catch_up(model)
        return self.rest[2]

    def nodes(self, model: Growing, number: int, tree: Tree, level: int) -> np.ndarray:
        """Node of each row inside a level of the model's tree of that number, from the level it was last asked for."""
        at, node = 0, np.zeros(len(self.y), int)
        if self.place is not None and self.place[:2] == (model.number, number) and self.place[2] <= level:
            at, node = self.place[2:]
        for step in range(at, level):
            node = tree.down(self.x, node, step)
        self.place = model.number, number, level, node
        return node

    def halves(self, model: Growing) -> tuple[np.ndarray, np.ndarray]:
        """Rows that fit the model, and rows that choose its last round."""
        if model.number not in self.parts:
            mine = self.fold != model.hold
            held = mine & (share(self.u, model.settings.seed) < model.es_share)
            self.parts[model.number] = np.flatnonzero(mine & ~held), np.flatnonzero(held)
        return self.parts[model.number]

    def sample(self, model: Growing, resid: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Rows drawn for the tree that grows, the signs of their residuals, and the tried features."""
        s, number = model.settings, len(model.trees)
        if self.drawn is None or self.drawn[:2] != (model.number, number):
            fit = self.halves(model)[0]
            if self.hashes is None or self.hashes[0] != model.number:
                self.hashes = model.number, self.u[fit]
            drawn = share(self.hashes[1], s.seed + 7919 * number) < s.row_share
            rows, self.undrawn = fit[drawn], fit[~drawn]
            self.drawn = model.number, number, rows, signs(resid.take(rows)), model.tried() if model.features else []
        return self.drawn[2:]

    def splitting(self, model: Growing) -> bool:
        """Whether the model's next step looks for splits."""
        return model.level < model.settings.depth and bool(model.trees)

    def whole(self, model: Growing, resid: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(table, values) of the model's next step that are not of a feature."""
        s = model.settings
        fit, held = self.halves(model)
        if model.level <= 0:
            r = resid[fit]
            yield RANGE, np.array([r.min(initial=np.inf), r.max(initial=-np.inf), np.abs(resid[held]).sum(), len(r), len(held)])
            if not model.trees:
                return
        if model.level == s.depth:
            leaf, cells = self.nodes(model, len(model.trees), model.tree, s.depth), np.empty(len(fit), int)
            wide = max(model.high - model.low, 1e-300)
            for i in range(0, len(fit), PIECE):
                mine = fit[i:i + PIECE]
                place = np.minimum(((resid.take(mine) - model.low) / wide * MEDIAN_BINS).astype(int), MEDIAN_BINS - 1)
                np.add(leaf.take(mine) * MEDIAN_BINS, place, out=cells[i:i + PIECE])
            yield LEAF, np.bincount(cells, minlength=2 ** s.depth * MEDIAN_BINS).reshape(-1, MEDIAN_BINS)

    def tables(self, model: Growing) -> Iterator[tuple[int, np.ndarray]]:
        """(table, values) of the model's next step. Tables of one name are added up over the blocks, but for the ends of the range."""
        resid = self.y - self.catch_up(model)
        yield from self.whole(model, resid)
        if self.splitting(model):
            rows, sign, tried = self.sample(model, resid)
            node = self.nodes(model, len(model.trees), model.tree or Tree.bare(model.settings.depth), model.level)[rows]
            # single rows are copied whole, so the memory is read once
            bins = self.bins(tried, rows) if self.x.ndim == 3 else np.ascontiguousarray(self.x[rows].T[tried]) if tried else []
            many = 2 ** model.level
            yield from zip(tried, counted(bins, node, *begun(node, sign, many, model.bins), many, model.bins, len(tried)))

    def everything(self, model: Growing, resid: np.ndarray) -> dict[int, np.ndarray]:
        """Tables of all rows that fit the model, by feature: as they were, but for the rows whose sign has changed."""
        fit = self.halves(model)[0]
        sign = signs(resid.take(fit))
        if self.base is None or self.base[0] != model.number:
            tables = {f: np.zeros((2, 1, model.bins), np.int32) for f in sorted(model.features)}
            for table, b in zip(tables.values(), self.bins(tables, fit)):
                table[1, 0] = np.bincount(b, minlength=model.bins)
            self.base = model.number, np.zeros(len(fit), np.int8), tables
        _, before, tables = self.base
        turned = np.flatnonzero(sign != before)
        rows, change = fit[turned], (sign[turned] - before[turned]).astype(float)
        for table, b in zip(tables.values(), self.bins(tables, rows)):
            table[0, 0] += np.bincount(b, change, model.bins).astype(np.int32)
        before[turned] = sign[turned]
        return tables

    def summed(self, model: Growing, resid: np.ndarray) -> Iterator[tuple[list[int], np.ndarray]]:
        """(features, tables summed up over the bins) of a block that holds all rows of the model.

        Below the root only the smaller child of every node is counted; its sibling has what the node's table has left. At the root
        the rows that are not drawn are counted, if they are fewer, and the drawn ones are what the table of all rows has left.
        """
        level, number = model.level, len(model.trees)
        self.pack()
        rows, sign, tried = self.sample(model, resid)
        node = self.nodes(model, number, model.tree or Tree.bare(model.settings.depth), level)[rows]
        known = self.upto[3] if level and self.upto is not None and self.upto[:3] == (model.number, number, level - 1) else None
        many, every = 2 ** level, None
        if level == 0 and len(self.undrawn) < len(rows):
            every = self.everything(model, resid)
            rows = self.undrawn
            sign, node = signs(resid.take(rows)), np.zeros(len(rows), int)
        if known is not None:
            size = np.bincount(node, minlength=many)
            many //= 2
            small = 2 * np.arange(many) + (size[1::2] < size[::2])
            at = np.flatnonzero(np.isin(np.arange(2 * many), small).take(node))
            rows, sign, node = rows.take(at), sign.take(at), node.take(at) >> 1
        made = self.room.get(level)
        if made is None or made.shape != (len(tried), 2, 2 ** level, model.bins):
            made = self.room[level] = np.empty((len(tried), 2, 2 ** level, model.bins), np.int32)
        size, cells = max(1, TOGETHER >> level), begun(node, sign, many, model.bins)
        for i in range(0, len(tried), size):
            part, upto = tried[i:i + size], made[i:i + size]
            tables = counted(self.bins(part, rows), node, *cells, many, model.bins, len(part))
            if every is not None:
                np.subtract([every[f] for f in part], tables, out=tables)
            tables = summed_up(tables)
            if known is None:
                upto[:] = tables
            else:
                upto[:, :, small] = tables
                upto[:, :, small ^ 1] = known[i:i + size] - tables
            yield part, upto
        self.upto = model.number, number, level, made


def signs(values: np.ndarray) -> np.ndarray:
    return (values > 0).view(np.int8) - (~(values >= 0)).view(np.int8)


def begun(node: np.ndarray, sign: np.ndarray, nodes: int, many: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell of each row that its bin is added to, rows of no sign), the same for all features."""
    first = np.where(sign > 0, (node + nodes) * many, node * many)
    return first.astype(np.promote_types(np.uint16, np.min_scalar_type(2 * nodes * many))), np.flatnonzero(sign == 0)


def counted(bins: Iterable[np.ndarray], node: np.ndarray, first: np.ndarray, flat: np.ndarray, nodes: int, many: int, features: int) -> np.ndarray:
    """(feature, sum of the signs or number of rows, node, bin), from the bins of the rows by feature."""
    cell = np.empty_like(first)
    both, zeros = np.empty((features, 2, nodes, many), np.int32), None
    if len(flat):
        zeros, nought = np.empty((features, nodes, many), np.int32), node[flat] * many
    for i, b in enumerate(bins):
        np.add(first, b, out=cell)
        both[i] = np.bincount(cell, minlength=2 * nodes * many).reshape(2, nodes, many)
        if zeros is not None:
            zeros[i] = np.bincount(nought + b[flat], minlength=nodes * many).reshape(nodes, many)
    low, high = both[:, 0].copy(), both[:, 1]
    np.subtract(high, low, out=both[:, 0])
    high += low
    if zeros is not None:  # counted with the negative ones
        both[:, 0] += zeros
    return both


def share(u: np.ndarray, salt: int) -> np.ndarray:
    """A number from 0 to 1 for each row and salt."""
    if len(u) > PIECE:
        return np.concatenate([share(u[i:i + PIECE], salt) for i in range(0, len(u), PIECE)])
    z = u ^ np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    z >>= np.uint64(11)
    return z / float(1 << 53)


def added(f: int, tables: Sequence[np.ndarray]) -> np.ndarray:
    total = np.sum(tables, axis=0)
    if f == RANGE:
        total[0], total[1] = min(t[0] for t in tables), max(t[1] for t in tables)
    return total


def searched(f: int, total: np.ndarray, model: Growing) -> tuple[list, list, list]:
    """Best split per node of one feature, or the numbers of a table that is not of a feature."""
    if f == RANGE:
        return total.tolist(), [], []
    if f == LEAF:
        count = total.sum(1)
        upto = np.cumsum(total, 1)
        at = (2 * upto >= count[:, None]).argmax(1)
        rows = np.arange(len(total))
        inside = (count / 2 - (upto[rows, at] - total[rows, at])) / np.maximum(total[rows, at], 1)
        value = model.low + (at + inside) * (model.high - model.low) / MEDIAN_BINS
        return np.where(count > 0, value, 0.0).tolist(), [], []
    return tuple(v[0].tolist() for v in splits(summed_up(total[None]), model.settings))


def summed_up(tables: np.ndarray) -> np.ndarray:
    """Tables with running sums over the bins, but for that of missing values."""
    out = tables.copy()
    np.cumsum(tables[..., 1:], -1, out=out[..., 1:])
    return out


def splits(upto: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, last bin on the left, whether missing values go left) by feature and node, from (feature, sign or count, node, bin) as summed up."""
    g, h = upto[:, 0], upto[:, 1]
    below_g, below_h, lost_g, lost_h = (v.astype(float) for v in (g[:, :, 1:], h[:, :, 1:], g[:, :, :1], h[:, :, :1]))
    g_all, h_all = lost_g + below_g[:, :, -1:], lost_h + below_h[:, :, -1:]
    whole, gains = g_all ** 2 / (h_all + s.l2), []
    for left in (1, 0) if lost_h.any() else (0,):  # the last may change the sums in place
        gl, hl = (below_g + lost_g, below_h + lost_h) if left else (below_g, below_h)
        gr, hr = g_all - gl, h_all - hl
        small = np.minimum(hl, hr) < s.min_leaf
        gain = np.multiply(gl, gl, out=gl)
        hl += s.l2
        gain /= hl
        gr *= gr
        hr += s.l2
        gr /= hr
        gain += gr
        gain -= whole
        gain[small] = 0.0
        gains.append(gain)
    both = np.concatenate(gains[::-1], 2) if len(gains) > 1 else gains[0]
    at = both.argmax(2)
    one = g.shape[2] - 1
    return np.take_along_axis(both, at[:, :, None], 2)[:, :, 0], at % one + 1, at // one


def step_alone(block: Block, model: Growing) -> None:
    """A step of a model whose rows all lie in one block."""
    resid = block.residuals(model)
    found = {f: searched(f, added(f, [v]), model) for f, v in block.whole(model, resid)}
    if block.splitting(model):
        for part, upto in block.summed(model, resid):
            found |= zip(part, zip(*splits(upto, model.settings)))
    model.advance(found)


@dataclass
class Boosted:
    """Fitted trees of several models over the same columns; model m of a row is named by a column."""

    cols: list[str]
    edges: list[np.ndarray]
    models: list[Growing]
    clip: tuple[float, float] | None

    def predict(self, df: DataFrame, name: str, model: Column) -> DataFrame:
        """df with the prediction of the model whose number `model` gives; NULL where that model has no trees."""
        edges, trees, clip = self.edges, [stacked(m.trees) if m.trees else None for m in self.models], self.clip

        @F.pandas_udf("double")
        def score(values: pd.Series, number: pd.Series) -> pd.Series:
            out = np.full(len(values), np.nan)
            if len(values):
                x, number = binned(np.stack(values.to_numpy()).astype(float), edges), number.to_numpy()
                for m in np.unique(number[~pd.isna(number)]).astype(int):
                    rows = np.flatnonzero(number == m)
                    if trees[m]:
                        out[rows] = added_up(trees[m], x[rows])
            return pd.Series(out if clip is None else np.clip(out, *clip)).replace({np.nan: None}).astype(float)

        values = F.array(*[F.expr(f"coalesce(CAST(`{c}` AS DOUBLE), CAST('NaN' AS DOUBLE))") for c in self.cols])
        scored = df.withColumn(name, score(values, model))
        return scored.withColumn(name, F.when(~F.isnan(name), F.col(name)))

    def importance(self, number: int = 0) -> dict[str, float]:
        """Total gain per column of one model."""
        return {self.cols[f]: self.models[number].gains.get(f, 0.0) for f in self.models[number].features}


def binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    out = np.zeros(x.shape, np.uint8)
    for i, e in enumerate(edges):
        out[:, i] = np.where(np.isnan(x[:, i]), 0, np.searchsorted(e, x[:, i], "left") + 1)
    return out


def quantile_edges(rows: DataFrame, cols: Sequence[str], n: int, accuracy: int = 10_000) -> list[np.ndarray]:
    """At most 254 upper ends of bins per column, from one pass with a sketch per column."""
    parts = max(2, min(BINS - 1, n // BIN_ROWS))
    shares = ", ".join(repr(i / parts) for i in range(1, parts))
    wide = rows.agg(*[F.expr(f"percentile_approx(CASE WHEN NOT isnan(`{c}`) THEN CAST(`{c}` AS DOUBLE) END, array({shares}), {accuracy})").alias(f"q{i}")
                      for i, c in enumerate(cols)]).first()
    return [np.unique(np.array(q if q is not None else [], dtype=float)) for q in wide]


def row_blocks(rows: DataFrame, cols: Sequence[str], edges: list[np.ndarray], most: int) -> DataFrame:
    """Rows (_y, _u, _fold, columns) as blocks of at most `most`."""
    arrow = to_arrow_schema(BLOCKS)

    def run(batches):
        held, size = [], 0  # rows wait as bins, which take an eighth of the columns' memory
        for batch in batches:
            for i in range(0, batch.num_rows, most):
                held.append(parts(batch.slice(i, most)))
                size += len(held[-1][0])
                while size >= most:
                    whole = [np.concatenate(p) for p in zip(*held)]
                    yield made([p[:most] for p in whole])
                    held, size = [[p[most:] for p in whole]], size - most
        if size:
            yield made([np.concatenate(p) for p in zip(*held)])

    def parts(t):
        x = np.column_stack([t[f"_{i}"].to_numpy(zero_copy_only=False) for i in range(len(edges))]) if edges else np.zeros((t.num_rows, 0))
        y, u, fold = (t[c].to_numpy(zero_copy_only=False) for c in ("_y", "_u", "_fold"))
        return binned(x, edges), y, u.view(np.uint64), fold.astype(np.int32)

    def made(whole):
        cells = [np.ascontiguousarray(p).tobytes() for p in whole]
        return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells] + [pa.array([None], pa.binary()), pa.array([len(whole[0])], pa.int32())], schema=arrow)

    values = [F.expr(f"coalesce(CAST(`{c}` AS DOUBLE), CAST('NaN' AS DOUBLE))").alias(f"_{i}") for i, c in enumerate(cols)]
    return rows.select("_y", "_u", "_fold", *values).mapInArrow(run, BLOCKS)


def best_split(models: dict[int, Growing]):
    """For (model, table): the tables of all blocks added up and searched."""
    schema = to_arrow_schema(FOUND)

    def reduce(key, table):
        m, f = (k.as_py() for k in key)
        total = added(f, [pickle.loads(v) for v in table["v"].to_pylist()])
        return pa.Table.from_pylist([dict(zip(FOUND.names, (m, f, *searched(f, total, models[m]))))], schema=schema)
    return reduce


def grown_together(blocks: DataFrame, models: list[Growing]) -> list[Growing]:
    """One aggregate over all blocks per step, until every model is done."""
    tables_schema = to_arrow_schema(TABLES)
    many = len(models)
    while not all(m.done for m in models):
        active = [m for m in models if not m.done]
        by_number = {m.number: m for m in active}

        def partial(batches, active=active):
            for batch in batches:
                for row in batch.to_pylist():
                    block = Block(row, many)
                    out = [(m.number, f, pickle.dumps(v)) for m in active for f, v in block.tables(m)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), tables_schema)], schema=tables_schema)

        steps = blocks.mapInArrow(partial, TABLES).groupBy("m", "f").applyInArrow(best_split(by_number), FOUND)
        found: dict[int, dict] = {m.number: {} for m in active}
        for r in steps.collect():  # one row per model and feature
            found[r["m"]][r["f"]] = (r["gain"], r["cut"], r["left"])
        for m in active:
            m.advance(found[m.number])
        if any(not m.done and m.level == 0 and len(m.trees) - m.kept >= KEPT for m in models):
            def written(batches, models=models):
                for batch in batches:
                    for row in batch.to_pylist():
                        block = Block(row, many)
                        for m in models:
                            if not m.done:
                                block.catch_up(m)
                        row["margin"] = np.concatenate([block.margin(m.number) for m in models]).tobytes()
                        yield pa.RecordBatch.from_pylist([row], schema=to_arrow_schema(BLOCKS))
            blocks = stored(blocks.mapInArrow(written, BLOCKS), "margins")
            for m in models:
                m.kept = len(m.trees)
    return models


def grown_apart(blocks: DataFrame, models: list[Growing]) -> list[Growing]:
    """All steps of a model in one task, each model in its own: for rows that a task can hold."""
    many = len(models)
    numbers = F.explode(F.array(*[F.lit(m.number) for m in models])).alias("m")

    def run(batches):
        held: dict[int, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault(row["m"], []).append(row)
        batch = row = None
        while held:
            number, rows = held.popitem()
            model, block = models[number], Block.joined(rows, models[number].hold)
            del rows
            while not model.done:
                step_alone(block, model)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([model.result()])], schema=to_arrow_schema(MODELS))

    placed = blocks.select("*", numbers).repartitionById(many, "m")  # a hash would put several models into one task
    for r in placed.mapInArrow(run, MODELS).collect():
        models[r["m"]].take(r["model"])
    return models


def fit_boosters(rows: DataFrame, cols: Sequence[str], label: str, key: str, subsets: Sequence[Sequence[str]],
                 fold: Column | None = None, folds: Sequence[int] = (-1,), clip: tuple[float, float] | None = None,
                 settings: Settings = Settings()) -> Boosted:
    """Models for every subset of the columns and every fold, in the order of (subset, fold); a fold's number is left out of its
    training rows, -1 leaves out none. Rows without label are ignored. About max(min_es, es_frac * n) rows, by a hash of the key, choose the last round."""
    cols = list(cols)
    where = {c: i for i, c in enumerate(cols)}
    used = rows.filter(F.col(label).isNotNull()).withColumns({
        "_y": F.col(label).cast("double"), "_u": F.xxhash64(F.col(key)), "_fold": (F.lit(0) if fold is None else fold).cast("int")})
    per_fold = {r["_fold"]: r["count"] for r in used.groupBy("_fold").count().collect()}  # one row per fold
    n = sum(per_fold.values())
    edges = quantile_edges(used, cols, n)
    bins = max((len(e) for e in edges), default=0) + 2
    models = []
    for subset in subsets:
        for hold in folds:
            left = n - per_fold.get(hold, 0)
            wanted = min(left // 2, max(settings.min_es, int(settings.es_frac * left)))
            models.append(Growing(len(models), [where[c] for c in subset], hold, wanted / max(left, 1), settings, bins))
    small = n <= ALONE_BLOCKS * BLOCK_ROWS and n * len(cols) <= ALONE_BYTES
    blocks = stored(row_blocks(used, cols, edges, BLOCK_ROWS), "blocks")
    grown = (grown_apart if small else grown_together)(blocks, models) if n else models
    return Boosted(cols, edges, grown, clip)
