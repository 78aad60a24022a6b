"""Extremely randomised trees and histogram boosting for regression, in NumPy.

Both fit on a bounded sample of rows.  The trees of a forest are independent and are grown
by Spark tasks, a few each; boosting is sequential and runs on the driver over binned
features.  Predicting runs on the executors with the trees sent along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from helixframe.models.features import encode, kmer_matrix
from helixframe.shipping import arrow_map


@dataclass
class Tree:
    """Nodes as arrays: rows with ``x[feature] <= cut`` go to ``left``, others to ``right``; a leaf has feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        open_ = np.flatnonzero(self.feature[at] >= 0)
        while len(open_):
            node = at[open_]
            low = x[open_, self.feature[node]] <= self.cut[node]
            at[open_] = np.where(low, self.left[node], self.right[node])
            open_ = open_[self.feature[at[open_]] >= 0]
        return self.value[at]


class _Growing:
    """A tree while it grows."""

    def __init__(self):
        self.rows: list[list[float]] = []

    def add(self, value: float) -> int:
        self.rows.append([-1, 0.0, -1, -1, value])
        return len(self.rows) - 1

    def split(self, node: int, feature: int, cut: float, left: int, right: int) -> None:
        self.rows[node][:4] = [feature, cut, left, right]

    def done(self) -> Tree:
        f, c, a, b, v = (np.array(x, dtype=np.float64) for x in zip(*self.rows, strict=True))
        return Tree(f.astype(np.int64), c, a.astype(np.int64), b.astype(np.int64), v)


def random_tree(x: np.ndarray, y: np.ndarray, seed: tuple[int, int], leaf: int = 8) -> Tree:
    """One extremely randomised tree over all rows.

    At each node every feature that varies gets one cut, uniform between its least and greatest
    value; of those that leave ``leaf`` rows on either side the one that lowers the squared
    error most is taken.  A node without such a cut, or with one label only, is a leaf.
    """
    rng, tree = np.random.default_rng(seed), _Growing()
    todo = [(tree.add(float(y.mean())), np.arange(len(y)))]
    while todo:
        node, rows = todo.pop()
        own, labels = x[rows], y[rows]
        if len(rows) < 2 * leaf or labels.min() == labels.max():
            continue
        low, high = own.min(axis=0), own.max(axis=0)
        varies = np.flatnonzero(high > low)
        if not len(varies):
            continue
        cuts = rng.uniform(low[varies], high[varies])
        goes = own[:, varies] <= cuts
        n = goes.sum(axis=0)
        total, sums = labels.sum(), labels @ goes
        fits = (n >= leaf) & (len(rows) - n >= leaf)
        if not fits.any():
            continue
        gain = np.full(len(varies), -np.inf)
        gain[fits] = sums[fits] ** 2 / n[fits] + (total - sums[fits]) ** 2 / (len(rows) - n[fits])
        best = int(gain.argmax())
        side = goes[:, best]
        left, right = tree.add(float(labels[side].mean())), tree.add(float(labels[~side].mean()))
        tree.split(node, int(varies[best]), float(cuts[best]), left, right)
        todo += [(left, rows[side]), (right, rows[~side])]
    return tree.done()


@dataclass
class TreeSum:
    """A base value and trees; a forest weighs each by one over their number, boosting by its rate."""

    base: float
    rate: float
    trees: list[Tree]

    def predict(self, texts: list[str]) -> np.ndarray:
        x = kmer_matrix(encode(texts))
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += self.rate * t.predict(x)
        return out


def extra_trees(spark: SparkSession, texts: list[str], y: np.ndarray, trees: int = 128, leaf: int = 8, seed: int = 0) -> TreeSum:
    """A forest of extremely randomised trees, each over all the rows given; tasks grow the trees, a tree's draws come from (seed, tree)."""
    shared = spark.sparkContext.broadcast((kmer_matrix(encode(texts)), np.asarray(y, dtype=np.float64)))  # the caller bounds the rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, labels = shared.value
        for batch in batches:
            for k in batch.column("id").to_pylist():
                t = random_tree(x, labels, (seed, k), leaf)
                parts = [np.asarray(v, dtype=np.float64).tobytes() for v in (t.feature, t.cut, t.left, t.right, t.value)]
                yield pa.RecordBatch.from_arrays([pa.array([k]), *(pa.array([p], pa.binary()) for p in parts)], names=["id", "feature", "cut", "lo", "hi", "value"])

    tasks = min(trees, max(1, spark.sparkContext.defaultParallelism))
    rows = arrow_map(spark.range(0, trees, 1, tasks), run, "id long, feature binary, cut binary, lo binary, hi binary, value binary").collect()  # `trees` rows
    grown = []
    for r in sorted(rows, key=lambda r: r["id"]):
        f, c, a, b, v = (np.frombuffer(r[k]) for k in ("feature", "cut", "lo", "hi", "value"))
        grown.append(Tree(f.astype(np.int64), c, a.astype(np.int64), b.astype(np.int64), v))
    shared.unpersist()
    return TreeSum(0.0, 1 / trees, grown)


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Cuts of each feature: midpoints between its distinct values, or its percentiles where it has more than ``bins``."""
    out = []
    for column in x.T:
        values = np.unique(column)
        out.append((values[1:] + values[:-1]) / 2 if len(values) <= bins else np.unique(np.percentile(column, np.linspace(0, 100, bins + 1)[1:-1], method="midpoint")))
    return out


def histogram_boosting(texts: list[str], y: np.ndarray, rounds: int = 100, rate: float = 0.05, leaves: int = 15, least: int = 20, bins: int = 255) -> TreeSum:
    """Gradient boosting for squared error over binned features; trees grow best leaf first, to ``leaves`` leaves of ``least`` rows or more.

    The histogram of the larger child is its parent's less the smaller child's.
    """
    x, y = kmer_matrix(encode(texts)), np.asarray(y, dtype=np.float64)
    edges = bin_edges(x, bins)
    codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    width, features = bins + 1, x.shape[1]
    flat = codes + np.arange(features) * width
    base, trees = float(y.mean()), []
    score = np.full(len(y), base)

    def histogram(rows: np.ndarray, errors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = flat[rows].ravel()
        shape = (features, width)
        return np.bincount(at, weights=np.repeat(errors[rows], features), minlength=features * width).reshape(shape), np.bincount(at, minlength=features * width).reshape(shape)

    def best_cut(sums: np.ndarray, counts: np.ndarray) -> tuple[float, int, int]:
        n, left_n = counts[0].sum(), counts.cumsum(axis=1)[:, :-1]
        total, left = sums[0].sum(), sums.cumsum(axis=1)[:, :-1]
        fits = (left_n >= least) & (n - left_n >= least)
        gain = np.where(fits, left**2 / np.maximum(1, left_n) + (total - left) ** 2 / np.maximum(1, n - left_n) - total**2 / max(1, n), -np.inf)
        k = int(gain.argmax())
        return float(gain.ravel()[k]), k // (width - 1), k % (width - 1)

    for _ in range(rounds):
        errors, tree = y - score, _Growing()
        rows = np.arange(len(y))
        sums = histogram(rows, errors)
        open_ = [(*best_cut(*sums), tree.add(float(errors.mean())), rows, sums)]
        done: list[tuple[int, np.ndarray]] = []
        while open_ and len(open_) + len(done) < leaves:
            k = max(range(len(open_)), key=lambda i: open_[i][0])
            gain, feature, place, node, rows, sums = open_.pop(k)
            if gain <= 1e-12:
                done.append((node, rows))
                continue
            side = codes[rows, feature] <= place
            left, right = rows[side], rows[~side]
            small = histogram(left if len(left) <= len(right) else right, errors)
            other = (sums[0] - small[0], sums[1] - small[1])
            parts = (small, other) if len(left) <= len(right) else (other, small)
            ids = [tree.add(float(errors[part].mean())) for part in (left, right)]
            tree.split(node, feature, float(edges[feature][place]), *ids)
            open_ += [(*best_cut(*h), i, part, h) for i, part, h in zip(ids, (left, right), parts, strict=True)]
        for node, rows in [*done, *((o[3], o[4]) for o in open_)]:
            score[rows] += rate * tree.rows[node][4]
        trees.append(tree.done())
    return TreeSum(base, rate, trees)
