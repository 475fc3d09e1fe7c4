"""Boosted trees for several classes with a softmax loss, grown from histograms that Spark adds up.

Features are binned once. In every round each class gets one tree; every level of all trees of a
round is one aggregate: gradients and curvatures by (class, node, feature, bin), added up in
arrays by each task, so that no row is multiplied by classes and features. What comes to the driver is that histogram, whose size depends on classes, depth,
features and bins and not on rows. Scores are written after each round, so a lost executor
costs a re-read, and the plan does not grow.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MOST_CLASSES = 100
# a tree is the value of a leaf, or (feature, bin, rows up to that bin, the others)
Tree = float | tuple


@dataclass
class SoftmaxBoost:
    """A fitted model; ``probabilities`` scores a table or a stream."""

    features: list[str]
    edges: list[list[float]]
    classes: list
    base: list[float]
    trees: list[list[Tree]] = field(default_factory=list)

    def binned(self) -> Column:
        """Bin of each feature: how many edges are below the value; nulls and NaN have bin -1."""
        return F.array(*[_bin(F.col(f"`{f}`").cast("double"), e) for f, e in zip(self.features, self.edges)])

    def probabilities(self, df: DataFrame, name: str = "probabilities", chosen: str | None = None) -> DataFrame:
        """``df`` with the probability of each class, in the order of ``classes``, and the likeliest class."""
        taken = set(df.columns)
        inner = "bins"
        while inner in taken:
            inner = f"_{inner}"
        x = F.col(inner)
        scores = [F.lit(b) + sum((_value(x, round_[k]) for round_ in self.trees), F.lit(0.0)) for k, b in enumerate(self.base)]
        out = df.withColumn(inner, self.binned()).withColumn(name, _softmax(F.array(*scores))).drop(inner)
        if chosen:
            best = F.array_position(F.col(name), F.array_max(name)).cast("int")
            out = out.withColumn(chosen, F.get(F.array(*[F.lit(c) for c in self.classes]), best - 1))
        return out


def _bin(value: Column, edges: Sequence[float]) -> Column:
    known = F.when(value.isNotNull() & ~F.isnan(value), value)
    if not edges:
        return F.when(known.isNull(), -1).otherwise(0)
    below = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < known))
    return F.when(known.isNull(), -1).otherwise(below)


def _softmax(scores: Column) -> Column:
    power = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    return F.transform(power, lambda e: e / F.aggregate(power, F.lit(0.0), lambda a, b: a + b))


def _value(x: Column, tree: Tree) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    feature, last, left, right = tree
    return F.when(F.get(x, F.lit(feature)) <= last, _value(x, left)).otherwise(_value(x, right))


def _open_nodes(x: np.ndarray, splits: dict[int, tuple[int, int]], level: int) -> np.ndarray:
    """Number of the node of this level that each row is in; -1 where its branch has ended."""
    at = np.ones(len(x), np.int64)
    for _ in range(level):
        feature, last = np.full(int(at.max(initial=1)) + 1, -1), np.zeros(int(at.max(initial=1)) + 1, np.int64)
        for node, (f, b) in splits.items():
            if node < len(feature):
                feature[node], last[node] = f, b
        own = feature[at]  # node 0 has no split: rows of ended branches wait there
        right = x[np.arange(len(x)), np.maximum(own, 0)] > last[at]
        at = np.where(own >= 0, 2 * at + right, 0)
    return np.where(at > 0, at, -1)


def _histograms(rows: DataFrame, splits: list[dict[int, tuple[int, int]]], level: int, n_features: int, n_bins: int) -> DataFrame:
    """Gradients, curvatures and rows by (class, node, feature, bin): arrays per task, then one aggregate."""
    n_classes, n_nodes, width = len(splits), 2 << level, n_bins + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((n_classes, n_features, 3, n_nodes * width))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, n_features).astype(np.int64)
            scores = batch.column("s").flatten().to_numpy(zero_copy_only=False).reshape(-1, n_classes)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            p = np.exp(scores - scores.max(axis=1, keepdims=True, initial=-np.inf))
            p /= p.sum(axis=1, keepdims=True)
            for k in range(n_classes):
                node = _open_nodes(x, splits[k], level)
                here = node >= 0
                g, h = (p[:, k] - (y == k))[here], (p[:, k] * (1 - p[:, k]))[here]
                for f in range(n_features):
                    cell = node[here] * width + x[here, f] + 1  # bin -1 is the first
                    for i, weights in enumerate((g, h, None)):
                        sums[k, f, i] += np.bincount(cell, weights, n_nodes * width)
        k, f, cell = np.nonzero(sums[:, :, 2])
        g, h, n = (sums[k, f, i, cell] for i in range(3))
        made = [k.astype(np.int32), cell // width, f.astype(np.int32), (cell % width - 1).astype(np.int32), g, h, n.astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], names=["k", "node", "f", "bin", "g", "h", "n"])

    parts = rows.mapInArrow(add, "k int, node bigint, f int, bin int, g double, h double, n bigint")
    return parts.groupBy("k", "node", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))


def _best_split(hist: pd.DataFrame, l2: float, min_rows: int) -> tuple | None:
    """Feature, bin and sums of both sides of the best split; equal gains go to the earlier feature and bin."""
    best, best_gain = None, 1e-12
    for feature, part in hist.sort_values(["f", "bin"]).groupby("f"):
        left = part[["g", "h", "n"]].to_numpy(float).cumsum(axis=0)
        right = left[-1] - left
        gain = left[:, 0] ** 2 / (left[:, 1] + l2) + right[:, 0] ** 2 / (right[:, 1] + l2) - left[-1, 0] ** 2 / (left[-1, 1] + l2)
        gain[(left[:, 2] < min_rows) | (right[:, 2] < min_rows)] = -np.inf
        gain = np.round(gain, 9)
        i = int(np.argmax(gain))
        if gain[i] > best_gain:
            best, best_gain = (int(feature), int(part["bin"].iloc[i]), left[i], right[i]), float(gain[i])
    return best


def _grow(rows: DataFrame, n_classes: int, n_features: int, n_bins: int, depth: int, rate: float, l2: float, min_rows: int) -> list[Tree]:
    """One tree for each class on the gradients of the present scores."""
    splits: list[dict[int, tuple[int, int]]] = [{} for _ in range(n_classes)]
    sums: list[dict[int, np.ndarray]] = [{} for _ in range(n_classes)]
    for level in range(depth):
        hist = _histograms(rows, splits, level, n_features, n_bins).toPandas()
        for (k, node), part in hist.groupby(["k", "node"]):
            if level == 0:
                first = part[part["f"] == part["f"].min()]
                sums[k][node] = first[["g", "h", "n"]].to_numpy(float).sum(axis=0)
            found = _best_split(part, l2, min_rows)
            if found:
                splits[k][node] = found[:2]
                sums[k][2 * node], sums[k][2 * node + 1] = found[2:]
        if not any(n >= 1 << level for s in splits for n in s):
            break

    def tree(k: int, node: int) -> Tree:
        if node in splits[k]:
            return (*splits[k][node], tree(k, 2 * node), tree(k, 2 * node + 1))
        g, h, _ = sums[k][node]
        return float(-rate * g / (h + l2))

    return [tree(k, 1) for k in range(n_classes)]


def fit_softmax(
    train: DataFrame, *, features: Sequence[str], label: str, rounds: int = 20, depth: int = 3, rate: float = 0.1, bins: int = 32,
    min_rows: int = 20, l2: float = 1.0,
) -> SoftmaxBoost:
    """Fit on the rows with a label; null and NaN features are a value of their own, below all others.

    Classes are the labels found, in order. Bin edges are approximate quantiles (exact up to ten
    thousand different values). A split leaves at least ``min_rows`` rows on either side. An
    input without a labelled row is an error, and so are more than a hundred classes.
    """
    labelled = train.where(F.col(f"`{label}`").isNotNull())
    counts = labelled.groupBy(F.col(f"`{label}`").alias("y")).agg(F.count("*").alias("n")).orderBy("y").limit(MOST_CLASSES + 1).collect()
    if not counts or len(counts) > MOST_CLASSES:
        raise ValueError(f"need 1 to {MOST_CLASSES} classes")
    classes, total = [r["y"] for r in counts], sum(r["n"] for r in counts)
    at = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    known = lambda f: F.when(~F.isnan(F.col(f"`{f}`").cast("double")), F.col(f"`{f}`").cast("double"))
    found = labelled.agg(*[F.percentile_approx(known(f), at, 10_000).alias(f"e{i}") for i, f in enumerate(features)]).first()
    edges = [sorted(set(e or [])) for e in found]
    model = SoftmaxBoost(list(features), edges, classes, [float(np.log(r["n"] / total)) for r in counts])
    y = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(f"`{label}`")).cast("int") - 1
    rows = labelled.select(model.binned().alias("x"), y.alias("y"), F.array(*[F.lit(b) for b in model.base]).alias("s"))
    rows = stage(rows, "boosting_scores")
    for i in range(rounds):
        trees = _grow(rows, len(classes), len(model.features), max(map(len, edges), default=0) + 1, depth, rate, l2, min_rows)
        model.trees.append(trees)
        if i + 1 < rounds:
            moved = F.array(*[F.get("s", F.lit(k)) + _value(F.col("x"), t) for k, t in enumerate(trees)])
            rows = stage(rows.withColumn("s", moved), "boosting_scores")
    return model
