"""A quality classifier: naive Bayes support vectors on hashed n-gram indicators.

A text is the set of its byte n-grams and of the n-grams of its shape (letters, capitals,
digits and other bytes told apart only by kind), hashed into ``DIMENSIONS`` places. Each
indicator is scaled by the log ratio of its share in the two classes, texts are brought to
length one, and a linear model with hinge loss is fitted by dual coordinate descent. A
logistic curve over the margins of held-back training rows turns margins into scores.

The model is fitted on a bounded sample of labelled rows (``sample``), chosen by a hash of
doc_id; scoring reads every whole text once, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import few_rows_at_once, small, texts

BITS = 18
DIMENSIONS = 1 << BITS
BYTE_ORDERS, SHAPE_ORDERS = (1, 2, 3), (2, 4, 6)


def _shapes() -> np.ndarray:
    kinds = np.full(256, ord("u"), np.uint32)
    for code in range(128):
        char = chr(code)
        kinds[code] = ord("a") if char.islower() else ord("A") if char.isupper() else ord("0") if char.isdigit() else code
    return kinds


SHAPES = _shapes()
_STEP, _SPREAD = np.uint32(16777619), np.uint32(2654435769)


def indicators(text: bytes, seen: np.ndarray) -> np.ndarray:
    """The places of a text's n-grams; ``seen`` is a cleared scratch array of flags."""
    raw = np.frombuffer(text, np.uint8)
    for units, orders, start in ((raw.astype(np.uint32), BYTE_ORDERS, 2166136261), (SHAPES[raw], SHAPE_ORDERS, 84696351)):
        state = np.full(len(units), start, np.uint32)
        for order in range(1, min(max(orders), len(units)) + 1):
            state = (state[: len(units) - order + 1] ^ units[order - 1 :]) * _STEP
            if order in orders:
                seen[((state ^ (state >> np.uint32(15))) * _SPREAD) >> np.uint32(32 - BITS)] = True
    places = np.flatnonzero(seen)
    seen[places] = False
    return places


@dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * margin + shift))); margin from the scaled indicators."""

    ratios: np.ndarray
    weights: np.ndarray  # ratio times weight, per place
    bias: float
    slope: float
    shift: float

    def margin(self, places: np.ndarray) -> float:
        length = float(np.sqrt((self.ratios[places] ** 2).sum()))
        return self.bias + (float(self.weights[places].sum()) / length if length else 0.0)

    def score(self, places: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(places) + self.shift, -500, 500))))


def log_count_ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    counts = np.ones((2, DIMENSIONS))
    for places, label in zip(rows, good, strict=True):
        counts[int(label), places] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def dual_coordinate_descent(
    rows: list[np.ndarray], values: list[np.ndarray], good: np.ndarray, cost: float = 1.0, rounds: int = 20
) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear hinge-loss model; one dual variable a row, kept in [0, cost].

    Rows have length one, and the bias is a further place of value one.
    """
    weights, bias = np.zeros(DIMENSIONS), 0.0
    dual, signs = np.zeros(len(rows)), np.where(good, 1.0, -1.0)
    draw = np.random.default_rng(7)
    for _ in range(rounds):
        largest = 0.0
        for i in draw.permutation(len(rows)):
            places, value, sign = rows[i], values[i], signs[i]
            gradient = sign * (weights[places] @ value + bias) - 1
            new = min(max(dual[i] - gradient / (float(value @ value) + 1), 0.0), cost)
            if change := new - dual[i]:
                dual[i] = new
                weights[places] += change * sign * value
                bias += change * sign
                largest = max(largest, abs(change))
        if largest < 1e-3:
            break
    return weights, bias


def logistic_curve(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps on smoothed targets, so that they stay finite."""
    n1, n0 = int(good.sum()), int((~good).sum())
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    slope, shift = 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    x = np.stack([margins, np.ones(len(margins))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -500, 500)))
        gradient = x @ (p - target)
        hessian = (x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        change = np.linalg.solve(hessian, gradient)
        change *= min(1.0, 5.0 / max(abs(change).max(), 1e-12))
        slope, shift = slope - change[0], shift - change[1]
        if abs(change).max() < 1e-6:
            break
    return float(slope), float(shift)


def fit_rows(rows: list[np.ndarray], good: np.ndarray) -> Model:
    """Every fifth row only bends the curve; with one class or none the score is its share."""
    n1, n0 = int(good.sum()), int((~good).sum())
    held = np.arange(len(rows)) % 5 == 4
    if min(good[~held].sum(), (~good[~held]).sum()) == 0:
        nothing = np.zeros(DIMENSIONS)
        return Model(nothing, nothing, 0.0, 1.0, float(np.log((n1 + 1) / (n0 + 1))))
    learnt = [r for r, h in zip(rows, held, strict=True) if not h]
    ratios = log_count_ratios(learnt, good[~held])
    lengths = [float(np.sqrt((ratios[r] ** 2).sum())) or 1.0 for r in learnt]
    values = [ratios[r] / n for r, n in zip(learnt, lengths, strict=True)]
    weights, bias = dual_coordinate_descent(learnt, values, good[~held])
    model = Model(ratios, weights * ratios, bias, 1.0, 0.0)
    bends = held if held.any() else ~held
    margins = np.array([model.margin(r) for r, h in zip(rows, bends, strict=True) if h])
    model.slope, model.shift = logistic_curve(margins, good[bends])
    return model


def _indicated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(DIMENSIONS, bool)
    for batch in small(batches):
        places = [indicators(t, seen).astype("<i4").tobytes() for t in texts(batch.column("text"))]
        yield batch.drop_columns(["text"]).append_column("places", pa.array(places, pa.binary()))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no model may see: crc32 of the id as text leaves no rest by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = 8000) -> Model:
    """The model from at most ``sample`` labelled rows of ``docs`` that are not held out.

    Labels are ``labels(doc_id, quality)``; those that are null or neither 0 nor 1 and those
    without a document teach nothing. Only the text is an input. Of rows that share a doc_id the
    text with the least hash is learnt, so the driver gets no more rows than ``sample``.
    """
    usable = labels.where(
        F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    ).select("doc_id", F.col("quality").cast("int"))
    chosen = usable.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    taught = few_rows_at_once(docs).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `sample` ids at most
    one = taught.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    rows = one.mapInArrow(_indicated, "doc_id long, quality int, places binary").collect()
    rows.sort(key=lambda r: (r["doc_id"] * 2654435761 % (1 << 32), r["doc_id"], r["quality"], r["places"]))
    return fit_rows(
        [np.frombuffer(r["places"], "<i4") for r in rows], np.array([r["quality"] == 1 for r in rows], bool)
    )


def _scored(batches: Iterable[pa.RecordBatch], model: Model, name: str) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(DIMENSIONS, bool)
    for batch in small(batches):
        scores = [model.score(indicators(t, seen)) for t in texts(batch.column("text"))]
        yield batch.append_column(name, pa.array(scores, pa.float64()))


def with_score(docs: DataFrame, model: Model, name: str = "_score") -> DataFrame:
    """``docs`` and a column ``name`` from 0 to 1, in place of one of that name; a null text counts as empty.

    Rows come out as they are, repeated ones too; an empty table gives an empty result. Other
    columns may have any names.
    """
    docs = docs.drop(name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return few_rows_at_once(docs).mapInArrow(partial(_scored, model=model, name=name), schema)
