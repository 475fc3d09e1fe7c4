"""Vector codes against a plain Lloyd loop over whole numbers."""

import math

import numpy as np
import pytest

from tidemark.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, row long, entry int, error long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)


def by_loop(rows, n_parts, n_entries, rounds):
    """(vec_id, label, entries, error) sorted, and the codebooks, with Python's own integers."""
    kept = [(i, [math.floor(1024 * x) for x in np.float32(v).astype(float).tolist()], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // n_parts)
    kept = [(i, v + [0] * (n_parts * width - len(v)), label, v) for i, v, label in kept]
    rank = lambda i: (i is None, i or 0)
    first = {}
    for i, v, _, own in sorted(kept, key=lambda r: (rank(r[0]), r[3])):
        first.setdefault(i, v)
    seeds = [first[i] for i in sorted(first, key=rank)[:n_entries]]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(s, p) for s in seeds] for p in range(n_parts)]

    def name(v, p):
        far = [sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)) for e in books[p]]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p in range(n_parts):
            held = [[] for _ in seeds]
            for _, v, _, _ in kept:
                held[name(v, p)[0]].append(cut(v, p))
            books[p] = [[sum(c) // len(m) for c in zip(*m, strict=True)] if m else b for m, b in zip(held, books[p], strict=True)]
    out = []
    for i, v, label, _ in kept:
        named = [name(v, p) for p in range(n_parts)]
        out.append((i, label, [e for e, _ in named], min(sum(d for _, d in named), 2**63 - 1)))
    return sorted(out, key=str), books


def got(codes):
    rows = [(r["vec_id"], r["label"], r["entries"], r["error"]) for r in codes.rows.collect()]
    return sorted(rows, key=str), [b.tolist() for b in codes.codebooks]


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(12, 8)) / 5
    rows = [(int(i), (centres[i % 12] + draw.normal(size=8) / 30).tolist(), int(i % 3)) for i in draw.permutation(300)]
    rows += [(1000 + i, [0.125] * 8, None) for i in range(150)]  # a third of all alike
    return rows + [(2000, None, 1), (2001, [1.0, None] * 4, 1), (2002, [float("nan")] * 8, 1), (2003, [float("inf")] * 8, 1)]


def test_equals_a_loop(spark, rows):
    codes = vector_codes.compress(frame(spark, rows), n_entries=20)
    assert got(codes) == by_loop(rows, 4, 20, 4)
    summed = vector_codes.with_label_errors(codes.rows).collect()
    for label in (0, 1, 2, None):
        of = [r for r in summed if r["label"] == label]
        assert {r["label_error"] for r in of} == {sum(r["error"] for r in of)}
    assert len(summed) == 450


def test_small_partitions_and_residents(spark, rows):
    assert got(vector_codes.compress(frame(spark, rows), n_entries=20, most_bytes=300)) == by_loop(rows, 4, 20, 4)


def test_only_changed_parts_move():
    shape = vector_codes.Shape(1, 2, 3, True, "<i2", 5)
    parts = np.array([[0, 0], [9, 9], [5, 5], [9, 8]], "<i2")
    block = np.arange(4), np.zeros(4, np.uint8), np.array([0, 0, 2, 1], np.uint16), parts

    class Books:
        value = [np.array([[0, 0], [9, 9], [5, 5]])]

    out = list(vector_codes.move(3, [(3, block)], Books, shape))
    assert out[0][0] == 3 and out[0][1][0].tolist() == [0, 2, 3]
    assert [x[1][0].tolist() for x in out[1:]] == [[1]]


def test_odd_tables(spark):
    assert got(vector_codes.compress(frame(spark, []))) == ([], [])
    assert got(vector_codes.compress(frame(spark, [(1, None, 1)]))) == ([], [])
    odd = [(5, [0.5, 0.25, 0.1], 1), (5, [0.5, 0.25, 0.2], 1), (None, [], None), (7, [-0.1] * 6, 2), (7, [-0.1] * 6, 2)]
    assert got(vector_codes.compress(frame(spark, odd), n_entries=3)) == by_loop(odd, 4, 3, 4)
    assert got(vector_codes.compress(frame(spark, odd[2:3]))) == by_loop(odd[2:3], 4, 256, 4)
    huge = [(1, [1e9, 0.0], 1), (2, [-3e9, 2e9], 1), (3, [1e12, -1e12], 1), (4, [1.0, 2.0], 1)]
    assert got(vector_codes.compress(frame(spark, huge), n_parts=2, n_entries=2)) == by_loop(huge, 2, 2, 4)


def test_residents_are_united_in_place(spark):
    shape = vector_codes.Shape(1, 1, 2, True, "<i2", 3)
    first = spark.sparkContext.parallelize([(0, "a"), (2, "b")], 2).partitionBy(shape.partitions, vector_codes.place)
    own = first.mapPartitionsWithIndex(lambda i, x: x, preservesPartitioning=True)
    more = spark.sparkContext.parallelize([(2, "c")], 2).partitionBy(shape.partitions, vector_codes.place)
    assert own.union(more).getNumPartitions() == shape.partitions
