"""Exact top-k search by inner product: columnar branch and bound.

Candidates and queries are dealt into blocks, and every pair of blocks meets in one bounded
cell. A cell holds its candidates dimension by dimension. Scores are accumulated a block of
dimensions at a time; what the remaining dimensions can still add or take is at most the
product of the two remaining norms, so after each block a candidate whose best case is below
the k-th best worst case is dropped and the survivors are compacted. The k best of all cells
of a query are then ranked.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORED = "query_id long, query_key long, vec_id long, score long"
SCORED_ARROW = pa.schema([(n, pa.int64()) for n in ("query_id", "query_key", "vec_id", "score")])
EXACT = float(1 << 53)  # whole numbers below this are exact as doubles


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of integers; shorter ones are filled up with zeros."""
    lists = column.combine_chunks()
    sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def branch_and_bound(
    query: np.ndarray, own: np.ndarray, first: np.ndarray, columns: np.ndarray, rest: np.ndarray, k: int, step: int
) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of candidates that can be among the k best of one query.

    ``columns`` is dimensions x candidates, ``rest[b]`` the norm of each candidate beyond
    block b, ``first`` the scores over the first block, ``own`` the places to leave out.
    """
    at = own
    partial_scores = first[at]
    if len(at) < columns.shape[1]:
        columns, rest = columns[:, at], rest[:, at]
    for b, start in enumerate(range(step, len(query), step)):
        if len(at) > k:
            slack = np.sqrt(float((query[start:] ** 2).sum())) * rest[b] * (1 + 1e-9) + 1
            kth = np.partition(partial_scores - slack, len(at) - k)[len(at) - k]
            alive = partial_scores + slack >= kth
            if np.count_nonzero(alive) < 0.75 * len(at):  # compact when that saves work
                at, partial_scores = at[alive], partial_scores[alive]
                columns, rest = columns[:, alive], rest[:, alive]
        partial_scores = partial_scores + query[start : start + step] @ columns[start : start + step]
    return at, partial_scores


def search_cell(_key: tuple, queries: pa.Table, candidates: pa.Table, k: int, step: int) -> pa.Table:
    if not queries.num_rows or not candidates.num_rows:
        return SCORED_ARROW.empty_table()
    width = max(
        1,
        pa.compute.max(pa.compute.list_value_length(queries.column("vector"))).as_py(),
        pa.compute.max(pa.compute.list_value_length(candidates.column("vector"))).as_py(),
    )
    q, c = _matrix(queries.column("vector"), width), _matrix(candidates.column("vector"), width)
    query_ids, keys = queries.column("vec_id").to_numpy(), queries.column("key").to_numpy()
    ids = candidates.column("vec_id").to_numpy()
    out: list[list[np.ndarray]] = [[], [], [], []]
    exact = width * (float(abs(q.astype(float)).max()) + 1) * (float(abs(c.astype(float)).max()) + 1) < EXACT
    if exact:
        columns = np.ascontiguousarray(c.T, dtype=np.float64)
        squares = np.cumsum((columns**2)[::-1], axis=0)[::-1]
        rest = np.sqrt(squares[step::step])
        vectors = q.astype(np.float64)
        first = vectors[:, :step] @ columns[:step]
    for i, (query_id, key) in enumerate(zip(query_ids, keys, strict=True)):
        others = np.flatnonzero(ids != query_id)
        if exact:
            at, scores = branch_and_bound(vectors[i], others, first[i], columns, rest, k, step)
            scores = scores.astype(np.int64)
        else:  # too large for doubles: whole numbers of any size, held to the range of a long
            at = others
            whole = c[at].astype(object) @ q[i].astype(object)
            scores = np.array([min(max(s, -(1 << 63) + 1), (1 << 63) - 1) for s in whole], np.int64)
        top = _best(scores, ids[at], k)
        for column, values in zip(
            out, (np.full(len(top), query_id), np.full(len(top), key), ids[at[top]], scores[top]), strict=True
        ):
            column.append(values)
    return pa.table([np.concatenate(column) for column in out], schema=SCORED_ARROW)


def quantised(vector: Column, scale: float = 1024.0) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def _usable(vector: Column) -> Column:
    def finite(x: Column) -> Column:
        x = x.cast("double")
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    return vector.isNotNull() & F.forall(vector, finite)


def top_k(
    vectors: DataFrame,
    is_query: Callable[[Column], Column],
    k: int = 10,
    step: int = 16,
    cell_candidates: int = 16384,
    cell_queries: int = 2048,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query.

    ``vectors(vec_id, embedding)``; components become floor(1024 * x). Every row but those
    with the query's own vec_id is a candidate; ties go to the smaller vec_id. Rows without
    vec_id, and vectors that are null or hold null or non-finite components, take no part;
    of vectors of unequal length the shorter counts as filled up with zeros. Repeated rows are
    candidates each; a repeated query counts once. Other columns are ignored; an empty table
    gives an empty result. A cell holds at most about ``cell_candidates`` x ``cell_queries``.
    """
    used = vectors.where(F.col("vec_id").isNotNull() & _usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long"), quantised(F.col("embedding")).alias("vector")
    )
    asked = used.where(is_query(F.col("vec_id"))).dropDuplicates().withColumn("key", F.xxhash64("vector"))
    n = used.agg(F.count("*").alias("n"), F.count_if(is_query(F.col("vec_id"))).alias("q")).first()
    # at least about 64 cells, so that a small table is spread as well
    down = max(1, -(-n["n"] // min(cell_candidates, max(256, -(-n["n"] // 64)))))
    across = max(1, -(-n["q"] // cell_queries))
    row, column = F.xxhash64(F.lit("row"), "vec_id", "vector"), F.xxhash64(F.lit("column"), "vec_id", "vector")
    candidates = used.withColumns(
        {"down": F.pmod(row, F.lit(down)).cast("int"), "across": F.explode(F.sequence(F.lit(0), F.lit(across - 1)))}
    )
    queries = asked.withColumns(
        {"across": F.pmod(column, F.lit(across)).cast("int"), "down": F.explode(F.sequence(F.lit(0), F.lit(down - 1)))}
    )
    scored = (
        queries.groupBy("down", "across")
        .cogroup(candidates.groupBy("down", "across"))
        .applyInArrow(partial(search_cell, k=k, step=step), SCORED)
    )
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
