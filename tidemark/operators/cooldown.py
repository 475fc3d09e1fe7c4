"""Greedy thinning: keep a row only when enough time has passed since the last kept row.

The rule is sequential, but it can be cut. The instants of a key are cut into blocks bounded by
rows. What a block needs from the past is one number: the earliest time at which a row may be
kept again. For every possible such number the block's own outcome is a step function, and
different starts soon keep the same rows, so

1. each (key, block) is reduced to its steps (entry, time free again), all blocks in parallel,
2. one forward as-of join links each step to the step of a later block that it leads into,
3. the links are doubled (one block, two, four, ...) and the steps reached from a key's first
   are marked on the way, so a key of many blocks costs the logarithm of their number in joins,
4. each block, told its own start, is sorted once and walked in Arrow batches that hold the
   rows of many blocks; what a block needs from the batch before is one number.

Steps and links are rows: no array holds more than one block's instants, also where a key has
more instants in one cooldown than a task could hold. Keys of one block have only step 4.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.asof import asof_join
from tidemark.operators.borders import border_table, dealt
from tidemark.operators.scan import bucket_start, micros
from tidemark.session import stage

# the small functions below travel with the job, also where the package is not installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NEVER = np.iinfo(np.int64).min
TIMES = T.ArrayType(T.LongType())
MOST_INSTANTS = 1 << 17  # of one block, about
AXIS = 1 << 62


class _Batch:
    """The sorted instants of many blocks laid end to end on one axis.

    Blocks are shifted apart by more than any wait, so one binary search serves all.
    """

    def __init__(self, times: np.ndarray, lengths: np.ndarray, wait: np.ndarray) -> None:
        self.times, self.n, self.wait = times, len(lengths), wait
        self.ends = np.cumsum(lengths)
        self.begins = self.ends - lengths
        self.first = self.times[self.begins]
        self.owner = np.repeat(np.arange(self.n), lengths)
        inside = self.times - self.first[self.owner]
        self.gap = _gap(self.first, times[self.ends - 1], wait)
        self.axis = inside + self.owner * self.gap
        # first instant of the same block that may follow; the block's end if none
        self.following = np.searchsorted(self.axis, self.axis + self.wait[self.owner], side="left")

    def first_at(self, offset: np.ndarray) -> np.ndarray:
        """First instant of each block at or after an offset from the block's first."""
        bounded = np.clip(offset, 0, self.gap - 1)
        return np.searchsorted(self.axis, bounded + np.arange(self.n) * self.gap, side="left")

    def jumps(self) -> Iterator[np.ndarray]:
        """Where 1, 2, 4, ... followings lead, until all have left their block; the last place is outside."""
        outside = len(self.times)
        jump = np.append(np.where(self.following < self.ends[self.owner], self.following, outside), outside)
        while (jump < outside).any():
            yield jump
            jump = jump[jump]

    def split(self, values: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        return np.split(values, np.cumsum(counts)[:-1])


def _gap(first: np.ndarray, last: np.ndarray, wait: np.ndarray) -> int:
    return int((last - first).max()) + 2 * int(wait.max()) + 1


def _pieces(times: np.ndarray, lengths: np.ndarray, wait: np.ndarray) -> Iterator[tuple[slice, _Batch]]:
    """Runs of blocks whose common axis fits in 64 bits."""
    if len(lengths):
        ends = np.cumsum(lengths)
        size = max(1, AXIS // _gap(times[ends - lengths], times[ends - 1], wait))
        for at in range(0, len(lengths), size):
            here = slice(at, at + size)
            n = lengths[here]
            begin = int(ends[at] - lengths[at])
            yield here, _Batch(times[begin : begin + int(n.sum())], n, wait[here])


def _steps(x: _Batch) -> list[np.ndarray]:
    # an entry lies at most one wait behind the block's first instant: only the instants up
    # to there, and the next one, can be the first one kept
    last = np.minimum(x.first_at(x.wait), x.ends - 1)
    first = np.flatnonzero(np.arange(len(x.times)) <= last[x.owner])
    own, at, outside = x.owner[first], first.copy(), len(x.times)
    for jump in reversed(list(x.jumps())):
        at = np.where(jump[at] < outside, jump[at], at)
    free = x.times[at] + x.wait[own]
    # neighbouring entries with the same outcome are one step: keep the last of a run
    close = np.append((own[1:] != own[:-1]) | (free[1:] != free[:-1]), True)
    pairs = np.column_stack([x.times[first][close], free[close]]).ravel()
    return x.split(pairs, 2 * np.bincount(own[close], minlength=x.n))


def _kept(x: _Batch, start: np.ndarray) -> np.ndarray:
    """Which rows are kept when nothing before its start may be kept in a block; of one instant the first row."""
    begin = np.maximum(start, x.first)  # NEVER is before any first
    at = x.first_at(begin - x.first)
    reached = np.zeros(len(x.times) + 1, dtype=bool)
    reached[at[at < x.ends]] = True
    for jump in x.jumps():
        reached[jump[np.flatnonzero(reached[:-1])]] = True
    return reached[:-1]


@F.pandas_udf(TIMES)
def _block_steps(ts: pd.Series, wait: pd.Series) -> pd.Series:
    """Steps of each block as one flat array: entry, free, entry, free, …"""
    lengths = np.fromiter((len(t) for t in ts), np.int64, count=len(ts))
    times = np.concatenate([np.asarray(t, dtype=np.int64) for t in ts]) if len(ts) else np.empty(0, np.int64)
    return pd.Series([a for _, x in _pieces(times, lengths, wait.to_numpy(np.int64)) for a in _steps(x)], dtype=object)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows kept of sorted blocks; ``__first`` marks where a block begins, which may go on in the next batch."""
    free = NEVER
    for batch in batches:
        if not batch.num_rows:
            continue
        us, wait, start, first = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__us", "__wait", "__start", "__first"))
        begins = np.flatnonzero(first)
        if not first[0]:
            begins = np.append(0, begins)
        lengths = np.diff(np.append(begins, len(us)))
        begun, waits = np.array(start[begins]), wait[begins]
        if not first[0]:
            begun[0] = free
        kept = np.concatenate([_kept(x, begun[here]) for here, x in _pieces(us, lengths, waits)])
        own = np.flatnonzero(kept[begins[-1] :])
        free = us[begins[-1] + own[-1]] + waits[-1] if len(own) else begun[-1]
        yield batch.filter(pa.array(kept)).select([c for c in batch.schema.names if c not in ("__us", "__wait", "__start", "__first")])


def _step_rows(blocks: DataFrame) -> DataFrame:
    """The steps of blocks as written rows ``__g``, ``__b``, ``__e``, ``__f``."""
    flat = blocks.select("__g", "__b", _block_steps("__ts", "__wait").alias("__s"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.size("__s") - 2, F.lit(2)),
        lambda i: F.struct(F.get("__s", i).alias("e"), F.get("__s", i + 1).alias("f")),
    )
    steps = flat.select("__g", "__b", F.explode(pairs).alias("__p"))
    return stage(steps.select("__g", "__b", F.col("__p.e").alias("__e"), F.col("__p.f").alias("__f")), "cooldown_steps")


def _starts(steps: DataFrame, most_rows: int) -> DataFrame:
    """When a block that keeps anything is entered: ``__g``, ``__b``, ``__start`` (never before a key's first).

    ``steps`` is a written table of ``__g``, ``__b``, ``__e`` (entry) and ``__f`` (free again).
    """
    linked = asof_join(
        steps.withColumn("__ft", F.timestamp_micros("__f")),
        steps.select("__g", F.timestamp_micros("__e").alias("__et"), F.col("__e").alias("__j"), F.col("__b").alias("__jb")),
        on=["__g"], left_ts="__ft", right_ts="__et", direction="forward", right_cols=["__j", "__jb"], most_rows=most_rows,
    )
    links = stage(linked.where("__j IS NOT NULL").select("__g", "__e", "__f", "__j", "__jb"), "cooldown_links")
    reached = steps.groupBy("__g").agg(F.min("__e").alias("__e"))
    jump = links.select("__g", "__e", "__j")
    while not jump.isEmpty():
        further = reached.join(jump, ["__g", "__e"]).select("__g", F.col("__j").alias("__e"))
        reached = stage(reached.unionByName(further), "cooldown_reached")
        onward = jump.select("__g", F.col("__e").alias("__j"), F.col("__j").alias("__jj"))
        doubled = jump.join(onward, ["__g", "__j"]).select("__g", "__e", F.col("__jj").alias("__j"))
        jump = stage(doubled, "cooldown_jumps")
    taken = links.join(reached, ["__g", "__e"], "left_semi")
    roots = steps.groupBy("__g").agg(F.min("__b").alias("__b"), F.lit(NEVER).alias("__start"))
    return roots.unionByName(taken.select("__g", F.col("__jb").alias("__b"), F.col("__f").alias("__start")))


def cooldown_thin(
    df: DataFrame,
    *,
    keys: Sequence[str],
    ts: str,
    tie: str,
    seconds: str | float,
    block_seconds: int | None = None,
    most_rows: int = MOST_INSTANTS,
) -> DataFrame:
    """Rows kept by the greedy cooldown of each key, in (ts, tie) order.

    ``seconds`` is a number, or the name of a column that is constant within a key. Of rows
    with the same time only the first by ``tie`` can be kept while the cooldown is positive; a
    cooldown of 0 keeps all. Rows without a time, or with a null cooldown, are not kept; null
    keys are a key. A block holds about ``most_rows`` instants of a key or, where
    ``block_seconds`` is given, those of that time. Blocks may be shorter than the cooldown.
    """
    fixed = isinstance(seconds, (int, float))
    if fixed and seconds <= 0:
        return df
    wait = (
        F.lit(int(round(float(seconds) * 1e6))).cast("bigint")
        if fixed
        else F.round(F.col(seconds) * 1_000_000).cast("bigint")
    )
    group = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]) if keys else F.struct(F.lit(0).alias("k0"))
    timed = df.withColumns({"__g": group, "__us": micros(ts), "__wait": wait}).where("__wait > 0 AND __us IS NOT NULL")
    if block_seconds is None:
        ordered = timed.withColumn("__o", F.struct("__us"))
        at = {"keys": ["__g"], "order": "__o"}
        cuts = border_table([ordered], **at, most_rows=most_rows)
        if cuts.isEmpty():
            begun = timed.withColumns({"__b": F.lit(0).cast("bigint"), "__start": F.lit(NEVER)})
        else:
            (placed,) = dealt([ordered], cuts, **at, name="__b", split="__cut")
            begun = _begun(placed.drop("__o"), most_rows)
    else:
        begun = _begun(timed.withColumns({"__b": bucket_start(F.col("__us"), block_seconds * 1_000_000), "__cut": F.lit(True)}), most_rows)
    block = Window.partitionBy(*keys, "__b").orderBy("__us", tie)
    marked = begun.select(*df.columns, "__us", "__wait", "__start", (F.row_number().over(block) == 1).alias("__first"))
    out = marked.mapInArrow(_walked, df.schema)
    # a cooldown of zero keeps every row, also several of one instant
    return out if fixed else out.unionByName(df.where(F.col(seconds) <= 0))


def _begun(placed: DataFrame, most_rows: int) -> DataFrame:
    """Rows with the ``__start`` of their block; a block of a cut key that no step leads into keeps nothing."""
    instants = placed.where("__cut").groupBy("__g", "__b", "__us").agg(F.max("__wait").alias("__wait"))
    blocks = instants.groupBy("__g", "__b").agg(F.array_sort(F.collect_list("__us")).alias("__ts"), F.max("__wait").alias("__wait"))
    starts = _starts(_step_rows(blocks), most_rows)
    joined = placed.join(starts, ["__g", "__b"], "left")
    return joined.withColumn("__start", F.coalesce("__start", F.when(~F.col("__cut"), F.lit(NEVER)))).where("__start IS NOT NULL")
