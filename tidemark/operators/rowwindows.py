"""Row-frame windows (lag, lead, rolling) that do not put one key into one task.

Rows carry an index (their position in the key). Blocks of ``block`` rows become
the window partitions; the rows a frame reaches back (or ahead) for are copied into
the neighbouring block as a halo and dropped afterwards. Blocks are cut by index, so
a halo never spans more than one block and the result equals the global window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def in_blocks(
    df: DataFrame,
    *,
    keys: Sequence[str],
    index: str,
    compute: Callable[[WindowSpec], dict[str, Column]],
    before: int = 0,
    after: int = 0,
    block: int = 4_096,
) -> DataFrame:
    """Add window columns over each key ordered by ``index``.

    ``compute`` receives the window specification (partition and order set) and
    returns the new columns; their frames may reach ``before`` rows back and
    ``after`` rows ahead, not further. ``index`` is 0, 1, 2 … within each key.
    """
    block = max(block, before, after, 1)
    own = F.floor(F.col(index) / block).cast("bigint")
    place = F.pmod(F.col(index), F.lit(block))
    copies = [F.struct(own.alias("blk"), F.lit(True).alias("own"))]
    if before:
        copies.append(
            F.when(place >= block - before, F.struct((own + 1).alias("blk"), F.lit(False).alias("own")))
        )
    if after:
        copies.append(F.when(place < after, F.struct((own - 1).alias("blk"), F.lit(False).alias("own"))))
    spread = df.select("*", F.explode(F.array_compact(F.array(*copies))).alias("__copy"))
    spread = spread.select(*df.columns, F.col("__copy.blk").alias("__blk"), F.col("__copy.own").alias("__own"))
    window = Window.partitionBy(*keys, "__blk").orderBy(index)
    new = compute(window)
    kept = [c for c in df.columns if c not in new]
    out = spread.select(*kept, "__own", *[expr.alias(name) for name, expr in new.items()])
    return out.where("__own").drop("__own")


def rolling(fn: Callable[[Column], Column], value: str | Column, rows: int, window: WindowSpec) -> Column:
    """Aggregate over the last ``rows`` rows; null until that many non-null values are there."""
    v = F.col(value) if isinstance(value, str) else value
    frame = window.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(v).over(frame) == rows, fn(v).over(frame))


def relative_change(value: str, rows: int, window: WindowSpec) -> Column:
    past = F.lag(value, rows).over(window)
    return F.when(past != 0, F.col(value) / past - 1.0)


def log_change(value: str, window: WindowSpec) -> Column:
    past = F.lag(value, 1).over(window)
    v = F.col(value)
    return F.when((v > 0) & (past > 0), F.ln(v) - F.ln(past))
