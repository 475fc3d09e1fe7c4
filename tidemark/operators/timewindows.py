"""Aggregates over the last ``s`` seconds of each row, in work that does not grow with the window.

A range frame of Spark adds up its whole window again for every row, which is quadratic in the
rows of a dense key. Here time is cut into cells of ``s / CELLS`` seconds, and a window is

* the rows of its own cell up to the row's time: a running aggregate inside the cell,
* the ``CELLS - 1`` whole cells before: from one row per cell, in blocks of cells,
* the rows of the cell it begins in, from its begin on: a running aggregate backward.

Parts are merged (sums are added, moments by their pairwise rule) and nothing is taken away from
a sum, so no digits are lost. A task holds one cell at a time, also of a single hot key.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scan import bucket_start, micros
from tidemark.session import stage

CELLS = 64  # a window's; a second of microseconds can be divided by it
BLOCK = 4_096  # cells a task looks at together


def _moments(value: str, over: Callable[[Column], Column] = lambda c: c) -> Column:
    n = over(F.count(value))
    return F.struct(n.alias("n"), over(F.avg(value)).alias("m"), (over(F.var_pop(value)) * n).alias("d"))


def _merged(a: Column, b: Column) -> Column:
    """Count, mean and squared deviations of two runs together; either may be missing."""
    n, step = a["n"] + b["n"], b["m"] - a["m"]
    both = F.struct(
        n.alias("n"), (a["m"] + step * b["n"] / n).alias("m"), (a["d"] + b["d"] + step * step * a["n"] * b["n"] / n).alias("d")
    )
    return F.when(a.isNull() | (a["n"] == 0), b).when(b.isNull() | (b["n"] == 0), a).otherwise(both)


def _added(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)


def trailing(
    rows: DataFrame,
    *,
    keys: Sequence[str],
    ts: str,
    seconds: Sequence[int],
    sums: Mapping[str, Column] | None = None,
    deviations: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``rows`` with ``<name>_<s>s``: sums and sample deviations over the rows of the key in ``[t - s, t]``.

    All rows of the row's own instant belong to its window. Rows without a time are each
    other's window; null keys are a key. The rows are written once, as every part reads them.
    """
    named = [(n, e, False) for n, e in (sums or {}).items()] + [(n, e, True) for n, e in (deviations or {}).items()]
    specs = [(name, f"__v{i}", spread) for i, (name, _, spread) in enumerate(named)]
    held = stage(
        rows.select("*", micros(ts).alias("__us"), *[e.alias(v) for (_, e, _), (_, v, _) in zip(named, specs)]), "trailing_rows"
    )
    out = held
    for s in seconds:
        out = _one_length(out, held, list(keys), s, specs)
    return out.drop("__us", *[v for _, v, _ in specs])


def _part(spread: bool, value: str, over: Callable[[Column], Column] = lambda c: c) -> Column:
    return _moments(value, over) if spread else over(F.sum(value))


def _one_length(df: DataFrame, held: DataFrame, keys: list[str], s: int, specs: Sequence[tuple[str, str, bool]]) -> DataFrame:
    width = s * 1_000_000 // CELLS
    cell = bucket_start(F.col("__us"), width).alias("__c")
    plain = held.where("__us IS NOT NULL").select(*keys, "__us", cell, *[v for _, v, _ in specs])
    whole = plain.groupBy(*keys, "__c").agg(*[_part(spread, v).alias(f"{v}p") for _, v, spread in specs])
    between = _cells_between(whole, keys, width, specs)

    upto = Window.partitionBy(*keys, "__c").orderBy("__side", "__us").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = df.select("*", cell, F.lit(1).alias("__side")).unionByName(
        between.withColumn("__side", F.lit(0)), allowMissingColumns=True
    )
    own = both.select(
        *df.columns, "__c", "__side",
        *[_part(spread, v, lambda c: c.over(upto)).alias(f"{v}o") for _, v, spread in specs],
        *[F.last(f"{v}m", ignorenulls=True).over(upto).alias(f"{v}m") for _, v, _ in specs],
    ).where("__side = 1")
    asking = own.select(
        *df.columns, (F.col("__c") - CELLS * width).alias("__c"), "__side", (F.col("__us") - s * 1_000_000).alias("__at"),
        *[(_merged if spread else _added)(F.col(f"{v}m"), F.col(f"{v}o")).alias(f"{v}o") for _, v, spread in specs],
    )
    answers = plain.select(
        *keys, "__c", F.lit(0).alias("__side"), F.col("__us").alias("__at"), *[F.col(v).alias(f"{v}x") for _, v, _ in specs]
    )
    since = Window.partitionBy(*keys, "__c").orderBy(F.col("__at").desc(), "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = asking.unionByName(answers, allowMissingColumns=True).select(
        *df.columns, "__side", *[f"{v}o" for _, v, _ in specs],
        *[_part(spread, f"{v}x", lambda c: c.over(since)).alias(f"{v}h") for _, v, spread in specs],
    ).where("__side = 1")
    total = found.select(
        *df.columns, *[(_merged if spread else _added)(F.col(f"{v}h"), F.col(f"{v}o")).alias(f"{v}t") for _, v, spread in specs]
    )
    new = []
    for name, v, spread in specs:
        t = F.col(f"{v}t")
        new.append((F.when(t["n"] > 1, F.sqrt(t["d"] / (t["n"] - 1))) if spread else t).alias(f"{name}_{s}s"))
    return total.select(*df.columns, *new)


def _cells_between(whole: DataFrame, keys: list[str], width: int, specs: Sequence[tuple[str, str, bool]]) -> DataFrame:
    """For each cell, what the ``CELLS - 1`` cells before it hold together, as ``<value>m``."""
    reach = (CELLS - 1) * width
    c = F.col("__c")
    place = F.pmod(c, F.lit(BLOCK * width).cast("bigint"))
    after = F.when(place >= BLOCK * width - reach, F.struct((c - place + BLOCK * width).alias("b"), F.lit(False).alias("own")))
    copies = F.array_compact(F.array(F.struct((c - place).alias("b"), F.lit(True).alias("own")), after))
    spread_out = whole.select("*", F.inline(copies).alias("__b", "__own"))
    frame = Window.partitionBy(*keys, "__b").orderBy("__c").rangeBetween(-reach, -width)
    seen = spread_out.select(
        *keys, "__c", "__own",
        *[(F.collect_list if spread else F.sum)(f"{v}p").over(frame).alias(f"{v}m") for _, v, spread in specs],
    ).where("__own")
    return seen.select(
        *keys, "__c",
        *[
            (F.reduce(F.slice(f"{v}m", 2, CELLS), F.get(f"{v}m", F.lit(0)), _merged) if spread else F.col(f"{v}m")).alias(f"{v}m")
            for _, v, spread in specs
        ],
    )
