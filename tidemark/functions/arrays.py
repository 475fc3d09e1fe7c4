"""Order-book levels: ARRAY<STRUCT<price, size>> in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalars import imbalance


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sorted_levels(levels: str | Column, side: str, depth: int | None = 5) -> Column:
    """Best first (bids high to low, asks low to high); ties keep input order; no null prices."""
    sign = -1.0 if side == "bid" else 1.0
    numbered = F.transform(
        _col(levels),
        lambda x, i: F.struct((x.price * sign).alias("rank"), i.alias("pos"), x.price.alias("price"), x["size"].alias("size")),
    )
    priced = F.array_sort(F.filter(numbered, lambda x: x.price.isNotNull()))
    best = F.transform(priced, lambda x: F.struct(x.price.alias("price"), x["size"].alias("size")))
    return F.slice(best, 1, depth) if depth else best


def best_level(sorted_side: str | Column) -> Column:
    """First level of a sorted side (null for an empty side)."""
    return F.get(_col(sorted_side), F.lit(0))


def depth_sum(sorted_side: str | Column, n: int) -> Column:
    """Sum of the sizes of the top n levels; missing sizes are skipped; null for an empty side."""
    side = _col(sorted_side)
    total = F.aggregate(
        F.slice(side, 1, n), F.lit(0.0), lambda acc, x: acc + F.coalesce(x["size"], F.lit(0.0))
    )
    return F.when(F.size(side) > 0, total)


def wide_levels(levels: str | Column, prefix: str, n: int) -> dict[str, Column]:
    """``{prefix}_px_i`` and ``{prefix}_qty_i`` in input order, null where missing."""
    side = _col(levels)
    out: dict[str, Column] = {}
    for i in range(n):
        level = F.get(side, F.lit(i))
        out[f"{prefix}_px_{i + 1}"] = level.getField("price")
        out[f"{prefix}_qty_{i + 1}"] = level.getField("size")
    return out


def depth_metrics(bids: str | Column, asks: str | Column, n: int) -> dict[str, Column]:
    """Depth of both sides over n levels, and their imbalance."""
    b, a = depth_sum(bids, n), depth_sum(asks, n)
    return {f"bid_depth_{n}": b, f"ask_depth_{n}": a, f"depth_imbalance_{n}": imbalance(b, a)}


def take_price(
    levels: str | Column,
    side: str,
    shares: float | Column,
    *,
    fallback_price: Column | None = None,
    fallback_size: Column | None = None,
) -> Column:
    """Result of taking ``shares`` from a book side.

    STRUCT<avg_price, filled, full, worst_price>; avg and worst are null when nothing
    fills. Without levels the fallback quote is used (of unlimited size when its size
    is unknown).
    """
    want = F.lit(float(shares)) if isinstance(shares, (int, float)) else shares.cast("double")
    book = F.transform(
        sorted_levels(levels, side, None),
        lambda x: F.struct(x.price.alias("price"), F.greatest(F.coalesce(x["size"], F.lit(0.0)), F.lit(0.0)).alias("size")),
    )
    if fallback_price is not None:
        size = F.greatest(F.coalesce(fallback_size, want), F.lit(0.0)) if fallback_size is not None else want
        backup = F.when(
            fallback_price.isNotNull(),
            F.array(F.struct(fallback_price.cast("double").alias("price"), size.cast("double").alias("size"))),
        )
        book = F.when(F.size(book) > 0, book).otherwise(backup)
    zero = F.struct(
        F.lit(0.0).alias("filled"), F.lit(0.0).alias("notional"), F.lit(None).cast("double").alias("worst")
    )

    def step(acc: Column, level: Column) -> Column:
        take = F.greatest(F.least(want - acc.filled, level["size"]), F.lit(0.0))
        return F.struct(
            (acc.filled + take).alias("filled"),
            (acc.notional + take * level.price).alias("notional"),
            F.when(take > 1e-12, level.price).otherwise(acc.worst).alias("worst"),
        )

    def done(acc: Column) -> Column:
        some = acc.filled > 0
        return F.struct(
            F.when(some, acc.notional / F.when(some, acc.filled)).alias("avg_price"),
            acc.filled.alias("filled"),
            (some & (acc.filled + 1e-9 >= want)).alias("full"),
            acc.worst.alias("worst_price"),
        )

    none = F.array().cast("array<struct<price:double,size:double>>")
    return F.aggregate(F.coalesce(book, none), zero, step, done)


def side_ids(outcomes: str | Column, ids: str | Column, classify) -> dict[str, Column]:
    """Ids on the YES and NO side of zipped outcome / id arrays, and a length problem if any."""
    o, i = _col(outcomes), _col(ids)
    zipped = F.arrays_zip(o.alias("o"), i.alias("i"))

    def pick(side: str) -> Column:
        # arrays_zip pads the shorter array with nulls; those pairs name no id
        hit = F.filter(zipped, lambda z: (classify(z["o"]) == side) & z["i"].isNotNull())
        return F.array_sort(F.array_distinct(F.transform(hit, lambda z: z["i"])))

    mismatch = F.when(
        F.size(o) != F.size(i), F.concat(F.lit("length mismatch: "), F.size(o), F.lit(" vs "), F.size(i))
    )
    return {"yes_ids": pick("YES"), "no_ids": pick("NO"), "issue": mismatch}


def arg_max(values: str | Column) -> Column:
    """Zero-based position of the largest non-null value (the first one when equal)."""
    v = _col(values)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")
