"""Order-book results from level rows, for books too large to hold as one array."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.pick import top_per_group
from tidemark.operators.scan import prefix_scan


def best_levels(rows: DataFrame, *, keys: Sequence[str], price: str, size: str, tie: str, side: str, depth: int = 5) -> DataFrame:
    """The best ``depth`` levels of each book as one sorted array column ``levels``.

    Each salt of a book keeps its own best levels first, so only few reach the array.
    """
    few = top_per_group(
        rows.where(F.col(price).isNotNull()), keys=keys, score=price, tie=[tie], k=depth, descending=side == "bid"
    )
    level = F.struct("rank", F.col(price).alias("price"), F.col(size).alias("size"))
    packed = few.groupBy(*keys).agg(F.array_sort(F.collect_list(level)).alias("__l"))
    return packed.select(
        *keys, F.transform("__l", lambda x: F.struct(x.price.alias("price"), x["size"].alias("size"))).alias("levels")
    )


def sweep(
    rows: DataFrame, *, keys: Sequence[str], price: str, size: str, tie: str, side: str, shares: float,
    price_bucket: float,
) -> DataFrame:
    """Average and worst price, and filled size, for taking ``shares`` from each book.

    A level fills what the better levels left over: a running sum in price order,
    spread over price buckets of the given width.
    """
    sign = 1.0 if side == "ask" else -1.0
    book = rows.where(F.col(price).isNotNull()).select(
        *keys,
        (F.col(price) * sign).alias("__p"),
        F.greatest(F.coalesce(F.col(size), F.lit(0.0)), F.lit(0.0)).alias("__q"),
        F.col(tie).alias("__tie"),
    )
    walked = prefix_scan(
        book, keys=keys, bucket=F.floor(F.col("__p") / price_bucket).cast("bigint"), order=["__p", "__tie"],
        sums={"__upto": F.col("__q")},
    )
    take = F.least(F.col("__q"), F.greatest(F.lit(0.0), F.lit(float(shares)) - (F.col("__upto") - F.col("__q"))))
    taken = walked.withColumn("__take", take)
    got = F.sum("__take")
    return taken.groupBy(*keys).agg(
        (F.sum(F.col("__take") * F.col("__p") * sign) / F.when(got > 0, got)).alias("avg_price"),
        got.alias("filled"),
        (got + 1e-9 >= shares).alias("full"),
        (F.max(F.when(F.col("__take") > 1e-12, F.col("__p"))) * sign).alias("worst_price"),
    )
