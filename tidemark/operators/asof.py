"""As-of joins: attach the last (or next) row of another series.

``asof_join`` works on (key, time bucket) groups with a carried row per bucket, so
one hot key spreads over as many tasks as it has buckets and each input row is
shuffled once. See :mod:`tidemark.operators.scan` for the idea.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.borders import MOST_ROWS, row_buckets, salt_of
from tidemark.operators.scan import bucket_start, micros

FIRST = -(1 << 62)  # before any time


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    on: Sequence[str] = (),
    left_ts: str,
    right_ts: str,
    direction: str = "backward",
    tolerance: float | None = None,
    tie: Sequence[str] = (),
    right_cols: Sequence[str] | None = None,
    prefix: str = "",
    match_ts: str | None = None,
    allow_exact: bool = True,
    bucket_seconds: int | None = None,
    most_rows: int = MOST_ROWS,
) -> DataFrame:
    """Left join each left row with one right row of the same key.

    ``backward`` takes the last right row with ``right_ts <= left_ts`` (the last by
    ``tie`` among equal times); ``forward`` the first with ``right_ts >= left_ts``.
    ``tolerance`` (seconds, inclusive) drops matches further away. Right columns come
    back as ``prefix + name``, the matched time as ``match_ts`` when named. A bucket holds
    about ``most_rows`` rows of both sides together, or, where ``bucket_seconds`` is given,
    the rows of that time.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction must be 'backward' or 'forward'")
    back = direction == "backward"
    keys = list(on)
    right_cols = list(
        right_cols if right_cols is not None else [c for c in right.columns if c not in keys and c != right_ts]
    )
    tol = None if tolerance is None else int(round(tolerance * 1_000_000))
    by_rows = bucket_seconds is None
    width = 0 if by_rows else max(bucket_seconds * 1_000_000, tol or 0)

    kcols = [f"__k{i}" for i in range(len(keys))]
    tcols = [f"__t{i}" for i in range(len(tie))]

    def directed(ts: str) -> Column:
        return micros(ts) if back else -micros(ts)

    payload = F.struct(micros(right_ts).alias("__ts"), *right_cols)
    rights = (
        right.dropna(subset=[right_ts, *keys])
        .select(
            *[F.col(k).alias(a) for k, a in zip(keys, kcols)],
            directed(right_ts).alias("__o"),
            *[F.col(t).alias(a) for t, a in zip(tie, tcols)],
            payload.alias("__r"),
        )
    )
    # left columns stay flat: the join keys double as the key columns
    rest = [c for c in left.columns if c not in keys]
    lcols = [f"__l{i}" for i in range(len(rest))]
    lefts = left.select(
        *[F.col(k).alias(a) for k, a in zip(keys, kcols)],
        directed(left_ts).alias("__o"),
        *[F.col(c).alias(a) for c, a in zip(rest, lcols)],
    )
    if by_rows:
        rights, lefts = _by_rows(rights, lefts, kcols, tcols, 1 if back == allow_exact else -1, back, most_rows)
    else:
        rights, lefts = (x.withColumn("__b", bucket_start(F.col("__o"), width)) for x in (rights, lefts))

    by = [*kcols, "__b"]
    # last right row of a bucket in walking direction
    if back:
        newest = F.max_by("__r", F.when(F.col("__r").isNotNull(), F.struct("__o", *tcols)))
    else:
        newest = F.min_by("__r", F.when(F.col("__r").isNotNull(), F.struct(-F.col("__o"), *tcols)))

    if tol is not None and not by_rows:
        # a bucket is at least as wide as the tolerance: only the previous one can reach in
        carry = (
            rights.groupBy(*by)
            .agg(newest.alias("__r"))
            .withColumn("__b", F.col("__b") + F.lit(width).cast("bigint"))
        )
    else:
        # one row per bucket on either side; a bucket's own right rows come after its question
        line = (
            Window.partitionBy(*(kcols or [F.lit(0)]))
            .orderBy("__b", "__kind")
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        asked = lefts.select(*by).distinct().withColumn("__kind", F.lit(0))
        known = rights.groupBy(*by).agg(newest.alias("__r")).withColumn("__kind", F.lit(1))
        carry = (
            asked.unionByName(known, allowMissingColumns=True)
            .select(*by, "__kind", F.last("__r", ignorenulls=True).over(line).alias("__r"))
            .where("__kind = 0 AND __r IS NOT NULL")
            .drop("__kind")
        )
    carry = carry.withColumn("__o", F.lit(FIRST) if by_rows else F.col("__b")).withColumn("__side", F.lit(-2))

    everything = (
        rights.withColumn("__side", F.lit(0))
        .unionByName(carry, allowMissingColumns=True)
        .unionByName(lefts.withColumn("__side", F.lit(1 if allow_exact else -1)), allowMissingColumns=True)
    )
    ties = [F.col(t).asc() if back else F.col(t).desc() for t in tcols]
    upto = (
        Window.partitionBy(*by)
        .orderBy("__o", "__side", *ties)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    mine = 1 if allow_exact else -1
    matched = everything.select(
        *kcols, *lcols, "__o", "__side", F.last("__r", ignorenulls=True).over(upto).alias("__m")
    ).where(F.col("__side") == mine)
    if tol is not None:
        gap = F.col("__o") - (F.col("__m.__ts") if back else -F.col("__m.__ts"))
        matched = matched.withColumn("__m", F.when(gap <= tol, F.col("__m")))

    named = dict(zip([*keys, *rest], [*kcols, *lcols]))
    out = [F.col(named[c]).alias(c) for c in left.columns]
    if match_ts:
        out.append(F.timestamp_micros(F.col("__m.__ts")).alias(match_ts))
    out += [F.col(f"__m.`{c}`").alias(f"{prefix}{c}") for c in right_cols]
    return matched.select(*out)


def _by_rows(
    rights: DataFrame, lefts: DataFrame, keys: Sequence[str], ties: Sequence[str], side: int, back: bool, most_rows: int
) -> list[DataFrame]:
    """Both sides with ``__b``, a bucket of about ``most_rows`` rows in walking order.

    Borders run forward in time: (time, right or left, ties); ``side`` says whether left rows
    come after (1) or before (-1) the right rows of their instant. Left rows of one instant
    may be parted anywhere, so a hash of the row parts them.
    """
    us = F.col("__o") if back else -F.col("__o")
    kinds = {t: rights.schema[t].dataType for t in ties}
    whole = F.struct(us.alias("us"), F.lit(0).alias("side"), *ties, F.lit(0).cast("bigint").alias("salt"))
    none = [F.lit(None).cast(kinds[t]).alias(t) for t in ties]
    row = F.struct(us.alias("us"), F.lit(side).alias("side"), *none, salt_of(lefts).alias("salt"))
    dealt = row_buckets(
        [rights.withColumn("__order", whole), lefts.withColumn("__order", row)], keys=keys, order="__order", most_rows=most_rows, name="__b"
    )
    return [x.withColumn("__b", F.col("__b") if back else -F.col("__b")).drop("__order") for x in dealt]


def asof_offsets(
    base: DataFrame,
    quotes: DataFrame,
    *,
    on: Sequence[str],
    id_cols: Sequence[str],
    base_ts: str,
    quote_ts: str,
    offsets_ms: Sequence[int],
    quote_cols: Sequence[str],
    tolerance: float | None = 1.0,
    tie: Sequence[str] = (),
    name: str = "quotes_at",
    bucket_seconds: int | None = None,
) -> DataFrame:
    """Forward lookups at ``base_ts + offset`` for several offsets in one as-of pass.

    Only (id, time, offset) is fanned out; the wide base rows are not. The result
    holds one map ``offset_ms -> struct(quote_ts, quote_cols…)`` per base row, with
    at most ``len(offsets_ms)`` entries, and no entry where nothing matched.
    ``id_cols`` must identify a base row and contain the join keys.
    """
    missing = [k for k in on if k not in id_cols]
    if missing:
        raise ValueError(f"id_cols must contain the join keys, missing {missing}")
    narrow = list(dict.fromkeys([*id_cols, base_ts]))
    lookups = base.select(
        *narrow,
        F.explode(F.array(*[F.lit(int(o)).cast("bigint") for o in sorted(set(offsets_ms))])).alias("__off"),
    ).withColumn("__due", F.timestamp_micros(micros(base_ts) + F.col("__off") * 1000))
    hit = asof_join(
        lookups,
        quotes,
        on=on,
        left_ts="__due",
        right_ts=quote_ts,
        direction="forward",
        tolerance=tolerance,
        tie=tie,
        right_cols=quote_cols,
        prefix="__q_",
        match_ts="__quote_ts",
        bucket_seconds=bucket_seconds,
    ).where(F.col("__quote_ts").isNotNull())
    entry = F.struct(
        F.col("__off").alias("key"),
        F.struct(
            F.col("__quote_ts").alias("quote_ts"),
            *[F.col(f"__q_{c}").alias(c) for c in quote_cols],
        ).alias("value"),
    )
    maps = hit.groupBy(*id_cols).agg(F.map_from_entries(F.collect_list(entry)).alias(name))
    return base.join(maps, list(id_cols), "left")


def nearest_join(
    left: DataFrame,
    right: DataFrame,
    *,
    on: Sequence[str],
    left_ts: str,
    right_ts: str,
    right_cols: Sequence[str],
    tie: Sequence[str] = (),
    match_ts: str = "nearest_ts",
    abs_ms: str = "abs_ms",
    bucket_seconds: int | None = None,
    most_rows: int = MOST_ROWS,
) -> DataFrame:
    """Right row with the smallest time distance (the earlier one when equal).

    One carried row from before and one from after enter each bucket, so the work is
    linear; a join on the key would build every pair of a hot key.
    """
    keys = list(on)
    kcols = [f"__k{i}" for i in range(len(keys))]
    tcols = [f"__t{i}" for i in range(len(tie))]
    by = [*kcols, "__b"]
    rights = (
        right.dropna(subset=[right_ts, *keys])
        .select(
            *[F.col(k).alias(a) for k, a in zip(keys, kcols)],
            micros(right_ts).alias("__o"),
            *[F.col(t).alias(a) for t, a in zip(tie, tcols)],
            F.struct(micros(right_ts).alias("__ts"), *right_cols).alias("__r"),
        )
    )
    lefts = left.select(
        *[F.col(k).alias(a) for k, a in zip(keys, kcols)],
        micros(left_ts).alias("__o"),
        F.struct(*left.columns).alias("__l"),
    )
    if bucket_seconds is None:
        rights, lefts = _by_rows(rights, lefts, kcols, tcols, 1, True, most_rows)
    else:
        rights, lefts = (x.withColumn("__b", bucket_start(F.col("__o"), bucket_seconds * 1_000_000)) for x in (rights, lefts))

    at = F.struct("__o", *tcols)
    part = Window.partitionBy(*(kcols or [F.lit(0)]))
    asked = lefts.select(*by).distinct().withColumn("__kind", F.lit(0))
    known = (
        rights.groupBy(*by)
        .agg(F.max_by("__r", at).alias("__last"), F.min_by("__r", at).alias("__first"))
        .withColumn("__kind", F.lit(1))
    )
    # walking either way, a bucket's own right rows come after its question
    forth = part.orderBy(F.col("__b"), "__kind").rowsBetween(Window.unboundedPreceding, 0)
    back_again = part.orderBy(F.col("__b").desc(), "__kind").rowsBetween(Window.unboundedPreceding, 0)
    ends = (
        asked.unionByName(known, allowMissingColumns=True)
        .select(
            *by,
            "__kind",
            F.last("__last", ignorenulls=True).over(forth).alias("__last"),
            F.last("__first", ignorenulls=True).over(back_again).alias("__first"),
        )
        .where("__kind = 0")
    )
    carried = ends.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.lit(FIRST).alias("o"), F.lit(-2).alias("side"), F.col("__last").alias("r")),
                F.struct(F.lit(-FIRST).alias("o"), F.lit(3).alias("side"), F.col("__first").alias("r")),
            )
        ).alias("__c"),
    ).select(*by, F.col("__c.o").alias("__o"), F.col("__c.side").alias("__side"), F.col("__c.r").alias("__r"))
    everything = (
        rights.withColumn("__side", F.lit(0))
        .unionByName(carried.where("__r IS NOT NULL"), allowMissingColumns=True)
        .unionByName(lefts.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    )
    # the second window walks backward: a frame to the end would be recomputed per row
    ahead = Window.partitionBy(*by).orderBy("__o", "__side", *tcols).rowsBetween(Window.unboundedPreceding, 0)
    behind = (
        Window.partitionBy(*by)
        .orderBy(F.col("__o").desc(), F.col("__side").desc(), *[F.col(t).desc() for t in tcols])
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    matched = everything.select(
        "__l",
        "__o",
        F.last("__r", ignorenulls=True).over(ahead).alias("__p"),
        F.last("__r", ignorenulls=True).over(behind).alias("__n"),
    ).where(F.col("__l").isNotNull())
    before = F.col("__o") - F.col("__p.__ts")
    after = F.col("__n.__ts") - F.col("__o")
    far = F.lit(2**62)
    matched = matched.withColumn(
        "__m", F.when(F.coalesce(before, far) <= F.coalesce(after, far), F.col("__p")).otherwise(F.col("__n"))
    )
    return matched.select(
        *[F.col(f"__l.`{c}`").alias(c) for c in left.columns],
        F.timestamp_micros(F.col("__m.__ts")).alias(match_ts),
        (F.abs(F.col("__o") - F.col("__m.__ts")) / 1000.0).alias(abs_ms),
        *[F.col(f"__m.`{c}`").alias(c) for c in right_cols],
    )
