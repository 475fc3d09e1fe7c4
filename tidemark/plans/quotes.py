"""Quote events to quote state, and quote state on a regular grid."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as fn
from tidemark.operators.asof import asof_join
from tidemark.operators.rowwindows import in_blocks
from tidemark.operators.scan import bucket_start, forward_fill, micros

QUOTE_EVENT = {
    "market_id": "string",
    "asset_id": "string",
    "ts_event": "timestamp",
    "ts_recv": "timestamp",
    "source": "string",
    "update_bid": "double",
    "update_ask": "double",
    "update_bid_size": "double",
    "update_ask_size": "double",
    "last_trade_price": "double",
    "event_type": "string",
    "source_file": "string",
}

_STATE = ["bid", "ask", "bid_size", "ask_size"]


def with_columns_present(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Add missing columns as typed nulls."""
    missing = {c: F.lit(None).cast(t) for c, t in schema.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def normalize_quote_events(snapshots: DataFrame | None, changes: DataFrame | None) -> DataFrame:
    """Book snapshots and price changes as one stream of quote updates.

    A trade price is kept as ``last_trade_price`` only; it never becomes a quote.
    """
    parts = []
    if snapshots is not None:
        snap = with_columns_present(
            snapshots,
            {**QUOTE_EVENT, "best_bid": "double", "best_ask": "double", "bid_size_1": "double", "ask_size_1": "double"},
        )
        parts.append(
            snap.select(
                F.col("market_id").cast("string"),
                F.col("asset_id").cast("string"),
                "ts_event",
                "ts_recv",
                F.lit("orderbook").alias("source"),
                fn.valid_price("best_bid").alias("update_bid"),
                fn.valid_price("best_ask").alias("update_ask"),
                F.col("bid_size_1").try_cast("double").alias("update_bid_size"),
                F.col("ask_size_1").try_cast("double").alias("update_ask_size"),
                F.lit(None).cast("double").alias("last_trade_price"),
                F.lit("orderbook").alias("event_type"),
                F.col("source_file").cast("string"),
            )
        )
    if changes is not None:
        chg = with_columns_present(
            changes, {**QUOTE_EVENT, "best_bid": "double", "best_ask": "double", "price": "double"}
        )
        parts.append(
            chg.select(
                F.col("market_id").cast("string"),
                F.col("asset_id").cast("string"),
                "ts_event",
                "ts_recv",
                F.lit("price_change").alias("source"),
                fn.valid_price("best_bid").alias("update_bid"),
                fn.valid_price("best_ask").alias("update_ask"),
                F.lit(None).cast("double").alias("update_bid_size"),
                F.lit(None).cast("double").alias("update_ask_size"),
                fn.valid_price("price").alias("last_trade_price"),
                F.col("event_type").cast("string"),
                F.col("source_file").cast("string"),
            )
        )
    if not parts:
        raise ValueError("give snapshots, changes or both")
    events = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return events.dropna(subset=["market_id", "asset_id", "ts_event"])


def _priority() -> Column:
    # a snapshot applies before a change of the same instant
    return F.when(F.col("source") == "orderbook", 0).otherwise(1)


def _event_order(trade: str = "last_trade_price") -> list[Column]:
    # total order among the events of one instant
    rest = F.struct(
        F.coalesce(F.col("update_bid"), F.lit(-1.0)).alias("bid"),
        F.coalesce(F.col("update_ask"), F.lit(-1.0)).alias("ask"),
        F.coalesce(F.col(trade), F.lit(-1.0)).alias("trade"),
        F.coalesce(F.col("source_file"), F.lit("")).alias("file"),
    )
    return [_priority(), F.coalesce(micros("ts_recv"), F.lit(0)), rest]


def _finish(df: DataFrame, prefix: str, bid: str, ask: str) -> DataFrame:
    b, a = F.col(bid), F.col(ask)
    return df.withColumns(
        {
            f"{prefix}mid": fn.mid_price(b, a),
            f"{prefix}spread": fn.spread(b, a),
            f"{prefix}crossed_quote": F.coalesce(b > a, F.lit(False)),
        }
    )


def asset_quote_state(events: DataFrame, *, bucket_seconds: int | None = 86_400) -> DataFrame:
    """State after each event of an asset: forward-filled sides, mid, spread, crossed flag."""
    moved = F.col("update_bid").isNotNull() | F.col("update_ask").isNotNull()
    filled = forward_fill(
        events.withColumn("__trade", F.col("last_trade_price")).drop("last_trade_price"),
        keys=["market_id", "asset_id"],
        ts="ts_event",
        tie=_event_order("__trade"),
        bucket_seconds=bucket_seconds,
        fills={
            "current_bid": F.col("update_bid"),
            "current_ask": F.col("update_ask"),
            "current_bid_size": F.col("update_bid_size"),
            "current_ask_size": F.col("update_ask_size"),
            "last_quote_update_ts": F.when(moved, F.col("ts_event")),
            "last_trade_price": F.col("__trade"),
        },
    )
    return _finish(filled, "", "current_bid", "current_ask").select(
        "market_id",
        "asset_id",
        "ts_event",
        "source",
        "current_bid",
        "current_ask",
        "current_bid_size",
        "current_ask_size",
        "mid",
        "spread",
        "crossed_quote",
        "last_quote_update_ts",
        "last_trade_price",
        _order_struct("__trade"),
    )


def _order_struct(trade: str = "last_trade_price") -> Column:
    parts = [*_event_order(trade), F.col("asset_id")]
    return F.struct(*[c.alias(f"o{i}") for i, c in enumerate(parts)]).alias("event_order")


def pair_quote_state(events: DataFrame, markets: DataFrame, *, bucket_seconds: int | None = 86_400) -> DataFrame:
    """State of both sides of a market after each event of either side.

    ``markets`` is the dimension (market_id, yes_asset_id, no_asset_id). Both sides
    are filled in one pass, so sampling the pair later is one as-of join.
    """
    dim = markets.select("market_id", "yes_asset_id", "no_asset_id")
    tagged = events.join(dim, "market_id").withColumn(
        "__side",
        F.when(F.col("asset_id") == F.col("yes_asset_id"), "yes").when(
            F.col("asset_id") == F.col("no_asset_id"), "no"
        ),
    )
    moved = F.col("update_bid").isNotNull() | F.col("update_ask").isNotNull()
    fills: dict[str, Column] = {}
    for side in ("yes", "no"):
        here = F.col("pair_side") == side
        for field in _STATE:
            fills[f"{side}_{field}"] = F.when(here, F.col(f"update_{field}"))
        fills[f"{side}_last_quote_update_ts"] = F.when(here & moved, F.col("ts_event"))
    filled = forward_fill(
        tagged.withColumnRenamed("__side", "pair_side"),
        keys=["market_id"],
        ts="ts_event",
        tie=[*_event_order(), F.col("asset_id")],
        bucket_seconds=bucket_seconds,
        fills=fills,
    )
    for side in ("yes", "no"):
        filled = _finish(filled, f"{side}_", f"{side}_bid", f"{side}_ask")
    return filled.select(
        "market_id",
        "ts_event",
        _order_struct(),
        *[
            f"{side}_{c}"
            for side in ("yes", "no")
            for c in (*_STATE, "mid", "spread", "crossed_quote", "last_quote_update_ts")
        ],
    )


def time_grid(
    spans: DataFrame,
    *,
    start: str,
    end: str,
    step_seconds: int = 1,
    ts: str = "sample_ts",
    index: str = "grid_idx",
    chunk: int = 3_600,
) -> DataFrame:
    """Regular samples from ``start`` to ``end`` inclusive for each row of ``spans``.

    Samples are produced in chunks that are spread over the tasks first, so one long
    span does not unroll inside one task.
    """
    step = step_seconds * 1_000_000
    n = F.floor((micros(end) - micros(start)) / step).cast("bigint")
    chunks = (
        spans.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))
        .withColumn("__n", n)
        .select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n"), F.lit(chunk).cast("bigint"))).alias("__c"))
    )
    rows = chunks.repartition(F.col("__c"), *[F.col(c) for c in spans.columns]).select(
        *spans.columns,
        F.explode(
            F.sequence(F.col("__c"), F.least(F.col("__n"), F.col("__c") + (chunk - 1)))
        ).alias(index),
    )
    return rows.withColumn(ts, F.timestamp_micros(micros(start) + F.col(index) * step))


def state_on_grid(
    grid: DataFrame,
    state: DataFrame,
    *,
    ttl_seconds: float,
    ts: str = "sample_ts",
    keys: tuple[str, ...] = ("market_id", "asset_id"),
    bucket_seconds: int = 86_400,
) -> DataFrame:
    """Backward as-of of asset state onto a grid with quote age and stale flag."""
    joined = asof_join(
        grid,
        state,
        on=keys,
        left_ts=ts,
        right_ts="ts_event",
        tie=["event_order"],
        right_cols=list(STATE_COLUMNS),
        bucket_seconds=bucket_seconds,
    )
    return with_freshness(joined, ts=ts, ttl_seconds=ttl_seconds)


STATE_COLUMNS = (
    "current_bid", "current_ask", "current_bid_size", "current_ask_size", "mid", "spread", "crossed_quote", "last_quote_update_ts",
)


def state_on_spans(
    spans: DataFrame, state: DataFrame, *, start: str, end: str, step_seconds: int, ttl_seconds: float, ts: str = "sample_ts",
    keys: tuple[str, ...] = ("market_id", "asset_id"), bucket_seconds: int = 86_400,
) -> DataFrame:
    """``state_on_grid`` over the regular grid of each span, without building the grid first.

    A state holds until the next one of its asset, so each state row produces the samples of
    its own interval; what lies before the first state comes from a row without values. Only
    state rows are shuffled and sorted, by (asset, bucket of time); a bucket learns from the
    buckets' first times when the next one begins.
    """
    step, width = step_seconds * 1_000_000, bucket_seconds * 1_000_000
    names = list(keys)
    wanted = spans.where(F.col(start) <= F.col(end)).select(*names, micros(start).alias("__s"), micros(end).alias("__e"))
    known = state.select(*names, micros("ts_event").alias("__us"), "event_order", F.struct(*STATE_COLUMNS).alias("__v"))
    nothing = wanted.select(names).distinct().withColumns(
        {"__us": F.lit(-(1 << 62)), "event_order": F.lit(None).cast(known.schema["event_order"].dataType), "__v": F.lit(None).cast(known.schema["__v"].dataType)}
    )
    rows = known.where(F.col("__us").isNotNull()).unionByName(nothing).withColumn("__b", bucket_start(F.col("__us"), width))
    inside = Window.partitionBy(*names, "__b").orderBy("__us", "event_order")
    firsts = rows.groupBy(*names, "__b").agg(F.min("__us").alias("__f"))
    after = firsts.withColumn("__after", F.lead("__f").over(Window.partitionBy(*names).orderBy("__b"))).drop("__f")
    held = rows.withColumn("__next", F.lead("__us").over(inside)).join(after, [*names, "__b"]).withColumn("__next", F.coalesce("__next", "__after"))
    # samples start + i * step with this state: from its time on, up to before the next one
    def at(us: Column) -> Column:
        return F.ceil((us - F.col("__s")) / step)

    lo = F.when(F.col("__us") <= F.col("__s"), F.lit(0)).otherwise(at(F.col("__us")))
    last = F.floor((F.col("__e") - F.col("__s")) / step)
    hi = F.when(F.col("__next").isNull(), last).otherwise(F.least(last, at(F.col("__next")) - 1))
    found = held.join(wanted, names).withColumns({"__lo": lo.cast("bigint"), "__hi": hi.cast("bigint")}).where("__lo <= __hi")
    samples = found.select(*names, "__v", "__s", F.explode(F.sequence("__lo", "__hi")).alias("__i")).select(
        *names, F.timestamp_micros(F.col("__s") + F.col("__i") * step).alias(ts), *[F.col(f"__v.{c}").alias(c) for c in STATE_COLUMNS]
    )
    return with_freshness(samples, ts=ts, ttl_seconds=ttl_seconds)


def with_freshness(joined: DataFrame, *, ts: str, ttl_seconds: float) -> DataFrame:
    age = fn.seconds_between(ts, "last_quote_update_ts")
    return joined.withColumns(
        {
            "quote_age_seconds": age,
            "depth_imbalance_1": fn.imbalance("current_bid_size", "current_ask_size"),
            "crossed_quote": F.coalesce("crossed_quote", F.lit(False)),
            "is_stale": is_stale("current_bid", "current_ask", "last_quote_update_ts", age, ttl_seconds),
        }
    )


def is_stale(bid: str, ask: str, updated: str, age: Column, ttl_seconds: float) -> Column:
    """A side is stale when a quote is missing, was never set, or is older than the limit."""
    return F.col(bid).isNull() | F.col(ask).isNull() | F.col(updated).isNull() | (age > ttl_seconds)


def market_silver(
    markets: DataFrame,
    events: DataFrame,
    *,
    ttl_seconds: float = 5,
    step_seconds: int = 1,
    short_lag: int = 1,
    long_lag: int = 5,
    bucket_seconds: int = 86_400,
    stage: Callable[[DataFrame, str], DataFrame] | None = None,
) -> DataFrame:
    """Both sides of every mapped market on a regular grid from its start to its end.

    ``stage`` may write the quote state (see :func:`tidemark.session.stage`), which the
    as-of join reads twice.
    """
    dim = markets.where("mapping_status = 'ok'").select(
        "market_id", "yes_asset_id", "no_asset_id", "mapping_status", "market_start_ts", "market_end_ts"
    )
    grid = time_grid(dim, start="market_start_ts", end="market_end_ts", step_seconds=step_seconds)
    state = pair_quote_state(events, dim, bucket_seconds=bucket_seconds)
    if stage:
        state = stage(state, "quote_state")
    sampled = asof_join(
        grid,
        state,
        on=["market_id"],
        left_ts="sample_ts",
        right_ts="ts_event",
        tie=["event_order"],
        match_ts="last_market_update_ts",
        bucket_seconds=bucket_seconds,
    ).drop("event_order")
    derived: dict[str, Column] = {}
    for side in ("yes", "no"):
        age = fn.seconds_between("sample_ts", f"{side}_last_quote_update_ts")
        derived[f"{side}_quote_age_seconds"] = age
        derived[f"{side}_size_imbalance_1"] = fn.imbalance(f"{side}_bid_size", f"{side}_ask_size")
        derived[f"{side}_is_stale"] = is_stale(
            f"{side}_bid", f"{side}_ask", f"{side}_last_quote_update_ts", age, ttl_seconds
        )
        derived[f"{side}_crossed_quote"] = F.coalesce(f"{side}_crossed_quote", F.lit(False))
    derived |= {
        "seconds_since_last_update": fn.seconds_between("sample_ts", "last_market_update_ts"),
        "pair_bid_sum": F.col("yes_bid") + F.col("no_bid"),
        "pair_ask_sum": F.col("yes_ask") + F.col("no_ask"),
        "pair_mid_sum": F.col("yes_mid") + F.col("no_mid"),
        "time_elapsed_seconds": fn.seconds_between("sample_ts", "market_start_ts"),
        "time_to_expiry_seconds": fn.seconds_between("market_end_ts", "sample_ts"),
        "quote_state_available": F.col("yes_last_quote_update_ts").isNotNull()
        & F.col("no_last_quote_update_ts").isNotNull(),
        "date": F.date_format("sample_ts", "yyyy-MM-dd"),
    }
    full = sampled.withColumns(derived)
    return in_blocks(
        full,
        keys=["market_id"],
        index="grid_idx",
        before=long_lag,
        compute=lambda w: {
            "yes_mid_change_1_past": F.col("yes_mid") - F.lag("yes_mid", short_lag).over(w),
            "yes_mid_change_5_past": F.col("yes_mid") - F.lag("yes_mid", long_lag).over(w),
            "no_mid_change_1_past": F.col("no_mid") - F.lag("no_mid", short_lag).over(w),
            "no_mid_change_5_past": F.col("no_mid") - F.lag("no_mid", long_lag).over(w),
        },
    )


def add_quote_derived(df: DataFrame) -> DataFrame:
    """Pair sums, complements and differences, added where their inputs exist."""
    have = set(df.columns)
    pairs = {
        "pair_bid_sum": ("yes_bid", "no_bid", 1),
        "pair_ask_sum": ("yes_ask", "no_ask", 1),
        "pair_mid_sum": ("yes_mid", "no_mid", 1),
        "yes_bid_vs_no_ask_complement": ("yes_bid", "no_ask", 1),
        "yes_ask_vs_no_bid_complement": ("yes_ask", "no_bid", 1),
        "yes_bid_minus_no_bid": ("yes_bid", "no_bid", -1),
        "yes_ask_minus_no_ask": ("yes_ask", "no_ask", -1),
        "yes_mid_minus_no_mid": ("yes_mid", "no_mid", -1),
    }
    new = {
        name: F.col(a) + F.col(b) * sign
        for name, (a, b, sign) in pairs.items()
        if {a, b} <= have and (name not in have)
    }
    return df.withColumns(new) if new else df
