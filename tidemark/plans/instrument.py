"""Instrument series on a regular grid: quotes, flows, returns, volatility, direction labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as fn
from tidemark.operators.asof import asof_join
from tidemark.operators.rowwindows import in_blocks, log_change, relative_change, rolling
from tidemark.operators.scan import row_index, time_bucket, micros
from tidemark.operators.timewindows import trailing
from tidemark.plans.quotes import time_grid


def flow_per_step(trades: DataFrame, *, keys: Sequence[str] = ("symbol",), step_seconds: int = 1) -> DataFrame:
    """Signed flow per key and step: buy, sell and total quantity, number of trades."""
    buy = F.when(F.col("side") == "buy_aggressor", F.col("qty")).otherwise(0.0)
    sell = F.when(F.col("side") == "sell_aggressor", F.col("qty")).otherwise(0.0)
    return trades.groupBy(*keys, fn.floor_seconds("ts_event", step_seconds).alias("sample_ts")).agg(
        F.sum(buy).alias("buy_volume"),
        F.sum(sell).alias("sell_volume"),
        F.sum("qty").alias("total_volume"),
        F.count("*").alias("trade_count"),
    )


def flow_columns(window, width: int) -> dict[str, Column]:
    """Rolling flows over ``width`` steps; null until the window is full."""
    buy = rolling(F.sum, "buy_volume", width, window)
    sell = rolling(F.sum, "sell_volume", width, window)
    total = rolling(F.sum, "total_volume", width, window)
    return {
        f"buy_volume_{width}": buy,
        f"sell_volume_{width}": sell,
        f"net_volume_{width}": buy - sell,
        f"total_volume_{width}": total,
        f"trade_count_{width}": rolling(F.sum, "trade_count", width, window),
        f"trade_imbalance_{width}": F.when(total > 0, (buy - sell) / total),
    }


def instrument_silver(
    quotes: DataFrame,
    trades: DataFrame,
    depth: DataFrame | None = None,
    *,
    step_seconds: int = 1,
    flow_windows: Sequence[int] = (1, 5, 30),
    return_steps: Sequence[int] = (1, 5, 10, 30),
    vol_windows: Sequence[int] = (10, 30, 60),
    bucket_seconds: int = 3_600,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Every symbol on its own grid with last quote, flows, returns and realised volatility.

    ``quotes`` needs ts_event, symbol, bid / ask price and quantity. Rolling windows
    and lags run in blocks of the grid index, so one symbol uses many tasks.
    """
    spans = quotes.groupBy("symbol").agg(
        F.min("ts_event").alias("__from"), F.max("ts_event").alias("__to")
    ).select(
        "symbol",
        fn.floor_seconds("__from", step_seconds).alias("__from"),
        fn.floor_seconds("__to", step_seconds).alias("__to"),
    )
    grid = time_grid(spans, start="__from", end="__to", step_seconds=step_seconds).drop("__from", "__to")
    priced = quotes.select(
        "symbol", "ts_event", *tie, "bid_price", "ask_price", "bid_qty", "ask_qty",
        fn.mid_price("bid_price", "ask_price").alias("mid_price"),
        fn.spread("bid_price", "ask_price").alias("spread"),
        fn.microprice("bid_price", "ask_price", "bid_qty", "ask_qty").alias("microprice"),
    )
    on_grid = asof_join(
        grid, priced, on=["symbol"], left_ts="sample_ts", right_ts="ts_event", tie=tie,
        right_cols=["bid_price", "ask_price", "bid_qty", "ask_qty", "mid_price", "spread", "microprice"],
        bucket_seconds=bucket_seconds,
    )
    if depth is not None:
        on_grid = asof_join(
            on_grid, depth, on=["symbol"], left_ts="sample_ts", right_ts="ts_event",
            right_cols=["bid_depth_5", "ask_depth_5", "depth_imbalance_5"], bucket_seconds=bucket_seconds,
        )
    flows = flow_per_step(trades, step_seconds=step_seconds)
    joined = on_grid.join(flows, ["symbol", "sample_ts"], "left").withColumns(
        {
            "microprice_minus_mid": F.col("microprice") - F.col("mid_price"),
            "buy_volume": F.coalesce("buy_volume", F.lit(0.0)),
            "sell_volume": F.coalesce("sell_volume", F.lit(0.0)),
            "total_volume": F.coalesce("total_volume", F.lit(0.0)),
            "trade_count": F.coalesce("trade_count", F.lit(0)),
        }
    )

    def first_pass(w):
        out = {"log_return_1": log_change("mid_price", w)}
        for steps in return_steps:
            out[f"return_{steps}"] = relative_change("mid_price", steps, w)
        for width in flow_windows:
            out |= flow_columns(w, width)
        return out

    with_flows = in_blocks(
        joined, keys=["symbol"], index="grid_idx", compute=first_pass,
        before=max([*return_steps, *[w - 1 for w in flow_windows]]),
    )
    with_vol = in_blocks(
        with_flows, keys=["symbol"], index="grid_idx", before=max(vol_windows) - 1,
        compute=lambda w: {
            f"realized_vol_{n}": rolling(F.stddev_samp, "log_return_1", n, w) for n in vol_windows
        },
    )
    return with_vol.drop("buy_volume", "sell_volume", "total_volume", "trade_count").withColumn(
        "date", F.date_format("sample_ts", "yyyy-MM-dd")
    )


def lead_rows(
    df: DataFrame, *, keys: Sequence[str], index: str, value: str, steps: Sequence[int], prefix: str = "future_"
) -> DataFrame:
    """Value ``k`` rows ahead per key (rows, not time: gaps make it further)."""
    return in_blocks(
        df, keys=keys, index=index, after=max(steps),
        compute=lambda w: {f"{prefix}{value}_{k}": F.lead(value, k).over(w) for k in steps},
    )


def direction_labels(
    silver: DataFrame,
    *,
    horizons: Sequence[int] = (1, 5, 30),
    threshold: float = 1e-4,
    null_label: str | None = "FLAT",
) -> DataFrame:
    """Future return over ``k`` grid rows and its UP / DOWN / FLAT label, per symbol.

    The last ``k`` rows have no future; their label is ``null_label``.
    """
    led = lead_rows(silver, keys=["symbol"], index="grid_idx", value="mid_price", steps=horizons)
    new: dict[str, Column] = {}
    for k in horizons:
        ret = fn.safe_div(F.col(f"future_mid_price_{k}"), F.col("mid_price")) - 1.0
        new[f"future_return_{k}"] = ret
        new[f"label_direction_{k}"] = fn.three_way(ret, threshold, null_label=null_label)
    return led.withColumns(new).drop(*[f"future_mid_price_{k}" for k in horizons])


def tick_volatility(
    ticks: DataFrame, *, keys: Sequence[str], value: str, n: int, tie: Sequence[str], bucket_seconds: int | None = None
) -> DataFrame:
    """Sample deviation of log returns over the last ``n`` ticks (n - 1 returns at most)."""
    indexed = row_index(
        ticks, keys=keys, bucket=None if bucket_seconds is None else time_bucket("ts_event", bucket_seconds), order=[micros("ts_event"), *tie],
        name="tick_idx",
    )
    rets = in_blocks(
        indexed, keys=keys, index="tick_idx", before=1, compute=lambda w: {"log_return": log_change(value, w)}
    )
    return in_blocks(
        rets, keys=keys, index="tick_idx", before=n - 2,
        compute=lambda w: {f"vol_{n}_ticks": F.stddev_samp("log_return").over(w.rowsBetween(-(n - 2), 0))},
    )


def second_volatility(ticks: DataFrame, *, keys: Sequence[str], value: str, seconds: Sequence[int], tie: Sequence[str]) -> DataFrame:
    """Sample deviation of the log returns of the ticks in the last ``s`` seconds, as ``vol_<s>s``.

    The batch form of ``vol_seconds`` in the streaming tick features: a return is against the
    tick before, also where that is older. Only ticks with a time and a positive price have a row.
    """
    good = ticks.where((F.col(value) > 0) & F.col("ts_event").isNotNull())
    indexed = row_index(good, keys=keys, bucket=None, order=[micros("ts_event"), *tie], name="__i")
    rets = in_blocks(indexed, keys=keys, index="__i", before=1, compute=lambda w: {"log_return": log_change(value, w)}).drop("__i")
    return trailing(rets, keys=keys, ts="ts_event", seconds=seconds, deviations={"vol": F.col("log_return")})


def sliding_flow(
    trades: DataFrame, *, keys: Sequence[str], seconds: Sequence[int]
) -> DataFrame:
    """Flow over the last ``s`` seconds (inclusive) at each trade."""
    side, qty = F.col("side"), F.col("qty")
    out = trailing(
        trades, keys=keys, ts="ts_event", seconds=seconds,
        sums={
            "buy": F.when(side == "buy_aggressor", qty).otherwise(0.0),
            "sell": F.when(side == "sell_aggressor", qty).otherwise(0.0),
            "count": F.lit(1).cast("bigint"),
        },
    )
    cols = []
    for s in seconds:
        b, x = F.col(f"buy_{s}s"), F.col(f"sell_{s}s")
        cols += [
            b, x, (b - x).alias(f"net_{s}s"), F.col(f"count_{s}s"),
            F.when(b + x > 0, (b - x) / (b + x)).alias(f"imbalance_{s}s"),
        ]
    return out.select(*trades.columns, *cols)


def lag_value(
    series: DataFrame, *, keys: Sequence[str], ts: str, value: str, seconds: Sequence[int], tie: Sequence[str]
) -> DataFrame:
    """Last value at or before ``t - s`` for each row and each lag: backward as-of on itself."""
    out = series
    right = series.select(*keys, F.col(ts).alias("__rts"), F.col(value).alias("__rv"), *[F.col(t).alias(f"__rt_{t}") for t in tie])
    for s in seconds:
        shifted = out.withColumn("__at", fn.plus_ms(ts, -s * 1000))
        out = asof_join(
            shifted, right, on=keys, left_ts="__at", right_ts="__rts",
            tie=[f"__rt_{t}" for t in tie], right_cols=["__rv"],
        ).drop("__at").withColumnRenamed("__rv", f"{value}_lag_{s}s")
    return out
