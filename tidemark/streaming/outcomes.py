"""Delayed outcomes of signals: entry, exit and expiry by event-time timers.

Quotes and signals may come out of order within the watermark's delay. A market's state holds
the quotes an open or still possible signal can ask for, and the open signals; nothing is
decided before the watermark has passed it, so the result does not depend on the order of
arrival and equals the batch result over all rows that were not late. A market whose signals
are closed and whose quotes are out of reach has no state. Markets are dealt by hash to buckets:
Python is called once per bucket and micro-batch, on arrays of the rows of all its markets.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions import scalars as fn
from tidemark.operators.scan import micros
from tidemark.streaming.state import in_buckets

cloudpickle.register_pickle_by_value(sys.modules[__name__])

L, D, S, B = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()
NEVER = np.iinfo(np.int64).max
SIDES = ("yes", "no")
PRICES = [f"{s}_{c}" for s in SIDES for c in ("bid", "ask")]
FLAGS = [f"{s}_{c}" for s in SIDES for c in ("stale", "crossed")]
CLOSED = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("market_id", S), ("signal_id", L), ("direction", S), ("signal_us", L), ("entry_us", L), ("entry_price", D),
        ("entry_quote_stale", B), ("entry_crossed_quote", B), ("exit_us", L), ("exit_price", D), ("exit_quote_stale", B),
        ("exit_crossed_quote", B), ("closed_by", S), ("closed_us", L), ("late_rows", L),
    )]
)
# of a bucket: its markets, quotes (market, time, id, prices, flags) and open signals, pickled (``_nothing`` at first)
HELD = T.StructType([T.StructField("held", T.BinaryType())])


def _nothing() -> tuple:
    """The state of a bucket before its first row: keys of markets; places among them, times, ids, prices and flags of quotes; open signals."""
    no = np.zeros(0, np.int64)
    return [], no, no, no, np.zeros((0, len(PRICES))), np.zeros((0, len(FLAGS)), np.int8), np.zeros((len(SIGNAL), 0), np.int64)


SIGNAL = ("market", "id", "at", "up")  # rows of the array of open signals


def _first(flags: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Place of the first flagged row from each ``start`` on; the number of rows where there is none."""
    places = np.append(np.flatnonzero(flags), len(flags))
    return places[np.searchsorted(places, np.minimum(start, len(flags)))]


def _from(market: np.ndarray, us: np.ndarray, own: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Place of the first row of each market ``own`` from its time ``at`` on, among rows in order of market and time."""
    low, high = np.searchsorted(market, own, side="left"), np.searchsorted(market, own, side="right")
    while (wide := low < high).any():
        middle = (low + high) // 2
        before = wide & (us[np.minimum(middle, len(us) - 1)] < at)
        low, high = np.where(before, middle + 1, low), np.where(wide & ~before, middle, high)
    return low


def _places(market: np.ndarray, us: np.ndarray, prices: np.ndarray, side: int, own: np.ndarray, at: np.ndarray, latency: int, horizon: int, expire: int) -> tuple:
    """Entry and exit quote of signals of one side among quotes in order; their number stands for none."""
    due, n = at + latency + horizon, len(us)
    market_or_none, us_or_never = np.append(market, -1), np.append(us, NEVER)

    def known(price: int, start: np.ndarray) -> np.ndarray:
        place = _first(~np.isnan(prices[:, 2 * side + price]), start)
        return np.where((market_or_none[place] == own) & (us_or_never[place] <= due + expire), place, n)

    enter = known(1, _from(market, us, own, at + latency))
    return enter, known(0, np.maximum(_from(market, us, own, due), enter))


def _market_ids(keys: list[str], place: np.ndarray) -> np.ndarray:
    """Names of markets from their keys of ``in_buckets``; "-" is the null one."""
    names = np.asarray([None if k == "-" else k.partition(":")[2] for k in keys], object)
    return names[place]


def _rows(n: int, columns: dict) -> pd.DataFrame:
    """Rows of the result; columns not given are null."""
    out = pd.DataFrame({f.name: columns.get(f.name, pd.Series([None] * n, dtype=object)) for f in CLOSED.fields}, index=range(n))
    return out[[f.name for f in CLOSED.fields]]


def _closed(ids: np.ndarray, signals: np.ndarray, side: int, us: np.ndarray, prices: np.ndarray, flags: np.ndarray, enter: np.ndarray, leave: np.ndarray, limit: np.ndarray) -> pd.DataFrame:
    """Rows of the result for signals of one side that are closed."""
    n = len(us)
    us, prices = np.append(us, NEVER), np.append(prices, np.full((1, len(PRICES)), np.nan), axis=0)
    flags = np.append(flags, np.full((1, len(FLAGS)), -1, np.int8), axis=0)
    out: dict = {"market_id": ids, "signal_id": signals[1], "direction": np.full(len(ids), ("UP", "DOWN")[side], object), "signal_us": signals[2]}
    for name, place, price in (("entry", enter, 1), ("exit", leave, 0)):
        out[f"{name}_us"] = pd.arrays.IntegerArray(us[place], place == n)
        out[f"{name}_price"] = prices[place, 2 * side + price]
        for c, flag in enumerate(("quote_stale", "crossed_quote")):
            value = flags[place, 2 * side + c]
            out[f"{name}_{flag}"] = pd.arrays.BooleanArray(value == 1, value < 0)
    out["closed_by"] = np.where(leave < n, "exit", "expiry").astype(object)
    out["closed_us"] = np.where(leave < n, us[leave], limit)
    return _rows(len(ids), out)


def delayed_outcomes(
    signals: DataFrame, quotes: DataFrame, *, latency_ms: int, horizon_s: float, expire_s: float = 2.0,
    delay: str = "10 seconds", clock: DataFrame | None = None,
) -> DataFrame:
    """One row for each signal, when its exit is certain or its expiry has passed.

    Signals: market_id, signal_id, direction (UP or DOWN), ts. Quotes: market_id, row_id, ts and
    for each side (yes, no) bid, ask, stale, crossed. Entry is at the first ask from ``latency``
    after the signal on, exit at the first bid from ``horizon`` later on (not before the entry);
    neither is later than ``expire_s`` after the exit was due. ``closed_by`` is ``exit`` or
    ``expiry``: a signal without an exit closes by its timer, no further quote is needed.
    The watermark is ``delay`` behind the newest row of any kind. ``clock(ts)`` are heartbeats that only move the watermark, so that signals close in
    markets, or on feeds, that have gone quiet. Rows behind the watermark change no result: a
    late signal comes out closed by ``late``, late quotes of a market and batch as one row
    without a signal that says how many (``late_rows``), and what Spark itself drops, rows
    behind the watermark of the batch before, is counted in the query's progress
    (``numRowsDroppedByWatermark``). Rows without a time, and signals of another direction, are left out.
    """
    latency, horizon, expire = latency_ms * 1000, int(round(horizon_s * 1e6)), int(round(expire_s * 1e6))
    number = lambda c: F.col(c).cast("double")
    flag = lambda c: F.when(number(c).isNull() | F.isnan(number(c)), -1).otherwise((number(c) == 1).cast("int")).cast("tinyint")
    none = [F.lit(None).cast("double").alias(c) for c in PRICES] + [F.lit(-1).cast("tinyint").alias(c) for c in FLAGS]

    def timed(rows: DataFrame, kind: int, key: str | None, i: Column, values: list[Column], up: Column) -> DataFrame:
        market = (F.col(key) if key else F.lit(None)).cast("string").alias("market_id")
        named = [F.coalesce(i.cast("bigint"), F.lit(0)).alias("id"), i.cast("bigint").isNotNull().alias("named")]
        return rows.select(market, "ts", micros("ts").alias("us"), F.lit(kind).alias("kind"), *named, *values, up.cast("bigint").alias("up"))

    neither = F.lit(-1)
    up = F.when(F.col("direction") == "UP", 1).when(F.col("direction") == "DOWN", 0).otherwise(neither)
    quoted = [number(c).alias(c) for c in PRICES] + [flag(c).alias(c) for c in FLAGS]
    rows = timed(quotes, 0, "market_id", F.col("row_id"), quoted, neither).unionByName(timed(signals, 1, "market_id", F.col("signal_id"), none, up))
    if clock is not None:
        rows = rows.unionByName(timed(clock, 2, None, F.lit(0), none, neither))
    # one watermark for all: the least of several would stand still with the quietest feed
    rows = rows.where(F.col("ts").isNotNull()).withWatermark("ts", delay)

    def step(bucket: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, market, us, ids, prices, flags, waiting = pickle.loads(state.get[0]) if state.exists else _nothing()
        passed = state.getCurrentWatermarkMs() * 1000  # everything before this is here
        new, late_quotes = [(market, us, ids, prices, flags, waiting)], [np.zeros(0, np.int64)]
        if not state.hasTimedOut:
            place = {k: i for i, k in enumerate(keys)}
            for pdf in parts:
                code, found = pd.factorize(pdf["__key"].to_numpy(object))
                own = np.asarray([place.setdefault(k, len(place)) for k in found], np.int64)[code]
                when, kind, up, named = (pdf[c].to_numpy(np.int64) for c in ("us", "kind", "up", "id"))
                late, quote, signal = when < passed, kind == 0, (kind == 1) & (up >= 0)
                q, s = quote & ~late, signal & ~late
                values = pdf[PRICES].to_numpy(float)[q], pdf[FLAGS].to_numpy(np.int8)[q]
                new.append((own[q], when[q], named[q], *values, np.stack([own[s], named[s], when[s], up[s]])))
                late_quotes.append(own[late & quote])
                if (s := late & signal).any():
                    signal_id = pd.arrays.IntegerArray(named[s], ~pdf["named"].to_numpy(bool)[s])
                    direction = np.where(up[s] == 1, "UP", "DOWN").astype(object)
                    told = {"market_id": _market_ids(list(place), own[s]), "signal_id": signal_id, "direction": direction, "signal_us": when[s]}
                    yield _rows(int(s.sum()), told | {"closed_by": "late", "late_rows": 1})
            keys = list(place)
            own, n_late = np.unique(np.concatenate(late_quotes), return_counts=True)
            if len(own):
                yield _rows(len(own), {"market_id": _market_ids(keys, own), "closed_by": "late", "late_rows": n_late})
        market, us, ids, prices, flags = (np.concatenate(x) for x in list(zip(*new))[:-1])
        waiting = np.concatenate([x[-1] for x in new], axis=1)
        order = np.lexsort((ids, us, market))
        market, us, ids, prices, flags = (x[order] for x in (market, us, ids, prices, flags))
        next_us, stays = NEVER, np.ones(waiting.shape[1], bool)
        for side in (0, 1):  # UP is the yes side, the first one
            here = np.flatnonzero(waiting[3] == 1 - side)
            if not len(here):
                continue
            own, _, at, _ = waiting[:, here]
            enter, leave = _places(market, us, prices, side, own, at, latency, horizon, expire)
            leaves, limit = np.append(us, NEVER)[leave], at + latency + horizon + expire
            done = (leaves < passed) | (limit < passed)
            stays[here[done]] = False
            if not done.all():
                next_us = min(next_us, int(np.minimum(leaves, limit)[~done].min()))
            if done.any():
                yield _closed(_market_ids(keys, own[done]), waiting[:, here[done]], side, us, prices, flags, enter[done], leave[done], limit[done])
        waiting = waiting[:, stays]
        # quotes that an open signal of their market, or one that is still to come, can ask for
        need = np.full(len(keys), passed + latency)
        np.minimum.at(need, waiting[0], waiting[2] + latency)
        kept = us >= need[market]
        market, us, ids, prices, flags = (x[kept] for x in (market, us, ids, prices, flags))
        last = np.flatnonzero(np.append(market[1:] != market[:-1], True)) if len(market) else np.zeros(0, np.int64)
        idle = last[~np.isin(market[last], waiting[0])]
        if len(idle):  # markets without open signals: when their quotes are out of reach
            next_us = min(next_us, int(us[idle].min()) - latency)
        if next_us == NEVER:
            if state.exists:
                state.remove()
            return
        used = np.unique(np.append(market, waiting[0]))
        waiting[0] = np.searchsorted(used, waiting[0])
        held = [keys[i] for i in used.tolist()], np.searchsorted(used, market), us, ids, prices, flags, waiting
        state.update((pickle.dumps(held, protocol=pickle.HIGHEST_PROTOCOL),))
        state.setTimeoutTimestamp(max(next_us // 1000, state.getCurrentWatermarkMs()) + 1)

    return in_buckets(rows, ["market_id"]).groupBy("__bucket").applyInPandasWithState(step, CLOSED, HELD, "append", GroupStateTimeout.EventTimeTimeout)


def with_result(outcomes: DataFrame, *, fee_rate: float = 0.07, slippage: float = 0.0025, shares: float = 1.0, settles: Column | bool = False) -> DataFrame:
    """pnl, roi, entry_fee, exit_fee, net_pnl, net_pnl_total of rows with entry_price and exit_price.

    Null where either price is. The return on investment is null where the entry price is not
    positive. Where ``settles`` holds the exit is a settlement, which costs no fee.
    """
    entry, leave = F.col("entry_price"), F.col("exit_price")
    both = entry.isNotNull() & leave.isNotNull()
    settles = F.lit(settles) if isinstance(settles, bool) else settles
    out = outcomes.withColumns({
        "pnl": leave - entry,
        "entry_fee": F.when(both, fn.taker_fee("entry_price", fee_rate)),
        "exit_fee": F.when(both, F.when(settles, 0.0).otherwise(fn.taker_fee("exit_price", fee_rate))),
    })
    out = out.withColumns({
        "roi": F.when(entry > 0, F.col("pnl") / entry),
        "net_pnl": F.col("pnl") - F.col("entry_fee") - F.col("exit_fee") - F.lit(slippage),
    })
    return out.withColumn("net_pnl_total", F.col("net_pnl") * F.lit(shares))
