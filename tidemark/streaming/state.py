"""Keyed state over streams, in event-time order inside each micro-batch.

Every operator keeps a small bounded state per key. Operators whose keys are many and have few
rows each deal the keys by hash to ``BUCKETS`` groups: Python is called once per bucket and
micro-batch, its arrays hold the rows of many keys, and the state of a bucket lists its keys.
Rows of a key are sorted by
(time, tie) within a micro-batch; across micro-batches they are taken as they come,
so feeds should be ordered up to the watermark the caller sets. On a stream whose
batches are in order the results equal the batch operators row by row.
"""

from __future__ import annotations

import math
import sys
from collections import deque
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.moments import window_deviation
from tidemark.operators.scan import micros

cloudpickle.register_pickle_by_value(sys.modules[__name__])

L, D, S = T.LongType(), T.DoubleType(), T.StringType()


def _sorted(parts: Iterable[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    frames = list(parts)
    pdf = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
    return pdf.sort_values(order, kind="stable", ignore_index=True)


def _fields(*spec: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in spec])


BUCKETS = 512


def in_buckets(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with ``__key``, one text for each combination of the keys (nulls too), and its ``__bucket``."""
    text = [F.col(k).cast("string") for k in keys]
    parts = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    return rows.withColumn("__key", F.concat(*parts)).withColumn("__bucket", F.pmod(F.xxhash64("__key"), F.lit(BUCKETS)))


def runs(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal names begins and ends."""
    first = np.append(0, np.flatnonzero(names[1:] != names[:-1]) + 1)
    return first, np.append(first[1:], len(names))


def _filled(pdf: pd.DataFrame, fills: dict[str, np.ndarray], state: GroupState) -> dict[str, np.ndarray]:
    """Last known value of each column up to the row of its key, from the state on; the state moves on.

    ``pdf`` is sorted by key first. The state is the bucket's keys and a row of values for each.
    """
    names = pdf["__key"].to_numpy(object)
    first, end = runs(names)
    size = end - first
    keys, flat = state.get if state.exists else ([], [])
    held = np.asarray(flat, float).reshape(-1, len(fills))
    place = {k: i for i, k in enumerate(keys)}
    at = np.asarray([place.setdefault(k, len(place)) for k in names[first].tolist()], np.int64)
    held = np.concatenate([held, np.full((len(place) - len(held), len(fills)), np.nan)])
    start, out = np.repeat(first, size), {}
    for c, (name, values) in enumerate(fills.items()):
        known = np.maximum.accumulate(np.where(np.isnan(values), -1, np.arange(len(values))))
        out[name] = np.where(known >= start, values[np.maximum(known, 0)], np.repeat(held[at, c], size))
        held[at, c] = out[name][end - 1]
    state.update((list(place), held.ravel().tolist()))
    return out


def throttle(stream: DataFrame, *, keys: Sequence[str], ts: str, tie: str, seconds: float) -> DataFrame:
    """Keep a row when at least ``seconds`` passed since the last kept row of its key.

    State per key: one time. Serves throttled sampling and signal cooldowns; the batch
    form is :func:`tidemark.operators.cooldown.cooldown_thin`.
    """
    wait = int(round(seconds * 1e6))
    timed = in_buckets(stream.withColumn("__us", micros(ts)), keys)
    schema = stream.schema

    def step(bucket: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = _sorted(parts, ["__key", "__us", tie])
        times, names = pdf["__us"].to_numpy(np.int64), pdf["__key"].to_numpy(object)
        held = dict(zip(*state.get)) if state.exists else {}
        kept = []
        for first, end in zip(*(x.tolist() for x in runs(names))):
            us, last = times[first:end], held.get(names[first])
            i = 0 if last is None else int(us.searchsorted(last + wait, side="left"))
            while i < len(us):
                kept.append(first + i)
                last = int(us[i])
                i = max(i + 1, int(us.searchsorted(last + wait, side="left")))
            if last is not None:
                held[names[first]] = last
        if kept:
            state.update((list(held), list(held.values())))
            yield pdf.iloc[kept][schema.names]

    return timed.groupBy("__bucket").applyInPandasWithState(
        step, schema, _fields(("key", T.ArrayType(S)), ("last", T.ArrayType(L))), "append", GroupStateTimeout.NoTimeout
    )


def first_only(stream: DataFrame, *, keys: Sequence[str], ts: str, tie: str) -> DataFrame:
    """The first row of each key: one accepted trade per market and side."""
    timed = in_buckets(stream.withColumn("__us", micros(ts)), keys)
    schema = stream.schema

    def step(bucket: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = _sorted(parts, ["__key", "__us", tie])
        seen = state.get[0] if state.exists else []
        new = pdf.iloc[runs(pdf["__key"].to_numpy(object))[0]]
        new = new[~new["__key"].isin(set(seen))]
        if len(new):
            state.update(([*seen, *new["__key"].tolist()],))
            yield new[schema.names]

    return timed.groupBy("__bucket").applyInPandasWithState(
        step, schema, _fields(("seen", T.ArrayType(S))), "append", GroupStateTimeout.NoTimeout
    )


def hourly_limit(stream: DataFrame, *, keys: Sequence[str], ts: str, tie: str, limit: int, window_seconds: int = 3_600) -> DataFrame:
    """At most ``limit`` accepted rows per key in any trailing window; state is those times."""
    span = window_seconds * 1_000_000
    timed = stream.withColumn("__us", micros(ts))

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = _sorted(parts, ["__us", tie])
        # only the last `limit` accepted times matter: a row is free once the oldest of them is out
        recent = deque(state.get[0] if state.exists else [], maxlen=limit)
        kept = []
        for i, now in enumerate(pdf["__us"].tolist()):
            if len(recent) < limit or recent[0] < now - span:
                kept.append(i)
                recent.append(now)
        state.update((list(recent),))
        if kept:
            yield pdf.iloc[kept]

    out = timed.groupBy(*keys).applyInPandasWithState(
        step, timed.schema, _fields(("recent", T.ArrayType(L))), "append", GroupStateTimeout.NoTimeout
    )
    return out.drop("__us")


QUOTE_STATE = _fields(
    ("market_id", S), ("asset_id", S), ("ts_us", L), ("row_id", L), ("current_bid", D), ("current_ask", D),
    ("current_bid_size", D), ("current_ask_size", D), ("last_quote_update_us", L), ("last_trade_price", D),
)


KEY_VALUES = _fields(("key", T.ArrayType(S)), ("values", T.ArrayType(D)))


def quote_state(events: DataFrame, *, tie: str = "row_id") -> DataFrame:
    """State of each asset after every quote event: sides replaced as they arrive.

    ``events`` are normalised quote events with an integer ``tie``. State per asset: the
    six current values.
    """
    cols = ["update_bid", "update_ask", "update_bid_size", "update_ask_size"]
    rows = events.select("market_id", "asset_id", micros("ts_event").alias("ts_us"), F.col(tie).cast("bigint").alias("row_id"),
                         F.when(F.col("source") == "orderbook", 0).otherwise(1).alias("prio"), *cols, "last_trade_price")

    def step(bucket: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = _sorted(parts, ["__key", "ts_us", "prio", "row_id"])
        value = {c: pdf[c].to_numpy(float) for c in (*cols, "last_trade_price", "ts_us")}
        moved = ~(np.isnan(value["update_bid"]) & np.isnan(value["update_ask"]))
        fills = {c.replace("update", "current"): value[c] for c in cols}
        fills |= {"last_quote_update_us": np.where(moved, value["ts_us"], np.nan), "last_trade_price": value["last_trade_price"]}
        out = pdf[["market_id", "asset_id", "ts_us", "row_id"]].assign(**_filled(pdf, fills, state))
        yield out.astype({"last_quote_update_us": "Int64"})

    return in_buckets(rows, ["market_id", "asset_id"]).groupBy("__bucket").applyInPandasWithState(
        step, QUOTE_STATE, KEY_VALUES, "append", GroupStateTimeout.NoTimeout
    )


_PAIR = [f"{s}_{f}" for s in ("yes", "no") for f in ("bid", "ask", "bid_size", "ask_size")]
PAIR_STATE = _fields(
    ("market_id", S), ("ts_us", L), ("row_id", L), *[(c, D) for c in _PAIR], ("yes_update_us", L), ("no_update_us", L)
)


def pair_state(events: DataFrame, *, tie: str = "row_id") -> DataFrame:
    """Both sides of a market after every event of either side: the live feature base.

    ``events`` carry market_id and direction (UP / DOWN) next to the quote update.
    Derived features are plain columns on the result.
    """
    cols = ["update_bid", "update_ask", "update_bid_size", "update_ask_size"]
    rows = events.select("market_id", micros("ts_event").alias("ts_us"), F.col(tie).cast("bigint").alias("row_id"),
                         F.when(F.col("source") == "orderbook", 0).otherwise(1).alias("prio"), (F.col("direction") == "UP").alias("yes"), *cols)

    def step(bucket: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = _sorted(parts, ["__key", "ts_us", "prio", "row_id"])
        value = {c: pdf[c].to_numpy(float) for c in (*cols, "ts_us")}
        moved = ~(np.isnan(value["update_bid"]) & np.isnan(value["update_ask"]))
        yes = pdf["yes"].astype(bool).to_numpy()
        sides = {"yes": yes, "no": ~yes}
        fills = {f"{s}_{c.removeprefix('update_')}": np.where(here, value[c], np.nan) for s, here in sides.items() for c in cols}
        fills |= {f"{s}_update_us": np.where(moved & here, value["ts_us"], np.nan) for s, here in sides.items()}
        out = pdf[["market_id", "ts_us", "row_id"]].assign(**_filled(pdf, fills, state))
        yield out.astype({f"{s}_update_us": "Int64" for s in sides})

    return in_buckets(rows, ["market_id"]).groupBy("__bucket").applyInPandasWithState(
        step, PAIR_STATE, KEY_VALUES, "append", GroupStateTimeout.NoTimeout
    )


SETTLED = _fields(("signal_id", L), ("market_id", S), ("direction", S), ("open_price", D), ("close_price", D), ("settled_yes", L), ("pnl", D))


def settle_at_end(
    signals: DataFrame, prices: DataFrame, *, series: str = "series", grace_s: float = 2.0, span_s: float = 86_400.0,
    delay: str = "10 seconds",
) -> DataFrame:
    """Outcome of held signals at their market's end, from a reference price stream.

    Signals: series, signal_id, market_id, direction, entry_price, start_ts, end_ts, ts.
    Prices: series, row_id, ts, price. The open price is the last one at or before the
    market's start, the close the last one at or before end plus grace. A signal settles
    with the first price after that, or when the watermark (``delay`` behind the newest
    row) passes it; rows behind the watermark are dropped. Prices of the last ``span_s``
    seconds are kept, the longest a market may have been open when a signal comes; a signal
    whose market began before that has no open price. State per series: those prices and
    the open signals.
    """
    grace, span = int(round(grace_s * 1e6)), int(round(span_s * 1e6))
    nd, ns, nl = F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(None).cast("bigint")
    both = prices.withWatermark("ts", delay).select(
        F.col(series).alias("series"), "ts", micros("ts").alias("us"), F.lit(0).alias("kind"), F.col("row_id").cast("bigint").alias("id"),
        F.col("price").cast("double").alias("x"), ns.alias("market_id"), ns.alias("direction"), nl.alias("a"), nl.alias("b"),
    ).unionByName(
        signals.withWatermark("ts", delay).select(
            F.col(series).alias("series"), "ts", micros("ts").alias("us"), F.lit(1).alias("kind"), F.col("signal_id").cast("bigint").alias("id"),
            F.col("entry_price").cast("double").alias("x"), "market_id", "direction", micros("start_ts").alias("a"), micros("end_ts").alias("b"),
        )
    )
    held = _fields(
        ("us", T.ArrayType(L)), ("px", T.ArrayType(D)), ("id", T.ArrayType(L)), ("m", T.ArrayType(S)), ("d", T.ArrayType(S)),
        ("e", T.ArrayType(D)), ("o", T.ArrayType(D)), ("b", T.ArrayType(L)),
    )

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = [list(x) for x in state.get] if state.exists else [[] for _ in range(8)]
        us, pr = np.asarray(old[0], dtype=np.int64), np.asarray(old[1], dtype=float)
        waiting = pd.DataFrame(dict(zip(("id", "m", "d", "e", "o", "b"), old[2:], strict=True)))

        def last_price(times: np.ndarray) -> np.ndarray:
            at = np.searchsorted(us, times, side="right") - 1
            return np.where(at >= 0, np.append(pr, np.nan)[at], np.nan)

        passed = state.getCurrentWatermarkMs() * 1000
        if not state.hasTimedOut:
            pdf = _sorted(parts, ["us", "kind", "id"])
            new = pdf[pdf["kind"] == 0]
            us = np.concatenate([us, new["us"].to_numpy(np.int64)])
            pr = np.concatenate([pr, new["x"].to_numpy(float)])
            sig = pdf[pdf["kind"] == 1]
            if len(sig):
                opened = last_price(sig["a"].to_numpy(np.int64))
                more = pd.DataFrame({"id": sig["id"], "m": sig["market_id"], "d": sig["direction"], "e": sig["x"], "o": opened, "b": sig["b"].astype("int64")})
                waiting = pd.concat([waiting, more], ignore_index=True) if len(waiting) else more.reset_index(drop=True)
        passed = max(passed, int(us[-1]) if len(us) else passed)
        if len(waiting):
            due = waiting["b"].to_numpy(np.int64) + grace
            over = due < passed
            done, waiting = waiting[over], waiting[~over]
            if len(done):
                close, opened = last_price(due[over]), done["o"].to_numpy(float)
                known = ~(np.isnan(close) | np.isnan(opened))
                yes = (close > opened).astype(float)
                worth = np.where(done["d"] == "UP", yes, 1 - yes) - done["e"].to_numpy(float)
                out = pd.DataFrame({"signal_id": done["id"], "market_id": done["m"], "direction": done["d"], "open_price": opened, "close_price": close})
                out["settled_yes"] = pd.Series(np.where(known, yes, np.nan), index=out.index).astype("Int64")
                out["pnl"] = np.where(known, worth, np.nan)
                yield out
        # what a later signal or an open one can still ask for, and the price before it
        need = min([passed - span, *(waiting["b"] + grace)]) if len(waiting) else passed - span
        cut = max(int(np.searchsorted(us, need, side="right")) - 1, 0)
        state.update((us[cut:].tolist(), pr[cut:].tolist(), *(waiting[c].tolist() if len(waiting) else [] for c in ("id", "m", "d", "e", "o", "b"))))
        if len(waiting):
            state.setTimeoutTimestamp(max(int((waiting["b"].min() + grace) // 1000) + 1, state.getCurrentWatermarkMs() + 1))

    return both.groupBy("series").applyInPandasWithState(step, SETTLED, held, "append", GroupStateTimeout.EventTimeTimeout)


def with_open(outcomes: DataFrame, signals: DataFrame, *, key: str = "signal_id") -> DataFrame:
    """Resolved outcomes and, with nulls, the signals that are still open."""
    return signals.join(outcomes.drop(*(set(signals.columns) - {key})), key, "left")


def tick_features(
    ticks: DataFrame, *, key: str, ts: str, tie: str, price: str, qty: str, side: str,
    lags_s: Sequence[int] = (1, 5, 10, 30), flows_s: Sequence[int] = (1, 5, 30), vol_ticks: int = 60, vol_seconds: Sequence[int] = (),
    history_s: int = 65,
) -> DataFrame:
    """Lagged prices, sliding flows and volatility at each tick, from a pruned history.

    ``vol_ticks`` is the deviation of the log returns between the last ticks of the history;
    ``vol_seconds`` adds ``vol_<s>s``, that of the returns of the ticks in the last ``s``
    seconds (inclusive, at most ``history_s``), each against the tick before it. Ticks without a
    positive price have no return.

    State per key: price and trade history of the last ``history_s`` seconds, both
    pruned, so it is bounded by the tick rate and not by the age of the stream.
    ``side`` is 1 for a buy, -1 for a sell, 0 for a quote without a trade.
    """
    keep = history_s * 1_000_000
    if any(s > history_s for s in vol_seconds):
        raise ValueError("vol_seconds reach further back than history_s")
    rows = ticks.select(F.col(key).cast("string").alias("key"), micros(ts).alias("us"), F.col(tie).cast("bigint").alias("row_id"),
                        F.col(price).cast("double").alias("price"), F.col(qty).cast("double").alias("qty"), F.col(side).cast("int").alias("side"))
    out_schema = _fields(
        ("key", S), ("us", L), ("row_id", L), ("price", D),
        *[(f"price_lag_{s}s", D) for s in lags_s],
        *[(f"{w}_{s}s", D) for s in flows_s for w in ("buy", "sell")],
        ("vol_ticks", D), *[(f"vol_{s}s", D) for s in vol_seconds], ("history_rows", L),
    )
    hist = _fields(("key", T.ArrayType(S)), ("rows", T.ArrayType(L)), ("us", T.ArrayType(L)), ("price", T.ArrayType(D)), ("qty", T.ArrayType(D)), ("side", T.ArrayType(L)))
    made = [f.name for f in out_schema.fields[4:]]

    def key_step(old: Sequence[np.ndarray], new: Sequence[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Features of one key's new ticks and its history after them."""
        us, px, qt, sd = (np.concatenate(x) for x in zip(old, new))
        at = np.arange(len(old[0]), len(us))
        now = us[at]
        oldest = np.searchsorted(us, now - keep, side="left")  # first row still in history
        out = []
        for s in lags_s:
            pos = np.searchsorted(us, now - s * 1_000_000, side="right") - 1
            ok = (pos >= oldest) & (pos >= 0)
            out.append(np.where(ok, px[np.maximum(pos, 0)], np.nan))
        buys = np.concatenate([[0.0], np.cumsum(np.where(sd > 0, qt, 0.0))])
        sells = np.concatenate([[0.0], np.cumsum(np.where(sd < 0, qt, 0.0))])
        for s in flows_s:
            lo = np.maximum(np.searchsorted(us, now - s * 1_000_000, side="left"), oldest)
            out += [buys[at + 1] - buys[lo], sells[at + 1] - sells[lo]]
        good = np.append(0, np.cumsum(px > 0))  # positive prices before each row
        returns = np.diff(np.log(px[px > 0]))  # number i leads to positive price i + 1
        upto = good[at + 1] - 1
        out.append(window_deviation(returns, good[np.maximum(oldest, at + 1 - vol_ticks)], upto))
        for s in vol_seconds:
            lo = np.searchsorted(us, now - s * 1_000_000, side="left")
            out.append(window_deviation(returns, np.maximum(good[lo] - 1, 0), upto))
        out.append(at - oldest + 1)
        cut = int(oldest[-1])
        held = np.append(np.flatnonzero(px[:cut] > 0)[-1:], np.arange(cut, len(us)))  # with the price before
        return out, [x[held] for x in (us, px, qt, sd)]

    def step(bucket: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = _sorted(parts, ["__key", "us", "row_id"])
        names = pdf["__key"].to_numpy(object)
        columns = (
            pdf["us"].to_numpy(np.int64), pdf["price"].to_numpy(float), pdf["qty"].fillna(0.0).to_numpy(float), pdf["side"].fillna(0).to_numpy(np.int64),
        )
        history = {}
        if state.exists:
            keys, sizes, *flat = state.get
            flat = [np.asarray(x, t) for x, t in zip(flat, (np.int64, float, float, np.int64))]
            cuts = np.append(0, np.cumsum(sizes)).astype(int).tolist()
            history = {k: [x[a:b] for x in flat] for k, a, b in zip(keys, cuts, cuts[1:])}
        none = [x[:0] for x in columns]
        found = []
        for first, end in zip(*(x.tolist() for x in runs(names))):
            key = names[first]
            out, history[key] = key_step(history.get(key, none), [x[first:end] for x in columns])
            found.append(out)
        flat = [np.concatenate(x).tolist() for x in zip(*history.values())]
        state.update((list(history), [len(h[0]) for h in history.values()], *flat))
        yield pdf[["key", "us", "row_id", "price"]].assign(**{n: np.concatenate(x) for n, x in zip(made, zip(*found))})

    return in_buckets(rows, ["key"]).groupBy("__bucket").applyInPandasWithState(step, out_schema, hist, "append", GroupStateTimeout.NoTimeout)


OUTCOME = _fields(
    ("market_id", S), ("signal_id", L), ("signal_us", L), ("entry_us", L), ("entry_price", D),
    ("exit_us", L), ("exit_price", D), ("pnl", D), ("resolved_us", L),
)


def resolve_outcomes(
    signals: DataFrame, quotes: DataFrame, *, latency_ms: int, horizon_s: float, expire_s: float = 2.0
) -> DataFrame:
    """Entry at the first quote ``latency`` after a signal, exit at the first one ``horizon`` later.

    Signals: market_id, signal_id, ts. Quotes: market_id, row_id, ts, bid, ask. A signal
    resolves when its exit is known, or at the first quote more than ``expire_s`` after
    the exit was due. State per market: the open signals.
    """
    lat, hor, exp = latency_ms * 1000, int(round(horizon_s * 1e6)), int(round(expire_s * 1e6))
    none_d = F.lit(None).cast("double")
    both = quotes.select("market_id", F.col("row_id").cast("bigint").alias("id"), micros("ts").alias("us"), F.lit(0).alias("kind"), "bid", "ask").unionByName(
        signals.select("market_id", F.col("signal_id").cast("bigint").alias("id"), micros("ts").alias("us"), F.lit(1).alias("kind"), none_d.alias("bid"), none_d.alias("ask"))
    )
    open_schema = _fields(
        ("id", T.ArrayType(L)), ("us", T.ArrayType(L)), ("entry_us", T.ArrayType(L)), ("entry", T.ArrayType(D))
    )

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = _sorted(parts, ["us", "kind", "id"])
        quotes, new = pdf[pdf["kind"] == 0], pdf[pdf["kind"] == 1]
        old = [list(x) for x in state.get] if state.exists else [[] for _ in range(4)]
        us, bid, ask = (quotes[c].to_numpy(t) for c, t in (("us", np.int64), ("bid", float), ("ask", float)))
        sid = np.concatenate([np.asarray(old[0], np.int64), new["id"].to_numpy(np.int64)])
        at = np.concatenate([np.asarray(old[1], np.int64), new["us"].to_numpy(np.int64)])
        entry_us = np.array([*(math.nan if x is None else x for x in old[2]), *[math.nan] * len(new)], float)
        entry = np.array([*(math.nan if x is None else x for x in old[3]), *[math.nan] * len(new)], float)
        n = len(us)
        # a quote counts for signals before it, and of one instant quotes stand first
        seen = np.concatenate([np.zeros(len(old[0]), np.int64), np.searchsorted(us, new["us"].to_numpy(np.int64), side="right")])

        def first(flags: np.ndarray, start: np.ndarray) -> np.ndarray:
            """Place of the first flagged quote from ``start`` on (n: none)."""
            places = np.append(np.flatnonzero(flags), n)
            return places[np.searchsorted(places, np.minimum(start, n))]

        entered = ~np.isnan(entry)
        enter = np.where(entered, seen, first(~np.isnan(ask), np.maximum(seen, np.searchsorted(us, at + lat, side="left"))))
        due = at + lat + hor
        leave = np.where(enter < n, first(~np.isnan(bid), np.maximum(enter, np.searchsorted(us, due, side="left"))), n)
        leave = np.where(entered & (n > 0), first(~np.isnan(bid), np.maximum(seen, np.searchsorted(us, due, side="left"))), leave)
        late = np.maximum(seen, np.searchsorted(us, due + exp, side="right"))
        over = np.minimum(leave, late)
        closed, done = (leave <= late) & (leave < n), over < n
        padded = [np.append(x.astype(float), math.nan) for x in (us, bid, ask)]
        fresh = ~entered & (enter < n) & ((enter <= over) | ~done)
        entry_us = np.where(fresh, padded[0][np.minimum(enter, n)], entry_us)
        entry = np.where(fresh, padded[2][np.minimum(enter, n)], entry)
        still = ~done
        none = lambda x: [None if math.isnan(v) else v for v in x.tolist()]
        state.update((sid[still].tolist(), at[still].tolist(), [None if v is None else int(v) for v in none(entry_us[still])], none(entry[still])))
        if done.any():
            place = over[done]
            exit_price = np.where(closed[done], padded[1][place], math.nan)
            out = pd.DataFrame({"market_id": key[0], "signal_id": sid[done], "signal_us": at[done], "entry_us": entry_us[done], "entry_price": entry[done]})
            out["exit_us"] = np.where(closed[done], padded[0][place], math.nan)
            out["exit_price"], out["pnl"] = exit_price, exit_price - entry[done]
            out["resolved_us"] = us[place]
            for c in ("entry_us", "exit_us"):
                out[c] = out[c].astype("Int64")
            yield out

    return both.groupBy("market_id").applyInPandasWithState(step, OUTCOME, open_schema, "append", GroupStateTimeout.NoTimeout)


DRAWDOWN_EVENT = _fields(("account", S), ("us", L), ("row_id", L), ("cum_pnl", D), ("peak_pnl", D), ("drawdown", D), ("level", D))


def drawdown_events(results: DataFrame, *, account: str, ts: str, tie: str, pnl: str, threshold: float) -> DataFrame:
    """An event each time the running drawdown reaches a further multiple of the threshold."""
    rows = results.select(F.col(account).cast("string").alias("account"), micros(ts).alias("us"), F.col(tie).cast("bigint").alias("row_id"), F.col(pnl).cast("double").alias("pnl"))

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = _sorted(parts, ["us", "row_id"])
        total, peak, level = state.get if state.exists else (0.0, 0.0, 0.0)
        cum = total + np.cumsum(pdf["pnl"].fillna(0.0).to_numpy(float))
        peaks = np.maximum.accumulate(np.append(peak, cum))[1:]
        fall = peaks - cum
        levels = np.floor(fall / threshold) * threshold
        top = np.maximum.accumulate(np.append(level, levels))
        hit = levels > top[:-1]
        state.update((float(cum[-1]), float(peaks[-1]), float(top[-1])))
        if hit.any():
            out = pdf.loc[hit, ["account", "us", "row_id"]].copy()
            out["cum_pnl"], out["peak_pnl"], out["drawdown"], out["level"] = cum[hit], peaks[hit], -fall[hit], levels[hit]
            yield out

    return rows.groupBy("account").applyInPandasWithState(
        step, DRAWDOWN_EVENT, _fields(("t", D), ("p", D), ("l", D)), "append", GroupStateTimeout.NoTimeout
    )


CONTEXT = _fields(("key", S), ("us", L), ("row_id", L), ("recent_us", T.ArrayType(L)), ("recent_value", T.ArrayType(D)))


def recent_context(rows: DataFrame, *, key: str, ts: str, tie: str, value: str, wanted: str, last: int = 120) -> DataFrame:
    """For rows where ``wanted`` holds: the last ``last`` values of the key up to the row."""
    src = rows.select(F.col(key).cast("string").alias("key"), micros(ts).alias("us"), F.col(tie).cast("bigint").alias("row_id"),
                      F.col(value).cast("double").alias("value"), F.col(wanted).cast("boolean").alias("wanted"))

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = _sorted(parts, ["us", "row_id"])
        old = state.get if state.exists else ([], [])
        us = [*old[0], *pdf["us"].tolist()]
        vs = [*old[1], *pdf["value"].tolist()]
        base = len(old[0])
        state.update((us[-last:], vs[-last:]))
        out = [
            (k[0], us[base + i], rid, us[max(0, base + i + 1 - last): base + i + 1], vs[max(0, base + i + 1 - last): base + i + 1])
            for i, (rid, w) in enumerate(zip(pdf["row_id"].tolist(), pdf["wanted"].tolist()))
            if w
        ]
        if out:
            yield pd.DataFrame(out, columns=[f.name for f in CONTEXT.fields])

    return src.groupBy("key").applyInPandasWithState(
        step, CONTEXT, _fields(("us", T.ArrayType(L)), ("v", T.ArrayType(D))), "append", GroupStateTimeout.NoTimeout
    )
