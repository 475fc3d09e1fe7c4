"""The live feature vector: one row per quote update, joined as of its time with the ticks of its instrument.

Quotes of a market and ticks of its instrument come in any order within the watermark's delay.
A market's state holds what the watermark has not passed yet, the current values of both sides,
and a bounded past (the longest look-back, and the ticks of the longest volatility). An update is
released once the watermark has passed it, so the rows equal those of a batch join over all rows
that were not late. The state of a market ends with the market.

State and look-backs are made in Python on arrays, market by market; every feature is a column on
top. Markets are dealt by hash to buckets, so Python is called once per bucket and micro-batch and
only the markets with new rows, or with something due, are opened.
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
from tidemark.operators.moments import window_deviation
from tidemark.operators.scan import micros
from tidemark.plans.features import derived_features
from tidemark.streaming.state import BUCKETS, runs

cloudpickle.register_pickle_by_value(sys.modules[__name__])

L, D, S = T.LongType(), T.DoubleType(), T.StringType()
SIDES = ("yes", "no")
QUOTE = ("bid", "ask", "bid_size", "ask_size", "bid_depth", "ask_depth")
TICK = ("bid", "ask", "bid_size", "ask_size", "price", "signed_qty")
PRICE, SIGNED = 4, 5
LAGS, FLOWS, VOLS, MOVES = (1, 5, 10, 30), (1, 5, 30), (10, 30, 60), (1, 5)
INTS = ("us", "kind", "prio", "id", "yes")
VALUES = [f"v{i}" for i in range(len(QUOTE))]
CURRENT = [f"{s}_{c}" for s in SIDES for c in QUOTE]

STATE_ROW = T.StructType(
    [T.StructField("market_id", S), *[T.StructField(n, L) for n in ("ts_us", "row_id", "start_us", "end_us")]]
    + [T.StructField(n, D) for n in CURRENT]
    + [T.StructField(f"{s}_update_us", L) for s in SIDES]
    + [T.StructField(f"yes_mid_lag_{m}", D) for m in MOVES]
    + [T.StructField(f"ref_{c}", D) for c in TICK[:PRICE]]
    + [T.StructField(n, D) for n in ("ref_price", "open_price")]
    + [T.StructField(f"ref_lag_{s}", D) for s in LAGS]
    + [T.StructField(f"ref_vol_{n}", D) for n in VOLS]
    + [T.StructField(f"ref_{what}_{s}", D) for s in FLOWS for what in ("buy", "sell")]
    + [T.StructField(f"ref_count_{s}", L) for s in FLOWS]
    + [T.StructField("late_rows", L)]
)
# of each market of a bucket: when to look at it again, and its past (``_nothing`` at first)
HELD = T.StructType([T.StructField("market", T.ArrayType(S)), T.StructField("due", T.ArrayType(L)), T.StructField("past", T.ArrayType(T.BinaryType()))])


def _nothing(start: int, end: int) -> tuple:
    """The past of a new market: waiting rows, ticks, mids, current values and their times, open price and its time, window."""
    no, none = np.zeros(0, np.int64), np.full(len(CURRENT), np.nan)
    return np.zeros((len(INTS), 0), np.int64), np.zeros((len(VALUES), 0)), no, np.zeros((len(TICK), 0)), no, np.zeros(0), none, np.full(len(SIDES), np.nan), (None, None), start, end


def _at(values: np.ndarray, place: np.ndarray) -> np.ndarray:
    """``values[place]``, nothing where the place is before the first."""
    padded = np.append(values, np.nan)
    return padded[np.where(place < 0, len(values), place)]


def live_state(
    quotes: DataFrame, ticks: DataFrame, markets: DataFrame, *, unit_s: float = 1.0, delay: str = "10 seconds",
    clock: DataFrame | None = None,
) -> DataFrame:
    """Both sides, the instrument and its past at every quote update of a market.

    Quotes: market_id, row_id, ts, side (yes or no), prio (of rows of one time the smaller is
    first), and updates of bid, ask, bid_size, ask_size, bid_depth, ask_depth (null keeps the
    value). Ticks: instrument, row_id, ts, bid, ask, bid_size, ask_size, price, signed_qty
    (bought above zero, sold below, null without a trade); ticks without a positive price are left
    out. Markets, a table: market_id, instrument, start_ts, end_ts; quotes of other markets
    and rows without a time are left out. A tick goes to every market of its instrument that is
    open then or opens within the look-back, so the feed grows by the number of markets open
    at a time. ``unit_s`` is the length of the one in "1 s ago". The open price is the first
    price inside the market's window. ``clock(ts)`` are heartbeats that only move the watermark.
    Rows behind the watermark change no result; a market's late rows of a batch come out as one
    row with ``late_rows`` and no row_id.
    """
    unit = int(round(unit_s * 1e6))
    past = max(*LAGS, *FLOWS) * unit
    window = markets.select(
        F.col("market_id").cast("string").alias("market_id"), "instrument", micros("start_ts").alias("start_us"), micros("end_ts").alias("end_us")
    )
    common = ["market_id", "ts", "us", "kind", "prio", "id", "yes", "start_us", "end_us", *VALUES]

    def row(kind: int, prio: Column | int, ident: Column, yes: Column | int, values: list[Column]) -> dict[str, Column]:
        as_long = {"us": micros("ts"), "kind": F.lit(kind), "prio": prio if isinstance(prio, Column) else F.lit(prio), "id": ident, "yes": yes if isinstance(yes, Column) else F.lit(yes)}
        return {n: c.cast("bigint") for n, c in as_long.items()} | {n: c.cast("double") for n, c in zip(VALUES, values)}

    quoted = quotes.withColumn("market_id", F.col("market_id").cast("string")).join(window.drop("instrument"), "market_id").where("side IN ('yes', 'no')")
    rows = quoted.select("market_id", "ts", "start_us", "end_us", *[c.alias(n) for n, c in row(0, F.col("prio"), F.col("row_id"), F.col("side") == "yes", [F.col(c) for c in QUOTE]).items()])
    reach = (micros("ts") >= F.col("start_us") - past) & (micros("ts") < F.col("end_us"))
    ticked = ticks.where("price > 0").join(window, "instrument").where(reach)
    rows = rows.select(*common).unionByName(
        ticked.select("market_id", "ts", "start_us", "end_us", *[c.alias(n) for n, c in row(1, 0, F.col("row_id"), 0, [F.col(c) for c in TICK]).items()]).select(*common)
    )
    if clock is not None:
        nothing = [F.lit(None)] * len(VALUES)
        none = {"market_id": F.lit(None).cast("string"), "start_us": F.lit(None).cast("bigint"), "end_us": F.lit(None).cast("bigint")}
        rows = rows.unionByName(clock.select("ts", *[c.alias(n) for n, c in (none | row(2, 0, F.lit(0), 0, nothing)).items()]).select(*common))
    rows = rows.where(F.col("ts").isNotNull()).withWatermark("ts", delay)

    def advance(market: str, held: tuple, more: tuple | None, passed: int) -> tuple:
        """Rows of the market's updates that the watermark has passed, when to look again (None: it has ended), its past."""
        ints, values, tick_us, tick, mid_us, mid, current, updated, opened, start, end = held
        if more is not None:
            ints, values = np.concatenate([ints, more[0]], axis=1), np.concatenate([values, more[1]], axis=1)
        order = np.lexsort((ints[3], ints[2], ints[0]))
        ints, values = ints[:, order], values[:, order]
        ready = ints[0] < passed
        new_tick, quote = ready & (ints[1] == 1), ready & (ints[1] == 0)
        tick_us, tick = np.append(tick_us, ints[0, new_tick]), np.concatenate([tick, values[:, new_tick]], axis=1)
        if opened[0] is None:
            i = int(np.searchsorted(tick_us, start, side="left"))
            if i < len(tick_us):
                opened = int(tick_us[i]), float(tick[PRICE, i])
        out = None
        if quote.any():
            out, current, updated, mid_us, mid = released(ints[:, quote], values[:, quote], tick_us, tick, mid_us, mid, current, updated, opened)
            n = int(quote.sum())
            out |= {"market_id": np.full(n, market, object), "start_us": np.full(n, start), "end_us": np.full(n, end)}
        ints, values = ints[:, ~ready], values[:, ~ready]
        if passed >= end and not ints.shape[1]:
            return out, None, None
        # the look-backs of updates still to come, and the last value before them
        cut = min(int(np.searchsorted(tick_us, passed - past, side="left")) - 1, len(tick_us) - max(VOLS))
        tick_us, tick = tick_us[max(cut, 0) :], tick[:, max(cut, 0) :]
        cut = max(int(np.searchsorted(mid_us, passed - max(MOVES) * unit, side="left")) - 1, 0)
        due = int(ints[0].min()) if ints.shape[1] else end
        return out, due, (ints, values, tick_us, tick, mid_us[cut:], mid[cut:], current, updated, opened, start, end)

    def step(bucket: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = state.getCurrentWatermarkMs() * 1000  # everything before this is here
        held = {m: (due, kept) for m, due, kept in zip(*state.get)} if state.exists else {}
        new, late = {}, {}
        if not state.hasTimedOut:
            pdf = pd.concat(list(parts), ignore_index=True)
            pdf = pdf[pdf["market_id"].notna()].sort_values("market_id", kind="stable")  # others are heartbeats
            if len(pdf):
                names, times = pdf["market_id"].to_numpy(object), pdf["us"].to_numpy(np.int64)
                ints, values = pdf[list(INTS)].to_numpy(np.int64).T, pdf[VALUES].to_numpy(float).T
                starts, ends = pdf["start_us"].to_numpy(np.int64), pdf["end_us"].to_numpy(np.int64)
                for first, end in zip(*(x.tolist() for x in runs(names))):
                    here = np.flatnonzero(times[first:end] >= passed) + first
                    new[names[first]] = ints[:, here], values[:, here], int(starts[end - 1]), int(ends[end - 1])
                    if len(here) < end - first:
                        late[names[first]] = end - first - len(here)
        if late:
            rows = pd.DataFrame({f.name: pd.Series([None] * len(late), dtype=object) for f in STATE_ROW.fields})
            rows["market_id"], rows["late_rows"] = list(late), list(late.values())
            yield rows
        found = []
        for market in [*new, *(m for m, (due, _) in held.items() if due <= passed and m not in new)]:
            more = new.get(market)
            kept = pickle.loads(held[market][1]) if market in held else _nothing(*more[2:])
            if more is not None:
                kept = (*kept[:-2], *more[2:])
            out, due, kept = advance(market, kept, more, passed)
            if out is not None:
                found.append(out)
            if due is None:
                held.pop(market, None)
            else:
                held[market] = due, pickle.dumps(kept, protocol=pickle.HIGHEST_PROTOCOL)
        if found:
            rows = pd.DataFrame({n: np.concatenate([x[n] for x in found]) for n in found[0]})
            rows = rows.astype({f"{s}_update_us": "Int64" for s in SIDES}).assign(late_rows=pd.Series([None] * len(rows), dtype="Int64"))
            yield rows[[f.name for f in STATE_ROW.fields]]
        if held:
            state.update((list(held), [due for due, _ in held.values()], [kept for _, kept in held.values()]))
            state.setTimeoutTimestamp(max(min(due for due, _ in held.values()) // 1000, state.getCurrentWatermarkMs()) + 1)
        elif state.exists:
            state.remove()

    def released(ints, values, tick_us, tick, mid_us, mid, current, updated, opened):
        """Columns of the updates given, and the values after them."""
        us, yes = ints[0], ints[4] == 1
        out: dict[str, np.ndarray] = {"ts_us": us, "row_id": ints[3]}
        moved = ~(np.isnan(values[0]) & np.isnan(values[1]))
        both = np.concatenate([np.where(own, values, np.nan) for own in (yes, ~yes)] + [np.where([yes & moved, ~yes & moved], us, np.nan)])
        both = np.concatenate([np.append(current, updated)[:, None], both], axis=1)
        places = np.maximum.accumulate(np.where(np.isnan(both), 0, np.arange(both.shape[1])), axis=1)
        both = np.take_along_axis(both, places, axis=1)
        out |= dict(zip([*CURRENT, *(f"{s}_update_us" for s in SIDES)], both[:, 1:]))
        after, stamps = both[: len(CURRENT), -1], both[len(CURRENT) :, -1]
        yes_mid = (out["yes_bid"] + out["yes_ask"]) / 2
        known = ~np.isnan(yes_mid)
        mid_us, mid = np.append(mid_us, us[known]), np.append(mid, yes_mid[known])
        for m in MOVES:
            out[f"yes_mid_lag_{m}"] = _at(mid, np.searchsorted(mid_us, us - m * unit, side="right") - 1)
        upto = np.searchsorted(tick_us, us, side="right")
        for c, name in enumerate(TICK[: PRICE + 1]):
            out[f"ref_{name}"] = _at(tick[c], upto - 1)
        out["open_price"] = np.full(len(us), np.nan) if opened[0] is None else np.where(us >= opened[0], opened[1], np.nan)
        for s in LAGS:
            out[f"ref_lag_{s}"] = _at(tick[PRICE], np.searchsorted(tick_us, us - s * unit, side="right") - 1)
        returns = np.diff(np.log(tick[PRICE]))
        for n in VOLS:  # of the last n prices
            out[f"ref_vol_{n}"] = window_deviation(returns, np.maximum(upto - n, 0), upto - 1)
        signed = np.nan_to_num(tick[SIGNED])
        sums = {what: np.append(0.0, np.cumsum(x)) for what, x in (("buy", np.maximum(signed, 0)), ("sell", np.maximum(-signed, 0)), ("count", signed != 0))}
        for s in FLOWS:
            first = np.searchsorted(tick_us, us - s * unit, side="left")
            for what, total in sums.items():
                moved_by = total[upto] - total[first]
                out[f"ref_{what}_{s}"] = moved_by.astype(np.int64) if what == "count" else moved_by
        return out, after, stamps, mid_us, mid

    bucketed = rows.withColumn("__bucket", F.pmod(F.xxhash64("market_id"), F.lit(BUCKETS)))
    return bucketed.groupBy("__bucket").applyInPandasWithState(step, STATE_ROW, HELD, "append", GroupStateTimeout.EventTimeTimeout)


def live_vector(state: DataFrame, *, ttl_seconds: float) -> DataFrame:
    """The base features of every update and the derived ones, as columns on ``live_state``.

    ``complete`` says whether a model may score the row: both mids and a reference price are
    known and the market is open. The probability is 0.5 while it cannot be computed. Changes
    of the no side's mid are null, as live scoring has them.
    """
    known = state.where("row_id IS NOT NULL").drop("late_rows")
    t, cols = F.col, {}
    cols["time_to_expiry_seconds"] = (t("end_us") - t("ts_us")) / 1e6
    cols["time_elapsed_seconds"] = (t("ts_us") - t("start_us")) / 1e6
    for s in SIDES:
        bid, ask, age = t(f"{s}_bid"), t(f"{s}_ask"), (t("ts_us") - t(f"{s}_update_us")) / 1e6
        cols[f"{s}_mid"] = (bid + ask) / 2
        cols[f"{s}_spread"] = ask - bid
        cols[f"{s}_depth_imbalance"] = fn.imbalance(f"{s}_bid_depth", f"{s}_ask_depth")
        cols[f"{s}_size_imbalance"] = fn.imbalance(f"{s}_bid_size", f"{s}_ask_size")
        cols[f"{s}_quote_age_seconds"] = age
        cols[f"{s}_is_stale"] = bid.isNull() | ask.isNull() | age.isNull() | (age > ttl_seconds)
        cols[f"{s}_crossed"] = F.coalesce(bid > ask, F.lit(False))
    out = known.withColumns(cols)
    price, opened, size_sum = t("ref_price"), t("open_price"), t("ref_bid_size") + t("ref_ask_size")
    micro = F.when(size_sum > 0, (t("ref_ask") * t("ref_bid_size") + t("ref_bid") * t("ref_ask_size")) / size_sum)
    cols = {f"pair_{kind}_sum": t(f"yes_{kind}") + t(f"no_{kind}") for kind in ("bid", "ask", "mid")}
    cols |= {f"yes_mid_change_{m}s": t("yes_mid") - t(f"yes_mid_lag_{m}") for m in MOVES}
    cols |= {f"no_mid_change_{m}s": F.lit(None).cast("double") for m in MOVES}
    cols |= {f"ref_return_{s}s": F.when(t(f"ref_lag_{s}") != 0, price / t(f"ref_lag_{s}") - 1.0) for s in LAGS}
    cols |= {f"ref_vol_{n}s": t(f"ref_vol_{n}") for n in VOLS}
    for s in FLOWS:
        buy, sell = t(f"ref_buy_{s}"), t(f"ref_sell_{s}")
        cols |= {f"ref_net_{s}s": buy - sell, f"ref_total_{s}s": buy + sell, f"ref_imbalance_{s}s": F.when(buy + sell > 0, (buy - sell) / (buy + sell))}
    cols |= {
        "ref_spread": t("ref_ask") - t("ref_bid"),
        "ref_depth_imbalance": fn.imbalance("ref_bid_size", "ref_ask_size"),
        "ref_microprice_minus_mid": micro - price,
        "return_since_open": F.when(opened != 0, price / opened - 1.0),
        "distance_to_open": price - opened,
        "seconds_since_update": (t("ts_us") - F.greatest("yes_update_us", "no_update_us")) / 1e6,
        "formula_p_yes": F.coalesce(fn.formula_probability("ref_price", "open_price", "ref_vol_60", "time_to_expiry_seconds"), F.lit(0.5)),
        "complete": t("yes_mid").isNotNull() & t("no_mid").isNotNull() & price.isNotNull() & (t("time_elapsed_seconds") >= 0) & (t("time_to_expiry_seconds") > 0),
        "quote_bad": t("yes_is_stale") | t("no_is_stale") | t("yes_crossed") | t("no_crossed"),
    }
    out = out.withColumns(cols)
    p = t("formula_p_yes")
    out = out.withColumns({"edge_to_yes_ask": p - t("yes_ask"), "edge_to_no_ask": (1.0 - p) - t("no_ask"), "formula_p_yes_minus_yes_mid": p - t("yes_mid")})
    return derived_features(out, live=True)
