"""Streaming queries, run over everything available; checked against the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import evaluate as ce
from tidemark.catalog import views as v
from tidemark.operators.gates import SignalRules, signal_rules
from tidemark.session import workspace_dir
from tidemark.streaming import commits, features, outcomes, replay, signals, sources, state, vector

BATCHES, FILES = 3, 4


def event_stream(spark, sf):
    """The events as a stream: batches of several files each, in time order."""
    ev = v.table(spark, sf, "events")
    path = workspace_dir(spark, "event_files")
    lo, hi = ev.agg(F.min("ts"), F.max("ts")).first()
    _in_batches(ev, F.col("ts"), lo, hi, path)
    return sources.file_stream(spark, path, ev.schema, files_per_batch=FILES).withColumn(
        "k", F.get_json_object("props", "$.k").cast("int")
    )


def _in_batches(rows, arrival, lo, hi, path):
    """Rows written as files of a few batches, by their time of arrival; those without one come first."""
    if lo is None:
        rows.write.mode("append").parquet(path)
        return
    cuts = [lo + (hi - lo) * i / BATCHES for i in range(1, BATCHES)]
    for i in range(BATCHES):
        after = arrival >= F.lit(cuts[i - 1]) if i else F.lit(True)
        before = arrival < F.lit(cuts[i]) if i < BATCHES - 1 else F.lit(True)
        here = after & before if i else F.coalesce(before, F.lit(True))
        rows.where(here).repartition(FILES).write.mode("append").parquet(path)


HEARTBEAT = "heartbeat"


def unordered_stream(spark, sf, late_s, quiet_s):
    """The events as a stream whose rows come up to ``late_s`` seconds late, then a heartbeat ``quiet_s`` after the last."""
    ev = v.table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    path = workspace_dir(spark, "unordered_files")
    arrival = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(late_s * 1_000_000)))
    arrival = arrival.cast(ev.schema["ts"].dataType)
    lo, hi = ev.agg(F.min(arrival), F.max(arrival)).first()
    _in_batches(ev, arrival, lo, hi, path)
    if hi is not None:
        beat = ev.agg(F.max("ts").alias("ts")).select(
            F.lit(None).cast("bigint").alias("event_id"), (F.col("ts") + F.expr(f"INTERVAL {quiet_s} SECOND")).alias("ts"),
            F.lit(None).cast(ev.schema["user_id"].dataType).alias("user_id"), F.lit(HEARTBEAT).alias("event_type"), F.lit(None).cast("double").alias("value"),
        )
        beat.coalesce(1).write.mode("append").parquet(path)
    return sources.file_stream(spark, path, ev.schema, files_per_batch=FILES)


SYMBOLS = 16  # reference instruments; users follow one of them


def _symbol():
    return (F.col("user_id") % SYMBOLS).cast("string")


def _us(col, name):
    return F.timestamp_micros(F.col(col)).cast("timestamp_ntz").alias(name)


def _quote_stream(spark, sf):
    ev = event_stream(spark, sf).where("event_type IN ('view', 'click', 'error')")
    kind = F.col("event_type")
    price = F.col("value") / 500
    ok = lambda c: F.when(c.between(0.0, 1.0), c)
    rows = ev.select(
        F.col("user_id").cast("string").alias("market_id"),
        F.concat(F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, "-Y").otherwise("-N")).alias("asset_id"),
        F.col("ts").alias("ts_event"), F.col("event_id").alias("row_id"),
        F.when(kind == "view", "orderbook").otherwise("price_change").alias("source"),
        ok(F.when(kind == "view", price)).alias("update_bid"),
        ok(F.when(kind == "view", price + 0.02).when(kind == "click", price + 0.01)).alias("update_ask"),
        F.when(kind == "view", F.col("k").cast("double")).alias("update_bid_size"),
        F.when(kind == "view", (F.col("k") % 7 + 1).cast("double")).alias("update_ask_size"),
        ok(F.when(kind == "error", price)).alias("last_trade_price"),
    )
    return rows


def stream_pair_state(spark, sf):
    """Both sides of each market after every event of either side."""
    rows = _quote_stream(spark, sf).withColumn("direction", F.when(F.col("asset_id").endswith("-Y"), "UP").otherwise("DOWN"))
    out = sources.drain(state.pair_state(rows), "stream_pair_state")
    return out.select(
        "market_id", F.col("row_id").alias("event_id"), "yes_bid", "yes_ask", "no_bid", "no_ask", "yes_bid_size", "no_ask_size",
        _us("yes_update_us", "yes_update_ts"), _us("no_update_us", "no_update_ts"),
    )


TTL = 86_400.0


def stream_features(spark, sf):
    """Base features of each market after every quote event."""
    rows = _quote_stream(spark, sf).withColumn("direction", F.when(F.col("asset_id").endswith("-Y"), "UP").otherwise("DOWN"))
    out = sources.drain(features.live_features(rows, ttl_seconds=TTL), "stream_features")
    return out.select(
        "market_id", F.col("row_id").alias("event_id"), *[F.round(c, 8).alias(c) for c in ("yes_mid", "no_spread", "yes_quote_age_seconds", "pair_ask_sum", "mid_difference")],
        "yes_is_stale", "no_crossed", "quote_bad",
    )


def stream_market_opens(spark, sf):
    """First price of the symbol after each user's first event: the market's open price."""
    u = v.table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("market_start_ts"), F.max("ts").alias("market_end_ts"))
    m = u.select(_symbol().alias("symbol"), F.col("user_id").cast("string").alias("market_id"), "market_start_ts", "market_end_ts")
    px = event_stream(spark, sf).where("event_type <> 'signup'").select(_symbol().alias("symbol"), "ts", "event_id", "value")
    path = workspace_dir(spark, "stream_opens")
    features.market_opens(px, m, f"{path}/table", f"{path}/checkpoint", on="symbol", ts="ts", tie="event_id", price="value").awaitTermination()
    out = features.opened_markets(px, m, f"{path}/table", ts="ts", price="value")
    return out.select("market_id", v.naive("open_seen_ts"), "open_price")


def stream_settlement(spark, sf):
    """Sign-ups in markets that began six hours before, settled on the price of their symbol after a day."""

    def signals(ev):
        return ev.where("event_type = 'signup'").select(
            _symbol().alias("series"), F.col("event_id").alias("signal_id"), F.col("user_id").cast("string").alias("market_id"),
            F.when(F.col("event_id") % 2 == 0, "UP").otherwise("DOWN").alias("direction"), F.lit(0.5).alias("entry_price"),
            (F.col("ts") - F.expr("INTERVAL 6 HOUR")).alias("start_ts"), (F.col("ts") + F.expr("INTERVAL 18 HOUR")).alias("end_ts"), "ts",
        )

    ev = event_stream(spark, sf)
    px = ev.where("event_type <> 'signup'").select(_symbol().alias("series"), F.col("event_id").alias("row_id"), "ts", F.col("value").alias("price"))
    out = sources.drain(state.settle_at_end(signals(ev), px, span_s=86_400), "stream_settlement")
    every = state.with_open(out, signals(v.table(spark, sf, "events")).select("signal_id", "market_id", "direction"))
    return every.select("signal_id", "market_id", "direction", "open_price", "close_price", "settled_yes", "pnl")


def stream_quote_state(spark, sf):
    out = sources.drain(state.quote_state(_quote_stream(spark, sf)), "stream_quote_state")
    return out.select(
        "market_id", "asset_id", _us("ts_us", "ts_event"), "current_bid", "current_ask", "current_bid_size", "current_ask_size",
        _us("last_quote_update_us", "last_quote_update_ts"), "last_trade_price",
    )


def _signals(spark, sf, threshold=0.5):
    """Signals of both sides."""
    up = F.round(1 - F.exp(-F.col("value") / 50), 4)
    sides = F.array(F.struct(F.lit("UP").alias("direction"), up.alias("probability")), F.struct(F.lit("DOWN").alias("direction"), F.round(1 - up, 4).alias("probability")))
    ev = event_stream(spark, sf)
    both = ev.select("event_id", F.col("user_id").cast("string").alias("market_id"), F.col("ts").alias("sample_ts"), F.inline(sides))
    return both.where(F.col("probability") >= threshold)


def stream_cooldown(spark, sf):
    out = state.throttle(_signals(spark, sf), keys=["market_id", "direction"], ts="sample_ts", tie="event_id", seconds=21_600)
    return sources.drain(out, "stream_cooldown").select("event_id", "market_id", "direction", v.naive("sample_ts"))


def stream_first_accept(spark, sf):
    out = state.first_only(_signals(spark, sf, 0.7), keys=["market_id", "direction"], ts="sample_ts", tie="event_id")
    return sources.drain(out, "stream_first").select("market_id", "direction", "event_id", v.naive("sample_ts"))


def _samples(spark, sf):
    """Scored samples of both sides with what the signal rules look at."""
    up = F.round(1 - F.exp(-F.col("value") / 50), 4)
    sides = F.array(F.struct(F.lit("UP").alias("direction"), up.alias("probability")), F.struct(F.lit("DOWN").alias("direction"), F.round(1 - up, 4).alias("probability")))
    ev = event_stream(spark, sf)
    return ev.select(
        "event_id", F.col("user_id").cast("string").alias("market_id"), F.col("ts").alias("sample_ts"), F.inline(sides),
        (300 - F.unix_timestamp("ts") % 300).cast("double").alias("time_to_expiry_seconds"), (F.col("event_id") % 11 == 0).alias("quote_bad"),
        F.when(F.col("event_id") % 17 != 0, (F.col("event_id") % 6) / 100).alias("spread"),
    )


CONFIGS = {
    "wide": SignalRules("wide", threshold=0.5, min_tte=30, max_spread=0.05),
    "narrow": SignalRules("narrow", threshold=0.8, min_tte=60, max_tte=240, max_spread=0.02),
}


def stream_signals(spark, sf):
    """Two configurations of rules on the stream, each signal followed by twelve hours of cooldown."""
    rules = {n: signal_rules(r) for n, r in CONFIGS.items()}
    out = signals.emitted(_samples(spark, sf), rules, ts="sample_ts", tie="event_id", cooldown_seconds=43_200, received="sample_ts")
    out = sources.drain(out, "stream_signals")
    return out.select("config", "market_id", "direction", "event_id", "probability", (F.col("latency_ms") > 0).alias("late"))


def stream_candidates(spark, sf):
    """Samples that pass, and those that only miss the probability by a little."""
    rules = {n: signal_rules(r) for n, r in CONFIGS.items()}
    near = (F.col("reject_reason") == "probability_below_threshold") & (F.col("probability") >= 0.45)
    out = sources.drain(signals.candidates(_samples(spark, sf), rules, near=near), "stream_candidates")
    return out.select("config", "market_id", "direction", "event_id", "reject_reason")


def stream_snapshots(spark, sf):
    """Samples of a market's last minute, at most one in two days."""
    rows = _samples(spark, sf).where("direction = 'UP'").drop("direction")
    out = signals.near_expiry(rows, left="time_to_expiry_seconds", within_seconds=60, every_seconds=172_800, ts="sample_ts", tie="event_id")
    return sources.drain(out, "stream_snapshots").select("market_id", "event_id", "time_to_expiry_seconds")


def stream_hourly_limit(spark, sf):
    """At most three decisions per user in any six hours."""
    s = event_stream(spark, sf).select("event_id", "user_id", "ts")
    out = state.hourly_limit(s, keys=["user_id"], ts="ts", tie="event_id", limit=3, window_seconds=21_600)
    return sources.drain(out, "stream_limit").select("event_id", "user_id")


def stream_tick_features(spark, sf):
    ev = event_stream(spark, sf)
    side = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", -1).otherwise(0)
    ticks = ev.select("event_id", "ts", _symbol().alias("symbol"), (F.col("value") + 100).alias("price"), F.col("k").alias("qty"), side.alias("side"))
    out = state.tick_features(
        ticks, key="symbol", ts="ts", tie="event_id", price="price", qty="qty", side="side",
        lags_s=(60, 3_600), flows_s=(600, 3_600), vol_ticks=20, history_s=14_400,
    )
    out = sources.drain(out, "stream_ticks")
    return out.select(F.col("row_id").alias("event_id"), F.round("vol_ticks", 9).alias("vol_ticks"), "price_lag_60s", "price_lag_3600s", *[F.round(c, 6).alias(c) for c in ("buy_600s", "sell_600s", "buy_3600s", "sell_3600s")], "history_rows")


def stream_tick_volatility(spark, sf):
    """Volatility over the last 30 ticks, hour and day of each user's series."""
    ticks = event_stream(spark, sf).select("event_id", "ts", "user_id", (F.col("value") + 100).alias("price"), F.lit(0.0).alias("qty"), F.lit(0).alias("side"))
    out = state.tick_features(
        ticks, key="user_id", ts="ts", tie="event_id", price="price", qty="qty", side="side",
        lags_s=(3_600,), flows_s=(3_600,), vol_ticks=30, vol_seconds=(86_400, 345_600), history_s=345_600,
    )
    out = sources.drain(out, "stream_tick_volatility")
    return out.select(F.col("row_id").alias("event_id"), *[F.round(c, 9).alias(c) for c in ("vol_86400s", "vol_345600s")])


def stream_outcomes(spark, sf):
    ev = event_stream(spark, sf)
    m = F.col("user_id").cast("string")
    pick = lambda rows: rows.where("event_type = 'signup'").select(m.alias("market_id"), F.col("event_id").alias("signal_id"), "ts")
    quo = ev.where("event_type IN ('view', 'click')").select(
        m.alias("market_id"), F.col("event_id").alias("row_id"), "ts", (F.col("value") / 500).alias("bid"), (F.col("value") / 500 + 0.02).alias("ask")
    )
    out = sources.drain(state.resolve_outcomes(pick(ev), quo, latency_ms=3_600_000, horizon_s=86_400, expire_s=172_800), "stream_outcomes")
    out = state.with_open(out, pick(v.table(spark, sf, "events")).select("market_id", "signal_id"))
    return out.select("market_id", "signal_id", _us("entry_us", "entry_ts"), "entry_price", _us("exit_us", "exit_ts"), "exit_price", F.round("pnl", 9).alias("pnl"))


LATE_S, LATENCY_S, HORIZON_S, EXPIRE_S = 7_200, 3_600, 86_400, 172_800


def stream_delayed_outcomes(spark, sf):
    """Outcomes of signals of both sides from a feed out of order; every signal closes by exit or by timer."""
    ev = unordered_stream(spark, sf, LATE_S, 2 * LATE_S + LATENCY_S + HORIZON_S + EXPIRE_S)
    m, i, bid = F.col("user_id").cast("string"), F.col("event_id"), F.col("value") / 500
    sig = ev.where("event_type = 'signup'").select(
        m.alias("market_id"), i.alias("signal_id"), "ts", F.when(i % 3 == 0, "DOWN").otherwise("UP").alias("direction")
    )
    ask = bid + 0.02
    quo = ev.where("event_type IN ('view', 'click')").select(
        m.alias("market_id"), i.alias("row_id"), "ts",
        F.when(i % 17 != 0, bid).alias("yes_bid"), F.when(i % 13 != 0, ask).alias("yes_ask"),
        F.when(i % 13 != 0, 1 - ask).alias("no_bid"), F.when(i % 17 != 0, 1 - bid).alias("no_ask"),
        (i % 7 == 0).alias("yes_stale"), (i % 11 == 0).alias("yes_crossed"), (i % 5 == 0).alias("no_stale"), (i % 19 == 0).alias("no_crossed"),
    )
    out = outcomes.delayed_outcomes(
        sig, quo, latency_ms=LATENCY_S * 1000, horizon_s=HORIZON_S, expire_s=EXPIRE_S, delay=f"{LATE_S} seconds",
        clock=ev.where(F.col("event_type") == HEARTBEAT).select("ts"),
    )
    out = outcomes.with_result(sources.drain(out, "stream_delayed_outcomes"), shares=6.0)
    flags = ("entry_quote_stale", "entry_crossed_quote", "exit_quote_stale", "exit_crossed_quote")
    return out.select(
        "market_id", "signal_id", "direction", "closed_by", _us("entry_us", "entry_ts"), _us("exit_us", "exit_ts"), *flags,
        *[F.round(c, 9).alias(c) for c in ("entry_price", "exit_price", "pnl", "roi", "entry_fee", "exit_fee", "net_pnl", "net_pnl_total")],
    )


PERIOD_S, STEP_S = 864_000, 10_800  # a market is ten days of a user; three hours stand for the vector's second
VECTOR = (
    "yes_mid", "no_spread", "yes_depth_imbalance", "no_quote_age_seconds", "pair_mid_sum", "yes_mid_change_5s", "ref_return_1s", "ref_return_30s",
    "ref_vol_10s", "ref_vol_60s", "ref_net_5s", "ref_imbalance_30s", "ref_microprice_minus_mid", "distance_to_open", "log_tte", "time_frac_elapsed",
    "pair_ask_overround", "sum_quote_age", "btc_ret_1m5_reversal", "btc_trade_imb_1m5", "log_yes_ask_bid_depth_ratio", "btc_ret5_x_logtte",
)


def _period():
    return F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (PERIOD_S * 1_000_000))


def stream_feature_vector(spark, sf):
    """The live feature vector of every quote update, from feeds out of order; the user's other events are the instrument's ticks."""
    ev = unordered_stream(spark, sf, LATE_S, 2 * LATE_S + PERIOD_S)
    i, price, kind = F.col("event_id"), F.col("value") + 50, F.col("event_type")
    market = F.concat_ws("|", "user_id", _period().cast("string")).alias("market_id")
    view = lambda c: F.when(kind == "view", c)
    quo = ev.where("event_type IN ('view', 'click')").select(
        market, i.alias("row_id"), "ts", F.when(i % 2 == 0, "yes").otherwise("no").alias("side"), F.lit(0).alias("prio"),
        view(F.col("value") / 500).alias("bid"), F.when(i % 13 != 0, F.col("value") / 500 + 0.02).alias("ask"),
        view(i % 100).alias("bid_size"), view(i % 7).alias("ask_size"), view(i % 50 + 1).alias("bid_depth"), view(i % 30 + 1).alias("ask_depth"),
    )
    tic = ev.where("event_type IN ('purchase', 'error', 'signup')").select(
        F.col("user_id").cast("string").alias("instrument"), i.alias("row_id"), "ts", (price - 1).alias("bid"), (price + 1).alias("ask"),
        (i % 9).alias("bid_size"), (i % 4).alias("ask_size"), price.alias("price"), F.when(kind == "purchase", i % 5 + 1).when(kind == "error", -(i % 3 + 1)).alias("signed_qty"),
    )
    begin = lambda n: F.timestamp_seconds((_period() + n) * PERIOD_S)
    markets = v.table(spark, sf, "events").where("ts IS NOT NULL").select(
        market, F.col("user_id").cast("string").alias("instrument"), begin(0).alias("start_ts"), begin(1).alias("end_ts")
    )
    state_rows = vector.live_state(
        quo, tic, markets.distinct(), unit_s=STEP_S, delay=f"{LATE_S} seconds", clock=ev.where(kind == HEARTBEAT).select("ts")
    )
    out = vector.live_vector(sources.drain(state_rows, "stream_feature_vector"), ttl_seconds=TTL)
    return out.select("market_id", F.col("row_id").alias("event_id"), "complete", *[F.round(c, 7).alias(c) for c in VECTOR])


def stream_committed_days(spark, sf):
    """Events appended by date in committed batches, read back: rows of the table and of its manifest."""
    rows = event_stream(spark, sf).where("ts IS NOT NULL").select("event_id", "ts", "value", F.date_format("ts", "yyyy-MM-dd").alias("date"))
    path = workspace_dir(spark, "committed")
    commits.append_committed(rows, f"{path}/table", f"{path}/checkpoint", partition_by=["date"]).awaitTermination()
    table = commits.read_committed(spark, f"{path}/table", rows.schema, ["date"])
    listed = commits.manifest(spark, f"{path}/table", rows.schema, ["date"]).groupBy("date").agg(F.sum("rows").alias("manifest_rows"))
    found = table.groupBy("date").agg(F.count("*").alias("rows"), F.count_distinct("event_id").alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return found.join(listed, "date", "full")


def stream_drawdown_events(spark, sf):
    ev = event_stream(spark, sf).withColumn("pnl", F.col("value") - 50)
    out = sources.drain(state.drawdown_events(ev, account="user_id", ts="ts", tie="event_id", pnl="pnl", threshold=50.0), "stream_drawdown")
    return out.select("account", F.col("row_id").alias("event_id"), *[F.round(c, 4).alias(c) for c in ("cum_pnl", "peak_pnl", "drawdown")], "level")


def stream_context(spark, sf):
    ev = event_stream(spark, sf).withColumn("wanted", F.col("event_type") == "purchase")
    out = sources.drain(state.recent_context(ev, key="user_id", ts="ts", tie="event_id", value="value", wanted="wanted", last=5), "stream_context")
    return out.select(F.col("key").alias("user_id"), F.col("row_id").alias("event_id"), F.size("recent_value").cast("bigint").alias("n"), F.round(F.aggregate("recent_value", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def stream_flow(spark, sf):
    """Hourly flow; windows the watermark has passed."""
    ev = event_stream(spark, sf).where("event_type IN ('purchase', 'signup')")
    tr = ev.select(
        _symbol().alias("symbol"), F.col("ts").alias("ts_event"),
        F.when(F.col("event_type") == "purchase", "buy_aggressor").otherwise("sell_aggressor").alias("side"), F.col("k").cast("double").alias("qty"),
    )
    out = sources.drain(sources.windowed_flow(tr, width="1 hour", delay="10 minutes"), "stream_flow")
    return out.select("symbol", v.naive("window_start"), "buy", "sell", "trades")


def stream_dedupe(spark, sf):
    """Ids repeat; only the first of each is kept."""
    ev = event_stream(spark, sf).select((F.col("event_id") / 2).cast("bigint").alias("signal_id"), "ts")
    return sources.drain(sources.deduplicated(ev, ids=("signal_id",), ts="ts", delay="40 days"), "stream_dedupe").select("signal_id")


def feed_staleness(spark, sf):
    ev = v.table(spark, sf, "events")
    last = sources.feed_staleness(ev, source="event_type", recv="ts")
    out = sources.with_staleness(last, now=F.lit("2024-01-31").cast("timestamp"), limit_seconds=600)
    return out.select("event_type", v.naive("last_recv"), "rows", "age_seconds", "is_stale")


def replay_signals(spark, sf):
    """The live rules replayed inside windows around confident samples."""
    p = v.predictions(spark, sf)
    windows = p.where("p_up >= 0.9").select(
        F.col("event_id").cast("string").alias("window_id"), "market_id", F.col("sample_ts").alias("center_ts"),
        (F.col("sample_ts") - F.expr("INTERVAL 1 HOUR")).alias("start_ts"), (F.col("sample_ts") + F.expr("INTERVAL 3 DAYS")).alias("end_ts"),
    )
    rows = p.select(
        "event_id", "market_id", "sample_ts", F.lit(False).alias("quote_bad"), "time_to_expiry_seconds", F.col("p_up").alias("probability"),
        (F.col("yes_ask") - F.col("yes_bid")).alias("spread"),
    )
    out = replay.replay_windows(rows, windows, rules=signal_rules(SignalRules("r", threshold=0.5, min_tte=30)), cooldown_seconds=43_200, forced=True)
    return out.select("window_id", "event_id", "is_forced")


def replay_tail(spark, sf):
    """The live rules on both sides, replayed over the last ten days of the table."""
    p = v.predictions(spark, sf)
    sides = F.array(
        F.struct(F.lit("UP").alias("direction"), F.col("p_up").alias("probability")), F.struct(F.lit("DOWN").alias("direction"), F.col("p_down").alias("probability"))
    )
    rows = p.select(
        "event_id", "market_id", "sample_ts", F.lit(False).alias("quote_bad"), "time_to_expiry_seconds", (F.col("yes_ask") - F.col("yes_bid")).alias("spread"), F.inline(sides)
    )
    rules = signal_rules(SignalRules("r", threshold=0.5, min_tte=30))
    out = replay.replay_tail(rows, keys=["market_id", "direction"], rules=rules, cooldown_seconds=43_200, minutes=14_400)
    return out.select("market_id", "direction", "event_id")


QUERIES = {
    n: f for n, f in list(globals().items())
    if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_") and n not in ("event_stream", "unordered_stream")
}

_SAMPLES = f"""{v.PRED}, x AS (SELECT event_id, market_id, sample_ts, 'UP' AS direction, p_up AS p, time_to_expiry_seconds AS tte, CASE WHEN event_id % 17 <> 0 THEN (event_id % 6) / 100.0 END AS sp FROM pred
        UNION ALL SELECT event_id, market_id, sample_ts, 'DOWN', p_down, time_to_expiry_seconds, CASE WHEN event_id % 17 <> 0 THEN (event_id % 6) / 100.0 END FROM pred),
      g AS (SELECT 'wide' AS config, *, CASE WHEN event_id % 11 = 0 THEN 'quote_stale' WHEN tte < 30 THEN 'tte_too_low' WHEN p < 0.5 THEN 'probability_below_threshold' WHEN sp IS NULL OR sp > 0.05 THEN 'spread_too_wide' END AS reason FROM x
        UNION ALL SELECT 'narrow', *, CASE WHEN event_id % 11 = 0 THEN 'quote_stale' WHEN tte < 60 THEN 'tte_too_low' WHEN tte > 240 THEN 'tte_too_high' WHEN p < 0.8 THEN 'probability_below_threshold' WHEN sp IS NULL OR sp > 0.02 THEN 'spread_too_wide' END FROM x)"""

ORACLES = {
    "stream_features": f"""WITH {v.QUOTES.replace("ts AS ts_event,", "ts AS ts_event, event_id,", 1)},
      f AS (SELECT market_id, event_id, ts_event, {", ".join(f"last_value(CASE WHEN asset_id LIKE '%-{a}' THEN update_{c} END IGNORE NULLS) OVER w AS {s}_{c}" for s, a in (("yes", "Y"), ("no", "N")) for c in ("bid", "ask"))},
        {", ".join(f"last_value(CASE WHEN asset_id LIKE '%-{a}' AND (update_bid IS NOT NULL OR update_ask IS NOT NULL) THEN ts_event END IGNORE NULLS) OVER w AS {s}_u" for s, a in (("yes", "Y"), ("no", "N")))}
        FROM quotes WINDOW w AS (PARTITION BY market_id ORDER BY ts_event ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
      g AS (SELECT *, {", ".join(f"(epoch_us(ts_event) - epoch_us({s}_u)) / 1e6 AS {s}_age, coalesce({s}_bid > {s}_ask, false) AS {s}_crossed, ({s}_bid + {s}_ask) / 2 AS {s}_mid" for s in ("yes", "no"))} FROM f),
      h AS (SELECT *, {", ".join(f"{s}_bid IS NULL OR {s}_ask IS NULL OR {s}_u IS NULL OR {s}_age > {TTL} AS {s}_stale" for s in ("yes", "no"))} FROM g)
      SELECT market_id, event_id, round(yes_mid, 8) AS yes_mid, round(no_ask - no_bid, 8) AS no_spread, round(yes_age, 8) AS yes_quote_age_seconds, round(yes_ask + no_ask, 8) AS pair_ask_sum,
        round(yes_mid - no_mid, 8) AS mid_difference, yes_stale AS yes_is_stale, no_crossed, yes_stale OR no_stale OR yes_crossed OR no_crossed AS quote_bad FROM h""",
    "stream_market_opens": f"""WITH m AS (SELECT user_id, user_id % {SYMBOLS} AS s, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1), p AS (SELECT user_id % {SYMBOLS} AS s, ts, event_id, value FROM events WHERE event_type <> 'signup')
      SELECT CAST(m.user_id AS VARCHAR) AS market_id, min(p.ts) AS open_seen_ts, arg_min(p.value, (p.ts, p.event_id)) AS open_price FROM m JOIN p ON p.s = m.s AND p.ts >= m.a AND p.ts < m.b GROUP BY 1""",
    "stream_signals": f"""WITH RECURSIVE {_SAMPLES}, s AS (SELECT * FROM g WHERE reason IS NULL),
      kept AS (SELECT config, market_id, direction, min(sample_ts) AS sample_ts FROM s GROUP BY 1, 2, 3 UNION ALL
        SELECT k.config, k.market_id, k.direction, min(s.sample_ts) FROM kept k JOIN s ON s.config = k.config AND s.market_id = k.market_id AND s.direction = k.direction AND s.sample_ts >= k.sample_ts + INTERVAL 12 HOUR GROUP BY 1, 2, 3)
      SELECT s.config, s.market_id, s.direction, s.event_id, s.p AS probability, true AS late FROM s JOIN kept k ON k.config = s.config AND k.market_id = s.market_id AND k.direction = s.direction AND k.sample_ts = s.sample_ts""",
    "stream_candidates": f"WITH {_SAMPLES} SELECT config, market_id, direction, event_id, reason AS reject_reason FROM g WHERE reason IS NULL OR reason = 'probability_below_threshold' AND p >= 0.45",
    "stream_snapshots": f"""WITH RECURSIVE {v.PRED}, s AS (SELECT * FROM pred WHERE time_to_expiry_seconds BETWEEN 0 AND 60),
      kept AS (SELECT market_id, min(sample_ts) AS sample_ts FROM s GROUP BY 1 UNION ALL SELECT k.market_id, min(s.sample_ts) FROM kept k JOIN s ON s.market_id = k.market_id AND s.sample_ts >= k.sample_ts + INTERVAL 2 DAY GROUP BY 1)
      SELECT s.market_id, s.event_id, s.time_to_expiry_seconds FROM s JOIN kept k ON k.market_id = s.market_id AND k.sample_ts = s.sample_ts""",
    "stream_pair_state": f"""WITH {v.QUOTES.replace("ts AS ts_event,", "ts AS ts_event, event_id,", 1)}
      SELECT market_id, event_id, {", ".join(f"last_value(CASE WHEN asset_id LIKE '%-{a}' THEN update_{c} END IGNORE NULLS) OVER w AS {s}_{c}" for s, a, c in (("yes", "Y", "bid"), ("yes", "Y", "ask"), ("no", "N", "bid"), ("no", "N", "ask"), ("yes", "Y", "bid_size"), ("no", "N", "ask_size")))},
        {", ".join(f"last_value(CASE WHEN asset_id LIKE '%-{a}' AND (update_bid IS NOT NULL OR update_ask IS NOT NULL) THEN ts_event END IGNORE NULLS) OVER w AS {s}_update_ts" for s, a in (("yes", "Y"), ("no", "N")))}
      FROM quotes WINDOW w AS (PARTITION BY market_id ORDER BY ts_event ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "stream_settlement": f"""WITH p AS (SELECT user_id % {SYMBOLS} AS s, ts, value FROM events WHERE event_type <> 'signup'), e AS (SELECT max(ts) - INTERVAL 10 SECOND AS w FROM events),
      l AS (SELECT s, max(ts) AS last FROM p GROUP BY 1), s AS (SELECT event_id, user_id, user_id % {SYMBOLS} AS s, ts - INTERVAL 6 HOUR AS a, ts + INTERVAL 64802 SECOND AS b FROM events WHERE event_type = 'signup'),
      j AS (SELECT s.*, o.value AS o, c.value AS c, b < last OR b < (SELECT w FROM e) AS over FROM s LEFT JOIN l ON l.s = s.s ASOF LEFT JOIN p o ON o.s = s.s AND s.a >= o.ts ASOF LEFT JOIN p c ON c.s = s.s AND s.b >= c.ts),
      k AS (SELECT event_id, user_id, CASE WHEN over THEN o END AS open_price, CASE WHEN over THEN c END AS close_price FROM j), m AS (SELECT *, CASE WHEN open_price IS NOT NULL AND close_price IS NOT NULL THEN CAST(close_price > open_price AS BIGINT) END AS settled_yes FROM k)
      SELECT event_id AS signal_id, CAST(user_id AS VARCHAR) AS market_id, CASE WHEN event_id % 2 = 0 THEN 'UP' ELSE 'DOWN' END AS direction, open_price, close_price, settled_yes,
        CAST(CASE WHEN event_id % 2 = 0 THEN settled_yes ELSE 1 - settled_yes END - 0.5 AS DOUBLE) AS pnl FROM m""",
    "stream_quote_state": f"WITH {v.STATE} SELECT * EXCLUDE (source) FROM state",
    "stream_cooldown": ce.ORACLES["cooldown_6h"],
    "stream_first_accept": ce.ORACLES["first_signal"],
    "stream_hourly_limit": """WITH RECURSIVE n AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
      r AS (SELECT event_id, user_id, i, [ts] AS recent, true AS kept FROM n WHERE i = 1 UNION ALL
        SELECT n.event_id, n.user_id, n.i, CASE WHEN len(r.recent) < 3 OR r.recent[-3] < n.ts - INTERVAL 6 HOUR THEN list_append(r.recent, n.ts)[-3:] ELSE r.recent END, len(r.recent) < 3 OR r.recent[-3] < n.ts - INTERVAL 6 HOUR
        FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1)
      SELECT event_id, user_id FROM r WHERE kept""",
    "stream_tick_features": f"""WITH {v.EV}, t AS (SELECT event_id, user_id % {SYMBOLS} AS s, ts, value + 100 AS price, CASE event_type WHEN 'purchase' THEN k ELSE 0 END AS b, CASE event_type WHEN 'signup' THEN k ELSE 0 END AS q FROM ev),
      n AS (SELECT *, ln(price / lag(price) OVER (PARTITION BY s ORDER BY ts, event_id)) AS r, row_number() OVER (PARTITION BY s ORDER BY ts, event_id) AS i,
        count(*) OVER (PARTITION BY s ORDER BY ts RANGE BETWEEN INTERVAL 4 HOUR PRECEDING AND CURRENT ROW) AS h FROM t),
      x AS (SELECT a.event_id, count(b.r) AS c, stddev_samp(b.r) AS sd FROM n a LEFT JOIN n b ON b.s = a.s AND b.i <= a.i AND b.i > a.i - least(20, a.h) + 1 GROUP BY 1)
      SELECT t.event_id, CASE WHEN x.c > 1 THEN round(x.sd, 9) END AS vol_ticks, CASE WHEN t.ts - a.ts <= INTERVAL 4 HOUR THEN a.price END AS price_lag_60s, CASE WHEN t.ts - c.ts <= INTERVAL 4 HOUR THEN c.price END AS price_lag_3600s,
        CAST(sum(t.b) OVER w6 AS DOUBLE) AS buy_600s, CAST(sum(t.q) OVER w6 AS DOUBLE) AS sell_600s, CAST(sum(t.b) OVER w36 AS DOUBLE) AS buy_3600s, CAST(sum(t.q) OVER w36 AS DOUBLE) AS sell_3600s,
        count(*) OVER (PARTITION BY t.s ORDER BY t.ts RANGE BETWEEN INTERVAL 4 HOUR PRECEDING AND CURRENT ROW) AS history_rows
      FROM t JOIN x USING (event_id) ASOF LEFT JOIN t a ON a.s = t.s AND t.ts - INTERVAL 60 SECOND >= a.ts ASOF LEFT JOIN t c ON c.s = t.s AND t.ts - INTERVAL 3600 SECOND >= c.ts
      WINDOW w6 AS (PARTITION BY t.s ORDER BY t.ts RANGE BETWEEN INTERVAL 600 SECOND PRECEDING AND CURRENT ROW), w36 AS (PARTITION BY t.s ORDER BY t.ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW)""",
    "stream_tick_volatility": f"""WITH r AS (SELECT event_id, user_id, ts, ln(value + 100) - ln(lag(value + 100) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS r FROM events)
      SELECT event_id, {", ".join(f"round(stddev_samp(r) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL {s} SECOND PRECEDING AND CURRENT ROW), 9) AS vol_{s}s" for s in (86400, 345600))} FROM r""",
    "stream_outcomes": """WITH s AS (SELECT CAST(user_id AS VARCHAR) AS market_id, event_id AS signal_id, ts FROM events WHERE event_type = 'signup'),
      q AS (SELECT CAST(user_id AS VARCHAR) AS market_id, ts, value / 500 AS bid, value / 500 + 0.02 AS ask FROM events WHERE event_type IN ('view', 'click'))
      SELECT s.market_id, s.signal_id, r.ts AS entry_ts, r.ask AS entry_price, r.xts AS exit_ts, r.xbid AS exit_price, round(r.xbid - r.ask, 9) AS pnl
      FROM s LEFT JOIN (SELECT s.signal_id, e.ts, e.ask, x.ts AS xts, x.bid AS xbid FROM s ASOF JOIN q e ON e.market_id = s.market_id AND s.ts + INTERVAL 1 HOUR <= e.ts ASOF JOIN q x ON x.market_id = s.market_id AND s.ts + INTERVAL 25 HOUR <= x.ts) r USING (signal_id)""",
    "stream_delayed_outcomes": f"""WITH s AS (SELECT CAST(user_id AS VARCHAR) AS market_id, event_id AS signal_id, ts, CASE WHEN event_id % 3 = 0 THEN 'DOWN' ELSE 'UP' END AS direction FROM events WHERE event_type = 'signup'),
      q AS (SELECT CAST(user_id AS VARCHAR) AS market_id, ts, event_id AS i, value / 500 AS b, value / 500 + 0.02 AS a FROM events WHERE event_type IN ('view', 'click')),
      d AS (SELECT market_id, ts, 'UP' AS direction, CASE WHEN i % 17 <> 0 THEN b END AS bid, CASE WHEN i % 13 <> 0 THEN a END AS ask, i % 7 = 0 AS stale, i % 11 = 0 AS crossed FROM q
        UNION ALL SELECT market_id, ts, 'DOWN', CASE WHEN i % 13 <> 0 THEN 1 - a END, CASE WHEN i % 17 <> 0 THEN 1 - b END, i % 5 = 0, i % 19 = 0 FROM q),
      e AS (SELECT s.*, s.ts + INTERVAL {LATENCY_S + HORIZON_S} SECOND AS due, s.ts + INTERVAL {LATENCY_S + HORIZON_S + EXPIRE_S} SECOND AS last, d.ts AS ets, d.ask, d.stale, d.crossed
        FROM s ASOF LEFT JOIN (SELECT * FROM d WHERE ask IS NOT NULL) d ON d.market_id = s.market_id AND d.direction = s.direction AND s.ts + INTERVAL {LATENCY_S} SECOND <= d.ts),
      x AS (SELECT e.*, ets <= last AS entered, d.ts AS xts, d.bid, d.stale AS xstale, d.crossed AS xcrossed
        FROM e ASOF LEFT JOIN (SELECT * FROM d WHERE bid IS NOT NULL) d ON d.market_id = e.market_id AND d.direction = e.direction AND greatest(e.due, e.ets) <= d.ts),
      o AS (SELECT *, entered AND xts <= last AS exited FROM x),
      r AS (SELECT market_id, signal_id, direction, CASE WHEN exited THEN 'exit' ELSE 'expiry' END AS closed_by, CASE WHEN entered THEN ets END AS entry_ts, CASE WHEN exited THEN xts END AS exit_ts,
        CASE WHEN entered THEN stale END AS entry_quote_stale, CASE WHEN entered THEN crossed END AS entry_crossed_quote, CASE WHEN exited THEN xstale END AS exit_quote_stale, CASE WHEN exited THEN xcrossed END AS exit_crossed_quote,
        CASE WHEN entered THEN ask END AS p, CASE WHEN exited THEN bid END AS y FROM o),
      f AS (SELECT *, y - p AS g, CASE WHEN y IS NOT NULL THEN 0.07 * least(greatest(p, 0), 1) * (1 - least(greatest(p, 0), 1)) END AS ef, CASE WHEN y IS NOT NULL THEN 0.07 * least(greatest(y, 0), 1) * (1 - least(greatest(y, 0), 1)) END AS xf FROM r)
      SELECT market_id, signal_id, direction, closed_by, entry_ts, exit_ts, entry_quote_stale, entry_crossed_quote, exit_quote_stale, exit_crossed_quote, round(p, 9) AS entry_price, round(y, 9) AS exit_price,
        round(g, 9) AS pnl, round(CASE WHEN p > 0 THEN g / p END, 9) AS roi, round(ef, 9) AS entry_fee, round(xf, 9) AS exit_fee, round(g - ef - xf - 0.0025, 9) AS net_pnl, round(6.0 * (g - ef - xf - 0.0025), 9) AS net_pnl_total FROM f""",
    "stream_feature_vector": f"""WITH e AS (SELECT event_id AS i, user_id AS u, epoch_us(ts) AS us, event_type AS et, value, epoch_us(ts) // {PERIOD_S * 1_000_000} AS pd FROM events WHERE ts IS NOT NULL),
      q0 AS (SELECT u, pd, i, us, i % 2 = 0 AS yes, CASE et WHEN 'view' THEN value / 500 END AS b, CASE WHEN i % 13 <> 0 THEN value / 500 + 0.02 END AS a,
        CASE et WHEN 'view' THEN i % 50 + 1 END AS bd, CASE et WHEN 'view' THEN i % 30 + 1 END AS ad FROM e WHERE et IN ('view', 'click')),
      q1 AS (SELECT u, pd, i, us, {", ".join(f"last_value(CASE WHEN {'' if s == 'y' else 'NOT '}yes THEN {c} END IGNORE NULLS) OVER w AS {s}{c}" for s in "yn" for c in ("b", "a", "bd", "ad"))},
        {", ".join(f"last_value(CASE WHEN {'' if s == 'y' else 'NOT '}yes AND (b IS NOT NULL OR a IS NOT NULL) THEN us END IGNORE NULLS) OVER w AS {s}u" for s in "yn")}
        FROM q0 WINDOW w AS (PARTITION BY u, pd ORDER BY us, i ROWS UNBOUNDED PRECEDING)),
      q AS (SELECT *, (yb + ya) / 2 AS ym, (nb + na) / 2 AS nm, us - pd * {PERIOD_S * 1_000_000} AS el, (pd + 1) * {PERIOD_S * 1_000_000} - us AS tte,
        us - {1 * STEP_S * 1_000_000} AS l1, us - {5 * STEP_S * 1_000_000} AS l5, us - {30 * STEP_S * 1_000_000} AS l30 FROM q1),
      t0 AS (SELECT m.u, m.pd, e.us, e.i, e.value + 50 AS p, CASE et WHEN 'purchase' THEN i % 5 + 1 ELSE 0 END AS buy, CASE et WHEN 'error' THEN i % 3 + 1 ELSE 0 END AS sell
        FROM (SELECT DISTINCT u, pd FROM e) m JOIN e ON e.u = m.u AND e.us >= m.pd * {PERIOD_S * 1_000_000} - {30 * STEP_S * 1_000_000} AND e.us < (m.pd + 1) * {PERIOD_S * 1_000_000}
        WHERE et IN ('purchase', 'error', 'signup') AND e.value + 50 > 0),
      t1 AS (SELECT *, ln(p) - ln(lag(p) OVER w) AS r, sum(buy) OVER w AS cb, sum(sell) OVER w AS cs FROM t0 WINDOW w AS (PARTITION BY u, pd ORDER BY us, i)),
      t AS (SELECT *, {", ".join(f"stddev_samp(r) OVER (PARTITION BY u, pd ORDER BY us, i ROWS BETWEEN {n - 2} PRECEDING AND CURRENT ROW) AS vol{n}" for n in (10, 60))} FROM t1),
      o AS (SELECT u, pd, min(us) AS ous, arg_min(p, (us, i)) AS op FROM t0 WHERE us >= pd * {PERIOD_S * 1_000_000} GROUP BY 1, 2),
      j AS (SELECT q.*, x.p, x.i AS ti, x.vol10, x.vol60, a1.p AS p1, a5.p AS p5, a30.p AS p30, ym - h.hm AS move5, CASE WHEN q.us >= o.ous THEN o.op END AS op,
          {", ".join(f"coalesce(x.c{w}, 0) - coalesce(f{n}.c{w}, 0) AS {name}{n}" for n in (1, 5, 30) for w, name in (("b", "buy"), ("s", "sell")))}
        FROM q LEFT JOIN o ON o.u = q.u AND o.pd = q.pd
        ASOF LEFT JOIN t x ON x.u = q.u AND x.pd = q.pd AND q.us >= x.us
        {" ".join(f"ASOF LEFT JOIN t a{n} ON a{n}.u = q.u AND a{n}.pd = q.pd AND q.l{n} >= a{n}.us ASOF LEFT JOIN t f{n} ON f{n}.u = q.u AND f{n}.pd = q.pd AND q.l{n} > f{n}.us" for n in (1, 5, 30))}
        ASOF LEFT JOIN (SELECT u, pd, us, ym AS hm FROM q WHERE ym IS NOT NULL) h ON h.u = q.u AND h.pd = q.pd AND q.l5 >= h.us),
      k AS (SELECT *, p / p1 - 1 AS r1, p / p5 - 1 AS r5, p / p30 - 1 AS r30, (us - yu) / 1e6 AS yage, (us - nu) / 1e6 AS nage, ln(1 + tte / 1e6) AS lt,
        {", ".join(f"CASE WHEN buy{n} + sell{n} > 0 THEN (buy{n} - sell{n}) / (buy{n} + sell{n})::DOUBLE END AS im{n}" for n in (1, 5, 30))} FROM j),
      z AS (SELECT CAST(u AS VARCHAR) || '|' || CAST(pd AS VARCHAR) AS market_id, i AS event_id, ym IS NOT NULL AND nm IS NOT NULL AND p IS NOT NULL AS complete, ym AS yes_mid, na - nb AS no_spread,
        (ybd - yad) / (ybd + yad)::DOUBLE AS yes_depth_imbalance, nage AS no_quote_age_seconds, ym + nm AS pair_mid_sum, move5 AS yes_mid_change_5s, r1 AS ref_return_1s, r30 AS ref_return_30s, vol10 AS ref_vol_10s, vol60 AS ref_vol_60s,
        CAST(buy5 - sell5 AS DOUBLE) AS ref_net_5s, im30 AS ref_imbalance_30s, CASE WHEN ti % 9 + ti % 4 > 0 THEN ((p + 1) * (ti % 9) + (p - 1) * (ti % 4)) / (ti % 9 + ti % 4) END - p AS ref_microprice_minus_mid,
        p - op AS distance_to_open, lt AS log_tte, (el / 1e6) / (el / 1e6 + tte / 1e6) AS time_frac_elapsed, ya + na - 1.0 AS pair_ask_overround, coalesce(yage, 999) + coalesce(nage, 999) AS sum_quote_age,
        r1 - r5 AS btc_ret_1m5_reversal, im1 - im5 AS btc_trade_imb_1m5, ln(1 + yad / (ybd + 1e-9)) AS log_yes_ask_bid_depth_ratio, r5 * lt AS btc_ret5_x_logtte FROM k)
      SELECT market_id, event_id, complete, {", ".join(f"round({c}, 7) AS {c}" for c in VECTOR)} FROM z""",
    "stream_committed_days": """SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS rows, count(DISTINCT event_id) AS events, round(sum(value), 4) AS total, count(*) AS manifest_rows
      FROM events WHERE ts IS NOT NULL GROUP BY 1""",
    "stream_drawdown_events": """WITH a AS (SELECT *, sum(value - 50) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cum FROM events),
      b AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS peak FROM a),
      c AS (SELECT *, floor((peak - cum) / 50.0) * 50.0 AS lvl FROM b), d AS (SELECT *, coalesce(max(lvl) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
      SELECT CAST(user_id AS VARCHAR) AS account, event_id, round(cum, 4) AS cum_pnl, round(peak, 4) AS peak_pnl, round(cum - peak, 4) AS drawdown, lvl AS level FROM d WHERE lvl > before AND lvl > 0""",
    "stream_context": """WITH a AS (SELECT *, count(*) OVER w AS n, sum(value) OVER w AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
      SELECT CAST(user_id AS VARCHAR) AS user_id, event_id, n, round(total, 6) AS total FROM a WHERE event_type = 'purchase'""",
    "stream_flow": f"""WITH {v.EV}, t AS (SELECT user_id % {SYMBOLS} AS g, date_trunc('hour', ts) AS window_start, CASE event_type WHEN 'purchase' THEN k ELSE 0 END AS b, CASE event_type WHEN 'signup' THEN k ELSE 0 END AS s FROM ev WHERE event_type IN ('purchase', 'signup'))
      SELECT CAST(g AS VARCHAR) AS symbol, window_start, CAST(sum(b) AS DOUBLE) AS buy, CAST(sum(s) AS DOUBLE) AS sell, count(*) AS trades FROM t GROUP BY g, window_start
      HAVING window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events WHERE event_type IN ('purchase', 'signup')) - INTERVAL 10 MINUTE""",
    "stream_dedupe": "SELECT DISTINCT event_id // 2 AS signal_id FROM events",
    "feed_staleness": """SELECT event_type, max(ts) AS last_recv, count(*) AS rows, CAST((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts))) // 1000 AS DOUBLE) / 1000.0 AS age_seconds,
      (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts))) // 1000 / 1000.0 > 600 AS is_stale FROM events GROUP BY 1""",
    "replay_signals": f"""WITH RECURSIVE {v.PRED}, w AS (SELECT event_id AS wid, market_id, sample_ts AS c FROM pred WHERE p_up >= 0.9),
      h AS (SELECT w.wid, p.event_id, p.sample_ts, w.c, p.p_up, p.time_to_expiry_seconds AS tte FROM w JOIN pred p ON p.market_id = w.market_id AND p.sample_ts BETWEEN w.c - INTERVAL 1 HOUR AND w.c + INTERVAL 3 DAY),
      ok AS (SELECT * FROM h WHERE sample_ts >= c AND p_up >= 0.5 AND tte >= 30),
      kept AS (SELECT wid, min(sample_ts) AS sample_ts FROM ok GROUP BY 1 UNION ALL SELECT k.wid, min(o.sample_ts) FROM kept k JOIN ok o ON o.wid = k.wid AND o.sample_ts >= k.sample_ts + INTERVAL 12 HOUR GROUP BY k.wid)
      SELECT CAST(o.wid AS VARCHAR) AS window_id, o.event_id, false AS is_forced FROM ok o JOIN kept k ON k.wid = o.wid AND k.sample_ts = o.sample_ts
      UNION ALL SELECT CAST(wid AS VARCHAR), event_id, true FROM h WHERE sample_ts = c""",
    "replay_tail": f"""WITH RECURSIVE {v.PRED}, x AS (SELECT event_id, market_id, sample_ts, 'UP' AS direction, p_up AS p, time_to_expiry_seconds AS tte FROM pred
        UNION ALL SELECT event_id, market_id, sample_ts, 'DOWN', p_down, time_to_expiry_seconds FROM pred),
      ok AS (SELECT * FROM x WHERE sample_ts >= (SELECT max(sample_ts) FROM pred) - INTERVAL 10 DAY AND p >= 0.5 AND tte >= 30),
      kept AS (SELECT market_id, direction, min(sample_ts) AS sample_ts FROM ok GROUP BY 1, 2 UNION ALL
        SELECT k.market_id, k.direction, min(o.sample_ts) FROM kept k JOIN ok o ON o.market_id = k.market_id AND o.direction = k.direction AND o.sample_ts >= k.sample_ts + INTERVAL 12 HOUR GROUP BY 1, 2)
      SELECT o.market_id, o.direction, o.event_id FROM ok o JOIN kept k ON k.market_id = o.market_id AND k.direction = o.direction AND k.sample_ts = o.sample_ts""",
}
