"""Signal evaluation over parameter grids.

A grid is a literal array on the row, filtered before it is exploded, so a sample
fans out only into the parameter sets it qualifies for. There is no cross join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as fn
from tidemark.operators.asof import asof_join, asof_offsets, nearest_join
from tidemark.operators.quantile import group_quantiles, null_safe_join
from tidemark.operators.trades import (
    break_even,
    equity_curve,
    max_drawdown,
    metrics_by_sets,
    select_modes,
    simple_metrics,
    stability,
    trade_metrics,
)
from tidemark.operators.pick import top_per_group

# side of the quotes a direction trades on
SIDE = {"UP": "yes", "DOWN": "no"}


def _choices(values: Sequence[float], fits) -> Column:
    """Values of a grid axis that the row qualifies for."""
    return F.filter(F.array(*[F.lit(float(v)) for v in values]), fits)


def future_quotes(
    predictions: DataFrame,
    quotes: DataFrame,
    *,
    horizons_s: Sequence[float],
    id_cols: Sequence[str] = ("market_id", "event_id"),
    tolerance: float = 1.0,
    bucket_seconds: int = 3_600,
) -> DataFrame:
    """First quote at or after ``sample_ts + h`` for each horizon, as one map per row."""
    fields = [c for c in ("yes_bid", "yes_ask", "no_bid", "no_ask") if c in quotes.columns]
    flags = [
        c for c in ("yes_is_stale", "no_is_stale", "yes_crossed_quote", "no_crossed_quote") if c in quotes.columns
    ]
    return asof_offsets(
        predictions, quotes, on=["market_id"], id_cols=id_cols, base_ts="sample_ts", quote_ts="sample_ts",
        offsets_ms=[int(round(h * 1000)) for h in horizons_s], quote_cols=[*fields, *flags], tolerance=tolerance,
        bucket_seconds=bucket_seconds,
    )


def _at(offset: Column, field: str) -> Column:
    return F.col("quotes_at")[offset].getField(field)


def signals(
    looked: DataFrame,
    *,
    thresholds: Sequence[float],
    horizons_s: Sequence[float],
    latencies_s: Sequence[float] | None = None,
    directions: Sequence[str] = ("UP", "DOWN"),
    keep: Sequence[str] = ("event_id", "market_id", "sample_ts", "date", "tte_bucket", "time_to_expiry_seconds"),
) -> DataFrame:
    """Long form: one row per sample, direction, horizon (and latency) and threshold it passes.

    Without latencies the entry is the sample's own ask; with them, the entry quote is
    the one found at ``t + latency`` and both quotes must be fresh and uncrossed.
    """
    has_flags = "yes_is_stale" in dict(
        (f.name, f) for f in looked.schema["quotes_at"].dataType.valueType.fields
    )
    combos = [
        F.struct(
            F.lit(float(a)).alias("latency_seconds"),
            F.lit(float(h)).alias("exit_horizon_seconds"),
            F.lit(int(round(a * 1000))).cast("bigint").alias("from_ms"),
            F.lit(int(round((a + h) * 1000))).cast("bigint").alias("to_ms"),
        )
        for a in (latencies_s if latencies_s is not None else [0.0])
        for h in horizons_s
    ]
    table = F.array(*combos)
    if latencies_s is not None:
        table = F.filter(table, lambda c: F.col("time_to_expiry_seconds") >= c.latency_seconds + c.exit_horizon_seconds)
    fanned = looked.select("*", F.explode(table).alias("__c")).withColumns(
        {"__from": F.col("__c.from_ms"), "__to": F.col("__c.to_ms")}
    )
    options = []
    for d in directions:
        s = SIDE[d]
        entry = F.col(f"{s}_ask") if latencies_s is None else _at(F.col("__from"), f"{s}_ask")
        exit_ = _at(F.col("__to"), f"{s}_bid")
        ok = fn.is_finite(entry) & fn.is_finite(exit_)
        if latencies_s is not None and has_flags:
            for flag in (f"{s}_is_stale", f"{s}_crossed_quote"):
                for off in ("__from", "__to"):
                    ok = ok & ~F.coalesce(_at(F.col(off), flag), F.lit(True))
        options.append(
            F.struct(
                F.lit(d).alias("direction"),
                F.col("p_up" if d == "UP" else "p_down").alias("signal_probability"),
                entry.alias("entry_price"),
                exit_.alias("exit_price"),
                ok.alias("ok"),
            )
        )
    sided = fanned.select(
        *keep, "__c.latency_seconds", "__c.exit_horizon_seconds", F.explode(F.array(*options)).alias("__d")
    ).where("__d.ok")
    passed = sided.select(
        *keep, "latency_seconds", "exit_horizon_seconds", "__d.direction", "__d.signal_probability",
        "__d.entry_price", "__d.exit_price", (F.col("__d.exit_price") - F.col("__d.entry_price")).alias("pnl"),
    )
    return passed.select(
        "*", F.explode(_choices(thresholds, lambda t: F.col("signal_probability") >= t)).alias("threshold")
    )


PARAMS = ("direction", "threshold", "latency_seconds", "exit_horizon_seconds")


def evaluate_grid(
    long: DataFrame, *, modes: Mapping[str, float | None], params: Sequence[str] = PARAMS
) -> DataFrame:
    """Trades of every mode for every parameter set (feed to the metric functions)."""
    return select_modes(long, params=params, side_keys=["market_id", "direction"], modes=modes)


def grid_metrics(trades: DataFrame, *, params: Sequence[str] = PARAMS) -> DataFrame:
    """Full metric row per mode and parameter set; drawdown runs market by market."""
    return trade_metrics(trades, keys=["mode", *params], within="market_id")


def grid_cuts(trades: DataFrame, *, params: Sequence[str] = PARAMS) -> DataFrame:
    """Simple metrics overall, by date and by time-left bucket."""
    return metrics_by_sets(trades, params=["mode", *params], cuts=["date", "tte_bucket"])


def stress(
    trades: DataFrame, *, costs: Sequence[float], params: Sequence[str] = PARAMS
) -> DataFrame:
    """Metrics after subtracting a fixed cost per trade, for each cost.

    Trades are selected once; only the metric aggregate sees the costs.
    """
    fanned = trades.select(
        "*", F.explode(F.array(*[F.lit(float(c)) for c in costs])).alias("stress_cost")
    ).withColumn("pnl", F.col("pnl") - F.col("stress_cost"))
    return simple_metrics(fanned, keys=["mode", *params, "stress_cost"])


def break_even_costs(stressed: DataFrame, *, params: Sequence[str] = PARAMS) -> DataFrame:
    return break_even(stressed, keys=["mode", *params], cost="stress_cost")


def filter_grid(
    executable: DataFrame,
    *,
    probabilities: Sequence[float],
    max_spreads: Sequence[float | None],
    max_ages: Sequence[float],
    min_ttes: Sequence[float],
) -> DataFrame:
    """Rows fanned out to the filter sets they pass; a null spread limit means no limit."""
    spreads = F.array(*[F.lit(s).cast("double") for s in max_spreads])
    return (
        executable.select("*", F.explode(_choices(probabilities, lambda t: F.col("p_model") >= t)).alias("prob_threshold"))
        .select("*", F.explode(_choices(max_ages, lambda a: F.col("side_quote_age_seconds") <= a)).alias("max_quote_age"))
        .select("*", F.explode(_choices(min_ttes, lambda m: F.col("time_to_expiry_seconds") >= m)).alias("min_time_to_expiry"))
        .select("*", F.explode(F.filter(spreads, lambda s: s.isNull() | (F.col("side_spread") <= s))).alias("max_spread"))
    )


FILTER_PARAMS = ("direction", "prob_threshold", "max_spread", "max_quote_age", "min_time_to_expiry")


def stability_tables(trades: DataFrame, *, params: Sequence[str], top_markets: int = 200) -> dict[str, DataFrame]:
    """Stability summary, per-date / per-bucket cuts, best markets and equity curve."""
    keys = ["mode", *params]
    per_market = simple_metrics(trades, keys=[*keys, "market_id"])
    return {
        "summary": stability(trades, params=keys),
        "cuts": metrics_by_sets(trades, params=keys, cuts=["date", "tte_bucket"]),
        "markets": top_per_group(per_market, keys=keys, score="total_pnl", tie=["market_id"], k=top_markets),
        "drawdown": equity_curve(trades, keys=keys, ts="sample_ts", tie=["event_id"], value="pnl"),
    }


# --- hold to settlement -----------------------------------------------------------


def settlement_signals(
    predictions: DataFrame, *, prob: str, thresholds: Sequence[float], maker: bool = False
) -> DataFrame:
    """YES and NO signals on edge, held to settlement; taker buys the ask, maker the bid."""
    quote = "bid" if maker else "ask"
    settled = F.col("settled_yes").cast("double")
    options = F.array(
        F.struct(
            F.lit("YES").alias("side"),
            (F.col(prob) - F.col(f"yes_{quote}")).alias("edge"),
            F.col(f"yes_{quote}").alias("entry_price"),
            (settled - F.col(f"yes_{quote}")).alias("pnl"),
        ),
        F.struct(
            F.lit("NO").alias("side"),
            ((1.0 - F.col(prob)) - F.col(f"no_{quote}")).alias("edge"),
            F.col(f"no_{quote}").alias("entry_price"),
            ((1.0 - settled) - F.col(f"no_{quote}")).alias("pnl"),
        ),
    )
    keep = [
        "event_id", "market_id", "sample_ts", "date", "tte_bucket", "time_to_expiry_seconds", "settled_yes", "label_source",
    ]
    sided = predictions.select(*keep, F.explode(options).alias("__s")).select(*keep, "__s.*")
    out = sided.select("*", F.explode(_choices(thresholds, lambda t: F.col("edge") >= t)).alias("threshold"))
    return out.withColumn("roi", F.when(F.col("entry_price") != 0, F.col("pnl") / F.col("entry_price")))


def settlement_trades(long: DataFrame) -> DataFrame:
    """All signals, and the first of each market and side."""
    return select_modes(
        long, params=["threshold"], side_keys=["market_id", "side"],
        modes={"all_signals": 0, "first_signal_per_market_side": None},
    )


def settlement_metrics(trades: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Metrics per mode, side, threshold and extra grouping; drawdown is ≤ 0 here."""
    keys = ["mode", "side", "threshold", *by]
    base = trades.groupBy(*keys).agg(
        F.count("*").alias("trades"),
        F.avg("entry_price").alias("avg_entry_price"),
        F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"),
        F.sum("pnl").alias("total_pnl"),
        F.avg("pnl").alias("avg_pnl"),
        F.avg("roi").alias("avg_roi"),
        F.coalesce(F.stddev_samp("pnl"), F.lit(0.0)).alias("pnl_std"),
        F.avg("time_to_expiry_seconds").alias("avg_time_to_expiry"),
        F.min("time_to_expiry_seconds").alias("min_time_to_expiry"),
        F.max("time_to_expiry_seconds").alias("max_time_to_expiry"),
    )
    base = base.withColumn("sharpe_like", F.when(F.col("pnl_std") > 1e-12, F.col("avg_pnl") / F.col("pnl_std")))
    mid = group_quantiles(trades, keys=keys, value="roi", quantiles={"median_roi": 0.5})
    dd = max_drawdown(trades, keys=keys, ts="sample_ts", tie=["event_id"], value="pnl", bucket_seconds=86_400).withColumn(
        "max_drawdown", -F.col("max_drawdown")
    )
    return null_safe_join(null_safe_join(base, mid, keys), dd, keys)


def markout_sanity(
    predictions: DataFrame, *, thresholds: Sequence[float], markout: str, spread: str, by: Sequence[str] = ()
) -> DataFrame:
    """Does the directional markout of confident signals cover half / all of the spread?"""
    options = F.array(
        F.struct(F.lit("UP").alias("direction"), F.col("p_up").alias("p"), F.col(markout).alias("m")),
        F.struct(F.lit("DOWN").alias("direction"), F.col("p_down").alias("p"), (-F.col(markout)).alias("m")),
    )
    keep = list(dict.fromkeys([*by, spread]))
    sided = predictions.select(*keep, F.explode(options).alias("__s")).select(*keep, "__s.*")
    sig = sided.select("*", F.explode(_choices(thresholds, lambda t: F.col("p") >= t)).alias("threshold"))
    m, s = F.col("m"), F.col(spread)
    keys = ["direction", "threshold", *by]

    def rate(cond: Column) -> Column:
        return F.avg(cond.cast("double"))

    base = sig.groupBy(*keys).agg(
        F.count("*").alias("signals"),
        F.avg(m).alias("mean_markout"),
        rate(m > 0).alias("positive_rate"),
        rate(m > 0.005).alias("gt_half_cent_rate"),
        rate(m > 0.01).alias("gt_1c_rate"),
        rate(m > 0.02).alias("gt_2c_rate"),
        F.avg(s).alias("avg_spread"),
        F.avg(m - 0.5 * s).alias("markout_minus_half_spread"),
        F.avg(m - s).alias("markout_minus_full_spread"),
    )
    mid = group_quantiles(sig, keys=keys, value="m", quantiles={"median_markout": 0.5})
    return null_safe_join(base, mid, keys)


# --- folds, thresholds ------------------------------------------------------------


def fold_roles(df: DataFrame, folds: Sequence[tuple[str, str, str, str, str]], *, date: str = "date") -> DataFrame:
    """Rows with each fold they take part in and their role.

    A fold is (name, train from, train to, valid date, test date), all inclusive.
    """
    d = F.col(date)
    options = []
    for name, start, end, valid, test in folds:
        role = (
            F.when(d.between(start, end), "train").when(d == valid, "valid").when(d == test, "test")
        )
        options.append(F.struct(F.lit(name).alias("fold"), role.alias("role")))
    roles = F.filter(F.array(*options), lambda o: o.role.isNotNull())
    return df.select("*", F.explode(roles).alias("__f")).select(*df.columns, "__f.fold", "__f.role")


def fold_status(roles: DataFrame, *, min_rows: int = 1000) -> DataFrame:
    """Rows per role of each fold, and whether the fold is large enough to be fitted."""
    counts = roles.groupBy("fold").agg(
        *[F.count_if(F.col("role") == r).alias(f"{r}_rows") for r in ("train", "valid", "test")]
    )
    least = F.least("train_rows", "valid_rows", "test_rows")
    return counts.withColumn("status", F.when(least < min_rows, "skipped").otherwise("ok"))


def choose_threshold(
    valid: DataFrame,
    *,
    keys: Sequence[str],
    edges: Sequence[float],
    probabilities: Sequence[float],
    min_trades: int,
    penalty: float = 0.05,
    tie: Sequence[str] = ("event_id",),
) -> DataFrame:
    """Best (edge, probability) thresholds per key by average net pnl less a drawdown penalty.

    Sets with fewer than ``min_trades`` trades do not compete; where none is left the
    fallback is (0, 0.5) without a score.
    """
    fanned = valid.select(
        "*", F.explode(_choices(edges, lambda t: F.col("pred_edge") >= t)).alias("edge_threshold")
    ).select("*", F.explode(_choices(probabilities, lambda t: F.col("pred_prob") >= t)).alias("prob_threshold"))
    by = [*keys, "edge_threshold", "prob_threshold"]
    base = simple_metrics(fanned, keys=by, pnl="net_pnl").where(F.col("trades") >= min_trades)
    dd = max_drawdown(fanned, keys=by, ts="sample_ts", tie=tie, value="net_pnl", within="market_id", bucket_seconds=86_400)
    scored = null_safe_join(base, dd, by).withColumn("score", F.col("avg_pnl") - penalty * F.col("max_drawdown"))
    # of equal scores the first in grid order wins
    rank = F.struct("score", -F.col("edge_threshold"), -F.col("prob_threshold"))
    best = scored.groupBy(*keys).agg(
        F.max_by(F.struct("edge_threshold", "prob_threshold", "score", "trades"), rank).alias("__b")
    )
    every = valid.select(*keys).distinct()
    joined = null_safe_join(every, best, keys) if keys else null_safe_join(valid.agg(F.count("*").alias("__n")).drop("__n"), best, [])
    return joined.select(
        *keys,
        F.coalesce("__b.edge_threshold", F.lit(0.0)).alias("edge_threshold"),
        F.coalesce("__b.prob_threshold", F.lit(0.5)).alias("prob_threshold"),
        F.col("__b.score").alias("score"),
        F.col("__b.trades").alias("trades"),
    )


def with_net_pnl(
    trades: DataFrame, *, gross: str, entry: str, exit: str, fee_rate: float = 0.07, slippage: float = 0.0025
) -> DataFrame:
    """Entry and exit fee, net result and its label."""
    fees = trades.withColumns(
        {"entry_fee": fn.taker_fee(entry, fee_rate), "exit_fee": fn.taker_fee(exit, fee_rate)}
    )
    net = F.col(gross) - F.col("entry_fee") - F.col("exit_fee") - slippage
    return fees.withColumn("net_pnl", net).withColumn("label_net", (F.col("net_pnl") > 0).cast("int"))


def threshold_pnl(trades: DataFrame, *, prob: str, thresholds: Sequence[float], keys: Sequence[str], pnl: str = "net_pnl") -> DataFrame:
    """Metrics of the rows at or above each probability threshold."""
    fanned = trades.select("*", F.explode(_choices(thresholds, lambda t: F.col(prob) >= t)).alias("threshold"))
    return simple_metrics(fanned, keys=[*keys, "threshold"], pnl=pnl)


# --- parity of two runs -----------------------------------------------------------


def signal_parity(windows: DataFrame, signals_run: DataFrame, *, bucket_seconds: int = 3_600) -> DataFrame:
    """The run's signal nearest to each window's centre, with probability differences."""
    near = nearest_join(
        windows, signals_run.withColumnRenamed("sample_ts", "__signal_ts"), on=["market_id"],
        left_ts="center_sample_ts", right_ts="__signal_ts", right_cols=["signal_id", "direction", "p_up", "p_down"],
        tie=["signal_id"], match_ts="sample_ts", abs_ms="abs_ms_from_center", bucket_seconds=bucket_seconds,
    )
    return near.withColumns(
        {
            "abs_diff_p_up": F.abs(F.col("p_up") - F.col("offline_p_up")),
            "abs_diff_p_down": F.abs(F.col("p_down") - F.col("offline_p_down")),
            "signal_found": F.col("sample_ts").isNotNull(),
        }
    )


def outcome_parity(outcomes: DataFrame, quotes: DataFrame, *, bucket_seconds: int = 3_600) -> DataFrame:
    """Recompute entry and exit of each outcome from the quote grid and compare.

    Entry is the first quote at or after ``signal_ts + latency``, exit the first at or
    after that plus the horizon; no tolerance, as long as a later quote exists.
    """
    due = outcomes.withColumns(
        {
            "entry_due_ts": fn.plus_ms("signal_ts", F.col("entry_latency_ms").cast("bigint")),
            "exit_due_ts": fn.plus_ms(
                "signal_ts",
                F.col("entry_latency_ms").cast("bigint") + F.col("exit_horizon_seconds").cast("bigint") * 1000,
            ),
        }
    )
    # both instants of an outcome in one pass
    instants = F.array(
        F.struct(F.lit("entry").alias("which"), F.col("entry_due_ts").alias("at")),
        F.struct(F.lit("exit").alias("which"), F.col("exit_due_ts").alias("at")),
    )
    looked = due.select("*", F.explode(instants).alias("__i")).select(
        *due.columns, F.col("__i.which").alias("__which"), F.col("__i.at").alias("__at")
    )
    right = quotes.select("market_id", F.col("sample_ts").alias("__q_ts"), "yes_bid", "yes_ask", "no_bid", "no_ask")
    found = asof_join(
        looked, right, on=["market_id"], left_ts="__at", right_ts="__q_ts", direction="forward",
        right_cols=["yes_bid", "yes_ask", "no_bid", "no_ask"], bucket_seconds=bucket_seconds,
    )
    up = F.col("direction") == "UP"
    entry = F.when(up, F.col("yes_ask")).otherwise(F.col("no_ask"))
    exit_ = F.when(up, F.col("yes_bid")).otherwise(F.col("no_bid"))
    back = found.groupBy(*outcomes.columns).agg(
        F.max(F.when(F.col("__which") == "entry", entry)).alias("expected_entry_price"),
        F.max(F.when(F.col("__which") == "exit", exit_)).alias("expected_exit_price"),
    )
    expected = F.col("expected_exit_price") - F.col("expected_entry_price")
    return back.withColumns(
        {
            "expected_pnl": expected,
            "abs_diff_entry_price": F.abs(F.col("expected_entry_price") - F.col("entry_price")),
            "abs_diff_exit_price": F.abs(F.col("expected_exit_price") - F.col("exit_price")),
            "abs_diff_pnl": F.abs(expected - F.col("pnl")),
        }
    )


def parity_summary(parity: DataFrame, *, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Nearest-rank 95 % quantile of each absolute difference."""
    out = parity.groupBy(*keys).agg(F.count("*").alias("rows"))
    for c in columns:
        q = group_quantiles(parity, keys=keys, value=c, quantiles={f"{c}_p95": 0.95}, method="nearest")
        out = null_safe_join(out, q, keys)
    return out


def model_summary(metrics: DataFrame, *, model: str, baseline: str, by: Sequence[str] = ()) -> DataFrame:
    """Metric differences of a model against a baseline, side by side per group."""
    both = metrics.where(F.col("probability").isin(model, baseline))
    picks = []
    for m in ("auc", "logloss", "brier", "accuracy_0p5"):
        mine = F.max(F.when(F.col("probability") == model, F.col(m)))
        base = F.max(F.when(F.col("probability") == baseline, F.col(m)))
        picks += [mine.alias(f"{m}_model"), base.alias(f"{m}_baseline"), (mine - base).alias(f"{m}_delta")]
    return both.groupBy(*by).agg(*picks)


def best_choices(trades: DataFrame, *, choices: Mapping[str, Column], pnl: str = "pnl") -> DataFrame:
    """For each kind of choice (threshold, interval, ...) its value with the highest total result.

    ``choices`` names a column per kind; ties go to the smaller value. One pass over the trades.
    """
    pairs = F.array(*[F.struct(F.lit(n).alias("choice"), c.cast("string").alias("value")) for n, c in choices.items()])
    long = trades.select(F.col(pnl).alias("__v"), F.explode(pairs).alias("__c")).select("__v", "__c.*")
    totals = long.where("value IS NOT NULL").groupBy("choice", "value").agg(
        F.count("*").alias("trades"), F.sum("__v").alias("total_pnl"), F.avg((F.col("__v") > 0).cast("double")).alias("win_rate")
    )
    first = F.struct((-F.col("total_pnl")).alias("loss"), "value", "trades", "total_pnl", "win_rate")
    return totals.groupBy("choice").agg(F.min(first).alias("__b")).select(
        "choice", "__b.value", "__b.trades", "__b.total_pnl", "__b.win_rate"
    )


def winning_dates(trades: DataFrame, *, by: Sequence[str], date: str = "date", pnl: str = "pnl") -> DataFrame:
    """Per group: days traded, days with a gain, and the first and last of those."""
    days = trades.groupBy(*by, date).agg(F.sum(pnl).alias("__d"))
    won = F.when(F.col("__d") > 0, F.col(date))
    return days.groupBy(*by).agg(
        F.count("*").alias("days"), F.count(won).alias("winning_days"), F.min(won).alias("first_win"), F.max(won).alias("last_win")
    )
