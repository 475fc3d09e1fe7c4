"""Rule gates: which rule stopped a row, first or all."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple  # (reason, column that is true when the rule stops the row)


def first_reason(rules: Sequence[Rule]) -> Column:
    """Reason of the first rule that stops the row, null when none does."""
    out: Column | None = None
    for reason, fails in rules:
        cond = F.coalesce(fails, F.lit(False))
        out = F.when(cond, reason) if out is None else out.when(cond, reason)
    return out.otherwise(F.lit(None))


def all_reasons(rules: Sequence[Rule], separator: str = ",") -> Column:
    """All reasons in rule order, joined; empty when the row passes."""
    hits = F.array(*[F.when(F.coalesce(fails, F.lit(False)), F.lit(reason)) for reason, fails in rules])
    return F.array_join(F.array_compact(hits), separator)


def rejection_histogram(df: DataFrame, *, keys: Sequence[str] = (), reason: str = "reject_reason") -> DataFrame:
    return df.where(F.col(reason).isNotNull()).groupBy(*keys, reason).agg(F.count("*").alias("rows"))


@dataclass(frozen=True)
class SignalRules:
    """Limits of one signal configuration; None switches a rule off."""

    name: str
    threshold: float
    min_tte: float = 0.0
    max_tte: float | None = None
    max_pair_ask_sum: float | None = None
    max_update_age: float | None = None
    max_quote_age: float | None = None
    max_spread: float | None = None
    min_ask_depth: float | None = None
    max_depth_fraction: float | None = None
    order_size: float = 1.0
    min_edge: float | None = None


def signal_rules(r: SignalRules, *, cooldown: bool = False) -> list[Rule]:
    """Rules in the order they are applied to a (sample, direction) row.

    The row has: quote_bad, time_to_expiry_seconds, pair_ask_sum, update_age,
    yes_quote_age, no_quote_age, probability, spread, ask_depth. A missing value
    counts as failing wherever a limit is set. With ``cooldown`` the row also has
    in_cooldown: a signal of the same market and side came a short time before.
    """
    c = F.col
    rules: list[Rule] = [
        ("quote_stale", c("quote_bad")),
        ("tte_too_low", F.coalesce(c("time_to_expiry_seconds"), F.lit(0.0)) < r.min_tte),
    ]

    def over(reason: str, col: str, limit: float | None) -> None:
        if limit is not None:
            rules.append((reason, c(col).isNull() | (c(col) > limit)))

    if r.max_tte is not None:
        rules.append(("tte_too_high", F.coalesce(c("time_to_expiry_seconds"), F.lit(0.0)) > r.max_tte))
    over("pair_ask_sum_too_high", "pair_ask_sum", r.max_pair_ask_sum)
    over("pm_update_too_old", "update_age", r.max_update_age)
    if r.max_quote_age is not None:
        late = F.lit(False)
        for side in ("yes_quote_age", "no_quote_age"):
            late = late | c(side).isNull() | (c(side) > r.max_quote_age)
        rules.append(("quote_age_too_old", late))
    rules.append(("probability_below_threshold", c("probability").isNull() | (c("probability") < r.threshold)))
    wide = c("spread").isNull()
    rules.append(("spread_too_wide", wide if r.max_spread is None else wide | (c("spread") > r.max_spread)))
    if r.min_ask_depth is not None:
        rules.append(("ask_depth_too_low", c("ask_depth").isNull() | (c("ask_depth") < r.min_ask_depth)))
    if r.max_depth_fraction is not None:
        rules.append(
            (
                "order_too_large_for_depth",
                c("ask_depth").isNull() | (c("ask_depth") * r.max_depth_fraction < r.order_size),
            )
        )
    if r.min_edge is not None:
        rules.append(("cost_adjusted_edge_too_low", c("probability") < r.min_edge))
    if cooldown:
        rules.append(("cooldown", F.coalesce(c("in_cooldown"), F.lit(False))))
    return rules


@dataclass(frozen=True)
class OrderRules:
    """Limits of the order gate."""

    target_shares: float = 6.0
    max_signal_age: float = 30.0
    min_tte: float = 30.0
    max_tte: float = 900.0
    max_ask: float = 0.90
    max_spread: float = 0.05
    limit_offset: float = 0.01
    min_limit: float = 0.01
    max_limit: float = 0.99
    min_notional: float = 1.0
    max_decisions_per_hour: int = 20
    allow_up: bool = True
    allow_down: bool = True


def order_rules(r: OrderRules, *, with_history: bool = False) -> list[Rule]:
    """Order rules, all of which are reported, in their published order.

    The row has: signal_id, direction, signal_age, time_to_expiry_seconds, asset_id, ask,
    fill, spread, notional. ``with_history`` adds the rules on earlier decisions; the row
    then also has seen_before, side_accepted and decisions_last_hour.
    """
    c = F.col

    def history(reason: str, failed: Column) -> list[Rule]:
        return [(reason, F.coalesce(failed, F.lit(False)))] if with_history else []

    up, down = c("direction") == "UP", c("direction") == "DOWN"
    return [
        ("missing_signal_id", F.coalesce(c("signal_id").cast("string"), F.lit("")) == ""),
        *history("duplicate_signal", c("seen_before")),
        ("up_disabled", up & F.lit(not r.allow_up)),
        ("down_disabled", down & F.lit(not r.allow_down)),
        ("bad_direction", ~F.coalesce(up | down, F.lit(False))),
        ("missing_sample_ts", c("signal_age").isNull()),
        ("signal_too_old", c("signal_age") > r.max_signal_age),
        ("signal_from_future", c("signal_age") < -5),
        ("missing_tte", c("time_to_expiry_seconds").isNull()),
        ("tte_too_low", c("time_to_expiry_seconds") < r.min_tte),
        ("tte_too_high", c("time_to_expiry_seconds") > r.max_tte),
        *history("market_side_already_accepted", c("side_accepted")),
        *history("hourly_decision_limit", c("decisions_last_hour") >= r.max_decisions_per_hour),
        ("missing_asset_id", F.coalesce(c("asset_id"), F.lit("")) == ""),
        ("missing_effective_ask", c("ask").isNull()),
        ("ask_too_high", c("ask") > r.max_ask),
        ("bad_ask", c("ask") <= 0),
        ("insufficient_depth", c("fill") + 1e-9 < r.target_shares),
        ("spread_too_wide", c("spread") > r.max_spread),
        ("notional_below_min", c("notional") < r.min_notional),
    ]
