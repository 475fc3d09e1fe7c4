"""Signals, candidates and snapshots from a stream of scored samples.

The rules are the columns of the batch gate, so a stream and a table reject alike; only the
cooldown and the snapshot interval keep state (one time per key).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.gates import Rule, first_reason
from tidemark.streaming.state import throttle

KEYS = ("config", "market_id", "direction")


def gated(samples: DataFrame, configs: Mapping[str, Sequence[Rule]]) -> DataFrame:
    """One row per sample and configuration with the first rule it fails (null: none)."""
    rows = F.array(
        *[F.struct(F.lit(name).alias("config"), first_reason(list(rules)).alias("reject_reason")) for name, rules in configs.items()]
    )
    return samples.select("*", F.inline(rows))


def candidates(samples: DataFrame, configs: Mapping[str, Sequence[Rule]], *, near: Column) -> DataFrame:
    """Samples worth keeping for study: they pass, or are ``near`` enough to passing."""
    return gated(samples, configs).where(F.col("reject_reason").isNull() | near)


def emitted(
    samples: DataFrame, configs: Mapping[str, Sequence[Rule]], *, ts: str, tie: str, cooldown_seconds: float,
    received: str | None = None,
) -> DataFrame:
    """Signals: samples that pass, at most one per cooldown of a (config, market, direction).

    With ``received`` the row says how long after its receipt the signal left, in milliseconds.
    """
    passed = gated(samples, configs).where("reject_reason IS NULL").drop("reject_reason")
    out = throttle(passed, keys=list(KEYS), ts=ts, tie=tie, seconds=cooldown_seconds)
    if received is None:
        return out
    now = F.unix_micros(F.current_timestamp())
    return out.withColumn("latency_ms", (now - F.unix_micros(received)) / 1000)


def near_expiry(
    samples: DataFrame, *, left: str, within_seconds: float, every_seconds: float, ts: str, tie: str,
    keys: Sequence[str] = ("market_id",),
) -> DataFrame:
    """Full rows close to a market's end, at most one per interval and market."""
    close = samples.where((F.col(left) >= 0) & (F.col(left) <= within_seconds))
    return throttle(close, keys=list(keys), ts=ts, tie=tie, seconds=every_seconds)
