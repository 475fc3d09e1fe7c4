"""Registered queries against their SQL twins on the smallest tables (all: tools/check.py)."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
import check  # noqa: E402

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "grid_stale_rate", "asof_bucketed_single", "nearest_match", "trade_flow_rolling", "row_time_split", "executable_grid",
    "cooldown_hot_key", "signals_long", "filter_grid", "drawdown", "record_router", "book_sweep", "settled_results",
    "auc_by_group", "decile_heavy_ties", "dist_summary_nearest", "gate_first_reason", "stream_cooldown", "interval_windows",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_equals_sql(spark, con, name):
    text, ok = check.compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, text


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_model_learns_a_rule(spark):
    from pyspark.sql import functions as F

    from tidemark.plans import models

    df = spark.range(900).select(
        (F.col("id") % 30).cast("double").alias("x"), F.when(F.col("id") % 7 != 0, F.col("id") % 11).alias("z"),
        ((F.col("id") % 30) > 14).cast("int").alias("settled"),
        F.when(F.col("id") % 10 < 6, "train").when(F.col("id") % 10 < 8, "valid").otherwise("test").alias("split"),
    )
    _, scored = models.fit_binary(df, features=["x", "z"], label="settled", max_iter=20)
    from tidemark.operators.rank import binary_metrics

    assert binary_metrics(scored, label="label", prob="p_model").first().auc > 0.99
    with pytest.raises(ValueError):
        models.fit_binary(df, features=["label_up"], label="settled")


@pytest.mark.parametrize(
    "query, operator", [
        ("model_comparison", "model_comparison"), ("model_net_edge", "net_edge_model"),
        ("model_walk_forward", "walk_forward"), ("model_per_parameter", "per_parameter_models"),
    ],
)
def test_registered_models_are_not_cut_short(spark, monkeypatch, query, operator):
    import inspect

    from tidemark.plans import models

    least = inspect.signature(getattr(models, operator)).parameters["max_iter"].default
    seen = []

    class Seen(Exception):
        pass

    def spy(*args, **kwargs):
        seen.append(kwargs.get("max_iter", least))
        raise Seen

    monkeypatch.setattr(models, operator, spy)
    with pytest.raises(Seen):
        entry.queries()[query](spark, SF)
    assert seen == [least]
