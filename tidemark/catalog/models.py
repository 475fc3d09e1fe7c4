"""Queries that fit models (no SQL twin: checked by the tests on rules that can be learnt)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import views as v
from tidemark.catalog.evaluate import FOLDS
from tidemark.catalog.tables import _split as _split_sql
from tidemark.functions import scalars as fn
from tidemark.operators import rank
from tidemark.plans import evaluate as ev
from tidemark.plans import boosting, models
from tidemark.session import stage

FEATURES = ["p_up", "yes_ask", "yes_bid", "time_to_expiry_seconds", "quote_age_seconds"]


def _split(spark, sf):
    p = rank.time_split(v.predictions(spark, sf), ts="sample_ts", tie=["event_id"])
    return stage(p, "split_predictions")


def class_weights(spark, sf):
    """Weights that make classes count the same in training; other rows have no say in them."""
    p = models.prepared(_split(spark, sf), ["p_up"], "settled_yes")
    out = models.with_class_weights(p)
    return out.groupBy("split", "label").agg(F.count("*").alias("rows"), F.round(F.max("weight"), 8).alias("weight"))


def model_comparison(spark, sf):
    """Logistic and boosted models against the quoted price on the test split."""
    out = models.model_comparison(_split(spark, sf), features=FEATURES, label="settled_yes", baselines=["yes_ask"])
    return out.select("model", "rows", *[F.round(c, 3).alias(c) for c in ("auc", "logloss", "brier", "accuracy_0p5")])


def model_three_way(spark, sf):
    p = _split(spark, sf).withColumn("label_move", fn.three_way(F.col("yes_ask") - 0.5, 0.2))
    out = models.fit_three_way(p, features=["p_up", "yes_bid", "no_bid"], label="label_move", max_iter=20)
    return out.select("rows", *[F.round(c, 3).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_f1")])


def model_three_way_boosted(spark, sf):
    """Boosted trees of three classes with a softmax loss: test rows, accuracy and what the probabilities sum to."""
    p = _split(spark, sf).withColumn("label_move", fn.three_way(F.col("yes_ask") - 0.5, 0.2, null_label=None))
    model = boosting.fit_softmax(p.where("split = 'train'"), features=["p_up", "yes_bid", "no_bid"], label="label_move")
    scored = model.probabilities(p.where("split = 'test' AND label_move IS NOT NULL"), "prob", "chosen")
    right = F.when(F.col("chosen") == F.col("label_move"), 1.0).otherwise(0.0)
    total = F.aggregate("prob", F.lit(0.0), lambda a, x: a + x)
    out = scored.groupBy("label_move").agg(F.count("*").alias("rows"), F.round(F.avg(right), 3).alias("recall"), F.round(F.min(total), 9).alias("least_sum"))
    return out


def model_net_edge(spark, sf):
    p = _split(spark, sf)
    t = ev.with_net_pnl(
        p.withColumns({"gross": F.col("settled_yes") - F.col("yes_ask"), "exit": F.col("settled_yes").cast("double")}),
        gross="gross", entry="yes_ask", exit="exit",
    )
    _, scored = models.net_edge_model(t, features=FEATURES, edges=(-0.1, 0.0, 0.1), probabilities=(0.3, 0.5), min_trades=20)
    return scored.groupBy("edge_threshold", "prob_threshold", "selected").agg(F.count("*").alias("rows"), F.round(F.avg("net_pnl"), 4).alias("avg_net_pnl"))


def model_walk_forward(spark, sf):
    p = stage(v.predictions(spark, sf), "predictions")
    out = models.walk_forward(p, folds=FOLDS, features=FEATURES, label="settled_yes", min_rows=20)
    return out.select("fold", "status", "train_rows", "valid_rows", "test_rows", F.round("auc", 3).alias("auc"))


def model_per_parameter(spark, sf):
    """One model per label source and direction."""
    p = _split(spark, sf).withColumns({"up": F.col("settled_yes"), "down": 1 - F.col("settled_yes")})
    out = models.per_parameter_models(
        p, features=FEATURES, sets=[{"label_source": "real"}, {"label_source": "proxy"}], labels={"UP": "up", "DOWN": "down"}
    )
    return out.select("label_source", "direction", "rows", *[F.round(c, 3).alias(c) for c in ("auc", "brier")])


QUERIES = {
    n: f for n, f in list(globals().items())
    if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_")
}
_SPLIT = f"""{v.PRED}, r AS (SELECT event_id, settled_yes, row_number() OVER (ORDER BY sample_ts, event_id) - 1 AS i, count(*) OVER () AS n FROM pred),
      s AS (SELECT event_id, settled_yes, {_split_sql()} FROM r)"""
ORACLES: dict[str, str] = {
    "class_weights": f"""WITH {_SPLIT}, t AS (SELECT settled_yes AS y, count(*) AS c, sum(count(*)) OVER () AS n, count(*) OVER () AS k FROM s WHERE split = 'train' GROUP BY 1)
      SELECT split, CAST(settled_yes AS DOUBLE) AS label, count(*) AS rows, round(max(n / (k * c)), 8) AS weight FROM s LEFT JOIN t ON t.y = s.settled_yes WHERE settled_yes IS NOT NULL GROUP BY 1, 2""",
}
