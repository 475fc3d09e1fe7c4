"""Look-ups, top rows, JSON columns, audits by cut, and the choices of a summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import audits
from tidemark.catalog import views as v
from tidemark.functions import arrays as arr
from tidemark.functions import scalars as fn
from tidemark.operators import rank
from tidemark.operators import trades as tr
from tidemark.operators.pick import last_per_group, top_rows
from tidemark.plans import evaluate as ev
from tidemark.plans import gold, models
from tidemark.plans import quality as ql
from tidemark.sources import tables


def _round(cols, digits=6):
    return [F.round(c, digits).alias(c) for c in cols]


def feature_lookup(spark, sf):
    """Features of exactly the sample's market and second; samples half a day on find none."""
    p = v.predictions(spark, sf)
    samples = p.select("event_id", "market_id", F.date_trunc("hour", "sample_ts").alias("at"))
    rows = p.where("event_id % 2 = 0").select("market_id", F.date_trunc("hour", "sample_ts").alias("at"), "p_up", "yes_ask", F.col("event_id").alias("row_id"))
    out = tables.feature_lookup(samples, rows, keys=["market_id", "at"], columns=["p_up", "yes_ask"], tie=["row_id"])
    return out.select("event_id", "market_id", "p_up", F.round("yes_ask", 9).alias("yes_ask"))


def _metric_rows(spark, sf):
    p = v.predictions(spark, sf)
    gain = F.when(F.col("p_up") >= 0.9, F.col("settled_yes") - F.col("yes_ask"))
    return p.groupBy("market_id").agg(F.count("*").alias("rows"), F.count(gain).alias("trades"), F.round(F.avg(gain), 9).alias("avg_pnl"))


def top_metric_rows(spark, sf):
    """The 25 best markets; those without a trade stand last."""
    return top_rows(_metric_rows(spark, sf), score="avg_pnl", tie=["market_id"], k=25)


def top_metric_rows_nulls(spark, sf):
    """With few rated markets the list goes on with unrated ones."""
    rated = _metric_rows(spark, sf).withColumn("avg_pnl", F.when(F.col("market_id").cast("int") % 50 == 0, F.col("avg_pnl")))
    return top_rows(rated, score="avg_pnl", tie=["market_id"], k=60)


def json_columns(spark, sf):
    """Book levels (ten at most) and context as JSON text."""
    e = v.events(spark, sf)
    levels = F.transform(
        F.sequence(F.lit(1), F.col("k") % 14 + 1), lambda i: F.struct(i.cast("bigint").alias("price"), (i * F.col("event_id")).cast("bigint").alias("size"))
    )
    rows = e.select("event_id", "user_id", "event_type", "k", F.when(F.col("k") % 9 != 0, levels).alias("levels"))
    return rows.select("event_id", tables.levels_json("levels").alias("levels"), tables.event_json(rows, ["user_id", "event_type", "k"]).alias("context"))


def first_update_times(spark, sf):
    """The first 500 distinct (market, time) of quote updates, in order."""
    e = v.events(spark, sf).where("event_type IN ('view', 'click', 'error')").select(
        F.col("user_id").cast("string").alias("market_id"), F.date_trunc("hour", "ts").alias("ts_event"),
        F.when(F.col("event_type") == "view", F.col("value")).alias("best_bid"), F.when(F.col("event_type") == "click", F.col("value")).alias("best_ask"),
    )
    return tables.first_events(e, n=500).select("market_id", v.naive("sample_ts"))


def scored_edges(spark, sf):
    """A scoring table: probability and its edges over both asks."""
    p = v.predictions(spark, sf).withColumnRenamed("p_up", "p_model")
    return models.with_edges(p).select("event_id", "p_model", *_round(["edge_model_yes_ask", "edge_model_no_ask"], 9))


def label_match_rate(spark, sf):
    return ql.label_match_rate(audits.label_comparison(spark, sf)).select("entities", "compared", "matches", *_round(["match_rate"]))


_SPREAD = "CAST(floor((event_id % 13) / 4) AS BIGINT)"


def label_audit_cuts(spark, sf):
    """Results by time left, spread and confidence, in one pass."""
    p = v.predictions(spark, sf).withColumn("markout", F.round((F.col("settled_yes") - F.col("yes_ask")) / 10, 6))
    cuts = {"tte": F.col("tte_bucket"), "spread": F.floor(F.col("event_id") % 13 / 4), "confidence": ql.confidence_regime("p_up")}
    out = ql.label_audit_cuts(p, cuts=cuts, value="markout")
    return out.select("cut", "bucket", "rows", *_round(["mean", "positive_rate", "negative_rate", "abs_gt_1c_rate", "abs_gt_2c_rate", "p10", "p50", "p90"]))


def _summary_trades(spark, sf):
    p = v.predictions(spark, sf).where("p_up >= 0.5")
    return p.withColumns({"pnl": F.round(F.col("settled_yes") - F.col("yes_ask"), 6), "threshold": F.floor(F.col("p_up") * 10) / 10})


def summary_choices(spark, sf):
    """Best threshold, interval and label source by total result."""
    kinds = {"threshold": F.col("threshold"), "interval": F.col("tte_bucket"), "label_source": F.col("label_source")}
    return ev.best_choices(_summary_trades(spark, sf), choices=kinds).select("choice", "value", "trades", *_round(["total_pnl", "win_rate"], 5))


def winning_dates(spark, sf):
    return ev.winning_dates(_summary_trades(spark, sf), by=["tte_bucket"])


def entity_split_rows(spark, sf):
    """Every event with the split of its user."""
    e = v.table(spark, sf, "events").select("event_id", "user_id", "ts")
    return rank.entity_split(e, entity="user_id", ts="ts").select("event_id", "user_id", "split")


def last_event_per_user(spark, sf):
    e = v.table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return last_per_group(e, keys=["user_id"], order=["ts", "event_id"]).select("user_id", "event_id", "value")


def sequential_rows(spark, sf):
    """Row numbers in time order over all events."""
    e = v.table(spark, sf, "events").select("event_id", "ts")
    return tr.sequential_rows(e, ts="ts", tie=["event_id"]).select("event_id", F.col("row_idx").cast("bigint").alias("row_idx"))


def lead_values(spark, sf):
    """The price an hour and a day later, the first at or after within six hours."""
    p = v.predictions(spark, sf).select("event_id", "market_id", "sample_ts")
    px = v.predictions(spark, sf).select("market_id", "sample_ts", "yes_ask")
    out = gold.lead_time(p, px, keys=["market_id"], value="yes_ask", seconds=(3_600, 86_400), tolerance=21_600)
    return out.select("event_id", *_round(["yes_ask_in_3600s", "yes_ask_in_86400s"], 9))


def book_depth(spark, sf):
    """Depth of the first three levels of both sides, and its imbalance."""
    k = F.col("k")
    side = lambda n, size: F.transform(F.sequence(F.lit(1), n), lambda i: F.struct((i / 10).cast("double").alias("price"), (size * i).cast("double").alias("size")))
    e = v.events(spark, sf).select("event_id", side(k % 5 + 1, k + 1).alias("bids"), side(k % 4 + 1, k % 7 + 1).alias("asks"))
    made = arr.depth_metrics("bids", "asks", 3)
    return e.select("event_id", made["bid_depth_3"].alias("bid_depth_3"), made["ask_depth_3"].alias("ask_depth_3"), F.round(made["depth_imbalance_3"], 9).alias("depth_imbalance_3"))


def events_by_day(spark, sf):
    e = v.table(spark, sf, "events")
    return e.groupBy(fn.day_of("ts").alias("day")).agg(F.count("*").alias("rows"))


QUERIES = {
    n: f for n, f in list(globals().items())
    if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_")
}

_METRIC = f"""WITH {v.PRED}, m AS (SELECT market_id, count(*) AS rows, count(*) FILTER (p_up >= 0.9) AS trades, round(avg(settled_yes - yes_ask) FILTER (p_up >= 0.9), 9) AS avg_pnl FROM pred GROUP BY 1)"""
_NEAREST = lambda q: f"s[CAST(floor((len(s) - 1) * CAST({q} AS DOUBLE) + 0.5) AS BIGINT) + 1]"
_TRADES = f"{v.PRED}, t AS (SELECT *, round(settled_yes - yes_ask, 6) AS pnl, floor(p_up * 10) / 10 AS threshold FROM pred WHERE p_up >= 0.5)"

_LAST_SPLIT = """CASE WHEN i < CAST(trunc(n * CAST(0.7 AS DOUBLE)) AS BIGINT) THEN 'train'
        WHEN i < CAST(trunc(n * (CAST(0.7 AS DOUBLE) + CAST(0.15 AS DOUBLE))) AS BIGINT) THEN 'valid' ELSE 'test' END AS split"""

ORACLES = {
    "entity_split_rows": f"""WITH f AS (SELECT user_id, min(ts) AS t FROM events GROUP BY 1), r AS (SELECT user_id, row_number() OVER (ORDER BY t, user_id) - 1 AS i, count(*) OVER () AS n FROM f),
      s AS (SELECT user_id, {_LAST_SPLIT} FROM r) SELECT event_id, user_id, split FROM events JOIN s USING (user_id)""",
    "last_event_per_user": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1",
    "sequential_rows": "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_idx FROM events",
    "lead_values": f"""WITH {v.PRED}, a AS (SELECT p.event_id, CASE WHEN x.sample_ts - p.sample_ts <= INTERVAL 7 HOUR THEN round(x.yes_ask, 9) END AS v FROM pred p ASOF LEFT JOIN pred x ON x.market_id = p.market_id AND p.sample_ts + INTERVAL 1 HOUR <= x.sample_ts),
      b AS (SELECT p.event_id, CASE WHEN x.sample_ts - p.sample_ts <= INTERVAL 30 HOUR THEN round(x.yes_ask, 9) END AS v FROM pred p ASOF LEFT JOIN pred x ON x.market_id = p.market_id AND p.sample_ts + INTERVAL 24 HOUR <= x.sample_ts)
      SELECT event_id, a.v AS yes_ask_in_3600s, b.v AS yes_ask_in_86400s FROM a JOIN b USING (event_id)""",
    "book_depth": f"""WITH {v.EV}, d AS (SELECT event_id, list_sum(list_transform(range(1, least(3, k % 5 + 1) + 1), lambda i: (k + 1) * i))::DOUBLE AS b, list_sum(list_transform(range(1, least(3, k % 4 + 1) + 1), lambda i: (k % 7 + 1) * i))::DOUBLE AS a FROM ev)
      SELECT event_id, b AS bid_depth_3, a AS ask_depth_3, round((b - a) / (b + a), 9) AS depth_imbalance_3 FROM d""",
    "events_by_day": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS rows FROM events GROUP BY 1",
    "feature_lookup": f"""WITH {v.PRED}, f AS (SELECT market_id, date_trunc('hour', sample_ts) AS at, arg_max(p_up, event_id) AS p_up, arg_max(yes_ask, event_id) AS yes_ask FROM pred WHERE event_id % 2 = 0 GROUP BY 1, 2)
      SELECT p.event_id, p.market_id, f.p_up, round(f.yes_ask, 9) AS yes_ask FROM pred p LEFT JOIN f ON f.market_id = p.market_id AND f.at = date_trunc('hour', p.sample_ts)""",
    "top_metric_rows": f"{_METRIC} SELECT * FROM m ORDER BY avg_pnl DESC NULLS LAST, market_id LIMIT 25",
    "top_metric_rows_nulls": f"{_METRIC} SELECT market_id, rows, trades, CASE WHEN CAST(market_id AS INTEGER) % 50 = 0 THEN avg_pnl END AS avg_pnl FROM m ORDER BY 4 DESC NULLS LAST, market_id LIMIT 60",
    "json_columns": f"""WITH {v.EV} SELECT event_id, CASE WHEN k % 9 <> 0 THEN CAST(to_json(list_transform(range(1, least(10, k % 14 + 1) + 1), lambda i: {{'price': i, 'size': i * event_id}})) AS VARCHAR) END AS levels,
        CAST(to_json({{'user_id': user_id, 'event_type': event_type, 'k': k}}) AS VARCHAR) AS context FROM ev""",
    "first_update_times": """SELECT DISTINCT CAST(user_id AS VARCHAR) AS market_id, date_trunc('hour', ts) AS sample_ts FROM events WHERE event_type IN ('view', 'click') ORDER BY 1, 2 LIMIT 500""",
    "scored_edges": f"WITH {v.PRED} SELECT event_id, p_up AS p_model, round(p_up - yes_ask, 9) AS edge_model_yes_ask, round(1.0 - p_up - no_ask, 9) AS edge_model_no_ask FROM pred",
    "label_match_rate": f"WITH c AS ({audits.ORACLES['label_comparison']}) SELECT count(*) AS entities, count(match) AS compared, CAST(sum(match) AS BIGINT) AS matches, round(sum(match) / count(match), 6) AS match_rate FROM c",
    "label_audit_cuts": f"""WITH {v.PRED}, m AS (SELECT *, round((settled_yes - yes_ask) / 10, 6) AS markout FROM pred),
      l AS (SELECT 'tte' AS cut, tte_bucket AS bucket, markout FROM m UNION ALL SELECT 'spread', CAST({_SPREAD} AS VARCHAR), markout FROM m
        UNION ALL SELECT 'confidence', CASE WHEN abs(p_up - 0.5) >= 0.3 THEN 'high' WHEN abs(p_up - 0.5) >= 0.15 THEN 'medium' ELSE 'low' END, markout FROM m),
      a AS (SELECT cut, bucket, count(*) AS rows, avg(markout) AS mean, avg(CAST(markout > 0 AS INTEGER)) AS positive_rate, avg(CAST(markout < 0 AS INTEGER)) AS negative_rate,
        avg(CAST(abs(markout) > 0.01 AS INTEGER)) AS abs_gt_1c_rate, avg(CAST(abs(markout) > 0.02 AS INTEGER)) AS abs_gt_2c_rate, list_sort(list(markout)) AS s FROM l GROUP BY 1, 2)
      SELECT cut, bucket, rows, {", ".join(f"round({c}, 6) AS {c}" for c in ("mean", "positive_rate", "negative_rate", "abs_gt_1c_rate", "abs_gt_2c_rate"))},
        round({_NEAREST(0.1)}, 6) AS p10, round({_NEAREST(0.5)}, 6) AS p50, round({_NEAREST(0.9)}, 6) AS p90 FROM a""",
    "summary_choices": f"""WITH {_TRADES}, l AS (SELECT 'threshold' AS choice, CAST(threshold AS VARCHAR) AS value, pnl FROM t UNION ALL SELECT 'interval', tte_bucket, pnl FROM t UNION ALL SELECT 'label_source', label_source, pnl FROM t),
      g AS (SELECT choice, value, count(*) AS trades, sum(pnl) AS total_pnl, avg(CAST(pnl > 0 AS INTEGER)) AS win_rate FROM l WHERE value IS NOT NULL GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY choice ORDER BY total_pnl DESC, value) AS rn FROM g) SELECT choice, value, trades, round(total_pnl, 5) AS total_pnl, round(win_rate, 5) AS win_rate FROM r WHERE rn = 1""",
    "winning_dates": f"""WITH {_TRADES}, d AS (SELECT tte_bucket, date, sum(pnl) AS d FROM t GROUP BY 1, 2)
      SELECT tte_bucket, count(*) AS days, count(*) FILTER (d > 0) AS winning_days, min(date) FILTER (d > 0) AS first_win, max(date) FILTER (d > 0) AS last_win FROM d GROUP BY 1""",
}
