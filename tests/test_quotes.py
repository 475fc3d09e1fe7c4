import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import arrays as arr
from tidemark.functions import scalars as fn
from tidemark.functions.jsonfields import field, price_levels
from tidemark.plans import gold
from tidemark.plans import quotes as q

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SNAP = "market_id string, asset_id string, ts_event timestamp, ts_recv timestamp, best_bid double, best_ask double, bid_size_1 double, ask_size_1 double, source_file string"
CHANGE = "market_id string, asset_id string, ts_event timestamp, ts_recv timestamp, best_bid double, best_ask double, price double, event_type string, source_file string"


def at(s):
    return T0 + dt.timedelta(seconds=s)


def sampled(spark, snaps, changes, second=2, ttl=60):
    events = q.normalize_quote_events(
        spark.createDataFrame(snaps, SNAP) if snaps else None, spark.createDataFrame(changes, CHANGE) if changes else None
    )
    grid = spark.createDataFrame([("m", a, at(second)) for a in ("y", "n")], "market_id string, asset_id string, sample_ts timestamp")
    out = q.state_on_grid(grid, q.asset_quote_state(events), ttl_seconds=ttl)
    return {r.asset_id: r for r in out.collect()}


def test_change_overrides_snapshot(spark):
    got = sampled(
        spark, [("m", "y", at(0), at(0), 0.01, 0.99, 1.0, 1.0, "f")], [("m", "y", at(1), at(1), 0.48, 0.49, None, "price_change", "f")]
    )["y"]
    assert (got.current_bid, got.current_ask) == (0.48, 0.49)
    assert got.mid == pytest.approx(0.485) and not got.is_stale and got.quote_age_seconds == 1.0


def test_other_side_is_not_filled_in(spark):
    got = sampled(spark, None, [("m", "y", at(1), at(1), 0.48, 0.49, None, "price_change", "f")])["n"]
    assert (got.current_bid, got.current_ask, got.mid, got.is_stale) == (None, None, None, True)


def test_trade_price_is_not_a_quote(spark):
    got = sampled(spark, None, [("m", "y", at(1), at(1), None, None, 0.5, "last_trade_price", "f")])["y"]
    assert (got.current_bid, got.current_ask, got.mid) == (None, None, None)


def test_no_quote_from_the_future(spark):
    got = sampled(spark, None, [("m", "y", at(3), at(3), 0.4, 0.5, None, "price_change", "f")])["y"]
    assert got.current_bid is None and got.is_stale


def test_snapshot_applies_before_change_of_the_same_instant(spark):
    got = sampled(
        spark, [("m", "y", at(1), at(1), 0.1, 0.2, 5.0, 6.0, "f")], [("m", "y", at(1), at(1), 0.3, None, None, "price_change", "f")]
    )["y"]
    assert (got.current_bid, got.current_ask, got.current_bid_size, got.crossed_quote) == (0.3, 0.2, 5.0, True)


def test_stale_after_ttl_and_price_bounds(spark):
    got = sampled(spark, None, [("m", "y", at(0), at(0), 0.4, 1.2, None, "price_change", "f"), ("m", "n", at(0), at(0), 0.4, 0.5, None, "x", "f")], second=9, ttl=5)
    assert got["y"].current_ask is None and got["n"].is_stale and got["n"].quote_age_seconds == 9.0


def test_market_silver_pairs_both_sides(spark):
    dim = spark.createDataFrame(
        [("m", "y", "n", "ok", at(0), at(4))], "market_id string, yes_asset_id string, no_asset_id string, mapping_status string, market_start_ts timestamp, market_end_ts timestamp"
    )
    events = q.normalize_quote_events(
        None,
        spark.createDataFrame([("m", "y", at(1), at(1), 0.4, 0.5, None, "c", "f"), ("m", "n", at(2), at(2), 0.5, 0.6, None, "c", "f"), ("m", "y", at(3), at(3), 0.5, 0.6, None, "c", "f")], CHANGE),
    )
    rows = q.market_silver(dim, events, ttl_seconds=60).orderBy("sample_ts").collect()
    assert len(rows) == 5
    assert [r.yes_bid for r in rows] == [None, 0.4, 0.4, 0.5, 0.5]
    assert [r.no_ask for r in rows] == [None, None, 0.6, 0.6, 0.6]
    assert [r.pair_ask_sum for r in rows][2:] == pytest.approx([1.1, 1.2, 1.2])
    assert rows[3].yes_mid_change_1_past == pytest.approx(0.1) and rows[0].yes_mid_change_1_past is None
    assert [r.seconds_since_last_update for r in rows] == [None, 0.0, 0.0, 0.0, 1.0]
    assert [r.time_to_expiry_seconds for r in rows] == [4.0, 3.0, 2.0, 1.0, 0.0]


@pytest.mark.parametrize(
    "bids,asks,want",
    [
        ('[[".10","1"],[".40","4"],[".25","2"]]', '[[".90","9"],[".45","3"],[".50","5"]]', (0.40, 4.0, 0.45, 3.0)),
        (
            '[{"price":".20","size":"1"},{"price":".48","size":"7"},{"price":".31","size":"2"}]',
            '[{"price":".70","size":"1"},{"price":".49","size":"11"},{"price":".55","size":"2"}]',
            (0.48, 7.0, 0.49, 11.0),
        ),
    ],
)
def test_unsorted_levels(spark, bids, asks, want):
    df = spark.createDataFrame([(f'{{"bids":{bids},"asks":{asks}}}',)], "line string").withColumn("v", F.parse_json("line"))
    side = lambda n, s: arr.best_level(arr.sorted_levels(price_levels(field("v", n, "array<variant>")), s))
    r = df.select(side("bids", "bid").alias("b"), side("asks", "ask").alias("a")).first()
    assert (r.b.price, r.b.size, r.a.price, r.a.size) == want
    if want[0] == 0.48:
        assert r.a.price - r.b.price == 0.010000000000000009


def test_take_price_sweeps_levels_and_falls_back(spark):
    df = spark.createDataFrame([(1, [(0.5, 2.0), (0.4, 3.0), (0.6, 10.0)]), (2, [])], "id int, levels array<struct<price:double,size:double>>")
    out = df.select(
        "id", arr.take_price("levels", "ask", 6.0, fallback_price=F.lit(0.7), fallback_size=F.lit(4.0)).alias("t")
    ).orderBy("id").collect()
    assert out[0].t.avg_price == pytest.approx((3 * 0.4 + 2 * 0.5 + 1 * 0.6) / 6) and out[0].t.full and out[0].t.worst_price == 0.6
    assert (out[1].t.avg_price, out[1].t.filled, out[1].t.full) == (pytest.approx(0.7), 4.0, False)


@pytest.mark.parametrize("ret,t,want", [(0.001, 1e-4, "UP"), (-0.001, 1e-4, "DOWN"), (0.0, 1e-4, "FLAT"), (0.02, 0.01, "UP"), (-0.02, 0.01, "DOWN"), (0.005, 0.01, "FLAT"), (None, 0.01, "FLAT")])
def test_three_way(spark, ret, t, want):
    df = spark.createDataFrame([(ret,)], "r double")
    assert df.select(fn.three_way("r", t).alias("x")).first().x == want


def test_settlement_and_names(spark):
    df = spark.createDataFrame([(100.0, 101.0), (100.0, 99.0), (100.0, 100.0), (None, 1.0)], "o double, c double")
    assert [r.s for r in df.select(fn.settled_up("o", "c").alias("s")).collect()] == [1, 0, 0, None]
    names = ["future_x", "markout_1s", "label_y", "settled_yes", "btc_close_price", "mid_price"]
    assert [n for n in names if gold.is_feature(n)] == ["mid_price"]


def test_normal_cdf_is_close(spark):
    import math

    xs = [-4.0, -1.5, -0.1, 0.0, 0.3, 2.0, 5.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", fn.normal_cdf("x").alias("p")).collect():
        assert r.p == pytest.approx(0.5 * (1 + math.erf(r.x / math.sqrt(2))), abs=2e-7)
