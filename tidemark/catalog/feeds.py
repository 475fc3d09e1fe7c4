"""Queries on raw records, typed tables, order books and the market dimension."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.catalog import views as v
from tidemark.functions import arrays as arr
from tidemark.functions import scalars as fn
from tidemark.functions.jsonfields import elements_or_self, field, first_field, once, price_levels
from tidemark.operators import book
from tidemark.sources import bronze, markets, raw, salvage, tables
from tidemark.operators.scan import micros
from tidemark.session import stage


def feed(spark, sf):
    """The events written as JSON lines whose field names, shapes and units drift.

    Every tenth record occurs twice in a second file; every 97th is cut off.
    """
    e = v.events(spark, sf)
    us = micros("ts")
    n = F.col("event_id") % 3
    q = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    stamp = (
        F.when(n == 0, q((us / 1000).cast("bigint")))
        .when(n == 1, us.cast("string"))
        .otherwise(q(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")))
    )
    price, k, m = F.col("value") / 500, F.col("k"), F.col("user_id").cast("string")
    asset = F.concat(m, F.when(F.col("event_id") % 2 == 0, "-Y").otherwise("-N"))
    lvl = lambda p, s: F.when(
        n == 1, F.concat(F.lit("["), q(p), F.lit(","), q(s), F.lit("]"))
    ).otherwise(F.concat(F.lit('{"price":'), q(p), F.lit(',"size":'), q(s), F.lit("}")))
    pair = lambda a, b: F.concat(F.lit("["), a, F.lit(","), b, F.lit("]"))
    mk = F.when(n == 1, "market_id").otherwise("market")
    ak = F.when(n == 1, "token_id").otherwise("asset_id")
    book = F.concat(
        F.lit('[{"'), mk, F.lit('":'), q(m), F.lit(',"'), ak, F.lit('":'), q(asset), F.lit(',"timestamp":'), stamp,
        F.when(n == 2, F.lit(',"outcome":"yes"')).otherwise(""),
        F.lit(',"bids":'), pair(lvl(price / 2, k + 1), lvl(price, k)),
        F.lit(',"asks":'), pair(lvl(price + 0.02, k), lvl(price + 0.01, k + 3)), F.lit("}]"),
    )
    change = F.concat(
        F.lit('{"'), mk, F.lit('":'), q(m), F.lit(',"timestamp":'), stamp,
        F.lit(',"event_type":"price_change","'), F.when(n == 2, "changes").otherwise("price_changes"), F.lit('":['),
        F.lit('{"asset_id":'), q(F.concat(m, F.lit("-Y"))), F.lit(',"price":'), q(price), F.lit(',"best_bid":null,"best_ask":'), q(price + 0.01), F.lit(',"side":"BUY"},'),
        F.lit('{"asset_id":'), q(F.concat(m, F.lit("-N"))), F.lit(',"price":" bad ","best_bid":'), (price / 4).cast("string"), F.lit(',"side":"SELL"}]}'),
    )
    data = lambda stream, body: F.concat(F.lit('{"stream":"allusdt@' + stream + '","data":{"E":'), stamp, F.lit(","), body, F.lit("}}"))
    trade = data("aggTrade", F.concat(
        F.when(n == 1, "").otherwise(F.lit('"s":"ALLUSDT",')),
        F.lit('"'), F.when(n == 1, "price").otherwise("p"), F.lit('":'), q(F.col("value")), F.lit(',"q":'), q(k), F.lit(',"m":'),
        F.when(F.col("event_id") % 2 == 0, "true").otherwise('"0"'),
    ))
    ticker = data("bookTicker", F.concat(
        F.lit('"'), F.when(n == 1, "bidPrice").otherwise("b"), F.lit('":'), q(F.col("value")), F.lit(',"B":'), q(k),
        F.lit(',"'), F.when(n == 1, "ask_price").otherwise("a"), F.lit('":'), q(F.col("value") + 1), F.lit(',"A":'), q(F.lit(100) - k),
    ))
    depth = data("depth5@100ms", F.concat(
        F.lit('"bids":'), pair(pair(q(F.col("value")), q(k)), pair(q(F.col("value") - 1), q(k + 1))),
        F.lit(',"asks":'), pair(pair(q(F.col("value") + 1), q(k + 2)), F.lit('["x","3"]')),
    ))
    body = (
        F.when(F.col("event_type") == "view", book)
        .when(F.col("event_type") == "click", change)
        .when(F.col("event_type") == "purchase", trade)
        .when(F.col("event_type") == "signup", ticker)
        .otherwise(depth)
    )
    line = F.concat(F.lit('{"recv_ns":'), (us * 1000).cast("string"), F.lit(',"raw":'), body, F.lit("}"))
    line = F.when(F.col("event_id") % 97 == 0, F.substring(line, 1, 40)).otherwise(line)
    files = F.when(F.col("event_id") % 10 == 0, F.array(F.lit("a.jsonl"), F.lit("b.jsonl"))).otherwise(F.array(F.lit("a.jsonl")))
    # the feed arrives as files of lines: write it before reading it
    return stage(e.select(line.alias("line"), F.explode(files).alias("source_file")), "feed")


def typed(spark, sf):
    return bronze.typed(raw.records(raw.parse_lines(feed(spark, sf))))


def record_router(spark, sf):
    return bronze.file_type_counts(typed(spark, sf))


def raw_read_status(spark, sf):
    return raw.read_status(raw.parse_lines(feed(spark, sf)))


@F.pandas_udf(T.BinaryType())
def _gzipped(text: pd.Series) -> pd.Series:
    return text.map(lambda t: gzip.compress(t.encode()))


def raw_damaged_files(spark, sf):
    """The feed as one gzip file per user: whole, cut, with something behind it, or turned into rubbish."""
    lines = v.events(spark, sf).select("user_id", "event_id", F.when(F.col("event_id") % 97 == 0, '{"a":').otherwise(F.format_string('{"id":%s}', "event_id")).alias("line"))
    files = lines.groupBy("user_id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"])).alias("text"))
    packed = files.select("user_id", _gzipped("text").alias("c"))
    kind = F.col("user_id") % 4
    # without its last bytes a member has all its text, but does not end
    content = (
        F.when(kind == 1, F.substring(F.col("c"), F.lit(1), F.length("c") - 3)).when(kind == 2, F.concat("c", F.encode(F.lit("junk!"), "UTF-8")))
        .when(kind == 3, F.encode(F.lit("no gzip at all"), "UTF-8")).otherwise(F.col("c"))
    )
    out = salvage.salvage_status(salvage.salvage(packed.select(F.format_string("u%s.jsonl.gz", "user_id").alias("path"), content.alias("content"))))
    return out.select("source_file", "lines", "readable_rows", "corrupt_rows", "bytes_lost", "damage", "kept_readable_part")


def _table(spark, sf, name):
    return bronze.build(typed(spark, sf), only=[name])[name]


def bronze_best_quotes(spark, sf):
    t = _table(spark, sf, bronze.BEST_QUOTE)
    return t.select(v.naive("ts_event"), v.naive("ts_recv"), "symbol", "bid_price", "bid_qty", "ask_price", "ask_qty",
                    "mid_price", "spread", F.round("microprice", 8).alias("microprice"), "source_file", "date")


def bronze_trades(spark, sf):
    t = _table(spark, sf, bronze.TRADE)
    return t.select(v.naive("ts_event"), "symbol", "price", "qty", "is_buyer_maker", "side", F.round("notional", 6).alias("notional"), "source_file")


def bronze_depth(spark, sf):
    t = _table(spark, sf, bronze.DEPTH)
    return t.select(v.naive("ts_event"), "symbol", "bid_px_1", "bid_qty_1", "bid_px_2", "bid_qty_2", "bid_px_3", "ask_px_1", "ask_qty_1",
                    "ask_px_2", "ask_qty_2", "bid_depth_5", "ask_depth_5", F.round("depth_imbalance_5", 8).alias("depth_imbalance_5"))


def bronze_order_books(spark, sf):
    t = _table(spark, sf, bronze.ORDER_BOOK)
    return t.select(v.naive("ts_event"), "market_id", "asset_id", "outcome", "best_bid", "best_ask", F.round("mid", 9).alias("mid"),
                    F.round("spread", 9).alias("spread"), "bid_size_1", "ask_size_1", "bid_depth_3", "ask_depth_5",
                    F.round("depth_imbalance_5", 8).alias("depth_imbalance_5"), "source_file")


def bronze_price_changes(spark, sf):
    t = _table(spark, sf, bronze.PRICE_CHANGE)
    return t.select(v.naive("ts_event"), v.naive("ts_recv"), "market_id", "asset_id", "price", "best_bid", "best_ask", "side", "event_type")


def json_coalesce_fields(spark, sf):
    """One logical field from drifting names and units, straight from the record."""
    t = typed(spark, sf).where("source_file = 'a.jsonl'")
    return t.select(
        (F.try_variant_get("rec", "$.recv_ns", "decimal(19,0)") / 1000).cast("bigint").alias("recv_us"),
        first_field("rec", ("raw.data.p", "raw.data.price")).try_cast("double").alias("trade_price"),
        first_field("raw", ("market", "market_id")).alias("market"),
        "record_type",
    )


def record_profile(spark, sf):
    out = raw.profile(raw.records(raw.parse_lines(feed(spark, sf))))
    return out.select("source_file", "path", "occurrences", F.size("samples").alias("n_samples"), "time_candidate", "id_candidate")


def typed_record_profile(spark, sf):
    """Type counts, key sets and values of records seven levels deep, with arrays of mixed types."""
    e = v.table(spark, sf, "events")
    i, text = F.col("event_id"), lambda c: c.cast("string")
    line = F.concat(
        F.lit('{"id":'), text(i), F.lit(',"a":{"b":[{"c":{"d":['), text(F.col("user_id")), F.lit(',"'), F.col("event_type"),
        F.lit('",null,{"e":'), F.when(i % 2 == 0, "true").otherwise('{"f":[0.5]}'), F.lit("}]}},"), text(i % 7), F.lit(']},"t":'),
        F.when(i % 3 == 0, '"x"').when(i % 3 == 1, "1").otherwise("[true,[],{}]"), F.lit("}"),
    )
    files = F.concat(F.lit("f"), text(i % 2), F.lit(".jsonl"))
    lines = e.select(F.when(i % 89 == 0, F.substring(line, 1, 30)).otherwise(line).alias("line"), files.alias("source_file"))
    out = raw.typed_profile(raw.records(raw.parse_lines(lines)))
    return out.select(
        "source_file", "path", "occurrences", *[f"n_{k}" for k in raw.KINDS], F.concat_ws(",", "keys").alias("keys"), "least_value", "greatest_value"
    )


def epoch_units(spark, sf):
    """The same instant as seconds, milliseconds, microseconds, nanoseconds and text."""
    e = v.table(spark, sf, "events").withColumn("us", micros("ts"))
    us = F.col("us")
    return e.select(
        "event_id",
        *[
            fn.parse_epoch(c).cast("timestamp_ntz").alias(n)
            for n, c in {
                "from_s": (us / 1_000_000).cast("bigint").cast("string"),
                "from_ms": (us / 1_000).cast("bigint").cast("string"),
                "from_us": us.cast("string"),
                "from_ns": (us * 1000 + 999).cast("string"),
                "from_iso": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"),
                "from_bad": F.concat(F.lit("x"), us.cast("string")),
            }.items()
        ],
        fn.parse_epoch((us / 1000).cast("bigint").cast("string"), "ms_or_s").cast("timestamp_ntz").alias("live_ms"),
    )


def lenient_casts(spark, sf):
    """Numbers, flags, outcomes, symbols and dates from untidy text."""
    e = v.events(spark, sf)
    k = F.col("k")
    text = (
        F.when(k % 6 == 0, F.concat(F.lit(" "), k.cast("string"), F.lit(" ")))
        .when(k % 6 == 1, "NaN").when(k % 6 == 2, "").when(k % 6 == 3, "abc").when(k % 6 == 4, "1e3").otherwise("-Infinity")
    )
    flag = F.when(k % 4 == 0, " True ").when(k % 4 == 1, "no").when(k % 4 == 2, "0").otherwise("maybe")
    outcome = F.when(k % 5 == 0, " up").when(k % 5 == 1, "Below").when(k % 5 == 2, "yes").when(k % 5 == 3, "N").otherwise("draw")
    return e.select(
        "event_id",
        fn.lenient_double(text).alias("number"),
        fn.lenient_bool(flag).alias("flag"),
        fn.outcome_alias(outcome).alias("outcome"),
        fn.outcome_exact(outcome).alias("exact"),
        fn.symbol_from_stream(F.concat(F.col("event_type"), F.lit("@depth@100ms"))).alias("symbol"),
        fn.date_text(F.when(k % 2 == 0, F.date_format("ts", "yyyyMMdd")).otherwise(F.date_format("ts", "yyyy-MM-dd"))).alias("day"),
        fn.iso_utc_text(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssxxx")).alias("iso"),
        F.round(fn.taker_fee(F.col("value") / 100, 0.07), 7).alias("fee"),
        fn.bucket_label(F.col("value") / 500 - 0.1, fn.EDGE, "unbucketed").alias("edge_bucket"),
        fn.bucket_label(F.col("value") / 500, fn.ASK_PRICE, "unbucketed").alias("ask_bucket"),
    )


def _levels(spark, sf):
    return v.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")


def book_best_depth(spark, sf):
    """Best level and depth of each order's lines seen as a book side."""
    at = dict(keys=["l_orderkey"], price="l_extendedprice", size="l_quantity", tie="l_linenumber")
    bid = book.best_levels(_levels(spark, sf), side="bid", **at).withColumnRenamed("levels", "bid")
    ask = book.best_levels(_levels(spark, sf), side="ask", **at).withColumnRenamed("levels", "ask")
    return bid.join(ask, "l_orderkey").select(
        "l_orderkey",
        arr.best_level("bid").getField("price").alias("best_bid"),
        arr.best_level("ask").getField("price").alias("best_ask"),
        arr.best_level("ask").getField("size").alias("ask_size"),
        arr.depth_sum("bid", 3).alias("bid_depth_3"),
        arr.depth_sum("ask", 5).alias("ask_depth_5"),
    )


def book_sweep(spark, sf):
    """Cost of taking 60 units from the cheapest lines up."""
    out = book.sweep(_levels(spark, sf), keys=["l_orderkey"], price="l_extendedprice", size="l_quantity", tie="l_linenumber", side="ask", shares=60.0, price_bucket=1_000.0)
    return out.select("l_orderkey", F.round("avg_price", 7).alias("avg_price"), "filled", "full", "worst_price")


def book_sweep_snapshots(spark, sf):
    """Cost of taking 60 units from the asks of each book snapshot in the feed."""
    rows = typed(spark, sf).where("record_type = 'order_book' AND source_file = 'a.jsonl'")
    books = rows.select(F.explode(elements_or_self("raw")).alias("b"))
    sides = books.select(
        first_field("b", ("market", "market_id")).alias("market_id"),
        price_levels(field("b", "asks", "array<variant>")).alias("asks"),
    )
    t = arr.take_price("asks", "ask", 60.0)
    return sides.select("market_id", t.alias("t")).groupBy("market_id").agg(
        F.count("*").alias("books"), F.count_if(F.col("t.full")).alias("full_books"),
        F.round(F.sum("t.filled"), 4).alias("filled"), F.round(F.avg("t.avg_price"), 6).alias("avg_price"),
        F.max("t.worst_price").alias("worst_price"),
    )


def _votes(spark, sf):
    o = v.table(spark, sf, "orders")
    return o.select(
        F.col("o_custkey").cast("string").alias("market_id"),
        (F.col("o_orderkey") % 3).cast("string").alias("asset_id"),
        F.when(F.col("o_orderstatus") == "F", "yes").when(F.col("o_orderstatus") == "O", "NO").otherwise("pending").alias("outcome"),
        F.col("o_orderdate").alias("ts_event"),
    )


def vote_mapping_status(spark, sf):
    rows = _votes(spark, sf)
    m = markets.discovered(rows, v.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("market_id")))
    out = markets.mapping_status(m, markets.asset_votes(rows))
    return out.select("market_id", "mapping_status", "yes_asset_id", "no_asset_id", F.array_join("yes_ids", ",").alias("yes_ids"), F.array_join("no_ids", ",").alias("no_ids"))


def market_first_events(spark, sf):
    rows = _votes(spark, sf)
    spans = markets.market_spans(rows, duration_seconds=300)
    return (
        spans.join(markets.sampled_ids(rows, k=2), "market_id").join(markets.has_outcome(rows.withColumn("outcome", fn.outcome_exact("outcome"))), "market_id")
        .select("market_id", v.naive("start_ts"), v.naive("end_ts"), F.array_join("asset_ids", ",").alias("asset_ids"), v.naive("first_ts"), "has_outcome")
    )


def _meta(spark, sf):
    """Customers as market metadata records of varying completeness."""
    # a small file is one task, and records cost far more than their bytes
    c = v.table(spark, sf, "customer").select("c_custkey").repartition(4 * spark.sparkContext.defaultParallelism, "c_custkey")
    k = F.col("c_custkey")
    start = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + k * 900 + F.when(k % 4 == 0, 7200).otherwise(60)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    outcomes = F.when(k % 5 == 0, '["No","Yes"]').when(k % 5 == 1, '["Up","Down"]').when(k % 5 == 2, '["Yes"]').otherwise('["Yes","No"]')
    ks = k.cast("string")
    text = F.concat(
        F.lit('{"id":"'), ks, F.lit('","conditionId":"c'), ks, F.lit('","startDate":'), F.when(k % 7 == 0, F.lit("null")).otherwise(F.concat(F.lit('"'), start, F.lit('"'))),
        F.lit(',"outcomes":"'), F.replace(outcomes, F.lit('"'), F.lit('\\"')), F.lit('","clobTokenIds":["'), ks, F.lit('a","'), ks, F.lit('b"]'),
        F.lit(',"outcomePrices":"[\\"'), F.when(k % 3 == 0, "0.995").otherwise("0.3"), F.lit('\\",\\"'), F.when(k % 3 == 0, "0.005").otherwise("0.7"), F.lit('\\"]"'),
        F.when(k % 11 == 0, F.lit(',"Winner":"No"')).when(k % 13 == 0, F.concat(F.lit(',"WINNING_token_id":"'), ks, F.lit('b"'))).otherwise(""),
        F.lit(',"active":true,"slug":"s'), ks, F.lit('"}'),
    )
    slot = F.timestamp_seconds(F.lit(1_704_067_200) + k * 900)
    out = once(c, {"rec": F.parse_json(text)})  # filters on a record stay behind it, and so behind the shuffle
    return out.select("c_custkey", "rec", slot.alias("slot_start"), (slot + F.expr("INTERVAL 15 MINUTES")).alias("slot_end"))


def market_metadata_rows(spark, sf):
    out = markets.market_rows(_meta(spark, sf))
    return out.select("market_id", "yes_asset_id", "no_asset_id", v.naive("market_start_ts"), v.naive("market_end_ts"), "slug", "active", "closed")


def settled_results(spark, sf):
    m = _meta(spark, sf)
    k = F.col("c_custkey").cast("string")
    pairs = markets.token_pairs(m)
    return pairs.select(
        "c_custkey",
        markets.settled_result("rec", F.concat(k, F.lit("a")), F.concat(k, F.lit("b"))).alias("settled_yes"),
        F.array_join("yes_ids", ",").alias("yes_ids"), F.array_join("no_ids", ",").alias("no_ids"), "issue",
    )


def interval_slots(spark, sf):
    m = v.markets(spark, sf).select("market_id", "market_start_ts", fn.plus_ms("market_start_ts", 86_400_000).alias("stop_ts"))
    out = markets.interval_slots(m, start="market_start_ts", stop="stop_ts", minutes=15)
    return out.select("market_id", v.naive("slot_start"), v.naive("slot_end"), "slug")


def merged_mapping(spark, sf):
    c = v.table(spark, sf, "customer")
    gen = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("market_id"), F.col("c_name").alias("question"), F.lit(None).cast("string").alias("note"))
    man = c.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("market_id"), F.col("c_mktsegment").alias("question"), F.lit("manual").alias("note"))
    return markets.merge_mapping(gen, man)


def upserted_markets(spark, sf):
    c = v.table(spark, sf, "customer")
    old = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("market_id"), "c_acctbal", F.lit(1).alias("version"))
    new = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("market_id"), (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit(2).alias("version"))
    return markets.upsert(old, new, stamp="version")


def nested_entities(spark, sf):
    """Market records found anywhere inside nested documents."""
    c = v.table(spark, sf, "customer")
    inner = F.to_json(F.struct(F.col("c_custkey").cast("string").alias("market_id"), "c_name"))
    doc = F.concat(F.lit('{"a":{"b":[[{"groups":[{"x":1,"items":'), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("["), inner, F.lit("]"))).otherwise(inner), F.lit("}]}]]}}"))
    found = markets.find_entities(c.select(F.parse_json(doc).alias("rec")))
    return found.select("entity_id", F.try_variant_get("rec", "$.c_name", "string").alias("name"))


def latest_signals(spark, sf):
    """Queue and table rows of one version, the queue row preferred, newest week only."""
    e = v.events(spark, sf)
    base = e.select((F.col("event_id") % 5000).alias("signal_id"), F.col("ts").alias("sample_ts"), "event_type", F.concat(F.lit("v"), (F.col("k") % 2).cast("string")).alias("model_version"), "event_id")
    queue = base.where("event_type = 'click'").withColumn("queued", F.lit(True))
    table = base.where("event_type IN ('view', 'click')")
    out = tables.combined_signals(queue, table, version="v1", newer_than=F.lit("2024-01-24").cast("timestamp"))
    return out.select("signal_id", "event_id", F.coalesce("queued", F.lit(False)).alias("queued"), v.naive("sample_ts"))


def newest_runs(spark, sf):
    e = v.events(spark, sf)
    d = e.select(F.col("event_type").alias("mode"), (F.col("k") % 2 == 0).alias("forced"), F.col("event_id").cast("string").alias("run_id"), F.col("ts").alias("created_at"))
    return tables.newest_runs(d).select("mode", "forced", "run_id", v.naive("created_at"))


def retained_rows(spark, sf):
    e = v.table(spark, sf, "events").withColumn("date", F.date_format("ts", "yyyy-MM-dd"))
    kept = tables.within_retention(e, days=7, today="2024-01-30")
    return tables.in_date_range(kept, end="2024-01-29").groupBy("date").agg(F.count("*").alias("rows"))


def dimension_build(spark, sf):
    """Market dimension from the events: discovered, voted, timed."""
    out = markets.build_dimension(_votes(spark, sf), duration_seconds=900)
    return out.select("market_id", "mapping_status", v.naive("market_start_ts"), v.naive("market_end_ts"))


def asset_enrichment(spark, sf):
    """Quote events with the market and direction of their asset id."""
    rows = v.snapshots(spark, sf).select("asset_id").unionByName(v.changes(spark, sf).select("asset_id"))
    return markets.with_market_of_asset(rows, v.markets(spark, sf)).groupBy("market_id", "direction").agg(F.count("*").alias("rows"))


def unprocessed_signals(spark, sf):
    e = v.table(spark, sf, "events")
    done = e.where("event_id % 3 = 0").select("event_id")
    return tables.unprocessed(e.where("event_type = 'view'").select("event_id"), done, key="event_id")


def wanted_assets(spark, sf):
    e = v.table(spark, sf, "events").withColumn("market_id", F.col("user_id").cast("string"))
    return tables.missing_ids(e.where("event_type = 'purchase'"), e.where("event_type = 'signup' AND event_id % 20 = 0"), key="market_id")


def compact_dimension(spark, sf):
    m = v.markets(spark, sf)
    samples = m.select("*", F.explode(F.array("market_start_ts", "market_end_ts")).alias("sample_ts"))
    out = markets.compact_dimension(samples)
    return out.select("market_id", "yes_asset_id", "no_asset_id", v.naive("market_start_ts"), v.naive("market_end_ts"))


QUERIES = {
    n: f for n, f in list(globals().items())
    if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_") and n not in ("feed", "typed", "stage", "micros", "first_field")
}

EVD = f"{v.EV}, e AS (SELECT *, event_id % 3 AS n, value / 500 AS p, epoch_us(ts) AS us, strftime(ts, '%Y-%m-%d') AS date FROM ev WHERE event_id % 97 <> 0), "
# the feed carries milliseconds, microseconds or text depending on the record
_TS = "CASE WHEN n = 0 THEN make_timestamp(us // 1000 * 1000) ELSE ts END"

ORACLES = {
    "record_router": f"""WITH {v.EV}, f AS (SELECT *, 'a.jsonl' AS source_file FROM ev UNION ALL SELECT *, 'b.jsonl' FROM ev WHERE event_id % 10 = 0)
      SELECT source_file, count(*) AS records, count(*) FILTER (event_type = 'signup') AS best_quote, count(*) FILTER (event_type = 'purchase') AS trade,
        count(*) FILTER (event_type = 'error') AS depth, count(*) FILTER (event_type = 'view') AS order_book, count(*) FILTER (event_type = 'click') AS price_change,
        CAST(0 AS BIGINT) AS unknown FROM f WHERE event_id % 97 <> 0 GROUP BY 1""",
    "typed_record_profile": r"""WITH f AS (SELECT 'f' || (event_id % 2) || '.jsonl' AS source_file,
        '{"id":' || event_id || ',"a":{"b":[{"c":{"d":[' || user_id || ',"' || event_type || '",null,{"e":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE '{"f":[0.5]}' END
          || '}]}},' || (event_id % 7) || ']},"t":' || CASE event_id % 3 WHEN 0 THEN '"x"' WHEN 1 THEN '1' ELSE '[true,[],{}]' END || '}' AS line
        FROM events WHERE event_id % 89 <> 0),
      d AS (SELECT source_file, regexp_replace(regexp_replace(t.fullkey, '\[\d+\]', '[]', 'g'), '^\$\.?', '') AS path, t.type, CASE WHEN t.type NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN t.atom ->> '$' END AS value, t.atom, t.json
        FROM f, json_tree(f.line) t),
      p AS (SELECT source_file, path, count(*) AS occurrences, count(*) FILTER (type = 'OBJECT') AS n_object, count(*) FILTER (type = 'ARRAY') AS n_array, count(*) FILTER (type = 'VARCHAR') AS n_string,
        count(*) FILTER (type IN ('UBIGINT', 'BIGINT', 'DOUBLE')) AS n_number, count(*) FILTER (type = 'BOOLEAN') AS n_boolean, count(*) FILTER (type = 'NULL') AS n_null, min(value) AS least_value, max(value) AS greatest_value FROM d GROUP BY 1, 2),
      k AS (SELECT source_file, regexp_replace(path, '(^|\.)[^.\[\]]+$', '') AS path, string_agg(regexp_extract(path, '([^.\[\]]+)$', 1), ',' ORDER BY regexp_extract(path, '([^.\[\]]+)$', 1)) AS keys FROM p WHERE regexp_matches(path, '[^.\[\]]+$') GROUP BY 1, 2)
      SELECT p.* , coalesce(k.keys, '') AS keys FROM p LEFT JOIN k USING (source_file, path)""",
    "raw_read_status": f"""WITH {v.EV}, f AS (SELECT *, 'a.jsonl' AS source_file FROM ev UNION ALL SELECT *, 'b.jsonl' FROM ev WHERE event_id % 10 = 0)
      SELECT source_file, count(*) AS lines, count(*) FILTER (event_id % 97 <> 0) AS readable_rows, count(*) FILTER (event_id % 97 = 0) AS corrupt_rows,
        count(*) FILTER (event_id % 97 = 0) > 0 AS kept_readable_part FROM f GROUP BY 1""",
    "raw_damaged_files": """SELECT 'u' || user_id || '.jsonl.gz' AS source_file, CASE WHEN user_id % 4 = 3 THEN 0 ELSE count(*) END AS lines,
        CASE WHEN user_id % 4 = 3 THEN 0 ELSE count(*) FILTER (event_id % 97 <> 0) END AS readable_rows, CASE WHEN user_id % 4 = 3 THEN 0 ELSE count(*) FILTER (event_id % 97 = 0) END AS corrupt_rows,
        CAST(CASE user_id % 4 WHEN 2 THEN 5 WHEN 3 THEN 14 ELSE 0 END AS BIGINT) AS bytes_lost, CASE user_id % 4 WHEN 1 THEN 'cut' WHEN 2 THEN 'trailing' WHEN 3 THEN 'unreadable' END AS damage,
        user_id % 4 <> 3 AND (user_id % 4 > 0 OR count(*) FILTER (event_id % 97 = 0) > 0) AND count(*) FILTER (event_id % 97 <> 0) > 0 AS kept_readable_part FROM events GROUP BY user_id""",
    "bronze_best_quotes": f"""WITH {EVD} x AS (SELECT *, {_TS} AS ts_event FROM e WHERE event_type = 'signup')
      SELECT ts_event, ts AS ts_recv, 'ALLUSDT' AS symbol, value AS bid_price, CAST(k AS DOUBLE) AS bid_qty, value + 1 AS ask_price, CAST(100 - k AS DOUBLE) AS ask_qty,
        (value + (value + 1)) / 2.0 AS mid_price, (value + 1) - value AS spread, round(((value + 1) * k + value * (100 - k)) / 100.0, 8) AS microprice, 'a.jsonl' AS source_file, strftime(ts_event, '%Y-%m-%d') AS date FROM x""",
    "bronze_trades": f"""WITH {EVD} x AS (SELECT *, {_TS} AS ts_event FROM e WHERE event_type = 'purchase')
      SELECT ts_event, 'ALLUSDT' AS symbol, value AS price, CAST(k AS DOUBLE) AS qty, event_id % 2 = 0 AS is_buyer_maker,
        CASE WHEN event_id % 2 = 0 THEN 'sell_aggressor' ELSE 'buy_aggressor' END AS side, round(value * k, 6) AS notional, 'a.jsonl' AS source_file FROM x""",
    "bronze_depth": f"""WITH {EVD} x AS (SELECT *, {_TS} AS ts_event FROM e WHERE event_type = 'error')
      SELECT ts_event, 'ALLUSDT' AS symbol, value AS bid_px_1, CAST(k AS DOUBLE) AS bid_qty_1, value - 1 AS bid_px_2, CAST(k + 1 AS DOUBLE) AS bid_qty_2, CAST(NULL AS DOUBLE) AS bid_px_3,
        value + 1 AS ask_px_1, CAST(k + 2 AS DOUBLE) AS ask_qty_1, CAST(NULL AS DOUBLE) AS ask_px_2, CAST(3 AS DOUBLE) AS ask_qty_2,
        CAST(2 * k + 1 AS DOUBLE) AS bid_depth_5, CAST(k + 5 AS DOUBLE) AS ask_depth_5, round((2 * k + 1 - (k + 5)) / CAST(3 * k + 6 AS DOUBLE), 8) AS depth_imbalance_5 FROM x""",
    "bronze_order_books": f"""WITH {EVD} x AS (SELECT *, {_TS} AS ts_event, CAST(user_id AS VARCHAR) AS market_id FROM e WHERE event_type = 'view')
      SELECT ts_event, market_id, market_id || CASE WHEN event_id % 2 = 0 THEN '-Y' ELSE '-N' END AS asset_id, CASE WHEN n = 2 THEN 'YES' END AS outcome,
        p AS best_bid, p + 0.01 AS best_ask, round((p + (p + 0.01)) / 2.0, 9) AS mid, round(p + 0.01 - p, 9) AS spread,
        CAST(CASE WHEN p = 0 THEN k + 1 ELSE k END AS DOUBLE) AS bid_size_1, CAST(k + 3 AS DOUBLE) AS ask_size_1, CAST(2 * k + 1 AS DOUBLE) AS bid_depth_3, CAST(2 * k + 3 AS DOUBLE) AS ask_depth_5,
        round(-2 / CAST(4 * k + 4 AS DOUBLE), 8) AS depth_imbalance_5, 'a.jsonl' AS source_file FROM x""",
    "bronze_price_changes": f"""WITH {EVD} x AS (SELECT *, {_TS} AS ts_event, CAST(user_id AS VARCHAR) AS market_id FROM e WHERE event_type = 'click')
      SELECT ts_event, ts AS ts_recv, market_id, market_id || '-Y' AS asset_id, p AS price, CAST(NULL AS DOUBLE) AS best_bid, p + 0.01 AS best_ask, 'BUY' AS side, 'price_change' AS event_type FROM x
      UNION ALL SELECT ts_event, ts, market_id, market_id || '-N', NULL, p / 4, NULL, 'SELL', 'price_change' FROM x""",
    "json_coalesce_fields": f"""WITH {EVD.rstrip(', ')} SELECT us AS recv_us, CASE WHEN event_type = 'purchase' THEN value END AS trade_price,
        CASE WHEN event_type = 'click' THEN CAST(user_id AS VARCHAR) END AS market,
        CASE event_type WHEN 'view' THEN 'order_book' WHEN 'click' THEN 'price_change' WHEN 'purchase' THEN 'trade' WHEN 'signup' THEN 'best_quote' ELSE 'depth' END AS record_type FROM e""",
    "epoch_units": """SELECT event_id, make_timestamp(epoch_us(ts) // 1000000 * 1000000) AS from_s, make_timestamp(epoch_us(ts) // 1000 * 1000) AS from_ms, ts AS from_us, ts AS from_ns, ts AS from_iso,
        CAST(NULL AS TIMESTAMP) AS from_bad, make_timestamp(epoch_us(ts) // 1000 * 1000) AS live_ms FROM events""",
    "lenient_casts": f"""WITH {v.EV} SELECT event_id, CASE k % 6 WHEN 0 THEN CAST(k AS DOUBLE) WHEN 4 THEN 1000.0 END AS number,
        CASE k % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END AS flag, CASE k % 5 WHEN 0 THEN 'YES' WHEN 1 THEN 'NO' WHEN 2 THEN 'YES' WHEN 3 THEN 'NO' END AS outcome,
        CASE k % 5 WHEN 2 THEN 'YES' END AS exact, upper(event_type) AS symbol, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso,
        round(0.07 * least(value / 100, 1.0) * (1 - least(value / 100, 1.0)), 7) AS fee,
        CASE {" ".join(f"WHEN {'true' if lo is None else f'value / 500 - 0.1 >= {lo}'} AND {'true' if hi is None else f'value / 500 - 0.1 < {hi}'} THEN '{t}'" for lo, hi, t in fn.EDGE)} END AS edge_bucket,
        CASE {" ".join(f"WHEN {'true' if lo is None else f'value / 500 >= {lo}'} AND {'true' if hi is None else f'value / 500 < {hi}'} THEN '{t}'" for lo, hi, t in fn.ASK_PRICE)} END AS ask_bucket FROM ev""",
    "book_best_depth": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber) AS a FROM lineitem)
      SELECT l_orderkey, max(l_extendedprice) AS best_bid, min(l_extendedprice) AS best_ask, max(l_quantity) FILTER (a = 1) AS ask_size,
        sum(l_quantity) FILTER (b <= 3) AS bid_depth_3, sum(l_quantity) FILTER (a <= 5) AS ask_depth_5 FROM r GROUP BY 1""",
    "book_sweep": """WITH r AS (SELECT *, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lineitem),
      t AS (SELECT *, least(l_quantity, greatest(0, 60 - before)) AS take FROM r)
      SELECT l_orderkey, round(sum(take * l_extendedprice) / sum(take), 7) AS avg_price, sum(take) AS filled, sum(take) + 1e-9 >= 60 AS "full", max(CASE WHEN take > 0 THEN l_extendedprice END) AS worst_price FROM t GROUP BY 1""",
    "book_sweep_snapshots": f"""WITH {EVD} x AS (SELECT CAST(user_id AS VARCHAR) AS market_id, p + 0.01 AS p1, k + 3 AS q1, p + 0.02 AS p2, k AS q2 FROM e WHERE event_type = 'view'),
      t AS (SELECT *, least(q1, 60) AS t1, least(q2, greatest(0, 60 - q1)) AS t2 FROM x)
      SELECT market_id, count(*) AS books, count(*) FILTER (t1 + t2 >= 60) AS full_books, CAST(sum(t1 + t2) AS DOUBLE) AS filled, round(avg((t1 * p1 + t2 * p2) / (t1 + t2)), 6) AS avg_price,
        max(CASE WHEN t2 > 0 THEN p2 ELSE p1 END) AS worst_price FROM t GROUP BY 1""",
    "dimension_build": """WITH o AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS market_id, CAST(o_orderkey % 3 AS VARCHAR) AS a, o_orderstatus AS s FROM orders WHERE o_orderstatus IN ('F', 'O')),
      g AS (SELECT market_id, count(*) FILTER (s = 'F') AS y, count(*) FILTER (s = 'O') AS n FROM o GROUP BY 1), f AS (SELECT CAST(o_custkey AS VARCHAR) AS market_id, min(o_orderdate) AS t FROM orders GROUP BY 1)
      SELECT f.market_id, CASE WHEN y = 1 AND n = 1 THEN 'ok' WHEN y > 0 OR n > 0 THEN 'conflict' ELSE 'unmapped' END AS mapping_status, t AS market_start_ts, t + INTERVAL 900 SECOND AS market_end_ts FROM f LEFT JOIN g USING (market_id)""",
    "asset_enrichment": f"""WITH {v.QUOTES} SELECT market_id, CASE WHEN asset_id LIKE '%-Y' THEN 'UP' ELSE 'DOWN' END AS direction, count(*) AS rows FROM quotes GROUP BY 1, 2""",
    "unprocessed_signals": "SELECT event_id FROM events WHERE event_type = 'view' AND event_id % 3 <> 0",
    "wanted_assets": "SELECT DISTINCT CAST(user_id AS VARCHAR) AS market_id FROM events WHERE event_type = 'purchase' EXCEPT SELECT CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'signup' AND event_id % 20 = 0",
    "compact_dimension": f"""WITH {v.MARKETS} SELECT market_id, yes_asset_id, no_asset_id, market_start_ts, market_end_ts FROM markets""",
    "vote_mapping_status": """WITH o AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS market_id, CAST(o_orderkey % 3 AS VARCHAR) AS a, o_orderstatus AS s FROM orders WHERE o_orderstatus IN ('F', 'O')),
      g AS (SELECT market_id, coalesce(string_agg(a, ',' ORDER BY a) FILTER (s = 'F'), '') AS yes_ids, coalesce(string_agg(a, ',' ORDER BY a) FILTER (s = 'O'), '') AS no_ids, count(*) FILTER (s = 'F') AS y, count(*) FILTER (s = 'O') AS n FROM o GROUP BY 1)
      SELECT CAST(c_custkey AS VARCHAR) AS market_id, CASE WHEN y = 1 AND n = 1 THEN 'ok' WHEN y > 0 OR n > 0 THEN 'conflict' ELSE 'unmapped' END AS mapping_status,
        CASE WHEN y = 1 AND n = 1 THEN yes_ids END AS yes_asset_id, CASE WHEN y = 1 AND n = 1 THEN no_ids END AS no_asset_id, coalesce(yes_ids, '') AS yes_ids, coalesce(no_ids, '') AS no_ids
      FROM customer LEFT JOIN g ON g.market_id = CAST(c_custkey AS VARCHAR)""",
    "market_first_events": """SELECT CAST(o_custkey AS VARCHAR) AS market_id, min(o_orderdate) AS start_ts, min(o_orderdate) + INTERVAL 300 SECOND AS end_ts,
        array_to_string(list_slice(list_sort(list(DISTINCT CAST(o_orderkey % 3 AS VARCHAR))), 1, 2), ',') AS asset_ids, min(o_orderdate) AS first_ts, bool_or(o_orderstatus IN ('F', 'O')) AS has_outcome FROM orders GROUP BY 1""",
    "market_metadata_rows": """WITH c AS (SELECT c_custkey AS k, make_timestamp((1704067200 + c_custkey * 900) * 1000000) AS slot FROM customer)
      SELECT 'c' || k AS market_id, k || CASE WHEN k % 5 = 0 THEN 'b' ELSE 'a' END AS yes_asset_id, k || CASE WHEN k % 5 = 0 THEN 'a' ELSE 'b' END AS no_asset_id,
        CASE WHEN k % 7 = 0 OR k % 4 = 0 THEN slot ELSE slot + INTERVAL 60 SECOND END AS market_start_ts, slot + INTERVAL 15 MINUTE AS market_end_ts, 's' || k AS slug, true AS active, false AS closed
      FROM c WHERE k % 5 <> 2""",
    "settled_results": """WITH c AS (SELECT c_custkey AS k FROM customer)
      SELECT k AS c_custkey, CASE WHEN k % 11 = 0 THEN 0 WHEN k % 13 = 0 THEN 0 WHEN k % 3 = 0 THEN 1
          WHEN k % 5 = 0 THEN 1 WHEN k % 5 = 1 THEN NULL WHEN k % 5 = 2 THEN NULL ELSE 0 END AS settled_yes,
        CASE k % 5 WHEN 0 THEN k || 'b' ELSE k || 'a' END AS yes_ids, CASE k % 5 WHEN 0 THEN k || 'a' WHEN 2 THEN '' ELSE k || 'b' END AS no_ids,
        CASE WHEN k % 5 = 2 THEN 'length mismatch: 1 vs 2' END AS issue FROM c""",
    "interval_slots": f"""WITH {v.MARKETS} SELECT market_id, s AS slot_start, s + INTERVAL 15 MINUTE AS slot_end, 'updown-15m-' || CAST(epoch(s) AS BIGINT) AS slug
      FROM markets, LATERAL (SELECT unnest(generate_series(market_start_ts, market_start_ts + INTERVAL 1 DAY, INTERVAL 15 MINUTE)) AS s)""",
    "merged_mapping": """SELECT c_custkey AS market_id, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment ELSE c_name END AS question, CASE WHEN c_custkey % 5 = 0 THEN 'manual' END AS note
      FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 5 = 0""",
    "upserted_markets": """SELECT c_custkey AS market_id, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS version, c_custkey % 2 <> 0 AS is_new
      FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""",
    "nested_entities": "SELECT CAST(c_custkey AS VARCHAR) AS entity_id, c_name AS name FROM customer",
    "latest_signals": f"""WITH {v.EV}, b AS (SELECT event_id % 5000 AS signal_id, event_id, ts, event_type, true AS queued, 0 AS src FROM ev WHERE event_type = 'click' AND k % 2 = 1
          UNION ALL SELECT event_id % 5000, event_id, ts, event_type, false, 1 FROM ev WHERE event_type IN ('view', 'click') AND k % 2 = 1),
      r AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY src, ts) AS rn FROM b WHERE ts >= TIMESTAMP '2024-01-24')
      SELECT signal_id, event_id, queued, ts AS sample_ts FROM r WHERE rn = 1""",
    "newest_runs": f"WITH {v.EV} SELECT event_type AS mode, k % 2 = 0 AS forced, CAST(arg_max(event_id, ts) AS VARCHAR) AS run_id, max(ts) AS created_at FROM ev GROUP BY 1, 2",
    "retained_rows": "SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS rows FROM events WHERE ts >= TIMESTAMP '2024-01-23' AND ts < TIMESTAMP '2024-01-30' GROUP BY 1",
}
