import datetime as dt
import gzip
import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scalars as fn
from tidemark.sources import bronze, markets, raw, tables


def write_raw(tmp_path):
    day1, day2 = tmp_path / "20240101", tmp_path / "20240102"
    day1.mkdir(), day2.mkdir()
    book = {"recv_ns": 1704067200123456789, "raw": [{"market": "m", "asset_id": "y", "timestamp": "1704067200000", "bids": [["0.4", "4"], ["0.1", "1"]], "asks": []}]}
    trade = {"recv_ns": 1704067201000000000, "raw": {"stream": "btc@aggTrade", "data": {"p": "1.5", "q": "2", "m": True}}}
    (day1 / "a.jsonl").write_text("\n".join([json.dumps(book), "", "[1,2]", "{broken", json.dumps(trade)]) + "\n")
    with gzip.open(day2 / "b.jsonl.gz", "wt") as fh:
        fh.write(json.dumps(trade) + "\n")
    (day2 / "c.txt").write_text("ignored")
    return str(tmp_path)


def test_reads_lines_and_reports_bad_ones(spark, tmp_path):
    root = write_raw(tmp_path)
    lines = raw.raw_lines(spark, [root])
    status = {r.source_file.rsplit("/", 1)[1]: r for r in raw.read_status(raw.parse_lines(lines)).collect()}
    assert set(status) == {"a.jsonl", "b.jsonl.gz"}
    a = status["a.jsonl"]
    assert (a.lines, a.readable_rows, a.corrupt_rows, a.kept_readable_part) == (4, 2, 1, True)
    assert raw.raw_lines(spark, [root], start_date="20240102").select("source_file").distinct().count() == 1
    assert raw.raw_lines(spark, [root], end_date="20240101").select("source_file").distinct().count() == 1


def test_typed_tables_from_files(spark, tmp_path):
    rows = bronze.typed(raw.records(raw.parse_lines(raw.raw_lines(spark, [write_raw(tmp_path)]))))
    built = bronze.build(rows)
    b = built[bronze.ORDER_BOOK].first()
    assert (b.market_id, b.asset_id, b.best_bid, b.bid_size_1, b.best_ask, b.ask_depth_5, b.mid) == ("m", "y", 0.4, 4.0, None, None, None)
    assert b.ts_event == dt.datetime(2024, 1, 1) and b.date == "2024-01-01"
    # the same trade in two files counts once, or once per file
    assert built[bronze.TRADE].count() == 1
    assert bronze.build(rows, only=[bronze.TRADE], per_file=True)[bronze.TRADE].count() == 2
    t = built[bronze.TRADE].first()
    assert (t.symbol, t.side, t.notional, t.ts_event) == ("BTC", "sell_aggressor", 3.0, t.ts_recv)


def test_truncated_gzip_keeps_the_readable_part(spark, tmp_path):
    text = "\n".join(json.dumps({"i": i, "pad": str(i * 7919) * 20}) for i in range(4_000))
    data = gzip.compress(text.encode())
    (tmp_path / "t.jsonl.gz").write_bytes(data[: len(data) // 2])
    n = raw.records(raw.parse_lines(raw.raw_lines(spark, [str(tmp_path)]))).count()
    assert 0 < n < 4_000


def test_whole_file_json(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"a":1},\n 5, {"a":2}]')
    files = raw.raw_lines(spark, [str(tmp_path)], glob="*.json", whole_file=True)
    got = raw.whole_file_records(files).select(F.try_variant_get("rec", "$.a", "int").alias("a")).collect()
    assert sorted(r.a for r in got) == [1, 2]


def test_record_types_in_order(spark):
    cases = {
        '{"raw":{"stream":"x@bookTicker","event_type":"price_change"}}': "best_quote",
        '{"raw":{"event_type":"price_change","bids":[],"asks":[]}}': "price_change",
        '{"raw":{"bids":null,"asks":[]}}': "order_book",
        '{"raw":{"event_type":"tick_size_change"}}': "market_tick_size_change",
        '{"bids":[],"asks":[]}': "order_book",
        '{"raw":[]}': "unknown",
        '{"raw":{"price_changes":[{}]}}': "price_change",
    }
    lines = spark.createDataFrame([(c, "f") for c in cases], "line string, source_file string")
    got = {r.line: r.record_type for r in bronze.typed(raw.records(raw.parse_lines(lines))).select("line", "record_type").collect()}
    assert got == cases


def test_profile_follows_all_elements(spark):
    lines = spark.createDataFrame([('{"a":{"ts":1},"l":[{"x":1},{"y":"v"}]}', "f"), ('{"a":{"ts":2}}', "f")], "line string, source_file string")
    rows = {r.path: r for r in raw.profile(raw.records(raw.parse_lines(lines))).collect()}
    assert set(rows) == {"a", "a.ts", "l", "l[].x", "l[].y"}
    assert rows["a.ts"].occurrences == 2 and rows["a.ts"].samples == ["1", "2"] and rows["a.ts"].time_candidate


def test_epochs(spark):
    texts = ["1704067200", "1704067200123", "1704067200123456", "1704067200123456789", "2024-01-01T02:00:00+02:00", "2024-01-01T00:00:00Z", "x", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.v for r in df.orderBy("i").select(fn.parse_epoch("t").alias("v")).collect()]
    base = dt.datetime(2024, 1, 1)
    assert got == [base, base.replace(microsecond=123000), base.replace(microsecond=123456), base.replace(microsecond=123456), base, base, None, None, None]


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "date string, market_id string, v int"
    tables.write_partitioned(spark.createDataFrame([("d1", "a", 1), ("d2", "a", 2)], schema), path, ["date", "market_id"])
    tables.write_partitioned(spark.createDataFrame([("d2", "a", 9)], schema), path, ["date", "market_id"])
    assert sorted((r.date, r.v) for r in tables.scan_table(spark, path).collect()) == [("d1", 1), ("d2", 9)]
    chosen = spark.createDataFrame([("d2", "a")], "date string, market_id string")
    assert [r.v for r in tables.read_selected(tables.scan_table(spark, path), chosen).collect()] == [9]
    empty = tables.scan_table(spark, str(tmp_path / "none"), T.StructType([T.StructField("x", T.IntegerType())]))
    assert empty.count() == 0 and empty.columns == ["x"]


def test_drifting_schemas(spark, tmp_path):
    a, b = str(tmp_path / "t/p=1"), str(tmp_path / "t/p=2")
    spark.createDataFrame([(1, "x")], "id int, s string").write.parquet(a)
    spark.createDataFrame([(2, True)], "id int, is_forced_signal boolean").write.parquet(b)
    df = tables.read_columns(spark, str(tmp_path / "t"), ["id", "is_forced_signal", "missing"])
    assert df.columns == ["id", "is_forced_signal"]
    got = {r.id: r.is_forced_signal for r in tables.with_flag_default(df).collect()}
    assert got == {1: False, 2: True}
    wide = tables.union_widened([spark.createDataFrame([(1,)], "v int"), spark.createDataFrame([(0.5, "q")], "v double, w string")])
    assert sorted((r.v, r.w) for r in wide.fillna("-").collect()) == [(0.5, "q"), (1.0, "-")]


def test_csv_and_feature_lists(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, 1, "train")], "id int, mid_price double, label_up int, split string")
    tables.write_csv(df, str(tmp_path / "c"))
    back = tables.read_csv(spark, str(tmp_path / "c"), df.schema)
    assert back.collect() == df.collect()
    lists = tables.feature_lists(df, labels=["label_up"], exclude=["id"])
    assert lists == {"features": ["mid_price"], "labels": ["label_up"]}
    tables.write_feature_lists(df, str(tmp_path / "f"), labels=["label_up"], exclude=["id"])
    assert json.loads(spark.read.text(str(tmp_path / "f")).first().value) == lists


def test_nothing_is_too_deep(spark):
    text = '{"a":[[{"b":{"c":[{"d":{"e":{"market_id":"7"}}}]}}]]}'
    recs = spark.createDataFrame([("f", text), ("f", '{"x":1}')], "source_file string, t string").select(
        "source_file", F.parse_json("t").alias("rec")
    )
    paths = {(r.path, r.value) for r in raw.record_paths(recs, keep=["source_file"]).collect()}
    assert ("a[][].b.c[].d.e.market_id", "7") in paths and ("x", "1") in paths and len(paths) == 7
    assert [r.entity_id for r in markets.find_entities(recs).collect()] == ["7"]


def test_typed_profile_equals_a_loop(spark):
    import json
    from collections import Counter, defaultdict

    records = [
        {"a": {"b": [1, "x", None, {"c": [True, {"d": {"e": 0.25}}]}]}, "t": "s"},
        {"a": {"b": {"c": 2}}, "t": [1, [2, ["deep"]]], "z": {}},
        {"a": None, "t": 7, "u": "s"},
    ]
    lines = [json.dumps(r) for r in records] + ["{broken", "[1]"]
    df = spark.createDataFrame([(x, "f") for x in lines], "line string, source_file string")
    got = {r["path"]: r for r in raw.typed_profile(raw.records(raw.parse_lines(df))).collect()}
    kinds, keys, values = defaultdict(Counter), defaultdict(set), defaultdict(list)

    def walk(path, v):
        kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(v), "number")
        kinds[path][kind] += 1
        if isinstance(v, dict):
            for k, x in v.items():
                keys[path].add(k)
                walk(f"{path}.{k}" if path else k, x)
        elif isinstance(v, list):
            for x in v:
                walk(f"{path}[]", x)
        elif v is not None:
            values[path].append(json.dumps(v) if not isinstance(v, str) else v)

    for r in records:
        walk("", r)
    assert got.keys() == kinds.keys()
    for path, count in kinds.items():
        row = got[path]
        assert row["occurrences"] == sum(count.values())
        assert {k: row[f"n_{k}"] for k in raw.KINDS} == {k: count[k] for k in raw.KINDS}
        assert row["keys"] == sorted(keys[path])
        assert (row["least_value"], row["greatest_value"]) == ((min(values[path]), max(values[path])) if values[path] else (None, None))
        assert row["some_value"] in (values[path] or [None])
    assert raw.typed_profile(raw.records(raw.parse_lines(df.where("false")))).collect() == []


def test_settled_results_of_one_small_file_use_many_tasks(spark, tmp_path):
    """One file of few bytes is one task, and every record costs a parse."""
    from tidemark.catalog import feeds

    spark.range(1, 41).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    out = feeds.settled_results(spark, str(tmp_path))
    assert out.rdd.getNumPartitions() > 1
    for r in out.collect():
        k = r["c_custkey"]
        want = 0 if k % 11 == 0 or k % 13 == 0 else 1 if k % 3 == 0 or k % 5 == 0 else None if k % 5 in (1, 2) else 0
        assert r["settled_yes"] == want
    assert feeds.market_metadata_rows(spark, str(tmp_path)).rdd.getNumPartitions() > 1
