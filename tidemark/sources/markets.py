"""The market dimension: metadata records, slots, votes, mapping, settled results."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import arrays as arr
from tidemark.functions import scalars as fn
from tidemark.functions.jsonfields import any_case, first_field, is_object, lowered_fields, text_array
from tidemark.operators.pick import top_per_group
from tidemark.operators.scan import micros
from tidemark.sources import fields as f
from tidemark.sources.raw import descendants


def interval_slots(
    spans: DataFrame, *, start: str, stop: str, minutes: int = 15, prefix: str = "updown-15m-"
) -> DataFrame:
    """Fixed-width slots from floor(start) to floor(stop) inclusive, with a key per slot."""
    width = minutes * 60
    first, last = fn.floor_seconds(start, width), fn.floor_seconds(stop, width)
    step = F.make_dt_interval(mins=F.lit(minutes))
    rows = spans.select(*spans.columns, F.explode(F.sequence(first, last, step)).alias("slot_start"))
    return rows.select(
        *spans.columns,
        "slot_start",
        (F.col("slot_start") + step).alias("slot_end"),
        F.concat(F.lit(prefix), F.unix_timestamp("slot_start").cast("string")).alias("slug"),
    )


def market_rows(
    meta: DataFrame, *, record: str = "rec", default_start: str = "slot_start", default_end: str = "slot_end"
) -> DataFrame:
    """Metadata records (VARIANT) to market rows.

    Outcomes are zipped with the token ids; records without an up and a down side, or
    with lists of different length, are left out. A start more than an hour away from
    the slot is the record's creation time and is replaced by the slot's start.
    """
    outcomes = text_array(first_field(record, ("outcomes",)))
    ids = text_array(first_field(record, ("clobTokenIds", "clob_token_ids")))
    named = F.transform(outcomes, lambda o: F.lower(F.trim(o)))

    def position(words: Sequence[str]) -> Column:
        hits = F.transform(named, lambda o, i: F.when(o.isin(*words), i))
        return F.array_min(hits)

    start = F.coalesce(fn.parse_epoch(first_field(record, ("startDate", "start_date"))), F.col(default_start))
    end = F.coalesce(fn.parse_epoch(first_field(record, ("endDate", "end_date"))), F.col(default_end))
    off = F.abs(micros(start) - micros(default_start)) > 3_600 * 1_000_000
    up, down = position(("up", "yes")), position(("down", "no"))
    return (
        meta.withColumns({"__o": outcomes, "__i": ids, "__up": up, "__down": down})
        .where((F.size("__o") == F.size("__i")) & F.col("__up").isNotNull() & F.col("__down").isNotNull())
        .select(
            first_field(record, ("conditionId", "condition_id", "id")).alias("market_id"),
            F.get("__i", F.col("__up")).alias("yes_asset_id"),
            F.get("__i", F.col("__down")).alias("no_asset_id"),
            F.when(off, F.col(default_start)).otherwise(start).alias("market_start_ts"),
            end.alias("market_end_ts"),
            F.coalesce(first_field(record, ("question",)), F.lit("")).alias("question"),
            F.coalesce(first_field(record, ("slug",)), F.lit("")).alias("slug"),
            F.coalesce(fn.lenient_bool(first_field(record, ("active",))), F.lit(False)).alias("active"),
            F.coalesce(fn.lenient_bool(first_field(record, ("closed",))), F.lit(False)).alias("closed"),
        )
    )


def token_pairs(meta: DataFrame, *, record: str = "rec") -> DataFrame:
    """Ids classified YES / NO by outcome name, with the problem when they do not match up."""
    outcomes = text_array(first_field(record, ("outcomes",)))
    ids = text_array(first_field(record, ("clobTokenIds", "clob_token_ids")))
    base = meta.withColumns({"__o": outcomes, "__i": ids})
    sides = arr.side_ids("__o", "__i", fn.outcome_alias)
    out = base.withColumns(sides)
    incomplete = (F.size("__o") > 0) & ((F.size("yes_ids") == 0) | (F.size("no_ids") == 0))
    return out.withColumn(
        "issue", F.coalesce("issue", F.when(incomplete, "could not classify both outcomes"))
    ).drop("__o", "__i")


def asset_votes(rows: DataFrame) -> DataFrame:
    """Distinct asset ids seen per market and side (YES / NO)."""
    side = fn.outcome_exact("outcome")
    seen = (
        rows.where(F.col("asset_id").isNotNull() & side.isNotNull())
        .select("market_id", side.alias("side"), F.col("asset_id").cast("string").alias("asset_id"))
        .distinct()
    )
    return seen.groupBy("market_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == "YES", F.col("asset_id")))).alias("yes_ids"),
        F.array_sort(F.collect_list(F.when(F.col("side") == "NO", F.col("asset_id")))).alias("no_ids"),
    )


def mapping_status(markets: DataFrame, votes: DataFrame) -> DataFrame:
    """Every market with its pair of ids: ok (one each), conflict (some), unmapped (none)."""
    none = F.array().cast("array<string>")
    both = markets.join(votes, "market_id", "left").withColumns(
        {"yes_ids": F.coalesce("yes_ids", none), "no_ids": F.coalesce("no_ids", none)}
    )
    y, n = F.size("yes_ids"), F.size("no_ids")
    ok = (y == 1) & (n == 1)
    return both.withColumns(
        {
            "mapping_status": F.when(ok, "ok").when((y > 0) | (n > 0), "conflict").otherwise("unmapped"),
            "yes_asset_id": F.when(ok, F.get("yes_ids", F.lit(0))),
            "no_asset_id": F.when(ok, F.get("no_ids", F.lit(0))),
        }
    )


def market_spans(events: DataFrame, *, duration_seconds: int = 300) -> DataFrame:
    """Start (earliest event) and derived end of each market, from two columns of the scan."""
    first = events.groupBy("market_id").agg(F.min("ts_event").alias("start_ts"))
    return first.withColumn("end_ts", fn.plus_ms("start_ts", duration_seconds * 1000))


def override_spans(spans: DataFrame, meta: DataFrame) -> DataFrame:
    """Metadata times win over derived ones."""
    m = meta.select("market_id", F.col("market_start_ts").alias("__ms"), F.col("market_end_ts").alias("__me"))
    return spans.join(m, "market_id", "left").select(
        "market_id",
        F.coalesce("__ms", "start_ts").alias("start_ts"),
        F.coalesce("__me", "end_ts").alias("end_ts"),
    )


def sampled_ids(events: DataFrame, *, k: int = 4) -> DataFrame:
    """The first k distinct asset ids of each market."""
    ids = events.where("asset_id IS NOT NULL").select("market_id", "asset_id").distinct()
    few = top_per_group(ids, keys=["market_id"], score="asset_id", tie=["asset_id"], k=k, descending=False)
    return few.groupBy("market_id").agg(F.array_sort(F.collect_list("asset_id")).alias("asset_ids"))


def has_outcome(events: DataFrame) -> DataFrame:
    """Earliest time and whether any outcome is known, per market."""
    return events.groupBy("market_id").agg(
        F.min("ts_event").alias("first_ts"), (F.count("outcome") > 0).alias("has_outcome")
    )


def discovered(*tables: DataFrame) -> DataFrame:
    """Distinct market ids over several tables (partition values where partitioned)."""
    out = tables[0].select("market_id")
    for t in tables[1:]:
        out = out.unionByName(t.select("market_id"))
    return out.distinct()


def merge_mapping(generated: DataFrame, manual: DataFrame, *, key: str = "market_id") -> DataFrame:
    """Manual rows replace generated rows of the same key as a whole."""
    cols = [c for c in generated.columns if c != key]
    g = generated.select(key, F.struct(*cols).alias("__g"))
    m = manual.select(key, F.struct(*cols).alias("__m"))
    return g.join(m, key, "full_outer").select(key, F.coalesce("__m", "__g").alias("__r")).select(key, "__r.*")


def upsert(current: DataFrame, fresh: DataFrame, *, key: str = "market_id", stamp: str) -> DataFrame:
    """Newest row per key by ``stamp``; fresh rows win a tie. Adds ``is_new`` for unseen keys."""
    both = current.withColumn("__fresh", F.lit(0)).unionByName(fresh.withColumn("__fresh", F.lit(1)))
    cols = [c for c in current.columns if c != key]
    return both.groupBy(key).agg(
        F.max_by(F.struct(*cols), F.struct(stamp, "__fresh", *cols)).alias("__r"),
        (F.min("__fresh") == 1).alias("is_new"),
    ).select(key, "__r.*", "is_new")


def find_entities(docs: DataFrame, *, ids: Sequence[str] = ("market_id", "condition_id", "conditionId")) -> DataFrame:
    """Every object with an id key, however deep it stands in nested documents."""
    found = descendants(docs.select("rec")).where(is_object("v"))
    return found.select(first_field("v", ids).alias("entity_id"), F.col("v").alias("rec")).where("entity_id IS NOT NULL")


def settled_result(record: str | Column, yes_id: str | Column, no_id: str | Column) -> Column:
    """1 / 0 / null: the real outcome from whatever the metadata offers.

    In order: a winner id, a winner text, the side whose price is the highest (for ids
    only from 0.99 up), and the outcome name at that position. Keys may be spelt in any case.
    """
    rec = F.col(record) if isinstance(record, str) else record
    yes = F.col(yes_id) if isinstance(yes_id, str) else yes_id
    no = F.col(no_id) if isinstance(no_id, str) else no_id

    def by_id(v: Column) -> Column:
        return F.when(v == yes, 1).when(v == no, 0)

    def found(m: Column) -> Column:
        winner = F.coalesce(*[by_id(any_case(m, (n,))) for n in f.WINNER_ID])
        won = lambda t: F.when(t.isin(*f.WON_YES), 1).when(t.isin(*f.WON_NO), 0)
        text = F.coalesce(*[_let(F.lower(F.trim(any_case(m, (n,)))), won) for n in f.WINNER_TEXT])
        return F.coalesce(winner, text, _let(_offers(m), by_offer))

    def by_offer(o: Column) -> Column:
        by_price = F.when(F.array_max(o["prices"]) >= 0.99, by_id(F.get(o["ids"], o["at"])))
        name = F.lower(F.trim(F.get(o["names"], o["at"])))
        return F.coalesce(by_price, F.when(name == "yes", 1).when(name == "no", 0))

    return _let(lowered_fields(rec), found).cast("int")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once; a column that is named twice is computed twice."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _offers(members: Column) -> Column:
    """Prices, ids and names of the outcomes, and the place of the highest price."""
    prices = F.transform(text_array(any_case(members, ("outcomePrices", "outcome_prices"))), fn.lenient_double)
    ids = text_array(any_case(members, ("clobTokenIds", "clob_token_ids")))
    names = text_array(any_case(members, ("outcomes",)))
    return _let(prices, lambda p: F.struct(p.alias("prices"), arr.arg_max(p).alias("at"), ids.alias("ids"), names.alias("names")))


def compact_dimension(silver: DataFrame) -> DataFrame:
    """First row per market of the five dimension columns."""
    cols = ["market_id", "yes_asset_id", "no_asset_id", "market_start_ts", "market_end_ts"]
    return silver.groupBy("market_id").agg(
        F.min_by(F.struct(*cols[1:]), F.struct("sample_ts", *cols[1:])).alias("__r")
    ).select("market_id", "__r.*")


def build_dimension(events: DataFrame, meta: DataFrame | None = None, *, duration_seconds: int = 300) -> DataFrame:
    """Every market seen in the events with its pair of ids, status and time span.

    ``meta`` (market_id, market_start_ts, market_end_ts) overrides the derived span.
    """
    mapped = mapping_status(discovered(events), asset_votes(events))
    spans = market_spans(events, duration_seconds=duration_seconds)
    if meta is not None:
        spans = override_spans(spans, meta)
    spans = spans.withColumnsRenamed({"start_ts": "market_start_ts", "end_ts": "market_end_ts"})
    return mapped.join(spans, "market_id", "left").select(
        "market_id", "yes_asset_id", "no_asset_id", "mapping_status", "market_start_ts", "market_end_ts"
    )


def status_counts(dimension: DataFrame) -> DataFrame:
    return dimension.groupBy("mapping_status").agg(F.count("*").alias("markets"))


def with_market_of_asset(rows: DataFrame, markets: DataFrame) -> DataFrame:
    """Market and direction (UP for the yes side) of each row's asset; also for a stream."""
    sides = F.array(
        F.struct(F.col("yes_asset_id").alias("asset_id"), F.lit("UP").alias("direction")),
        F.struct(F.col("no_asset_id").alias("asset_id"), F.lit("DOWN").alias("direction")),
    )
    lookup = markets.select("market_id", F.explode(sides).alias("__s")).select("market_id", "__s.*")
    return rows.join(lookup, "asset_id")
