"""Raw records to typed tables: record types, field mapping, dedupe, routing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import arrays as arr
from tidemark.functions import scalars as fn
from tidemark.functions.jsonfields import elements_or_self, field, first_array, first_field, is_object, once, price_levels
from tidemark.sources import fields as f

BEST_QUOTE, TRADE, DEPTH = "best_quote", "trade", "depth"
ORDER_BOOK, PRICE_CHANGE = "order_book", "price_change"

# partition columns of each table
PARTITIONS = {
    BEST_QUOTE: ("date", "symbol"),
    TRADE: ("date", "symbol"),
    DEPTH: ("date", "symbol"),
    ORDER_BOOK: ("date", "market_id"),
    PRICE_CHANGE: ("date", "market_id"),
}


def typed(recs: DataFrame) -> DataFrame:
    """Add ``raw`` (the wrapped payload, else the record itself) and ``record_type``.

    The kind follows from the stream name, then the shape, then the event type, in
    that order. Market events of any other type are ``market_<type>``; the router
    sends them with the price changes.
    """

    def both(at: str) -> Column:
        # the keys must be there; their values may be null
        has = [F.try_variant_get("raw", f"{at}.{n}", "variant").isNotNull() for n in ("bids", "asks")]
        return has[0] & has[1]

    # a path into the wrong shape is null
    probed = once(
        once(recs, {"raw": F.coalesce(field("rec", "raw", "variant"), F.col("rec"))}),
        {
            "__stream": F.lower(field("raw", "stream")),
            "__kind": field("raw", "event_type"),
            "__changes": F.size(field("raw", "price_changes", "array<variant>")),
            "__list_book": both("$[0]"),
            "__book": both("$"),
        },
    )
    kind = (
        F.when(F.col("__stream").contains("bookticker"), BEST_QUOTE)
        .when(F.col("__stream").contains("aggtrade"), TRADE)
        .when(F.col("__stream").contains("depth"), DEPTH)
        .when(F.col("__list_book"), ORDER_BOOK)
        .when((F.col("__changes") > 0) | (F.col("__kind") == "price_change"), PRICE_CHANGE)
        .when(F.col("__book"), ORDER_BOOK)
        .when(F.col("__kind") != "", F.concat(F.lit("market_"), F.col("__kind")))
        .otherwise("unknown")
    )
    return once(probed, {"record_type": kind}).drop("__stream", "__kind", "__changes", "__list_book", "__book")


def _exchange(rows: DataFrame, kind: str, texts: dict[str, Sequence[str]]) -> DataFrame:
    """Payload ``p``, times, symbol and the named text fields of exchange records.

    Fields are read as text in one projection and converted in the next, so that no
    path is walked twice.
    """
    out = once(
        rows.where(F.col("record_type") == kind).select("rec", "source_file"),
        {"p": first_field("rec", f.PAYLOAD, "variant")},
    ).where(is_object("p"))
    out = once(
        out,
        {
            "__recv": first_field("rec", f.RECV_TIME),
            "__event": first_field("p", f.EXCHANGE_TIME),
            "__symbol": first_field("p", f.SYMBOL),
            "__stream": first_field("rec", f.STREAM),
            **{f"__{n}": first_field("p", names) for n, names in texts.items()},
        },
    )
    out = once(out, {"__recv": fn.parse_epoch("__recv"), "__event": fn.parse_epoch("__event")})
    return out.withColumns(
        {
            "symbol": F.coalesce("__symbol", fn.symbol_from_stream("__stream")),
            "ts_event": F.coalesce("__event", "__recv"),
            "ts_recv": F.coalesce("__recv", "__event"),
        }
    )


def best_quotes(rows: DataFrame) -> DataFrame:
    names = {"bid_price": f.BID_PRICE, "bid_qty": f.BID_QTY, "ask_price": f.ASK_PRICE, "ask_qty": f.ASK_QTY}
    x = _exchange(rows, BEST_QUOTE, names).withColumns({n: fn.lenient_double(f"__{n}") for n in names})
    return x.select(
        "ts_event", "ts_recv", "symbol", "bid_price", "bid_qty", "ask_price", "ask_qty",
        fn.mid_price("bid_price", "ask_price").alias("mid_price"),
        fn.spread("bid_price", "ask_price").alias("spread"),
        fn.microprice("bid_price", "ask_price", "bid_qty", "ask_qty").alias("microprice"),
        "source_file",
    )


def trades(rows: DataFrame) -> DataFrame:
    x = _exchange(rows, TRADE, {"price": f.TRADE_PRICE, "qty": f.TRADE_QTY, "maker": f.BUYER_MAKER}).withColumns(
        {
            "price": fn.lenient_double("__price"),
            "qty": fn.lenient_double("__qty"),
            "is_buyer_maker": fn.lenient_bool("__maker"),
        }
    )
    maker = F.col("is_buyer_maker")
    return x.select(
        "ts_event", "ts_recv", "symbol", "price", "qty", "is_buyer_maker",
        F.when(maker, "sell_aggressor").when(~maker, "buy_aggressor").alias("side"),
        (F.col("price") * F.col("qty")).alias("notional"),
        "source_file",
    )


def depth(rows: DataFrame, levels: int = 5) -> DataFrame:
    """First levels of each side in feed order, wide, with their sums."""
    x = _exchange(rows, DEPTH, {}).withColumns(
        {
            "__bids": price_levels(first_array("p", f.DEPTH_BIDS), price=("price",), size=("size",), first=levels),
            "__asks": price_levels(first_array("p", f.DEPTH_ASKS), price=("price",), size=("size",), first=levels),
        }
    )
    wide = {**arr.wide_levels("__bids", "bid", levels), **arr.wide_levels("__asks", "ask", levels)}
    b, a = f"bid_depth_{levels}", f"ask_depth_{levels}"
    x = x.withColumns({b: arr.depth_sum("__bids", levels), a: arr.depth_sum("__asks", levels)})
    return x.select(
        "ts_event", "ts_recv", "symbol", "source_file",
        *[c.alias(n) for n, c in wide.items()],
        b,
        a,
        fn.imbalance(b, a).alias(f"depth_imbalance_{levels}"),
    )


def order_books(rows: DataFrame) -> DataFrame:
    """One row per book in the record (a record may hold a list of books)."""
    books = (
        rows.where(F.col("record_type") == ORDER_BOOK)
        .select(
            first_field("rec", f.RECV_TIME).alias("__recv"), "source_file", F.explode(elements_or_self("raw")).alias("b")
        )
        .where(is_object("b"))
    )
    x = once(
        books,
        {
            "__event": first_field("b", f.MARKET_TIME),
            "market_id": first_field("b", f.MARKET_ID),
            "asset_id": first_field("b", f.ASSET_ID),
            "outcome": first_field("b", f.OUTCOME),
            "__bids": price_levels(field("b", "bids", "array<variant>"), price=("price",), size=("size",)),
            "__asks": price_levels(field("b", "asks", "array<variant>"), price=("price",), size=("size",)),
        },
    )
    x = once(
        x,
        {
            "__recv": fn.parse_epoch("__recv"),
            "ts_event": fn.parse_epoch("__event"),
            "outcome": fn.outcome_exact("outcome"),
            "__bids": arr.sorted_levels("__bids", "bid"),
            "__asks": arr.sorted_levels("__asks", "ask"),
        },
    )
    sums = {f"{s}_depth_{n}": arr.depth_sum(f"__{s}s", n) for n in (3, 5) for s in ("bid", "ask")}
    x = once(x, {"__bb": arr.best_level("__bids"), "__ba": arr.best_level("__asks"), **sums}).withColumns(
        {
            "ts_recv": F.coalesce("__recv", "ts_event"),
            "best_bid": F.col("__bb.price"), "best_ask": F.col("__ba.price"),
            "bid_size_1": F.col("__bb.size"), "ask_size_1": F.col("__ba.size"),
        }
    )
    return x.select(
        "ts_event", "ts_recv", "market_id", "asset_id", "outcome", "best_bid", "best_ask",
        fn.mid_price("best_bid", "best_ask").alias("mid"),
        fn.spread("best_bid", "best_ask").alias("spread"),
        "bid_size_1", "ask_size_1",
        *sums,
        fn.imbalance("bid_depth_3", "ask_depth_3").alias("depth_imbalance_3"),
        fn.imbalance("bid_depth_5", "ask_depth_5").alias("depth_imbalance_5"),
        "source_file",
    )


def price_changes(rows: DataFrame) -> DataFrame:
    """One row per change; a change inherits market and time of its record."""
    is_market = (F.col("record_type") == PRICE_CHANGE) | F.col("record_type").startswith("market_")
    x = rows.where(is_market).select(
        "source_file",
        first_field("rec", f.RECV_TIME).alias("__recv"),
        first_field("raw", f.MARKET_TIME).alias("__outer"),
        first_field("raw", f.MARKET_ID).alias("__market"),
        field("raw", "event_type").alias("__kind"),
        F.explode(F.coalesce(first_array("raw", f.CHANGES), F.array("raw"))).alias("c"),
    ).where(is_object("c"))
    x = once(
        x,
        {
            "__inner": first_field("c", f.MARKET_TIME),
            "__own_market": first_field("c", f.MARKET_ID),
            "asset_id": first_field("c", f.ASSET_ID),
            "outcome": first_field("c", f.OUTCOME),
            "price": field("c", "price"),
            "best_bid": field("c", "best_bid"),
            "best_ask": field("c", "best_ask"),
            "side": field("c", "side"),
            "__own_kind": field("c", "event_type"),
        },
    )
    x = once(x, {n: fn.parse_epoch(n) for n in ("__recv", "__outer", "__inner")})
    return x.select(
        F.coalesce("__outer", "__inner").alias("ts_event"),
        F.coalesce("__recv", "__outer").alias("ts_recv"),
        F.coalesce("__market", "__own_market").alias("market_id"),
        "asset_id",
        fn.outcome_exact("outcome").alias("outcome"),
        fn.lenient_double("price").alias("price"),
        fn.lenient_double("best_bid").alias("best_bid"),
        fn.lenient_double("best_ask").alias("best_ask"),
        "side",
        F.coalesce("__kind", "__own_kind").alias("event_type"),
        "source_file",
    )


NORMALIZERS = {
    BEST_QUOTE: best_quotes,
    TRADE: trades,
    DEPTH: depth,
    ORDER_BOOK: order_books,
    PRICE_CHANGE: price_changes,
}


def dedupe(table: DataFrame, *, per_file: bool = False) -> DataFrame:
    """Drop rows equal in everything but the file; keeps the first file name.

    ``per_file`` keeps equal rows of different files apart.
    """
    if per_file:
        return table.dropDuplicates()
    rest = [c for c in table.columns if c != "source_file"]
    return table.groupBy(*rest).agg(F.min("source_file").alias("source_file")).select(*table.columns)


def build(
    rows: DataFrame,
    *,
    only: Sequence[str] | None = None,
    per_file: bool = False,
    stage: Callable[..., DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """All typed tables of a batch of records, deduplicated, with their ``date``.

    With ``stage`` (see :func:`tidemark.session.stage`) the records are parsed once and
    written by their type; each table then reads its own partition.
    """
    if stage:
        rows = stage(rows.select("rec", "raw", "source_file", "record_type"), "records", ("record_type",))
    out = {}
    for name, normalize in NORMALIZERS.items():
        if only and name not in only:
            continue
        table = dedupe(normalize(rows), per_file=per_file).where(F.col("ts_event").isNotNull())
        out[name] = table.withColumn("date", F.date_format("ts_event", "yyyy-MM-dd"))
    return out


def routed(kind: str | Column) -> Column:
    """Target table of a record type (null for unknown)."""
    k = F.col(kind) if isinstance(kind, str) else kind
    return F.when(k.startswith("market_"), PRICE_CHANGE).when(k != "unknown", k)


def file_type_counts(rows: DataFrame) -> DataFrame:
    """Records per file and target table, wide."""
    counted = rows.withColumn("target", F.coalesce(routed("record_type"), F.lit("unknown")))
    return counted.groupBy("source_file").agg(
        F.count("*").alias("records"),
        *[F.count_if(F.col("target") == t).alias(t) for t in [*NORMALIZERS, "unknown"]],
    )
