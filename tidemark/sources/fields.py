"""Where each logical field may be found in the raw feeds.

Fixed values: candidate names in order of preference; the first non-null wins.
"""

RECV_TIME = ("recv_ns", "ts_recv", "received_at")

# exchange feed
STREAM = ("raw.stream", "stream")
PAYLOAD = ("raw.data", "data", "raw")
EXCHANGE_TIME = ("E", "T", "timestamp", "event_time", "transactTime")
SYMBOL = ("s", "symbol")
BID_PRICE = ("b", "bidPrice", "bid_price")
BID_QTY = ("B", "bidQty", "bid_qty")
ASK_PRICE = ("a", "askPrice", "ask_price")
ASK_QTY = ("A", "askQty", "ask_qty")
TRADE_PRICE = ("p", "price")
TRADE_QTY = ("q", "qty", "quantity")
BUYER_MAKER = ("m", "isBuyerMaker", "is_buyer_maker")
DEPTH_BIDS = ("bids", "b")
DEPTH_ASKS = ("asks", "a")

# market feed
MARKET_ID = ("market", "market_id")
ASSET_ID = ("asset_id", "token_id")
MARKET_TIME = ("timestamp", "ts_event", "event_time")
OUTCOME = ("outcome", "side_name", "token_outcome")
CHANGES = ("price_changes", "changes")

# settled result in market metadata
WINNER_ID = ("winning_asset_id", "winner_asset_id", "winning_token_id", "winner_token_id", "winningClobTokenId")
WINNER_TEXT = ("resolved_outcome", "winning_outcome", "winner", "result")
WON_YES = ("yes", "true", "1", "up", "above")
WON_NO = ("no", "false", "0", "down", "below")

# names that suggest a time or an id when profiling unknown records
TIME_TOKENS = ("time", "ts", "recv_ns", "timestamp")
TIME_ENDINGS = (".E", ".T")
ID_TOKENS = ("asset", "market", "symbol", "stream")
ID_ENDINGS = (".s", ".asset_id", ".market")
