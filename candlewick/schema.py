"""Fixed schemas and constants of the bar data model."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import types as T

# Bar table, primary key (open_time, symbol). open_time is a naive UTC time.
BAR_COLUMNS = [
    "open_time",
    "symbol",
    "open",
    "high",
    "low",
    "close",
    "volume",
    "quote_volume",
    "trade_num",
    "taker_buy_base_asset_volume",
    "taker_buy_quote_asset_volume",
    "avg_price",
]

BAR_SCHEMA = T.StructType(
    [
        T.StructField("open_time", T.TimestampNTZType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
        T.StructField("quote_volume", T.DoubleType()),
        T.StructField("trade_num", T.IntegerType()),
        T.StructField("taker_buy_base_asset_volume", T.DoubleType()),
        T.StructField("taker_buy_quote_asset_volume", T.DoubleType()),
        T.StructField("avg_price", T.DoubleType()),
    ]
)

# Columns summed when bars are rolled up to a coarser interval.
SUM_COLUMNS = [
    "volume",
    "quote_volume",
    "taker_buy_base_asset_volume",
    "taker_buy_quote_asset_volume",
]

# Result of a resample, in this column order.
RESAMPLED_COLUMNS = [
    "resample_time",
    "open",
    "high",
    "low",
    "close",
    "volume",
    "quote_volume",
    "trade_num",
    "taker_buy_base_asset_volume",
    "taker_buy_quote_asset_volume",
    "avg_price",
    "symbol",
]

RESAMPLED_SCHEMA = T.StructType(
    [T.StructField("resample_time", T.TimestampNTZType())]
    + [f for f in BAR_SCHEMA.fields if f.name not in ("open_time", "symbol")]
    + [T.StructField("symbol", T.StringType())]
)

INSTRUMENT_COLUMNS = [
    "market",
    "symbol",
    "status",
    "base_asset",
    "quote_asset",
    "price_tick",
    "lot_size",
    "min_notional_value",
    "contract_type",
    "margin_asset",
    "pre_market",
]

STATE_SCHEMA = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("updated_at", T.TimestampNTZType()),
    ]
)

# ---------------------------------------------------------------------------
# Fixed values that must equal the source system's for identical results.
# ---------------------------------------------------------------------------

# "No data yet" watermark.
SENTINEL_TIME = _dt.datetime(2009, 1, 3, 0, 0, 0)

# Markets served by the query API.
QUERY_MARKETS = ("usdt_perp", "usdt_spot")

# Markets whose exchange-info payload can be parsed.
INSTRUMENT_MARKETS = ("usdt_perp", "coin_perp", "usdt_spot")

# Anchor month of the archive period calendar.
PERIOD_ANCHOR = _dt.date(2019, 1, 1)

# Stablecoin pairs excluded from the tradable universe (fourteen).
STABLECOINS = (
    "BKRWUSDT", "USDCUSDT", "USDPUSDT", "TUSDUSDT", "BUSDUSDT", "FDUSDUSDT", "DAIUSDT",
    "EURUSDT", "GBPUSDT", "USBPUSDT", "SUSDUSDT", "AEURUSDT", "USDSUSDT", "USDSBUSDT",
)

# Stable assets whose USDT pairs the spot symbol filter drops (ten).
SPOT_STABLE_ASSETS = ("BKRW", "USDC", "USDP", "TUSD", "BUSD", "FDUSD", "DAI", "EUR", "GBP", "AEUR")

# Leveraged-token suffixes; JUPUSDT ends in UPUSDT but is an ordinary pair.
LEVERAGED_SUFFIXES = ("UPUSDT", "DOWNUSDT", "BULLUSDT", "BEARUSDT")
LEVERAGED_EXCEPTIONS = ("JUPUSDT",)

# Delivery contract types.
DELIVERY_TYPES = ("CURRENT_QUARTER", "NEXT_QUARTER")

# Market type -> (kind, quote asset, contract types) for the trading-symbol filter.
TRADING_MARKET_TYPES = {
    "usdt_spot": ("spot", "USDT", None),
    "usdc_spot": ("spot", "USDC", None),
    "btc_spot": ("spot", "BTC", None),
    "usdt_perp": ("futures", "USDT", ("PERPETUAL",)),
    "usdt_deli": ("futures", "USDT", DELIVERY_TYPES),
    "usdc_perp": ("futures", "USDC", ("PERPETUAL",)),
    "btc_perp": ("futures", "BTC", ("PERPETUAL",)),
    "coin_perp": ("coin_futures", None, ("PERPETUAL",)),
    "coin_deli": ("coin_futures", None, DELIVERY_TYPES),
}

# Instrument filter defaults when the exchange omits a value:
# (price tick, lot size, min notional) per market.
INSTRUMENT_DEFAULTS = {
    "usdt_perp": ("0.01", "0.001", "5"),
    "usdt_spot": ("0.01", "0.001", "10"),
}

# Backfill page sizes and the maximum catch-up gap, in base bars.
SHORT_PAGE = 99
LONG_PAGE = 499

# Recent-tier retention and the hybrid-merge redundancy.
RETENTION_DAYS = 7
REDUNDANCY_HOURS = 1
