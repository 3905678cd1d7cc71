"""Symbol universes: trading filters per market type, suffix rules, and set
differences between symbol snapshots. All are column predicates or
semi/anti joins on ``symbol``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.schema import (
    LEVERAGED_EXCEPTIONS, LEVERAGED_SUFFIXES, SPOT_STABLE_ASSETS, STABLECOINS, TRADING_MARKET_TYPES,
)


def _any(preds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, preds)


def is_leveraged(symbol: Column) -> Column:
    return _any([symbol.endswith(s) for s in LEVERAGED_SUFFIXES]) & ~symbol.isin(*LEVERAGED_EXCEPTIONS)


def trading_predicate(market_type: str, keep_stablecoins: bool = False) -> Column:
    """Predicate over instrument rows for one of the nine market types."""
    if market_type not in TRADING_MARKET_TYPES:
        raise ValueError(f"unknown market type {market_type!r}")
    kind, quote, types = TRADING_MARKET_TYPES[market_type]
    pred = F.col("status") == F.lit("TRADING")
    if quote is not None:
        pred = pred & (F.col("quote_asset") == F.lit(quote))
    if kind == "spot":
        if not keep_stablecoins:
            pred = pred & ~F.col("symbol").isin(*STABLECOINS)
    else:
        pred = pred & F.col("contract_type").isin(*types)
    return F.coalesce(pred, F.lit(False))


def trading_instruments(instruments: DataFrame, market_type: str) -> DataFrame:
    return instruments.filter(trading_predicate(market_type))


def usdt_symbols(symbols: DataFrame) -> DataFrame:
    """Symbols quoted in USDT."""
    return symbols.filter(F.col("symbol").endswith("USDT"))


def spot_symbols(symbols: DataFrame) -> DataFrame:
    """Drop leveraged tokens and the ten stable pairs; JUPUSDT always stays."""
    s = F.col("symbol")
    stable = [a + "USDT" for a in SPOT_STABLE_ASSETS]
    leveraged = _any([s.endswith(x) for x in LEVERAGED_SUFFIXES])
    keep = s.isin(*LEVERAGED_EXCEPTIONS) | (~leveraged & ~s.isin(*stable))
    return symbols.filter(keep)


def tradable_universe(symbols: DataFrame) -> DataFrame:
    """Sorted distinct USDT symbols, no leveraged tokens, none of the fourteen stablecoins."""
    s = F.col("symbol")
    keep = s.endswith("USDT") & ~is_leveraged(s) & ~s.isin(*STABLECOINS)
    return symbols.select("symbol").filter(keep).distinct().orderBy("symbol")


def delisted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Symbols in ``old`` but not in ``new`` (J4): one row a symbol on both sides."""
    return old.select("symbol").distinct().join(new.select("symbol").distinct(), "symbol", "left_anti")


def onboarded(old: DataFrame, new: DataFrame) -> DataFrame:
    """Symbols in ``new`` but not in ``old``."""
    return delisted(new, old)


def symbols_at(bars: DataFrame, when) -> DataFrame:
    """Symbols with a bar opening exactly at ``when``."""
    return bars.filter(F.col("open_time") == F.lit(when)).select("symbol").distinct()


def members(instruments: DataFrame, symbols: DataFrame) -> DataFrame:
    """Instrument rows whose symbol is in ``symbols``."""
    return instruments.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
