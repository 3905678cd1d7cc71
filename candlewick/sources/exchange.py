"""Exchange-info and funding payloads to typed rows.

Input is a DataFrame with one JSON document per row in ``value`` (landing
files read with ``spark.read.text`` or a stream). Each document is parsed
with ``from_json`` against a fixed schema; nested lookups use higher-order
functions (``filter``, ``exists``), so nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.functions.scalars import filter_field, has_permission
from candlewick.schema import INSTRUMENT_COLUMNS, INSTRUMENT_DEFAULTS, INSTRUMENT_MARKETS  # noqa: F401

_FILTER = T.StructType([T.StructField(n, T.StringType()) for n in
                        ("filterType", "tickSize", "stepSize", "notional", "minNotional")])

SYMBOL_INFO = T.StructType(
    [T.StructField(n, T.StringType()) for n in
     ("symbol", "status", "contractStatus", "baseAsset", "quoteAsset", "contractType",
      "marginAsset", "contractSize")]
    + [T.StructField("filters", T.ArrayType(_FILTER)),
       T.StructField("permissionSets", T.ArrayType(T.ArrayType(T.StringType())))]
)

EXCHANGE_INFO = T.StructType([T.StructField("symbols", T.ArrayType(SYMBOL_INFO))])

FUNDING = T.ArrayType(T.StructType([T.StructField("symbol", T.StringType()),
                                    T.StructField("lastFundingRate", T.StringType())]))


def _or_default(c, default: str | None):
    """Python-style ``value or default``: NULL and empty text both fall back."""
    if default is None:
        return c
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def parse_instruments(docs: DataFrame, market: str, value_col: str = "value") -> DataFrame:
    """Exchange-info documents to instrument rows of ``market``.

    usdt_perp: status, contract type, margin asset; tick/lot/min-notional
    default to 0.01 / 0.001 / 5. coin_perp: status from contractStatus, lot
    size from contractSize, no defaults. usdt_spot: min notional from the
    NOTIONAL filter (default 10), pre_market when any permission set holds
    PRE_MARKET, no contract type or margin asset.
    """
    if market not in INSTRUMENT_MARKETS:
        raise ValueError(f"market {market!r} not supported; use one of {INSTRUMENT_MARKETS}")
    s = (docs.select(F.from_json(F.col(value_col), EXCHANGE_INFO).alias("doc"))
             .select(F.explode("doc.symbols").alias("s")).select("s.*"))
    tick = filter_field("filters", "PRICE_FILTER", "tickSize")
    step = filter_field("filters", "LOT_SIZE", "stepSize")
    null = F.lit(None).cast("string")
    if market == "usdt_perp":
        d = INSTRUMENT_DEFAULTS[market]
        cols = dict(status=F.col("status"), contract_type=F.col("contractType"), margin_asset=F.col("marginAsset"),
                    price_tick=_or_default(tick, d[0]), lot_size=_or_default(step, d[1]),
                    min_notional_value=_or_default(filter_field("filters", "MIN_NOTIONAL", "notional"), d[2]),
                    pre_market=F.lit(None).cast("boolean"))
    elif market == "coin_perp":
        cols = dict(status=F.col("contractStatus"), contract_type=F.col("contractType"),
                    margin_asset=F.col("marginAsset"), price_tick=tick, lot_size=F.col("contractSize"),
                    min_notional_value=null, pre_market=F.lit(None).cast("boolean"))
    else:
        d = INSTRUMENT_DEFAULTS[market]
        cols = dict(status=F.col("status"), contract_type=null, margin_asset=null,
                    price_tick=_or_default(tick, d[0]), lot_size=_or_default(step, d[1]),
                    min_notional_value=_or_default(filter_field("filters", "NOTIONAL", "minNotional"), d[2]),
                    pre_market=has_permission(F.coalesce("permissionSets", F.array()), "PRE_MARKET"))
    cols.update(market=F.lit(market), symbol=F.col("symbol"), base_asset=F.col("baseAsset"),
                quote_asset=F.col("quoteAsset"))
    return s.select(*[cols[c].alias(c) for c in INSTRUMENT_COLUMNS])


def instruments_as_decimal(instruments: DataFrame) -> DataFrame:
    """View with the three size columns as DECIMAL(38,18) (text stays the stored form)."""
    out = instruments
    for c in ("price_tick", "lot_size", "min_notional_value"):
        out = out.withColumn(c, F.col(c).try_cast("decimal(38,18)"))
    return out


def parse_funding(docs: DataFrame, value_col: str = "value") -> DataFrame:
    """Premium-index documents to (symbol, funding_rate); unparsable rates are NULL."""
    return (docs.select(F.explode(F.from_json(F.col(value_col), FUNDING)).alias("f"))
                .select(F.col("f.symbol").alias("symbol"),
                        F.col("f.lastFundingRate").try_cast("double").alias("funding_rate")))
