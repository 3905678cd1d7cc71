import datetime as dt
import json

from candlewick.functions.scalars import epoch_to_time, strip_zeros
from candlewick.sources import exchange as EX
from candlewick.sources import listing as SL
from candlewick.sources.bars import parse_rest_bars, parse_stream_bars


def text_df(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_epoch_micro_and_milli_agree(spark):
    df = spark.createDataFrame([("1704067200000",), ("1704067200000000",)], "e string")
    got = {r[0] for r in df.select(epoch_to_time("e")).collect()}
    assert got == {dt.datetime(2024, 1, 1)}


def test_rest_bars_numbers_and_strings(spark):
    page = json.dumps([[1704067200000, "1.5", "2", "1", "1.75", "10", 1704068099999, "15", 7, "4", "6", "0"],
                       [1704068100000, "1", "1", "1", "1", "0", 1704068999999, "0", 0, "0", "0", "0"]])
    out = parse_rest_bars(spark.createDataFrame([("XUSDT", page)], "symbol string, value string")).collect()
    assert out[0]["open_time"] == dt.datetime(2024, 1, 1) and out[0]["trade_num"] == 7
    assert out[0]["avg_price"] == 1.5 and out[1]["avg_price"] is None
    assert out[0]["symbol"] == "XUSDT"


def test_stream_messages_filtered(spark):
    k = {"t": 1704067200000, "T": 1704068099999, "o": "1", "h": "2", "l": "0.5", "c": "1.5", "v": "2", "q": "3",
         "n": 4, "V": "1", "Q": "1.5", "x": True}
    good = json.dumps({"data": {"e": "kline", "s": "XUSDT", "k": k}})
    unclosed = json.dumps({"data": {"e": "kline", "s": "XUSDT", "k": {**k, "x": False}}})
    other = json.dumps({"data": {"e": "24hrTicker", "s": "XUSDT"}})
    out = parse_stream_bars(text_df(spark, [good, unclosed, other, "{broken", '{"result": null}'])).collect()
    assert len(out) == 1
    r = out[0]
    assert (r["volume"], r["taker_buy_base_asset_volume"], r["quote_volume"], r["trade_num"]) == (2.0, 1.0, 3.0, 4)


def test_instruments_defaults_and_permissions(spark):
    doc = {"symbols": [
        {"symbol": "AUSDT", "status": "TRADING", "baseAsset": "A", "quoteAsset": "USDT", "contractType": "PERPETUAL",
         "marginAsset": "USDT", "filters": [{"filterType": "PRICE_FILTER", "tickSize": ""}]},
        {"symbol": "BUSDT", "status": "BREAK", "baseAsset": "B", "quoteAsset": "USDT", "contractType": "PERPETUAL",
         "marginAsset": "USDT", "filters": []}]}
    perp = {r["symbol"]: r for r in EX.parse_instruments(text_df(spark, [json.dumps(doc)]), "usdt_perp").collect()}
    assert perp["AUSDT"]["price_tick"] == "0.01" and perp["AUSDT"]["lot_size"] == "0.001"
    assert perp["BUSDT"]["min_notional_value"] == "5"
    spot_doc = {"symbols": [{"symbol": "CUSDT", "status": "TRADING", "baseAsset": "C", "quoteAsset": "USDT",
                             "filters": [{"filterType": "NOTIONAL", "minNotional": "1.0"}],
                             "permissionSets": [["SPOT"], ["PRE_MARKET"]]},
                            {"symbol": "DUSDT", "status": "TRADING", "baseAsset": "D", "quoteAsset": "USDT",
                             "filters": []}]}
    spot = {r["symbol"]: r for r in EX.parse_instruments(text_df(spark, [json.dumps(spot_doc)]), "usdt_spot").collect()}
    assert spot["CUSDT"]["pre_market"] is True and spot["DUSDT"]["pre_market"] is False
    assert spot["CUSDT"]["min_notional_value"] == "1.0" and spot["DUSDT"]["min_notional_value"] == "10"
    dec = EX.instruments_as_decimal(EX.parse_instruments(text_df(spark, [json.dumps(spot_doc)]), "usdt_spot"))
    assert str(dec.schema["price_tick"].dataType) == "DecimalType(38,18)"


def test_funding_non_numeric_is_null(spark):
    doc = json.dumps([{"symbol": "A", "lastFundingRate": "0.0001"}, {"symbol": "B", "lastFundingRate": "n/a"}])
    got = {r["symbol"]: r["funding_rate"] for r in EX.parse_funding(text_df(spark, [doc])).collect()}
    assert got == {"A": 0.0001, "B": None}


def test_listing_and_selections(spark):
    xml = ("<ListBucketResult><Prefix>data/spot/daily/klines/XUSDT/1m/</Prefix>"
           "<Contents><Key>data/spot/daily/klines/XUSDT/1m/XUSDT-1m-2024-01-14.zip.CHECKSUM</Key>"
           "<LastModified>2024-01-15T02:00:00.000Z</LastModified></Contents>"
           "<Contents><Key>data/spot/daily/klines/XUSDT/1m/XUSDT-1m-2024-01-15.zip.CHECKSUM</Key>"
           "<LastModified>2024-01-16T02:00:00.000Z</LastModified></Contents>"
           "<Contents><Key>data/spot/daily/klines/XUSDT/1m/XUSDT-1m-2024-01-15.zip</Key>"
           "<LastModified>2024-01-16T02:00:00.000Z</LastModified></Contents>"
           "<IsTruncated>false</IsTruncated></ListBucketResult>")
    m = SL.parse_listing(text_df(spark, [xml]))
    rows = m.collect()
    assert {r["symbol"] for r in rows} == {"XUSDT"} and len(rows) == 3
    assert rows[0]["last_modified"] == dt.datetime(2024, 1, 15, 2)
    picked = [r["key"] for r in SL.select_daily(m, dt.date(2024, 1, 15)).collect()]
    assert picked == ["data/spot/daily/klines/XUSDT/1m/XUSDT-1m-2024-01-15.zip.CHECKSUM"]
    local = spark.createDataFrame([("XUSDT-1m-2024-01-15.zip.CHECKSUM", dt.datetime(2024, 1, 15))],
                                  "file_name string, local_mtime timestamp_ntz")
    need = {r["key"].rsplit("/", 1)[1]: r["reason"] for r in SL.stale_or_missing(m, local).collect()}
    assert need["XUSDT-1m-2024-01-15.zip.CHECKSUM"] == "stale"
    assert need["XUSDT-1m-2024-01-14.zip.CHECKSUM"] == "missing"


def test_strip_zeros(spark):
    df = spark.createDataFrame([("1.2300",), ("5.000",), ("100",), ("0.000",), ("0.0001",)], "v string")
    assert [r[0] for r in df.select(strip_zeros("v")).collect()] == ["1.23", "5", "100", "0", "0.0001"]
