"""Landing payloads derived from the event bars (K0), for round-trip checks:
REST kline pages, stream messages, zipped CSV files with checksum sidecars,
and bucket-listing XML pages. Expected output is K0 itself (or K0 with the
documented change), so DuckDB stays the oracle.

The zip writer uses Python file IO inside ``mapInArrow`` and so needs a
folder every task can write to (the session's checkpoint root on a shared
file system).
"""

from __future__ import annotations

import hashlib
import io
import itertools
import os
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick import fixtures as fx

INTERVAL = "15m"
LISTING_ROOT = "data/futures/um"
SHIFT = 1.0 / 64      # close change carried by the daily re-publication


def _ms(c) -> Column:
    return F.unix_millis(F.col(c).cast("timestamp"))


def _txt(c) -> Column:
    return F.col(c).cast("string")


def _close_ms() -> Column:
    return _ms("open_time") + F.lit(15 * 60 * 1000 - 1)


# ---------------------------------------------------------------------------- REST pages

def rest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, value): one page per symbol and day, numbers as JSON numbers,
    prices as JSON strings, as the exchange sends them."""
    k0 = fx.event_bars(spark, sf_dir)
    rec = F.concat(
        F.lit("["), _ms("open_time").cast("string"),
        *[F.concat(F.lit(',"'), _txt(c), F.lit('"')) for c in ("open", "high", "low", "close", "volume")],
        F.lit(","), _close_ms().cast("string"),
        F.lit(',"'), _txt("quote_volume"), F.lit('",'), _txt("trade_num"),
        F.lit(',"'), _txt("taker_buy_base_asset_volume"), F.lit('","'), _txt("taker_buy_quote_asset_volume"),
        F.lit('","0"]'))
    pages = k0.groupBy("symbol", F.to_date("open_time").alias("day")).agg(F.collect_list(rec).alias("recs"))
    return pages.select("symbol", F.concat(F.lit("["), F.array_join("recs", ","), F.lit("]")).alias("value"))


# ---------------------------------------------------------------------------- stream messages

def stream_messages(spark: SparkSession, sf_dir: str, k0: DataFrame | None = None) -> DataFrame:
    """(value): per bar (of ``k0``, by default every event bar) a closed kline
    message and an unclosed update; repeats of the closed message (trade_num >= 2),
    malformed text (trade_num >= 3), ticker messages (zero volume) and envelopes
    without data (trade_num = 1)."""
    k0 = fx.event_bars(spark, sf_dir) if k0 is None else k0

    def kline(closed: bool, close: Column) -> Column:
        k = F.struct(_ms("open_time").alias("t"), _close_ms().alias("T"), F.col("symbol").alias("s"),
                     F.lit(INTERVAL).alias("i"), _txt("open").alias("o"), close.cast("string").alias("c"),
                     _txt("high").alias("h"), _txt("low").alias("l"), _txt("volume").alias("v"),
                     F.col("trade_num").alias("n"), F.lit(closed).alias("x"), _txt("quote_volume").alias("q"),
                     _txt("taker_buy_base_asset_volume").alias("V"), _txt("taker_buy_quote_asset_volume").alias("Q"))
        data = F.struct(F.lit("kline").alias("e"), _close_ms().alias("E"), F.col("symbol").alias("s"), k.alias("k"))
        return F.to_json(F.struct(F.concat(F.lower("symbol"), F.lit("@kline_15m")).alias("stream"), data.alias("data")))

    closed = kline(True, F.col("close"))
    tn = F.col("trade_num")
    msgs = F.array_compact(F.array(
        closed,
        kline(False, F.col("close") + F.lit(1.0)),
        F.when(tn >= 2, closed),
        F.when(tn >= 3, F.concat(F.lit('{"data": {"e": "kline", "k": '), F.col("symbol"))),
        F.when(F.col("volume") == 0, F.to_json(F.struct(F.struct(F.lit("24hrTicker").alias("e"),
                                                                  F.col("symbol").alias("s")).alias("data")))),
        F.when(tn == 1, F.lit('{"result": null, "id": 1}')),
    ))
    return k0.select(F.explode(msgs).alias("value"))


# ---------------------------------------------------------------------------- zipped CSV

def _put(store: fs.FileSystem, name: str, data: bytes) -> None:
    with store.open_output_stream(name) as out:
        out.write(data)


def _write_zip(path: str, lines: list[str], header: bool, good_sum: bool, made: set[str]) -> str:
    """Write a zip and its sidecar to the store that the path's scheme names (hdfs, s3, file)."""
    store, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    if os.path.dirname(name) not in made:
        store.create_dir(os.path.dirname(name), recursive=True)
        made.add(os.path.dirname(name))
    if header:
        lines = [",".join(("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume",
                           "count", "taker_buy_volume", "taker_buy_quote_volume", "ignore"))] + lines
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        zf.writestr(os.path.basename(path)[:-4] + ".csv", "\n".join(lines) + "\n")
    data = buf.getvalue()
    _put(store, name, data)
    digest = hashlib.sha256(data).hexdigest()
    sidecar = digest if good_sum else hashlib.sha256(b"").hexdigest()
    _put(store, name + ".CHECKSUM", f"{sidecar}  {os.path.basename(path)}\n".encode())
    return digest


def _write_zips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code: one zip a path from lines in order of path and time; one file's lines are held at a time."""
    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("path", "line", "header", "good_sum")))

    made: set[str] = set()
    for path, group in itertools.groupby(rows(), key=lambda r: r[0]):
        _, first, header, good_sum = next(group)
        digest = _write_zip(path, [first, *(r[1] for r in group)], header, good_sum, made)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([digest])], ["path", "sha256"])


def write_zip_archive(spark: SparkSession, sf_dir: str, root: str) -> DataFrame:
    """Write K0 as zipped CSV under ``root``; returns (path, sha256) per file.

    monthly_klines/<SYM>/<SYM>-15m-<YYYY-MM>.zip: header row; epochs in
    microseconds when the symbol name has odd length, else milliseconds;
    the checksum sidecar is wrong for those odd-length symbols.
    daily_klines/<SYM>/<SYM>-15m-<YYYY-MM-DD>.zip for each symbol's last day:
    no header, millisecond epochs, close shifted by 1/64 (a re-published day).
    """
    k0 = fx.event_bars(spark, sf_dir)
    odd = (F.length("symbol") % 2) == 1
    last_day = k0.groupBy("symbol").agg(F.max(F.to_date("open_time")).alias("day"))

    def line(epoch: Column, close: Column) -> Column:
        return F.concat_ws(",", epoch.cast("string"), _txt("open"), _txt("high"), _txt("low"), close.cast("string"),
                           _txt("volume"), _close_ms().cast("string"), _txt("quote_volume"), _txt("trade_num"),
                           _txt("taker_buy_base_asset_volume"), _txt("taker_buy_quote_asset_volume"), F.lit("0"))

    month = F.date_format("open_time", "yyyy-MM")
    monthly = k0.select(
        F.concat(F.lit(f"{root}/monthly_klines/"), "symbol", F.lit("/"), "symbol", F.lit(f"-{INTERVAL}-"), month,
                 F.lit(".zip")).alias("path"),
        "open_time", line(F.when(odd, _ms("open_time") * 1000).otherwise(_ms("open_time")), F.col("close")).alias("line"),
        F.lit(True).alias("header"), (~odd).alias("good_sum"))
    daily_rows = k0.join(last_day, (k0["symbol"] == last_day["symbol"]) & (F.to_date(k0["open_time"]) == last_day["day"]),
                         "left_semi")
    daily = daily_rows.select(
        F.concat(F.lit(f"{root}/daily_klines/"), "symbol", F.lit("/"), "symbol", F.lit(f"-{INTERVAL}-"),
                 F.date_format("open_time", "yyyy-MM-dd"), F.lit(".zip")).alias("path"),
        "open_time", line(_ms("open_time"), F.col("close") + F.lit(SHIFT)).alias("line"),
        F.lit(False).alias("header"), F.lit(True).alias("good_sum"))
    return write_zips(monthly.unionByName(daily))


def write_zips(lines: DataFrame) -> DataFrame:
    """Write (path, open_time, line, header, good_sum) rows as one zip and sidecar a path
    (a symbol's month or day); returns (path, sha256) per file."""
    return (lines.repartition("path").sortWithinPartitions("path", "open_time")
            .mapInArrow(_write_zips, "path string, sha256 string"))


# ---------------------------------------------------------------------------- listing pages

def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value): XML listing pages, one per symbol and month for the daily
    prefix and one per symbol for the monthly prefix; each day/month with bars
    lists its zip and its CHECKSUM, LastModified one day and two hours after."""
    k0 = fx.event_bars(spark, sf_dir)
    days = k0.select("symbol", F.to_date("open_time").alias("day")).distinct()

    def contents(key: Column, modified: Column) -> Column:
        ts = F.date_format(modified, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        return F.concat(F.lit("<Contents><Key>"), key, F.lit("</Key><LastModified>"), ts,
                        F.lit("</LastModified></Contents>"))

    def page(prefix: Column, items: Column) -> Column:
        return F.concat(F.lit("<ListBucketResult><Name>data</Name><Prefix>"), prefix, F.lit("</Prefix>"),
                        F.array_join(items, ""), F.lit("<IsTruncated>false</IsTruncated></ListBucketResult>"))

    dprefix = F.concat(F.lit(f"{LISTING_ROOT}/daily/klines/"), "symbol", F.lit(f"/{INTERVAL}/"))
    dkey = F.concat(dprefix, "symbol", F.lit(f"-{INTERVAL}-"), F.date_format("day", "yyyy-MM-dd"), F.lit(".zip"))
    dmod = F.to_timestamp_ntz(F.date_add("day", 1)) + F.expr("INTERVAL 2 HOURS")
    daily = (days.select("symbol", F.date_format("day", "yyyy-MM").alias("m"),
                         contents(dkey, dmod).alias("a"), contents(F.concat(dkey, F.lit(".CHECKSUM")), dmod).alias("b"))
             .groupBy("symbol", "m").agg(F.collect_list(F.concat("a", "b")).alias("items"))
             .select(page(dprefix, F.array_sort("items")).alias("value")))
    months = days.select("symbol", F.trunc("day", "month").alias("mon")).distinct()
    mprefix = F.concat(F.lit(f"{LISTING_ROOT}/monthly/klines/"), "symbol", F.lit(f"/{INTERVAL}/"))
    mkey = F.concat(mprefix, "symbol", F.lit(f"-{INTERVAL}-"), F.date_format("mon", "yyyy-MM"), F.lit(".zip"))
    mmod = F.to_timestamp_ntz(F.add_months("mon", 1)) + F.expr("INTERVAL 2 HOURS")
    monthly = (months.select("symbol", contents(mkey, mmod).alias("a"),
                             contents(F.concat(mkey, F.lit(".CHECKSUM")), mmod).alias("b"))
               .groupBy("symbol").agg(F.collect_list(F.concat("a", "b")).alias("items"))
               .select(page(mprefix, F.array_sort("items")).alias("value")))
    return daily.unionByName(monthly)
